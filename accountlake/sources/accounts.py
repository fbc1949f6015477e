"""Account lists from files and tables."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from accountlake import vocab
from accountlake.config import FilterSpec
from accountlake.functions.text import strip
from accountlake.operators.predicates import TABLE, predicate
from accountlake.spark import stored


def _in_file_order(lines: DataFrame) -> DataFrame:
    """``lines`` with ``ord``: files by path, and the rows of a file from top to bottom.

    Spark deals files to tasks by size, so a row's place follows from its file, its block and its
    place in the block: blocks are counted, and a block's rows are numbered on from those before it.
    """
    block = ["_file", "_block"]
    placed = lines if "_at" in lines.columns else lines.withColumn("_at", F.monotonically_increasing_id())
    counts = placed.groupBy(*block).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy(*block).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*block, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy(*block).orderBy("_at"))
    return placed.withColumn("_i", inside).join(starts, block).withColumn("ord", F.col("_start") + F.col("_i") - 1)


_CELL = r'(?:^|,)(?:"((?:[^"]|"")*)"|([^,"]*))'


def _heads(spark: SparkSession, path: str) -> DataFrame:
    """The first line of every CSV file: ``_file``, its ``cells``, and ``column``, the place of the first known name (null: none)."""
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"))
    first = lines.where("_block = 0").withColumn("_at", F.monotonically_increasing_id()).groupBy("_file").agg(F.min_by("value", "_at").alias("line"))
    line = F.regexp_replace("line", "^\ufeff|\r$", "")
    cells = F.zip_with(
        F.regexp_extract_all(line, F.lit(_CELL), 1), F.regexp_extract_all(line, F.lit(_CELL), 2),
        lambda quoted, bare: F.when(quoted != "", F.replace(quoted, F.lit('""'), F.lit('"'))).otherwise(bare))
    names = F.transform("cells", lambda c: F.lower(F.trim(c)))
    known = F.coalesce(*[F.nullif(F.array_position("_names", name), F.lit(0)) for name in vocab.DOMAIN_COLUMNS])
    return first.select("_file", cells.alias("cells")).withColumn("_names", names).select("_file", "cells", known.cast("int").alias("column"))


def _csv_domains(spark: SparkSession, path: str, multiline: bool) -> DataFrame:
    """``domain, _file, _block, _at`` of CSV files, each by its own header."""
    heads = stored(_heads(spark, path), "heads")
    widths = heads.agg(F.coalesce(F.max(F.size("cells")), F.lit(1))).first()[0]
    columns = [f"_c{i}" for i in range(widths)]
    rows = spark.read.schema(", ".join(f"{c} string" for c in columns)).csv(
        path, header=True, enforceSchema=True, quote='"', escape='"', multiLine=multiline)
    rows = rows.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block")).withColumn(
        "_at", F.monotonically_increasing_id())
    # Where all files agree, only that column is read.
    places = [r[0] for r in heads.select(F.coalesce("column", F.lit(1))).distinct().collect()]
    if len(places) == 1:
        named = rows.withColumn("domain", F.col(columns[places[0] - 1]))
    else:
        at = heads.select("_file", F.coalesce("column", F.lit(1)).alias("_place"))
        named = rows.join(at, "_file").withColumn("domain", F.element_at(F.array(*columns), F.col("_place")))
    # A first line that names nothing known is a row, if there is a domain in it.
    firsts = heads.where(F.col("column").isNull() & F.get("cells", F.lit(0)).contains(".")).select(
        F.get("cells", F.lit(0)).alias("domain"), "_file", F.lit(0).cast("long").alias("_block"), F.lit(-1).cast("long").alias("_at"))
    return named.select("domain", "_file", "_block", "_at").unionByName(firsts)


def read_account_file(spark: SparkSession, path: str, limit: int = 0, *, multiline: bool = False) -> DataFrame:
    """``domain, source, ord`` from CSV files or plain lists: a file, or all files of a folder.

    A CSV's domain column is the first known name in its own header; without one it is
    the first column, whose first row counts when it has a dot in it. Quotes inside quoted
    fields are doubled. ``multiline`` reads quoted line breaks too, at the price of one task per file. In any other
    file every line is a domain, but for blank lines and ``#`` comments. A folder's files count in order of
    their names; ``limit`` keeps the first rows.
    """
    if path.lower().endswith(".csv"):
        found = _csv_domains(spark, path, multiline)
    else:
        lines = spark.read.text(path).select(
            F.col("value").alias("domain"), F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"))
        found = lines.where(~F.col("domain").startswith("#"))
    found = _in_file_order(found.withColumn("domain", strip("domain")).where("domain <> ''"))
    found = found.select("domain", F.lit("file").alias("source"), "ord")
    return found.orderBy("ord").limit(limit) if limit else found


def read_accounts(
    df: DataFrame,
    spec: FilterSpec,
    *,
    domain_col: str | Column = "domain",
    record_id: str | Column | None = None,
    properties: Sequence[str] = (),
    source: str = TABLE,
    system: str = TABLE,
    now: datetime | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Accounts that match the filter and have a domain, with the properties asked for.

    The limit (the filter's own unless given; 0 for none) counts accounts with a domain.
    """
    domain = F.col(domain_col) if isinstance(domain_col, str) else domain_col
    rid = F.lit(None).cast("string") if record_id is None else record_id
    rid = F.col(rid) if isinstance(rid, str) else rid
    matched = df.where(predicate(spec, system=system, now=now, schema=df.schema)).where(
        domain.isNotNull() & (F.trim(domain) != "")
    )
    chosen = matched.select(
        rid.cast("string").alias("record_id"), domain.alias("domain"),
        F.lit(source).alias("source"), *properties,
    )
    n = spec.limit if limit is None else limit
    return chosen.limit(n) if n else chosen


def first_targets(accounts: DataFrame, n: int = 0, order: str = "ord") -> DataFrame:
    """The first ``n`` accounts of the list; 0 for all."""
    return accounts.orderBy(order).limit(n) if n else accounts
