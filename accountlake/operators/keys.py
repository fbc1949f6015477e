"""One row per key, and lookups that survive hot keys."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from accountlake.spark import stored

ROWS_PER_TASK = 2_000_000


def one_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str], *, last: bool = False) -> DataFrame:
    """The row with the smallest (or largest) order columns of every key.

    An aggregate rather than a window: every task first reduces its own rows to one
    per key, so a key that holds a third of the table never meets in one task.
    """
    rest = [c for c in df.columns if c not in keys]
    pick = F.max_by if last else F.min_by
    ordering = F.struct(*order)
    row = pick(F.struct(*rest), ordering).alias("_row")
    return df.groupBy(*keys).agg(row).select(*keys, "_row.*").select(*df.columns)


def row_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str], *, last: bool = False) -> DataFrame:
    """As :func:`one_per_key`, for rows with wide columns: no aggregate holds them. Rows with a null key are left out.

    The winner is picked on keys, order columns and a hash of the row, then joined to its row by all of them, so rows of
    a hot key are spread and only winners go on. Rows that are equal in everything are one.
    """
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    plain = [name for name, kind in kinds.items() if "map<" not in kind and "variant" not in kind]
    place = F.struct(*[F.col(c) for c in order], F.xxhash64(*plain).alias("_hash"))
    pick = F.max if last else F.min
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    rows = df.where(known).withColumn("_place", place)
    winners = rows.select(*keys, "_place").groupBy(*keys).agg(pick("_place").alias("_place"))
    first = F.row_number().over(Window.partitionBy(*keys, "_place").orderBy(F.lit(0))) == 1
    return rows.join(winners, [*keys, "_place"]).withColumn("_first", first).where("_first").select(*df.columns)


def lookup_join(
    rows: DataFrame,
    lookup: DataFrame,
    on: Sequence[str],
    *,
    how: str = "left",
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Equi-join of many rows to few rows per key, hot keys spread over several tasks.

    Keys with at least ``rows_per_task`` rows are counted first, by a job on the key columns
    alone; there are at most ``count(rows) / rows_per_task`` of them, and they are written to the shared folder. Without any, this is a
    plain join. Else a hot key's rows get a salt from a hash of the whole row and its lookup rows
    are repeated once per salt; other keys join as they are. Null keys match nothing
    and are spread over as many salts as they have rows for. ``rows_per_task`` sets the layout, never the result.
    """
    on = list(on)
    counts = rows.select(*on).groupBy(*on).count().where(F.col("count") >= rows_per_task)
    hot = counts.select(*[F.col(k).alias(f"_{k}") for k in on], F.ceil(F.col("count") / rows_per_task).cast("int").alias("_salts"))
    hot = stored(hot, "hot-keys")
    if hot.isEmpty():
        return rows.join(lookup.dropna(subset=on), on, how)

    def same(side: DataFrame) -> Column:
        return reduce(lambda a, b: a & b, [side[k].eqNullSafe(hot[f"_{k}"]) for k in on])

    hot_keys = [f"_{k}" for k in on]
    kinds = {c.name: c.dataType.simpleString() for c in rows.schema}
    plain = [name for name, kind in kinds.items() if "map<" not in kind and "variant" not in kind]
    salt = F.when(F.col("_salts").isNotNull(), F.pmod(F.xxhash64(*plain), F.col("_salts"))).otherwise(0).cast("int")
    salted = rows.join(hot, same(rows), "left").withColumn("_salt", salt).drop("_salts", *hot_keys)
    copies = F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1)
    repeated = lookup.dropna(subset=on)
    repeated = repeated.join(hot, same(repeated), "left").withColumn("_salt", F.explode(copies)).drop("_salts", *hot_keys)
    return salted.join(repeated, [*on, "_salt"], how).drop("_salt")
