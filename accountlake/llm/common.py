"""What the operators of this subpackage share."""

from __future__ import annotations

import pickle
import sys
import uuid
from collections.abc import Callable
from typing import Any

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Executors get the functions of this subpackage as code; they need not have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__package__])

# Words end at these six ASCII characters only.
WORD = r"[^\x20\x09-\x0D]+"

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Bounds what a Python worker holds at a time: whole texts travel in these batches.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
}


def prepare(spark: SparkSession) -> SparkSession:
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def folder(spark: SparkSession, purpose: str) -> str:
    """A new folder that the driver and all executors reach.

    It lies under ``spark.checkpoint.dir``; a session without one (tests) uses its warehouse.
    """
    root = (
        spark.conf.get("spark.checkpoint.dir", None)
        or spark.sparkContext.getCheckpointDir()
        or spark.conf.get("spark.sql.warehouse.dir")
    )
    return f"{root.rstrip('/')}/llm/{purpose}-{uuid.uuid4().hex}"


def saved(df: DataFrame, purpose: str) -> DataFrame:
    """Write a table to the shared folder and read it again: cuts lineage, survives lost executors."""
    path = folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def pick(df: DataFrame, *names: str) -> DataFrame:
    """These columns by their exact names, whatever else the table has (``Text`` beside ``text``)."""
    at = [df.columns.index(n) for n in names]
    plain = df.toDF(*[f"_{i}" for i in range(len(df.columns))])
    return plain.select(*[F.col(f"_{i}").alias(n) for i, n in zip(at, names, strict=True)])


def packed(df: DataFrame, *names: str) -> DataFrame:
    """``names`` beside ``row``, a struct of all columns under positional names."""
    at = [df.columns.index(n) for n in names]
    plain = df.toDF(*[f"_{i}" for i in range(len(df.columns))])
    return plain.select(
        *[F.col(f"_{i}").alias(n) for i, n in zip(at, names, strict=True)], F.struct("*").alias("row")
    )


def unpacked(df: DataFrame, columns: list[str]) -> DataFrame:
    """The inverse of :func:`packed`: the columns of ``row`` under their own names again."""
    return df.select("row.*").toDF(*columns)


def shipped(spark: SparkSession, value: Any) -> Callable[[], Any]:
    """A value of bounded size for the tasks, its classes with it; call the result to get it."""
    sent = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    return lambda: pickle.loads(sent.value)


def fold(key: Column, n: int) -> Column:
    """``crc32`` of the key as text, modulo ``n``; a null key counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % n


def ranked(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Rows numbered from 0 in a total order, without a single-task window.

    Rows are dealt out by range, numbered inside their range, and moved up by what the ranges
    before hold. Rows that tie in ``order`` are numbered in any order.
    """
    from pyspark.sql import Window

    dealt = saved(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("_p").orderBy(*order)) - 1
    return (
        dealt.withColumn("_i", inside)
        .join(starts, "_p")
        .withColumn(name, (F.col("_start") + F.col("_i")).cast("long"))
        .drop("_p", "_i", "_start")
    )
