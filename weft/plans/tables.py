"""Scans of the driver's tables; any store that Spark's readers can open."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Rows of a task of a shuffle by key, at most about, and rows for which a further task is worth its cost.
SHUFFLE_ROWS, LEAST_ROWS = 1_000_000, 50_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` under ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def tasks(spark: SparkSession, rows: int) -> int:
    """Tasks of a shuffle over so many rows: they grow with the rows, whatever
    the session's number is, so that a task's memory does not."""
    return max(1, -(-rows // SHUFFLE_ROWS), min(spark.sparkContext.defaultParallelism, -(-rows // LEAST_ROWS)))


def dealt(df: DataFrame, rows: int, *by: str) -> DataFrame:
    """``df`` of ``rows`` rows, or at most so many, dealt out by key."""
    return df.repartition(tasks(df.sparkSession, rows), *by)
