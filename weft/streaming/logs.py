"""Probe logs as a stream: the same expressions over new files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from weft.functions.logs import probes
from weft.sources.textgraph import LINES


def read_probes(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """Measurements of every line of the files that appear in ``path``."""
    return probes(spark.readStream.schema(LINES).option("maxFilesPerTrigger", files_per_trigger).text(path))


def follow(spark: SparkSession, path: str, out: str, checkpoint: str) -> StreamingQuery:
    """Append measurements as Parquet, once each, until stopped."""
    return read_probes(spark, path).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").start()
