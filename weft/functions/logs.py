"""Probe-log lines to measurements, as Column expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The headings of the probe types, and the pattern of a probe.
HEADINGS = {"tl": "Local times", "tg": "Global times", "mf": "Memory utilization"}
OTHER = "Miscellanous"
PROBE = r"\[P:(.+?):(.+?):(.+?)\]"


def split_by_node(lines: DataFrame) -> DataFrame:
    """``lines`` with ``node``: the number before the first colon, else ``_``."""
    return lines.withColumn("node", F.when(F.col("value").rlike("^[0-9]+:"), F.regexp_extract("value", "^([0-9]+):", 1)).otherwise("_"))


def probes(lines: DataFrame) -> DataFrame:
    """``node, heading, name, value, number, measurement`` of every probe.

    ``number`` is seconds for times and the inverse share for memory.
    """
    found = split_by_node(lines).withColumn("p", F.explode(F.regexp_extract_all("value", F.lit(PROBE), 0)))
    part = lambda i: F.regexp_extract("p", PROBE, i)
    rows = found.select("node", F.lower(part(1)).alias("type"), part(2).alias("name"), part(3).alias("v"))
    heading = F.coalesce(F.create_map(*[F.lit(x) for pair in HEADINGS.items() for x in pair])[F.col("type")], F.lit(OTHER))
    halves = F.split("v", "/")
    number = F.when(F.col("type").isin("tl", "tg"), F.try_to_number("v", F.lit("9" * 18)).cast("double") / 1e9).when(F.col("type") == "mf", halves[1].try_cast("double") / halves[0].try_cast("double"))
    rows = rows.select("node", heading.alias("heading"), "type", "name", F.col("v").alias("value"), number.alias("number"))
    text = (
        F.when(F.col("type") == "tl", F.format_string("[%s] %s: %sns (%.2fs)", "node", "name", "value", "number"))
        .when(F.col("type") == "tg", F.format_string("%s: %s (%.2fs)", "name", "value", "number"))
        .when(F.col("type") == "mf", F.format_string("[%s] %s: %s (1/%.2f)", "node", "name", "value", "number"))
        .otherwise(F.format_string("[%s] %s: %s", "node", "name", "value"))
    )
    return rows.withColumn("measurement", text).drop("type")


def report(lines: DataFrame) -> DataFrame:
    """``heading, node, n_probes, total_ns``; the time is null where a heading
    has none."""
    rows = probes(lines)
    times = F.when(F.col("heading").isin(HEADINGS["tl"], HEADINGS["tg"]), F.try_to_number("value", F.lit("9" * 18)).cast("double"))
    return rows.groupBy("heading", "node").agg(F.count("*").alias("n_probes"), F.sum(times).alias("total_ns"))


def report_lines(lines: DataFrame) -> DataFrame:
    """``heading, node, line``: every measurement, to be written by heading."""
    return probes(lines).select("heading", "node", F.col("measurement").alias("line"))


def write_split(lines: DataFrame, path: str, with_probes: bool = False) -> None:
    """One folder of text files for each node, and if asked a folder
    ``node=probes`` of the measurements, each heading in a folder of its own."""
    split_by_node(lines).select("node", "value").write.partitionBy("node").text(path)
    if with_probes:
        report_lines(lines).select("heading", F.col("line").alias("value")).write.partitionBy("heading").text(f"{path}/node=probes")
