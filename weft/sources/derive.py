"""Graphs derived from the relational tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.operators.model import Graph
from weft.plans.ordinal import with_next
from weft.plans.tables import dealt, table, tasks


def _undirected(a: str, b: str) -> list:
    return [F.least(a, b).alias("src"), F.greatest(a, b).alias("dst")]


def hand_off(spark: SparkSession, sf_dir: str) -> Graph:
    """CC: customers of consecutive orders."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("a"))
    rows = orders.count()
    pairs = with_next(orders, "k", "a", "b", tasks(spark, rows)).where("b is not null and a <> b").select(*_undirected("a", "b"))
    return Graph.undirected(dealt(pairs, rows, "src", "dst").distinct(), rows, pairs)


def supplier_part(spark: SparkSession, sf_dir: str) -> Graph:
    """SP: bipartite, even suppliers and odd parts."""
    items = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") * 2).alias("src"), (F.col("l_partkey") * 2 + 1).alias("dst"))
    rows = items.count()
    return Graph.undirected(dealt(items, rows, "src", "dst").distinct(), rows, items)


def co_purchase(spark: SparkSession, sf_dir: str) -> Graph:
    """PP: parts of the same order."""
    read = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    lines = dealt(read, read.count(), "l_orderkey")
    n = F.col("n")
    rows = lines.groupBy("l_orderkey").agg(F.count("*").alias("n")).agg(F.sum(F.floor(n * (n - 1) / 2))).first()[0] or 0
    items = lines.distinct()
    two = items.select("l_orderkey", F.col("l_partkey").alias("dst"))
    pairs = items.join(two, "l_orderkey").where("l_partkey < dst").select(F.col("l_partkey").alias("src"), "dst")
    return Graph.undirected(dealt(pairs, rows, "src", "dst").distinct(), rows)


def user_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UT: directed, weighted steps between users of consecutive events."""
    events = table(spark, sf_dir, "events").select(F.col("event_id").alias("k"), F.col("user_id").alias("a"))
    pairs = with_next(events, "k", "a", "b", tasks(spark, events.count())).where("b is not null and a <> b")
    return pairs.groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.min(1 + F.col("k") % 10).cast("double").alias("weight"))


def probe_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log lines with time, memory and other probes, made from ``events``."""
    e = table(spark, sf_dir, "events")
    node = F.when(F.col("event_id") % 7 == 0, F.lit("")).otherwise(F.concat((F.col("user_id") % 4).cast("string"), F.lit(": ")))
    kind = F.element_at(F.array(F.lit("TL"), F.lit("TG"), F.lit("MF"), F.lit("XX")), (F.col("event_id") % 4 + 1).cast("int"))
    value = F.when(kind == "MF", F.concat((F.col("event_id") + 1).cast("string"), F.lit("/"), (F.col("event_id") * 3 + 7).cast("string"))).otherwise((F.col("event_id") * 1000003).cast("string"))
    return e.select("event_id", F.concat(node, F.lit("run [P:"), kind, F.lit(":"), F.col("event_type"), F.lit(":"), value, F.lit("] done")).alias("value"))
