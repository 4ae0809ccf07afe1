"""Validators: each returns one row ``valid boolean``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.operators.model import Graph, dedup
from weft.operators.placement import mapped_back, placed_edges


def _all(df: DataFrame, condition) -> DataFrame:
    return df.agg(F.coalesce(F.every(condition), F.lit(True)).alias("valid"))


def bfs(result: DataFrame, root: int) -> DataFrame:
    """Distances of zero or more; each one more than the predecessor's; only
    the root is its own predecessor. Unreached vertices (nulls) are left out."""
    own = result.where("dist is not null")
    before = own.select(F.col("id").alias("pred"), F.col("dist").alias("before"))
    met = own.join(before, "pred", "left")
    ok = (F.col("dist") >= 0) & F.when(F.col("pred") == F.col("id"), F.col("id") == root).otherwise(F.coalesce(F.col("before") == F.col("dist") - 1, F.lit(False)))
    return _all(met, ok)


def bfs_strict(graph: Graph, result: DataFrame, root: int) -> DataFrame:
    """As ``bfs``; tree edges exist, and no edge skips a level or leaves the
    reached part."""
    own = result.where("dist is not null")
    tree = own.where("pred <> id").select(F.col("pred").alias("src"), F.col("id").alias("dst"))
    missing = tree.join(dedup(graph.edges), ["src", "dst"], "left_anti")
    at = lambda c: result.select(F.col("id").alias(c), F.col("dist").alias(f"{c}_d"))
    far = dedup(graph.edges).join(at("src"), "src").join(at("dst"), "dst").where("src_d is not null and (dst_d is null or dst_d > src_d + 1)")
    bad = missing.select("src").union(far.select("src")).agg(F.count("*").alias("n"))
    return bfs(result, root).join(F.broadcast(bad)).select((F.col("valid") & (F.col("n") == 0)).alias("valid"))


def colouring(graph: Graph, result: DataFrame) -> DataFrame:
    """Every vertex has a colour and no edge joins equal ones."""
    at = lambda c: result.select(F.col("id").alias(c), F.col("colour").alias(f"{c}_c"))
    each = graph.edges.where("src <> dst") if graph.half is None else graph.half
    met = each.join(at("src"), "src", "left").join(at("dst"), "dst", "left")
    return _all(met, F.coalesce(F.col("src_c") != F.col("dst_c"), F.lit(False)))


def partitioning(graph: Graph, placement: DataFrame) -> DataFrame:
    """Edges placed by global ids and mapped back are the graph's edges."""
    back = mapped_back(placed_edges(graph, placement), placement).withColumn("side", F.lit(1))
    both = dedup(graph.edges).withColumn("side", F.lit(2)).unionByName(back)
    return _all(both.groupBy("src", "dst").agg(F.countDistinct("side").alias("n")), F.col("n") == 2)


def spanning_tree(graph: Graph, tree: DataFrame, cost: float) -> DataFrame:
    """Same vertices, the given cost, and only edges of the graph."""
    seen = tree.select(F.col("src").alias("id")).union(tree.select("dst")).distinct()
    vertices = graph.vertices.withColumn("a", F.lit(1)).join(seen.withColumn("b", F.lit(1)), "id", "full")
    lost = vertices.agg(F.count_if(F.col("a").isNull() | F.col("b").isNull()).alias("lost"))
    own = graph.edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    strange = tree.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).join(own, ["src", "dst"], "left_anti").agg(F.count("*").alias("strange"))
    total = tree.agg(F.coalesce(F.sum("weight"), F.lit(0.0)).alias("total"))
    return lost.join(strange).join(total).select(((F.col("lost") == 0) & (F.col("strange") == 0) & (F.abs(F.col("total") - cost) < 1e-6)).alias("valid"))
