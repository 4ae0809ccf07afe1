"""Minimum spanning trees under the total order (weight, src, dst)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.operators.components import components
from weft.operators.model import Graph
from weft.plans.lineage import counted, cut, temporary
from weft.plans.superstep import is_small, one_task, sized

SCHEMA = "src bigint, dst bigint, weight double"


class NotConnected(ValueError):
    """There is no spanning tree."""


def _kruskal(edges: pd.DataFrame) -> pd.DataFrame:
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    kept = []
    for s, d, w in edges.sort_values(["weight", "src", "dst"])[["src", "dst", "weight"]].itertuples(index=False):
        a, b = find(s), find(d)
        if a != b:
            parent[a] = b
            kept.append((s, d, w))
    return pd.DataFrame(kept, columns=["src", "dst", "weight"]).astype({"src": "int64", "dst": "int64", "weight": "float64"})


def forest(graph: Graph, local_edges: int | None = None) -> DataFrame:
    """Minimum spanning forest, edges with ``src < dst``."""
    half = graph.edges.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), F.col("weight").cast("double").alias("weight"))
    with temporary(graph.edges.sparkSession) as keep:
        edges, seen = counted(half.groupBy("src", "dst").agg(F.min("weight").alias("weight")))
        if is_small(seen["rows"], local_edges):
            return keep(one_task(edges, _kruskal, SCHEMA), "forest")
        # Boruvka: every component takes its least outgoing edge; ids are labels.
        open_edges, kept = edges.select("src", "dst", "weight", F.col("src").alias("a"), F.col("dst").alias("b")), None
        while seen["rows"]:
            with sized(edges.sparkSession, seen["rows"]):
                order = F.struct("weight", "src", "dst", "a", "b")
                each = open_edges.select("a", order.alias("o")).union(open_edges.select("b", order.alias("o"))).toDF("c", "o")
                least = cut(each.groupBy("c").agg(F.min("o").alias("o")).select("o.*").distinct())
                chosen = least.select("src", "dst", "weight")
                kept = chosen if kept is None else kept.union(chosen)
                joined = components(least.select(F.col("a").alias("src"), F.col("b").alias("dst")))
                of = lambda c: joined.select(F.col("id").alias(c), F.col("component").alias(f"{c}2"))  # noqa: B023, E731
                renamed = open_edges.join(of("a"), "a").join(of("b"), "b")
                open_edges, seen = counted(renamed.where("a2 <> b2").select("src", "dst", "weight", F.col("a2").alias("a"), F.col("b2").alias("b")))
        return keep(kept if kept is not None else edges, "forest")


def spanning_tree(graph: Graph, local_edges: int | None = None) -> DataFrame:
    """The tree's edges; raises where the graph has none or one vertex only."""
    found = cut(forest(graph, local_edges))
    vertices, edges = graph.vertices.count(), found.count()
    if vertices < 2 or edges != vertices - 1:
        raise NotConnected(f"{edges} tree edges for {vertices} vertices")
    return found


def cost(edges: DataFrame) -> DataFrame:
    return edges.agg(F.coalesce(F.sum("weight"), F.lit(0.0)).alias("cost"))
