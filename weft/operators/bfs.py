"""Breadth-first search: levels, trees, reachability, visit order.

A round takes one level: its vertices meet the edges, and what no level has
yet is the next one. Levels are kept as tables of their own and never written
again. A level of few vertices is broadcast, so that the edges, hubs included,
stay where they are; a larger one is a shuffled join.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.operators.model import Graph, dedup
from weft.plans.lineage import counted, cut, temporary
from weft.plans.ordinal import counted_ordinal
from weft.plans.superstep import is_small, one_task, sized, small

SCHEMA = "id bigint, pred bigint, dist int"
#: Levels whose ids are merged into one table.
MERGED_LEVELS = 16


def first_vertex(graph: Graph) -> int:
    return graph.vertices.agg(F.min("id")).first()[0]


def _edges(graph: Graph) -> tuple[DataFrame, int]:
    edges, seen = counted(dedup(graph.edges))
    return edges, seen["rows"]


def _local(root: int):
    def run(edges: pd.DataFrame) -> pd.DataFrame:
        e = edges.sort_values(["src", "dst"])
        ids = np.unique(np.concatenate([e.src.to_numpy(np.int64), e.dst.to_numpy(np.int64), [root]]))
        src, dst = np.searchsorted(ids, e.src.to_numpy(np.int64)), np.searchsorted(ids, e.dst.to_numpy(np.int64))
        first = np.searchsorted(src, np.arange(len(ids) + 1))
        dist, pred = np.full(len(ids), -1, np.int32), np.full(len(ids), -1, np.int64)
        front = np.searchsorted(ids, [root])
        dist[front], pred[front] = 0, front
        level = 0
        while len(front):
            level += 1
            size = first[front + 1] - first[front]
            at = np.repeat(first[front] - np.cumsum(size) + size, size) + np.arange(size.sum())
            to, origin = dst[at], np.repeat(front, size)
            new = dist[to] < 0
            to, origin = to[new], origin[new]
            order = np.lexsort((origin, to))
            front, where = np.unique(to[order], return_index=True)
            dist[front], pred[front] = level, origin[order][where]
        seen = dist >= 0
        return pd.DataFrame({"id": ids[seen], "pred": ids[pred[seen]], "dist": dist[seen]})

    return run


class _Levels:
    """The vertices of all levels so far, as appended tables."""

    def __init__(self, start: DataFrame):
        self.tables, self.sizes = [start], [1]
        self.seen, self.n_seen = [start.select("id")], 1

    def front(self) -> DataFrame:
        return small(self.tables[-1], self.sizes[-1])

    def add(self, level: DataFrame) -> bool:
        level, seen = counted(level)
        n = seen["rows"]
        if n:
            self.tables.append(level)
            self.sizes.append(n)
            self.seen.append(level.select("id"))
            self.n_seen += n
            if len(self.seen) == MERGED_LEVELS:
                self.seen = [cut(_union(self.seen))]
        return bool(n)

    def known(self, levels: int | None = None) -> DataFrame:
        """Ids of the last levels, or of all."""
        if levels is None:
            return small(_union(self.seen), self.n_seen)
        return small(_union([t.select("id") for t in self.tables[-levels:]]), sum(self.sizes[-levels:]))


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def reach(graph: Graph, root: int, symmetric: bool = False, local_edges: int | None = None) -> DataFrame:
    """``id, pred, dist`` of the vertices reached along directed edges.

    ``pred`` is the smallest id among the predecessors one level before; the
    root is its own. ``symmetric`` graphs compare only the last two levels.
    """
    with temporary(graph.edges.sparkSession) as keep:
        edges, n_edges = _edges(graph)
        if is_small(n_edges, local_edges):
            return keep(one_task(edges, _local(root), SCHEMA), "bfs")
        levels = _Levels(edges.sparkSession.createDataFrame([(root, root, 0)], SCHEMA))
        more = True
        with sized(edges.sparkSession, n_edges):
            while more:
                # The level is a column and no literal, so that all rounds are one compiled plan.
                front = levels.front().select(F.col("id").alias("src"), (F.col("dist") + 1).alias("dist"))
                met = edges.join(front, "src").groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("pred"), F.min("dist").alias("dist"))
                more = levels.add(met.join(levels.known(2 if symmetric else None), "id", "left_anti").select("id", "pred", "dist"))
        return keep(_union(levels.tables), "bfs")


def tree(graph: Graph, root: int | None = None, **how) -> DataFrame:
    """``reach`` for all vertices, nulls where the root does not lead."""
    root = first_vertex(graph) if root is None else root
    return graph.vertices.join(reach(graph, root, **how), "id", "left")


def visited(graph: Graph, root: int | None = None, **how) -> DataFrame:
    root = first_vertex(graph) if root is None else root
    return graph.vertices.join(reach(graph, root, **how).select("id", F.lit(True).alias("v")), "id", "left").select("id", F.coalesce("v", F.lit(False)).alias("visited"))


def visit_edges(graph: Graph, root: int | None = None) -> DataFrame:
    """``pos, parent, child``: tree edges in queue order, neighbours ascending.

    A vertex is found by the earliest vertex of the level before; a level
    follows the order of those, then of its own ids.
    """
    root = first_vertex(graph) if root is None else root
    with temporary(graph.edges.sparkSession) as keep:
        edges, n_edges = _edges(graph)
        levels = _Levels(edges.sparkSession.createDataFrame([(root, None, -1)], "id bigint, parent bigint, pos bigint"))
        more, found = True, 0
        with sized(edges.sparkSession, n_edges):
            while more:
                front = levels.front().select(F.col("id").alias("src"), "pos")
                met = edges.join(front, "src").groupBy(F.col("dst").alias("id")).agg(F.min(F.struct("pos", "src")).alias("by"))
                new = met.join(levels.known(), "id", "left_anti").select("id", F.col("by.src").alias("parent"), F.col("by.pos").alias("before"))
                placed, n = counted_ordinal(new, "before", "id", name="place")
                more = levels.add(placed.select("id", "parent", (F.lit(found) + F.col("place")).alias("pos")))
                found += n
        return keep(_union(levels.tables).where("pos >= 0").select("pos", "parent", F.col("id").alias("child")), "bfs-order")
