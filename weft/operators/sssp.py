"""Single-source shortest paths: four algorithms with one answer.

A round relaxes the edges of some open vertices, those that got nearer since
their edges were relaxed last; the algorithms differ in which of them a round
takes and what they refuse. Few taken vertices are broadcast to the edges.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable
from functools import wraps

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.operators.model import Graph
from weft.plans.lineage import counted, cut, temporary
from weft.plans.superstep import is_small, one_task, sized, small

SCHEMA = "id bigint, dist double"
DELTA = 1.0


class NegativeCycle(ValueError):
    """A cycle of negative weight can be reached from the source."""


class NegativeWeight(ValueError):
    """The algorithm takes no negative weights."""


def _kept(run: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """``run`` with its result stored and the tables of its rounds deleted."""

    @wraps(run)
    def whole(graph: Graph, *args, **more) -> DataFrame:
        with temporary(graph.edges.sparkSession) as keep:
            return keep(run(graph, *args, **more), "paths")

    return whole


def _lightest(graph: Graph, whole: bool, negative: bool = False) -> tuple[DataFrame, int]:
    """The lightest of parallel edges, and how many; refuses negative weights."""
    w = F.col("weight").cast("bigint").cast("double") if whole else F.col("weight").cast("double")
    edges, seen = counted(graph.edges.groupBy("src", "dst").agg(F.min(w).alias("weight")), least=F.min("weight"))
    if not negative and seen["least"] is not None and seen["least"] < 0:
        raise NegativeWeight(f"weight {seen['least']}")
    return edges, seen["rows"]


def _local(source: int):
    def run(edges: pd.DataFrame) -> pd.DataFrame:
        near: dict[int, list] = {}
        for s, d, w in zip(edges.src.tolist(), edges.dst.tolist(), edges.weight.tolist(), strict=True):
            near.setdefault(s, []).append((d, w))
        best, heap = {source: 0.0}, [(0.0, source)]
        while heap:
            far, v = heapq.heappop(heap)
            if far == best[v]:
                for d, w in near.get(v, ()):
                    if d not in best or far + w < best[d]:
                        best[d] = far + w
                        heapq.heappush(heap, (far + w, d))
        return pd.DataFrame({"id": list(best), "dist": list(best.values())}).astype({"id": "int64", "dist": "float64"})

    return run


STATE = "id bigint, dist double, pred bigint, open boolean, due boolean"


def _start(edges: DataFrame, source: int) -> DataFrame:
    """``open``: light edges are to be relaxed; ``due``: heavy ones are."""
    return edges.sparkSession.createDataFrame([(source, 0.0, None, True, False)], STATE)


def _relaxed(state: DataFrame, edges: DataFrame, taken: Column, count: int, owes: bool = False) -> DataFrame:
    """The state after some edges of the ``taken`` vertices (``count`` of them):
    one that got nearer is open, the others of the taken are closed, and due
    where they still owe their heavy edges."""
    front = small(state.where(taken).select(F.col("id").alias("src"), F.col("dist").alias("so_far")), count)
    offer = F.min(F.struct((F.col("so_far") + F.col("weight")).alias("new"), F.col("src").alias("by")))
    got = edges.join(front, "src").groupBy(F.col("dst").alias("to")).agg(offer.alias("o"))
    met = state.join(got, state["id"] == got["to"], "full")
    nearer = F.coalesce(F.col("dist").isNull() | (F.col("o.new") < F.col("dist")), F.lit(False))
    was = F.coalesce(taken, F.lit(False))
    return met.select(
        F.coalesce("id", "to").alias("id"),
        F.when(nearer, F.col("o.new")).otherwise(F.col("dist")).alias("dist"),
        F.when(nearer, F.col("o.by")).otherwise(F.col("pred")).alias("pred"),
        (nearer | (F.coalesce("open", F.lit(False)) & ~was)).alias("open"),
        (F.coalesce("due", F.lit(False)) & ~was | was & F.lit(owes)).alias("due"),
    )


def _in_cycle(state: DataFrame, source: int) -> bool:
    """Whether the predecessors hold a cycle: pointers are doubled until all
    lead to the source, or more often than a path could be long."""
    far = F.count_if(F.col("up") != source)
    at, seen = counted(state.select("id", F.coalesce("pred", F.lit(source)).alias("up")), far=far)
    reach = 1
    while seen["far"] and reach <= seen["rows"]:
        other = at.select(F.col("id").alias("up"), F.col("up").alias("next"))
        at, seen = counted(at.join(other, "up").select("id", F.col("next").alias("up")), far=far)
        reach *= 2
    return seen["far"] > 0


def _open() -> dict[str, Column]:
    """What a round must know: open vertices, and the least distance of them."""
    return {"open": F.count_if("open"), "least": F.min(F.when(F.col("open"), F.col("dist")))}


def _frontier_rounds(edges: DataFrame, n_edges: int, source: int, most: int | None = None) -> DataFrame:
    """All open vertices each round. With ``most`` rounds for a path, a cycle
    of negative weight is looked for after 2, 4, 8, 16, ... of them."""
    state, n, done, look = _start(edges, source), 1, 0, 2
    with sized(edges.sparkSession, n_edges):
        while n:
            if most is not None and (done > most or done >= look):
                look *= 2
                below = not state.where((F.col("id") == source) & (F.col("dist") < 0)).isEmpty()
                if done > most or below or _in_cycle(state, source):
                    raise NegativeCycle(f"still nearer after {done} rounds")
            state, seen = counted(_relaxed(state, edges, F.col("open"), n), **_open())
            n, done = seen["open"], done + 1
    return state.select("id", "dist")


@_kept
def dijkstra(graph: Graph, source: int, local_edges: int | None = None) -> DataFrame:
    """``id, dist`` of the reached vertices; weights of zero or more."""
    edges, n = _lightest(graph, False)
    return one_task(edges, _local(source), SCHEMA) if is_small(n, local_edges) else _frontier_rounds(edges, n, source)


def _passes(source: int):
    """Full passes over all edges; null distances of every vertex that is
    reached tell that the last allowed pass still came nearer."""

    def run(edges: pd.DataFrame) -> pd.DataFrame:
        ids = np.unique(np.concatenate([edges.src.to_numpy(np.int64), edges.dst.to_numpy(np.int64), [source]]))
        src, dst = np.searchsorted(ids, edges.src.to_numpy(np.int64)), np.searchsorted(ids, edges.dst.to_numpy(np.int64))
        weight = edges.weight.to_numpy(np.float64)
        dist = np.full(len(ids), np.inf)
        dist[np.searchsorted(ids, source)] = 0.0
        for _ in range(len(ids)):
            new = dist.copy()
            np.minimum.at(new, dst, dist[src] + weight)
            if (new == dist).all():
                break
            dist = new
        else:
            return pd.DataFrame({"id": ids, "dist": pd.array([None] * len(ids), "Float64")})
        seen = np.isfinite(dist)
        return pd.DataFrame({"id": ids[seen], "dist": dist[seen]})

    return run


@_kept
def bellman_ford(graph: Graph, source: int, local_edges: int | None = None) -> DataFrame:
    """As ``dijkstra`` for any weights; raises on a reachable negative cycle."""
    edges, n = _lightest(graph, False, negative=True)
    if not is_small(n, local_edges):
        return _frontier_rounds(edges, n, source, max(1, graph.vertices.count() - 1))
    found = cut(one_task(edges, _passes(source), SCHEMA))
    if not found.where("dist is null").isEmpty():
        raise NegativeCycle("still nearer after as many passes as vertices")
    return found


def has_negative_cycle(graph: Graph, source: int, local_edges: int | None = None) -> bool:
    try:
        bellman_ford(graph, source, local_edges)
    except NegativeCycle:
        return True
    return False


@_kept
def dial(graph: Graph, source: int, local_edges: int | None = None) -> DataFrame:
    """Whole weights; a round takes the open vertices of the least distance."""
    edges, n_edges = _lightest(graph, True)
    if is_small(n_edges, local_edges):
        return one_task(edges, _local(source), SCHEMA)
    state, seen = _start(edges, source), {"open": 1, "least": 0.0}
    with sized(edges.sparkSession, n_edges):
        while seen["open"]:
            taken = F.col("open") & (F.col("dist") == seen["least"])
            state, seen = counted(_relaxed(state, edges, taken, seen["open"]), **_open())
    return state.select("id", "dist")


@_kept
def delta_stepping(graph: Graph, source: int, delta: float = DELTA, local_edges: int | None = None) -> DataFrame:
    """Light edges to a fixpoint inside the least bucket, then heavy ones once."""
    edges, n_edges = _lightest(graph, False)
    if is_small(n_edges, local_edges):
        return one_task(edges, _local(source), SCHEMA)
    light, heavy = cut(edges.where(F.col("weight") < delta)), cut(edges.where(F.col("weight") >= delta))
    bucket = F.floor(F.col("dist") / delta)
    least = lambda which: F.min(F.when(which, bucket))
    marks = {"open": least(F.col("open")), "due": least(F.col("due")), "n": F.count_if(F.col("open") | F.col("due"))}
    state, seen = _start(edges, source), {"open": 0, "due": None, "n": 1}
    with sized(edges.sparkSession, n_edges):
        while seen["n"]:
            if seen["open"] is not None and (seen["due"] is None or seen["open"] <= seen["due"]):
                step = _relaxed(state, light, F.col("open") & (bucket == seen["open"]), seen["n"], owes=True)
            else:
                # Whatever the bucket held at any time is due, and settled now.
                step = _relaxed(state, heavy, F.col("due") & (bucket == seen["due"]), seen["n"])
            state, seen = counted(step, **marks)
    return state.select("id", "dist")
