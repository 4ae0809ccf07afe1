"""Strongly connected components of a directed graph."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.operators.model import Graph, dedup, reverse
from weft.plans.lineage import counted, cut, temporary
from weft.plans.superstep import is_small, one_task, sized, small

SCHEMA = "id bigint, scc bigint"


def _local(edges: pd.DataFrame) -> pd.DataFrame:
    """Two depth-first passes; labels are the smallest ids."""
    ahead: dict[int, list[int]] = {}
    back: dict[int, list[int]] = {}
    for s, d in zip(edges.src.tolist(), edges.dst.tolist(), strict=True):
        for v in (s, d):
            ahead.setdefault(v, [])
            back.setdefault(v, [])
        ahead[s].append(d)
        back[d].append(s)
    order, seen = [], set()
    for root in ahead:
        stack = [(root, iter(ahead[root]))] if root not in seen else []
        seen.add(root)
        while stack:
            v, rest = stack[-1]
            w = next((x for x in rest if x not in seen), None)
            if w is None:
                order.append(v)
                stack.pop()
            else:
                seen.add(w)
                stack.append((w, iter(ahead[w])))
    label: dict[int, int] = {}
    for root in reversed(order):
        if root not in label:
            own, todo = [], [root]
            label[root] = root
            while todo:
                v = todo.pop()
                own.append(v)
                for w in back[v]:
                    if w not in label:
                        label[w] = root
                        todo.append(w)
            low = min(own)
            label.update((v, low) for v in own)
    return pd.DataFrame({"id": list(label), "scc": list(label.values())}, dtype="int64")


def _spread(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """Smallest label that leads to each vertex, to the fixpoint; only what
    changed is sent on. Null labels are larger than any."""
    new = {"new": F.count_if("new")}
    state, seen = counted(labels.withColumn("new", F.col("label").isNotNull()), **new)
    while seen["new"]:
        sent = state.where("new").select(F.col("id").alias("src"), "label")
        got = edges.join(small(sent, seen["new"]), "src").groupBy(F.col("dst").alias("id")).agg(F.min("label").alias("got"))
        lower = F.coalesce(F.col("label").isNull() | (F.col("got") < F.col("label")), F.lit(False)) & F.col("got").isNotNull()
        state, seen = counted(state.join(got, "id", "left").select("id", F.when(lower, F.col("got")).otherwise(F.col("label")).alias("label"), lower.alias("new")), **new)
    return state.select("id", "label")


def labels(graph: Graph, local_edges: int | None = None) -> DataFrame:
    """``id, scc``: the smallest id of each vertex's component.

    Vertices that nothing leads to, or that lead nowhere, are components of
    their own and go first. Then the smallest ancestor of each vertex is its
    colour, and what leads back to it within the colour is its component.
    """
    with temporary(graph.edges.sparkSession) as keep:
        edges, seen = counted(dedup(graph.edges.where("src <> dst")))
        if is_small(seen["rows"], local_edges):
            found = one_task(edges, _local, SCHEMA)
            return keep(graph.vertices.join(found, "id", "left").select("id", F.coalesce("scc", "id").alias("scc")), "scc")
        rest, done = cut(graph.vertices), []
        with sized(edges.sparkSession, seen["rows"]):
            while True:
                inner, seen = counted(edges.select(F.col("src").alias("id")).distinct().join(edges.select(F.col("dst").alias("id")).distinct(), "id"))
                done.append(rest.join(inner, "id", "left_anti").select("id", F.col("id").alias("scc")))
                if not seen["rows"]:
                    break
                ahead = _spread(inner.select("id", F.col("id").alias("label")), edges)
                of = lambda c: ahead.select(F.col("id").alias(c), F.col("label").alias(f"{c}_l"))  # noqa: B023, E731
                own = cut(edges.join(of("src"), "src").join(of("dst"), "dst").where("src_l = dst_l").select("src", "dst"))
                starts = ahead.select("id", F.when(F.col("id") == F.col("label"), F.col("label")).alias("label"))
                behind = _spread(starts, reverse(own))
                done.append(behind.where("label is not null").select("id", F.col("label").alias("scc")))
                rest = cut(behind.where("label is null").select("id"))
                # Edges between colours join no component.
                stays = lambda c: rest.withColumnRenamed("id", c)  # noqa: B023, E731
                edges = cut(own.join(stays("src"), "src", "left_semi").join(stays("dst"), "dst", "left_semi"))
        out = done[0]
        for table in done[1:]:
            out = out.unionByName(table)
        return keep(out, "scc")


def count(graph: Graph, local_edges: int | None = None) -> DataFrame:
    return labels(graph, local_edges).agg(F.countDistinct("scc").alias("n_scc"))
