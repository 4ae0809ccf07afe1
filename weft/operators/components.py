"""Connected components by minimum-label exchange with pointer jumping."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.plans.lineage import counted, temporary
from weft.plans.superstep import is_small, one_task, sized, small


def _local(edges: pd.DataFrame) -> pd.DataFrame:
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for s, d in zip(edges.s.tolist(), edges.d.tolist(), strict=True):
        a, b = find(s), find(d)
        parent[max(a, b)] = min(a, b)
    return pd.DataFrame({"id": list(parent), "component": [find(x) for x in parent]}, dtype="int64")


def components(edges: DataFrame, max_rounds: int = 1000, local_edges: int | None = None) -> DataFrame:
    """``(id, component)`` for every endpoint of the undirected ``(src, dst)``.

    ``component`` is the smallest id reachable. Each round takes the smallest
    label among a vertex and its neighbours, then the label of that label, so
    that chains halve; one reliable checkpoint and one count a round. Null
    endpoints and self-loops add nothing but the vertex itself. All runs are
    rounds unless ``local_edges`` allows one task for so few edges.
    """
    e = edges.select(F.col("src").alias("s"), F.col("dst").alias("d")).where("s is not null and d is not null")
    with temporary(edges.sparkSession) as keep:
        both, seen = counted(e.select(F.least("s", "d").alias("s"), F.greatest("s", "d").alias("d")).distinct())
        if is_small(seen["rows"], local_edges):
            return keep(one_task(both, _local, "id bigint, component bigint"), "components")
        # Turned row by row: a union would double the tasks of every round.
        both = both.select(F.inline(F.array(F.struct("s", "d"), F.struct(F.col("d").alias("s"), F.col("s").alias("d")))))
        with sized(edges.sparkSession, 2 * seen["rows"]):
            labels, seen = counted(both.groupBy(F.col("s").alias("id")).agg(F.least(F.min("d"), F.first("s")).alias("component")))
            n = seen["rows"]
            for _ in range(max_rounds):
                # A hub is the key of many edges: few labels are broadcast to them.
                near = both.join(small(labels, n), both.d == labels.id).groupBy("s").agg(F.min("component").alias("near"))
                lower = labels.join(near, labels.id == near.s).select("id", F.col("component").alias("old"), F.least("component", "near").alias("low"))
                # The label of a label comes from the table of this round's start, which is a vertex too.
                jump = labels.select(F.col("id").alias("low"), F.col("component").alias("far"))
                step, seen = counted(lower.join(small(jump, n), "low").select("id", "old", F.least("low", "far").alias("component")), moved=F.count_if(F.col("old") != F.col("component")))
                labels = step.select("id", "component")
                if not seen["moved"]:
                    return keep(labels, "components")
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
