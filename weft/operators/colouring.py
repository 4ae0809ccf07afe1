"""Greedy colouring in descending id order.

A vertex takes the smallest colour that no higher neighbour has. The result is
unique: it does not depend on partitions or rounds.

Ids are cut into ranges of about as many edges to higher neighbours. A round
colours one range, the highest first: the colours that its vertices may not
use are joined and aggregated from all higher ranges, and one task settles the
edges inside the range. So there are as many rounds as ranges, however long
the chains of dependent vertices are, and a task never holds more than a
range: ``BLOCK_EDGES`` edges, or one vertex with the colours of its neighbours.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.operators.model import Graph
from weft.plans.lineage import counted, scratch, temporary
from weft.plans.superstep import one_task, sized
from weft.plans.tables import tasks

SCHEMA = "id bigint, colour int"
#: Edges of a range, about, and ranges at least.
BLOCK_EDGES, LEAST_BLOCKS = 4_000_000, 8


def _settle(rest: pd.DataFrame) -> pd.DataFrame:
    """Colours of all ``src`` of a range: rows with ``colour`` -1 are edges
    inside it, the others a colour that is taken above it. A ``dst`` that is no
    ``src`` has no higher neighbour and so colour 0."""
    src, far, used = (rest[c].to_numpy(np.int64) for c in ("src", "dst", "colour"))
    inner = used < 0
    ids = np.unique(src)
    taken: list[set[int]] = [set() for _ in ids]
    for at, c in zip(np.searchsorted(ids, src[~inner]).tolist(), used[~inner].tolist(), strict=True):
        taken[at].add(c)
    own, far = src[inner], far[inner]
    place = np.minimum(np.searchsorted(ids, far), max(0, len(ids) - 1))
    known = ids[place] == far if len(far) else np.zeros(0, bool)
    order = np.argsort(own, kind="stable")
    own, place, known = own[order], np.where(known, place, -1)[order], None
    first = np.searchsorted(own, ids, "left")
    last = np.searchsorted(own, ids, "right")
    colour = np.zeros(len(ids) + 1, np.int32)  # the last one is for place -1
    for v in range(len(ids) - 1, -1, -1):
        mine = taken[v]
        if first[v] < last[v]:
            mine.update(colour[place[first[v] : last[v]]].tolist())
        c = 0
        while c in mine:
            c += 1
        colour[v] = c
    return pd.DataFrame({"id": ids, "colour": colour[:-1]})


def _bounds(up: DataFrame, edges: int, block_edges: int) -> list[int]:
    """The ids at which a new range begins. A vertex of several ranges' edges
    is a range of its own."""
    blocks = max(LEAST_BLOCKS, -(-edges // block_edges))
    cuts = up.approxQuantile("src", [i / blocks for i in range(1, blocks)], 0.25 / blocks)
    cuts = [min(int(c), (1 << 63) - 2) for c in cuts]
    return sorted(set(cuts) | {a + 1 for a, b in zip(cuts, cuts[1:], strict=False) if a == b})


def _number(df: DataFrame, bounds: list[int]) -> DataFrame:
    """``df`` with the ``block`` of its ``src``: how many bounds are not above
    it, by binary search, a step a projection."""
    limits = F.array(*[F.lit(b).cast("bigint") for b in bounds])
    out, step = df.withColumn("block", F.lit(0)), 1 << max(0, len(bounds).bit_length() - 1)
    while step and bounds:
        at = F.col("block") + step - 1
        out = out.withColumn("block", F.when(F.coalesce(F.get(limits, at) <= F.col("src"), F.lit(False)), F.col("block") + step).otherwise(F.col("block")))
        step //= 2
    return out


def colour(graph: Graph, local_edges: int | None = None) -> DataFrame:
    """``id, colour`` of every vertex; isolated ones take 0.

    ``local_edges`` sets the edges of a range, ``BLOCK_EDGES`` by default.
    """
    spark = graph.edges.sparkSession
    with temporary(spark) as keep:
        if graph.exact:
            up, edges = graph.half, graph.rows // 2
        else:
            up, seen = counted(graph.clean().edges.where("dst > src").select("src", "dst") if graph.half is None else graph.half)
            edges = seen["rows"]
        bounds = _bounds(up, edges, max(1, local_edges or BLOCK_EDGES)) if edges else []
        # One folder a range, so that a round reads its own edges and no others.
        blocks, colours = scratch(spark, "colouring-edges"), scratch(spark, "colouring")
        _number(up, bounds).repartitionByRange(tasks(spark, edges), "src").write.partitionBy("block").parquet(blocks)
        roots = graph.vertices.union(up.select("dst")).distinct().join(up.select(F.col("src").alias("id")).distinct(), "id", "left_anti")
        roots.select("id", F.lit(0).alias("colour")).write.parquet(f"{colours}/part=-1")
        with sized(spark, edges // (len(bounds) + 1)):
            for i in reversed(range(len(bounds) + 1)) if edges else ():
                own = spark.read.schema("src bigint, dst bigint, block int").parquet(blocks).where(F.col("block") == i).select("src", "dst")
                # Plain numbers without nulls: nested values reach Python one by one, and nulls make ids floats.
                rows = own.withColumn("colour", F.lit(-1))
                if i < len(bounds):
                    done = spark.read.schema(SCHEMA).parquet(colours)
                    above = own.where(F.col("dst") >= bounds[i]).join(done.select(F.col("id").alias("dst"), "colour"), "dst")
                    used = above.select("src", "colour").distinct().select("src", F.col("src").alias("dst"), "colour")
                    rows = rows.where(F.col("dst") < bounds[i]).unionByName(used)
                one_task(rows, _settle, SCHEMA).write.parquet(f"{colours}/part={i}")
        return keep(spark.read.schema(SCHEMA).parquet(colours).select("id", "colour"), "colours")
