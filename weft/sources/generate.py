"""Graph generators; undirected graphs hold both directions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.operators.model import symmetrise
from weft.plans.lineage import counted, cut, temporary
from weft.plans.superstep import sized


def path(spark: SparkSession, n: int) -> DataFrame:
    """0 - 1 - ... - n-1."""
    return symmetrise(spark.range(n - 1).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst")))


def star(spark: SparkSession, n: int) -> DataFrame:
    """Hub 0 and n leaves."""
    return symmetrise(spark.range(1, n + 1).select(F.lit(0).cast("bigint").alias("src"), F.col("id").alias("dst")))


def complete(spark: SparkSession, n: int) -> DataFrame:
    """Every ordered pair of different vertices."""
    pairs = spark.range(n).select(F.col("id").alias("src"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))).alias("dst"))
    return pairs.where("src <> dst")


def ladder(spark: SparkSession, n: int) -> DataFrame:
    """Two n-cycles joined by n rungs."""
    i = F.col("id")
    turn = F.array(F.struct(i.alias("src"), ((i + 1) % n).alias("dst")), F.struct((i + n).alias("src"), ((i + 1) % n + n).alias("dst")), F.struct(i.alias("src"), (i + n).alias("dst")))
    return symmetrise(spark.range(n).select(F.explode(turn).alias("e")).select("e.*"))


def draw(*parts: int | str | Column) -> Column:
    """A 40-bit number that depends on some numbers alone, so that a
    recomputed partition draws the same."""
    text = F.concat_ws("/", *[(p if isinstance(p, Column) else F.col(p) if isinstance(p, str) else F.lit(p)).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 10), 16, 10).cast("bigint")


def gnp(spark: SparkSession, n: int, p: float, seed: int, directed: bool = False) -> DataFrame:
    """Each pair of different vertices with chance ``p``."""
    hit = (F.col("src") != F.col("dst")) if directed else (F.col("src") < F.col("dst"))
    pairs = spark.range(n).select(F.col("id").alias("src"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))).alias("dst"))
    kept = pairs.where(hit & (draw(seed, "src", "dst") % 1_000_000 < int(p * 1_000_000)))
    return kept if directed else symmetrise(kept)


def random(spark: SparkSession, n: int, edges_per_vertex: int, seed: int) -> DataFrame:
    """Each vertex draws uniform targets above it, 1.5 for each edge that it
    lacks to ``edges_per_vertex`` when the lower vertices have drawn theirs.

    All draws are known at once; how many of them a vertex takes depends on
    the lower ones, so the counts are refined in rounds until they stay: after
    a round, the counts of one more link of every chain are final.
    """
    with temporary(spark) as keep:
        most = edges_per_vertex * 3 // 2
        v = spark.range(n - 1).select(F.col("id").alias("src"), F.explode(F.sequence(F.lit(0), F.lit(most - 1))).alias("j"))
        to = F.col("src") + 1 + F.pmod(draw(seed, "src", "j"), F.lit(n - 1) - F.col("src"))
        draws = cut(v.select("src", "j", to.cast("bigint").alias("dst")))
        takes = cut(spark.range(n - 1).select("id", F.lit(most).cast("bigint").alias("n")))
        with sized(spark, n * most):
            while True:
                taken = draws.join(takes.withColumnRenamed("id", "src"), "src").where("j < n").select("src", "dst").distinct()
                back = taken.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("b"))
                lacks = F.lit(edges_per_vertex) - F.coalesce("b", F.lit(0))
                new = F.greatest(F.floor(lacks * 3 / 2), F.lit(0)).cast("bigint")
                step, seen = counted(takes.join(back, "id", "left").select("id", F.col("n").alias("old"), new.alias("n")), moved=F.count_if(F.col("old") != F.col("n")))
                takes = step.select("id", "n")
                if not seen["moved"]:
                    return keep(symmetrise(taken), "random-graph")


def power_law(spark: SparkSession, scale: int, edges: int, seed: int) -> DataFrame:
    """A recursive-matrix graph over 2**scale ids: each edge descends the
    quadrants of the adjacency matrix, the first most often (57, 19, 19 and 5
    of 100 times)."""
    e = spark.range(edges)
    src = dst = F.lit(0).cast("bigint")
    for level in range(scale):
        u = F.pmod(draw(seed, "id", F.lit(level)), F.lit(100))
        src = src * 2 + (u >= 76).cast("bigint")
        dst = dst * 2 + (((u >= 57) & (u < 76)) | (u >= 95)).cast("bigint")
    return symmetrise(e.select(src.alias("src"), dst.alias("dst")).where("src <> dst").distinct())


def power_law_cluster(spark: SparkSession, n: int, m: int, p: float, seed: int) -> DataFrame:
    """A graph with power-law degrees and triangles, grown by preferential
    attachment: each vertex from ``m`` on makes ``m`` edges to lower ones.

    An edge goes to an end of a random earlier edge, so to a vertex by its
    degree; with chance ``p`` a further edge closes a triangle instead, to a
    random lower neighbour of the vertex that the edge before went to. Vertex
    ``m`` joins the first ``m``; parallel edges are one. Which earlier edge an
    edge copies is known at once; its target is found by rounds in which
    pointers are doubled, so that there are few rounds however long the chains.
    """
    some = lambda what, below: F.pmod(draw(seed, F.lit(what), "v", "j"), below)
    slots = spark.range(m, n).select(F.col("id").alias("v"), F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias("j"))
    slots = slots.withColumns({"w": F.lit(m) + some("vertex", F.greatest(F.col("v") - m, F.lit(1))), "l": some("edge", F.lit(m)).cast("int"), "c": some("near", F.lit(m)).cast("int")})
    first, triangle, whole = F.col("v") == m, (F.col("j") > 0) & (some("kind", F.lit(1_000_000)) < int(p * 1_000_000)), some("end", F.lit(2)) == 0
    # A slot has its target, or waits for the target of slot (wv, wj): to take it, or (peeks) to go on from it.
    known = F.when(first, F.col("j")).when(~triangle & whole, F.col("w"))
    peeks = ~first & triangle
    state = slots.select("v", "j", "w", "l", "c", whole.alias("whole"), known.cast("bigint").alias("t"), peeks.alias("peeks"), F.when(peeks, F.col("v")).otherwise(F.col("w")).alias("wv"), F.when(peeks, F.col("j") - 1).otherwise(F.col("l")).alias("wj"))
    with temporary(spark) as keep, sized(spark, (n - m) * m):
        state, seen = counted(state, open=F.count_if(F.col("t").isNull()))
        while seen["open"]:
            other = state.select(F.col("v").alias("wv"), F.col("j").alias("wj"), F.col("t").alias("ot"), F.col("peeks").alias("op"), F.col("wv").alias("ov"), F.col("wj").alias("oj"))
            met = state.where("t is null").join(other, ["wv", "wj"])
            here, on = F.col("ot").isNotNull(), F.col("ot").isNull() & ~F.col("op")
            closes, falls = F.col("peeks") & here & (F.col("ot") >= m), F.col("peeks") & here & (F.col("ot") < m)
            moved = met.select(
                "v", "j", "w", "l", "c", "whole",
                F.when(here & ~F.col("peeks"), F.col("ot")).when(falls & F.col("whole"), F.col("w")).alias("t"),
                (F.col("peeks") & ~here).alias("peeks"),
                F.when(closes, F.col("ot")).when(falls, F.col("w")).when(on, F.col("ov")).otherwise(F.col("wv")).alias("wv"),
                F.when(closes, F.col("c")).when(falls, F.col("l")).when(on, F.col("oj")).otherwise(F.col("wj")).alias("wj"),
            )
            state, seen = counted(state.where("t is not null").unionByName(moved), open=F.count_if(F.col("t").isNull()))
        return keep(symmetrise(state.select(F.col("v").alias("src"), F.col("t").alias("dst"))), "power-law")
