"""The graph model: edge tables and the relational operators over them.

A graph is directed; an undirected one holds each edge in both directions.
``vertices`` has ``id bigint``; ``edges`` has ``src, dst bigint`` and, where
the graph is weighted, ``weight double``.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from weft.plans.lineage import counted

EDGES = StructType([StructField("src", LongType()), StructField("dst", LongType())])
WEIGHTED = StructType([*EDGES.fields, StructField("weight", DoubleType())])
COLOURS = StructType([StructField("id", LongType()), StructField("colour", IntegerType())])


@dataclass(frozen=True)
class Graph:
    vertices: DataFrame
    edges: DataFrame
    #: Of an undirected graph without loops: each edge once, ``src < dst``, where that is at hand.
    half: DataFrame | None = None
    #: The number of edges or a bound above it, where one is known.
    rows: int | None = None
    #: Whether ``half`` is written and ``rows`` is the number itself.
    exact: bool = False

    @staticmethod
    def of(edges: DataFrame, vertices: DataFrame | None = None) -> Graph:
        """A graph over ``edges``; its vertices are the endpoints by default."""
        if vertices is None:
            vertices = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()
        return Graph(vertices.select(F.col("id").cast("bigint").alias("id")), edges)

    @staticmethod
    def undirected(pairs: DataFrame, rows: int | None = None, ends: DataFrame | None = None) -> Graph:
        """The graph over distinct ``src, dst``, ``rows`` of them at most, none
        a loop or another one's reverse: both directions need no ``distinct``.
        ``ends`` are the pairs as they come, where vertices are sooner found there."""
        way = lambda a, b: F.struct(F.col(a).alias("src"), F.col(b).alias("dst"))
        edges = pairs.select(F.inline(F.array(way("src", "dst"), way("dst", "src"))))
        half = pairs.where("src is not null and dst is not null").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
        return Graph(Graph.of(pairs if ends is None else ends).vertices, edges, half, None if rows is None else 2 * rows)

    def held(self) -> Graph:
        """An undirected graph over a checkpoint of its ``half``, with the
        number of its edges, so that nothing derives it again. Edges with an
        unknown end and vertices without edges are left out."""
        half, seen = counted(self.half)
        return replace(Graph.undirected(half, seen["rows"]), half=half, exact=True)

    def clean(self) -> Graph:
        """Without self-loops and parallel edges."""
        return Graph(self.vertices, dedup(self.edges.where("src <> dst")))


def dedup(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").distinct()


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select(*[F.col("dst").alias("src"), F.col("src").alias("dst")], *[c for c in edges.columns if c not in ("src", "dst")])


def symmetrise(edges: DataFrame) -> DataFrame:
    """Both directions of every edge, once; the lightest of parallel ones."""
    both = edges.unionByName(reverse(edges))
    return both.groupBy("src", "dst").agg(F.min("weight").alias("weight")) if "weight" in edges.columns else both.distinct()


def disjoint_union(one: DataFrame, other: DataFrame, offset: int) -> DataFrame:
    """``one`` beside ``other`` with its ids moved up by ``offset``."""
    return one.select("src", "dst").union(other.select(F.col("src") + offset, F.col("dst") + offset))


def degrees(graph: Graph) -> DataFrame:
    counted = graph.edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n"))
    return graph.vertices.join(counted, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("degree"))


def adjacency(graph: Graph) -> DataFrame:
    """``id, neighbours``: sorted sets, empty where there are none."""
    lists = graph.edges.groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_set("dst")).alias("n"))
    return graph.vertices.join(lists, "id", "left").select("id", F.coalesce("n", F.array().cast("array<bigint>")).alias("neighbours"))


def triplets(edges: DataFrame, state: DataFrame, value: str) -> DataFrame:
    """Edges with ``value`` of both endpoints."""
    s = state.select(F.col("id").alias("src"), F.col(value).alias(f"src_{value}"))
    d = state.select(F.col("id").alias("dst"), F.col(value).alias(f"dst_{value}"))
    return edges.join(s, "src").join(d, "dst").select("src", "dst", f"src_{value}", f"dst_{value}")


def higher(edges: DataFrame) -> DataFrame:
    return edges.where("dst > src")


def lower(edges: DataFrame) -> DataFrame:
    return edges.where("dst < src")


def wait_counters(graph: Graph) -> DataFrame:
    """How many higher neighbours each vertex waits for, zeros included."""
    waits = graph.edges.groupBy(F.col("src").alias("id")).agg(F.count_if(F.col("dst") > F.col("src")).alias("n"))
    return graph.vertices.join(waits, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("waiting"))


def neighbour_split(edges: DataFrame) -> DataFrame:
    """Count of higher neighbours and the sorted set of lower ones."""
    return edges.groupBy(F.col("src").alias("id")).agg(
        F.count_if(F.col("dst") > F.col("src")).alias("n_higher"),
        F.array_sort(F.collect_set(F.when(F.col("dst") < F.col("src"), F.col("dst")))).alias("lower"),
    )


def stats(graph: Graph) -> DataFrame:
    """One row: vertices, edges, largest degree, sum of degrees."""
    d = degrees(graph)
    return d.agg(F.count("*").alias("n_vertices"), F.sum("degree").alias("n_edges"), F.max("degree").alias("max_degree"))


def light_heavy(edges: DataFrame, delta: float) -> DataFrame:
    return edges.withColumn("light", F.col("weight") < delta)


def max_weight(edges: DataFrame) -> DataFrame:
    """Largest whole weight; an error where a weight is negative."""
    low = F.raise_error(F.lit("negative weight")).cast("bigint")
    return edges.agg(F.when(F.min("weight") < 0, low).otherwise(F.max(F.col("weight").cast("bigint"))).alias("max_weight"))


def by_weight(edges: DataFrame) -> DataFrame:
    """Edges in the total order (weight, src, dst)."""
    return edges.orderBy("weight", "src", "dst")
