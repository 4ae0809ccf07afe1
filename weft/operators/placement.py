"""Where vertices and edges live on ``parts`` nodes.

Contiguous ranges, round robin, and a two-dimensional vertex cut in which the
i-th neighbour of a vertex is stored i nodes after its master. A vertex's
position is its place in id order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft.functions.scalars import id_string, numeric_id, part_of, range_end, range_start
from weft.operators.model import Graph, dedup, degrees
from weft.plans.lineage import cut
from weft.plans.ordinal import BUCKET, ordinal_in_parts, with_ordinal
from weft.plans.tables import tasks


def ranges(spark, total: int, parts: int) -> DataFrame:
    n, p, i = F.lit(total), F.lit(parts), F.col("id")
    return spark.range(parts).select(i.alias("part"), range_start(n, p, i).cast("bigint").alias("start"), range_end(n, p, i).cast("bigint").alias("end"))


def parts_of(spark, total: int, parts: int) -> DataFrame:
    return spark.range(total).select(F.col("id").alias("i"), part_of(F.lit(total), F.lit(parts), F.col("id")).cast("bigint").alias("part"))


def chunked(graph: Graph, parts: int) -> DataFrame:
    """``id, node, local``: contiguous ranges of positions."""
    placed = with_ordinal(graph.vertices, "id")
    total = graph.vertices.agg(F.count("*").alias("total"))
    at = placed.join(F.broadcast(total))
    node = part_of(F.col("total"), F.lit(parts), F.col("k"))
    return at.select("id", node.cast("int").alias("node"), (F.col("k") - range_start(F.col("total"), F.lit(parts), node)).cast("bigint").alias("local"))


def round_robin(graph: Graph, parts: int) -> DataFrame:
    """``id, node, local``: position modulo and divided by the nodes."""
    k = with_ordinal(graph.vertices, "id")
    return k.select("id", F.pmod("k", F.lit(parts)).cast("int").alias("node"), F.floor(F.col("k") / parts).cast("bigint").alias("local"))


def convert(graph: Graph, ids: DataFrame, parts: int) -> DataFrame:
    """Global ids of the requested vertices."""
    return round_robin(graph, parts).join(ids.select("id"), "id", "left_semi")


def numeric_ids(graph: Graph, parts: int) -> DataFrame:
    p = round_robin(graph, parts)
    return p.select("id", numeric_id(F.col("node"), F.col("local")).alias("numeric"), id_string(F.col("node"), F.col("local")).alias("name"))


def csr_offsets(graph: Graph, parts: int) -> DataFrame:
    """``node, local, id, degree, offset``: edges of earlier vertices on a node.

    Sums run inside buckets of local ids and then over buckets, so that a node
    need not fit into one task.
    """
    rows = round_robin(graph, parts).join(degrees(graph), "id").withColumn("b", F.floor(F.col("local") / BUCKET))
    upto = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    local = F.coalesce(F.sum("degree").over(upto(Window.partitionBy("node", "b").orderBy("local"))), F.lit(0))
    totals = rows.groupBy("node", "b").agg(F.sum("degree").alias("t"))
    base = totals.select("node", "b", F.coalesce(F.sum("t").over(upto(Window.partitionBy("node").orderBy("b"))), F.lit(0)).alias("base"))
    return rows.withColumn("o", local).join(base, ["node", "b"]).select("node", "local", "id", "degree", (F.col("base") + F.col("o")).alias("offset"))


def vertex_cut(graph: Graph, parts: int, at: DataFrame | None = None) -> DataFrame:
    """``src, dst, pos, master, node`` of every edge; ``at`` is the round
    robin of the vertices, where it is at hand.

    A neighbour's place is its ordinal among all edges less the vertex's
    first one. Edges are met by vertex and range of edges, so that a hub's
    neighbours are never one array or one task.
    """
    edges = graph.edges.select("src", "dst") if graph.half is not None else dedup(graph.edges)
    n = tasks(edges.sparkSession, edges.count() if graph.rows is None else graph.rows)
    edges = ordinal_in_parts(edges, "src", "dst", tasks=n)
    runs = edges.groupBy("_part", "src").agg(F.min("k").alias("k"))
    owners = (round_robin(graph, parts) if at is None else at).select(F.col("id").alias("src"), F.col("node").alias("master"))
    known = runs.groupBy("src").agg(F.min("k").alias("first")).join(owners, "src").join(runs.select("_part", "src"), "src")
    met = edges.repartition(n, "_part", "src").join(known.repartition(n, "_part", "src"), ["_part", "src"])
    each = met.select("src", "dst", (F.col("k") - F.col("first")).cast("int").alias("pos"), "master")
    return each.select("src", "dst", "pos", "master", F.pmod(F.col("master") + F.col("pos"), F.lit(parts)).cast("int").alias("node"))


def masters(graph: Graph, parts: int) -> DataFrame:
    """Masters with the number of their edges kept on their own node."""
    at = round_robin(graph, parts)
    own = vertex_cut(graph, parts, at).where("node = master").groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n"))
    return at.join(own, "id", "left").select("id", "node", "local", F.coalesce("n", F.lit(0)).alias("n_edges"))


def shadows(graph: Graph, parts: int, at: DataFrame | None = None) -> DataFrame:
    """``id, node, n_edges``: vertices with edges away from their master."""
    return vertex_cut(graph, parts, at).where("node <> master").groupBy(F.col("src").alias("id"), "node").agg(F.count("*").alias("n_edges"))


def co_owners(graph: Graph, parts: int, return_self: bool = False) -> DataFrame:
    """``id, master, nodes``: the sorted other nodes with a vertex's edges;
    with ``return_self`` the master too, for every vertex."""
    at = round_robin(graph, parts)
    away = vertex_cut(graph, parts, at).where("node <> master").select("src", "master", "node")
    if return_self:
        away = away.unionByName(at.select(F.col("id").alias("src"), F.col("node").alias("master"), "node"))
    return away.groupBy(F.col("src").alias("id"), "master").agg(F.array_sort(F.collect_set("node")).alias("nodes"))


def shadow_ids(graph: Graph, parts: int) -> DataFrame:
    """``id, node, local``: shadows numbered after the most masters of a node."""
    at = round_robin(graph, parts)
    most = at.groupBy("node").agg(F.count("*").alias("n")).agg(F.max("n").alias("most"))
    rows = cut(with_ordinal(shadows(graph, parts, at).select("id", "node"), "node", "id"))
    # One row a node.
    first = rows.groupBy("node").agg(F.min("k").alias("first"))
    at = rows.join(F.broadcast(first), "node").join(F.broadcast(most))
    return at.select("id", "node", (F.col("most") + F.col("k") - F.col("first")).cast("bigint").alias("local"))


def kinds(graph: Graph, parts: int) -> DataFrame:
    """``id, node, kind`` for every vertex seen from every node."""
    at = round_robin(graph, parts)
    seen = at.select("id", F.col("node").alias("master"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("node"))
    away = shadows(graph, parts, at).select("id", "node", F.lit(True).alias("shadow"))
    kind = F.when(F.col("node") == F.col("master"), "master").when(F.col("shadow"), "shadow").otherwise("non_local")
    return seen.join(away, ["id", "node"], "left").select("id", "node", kind.alias("kind"))


def _limits(graph: Graph, parts: int, divisor: int | None, edge_divisor: int | None) -> tuple[DataFrame, DataFrame]:
    by = divisor or max(1, parts - 1)
    rows = round_robin(graph, parts).join(degrees(graph), "id")
    used = rows.groupBy("node").agg(F.count("*").alias("n_vertices"), F.sum("degree").alias("n_edges"))
    total = used.agg((F.floor(F.sum("n_vertices") / by) + 1).alias("vertex_limit"), (F.floor(F.sum("n_edges") / (edge_divisor or by)) + 1).alias("edge_limit"))
    return used, total


def limits(graph: Graph, parts: int, divisor: int | None = None, edge_divisor: int | None = None) -> DataFrame:
    """Use and limit of every node, and whether either limit is exceeded.

    The limits are the totals over the divisors, which are the nodes less one
    by default; ``edge_divisor`` is ``divisor`` by default.
    """
    used, total = _limits(graph, parts, divisor, edge_divisor)
    over = (F.col("n_vertices") > F.col("vertex_limit")) | (F.col("n_edges") > F.col("edge_limit"))
    return used.join(F.broadcast(total)).select("node", "n_vertices", "n_edges", "vertex_limit", "edge_limit", over.alias("exceeded"))


def check_limits(graph: Graph, parts: int, divisor: int | None = None, edge_divisor: int | None = None) -> None:
    bad = limits(graph, parts, divisor, edge_divisor).where("exceeded").first()
    if bad:
        raise ValueError(f"node {bad.node} exceeds its limits: {bad.n_vertices} vertices, {bad.n_edges} edges")


def occupancy(graph: Graph, parts: int, divisor: int | None = None) -> DataFrame:
    used, total = _limits(graph, parts, divisor, None)
    share = lambda a, b: (F.col(a) / F.col(b)).cast("double")
    return used.join(F.broadcast(total)).select("node", share("n_vertices", "vertex_limit").alias("v_occup"), share("n_edges", "edge_limit").alias("e_occup"))


def global_ids(graph: Graph, parts: int, locals_: DataFrame) -> DataFrame:
    """``node, local, id`` of asked masters (``node, local``); an error where a
    local id is out of its node's range."""
    found = locals_.select(F.col("node").cast("int").alias("node"), F.col("local").cast("bigint").alias("local")).join(round_robin(graph, parts), ["node", "local"], "left")
    bad = F.raise_error(F.format_string("no vertex (%d,%d)", "node", "local")).cast("bigint")
    return found.select("node", "local", F.when(F.col("id").isNull(), bad).otherwise(F.col("id")).alias("id"))


def placed_edges(graph: Graph, placement: DataFrame) -> DataFrame:
    """Edges as pairs of global ids, by two equi-joins."""
    of = lambda c: placement.select(F.col("id").alias(c), F.struct("node", "local").alias(f"{c}_at"))
    return graph.edges.select("src", "dst").join(of("src"), "src").join(of("dst"), "dst").select("src_at", "dst_at")


def mapped_back(edges: DataFrame, placement: DataFrame) -> DataFrame:
    """``placed_edges`` turned back into original ids."""
    of = lambda c: placement.select(F.struct("node", "local").alias(f"{c}_at"), F.col("id").alias(c))
    return edges.join(of("src"), "src_at").join(of("dst"), "dst_at").select("src", "dst")

