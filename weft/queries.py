"""The registered graph queries and their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions import logs
from weft.functions.scalars import mex
from weft.operators import bfs, colouring, components, model, mst, placement, scc, sssp, traversal, validate
from weft.operators.model import Graph
from weft.plans.lineage import cut, scratch, temporary
from weft.plans.superstep import superstep
from weft.sources import derive, generate, textgraph

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
#: Nodes of the placement queries, and of the uneven case.
P, P_ODD = 3, 5

# --- SQL of the derived graphs -------------------------------------------------

CC = """cc_h AS (
  SELECT DISTINCT least(a, b) AS s, greatest(a, b) AS d
  FROM (SELECT o_custkey AS a, lead(o_custkey) OVER (ORDER BY o_orderkey) AS b, o_orderkey AS k FROM orders)
  WHERE b IS NOT NULL AND a <> b),
cc AS (SELECT s AS src, d AS dst FROM cc_h UNION ALL SELECT d, s FROM cc_h),
ccv AS (SELECT DISTINCT src AS id FROM cc),
cck AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS k, count(*) OVER () AS n FROM ccv),
ccd AS (SELECT v.id, count(e.dst) AS degree FROM ccv v LEFT JOIN cc e ON e.src = v.id GROUP BY v.id)"""
SP = """sp_h AS (SELECT DISTINCT 2 * l_suppkey AS s, 2 * l_partkey + 1 AS d FROM lineitem),
sp AS (SELECT s AS src, d AS dst FROM sp_h UNION ALL SELECT d, s FROM sp_h),
spv AS (SELECT DISTINCT src AS id FROM sp),
spk AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS k, count(*) OVER () AS n FROM spv)"""
PP = """pp_h AS (
  SELECT DISTINCT a.l_partkey AS s, b.l_partkey AS d FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey WHERE a.l_partkey < b.l_partkey),
pp AS (SELECT s AS src, d AS dst FROM pp_h UNION ALL SELECT d, s FROM pp_h),
ppv AS (SELECT DISTINCT src AS id FROM pp)"""
UT = """ut AS (
  SELECT a AS src, b AS dst, CAST(min(1 + k % 10) AS DOUBLE) AS weight
  FROM (SELECT user_id AS a, lead(user_id) OVER (ORDER BY event_id) AS b, event_id AS k FROM events)
  WHERE b IS NOT NULL AND a <> b GROUP BY a, b),
utv AS (SELECT src AS id FROM ut UNION SELECT dst FROM ut),
uu AS (SELECT src, dst, min(weight) AS weight FROM (SELECT src, dst, weight FROM ut UNION ALL SELECT dst, src, weight FROM ut) GROUP BY src, dst)"""
RR = f"rr AS (SELECT id, CAST(k % {P} AS INTEGER) AS node, CAST(k // {P} AS BIGINT) AS local FROM cck)"
CUT = f"""spr AS (SELECT id, k % {P} AS node FROM spk),
cut_e AS (SELECT e.src, e.dst, CAST(row_number() OVER (PARTITION BY e.src ORDER BY e.dst) - 1 AS INTEGER) AS pos, CAST(r.node AS INTEGER) AS master FROM sp e JOIN spr r ON r.id = e.src),
vc AS (SELECT src, dst, pos, master, CAST((master + pos) % {P} AS INTEGER) AS node FROM cut_e)"""


def _with(*parts: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(parts) + "\n"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return add


def cc(spark: SparkSession, sf_dir: str) -> Graph:
    return derive.hand_off(spark, sf_dir)


def steps(spark: SparkSession, sf_dir: str) -> Graph:
    return Graph.of(derive.user_steps(spark, sf_dir))


def friends(spark: SparkSession, sf_dir: str) -> Graph:
    return Graph.of(model.symmetrise(derive.user_steps(spark, sf_dir)))


def _long(*names: str) -> list:
    return [F.col(n).cast("bigint").alias(n) for n in names]


# --- model ---------------------------------------------------------------------


@query("vertices", _with(CC) + "SELECT id FROM ccv")
def vertices(spark, sf_dir):
    return cc(spark, sf_dir).vertices


@query("neighbours", _with(SP) + "SELECT src, dst FROM sp")
def neighbours(spark, sf_dir):
    return derive.supplier_part(spark, sf_dir).edges


@query("symmetrise", _with(UT) + "SELECT src, dst, weight FROM uu")
def symmetrise(spark, sf_dir):
    return friends(spark, sf_dir).edges


@query("reverse_edges", _with(UT) + "SELECT dst AS src, src AS dst, weight FROM ut")
def reverse_edges(spark, sf_dir):
    return model.reverse(derive.user_steps(spark, sf_dir))


@query("dedup_edges", "SELECT DISTINCT l_orderkey AS src, l_partkey AS dst FROM lineitem")
def dedup_edges(spark, sf_dir):
    from weft.plans.tables import table

    return model.dedup(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst")))


@query("disjoint_union", _with(CC, UT) + "SELECT src, dst FROM cc UNION ALL SELECT src + 1000000, dst + 1000000 FROM ut")
def disjoint_union(spark, sf_dir):
    return model.disjoint_union(cc(spark, sf_dir).edges, derive.user_steps(spark, sf_dir), 1_000_000)


@query("degrees", _with(CC) + "SELECT id, degree FROM ccd")
def degrees(spark, sf_dir):
    return model.degrees(cc(spark, sf_dir))


@query("graph_stats", _with(CC) + "SELECT count(*) AS n_vertices, CAST(sum(degree) AS BIGINT) AS n_edges, max(degree) AS max_degree FROM ccd")
def graph_stats(spark, sf_dir):
    return model.stats(cc(spark, sf_dir))


@query("triplets", _with(CC) + "SELECT e.src, e.dst, a.degree AS src_degree, b.degree AS dst_degree FROM cc e JOIN ccd a ON a.id = e.src JOIN ccd b ON b.id = e.dst")
def triplets(spark, sf_dir):
    g = cc(spark, sf_dir)
    return model.triplets(g.edges, model.degrees(g), "degree")


@query("higher_neighbours", _with(CC) + "SELECT src, dst FROM cc WHERE dst > src")
def higher_neighbours(spark, sf_dir):
    return model.higher(cc(spark, sf_dir).edges)


@query("lower_neighbours", _with(CC) + "SELECT src, dst FROM cc WHERE dst < src")
def lower_neighbours(spark, sf_dir):
    return model.lower(cc(spark, sf_dir).edges)


@query("wait_counters", _with(CC) + "SELECT v.id, count(e.dst) AS waiting FROM ccv v LEFT JOIN cc e ON e.src = v.id AND e.dst > e.src GROUP BY v.id")
def wait_counters(spark, sf_dir):
    return model.wait_counters(cc(spark, sf_dir))


@query("neighbour_split", _with(CC) + "SELECT src AS id, count(*) FILTER (WHERE dst > src) AS n_higher, coalesce(string_agg(CAST(dst AS VARCHAR), ',' ORDER BY dst) FILTER (WHERE dst < src), '') AS lower FROM cc GROUP BY src")
def neighbour_split(spark, sf_dir):
    found = model.neighbour_split(cc(spark, sf_dir).edges)
    return found.withColumn("lower", F.array_join(F.col("lower").cast("array<string>"), ","))


@query("edge_light_heavy", _with(UT) + "SELECT src, dst, weight, weight < 4 AS light FROM ut")
def edge_light_heavy(spark, sf_dir):
    return model.light_heavy(derive.user_steps(spark, sf_dir), 4.0)


@query("max_weight", _with(UT) + "SELECT CAST(max(weight) AS BIGINT) AS max_weight FROM ut")
def max_weight(spark, sf_dir):
    return model.max_weight(derive.user_steps(spark, sf_dir))


@query("edges_by_weight", _with(UT) + "SELECT src, dst, weight FROM ut ORDER BY weight, src, dst")
def edges_by_weight(spark, sf_dir):
    return model.by_weight(derive.user_steps(spark, sf_dir))


@query("mex", _with(CC) + ", u AS (SELECT src AS id, list_distinct(list(CAST(dst % 4 AS INTEGER))) AS used FROM cc GROUP BY src) SELECT id, CAST(list_min(list_filter(range(0, len(used) + 1), lambda x: NOT list_contains(used, CAST(x AS INTEGER)))) AS INTEGER) AS mex FROM u")
def mex_(spark, sf_dir):
    used = cc(spark, sf_dir).edges.groupBy(F.col("src").alias("id")).agg(F.collect_set((F.col("dst") % 4).cast("int")).alias("used"))
    return used.select("id", mex(F.col("used")).alias("mex"))


# --- placement -----------------------------------------------------------------


@query("partition_ranges", "SELECT p AS part, (14 // 5) * p + least(p, 14 % 5) AS start, (14 // 5) * (p + 1) + least(p + 1, 14 % 5) AS \"end\" FROM (SELECT unnest(range(0, 5)) AS p)")
def partition_ranges(spark, sf_dir):
    return placement.ranges(spark, 14, P_ODD)


@query("partition_of", "WITH r AS (SELECT p, (14 // 5) * p + least(p, 14 % 5) AS a, (14 // 5) * (p + 1) + least(p + 1, 14 % 5) AS b FROM (SELECT unnest(range(0, 5)) AS p)) SELECT i, r.p AS part FROM (SELECT unnest(range(0, 14)) AS i) JOIN r ON i >= r.a AND i < r.b")
def partition_of(spark, sf_dir):
    return placement.parts_of(spark, 14, P_ODD)


@query("place_chunked", _with(CC, f"r AS (SELECT p, (n // {P_ODD}) * p + least(p, n % {P_ODD}) AS a, (n // {P_ODD}) * (p + 1) + least(p + 1, n % {P_ODD}) AS b FROM (SELECT unnest(range(0, {P_ODD})) AS p) CROSS JOIN (SELECT count(*) AS n FROM ccv))") + "SELECT id, CAST(r.p AS INTEGER) AS node, CAST(k - r.a AS BIGINT) AS local FROM cck JOIN r ON k >= r.a AND k < r.b")
def place_chunked(spark, sf_dir):
    return placement.chunked(cc(spark, sf_dir), P_ODD)


@query("place_round_robin", _with(CC, RR) + "SELECT id, node, local FROM rr")
def place_round_robin(spark, sf_dir):
    return placement.round_robin(cc(spark, sf_dir), P)


@query("numeric_ids", _with(CC, RR) + "SELECT id, local * 4294967296 + node AS numeric FROM rr")
def numeric_ids(spark, sf_dir):
    return placement.numeric_ids(cc(spark, sf_dir), P).select("id", "numeric")


@query("id_strings", _with(CC, RR) + "SELECT id, '(' || node || ',' || local || ')' AS name FROM rr")
def id_strings(spark, sf_dir):
    return placement.numeric_ids(cc(spark, sf_dir), P).select("id", "name")


@query("convert_vertices", _with(CC, RR) + "SELECT id, node, local FROM rr WHERE id IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def convert_vertices(spark, sf_dir):
    from weft.plans.tables import table

    urgent = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("id")).distinct()
    return placement.convert(cc(spark, sf_dir), urgent, P)


@query("csr_offsets", _with(CC, RR) + 'SELECT node, local, rr.id, degree, CAST(coalesce(sum(degree) OVER (PARTITION BY node ORDER BY local ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM rr JOIN ccd ON ccd.id = rr.id')
def csr_offsets(spark, sf_dir):
    return placement.csr_offsets(cc(spark, sf_dir), P)


@query("place_rr2d_edges", _with(SP, CUT) + "SELECT src, dst, pos, master, node FROM vc")
def place_rr2d_edges(spark, sf_dir):
    return placement.vertex_cut(derive.supplier_part(spark, sf_dir), P)


@query("rr2d_masters", _with(SP, CUT) + f"SELECT k.id, CAST(k.k % {P} AS INTEGER) AS node, CAST(k.k // {P} AS BIGINT) AS local, count(v.dst) AS n_edges FROM spk k LEFT JOIN vc v ON v.src = k.id AND v.node = v.master GROUP BY k.id, k.k")
def rr2d_masters(spark, sf_dir):
    return placement.masters(derive.supplier_part(spark, sf_dir), P)


@query("rr2d_shadows", _with(SP, CUT) + "SELECT src AS id, node, count(*) AS n_edges FROM vc WHERE node <> master GROUP BY src, node")
def rr2d_shadows(spark, sf_dir):
    return placement.shadows(derive.supplier_part(spark, sf_dir), P)


@query("rr2d_coowners", _with(SP, CUT) + "SELECT id, master, string_agg(CAST(node AS VARCHAR), ',' ORDER BY node) AS nodes FROM (SELECT DISTINCT src AS id, master, node FROM vc WHERE node <> master) GROUP BY id, master")
def rr2d_coowners(spark, sf_dir):
    found = placement.co_owners(derive.supplier_part(spark, sf_dir), P)
    return found.withColumn("nodes", F.array_join(F.col("nodes").cast("array<string>"), ","))


@query("rr2d_shadow_ids", _with(SP, CUT) + f"SELECT id, node, CAST((SELECT max(c) FROM (SELECT count(*) AS c FROM spk GROUP BY k % {P})) + row_number() OVER (PARTITION BY node ORDER BY id) - 1 AS BIGINT) AS local FROM (SELECT DISTINCT src AS id, node FROM vc WHERE node <> master)")
def rr2d_shadow_ids(spark, sf_dir):
    return placement.shadow_ids(derive.supplier_part(spark, sf_dir), P)


@query("vertex_kind", _with(SP, CUT, "sh AS (SELECT DISTINCT src AS id, node FROM vc WHERE node <> master)") + f"SELECT r.id, CAST(p.p AS INTEGER) AS node, CASE WHEN r.node = p.p THEN 'master' WHEN sh.id IS NOT NULL THEN 'shadow' ELSE 'non_local' END AS kind FROM spr r CROSS JOIN (SELECT unnest(range(0, {P})) AS p) p LEFT JOIN sh ON sh.id = r.id AND sh.node = p.p")
def vertex_kind(spark, sf_dir):
    return placement.kinds(derive.supplier_part(spark, sf_dir), P)


@query("vertex_counts", _with(CC, RR) + "SELECT node, count(*) AS n_vertices, (SELECT max(c) FROM (SELECT count(*) AS c FROM rr GROUP BY node)) AS max_vertices FROM rr GROUP BY node")
def vertex_counts(spark, sf_dir):
    counts = placement.round_robin(cc(spark, sf_dir), P).groupBy("node").agg(F.count("*").alias("n_vertices"))
    return counts.join(F.broadcast(counts.agg(F.max("n_vertices").alias("max_vertices"))))


USED = "used AS (SELECT node, count(*) AS n_vertices, CAST(sum(degree) AS BIGINT) AS n_edges FROM rr JOIN ccd ON ccd.id = rr.id GROUP BY node), lim AS (SELECT CAST(sum(n_vertices) AS BIGINT) // 2 + 1 AS vertex_limit, CAST(sum(n_edges) AS BIGINT) // 2 + 1 AS edge_limit FROM used)"


@query("partition_limits", _with(CC, RR, USED) + "SELECT node, n_vertices, n_edges, vertex_limit, edge_limit, n_vertices > vertex_limit OR n_edges > edge_limit AS exceeded FROM used CROSS JOIN lim")
def partition_limits(spark, sf_dir):
    return placement.limits(cc(spark, sf_dir), P)


@query("partition_occupancy", _with(CC, RR, USED) + "SELECT node, CAST(n_vertices AS DOUBLE) / vertex_limit AS v_occup, CAST(n_edges AS DOUBLE) / edge_limit AS e_occup FROM used CROSS JOIN lim")
def partition_occupancy(spark, sf_dir):
    return placement.occupancy(cc(spark, sf_dir), P)


# --- algorithms ----------------------------------------------------------------

LEVELS = """levels(id, dist) USING KEY (id) AS (
  SELECT min(id), CAST(0 AS INTEGER) FROM ccv
  UNION
  SELECT DISTINCT e.dst, l.dist + 1 FROM levels l JOIN cc e ON e.src = l.id WHERE e.dst NOT IN (SELECT id FROM recurring.levels))"""
TREE = "tree AS (SELECT l.id, CASE WHEN l.dist = 0 THEN l.id ELSE min(p.id) END AS pred, l.dist FROM levels l LEFT JOIN cc e ON e.dst = l.id LEFT JOIN levels p ON p.id = e.src AND p.dist = l.dist - 1 GROUP BY l.id, l.dist)"


@query("bfs_levels", _with(CC, LEVELS, recursive=True) + "SELECT dist, count(*) AS n_vertices FROM levels GROUP BY dist")
def bfs_levels(spark, sf_dir):
    g = cc(spark, sf_dir)
    g = Graph(g.vertices, cut(g.edges))
    return bfs.reach(g, bfs.first_vertex(Graph.of(g.edges)), symmetric=True).groupBy("dist").agg(F.count("*").alias("n_vertices"))


@query("bfs_tree", _with(CC, LEVELS, TREE, recursive=True) + "SELECT v.id, t.pred, t.dist FROM ccv v LEFT JOIN tree t ON t.id = v.id")
def bfs_tree(spark, sf_dir):
    return bfs.tree(Graph.of(cut(cc(spark, sf_dir).edges)), symmetric=True)


REACHED = "walk AS (SELECT min(id) AS v FROM utv UNION SELECT e.dst FROM walk w JOIN ut e ON e.src = w.v)"


@query("bfs_visited", _with(UT, REACHED, recursive=True) + "SELECT id, id IN (SELECT v FROM walk) AS visited FROM utv")
def bfs_visited(spark, sf_dir):
    return bfs.visited(Graph.of(cut(derive.user_steps(spark, sf_dir))))


FIFO = """near AS (SELECT src, list(dst ORDER BY dst) AS ns FROM uu GROUP BY src),
q AS (
  SELECT 0 AS i, [(SELECT min(id) FROM utv)] AS queue, CAST([NULL] AS BIGINT[]) AS parents
  UNION ALL
  SELECT i + 1,
         queue || list_filter(coalesce(n.ns, []), lambda x: NOT list_contains(queue, x)),
         parents || list_transform(list_filter(coalesce(n.ns, []), lambda x: NOT list_contains(queue, x)), lambda x: queue[i + 1])
  FROM q LEFT JOIN near n ON n.src = queue[i + 1] WHERE i < len(queue)),
last AS (SELECT queue, parents FROM q ORDER BY i DESC LIMIT 1)"""


@query("bfs_edges", _with(UT, FIFO, recursive=True) + "SELECT CAST(j - 2 AS BIGINT) AS pos, parents[j] AS parent, queue[j] AS child FROM (SELECT queue, parents, unnest(range(2, len(queue) + 1)) AS j FROM last)")
def bfs_edges(spark, sf_dir):
    return bfs.visit_edges(Graph.of(cut(friends(spark, sf_dir).edges)))


STACK = """near AS (SELECT src, list(dst ORDER BY dst) AS ns FROM uu GROUP BY src),
d AS (
  SELECT 0 AS i, [(SELECT min(id) FROM utv)] AS stack, [(SELECT min(id) FROM utv)] AS seen, CAST([] AS BIGINT[]) AS parents, CAST([] AS BIGINT[]) AS post
  UNION ALL
  SELECT i + 1,
         CASE WHEN w IS NULL THEN stack[1:len(stack) - 1] ELSE list_append(stack, w) END,
         CASE WHEN w IS NULL THEN seen ELSE list_append(seen, w) END,
         CASE WHEN w IS NULL THEN parents ELSE list_append(parents, stack[len(stack)]) END,
         CASE WHEN w IS NULL THEN list_append(post, stack[len(stack)]) ELSE post END
  FROM (SELECT d.*, list_min(list_filter(coalesce(n.ns, []), lambda x: NOT list_contains(d.seen, x))) AS w FROM d LEFT JOIN near n ON n.src = d.stack[len(d.stack)] WHERE len(d.stack) > 0)),
last AS (SELECT seen, parents, post FROM d ORDER BY i DESC LIMIT 1)"""


@query("dfs_edges", _with(UT, STACK, recursive=True) + "SELECT CAST(j - 1 AS BIGINT) AS pos, parents[j] AS parent, seen[j + 1] AS child FROM (SELECT seen, parents, unnest(range(1, len(parents) + 1)) AS j FROM last)")
def dfs_edges(spark, sf_dir):
    return traversal.edges(Graph.of(cut(friends(spark, sf_dir).edges)))


@query("dfs_postorder", _with(UT, STACK, recursive=True) + "SELECT CAST(j - 1 AS BIGINT) AS pos, post[j] AS id FROM (SELECT post, unnest(range(1, len(post) + 1)) AS j FROM last)")
def dfs_postorder(spark, sf_dir):
    return traversal.postorder(Graph.of(cut(friends(spark, sf_dir).edges)))


def _greedy(edges: str, vertices: str) -> str:
    return f"""o AS (SELECT id, row_number() OVER (ORDER BY id DESC) AS rn FROM {vertices}),
nb AS (SELECT o.id, o.rn, list(h.rn) FILTER (WHERE h.rn IS NOT NULL) AS hs FROM o LEFT JOIN {edges} e ON e.src = o.id AND e.dst > e.src LEFT JOIN o h ON h.id = e.dst GROUP BY o.id, o.rn),
g AS (
  SELECT CAST(0 AS BIGINT) AS i, CAST([] AS INTEGER[]) AS cs
  UNION ALL
  SELECT g.i + 1, list_append(g.cs, CAST(list_min(list_filter(range(0, coalesce(len(nb.hs), 0) + 1), lambda c: NOT list_contains(list_transform(coalesce(nb.hs, []), lambda r: g.cs[r]), CAST(c AS INTEGER)))) AS INTEGER))
  FROM g JOIN nb ON nb.rn = g.i + 1),
colours AS (SELECT o.id, l.cs[o.rn] AS colour FROM o CROSS JOIN (SELECT cs FROM g ORDER BY i DESC LIMIT 1) l)"""


@query("colouring", _with(CC, _greedy("cc", "ccv"), recursive=True) + "SELECT id, colour FROM colours")
def colouring_(spark, sf_dir):
    return colouring.colour(cc(spark, sf_dir))


@query("colouring_isolated", _with(CC, "allv AS (SELECT c_custkey AS id FROM customer UNION SELECT id FROM ccv)", _greedy("cc", "allv"), recursive=True) + "SELECT id, colour FROM colours")
def colouring_isolated(spark, sf_dir):
    from weft.plans.tables import table

    g = cc(spark, sf_dir)
    people = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("bigint").alias("id"))
    return colouring.colour(Graph(people.union(g.vertices).distinct(), g.edges, g.half, g.rows))


@query("colouring_copurchase", _with(PP, _greedy("pp", "ppv"), recursive=True) + "SELECT colour, count(*) AS n_vertices FROM colours GROUP BY colour")
def colouring_copurchase(spark, sf_dir):
    """Colour classes of the co-purchase graph; the bench query."""
    with temporary(spark) as keep:
        colours = keep(colouring.colour(derive.co_purchase(spark, sf_dir).held()), "colours")
    return colours.groupBy("colour").agg(F.count("*").alias("n_vertices"))


def _distances(edges: str) -> str:
    return f"""far(id, dist) USING KEY (id) AS (
  SELECT min(id), CAST(0 AS DOUBLE) FROM utv
  UNION
  SELECT e.dst, min(f.dist + e.weight) FROM far f JOIN {edges} e ON e.src = f.id LEFT JOIN recurring.far r ON r.id = e.dst
  WHERE r.dist IS NULL OR f.dist + e.weight < r.dist GROUP BY e.dst)"""


SSSP = _with(UT, _distances("ut"), recursive=True) + "SELECT id, dist FROM far"
SSSP_UNDIRECTED = _with(UT, _distances("uu"), recursive=True) + "SELECT id, dist FROM far"


@query("sssp_dijkstra", SSSP_UNDIRECTED)
def sssp_dijkstra(spark, sf_dir):
    g = friends(spark, sf_dir)
    return sssp.dijkstra(Graph.of(cut(g.edges)), bfs.first_vertex(g))


@query("sssp_bellman_ford", SSSP)
def sssp_bellman_ford(spark, sf_dir):
    g = Graph.of(cut(derive.user_steps(spark, sf_dir)))
    return sssp.bellman_ford(g, bfs.first_vertex(g))


@query("sssp_dial", SSSP)
def sssp_dial(spark, sf_dir):
    g = Graph.of(cut(derive.user_steps(spark, sf_dir)))
    return sssp.dial(g, bfs.first_vertex(g))


@query("sssp_delta", SSSP_UNDIRECTED)
def sssp_delta(spark, sf_dir):
    g = Graph.of(cut(friends(spark, sf_dir).edges))
    return sssp.delta_stepping(g, bfs.first_vertex(g))


def _passes(name: str, edges: str) -> str:
    """Distances with the pass of their last change, in as many passes as vertices."""
    return f"""{name}(id, dist, pass) USING KEY (id) AS (
  SELECT min(id), CAST(0 AS DOUBLE), 0 FROM utv
  UNION
  SELECT e.dst, min(p.dist + e.weight), max(p.pass) + 1 FROM {name} p JOIN {edges} e ON e.src = p.id LEFT JOIN recurring.{name} r ON r.id = e.dst
  WHERE p.pass < (SELECT count(*) FROM utv) AND (r.dist IS NULL OR p.dist + e.weight < r.dist) GROUP BY e.dst)"""


BACK = "bad AS (SELECT src, dst, weight FROM ut UNION ALL SELECT dst, src, -weight - 1 FROM ut WHERE src = (SELECT min(id) FROM utv))"
STILL = "(SELECT max(pass) FROM {}) >= (SELECT count(*) FROM utv)"


@query("negative_cycle", _with(UT, BACK, _passes("with_it", "bad"), _passes("without_it", "ut"), recursive=True) + f"SELECT {STILL.format('with_it')} AS with_back_edge, {STILL.format('without_it')} AS without")
def negative_cycle(spark, sf_dir):
    """The step graph has no negative weight; back edges a little lighter than
    the root's steps close negative cycles."""
    g = Graph.of(cut(derive.user_steps(spark, sf_dir)))
    root = bfs.first_vertex(g)
    back = g.edges.where(F.col("src") == root).select(F.col("dst").alias("src"), F.col("src").alias("dst"), (-F.col("weight") - 1).alias("weight"))
    bad = sssp.has_negative_cycle(Graph.of(cut(g.edges.unionByName(back))), root)
    return spark.range(1).select(F.lit(bad).alias("with_back_edge"), F.lit(sssp.has_negative_cycle(g, root)).alias("without"))


PAIRS = "r AS (SELECT src AS a, dst AS b FROM ut UNION SELECT r.a, e.dst FROM r JOIN ut e ON e.src = r.b), scc AS (SELECT v.id, least(v.id, coalesce(min(f.b), v.id)) AS scc FROM utv v LEFT JOIN (SELECT x.a, x.b FROM r x JOIN r y ON x.a = y.b AND x.b = y.a) f ON f.a = v.id GROUP BY v.id)"


@query("scc_labels", _with(UT, PAIRS, recursive=True) + "SELECT id, scc FROM scc")
def scc_labels(spark, sf_dir):
    return scc.labels(steps(spark, sf_dir))


@query("scc_count", _with(UT, PAIRS, recursive=True) + "SELECT count(DISTINCT scc) AS n_scc FROM scc")
def scc_count(spark, sf_dir):
    return scc.count(steps(spark, sf_dir))


COMPONENTS = "w AS (SELECT id, id AS c FROM ccv UNION SELECT e.dst, w.c FROM w JOIN cc e ON e.src = w.id WHERE w.c < e.dst)"


@query("components", _with(CC, COMPONENTS, recursive=True) + "SELECT id, min(c) AS component FROM w GROUP BY id")
def components_(spark, sf_dir):
    return components.components(cc(spark, sf_dir).edges)


KRUSKAL = """he AS (SELECT src, dst, weight, row_number() OVER (ORDER BY weight, src, dst) AS rn FROM uu WHERE src < dst),
vn AS (SELECT id, row_number() OVER (ORDER BY id) AS p FROM utv),
ep AS (SELECT he.rn, a.p AS x, b.p AS y FROM he JOIN vn a ON a.id = he.src JOIN vn b ON b.id = he.dst),
m AS (
  SELECT CAST(0 AS BIGINT) AS i, (SELECT list(p ORDER BY p) FROM vn) AS ls, CAST([] AS BIGINT[]) AS took
  UNION ALL
  SELECT m.i + 1,
         CASE WHEN m.ls[ep.x] = m.ls[ep.y] THEN m.ls ELSE list_transform(m.ls, lambda v: CASE WHEN v = m.ls[ep.y] THEN m.ls[ep.x] ELSE v END) END,
         CASE WHEN m.ls[ep.x] = m.ls[ep.y] THEN m.took ELSE list_append(m.took, ep.rn) END
  FROM m JOIN ep ON ep.rn = m.i + 1),
mst AS (SELECT src, dst, weight FROM he WHERE list_contains((SELECT took FROM m ORDER BY i DESC LIMIT 1), rn))"""


@query("mst_edges", _with(UT, KRUSKAL, recursive=True) + "SELECT src, dst, weight FROM mst")
def mst_edges(spark, sf_dir):
    return mst.forest(friends(spark, sf_dir))


@query("mst_cost", _with(UT, KRUSKAL, recursive=True) + "SELECT sum(weight) AS cost FROM mst")
def mst_cost(spark, sf_dir):
    return mst.cost(mst.forest(friends(spark, sf_dir)))


# --- validators ----------------------------------------------------------------

# Each validator judges a right result and one with a planted fault.


def _judged(found: DataFrame, planted: DataFrame) -> DataFrame:
    of = lambda df, name: df.select(F.lit(name).alias("input"), "valid")
    return of(found, "found").unionByName(of(planted, "planted"))


def _inputs(columns: str, table_: str, planted: str) -> str:
    return f"inputs AS (SELECT 'found' AS input, {columns} FROM {table_} UNION ALL SELECT 'planted', {planted} FROM {table_})"


PLAIN = """SELECT c.input, bool_and(c.dist >= 0 AND CASE WHEN c.pred = c.id THEN c.id = (SELECT min(id) FROM ccv) ELSE coalesce(p.dist = c.dist - 1, false) END) AS valid
FROM inputs c LEFT JOIN inputs p ON p.input = c.input AND p.id = c.pred WHERE c.dist IS NOT NULL GROUP BY c.input"""
LATE = "id, pred, dist + CASE WHEN id = (SELECT max(id) FROM tree) THEN 1 ELSE 0 END"


@query("validate_bfs", _with(CC, LEVELS, TREE, _inputs("id, pred, dist", "tree", LATE), recursive=True) + PLAIN)
def validate_bfs(spark, sf_dir):
    """Planted: the last vertex is one level too deep."""
    g = Graph.of(cut(cc(spark, sf_dir).edges))
    root = bfs.first_vertex(g)
    tree = cut(bfs.tree(g, root, symmetric=True))
    last = tree.agg(F.max("id").alias("last"))
    late = tree.join(F.broadcast(last)).select("id", "pred", (F.col("dist") + (F.col("id") == F.col("last")).cast("int")).alias("dist"))
    return _judged(validate.bfs(tree, root), validate.bfs(late, root))


FAR = "(SELECT max(struct_pack(d := dist, i := id)).i FROM tree)"
LOST = f"id, CASE WHEN id <> {FAR} THEN pred END, CASE WHEN id <> {FAR} THEN dist END"
STRICT = f"""plain AS ({PLAIN}),
broken AS (
  SELECT t.input FROM inputs t WHERE t.pred <> t.id AND NOT EXISTS (SELECT 1 FROM cc e WHERE e.src = t.pred AND e.dst = t.id)
  UNION ALL SELECT a.input FROM cc e JOIN inputs a ON a.id = e.src JOIN inputs b ON b.id = e.dst AND b.input = a.input WHERE a.dist IS NOT NULL AND (b.dist IS NULL OR b.dist > a.dist + 1))
SELECT input, valid AND input NOT IN (SELECT input FROM broken) AS valid FROM plain"""


@query("validate_bfs_strict", _with(CC, LEVELS, TREE, _inputs("id, pred, dist", "tree", LOST), STRICT, recursive=True).rstrip())
def validate_bfs_strict(spark, sf_dir):
    """Planted: the last vertex of the last level is left out, which only the
    strict validator sees."""
    g = Graph.of(cut(cc(spark, sf_dir).edges))
    root = bfs.first_vertex(g)
    tree = cut(bfs.tree(g, root, symmetric=True))
    far = tree.where("dist is not null").agg(F.max(F.struct("dist", "id")).alias("m")).select(F.col("m.id").alias("far"))
    stays = F.col("id") != F.col("far")
    lost = cut(tree.join(F.broadcast(far)).select("id", F.when(stays, F.col("pred")).alias("pred"), F.when(stays, F.col("dist")).alias("dist")))
    return _judged(validate.bfs_strict(g, tree, root), validate.bfs_strict(g, lost, root))


SAME = "id, CASE WHEN id = (SELECT max(id) FROM spv) THEN (SELECT c.colour FROM colours c WHERE c.id = (SELECT min(dst) FROM sp WHERE src = (SELECT max(id) FROM spv))) ELSE colour END"


@query("validate_colouring", _with(SP, _greedy("sp", "spv"), _inputs("id, colour", "colours", SAME), recursive=True) + "SELECT a.input, bool_and(a.colour <> b.colour) AS valid FROM sp e JOIN inputs a ON a.id = e.src JOIN inputs b ON b.id = e.dst AND b.input = a.input GROUP BY a.input")
def validate_colouring(spark, sf_dir):
    """Planted: the last vertex has the colour of its first neighbour."""
    g = derive.supplier_part(spark, sf_dir).held()
    colours = cut(colouring.colour(g))
    last = g.edges.agg(F.max(F.struct("src", (-F.col("dst")).alias("first"))).alias("m")).select(F.col("m.src").alias("last"), (-F.col("m.first")).alias("first"))
    other = colours.join(F.broadcast(last), F.col("id") == F.col("first")).select("last", F.col("colour").alias("same"))
    bad = colours.join(F.broadcast(other)).select("id", F.when(F.col("id") == F.col("last"), F.col("same")).otherwise(F.col("colour")).alias("colour"))
    return _judged(validate.colouring(g, colours), validate.colouring(g, bad))


MOVED = "id, CASE WHEN id = (SELECT max(id) FROM rr) THEN 0 ELSE node END, CASE WHEN id = (SELECT max(id) FROM rr) THEN 0 ELSE local END"
BACK_AGAIN = """back AS (
  SELECT DISTINCT a.input, c.id AS src, d.id AS dst
  FROM cc e JOIN inputs a ON a.id = e.src JOIN inputs b ON b.id = e.dst AND b.input = a.input
  JOIN inputs c ON c.input = a.input AND c.node = a.node AND c.local = a.local
  JOIN inputs d ON d.input = a.input AND d.node = b.node AND d.local = b.local)"""


@query("validate_partitioning", _with(CC, RR, _inputs("id, node, local", "rr", MOVED), BACK_AGAIN) + "SELECT i.input, NOT EXISTS (SELECT src, dst FROM back WHERE back.input = i.input EXCEPT SELECT src, dst FROM cc) AND NOT EXISTS (SELECT src, dst FROM cc EXCEPT SELECT src, dst FROM back WHERE back.input = i.input) AS valid FROM (SELECT DISTINCT input FROM inputs) i")
def validate_partitioning(spark, sf_dir):
    """Planted: the last vertex is placed where the first one is."""
    g = Graph.of(cut(cc(spark, sf_dir).edges))
    placed = cut(placement.round_robin(g, P))
    last = placed.agg(F.max("id").alias("last"))
    at = lambda c: F.when(F.col("id") == F.col("last"), F.lit(0)).otherwise(F.col(c)).cast(placed.schema[c].dataType).alias(c)
    moved = cut(placed.join(F.broadcast(last)).select("id", at("node"), at("local")))
    return _judged(validate.partitioning(g, placed), validate.partitioning(g, moved))


SHORT = """inputs AS (SELECT 'found' AS input, src, dst, weight FROM mst UNION ALL SELECT 'planted', src, dst, weight FROM mst WHERE (weight, src, dst) <> (SELECT (weight, src, dst) FROM mst ORDER BY weight DESC, src DESC, dst DESC LIMIT 1)),
ends AS (SELECT input, src AS id FROM inputs UNION SELECT input, dst FROM inputs)"""


@query("validate_mst", _with(UT, KRUSKAL, SHORT, recursive=True) + "SELECT i.input, sum(i.weight) = (SELECT sum(weight) FROM mst) AND bool_and(EXISTS (SELECT 1 FROM uu WHERE uu.src = i.src AND uu.dst = i.dst)) AND (SELECT count(*) FROM ends WHERE ends.input = i.input) = (SELECT count(*) FROM utv) AS valid FROM inputs i GROUP BY i.input")
def validate_mst(spark, sf_dir):
    """Planted: the heaviest edge is left out."""
    g = Graph.of(cut(friends(spark, sf_dir).edges))
    tree = cut(mst.forest(g))
    total = mst.cost(tree).first().cost
    heavy = tree.agg(F.max(F.struct("weight", "src", "dst")).alias("h"))
    short = cut(tree.join(F.broadcast(heavy)).where(F.struct("weight", "src", "dst") != F.col("h")).select("src", "dst", "weight"))
    return _judged(validate.spanning_tree(g, tree, total), validate.spanning_tree(g, short, total))


# --- sources and sinks ---------------------------------------------------------


@query("parse_int_rows", "SELECT o_orderkey AS a, -o_custkey AS b, CAST(2 AS INTEGER) AS n FROM orders")
def parse_int_rows(spark, sf_dir):
    from weft.plans.tables import table

    path = scratch(spark, "int-rows")
    table(spark, sf_dir, "orders").select(F.concat(F.lit("k="), "o_orderkey", F.lit(" ;; "), -F.col("o_custkey"), F.lit(",")).alias("value")).write.text(path)
    rows = textgraph.read_int_rows(spark, path)
    return rows.select(F.col("numbers")[0].alias("a"), F.col("numbers")[1].alias("b"), F.size("numbers").alias("n"))


def _written(spark: SparkSession, sf_dir: str, test_formats: bool = False) -> tuple[Graph, str]:
    g = Graph.of(cut(cc(spark, sf_dir).edges))
    prefix = scratch(spark, "graph")
    textgraph.write_graph(g, prefix, test_formats)
    return g, prefix


@query("adjl_scan", _with(CC) + "SELECT CAST(row_number() OVER (ORDER BY id) - 1 AS BIGINT) AS pos, id, ns AS neighbours, (SELECT count(*) FROM ccv) AS n_vertices, (SELECT count(*) FROM cc) AS n_edges FROM (SELECT src AS id, string_agg(CAST(dst AS VARCHAR), ' ' ORDER BY dst) AS ns FROM cc GROUP BY src)")
def adjl_scan(spark, sf_dir):
    head, body = textgraph.read_adjacency(spark, _written(spark, sf_dir)[1] + ".adjl")
    return body.join(F.broadcast(head)).select("pos", "id", F.array_join(F.col("neighbours").cast("array<string>"), " ").alias("neighbours"), "n_vertices", "n_edges")


@query("elt_scan", _with(CC) + "SELECT src, dst FROM cc")
def elt_scan(spark, sf_dir):
    return textgraph.read_edges(spark, _written(spark, sf_dir)[1] + ".elt", "\t")


@query("el_scan", _with(CC) + "SELECT src, dst FROM cc")
def el_scan(spark, sf_dir):
    return textgraph.read_edges(spark, _written(spark, sf_dir, True)[1] + ".el", ",")


@query("vl_scan", _with(CC) + "SELECT id FROM ccv")
def vl_scan(spark, sf_dir):
    return textgraph.read_vertices(spark, _written(spark, sf_dir, True)[1] + ".vl")


@query("adjl_render", _with(CC) + "SELECT CAST(0 AS BIGINT) AS pos, CAST(count(*) AS VARCHAR) AS line FROM ccv UNION ALL SELECT 1, CAST(count(*) AS VARCHAR) FROM cc UNION ALL SELECT row_number() OVER (ORDER BY id) + 1, CAST(id AS VARCHAR) || ' ' || ns FROM (SELECT src AS id, string_agg(CAST(dst AS VARCHAR), ' ' ORDER BY dst) AS ns FROM cc GROUP BY src)")
def adjl_render(spark, sf_dir):
    return textgraph.adjacency_lines(cc(spark, sf_dir))


@query("vl_render", _with(CC) + "SELECT string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS line FROM ccv")
def vl_render(spark, sf_dir):
    return textgraph.vertex_line(cc(spark, sf_dir).vertices)


@query("el_render", _with(CC) + "SELECT CAST(src AS VARCHAR) || ',' || CAST(dst AS VARCHAR) AS line FROM cc")
def el_render(spark, sf_dir):
    return textgraph.edge_lines(cc(spark, sf_dir).edges.where("src < dst").select("src", "dst"), ",")


BOTH = "SELECT s AS src, d AS dst FROM h UNION SELECT d, s FROM h"


@query("gen_path", "WITH h AS (SELECT unnest(range(0, 49)) AS s, unnest(range(1, 50)) AS d) " + BOTH)
def gen_path(spark, sf_dir):
    return generate.path(spark, 50)


@query("gen_star", "WITH h AS (SELECT CAST(0 AS BIGINT) AS s, unnest(range(1, 51)) AS d) " + BOTH)
def gen_star(spark, sf_dir):
    return generate.star(spark, 50)


@query("gen_complete", "SELECT a AS src, b AS dst FROM (SELECT unnest(range(0, 50)) AS a) CROSS JOIN (SELECT unnest(range(0, 50)) AS b) WHERE a <> b")
def gen_complete(spark, sf_dir):
    return generate.complete(spark, 50)


@query("gen_ladder", "WITH i AS (SELECT unnest(range(0, 20)) AS i), h AS (SELECT i AS s, (i + 1) % 20 AS d FROM i UNION ALL SELECT i + 20, (i + 1) % 20 + 20 FROM i UNION ALL SELECT i, i + 20 FROM i) " + BOTH)
def gen_ladder(spark, sf_dir):
    return generate.ladder(spark, 20)


def _draw(*parts: str) -> str:
    """The generators' 40-bit draw for some numbers."""
    return "CAST('0x' || substr(md5(" + " || '/' || ".join(f"CAST({p} AS VARCHAR)" for p in parts) + "), 1, 10) AS BIGINT)"


N, E = 2_000, 10
DRAWN = f"""d AS (SELECT s, j, s + 1 + {_draw("876", "s", "j")} % ({N - 1} - s) AS t FROM (SELECT unnest(range(0, {N - 1})) AS s) CROSS JOIN (SELECT unnest(range(0, {3 * E // 2})) AS j)),
r AS (
  -- How many draws each vertex takes, from vertex 0 on: 1.5 for each edge that lower ones have not drawn to it.
  SELECT CAST(0 AS BIGINT) AS v, list_transform(range(0, {N}), lambda x: CAST([] AS BIGINT[])) AS back, CAST([] AS BIGINT[]) AS takes
  UNION ALL
  SELECT v + 1,
         CASE WHEN n = 0 THEN back ELSE list_transform(back, lambda b, i: CASE WHEN list_contains(ts[:n], i - 1) THEN list_append(b, v) ELSE b END) END,
         list_append(takes, n)
  FROM (SELECT r.v, r.back, r.takes, o.ts, greatest(0, ({E} - len(r.back[r.v + 1])) * 3 // 2) AS n FROM r JOIN (SELECT s, list(t ORDER BY j) AS ts FROM d GROUP BY s) o ON o.s = r.v)),
h AS (SELECT DISTINCT s, t AS d FROM d WHERE j < (SELECT takes FROM r ORDER BY v DESC LIMIT 1)[s + 1])"""


@query("gen_random", _with(DRAWN, recursive=True) + BOTH)
def gen_random(spark, sf_dir):
    return generate.random(spark, N, E, seed=876)


def _descent(levels: int, edges: int) -> str:
    bit = lambda who: " + ".join(f"{1 << (levels - 1 - i)} * CAST({who.replace('u', f'u{i}')} AS BIGINT)" for i in range(levels))
    draws = ", ".join(f"{_draw('876', 'id', str(i))} % 100 AS u{i}" for i in range(levels))
    return f"q AS (SELECT id, {draws} FROM (SELECT unnest(range(0, {edges})) AS id)), e AS (SELECT {bit('(u >= 76)')} AS a, {bit('((u >= 57 AND u < 76) OR u >= 95)')} AS b FROM q), h AS (SELECT DISTINCT a AS s, b AS d FROM e WHERE a <> b)"


@query("gen_rmat", _with(_descent(13, 80_000)) + BOTH)
def gen_rmat(spark, sf_dir):
    return generate.power_law(spark, 13, 80_000, seed=876)


M, NP = 6, 800
SLOTS = f"""slots AS (
  SELECT v, j, {M} + {_draw("876", "'vertex'", "v", "j")} % greatest(v - {M}, 1) AS w, {_draw("876", "'edge'", "v", "j")} % {M} AS l, {_draw("876", "'near'", "v", "j")} % {M} AS c,
         j > 0 AND v > {M} AND {_draw("876", "'kind'", "v", "j")} % 1000000 < 500000 AS triangle, {_draw("876", "'end'", "v", "j")} % 2 = 0 AS whole
  FROM (SELECT unnest(range({M}, {NP})) AS v) CROSS JOIN (SELECT unnest(range(0, {M})) AS j)),
found(v, j, t) USING KEY (v, j) AS (
  SELECT v, j, CASE WHEN v = {M} THEN j ELSE w END FROM slots WHERE v = {M} OR (NOT triangle AND whole)
  UNION
  -- The slot before tells where a triangle is closed; the first vertices have no lower neighbours.
  SELECT s.v, s.j, CASE WHEN s.triangle AND b.t < {M} AND s.whole THEN s.w ELSE o.t END
  FROM slots s
  LEFT JOIN recurring.found b ON s.triangle AND b.v = s.v AND b.j = s.j - 1
  LEFT JOIN recurring.found o ON o.v = CASE WHEN s.triangle AND b.t >= {M} THEN b.t ELSE s.w END AND o.j = CASE WHEN s.triangle AND b.t >= {M} THEN s.c ELSE s.l END
  WHERE (SELECT count(*) FROM found) > 0 AND (NOT s.triangle OR b.t IS NOT NULL) AND (o.t IS NOT NULL OR (s.triangle AND b.t < {M} AND s.whole))
    AND NOT EXISTS (SELECT 1 FROM recurring.found f WHERE f.v = s.v AND f.j = s.j)),
h AS (SELECT DISTINCT v AS s, t AS d FROM found)"""


@query("gen_powerlaw", _with(SLOTS, recursive=True) + BOTH)
def gen_powerlaw(spark, sf_dir):
    return generate.power_law_cluster(spark, NP, M, 0.5, seed=876)


@query("gen_gnp", f"WITH h AS (SELECT a AS s, b AS d FROM (SELECT unnest(range(0, 60)) AS a) CROSS JOIN (SELECT unnest(range(0, 60)) AS b) WHERE a <> b AND {_draw('876', 'a', 'b')} % 1000000 < 250000) SELECT s AS src, d AS dst FROM h")
def gen_gnp(spark, sf_dir):
    return generate.gnp(spark, 60, 0.25, seed=876, directed=True)


@query("superstep_min", _with(CC) + "SELECT v.id, least(v.id, coalesce(min(e.src), v.id)) AS value, count(e.src) AS n_messages FROM ccv v LEFT JOIN cc e ON e.dst = v.id GROUP BY v.id")
def superstep_min(spark, sf_dir):
    """One step of the vertex program that spreads the smallest id."""
    g = cc(spark, sf_dir)
    state = g.vertices.select("id", F.col("id").alias("value"))
    return superstep(state, g.edges, {"got": F.col("value")}, {"low": F.min("got"), "n": F.count("*")}, {"value": F.least("value", F.coalesce("low", "value")), "n_messages": F.coalesce("n", F.lit(0))})


@query("load_graph", _with(CC) + "SELECT src, dst FROM cc")
def load_graph(spark, sf_dir):
    return textgraph.load_graph(spark, _written(spark, sf_dir)[1] + ".elt", 4).edges


@query("solution_slice", "SELECT CAST(i AS INTEGER) AS i, value FROM (SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS i, c_custkey % 7 AS value FROM customer) WHERE i >= 10 AND i < 60")
def solution_slice(spark, sf_dir):
    """A range of a colouring solution's line."""
    from weft.plans.tables import table

    path = scratch(spark, "solution")
    line = table(spark, sf_dir, "customer").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey"))), lambda c: (c["c_custkey"] % 7).cast("string")), " ").alias("value"))
    line.write.text(path)
    return textgraph.read_solution(spark, path, 10, 60)


@query("global_ids", _with(CC, RR) + "SELECT node, local, id FROM rr WHERE local < 5")
def global_ids(spark, sf_dir):
    asked = spark.range(P * 5).select((F.col("id") % P).alias("node"), F.floor(F.col("id") / P).alias("local"))
    return placement.global_ids(cc(spark, sf_dir), P, asked)


@query("rr2d_owners", _with(SP, CUT) + "SELECT id, master, string_agg(CAST(node AS VARCHAR), ',' ORDER BY node) AS nodes FROM (SELECT DISTINCT src AS id, master, node FROM vc UNION SELECT id, CAST(node AS INTEGER), CAST(node AS INTEGER) FROM spr) GROUP BY id, master")
def rr2d_owners(spark, sf_dir):
    found = placement.co_owners(derive.supplier_part(spark, sf_dir), P, return_self=True)
    return found.withColumn("nodes", F.array_join(F.col("nodes").cast("array<string>"), ","))


LOG = """lines AS (
  SELECT event_id, CASE WHEN event_id % 7 = 0 THEN '' ELSE CAST(user_id % 4 AS VARCHAR) || ': ' END AS node_part,
         ['TL', 'TG', 'MF', 'XX'][event_id % 4 + 1] AS t, event_type FROM events),
log AS (
  SELECT event_id, t, event_type, CASE WHEN node_part = '' THEN '_' ELSE node_part[1:1] END AS node,
         CASE WHEN t = 'MF' THEN (event_id + 1) || '/' || (event_id * 3 + 7) ELSE CAST(event_id * 1000003 AS VARCHAR) END AS v,
         node_part || 'run [P:' || t || ':' || event_type || ':' AS start FROM lines)"""


@query("log_scan", _with(LOG) + "SELECT start || v || '] done' AS value FROM log")
def log_scan(spark, sf_dir):
    path = scratch(spark, "log")
    derive.probe_lines(spark, sf_dir).select("value").write.text(path)
    return spark.read.schema(textgraph.LINES).text(path)


@query("log_split", _with(LOG) + "SELECT node, start || v || '] done' AS value FROM log")
def log_split(spark, sf_dir):
    path = scratch(spark, "log-split")
    logs.write_split(derive.probe_lines(spark, sf_dir).select("value"), path)
    return spark.read.schema("value string, node string").text(path).select("node", "value")


@query("log_probes", _with(LOG) + "SELECT node, CASE t WHEN 'TL' THEN 'Local times' WHEN 'TG' THEN 'Global times' WHEN 'MF' THEN 'Memory utilization' ELSE 'Miscellanous' END AS heading, event_type AS name, v AS value, CASE WHEN t IN ('TL', 'TG') THEN CAST(event_id * 1000003 AS DOUBLE) / 1e9 WHEN t = 'MF' THEN CAST(event_id * 3 + 7 AS DOUBLE) / (event_id + 1) END AS number FROM log")
def log_probes(spark, sf_dir):
    return logs.probes(derive.probe_lines(spark, sf_dir).select("value")).drop("measurement")


@query("log_report", _with(LOG) + """, p AS (SELECT node, CASE t WHEN 'TL' THEN 'Local times' WHEN 'TG' THEN 'Global times' WHEN 'MF' THEN 'Memory utilization' ELSE 'Miscellanous' END AS heading, t, event_id FROM log)
SELECT heading, node, count(*) AS n_probes, sum(CASE WHEN t IN ('TL', 'TG') THEN CAST(event_id AS HUGEINT) * 1000003 END)::DOUBLE AS total_ns FROM p GROUP BY heading, node""")
def log_report(spark, sf_dir):
    """Probes by heading and node."""
    return logs.report(derive.probe_lines(spark, sf_dir).select("value"))
