import pytest
from graphs import complete, frame, greedy, levels, shortest
from pyspark.sql import functions as F
from test_algorithms import pairs, random_pairs

from weft.operators import bfs, colouring, components, mst, scc, sssp, traversal
from weft.operators.model import Graph, symmetrise
from weft.plans import lineage, superstep
from weft.plans.ordinal import with_last, with_next, with_ordinal
from weft.sources import generate, textgraph


def test_one_task_only_where_the_caller_allows_it(spark):
    """The kernels of ``local_edges`` give what the rounds give."""
    edges = random_pairs(11, 30, 45)
    root = edges[0][0]
    weighted = [(a, b, (a * 7 + b) % 5) for a, b in edges]
    g, w = Graph.of(frame(spark, edges)), Graph.of(frame(spark, weighted))
    assert pairs(bfs.reach(g, root, local_edges=1000), "id", "dist") == levels(edges, root)
    assert pairs(sssp.dial(w, root, local_edges=1000), "id", "dist") == shortest(weighted, root)
    assert pairs(sssp.bellman_ford(w, root, local_edges=1000), "id", "dist") == shortest(weighted, root)
    assert pairs(components.components(g.edges, local_edges=1000), "id", "component") == pairs(components.components(g.edges), "id", "component")
    assert pairs(scc.labels(g, local_edges=1000), "id", "scc") == pairs(scc.labels(g), "id", "scc")
    tree = lambda **how: sorted(map(tuple, mst.forest(Graph.of(symmetrise(w.edges)), **how).collect()))
    assert tree(local_edges=1000) == tree()


def rounds_of(monkeypatch, run):
    """The filters on open vertices that the rounds of a run took."""
    seen = []
    plain = sssp._relaxed
    monkeypatch.setattr(sssp, "_relaxed", lambda state, edges, taken, *rest, **more: seen.append(str(taken)) or plain(state, edges, taken, *rest, **more))
    result = pairs(run(), "id", "dist")
    monkeypatch.setattr(sssp, "_relaxed", plain)
    return result, seen


def test_bucket_rounds_run(spark, monkeypatch):
    """Dial takes one distance a round; delta-stepping relaxes light edges in
    a bucket until it stays, then heavy ones."""
    edges = [(0, 1, 1), (0, 2, 4), (1, 2, 1), (2, 3, 3), (1, 4, 7), (3, 4, 1), (4, 0, 1)]
    g, want = Graph.of(frame(spark, edges)), shortest(edges, 0)
    got, taken = rounds_of(monkeypatch, lambda: sssp.dial(g, 0))
    assert got == want and len(taken) == len(set(want.values()))
    got, taken = rounds_of(monkeypatch, lambda: sssp.delta_stepping(g, 0, 2.0))
    assert got == want and any("due" in t for t in taken) and any("open" in t and "due" not in t for t in taken)


def test_colouring_by_many_ranges(spark, monkeypatch):
    edges = random_pairs(13, 60, 150) + [(0, i) for i in range(1, 60)] + [(i, 59) for i in range(59)]
    edges = sorted(set(edges) | {(b, a) for a, b in edges})
    for limit in (None, 25):
        assert pairs(colouring.colour(Graph.of(frame(spark, edges)), limit), "id", "colour") == greedy(range(60), edges)


def test_visit_order_over_levels(spark):
    edges = random_pairs(17, 40, 60)
    near = {}
    for a, b in edges:
        near.setdefault(a, []).append(b)
    root, want, seen = edges[0][0], [], {edges[0][0]}
    queue = [root]
    for v in queue:
        for w in sorted(near.get(v, [])):
            if w not in seen:
                seen.add(w)
                queue.append(w)
                want.append((len(want), v, w))
    assert sorted(map(tuple, bfs.visit_edges(Graph.of(frame(spark, edges)), root).collect())) == want


def test_sequential_walks_refuse_large_graphs(spark, monkeypatch):
    monkeypatch.setattr(superstep, "SEQUENTIAL_EDGES", 5)
    with pytest.raises(superstep.TooLarge):
        traversal.edges(Graph.of(frame(spark, complete(4))), 0)


def test_ordinals_of_sparse_keys(spark):
    rows = spark.range(500).select(F.xxhash64("id").alias("key"), "id")
    keys = sorted(r.key for r in rows.collect())
    assert {r.key: r.k for r in with_ordinal(rows, "key").collect()} == {k: i for i, k in enumerate(keys)}
    got = {r.key: r.n for r in with_next(rows, "key", "key", "n").collect()}
    assert got == dict(zip(keys, [*keys[1:], None]))
    some = rows.withColumn("v", F.when(F.col("id") % 7 == 0, F.col("key").cast("string")))
    marks = {r.key: r.v for r in some.collect()}
    seen = None
    found = {r.key: r["last"] for r in with_last(some, ["key"], "v", "last").collect()}
    for k in keys:
        seen = marks[k] or seen
        assert found[k] == seen
    assert with_ordinal(rows.limit(0), "key").count() == 0


def files(spark):
    from pathlib import Path
    from urllib.parse import urlparse

    return {str(p) for p in Path(urlparse(lineage.checkpoint_dir(spark)).path).rglob("*") if p.is_file()}


def test_rounds_leave_only_their_result(spark):
    edges = random_pairs(19, 30, 40)
    weighted = Graph.of(frame(spark, [(a, b, 1 + a % 3) for a, b in edges]))
    g = Graph.of(frame(spark, edges))
    for run in (lambda: components.components(g.edges), lambda: bfs.reach(g, edges[0][0]), lambda: scc.labels(g), lambda: mst.forest(weighted), lambda: sssp.dial(weighted, edges[0][0]), lambda: colouring.colour(g)):
        before = files(spark)
        out = run()
        left = {f.split("/")[-2] for f in files(spark) - before}
        assert len(left) == 1 and out.count() > 0, left
    with pytest.raises(sssp.NegativeCycle):
        before = files(spark)
        sssp.bellman_ford(Graph.of(frame(spark, [(0, 1, 1), (1, 0, -2)])), 0)
    assert files(spark) == before


def test_a_cluster_must_name_its_checkpoint_folder():
    class Unset:
        conf = {}

        class sparkContext:  # noqa: N801
            master, applicationId = "spark://host:7077", "no-such-application"
            _jsc = type("J", (), {"sc": staticmethod(lambda: type("S", (), {"getCheckpointDir": staticmethod(lambda: type("O", (), {"isEmpty": staticmethod(lambda: True)}))}))})
            getConf = staticmethod(dict)  # noqa: N815

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        lineage.checkpoint_dir(Unset)


def test_random_graph_draws_less_where_lower_vertices_drew(spark):
    n, e = 120, 4
    draws = {}
    for r in spark.range(n - 1).select(F.col("id").alias("s"), F.explode(F.sequence(F.lit(0), F.lit(5))).alias("j")).select("s", "j", generate.draw(876, "s", "j").alias("u")).collect():
        draws[r.s, r.j] = r.s + 1 + r.u % (n - 1 - r.s)
    back, want = {}, set()
    for s in range(n - 1):
        for j in range(max(0, (e - len(back.get(s, ()))) * 3 // 2)):
            back.setdefault(draws[s, j], set()).add(s)
            want |= {(s, draws[s, j]), (draws[s, j], s)}
    assert {(r.src, r.dst) for r in generate.random(spark, n, e, 876).collect()} == want


def test_solution_ranges(spark, tmp_path):
    (tmp_path / "s").write_text("5 6 7\n")
    got = textgraph.read_solution(spark, str(tmp_path / "s"), 1, 3).collect()
    assert [(r.i, r.value) for r in got] == [(1, 6), (2, 7)]
    with pytest.raises(Exception, match="no value 3"):
        textgraph.read_solution(spark, str(tmp_path / "s"), 1, 4).collect()


def test_component_rounds_read_each_edge_once(spark, monkeypatch):
    """A union of a table with itself would read it by twice the tasks."""
    plans = []

    def counted(df, **more):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return lineage.counted(df, **more)

    monkeypatch.setattr(components, "counted", counted)
    edges = frame(spark, [*random_pairs(5, 40, 30), (77, 77)]).union(spark.sql("select 5L, cast(null as long)"))
    got = pairs(components.components(edges), "id", "component")
    assert got == pairs(components.components(edges, local_edges=1000), "id", "component")
    assert got[77] == 77 and not any("Union" in p for p in plans[1:])
