import math

import pytest
from graphs import both, complete, frame
from pyspark.sql import functions as F

from weft.functions.logs import probes, split_by_node, write_split
from weft.functions.scalars import mex
from weft.harness import Executor, Probe, parse_cli
from weft.operators import model, placement, validate
from weft.operators.model import Graph
from weft.plans.ordinal import with_next, with_ordinal
from weft.plans.superstep import rounds, superstep
from weft.sources import generate, textgraph


def test_mex(spark):
    rows = spark.createDataFrame([([0, 1, 3],), ([1],), ([],), ([2, 0, 1],)], "u array<int>")
    assert [r[0] for r in rows.select(mex(F.col("u"))).collect()] == [2, 0, 0, 3]


@pytest.mark.parametrize(("n", "p"), [(20, 5), (14, 3), (12, 4), (14, 5), (5, 3), (2, 5), (1, 1)])
def test_ranges_and_their_inverse(spark, n, p):
    got = [(r.start, r.end) for r in placement.ranges(spark, n, p).orderBy("part").collect()]
    assert got[0][0] == 0 and got[-1][1] == n and all(a[1] == b[0] for a, b in zip(got, got[1:], strict=False))
    assert sorted((b - a for a, b in got), reverse=True) == [b - a for a, b in got] and max(b - a for a, b in got) == math.ceil(n / p)
    for r in placement.parts_of(spark, n, p).collect():
        assert got[r.part][0] <= r.i < got[r.part][1]


def test_ordinals_cross_buckets(spark, monkeypatch):
    import weft.plans.ordinal as o

    monkeypatch.setattr(o, "BUCKET", 10)
    keys = [3, 7, 9, 10, 55, 56, 200]
    rows = spark.createDataFrame([(k, -k) for k in keys], "key long, v long")
    assert [r.k for r in with_ordinal(rows, "key").orderBy("key").collect()] == list(range(7))
    assert [r.n for r in with_next(rows, "key", "v", "n").orderBy("key").collect()] == [-7, -9, -10, -55, -56, -200, None]


def test_chunked_placement(spark):
    g = Graph.of(frame(spark, complete(4)))
    assert sorted((r.id, r.node, r.local) for r in placement.chunked(g, 2).collect()) == [(0, 0, 0), (1, 0, 1), (2, 1, 0), (3, 1, 1)]


@pytest.mark.parametrize("place", [placement.chunked, placement.round_robin])
def test_placement_keeps_the_structure(spark, place):
    g = Graph.of(frame(spark, both([(0, 5), (5, 9), (9, 2), (2, 7), (7, 0), (3, 9)])))
    assert validate.partitioning(g, place(g, 3)).first().valid
    wrong = place(g, 3).withColumn("local", F.lit(0).cast("bigint"))
    assert not validate.partitioning(g, wrong).first().valid


def test_vertex_cut(spark):
    g = Graph.of(frame(spark, complete(5)))
    cut = placement.vertex_cut(g, 3).collect()
    assert all(r.node == (r.master + r.pos) % 3 for r in cut) and len(cut) == 20
    assert placement.shadows(g, 3).agg(F.sum("n_edges")).first()[0] + placement.masters(g, 3).agg(F.sum("n_edges")).first()[0] == 20
    assert min(r.local for r in placement.shadow_ids(g, 3).collect()) == 2
    kinds = {(r.id, r.node): r.kind for r in placement.kinds(g, 3).collect()}
    assert len(kinds) == 15 and sum(k == "master" for k in kinds.values()) == 5
    with pytest.raises(ValueError):
        placement.check_limits(g, 3, divisor=100)
    placement.check_limits(g, 3)


def test_max_weight_refuses_negative(spark):
    assert model.max_weight(frame(spark, [(0, 1, 2.9), (1, 2, 1)])).first()[0] == 2
    with pytest.raises(Exception, match="negative weight"):
        model.max_weight(frame(spark, [(0, 1, -2)])).collect()


def write(tmp_path, name, text):
    path = tmp_path / name
    path.write_text(text)
    return str(path)


def test_readers(spark, tmp_path):
    rows = textgraph.read_int_rows(spark, write(tmp_path, "a.csv", "-1 -2,-3\n 6;;5 x4\n\n7 8\n"))
    assert [r.numbers for r in rows.orderBy("pos").collect()] == [[-1, -2, -3], [6, 5, 4]]
    head, body = textgraph.read_adjacency(spark, write(tmp_path, "k.adjl", "3\n4\n0 2 1 2\n1 0\n2\n"))
    assert tuple(head.first()) == (3, 4)
    assert [(r.id, r.neighbours) for r in body.orderBy("pos").collect()] == [(0, [1, 2]), (1, [0]), (2, [])]
    assert textgraph.graph_of(body).vertices.count() == 3
    assert [(r.src, r.dst) for r in textgraph.read_edges(spark, write(tmp_path, "e.elt", "# c\n1\t2\n1\t2\n"), "\t").collect()] == [(1, 2)]
    assert textgraph.load_graph(spark, write(tmp_path, "f.elt", "1\t2\n2\t1\n"), 2).edges.rdd.getNumPartitions() >= 1
    solution = textgraph.read_bfs_solution(spark, write(tmp_path, "s.bfssol", "0 1 1 1\n0 0\n0 0\n0 0\n0 0\n"), 1, 3)
    assert [tuple(r) for r in solution.orderBy("i").collect()] == [(1, 1, 0, 0), (2, 1, 0, 0)]
    assert [r.value for r in textgraph.read_solution(spark, write(tmp_path, "c.csol", "3 2 1 0\n")).orderBy("i").collect()] == [3, 2, 1, 0]
    with pytest.raises(Exception):
        textgraph.read_int_rows(spark, str(tmp_path / "none")).collect()


def test_round_trip_of_all_formats(spark, tmp_path):
    g = Graph.of(frame(spark, both([(0, 3), (3, 8), (8, 1)])))
    textgraph.write_graph(g, str(tmp_path / "g"), test_formats=True)
    want = {tuple(r) for r in g.edges.collect()}
    assert {tuple(r) for r in textgraph.graph_of(textgraph.read_adjacency(spark, str(tmp_path / "g.adjl"))[1]).edges.collect()} == want
    assert {tuple(r) for r in textgraph.read_edges(spark, str(tmp_path / "g.elt"), "\t").collect()} == want
    assert {tuple(r) for r in textgraph.read_edges(spark, str(tmp_path / "g.el"), ",").collect()} == want
    assert sorted(r.id for r in textgraph.read_vertices(spark, str(tmp_path / "g.vl")).collect()) == [0, 1, 3, 8]


def test_generators(spark):
    assert generate.complete(spark, 5).count() == 20 and generate.star(spark, 7).count() == 14 and generate.path(spark, 7).count() == 12
    assert generate.ladder(spark, 6).count() == 36
    r = {tuple(x) for x in generate.random(spark, 500, 10, 1).collect()}
    assert r == {tuple(x) for x in generate.random(spark, 500, 10, 1).collect()} != {tuple(x) for x in generate.random(spark, 500, 10, 2).collect()}
    assert all((b, a) in r and a != b and 0 <= a < 500 for a, b in r) and 6 <= len(r) / 500 <= 16
    p = generate.power_law(spark, 8, 2000, 1)
    top = p.groupBy("src").count().agg(F.max("count"), F.avg("count")).first()
    assert top[0] > 5 * top[1]


def test_logs(spark, tmp_path):
    lines = ["3: a [P:TL:load:2500000000] b [P:XX:n:v]", "[P:TG:run:1000000000]", "12: [P:MF:v_occup:4/10]", "none"]
    frame_ = spark.createDataFrame([(x,) for x in lines], "value string")
    got = {(r.node, r.measurement) for r in probes(frame_).collect()}
    assert got == {("3", "[3] load: 2500000000ns (2.50s)"), ("3", "[3] n: v"), ("_", "run: 1000000000 (1.00s)"), ("12", "[12] v_occup: 4/10 (1/2.50)")}
    assert [r.node for r in split_by_node(frame_).collect()] == ["3", "_", "12", "_"]
    write_split(frame_, str(tmp_path / "split"))
    assert {p.name for p in (tmp_path / "split").iterdir() if p.is_dir()} == {"node=3", "node=12", "node=_"}


def test_log_stream(spark, tmp_path):
    from weft.streaming.logs import follow

    (tmp_path / "in").mkdir()
    write(tmp_path / "in", "1.log", "1: [P:TL:a:1000000000]\n")
    q = follow(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.processAllAvailable()
    write(tmp_path / "in", "2.log", "2: [P:TL:b:3000000000]\n")
    q.processAllAvailable()
    q.stop()
    assert sorted(r.number for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1.0, 3.0]


def test_cli_and_harness(spark, capsys):
    assert parse_cli(["-a", "bfs", "-g", "x", "-a", "y"]) == {"a": "bfs", "g": "x"}
    for bad in (["-a"], ["a", "b"], ["-a", "-b"]):
        with pytest.raises(ValueError):
            parse_cli(bad)
    load = lambda: Graph.of(frame(spark, complete(4)))
    assert Executor().execute("repeating", load, {"ra-n": "2", "ra-name": "colouring"})
    assert Executor().execute("bfs", load, {}) and not Executor().execute("unknown", load, {})
    assert capsys.readouterr().out.count("[P:TL:Algorithm:") == 3
    with Probe("x") as p:
        pass
    assert p.ns > 0


def test_vertex_program(spark):
    edges = frame(spark, [(0, 1), (1, 2), (2, 3)])
    state = spark.createDataFrame([(i, 0 if i == 0 else None) for i in range(4)], "id long, dist int")

    def step(s, i):
        new = superstep(s, edges, {"m": F.col("dist") + 1}, {"m": F.min("m")}, {"dist": F.least("dist", "m").cast("int")})
        return new if i < 3 else None

    assert sorted(tuple(r) for r in rounds(state, step).collect()) == [(0, 0), (1, 1), (2, 2), (3, 3)]


def test_scratch_is_cleared(spark):
    from weft.plans import lineage

    kept = list(lineage._SCRATCH)
    lineage._SCRATCH.clear()
    df = lineage.stored(spark.range(3).toDF("id"), "gone")
    assert df.count() == 3 and lineage.clear_scratch(spark) == 1 and lineage.clear_scratch(spark) == 0
    with pytest.raises(Exception):
        df.select("id").collect()
    lineage._SCRATCH.extend(kept)
