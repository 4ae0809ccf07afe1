import pytest
from graphs import both, complete, frame

from weft import harness
from weft.harness import Arguments, Executor, Experiment, bench, parse_bench, run_experiment
from weft.operators.model import Graph
from weft.sources import textgraph


def test_a_root_is_validated_as_given(spark):
    load = lambda: Graph.of(frame(spark, both([(0, 1), (1, 2)])))
    assert Executor().execute("bfs", load, {"root": "2"})


def test_noval_takes_a_value(spark, capsys):
    load = lambda: Graph.of(frame(spark, both([(0, 1), (1, 2)])))
    for value, told in (("0", True), ("1", False)):
        assert Executor().execute("colouring", load, {"noval": value})
        assert ("Validation" in capsys.readouterr().out) == told


def test_limits_by_divisors(spark, capsys):
    load = lambda: Graph.of(frame(spark, both([(i, i + 1) for i in range(9)])))
    assert Executor().execute("colouring", load, {"nodes": "3"})
    assert "[P:MF:0_v_occup:4/6]" in capsys.readouterr().out
    for tight in ({"vdiv": "9"}, {"ediv": "12", "vdiv": "1"}):
        with pytest.raises(ValueError, match="exceeds"):
            Executor().execute("colouring", load, {"nodes": "3", **tight})


def test_bench_command_line(spark, tmp_path, capsys):
    assert parse_bench(["-g", "x.elt", "-i", "3", "-a", "Colouring", "-p", "7", "-v", "-k"]) == Arguments("colouring", 3, "x.elt", True, True, 7)
    assert parse_bench([]) == Arguments()
    for bad in (["-a", "sorting"], ["-i"], ["-x", "1"]):
        with pytest.raises(ValueError):
            parse_bench(bad)
    textgraph.write_graph(Graph.of(frame(spark, complete(5))), str(tmp_path / "g"), True)
    for end in (".elt", ".el", ".adjl"):
        assert harness.build_graph(spark, str(tmp_path / "g") + end).edges.count() == 20
    times = bench(spark, Arguments("colouring", 2, str(tmp_path / "g.elt")))
    out = capsys.readouterr().out
    assert len(times) == 2 and out.count("graph: ") == 3 and out.count("algo: ") == 2


def test_experiments(spark):
    assert set(harness.EXPERIMENTS) == {"t0", "t1", "t2", "adhoc"}
    assert run_experiment(spark, Experiment("colouring", [("random", 400, 4), ("power", 400, 3)]), 0.2)
