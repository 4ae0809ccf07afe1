"""Runs an algorithm over a graph: load, run, validate, with timing probes.

Three command lines: assemblies (``-a bfs -g graph.adjl``), repeated timings
(``bench -a colouring -g graph.elt -i 3``) and whole experiments (``experiment
t0``).
"""

from __future__ import annotations

import sys
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from weft.operators import bfs, colouring, placement, scc, validate
from weft.operators.model import Graph
from weft.plans.lineage import clear_scratch, cut
from weft.sources import generate, textgraph

Config = dict[str, str]


def parse_cli(args: list[str]) -> Config:
    """``-option value`` pairs; the first of repeated options holds."""
    if len(args) % 2:
        raise ValueError("options and values must come in pairs")
    out: Config = {}
    for name, value in zip(args[::2], args[1::2], strict=True):
        if not name.startswith("-") or len(name) < 2 or value.startswith("-"):
            raise ValueError(f"not an option and its value: {name} {value}")
        out.setdefault(name[1:], value)
    return out


class Probe:
    """A named wall time, printed as a log line when it stops."""

    def __init__(self, name: str, kind: str = "TL"):
        self.name, self.kind, self.ns = name, kind, 0

    def __enter__(self) -> Probe:
        self.start = time.perf_counter_ns()
        return self

    def __exit__(self, *_) -> None:
        self.ns = time.perf_counter_ns() - self.start
        print(f"[P:{self.kind}:{self.name}:{self.ns}]")


def report_fraction(name: str, used: int, limit: int) -> None:
    """A share of memory, printed as a log line."""
    print(f"[P:MF:{name}:{used}/{limit}]")


def _is_set(config: Config, name: str) -> bool:
    return config.get(name, "0").lower() not in ("0", "false", "no")


def report_occupancy(graph: Graph, config: Config) -> None:
    """Use of each of ``-nodes`` nodes against its limits, whose divisors are
    ``-vdiv`` and ``-ediv``; raises where a limit is exceeded."""
    parts = int(config["nodes"])
    vdiv, ediv = (int(config[n]) if n in config else None for n in ("vdiv", "ediv"))
    for r in placement.limits(graph, parts, vdiv, ediv).orderBy("node").collect():
        report_fraction(f"{r.node}_v_occup", r.n_vertices, r.vertex_limit)
        report_fraction(f"{r.node}_e_occup", r.n_edges, r.edge_limit)
    placement.check_limits(graph, parts, vdiv, ediv)


def _materialised(graph: Graph) -> Graph:
    """A graph in checkpoints; what its loader kept is given back."""
    out = Graph(cut(graph.vertices), cut(graph.edges))
    textgraph.release_graph(graph)
    return out


@dataclass(frozen=True)
class Assembly:
    """``run(graph, config) -> result`` and ``check(graph, result, config) -> valid``."""

    run: Callable[[Graph, Config], DataFrame]
    check: Callable[[Graph, DataFrame, Config], DataFrame] | None = None

    def execute(self, load: Callable[[], Graph], config: Config) -> bool:
        with Probe("GraphLoading"):
            graph = _materialised(load())
        if "nodes" in config:
            report_occupancy(graph, config)
        with Probe("Algorithm"):
            result = cut(self.run(graph, config))
        valid = True
        if self.check is not None and not _is_set(config, "noval"):
            with Probe("Validation"):
                valid = bool(self.check(graph, result, config).first().valid)
        return valid


def _root(graph: Graph, config: Config) -> int:
    return int(config["root"]) if "root" in config else bfs.first_vertex(graph)


ASSEMBLIES = {
    "bfs": Assembly(lambda g, c: bfs.tree(g, _root(g, c)), lambda g, r, c: validate.bfs(r, _root(g, c))),
    "colouring": Assembly(lambda g, c: colouring.colour(g), lambda g, r, c: validate.colouring(g, r)),
    "scc": Assembly(lambda g, c: scc.labels(g)),
}


class Executor:
    """Assemblies by name; ``repeating`` runs ``ra-name`` ``ra-n`` times."""

    def __init__(self, assemblies: dict[str, Assembly] | None = None):
        self.assemblies = dict(ASSEMBLIES if assemblies is None else assemblies)

    def register(self, name: str, assembly: Assembly) -> None:
        self.assemblies[name] = assembly

    def execute(self, name: str, load: Callable[[], Graph], config: Config) -> bool:
        """Whether the assembly is known and its result valid."""
        if name == "repeating":
            times = int(config.get("ra-n", "1"))
            return all(self.execute(config.get("ra-name", ""), load, config) for _ in range(times))
        if name not in self.assemblies:
            return False
        return self.assemblies[name].execute(load, config)


def _adjacency(spark: SparkSession, path: str, parts: int) -> Graph:
    return textgraph.graph_of(textgraph.read_adjacency(spark, path)[1])


#: How a graph is built, by the end of its path.
LOADERS: dict[str, Callable[[SparkSession, str, int], Graph]] = {
    ".adjl": _adjacency,
    ".el": lambda spark, path, parts: Graph.of(textgraph.read_edges(spark, path, ",")),
    ".elt": textgraph.load_graph,
}


def build_graph(spark: SparkSession, path: str, parts: int = 2) -> Graph:
    """The graph of a file, by its format; a tab separated list by default."""
    found = next((make for end, make in LOADERS.items() if path.endswith(end)), textgraph.load_graph)
    return found(spark, path, parts)


@dataclass(frozen=True)
class Arguments:
    """What ``bench`` is asked for."""

    algorithm: str = "bfs"
    iterations: int = 1
    graph: str = ""
    verbose: bool = False
    kryo: bool = False
    partitions: int = 2


def parse_bench(args: list[str]) -> Arguments:
    """``-g path -i times -a bfs|colouring -p partitions``, ``-v`` and ``-k``."""
    names = {"-g": ("graph", str), "-i": ("iterations", int), "-a": ("algorithm", str.lower), "-p": ("partitions", int)}
    found: dict = {}
    rest = list(args)
    while rest:
        name = rest.pop(0)
        if name in ("-v", "-k"):
            found["verbose" if name == "-v" else "kryo"] = True
        elif name in names and rest:
            key, kind = names[name]
            found[key] = kind(rest.pop(0))
        else:
            raise ValueError(f"unknown option {name}")
    out = Arguments(**found)
    if out.algorithm not in ("bfs", "colouring"):
        raise ValueError(f"unknown algorithm {out.algorithm}")
    return out


def print_time(name: str, ns: int) -> None:
    print(f"{name}: {ns} ({ns / 1e9})")


def bench(spark: SparkSession, a: Arguments) -> list[tuple[int, int]]:
    """Load and run so many times; the nanoseconds of both each time."""
    print(f"graph: {a.graph} algorithm: {a.algorithm} iterations: {a.iterations}")
    out = []
    for _ in range(a.iterations):
        start = time.perf_counter_ns()
        graph = _materialised(build_graph(spark, a.graph, a.partitions))
        loaded = time.perf_counter_ns()
        print_time("graph", loaded - start)
        result = bfs.visited(graph) if a.algorithm == "bfs" else colouring.colour(graph)
        result.write.format("noop").mode("overwrite").save()
        done = time.perf_counter_ns()
        print_time("algo", done - loaded)
        if a.verbose:
            result.show()
        out.append((loaded - start, done - loaded))
    return out


@dataclass(frozen=True)
class Experiment:
    """An algorithm over generated graphs: ``(kind, vertices, edges a vertex)``."""

    algorithm: str
    graphs: list[tuple[str, int, int]]
    repetitions: int = 1
    config: Config = field(default_factory=dict)


#: Graphs and repetitions of the timing experiments.
EXPERIMENTS = {
    "t0": Experiment("colouring", [("power", 100_000, 10), ("power", 200_000, 10), ("power", 300_000, 10), ("power", 400_000, 10)]),
    "t1": Experiment("colouring", [("random", 2_000_000, 40)], 3),
    "t2": Experiment("colouring", [("random", 2_000_000, 40)], 3),
    "adhoc": Experiment("colouring", [("random", 2_000_000, 40)]),
}


def run_experiment(spark: SparkSession, e: Experiment, scale: float = 1.0) -> bool:
    """Whether all runs are valid; ``scale`` shrinks the graphs."""
    good = True
    for kind, vertices, edges in e.graphs:
        n = max(16, int(vertices * scale))

        def load(kind: str = kind, n: int = n, edges: int = edges) -> Graph:
            made = generate.random(spark, n, edges, 876) if kind == "random" else generate.power_law(spark, max(4, (n - 1).bit_length()), n * edges, 876)
            return Graph.of(made)

        for _ in range(e.repetitions):
            good &= Executor().execute(e.algorithm, load, e.config)
    return good


def main(args: list[str]) -> int:
    mode = args[0] if args and not args[0].startswith("-") else ""
    builder = SparkSession.builder.appName("weft")
    if mode == "bench":
        asked = parse_bench(args[1:])
        if asked.kryo:
            builder = builder.config("spark.serializer", "org.apache.spark.serializer.KryoSerializer")
        spark = builder.getOrCreate()
        bench(spark, asked)
        good = True
    elif mode == "experiment":
        spark = builder.getOrCreate()
        config = parse_cli(args[2:])
        good = run_experiment(spark, EXPERIMENTS[args[1]], float(config.get("scale", "1")))
    else:
        config = parse_cli(args)
        spark = builder.getOrCreate()
        good = Executor().execute(config["a"].lower(), lambda: build_graph(spark, config["g"], int(config.get("p", "2"))), config)
    clear_scratch(spark)
    return 0 if good else 1


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
