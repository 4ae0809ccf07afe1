import random

import pytest
from graphs import DISCONNECTED, NEGATIVE_CYCLE, NEGATIVE_EDGES, WEIGHTED, both, complete, frame, greedy, levels, shortest

from pyspark.sql import functions as F

from weft.operators import bfs, colouring, components, mst, scc, sssp, traversal, validate
from weft.operators.model import Graph, symmetrise

#: Both ways of running: one task, and rounds.
WAYS = [None, 0]


def random_pairs(seed, n, m):
    rng = random.Random(seed)
    return both({(a, b) for a, b in ((rng.randrange(n), rng.randrange(n)) for _ in range(m)) if a != b})


def pairs(df, *names):
    return {r[0]: r[1] if len(names) == 2 else tuple(r)[1:] for r in df.select(*names).collect()}


@pytest.mark.parametrize("way", WAYS)
def test_bfs(spark, way):
    edges = random_pairs(1, 60, 80)
    root = min(a for a, _ in edges)
    g = Graph.of(frame(spark, edges))
    want = levels(edges, root)
    for symmetric in (False, True):
        got = pairs(bfs.tree(g, root, symmetric=symmetric, local_edges=way), "id", "pred", "dist")
        assert {k: v[1] for k, v in got.items() if v[1] is not None} == want
        for v, (p, d) in got.items():
            if d:
                assert p == min(a for a, b in edges if b == v and want.get(a) == d - 1)
    result = bfs.tree(g, root, local_edges=way)
    assert validate.bfs(result, root).first().valid and validate.bfs_strict(g, result, root).first().valid


@pytest.mark.parametrize("way", WAYS)
def test_directed_reachability(spark, way):
    edges = [(0, 1), (1, 2), (2, 0), (2, 3), (4, 0), (4, 4)]
    got = pairs(bfs.visited(Graph.of(frame(spark, edges)), 0, local_edges=way), "id", "visited")
    assert got == {0: True, 1: True, 2: True, 3: True, 4: False}


def test_visit_order(spark):
    assert [(r.parent, r.child) for r in bfs.visit_edges(Graph.of(frame(spark, complete(10))), 0).orderBy("pos").collect()] == [(0, i) for i in range(1, 10)]


@pytest.mark.parametrize("way", WAYS)
def test_colouring(spark, way):
    edges = random_pairs(2, 40, 90)
    vertices = range(45)
    g = Graph.of(frame(spark, edges), spark.range(45))
    result = colouring.colour(g, local_edges=way)
    assert pairs(result, "id", "colour") == greedy(vertices, edges)
    assert validate.colouring(g, result).first().valid


@pytest.mark.parametrize("way", WAYS)
def test_colouring_of_complete_graph_with_loops_and_parallel_edges(spark, way):
    edges = complete(4) + complete(4) + [(2, 2)]
    assert pairs(colouring.colour(Graph.of(frame(spark, edges)), way), "id", "colour") == {0: 3, 1: 2, 2: 1, 3: 0}


def test_validators_reject(spark):
    g = Graph.of(frame(spark, complete(4)))
    bad = spark.createDataFrame([(0, 0, 0), (1, 0, 1), (2, 0, 2), (3, 0, 1)], "id long, pred long, dist int")
    assert not validate.bfs(bad, 0).first().valid
    fake = spark.createDataFrame([(0, 0, 0), (1, 0, 1), (2, 0, 1), (3, 3, 0)], "id long, pred long, dist int")
    assert not validate.bfs(fake, 0).first().valid
    assert not validate.colouring(g, spark.createDataFrame([(i, 1) for i in range(4)], "id long, colour int")).first().valid
    assert not validate.colouring(g, spark.createDataFrame([(0, 1), (1, 2), (2, 3)], "id long, colour int")).first().valid


@pytest.mark.parametrize("way", WAYS)
def test_shortest_paths_agree(spark, way):
    g = Graph.of(symmetrise(frame(spark, WEIGHTED)))
    want = {0: 0, 1: 3, 2: 4, 3: 5, 4: 1, 5: 4}
    for run in (sssp.dijkstra, sssp.dial, sssp.delta_stepping, sssp.bellman_ford):
        assert pairs(run(g, 0, local_edges=way), "id", "dist") == want, run
    rng = random.Random(3)
    edges = [(a, b, rng.randrange(1, 9)) for a, b in random_pairs(4, 30, 50)]
    source = edges[0][0]
    for run in (sssp.dijkstra, sssp.dial):
        assert pairs(run(Graph.of(frame(spark, edges)), source, local_edges=way), "id", "dist") == shortest(edges, source)
    assert pairs(sssp.delta_stepping(Graph.of(frame(spark, edges)), source, 4.0, way), "id", "dist") == shortest(edges, source)


@pytest.mark.parametrize("way", WAYS)
def test_negative_weights(spark, way):
    g = Graph.of(frame(spark, NEGATIVE_EDGES))
    assert pairs(sssp.bellman_ford(g, 0, way), "id", "dist") == {0: 0, 1: 1, 2: 3, 3: 0, 4: 0, 5: 2, 6: 11, 7: 0, 8: -1}
    with pytest.raises(sssp.NegativeWeight):
        sssp.dijkstra(g, 0)
    bad = Graph.of(frame(spark, NEGATIVE_CYCLE))
    with pytest.raises(sssp.NegativeCycle):
        sssp.bellman_ford(bad, 0, way)
    assert not sssp.has_negative_cycle(bad, 3, way)


def test_unreached_vertices_are_left_out(spark):
    g = Graph.of(symmetrise(frame(spark, DISCONNECTED)))
    assert pairs(sssp.dijkstra(g, 0), "id", "dist") == {0: 0, 1: 1, 2: 3}


@pytest.mark.parametrize("way", WAYS)
def test_spanning_trees(spark, way):
    g = Graph.of(symmetrise(frame(spark, WEIGHTED)))
    tree = mst.spanning_tree(g, way)
    assert {(r.src, r.dst) for r in tree.collect()} == {(0, 4), (3, 5), (1, 4), (2, 5), (1, 5)}
    assert mst.cost(tree).first().cost == 9
    assert validate.spanning_tree(g, tree, 9).first().valid
    assert not validate.spanning_tree(g, tree, 8).first().valid
    assert mst.cost(mst.spanning_tree(Graph.of(frame(spark, [(a, b, 2) for a, b in complete(10)])), way)).first().cost == 18
    with pytest.raises(mst.NotConnected):
        mst.spanning_tree(Graph.of(symmetrise(frame(spark, DISCONNECTED))), way)


@pytest.mark.parametrize("way", WAYS)
def test_strong_components(spark, way):
    cliques = [(a + 10 * i, b + 10 * i) for i in range(3) for a, b in complete(4)]
    for edges, count in ((cliques, 3), ([(0, 1), (0, 2), (2, 1)], 3), ([(0, 1), (1, 2), (2, 1), (2, 3)], 3)):
        assert scc.count(Graph.of(frame(spark, edges)), way).first().n_scc == count
    assert pairs(scc.labels(Graph.of(frame(spark, [(5, 1), (1, 9), (9, 5), (9, 7), (0, 5)])), way), "id", "scc") == {5: 1, 1: 1, 9: 1, 7: 7, 0: 0}


@pytest.mark.parametrize("way", WAYS)
def test_components(spark, way):
    edges = [(i, i + 1) for i in range(1, 40)] + [(50, 60), (60, 70), (80, 80), (None, 3)]
    got = pairs(components.components(frame(spark, edges), local_edges=way), "id", "component")
    assert got == {i: 1 for i in range(1, 41)} | {50: 50, 60: 50, 70: 50, 80: 80}
    assert components.components(frame(spark, edges).limit(0)).count() == 0


def test_depth_first(spark):
    walk = lambda e: [(r.parent, r.child) for r in traversal.edges(Graph.of(frame(spark, e)), 0).orderBy("pos").collect()]
    chain = [(i, i + 1) for i in range(9)]
    assert walk(complete(10)) == chain and walk(both(chain)) == chain
    assert walk(both([(0, i) for i in range(1, 11)])) == [(0, i) for i in range(1, 11)]
    post = traversal.postorder(Graph.of(frame(spark, both(chain))), 0).orderBy("pos").collect()
    assert [r.id for r in post] == list(range(9, -1, -1))
    some = traversal.postorder(Graph.of(frame(spark, both(chain))), 0, keep=F.col("id") < 5).collect()
    assert len(some) == 5


def test_partition_count_does_not_matter(spark):
    edges = random_pairs(7, 50, 90)
    seen = set()
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("1", "3", "8"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            g = Graph.of(frame(spark, edges))
            seen.add((tuple(sorted(pairs(colouring.colour(g, 20), "id", "colour").items())), tuple(sorted(pairs(bfs.tree(g), "id", "pred").items()))))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert len(seen) == 1
