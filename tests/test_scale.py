"""What a task holds does not grow with the tables."""

import tracemalloc

import numpy as np
import pandas as pd
import pytest
from graphs import frame, greedy
from pyspark.sql import functions as F

from weft.operators import colouring, placement, traversal
from weft.operators.model import Graph
from weft.plans import tables
from weft.sources import derive

ITEMS = [(o, (o * 7 + i * 3) % 40, (o + i) % 9) for o in range(60) for i in range(5)] + [(1, 7, 1), (1, 7, 1), (2, None, 3), (3, 4, None)]


@pytest.fixture
def few(spark, tmp_path, monkeypatch):
    """A folder of small tables, tasks of 40 rows and a session with one task a shuffle."""
    spark.createDataFrame(ITEMS, "l_orderkey long, l_partkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(i, i * i % 17) for i in range(200)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    monkeypatch.setattr(tables, "SHUFFLE_ROWS", 40)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield str(tmp_path)
    spark.conf.set("spark.sql.shuffle.partitions", old)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_derived_edges_are_dealt_to_tasks_by_their_number(spark, few):
    sp = {(None if s is None else 2 * s, None if p is None else 2 * p + 1) for _, p, s in ITEMS}
    pp = {(a, b) for o, a, _ in ITEMS for q, b, _ in ITEMS if o == q and None not in (a, b) and a != b}
    cust = [i * i % 17 for i in range(200)]
    cc = {p for a, b in zip(cust, cust[1:]) if a != b for p in ((a, b), (b, a))}
    for make, want in ((derive.supplier_part, sp | {(b, a) for a, b in sp}), (derive.co_purchase, pp), (derive.hand_off, cc)):
        g = make(spark, few)
        assert rows(g.edges) == sorted(want, key=str)
        assert rows(g.half) == sorted({(a, b) for a, b in want if None not in (a, b) and a < b}, key=str)
        assert rows(g.vertices) == sorted({(a,) for a, _ in want}, key=str)
        assert g.edges.rdd.getNumPartitions() > 4 and g.rows >= len(want)
        sizes = [r.n for r in g.edges.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
        assert max(sizes) < 200


def test_depth_first_order_holds_an_edge_in_eight_bytes():
    draw = np.random.default_rng(5)
    n, v = 400_000, 3_000
    edges = np.unique(draw.integers(0, v, (n, 2)), axis=0)
    batches = [pd.DataFrame({"s": part[:, 0], "d": part[:, 1]}) for part in np.array_split(draw.permutation(edges), 50)]
    tracemalloc.start()
    parents, children, post = traversal._walk(iter(batches), len(edges), v, 0)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 12 * len(edges) + 100 * v
    near = [edges[edges[:, 0] == i, 1].tolist() for i in range(v)]
    seen, tree, done, stack = {0}, [], [], [(0, iter(near[0]))]
    while stack:
        at, rest = stack[-1]
        w = next((x for x in rest if x not in seen), None)
        if w is None:
            done.append(stack.pop()[0])
        else:
            seen.add(w)
            tree.append((at, w))
            stack.append((w, iter(near[w])))
    assert list(zip(parents, children)) == tree and list(post) == done


def test_depth_first_order_of_sparse_ids_and_of_a_lone_start(spark):
    g = Graph.of(frame(spark, [(-5, 10**15), (10**15, 7), (-5, 7), (7, -5), (7, 7)]))
    assert rows(traversal.edges(g)) == [(0, -5, 7), (1, -5, 10**15)]
    assert [r.id for r in traversal.postorder(g).orderBy("pos").collect()] == [7, 10**15, -5]
    assert rows(traversal.edges(g, 99)) == [] and rows(traversal.postorder(g, 99)) == [(0, 99)]


def test_cut_edges_are_met_in_as_many_tasks_as_their_number_needs(spark, few):
    """One hub among 150 vertices; its edges are no single task's."""
    pairs = [(0, i) for i in range(1, 150)] + [(i, i + 1) for i in range(1, 100)]
    g = Graph.undirected(frame(spark, pairs), len(pairs))
    both = sorted({*pairs, *[(b, a) for a, b in pairs]})
    want, pos = [], {}
    for a, b in both:
        at = pos[a] = pos.get(a, -1) + 1
        want.append((a, b, at, a % 3, (a + at) % 3))
    for graph in (g, Graph.of(frame(spark, both + both[:50]))):
        found = placement.vertex_cut(graph, 3)
        assert sorted(map(tuple, found.collect())) == want
        sizes = [r.n for r in found.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
        assert len(sizes) > 4 and max(sizes) < 149


def test_ranges_reach_their_task_as_plain_numbers(spark, monkeypatch):
    """Nested values reach Python one by one; nulls would make large ids floats."""
    seen = []
    plain = colouring.one_task
    monkeypatch.setattr(colouring, "one_task", lambda df, *rest: seen.append(df.dtypes) or plain(df, *rest))
    big = 2**60
    edges = [(big + a, big + b) for a in range(8) for b in range(a + 1, 8) if (a + b) % 3]
    got = {r.id: r.colour for r in colouring.colour(Graph.of(frame(spark, edges))).collect()}
    assert got == greedy({v for e in edges for v in e}, edges)
    assert seen and all(kind in ("bigint", "int") for d in seen for _, kind in d)
