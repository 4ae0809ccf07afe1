import zlib

import numpy as np
from pyspark.sql import functions as F

from weft.llm.hilbert import assign, hilbert_index, report, write_clustered
from weft.plans.tables import table

SF = "/root/testdata/sf0.01"


def test_curve_visits_every_cell_by_unit_steps():
    for n, bits in ((2, 3), (3, 2), (4, 2)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * n, indexing="ij"), -1).reshape(-1, n)
        h = hilbert_index(grid, bits)
        assert sorted(h) == list(range(len(grid)))
        path = grid[np.argsort(h)]
        assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def check(rows, shards):
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
    sizes = [len(slots.get(s, [])) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1 and set(slots) <= set(range(shards))
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_rows_law(spark):
    docs = table(spark, SF, "documents")
    got = report(docs).collect()
    text = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    assert len(got) == len(text)
    check(got, 40)
    for r in got:
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(text[r.doc_id]) + 16, zlib.crc32(text[r.doc_id]), "rows", None)
    by_rank = sorted(got, key=lambda r: (r.shard, r.slot))
    assert [r.curve_index for r in by_rank] == sorted(r.curve_index for r in got)


def test_pruning(spark):
    """Shards span few sources: a plain order by id would span them all."""
    docs = table(spark, SF, "documents")
    found = assign(docs, ["source", "lang"], 40).join(docs.select("doc_id", "source"), "doc_id")
    spans = [len({r.source for r in found.where(f"shard = {s}").collect()}) for s in (0, 20, 39)]
    assert max(spans) <= 8


def test_odd_rows(spark):
    rows = [(1, None, None, None), (1, None, None, None), (None, "", "en", "s"), (2, "é" * 9999, "de", None)]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, source string, shard int")
    got = report(frame).collect()
    check(got, 40)
    assert sorted(r.size for r in got) == [16, 16, 16, 20014]
    assert report(frame.limit(0)).count() == 0


def test_written_files_keep_all_rows(spark, tmp_path):
    docs = table(spark, SF, "documents")
    write_clustered(docs, str(tmp_path / "out"), ["source", "size"], 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.columns == docs.columns and back.count() == docs.count() and back.exceptAll(docs).isEmpty()


def brute_index(point, bits):
    """The place of a cell on the curve, bit by bit in Python integers: the
    cells of each halving are numbered by the Gray code of the turned cube."""
    x, n = list(point), len(point)
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        for i in range(n):
            if x[i] & q:
                x[0] ^= q - 1
            else:
                t = (x[0] ^ x[i]) & (q - 1)
                x[0], x[i] = x[0] ^ t, x[i] ^ t
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = 0
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        if x[n - 1] & q:
            turn ^= q - 1
    x = [v ^ turn for v in x]
    out = 0
    for b in range(bits - 1, -1, -1):
        for v in x:
            out = out << 1 | v >> b & 1
    return out


def test_report_equals_brute_force(spark):
    """Quantisation, curve, order, shard and slot of every row, by hand."""
    import random
    from collections import Counter

    rng = random.Random(17)
    rows = [(rng.choice([None, *range(90)]), rng.choice([None, "", "é" * rng.randrange(40), "x" * rng.randrange(400)]), rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "s3", None])) for _ in range(230)]
    frame = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, lang string, source string, h int")
    got = report(frame, shards=7)
    size = [len((t or "").encode()) + 16 for _, t, _, _ in rows]

    def names(values):
        top = sorted(sorted(Counter(v for v in values if v is not None).items(), key=lambda x: (-x[1], x[0]))[:63])
        every = sum(n for _, n in top)
        return [0 if v is None else 1 + sum(n for w, n in top if w < v) * 63 // every for v in values]

    def numbers(values, name):
        points = sorted(set(frame.select("doc_id", (F.octet_length(F.coalesce("text", F.lit(""))) + 16).alias("size")).approxQuantile(name, [(i + 1) / 64 for i in range(63)], 0.002)))
        known = sorted(v for v in values if v is not None)
        for i, p in enumerate(points):
            assert p in known
        return [0 if v is None else sum(v > p for p in points) for v in values]

    cells = list(zip(names([r[3] for r in rows]), names([r[2] for r in rows]), numbers(size, "size"), numbers([r[0] for r in rows], "doc_id")))
    index = [brute_index(c, 6) for c in cells]
    low = -(1 << 63) - 1
    order = sorted(zip(index, [low if r[0] is None else r[0] for r in rows], [zlib.crc32((r[1] or "").encode()) for r in rows], size))
    want, seen = [], [0] * 7
    for k, (h, d, crc, n) in enumerate(order):
        shard = k * 7 // len(order)
        want.append((None if d == low else d, n, crc, shard, seen[shard], h))
        seen[shard] += 1
    found = [(r.doc_id, r.size, r.text_crc32, r.shard, r.slot, r.curve_index) for r in got.collect()]
    key = lambda r: (r[3], r[4])
    assert sorted(found, key=key) == sorted(want, key=key)
    assert max(seen) - min(seen) <= 1


def test_file_statistics_prune(spark, tmp_path):
    """Filters on any dimension skip files by their footers, a hot cell too."""
    import pyarrow.parquet as pq

    rows = [(i, f"s{i % 9:02d}" if i % 3 else "s00", "en" if i % 3 == 0 else ["de", "fr"][i % 2], "x" * (i % 3 and i % 700)) for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, text string")
    files = 64
    write_clustered(docs, str(tmp_path / "out"), ["source", "lang", "size", "doc_id"], files)
    parts = sorted((tmp_path / "out").glob("*.parquet"))
    counts = [pq.read_metadata(p).num_rows for p in parts]
    assert sum(counts) == 6000 and max(counts) < 6000 // 16

    def read(column, value):
        hit = 0
        for p in parts:
            meta = pq.read_metadata(p)
            at = [meta.schema.column(i).name for i in range(meta.num_columns)].index(column)
            hit += any((s := meta.row_group(g).column(at).statistics).min <= value <= s.max for g in range(meta.num_row_groups))
        return hit / len(parts)

    shares = {c: read(c, v) for c, v in (("source", "s04"), ("doc_id", 100), ("lang", "fr"))}
    assert max(shares.values()) < 0.6, shares
