import random

import numpy as np

from weft.llm import minhash
from weft.llm.minhash import near_duplicates, sub_keys


def brute(docs, n, percent):
    sets = []
    for _, t in docs:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    parent = {d: d for d, _ in docs}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (d, _) in enumerate(docs):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(d), find(docs[j][0])
                parent[max(a, b)] = min(a, b)
    return sorted((d, len(s), find(d), find(d) == d) for (d, _), s in zip(docs, sets, strict=True))


def result(frame, n=3, percent=85):
    return sorted(tuple(r) for r in near_duplicates(frame, n, percent).collect())


def fixture(seed):
    rng = random.Random(seed)
    docs = []
    for group in range(25):
        base = [f"g{group}w{rng.randrange(400)}" for _ in range(rng.choice([4, 30, 80, 200]))]
        for _ in range(rng.choice([1, 2, 5, 25])):
            words = list(base)
            for _ in range(rng.randrange(0, max(2, len(base) // 25))):
                words[rng.randrange(len(words))] = f"x{rng.randrange(9999)}"
            docs.append(" ".join(words))
    rng.shuffle(docs)
    return [(3 * i + 1, t) for i, t in enumerate(docs)]


def test_equals_brute_force(spark):
    docs = fixture(1) + [(9000, None), (9001, ""), (9002, " \n "), (9003, "One two"), (9004, "one\ttwo "), (9005, "w " * 50000)]
    frame = spark.createDataFrame([(d, t, "s", 1) for d, t in docs], "doc_id long, text string, rep string, n int")
    assert result(frame) == brute(docs, 3, 85)


def test_large_groups_are_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK_MEMBERS", 4)
    docs = fixture(2)
    assert result(spark.createDataFrame(docs, "doc_id long, text string")) == brute(docs, 3, 85)


def test_repeated_ids_and_null_ids(spark):
    rows = [(5, "a b c d"), (5, "e f g h"), (2, "e f g h"), (7, "a b c d"), (None, "a b c d"), (7, "a b c d")]
    got = result(spark.createDataFrame([r for r in rows if r[0] is not None], "doc_id long, text string"))
    assert {(d, c) for d, _, c, _ in got} == {(5, 2), (2, 2), (7, 2)} and len(got) == 5
    full = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()
    assert [(r.component_id, r.kept) for r in full if r.doc_id is None] == [(None, False)]


def test_pairs_at_a_lower_threshold_meet_as_often():
    chance = lambda percent: 1 - (1 - (1 - (percent / 100) ** minhash.K) ** minhash.sub_key_count(percent)) ** 2
    assert [minhash.sub_key_count(p) for p in (85, 80)] == [16, 23]
    assert all(chance(p) <= minhash.MISS for p in range(60, 101))
    # At 0.8, with 16 sub-keys one pair in 2,300 failed to meet; the keys follow the percent.
    assert sub_keys([np.arange(9, dtype=np.uint64)], minhash.sub_key_count(80)).shape == (1, 46)


def test_stored_sub_keys_follow_the_percent(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(minhash, "signatures", lambda docs, n, m, f=minhash.signatures: seen.append(m) or f(docs, n, m))
    frame = spark.createDataFrame(fixture(3)[:40], "doc_id long, text string")
    assert result(frame, 5, 80) == brute(fixture(3)[:40], 5, 80) and result(frame) == brute(fixture(3)[:40], 3, 85)
    assert seen == [23, 16]


def test_empty_table(spark):
    assert result(spark.createDataFrame([], "doc_id long, text string")) == []


def test_hot_classes_and_broadcast_limits_change_no_result(spark, monkeypatch):
    """Copies over the hot count, too many hot classes, and no broadcast at all."""
    docs = [(i, f"a text that very many pages hold copy {i % 2} of two") for i in range(60)]
    docs += [(100 + i, t) for i, t in fixture(4)[:60]] + [(900 + i, "") for i in range(20)] + [(950, None)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    want = brute(docs, 3, 85)
    monkeypatch.setattr(minhash, "HOT_COPIES", 4)
    monkeypatch.setattr(minhash, "HOT_CLASSES", 1)
    assert result(frame) == want
    monkeypatch.setattr(minhash, "BLOCK_MEMBERS", 4)
    monkeypatch.setattr(minhash, "BROADCAST_ROWS", 0)
    assert result(frame) == want


def test_deduplicate_keeps_clashing_columns(spark):
    rows = [(1, "a b c d", 1, "x", 2), (2, "a b c d", 3, None, 4), (3, None, 5, "y", 6), (3, "z z z", 7, "q", 8)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, _id int, _hash string, _row int")
    got = minhash.deduplicate(frame, 3, 85)
    assert got.schema == frame.schema and sorted(r.doc_id for r in got.collect()) == [1, 3]
    assert minhash.deduplicate(frame.limit(0), 3, 85).count() == 0
