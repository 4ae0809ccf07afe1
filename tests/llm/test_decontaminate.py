import hashlib
import random
import re

from weft.llm.decontaminate import decontaminate, find_passages, report

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    raw = (text or "").encode()
    return WORD.findall(bytes(b + 32 if 65 <= b <= 90 else b for b in raw))


def brute(docs, items, n=10):
    out = {}
    for d, text in docs:
        w = words(text)
        hit, who = set(), set()
        for i, t in items:
            iw = words(t)
            size = min(n, len(iw))
            grams = {tuple(iw[k : k + size]) for k in range(len(iw) - size + 1)} if size else set()
            for k in range(len(w) - size + 1 if size else 0):
                if tuple(w[k : k + size]) in grams:
                    who.add(str(i))
                    hit |= set(range(k, k + size))
        out[d] = (len(w), len(hit), len(who), hashlib.sha256(",".join(sorted(who)).encode()).hexdigest(), bool(hit))
    return out


def fixture():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(12)] + ["Été", "Ünï", "x'y"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.choice([10, 12, 30]))) for i in range(12)] + [(100, "w1 W2, w3"), (101, ""), (102, None), (103, "one"), (104, text(9))]
    docs = [(i, text(rng.randint(0, 60))) for i in range(60)]
    for i in range(60, 100):
        whole = items[rng.randrange(12)][1]
        docs.append((i, f"{text(rng.randint(0, 20))}. {whole.upper() if i % 3 == 0 else whole}! {text(3)}"))
    docs += [(200, None), (201, ""), (202, "ONE"), (203, "w1;w2\n\nw3 " * 4000), (204, " \t "), (205, "é" * 5000)]
    return docs, items


def test_report_equals_brute_force(spark):
    docs, items = fixture()
    got = report(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = brute(docs, items)
    assert len(got) == len(docs)
    for r in got:
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == want[r.doc_id], r.doc_id


def test_blocks_give_the_same_spans(spark):
    docs, items = fixture()
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame(items, "item_id long, text string")
    key = lambda r: r.doc_id
    assert sorted(find_passages(d, i).collect(), key=key) == sorted(find_passages(d, i, limit=200).collect(), key=key)


def test_empty_tables_and_clashing_columns(spark):
    d = spark.createDataFrame([(1, "a b", "x", 5)], "doc_id long, text string, item_id string, n_words int")
    none = spark.createDataFrame([], "item_id long, text string, doc_id long")
    r = report(d, none).collect()[0]
    assert (r.n_words, r.n_hit, r.contaminated) == (2, 0, False)
    assert report(d.limit(0), none).count() == 0


def test_actions(spark):
    docs, items = fixture()
    d = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, source string")
    i = spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    kept = {r.doc_id for r in decontaminate(d, i).collect()}
    assert kept == {k for k, v in want.items() if not v[4]}
    cut = {r.doc_id: r.text for r in decontaminate(d, i, action="remove").collect()}
    assert set(cut) == set(want)
    for k, t in docs:
        assert cut[k] == t if not want[k][4] else len(words(cut[k])) == want[k][0] - want[k][1]


def test_items_without_id_are_matched_as_in_sql(spark):
    import duckdb
    import pyarrow as pa

    from weft.llm.decontaminate import SQL

    one, two, three = ("passage " * 9 + w for w in ("one", "two", "three"))
    items = [(None, one), (None, two), (7, two), (8, three), (None, None)]
    docs = [(1, f"x {one} y"), (2, two), (3, f"{one} {two}"), (4, three), (5, "clean")]
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = sorted(tuple(r) for r in report(d, i).collect())
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": [r[0] for r in docs], "text": [r[1] for r in docs]}))
    con.register("benchmark", pa.table({"item_id": pa.array([r[0] for r in items], pa.int64()), "text": [r[1] for r in items]}))
    assert got == sorted(con.execute(SQL).fetchall())
    assert [r[5] for r in got] == [True, True, True, True, False]
    assert {r.doc_id for r in decontaminate(d, i).collect()} == {5}
    whole, blocks = ({r.doc_id: (r.n_words, r.spans, r.items) for r in find_passages(d, i, **limit).collect()} for limit in ({}, {"limit": 20}))
    assert whole == blocks


def test_block_size_changes_no_result(spark):
    """Overlapping items in different blocks, both actions, clashing names."""
    words_ = [f"w{i}" for i in range(1, 41)]
    items = [(1, " ".join(words_[:10])), (2, " ".join(words_[5:15])), (3, " ".join(words_[20:40])), (4, "z " * 500)]
    docs = [(1, " ".join(words_[:15]), 1, 2), (2, "\tif x:\n\t    keep  this\n" + " ".join(words_[:16]) + "  and\tthat", 3, 4), (3, "clean   as\tit is", 5, 6), (1, " ".join(words_[:15]), 7, 8), (4, "a " + "z " * 30 + "b", 9, 0), (5, None, 1, 1)]
    more, items2 = fixture()
    docs += [(i + 1000, t, 0, 0) for i, t in more]
    items += [(i + 1000, t) for i, t in items2]
    d = spark.createDataFrame(docs, "doc_id long, text string, _row int, _where int")
    i = spark.createDataFrame(items, "item_id long, text string")
    for action in ("drop", "remove"):
        whole, blocks = (decontaminate(d, i, action=action, **limit) for limit in ({}, {"limit": 200}))
        assert whole.schema == blocks.schema == d.schema
        assert sorted(map(str, whole.collect())) == sorted(map(str, blocks.collect()))
    cut = {r.doc_id: r.text for r in decontaminate(d, i, action="remove", limit=200).collect()}
    assert cut[1] == "" and cut[2] == "\tif x:\n\t    keep  this\n w16  and\tthat" and cut[3] == "clean   as\tit is" and cut[4] == "a b"
    a, b = (sorted(map(str, find_passages(d, i, **limit).collect())) for limit in ({}, {"limit": 50}))
    assert a == b


def test_long_items_are_split_whole_windows_each():
    from weft.llm.decontaminate import Windows, _pieces, scan

    text = " ".join(f"w{i % 37}" for i in range(500)).encode()
    parts = _pieces(text, 10, 60)
    grams = lambda t: {tuple(words(t.decode())[k : k + 10]) for k in range(len(words(t.decode())) - 9)}
    assert len(parts) > 20 and set().union(*map(grams, parts)) == grams(text)
    assert all(len(words(p.decode())) >= 10 for p in parts)
    assert scan([text], Windows([("a", p) for p in parts], 10))[0][1] == [(0, 500)]
