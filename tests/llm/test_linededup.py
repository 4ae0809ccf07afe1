import random
from collections import Counter

from weft.llm.linededup import deduplicate, report


def brute(rows, ratio=0.1, least=10):
    docs, seen = Counter(r[1] for r in rows), Counter()
    for _, host, text in rows:
        seen.update((host, x) for x in {x.strip(" \t\r") for x in (text or "").split("\n")} if x)
    bad = {k for k, n in seen.items() if n >= least and n > ratio * docs[k[0]]}
    out = []
    for d, host, text in rows:
        lines = text.split("\n") if text is not None else []
        kept = [x for x in lines if (host, x.strip(" \t\r")) not in bad]
        out.append((d, host, len(lines), len(lines) - len(kept), None if text is None else "\n".join(kept)))
    return out


def fixture():
    rng = random.Random(8)
    rows = []
    for i in range(200):
        host = ["a", "b", None][i % 3]
        lines = [f"line {rng.randrange(500)}" for _ in range(rng.randrange(1, 6))]
        if rng.random() < 0.3 and host == "a":
            lines.insert(rng.randrange(len(lines) + 1), " Menu\t")
        if rng.random() < 0.5 and host is None:
            lines += ["", "Menu", "Menu\r"]
        if i % 50 == 0:
            lines = ["Menu"]
        rows.append((i, host, "\n".join(lines)))
    return rows + [(900, "a", None), (901, "a", ""), (902, "a", "Menu\n\nMenu"), (903, "a", "x" * 100_000 + "\nMenu"), (904, "rare", "Menu")]


def test_equals_brute_force(spark):
    rows = fixture()
    frame = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, source string, text string, host int, n int")
    key = lambda r: r[0]
    assert sorted(map(tuple, report(frame).collect()), key=key) == sorted(brute(rows), key=key)
    cleaned = deduplicate(frame)
    assert cleaned.columns == frame.columns
    assert {r.doc_id: r.text for r in cleaned.collect()} == {r[0]: r[4] for r in brute(rows)}


def test_without_broadcast(spark, monkeypatch):
    from weft.llm import linededup

    monkeypatch.setattr(linededup, "BROADCAST_LINES", -1)
    rows = fixture()
    frame = spark.createDataFrame(rows, "doc_id long, source string, text string")
    key = lambda r: r[0]
    assert sorted(map(tuple, report(frame).collect()), key=key) == sorted(brute(rows), key=key)


def test_empty(spark):
    assert report(spark.createDataFrame([], "doc_id long, source string, text string")).count() == 0


def test_repeated_rows_count_each_as_in_sql(spark):
    import duckdb
    import pyarrow as pa

    from weft.llm.linededup import SQL

    rows = [(i, "h", f"own {i}\nMenu" if i < 4 else f"own {i}") for i in range(30)] + [(3, "h", "own 3\nMenu")] * 8 + [(None, None, None), (None, None, "x")]
    key = lambda r: tuple(map(str, r))
    got = sorted(map(tuple, report(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()), key=key)
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "source": [r[1] for r in rows], "text": [r[2] for r in rows]}))
    assert got == sorted(brute(rows), key=key) == sorted(con.execute(SQL).fetchall(), key=key)
    assert sum(r[3] for r in got) == 12
