"""The pipeline against plain Python, on a small planted table."""

import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from pyspark.sql import functions as F
from weft.llm import langid
from weft.plans.lineage import stored

WORDS = {"en": "the of and with from that this over which were", "de": "der und die mit von nicht eine auch wird sich", "fr": "le et la avec des pour dans une qui sur"}


def documents():
    rng = random.Random(9)
    rows = []

    def text(lang, n):
        own = WORDS[lang].split()
        return "\n".join(" ".join(rng.choice(own) + str(rng.randrange(300)) * (rng.random() < 0.5) for _ in range(12)) for _ in range(n))

    for i in range(160):
        lang = ["en", "de", "fr"][i % 3]
        body = text(lang, rng.randrange(1, 6))
        if i % 2:
            body = "Share this page with friends\n" + body
        rows.append((i, body, lang, "src0" if i % 4 else "src1", len(body)))
    passage = "a passage of the benchmark that nobody should ever train on please"
    rows.append((500, text("en", 2) + "\n" + passage.upper(), "en", "src1", 1))
    base = text("de", 8)
    rows += [(600 + k, base if k < 3 else base.replace(" ", "  ", k), "de", "src2", 1) for k in range(6)]
    rows += [(700, None, None, "src1", None), (701, "123 456", None, None, 7), (702, "", "en", "src1", 0)]
    return rows, [(1, passage), (2, None)]


def expected(rows, items, spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    model = langid.train(spark.createDataFrame(rows, schema), ~langid.held_out())
    names, scores = model.predict([r[1] or "" for r in rows])
    kept = [(r[0], r[1], r[3]) for r, n, s in zip(rows, names, scores, strict=True) if n != langid.UNKNOWN and s >= corpus_pipeline.LEAST_LANGUAGE_SCORE]
    from test_linededup import brute as lines

    kept = [(d, t) for d, _, _, _, t in lines([(d, s, t) for d, t, s in kept])]
    from test_minhash import brute as near

    first = {d for d, _, _, k in near(kept, corpus_pipeline.SHINGLE_WORDS, corpus_pipeline.SIMILARITY) if k}
    kept = [(d, t) for d, t in kept if d in first]
    from test_decontaminate import brute as hits

    bad = hits(kept, items)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out = {}
    for d, t in kept:
        if not bad[d][4]:
            ids = tokenizer.encode(t, add_special_tokens=False).ids
            out[d] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
    return out


@pytest.fixture()
def folder(spark, tmp_path):
    rows, items = documents()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path), rows, items


def test_run_equals_plain_python(spark, folder):
    path, rows, items = folder
    got = {r.doc_id: (r.n_tokens, r.ids_sha256) for r in corpus_pipeline.run(spark, path).collect()}
    want = expected(rows, items, spark)
    assert got == want
    assert 500 not in got and not {601, 602, 700, 701} & set(got) and 600 in got and len(got) > 100


def test_stages_keep_the_columns_of_documents(spark, folder):
    path, rows, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontamination", "tokenization"]
    cleaned = dict(corpus_pipeline.STAGES)["line_dedup"](spark, docs, path)
    assert cleaned.schema == docs.schema
    assert not [r for r in cleaned.collect() if r.source == "src0" and re.search("Share this page", r.text or "")]


CLASHES = ["_lang", "_score", "lang_pred", "score", "_whole", "_host", "host", "_lines", "_id", "_hash", "_row", "row", "rep", "_where", "h", "k", "item_id"]


@pytest.mark.parametrize("empty", [False, True])
def test_stages_on_odd_tables(spark, folder, empty):
    """Clashing names, repeated rows, nulls, a very long text, no rows."""
    path, rows, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    long = "the of and with from that " * 40_000
    more = [(900, long, "en", None, 3), (901, long + "end", "en", "src1", 3), (None, "the of and with no id", "en", None, None), (None, "the of and with no id", "en", None, None), (3, rows[3][1], "en", "src0", 1), (3, "the other text of and with this id", "en", "src0", 1)]
    docs = docs.unionByName(spark.createDataFrame(more, docs.schema))
    for i, c in enumerate(CLASHES):
        docs = docs.withColumn(c, F.lit(i) if i % 2 else F.lit("x"))
    docs = docs.limit(0) if empty else docs
    left = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stored(stage(spark, left, path), f"test-{name}")
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema], name
        before, after = left.count(), out.count()
        assert (after == 0) if empty else (0 < after <= before), name
        left = out
    last = corpus_pipeline.STAGES[-1][1](spark, left, path).collect()
    assert len(last) == left.count()
    if not empty:
        ids = [r.doc_id for r in last]
        assert ids.count(3) == 1 and ids.count(None) == 2 and (900 in ids) and 901 not in ids and 500 not in ids
        assert {r["_id"] for r in left.collect()} == {"x"} and {r["lang_pred"] for r in left.collect()} == {"x"}
