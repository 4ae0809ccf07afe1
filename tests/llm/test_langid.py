import random
import zlib

import numpy as np

from weft.llm import langid
from weft.llm.langid import UNKNOWN, fit, histograms, predictions
from weft.plans.tables import table

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = table(spark, SF, "documents")
    got = predictions(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in got)


def test_odd_rows(spark):
    rows = [(i, f"the word and {i} of", "en") for i in range(40)] + [(100 + i, f"der und die {i} von", "de") for i in range(40)]
    rows += [(200 + i, f"le mot et la {i} des", "fr") for i in range(40)]
    odd = [(900, None, None), (901, "", "en"), (902, "12 !! ½", None), (903, "日本", None), (None, "the of and", "en"), (904, "the and " * 20000, None)]
    frame = spark.createDataFrame([(*r, "x") for r in rows + odd], "doc_id long, text string, lang string, lang_pred string")
    got = {r.doc_id: r for r in predictions(frame).collect()}
    assert len(got) == len(rows + odd)
    assert [got[i].lang_pred for i in (900, 901, 902)] == [UNKNOWN] * 3 and got[900].score == 0
    assert got[903].lang_pred in ("en", "de", "fr") and got[None].lang_pred == got[904].lang_pred == "en"


def test_no_labels_and_no_rows(spark):
    frame = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert [r.lang_pred for r in predictions(frame).collect()] == [UNKNOWN]
    assert predictions(frame.limit(0)).count() == 0


def test_families_come_first():
    rng = random.Random(1)
    words = {"en": "the of and with", "de": "der und die mit", "fr": "le et la avec", "es": "el y la con", "xx": "qq zz ww jj"}
    texts, labels = [], []
    for lang, w in words.items():
        for _ in range(30):
            texts.append(" ".join(rng.choice(w.split()) for _ in range(30)))
            labels.append(lang)
    model = fit(histograms(texts), labels)
    assert model.families == ["germanic", "romance", "xx"] and len(model.pairs) == 2
    names, scores = model.predict(texts)
    assert names == labels and min(scores) > 0.5
    assert np.allclose((histograms(["abcd"]) ** 2).sum(), 1)


def brute_vector(text):
    """Square roots of the relative frequencies of hashed byte trigrams, by hand."""
    words = "".join(c if not c.isascii() or c.isalpha() else " " for c in text.lower()).split()
    raw = (" " + " ".join(words) + " ").encode() if words else b"  "[:1]
    out = np.zeros(4096)
    for a, b, c in zip(raw, raw[1:], raw[2:]):
        h = ((a * 0x9E3779B1 & 0xFFFFFFFF) ^ (b * 0x85EBCA77 & 0xFFFFFFFF) ^ (c * 0xC2B2AE3D & 0xFFFFFFFF)) * 0x27D4EB2F & 0xFFFFFFFF
        out[h >> 20] += 1
    return np.sqrt(out / max(1, out.sum()))


def brute_predict(model, text):
    """Family by one-versus-rest, language by votes inside it, by hand."""
    if not any(c.isalpha() for c in text):
        return UNKNOWN
    margin = [float(w.astype(np.float64) @ brute_vector(text)) + b for w, b in zip(model.weights, model.bias)]
    family = max(range(len(model.families)), key=lambda f: (margin[f], -f)) if len(model.families) > 1 else 0
    own = model.languages[family]
    votes, total = [0] * len(own), [0.0] * len(own)
    for (f, a, b), m in zip(model.pairs, margin[len(model.families) :]):
        if f == family:
            votes[a if m >= 0 else b] += 1
            total[a] += m
            total[b] -= m
    return own[max(range(len(own)), key=lambda k: (votes[k], total[k], -k))]


def test_query_equals_brute_force(spark):
    """Every row of the query against features and votes taken by hand."""
    rng = random.Random(12)
    words = {"en": "the of and with from", "de": "der und die mit nicht", "nl": "het een van niet met", "fr": "le et la avec des", "es": "el y la con por"}
    rows = [(i, " ".join(rng.choice(words[lang].split()) + rng.choice(["", "x", "é", "9"]) for _ in range(rng.randrange(1, 30))), lang) for i, lang in enumerate(list(words) * 40)]
    rows += [(900, "mixed the der le el het ÄÖ 日本", None), (901, " 12 ", "en"), (902, None, "en"), (903, "ẞ İ", None), (5, rows[5][1], "en")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(frame, ~langid.held_out())
    got = sorted((r.doc_id, r.lang_pred) for r in predictions(frame).collect())
    assert got == sorted((d, brute_predict(model, t or "")) for d, t, _ in rows)
    assert len(model.pairs) == 4 and {p for _, p in got} == {*words, UNKNOWN}


def test_machines_are_at_the_optimum():
    """Long gradient descent from the machine's weights gains next to nothing."""
    rng = np.random.default_rng(3)
    x = np.abs(rng.normal(size=(120, 30))).astype(np.float32)
    y = np.where(x[:, 0] + 0.3 * rng.normal(size=120) > 0.8, 1.0, -1.0)
    w, b = langid.fit_svm(x, y, c=1.0, epochs=400)
    each = np.where(y > 0, len(y) / (2 * (y > 0).sum()), len(y) / (2 * (y < 0).sum()))
    v, wide = np.append(w, b).astype(np.float64), np.column_stack([x, np.ones(120)]).astype(np.float64)
    loss = lambda v: 0.5 * v @ v + (each * np.maximum(0, 1 - y * (wide @ v)) ** 2).sum()
    at, first = v.copy(), loss(v)
    for _ in range(20_000):
        at -= 1e-4 * (at - 2 * (each * np.maximum(0, 1 - y * (wide @ at)) * y) @ wide)
    assert loss(at) > 0.999 * first
