"""Language identification in two steps: family first, then its languages.

A text's features are the square roots of the relative frequencies of its
letter trigrams, hashed to ``DIMENSIONS``. One-versus-rest linear support
vector machines choose the language family; within it, one-versus-one linear
support vector machines separate the closely related languages by votes, ties
by summed margins. The machines are fitted on the driver from a bounded
sample (at most ``ROWS_PER_LANGUAGE`` distinct texts of each language and
``TRAIN_ROWS`` in all, chosen by a hash of the text); every text is scored whole, on executors.

Results for odd input: a null text, or one without a letter, is ``und`` with
score 0; a language whose family is not listed is a family of its own; with
one language in the sample every other text is of that language; with none
every text is ``und``; equal texts give equal rows; further columns are
ignored. Rows with a null id are learned from and never held out.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.llm.arrow import map_rows, plain, texts
from weft.llm.words import groups, table

#: Hashed trigram features, and training rows of each language.
DIMENSIONS, ROWS_PER_LANGUAGE = 4096, 800
#: Training rows of all languages together (16 KB each on the driver).
TRAIN_ROWS = 8_000
UNKNOWN = "und"
#: ISO 639-1 codes by language family.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is fy af lb yi",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk bg mk sr hr bs sl",
    "baltic": "lt lv",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz ky tk",
    "indo-aryan": "hi ur bn pa gu mr ne si",
    "dravidian": "ta te kn ml",
    "semitic": "ar he am mt",
    "sinitic": "zh yue",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}
_LETTER = re.compile("[A-Za-z]")
#: ASCII other than letters separates words; case is folded before.
_BY = table(bytes(b for b in range(128) if not chr(b).isalpha()))


def has_letter(text: str) -> bool:
    return bool(_LETTER.search(text)) or any(map(str.isalpha, text))


def histograms(batch: list[str]) -> np.ndarray:
    """Feature vectors of some texts, one row each."""
    out = np.zeros((len(batch), DIMENSIONS), np.float32)
    raw = [b" ".join([b"", *t.lower().encode("utf-8", "replace").translate(_BY).split(), b""]) for t in batch]
    for a, b in groups(raw):
        data = np.frombuffer(b"".join(raw[a:b]), np.uint8).astype(np.uint32)
        key = (data[:-2] * np.uint32(0x9E3779B1) ^ data[1:-1] * np.uint32(0x85EBCA77) ^ data[2:] * np.uint32(0xC2B2AE3D)) * np.uint32(0x27D4EB2F)
        place = (key >> np.uint32(32 - 12)).astype(np.int64) if len(data) > 2 else np.zeros(0, np.int64)
        at = 0
        for i in range(a, b):
            own = place[at : at + max(0, len(raw[i]) - 2)]
            if len(own):
                out[i] = np.sqrt(np.bincount(own, minlength=DIMENSIONS) / len(own))
            at += len(raw[i])
    return out


def fit_svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, epochs: int = 15, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear SVM: squared hinge, dual coordinate descent.

    ``y`` is +1 or -1; each class weighs the same in total.
    """
    weight = np.where(y > 0, len(y) / (2 * max(1, (y > 0).sum())), len(y) / (2 * max(1, (y < 0).sum())))
    slack = 1 / (2 * c * weight)
    # The bias is one more feature that is 1 everywhere; ``x`` is never copied.
    norm = np.einsum("ij,ij->i", x, x, dtype=np.float64) + 1 + slack
    w, bias, alpha = np.zeros(x.shape[1]), 0.0, np.zeros(len(x))
    rng = np.random.Generator(np.random.PCG64(seed))
    for _ in range(epochs):
        for i in rng.permutation(len(x)):
            g = y[i] * (w @ x[i] + bias) - 1 + slack[i] * alpha[i]
            new = max(alpha[i] - g / norm[i], 0.0)
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w += step * x[i]
                bias += step
                alpha[i] = new
    return w.astype(np.float32), float(bias)


class Model(NamedTuple):
    """One weight row for each machine: families first, then pairs."""

    families: list[str]
    languages: list[list[str]]
    pairs: list[tuple[int, int, int]]
    weights: np.ndarray
    bias: np.ndarray

    def predict(self, batch: list[str]) -> tuple[list[str], list[float]]:
        names, scores = [UNKNOWN] * len(batch), [0.0] * len(batch)
        at = [i for i, t in enumerate(batch) if self.families and has_letter(t)]
        if not at:
            return names, scores
        margins = histograms([batch[i] for i in at]) @ self.weights.T + self.bias
        for i, m in zip(at, margins.astype(np.float64), strict=True):
            names[i], scores[i] = self._decide(m)
        return names, scores

    def _decide(self, m: np.ndarray) -> tuple[str, float]:
        squash = lambda v: 1 / (1 + np.exp(-np.clip(4 * v, -50, 50)))
        f = int(np.argmax(m[: len(self.families)])) if len(self.families) > 1 else 0
        sure = squash(m[f]) if len(self.families) > 1 else 1.0
        own = self.languages[f]
        votes, total, least = np.zeros(len(own)), np.zeros(len(own)), np.ones(len(own))
        for j, (family, a, b) in enumerate(self.pairs):
            if family == f:
                v = m[len(self.families) + j]
                votes[a if v >= 0 else b] += 1
                total[a] += v
                total[b] -= v
                least[a], least[b] = min(least[a], squash(v)), min(least[b], squash(-v))
        best = max(range(len(own)), key=lambda k: (votes[k], total[k], -k))
        return own[best], float(sure * least[best])


def fit(vectors: np.ndarray, labels: list[str], families: dict[str, str] = FAMILY_OF) -> Model:
    names = sorted(set(labels))
    of = {n: families.get(n, n) for n in names}
    groups_ = sorted(set(of.values()))
    languages = [[n for n in names if of[n] == g] for g in groups_]
    lang = np.array(labels, object)
    family = np.array([of[n] for n in labels], object)
    weights, bias, pairs = [], [], []

    def add(x: np.ndarray, y: np.ndarray) -> None:
        w, b = fit_svm(x, y)
        weights.append(w)
        bias.append(b)

    for g in groups_:
        if len(groups_) > 1:
            add(vectors, np.where(family == g, 1.0, -1.0))
        else:
            weights.append(np.zeros(DIMENSIONS, np.float32))
            bias.append(0.0)
    for f, own in enumerate(languages):
        for a in range(len(own)):
            for b in range(a + 1, len(own)):
                two = (lang == own[a]) | (lang == own[b])
                add(vectors[two], np.where(lang[two] == own[a], 1.0, -1.0))
                pairs.append((f, a, b))
    return Model(groups_, languages, pairs, np.array(weights, np.float32).reshape(-1, DIMENSIONS), np.array(bias))


def train(docs: DataFrame, usable: Column, rows_per_language: int = ROWS_PER_LANGUAGE) -> Model:
    """Fit on at most ``rows_per_language`` distinct texts of each language.

    The driver receives at most ``TRAIN_ROWS`` feature vectors of 16 KB and
    nothing that grows with the table but the list of languages.
    """
    rows = docs.where(usable).select("text", "lang").where("text is not null and lang is not null")
    h = F.xxhash64("text")
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.approx_count_distinct(h, 0.02).alias("n")).collect()}
    if not counts:
        return fit(np.zeros((0, DIMENSIONS), np.float32), [])
    rows_per_language = min(rows_per_language, max(1, TRAIN_ROWS // len(counts)))
    share = F.create_map(*[F.lit(v) for lang, n in counts.items() for v in (lang, int(min(1.0, 1.3 * rows_per_language / max(1, n)) * 1_000_000))])
    picked = rows.withColumn("h", h).where(F.pmod("h", F.lit(1_000_000)) < share[F.col("lang")]).dropDuplicates(["h", "lang"])
    few = picked.withColumn("i", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("i") <= rows_per_language)

    def make():
        def f(batch):
            kept = [(t, lang) for t, lang in zip(texts(batch), batch.column(1).to_pylist(), strict=True) if has_letter(t)]
            return {"v": [x.tobytes() for x in histograms([t for t, _ in kept])], "lang": [lang for _, lang in kept]}

        return f

    got = sorted((r.lang, bytes(r.v)) for r in map_rows(few, ["text", "lang"], make, "v binary, lang string").collect())
    names = [lang for lang, _ in got]
    vectors = np.empty((len(got), DIMENSIONS), np.float32)
    for i in range(len(got)):
        vectors[i] = np.frombuffer(got[i][1], np.float32)
        got[i] = None  # its bytes are free from here on
    return fit(vectors, names)


def identify(docs: DataFrame, model: Model, columns: list[str], lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """``columns`` with the predicted language and its score, in columns that
    are named ``lang`` and ``score``, for every document."""
    shared = docs.sparkSession.sparkContext.broadcast(tuple(model))
    kinds = [(c, docs.schema[c].dataType.simpleString()) for c in columns]
    sent = [*columns] if "text" in columns else [*columns, "text"]
    at = sent.index("text")

    def make():
        own = Model(*shared.value)

        def f(batch):
            names, scores = own.predict([x or "" for x in batch.column(at).to_pylist()])
            return {c: batch.column(i) for i, c in enumerate(columns)} | {lang: names, score: scores}

        return f

    return map_rows(docs, [F.col(f"`{c}`") for c in sent], make, ", ".join([*(f"`{c}` {k}" for c, k in kinds), f"`{lang}` string, `{score}` double"]))


def held_out() -> Column:
    """Rows that are never learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def predictions(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every document."""
    docs = plain(docs, "doc_id", "text", "lang")
    model = train(docs, ~held_out())
    found = identify(docs, model, ["doc_id"])
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
