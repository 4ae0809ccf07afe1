"""Toxicity by a counterfactually regularised logistic classifier.

Features are the words of a text and their prefixes of ``PREFIXES`` bytes (an
insult takes endings), hashed, each at the ``LEVELS`` of how often it occurs;
at most ``FEATURES`` of those seen in at least ``LEAST_DOCS`` training texts and tied to label 1 (signed root of chi-squared
above ``LEAST_TIE``, smoothed share of label 1 at least ``LEAST_SHARE``) take part, with weights of zero or more. The loss is the
class-balanced logistic loss, a ridge, and a penalty on the change of a
labelled text's margin when an identity term in it is swapped for another term
of its group, word, prefixes and levels with it, so that a mere mention of a
group does not move the score. The
model is fitted on the driver from at most ``TRAIN_ROWS`` distinct labelled
texts of ``TRAIN_BYTES`` together, taken whole in the order of a hash of the
text; every text is scored whole.

Results for odd input: null and empty texts get the score of no feature;
labels that are null, or of unknown documents, are not learned from; with no
labels of both kinds every score is the share of label 1 (0 without labels);
a document with several labels is learned from once for each; equal texts
give equal scores; further columns are ignored. Rows with a null id are never
held out.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.llm.arrow import map_rows, plain, utf8
from weft.llm.words import ALNUM, Hashed, groups, hashed, shingles

#: Bounds: labelled texts, features, and the least texts a feature is in.
TRAIN_ROWS, FEATURES, LEAST_DOCS, PRINTS, SINGLES = 6_000, 2_048, 4, 4, 3
#: Bytes of labelled text, of which the driver gets some five times as much in hashes and counts.
TRAIN_BYTES = 32 << 20
#: Bytes of the word prefixes that count as features, and how often at least.
PREFIXES, LEVELS = (4, 5, 6, 7), (1, 2, 4)
LEAST_TIE, LEAST_SHARE = 5.0, 0.9
RIDGE, SWAP_PENALTY, STEPS, THRESHOLD = 0.1, 20.0, 800, 0.7
#: Identity terms; a term is swapped within its line.
IDENTITY = """
women men girls boys mothers fathers
woman man girl boy mother father
gay straight lesbian bisexual transgender queer
black white asian latino african arab european
muslim christian jewish hindu buddhist atheist catholic
muslims christians jews hindus buddhists atheists catholics
immigrants refugees foreigners migrants natives
american mexican chinese indian german french spanish english turkish polish
disabled deaf blind autistic elderly young
femmes hommes filles mères pères
musulmans chrétiens juifs hindous bouddhistes athées
frauen männer mädchen jungen mütter väter
muslime christen juden hindus buddhisten atheisten
mujeres hombres chicas chicos madres padres
musulmanes cristianos judíos hindúes budistas ateos
"""


def _key(word: str) -> int:
    return int(hashed([word.encode()], ALNUM).hashes[0])


def _swaps() -> dict[int, list[int]]:
    """The other terms of each identity term's lines, as word hashes."""
    out: dict[int, list[int]] = {}
    for line in IDENTITY.strip().splitlines():
        keys = [_key(w) for w in line.split()]
        for k in keys:
            out.setdefault(k, []).extend(x for x in keys if x != k)
    return out


def _term_bases() -> dict[int, np.ndarray]:
    """The word and prefix hashes of each identity term, by its word hash."""
    found = (_bases(hashed([w.encode()], ALNUM, PREFIXES))[0] for w in sorted(set(IDENTITY.split())))
    return {int(base[0]): np.unique(base[base != 0]) for base in found}


def _bases(h: Hashed) -> tuple[np.ndarray, np.ndarray]:
    """The word and prefix hashes of run-together texts, and their texts."""
    doc = np.repeat(np.arange(len(h.counts)), h.counts)
    base = np.concatenate([h.hashes, h.prefixes.T.ravel()])
    return base, np.concatenate([doc] * (1 + len(PREFIXES)))


def counted(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """The distinct word and prefix hashes of each text, and how often each
    occurs, up to 255."""
    out = []
    for t in texts:
        base, _ = _bases(hashed([t], ALNUM, PREFIXES))
        found, times = np.unique(base[base != 0], return_counts=True)
        out.append((found, np.minimum(times, 255).astype(np.uint8)))
    return out


def prints(texts: list[bytes]) -> list[list[int]]:
    """``PRINTS`` minima of each text's three-word shingles."""
    out = []
    for a, b in groups(texts):
        h = hashed(texts[a:b], ALNUM)
        for own in np.split(h.hashes, np.cumsum(h.counts)[:-1]):
            s = shingles(own, min(3, len(own))) if len(own) else np.zeros(1, np.uint64)
            odd = (2 * np.arange(PRINTS) + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            out.append([int((s * (o | np.uint64(1))).min().astype(np.int64)) for o in odd])
    return out


def thinned(marks: list[list[int]]) -> list[int]:
    """Positions that share no mark with an earlier one of them."""
    seen: set[tuple[int, int]] = set()
    kept = []
    for i, own in enumerate(marks):
        if not any((j, m) in seen for j, m in enumerate(own)):
            kept.append(i)
            seen.update(enumerate(own))
    return kept


class Model(NamedTuple):
    """For each word or prefix, by its hash, the weight that each level adds."""

    keys: np.ndarray
    weights: np.ndarray
    bias: float

    def margins(self, texts: list[bytes]) -> np.ndarray:
        out = np.full(len(texts), self.bias)
        if not len(self.keys):
            return out
        bits = np.zeros(1 << 20, bool)
        bits[(self.keys >> np.uint64(44)).astype(np.int64)] = True
        total = np.cumsum(self.weights, 1)
        for a, b in groups(texts):
            base, doc = _bases(hashed(texts[a:b], ALNUM, PREFIXES))
            at = np.flatnonzero(bits[(base >> np.uint64(44)).astype(np.int64)])
            place = np.minimum(np.searchsorted(self.keys, base[at]), len(self.keys) - 1)
            same = self.keys[place] == base[at]
            once, times = np.unique(doc[at[same]] * len(self.keys) + place[same], return_counts=True)
            level = np.searchsorted(LEVELS, times, "right") - 1
            np.add.at(out, a + once // len(self.keys), total[once % len(self.keys), level])
        return out


def fit(counts: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, marks: list[list[int]] | None = None) -> Model:
    """``counts``: each text's hashes and counts; ``labels``: 0 or 1; ``marks``: the prints by which copies are thinned. A feature must be telling
    among all texts, copies included, and tied to the label without them."""
    own = _term_bases()
    identity = np.fromiter(own, np.uint64, len(own))
    spoken = np.unique(np.concatenate(list(own.values())))
    bases, inverse, texts_with = np.unique(np.concatenate([np.zeros(0, np.uint64), *(k for k, _ in counts)]), return_inverse=True, return_counts=True)
    # What is in too few texts is no feature: most words go here, before levels are laid out.
    usable = (texts_with >= LEAST_DOCS) | np.isin(bases, identity)
    some = usable[inverse]
    inverse = (np.cumsum(usable, dtype=np.int32) - 1)[inverse[some]]
    bases = bases[usable]
    times = np.concatenate([np.zeros(0, np.uint8), *(c for _, c in counts)])[some]
    text = np.repeat(np.arange(len(counts), dtype=np.int32), [len(k) for k, _ in counts])[some]
    said = np.zeros((len(counts), len(spoken)), np.uint8)
    named = np.flatnonzero(np.isin(bases, spoken))
    some = np.isin(inverse, named)
    said[text[some], np.searchsorted(spoken, bases[inverse[some]])] = times[some]
    # A feature is a base and a level: number base * len(LEVELS) + level.
    rows = np.concatenate([text[times >= v] for v in LEVELS])
    cols = np.concatenate([inverse[times >= v] * len(LEVELS) + j for j, v in enumerate(LEVELS)])
    width = len(bases) * len(LEVELS)
    every, every_toxic = np.bincount(cols, minlength=width), np.bincount(cols, weights=labels[rows], minlength=width)
    if marks is not None:
        kept = np.array(thinned(marks), np.int64)
        number = np.full(len(counts), -1)
        number[kept] = np.arange(len(kept))
        stays = number[rows] >= 0
        rows, cols, labels = number[rows[stays]], cols[stays], labels[kept]
        said = said[kept]
    n, positive = len(labels), int(labels.sum())
    if not positive or positive == n:
        share = positive / n if n else 0.0
        return Model(np.zeros(0, np.uint64), np.zeros((0, len(LEVELS))), float(np.log((share + 1e-6) / (1 - share + 1e-6))))
    seen = np.bincount(cols, minlength=width)
    toxic = np.bincount(cols, weights=labels[rows], minlength=width)
    # Signed square root of chi-squared for presence against the label.
    rate = positive / n
    tie = (toxic - seen * rate) / np.sqrt(1e-9 + seen * rate * (1 - rate) * np.maximum(1 - seen / n, 1e-9))
    terms = np.zeros(width, bool)
    terms[np.flatnonzero(np.isin(bases, identity)) * len(LEVELS)] = True
    telling = (every_toxic + 0.6 * rate) / (every + 0.6) >= LEAST_SHARE
    strength = np.where((seen >= LEAST_DOCS) & telling, tie, 0.0)
    order = np.lexsort((np.arange(width), -strength))
    chosen = np.zeros(width, bool)
    chosen[order[:FEATURES]] = strength[order[:FEATURES]] > LEAST_TIE
    chosen |= terms
    place = np.cumsum(chosen) - 1
    features, keep = np.flatnonzero(chosen), chosen[cols]
    rows, cols = rows[keep], place[cols[keep]]

    swapped, moved = _swap_form(said, spoken, np.where(chosen, place, -1).reshape(-1, len(LEVELS)), bases)
    rows, cols, labels = _with_singles(rows, cols, labels, np.isin(bases[features // len(LEVELS)], spoken))
    n, positive = len(labels), int(labels.sum())

    size = np.where(labels > 0, 0.5 / positive, 0.5 / (n - positive)) * n
    w, bias = np.zeros(len(features)), 0.0
    first, second = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for step in range(1, STEPS + 1):
        p = 1 / (1 + np.exp(-np.clip(bias + np.bincount(rows, weights=w[cols], minlength=n), -40, 40)))
        r = size * (p - labels)
        g = np.bincount(cols, weights=r[rows], minlength=len(w)) + RIDGE * w
        g[moved] += SWAP_PENALTY * (swapped @ w[moved])
        full = np.append(g, r.sum())
        first, second = 0.9 * first + 0.1 * full, 0.999 * second + 0.001 * full * full
        move = 0.05 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-9)
        # Words are evidence for toxicity only: none that is common elsewhere may excuse an insult.
        w, bias = np.maximum(w - move[:-1], 0.0), bias - move[-1]
    own, place = np.unique(features // len(LEVELS), return_inverse=True)
    weights = np.zeros((len(own), len(LEVELS)))
    weights[place, features % len(LEVELS)] = w
    return Model(bases[own], weights, float(bias))


def _swap_form(said: np.ndarray, spoken: np.ndarray, place: np.ndarray, bases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sum of squared margin changes over all swaps as a quadratic form,
    and the features it is over. ``said``: how often each text has each base of
    ``spoken``; ``place``: the feature of each of ``bases`` and level, or -1.
    A term is swapped wherever it stands in a text, and the swaps of one term
    in one text weigh 1 together."""
    at = np.minimum(np.searchsorted(bases, spoken), len(bases) - 1)
    feature = np.where((bases[at] == spoken)[:, None], place[at], -1) if len(bases) else np.full((len(spoken), len(LEVELS)), -1)
    moved = np.unique(feature[feature >= 0])
    form, own, steps = np.zeros((len(moved), len(moved))), _term_bases(), np.array(LEVELS)
    for term, others in _swaps().items():
        texts = said[said[:, np.searchsorted(spoken, np.uint64(term))] > 0].astype(np.int64)
        times = texts[:, np.searchsorted(spoken, np.uint64(term))]
        for other in others if len(texts) else ():
            both = np.searchsorted(spoken, np.setxor1d(own[term], own[other]))
            both = both[(feature[both] >= 0).any(1)]
            sign = np.where(np.isin(spoken[both], own[other]), 1, -1)
            old = texts[:, both]
            new = np.maximum(old + sign * times[:, None], 0)
            change = (new[:, :, None] >= steps).astype(np.float64) - (old[:, :, None] >= steps)
            live = feature[both] >= 0
            change, k = change[:, live], np.searchsorted(moved, feature[both][live])
            form[np.ix_(k, k)] += change.T @ change / len(others)
    return form, moved


def _with_singles(rows: np.ndarray, cols: np.ndarray, labels: np.ndarray, barred: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Copies of the texts of label 1 that keep one feature each, never one
    that is ``barred``."""
    order = np.argsort(rows, kind="stable")
    rows, cols = rows[order], cols[order]
    rng = np.random.Generator(np.random.PCG64(11))
    more = []
    for i in np.flatnonzero(labels):
        own = cols[np.searchsorted(rows, i) : np.searchsorted(rows, i, "right")]
        own = own[~barred[own]]
        more += rng.permutation(own)[:SINGLES].tolist()
    at = len(labels) + np.arange(len(more))
    return np.concatenate([rows, at]), np.concatenate([cols, np.array(more, cols.dtype)]), np.concatenate([labels, np.ones(len(more))])


def held_out() -> Column:
    """Rows that are never learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, usable: Column, rows: int = TRAIN_ROWS) -> Model:
    """Fit on at most ``rows`` distinct labelled texts (some 10 KB each of
    hashes and counts on the driver for a text of 300 distinct words)."""
    marked = plain(labels, "doc_id", "toxic").where(usable & F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1))
    # Choose among labelled ids first, by hash, so that few texts are moved.
    total = marked.count()
    share = min(1.0, 2 * rows / max(1, total))
    few = marked.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000)).distinct()
    few = few.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(3 * rows)
    text = plain(docs, "doc_id", "text").where("text is not null")
    # At most 3 * rows ids of eight bytes: small whatever the table's size.
    pairs = text.join(F.broadcast(few), "doc_id").withColumn("h", F.xxhash64("text")).dropDuplicates(["h", "toxic"])
    picked = pairs.orderBy("h", "toxic").select("text", "toxic", "h").limit(rows)
    upto = F.sum(F.octet_length("text").cast("bigint")).over(Window.orderBy("h", "toxic"))
    picked = picked.withColumn("upto", upto).where(F.col("upto") <= TRAIN_BYTES)

    def make():
        def f(batch):
            own = utf8(batch)
            return {"h": batch.column(2), "s": [k.tobytes() + c.tobytes() for k, c in counted(own)], "toxic": batch.column(1), "m": prints(own)}

        return f

    got = sorted((r.h, r.toxic, bytes(r.s), list(r.m)) for r in map_rows(picked, ["text", "toxic", "h"], make, "h bigint, s binary, toxic int, m array<bigint>").collect())
    split = lambda s: (np.frombuffer(s, np.uint64, len(s) // 9), np.frombuffer(s, np.uint8, -1, len(s) // 9 * 8))
    return fit([split(x[2]) for x in got], np.array([x[1] for x in got], np.float64), [x[3] for x in got])


def scores(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, score, predicted`` of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(tuple(model))

    def make():
        own = Model(*shared.value)

        def f(batch):
            s = 1 / (1 + np.exp(-np.clip(own.margins(utf8(batch)), -40, 40)))
            return {"doc_id": batch.column(0), "score": s, "predicted": (s >= threshold).astype(np.int32)}

        return f

    docs = plain(docs, "doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_rows(docs, ["doc_id", "text"], make, f"doc_id {kind}, score double, predicted int")


def predictions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document."""
    model = train(docs, labels, ~held_out())
    return scores(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")
