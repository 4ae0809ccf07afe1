"""Benchmark decontamination by a broadcast hash set of test n-grams.

Benchmark items are cut into windows of ``n`` words (an item of fewer words is
one window); their texts are broadcast behind a check of their size, each
worker process builds the windows' hashes once, and every training window is
looked up, first in a bitmap, then in the sorted hashes; a hit counts only when
the words themselves agree. A benchmark beyond the size limit is scanned in
blocks, one at a time, over a stored copy of the documents, and the spans of
all blocks are united before anything is cut, so that the size of the blocks
changes no result.

Results for odd input: a null or empty text has no words and no hits; items
without words or without text match nothing; equal items count once for each id, and
items without id together once, with nothing in the digest; repeated documents give repeated rows; further columns of
either table are ignored by the report and kept by ``decontaminate``, whatever their names.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.arrow import fresh, map_rows, plain, prepare, utf8
from weft.llm.words import ALNUM, groups, hashed, mix, shingles
from weft.plans.lineage import stored

NGRAM = 10
#: Most bytes of benchmark text in one broadcast; a worker needs some 15 times as much.
BROADCAST_BYTES = 8 << 20
_BITS = 22


class Windows:
    """The benchmark's windows by length: sorted hashes over the items' bytes.

    A window takes some 30 bytes, a word 24 and its text; no window's words
    are copied out.
    """

    def __init__(self, items: list[tuple[str | None, bytes]], n: int):
        self.names = sorted({i for i, _ in items}, key=lambda i: (i is None, i))
        number = {name: k for k, name in enumerate(self.names)}
        h = hashed([t for _, t in items], ALNUM)
        self.benchmark = h._replace(hashes=h.hashes[:0])
        owner = np.array([number[i] for i, _ in items], np.int32)
        sizes = np.minimum(n, h.counts)
        first = np.concatenate([[0], np.cumsum(h.counts)])[:-1]
        self.tables = {size: self._table(h.hashes, size, sizes == size, first, h.counts, owner) for size in sorted(set(sizes.tolist()) - {0})}

    @staticmethod
    def _table(hashes: np.ndarray, size: int, own: np.ndarray, first: np.ndarray, counts: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, ...]:
        """Keys, where the entries of each begin, second hashes, owners and
        first words of the entries, and a bitmap of the keys."""
        times = counts[own] - size + 1
        at = np.repeat(first[own] - np.cumsum(times) + times, times) + np.arange(times.sum())
        who = np.repeat(owner[own], times)
        one, two = shingles(hashes, size)[at], shingles(mix(hashes), size)[at]
        order = np.lexsort((at, who, two, one))
        one, two, who, at = one[order], two[order], who[order], at[order]
        new = np.concatenate([[True], (one[1:] != one[:-1]) | (two[1:] != two[:-1]) | (who[1:] != who[:-1])])
        one, two, who, at = one[new], two[new], who[new], at[new]
        keys, begin = np.unique(one, return_index=True)
        bits = np.zeros(1 << _BITS, bool)
        bits[(keys >> np.uint64(64 - _BITS)).astype(np.int64)] = True
        return keys, np.append(begin, len(one)), two, who, at, bits

    def hits(self, size: int, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions whose hash is that of a window, and its key's place."""
        keys, *_, bits = self.tables[size]
        at = np.flatnonzero(bits[(found >> np.uint64(64 - _BITS)).astype(np.int64)])
        place = np.minimum(np.searchsorted(keys, found[at]), len(keys) - 1)
        same = keys[place] == found[at]
        return at[same], place[same]

    def owners(self, size: int, place: int, words: bytes) -> np.ndarray:
        """The items whose window of this key has these very words."""
        _, begin, two, who, at, _ = self.tables[size]
        a, b = begin[place], begin[place + 1]
        found = []
        while a < b:
            c = a + int(np.searchsorted(two[a:b], two[a], "right"))
            if self.benchmark.word(int(at[a]), size) == words:
                found.append(who[a:c])
            a = c
        return np.concatenate(found) if found else who[:0]


#: The windows that this worker process has built last, and from what.
_BUILT: list = [None, 0, None]


def _windows(items: list[tuple[str | None, bytes]], n: int) -> Windows:
    """One build a worker process for each broadcast."""
    if _BUILT[0] is not items or _BUILT[1] != n:
        _BUILT[:] = [None, 0, None]
        _BUILT[:] = [items, n, Windows(items, n)]
    return _BUILT[2]


def scan(texts: list[bytes], windows: Windows) -> list[tuple[int, list[tuple[int, int]], list[str | None], list[tuple[int, int]]]]:
    """For each text: words, runs of hit words, items, and the runs in bytes."""
    out = []
    for a, b in groups(texts):
        h = hashed(texts[a:b], ALNUM)
        first = np.concatenate([[0], np.cumsum(h.counts)])
        offset = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts[a:b]])])
        mark = np.zeros(len(h.hashes) + 1, np.int32)
        items: dict[int, set[int]] = {}
        for size in windows.tables:
            at, place = windows.hits(size, shingles(h.hashes, size))
            doc = np.searchsorted(first, at, "right") - 1
            for i, k, d in zip(at.tolist(), place.tolist(), doc.tolist(), strict=True):
                if i + size <= first[d + 1] and len(who := windows.owners(size, k, h.word(i, size))):
                    items.setdefault(d, set()).update(who.tolist())
                    mark[i] += 1
                    mark[i + size] -= 1
        hit = np.concatenate([[False], np.cumsum(mark[:-1]) > 0, [False]])
        for d in range(b - a):
            runs, where = [], []
            if d in items:
                # Runs end at the text's last word, though the next text's first may be hit.
                inside = np.concatenate([[False], hit[first[d] + 1 : first[d + 1] + 1], [False]])
                edge = np.flatnonzero(inside[1:] != inside[:-1])
                runs = list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))
                where = [(int(h.starts[first[d] + s] - offset[d]), int(h.ends[first[d] + e - 1] - offset[d])) for s, e in runs]
            out.append((int(h.counts[d]), runs, [windows.names[k] for k in sorted(items.get(d, ()))], where))
    return out


def _pieces(text: bytes, n: int, most: int) -> list[bytes]:
    """A text in pieces of about ``most`` bytes; each of its windows is whole
    in one of them."""
    if len(text) <= most:
        return [text]
    h = hashed([text], ALNUM)
    total = len(h.hashes) - n + 1
    step = max(1, most * len(h.hashes) // len(text))
    # Fewer words than a window, or a word beyond the size, stay in one piece.
    return [text[h.starts[i] : h.ends[min(i + step, total) + n - 2]] for i in range(0, total, step)] or [text]


def _blocks(items: DataFrame, id_column: str, n: int, limit: int) -> Iterator[list[tuple[str | None, bytes]]]:
    """The benchmark in blocks of at most ``limit`` bytes of text (or one
    piece), of which the driver holds one at a time."""

    def make():
        def f(batch):
            names, parts = [], []
            for i, text in zip(batch.column(0).to_pylist(), utf8(batch), strict=True):
                own = _pieces(text, n, max(1, limit // 4))
                names += [i] * len(own)
                parts += own
            return {"i": names, "text": parts}

        return f

    rows = items.select(F.col(f"`{id_column}`").cast("string").alias("i"), "text").where("text is not null")
    block: list[tuple[str | None, bytes]] = []
    size = 0
    for r in map_rows(rows, ["i", "text"], make, "i string, text binary").toLocalIterator():
        if block and size + len(r.text) > limit:
            yield block
            block, size = [], 0
        block.append((r.i, bytes(r.text)))
        size += len(r.text)
    yield block


_SPANS = "array<struct<first: int, last: int>>"


def _scanned(docs: DataFrame, key: str, shared, n: int, all_rows: bool = True) -> DataFrame:
    """What one broadcast block hits in ``key, text``; without ``all_rows``
    only documents with hits."""

    def make():
        windows = _windows(shared.value, n)

        def f(batch):
            found = scan(utf8(batch), windows)
            at = [i for i, x in enumerate(found) if all_rows or x[1]]
            found = [found[i] for i in at]
            return {
                key: batch.column(0).take(pa.array(at, pa.int64())),
                "n_words": [x[0] for x in found],
                "spans": [[{"first": s, "last": e} for s, e in x[1]] for x in found],
                "bytes": [[{"first": s, "last": e} for s, e in x[3]] for x in found],
                "items": [x[2] for x in found],
            }

        return f

    kind = docs.schema[key].dataType.simpleString()
    return map_rows(docs, [f"`{key}`", "text"], make, f"`{key}` {kind}, n_words bigint, spans {_SPANS}, bytes {_SPANS}, items array<string>")


def union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of half-open spans, sorted."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _unioned(found: DataFrame, key: str) -> DataFrame:
    """``found`` with the spans and items of several blocks united."""

    def make():
        def f(batch):
            names = dict(zip(batch.schema.names, batch.columns, strict=True))
            whole = lambda c: [[{"first": a, "last": b} for a, b in union([(s["first"], s["last"]) for s in own])] for own in names[c].to_pylist()]
            items = [sorted(set(own), key=lambda i: (i is None, i)) for own in names["items"].to_pylist()]
            return {key: names[key], "n_words": names["n_words"], "spans": whole("spans"), "bytes": whole("bytes"), "items": items}

        return f

    kind = found.schema[key].dataType.simpleString()
    return map_rows(found, [key, "n_words", "spans", "bytes", "items"], make, f"{key} {kind}, n_words bigint, spans {_SPANS}, bytes {_SPANS}, items array<string>")


def _by_blocks(rows: DataFrame, key: str, blocks: Iterator[list[tuple[str | None, bytes]]], n: int) -> DataFrame:
    """``find_passages`` of stored rows with a unique ``key``: block after
    block, each broadcast freed before the next."""
    parts = None
    for i, block in enumerate(blocks):
        shared = rows.sparkSession.sparkContext.broadcast(block)
        part = stored(_scanned(rows, key, shared, n, all_rows=i == 0), "decontaminate-block")
        shared.unpersist(blocking=True)
        parts = part if parts is None else parts.unionByName(part)
    of = lambda c: F.flatten(F.collect_list(c)).alias(c)
    return _unioned(parts.groupBy(key).agg(F.max("n_words").alias("n_words"), of("spans"), of("bytes"), of("items")), key)


def _peeked(blocks: Iterator[list]) -> tuple[list, Iterator[list] | None]:
    """The first block, and all of them again where there are more."""
    one = next(blocks)
    two = next(blocks, None)
    return one, None if two is None else itertools.chain([one, two], blocks)


def find_passages(docs: DataFrame, items: DataFrame, key: str = "doc_id", item_key: str = "item_id", n: int = NGRAM, limit: int = BROADCAST_BYTES) -> DataFrame:
    """For each document: its words, hit word spans, hit byte spans and items.

    ``spans`` and ``bytes`` are half-open and sorted. Columns of ``docs``
    needed are ``key`` and ``text``, of ``items`` ``item_key`` and ``text``.
    """
    spark = docs.sparkSession
    one, more = _peeked(_blocks(plain(items, item_key, "text"), item_key, n, limit))
    if more is None:
        return _scanned(plain(docs, key, "text"), key, spark.sparkContext.broadcast(one), n)
    rows = stored(plain(docs, key, "text").withColumn("_row", F.monotonically_increasing_id()), "decontaminate")
    return rows.select("_row", f"`{key}`").join(_by_blocks(rows, "_row", more, n), "_row").drop("_row")


def report(docs: DataFrame, items: DataFrame, n: int = NGRAM) -> DataFrame:
    """Counts and digests of ``find_passages`` for each document."""
    found = find_passages(docs, items, n=n)
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, x: a + x["last"] - x["first"])
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def _without(text: bytes, spans: list[tuple[int, int]]) -> str:
    """A text without some spans. Only at a cut that has blanks on both sides
    are those behind it dropped."""
    out, at = b"", 0
    for a, b in spans:
        out += text[at:a]
        at = b
        while out[-1:] in (b" ", b"\t") and text[at : at + 1] in (b" ", b"\t"):
            at += 1
    return (out + text[at:]).decode()


def decontaminate(docs: DataFrame, items: DataFrame, action: str = "drop", n: int = NGRAM, limit: int = BROADCAST_BYTES) -> DataFrame:
    """The documents without benchmark passages, in their own columns.

    ``drop`` leaves out every document with a hit; ``remove`` cuts the union
    of the hit spans of the whole benchmark out of its text, once. Documents
    without hits stay as they are.
    """
    if action not in ("drop", "remove"):
        raise ValueError(f"action must be drop or remove, not {action!r}")
    spark = docs.sparkSession
    prepare(spark)
    one, more = _peeked(_blocks(plain(items, "item_id", "text"), "item_id", n, limit))
    if more is None:
        return docs.mapInArrow(_Cleaner(spark.sparkContext.broadcast(one), action, n), docs.schema)
    row, where = (fresh(c, docs.columns) for c in ("row", "where"))
    kept = stored(docs.withColumn(row, F.monotonically_increasing_id()), "decontaminate")
    texts = kept.select(F.col(f"`{row}`").alias("_row"), "text")
    found = _by_blocks(texts, "_row", more, n).where(F.size("bytes") > 0).select(F.col("_row").alias(row), F.col("bytes").alias(where))
    if action == "drop":
        return kept.join(found, row, "left_anti").drop(row)
    return kept.join(found, row, "left").drop(row).mapInArrow(_Cutter(where), docs.schema)


class _Cleaner:
    """Documents past one block of the benchmark."""

    def __init__(self, shared, action: str, n: int):
        self.shared, self.action, self.n = shared, action, n

    def __call__(self, batches):
        windows = _windows(self.shared.value, self.n)
        for batch in batches:
            found = scan(utf8(batch), windows)
            if self.action == "drop":
                yield batch.filter(pa.array([not x[3] for x in found], pa.bool_()))
            else:
                yield _cut(batch, [x[3] for x in found])


class _Cutter:
    """Documents with the spans to cut in a last column of their own."""

    def __init__(self, where: str):
        self.where = where

    def __call__(self, batches):
        for batch in batches:
            at = batch.schema.get_field_index(self.where)
            spans = [[(s["first"], s["last"]) for s in own or ()] for own in batch.column(at).to_pylist()]
            yield _cut(batch.remove_column(at), spans)


def _cut(batch: pa.RecordBatch, spans: list[list[tuple[int, int]]]) -> pa.RecordBatch:
    at = batch.schema.get_field_index("text")
    old = batch.column(at).to_pylist()
    new = [_without(o.encode(), s) if s else o for o, s in zip(old, spans, strict=True)]
    return batch.set_column(at, batch.schema.field(at), pa.array(new, batch.schema.field(at).type))


def digest(items: list[str]) -> str:
    """The digest of a document's items, as ``report`` gives it."""
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


#: The report in DuckDB, over the words themselves.
SQL = rf"""
WITH lowered AS (
  SELECT 'd' AS kind, doc_id AS id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
  UNION ALL SELECT 'b', item_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark
), w AS (
  SELECT kind, id, coalesce(regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS ws FROM lowered
), b AS (
  SELECT id, ws, least(len(ws), {NGRAM}) AS size FROM w WHERE kind = 'b' AND len(ws) > 0
), grams AS (
  SELECT DISTINCT id, size, array_to_string(ws[i:i + size - 1], ' ') AS g FROM (SELECT id, ws, size, unnest(range(1, len(ws) - size + 2)) AS i FROM b)
), found AS (
  SELECT d.id, d.i, d.size, d.g FROM (
    SELECT id, i, size, array_to_string(ws[i:i + size - 1], ' ') AS g
    FROM (SELECT w.id, w.ws, s.size, unnest(range(1, len(w.ws) - s.size + 2)) AS i FROM w CROSS JOIN (SELECT DISTINCT size FROM b) s WHERE w.kind = 'd')) d
  WHERE d.g IN (SELECT g FROM grams)
), hits AS (
  SELECT id, count(DISTINCT place) AS n FROM (SELECT id, unnest(range(i, i + size)) AS place FROM found) GROUP BY id
), who AS (
  SELECT id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT found.id, CAST(grams.id AS VARCHAR) AS item FROM found JOIN grams ON grams.g = found.g AND grams.size = found.size) GROUP BY id
)
SELECT w.id AS doc_id, len(w.ws) AS n_words, coalesce(hits.n, 0) AS n_hit, coalesce(who.n, 0) AS n_items,
       sha256(coalesce(who.items, '')) AS items_sha256, coalesce(hits.n, 0) > 0 AS contaminated
FROM w LEFT JOIN hits ON hits.id = w.id LEFT JOIN who ON who.id = w.id WHERE w.kind = 'd'
"""
