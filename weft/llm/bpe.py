"""Byte-level BPE by contiguous rank arrays, with exact decoding.

A text is cut at the tokenizer's special strings, then into words by its
pattern, and each word is encoded on its own: the word's parts lie in a list,
the ranks of adjacent pairs in another; the smallest rank is found by a scan,
its boundary deleted, and the two neighbouring ranks are refreshed. A word
longer than ``SCAN_LIMIT`` bytes keeps the same parts and ranks but finds the
minimum through a heap, since a scan costs the square of its length.

Results for odd input: null and empty texts have no tokens; white space, any
Unicode text and special strings inside texts encode as the tokenizers library
does; equal texts give equal rows; further input columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Callable

import numpy as np
import regex
from pyspark.sql import DataFrame

from weft.llm.arrow import map_rows, plain, texts

#: Longest word, in bytes, whose minimum is found by scanning.
SCAN_LIMIT = 256
#: Longest cached piece, and pieces a worker keeps in each of two generations.
CACHE_CHARS, CACHE_SIZE = 48, 200_000
#: Fixed value: the byte-level pre-tokenizer's pattern, white space spelled out.
SPACE = "\t-\r \x85\xa0  -     　"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
ID_BITS = 24
ID_MASK, _NONE = (1 << ID_BITS) - 1, 1 << 60


def byte_symbols() -> dict[str, int]:
    """The printable symbol of each byte in byte-level vocabularies, reversed.

    Printable Latin-1 characters stand for themselves; the others, in order,
    take the code points from 256 on.
    """
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = sorted(set(range(256)) - set(shown))
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """Pair ranks, token bytes and special strings of a tokenizer file."""

    def __init__(self, data: bytes):
        spec = json.loads(data)
        model = spec["model"]
        symbols = byte_symbols()
        raw = lambda s: bytes(symbols[c] for c in s)
        ids = {raw(t): i for t, i in model["vocab"].items()}
        self.byte_ids = [ids[bytes([b])] for b in range(256)]
        #: A pair's rank above the merged token's id, so that one number holds both.
        self.pairs: dict[tuple[int, int], int] = {}
        for rank, merge in enumerate(model["merges"]):
            a, b = map(raw, merge if isinstance(merge, list) else merge.split(" "))
            self.pairs.setdefault((ids[a], ids[b]), rank << ID_BITS | ids[a + b])
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        size = max([*ids.values(), *self.special.values()], default=-1) + 1
        self.token_bytes = [b""] * size
        for t, i in ids.items():
            self.token_bytes[i] = t
        for t, i in self.special.items():
            self.token_bytes[i] = t.encode()
        self.packed = [i.to_bytes(4, "little") for i in range(size)]

    def merge_word(self, word: bytes) -> list[int]:
        """Token ids of one word."""
        ids = self.byte_ids
        parts = [ids[b] for b in word]
        if len(parts) > SCAN_LIMIT:
            return self._merge_long(parts)
        get = self.pairs.get
        ranks = [get(p, _NONE) for p in zip(parts, parts[1:])]  # noqa: B905
        while ranks:
            low = min(ranks)
            if low == _NONE:
                break
            i = ranks.index(low)
            parts[i] = low & ID_MASK
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get((parts[i - 1], parts[i]), _NONE)
            if i < len(ranks):
                ranks[i] = get((parts[i], parts[i + 1]), _NONE)
        return parts

    def _merge_long(self, parts: list[int]) -> list[int]:
        n, pairs = len(parts), self.pairs
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(pairs[p], i) for i, p in enumerate(zip(parts, parts[1:], strict=False)) if p in pairs]
        heapq.heapify(heap)
        while heap:
            low, i = heapq.heappop(heap)
            j = after[i]
            if j >= n or parts[i] < 0 or pairs.get((parts[i], parts[j])) != low:
                continue
            parts[i], parts[j] = low & ID_MASK, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for left in (before[i], i):
                if left >= 0 and after[left] < n and (p := pairs.get((parts[left], parts[after[left]]))) is not None:
                    heapq.heappush(heap, (p, left))
        return [p for p in parts if p >= 0]


class Recent:
    """A mapping of two generations: what is asked for again moves from the
    old one to the new one, and a full new one becomes the old one."""

    def __init__(self, size: int):
        self.size = size
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def recall(self, key: str) -> bytes | None:
        """The value of a key that is not in ``known``."""
        found = self.old.get(key)
        if found is not None:
            self.keep(key, found)
        return found

    def keep(self, key: str, value: bytes) -> None:
        if len(self.known) >= self.size:
            self.old = dict(self.known)
            self.known.clear()
        self.known[key] = value


class Pieces(dict):
    """Encoded pieces by text, as little-endian 32-bit ids.

    A piece is what stands between single spaces, with the space before it.
    Where a space is next to other white space the pattern may join them, so
    such a piece is None and its text is cut by the pattern alone.
    """

    def __init__(self, encode: Callable[[str], bytes], lead: str = " "):
        super().__init__()
        self.encode, self.lead = encode, lead
        self.recent = Recent(CACHE_SIZE)
        self.recent.known = self

    def __missing__(self, piece: str) -> bytes | None:
        if not piece or piece[0].isspace() or piece[-1].isspace():
            return None
        found = self.recent.recall(piece)
        if found is None:
            found = self.encode(self.lead + piece)
            if len(piece) <= CACHE_CHARS:
                self.recent.keep(piece, found)
        return found


class Encoder:
    """Whole texts to packed ids; ``encode_piece`` may be another encoder."""

    def __init__(self, special: dict[str, int], encode_piece: Callable[[str], bytes]):
        self.special = special
        self.cut = re.compile("|".join(re.escape(s) for s in sorted(special, key=len, reverse=True))) if special else None
        self.encode_piece = encode_piece
        self.pieces = Pieces(encode_piece)

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if self.cut is None or not self.cut.search(text):
            return self._plain(text)
        out, at = [], 0
        for m in self.cut.finditer(text):
            out += [self._plain(text[at : m.start()]), self.special[m[0]].to_bytes(4, "little")]
            at = m.end()
        return b"".join([*out, self._plain(text[at:])])

    def _plain(self, text: str) -> bytes:
        if not text:
            return b""
        first, *rest = text.split(" ")
        if first and not first[-1].isspace():
            try:
                return self.encode_piece(first) + b"".join(map(self.pieces.__getitem__, rest))
            except TypeError:  # white space beside white space
                pass
        return self.encode_piece(text)


class RankArrayEncoder(Encoder):
    """The encoder of this module's method."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.words = Recent(CACHE_SIZE)
        self.pattern = regex.compile(PATTERN)
        super().__init__(vocabulary.special, self._piece)

    def _piece(self, piece: str) -> bytes:
        return b"".join([self._word(w) for w in self.pattern.findall(piece)])

    def _word(self, word: str) -> bytes:
        # A word behind a space is a piece too, and is kept only once.
        piece = word[0] == " " and not word[-1].isspace()
        cache, key = (self.pieces.recent, word[1:]) if piece else (self.words, word)
        found = cache.known.get(key)
        if found is None:
            found = cache.recall(key)
        if found is None:
            packed = self.vocabulary.packed
            found = b"".join([packed[i] for i in self.vocabulary.merge_word(word.encode())])
            if len(key) <= CACHE_CHARS:
                cache.keep(key, found)
        return found

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 of the decoded text; broken sequences become U+FFFD."""
        table = self.vocabulary.token_bytes
        raw = b"".join([table[i] for i in np.frombuffer(ids, "<u4").tolist()])
        return raw.decode("utf-8", "replace").encode()


_LOADED: dict[bytes, RankArrayEncoder] = {}


def loaded(data: bytes) -> RankArrayEncoder:
    """One encoder a worker process for each vocabulary file."""
    key = hashlib.sha256(data).digest()
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = RankArrayEncoder(Vocabulary(data))
    return _LOADED[key]


def encode_documents(docs: DataFrame, vocabulary_path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Token ids of every text, and the text decoded from them again.

    Returns ``id_column``, ``ids`` (array of int) and ``decoded``. The file is
    read on the driver and broadcast; its size is that of one vocabulary.
    """
    docs = plain(docs, id_column, text_column)
    data = docs.sparkSession.sparkContext.broadcast(open(vocabulary_path, "rb").read())

    def make():
        encoder = loaded(data.value)

        def f(batch):
            packed = [encoder.encode(t) for t in texts(batch, text_column)]
            return {id_column: batch.column(0), "ids": [np.frombuffer(p, "<i4") for p in packed], "decoded": [encoder.decode(p).decode() for p in packed]}

        return f

    kind = docs.schema[id_column].dataType.simpleString()
    return map_rows(docs, [id_column, text_column], make, f"{id_column} {kind}, ids array<int>, decoded string")


def digest_documents(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """``encode_documents`` reduced to counts and hashes inside the worker."""
    docs = plain(docs, "doc_id", "text")
    data = docs.sparkSession.sparkContext.broadcast(open(vocabulary_path, "rb").read())

    def make():
        encoder = loaded(data.value)
        sha = lambda b: hashlib.sha256(b).hexdigest()

        def f(batch):
            packed = [encoder.encode(t) for t in texts(batch)]
            return {"doc_id": batch.column(0), "n_tokens": [len(p) // 4 for p in packed], "ids_sha256": list(map(sha, packed)), "decoded_sha256": [sha(encoder.decode(p)) for p in packed]}

        return f

    return map_rows(docs, ["doc_id", "text"], make, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
