"""Words of whole texts as 64-bit hashes, computed over byte arrays at once.

A translation table lower-cases A-Z and turns every separator into a space;
the bytes of many texts then lie in one array, and each word's hash is a
difference of two prefix sums of a polynomial modulo 2**64, scrambled with its
length. Memory is bounded by ``BLOCK`` bytes (or one longer word) at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np

BLOCK = 1 << 20
_BASE, _MASK = 0x9E3779B97F4A7C15, (1 << 64) - 1
_POWERS: list[np.ndarray] = []


def table(separators: bytes) -> bytes:
    """A translation table: A-Z to lower case, separators to spaces."""
    out = bytearray(bytes(range(256)).lower())
    for b in separators:
        out[b] = 32
    return bytes(out)


#: Words of ``[^\x20\x09-\x0D]+`` and of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``, both after lower-casing.
SPACED = table(b"\x20\x09\x0a\x0b\x0c\x0d")
ALNUM = table(bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))


def _powers(n: int) -> list[np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, BLOCK + 4096)
        make = lambda b: np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size, b, np.uint64))])
        _POWERS[:] = [make(_BASE), make(pow(_BASE, -1, 1 << 64))]
    return _POWERS


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


class Hashed(NamedTuple):
    """Texts run together: their bytes, the words' bounds and hashes, the
    number of words of each text, and for each prefix length the hashes of the
    longer words' prefixes (0 for other words)."""

    data: bytes
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    counts: np.ndarray
    prefixes: np.ndarray

    def word(self, i: int, n: int = 1) -> bytes:
        """Words i to i + n - 1, joined by spaces."""
        return b" ".join(self.data[self.starts[k] : self.ends[k]] for k in range(i, i + n))


def _block(data: bytes, at: int, end: int, lengths: tuple[int, ...]) -> tuple[np.ndarray, ...]:
    buf = np.frombuffer(data, np.uint8, end - at, at)
    p, inverse = _powers(len(buf) + 1)
    word = np.empty(len(buf) + 2, np.int8)
    word[0] = word[-1] = 0
    np.not_equal(buf, 32, out=word[1:-1].view(bool))
    edge = np.flatnonzero(word[1:] != word[:-1])
    starts, ends = edge[::2], edge[1::2]
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(buf * p[: len(buf)], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    cuts = np.zeros((len(starts), len(lengths)), np.uint64)
    for j, n in enumerate(lengths):
        long = starts[ends - starts > n]
        cuts[ends - starts > n, j] = mix((sums[long + n] - sums[long]) * inverse[long] + np.uint64(n * 0xA0761D6478BD642F & _MASK))
    return starts + at, ends + at, hashes, cuts


def hashed(texts: list[bytes], by: bytes, prefixes: tuple[int, ...] = ()) -> Hashed:
    """The words of some texts; ``by`` is a table of this module and
    ``prefixes`` are lengths in bytes."""
    data = b" ".join(texts).translate(by)
    found, at = [], 0
    while at < len(data):
        end = min(len(data), at + BLOCK)
        if end < len(data) and (cut := data.rfind(b" ", at, end)) > at:
            end = cut
        elif end < len(data):
            end = cut if (cut := data.find(b" ", end)) >= 0 else len(data)
        found.append(_block(data, at, end, prefixes))
        at = end
    none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros((0, len(prefixes)), np.uint64))
    starts, ends, hashes, cuts = (np.concatenate(x) for x in zip(*found, none, strict=True)) if found else none
    first = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return Hashed(data, starts, ends, hashes, np.diff(np.searchsorted(starts, first)), cuts)


def groups(texts: list[bytes], size: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``size`` bytes; a longer text stands alone."""
    start = total = 0
    for i, t in enumerate(texts):
        if i > start and total + len(t) > size:
            yield start, i
            start, total = i, 0
        total += len(t) + 1
    if start < len(texts):
        yield start, len(texts)


def shingles(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of every n consecutive words."""
    out = hashes[: max(0, len(hashes) - n + 1)].copy()
    for j in range(1, n):
        out = (out ^ (out >> np.uint64(31))) * np.uint64(0x9FB21C651E98DF25) + hashes[j : j + len(out)]
    return mix(out)
