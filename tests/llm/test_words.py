import random
import re

import numpy as np

from weft.llm import words
from weft.llm.words import ALNUM, SPACED, hashed, shingles

PATTERNS = {SPACED: rb"[^\x20\x09-\x0D]+", ALNUM: rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"}


def texts():
    rng = random.Random(3)
    alphabet = [bytes([b]) for b in range(128)] + ["é".encode(), "日".encode(), b"a", b"b", b" ", b" "]
    return [b"".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 300))) for _ in range(60)] + [b"", b" ", b"x" * 5000]


def test_words_are_those_of_the_patterns():
    for table, pattern in PATTERNS.items():
        own = texts()
        h = hashed(own, table)
        want = [re.findall(pattern, t.lower()) for t in own]
        assert h.counts.tolist() == [len(w) for w in want]
        flat = [w for ws in want for w in ws]
        assert [h.word(i) for i in range(len(flat))] == flat
        by_hash = {}
        for k, w in zip(h.hashes.tolist(), flat, strict=True):
            assert by_hash.setdefault(k, w) == w
        assert len(by_hash) == len(set(flat))


def test_blocks_do_not_change_hashes(monkeypatch):
    own = texts()
    whole = hashed(own, SPACED, (4, 6))
    monkeypatch.setattr(words, "BLOCK", 50)
    parts = hashed(own, SPACED, (4, 6))
    assert (whole.hashes == parts.hashes).all() and (whole.prefixes == parts.prefixes).all()


def test_prefixes_and_shingles():
    h = hashed([b"abcdefg abcdxyz abc abcd"], SPACED, (4,))
    assert h.prefixes[0, 0] == h.prefixes[1, 0] != 0 and h.prefixes[2, 0] == h.prefixes[3, 0] == 0
    s = hashed([b"a b c a b c d"], SPACED).hashes
    three = shingles(s, 3)
    assert len(three) == 5 and three[0] == three[3] and len(np.unique(three)) == 4
    assert len(shingles(s[:2], 3)) == 0
