import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from weft.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def special():
    return list(bpe.Vocabulary(open(PATH, "rb").read()).special)


def odd_texts(n=1500):
    rng = random.Random(31)
    bits = ["a", "the", " the", "  ", " ", "\t", "\n", "\r\n", "\x0b", "\x1c", "\x85", "\u00a0", "\u2003", "\u3000", "\u200b", "\ufeff", "'s", "'S", "'re", "'", "12", "٣", "½", "é", "e\u0301", "日本", "\U0001f600", "\U0001f468\u200d\U0001f469", "...", "!?", "_", "-", "\0", "\ufffd", "Ω", "ß", "İ", "ſ", "中", "<", "<|", "|>", "x" * 40, *special()]
    out = ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 30))) for _ in range(n)]
    return out + ["", " ", "\n", "  \n  ", " x", "x ", "x  y", "x \n y", *special(), "a".join(special())]


def long_texts():
    rng = random.Random(5)
    return ["a" * 5000, "ab" * 3000 + " " + "é" * 2000, "".join(chr(rng.randrange(97, 123)) for _ in range(3000)), "x" * 257, "x" * 256, "-" * 700, " " * 900 + "x", "word " * 20_000]


def want(library, text):
    ids = library.encode(text, add_special_tokens=False).ids
    return ids, library.decode(ids, skip_special_tokens=False)


def test_ids_and_decoding_are_the_library_s(library):
    encoder = bpe.RankArrayEncoder(bpe.Vocabulary(open(PATH, "rb").read()))
    for text in odd_texts() + long_texts():
        ids, decoded = want(library, text)
        packed = encoder.encode(text)
        assert np.frombuffer(packed, "<u4").tolist() == ids, repr(text[:80])
        assert encoder.decode(packed).decode() == decoded, repr(text[:80])


def test_small_caches_change_nothing(library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_SIZE", 3)
    encoder = bpe.RankArrayEncoder(bpe.Vocabulary(open(PATH, "rb").read()))
    for text in ["a b c d e a b c d e f g a", "a b", "q w e r t y a b c d"] * 2 + odd_texts(100):
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == want(library, text)[0]


def test_scan_and_heap_merge_alike():
    vocabulary = bpe.Vocabulary(open(PATH, "rb").read())
    rng = random.Random(8)
    for _ in range(200):
        word = "".join(rng.choice(["th", "e", "in", "g", "é", "a", "zz"]) for _ in range(rng.randrange(1, 60))).encode()
        assert vocabulary.merge_word(word) == vocabulary._merge_long([vocabulary.byte_ids[b] for b in word])


def test_broken_sequences_decode_as_in_the_library(library):
    encoder = bpe.RankArrayEncoder(bpe.Vocabulary(open(PATH, "rb").read()))
    rng = random.Random(3)
    for _ in range(300):
        ids = [rng.randrange(len(encoder.vocabulary.token_bytes)) for _ in range(rng.randrange(0, 12))]
        assert encoder.decode(np.array(ids, "<u4").tobytes()).decode() == library.decode(ids, skip_special_tokens=False)


def test_documents(spark, library):
    texts = [None, "", *odd_texts(60), *long_texts(), "same", "same"]
    rows = [(i, t, [1], f"d{i}") for i, t in enumerate(texts)] + [(0, "twice", [2], None), (None, "no id", None, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, ids array<int>, decoded string")
    got = bpe.digest_documents(frame, PATH).collect()
    assert len(got) == len(rows)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    expected = []
    for i, t, *_ in rows:
        ids, decoded = want(library, t or "")
        expected.append((i, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(decoded.encode())))
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got), key=key) == sorted(expected, key=key)
    whole = {r.doc_id: r for r in bpe.encode_documents(frame, PATH).where("doc_id is not null").collect()}
    assert whole[5].ids == want(library, texts[5])[0] and whole[5].decoded == want(library, texts[5])[1]
    assert bpe.digest_documents(frame.limit(0), PATH).count() == 0


def test_a_word_is_kept_once(library):
    encoder = bpe.RankArrayEncoder(bpe.Vocabulary(open(PATH, "rb").read()))
    for text in ["one two, two three.\nfour two \n two", "x \n two", "a \x1c b \x1c"]:
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == want(library, text)[0]
    assert "two" in encoder.pieces and "\n" not in encoder.pieces
    assert not any(w[0] == " " and not w.isspace() for w in encoder.words.known)
