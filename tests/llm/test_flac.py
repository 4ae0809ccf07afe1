import hashlib
import random
import struct
import zlib

import numpy as np
import pytest

from weft.llm import flac
from weft.llm.flac import BLOCK, decode, encode, media_features, padded, parse, pcm_blocks, seek, store_media


class Bits:
    def __init__(self):
        self.out = []

    def put(self, value, width):
        self.out += [value >> (width - 1 - i) & 1 for i in range(width)]

    def rice(self, value, k):
        u = value * 2 if value >= 0 else -2 * value - 1
        self.out += [0] * (u >> k) + [1]
        self.put(u & (1 << k) - 1, k)

    def bytes(self):
        return bytes(np.packbits(np.array(self.out, np.uint8)))


def crc(data, width, poly):
    c = 0
    for b in data:
        c ^= b << (width - 8)
        for _ in range(8):
            c = (c << 1 ^ poly if c >> (width - 1) & 1 else c << 1) & (1 << width) - 1
    return c


def stream_of(samples, bits, block, write):
    """A stream without seek table whose subframes ``write`` makes."""
    frames = b""
    for number, a in enumerate(range(0, len(samples), block)):
        x = samples[a : a + block]
        head = b"\xff\xf8" + bytes([7 << 4, {8: 1, 16: 4}[bits] << 1, number]) + (len(x) - 1).to_bytes(2, "big")
        body = Bits()
        write(body, x, bits)
        data = head + bytes([crc(head, 8, 7)]) + body.bytes()
        frames += data + crc(data, 16, 0x8005).to_bytes(2, "big")
    info = struct.pack(">HH", block, block) + bytes(6) + (8000 << 44 | (bits - 1) << 36 | len(samples)).to_bytes(8, "big")
    pcm = np.array(samples, "<i2" if bits == 16 else "i1").tobytes()
    return b"fLaC\x80" + (34).to_bytes(3, "big") + info + hashlib.md5(pcm).digest() + frames


def linear(body, x, bits):
    """Order 3, precision 6, shift 4, two partitions, the second escaped."""
    c = [25, -9, 3]
    body.put((32 + 2) << 1, 8)
    for v in x[:3]:
        body.put(v & (1 << bits) - 1, bits)
    body.put(5, 4)
    body.put(4, 5)
    for v in c:
        body.put(v & 63, 6)
    residual = [x[j] - (sum(c[i] * x[j - 1 - i] for i in range(3)) >> 4) for j in range(3, len(x))]
    body.put(1, 2)
    body.put(1, 4)
    half = len(x) // 2
    body.put(3, 5)
    for v in residual[: half - 3]:
        body.rice(v, 3)
    body.put(31, 5)
    body.put(bits + 4, 5)
    for v in residual[half - 3 :]:
        body.put(v & (1 << bits + 4) - 1, bits + 4)


def test_linear_prediction_partitions_and_escapes():
    rng = random.Random(3)
    for bits in (8, 16):
        top = 1 << bits - 1
        x = [max(-top, min(top - 1, int(top * 0.9 * np.sin(i / 9)) + rng.randrange(-3, 4))) for i in range(64 * 5)]
        assert decode([stream_of(x, bits, 64, linear)])[0].tolist() == x


def fixture():
    rng = np.random.default_rng(1)
    texts = [b"", b"a", b"\xff" * BLOCK, bytes(range(256)) * 9, "né 日本\n".encode() * 900, rng.bytes(3000), b"ab" * 4000]
    texts += [rng.choice(np.frombuffer(b"etaoin shrdlu", np.uint8), int(rng.integers(1, 4000))).tobytes() for _ in range(40)]
    texts.append((np.cumsum(rng.integers(-2, 3, 6000)) % 256).astype(np.uint8).tobytes())
    return [padded(t) for t in texts]


def test_round_trip_and_kinds_of_subframes():
    payloads = fixture()
    streams = encode(payloads)
    assert [(x + 128).astype(np.uint8).tobytes() for x in decode(streams)] == payloads
    kinds = set()
    for s in streams:
        info = parse(s)
        assert sum(p[2] for p in info.points) == info.total
        kinds |= {s[info.first + p[1] + 6] >> 1 for p in info.points if p[0] < 128 * BLOCK}
    assert {0, 1} < kinds and kinds & {8, 9, 10, 11, 12}
    assert encode(payloads[:3]) == streams[:3]


def test_seeking_and_walking_agree():
    payload = fixture()[4]
    stream = encode([payload])[0]
    for sample in (0, BLOCK - 1, BLOCK, len(payload) - 1):
        a = sample // BLOCK * BLOCK
        assert (seek(stream, sample) + 128).astype(np.uint8).tobytes() == payload[a : a + BLOCK]
    info = parse(stream)
    bare = b"fLaC\x80" + stream[5 : 4 + 4 + 34] + stream[info.first :]
    assert (decode([bare, stream])[0] == decode([stream])[0]).all()


def test_passes_are_bounded(monkeypatch):
    monkeypatch.setattr(flac, "PASS_SAMPLES", 3 * BLOCK)
    monkeypatch.setattr(flac, "PASS_LANES", 4)
    payloads = fixture()
    assert [(x + 128).astype(np.uint8).tobytes() for x in decode(encode(payloads))] == payloads


@pytest.mark.parametrize("place", ["head", "body", "md5"])
def test_damage_is_found(place):
    stream = bytearray(encode([fixture()[10]])[0])
    info = parse(bytes(stream))
    at = {"head": info.first + 4, "body": info.first + 90, "md5": 8 + 20}[place]
    stream[at] ^= 4
    with pytest.raises(ValueError):
        decode([bytes(stream)])


def test_columns(spark):
    rows = [(1, "héllo wörld " * 300, 5), (2, None, 5), (2, "", 5), (None, "héllo wörld " * 300, 5), (3, "z" * 200_000, 5)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, media int")
    media = store_media(frame)
    got = media_features(media).collect()
    raw = {r[0]: padded((r[1] or "").encode()) for r in rows}
    for r in got:
        p = raw[r.doc_id]
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
    same = {(r.media_sha256, r.feature, r.n_bytes) for r in got if r.doc_id in (1, None)}
    assert len(got) == 5 and len(same) == 1
    blocks = sorted((r.first_sample, bytes(r.pcm)) for r in pcm_blocks(media, block=BLOCK * 100).where("doc_id = 3").collect())
    joined = np.frombuffer(b"".join(b for _, b in blocks), "<i4") + 128
    assert [a for a, _ in blocks] == list(range(0, len(raw[3]), BLOCK * 100)) and joined.astype(np.uint8).tobytes() == raw[3]
    assert media_features(store_media(frame.limit(0))).count() == 0


def test_sparse_seek_points_and_pcm_blocks(monkeypatch):
    payloads = fixture()
    dense = encode(payloads)
    monkeypatch.setattr(flac, "SEEK_POINTS", 3)
    monkeypatch.setattr(flac, "PASS_LANES", 4)
    sparse = encode(payloads)
    assert max(len(parse(s).points) for s in sparse) == 3 and any(len(a) > len(b) for a, b in zip(dense, sparse, strict=True))
    assert [(x + 128).astype(np.uint8).tobytes() for x in decode(sparse)] == payloads
    payload, stream = payloads[4], sparse[4]
    for sample in (0, BLOCK * 2, len(payload) - 1):
        a = sample // BLOCK * BLOCK
        assert (seek(stream, sample) + 128).astype(np.uint8).tobytes() == payload[a : a + BLOCK]
    for size in (100, BLOCK, 5 * BLOCK):
        got = {}
        for i, first, x in flac.blocks(sparse, size):
            assert first == sum(map(len, got.get(i, []))) and 0 < len(x) <= size
            got.setdefault(i, []).append((x + 128).astype(np.uint8).tobytes())
        assert [b"".join(got[i]) for i in range(len(payloads))] == payloads


def test_features_do_not_depend_on_the_blocks():
    payload = fixture()[-1]
    x = decode(encode([payload]))[0]
    one = flac._Feature()
    one.add(x)
    many = flac._Feature()
    for a in range(0, len(x), 97):
        many.add(x[a : a + 97])
    assert str(one) == str(many) and one.digest.digest() == many.digest.digest() == hashlib.sha256(payload).digest()
    assert one.tail == many.tail == payload[-32:] and one.size == len(payload)
    assert f"energy={int((x * x).sum())};steps={int(np.abs(np.diff(x)).sum())}" in str(one)
