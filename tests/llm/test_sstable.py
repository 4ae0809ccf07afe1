import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from weft.llm import sstable
from weft.llm.sstable import LibraryEncoder, Shard, ShardWriter, digest_shards, find, key_of, read_shards, write_shards

PATH = public_tokenizers.path("byte_bpe_50k.json")


def rows():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abé \n'1 ") for _ in range(rng.randrange(1, 9)))
    docs = [(i * 7 - 900, " ".join(word() for _ in range(rng.randrange(0, 40)))) for i in range(300)]
    docs += [(10**15, None), (-(10**15), ""), (10**15 + 1, "x" * 30000), (10**15 + 2, "a <|endoftext|> b  c \n d ")]
    rng.shuffle(docs)
    return docs


def test_shards_hold_the_library_s_ids(spark):
    docs = rows()
    t = Tokenizer.from_file(PATH)
    manifest = write_shards(spark.createDataFrame([(d, x, 1) for d, x in docs], "doc_id long, text string, start int"), PATH, end_id=2, shard_bytes=4000)
    assert manifest.count() > 4
    got = {r.doc_id: r for r in digest_shards(manifest).collect()}
    full = {r.doc_id: r for r in read_shards(manifest).collect()}
    start = 0
    for d, x in sorted(docs, key=lambda r: r[0]):
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 2]
        assert (got[d].start, got[d].n_tokens, got[d].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        assert full[d].ids == ids and full[d].start == start
        start += len(ids)
    assert len(got) == len(docs)


def test_lookup(spark):
    docs = rows()
    frame = spark.createDataFrame([*docs, (99, "one"), (99, "two"), (None, "none")], "doc_id long, text string")
    manifest = write_shards(frame, PATH, shard_bytes=4000)
    asked = spark.createDataFrame([(docs[5][0],), (99,), (98765,), (None,)], "doc_id long")
    t = Tokenizer.from_file(PATH)
    want = sorted([(str(d), t.encode(x or "").ids) for d, x in [docs[5], (99, "one"), (99, "two"), (None, "none")]])
    assert sorted((str(r.doc_id), r.ids) for r in find(manifest, asked).collect()) == want


def test_binary_search_and_damage(tmp_path):
    writer = ShardWriter(2)
    for i in range(5000):
        writer.add(key_of(2 * i), np.arange(i % 50))
    path = tmp_path / "s.sst"
    path.write_bytes(data := writer.finish())
    shard = Shard(str(path))
    assert len(shard.index) > 3 and shard.docs == 5000
    for i in (0, 1, 17, 2500, 4999):
        assert [x.tolist() for x in shard.get(2 * i)] == [list(range(i % 50))]
        assert shard.get(2 * i + 1) == []
    assert sum(shard.may_hold(2 * i + 1) for i in range(5000)) < 200
    path.write_bytes(data[:30] + bytes([data[30] ^ 1]) + data[31:])
    with pytest.raises(ValueError, match="damaged"):
        list(Shard(str(path)).scan())


def test_empty_table(spark):
    manifest = write_shards(spark.createDataFrame([], "doc_id long, text string"), PATH)
    assert digest_shards(manifest).count() == 0


def test_an_id_over_several_shards_is_found_whole(spark):
    docs = [(i, f"word{i} " * 50) for i in range(40)] + [(17, f"again {k} " * 200) for k in range(30)]
    manifest = write_shards(spark.createDataFrame(docs, "doc_id long, text string"), PATH, shard_bytes=2000)
    asked = spark.createDataFrame([(17,), (-5,), (39,), (1000,), (17,)], "doc_id long")
    found = find(manifest, asked)
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()
    got = [r.doc_id for r in found.collect()]
    assert sorted(got) == [17] * 31 + [39]
    assert find(manifest, asked.limit(0)).count() == 0


def test_texts_together_ask_for_each_part_once():
    rng = random.Random(9)
    bits = ["the", "The", "don't", "a's,", "x.y", "é,", "ñ'll", "日本,", "²,", "12,", "3.5", "...", "'", "İ.", "Ǆ,", "ſ's", "é,", "\U0001f600", "a_b", "(c)", "x" * 60]
    texts = ["".join(rng.choice(bits) + rng.choice(["", "", " ", "\n"]) for _ in range(rng.randrange(1, 40))) + "end" for _ in range(800)]
    texts += ["", " ", " a", "a ", "a  b", "a \n b", "a\r\nb", "a\tb", "a\x01b", "a\x1cb", "x  y", "a <|endoftext|> b", "ab" * 5000]
    encoder, asked = LibraryEncoder(open(PATH, "rb").read()), []
    library = encoder._ids
    encoder._ids = lambda text: asked.append(text) or library(text)
    t = Tokenizer.from_file(PATH)
    for _ in range(2):
        got = encoder.encode_all(texts)
        assert [x.tolist() for x in got] == [t.encode(x, add_special_tokens=False).ids for x in texts]
    asked.clear()
    encoder.encode_all(["one two, two. two\none two"] * 50)
    assert sorted("".join(asked).replace(" a", " ").split()) == sorted("one two , .".split())
    assert encoder.encode_all([]) == []


def test_texts_run_together_to_a_bounded_size(monkeypatch):
    monkeypatch.setattr(sstable, "RUN_BYTES", 10)
    batches = [pa.RecordBatch.from_pydict({"doc_id": [1, 2, 3], "text": ["abc", None, "x" * 50]}), pa.RecordBatch.from_pydict({"doc_id": [4, None], "text": ["abcde", "abcde"]})]
    assert list(sstable._runs(batches)) == [([1, 2], ["abc", ""]), ([3], ["x" * 50]), ([4, None], ["abcde", "abcde"])]
