"""Token ids in sorted-string-table shards.

Documents are range-partitioned and sorted by id; each task encodes its run
with the tokenizers library and writes shards of bounded size into a shared
folder. A shard holds prefix-compressed blocks, a Bloom filter over its keys,
a sparse index (the last key of each block) and a footer; a lookup asks the
filter, finds the block by binary search and then the entry through the
block's restart points. A manifest, written by Spark's committer, names the
shards whose task succeeded, so a retried or lost task leaves only unnamed
files behind.

Layout (little-endian): magic; blocks, each zstd(entries, restart offsets)
and its CRC-32; filter; index; footer. An entry is three varints (shared and
own key bytes, value bytes), the key's rest and the value. A key is a null
flag and the id in big-endian offset binary, so that byte order is id order.

Results for odd input: a null or empty text stores only the end id; null ids
come first; repeated ids keep one entry a row, ordered by the hash of their
text; an empty table has no shards; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from weft.llm import storage
from weft.llm.arrow import map_rows, plain, prepare, texts
from weft.llm.bpe import CACHE_CHARS, CACHE_SIZE, Encoder
from weft.plans.lineage import cut, scratch, stored
from weft.plans.ordinal import with_last

MAGIC = b"WEFTSST1"
FOOTER = struct.Struct("<QQQQQQQI8s")
BLOCK_BYTES, SHARD_BYTES, RESTART = 64 << 10, 32 << 20, 16
#: Bytes of text that a task encodes, about.
TASK_BYTES = 32 << 20
BLOOM_BITS, BLOOM_HASHES = 10, 7
#: Characters of text that are encoded together, and parts in one call of the library.
RUN_BYTES, ASKED = 12 << 20, 4096
#: Where texts are cut: white space that forbids it, a mark of cuts, and marks behind letters.
CUT = "\x01"
ODD = r"[\x00\x01\t\x0b\x0c\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200b}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]|[ \n][ \n]|[ \n]\z|\A[ \n]"
BEFORE_MARK = r"([A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}])([!-/:-@\[-`{-~])"
MANIFEST = "path string, task int, part int, docs bigint, tokens bigint, first_key binary, last_key binary, file_bytes bigint"


def key_of(doc_id: int | None) -> bytes:
    return b"\0" + bytes(8) if doc_id is None else b"\1" + (doc_id + (1 << 63)).to_bytes(8, "big")


def id_of(key: bytes) -> int | None:
    return int.from_bytes(key[1:], "big") - (1 << 63) if key[0] else None


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while data[at] > 127:
        n |= (data[at] & 127) << shift
        shift, at = shift + 7, at + 1
    return n | data[at] << shift, at + 1


def bloom_places(key: bytes, bits: int) -> list[int]:
    h = xxhash.xxh3_128_intdigest(key)
    low, high = h & (1 << 64) - 1, h >> 64 | 1
    return [(low + i * high) % bits for i in range(BLOOM_HASHES)]


class ShardWriter:
    """Entries in key order to the bytes of one shard."""

    def __init__(self, width: int):
        self.width, self.packer = width, zstandard.ZstdCompressor(level=1)
        self.out, self.size = [MAGIC], len(MAGIC)
        self.index: list[tuple[bytes, int, int]] = []
        self.keys: list[bytes] = []
        self.tokens = 0
        self._clear()

    def _clear(self) -> None:
        self.entries, self.restarts, self.raw, self.last, self.count = [], [], 0, b"", 0

    def add(self, key: bytes, ids: np.ndarray) -> None:
        shared = 0
        if self.count % RESTART:
            while shared < len(key) and self.last[shared] == key[shared]:
                shared += 1
        else:
            self.restarts.append(self.raw)
        value = ids.astype(f"<u{self.width}").tobytes()
        entry = b"".join([varint(shared), varint(len(key) - shared), varint(len(value)), key[shared:], value])
        self.entries.append(entry)
        self.raw += len(entry)
        self.last, self.count, self.tokens = key, self.count + 1, self.tokens + len(ids)
        self.keys.append(key)
        if self.raw >= BLOCK_BYTES:
            self._flush()

    def _flush(self) -> None:
        if self.entries:
            tail = np.array([*self.restarts, len(self.restarts)], "<u4").tobytes()
            packed = self.packer.compress(b"".join([*self.entries, tail]))
            self.index.append((self.last, self.size, len(packed)))
            self.out += [packed, zlib.crc32(packed).to_bytes(4, "little")]
            self.size += len(packed) + 4
            self._clear()

    def finish(self) -> bytes:
        self._flush()
        bits = max(64, -(-len(self.keys) * BLOOM_BITS // 8) * 8)
        bloom = np.zeros(bits, np.uint8)
        for k in self.keys:
            bloom[bloom_places(k, bits)] = 1
        bloom_data = np.packbits(bloom, bitorder="little").tobytes()
        index = b"".join(varint(len(k)) + k + varint(at) + varint(n) for k, at, n in self.index)
        footer = FOOTER.pack(self.size, len(bloom_data), self.size + len(bloom_data), len(index), len(self.index), len(self.keys), self.tokens, self.width, MAGIC)
        return b"".join([*self.out, bloom_data, index, footer, zlib.crc32(bloom_data + index + footer).to_bytes(4, "little")])


class Entry(NamedTuple):
    key: bytes
    ids: np.ndarray


class Shard:
    """A shard's filter, index and blocks, read by offset."""

    def __init__(self, uri: str):
        self.uri = uri
        tail = storage.read(uri, -FOOTER.size - 4)
        self.bloom_at, bloom_len, index_at, index_len, blocks, self.docs, self.tokens, self.width, magic = FOOTER.unpack(tail[:-4])
        meta = storage.read(uri, self.bloom_at, bloom_len + index_len)
        if magic != MAGIC or zlib.crc32(meta + tail[:-4]) != int.from_bytes(tail[-4:], "little"):
            raise ValueError(f"{uri} is not a whole shard")
        self.bloom, data, at = meta[:bloom_len], meta[bloom_len:], 0
        self.index: list[tuple[bytes, int, int]] = []
        for _ in range(blocks):
            n, at = read_varint(data, at)
            key, at = data[at : at + n], at + n
            offset, at = read_varint(data, at)
            length, at = read_varint(data, at)
            self.index.append((key, offset, length))

    def _block(self, i: int) -> tuple[bytes, np.ndarray]:
        _, at, n = self.index[i]
        packed = storage.read(self.uri, at, n + 4)
        if zlib.crc32(packed[:-4]) != int.from_bytes(packed[-4:], "little"):
            raise ValueError(f"block {i} of {self.uri} is damaged")
        raw = zstandard.ZstdDecompressor().decompress(packed[:-4])
        count = int.from_bytes(raw[-4:], "little")
        return raw[: -4 * (count + 1)], np.frombuffer(raw[-4 * (count + 1) : -4], "<u4")

    def _entries(self, raw: bytes, at: int) -> Iterator[Entry]:
        key = b""
        while at < len(raw):
            shared, at = read_varint(raw, at)
            own, at = read_varint(raw, at)
            size, at = read_varint(raw, at)
            key, at = key[:shared] + raw[at : at + own], at + own
            yield Entry(key, np.frombuffer(raw, f"<u{self.width}", size // self.width, at))
            at += size

    def scan(self) -> Iterator[Entry]:
        """All entries in key order, a block at a time."""
        for i in range(len(self.index)):
            yield from self._entries(self._block(i)[0], 0)

    def may_hold(self, doc_id: int | None) -> bool:
        return all(self.bloom[p >> 3] >> (p & 7) & 1 for p in bloom_places(key_of(doc_id), 8 * len(self.bloom)))

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of every row with this id, by binary search."""
        key, found = key_of(doc_id), []
        if not self.may_hold(doc_id):
            return found
        for i in range(bisect_left(self.index, key, key=lambda x: x[0]), len(self.index)):
            raw, restarts = self._block(i)
            at = bisect_left(restarts.tolist(), key, key=lambda o: next(self._entries(raw, o)).key)
            for e in self._entries(raw, int(restarts[max(0, at - 1)])):
                if e.key > key:
                    return found
                if e.key == key:
                    found.append(e.ids)
        return found


class LibraryEncoder(Encoder):
    """The tokenizers library, asked once for each distinct piece of text.

    A piece stands between single spaces, with the space before it, and encodes
    alike wherever it stands. The unknown pieces of a text are encoded in one
    call, and the ids are dealt to them by the byte lengths of the tokens. A
    text whose spaces touch other white space is encoded whole. ``encode_all``
    does so for many texts at once, over arrays.
    """

    def __init__(self, data: bytes):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_buffer(data)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        size = max(self.tokenizer.get_vocab().values()) + 1
        # One symbol a byte in byte-level vocabularies.
        self.lengths = np.array([len(self.tokenizer.id_to_token(i) or "") for i in range(size)], np.int64)
        # Two generations: what is asked for again moves from the old to the new.
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        super().__init__(special, self._library)

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _library(self, text: str) -> bytes:
        return self._ids(text).tobytes()

    def _dealt(self, pieces: list[str]) -> dict[str, bytes]:
        """The packed ids of some pieces, each with a space before it."""
        ids = self._ids(" " + " ".join(pieces))
        ends = np.cumsum(self.lengths[ids])
        last = np.cumsum([len(p.encode()) + 1 for p in pieces])
        cuts = np.searchsorted(ends, last) + 1
        if cuts[-1] != len(ids) or (ends[np.minimum(cuts, len(ids)) - 1] != last).any():
            return {p: self._library(" " + p) for p in pieces}
        packed = ids.tobytes()
        cuts = (4 * cuts).tolist()
        return {p: packed[a:b] for p, a, b in zip(pieces, [0, *cuts[:-1]], cuts, strict=True)}

    def _plain(self, text: str) -> bytes:
        if not text:
            return b""
        first, *rest = text.split(" ")
        if not first or first[-1].isspace():
            return self._library(text)
        found = list(map(self.known.get, rest))
        if None in found:
            asked = {p for p, v in zip(rest, found, strict=True) if v is None}
            made = {p: v for p in asked if (v := self.old.get(p)) is not None}
            fresh = list(asked - made.keys())
            if any(not p or p[0].isspace() or p[-1].isspace() for p in fresh):
                return self._library(text)
            if fresh:
                made |= self._dealt(fresh)
            found = [made[p] if v is None else v for p, v in zip(rest, found, strict=True)]
            if len(self.known) + len(made) > CACHE_SIZE:
                self.old, self.known = self.known, {}
            self.known.update((p, v) for p, v in made.items() if len(p) <= CACHE_CHARS)
        return self._library(first) + b"".join(found)

    def _asked(self, parts: list[str], sizes: np.ndarray, lead: str) -> tuple[np.ndarray, np.ndarray]:
        """The ids of parts that stand apart behind ``lead``, run together, and
        how many ids each has; ``sizes`` are their lengths in bytes."""
        found, counts = [], []
        skip = len(self._ids(lead)) if lead else 0
        for at in range(0, len(parts), ASKED):
            some = parts[at : at + ASKED]
            ids = self._ids(lead + lead.join(some))
            ends = np.cumsum(self.lengths[ids])
            last = np.cumsum(sizes[at : at + ASKED] + len(lead))
            cuts = np.searchsorted(ends, last) + 1
            if cuts[-1] != len(ids) or (ends[np.minimum(cuts, len(ids)) - 1] != last).any():
                each = [self._ids(lead + p) for p in some]
                ids, cuts = np.concatenate(each), np.cumsum(list(map(len, each)))
            own = np.diff(cuts, prepend=0)
            if skip:
                inside = np.ones(len(ids), bool)
                for k in range(skip):
                    inside[cuts - own + k] = False
                ids, own = ids[inside], own - skip
            found.append(ids)
            counts.append(own)
        return np.concatenate([*found, np.zeros(0, "<u4")]), np.concatenate([*counts, np.zeros(0, np.int64)]).astype(np.int64)

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of some texts, each distinct part of them encoded once.

        A text is cut where the pattern always cuts: before a single space or
        line end, and before an ASCII mark behind a Latin letter. Texts with
        other white space, or with special strings, are encoded one by one.
        """
        column = pa.array(texts, pa.large_string())
        odd = pc.match_substring_regex(column, ODD).to_numpy(zero_copy_only=False)
        if self.cut is not None:
            odd = odd | np.array([bool(self.cut.search(t)) for t in texts], bool)
        odd |= np.array([not t for t in texts], bool)
        out: list = [np.frombuffer(self.encode(t), "<u4") if o else None for t, o in zip(texts, odd.tolist(), strict=True)]
        at = np.flatnonzero(~odd)
        if not len(at):
            return out
        cut = column.take(pa.array(at))
        for space in " \n":
            cut = pc.replace_substring(cut, space, CUT + space)
        cut = pc.replace_substring_regex(cut, BEFORE_MARK, r"\1" + CUT + r"\2")
        # Behind a line end a text's first part is like any other.
        split = pc.split_pattern(pc.binary_join_element_wise(pa.scalar("\n", pa.large_string()), cut, pa.scalar("", pa.large_string())), CUT)
        coded = split.values.dictionary_encode()
        parts, place = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        sizes = pc.binary_length(coded.dictionary).to_numpy()
        kind = np.array([" \n".find(p[0]) for p in parts], np.int8)
        pools, begin, count, total = [], np.empty(len(parts), np.int64), np.empty(len(parts), np.int64), 0
        for k, lead in ((0, ""), (1, ""), (-1, " a")):
            own = np.flatnonzero(kind == k)
            ids, n = self._asked([parts[i] for i in own.tolist()], sizes[own], lead)
            begin[own], count[own] = total + np.cumsum(n) - n, n
            pools.append(ids)
            total += len(ids)
        pool, line_end = np.concatenate(pools), len(self._ids("\n"))
        bounds = split.offsets.to_numpy()
        for i, a, b in zip(at.tolist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            n = count[place[a:b]]
            ends = np.cumsum(n)
            out[i] = pool[np.repeat(begin[place[a:b]] - ends + n, n) + np.arange(ends[-1])][line_end:]
        return out


_LOADED: dict[bytes, LibraryEncoder] = {}


def loaded(data: bytes) -> LibraryEncoder:
    key = hashlib.sha256(data).digest()
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = LibraryEncoder(data)
    return _LOADED[key]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
    """Ids and texts of about ``RUN_BYTES`` of text, or of one longer text."""
    keys, some, size = [], [], 0
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), texts(batch), strict=True):
            if some and size + len(text) > RUN_BYTES:
                yield keys, some
                keys, some, size = [], [], 0
            keys.append(doc_id)
            some.append(text)
            size += len(text)
    if some:
        yield keys, some


class _Writer:
    def __init__(self, data, folder: str, end_id: int | None, shard_bytes: int):
        self.data, self.folder, self.end_id, self.shard_bytes = data, folder, end_id, shard_bytes
        self.schema = to_arrow_schema(StructType.fromDDL(MANIFEST))

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = loaded(self.data.value)
        width = 2 if max(encoder.tokenizer.get_vocab_size(True), self.end_id or 0) <= 1 << 16 else 4
        end = np.array([] if self.end_id is None else [self.end_id], "<u4")
        task, attempt, part = TaskContext.get().partitionId(), uuid.uuid4().hex[:12], 0
        writer = ShardWriter(width)
        for keys, some in _runs(batches):
            for doc_id, ids in zip(keys, encoder.encode_all(some), strict=True):
                writer.add(key_of(doc_id), np.concatenate([ids, end]))
                if writer.size + writer.raw >= self.shard_bytes:
                    yield self._close(writer, task, part, attempt)
                    writer, part = ShardWriter(width), part + 1
        if writer.keys:
            yield self._close(writer, task, part, attempt)

    def _close(self, writer: ShardWriter, task: int, part: int, attempt: str) -> pa.RecordBatch:
        data = writer.finish()
        path = f"{self.folder}/shard-{task:06d}-{part:06d}-{attempt}.sst"
        storage.write(path, data)
        row = [path, task, part, len(writer.keys), writer.tokens, writer.keys[0], writer.keys[-1], len(data)]
        return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, self.schema, strict=True)], schema=self.schema)


def write_shards(docs: DataFrame, vocabulary_path: str, end_id: int | None = None, folder: str | None = None, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Write all documents; returns the manifest with each shard's ``start``.

    ``folder`` is a URI that the driver and all executors share; by default a
    fresh one under the checkpoint folder. ``start`` is the number of ids in
    all earlier shards; shards in ``(task, part)`` order are in id order.
    """
    spark = docs.sparkSession
    prepare(spark)
    folder = folder or scratch(spark, "sstable")
    data = spark.sparkContext.broadcast(open(vocabulary_path, "rb").read())
    # The hash only settles the order of repeated ids, and spreads them.
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    rows = plain(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("bigint"))
    # A stated number of partitions that grows with the texts: encoding costs far more than their bytes tell, so none are merged.
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text").cast("bigint")), F.lit(0))).first()[0]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK_BYTES))
    run = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "text")
    manifest = stored(run.mapInArrow(_Writer(data, folder, end_id, shard_bytes), MANIFEST), "sstable-manifest")
    # One row a shard of 32 MB: the running sum is over the manifest only.
    before = Window.orderBy("task", "part").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0)))


def read_shards(manifest: DataFrame) -> DataFrame:
    """``doc_id, start, ids`` of every entry of every shard."""
    return _read(manifest, "ids array<int>", lambda ids: {"ids": ids.astype(np.int32)})


def digest_shards(manifest: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every entry, read back."""
    return _read(manifest, "n_tokens bigint, ids_crc32 bigint", lambda ids: {"n_tokens": len(ids), "ids_crc32": zlib.crc32(ids.astype("<u4").tobytes())})


class _Reader:
    def __init__(self, schema: str, make):
        self.schema, self.make = to_arrow_schema(StructType.fromDDL(schema)), make

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = []
                for e in Shard(path).scan():
                    rows.append({"doc_id": id_of(e.key), "start": start} | self.make(e.ids))
                    start += len(e.ids)
                    if len(rows) >= 1024:
                        yield pa.RecordBatch.from_pylist(rows, schema=self.schema)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=self.schema)


def _read(manifest: DataFrame, more: str, make) -> DataFrame:
    schema = f"doc_id bigint, start bigint, {more}"
    spark = manifest.sparkSession
    spread = manifest.select("path", "start").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path")
    return spread.mapInArrow(_Reader(schema, make), schema)


def find(manifest: DataFrame, doc_ids: DataFrame) -> DataFrame:
    """The entries of the asked ids: shards by key range, then binary search.

    ``doc_ids`` has a column ``doc_id``; returns ``doc_id, ids``. An id is
    looked up in the last shard that begins at or before it, found by a look
    back in key order, and in earlier ones that end with it, by an equi-join.
    """
    order = F.concat(F.when(F.col("doc_id").isNull(), F.lit(b"\0")).otherwise(F.lit(b"\1")), F.unhex(F.lpad(F.hex(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(0)).bitwiseXOR(F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(F.lit(-(1 << 63))))), 16, "0")))
    asked = cut(plain(doc_ids, "doc_id").distinct().select(F.col("doc_id").cast("bigint").alias("doc_id"), order.alias("k")))
    begins = manifest.select(F.lit(None).cast("bigint").alias("doc_id"), F.col("first_key").alias("k"), F.lit(0).alias("kind"), "path", "task", "part")
    blank = [F.lit(None).cast(t).alias(n) for n, t in (("path", "string"), ("task", "int"), ("part", "int"))]
    events = begins.unionByName(asked.select("doc_id", "k", F.lit(1).alias("kind"), *blank))
    last = with_last(events, ["k", "kind", "task", "part"], "path", "at").where("kind = 1 and at is not null").select(F.col("at").alias("path"), "doc_id")
    ends = manifest.select("path", F.col("last_key").alias("k")).join(asked, "k").select("path", "doc_id")
    where = last.union(ends).distinct().repartition("path")

    def make():
        open_shards: dict[str, Shard] = {}

        def f(batch):
            ids, found = [], []
            for path, doc_id in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if path not in open_shards:
                    open_shards.clear()
                    open_shards[path] = Shard(path)
                for x in open_shards[path].get(doc_id):
                    ids.append(doc_id)
                    found.append(x.astype(np.int32))
            return {"doc_id": ids, "ids": found}

        return f

    return map_rows(where, ["path", "doc_id"], make, "doc_id bigint, ids array<int>")
