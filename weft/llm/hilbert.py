"""Shards along a Hilbert curve through document metadata.

Each dimension is quantised to ``BITS`` bits: numbers by quantiles, names by
the quantiles of their rows in alphabetical order among the most frequent names
(others by a hash). The curve index
orders the rows and runs of it are cut into shards whose row counts differ by
at most one, so that a shard's files span a narrow range of every dimension.

Ranks are global without a global sort on one task: the narrow rows are range
partitioned, sorted and checkpointed, partitions are counted, and each row adds
its partition's offset to its place.

Results for odd input: a null text has no bytes (its size is the ``OVERHEAD``
alone) and the CRC of nothing; nulls in a dimension come first; repeated rows
get neighbouring slots; with fewer rows than shards some shards are empty; an
empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.llm.arrow import fresh, prepare
from weft.plans.lineage import stored
from weft.plans.ordinal import counted_ordinal

BITS, OVERHEAD = 6, 16


def hilbert_index(points: np.ndarray, bits: int) -> np.ndarray:
    """Distances along the curve of integer points, one a row.

    Transposes the coordinates to the curve's Gray code (Skilling, 2004) and
    interleaves their bits, most significant first.
    """
    x = points.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(n):
            swap = np.where(x[i] & q, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(x[i] & q, low, swap)
            if i:
                x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        turn ^= np.where(x[n - 1] & q, q - 1, 0)
        q >>= 1
    x ^= turn
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = out << 1 | (x[i] >> b) & 1
    return out


def _number(df: DataFrame, name: str, bits: int) -> Column:
    """Quantile bucket of a numeric column, by its cut points."""
    cells = (1 << bits) - 1
    points = df.approxQuantile(name, [(i + 1) / (cells + 1) for i in range(cells)], 0.002)
    points = sorted(set(points))
    if not points:
        return F.lit(0)
    # Cells above the i-th cut point; nulls are cell 0.
    return F.coalesce(F.aggregate(F.array(*[F.lit(float(p)) for p in points]), F.lit(0), lambda a, p: a + (F.col(f"`{name}`").cast("double") > p).cast("int")), F.lit(0))


def _name(df: DataFrame, name: str, bits: int) -> Column:
    """Quantile bucket of a name among the most frequent names in alphabetical
    order, weighted by their rows, so that the names fill the dimension
    however few they are; other names by a hash."""
    cells = (1 << bits) - 1
    top = df.where(F.col(f"`{name}`").isNotNull()).groupBy(F.col(f"`{name}`").alias("v")).count().orderBy(F.desc("count"), "v").limit(cells).collect()
    known = sorted((r["v"], r["count"]) for r in top)
    total = sum(n for _, n in known)
    before = [0, *accumulate(n for _, n in known)]
    other = F.when(F.col(f"`{name}`").isNull(), F.lit(0)).otherwise(1 + F.pmod(F.xxhash64(f"`{name}`"), F.lit(cells)).cast("int"))
    if not known:
        return other
    places = F.create_map(*[F.lit(x) for i, (v, _) in enumerate(known) for x in (v, 1 + before[i] * cells // total)])
    return F.coalesce(F.try_element_at(places, F.col(f"`{name}`")), other)


def curve(df: DataFrame, dimensions: list[str], bits: int = BITS, name: str = "h") -> DataFrame:
    """``df`` with its curve index over the named columns."""
    prepare(df.sparkSession)
    kinds = dict(df.dtypes)
    cells = [(_name if kinds[d] == "string" else _number)(df, d, bits).cast("int") for d in dimensions]

    @F.pandas_udf("bigint")
    def index(*columns: pd.Series) -> pd.Series:
        return pd.Series(hilbert_index(np.stack([c.to_numpy() for c in columns], 1), bits))

    return df.withColumn(name, index(*cells))


def assign(docs: DataFrame, dimensions: list[str], shards: int) -> DataFrame:
    """``doc_id, size, text_crc32, h, rank, shard, slot`` of every document.

    ``dimensions`` may name columns of ``docs`` or ``size``.
    """
    names = list(dict.fromkeys(["doc_id", *(d for d in dimensions if d != "size")]))
    raw = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    narrow = docs.select(*[F.col(f"`{n}`") for n in names], (F.octet_length(raw) + OVERHEAD).cast("bigint").alias("size"), F.crc32(raw).alias("text_crc32"))
    narrow = stored(narrow, "hilbert-rows")
    marked = stored(curve(narrow, dimensions).select("doc_id", "size", "text_crc32", "h"), "hilbert-curve")
    order = [F.col("h").asc(), F.col("doc_id").asc_nulls_first(), F.col("text_crc32").asc(), F.col("size").asc(), F.monotonically_increasing_id()]
    rows, total = counted_ordinal(marked, *order, name="rank")
    shard = F.expr(f"cast((rank * {shards}) div {max(1, total)} as int)")
    first = F.expr(f"(cast(shard as bigint) * {total} + {shards - 1}) div {shards}")
    return rows.withColumn("shard", shard).withColumn("slot", F.col("rank") - first)


def report(docs: DataFrame, shards: int = 40) -> DataFrame:
    """The shard of every document, by the law of equal row counts."""
    found = assign(docs, ["source", "lang", "size", "doc_id"], shards)
    return found.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), F.col("h").alias("curve_index"))


def write_clustered(docs: DataFrame, path: str, dimensions: list[str], files: int) -> None:
    """Write all columns as Parquet files along the curve, for pruning. Rows
    of one cell of the curve may be cut into several files."""
    h, spread = (fresh(c, docs.columns) for c in ("h", "spread"))
    added = "size" in dimensions and "size" not in docs.columns
    with_size = docs.withColumn("size", F.octet_length(F.coalesce("text", F.lit(""))).cast("bigint") + OVERHEAD) if added else docs
    laid = curve(with_size, dimensions, name=h).withColumn(spread, F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns if docs.schema[c].dataType.typeName() != "map"]))
    laid = laid.repartitionByRange(files, h, spread).sortWithinPartitions(h)
    laid.select(*[F.col(f"`{c}`") for c in docs.columns]).write.parquet(path)
