"""Global positions and neighbours in an order, without one global sort.

Rows are range-partitioned, sorted and checkpointed; only one number for each
partition is summed up, whatever the keys look like. Keys need not be dense.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.plans.lineage import cut

#: Dense positions in a bucket of running sums.
BUCKET = 1 << 16


def _laid_out(df: DataFrame, order: list, tasks: int | None = None) -> tuple[DataFrame, list[int]]:
    """``df`` sorted over its partitions with ``_part`` and ``_place``, and the
    rows of each partition; ``tasks`` are the session's by default."""
    # The checkpoint fixes the partitions, which a repeated sampling of the ranges could move.
    laid = cut(df.repartitionByRange(*([tasks] if tasks else []), *order).sortWithinPartitions(*order)).withColumn("_at", F.monotonically_increasing_id())
    placed = laid.withColumns({"_part": F.shiftright("_at", 33).cast("int"), "_place": F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))}).drop("_at")
    counts = {r["_part"]: r["n"] for r in placed.groupBy("_part").agg(F.count("*").alias("n")).collect()}
    return placed, [counts.get(i, 0) for i in range(max(counts, default=-1) + 1)]


def _of_part(values: list, kind: str = "bigint") -> Column:
    """The value that belongs to a row's partition."""
    return F.get(F.array(*[F.lit(v).cast(kind) for v in values]), F.col("_part")) if values else F.lit(None).cast(kind)


def _numbered(df: DataFrame, order: list, name: str, tasks: int | None = None) -> tuple[DataFrame, int]:
    """``counted_ordinal`` with the partition ``_part`` of each row."""
    placed, sizes = _laid_out(df, order, tasks)
    before = [0, *accumulate(sizes)]
    return placed.withColumn(name, _of_part(before[:-1]) + F.col("_place")).drop("_place"), before[-1]


def counted_ordinal(df: DataFrame, *order: str | Column, name: str = "k") -> tuple[DataFrame, int]:
    """``df`` with the 0-based place of each row in the order, and its rows."""
    numbered, rows = _numbered(df, list(order), name)
    return numbered.drop("_part"), rows


def ordinal_in_parts(df: DataFrame, *order: str | Column, name: str = "k", tasks: int | None = None) -> DataFrame:
    """``with_ordinal`` over ``tasks`` ranges, with the range ``_part`` of each row."""
    return _numbered(df, list(order), name, tasks)[0]


def with_ordinal(df: DataFrame, *order: str | Column, name: str = "k") -> DataFrame:
    """``df`` with the 0-based place of each row in the order; ties are
    ordered arbitrarily."""
    return counted_ordinal(df, *order, name=name)[0]


def with_next(df: DataFrame, key: str, value: str, name: str, tasks: int | None = None) -> DataFrame:
    """``df`` with ``value`` of the following row in the order of ``key``."""
    placed, sizes = _laid_out(df, [key], tasks)
    first = {r["_part"]: r["v"] for r in placed.where("_place = 0").select("_part", F.col(value).alias("v")).collect()}
    far: list = []
    following = None
    for i in reversed(range(len(sizes))):
        far.append(following)
        following = first[i] if sizes[i] else following
    last = F.col("_place") == _of_part([n - 1 for n in sizes])
    near = F.lead(value).over(Window.partitionBy("_part").orderBy("_place"))
    kind = df.schema[value].dataType.simpleString()
    return placed.withColumn(name, F.when(last, _of_part(far[::-1], kind)).otherwise(near)).drop("_part", "_place")


def with_last(df: DataFrame, order: list, value: str, name: str) -> DataFrame:
    """``df`` with the last ``value`` that is not null, up to each row in the
    order: an as-of join's look back, by ranges instead of pairs."""
    placed, sizes = _laid_out(df, order)
    known = placed.where(F.col(value).isNotNull()).groupBy("_part").agg(F.max_by(value, "_place").alias("v"))
    last = {r["_part"]: r["v"] for r in known.collect()}
    before: list = []
    for i in range(len(sizes)):
        before.append(last.get(i - 1, before[-1] if before else None))
    inside = F.last(value, ignorenulls=True).over(Window.partitionBy("_part").orderBy("_place"))
    kind = df.schema[value].dataType.simpleString()
    return placed.withColumn(name, F.coalesce(inside, _of_part(before, kind))).drop("_part", "_place")
