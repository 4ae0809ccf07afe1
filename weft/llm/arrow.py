"""Bounded Arrow batches for the operators that run Python on executors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from weft.plans.lineage import ship

#: Rows in one Arrow batch. A worker holds one batch and what it makes of it.
BATCH_ROWS = 512


def prepare(spark: SparkSession) -> None:
    """Ship the package and bound the batches that workers receive."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def map_rows(df: DataFrame, columns: list, make: Callable[[], Callable], schema: str) -> DataFrame:
    """``mapInArrow`` over the named columns.

    ``make()`` runs once a partition and returns a function from a record
    batch to a dict of column name to list or array.
    """
    prepare(df.sparkSession)
    return df.select(*columns).mapInArrow(_Mapper(make, schema), schema)


class _Mapper:
    def __init__(self, make: Callable[[], Callable], schema: str):
        self.make = make
        self.schema = to_arrow_schema(StructType.fromDDL(schema))

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, f = self.schema, self.make()
        for batch in batches:
            if batch.num_rows:
                out = f(batch)
                if out is not None:
                    yield pa.RecordBatch.from_arrays([pa.array(out[n], schema.field(n).type) for n in schema.names], schema=schema)


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The texts of a batch; null is the empty text."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def utf8(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """The UTF-8 bytes of the texts of a batch; null is the empty text."""
    column = batch.column(batch.schema.get_field_index(name))
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def plain(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that further ones cannot clash."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def fresh(name: str, taken: list[str]) -> str:
    """A column name like ``name`` that is none of ``taken``."""
    low = {c.lower() for c in taken}
    name = f"_{name}"
    while name.lower() in low:
        name += "_"
    return name
