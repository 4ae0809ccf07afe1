"""Lineage control and code shipping shared by every operator.

Iterative operators cut their lineage with a reliable ``checkpoint()``: the
files live in the folder the cluster names in ``spark.checkpoint.dir``, so a
lost executor costs a re-read and never a result. A folder of our own is set
only where that setting is absent and the master is local, as in tests; on a
cluster an unset folder is an error.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_SHIPPED: set[str] = set()
#: Folders that this driver has named, for ``clear_scratch``.
_SCRATCH: list[str] = []
#: Checkpoint folders of the open ``temporary`` blocks, and an application's own one.
_FOLDERS: list[str] = []
_OWN: dict[str, str] = {}


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder; a private one only where none is named."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
            spark.sparkContext.setCheckpointDir(named)
        return named
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not current.isEmpty():
            _OWN[app] = current.get()
        elif not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        else:
            _OWN[app] = Path(tempfile.mkdtemp(prefix="weft-checkpoint-")).as_uri()
            spark.sparkContext.setCheckpointDir(_OWN[app])
    return _OWN[app]


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder name under the shared checkpoint folder."""
    _SCRATCH.append(f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}")
    return _SCRATCH[-1]


def _delete(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Checkpoints and scratch tables made inside are deleted at its end.

    Gives a function that stores a result so that it outlives the rest. What
    was made before is not touched; an outer one deletes what an inner kept.
    """
    base = checkpoint_dir(spark)
    start, kept = len(_SCRATCH), []
    _FOLDERS.append(scratch(spark, "rounds"))
    spark.sparkContext.setCheckpointDir(_FOLDERS[-1])

    def keep(df: DataFrame, name: str) -> DataFrame:
        out = stored(df, name)
        kept.append(_SCRATCH[-1])
        return out

    try:
        yield keep
    finally:
        _FOLDERS.pop()
        spark.sparkContext.setCheckpointDir(_FOLDERS[-1] if _FOLDERS else base)
        gone = [p for p in _SCRATCH[start:] if p not in kept]
        _SCRATCH[start:] = kept
        for path in gone:
            _delete(spark, path)


def clear_scratch(spark: SparkSession) -> int:
    """Delete the scratch folders of this driver; results that still read them
    must have been written before. Returns how many there were."""
    done = 0
    while _SCRATCH:
        done += _delete(spark, _SCRATCH.pop())
    return done


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """Reliable checkpoint of ``df``: materialises it and drops its lineage."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


def counted(df: DataFrame, **more: Column) -> tuple[DataFrame, dict]:
    """``cut`` with the ``rows`` and further aggregates of the table, seen by
    the job that writes it, so that a round needs no second one."""
    checkpoint_dir(df.sparkSession)
    seen = Observation()
    out = df.observe(seen, F.count(F.lit(1)).alias("rows"), *[c.alias(n) for n, c in more.items()]).checkpoint()
    return out, seen.get


def stored(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back; ``codec``
    is the pages' compression, the session's by default.

    Preferred over ``cut`` for wide rows: columnar, compressed, and later
    readers still prune columns.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Make this package importable in the executors' Python workers.

    A zip of the package's sources is handed to Spark's own file server once
    per application, so that no executor needs the driver's folders.
    """
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[1]
    target = os.path.join(tempfile.mkdtemp(prefix="weft-src-"), f"{root.name}.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(p.relative_to(root.parent)))
    spark.sparkContext.addPyFile(target)
    _SHIPPED.add(app)
