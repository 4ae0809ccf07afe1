"""Rounds over a state table: the frame of all iterative operators.

A round is one plan of joins and aggregations, cut by a reliable checkpoint.
The two exceptions are stated where they stand: walks that are sequential by
nature run in one task behind a check of their size, and an operator's
``local_edges`` lets a caller who knows that a graph is small skip the rounds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.plans.lineage import counted, cut, ship

#: Most ids (eight bytes each) in one broadcast.
BROADCAST_IDS = 1_000_000
#: Most edges (eight bytes each) of a walk that only one task can take.
SEQUENTIAL_EDGES = 200_000_000


#: Rows of a round up to which its fixed cost is what counts, and rows a task.
#: A table of so few rows is also broadcast, so that no hub is a task's key.
QUICK_ROWS, TASK_ROWS = BROADCAST_IDS, 250_000


@contextmanager
def sized(spark: SparkSession, rows: int) -> Iterator[None]:
    """Plan rounds over so many rows: a few tasks and no re-planning between
    stages where the rows are few, else the session's own settings. Plans
    differ, results do not."""
    names = ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")
    old = [spark.conf.get(n) for n in names]
    if rows <= QUICK_ROWS:
        spark.conf.set(names[0], "false")
        spark.conf.set(names[1], str(max(1, min(int(old[1]), -(-rows // TASK_ROWS)))))
    try:
        yield
    finally:
        for n, v in zip(names, old, strict=True):
            spark.conf.set(n, v)


class TooLarge(ValueError):
    """A sequential walk over more edges than one task may take."""


def is_small(edges: int, local_edges: int | None) -> bool:
    """Whether the caller allows one task for so many edges; by default never."""
    return bool(local_edges) and edges <= local_edges


def small(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast behind a check of the counted rows; else Spark's own choice."""
    return F.broadcast(df) if rows <= BROADCAST_IDS else df


def one_task(df: DataFrame, run: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``run`` over all rows of a table whose size is bounded or checked."""
    ship(df.sparkSession)
    names = df.columns

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = list(batches)
        yield run(pd.concat(parts, ignore_index=True) if parts else pd.DataFrame({n: [] for n in names}))

    return df.repartition(1).mapInPandas(whole, schema)


def sequential(edges: DataFrame, rows: int, run: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """A walk with no parallel form over ``rows`` edges, batch by batch in one
    task; raises over its limit."""
    if rows > SEQUENTIAL_EDGES:
        raise TooLarge(f"{rows} edges in a sequential walk, at most {SEQUENTIAL_EDGES}")
    ship(edges.sparkSession)
    return edges.repartition(1).mapInPandas(run, schema)


def rounds(state: DataFrame, step: Callable[[DataFrame, int], DataFrame | None], most: int = 100_000) -> DataFrame:
    """Apply ``step`` until it returns None; each state is checkpointed."""
    for i in range(most):
        following = step(state, i)
        if following is None:
            return state
        state = cut(following)
    raise RuntimeError(f"no fixpoint in {most} rounds")


def superstep(state: DataFrame, edges: DataFrame, send: dict, merge: dict, apply: dict) -> DataFrame:
    """One vertex-program step with Column expressions.

    ``send`` makes message columns from the columns of ``state`` (as ``id`` and
    its values) and of ``edges``; ``merge`` aggregates them for each ``dst``;
    ``apply`` makes the new values from the old ones and the merged messages,
    null where none arrived.
    """
    sent = edges.join(state, F.col("src") == F.col("id")).select("dst", *[c.alias(n) for n, c in send.items()])
    merged = sent.groupBy(F.col("dst").alias("_to")).agg(*[c.alias(n) for n, c in merge.items()])
    met = state.join(merged, state["id"] == merged["_to"], "left")
    return met.select("id", *[c.alias(n) for n, c in apply.items()])
