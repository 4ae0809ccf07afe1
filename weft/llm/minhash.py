"""Near-duplicate classes by tensored MinHash banding and exact verification.

Two collections of ``m`` sub-keys each hash ``K`` minima of a document's
shingles; table keys are all pairs of one sub-key from either collection, so
``m * m`` tables of ``2 * K`` rows cost ``2 * m * K`` minima instead of
``2 * K * m * m``. Two documents meet in some table if and only if they share a
sub-key in both collections: at the linking threshold s the chance to miss is
at most ``2 * (1 - s**K) ** m``, and ``m`` is the least number that brings this
to ``MISS`` (16 at 0.85, 23 at 0.8).

Equal shingle sets become one representative first. A table key is made only
of sub-keys that several representatives have. Representatives that meet
form groups, by way of one pivot for each table key. Groups are cut by hash
into blocks of bounded size, and full shingle sets are compared in cells of at
most two blocks by one product of 0/1 matrices: a cell sends out the classes it
joins, never its pairs. In a group of several blocks every block first meets
block 0; then members are blocked anew by class, and cells of two blocks that
already are one class are left out, so that a large class costs no more pairs
while every pair in different classes is still compared.

Results for odd input: texts without words, null texts and null ids have no
shingles in common with anything; fewer than ``N`` words are one shingle;
repeated rows and equal texts share a class; a repeated id joins the classes
of its texts; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.llm.arrow import fresh, map_rows, plain, utf8
from weft.llm.words import SPACED, groups, hashed, shingles
from weft.operators.components import components
from weft.plans.lineage import stored, temporary

#: Minima in a sub-key, and the chance that a pair at the threshold fails to meet, at most.
K, MISS = 4, 1.5e-5
#: Members and shingles that a block has on average, at most; members of the
#: blocks that meet first, of which many are enough to join a class of copies.
BLOCK_MEMBERS, BLOCK_SHINGLES, FIRST_MEMBERS = 512, 1 << 20, 64
#: Most rows of three integers in one broadcast.
BROADCAST_ROWS = 1_000_000
#: Copies that make a class hot, at least, and hot classes in one broadcast.
HOT_COPIES, HOT_CLASSES = 128, 100_000


def sub_key_count(percent: int) -> int:
    """Sub-keys in a collection for a linking threshold of ``percent``."""
    m, apart = 1, 1 - (percent / 100) ** K
    while 2 * apart**m > MISS:
        m += 1
    return m


def _functions(m: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(20240607))
    return rng.integers(0, 1 << 63, 2 * K * m, np.uint64), rng.integers(0, 1 << 63, 2 * K * m, np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(texts: list[bytes], n: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    out = []
    for a, b in groups(texts):
        h = hashed(texts[a:b], SPACED)
        at = 0
        for c in h.counts.tolist():
            own = h.hashes[at : at + c]
            out.append(np.unique(shingles(own, min(n, c))) if c else own)
            at += c
    return out


def sub_keys(sets: list[np.ndarray], m: int) -> np.ndarray:
    """``2 * m`` sub-keys of each non-empty set."""
    seeds, odds = _functions(m)
    out = np.empty((len(sets), 2 * m), np.uint64)
    sizes = [8 * len(s) for s in sets]
    start = 0
    while start < len(sets):
        end, total = start, 0
        while end < len(sets) and (end == start or total + sizes[end] <= 1 << 20):
            total += sizes[end]
            end += 1
        values = np.concatenate(sets[start:end])
        first = np.cumsum([0, *map(len, sets[start : end - 1])])
        for j in range(2 * m):
            key = np.full(end - start, j + 1, np.uint64)
            for k in range(K):
                low = np.minimum.reduceat((values ^ seeds[j * K + k]) * odds[j * K + k], first)
                key = (key ^ (key >> np.uint64(31))) * np.uint64(0x9FB21C651E98DF25) + low
            out[start:end, j] = key ^ (key >> np.uint64(29))
        start = end
    return out


def signatures(docs: DataFrame, n: int, m: int) -> DataFrame:
    """``doc_id, n_shingles, set_key, a, b`` of every document, with ``m``
    sub-keys in ``a`` and in ``b``."""

    def make():
        import xxhash

        def f(batch):
            sets = shingle_sets(utf8(batch), n)
            some = [s for s in sets if len(s)]
            keys = iter(sub_keys(some, m).view(np.int64) if some else [])
            rows = [next(keys) if len(s) else None for s in sets]
            return {
                "doc_id": batch.column(0),
                "n_shingles": [len(s) for s in sets],
                "set_key": [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets],
                "a": [r if r is None else r[:m] for r in rows],
                "b": [r if r is None else r[m:] for r in rows],
            }

        return f

    return map_rows(plain(docs, "doc_id", "text"), ["doc_id", "text"], make, "doc_id bigint, n_shingles bigint, set_key binary, a array<bigint>, b array<bigint>")


def _sets(docs: DataFrame, n: int) -> DataFrame:
    """``rep, g, s`` of documents that come with their group ``g``."""

    def make():
        def f(batch):
            return {"rep": batch.column(0), "g": batch.column(1), "s": [s.view(np.int64) for s in shingle_sets(utf8(batch), n)]}

        return f

    return map_rows(docs, ["doc_id", "g", "text"], make, "rep bigint, g bigint, s array<bigint>")


def linked_classes(sets: list[np.ndarray], labels: np.ndarray, percent: int) -> set[tuple[int, int]]:
    """Pairs of labels that links among some sets join."""
    size = np.array([len(s) for s in sets], np.int64)
    count = len(sets)
    _, token, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(count), size)
    shared = seen > 1
    column = np.cumsum(shared) - 1
    row, column = row[shared[token]], column[token[shared[token]]]
    both = np.zeros((count, count), np.float32)
    width = max(64, (1 << 23) // count)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, [start, start + width])
        part = np.zeros((count, min(width, int(column[-1]) + 1 - start)), np.float32)
        part[row[a:b], column[a:b] - start] = 1
        both += part @ part.T
    both = both.astype(np.int64)
    link = 100 * both >= percent * (size[:, None] + size[None, :] - both)
    label = labels.copy()
    while True:
        low = np.where(link, label[None, :], np.iinfo(np.int64).max).min(1)
        low = np.minimum(low, label)
        if (low == label).all():
            break
        label = low
    return {(int(a), int(b)) for a, b in zip(labels, label, strict=True) if a != b}


class _Cells:
    """Rows sorted by cell to the classes that each cell joins."""

    def __init__(self, percent: int):
        self.percent = percent

    def __call__(self, batches):
        import pyarrow as pa

        def joined(sets, labels):
            found = linked_classes(sets, np.array(labels, np.int64), self.percent) if len(sets) > 1 else ()
            return pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], ["src", "dst"])

        cell, sets, labels = None, [], []
        for batch in batches:
            flat, at = batch.column(2), 0
            values = flat.values.to_numpy(zero_copy_only=False)
            offsets = flat.offsets.to_numpy()
            for c, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if c != cell:
                    if len(sets) > 1:
                        yield joined(sets, labels)
                    cell, sets, labels = c, [], []
                sets.append(values[offsets[at] : offsets[at + 1]].copy())
                labels.append(label)
                at += 1
        if len(sets) > 1:
            yield joined(sets, labels)


def _compare(rows: DataFrame, percent: int) -> DataFrame:
    """``src, dst``: labels joined in the cells of ``cell, label, s``."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = rows.select("cell", "label", "s").repartition(parts, "cell").sortWithinPartitions("cell")
    return stored(laid.mapInArrow(_Cells(percent), "src bigint, dst bigint"), "minhash-joins")


def _small(df: DataFrame, count: int) -> DataFrame:
    """Broadcast behind a check of its rows; otherwise Spark's own choice."""
    return F.broadcast(df) if count <= BROADCAST_ROWS else df


def _checked(df: DataFrame) -> DataFrame:
    return _small(df, df.count())


def _shared(rows: DataFrame, side: str) -> DataFrame:
    """``rep`` and the sub-keys of one collection that another one has too."""
    keys = rows.select("rep", F.posexplode(side).alias("i", "v")).select("rep", F.xxhash64("i", "v").alias("k"))
    met = keys.groupBy("k").agg(F.min("rep").alias("p"), F.max("rep").alias("q")).where("p < q").select("k")
    return keys.join(met, "k", "left_semi").groupBy("rep").agg(F.collect_list("k").alias(f"s{side}"))


def _members(reps: DataFrame) -> DataFrame:
    """``rep, sa, sb``: representatives with a shared sub-key in either
    collection. No other pair of sub-keys can be a table key of two of them."""
    one = stored(_shared(reps, "a").join(reps.select("rep", "b"), "rep"), "minhash-shared")
    return one.select("rep", "sa").join(_shared(one, "b"), "rep")


def _table_groups(members: DataFrame) -> DataFrame:
    """``rep, g`` of the members that meet another in some table."""
    pair = F.explode(F.flatten(F.transform("sa", lambda p: F.transform("sb", lambda q: F.xxhash64(p, q)))))
    keys = members.select(pair.alias("key"), "rep")
    pivots = keys.groupBy("key").agg(F.min("rep").alias("src"), F.max("rep").alias("high")).where("src < high").select("key", "src")
    # A member meets at most m * m pivots: it is tied to the least of them, and that one to the others.
    met = keys.join(pivots, "key").where("src < rep").groupBy("rep").agg(F.collect_set("src").alias("all")).withColumn("src", F.array_min("all"))
    ties = met.select("src", F.col("rep").alias("dst")).union(met.select("src", F.explode("all").alias("dst")).where("src < dst").distinct())
    return components(ties).select(F.col("id").alias("rep"), F.col("component").alias("g"))


def _blocks(most: int) -> Column:
    """Blocks of ``most`` members for so many ``members`` and ``shingles``."""
    return F.greatest(F.ceil(F.col("members") / most), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int")


def _first_cells(sets: DataFrame, large: DataFrame) -> DataFrame:
    """Small groups are one cell; each block of a large one meets block 0."""
    wide = sets.join(_checked(large.select("g", "blocks")), "g", "left")
    block = F.pmod(F.xxhash64("rep"), F.col("blocks"))
    numbers = F.when(F.col("blocks").isNull(), F.array(F.lit(0))).when(block == 0, F.sequence(F.lit(1), F.col("blocks") - 1)).otherwise(F.array(block.cast("int")))
    return wide.withColumn("number", F.explode(numbers)).select(F.xxhash64("g", "number").alias("cell"), F.col("rep").alias("label"), "s")


def _second_cells(sets: DataFrame) -> DataFrame:
    """Cells of ``rep, g, label, s`` for all pairs in different classes."""
    of = sets.select("g", "label", F.size("s").alias("n")).groupBy("g", "label").agg(F.count("*").alias("members"), F.sum("n").alias("shingles"))
    # Classes of half a block get blocks of their own, the others share some.
    of = stored(of.withColumn("own", F.when((F.col("members") * 2 >= BLOCK_MEMBERS) | (F.col("shingles") * 2 >= BLOCK_SHINGLES), F.col("label"))), "minhash-classes")
    pools = of.groupBy("g", "own").agg(F.sum("members").alias("members"), F.sum("shingles").alias("shingles")).withColumn("blocks", _blocks(BLOCK_MEMBERS))
    pools = stored(pools.select("g", "own", "blocks"), "minhash-pools")
    blocks = pools.withColumn("number", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("g", "own", "number", F.xxhash64("g", "own", "number").alias("block"))
    blocks = stored(blocks, "minhash-blocks")
    left, right = (blocks.select("g", F.col("own").alias(f"own{i}"), F.col("block").alias(f"block{i}")) for i in (1, 2))
    apart = F.coalesce(F.col("own1") != F.col("own2"), F.lit(True))
    cells = left.join(right, "g").where((F.col("block1") <= F.col("block2")) & apart)
    # A pool of small classes also meets itself, alone only where it is its group.
    cells = cells.select(F.xxhash64("block1", "block2").alias("cell"), F.array_distinct(F.array("block1", "block2")).alias("two"))
    cells = stored(cells.select("cell", F.explode("two").alias("block")), "minhash-cells")
    owns = of.where("own is not null").select("g", "label", "own")
    placed = sets.join(_checked(owns), ["g", "label"], "left")
    placed = placed.join(_checked(pools.withColumnRenamed("g", "g2").withColumnRenamed("own", "own2")), (F.col("g") == F.col("g2")) & F.col("own").eqNullSafe(F.col("own2")))
    placed = placed.withColumn("block", F.xxhash64("g", "own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))).select("block", "label", "s")
    return placed.join(_checked(cells), "block").select("cell", "label", "s")


def near_duplicates(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every document.

    Documents link when 100 * intersection >= ``percent`` * union of their
    ``n``-word shingle sets; ``component_id`` is the smallest id reachable and
    ``kept`` marks that document. The tables in between, full shingle sets
    among them, are deleted once the result is stored.
    """
    with temporary(docs.sparkSession) as keep:
        return keep(_near_duplicates(docs, n, percent), "minhash-result")


def _near_duplicates(docs: DataFrame, n: int, percent: int) -> DataFrame:
    docs = plain(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("bigint"))
    sig = stored(signatures(docs, n, sub_key_count(percent)), "minhash-signatures")
    full = sig.where("doc_id is not null and set_key is not null")
    classes = full.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("a").alias("a"), F.first("b").alias("b"))
    reps = stored(classes, "minhash-representatives")
    members = stored(_members(reps), "minhash-members")
    grouped = stored(_table_groups(members), "minhash-groups")
    met = grouped.count()
    if not met:
        return _result(sig, reps, None)
    sets = stored(_sets(docs.join(_small(grouped.withColumnRenamed("rep", "doc_id"), met), "doc_id"), n), "minhash-sets")

    sizes = sets.select("g", F.size("s").alias("n")).groupBy("g").agg(F.count("*").alias("members"), F.sum("n").alias("shingles"))
    # Only groups of more than one block: each has FIRST_MEMBERS rows or more.
    large = stored(sizes.withColumn("blocks", _blocks(min(FIRST_MEMBERS, BLOCK_MEMBERS))).where("blocks > 1").select("g", "blocks"), "minhash-large")
    joins = _compare(_first_cells(sets, large), percent)
    labels = _labels(joins)
    if not large.isEmpty():
        wide = sets.join(_checked(large.select("g")), "g", "left_semi")
        known = wide.join(labels, "rep", "left").select("rep", "g", F.coalesce("label", "rep").alias("label"), "s") if labels is not None else wide.withColumn("label", F.col("rep"))
        more = _compare(_second_cells(known), percent)
        if not more.isEmpty():
            labels = _labels(joins.unionByName(more))
    return _result(sig, reps, labels)


def _labels(joins: DataFrame) -> DataFrame | None:
    """``rep, label`` of the representatives that some link joins."""
    if joins.isEmpty():
        return None
    return components(joins).select(F.col("id").alias("rep"), F.col("component").alias("label"))


def _named(sig: DataFrame, reps: DataFrame, labels: DataFrame | None) -> DataFrame:
    """``doc_id, n_shingles, component_id`` by the documents' shingle sets.

    Classes are named first, one row each. Those of very many copies are
    broadcast; their number is bounded, since the least count of copies is
    doubled until they are few. All others are joined by a shuffle in which
    no key has more rows than that count: documents that need no name, or have
    it already, are spread by their id.
    """
    named = reps.select("set_key", "rep", "copies")
    if labels is not None:
        named = named.join(labels, "rep", "left").select("set_key", "rep", "copies", F.coalesce("label", "rep").alias("name"))
    else:
        named = named.withColumn("name", F.col("rep"))
    named = stored(named.where("copies > 1 or name <> rep").select("set_key", "copies", "name"), "minhash-names")
    least = HOT_COPIES
    while (hot := named.where(F.col("copies") >= least)).count() > HOT_CLASSES:
        least *= 2
    known = sig.select("doc_id", "n_shingles", "set_key").join(F.broadcast(hot.select("set_key", F.col("name").alias("hot"))), "set_key", "left")
    spread = F.unhex(F.hex(F.xxhash64("doc_id", "n_shingles")))
    known = known.withColumn("key", F.coalesce(F.when(F.col("hot").isNull() & F.col("doc_id").isNotNull(), F.col("set_key")), spread))
    others = named.where(F.col("copies") < least).select(F.col("set_key").alias("key"), "name")
    name = F.when(F.col("doc_id").isNotNull(), F.coalesce("hot", "name", "doc_id"))
    return known.join(others, "key", "left").select("doc_id", "n_shingles", name.alias("component_id"))


def _result(sig: DataFrame, reps: DataFrame, labels: DataFrame | None) -> DataFrame:
    rows = _named(sig, reps, labels)
    # A repeated id may stand in several classes: they are one.
    bridges = rows.where("doc_id is not null").groupBy("doc_id").agg(F.min("component_id").alias("src"), F.max("component_id").alias("dst"), F.collect_set("component_id").alias("all")).where("src < dst")
    bridges = stored(bridges.select("src", F.explode("all").alias("dst")), "minhash-bridges")
    if not bridges.isEmpty():
        rows = rows.join(components(bridges).select(F.col("id").alias("component_id"), F.col("component").alias("new")), "component_id", "left").select("doc_id", "n_shingles", F.coalesce("new", "component_id").alias("component_id"))
    return rows.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def deduplicate(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """The documents that are kept, in their own columns: one of each class.

    Of rows with one id, the one with the smallest text hash stays; rows
    without an id all stay.
    """
    found = near_duplicates(docs, n, percent).where("doc_id is not null")
    key, mark, row = (fresh(c, docs.columns) for c in ("id", "hash", "row"))
    gone = found.where(~F.col("kept")).select(F.col("doc_id").alias(key)).distinct()
    twice = stored(found.groupBy(F.col("doc_id").alias(key)).count().where("count > 1").select(key), "minhash-repeated")
    removed = found.where(~F.col("kept")).count()
    at = F.col("doc_id") == F.col(key)
    left = docs.join(_small(gone, removed), at, "left_anti")
    if twice.isEmpty():
        return left
    once = left.join(twice, at, "left_anti")
    again = left.join(twice, at, "left_semi")
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    first = again.withColumn(mark, F.xxhash64("text")).groupBy(F.col("doc_id").alias(key)).agg(F.min_by(whole, mark).alias(row))
    return once.unionByName(first.select(*[F.col(f"{row}.`{c}`").alias(c) for c in docs.columns]))
