"""Boilerplate lines by their site-relative frequency.

For each host, the documents that contain a line are divided by the host's
documents; lines above ``ratio`` that at least ``least`` documents contain are
dropped everywhere on that host. Lines are compared without blanks at either
end; empty lines are never counted or dropped.

Lines travel as 128-bit hashes and are counted with map-side combination, so a
host with very many documents, or a line on every page, is summed up before
the shuffle. What is flagged on a host is at most its lines over ``ratio``, so
the flagged table is small beside the documents; it is broadcast only behind a
check of its rows, and otherwise joined by host and a salt.

Results for odd input: a null text stays null and counts as a document; a null
host is one more host; a document whose lines are all dropped has an empty
text; repeated rows count each; further columns are kept by ``deduplicate``
and ignored by ``report``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.llm.arrow import fresh, plain
from weft.plans.lineage import stored

RATIO, LEAST = 0.1, 10
#: Most flagged lines (40 bytes each) in one broadcast.
BROADCAST_LINES = 500_000
#: Tasks that the pages of a host are dealt to where its lines are not broadcast.
SALTS = 32
BLANKS = " \t\r"


def _key(line: Column) -> Column:
    bare = F.btrim(line, F.lit(BLANKS))
    return F.when(bare != "", F.struct(F.xxhash64(bare).alias("p"), F.xxhash64(bare, F.lit(1)).alias("q")))


def _keys(text: Column) -> Column:
    return F.transform(F.split(text, "\n", -1), _key)


def flagged(docs: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, least: int = LEAST) -> DataFrame:
    """``host, lines``: the keys of each host's boilerplate lines."""
    rows = docs.select(F.col(f"`{host}`").alias("host"), F.col(f"`{text}`").alias("text"))
    total = rows.groupBy("host").agg(F.count("*").alias("docs"))
    each = rows.select("host", F.explode(F.array_distinct(_keys(F.col("text")))).alias("k")).where("k is not null")
    seen = each.groupBy("host", "k").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    total = total.where(F.col("docs") >= least).withColumnRenamed("host", "host2")
    over = seen.join(total, F.col("host").eqNullSafe(F.col("host2"))).where(F.col("n") > F.col("docs") * F.lit(ratio))
    return over.groupBy("host").agg(F.collect_list("k").alias("lines"), F.count("*").alias("n"))


def _marked(docs: DataFrame, host: str, text: str, ratio: float, least: int) -> tuple[DataFrame, str]:
    """``docs`` with one more column, and its name: the keys of the flagged
    lines of a row's host."""
    found = stored(flagged(docs, host, text, ratio, least), "boilerplate")
    size = found.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    other, lines = fresh("host", docs.columns), fresh("lines", docs.columns)
    side = found.select(F.col("host").alias(other), F.col("lines").alias(lines))
    if size <= BROADCAST_LINES:
        return docs.join(F.broadcast(side), F.col(f"`{host}`").eqNullSafe(F.col(other)), "left"), lines
    # A host's pages are dealt to several tasks, each with a copy of its lines.
    salt, copy = fresh("salt", docs.columns), fresh("copy", docs.columns)
    side = side.withColumn(copy, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = docs.withColumn(salt, F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    return dealt.join(side, F.col(f"`{host}`").eqNullSafe(F.col(other)) & (F.col(salt) == F.col(copy)), "left"), lines


def _kept(text: str, lines: str) -> Column:
    def stays(line: Column) -> Column:
        return ~F.coalesce(F.array_contains(F.col(lines), _key(line)), F.lit(False))

    return F.when(F.col(lines).isNull(), F.split(f"`{text}`", "\n", -1)).otherwise(F.filter(F.split(f"`{text}`", "\n", -1), stays))


def deduplicate(docs: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, least: int = LEAST) -> DataFrame:
    """The documents without their hosts' boilerplate lines, same columns."""
    marked, lines = _marked(docs, host, text, ratio, least)
    new = F.when(F.col(f"`{text}`").isNotNull(), F.array_join(_kept(text, lines), "\n")).alias(text)
    return marked.select(*[new if c == text else F.col(f"`{c}`") for c in docs.columns])


def report(docs: DataFrame, host: str = "source", ratio: float = RATIO, least: int = LEAST) -> DataFrame:
    """``doc_id, host, n_lines, n_dropped, text`` of every document."""
    marked, lines = _marked(plain(docs, "doc_id", host, "text"), host, "text", ratio, least)
    marked = marked.withColumn("_kept", _kept("text", lines))
    count = F.coalesce(F.size(F.split("text", "\n", -1)), F.lit(0)).cast("bigint")
    count = F.when(F.col("text").isNull(), F.lit(0)).otherwise(count).cast("bigint")
    dropped = F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size(F.split("text", "\n", -1)) - F.size("_kept")).cast("bigint")
    return marked.select("doc_id", F.col(f"`{host}`").alias("host"), count.alias("n_lines"), dropped.alias("n_dropped"), F.array_join("_kept", "\n").alias("text"))


#: The same in DuckDB, over whole lines.
SQL = f"""
WITH each AS (
  SELECT source, row_id, btrim_line AS line FROM (
    SELECT DISTINCT source, row_id, trim(u.line, ' ' || chr(9) || chr(13)) AS btrim_line
    FROM (SELECT source, row_id, unnest(string_split(text, chr(10))) AS line FROM (SELECT *, row_number() OVER () AS row_id FROM documents)) u
  ) WHERE btrim_line <> ''
), seen AS (SELECT source, line, count(*) AS n FROM each GROUP BY source, line HAVING count(*) >= {LEAST}),
total AS (SELECT source, count(*) AS docs FROM documents GROUP BY source),
over_ratio AS (
  SELECT s.source, list(s.line) AS lines FROM seen s JOIN total t ON s.source IS NOT DISTINCT FROM t.source
  WHERE s.n > t.docs * {RATIO} GROUP BY s.source
), kept AS (
  SELECT d.doc_id, d.source AS host, d.text AS whole, string_split(d.text, chr(10)) AS lines,
         CASE WHEN o.lines IS NULL THEN string_split(d.text, chr(10))
              ELSE list_filter(string_split(d.text, chr(10)), lambda x: NOT list_contains(o.lines, trim(x, ' ' || chr(9) || chr(13)))) END AS k
  FROM documents d LEFT JOIN over_ratio o ON d.source IS NOT DISTINCT FROM o.source
)
SELECT doc_id, host, CASE WHEN whole IS NULL THEN 0 ELSE len(lines) END AS n_lines,
       CASE WHEN whole IS NULL THEN 0 ELSE len(lines) - len(k) END AS n_dropped,
       array_to_string(k, chr(10)) AS text
FROM kept
"""
