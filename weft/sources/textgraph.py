"""Text formats: adjacency lists, edge lists, vertex lists and solutions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from weft.operators.model import EDGES, Graph, adjacency, reverse
from weft.plans.ordinal import with_ordinal

LINES = StructType([StructField("value", StringType())])


def numbers(value="value"):
    """Every signed integer of a line; anything else separates."""
    return F.transform(F.regexp_extract_all(value, F.lit(r"(-?\d+)"), 1), lambda x: x.cast("bigint"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``pos, value``: lines with their place over all files of ``path``.

    A split's lines are numbered inside it; one row a split is summed up.
    """
    lines = spark.read.schema(LINES).text(path).select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"))
    lines = lines.withColumn("m", F.monotonically_increasing_id())
    counts = lines.groupBy("f", "b").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("f", "b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("f", "b", before.alias("o"))
    place = F.row_number().over(Window.partitionBy("f", "b").orderBy("m")) - 1
    return lines.withColumn("p", place).join(offsets, ["f", "b"]).select((F.col("o") + F.col("p")).cast("bigint").alias("pos"), "value")


def read_int_rows(spark: SparkSession, path: str) -> DataFrame:
    """``pos, numbers`` up to the first empty line."""
    rows = numbered_lines(spark, path)
    end = rows.where("trim(value) = ''").agg(F.min("pos").alias("end"))
    return rows.join(F.broadcast(end)).where("end is null or pos < end").select("pos", numbers().alias("numbers"))


def read_adjacency(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The header (``n_vertices, n_edges``) and ``pos, id, neighbours``."""
    rows = read_int_rows(spark, path)
    head = rows.where("pos < 2").agg(F.max(F.when(F.col("pos") == 0, F.col("numbers")[0])).alias("n_vertices"), F.max(F.when(F.col("pos") == 1, F.col("numbers")[0])).alias("n_edges"))
    body = rows.where("pos >= 2").select((F.col("pos") - 2).alias("pos"), F.col("numbers")[0].alias("id"), F.array_sort(F.array_distinct(F.slice("numbers", 2, F.greatest(F.size("numbers") - 1, F.lit(0))))).alias("neighbours"))
    return head, body


def graph_of(body: DataFrame) -> Graph:
    return Graph.of(body.select(F.col("id").alias("src"), F.explode("neighbours").alias("dst")), body.select("id"))


def read_edges(spark: SparkSession, path: str, separator: str) -> DataFrame:
    """Distinct edges of a tab or comma separated list; ``#`` starts a comment."""
    return spark.read.csv(path, sep=separator, schema=EDGES, comment="#", mode="FAILFAST").distinct()


def load_graph(spark: SparkSession, path: str, parts: int) -> Graph:
    """A tab separated edge list, partitioned by source and persisted until
    ``release_graph``."""
    from pyspark import StorageLevel

    edges = read_edges(spark, path, "\t").repartition(parts, "src").persist(StorageLevel.MEMORY_AND_DISK)
    return Graph.of(edges)


def release_graph(graph: Graph) -> None:
    """Give back what ``load_graph`` keeps."""
    graph.edges.unpersist()


def read_vertices(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LINES).text(path).select(F.explode(numbers()).alias("id"))


def read_solution(spark: SparkSession, path: str, start: int = 0, end: int | None = None) -> DataFrame:
    """``i, value`` of a range of a solution's first line; an error where the
    line is shorter than the range."""
    line = numbered_lines(spark, path).where("pos = 0").select(numbers().alias("v"))
    if end is not None:
        short = F.raise_error(F.format_string("a solution of %d values has no value %d", F.size("v"), F.lit(end - 1))).cast("array<bigint>")
        line = line.select(F.when(F.size("v") < end, short).otherwise(F.col("v")).alias("v"))
    values = line.select(F.posexplode("v").alias("i", "value")).where(F.col("i") >= start)
    return values if end is None else values.where(F.col("i") < end)


def read_bfs_solution(spark: SparkSession, path: str, start: int = 0, end: int | None = None) -> DataFrame:
    """``i, dist, pred_node, pred_local``, of a range of vertices if asked."""
    rows = read_int_rows(spark, path)
    dist = rows.where("pos = 0").select(F.posexplode("numbers").alias("i", "dist"))
    pred = rows.where("pos > 0").select((F.col("pos") - 1).cast("int").alias("i"), F.col("numbers")[0].cast("int").alias("pred_node"), F.col("numbers")[1].alias("pred_local"))
    whole = dist.join(pred, "i").where(F.col("i") >= start)
    return whole if end is None else whole.where(F.col("i") < end)


def adjacency_lines(graph: Graph) -> DataFrame:
    """``pos, line``: vertex count, directed edge count, then one vertex a line."""
    lists = adjacency(graph)
    body = with_ordinal(lists, "id", name="pos").select((F.col("pos") + 2).alias("pos"), F.concat_ws(" ", F.array_prepend(F.col("neighbours"), F.col("id"))).alias("line"))
    head = lists.agg(F.count("*").alias("v"), F.coalesce(F.sum(F.size("neighbours")), F.lit(0)).alias("e"))
    head = head.select(F.explode(F.array(F.struct(F.lit(0).cast("bigint").alias("pos"), F.col("v").cast("string").alias("line")), F.struct(F.lit(1).cast("bigint").alias("pos"), F.col("e").cast("string").alias("line")))).alias("r")).select("r.*")
    return head.unionByName(body)


def edge_lines(edges: DataFrame, separator: str) -> DataFrame:
    """Each edge of a half list twice, once each way."""
    return edges.unionByName(reverse(edges)).select(F.concat_ws(separator, "src", "dst").alias("line"))


def vertex_line(vertices: DataFrame) -> DataFrame:
    """The format's single line: all ids, ascending."""
    return vertices.agg(F.array_join(F.array_sort(F.collect_list("id")).cast("array<string>"), ",").alias("line"))


def write_graph(graph: Graph, prefix: str, test_formats: bool = False) -> None:
    """``.adjl`` and ``.elt`` folders, and ``.vl`` and ``.el`` if asked."""
    adjacency_lines(graph).orderBy("pos").select("line").write.text(f"{prefix}.adjl")
    half = graph.edges.where("src < dst").select("src", "dst")
    edge_lines(half, "\t").write.text(f"{prefix}.elt")
    if test_formats:
        vertex_line(graph.vertices).write.text(f"{prefix}.vl")
        edge_lines(half, ",").write.text(f"{prefix}.el")
