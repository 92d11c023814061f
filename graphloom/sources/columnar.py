"""Graphs as flat arrays in files: read in parts by the executors, with what is wrong as rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.sources.graph import EDGE_COLOR, EDGE_WIDTH, NODE_COLOR, NODE_RADIUS, Graph, GraphError, rgb

# Arrays by name, with the numbers a row has, whether they belong to nodes or edges, and their type.
ARRAYS = {
    "positions": (2, "node", "<f4"),
    "nodeRadii": (1, "node", "<f4"),
    "nodeColors": (3, "node", "<f4"),
    "edgePairs": (2, "edge", "<u4"),
    "edgeWidths": (1, "edge", "<f4"),
    "edgeColors": (3, "edge", "<f4"),
}
_NAMES = {"positions": ["x", "y"], "nodeRadii": ["radius"], "nodeColors": ["r", "g", "b"], "edgePairs": ["src", "dst"], "edgeWidths": ["width"], "edgeColors": ["r", "g", "b"]}
#: Rows of a batch that leaves a task.
ROWS = 100_000


def _files(spark: SparkSession, path: str, name: str) -> DataFrame | None:
    """(path, bytes, first) of an array's files in the order of their names, ``first`` being the bytes before each; none where the array isn't there. A row a file, contents unread."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/{name}")
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return None
    files = spark.read.format("binaryFile").load(f"{path.rstrip('/')}/{name}").select("path", F.col("length").alias("bytes"))
    before = Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("first", F.coalesce(F.sum("bytes").over(before), F.lit(0)))


def array_rows(spark: SparkSession, path: str, name: str) -> DataFrame:
    """An array's rows (i, then its columns), numbered over all its files. A task holds one file: write arrays in files of some hundred MB."""
    width, _, kind = ARRAYS[name]
    names, long = _NAMES[name], kind == "<u4"
    schema = "i long, " + ", ".join(f"{c} {'long' if long else 'double'}" for c in names)
    files = _files(spark, path, name)
    if files is None:
        return spark.createDataFrame([], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = np.frombuffer(content.as_buffer(), kind)
                for at in range(0, len(data), ROWS * width):
                    part = data[at : at + ROWS * width].reshape(-1, width)
                    start = (first + 4 * at) // (4 * width)
                    columns = [np.arange(start, start + len(part)), *(part[:, k].astype(np.int64 if long else np.float64) for k in range(width))]
                    yield pa.record_batch([pa.array(c) for c in columns], ["i", *names])

    content = spark.read.format("binaryFile").load(f"{path.rstrip('/')}/{name}").select("path", "content")
    return content.join(F.broadcast(files.select("path", "first")), "path").select("first", "content").mapInArrow(run, schema)  # a row a file


def counts(spark: SparkSession, path: str) -> tuple[int | None, int]:
    """The numbers of nodes and edges that ``meta.json`` states; edges default to none."""
    row = spark.read.schema("nodeCount long, edgeCount long").json(f"{path.rstrip('/')}/meta.json").first()
    return (row.nodeCount, row.edgeCount or 0) if row else (None, 0)


def columnar_faults(spark: SparkSession, path: str) -> DataFrame:
    """(array, fault, expected, found): a count of nodes that isn't there or negative, arrays of another length than the counts say, files that end within a row, and the number of edge ends that are no node."""
    n_nodes, n_edges = counts(spark, path)
    schema = "array string, fault string, expected long, found long"
    if n_nodes is None or n_nodes < 0 or n_edges < 0:
        return spark.createDataFrame([("meta", "counts", 0, n_nodes)], schema)
    out = spark.createDataFrame([], schema)
    for name, (width, owner, _) in ARRAYS.items():
        if (files := _files(spark, path, name)) is None:
            continue
        want = (n_nodes if owner == "node" else n_edges) * width
        length = files.agg((F.sum("bytes") / 4).cast("long").alias("found")).select(F.lit(name), F.lit("length"), F.lit(want).cast("long"), "found").where(F.coalesce("found", F.lit(0)) != want)
        torn = files.where(F.col("bytes") % (4 * width) != 0).agg(F.count("*").alias("n")).where("n > 0").select(F.lit(name), F.lit("file ends within a row"), F.lit(0).cast("long"), "n")
        out = out.union(length).union(torn)
    if out.isEmpty() and _files(spark, path, "edgePairs") is not None:
        ends = array_rows(spark, path, "edgePairs").agg(F.sum((F.col("src") >= n_nodes).cast("long") + (F.col("dst") >= n_nodes).cast("long")).alias("n")).where("n > 0")
        out = out.union(ends.select(F.lit("edgePairs"), F.lit("an end is no node"), F.lit(n_nodes).cast("long"), "n"))
    return out


def read_columnar(spark: SparkSession, path: str) -> Graph:
    """A graph from a folder: ``meta.json`` with nodeCount and edgeCount, and for each array of ``ARRAYS`` that there is a folder of files of little-endian numbers, put together in the order of their names.

    Ids are row numbers, named ``n<i>`` and ``e<i>``; attributes without an array get their
    defaults, places 0. Arrays whose lengths don't fit, and ends that are no node, are an error
    whose rows tell them (``columnar_faults``).
    """
    bad = columnar_faults(spark, path)
    if not bad.isEmpty():
        kinds = {r.fault for r in bad.select("fault").distinct().collect()}
        raise GraphError(1003 if "an end is no node" in kinds else 1001, ", ".join(sorted(kinds)), bad)
    n_nodes, n_edges = counts(spark, path)

    def filled(rows: DataFrame, key: str, name: str, **defaults: float) -> DataFrame:
        found = array_rows(spark, path, name).withColumnRenamed("i", key)
        return rows.join(found, key, "left").na.fill(defaults)

    def colored(rows: DataFrame, key: str, name: str, default: tuple[float, float, float]) -> DataFrame:
        out = filled(rows, key, name)
        return out.withColumn("color", F.when(F.col("r").isNull(), rgb(default)).otherwise(F.struct("r", "g", "b"))).drop("r", "g", "b")

    nodes = spark.range(n_nodes).select(F.col("id").alias("node_id"), F.concat(F.lit("n"), "id").alias("ext_id"))
    nodes = colored(filled(filled(nodes, "node_id", "positions", x=0.0, y=0.0), "node_id", "nodeRadii", radius=NODE_RADIUS), "node_id", "nodeColors", NODE_COLOR)
    edges = spark.range(n_edges).select(F.col("id").alias("edge_id"), F.concat(F.lit("e"), "id").alias("ext_id"))
    edges = filled(edges, "edge_id", "edgePairs", src=0, dst=0)
    return Graph(nodes, colored(filled(edges, "edge_id", "edgeWidths", width=EDGE_WIDTH), "edge_id", "edgeColors", EDGE_COLOR))
