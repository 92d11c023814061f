"""Graphs derived from the test tables, as DataFrames and as SQL with the same rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.operators.iterate import stored
from graphloom.operators.placement import place
from graphloom.operators.structure import compact


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings as points: the first two components times 1000, the label as community."""
    v = lambda i: F.element_at("embedding", i).cast("double") * 1000
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("node_id"), v(1).alias("x"), v(2).alias("y"), F.col("label").cast("long").alias("community"))


def trade(spark: SparkSession, d: str) -> DataFrame:
    """A multigraph of order lines: part to supplier."""
    return table(spark, d, "lineitem").select(F.col("l_partkey").alias("src"), (F.col("l_suppkey") + 1_000_000_000).alias("dst"), F.col("l_quantity").alias("weight"))


def suppliers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("node_id"))


#: Suppliers that a row of a part's list holds, about, and entries of a run's lists that a task holds before it counts them.
LISTED, HELD = 1000, 1_000_000
#: Ids of a run at most, and pairs of its suppliers and their partners at most where it has several.
NEXT, PAIRS = 256, 20_000_000


class _Partners:
    """Counts of one supplier's partners, from lists that come a piece at a time."""

    def __init__(self, src: int):
        self.src, self.lists, self.held = src, [], 0
        self.dst, self.n = np.array([], np.int64), np.array([], np.int64)

    def add(self, found: np.ndarray) -> None:
        self.lists.append(found)
        self.held += len(found)
        if self.held > HELD:
            self.count()

    def count(self) -> None:
        if not self.lists:
            return
        own, n = np.unique(np.concatenate(self.lists), return_counts=True)
        if len(self.dst):
            own, at = np.unique(np.concatenate([self.dst, own]), return_inverse=True)
            n = np.bincount(at, np.concatenate([self.n, n])).astype(np.int64)
        self.dst, self.n, self.lists, self.held = own, n, [], 0

    def best(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``k`` that share most, ties by id."""
        self.count()
        other = self.dst != self.src
        dst, n = self.dst[other], self.n[other]
        first = np.argsort(-n, kind="stable")[:k]
        return dst[first], n[first]


def _crossed(own: np.ndarray, owns: np.ndarray, found: np.ndarray, founds: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """Each supplier with the entries of its lists, from rows that hold some suppliers and a list: ``owns`` of ``own`` and ``founds`` of ``found`` a row."""
    of = np.repeat(np.arange(len(owns)), owns)
    order = np.argsort(own, kind="stable")
    own, of = own[order], of[order]
    size, last = founds[of], np.cumsum(founds[of])
    all_ = found[np.arange(last[-1]) + np.repeat((np.cumsum(founds) - founds)[of] - last + size, size)]
    src, first = np.unique(own, return_index=True)
    return list(zip(src.tolist(), np.split(all_, (last - size)[first[1:]]), strict=True))


def _width(lines: DataFrame) -> int:
    """Ids of a run: ``NEXT``, or fewer where a supplier's lists are so long that its run could have more than ``PAIRS`` partners."""
    most = [lines.groupBy(c).count().agg(F.max("count")).first()[0] or 1 for c in ("p", "s")]
    return max(1, min(NEXT, PAIRS // (most[0] * most[1])))


def knn(spark: SparkSession, d: str, k: int = 5) -> DataFrame:
    """Each supplier's ``k`` partners that share most parts, stored, so that a query that reads it twice counts it once.

    A part sends the list of all its suppliers once to each run of ids that holds some of them,
    and pairs are counted where a run's lists arrive, one run after another: no pair is a row. A
    part of very many suppliers has its list in several rows; a task holds one run's different
    partners (``PAIRS``, or one supplier's) and ``HELD`` entries of its lists.
    """
    lines = table(spark, d, "lineitem").select(F.col("l_partkey").alias("p"), F.col("l_suppkey").cast("long").alias("s")).where("p is not null and s is not null")
    pairs, width = lines.repartition("p").distinct(), _width(lines)
    piece = F.pmod(F.xxhash64("s"), 1 + F.floor(F.count("*").over(Window.partitionBy("p")) / LISTED).cast("long"))
    lists = pairs.withColumn("piece", piece).groupBy("p", "piece").agg(F.collect_list("s").alias("all"))
    runs = pairs.groupBy("p", F.expr(f"s div {width}").alias("run")).agg(F.collect_list("s").alias("own"))
    sent = runs.hint("merge").join(lists.select("p", "all"), "p").select("run", "own", "all").repartition("run").sortWithinPartitions("run")

    def rows(done: list[_Partners]) -> pa.RecordBatch:
        best = [one.best(k) for one in done]
        src = np.repeat([one.src for one in done], [len(dst) for dst, _ in best])
        return pa.record_batch([pa.array(src, pa.int64()), pa.array(np.concatenate([dst for dst, _ in best]), pa.int64()), pa.array(np.concatenate([n for _, n in best]), pa.float64())], ["src", "dst", "weight"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, at, held = {}, None, 0
        for batch in batches:
            near, done = batch.column(0).to_numpy(), []
            own, found = (batch.column(c).flatten().to_numpy() for c in (1, 2))
            owns, founds = (batch.column(c).offsets.to_numpy().astype(np.int64) for c in (1, 2))
            owns, founds = owns - owns[0], founds - founds[0]
            room = np.cumsum(np.diff(owns) * np.diff(founds)) // HELD  # rows are taken by about HELD entries
            starts = np.flatnonzero((np.diff(near, prepend=near[:1] - 1) != 0) | (np.diff(room, prepend=-1) != 0))
            for first, last in zip(starts.tolist(), [*starts[1:].tolist(), len(near)], strict=True):
                if at != near[first]:
                    done += now.values()
                    now, at, held = {}, near[first], 0
                for src, some in _crossed(own[owns[first] : owns[last]], np.diff(owns[first : last + 1]), found[founds[first] : founds[last]], np.diff(founds[first : last + 1])):
                    now.setdefault(src, _Partners(src)).add(some)
                    held += len(some)
                if held > HELD:
                    for one in now.values():
                        one.count()
                    held = 0
            if done:
                yield rows(done)
        if now:
            yield rows(list(now.values()))

    return stored(sent.mapInArrow(run, "src long, dst long, weight double"))


def placed_suppliers(spark: SparkSession, d: str) -> DataFrame:
    return place(compact(suppliers(spark, d)), "phyllotaxis")


def containment(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """A tree: root 0, regions from 10, nations from 100, customers from 1000."""
    r = table(spark, d, "region").select(F.lit(0).cast("long").alias("src"), (F.col("r_regionkey") + 10).cast("long").alias("dst"))
    n = table(spark, d, "nation").select((F.col("n_regionkey") + 10).cast("long").alias("src"), (F.col("n_nationkey") + 100).cast("long").alias("dst"))
    c = table(spark, d, "customer").select((F.col("c_nationkey") + 100).cast("long").alias("src"), (F.col("c_custkey") + 1000).cast("long").alias("dst"))
    edges = r.union(n).union(c)
    return edges.select(F.col("dst").alias("node_id")).union(spark.range(1).select(F.col("id").alias("node_id"))), edges


def transitions(spark: SparkSession, d: str) -> DataFrame:
    """Consecutive event types of each user with their number."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    steps = table(spark, d, "events").select(F.col("event_type").alias("dst"), F.lag("event_type").over(w).alias("src")).where("src is not null")
    return steps.groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))


POINTS = "points AS (SELECT vec_id AS node_id, CAST(embedding[1] AS DOUBLE) * 1000 AS x, CAST(embedding[2] AS DOUBLE) * 1000 AS y, CAST(label AS BIGINT) AS community FROM embeddings)"
TRADE = "trade AS (SELECT l_partkey AS src, l_suppkey + 1000000000 AS dst, l_quantity AS weight FROM lineitem)"
KNN = """ps AS (SELECT DISTINCT l_partkey AS p, l_suppkey AS s FROM lineitem),
both_ AS (SELECT a.s AS src, b.s AS dst, CAST(count(*) AS DOUBLE) AS weight FROM ps a JOIN ps b ON a.p = b.p AND a.s <> b.s GROUP BY 1, 2),
knn AS (SELECT src, dst, weight FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS r FROM both_) q WHERE r <= 5)"""
PLACED = """slots AS (SELECT s_suppkey AS node_id, CAST(row_number() OVER (ORDER BY s_suppkey) - 1 AS DOUBLE) AS i, CAST(count(*) OVER () AS DOUBLE) AS n FROM supplier),
placed AS (SELECT node_id, 10 * sqrt(n) * sqrt(i / n) * cos(i * (pi() * (3 - sqrt(5)))) AS x, 10 * sqrt(n) * sqrt(i / n) * sin(i * (pi() * (3 - sqrt(5)))) AS y FROM slots)"""
TREE = """tree AS (SELECT CAST(0 AS BIGINT) AS src, CAST(r_regionkey + 10 AS BIGINT) AS dst FROM region
UNION ALL SELECT CAST(n_regionkey + 10 AS BIGINT), CAST(n_nationkey + 100 AS BIGINT) FROM nation
UNION ALL SELECT CAST(c_nationkey + 100 AS BIGINT), CAST(c_custkey + 1000 AS BIGINT) FROM customer),
tnodes AS (SELECT dst AS node_id FROM tree UNION ALL SELECT CAST(0 AS BIGINT))"""
TRANSITIONS = """steps AS (SELECT event_type AS dst, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS src FROM events),
transitions AS (SELECT src, dst, CAST(count(*) AS DOUBLE) AS weight FROM steps WHERE src IS NOT NULL GROUP BY 1, 2)"""
