"""Helpers shared by the training-data operators: tables, words, hashes, components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: Odd multipliers of the two polynomial hashes over word hashes.
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; where it is unset, a temporary one in local mode and an error on a cluster."""
    if not (path := spark.conf.get("spark.checkpoint.dir", None)):
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="graphloom-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Send whole texts to Python in batches of ``rows``, not Spark's default of 10,000: a task's memory follows the batch. Any other setting of the user's own stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(rows))


def give_back() -> None:
    """Return what this worker has freed to the system: it lives on beside its executor's other tasks."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` over small batches; a task gives its memory back when it ends."""
    small_batches(df.sparkSession)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return df.mapInArrow(task, schema)


_WRITTEN: list[str] = []


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: the lineage ends there, so a lost executor costs one stage."""
    path = new_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def new_folder(spark: SparkSession) -> str:
    """A new folder's name in the shared folder, which ``forget`` removes."""
    _WRITTEN.append(f"{shared_dir(spark)}/graphloom-{uuid.uuid4().hex}")
    return _WRITTEN[-1]


def written() -> int:
    """A mark for ``forget``: how many tables this process has materialized and not removed."""
    return len(_WRITTEN)


def forget(spark: SparkSession, since: int = 0, until: int | None = None) -> None:
    """Remove the tables materialized between two marks; results that still read from them must have been written elsewhere."""
    for name in _WRITTEN[since:until]:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    del _WRITTEN[since:until]


class WordHashes(dict):
    """64-bit hash of each word (bytes), kept for words seen before; starts over at ``most`` words so that memory stays bounded."""

    def __init__(self, most: int = 50_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), U64, len(words))


def words_of(text: str | None, lower: bool = False) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` as UTF-8: ``bytes.split`` parts at just these six characters, ``bytes.lower`` maps just A-Z."""
    data = text.encode("utf-8", "surrogatepass") if text else b""
    return (data.lower() if lower else data).split()


def mixed(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over the 64-bit word."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 4096), base, U64)
        have[0] = 1
        have = _POWERS[base] = np.multiply.accumulate(have)
    return have[:n]


def prefix_hashes(h: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of ``h[i] * base**i`` over prefixes, and the powers of the base's inverse: ``span_hashes`` reads any span's hash from them."""
    inverse = pow(base, -1, 1 << 64)
    sums = np.zeros(len(h) + 1, U64)
    np.cumsum(h * _powers(base, len(h)), out=sums[1:])
    return sums, _powers(inverse, len(h) + 1)


def span_hashes(prefix: tuple[np.ndarray, np.ndarray], start: np.ndarray, end: np.ndarray) -> np.ndarray:
    sums, unshift = prefix
    return mixed((sums[end] - sums[start]) * unshift[start] + (end - start).astype(U64))


def window_hashes(h: np.ndarray, n: int, base: int = BASES[0]) -> np.ndarray:
    """One hash for each window of n consecutive words."""
    starts = np.arange(max(len(h) - n + 1, 0))
    return span_hashes(prefix_hashes(h, base), starts, starts + n)


def components(links: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """Connected components of undirected links as (id, component), the component being its smallest id.

    Alternating large-star and small-star rounds (Kiveris et al. 2014) contract every
    component to a star on its smallest id. Each round is a minimum per node,
    combined before the shuffle, and a join; its links are written to the shared
    folder. Ids without links don't appear. Null ends and self links are ignored.
    """
    edges = materialize(
        links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u is not null and v is not null and u != v").distinct()
    )

    def stamp(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())

    before = stamp(edges)
    for _ in range(most_rounds):
        if not before[0]:
            break
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        edges = materialize(small.select("e.*").where("u != v").distinct())
        after = stamp(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    return edges.groupBy("u").agg(F.min("v").alias("v")).select(F.explode(F.array(F.struct(F.col("u").alias("id"), F.col("v").alias("component")), F.struct(F.col("v").alias("id"), F.col("v").alias("component")))).alias("e")).select("e.*").distinct()
