"""A dictionary of external ids that grows: known ids keep their numbers, freed numbers are given out again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.structure import running

_SCHEMA = "ext_id string, node_id long, version long, place long, live boolean"


class IdMap:
    """(ext_id, node_id) in a folder, one increment a change; the newest increment of a number tells whether it is taken.

    Every change writes only what it changes, as a version of its own, and a version counts once
    it is written whole: a job that is lost leaves the versions before it. ``compact`` puts
    all increments into one. Numbers are ranked over range partitions: no task sees all ids.
    One writer at a time; readers see the versions that were there when they began.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._hadoop(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # Versions

    def _versions(self) -> list[int]:
        """Whole versions from the last full one on."""
        if not self._fs.exists(self._hadoop(self.path)):
            return []
        found = {f.getPath().getName() for f in self._fs.listStatus(self._hadoop(self.path)) if self._fs.exists(self._hadoop(f"{self.path}/{f.getPath().getName()}/_SUCCESS"))}
        number = sorted((int(name[1:]), name[0]) for name in found if name[0] in "vf")
        full = max((i for i, kind in number if kind == "f"), default=0)
        return [f"{kind}{i}" for i, kind in number if i >= full]

    def _next(self) -> int:
        return max((int(v[1:]) for v in self._versions()), default=0) + 1

    def _events(self) -> DataFrame:
        paths = [f"{self.path}/{v}" for v in self._versions()]
        return self.spark.read.schema(_SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], _SCHEMA)

    def _write(self, rows: DataFrame, full: bool = False) -> None:
        """The next version. What an earlier try left there is overwritten: it wasn't whole."""
        number = self._next()
        stamped = rows if full else rows.withColumn("version", F.lit(number).cast("long"))
        stamped.select("ext_id", "node_id", "version", "place", "live").write.mode("overwrite").parquet(f"{self.path}/{'f' if full else 'v'}{number}")

    def _state(self) -> DataFrame:
        """The newest event of each number."""
        newest = F.max(F.struct("version", "live", "place", "ext_id")).alias("m")
        return self._events().groupBy("node_id").agg(newest).select("m.ext_id", "node_id", "m.version", "m.place", "m.live")

    # Reading

    def entries(self) -> DataFrame:
        """(ext_id, node_id) of all ids that are there."""
        return self._state().where("live").select("ext_id", "node_id")

    def size(self) -> int:
        return self.entries().count()

    def get(self, ids: DataFrame, col: str = "ext_id") -> DataFrame:
        """``ids`` with ``node_id``, null where an id isn't there."""
        own = self.entries().withColumnRenamed("ext_id", "_ext")
        return ids.join(own, F.col(col).cast("string") == F.col("_ext"), "left").drop("_ext")

    def get_ids(self, numbers: DataFrame) -> DataFrame:
        """``numbers`` (node_id) with ``ext_id``, null where a number isn't taken."""
        return numbers.join(self.entries(), "node_id", "left")

    # Changes

    def add(self, ids: DataFrame, col: str = "ext_id", order: str | None = None) -> None:
        """Give the ids that aren't there numbers, in the order of ``order`` and id: first those freed last, then new ones. Null ids are left out, repeated ones count once."""
        state = self._state()
        wanted = ids.select(F.col(col).cast("string").alias("ext_id"), F.col(order or col).alias("by")).where("ext_id is not null").groupBy("ext_id").agg(F.min("by").alias("by"))
        new = wanted.join(state.where("live").select("ext_id"), "ext_id", "left_anti")
        ranked = running(new.select("ext_id", F.struct("by", "ext_id").alias("at")), "at", F.lit(1)).select("ext_id", F.col("before").alias("rank"))
        free = state.where("not live").select("node_id", F.struct((-F.col("version")).alias("v"), (-F.col("place")).alias("p"), "node_id").alias("at"))
        free = running(free, "at", F.lit(1)).select("node_id", F.col("before").alias("rank"))
        n_free, bound = state.agg(F.count_if(~F.col("live")), F.coalesce(F.max("node_id") + 1, F.lit(0))).first()
        given = ranked.join(free, "rank", "left").withColumn("node_id", F.coalesce("node_id", F.col("rank") - n_free + bound))
        self._write(given.select("ext_id", "node_id", F.col("rank").alias("place"), F.lit(True).alias("live")))

    def set(self, pairs: DataFrame) -> None:
        """Take (ext_id, node_id) as they are: an id that had another number frees it, and an id whose number is taken over is gone. Repeated ids or numbers are an error."""
        pairs = pairs.select(F.col("ext_id").cast("string").alias("ext_id"), F.col("node_id").cast("long").alias("node_id"))
        for key in ("ext_id", "node_id"):
            if not pairs.groupBy(key).count().where("count > 1").isEmpty():
                raise ValueError(f"{key} repeats")
        old = self.entries().join(pairs.select("ext_id", F.col("node_id").alias("_new")), "ext_id").where("node_id != _new").select("ext_id", "node_id")
        freed = old.join(pairs.select("node_id"), "node_id", "left_anti").select("ext_id", "node_id", F.col("node_id").alias("place"), F.lit(False).alias("live"))
        self._write(pairs.select("ext_id", "node_id", F.lit(0).cast("long").alias("place"), F.lit(True).alias("live")).union(freed))

    def remove(self, ids: DataFrame, col: str = "ext_id") -> None:
        """Free the numbers of ids; the last of them by number is the first to be given out again. Unknown ids are left out."""
        gone = self.entries().join(ids.select(F.col(col).cast("string").alias("ext_id")), "ext_id", "left_semi")
        self._write(gone.select("ext_id", "node_id", F.col("node_id").alias("place"), F.lit(False).alias("live")))

    def clear(self) -> None:
        """Forget all ids and numbers: the next id is number 0."""
        self._write(self.spark.createDataFrame([], _SCHEMA), full=True)

    def compact(self) -> None:
        """One full version with the state of every number; older versions stay for those who read them."""
        self._write(self._state(), full=True)
