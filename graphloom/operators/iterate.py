"""Driver loops over DataFrames: each step is one plan, its rows written to the shared folder."""

from __future__ import annotations

import itertools
import tempfile
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession


_WRITTEN: list[str] = []


def forget(spark: SparkSession) -> None:
    """Remove the steps stored so far; results that still read from them must have been written elsewhere."""
    while _WRITTEN:
        path = spark._jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def new_folder(spark: SparkSession) -> str:
    """A new folder's name under ``spark.checkpoint.dir``, which ``forget`` removes; a temporary one in local mode where that is unset."""
    if not (folder := spark.conf.get("spark.checkpoint.dir", None)):
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="graphloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    _WRITTEN.append(f"{folder.rstrip('/')}/step-{uuid.uuid4().hex}")
    return _WRITTEN[-1]


def stored(df: DataFrame) -> DataFrame:
    """The rows written as Parquet under ``spark.checkpoint.dir`` and read back, which ends their lineage; a lost executor costs one step."""
    path = new_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Pile:
    """A stored table that grows by rounds: each adds its own rows, and none is written again."""

    def __init__(self, first: DataFrame):
        self.spark, self.schema, self.path, self.rounds = first.sparkSession, first.schema, new_folder(first.sparkSession), 0
        self.last = self.add(first)

    def add(self, df: DataFrame) -> DataFrame:
        """Write the rows of one round and read them back."""
        path, self.rounds = f"{self.path}/round={self.rounds}", self.rounds + 1
        df.select(*self.schema.names).write.parquet(path)
        self.last = self.spark.read.schema(self.schema).parquet(path)
        return self.last

    def all(self) -> DataFrame:
        return self.spark.read.schema(self.schema).option("recursiveFileLookup", "true").parquet(self.path)


def settle(state: DataFrame, step: Callable[[DataFrame, int], DataFrame], stamp: Callable[[DataFrame], Any], most: int | None = None) -> DataFrame:
    """``step`` again and again until ``stamp``, one small aggregate, stays the same; ``most`` steps, if given, or an error."""
    state = stored(state)
    last = stamp(state)
    for turn in itertools.count():
        if most is not None and turn >= most:
            raise RuntimeError(f"not settled after {most} steps")
        state = stored(step(state, turn))
        now = stamp(state)
        if now == last:
            return state
        last = now


def repeat(state: DataFrame, step: Callable[[DataFrame], DataFrame], times: int, every: int = 5) -> DataFrame:
    """``step`` a fixed number of times, the lineage cut every few."""
    for turn in range(times):
        state = step(state)
        if (turn + 1) % every == 0 and turn + 1 < times:
            state = stored(state)
    return state
