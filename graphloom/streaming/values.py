"""Keyed value streams: last write wins, in batches and as a stream."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState

from graphloom.functions import color


def latest(values: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by ``order``: a maximum of structs, combined before the shuffle."""
    rest = [c for c in values.columns if c not in keys and c not in order]
    best = values.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("m"))
    return best.select(*keys, *[F.col(f"m.{c}").alias(c) for c in (*order, *rest)])


def upsert(spark_stream: DataFrame, path: str, checkpoint: str, keys: list[str], order: list[str]) -> StreamingQuery:
    """Keep ``path``'s newest version the last row of each key seen so far; versions are numbered by batch, so a batch that runs again writes the same one."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        old = spark.read.parquet(f"{path}/v{number - 1}") if number else None
        rows = batch if old is None else old.unionByName(batch)
        latest(rows, keys, order).write.mode("overwrite").parquet(f"{path}/v{number}")

    return spark_stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: A change of a keyed value: a null value clears the node's, a null node the whole stream's.
_CHANGE = "stream string, node_id long, value double, at timestamp, seq long"
_STATE = "at long, seq long, value double, cleared boolean"


def _last_change(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """One key: its last change by (at, seq) is its state; a later one is handed on, earlier ones and repeats change nothing."""
    if state.hasTimedOut:  # a clear that no row can be older than any more
        state.remove()
        return
    last = tuple(state.get[:2]) if state.exists else None
    whole = key[1] is None or key[1] != key[1]  # a clear of the whole stream stays
    best, watermark = None, state.getCurrentWatermarkMs() * 1000
    for rows in batches:
        at = rows["at"].astype("datetime64[us]").astype("int64")
        for when, seq, value in zip(at, rows["seq"], rows["value"], strict=True):
            if when >= watermark and (last is None or (when, seq) > last):
                last, best = (int(when), int(seq)), value
    if best is not None:
        cleared = bool(best != best)
        state.update((*last, None if cleared else float(best), cleared))
        yield pd.DataFrame({"stream": [key[0]], "node_id": pd.array([None if whole else key[1]], "Int64"), "value": [None if cleared else float(best)], "at": [pd.Timestamp(last[0], unit="us")], "seq": [last[1]]})
    if state.exists and state.get[3] and not whole:
        state.setTimeoutTimestamp(max(last[0], watermark) // 1000 + 1)


def keyed_changes(changes: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """The changes (stream, node_id, value, at, seq) of a stream that set a key's value anew: the last by (at, seq) wins, whenever it comes.

    A state a key holds its last change. A cleared key keeps its clear until the watermark,
    ``delay`` behind the newest row, has passed it, and then no state at all; rows behind the
    watermark change nothing. Rows without ``at`` or ``seq`` are left out.
    """
    rows = changes.where("stream is not null and at is not null and seq is not null").select("stream", "node_id", F.when(~F.isnan("value"), F.col("value")).alias("value"), "at", "seq")
    return rows.withWatermark("at", delay).groupBy("stream", "node_id").applyInPandasWithState(_last_change, _CHANGE, _STATE, "update", "EventTimeTimeout")


def keep_values(changes: DataFrame, path: str, checkpoint: str, delay: str = "10 minutes") -> StreamingQuery:
    """Write the changed keys of each batch under ``path``, a version a batch: a batch that runs again writes the same one, and no batch reads or writes the others' rows."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return keyed_changes(changes, delay).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_values(spark: SparkSession, path: str) -> DataFrame:
    """(stream, node_id, value, at, seq): the keys that have a value, from all versions under ``path``: the last change of each, unless it or a later one of its stream cleared it."""
    rows = spark.read.schema(_CHANGE).option("recursiveFileLookup", "true").parquet(path)
    last = latest(rows.where("node_id is not null"), ["stream", "node_id"], ["at", "seq"])
    cleared = rows.where("node_id is null").groupBy("stream").agg(F.max(F.struct("at", "seq")).alias("clear"))
    return last.join(cleared, "stream", "left").where("value is not null and (clear is null or struct(at, seq) > clear)").select("stream", "node_id", "value", "at", "seq")


def rolling_mean(frames: DataFrame, key: str, order: str, value: str, rows: int = 60) -> DataFrame:
    """Each row with the mean of its key's last ``rows`` values."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(1 - rows, 0)
    return frames.withColumn("mean", F.avg(value).over(w))


@dataclass(frozen=True)
class Stream:
    """How a value stream is drawn: its domain, colour stops, opacity and how it blends with the streams before it."""

    name: str
    low: float = 0.0
    high: float = 1.0
    stops: tuple = tuple(color.STREAM_SCALES["heat"])
    mode: str = "additive"
    opacity: float = 1.0
    enabled: bool = True

    def __post_init__(self):
        if self.mode not in color.BLENDS:
            raise ValueError(f"unknown blend mode {self.mode}")


@dataclass
class Streams:
    """Defined streams in their order, at most ``most``; their values are rows (stream, node_id, value), one a key."""

    defined: dict[str, Stream] = field(default_factory=dict)
    most: int = 16

    def define(self, stream: Stream) -> None:
        if stream.name in self.defined:
            raise ValueError(f"stream {stream.name} exists")
        if len(self.defined) >= self.most:
            raise ValueError(f"at most {self.most} streams")
        self.defined[stream.name] = stream

    def remove(self, name: str) -> None:
        self.defined.pop(name, None)

    def has(self, name: str) -> bool:
        return name in self.defined

    def change(self, name: str, **settings) -> None:
        """Set a stream's opacity, mode, stops or domain, or switch it on or off."""
        self.defined[name] = replace(self.defined[name], **settings)

    def toggle(self, name: str) -> None:
        self.change(name, enabled=not self.defined[name].enabled)

    def info(self, values: DataFrame) -> DataFrame:
        """(stream, enabled, mode, opacity, n): every stream with how many nodes have a value."""
        spark = values.sparkSession
        rows = [(s.name, s.enabled, s.mode, float(s.opacity)) for s in self.defined.values()]
        counts = values.groupBy("stream").agg(F.count("*").alias("n"))
        return spark.createDataFrame(rows, "stream string, enabled boolean, mode string, opacity double").join(counts, "stream", "left").na.fill(0, ["n"])

    def enabled(self, values: DataFrame) -> DataFrame:
        on = [s.name for s in self.defined.values() if s.enabled]
        return values.where(F.col("stream").isin(on)) if on else values.limit(0)

    def affected(self, values: DataFrame) -> DataFrame:
        """Nodes with a value in a stream that is on."""
        return self.enabled(values).select("node_id").distinct()

    def blended(self, values: DataFrame, base: tuple[float, float, float, float] = (0.0, 0.0, 0.0, 0.0)) -> DataFrame:
        """(node_id, r, g, b, a): each affected node's colours folded over ``base`` in the order of definition.

        A node has at most one value a stream, so its row of layers is as short as the list of streams.
        """
        layers = []
        for s in self.defined.values():
            if s.enabled:
                value = F.max(F.when(F.col("stream") == s.name, F.col("value")))
                layers.append(value.alias(s.name))
        if not layers:
            return values.limit(0).select("node_id", *[F.lit(0.0).alias(c) for c in "rgba"])
        wide = self.enabled(values).groupBy("node_id").agg(*layers)
        out = wide.withColumns({c: F.lit(float(v)) for c, v in zip(("_r", "_g", "_b", "_a"), base, strict=True)})
        for s in self.defined.values():
            if s.enabled:
                new = color.scale(color.normalise(F.col(f"`{s.name}`"), s.low, s.high), list(s.stops), s.opacity)
                blend = color.BLENDS[s.mode]
                out = out.withColumn("_new", F.when(F.col(f"`{s.name}`").isNotNull(), new))
                parts = {f"_{c}": F.when(F.col("_new").isNull(), F.col(f"_{c}")).otherwise(blend(F.col(f"_{c}"), F.col("_new")[c], F.col("_new.a"))) for c in "rgb"}
                out = out.withColumns(parts | {"_a": F.when(F.col("_new").isNull(), F.col("_a")).otherwise(F.greatest("_a", F.col("_new.a")))})
        return out.select("node_id", *[F.col(f"_{c}").alias(c) for c in "rgba"])

    def applied(self, nodes: DataFrame, values: DataFrame) -> DataFrame:
        """Nodes (node_id, r, g, b, a) with their blended colours where these can be seen; without a stream they have their own again."""
        new = self.blended(values).select("node_id", *[F.col(c).alias(f"_{c}") for c in "rgba"])
        seen = F.coalesce(F.col("_a"), F.lit(0.0)) > 0
        return nodes.join(new, "node_id", "left").withColumns({c: F.when(seen, F.col(f"_{c}")).otherwise(F.col(c)) for c in "rgba"}).drop("_r", "_g", "_b", "_a")

    def intensity(self, nodes: DataFrame, values: DataFrame, name: str) -> DataFrame:
        """(node_id, intensity): each node's normalised value in a stream, 0 without one."""
        s = self.defined[name]
        own = values.where(F.col("stream") == name).select("node_id", color.normalise(F.col("value"), s.low, s.high).alias("intensity"))
        return nodes.select("node_id").join(own, "node_id", "left").na.fill(0.0, ["intensity"])


def channel(values: DataFrame, keys: list[str], how: str) -> DataFrame:
    """(keys, value): several values of a channel as one, by sum, max, avg or min."""
    return values.groupBy(*keys).agg({"sum": F.sum, "max": F.max, "avg": F.avg, "min": F.min}[how]("value").alias("value"))


def of_rank(df: DataFrame, col: str, rank: int, bins: int = 65536) -> float:
    """The value of a rank (from 0) among a column's non-null values, exactly: each pass counts them in ``bins`` bins and goes on in the bin that holds the rank. No task sees all values."""
    rows = df.select(F.col(col).cast("double").alias("v")).where("v is not null")
    low, high = rows.agg(F.min("v"), F.max("v")).first()
    below = 0
    while low < high:
        width = (high - low) / bins
        if low + width == low:  # as narrow as doubles are: the few values there are told apart
            counted = [(v, n) for v, n in rows.where(F.col("v").between(low, high)).groupBy("v").count().orderBy("v").collect()]
            for v, n in counted:
                if below + n > rank:
                    return v
                below += n
        inside = rows.where(F.col("v").between(low, high)).groupBy(F.least(F.floor((F.col("v") - low) / width), F.lit(bins - 1)).alias("bin")).agg(F.count("*").alias("n"), F.min("v"), F.max("v"))
        for _, n, least, most in sorted(map(tuple, inside.collect())):
            if below + n > rank:
                low, high = least, most
                break
            below += n
    return low


def frame_summary(frames: DataFrame, value: str, target_fps: float = 30.0) -> DataFrame:
    """One row: frames, total, average, least and most time, and the rates they mean; ``slow`` is the value of rank floor(0.99 n)."""
    out = frames.agg(F.count(value).alias("frames"), F.sum(value).alias("total"), F.avg(value).alias("avg"), F.min(value).alias("least"), F.max(value).alias("most"))
    n = frames.where(F.col(value).isNotNull()).count()
    slow = of_rank(frames, value, math.floor(0.99 * n)) if n else None
    out = out.withColumn("slow", F.lit(slow).cast("double"))
    rates = {"fps_avg": 1000 / F.col("avg"), "fps_least": 1000 / F.col("most"), "fps_most": 1000 / F.col("least"), "fps_slow": 1000 / F.col("slow")}
    return out.withColumns(rates).withColumn("met", F.col("fps_avg") >= target_fps)
