"""Mixing sources to target weights: capped water-filling and seeded repetitions."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import materialize

#: Hash buckets in each size class of a source; what a source takes is settled by whole buckets.
BUCKETS = 256


def n_words(text: Column) -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+``; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def water_fill(sources: DataFrame, total: float, max_epochs: float) -> DataFrame:
    """Targets for ``sources`` (source, source_size, weight): shares of ``total`` by weight, at most ``max_epochs`` times a source's size.

    Clamping the sources above their cap and sharing the excess by weight until none is
    above has one fixed point: ``min(cap, level * weight)``. With the sources in order of
    cap / weight the clamped ones are a prefix, and the level follows from sums over it: the
    largest level that the row it is taken at is not filled by.
    One row per source is ordered here, never one per document. If all caps together fall
    short of ``total``, every source gets its cap.
    """
    order = Window.orderBy(F.col("fill"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    ranked = sources.withColumn("cap", max_epochs * F.col("source_size")).withColumn("fill", F.col("cap") / F.col("weight"))
    ranked = ranked.withColumn("level", (F.lit(float(total)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    level = F.max(F.when(F.col("fill") >= F.col("level"), F.col("level"))).over(Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return ranked.withColumn("target", F.least("cap", F.coalesce(level, F.lit(float("inf"))) * F.col("weight"))).select("source", "source_size", "target")


def _cutoffs(pdf: pd.DataFrame) -> pd.DataFrame:
    """For one source, the number of buckets of each size class that get one more repetition.

    Classes go from long documents to short ones; what whole buckets leave of a class's
    share is carried to the next, so a source misses its target by less than a bucket of its
    shortest class that takes any: little beside a large source, more beside a small one. At most 64 classes of ``BUCKETS`` buckets come here.
    """
    out, carry = [], 0.0
    first = pdf.iloc[0]
    for size_class, group in sorted(pdf.groupby("size_class"), reverse=True):
        want, got, cutoff = group["words"].sum() * first["fraction"] + carry, 0, 0
        for bucket, words in sorted(zip(group["bucket"], group["words"], strict=True)):
            if got + words > want + 1e-6:
                break
            got, cutoff = got + words, bucket + 1
        carry = want - got
        out.append((first["source_key"], size_class, cutoff))
    return pd.DataFrame(out, columns=["source_key", "size_class", "cutoff"])


def plan_mix(
    docs: DataFrame,
    weights: Sequence[float] = (5.0, 2.0, 1.0),
    total_ratio: float = 1.5,
    max_epochs: float = 2.0,
    seed: int = 17,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target`` and ``repeats`` (whole times that the mix takes the row).

    Sources in code-point order, null last, take ``weights`` in turn and share
    ``total_ratio`` of all words. A source repeats all its documents the whole part of
    target / size times; the fraction goes to documents in the order of a seeded hash,
    stratified by size class. Counts per (source, class, bucket) decide it, so no source
    is gathered or sorted and reruns agree. Repeated rows are decided alike. A null or
    empty text has size 0 and repeats like its source's shortest class, at no cost. A null
    source is a source. An empty table gives no rows.
    """
    key = F.coalesce(F.concat(F.lit("s"), F.col(source_col)), F.lit(""))  # "": the null source
    sized = docs.withColumn("_source_key", key).withColumn("size", n_words(F.col(text_col)))
    small = materialize(
        sized.select("_source_key", "size", F.floor(F.log2(F.greatest("size", F.lit(1)).cast("double"))).cast("int").alias("size_class"), _bucket(id_col, seed))
        .groupBy(F.col("_source_key").alias("source_key"), "size_class", "bucket")
        .agg(F.sum("size").alias("words"))
    )
    by_source = small.groupBy("source_key").agg(F.sum("words").alias("source_size"))
    n = len(weights)
    place = F.pmod(F.row_number().over(Window.orderBy((F.col("source_key") == "").asc(), "source_key")) - 1, F.lit(n))
    sources = by_source.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), place + 1)).withColumnRenamed("source_key", "source")
    words = by_source.agg(F.sum("source_size")).first()[0] or 0
    targets = water_fill(sources, total_ratio * words, max_epochs).withColumnRenamed("source", "source_key")
    epochs = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    targets = materialize(targets.withColumn("epochs", epochs).withColumn("whole", F.floor(F.col("epochs") + 1e-9)).withColumn("fraction", F.greatest(F.col("epochs") - F.col("whole"), F.lit(0.0))))
    cutoffs = small.join(targets.select("source_key", "fraction"), "source_key").groupBy("source_key").applyInPandas(_cutoffs, "source_key string, size_class int, cutoff int")
    plan = materialize(cutoffs.join(targets.select("source_key", "source_size", "target", "whole"), "source_key"))
    out = sized.withColumn("_size_class", F.floor(F.log2(F.greatest("size", F.lit(1)).cast("double"))).cast("int")).withColumn("_bucket", _bucket(id_col, seed))
    plan = plan.select(*[F.col(c).alias(f"_{c}") for c in ("source_key", "size_class")], "source_size", "target", "whole", "cutoff")
    return (
        out.join(plan, ["_source_key", "_size_class"])
        .withColumn("repeats", F.least(F.col("whole") + (F.col("_bucket") < F.col("cutoff")).cast("long"), F.lit(math.floor(max_epochs))))
        .drop("_source_key", "_size_class", "_bucket", "whole", "cutoff")
    )


def _bucket(id_col: str, seed: int):
    return F.pmod(F.xxhash64(F.lit(seed), F.col(id_col)), F.lit(BUCKETS)).cast("int").alias("bucket")


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed rows with the columns of ``docs``, each as often as ``plan_mix`` says."""
    planned = plan_mix(docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]), **{k: f"c{docs.columns.index(options.pop(k, d))}" for k, d in (("id_col", "doc_id"), ("text_col", "text"), ("source_col", "source"))}, **options)
    return planned.where("repeats > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("repeats").cast("int")))).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])
