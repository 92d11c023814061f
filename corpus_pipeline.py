"""The corpus pipeline: quality, exact dedup, near-dedup, mixing, packing.

Every stage takes (spark, docs, sf_dir), works on all rows of its predecessor and returns
the columns of ``documents``, extra ones included; the last one returns packed pieces.

In all stages a null text counts as empty, repeated rows are decided alike, an empty table
gives no rows, and texts are taken whole however long they are. Rows with a null id are kept by
near dedup and mixed and packed like others. What ties is stated with each operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import exact, minhash, mix, pack, quality
from graphloom.llm.common import forget, materialize, table, written


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the quality model rejects."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each text."""
    return exact.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each near-duplicate group."""
    return minhash.drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take each source's documents as often as its target asks."""
    return mix.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack all documents into sequences of ids."""
    return pack.pack(docs)


STAGES = [
    ("quality classifier", keep_good),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL can express neither the fitted classifier nor the packing; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's rows written as Parquet and reread by the next."""
    docs, first = table(spark, sf_dir, "documents"), written()
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
        forget(spark, first, written() - 1)  # all but this stage's rows
    return STAGES[-1][1](spark, docs, sf_dir)
