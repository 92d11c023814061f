"""Exact deduplication by skew-safe combining, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import materialize

#: Parts into which the copies of one text are dealt before they meet.
SALTS = 64


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """One row for each row of ``docs``: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Three stages, each grouping by digest *and whole text*, so that equal digests
    never merge different texts: Spark's partial aggregation merges the copies within
    a task; the salted groups merge up to ``salts`` rows of a text in different tasks;
    the last stage merges the salts' winners. Of equal texts the largest id stays.

    Rows meet their group by digest and length only; a digest that stands for two
    texts of that length (none is known for SHA-256) stops the job rather than merge them.

    A null text counts as empty. A null id loses to any other; where all ids of a group
    are null, its ``keep_id`` is null and none is ``kept``. Repeated rows with the kept
    id are all ``kept``. An empty table gives no rows. Other columns are ignored.
    """
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    ).select("doc_id", "text", F.unhex(F.sha2("text", 256)).alias("digest"), F.octet_length("text").alias("n"))
    salted = (
        rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)))
        .groupBy("digest", "n", "salt", "text")
        .agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    )
    whole = salted.groupBy("digest", "n", "text").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    groups = materialize(
        whole.groupBy("digest", "n")
        .agg(F.count("*").alias("texts"), F.max("keep_id").alias("keep_id"), F.max("group_size").alias("group_size"))
        .select("digest", "n", "keep_id", "group_size", F.assert_true(F.col("texts") == 1, "two texts share a digest").alias("sure"))
        .where("sure is null")
        .drop("sure")
    )
    return rows.select("doc_id", "digest", "n").join(groups, ["digest", "n"]).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """The row of each distinct text with the largest id, with all columns of ``docs``.

    The same three stages, carrying the rows themselves: whole rows of a digest are
    merged locally, by salt and globally, the text being part of every grouping key.
    Rows that tie in id and text are one row. A null text equals an empty one;
    null ids lose to others, and one row stays where all ids are null.
    """
    rest = [c for c in docs.columns if c != text_col]
    plain = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    row = F.struct(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(-(2**63))).alias("_order"), *[F.col(f"`{c}`") for c in rest], F.col(f"`{text_col}`").isNull().alias("_null"))
    rows = docs.select(
        F.sha2(plain, 256).alias("_digest"),
        F.pmod(F.xxhash64(F.col(f"`{id_col}`")), F.lit(salts)).alias("_salt"),
        plain.alias("_text"),
        row.alias("_row"),
    )
    salted = rows.groupBy("_digest", "_salt", "_text").agg(F.max("_row").alias("_row"))
    best = salted.groupBy("_digest", "_text").agg(F.max("_row").alias("_row"))
    return best.select(*[F.when(F.col("_row._null"), F.lit(None)).otherwise(F.col("_text")).alias(c) if c == text_col else F.col(f"_row.`{c}`").alias(c) for c in docs.columns])
