"""The prefix trie of conversations by partition refinement."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm.common import materialize, new_folder

#: Bytes of decimal ids that one row of an end list holds at most.
CHUNK = 32_768
_EMPTY = hashlib.sha256().hexdigest()
_NODE = "conv_id long, parent_conv_id long, n_convs long, chars long, total long"


def turns_of(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, pos, digest, chars): turns numbered from 0 by turn, nulls first, with a SHA-256 of role and text and the text's code points.

    Rows that tie in turn come by role, then by digest; repeated rows are turns of their own. A
    null role or text counts as empty; rows with a null id belong to no conversation and go.
    Numbers are counted within range partitions, so that a conversation may lie in many.
    """
    role, text = (F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in (role_col, text_col))
    rows = conversations.where(F.col(f"`{id_col}`").isNotNull()).select(
        F.col(f"`{id_col}`").cast("long").alias("conv_id"),
        F.col(f"`{turn_col}`").alias("turn"),
        role.alias("role"),
        F.unhex(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256)).alias("digest"),
        F.char_length(text).cast("long").alias("chars"),
    )
    order = ["conv_id", "turn", "role", "digest"]
    ranged = materialize(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    sizes = ranged.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.select("conv_id", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = F.row_number().over(Window.partitionBy("conv_id", "part").orderBy("turn", "role", "digest"))
    return ranged.withColumn("inside", inside).join(first, ["conv_id", "part"]).select("conv_id", (F.col("first") + F.col("inside") - 1).alias("pos"), "digest", "chars")


def lengths_of(turns: DataFrame) -> DataFrame:
    """(conv_id, total): the number of turns of each conversation that has any."""
    return turns.groupBy("conv_id").agg(F.count("*").alias("total"))


def spliced(turns: DataFrame, convs: DataFrame, every: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """Each conversation c with its first h turns put in place by those of c - c % ``every``; h is crc32 of c's decimals modulo ``most``.

    Where that conversation has fewer turns or doesn't exist, all or none are put in; c may then be left without turns.
    """
    known = convs.select("conv_id", F.col("total").alias("own"), (F.col("conv_id") - F.col("conv_id") % every).alias("base"), (F.crc32(F.col("conv_id").cast("string")) % most).alias("h"))
    bases = convs.select(F.col("conv_id").alias("base"), F.col("total").alias("there"))
    plan = materialize(known.join(bases, "base", "left").withColumn("head", F.least("h", F.coalesce("there", F.lit(0)))))
    heads = turns.where((F.col("conv_id") % every == 0) & (F.col("pos") < most)).withColumnRenamed("conv_id", "base").join(plan.select("conv_id", "base", "h"), "base").where("pos < h")
    rest = turns.join(plan.select("conv_id", "h", "head"), "conv_id").where("pos >= h").withColumn("pos", F.col("pos") - F.col("h") + F.col("head"))
    totals = plan.select("conv_id", (F.col("head") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("total"))
    return heads.select("conv_id", "pos", "digest", "chars").union(rest.select("conv_id", "pos", "digest", "chars")), totals


def _put(df: DataFrame, folder: str, depth: int) -> DataFrame:
    """``df`` written as one level of a folder, and read back."""
    path = f"{folder}/depth={depth}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _levels(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.read.schema(f"{schema}, depth int").parquet(folder).withColumn("depth", F.col("depth").cast("long"))


def _refined(turns: DataFrame, convs: DataFrame) -> tuple[str, str, int]:
    """Folders of the classes found and of the members of classes that are split further, a level a depth, and the last depth with such a class.

    The first class holds all conversations. In each round the members of a class part by
    their next turn; a class is named by its smallest member. A class of one member isn't
    split again. Rounds end when no class has two members: as many as turns that two
    conversations share from the start. Turns lie in the order of ``pos``, so that a round
    reads its own.
    """
    spark = turns.sparkSession
    classes, members = new_folder(spark), new_folder(spark)
    _put(convs.agg(F.min("conv_id").alias("conv_id"), F.lit(None).cast("long").alias("parent_conv_id"), F.count("*").alias("n_convs"), F.lit(0).cast("long").alias("chars"), F.max("total").alias("total")), classes, 0)
    least = convs.agg(F.min("conv_id")).first()[0]
    active, depth = _put(convs.select("conv_id", F.lit(least).cast("long").alias("class"), "total"), members, 0), 0
    while True:
        following = materialize(active.join(turns.where(F.col("pos") == depth), "conv_id").select("conv_id", "class", "total", "digest", "chars"))
        parts = following.groupBy("class", "digest")
        split = materialize(parts.agg(F.min("conv_id").alias("label"), F.count("*").alias("n"), F.max("chars").alias("chars"), F.max("total").alias("total")))
        _put(split.select(F.col("label").alias("conv_id"), F.col("class").alias("parent_conv_id"), F.col("n").alias("n_convs"), "chars", "total"), classes, depth + 1)
        if split.where("n > 1").isEmpty():
            return classes, members, depth
        depth += 1
        active = _put(following.join(split.where("n > 1").select("class", "digest", "label"), ["class", "digest"]).select("conv_id", F.col("label").alias("class"), "total"), members, depth)


def _folded(spark: SparkSession, classes: str, last: int) -> DataFrame:
    """Classes that were split, from the deepest up, with what their subtrees sum to."""
    out, below = new_folder(spark), None
    for depth in range(last, -1, -1):
        read = lambda d: spark.read.schema(_NODE).parquet(f"{classes}/depth={d}")
        one = F.col("n_convs") == 1
        children = read(depth + 1).where(one).select("parent_conv_id", F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"))
        if below is not None:
            children = children.union(below.select("parent_conv_id", "n_leaves", "saved_tokens"))
        sums = children.groupBy(F.col("parent_conv_id").alias("conv_id")).agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("below"))
        nodes = read(depth) if depth == 0 else read(depth).where(~one)
        folded = nodes.join(sums, "conv_id", "left").select(
            "conv_id",
            "parent_conv_id",
            "n_convs",
            F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
            F.coalesce("n_leaves", F.lit(1)).cast("long").alias("n_leaves"),
            ((F.col("n_convs") - 1) * F.col("chars") + F.coalesce("below", F.lit(0))).cast("long").alias("saved_tokens"),
        )
        below = _put(folded, out, depth)
    return _levels(spark, out, "conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long")


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (depth, class, conv_id) to rows of one class's ids each, joined by commas."""
    key, first, ids, size, rows = None, None, [], 0, []

    def full() -> None:
        if ids:
            rows.append((*key, first, ",".join(ids)))

    for batch in batches:
        for depth, label, conv in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (depth, label) != key or size >= CHUNK:
                full()
                key, first, ids, size = (depth, label), conv, [], 0
            ids.append(str(conv))
            size += len(ids[-1]) + 1
        if rows:
            yield pa.record_batch(list(map(list, zip(*rows, strict=True))), ["depth", "conv_id", "first", "ids"])
            rows.clear()
    full()
    if rows:
        yield pa.record_batch(list(map(list, zip(*rows, strict=True))), ["depth", "conv_id", "first", "ids"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted chunks to one digest a class."""
    key, digest, rows = None, None, []

    def done() -> None:
        if key is not None:
            rows.append((*key, digest.hexdigest()))

    for batch in batches:
        for depth, label, ids in zip(*(batch.column(k).to_pylist() for k in ("depth", "conv_id", "ids")), strict=True):
            if (depth, label) == key:
                digest.update(b"," + ids.encode())
            else:
                done()
                key, digest = (depth, label), hashlib.sha256(ids.encode())
        if rows:
            yield pa.record_batch(list(map(list, zip(*rows, strict=True))), ["depth", "conv_id", "ends_sha256"])
            rows.clear()
    done()
    if rows:
        yield pa.record_batch(list(map(list, zip(*rows, strict=True))), ["depth", "conv_id", "ends_sha256"])


def _ends(members: DataFrame) -> DataFrame:
    """(depth, conv_id, ends_sha256) of the classes in which conversations end.

    Ids are joined in range partitions first, so that the hash, which can't be split, meets
    a few rows a class and holds none of them.
    """
    ended = members.where(F.col("total") == F.col("depth")).select("depth", "class", "conv_id")
    order = ["depth", "class", "conv_id"]
    chunks = ended.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_chunks, "depth long, conv_id long, first long, ids string")
    return chunks.repartition("depth", "conv_id").sortWithinPartitions("depth", "conv_id", "first").mapInArrow(_digests, "depth long, conv_id long, ends_sha256 string")


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """The nodes of the trie of turn sequences: one row for each distinct beginning of a conversation, the empty one (the root) included.

    ``turns`` has (conv_id, pos, digest, chars) with pos from 0 without gaps, as ``turns_of``
    gives it; ``convs`` has (conv_id, total), total being the conversation's turns or 0. The
    result names a node by its smallest member ``conv_id`` and its ``depth``: with
    ``parent_conv_id``, members ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens``
    (code points of turns that members beyond the first needn't repeat) and ``ends_sha256``.

    Classes with two members or more are split turn by turn (``_refined``) and folded back from
    the deepest up; a class of one is retired, its remaining turns a chain of nodes. Equal
    conversations share all nodes. Without conversations there are no nodes, not even a root.
    """
    convs = materialize(convs.select("conv_id", F.col("total").cast("long").alias("total")))
    spark = turns.sparkSession
    if convs.isEmpty():
        return spark.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    turns = materialize(turns.withColumn("pos", F.col("pos").cast("long")).repartitionByRange("pos", "conv_id").sortWithinPartitions("pos", "conv_id"))
    classes, members, last = _refined(turns, convs)
    ends = _ends(_levels(spark, members, "conv_id long, class long, total long"))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    shared = _folded(spark, classes, last).join(ends, ["depth", "conv_id"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(_EMPTY)))
    retired = _levels(spark, classes, _NODE).where("n_convs = 1 and depth > 0").select("conv_id", F.col("depth").alias("since"), F.col("parent_conv_id").alias("class"), "total")
    tails = turns.select("conv_id", (F.col("pos") + 1).alias("depth")).join(retired, "conv_id").where("depth >= since")
    is_last = F.col("depth") == F.col("total")
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    chain = tails.select(
        "conv_id",
        "depth",
        F.when(F.col("depth") == F.col("since"), F.col("class")).otherwise(F.col("conv_id")).alias("parent_conv_id"),
        one.alias("n_convs"),
        F.when(is_last, none).otherwise(one).alias("n_children"),
        one.alias("n_leaves"),
        none.alias("saved_tokens"),
        F.when(is_last, F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(F.lit(_EMPTY)).alias("ends_sha256"),
    )
    return shared.select(*columns).union(chain.select(*columns))
