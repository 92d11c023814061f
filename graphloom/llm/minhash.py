"""Near-deduplication by an inverted join of MinHash signature coordinates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import U64, WordHashes, components, map_batches, materialize, window_hashes, words_of

#: Coordinates of a signature, and how many of them two documents must share to be compared.
#: At similarity 0.75 the shared ones are Binomial(64, 0.75): fewer than 29 with a chance of 1e-7.
COORDINATES, MATCHES = 64, 29
#: A document's words are lower-cased (A-Z) and taken in shingles of this many.
SHINGLE = 5

_RANDOM = np.random.default_rng(20_11)
_MULTIPLIERS = _RANDOM.integers(1, 2**63, COORDINATES, dtype=np.uint64) * U64(2) + U64(1)
_SHIFTS = _RANDOM.integers(0, 2**63, COORDINATES, dtype=np.uint64)


def shingle_set(text: str | None, words: WordHashes) -> np.ndarray:
    """Sorted 64-bit hashes of a text's distinct 5-word shingles; of all its words where they are fewer; empty without words."""
    h = words.of(words_of(text, lower=True))
    return np.unique(window_hashes(h, min(SHINGLE, len(h)))) if len(h) else h


def _signature(shingles: np.ndarray) -> np.ndarray:
    """The least of each coordinate's 32-bit hash over the shingles."""
    least = np.full(COORDINATES, 2**64 - 1, U64)
    for at in range(0, len(shingles), 2048):
        part = shingles[at : at + 2048]
        np.minimum(least, (part[:, None] * _MULTIPLIERS + _SHIFTS).min(axis=0), out=least)
    return (least >> U64(32)).astype(np.uint32).view(np.int32)


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, size of its shingle set, a 128-bit digest of the set and its signature (null for an empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for batch in batches:
            sizes, digests, found = [], [], []
            for text in batch.column(1):
                shingles = shingle_set(text.as_py(), words)
                sizes.append(len(shingles))
                digests.append(xxhash.xxh3_128_digest(shingles.tobytes()))
                found.append(_signature(shingles) if len(shingles) else None)
            yield pa.record_batch([batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(found, pa.list_(pa.int32()))], ["doc_id", "n_shingles", "digest", "signature"])

    return map_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), run, "doc_id long, n_shingles long, digest binary, signature array<int>")


def postings(reps: DataFrame) -> DataFrame:
    """(key, id, n, common): each document under the coordinate values by which it can still reach ``MATCHES``.

    A key is a coordinate with its value. Keys of one document match nothing and go. The
    rest are ordered by document frequency, rarest first. Two documents that share
    ``MATCHES`` keys share one within the first ``len - MATCHES + 1`` of each (their rarest
    shared key has at least ``MATCHES - 1`` shared ones behind it in either list), so only
    these are posted: the most frequent lists are skipped where a document has rarer ones.
    ``common`` sums the logarithms of the lengths of all a document's lists: in a group of near
    copies it is largest for those that share most with the others.
    """
    exploded = reps.select("id", "n", F.posexplode("signature").alias("coordinate", "value")).select("id", "n", (F.shiftleft(F.col("coordinate").cast("long"), 32) + F.col("value").cast("long")).alias("key"))
    frequent = materialize(exploded.groupBy("key").agg(F.count("*").alias("df")).where("df > 1"))
    kept = exploded.join(frequent, "key").groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("df", "key"))).alias("keys"))  # COORDINATES at most
    common = F.aggregate("keys", F.lit(0.0), lambda s, k: s + F.log2(k["df"].cast("double")))
    return kept.where(F.size("keys") >= MATCHES).select("id", "n", common.alias("common"), F.explode(F.slice("keys", F.lit(1), F.size("keys") - MATCHES + 1)).alias("k")).select(F.col("k.key").alias("key"), "id", "n", "common")


def _matching(met: DataFrame, reps: DataFrame) -> DataFrame:
    """Pairs that collide in ``MATCHES`` coordinates or more; ``met`` has (a, b) with the collisions counted in posted lists.

    Pairs with enough of these are through. The others' remaining lists, the frequent ones
    among them, aren't merged but probed: the two signatures tell at once which lists hold both.
    """
    one, two = reps.select(F.col("id").alias("a"), F.col("signature").alias("sa")), reps.select(F.col("id").alias("b"), F.col("signature").alias("sb"))
    shared = F.aggregate(F.zip_with("sa", "sb", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    probed = met.where(F.col("met") < MATCHES).join(one, "a").join(two, "b").where(shared >= MATCHES)
    return met.where(F.col("met") >= MATCHES).select("a", "b").union(probed.select("a", "b"))


def verified(pairs: DataFrame, texts: DataFrame, numerator: int, denominator: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets reach the similarity; ``texts`` has (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for batch in batches:
            last, mine, keep = None, None, []
            for a, one, two in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3), strict=True):
                if a != last or last is None:
                    last, mine = a, shingle_set(one.as_py(), words)
                other = shingle_set(two.as_py(), words)
                both = len(np.intersect1d(mine, other, assume_unique=True))
                keep.append(denominator * both >= numerator * (len(mine) + len(other) - both))
            mask = pa.array(keep, pa.bool_())
            yield pa.record_batch([batch.column(0), batch.column(1)], ["a", "b"]).filter(mask)

    one, two = texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), texts.select(F.col("id").alias("b"), F.col("text").alias("tb"))
    return map_batches(pairs.join(two, "b").join(one, "a").select("a", "b", "ta", "tb"), run, "a long, b long")


def shingle_postings(texts: DataFrame, numerator: int, denominator: int) -> DataFrame:
    """(key, id, n, behind, index): documents of ``texts`` (id, text) under the shingles by which they can still reach the similarity.

    The intersection of a linked pair is at least ``numerator / denominator`` of either set,
    and ``2 * numerator / (numerator + denominator)`` of the smaller one. With shingles in the
    order of their document frequency, a linked pair shares one within the rarest that are
    over these bounds, the smaller set's (those marked ``index``) being fewer. Shingles of one
    document count in that order but aren't posted. ``behind`` counts a document's shared
    shingles from this one on: two documents that first meet here can't have more in common
    than the lesser of both, so a list skips all pairs for which that is too few.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                sets = [shingle_set(t.as_py(), words) for t in batch.column(1)[at : at + 256]]
                sizes = np.array([len(s) for s in sets], np.int64)
                ids = batch.column(0)[at : at + 256].to_numpy(zero_copy_only=False)
                yield pa.record_batch([pa.array(np.repeat(ids, sizes)), pa.array(np.repeat(sizes, sizes)), pa.array(np.concatenate(sets).view(np.int64))], ["id", "n", "key"])

    exploded = materialize(map_batches(texts.select("id", "text"), run, "id long, n long, key long"))
    frequent = materialize(exploded.groupBy("key").agg(F.count("*").alias("df")).where("df > 1"))
    kept = exploded.join(frequent, "key").groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("df", "key"))).alias("keys"))  # one document's
    least = lambda part, whole: F.ceil(F.col("n") * part / whole - 1e-9)
    posted = kept.select("id", "n", F.size("keys").alias("s"), (F.size("keys") - least(2 * numerator, numerator + denominator)).alias("few"), F.slice("keys", F.lit(1), F.greatest(F.size("keys") - least(numerator, denominator) + 1, F.lit(0)).cast("int")).alias("keys"))
    return posted.select("id", "n", "s", "few", F.posexplode("keys").alias("at", "k")).select(F.col("k.key").alias("key"), "id", "n", (F.col("s") - F.col("at")).alias("behind"), (F.col("at") <= F.col("few")).alias("index"))


def near_groups(docs: DataFrame, numerator: int = 75, denominator: int = 100, rounds: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, n_shingles, component_id, kept``.

    Documents are linked where ``denominator * intersection >= numerator * union`` of their
    shingle sets; ``component_id`` is the smallest id reachable over links.

    Equal sets meet first and are stood for by their smallest id. The representatives'
    signature coordinates are posted (``postings``). In each of ``rounds`` one member of a
    list, at first the one most in common with the others, is compared with the members in other components, which ties
    groups of near copies together without all their pairs. At last the members of lists that
    still hold several components are posted by their rarest shingles (``shingle_postings``),
    and the pairs that can reach the similarity from where they first meet are compared across
    components: no link between components is lost, and hot lists of unlinked documents
    aren't paired out. Pairs with a pivot must collide in ``MATCHES`` coordinates; all links are
    confirmed on the full sets (of 64-bit hashes of the shingles).

    Null, empty and blank texts have no shingles and are linked with nothing. A row with a
    null id has a null component and isn't kept. Repeated rows get equal results; an id with
    several texts is one document that has every link of any of them. Long texts are taken
    whole, with one row for each of their shingles in the last step only. An empty table gives
    no rows. Other columns are ignored.
    """
    rows = materialize(signatures(docs, id_col, text_col))
    sets = rows.where("n_shingles > 0 and doc_id is not null")
    groups = materialize(sets.groupBy("digest").agg(F.min_by(F.struct("doc_id", "n_shingles", "signature"), "doc_id").alias("r")).select("digest", "r.*"))
    reps = groups.select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), "signature")
    posted = materialize(postings(reps))
    wanted = materialize(posted.select("id").distinct())
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(wanted, "id", "left_semi")
    texts = materialize(texts.distinct())
    known = reps.join(wanted, "id", "left_semi")

    similar = (denominator * F.least("na", "n") >= numerator * F.greatest("na", "n")) & (F.col("ca") != F.col("component"))
    links, placed = None, posted.withColumn("component", F.col("id"))
    for turn in range(rounds):
        order = F.xxhash64(F.lit(turn), "id").cast("double") if turn else -F.col("common")
        pivots = materialize(placed.groupBy("key").agg(F.min(F.struct(order.alias("o"), "id", "n", "component")).alias("p"), F.min("component").alias("x"), F.max("component").alias("y")).where("x != y").select("key", F.col("p.id").alias("a"), F.col("p.n").alias("na"), F.col("p.component").alias("ca")))
        met = materialize(placed.join(pivots, "key").where(similar).groupBy(F.least("a", "id").alias("a"), F.greatest("a", "id").alias("b")).agg(F.count("*").alias("met")))
        found = materialize(verified(_matching(met, known), texts, numerator, denominator))
        links = found if links is None else links.union(found)
        component = materialize(components(links))
        placed = materialize(posted.join(component, "id", "left").select("key", "id", "n", "common", F.coalesce("component", "id").alias("component")))
        if found.isEmpty():
            break

    several = placed.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x != y").select("key")
    left = materialize(placed.join(several, "key", "left_semi").select("id").distinct())
    rare = shingle_postings(texts.join(left, "id", "left_semi"), numerator, denominator)
    rare = materialize(rare.join(component, "id", "left").select("key", "id", "n", "behind", "index", F.coalesce("component", "id").alias("component")))
    one = rare.where("index").select("key", F.col("id").alias("a"), F.col("n").alias("na"), F.col("behind").alias("more"), F.col("component").alias("ca"))
    enough = (numerator + denominator) * F.least("behind", "more") >= numerator * (F.col("n") + F.col("na"))
    pairs = one.join(rare, "key").where(similar & enough & (F.struct("na", "a") < F.struct("n", "id"))).select(F.least("a", "id").alias("a"), F.greatest("a", "id").alias("b")).distinct()
    found = materialize(verified(pairs, texts, numerator, denominator))

    joined = materialize(components(links.union(found)))
    by_digest = materialize(groups.select("digest", F.col("doc_id").alias("id")).join(joined, "id", "left").select("digest", F.coalesce("component", "id").alias("component")))
    return rows.join(by_digest, "digest", "left").select(
        "doc_id",
        "n_shingles",
        F.when(F.col("n_shingles") > 0, F.when(F.col("doc_id").isNotNull(), F.col("component"))).otherwise(F.col("doc_id")).alias("component_id"),
    ).select("*", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that stand for their near-duplicate group, all columns; rows with null ids stay."""
    kept = materialize(near_groups(docs, id_col=id_col, text_col=text_col, **options).where("not kept and doc_id is not null").select(F.col("doc_id").alias("_dropped")).distinct())
    return docs.join(kept, F.col(f"`{id_col}`").cast("long") == F.col("_dropped"), "left_anti")
