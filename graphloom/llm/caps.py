"""Embedding near-deduplication by spherical-cap filters (locality-sensitive filtering, Becker et al. 2016)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import components, map_batches, materialize


@dataclass(frozen=True)
class ProductCode:
    """``codes`` random rotations, each with filter directions that are sums of one random code word a block.

    A code's ``words ** blocks`` directions come from ``words * blocks`` short vectors, so all
    directions that a vector exceeds are listed without looking at the others. The caps'
    height is where random unit vectors pass ``listed`` filters of a code on average. Lists
    vary in length from vector to vector, but little over several rotations together.
    """

    words: int
    codes: int = 8
    listed: int = 4
    blocks: int = 2
    seed: int = 41

    @staticmethod
    def of(vectors: int, mates: float = 0.25) -> ProductCode:
        """A code of which a filter is passed by about ``mates`` unrelated ones of ``vectors``."""
        return ProductCode(max(24, int(np.ceil(np.sqrt(ProductCode.listed * vectors / mates)))))

    def rows(self) -> int:
        """Rows to decode at once, so that their products with all code words stay within 64 MB."""
        return int(np.clip(8_000_000 // (self.words * self.blocks * self.codes), 1, 1024))

    def scores(self, unit: np.ndarray, code: int) -> list[np.ndarray]:
        """For each block the products of the rotated vectors with its code words."""
        dim = unit.shape[1]
        cuts = np.linspace(0, dim, self.blocks + 1).astype(int)
        turned = unit @ np.linalg.qr(np.random.default_rng([self.seed, dim, code]).standard_normal((dim, dim)))[0]
        out = []
        for block, width in enumerate(np.diff(cuts)):
            words = np.random.default_rng([self.seed, dim, code, block]).standard_normal((self.words, width))
            words *= np.sqrt(width) / np.maximum(np.linalg.norm(words, axis=1, keepdims=True), 1e-12)
            out.append(turned[:, cuts[block] : cuts[block + 1]] @ words.T)
        return out

    def decode(self, unit: np.ndarray) -> Iterator[np.ndarray]:
        """For each row of unit vectors the numbers of all filters whose height it reaches, or of each code's best one."""
        dim = unit.shape[1]
        codes = [self.scores(unit, code) for code in range(self.codes)]
        heights = [_height(self, dim, code) for code in range(self.codes)]
        ends = [np.concatenate([np.cumsum([s.max(axis=1) for s in scores[:0:-1]], axis=0)[::-1], np.zeros((1, len(unit)))]) for scores in codes]
        for row in range(len(unit)):
            found = []
            for code, scores in enumerate(codes):
                numbers, sums = np.full(1, code, np.int64), np.zeros(1)
                for block in range(self.blocks):  # a beginning goes on while the best ends can lift it to the cap
                    sums = (sums[:, None] + scores[block][row]).ravel()
                    bound = sums + ends[code][block][row]
                    going = np.flatnonzero(bound >= min(heights[code], bound.max()))
                    numbers, sums = (numbers[going // self.words] * self.words + going % self.words), sums[going]
                found.append(numbers)
            yield np.concatenate(found)


@lru_cache(maxsize=256)
def _height(code: ProductCode, dim: int, number: int, samples: int = 256) -> float:
    unit = np.random.default_rng([code.seed, dim]).standard_normal((samples, dim))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    scores, top = code.scores(unit, number), []
    keep = min(50 * code.listed, code.words**code.blocks)
    for row in range(samples):
        sums = np.zeros(1)
        for s in scores:  # the largest sums begin with the largest beginnings and end with the largest ends
            ends = s[row] if code.words <= keep else np.partition(s[row], code.words - keep)[-keep:]
            sums = (sums[:, None] + ends).ravel()
            sums = sums if len(sums) <= keep else np.partition(sums, len(sums) - keep)[-keep:]
        top.append(sums)
    return float(np.sort(np.concatenate(top))[-min(code.listed * samples, sum(map(len, top)))])


def _vectors(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """Rows with their unit vector (double; null where it links with nothing) and a digest of their components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units, digests = [], []
            for label, vector in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                x = np.array([], float) if vector is None or None in vector or not label.is_valid else np.array(vector, float)
                largest = np.abs(x).max() if len(x) else 0.0
                if not (np.isfinite(largest) and largest > 0):
                    units.append(None)
                    digests.append(None)
                    continue
                digests.append(xxhash.xxh3_128_digest((x + 0.0).tobytes()))
                x = x / largest
                units.append(x / np.sqrt(x @ x))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(units, pa.list_(pa.float64())), pa.array(digests, pa.binary())], ["vec_id", "label", "unit", "digest"])

    return map_batches(vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("v")), run, "vec_id long, label string, unit array<double>, digest binary")


def _listed(reps: DataFrame, code: ProductCode) -> DataFrame:
    """(label, dim, filter, id): every representative under all filters it passes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, dims, labels = batch.column(0).to_numpy(zero_copy_only=False), np.array([len(u) for u in batch.column(2)]), batch.column(1)
            for dim in np.unique(dims):
                rows = np.flatnonzero(dims == dim)
                unit = batch.column(2).take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(len(rows), dim)
                step = code.rows()
                for at in range(0, len(rows), step):
                    found = list(code.decode(unit[at : at + step]))
                    which = np.repeat(rows[at : at + step], [len(f) for f in found])
                    numbers = np.concatenate(found)
                    yield pa.record_batch([labels.take(pa.array(which)), pa.array(np.full(len(which), dim, np.int32)), pa.array(numbers), pa.array(ids[which])], ["label", "dim", "filter", "id"])

    return map_batches(reps.select("id", "label", "unit"), run, "label string, dim int, filter long, id long")


def cap_links(reps: DataFrame, threshold: float, code: ProductCode) -> DataFrame:
    """Pairs (a, b), a < b, of ``reps`` (id, label, unit) that share a label and a filter and reach the cosine, each once."""
    listed = materialize(_listed(reps, code))
    one, two = listed.withColumnRenamed("id", "a"), listed.withColumnRenamed("id", "b")
    pairs = materialize(one.join(two, ["label", "dim", "filter"]).where("a < b").select("a", "b").distinct())
    u, v = reps.select(F.col("id").alias("a"), F.col("unit").alias("u")), reps.select(F.col("id").alias("b"), F.col("unit").alias("v"))
    cosine = F.aggregate(F.zip_with("u", "v", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return pairs.join(u, "a").join(v, "b").where(cosine >= threshold).select("a", "b")


def cap_groups(vectors: DataFrame, threshold: float = 0.93, code: ProductCode | None = None, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row for each row of ``vectors``: ``vec_id, n_links, component_id, kept``.

    Vectors of equal labels are linked if their cosine, in double precision, reaches
    ``threshold`` and they pass a common filter. Equal vectors of a label are one
    representative, linked among themselves without being paired; ``n_links`` counts the
    other rows linked directly, and ``component_id`` is the smallest id reachable.

    The code's size follows the largest label, so that unrelated vectors seldom meet; pairs
    planted at a cosine of just 0.93 share 12 of about 32 filters on average. Null or
    empty vectors, zero ones, those with null or non-finite components and those with a null
    label link with nothing. A null id has a null component and isn't kept, and its links
    don't reach further. Repeated rows count as vectors of their own with one id. An empty
    table gives no rows. Other columns are ignored.
    """
    rows = materialize(_vectors(vectors, id_col, vector_col, label_col))
    valid = rows.where("unit is not null and vec_id is not null")
    groups = materialize(valid.groupBy("label", "digest").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"), F.first("unit").alias("unit")))
    largest = groups.groupBy("label").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    links = materialize(cap_links(groups.select("id", "label", "unit"), threshold, code or ProductCode.of(largest)))
    sizes = groups.groupBy("id").agg(F.sum("copies").alias("copies"))
    both = links.select(F.col("a").alias("id"), F.col("b").alias("other")).union(links.select(F.col("b").alias("id"), F.col("a").alias("other")))
    linked = both.join(sizes.withColumnRenamed("id", "other"), "other").groupBy("id").agg(F.sum("copies").alias("linked"))
    placed = groups.select("label", "digest", "id", "copies").join(linked, "id", "left").join(components(links), "id", "left")
    placed = materialize(placed.select("label", "digest", (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("component_id")))
    own = rows.select("vec_id", "label", "digest")
    return (
        own.join(placed, ["label", "digest"], "left")
        .select("vec_id", F.when(F.col("vec_id").isNotNull(), F.coalesce("n_links", F.lit(0))).otherwise(F.lit(0)).alias("n_links"), F.when(F.col("vec_id").isNotNull(), F.coalesce("component_id", "vec_id")).alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
    )
