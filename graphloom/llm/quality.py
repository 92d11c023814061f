"""Quality by importance resampling over hashed n-gram models (Xie et al. 2023), sampled by Gumbel top-k."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import U64, give_back, map_batches, materialize, mixed, small_batches

#: Buckets of the hashed n-grams: the model's size, whatever the corpus.
BUCKETS = 1 << 14
#: Most labelled rows of each class that the target model and the threshold are fitted on, lowest hash first.
MOST_LABELS = 20_000


class _Tokens(dict):
    """64-bit hashes of a white-space word's tokens (runs of word characters, runs of signs), kept for words seen before."""

    TOKENS = regex.compile(r"\w+|[^\w\s]+")

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= 50_000:
            self.clear()
        found = self[word] = tuple(xxhash.xxh3_64_intdigest(t) for t in self.TOKENS.findall(word))
        return found


def ngrams(words: list[str], tokens: _Tokens, buckets: int) -> np.ndarray:
    """Buckets of a text's unigrams and bigrams; a token that repeats the one before it counts as one kind of bigram."""
    h = np.fromiter(chain.from_iterable(map(tokens.__getitem__, words)), U64)
    pairs = np.where(h[1:] == h[:-1], U64(1), mixed(h[:-1] * U64(3) + h[1:]))
    return (np.concatenate([h, pairs]) % U64(buckets)).astype(np.int64)


@dataclass(frozen=True)
class QualityModel:
    """Log ratio of the target's and the raw model's probability for each bucket, and what makes a text's mean of them log odds.

    A text's n-grams are far from independent: their sum grows with its length, and noise would
    be nothing beside it. Labelled rows tell how sure a mean is.
    """

    ratios: np.ndarray
    slope: float
    offset: float
    seed: int = 29


def _sample_ids(labels: DataFrame, quality: int, most: int) -> frozenset[int]:
    rows = labels.where(F.col("quality") == quality).select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null")
    return frozenset(r[0] for r in rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).collect())


def _scores(docs: DataFrame, ratios: np.ndarray, id_col: str, text_col: str) -> DataFrame:
    """Per row: id, number of n-grams and the sum of their log ratios."""
    model = docs.sparkSession.sparkContext.broadcast(ratios)  # BUCKETS doubles

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _Tokens()
        for batch in batches:
            n, sums = [], []
            for text in batch.column(1):
                grams = ngrams((text.as_py() or "").split(), tokens, len(model.value))
                n.append(len(grams))
                sums.append(float(model.value[grams].sum()))
            yield pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array(sums, pa.float64())], ["doc_id", "n_grams", "log_ratio"])

    return map_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), run, "doc_id long, n_grams long, log_ratio double")


def fit(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, most_labels: int = MOST_LABELS, smoothing: float = 1.0, id_col: str = "doc_id", text_col: str = "text") -> tuple[QualityModel | None, DataFrame | None]:
    """The model and every row's scores; (None, None) where no labelled good document has an n-gram.

    The raw model counts the n-grams of all documents; the target model those of labelled
    good ones, ``most_labels`` at most. Slope and offset are those of the logistic curve that
    best tells labelled good from bad documents by their mean log ratio, both classes counting
    alike; without bad ones the log odds are 0 just below the least good one.
    """
    good, bad = _sample_ids(labels, 1, most_labels), _sample_ids(labels, 0, most_labels)
    both = docs.sparkSession.sparkContext.broadcast((good, bad))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, raw, target = _Tokens(), np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                grams = np.bincount(ngrams((text.as_py() or "").split(), tokens, buckets), minlength=buckets)
                raw += grams
                if doc_id in both.value[0]:
                    target += grams
        at = np.flatnonzero(raw)
        yield pa.record_batch([pa.array(at), pa.array(raw[at]), pa.array(target[at])], ["bucket", "raw", "target"])

    counts = map_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), count, "bucket long, raw long, target long")
    raw, target = np.zeros(buckets), np.zeros(buckets)
    for r in counts.groupBy("bucket").agg(F.sum("raw"), F.sum("target")).collect():  # one row a bucket
        raw[r[0]], target[r[0]] = r[1], r[2]
    if not target.sum():
        return None, None
    p, q = target + smoothing, raw + smoothing
    ratios = np.log(p / p.sum()) - np.log(q / q.sum())
    scores = materialize(_scores(docs, ratios, id_col, text_col))
    wanted = docs.sparkSession.createDataFrame([(i, 1) for i in good - bad] + [(i, 0) for i in bad - good] or [(None, 0)], "doc_id long, quality int")
    means = scores.where("n_grams > 0").join(F.broadcast(wanted), "doc_id").groupBy("doc_id", "quality").agg(F.avg(F.expr("log_ratio / n_grams")).alias("m"))  # one row a labelled id
    means = [(r[0], r[1]) for r in means.select("quality", "m").collect()]
    return QualityModel(ratios, *_calibrated(np.array([m for q, m in means if q]), np.array([m for q, m in means if not q]))), scores


def _calibrated(good: np.ndarray, bad: np.ndarray, ridge: float = 2e-4) -> tuple[float, float]:
    """Slope and offset of the log odds of being good by ridge logistic regression, found by Newton steps."""
    if not len(bad) or not len(good):
        scale = max(float(good.std()), 1e-6) if len(good) else 1.0
        return 1 / scale, -(float(good.min()) - 1e-6) / scale if len(good) else 0.0
    x, y = np.concatenate([good, bad]), np.concatenate([np.ones(len(good)), np.zeros(len(bad))])
    share = np.where(y == 1, 0.5 / len(good), 0.5 / len(bad))
    middle, scale = float((good.mean() + bad.mean()) / 2), max(float(x.std()), 1e-9)
    z, at = np.stack([(x - middle) / scale, np.ones(len(x))]), np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(at @ z, -500, 500)))
        gradient = z @ (share * (p - y)) + ridge * at
        step = np.linalg.solve((z * (share * p * (1 - p))) @ z.T + ridge * np.eye(2), gradient)
        at = at - step * min(1.0, 2.0 / max(float(np.abs(step).max()), 1e-12))
        if np.abs(step).max() < 1e-9:
            break
    slope = at[0] / scale
    return float(slope), float(at[1] - slope * middle)


def _weight(model: QualityModel) -> Column:
    return F.when(F.col("n_grams") > 0, model.slope * F.col("log_ratio") / F.col("n_grams") + model.offset).otherwise(0.0)


def _key(model: QualityModel) -> Column:
    """The log weight with Gumbel noise drawn from a seeded hash of the id."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(model.seed), "doc_id"), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    return _weight(model) - F.log(-F.log(u))


def _keyed(scores: DataFrame, model: QualityModel) -> DataFrame:
    return scores.select("doc_id", "n_grams", _weight(model).alias("log_weight"), _key(model).alias("gumbel_key"))


def kth_largest(df: DataFrame, col: str, k: int) -> float:
    """The k-th largest of a double column, exactly: histograms of 2**16 bins, each pass over the bin that holds it."""
    n = df.count()
    if k <= 0 or not n:
        return math.inf
    if k >= n:
        return -math.inf
    low, high = df.agg(F.min(col), F.max(col)).first()
    for _ in range(8):
        if not low < high:
            break
        width = (high - low) / 65536
        if low + width == low:
            break
        inside = df.where((F.col(col) >= low) & (F.col(col) <= high))
        above = df.where(F.col(col) > high).count()
        bins = sorted(((r[0], r[1], r[2], r[3]) for r in inside.groupBy(F.least(F.floor((F.col(col) - low) / width), F.lit(65535)).alias("bin")).agg(F.count("*"), F.min(col), F.max(col)).collect()), reverse=True)
        for _, count, least, most in bins:
            if above + count >= k:
                low, high = least, most
                break
            above += count
    return low


def select(docs: DataFrame, labels: DataFrame, k: int | None = None, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, n_grams, log_weight, gumbel_key, kept``.

    ``log_weight`` is the log of a row's importance weight: the mean over its n-grams of log
    target / raw, as the log odds that labelled rows give it. Adding seeded Gumbel noise and
    keeping the ``k`` largest keys draws k rows without replacement by weight. By default k is
    the number of rows whose odds are even or better, so that rows about the even odds are
    drawn by chance and clear ones aren't.

    Ties of the k-th key, repeated rows among them, are kept with it. A null or empty text has
    log weight 0. Long texts count by all their n-grams. Without labelled good rows (or without
    labels) nothing can be judged: all rows are kept, with null weights. An empty table gives
    no rows. Other columns are ignored.
    """
    model, scores = fit(docs, labels, id_col=id_col, text_col=text_col, **options)
    if model is None:
        return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("n_grams"), F.lit(None).cast("double").alias("log_weight"), F.lit(None).cast("double").alias("gumbel_key"), F.lit(True).alias("kept"))
    keyed = _keyed(scores, model)
    if k is None:
        k = keyed.where("log_weight >= 0").count()
    return keyed.withColumn("kept", F.col("gumbel_key") >= kth_largest(keyed, "gumbel_key", k))


def keep_good(docs: DataFrame, labels: DataFrame, k: int | None = None, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that ``select`` keeps, all columns; the rows are scored again in place, so texts aren't shuffled."""
    model, scores = fit(docs, labels, id_col=id_col, text_col=text_col, **options)
    if model is None:
        return docs
    keyed = _keyed(scores, model)
    least = kth_largest(keyed, "gumbel_key", keyed.where("log_weight >= 0").count() if k is None else k)
    ratios = docs.sparkSession.sparkContext.broadcast(model.ratios)

    @F.pandas_udf("struct<n_grams: long, log_ratio: double>")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        tokens = _Tokens()
        for texts in batches:
            found = []
            for text in texts:
                grams = ngrams((text or "").split(), tokens, len(ratios.value))
                found.append((len(grams), float(ratios.value[grams].sum())))
            yield pd.DataFrame(found, columns=["n_grams", "log_ratio"])
        give_back()

    small_batches(docs.sparkSession)
    names = docs.columns
    scored = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)]).withColumn("_score", score(f"c{names.index(text_col)}"))
    scored = scored.select("*", F.col(f"c{names.index(id_col)}").cast("long").alias("doc_id"), F.col("_score.n_grams").alias("n_grams"), F.col("_score.log_ratio").alias("log_ratio"))
    return scored.where(_key(model) >= least).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])
