"""Spelling variants: words one edit apart, found in a forward and a reversed sorted dictionary."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import map_batches, materialize

#: A word's least code points and occurrences; times that a form is more frequent than its variant.
LEAST_LENGTH, LEAST_COUNT, RATIO = 7, 2, 10
#: One in so many (document, run) pairs loses a code point.
SLIPS = 31
#: Words of a block that a task compares; larger blocks are subdivided.
BLOCK = 48
#: Distinct words that a task counts before it hands them on, and code points from which a text's runs are taken one by one.
MOST, LONG = 200_000, 1_000_000
RUN = re.compile("[A-Za-zÀ-ÿ]+")
_BLOCK = ["kind", "size", "low", "high", "head", "tail"]
_ENTRY = "kind int, size int, low int, high int, head string, tail string, word string, n long"


def words_of(doc_id: int | None, text: str | None, slips: int = SLIPS) -> Counter:
    """The runs of a text with A-Z in lower case, each with its count; a run whose crc32 with the document's id (none: empty) ``slips`` divides loses a code point."""
    lower = (text or "").encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
    runs = Counter(RUN.findall(lower) if len(lower) <= LONG else (m.group() for m in RUN.finditer(lower)))
    start, out = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode()), Counter()
    for run, n in runs.items():
        h = zlib.crc32(run.encode(), start)
        if h % slips == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        out[run] += n
    return out


def dictionary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n): the words of all texts with their occurrences. Tasks count locally, at most ``MOST`` words at a time, before counts meet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        full = lambda: pa.record_batch([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for word, n in words_of(doc_id, text.as_py()).items():
                    if len(word) >= least_length:
                        counts[word] += n
                if len(counts) >= MOST:
                    yield full()
                    counts.clear()
        if counts:
            yield full()

    rows = map_batches(docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")), run, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _keyed(words: DataFrame, sides: Column) -> DataFrame:
    """A row for each element of ``sides`` (kind, size, low, high): with the beginning and the reversed end that the block's words share."""
    rows = words.select("word", "n", F.explode(sides).alias("s")).select("s.*", "word", "n")
    shared = F.col("size") - F.when(F.col("kind") == 0, 1).otherwise(0) - F.col("high")
    return rows.withColumns({"head": F.substring("word", F.lit(1), F.col("low")), "tail": F.reverse(F.when(shared > 0, F.substring("word", -shared, shared)).otherwise(""))}).select(*_BLOCK, "word", "n")


def _halves(kind: Column, size: Column, low: Column, high: Column) -> list[Column]:
    """The two parts of a block whose pairs share between ``low`` and ``high`` code points at their start: those that share half of the rest too, and the others, who share the other half at their end."""
    middle = low + F.ceil((high - low) / 2).cast("int")
    part = lambda a, b: F.struct(kind.cast("int").alias("kind"), size.cast("int").alias("size"), a.cast("int").alias("low"), b.cast("int").alias("high"))
    return [part(middle, high), part(low, middle - 1)]


def entries(words: DataFrame, least_length: int = LEAST_LENGTH) -> DataFrame:
    """Both dictionaries: each word in the blocks of its first and of its last half.

    Of two words one edit apart, the shorter of ``size`` code points, the common beginning
    and the common end make up ``size`` (an insertion, kind 1) or ``size`` - 1 (a replacement,
    kind 0) code points at least. A pair belongs to the block that holds the length of its
    common beginning between ``low`` and ``high``, so that it is met once.
    """
    n, zero = F.char_length("word"), F.lit(0)
    sides = [*_halves(zero, n, zero, n - 1), *_halves(F.lit(1), n, zero, n), *_halves(F.lit(1), n - 1, zero, n - 1)]
    return _keyed(words, F.filter(F.array(*sides), lambda s: s["size"] >= least_length))


def subdivided(rows: DataFrame, most: int = BLOCK) -> DataFrame:
    """Entries with blocks of more than ``most`` words halved again and again, until a block's words share all but one code point: such blocks are as small as an alphabet."""
    done: list[DataFrame] = []
    while True:
        skewed = materialize(rows.groupBy(*_BLOCK).agg(F.count("*").alias("words")).where((F.col("words") > most) & (F.col("low") < F.col("high"))).select(*_BLOCK))
        if skewed.isEmpty():
            break
        done.append(rows.join(skewed, _BLOCK, "left_anti"))
        rows = materialize(_keyed(rows.join(skewed, _BLOCK, "left_semi"), F.array(*_halves(*map(F.col, _BLOCK[:4])))))
    for other in done:
        rows = rows.union(other.select(*rows.columns))
    return rows


def near(w: str, v: str) -> bool:
    """One inserted, deleted or replaced code point makes one of the other."""
    if len(w) == len(v):
        return sum(map(str.__ne__, w, v)) == 1
    if len(w) > len(v):
        w, v = v, w
    if len(w) + 1 != len(v):
        return False
    at = next((i for i, (a, b) in enumerate(zip(w, v, strict=False)) if a != b), len(w))
    return w[at:] == v[at + 1 :]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranges of equal blocks in sorted entries: for each word of a range with near words there, how many and the most frequent."""

    def rows() -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

    out: list[tuple] = []
    for (kind, size, low, high, *_), group in groupby(rows(), lambda r: r[:6]):
        members = [r[6:] for r in group]
        if len(members) == 1:
            continue
        shared = size - (kind == 0) - high
        rests = [w[low : len(w) - shared] for w, _ in members]
        short = [i for i, (w, _) in enumerate(members) if len(w) == size]
        found: dict[int, list[int]] = {}
        for k, i in enumerate(short):
            for j in short[k + 1 :] if kind == 0 else (j for j, (w, _) in enumerate(members) if len(w) > size):
                apart = members[i][0][: high + 1] != members[j][0][: high + 1]  # else they share more than ``high``
                if apart and near(rests[i], rests[j]):
                    found.setdefault(i, []).append(j)
                    found.setdefault(j, []).append(i)
        for i, others in found.items():
            n, form = min((-members[j][1], members[j][0]) for j in others)
            out.append((members[i][0], len(others), -n, form))
        if len(out) > 10_000:
            yield pa.record_batch(list(map(list, zip(*out, strict=True))), ["word", "near", "form_n", "form"])
            out = []
    if out:
        yield pa.record_batch(list(map(list, zip(*out, strict=True))), ["word", "near", "form_n", "form"])


def near_words(words: DataFrame, least_length: int = LEAST_LENGTH, most: int = BLOCK) -> DataFrame:
    """(word, n_near, form_n, form) of the words that have near ones: their number, and the most frequent, of equals the first by code point."""
    ranged = subdivided(entries(words, least_length), most).repartitionByRange(*_BLOCK).sortWithinPartitions(*_BLOCK, "word")
    found = ranged.mapInArrow(_scan, "word string, near long, form_n long, form string")
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), F.min(F.struct((-F.col("form_n")).alias("m"), "form")).alias("best")).select("word", "n_near", (-F.col("best.m")).alias("form_n"), "best.form")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for each (word, form): where forms end. Ways are doubled in each round; a form being more frequent than its variant, there are no circles."""
    ways = materialize(forms.select("word", F.col("form").alias("root")))
    while True:
        on = ways.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        joined = materialize(ways.join(on, "root", "left"))
        if joined.where("beyond is not null").isEmpty():
            return ways
        ways = joined.select("word", F.coalesce("beyond", "root").alias("root"))


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, ratio: int = RATIO, most: int = BLOCK) -> DataFrame:
    """One row for each word: ``form`` (the near word of which it is a variant, or null), ``root`` (the last form), ``n``, ``n_near``, ``form_n``.

    A null text has no words; a null id counts as empty where runs lose code points; repeated
    rows count again. Of near words that tie in occurrences the first by code point is the
    form. Texts without words and empty tables give no rows. Texts are read whole however long
    they are; other columns are ignored, whatever their names.
    """
    words = materialize(dictionary(docs, id_col, text_col, least_length, least_count))
    close = materialize(near_words(words, least_length, most))
    known = words.join(close, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), *[F.when(F.col("form_n") >= ratio * F.col("n"), F.col(c)).alias(c) for c in ("form", "form_n")])
    known = materialize(known)
    ends = roots(known.where("form is not null"))
    return known.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
