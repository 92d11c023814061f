"""Substring deduplication over a compacted De Bruijn graph of token k-mers."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import BASES, U64, WordHashes, map_batches, materialize, mixed, prefix_hashes, span_hashes, words_of

#: Words of a window, and of the k-mers that are the graph's edges.
WINDOW, KMER = 50, 20


def anchors(h: np.ndarray, window: int = WINDOW, k: int = KMER) -> np.ndarray:
    """Starts of the k-mers that are, in some window, the leftmost with the least hash.

    They depend on the window's words only, so equal windows hold equal anchors, and every
    window holds one: the graph needs no other edges.
    """
    if len(h) < window:
        return np.array([], np.int64)
    starts = np.arange(len(h) - k + 1)
    value = mixed(span_hashes(prefix_hashes(h, BASES[0]), starts, starts + k) ^ U64(0x5851F42D4C957F2D))
    least = np.lib.stride_tricks.sliding_window_view(value, window - k + 1).argmin(axis=1)
    return np.unique(least + np.arange(len(least)))


def _edges(h: np.ndarray, at: np.ndarray, k: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the k-mers at ``at`` and of the words from each to the end of its neighbour before and after; 0 at a document's ends."""
    prefix = prefix_hashes(h, BASES[0])
    key = span_hashes(prefix, at, at + k)
    steps = span_hashes(prefix_hashes(h, BASES[1]), at[:-1], at[1:] + k) if len(at) else key
    zero = np.zeros(min(1, len(at)), U64)
    mask = U64((1 << bits) - 1)
    return key, np.concatenate([zero, steps >> U64(32) & mask | U64(1)]), np.concatenate([steps & mask | U64(1), zero])


def _signed(a: np.ndarray) -> pa.Array:
    return pa.array(a.astype(U64).view(np.int64))


def _half(a: np.ndarray) -> pa.Array:
    """The low 32 bits; a path's step is compared from both of its ends, so 64 bits decide together."""
    return pa.array(a.astype(np.uint32).view(np.int32))


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Ids and texts with the key of equal rows."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("row", F.xxhash64("text"))


def _graph(rows: DataFrame, window: int, k: int, bits: int) -> DataFrame:
    """One row per edge and place: key, doc_id, row, place, hashes of the steps before and after."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                ids, keys, out = batch.column(0)[at : at + 128].to_numpy(zero_copy_only=False), batch.column(2)[at : at + 128].to_numpy(zero_copy_only=False), []
                for doc_id, row, text in zip(ids, keys, batch.column(1)[at : at + 128], strict=True):
                    h = words.of(words_of(text.as_py()))
                    places = anchors(h, window, k)
                    out.append((np.full(len(places), doc_id, np.int64), np.full(len(places), row, np.int64), places, *_edges(h, places, k, bits)))
                doc_id, row, places, key, before, after = map(np.concatenate, zip(*out, strict=True))
                yield pa.record_batch([_signed(key), pa.array(doc_id), pa.array(row), pa.array(places.astype(np.int32)), _half(before), _half(after)], ["key", "doc_id", "row", "place", "before", "after"])

    return map_batches(rows.where("doc_id is not null and text is not null").select("doc_id", "text", "row"), run, "key long, doc_id long, row long, place int, before int, after int")


def _paths(h: np.ndarray, edges: dict, window: int, k: int) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """For a document's windows: the least document known to hold each (-1 none), the starts of those still to be looked up, and the paths that settle any (first and last edge).

    ``edges`` has arrays place, owner (least document), joined (the step to the next edge
    belongs to a nonbranching path), for the document's repeated edges in order.
    """
    n = max(len(h) - window + 1, 0)
    owner = np.full(n, -1, np.int64)
    doubtful = np.zeros(n, bool)
    places, owners, joined = edges["place"], edges["owner"], edges["joined"]
    every = anchors(h, window, k)
    index = np.searchsorted(every, places)
    linked = joined[:-1] & (np.diff(index) == 1) & (owners[:-1] == owners[1:])
    first = np.concatenate([[True], ~linked])
    starts, ends = np.flatnonzero(first), np.append(np.flatnonzero(first)[1:], len(places))
    # Windows that hold a repeated edge, each under the edge it is known by: the leftmost least one it holds.
    for i in range(len(places)):
        doubtful[max(places[i] + k - window, 0) : places[i] + 1] = True
    paths = []
    for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
        low, high = places[s], places[e - 1] + k - window
        if high >= low:  # windows within one path occur wherever its edges do
            owner[low : high + 1] = owners[s]
            doubtful[low : high + 1] = False
            paths.append((s, e - 1))
    return owner, np.flatnonzero(doubtful), paths


def _unlike(settled: DataFrame) -> DataFrame:
    """Paths (key of the first edge, owner, length, digest) whose words in a document differ from those at the coordinates of their owner, which settles the same paths.

    A path's rows in many documents are alike and combine before the shuffle.
    """
    spans = settled.select("doc_id", F.explode("spans").alias("s")).select("s.*", (F.col("doc_id") == F.col("s.owner")).alias("own"))
    return spans.groupBy("key", "owner", "length", "digest").agg(F.max("own").alias("own")).where("not own")


def drop_repeats(docs: DataFrame, window: int = WINDOW, k: int = KMER, texts: bool = True, id_col: str = "doc_id", text_col: str = "text", bits: int = 32) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, n_words, n_removed, kept_sha256`` and, if ``texts``, ``kept_text``.

    A word is removed if a window of ``window`` consecutive words covers it whose word
    sequence also starts in a document with a smaller id, windows being judged on the input.

    Each document becomes a path over the graph whose edges are token k-mers (the anchors of
    its windows). Edges that two documents share are joined back to their places with the
    least document that holds them and with whether their step to the next edge is the only
    one anywhere. Runs of such steps are nonbranching paths: all their windows occur in just
    the documents of any of their edges, so a path is settled as one span at its source
    coordinates. The words of every such span are then compared, as SHA-256 digests taken at
    its coordinates in each document, with those of its owner; where any differ, because hashes of k-mers or
    steps (``bits`` of each, twice) were equal by chance, no path stands and every window of a
    repeated edge is looked up. Windows over a path's ends or a branch are looked up one by one, by
    128-bit hashes of all their words.

    A null text has no words. Rows with a null id keep all words and stand for nothing.
    Repeated rows are treated alike; an id's own windows never remove its words. An empty
    table gives no rows. Other columns are ignored.
    """
    rows = _rows(docs, id_col, text_col)
    graph = materialize(_graph(rows, window, k, bits))
    shared = materialize(
        graph.groupBy("key")
        .agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last"), F.min("before").alias("b1"), F.max("before").alias("b2"), F.min("after").alias("a1"), F.max("after").alias("a2"))
        .where("owner < last")
        .select("key", "owner", ((F.col("b1") == F.col("b2")) & (F.col("b1") != 0)).alias("one_before"), ((F.col("a1") == F.col("a2")) & (F.col("a1") != 0)).alias("one_after"))
    )

    span = pa.struct([("key", pa.int64()), ("owner", pa.int64()), ("length", pa.int32()), ("digest", pa.binary())])

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, min(64, batch.num_rows - at))
                out = []
                for doc_id, text, edges in zip(part.column(0).to_pylist(), part.column(1), part.column(3), strict=True):
                    tokens = words_of(text.as_py())
                    n, known, open_, hashes, spans = len(tokens), np.array([], np.int64), np.array([], np.int64), (np.array([], U64),) * 2, []
                    if edges.is_valid and doc_id is not None:
                        e = edges.values.flatten()
                        place, owner, before, after, key = (x.to_numpy(zero_copy_only=False) for x in e)
                        h = words.of(tokens)
                        joined = after & np.append(before[1:], False)
                        owners, open_, paths = _paths(h, {"place": place.astype(np.int64), "owner": owner, "joined": joined}, window, k)
                        known = np.flatnonzero((owners >= 0) & (owners < doc_id))
                        for s, e in paths:
                            start, end = int(place[s]), int(place[e]) + k
                            spans.append({"key": int(key[s]), "owner": int(owner[s]), "length": end - start, "digest": hashlib.sha256(b" ".join(tokens[start:end])).digest()})
                        hashes = tuple(span_hashes(prefix_hashes(h, b), open_, open_ + window) for b in BASES)
                    kept = None if len(open_) else _kept(tokens, known, window)
                    joined_kept = b" ".join(kept) if kept is not None else None
                    out.append((doc_id, text.as_py() if len(open_) else None, n, n - len(kept) if kept is not None else None, joined_kept.decode("utf-8", "surrogatepass") if texts and kept is not None else None, _digest(joined_kept), known.astype(np.int32), open_.astype(np.int32), hashes[0].view(np.int64), hashes[1].view(np.int64), spans))
                doc_id, text, n, gone, kept, digest, known, open_, one, two, spans = zip(*out, strict=True)
                lists = [pa.array(x, pa.list_(t)) for x, t in ((known, pa.int32()), (open_, pa.int32()), (one, pa.int64()), (two, pa.int64()), (spans, span))]
                yield pa.record_batch([part.column(0), part.column(2), pa.array(text, pa.string()), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string()), pa.array(digest, pa.string()), *lists], ["doc_id", "row", "text", "n_words", "n_removed", "kept_text", "kept_sha256", "known", "open", "one", "two", "spans"])

    def settled_by(shared: DataFrame) -> DataFrame:
        places = graph.select("key", "doc_id", "row", "place").join(shared, "key")
        by_doc = places.groupBy("doc_id", "row").agg(F.sort_array(F.collect_set(F.struct("place", "owner", "one_before", "one_after", "key"))).alias("edges"))  # one document's
        return materialize(
            map_batches(
                rows.join(by_doc, ["doc_id", "row"], "left").select("doc_id", "text", "row", "edges"),
                settle,
                "doc_id long, row long, text string, n_words long, n_removed long, kept_text string, kept_sha256 string, known array<int>, open array<int>, one array<long>, two array<long>, spans array<struct<key:long,owner:long,length:int,digest:binary>>",
            )
        )

    settled = settled_by(shared)
    if not _unlike(settled).isEmpty():
        settled = settled_by(shared.select("key", "owner", *[F.lit(False).alias(c) for c in ("one_before", "one_after")]))
    columns = ["doc_id", "n_words", "n_removed", "kept_sha256", *["kept_text"] * texts]
    done = settled.where("n_removed is not null").select(columns)
    left = settled.where("n_removed is null")
    windows = left.select("doc_id", "row", F.explode(F.arrays_zip("open", "one", "two")).alias("w")).select("doc_id", "row", "w.*")
    least = materialize(windows.groupBy("one", "two").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last")).where("owner < last").drop("last"))
    more = windows.join(least, ["one", "two"]).where("owner < doc_id").groupBy("doc_id", "row").agg(F.collect_set("open").alias("more"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone, kept, digests = [], [], []
            for text, known, more in zip(batch.column(1), batch.column(3), batch.column(4), strict=True):
                tokens = words_of(text.as_py())
                starts = np.concatenate([x.values.to_numpy() if x.is_valid else np.array([], np.int32) for x in (known, more)])
                stay = _kept(tokens, starts, window)
                gone.append(len(tokens) - len(stay))
                joined_kept = b" ".join(stay)
                digests.append(_digest(joined_kept))
                kept.append(joined_kept.decode("utf-8", "surrogatepass") if texts else None)
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array(gone, pa.int64()), pa.array(digests, pa.string()), *[pa.array(kept, pa.string())] * texts], columns)

    rest = map_batches(left.select("doc_id", "row", "text", "n_words", "known").join(more, ["doc_id", "row"], "left").select("doc_id", "text", "n_words", "known", "more"), finish, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * texts)
    return done.union(rest)


def _digest(text: bytes | None) -> str | None:
    return None if text is None else hashlib.sha256(text).hexdigest()


def _kept(tokens: list[bytes], starts: np.ndarray, window: int) -> list[bytes]:
    """The tokens that no window starting at ``starts`` covers."""
    if not len(starts):
        return tokens
    delta = np.zeros(len(tokens) + 1, np.int64)
    np.add.at(delta, starts, 1)
    np.add.at(delta, starts + window, -1)
    covered = np.cumsum(delta[:-1]) > 0
    return [t for t, c in zip(tokens, covered.tolist(), strict=True) if not c]
