"""Packing token streams into fixed windows by order-preserving dynamic programming."""

from __future__ import annotations

import json
import sys
import unicodedata
import zlib
from array import array
from collections import deque
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.models import BPE

from graphloom.llm.common import map_batches, materialize

#: The default vocabulary, one of the installed public tokenizers.
VOCABULARY = "word_bpe_49k.json"
TOKEN_SCHEMA = "doc_id long, n_ids long, ids binary, cuts binary, row long"
PIECE_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, input_ids binary"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: The parts into which the default vocabulary splits a text, as its file has it.
PARTS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Kinds of signs: white space, letters, numbers, others, and those that the library's tables may know otherwise.
SPACE, LETTER, NUMBER, OTHER, UNSURE = range(5)


#: Marks whose order among others the library's tables have otherwise than Python's.
REORDERED = "\u1df6\U0001e4ec\U0001e4ed"


@lru_cache(1)
def kinds() -> np.ndarray:
    """The kind of every code point, as ``PARTS`` tells them apart; those that Python's Unicode tables don't have are unsure."""
    kind, every = np.full(sys.maxunicode + 1, OTHER, np.uint8), np.arange(sys.maxunicode + 1, dtype="<u4")
    signs = _text(every[(every < 0xD800) | (every > 0xDFFF)])
    for pattern, one in ((r"\s+", SPACE), (r"\p{L}+", LETTER), (r"\p{N}+", NUMBER)):
        kind[_signs("".join(regex.findall(pattern, signs)))] = one
    kind[_signs("".join(c for c in signs if unicodedata.category(c) == "Cn"))] = UNSURE
    kind[list(map(ord, REORDERED))] = UNSURE
    return kind


def _signs(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), "<u4")


def _text(signs: np.ndarray) -> str:
    return signs.tobytes().decode("utf-32-le")


def _contracted(signs: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The lengths of the contractions, as in ``PARTS``, that begin with the apostrophes at these places; 0 where none does."""
    one, two = (signs[np.minimum(at + k, len(signs) - 1)] for k in (1, 2))
    pairs = [(one == ord(a)) & (two == ord(b)) for a, b in ("re", "ve", "ll")]
    return np.where(np.isin(one, [ord(c) for c in "stmd"]), 2, np.where(np.logical_or.reduce(pairs), 3, 0))


def split_parts(plain: str) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The parts of normal words, one word a line, by ``PARTS``, the number of the line of each, and the lines that hold unsure signs."""
    signs = _signs(plain)
    kind = kinds()[signs]
    begins = kind == NUMBER
    begins[:1] = True
    begins[1:] |= kind[1:] != kind[:-1]
    at = np.flatnonzero(begins & (signs == ord("'")))
    if len(length := _contracted(signs, at)):
        at, length = at[length > 0], length[length > 0]
        begins[at + 1] = False
        after = at + length
        begins[after[after < len(signs)]] = True
    kept = kind != SPACE
    starts = np.flatnonzero(begins[kept])
    line = np.cumsum(signs == ord("\n"))
    unsure, line = line[kind == UNSURE], line[kept][starts]
    signs = signs[kept]
    data = _text(signs).encode()
    if len(data) > len(signs):  # places of signs become places of bytes
        sizes = 1 + (signs > 0x7F).astype(np.uint8) + (signs > 0x7FF) + (signs > 0xFFFF)
        starts = (np.cumsum(sizes, dtype=np.int64) - sizes)[starts]
    offsets = np.append(starts, len(data)).astype(np.int32)
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data)), line, unsure


def _joined(texts: pa.Array, sign: str) -> str:
    return pc.binary_join(pa.ListArray.from_arrays([0, len(texts)], texts), sign)[0].as_py()


class WordIds:
    """Ids of texts by their white-space words, each encoded once while it is remembered.

    A vocabulary that composes and lower-cases a text, drops white space and splits the rest
    by ``PARTS``, every part ending with a token marked ``</w>``, gives a text its words' ids
    in a row and a word its parts'; many new parts can be encoded as one text and told apart
    by the marks. Words and parts are told apart as arrays of many texts at once. About
    ``most`` words and as many parts are remembered; beyond that those
    that several batches met stay, the most frequent half at most. With any other vocabulary texts are encoded as wholes, which is slower.
    """

    SENTENCE = regex.compile(r"[.!?\u2026](?=\s)")
    #: Signs that are white space to Python only, and texts of special tokens; such a text is encoded as a whole.
    ODD = ("\x1c", "\x1d", "\x1e", "\x1f", "<|startoftext|>", "<|endoftext|>")

    def __init__(self, path: str, most: int = 400_000):
        self.path, self.most = path, most
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        self.by_words = self._splits(made)
        if self.by_words:  # parts are normal and apart already
            signs = [s for s in made["pre_tokenizer"]["pretokenizers"] if s["type"] == "ByteLevel"]
            made |= {"normalizer": None, "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, *signs]}, "post_processor": None, "added_tokens": []}
            self.of_parts = Tokenizer.from_str(json.dumps(made))
            self.of_parts.model = self._uncached(made["model"])
            vocabulary = self.of_parts.get_vocab()
            self.marks = np.zeros(max(vocabulary.values()) + 1, bool)
            self.marks[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.forget()

    @cached_property
    def tokenizer(self) -> Tokenizer:
        """The vocabulary's own tokenizer, loaded for the first text that needs it."""
        return Tokenizer.from_file(self.path)

    def forget(self) -> None:
        self.parts, self.part_ids, self.part_met = pa.array([], pa.string()), _Lists(), np.array([], np.int64)
        self.words, self.word_ids, self.word_met = pa.array([], pa.string()), _Lists(), np.array([], np.int64)
        self.stops, self.unsure = bytearray(), bytearray()

    def trim(self) -> None:
        """Forget all but the words and parts that several batches met."""
        kept, self.word_ids, self.word_met = _often(self.word_ids, self.word_met, self.most // 2)
        self.words = self.words.take(pa.array(kept))
        self.stops, self.unsure = (bytearray(np.frombuffer(flags, np.uint8)[kept].tobytes()) for flags in (self.stops, self.unsure))
        kept, self.part_ids, self.part_met = _often(self.part_ids, self.part_met, self.most // 2)
        self.parts = self.parts.take(pa.array(kept))

    @staticmethod
    def _splits(made: dict) -> bool:
        kinds = [n["type"] for n in (made["normalizer"] or {}).get("normalizers", [])]
        patterns = [s["pattern"].get("Regex") for s in (made["pre_tokenizer"] or {}).get("pretokenizers", []) if s["type"] == "Split" and s["invert"]]
        return kinds == ["NFC", "Replace", "Lowercase"] and patterns == [PARTS] and made["model"].get("end_of_word_suffix") == "</w>"

    @staticmethod
    def _uncached(model: dict) -> BPE:
        """The merges without the library's own cache of parts, as each part is encoded once."""
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        settings = {k: model[k] for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges") if model.get(k) is not None}
        return BPE(vocab=model["vocab"], merges=merges, cache_capacity=0, **settings)

    def whole(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        if not text:
            return np.array([], np.uint32), np.array([], np.int64)
        found = self.tokenizer.encode(text, add_special_tokens=False)
        stops = [m.end() for m in self.SENTENCE.finditer(text)]
        ends = np.array([e for _, e in found.offsets], np.int64)
        return np.array(found.ids, np.uint32), np.unique(np.searchsorted(ends, stops) + 1) if stops and len(ends) else np.array([], np.int64)

    def learn_parts(self, parts: pa.Array) -> None:
        for k in range(0, len(parts), 8000):
            some = parts[k : k + 8000]
            ids = np.array(self.of_parts.encode_batch_fast([_joined(some, " ")], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(self.marks[ids]) + 1
            if len(ends) != len(some) or ends[-1] != len(ids):  # no vocabulary seen here does this
                each = [np.array(self.tokenizer.encode(p, add_special_tokens=False).ids, np.uint32) for p in some.to_pylist()]
                ids, ends = np.concatenate(each), np.cumsum([len(e) for e in each])
            self.part_ids.add(ids, ends)
        self.parts = pa.concat_arrays([self.parts, parts])
        self.part_met = np.append(self.part_met, np.zeros(len(parts), np.int64))

    def learn(self, new: pa.Array) -> None:
        """Encode words not seen before."""
        joined = _joined(new, "\n")
        if "\u03a3" in joined:  # Python lowers a last sigma its own way
            plain = "\n".join(self.tokenizer.normalizer.normalize_str(w) if "\u03a3" in w else unicodedata.normalize("NFC", w).lower() for w in joined.split("\n"))
        else:
            plain = (joined if joined.isascii() else unicodedata.normalize("NFC", joined)).lower()
        parts, word, unsure = split_parts(plain)
        parts = parts.dictionary_encode()
        which, unseen = _found(parts.dictionary, self.parts)
        if len(unseen):
            self.learn_parts(unseen)
        self.part_met[which] += 1  # parts of a dictionary differ
        ids, ends = self.part_ids.gather(which[parts.indices.to_numpy()])
        lengths = np.bincount(word, np.diff(ends, prepend=0), len(new)).astype(np.int64)
        self.words = pa.concat_arrays([self.words, new])
        self.word_ids.add(ids, np.cumsum(lengths))
        self.word_met = np.append(self.word_met, np.zeros(len(new), np.int64))
        stops = [pc.ends_with(new, sign).to_numpy(zero_copy_only=False) for sign in ".!?\u2026"]
        self.stops += np.logical_or.reduce(stops).tobytes()
        self.unsure += np.isin(np.arange(len(new)), unsure).tobytes()

    def encode(self, texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each text its ids and the offsets in them at which sentences end; null counts as empty."""
        texts = texts.fill_null("")
        if not self.by_words:
            return [self.whole(t.as_py()) for t in texts]
        if max(len(self.words), len(self.parts)) > self.most:
            self.trim()
        odd = np.zeros(len(texts), bool)
        for sign in self.ODD:
            odd |= pc.match_substring(texts, sign).to_numpy(zero_copy_only=False)
        split = pc.utf8_split_whitespace(texts)
        bounds = split.offsets.to_numpy()
        words = split.flatten().dictionary_encode()
        known, unseen = _found(words.dictionary.cast(pa.string()), self.words)
        if len(unseen):
            self.learn(unseen)
        self.word_met[known] += 1  # words of a dictionary differ
        words = words.indices.to_numpy()
        stop, unsure = (np.frombuffer(flags or b"\0", bool) for flags in (self.stops, self.unsure))
        bounds = (bounds - bounds[0]).tolist()
        out = []
        for number in range(0, len(texts), 500):  # so many at a time, which bounds the places held
            some = bounds[number : number + 501]
            which = known[words[some[0] : some[-1]]]
            ids, ends = self.word_ids.gather(which)
            cuts = np.flatnonzero(stop[which])
            cuts, upto = ends[cuts], np.searchsorted(cuts, np.array(some) - some[0]).tolist()
            if len(found := np.flatnonzero(unsure[which])):
                odd[number + np.searchsorted(some, found + some[0], "right") - 1] = True
            ends, at = np.append(ends, 0), 0
            for k, (first, last) in enumerate(zip(some[:-1], some[1:], strict=True)):
                end = int(ends[last - some[0] - 1]) if last > some[0] else 0
                out.append(self.whole(texts[number + k].as_py()) if odd[number + k] else (ids[at:end], cuts[upto[k] : upto[k + 1]] - at))
                at = end
        return out


def _found(each: pa.Array, known: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Where different strings lie among the known ones, and those that don't, which are to be added behind them."""
    at = pc.fill_null(pc.index_in(each, known), -1).to_numpy().astype(np.int64)
    unseen = np.flatnonzero(at < 0)
    at[unseen] = np.arange(len(known), len(known) + len(unseen))
    return at, each.take(pa.array(unseen))


class _Lists:
    """Many short lists of ids in one growing array."""

    def __init__(self):
        self.ids, self.bounds = array("I"), array("q", [0])

    def add(self, ids: np.ndarray, ends: np.ndarray) -> None:
        self.bounds.frombytes((ends + len(self.ids)).astype(np.int64).tobytes())
        self.ids.frombytes(ids.astype(np.uint32).tobytes())

    def gather(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of these lists one after another, and where each ends."""
        if not len(which):
            return np.array([], np.uint32), np.array([], np.int64)
        bounds = np.frombuffer(self.bounds, np.int64)
        starts = bounds[which]
        lengths = bounds[which + 1] - starts
        ends = np.cumsum(lengths)
        return np.frombuffer(self.ids, np.uint32)[np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1])], ends


def _often(lists: _Lists, met: np.ndarray, most: int) -> tuple[np.ndarray, _Lists, np.ndarray]:
    """The numbers of those that more than one batch met, at most ``most`` of those met most, with their lists and half their counts."""
    kept, fewer = np.flatnonzero(met > 1), _Lists()
    kept = np.sort(kept[np.argsort(-met[kept], kind="stable")[:most]])
    fewer.add(*lists.gather(kept))
    return kept, fewer, met[kept] // 2


_KNOWN: dict[str, WordIds] = {}
#: Bytes of texts that are encoded together, so that a word new to all of them is encoded once.
TOGETHER = 8_000_000


def _gathered(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of up to ``most`` bytes; a larger batch stays as it is."""
    held, size = [], 0
    for batch in batches:
        if held and size + batch.nbytes > most:
            yield pa.concat_batches(held)
            held, size = [], 0
        held.append(batch)
        size += batch.nbytes
    if held:
        yield pa.concat_batches(held)


def tokenize(docs: DataFrame, path: str | None = None, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs`` its ids followed by ``end_id``, and where sentences end.

    ``ids`` are little-endian and unsigned, of 16 bits where all of the row's are below 65,536, else of 32.
    ``cuts`` holds 32-bit offsets into the ids, rising, the last one being ``n_ids``. A null
    text counts as empty: its only id is ``end_id``. ``row`` numbers the rows, so that equal
    ones can be told apart. Other columns are ignored.
    """
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _KNOWN.setdefault(path, None) or WordIds(path)  # one per Python worker; between tasks it keeps the frequent words
        _KNOWN[path] = known
        row = TaskContext.get().partitionId() << 40
        for batch in _gathered(batches, TOGETHER):
            found = known.encode(batch.column(1))
            for at in range(0, batch.num_rows, 500):
                keys = batch.column(0)[at : at + 500]
                ids, cuts = [], []
                for own, stops in found[at : at + 500]:
                    own = np.append(own, np.uint32(end_id))
                    ids.append(own.astype("<u2" if own.max() < 1 << 16 else "<u4"))
                    cuts.append(np.append(stops[(stops > 0) & (stops < len(own) - 1)], len(own)).astype("<u4").tobytes())
                yield pa.record_batch([keys, pa.array(map(len, ids), pa.int64()), pa.array([i.tobytes() for i in ids], pa.binary()), pa.array(cuts, pa.binary()), pa.array(np.arange(row, row + len(ids)))], ["doc_id", "n_ids", "ids", "cuts", "row"])
                row += len(ids)
        known.trim()

    return map_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), run, TOKEN_SCHEMA)


def best_cuts(ends: list[int], penalties: list[float], window: int, tail: bool) -> list[int]:
    """Indexes of the boundaries at which to cut, the last one included.

    ``ends`` are rising stream positions with gaps of at most ``window``; the stream starts
    at 0. A cut at boundary j costs ``penalties[j]``, a window its padding. As padding is
    ``window - (ends[j] - ends[i])``, the best previous cut i minimises ``cost[i] + ends[i]``
    over boundaries within the window: a monotone queue yields it in constant time.
    """
    cost, back = [0.0] * (len(ends) + 1), [0] * (len(ends) + 1)
    where = [0, *ends]
    queue: deque[int] = deque([0])
    for j in range(1, len(where)):
        here = where[j]
        while where[queue[0]] < here - window:
            queue.popleft()
        i = queue[0]
        back[j] = i
        cost[j] = here_cost = cost[i] + where[i] + window - here + penalties[j - 1]
        if j == len(ends) and not tail:
            break
        value = here_cost + here
        while queue and cost[queue[-1]] + where[queue[-1]] >= value:
            queue.pop()
        queue.append(j)
    cuts, j = [], len(ends)
    while j:
        cuts.append(j - 1)
        j = back[j]
    return cuts[::-1]


class _Shard:
    """Packs one task's documents, in order, holding about ``block`` ids at a time."""

    def __init__(self, window: int, penalty: float, hard_penalty: float, longest: int, block: int, first_id: int):
        self.window, self.penalty, self.hard_penalty, self.longest, self.block, self.next_id = window, penalty, hard_penalty, min(longest, window), block, first_id
        self.docs: deque[tuple] = deque()  # id, ids, cuts, ids already packed
        self.held = 0

    def add(self, doc_id, ids: np.ndarray, cuts: np.ndarray) -> None:
        self.docs.append((doc_id, ids, cuts, 0))
        self.held += len(ids)

    def pack(self, last: bool) -> list[tuple]:
        ends, penalties, at = [], [], 0
        for _, ids, cuts, done in self.docs:
            previous = done
            for cut in cuts[cuts > done].tolist():
                while cut - previous > self.longest:  # a longer sentence may be cut within
                    previous += self.longest
                    ends.append(at + previous - done)
                    penalties.append(self.hard_penalty)
                ends.append(at + cut - done)
                penalties.append(0.0 if cut == len(ids) else self.penalty)
                previous = cut
            at += len(ids) - done
        if not ends:
            return []
        chosen = [ends[j] for j in best_cuts(ends, penalties, self.window, True)]
        if not last:  # the final windows are settled with what follows
            chosen = chosen[:-8]
        elif (left := chosen[-1] - (chosen[-2] if len(chosen) > 1 else 0)) < self.window:
            # Lengths that are powers of two need no padding: the rest is cut into the largest ones.
            start = chosen.pop() - left
            while left:
                start, left = start + (1 << left.bit_length() - 1), left - (1 << left.bit_length() - 1)
                chosen.append(start)
        return self.emit(chosen)

    def emit(self, chosen: list[int]) -> list[tuple]:
        pieces, bounds, begin, at = [], iter(chosen), 0, 0
        end = next(bounds, None)
        while end is not None and self.docs:
            doc_id, ids, cuts, done = self.docs[0]
            take = min(len(ids) - done, end - at)
            part = ids[done : done + take].tobytes()
            pieces.append((doc_id, done, take, zlib.crc32(part), len(ids), self.next_id, at - begin, part))
            at, self.held = at + take, self.held - take
            if done + take == len(ids):
                self.docs.popleft()
            else:
                self.docs[0] = (doc_id, ids, cuts, done + take)
            if at == end:
                begin, end = at, next(bounds, None)
                self.next_id += 1
        return pieces


def pack(
    docs: DataFrame,
    window: int = 4096,
    penalty: float = 0.5,
    hard_penalty: float = 8.0,
    longest: int = 48,
    shard_ids: int = 8_000_000,
    path: str | None = None,
    end_id: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Pieces of all documents in sequences of at most ``window`` ids, in the order of their ids.

    Documents are tokenized once, dealt into ranges of ids that hold about ``shard_ids``
    ids, and cut at document or sentence ends so that padding plus ``penalty`` for each cut
    within a document is least. A sentence of over ``longest`` ids may also be cut at every
    ``longest``-th id, at ``hard_penalty``. The last sequence of a range is cut
    into powers of two, which need no padding.

    Returns ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` and the
    piece's ``input_ids``. A null or empty text is a document of one id. Null ids come
    first. Repeated rows are packed each. An empty table gives no rows.
    """
    tokens = materialize(tokenize(docs, path, end_id, id_col, text_col))
    total = tokens.agg(F.sum("n_ids")).first()[0] or 0
    shards = max(1, round(total / shard_ids))
    tokens = tokens.withColumn("crc", F.crc32("ids"))
    ordered = tokens.repartitionByRange(shards, "doc_id", "crc", "row").sortWithinPartitions("doc_id", "crc", "row")  # null and repeated ids may lie in many ranges

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = _Shard(window, penalty, hard_penalty, longest, 1_000_000, TaskContext.get().partitionId() << 36)
        names = PIECE_SCHEMA.replace(" long", "").replace(" binary", "").split(", ")
        kinds = [pa.int64()] * 7 + [pa.binary()]

        def rows(pieces):
            for at in range(0, len(pieces), 4096):
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*pieces[at : at + 4096], strict=True), kinds, strict=True)], names)

        for batch in batches:
            for doc_id, n, ids, cuts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                held = ids.as_buffer()
                shard.add(doc_id, np.frombuffer(held, "<u2" if held.size == 2 * n else "<u4").astype("<u4"), np.frombuffer(cuts.as_buffer(), "<u4").astype(np.int64))
                if shard.held >= shard.block:
                    yield from rows(shard.pack(False))
        yield from rows(shard.pack(True))

    return map_batches(ordered, run, PIECE_SCHEMA)
