"""Counting tokens: pre-tokens that are whole tokens count at once, only the others are merged."""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import count, groupby, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from graphloom.llm.common import map_batches
from graphloom.llm.pack import vocabulary_path

VOCABULARY, LIMIT = "byte_bpe_50k.json", 1024
#: The parts into which byte-level vocabularies of this kind split a text.
PARTS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Characters from which a text is cut in bounded steps, and the pieces of a step.
LONG, STEP = 1_000_000, 100_000


@lru_cache(1)
def newer_signs() -> re.Pattern:
    """Letters and digits that ``regex`` knows and Python's Unicode tables don't: the library may not know them either, so that texts with one are left to it."""
    signs = "".join(map(chr, (*range(0xD800), *range(0xE000, sys.maxunicode + 1))))
    newer = [ord(c) for c in regex.findall(r"[\p{L}\p{N}]", signs) if unicodedata.category(c) == "Cn"]
    runs = [list(g) for _, g in groupby(newer, lambda i, n=count(): i - next(n))]
    return re.compile("[" + "".join(f"{chr(r[0])}-{chr(r[-1])}" for r in runs) + "]")


def _read(path: str) -> dict:
    """The vocabulary file's content; an error unless it is a byte-level BPE that splits by ``PARTS``."""
    with open(path, encoding="utf-8") as f:
        made = json.load(f)
    split, model = made["pre_tokenizer"] or {}, made["model"]
    flags = [t[k] for t in made["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")]
    plain = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split["add_prefix_space"] and not made["normalizer"] and model["type"] == "BPE"
    if not plain or any(flags) or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")):
        raise ValueError(f"{path} isn't a byte-level vocabulary that splits texts as expected")
    return made


def merger(path: str) -> Tokenizer:
    """The vocabulary's merges alone: what it is given counts as one pre-token."""
    made = _read(path)
    made["pre_tokenizer"]["use_regex"] = False
    return Tokenizer.from_str(json.dumps(made | {"added_tokens": [], "truncation": None, "padding": None}))


def whole_tokens(path: str) -> frozenset[str]:
    """The vocabulary strings that, alone, encode as one token, each tried with the library's own merges.

    A pre-token's merges depend on its bytes only, so that such a string counts 1 wherever a
    text is split into it. Strings that aren't UTF-8 are no pre-token of any text.
    """
    merges = merger(path)
    to_byte = {c: b for b in range(256) if len(c := _shown(b)) == 1}
    texts = []
    for token in merges.get_vocab(with_added_tokens=False):
        try:
            texts.append(bytes(map(to_byte.__getitem__, token)).decode())
        except (KeyError, UnicodeDecodeError):
            continue
    found = merges.encode_batch_fast(texts, add_special_tokens=False)
    return frozenset(t for t, e in zip(texts, found, strict=True) if len(e.ids) == 1)


@lru_cache(256)
def _shown(byte: int) -> str:
    """The sign by which byte-level vocabularies write a byte: itself if it prints in Latin-1, else the next from 256 on."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return chr(byte if byte in prints else 256 + [b for b in range(256) if b not in prints].index(byte))


class TokenCounts:
    """Numbers of tokens of texts. ``whole`` comes from ``whole_tokens``; of other pre-tokens about ``most`` are remembered with their counts."""

    def __init__(self, path: str, whole: frozenset[str], most: int = 200_000):
        self.path, self.whole, self.most = path, whole, most
        self.merges, self.library = merger(path), None
        added = sorted((t["content"] for t in _read(path)["added_tokens"]), key=len, reverse=True)
        self.added = regex.compile("|".join(map(regex.escape, added))) if added else None
        self.known = dict.fromkeys(whole, 1)

    def learn(self, parts: list[str]) -> None:
        """Merge pre-tokens that aren't whole tokens."""
        if len(self.known) > len(self.whole) + self.most:
            self.known = dict.fromkeys(self.whole, 1)
        if new := [p for p in set(parts) if p not in self.known]:
            words = self.merges.encode(new, is_pretokenized=True, add_special_tokens=False).word_ids
            self.known.update(zip(new, np.bincount(words, minlength=len(new)).tolist(), strict=True))

    def of_parts(self, parts: list[str]) -> int:
        try:
            return sum(map(self.known.__getitem__, parts))
        except KeyError:
            self.learn(parts)
            return sum(map(self.known.__getitem__, parts))

    def of_plain(self, text: str) -> int:
        """Of a text without added tokens in it."""
        if len(text) <= LONG:
            return self.of_parts(PARTS.findall(text))
        found, n = PARTS.finditer(text), 0
        while some := [m.group() for m in islice(found, STEP)]:
            n += self.of_parts(some)
        return n

    def of(self, text: str | None) -> int:
        if not text:
            return 0
        if not text.isascii() and newer_signs().search(text):
            self.library = self.library or Tokenizer.from_file(self.path)
            return len(self.library.encode(text, add_special_tokens=False).ids)
        if not self.added:
            return self.of_plain(text)
        parts = self.added.split(text)
        return sum(map(self.of_plain, parts)) + len(parts) - 1


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, limit: int = LIMIT) -> DataFrame:
    """One row for each row of ``docs``: id, ``n_bytes`` (UTF-8), ``n_tokens``, ``over_limit`` (more than ``limit`` tokens).

    ``vocabulary`` names a byte-level BPE among the public tokenizers. The driver proves once
    which of its strings are whole tokens; the set, bounded by the vocabulary, goes to the
    tasks. Rows are counted where they lie: no shuffle, nothing depends on other rows.

    A null text counts as empty, an empty one has 0 tokens; null ids and repeated rows are
    counted like others and there are no ties to break. An empty table gives no rows. Other
    columns are ignored, whatever their names. A text beyond ``LONG`` characters is split
    ``STEP`` pre-tokens at a time and counted whole. Texts of added tokens count as these.
    """
    path = vocabulary_path(vocabulary)
    whole = docs.sparkSession.sparkContext.broadcast(whole_tokens(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = TokenCounts(path, whole.value)
        for batch in batches:
            texts = batch.column(1).fill_null("")
            n = pa.array([counts.of(t.as_py()) for t in texts], pa.int64())
            yield pa.record_batch([batch.column(0), pc.binary_length(texts).cast(pa.int64()), n, pc.greater(n, limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return map_batches(docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")), run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
