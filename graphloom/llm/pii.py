"""Personal data: base patterns, and a skip-chain conditional random field that carries their labels across a document."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import map_batches

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, int]  # kind, start, end

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
#: Mentions that may be personal data: numbers, in groups or not, and addresses, their @ written out or not. Possessive, and begun at a token's start only, so linear.
_NUMBER = r"(?<![\w+])\+?\(?[0-9]++(?!\w)(?:[ ().-]{1,3}+[0-9]++(?!\w))*+"
_ADDRESS = r"(?<![\w.%+-])[\w.%+-]++(?:@| ?[(\[]at[)\]] ?)[\w-]++(?:\.[\w-]++)*+"
_NUMBERS, _MENTIONS = re.compile(_NUMBER), re.compile(f"{_ADDRESS}|{_NUMBER}")
_AT = re.compile(r"@| ?[(\[]at[)\]] ?")


def _luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Spans of the base patterns by kind, then start; a match that fails its test is dropped."""
    found: list[Span] = []
    at, last = text.find("@"), 0
    while at >= 0:  # leftmost match: the whole run before an @ that isn't in the match before
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (domain := _DOMAIN.match(text, at + 1)):
            found.append((0, start, domain.end()))
            last = domain.end()
            at = text.find("@", last)
        else:
            at = text.find("@", at + 1)
    if first := _DIGIT.search(text):
        for m in _IP.finditer(text, first.start()):
            if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
                found.append((1, *m.span()))
        for m in _CARD.finditer(text, first.start()):
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and _luhn(digits):
                found.append((2, *m.span()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                    found.append((3, *m.span()))
    return found


@dataclass
class _Graph:
    """Mentions: places, buckets of their shape, base labels (0 none), links of neighbours, and links of similar mentions to their hub.

    Similar are numbers with the same last seven digits (all, where they are four to six) and
    addresses with the same name before the @, however they are written. The hub is the first
    of them that lies in a base span, or else the first: an observed node, so that a copy is
    one link from its label however many there are.
    """

    spans: list[tuple[int, int]]
    shapes: np.ndarray
    labels: np.ndarray
    chain: list[tuple[int, int]]
    skips: list[tuple[int, int]]


#: Buckets of shapes: 1024 in each of 4 classes (with or without @ and letters).
CLASSES, SHAPES = 4, 4096
#: Share of a bucket's rates that comes from the prior, which an unseen shape has alone; it says "none".
BACK_OFF = 0.2
#: Share of the pairs of labels that comes from the prior.
PRIOR = 0.01
#: Characters between mentions that count as neighbours, at most.
NEAR = 16


def _bucket(mention: str) -> int:
    shape = _AT.sub(lambda m: m[0] if m[0] == "@" else "(@)", mention)
    shape = re.sub(r"[0-9]+", lambda m: "9" * min(len(m[0]), 6), re.sub(r"[^\W\d_]+", "a", shape))
    shape = re.sub(r"(?:[a9]+[._-]?)+(?=\(?@)", "n", shape)  # names before the @ are of one shape
    each = SHAPES // CLASSES
    return (2 * ("@" in shape) + ("a" in shape)) * each + xxhash.xxh32_intdigest(shape) % each


def _key(mention: str) -> str | None:
    name = _AT.split(mention, maxsplit=1)
    if len(name) > 1:
        return "@" + name[0].lower() if len(name[0]) >= 4 else None
    digits = "".join(filter(str.isdigit, mention))
    return digits[-7:] if len(digits) >= 4 else None


def _graph(text: str, spans: list[Span]) -> _Graph:
    found = (_MENTIONS if "@" in text or "at)" in text or "at]" in text else _NUMBERS).finditer(text)
    places, shapes, chain, alike = [], [], [], {}
    for node, m in enumerate(found):
        if node and m.start() - places[-1][1] <= NEAR:
            chain.append((node - 1, node))
        places.append(m.span())
        shapes.append(_bucket(m[0]))
        if key := _key(m[0]):
            alike.setdefault(key, []).append(node)
    labels = np.zeros(len(places), int)
    if spans and places:
        starts, ends = np.array(places).T
        for k, s, e in sorted(spans, key=lambda x: x[1:], reverse=True):  # the first span that meets a mention labels it
            labels[np.searchsorted(ends, s, "right") : np.searchsorted(starts, e, "left")] = k + 1
    skips = []
    for nodes in alike.values():
        hub = next((i for i in nodes if labels[i]), nodes[0])
        skips += [(hub, i) for i in nodes if i != hub]
    return _Graph(places, np.array(shapes, int), labels, chain, skips)


def rewritten(kind: int, mention: str) -> list[str]:
    """Other ways to write what a base pattern found, which none of them finds: examples for the field of what it should add."""
    digits = "".join(filter(str.isdigit, mention))
    if kind == 0:
        name, domain = mention.split("@", 1)
        return [f"{name} (at) {domain}", f"{name} [at] {domain}", f"{name}(at){domain}", f"{name}@{domain.split('.')[0]}"]
    if kind == 1:
        return [mention.replace(".", "-"), mention.replace(".", " ")]
    if kind == 2:
        groups = [digits[i : i + 4] for i in range(0, len(digits), 4)]
        return [".".join(groups), "(" + groups[0] + ") " + ".".join(groups[1:])]
    area, first, last = digits[-10:-7], digits[-7:-4], digits[-4:]
    return [mention[1:], f"({area}) {first}-{last}", f"{area}-{first}-{last}", f"{area}.{first}.{last}", f"{area} {first} {last}", area + first + last] if len(digits) >= 10 else [mention[1:]]


@dataclass(frozen=True)
class Potentials:
    """Log potentials: of a label for a shape, of two labels in a row, and of two labels of similar tokens.

    All come from rates and priors that are shares of them, so the same table many times over has the same.
    """

    unary: np.ndarray  # SHAPES x labels
    chain: np.ndarray  # labels x labels
    skip: np.ndarray  # labels x labels

    @staticmethod
    def of(counts: Counter) -> Potentials:
        n = len(KINDS) + 1
        unary, chain, skip = np.zeros((SHAPES, n)), np.zeros((n, n)), np.zeros((n, n))
        for (what, a, b), c in counts.items():
            (unary, chain, skip)[what][a, b] += c

        def rates(x: np.ndarray, back: np.ndarray) -> np.ndarray:
            sums = x.sum(1, keepdims=True)
            return np.where(sums > 0, (1 - BACK_OFF) * x / np.maximum(sums, 1) + BACK_OFF * back, back)

        def ratios(x: np.ndarray, prior: Callable[[np.ndarray], np.ndarray], most: float) -> np.ndarray:
            x = (x + x.T) / (x.sum() * 2) if x.any() else np.eye(1, n * n).reshape(n, n)
            share = np.maximum(x.sum(1), 1e-6)
            x = (1 - PRIOR) * x + PRIOR * prior(share)
            x = x / x.sum()
            return np.clip(np.log(x) - np.log(x.sum(1))[:, None] - np.log(x.sum(0)), -most, most)

        prior = np.array([1.0, *[0.1] * (n - 1)])
        return Potentials(np.log(rates(unary, prior / prior.sum())), ratios(chain, lambda s: np.outer(s, s), 3), ratios(skip, lambda s: 0.999 * np.diag(s) + 0.001 * np.outer(s, s), 8))


def _beliefs(graph: _Graph, model: Potentials, rounds: int = 200) -> np.ndarray:
    """Marginals by loopy sum-product until messages settle; nodes of base spans are observed."""
    own = model.unary[graph.shapes].copy()
    known = np.flatnonzero(graph.labels)
    own[known] = -1e9  # however many links a hub has
    own[known, graph.labels[known]] = 0.0
    ends = np.array(graph.chain + graph.skips, int).reshape(-1, 2)
    a, b = np.concatenate([ends, ends[:, ::-1]]).T  # each link in both directions; the pairs' potentials are symmetric
    pairs = np.tile(np.concatenate([np.repeat(model.chain[None], len(graph.chain), axis=0), np.repeat(model.skip[None], len(graph.skips), axis=0)]), (2, 1, 1))
    messages = np.zeros((len(a), own.shape[1]))

    def total() -> np.ndarray:
        out = own.copy()
        np.add.at(out, b, messages)
        return out

    for _ in range(rounds):
        fresh = np.logaddexp.reduce((total()[a] - np.roll(messages, len(ends), axis=0))[:, :, None] + pairs, axis=1)
        fresh -= fresh.max(axis=1, keepdims=True)
        if not len(a) or np.abs(fresh - messages).max() < 1e-3:
            break
        messages = 0.5 * messages + 0.5 * fresh
    out = total()
    out = np.exp(out - out.max(axis=1, keepdims=True))
    return out / out.sum(axis=1, keepdims=True)


def all_spans(text: str, model: Potentials, certain: float = 0.9) -> tuple[list[Span], list[Span]]:
    """The base spans, and these with the mentions that the field labels with a probability of ``certain`` or more."""
    base = base_spans(text)
    if "@" not in text and "at)" not in text and "at]" not in text and not _DIGIT.search(text):
        return base, base
    graph = _graph(text, base)
    if graph.labels.all():
        return base, base
    marginals = _beliefs(graph, model)
    free = np.flatnonzero((graph.labels == 0) & (marginals[:, 1:].max(axis=1) >= certain))
    more = [(int(marginals[node, 1:].argmax()), *graph.spans[node]) for node in free]
    return base, sorted([*base, *more]) if more else base


def fit(docs: DataFrame, text_col: str = "text") -> Potentials:
    """Potentials counted over all documents; at most ``SHAPES`` x 5 + 50 counts come to the driver.

    The base spans are labels, and what the patterns don't find would all be "none": such a
    field could add nothing. So each base span is also counted as if it stood in the document
    once more in every form of ``rewritten``, with its label and a skip link to itself.
    Mentions outside the base spans that are similar to one within have no known label and
    aren't counted.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                if not (text := text.as_py()) or "@" not in text and not _DIGIT.search(text):
                    continue
                base = base_spans(text)
                graph = _graph(text, base)
                labels = graph.labels.tolist()
                copies = {b for a, b in graph.skips if labels[a] and not labels[b]}
                counts.update((0, s, k) for i, (s, k) in enumerate(zip(graph.shapes.tolist(), labels, strict=True)) if i not in copies)
                for what, links in ((1, graph.chain), (2, graph.skips)):
                    counts.update((what, labels[a], labels[b]) for a, b in links if a not in copies and b not in copies)
                for kind, start, end in base:
                    forms = rewritten(kind, text[start:end])
                    counts.update((0, _bucket(form), kind + 1) for form in forms)
                    counts[2, kind + 1, kind + 1] += len(forms)
        rows = [(*key, n) for key, n in counts.items()] or [(0, 0, 0, 0)]
        yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["what", "a", "b", "n"])

    rows = map_batches(docs.select(F.col(text_col).alias("text")), count, "what long, a long, b long, n long").groupBy("what", "a", "b").agg(F.sum("n"))
    return Potentials.of(Counter({(r[0], r[1], r[2]): r[3] for r in rows.collect()}))


def _written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def find(docs: DataFrame, model: Potentials | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: ``doc_id``, base counts ``n_email, n_ip, n_card, n_phone``, ``base_sha256`` and ``spans``.

    Base spans come from fixed patterns. A conditional random field over the document's
    mentions (numbers and addresses) then shares their labels: neighbours are linked in a
    chain, distant mentions of the same digits or name by skip edges, and loopy message
    passing makes labels agree. Mentions it is sure of are added to ``spans`` (kind:start:end
    in code points); base spans stay. Its potentials are counted over all documents of the table.

    A null or empty text has no spans. A long text is one field, its messages linear in its
    mentions. Of kinds that tie for a mention the first listed is taken. Repeated rows are
    found alike, null ids stay null, an empty table gives no rows, other columns are ignored.
    """
    known = docs.sparkSession.sparkContext.broadcast(model or fit(docs, text_col))  # a fixed number of doubles

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"]
        for batch in batches:
            out = []
            for text in batch.column(1):
                base, spans = all_spans(text.as_py() or "", known.value)
                out.append((*[sum(s[0] == k for s in base) for k in range(len(KINDS))], hashlib.sha256(_written(base).encode()).hexdigest(), _written(spans)))
            columns = list(zip(*out, strict=True)) or [()] * 6
            yield pa.record_batch([batch.column(0), *[pa.array(c, pa.int64()) for c in columns[:4]], *[pa.array(c, pa.string()) for c in columns[4:]]], names)

    return map_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
