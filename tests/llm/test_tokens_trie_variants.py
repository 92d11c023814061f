"""Token counts, the prefix trie and spelling variants: edge cases, and against brute force."""

import hashlib
import random
import sys
import zlib
from collections import Counter, defaultdict

import pytest
from tokenizers import Tokenizer

from graphloom.llm import tokens, trie, variants
from graphloom.llm.pack import vocabulary_path

CLASHING = "doc_id long, text string, n_bytes string, n_tokens string, word string, n string, kind string, row string"


def docs(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z", "w", "v", "u") for r in rows], CLASHING).repartition(3)


# Token counts


@pytest.fixture(scope="module")
def counts():
    path = vocabulary_path(tokens.VOCABULARY)
    return tokens.TokenCounts(path, tokens.whole_tokens(path), most=50), Tokenizer.from_file(path)


def test_whole_tokens_are_proved(counts):
    count, library = counts
    assert 49_000 < len(count.whole) <= 50_256
    merges = tokens.merger(count.path)
    for part in random.Random(0).sample(sorted(count.whole), 500):
        assert len(merges.encode(part).ids) == 1
    assert " the" in count.whole and "zqx" not in count.whole


def test_shortcut_counts_as_the_library(counts):
    count, library = counts
    signs = [chr(i) for i in range(sys.maxunicode + 1) if not 0xD800 <= i < 0xE000]
    texts = ["".join(signs[k : k + 997]) for k in range(0, len(signs), 997)] + [" a".join(signs[k : k + 997]) for k in range(0, len(signs), 9970)]
    rng = random.Random(1)
    texts += ["".join(rng.choices(" \n\t'sdlv re1٣é—\x1c\x85<|>", k=rng.randrange(40))) for _ in range(3000)]
    texts += ["<|endoftext|>", "a<|endoftext|><|endoftext|> b", " <|endoftext|>\n", "<|endoftext|", "don't  stop\n\n\nnow   ", "x" * 5000, "word " * 3000]
    assert [count.of(t) for t in texts] == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_long_texts_in_steps(counts, monkeypatch):
    count, library = counts
    text = "some  words, don't\n\nsplit 123 here — and there" * 200
    want = len(library.encode(text, add_special_tokens=False).ids)
    assert count.of(text) == want
    monkeypatch.setattr(tokens, "LONG", 10)
    monkeypatch.setattr(tokens, "STEP", 7)
    assert count.of(text) == want


def test_token_rows(spark, counts):
    rows = [(1, None), (2, ""), (3, "hello world"), (3, "hello world"), (None, "é" * 2000), (4, "long " * 400_000)]
    got = tokens.count_tokens(docs(spark, rows), limit=100).collect()
    want = [(i, len((t or "").encode()), (n := len(counts[1].encode(t or "", add_special_tokens=False).ids)), n > 100) for i, t in rows]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert tokens.count_tokens(docs(spark, rows).limit(0)).collect() == []
    with pytest.raises(ValueError):
        tokens.whole_tokens(vocabulary_path("word_bpe_49k.json"))


# The trie


def brute_trie(rows, every=100, most=6):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
            own[conv].append(((turn is not None, turn or 0), role, digest, text))
    own = {c: [(r, t) for _, r, _, t in sorted(v)] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % most
        built[c] = own.get(c - c % every, [])[:h] + turns[h:]
    members = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    out = []
    for path, convs in members.items():
        below = [p for p in members if p[: len(path)] == path]
        leaves = [p for p in below if not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in members)]
        ends = sorted(c for c in convs if len(built[c]) == len(path))
        out.append((
            min(convs), len(path), min(members[path[:-1]]) if path else None, len(convs),
            sum(len(q) == len(path) + 1 and q[: len(path)] == path for q in members), len(leaves),
            sum((len(members[p]) - 1) * len(p[-1][1]) for p in below if p), hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def trie_of(spark, rows):
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], "conv_id long, turn long, role string, text string, digest string, pos string, part string").repartition(3)
    turns = trie.turns_of(df)
    found = trie.prefix_trie(*trie.spliced(turns, trie.lengths_of(turns)))
    assert found.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(map(tuple, found.collect()), key=str)


def test_trie_as_brute_force(spark, monkeypatch):
    monkeypatch.setattr(trie, "CHUNK", 8)  # end lists of many rows
    rng = random.Random(2)
    rows = []
    for c in [0, 1, 2, 3, 7, 99, 100, 101, 150, 205, 206, 207, 208, 209, 210, 333]:
        for turn in range(rng.choice([1, 2, 3, 6])):
            rows.append((c, turn, rng.choice(["user", "assistant", None]), rng.choice(["a", "bé", "a", None, ""])))
    rows += [(c, t, "user", f"copy {t}") for c in range(400, 430) for t in range(7)]  # a large group of copies
    rows += [(500, None, "user", "first"), (500, 3, "user", "b"), (500, 3, "user", "b"), (500, 3, "user", "a"), (500, 3, "assistant", "c"), (None, 0, "user", "nobody's"), (600, 0, "user", "é" * 100_000)]
    rng.shuffle(rows)
    assert trie_of(spark, rows) == brute_trie(rows)


def test_small_tries(spark):
    for rows in ([], [(None, 0, "user", "x")], [(7, 0, "user", "x")], [(5, t, "user", str(t)) for t in range(9)], [(1, 0, "a", "bc"), (2, 0, "ab", "c")]):
        assert trie_of(spark, rows) == brute_trie(rows)


# Spelling variants


def brute_near(w, v):
    if len(w) == len(v):
        return sum(a != b for a, b in zip(w, v, strict=True)) == 1
    w, v = sorted((w, v), key=len)
    return len(w) + 1 == len(v) and any(v[:i] + v[i + 1 :] == w for i in range(len(v)))


def brute_variants(counts, ratio=10):
    form = {}
    near = {w: [v for v in counts if brute_near(w, v)] for w in counts}
    for w, others in near.items():
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best and counts[best] >= ratio * counts[w] else None

    def root(w):
        return root(form[w]) if form[w] else w

    return sorted(((w, form[w], root(w), counts[w], len(near[w]), counts[form[w]] if form[w] else None) for w in counts), key=str)


def word_counts(rows, least=7):
    counts = Counter()
    for doc_id, text in rows:
        lower, runs, run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""), [], ""
        for c in lower + " ":
            if "a" <= c <= "z" or "À" <= c <= "ÿ":
                run += c
            elif run:
                runs.append(run)
                run = ""
        for run in runs:
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    return {w: n for w, n in counts.items() if len(w) >= least and n >= 2}


@pytest.mark.parametrize("most", [2, variants.BLOCK])
def test_variants_as_brute_force(spark, most):
    rng = random.Random(3)
    stems = ["".join(rng.choices("abé", k=rng.randrange(6, 12))) for _ in range(60)] + ["aaaaaaaaa", "aaaaaaaa", "aaaaaaa", "Straßen×÷", "ÀLEVEL"]
    rows = []
    for i in range(60):
        some = rng.choices(stems, k=40)
        rows.append((i, " ".join(w if rng.random() < 0.8 else w[: (k := rng.randrange(len(w)))] + rng.choice(["", "b", "xz"]) + w[k + 1 :] for w in some)))
    rows += [(70, "frequent1Frequent, FREQUENT " * 300), (71, "frequant frequant frequentt frequentt"), (72, None), (73, ""), (None, "nullish nullish nulliah"), (None, None), (74, "x" * 3000 + " " + "x" * 2999 + "y " + "x" * 3000 + " " + "x" * 2999 + "y"), rows[0], rows[0]]
    got = variants.spelling_variants(docs(spark, rows), most=most)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = brute_variants(word_counts(rows))
    assert sum(r[1] is not None for r in want) > 5
    assert sorted(map(tuple, got.collect()), key=str) == want


def test_blocks_stay_small(spark):
    """Thousands of words that share their beginning: no block that a task compares is larger than an alphabet."""
    rng = random.Random(4)
    words = {"common" + "".join(rng.choices("abcdefghij", k=5)) for _ in range(5000)}
    rows = variants.subdivided(variants.entries(spark.createDataFrame([(w, 2) for w in words], "word string, n long")), 20)
    sizes = [r["count"] for r in rows.groupBy(*variants._BLOCK).count().collect()]
    assert max(sizes) <= 20
    near = {r.word: r.n_near for r in variants.near_words(spark.createDataFrame([(w, 2) for w in words], "word string, n long"), most=20).collect()}
    some = sorted(words)[:40]
    assert [near.get(w, 0) for w in some] == [sum(brute_near(w, v) for v in words) for w in some]


def test_forms_are_followed(spark):
    """A chain of forms, ties by code point, and no rows for tables without words."""
    words = {"abcdefg": 2, "abcdefh": 20, "abcdefhh": 200, "abcdefi": 20, "xbcdefhhz": 5}
    text = " ".join(w for w, n in words.items() for _ in range(n))
    found = {r.word: (r.form, r.root) for r in variants.spelling_variants(docs(spark, [(1, text)])).collect()}
    got = word_counts([(1, text)])
    assert found == {w: (f, r) for w, f, r, *_ in brute_variants(got)}
    assert variants.spelling_variants(docs(spark, [(1, "short words 12"), (2, None)])).collect() == []
    assert variants.spelling_variants(docs(spark, [(1, "x")]).limit(0)).collect() == []
