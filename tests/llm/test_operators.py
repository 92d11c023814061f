"""Each operator on edge cases and against brute force."""

import hashlib
import re
import zlib
from collections import defaultdict
from html.parser import HTMLParser

import numpy as np
import pytest

from graphloom.llm import caps, exact, html, licenses, minhash, mix, pack, pii, quality, substrings
from graphloom.llm.common import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, component_id string, size string, row string, id string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def prose(n, seed):
    rng = np.random.default_rng(seed)
    return " ".join("".join(rng.choice(list("abcdefgh"), 4)) + ("." if i % 11 == 10 else "") for i in range(n))


@pytest.fixture(scope="module")
def rows():
    base, other = prose(300, 1), prose(80, 2)
    near = base.split()
    near[150] = "changed"
    texts = [None, "", " \t\n", "one", "one two three", base, base, " ".join(near), base.upper(), other, prose(60, 3) + " " + other + " " + prose(60, 4), other + "\n" + other, prose(9000, 5), "Straße ﬁ É 12.5% \x1c x", "mail a.b@c.de or +1 (499) 555-6503 at 10.0.0.1 card 4111 1111 1111 1111 and 4111111111111111"]
    out = [(i, t, "en", None if i % 4 == 0 else f"s{i % 3}") for i, t in enumerate(texts)]
    return [*out, out[5], (None, base, "en", "s1"), (None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, 1, True, "x", "y", "z", "w") for r in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_exact(docs, rows, empty):
    found = exact.exact_groups(docs).collect()
    assert len(found) == len(rows) and exact.exact_groups(empty).count() == 0
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[t or ""].append(i)
    by_hash = {hashlib.sha256(t.encode()).hexdigest(): v for t, v in groups.items()}
    for r in found:
        ids = by_hash[r.text_sha256]
        keep = max(i for i in ids if i is not None)
        assert (r.keep_id, r.group_size, r.kept) == (keep, len(ids), r.doc_id == keep)
    kept = exact.drop_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(max(i for i in v if i is not None) for v in groups.values())
    assert exact.drop_copies(empty).count() == 0


def shingles(text):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_minhash(docs, rows, empty):
    found = minhash.near_groups(docs).collect()
    sets = {i: shingles(t) for i, t, *_ in rows if i is not None}
    root = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    assert len(found) == len(rows)
    for r in found:
        assert (r.component_id, r.kept) == ((root[r.doc_id], root[r.doc_id] == r.doc_id) if r.doc_id is not None else (None, False))
        assert r.doc_id is None or r.n_shingles == len(sets[r.doc_id])
    assert minhash.near_groups(empty).count() == 0


def test_minhash_group_of_many_near_copies(spark):
    base, rng = prose(120, 9).split(), np.random.default_rng(0)
    texts = []
    for _ in range(60):
        w = list(base)
        for at in rng.choice(len(w), rng.integers(0, 7), replace=False):
            w[at] = f"w{rng.integers(1000)}"
        texts.append(" ".join(w))
    sets = [shingles(t) for t in texts]
    root = list(range(60))
    for _ in range(60):
        for a in range(60):
            for b in range(a):
                if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    found = minhash.near_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in found} == dict(enumerate(root))


def without_repeats(rows):
    """Sorted rows of brute force over all windows of 50 words; ids of null as -1."""
    first = {}
    for i, t, *_ in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        w = words(t)
        for k in range(len(w) - 49):
            first.setdefault(tuple(w[k : k + 50]), i)
    want = []
    for i, t, *_ in rows:
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - 49):
            if i is not None and first[tuple(w[k : k + 50])] < i:
                gone[k : k + 50] = [True] * 50
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        want.append((i if i is not None else -1, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return sorted(want)


def sorted_repeats(found):
    return sorted((r.doc_id if r.doc_id is not None else -1, r.n_words, r.n_removed, r.kept_sha256, r.kept_text) for r in found)


def test_substrings(docs, rows, empty):
    assert sorted_repeats(substrings.drop_repeats(docs).collect()) == without_repeats(rows)
    assert substrings.drop_repeats(empty).count() == 0


@pytest.mark.parametrize("bits", [1, 32])
def test_spans_are_compared_at_their_coordinates(spark, monkeypatch, bits):
    """With hashes of one bit, which make false paths, the words decide all the same."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(30):
        text = [f"w{x}" for x in rng.integers(0, 10**6, 400)]
        for version in range(3):
            own = list(text)
            for at in rng.integers(0, 400, 2 * version):
                own[at] = f"own{at}-{version}"
            rows.append((3 * i + version, " ".join(own)))
    rows += [(200, rows[0][1] + " " + rows[4][1]), (201, rows[4][1] + "\n" + rows[0][1]), (5, rows[5][1]), (5, rows[8][1]), (300, None), (None, rows[0][1])]
    caught, compare = [], substrings._unlike

    def seen(*args):
        caught.append(compare(*args))
        return caught[-1]

    monkeypatch.setattr(substrings, "_unlike", seen)
    found = substrings.drop_repeats(spark.createDataFrame(rows, "doc_id long, text string"), bits=bits).collect()
    assert sorted_repeats(found) == without_repeats(rows)
    assert [u.isEmpty() for u in caught] == [bits == 32]


def test_packing(docs, rows, empty):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(pack.vocabulary_path())
    pieces = pack.pack(docs, window=512, shard_ids=5000).collect()
    whole, sequences = defaultdict(list), defaultdict(list)
    for p in pieces:
        assert p.ids_crc32 == zlib.crc32(p.input_ids) and len(p.input_ids) == 4 * p.length > 0
        whole[p.doc_id].append((p.start, np.frombuffer(p.input_ids, "<u4").tolist(), p.doc_tokens))
        sequences[p.sequence_id].append((p.offset, p.length))
    for i, t, *_ in rows:
        if i not in (None, 5):
            ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [2]
            parts = sorted(whole[i])
            assert sum((x[1] for x in parts), []) == ids and all(x[2] == len(ids) for x in parts)
    padding = total = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 512
        total += at
        padding += 0 if at & (at - 1) == 0 else 512 - at
    assert padding < 0.05 * total and pack.pack(empty).count() == 0


def test_best_cuts_are_best():
    rng = np.random.default_rng(3)
    for _ in range(30):
        ends = np.cumsum(rng.integers(1, 9, 14)).tolist()
        penalties = rng.random(14).round(2).tolist()
        best = {0: 0.0}
        where = [0, *ends]
        for j in range(1, 15):
            best[j] = min(best[i] + 10 - (where[j] - where[i]) + penalties[j - 1] for i in range(j) if where[j] - where[i] <= 10)
        cuts = pack.best_cuts(ends, penalties, 10, True)
        cost, at = 0.0, 0
        for c in cuts:
            cost, at = cost + 10 - (ends[c] - at) + penalties[c], ends[c]
        assert cost == pytest.approx(best[14])


def test_mixing(spark, docs, rows, empty):
    found = mix.plan_mix(docs).collect()
    assert len(found) == len(rows) and mix.plan_mix(empty).count() == 0
    sizes, kinds = defaultdict(int), sorted({r[3] for r in rows if r[3] is not None}) + [None]
    for _, t, _, s in rows:
        sizes[s] += len(words(t))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(kinds)}
    total, target, free = 1.5 * sum(sizes.values()), {}, set(kinds)
    while free:
        rest, share = total - sum(target.values()), sum(weight[s] for s in free)
        over = [s for s in free if rest * weight[s] / share > 2 * sizes[s]]
        if not over:
            target |= {s: rest * weight[s] / share for s in free}
            break
        target |= {s: 2.0 * sizes[s] for s in over}
        free -= set(over)
    for r in found:
        assert r.target == pytest.approx(target[r.source]) and r.source_size == sizes[r.source] and 0 <= r.repeats <= 2
    assert mix.mix(docs).columns == docs.columns
    many = spark.createDataFrame([(i, prose(1 + i % 37, i), "abc"[i % 3]) for i in range(600)], "doc_id long, text string, source string")
    for source in "abc":
        part = [r for r in mix.plan_mix(many).collect() if r.source == source]
        assert sum(r.size * r.repeats for r in part) == pytest.approx(part[0].target, rel=0.02)


def test_quality(spark, docs, empty):
    good = [(i, prose(40, i), 1) for i in range(40)]
    bad = [(100 + i, " ".join(f"{w}%%%" for w in prose(40, 500 + i).split()), 0) for i in range(20)]
    table = spark.createDataFrame([(i, t) for i, t, _ in good + bad], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in good[:20] + bad[:10]], "doc_id long, quality int, toxic int")
    kept = {r.doc_id for r in quality.select(table, labels).where("kept").collect()}
    assert kept == {i for i, _, _ in good}
    assert {r.doc_id for r in quality.keep_good(table, labels).collect()} == kept
    assert quality.select(table, labels, k=7).where("kept").count() == 7
    assert quality.select(docs, labels.limit(0)).where("kept").count() == docs.count()
    assert quality.keep_good(docs, labels.limit(0)).columns == docs.columns
    assert quality.select(empty, labels).count() == 0


@pytest.mark.parametrize("k", [0, 1, 5, 99, 100, 1000])
def test_kth_largest(spark, k):
    df = spark.createDataFrame([(float(i % 50) / 3,) for i in range(100)], "v double")
    expected = sorted((float(i % 50) / 3 for i in range(100)), reverse=True)
    found = quality.kth_largest(df, "v", k)
    assert found == (float("inf") if k == 0 else float("-inf") if k >= 100 else expected[k - 1])


def test_caps(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((300, 32))
    near = x[:60] + 0.25 * rng.standard_normal((60, 32))
    v = [*map(np.ndarray.tolist, np.concatenate([x, near])), x[0].tolist(), None, [0.0] * 32, [float("nan")] * 32, [None] * 32, []]
    label = [i % 3 for i in range(300)] + [i % 3 for i in range(60)] + [0, 0, 0, 0, 0, 0]
    table = [(i, e, lab, "x") for i, (e, lab) in enumerate(zip(v, label, strict=True))] + [(900, x[0].tolist(), None, "x"), (None, x[0].tolist(), 0, "x")]
    found = {r.vec_id: r for r in caps.cap_groups(spark.createDataFrame(table, "vec_id long, embedding array<double>, label int, kept string")).collect()}
    ok = {i: np.array(e) / np.linalg.norm(e) for i, e, lab, _ in table if i is not None and lab is not None and e and None not in e and np.isfinite(e).all() and any(e)}
    links = {i: [j for j in ok if j != i and label[i] == label[j] and ok[i] @ ok[j] >= 0.93] for i in ok}
    true = sum(map(len, links.values()))
    assert true > 60 and sum(found[i].n_links for i in ok) >= 0.99 * true and all(found[i].n_links <= len(links[i]) for i in ok)
    assert all(found[i].n_links == 0 and found[i].kept for i in (*range(361, 366), 900)) and found[None].component_id is None


def test_components(spark):
    pairs = [(i, i + 1) for i in range(20)] + [(50, 40), (40, 45), (7, 7), (None, 3)]
    found = dict(components(spark.createDataFrame(pairs, "a long, b long")).collect())
    assert found == {i: 0 for i in range(21)} | {i: 40 for i in (40, 45, 50)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_main_text(spark):
    page = "<html><head><title>t</title></head><body><nav><a href=x>menu</a></nav><div class='ad'>buy</div><article><h1>Head&amp;line</h1><p>One <b>two\n three<p>Four &lt;five&gt;<!-- no --><script>var p='</p>'</script></article><div id=comments><p>reader</p></div><footer>&copy; f</footer>"
    assert html.main_text(page) == "Head&line One two three Four <five>"
    plain = "<body><ul><li><a href=1>a link here</a></ul><div>" + "long text " * 20 + "<br>end</div><form>sign up</form></body>"
    assert html.main_text(plain) == " ".join(["long text"] * 20) + " end"
    assert html.main_text(None) == html.main_text("") == html.main_text("<nav>x</nav>") == ""
    pages = spark.createDataFrame([(1, "u", page, "x"), (1, "u", page, "x"), (None, None, None, None)], "page_id long, url string, html string, text string")
    found = html.extract(pages).collect()
    assert len(found) == 3 and {(r.n_chars, len(r.text)) for r in found} == {(35, 35), (0, 0)}
    assert html.extract(pages.limit(0)).count() == 0


def test_main_text_keeps_whole_articles():
    for around in ("class='has-sidebar'", "id=page-with-header", "class='x long-form'", "class=form"):
        assert html.main_text(f"<body><div {around}><article><p>The text of it.</div><div class=related><article>x</article></div>") == "The text of it."
    assert html.main_text("<body><div class=has-sidebar><p>" + "words " * 30 + "</div><div class=site-header>top") == " ".join(["words"] * 30)
    assert html.main_text("<article><p>short<div id=comments>" + "<p>a longer comment" * 9 + "</div></article>") == "short"
    assert html.main_text("<p>a</p><svg/><p>b</p><svg>c</svg><math/><p>d</p><canvas><p>e</p><object/><p>f") == "a b d e f"
    assert html.main_text("<p>a</p><script>var x = '<p>b'") == "a"


def test_main_text_judges_lines_of_an_article():
    links = "".join(f"<p><a href=x>more to read {i}</a>" for i in range(3))
    body = "<p>" + "long text " * 20
    page = f"<body><p>outside the mark<article><h1>Head</h1>{body}<p><a href=x>one link</a>{body}{links}<p>tail</article>"
    more = "more to read 0 more to read 1 more to read 2"
    assert html.main_text(page) == " ".join(["Head", *["long text"] * 20, "one link", *["long text"] * 20, more, "tail"])
    assert html.main_text(f"<article><p>short{links}<p>words</article><p>{'other ' * 40}") == f"short {more} words"
    assert html.main_text(f"<article><p>short</article><p>{'other ' * 4000}") == "short"  # marks decide at every size
    assert html.main_text("<article><p>energy is <math><mi>E</mi><mo>=</mo><msup><mi>c</mi><mn>2</mn></msup><annotation>E=c^2</annotation></math> here") == "energy is E=c2 here"
    assert html.main_text("<article><p>a<nav><a href=x>b</a></nav><nav>c</nav><nav>d</nav><nav>e</nav><p>f</article>") == "a f"


class Marked(HTMLParser):
    """The blocks of a well-formed page's article, read by the standard library's parser."""

    AROUND = {"nav", "header", "footer", "aside", "form", "dialog", "script", "style", "noscript", "template", "title"}
    INLINE = {"a", "b", "em", "i", "span", "strong", "code", "sup", "sub"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.around, self.blocks, self.now = 0, 0, [], ""

    def end_block(self):
        if text := " ".join(self.now.split()):
            self.blocks.append(text)
        self.now = ""

    def step(self, tag, by):
        if tag not in self.INLINE:
            self.end_block()
        self.inside += by * (tag == "article")
        self.around += by * (tag in self.AROUND)

    def handle_starttag(self, tag, attrs):
        self.step(tag, 1)

    def handle_endtag(self, tag):
        self.step(tag, -1)

    def handle_data(self, data):
        if self.inside and not self.around:
            self.now += data


def test_main_text_against_a_parser(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    found = {r.page_id: r for r in html.extract(pages).collect()}
    rows = pages.collect()
    assert len(found) == len(rows)
    for row in rows:
        parser = Marked()
        parser.feed(row.html or "")
        parser.close()
        parser.end_block()
        text = " ".join(parser.blocks)
        assert (found[row.page_id].text, found[row.page_id].n_chars, found[row.page_id].url) == (text, len(text), row.url)


REFERENCE = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(d := re.sub(r"\D", "", m)) <= 19 and sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(d[::-1])) % 10 == 0),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= sum(c.isdigit() for c in m) <= 15),
]


def test_base_spans_are_the_patterns():
    rng = np.random.default_rng(7)
    texts = ["".join(rng.choice(list("a1.2@+- ()4"), 120)) for _ in range(400)] + ["a@b@c.d x@y.z@q.r 1.2.3.4.5.6.7.8 999.1.1.1 4111 1111-1111 1111 +1 (499) 555-6503"]
    for text in texts:
        want = [(k, *m.span()) for k, (_, pattern, good) in enumerate(REFERENCE) for m in re.finditer(pattern, text) if good(m[0])]
        assert pii.base_spans(text) == want


def test_personal_data(docs, rows, empty):
    found = pii.find(docs).collect()
    assert len(found) == len(rows) and pii.find(empty).count() == 0
    one = next(r for r in found if r.doc_id == 14)
    assert (one.n_email, one.n_ip, one.n_card, one.n_phone) == (1, 1, 2, 1)
    assert next(r for r in found if r.doc_id == 0).spans == ""


def test_skip_chain_carries_labels():
    model = pii.Potentials.of(pii.Counter({(2, 4, 4): 90, (2, 0, 0): 90}))
    text = "call +1 (499) 555-6503 today. Again 1-499-555-6503 or 555-6503 but not 777-1234"
    base, spans = pii.all_spans(text, model)
    added = {text[s:e] for k, s, e in spans if (k, s, e) not in base}
    assert "555-6503" in added and "777-1234" not in added and set(base) <= set(spans)


def test_potentials_are_rates(spark):
    texts = ["Call +14995556503 now. Again 1499-555-6503 here.", "room 12 of 1200-300-4000 then", "mail a.b@c.de and 10.0.0.1 or 7"]
    once = pii.fit(spark.createDataFrame([(t,) for t in texts], "text string"))
    often = pii.fit(spark.createDataFrame([(t,) for t in texts], "text string").crossJoin(spark.range(500)).select("text"))
    for name in ("unary", "chain", "skip"):
        assert np.allclose(getattr(once, name), getattr(often, name))
    for model in (once, often):
        base, spans = pii.all_spans(texts[0], model)
        assert {texts[0][s:e] for k, s, e in spans if (k, s, e) not in base} == {"1499-555-6503"}
        assert all(base == spans for base, spans in (pii.all_spans(t, model) for t in texts[1:]))
    long = " ".join(f"x 1499-555-6503 y{'z' * i}" for i in range(40)) + " +14995556503"
    base, spans = pii.all_spans(long, often)
    assert len(spans) == len(base) + 40


def test_licenses(docs, empty, spark):
    text = "Some words\nReleased under the MIT License.\nThis work is licensed under the GNU General\nPublic License, version 3."
    found = licenses.licenses_of(text)
    assert [f[0] for f in found] == ["MIT", "GPL-3.0-only"] and text[found[0][1] : found[0][2]].strip() == "Released under the MIT License."
    grant, notice = licenses.SENTENCES["mit-grant"][0], licenses.SENTENCES["mit-notice"][0]
    assert [f[0] for f in licenses.licenses_of(f"{grant}\n\n{notice}")] == ["MIT"] and licenses.licenses_of(notice) == []
    for key, sentences in licenses.SENTENCES.items():
        assert all(any(h in s.lower() for h in licenses._HINTS) for s in sentences if "SPDX" not in s), key
    assert licenses.scan(docs).count() == 0 and licenses.scan(empty).count() == 0
    assert licenses.scan(spark.createDataFrame([(1, text), (1, text), (None, None)], "doc_id long, text string")).count() == 4
