"""Main-text extraction from HTML by the distribution of text over line blocks."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import map_batches

#: Lines that a window spans, and the least text within it at which the main text may surge up.
SPAN, SURGE = 3, 60
#: How many times its length a heading counts on a page without an article's marks.
MARKED = 4

# Possessive throughout: no text is scanned twice. A quoted value ends where white space, a slash or the tag's end follows.
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/<>]*+)((?:[^<>"']++|"[^"]*+"(?=[\s/>])|'[^']*+'(?=[\s/>]))*+)>""")
_BROKEN = re.compile(r"[<>]")
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++))?""")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_WORD = re.compile(r"[a-z]+|[A-Z][a-z]*")
#: Elements whose contents are no text: everything up to their end tag goes.
_RAW = frozenset("script style noscript template iframe object embed svg annotation canvas audio video head title textarea select option datalist noframes map".split())
#: Of these, what holds no elements and so goes to the page's end if nothing ends it; where another has no end tag, only its tag goes.
_UNENDED = frozenset("script style title textarea iframe noframes".split())
#: Elements that lie around the main text.
_AROUND = frozenset("nav header footer aside form dialog menu button fieldset label input".split())
#: Elements that don't part a line.
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img input".split()) | frozenset("math mi mn mo ms mtext mrow mfrac msqrt mroot msub msup msubsup munder mover munderover mstyle mpadded mphantom merror mtable mtr mtd semantics".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that another of the same kind, or the end of what holds them, ends.
_LOOSE = frozenset("p li dt dd tr td th option thead tbody tfoot colgroup".split())
_PAIRS = {"dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th")}
_ENDS_P = frozenset("article section div ul ol table footer header nav aside form h1 h2 h3 h4 h5 h6 blockquote pre".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words that name what isn't main text, and words that say nothing beside them: a name of an
#: element's class, id or role counts if all its words are of these, one at least of the first.
_BOILER = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion promoted nav navbar navigation menu menubar breadcrumb breadcrumbs"
    " header masthead topbar footer sidebar aside complementary contentinfo widget widgets related recommended recommendations share sharing social"
    " comment comments commentlist disqus respond reply replies cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter"
    " subscribe subscription signup login pagination pager toolbar skip tags tagcloud search searchbox copyright legal disclaimer form".split()
)
_NEUTRAL = frozenset(
    "area bar bars block box boxes btn button buttons bottom top left right center inner outer main page site global primary secondary section list item items"
    " link links container wrapper wrap group row col column content the to of us new more unit slot zone panel thread no js fixed sticky mobile desktop google".split()
)


class _Line:
    __slots__ = ("heading", "linked", "main", "named", "text")

    def __init__(self, text: str, linked: int, main: bool, named: int, heading: bool):
        self.text, self.linked, self.main, self.named, self.heading = text, linked, main, named, heading


def _names(attributes: str) -> tuple[bool, bool, bool]:
    """Whether class, id or role name what isn't main text; whether the element is hidden; whether it is the main text's."""
    boiler, hidden, main = False, False, False
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and _HIDDEN.search(value):
            hidden = True
        elif name == "itemprop":
            main |= value.lower() == "articlebody"
        elif name in ("class", "id", "role"):
            main |= name == "role" and value.lower() in ("main", "article")
            for one in value.split():
                words = {w.lower() for w in _WORD.findall(one)}
                boiler |= bool(words & _BOILER) and words <= _BOILER | _NEUTRAL
    return boiler, hidden, main


def lines_of(page: str) -> list[_Line]:
    """The lines of a page in order, those around the main text without their text.

    One pass over the page: markup is found by its next sign, and what is looked for in
    vain isn't looked for again, so broken pages take no longer. An element of a name that
    isn't main text's is passed over, unless it holds most of the page's text or of what is
    marked as an article's within it.
    """
    lines: list[_Line] = []
    text: list[str] = []
    stack: list[tuple[str, bool, bool, int, bool]] = []  # name, around the main text, within an article, named element around (-1 none), heading
    named: list[tuple[int, bool]] = []  # the named element around, whether within an article
    opened: Counter = Counter()
    absent: set[str] = set()
    linked = link = 0

    def find(sign: str, start: int) -> int:
        if sign in absent:
            return -1
        if (found := page.find(sign, start)) < 0:
            absent.add(sign)
        return found

    def flush() -> None:
        nonlocal linked
        around, main, within, heading = stack[-1][1:] if stack else (False, False, -1, False)
        if around:
            if not lines or lines[-1].text or len(lines) < SPAN or any(x.text for x in lines[-SPAN:]):
                lines.append(_Line("", 0, main, within, False))
        elif joined := " ".join(html.unescape("".join(text)).split()):
            lines.append(_Line(joined, linked, main, within, heading))
        text.clear()
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked
        if raw and not (stack and stack[-1][1]):
            text.append(raw)
            if link:
                linked += len(raw)

    def pop() -> None:
        nonlocal link
        name = stack.pop()[0]
        opened[name] -= 1
        link -= name == "a"

    def close(name: str) -> None:
        while opened[name]:
            last = stack[-1][0]
            pop()
            if last == name:
                return

    at, end = 0, len(page)
    while at < end:
        sign = page.find("<", at)
        if sign < 0:
            add(page[at:])
            break
        add(page[at:sign])
        follows = page[sign + 1 : sign + 2]
        if follows in ("!", "?"):
            closing = "-->" if page.startswith("!--", sign + 1) else "]]>" if page.startswith("![CDATA[", sign + 1) else ">"
            at = find(closing, sign + 2)
            at = end if at < 0 else at + len(closing)
            continue
        if not (follows.isascii() and follows.isalpha() or follows == "/" and page[sign + 2 : sign + 3].isalpha()):
            add("<")
            at = sign + 1
            continue
        if not (tag := _TAG.match(page, sign)):  # a broken one ends with the next sign
            stop = _BROKEN.search(page, sign + 1)
            at = end if not stop else stop.end() if stop[0] == ">" else stop.start()
            continue
        at, name, attributes = tag.end(), tag[2].lower(), tag[3]
        if name not in _INLINE:
            flush()
        if tag[1]:
            close(name)
            continue
        if name in _VOID or attributes.endswith("/") and (name not in _RAW or name == "svg") and name not in _INLINE:
            continue
        if name in _RAW:
            done = None if name in absent else re.compile(rf"</{re.escape(name)}\b[^<>]*+>", re.I).search(page, at)
            if not done:
                absent.add(name)
            at = done.end() if done else end if name in _UNENDED else at
            continue
        if name in _LOOSE and stack and stack[-1][0] in _PAIRS.get(name, (name,)):
            pop()
        elif name in _ENDS_P and opened["p"]:
            close("p")
        around, main, within, heading = stack[-1][1:] if stack else (False, False, -1, False)
        boiler, hidden, own = _names(attributes) if attributes and not attributes.isspace() else (False, False, False)
        around |= hidden or name in _AROUND and not (main and name == "header")
        if boiler and name not in ("body", "html", "article", "main"):
            if name in _INLINE:
                around = True
            else:
                named.append((within, main))
                within = len(named) - 1
        stack.append((name, around, main or own or name in ("article", "main"), within, heading or name in _HEADINGS))
        opened[name] += 1
        link += name == "a"
    flush()
    return _unnamed(lines, named)


def _unnamed(lines: list[_Line], named: list[tuple[int, bool]]) -> list[_Line]:
    """Lines within elements whose names say that they lie around the main text lose their text.

    A name doesn't count where the element holds most of the page's text, or lies around the
    article's mark and holds most of the text marked.
    """
    if not named:
        return lines
    marked = any(x.main and x.text for x in lines)
    held, total = [0] * len(named), 0
    for x in lines:
        if x.main or not marked:
            total += len(x.text)
            if x.named >= 0:
                held[x.named] += len(x.text)
    for i in range(len(named) - 1, -1, -1):  # what holds an element comes before it
        if named[i][0] >= 0:
            held[named[i][0]] += held[i]
    out: list[bool] = []
    for i, (around, inside) in enumerate(named):
        out.append(around >= 0 and out[around] or inside and marked or 2 * held[i] <= total)
    return [_Line("", 0, x.main, -1, False) if x.named >= 0 and out[x.named] else x for x in lines]


def blocks(lengths: list[float], span: int = SPAN, surge: float = SURGE) -> list[tuple[int, int]]:
    """Stretches of lines between a surge of the windows' text and the dive to none.

    The window at a line is that line and the ``span - 1`` after it. Text surges where a
    window reaches ``surge`` and its first line has text; it dives at the first window without.
    """
    found, start = [], None
    total = sum(lengths[:span])
    for i, own in enumerate(lengths):
        if start is None and total >= surge and own:
            start = i
        elif start is not None and not total:
            found.append((start, i))
            start = None
        total = total - own + (lengths[i + span] if i + span < len(lengths) else 0)
    if start is not None:
        found.append((start, len(lengths)))
    return found


def weights(lines: list[_Line], marks: bool = True) -> list[int]:
    """How much text each line counts for.

    Where an article's marks hold any text, however little, lines within count ``SURGE`` beside
    their length, links or not, so that each surges by itself and none is lost, and the others
    nothing. Without marks a line counts its length, nothing if it is mostly links, and
    ``MARKED`` times as much if it is a heading.
    """
    if marks and any(x.main and x.text for x in lines):
        return [(SURGE + len(x.text)) * (x.main and bool(x.text)) for x in lines]
    return [0 if 2 * x.linked > len(x.text) else len(x.text) * (MARKED if x.heading else 1) for x in lines]


def main_text(page: str | None, marks: bool = True) -> str:
    """The main text of a page: the lines of any ``weights`` between surge and dive points, joined by one space.

    Where nothing surges, all lines that count stay: a short page is kept whole.
    """
    lines = lines_of(page or "")
    counted = weights(lines, marks)
    stretches = blocks(counted) or [(0, len(lines))]
    return " ".join(lines[i].text for s, e in stretches for i in range(s, e) if counted[i])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row for each row of ``pages``: ``page_id, url, text, n_chars`` (code points).

    Each page is one scan, linear in its length however long or broken it is. A null page
    counts as empty and has an empty text. Windows that tie surge alike: the first one
    starts a stretch. Repeated rows are extracted each, null ids and urls stay null, an empty
    table gives no rows, other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p.as_py()) for p in batch.column(2)]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return map_batches(pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html")), run, "page_id long, url string, text string, n_chars long")
