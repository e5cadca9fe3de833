"""Main-text extraction from HTML by tag-path ratios.

Every run of text is a leaf with its path of block elements from the root, by tag and
class. Over all leaves of one path, text length and punctuation are summed and set
against the number of leaves. The two ratios, in page order, are smoothed with their
neighbours and fused to one score for each path. Two thresholds, as shares of the
largest score, select: paths over THRESHOLD are content, and what they have in common
is the element that holds it; inside of it every path over WEAK stays. Only tags that
name a menu, footer, form or the like drop their text outright. Words in class, id or
role lower the score of a path, as links do, unless the element is or wraps the article,
is a heading, or holds most of the text of a page without article; within an article
they lower it only if most of the element is links. Pages are read alone, in Arrow
batches; nothing is shuffled.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from html import unescape
from math import log

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from lexmill.session import small_batches
from lexmill.sources.tables import table

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^\"'>]|\"[^\"]*\"|'[^']*')*+)(>|\Z)", re.S)
LOOSE_TAG = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9:-]*)([^>]*)(>|\Z)")
ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
WORD = re.compile(r"[a-z]+|[0-9]+")
PUNCTUATION = re.compile(r"[.,;:!?…。、，！？¿¡]")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe template xmp noembed noframes svg canvas object select".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rt rp s samp small span strike strong sub sup time tt u var wbr br img noscript math mi mn mo ms mtext mspace mrow mfrac msqrt mroot msup msub msubsup mover munder munderover mstyle mpadded mphantom mfenced semantics annotation".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: An opening tag ends an open element of the second kind, if none of the third stands between.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: Tags that never hold main text; a header counts only outside of an article.
DROPPED_TAGS = frozenset("nav footer aside form button fieldset head menu dialog audio video".split())
#: Words of class, id or role that name such parts.
DROPPED_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu menubar footer sidebar "
    "aside complementary notice notices cookie cookies consent gdpr alert newsletter subscribe subscription signup login share sharing social "
    "comment comments commentlist disqus reply replies respond related recommended breadcrumb breadcrumbs pagination pager popup modal overlay "
    "toolbar widget form search skip contentinfo toc".split()
)
HEADER_WORDS = frozenset({"header", "masthead", "topbar"})
MAIN_TAGS = frozenset({"article", "main"})
#: Elements that words of class, id or role never make suspect.
KEPT_TAGS = MAIN_TAGS | frozenset("html body h1 h2 h3 h4 h5 h6".split())
#: Elements of text alone: their parent takes their place as holder of the content.
TEXT_TAGS = INLINE | frozenset("p li td th tr tbody ul ol dl dt dd table pre blockquote section h1 h2 h3 h4 h5 h6".split())
#: Shares of the largest score from which a path is content, and from which it stays beside content.
THRESHOLD, WEAK = 0.5, 0.08
#: What the score of a path is multiplied by if it is suspect, if it is all links, and if it is not in the article of a page that has one.
LOWERED, LINKED, OUTSIDE = 0.05, 0.3, 0.25

SCHEMA = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])


class _Element:
    __slots__ = ("tag", "path", "parent", "dropped", "suspect", "main", "depth", "wraps", "size", "linked", "lowered")

    def __init__(self, tag: str, label: str, parent: _Element | None, dropped: bool, main: bool, suspect: bool = False) -> None:
        self.tag, self.parent, self.dropped, self.main, self.suspect = tag, parent, dropped, main, suspect
        # whether an article is inside; characters of text, and those of them in links
        self.wraps, self.size, self.linked = False, 0, 0
        self.path = (parent.path if tag in INLINE else f"{parent.path}/{label}") if parent else label
        self.lowered = False
        self.depth = parent.depth + 1 if parent else 0


def _attributes(text: str) -> tuple[str, set[str], bool]:
    """Class for the path, words of class, id and role, and whether the element is hidden."""
    label, words, hidden = "", set(), False
    if text:
        for m in ATTRIBUTE.finditer(text):
            name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if name == "hidden":
                hidden = True
            elif name == "aria-hidden":
                hidden |= value == "true"
            elif name == "style":
                hidden |= "display:none" in value.replace(" ", "")
            else:
                words |= set(WORD.findall(value))
                label = f".{value}" if name == "class" else label
    return label, words, hidden


def leaves(html: str) -> list[tuple[int, _Element, str]]:
    """(block number, element, raw text) of every run of text, in page order."""
    root = _Element("", "", None, False, False)
    top, out, block, at, end = root, [], 0, 0, len(html)
    while at < end:
        lt = html.find("<", at)
        if lt < 0:
            lt = end
        if lt > at:
            out.append((block, top, html[at:lt]))
        if lt == end:
            break
        m = TOKEN.match(html, lt)
        if m and m[2] and not m[4]:
            m = None
        m = m or LOOSE_TAG.match(html, lt)
        if not m:
            out.append((block, top, "<"))
            at = lt + 1
            continue
        at = m.end()
        if m.re is TOKEN and not m[2]:
            continue
        tag = m[2].lower()
        if not m[4]:
            break  # the page ends within a tag
        if tag not in INLINE and tag not in RAW:
            block += 1
        elif tag == "br":
            out.append((block, top, " "))
        if m[1]:
            x: _Element | None = top
            while x is not None and x.tag != tag:
                x = x.parent
            if x is not None and x.parent is not None:
                top = x.parent
            continue
        if tag in RAW and not m[3].endswith("/"):
            close = re.compile(rf"</{tag}(?![\w-])[^>]*(?:>|\Z)", re.I).search(html, at)
            at = close.end() if close else end
            continue
        if tag in VOID:
            continue
        if tag in CLOSES_P:
            x = top
            while x is not None and x.tag != "p" and (x.tag in INLINE):
                x = x.parent
            if x is not None and x.tag == "p":
                top = x.parent
        elif tag in ENDS:
            kinds, walls = ENDS[tag]
            x = top
            while x is not None and x.tag not in walls:
                if x.tag in kinds:
                    top = x.parent
                x = x.parent
        label, words, hidden = _attributes(m[3])
        in_main = top.main
        main = in_main or tag in MAIN_TAGS or "main" in words and tag in ("div", "section")
        dropped = top.dropped or hidden or tag in DROPPED_TAGS and tag != "form"
        suspect = tag == "form" or tag == "noscript" and not in_main or tag not in KEPT_TAGS and (bool(words & DROPPED_WORDS) or not in_main and (tag == "header" or bool(words & HEADER_WORDS)))
        if not m[3].endswith("/"):
            top = _Element(tag, tag + label, top, dropped, main, suspect)
            if tag in MAIN_TAGS and not dropped:
                x = top
                while x is not None and not x.wraps:
                    x.wraps = True
                    x = x.parent
    _settle(out, root)
    return out


def _settle(runs: list[tuple[int, _Element, str]], root: _Element) -> None:
    """Marks the suspect elements whose paths are lowered, and all within them."""
    chains: dict[_Element, list[_Element]] = {}
    for _, element, text in runs:
        if element.dropped or text.isspace():
            continue
        if element not in chains:
            chain, x = [], element
            while x is not None:
                chain.append(x)
                x = x.parent
            chains[element] = chain
        size = len(text.strip())
        linked = size if any(x.tag == "a" for x in chains[element]) else 0
        for x in chains[element]:
            x.size += size
            x.linked += linked
    settled: set[_Element] = {root}
    for _, element, _ in runs:
        chain, x = [], element
        while x is not None and x not in settled:
            chain.append(x)
            x = x.parent
        for x in reversed(chain):
            settled.add(x)
            x.dropped = x.dropped or x.parent.dropped
            x.lowered = x.parent.lowered or x.suspect and not _spared(x, root)


def _spared(x: _Element, root: _Element) -> bool:
    if x.wraps or not root.wraps and 2 * x.size > root.size and 2 * x.linked < x.size:
        return True
    return x.tag != "form" and x.main and 2 * x.linked < x.size


def path_scores(runs: list[tuple[int, _Element, str]]) -> dict[tuple[str, bool], float]:
    """The smoothed and fused score of each path that may hold content, lowered or not."""
    length: dict[tuple[str, bool], int] = defaultdict(int)
    marks: dict[tuple[str, bool], int] = defaultdict(int)
    links: dict[tuple[str, bool], int] = defaultdict(int)
    count: dict[tuple[str, bool], int] = defaultdict(int)
    order = []
    for _, element, text in runs:
        if text.isspace():
            continue
        path = element.path, element.lowered
        order.append((path, element.dropped, element.main))
        length[path] += len(text)
        marks[path] += len(PUNCTUATION.findall(text))
        links[path] += len(text) if _in_link(element) else 0
        count[path] += 1
    sizes = [0.0 if dropped else length[p] / count[p] for p, dropped, _ in order]
    points = [0.0 if dropped else marks[p] / count[p] for p, dropped, _ in order]

    def smooth(x: list[float]) -> list[float]:
        padded = [x[0], *x, x[-1]]
        return [(a + 2 * b + c) / 4 for a, b, c in zip(padded, padded[1:], padded[2:], strict=False)]

    total: dict[tuple[str, bool], float] = defaultdict(float)
    if order:
        some_main = any(main and not dropped for _, dropped, main in order)
        for (path, dropped, main), a, b in zip(order, smooth(sizes), smooth(points), strict=True):
            if not dropped:
                weight = (LOWERED if path[1] else 1.0) * (1.0 if main or not some_main else OUTSIDE)
                total[path] += log(3.0 + a * (1.0 + b)) * weight
    return {p: s / count[p] * (1.0 - (1.0 - LINKED) * links[p] / length[p]) for p, s in total.items()}


def _in_link(x: _Element | None) -> bool:
    while x is not None and x.tag in INLINE:
        if x.tag == "a":
            return True
        x = x.parent
    return x is not None and x.tag == "a"


def _common(a: _Element, b: _Element) -> _Element:
    """The lowest element that holds both."""
    while a is not b:
        if a.depth >= b.depth and a.parent is not None:
            a = a.parent
        elif b.parent is not None:
            b = b.parent
    return a


def main_text(html: str) -> str:
    """The main text of a page: its blocks in page order, one to a line."""
    runs = leaves(html)
    scores = path_scores(runs)
    if not scores:
        return ""
    most = max(scores.values())
    passing = {e for _, e, text in runs if not e.dropped and not text.isspace() and scores[e.path, e.lowered] >= THRESHOLD * most}
    holder: _Element | None = None
    for x in passing:
        holder = x if holder is None else _common(holder, x)
    while holder is not None and holder.tag in TEXT_TAGS and holder.parent is not None and not holder.parent.main:
        holder = holder.parent
    while holder is not None and holder.main and holder.parent is not None and holder.parent.main:
        holder = holder.parent
    # outside of the articles of a page that has some, only paths of the content count
    strict = holder is not None and not holder.main and any(x.main for x in passing)
    blocks: dict[int, list[str]] = defaultdict(list)
    for block, element, text in runs:
        if element.dropped or not text.isspace() and (scores[element.path, element.lowered] < WEAK * most or strict and not element.main and element not in passing):
            continue
        x = element
        while x is not None and x is not holder:
            x = x.parent
        if x is holder:
            blocks[block].append(text)
    lines = (" ".join(unescape("".join(parts)).split()) for parts in blocks.values())
    return "\n".join(x for x in lines if x)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of pages: page_id, url, text, n_chars.

    Null or empty html, or a page without main text, gives an empty text. Broken
    markup is read on: open elements end with their parents, a tag cut by the end of
    the page is dropped. Null ids and repeated rows are kept as they are; no other
    column is read. No rows: no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py() or "") for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], SCHEMA.fieldNames())

    small_batches(pages.sparkSession)
    return pages.selectExpr(f"cast(`{id_col}` as bigint) as page_id", f"`{url_col}` as url", f"`{html_col}` as html").mapInArrow(run, SCHEMA)


def op7_tag_path_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


QUERIES = {"op7_tag_path_ratios": op7_tag_path_ratios}
#: Parsing HTML is not SQL; the query is tested on pages with known articles.
ORACLES: dict[str, str] = {}
