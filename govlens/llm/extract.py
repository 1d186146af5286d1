"""Main text of web pages by tree scoring.

A page becomes a tree of its block elements. Menus, page headers, footers, sidebars,
notices, adverts, forms, scripts, styles, hidden elements and reader comments are cut
out by element, role and class; a class, id or role alone does not cut what holds the
page's prose (see below). Each paragraph then gives points for its length and its
commas, discounted by the share of its text in links, to its ancestors: all to the
parent, less to each one above. The container with most points is kept (widened to the
article or main element around it), and with it those of its siblings that scored well
or are prose of their own. Lists that consist of links are menus wherever they stand.

Its siblings stay if they hold a paragraph or main heading of their own that is no link,
and so does all that stands between the first and the last one kept. Without an article or
main element, what stands beside the elements around the container stays if it scored well
or holds a main heading, so columns that are wrapped each on its own stay together.

Inside the kept container, a class, id or role cuts only if one of its names consists of
marks and words of layout (``comment-list``, ``ad-slot``); outside, one mark in a name will do
(``related-work`` is a part of an article, but as a box beside it, it is not).

Marks of class, id and role only name what may be cut. A name with ``has``, ``no`` or
``with`` says what its element has, not what it is: words from there on are no marks.
An article, main or element with a likely mark as a name of its own is never cut by its
marks, unless a name of its own is in ``FOREIGN``. All others are cut when they hold
a minor share of the points of the page's prose: under ``MINOR``, or, with a mark in ``FOREIGN``
(reader comments, notices, adverts, which may outweigh an article), under ``MINOR_FOREIGN``
or beside an article or main element with a text of any length.

Every page is read whole by a linear scan, by a second one if it has such marks, and by a
third if a part of the container was cut for one mark in a name; pages are spread over
tasks by Spark.

Defined results: null or empty html and pages without text give an empty text. Broken
markup closes where HTML closes it: a paragraph ends at the next block, an element that
is never closed ends with its parent. Rows repeat as in the input.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from govlens.llm.common import keep, text_runs

# Fixed names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp template".split())
CUT = frozenset(
    "nav footer aside form script style noscript template svg math iframe object canvas select"
    " button textarea dialog head menu audio video title".split()
)
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption"
    " figure footer form h1 h2 h3 h4 h5 h6 head header hgroup html legend li main menu nav ol p pre"
    " section summary table tbody td tfoot th thead tr ul caption".split()
)
PARAGRAPH = frozenset("p pre td blockquote li dd div section article body main".split())
ENDS_ITSELF = {
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "td", "th"]),
    "td": frozenset(["td", "th"]),
    "th": frozenset(["td", "th"]),
}
SCOPE = frozenset("ul ol dl table article section div main body html".split())

# Words of class, id and role that mark what is no part of the article.
UNLIKELY = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising sponsor sponsored promo promoted"
    " promotion cookie cookies consent gdpr notice notices alert popup modal overlay newsletter"
    " subscribe subscription signup login share sharing social sidebar sidenav menu nav navbar"
    " navigation breadcrumb breadcrumbs pagination pager toolbar footer comment comments disqus"
    " replies reply respond related recommended recommendations contentinfo complementary search"
    " banner widget widgets skip disclaimer copyright".split()
)
HEADER = frozenset("header masthead topbar".split())
LIKELY = frozenset("article content main post entry story body text".split())
# Of the unlikely ones, what can outweigh the article beside it.
FOREIGN = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising cookie cookies consent gdpr popup"
    " modal overlay newsletter comment comments disqus replies reply respond".split()
)
# Words that say where or in what shape an element stands, not what it is.
LAYOUT = frozenset(
    "area bar block body bottom box btn button buttons card center cell col column container content"
    " cta embed entry feed field fixed float form frame global group head header heading hidden"
    " icon icons inline inner item items js label large layer layout left line link links list main"
    " mobile module outer page panel part post posts primary right root row secondary section single"
    " site slot small social sticky story strip tab text thread title top unit view wp wrap wrapper"
    " zone".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
HAVING = frozenset("has no with without".split())
MINOR, MINOR_FOREIGN = 0.5, 0.9

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"<]*\"|'[^'<]*'|[^>])*+)(?:>|\Z)",
    re.DOTALL,
)
_NAMED = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORDS = re.compile(r"[A-Za-z][a-z]*")
_HIDDEN = re.compile(
    r"(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none|visibility\s*:\s*hidden",
    re.I,
)
_RAW_END = {t: re.compile(rf"</{t}[\s/>]", re.I) for t in RAW}


def _marks(attributes: str) -> tuple[set[str], set[str]]:
    """Lower-case words of class, id and role, and the whole names.

    Joined words are also seen as one; words behind ``has`` and the like are left out.
    """
    out: set[str] = set()
    names: set[str] = set()
    for m in _NAMED.finditer(attributes):
        value = m[2] or m[3] or m[4] or ""
        for name in value.split():
            words = [w.lower() for w in _WORDS.findall(name)]
            having = [k for k, w in enumerate(words) if w in HAVING]
            out.update(words[: having[0]] if having else words)
            if not having:
                out.add(name.lower())
            names.add(name.lower())
    return out, names


def _named_whole(names: set[str]) -> bool:
    """Whether one of the names is made of marks and words of layout only."""
    for name in names:
        words = [w.lower() for w in _WORDS.findall(name)]
        if any(w in UNLIKELY or w in HEADER for w in words):
            if all(w in UNLIKELY or w in HEADER or w in LAYOUT for w in words):
                return True
    return False


def _points(text: str, linked: float) -> float:
    return (1 + text.count(",") + min(len(text) / 100, 3)) * (1 - linked)


class Page:
    """Block elements and texts of a page, without what was cut out."""

    def __init__(self, source: str, spared: frozenset | None = None):
        """``spared``: elements that their marks do not cut, by number; None spares all."""
        self._spared = spared
        # elements whose marks can cut them: whether a mark is foreign
        self.marked: list[bool] = []
        # whether a whole name says so, and the element that each stands in
        self.whole: list[bool] = []
        self.within: list[int] = []
        self.parent, self.tag, self.likely = [-1], ["html"], [False]
        # texts: (element, text, share in links, share in each open marked element)
        self.blocks: list[list] = []
        self._open: list | None = None
        # open elements: tag, its block element, cut, in a link, innermost marked element
        self._stack: list[tuple[str, int, bool, bool, int]] = [("html", 0, False, False, -1)]
        self._count: dict[str, int] = {}  # open elements by tag
        self._over: list[int] = []  # the marked element around each marked element
        self._read(source)
        self._break()

    def _text(self, raw: str) -> None:
        _, node, cut, link, mark = self._stack[-1]
        if cut or not raw:
            return
        text = entities.unescape(raw) if "&" in raw else raw
        if self._open is None:
            self._open = [node, [], 0, {}]
        self._open[1].append(text)
        if mark >= 0:
            self._open[3][mark] = self._open[3].get(mark, 0) + len(text)
        if link:
            self._open[2] += len(text.strip())

    def _break(self) -> None:
        if self._open is not None:
            text = " ".join("".join(self._open[1]).split())
            if text:
                size = sum(map(len, self._open[1]))
                parts = {k: n / size for k, n in self._open[3].items()}
                self.blocks.append([self._open[0], text, min(1.0, self._open[2] / len(text)), parts])
            self._open = None

    def _pop_to(self, depth: int) -> None:
        if any(e[0] in BLOCK for e in self._stack[depth:]):
            self._break()
        for element in self._stack[depth:]:
            self._count[element[0]] -= 1
        del self._stack[depth:]

    def _close(self, tags: frozenset | tuple, until: frozenset) -> None:
        """End the nearest open element of ``tags`` unless one of ``until`` lies above it."""
        if not any(self._count.get(t) for t in tags):
            return
        for k in range(len(self._stack) - 1, 0, -1):
            if self._stack[k][0] in tags:
                self._pop_to(k)
                return
            if self._stack[k][0] in until:
                return

    def _start(self, tag: str, attributes: str) -> None:
        if tag in BLOCK:
            self._break()
            self._close(("p",), SCOPE)
            if tag in ENDS_ITSELF:
                self._close(ENDS_ITSELF[tag], frozenset(["ul", "ol", "dl", "table"]))
            if tag == "body":
                self._close(("head",), frozenset())
        if tag in VOID:
            if tag == "br":
                self._text(" ")
            elif tag == "hr":
                self._break()
            return
        _, node, cut, link, mark = self._stack[-1]
        marks, names = _marks(attributes) if attributes else (set(), set())
        headed = tag == "header" or bool(marks & HEADER)
        if headed and (self._count.get("article") or self._count.get("main")):
            headed = False
        if tag not in ("html", "body"):
            cut = (
                cut
                or tag in CUT
                or (attributes != "" and bool(_HIDDEN.search(attributes)))
                or (tag == "header" and headed)
            )
            own = tag in ("article", "main") or bool(names & LIKELY)
            if (marks & UNLIKELY or (marks & HEADER and headed)) and (not own or names & FOREIGN):
                number = len(self.marked)
                self.marked.append(bool(marks & FOREIGN))
                self.whole.append(_named_whole(names))
                self.within.append(node)
                self._over.append(mark)
                mark = number
                cut = cut or (self._spared is not None and number not in self._spared)
        if tag in BLOCK and not cut and tag != "html":
            self.parent.append(node)
            self.tag.append(tag)
            self.likely.append(bool(marks & LIKELY))
            node = len(self.tag) - 1
        self._stack.append((tag, node, cut, link or tag == "a", mark))
        self._count[tag] = self._count.get(tag, 0) + 1

    def _end(self, tag: str) -> None:
        if not self._count.get(tag):
            return
        for k in range(len(self._stack) - 1, 0, -1):
            if self._stack[k][0] == tag:
                self._pop_to(k)
                return
            if tag not in BLOCK and self._stack[k][0] in BLOCK:
                return

    def _read(self, source: str) -> None:
        at = 0
        while m := _TAG.search(source, at):
            self._text(source[at : m.start()])
            at = m.end()
            if m[2] is None:
                continue
            tag = m[2].lower()
            if m[1]:
                self._end(tag)
                continue
            if tag in RAW:
                end = _RAW_END[tag].search(source, at)
                at = end.start() if end else len(source)
                if end:
                    close = source.find(">", at)
                    at = close + 1 if close >= 0 else len(source)
                if tag in BLOCK:
                    self._break()
                continue
            self._start(tag, m[3].strip())
        self._text(source[at:])

    def menus(self) -> set[int]:
        """Lists of at least three texts that are links for the most part."""
        inside: dict[int, list[float]] = {}
        for node, text, linked, _ in self.blocks:
            while node > 0 and self.tag[node] not in ("ul", "ol", "dl"):
                node = self.parent[node]
            if node > 0:
                sums = inside.setdefault(node, [0, 0, 0.0])
                sums[0] += 1
                sums[1] += len(text)
                sums[2] += linked * len(text)
        return {n for n, (k, size, linked) in inside.items() if k >= 3 and linked > 0.8 * size}

    def _no_menus(self) -> list[list]:
        menus = self.menus()
        under = [False] * len(self.tag)
        for node in range(1, len(self.tag)):
            under[node] = node in menus or under[self.parent[node]]
        return [b for b in self.blocks if not under[b[0]]]

    def prose_holders(self) -> frozenset:
        """Numbers of the marked elements that hold no minor share of the page's prose."""
        held, total = [0.0] * len(self.marked), 0.0
        semantic = [False] * len(self.tag)
        for node in range(1, len(self.tag)):
            semantic[node] = self.tag[node] in ("article", "main") or semantic[self.parent[node]]
        blocks = self._no_menus()
        # what is foreign cannot outweigh an article, however short, that stands outside it
        article = any(semantic[node] and not parts for node, _, _, parts in blocks)
        wraps = {mark for node, _, _, parts in blocks if semantic[node] for mark in parts}
        for node, text, linked, parts in blocks:
            if self.tag[node] in PARAGRAPH and len(text) >= 25:
                score = _points(text, linked)
                total += score
                for mark, part in parts.items():
                    held[mark] += score * part
        for mark in range(len(held) - 1, -1, -1):
            if self._over[mark] >= 0:
                held[self._over[mark]] += held[mark]
        return frozenset(
            k
            for k, foreign in enumerate(self.marked)
            if held[k] > 0
            and held[k] >= (MINOR_FOREIGN if foreign else MINOR) * total
            and not (foreign and article and k not in wraps)
        )

    def scores(self, blocks: list[list]) -> list[float]:
        """Points of every element."""
        points = [0.0] * len(self.tag)
        for node, text, linked, _ in blocks:
            if self.tag[node] not in PARAGRAPH or len(text) < 25:
                continue
            score = _points(text, linked)
            # text that stands in a container itself counts there; a paragraph's counts above it
            over = node if self.tag[node] in SCOPE else self.parent[node]
            level = 1
            while over >= 0 and level <= 6:
                points[over] += score / level
                over, level = self.parent[over], level + 1
        for node, tag in enumerate(self.tag):
            if points[node]:
                points[node] *= 1.25 if tag in ("article", "main") or self.likely[node] else 1.0
                points[node] *= 0.5 if tag in ("ul", "ol", "dl", "tr", "tbody", "table") else 1.0
        return points

    def _below(self, start: set[int]) -> list[bool]:
        inside = [node in start for node in range(len(self.tag))]
        for node in range(1, len(self.tag)):
            inside[node] = inside[node] or inside[self.parent[node]]
        return inside

    def kept(self) -> list[bool]:
        """For every element, whether it belongs to the main text."""
        blocks = self._no_menus()
        if not blocks:
            return [False] * len(self.tag)
        points = self.scores(blocks)
        best = max(range(len(points)), key=lambda n: (points[n], -n))
        if not points[best]:
            best = self._semantic(blocks)
        over, semantic = best, False
        while over > 0 and not semantic:
            semantic = self.tag[over] in ("article", "main")
            best, over = (over if semantic else best), self.parent[over]
        # what an element and all below it hold: main headings, prose in paragraphs, points of it
        main, prose, score = ([0.0] * len(self.tag) for _ in range(3))
        for node, text, linked, _ in blocks:
            main[node] += self.tag[node] == "h1"
            if linked < 0.5 and self.tag[node] in ("p", "pre", "blockquote"):
                prose[node] += len(text)
            if self.tag[node] in PARAGRAPH and len(text) >= 25:
                score[node] += _points(text, linked)
        for node in range(len(self.tag) - 1, 0, -1):
            for held in (main, prose, score):
                held[self.parent[node]] += held[node]
        beside: dict[int, list[int]] = {}
        for node in range(1, len(self.tag)):
            beside.setdefault(self.parent[node], []).append(node)
        kept, at = {best}, best
        while at > 0:
            row = beside[self.parent[at]]
            stay = [
                k
                for k, node in enumerate(row)
                if node == at
                or main[node]
                or points[node] >= max(4.0, 0.2 * points[best])
                or (not semantic and score[node] >= max(4.0, 0.2 * score[best]))
                or (at == best and prose[node] and (not semantic or self.tag[node] != "article"))
            ]
            if semantic:
                kept.update(row[k] for k in stay)
                break
            kept.update(node for node in row[stay[0] : stay[-1] + 1] if node != at)
            at = self.parent[at]
        return self._below(kept)

    def spare(self, holders: frozenset) -> frozenset:
        """``holders`` and the marked elements inside the main text that no whole name marks."""
        inside = self.kept()
        return holders | {
            k for k, node in enumerate(self.within) if inside[node] and not self.whole[k]
        }

    def main_text(self) -> str:
        inside = self.kept()
        return "\n\n".join(text for node, text, _, _ in self._no_menus() if inside[node])

    def _semantic(self, blocks: list[list]) -> int:
        """Without any scored paragraph: the first article or main with text, else the page."""
        for node, *_ in blocks:
            while node > 0:
                if self.tag[node] in ("article", "main"):
                    return node
                node = self.parent[node]
        return 0


def main_text(source: str) -> str:
    if not source:
        return ""
    page = Page(source)
    if page.marked:
        holders = page.prose_holders()
        page = Page(source, holders)
        spared = page.spare(holders)
        if spared != holders:
            page = Page(source, spared)
    return page.main_text()


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``pages`` with text and n_chars (code points); columns of these names are replaced."""
    pages = pages.select(html_col, *[c for c in pages.columns if c not in (html_col, "text", "n_chars")])
    names = pages.columns
    kinds = {"text": pa.string(), "n_chars": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for part, sources in text_runs(batch, html_col):
                texts = [main_text(s.decode("utf-8", "replace")) for s in sources]
                more = {"text": texts, "n_chars": [len(t) for t in texts]}
                yield keep(part, names, more, kinds)

    schema = T.StructType(
        [
            *pages.schema.fields,
            T.StructField("text", T.StringType()),
            T.StructField("n_chars", T.LongType()),
        ]
    )
    return pages.mapInArrow(run, schema)


def report(pages: DataFrame) -> DataFrame:
    return extract(pages.select("page_id", "url", "html")).select(
        "page_id", "url", "text", "n_chars"
    )
