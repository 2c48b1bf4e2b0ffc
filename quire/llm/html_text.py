"""Main text of web pages by ratios of tag paths.

A page's text is cut into blocks; each has the path of tags from the root to it. Text outside links and punctuation are
added up for each path, smoothed with those of the paths under the same parent, and multiplied; paths above a share of
the page's mean are content. The smallest element that holds most of the content blocks' text is the article: all its
blocks are its text, but those that are marked as something else or are lists of links.

What a page says of its parts is a third measure: landmarks (article, main; nav, aside, footer, form) and the names that
elements have. A page is judged by itself, so nothing is moved but its row.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from html import unescape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

#: Elements of the public HTML standard. Inline ones do not end a block.
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = set("head title script style noscript template svg math iframe object select textarea button form canvas audio video nav aside footer dialog menu".split())
#: An element of the key is ended where one of the values begins inside the same parent.
ENDS = {"p": set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split()), "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
SCOPES = {"ul", "ol", "dl", "table", "article", "section", "div", "body", "main", "aside", "nav", "footer"}
#: Words in an element's class, id or role that say that it is not the article's text.
NOT_TEXT = set("""
ad ads advert advertisement advertising adsense promo promotion sponsor sponsored banner
nav navbar navigation menu breadcrumb breadcrumbs pagination pager toolbar tabs
footer colophon copyright sidebar aside rail widget widgets
cookie cookies consent gdpr notice alert popup modal overlay paywall newsletter subscribe signup login register search
comment comments disqus respond replies discussion share sharing social related recommended teaser hidden
""".split())
#: Of an article only these say so: comments and teasers are articles too.
NOT_ARTICLE = set("ad ads advert advertisement promo sponsored comment comments replies related recommended teaser".split())
HEADER = {"header", "masthead"}
MAIN = {"article", "main"}
#: Blocks that are not looked into for the article.
LEAVES = set("p h1 h2 h3 h4 h5 h6 li dt dd td th blockquote pre figcaption".split())
IN_HEAD = set("meta title link script style base noscript template".split())
LETTER_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？]")

#: Share of the mean score from which a path is content, and of the content's text that leads into an element.
SHARE, HOLDS = 0.1, 0.6
#: A run of links: this share of a path's text is in links, and hardly a sentence's mark in ten blocks.
LINKED = 0.6


@dataclass
class _Element:
    tag: str
    up: int
    path: int = 0
    said: bool = False  # by its names, not to be text
    hidden: bool = False
    main: bool = False
    head: bool = False
    cleared: bool = False


#: An attribute: its name and value, quoted or not.
ATTRIBUTE = re.compile(r"""[\s/]*([^\s/>=]+|=)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]*))?""")
NAME = re.compile(r"[a-zA-Z][^\s/>]*")
RAW = {t: re.compile(rf"</{t}(?=[\s/>])", re.IGNORECASE) for t in ("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes")}


class _Page:
    """Elements of a page, and its blocks: (element, text, letters in links). Reading takes time in proportion to the page."""

    def __init__(self, html: str):
        self.elements = [_Element("", -1)]
        #: Paths of tags by number: (path above, tag).
        self.paths: dict[tuple[int, str], int] = {}
        self.above = [0]
        self.open: Counter = Counter()
        self.blocks: list[tuple[int, str, int]] = []
        self.at, self.parts, self.linked, self.in_link = 0, [], 0, False
        self.read(html)
        self.end_block()

    def read(self, html: str):
        pos, size = 0, len(html)
        while pos < size:
            lt = html.find("<", pos)
            if lt != pos:
                self.text(html[pos : lt if lt >= 0 else size])
                if lt < 0:
                    return
            named = NAME.match(html, lt + 1)
            if named:
                pos = self.start(html, named)
            elif html.startswith("<!--", lt):
                pos = html.find("-->", lt + 2)
                pos = pos + 3 if pos > 0 else 0
            elif html[lt + 1 : lt + 2] in ("!", "?", "/"):
                pos = html.find(">", lt + 1) + 1
                named = NAME.match(html, lt + 2)
                if pos and named and html[lt + 1] == "/":
                    self.end_tag(named[0].lower())
            else:
                self.text("<")
                pos = lt + 1
                continue
            if pos <= lt:  # not ended: it takes the rest
                return

    def start(self, html: str, named: re.Match) -> int:
        tag, pos, attrs = named[0].lower(), named.end(), {}
        while m := ATTRIBUTE.match(html, pos):
            attrs.setdefault(m[1].lower(), (m[2] or "").strip("\"'"))
            pos = m.end()
        pos = html.find(">", pos) + 1
        if pos:
            self.start_tag(tag, attrs)
            if tag in RAW:
                end = RAW[tag].search(html, pos)
                return end.start() if end else 0
        return pos

    def text(self, data: str):
        if "&" in data:
            data = unescape(data)
        self.parts.append(data)
        if self.in_link:
            self.linked += len(data.strip())

    def end_block(self):
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                self.blocks.append((self.at, text, self.linked))
            self.parts, self.linked = [], 0

    def start_tag(self, tag: str, attrs: dict[str, str]):
        if tag == "a":
            self.in_link = "href" in attrs
        elif tag == "br":
            self.parts.append(" ")
        names = [attrs[k] for k in ("class", "id", "role") if k in attrs]
        words = {w.lower() for v in names for w in LETTER_WORDS.findall(v)} if names else set()
        said = not words.isdisjoint(NOT_ARTICLE if tag in MAIN else NOT_TEXT) or "hidden" in attrs
        if tag in INLINE and (tag in VOID or not said and not self.open[tag]):
            return
        self.end_block()
        self.in_link = tag == "a" and self.in_link
        if tag in VOID:
            return
        if self.open["head"] and tag not in IN_HEAD:
            self.close("head")
        while self.elements[self.at].tag not in SCOPES and tag in ENDS.get(self.elements[self.at].tag, ()):
            self.leave()
        main = tag in MAIN and not said or "main" in names or attrs.get("itemprop") == "articleBody"
        path = self.paths.setdefault((self.elements[self.at].path, tag), len(self.above))
        if path == len(self.above):
            self.above.append(self.elements[self.at].path)
        head = tag == "header" or not words.isdisjoint(HEADER) and tag not in MAIN
        self.elements.append(_Element(tag, self.at, path, said and tag not in ("html", "body"), tag in HIDDEN, main, head))
        self.at = len(self.elements) - 1
        self.open[tag] += 1
        if main and tag in MAIN or tag == "h1":
            # what holds the article or its title is not to be left out for its name
            i = self.elements[self.at].up
            while i > 0 and not (self.elements[i].hidden or self.elements[i].cleared):
                self.elements[i].said, self.elements[i].cleared = False, True
                i = self.elements[i].up

    def leave(self):
        e = self.elements[self.at]
        self.open[e.tag] -= 1
        self.at = e.up

    def close(self, tag: str):
        while self.elements[self.at].tag != tag:
            self.leave()
        self.leave()

    def end_tag(self, tag: str):
        if tag == "a":
            self.in_link = False
        if self.open[tag]:
            self.end_block()
            self.close(tag)
            self.in_link = False
        elif tag == "p":
            self.end_block()


def _scores(page: _Page, out: list[bool]) -> list[float]:
    """For each path the product of its smoothed ratios: text outside links, and punctuation, for each block."""
    own, above = ([[0, 0, 0] for _ in page.above] for _ in range(2))
    for (i, text, linked), left_out in zip(page.blocks, out, strict=True):
        path = page.elements[i].path
        length, marks = (0, 0) if left_out else (max(len(text) - linked, 0), _marks(text) if linked < LINKED * len(text) else 0)
        for x in (own[path], above[page.above[path]]):
            x[0] += 1
            x[1] += length
            x[2] += marks
    scores = []
    for path, (n, length, marks) in enumerate(own):
        m, length_above, marks_above = above[page.above[path]]
        scores.append((length / n + length_above / m) / 2 * (1 + marks / n + marks_above / m) / 2 if length else 0.0)
    return scores


def _marks(text: str) -> int:
    return len(PUNCTUATION.findall(text))


def main_text(html: str) -> str:
    """The main text of a page."""
    page = _Page(html)
    elements, blocks = page.elements, page.blocks
    # what an element says of itself holds for all in it; a header inside the article is the article's own
    in_main, left = [False] * len(elements), [False] * len(elements)
    for i, e in enumerate(elements[1:], 1):
        in_main[i] = in_main[e.up] or e.main
        left[i] = left[e.up] or e.hidden or e.said or (e.head and not in_main[i])
    out = [left[i] for i, _, _ in blocks]
    scores = _scores(page, out)
    links: dict[int, list] = {}
    for i, text, linked in blocks:
        x = links.setdefault(elements[i].path, [0, 0, 0, 0])
        for k, v in enumerate((1, len(text), linked, _marks(text) if linked else 0)):
            x[k] += v
    runs = {p for p, (n, length, linked, marks) in links.items() if n >= 3 and linked >= LINKED * length and marks * 10 <= n}
    out = [o or elements[i].path in runs for o, (i, _, _) in zip(out, blocks, strict=True)]
    kept = [k for k, o in enumerate(out) if not o]
    if any(in_main[blocks[k][0]] for k in kept):
        # a landmark weighs more than any ratio
        kept = [k for k in kept if in_main[blocks[k][0]]]
    sizes = {k: len(blocks[k][1]) for k in kept}
    total = sum(sizes.values())
    if not total:
        return ""
    mean = sum(scores[elements[blocks[k][0]].path] * n for k, n in sizes.items()) / total
    content = {k for k in kept if scores[elements[blocks[k][0]].path] >= SHARE * mean}
    root = _root(blocks, elements, {k: sizes[k] for k in content})
    inside = [False] * len(elements)
    for i, e in enumerate(elements):
        inside[i] = i == root or (i > 0 and inside[e.up])
    # a title right above it
    above = {elements[root].up, elements[elements[root].up].up} if root else set()
    title = {i for i, e in enumerate(elements) if e.tag == "h1" and i < root and e.up in above} if not in_main[root] else set()
    return " ".join(blocks[k][1] for k in kept if inside[blocks[k][0]] or blocks[k][0] in title)


def _root(blocks: list, elements: list, sizes: dict[int, int]) -> int:
    """The smallest element that leads to most of the content, or the article around it."""
    held = [0] * len(elements)
    for k, n in sizes.items():
        held[blocks[k][0]] += n
    # elements come before what they hold
    for i in range(len(elements) - 1, 0, -1):
        held[elements[i].up] += held[i]
    best: dict[int, int] = {}
    for i in range(1, len(elements)):
        up = elements[i].up
        if held[i] > held[best.get(up, 0)] * (up in best):
            best[up] = i
    root = 0
    while root in best and held[best[root]] > HOLDS * held[0] and elements[best[root]].tag not in LEAVES:
        root = best[root]
    i = root
    while i > 0:
        if elements[i].main:
            root = i
            if elements[i].tag == "article":
                break
        i = elements[i].up
    return root


def extract(pages: DataFrame, html: str = "html", keep: list[str] | None = None) -> DataFrame:
    """The rows of pages with text, the page's main text, and n_chars, its code points.

    keep: the columns of pages that are returned (all but the html, if None); ones named text or n_chars are replaced by
    the results. White space inside a block is one space; blocks follow each other in page order after one space;
    character references are decoded. A null or empty page, and one without content, has the empty text. Pages are judged
    each by itself, so repeated rows stay and have equal results. An empty table gives an empty one.
    """
    shared.prepare(pages.sparkSession)
    keep = [c for c in (keep if keep is not None else pages.columns) if c not in (html, "text", "n_chars")]
    rows = pages.select(shared.text_or_empty(html).alias("html"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)])
    text = F.pandas_udf(lambda b: b.map(main_text), "string")(F.col("html"))
    rows = rows.withColumn("text", text)
    return rows.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)], "text", F.length("text").cast("long").alias("n_chars"))
