"""Operator 8: main text of web pages, by classifying flat text blocks with a decision tree.

A page becomes a flat list of text blocks, cut at block-level tags. A block is described by its word
count and link density, those of its neighbours before and after, whether it is a heading, and the
region it stands in (a menu, notice or the like; an article). A decision tree, grown here from a small
labelled table of pages of several layouts, keeps or drops each block. Kept blocks are joined in page
order.

Regions are known by tags, roles, and classes and ids. A class is read as the words it is made of; one
with a word of absence or state ("no-comments", "has-sidebar") names no region. Inside article and main,
where sections and headings are called by their titles, ids of sections, headings and inline tags are
not read; their classes, and ids of other tags, count only by names that no title is likely to give
(comments, adverts; share bars by class). A region that turns out to hold all of the page's articles,
or, on a page without any, nearly all of its unlinked words, is the page and no boilerplate.

Form controls (button, select, option, textarea) count as forms wherever they stand; noscript, template,
svg and embedded frames are not text of the page.

Defined cases: a null or empty page gives an empty text; markup may be broken or cut off anywhere (an
unfinished tag, comment or raw-text element such as a script or style runs to the end of the page; a
button, select, noscript, template or svg without an end tag of its own ends with the
element it stands in or at the next block-level tag); repeated rows give repeated
rows; columns other than id, url and html are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from random import Random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lexispan.llm.common import require

# Tags of HTML by what they do to text.
BLOCK_TAGS = frozenset("address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html iframe legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead title tr ul".split())
RAW_TAGS = frozenset("script style textarea title xmp iframe noembed noframes".split())
SKIPPED_TAGS = frozenset("noscript template svg select button".split())
SKIPPED_PARTS = frozenset("option optgroup legend button select".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta source track wbr".split())
BOILER_TAGS = frozenset("nav header footer aside form menu dialog fieldset search head".split())
MAIN_TAGS = frozenset("article main".split())
HEADING = re.compile("h[1-6]")
#: Words that name regions: those that no section of an article is likely to have, and those that it may have by its title.
COMMENT_NAMES = frozenset("comment comments commentlist commentform disqus replies respond".split())
CLEAR_NAMES = COMMENT_NAMES | frozenset("adbox adslot adunit adsense advert adverts advertisement advertising advertisment banner banners sponsor sponsors sponsored promo promos promotion breadcrumb breadcrumbs masthead footer footers sidebar sidebars widget widgets popup modal newsletter subscribe subscription signup pager pagination toolbar".split())
SHARE_NAMES = frozenset("share sharing".split())
OTHER_NAMES = frozenset("nav navs navbar navigation navmenu menu menus menubar foot copyright aside related social reply discussion feedback cookie cookies consent notice notices notification notifications disclaimer login search searchbox searchform tag tags skip skiplink alert alerts".split())
AD_PARTS = frozenset("ad ads slot box unit container wrapper wrap banner block area zone label text top bottom left right side inline middle google".split())
#: A class with one of these words tells of an absence or a state.
STATE_WORDS = frozenset("no not non without has have with is hide enable enabled disable disabled open closed on off sticky fixed toggle".split())
NAME_WORD = re.compile("[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
TOKEN = re.compile(r"<!--(?:-?>|.*?--!?>|.*)|<[!?][^>]*+(?:>|$)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)(?:>|$)", re.S)
ATTRIBUTE = re.compile(r"([^\s=>\"'/]+)(?:\s*=\s*(\"[^\"]*\"?|'[^']*'?|[^\s>]+))?")


class Block:
    __slots__ = ("text", "words", "linked", "region", "boiler", "main", "heading")

    def __init__(self, text: str, words: int, linked: int, region: int, main: bool, heading: bool):
        self.text, self.words, self.linked, self.region, self.main, self.heading = text, words, linked, region, main, heading
        self.boiler = False


# The header of a post holds its title, and what a search has found is no search form.
OWN_PARTS, OWN_HEADER = frozenset("post entry article story".split()), frozenset(["header"])
RESULT_WORDS, SEARCH_FOUND = frozenset("result results".split()), frozenset(["search"])


def region_names(value: str) -> set[str]:
    """The words of a class list or id that may name a region."""
    out: set[str] = set()
    for name in value.split():
        words = [w.lower() for w in NAME_WORD.findall(name)]
        if STATE_WORDS.isdisjoint(words):
            own = OWN_HEADER if not OWN_PARTS.isdisjoint(words) else SEARCH_FOUND if not RESULT_WORDS.isdisjoint(words) else frozenset()
            out.update(w for w in words if (w not in AD_PARTS or w == "banner") and w not in own)
            if words and not {"ad", "ads"}.isdisjoint(words) and all(w in AD_PARTS or w.isdigit() for w in words):
                out.add("advert")
    return out


def _names(tag: str, name: str, in_main: bool) -> frozenset[str]:
    """The names that make a region of boilerplate, as class or id of such a tag."""
    if not in_main:
        return CLEAR_NAMES | SHARE_NAMES | OTHER_NAMES | {"header"}
    part = tag == "section" or tag not in BLOCK_TAGS or HEADING.fullmatch(tag)
    if name == "id":
        return frozenset() if part else CLEAR_NAMES
    return CLEAR_NAMES | SHARE_NAMES if part else CLEAR_NAMES | SHARE_NAMES | OTHER_NAMES  # an article's own header stays


NO, MAYBE, SURELY = 0, 1, 2


def _is_boiler(tag: str, attributes: str, in_main: bool) -> int:
    """Whether an element is a region of boilerplate; MAYBE if not where it turns out to be the whole page."""
    if tag in ("nav", "footer", "head"):
        return SURELY
    found = MAYBE if tag in BOILER_TAGS and not (tag == "header" and in_main) else NO
    if attributes and tag not in ("html", "body", "article", "main"):
        for name, value in ATTRIBUTE.findall(attributes):
            name, value = name.lower(), value.strip("\"'")
            if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
                return SURELY
            if name == "role" and value.lower() in BOILER_ROLES:
                found = max(found, MAYBE)
            if name in ("class", "id"):
                names = region_names(value) & _names(tag, name, in_main)
                found = max(found, NO if not names else SURELY if names & COMMENT_NAMES else MAYBE)
    return found


class Regions:
    """The boilerplate regions of a page as a forest: of each its parent, whether it surely is one, and what it holds."""

    def __init__(self):
        self.parent, self.sure, self.mains, self.plain = [-1], [False], [0], [0]

    def open(self, parent: int, sure: bool) -> int:
        for column, value in ((self.parent, parent), (self.sure, sure or parent > 0 and self.sure[parent]), (self.mains, 0), (self.plain, 0)):
            column.append(value)
        return len(self.parent) - 1

    def settle(self) -> list[bool]:
        """Which regions are boilerplate, or stand in one."""
        for k in range(len(self.parent) - 1, 0, -1):
            if not self.sure[k]:  # an article among reader comments makes no page
                self.mains[self.parent[k]] += self.mains[k]
            self.plain[self.parent[k]] += self.plain[k]
        boiler = [False]
        for k in range(1, len(self.parent)):
            whole = self.mains[k] == self.mains[0] if self.mains[0] else self.plain[k] > 0.8 * self.plain[0]
            boiler.append(boiler[self.parent[k]] or self.sure[k] or not whole)
        return boiler


def _raw_end(page: str, tag: str, at: int) -> re.Match | None:
    return re.compile(rf"(?i)</{tag}(?=[\s/>])[^>]*>?").search(page, at)


def _skipped_ends(page: str) -> dict[int, int]:
    """Where each element of SKIPPED_TAGS ends, by the end of its start tag; none for one whose end tag is missing."""
    ends: dict[int, int] = {}
    open_: list[tuple[str, int]] = []
    held: Counter[str] = Counter()
    at = 0
    while m := TOKEN.search(page, at):
        at, tag = m.end(), (m[2] or "").lower()
        if tag in RAW_TAGS and not m[1] and not m[3].rstrip().endswith("/"):
            stop = _raw_end(page, tag, at)
            at = stop.end() if stop else len(page)
        elif tag in VOID_TAGS or tag not in BLOCK_TAGS and tag not in SKIPPED_TAGS:
            continue
        elif not m[1]:
            if not (tag in SKIPPED_TAGS and m[3].rstrip().endswith("/")):
                open_.append((tag, at))
                held[tag] += 1
        elif held[tag]:
            while True:
                name, start = open_.pop()
                held[name] -= 1
                if name == tag:
                    break
            if tag in SKIPPED_TAGS:
                ends[start] = at
    return ends


def text_blocks(page: str) -> list[Block]:
    """The flat blocks of a page, in order, without scripts, styles, comments and markup."""
    blocks: list[Block] = []
    regions = Regions()
    stack: list[tuple[str, int, bool]] = []  # open tags: name, region outside of it, is main
    held: Counter[str] = Counter()  # how many of each name are open
    parts: list[str] = []
    linked_parts: list[str] = []
    region = main = links = 0
    heading = False
    unended: int | None = None  # place in the stack of an element without an end tag of its own
    skipped: dict[int, int] | None = None

    def close() -> None:
        nonlocal linked_parts
        if parts:
            words = html.unescape("".join(parts)).split()
            if words:
                linked = min(len(html.unescape("".join(linked_parts)).split()), len(words)) if linked_parts else 0
                blocks.append(Block(" ".join(words), len(words), linked, region, main > 0, heading))
                regions.plain[region] += len(words) - linked
            parts.clear()
            linked_parts = []

    def add(text: str) -> None:
        if text:
            parts.append(text)
            if links:
                linked_parts.append(text)

    def push(tag: str, boiler: int) -> None:
        nonlocal region, main
        stack.append((tag, region, tag in MAIN_TAGS))
        held[tag] += 1
        if boiler:
            region = regions.open(region, boiler == SURELY)
        if tag in MAIN_TAGS:
            main += 1
            regions.mains[region] += 1

    def pop() -> str:
        nonlocal region, main
        tag, region, is_main = stack.pop()
        held[tag] -= 1
        main -= is_main
        return tag

    at, end = 0, len(page)
    while at < end:
        m = TOKEN.search(page, at)
        if not m:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        closing = bool(m[1])
        if unended is not None and len(stack) <= unended:
            unended = None
        if tag in RAW_TAGS and not closing and not m[3].rstrip().endswith("/"):
            if tag in BLOCK_TAGS or tag == "xmp":
                close()
            stop = _raw_end(page, tag, at)
            if tag == "xmp":  # shown as it stands
                add(html.escape(page[at : stop.start() if stop else end]))
                close()
            at = stop.end() if stop else end
        elif tag in SKIPPED_TAGS and not closing:
            if tag in BLOCK_TAGS:
                close()
            if m[3].rstrip().endswith("/"):
                continue
            if skipped is None:
                skipped = _skipped_ends(page)
            if at in skipped:
                at = skipped[at]
            else:  # its end tag is missing
                close()
                unended = len(stack) if unended is None else unended
                push(tag, SURELY)
        elif tag == "a":
            links = 0 if closing else 1
        elif unended is not None and not closing and tag in BLOCK_TAGS and tag not in SKIPPED_PARTS and tag not in VOID_TAGS:
            close()
            while len(stack) > unended:
                pop()
            unended, at = None, m.start()
        elif tag in BLOCK_TAGS or not closing and m[3] and tag not in VOID_TAGS and _is_boiler(tag, m[3], main > 0):
            close()
            if tag in BLOCK_TAGS:
                links = links if tag in ("br", "li", "div", "p") else 0
            if tag in VOID_TAGS:
                continue
            if HEADING.fullmatch(tag):
                heading = not closing
            if not closing:
                if tag == "p" or tag == "li":  # these end with the next of their kind
                    while stack and stack[-1][0] == tag:
                        pop()
                push(tag, _is_boiler(tag, m[3], main > 0))
            elif held[tag]:
                while pop() != tag:
                    pass
        elif closing and held[tag]:
            close()
            while pop() != tag:
                pass
    close()
    boiler = regions.settle()
    for b in blocks:
        b.boiler = boiler[b.region]
    return blocks


FEATURES = ("words", "link_density", "words_before", "link_density_before", "words_after", "link_density_after", "in_boiler", "in_main", "heading", "outside_main")


def describe(blocks: list[Block]) -> np.ndarray:
    """One row of FEATURES for each block."""
    n = len(blocks)
    out = np.zeros((n, len(FEATURES)))
    if n:
        words = np.array([b.words for b in blocks], dtype=np.float64)
        density = np.array([b.linked for b in blocks]) / words
        out[:, 0], out[:, 1] = words, density
        out[1:, 2], out[1:, 3] = words[:-1], density[:-1]
        out[:-1, 4], out[:-1, 5] = words[1:], density[1:]
        out[:, 6], out[:, 7], out[:, 8] = [b.boiler for b in blocks], [b.main for b in blocks], [b.heading for b in blocks]
        out[:, 7] *= 1 - out[:, 6]
        out[:, 9] = out[:, 7].any() * (1 - out[:, 7])
    return out


class DecisionTree:
    """Binary splits of least Gini impurity, to a bounded depth; ties go to the first feature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, depth: int = 12, least: int = 2):
        self.root = self._grow(x, y, depth, least)

    def _grow(self, x: np.ndarray, y: np.ndarray, depth: int, least: int):
        if depth == 0 or len(y) < least or y.min() == y.max():
            return float(y.mean())
        best = None
        for f in range(x.shape[1]):
            order = np.argsort(x[:, f], kind="stable")
            v, t = x[order, f], y[order]
            left, ones = np.arange(1, len(v)), np.cumsum(t)[:-1]
            right, rest = len(v) - left, t.sum() - ones
            impurity = ones * (1 - ones / left) + rest * (1 - rest / right)
            impurity[v[1:] == v[:-1]] = np.inf
            k = int(np.argmin(impurity))
            if impurity[k] < np.inf and (best is None or impurity[k] < best[0] - 1e-9):
                best = impurity[k], f, (v[k] + v[k + 1]) / 2
        if best is None:
            return float(y.mean())
        low = x[:, best[1]] <= best[2]
        return best[1], best[2], self._grow(x[low], y[low], depth - 1, least), self._grow(x[~low], y[~low], depth - 1, least)

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.empty(len(x))

        def go(node, rows: np.ndarray) -> None:
            if isinstance(node, float):
                out[rows] = node
            elif len(rows):
                low = x[rows, node[0]] <= node[1]
                go(node[2], rows[low])
                go(node[3], rows[~low])

        go(self.root, np.arange(len(x)))
        return out >= 0.5


PLAIN_WORDS = "rain fell over the old harbour while two boats waited for the morning tide to turn and a gull cried from its post by the net shed where nobody mended anything that day".split()


class PageMaker:
    """Labelled pages by a seeded rule; a page is a list of (html, labels of its blocks: 1 is main text).

    ``style`` says how regions are marked: "tags" (nav, article, footer), "names" (classes and ids), or
    "plain" (unnamed divs, where only words and links tell).
    """

    def __init__(self, seed: int):
        self.r = Random(seed)

    def prose(self, n: int, linked: float = 0.0) -> str:
        words = [self.r.choice(PLAIN_WORDS) for _ in range(n)]
        k = round(n * linked)
        return " ".join([f'<a href="/p">{" ".join(words[:k])}</a>'] * (k > 0) + words[k:])

    def links(self, n: int) -> tuple[str, list[int]]:
        """Items that are all link: as a list, or in one line."""
        items = [f'<a href="/{k}">{self.prose(self.r.choice((1, 1, 2, 3, 6)))}</a>' for k in range(n)]
        if self.r.random() < 0.3:
            return f"<div>{self.r.choice((' | ', ' ')).join(items)}</div>", [0]
        return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>", [0] * n

    def region(self, style: str, tag: str, names: tuple[str, ...], inner: str) -> str:
        if style == "tags":
            return f"<{tag}>{inner}</{tag}>"
        return f'<div class="{self.r.choice(names)}">{inner}</div>' if style == "names" else f"<div>{inner}</div>"

    def article(self, style: str) -> tuple[str, list[int]]:
        r = self.r
        parts = [f"<h1>{self.prose(r.randint(1, 8))}</h1>"]
        marked = style == "tags" or style == "names" and r.random() < 0.6
        sizes = [r.choice((1, 2, 3, 5, 9, 14, 25, 40, 60, 150)) for _ in range(r.randint(0, 8))]
        if not marked:  # nothing but its words tells where it starts and ends
            sizes = [r.randint(18, 60), *sizes, r.randint(18, 60)]
        for k, n in enumerate(sizes):
            if k and r.random() < 0.2 and (marked or n > 9):
                parts.append(f"<h2>{self.prose(r.randint(1, 5))}</h2>")
            parts.append(f"<{(t := r.choice(('p', 'p', 'p', 'div', 'blockquote')))}>{self.prose(n, r.choice((0, 0, 0, 0.15, 0.3, 1.0 if marked else 0)))}</{t}>")
        if marked and r.random() < 0.4:  # a list of sources is a part of it
            items, _ = self.links(r.randint(1, 5))
            parts.append(items)
        inner = "".join(parts)
        labels = [1] * (len(parts) if not (marked and parts[-1].startswith("<ul>")) else len(parts) - 1 + parts[-1].count("<li>"))
        if marked and r.random() < 0.4:
            inner += self.region("names", "div", ("ad", "share", "comments", "sidebar", "widget"), f"<p>{self.prose(r.randint(3, 40))}</p>")
            labels = [*labels, 0]
        tag = r.choice(("article", "main")) if marked else "div"
        return f"<{tag}>{inner}</{tag}>", labels

    def page(self, style: str) -> tuple[str, list[int]]:
        r, parts = self.r, []
        put = lambda tag, names, inner, labels: parts.append((self.region(style, tag, names, inner), labels))
        top, bottom = r.random() < 0.75, r.random() < 0.75  # some pages start or end with their article
        if top and r.random() < 0.7:
            put("header", ("header", "site-header", "masthead"), f"<p>{self.prose(r.randint(1, 4))}</p>", [0])
        if top:
            put("nav", ("menu", "nav", "navbar"), *self.links(r.randint(2, 7)))
        if top and style != "plain" and r.random() < 0.5:
            parts.append((self.region("names", "div", ("cookie-notice", "banner", "newsletter", "ad", "promo"), self.prose(r.randint(4, 40))), [0]))
        parts.append(self.article(style))
        if parts[-1][0].startswith(("<article", "<main")) and r.random() < 0.4:  # what stands beside an article is none of it
            parts.insert(r.choice((len(parts), len(parts) - 1)), (f"<div><p>{self.prose(r.randint(3, 80))}</p></div>", [0]))
        if bottom and style != "plain" and r.random() < 0.5:
            put("aside", ("sidebar", "related", "widget"), f"<p>{self.prose(r.randint(5, 50))}</p>", [0])
        if bottom and r.random() < 0.7:
            inner, labels = self.links(r.randint(2, 6))
            put("aside", ("related", "sidebar"), f"<h3>{self.prose(r.randint(1, 3))}</h3>" + inner, [0, *labels])
        if bottom and style != "plain" and r.random() < 0.4:
            put("form", ("comments", "login", "subscribe"), f"<p>{self.prose(r.randint(2, 9))}</p><p>{self.prose(r.randint(2, 60))}</p>", [0, 0])
        if bottom:
            put("footer", ("footer", "site-footer", "copyright"), f"<p>&copy; {self.prose(r.randint(2, 7), r.choice((0, 0.5)))}</p>", [0])
        return "<html><head><title>t</title></head><body>" + "".join(h for h, _ in parts) + "</body></html>", [x for _, labels in parts for x in labels]


    def free_blocks(self, label: int) -> list[tuple[str, int]]:
        """Any blocks in any order: headings, paragraphs, link lists."""
        r, out = self.r, []
        for _ in range(r.randint(1, 9)):
            tag = r.choice(("p", "p", "div", "li", "td", "h2", "figcaption"))
            out.append((f"<{tag}>{self.prose(r.choice((1, 1, 2, 3, 4, 6, 9, 14, 20, 30, 50, 90, 200)), r.choice((0, 0, 0, 0.1, 0.2, 0.35, 0.5, 0.75, 1.0, 1.0)))}</{tag}>", label))
        return out

    def free_page(self) -> tuple[str, list[int]]:
        """A marked article of any blocks, alone or beside any others; or long paragraphs beside regions of any blocks."""
        r, tag = self.r, self.r.choice(("article", "main", "div"))
        before, inner, after = (self.free_blocks(label) if label or r.random() < 0.5 else [] for label in (0, 1, 0))
        if tag == "div":
            inner = [(f"<p>{self.prose(r.randint(30, 90), r.choice((0, 0.1, 0.2)))}</p>", 1) for _ in range(r.randint(3, 6))]
        held = lambda blocks: "".join(h for h, _ in blocks)
        beside = [held(x) if tag != "div" else self.region(r.choice(("tags", "names")), r.choice(("nav", "footer")), ("comments", "menu", "ad", "sidebar-right"), held(x)) for x in (before, after)]
        return f"<body>{beside[0]}<{tag}>{held(inner)}</{tag}>{beside[1]}</body>", [x for _, x in before + inner + after]


def labelled_pages(pages: int = 1200, seed: int = 1) -> list[tuple[str, list[int]]]:
    """(page, label of each of its blocks: 1 is main text): a third plain, a sixth by tags, a sixth by names, a third free."""
    make, styles = PageMaker(seed), ("plain", "tags", None, "plain", "names", None)
    return [make.page(style) if (style := styles[k % 6]) else make.free_page() for k in range(pages)]


@lru_cache(maxsize=1)
def default_tree() -> DecisionTree:
    x, y = [], []
    for page, labels in labelled_pages():
        x.append(describe(text_blocks(page)))
        y += labels
    return DecisionTree(np.concatenate(x), np.array(y, dtype=np.float64))


#: A paragraph of links stays between two others, and a page's only block stays, if it has so many words.
LINKED_WORDS, LONE_WORDS = 8, 3


def chosen(blocks: list[Block], tree: DecisionTree) -> list[bool]:
    """Which blocks are main text, by the tree and two rules on its answers.

    A page of one short block, of which the tree knows no example, is its own main text if it stands in no region of
    boilerplate and is not only links. And one linked paragraph between two that are kept, in the same region, is part of the text.
    """
    kept = [bool(k) for k in tree.predict(describe(blocks))]
    if len(blocks) == 1 and not blocks[0].boiler and blocks[0].words >= LONE_WORDS and blocks[0].linked < blocks[0].words:
        return [True]
    for k in range(1, len(blocks) - 1):
        before, b, after = blocks[k - 1 : k + 2]
        if not kept[k] and kept[k - 1] and kept[k + 1] and not b.boiler and b.words >= LINKED_WORDS and before.region == b.region == after.region and before.main == b.main == after.main:
            kept[k] = not before.heading and not after.heading
    return kept


def main_text(page: str | None, tree: DecisionTree | None = None) -> str:
    blocks = text_blocks(page or "")
    if not blocks:
        return ""
    return " ".join(b.text for b, keep in zip(blocks, chosen(blocks, tree or default_tree())) if keep)


def extract_pages(df: DataFrame, tree: DecisionTree | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) of each page."""
    kind = df.schema[id_col].dataType.simpleString()
    tree = tree or default_tree()

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h, tree) for h in b.column(2).to_pylist()]
            yield pa.record_batch({"id": b.column(0), "url": b.column(1), "text": pa.array(texts, pa.string()), "n_chars": pa.array(map(len, texts), pa.int64())})

    return require(df, id_col, url_col, html_col).mapInArrow(extract, f"id {kind}, url string, text string, n_chars long").withColumnRenamed("id", id_col).withColumnRenamed("url", url_col)
