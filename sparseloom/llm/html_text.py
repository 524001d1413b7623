"""Main text of web pages: flat text blocks, classified by a decision tree.

A page is cut into blocks at block-level tags. A block has its number of words and
its link density (share of words inside links), those of the two blocks before and
after it, and how much running text the page has before and after it. What tags and
names of classes say of an element (side matter, reader comments, main matter) is a
feature too, with the share of the page's words that the element holds; it drops or
keeps nothing by itself. A tree grown on a labelled table of generated pages says
which blocks are content.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from sparseloom.llm.common import read_table, small_batches

#: Tags of HTML that end the text block before them. Fixed values.
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
#: Tags without closing ones. Fixed values.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Tags whose content is never text of the page.
UNSEEN = frozenset("script style template noscript iframe object svg math canvas textarea title select button datalist audio video".split())
#: Of those, the ones that hold raw text up to their closing tag. Fixed values.
RAW = frozenset("script style textarea title iframe noscript".split())
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Elements that close an open one of their own kind.
SIBLINGS = frozenset(("p", "li", "td", "th", "dt", "dd", "option", "tr"))
#: What tags and names of elements hint at.
SIDE_TAGS = frozenset("nav footer aside form menu dialog header".split())
MAIN_TAGS = frozenset(("article", "main"))
SIDE_WORDS = frozenset(
    "ad ads adv advert advertisement banner breadcrumb breadcrumbs complementary consent contentinfo cookie cookies copyright disclaimer "
    "footer gdpr header legal login masthead menu menubar modal nav navbar navigation newsletter notice notification pager pagination popup "
    "promo promotion promoted recommended related search share sharing sidebar sidenav signup social sponsor sponsored subscribe teaser "
    "toolbar topbar trending widget".split()
)
TALK_WORDS = frozenset("comment comments disqus discussion feedback remarks replies reply respond responses".split())
MAIN_WORDS = frozenset("article body content entry main maincontent post postbody posttext story storybody text".split())
#: Last parts of compound names that leave the meaning to the first part, and first parts that only tell of a state.
NEUTRAL = frozenset("area bar block body box container content entry group holder inner item items links list panel posts row section slot text thread top unit wrap wrapper".split())
STATES = frozenset("has is no non not with without".split())

#: Of HTML elements, those whose start ends an svg or math element around them. Fixed values.
BREAKOUT = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split()
)
_NAME = re.compile(r"/?([a-zA-Z][^\s/>]*)")
_PLAIN = re.compile(r"[^>\"']*")
_HINT = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?=[\s=/]|$)|display\s*:\s*none", re.I)
_HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")
NONE, SIDE, TALK, MAIN = range(4)


class Tags:
    """The tags of a page, one after another, in time linear in its length.

    A tag ends at the first > outside quotes; a quote that is never closed counts as
    any other character. Where quotes swallow every > up to the end, tags from there on
    end at the first >. Without a > what looks like a tag is text.
    """

    def __init__(self, page: str):
        self.page = page
        self.last = {q: page.rfind(q) for q in "\"'>"}
        self.quotes = True

    def next(self, at: int) -> tuple[int, int, bool, str, str] | None:
        """Start, end, whether it closes, name ('' for comments and declarations) and attributes of the first tag from a place on."""
        page, last = self.page, self.last[">"]
        while True:
            start = page.find("<", at)
            if start < 0:
                return None
            if page.startswith("<!--", start):
                stop = page.find("-->", start + 4)
                return start, len(page) if stop < 0 else stop + 3, False, "", ""
            if start > last:
                return None if page.find("<!--", start) < 0 else self.next(page.find("<!--", start))
            if page[start + 1] in "!?":
                return start, page.find(">", start) + 1, False, "", ""
            name = _NAME.match(page, start + 1)
            if name:
                stop = self._stop(name.end())
                return start, stop + 1, page[start + 1] == "/", name[1], page[name.end() : stop]
            at = start + 1

    def _stop(self, at: int) -> int:
        page, first = self.page, at
        while self.quotes:
            at = _PLAIN.match(page, at).end()
            if at >= len(page):
                self.quotes = False
            elif page[at] == ">":
                return at
            else:
                at = (page.find(page[at], at + 1) if at < self.last[page[at]] else at) + 1
        return page.find(">", first)


@dataclass
class Block:
    words: list[str] = field(default_factory=list)
    linked: int = 0
    heading: bool = False
    listed: bool = False
    #: What the innermost element with a hint is; numbers of the innermost side and talk elements around the block, -1 if none; within a main one.
    near: int = NONE
    side: int = -1
    talk: int = -1
    main: bool = False


def _word_kind(w: str) -> int:
    return SIDE if w in SIDE_WORDS else TALK if w in TALK_WORDS else MAIN if w in MAIN_WORDS else NONE


@lru_cache(100_000)
def name_kind(name: str) -> int:
    """What a class, id or role hints at. A compound name means its last part, or its first one before a neutral part."""
    parts = [w for w in re.split(r"[^a-z]+", _HUMP.sub("-", name).lower()) if w]
    if not parts or parts[0] in STATES:
        return NONE
    first, last = _word_kind(parts[0]), _word_kind(parts[-1])
    if first in (SIDE, TALK) and parts[-1] in NEUTRAL:
        return first
    return last


def element_kind(tag: str, attributes: str, within_main: bool) -> int:
    kind = MAIN if tag in MAIN_TAGS else SIDE if tag in SIDE_TAGS and not (tag == "header" and within_main) else NONE
    if kind == NONE and attributes and tag not in ("body", "html", "a") and "=" in attributes:
        kinds = {name_kind(name) for m in _HINT.finditer(attributes) for name in (m[1] or m[2] or m[3] or "").split()}
        kind = next((k for k in (TALK, SIDE, MAIN) if k in kinds), NONE)
    return kind


def blocks(page: str) -> tuple[list[Block], list[int]]:
    """Text blocks in page order, those without a word left out; and the words within each element with a side or talk hint."""
    out: list[Block] = []
    held: list[int] = []  # words before the element while it is open, then words in it
    # open elements: tag, number in held or -1, and what was before: context, unseen, in a link
    stack: list[tuple[str, int, tuple[int, int, int, bool], bool, bool]] = []
    count: Counter[str] = Counter()
    around = (NONE, -1, -1, False)
    unseen = link = heading = False
    parts: list[tuple[str, bool]] = []
    total = 0
    endless: set[str] = set()

    def flush() -> None:
        nonlocal total
        if parts:
            words = html.unescape("".join([p for p, _ in parts])).split()
            if words:
                linked = sum(len(html.unescape(p).split()) for p, inside in parts if inside)
                out.append(Block(words, min(linked, len(words)), heading, bool(count["li"] or count["td"]), *around))
                total += len(words)
            parts.clear()

    def close() -> None:
        nonlocal around, unseen, link
        tag, number, around, unseen, link = stack.pop()
        count[tag] -= 1
        if number >= 0:
            held[number] = total - held[number]

    at, end, tags = 0, len(page), Tags(page)
    while at < end:
        m = tags.next(at)
        if not m:
            break
        start, stop, closing, tag, attributes = m
        if start > at and not unseen:
            parts.append((page[at:start], link))
        at, tag = stop, tag.lower()
        if not tag:
            continue
        if tag in BREAKOUT and not closing and not count["foreignobject"]:
            for foreign in ("svg", "math"):
                while count[foreign]:
                    close()
        if tag == "br":
            parts.append((" ", link))
            continue
        if tag in BLOCK or tag in UNSEEN and tag not in ("svg", "math"):
            flush()
        if closing:
            # up to the closest element of that tag; a closing tag without one is ignored
            if count[tag]:
                while stack[-1][0] != tag:
                    close()
                close()
            if tag in HEADINGS:
                heading = False
            continue
        if tag in RAW:
            stop = None if tag in endless else re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            if not stop:
                endless.add(tag)
            at = stop.end() if stop else (end if tag in ("script", "style") else at)
            continue
        if tag in VOID or attributes.endswith("/") and tag not in BLOCK:
            continue
        if tag in HEADINGS or tag == "p":
            heading = tag != "p"
        if tag == "a" and count["a"]:  # links don't hold links
            while stack[-1][0] != "a" and stack[-1][0] not in BLOCK:
                close()
            if stack[-1][0] == "a":
                close()
        if tag in SIBLINGS and len(stack) > 1 and stack[-1][0] == "a" and stack[-2][0] == tag:
            close()
        if tag in SIBLINGS and stack and stack[-1][0] == tag:  # ends where the next one starts
            close()
        elif tag not in BLOCK and tag not in UNSEEN and tag not in ("a", "foreignobject") and "=" not in attributes and "hidden" not in attributes:
            continue  # inline markup
        kind = element_kind(tag, attributes, around[3]) if tag != "a" else NONE
        stack.append((tag, len(held) if kind in (SIDE, TALK) else -1, around, unseen, link))
        count[tag] += 1
        if kind:
            around = (kind, len(held) if kind == SIDE else around[1], len(held) if kind == TALK else around[2], around[3] or kind == MAIN)
            if kind != MAIN:
                held.append(total)
        link = link or tag == "a"
        unseen = unseen or tag in UNSEEN or bool(attributes) and bool(_HIDDEN.search(attributes))
    if at < end and not unseen:
        parts.append((page[at:], link))
    flush()
    while stack:
        close()
    return out, held


FEATURES = (
    "words", "link", "words_before", "link_before", "words_after", "link_after", "words_before_2", "link_before_2", "words_after_2", "link_after_2",
    "text_before", "text_after", "of_longest", "heading", "listed", "title_after", "near_side", "near_talk", "near_main", "in_main", "side_share", "talk_share", "main_share",
)
#: Words of a block of running text, and its largest link density.
LONG, LINKED = 12, 0.34


def features(found: list[Block], held: list[int]) -> np.ndarray:
    """A row for each block, columns as in FEATURES. Neighbours beyond the page have no words."""
    n = len(found)
    if not n:
        return np.zeros((0, len(FEATURES)))
    words = np.zeros(n + 4)
    words[2:-2] = [len(b.words) for b in found]
    link = np.zeros(n + 4)
    link[2:-2] = [b.linked for b in found]
    link[2:-2] /= words[2:-2]
    w, total = words[2:-2], words.sum()
    text = np.where((w >= LONG) & (link[2:-2] <= LINKED), w, 0)
    before = np.cumsum(text) - text
    near = np.array([b.near for b in found])
    main = np.array([b.main for b in found], float)
    inside = np.array([0, *held]) / total
    headed = np.array([b.heading for b in found], float)
    first = int(headed.argmax()) if headed.any() else 0  # blocks before it have a title still to come
    return np.stack([
        w, link[2:-2], words[1:-3], link[1:-3], words[3:-1], link[3:-1], words[:-4], link[:-4], words[4:], link[4:],
        before / total, (text.sum() - before - text) / total, w / w.max(),
        headed, np.array([b.listed for b in found], float), np.arange(n) < first,
        near == SIDE, near == TALK, near == MAIN, main,
        inside[[b.side + 1 for b in found]], inside[[b.talk + 1 for b in found]], np.full(n, (w * main).sum() / total),
    ], 1)


class DecisionTree:
    """Splits that lower the Gini impurity most, to a depth; leaves hold the majority."""

    def __init__(self, depth: int = 11, least: int = 6):
        self.depth, self.least = depth, least
        self.column, self.limit, self.low, self.high, self.value = [], [], [], [], []

    def fit(self, x: np.ndarray, y: np.ndarray) -> DecisionTree:
        self._grow(x, y.astype(bool), self.depth)
        return self

    def _grow(self, x: np.ndarray, y: np.ndarray, depth: int) -> int:
        node = len(self.column)
        for a, v in ((self.column, -1), (self.limit, 0.0), (self.low, -1), (self.high, -1), (self.value, bool(2 * y.sum() >= len(y)))):
            a.append(v)
        if depth and 0 < y.sum() < len(y):
            best = min((s for c in range(x.shape[1]) if (s := self._split(x[:, c], y, c))), default=None)
            if best and best[0] < 1 - 1e-9:
                _, c, limit = best
                below = x[:, c] <= limit
                self.column[node], self.limit[node] = c, limit
                self.low[node] = self._grow(x[below], y[below], depth - 1)
                self.high[node] = self._grow(x[~below], y[~below], depth - 1)
        return node

    def _split(self, v: np.ndarray, y: np.ndarray, c: int) -> tuple[float, int, float] | None:
        """Impurity after the best split of a column, as a share of that before it."""
        order = np.argsort(v, kind="stable")
        v, y = v[order], y[order].astype(float)
        at = np.flatnonzero(v[1:] > v[:-1]) + 1
        at = at[(at >= self.least) & (len(v) - at >= self.least)]
        if not len(at):
            return None
        ones, n = np.cumsum(y), len(v)
        a, b = ones[at - 1], ones[-1] - ones[at - 1]
        after = a * (at - a) / at + b * (n - at - b) / (n - at)
        k = int(after.argmin())
        before = ones[-1] * (n - ones[-1]) / n
        return float(after[k] / before), c, float((v[at[k]] + v[at[k] - 1]) / 2)

    def predict(self, x: np.ndarray) -> np.ndarray:
        column, limit, low, high, value = (np.array(a) for a in (self.column, self.limit, self.low, self.high, self.value))
        node = np.zeros(len(x), np.int64)
        rows = np.arange(len(x))
        for _ in range(self.depth):
            c = column[node]
            step = np.where(x[rows, c] <= limit[node], low[node], high[node])
            node = np.where(c >= 0, step, node)
        return value[node]


#: Names of elements in the labelled pages.
NAMES = {
    "top": ("nav", "menu", "main-nav", "navbar", "topbar", "site-header", "header"), "side": ("sidebar", "widget", "widget-area", "right-sidebar", "sidenav"),
    "foot": ("footer", "site-footer", "copyright", "footer-links"), "ad": ("ad", "ads", "ad-slot", "advert", "sponsored", "promo", "banner"),
    "notice": ("cookie-notice", "notice", "consent", "newsletter", "cookies"), "more": ("related", "related-posts", "recommended", "share", "trending"),
    "talk": ("comments", "comment-list", "discussion", "replies", "commentsSection"), "main": ("content", "entry-content", "post", "article-body", "story", "main", "post-content", "text"),
    "plain": ("layout", "row", "page", "wrap", "has-sidebar", "no-sidebar", "header-fixed", "inner", "grid", "note warning", "with-comments", "col-8"),
}
TAGS = {"top": ("nav", "header"), "side": ("aside",), "foot": ("footer",), "ad": ("aside",), "notice": ("dialog", "aside"), "more": ("nav", "aside"), "talk": ("section",), "main": ("article", "main")}
#: Pages of the labelled table, and where its random choices start.
PAGES, SEED = 3000, 3
#: Of how many labelled pages one is there a second time without any hint.
BARE = 7


def labelled_pages(n: int = PAGES, seed: int = SEED, themes: tuple[str, ...] = ("tags", "classes", "mixed", "none", "wrapped")) -> list[str]:
    """The labelled table, as n pages put together at random. A block whose first word is 'keep' is content.

    Themes say how parts are marked: by tags, by class names, by either, not at all, or
    by either within an element whose name or tag misleads. Where nothing marks them,
    readers' comments come with linked names.
    """
    rng = random.Random(seed)

    def words(kind: str, k: int, linked: int = 0) -> str:
        k = max(1, k)
        linked = min(linked, k)
        plain = " ".join([kind] * (k - linked))
        return f"{plain} " * bool(plain) + f'<a href="#">{" ".join([kind] * linked)}</a>' * bool(linked)

    def size(middle: float, spread: float, most: int) -> int:
        return max(1, min(most, round(rng.lognormvariate(np.log(middle), spread))))

    def links(k: int, longest: int) -> str:
        items = (words("drop", m, m) for m in (rng.randint(1, longest) for _ in range(k)))
        style = rng.randrange(3)
        if style == 0:
            return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>"
        return "".join(f"<div>{x}</div>" for x in items) if style == 1 else "<p>" + " | ".join(items).replace("|", rng.choice(("", "drop"))) + "</p>"

    def text(kind: str, k: int, linked: int = 0) -> str:
        tag = rng.choice(("p", "p", "p", "div"))
        return f"<{tag}>{words(kind, k, linked)}</{tag}>"

    def article(marked: bool, mark) -> str:
        out = [f"<h1>{words('keep', size(6, 0.7, 20))}</h1>"] if rng.random() < 0.85 else []
        if out and rng.random() < 0.04:
            out.insert(0, text("keep", rng.randint(1, 6)))
        if rng.random() < 0.2:
            out.append(text("keep", rng.randint(2, 6)))
        middle = rng.choice((4, 12, 30, 45, 60))
        for i in range(rng.choice((1, 1, 2, 3, 4, 6, 9, 14))):
            roll = rng.random()
            if i and roll < 0.1:
                out.append(f"<h{rng.randint(2, 4)}>{words('keep', size(3, 0.6, 12))}</h2>")
            elif i and roll < 0.2:
                out.append("<ul>" + "".join(f"<li>{words('keep', size(7, 0.7, 60), rng.randrange(3) if rng.random() < 0.3 else 0)}</li>" for _ in range(rng.randint(2, 6))) + "</ul>")
            elif i and roll < 0.25:
                out.append(f"<blockquote>{words('keep', size(18, 0.7, 90))}</blockquote>")
            elif i and marked and roll < 0.32:
                out.append(mark(rng.choice(("ad", "more")), text("drop", size(7, 0.8, 30), rng.randrange(4)) if rng.random() < 0.6 else links(rng.randint(2, 5), 8)))
            elif i and roll < 0.36:
                out.append(f'<div class="{rng.choice(NAMES["plain"])}">{words("keep", size(14, 0.6, 60))}</div>')
            else:
                out.append(text("keep", size(middle, 0.9, 400), rng.randint(1, 4) if rng.random() < 0.25 else 0))
        return "".join(out)

    def page(theme: str) -> str:
        marked = theme != "none"

        def mark(part: str, inner: str) -> str:
            how = theme if theme in ("tags", "classes") else rng.choice(("tags", "classes"))
            if not marked:
                return f"<div>{inner}</div>"
            name = rng.choice(NAMES[part])
            if how == "tags" and part in TAGS and not (part == "talk" and rng.random() < 0.5):
                tag = rng.choice(TAGS[part])
                return f'<{tag} id="{name}">{inner}</{tag}>' if tag == "section" or rng.random() < 0.2 else f"<{tag}>{inner}</{tag}>"
            return f'<div {rng.choice(("class", "id"))}="{name}">{inner}</div>'

        def maybe(chance: float, part) -> str:
            return part() if rng.random() < chance else ""

        def ad(told: bool = marked) -> str:
            """Where nothing tells of it, wholly a link."""
            k = size(8, 0.6, 20 if told else 9)
            return mark("ad", text("drop", k, rng.choice((0, 0, k // 2, k)) if told else k))

        def form() -> str:
            fields = "".join(f"<label>{words('drop', rng.randint(1, 2))}</label><input name=x>" for _ in range(rng.randint(1, 3)))
            return f"<form>{maybe(0.5, lambda: text('drop', size(6, 0.5, 14)))}{fields}<button>drop</button></form>"

        def side() -> str:
            teaser = maybe(0.4, lambda: text("drop", size(12, 0.6, 35), rng.randint(2, 9)))
            return mark("side", f"<h3>{words('drop', rng.randint(1, 3))}</h3>{links(rng.randint(2, 8), 7)}{teaser}")

        def talk() -> str:
            linked = not marked or rng.random() < 0.5
            one = lambda: f"<div>{words('drop', 2, 2 * linked)}</div>" + text("drop", size(14, 0.9, 150))
            return mark("talk", f"<h3>{words('drop', rng.randint(1, 3))}</h3>" + "".join(one() for _ in range(rng.randint(1, 6))))

        def foot() -> str:
            k = size(7, 0.7, 40 if marked else 11)
            return mark("foot", maybe(0.4, lambda: links(rng.randint(2, 7), 3)) + text("drop", k, rng.choice((0, 0, k // 3, k))))

        top = maybe(0.2, lambda: mark("top", words("drop", rng.randint(1, 6)))) + maybe(0.9, lambda: mark("top", links(rng.randint(3, 12), 3)))
        main = article(marked, mark)
        titled = main.startswith("<h1")  # what stands above a title tells of itself
        top += maybe(0.4, lambda: ad(marked or titled)) + maybe(0.15 * marked, lambda: mark("notice", text("drop", size(14, 0.5, 30), rng.randrange(3))))
        if marked and rng.random() < 0.8:
            main = mark("main", main)
        left, right = (maybe(0.25, side) for _ in range(2))
        after = maybe(0.2, lambda: mark("more", f"<h3>{words('drop', rng.randint(1, 3))}</h3>{links(rng.randint(2, 6), 10)}"))
        after += maybe(0.25, talk) + right + maybe(0.2, form) + maybe(0.15, ad) + maybe(0.75, foot)
        body = f"{left}{main}{after}"
        if theme == "wrapped":
            misled = rng.choice(("form", "side", "main", "plain", "talk", "article"))
            if misled in ("side", "talk") or misled == "form" and rng.random() < 0.5:  # around the article alone
                name = rng.choice(NAMES[misled]) if misled != "form" else "form"
                around = f'<div class="{name}">{main}</div>' if misled != "form" else f"<form>{main}</form>"
                if rng.random() < 0.4:
                    top = left = after = ""
                body = f"{left}{around}{after}"
            elif misled == "form":
                body = f'<form id="page">{top}{body}</form>'
                top = ""
            else:
                body = f"<article>{body}</article>" if misled == "article" else f'<div class="{rng.choice(NAMES[misled])}">{body}</div>'
        if rng.random() < 0.15:
            body = f'<div class="{rng.choice(NAMES["plain"])}">{body}</div>'
        if rng.random() < 0.06:  # a page of little more than the text
            top, body = "", maybe(0.5, lambda: main) or mark("main", text("keep", size(2, 1, 12))) + maybe(0.3, ad)
        return f"<html><body>{top}{body}</body></html>"

    return [page(themes[i % len(themes)]) for i in range(n)]


def train_tree(pages: list[str] | None = None) -> DecisionTree:
    rows, labels, hints = [], [], FEATURES.index("near_side")
    for i, page in enumerate(pages or labelled_pages()):
        found, held = blocks(page)
        rows.append(features(found, held))
        labels += [b.words[0] == "keep" for b in found]
        if i % BARE == 0:  # as if all its names were unknown
            rows.append(np.where(np.arange(len(FEATURES)) < hints, rows[-1], 0))
            labels += [b.words[0] == "keep" for b in found]
    return DecisionTree().fit(np.concatenate(rows), np.array(labels))


@lru_cache(1)
def default_tree() -> DecisionTree:
    return train_tree()


def main_text(page: str | None, tree: DecisionTree) -> str:
    found, held = blocks(page or "")
    if not found:
        return ""
    return " ".join([" ".join(b.words) for b, kept in zip(found, tree.predict(features(found, held))) if kept])


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", tree: DecisionTree | None = None) -> DataFrame:
    """Main text of each page: page_id, url, text, n_chars, a row for each input row.

    A null or empty page, and one without content blocks, has the text ''. Markup
    that is cut off or nested wrongly is read as far as it goes. Equal rows get equal
    results; null ids and urls pass through. No shuffle.
    """
    sent = pages.sparkSession.sparkContext.broadcast(tree or default_tree())  # some hundred nodes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grown = sent.value
        for b in batches:
            texts = [main_text(p, grown) for p in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    base = pages.select(pages[id_col].alias("page_id"), pages[url_col].alias("url"), pages[html_col].alias("html"))
    kind = base.schema["page_id"].dataType.simpleString()
    return small_batches(base).mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(read_table(spark, sf_dir, "pages"))


QUERIES = {"op9_html_text": op9_html_text}
ORACLES: dict[str, str] = {}
