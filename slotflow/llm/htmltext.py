"""Main text of web pages: flat text blocks, classified by a decision tree.

A page becomes a flat list of text blocks. A block is described by its words and link density,
by those of the blocks before and after it, by its size beside the largest block of the page,
and by what it stands in. A decision tree trained on the blocks of a small labelled table
keeps the main text; its first split is on words or links, and what containers are called only
corrects that.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^\"'>]|\"[^\"]*\"|'[^']*')*+|[^>]*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=\"'>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_PART = re.compile(r"[a-z]+|[A-Z][a-z]+|[A-Z]+")

_SKIPPED = frozenset("script style noscript template svg math iframe object canvas audio video title head textarea select option button datalist".split())
_RAW = frozenset("script style textarea title noscript iframe".split())
#: What may stand in a head; anything else begins the body.
_HEAD = frozenset("base head html link meta noframes noscript script style template title".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split()
)
_HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements whose end tag may be missing: what else their start ends, and where that search stops.
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "tbody": ({"tr", "td", "th", "thead", "tbody"}, {"table"}),
    "tfoot": ({"tr", "td", "th", "thead", "tbody"}, {"table"}),
}
_AROUND_TAGS = frozenset("nav footer aside menu dialog header".split())
_AROUND_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
_MAIN_TAGS = frozenset("article main".split())
#: Last words of class and id names of containers around the main text.
_AROUND_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs "
    "header masthead topbar footer foot copyright legal sidebar widget widgets related recommended cookie cookies consent notice alert popup modal "
    "overlay comment comments reply replies disqus respond form login signup subscribe newsletter search share sharing social tags pagination pager toolbar "
    "teaser teasers trending popular colophon disclaimer".split()
)
_MAIN_NAMES = frozenset("article main content post entry story body text".split())
#: Last words that say nothing of what is held, so that the first word counts; and first words that turn a name into a layout's.
_HOLDERS = frozenset(
    "area articles bar block body bottom box button buttons cell col column container content count entry form group holder icon icons inner item items left link links list news panel posts "
    "right row section slot stories text thread top unit wrap wrapper".split()
)
_LAYOUT = frozenset("with has no without is page layout open closed".split())

#: Names of the features, in order. The first ``LEADING`` may make the tree's first split.
FEATURES = "words links words_before links_before words_after links_after relative around named main heading".split()
LEADING = 7


@dataclass
class Block:
    """A piece of text between block tags, and where it stands."""

    text: str
    linked: int  # words in links
    around: bool  # in a menu, footer, aside or the like
    main: bool  # in an article or the like
    heading: bool
    holder: int = -1  # the nearest container with a name of what stands around main text
    named: bool = False  # in such a container that does not hold the main text itself

    @property
    def words(self) -> int:
        return self.text.count(" ") + 1


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(text)} if text else {}


def _names(attributes: dict[str, str]) -> list[list[str]]:
    """Class and id names as their parts, without names that only describe a layout."""
    each = f"{attributes.get('class', '')} {attributes.get('id', '')}".split()
    parts = [[p.lower() for p in _PART.findall(name)] for name in each]
    return [p for p in parts if p and not (len(p) > 1 and _LAYOUT & {p[0], p[-1]})]


def _called(parts: list[str], names: frozenset[str]) -> bool:
    return parts[-1] in names or (parts[0] in names and parts[-1] in _HOLDERS)


@dataclass
class _Open:
    """An open element and what it says of the text in it."""

    tag: str
    hidden: bool
    around: bool
    main: bool
    holder: int


def _opened(tag: str, attributes: dict[str, str], inside: _Open, holders: list[int]) -> _Open:
    role = attributes.get("role", "").lower()
    hidden = "hidden" in attributes or bool(_UNSEEN.search(attributes.get("style", ""))) or attributes.get("aria-hidden", "").lower() == "true"
    around = (tag in _AROUND_TAGS and not (tag == "header" and inside.main)) or role in _AROUND_ROLES
    main, named = tag in _MAIN_TAGS or role == "main", tag == "form"
    if tag not in ("body", "html"):
        for parts in _names(attributes):
            own = _called(parts, _AROUND_NAMES)
            if own and parts[-1] == "header" and (inside.main or tag == "header"):
                own = False  # an article's own head
            # An article is called what the page says of it: only a plain name tells what it is.
            named |= own and (tag not in _MAIN_TAGS or len(parts) == 1 and parts[0] not in ("tags", "header"))
            main |= not own and _called(parts, _MAIN_NAMES)
    holder = inside.holder
    if named:
        holder = len(holders)
        holders.append(inside.holder)
    return _Open(tag, inside.hidden or hidden, inside.around or around, inside.main or main, holder)


_ROOT = _Open("", False, False, False, -1)


def blocks(page: str) -> list[Block]:
    """The flat blocks of a page. White space is one space; character references are decoded.

    Tags that are missing are borne: list items, table cells and paragraphs end where the next
    begins, an end tag closes what is open inside its element, a stray one counts for nothing,
    and a tag or comment that the page breaks off in is dropped. Hidden elements hold no text.
    Time and memory grow with the length of the page, however it is nested.
    """
    out: list[Block] = []
    stack: list[_Open] = []
    open_tags: dict[str, int] = {}
    holders: list[int] = []  # the container around each named one
    texts: list[str] = []
    linked: list[str] = []
    link: int | None = None  # depth of the stack where a link began
    heading = False
    skips = _Skips(page)

    def close() -> None:
        text = " ".join(html.unescape("".join(texts)).split())
        inside = stack[-1] if stack else _ROOT
        if text and not inside.hidden:
            words = len(html.unescape("".join(linked)).split())
            out.append(Block(text, words, inside.around, inside.main, heading, inside.holder))
        texts.clear()
        linked.clear()

    def pop(depth: int) -> None:
        nonlocal link
        for gone in stack[depth:]:
            open_tags[gone.tag] -= 1
        del stack[depth:]
        if link is not None and link > depth:
            link = None

    def end(tags: set[str] | frozenset[str], stop: set[str] | frozenset[str] = frozenset()) -> bool:
        if not any(open_tags.get(t) for t in tags):
            return False
        for depth in range(len(stack) - 1, -1, -1):
            if stack[depth].tag in tags:
                pop(depth)
                return True
            if stack[depth].tag in stop:
                break
        return False

    at, n = 0, len(page)
    while at < n:
        found = _TAG.search(page, at)
        text = page[at : found.start()] if found else page[at:]
        if text:
            texts.append(text)
            if link is not None:
                linked.append(text + " ")
        if not found:
            break
        at = found.end()
        ending, tag = found[1], (found[2] or "").lower()
        if not tag:
            continue
        if tag in _SKIPPED:
            if not ending:
                close()
                at = skips.behind(found, tag)
            continue
        if tag == "a":
            link = None if ending else len(stack)
            continue
        if tag == "br":
            texts.append(" ")
            continue
        if tag in _VOID:
            if tag == "hr":
                close()
                end({"p"})
            continue
        attributes = {} if ending else _attributes(found[3])
        if tag in _INLINE:
            if ending:
                if open_tags.get(tag):
                    close()
                    end({tag})
                continue
            opened = _opened(tag, attributes, stack[-1] if stack else _ROOT, holders) if attributes else None
            inside = stack[-1] if stack else _ROOT
            if opened is None or (opened.hidden, opened.around, opened.holder) == (inside.hidden, inside.around, inside.holder):
                continue
        close()
        if ending:
            heading = False
            # A paragraph's end closes nothing that began before it.
            end({tag}, {"div", "article", "section", "td", "li"} if tag == "p" else frozenset())
            continue
        if tag not in _INLINE:
            end({"p"}, {"button", "table", "td", "th", "object"})
            heading = tag in _HEADING
        if tag in _ENDS:
            tags, stop = _ENDS[tag]
            while end(tags, stop):
                pass
        stack.append(_opened(tag, attributes, stack[-1] if stack else _ROOT, holders))
        open_tags[tag] = open_tags.get(tag, 0) + 1
    close()
    _name(out, holders)
    return out


def _name(found: list[Block], holders: list[int]) -> None:
    """Set ``named``. A container that holds most of the page's text and all its articles is a frame, whatever its name."""
    words, mains = [0] * len(holders), [0] * len(holders)
    plain = [max(0, b.words - b.linked) if not b.around else 0 for b in found]
    for b, n in zip(found, plain):
        if b.holder >= 0:
            words[b.holder] += n
            mains[b.holder] += b.main
    for i in range(len(holders) - 1, -1, -1):
        if holders[i] >= 0:
            words[holders[i]] += words[i]
            mains[holders[i]] += mains[i]
    total, main = sum(plain), sum(b.main for b in found)
    outside = [False] * len(holders)
    for i, above in enumerate(holders):
        frame = 4 * words[i] >= 3 * total and mains[i] == main
        outside[i] = not frame or (above >= 0 and outside[above])
    for b in found:
        b.named = b.holder >= 0 and outside[b.holder]


class _Skips:
    """Where elements end whose content is no text; each name is looked up over the page once."""

    def __init__(self, page: str) -> None:
        self.page, self.ends = page, {}

    def behind(self, start: re.Match, tag: str) -> int:
        if tag in _RAW:
            found = re.compile(f"</{tag}(?=[\\s/>])[^>]*(?:>|\\Z)|\\Z", re.I).search(self.page, start.end())
            return found.end()
        if tag == "head":
            return self._head(start.end())
        if tag not in self.ends:
            self.ends[tag], open_ = {}, []
            for found in re.finditer(f"<(/?){tag}(?=[\\s/>])[^>]*(?:>|\\Z)", self.page, re.I):
                if not found[1]:
                    open_.append(found.start())
                elif open_:
                    self.ends[tag][open_.pop()] = found.end()
        return max(start.end(), self.ends[tag].get(start.start(), 0))  # never closed: only the tag goes

    def _head(self, at: int) -> int:
        """Behind the head's end tag; where it is missing, before the first tag or text that cannot stand in a head."""
        while found := _TAG.search(self.page, at):
            tag = (found[2] or "").lower()
            if self.page[at : found.start()].strip():
                return at
            if found[1]:
                if tag == "head":
                    return found.end()
                if tag in ("body", "html", "br"):
                    return found.start()
            elif tag and tag not in _HEAD:
                return found.start()
            at = found.end()
            if tag in _HEAD - _VOID - {"head", "html"} and not found[1]:
                at = self.behind(found, tag)
        return at


def features(found: list[Block]) -> np.ndarray:
    """One row for each block, with the columns of ``FEATURES``."""
    if not found:
        return np.zeros((0, len(FEATURES)))
    words = np.array([b.words for b in found], dtype=float)
    links = np.array([min(1.0, b.linked / b.words) for b in found])
    edge = lambda x, first: np.concatenate([[0.0], x[:-1]]) if first else np.concatenate([x[1:], [0.0]])
    open_ = np.array([not (b.around or b.named) for b in found]) & (links < 0.5)
    relative = words / max(words[open_].max(initial=0.0), 1.0)
    flags = [np.array([getattr(b, name) for b in found], dtype=float) for name in ("around", "named", "main", "heading")]
    return np.column_stack([words, links, edge(words, True), edge(links, True), edge(words, False), edge(links, False), relative, *flags])


@dataclass(frozen=True)
class Tree:
    """Decision nodes: (feature, cut, left, right), or (-1, share of main text, 0, 0) for a leaf."""

    nodes: tuple[tuple[int, float, int, int], ...]

    def main(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), dtype=int)
        table = np.array(self.nodes)
        while True:
            feature = table[at, 0].astype(int)
            inner = feature >= 0
            if not inner.any():
                return table[at, 1] >= 0.5
            value = x[np.arange(len(x)), np.maximum(feature, 0)]
            at = np.where(inner, np.where(value <= table[at, 1], table[at, 2], table[at, 3]), at).astype(int)


def grow(x: np.ndarray, y: np.ndarray, depth: int = 8, least: int = 1, leading: int | None = None) -> Tree:
    """A tree of the splits with the lowest Gini impurity; of equal ones the first feature, lowest cut.

    ``leading`` is how many of the features may make the first split (all when None).
    """
    nodes: list[tuple[int, float, int, int]] = []

    def add(rows: np.ndarray, left: int) -> int:
        here = len(nodes)
        nodes.append((-1, float(y[rows].mean()) if len(rows) else 0.0, 0, 0))
        best = None
        if left and len(rows) >= 2 * least and 0 < y[rows].mean() < 1:
            for feature in range(x.shape[1] if here else leading or x.shape[1]):
                values = np.unique(x[rows, feature])
                for cut in (values[:-1] + values[1:]) / 2:
                    low = x[rows, feature] <= cut
                    if least <= low.sum() <= len(rows) - least:
                        p, q = y[rows[low]].mean(), y[rows[~low]].mean()
                        impurity = low.sum() * p * (1 - p) + (~low).sum() * q * (1 - q)
                        if best is None or impurity < best[0] - 1e-12:
                            best = (impurity, feature, cut, low)
        if best:
            _, feature, cut, low = best
            nodes[here] = (feature, float(cut), add(rows[low], left - 1), add(rows[~low], left - 1))
        return here

    add(np.arange(len(y)), depth)
    return Tree(tuple(nodes))


def fit(table: list[tuple[str, list[str]]]) -> Tree:
    """A tree from labelled pages: their HTML and the texts of their main blocks."""
    xs, ys = [], []
    for page, main in table:
        found = blocks(page)
        xs.append(features(found))
        ys += [b.text in main for b in found]
    return grow(np.concatenate(xs), np.array(ys, dtype=float), leading=LEADING)


def extract(page: str | None, tree: Tree) -> str:
    found = blocks(page or "")
    return "\n".join(b.text for b, keep in zip(found, tree.main(features(found))) if keep)


def main_text(page: Column, tree: Tree) -> Column:
    """The main text: kept blocks in page order, joined by line feeds; empty for NULL, empty and textless pages.

    Pages of any length are read whole; unclosed and stray tags are borne as :func:`blocks` says.
    Equal pages give equal texts.
    """

    @F.arrow_udf("string")
    def extract_text(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([extract(p.as_py(), tree) for p in batch], pa.string())

    return extract_text(page)
