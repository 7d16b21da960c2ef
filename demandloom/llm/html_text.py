"""Main text of web pages: text-to-tag ratios of parser blocks, smoothed and clustered, select the content region."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterable
from dataclasses import dataclass
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Elements whose text is never shown as prose.
SILENT = frozenset("script style noscript template svg math iframe object canvas audio video select button textarea head title map".split())
#: Silent elements that hold raw text: the rest of the page if they aren't closed.
RAW = frozenset("script style title textarea".split())
#: Elements that hold others and mark off a part of the page.
HOLDERS = frozenset(
    "html body main article section div nav header footer aside form dialog menu ul ol dl table thead tbody tr td th "
    "blockquote figure fieldset details center".split()
)
#: Elements that start a block of their own without holding others.
BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre address figcaption caption legend summary hr option".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Page furniture by element, role, and word of a class or id.
FURNITURE = frozenset("nav footer aside form dialog menu".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
HINTS = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs masthead topbar header footer sidebar widget ad ads advert adverts "
    "advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup "
    "modal overlay newsletter subscribe subscription signup login paywall search share sharing social comment comments disqus "
    "reply replies related recommended recommendations pagination pager toolbar copyright".split()
)
#: Hints that stand however much text is there: readers may write more than the author.
ASIDES = frozenset("comment comments disqus reply replies related recommended recommendations".split())
#: Holders that are a part of a text, not its region.
PARTS = frozenset("ul ol dl table thead tbody tr blockquote figure fieldset details".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Gaussian kernel over neighbouring blocks.
KERNEL = np.exp(-0.5 * np.arange(-2, 3) ** 2)
#: A holder with a hint in its class or id and more than this share of the page's plain text is no furniture.
MOST = 0.5
_WORDS = re.compile(r"[^a-z0-9]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


@dataclass
class Block:
    pieces: list[tuple[str, bool, int]]  # text, whether linked, number of the silent element around or -1
    tags: int
    parent: int
    furniture: bool
    heading: bool
    hints: frozenset[str]  # of its own class and id
    text: str = ""
    linked: int = 0


@dataclass
class Holder:
    """An element that holds others; what its ancestors imply is carried along, so that no path is ever walked."""

    tag: str
    parent: int
    name: str  # class as written: holders that share it are of one kind
    furniture: bool
    silent: int  # number of the innermost silent element, itself included, or -1
    kind: str  # article, main or nothing
    within: bool  # itself or an ancestor is an article or main
    hints: frozenset[str]
    closed: bool = False


class PageEvents(HTMLParser):
    """Turns parser events into blocks with their number of tags, linked characters and innermost holder."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[Block] = []
        self.holders: list[Holder] = []
        self.stack: list[int] = []
        self.open: Counter[str] = Counter()
        self.pieces: list[tuple[str, bool, int]] = []
        self.tags = self.links = 0
        self.odd = self.heading = False  # the current block itself is furniture, or a heading
        self.hints: frozenset[str] = frozenset()

    def top(self) -> Holder | None:
        return self.holders[self.stack[-1]] if self.stack else None

    def flush(self) -> None:
        if self.pieces:
            top = self.top()
            furniture = self.odd or bool(top and top.furniture)
            parent = self.stack[-1] if self.stack else -1
            self.blocks.append(Block(self.pieces, self.tags, parent, furniture, self.heading, self.hints))
        self.pieces, self.tags, self.odd, self.heading, self.hints = [], 0, False, False, frozenset()

    def _is_furniture(self, tag: str, attrs: dict[str, str | None], within: bool) -> bool:
        if tag in FURNITURE or "hidden" in attrs or (attrs.get("role") or "").lower() in ROLES:
            return True
        if "display:none" in (attrs.get("style") or "").replace(" ", "").lower():
            return True
        return tag == "header" and not within

    def _hints(self, tag: str, attrs: dict[str, str | None], within: bool) -> frozenset[str]:
        if tag in ("html", "body", "main", "article"):
            return frozenset()
        names = _CAMEL.sub(" ", f"{attrs.get('class') or ''} {attrs.get('id') or ''}").lower()
        hints = HINTS.intersection(_WORDS.split(names))
        return hints - {"header"} if tag in HEADINGS or within else hints  # a heading's or an article's own header

    def _hold(self, tag: str, attrs: dict[str, str | None]) -> None:
        top, number = self.top(), len(self.holders)
        within = bool(top and top.within)
        named = tag in ("article", "main") or attrs.get("role") in ("article", "main") or attrs.get("itemprop") == "articleBody"
        kind = ("article" if tag == "article" or attrs.get("itemprop") else "main") if named else ""
        furniture = bool(top and top.furniture) or (tag in HOLDERS and self._is_furniture(tag, attrs, within))
        hints = self._hints(tag, attrs, within) if tag in HOLDERS and not kind else frozenset()
        silent = number if tag in SILENT else top.silent if top else -1
        parent = self.stack[-1] if self.stack else -1
        self.holders.append(Holder(tag, parent, attrs.get("class") or "", furniture, silent, kind, within or named, hints, tag in RAW))
        self.stack.append(number)
        self.open[tag] += 1

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in SILENT or tag in HOLDERS:
            if tag in HOLDERS:
                self.flush()
            self._hold(tag, dict(attrs))
        elif tag in BLOCKS:
            self.flush()
            top = self.top()
            within = bool(top and top.within)
            self.odd = tag == "option" or bool(attrs) and self._is_furniture(tag, dict(attrs), within)
            self.hints = self._hints(tag, dict(attrs), within) if attrs else frozenset()
            self.heading = tag in HEADINGS
        elif tag == "br":
            self.pieces.append((" ", False, -1))
        elif tag == "a":
            self.links += 1
        self.tags += 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in VOID or tag not in HOLDERS | SILENT:
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag == "a":
            self.links = max(0, self.links - 1)
        elif tag in BLOCKS or tag in HOLDERS:
            self.flush()
        if self.open[tag]:
            while True:
                number = self.stack.pop()
                self.open[self.holders[number].tag] -= 1
                if self.holders[number].tag == tag:
                    self.holders[number].closed = True
                    break

    def handle_data(self, data: str) -> None:
        top = self.top()
        self.pieces.append((data, bool(self.links), top.silent if top else -1))

    def unknown_decl(self, data: str) -> None:
        pass

    def settle(self) -> None:
        """Text of the blocks, without what closed silent elements hold; an unclosed one silences nothing."""
        muted: list[bool] = []
        for number, h in enumerate(self.holders):
            above = h.parent >= 0 and muted[h.parent]
            muted.append(above or (h.silent == number and h.closed))
        for b in self.blocks:
            heard = [(data, linked) for data, linked, silent in b.pieces if silent < 0 or not muted[silent]]
            b.text = " ".join("".join(data for data, _ in heard).split())
            b.linked = sum(len(data) for data, linked in heard if linked)
            b.pieces = []
        self.blocks = [b for b in self.blocks if b.text]


def page_blocks(html: str) -> PageEvents:
    events = PageEvents()
    try:
        events.feed(html)
        events.close()
    except AssertionError:  # a marked section the parser doesn't know
        events = PageEvents()
        events.feed(html.replace("<![", "&lt;!["))
        events.close()
    events.flush()
    events.settle()
    return events


def clustered(blocks: list[Block]) -> tuple[np.ndarray, np.ndarray, float]:
    """Per block its text-to-tag ratio and the ratio smoothed over neighbours, and the least ratio of the content cluster.

    Linked characters count for nothing. Furniture has the ratio 0 and no part in smoothing or clustering.
    """
    ratio = np.array([0.0 if b.furniture else (len(b.text) - min(b.linked, len(b.text))) / max(1, b.tags) for b in blocks])
    plain = np.array([not b.furniture for b in blocks], bool)
    smooth = np.zeros(len(blocks))
    if not plain.any():
        return ratio, smooth, np.inf
    there = np.convolve(np.pad(np.ones(plain.sum()), 2), KERNEL, "valid")  # weight of the neighbours that exist
    smooth[plain] = near = np.convolve(np.pad(ratio[plain], 2), KERNEL, "valid") / there
    ranked = np.sort(near)
    sums, n = np.concatenate([[0.0], ranked.cumsum()]), len(ranked)
    low, high, last = ranked[0], ranked[-1], -1
    for _ in range(16):  # two clusters on a line
        k = int(ranked.searchsorted((low + high) / 2))
        if k == last:
            break
        low, high, last = (sums[k] / k if k else low), ((sums[n] - sums[k]) / (n - k) if k < n else high), k
    # Everything above the standard deviation is content as well: a page of even prose has no second cluster.
    return ratio, smooth, min((low + high) / 2, near.std() if near.std() > 0 else near.max())


def content_lines(blocks: list[Block]) -> np.ndarray:
    """Which blocks belong to the cluster of high smoothed text-to-tag ratios."""
    _, smooth, cut = clustered(blocks)
    return (smooth >= cut) & ~np.array([b.furniture for b in blocks], bool)


def subtree_sums(events: PageEvents, own: dict[int, float]) -> list[float]:
    """Per holder the sum of its own value and those of all holders inside; children have the larger numbers."""
    total = [own.get(n, 0) for n in range(len(events.holders))]
    for n in range(len(total) - 1, -1, -1):
        if events.holders[n].parent >= 0:
            total[events.holders[n].parent] += total[n]
    return total


def by_parent(blocks: list[Block], values: Iterable[float]) -> dict[int, float]:
    sums: dict[int, float] = defaultdict(float)
    for b, v in zip(blocks, values):
        sums[b.parent] += v
    return sums


def settle_hints(events: PageEvents) -> None:
    """Makes blocks furniture whose class and id hints, their own or a holder's, nothing overrides.

    A holder with a hint is no furniture if an article or main is inside, unless another one stands outside of all
    hints, or if it holds most of the text of the cluster that forms without hints. Comments and the like give way only
    to a main inside.
    """
    blocks, holders = events.blocks, events.holders
    if not any(b.hints for b in blocks) and not any(h.hints for h in holders):
        return
    content = content_lines(blocks)
    sizes = [len(b.text) * bool(c) for b, c in zip(blocks, content)]
    held = subtree_sums(events, by_parent(blocks, [not b.furniture for b in blocks]))
    inside = subtree_sums(events, by_parent(blocks, sizes))
    full = [n for n, h in enumerate(holders) if h.kind and held[n]]  # articles with text
    articles = subtree_sums(events, dict.fromkeys(full, 1))
    mains = subtree_sums(events, {n: 1 for n in full if holders[n].kind == "main"})
    wanted = set(full)
    hinted, far, clean = [], [], []  # of a holder's path: any hint, comments and the like, articles outside of all hints
    for n, h in enumerate(holders):
        above = h.parent
        hinted.append(bool(h.hints) or (above >= 0 and hinted[above]))
        far.append(bool(h.hints & ASIDES) or (above >= 0 and far[above]))
        clean.append((clean[above] if above >= 0 else 0) + (n in wanted and not hinted[n]))
    cleans = sum(n in wanted and not hinted[n] for n in range(len(holders)))
    total = sum(s for s, b in zip(sizes, blocks) if not (b.hints & ASIDES or (b.parent >= 0 and far[b.parent])))
    blocked: list[bool] = []
    for n, h in enumerate(holders):
        if h.hints & ASIDES:
            stands = mains[n] == 0
        else:
            stands = bool(h.hints) and not (articles[n] and clean[n] == cleans) and inside[n] <= MOST * total
        blocked.append(stands or (h.parent >= 0 and blocked[h.parent]))
    for b in blocks:
        own = b.hints and (b.hints & ASIDES or len(b.text) <= MOST * total)
        b.furniture = b.furniture or bool(own) or (b.parent >= 0 and blocked[b.parent])


def content_region(events: PageEvents, found: tuple[np.ndarray, np.ndarray, float]) -> int:
    """Number of the innermost holder around all content; -1 if it is the whole page.

    Content is every article with more plain than linked text, then what the cluster has inside main, else the cluster's
    blocks whose own ratio is high, so that short neighbours, in by smoothing alone, don't widen the region. Lists,
    tables and quotations are parts of a text: their holder is taken.
    """
    blocks, holders = events.blocks, events.holders
    ratio, smooth, cut = found
    plain = subtree_sums(events, by_parent(blocks, [0 if b.furniture else len(b.text) - 2 * b.linked for b in blocks]))
    outer, inner = [], []  # outermost article, innermost article or main
    for n, h in enumerate(holders):
        above = outer[h.parent] if h.parent >= 0 else -1
        outer.append(n if above < 0 and h.kind == "article" else above)
        inner.append(n if h.kind else inner[h.parent] if h.parent >= 0 else -1)
    named, rest = [], []
    for b, own, near in zip(blocks, ratio, smooth):
        article = outer[b.parent] if b.parent >= 0 else -1
        if b.furniture:
            continue
        if article >= 0 and (near >= cut or plain[article] > 0):
            named.append(article)
        elif near >= cut and b.parent >= 0 and inner[b.parent] >= 0:
            named.append(inner[b.parent])
        elif min(own, near) >= cut:
            rest.append(b.parent)
    wanted = named or rest
    if not wanted or -1 in wanted:
        return -1
    around = subtree_sums(events, Counter(wanted))
    region = max((n for n, count in enumerate(around) if count == len(wanted)), default=-1)
    while region >= 0 and holders[region].tag in PARTS and not holders[region].kind:
        region = holders[region].parent
    return region


def content_blocks(events: PageEvents, region: int, found: tuple[np.ndarray, np.ndarray, float]) -> list[Block]:
    """The region's blocks without what its ratios tell apart.

    Holders of one tag and class are one kind, judged by the text-to-tag ratio of them all, so that short paragraphs stay
    beside long ones of their kind. A kind goes whose text is mostly linked. So does one with a ratio below the cluster's,
    unless it has a heading in the smoothed cluster or, inside an article or main, any block there. A list, table or
    quotation goes only if it is mostly linked. Where the region is the whole page, its own blocks before and after
    the cluster go too.
    """
    blocks, holders = events.blocks, events.holders
    _, smooth, cut = found
    shown = [not b.furniture for b in blocks]
    chars = subtree_sums(events, by_parent(blocks, [len(b.text) * s for b, s in zip(blocks, shown)]))
    links = subtree_sums(events, by_parent(blocks, [min(b.linked, len(b.text)) * s for b, s in zip(blocks, shown)]))
    tags = subtree_sums(events, by_parent(blocks, [max(1, b.tags) * s for b, s in zip(blocks, shown)]))
    near = [bool(v >= cut) and s for v, s in zip(smooth, shown)]
    lines = subtree_sums(events, by_parent(blocks, near))
    heads = subtree_sums(events, by_parent(blocks, [n and b.heading for n, b in zip(near, blocks)]))
    below = [False] * len(holders)
    kinds: dict[object, np.ndarray] = defaultdict(lambda: np.zeros(5))
    for n, h in enumerate(holders):
        below[n] = region < 0 or h.parent == region or (h.parent >= 0 and below[h.parent])
        if below[n]:
            kinds[_kind(n, h)] += (chars[n], links[n], tags[n], lines[n], heads[n])

    def goes(n: int, h: Holder) -> bool:
        size, linked, count, close, headings = kinds[_kind(n, h)]
        if h.tag in PARTS:
            return 2 * linked > size
        low = size - linked < cut * count and not headings and not (h.within and close)
        return not h.kind and h.tag not in ("html", "body") and (2 * linked > size or low)

    gone: list[bool] = []
    for n, h in enumerate(holders):
        gone.append(below[n] and (goes(n, h) or (h.parent >= 0 and gone[h.parent])))
    kept = [s and (b.parent < 0 or not gone[b.parent]) and _inside(b, region, below) for b, s in zip(blocks, shown)]
    if region < 0 or holders[region].tag in ("html", "body"):
        core = [i for i, (n, k) in enumerate(zip(near, kept)) if n and k]
        low, high = (core[0], core[-1]) if core else (0, len(blocks))
        loose = lambda b: b.parent < 0 or b.parent == region or holders[b.parent].tag in ("html", "body")
        kept = [k and (low <= i <= high or not loose(b)) for i, (k, b) in enumerate(zip(kept, blocks))]
    return [b for b, k in zip(blocks, kept) if k]


def _kind(number: int, holder: Holder) -> object:
    return number if holder.tag in PARTS else (holder.tag, holder.name)


def _inside(block: Block, region: int, below: list[bool]) -> bool:
    return region < 0 or block.parent == region or (block.parent >= 0 and below[block.parent])


def main_text(html: str | None) -> str:
    """The page's article, its blocks joined by line feeds; empty if none."""
    events = page_blocks(html or "")
    if not events.blocks:
        return ""
    settle_hints(events)
    found = clustered(events.blocks)
    return "\n".join(b.text for b in content_blocks(events, content_region(events, found), found))


@F.pandas_udf(T.StringType())
def main_text_of(pages: pd.Series) -> pd.Series:
    return pages.map(main_text)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, `text` and n_chars (code points) of every row.

    A block's white space becomes single spaces, trimmed; empty blocks go. Furniture (menus, page headers, footers,
    sidebars, notices, adverts, forms, comments) is told by element, role, class and id; class and id give way where an
    article or most of the clustered text is inside. The region is the innermost element around all clustered text, of
    the articles and main where a page has them. Its own blocks stay, short ones too; holders inside it go if their text
    is mostly linked or their ratio is below the cluster's (`content_blocks`). A silent element that is never closed
    silences nothing. Time and memory grow in proportion to the page, however deep it is nested. Null, empty and text-free pages give the empty text. Rows with the same page_id are pages of their
    own. Other columns are not read.
    """
    texts = pages.select("page_id", "url", main_text_of(F.coalesce("html", F.lit(""))).alias("text"))
    return texts.withColumn("n_chars", F.length("text").cast("long"))
