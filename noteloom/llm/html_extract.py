"""Main text of web pages.

The standard library's parser streams events into lines (blocks of text with their tags), of menus and notices as well
as of the article. Each line has a text-to-tag ratio; linked text, and text in an element whose name, class or role
speaks of something beside the article, counts with the tags. The ratios are smoothed by a Gaussian and split into two
clusters. The lines of the upper cluster choose the regions of the page that are its content.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import in_small_batches

#: Elements whose content is no text of the page.
RAW = frozenset("audio canvas datalist head iframe map noscript object script select style svg template textarea title video".split())
#: Elements beside the article by their name.
BESIDE = frozenset("aside button dialog fieldset footer form header label menu nav option".split())
#: Elements that begin and end a block.
BLOCK = frozenset("address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Containers whose share of linked text is taken as a whole.
REGION = frozenset("article body div dl main nav ol section table td ul".split())
#: Words of class, id and role that mark parts beside the article.
MARKS = frozenset(
    "ad ads advert advertisement advertising adverts alert banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disclaimer disqus footer gdpr header masthead menu modal nav navbar navigation newsletter notice "
    "notification pager pagination paywall popup promo promoted related replies respond share sharing sidebar signup social sponsor sponsored subscribe toolbar widget complementary contentinfo search".split()
)
#: Parts of a class name that leave the meaning of a mark as it is (ad-slot, site-footer, related-posts).
NEUTRAL = frozenset("area article bar block body bottom box buttons container entry fixed floating footer form global header holder inner item items left link links list main outer panel post posts primary reader right secondary section site slot sticky thread top unit user wrap wrapper".split())
#: Elements that hold the page: class words do not mark them; of an article, only these whole names do.
WHOLE = frozenset("html body main".split())
ARTICLE_MARKS = frozenset("ad advert advertisement comment promo sponsored".split())
#: Elements that a new one of these closes when their end tag is left out.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "p": {"p"}}
SIGMA = 1.5
#: Articles are the content if they hold this share of the upper cluster's text.
ARTICLE_SHARE = 0.2


def names_mark(name: str) -> bool:
    """Whether a class name is made of marks and of parts that leave their meaning: a word of another kind (market-share, has-comments, search-results) says that the name is of something else."""
    parts = "".join(c if c.isalnum() else " " for c in name).split()
    return any(p in MARKS for p in parts) and all(p in MARKS or p in NEUTRAL for p in parts)


#: How an element stands to the article: part of it, beside it by its class (unless it holds the page's heading), beside it for sure, or no text.
PART, NAMED, BESIDE_IT, NO_TEXT = range(4)


def standing(tag: str, attrs: list[tuple[str, str | None]]) -> int:
    """What an element's own name and attributes say of it."""
    if tag in RAW:
        return NO_TEXT
    named = False
    for name, value in attrs:
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and value and "display:none" in value.replace(" ", "").lower()):
            return BESIDE_IT
        if name in ("class", "id", "role") and value and tag not in WHOLE:
            words = value.lower().split()
            named = named or (any(w in ARTICLE_MARKS for w in words) if tag == "article" else any(map(names_mark, words)))
    return BESIDE_IT if tag in BESIDE else NAMED if named else PART


@dataclass
class Element:
    parent: int
    tag: str
    standing: int
    heading: bool = False  # holds a first heading or a main


@dataclass
class Line:
    text: str
    tags: int
    linked: int
    element: int


class Lines(HTMLParser):
    """Collects the page's elements and its lines; text of an inline element beside the article is a line of its own."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.elements = [Element(-1, "", PART)]
        self.lines: list[Line] = []
        self.stack = [0]
        self.parts: dict[int, list[str]] = {}  # text of the open block by its element, and of inline elements beside
        self.links = self.raw = self.tags = self.linked = 0
        self.owners = [0]  # the block, or the element beside the article, that text now belongs to

    def flush(self) -> None:
        for element, parts in self.parts.items():
            text = " ".join("".join(parts).split())
            if text:
                self.lines.append(Line(text, self.tags, min(self.linked, len(text)), element))
        self.parts.clear()
        self.tags = self.linked = 0

    def handle_starttag(self, tag, attrs):
        if tag in BLOCK:
            self.flush()
            top = self.elements[self.stack[-1]].tag
            if top in CLOSES.get(tag, ()) or (top == "p" and tag != "p"):
                self.pop()
        elif tag == "br":
            self.parts.setdefault(self.owners[-1], []).append(" ")
        self.tags += 1
        if tag in VOID:
            return
        kind = standing(tag, attrs)
        if tag in BLOCK or kind != PART or tag in ("a", "em", "span", "strong"):
            self.push(tag, kind)

    def push(self, tag: str, kind: int) -> None:
        if tag in ("h1", "main"):
            for e in self.stack:
                self.elements[e].heading = True
        self.elements.append(Element(self.stack[-1], tag, kind))
        self.stack.append(len(self.elements) - 1)
        self.owners.append(self.stack[-1] if tag in BLOCK or kind != PART else self.owners[-1])
        self.links += tag == "a"
        self.raw += kind == NO_TEXT

    def pop(self) -> None:
        gone = self.elements[self.stack.pop()]
        if gone.tag in BLOCK:
            self.flush()
        self.owners.pop()
        self.links -= gone.tag == "a"
        self.raw -= gone.standing == NO_TEXT

    def handle_endtag(self, tag):
        if tag in BLOCK:
            self.flush()
        self.tags += 1
        for i in range(len(self.stack) - 1, 0, -1):
            name = self.elements[self.stack[i]].tag
            if name == tag:
                while len(self.stack) > i:
                    self.pop()
                return
            if tag not in BLOCK and name in BLOCK:
                return  # an inline end tag closes nothing beyond its block

    def handle_data(self, data):
        if not self.raw:
            self.parts.setdefault(self.owners[-1], []).append(data)
            if self.links:
                self.linked += len(data)


def smoothed(values: list[float], sigma: float = SIGMA) -> list[float]:
    """Gaussian smoothing with the weights renormalised at the ends."""
    reach = int(3 * sigma)
    weights = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(reach + 1)]
    out = []
    for i in range(len(values)):
        total = weight = 0.0
        for j in range(max(0, i - reach), min(len(values), i + reach + 1)):
            w = weights[abs(i - j)]
            total += w * values[j]
            weight += w
        out.append(total / weight)
    return out


def threshold(values: list[float]) -> float:
    """Cut between two clusters of the values (two means, from the extremes); the least value if all are alike."""
    low, high = min(values), max(values)
    for _ in range(50):
        cut = (low + high) / 2
        below, above = [v for v in values if v < cut], [v for v in values if v >= cut]
        if not below:
            return min(values)
        new = sum(below) / len(below), sum(above) / len(above)
        if new == (low, high):
            break
        low, high = new
    return (low + high) / 2


def content_lines(elements: list[Element], lines: list[Line]) -> list[int]:
    """Places of the lines that are the page's content."""
    beside, article, depth = [False], [0], [0]
    for k, e in enumerate(elements[1:], 1):
        beside.append(beside[e.parent] or e.standing == BESIDE_IT or (e.standing == NAMED and not e.heading))
        article.append(article[e.parent] or (k if e.tag == "article" else 0))
        depth.append(depth[e.parent] + 1)
    own = [0 if beside[x.element] else len(x.text) - x.linked for x in lines]
    ratio = [math.log1p(n / max(1, x.tags)) for n, x in zip(own, lines)]
    smooth = smoothed(ratio)
    open_ = [i for i, x in enumerate(lines) if not beside[x.element]]
    if not open_:
        return []
    # A line that is mostly links, or beside the article, is lifted by its neighbours alone and chooses nothing.
    able = [i for i in open_ if 2 * own[i] > len(lines[i].text)] or open_
    cut = min(threshold(smooth), max(smooth[i] for i in able))
    chosen = [i for i in able if smooth[i] >= cut]
    weight = lambda some: sum(len(lines[i].text) for i in some)
    inside = [i for i in chosen if article[lines[i].element]]
    if inside and weight(inside) >= ARTICLE_SHARE * weight(chosen):
        regions = {article[lines[i].element] for i in inside}
        return [i for i in open_ if article[lines[i].element] in regions]

    # Without an article, the content is the least element that holds all chosen lines, save for lists of links in it.
    root = lines[chosen[0]].element
    for i in chosen[1:]:
        e = lines[i].element
        while e != root:
            if depth[e] >= depth[root]:
                e = elements[e].parent
            else:
                root = elements[root].parent
    region = [0]
    within = [root == 0]
    for k, e in enumerate(elements[1:], 1):
        region.append(k if e.tag in REGION else region[e.parent])
        within.append(k == root or within[e.parent])
    linked: dict[int, int] = defaultdict(int)
    total: dict[int, int] = defaultdict(int)
    for i in open_:
        linked[region[lines[i].element]] += lines[i].linked
        total[region[lines[i].element]] += len(lines[i].text)
    held = {region[lines[i].element] for i in chosen}
    plain = lambda r: r in held or 2 * linked[r] <= total[r]
    return [i for i in open_ if within[lines[i].element] and plain(region[lines[i].element])]


def main_text(html: str | None) -> str:
    """Article text: white space inside a block is one space, blocks are joined by a newline; empty if there is none."""
    if not html:
        return ""
    parser = Lines()
    parser.feed(html)
    parser.close()
    parser.flush()
    return "\n".join(parser.lines[i].text for i in content_lines(parser.elements, parser.lines))


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Main text of every page: page_id, url, text, n_chars (code points).

    Null html gives an empty text. Repeated rows give a row each, null ids and urls stay null, an empty table gives no
    rows, and other columns are not read. Broken markup is read as far as the parser can; nothing is capped.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py()) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    source = pages.select(pages[id_col].alias("page_id"), pages[url_col].alias("url"), pages[html_col].alias("html"))
    kinds = [source.schema[c].dataType.simpleString() for c in ("page_id", "url")]
    return in_small_batches(source).mapInArrow(run, f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars long")
