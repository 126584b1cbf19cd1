"""Main text of web pages.

The page is fed in slices to the standard library's parser; its events cut the page into lines (one for each block
element) and count for each line the characters of text outside links and the tags in it. Logarithms of these ratios are
smoothed over neighbouring lines with a Gaussian, and two-means clustering of the smoothed values sets the threshold
between furniture and content. Lines above it are seeds, whatever tags they stand in. A box (the innermost division around
a line) with a seed whose own ratio, without its neighbours, passes too is a content region: it gives its lines between its
first and last seed and one more on either side (a title, a short end), but no strips of links. Markup only shifts this: in
an article a box needs a ratio lower by ARTICLE, and gives all its lines (one with lines of links only if it is the largest); lines inside navigation, header, footer, forms
and the like, or in an element whose class or role names such a thing, count as lines without text and are left out.
Articles named as comments or as something related are furniture, and those named as teasers have no prior.

Defined results: a null or empty page, or one without content, has the text "" and n_chars 0; repeated rows are done
each for itself; truncated or badly nested markup is read as far as it goes.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import read

SLICE = 1 << 16
SIGMA = 1.0
#: What an article tag takes off the logarithm of the ratio that a box needs: half as much text for each tag is enough.
ARTICLE = 0.7
#: Elements by what they hold.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("script style noscript template head title iframe object svg math canvas audio video select textarea button datalist".split())
FURNITURE = frozenset("nav header footer aside form menu dialog fieldset".split())
DIVISIONS = frozenset("article body div main section td".split())
BLOCKS = frozenset("address article aside blockquote body dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
#: Words in class, id or role that name furniture.
HINTS = re.compile(
    r"(?:^|[\s_-])(?:ads?|ad(?:box|slot|unit|space|banner)|advert\w*|sponsor\w*|promo\w*|banner|nav\w*|menu\w*|breadcrumbs?|side-?bar|footer|header|masthead|cookies?|consent|notices?|alert|disclaimer|popup|modal|overlay|newsletter|subscribe|signup|login|share|sharing|social|related|recommend\w*|comment\w*|replies|reply|disqus|widget|toolbar|pagination|pager|search|contentinfo|complementary|navigation|hidden)(?:$|[\s_-])",
    re.IGNORECASE,
)
#: Names that only say how a page is laid out, and hints that within an article stand for its own title.
LAYOUT = re.compile(r"(?:^|\s)(?:has|no|with|without|is|js)[-_]\S*", re.IGNORECASE)
TITLES = re.compile(r"(?:^|\s)\S*(?:header|masthead)\S*", re.IGNORECASE)

#: Names of what has articles of its own that are not the page's; names that only say whether there are any.
OTHERS = re.compile(r"(?:^|[\s_-])(?:comment\w*|replies|reply|disqus|related|recommend\w*)(?:$|[\s_-])", re.IGNORECASE)
STATES = re.compile(r"(?:^|\s)\S*[-_](?:open|closed|enabled|disabled|on|off|free)(?=\s|$)", re.IGNORECASE)
#: Names of an article that is one of many, and those that only tell its subject.
TEASERS = re.compile(r"(?:^|[\s_-])(?:cards?|teasers?|tiles?|preview|excerpt)(?:$|[\s_-])", re.IGNORECASE)
SUBJECTS = re.compile(r"(?:^|\s)(?:category|tag|topic|type|format|post|status)[-_]\S*", re.IGNORECASE)


@dataclass
class Line:
    article: bool
    furniture: bool
    box: int
    parts: list[str] = field(default_factory=list)
    tags: int = 1
    own: int = 0  # characters outside links, white space apart

    def text(self) -> str:
        return " ".join("".join(self.parts).split())


class Lines(HTMLParser):
    """Collects the lines of a page from parser events."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool, int, bool, int]] = []  # tag, unseen, furniture (1: by name, 2: by tag), article, box: each with what is above
        self.held: Counter[str] = Counter()  # open elements by tag: none is looked for in vain
        self.boxes = 0
        self.lines: list[Line] = []
        self.cut()

    def state(self) -> tuple[bool, int, bool, int]:
        return self.open[-1][1:] if self.open else (False, 0, False, 0)

    def cut(self) -> None:
        _, furniture, article, box = self.state()
        if self.lines and not self.lines[-1].parts:
            self.lines.pop()
        self.lines.append(Line(article, furniture > 0, box))

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in VOID:
            if tag in ("br", "hr"):
                self.add(" ")
            self.lines[-1].tags += 1
            return
        if tag in BLOCKS and self.held["p"]:
            self.close_to("p")
        elif tag in ("li", "dt", "dd", "tr", "td", "th", "option") and self.open and self.open[-1][0] == tag:
            self.close_to(tag)
        unseen, furniture, article, box = self.state()
        named = " ".join(v for k, v in attrs if k in ("class", "id", "role") and v)
        hidden = any(k == "hidden" or k == "aria-hidden" and v == "true" or k == "style" and v and "display:none" in v.replace(" ", "").lower() for k, v in attrs)
        is_article = tag in ("article", "main") or "main" in named.lower().split()
        names = LAYOUT.sub(" ", named)
        names = TITLES.sub(" ", names) if article else names
        own = SUBJECTS.sub(" ", TITLES.sub(" ", names)) if tag == "article" else ""
        if OTHERS.search(STATES.sub(" ", own if is_article else names)) and tag not in ("html", "body"):
            furniture, is_article = 2, False
        elif HINTS.search(STATES.sub(" ", own)):
            furniture, is_article = max(furniture, 1), False
        elif TEASERS.search(own):
            is_article = False
        elif is_article:
            furniture = 2 if furniture == 2 else 0  # an article within a wrapper of an odd name is one all the same
        elif tag in FURNITURE and not (tag == "header" and article):
            furniture = 2
        elif names and HINTS.search(STATES.sub(" ", names)) and tag not in ("html", "body"):
            furniture = max(furniture, 1)
        if tag in DIVISIONS:
            self.boxes += 1
            box = self.boxes
        self.open.append((tag, unseen or tag in UNSEEN or hidden, furniture, article or is_article, box))
        self.held[tag] += 1
        if tag in BLOCKS:
            self.cut()
        self.lines[-1].tags += 1

    def close_to(self, tag: str) -> None:
        if not self.held[tag]:
            return
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                block = any(t[0] in BLOCKS for t in self.open[i:])
                self.held.subtract(t[0] for t in self.open[i:])
                del self.open[i:]
                if block:
                    self.cut()
                return
            if tag == "p" and self.open[i][0] in BLOCKS:
                return

    def handle_endtag(self, tag: str) -> None:
        if tag == "br":
            self.add(" ")
        if tag not in VOID:
            self.close_to(tag)
        self.lines[-1].tags += 1

    def add(self, text: str) -> None:
        if not self.state()[0]:
            self.lines[-1].parts.append(text)
            if self.held["a"] <= 0:
                self.lines[-1].own += len("".join(text.split()))

    handle_data = add


def smooth(values: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing with mirrored ends."""
    reach = int(3 * sigma)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    padded = np.pad(values, reach, mode="symmetric" if len(values) >= reach else "edge")
    return np.convolve(padded, kernel / kernel.sum(), mode="valid")


def threshold(values: np.ndarray, rounds: int = 20) -> float:
    """The border of two clusters in one dimension (two means); all alike: below all."""
    low, high = float(values.min()), float(values.max())
    if high - low < 1e-9:
        return low
    for _ in range(rounds):
        middle = (low + high) / 2
        a, b = values[values <= middle], values[values > middle]
        if not len(a) or not len(b) or (a.mean(), b.mean()) == (low, high):
            break
        low, high = float(a.mean()), float(b.mean())
    return (low + high) / 2


def content(lines: list[Line]) -> list[bool]:
    """Which lines are in content regions."""
    own = np.array([0 if x.furniture else x.own for x in lines], float)
    tags = np.array([x.tags for x in lines], float)
    ratio = smooth(np.log1p(own / tags))
    border = threshold(ratio)
    boxes: dict[int, list[int]] = {}
    for i, x in enumerate(lines):
        if not x.furniture:
            boxes.setdefault(x.box, []).append(i)
    keep = [False] * len(lines)
    largest = max((held for held in boxes.values() if lines[held[0]].article), key=lambda held: own[held].sum(), default=None)
    for held in boxes.values():
        # the prior is for text: a box with lines of links needs what it would elsewhere, but for the largest
        article = lines[held[0]].article and (held is largest or bool(own[held].all()))
        least = border - ARTICLE * article
        seeds = [k for k, i in enumerate(held) if own[i] and ratio[i] >= least]
        if not seeds or np.log1p(own[held].sum() / tags[held].sum()) < least:
            continue
        first, last = (0, len(held) - 1) if article else (seeds[0] - 1, seeds[-1] + 1)
        for k in range(max(first, 0), min(last + 1, len(held))):
            # a line of links alone stays between lines of text, not in a strip or at an end
            keep[held[k]] = own[held[k]] > 0 or 0 < k < len(held) - 1 and bool(own[held[k - 1]] and own[held[k + 1]])
    return keep


def main_text(html: str | None) -> str:
    """The article of one page, a line for each block."""
    if not html:
        return ""
    parser = Lines()
    for at in range(0, len(html), SLICE):
        parser.feed(html[at : at + SLICE])
    parser.close()
    lines = [(x, t) for x in parser.lines if (t := x.text())]
    if not lines:
        return ""
    return "\n".join(t for (_, t), keep in zip(lines, content([x for x, _ in lines]), strict=True) if keep)


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text, n_chars for every page; one narrow pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x.as_py()) for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages"))
