"""Main text of web pages by text-to-tag ratios.

The standard library's streaming parser turns a page into lines, one for every block of text, each with its
number of characters, tags and characters in links. The ratio of text outside of links to tags of the lines is smoothed
with a Gaussian, and lines whose own and smoothed ratios reach a threshold of one standard deviation (at most half of the
largest) are the page's content; they alone decide where its text is:

* if most of them stand in articles, those articles are the text, whole, with short paragraphs, table cells and headlines, but for small ones under a linked headline beside a large one;
* else the lowest container that holds most of them: what shares a container with them, what stands between the first and
  the last of them unless it is mostly links, and the headings before the first. So plain blocks of a menu before the
  text and of a notice after it stay out.

Scripts, asides, footers and controls never become lines, and do not end one where they stand within it. Navigation that holds no article, forms, and blocks whose role, class or id names
what is not the article (adverts, comments, related pages and the like), are left out too, unless they hold the article itself or, on pages
without one outside of them, half of the text; and so are headers that are not an article's with its headline.

Defined results: a null or empty page, and one without any text, gives an empty text; unclosed and crossed
elements are closed as browsers do for the common cases; pages are read whole, of any length; the parser
holds one page at a time. Repeated rows are repeated. A column of the name of the result is replaced, no other is touched.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixlake.llm._shared import slices, small_batches, table

# Elements of HTML by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
DROPPED = frozenset("script style head title noscript template footer aside button select textarea option iframe object svg canvas dialog menu".split())
#: Dropped elements that stand within a line and do not end its block; those that show something part its words.
WITHIN = frozenset("script style noscript template button select textarea iframe object svg canvas".split())
SHOWN = frozenset("br img button select textarea iframe object svg canvas".split())
CONTAINERS = frozenset("article main section div td body blockquote form header".split())
SELF_CLOSING = frozenset("p li dt dd tr td th option".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
#: Parts of class and id names that mark what is not the article; after has-, with-, without- or no- they tell of a layout.
_NAMES = r"ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|nav\w*|menu\w*|breadcrumbs?|side-?bar|footer|masthead|cookies?|consent|gdpr|notices?|notification\w*|alert|popup|modal|overlay|newsletter|subscribe|subscription|sign-?up|log-?in|share|sharing|social|related|recommend\w*|teasers?|comments?|commentlist|disqus|replies|respond|widget|toolbar|pagination|pager|skip|copyright"
NAMES = re.compile(rf"(?:^|[\s_-])(?<!\bhas[_-])(?<!\bwith[_-])(?<!\bwithout[_-])(?<!\bno[_-])(?:{_NAMES}|header)(?:$|[\s_-])", re.IGNORECASE)
#: The same without headers.
NO_HEADER = re.compile(rf"(?:^|[\s_-])(?:{_NAMES})(?:$|[\s_-])", re.IGNORECASE)
ARTICLE_HEADER = re.compile(r"(?:entry|post|article|story|content)[_-]?header", re.IGNORECASE)
#: The same as a whole name, for paragraphs and other small blocks.
WHOLE_NAME = re.compile(rf"(?:^|\s)(?:{_NAMES})(?:$|\s)", re.IGNORECASE)
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
#: Standard deviation of the smoothing, in lines.
SIGMA = 1.0


class Line(NamedTuple):
    text: str
    tags: int
    linked: int
    container: int
    heading: bool


class Lines(HTMLParser):
    """Collects the lines of a page, and the containers that they stand in, from parser events."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool, int]] = []  # name, dropped, container
        self.lines: list[Line] = []
        # Of every container the one around it, its name, whether its names speak against it, and whether they only call it a header. 0 is the page.
        self.parent, self.kind, self.doubtful, self.headed = [0], ["page"], [False], [False]
        self.text: list[str] = []
        self.tags = self.linked = self.links = self.headings = 0

    def flush(self) -> None:
        if self.text:
            line = " ".join("".join(self.text).split())
            if line:
                self.lines.append(Line(line, self.tags, self.linked, self.open[-1][2] if self.open else 0, self.headings > 0))
            self.text, self.linked = [], 0
            self.tags = 0

    @staticmethod
    def judged(tag: str, attrs: list[tuple[str, str | None]]) -> tuple[bool, bool]:
        """Whether an element is dropped, and whether it is doubtful."""
        drops, doubtful = tag in DROPPED, tag in ("form", "nav")
        for k, v in attrs:
            if k == "hidden":
                drops = True
            elif v and (k == "aria-hidden" and v == "true" or k == "style" and HIDDEN.search(v)):
                drops = True
            elif v and k == "role" and v.lower() in ROLES:
                doubtful = True
            elif v and k in ("class", "id") and tag not in ("body", "html", "main"):
                # A small block is named as a whole; a part of its name may be about its text.
                doubtful |= bool((NAMES if tag in CONTAINERS or tag in ("ul", "ol", "dl", "table", "span", "center") else WHOLE_NAME).search(v))
        return drops, doubtful

    def is_header(self, tag: str, attrs: list[tuple[str, str | None]]) -> bool:
        """Whether nothing but being an article's header speaks against an element."""
        named = [v for k, v in attrs if v and k in ("class", "id", "role")]
        above, of_article = self.open[-1][2] if self.open else 0, any(ARTICLE_HEADER.search(v) for v in named)
        while above:
            of_article |= self.kind[above] in ("article", "main")
            above = self.parent[above]
        return of_article and tag != "form" and not any(NO_HEADER.search(v) or v.lower() in ROLES for v in named)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag not in INLINE and tag not in WITHIN:
            self.flush()
            if tag in SELF_CLOSING:
                self.close_open(tag)
        elif tag in SHOWN and not (self.open and self.open[-1][1]):
            self.text.append(" ")
        if tag in VOID:
            return
        _, dropped, container = self.open[-1] if self.open else ("", False, 0)
        drops, doubtful = self.judged(tag, attrs)
        doubtful |= tag == "header"
        # The label of a control is no text; elsewhere it is a word of its line.
        drops |= tag == "label" and any(x[0] == "form" for x in self.open)
        if dropped or drops:
            drops = True
        elif tag in CONTAINERS or doubtful and tag not in INLINE:
            self.parent.append(container)
            self.kind.append(tag)
            self.doubtful.append(doubtful)
            self.headed.append(doubtful and tag != "nav" and self.is_header(tag, attrs))
            container = len(self.parent) - 1
        elif doubtful:
            drops = True
        self.links += tag == "a"
        self.headings += tag in HEADINGS
        self.open.append((tag, drops, container))

    def close_open(self, tag: str) -> None:
        """Close an element of this name that is still open inside the nearest container, list or table."""
        for i in range(len(self.open) - 1, -1, -1):
            name = self.open[i][0]
            if name == tag:
                self.pop(i)
                return
            if name in CONTAINERS or name in ("ul", "ol", "dl", "table", "nav", "footer", "aside"):
                return

    def pop(self, i: int) -> None:
        self.links -= sum(x[0] == "a" for x in self.open[i:])
        self.headings -= sum(x[0] in HEADINGS for x in self.open[i:])
        del self.open[i:]

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag not in INLINE and tag not in WITHIN:
            self.flush()
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                self.pop(i)
                return
            if tag in INLINE and self.open[i][0] not in INLINE:
                return

    def handle_data(self, data: str) -> None:
        if not (self.open and self.open[-1][1]):
            self.text.append(data)
            if self.links:
                self.linked += len(data)


def gaussian(values: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    reach = int(np.ceil(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return np.convolve(np.pad(values, reach, mode="edge"), kernel / kernel.sum(), mode="valid")


def summed(parent: list[int], own: list[int]) -> list[int]:
    """Sums over containers and all inside them; a container stands after the one around it."""
    total = list(own)
    for c in range(len(parent) - 1, 0, -1):
        total[parent[c]] += total[c]
    return total


def without_doubtful(parser: Lines) -> list[Line]:
    """The lines but those in doubtful containers, unless one holds half of the text, an article or, as a header, a headline.

    Navigation stays out unless it holds an article, as where its end is missing.
    """
    parent, kind, n = parser.parent, parser.kind, len(parser.parent)
    articles = summed(parent, [int(kind[c] in ("article", "main")) for c in range(n)])
    gone = [False] * n
    for c in range(1, n):
        gone[c] = gone[parent[c]] or kind[c] == "nav" and not articles[c]
    chars, headlines = [0] * n, [0] * n
    lines = [x for x in parser.lines if not gone[x.container]]
    for x in lines:
        chars[x.container] += len(x.text)
        headlines[x.container] += x.heading
    inside, headlines = summed(parent, chars), summed(parent, headlines)
    out = [False] * n
    for c in range(1, n):
        own = kind[c] in ("article", "main")
        half = kind[c] != "nav" and 2 * inside[c] > inside[0]
        innocent = half and articles[c] == articles[0] or articles[c] > own or parser.headed[c] and headlines[c] > 0
        out[c] = out[parent[c]] or parser.doubtful[c] and not innocent
    return [x for x in lines if not out[x.container]]


def teasers(lines: list[Line], article: list[int], whole: set[int]) -> set[int]:
    """Of several articles those that have less than a fifth of the largest one's text under a headline that is a link."""
    chars, linked = dict.fromkeys(whole, 0), set()
    for x in lines:
        a = article[x.container]
        if a in whole:
            chars[a] += len(x.text)
            if x.heading and 2 * x.linked > len(x.text):
                linked.add(a)
    return {a for a in linked if 5 * chars[a] < max(chars.values())}


def main_text(html: str | None) -> str:
    if not html:
        return ""
    parser = Lines()
    parser.feed(html)
    parser.close()
    parser.flush()
    lines = without_doubtful(parser)
    if not lines:
        return ""
    sizes = np.array([max(0, len(x.text) - x.linked) / max(1, x.tags) for x in lines])
    smooth = gaussian(sizes)
    threshold = min(float(smooth.std()), float(smooth.max()) / 2)
    core = np.flatnonzero((smooth >= threshold) & (sizes >= min(threshold, sizes.max()))).tolist()
    parent, kind = parser.parent, parser.kind
    # The outermost article around each container; an article of its own inside another one belongs to it.
    article = [0] * len(parent)
    for c in range(1, len(parent)):
        article[c] = article[parent[c]] or (c if kind[c] == "article" else 0)
    mass = [0] * len(parent)
    for i in core:
        mass[lines[i].container] += len(lines[i].text)
    held = sum(len(lines[i].text) for i in core if article[lines[i].container])
    if 2 * held > sum(mass):
        whole = {article[lines[i].container] for i in core} - {0}
        whole -= teasers(lines, article, whole)
        return "\n".join(x.text for x in lines if article[x.container] in whole)
    inside, root = summed(parent, mass), 0
    while True:
        deeper = [c for c in range(root + 1, len(parent)) if parent[c] == root and 5 * inside[c] >= 4 * inside[0]]
        if not deeper:
            break
        root = deeper[0]
    within = [False] * len(parent)
    for c in range(len(parent)):
        within[c] = c == root or c > 0 and within[parent[c]]
    core = [i for i in core if within[lines[i].container]]
    beside = {lines[i].container for i in core if kind[lines[i].container] not in ("page", "body")}
    kept = []
    for i, x in enumerate(lines):
        among = core[0] <= i <= core[-1] and 2 * x.linked <= len(x.text)
        if within[x.container] and (x.container in beside or among or x.heading and i < core[0]):
            kept.append(x.text)
    return "\n".join(kept)


def extract(pages: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    """Add the main text of every page; one pass, no shuffle."""
    small_batches(pages.sparkSession)

    @F.arrow_udf("string")
    def texts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([main_text(x) for part in slices([batch]) for x in part.to_pylist()], pa.string())

    return pages.withColumn(out, texts(F.col(html).cast("string")))


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
