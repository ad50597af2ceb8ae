"""Main text of web pages by smoothed text-to-tag ratios of their lines.

The standard library's parser turns a page into a stream of events. Text between
two block-level tags is a line, with the number of tags met since the line
before. Lines inside elements that are never part of an article (menus, headers,
footers, sidebars, forms, scripts, adverts, notices, comments, told by tag, role
or class) are set aside. Of the others the ratio of text to tags is smoothed
with a Gaussian along the page and thresholded at its standard deviation, which
gives clusters of dense lines; the content region is the articles that hold
dense lines, or else the innermost element that holds all of them. A
region is taken whole, so that short paragraphs between long ones stay; outside
of articles, lines that are mostly link text and not dense are left out. Where a
page has no article and most of its text stands in elements set aside for the
words of a class or id alone, which then are words of its subject, these words
don't count and the ratios decide; those of reader comments always count.

Defined results: null or empty html, and pages without text, give an empty text.
White space inside a line becomes one space; lines are joined by one space in
page order; nothing is capped. Rows are never dropped or merged.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.llm.arrow_columns import with_python_columns
from tidelog.llm.tables import table

SIGMA, REACH = 1.0, 3
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark meter q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split()
)
#: Elements whose text is never the article's.
DROPPED = frozenset("nav header footer aside form script style noscript template svg math iframe object button select textarea dialog head title menu canvas audio video map".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Words of a class or id that mark such an element.
DROPPED_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies copyright disqus "
    "discussion footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices notification overlay pager pagination popup promo "
    "promotion related replies reply respond responses search share sharing sidebar signup skip social sponsor sponsored subscribe subscription teaser toolbar topbar "
    "widget widgets".split()
)
COMMENT_WORDS = frozenset("comment comments reply replies response responses related teaser promo sponsored ad advert".split())
#: Of the marking words, those of reader comments.
READER_WORDS = frozenset("comment comments commentlist discussion disqus replies reply respond response responses".split())
#: So many times the text that stays makes the text set aside by words most of a page's.
MOSTLY = 4
#: Not set aside, set aside by words of a class or id, set aside by what an element is.
KEPT, BY_WORDS, DROPPED_ALWAYS = 0, 1, 2
#: Whole names of classes and ids that mark such an element inside an article too, where single words are often those of its subject.
OWN_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising breadcrumb breadcrumbs disqus modal nav navbar navigation newsletter overlay pager pagination popup promo "
    "share sharing sidebar signup social sponsor sponsored subscribe teaser toolbar widget widgets".split()
)
#: Adverts and comments by the usual names of their elements.
OWN_PATTERN = re.compile(
    r"(ads?|adv|adverts?|advertisements?|sponsor(ed)?)[-_]?(area|banner|block|box|container|content|label|placeholder|slot|space|unit|wrapper)|adsbygoogle|disqus[-_]thread"
    r"|comments?([-_]?(area|body|box|container|content|form|list|respond|reply|section|thread|wrapper))?|(newsletter|share|sharing|social)[-_](bar|box|buttons?|form|icons?|links?|signup)"
)
#: Elements whose ids are made of their headings.
TITLED = frozenset("section h1 h2 h3 h4 h5 h6".split())
#: Words before a marking word that make it say something about the page's layout only.
LAYOUT_WORDS = frozenset("has with no without".split())
CONTAINERS = frozenset("html body article main section div td blockquote center".split())
ARTICLES = frozenset(("article", "main"))
#: A tag that the page ends in the middle of.
UNENDED = re.compile(r"<[/!?a-zA-Z][^<>]*\Z")
_WORDS = re.compile(r"[a-z0-9]+")


def _marks(value: str) -> set[str]:
    """Marking words of a class or id."""
    found = set()
    for name in value.lower().split():
        words = _WORDS.findall(name)
        if not LAYOUT_WORDS.intersection(words):
            found.update(words)
    return found


def _marked(tag: str, classes: str, name: str, in_article: bool) -> bool:
    """Whether the class or id (``name``) says that an element is not the article's."""
    titled = tag in TITLED
    if in_article:
        own = lambda w: w in OWN_NAMES or OWN_PATTERN.fullmatch(w)
        return any(map(own, classes.lower().split())) or any(map(OWN_PATTERN.fullmatch if titled else own, name.lower().split()))
    if titled:
        return bool(_marks(classes) & DROPPED_WORDS) or any(map(OWN_PATTERN.fullmatch, name.lower().split()))
    return bool(_marks(f"{classes} {name}") & DROPPED_WORDS)


class LineParser(HTMLParser):
    """Collects lines: (text, tags before it, characters in links, container, article)."""

    def __init__(self, words: bool = True):
        super().__init__(convert_charrefs=True)
        self.words, self.by_words = words, 0  # whether marking words count, and the characters set aside by them
        self.lines: list[tuple[str, int, int, int, int]] = []
        self.parents = [-1]  # of containers
        self.stack: list[tuple[str, int, int, int]] = []  # tag, dropped, container, article
        self.dropped, self.container, self.article = KEPT, 0, -1
        self.text: list[str] = []
        self.tags = self.linked = self.links = 0

    def flush(self) -> None:
        if self.text:
            text = " ".join("".join(self.text).split())
            if text:
                self.lines.append((text, self.tags, self.linked, self.container, self.article))
                self.tags = 0
            self.text.clear()
        self.linked = 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag not in INLINE:
            self.flush()
        if tag in VOID:
            return
        if tag == "p" or tag == "li":  # their end tags may be missing
            self.leave(tag, CONTAINERS | {"ul", "ol", "table", "nav", "aside", "form", "footer", "header"})
        self.stack.append((tag, self.dropped, self.container, self.article))
        if tag == "a":
            self.links += 1
        self.dropped = self.drops(tag, attrs)
        if tag in CONTAINERS and not self.dropped:
            self.parents.append(self.container)
            self.container = len(self.parents) - 1
            if tag in ARTICLES and self.article < 0:
                self.article = self.container

    def drops(self, tag: str, attrs: list[tuple[str, str | None]]) -> int:
        if tag in DROPPED:
            return DROPPED_ALWAYS
        if not attrs and tag not in ARTICLES:
            return self.dropped
        given = {k: v or "" for k, v in attrs}
        if "hidden" in given or given.get("aria-hidden", "").lower() == "true" or "display:none" in given.get("style", "").replace(" ", "").lower():
            return DROPPED_ALWAYS
        classes, name = given.get("class", ""), given.get("id", "")
        if tag in ARTICLES:
            # An article inside an element dropped by its class only is an article still.
            return DROPPED_ALWAYS if _marks(classes) & COMMENT_WORDS or self.dropped and any(t in DROPPED for t, *_ in self.stack) else KEPT
        if tag in ("html", "body"):
            return self.dropped
        if given.get("role", "").lower() in DROPPED_ROLES:
            return DROPPED_ALWAYS
        if self.dropped == DROPPED_ALWAYS or not _marked(tag, classes, name, self.article >= 0):
            return self.dropped
        if self.article >= 0 or _marks(f"{classes} {name}") & READER_WORDS:
            return DROPPED_ALWAYS
        return BY_WORDS if self.words else self.dropped

    def leave(self, tag: str, barrier: frozenset[str] = frozenset()) -> None:
        """Close the innermost open ``tag`` and all within it."""
        for at in range(len(self.stack) - 1, -1, -1):
            if self.stack[at][0] == tag:
                self.links -= sum(t == "a" for t, *_ in self.stack[at:])
                _, self.dropped, self.container, self.article = self.stack[at]
                del self.stack[at:]
                return
            if self.stack[at][0] in barrier:
                return

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag not in INLINE:
            self.flush()
        if tag not in VOID:
            self.leave(tag, frozenset() if tag in CONTAINERS or tag in DROPPED else CONTAINERS)

    def handle_data(self, data: str) -> None:
        if not self.dropped:
            self.text.append(data)
            if self.links:
                self.linked += len(data)
        elif self.dropped == BY_WORDS:
            self.by_words += len(data.strip())


def smoothed(ratios: np.ndarray) -> np.ndarray:
    """Gaussian smoothing along the page."""
    reach = np.arange(-REACH, REACH + 1)
    kernel = np.exp(-(reach**2) / (2 * SIGMA**2))
    padded = np.pad(ratios, REACH, mode="edge")
    return np.convolve(padded, kernel / kernel.sum(), mode="valid")


def parsed(html: str, words: bool = True) -> LineParser:
    """The lines of a page."""
    parser = LineParser(words)
    parser.feed(UNENDED.sub("", html))
    parser.close()
    parser.flush()
    return parser


def main_text(html: str | None) -> str:
    """The article's text."""
    if not html:
        return ""
    parser = parsed(html)
    if parser.by_words and all(line[4] < 0 for line in parser.lines) and parser.by_words > MOSTLY * sum(len(line[0]) for line in parser.lines):
        parser = parsed(html, words=False)
    lines = parser.lines
    if not lines:
        return ""
    ratios = np.array([len(text) / max(1, tags) for text, tags, *_ in lines])
    level = smoothed(ratios)
    dense = level >= min(level.std(), level.max())
    mass = np.array([len(text) for text, *_ in lines]) * dense
    articles = {line[4] for line, d in zip(lines, dense, strict=True) if d and line[4] >= 0}
    in_articles = sum(m for line, m in zip(lines, mass, strict=True) if line[4] >= 0)
    if articles and 2 * in_articles >= mass.sum():
        return " ".join(line[0] for line in lines if line[4] in articles)
    held: dict[int, int] = {}  # dense text in each container and all within it
    for line, m in zip(lines, mass, strict=True):
        at = line[3]
        while at >= 0:
            held[at] = held.get(at, 0) + m
            at = parser.parents[at]
    region = max((c for c, m in held.items() if m >= mass.sum()), default=0)  # inner containers come later

    def inside(at: int) -> bool:
        while at > region:
            at = parser.parents[at]
        return at == region

    return " ".join(line[0] for line, d in zip(lines, dense, strict=True) if inside(line[3]) and (d or 2 * line[2] <= len(line[0])))


def extractor() -> Callable[[pa.Array], list[pa.Array]]:
    return lambda pages: [pa.array([main_text(h) for h in pages.to_pylist()], pa.string())]


def extract(pages: DataFrame, html: str = "html", into: str = "text") -> DataFrame:
    """``pages`` plus the main text of each."""
    return with_python_columns(pages, [(html, [T.StructField(into, T.StringType())], extractor)])


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every row of ``pages``."""
    found = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))
