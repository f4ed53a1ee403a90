"""Main text of web pages by text-to-tag ratio.

The standard library's parser streams events; they are laid out as lines, one
for each block of running text, with the count of its text and of its tags.
The text-to-tag ratios are smoothed with a Gaussian, and a threshold (found by
two-means clustering of the smoothed ratios) tells content from other lines;
content regions grow from the lines beyond it, and a page without such lines has
no text. Structure excludes and joins: what stands in scripts, styles,
navigation, headers, footers, asides, forms, notices, adverts and comment lists
(by element name, class, id or role) never counts, and where article or main
elements hold a third of the content lines' text or more, these elements are
the regions; else a region goes from the first content line to the last, with
the open lines around them.

White space inside a block becomes one space; blocks join in page order by one
space; character references are decoded by the parser. Nothing else is dropped
and nothing is capped.

Defined results: null, empty and textless html give an empty text; html that is
cut off anywhere gives what came before the cut; repeated rows give equal rows;
other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitquarry.llm._common import arrow_batches, lean, read

SIGMA = 1.0

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_SKIP = frozenset("script style template noscript iframe object svg head title select textarea".split())
_SIDE = frozenset("nav header footer aside form menu dialog button".split())
_BLOCK = frozenset("address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
#: elements that end an open p
_CLOSES_P = _BLOCK - {"body", "br", "caption", "html", "option", "title", "tbody", "td", "tfoot", "th", "thead", "tr"}
_PEERS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
_SIDE_NAME = re.compile(
    r"(?:^|[-_ ])(?:ads?|advert\w*|adsense|banner|sponsor\w*|promo\w*|nav|navbar|navigation|menu|breadcrumbs?|header|masthead|footer|sidebar|aside|widget|related|recommend\w*|share|sharing|social|cookies?|consent|notice|popup|modal|newsletter|subscribe|signup|login|search|comments?|commentlist|disqus|replies|pagination|pager|copyright|skip|toolbar|tags?)(?:$|[-_ ])",
    re.IGNORECASE,
)
#: elements of running text: a class names one of them only if it is the word itself, as in "ad" but not "share-price"
_TEXT = frozenset("p h1 h2 h3 h4 h5 h6 span em strong b i td li dt dd blockquote".split())
_SIDE_ROLE = frozenset("navigation banner contentinfo complementary search form menu menubar toolbar dialog alert alertdialog".split())


class _Lines(HTMLParser):
    """Lines of text: [text parts, characters, tags, side?, article number]."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, bool, bool, int]] = []  # name, skipped, side, article
        self.lines: list[list] = []
        self.parts: list[str] = []
        self.tags = 0
        self.articles = 0

    def _state(self) -> tuple[str, bool, bool, int]:
        return self.stack[-1] if self.stack else ("", False, False, 0)

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            _, _, side, article = self._state()
            self.lines.append([text, self.tags, side, article])
            self.tags = 0
        self.parts = []

    @staticmethod
    def _named(tag: str, given: dict[str, str]) -> bool:
        names = [given.get(k, "") for k in ("class", "id")]
        if tag in _TEXT:
            return any(_SIDE_NAME.fullmatch(x) for n in names for x in n.split())
        return any(map(_SIDE_NAME.search, names))

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """Broken declarations end at the next >, as browsers have it."""
        try:
            return super().parse_marked_section(i, report)
        except AssertionError:
            return self.rawdata.find(">", i) + 1 or -1

    def _pop(self, k: int) -> None:
        self.flush()
        del self.stack[k:]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in _BLOCK:
            self.flush()
        if tag in _CLOSES_P:
            for k in range(len(self.stack) - 1, -1, -1):
                if self.stack[k][0] == "p":
                    self._pop(k)
                    break
                if self.stack[k][0] in _BLOCK:
                    break
        if tag in _PEERS:
            peers, stop = _PEERS[tag]
            for k in range(len(self.stack) - 1, -1, -1):
                if self.stack[k][0] in stop:
                    break
                if self.stack[k][0] in peers:
                    self._pop(k)
        self.tags += 1
        if tag in _VOID:
            return
        _, skipped, side, article = self._state()
        given = {k: v or "" for k, v in attrs}
        if not side and tag not in ("html", "body", "article", "main"):
            side = tag in _SIDE or given.get("role", "").lower() in _SIDE_ROLE or self._named(tag, given) or "hidden" in given or given.get("aria-hidden") == "true"
        if tag in ("article", "main") and not side:
            self.articles += 1
            article = article or self.articles
        self.stack.append((tag, skipped or tag in _SKIP, side, article))

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in _BLOCK:
            self.flush()
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == tag:
                if tag in _BLOCK or tag in _SKIP:
                    self._pop(k)
                else:  # an inline element: what is open inside it stays in its own block
                    del self.stack[k:]
                return
            if tag not in _BLOCK and tag not in _SKIP and self.stack[k][0] in _BLOCK:
                return

    def handle_data(self, data: str) -> None:
        if not self._state()[1]:
            self.parts.append(data)


def smooth(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing; weights at the ends are made to sum to one."""
    r = max(1, round(2 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    weight = np.convolve(np.ones(len(ratios)), kernel, "full")[r : r + len(ratios)]
    return np.convolve(ratios, kernel, "full")[r : r + len(ratios)] / weight


def threshold(x: np.ndarray) -> float:
    """Where two-means clustering parts the values; below all of them if they are one cluster."""
    low, high = float(x.min()), float(x.max())
    if high <= 2 * low:
        return low
    for _ in range(100):
        cut = (low + high) / 2
        a, b = x[x < cut], x[x >= cut]
        new = (float(a.mean()) if len(a) else low, float(b.mean()) if len(b) else high)
        if new == (low, high):
            break
        low, high = new
    return (low + high) / 2


def main_blocks(html: str | None) -> list[str]:
    """The content blocks of a page, in page order."""
    if not html:
        return []
    cut = html.rfind("<!--")
    if cut >= 0 and "-->" not in html[cut:] and "</script" not in html[cut:].lower():
        html = html[:cut]  # cut off inside a comment
    cut = html.rfind("<!")
    if cut >= 0 and ">" not in html[cut:]:
        html = html[:cut]  # or a declaration
    parser = _Lines()
    parser.feed(html)
    parser.close()
    parser.flush()
    lines = parser.lines
    if not lines:
        return []
    ratios = np.array([0.0 if side else len(text) / max(1, tags) for text, tags, side, _ in lines])
    level = smooth(ratios)
    content = level >= threshold(level)
    return [line[0] for line, c in zip(lines, regions(lines, content)) if c]


def regions(lines: list[list], content: np.ndarray) -> np.ndarray:
    """The content lines, grown to whole regions. Without content lines there is none."""
    open_ = np.array([not side for _, _, side, _ in lines])
    content = content & open_
    if not content.any():
        return content
    size = np.array([len(text) for text, _, _, _ in lines])
    article = np.array([a for _, _, _, a in lines])
    inside = content & (article > 0)
    if 3 * size[inside].sum() >= size[content].sum():
        # marked elements that hold content lines are regions; what else passed the threshold stands beside the article
        return open_ & np.isin(article, np.unique(article[inside]))
    grown = content.copy()
    at = np.flatnonzero(content)
    for x, y in zip(at, at[1:]):  # what stands between two content lines, side lines apart
        grown[x : y + 1] |= open_[x : y + 1]
    for step, k in ((-1, at[0]), (1, at[-1])):  # open lines before the first (headings) and after the last
        k += step
        while 0 <= k < len(lines) and open_[k]:
            grown[k] = True
            k += step
    return grown


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    arrow_batches(pages.sparkSession)

    @lean
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [" ".join(main_blocks(h)) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(step, "page_id bigint, url string, text string, n_chars bigint")


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages"))
