"""Main text of web pages by smoothed text-to-tag ratios.

The standard library's parser streams events; every block of a page is a line with its text, its tags and the
section it stands in. The ratio of text to tags per line is smoothed with a Gaussian, lines above the threshold
cluster into content regions, and a region takes in the rest of its section. Lines of menus, headers, footers,
sidebars, notices, adverts, forms and comments have no ratio and are never taken.
"""

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from stopclock.llm.store import ready

# Element names of HTML, and words that name such parts of a page in class, id or role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
SECTION = frozenset("article main section div body td blockquote".split())
NEVER = frozenset("head title script style noscript template svg math iframe object canvas audio video map nav menu footer aside form button select textarea dialog".split())
CLOSED_BY_BLOCK = frozenset(["p"])
CLOSED_BY_OWN = frozenset("li dt dd tr td th option".split())
SIDE = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|banner|breadcrumbs?|comments?|cookies?|consent|copyright|disqus|footer|foot|form|gdpr|header|masthead|menu|modal|"
    r"nav\w*|newsletter|notice|pager|pagination|popup|promo\w*|related|respond|search|share|sharing|sidebar|social|sponsor\w*|subscribe|toolbar|widget)(?:$|[\s_-])",
    re.I,
)

SIGMA = 1.5
LINKED = 0.6


class _Lines(HTMLParser):
    """Blocks of a page: text pieces, number of tags, characters in links, section, and whether they can be content."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool, int, bool]] = []  # tag, never content, section, inside an article
        self.sections = 0
        self.links = 0
        self.lines: list[list] = []
        self._new()

    def _state(self) -> tuple[bool, int, bool]:
        return self.open[-1][1:] if self.open else (False, 0, False)

    def _new(self) -> None:
        never, section, article = self._state()
        if self.lines and not self.lines[-1][0]:
            tags = self.lines.pop()[1]
        else:
            tags = 0
        self.lines.append([[], tags, 0, never, section, article])

    def _pop(self, tag: str) -> None:
        at = next((i for i in range(len(self.open) - 1, -1, -1) if self.open[i][0] == tag), None)
        if at is not None:
            self.links -= sum(x[0] == "a" for x in self.open[at:])
            del self.open[at:]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.lines[-1][1] += 1
        if tag in VOID:
            return
        if tag in BLOCK and self.open:
            top = self.open[-1][0]
            if any(x[0] in CLOSED_BY_BLOCK for x in self.open[-4:]):
                self._pop("p")
            elif tag == top and tag in CLOSED_BY_OWN:
                self._pop(tag)
        never, section, article = self._state()
        if not never:
            inside = tag in ("article", "main")
            named = " ".join(v for k, v in attrs if k in ("class", "id", "role") and v)
            never = tag in NEVER or tag == "header" and not article or bool(not inside and named and tag not in ("body", "html") and SIDE.search(named))
            article = article or inside
        if tag in SECTION and not (article and tag not in ("article", "main")):
            self.sections += 1
            section = self.sections
        self.open.append((tag, never, section, article))
        self.links += tag == "a"
        if tag in BLOCK:
            self._new()

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.lines[-1][1] += 1
        self._pop(tag)
        if tag in BLOCK:
            self._new()

    def handle_data(self, data: str) -> None:
        never, section, article = self._state()
        line = self.lines[-1]
        if (line[3], line[4]) != (never, section):
            if line[0]:
                self._new()
                line = self.lines[-1]
            line[3:] = [never, section, article]
        line[0].append(data)
        if self.links > 0:
            line[2] += len(data.strip())


def main_text(html: str | None, coefficient: float = 1.0) -> str:
    """Main text of one page; empty if it has none."""
    parser = _Lines()
    parser.feed(html or "")
    parser.close()
    lines = [(" ".join("".join(pieces).split()), *rest) for pieces, *rest in parser.lines]
    lines = [x for x in lines if x[0] or x[1]]
    if not lines:
        return ""
    menu = np.array([x[3] or (not x[5] and x[2] > LINKED * len(x[0])) for x in lines])
    ratio = np.array([len(x[0]) / max(x[1], 1) for x in lines]) * ~menu
    reach = math.ceil(2 * SIGMA)
    bell = np.exp(-(np.arange(-reach, reach + 1) ** 2) / (2 * SIGMA**2))
    smooth = np.convolve(ratio, bell / bell.sum(), "full")[reach:-reach]
    chosen = (smooth >= coefficient * smooth.std()) & ~menu & (ratio > 0)
    if not chosen.any():
        chosen = ratio > 0
    text_of: dict[int, list[int]] = {}
    for x, take, out in zip(lines, chosen, menu, strict=True):
        if not out:
            both = text_of.setdefault(x[4], [0, 0])
            both[0] += len(x[0])
            both[1] += len(x[0]) * bool(take)
    # an article that has a region is the content; else the sections of the regions are
    articles = {x[4] for x, take in zip(lines, chosen, strict=True) if take and x[5]}
    sections = articles or {s for s, (whole, part) in text_of.items() if part * 2 >= whole > 0}
    return " ".join(x[0] for x, out in zip(lines, menu, strict=True) if x[0] and not out and x[4] in sections)


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = pa.array([main_text(html.as_py()) for html in batch.column(2)], pa.string())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), texts], ["page_id", "url", "text"])


def extract_main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text of every row: the article alone, its blocks in page order joined by one space.

    Character references are decoded and white space inside a block becomes one space. A null or empty page, and one
    without content, has the empty text. Markup may be broken or cut off. Rows may repeat and page_id or url may be
    null; further columns are ignored. A page is parsed by one task, in memory that follows the page.
    """
    ready(pages.sparkSession)
    return pages.select("page_id", "url", "html").mapInArrow(_extracted, "page_id long, url string, text string")
