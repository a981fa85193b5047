"""Main text of web pages, from parser events and text-to-tag ratios.

The standard library's streaming parser turns a page into lines, one per
block. Each line has its text, the tags met in it, how much of it is linked,
and the elements that enclose it. Its text-to-tag ratio is that of unlinked
characters to tags. The ratios are smoothed by a Gaussian and weighed by where
the line stands: fully in an article, or anywhere in a page without article
elements; by ``AFAR`` outside the articles of a page that has some; and by
``BOILERPLATE`` in elements that are no article text by their kind, role or
class (menus, notices, forms, comments ...). The border of two clusters of the
weighed values is the threshold, and the lines over it mark the content regions.

A region is an outermost article, else the container of the lines. All lines
of a region stay, however short, but for containers inside it that weigh
little, or whose lines all have smoothed ratios under ``INNER`` of the
threshold (bars of links, labels and the like). What is not shown as text
(scripts, styles, templates, hidden elements ...) makes no lines.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt",
    "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html",
    "legend", "li", "main", "menu", "nav", "ol", "option", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th",
    "thead", "title", "tr", "ul",
}
#: Elements whose content is no text of the page.
SKIP = {
    "script", "style", "noscript", "template", "select", "textarea", "datalist", "iframe", "object", "svg", "canvas", "audio", "video", "head", "title",
}
#: Elements whose text is no article text.
ASIDE = {"nav", "footer", "aside", "form", "button", "dialog", "menu"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "form", "menu", "menubar", "toolbar"}
ARTICLE = {"article", "main"}
#: Class or id names, with an affix or not, of what is no article text.
NAMES = re.compile(
    r"(?:(?:site|page|main|global|top|bottom|left|right|the|post|article|user|reader|primary|secondary|cookie|social|site)[-_]?)?"
    r"(?:nav|navbar|navigation|menu|sidebar|side|footer|masthead|topbar|ad|ads|advert|adverts|advertisement|sponsor|sponsored|promo|promotion|banner"
    r"|cookie|cookies|consent|gdpr|notice|notices|notification|alert|comment|comments|disqus|respond|discussion|newsletter|subscribe|signup|share|sharing"
    r"|social|related|recommended|breadcrumb|breadcrumbs|popup|modal|overlay|toolbar|pagination|pager|widget|widgets|login|search)"
    r"(?:[-_]?(?:container|box|wrapper|wrap|area|section|list|bar|inner|block|unit|slot|panel|thread|message|form|link|links|menu|item|items|left|right|top|bottom|body|text|title|head|footer|policy|count|content|\d+))?",
    re.I,
)
HEADERS = re.compile(r"(?:(?:site|global|top|main)[-_]?)?header", re.I)
CLOSED_BY = {"p": BLOCKS - {"html", "body", "head", "title"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}, "head": {"body"}}


HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Blocks that hold text of the container around them.
TEXT_BLOCKS = HEADINGS | {"p", "li", "ul", "ol", "blockquote", "pre", "dl", "dt", "dd", "figure", "figcaption"}
#: Weights of lines that lie in boilerplate elements, and outside the articles of a page that has some.
BOILERPLATE, AFAR = 1e-6, 1e-3
#: Containers inside a region whose smoothed ratios all lie under this share of the threshold go.
INNER = 0.25
#: A weighed value of less is no content, whatever the page's other lines have.
LEAST = 0.01
COMMENT_END = re.compile("--!?>")
OUTSIDE = ("", 0, False, 0, 0, False, 0)


def ended(html: str) -> str:
    """The page without a tag that never ends: the parser would look through the rest of the page for each such start."""
    last = html.rfind(">") + 1
    tail = re.search(r"<[A-Za-z/]", html[last:])
    return html[: last + tail.start()] if tail else html


class Line:
    __slots__ = ("text", "tags", "linked", "article", "parent", "aside")

    def __init__(self, article: int, parent: int, aside: int):
        self.text: list[str] = []
        self.tags, self.linked, self.article, self.parent, self.aside = 1, 0, article, parent, aside


class Lines(HTMLParser):
    """Parser events to lines."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        #: (tag, number, left out, outermost article's number, container's number, in a heading, outermost boilerplate's number) of the open elements
        self.open: list[tuple[str, int, bool, int, int, bool, int]] = []
        self.there: dict[str, int] = {}
        self.count = self.links = 0
        self.lines: list[Line] = []
        self.line: Line | None = None

    def parse_comment(self, i, report=True):
        """A comment without an end goes on to the end of the page."""
        for empty in (">", "->"):
            if self.rawdata.startswith(empty, i + 4):
                return i + 4 + len(empty)
        end = COMMENT_END.search(self.rawdata, i + 4)
        return end.end() if end else len(self.rawdata)

    def parse_html_declaration(self, i):
        """Declarations and instructions end at the next ``>``, or with the page."""
        end = self.rawdata.find(">", i)
        return end + 1 if end >= 0 else len(self.rawdata)

    parse_pi = parse_html_declaration

    def _boilerplate(self, tag: str, attrs: list) -> bool:
        inside = bool(self.open and self.open[-1][3])
        if tag in ASIDE or tag == "header" and not inside:
            return True
        if tag in ("html", "body", *ARTICLE):
            return False
        for k, v in attrs:
            if k == "role" and (v or "").lower() in ROLES:
                return True
            if k in ("class", "id") and any(NAMES.fullmatch(x) or not inside and HEADERS.fullmatch(x) for x in (v or "").split()):
                return True
        return False

    def _push(self, tag: str, attrs: list) -> None:
        self.count += 1
        up = self.open[-1] if self.open else OUTSIDE
        self.open.append(
            (
                tag,
                self.count,
                up[2] or tag in SKIP or tag not in ("html", "body") and any(k == "hidden" for k, _ in attrs),
                up[3] or (self.count if tag in ARTICLE else 0),
                self.count if tag in BLOCKS - TEXT_BLOCKS else up[4],
                tag in HEADINGS or up[5] and tag not in BLOCKS - TEXT_BLOCKS,
                up[6] or (self.count if self._boilerplate(tag, attrs) else 0),
            )
        )
        self.there[tag] = self.there.get(tag, 0) + 1

    def _pop(self) -> None:
        tag = self.open.pop()[0]
        self.there[tag] -= 1

    def handle_starttag(self, tag, attrs):
        while self.open and tag in CLOSED_BY.get(self.open[-1][0], ()):
            self._pop()
        if tag in BLOCKS:
            self._end_paragraph(tag)
            self.line = None
        elif self.line:
            self.line.tags += 1
        if tag == "br":
            self.handle_data("\n")
        if tag == "a":
            self.links += 1
        if tag not in VOID:
            self._push(tag, attrs)

    def _end_paragraph(self, tag: str) -> None:
        """An open paragraph ends at a block, whatever inline elements are open in it."""
        if not self.there.get("p", 0):
            return
        for i in range(len(self.open) - 1, -1, -1):
            t = self.open[i][0]
            if t == "p" and tag in CLOSED_BY["p"]:
                while len(self.open) > i:
                    if self.open[-1][0] == "a":
                        self.links = max(0, self.links - 1)
                    self._pop()
                return
            if t in BLOCKS:
                return

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in BLOCKS:
            self.line = None
        if tag == "a":
            self.links = max(0, self.links - 1)
        if self.there.get(tag, 0):
            if tag not in BLOCKS:  # an inline element isn't closed from outside a block
                for t in reversed(self.open):
                    if t[0] == tag:
                        break
                    if t[0] in BLOCKS:
                        return
            while self.open[-1][0] != tag:
                self._pop()
            self._pop()

    def handle_data(self, data):
        top = self.open[-1] if self.open else OUTSIDE
        if top[2]:
            return
        if self.line is None:
            if not data.strip():
                return
            in_header = top[3] and not top[5] and self.there.get("header", 0)  # of an article's own header, the headings count
            self.line = Line(top[3], top[4], top[6] or (top[1] if in_header else 0))
            self.lines.append(self.line)
        self.line.text.append(data)
        if self.links:
            self.line.linked += len(data.strip())


def smoothed(ratio: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian smoothing, normalised at the ends."""
    if not len(ratio):
        return ratio
    reach = max(1, int(3 * sigma))
    w = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    part = slice(reach, reach + len(ratio))
    return np.convolve(ratio, w)[part] / np.convolve(np.ones(len(ratio)), w)[part]


def threshold(values: np.ndarray) -> float:
    """The border of two clusters, ``LEAST`` at least: Lloyd's rounds from the least and the greatest value."""
    lo, hi = float(values.min()), float(values.max())
    for _ in range(20):
        mid = (lo + hi) / 2
        under, over = values[values < mid], values[values >= mid]
        if not len(under) or not len(over) or (under.mean(), over.mean()) == (lo, hi):
            break
        lo, hi = float(under.mean()), float(over.mean())
    return max((lo + hi) / 2, LEAST)


def main_text(html: str, sigma: float = 1.0, border=threshold, weights: tuple[float, float] = (BOILERPLATE, AFAR)) -> str:
    """The main text of one page; '' if there is none. ``border`` gives the threshold of the weighed values."""
    p = Lines()
    p.feed(ended(html))
    p.close()
    lines = [(x, t) for x in p.lines if (t := " ".join("".join(x.text).split()))]
    if not lines:
        return ""
    articles = any(x.article and not x.aside for x, _ in lines)
    weight = np.array([weights[0] if x.aside else weights[1] if articles and not x.article else 1.0 for x, _ in lines])
    smooth = smoothed(np.array([max(0, len(t) - x.linked) / x.tags for x, t in lines], float), sigma)
    weighed = smooth * weight
    least = border(weighed)
    region = [(x.aside, x.article or x.parent) for x, _ in lines]
    content = {r for r, w in zip(region, weighed) if w >= least}
    if not content and articles:  # an article of links alone
        content = {(0, x.article) for x, _ in lines if x.article}
    high: dict[int, float] = {}
    for (x, _), w in zip(lines, weighed):
        high[x.parent] = max(high.get(x.parent, 0.0), w)
    return "\n".join(t for (x, t), r in zip(lines, region) if r in content and (x.parent == r[1] or high[x.parent] >= min(INNER * least, weighed.max())))


def _extracted(batches):
    for b in batches:
        html = b.column(2)
        for x, y in slices(pa.compute.binary_length(html).to_pylist(), 4_000_000):
            out = [main_text(h) for h in html.slice(x, y - x).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).slice(x, y - x), b.column(1).slice(x, y - x), pa.array(out, pa.string()), pa.array(map(len, out), pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of each row of ``pages``.

    Null and empty html give an empty text; nulls in the other columns stay.
    ``br`` is white space inside its block. A comment, declaration or tag that
    never ends takes the rest of the page. Rows stay as they are, repeated or not;
    an empty table gives none; extra columns are not read, whatever their names.
    A page's work is linear in its length, and a task holds about 4 MB of pages at once.
    """
    return pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).mapInArrow(_extracted, "page_id long, url string, text string, n_chars long")
