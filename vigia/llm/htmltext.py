"""HTML extraction: parser events, text-to-tag ratios per line, Gaussian smoothing, threshold clusters."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import slices

#: Fixed tables of HTML: elements that end a block, that never hold article text, and that have no end tag.
BLOCKS = frozenset("address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
DROPPED = frozenset("aside button datalist footer form head iframe input label menu nav noscript object script select style svg template textarea title".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Elements that can be a content region, those that hold one article, and headings.
REGIONS = frozenset("article body div main section td".split())
ARTICLES = frozenset(("article", "main"))
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: Fixed names.  An element is page furniture if a class, id or role name is one of FURNITURE, or begins or ends with one as a part of its own;
#: elements with a name of TOOLS only if they hold links or no sentence.  Names of states say nothing.
FURNITURE = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments complementary contentinfo cookie cookies disqus footer gdpr masthead menu nav navbar navigation newsletter notice notices"
    " pagination pop-up popup promo recommended related replies respond sidebar side-bar sponsored subscribe tag-cloud".split()
)
TOOLS = frozenset("header page-header search share share-buttons sharing skip-link social social-links social-share toolbar top-bar widget widgets".split())
STATES = ("has-", "is-", "no-", "not-", "show-", "hide-", "with-", "without-")
#: Why an element may be furniture: by a whole name, by a part of one (or its tag), as a tool.
WHOLE, PART, TOOL = 1, 2, 3
#: Smoothing radius in lines; characters a tag from which a line is full text; factor between the two levels of a page with two.
SIGMA, FULL, APART = 1.0, 100.0, 3.0
#: Share of the text of all cluster lines that the core of the content holds; what lies beside it is judged line by line.
SHARE = 0.9
#: Of a line, or of an element: share of characters in links from which it is a list of links, and from which an element with a tool's name is one.
LINKED, LINKED_TOOL = 0.5, 0.34
#: Words from which a line without a full stop is a sentence too.
SENTENCE = 10

_SPACES = re.compile(r"\s+")
_STOPS = (".", "!", "?", "…", ":", '."', ".”")
_INLINE = frozenset("p b i a span em strong".split())
_LISTS = frozenset(("ul", "ol", "menu"))


def _names(attrs: list[tuple[str, str | None]]) -> set[str]:
    names = {name for key, value in attrs if key in ("class", "id", "role") and value for name in value.lower().replace("_", "-").split()}
    return {name for name in names if not name.startswith(STATES)}


def _suspicion(tag: str, attrs: list[tuple[str, str | None]], in_article: bool) -> int:
    """WHOLE, PART or TOOL if the element may be page furniture, else 0.  A header is the page's, or an article's own."""
    if tag in ("html", "body", "main"):
        return 0
    names = _names(attrs)
    if not FURNITURE.isdisjoint(names):
        return WHOLE
    if any(name.startswith(tuple(f"{x}-" for x in FURNITURE)) or name.endswith(tuple(f"-{x}" for x in FURNITURE)) for name in names if "-" in name):
        return PART
    if tag == "form" or (tag == "header" and not in_article):
        return PART
    return TOOL if not TOOLS.isdisjoint(names) and tag != "header" else 0


def _hides(tag: str, attrs: list[tuple[str, str | None]]) -> bool:
    """Whether nothing in the element is text of the page."""
    if tag in ("html", "body", *ARTICLES, "form"):
        return False
    return tag in DROPPED or any(name == "hidden" or (name == "aria-hidden" and value == "true") for name, value in attrs)


@dataclass
class Line:
    """One block's text, the tags since the line before, the region and the suspect it stands in, if it is a heading, and its characters in links."""

    text: str
    tags: int
    region: int
    heading: bool
    suspect: int = -1
    linked: int = 0


@dataclass
class Region:
    """An element that can be the content region: the one around it, its tag and class, and its outermost article and main element."""

    parent: int
    kind: tuple[str, str]
    article: int = -1
    main: int = -1


@dataclass
class Suspect:
    """An element that may be furniture: the suspect around it, why, its tag, and if it holds an article."""

    parent: int
    why: int
    tag: str
    article: bool = False


@dataclass
class _Open:
    tag: str
    hides: bool
    article: bool
    region: int
    suspect: int


class _Lines(HTMLParser):
    """Turns parser events into lines, regions and suspects; what an open tag asks of the stack is kept as counts and places, never walked for."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.regions = [Region(-1, ("", ""))]
        self.suspects: list[Suspect] = []
        self.open: list[_Open] = []
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []
        self.barriers: list[int] = []
        self.text: list[str] = []
        self.tags = self.hidden = self.articles = self.linked = 0

    def end_line(self) -> None:
        text = _SPACES.sub(" ", "".join(self.text)).strip()
        if text and not self.hidden:
            top = self.open[-1] if self.open else None
            self.lines.append(Line(text, self.tags, top.region if top else 0, any(x.tag in HEADINGS for x in self.open[-3:]), top.suspect if top else -1, min(self.linked, len(text))))
        if text:
            self.tags = 0
        self.text, self.linked = [], 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        article = tag in ARTICLES or (tag == "div" and ("role", "main") in attrs)
        hides, why = _hides(tag, attrs), _suspicion(tag, attrs, self.articles > 0)
        if tag in BLOCKS or hides or why or article:
            self.end_line()
        self.tags += 1
        if tag in VOID:
            return
        if tag == "p":
            self.close("p", self.blocks)
        if tag == "li":
            self.close("li", [max((self.places[x][-1] for x in _LISTS if self.places.get(x)), default=-1)])
        around = self.open[-1] if self.open else None
        region, suspect = (around.region, around.suspect) if around else (0, -1)
        if why:
            self.suspects.append(Suspect(suspect, why, tag))
            suspect = len(self.suspects) - 1
        elif article:
            held = suspect
            while held >= 0 and not self.suspects[held].article:  # marked once each
                self.suspects[held].article = True
                held = self.suspects[held].parent
        if tag in REGIONS or article:
            own, new = self.regions[region], len(self.regions)
            outer = own.article if own.article >= 0 else new if tag == "article" and not why else -1
            main = own.main if own.main >= 0 else new if article and tag != "article" else -1
            self.regions.append(Region(region, (tag, dict(attrs).get("class") or ""), outer, main))
            region = new
        at = len(self.open)
        self.open.append(_Open(tag, hides, article, region, suspect))
        self.places.setdefault(tag, []).append(at)
        if tag in BLOCKS:
            self.blocks.append(at)
        if article or hides or why:
            self.barriers.append(at)
        self.hidden += hides
        self.articles += article

    def close(self, tag: str, stops: list[int] | None = None) -> None:
        """Close the innermost open ``tag`` and what is open in it, unless an element of ``stops`` (or, for text tags, an article or a dropped one) lies between."""
        held = self.places.get(tag)
        if not held:
            return
        at = held[-1]
        if any(x and x[-1] > at for x in (stops or [], self.barriers if tag in _INLINE or stops is not None else [])):
            return
        while len(self.open) > at:
            x = self.open.pop()
            k = len(self.open)
            self.places[x.tag].pop()
            for kept in (self.blocks, self.barriers):
                if kept and kept[-1] == k:
                    kept.pop()
            self.hidden -= x.hides
            self.articles -= x.article

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS or tag in DROPPED or tag in ARTICLES:
            self.end_line()
        self.tags += 1
        self.close(tag)

    def handle_data(self, data: str) -> None:
        self.text.append(data)
        if self.places.get("a"):
            self.linked += len(data)

    def finish(self) -> list[Line]:
        """The lines that stand in no furniture."""
        super().close()
        self.end_line()
        return _without_furniture(self.lines, self.suspects)


def _without_furniture(lines: list[Line], suspects: list[Suspect]) -> list[Line]:
    """Lines outside the suspects that are furniture.

    A suspect with an article in it is none; one by part of a name, a form or a header is none if it holds over half of the page's
    text; a tool, unless it holds links for a third of its text or more, is none if a sentence stands in it or it is a paragraph, heading or cell.
    """
    if not suspects:
        return lines
    chars, linked, sentence = [0] * len(suspects), [0] * len(suspects), [False] * len(suspects)
    for x in lines:
        if x.suspect >= 0:
            chars[x.suspect] += len(x.text)
            linked[x.suspect] += x.linked
            sentence[x.suspect] = sentence[x.suspect] or x.text.endswith(_STOPS) or x.text.count(" ") >= SENTENCE - 1
    for k in range(len(suspects) - 1, -1, -1):
        if (up := suspects[k].parent) >= 0:
            chars[up] += chars[k]
            linked[up] += linked[k]
            sentence[up] = sentence[up] or sentence[k]
    total, gone = sum(len(x.text) for x in lines), []
    for k, x in enumerate(suspects):  # a suspect comes after the one around it
        if x.why == TOOL:
            furniture = linked[k] >= LINKED_TOOL * max(1, chars[k]) or not (sentence[k] or x.tag in HEADINGS or x.tag in ("p", "td", "li", "span"))
        else:
            furniture = x.why == WHOLE or chars[k] <= total / 2
        gone.append((furniture and not x.article) or (x.parent >= 0 and gone[x.parent]))
    return [x for x in lines if x.suspect < 0 or not gone[x.suspect]]


def smooth(values: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing; at the ends the kernel is cut and weighed anew."""
    reach = max(1, int(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    full = lambda x: np.convolve(x, kernel)[reach : reach + len(x)]
    return full(values) / full(np.ones(len(values)))


def cluster_lines(lines: list[Line]) -> np.ndarray:
    """Which lines lie in a content cluster.

    A line's ratio is its characters over its tags, FULL at most, so that one very long line sets no level.  The logarithms of the
    smoothed ratios are cut where the two parts are furthest apart in variance; parts whose levels differ by less
    than APART are one, and all lines are content.
    """
    ratio = np.log(smooth(np.array([min(FULL, len(x.text) / max(1, x.tags)) for x in lines])))
    level = np.sort(ratio)
    n = np.arange(1, len(level))
    low = np.cumsum(level)[:-1]
    high = level.sum() - low
    gap = high / (len(level) - n) - low / n
    if not len(n):
        return np.ones(len(lines), dtype=bool)
    best = int(np.argmax(gap**2 * n * (len(level) - n)))
    return ratio > level[best] if gap[best] >= np.log(APART) else np.ones(len(lines), dtype=bool)


def content_lines(lines: list[Line], regions: list[Region]) -> list[str]:
    """The lines of the content.

    Articles that hold half of the cluster lines' text or more are the content, with the lines beside them in their main element that
    are no links.  On other pages its core is the innermost element that holds SHARE of the text of the cluster lines; it grows
    to elements around it that add headings only, and elements of the same class beside it are core too.  Every line of the core
    is kept, so that short lines stay with the long ones; beside it, cluster lines that are no links are kept.
    """
    if not lines:
        return []
    inside = cluster_lines(lines).tolist()
    linked = [x.linked >= LINKED * len(x.text) for x in lines]
    mass, story = np.zeros(len(regions)), 0
    for line, content, links in zip(lines, inside, linked, strict=True):
        mass[line.region] += len(line.text) * content
        story += len(line.text) * (content and not links and regions[line.region].article >= 0)
    if story and 2 * story >= mass.sum():
        mains = {regions[x.region].main for x in lines if regions[x.region].article >= 0} - {-1}
        return [x.text for x, links in zip(lines, linked, strict=True) if regions[x.region].article >= 0 or (regions[x.region].main in mains and not links)]
    plain = np.zeros(len(regions))  # lines that are no headings
    for line in lines:
        plain[line.region] += not line.heading
    for k in range(len(regions) - 1, 0, -1):
        mass[regions[k].parent] += mass[k]
        plain[regions[k].parent] += plain[k]
    at = 0
    for k in range(1, len(regions)):  # an element comes after the one around it
        if regions[k].parent == at and mass[k] >= SHARE * mass[0]:
            at = k
    if regions[at].main >= 0:
        at = regions[at].main
    while at and plain[regions[at].parent] == plain[at]:
        at = regions[at].parent
    kind, around = regions[at].kind, regions[at].parent
    alike = [k == at or (at > 0 and regions[k].parent == around and regions[k].kind[0] == kind[0] and (kind[0] == "article" or (kind[1] != "" and regions[k].kind[1] == kind[1]))) for k in range(len(regions))]
    for k in range(1, len(regions)):
        alike[k] = alike[k] or alike[regions[k].parent]
    return [x.text for x, content, links in zip(lines, inside, linked, strict=True) if alike[x.region] or (content and not links)]


def extract(html: str) -> str:
    parser = _Lines()
    parser.feed(html)
    return "\n".join(content_lines(parser.finish(), parser.regions))


def extract_text(pages: DataFrame) -> DataFrame:
    """Main text of every page: ``page_id, url, text, n_chars``.

    Blocks in page order, joined by one newline; character references decoded, white space in a block made one space.
    Null and empty html, and pages without content, give empty text and 0; broken markup is read as far as
    it goes; repeated rows and null ids are kept as they are; other columns are ignored; no rows give no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _, _ in slices(batches, "html"):
            texts = [extract(h.as_py() or "") for h in part.column("html")]
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
