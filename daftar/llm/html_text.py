"""Main text of web pages: parser events, text-to-tag ratios, Gaussian smoothing, threshold clustering.

The standard library's parser streams events; block tags break the page into
lines, each with its text length, its number of tags and the elements around
it. Lines outside boilerplate elements get a text-to-tag ratio; the ratios are
smoothed with a Gaussian and lines above a share of their standard deviation
form the content cluster. Classes and ids only suggest boilerplate. An element
marked by its layout (header, sidebar, menu ...) or by a state of the page
(comments-open, has-notice) is none if an article is inside, if it holds half of
the cluster, or if it is inside an article and its own ratio is that of the
cluster. One marked as a comment, an advert or a notice, an article among them,
is always boilerplate, unless all articles and nine tenths of the text are inside. The smallest content element
(article, main) that holds most of the cluster's text is the region, with its
sibling elements of the same name; without one, the region is the smallest block
element around the whole cluster, or the page. All lines of the region outside
boilerplate are blocks of the text.

Defined results: null or empty html gives an empty text; html without markup is
one block; a null url stays null; repeated rows are treated one by one; of
content elements with equal shares the innermost, last opened, is taken; very
long or deeply nested pages take time and memory in proportion to their own
length; an empty table stays empty; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import small_batches
from .words import CHUNK, slices

#: Elements that start a new line, hold no content, or are content by name.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
BOILERPLATE = frozenset("aside button canvas datalist dialog footer form head iframe input label menu nav noscript object script select style svg template textarea title".split())
CONTENT = frozenset(("article", "main"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Start tags that end an open element of the same group without its end tag.
CLOSES = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: Words in class, id or role that mark what is never main text, and those that mark a place in the layout.
_NEVER = r"ads?|advert\w*|sponsor\w*|promo\w*|comments?|discussion|disqus|cookies?|consent|notices?|alert|popup|modal|newsletter|subscribe|subscription"
_LAYOUT = r"banner|side-?bar|menu|nav\w*|breadcrumbs?|share|sharing|social|related|recommended|footer|masthead|header|toolbar|widget|pager|pagination|complementary|contentinfo|search"
#: Words that make a mark a state of the page around (comments-open, has-notice), which is weighed like a place in the layout.
STATE = re.compile(r"(?:^|[_-])(?:has|have|with|without|no|not|is|allows?|opened|open|closed|enabled|disabled|on|off|hidden|visible|loaded|shown)(?:$|[_-])", re.I)
NEVER, LAYOUT = (re.compile(rf"(?:^|[\s_-])(?:{x})(?:$|[\s_-])", re.I) for x in (_NEVER, _LAYOUT))
#: Marks of an article's own head, which is part of it.
HEAD = re.compile(r"(?:^|[\s_-])(?:header|masthead)(?:$|[\s_-])", re.I)
#: Width of the Gaussian in lines, and the share of the deviation that a content line exceeds.
SIGMA, THRESHOLD = 1.5, 0.5
#: Share of the page's text that marks of what is never main text cannot remove.
WHOLE = 0.9


@dataclass(slots=True)
class Line:
    text: str
    tags: int
    suspect: int  # number of the innermost marked element around, -1 if none
    inside: int  # number of the innermost content element around, -1 if none


@dataclass(slots=True)
class Suspect:
    """An element whose class, id or role marks boilerplate."""

    parent: int
    never: bool
    within: bool  # inside a content element
    holds: int = 0  # content elements


class Lines(HTMLParser):
    """Lines of a page outside boilerplate elements, with their ratio's parts and surroundings."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.open: list[tuple[str, bool, bool, bool]] = []  # name, whether boilerplate, whether suspect, whether content
        self.of_name: dict[str, list[int]] = {}  # places of each name in ``open``
        self.block_at: list[int] = []  # places of block elements in ``open``
        self.inside: list[int] = []  # numbers of the open content elements
        self.kin: list[tuple[str, int, int]] = []  # of each content element its name, the block around it and the content element around it
        self.blocks: list[list[int]] = []  # of each block element its first line and the line after its last; -1 while open
        self.at: list[int] = []  # beside open: the number of the block, or of the one around
        self.suspects: list[Suspect] = []
        self.doubt: list[int] = []  # numbers of the open suspects
        self.skip = 0
        self.parts: list[str] = []
        self.tags = 0

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split()) if not self.skip else ""
        if text:
            self.lines.append(Line(text, self.tags, self.doubt[-1] if self.doubt else -1, self.inside[-1] if self.inside else -1))
        self.parts, self.tags = [], 0

    def marked(self, attrs) -> bool | None:
        """Whether the marks are of the kind that is never main text; None without marks."""
        words = [w for k, v in attrs if v and k in ("class", "id", "role") for w in v.split()]
        never = [w for w in words if NEVER.search(w)]
        if any(not STATE.search(w) for w in never):
            return True
        layout = [w for w in words if LAYOUT.search(w)]
        if self.inside:
            layout = [w for w in layout if LAYOUT.search(HEAD.sub(" ", w))]
        return False if layout or never else None

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        if tag in BLOCKS:
            # an open p, li ... that is the nearest block ends here
            if (closes := CLOSES.get(tag)) and self.block_at and self.open[self.block_at[-1]][0] in closes:
                self.close_to(self.block_at[-1])
            self.flush()
        elif tag == "br":
            self.parts.append(" ")
        if tag in VOID:
            return
        skip = tag in BOILERPLATE or (tag == "header" and not self.inside)
        never = None if skip or tag in ("html", "body") else self.marked(attrs)
        content = tag in CONTENT and not never
        if content:
            never = None  # the layout of an article is its own
        if (skip or never is not None) and tag not in BLOCKS:
            self.flush()
        around = self.at[-1] if self.at else -1
        self.of_name.setdefault(tag, []).append(len(self.open))
        if tag in BLOCKS:
            self.blocks.append([len(self.lines), -1])
            self.block_at.append(len(self.open))
        self.open.append((tag, skip, never is not None, content))
        self.at.append(len(self.blocks) - 1 if tag in BLOCKS else around)
        self.skip += skip
        if never is not None:
            self.suspects.append(Suspect(self.doubt[-1] if self.doubt else -1, never, bool(self.inside)))
            self.doubt.append(len(self.suspects) - 1)
        if content:
            self.kin.append((tag, around, self.inside[-1] if self.inside else -1))
            self.inside.append(len(self.kin) - 1)
            if self.doubt and not self.skip:
                self.suspects[self.doubt[-1]].holds += 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def close_to(self, k: int) -> None:
        """Close the open elements from place k on."""
        if any(skip or doubt or name in BLOCKS for name, skip, doubt, _ in self.open[k:]):
            self.flush()
        while len(self.open) > k:
            (name, skip, doubt, content), at = self.open.pop(), self.at.pop()
            self.of_name[name].pop()
            self.skip -= skip
            if doubt:
                self.doubt.pop()
            if name in BLOCKS:
                self.blocks[at][1] = len(self.lines)
                self.block_at.pop()
            if content:
                self.inside.pop()

    def handle_endtag(self, tag):
        self.tags += 1
        at = self.of_name.get(tag)
        # an inline end tag does not close the block around it
        if at and (tag in BLOCKS or not self.block_at or self.block_at[-1] < at[-1]):
            self.close_to(at[-1])
        elif tag in BLOCKS:
            self.flush()

    def handle_data(self, data):
        self.parts.append(data)


def smoothed(ratio: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    reach = int(np.ceil(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    kernel /= kernel.sum()
    return np.convolve(np.pad(ratio, reach, mode="edge"), kernel, "valid")


def summed(values: np.ndarray, at: list[int], parents: list[int]) -> np.ndarray:
    """Sums of ``values`` over elements and all inside them; parents have smaller numbers."""
    out = np.bincount(np.array(at, int) + 1, values, minlength=len(parents) + 1)[1:]
    for k in range(len(parents) - 1, -1, -1):
        if parents[k] >= 0:
            out[parents[k]] += out[k]
    return out


def spoiled(suspects: list[Suspect], lines: list[Line], size: np.ndarray, content: np.ndarray, limit: float) -> list[bool]:
    """Which marked elements are boilerplate, by themselves or for what is around them; ``limit`` is the ratio of content."""
    at, parents = [x.suspect for x in lines], [s.parent for s in suspects]
    own, tags, dense = (summed(x, at, parents) for x in (size, np.array([x.tags for x in lines], float), size * content))
    total = (size * content).sum()
    bad: list[bool] = []
    for k, s in enumerate(suspects):
        fine = not s.never and (s.holds > 0 or 2 * dense[k] >= total or (s.within and own[k] >= limit * max(tags[k], 1)))
        bad.append(not fine or (s.parent >= 0 and bad[s.parent]))
    return bad


def main_text(html: str | None) -> str:
    """Blocks of the page's content, joined by empty lines."""
    if not html:
        return ""
    page = Lines()
    page.feed(html)
    page.close()
    page.flush()
    # what is never main text goes before ratios are taken, unless it is the wrapper of the whole page
    parents = [s.parent for s in page.suspects]
    for k in range(len(parents) - 1, -1, -1):
        if parents[k] >= 0:
            page.suspects[parents[k]].holds += page.suspects[k].holds
    own = summed(np.array([len(x.text) for x in page.lines], float), [x.suspect for x in page.lines], parents)
    total = sum(len(x.text) for x in page.lines)
    never: list[bool] = []
    for k, s in enumerate(page.suspects):
        if s.never and s.holds == len(page.kin) and own[k] >= WHOLE * total:
            s.never = False
        never.append(s.never or (s.parent >= 0 and never[s.parent]))
    places = [k for k, x in enumerate(page.lines) if x.suspect < 0 or not never[x.suspect]]
    lines = [page.lines[k] for k in places]
    if not lines:
        return ""
    size = np.array([len(x.text) for x in lines], float)
    score = smoothed(size / np.maximum([x.tags for x in lines], 1))
    limit = THRESHOLD * score.std()
    content = score >= limit
    bad = spoiled(page.suspects, lines, size, content, limit)
    keep = [k for k, x in enumerate(lines) if x.suspect < 0 or not bad[x.suspect]]
    places, lines, size, content = [places[k] for k in keep], [lines[k] for k in keep], size[keep], content[keep]
    if not content.any():
        return "\n\n".join(x.text for x in lines)
    parents = [x[2] for x in page.kin]
    held = summed(size * content, [x.inside for x in lines], parents)
    most = np.flatnonzero(2 * held >= (size * content).sum())
    if len(most):
        region = int(most[-1])  # the last opened of them is the innermost
        kin: list[bool] = []
        for x in page.kin:
            kin.append(x[:2] == page.kin[region][:2] or (x[2] >= 0 and kin[x[2]]))
        blocks = [x.text for x in lines if x.inside >= 0 and kin[x.inside]]
    else:
        # lines that reach the limit by themselves: smoothing lifts short lines beside the cluster
        raw = size / np.maximum([x.tags for x in lines], 1)
        at = np.flatnonzero(content & (raw >= limit)) if (content & (raw >= limit)).any() else np.flatnonzero(content)
        first, last = places[at[0]], places[at[-1]]
        a, b = next(((a, b) for a, b in reversed(page.blocks) if a <= first and (b < 0 or last < b)), (0, -1))
        blocks = [x.text for k, x in zip(places, lines, strict=True) if a <= k and (b < 0 or k < b)]
    return "\n\n".join(blocks)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "html", 4 * CHUNK):
        texts = [main_text(h) for h in part.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of each page; no shuffle."""
    small_batches(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
