"""Main text of web pages from streaming parser events.

The standard library's parser sends its events through one pass.  Block elements cut the page into lines; each line has
its characters, its tags and the element it lies in.  The text-to-tag ratios of the lines are smoothed by a Gaussian, and
lines above the smoothed ratios' standard deviation are clustered as content.  The lowest element that holds nearly all
clustered characters is the region, or the article around it.

Elements such as menus, forms and scripts are never content.  Names of class, id and role are evidence only: the lines of
an element whose names speak of notices, adverts or comments count for a fraction of their ratio, and neighbours don't lift
them; its text stays if most of it is clustered nevertheless.  Within the region all other lines stay, however short; where
no article bounds it, what lies before and after its clusters in elements of its own goes.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements that begin a line, that can be a region, that are never content, and that have no end tag.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
REGIONS = frozenset("article main section div td body".split())
NEVER = frozenset("head title script style noscript template nav menu aside footer form button select option textarea input iframe object svg canvas dialog".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words of class, id and role that speak against an element, and words that say nothing beside them.
MARKS = frozenset("ad ads advert adverts advertisement banner sponsor sponsored promo cookie cookies consent notice notices popup modal overlay newsletter subscribe signup nav navbar navigation menu breadcrumb breadcrumbs sidebar related share sharing social comment comments disqus reply replies footer complementary contentinfo search".split())
PLAIN = frozenset("area bar block blocks body box button buttons container content count form group header heading icons inner item items left link links list main outer panel page post posts right row section site slot thread title top unit user widget wrap wrapper".split())
#: Ends of these are implied when a like element begins.
_ALIKE = {"p": frozenset(["p"]), "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "option": frozenset(["option"])}
_CLOSES_P = BLOCKS - {"html", "head", "body", "title", "option"}
#: Share of the clustered characters that the region holds at least: less than the rest is a stray line.
NEARLY_ALL = 0.95
#: By how much evidence lowers a line's ratio.
DOUBT = 64
#: Reach of the smoothing, in lines.
RADIUS = 2
_KERNEL = np.exp(-0.5 * np.arange(-RADIUS, RADIUS + 1) ** 2)
_KERNEL /= _KERNEL.sum()


def doubtful(names: str) -> bool:
    """Whether one of the names, such as cookie-banner, has a word of MARKS and otherwise PLAIN ones and numbers only."""
    for name in names.lower().split():
        words = [w for w in name.replace("_", "-").split("-") if w]
        if not MARKS.isdisjoint(words) and all(w in MARKS or w in PLAIN or w.isdigit() for w in words):
            return True
    return False


def _hidden(attrs: list[tuple[str, str | None]]) -> bool:
    return any(n == "hidden" or n == "aria-hidden" and v == "true" or v and n == "style" and "display:none" in v.replace(" ", "").lower() for n, v in attrs)


@dataclass
class Line:
    """A line of a page: text, tags since the line before, region and doubtful element around it (by number, 0 for none),
    and whether it can't be content."""

    text: str
    tags: int
    region: int
    doubt: int
    dropped: bool


@dataclass
class Open:
    """An open element, and what holds for the lines in it."""

    tag: str
    dropped: bool
    region: int
    doubt: int
    article: bool


class Lines(HTMLParser):
    """Collects the lines of a page, and kind and parent of every region; regions are numbered as they begin."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.kinds, self.parents = ["page"], [0]
        self.doubts = 0
        self.stack = [Open("", False, 0, 0, False)]
        self.count: Counter[str] = Counter()  # of open elements, by tag
        self.text: list[str] = []
        self.tags = 0

    def _line(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            top = self.stack[-1]
            self.lines.append(Line(text, self.tags, top.region, top.doubt, top.dropped))
            self.tags = 0
        self.text.clear()

    def _close(self, at: int) -> None:
        self._line()
        for e in self.stack[at:]:
            self.count[e.tag] -= 1
        del self.stack[at:]

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        if tag in BLOCKS:
            self._line()
            if tag in _CLOSES_P:
                self._implied(frozenset(["p"]) if tag not in _ALIKE else _ALIKE[tag] | {"p"})
        elif tag == "br":
            self.text.append(" ")
        if tag in VOID:
            return
        top = self.stack[-1]
        new = Open(tag, top.dropped, top.region, top.doubt, top.article or tag == "article")
        if tag in REGIONS:
            self.kinds.append(tag)
            self.parents.append(top.region)
            new.region = len(self.kinds) - 1
        if tag in HEADINGS and top.tag == "header" and top.article:
            new.dropped = self.stack[-2].dropped  # the article's own heading
        elif tag in NEVER or tag == "header" or _hidden(attrs):
            new.dropped = True
        if not new.dropped and tag not in ("body", "html") and any(doubtful(v) for n, v in attrs if v and n in ("class", "id", "role")):
            self.doubts += 1
            new.doubt = self.doubts
        if new.dropped != top.dropped or new.doubt != top.doubt:
            self._line()
        self.stack.append(new)
        self.count[tag] += 1

    def _implied(self, alike: frozenset[str]) -> None:
        """Closes an open element of these tags, if only inline elements are open within it."""
        for at in range(len(self.stack) - 1, 0, -1):
            tag = self.stack[at].tag
            if tag in alike:
                self._close(at)
                return
            if tag in BLOCKS:
                return

    def handle_endtag(self, tag):
        self.tags += 1
        if not self.count[tag]:
            return
        for at in range(len(self.stack) - 1, 0, -1):
            own = self.stack[at]
            if own.tag == tag:
                if tag in BLOCKS or tag in NEVER or own.dropped or own.doubt:
                    self._close(at)
                else:
                    del self.stack[at]  # inline elements may be closed in any order
                    self.count[tag] -= 1
                return
            if own.tag in BLOCKS and tag not in BLOCKS:
                return  # a stray end does not reach out of its block

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_data(self, data):
        if self.stack[-1].tag not in ("script", "style"):
            self.text.append(data)

    def parse_marked_section(self, i, report=1):
        return self.parse_bogus_comment(i)

    def ended(self) -> None:
        self.close()
        self._line()


def clustered(lines: list[Line]) -> np.ndarray:
    """Which lines are content: those whose smoothed text-to-tag ratio is above the standard deviation of all lines', and if
    they are in doubt their own ratio is too."""
    doubt = np.array([x.doubt > 0 for x in lines])
    ratio = np.array([len(x.text) / max(1, x.tags) for x in lines]) / np.where(doubt, DOUBT, 1)
    smooth = np.convolve(np.pad(ratio, RADIUS, mode="edge"), _KERNEL, "valid")
    return (smooth > smooth.std()) & (~doubt | (ratio > smooth.std()))


def main_text(html: str | None) -> str:
    """The page's main text, blocks joined by line feeds; empty if there is none."""
    if not html:
        return ""
    page = Lines()
    page.feed(html)
    page.ended()
    if not page.lines:
        return ""
    content = clustered(page.lines).tolist()
    lines = [x for x in page.lines if not x.dropped]
    content = [c for c, x in zip(content, page.lines) if not x.dropped]
    if not any(content):
        content = [not x.doubt for x in lines]
    # Characters of doubtful elements, in all and clustered.
    chars, certain = Counter(), Counter()
    for c, x in zip(content, lines):
        chars[x.doubt] += len(x.text)
        certain[x.doubt] += len(x.text) * c
    kept = [not x.doubt or 2 * certain[x.doubt] > chars[x.doubt] for x in lines]
    # Regions are numbered as they begin, so those within a region follow it; sums go up to the regions around.
    kinds, parents = page.kinds, page.parents
    mass, last = [0] * len(kinds), list(range(len(kinds)))
    for c, k, x in zip(content, kept, lines):
        mass[x.region] += len(x.text) * (c and k)
    for r in range(len(kinds) - 1, 0, -1):
        mass[parents[r]] += mass[r]
        last[parents[r]] = max(last[parents[r]], last[r])
    if not mass[0]:
        return ""
    # Regions that hold most of the content lie within each other, and the lowest began last.
    region = max(r for r in range(len(kinds)) if mass[r] >= NEARLY_ALL * mass[0])
    named, up = 0, region
    while up and not named:
        named, up = up if kinds[up] in ("article", "main") else 0, parents[up]
    region = named or region
    inside = [i for i, x in enumerate(lines) if kept[i] and region <= x.region <= last[region]]
    if not named:  # no element says where content begins and ends: the clusters do
        own = [i for i in inside if content[i]]
        loose = kinds[region] in ("page", "body")
        inside = [i for i in inside if own[0] <= i <= own[-1] or not loose and lines[i].region == region]
    return "\n".join(lines[i].text for i in inside)


def extract(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """keep columns of every row with text, the main text, and n_chars, its code points.

    Null and empty pages have the empty text; repeated rows stay repeated; broken markup is read as far as it makes
    sense.  Columns outside keep do not matter, whatever their names; keep can't hold text or n_chars.  One pass over the
    scan, no shuffle; a task holds one page's lines at a time.
    """
    slim = pages.select(*(F.col(k) for k in keep), F.col(html).alias("__html"))
    schema = slim.drop("__html").schema.add("text", "string").add("n_chars", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(v.as_py()) for v in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=schema.names)

    return slim.mapInArrow(run, schema)
