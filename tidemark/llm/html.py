"""Main text of web pages by text-to-tag ratio.

The standard library's parser streams events; each block of a page (a paragraph, heading, list item, cell)
becomes one line with its text, its number of tags and its container. The logarithm of the ratio of characters to tags,
which from ``FULL`` on tells nothing more, is smoothed along the lines with a Gaussian and split into two clusters; lines of the high cluster say which containers
hold the article: all ``article`` elements with such lines if most of these stand in them, else ``main``, else the lowest
element that holds all of them. Every line of these belongs to the text, short ones too. Menus, notices, adverts and the
like inside or outside of it are left out by element, role, and names of class and id that consist of such words alone.
A form or an element with such a name or role that holds more than half of the page's text is read all the same, unless
there is an ``article`` or ``main`` with text beside it.

Edge cases: a missing or empty page has the empty text, as has one without any text. Unclosed tags end
with their parent, an unclosed script or comment ends with the page. Missing ids or URLs and repeated
rows are kept, one result row for each page. Other columns play no part. No pages, no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIGMA, RADIUS = 1.0, 3
FULL = 80  # characters a tag from which a line is as much text as any
SLACK = 1.5  # in logarithms: lines so near to the best belong to the high cluster as well
FEED = 1 << 16

# Fixed sets of the markup language.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section "
    "summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
UNREAD = frozenset(
    "button canvas head iframe noscript object script select style svg template textarea title".split()
)
ASIDE = frozenset("aside dialog footer menu nav".split())
FORMS = frozenset("form fieldset".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())
WHOLE = frozenset("html body main".split())
#: What an open element of a kind ends with: the start of one of these.
ENDED_BY = {
    "p": BLOCKS, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"},
    "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option", "optgroup"},
}
#: Words that say where a labelled element stands or what it looks like, and not what it is about.
PLACES = frozenset(
    "area article bar block body bottom box container entry global inner item items left link links list main outer page panel "
    "post posts primary right secondary section site top wrap wrapper".split()
)
#: Words of class and id names.
LABELS = frozenset(
    "ad ads adbox advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist "
    "consent cookie cookies copyright disclaimer discussion disqus footer gdpr hidden masthead menu modal nav navbar "
    "navigation newsletter notice notices notification overlay pager pagination popup promo promoted promotion "
    "recommended related replies responses search share sharing sidebar signup skip social sponsor sponsored "
    "subscribe subscription toolbar topbar widget widgets".split()
)
#: Of these, what readers write, often longer than the article.
OPINIONS = frozenset("comment comments commentlist discussion disqus replies reply responses".split())
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def _labels(attrs: dict[str, str | None]) -> set[str]:
    """Labels in names of class and id that have no other words than labels and places."""
    found = set()
    for name in (attrs.get("class") or "").split() + [attrs.get("id") or ""]:
        parts = [p.lower() for p in re.findall(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+", name)]
        if all(p in LABELS or p in PLACES or p == "header" or p.isdigit() for p in parts):
            found |= {p for p in parts if p not in PLACES}
    return found


class _Lines(HTMLParser):
    """Collects lines (text, tags, characters in links, container) and the tree of containers."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, int, tuple[int, ...]]] = []
        self.outs: list[int] = []  # open elements that are left out if they do not hold most of the text, by number
        self.n_outs = 0
        self.ending = False
        self.parent, self.kind = [-1], ["page"]  # containers by number
        self.open: list[tuple[str, int, int]] = []  # tag, whether it is left out (2: for good), container
        self.count: Counter[str] = Counter()
        self.left_out = self.links = self.tags = self.in_link = 0
        self.header = 0  # inside an article's header, only headings are read
        self.text: list[str] = []

    def _flush(self):
        text = " ".join("".join(self.text).split())
        if text:
            self.lines.append((text, self.tags, min(self.in_link, len(text)), *self._where()))
            self.tags = 0
        self.text, self.in_link = [], 0

    def _where(self) -> tuple[int, tuple[int, ...]]:
        """The container of what is read now, and the elements around it that may be left out."""
        return self.open[-1][2] if self.open else 0, tuple(self.outs)

    def _is_left_out(self, tag: str, attrs: dict[str, str | None]) -> int:
        """0: read, 1: left out if it does not hold most of the text, 2: left out."""
        if tag in UNREAD or tag in ASIDE or "hidden" in attrs or (attrs.get("aria-hidden") or "").lower() == "true":
            return 2
        if _HIDDEN.search(attrs.get("style") or ""):
            return 2
        if tag in FORMS or (attrs.get("role") or "").lower() in ROLES:
            return 1
        if tag in WHOLE:
            return 0
        labels = _labels(attrs)
        if labels & OPINIONS:
            return 2
        if tag == "article":
            return int(bool(labels & {"ad", "sponsored"}))
        if tag == "header" or "header" in labels:
            return 0 if self.count["article"] or self.count["main"] else 2
        return int(bool(labels & LABELS))

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        while self.open and tag in ENDED_BY.get(self.open[-1][0], ()):
            self._pop()
        if tag == "br":
            self.text.append(" ")
        if tag in VOID:
            if tag in BLOCKS:
                self._flush()
            return
        if tag == "a":
            self.links += 1
        attrs = dict(attrs)
        out = self._is_left_out(tag, attrs)
        if tag in BLOCKS or out:
            self._flush()
            at = self.open[-1][2] if self.open else 0
            if tag in BLOCKS and tag not in ("p", "li") and tag not in HEADINGS:
                self.parent.append(at)
                self.kind.append(tag)
                at = len(self.kind) - 1
            self.open.append((tag, out, at))
            self.count[tag] += 1
            self.left_out += out == 2
            if out == 1:
                self.outs.append(self.n_outs)
                self.n_outs += 1
            self.header += tag == "header"

    # What is never closed reaches to the end of the page, and is not searched for again and again.

    def parse_comment(self, i, report=True):
        if self.rawdata.find("-->", i) < 0:
            return len(self.rawdata) if self.ending else -1
        return super().parse_comment(i, report)

    def parse_starttag(self, i):
        if self.rawdata.find(">", i) < 0:
            return len(self.rawdata) if self.ending else -1
        return super().parse_starttag(i)

    def close(self):
        self.ending = True
        super().close()
        self._flush()

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)  # a slash closes nothing but void elements

    def _pop(self):
        self._flush()
        tag, out, _ = self.open.pop()
        self.count[tag] -= 1
        self.left_out -= out == 2
        if out == 1:
            self.outs.pop()
        self.header -= tag == "header"

    def handle_endtag(self, tag):
        self.tags += 1
        if tag == "a":
            self.links = max(0, self.links - 1)
        if self.count[tag]:
            while self.open[-1][0] != tag:
                self._pop()
            self._pop()
        elif tag in BLOCKS:
            self._flush()

    def handle_data(self, data):
        if self.left_out or (self.header and not any(self.count[h] for h in HEADINGS)):
            return
        self.text.append(data)
        if self.links:
            self.in_link += len(data)


def lines_of(html: str) -> _Lines:
    parser = _Lines()
    for at in range(0, len(html), FEED):
        parser.feed(html[at : at + FEED])
    parser.close()
    return parser


def smoothed(ratios: np.ndarray, sigma: float = SIGMA, radius: int = RADIUS) -> np.ndarray:
    """Gaussian smoothing; at the ends the weights inside the page are scaled to 1."""
    kernel = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    weight = np.convolve(np.ones(len(ratios)), kernel)[radius : radius + len(ratios)]
    return np.convolve(ratios, kernel)[radius : radius + len(ratios)] / weight


def high_cluster(values: np.ndarray) -> np.ndarray:
    """Which values lie nearer to the higher of two means; all of them where there is but one value."""
    low, high = float(values.min()), float(values.max())
    for _ in range(50):
        cut = (low + high) / 2
        top = values >= cut
        if top.all():
            break
        new = float(values[~top].mean()), float(values[top].mean())
        if new == (low, high):
            break
        low, high = new
    return values >= (low + high) / 2


def _read(page: _Lines) -> list[tuple[str, int, int, int]]:
    """Lines that are in no element that is left out. Where none of them stands in an ``article`` or ``main``, an element that
    holds more than half of the text is not left out."""
    plain = [line for line in page.lines if not line[4]]
    named = {i for i, kind in enumerate(page.kind) if kind in ("article", "main")}
    if not any(line[3] in named or _inside(page.parent, line[3], named) for line in plain):
        chars = np.zeros(page.n_outs, np.int64)
        for text, *_, outs in page.lines:
            chars[list(outs)] += len(text)
        most = sum(len(line[0]) for line in page.lines) / 2
        plain = [line for line in page.lines if not any(chars[k] <= most for k in line[4])]
    return [tuple(line[:4]) for line in plain]


def main_text(html: str | None) -> str:
    """The article of a page, one line a block."""
    if not html:
        return ""
    page = lines_of(html)
    lines = _read(page)
    if not lines:
        return ""
    texts, tags, links, where = zip(*lines)
    size, where = np.array([len(t) for t in texts], float), np.array(where)
    ratio = (size - np.array(links)) / np.maximum(np.array(tags), 1)
    value = smoothed(np.log1p(np.minimum(ratio, FULL)))
    high = high_cluster(value) | (value >= value.max() - SLACK)
    # characters of high lines below each container; parents come before their children
    weight = np.zeros(len(page.kind))
    np.add.at(weight, where, np.where(high, size, 0.0))
    own = weight.copy()
    for at in range(len(page.kind) - 1, 0, -1):
        weight[page.parent[at]] += weight[at]
    chosen: list[int] = []
    for tag in ("article", "main"):
        found = [i for i, kind in enumerate(page.kind) if kind == tag and weight[i] > 0]
        around = set(found)
        found = [i for i in found if not _inside(page.parent, i, around)]
        if 2 * sum(weight[i] for i in found) > weight[0]:
            chosen = found
            break
    if not chosen:
        best, children = 0, {}
        for at in range(1, len(page.kind)):
            children.setdefault(page.parent[at], []).append(at)
        # as deep as all of the high lines go together
        while own[best] == 0 and (deeper := [i for i in children.get(best, ()) if weight[i] > 0]) and len(deeper) == 1:
            best = deeper[0]
        chosen = [best]
    inside = np.zeros(len(page.kind), bool)
    inside[chosen] = True
    for at in range(1, len(page.kind)):
        inside[at] = inside[at] or inside[page.parent[at]]
    return "\n".join(t for t, k in zip(texts, inside[where]) if k)


def _inside(parent: list[int], at: int, around: set[int]) -> bool:
    """Whether a container stands in one of ``around``."""
    while (at := parent[at]) >= 0:
        if at in around:
            return True
    return False


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``id_col``, ``url_col``, text and n_chars (code points, long) of every page."""
    plain = pages.select(F.col(id_col).alias("c0"), F.col(url_col).alias("c1"), F.col(html_col).alias("c2"))
    fields = plain.schema.fields

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                ["c0", "c1", "text", "n_chars"],
            )

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields[:2])
    return plain.mapInArrow(run, f"{kinds}, text string, n_chars long").toDF(id_col, url_col, "text", "n_chars")
