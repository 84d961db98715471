"""HTML extraction: parser events, text-to-tag ratios, Gaussian smoothing, threshold clustering of content regions.

The standard library's parser streams a page's events.  Each text block is a line with its text and the number of tags
since the line before.  Text inside boilerplate elements (menus, forms, scripts, ..., by tag, role and class name), blocks
or not, is set aside.  The other lines' text-to-tag ratios are smoothed with a Gaussian; lines above the threshold are
content.  The regions are the clusters of content lines, and ``article`` and ``main`` elements that hold content lines
are regions of their own; they compete by the text of their content lines.  A cluster outside such elements stays with
``SHARE`` of the largest one's; teaser cards (small articles, by name or several with short lines) go where another
region has twice their text.  All blocks of a region are returned, short ones too, but for those in an element whose name only hints
at boilerplate: such an element stays if one of its lines is content.

*Names.* A class or id names boilerplate if its words are such words (``cookie-banner``) or parts of a page
(``sidebar-left``); one with other words besides (``notice-of-tender``, ``share-price``) is a hint.

*Clusters.* Content lines with at most ``GAP`` others between them, or in the same element, are a cluster, with all lines
between them.  Its region is the innermost element around its content lines, or one around it whose own ratio of text to tags
reaches the threshold.  If that holds all text of the page, boilerplate
included, it tells nothing: then the region goes on, before and after, with neighbours of content lines in their own elements, with lines at
most ``GAP`` away, and with the rest of an element so begun.

*Forms and comments.* A form goes, unless it is the page's layout: it holds most of the page's text and also its headings,
menus or articles, or all there is.  Then its controls and labels go.  An element with a word for comments in its name,
whatever stands beside it, goes unless it holds most of the text.  Markup that the page doesn't finish is no text.

Defined cases: null or empty html and pages without text give an empty text; broken nesting is repaired as browsers
do for paragraphs and list items; repeated rows are kept; columns named ``text`` and ``n_chars`` are replaced, other
columns pass through; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements of HTML by role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
CLOSES_P = BLOCKS - {"html", "head", "body", "title", "option", "optgroup"}
BOILERPLATE_TAGS = frozenset("head script style noscript template nav footer aside button select textarea iframe object svg canvas audio video dialog menu math applet".split())
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
BOILERPLATE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner promo promotion sponsor sponsored cookie cookies consent gdpr notice notices alert alerts newsletter subscribe popup modal overlay menu menus nav navbar navigation breadcrumb breadcrumbs sidebar sidenav aside footer comment comments replies reply respond discussion disqus share sharing social related recommended widget widgets toolbar pagination pager login signup search skip masthead topbar".split()
)
#: Words that say where or what kind of a part something is, beside a boilerplate word in a name.
PART_WORDS = frozenset(
    "area bar block body bottom box btn button buttons center column container content desktop fixed float global group header holder icon icons inner item items label layer left link links list main mobile module outer page panel position primary right row secondary section side site slot sticky strip text title top unit wrap wrapper zone".split()
)
#: Names with one of these words tell of a layout, not of a part.
LAYOUT_WORDS = frozenset("no not has have with without is".split())
#: Names that make even an ``article`` or ``main`` boilerplate.
REGION_WORDS = frozenset("comment comments ad advert related".split())
#: Names with one of these words are of reader comments, whatever other words they have.
COMMENT_WORDS = frozenset("comment comments replies reply disqus".split())
#: Names of articles that stand for others.
CARD_WORDS = frozenset("card cards teaser teasers tile tiles preview excerpt".split())
#: Parts of a form that are no text of a page, and parts of a page that a form has only if it is the layout.
FORM_PARTS = frozenset("label legend option optgroup datalist output".split())
PAGE_PARTS = frozenset("article main nav header footer h1".split())
UNSEEN = frozenset("script style noscript template".split())
REGIONS = frozenset({"article", "main"})
SIGMA = 1.5
#: Lines below the threshold that may lie between two content lines of one cluster, whatever elements they are in.
GAP = 5
#: Part of the largest region's text that a cluster outside ``article`` and ``main`` must have.
SHARE = 0.25
#: Lines of a teaser card, at most.
CARD_LINES = 3
#: Block elements nested deeper are taken as neighbours, as browsers do.
DEPTH = 512
_OTHER_BLOCKS = BLOCKS - {"p"}


@lru_cache(4096)
def named(names: str) -> tuple[bool, bool, bool, bool, bool]:
    """Of class names and an id: whether one names boilerplate, boilerplate of a region, hints at boilerplate, names comments among others, or a card."""
    whole = region = hint = comment = card = False
    for name in names.split():
        words = set(re.findall(r"[a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", name).lower()))
        card |= bool(words & CARD_WORDS)
        found = words & BOILERPLATE_WORDS
        if not found or words & LAYOUT_WORDS:
            continue
        if words <= BOILERPLATE_WORDS | PART_WORDS:
            whole, region = True, region or bool(found & REGION_WORDS)
        elif found & COMMENT_WORDS:
            comment = True
        else:
            hint = True
    return whole, region, hint, comment, card


class Place(NamedTuple):
    """Where text stands: whether in boilerplate, and the region, block element, hinted element, form and element of comments around it (0: none)."""

    bad: bool = False
    region: int = 0
    element: int = 0
    hint: int = 0
    form: int = 0
    comment: int = 0


class Line(NamedTuple):
    text: str
    tags: int
    place: Place


class _Lines(HTMLParser):
    """Blocks of a page: text without boilerplate, tags before it, and where it stands.

    The stack is indexed by tag, so an end tag finds its element at once however deep the nesting is.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, Place]] = []
        self.open: dict[str, list[int]] = defaultdict(list)  # places in the stack by tag
        self.open_blocks: list[int] = []  # but paragraphs
        self.parents, self.depths = [0], [0]  # of each block element; the first is the page
        self.pieces: list[str] = []
        self.aside = False  # boilerplate text since the last line
        self.aside_in: set[int] = set()  # block elements of boilerplate text, but for the head's
        self.tags = self.hinted = self.forms = self.comments = 0
        self.regions: list[tuple[str, bool]] = [("", False)]  # tag of each, and whether its name is of a card
        self.layouts: set[int] = set()  # forms with parts of a page
        self.lines: list[Line] = []

    def here(self) -> Place:
        return self.stack[-1][1] if self.stack else Place()

    def flush(self) -> None:
        text = " ".join("".join(self.pieces).split())
        if text:
            self.lines.append(Line(text, max(self.tags, 1), self.here()))
        if text or self.aside:
            self.tags = 0
        self.pieces, self.aside = [], False

    def finish(self) -> list[Line]:
        """The lines, without those of forms that are no layout and of comments that are not the page's text."""
        if re.match(r"<[a-zA-Z!/?]", self.rawdata):  # markup without an end
            self.rawdata = ""
        self.close()
        self.flush()
        for kind in ("form", "comment"):
            mass, whole = Counter(), sum(len(line.text) for line in self.lines)
            for line in self.lines:
                mass[getattr(line.place, kind)] += len(line.text)
            gone = {k for k, n in mass.items() if k and not (2 * n > whole and (kind == "comment" or k in self.layouts or n == whole))}
            self.aside_in.update(line.place.element for line in self.lines if getattr(line.place, kind) in gone)
            self.lines = [line for line in self.lines if getattr(line.place, kind) not in gone]
        return self.lines

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag == "br":
            self.pieces.append(" ")
            return
        if tag in BLOCKS:
            self.flush()
            if tag in CLOSES_P and self.open["p"] and (not self.open_blocks or self.open["p"][-1] > self.open_blocks[-1]):
                self.cut(self.open["p"][-1])
            if tag == "li":
                self.close_open(("li",), ("ul", "ol", "menu"))
            elif tag in ("dt", "dd"):
                self.close_open(("dt", "dd"), ("dl",))
            elif tag in ("td", "th"):
                self.close_open(("td", "th"), ("table",))
            elif tag == "tr":
                self.close_open(("td", "th", "tr"), ("table",))
            elif tag == "body":
                self.close_open(("head",), ())
        if tag in VOID:
            return
        around = self.here()
        bad, region, element, hint, form, comment = around
        own, hints, comments, card = self.boilerplate(tag, dict(attrs), around)
        if tag in BLOCKS and tag not in ("html", "body"):
            if self.depths[element] >= DEPTH:
                element = self.parents[element]
            self.parents.append(element)
            self.depths.append(self.depths[element] + 1)
            element = len(self.parents) - 1
        if form and tag in PAGE_PARTS:
            self.layouts.add(form)
        if tag in REGIONS and not bad and not region:
            region = len(self.regions)
            self.regions.append((tag, card))
        if hints and not hint:
            self.hinted += 1
            hint = self.hinted
        if tag == "form" and not form:
            self.forms += 1
            form = self.forms
        if comments and not comment:
            self.comments += 1
            comment = self.comments
        self.open[tag].append(len(self.stack))
        if tag in _OTHER_BLOCKS:
            self.open_blocks.append(len(self.stack))
        self.stack.append((tag, Place(bad or own, region, element, hint, form, comment)))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # a slash closes void elements only

    def boilerplate(self, tag: str, attrs: dict[str, str | None], around: Place) -> tuple[bool, bool, bool, bool]:
        """Whether an element is boilerplate by itself, whether its name hints at it, speaks of comments, or is a card's."""
        if tag in ("html", "body"):
            return False, False, False, False
        names = f"{attrs.get('class') or ''} {attrs.get('id') or ''}"
        whole, of_region, hint, comment, card = named(names) if names != " " else (False, False, False, False, False)
        if tag in REGIONS:
            whole, hint, comment = of_region, False, comment and tag != "main"
        hidden = "hidden" in attrs or attrs.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", attrs.get("style") or "") is not None
        own = tag in BOILERPLATE_TAGS or (tag == "header" and not around.region) or (around.form and tag in FORM_PARTS) or (attrs.get("role") or "").lower() in BOILERPLATE_ROLES or hidden or whole
        return bool(own), hint, comment, card

    def cut(self, place: int) -> None:
        """Close the element at a place in the stack and all inside it."""
        while len(self.stack) > place:
            tag = self.stack.pop()[0]
            self.open[tag].pop()
            if tag in _OTHER_BLOCKS:
                self.open_blocks.pop()

    def close_open(self, tags: tuple[str, ...], within: tuple[str, ...]) -> None:
        """Close the innermost open one of ``tags``, unless one of ``within`` is opened inside it."""
        place = max((self.open[t][-1] for t in tags if self.open[t]), default=-1)
        if place > max((self.open[t][-1] for t in within if self.open[t]), default=-1):
            self.cut(place)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in BLOCKS:
            self.flush()
        if tag in VOID or not self.open[tag]:
            return
        place = self.open[tag][-1]
        innermost = max(self.open_blocks[-1] if self.open_blocks else -1, self.open["p"][-1] if self.open["p"] else -1)
        if tag in BLOCKS or place > innermost:  # an inline end tag doesn't close blocks
            self.cut(place)

    def handle_data(self, data: str) -> None:
        here = self.here()
        if not here.bad:
            self.pieces.append(data)
        elif data.strip():
            self.aside = True
            if not self.open["head"]:
                self.aside_in.add(here.element)
            if self.stack[-1][0] not in UNSEEN:  # a button or an advert parts the words around it
                self.pieces.append(" ")


def smoothed(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian mean over neighbouring lines."""
    radius = max(1, int(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    weight = np.convolve(np.ones(len(ratios)), kernel)[radius : radius + len(ratios)]
    return np.convolve(ratios, kernel)[radius : radius + len(ratios)] / weight


def clustered(lines: list[Line], content: list[int], parents: list[int], aside: set[int], threshold: float) -> list[np.ndarray]:
    """The places of the lines of each cluster's region; ``parents``: of each element, a lesser number, ``aside``: elements of
    boilerplate text.

    Elements are numbered as they open, so an element holds those from its own number to that of its last descendant.
    """
    last = list(range(len(parents)))
    for e in range(len(parents) - 1, 0, -1):
        last[parents[e]] = max(last[parents[e]], last[e])

    def around(low: int, high: int) -> int:
        """The innermost element that holds both, and so all between."""
        while last[low] < high:
            low = parents[low]
        return low

    elements = [line.place.element for line in lines]
    number = np.array(elements)
    length = np.r_[0, np.cumsum(np.bincount(number, [len(line.text) for line in lines], len(parents)))]
    tags = np.r_[0, np.cumsum(np.bincount(number, [line.tags for line in lines], len(parents)))]
    outer = [parents[e] for e in elements]
    everywhere = {*outer, *(parents[e] for e in aside)}
    page = around(min(everywhere), max(everywhere))
    clusters: list[list[int]] = []
    found: list[np.ndarray] = []
    taken = np.zeros(len(elements), bool)
    order = np.argsort(number, kind="stable")
    ranked = number[order]
    regions: set[int] = set()
    for i in content:
        if clusters and (i - clusters[-1][-1] <= GAP + 1 or outer[i] == outer[clusters[-1][-1]]):
            clusters[-1].append(i)
        else:
            clusters.append([i])
    for cluster in clusters:
        own = {outer[i] for i in cluster}
        region = around(min(own), max(own))
        while region != page and (up := parents[region]) != page and length[last[up] + 1] - length[up] >= threshold * (tags[last[up] + 1] - tags[up]):
            region = up
        spans = np.arange(cluster[0], cluster[-1] + 1)
        if region != page:
            inside = order[np.searchsorted(ranked, region) : np.searchsorted(ranked, last[region], "right")]
            spans = np.union1d(spans, inside) if region not in regions else spans
            regions.add(region)
        else:
            before, after = [], []
            for end, step, more in ((cluster[0], -1, before), (cluster[-1], 1, after)):
                j = end + step
                while 0 <= j < len(elements) and not taken[j] and (outer[j] in own or abs(j - end) <= GAP or (outer[j] == outer[j - step] != page)):
                    more.append(j)
                    j += step
            spans = np.array([*before[::-1], *spans, *after])
        taken[spans] = True
        found.append(spans)
    return found


def main_text(html: str | None) -> str:
    """Main text of a page, a line per block."""
    parser = _Lines()
    parser.feed(html or "")
    lines = parser.finish()
    if not lines:
        return ""
    length = np.array([len(line.text) for line in lines])
    own = length / np.array([line.tags for line in lines])
    ratio = smoothed(own)
    threshold = min(ratio.std() or ratio.mean(), ratio.mean())
    content = ratio >= threshold
    region = np.array([line.place.region for line in lines])
    # A line that only its neighbours lift stays, but founds no cluster and settles no hint.
    founders = content & (own >= threshold)
    hint = np.array([line.place.hint for line in lines])
    clusters = clustered(lines, np.flatnonzero(founders & (region == 0)).tolist(), parser.parents, parser.aside_in, threshold)
    if region.any():
        keep = chosen(region, content, length, clusters, parser.regions)
    else:
        keep = content.copy()
        for places in clusters:
            keep[places] = True
    keep &= (hint == 0) | np.isin(hint, hint[founders])
    return "\n".join(line.text for line, k in zip(lines, keep.tolist(), strict=True) if k)


def chosen(region: np.ndarray, content: np.ndarray, length: np.ndarray, clusters: list[np.ndarray], regions: list[tuple[str, bool]]) -> np.ndarray:
    """Which lines stay on a page with ``article`` or ``main`` elements: those compete with the clusters outside of them."""
    text = np.where(content, length, 0)
    mass, lines = np.bincount(region, text, len(regions)), np.bincount(region, minlength=len(regions))
    voted = [r for r in np.unique(region[content]).tolist() if r]
    if not voted and not clusters:
        return region > 0
    outside = [places[region[places] == 0] for places in clusters]
    masses = [int(text[places].sum()) for places in outside]
    small = {r for r, (tag, _) in enumerate(regions) if tag == "article" and 0 < lines[r] <= CARD_LINES}
    others = content & ~np.isin(region, list(small))
    usual = length[others].mean() if others.any() else 0
    longest = np.zeros(len(regions), np.int64)
    np.maximum.at(longest, region, length)
    cards = {r for r in small if regions[r][1] or (len(small) > 1 and 2 * longest[r] < usual)}
    largest = max([*(mass[r] for r in voted if r not in cards), *masses], default=0)
    kept = [r for r in voted if r not in cards or 2 * mass[r] > largest]
    keep = np.isin(region, kept)
    most = max([largest, *(mass[r] for r in kept)])
    for places, own in zip(outside, masses, strict=True):
        if own >= SHARE * most:
            keep[places] = True
    return keep


def extract(pages: DataFrame) -> DataFrame:
    """Add ``text`` and ``n_chars`` (code points) in place of ``html``."""
    kept = [c for c in pages.columns if c not in ("html", "text", "n_chars")]
    schema = pages.select(*kept, F.lit("").alias("text"), F.lit(0).cast("long").alias("n_chars")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 200):
                batch = whole.slice(start, 200)
                texts = [main_text(h) for h in batch.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=[*kept, "text", "n_chars"])

    return pages.select(*kept, "html").mapInArrow(run, schema)
