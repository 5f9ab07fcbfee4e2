"""Main-text extraction from HTML by text-to-tag ratios.

The standard library's parser streams events; block elements split the page
into lines.  Every line has a text-to-tag ratio (characters outside links over
the tags since the line before), the ratios are smoothed with a Gaussian kernel,
and a two-cluster threshold on the smoothed values marks content lines.  The
content lines choose the region: from the page down, the child that holds most of
their text, as long as one holds ``REGION_SHARE`` of it; a single line beside others that are
not a menu is no region, and where no share decides, the one child with a heading and
several lines among single lines is.  The region is taken whole, short lines and all.

Names are priors on that.  Elements that are never article text (menus, footers,
forms, scripts ...) and those whose class, id or role is a boilerplate name as a
whole cannot hold content.  A boilerplate word within a longer name removes a
block only if the ratios agree: most of its text is in links, or its own ratio is
below the threshold.  So it is, inside an article or main element, with names that may
well be a section's subject (`SUBJECTS`).  A region within an article or main element
extends to all of it.  Without such an element the headings right before the region
belong to it, and blocks that are mostly links below the threshold do not.

Defined cases: null or empty html gives an empty text; so does a page with
nothing but boilerplate; malformed markup is read as the parser reads it; of two
children with equal content the first is taken; repeated rows give repeated
results; an empty table gives no rows; texts are never cut, long pages are parsed whole, one at a time; other
columns of the input, whatever their names, do not matter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices

SCHEMA = "page_id long, url string, text string, n_chars long"

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main menu "
    "nav noscript ol option p pre section select summary table tbody td template textarea tfoot th thead "
    "title tr ul".split()
)
#: Elements that never hold article text.
DROPPED = frozenset(
    "aside button canvas dialog fieldset footer form head iframe input menu nav noscript object option "
    "script select style svg template textarea title".split()
)
#: Words in class, id or role that mark boilerplate.  Fixed values.
MARKS = frozenset(
    "ad ads adslot advert advertisement adverts banner breadcrumb breadcrumbs complementary comment "
    "commentlist comments consent contentinfo cookie cookies dialog disqus footer form gdpr header hidden login "
    "masthead menu modal nav navbar navigation newsletter notice notices pager pagination paywall popup promo "
    "promoted promotion recommended related reply replies respond responses search share sharing sidebar "
    "signup skip social sponsor sponsored subscribe subscription toolbar topbar widget".split()
)
#: Words that say where or what kind of box an element is and nothing of its text.  Fixed values.
BOXES = frozenset(
    "area articles bar body bottom box button buttons col column container content cta entry footer global group "
    "holder icons inner item items js left level links list main menu outer page pages panel posts primary right row "
    "secondary section site slot stories text thread top topics unit user wrap wrapper".split()
)
#: Marks that inside an article may be what a section is about: the ratios have to agree.
SUBJECTS = frozenset(
    "complementary dialog form navigation notice notices promotion recommended related respond responses "
    "search share sharing social subscription toolbar widget".split()
)
_UNSEEN = frozenset("head iframe script select style svg template textarea title".split())
#: Elements that a mark never removes.
KEPT = frozenset("html body main article h1 h2 h3 h4 h5 h6".split())
#: Start tags that close an open element of the first kind.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPE = frozenset("ul ol dl table div article section main body blockquote td th".split())
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Beginnings of class names that describe a page's layout and not the element.
_LAYOUT = ("has-", "with-", "no-", "without-", "is-", "overflow-")


@lru_cache(maxsize=4096)
def marks_of(value: str) -> tuple[frozenset[str], bool]:
    """The boilerplate words among the names of a class, id or role attribute, and whether a whole name is made of them.

    A name is a boilerplate name as a whole if all its words are marks or boxes
    ("comment-list"); "related-work" only has a mark in it.
    """
    found: set[str] = set()
    whole = False
    for name in value.split():
        if name.lower().startswith(_LAYOUT):
            continue
        words = [w.lower() for w in _WORDS.findall(name)]
        marks = MARKS.intersection(words)
        if "hidden" in marks and len(words) > 1:  # only as a name of its own
            marks = marks - {"hidden"}
        found |= marks
        whole |= bool(marks) and all(w in MARKS or w in BOXES or w.isdigit() for w in words)
    return frozenset(found), whole


SIGMA = 1.5
REGION_SHARE = 0.75
#: The share of a block's text in links from which it is a menu.
MOSTLY = 0.5
BATCH_BYTES = 16_000_000


class _Page(HTMLParser):
    """Lines of a page with their ratios and open elements."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.names: list[str] = ["#page"]  # every element seen
        self.parent: list[int] = [-1]
        self.dropped: list[bool] = [False]
        self.doubtful: list[bool] = [False]  # a boilerplate word within a longer name
        self.unseen: list[bool] = [False]
        self.in_link: list[bool] = [False]
        self.open: list[int] = [0]
        self.depths: dict[str, list[int]] = {}  # where the open elements of a name are
        self.lines: list[tuple[str, int, int, int]] = []  # text, innermost element, tags, characters in links
        self.buffer: list[str] = []
        self.linked = 0
        self.tags = 0

    def flush(self) -> None:
        if self.buffer:
            text = " ".join("".join(self.buffer).split())
            self.buffer = []
            if text:
                self.lines.append((text, self.open[-1], self.tags, min(self.linked, len(text))))
                self.tags = 0
        self.linked = 0

    def _pop_to(self, depth: int) -> None:
        for at in self.open[depth:]:
            self.depths[self.names[at]].pop()
        del self.open[depth:]

    def _innermost(self, names) -> int:
        return max((self.depths[n][-1] for n in names if self.depths.get(n)), default=0)

    def _find(self, names, stop=frozenset()) -> int:
        """The depth of the innermost open element of the names, 0 if there is none or one of ``stop`` is further in."""
        depth = self._innermost(names)
        return depth if depth and depth >= self._innermost(stop) else 0

    def handle_starttag(self, tag, attrs) -> None:
        self.tags += 1
        if tag in VOID:
            if tag in ("br", "wbr", "hr"):
                self.buffer.append(" " if tag == "br" else "")
            if tag == "hr":
                self.flush()
            return
        if tag in BLOCK:
            self.flush()
            if at := self._find({"p"}, _SCOPE):
                self._pop_to(at)
            if tag in CLOSES and (at := self._find(CLOSES[tag], {"ul", "ol", "dl", "table"})):
                self._pop_to(at)
        at = self.open[-1]
        drop, doubt = self._judged(tag, attrs)
        self.names.append(tag)
        self.parent.append(at)
        # The main element counts even inside a wrapper whose class looks like boilerplate.
        self.dropped.append(tag != "main" and (self.dropped[at] or drop))
        self.doubtful.append(doubt)
        self.unseen.append(self.unseen[at] or tag in _UNSEEN)
        self.in_link.append(tag == "a" or self.in_link[at] and tag not in BLOCK)
        self.depths.setdefault(tag, []).append(len(self.open))
        self.open.append(len(self.names) - 1)

    def _judged(self, tag, attrs) -> tuple[bool, bool]:
        """Whether an element is boilerplate by its name and attributes, and whether that is for the ratios to say."""
        if tag in DROPPED:
            return True, False
        if tag == "header":
            return not self._find({"article", "main"}), False
        if tag in KEPT:
            # An article inside an article is a reader's comment if it is marked so.
            if tag != "article" or not self._find({"article"}):
                return False, False
        doubt = False
        for name, value in attrs:
            if name == "hidden" or name == "aria-hidden" and value == "true":
                return True, False
            if value and name in ("class", "id", "role"):
                marks, whole = marks_of(value)
                within = bool(marks) and bool(self._find({"article", "main"}))
                # A header inside the article is its heading.
                if marks and not (within and marks == {"header"}):
                    if whole and not (within and marks <= SUBJECTS):
                        return True, False
                    doubt = True
            if value and name == "style" and "display:none" in value.replace(" ", "").lower():
                return True, False
        return False, doubt

    def handle_startendtag(self, tag, attrs) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag) -> None:
        self.tags += 1
        if tag in BLOCK:
            self.flush()
        if at := self._find({tag}):
            self._pop_to(at)

    def handle_data(self, data) -> None:
        if not self.unseen[self.open[-1]]:
            self.buffer.append(data)
            if self.in_link[self.open[-1]]:
                self.linked += len(data.strip())


_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_LEAVES = frozenset("p li dt dd span a b i em strong blockquote pre h1 h2 h3 h4 h5 h6".split())


def smooth(values: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing; the kernel is renormalised at the ends."""
    radius = int(np.ceil(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    # "full" and then cut: "same" would return the kernel's length for short pages.
    top = np.convolve(values, kernel)[radius : radius + len(values)]
    return top / np.convolve(np.ones(len(values)), kernel)[radius : radius + len(values)]


def content_lines(ratios: np.ndarray) -> tuple[np.ndarray, float]:
    """Which lines belong to the upper of two clusters of the smoothed ratios, and the ratio that parts them."""
    x = np.log1p(smooth(ratios))
    low, high = x.min(), x.max()
    if high - low < 0.7:  # less than a factor of two: one cluster
        return np.ones(len(x), bool), 0.0
    for _ in range(50):
        upper = x > (low + high) / 2
        new = x[~upper].mean(), x[upper].mean()
        if new == (low, high):
            break
        low, high = new
    return x > (low + high) / 2, float(np.expm1((low + high) / 2))


def extract_main_text(html: str | None) -> str:
    """The article of a page: its blocks joined by two newlines, "" if there is none."""
    page = _Page()
    try:
        page.feed(html or "")
        page.close()
    except AssertionError:  # the parser rejects unknown marked sections
        page = _Page()
        page.feed(html.replace("<![", "&lt;!["))
        page.close()
    page.flush()
    lines = page.lines
    if not lines:
        return ""
    chosen, least = content_lines(np.array([(len(text) - links) / (1 + tags) for text, _, tags, links in lines]))
    sizes = np.array([len(text) for text, *_ in lines], float)
    places = np.array([at for _, at, _, _ in lines])
    in_links = np.array([links for *_, links in lines], float)
    parents = page.parent

    def under(values: np.ndarray) -> np.ndarray:
        """Sums under every element; children come after their parents."""
        total = np.bincount(places, values, len(parents))
        for at in range(len(total) - 1, 0, -1):
            total[parents[at]] += total[at]
        return total

    size = np.maximum(under(sizes), 1)
    tags = np.array([tags for _, _, tags, _ in lines], float)
    # Unsmoothed, for a block is judged by itself.
    low = (under(sizes - in_links) / (1 + under(tags)) < least) | (under(in_links) > MOSTLY * size)
    gone = list(page.dropped)
    for at in range(1, len(gone)):
        gone[at] = gone[at] or page.names[at] != "main" and (gone[parents[at]] or page.doubtful[at] and bool(low[at]))
    kept = ~np.array(gone)[places]
    if not kept.any():
        return ""
    content = kept & chosen if (kept & chosen).any() else kept
    weight = under(sizes * content)
    # A block of links below the threshold is a menu, whatever its name.
    menus = ((under(in_links) > MOSTLY * size) & (under(sizes * chosen) == 0))[places]
    number = under(kept & ~menus)
    children: dict[int, list[int]] = {}
    for at in range(1, len(weight)):
        children.setdefault(parents[at], []).append(at)
    titles = under(kept & np.array([page.names[at] in _HEADINGS for at in places]))
    region = 0
    while own := children.get(region):
        best = max(own, key=lambda c: weight[c])
        held = weight[best] >= REGION_SHARE * weight[region] > 0 and page.names[best] not in _LEAVES
        if not held or number[best] <= 1 < number[region]:
            # Ratios do not decide: the only titled block of several lines, if all others are single lines.
            titled = [c for c in own if titles[c]]
            if len(titled) != 1 or number[titled[0]] <= 1 or any(number[c] > 1 for c in own if c != titled[0]):
                break
            best = titled[0]
        region = best
    # The element that names the article, if the region is in one: the outermost article, else the main element.
    above, at = [], region
    while at >= 0:
        above.append(at)
        at = parents[at]
    named = [at for at in above if page.names[at] == "article"] or [at for at in above if page.names[at] == "main"]
    inside = np.zeros(len(weight), bool)
    inside[named[-1] if named else region] = True
    for at in range(1, len(weight)):
        inside[at] |= inside[parents[at]]
    rows = kept & inside[places]
    if not named:
        rows &= ~menus
        first = int(np.flatnonzero(rows)[0])
        while first and page.names[places[first - 1]] in _HEADINGS and kept[first - 1]:
            first -= 1
            rows[first] = True
    return "\n\n".join(lines[n][0] for n in np.flatnonzero(rows))


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars (code points) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2, BATCH_BYTES):
                texts = [extract_main_text(h.as_py()) for h in part.column(2)]
                sizes = pa.array([len(t) for t in texts], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()), sizes],
                    ["page_id", "url", "text", "n_chars"],
                )

    return pages.select(id_col, url_col, html_col).mapInArrow(run, SCHEMA)
