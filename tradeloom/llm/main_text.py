"""Main text of web pages by text-to-tag ratios of their lines.

Events of the standard-library parser cut a page into lines, one per run of
text between block-level tags, and count the tags before each. The ratio of text
to tags is smoothed with a Gaussian kernel over neighbouring lines; lines whose
smoothed ratio is above one standard deviation of the page's ratios form the
content cluster. Lines in menus, headers, footers, sidebars, notices, adverts,
forms, comments, scripts and styles never count. Some of these are known by a
whole class, id or role token only; such an element counts all the same if it
holds most of the text, and so does a ``main`` or a large ``article`` inside it.
The content region is made of
the outermost ``article`` and ``main`` elements where these hold nearly all text
of the cluster, else it is the innermost element that holds all of it, grown while
that is only a part of a text (a section, quote, table or list) or stands among
lines of its parent. Short lines belong to the cluster of a region without ``article`` only by
their own ratio, as smoothing also lifts the first lines after the text, or as the top heading right before such a line.

The ratios then decide about parts inside the region that no list names. A part with a sign of being beside the
text (mostly links, fields to fill in, or a word of HINTS in its class or id) goes if its text is thinner than the cluster
around it; a sign alone, or thin text alone, drops nothing. A part that holds half of the region or more stays.
All other lines of the region, short ones too, are the main text.

A null html is an empty page; a page without content has the text ''. Unclosed
and stray tags are allowed. Repeated rows are pages like others; other columns
are kept, and columns called ``text`` or ``n_chars`` are replaced. An empty table
gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tradeloom.llm.common import nullable, small_batches

# HTML element names by their role.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CONTAINERS = frozenset("article aside blockquote body div dl fieldset figure footer form header main menu nav ol section table tbody td tr ul".split())
NEVER = frozenset("aside button dialog footer form head iframe menu nav noscript object script select style svg template textarea title".split())
#: Tokens of a class, id or role that mark a part of the page beside its article.
BESIDE = frozenset(
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments complementary contentinfo cookie cookies "
    "disqus footer form masthead menu modal nav navbar navigation newsletter notice popup promo related replies reply "
    "respond search share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget "
    "ad-banner ad-container ad-slot ad-unit ad-wrapper breadcrumb-nav comment-body comment-form comment-list comments-area comments-section "
    "cookie-banner cookie-bar cookie-consent cookie-notice main-menu main-nav main-navigation nav-bar nav-links nav-menu newsletter-form "
    "newsletter-signup page-footer post-comments post-navigation primary-navigation related-articles related-posts search-box search-form "
    "share-buttons share-links side-bar site-footer site-header site-navigation skip-link skip-links social-links social-media "
    "social-share top-nav top-navigation widget-area".split()
)
#: Words inside a class, id or role that say something only together with a low ratio.
HINTS = frozenset(
    "alert breadcrumb breadcrumbs comment comments consent cookie cookies disqus feedback gdpr modal navbar newsletter popup promo replies sidebar signup "
    "sponsor sponsored subscribe toolbar widget".split()
)
WORDS = re.compile(r"[a-z]+")
# HTML elements to fill in, and kinds of ``input`` that also stand in texts.
FIELDS, MARKERS = frozenset("input select textarea".split()), frozenset("checkbox hidden image radio".split())
#: A part is mostly links if it has so many, with this share of its text.
LINKS, LINKED = 3, 2 / 3
# Open elements that a start tag closes where their end tags were left out, up to the nearest table.
IMPLIED = {"td": frozenset(["td"]), "tr": frozenset(["td", "tr"]), "tbody": frozenset(["td", "tr", "tbody"])}
#: Elements of NEVER that a ``main`` or most of the page may be found in, as when their end tag is missing.
LAYOUT = frozenset("aside dialog footer head header menu nav".split())
NUMBER = re.compile(r"[-_]*\d+$")
MARKED, AROUND, UNSEEN = 1, 2, 3
RADIUS, SIGMA = 2, 1.0
#: Articles are the region if they hold at least this share of the cluster's text.
MOST = 0.8
#: Elements that hold a text or a page; the other containers, but for the cells of tables, are parts of a text.
WHOLE = frozenset(["", "article", "body", "div", "main"])
ARTICLES = frozenset(["article", "main"])


class Lines(HTMLParser):
    """Lines of a page: text, tags before it and the innermost element around it; and the elements with parents and marks.

    Elements know their parent only, so memory grows with the page and not with its depth.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.texts: list[str] = []
        self.tags: list[int] = []
        self.within: list[int] = []
        self.stack: list[int] = [0]
        self.open: Counter[str] = Counter()
        self.names: list[str] = [""]
        self.parents: list[int] = [0]
        self.marks: list[int] = [0]
        self.hinted: list[bool] = [False]
        self.fields: list[bool] = [False]
        self.links: list[int] = []
        self.linked: list[int] = []
        self.top: list[bool] = []
        self.parts: list[str] = []
        self.count = 0
        self.link_depth = 0  # open elements where the open link began, 0 outside links
        self.link_count = self.link_size = 0
        self.in_top = False

    def end_line(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            self.parts = []
            if text:
                self.texts.append(text)
                self.tags.append(self.count)
                self.within.append(self.stack[-1])
                self.links.append(self.link_count)
                self.linked.append(min(self.link_size, len(text)))
                self.top.append(self.in_top)
                self.count = self.link_count = self.link_size = 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.count += 1
        if tag == "a":
            self.link_depth = len(self.stack)
            self.link_count += 1
        if tag in INLINE:
            return
        self.end_line()
        self.in_top = tag == "h1"
        if tag in FIELDS and dict(attrs).get("type") not in MARKERS:
            self.fields[self.stack[-1]] = True
        if tag in VOID or (tag not in CONTAINERS and tag not in NEVER):
            return
        while self.names[self.stack[-1]] in IMPLIED.get(tag, ()):
            self.leave()
        mark = self.mark(tag, attrs)
        self.names.append(tag)
        self.parents.append(self.stack[-1])
        self.marks.append(mark)
        self.hinted.append(any(value and name in ("class", "id", "role") and not HINTS.isdisjoint(WORDS.findall(value.lower())) for name, value in attrs))
        self.fields.append(False)
        self.stack.append(len(self.names) - 1)
        self.open[tag] += 1

    def leave(self) -> None:
        self.open[self.names[self.stack.pop()]] -= 1
        if len(self.stack) < self.link_depth:
            self.link_depth = 0

    def mark(self, tag: str, attrs: list[tuple[str, str | None]]) -> int:
        if tag == "header" and any(self.open[a] for a in ARTICLES):
            return 0
        if tag in NEVER and tag != "form" or tag == "header":
            return AROUND if tag in LAYOUT else UNSEEN
        if tag in ("body", "article", "main"):
            return 0
        for name, value in attrs:
            if value and name in ("class", "id", "role") and not BESIDE.isdisjoint(NUMBER.sub("", t).replace("_", "-") for t in value.lower().split()):
                return MARKED
            if name == "hidden" or name == "aria-hidden" and value == "true":
                return MARKED
        return MARKED if tag == "form" else 0

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.count += 1
        if tag not in INLINE:
            self.end_line()
            if tag in FIELDS and dict(attrs).get("type") not in MARKERS:
                self.fields[self.stack[-1]] = True

    def handle_endtag(self, tag: str) -> None:
        self.count += 1
        if tag == "a":
            self.link_depth = 0
        if tag in INLINE:
            return
        self.end_line()
        self.in_top = False
        if self.open[tag]:
            while self.names[self.stack[-1]] != tag:
                self.leave()
            self.leave()

    def handle_data(self, data: str) -> None:
        if self.names[self.stack[-1]] not in ("script", "style"):
            self.parts.append(data)
            if self.link_depth:
                self.link_size += len(data.strip())


def held(lines: Lines, without: list[bool]) -> list[int]:
    """Length of the text in each element, but for lines in elements ``without``."""
    size = [0] * len(lines.names)
    for text, e in zip(lines.texts, lines.within):
        if not without[e]:
            size[e] += len(text)
    for e in range(len(size) - 1, 0, -1):
        size[lines.parents[e]] += size[e]
    return size


def beside(lines: Lines) -> list[bool]:
    """Which elements hold no content of their own, by their marks and those around them."""
    names, parents, marks = lines.names, lines.parents, lines.marks
    elements = range(1, len(names))
    scope = [0] * len(names)  # the innermost article around an element, 0 for the page
    unseen = [False] * len(names)
    for e in elements:
        scope[e] = parents[e] if names[parents[e]] in ARTICLES else scope[parents[e]]
        unseen[e] = unseen[parents[e]] or marks[e] == UNSEEN
    size = held(lines, unseen)
    out = unseen[:]
    for e in elements:
        freed = names[e] in ("body", "main") or names[e] == "article" and 2 * size[e] > size[0]
        out[e] = unseen[e] or marks[e] == AROUND or out[parents[e]] and not freed

    size = held(lines, out)
    articles = [e for e in elements if names[e] in ARTICLES and not out[e] and size[e]]
    # Comments can be longer than the article: what lies beside one needs nearly all of the page's text to count.
    marked = [False] * len(names)
    under = marked[:]
    for e in elements:
        if marks[e] == MARKED:
            marked[e] = 2 * size[e] <= size[scope[e]] or not scope[e] and bool(articles) and size[e] < MOST * size[0]
        under[e] = under[parents[e]] or marked[e]
    clear = max((size[e] for e in articles if not under[e]), default=0)
    for e in elements:
        freed = names[e] == "main" or names[e] == "article" and not scope[e] and size[e] >= clear
        marked[e] = marked[e] or marked[parents[e]] and not freed
    return [a or b for a, b in zip(out, marked)]


def smoothed(ratios: np.ndarray, radius: int = RADIUS, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian mean over ``radius`` lines on each side, with less weight in all at the page's ends."""
    kernel = np.exp(-(np.arange(-radius, radius + 1) ** 2) / (2 * sigma**2))
    padded = np.pad(ratios, radius)
    inside = np.pad(np.ones(len(ratios)), radius)
    return np.convolve(padded, kernel, "valid") / np.convolve(inside, kernel, "valid")


def region(lines: Lines) -> list[int]:
    """Numbers of the lines that are the page's main text."""
    no_content = beside(lines)
    usable = [i for i, e in enumerate(lines.within) if not no_content[e]]
    if not usable:
        return []
    size = np.array([len(t) for t in lines.texts], float)
    ratios = smoothed(size / np.maximum(1, np.array(lines.tags, float)))
    usable = np.array(usable)
    content = usable[ratios[usable] >= ratios.std()]
    if not len(content):
        content = usable
    wanted = under(lines, {e for e, name in enumerate(lines.names) if name in ARTICLES})
    inside = [i for i in content.tolist() if wanted[lines.within[i]]]
    if not inside or size[inside].sum() < MOST * size[content].sum():
        direct = {lines.within[i] for i in usable.tolist()}
        own = {i for i in content.tolist() if size[i] / max(1, lines.tags[i]) >= ratios.std()}
        own |= {i for i in usable.tolist() if lines.top[i] and i + 1 in own}
        wanted = under(lines, {grown(lines, common(lines, {lines.within[i] for i in own or content.tolist()}), direct)})
    kept = [i for i in usable.tolist() if wanted[lines.within[i]]]
    off = thin(lines, kept, set(content.tolist()), ratios)
    return [i for i in kept if not off[lines.within[i]]]


def thin(lines: Lines, kept: list[int], content: set[int], ratios: np.ndarray) -> list[bool]:
    """Which elements of the region are beside its text after all: they show a sign of it and their smoothed ratio is below that of the cluster around them."""
    # Per element: text, text times ratio, both for lines of the cluster only, links and text in links.
    sums = np.zeros((len(lines.names), 6))
    for i in kept:
        text = len(lines.texts[i])
        mass = text * ratios[i]
        sums[lines.within[i]] += (text, mass, text if i in content else 0, mass if i in content else 0, lines.links[i], lines.linked[i])
    fields = lines.fields[:]
    for e in range(len(sums) - 1, 0, -1):
        sums[lines.parents[e]] += sums[e]
        fields[lines.parents[e]] |= fields[e]
    whole, whole_mass = sums[0, 2:4]
    out = [False] * len(sums)
    for e in range(1, len(sums)):
        text, mass, inner, inner_mass, links, linked = sums[e].tolist()
        out[e] = out[lines.parents[e]]
        if out[e] or not text or 2 * text >= sums[0, 0] or whole <= inner:
            continue
        sign = lines.hinted[e] or fields[e] and not inner or links >= LINKS and linked >= LINKED * text
        out[e] = bool(sign and mass / text < (1 - 1e-9) * (whole_mass - inner_mass) / (whole - inner))
    return out


def under(lines: Lines, roots: set[int]) -> list[bool]:
    """Which elements are one of ``roots`` or inside one."""
    out = [e in roots for e in range(len(lines.names))]
    for e in range(1, len(out)):
        out[e] = out[e] or out[lines.parents[e]]
    return out


def common(lines: Lines, elements: set[int]) -> int:
    """The innermost element that is or holds each of ``elements``: the one farthest down that as many of them lead to."""
    leading = [0] * len(lines.names)
    for e in elements:
        leading[e] = 1
    for e in range(len(leading) - 1, 0, -1):
        leading[lines.parents[e]] += leading[e]
    return max(e for e, n in enumerate(leading) if n == len(elements))


def grown(lines: Lines, element: int, direct: set[int]) -> int:
    """``element``, or the one above it whose text it is a part of; ``direct`` elements have lines of their own."""
    while element:
        above = lines.parents[element]
        between = {above}
        while lines.names[above] not in WHOLE:
            above = lines.parents[above]
            between.add(above)
        tag = lines.names[element]
        if (tag in WHOLE or tag == "td") and direct.isdisjoint(between):
            break
        element = above
    return element


def main_text(html: str | None) -> str:
    if not html:
        return ""
    lines = Lines()
    lines.feed(html)
    lines.close()
    lines.end_line()
    return " ".join(lines.texts[i] for i in region(lines))


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` without the html, with ``text`` and its length in code points."""
    small_batches(pages.sparkSession)
    keep = [c for c in pages.columns if c not in (html, "text", "n_chars")]
    rows = pages.select(*keep, pages[html].alias("html"))
    fields = [*rows.schema.fields[:-1], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h) for h in batch.column(len(keep)).to_pylist()]
            columns = [*batch.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [*keep, "text", "n_chars"])

    return rows.mapInArrow(run, nullable(T.StructType(fields)))
