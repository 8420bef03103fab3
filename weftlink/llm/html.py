"""HTML main-text extraction by the distribution of text over line blocks.

Markup is stripped into lines, one a block, each with the length of its own text; links, and whatever stands in
menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments, have no length.
Lengths are summed over sliding windows of lines; text surges where a window rises over a threshold, which comes from
the page's own windows, by its first line alone or with text in the next one too, and dives where windows fall to nothing. Lines of text between
a surge and its dive are kept, and so is other text of their section. Article and main elements are evidence: one that
text surged in is kept whole, but for what stands aside.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from weftlink.llm.common import need, text_slices

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z|(?=<))", re.S)
ATTRIBUTE = re.compile(r"([A-Za-z_:][\w:.-]*)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
#: Kinds of elements.
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption title head".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is no markup up to the closing tag.
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template svg math".split())
ASIDE = frozenset("nav header footer aside form script style noscript iframe template svg math head title textarea button select option input object canvas audio video menu dialog".split())
#: An element of these starts where one of the same group is open: <p> ends <p>, <li> ends <li>.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Words of class names and ids that mark what isn't the article, and those of reader comments, which can outgrow it.
COMMENTS = frozenset("comment comments commentlist disqus replies reply respond".split())
NOISE = COMMENTS | frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promoted promotion sidebar menu nav navbar navigation breadcrumb breadcrumbs footer header masthead cookie cookies consent gdpr "
    "notice popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended widget toolbar pagination pager".split()
)
#: Words that may follow them in a name, words before them that deny it, and words that make a header the article's own.
PARTS = frozenset("left right inner outer wrap wrapper container list item items area section box bar block blocks content panel link links post posts button buttons slot unit top bottom primary secondary body text form title thread row col column group main site global message overlay banner".split())
DENIALS = frozenset("has no not with without is non hide show free".split())
OWN_HEADER = frozenset("entry post article page section content story title".split())
NAME_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
#: Elements that group blocks.
SECTIONS = frozenset("article body center dd div html main section td th ul ol dl".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BOUNDARIES = ("ul", "ol", "dl", "table")
SPACE = re.compile(r"\s+")


@dataclass
class Line:
    """A block's text; weight: the length that counts, 0 for links alone, below 0 for what stands aside; region: the innermost article or main element, from 1, or 0; section: the element that groups it."""

    text: str
    weight: int
    region: int
    section: int


@dataclass
class Element:
    """An open element: whether it stands aside, its region, its section and the one around it, and the innermost element with a noisy name, itself included (-1: none)."""

    name: str
    aside: bool
    region: int
    section: int
    around: int
    noisy: int
    named: bool


def noisy_word(token: str, words: frozenset[str]) -> bool:
    """Whether a class or an id names what isn't the article: such a word at its end, or at its start with a word for a part of it; denials take it back."""
    parts = [p.lower() for p in NAME_WORDS.findall(token)]
    if not parts or DENIALS.intersection(parts):
        return False
    if parts[-1] == "header" and OWN_HEADER.intersection(parts[:-1]):
        return False
    return parts[-1] in words or parts[0] in words and all(p in PARTS or p in words or p.isdigit() for p in parts[1:])


@lru_cache(4096)
def noisy_name(value: str, words: frozenset[str]) -> bool:
    return any(noisy_word(token, words) for token in value.split())


def judged(name: str, attributes: str) -> tuple[bool, bool, bool]:
    """Whether an element stands aside whatever is in it, whether its name is noisy, and whether it names comments. Of article and main elements only comments' names count."""
    off, named, comment = name in ASIDE, False, False
    if attributes and name not in ("html", "body"):
        own = name in ("article", "main")
        for key, *values in ATTRIBUTE.findall(attributes):
            key, value = key.lower(), "".join(values)
            if key in ("class", "id"):
                comment = comment or noisy_name(value, COMMENTS)
                named = named or comment or not own and noisy_name(value, NOISE)
            elif not own and (key == "role" and value.lower() in ROLES or key == "hidden" or key == "aria-hidden" and value.lower() == "true"):
                off = True
    return off, named, comment


class Page:
    """One pass over a page's markup; every step looks at the ends of lists only, so that depth costs nothing."""

    def __init__(self, page: str) -> None:
        self.lines: list[Line] = []
        self.noisy_of: list[int] = []  # of each line
        self.above: list[int] = []  # of each noisy element: the one around it
        self.comment: list[bool] = []
        self.headed: list[bool] = []  # whether a heading or a region is in it
        self.stack: list[Element] = [Element("", False, 0, 0, 0, -1, False)]
        self.opened: dict[str, list[int]] = {}  # places in the stack by name
        self.blocks: list[int] = []
        self.parts: list[str] = []
        self.linked = self.regions = self.sections = 0
        self.read(page)
        self.end()
        self.weigh()

    def end(self) -> None:
        """The block that was open is a line."""
        if self.parts:
            text = SPACE.sub(" ", html.unescape("".join(self.parts))).strip()
            self.parts.clear()
            if text:
                top = self.stack[-1]
                block = self.stack[self.blocks[-1]] if self.blocks else self.stack[0]
                self.lines.append(Line(text, -1 if top.aside else max(0, len(text) - self.linked), top.region, block.around))
                self.noisy_of.append(top.noisy)
        self.linked = 0

    def leave(self, at: int) -> None:
        if any(x.name in BLOCKS or x.aside or x.named for x in self.stack[at:]):
            self.end()
        for x in self.stack[at:]:
            self.opened[x.name].pop()
        del self.stack[at:]
        while self.blocks and self.blocks[-1] >= at:
            self.blocks.pop()

    def last(self, *names: str) -> int:
        """The place of the innermost open element of these names, or 0."""
        return max((places[-1] for n in names if (places := self.opened.get(n))), default=0)

    def enter(self, name: str, attributes: str) -> bool:
        """Opens an element; whether all of it is to be skipped up to its closing tag."""
        if name in BLOCKS:
            self.end()
            if name not in ("body", "html", "head"):  # a block ends an open paragraph
                at = self.last("p")
                if at and self.blocks[-1] == at:
                    self.leave(at)
            if name in CLOSES:
                at = self.last(*CLOSES[name])
                if at > self.last(*BOUNDARIES):
                    self.leave(at)
        if name == "br":
            self.parts.append(" ")
        if name in VOID:
            return False
        outer = self.stack[-1]
        region, noisy = outer.region, outer.noisy
        off, named, comment = judged(name, attributes)
        header = self.last("header")
        if name in HEADINGS and header and outer.region and outer.noisy < 0 and self.stack[header].region == outer.region and not self.stack[header - 1].aside:
            outer = self.stack[header - 1]  # the article's own title
        if name in ("article", "main") and not named:
            self.regions += 1
            region = self.regions
        if named:
            self.above.append(noisy), self.comment.append(comment), self.headed.append(False)
            noisy = len(self.above) - 1
        if noisy >= 0 and (name in HEADINGS or name in ("article", "main")):
            self.headed[noisy] = True
        if (off or named) and not outer.aside:
            self.end()
        if name in RAW and (off or named):
            return True
        if not attributes.rstrip().endswith("/"):
            if name in SECTIONS:
                self.sections += 1
            self.opened.setdefault(name, []).append(len(self.stack))
            if name in BLOCKS:
                self.blocks.append(len(self.stack))
            self.stack.append(Element(name, outer.aside or off, region, self.sections if name in SECTIONS else outer.section, outer.section, noisy, named))
        return False

    def read(self, page: str) -> None:
        place, n = 0, len(page)
        closers: dict[str, int] = {}  # raw elements that no tag closes from some place on
        while place < n:
            m = TOKEN.search(page, place)
            text = page[place : m.start() if m else n]
            if text:
                self.parts.append(text)
                if self.opened.get("a"):
                    self.linked += len(text.strip())
            if m is None:
                return
            place = m.end()
            if m[2] is None:
                continue
            name = m[2].lower()
            if m[1]:
                at = self.last(name)
                if at:
                    self.leave(at)
                elif name in BLOCKS:
                    self.end()
            elif self.enter(name, m[3]):
                close = None if closers.get(name) else re.compile(rf"</{name}\s*[^>]*>", re.I).search(page, place)
                closers[name] = close is None
                place = close.end() if close else n

    def weigh(self) -> None:
        """Lines of elements with noisy names lose their weight, unless the element wraps most of the page's text with a heading or an article in it; comments must wrap nearly all."""
        text, held = sum(max(0, x.weight) for x in self.lines), [0] * len(self.above)
        for x, k in zip(self.lines, self.noisy_of, strict=True):
            if k >= 0:
                held[k] += max(0, x.weight)
        for k in range(len(self.above) - 1, -1, -1):  # an element comes after the one around it
            if self.above[k] >= 0:
                held[self.above[k]] += held[k]
                self.headed[self.above[k]] |= self.headed[k]
        dead = [False] * len(self.above)
        for k, up in enumerate(self.above):
            free = self.headed[k] and held[k] > text * (0.95 if self.comment[k] else 0.5)
            dead[k] = not free or up >= 0 and dead[up]
        for x, k in zip(self.lines, self.noisy_of, strict=True):
            if k >= 0 and dead[k]:
                x.weight = -1


def lines_of(page: str) -> list[Line]:
    """The lines of a page in its order; what stands aside leaves a line without weight."""
    return Page(page).lines


def surged(weights: list[int], regions: list[int], sections: list[int], window: int = 3, most: int = 400) -> list[bool]:
    """Which lines lie between a surge and its dive: the threshold is half of the page's fullest window, or ``most`` where that is less. Windows hold lines of one region and section, and text dives where a region ends."""
    n, half = len(weights), window // 2
    sums = [sum(weights[j] for j in range(max(0, i - half), min(n, i + half + 1)) if regions[j] == regions[i] and sections[j] == sections[i]) for i in range(n)]
    threshold = max(1, min(most, max(sums, default=0) // 2))
    keep, inside = [False] * n, False
    for i in range(n):
        inside = inside and regions[i] == regions[i - 1] and sums[i] > 0
        if not inside and sums[i] >= threshold and (weights[i] >= threshold or i + 1 < n and sums[i + 1] > 0):  # a surge: it begins with the first line of text in its window
            inside = True
            back = i
            while back > 0 and back > i - half and weights[back - 1] and regions[back - 1] == regions[i] and sections[back - 1] == sections[i]:
                back -= 1
            keep[back:i] = [True] * (i - back)
        keep[i] = keep[i] or inside and weights[i] > 0
    return keep


def kept(lines: list[Line]) -> list[str]:
    """The article's lines: what surged, the rest of its sections, and the regions that text surged in."""
    keep = surged([max(0, x.weight) for x in lines], [x.region for x in lines], [x.section for x in lines])
    regions = {x.region for x, at in zip(lines, keep, strict=True) if at and x.region}
    sections = {x.section for x, at in zip(lines, keep, strict=True) if at}
    return [x.text for x, at in zip(lines, keep, strict=True) if at or x.weight >= 0 and x.region in regions or x.weight > 0 and x.section in sections]


def main_text(page: str | None) -> str:
    """The article of a page, its blocks joined by an empty line."""
    return "\n\n".join(kept(lines_of(page))) if page else ""


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """(id_col, keep..., text) of every page.

    The whole html is read. Null or empty html, and a page without an article, give an empty text. Repeated rows
    give a row each; columns other than ``keep`` are ignored; an empty table gives an empty table.
    """
    source = need(pages, id_col, *keep, html_col)
    last = len(source.columns) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, last):
            texts = [main_text(page) for page in batch.column(last).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:last], pa.array(texts, pa.string())], names=[*(f"c{i}" for i in range(last)), "text"])

    kinds = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(source.schema[:last]))
    return source.mapInArrow(run, f"{kinds}, text string").toDF(*source.columns[:last], "text")


def with_lengths(extracted: DataFrame) -> DataFrame:
    return extracted.withColumn("n_chars", F.length("text").cast("long"))
