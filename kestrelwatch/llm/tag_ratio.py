"""Main text of web pages by text-to-tag ratios.

The standard library's parser streams its events; blocks (headings, paragraphs, list items, cells, ...) are the lines. Each
line has the ratio of its characters outside links to its tags. A Gaussian smooths the logarithms of the ratios over
neighbouring lines, so that one very long line does not outweigh the others, a threshold clusters them into content and the
rest, and all content lines count. Content lines bring with them the lines of the article or main element around them, or else
of the container around them, so that short paragraphs at its edges stay.

Elements that are no article by their meaning (navigation, headers and footers of the page, adverts, controls of forms, ...)
never count. Some only seem to be none: a form, or a name that says so, does not exclude an element that holds most of the
text, unless an article stands elsewhere. Reader comments are told by a name, or by their structure: neighbouring elements
of one kind that each have an author and a time. Those count only where there is next to nothing else.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrelwatch.llm.arrow import map_batches, slices

SPREAD = 1.5
REACH = 4

# Elements of HTML by what they mean here.
HIDDEN = frozenset("head script style noscript template svg math iframe object canvas audio video select option optgroup datalist button textarea label legend output meter progress input nav footer aside dialog menu".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article blockquote body caption center dd details dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup html li main nav ol p pre "
    "section summary table tbody td tfoot th thead tr ul".split()
)
LANDMARKS = frozenset(["article", "main"])
# Elements that an end tag of an outer element, or their like, closes.
OPTIONAL = {"p": BLOCKS - {"body", "html"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "tr": {"tr", "tbody", "tfoot"}, "option": {"option"}}
# Words of class, id and role that name what surrounds an article, and those that do so only outside of one.
ASIDE = re.compile(
    r"ad(?:s|slot|box|unit|wrap|space|container)?|adverts?|advertisements?|advertising|adsense|adsbygoogle|sponsor(?:s|ed)?|promo(?:s|tion|tions)?|banners?|"
    r"cookie[a-z]*|consent|gdpr|notices?|alerts?|popups?|modals?|overlay|(?:top|main|sub|side|site|foot)?nav(?:bar|igation|list|menu)?|[a-z]*menus?|breadcrumbs?|"
    r"sidebars?|(?:right|left)(?:rail|bar)|rail|[a-z]*footers?|colophon|copyright|topbar|share|sharing|social|"
    r"follow|related|recommended|newsletter|subscribe|subscription|signup|login|search|widgets?|toolbar|pagination|pager|skip|skiplink|complementary|contentinfo|hidden"
)
COMMENTS = re.compile(r"comments?|commentlist|respond|replies|disqus|talkbacks?|guestbook")
# Two of these in one name speak of readers, one alone may be a part of an article.
READERS = re.compile(r"discussions?|threads?|responses|feedback|conversations?|remarks|opinions|readers?|users?|visitors?")
WHO = re.compile(r"authors?|users?|username|avatar|commenter|poster|vcard|nick|nickname|byline|creator")
WHEN = re.compile(r"dates?|datetime|datepublished|datecreated|times?|timestamp|posted|ago|published|permalink|reply")
TOP = re.compile(r"[a-z]*headers?|masthead")
# Words that may stand beside such a word in one name.
BESIDE = re.compile(
    r"site|page|main|top|bottom|left|right|side|bar|global|primary|secondary|mobile|sticky|box|block|unit|slot|wrap|wrapper|container|area|inner|outer|content|section|panel|"
    r"list|links?|items?|icons?|buttons?|form|us|me|by|posts?|stories|articles?|story|article|text|image|law|media|js|the|[a-z]?"
)
# Attributes that say what an element is.
SAYING = frozenset(["class", "id", "role", "rel", "itemprop"])
# A token that begins like this says something about a neighbour.
ABOUT_OTHERS = ("has-", "has_", "no-", "no_", "with-", "with_", "without-", "hide-", "show-")
CONTAINERS = frozenset("div section article ul ol dl table p span aside header footer figure li details".split())
# Elements that hold the fields of a form, or a whole page, and those that a comment can be.
FORMS = frozenset(["form", "fieldset"])
ITEMS = frozenset("article dd details div li section tr".split())
# Share of the text that comments must have to be the page's content.
ALMOST_ALL = 0.8
# Elements that lines stand in; others are part of a line or of a list.
BOXES = frozenset("article aside body center dd details dialog div fieldset figure footer form header main nav section td".split())


def names(tokens: list[str], what: re.Pattern, least: int = 1) -> bool:
    """Whether a whole token says ``what``: at least so many of its words do, and no word says anything else."""
    for token in tokens:
        words = re.split(r"[^a-z]+", token)
        if sum(map(bool, map(what.fullmatch, words))) >= least and all(what.fullmatch(w) or BESIDE.fullmatch(w) or (what is COMMENTS and READERS.fullmatch(w)) for w in words):
            return True
    return False


@dataclass(frozen=True)
class Meaning:
    """What the names of an element say."""

    comments: bool = False
    readers: bool = False
    aside: bool = False
    top: bool = False
    who: bool = False
    when: bool = False


NOTHING = Meaning()


@lru_cache(maxsize=20_000)
def meaning(text: str) -> Meaning:
    tokens = [t for t in text.split() if not t.startswith(ABOUT_OTHERS)]
    words = [w for t in tokens for w in re.split(r"[^a-z]+", t)]
    return Meaning(
        names(tokens, COMMENTS), names(tokens, READERS, 2), names(tokens, ASIDE), names(tokens, TOP), any(map(WHO.fullmatch, words)), any(map(WHEN.fullmatch, words))
    )


@dataclass
class Line:
    text: str
    tags: int
    linked: int
    landmark: int
    outside: bool
    heading: bool = False
    named: tuple[int, ...] = ()
    box: int = 0

    @property
    def ratio(self) -> float:
        return max(0, len(self.text) - self.linked) / max(1, self.tags)


@dataclass
class Open:
    """An element that has not ended."""

    tag: str
    no: bool = False  # no content
    landmark: int = 0
    named: tuple[int, ...] = ()  # numbers of the elements around, and of itself, that may be no content
    box: int = 0
    link: int = 0  # how many elements deeper still belong to a link
    item: int = -1  # the innermost element around that may be a comment
    serial: int = 0


class Lines(HTMLParser):
    """Turns events into lines. An element that is no content silences everything inside; it ends with its end tag or with
    that of an element around it, so that a forgotten end tag cannot reach beyond its parent."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[Open] = [Open("")]
        self.lines: list[Line] = []
        self.parts: list[str] = []
        self.tags = self.linked = self.landmarks = 0
        self.around: set[int] = set()  # landmarks that are main elements
        self.parent: dict[int, int] = {}  # the main element around an article
        self.kinds: list[str] = []  # of each numbered element: comments, readers, aside, or item
        self.boxes = [0]  # the box around each box
        # Of elements that may be comments: their neighbours of one kind, and whether an author and a time are inside.
        self.groups: dict[tuple, list[int]] = {}
        self.who: dict[int, bool] = {}
        self.when: dict[int, bool] = {}
        self.outer: dict[int, int] = {}
        self.serial = 0

    def updatepos(self, i: int, j: int) -> int:
        """Lines and columns of events are of no use here."""
        return j

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            top = self.open[-1]
            heading = any(e.tag in ("h1", "h2", "h3", "h4", "h5", "h6") for e in self.open[-3:])
            self.lines.append(Line(text, self.tags, self.linked, top.landmark, top.no, heading, top.named, top.box))
            self.tags = self.linked = 0
        self.parts = []

    def number(self, kind: str) -> int:
        self.kinds.append(kind)
        return len(self.kinds) - 1

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag == "br":
            self.parts.append(" ")
            return
        if tag in VOID:
            if attrs and self.open[-1].item >= 0:
                said = meaning(" ".join(v.lower() for k, v in attrs if v and k in SAYING))
                self.who[self.open[-1].item] |= said.who
                self.when[self.open[-1].item] |= said.when
            return
        while tag in OPTIONAL.get(self.open[-1].tag, ()):
            self.leave(len(self.open) - 1)
        if tag in BLOCKS or tag in HIDDEN:
            self.flush()
        top = self.open[-1]
        said, hidden, classes = NOTHING, False, ""
        if attrs:
            held = [v.lower() for k, v in attrs if v and k in SAYING]
            if held:
                said = meaning(" ".join(held))
                classes = next((v for k, v in attrs if v and k == "class"), "")
            hidden = any(k == "hidden" or (k == "aria-hidden" and v == "true") or (k == "style" and v and "display:none" in v.replace(" ", "")) for k, v in attrs)
        # A header inside an article holds its title.
        no = top.no or hidden or tag in HIDDEN or (not top.landmark and tag == "header")
        self.serial += 1
        element = Open(tag, no, top.landmark, top.named, top.box, 4 if tag == "a" else max(0, top.link - 1), top.item, self.serial)
        if not no:
            self.name(element, said, classes)
        if tag in BOXES:
            self.boxes.append(top.box)
            element.box = len(self.boxes) - 1
        if tag in LANDMARKS and not no:
            # The outermost article, or else the main element around.
            if not top.landmark or (tag == "article" and top.landmark in self.around):
                self.landmarks += 1
                if tag == "main":
                    self.around.add(self.landmarks)
                elif top.landmark:
                    self.parent[self.landmarks] = top.landmark
                element.landmark = self.landmarks
        self.open.append(element)

    def name(self, element: Open, said: Meaning, classes: str) -> None:
        """Numbers the element if it may be no content, and notes authors and times for the comment around it."""
        tag = element.tag
        if element.item >= 0 and (said.who or said.when or tag == "time"):
            self.who[element.item] |= said.who
            self.when[element.item] |= said.when or tag == "time"
        if tag in FORMS:
            element.named = (*element.named, self.number("aside"))
        if tag in CONTAINERS and (said.comments or said.readers or said.aside or (said.top and not element.landmark)):
            element.named = (*element.named, self.number("comments" if said.comments else "readers" if said.readers else "aside"))
        if tag in ITEMS:
            kind = (self.open[-1].serial, tag, re.sub(r"\d+", "", classes))
            number = self.number("item")
            self.groups.setdefault(kind, []).append(number)
            self.who[number], self.when[number], self.outer[number] = said.who, said.when, element.item
            element.named, element.item = (*element.named, number), number

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag in ("svg", "math") and self.open[-1].tag == tag:
            self.handle_endtag(tag)

    def leave(self, depth: int) -> None:
        if any(e.tag in BLOCKS or e.tag in HIDDEN for e in self.open[depth:]):
            self.flush()
        del self.open[depth:]

    def handle_endtag(self, tag: str) -> None:
        for depth in range(len(self.open) - 1, 0, -1):
            if self.open[depth].tag == tag:
                self.leave(depth)
                break
            # The end of an inline element does not close blocks.
            if tag not in BLOCKS and tag not in HIDDEN and self.open[depth].tag in BLOCKS:
                break

    def handle_data(self, data: str) -> None:
        top = self.open[-1]
        if top.tag in ("script", "style"):
            return
        self.parts.append(data)
        if top.link:
            self.linked += len(data.strip())

    def threads(self) -> dict[int, int]:
        """Number of each element that is one of several comments, with the number of their first."""
        # What an element holds, the elements around hold as well; inner ones have larger numbers.
        for number in sorted(self.outer, reverse=True):
            outer = self.outer[number]
            if outer >= 0:
                self.who[outer] |= self.who[number]
                self.when[outer] |= self.when[number]
        found = {}
        for members in self.groups.values():
            alike = [k for k in members if self.who[k] and self.when[k]]
            if len(alike) > 1 and 3 * len(alike) >= 2 * len(members):
                found |= dict.fromkeys(members, members[0])
        return found

    def done(self) -> list[Line]:
        self.close()
        self.flush()
        threads = self.threads()
        for line in self.lines:
            line.named = tuple(dict.fromkeys(threads.get(k, k) for k in line.named if self.kinds[k] != "item" or k in threads))
            line.outside = line.outside or any(self.kinds[k] == "comments" for k in line.named)
        held, total = Counter(), 0
        for line in self.lines:
            size = 0 if line.outside else max(0, len(line.text) - line.linked)
            total += size
            for k in line.named:
                held[k] += size
        # An element that holds most of the text is no surrounding, unless an article stands elsewhere.
        article = any(line.landmark and not line.named and not line.outside for line in self.lines)
        share = {k: (0.5 if self.kinds[k] == "aside" else ALMOST_ALL) for k in held}
        for line in self.lines:
            line.outside = line.outside or any(article or held[k] <= share[k] * total for k in line.named)
        # A box with a single line is part of the box around it.
        lines = Counter(line.box for line in self.lines)
        for line in self.lines:
            while line.box and lines[line.box] == 1:
                line.box = self.boxes[line.box]
        return self.lines


def smoothed(ratios: list[float], spread: float = SPREAD, reach: int = REACH) -> list[float]:
    """Gaussian mean over neighbouring lines; at the ends over those that are there."""
    if not ratios:
        return []
    weight = np.exp(-(np.arange(-reach, reach + 1) ** 2) / (2 * spread * spread))
    near, there = (np.convolve(v, weight)[reach : reach + len(ratios)] for v in (ratios, np.ones(len(ratios))))
    return (near / there).tolist()


def threshold(values: list[float]) -> float:
    """The border between two clusters of values: half way between their means, moved until it stays."""
    if not values:
        return 0.0
    border = sum(values) / len(values)
    for _ in range(50):
        low, high = [v for v in values if v < border], [v for v in values if v >= border]
        if not low or not high:
            return min(values)
        new = (sum(low) / len(low) + sum(high) / len(high)) / 2
        if abs(new - border) < 1e-9:
            break
        border = new
    return border


def content(lines: list[Line], parent: dict[int, int]) -> list[Line]:
    """The lines of the content regions, in page order. ``parent``: the main element around an article, whose headings before
    the article belong to it."""
    own = [0.0 if line.outside else math.log1p(line.ratio) for line in lines]
    ratios = smoothed(own)
    inner = [r for r, line in zip(ratios, lines, strict=True) if not line.outside]
    # Lines outside take part as what content is to be told from.
    border = min(threshold(ratios), threshold(inner)) if inner else 0.0
    high = [r >= border and not line.outside for r, line in zip(ratios, lines, strict=True)]
    links = [line.linked * 2 > len(line.text) for line in lines]
    marks = {line.landmark for yes, line in zip(high, lines, strict=True) if yes and line.landmark}
    if marks:
        # Beside an article a line must be high itself, not by the article's lines.
        high = [yes and (line.landmark > 0 or (r >= border and not link)) for yes, r, line, link in zip(high, own, lines, links, strict=True)]
    where = [i for i, yes in enumerate(high) if yes and not lines[i].landmark and not links[i]]
    taken = [yes or (line.landmark in marks and not line.outside) for yes, line in zip(high, lines, strict=True)]
    # The headings of a main element before its first article with content.
    first: dict[int, int] = {}
    for i, line in enumerate(lines):
        if line.landmark in marks and line.landmark in parent:
            first.setdefault(parent[line.landmark], i)
    taken = [yes or (line.heading and not line.outside and i < first.get(line.landmark, -1)) for i, (yes, line) in enumerate(zip(taken, lines, strict=True))]
    if not marks and where:
        # Without an article element: the containers of the regions and what lies between them, if it is not outside; a heading
        # right before a region opens it.
        boxes = {lines[i].box for i in where}
        begin, end = where[0], where[-1]
        # Smoothing pulls a long line at the edge of a region down to what lies around; its own ratio brings it back.
        while begin > 0 and own[begin - 1] >= border and not links[begin - 1]:
            begin -= 1
        while end + 1 < len(lines) and own[end + 1] >= border and not links[end + 1]:
            end += 1
        while begin > 0 and lines[begin - 1].heading and not lines[begin - 1].outside:
            begin -= 1
        # Lines of links count between others, not at the edges, where only smoothing lifts them.
        taken = [(yes and (begin <= i <= end or not link)) or ((begin <= i <= end or line.box in boxes) and not line.outside and not link) for i, (yes, line, link) in enumerate(zip(taken, lines, links, strict=True))]
    return [line for yes, line in zip(taken, lines, strict=True) if yes]


def main_text(html: str | None) -> str:
    """The blocks of the main content, a space between. Null, empty and text-free pages give an empty text."""
    if not html:
        return ""
    parser = Lines()
    parser.feed(html)
    return " ".join(line.text for line in content(parser.done(), parser.parent))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` for every row, from the whole html. Null html gives an empty text; null ids and urls and
    repeated rows are kept; markup that is broken or never closed is read as far as it says something. Other columns are
    not read."""

    def run(batch: pa.RecordBatch):
        for a, b in slices([len(h) if h else 0 for h in batch.column(2).to_pylist()]):
            texts = [main_text(h) for h in batch.column(2).slice(a, b - a).to_pylist()]
            yield batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), texts, [len(t) for t in texts]

    read = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.col(f"`{html_col}`").cast("string").alias("html"))
    return map_batches(read, run, "page_id long, url string, text string, n_chars long")
