"""Main text of web pages: parser events, text-to-tag ratio per line, Gaussian smoothing, threshold clustering.

The standard library's parser gives the events of a page; a line ends wherever a block begins or ends. A line's ratio is its
characters by its tags. Ratios are smoothed along the page, and lines at or above a share of their standard deviation are
content. The region that is kept is the innermost container that holds most of the content's characters, or, if that is
the whole page, the span from its first to its last content line; inside it short lines are kept too.

Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments are known by their tag, role
or class (RULES), and their text takes part in nothing. An element so known that holds most of the articles is a frame, not a part.

Null html counts as empty; an empty page, or one without text outside those parts, gives an empty string. Very long pages are read
in one pass: broken markup is first made whole in linear time, where the parser would search again and again. Repeated rows
give repeated rows. An empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsecheck.llm.common import batch_of, fields, per_slice

#: Lines that smoothing looks at to each side, and the bar as a share of the standard deviation.
RADIUS, BAR = 2, 1.0
#: The share of the content's characters that a region holds; share of a line in links that makes it a menu's.
MOST, LINKED = 0.8, 0.5
#: Characters of a tag from which only its name is read.
LONG_TAG = 4096

# Elements of HTML, by what they mean for lines.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav "
    "noscript ol optgroup option p pre search section select summary table tbody td template textarea tfoot th thead title tr ul".split()
)
CONTAINERS = frozenset("html body div article main section center td form".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: An element that ends when one of these begins, unless a list or table that it stands in is opened between.
ENDS = {
    "p": BLOCKS - {"button", "option", "optgroup"},
    "li": {"li"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "td": {"td", "th", "tr", "tbody", "tfoot", "thead"},
    "th": {"td", "th", "tr", "tbody", "tfoot", "thead"},
    "tr": {"tr", "tbody", "tfoot", "thead"},
    "tbody": {"tbody", "tfoot", "thead"},
    "thead": {"tbody", "tfoot"},
    "option": {"option", "optgroup"},
    "head": BLOCKS - {"noscript", "template", "title"},
}
INNER = {e: frozenset(x) for e, x in ENDS.items() if e not in ("p", "head")}

# Fixed values (RULES): what is no part of an article.
NEVER = frozenset("applet audio canvas head iframe math noframes noscript object script style svg template title video".split())
APART = frozenset("aside button dialog footer form header menu nav search select textarea".split())
#: These are no frames of a page, whatever they hold.
PARTS = frozenset("aside button footer menu nav search select textarea".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
NAMES = frozenset(
    "ad ads adsense adslot advert advertisement advertisements adverts alert aside banner breadcrumb breadcrumbs comment commentlist comments consent contentinfo cookie cookies disqus footer gdpr header "
    "login masthead menu modal nav navbar navigation newsletter notice notices notification overlay pager pagination paywall popup promo promotion recommended related respond share sharing sidebar signup "
    "skip social sponsor sponsored subscribe subscription toc toolbar topbar widget widgets".split()
)
#: Classes such as `has-sidebar` tell of a page, not of a part.
OF_A_PAGE = frozenset("has is no not with without hide show js".split())

# A page's tags. Attribute values in quotes are read whole; a tag that is not closed so ends at the next bracket.
TAG = r"""(?:[^>=]{1,2000}|=\s*+(?:"[^"]{0,2000}"|'[^']{0,2000}'|(?!["']))){0,64}+>"""
MARKUP = re.compile(
    rf"<!--(?:>|->|.*?--!?>|.*\Z)|<(?P<raw>script|style)(?=[\s/>])(?:{TAG}|[^>]*(?:>|\Z))(?:.*?</(?P=raw)(?=[\s/>])[^>]*(?:>|\Z)|.*\Z)"
    rf"|(?P<tag></?(?P<name>[a-zA-Z][^\s/>]*)(?:(?=[\s/>])(?P<whole>{TAG})|[^>]*(?:>|\Z)))|<[!?/][^>]*(?:>|\Z)|(?P<sign><)",
    re.S | re.I,
)


def _tidy(match: re.Match) -> str:
    if match["sign"]:
        return "&lt;"
    tag = match["tag"]
    if not tag:
        return " " if match["raw"] is None else "<wbr>"  # a script counts as a tag
    if match["whole"] and len(tag) <= LONG_TAG and "<" not in tag[1:]:
        return tag
    if tag[-1] != ">":
        return ""  # the page ends inside
    name = re.sub(r"[^a-zA-Z0-9-]", "-", match["name"][:40])
    return f"</{name}>" if tag[1] == "/" else f"<{name}>"


def _words(value: str) -> set[str]:
    """The parts of class names and ids; without those that tell of a page."""
    found: set[str] = set()
    for name in value.split()[:40]:
        parts = [p.lower() for p in re.findall(r"[A-Z]?[a-z]+|[A-Z]+", name)]
        if parts and parts[0] not in OF_A_PAGE:
            found.update(parts)
    return found


class Lines(HTMLParser):
    """Lines and elements of one page, from the parser's events."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        # Elements in order of appearance; the first stands for the page.
        self.parents, self.names, self.apart, self.never = [0], ["html"], [False], [False]
        self.open, self.counts = [0], {}
        self.element, self.size, self.tags, self.linked, self.texts = [], [], [], [], []
        self.parts: list[str] = []
        self.n_tags = self.n_linked = self.links = 0

    def flush(self) -> None:
        """A line ends here. One without text and tags is none."""
        text = " ".join("".join(self.parts).split())
        if text or self.n_tags:
            self.element.append(self.open[-1])
            self.size.append(len(text))
            self.tags.append(self.n_tags)
            self.linked.append(self.n_linked)
            self.texts.append(text)
        self.parts, self.n_tags, self.n_linked = [], 0, 0

    def pop_to(self, place: int) -> None:
        self.flush()
        for e in self.open[place:]:
            self.counts[self.names[e]] -= 1
        del self.open[place:]

    def close_for(self, tag: str) -> None:
        """What the beginning of `tag` ends."""
        while True:
            inner = self.names[self.open[-1]]
            if len(self.open) > 1 and tag in ENDS.get(inner, ()):
                self.pop_to(len(self.open) - 1)
                continue
            return

    def unfinished(self, tag: str) -> None:
        """An open item of the same list or row that a new one ends, though other elements stand open in it."""
        for at in range(len(self.open) - 1, max(0, len(self.open) - 32), -1):
            name = self.names[self.open[at]]
            if tag in INNER.get(name, ()):
                self.pop_to(at)
                return
            if name in ("ul", "ol", "dl", "table", "menu", "select", "article", "main", "body"):
                return

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "br":
            self.parts.append(" ")
        block = tag in BLOCKS
        if block:
            self.flush()
            self.close_for(tag)
            if tag in ("li", "dt", "dd", "td", "th", "tr", "option"):
                self.unfinished(tag)
                self.close_for(tag)
        self.n_tags += 1
        if tag in VOID:
            return
        if tag == "a":
            self.links = 1
        never, apart = self.is_apart(tag, attrs)
        if not block and not never and not apart:
            return
        if never or apart:
            self.flush()
        parent = self.open[-1]
        self.open.append(len(self.names))
        self.counts[tag] = self.counts.get(tag, 0) + 1
        self.parents.append(parent)
        self.names.append(tag)
        self.apart.append(apart)
        self.never.append(never)

    def is_apart(self, tag: str, attrs: list) -> tuple[bool, bool]:
        if tag in NEVER:
            return True, True
        if tag in ("html", "body", "main"):
            return False, False
        apart, words = tag in APART, set()
        for name, value in attrs:
            if name == "hidden":
                return True, True
            value = value or ""
            if name in ("class", "id"):
                words |= _words(value)
            elif name == "role":
                apart = apart or value.strip().lower() in ROLES
            elif name == "aria-hidden" and value.strip().lower() == "true" or name == "style" and re.search(r"display\s*:\s*none", value[:400], re.I):
                return True, True
        return False, apart or bool(words & NAMES)

    def handle_endtag(self, tag: str) -> None:
        self.n_tags += 1
        if tag == "a":
            self.links = 0
        if tag == "p" and not self.counts.get("p"):
            self.flush()
        if not self.counts.get(tag):
            return
        place = len(self.open) - 1
        while self.names[self.open[place]] != tag:
            place -= 1
        self.pop_to(place)

    def handle_data(self, data: str) -> None:
        self.parts.append(data)
        if self.links:
            self.n_linked += len(data.strip())


def smoothed(ratios: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Means weighted by a Gaussian over `radius` neighbours to each side; weights at the ends add up to one too."""
    reach = np.arange(-radius, radius + 1)
    kernel = np.exp(-(reach**2) / (2.0 * max(radius, 1)))
    full = np.convolve(ratios, kernel)[radius : radius + len(ratios)]
    return full / np.convolve(np.ones(len(ratios)), kernel)[radius : radius + len(ratios)]


class Page:
    """One page: its lines, which of them are content, and the region of the article."""

    def __init__(self, html: str):
        lines = Lines()
        lines.feed(MARKUP.sub(_tidy, html))
        lines.close()
        lines.flush()
        self.texts, self.names = lines.texts, lines.names
        parents = lines.parents
        n = len(parents)
        self.parents = parents
        element = np.array(lines.element, dtype=np.int64)
        # An element that holds most of the articles' characters is a frame of the page.
        own_article = [False] * n
        for e in range(1, n):
            own_article[e] = own_article[parents[e]] or (self.names[e] in ("article", "main") and not lines.apart[e] and not lines.never[e])
        held = np.zeros(n, dtype=np.int64)
        for e, size in zip(lines.element, lines.size):
            held[e] += size * own_article[e]
        half = held.sum() / 2
        held = held.tolist()
        for e in range(n - 1, 0, -1):
            held[parents[e]] += held[e]
        frame = [h > half and name not in PARTS for h, name in zip(held, self.names)]
        away, in_article = [False] * n, [False] * n
        heads = [False] * n  # the header of an article, of which headings stay
        for e in range(1, n):
            p = parents[e]
            in_article[e] = in_article[p] or self.names[e] in ("article", "main")
            own = lines.never[e] or (lines.apart[e] and not frame[e])
            if own and not lines.never[e] and self.names[e] == "header" and in_article[p]:
                own, heads[e] = False, True
            heads[e] = heads[e] or (heads[p] and self.names[e] not in HEADINGS)
            away[e] = away[p] or own
        self.element = element
        self.kept = ~(np.array(away)[element] | np.array(heads)[element]) if len(element) else np.zeros(0, dtype=bool)
        size = np.array(lines.size, dtype=float) * self.kept
        self.kept &= size > 0
        self.linked = np.array(lines.linked) > LINKED * np.maximum(size, 1)
        self.ratios = size / np.maximum(np.array(lines.tags), 1)
        self.smooth = smoothed(self.ratios) if len(size) else self.ratios
        bar = BAR * self.smooth.std() if len(size) else 0.0
        # Beside an article, smoothing raises menus too: there the line's own ratio decides.
        menu = self.linked & (self.ratios < bar)
        self.content = (self.smooth >= bar) & self.kept & ~menu
        self.size = size

    def region(self) -> np.ndarray:
        """Which lines are the article's."""
        if not self.content.any():
            return self.kept
        n = len(self.parents)
        weight = np.bincount(self.element[self.content], weights=self.size[self.content], minlength=n)
        total = weight.sum()
        for e in range(n - 1, 0, -1):
            weight[self.parents[e]] += weight[e]
        inner = max((e for e in range(n) if weight[e] >= MOST * total and self.names[e] in CONTAINERS), default=0)
        outer = inner
        while outer and self.names[outer] not in ("article", "main"):
            outer = self.parents[outer]
        chosen = outer or inner
        if self.names[chosen] in ("html", "body"):
            return self.span()
        inside = [False] * n
        for e in range(chosen, n):
            inside[e] = e == chosen or inside[self.parents[e]]
        return self.kept & np.array(inside)[self.element]

    def span(self) -> np.ndarray:
        """From the first to the last content line, with the headings before; lines of links below the bar are menus."""
        places = np.flatnonzero(self.content)
        first, last = places[0], places[-1]
        before = first - 1
        while before >= 0 and (not self.kept[before] or self.names[self.element[before]] in HEADINGS):
            first = before if self.kept[before] else first
            before -= 1
        within = np.zeros(len(self.kept), dtype=bool)
        within[first : last + 1] = True
        return self.kept & within & (self.content | ~self.linked)

    def text(self) -> str:
        return "\n".join(self.texts[i] for i in np.flatnonzero(self.region()))


def main_text(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """key, url, text and n_chars (code points) of every page. Nothing is shuffled."""
    rows = pages.select(F.col(f"`{key}`").alias("key"), F.col(f"`{url}`").alias("url"), F.col(f"`{html}`").cast("string").alias("text"))

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [Page(b.decode(errors="replace")).text() if b else "" for b in batch.column("text").cast(pa.large_binary()).to_pylist()]
            return batch_of(("key", batch.column("key")), ("url", batch.column("url")), ("text", pa.array(texts, pa.string())), ("n_chars", np.array(list(map(len, texts)), dtype=np.int64)))

        return step

    schema = fields(rows, "key", ("url", rows.schema["url"].dataType.simpleString()), ("text", "string"), ("n_chars", "long"))
    return per_slice(rows, make, schema).select(F.col("key").alias(key), F.col("url").alias(url), "text", "n_chars")
