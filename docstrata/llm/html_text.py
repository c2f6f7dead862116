"""Main text of HTML pages from parser events, text-to-tag ratios, Gaussian smoothing and threshold clustering.

A page is a stream of events of the standard library's parser. Block elements cut it into lines; each has its text
and the number of tags met since the line before. The ratio of text to tags, smoothed over neighbouring lines, is
split in two clusters; the upper one marks where the article lies. The article is then the element that holds those
lines, without the parts that its markup names as something else, so that short paragraphs aren't lost.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StringType, StructField, StructType

# Elements by what they do to text.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead title tr ul".split())
CONTAINERS = frozenset("article aside blockquote body details dialog div dl fieldset figure footer form header main menu nav ol search section table tbody td tfoot th thead tr ul".split())
HIDDEN = frozenset("script style noscript template head title svg math iframe object embed canvas audio video textarea select button datalist".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ASIDE = frozenset("nav aside footer form menu dialog search".split())
ARTICLES = frozenset(("article", "main"))
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
_NAMES = r"(?:nav|navbar|navigation|menu|menubar|sidebar|side-bar|aside|footer|masthead|site-header|page-header|breadcrumbs?|ads?|adverts?|advertisement|advertising|adsbygoogle|sponsor(?:ed)?|promo(?:tion)?|banner|cookies?|consent|gdpr|notices?|popup|modal|newsletter|subscribe|subscription|share|sharing|social|comments?|commentlist|discussions?|teasers?|respond|repl(?:y|ies)|disqus|related|recommend(?:ed|ations?)?|widgets?|login|signup|register|toolbar|pagination|pager|skip-link)"
# words that say where or in what form such a part stands; other words beside its name ("has-sidebar") tell of something else
_FORMS = r"(?:area|article|bar|block|body|bottom|box|button|buttons|cards?|col|column|container|content|entry|fb|fixed|footer|form|global|google|header|holder|inner|item|items|left|links?|list|main|mobile|outer|overlay|page|panel|placeholder|posts?|primary|reader|right|row|secondary|section|site|slot|sticky|text|top|unit|user|wrap|wrapper)"
PART = re.compile(rf"[^a-z]*(?:(?P<name>{_NAMES})|{_FORMS})(?=[^a-z]|$)[^a-z]*")
SIGMA, REACH = 1.0, 2
#: An article or main element is a root of the text if it holds this share of the upper cluster's text.
ROOT_SHARE = 0.2
#: So much text in the upper cluster of what is outside of all named containers is an article.
ARTICLE_CHARS = 200
FEED = 1 << 16
# Elements that end a drawing or formula they stand in, and elements of drawings that hold such ones.
BREAKOUT = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
FOREIGN = frozenset(("svg", "math"))
POINTS = frozenset(("foreignobject", "desc", "annotation-xml"))


def names_aside(token: str) -> bool:
    """Whether a whole class or id is a name of a part beside the article, alone or joined with such words."""
    at, found = 0, False
    while at < len(token):
        part = PART.match(token, at)
        if not part:
            return False
        at, found = part.end(), found or part["name"] is not None
    return found


class _Lines(HTMLParser):
    """Collects lines: (text, tags, innermost container, set aside by markup, all in links). Containers set aside by name alone are in ``named``.

    Containers are numbered as they open, 0 is the page; ``parents`` has the one around each, a smaller number. What
    is open is counted, so the time is linear in the page however deep its elements are nested.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, int, bool]] = []  # element, its number, whether it is set aside
        self.apart = self.tags = self.in_articles = 0
        self.parents = [0]
        self.open: Counter[str] = Counter()
        self.unseen: list[str] = []
        self.parts: list[str] = []
        self.lines: list[tuple[str, int, int, bool, bool]] = []
        self.linked = False
        self.plain = 0  # characters of the line that are in no link
        self.articles: set[int] = set()
        self.named: set[int] = set()
        self.bodies: set[int] = set()

    def flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            self.parts = []
            if text:
                self.lines.append((text, max(1, self.tags), self.stack[-1][1] if self.stack else 0, self.apart > 0, not self.plain))
                self.tags = 0
            self.plain = 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag in HIDDEN:
            if tag in BLOCKS:
                self.flush()
            if tag not in VOID:
                self.unseen.append(tag)
            return
        if self.unseen:
            while self.unseen and self.unseen[-1] in FOREIGN and tag in BREAKOUT:
                self.unseen.pop()  # the drawing was not closed
            if self.unseen and tag in POINTS and FOREIGN & set(self.unseen):
                self.unseen.append(tag)
            if self.unseen and tag != "body":
                return
            self.unseen = []  # the head was not closed
        if tag == "br":
            self.parts.append(" ")
        if tag == "a":
            self.linked = True
        if tag not in BLOCKS:
            return
        self.flush()
        if tag in CONTAINERS:
            held = {k: (v or "").lower() for k, v in attrs if k in ("class", "id", "role", "hidden", "aria-hidden", "style")}
            apart = tag in ASIDE or tag == "header" and not self.in_articles or held.get("role") in ROLES or "hidden" in held or held.get("aria-hidden") == "true" or "display:none" in held.get("style", "").replace(" ", "")
            number = len(self.parents)
            self.parents.append(self.stack[-1][1] if self.stack else 0)
            if not apart and tag not in ("body", "main") and any(map(names_aside, f"{held.get('class', '')} {held.get('id', '')}".split())):
                self.named.add(number)
            if tag in ARTICLES and not apart:
                self.articles.add(number)
                self.in_articles += 1
            if tag == "body":
                self.bodies.add(number)
            self.stack.append((tag, number, apart))
            self.open[tag] += 1
            self.apart += apart

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if self.unseen:
            if tag in self.unseen:
                while self.unseen.pop() != tag:
                    pass
            return
        if tag == "a":
            self.linked = False
        if tag in BLOCKS:
            self.flush()
        if tag in CONTAINERS and tag not in ("body",) and self.open[tag]:
            while True:
                t, number, apart = self.stack.pop()
                self.open[t] -= 1
                self.apart -= apart
                self.in_articles -= number in self.articles
                if t == tag:
                    break

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in HIDDEN and tag not in VOID:
            self.tags += 1
        else:
            self.handle_starttag(tag, attrs)

    def handle_data(self, data: str) -> None:
        if not self.unseen:
            self.parts.append(data)
            self.plain += 0 if self.linked or data.isspace() else len(data)


def smooth(values: np.ndarray, sigma: float = SIGMA, reach: int = REACH) -> np.ndarray:
    """Gaussian mean over the neighbours that exist."""
    weights = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return np.convolve(values, weights)[reach : reach + len(values)] / np.convolve(np.ones(len(values)), weights)[reach : reach + len(values)]


def upper_cluster(values: np.ndarray) -> np.ndarray:
    """Which values lie in the upper of two clusters; all of them if they are alike."""
    low, high = values.min(), values.max()
    if high <= 2 * low:
        return np.ones(len(values), bool)
    for _ in range(50):
        cut = (low + high) / 2
        over = values >= cut
        new = values[~over].mean(), values[over].mean()
        if new == (low, high):
            break
        low, high = new
    return values >= (low + high) / 2


def _sums(parents: list[int], lines: list[tuple[str, int, int, bool, bool]], values: list[int]) -> list[int]:
    """The sum over the lines in each container, itself and what it holds."""
    out = [0] * len(parents)
    for x, v in zip(lines, values):
        out[x[2]] += v
    for c in range(len(parents) - 1, 0, -1):
        out[parents[c]] += out[c]
    return out


def _within(parents: list[int], some: set[int]) -> list[bool]:
    """Whether each container is one of ``some`` or inside of one."""
    out = [0 in some] * len(parents)
    for c in range(1, len(parents)):
        out[c] = c in some or out[parents[c]]
    return out


def _regions(lines: list[tuple[str, int, int, bool, bool]]) -> list[bool]:
    """Which lines lie where the smoothed ratio of text to tags is in its upper cluster; links alone don't, if others do."""
    over = upper_cluster(smooth(np.array([len(x[0]) / x[1] for x in lines])))
    plain = over & ~np.array([x[4] for x in lines])
    return (plain if plain.any() else over).tolist()


def _set_aside(parser: _Lines, lines: list[tuple[str, int, int, bool, bool]]) -> set[int]:
    """The containers that are left out for their names: not those that hold the article.

    A container holds it if most of the upper cluster's text is in an article or main element of it. Where no such
    element with text stands outside of named containers, any article or main element counts; and a container without
    one is spared that has most of that text and of the page's, unless the upper cluster of what is in no named container
    has 200 characters, or a fifth as many as that of the page: then the article is there, however long its comments are.
    """
    parents = parser.parents
    if not parser.named:
        return set()
    sizes = [len(x[0]) for x in lines]
    size = _sums(parents, lines, [n * ok for n, ok in zip(sizes, _regions(lines))])  # text of the upper cluster by container
    full = _sums(parents, lines, sizes)
    named = _within(parents, parser.named)
    free = any(full[a] and not named[a] for a in parser.articles)
    holds = [False] * len(parents)
    for c in range(len(parents) - 1, 0, -1):
        article = c in parser.articles and full[c] > 0 and (not free or 2 * size[c] > size[0])
        holds[parents[c]] = holds[parents[c]] or holds[c] or article
    outside = [x for x in lines if not named[x[2]]]
    text = sum(len(x[0]) for x, ok in zip(outside, _regions(outside) if outside else []) if ok and not x[4])
    free = free or text >= min(ARTICLE_CHARS, ROOT_SHARE * size[0]) > 0
    return {c for c in parser.named if not holds[c] and (free or 2 * size[c] <= size[0] or 2 * full[c] <= full[0])}


def main_text(html: str | None) -> str:
    """The article's blocks, one a line. Null, empty or text-less pages give an empty text."""
    if not html:
        return ""
    parser = _Lines()
    i = 0
    while i < len(html):
        step = max(FEED, len(parser.rawdata))  # what the parser still holds, an open comment say, is gone through again
        parser.feed(html[i : i + step])
        i += step
    if parser.rawdata.startswith("<!--"):
        parser.rawdata = ""  # a comment that isn't closed reaches to the end
    parser.close()
    parser.flush()
    lines, parents = [x for x in parser.lines if not x[3]], parser.parents
    if not lines:
        return ""
    apart = _within(parents, _set_aside(parser, lines))
    lines = [x for x in lines if not apart[x[2]]]
    if not lines:
        return ""
    marks = _regions(lines)
    size = _sums(parents, lines, [len(x[0]) * ok for x, ok in zip(lines, marks)])
    roots = {a for a in parser.articles if size[a] >= ROOT_SHARE * size[0]}
    if roots:
        inside = _within(parents, roots)
        kept = [inside[x[2]] for x in lines]
    else:
        # the lowest element that holds all marked lines; of the whole page, what lies between the first, with a line
        # before it in the same element, and the last of them
        count = _sums(parents, lines, [int(ok) for ok in marks])
        lowest = max(c for c, n in enumerate(count) if n == count[0])
        inside = _within(parents, {lowest})
        marked = [k for k, ok in enumerate(marks) if ok]
        first, last = marked[0], marked[-1]
        above, c = set(), lowest
        while c:
            above.add(c)
            c = parents[c]
        if above - parser.bodies:
            first, last = 0, len(lines) - 1
        elif first and lines[first - 1][2] == lines[first][2]:
            first -= 1
        kept = [first <= k <= last and inside[x[2]] for k, x in enumerate(lines)]
    return "\n".join(x[0] for x, ok in zip(lines, kept) if ok)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row a page: its id, url and text (the article's blocks in page order, joined by a line feed).

    Every page gives one row, whatever it repeats; a null or empty html gives an empty text, an empty table no row.
    Other columns, whatever their names, are left out. Pages are read whole, in time linear in their length however
    deep their elements are nested; a task holds one batch of rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([main_text(x.as_py()) for x in b.column(2)], pa.string())], [id_col, url_col, "text"])

    schema = StructType([StructField(id_col, pages.schema[id_col].dataType), StructField(url_col, StringType()), StructField("text", StringType())])
    return pages.select(id_col, url_col, html_col).mapInArrow(run, schema)
