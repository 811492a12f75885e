"""Main text of web pages (operator 6).

The standard library's parser streams events; they become lines (one block element's text
each) with the tags they hold and the parts of the page they stand in.

1. Scripts, styles, form fields, media and hidden elements never give lines. Menus, headers, footers, asides and
   forms, and elements whose class, id or role names such a part (adverts, notices, comments, sharing ...), are
   set aside, but not when the page's article stands in them: no class word loses an article.
2. Each remaining line has its text-to-tag ratio; the ratios are smoothed with a Gaussian,
   and lines at or above one standard deviation form the content clusters.
3. The clusters select the region: the article or main element with the most clustered
   text if it holds a quarter of it, else the innermost container that holds four fifths of it. Every line of the
   region is kept, short ones too; outside an article, lines that are mostly links and in
   no cluster are not.

Work and memory follow the length of the page, whatever its nesting.

Defined results: a null or empty html, and one without text, give an empty text; broken
markup is taken as browsers do in the simple cases (open paragraphs end at the next
block, unknown end tags are ignored, an unknown declaration is a comment up to its ``>``); every row gives
one row; only the three columns are read."""

from __future__ import annotations

import math
import re
from html.parser import HTMLParser

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.llm.common import prepared

# HTML element names by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption "
                  "figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main nav ol p pre section summary "
                  "table tbody td tfoot th thead tr ul".split())
CONTAINER = frozenset("article body center div main section table tbody td tr".split())
NEVER = frozenset("applet audio button canvas datalist embed head iframe input map noframes noscript object option script "
                  "select style svg template textarea title video".split())
OUTSIDE = frozenset("aside dialog footer form header menu nav".split())
FIRM = frozenset("aside footer menu nav".split())  # outside however much of the text they hold
ENDS_AT_BLOCK = frozenset("p h1 h2 h3 h4 h5 h6".split())
# Words in class, id and role that name a part outside the article.
NEVER_NAMED = frozenset("ad ads advert advertisement advertising banner breadcrumb breadcrumbs comment comments "
                        "complementary consent contentinfo cookie cookies copyright dialog discussion "
                        "disqus footer gdpr header hidden login masthead menu menubar modal nav navbar navigation "
                        "newsletter notice outbrain pager pagination popup promo promoted promotion recommended "
                        "related replies reply respond search share sharing sidebar signup skip skyscraper social "
                        "sponsor sponsored sponsorship subscribe subscription taboola toolbar".split())
# Names of readers' comments, and words that make a name a state of the page or the article.
COMMENTS = frozenset("comment comments discussion disqus replies reply respond".split())
STATES = frozenset("active closed count disabled enabled fixed has is no off on open sticky with without".split())
WORDS = re.compile(r"[a-z]+")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


def named(attrs) -> frozenset[str]:
    """The words of NEVER_NAMED that begin or end a name in class, id or role."""
    found: set[str] = set()
    for key, value in attrs:
        if key in ("class", "id", "role") and value:
            for name in value.lower().split():
                words = WORDS.findall(name)
                if words and STATES.isdisjoint(words):
                    found.update(NEVER_NAMED.intersection((words[0], words[-1])))
    return frozenset(found)


def hidden(attrs) -> bool:
    return any(key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and value and HIDDEN.search(value.lower())
               for key, value in attrs)


class Part:
    """A container, or an element that is set aside unless the article stands in it."""

    __slots__ = ("parent", "outside", "firm", "article", "inline", "line", "mass", "clustered", "depth", "number", "last", "out")

    def __init__(self, parent: "Part | None", number: int, outside: bool = False, firm: bool = False, article: bool = False, inline: bool = False):
        self.parent, self.outside, self.firm, self.inline, self.line = parent, outside, firm, inline, None
        self.article = parent.article if parent and parent.article else self if article else None  # the outermost one
        self.mass, self.clustered, self.number, self.last, self.out = 0, 0, number, number, False
        self.depth = parent.depth + 1 if parent else 0


class Line:
    """One block's text with what the region choice needs to know."""

    __slots__ = ("chunks", "tags", "linked", "part", "text")

    def __init__(self, part: Part):
        self.chunks: list[str] = []
        self.tags, self.linked, self.part, self.text = 0, 0, part, ""


class Lines(HTMLParser):
    """Parser events to lines."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts = [Part(None, 0)]
        self.part = self.parts[0]
        self.lines: list[Line] = []
        self.open: list[tuple[str, bool, Part]] = []  # (element, never text, part before it)
        self.count: dict[str, int] = {}  # open elements by name
        self.never = 0
        self.line: Line | None = None

    def parse_marked_section(self, i, report=1):
        return self.parse_bogus_comment(i)

    def handle_starttag(self, tag, attrs):
        if tag in BLOCK:
            self.line = None
            if self.count.get("head"):
                self.end("head")  # an open head ends where the body begins
            if self.open and self.open[-1][0] in ENDS_AT_BLOCK or tag == "li" and self.open and self.open[-1][0] == "li":
                self.pop()
            while self.count.get("p") and self.inside_paragraph():
                self.end("p")
        elif self.line is not None:
            self.line.tags += 1
        if tag in VOID:
            if self.line is not None and tag == "br":
                self.line.chunks.append(" ")
            return
        page = tag in ("html", "body")
        never = tag in NEVER or not page and hidden(attrs)
        self.open.append((tag, never, self.part))
        self.count[tag] = self.count.get(tag, 0) + 1
        self.never += never
        article = tag in ("article", "main")
        names = frozenset() if page or article else named(attrs)
        outside = tag in OUTSIDE or bool(names)
        if outside or tag in CONTAINER:
            self.part = Part(self.part, len(self.parts), outside, tag in FIRM or not names.isdisjoint(COMMENTS), article, tag not in BLOCK)
            self.parts.append(self.part)

    def inside_paragraph(self) -> bool:
        """A paragraph is open and no container was opened since."""
        for tag, _, _ in reversed(self.open):
            if tag == "p":
                return True
            if tag in BLOCK:
                return False
        return False

    def pop(self):
        tag, never, self.part = self.open.pop()
        self.count[tag] -= 1
        self.never -= never

    def end(self, tag):
        while self.open[-1][0] != tag:
            self.pop()
        self.pop()

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag in BLOCK:
            self.line = None
        elif self.line is not None:
            self.line.tags += 1
        if not self.count.get(tag):
            return
        for at in range(len(self.open) - 1, -1, -1):
            if self.open[at][0] == tag:
                self.end(tag)
                return
            if self.open[at][0] in CONTAINER and tag not in CONTAINER and tag not in BLOCK:
                return  # an inline end tag does not close containers

    def handle_data(self, data):
        if self.never:
            return
        line = self.part.line if self.part.inline else self.line  # a part within a line has a line of its own
        if line is None or line.part is not self.part:
            if not data.strip():
                if line is not None:
                    line.chunks.append(data)
                return
            line = Line(self.part)
            self.lines.append(line)
            if self.part.inline:
                self.part.line = line
            else:
                self.line = line
        line.chunks.append(data)
        line.linked += len(data) * (self.count.get("a", 0) > 0)


def smoothed(ratios: list[float], radius: int = 2, sigma: float = 1.0) -> list[float]:
    """Gaussian smoothing, normalised at the ends."""
    kernel = [math.exp(-k * k / (2 * sigma * sigma)) for k in range(-radius, radius + 1)]
    out = []
    for i in range(len(ratios)):
        near = [(ratios[i + k], kernel[k + radius]) for k in range(-radius, radius + 1) if 0 <= i + k < len(ratios)]
        out.append(sum(r * w for r, w in near) / sum(w for _, w in near))
    return out


def content_clusters(lines: list[Line]) -> list[bool]:
    """Lines whose smoothed text-to-tag ratio reaches one standard deviation of the page's."""
    ratios = smoothed([len(x.text) / max(1, x.tags) for x in lines])
    mean = sum(ratios) / len(ratios)
    threshold = math.sqrt(sum((r - mean) ** 2 for r in ratios) / len(ratios))
    return [r >= threshold for r in ratios]


def set_aside(parts: list[Part], lines: list[Line]) -> None:
    """Marks the parts (``out``) that are not article text."""
    for x in lines:
        x.part.mass += len(x.text)
    among = [False] * len(parts)  # inside an outside part
    for p in parts:
        among[p.number] = p.outside or p.parent is not None and among[p.parent.number]
    for p in reversed(parts[1:]):
        p.parent.mass += p.mass
        p.parent.last = max(p.parent.last, p.last)
    keep: Part | None = None  # nothing that holds this part is set aside
    articles = [p for p in parts if p.article is p and p.mass]
    if articles:
        most = max(articles, key=lambda p: (p.mass, -p.number))
        if not any(4 * p.mass >= most.mass for p in articles if not among[p.number]):
            keep = most
    else:
        wide = [p for p in parts if p.outside and not p.firm and 2 * p.mass > parts[0].mass]
        keep = wide[-1] if wide else None
    held = set()
    while keep is not None:
        held.add(keep.number)
        keep = keep.parent
    for p in parts:
        p.out = p.parent is not None and p.parent.out or p.outside and p.number not in held


def region(parts: list[Part], lines: list[Line], content: list[bool]) -> list[Line]:
    """The lines of the region that the clusters select."""
    mass: dict[int, int] = {}
    for x, c in zip(lines, content):
        x.part.clustered += len(x.text) * c
        if x.part.article is not None:
            mass[x.part.article.number] = mass.get(x.part.article.number, 0) + len(x.text) * (1 + 9 * c)
    for p in reversed(parts[1:]):
        p.parent.clustered += p.clustered
    total = parts[0].clustered
    best = max(mass, key=lambda k: (mass[k], -k)) if mass else None
    if best is not None and 4 * parts[best].clustered >= total:
        return [x for x in lines if x.part.article is parts[best]]
    home = max((p for p in parts if 5 * p.clustered >= 4 * total), key=lambda p: (p.depth, p.number))
    return [x for x, c in zip(lines, content) if home.number <= x.part.number <= home.last and (c or 2 * x.linked < len(x.text))]


def main_text(html: str | None) -> str:
    """The article's blocks in page order, one to a line."""
    parser = Lines()
    parser.feed(html or "")
    parser.close()
    for x in parser.lines:
        x.text = " ".join("".join(x.chunks).split())
    lines = [x for x in parser.lines if x.text]
    set_aside(parser.parts, lines)
    lines = [x for x in lines if not x.part.out]
    if not lines:
        return ""
    return "\n".join(x.text for x in region(parser.parts, lines, content_clusters(lines)))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    prepared(pages.sparkSession)

    def run(batches):
        import pyarrow as pa
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                texts = [main_text(h) for h in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                        F.col(html_col).cast("string").alias("html")).mapInArrow(
        run, "page_id long, url string, text string, n_chars long")
