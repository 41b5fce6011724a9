"""Main text of pages by tag-path ratios.

A page is read once as a stream of tags and text. Each block of text belongs to the path of tags, with their classes,
from the root down to it. Per path the length of text, the number of blocks, the length inside links and the
punctuation are summed; two ratios (text to blocks, punctuation to text) are smoothed over neighbouring paths (those
with the same parent), fused by multiplication, and compared with a threshold. Blocks whose paths reach it are the
content nodes. The smallest element that holds `share` of their text is the article; where it stands in an <article>
or <main>, that is. The article's own short paragraphs and headings stay with it, whatever their paths score.

What stands around is a prior: blocks under menus, headers, footers, sidebars, notices, adverts, forms and reader
comments (by tag, role or a whole class or id of such words on a container) have no share in the ratios and are left
out. Outside an <article> or <main> so are blocks of paths under the threshold that are mostly links.

Edge cases: null, empty or tagless html gives its own text or an empty string; unclosed and wrongly nested tags
are closed as browsers do (a paragraph ends at the next block, a drawing or a list of options at the next block that
can't be in it); where no path reaches the threshold all that doesn't stand around is text; repeated rows repeat; other
columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: Elements by what they do.
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
AROUND = frozenset("nav header footer aside form button head menu dialog noscript template".split())
DRAWN = frozenset("svg math select option optgroup".split())
CONTAINERS = frozenset("div section ul ol dl table tbody tr td span center fieldset details figure blockquote li header p".split())
ARTICLES = frozenset("article main".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu".split())

#: Parts of class names and ids of what stands around an article, and the parts that may stand beside them.
NOTICES = frozenset(
    "ad ads advert adverts advertisement advertising banner promo promos promotion sponsor sponsored cookie cookies consent notice notices gdpr popup modal "
    "nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars widget widgets related recommended recommendations share sharing social subscribe "
    "newsletter footer header masthead comment comments replies reply disqus login signup copyright pager pagination toolbar".split()
)
BESIDE = frozenset("site page main top bottom left right upper lower box bar list wrap wrapper container inner outer block slot item items links link area unit holder panel row col column group content form section thread js button buttons icon icons title heading global primary secondary mobile desktop".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)")
HIDDEN = re.compile(r"(?i)\shidden(?:\s|=|/|$)")
SPACE = re.compile(r"\s+")
PARTS = re.compile(r"[a-z]+")
MARKS = re.compile(r"[.,;:!?…。，！？]")


def says_around(name: str) -> bool:
    """Whether a whole class or id is one of NOTICES, alone or beside words that only place it."""
    parts = PARTS.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower())
    return any(x in NOTICES for x in parts) and all(x in NOTICES or x in BESIDE for x in parts)


@dataclass
class Element:
    tag: str
    parent: int
    path: int
    around: bool
    header: bool
    linked: bool


@dataclass
class Block:
    element: int
    path: int
    text: str
    around: bool
    links: int


class Page:
    """The blocks of a page in page order, its elements after their parents, its paths by number."""

    def __init__(self, page: str):
        self.elements = [Element("", -1, 0, False, False, False)]
        self.paths: dict[tuple[int, str], int] = {}
        self.parent = [-1]  # of each path
        self.blocks: list[Block] = []
        self._read(page)

    def _open(self, tag: str, attributes: str, above: int) -> int:
        up = self.elements[above]
        label, around = tag, tag in AROUND or tag in DRAWN
        if attributes:
            for name, value in ATTRIBUTE.findall(attributes):
                name, value = name.lower(), value.strip("\"'")
                if name in ("class", "id"):
                    label += "." + re.sub(r"\d+", "0", value)
                    if tag in CONTAINERS and any(map(says_around, value.split() if name == "class" else [value])):
                        around = True
                elif name == "role" and value.lower() in ROLES and tag not in ARTICLES or name == "aria-hidden" and value == "true":
                    around = True
            if tag not in ("html", "body") and (HIDDEN.search(attributes) or "display:none" in attributes.replace(" ", "").lower()):
                around = True
        path = up.path
        if tag in BLOCK:
            path = self.paths.setdefault((up.path, label), len(self.parent))
            if path == len(self.parent):
                self.parent.append(up.path)
        header = up.header
        if tag == "header" and not up.around and any(self.elements[i].tag in ARTICLES for i in self._up(above)):
            around, header = up.around, True  # an article's own header: its headings stay
        elif header and tag in HEADINGS:
            header = False
        self.elements.append(Element(tag, above, path, up.around or around, header, up.linked or tag == "a"))
        return len(self.elements) - 1

    def _up(self, i: int):
        while i > 0:
            yield i
            i = self.elements[i].parent

    def _read(self, page: str) -> None:
        now, run, links, open_ = 0, [], 0, defaultdict(int)

        def flush() -> None:
            nonlocal run, links
            if run:
                text = SPACE.sub(" ", html.unescape("".join(run))).strip()
                if text:
                    e = self.elements[now]
                    self.blocks.append(Block(now, e.path, text, e.around or e.header, links))
                run, links = [], 0

        def close(tag: str) -> None:
            nonlocal now
            if open_[tag]:
                while True:
                    e = self.elements[now]
                    open_[e.tag] -= 1
                    now = e.parent
                    if e.tag == tag:
                        return

        at, n = 0, len(page)
        while at < n:
            m = TOKEN.search(page, at)
            text = page[at : m.start()] if m else page[at:]
            if text:
                run.append(text)
                if self.elements[now].linked:
                    links += len(text)
            if not m:
                break
            at = m.end()
            if m[2] is None:
                continue
            tag, closing, empty = m[2].lower(), bool(m[1]), m[3].rstrip().endswith("/")
            if closing:
                if tag in BLOCK or tag in DRAWN:
                    flush()
                close(tag)
                continue
            if tag in BLOCK or tag in DRAWN:
                flush()
            if tag in BLOCK:
                for t in ("option", "optgroup", "select", "svg", "math", "p"):  # a block ends these and what is open in them
                    close(t)
                if tag in ("li", "dt", "dd", "td", "th", "tr") and self.elements[now].tag == tag:
                    close(tag)
            elif tag == "option":
                close(tag)
            if tag in RAW:
                end = None if empty and tag == "iframe" else re.compile(rf"</{tag}\s*>", re.I).search(page, at)
                at = end.end() if end else (at if empty else n)
                continue
            if tag == "br":
                run.append(" ")
            elif tag not in VOID and not empty:
                now = self._open(tag, m[3], now)
                open_[tag] += 1
        flush()

    def scores(self) -> tuple[dict[int, float], dict[int, float]]:
        """Fused ratios of each path, in shares of the best path's, and the share of each path's text inside links."""
        size, count, marks, linked = (defaultdict(float) for _ in range(4))
        for b in self.blocks:
            if not b.around:
                size[b.path] += len(b.text)
                count[b.path] += 1
                marks[b.path] += len(MARKS.findall(b.text))
                linked[b.path] += min(b.links, len(b.text))
        plain = {p: size[p] - linked[p] for p in size}
        ratios = {p: (plain[p] / count[p], (1 + marks[p]) / (20 + plain[p])) for p in size}
        family: dict[int, list[int]] = defaultdict(list)
        for p in size:
            family[self.parent[p]].append(p)
        mean = {f: [sum(ratios[q][k] for q in ps) / len(ps) for k in (0, 1)] for f, ps in family.items()}
        fused = {}
        for p in size:
            smooth = [0.5 * ratios[p][k] + 0.5 * mean[self.parent[p]][k] for k in (0, 1)]
            fused[p] = smooth[0] * smooth[1] * plain[p] ** 0.5
        top = max(fused.values(), default=0.0)
        return {p: v / top if top else 0.0 for p, v in fused.items()}, {p: linked[p] / size[p] for p in size}

    def article(self, content: set[int], share: float) -> int:
        """The smallest element that holds `share` of the text of content paths, or the article that it stands in."""
        mass = [0] * len(self.elements)
        for b in self.blocks:
            if not b.around and b.path in content:
                mass[b.element] += len(b.text)
        for i in range(len(mass) - 1, 0, -1):
            mass[self.elements[i].parent] += mass[i]
        found = 0
        for i in range(1, len(mass)):  # children come after their parents
            if self.elements[i].parent == found and mass[i] >= share * mass[0] > 0:
                found = i
        inside = [i for i in self._up(found) if self.elements[i].tag in ARTICLES]
        while found and (self.elements[found].tag == "p" or self.elements[found].tag not in BLOCK):  # one paragraph isn't an article
            found = self.elements[found].parent
        return inside[-1] if inside else found


def main_text(page: str | None, threshold: float = 0.1, share: float = 0.8) -> str:
    """The text of the article, a block a line."""
    p = Page(page or "")
    scores, linked = p.scores()
    content = {x for x, v in scores.items() if v >= threshold}
    root = p.article(content, share)
    within = [False] * len(p.elements)
    within[root] = True
    for i in range(root + 1, len(within)):
        within[i] = within[p.elements[i].parent]
    named = p.elements[root].tag in ARTICLES
    keep = lambda b: not b.around and within[b.element] and (named or b.path in content or linked[b.path] <= 0.5)
    return "\n".join(b.text for b in p.blocks if keep(b))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", threshold: float = 0.1, share: float = 0.8) -> DataFrame:
    """page_id, url, text, n_chars: a row for each row of pages."""
    small_batches(pages.sparkSession)

    def run(batches):
        for b in batches:
            texts = [main_text(x, threshold, share) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
