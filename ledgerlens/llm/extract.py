"""Operator 4, HTML extraction by line-block distribution.

1. Strip markup: a tag scanner drops comments, scripts, styles, forms and page furniture (by element, role or a plain name
   such as navbar or comments), and starts a new line at every block element.  Furniture leaves empty lines behind,
   except between texts of the same block.  A name that may also be that of article text (side, notice, discussion ...)
   drops nothing here: its lines are only marked as one doubtful block.
2. Each line has the length of its text, less the text of its links; a sliding window of three lines sums them.
3. A surge point is a line whose window rises from zero to text, a dive point where the window falls back to zero.
   The text between them is one run, and its density is that of its densest window.
4. A doubtful block stays if it reaches DOUBT of the density of the page without such blocks, else it leaves as
   furniture does.
5. The articles that a page names (article, main or their roles) are runs of their own, and furniture inside leaves no
   gap, so that a notice between two paragraphs does not cut the article.  The densest one is the article, whole, with the
   others that reach SHARE of its density; teasers in small articles do not.  If text outside is TRUST times as dense
   as any of them, the names do not hold, and the page is read as one that names none: its densest run is the article,
   with every run that reaches SHARE of its density.

Defined results: null, empty or text-less html gives an empty text; broken or cut markup is read to its end, a tag with a
broken quote ends at the next >; equal rows give equal results; null ids and urls are kept; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import html as references
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Lines of a window.
WINDOW = 3
#: A run is kept if its densest window reaches this share of the densest window of the page.
SHARE = 0.2
#: The share of the density of the rest of the page at which a doubtful block is text.
DOUBT = 0.4
#: How many times as dense as all named articles text outside must be for the names not to hold.
TRUST = 4

_BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol optgroup option p pre section summary table tbody td "
    "tfoot th thead title tr ul".split()
)
#: Blocks that hold text alone: their parent tells where the text belongs.
_TEXT = frozenset("p pre h1 h2 h3 h4 h5 h6".split())
#: Elements whose content is never article text; the raw ones hold no tags of their own.
_RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
_DROP = frozenset("head nav header footer aside form button select option input label noscript template svg canvas object audio video dialog menu".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
#: A class or id names furniture if one of its words is among these.
_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsbox adbox adslot sponsor sponsored sponsors "
    "nav navbar navigation menu menus submenu topnav breadcrumb breadcrumbs pagination pager masthead topbar footer "
    "sidebar sidebars cookie cookies consent gdpr popup modal newsletter subscribe subscription signup login paywall "
    "sharing social comment comments commentlist disqus toolbar".split()
)
#: These may name furniture or text: the density of the block decides.
_DOUBTFUL = frozenset(
    "banner banners promo promos promotion header aside side rail widget widgets related recommended recommendations trending popular teaser teasers "
    "notice notices overlay alert share discussion replies reply respond reactions tags search form copyright disclaimer".split()
)
#: A quote opens a value only behind =, and a value holds no <, so a stray quote does not swallow the page.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:=\s*\"[^\"<]*\"|=\s*'[^'<]*'|[^>])*)(?:>|\Z)", re.S)
#: One attribute, with its whole value: words inside of a value are no attributes.
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)(?:\"|\Z)|'([^']*)(?:'|\Z)|([^\s\"'>]+)))?")
_NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def _furniture(tag: str, attributes: str) -> str:
    """"drop" for furniture, "doubt" for a block whose density decides, else an empty text."""
    if tag in _DROP:
        return "drop"
    found = ""
    for name, a, b, c in _ATTRIBUTE.findall(attributes) if attributes else ():
        name, value = name.lower(), a or b or c
        if name == "role":
            if value.strip().lower() in _ROLES:
                return "drop"
        elif name == "hidden" or name == "aria-hidden":
            if name == "hidden" or value.lower() == "true":
                return "drop"
        elif name in ("class", "id") and tag not in ("html", "body", "article", "main"):
            parts = {p.lower() for p in _NAME_PARTS.findall(value)}
            if parts & _NAMES:
                return "drop"
            if parts & _DOUBTFUL:
                found = "doubt"
    return found


def _main(tag: str, attributes: str) -> bool:
    if tag in ("article", "main"):
        return True
    found = _ATTRIBUTE.findall(attributes) if "role" in attributes.lower() else []
    return any(name.lower() == "role" and re.match(r"\s*(?:main|article)\b", a or b or c, re.I) for name, a, b, c in found)


class _Line:
    __slots__ = ("parts", "linked", "region", "doubt", "gap", "parents")

    def __init__(self, region: int, doubt: int, gap: bool = False):
        self.parts: list[str] = []
        self.linked = 0
        #: The number of the named article, and of the doubtful block, that the line lies in; 0 for none.
        self.region = region
        self.doubt = doubt
        self.gap = gap
        #: The blocks around the first and the last text of the line.
        self.parents: tuple[int, int] | None = None


def lines_of(page: str) -> list[tuple[str, int, int]]:
    """(text, weight, named article) of every line.

    Furniture and thin doubtful blocks outside an article give empty lines, unless the texts before and after them lie in
    the same block.
    """
    made: list[_Line] = [_Line(0, 0)]
    stack: list[str] = []
    numbers: list[int] = []  # a number of its own for each element of the stack; may be longer than the stack
    opened = 0
    dropped = 0  # depth of the stack at which furniture began
    links = 0
    regions: list[tuple[int, int]] = []  # (depth, number) of the outermost named article
    doubts: list[tuple[int, int]] = []  # (depth, number) of the outermost doubtful block
    at, end = 0, len(page)

    def text(a: int, b: int) -> None:
        if b > a and not dropped:
            piece = references.unescape(page[a:b]) if "&" in (raw := page[a:b]) else raw
            made[-1].parts.append(piece)
            if not piece.isspace():
                own = next((numbers[i] for i in range(len(stack) - 1, -1, -1) if stack[i] in _BLOCK and stack[i] not in _TEXT), 0)
                made[-1].parents = (made[-1].parents or (own,))[0], own
            if links:
                made[-1].linked += len(piece.strip())

    def fresh() -> None:
        at = regions[0][1] if regions else 0, doubts[0][1] if doubts else 0
        if made[-1].parts or (made[-1].region, made[-1].doubt) != at:
            made.append(_Line(*at))

    while at < end:
        found = _TOKEN.search(page, at)
        if not found:
            text(at, end)
            break
        text(at, found.start())
        at = found.end()
        tag = found[2]
        if not tag:
            continue
        tag, closing, attributes = tag.lower(), bool(found[1]), found[3] or ""
        if tag in _RAW and not closing:
            close = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = close.end() if close else end
            continue
        if closing:
            if tag in stack:
                while stack:
                    top = stack.pop()
                    if dropped and len(stack) < dropped:
                        dropped = 0
                        if not regions:
                            made.extend(_Line(0, 0, True) for _ in range(WINDOW + 1))
                            fresh()
                    if top == "a":
                        links = max(0, links - 1)
                    for kept in (regions, doubts):
                        if kept and len(stack) < kept[0][0]:
                            kept.clear()
                    if top == tag:
                        break
            if not dropped and tag in _BLOCK:
                fresh()
            continue
        if not dropped and tag in _BLOCK:
            fresh()
        if tag in _VOID or attributes.endswith("/") and tag not in _BLOCK:
            continue
        if tag == "p" and "p" in stack and not dropped:
            # A paragraph ends where the next one begins.
            while stack and stack[-1] not in ("p", "div", "article", "section", "main", "td", "li", "body"):
                if stack.pop() == "a":
                    links = max(0, links - 1)
            if stack and stack[-1] == "p":
                stack.pop()
        opened += 1
        del numbers[len(stack) :]
        stack.append(tag)
        numbers.append(opened)
        if dropped:
            continue
        verdict = _furniture(tag, attributes)
        if verdict == "drop":
            dropped = len(stack)
            continue
        if tag == "a":
            links += 1
        if not regions and _main(tag, attributes):
            regions.append((len(stack), opened))
            fresh()
        if not doubts and verdict == "doubt":
            doubts.append((len(stack), opened))
            fresh()
    rows = [(" ".join("".join(line.parts).split()), line) for line in made]
    weighed = [(joined, max(0, len(joined) - line.linked), line) for joined, line in rows]
    thin = thin_blocks([(weight, line.doubt) for _, weight, line in weighed])
    out: list[tuple[str, int, int]] = []
    last, gap, filled = None, False, 0  # block of the last text, furniture since then, lines up to it
    for joined, weight, line in weighed:
        if line.doubt in thin:
            out += [("", 0, 0)] * (0 if line.region else WINDOW + 1)
            gap = True
            continue
        gap |= line.gap
        if joined and line.parents:
            if gap and last == line.parents[0]:
                del out[filled:]
            last, gap = line.parents[1], False
        out.append((joined, weight, line.region))
        if joined:
            filled = len(out)
    return out


def thin_blocks(lines: list[tuple[int, int]]) -> set[int]:
    """The doubtful blocks of lines (weight, block) that do not reach DOUBT of the density of all other lines."""
    level = DOUBT * densest([w for w, doubt in lines if not doubt])
    blocks: dict[int, list[int]] = {}
    for weight, doubt in lines:
        if doubt:
            blocks.setdefault(doubt, []).append(weight)
    return {doubt for doubt, weights in blocks.items() if densest(weights) < level}


def runs(weights: list[int]) -> list[tuple[int, int, int]]:
    """(surge, dive, densest window) of every run of lines whose windows are not all zero."""
    n = len(weights)
    sums = [sum(weights[i : i + WINDOW]) for i in range(n)]
    found, i = [], 0
    while i < n:
        if not sums[i]:
            i += 1
            continue
        j = i
        while j < n and sums[j]:
            j += 1
        found.append((i, min(n, j + WINDOW - 1), max(sums[i:j])))
        i = j
    return found


def densest(weights: list[int]) -> int:
    """The densest window of a sequence of lines."""
    return max((k[2] for k in runs(weights)), default=0)


def extract(page: str | None) -> str:
    """The main text of a page: its blocks in order, joined by one space."""
    if not page:
        return ""
    lines = lines_of(page)
    dense = {r: densest([w if region == r else 0 for _, w, region in lines]) for r in {region for _, _, region in lines}}
    outside = dense.pop(0, 0)
    top = max(dense.values(), default=0)
    if any(region and text for text, _, region in lines) and outside <= TRUST * top:
        return " ".join(text for text, _, region in lines if text and region and dense[region] >= SHARE * top)
    kept = runs([w for _, w, _ in lines])
    most = max((k[2] for k in kept), default=0)
    parts, last = [], 0
    for surge, dive, density in kept:
        if density >= SHARE * most:
            parts += [text for text, _, _ in lines[max(surge, last) : dive] if text]
            last = max(last, dive)
    return " ".join(parts)


def _pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, 256):
            part = batch.slice(a, 256)
            texts = [extract(x.as_py()) for x in part.column("html")]
            yield pa.RecordBatch.from_arrays(
                [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page; one Arrow pass, no shuffle."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(_pages, "page_id long, url string, text string, n_chars long")
