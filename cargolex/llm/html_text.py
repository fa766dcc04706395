"""HTML extraction by layout-aware rendering.

Tags build a stack of open elements, with implied ends (a paragraph ends where a block begins, an item where the next one does), and text
is written as it would be seen: hidden parts left out, blocks on lines of their own with blank lines where they have margins,
lists indented behind their markers, table cells padded to their columns.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl menu blockquote pre table figure fieldset hr".split())
BLOCKS = SPACED | frozenset("address article aside body center dd details dialog div dt figcaption footer form header hgroup html legend li main nav option optgroup section summary caption tr td th thead tbody tfoot".split())
HIDDEN = frozenset("head title script style template noscript datalist iframe audio video canvas object noframes map".split())
RAW = frozenset("script style textarea title iframe noframes xmp".split())
#: What a start tag ends if it is open nearer than the tags of the second set.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "td": ({"td", "th", "caption"}, {"table"}),
    "th": ({"td", "th", "caption"}, {"table"}),
    "tr": ({"tr", "caption"}, {"table"}),
    **{x: ({"thead", "tbody", "tfoot", "caption"}, {"table"}) for x in ("thead", "tbody", "tfoot")},
}
#: Characters that lists and quotes are indented at most, and tables in tables that are aligned: deeper ones keep their text and its order.
INDENT, TABLES = 120, 24
#: How many times its own text the padding of a table may take; the widest columns are padded less beyond it.
PADDING = 6
#: Cells that reach down into a row at most; further ones fill their own row alone.
ABOVE = 1000
#: Elements that no end tag of another element reaches out of.
WALLS = frozenset("table td th caption".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>=]|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|=)*+)>|(?P<text>[^<]++)", re.S
)
#: The same where quotes do not count: after a tag whose quotes swallowed the rest of the page, so that only one search runs to its end.
_BROKEN = re.compile(_TOKEN.pattern.replace(r"(?:[^>=]|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|=)*+", "[^>]*+"), re.S)
_TAG = re.compile(r"</?[a-zA-Z]")
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_SPACE = re.compile(r"[ \t\n\r\f]+")
_GONE = re.compile(r"display\s*:\s*none", re.I)
_VISIBILITY = re.compile(r"visibility\s*:\s*(hidden|collapse|visible)", re.I)


class Writer:
    """Lines of one page or one table cell."""

    def __init__(self):
        self.lines: list[str] = []
        self.now: list[str] = []
        self.space = False
        self.margin = 0
        self.indent = 0
        self.marker = ""

    def text(self, s: str, kept: bool) -> None:
        if kept:
            first, *more = s.split("\n")
            self.now.append(first) if first else None
            for x in more:
                self.line()
                self.now.append(x) if x else None
            return
        core = s.strip(" \t\n\r\f")
        if not core:
            self.space = self.space or bool(s and self.now)
            return
        if self.now and (self.space or s[0] in " \t\n\r\f"):
            self.now.append(" ")
        self.now.append(_SPACE.sub(" ", core))
        self.space = s[-1] in " \t\n\r\f"

    def flush(self) -> None:
        if self.now or self.marker:
            if self.lines:
                self.lines += [""] * self.margin
            before = " " * min(self.indent, INDENT)
            if self.marker:
                before = before[: max(len(before) - len(self.marker), 0)] + self.marker
            self.lines.append((before + "".join(self.now)).rstrip())
            self.now, self.marker, self.margin = [], "", 0
        self.space = False

    def line(self) -> None:
        """A forced line end."""
        if self.now or self.marker:
            self.flush()
        elif self.lines:
            self.margin = min(self.margin + 1, 2)

    def block(self, margin: int) -> None:
        if self.now:
            self.flush()
        if not self.marker:
            self.margin = max(self.margin, margin)

    def rows(self, lines: list[str]) -> None:
        for x in lines:
            self.now = [x] if x else []
            if x:
                self.flush()
            else:
                self.margin = 1

    def result(self) -> list[str]:
        self.flush()
        return self.lines


class Element:
    __slots__ = ("count", "down", "gone", "hidden", "kept", "ordered", "pushed", "table", "tag", "unseen", "writer")

    def __init__(self, tag, gone, unseen, kept, writer):
        #: gone: left out with all that is in it; unseen: invisible, but for what is made visible inside
        self.tag, self.gone, self.unseen, self.hidden, self.kept, self.writer = tag, gone, unseen, gone or unseen, kept, writer
        self.table = self.ordered = self.count = self.down = None
        self.pushed = 0


def _spanned(value: str | None, most: int) -> int:
    return min(max(int(value[:9]), 1), most) if value and value.isascii() and value.isdigit() else 1


def _placed(rows: list[list[tuple[int, int, list[str]]]]) -> list[list[tuple[int, int, list[str]]]]:
    """Cells (columns and rows spanned, lines) to (first column, columns, lines); columns that a cell above still spans are left free."""
    out, above = [], []  # (first column, end, first row that is free again), by column
    for r, row in enumerate(rows):
        above = [x for x in above if x[2] > r]
        cells, at, i, down = [], 0, 0, []
        for span, tall, lines in row:
            while i < len(above) and above[i][0] <= at:
                at, i = max(at, above[i][1]), i + 1
            cells.append((at, span, lines))
            if tall > 1 and len(above) < ABOVE:
                down.append((at, at + span, r + tall))
            at += span
        if down:
            above = sorted(above + down)
        out.append(cells)
    return out


def _laid_out(rows: list[list[tuple[int, int, list[str]]]]) -> list[str]:
    """Lines of a table: cells begin where their columns do, two spaces apart at least."""
    placed = _placed(rows)
    widths: dict[int, int] = {}
    for cells in placed:
        for at, span, lines in cells:
            if span == 1:
                widths[at] = max([widths.get(at, 0), *map(len, lines)])
    columns, heights = sorted(widths), [max((len(lines) for *_, lines in cells), default=0) for cells in placed]
    allowed = 1000 + PADDING * sum(2 + sum(map(len, lines)) for cells in placed for *_, lines in cells)
    widest = max(widths.values(), default=0)
    while True:
        starts = [0, *accumulate(min(widths[c], widest) + 2 for c in columns)]
        begin = [[starts[bisect_left(columns, at)] for at, *_ in cells] for cells in placed]
        if sum(h * b[-1] for h, b in zip(heights, begin, strict=True) if b) <= allowed:
            break
        if not widest:  # columns by the thousand that hold next to nothing
            begin = [[0] * len(cells) for cells in placed]
            break
        widest //= 2
    out = []
    for cells, h, b in zip(placed, heights, begin, strict=True):
        by_line: list[list[tuple[int, str]]] = [[] for _ in range(h)]
        for (_, _, lines), start in zip(cells, b, strict=True):
            for i, cell in enumerate(lines):
                if cell:
                    by_line[i].append((start, cell))
        for own in by_line:
            parts, length = [], 0
            for start, cell in own:
                gap = max(start - length, 2) if length else start
                parts += [" " * gap, cell]
                length += gap + len(cell)
            out.append("".join(parts).rstrip())
    return out


class Page:
    def __init__(self):
        self.writer = Writer()
        self.open: list[Element] = [Element("", False, False, False, self.writer)]
        #: Where the open elements of each tag stand, so that no question about them walks the whole stack.
        self.places: dict[str, list[int]] = {}

    def push(self, e: Element) -> None:
        self.places.setdefault(e.tag, []).append(len(self.open))
        self.open.append(e)

    def close(self) -> None:
        e = self.open.pop()
        self.places[e.tag].pop()
        w = e.writer
        if e.tag in ("td", "th"):
            if not e.hidden and e.table is not None:
                if not e.table:
                    e.table.append([])
                e.table[-1].append((e.count, e.down, w.result()))
            elif not e.hidden and e.table is None:
                w.block(0)
        elif e.tag == "table":
            if not e.gone and e.table and any(e.table):
                w.rows(_laid_out([r for r in e.table if r]))
                w.block(1)
            elif not e.hidden and e.table is not None:
                w.block(1)
        elif e.tag in BLOCKS and not e.hidden:
            if e.tag == "li" and w.marker:
                w.flush()
            if e.pushed:
                w.block(0)
            w.block(e.tag in SPACED and not (e.tag in ("ul", "ol", "menu") and self.is_open("li")))
        w.indent -= e.pushed

    def nearest(self, tags, walls) -> int:
        """Place of the innermost open element of tags that no element of walls shuts in; 0 if none."""
        at = max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)
        wall = max((self.places[t][-1] for t in walls if t not in tags and self.places.get(t)), default=0)
        return at if at > wall else 0

    def is_open(self, tag: str) -> bool:
        return bool(self.places.get(tag))

    def close_to(self, i: int) -> None:
        while len(self.open) > i > 0:
            self.close()

    def start(self, tag: str, attrs: str) -> None:
        if tag in ("html", "body") and self.is_open(tag):
            return
        if self.open[-1].tag == "head" and tag not in ("title", "meta", "link", "base", "script", "style", "template", "noscript"):
            self.close()
        if tag in BLOCKS:
            self.close_to(self.nearest({"p"}, WALLS | {"button"}))
        if tag in ENDS:
            self.close_to(self.nearest(*ENDS[tag]))
        if tag in ("tr", "td", "th") and not self.nearest({"table"}, ()):
            tag = "div"
        above = self.open[-1]
        w = above.writer
        seen = {k.lower(): a or b or c for k, a, b, c in _ATTR.findall(attrs)} if attrs else {}
        style = seen.get("style", "")
        gone = above.gone or tag in HIDDEN or "hidden" in seen or bool(_GONE.search(style)) or (tag == "dialog" and "open" not in seen)
        own = _VISIBILITY.findall(style)
        unseen = own[-1].lower() != "visible" if own else above.unseen
        hidden = gone or unseen
        if tag == "br":
            if not hidden:
                w.line()
            return
        if tag in BLOCKS and not hidden:
            nested = tag in ("ul", "ol", "menu") and self.is_open("li")
            w.block(tag in SPACED and not nested)
        if tag in VOID:
            return
        e = Element(tag, gone, unseen, above.kept or tag in ("pre", "textarea", "xmp"), w)
        tables = self.places.get("table")
        table = self.open[tables[-1]] if tables else None
        if tag == "table":
            e.table = [] if not tables or len(tables) < TABLES else None
        elif tag == "tr":
            if not gone and table.table is not None:
                table.table.append([])
        elif tag in ("td", "th"):
            if table.table is not None:
                e.writer, e.table = Writer(), None if hidden else table.table
            e.count, e.down = _spanned(seen.get("colspan"), 1000), _spanned(seen.get("rowspan"), 65534)
        elif tag in ("ul", "ol", "menu"):
            e.ordered = tag == "ol"
            e.count = int(seen["start"]) - 1 if e.ordered and re.fullmatch(r"-?[0-9]{1,9}", seen.get("start", "")) else 0
        elif tag == "li" and not hidden:
            lst = self.open[i] if (i := self.nearest({"ul", "ol", "menu"}, {"table"})) else None
            if lst is not None and lst.ordered:
                lst.count += 1
            w.flush()
            w.marker = f"{lst.count}. " if lst is not None and lst.ordered else "- "
            e.pushed = len(w.marker)
            w.indent += e.pushed
        elif tag in ("blockquote", "dd") and not hidden:
            e.pushed = 2
            w.indent += 2
        self.push(e)

    def end(self, tag: str) -> None:
        if tag == "p" and not self.nearest({"p"}, WALLS):
            self.start("p", "")
        if tag in ("html", "body"):
            return
        walls = WALLS - {tag} if tag in WALLS else {"table"} if tag in ("tr", "tbody", "thead", "tfoot") else WALLS
        self.close_to(self.nearest({tag}, {"table"} if tag in ("td", "th", "caption") else () if tag == "table" else walls))

    def characters(self, s: str) -> None:
        e = self.open[-1]
        if e.tag == "head" and s.strip():
            self.close()
            e = self.open[-1]
        if not e.hidden:
            e.writer.text(html.unescape(s), e.kept)


def render(source: str) -> str:
    """The visible text of a page."""
    page, at, token, close = Page(), 0, _TOKEN, -1
    while at < len(source):
        m = token.match(source, at)
        if m is None:  # a tag that never ends, or no tag
            if close < at:
                close = source.find(">", at)
                close = len(source) if close < 0 else close
            ends = close == len(source)
            if _TAG.match(source, at):
                token = _BROKEN
            page.characters(source[at:].replace("<", "&lt;") if ends else "&lt;")
            at = len(source) if ends else at + 1
            continue
        at = m.end()
        if m["text"] is not None:
            page.characters(m["text"])
        elif m["tag"] is not None:
            tag = m["tag"].lower()
            if m["end"]:
                page.end(tag)
                continue
            page.start(tag, m["attrs"])
            if tag in RAW:
                stop = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(source, at)
                inner = source[at : stop.start() if stop else len(source)]
                if tag == "textarea" and inner:
                    page.characters(inner)
                at = stop.start() if stop else len(source)
    page.close_to(1)
    return "\n".join(page.writer.result())


def _render(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if x is None else render(x) for x in batch.column(1).to_pylist()], pa.string())], ["page_id", "text"])


def extract(pages: DataFrame) -> DataFrame:
    """One row per page: page_id and text. A null page gives null, an empty one ''; tags that never end, wrong nesting and pages of any length
    are rendered in one pass; elements may nest to any depth; repeated rows are rendered alike; an empty table gives an empty one; other columns are not looked at."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(_render, "page_id long, text string")
