"""Text of a page from its spans, and the choice between the ways to read a page.

Lines are folded over the page's ordered spans inside its row: a line is anchored at its first span, so the gap to the one before would not do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rx import let, strip
from ..schema import SPAN

# Tolerance of a line and least gap of columns in points, share of lines and of the page's width.
LINE, GAP, SHARE, CENTER = 3.0, 30.0, 0.5, 0.2
FEW, LAYOUT_GAIN, LEAST_LAYOUT, BLOCKS_GAIN = 100, 1.3, 50, 1.2


def score(text: Column) -> Column:
    """Letters and digits."""
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\p{L}\p{N}]", ""))


def usable_spans(spans: Column) -> Column:
    return F.filter(spans, lambda s: s["x0"].isNotNull() & s["y0"].isNotNull() & s["x1"].isNotNull() & s["y1"].isNotNull() & (strip(F.coalesce(s["text"], F.lit(""))) != ""))


def lines_of(spans: Column) -> Column:
    """Spans to lines, top down, each from left to right. The fold over the spans carries its anchor and where lines begin, so that lines are cut
    out of the ordered spans and none is built span by span."""
    by_place = F.array_sort(F.transform(usable_spans(spans), lambda s: F.struct(s["y0"].alias("y0"), s["x0"].alias("x0"), s["x1"].alias("x1"), s["y1"].alias("y1"), s["text"].alias("text"))))

    def step(acc: Column, s: Column) -> Column:
        new = acc["anchor"].isNull() | (F.abs(s["y0"] - acc["anchor"]) > LINE)
        n = acc["n"] + 1
        return F.struct(F.when(new, s["y0"]).otherwise(acc["anchor"]).alias("anchor"), n.alias("n"), F.when(new, F.concat(acc["begins"], F.array(n))).otherwise(acc["begins"]).alias("begins"))

    def cut(own: Column) -> Column:
        none = F.struct(F.lit(None).cast("double").alias("anchor"), F.lit(0).alias("n"), F.array().cast("array<int>").alias("begins"))
        line = lambda begins: F.transform(begins, lambda at, i: left_first(F.slice(own, at, F.coalesce(F.get(begins, i + 1), F.size(own) + 1) - at)))
        return let(F.aggregate(own, none, step, lambda acc: acc["begins"]), line)

    left_first = lambda line: F.array_sort(F.transform(line, lambda s, i: F.struct(s["x0"].alias("x0"), i.alias("i"), s["x1"].alias("x1"), s["text"].alias("text"))))
    return let(by_place, cut)


def is_two_column(lines: Column, width: Column) -> Column:
    """Whether in half of the lines the widest gap is wide enough and near the page's middle."""

    def widest(line: Column) -> Column:
        def step(acc: Column, s: Column) -> Column:
            gap = s["x0"] - acc["end"]
            more = F.coalesce(gap > acc["gap"], F.lit(False))
            return F.struct(s["x1"].alias("end"), F.when(more, gap).otherwise(acc["gap"]).alias("gap"), F.when(more, (s["x0"] + acc["end"]) / 2).otherwise(acc["mid"]).alias("mid"))

        none = F.struct(F.lit(None).cast("double").alias("end"), F.lit(0.0).alias("gap"), F.lit(0.0).cast("double").alias("mid"))
        return F.aggregate(line, none, step, lambda acc: (acc["gap"] >= GAP) & (F.abs(acc["mid"] - width / 2) < CENTER * width))

    return F.when(F.size(lines) > 0, F.size(F.filter(lines, widest)) / F.size(lines) >= SHARE).otherwise(False)


def _written(line: Column) -> Column:
    return F.array_join(F.transform(line, lambda s: strip(s["text"])), " ")


def render_lines(lines: Column, width: Column) -> Column:
    """The text of a page's lines: both columns one below the other if it has two, a blank line between them if neither is empty, else line by line."""

    def half(left: bool) -> Column:
        own = F.transform(lines, lambda line: F.filter(line, lambda s: ((s["x0"] + s["x1"]) / 2 < width / 2) if left else ((s["x0"] + s["x1"]) / 2 >= width / 2)))
        return F.array_join(F.transform(F.filter(own, lambda line: F.size(line) > 0), _written), "\n")

    two = F.array_join(F.filter(F.array(half(True), half(False)), lambda x: x != ""), "\n\n")
    return F.when(is_two_column(lines, width), two).otherwise(F.array_join(F.transform(lines, _written), "\n"))


def render(spans: Column, width: Column) -> Column:
    return let(lines_of(spans), lambda lines: render_lines(lines, width))


def block_text(blocks: Column) -> Column:
    """Text blocks (kind 0) that are not blank, stripped, with a blank line between them."""
    own = F.filter(blocks, lambda b: (b["kind"] == 0) & (strip(F.coalesce(b["text"], F.lit(""))) != ""))
    return F.array_join(F.transform(own, lambda b: strip(b["text"])), "\n\n")


def choose(plain: Column, blocks: Column, layout: Column) -> Column:
    """The reading with most letters and digits, each way with its own least gain; layout counts only for poor pages."""
    p, b, g = score(plain), score(blocks), score(layout)
    best = F.greatest(p, b)
    return F.when((best < FEW) & (g >= LAYOUT_GAIN * best) & (g > LEAST_LAYOUT), layout).when(b > BLOCKS_GAIN * p, blocks).otherwise(plain)


def page_text(page: Column) -> Column:
    """The text of a page: a struct of width, plain, blocks and spans. Spans are rendered only for poor pages."""

    def chosen(blocks: Column) -> Column:
        weak = F.greatest(score(page["plain"]), score(blocks)) < FEW
        return choose(F.coalesce(page["plain"], F.lit("")), blocks, F.when(weak, render(page["spans"].cast(SPAN), page["width"])))

    return let(block_text(page["blocks"]), chosen)


def page_texts(pages: DataFrame) -> DataFrame:
    """pages(source, page_no, width, plain, blocks, spans) to (source, page_no, text)."""
    return pages.select("source", "page_no", page_text(F.struct("width", "plain", "blocks", "spans")).alias("text"))


def joined_pages(pages: Column) -> Column:
    """The text of an array of pages in their order, parted by form feeds; nothing is shuffled."""
    return F.array_join(F.transform(F.array_sort(F.transform(pages, lambda p: F.struct(p["page_no"].alias("page_no"), page_text(p).alias("text")))), lambda p: p["text"]), "\f")


def file_texts(pages: DataFrame) -> DataFrame:
    """(source, text): pages that are rows of their own, in order, parted by form feeds."""
    own = page_texts(pages).groupBy("source").agg(F.array_sort(F.collect_list(F.struct("page_no", "text"))).alias("pages"))
    return own.select("source", F.array_join(F.transform("pages", lambda p: p["text"]), "\f").alias("text"))
