"""Lines of a page's blocks, with the spans that a PDF library gives, as small HTML.

The input has a row for each line: key columns of its block, `line` (its place in the block), `y0`
and `y1` (null if unknown) and `spans`, an array of struct<text, flags, font, size>. Styles, line
breaks and runs are windows over a block, all on one shuffle by its key. Where breaks go depends on
what was written before, so the runs are written one after another in tasks, a batch at a time,
with the state of one block in memory.

Defined cases: a block without text gives an empty text; null spans, texts, fonts, flags and sizes
count as none, empty or 0; a null key is a block of its own; an empty table gives an empty result.
"""

from __future__ import annotations

import html
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import text as T

# Fixed values.
HEADINGS = {"h1": 1.8, "h2": 1.4}
BOLD, ITALIC = 16, 2
BREAK_FACTOR = 1.2
NEAR_SIZE, VARIANT_SIZE, HEIGHT_STEP = 0.6, 1.0, 1.0
NO_SIZE = 12.0
TAGS = {"": ("", ""), "h1": ("<h1>", "</h1>"), "h2": ("<h2>", "</h2>"), "b": ("<b>", "</b>"), "i": ("<i>", "</i>"), "bi": ("<b><i>", "</i></b>")}
LABEL = range(2, 81)
LEAST_TITLE = 3


def heading(size: Column, body: Column) -> Column:
    """h1, h2 or null, by the ratio of a size to the body's."""
    ratio = F.when(body > 0, size / body)
    return F.when(ratio >= HEADINGS["h1"], "h1").when(ratio >= HEADINGS["h2"], "h2")


def halves(size: Column) -> Column:
    return F.when(size > 0, F.bround(size * 2) / 2)


def broken(lines: DataFrame, by: list[str]) -> DataFrame:
    """Adds is_break: more than 1.2 median gaps below the line before, or another height."""
    block = Window.partitionBy(*by)
    gap, height = F.col("y0") - F.lag("y0").over(block.orderBy("line")), F.col("y1") - F.col("y0")
    lines = lines.withColumns({"__gap": gap, "__height": height, "__before": F.lag(height).over(block.orderBy("line"))})
    # the median's window has no order, so that it sees the whole block
    lines = lines.withColumn("__median", F.median(F.when(F.col("__gap") > 0, F.col("__gap"))).over(block))
    wide = F.col("__gap") > F.col("__median") * BREAK_FACTOR
    stepped = (F.col("__before") > 0) & (F.col("__height") > 0) & (F.abs(F.col("__before") - F.col("__height")) >= HEIGHT_STEP)
    return lines.withColumn("is_break", F.coalesce(wide, F.lit(False)) | F.coalesce(stepped, F.lit(False))).drop("__gap", "__height", "__before", "__median")


def styled(spans: DataFrame, by: list[str], page_size: str | None = None) -> DataFrame:
    """Adds body_size, body_font and style to spans (line, place, text, flags, font, size) of blocks.

    The body's size is the most frequent one, in halves, the smallest of equally frequent ones; its
    font has most characters near that size, the first of equal ones. Another font at about that
    size counts as bold, if its name says nothing else and it isn't one of symbols.
    """
    block = Window.partitionBy(*by)
    size, font = F.col("size"), F.col("font")
    out = spans.withColumn("body_size", F.coalesce(F.mode(halves(size), True).over(block), F.lit(NO_SIZE)))
    body = F.col("body_size")
    counts = (F.abs(halves(size) - body) < NEAR_SIZE) & (font != "") & (F.col("text") != "")
    each = Window.partitionBy(*by, "font")
    out = out.withColumns({"__chars": F.sum(F.when(counts, F.length("text"))).over(each), "__first": F.min(F.when(counts, F.struct("line", "place"))).over(each)})
    # least by (-characters, first place)
    out = out.withColumn("body_font", F.min(F.when(F.col("__chars") > 0, F.struct((-F.col("__chars")).alias("c"), F.col("__first").alias("f"), "font"))).over(block)["font"])
    bold = (F.col("flags").bitwiseAND(BOLD) != 0) | T.is_bold_font(font)
    italic = (F.col("flags").bitwiseAND(ITALIC) != 0) | T.is_italic_font(font)
    variant = F.coalesce((font != "") & (font != F.col("body_font")), F.lit(False)) & (F.abs(size - body) <= VARIANT_SIZE) & ~T.is_math_font(font)
    page = F.when(F.col(page_size) > 0, F.col(page_size)).otherwise(body) if page_size else body
    style = F.coalesce(
        heading(size, body), heading(body, page),
        F.when(bold & italic, "bi").when(bold, "b").when(italic, "i").when(variant, "b").otherwise(""),
    )
    return out.withColumn("style", style).drop("__chars", "__first")


def runs(lines: DataFrame, by: list[str], page_size: str | None = None) -> DataFrame:
    """(by, run, style, text): neighbouring spans of one style are one run; lines meet at a blank, or at a run of style `br`."""
    kept = [*by, *([page_size] if page_size else [])]
    order = Window.partitionBy(*by).orderBy("line", "place")
    spans = F.coalesce("spans", F.array().cast("array<struct<text:string,flags:int,font:string,size:double>>"))
    spans = F.transform(spans, lambda s: F.struct(F.coalesce(s["text"], F.lit("")).alias("text"), F.coalesce(s["flags"].cast("int"), F.lit(0)).alias("flags"), F.coalesce(s["font"], F.lit("")).alias("font"), F.coalesce(s["size"].cast("double"), F.lit(0.0)).alias("size")))
    placed = broken(lines.select(*kept, "line", "y0", "y1", spans.alias("spans")), by)
    # place -1 stands for what is between a line and the one before
    between = F.struct(F.lit("").alias("text"), F.lit(0).alias("flags"), F.lit("").alias("font"), F.lit(0.0).alias("size"))
    placed = placed.select(*kept, "line", "is_break", F.posexplode(F.concat(F.array(between), "spans")).alias("place", "s")).select(*kept, "line", "is_break", (F.col("place") - 1).alias("place"), "s.*")
    out = styled(placed, by, page_size)
    # nothing is put before the first text of a block
    started = F.max(F.col("text") != "").over(order.rowsBetween(Window.unboundedPreceding, -1))
    joint = F.col("place") < 0
    started = F.coalesce(started, F.lit(False))
    out = out.withColumns({
        "style": F.when(joint & started & F.col("is_break"), "br").when(joint, "").otherwise(F.col("style")),
        "text": F.when(joint & started & ~F.col("is_break"), " ").otherwise(F.col("text")),
    })
    # a span without text is none; the first row of a block stays, so that every block has a run
    out = out.withColumn("__n", F.row_number().over(order)).filter((F.col("text") != "") | (F.col("style") == "br") | (F.col("__n") == 1))
    new = (F.col("style") == "br") | F.coalesce(F.col("style") != F.lag("style").over(order), F.lit(True))
    out = out.withColumn("run", F.sum(new.cast("int")).over(order) - 1)
    texts = F.transform(F.array_sort(F.collect_list(F.struct("line", "place", "text"))), lambda s: s["text"])
    return out.groupBy(*by, "run").agg(F.first("style").alias("style"), F.array_join(texts, "").alias("text"))


class Writer:
    """The runs of one block, one after another -> HTML."""

    def __init__(self):
        self.out: list[str] = []
        #: Something visible is written; a title waits for its break; what comes stands on a line of its own; the last text ended a sentence.
        self.seen = self.title = self.fresh = self.ended = False

    def line_end(self) -> None:
        self.out.append("<br>")
        self.title, self.fresh = False, True

    def add(self, text: str, style: str) -> None:
        if style == "br":
            if self.seen:
                self.line_end()
            return
        shown = text.strip()
        if shown and self.title and style not in HEADINGS:
            self.line_end()
        strong = style in ("b", "bi")
        title = (strong or style in HEADINGS) and (self.fresh or not self.seen) and len(shown) >= LEAST_TITLE and shown[-1] != ":"
        if strong and self.seen and self.ended and len(shown) in LABEL and shown[-1] in ":." and self.out[-1] != "<br>":
            self.out.append("<br>")
        before, after = TAGS[style]
        self.out.append(before + html.escape(text) + after)
        if shown:
            self.seen, self.fresh, self.title, self.ended = True, False, self.title or title, shown[-1] in ".?!:"

    def whole(self) -> str:
        return "".join(self.out).strip()


def _write(by: list[str]):
    """(by, run, style, text) in order -> (by, html)."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, key = None, None
        for batch in batches:
            done: list[tuple] = []
            keys = zip(*[batch.column(c).to_pylist() for c in by], strict=True)
            for own, run, style, text in zip(keys, *[batch.column(c).to_pylist() for c in ("run", "style", "text")], strict=True):
                if run == 0:
                    if writer is not None:
                        done.append((*key, writer.whole()))
                    writer, key = Writer(), own
                writer.add(text, style)
            kinds = [*[batch.schema.field(c).type for c in by], pa.string()]
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*done, strict=True), kinds, strict=True)], names=[*by, "html"])
        if writer is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((*key, writer.whole()), kinds, strict=True)], names=[*by, "html"])

    return write


def to_html(lines: DataFrame, by: list[str], page_size: str | None = None) -> DataFrame:
    """(by, html) of every block; page_size: a column with the page's usual size, which a whole block may exceed as a heading."""
    found = runs(lines, by, page_size)
    kinds = dict(found.dtypes)
    # the grouping above has put a block's runs in one task
    return found.sortWithinPartitions(*by, "run").select(*by, "run", "style", "text").mapInArrow(_write(by), ", ".join([*[f"`{c}` {kinds[c]}" for c in by], "html string"]))
