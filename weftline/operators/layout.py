"""Page layout: body fonts, line breaks, columns, boxes, and what to do with a block."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import scalars as S
from weftline.functions import text as T
from weftline.operators.segments import histogram_gaps, peaks

BINS = 20
READABLE, SCALE_FLOOR, SCALE_CEILING = 0.15, 0.15, 0.7
MIN_HEIGHT, MIN_WIDTH = 6, 20
LOW_CONFIDENCE = 0.7


def body_size(spans: DataFrame, by: str, size: str) -> DataFrame:
    """The most frequent positive size, in halves (a quarter goes to the even one); the smallest of equally frequent ones. 12 where there is none."""
    half = F.when(F.col(size) > 0, F.bround(F.col(size).cast("double") * 2) / 2)
    n = spans.groupBy(by, half.alias("size")).agg(F.count(F.lit(1)).alias("n"))
    order = F.when(F.col("size").isNotNull(), F.struct("n", (-F.col("size")).alias("s")))
    return n.groupBy(by).agg(F.coalesce(F.max_by("size", order), F.lit(12.0)).alias("body_size"))


def body_font(spans: DataFrame, by: str, font: str, chars: str, place: str) -> DataFrame:
    """The font with most characters; of equal ones the first seen, and of those seen at one place the last by name."""
    n = spans.groupBy(by, font).agg(F.sum(chars).alias("chars"), F.min(place).alias("first"))
    return n.groupBy(by).agg(F.max_by(font, F.struct("chars", (-F.col("first")).alias("f"), font)).alias("font"))


def line_breaks(lines: DataFrame, by: str, y: str, order: list[str], factor: float = 1.2) -> DataFrame:
    """Adds gap, median_gap (of positive gaps) and is_break: a gap of more than `factor` medians."""
    w = Window.partitionBy(by).orderBy(*order)
    gaps = lines.withColumn("gap", F.col(y) - F.lag(y).over(w))
    median = gaps.filter("gap > 0").groupBy(by).agg(F.median("gap").alias("median_gap"))
    return gaps.join(median, by, "left").withColumn("is_break", F.coalesce(F.col("gap") > factor * F.col("median_gap"), F.lit(False)))


def midpoint_bins(blocks: DataFrame, by: str, x0: str, x1: str, width: str) -> DataFrame:
    """(by, width, bins): a histogram of the blocks' middles over the page; the last bin is closed."""
    place = F.greatest(F.lit(0), F.least(F.lit(BINS - 1), F.floor((F.col(x0) + F.col(x1)) / 2 / (F.col(width) / BINS)))).cast("int")
    n = blocks.groupBy(by, F.col(width).alias("width"), place.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    maps = n.groupBy(by, "width").agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("m"))
    return maps.select(by, "width", F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0))).alias("bins"))


def columns(blocks: DataFrame, by: str, x0: str, x1: str, width: str, share: float = 0.3) -> DataFrame:
    """(by, n_columns, split_x, degraded): two columns if the middles leave one gap; flat if there are more."""
    b = midpoint_bins(blocks, by, x0, x1, width)
    # a gap spans at least `share` of the page, in bins
    least = max(int(share * BINS), 1)
    gaps = histogram_gaps(F.col("bins"), least)
    b = b.withColumn("gaps", gaps).withColumn("peaks", peaks(F.col("bins")))
    degraded = (F.col("peaks") >= 3) | (F.size("gaps") >= 2)
    two = ~degraded & (F.size("gaps") == 1)
    return b.select(by, F.when(two, 2).otherwise(1).alias("n_columns"), F.when(two, (F.get("gaps", F.lit(0)) + 0.5) * F.col("width") / BINS).alias("split_x"), degraded.alias("degraded"))


def outside_cells(blocks: DataFrame, cells: DataFrame, page: str = "page", tile: float = 64.0) -> DataFrame:
    """Blocks (page, x0, y0, x1, y1) whose middle lies in no cell of their page; borders count as inside.

    A page is cut into square tiles of side `tile`. A cell is in each tile that it meets and a
    middle in one, so blocks are held only against the cells of their tile.
    """
    place = lambda c: F.floor(c / tile)
    span = lambda a, b: F.explode(F.sequence(place(F.col(a)), place(F.col(b))))
    c = cells.select(page, "x0", "y0", "x1", "y1").filter("x0 <= x1 AND y0 <= y1").distinct().withColumn("__tx", span("x0", "x1")).withColumn("__ty", span("y0", "y1")).alias("c")
    b = blocks.alias("b")
    x, y = (F.col("b.x0") + F.col("b.x1")) / 2, (F.col("b.y0") + F.col("b.y1")) / 2
    inside = (F.col(f"b.{page}") == F.col(f"c.{page}")) & (place(x) == F.col("c.__tx")) & (place(y) == F.col("c.__ty"))
    inside &= x.between(F.col("c.x0"), F.col("c.x1")) & y.between(F.col("c.y0"), F.col("c.y1"))
    return b.join(c, inside, "left_anti")


def clip(rect: Column, images: Column) -> Column:
    """struct<x0,y0,x1,y1> cut back, image after image, to the larger part above or below each that it meets."""

    def step(r: Column, i: Column) -> Column:
        meets = (r["x0"] < i["x1"]) & (i["x0"] < r["x1"]) & (r["y0"] < i["y1"]) & (i["y0"] < r["y1"])
        above, below = F.greatest(F.lit(0.0), i["y0"] - r["y0"]), F.greatest(F.lit(0.0), r["y1"] - i["y1"])
        cut = F.when(above >= below, r.withField("y1", F.greatest(r["y0"], i["y0"]))).otherwise(r.withField("y0", F.least(r["y1"], i["y1"])))
        return F.when(meets, cut).otherwise(r)

    return F.aggregate(images, rect, step)


def decide(blocks: DataFrame, body: float = 12.0) -> DataFrame:
    """Adds action, reason and scale to blocks (kind, source_text, translated_text, width, height, hits_image)."""
    src, out = F.col("source_text"), F.col("translated_text")
    scale = S.fit_scale(F.length(F.coalesce(out, src)), F.col("width"), F.col("height"), F.lit(body))
    reason = (
        F.when(F.col("kind") == "math_passthrough", "math")
        .when(out.isNull() | (T.strip(src) == T.strip(out)), "identity")
        .when((F.col("height") < MIN_HEIGHT) | (F.col("width") < MIN_WIDTH), "too_small")
        .when(scale < READABLE, "too_dense")
        .when(F.col("hits_image"), "image_collision")
    )
    low = F.greatest(F.lit(SCALE_FLOOR), F.least(F.lit(SCALE_CEILING), scale))
    return blocks.withColumns({"action": F.when(reason.isNull(), "insert").otherwise("skip"), "reason": reason, "scale": F.when(reason.isNull(), low)})


def inserted(spare: Column, scale: Column) -> Column:
    """The flag after an insertion: no room left, or shrunk to fit."""
    return F.when(spare < 0, "overflow").when(scale < 1, "auto_adjusted")


def density(pages: DataFrame, by: str, text: str, least: int = 50) -> DataFrame:
    """(by, pages, chars_per_page, scanned): fewer than `least` characters a page on average."""
    n = pages.groupBy(by).agg(F.count(text).alias("pages"), F.sum(F.length(T.strip(F.col(text)))).alias("chars"))
    mean = F.when(F.col("pages") > 0, F.col("chars") / F.col("pages"))
    return n.select(by, "pages", mean.alias("chars_per_page"), F.coalesce(mean < least, F.lit(False)).alias("scanned"))


def confidence(pages: DataFrame, by: str, scores: Column) -> DataFrame:
    """(by, confidence, low): the mean of the scores, 1.0 without any; pages below the limit need review."""
    mean = F.coalesce(F.avg(scores), F.lit(1.0))
    return pages.groupBy(by).agg(mean.alias("confidence")).withColumn("low", F.col("confidence") < LOW_CONFIDENCE)


def reading_order(blocks: DataFrame, page: str = "page") -> DataFrame:
    """Ordinals from 0 in (page, column) by y; in a degraded page by (y, x) over all of it."""
    col = F.when(F.col("degraded"), F.lit(-1)).otherwise(F.col("col"))
    w = Window.partitionBy(page, col).orderBy("y0", F.when(F.col("degraded"), F.col("x0")).asc_nulls_first(), "x0")
    return blocks.withColumn("block", F.row_number().over(w) - 1)


def ocr_order(regions: DataFrame, page: str = "page") -> DataFrame:
    """By the order that recognition gave, unknown last, then as found."""
    w = Window.partitionBy(page).orderBy(F.coalesce("block_order", F.lit(9999)), "ordinal")
    return regions.withColumn("place", F.row_number().over(w) - 1)
