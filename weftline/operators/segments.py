"""Segments: numbering, identity, deduplication around a costly step, and batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.operators.folds import Greedy, fold


def number(lines: DataFrame, order: str = "line") -> DataFrame:
    """Drops blank lines and numbers the rest from 0 within a job."""
    kept = lines.filter(T.strip(F.col("text")) != "")
    return kept.withColumn("seq", F.row_number().over(Window.partitionBy("job_id").orderBy(order)) - 1)


def identify(numbered: DataFrame, prefix: str = "para") -> DataFrame:
    position = F.concat(F.lit(prefix + "."), F.col("seq").cast("string"))
    return numbered.withColumn("position", position).withColumn("segment_id", T.segment_id(F.col("text"), position))


def distinct_texts(segments: DataFrame, by: str = "job_id") -> DataFrame:
    """The texts of a job in the order of their first occurrence, from 0."""
    first = segments.groupBy(by, "text").agg(F.min("seq").alias("first_seq"), F.count(F.lit(1)).alias("copies"))
    return first.withColumn("ordinal", F.row_number().over(Window.partitionBy(by).orderBy("first_seq")) - 1)


def spread(segments: DataFrame, results: DataFrame, by: str = "job_id") -> DataFrame:
    """Results for distinct texts, given back to every segment with the text."""
    return segments.join(results, [by, "text"], "left")


def chunks(distinct: DataFrame, size: int = 10, by: str = "job_id") -> DataFrame:
    """Full batches of `size` texts in order; the last may be smaller."""
    return distinct.withColumn("batch", F.floor(F.col("ordinal") / size).cast("int"))


def greedy_batches(segments: DataFrame, tokens: Column, budget: int = 3000, by: str = "job_id", hard: int = 7000) -> DataFrame:
    """Batches in order, flushed when the next text would pass the budget; a text is never split.

    A text above the hard limit makes its job an error (null batch). Rows are streamed, and long jobs are
    split over tasks (see `folds`); tokens that are null count as none.
    """
    counted = segments.select(by, F.col("seq").cast("int").alias("seq"), F.coalesce(tokens, F.lit(0)).cast("int").alias("tokens"))
    too_long = counted.filter(F.col("tokens") > hard).select(F.col(by).alias("__by")).distinct()
    batches = fold(counted, [by], ["seq"], Greedy(budget), "batch").join(too_long, F.col(by).eqNullSafe(F.col("__by")), "left")
    return batches.select(by, "seq", "tokens", F.when(F.col("__by").isNull(), F.col("batch")).alias("batch"))


def islands(rows: DataFrame, key: list[str], order: list[str], by: str) -> DataFrame:
    """Runs of adjacent rows with the same key: first place, size."""
    w = Window.partitionBy(by).orderBy(*order)
    k = F.struct(*key)
    marked = rows.withColumn("place", F.row_number().over(w) - 1).withColumn("new", (~k.eqNullSafe(F.lag(k).over(w))).cast("int"))
    marked = marked.withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(by, "island").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("size"), *[F.first(c).alias(c) for c in key])


def histogram_gaps(bins: Column, least: int) -> Column:
    """Midpoints of runs of at least `least` empty bins that have content at both sides."""
    n = F.size(bins)
    full = F.filter(F.transform(bins, lambda c, i: F.when(c > 0, i)), lambda i: i.isNotNull())
    spans = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(full) - 1)), lambda k: F.struct(F.get(full, k - 1).alias("a"), F.get(full, k).alias("b")))
    wide = F.filter(spans, lambda s: s["b"] - s["a"] - 1 >= least)
    return F.when(n >= 0, F.transform(wide, lambda s: F.floor((s["a"] + 1 + s["b"]) / 2).cast("int")))


def peaks(bins: Column) -> Column:
    """Runs of non-empty bins."""
    return F.size(F.filter(F.transform(bins, lambda c, i: (c > 0) & (F.coalesce(F.get(bins, i - 1), F.lit(0)) == 0)), lambda x: x))
