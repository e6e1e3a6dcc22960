"""Checks of a translation: overflow, glossary, lost marks, untranslated text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions import scalars as S
from weftline.functions import text as T
from weftline.operators.containment import contained

# Fixed values.
FLAG_TYPES = ["overflow", "glossary_violation", "placeholder_mismatch", "llm_refusal", "smartart", "multi_column_degraded", "figure_passthrough", "ocr_page_error"]


def ratios(pairs: DataFrame, thresholds: DataFrame | None = None, default: float = 1.5) -> DataFrame:
    """Adds expansion_ratio and the threshold of the row's language pair (source_lang, target_lang), which `thresholds` has in lower case."""
    pairs = pairs.withColumn("expansion_ratio", S.expansion_ratio(F.col("source_text"), F.col("translated_text")))
    if thresholds is None:
        return pairs.withColumn("threshold", F.lit(default))
    of = thresholds.select(F.col("source_lang").alias("__s"), F.col("target_lang").alias("__t"), "threshold")
    pairs = pairs.join(of, (F.lower("source_lang") == F.col("__s")) & (F.lower("target_lang") == F.col("__t")), "left").drop("__s", "__t")
    return pairs.withColumn("threshold", F.coalesce("threshold", F.lit(default)))


def term_hits(texts: DataFrame, terms: DataFrame, text_col: str = "source_text", shards: int = 1) -> DataFrame:
    """Rows of texts with each term (source_term, target_term) that they contain, in any case; see `containment` for glossaries of any size."""
    return contained(texts, terms, text_col, "source_term", shards)


def flags(pairs: DataFrame, terms: DataFrame | None = None, thresholds: DataFrame | None = None) -> DataFrame:
    """(job_id, seq, flag_type, severity, details): one row per finding; segments without a translation are skipped.

    The checks of a row on its own are one projection; only the glossary needs a join.
    """
    pairs = ratios(pairs.filter(F.col("translated_text").isNotNull()), thresholds)
    src, out = F.col("source_text"), F.col("translated_text")
    flag = lambda kind, details: F.struct(F.lit(kind).alias("flag_type"), F.lit("warn").alias("severity"), details.alias("details"))
    missing = F.array_join(T.missing_marks(src, out), ",")
    own = F.array_compact(F.array(
        F.when(F.col("expansion_ratio") > F.col("threshold"), flag("overflow", F.lit("ratio above threshold"))),
        F.when(missing != "", flag("placeholder_mismatch", missing)),
        F.when((T.strip(src) == T.strip(out)) & (F.length(T.strip(src)) > 8) & ~T.is_ascii(T.strip(src)), flag("llm_refusal", F.lit("unchanged"))),
    ))
    found = pairs.select("job_id", "seq", F.inline(own))
    if terms is not None:
        hits = term_hits(pairs.select("job_id", "seq", "source_text", "translated_text"), terms.select("source_term", "target_term").filter(F.length("target_term") >= 2))
        lost = hits.filter(~T.contains_ci(out, F.col("target_term")))
        found = found.unionByName(lost.select("job_id", "seq", F.lit("glossary_violation").alias("flag_type"), F.lit("warn").alias("severity"), F.col("source_term").alias("details")))
    return found


def facets(found: DataFrame) -> DataFrame:
    """Flags by type."""
    return found.groupBy("flag_type").agg(F.count(F.lit(1)).alias("flags"))


def segment_facets(found: DataFrame) -> DataFrame:
    """Segments with a flag by type, with zeros for types that don't occur."""
    kinds = found.sparkSession.createDataFrame([(k,) for k in FLAG_TYPES], "flag_type string")
    n = found.groupBy("flag_type").agg(F.count_distinct("job_id", "seq").alias("segments"))
    return kinds.join(n, "flag_type", "left").select("flag_type", F.coalesce("segments", F.lit(0)).cast("long").alias("segments"))


def with_flags(segments: DataFrame, found: DataFrame) -> DataFrame:
    """Segments with the array of their flags, empty if they have none."""
    nested = found.groupBy("job_id", "seq").agg(F.array_sort(F.collect_list(F.struct("flag_type", "severity", "details"))).alias("flags"))
    return segments.join(nested, ["job_id", "seq"], "left").withColumn("flags", F.coalesce("flags", F.array()))


def flagged(segments: DataFrame, found: DataFrame, kind: str) -> DataFrame:
    return segments.join(found.filter(F.col("flag_type") == kind), ["job_id", "seq"], "left_semi")
