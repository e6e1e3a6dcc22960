"""Quality rules: a threshold table compiled into one native projection.

Each rule is a ratio of length, symbols, stop words or lines with a lower and an
upper bound. `judge` turns the table into Column expressions, so that a whole
corpus is judged in the scan's stage: no shuffle, no Python.

Defined cases: a null text counts as empty; empty and short texts fail by length;
repeated rows are judged alike; an empty table gives an empty result. Columns of
the input other than id and text are neither read nor returned by `judge`;
`filter_quality` returns the input's columns only, whatever their names are.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import SPACE, text_or_empty, words

# Frequent function words of English, French, German and Spanish.
STOP_WORDS = [
    "a", "an", "and", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "with",
    "au", "dans", "de", "des", "du", "elle", "en", "est", "et", "la", "le", "les", "par", "pas", "pour", "que", "qui", "sur", "un", "une",
    "auf", "das", "dem", "den", "der", "des", "die", "ein", "eine", "im", "ist", "mit", "nicht", "sich", "und", "von", "zu",
    "al", "como", "con", "del", "el", "es", "las", "los", "no", "para", "por", "se", "su", "y",
]

SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """A ratio with bounds; a text passes if low <= value <= high. A missing bound is not tested."""

    name: str
    value: str  # an SQL expression over the columns that `measure` makes
    low: float | None = None
    high: float | None = None

    def holds(self) -> Column:
        v = F.expr(self.value)
        tests = [v >= F.lit(self.low)] * (self.low is not None) + [v <= F.lit(self.high)] * (self.high is not None)
        out = F.lit(True)
        for t in tests:
            out = out & t
        return F.coalesce(out, F.lit(False))


#: The table. A text without words or lines has no ratios and fails their rules.
RULES = (
    Rule("length", "n_words", 50, 1_000_000),
    Rule("mean_word_length", "try_divide(word_chars, n_words)", 2.0, 15.0),
    Rule("symbol_share", "try_divide(n_symbols, n_words)", None, 0.1),
    Rule("upper_share", "try_divide(n_upper, word_chars)", None, 0.3),
    Rule("stop_word_share", "try_divide(n_stop, n_words)", 0.04, None),
    Rule("dup_line_share", "try_divide(n_dup_lines, n_lines)", None, 0.3),
    Rule("ellipsis_line_share", "try_divide(n_ellipsis, n_lines)", None, 0.3),
    Rule("repeat_word_share", "try_divide(n_repeat_words, n_words)", None, 0.5),
)


def _repeat_words(df: DataFrame) -> DataFrame:
    """Adds n_repeat_words: words in windows of three that occur twice or more in the text.

    Windows are compared by a 64-bit hash of their words. Sorting (hash, place) brings
    equal windows together; the places of such windows, sorted, are then swept once.
    Every step is a projection that reads the one before by name, so that none is
    evaluated anew inside a lambda.
    """
    w, h, s, p = "__wl_words", "__wl_hash", "__wl_sorted", "__wl_places"
    df = df.withColumn(h, F.when(F.size(w) >= 3, F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))).otherwise(F.array().cast("array<bigint>")))
    df = df.withColumn(s, F.when(F.size(F.array_distinct(h)) == F.size(h), F.array().cast("array<struct<h:bigint,i:int>>")).otherwise(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    same = lambda k, step: F.coalesce(F.get(s, k)["h"] == F.get(s, k + step)["h"], F.lit(False))
    df = df.withColumn(p, F.when(F.size(s) == 0, F.array().cast("array<int>")).otherwise(F.sort_array(F.transform(F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda k: same(k, -1) | same(k, 1)), lambda k: F.get(s, k)["i"]))))
    gaps = F.transform(F.col(p), lambda v, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - v, F.lit(3))))
    return df.withColumn("n_repeat_words", F.aggregate(gaps, F.lit(0), lambda a, x: a + x).cast("long")).drop(h, s, p)


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of `docs`: its id (and the columns in `keep`) and the counts that the rules use."""
    text = text_or_empty(text_col)
    df = docs.select(F.col(id_col).alias("doc_id"), *keep, text.alias("__wl_text"))
    df = df.withColumn("__wl_words", words(F.col("__wl_text"))).withColumn("__wl_lines", F.filter(F.split("__wl_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    df = _repeat_words(df)
    t = F.col("__wl_text")
    bare = F.lower(F.regexp_replace(t, r"[\p{P}&&[^'\-]]", " "))
    count = lambda c: c.cast("long")
    df = df.select(
        "doc_id", *keep, "n_repeat_words",
        count(F.size("__wl_words")).alias("n_words"),
        count(F.length(F.regexp_replace(t, SPACE, ""))).alias("word_chars"),
        count(F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).alias("n_symbols"),
        count(F.size("__wl_lines") - F.size(F.array_distinct("__wl_lines"))).alias("n_dup_lines"),
        count(F.size("__wl_lines")).alias("n_lines"),
        count(F.size(F.filter("__wl_lines", lambda x: x.rlike(r"(\.\.\.|…)[\x20\x09-\x0D]*$")))).alias("n_ellipsis"),
        count(F.regexp_count(t, F.lit(r"\p{Lu}"))).alias("n_upper"),
        count(F.size(F.filter(F.split(bare, SPACE + "+"), lambda x: x.isin(STOP_WORDS)))).alias("n_stop"),
    )
    return df


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES, keep: tuple[str, ...] = ()) -> DataFrame:
    """Counts, base_failed, kept and failed_rules (the names of the rules that a text breaks, in the table's order)."""
    df = measure(docs, id_col, text_col, keep)
    failed = F.filter(F.array(*[F.when(~r.holds(), F.lit(r.name)) for r in rules]), lambda x: x.isNotNull())
    df = df.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    return df.withColumn("failed_rules", failed).withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))


def filter_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of `docs` that pass, with the columns of `docs`.

    The partition number keeps the filter above the projection that computes `kept`;
    pushed below it, the filter would evaluate all its steps inside each other.
    """
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__wl_row"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return judge(packed, "doc_id", "text", rules, keep=("__wl_row",)).withColumn("__wl_p", F.spark_partition_id()).filter("kept AND __wl_p >= 0").select("__wl_row.*")


def op8(docs: DataFrame) -> DataFrame:
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP8_SQL = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT doc_id, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM t),
g AS (
  SELECT *, CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2]) ELSE [] END AS g FROM w),
x AS (SELECT doc_id, unnest(g) AS v, generate_subscripts(g, 1) AS i FROM g),
r AS (SELECT doc_id, v, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, v) AS n FROM x) WHERE n > 1),
p AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r, range(0, 3) s(k) GROUP BY doc_id),
m AS (
  SELECT g.doc_id, len(w) AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) AS word_chars,
         length(t) - length(translate(t, '{SYMBOLS}', '')) AS n_symbols,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(p.n, 0) AS n_repeat_words, len(lines) AS n_lines,
         len(list_filter(lines, lambda x: regexp_matches(x, '(\\.\\.\\.|…)[\\x20\\x09-\\x0D]*$'))) AS n_ellipsis,
         len(regexp_extract_all(t, '\\p{{Lu}}')) AS n_upper,
         len(list_filter(regexp_split_to_array(lower(regexp_replace(regexp_replace(t, '[\\x20\\x09-\\x0D]', ' ', 'g'), '[^\\P{{P}}''\\-]', ' ', 'g')), ' +'),
             lambda x: x IN ({", ".join("'" + s + "'" for s in STOP_WORDS)}))) AS n_stop
  FROM g LEFT JOIN p USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND CASE WHEN n_words < 50 THEN false ELSE
         n_words <= 1000000 AND word_chars / n_words BETWEEN 2.0 AND 15.0 AND n_symbols / n_words <= 0.1 AND n_upper / word_chars <= 0.3
         AND n_stop / n_words >= 0.04 AND n_dup_lines / n_lines <= 0.3 AND n_ellipsis / n_lines <= 0.3 AND n_repeat_words / n_words <= 0.5 END AS kept
FROM b
"""
