"""The translation step around a function that is passed in."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.operators import segments as G

#: Takes one text that joins several by the separator, or a single one, and returns its translation.
Translator = Callable[[str], str]


def identity(text: str) -> str:
    return text


def upper(text: str) -> str:
    return text.upper()


def translate(segments: DataFrame, translator: Translator, size: int = 10, calls: int = 8) -> DataFrame:
    """Adds translated_text to segments (job_id, seq, text).

    Equal texts of a job are translated once. Blank and numeric texts pass through.
    Texts are composed, protected and joined in batches; a reply with another number
    of parts is asked for again text by text. `calls` bounds how many run at once.
    """
    # a text is named by where it first occurs, so that no more than that goes along with what is asked
    name = F.struct(F.min("seq").over(Window.partitionBy("job_id", "text")).alias("first_seq"), F.xxhash64("text").alias("h"))
    unique = G.distinct_texts(segments)
    body = unique.filter(~T.is_passthrough(F.col("text")))
    body = G.distinct_texts(body.select("job_id", "text", F.col("first_seq").alias("seq")))
    body = body.withColumn("__name", F.struct("first_seq", F.xxhash64("text").alias("h")))
    m = T.mask_protected(T.nfc(F.col("text")))
    body = G.chunks(body, size).withColumn("__m", m)
    escaped, n = T.escape_sentinel(F.col("__m.masked"))
    # a text with a bar at an end would run into the separator, and is asked for alone
    body = body.withColumn("batch", F.when(F.col("text").rlike(r"^\||\|$"), -1 - F.col("ordinal")).otherwise(F.col("batch")))
    body = body.withColumns({"escaped": escaped, "n": n, "tokens": F.map_entries("__m.tokens")})
    batches = body.groupBy("job_id", "batch").agg(F.array_sort(F.collect_list(F.struct("ordinal", "escaped", F.col("__name").alias("name"), "n", "tokens"))).alias("parts"))
    ask = F.array_join(F.transform("parts", lambda p: p["escaped"]), T.SENTINEL)
    batches = batches.select("job_id", ask.alias("ask"), F.transform("parts", lambda p: F.struct(p["name"].alias("name"), p["n"].alias("n"), p["tokens"].alias("tokens"))).alias("parts")).repartition(calls)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f in frames:
            answers = []
            for ask in f.column("ask").to_pylist():
                parts = ask.split(T.SENTINEL)
                got = translator(ask).split(T.SENTINEL)
                answers.append(got if len(got) == len(parts) else [translator(p) for p in parts])
            yield pa.RecordBatch.from_arrays([f.column("job_id"), f.column("parts"), pa.array(answers, pa.list_(pa.string()))], names=["job_id", "parts", "answers"])

    kinds = {c: batches.schema[c].dataType.simpleString() for c in ("job_id", "parts")}
    back = batches.mapInArrow(run, f"job_id {kinds['job_id']}, parts {kinds['parts']}, answers array<string>")
    back = back.select("job_id", F.explode(F.arrays_zip("parts", "answers")).alias("z"))
    text = T.restore(T.restore_sentinel(F.col("z.answers"), F.col("z.parts.n")), F.map_from_entries("z.parts.tokens"))
    done = back.select(F.col("job_id").alias("__job"), F.col("z.parts.name").alias("__done"), T.nfc(text).alias("translated_text"))
    named = segments.withColumn("__name", name)
    same = (F.col("job_id") == F.col("__job")) & (F.col("__name.h") == F.col("__done.h")) & F.col("__name.first_seq").eqNullSafe(F.col("__done.first_seq"))
    out = named.join(done, same, "left")
    rest = [F.col(f"`{c}`") for c in segments.columns if c not in ("job_id", "text")]
    return out.select("job_id", "text", *rest, F.coalesce("translated_text", "text").alias("translated_text"))


def effective_text(edited: str, translated: str):
    """What is exported: an edit counts even if it is empty."""
    return F.coalesce(F.col(edited), F.col(translated), F.lit(""))


def effective_source(edited: str, source: str):
    """What is translated anew: an empty edit counts as none."""
    return F.coalesce(F.nullif(F.col(edited), F.lit("")), F.col(source))


def write_back(segments: DataFrame) -> DataFrame:
    """(position, run_index, new_text) for runs: the first run of a group gets the text, the others are emptied."""
    runs = segments.withColumn("k", F.explode(F.sequence(F.lit(0), F.greatest(F.col("run_group_size"), F.lit(1)) - 1)))
    return runs.select("job_id", "position", (F.coalesce("run_index", F.lit(0)) + F.col("k")).alias("run_index"), F.when(F.col("k") == 0, F.col("translated_text")).otherwise("").alias("new_text"))


def to_markdown(segments: DataFrame) -> DataFrame:
    """(job_id, markdown) from job_id, seq, label, kind, source_text, translated_text and edited_source_text.

    The corrected source counts first, then the translation, then the source; empty ones count as none. Titles and headers
    become headings, passed-through figures a mark; seals, page numbers and blank texts are left out. Blocks end with a blank line, and
    texts are stripped but for formulas. A job without a block has an empty text.
    """
    label = F.coalesce("label", F.lit("text"))
    kind = F.coalesce("kind", F.lit("text"))
    text = F.coalesce(F.nullif("edited_source_text", F.lit("")), F.nullif("translated_text", F.lit("")), F.col("source_text"), F.lit(""))
    body, figure = T.strip(text), kind == "figure_passthrough"
    line = F.when(figure, "[Figure]").when(label == "doc_title", F.concat(F.lit("# "), body)).when(label.isin("paragraph_title", "header"), F.concat(F.lit("## "), body))
    line = line.when((kind == "math_passthrough") & (label != "table"), text).otherwise(body)
    kept = ~label.isin("seal", "page_number") & (figure | (body != ""))
    lines = segments.groupBy("job_id").agg(F.array_sort(F.collect_list(F.when(kept, F.struct("seq", line.alias("line"))))).alias("s"))
    joined = F.concat(F.array_join(F.transform("s", lambda x: x["line"]), "\n\n"), F.lit("\n"))
    return lines.select("job_id", F.when(F.size("s") > 0, joined).otherwise("").alias("markdown"))
