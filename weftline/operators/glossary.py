"""Glossaries: validated imports and the terms that a job needs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.functions import text as T

# Accepted headers.
HEADERS = {
    "source_term": ["source_term", "source", "src", "Source Term", "Source"],
    "target_term": ["target_term", "target", "tgt", "Target Term", "Target"],
    "notes": ["notes", "note", "comment", "Notes", "Comment"],
}


def with_headers(raw: DataFrame) -> DataFrame:
    """Known spellings of the three columns, renamed; a byte order mark goes; the first of several counts."""
    found = {}
    for c in raw.columns:
        bare = c.lstrip("﻿").strip()
        for name, spellings in HEADERS.items():
            if bare in spellings:
                found.setdefault(name, c)
    if missing := [n for n in ("source_term", "target_term") if n not in found]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    notes = F.col(f"`{found['notes']}`") if "notes" in found else F.lit(None).cast("string")
    return raw.select(F.col(f"`{found['source_term']}`").alias("source_term"), F.col(f"`{found['target_term']}`").alias("target_term"), notes.alias("notes"))


def validated(rows: DataFrame) -> DataFrame:
    """Trimmed rows (row_num, source_term, target_term, notes) with `error`: what is wrong with a row, else null."""
    clean = rows.withColumns({c: T.strip(F.coalesce(c, F.lit(""))) for c in ("source_term", "target_term")})
    error = F.when((F.col("source_term") == "") | (F.col("target_term") == ""), "required").when((F.length("source_term") < 2) | (F.length("target_term") < 2), "too_short")
    return clean.withColumn("error", error)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """(row_num, source_term, target_term, notes) of a glossary file; the first bad row, counted from 2, rejects the file."""
    raw = with_headers(spark.read.csv(path, header=True, multiLine=True, escape='"'))
    place = Window.orderBy(F.monotonically_increasing_id())  # one file of one user: rows keep the order of the file
    rows = validated(raw.withColumn("row_num", F.row_number().over(place) + 1))
    bad = rows.filter(F.col("error").isNotNull()).orderBy("row_num").select("row_num", "error").head()
    if bad:
        raise ValueError(f"row {bad['row_num']}: {bad['error']}")
    return rows.select("row_num", "source_term", "target_term", "notes")


def read_tbx(spark: SparkSession, path: str, source: str, target: str) -> DataFrame:
    """(source_term, target_term) of a TBX file: the last term of each language in an entry; bad pairs are dropped."""
    entries = spark.read.format("xml").option("rowTag", "termEntry").schema("langSet array<struct<`_xml:lang`:string, tig:array<struct<term:string>>, ntig:array<struct<termGrp:struct<term:string>>>>>").load(path)
    terms = lambda s: F.concat(F.coalesce(F.transform(s["tig"], lambda t: t["term"]), F.array()), F.coalesce(F.transform(s["ntig"], lambda t: t["termGrp"]["term"]), F.array()))
    last = lambda lang: F.get(F.reverse(F.flatten(F.transform(F.filter("langSet", lambda s: s["_xml:lang"] == lang), terms))), F.lit(0))
    pairs = entries.select(T.strip(last(source)).alias("source_term"), T.strip(last(target)).alias("target_term"))
    return pairs.filter((F.length("source_term") >= 2) & (F.length("target_term") >= 2))


def import_terms(existing: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows to add: the first of equal source terms, unless the glossary has it."""
    first = rows.withColumn("__n", F.row_number().over(Window.partitionBy("source_term").orderBy("row_num"))).filter("__n = 1").drop("__n")
    return first.join(existing.select("source_term"), "source_term", "left_anti")


def import_summary(existing: DataFrame, rows: DataFrame) -> DataFrame:
    added = import_terms(existing, rows).agg(F.count(F.lit(1)).alias("imported"))
    return added.crossJoin(rows.agg(F.count(F.lit(1)).alias("n"))).select("imported", (F.col("n") - F.col("imported")).alias("skipped_duplicates"))  # two single rows
