"""A corpus pipeline: language, quality, near-duplicates, source mix, packing.

Each stage reads all that its predecessor kept, from Parquet, and returns the
columns of `documents` (the last: packed pieces with their ids). What a stage wrote for
itself goes when it ends, and its result when the next has read it.

Defined cases: a null or empty text has no language and goes with the first stage; very
long texts are taken whole; of repeated rows one stays; columns beside those of
`documents` are kept by all but the last stage, whatever their names; an empty table gives
an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from weftline.llm import langid, mixing, packing, quality, simhash
from weftline.llm.common import remove, scratch, shared_dir


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in none of the corpus's languages go; a null language is filled in."""
    return langid.filter_language(docs)


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.filter_quality(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of the documents linked by a Jaccard similarity of at least 0.8, on shingles of five words."""
    return simhash.keep_similar(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; one taken twice is two rows."""
    return mixing.mixed(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 ids, with their ids and their place in a sequence."""
    return packing.pack_with_ids(docs)


STAGES = [("language", language), ("quality", rules), ("near_duplicates", near_duplicates), ("mix", mix), ("packing", packed)]

#: Language distances, near-duplicate components and tokenisation aren't expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}-{name}"
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            remove(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
