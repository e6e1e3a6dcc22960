"""The subpackage's queries, by name, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from weftline.llm import fingerprints, importance, langid, licenses, lm, mixing, packing, phrases, quality, simhash, substrings, tokencounts, warc
from weftline.llm.common import documents


def _over_documents(op: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: op(documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_language_id": _over_documents(langid.op1),
        "op2_pitman_yor_lm": _over_documents(lm.op2),
        "op3_warc_archive": warc.op3,
        "op4_source_mix": _over_documents(mixing.op4),
        "op5_license_scan": _over_documents(licenses.op5),
        "op6_best_fit_packing": _over_documents(packing.op6),
        "op7_paragraph_sketch": _over_documents(fingerprints.op7),
        "op8_quality_rules": _over_documents(quality.op8),
        "op9_simhash_dedup": _over_documents(simhash.op9),
        "op10_edit_token_counts": _over_documents(tokencounts.op10),
        "op11_phrase_collocations": _over_documents(phrases.op11),
        "op12_importance_resampling": importance.op12,
        "op13_substring_dedup": _over_documents(substrings.op13),
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_warc_archive": warc.OP3_SQL, "op4_source_mix": mixing.OP4_SQL, "op5_license_scan": licenses.OP5_SQL, "op8_quality_rules": quality.OP8_SQL, "op11_phrase_collocations": phrases.OP11_SQL, "op12_importance_resampling": importance.OP12_SQL, "op13_substring_dedup": substrings.OP13_SQL}
