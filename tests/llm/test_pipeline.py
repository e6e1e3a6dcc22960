import base64
import random
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from weftline.llm import packing, simhash

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark, docs, tmp_path):
    df = docs.select(*COLUMNS)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert got
    sizes = []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, df, str(tmp_path)).write.parquet(str(tmp_path / name))
        df = spark.read.parquet(str(tmp_path / name))
        sizes.append(df.count())
        if name != "packing":
            assert df.columns == COLUMNS
        if name == "near_duplicates":
            sets = [set(simhash.shingles(r.text.encode()).tolist()) for r in df.collect()]
            assert all(5 * len(a & b) < 4 * len(a | b) for i, a in enumerate(sets) for b in sets[:i])
        if name == "mix":
            assert max(Counter(r.doc_id for r in df.collect()).values()) <= 3
    assert sizes[0] >= sizes[1] >= sizes[2]
    assert sorted(map(str, df.collect())) == sorted(map(str, got))


def test_an_empty_table_and_clashing_columns(spark, docs, empty, tmp_path):
    """Names that the operators use themselves; rows and columns go through all stages but the last."""
    for k, start in enumerate((empty, docs.withColumns({c: F.lit(1) for c in ("skey", "oc", "ob", "before", "root", "h", "k", "t", "n", "score", "lang_pred", "length")}))):
        df = start
        for name, stage in corpus_pipeline.STAGES:
            path = str(tmp_path / f"{k}{name}")
            out = stage(spark, df, "")
            if name != "packing":
                assert out.columns == start.columns
            out.write.parquet(path)
            df = spark.read.parquet(path)
        assert (df.count() == 0) == (k == 0)


def test_language_stage_drops_what_is_no_language(spark, docs):
    """Random letters, base64 and other scripts go; a null language is filled in."""
    rng = random.Random(2)
    junk = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=3000)), base64.b64encode(rng.randbytes(2000)).decode(), "道可道非常道" * 50, "Все счастливые семьи похожи " * 9, None, "123 !!"]
    prose = docs.filter("doc_id < 60")
    added = spark.createDataFrame([(1000 + i, t, None, "s", 0) for i, t in enumerate(junk)], "doc_id long, text string, lang string, source string, n_chars long")
    some = prose.select(*COLUMNS).withColumn("lang", F.when(F.col("doc_id") > 5, F.col("lang"))).union(added)
    got = {r.doc_id: r.lang for r in corpus_pipeline.language(spark, some, "").collect()}
    assert got == {r.doc_id: r.lang for r in prose.collect()}


def test_packed_ids_are_those_of_the_texts(spark, docs):
    from weftline.llm.packing import END, byte_encoder

    encode = byte_encoder()
    of = {}
    for r in corpus_pipeline.packed(spark, docs.select(*COLUMNS).dropDuplicates(["doc_id"]), "").orderBy("doc_id", "piece").collect():
        assert len(r.ids) == r.length
        of.setdefault(r.doc_id, []).extend(r.ids)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    assert of == {i: [*encode(t), END] for i, t in texts.items()}


def test_ids_are_neither_sorted_nor_sent_through_python_again(spark, docs):
    """Places are found without the ids, which then are the same as if they had gone along: repeated, null and clashing document ids too."""
    docs = docs.select(*COLUMNS)
    some = docs.union(docs.filter("doc_id in (203, 101, 7)")).union(docs.filter("doc_id = 204").withColumn("doc_id", F.lit(None).cast("long"))).union(docs.filter("doc_id = 5").withColumn("doc_id", F.lit(6)))
    out = corpus_pipeline.packed(spark, some, "")
    plan = out._jdf.queryExecution().optimizedPlan().toString().splitlines()
    python, window = ([k for k, x in enumerate(plan) if name in x] for name in ("MapInArrow", "Window"))
    assert python and window and not any(re.search(r"\bids#", plan[k]) for k in python)
    depth = lambda k: re.search(r"[A-Z]", plan[k]).start()
    for k in window:
        below = next((j for j in range(k + 1, len(plan)) if depth(j) <= depth(k)), len(plan))
        assert not any("Project" in x and re.search(r"\bids#", x) for x in plan[k:below])
    got = out.collect()
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length for r in got)
    assert sorted(map(str, got)) == sorted(map(str, packing.pack(packing.pieces(some, with_ids=True)).select(out.columns).collect()))
    assert out.select(F.countDistinct("sequence_id", "offset")).head()[0] == len(got)
