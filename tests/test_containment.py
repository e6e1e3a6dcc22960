"""Terms in texts, against a plain loop."""

import random

import pytest
from pyspark.sql import functions as F

from weftline.operators import checks, containment

SCHEMAS = "id int, source_text string", "source_term string, target_term string"


def expected(texts, terms):
    return sorted((i, s, t) for i, x in texts for s, t in terms if x is not None and s is not None and s.lower() in x.lower())


def got(df):
    return sorted(map(tuple, df.select("id", "source_term", "target_term").collect()))


@pytest.mark.parametrize("shards", [1, 3])
def test_terms_of_all_kinds(spark, shards):
    """Parts of words, one term in another, repeats on both sides, one letter, nothing, nulls, letters beyond the first plane."""
    texts = [(1, "The Stone house"), (2, "in"), (3, "onion"), (4, ""), (5, "stones stones"), (5, "stones stones"), (6, None), (7, "ÉLAN \U0001d538b"), (8, "x" * 200_000 + "Stone")]
    terms = [("stone", "a"), ("in", "b"), ("HOUSE", "c"), ("n", "d"), ("ones", "e"), ("Stone", "a"), ("stone", "a"), ("", "f"), (None, "g"), ("élan", "h"), ("\U0001d538B", "i"), ("e h", "j")]
    df, of = spark.createDataFrame(texts, SCHEMAS[0]), spark.createDataFrame(terms, SCHEMAS[1])
    assert got(checks.term_hits(df, of, shards=shards)) == expected(texts, terms)


def test_empty_sides_and_extra_columns(spark):
    texts, terms = spark.createDataFrame([(1, "a b", [1.5])], "id int, source_text string, `x.y` array<double>"), spark.createDataFrame([("a", "b")], SCHEMAS[1])
    assert [tuple(r) for r in checks.term_hits(texts, terms).collect()] == [(1, "a b", [1.5], "a", "b")]
    assert checks.term_hits(texts, terms.limit(0)).collect() == [] and checks.term_hits(texts.limit(0), terms).collect() == []
    with pytest.raises(ValueError, match="both sides"):
        checks.term_hits(texts.withColumn("target_term", F.lit("")), terms)


def test_a_glossary_of_a_hundred_thousand_terms(spark):
    """No job runs while the plan is made; hits equal those of a set of all parts of the texts."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(rng.randrange(5, 9)))
    terms = sorted({word() for _ in range(150_000)})[:100_000]
    texts = [(i, " ".join(word() for _ in range(30))) for i in range(300)]
    df, of = spark.createDataFrame(texts, SCHEMAS[0]), spark.createDataFrame([(w, w.upper()) for w in terms], SCHEMAS[1])
    spark.sparkContext.setJobGroup("glossary", "plan")
    hits = checks.term_hits(df, of, shards=2)
    assert spark.sparkContext.statusTracker().getJobIdsForGroup("glossary") == []
    known = set(terms)
    assert got(hits) == sorted((i, w, w.upper()) for i, x in texts for w in {x[a : a + n] for n in range(5, 9) for a in range(len(x) - n + 1)} & known)


def test_too_many_terms_for_a_task_say_so(spark):
    df, of = spark.createDataFrame([(1, "abc")], SCHEMAS[0]), spark.createDataFrame([(f"term {i}", "") for i in range(100)], SCHEMAS[1])
    with pytest.raises(Exception, match="raise shards above 1"):
        containment.contained(df, of, "source_text", "source_term", most=300).collect()
    assert containment.contained(df, of, "source_text", "source_term", shards=8, most=300).collect() == []
