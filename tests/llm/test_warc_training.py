import random

from weftline.llm import warc
from weftline.llm.common import cut


def trained(spark, rows, **how):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    return warc.train(pages, cut(warc.plan(pages)), **how)


def test_large_pages_get_a_dictionary(spark):
    rng = random.Random(1)
    words = [f"word{i}" for i in range(500)]
    rows = [(i, "u", "<html><body>" + " ".join(rng.choices(words, k=7000))) for i in range(40)]
    assert min(len(r[2]) for r in rows) > 32 << 10
    assert trained(spark, rows)


def test_short_pages_do_not_take_the_places_of_others(spark):
    rng = random.Random(2)
    words = [f"word{i}" for i in range(500)]
    rows = [(i, "u", f"x{i}") for i in range(400)] + [(1000 + i, "u", "<html>" + " ".join(rng.choices(words, k=300))) for i in range(40)]
    assert trained(spark, rows, samples=40)
