import random

import pytest

from weftline.llm.packing import byte_encoder
from weftline.llm.tokencounts import Tree, pretoken_counter


def test_edits_give_the_count_of_a_full_encoding():
    pattern, count = pretoken_counter()
    encode = byte_encoder()
    rng = random.Random(7)
    alphabet = ["the ", "don't", "'ll", "'", " ", "  ", "\n\n", "été", "x" * 40, "12 ", "9", "!?", "  \t", "ß", "😀", "I'l", "re", "<|endoftext|>", "<|endof", "text|>", "<", "|>"]
    for _ in range(300):
        text = "".join(rng.choices(alphabet, k=rng.choice([0, 1, 5, 60, 900])))
        tree = Tree.of(text, pattern, count)
        for _ in range(6):
            a = rng.randint(0, len(text))
            b = min(len(text), a + rng.choice([0, 0, 1, 3, 50, 2000]))
            new = "".join(rng.choices(alphabet, k=rng.choice([0, 1, 2, 200])))
            expected = text[:a] + new + text[b:]
            tree = Tree.load(tree.dump())
            text, _ = tree.edit(text, a, b, new, pattern, count)
            assert text == expected
            assert tree.chars == len(text)
            assert tree.tokens == len(encode(text))
            assert [n for blk in tree.blocks for n in blk[0]] == [len(p) for p in pattern.findall(text)]


def test_a_small_edit_encodes_little_of_a_long_text():
    pattern, count = pretoken_counter()
    text = "some words of prose. " * 5000
    tree = Tree.of(text, pattern, count)
    _, fresh = tree.edit(text, 50_000, 50_001, "zz", pattern, count)
    assert fresh < 20


LONG = [" " * 1_000_000, "\n" * 1_000_000, "ab" * 500_000, "a" + " " * 50_000 + "<|endoftext|>" + "!" * 50_000, " x" * 600_000]


@pytest.mark.parametrize("k", range(len(LONG)))
def test_very_long_runs(k):
    import public_tokenizers
    from tokenizers import Tokenizer

    ids = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode(LONG[k], add_special_tokens=False).ids
    assert byte_encoder()(LONG[k]) == ids
    assert Tree.of(LONG[k], *pretoken_counter()).tokens == len(ids)


def test_ids_of_any_type_and_no_rows(spark):
    from pyspark.sql import functions as F

    from weftline.llm import packing, tokencounts

    rows = [("a", "x y", 1), (None, "<|endoftext|>", 2), ("a", "x y", 3), ("b", None, 4)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, tree int")
    built = tokencounts.build(docs)
    assert sorted((r.doc_id or "", r.n_tokens) for r in built.collect()) == [("", 1), ("a", 2), ("a", 2), ("b", 0)]
    edits = F.array(F.struct(F.lit(0).alias("start"), F.lit(1).alias("end"), F.lit("z").alias("text")))
    one = tokencounts.build_and_edit(docs, edits).drop("n_tokens_before").collect()
    two = tokencounts.apply_edits(built.withColumn("edits", edits), "edits").collect()
    assert sorted(map(str, one)) == sorted(map(str, two))
    assert sorted(r.length for r in packing.op6(docs).collect()) == [1, 2, 3, 3]
    assert packing.op6(docs.limit(0)).count() == tokencounts.op10(docs.limit(0)).count() == 0
