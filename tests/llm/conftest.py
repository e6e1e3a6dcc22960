import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, kept string, word string, fp long, score string"


@pytest.fixture(scope="session")
def rows():
    """Nulls in every column, empty and very long texts, repeated rows, ties, and columns whose names clash."""
    rng = random.Random(3)
    words = {"en": "the of and then with this that was house river stone over under".split(), "fr": "le la des une élève après maison rivière être où déjà".split()}
    prose = lambda lang, n: "".join(f"{rng.choice(words[lang])}{rng.choice([' ', ' ', ' ', '. ', chr(10)])}" for _ in range(n))
    out = []
    for i in range(60):
        lang = "en" if i % 3 else "fr"
        out.append((i, prose(lang, rng.choice([8, 60, 150, 400])), lang, f"s{i % 4}", None, i, "x", "w", i, "y"))
    base = out[5][1] + " " + prose("en", 300)
    out += [(100, base, "en", "s0", 1, None, None, None, None, None), (101, base, "en", "s1", 1, None, None, None, None, None), (102, base + " end", "en", "s1", 1, None, None, None, None, None)]
    out += [out[7], out[7]]  # repeated rows
    out += [(200, None, None, None, None, None, None, None, None, None), (201, "", "en", None, 0, 0, "", "", 0, ""), (202, " \t\n ", "fr", "s2", 4, 0, "", "", 0, "")]
    out += [(203, prose("en", 20_000), "en", "s3", 0, 0, "", "", 0, ""), (204, "12 34 !!", "en", "é", 8, 0, "", "", 0, ""), (205, " \x1c a\x0bb c İ ẞ 😀 " * 30, None, "s3", 8, 0, "", "", 0, ""), (206, "Released under the MIT License.\n" * 60, "en", "s3", 8, 0, "", "", 0, "")]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
