import textwrap

import pytest

from weftline.llm import licenses


def laid_out(ids):
    """Sentences as one paragraph, those without an end closed by a semicolon."""
    return " ".join(s if s.endswith(".") else s + ";" for s in (licenses.SENTENCES[i] for i in ids))


@pytest.mark.parametrize("leader", ["", "# ", " * ", "// ", ";; ", "dnl ", "REM ", "    "])
def test_wrapped_licences_are_found(spark, leader):
    texts = []
    for _, ids in licenses.RULES:
        lines = textwrap.wrap(laid_out(ids), 72 - len(leader), break_long_words=False, break_on_hyphens=False)
        texts.append("\n".join(leader + x for x in ["Copyright 2020 A | B", "", *lines, "", "the end"]))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    for r in licenses.scan(df).collect():
        name, ids = licenses.RULES[r.doc_id]
        assert (r.sentence_ids, r.licenses) == (ids, [name])


def test_padding_blank_lines_and_titles(spark):
    grant = licenses.SENTENCES["mit-grant"]
    texts = ["MIT License\r\n\r\n" + grant.replace(" ", "\r\n", 30) + ":", "/***\n *" + grant.replace(" ", " " * 60) + "   *\n", grant.replace(" to deal", "\n\nto deal"), "x " + grant.replace(" to deal", "\nto deal"), "Licensed under | the MIT License | or so"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    assert [r.sentence_ids for r in licenses.scan(df).orderBy("doc_id").collect()] == [["mit-title-2", "mit-grant"], ["mit-grant"], [], [], []]
