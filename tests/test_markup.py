"""Spans to HTML, in small cases and against a plain walk over random blocks."""

import html
import random
from collections import Counter
from statistics import median

import pytest

from weftline.operators import markup

SCHEMA = "block long, line int, y0 double, y1 double, spans array<struct<text:string,flags:int,font:string,size:double>>"


def span(text, size=10.0, flags=4, font="Body"):
    return (text, flags, font, size)


def rows(blocks):
    return [(b, n, *(line[0] or (None, None)), line[1]) for b, lines in blocks.items() for n, line in enumerate(lines)]


def written(spark, blocks, page=None):
    df = spark.createDataFrame(rows(blocks), SCHEMA)
    if page:
        from pyspark.sql import functions as F

        df = df.withColumn("page_size", F.lit(page))
    return {r.block: r.html for r in markup.to_html(df.repartition(3), ["block"], "page_size" if page else None).collect()}


@pytest.fixture(scope="module")
def cases(spark):
    alone = lambda *s: [(None, list(s))]
    at = lambda y, *s, h=10: ((float(y), float(y + h)), list(s))
    return written(spark, {
        1: [(None, [span("Introduction", 24.0, 0, "")]), (None, [span("Body text here.", 12.0, 0, "")])],
        2: [(None, [span("Normal text.", 12.0, 0, "")]), (None, [span("More.", 12.0, 0, "")])],
        3: alone(span("Open", flags=16), span(" ", flags=16), span("Access", flags=16)),
        4: [at(100, span("Methods:", font="V"), span(" Two real world clinical datasets.")), at(112, span("More body text on the next line.")), at(128, span("Results:", font="V"), span(" It was the most accurate."))],
        5: [at(100, span("(Continued)", 8.0), h=8), at(110, span("Conclusion: ", font="Bold"), span("Better accuracy was shown."))],
        6: [at(y, span(f"Line {y}.")) for y in (100, 112, 124, 133, 145, 157)],
        7: alone(span("Thanks", font="V"), span(" We thank all of those who gave data.")),
        8: alone(span("Background:", font="V"), span(" Missing data is pervasive.")),
        9: alone(span("Item 1.", font="V"), span(" Some text that is long enough. "), span("Item 2.", font="V"), span(" More text, also long enough.")),
        10: alone(span("a < b & 'c'"), span("x", flags=18)),
        11: [(None, []), (None, None)],
        12: alone(span("sum of the values is "), span("Σ", font="ABC+CMSY10"), span(" and more")),
        13: [(None, [span("")]), (None, [span("late")])],
    })


@pytest.mark.parametrize("block, expected", [
    (1, "<h1>Introduction</h1><br> Body text here."),
    (2, "Normal text. More."),
    (3, "<b>Open Access</b>"),
    (4, "<b>Methods:</b> Two real world clinical datasets. More body text on the next line. <br><b>Results:</b> It was the most accurate."),
    (5, "(Continued)<br><b>Conclusion: </b>Better accuracy was shown."),
    (6, "Line 100. Line 112. Line 124. Line 133. Line 145. Line 157."),
    (7, "<b>Thanks</b><br> We thank all of those who gave data."),
    (8, "<b>Background:</b> Missing data is pervasive."),
    (9, "<b>Item 1.</b><br> Some text that is long enough. <br><b>Item 2.</b> More text, also long enough."),
    (10, "a &lt; b &amp; &#x27;c&#x27;<b><i>x</i></b>"),
    (11, ""),
    (12, "sum of the values is Σ and more"),
    (13, "late"),
])
def test_blocks(cases, block, expected):
    assert cases[block] == expected


def test_a_large_block_is_a_heading_of_its_page(spark):
    assert written(spark, {1: [(None, [span("A Title", 20.0)])], 2: [(None, [span("text")])]}, page=10.0) == {1: "<h1>A Title</h1>", 2: "text"}


def plain(lines):
    """What is asked for, in one walk over a block's lines: runs as the columns give them."""
    spans = [s for _, l in lines for s in l]
    sizes = Counter(round(s[3] * 2) / 2 for s in spans if s[3] > 0)
    body = min((-n, s) for s, n in sizes.items())[1] if sizes else 12.0
    fonts = Counter()
    for t, _, f, s in spans:
        if s > 0 and abs(round(s * 2) / 2 - body) < 0.6 and f and t:
            fonts[f] += len(t)
    font = max(fonts, key=fonts.get) if fonts else ""
    gaps = [b[0][0] - a[0][0] for a, b in zip(lines, lines[1:], strict=False)]
    limit = median([g for g in gaps if g > 0] or [float("inf")]) * 1.2
    runs = []
    for n, (box, own) in enumerate(lines):
        if n and runs:
            before = lines[n - 1][0]
            tall, now = before[1] - before[0], box[1] - box[0]
            cut = gaps[n - 1] > limit or (tall > 0 and now > 0 and abs(tall - now) >= 1)
            runs.append(["br", ""] if cut else ["", " "])
        for t, flags, f, s in own:
            if t:
                bold, italic = flags & 16 or f.endswith("Bold"), flags & 2
                bold = bold or (not italic and f and f != font and abs(s - body) <= 1)
                runs.append(["h1" if s / body >= 1.8 else "h2" if s / body >= 1.4 else "b" * bool(bold) + "i" * bool(italic), t])
    out = []
    for style, t in runs:
        if out and out[-1][0] == style != "br":
            out[-1][1] += t
        else:
            out.append([style, t])
    return [(s, t) for s, t in out]


def test_runs_of_random_blocks(spark):
    rng, blocks = random.Random(3), {}
    for b in range(150):
        y, lines = 0.0, []
        for _ in range(rng.randrange(1, 7)):
            y += rng.choice([12.0, 12.0, 12.5, 18.0, 0.0, -40.0])
            own = [(rng.choice(["", " ", "Abc.", "d:", "Title", "ef "]), rng.choice([0, 2, 16, 18, 4]), rng.choice(["F", "G", "H-Bold"]), rng.choice([10.0, 10.0, 10.2, 10.25, 14.0, 18.5, 0.0])) for _ in range(rng.randrange(4))]
            lines.append(((y, y + rng.choice([10.0, 10.0, 10.5, 12.0])), own))
        blocks[b] = lines
    df = spark.createDataFrame(rows(blocks), SCHEMA)
    found = {}
    for r in sorted(markup.runs(df.repartition(5), ["block"]).collect()):
        found.setdefault(r.block, []).append((r.style, r.text))
    assert {b: [x for x in r if x != ("", "")] for b, r in found.items()} == {b: plain(lines) for b, lines in blocks.items()}
    text = {r.block: r.html for r in markup.to_html(df, ["block"]).collect()}
    strip = lambda s: html.unescape(s.replace("<br>", "").replace("<b>", "").replace("</b>", "").replace("<i>", "").replace("</i>", "").replace("<h1>", "").replace("</h1>", "").replace("<h2>", "").replace("</h2>", ""))
    assert {b: strip(t).strip() for b, t in text.items()} == {b: "".join(t for _, t in plain(lines)).strip() for b, lines in blocks.items()}


def test_empty(spark):
    assert markup.to_html(spark.createDataFrame([], SCHEMA), ["block"]).count() == 0
