"""Rules that the tables don't exercise, on literal rows."""

import datetime
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from weftline.functions import scalars as S
from weftline.functions import text as T
from weftline.operators import checks, glossary, jobs, layout, licensing, segments, translate
from weftline.sources import languages, office
from weftline.streaming import state

T0 = datetime.datetime(2026, 6, 1, 2)


def one(spark, **columns):
    """The values of column expressions."""
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).head().asDict()


def test_strip_and_passthrough(spark):
    values = ["", " ", " ", "42", "٤٢", "²", "x1", " 7\n"]
    got = spark.createDataFrame([(v,) for v in values], "t string").select(T.is_passthrough(F.col("t")).alias("p")).collect()
    assert [r.p for r in got] == [True, True, True, True, True, True, False, True]


def test_every_protected_pattern_and_the_order_of_numbers():
    text = "https://e.org {{x}} ${y} <%= z %> 2024-01-02T03:04:05Z v1.2.3-rc1 <b> élan@exämple.org"
    masked, kept = T.mask(text)
    assert masked == "⟦T0⟧ ⟦T2⟧ ⟦T3⟧ ⟦T4⟧ ⟦T5⟧ ⟦T6⟧ ⟦T7⟧ ⟦T1⟧"
    assert kept[1] == "élan@exämple.org"


def test_restore_keeps_unknown_marks(spark):
    got = one(spark, r=T.restore(F.lit("⟦T0⟧ ⟦T9⟧"), F.create_map(F.lit(0), F.lit("a"))))
    assert got["r"] == "a ⟦T9⟧"


@pytest.mark.parametrize("text", ["Range |||x|||", "|||", "a", "", "x||||y"])
def test_sentinel_round_trip(spark, text):
    e, n = T.escape_sentinel(F.lit(text))
    got = one(spark, e=e, n=n, back=T.restore_sentinel(e, n))
    assert "|||" not in got["e"]
    assert got["back"] == text


def test_breadcrumbs(spark):
    expected = {
        "slide.0.shape.2.tf.0.para.1": "Slide 1 / Shape 3",
        "slide.1.shape.2.group.shape.4.tf.0.para.0": "Slide 2 / Shape 5",
        "slide.1.notes.para.0": "Slide 2 / Notes",
        "page.0.col.1.block.2": "Page 1 / Col 2 / Block 3",
        "page.3.block.0": "Page 4 / Block 1",
        "page.0.table.1.row.2.col.3": "Page 1 / Table 2 / Row 3 / Col 4",
        "page.2.region.r7": "Page 3 / Region r7",
        "page.x.block.y": "Page ? / Block ?",
        "para.7.run1": "para.7.run1",
    }
    df = spark.createDataFrame([(k,) for k in expected], "p string").select("p", T.breadcrumb(F.col("p")).alias("b"))
    assert {r.p: r.b for r in df.collect()} == expected


def test_keys_fonts_and_sizes(spark):
    got = one(spark, k=T.format_key(F.lit("abcd-efg hijk2345zz")), m=T.mask_key(F.lit("00ab12")), s=T.mask_key(F.lit("ab")), ok=T.is_license_key(F.lit("ABCD-EF23-GHIJ-KLMN")), math=T.is_math_font(F.lit("ABCDEF+AdvP4C4E74")), body=T.is_math_font(F.lit("AdvTT3f84")), b=T.human_bytes(F.lit(1536)), p=T.path_part(F.lit("page.12.block.0")), q=T.path_part(F.lit("page.x")), i=T.initials(F.lit(" ada  lovelace king")))
    assert got == {"k": "ABCD-EFGH-IJK2-345Z", "m": "****-****-****-AB12", "s": "****-****-****-????", "ok": True, "math": True, "body": False, "b": "1.5 KB", "p": 12, "q": None, "i": "AL"}


def test_dates(spark):
    now = F.lit(T0)
    day = lambda s: F.lit(T0 + datetime.timedelta(seconds=s))
    got = one(spark, a=S.days_left(day(86400 * 2 + 1), now), b=S.days_left(day(86400 * 2 + 1), now, True), c=S.ttl_seconds(day(-5), now), d=S.relative_age(day(-59), now), e=S.relative_age(day(-7300), now), v=S.license_valid(F.lit("ACTIVE"), day(0), now), w=S.license_valid(F.lit("ACTIVE"), F.lit(None).cast("timestamp"), now), iso=S.parse_iso(F.lit("2026-01-01T00:00:00 02:00")), bad=S.parse_iso(F.lit("soon")))
    assert (got["a"], got["b"], got["c"], got["d"], got["e"], got["v"], got["w"], got["bad"]) == (2, 3, 0, "just now", "2h ago", False, True, None)
    assert got["iso"].isoformat() == "2025-12-31T22:00:00"


def test_greedy_batches(spark):
    rows = [(1, i, "x" * (4 * n)) for i, n in enumerate([3, 3, 3, 9, 1])] + [(2, 0, "x" * 40_000)]
    df = spark.createDataFrame(rows, "job_id int, seq int, text string")
    got = {(r.job_id, r.seq): r.batch for r in segments.greedy_batches(df, T.token_estimate(F.col("text")), 7).collect()}
    assert [got[1, i] for i in range(5)] == [0, 0, 1, 2, 3]
    assert got[2, 0] is None


def test_refusals_and_boundaries(spark):
    rows = [(1, 0, "ééééééééé", "ééééééééé"), (1, 1, "éééééééé", "éééééééé"), (1, 2, "ascii text here", "ascii text here"), (1, 3, "ab", "a" * 20), (1, 4, "x", None), (1, 5, "⟦T2⟧ ⟦T10⟧", "")]
    df = spark.createDataFrame(rows, "job_id int, seq int, source_text string, translated_text string")
    terms = spark.createDataFrame([("Ascii", "ASCIIX"), ("text", "y"), ("absent", "zz")], "source_term string, target_term string")
    got = {(r.seq, r.flag_type, r.details) for r in checks.flags(df, terms).collect()}
    assert got == {(0, "llm_refusal", "unchanged"), (3, "overflow", "ratio above threshold"), (2, "glossary_violation", "Ascii"), (5, "placeholder_mismatch", "⟦T10⟧,⟦T2⟧")}


@pytest.mark.parametrize(("reply", "expected"), [(str.upper, str.upper), (lambda t: t.replace("|||", " ").upper() if "|||" in t else t.upper(), str.upper)])
def test_translation_keeps_count_and_falls_back(spark, reply, expected):
    texts = ["Year", "Range |||x|||", "Total", "Year", " ", "42", "end |", "see https://e.org"]
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "job_id int, seq int, text string")
    got = {r.seq: r.translated_text for r in translate.translate(df, reply).collect()}
    assert [got[i] for i in range(len(texts))] == ["YEAR", "RANGE |||X|||", "TOTAL", "YEAR", " ", "42", "END |", "SEE https://e.org"]


def test_write_back(spark):
    df = spark.createDataFrame([(1, "para.0", 2, 3, "new")], "job_id int, position string, run_index int, run_group_size int, translated_text string")
    assert sorted((r.run_index, r.new_text) for r in translate.write_back(df).collect()) == [(2, "new"), (3, ""), (4, "")]


def licenses(spark):
    rows = [(i, "PRO", "ACTIVE", e) for i, e in enumerate([None, -1, 0, 1, 7 * 86400, 7 * 86400 + 1])] + [(9, "TRIAL", "REVOKED", None), (10, "PRO", "PENDING", None), (11, "PRO", "SUSPENDED", None)]
    rows = [(i, i, t, s, None if e is None else T0 + datetime.timedelta(seconds=e)) for i, t, s, e in rows]
    return spark.createDataFrame(rows, "id int, customer_id int, tier string, status string, expired_at timestamp")


def test_reconciliation_boundaries(spark):
    got = licensing.reconcile(licenses(spark), F.lit(T0), batch=1)
    assert [r.license_id for r in got["audit"].collect()] == [1]
    assert sorted(r.license_id for r in got["warnings"].collect()) == [3, 4]
    assert got["summary"].head().asDict() == {"expired": 1, "batches": 1}


def test_bulk_changes(spark):
    now = F.lit(T0)
    all_ok = licensing.suspend(licenses(spark), [0, 1, 77]).collect()
    assert {(r.id, r.status) for r in all_ok} == {(0, "SUSPENDED"), (1, "SUSPENDED")}
    mixed = {r.id: (r.outcome, r.status) for r in licensing.suspend(licenses(spark), [0, 10, 11]).collect()}
    assert mixed == {0: ("ok", "ACTIVE"), 10: ("bad_state", "PENDING"), 11: ("conflict", "SUSPENDED")}
    past = licensing.extend(licenses(spark), [0, 9], F.lit(T0), now).collect()
    assert {r.id: r.outcome for r in past} == {0: "bad_date", 9: "conflict"}
    tries = spark.createDataFrame([(10, 5, T0), (10, 3, T0), (0, 1, T0)], "license_id int, device int, ts timestamp")
    got = {r.license_id: (r.winner, r.outcome) for r in licensing.activate(licenses(spark), tries, now).collect()}
    assert got == {10: (3, "ok"), 0: (None, "bad_state")}


def test_glossary_files(spark, tmp_path):
    (tmp_path / "g.csv").write_bytes("﻿Source,tgt,Comment\nmã nguồn,source code,n\nmã nguồn,again,\nhai,two,\n".encode())
    rows = glossary.read_csv(spark, str(tmp_path / "g.csv"))
    have = spark.createDataFrame([("hai",)], "source_term string")
    assert [(r.source_term, r.target_term) for r in glossary.import_terms(have, rows).collect()] == [("mã nguồn", "source code")]
    assert glossary.import_summary(have, rows).head().asDict() == {"imported": 1, "skipped_duplicates": 2}
    (tmp_path / "bad.csv").write_text("source,target\nok,fine\nx,short\n")
    with pytest.raises(ValueError, match="row 3: too_short"):
        glossary.read_csv(spark, str(tmp_path / "bad.csv"))
    (tmp_path / "none.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError, match="missing columns"):
        glossary.read_csv(spark, str(tmp_path / "none.csv"))


def test_tbx(spark, tmp_path):
    entry = lambda a, b: f'<termEntry><langSet xml:lang="vi"><tig><term>{a}</term></tig></langSet><langSet xml:lang="en"><ntig><termGrp><term>{b}</term></termGrp></ntig></langSet></termEntry>'
    (tmp_path / "g.tbx").write_text(f"<martif><text><body>{entry('một', 'one')}{entry('x', 'short')}</body></text></martif>")
    assert [tuple(r) for r in glossary.read_tbx(spark, str(tmp_path / "g.tbx"), "vi", "en").collect()] == [("một", "one")]


def docx(body):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{office.W[1:-1]}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def test_docx(spark, tmp_path):
    p = lambda t: f"<w:p><w:r><w:t>{t[:1]}</w:t></w:r><w:r><w:t>{t[1:]}</w:t></w:r></w:p>"
    cell = lambda x: f"<w:tc>{x}</w:tc>"
    inner = f"<w:tbl><w:tr>{cell(p('inner'))}</w:tr></w:tbl>"
    content = docx(p("one") + p("") + f"<w:tbl><w:tr>{cell(p('a'))}{cell(p('b') + inner)}</w:tr></w:tbl>" + p("two"))
    (tmp_path / "f.docx").write_bytes(content)
    got = [(r.position, r.text) for r in office.segments(spark, str(tmp_path)).orderBy("walk").collect()]
    assert got == [("para.0", "one"), ("cell_para.0", "a"), ("cell_para.1", "b"), ("cell_para.2", "inner"), ("para.2", "two")]
    back = office.docx_with(content, {"para.0": "EINS", "cell_para.2": "innen"})
    assert [t for _, t, _ in office.docx_parts(back)] == ["EINS", "a", "b", "innen", "two"]
    md = office.markdown_docx("# Title\n\n## Part\n\na < b")
    assert [t for _, t, _ in office.docx_parts(md)] == ["Title", "Part", "a < b"]


def test_tracked_changes():
    xml = f'<w:document xmlns:w="{office.W[1:-1]}"><w:body><w:p><w:ins><w:r><w:t>new</w:t></w:r></w:ins><w:del><w:r><w:t>old</w:t></w:r></w:del></w:p></w:body></w:document>'.encode()
    out = office.without_tracked_changes(xml)
    assert b"new" in out and b"old" not in out and b"ins>" not in out
    assert office.has_tracked_changes(docx("<w:p><w:ins/></w:p>"))
    assert not office.has_tracked_changes(b"no zip")


def test_columns(spark):
    two = [(1, x, x + 100.0) for x in (50.0, 60.0, 55.0)] + [(1, x, x + 100.0) for x in (400.0, 410.0)]
    rows = two + [(2, 50.0, 500.0), (2, 60.0, 520.0)] + [(3, x, x + 40.0) for x in (20.0, 270.0, 520.0)]
    df = spark.createDataFrame(rows, "page int, x0 double, x1 double").withColumn("width", F.lit(595.0))
    got = {r.page: (r.n_columns, r.degraded) for r in layout.columns(df, "page", "x0", "x1", "width").collect()}
    assert got == {1: (2, False), 2: (1, False), 3: (1, True)}


def test_clip(spark):
    rect = F.struct(*[F.lit(float(v)).alias(n) for n, v in (("x0", 0), ("y0", 0), ("x1", 100), ("y1", 100))])
    image = F.array(F.struct(*[F.lit(float(v)).alias(n) for n, v in (("x0", 10), ("y0", 70), ("x1", 50), ("y1", 120))]))
    assert one(spark, r=layout.clip(rect, image))["r"].y1 == 70


def test_sizes_and_headings(spark):
    l = lambda x: F.lit(float(x))  # noqa: E731, E741
    got = one(spark, z=S.fit_scale(F.lit(10), l(0), l(10), l(12)), f=S.font_size(F.lit(10), l(200), l(30), l(24)), none=S.font_size(F.lit(10_000), l(20), l(10), l(24)), h1=S.heading_level(l(18), l(10)), h0=S.heading_level(l(18), l(0)), s=S.shrink(F.lit("aaaa"), F.lit("aaaaa"), l(1)))
    assert got == {"z": 1.0, "f": 24.0, "none": 8.0, "h1": 1, "h0": 0, "s": "auto_adjusted"}


def test_orders(spark):
    df = spark.createDataFrame([(1, None, 0), (1, 2, 1), (1, 1, 2), (1, None, 3)], "page int, block_order int, ordinal int")
    assert [r.ordinal for r in layout.ocr_order(df).orderBy("place").collect()] == [2, 1, 0, 3]


def test_state_changes(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "id int, t string, parent int")
    new = spark.createDataFrame([(2, "B"), (3, "C")], "id int, t string")
    assert sorted((r.id, r.t) for r in jobs.upsert(old, new, ["id"], ["t"]).collect()) == [(1, "a"), (2, "B")]
    assert jobs.insert_missing(old.select("id", "t"), new, ["id"]).count() == 3
    gone = spark.createDataFrame([(2,)], "id int")
    assert [r.id for r in jobs.cascade(old, gone, "parent").collect()] == [1]
    assert sorted((r.id, r.parent) for r in jobs.cascade(old, gone, "parent", keep=True).collect()) == [(1, 1), (2, None)]


def test_configs(spark, tmp_path):
    assert [tuple(r) for r in office.thresholds(spark, '{"vi->en": 1.8}').collect()] == [("vi", "en", 1.8)]
    (tmp_path / "s.csv").write_text("Name,99%\na,10\nAggregated,40\n")
    assert office.load_stats(spark, str(tmp_path / "s.csv"), 50).head().asDict() == {"p99": 40.0, "ok": True}
    page = '{"parsing_res_list": [], "overall_ocr_res": {"rec_scores": [0.5, 0.4]}, "page": 1}'
    (tmp_path / "o.json").write_text(page + "\n" + '{"res": ' + page + "}\n")
    assert [list(r.overall_ocr_res.rec_scores) for r in office.ocr_pages(spark, str(tmp_path / "o.json")).collect()] == [[0.5, 0.4]] * 2
    assert len(languages.ROWS) == 76 and "auto" not in languages.TARGETS


def attempts(spark):
    rows = [(u, i, float(i * g), f) for u, g, n in ((1, 100, 12), (2, 600, 12), (3, 599, 12)) for i, f in enumerate([True] * n)] + [(4, i, float(i), i != 3) for i in range(8)]
    return spark.createDataFrame(rows, "user_id long, event_id long, at double, failed boolean")


def test_lockout_stream_equals_batch_and_rule(spark, tmp_path):
    df = attempts(spark)
    rule, expected = state.Lockout(), {}
    for u in (1, 2, 3, 4):
        s = (0, 0.0, 0.0)
        for r in df.filter(F.col("user_id") == u).orderBy("at").collect():
            s, expected[u, r.event_id] = rule.step(s, r.at, r.failed)
    key = lambda rows: {(r.user_id, r.event_id): r.outcome for r in rows}
    assert key(state.lockout_batch(df).collect()) == expected
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    assert key(state.run_available(state.lockout_stream(stream), "lockout").collect()) == expected
    assert expected[2, 11] == "failed"  # at exactly the window's end the count starts anew


def test_progress_stream(spark, tmp_path):
    rows = [(j, s, "running" if s < 3 else "done", s, 3) for j in (1, 2) for s in range(4 - j + 1)]
    log = spark.createDataFrame(rows, "job_id long, seq long, status string, done int, total int")
    state.to_messages(log).write.text(str(tmp_path / "in"))
    stream = spark.readStream.text(str(tmp_path / "in"))
    got = {r.job_id: r.status for r in state.run_available(state.progress(stream), "progress", "complete").collect()}
    assert got == {1: "done", 2: "running"}


def test_cooldown(spark):
    df = spark.createDataFrame([("a", i, float(t)) for i, t in enumerate([0, 59, 60, 100, 125])], "key string, event_id long, at double")
    assert sorted(r.event_id for r in state.cooldown(df).collect()) == [0, 2, 4]


def test_texts_of_a_translation_are_shuffled_once_to_be_asked_and_once_to_be_spread(spark):
    """Also: segments of one number keep their own translations, and other columns stay."""
    rows = [(1, 0, "a b", "x"), (1, 0, "c", "y"), (1, 1, "a b", "z"), (1, None, "d", "n"), (None, 2, "e", "j"), (2, 0, "12", "p"), (2, 1, "|f", "q"), (2, 2, "g ||| h", "r"), (2, 3, "é", "s")]
    out = translate.translate(spark.createDataFrame(rows, "job_id int, seq int, text string, more string"), translate.upper)
    assert out.columns == ["job_id", "text", "seq", "more", "translated_text"]
    got = {(r.job_id, r.seq, r.text, r.more): r.translated_text for r in out.collect()}
    assert got == {(j, s, t, m): t if j is None else "É" if m == "s" else t.upper() for j, s, t, m in rows}
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
