"""DOCX runs, PPTX shape trees and the sink of whole files."""

import io
import os
import zipfile

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from weftline.sources import docx_runs, filesink, office, pptx_shapes
from weftline.sources.ooxml import Package, R

W = docx_runs.W[1:-1]
SPACE = f'xmlns:w="{W}" xmlns:r="{R[1:-1]}" xmlns:mc="http://schemas.openxmlformats.org/markup-compatibility/2006" xmlns:w14="http://schemas.microsoft.com/office/word/2010/wordml" mc:Ignorable="w14"'


def r(text, props=""):
    return f'<w:r>{f"<w:rPr>{props}</w:rPr>" if props else ""}<w:t xml:space="preserve">{text}</w:t></w:r>'


def p(*runs):
    return f"<w:p>{''.join(runs)}</w:p>"


def docx(body, headers=None):
    out = io.BytesIO()
    rows = "".join(f'<Relationship Id="{i}" Type="{R[1:-1]}/header" Target="{i}.xml"/>' for i in headers or {})
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {SPACE}><w:body>{body}</w:body></w:document>")
        z.writestr("word/styles.xml", "<kept/>")
        z.writestr("word/_rels/document.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{rows}</Relationships>')
        for i, xml in (headers or {}).items():
            z.writestr(f"word/{i}.xml", f"<w:hdr {SPACE}>{xml}</w:hdr>")
    return out.getvalue()


def section(*refs):
    return "<w:sectPr>" + "".join(f'<w:{name}Reference w:type="{kind}" r:id="{i}"/>' for name, kind, i in refs) + "</w:sectPr>"


@pytest.fixture()
def grouped(spark):
    def run(*files):
        rows = spark.createDataFrame([(f"f{i}.docx", bytearray(c)) for i, c in enumerate(files)], "path string, content binary")
        return rows, docx_runs.grouped(docx_runs.runs_of(rows)).cache()

    return run


def listed(segments):
    return [(x.position, x.text, x.run_index, x.run_group_size) for x in segments.orderBy("path", "seq").collect()]


def test_runs_merge_by_format_and_split_where_it_changes(grouped):
    bold, off, red = "<w:b/>", '<w:b w:val="0"/>', '<w:color w:val="FF0000"/>'
    body = p(r("a", bold), r("b", bold), r("c"), r("d", off), r("e", bold), r("f", bold + red), r("g", bold + red)) + p() + p(r("  ")) + p(r("h"), "<w:hyperlink>" + r("link") + "</w:hyperlink>", r("i")) + p("<w:hyperlink>" + r("only") + "</w:hyperlink>")
    _, found = grouped(docx(body))
    assert listed(found) == [
        ("para.0.run0", "ab", 0, 2), ("para.0.run2", "c", 2, 1), ("para.0.run3", "d", 3, 1), ("para.0.run4", "e", 4, 1), ("para.0.run5", "fg", 5, 2),
        ("para.3.run0", "hi", 0, 2), ("para.4", "only", None, 1),
    ]
    assert [x.seq for x in found.orderBy("seq").collect()] == list(range(7))


def test_a_run_keeps_its_tabs_breaks_and_composed_letters(grouped):
    _, found = grouped(docx(p('<w:r><w:t>é</w:t><w:tab/><w:t>x</w:t><w:br/><w:t>y</w:t><w:br w:type="page"/><w:noBreakHyphen/></w:r>')))
    assert listed(found) == [("para.0.run0", "é\tx\ny-", 0, 1)]


def test_tables_by_rows_with_nested_ones_and_spans(grouped):
    cell = lambda x, props="": f"<w:tc><w:tcPr>{props}</w:tcPr>{x}</w:tc>"
    row = lambda *x: f"<w:tr>{''.join(x)}</w:tr>"
    inner = f"<w:tbl>{row(cell(p(r('in'))))}</w:tbl>"
    wide, top, under = '<w:gridSpan w:val="2"/>', '<w:vMerge w:val="restart"/>', "<w:vMerge/>"
    body = p(r("one")) + f"<w:tbl>{row(cell(p(r('A')), top), cell(p(r('B')) + inner + p(r('C'))))}{row(cell(p(), under), cell(p(r('D'))))}{row(cell(p(r('E')), wide))}</w:tbl>" + p(r("two"))
    _, found = grouped(docx(body))
    assert [x[1] for x in listed(found)] == ["one", "A", "B", "in", "C", "A", "D", "E", "E", "two"]
    assert [x[0].split(".")[0] for x in listed(found)] == ["para"] + ["cell_para"] * 8 + ["para"]


def test_headers_by_section_and_linked_ones_once(grouped):
    first, second = section(("header", "default", "h1"), ("footer", "even", "h2")), section(("header", "first", "h3"))
    body = f"<w:p><w:pPr>{first}</w:pPr>{r('one')}</w:p>" + p(r("two")) + second
    _, found = grouped(docx(body, {"h3": p(r("third")), "h2": p(r("second")), "h1": f"<w:tbl><w:tr><w:tc>{p(r('first'))}</w:tc></w:tr></w:tbl>", "unused": p(r("never"))}))
    assert [(x[0], x[1]) for x in listed(found)] == [("para.0.run0", "one"), ("para.1.run0", "two"), ("header.2.run0", "first"), ("header.3.run0", "second"), ("header.4.run0", "third")]


def test_written_texts_keep_formats_links_headers_and_other_parts(spark, grouped):
    body = p(r("a", "<w:b/>"), r("b", "<w:b/>"), r("c"), "<w:hyperlink>" + r("link", "<w:i/>") + "</w:hyperlink>") + p() + p("<w:hyperlink>" + r("only") + "</w:hyperlink>") + section(("header", "default", "h1"))
    content = docx(body, {"h1": p(r("head", "<w:u w:val='single'/>"))})
    same = docx(p(r("same")))
    files, found = grouped(content, same)
    new = found.filter("path = 'f0.docx'").select("path", "id", F.concat(F.upper("text"), F.lit("\t1\n2 ")).alias("new_text"))
    back = {x.path: bytes(x.content) for x in docx_runs.written_to(files, docx_runs.plan(found, new)).collect()}
    assert back["f1.docx"] == same
    package = Package(back["f0.docx"])
    assert package.parts["word/styles.xml"] == b"<kept/>" and b"xmlns:w14=" in package.parts["word/document.xml"]
    first = next(package.tree("word/document.xml").iter(docx_runs.W + "p"))
    assert [(docx_runs.run_text(x), docx_runs.run_format(x)[0]) for x in first.findall(docx_runs.W + "r")] == [("AB\t1\n2 ", True), ("", True), ("C\t1\n2 ", None)]
    assert docx_runs.paragraph_text(first).endswith("link")
    rows = {(x.para, x.run): (x.text, x.bold, x.underline) for x in docx_runs.runs_of(spark.createDataFrame([("x", bytearray(back["f0.docx"]))], "path string, content binary")).collect()}
    assert rows[2, 0][0] == "ONLY\t1\n2 " and rows[3, 0] == ("HEAD\t1\n2 ", None, "single")


def test_segments_of_files_are_those_of_their_runs_without_a_shuffle(spark, grouped):
    files, found = grouped(
        docx(p(r("a", "<w:b/>"), r("b", "<w:b/>"), r("c"), r("e"), r("\u0301 &amp; d"), r("  ", "<w:i/>")) + p() + p(r("\u3000")) + p("<w:hyperlink>" + r("only") + "</w:hyperlink>") + p(r("z", "<w:b/>"))),
        docx(""), b"no file", docx(p(r("x", '<w:b w:val="0"/>'), r("y", '<w:b w:val="false"/>'), r("z", "<w:b/><w:b w:val='0'/>"))),
    )
    own = docx_runs.segments_of(files)
    assert own.columns == found.columns and own.orderBy("path", "seq").collect() == found.orderBy("path", "seq").collect()
    assert "Exchange" not in own._jdf.queryExecution().executedPlan().toString()
    new = own.withColumn("new_text", F.upper("text"))
    kept = lambda plan: {x.path: sorted((w.para, w.run_index or 0, w.run_group_size, w.new_text) for w in x.writes) for x in plan.collect()}
    assert kept(docx_runs.plan(new)) == kept(docx_runs.plan(own, new.select("path", "id", "new_text")))


def test_indexes_beyond_the_runs_are_passed_over():
    content = docx(p(r("a"), r("b")))
    back = docx_runs.with_runs(content, [{"para": 0, "run_index": 5, "run_group_size": 1, "new_text": "x"}, {"para": 0, "run_index": 1, "run_group_size": 9, "new_text": "y"}, {"para": 7, "run_index": 0, "run_group_size": 1, "new_text": "z"}])
    assert docx_runs.paragraph_text(next(Package(back).tree("word/document.xml").iter(docx_runs.W + "p"))) == "ay"


def test_files_on_disk_and_unreadable_ones(spark, tmp_path):
    (tmp_path / "good.docx").write_bytes(docx(p(r("text"))))
    (tmp_path / "bad.docx").write_bytes(b"no zip")
    (tmp_path / "empty.docx").write_bytes(docx(""))
    (tmp_path / "other.txt").write_bytes(b"x")
    assert [x[1] for x in listed(docx_runs.grouped(docx_runs.runs(spark, str(tmp_path))))] == ["text"]
    assert [os.path.basename(x.path) for x in docx_runs.unreadable(spark, str(tmp_path)).collect()] == ["bad.docx"]


ODD = [
    p(r("a", "<w:b/>"), r("b &amp;lt; c"), r("d", '<w:rFonts w:ascii="X"/><w:b w:val="0"/>'), r(""), "<w:r><w:rPr><w:i/></w:rPr></w:r>", "<w:r/>", "<w:r><w:t/></w:r>", r("e")) + p(r("f")),
    p('<w:r w:rsidR="1" w:rsidRPr="2"><w:t>a</w:t></w:r><w:r w:rsidR="1"><w:rPr><w:b /><w:b w:val="0"/></w:rPr><w:t xml:space="preserve"> b </w:t></w:r><w:r><w:t xml:space="default">c</w:t></w:r>'),
    p(r("a") + "<!--" + r("hidden") + "-->" + r("b")), p("<w:r><w:t><![CDATA[" + r("text") + "]]></w:t></w:r>" + r("b")), p(r("a") + "<?x " + r("hidden") + "?>"),
    p(r("a > b") + r("]]&gt;") + r("\u00e9\u2028 e\u0301 \U0001f600") + r("x\ty") + r("x\r\ny") + r("&#233;") + r("q&quot;&apos;")),
    p("<w:hyperlink>" + r("li", "<w:b/>") + r("nk") + "</w:hyperlink>") + p("<w:hyperlink>" + r("li") + "</w:hyperlink>", r("own")),
    p("<w:r><w:txbxContent>" + p(r("box")) + "</w:txbxContent></w:r>" + r("after")) + p("<w:ins>" + r("new") + "</w:ins>"),
    "<w:tbl><w:tr><w:tc>" + p(r("one"), r("two", "<w:i/>")) + "</w:tc><w:tc>" + p(r("x")) + "</w:tc></w:tr></w:tbl>",
    p('<w:r w:x="1" w:x="2"><w:t>twice</w:t></w:r>'), p('<w:r><w:rPr><w:b w:val="1" w:val="2"/></w:rPr><w:t>twice</w:t></w:r>'), p(r("&none;")), p(r("a") + "<w:r>"), p(r("\x01")), p(r("") + '<w:r stretch-of-plain="0"/>' + r("a")),
    p(f'<x:r xmlns:x="{W}"><x:t>other</x:t></x:r>' + r("a")), p('<w:r xmlns:w="else"><w:t>else</w:t></w:r>' + r("a")), p("<w:r><w:rPr><w:b/></w:rPr><w:rPr><w:i/></w:rPr><w:t>a</w:t></w:r>"), "",
]


def test_stretches_of_plain_runs_read_and_write_as_trees_of_all_runs(monkeypatch):
    def read(content):
        x = docx_runs.Read()
        x.add("f", content)
        return x.tags, x.whole, x.runs, x.texts, [list(x.formats)[n] for n in x.looks]

    contents = [docx(b, {"h1": p(r("head"), r("er", "<w:u w:val='single'/>"))} if i == 0 else None) for i, b in enumerate(ODD)]
    writes = [(0, 0, 2, "N<e>w\t&\n\u0301 "), (0, 3, 1, " x"), (1, 0, 1, "e\u0301"), (1, None, 1, "whole"), (2, 0, 9, "head &")]

    def results():
        for content in contents:
            yield read(content)
            try:
                yield read(docx_runs.with_rows(content, writes))
            except docx_runs.BAD:
                yield "bad"

    short = list(results())
    whole = docx_runs.Document(contents[0]).tree("word/document.xml")
    assert len(list(whole.iter(docx_runs.W + "r"))) == 5  # of 9: two that are written without an end tag stand alone
    monkeypatch.setattr(docx_runs.Document, "_short", lambda self, part: part)
    assert short == list(results()) and sum(x == "bad" for x in short) == 5


def test_files_come_in_batches_of_bounded_size():
    from weftline.sources.ooxml import BYTES_AT_ONCE, batches_of

    sizes = [BYTES_AT_ONCE // 3] * 7 + [0, BYTES_AT_ONCE * 2, 5]
    got = list(batches_of((str(i), bytes(n)) for i, n in enumerate(sizes)))
    assert [x for b in got for x in b.column("path").to_pylist()] == [str(i) for i in range(10)]
    assert [b.num_rows for b in got] == [4, 5, 1]


# --- PPTX


def para(*runs):
    return "<a:p>" + "".join(f"<a:r><a:rPr b='1'/><a:t>{t}</a:t></a:r>" for t in runs) + "<a:endParaRPr/></a:p>"


def sp(*paras, ph=""):
    return f"<p:sp><p:nvSpPr><p:nvPr>{ph}</p:nvPr></p:nvSpPr><p:txBody>{''.join(paras)}</p:txBody></p:sp>"


BODY = '<p:ph type="body"/>'


@pytest.fixture()
def deck():
    table = "<p:graphicFrame><a:graphic><a:graphicData><a:tbl>" + "".join("<a:tr>" + "".join(f"<a:tc><a:txBody>{para(x)}</a:txBody></a:tc>" for x in row) + "</a:tr>" for row in ("ab", "cd")) + "</a:tbl></a:graphicData></a:graphic></p:graphicFrame>"
    smart = f'<p:graphicFrame><a:graphic><a:graphicData uri="{pptx_shapes.DIAGRAM}"><a:t>node</a:t><a:t> </a:t><a:t>two</a:t></a:graphicData></a:graphic></p:graphicFrame>'
    group = f"<p:grpSp><p:grpSpPr/>{sp(para('g0'))}<p:grpSp>{sp(para('deep'))}</p:grpSp></p:grpSp>"
    first = "<p:nvGrpSpPr/>" + sp(para("Ti", "tle"), para(" "), para("é ")) + "<p:pic/>" + table + group + smart
    return pptx_shapes.package([first, sp(para("second"))], [sp(para("master")) + "<p:pic/>" + sp(para("foot"))], {0: sp(para("number"), ph='<p:ph type="sldNum"/>') + sp(para("note"), para(), ph=BODY)})


def test_pptx_positions(deck):
    assert list(pptx_shapes.texts(deck)) == [
        ("master.0.shape.0.para.0", "master"), ("master.0.shape.2.para.0", "foot"),
        ("slide.0.shape.0.tf.0.para.0", "Title"), ("slide.0.shape.0.tf.0.para.2", "é"),
        *[(f"slide.0.shape.2.table.row.{i // 2}.col.{i % 2}.para.0", x) for i, x in enumerate("abcd")],
        ("slide.0.shape.3.group.shape.0.tf.0.para.0", "g0"), ("slide.0.shape.3.group.shape.1.group.shape.0.tf.0.para.0", "deep"),
        ("slide.0.shape.4.smartart", "node two"), ("slide.0.notes.para.0", "note"), ("slide.1.shape.0.tf.0.para.0", "second"),
    ]


def test_pptx_write_back_by_position(spark, deck, tmp_path):
    (tmp_path / "deck.pptx").write_bytes(deck)
    (tmp_path / "bad.pptx").write_bytes(b"no zip")
    found = pptx_shapes.positions(spark, str(tmp_path)).cache()
    new = found.select("path", "id", F.upper("text").alias("new_text")).filter("new_text NOT IN ('FOOT', 'A')")
    good = found.select("path").distinct().head().path
    out = pptx_shapes.written(spark, good, pptx_shapes.placed(found, new)).head()
    back = dict(pptx_shapes.texts(bytes(out.content)))
    assert back["slide.0.shape.0.tf.0.para.0"] == "TITLE" and back["slide.0.shape.0.tf.0.para.2"] == "É" and back["slide.0.notes.para.0"] == "NOTE"
    assert back["master.0.shape.2.para.0"] == "foot" and back["slide.0.shape.2.table.row.0.col.0.para.0"] == "a" and back["slide.0.shape.4.smartart"] == "node two"
    root = Package(bytes(out.content)).tree("ppt/slides/slide2.xml")
    runs = root.find(f".//{pptx_shapes.A}p").findall(f"{pptx_shapes.A}r")
    assert [(x.findtext(f"{pptx_shapes.A}t"), x.find(f"{pptx_shapes.A}rPr").get("b")) for x in runs] == [("TITLE", "1"), ("", "1")]


def cells(*texts, head="", end=""):
    return f"<p:graphicFrame><a:graphic><a:graphicData><a:tbl><a:tr>{''.join(f'<a:tc><a:txBody>{head}<a:p><a:r><a:t>{t}</a:t></a:r>{end}</a:p></a:txBody></a:tc>' for t in texts)}</a:tr></a:tbl></a:graphicData></a:graphic></p:graphicFrame>"


ODD_SLIDES = [
    cells("a", " b &amp;lt; ", "", "c > d", "x\ty", "e\u0301 \u2028", "&#233;", "q&quot;&apos;", head='<a:bodyPr wrap="none"/><a:lstStyle />', end='<a:endParaRPr lang="en"/>'),
    cells("a", "b").replace("</a:tr>", '<a:tc gridSpan="2"><a:txBody><a:p><a:r><a:rPr b="1"/><a:t>w</a:t></a:r></a:p></a:txBody><a:tcPr/></a:tc>' + "<a:tc><a:txBody><a:p><a:r><a:t>1</a:t></a:r><a:br/><a:r><a:t>2</a:t></a:r></a:p>" + para("p") + "</a:txBody></a:tc><a:tc/></a:tr><a:tr></a:tr>"),
    cells("a", end="<a:br/>") + cells("b", head="<a:p/>") + cells("c", end="<a:fld/>") + cells("d") + sp(para("own")) + "<p:grpSp>" + cells("in", "group") + "</p:grpSp>",
    cells("a", "<!--x-->", "b"), cells("a") + "<?x <a:tc> ?>", cells("<![CDATA[x]]>", "b"), cells("a", head='<a:bodyPr a="1" a="2"/>'), cells("&none;"), cells("a").replace("</a:tr>", "</a:tc></a:tr>"), cells("a", "stretch-of-plain"),
    f'<p:graphicFrame><a:graphic><a:graphicData uri="{pptx_shapes.DIAGRAM}"><a:t>node</a:t></a:graphicData></a:graphic></p:graphicFrame>' + cells("a", "b"),
    f'<p:graphicFrame><a:graphic><a:graphicData><a:tbl><a:tr><x:tc xmlns:x="{pptx_shapes.A[1:-1]}"><x:txBody><x:p><x:r><x:t>o</x:t></x:r></x:p></x:txBody></x:tc></a:tr></a:tbl></a:graphicData></a:graphic></p:graphicFrame>' + cells("a"),
]


def test_plain_cells_read_and_write_as_trees_of_all_elements(monkeypatch):
    def read(content):
        try:
            return list(pptx_shapes.texts(content))
        except docx_runs.BAD:
            return "bad"

    decks = [pptx_shapes.package([slide, cells("second", "slide")], notes={0: sp(para("note"), ph=BODY)}) for slide in ODD_SLIDES]
    places = [f"slide.{n}.shape.{s}.table.row.0.col.{c}.para.{k}" for n in (0, 1) for s in (0, 1) for c in (1, 3) for k in (0, 1)]

    def results():
        for content in decks:
            yield read(content)
            try:
                yield read(pptx_shapes.with_texts(content, {p: f"<{p}> &\te\u0301" for p in places}))
            except docx_runs.BAD:
                yield "bad"

    short = list(results())
    assert len(list(pptx_shapes.Deck(decks[0]).tree("ppt/slides/slide2.xml").iter(pptx_shapes.A + "tc"))) == 5  # of 8: two that the pattern leaves split the others
    monkeypatch.setattr(pptx_shapes.Deck, "_short", lambda self, part: part)
    assert short == list(results()) and short.count("bad") == 6 and len(short[0]) == 10


def test_an_archive_holds_what_zipfile_reads(monkeypatch):
    from weftline.sources.ooxml import archive

    parts = {"a/b.xml": b"x" * 1000, "\u00e9.xml": b"", "c": bytes(range(256))}
    for limit in (False, True):
        content = archive((n, d, None) for n, d in (parts if not limit else {str(i): b"" for i in range(70_000)}).items())
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            assert z.testzip() is None and len(z.namelist()) == (70_000 if limit else 3)
            if not limit:
                assert {n: z.read(n) for n in z.namelist()} == parts
                assert Package(Package(content).saved(set())).parts == parts


def test_pptx_paragraph_without_runs_gets_one_before_its_end(deck):
    content = pptx_shapes.package([sp("<a:p><a:fld><a:t>7</a:t></a:fld><a:br/><a:endParaRPr/></a:p>")])
    assert list(pptx_shapes.texts(content)) == [("slide.0.shape.0.tf.0.para.0", "7")]
    back = pptx_shapes.with_texts(content, {"slide.0.shape.0.tf.0.para.0": "x", "slide.9.shape.0.tf.0.para.0": "never"})
    tags = [c.tag.rpartition("}")[2] for c in Package(back).tree("ppt/slides/slide1.xml").iter() if c.tag.startswith(pptx_shapes.A)]
    assert tags.index("r") < tags.index("endParaRPr")


def test_segments_of_a_folder_of_both_kinds(spark, deck, tmp_path):
    (tmp_path / "a.docx").write_bytes(docx(p(r("text"))))
    (tmp_path / "b.pptx").write_bytes(deck)
    kinds = {x.kind for x in office.segments(spark, str(tmp_path)).collect()}
    assert kinds == {"text", "smartart"}


# --- the sink


def files_in(folder):
    return sorted(os.path.relpath(os.path.join(d, f), folder) for d, _, names in os.walk(folder) for f in names)


def test_sink_moves_all_files_at_commit(spark, tmp_path):
    rows = spark.createDataFrame([(f"j{i}/out.docx", bytearray(b"x%d" % i)) for i in range(6)] + [("none.docx", None)], "name string, content binary").repartition(3)
    filesink.write_files(rows, str(tmp_path))
    assert files_in(tmp_path) == [f"j{i}/out.docx" for i in range(6)] and (tmp_path / "j3/out.docx").read_bytes() == b"x3"
    filesink.write_files(spark.createDataFrame([("j3/out.docx", bytearray(b"again"))], "name string, content binary"), str(tmp_path))
    assert (tmp_path / "j3/out.docx").read_bytes() == b"again" and len(files_in(tmp_path)) == 6


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    def fail(batches):
        import pyarrow as pa

        for b in batches:
            for i in range(len(b)):
                if b.column("name")[i].as_py() == "7":
                    raise RuntimeError("lost")
                yield pa.RecordBatch.from_arrays([b.column("name").slice(i, 1), b.column("content").slice(i, 1)], names=["name", "content"])

    (tmp_path / "3").write_bytes(b"before")
    rows = spark.createDataFrame([(str(i), bytearray(b"x")) for i in range(9)], "name string, content binary").repartition(3).mapInArrow(fail, "name string, content binary")
    with pytest.raises(PySparkException):
        filesink.write_files(rows, str(tmp_path))
    assert files_in(tmp_path) == ["3"] and (tmp_path / "3").read_bytes() == b"before"


@pytest.mark.parametrize("names", [["a", "a"], ["../a"], ["/tmp/a"], ["_fence"]])
def test_names_that_clash_or_leave_the_target_fail(spark, tmp_path, names):
    rows = spark.createDataFrame([("fine", bytearray(b"x")), *[(n, bytearray(b"x")) for n in names]], "name string, content binary")
    with pytest.raises(PySparkException):
        filesink.write_files(rows, str(tmp_path))
    assert files_in(tmp_path) == []


def test_an_older_fence_is_refused(spark, tmp_path):
    rows = lambda x: spark.createDataFrame([("out", bytearray(x))], "name string, content binary")
    filesink.write_files(rows(b"first"), str(tmp_path), fence=1)
    filesink.write_files(rows(b"second"), str(tmp_path), fence=2)
    with pytest.raises(PySparkException):
        filesink.write_files(rows(b"late"), str(tmp_path), fence=1)
    assert (tmp_path / "out").read_bytes() == b"second" and files_in(tmp_path) == ["_fence", "out"]


def test_font_suffixes_count_in_their_case(spark):
    from weftline.functions import text as T

    fonts = [("AdvTT.B", True, False), ("AdvTT.b", False, False), ("x-b", False, False), ("ABC+Arial-BoldOblique", True, True), ("Bold+Plain", False, False), ("HEAVY", True, False), ("AdvTT.I", False, True), ("AdvTT.i", False, False), ("a-italic", False, True), ("", False, False)]
    got = spark.createDataFrame(fonts, "f string, b boolean, i boolean").select("f", T.is_bold_font(F.col("f")), T.is_italic_font(F.col("f"))).collect()
    assert [tuple(x) for x in got] == fonts


def test_markdown_by_hand(spark):
    from weftline.operators import translate

    rows = [
        (1, 3, None, "text", "plain ", "", None), (1, 0, "doc_title", "text", "src", " Title ", None), (1, 1, "seal", "text", "seal", "seal", None), (1, 2, "header", "text", "src", "tr", "edited"),
        (1, 4, "figure", "figure_passthrough", "", None, None), (1, 5, "text", "math_passthrough", " x = 1 ", None, ""), (1, 6, "text", "text", "kept out", " ", None), (2, 0, "page_number", "text", "7", None, None),
    ]
    df = spark.createDataFrame(rows, "job_id long, seq int, label string, kind string, source_text string, translated_text string, edited_source_text string")
    assert dict(map(tuple, translate.to_markdown(df).collect())) == {1: "# Title\n\n## edited\n\nplain\n\n[Figure]\n\n x = 1 \n", 2: ""}


def test_write_back_queries_shuffle_files_and_their_writes_only(spark, tmp_path):
    from weftline.plans import catalogue

    spark.createDataFrame([(1, "one two\nthree"), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for query in (catalogue.docx_write_back, catalogue.pptx_write_back):
        plan = query(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Join ") == 1


def test_new_texts_of_segments_are_placed_as_joined_ones(spark):
    files = spark.createDataFrame([("a", bytearray(pptx_shapes.package([sp(para("one")) + sp(para("two"))])))], "path string, content binary")
    found = pptx_shapes.positions_of(files)
    new = found.withColumn("new_text", F.when(F.col("text") == "one", "ONE"))
    placed = lambda rows: sorted((w.position, w.text) for w in rows.head().writes)
    assert placed(pptx_shapes.placed(new)) == placed(pptx_shapes.placed(found, new.filter("new_text IS NOT NULL").select("path", "id", "new_text")))
    assert [w[1] for w in placed(pptx_shapes.placed(new))] == ["ONE", "two"]


def test_write_back_makes_files_once(spark, tmp_path):
    from weftline.plans import catalogue

    spark.createDataFrame([(i, f"one two\nthree {i}") for i in range(50)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for query in (catalogue.docx_write_back, catalogue.pptx_write_back):
        out = query(spark, str(tmp_path))
        assert len(out.collect()) > 50
        plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert "ReusedExchange" in plan and plan.count("MapInArrow make") == 1
