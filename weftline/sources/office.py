"""DOCX and PPTX files as segments, and text written back: zip and XML from the standard library, in tasks.

PDF and scanned pages need libraries of their own; their extraction results are read
as JSON (`ocr_pages`) and enter the same operators.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.sources import pptx_shapes

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
SEGMENTS = "path string, walk int, position string, text string, kind string"


def file_format(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^.]+)$", 1))


def docx_parts(content: bytes) -> Iterator[tuple[str, str, str]]:
    """(position, text, kind) of body paragraphs, table cells row by row (nested ones too), then headers and footers."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{W}body")
        extra = [ElementTree.fromstring(z.read(n)) for n in sorted(z.namelist()) if re.fullmatch(r"word/(header|footer)\d*\.xml", n)]
    counts = {"para": 0, "cell_para": 0, "header": 0}

    def para(p: ElementTree.Element, tag: str) -> Iterator[tuple[str, str, str]]:
        text = "".join(t.text or "" for t in p.iter(f"{W}t"))
        n = counts[tag]
        counts[tag] += 1
        if text.strip():
            yield f"{tag}.{n}", text, "table_cell" if tag == "cell_para" else "text"

    def walk(node: ElementTree.Element, tag: str) -> Iterator[tuple[str, str, str]]:
        for child in node:
            if child.tag == f"{W}p":
                yield from para(child, tag)
            elif child.tag == f"{W}tbl":
                for row in child.findall(f"{W}tr"):
                    for cell in row.findall(f"{W}tc"):
                        yield from walk(cell, "cell_para")

    yield from walk(body, "para")
    for part in extra:
        yield from walk(part, "header")


def pptx_parts(content: bytes) -> Iterator[tuple[str, str, str]]:
    """(position, text, kind) in the presentation's order."""
    for position, text in pptx_shapes.texts(content):
        yield position, text, "smartart" if position.endswith(".smartart") else "text"


PARTS = {"docx": docx_parts, "pptx": pptx_parts}


def segments(spark: SparkSession, path: str) -> DataFrame:
    """(path, walk, position, text, kind) of all DOCX and PPTX files under a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content").withColumn("format", file_format(F.col("path"))).filter(F.col("format").isin(*PARTS))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for p, content, kind in zip(f["path"], f["content"], f["format"], strict=True):
                rows = [(p, i, *x) for i, x in enumerate(PARTS[kind](content))]
                yield pd.DataFrame(rows, columns=["path", "walk", "position", "text", "kind"])

    return files.mapInPandas(run, SEGMENTS)


def has_tracked_changes(content: bytes) -> bool:
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            xml = z.read("word/document.xml")
    except (zipfile.BadZipFile, KeyError):
        return False
    return b"<w:ins" in xml or b"<w:del" in xml


def without_tracked_changes(xml: bytes) -> bytes:
    """Insertions are kept as plain text, deletions go."""
    root = ElementTree.fromstring(xml)
    for parent in list(root.iter()):
        for child in list(parent):
            if child.tag == f"{W}del":
                parent.remove(child)
            elif child.tag == f"{W}ins":
                at = list(parent).index(child)
                parent.remove(child)
                for k, c in enumerate(list(child)):
                    parent.insert(at + k, c)
    return ElementTree.tostring(root)


def docx_with(content: bytes, texts: dict[str, str]) -> bytes:
    """The file with new texts by position: the first run of a paragraph gets the text, its other runs are emptied."""
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(content)) as z, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as w:
        counts = {"para": 0, "cell_para": 0, "header": 0}

        def walk(node: ElementTree.Element, tag: str) -> None:
            for child in node:
                if child.tag == f"{W}p":
                    new = texts.get(f"{tag}.{counts[tag]}")
                    counts[tag] += 1
                    if new is not None:
                        for k, t in enumerate(child.iter(f"{W}t")):
                            t.text = new if k == 0 else ""
                elif child.tag == f"{W}tbl":
                    for cell in (c for r in child.findall(f"{W}tr") for c in r.findall(f"{W}tc")):
                        walk(cell, "cell_para")

        names = z.namelist()
        extra = sorted(n for n in names if re.fullmatch(r"word/(header|footer)\d*\.xml", n))
        for n in ["word/document.xml", *extra, *(x for x in names if x != "word/document.xml" and x not in extra)]:
            data = z.read(n)
            if n == "word/document.xml" or n in extra:
                root = ElementTree.fromstring(data)
                walk(root.find(f"{W}body") if n == "word/document.xml" else root, "para" if n == "word/document.xml" else "header")
                data = ElementTree.tostring(root, xml_declaration=True, encoding="UTF-8")
            w.writestr(n, data)
    return out.getvalue()


def markdown_docx(markdown: str) -> bytes:
    """A DOCX whose paragraphs are the blocks of a Markdown text; # and ## are headings."""
    paras = []
    for block in markdown.split("\n\n"):
        level = 2 if block.startswith("## ") else 1 if block.startswith("# ") else 0
        style = f'<w:pPr><w:pStyle w:val="Heading{level}"/></w:pPr>' if level else ""
        text = block[level + 1 :] if level else block
        for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
            text = text.replace(a, b)
        paras.append(f'<w:p>{style}<w:r><w:t xml:space="preserve">{text}</w:t></w:r></w:p>')
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", '<?xml version="1.0"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>')
        z.writestr("_rels/.rels", '<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>')
        z.writestr("word/document.xml", f'<?xml version="1.0"?><w:document xmlns:w="{W[1:-1]}"><w:body>{"".join(paras)}</w:body></w:document>')
    return out.getvalue()


OCR = "page int, parsing_res_list array<struct<block_bbox:array<array<int>>,block_label:string,block_content:string,block_id:int,block_order:int>>, overall_ocr_res struct<rec_scores:array<double>>"


def ocr_pages(spark: SparkSession, path: str) -> DataFrame:
    """Recognition results, a JSON object a line: either at the top or under `res` or `layout_parsing_result`."""
    raw = spark.read.text(path)
    inner = F.coalesce(F.get_json_object("value", "$.res"), F.get_json_object("value", "$.layout_parsing_result"), F.col("value"))
    return raw.select(F.from_json(inner, OCR).alias("r"), F.get_json_object("value", "$.page").cast("int").alias("p")).select(F.coalesce("r.page", "p").alias("page"), "r.parsing_res_list", "r.overall_ocr_res")


def thresholds(spark: SparkSession, config: str) -> DataFrame:
    """`{"vi->en": 1.8}` as (source_lang, target_lang, threshold)."""
    m = spark.range(1).select(F.explode(F.from_json(F.lit(config), "map<string,double>")).alias("k", "threshold"))
    return m.select(F.split_part("k", F.lit("->"), F.lit(1)).alias("source_lang"), F.split_part("k", F.lit("->"), F.lit(2)).alias("target_lang"), "threshold")


def load_stats(spark: SparkSession, path: str, threshold: float) -> DataFrame:
    """(p99, ok) of a load test's CSV: the row named Aggregated, else the last."""
    rows = spark.read.csv(path, header=True).withColumn("n", F.monotonically_increasing_id())
    best = rows.orderBy((F.col("Name") == "Aggregated").desc(), F.desc("n")).limit(1)
    return best.select(F.col("`99%`").cast("double").alias("p99")).withColumn("ok", F.col("p99") < threshold)
