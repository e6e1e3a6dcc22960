"""DOCX files as runs, formatted stretches of them as segments, and texts written back to the same runs.

Tasks read XML: `paragraphs_of` gives a row for each paragraph with its runs' texts and formats. Neighbours of one format
are merged where they are read, on arrays of many files' runs, without a shuffle (`segments_of`); for runs that come as
rows it is a window and a grouping (`grouped`). What is written where is a grouping or a join (`plan`); tasks then put the
texts into the files (`written`).

A paragraph's number counts every paragraph that the walk meets: the body's with the cells of its
tables in rows, nested tables in their place, and then for each section its own headers and footers
(default, even, first); one linked to the section before isn't met again. A cell that spans columns
or rows is met once for each of them. A paragraph without a run of its own, such as one that is a link, is a
segment of its whole text.

Defined cases: a run's format is bold, italic, underline, colour, font and size, each null if the
run doesn't say; blank stretches are no segments, but count; texts are in NFC; a file that can't be read gives
no rows and is listed by `unreadable`; an index beyond a paragraph's runs is passed over.
"""

from __future__ import annotations

import io
import re
import unicodedata
import zipfile
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from xml.etree import ElementTree

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.sources.ooxml import GIVEN, SAID, XML, Package, R, Short, batches_of, escaped, rarely_collected, unescaped, walked

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
FORMAT = ("bold", "italic", "underline", "color", "font", "size")
KINDS = (pa.bool_(), pa.bool_(), pa.string(), pa.string(), pa.string(), pa.string())
#: text: that of a paragraph without a run; the arrays are its runs'.
PARAGRAPHS = "path string, para int, tag string, text string, texts array<string>, bold array<boolean>, italic array<boolean>, underline array<string>, color array<string>, font array<string>, size array<string>"
#: Runs in a batch of files that are read.
AT_ONCE = 50_000
BAD = (zipfile.BadZipFile, ElementTree.ParseError, KeyError, AttributeError, ValueError)
OFF = ("0", "false", "off", "none")
#: Elements of a run that stand for a character.
CHARACTERS = {f"{W}tab": "\t", f"{W}ptab": "\t", f"{W}br": "\n", f"{W}cr": "\n", f"{W}noBreakHyphen": "-"}


WR, WT, WP, WBR, RPR = f"{W}r", f"{W}t", f"{W}p", f"{W}br", f"{W}rPr"
VAL, TYPE = f"{W}val", f"{W}type"
#: A format's place in FORMAT by its element, and the attribute that tells it.
PLACES = {f"{W}b": (0, VAL), f"{W}i": (1, VAL), f"{W}u": (2, VAL), f"{W}color": (3, VAL), f"{W}rFonts": (4, f"{W}ascii"), f"{W}sz": (5, VAL)}
NONE = (None,) * len(FORMAT)


def run_text(run: ElementTree.Element) -> str:
    out = ""
    for c in run:
        tag = c.tag
        if tag == WT:
            out += c.text or ""
        elif tag in CHARACTERS and (tag != WBR or c.get(TYPE, "textWrapping") == "textWrapping"):
            out += CHARACTERS[tag]
    return out


def paragraph_text(p: ElementTree.Element) -> str:
    """The text of a paragraph's runs and links."""
    return "".join(run_text(c) if c.tag == f"{W}r" else "".join(map(run_text, c.findall(f"{W}r"))) for c in p if c.tag in (f"{W}r", f"{W}hyperlink"))


def run_format(run: ElementTree.Element) -> tuple:
    props = run.find(RPR)
    if props is None:
        return NONE
    out: list = [None] * len(FORMAT)
    for c in props[::-1]:  # the first of a kind counts
        if (place := PLACES.get(c.tag)) is not None:
            i, name = place
            out[i] = c.get(name) not in OFF if i < 2 else c.get(name)
    return tuple(out)


def paragraphs(package: Package) -> Iterator[tuple[str, str, ElementTree.Element]]:
    """(part, tag, paragraph) in the order of the walk."""
    main = next(iter(part for kind, part in package.relations("").values() if kind == "officeDocument"), "word/document.xml")
    body = package.tree(main).find(f"{W}body")
    yield from ((main, tag, p) for tag, p in _blocks(body, "para"))
    parts = package.relations(main)
    for section in body.iter(f"{W}sectPr"):
        for kind in ("default", "even", "first"):
            for name in ("header", "footer"):
                for ref in section.findall(f"{W}{name}Reference"):
                    if ref.get(f"{W}type", "default") == kind and ref.get(f"{R}id") in parts:
                        part = parts[ref.get(f"{R}id")][1]
                        yield from ((part, "header", p) for p in package.tree(part).iter(f"{W}p"))


def _blocks(node: ElementTree.Element, tag: str) -> Iterator[tuple[str, ElementTree.Element]]:
    for child in node:
        if child.tag == f"{W}p":
            yield tag, child
        elif child.tag == f"{W}tbl":
            above: list[ElementTree.Element] = []
            for row in child.findall(f"{W}tr"):
                here: list[ElementTree.Element] = []
                for cell in row.findall(f"{W}tc"):
                    props = cell.find(f"{W}tcPr")
                    get = lambda name, props=props: None if props is None else props.find(f"{W}{name}")
                    span, merge = get("gridSpan"), get("vMerge")
                    width = 1 if span is None else int(span.get(f"{W}val", "1"))
                    if merge is not None and merge.get(f"{W}val", "continue") == "continue" and len(here) < len(above):
                        cell = above[len(here)]
                    here += [cell] * width
                for cell in here:
                    yield from _blocks(cell, "cell_para")
                above = here


def _files(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.filter(F.lower("path").endswith(".docx")).select("path", "content")


class Looks(dict):
    """A format -> its number."""

    def __missing__(self, look: tuple) -> int:
        self[look] = len(self)
        return self[look]


ATTRIBUTES, NAME = GIVEN.format("w:"), "w:[A-Za-z][A-Za-z0-9]*"
START, END = '<w:t xml:space="preserve">', "</w:t></w:r>"


@dataclass
class Stretch:
    """Plain runs that lie behind one another: their heads, and texts as they stand in the markup: with their attribute, or (null) with all their tags."""

    heads: list[str]
    tags: list[str | None]
    texts: list[str]

    def __str__(self) -> str:
        return "".join([f"{h}{x}</w:r>" if t is None else f"{h}<w:t{t}>{x}</w:t></w:r>" for h, t, x in zip(self.heads, self.tags, self.texts, strict=True)])


class Document(Short):
    #: A run that says one text or none, and whose properties are elements without content: its head, the text's attribute, the text.
    plain = re.compile(f'(<w:r{ATTRIBUTES}>(?:<w:rPr>(?:<{NAME}{ATTRIBUTES} ?/>)*</w:rPr>)?)(?:<w:t( xml:space="preserve")?>({SAID})</w:t>)?</w:r>')
    tag, prefix, space = "r", "w", W[1:-1]

    def stretch(self, heads: list[str], tags: list[str | None], texts: list[str | None]) -> Stretch:
        for h in set(heads):
            _look(h)  # fails where an attribute is given twice
        return Stretch(heads, [None if x is None else t or "" for t, x in zip(tags, texts, strict=True)], [x or "" for x in texts])

    def opened(self, node: ElementTree.Element) -> ElementTree.Element:
        """With its own runs in place of their stretches."""
        for i in range(len(node) - 1, -1, -1):
            if node[i].tag == WR and (found := self.marked.get(node[i])):
                node[i : i + 1] = list(ElementTree.fromstring(f'<w:p xmlns:w="{W[1:-1]}">{found}</w:p>'))
        return node


@lru_cache(4096)
def _look(head: str) -> tuple:
    return run_format(ElementTree.fromstring(head.replace("<w:r", f'<w:r xmlns:w="{W[1:-1]}"', 1) + "</w:r>"))


@dataclass
class Read:
    """Paragraphs of files, as lists: counts are of a file's paragraphs and of a paragraph's runs, texts and looks (numbers of formats) are the runs'."""

    paths: list[str] = field(default_factory=list)
    paras: list[int] = field(default_factory=list)
    tags: list[str] = field(default_factory=list)
    whole: list[str | None] = field(default_factory=list)
    runs: list[int] = field(default_factory=list)
    texts: list[str] = field(default_factory=list)
    looks: list[int] = field(default_factory=list)
    formats: Looks = field(default_factory=Looks)
    heads: dict[str, int] = field(default_factory=dict)

    def add(self, path: str, content: bytes) -> None:
        """Nothing of a file that can't be read."""
        try:
            document = Document(content)
            found = [(tag, p, p.findall(WR)) for _, tag, p in paragraphs(document)]
            texts, looks, runs, formats, heads = [], [], [], self.formats, self.heads
            for _, _, own in found:
                before = len(texts)
                for r in own:
                    if stretch := document.marked.get(r):
                        for h in set(stretch.heads) - heads.keys():
                            heads[h] = formats[_look(h)]
                        texts += map(unescaped, stretch.texts)
                        looks += [heads[h] for h in stretch.heads]
                    else:
                        texts.append(run_text(r))
                        looks.append(formats[run_format(r)])
                runs.append(len(texts) - before)
            whole = [None if own else paragraph_text(_links(document, p)) for _, p, own in found]
        except BAD:
            return
        self.paths.append(path)
        self.paras.append(len(found))
        self.tags += [tag for tag, _, _ in found]
        self.whole += whole
        self.runs += runs
        self.texts += texts
        self.looks += looks

    def places(self) -> tuple[pa.Array, np.ndarray]:
        """Each paragraph's path and number."""
        n = np.array(self.paras, np.int64)
        return pa.array(self.paths, pa.string()).take(pa.array(np.repeat(np.arange(len(n)), n))), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def _links(document: Document, p: ElementTree.Element) -> ElementTree.Element:
    for link in p.findall(f"{W}hyperlink"):
        document.opened(link)
    return p


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[Read]:
    with rarely_collected():
        found = Read()
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
                found.add(path.as_py(), content.as_py())
                if len(found.texts) + len(found.tags) >= AT_ONCE:
                    yield found
                    found = Read()
        yield found


def paragraphs_of(files: DataFrame) -> DataFrame:
    """A row for each paragraph of `files` (path, content) that can be read."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _read(batches):
            path, para = x.places()
            ends, looks = pa.array(np.append(0, np.cumsum(x.runs)), pa.int32()), pa.array(x.looks, pa.int32())
            listed = lambda c, ends=ends: pa.ListArray.from_arrays(ends, c)
            formats = [listed(pa.array(c, kind).take(looks)) for c, kind in zip(zip(*(list(x.formats) or [NONE]), strict=True), KINDS, strict=True)]
            cols = [path, pa.array(para, pa.int32()), pa.array(x.tags, pa.string()), pa.array(x.whole, pa.string()), listed(pa.array(x.texts, pa.string())), *formats]
            yield pa.RecordBatch.from_arrays(cols, names=["path", "para", "tag", "text", "texts", *FORMAT])

    return files.mapInArrow(read, PARAGRAPHS)


def runs_of(files: DataFrame) -> DataFrame:
    """A row for each run of `files` (path, content); run is null for a paragraph without one."""
    rows = paragraphs_of(files).select("path", "para", "tag", F.col("text").alias("whole"), F.posexplode_outer(F.arrays_zip("texts", *FORMAT)).alias("run", "r"))
    return rows.select("path", "para", "tag", "run", F.coalesce("r.texts", "whole").alias("text"), *[f"r.{c}" for c in FORMAT])


def runs(spark: SparkSession, path: str) -> DataFrame:
    return runs_of(_files(spark, path))


def unreadable(spark: SparkSession, path: str) -> DataFrame:
    """(path) of the DOCX files that can't be read."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bad = []
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                try:
                    walked(content.as_py(), paragraphs)
                except BAD:
                    bad.append(name)
            yield pa.RecordBatch.from_arrays([pa.array(bad, pa.string())], names=["path"])

    return _files(spark, path).mapInArrow(read, "path string")


def grouped(rows: DataFrame) -> DataFrame:
    """(path, seq, id, position, para, run_index, run_group_size, text): neighbouring runs of one format, merged."""
    order = Window.partitionBy("path", "para").orderBy("run")
    key = F.struct(*FORMAT)
    rows = rows.withColumn("new", F.when(F.lag(F.lit(1)).over(order).isNull() | ~F.lag(key).over(order).eqNullSafe(key), 1).otherwise(0))
    rows = rows.withColumn("island", F.sum("new").over(order))
    merged = rows.groupBy("path", "para", "island").agg(
        F.first("tag").alias("tag"), F.min("run").alias("run_index"), F.count(F.lit(1)).cast("int").alias("run_group_size"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("run", "text"))), lambda r: r["text"]), "").alias("text"),
    )
    merged = merged.withColumn("text", T.nfc(F.col("text"))).filter(T.strip(F.col("text")) != "")
    position = F.concat_ws(".", "tag", F.col("para").cast("string"), F.concat(F.lit("run"), F.col("run_index").cast("string")))
    merged = merged.withColumn("position", position).withColumn("id", T.segment_id(F.col("text"), F.col("position")))
    seq = F.row_number().over(Window.partitionBy("path").orderBy("para", F.col("run_index").asc_nulls_first())) - 1
    return merged.withColumn("seq", seq).select("path", "seq", "id", "position", "para", "run_index", "run_group_size", "text")


def segments_of(files: DataFrame) -> DataFrame:
    """What `grouped` gives for the runs of `files` (path, content)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _read(batches):
            yield _stretches(x)

    found = files.mapInArrow(read, "path string, seq int, para int, tag string, run_index int, run_group_size int, text string")
    position = F.concat_ws(".", "tag", F.col("para").cast("string"), F.concat(F.lit("run"), F.col("run_index").cast("string")))
    found = found.withColumn("position", position).withColumn("id", T.segment_id(F.col("text"), F.col("position")))
    return found.select("path", "seq", "id", "position", "para", "run_index", "run_group_size", "text")


def _stretches(x: Read) -> pa.RecordBatch:
    """Runs lie behind one another, so a stretch's text is that from its first run's start to the next stretch's."""
    path, para = x.places()
    count = np.array(x.runs, np.int64)
    blank = count == 0  # a paragraph without a run is a stretch of its whole text
    first = np.cumsum(np.maximum(count, 1)) - np.maximum(count, 1)
    texts, looks = np.empty(len(x.texts) + blank.sum(), object), np.zeros(len(x.texts) + blank.sum(), np.int64)
    own = np.ones(len(texts), bool)
    own[first[blank]] = False
    texts[own], looks[own], texts[~own] = x.texts, x.looks, [w for w in x.whole if w is not None]
    text = pa.array(texts, pa.string())
    new = np.append(True, looks[1:] != looks[:-1])[: len(texts)]
    new[first] = True
    at = np.flatnonzero(new)
    ends = np.append(at, len(texts))
    _, offsets, data = text.buffers()
    offsets = np.frombuffer(offsets, np.int32, len(texts) + 1)[ends] if len(texts) else np.zeros(1, np.int32)
    text = pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets), data)
    # composing letters makes no text blank and no blank one a text
    said = pc.not_equal(pc.utf8_trim_whitespace(text), "")
    keep = np.flatnonzero(said.to_numpy(zero_copy_only=False))
    of = (np.searchsorted(first, at, "right") - 1)[keep]
    index = pa.array(at[keep] - first[of], pa.int32(), mask=blank[of])
    file = np.repeat(np.arange(len(x.paras)), x.paras)[of]
    seq = np.arange(len(of)) - np.searchsorted(file, file, "left")
    rows = pa.array(of)
    cols = [path.take(rows), pa.array(seq, pa.int32()), pa.array(para[of], pa.int32()), pa.array(x.tags, pa.string()).take(rows), index, pa.array(np.diff(ends)[keep], pa.int32()), T.composed(text.take(pa.array(keep)))]
    return pa.RecordBatch.from_arrays(cols, names=["path", "seq", "para", "tag", "run_index", "run_group_size", "text"])


def plan(segments: DataFrame, translated: DataFrame | None = None) -> DataFrame:
    """(path, writes): for each file the texts and the runs that get them. translated: (path, id, new_text), or segments have new_text; a null text leaves the runs."""
    found = segments if translated is None else segments.join(translated, ["path", "id"])
    found = found.filter("new_text IS NOT NULL").select("path", F.struct("para", "run_index", "run_group_size", "new_text").alias("w"))
    return found.groupBy("path").agg(F.collect_list("w").alias("writes"))


def written_to(files: DataFrame, writes: DataFrame) -> DataFrame:
    """(path, content) of `files` after their writes; a file without one stays as it is."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def files() -> Iterator[tuple[str, bytes]]:
            for batch in batches:
                for path, content, writes in zip(*(batch.column(c) for c in ("path", "content", "writes")), strict=True):
                    rows = writes.values
                    yield path.as_py(), with_rows(content.as_py(), [] if rows is None else zip(*(rows.field(c).to_pylist() for c in WRITE), strict=True))

        with rarely_collected():
            yield from batches_of(files())

    return files.join(writes, "path", "left").select("path", "content", "writes").mapInArrow(write, "path string, content binary")


def written(spark: SparkSession, path: str, writes: DataFrame) -> DataFrame:
    return written_to(_files(spark, path), writes)


def with_runs(content: bytes, writes: list[dict]) -> bytes:
    return with_rows(content, [tuple(w[c] for c in WRITE) for w in writes])


def with_rows(content: bytes, writes: Iterable[tuple[int, int | None, int, str]]) -> bytes:
    """The file with each text in the first run of its stretch and the stretch's other runs blank; all runs and their formats stay. Writes are as in WRITE."""
    by_para: dict[int, list[tuple]] = {}
    for para, *w in writes:
        by_para.setdefault(para, []).append(w)
    if not by_para:
        return content
    package, changed = Document(content), set()
    for n, (part, _, p) in enumerate(paragraphs(package)):
        if n not in by_para:
            continue
        own: list[tuple] = []  # (a run), or (its stretch, its place there)
        for r in p.findall(WR):
            found = package.marked.get(r)
            own += [(r,)] if found is None else [(found, i) for i in range(len(found.heads))]
        changed.add(part)
        for index, size, text in by_para[n]:
            if index is None:
                _put(own[0] if own else (ElementTree.SubElement(p, WR),), text)
                blank = own[1:]
            elif index < len(own):
                _put(own[index], text)
                blank = own[index + 1 : index + size]
            else:
                continue
            for r in blank:
                if len(r) == 2:
                    r[0].tags[r[1]], r[0].texts[r[1]] = None, ""
                else:
                    _put(r, "")
    return package.saved(changed)


WRITE = ("para", "run_index", "run_group_size", "new_text")
BREAKS = re.compile("([\t\n])")
SPACE = f"{{{XML}}}space"
CHARACTER_TAGS = {"\t": f"{W}tab", "\n": WBR}
BREAK_TAGS = {"\t": "<w:tab/>", "\n": "<w:br/>"}


def _put(run: tuple[ElementTree.Element] | tuple[Stretch, int], text: str) -> None:
    """Replaces what a run says, not how it looks."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text)
    parts = BREAKS.split(text) if "\t" in text or "\n" in text else [text]
    if len(run) == 2:
        stretch, i = run
        stretch.tags[i], stretch.texts[i] = None, "".join([BREAK_TAGS[x] if x in BREAK_TAGS else f"{START if x.strip() != x else '<w:t>'}{escaped(x)}</w:t>" for x in parts if x])
        return
    run = run[0]
    looks = run.findall(RPR)
    if len(looks) < len(run):
        run[:] = looks
    for part in parts:
        if part in CHARACTER_TAGS:
            ElementTree.SubElement(run, CHARACTER_TAGS[part])
        elif part:
            t = ElementTree.SubElement(run, WT)
            t.text = part
            if part.strip() != part:
                t.set(SPACE, "preserve")


def made(rows: DataFrame, bold: Callable[[pa.StringArray], pa.BooleanArray]) -> DataFrame:
    """(path, content): DOCX files from (path, text): a paragraph for each line, a run for each word with the space after it; bold: which of many words are (null: the format says nothing)."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def files() -> Iterator[tuple[str, bytes]]:
            for batch in batches:
                size = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False)) >> 20
                cuts = [0, *(np.flatnonzero(np.diff(size)) + 1), len(size)]
                for at, end in zip(cuts[:-1], cuts[1:], strict=True):  # about a megabyte of text
                    part = batch.slice(at, end - at)
                    yield from zip(part.column("path").to_pylist(), _documents(part.column("text"), bold), strict=True)

        yield from batches_of(files())

    return rows.select("path", "text").mapInArrow(make, "path string, content binary")


STARTS = pa.array([f"{p}{r}" for p in ("", "<w:p>") for r in (f"<w:r>{START}", f"<w:r><w:rPr><w:b/></w:rPr>{START}", f'<w:r><w:rPr><w:b w:val="0"/></w:rPr>{START}')])
ENDS = pa.array([f" {END}", f" {END}</w:p>"])
MARKUP = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("\t", f"</w:t><w:tab/>{START}"))


def _documents(texts: pa.StringArray, bold: Callable[[pa.StringArray], pa.BooleanArray]) -> Iterator[bytes]:
    """Written as text for all files at once: a file's markup is a stretch of the words' with their tags."""
    if not len(texts):
        return
    lines = pc.split_pattern(texts, "\n")
    by_line = pc.split_pattern(lines.flatten(), " ")
    words, ends, of_file = by_line.flatten(), by_line.offsets.to_numpy(), lines.offsets.to_numpy()
    look = pc.if_else(pc.fill_null(bold(words), False), 1, pc.if_else(pc.is_null(bold(words)), 0, 2)).to_numpy()
    start, end = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
    start[ends[:-1]], end[ends[1:] - 1] = 3, 1
    for a, b in MARKUP:
        words = pc.replace_substring(words, a, b)
    runs = pc.binary_join_element_wise(STARTS.take(pa.array(start + look)), words, ENDS.take(pa.array(end)), "")
    at, data = np.frombuffer(runs.buffers()[1], np.int32, len(runs) + 1)[ends[of_file]], runs.buffers()[2]
    for a, b in zip(at[:-1], at[1:], strict=True):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED, compresslevel=1) as z:
            z.writestr("word/document.xml", b"".join((f'<w:document xmlns:w="{W[1:-1]}"><w:body>'.encode(), data[a:b], b"</w:body></w:document>")))
        yield out.getvalue()
