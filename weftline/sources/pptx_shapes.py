"""PPTX files as text positions in their shape trees, and texts written back to the same paragraphs.

The order is the presentation's: its masters, then each slide's shapes and its notes; parts are
found by relations, not by their names. A position is a path:

    master.M.shape.S.para.K                       a master's own shapes
    slide.N.shape.S[.group.shape.S]*.tf.0.para.K  text, in groups of any depth
    slide.N.shape.S.table.row.R.col.C.para.K      a table's cells, by rows
    slide.N.shape.S.smartart                      the texts inside a diagram's frame, read only
    slide.N.notes.para.K                          the body of the notes

Tasks read and write XML; which text goes where is a join on (path, position) (`placed`).

Defined cases: texts are stripped and in NFC, blank ones are left out; a line break is a vertical tab; a
position that a file lacks is passed over; a file that can't be read gives no rows.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from xml.etree import ElementTree

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.sources.docx_runs import BAD
from weftline.sources.ooxml import GIVEN, SAID, R, Short, archive, batches_of, escaped, rarely_collected, unescaped

A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
DIAGRAM = "http://schemas.openxmlformats.org/drawingml/2006/diagram"
MAIN = "ppt/presentation.xml"
SHAPES = {P + n for n in ("sp", "grpSp", "graphicFrame", "cxnSp", "pic", "contentPart")}
Place = tuple[str, str, "ElementTree.Element | str | Cell"]


AP, AT, AR, ABR = f"{A}p", f"{A}t", f"{A}r", f"{A}br"
SHAPE, GROUP, TEXT_BODY = f"{P}sp", f"{P}grpSp", f"{P}txBody"
WORDS = (AR, f"{A}fld")
#: Rows in a batch of texts that are read.
AT_ONCE = 20_000


def paragraph_text(p: ElementTree.Element) -> str:
    out = ""
    for c in p:
        if c.tag in WORDS:
            out += c.findtext(AT) or ""
        elif c.tag == ABR:
            out += "\v"
    return out


@dataclass
class Cells:
    """Plain cells that lie behind one another: their markup before, in (the text) and after."""

    heads: list[str]
    texts: list[str]
    ends: list[str]

    def __str__(self) -> str:
        return "".join([x for cell in zip(self.heads, self.texts, self.ends, strict=True) for x in cell])


Cell = tuple[Cells, int]
#: An element that stands alone and says nothing.
ALONE = f"(?:<a:(?!(?:br|r|fld|p|t|txBody|tc)[ /])[A-Za-z][A-Za-z0-9]*{GIVEN.format('')} ?/>)*"


class Deck(Short):
    #: A table's cell of one paragraph of one run.
    plain = re.compile(f"(<a:tc{GIVEN.format('')}><a:txBody>{ALONE}<a:p>{ALONE}<a:r>{ALONE}<a:t>)({SAID})(</a:t></a:r>{ALONE}</a:p></a:txBody>{ALONE}</a:tc>)")
    tag, prefix, space, without = "tc", "a", A[1:-1], (DIAGRAM,)

    def stretch(self, heads: list[str], texts: list[str], ends: list[str]) -> Cells:
        for head, end in set(zip(heads, ends, strict=True)):
            _checked(head, end)
        return Cells(heads, texts, ends)


@lru_cache(4096)
def _checked(head: str, end: str) -> None:
    """Fails where an attribute is given twice."""
    ElementTree.fromstring(head.replace("<a:tc", f'<a:tc xmlns:a="{A[1:-1]}"', 1) + end)


def _body(put: Callable[[Place], None], part: str, owner: ElementTree.Element, position: str, name: str = TEXT_BODY) -> None:
    k = 0
    for body in owner.findall(name):
        for p in body.findall(AP):
            put((part, f"{position}.para.{k}", p))
            k += 1


def _shapes(put: Callable[[Place], None], marked: dict, part: str, tree: ElementTree.Element, prefix: str) -> None:
    s = -1
    for shape in tree:
        tag = shape.tag
        if tag not in SHAPES:
            continue
        s += 1
        position = f"{prefix}.shape.{s}"
        if tag == GROUP:
            _shapes(put, marked, part, shape, f"{position}.group")
        elif any(d.get("uri") == DIAGRAM for d in shape.iter(f"{A}graphicData")):
            put((part, f"{position}.smartart", " ".join(t.text for t in shape.iter(AT) if t.text and t.text.strip())))
        elif tag == f"{P}graphicFrame":
            for table in shape.findall(f"{A}graphic/{A}graphicData/{A}tbl"):
                for r, row in enumerate(table.findall(f"{A}tr")):
                    c, here = 0, f"{position}.table.row.{r}.col."
                    for cell in row.findall(f"{A}tc"):
                        if cells := marked.get(cell):
                            for i in range(len(cells.texts)):
                                put((part, f"{here}{c + i}.para.0", (cells, i)))
                            c += len(cells.texts)
                        else:
                            _body(put, part, cell, f"{here}{c}", f"{A}txBody")
                            c += 1
        elif tag == SHAPE:
            _body(put, part, shape, f"{position}.tf.0")


def places(package: Deck) -> list[Place]:
    """(part, position, paragraph, or a plain cell, or the text of a diagram) in the presentation's order."""
    found: list[Place] = []
    put = found.append
    main = next((part for kind, part in package.relations("").values() if kind == "officeDocument"), MAIN)
    parts = package.relations(main)
    listed = lambda tag: [parts[x.get(f"{R}id")][1] for x in package.tree(main).iter(f"{P}{tag}") if x.get(f"{R}id") in parts]
    for m, part in enumerate(listed("sldMasterId")):
        for s, shape in enumerate(x for x in package.tree(part).find(f"{P}cSld/{P}spTree") if x.tag in SHAPES):
            if shape.tag == SHAPE:
                _body(put, part, shape, f"master.{m}.shape.{s}")
    for n, part in enumerate(listed("sldId")):
        _shapes(put, package.marked, part, package.tree(part).find(f"{P}cSld/{P}spTree"), f"slide.{n}")
        for kind, notes in package.relations(part).values():
            if kind == "notesSlide":
                bodies = [x for x in package.tree(notes).iter(SHAPE) if (ph := x.find(f"{P}nvSpPr/{P}nvPr/{P}ph")) is not None and ph.get("type") == "body"]
                for shape in bodies[:1]:
                    _body(put, notes, shape, f"slide.{n}.notes")
    return found


def texts(content: bytes) -> Iterator[tuple[str, str]]:
    """(position, text) of what isn't blank."""
    for _, position, p in places(Deck(content)):
        if isinstance(p, tuple):
            text = unescaped(p[0].texts[p[1]]).strip()
        else:
            text = (p if isinstance(p, str) else paragraph_text(p)).strip()
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
        if text:
            yield position, text


def with_texts(content: bytes, new: dict[str, str]) -> bytes:
    """The file with new texts by position: a paragraph's first run gets the text, its other runs are emptied and keep their format. Diagrams stay, and parts where nothing is new."""

    def put(position: str, p: ElementTree.Element | str | Cell) -> bool:
        if position not in new or isinstance(p, str):
            return False
        text = new[position] if new[position].isascii() else unicodedata.normalize("NFC", new[position])
        if isinstance(p, tuple):
            cells, i = p
            before, cells.texts[i] = cells.texts[i], escaped(text)
            return cells.texts[i] != before
        own, changed = p.findall(AR), False
        if not own:
            own = [ElementTree.Element(f"{A}r")]
            ends = [i for i, c in enumerate(p) if c.tag == f"{A}endParaRPr"]
            p.insert(ends[0] if ends else len(p), own[0])
        for i, r in enumerate(own):
            t = r.find(AT)
            t = ElementTree.SubElement(r, AT) if t is None else t
            said = text if i == 0 else ""
            if (t.text or "") != said:
                t.text, changed = said, True
        return changed

    package = Deck(content)
    return package.saved({part for part, position, p in places(package) if put(position, p)})


def positions_of(files: DataFrame) -> DataFrame:
    """(path, seq, id, position, text) of files (path, content)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(paths: list, counts: list, found: list) -> pa.RecordBatch:
            n = np.array(counts, np.int64)
            seq = np.arange(len(found)) - np.repeat(np.cumsum(n) - n, n)
            position, text = zip(*found, strict=True) if found else ([], [])
            cols = [pa.array(paths, pa.string()).take(pa.array(np.repeat(np.arange(len(n)), n))), pa.array(seq, pa.int32()), pa.array(position, pa.string()), pa.array(text, pa.string())]
            return pa.RecordBatch.from_arrays(cols, names=["path", "seq", "position", "text"])

        paths, counts, found = [], [], []
        with rarely_collected():
            for batch in batches:
                for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
                    try:
                        rows = list(texts(content.as_py()))
                    except BAD:
                        continue
                    paths.append(path.as_py())
                    counts.append(len(rows))
                    found += rows
                    if len(found) >= AT_ONCE:
                        yield out(paths, counts, found)
                        paths, counts, found = [], [], []
            yield out(paths, counts, found)

    rows = files.mapInArrow(read, "path string, seq int, position string, text string")
    return rows.withColumn("id", T.segment_id(F.col("text"), F.col("position"))).select("path", "seq", "id", "position", "text")


def _files(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.filter(F.lower("path").endswith(".pptx")).select("path", "content")


def positions(spark: SparkSession, path: str) -> DataFrame:
    return positions_of(_files(spark, path))


def placed(segments: DataFrame, translated: DataFrame | None = None) -> DataFrame:
    """(path, writes): each segment's new text at its position; without one, its own text. translated: (path, id, new_text), or segments have new_text."""
    found = (segments if translated is None else segments.join(translated, ["path", "id"], "left")).filter(~F.col("position").endswith(".smartart"))
    return found.groupBy("path").agg(F.collect_list(F.struct("position", F.coalesce("new_text", "text").alias("text"))).alias("writes"))


def written_to(files: DataFrame, writes: DataFrame) -> DataFrame:
    """(path, content) of `files` after their writes."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def files() -> Iterator[tuple[str, bytes]]:
            for batch in batches:
                for path, content, writes in zip(*(batch.column(c) for c in ("path", "content", "writes")), strict=True):
                    w = writes.values
                    yield path.as_py(), with_texts(content.as_py(), {} if w is None else dict(zip(w.field("position").to_pylist(), w.field("text").to_pylist(), strict=True)))

        with rarely_collected():
            yield from batches_of(files())

    return files.join(writes, "path", "left").select("path", "content", "writes").mapInArrow(write, "path string, content binary")


def written(spark: SparkSession, path: str, writes: DataFrame) -> DataFrame:
    return written_to(_files(spark, path), writes)


def package(slides: list[str], masters: list[str] = (), notes: dict[int, str] | None = None) -> bytes:
    """A PPTX file of shape trees' inner XML. Slide n is the part numbered from the end, so that names don't tell the order."""
    notes = notes or {}
    tree = lambda kind, inner: f"<p:{kind} {SPACES}><p:cSld><p:spTree>{inner}</p:spTree></p:cSld></p:{kind}>"
    last, out = len(slides), []
    put = lambda name, text: out.append((name, text.encode(), None))
    put("_rels/.rels", _relationships([("rId1", "officeDocument", MAIN)]))
    ids = "".join(f'<p:sldMasterId r:id="m{i}"/>' for i in range(len(masters))), "".join(f'<p:sldId r:id="s{i}"/>' for i in range(last))
    put(MAIN, f"<p:presentation {SPACES}><p:sldMasterIdLst>{ids[0]}</p:sldMasterIdLst><p:sldIdLst>{ids[1]}</p:sldIdLst></p:presentation>")
    put("ppt/_rels/presentation.xml.rels", _relationships([(f"m{i}", "slideMaster", f"slideMasters/slideMaster{i}.xml") for i in range(len(masters))] + [(f"s{i}", "slide", f"slides/slide{last - i}.xml") for i in range(last)]))
    for i, m in enumerate(masters):
        put(f"ppt/slideMasters/slideMaster{i}.xml", tree("sldMaster", m))
    for i, s in enumerate(slides):
        put(f"ppt/slides/slide{last - i}.xml", tree("sld", s))
        if i in notes:
            put(f"ppt/slides/_rels/slide{last - i}.xml.rels", _relationships([("n", "notesSlide", f"../notesSlides/notesSlide{i}.xml")]))
            put(f"ppt/notesSlides/notesSlide{i}.xml", tree("notes", notes[i]))
    return archive(out, 1)


SPACES = f'xmlns:a="{A[1:-1]}" xmlns:p="{P[1:-1]}" xmlns:r="{R[1:-1]}"'


def _relationships(rows: list[tuple[str, str, str]]) -> str:
    found = "".join([f'<Relationship Id="{i}" Type="{R[1:-1]}/{k}" Target="{t}"/>' for i, k, t in rows])
    return f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{found}</Relationships>'


def made(rows: DataFrame) -> DataFrame:
    """(path, content): PPTX files from (path, text), a slide for each line: its first word in a shape, its second in a group, the others in a table's cells, and a note with its number."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def files() -> Iterator[tuple[str, bytes]]:
            for batch in batches:
                for path, text in zip(batch.column("path"), batch.column("text"), strict=True):
                    lines = escaped(text.as_py()).split("\n")
                    yield path.as_py(), package([_slide(line.split(" ")) for line in lines], notes={n: f"{NOTE}note {n}{SHAPE_END}" for n in range(len(lines))})

        yield from batches_of(files())

    return rows.select("path", "text").mapInArrow(make, "path string, content binary")


SHAPE_START, SHAPE_END = "<p:sp><p:txBody><a:p><a:r><a:t>", "</a:t></a:r></a:p></p:txBody></p:sp>"
CELL_START, CELL_END = "<a:tc><a:txBody><a:p><a:r><a:t>", "</a:t></a:r></a:p></a:txBody></a:tc>"
NOTE = '<p:sp><p:nvSpPr><p:nvPr><p:ph type="body"/></p:nvPr></p:nvSpPr><p:txBody><a:p><a:r><a:t>'


def _slide(words: list[str]) -> str:
    out = f"{SHAPE_START}{words[0]}{SHAPE_END}"
    if len(words) > 1:
        out += f"<p:grpSp>{SHAPE_START}{words[1]}{SHAPE_END}</p:grpSp>"
    if len(words) > 2:
        out += f"<p:graphicFrame><a:graphic><a:graphicData><a:tbl><a:tr>{CELL_START}{f'{CELL_END}{CELL_START}'.join(words[2:])}{CELL_END}</a:tr></a:tbl></a:graphicData></a:graphic></p:graphicFrame>"
    return out
