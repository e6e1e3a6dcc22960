"""Parts, relations and XML of office files, from the standard library."""

from __future__ import annotations

import contextlib
import gc
import io
import posixpath
import re
import struct
import zipfile
import zlib
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from typing import NamedTuple
from xml.etree import ElementTree
from xml.parsers import expat

import pyarrow as pa

R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
XML = "http://www.w3.org/XML/1998/namespace"
RELATIONS = "{http://schemas.openxmlformats.org/package/2006/relationships}Relationship"
MARK = "stretch-of-plain"
#: In markup: attributes of plain names (with a prefix or without), and text that needs no parser but for the five named entities.
GIVEN = '(?: {}[A-Za-z][A-Za-z0-9]*="[^"<>&\\x00-\\x1f\\ufffe\\uffff]*")*'
SAID = "[^<>&\\x00-\\x08\\x0b-\\x1f\\ufffe\\uffff]*+"
SAID = f"{SAID}(?:&(?:amp|lt|gt|quot|apos);{SAID})*"
#: Bytes of files in a batch that a task gives back.
BYTES_AT_ONCE = 4 << 20


@contextlib.contextmanager
def rarely_collected() -> Iterator[None]:
    """With few runs of the collector of cycles, which walks all elements again and again while trees grow; trees have no cycles."""
    usual = gc.get_threshold()
    gc.set_threshold(500_000, *usual[1:])
    try:
        yield
    finally:
        gc.set_threshold(*usual)


def batches_of(files: Iterator[tuple[str, bytes | None]]) -> Iterator[pa.RecordBatch]:
    """(path, content) in batches of a few megabytes, or a file."""
    paths, contents, size = [], [], 0
    batch = lambda: pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(contents, pa.binary())], names=["path", "content"])
    for path, content in files:
        paths.append(path)
        contents.append(content)
        size += len(content or b"")
        if size >= BYTES_AT_ONCE:
            yield batch()
            paths, contents, size = [], [], 0
    if paths:
        yield batch()


class Part(NamedTuple):
    """As it lies in an archive."""

    method: int
    crc: int
    size: int
    raw: bytes


def part_of(content: bytes, z: zipfile.ZipFile, info: zipfile.ZipInfo) -> tuple[bytes, Part | None]:
    """A part's bytes, and a plain one as it lies there, which is read without the stream that `read` opens for it."""
    at, method = info.header_offset, info.compress_type
    name, extra = (int.from_bytes(content[at + i : at + i + 2], "little") for i in (26, 28))
    known = info.orig_filename.encode("utf-8" if info.flag_bits & 0x800 else "cp437")
    if info.flag_bits & 0x61 or method not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED) or content[at : at + 4] != b"PK\3\4" or content[at + 30 : at + 30 + name] != known:
        return z.read(info), None
    at += 30 + name + extra
    data = raw = content[at : at + info.compress_size]
    if method == zipfile.ZIP_DEFLATED:
        try:
            data = zlib.decompress(raw, -15)
        except zlib.error as e:
            raise zipfile.BadZipFile(f"{info.filename}: {e}") from e
    if len(data) != info.file_size or zlib.crc32(data) != info.CRC:
        raise zipfile.BadZipFile(f"Bad CRC-32 for file {info.filename!r}")
    return data, Part(method, info.CRC, len(data), raw)


def deflated(data: bytes, level: int) -> bytes:
    """With tables of the data's size: for small parts those of the usual size take ten times as long as the work."""
    small = len(data) < 1 << 14
    made = zlib.compressobj(level, zlib.DEFLATED, -max(9, len(data).bit_length()) if small else -15, 5 if small else 8)
    return made.compress(data) + made.flush()


def archive(parts: Iterable[tuple[str, bytes, Part | None]], level: int = 6) -> bytes:
    """A ZIP file of (name, bytes, part as it lies in another archive): thousands of small parts take zipfile several times as long."""
    parts = [(name, data, part or Part(zipfile.ZIP_DEFLATED, zlib.crc32(data), len(data), deflated(data, level))) for name, data, part in parts]
    if len(parts) > 0xFFFE or sum(len(p.raw) + 2 * len(name) + 100 for name, _, p in parts) > 0x7FFFFFFF or any(p.size > 0x7FFFFFFF for _, _, p in parts):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for name, data, _ in parts:
                z.writestr(name, data)
        return out.getvalue()
    local, central, at = [], [], 0
    for name, _, (method, crc, size, raw) in parts:
        file = name.encode()
        fields = struct.pack("<HHHHHIIIHH", 20, 0x800, method, 0, 0x21, crc, len(raw), size, len(file), 0)
        local += [b"PK\3\4", fields, file, raw]
        central += [b"PK\1\2\x14\3", fields, struct.pack("<HHHII", 0, 0, 0, 0o600 << 16, at), file]
        at += 30 + len(file) + len(raw)
    size = sum(map(len, central))
    return b"".join([*local, *central, struct.pack("<4sHHHHIIH", b"PK\5\6", 0, 0, len(parts), len(parts), size, at, 0)])


class Package:
    """An office file's parts by name. Changed parts are written by `saved`, all others as they were."""

    def __init__(self, content: bytes):
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            found = {i.filename: part_of(content, z, i) for i in z.infolist()}
        self.parts = {n: data for n, (data, _) in found.items()}
        self.lying = {n: part for n, (_, part) in found.items()}
        self.trees: dict[str, ElementTree.Element] = {}
        self.tags: dict[tuple, Tags] = {}

    def tree(self, name: str) -> ElementTree.Element:
        """A part's root, the same each time."""
        if name not in self.trees:
            self.trees[name] = ElementTree.fromstring(self.parts[name])
        return self.trees[name]

    def relations(self, name: str) -> dict[str, tuple[str, str]]:
        """Relation id -> (kind, part) of what a part refers to inside the file, in the file's order."""
        folder, base = posixpath.split(name)
        rels = f"{folder}/_rels/{base}.rels".lstrip("/")
        if rels not in self.parts:
            return {}
        return _relations(folder, self.parts[rels])

    def saved(self, changed: set[str]) -> bytes:
        return archive((name, self._serialized(name), None) if name in changed else (name, data, self.lying[name]) for name, data in self.parts.items())

    def _serialized(self, name: str) -> bytes:
        """The part with its own prefixes; those that only attribute values name stay declared."""
        spaces = {XML: "xml"}
        for uri, prefix in declared(self.parts[name]).items():
            if prefix and not prefix.startswith(("ns", "xml")):
                spaces.setdefault(uri, prefix)
        key = tuple(spaces.items())
        if key not in self.tags:
            self.tags[key] = Tags(spaces)
        return serialized(self.trees[name], self.tags[key])


@lru_cache(4096)
def _relations(folder: str, part: bytes) -> dict[str, tuple[str, str]]:
    """Slides of many files have the same."""
    found = [r for r in ElementTree.fromstring(part).iter(RELATIONS) if r.get("TargetMode") != "External"]
    return {r.get("Id"): (r.get("Type", "").rpartition("/")[2], posixpath.normpath(posixpath.join("/" + folder, r.get("Target"))).lstrip("/")) for r in found}


class Short(Package):
    """A file whose trees have one marked element for each stretch of plain ones that lie behind one another, which take most of the time.

    A subclass says what is plain: `plain` finds it in the markup, `tag` is the marked element's name, `prefix` and `space` are those of all names in it,
    and `stretch` makes something of what its groups found, whose str() is the markup again."""

    plain: re.Pattern
    tag: str
    prefix: str
    space: str
    #: A part with one of these is read as it is.
    without: tuple[str, ...] = ()

    def __init__(self, content: bytes):
        super().__init__(content)
        self.stretches: list = []
        self.marked: dict[ElementTree.Element, object] = {}

    def stretch(self, *groups: list):
        raise NotImplementedError

    def tree(self, name: str) -> ElementTree.Element:
        if name not in self.trees:
            before, part = len(self.stretches), self._short(self.parts[name])
            self.trees[name] = ElementTree.fromstring(part)
            if len(self.stretches) > before:
                self.marked |= {e: self.stretches[int(e.get(MARK))] for e in self.trees[name].iter(f"{{{self.space}}}{self.tag}") if MARK in e.attrib}
        return self.trees[name]

    def _short(self, part: bytes) -> bytes | str:
        """The part with its stretches marked, if the prefix is what it usually is, throughout, and nothing can hide one."""
        if f"<{self.prefix}:{self.tag}".encode() not in part:
            return part
        start = part.find(b"?>") + 2 if part.startswith(b"<?xml") else 0
        prolog, root = part[:start].lower(), part[start : part.find(b">", start)]
        if b"encoding" in prolog and b"utf-8" not in prolog or b"<!" in part or part.find(b"<?", 1) >= 0 or any(x.encode() in part for x in (MARK, *self.without)):
            return part
        named = f"xmlns:{self.prefix}="
        if part.count(self.space.encode()) != 1 or part.count(named.encode()) != 1 or f'{named}"{self.space}"'.encode() not in root:
            return part
        found = self.plain.split(part[start:].decode())
        between, *groups = (found[i :: self.plain.groups + 1] for i in range(self.plain.groups + 1))
        ends = [i for i, x in enumerate(between) if x]
        if ends[0] or ends[-1] != len(groups[0]):
            return part
        out = [between[0]]
        for a, b in zip(ends[:-1], ends[1:], strict=True):
            out.append(f'<{self.prefix}:{self.tag} {MARK}="{len(self.stretches)}"/>{between[b]}')
            self.stretches.append(self.stretch(*(g[a:b] for g in groups)))
        return "".join(out)

    def _serialized(self, name: str) -> bytes:
        out = super()._serialized(name)
        if MARK.encode() in self.parts[name]:
            return out
        return re.sub(f'<{self.prefix}:{self.tag} {MARK}="([0-9]+)" />', lambda m: str(self.stretches[int(m[1])]), out.decode()).encode()


def declared(part: bytes) -> dict[str, str]:
    """Namespace -> the prefix that it is declared with first."""
    spaces: dict[str, str] = {}
    parser = expat.ParserCreate(namespace_separator="}")
    parser.StartNamespaceDeclHandler = lambda prefix, uri: spaces.setdefault(uri or "", prefix or "")
    last = part.rfind(b"xmlns")
    end = part.find(b"<", last) if last >= 0 else -1  # no tag after this one declares any
    parser.Parse(part if end < 0 else part[:end], end < 0)
    return spaces


def escaped(text: str) -> str:
    if "&" in text:
        text = text.replace("&", "&amp;")
    if "<" in text:
        text = text.replace("<", "&lt;")
    return text.replace(">", "&gt;") if ">" in text else text


def unescaped(text: str) -> str:
    return text.replace("&lt;", "<").replace("&gt;", ">").replace("&quot;", '"').replace("&apos;", "'").replace("&amp;", "&") if "&" in text else text


def attribute(text: str) -> str:
    return escaped(text).replace('"', "&quot;").replace("\r", "&#13;").replace("\n", "&#10;").replace("\t", "&#09;")


class Tags(dict):
    """A name in braces -> its name with a prefix, and its tags: opening, closing, empty. `spaces` gets a prefix for each namespace that has none."""

    def __init__(self, spaces: dict[str, str]):
        self.spaces = spaces
        self.attributes: dict[tuple, str] = {}

    def __missing__(self, name: str) -> tuple[str, str, str, str]:
        uri, _, local = name.rpartition("}")
        if uri and uri[1:] not in self.spaces:
            self.spaces[uri[1:]] = next(p for p in (f"ns{i}" for i in range(len(self.spaces) + 1)) if p not in self.spaces.values())
        full = f"{self.spaces[uri[1:]]}:{local}" if uri else local
        self[name] = full, f"<{full}>", f"</{full}>", f"<{full} />"
        return self[name]


def serialized(root: ElementTree.Element, tags: Tags) -> bytes:
    """What ElementTree.tostring writes, in a fraction of its time; all of the tags' spaces (namespace -> prefix) are declared at the root."""
    out, spaces = [], tags.spaces
    _put_element(root, tags, tags.attributes, out.append)
    place = 1 + len(tags[root.tag][0])
    out[0] = out[0][:place] + "".join(f' xmlns:{p}="{attribute(u)}"' for u, p in spaces.items() if u != XML) + out[0][place:]
    return ("<?xml version='1.0' encoding='UTF-8'?>\n" + "".join(out)).encode()


def _put_element(e: ElementTree.Element, tags: Tags, attributes: dict[tuple, str], put: Callable[[str], None]) -> None:
    """All but the tail; attributes: those written before."""
    name, start, end, empty = tags[e.tag]
    if items := e.items():
        key = tuple(items)
        if (said := attributes.get(key)) is None:
            said = "".join([f' {tags[k][0]}="{attribute(v)}"' for k, v in items])
            if len(attributes) < 1000:
                attributes[key] = said
        start, empty = f"<{name}{said}>", f"<{name}{said} />"
    text = e.text
    if len(e):
        put(start)
        if text:
            put(escaped(text))
        for c in e:
            _put_element(c, tags, attributes, put)
            if c.tail:
                put(escaped(c.tail))
        put(end)
    elif text:
        put(f"{start}{escaped(text)}{end}")
    else:
        put(empty)


def walked(content: bytes, walk: Callable, edit: Callable | None = None):
    """What `walk(package)` yields; with `edit(item) -> bool`, the file after the items' parts that it changed."""
    package = Package(content)
    if edit is None:
        return list(walk(package))
    return package.saved({item[0] for item in walk(package) if edit(item)})
