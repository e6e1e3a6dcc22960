"""Edit-aware token counts: a tree of pre-tokens per document.

Byte-level BPE never merges across pre-tokens, so a text's count is the sum over its
pre-tokens. A document's pre-tokens (their lengths in code points and their counts)
stand in blocks, and a binary tree over the blocks holds both sums. An edit finds its
blocks by walking down the tree, splits into pre-tokens anew from a little before the
edit until a boundary falls on an old one, counts only those, and updates the sums on
the paths of the blocks that changed. The tree is a column, so it is kept between
jobs.

Counts are those of `packing.byte_encoder`: the literal end-of-text string is a
pre-token of its own with one id, and texts end before it and begin after it.

Defined cases: a null text counts as empty, with 0 tokens and an empty tree; a very
long text has a long tree, and one tree is in memory at a time; edits
beyond the text's end are cut to it; edits apply in order, each to the text that the
one before left; a null list of edits is no edit; repeated rows are counted alike; ids
may be of any type and null; an empty table gives an empty result. Only the named
columns are read.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import text_or_empty
from weftline.llm.packing import SPECIAL, byte_encoder

BLOCK = 64
#: A match looks at most this many code points beyond its end.
AHEAD = len(SPECIAL)
#: Counts that a task remembers, of pre-tokens up to LONG code points.
REMEMBERED, LONG = 100_000, 40
#: Pre-tokens that are in memory as strings at once, and code points of results that a task holds before it passes them on.
STRINGS, AT_ONCE = 1 << 16, 2 << 20


def pretokens(pattern: str) -> str:
    """`pattern` with the special string as a match of its own: no other match runs into it, and white space ends before it as at a text's end."""
    special = re.escape(SPECIAL)
    others, spaces = r"[^\s\p{L}\p{N}]+", r"\s+(?!\S)"
    if others not in pattern or spaces not in pattern:
        raise ValueError("not the pattern of a byte-level BPE")
    pattern = pattern.replace(others, rf"(?:(?!{special})[^\s\p{{L}}\p{{N}}])+")
    return special + "|" + pattern.replace(spaces, rf"\s+(?:(?!\S)|(?={special}))")


def pretoken_counter(path: str | None = None) -> tuple[Callable, Callable[[str], int]]:
    """(compiled pattern, pre-token -> number of ids) of the byte-level BPE of 50,257 entries."""
    import public_tokenizers
    import regex

    encode, seen = byte_encoder(path), {}

    def count(pre: str) -> int:
        n = seen.get(pre)
        if n is None:
            n = len(encode(pre))
            if len(pre) <= LONG:
                if len(seen) >= REMEMBERED:
                    seen.clear()
                seen[pre] = n
        return n

    return regex.compile(pretokens(public_tokenizers.PATTERN)), count


Block = tuple[np.ndarray, np.ndarray]


class Tree:
    """Blocks of (lengths, counts) of pre-tokens, and sums over them: node 1 is the root, node i has children 2i and 2i+1."""

    def __init__(self, blocks: list[Block]):
        self.blocks = blocks
        self.width = 1 << max(0, (len(blocks) - 1).bit_length())
        self.sums = np.zeros((2, 2 * self.width), dtype=np.int64)
        if blocks:
            starts = np.cumsum([0, *[len(b[0]) for b in blocks[:-1]]])
            for k in range(2):
                self.sums[k, self.width : self.width + len(blocks)] = np.add.reduceat(np.concatenate([b[k] for b in blocks]), starts, dtype=np.int64)
        half = self.width
        while half > 1:
            half //= 2
            self.sums[:, half : 2 * half] = self.sums[:, 2 * half : 4 * half : 2] + self.sums[:, 2 * half + 1 : 4 * half : 2]

    @classmethod
    def of(cls, text: str, pattern, count: Callable[[str], int]) -> Tree:
        lengths, counts, matches = [], [], pattern.finditer(text)
        while pre := [m.group() for m in islice(matches, STRINGS)]:
            lengths.append(np.fromiter(map(len, pre), np.uint32, len(pre)))
            counts.append(np.fromiter(map(count, pre), np.uint32, len(pre)))
        if not lengths:
            return cls([])
        n, c = np.concatenate(lengths), np.concatenate(counts)
        return cls([(n[i : i + BLOCK], c[i : i + BLOCK]) for i in range(0, len(n), BLOCK)])

    @property
    def tokens(self) -> int:
        return int(self.sums[1, 1])

    @property
    def chars(self) -> int:
        return int(self.sums[0, 1])

    def find(self, at: int) -> tuple[int, int]:
        """(block, place where it starts) of the code point `at`; the last block for the end."""
        i, start = 1, 0
        while i < self.width:
            i *= 2
            if at >= start + self.sums[0, i] and self.sums[0, i + 1] > 0:
                start += int(self.sums[0, i])
                i += 1
        return i - self.width, start

    def put(self, first: int, last: int, n: np.ndarray, c: np.ndarray) -> None:
        """Blocks first..last become (n, c): in place and by path if they fit, else by a new tree over the blocks."""
        room = last - first + 1
        if room <= len(n) <= 2 * BLOCK * room:
            for k, (x, y) in enumerate(zip(np.array_split(n, room), np.array_split(c, room), strict=True)):
                self.blocks[first + k] = x, y
                i = self.width + first + k
                self.sums[:, i] = x.sum(dtype=np.int64), y.sum(dtype=np.int64)
                while i > 1:
                    i //= 2
                    self.sums[:, i] = self.sums[:, 2 * i] + self.sums[:, 2 * i + 1]
        else:
            self.__init__([*self.blocks[:first], *[(n[i : i + BLOCK], c[i : i + BLOCK]) for i in range(0, len(n), BLOCK)], *self.blocks[last + 1 :]])

    def edit(self, text: str, start: int, end: int, new: str, pattern, count: Callable[[str], int]) -> tuple[str, int]:
        """Replaces text[start:end] by `new`; returns the text and the number of pre-tokens encoded anew."""
        start = min(max(0, start), len(text))
        end = min(max(start, end), len(text))
        after = text[:start] + new + text[end:]
        if not self.blocks:
            self.__init__(Tree.of(after, pattern, count).blocks)
            return after, sum(len(b[0]) for b in self.blocks)
        first, begin = self.find(max(0, start - AHEAD - 1))
        last, b0 = self.find(end)
        # of the first block in reach, those before the edit that no match sees changed
        ends = begin + np.cumsum(self.blocks[first][0], dtype=np.int64)
        kept = int(np.searchsorted(ends, start - AHEAD, side="right"))
        at = int(ends[kept - 1]) if kept else begin
        shift = len(new) - (end - start)
        lengths, counts, rest, here = [], [], None, at
        bounds = self._bounds(last, b0)
        matches = pattern.finditer(after, at)
        while True:
            if here - shift >= end and here - shift >= at:  # all that follows is old text
                while last + 1 < len(self.blocks) and bounds[-1] < here - shift:
                    last, b0 = last + 1, bounds[-1]
                    bounds = self._bounds(last, b0)
                k = bisect_left(bounds, here - shift)
                if k < len(bounds) and bounds[k] == here - shift:
                    rest = k
                    break
            m = next(matches, None)
            if m is None:
                last = len(self.blocks) - 1
                break
            lengths.append(m.end() - m.start())
            counts.append(count(m.group()))
            here = m.end()
        made = np.array(lengths, np.uint32), np.array(counts, np.uint32)
        head = [x[:kept] for x in self.blocks[first]]
        tail = [x[rest:] if rest is not None else x[:0] for x in self.blocks[last]]
        self.put(first, last, *[np.concatenate(x) for x in zip(head, made, tail, strict=True)])
        return after, len(lengths)

    def _bounds(self, block: int, start: int) -> list[int]:
        return [start, *(start + np.cumsum(self.blocks[block][0], dtype=np.int64)).tolist()]

    def dump(self) -> bytes:
        sizes = np.array([len(self.blocks), *[len(b[0]) for b in self.blocks]], "<u4")
        flat = [b[k].astype("<u4", copy=False) for k in range(2) for b in self.blocks]
        return b"".join([sizes.tobytes(), *[x.tobytes() for x in flat], self.sums.astype("<i8").tobytes()])

    @classmethod
    def load(cls, blob: bytes) -> Tree:
        n = int(np.frombuffer(blob, "<u4", 1)[0])
        sizes = np.frombuffer(blob, "<u4", n, 4)
        total = int(sizes.sum())
        flat = np.frombuffer(blob, "<u4", 2 * total, 4 * (1 + n))
        ends = np.concatenate([[0], np.cumsum(sizes)]).astype(int).tolist()
        out = cls.__new__(cls)
        out.blocks = [(flat[a:b], flat[total + a : total + b]) for a, b in zip(ends, ends[1:], strict=False)]
        out.sums = np.frombuffer(blob, "<i8", offset=4 * (1 + n + 2 * total)).reshape(2, -1).copy()
        out.width = out.sums.shape[1] // 2
        return out


def _each(src: DataFrame, add: str, what: Callable, tokenizer: str | None) -> DataFrame:
    """doc_id and `add`: what(pattern, count, other columns of the row) for each row of `src`, one row in memory at a time."""
    fields = [x.split() for x in add.split(", ")]
    types = {"string": pa.string(), "binary": pa.binary(), "long": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern, count = pretoken_counter(tokenizer)
        for b in batches:
            rows, size, first = [], 0, 0

            def out(end: int) -> pa.RecordBatch:
                cols = list(zip(*rows, strict=True)) or [()] * len(fields)  # noqa: B023
                return pa.RecordBatch.from_arrays([b.column(0).slice(first, end - first), *[pa.array(c, types[t]) for c, (_, t) in zip(cols, fields, strict=True)]], ["doc_id", *[n for n, _ in fields]])  # noqa: B023

            for i in range(b.num_rows):
                own = [c[i].as_py() for c in b.columns[1:]]
                rows.append(what(pattern, count, *own))
                size += 64 + sum(len(x) for x in rows[-1] if isinstance(x, str | bytes))
                if size > AT_ONCE:
                    yield out(i + 1)
                    rows, size, first = [], 0, i + 1
            if rows:
                yield out(b.num_rows)

    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, {add}")


def _edited(text: str, tree: Tree, edits: list[dict] | None, pattern, count: Callable[[str], int]) -> tuple[str, int]:
    encoded = 0
    for e in edits or ():
        if e is not None:
            text, n = tree.edit(text, e["start"] or 0, e["end"] or 0, e["text"] or "", pattern, count)
            encoded += n
    return text, encoded


def build(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """(doc_id, text, tree binary, n_tokens long)."""

    def one(pattern, count: Callable[[str], int], text: str) -> tuple:
        tree = Tree.of(text, pattern, count)
        return text, tree.dump(), tree.tokens

    return _each(docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text")), "text string, tree binary, n_tokens long", one, tokenizer)


def apply_edits(state: DataFrame, edits_col: str, tokenizer: str | None = None) -> DataFrame:
    """`state` (doc_id, text, tree, edits) after its edits, array<struct<start:int,end:int,text:string>> in code points.

    Returns doc_id, text, tree, n_tokens and n_encoded (pre-tokens encoded anew).
    """

    def one(pattern, count: Callable[[str], int], text: str, blob: bytes, edits: list[dict] | None) -> tuple:
        tree = Tree.load(blob)
        text, encoded = _edited(text, tree, edits, pattern, count)
        return text, tree.dump(), tree.tokens, encoded

    return _each(state.select("doc_id", "text", "tree", F.col(edits_col).alias("edits")), "text string, tree binary, n_tokens long, n_encoded long", one, tokenizer)


def build_and_edit(docs: DataFrame, edits: Column, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """`build` and then `apply_edits` in one pass: (doc_id, text, tree, n_tokens_before, n_tokens, n_encoded)."""

    def one(pattern, count: Callable[[str], int], text: str, edits: list[dict] | None) -> tuple:
        tree = Tree.of(text, pattern, count)
        before = tree.tokens
        text, encoded = _edited(text, tree, edits, pattern, count)
        return text, tree.dump(), before, tree.tokens, encoded

    return _each(docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"), edits.alias("edits")), "text string, tree binary, n_tokens_before long, n_tokens long, n_encoded long", one, tokenizer)


def op10(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Counts of every document before and after three edits of its own: its first tenth is put in after a third, the code point at the middle goes, and `(edited)` is put at the end."""
    n = F.length(text_or_empty("text"))
    one = lambda start, end, text: F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), text.alias("text"))
    tenth = F.floor(n / 10).cast("int")
    edits = F.array(one(F.floor(n / 3), F.floor(n / 3), F.substring(text_or_empty("text"), F.lit(1), tenth)), one(F.floor(n / 2), F.floor(n / 2) + 1, F.lit("")), one(2 * n, 2 * n, F.lit(" (edited)")))
    done = build_and_edit(docs, edits, tokenizer=tokenizer)
    return done.select("doc_id", F.col("n_tokens_before").alias("n_tokens"), F.col("n_tokens").alias("n_tokens_edited"), "n_encoded", F.sha2(F.col("text").cast("binary"), 256).alias("edited_sha256"))
