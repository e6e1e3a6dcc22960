"""Best-fit packing of tokenised documents by minimum bin slack.

Documents become pieces of at most `capacity` tokens. A bin starts with the longest
length that is left; a bitset subset-sum over the lengths that are left finds the
fullest combination beside it, which is removed. The choice depends on which
lengths are left and not on which documents have them, and it stays the same until
one of its lengths runs short; so it is removed as often as it fits at once. The
plan therefore needs the histogram of lengths only (at most `capacity` numbers),
whatever the number of pieces, and pieces find their place by their rank among
those of their length.

Defined cases: a null or empty text is the end token alone; a very long text, or
one with a very long run of one character, is encoded whole and cut into full pieces;
repeated rows are packed separately; ids may be of any type and null; an empty table
gives an empty result; other columns of the input are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import cut, text_or_empty

CAPACITY = 1024
END = 2


#: The string that the tokenizer takes as its special token.
SPECIAL = "<|endoftext|>"
#: tiktoken gives up on white space much longer than this; such texts go to `tokenizers`.
RUN = 10_000


def byte_encoder(path: str | None = None, whole: str | None = None):
    """text -> ids of the byte-level BPE of 50,257 entries, as `tokenizers` gives them with default settings.

    `path`: its ranks, in tiktoken's format; `whole`: the same tokenizer in the format of
    `tokenizers`. Both give the same ids, the first several times as fast. The literal
    end-of-text string in a text is the special token, as in `tokenizers`.
    """
    import base64
    import re
    from functools import cache

    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={SPECIAL: 50256})
    plain, spaces = enc.encode_ordinary, re.compile(r"\s\s+")
    slow = cache(lambda: Tokenizer.from_file(whole or public_tokenizers.path("byte_bpe_50k.json")))

    def encode(text: str) -> list[int]:
        if len(text) > RUN and any(m.end() - m.start() > RUN for m in spaces.finditer(text)):
            return slow().encode(text, add_special_tokens=False).ids
        return enc.encode(text, allowed_special="all") if SPECIAL in text else plain(text)

    return encode


def split_at(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole if it fits, else full pieces after a first that may be shorter."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity
    return [(0, first)] * bool(first) + [(s, capacity) for s in range(first, n, capacity)]


#: Ids that a task holds before it passes them on.
AT_ONCE = 1 << 20

PIECES = "piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end: int = END, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every row's ids followed by `end`; `with_ids` adds the piece's ids."""
    id_type = docs.schema[id_col].dataType
    src = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = byte_encoder(tokenizer)
        types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), *[pa.list_(pa.uint32())] * with_ids]
        names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]
        for b in batches:
            at, rows, size = [], [], 0

            def out() -> pa.RecordBatch:
                cols = list(zip(*rows, strict=True)) or [()] * len(types)  # noqa: B023
                cols = [pa.array(c, t) for c, t in zip(cols, types, strict=True)]
                if with_ids:
                    cols[-1] = cols[-1].cast(pa.list_(pa.int32()))
                return pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *cols], names)  # noqa: B023

            for i in range(b.num_rows):
                ids = np.array([*encode(b.column(1)[i].as_py()), end], dtype="<u4")
                for k, (s, n) in enumerate(split_at(len(ids), capacity)):
                    at.append(i)
                    rows.append((k, s, n, zlib.crc32(ids[s : s + n].tobytes()), *[ids[s : s + n]] * with_ids))
                size += len(ids)
                if size > AT_ONCE:
                    yield out()
                    at, rows, size = [], [], 0
            yield out()

    return src.mapInArrow(run, f"doc_id {id_type.simpleString()}, {PIECES}" + ", ids array<int>" * with_ids)


def fullest(left: dict[int, int], room: int) -> dict[int, int]:
    """Multiplicities of lengths, none above what is left, whose sum is the largest of at most `room`.

    Bit s of a set is on if some combination sums to s. Lengths come in descending
    order and in powers of two of their multiplicity; walking back through the sets
    prefers the combination of longer lengths.
    """
    sets, items, now, mask = [], [], 1, (1 << (room + 1)) - 1
    for n in sorted((n for n in left if n <= room), reverse=True):
        many, k = min(left[n], room // n), 1
        while many > 0:
            m = min(k, many)
            sets.append(now)
            items.append((n, m))
            now |= (now << (n * m)) & mask
            many -= m
            k *= 2
        if now >> room & 1:
            break
    total, out = now.bit_length() - 1, {}
    for (n, m), before in zip(reversed(items), reversed(sets), strict=True):
        if not before >> total & 1:
            out[n] = out.get(n, 0) + m
            total -= n * m
    return out


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """(multiplicities of lengths in a bin, number of such bins), in the order of their removal."""
    left, out = {n: c for n, c in histogram.items() if c > 0}, []
    while left:
        top = max(left)
        rest = dict(left)
        rest[top] -= 1
        combo = fullest({n: c for n, c in rest.items() if c}, capacity - top)
        combo[top] = combo.get(top, 0) + 1
        times = min(left[n] // m for n, m in combo.items())
        out.append((combo, times))
        for n, m in combo.items():
            left[n] -= m * times
            if not left[n]:
                del left[n]
    return out


def pack(pieced: DataFrame, capacity: int = CAPACITY, rows: int = 50_000) -> DataFrame:
    """Adds sequence_id and offset to pieces. `pieced` is read three times and should be cheap to read again.

    Ranks within a length are made by (length, bucket), with a bucket for about `rows`
    pieces of the length, so that a length that most pieces have is dealt to many tasks.
    The driver gets the histogram and a count for each bucket; the plan and these counts
    are what tasks get. Further columns are sorted and passed through Python with their
    bucket, so they should be short; `pack_with_ids` is for the ids.
    """
    histogram = dict(map(tuple, pieced.groupBy("length").count().collect()))
    many = [-(-histogram.get(n, 0) // rows) or 1 for n in range(capacity + 1)]
    bucket = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.element_at(F.lit(many), F.col("length").cast("int") + 1))
    pieced = pieced.withColumn("__b", bucket.cast("int"))
    # where each length's buckets begin, and the pieces of the length before each bucket
    at = np.concatenate([[0], np.cumsum(many)])
    counts = np.zeros(at[-1], dtype=np.int64)
    found = pieced.groupBy("length", "__b").count().toArrow()
    counts[at[found["length"].to_numpy()] + found["__b"].to_numpy()] = found["count"].to_numpy()
    before = np.cumsum(counts) - counts
    before -= np.repeat(before[at[:-1]], many)
    # for each length, the intervals of ranks that a pattern takes: first rank, copies in a bin, first bin, offset in the bin
    taken, bins, spans = {}, 0, {}
    for combo, times in plan(histogram, capacity):
        offset = 0
        for n, m in combo.items():
            first = taken.get(n, 0)
            spans.setdefault(n, []).append((first, m, bins, offset))
            taken[n] = first + m * times
            offset += n * m
        bins += times
    spans = {n: np.array(x, dtype=np.int64).T for n, x in spans.items()}
    sent = pieced.sparkSession.sparkContext.broadcast((at, before, spans))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, before, spans = sent.value
        for b in batches:
            length, bucket, rank = (b.column(k).to_numpy(zero_copy_only=False) for k in (3, 5, 6))
            seq, off = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            for of in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(order) else []:
                n = int(length[of[0]])
                first, m, bin0, offset = spans[n]
                r = rank[of] - 1 + before[at[n] + bucket[of]]
                k = np.searchsorted(first, r, side="right") - 1
                inside = r - first[k]
                seq[of] = bin0[k] + inside // m[k]
                off[of] = offset[k] + inside % m[k] * n
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(seq), pa.array(off), *b.columns[7:]], [*b.schema.names[:5], "sequence_id", "offset", *b.schema.names[7:]])

    within = Window.partitionBy("length", "__b").orderBy("doc_id", "piece", "ids_crc32", "start")
    ranked = pieced.withColumn("__r", F.row_number().over(within).cast("long"))
    own = ["doc_id", "piece", "start", "length", "ids_crc32"]
    more = [c for c in pieced.columns if c not in (*own, "__b")]
    id_type, *types = (pieced.schema[c].dataType.simpleString() for c in ("doc_id", *more))
    ranked = ranked.select(*own, "__b", "__r", *more)
    return ranked.mapInArrow(run, ", ".join([f"doc_id {id_type}, {PIECES}, sequence_id long, offset long", *map("{} {}".format, more, types)]))


def pack_with_ids(docs: DataFrame, capacity: int = CAPACITY, **how: object) -> DataFrame:
    """The pieces of `docs` with their place and their ids; `how` is as for `pieces`.

    A piece's ids are some 4 KB and its place needs none of them. Pieces are numbered as they
    are written and packed without ids, and ids get the places by these numbers. That join hashes the
    places and streams the ids: they are shuffled once, evenly, and neither sorted nor held.
    """
    pieced = cut(pieces(docs, capacity=capacity, with_ids=True, **how).withColumn("__row", F.monotonically_increasing_id()))
    places = pack(pieced.drop("ids"), capacity)
    return places.hint("shuffle_hash").join(pieced.select("__row", "ids"), "__row").drop("__row")


def op6(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    return pack(cut(pieces(docs, tokenizer=tokenizer)))
