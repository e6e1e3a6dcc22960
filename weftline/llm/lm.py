"""Language-model scores by a hierarchical Pitman-Yor model.

Words are drawn from context restaurants, one for the word before (2^20 - 1 by its
hash, and the start of a text). They share one parent, the restaurant of all words. Its
base spells words: a byte model with restaurants for contexts of two, one and no bytes,
each the parent of the next longer, over a uniform byte. Words that training lacks are
one event, which has the probability of all their spellings.

Every restaurant seats its customers by the Chinese restaurant process with a discount
and a strength. A table of a context restaurant is a customer of the restaurant of all
words, and a table there spells the word once in the byte model. Seating is sampled by
Gibbs, a block at a time: all customers of a word in a restaurant are seated anew given
all others, and the number of their tables is drawn from its exact law, however many they
are. That law is held as a table up to `EXACT` customers; of more, its weights are contour
integrals, evaluated for the few numbers of tables that a rejection from a hat asks for.

Occurrences are shuffled once, by word, and a word's context and parent seatings are
sampled together where its rows are. What words share, the numbers of customers and
tables of each context restaurant and of the parent and the spellings, is summed
between passes and held fixed within one. In each pass a word's chain starts from one
table for each context and burns in; its random numbers are a hash of the word, the
context and the step, so that a pass repeats the samples of the pass before it, however
rows are dealt. The first pass refines the totals, the second sums them for the samples kept, and
the last repeats these samples and averages their predictive probabilities.

Defined cases: a null or empty text is its end token alone; a very long text ends its block; with nothing learned, every token is the unknown one, of probability 1; rows learn as often
as they repeat, and each is scored; ids may be of any type and null; an empty table gives
an empty result. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import bucket_of, cut, drop, text_or_empty

#: Context restaurants; the last is that of texts' first words. An occurrence names one by 20 bits.
CONTEXT_BITS = 20
CONTEXTS = 1 << CONTEXT_BITS
START = CONTEXTS - 1
#: Documents in a block at most (an occurrence names one by 12 bits), and bytes.
BLOCK, BLOCK_BYTES = 4096, 16 << 20
#: Occurrences of a word in a block beyond which its counts come before them, and bytes of them in a row of their own.
MANY, CHUNK = 256, 4 << 20


# ---- occurrences

#: Of a word in a block, once for each time that it occurs: context << 12 | document's place.
OCC = np.dtype("<u4")
#: A row's block and, above it, its kind.
KIND = 61
#: Customers of a word in a context.
CELL = np.dtype([("ctx", "<u4"), ("c", "<u4")])


def binary(values: np.ndarray, starts: np.ndarray) -> pa.Array:
    """A binary column whose rows are `values` (of any fixed type) from each start to the next."""
    offsets = (starts * values.dtype.itemsize).astype("<i4")
    return pa.Array.from_buffers(pa.binary(), len(starts) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(values.tobytes())])


def flat(column: pa.Array, kind: np.dtype | str) -> tuple[np.ndarray, np.ndarray]:
    """The values of a binary column end to end, and where each row starts; a null row has none."""
    column = column.fill_null(b"").cast(pa.large_binary())
    at = np.frombuffer(column.buffers()[1], "<i8", len(column) + 1, 8 * column.offset)
    raw = column.buffers()[2]
    raw = np.frombuffer(raw, np.uint8)[at[0] : at[-1]] if raw is not None else np.empty(0, np.uint8)
    return np.frombuffer(raw.tobytes(), kind), (at - at[0]) // np.dtype(kind).itemsize


def pack_block(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """(words, occurrences, starts of each word's, tokens of each text). bytes.lower and split act on ASCII only."""
    ids: dict[bytes, int] = {b"": 0}
    codes, lens = [], np.empty(len(texts), np.int64)
    for i, t in enumerate(texts):
        w = t.lower().split()
        codes.append(np.array([ids.setdefault(x, len(ids)) for x in w] + [0], np.int64))  # and the end
        lens[i] = len(w) + 1
    code = np.concatenate(codes)
    words, of = list(ids), xxhash.xxh64_intdigest
    context = np.fromiter((of(w, 1) % START if w else START for w in words), np.int64, len(words))
    ctx = np.concatenate([[START], context[code[:-1]]])  # an end is followed by a start
    key = np.sort((code << 32) | (ctx << 12) | np.repeat(np.arange(len(texts)), lens))
    return words, (key & 0xFFFFFFFF).astype(OCC), np.concatenate([[0], np.flatnonzero(np.diff(key >> 32)) + 1, [len(key)]]), lens


def cells_of(row: np.ndarray, ctx: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, CELL) by row and context; a customer each, or `n`."""
    key = row.astype(np.int64) << CONTEXT_BITS | ctx
    out_n = None
    if n is None:
        key, out_n = np.unique(key, return_counts=True)
    else:
        key, at = np.unique(key, return_inverse=True)
        out_n = np.bincount(at, weights=n, minlength=len(key)) if len(key) else 0
    out = np.empty(len(key), CELL)
    out["ctx"], out["c"] = key & (CONTEXTS - 1), out_n
    return key >> CONTEXT_BITS, out


def starts_of(row: np.ndarray, rows: int) -> np.ndarray:
    return np.searchsorted(row, np.arange(rows + 1))


def occurrences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_out: Column | None = None, many: int = MANY) -> DataFrame:
    """Rows (word, at, occ) and, with a null word, (at, doc): struct of place, doc_id, held_out and n_tokens.

    `at` has the row's block, and its kind above. A block has training texts only (its
    number is even) or held-out texts only. Kinds order a word's rows: 0, its training
    counts in blocks that have more than `many` of its occurrences; 1, the occurrences of
    smaller blocks; 2, those of the others.
    """
    held = F.lit(False) if held_out is None else F.coalesce(held_out, F.lit(False))
    src = docs.select(text_or_empty(text_col).cast("binary").alias("t"), held.alias("held"), F.col(id_col).alias("doc_id"))
    id_type = src.schema["doc_id"].dataType.simpleString()
    names = ["word", "at", "occ", "doc"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, k = TaskContext.get().partitionId() << 32, 0
        texts: tuple[list, list] = [], []
        ids: tuple[list, list] = [], []
        size = [0, 0]

        def rows(words: pa.Array, kind: int, block: int, blobs: pa.Array, doc_type: pa.DataType) -> Iterator[pa.RecordBatch]:
            for i in range(0, len(words), 20_000):
                w = words.slice(i, 20_000)
                yield pa.RecordBatch.from_arrays([w, pa.array(np.full(len(w), kind << KIND | block)), blobs.slice(i, 20_000), pa.nulls(len(w), doc_type)], names)

        def out(h: int) -> Iterator[pa.RecordBatch]:
            nonlocal k
            block, k = base | k << 1 | h, k + 1
            words, occ, starts, lens = pack_block(texts[h])
            n = len(texts[h])
            doc = pa.StructArray.from_arrays([pa.array(np.arange(n, dtype=np.int32)), pa.concat_arrays(ids[h]), pa.array(np.full(n, bool(h))), pa.array(lens)], ["place", "doc_id", "held_out", "n_tokens"])
            yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.binary()), pa.array(np.full(n, block)), pa.nulls(n, pa.binary()), doc], names)
            word, often = pa.array(words, pa.binary()), np.diff(starts) > many
            large, small = np.flatnonzero(often), np.flatnonzero(~often)
            blobs = binary(occ, starts)
            if len(large):
                use = np.repeat(often & (h == 0), np.diff(starts))
                row, cells = cells_of(np.repeat(np.arange(len(words)), np.diff(starts))[use], occ[use] >> 12)
                yield from rows(word.take(pa.array(large)), 0, block, binary(cells, np.append(np.searchsorted(row, large), len(row))), doc.type)
            yield from rows(word.take(pa.array(small)), 1, block, blobs.take(pa.array(small)), doc.type)
            yield from rows(word.take(pa.array(large)), 2, block, blobs.take(pa.array(large)), doc.type)
            texts[h].clear()
            ids[h].clear()
            size[h] = 0

        for b in batches:
            for i in range(b.num_rows):
                h = int(b.column(1)[i].as_py())
                texts[h].append(b.column(0)[i].as_py())
                ids[h].append(b.column(2).slice(i, 1))
                size[h] += len(texts[h][-1])
                if len(texts[h]) == BLOCK or size[h] > BLOCK_BYTES:
                    yield from out(h)
        for h in range(2):
            if texts[h]:
                yield from out(h)

    return src.mapInArrow(run, f"word binary, at long, occ binary, doc struct<place:int,doc_id:{id_type},held_out:boolean,n_tokens:bigint>")


# ---- words: a row (or more, for a frequent one) with all that is known of a word

WORDS = [("word", "binary", pa.binary()), ("lead", "boolean", pa.bool_()), ("cells", "binary", pa.binary()), ("ones", "long", pa.int64()), ("blocks", "binary", pa.binary()), ("counts", "binary", pa.binary()), ("occ", "binary", pa.binary())]
TOTALS = [("field", "int", pa.int32()), ("sums", "binary", pa.binary()), ("total", "long", pa.int64()), ("value", "double", pa.float64())]
#: Sums by context are cut into ranges of as many contexts as two bytes tell apart.
RANGE = 1 << 16
PART = np.dtype([("i", "<u2"), ("n", "<u4")])
#: Fields: customers, tables of cells, tables of contexts with one customer; from SAMPLE on, tables in each sample.
CUSTOMERS, TABLES, LONE, SAMPLE = 0, 1, 2, 3
#: Keys of single totals, below those of byte trigrams (not negative); of samples: ten further down each.
ROOT_C, ROOT_T, TYPES, TOKENS, ONES, TWOS, ROOT_ONES, ROOT_TWOS, SEEN, CELLS = range(-1, -11, -1)


class Sums:
    """A task's part of the totals."""

    def __init__(self):
        self.single: dict[int, float] = {}
        self.by: dict[int, np.ndarray] = {}

    def add(self, key: int, value: float) -> None:
        self.single[key] = self.single.get(key, 0.0) + float(value)

    def count(self, field: int, ctx: np.ndarray, n: np.ndarray | None = None) -> None:
        if field not in self.by:
            self.by[field] = np.zeros(CONTEXTS)
        np.add.at(self.by[field], ctx.astype(np.intp), 1.0 if n is None else n.astype(np.float64))  # its cost is that of `ctx`, not of all contexts

    def spell(self, word: tuple[np.ndarray, np.ndarray], tables: np.ndarray) -> None:
        """Byte trigrams, once for each of a word's tables."""
        two, one, sym, at = symbols(*word)
        grams, which = np.unique((two * 257 + one) * 257 + sym, return_inverse=True)
        for k, v in zip(grams.tolist(), np.bincount(which, weights=tables[at]).tolist(), strict=True):
            if v:
                self.add(k, v)

    def batches(self, columns: list[tuple] = TOTALS) -> Iterator[pa.RecordBatch]:
        def rows(n: int, **have: pa.Array) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([have[name] if name in have else pa.nulls(n, t) for name, _, t in columns], [name for name, _, _ in columns])

        for field, sums in self.by.items():
            for k in range(CONTEXTS // RANGE):
                part = sums[k * RANGE : (k + 1) * RANGE]
                at = np.flatnonzero(part)
                times = -(-part[at] // 0xFFFFFFFF).astype(np.int64)  # counts beyond four bytes: again
                x = np.zeros(int(times.sum()), PART)
                x["i"] = np.repeat(at, times)
                x["n"] = np.repeat(part[at] // times, times)
                if len(x):
                    x["n"][np.cumsum(times) - 1] += (part[at] - part[at] // times * times).astype(np.uint32)
                yield rows(1, field=pa.array([field * (CONTEXTS // RANGE) + k], pa.int32()), sums=pa.array([x.tobytes()], pa.binary()))
        if self.single:
            yield rows(len(self.single), total=pa.array(self.single.keys(), pa.int64()), value=pa.array(self.single.values(), pa.float64()))


class Collected:
    """Totals of a pass: at most about a thousand single ones and one for each byte trigram, and sums by context, 8 MB a field."""

    def __init__(self, totals: DataFrame):
        found = totals.filter("total IS NOT NULL").groupBy("total").agg(F.sum("value").alias("value")).toArrow()
        self.single = dict(zip(found["total"].to_pylist(), found["value"].to_pylist(), strict=True))

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            by: dict[int, np.ndarray] = {}
            for b in batches:
                for field, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    x = np.frombuffer(blob, PART)
                    by.setdefault(field, np.zeros(RANGE))
                    by[field] += np.bincount(x["i"], weights=x["n"], minlength=RANGE)
            for field, sums in by.items():
                yield pa.RecordBatch.from_arrays([pa.array([field], pa.int32()), pa.array([sums.tobytes()], pa.binary())], ["field", "sums"])

        self.by: dict[int, np.ndarray] = {}
        parts = CONTEXTS // RANGE
        for r in totals.filter("field IS NOT NULL").select("field", "sums").repartition("field").mapInArrow(add, "field int, sums binary").toArrow().to_pylist():
            self.by.setdefault(r["field"] // parts, np.zeros(CONTEXTS))[r["field"] % parts * RANGE :][:RANGE] = np.frombuffer(r["sums"])

    def __getitem__(self, key: int) -> float:
        return self.single.get(key, 0.0)

    def context(self, field: int) -> np.ndarray:
        return self.by.get(field, np.zeros(CONTEXTS))

    def grams(self) -> dict[int, float]:
        return {k: v for k, v in self.single.items() if k >= 0}


def gathered(rows: DataFrame, size: int = CHUNK) -> DataFrame:
    """Words, totals of the state in which each context has one table, and the texts' rows; the only shuffle of occurrences."""
    texts = [("at", "long", pa.int64()), ("doc", rows.schema["doc"].dataType.simpleString(), None)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, columns, kept = Sums(), [*WORDS, *TOTALS, *texts], None

        def full(n: int, **have: pa.Array) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([have[name] if name in have else pa.nulls(n, t) for name, _, t in columns], [name for name, _, _ in columns])

        def learned(word: tuple[np.ndarray, np.ndarray], row: np.ndarray, cells: np.ndarray, rows: int) -> None:
            """Adds words with training occurrences to the totals."""
            customers = np.bincount(row, minlength=rows)
            sums.count(CUSTOMERS, cells["ctx"], cells["c"])
            for key, value in ((TOKENS, cells["c"].sum(dtype=np.int64)), (CELLS, len(cells)), (ROOT_C, len(cells)), (ROOT_T, np.sum(customers > 0)), (TYPES, np.sum(customers > 0)), (ONES, np.sum(cells["c"] == 1)), (TWOS, np.sum(cells["c"] == 2)), (ROOT_ONES, np.sum(customers == 1)), (ROOT_TWOS, np.sum(customers == 2))):
                sums.add(key, value)
            sums.spell(word, (customers > 0).astype(float))

        def small(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            """Words whose rows are all here and of kind 1."""
            if not b.num_rows:
                return
            occ, at = flat(b.column("occ"), OCC)
            word, block = b.column("word"), b.column("at").to_numpy() & ((1 << KIND) - 1)
            first = np.flatnonzero(changes(word))
            n = len(first)
            of = np.repeat(np.searchsorted(first, np.arange(b.num_rows), side="right") - 1, np.diff(at))
            use = np.repeat(block & 1 == 0, np.diff(at))
            row, cells = cells_of(of[use], occ[use] >> 12)
            names = word.take(pa.array(first))
            learned(flat(names, "u1"), row, cells, n)
            lone = cells["c"] == 1
            sums.count(LONE, cells["ctx"][lone])
            sums.count(TABLES, cells["ctx"][~lone])
            yield full(
                n, word=names, lead=pa.array(np.ones(n, bool)), cells=binary(cells[~lone], starts_of(row[~lone], n)), ones=pa.array(np.bincount(row[lone], minlength=n)),
                blocks=binary(block, np.append(first, len(block))), counts=binary(np.diff(at).astype("<u4"), np.append(first, len(block))), occ=binary(occ, np.append(at[first], at[-1])),
            )

        class Large:
            """A word with rows of kind 0: counts are merged first, then its occurrences pass through in chunks."""

            def __init__(self, word: bytes):
                self.word, self.cells, self.rows, self.size, self.lead = word, [np.empty(0, CELL)], [], 0, True
                self.done = None

            def merged(self) -> np.ndarray:
                c = np.concatenate(self.cells)
                self.cells = [cells_of(np.zeros(len(c), np.int64), c["ctx"], c["c"])[1]]
                return self.cells[0]

            def add(self, kind: int, block: int, blob: bytes) -> Iterator[pa.RecordBatch]:
                if kind == 0:
                    self.cells.append(np.frombuffer(blob, CELL))
                else:
                    if kind == 1 and block & 1 == 0:
                        occ = np.frombuffer(blob, OCC)
                        self.cells.append(cells_of(np.zeros(len(occ), np.int64), occ >> 12)[1])
                    self.rows.append((block, blob))
                    self.size += len(blob)
                if len(self.cells) > 1000:
                    self.merged()
                if kind == 2 and self.size > max(size, 8 * len(self.cells[0])):
                    yield self.chunk()

            def chunk(self) -> pa.RecordBatch:
                if self.done is None:
                    self.done = self.merged()
                    if len(self.done):
                        learned((np.frombuffer(self.word, np.uint8), np.array([0, len(self.word)])), np.zeros(len(self.done), np.int64), self.done, 1)
                        sums.count(TABLES, self.done["ctx"])
                blocks, blobs = zip(*self.rows, strict=True)
                out = full(
                    1, word=pa.array([self.word], pa.binary()), lead=pa.array([self.lead]), cells=pa.array([self.done.tobytes()], pa.binary()), ones=pa.array([0], pa.int64()),
                    blocks=pa.array([np.array(blocks, "<i8").tobytes()], pa.binary()), counts=pa.array([np.array([len(x) // OCC.itemsize for x in blobs], "<u4").tobytes()], pa.binary()), occ=pa.array([b"".join(blobs)], pa.binary()),
                )
                self.rows, self.size, self.lead = [], 0, False
                return out

        large = None

        def words(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            """Rows of whole words, but that a large word may have begun before and may go on."""
            nonlocal large
            first = np.flatnonzero(changes(b.column("word")))
            at = b.column("at").to_numpy()
            kind, block = at >> KIND, at & ((1 << KIND) - 1)
            big = first[kind[first] == 0]
            lo = 0
            if large is not None and b.num_rows and b.column("word")[0].as_py() == large.word:
                big = np.union1d(big, [0])
            elif large is not None:
                yield from end()
            for f in big.tolist():
                yield from small(b.slice(lo, f - lo))
                lo = int(np.append(first, b.num_rows)[np.searchsorted(first, f, side="right")])
                word = b.column("word")[f].as_py()
                if large is None or large.word != word:
                    yield from end()
                    large = Large(word)
                for i in range(f, lo):
                    yield from large.add(int(kind[i]), int(block[i]), b.column("occ")[i].as_py())
            yield from small(b.slice(lo))

        def end() -> Iterator[pa.RecordBatch]:
            nonlocal large
            if large is not None and large.rows:
                yield large.chunk()
            large = None

        for b in batches:
            columns[-1] = ("doc", "", b.column("doc").type)
            n = b.column("word").null_count
            if n:
                yield full(n, **{name: b.column(name).slice(0, n) for name, _, _ in texts})
            b = b.slice(n).select(["word", "at", "occ"])
            if not b.num_rows:
                continue
            if kept is not None:
                b = pa.Table.from_batches([kept, b]).combine_chunks().to_batches()[0]
            last = int(np.flatnonzero(changes(b.column("word")))[-1])
            if b.column("at")[last].as_py() >> KIND == 0 or (large is not None and last == 0 and b.column("word")[0].as_py() == large.word):
                last = b.num_rows  # a large word needn't be here whole
            yield from words(b.slice(0, last))
            kept = b.slice(last) if last < b.num_rows else None
        if kept is not None:
            yield from words(kept)
        yield from end()
        if columns[-1][2] is not None:
            yield from sums.batches(columns)

    schema = ", ".join(f"{name} {kind}" for name, kind, _ in [*WORDS, *TOTALS, *texts])
    dealt = rows.repartition(F.coalesce(F.xxhash64("word"), F.xxhash64("at", "doc.place"))).sortWithinPartitions("word", "at")
    return cut(dealt.mapInArrow(run, schema), "zstd")


def changes(word: pa.Array) -> np.ndarray:
    """Whether a row's word differs from that of the row before."""
    import pyarrow.compute as pc

    return np.concatenate([[True], pc.not_equal(word.slice(1), word.slice(0, len(word) - 1)).to_numpy(zero_copy_only=False)]) if len(word) else np.empty(0, bool)


# ---- seating


def uniform(key: np.ndarray, step: int) -> np.ndarray:
    """Numbers in [0, 1), a hash of the key and the step."""
    z = key + np.uint64(step * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)) * 2.0**-53


#: Customers of a dish up to which the weights of seatings are held as a table (2 MB). The law is the same beyond.
EXACT = 512
#: Customers up to which all cells with as many are drawn together; of more, as many cells at once as `TOGETHER`, by size.
ALIKE, TOGETHER = 64, 64
#: Points of a contour integral and how far it goes, in widths of its peak: errors of a weight's logarithm are about 1e-7.
NODES, WIDTHS = 32, 9.0
#: Cells whose integrals are evaluated together.
CELLS_AT_ONCE = 1024


@lru_cache(maxsize=4)
def arrangements(d: float) -> np.ndarray:
    """Logarithms of the weights of all seatings of c customers at t tables, generalised Stirling numbers: row c, column t."""
    out = np.full((EXACT + 1, EXACT + 1), -np.inf)
    out[0, 0] = 0.0
    for c in range(1, EXACT + 1):
        with np.errstate(divide="ignore"):
            stay = np.log(np.maximum(c - 1 - d * np.arange(1, EXACT + 1), 0.0)) + out[c - 1, 1:]
        out[c, 1:] = np.logaddexp(out[c - 1, :-1], stay)
    return out


def log_factorial(n: np.ndarray) -> np.ndarray:
    """By Stirling's series, from 10 on; below by recurrence."""
    x = np.maximum(n, 10.0) + 1
    out = (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5) - 1 / (1680 * x**7)
    for k in range(1, 11):
        out -= np.where(n < k, np.log(k), 0.0)
    return out


def log_arrangements(c: np.ndarray, t: np.ndarray, d: float) -> np.ndarray:
    """Logarithms of the weights of all seatings of c customers at t tables, over c!.

    Of the power series of ((1 - (1-z)^d) / d)^t / t!, the coefficient at c, for which see the
    generalised Stirling numbers: an integral around the cut from 1 on, through the saddle.
    """
    ratio = np.log(c) - np.log(t * d)
    lo, hi = -ratio / (1 - d), np.minimum((np.log(t) - np.log(c)) / (1 - d), -1e-12)
    v = (lo + hi) / 2  # logarithm of 1 - z at the saddle
    for _ in range(12):
        e, ed = -np.expm1(v), -np.expm1(d * v)
        f = ratio + (1 - d) * v - np.log(e) + np.log(ed)
        lo, hi = np.where(f < 0, v, lo), np.where(f < 0, hi, v)
        v = v - f / (1 - d + np.exp(v) / e - d * np.exp(d * v) / ed)
        v = np.where((v > lo) & (v < hi), v, (lo + hi) / 2)
    v = np.clip(v, -np.log(c), np.log1p(-0.1 / c))
    w, z, g = np.exp(v), -np.expm1(v), -np.expm1(d * v)
    bend, slope = z / (4 * w), d * np.exp(d * v) / w * z / g
    peak = t * slope * (1 + (1 - d) * z / w - slope) + 2 * bend * np.maximum(c - t * slope, 0)
    upto = np.minimum(np.pi, WIDTHS / np.sqrt(np.maximum(peak, 1e-30)))
    angle, bend = (np.arange(NODES) + 0.5) / NODES * upto[:, None], bend[:, None]
    by = 4 * bend * np.sin(angle / 2) ** 2 + 1j * angle  # of the logarithm of z
    power = t[:, None] * np.log1p(-np.exp(d * np.log(-np.expm1(np.log(z)[:, None] + by))))
    near = t * np.exp(d * v) < 1  # to 1, whose integral is 0
    at = np.where(near, 0.0, t * np.log(g))
    values = np.exp(np.where(near[:, None], 0.0, power) - at[:, None] - c[:, None] * by)
    values[near] *= np.expm1(power[near])
    whole = (values * (1j + 2 * bend * np.sin(angle))).imag.sum(axis=1) * upto / (NODES * np.pi)
    log = np.log(np.where(t == c, 1.0, whole)) + at - c * np.log(z) - log_factorial(t) - t * np.log(d)
    return np.where(t == c, -log_factorial(c), log)


def expected(c: np.ndarray, new: np.ndarray, d: float) -> tuple[np.ndarray, np.ndarray]:
    """About the mean and the variance of the number of tables."""
    x = c / new
    v = np.minimum(-np.log1p(x), -np.log(x) / (1 - d))
    for _ in range(8):
        v = np.minimum(v + (np.log(-np.expm1(v)) - (1 - d) * v - np.log(x)) / (np.exp(v) / -np.expm1(v) + 1 - d), -1e-12)
    mean = new / d * -np.expm1(d * v)
    return mean, mean - c / (1 + (1 - d) * np.expm1(-np.maximum(v, -600.0)))


def drawn(c: np.ndarray, new: np.ndarray, d: float, key: np.ndarray, step: int) -> tuple[np.ndarray, int]:
    """Numbers of tables of cells with any number of customers from 3 on, and the most proposals that a cell took.

    The weights new^t S(c, t) are log-concave in t (their polynomial has real roots), so chords through
    three of them, drawn on, are a hat: numbers are proposed by it, and kept by the exact weights.
    """
    c, new = c.astype(np.float64), np.maximum(new, 1e-290)

    def weight(i: np.ndarray, t: np.ndarray) -> np.ndarray:
        return log_arrangements(c[i], t, d) + t * np.log(new[i])

    mean, variance = expected(c, new, d)
    s = np.maximum(1.0, np.round(1.4 * np.sqrt(np.maximum(variance, 0.25))))
    m = np.clip(np.floor(mean + 1), 2, c - 1)
    lo, hi = np.full(len(c), 2.0), c - 1
    below, above, top, up, down = np.empty((5, len(c)))
    todo, times = np.arange(len(c)), 1.0
    while len(todo):  # until the greatest weight is about at m
        i, a, b = todo, np.minimum(s[todo], m[todo] - 1), np.minimum(s[todo], c[todo] - m[todo])
        left, mid, right = weight(np.tile(i, 3), np.concatenate([m[i] - a, m[i], m[i] + b])).reshape(3, -1)
        below[i], above[i], top[i], up[i], down[i] = a, b, mid, (mid - left) / a, (right - mid) / b
        lo[i], hi[i] = np.where(down[i] > 0, m[i], lo[i]), np.where(up[i] < 0, m[i], hi[i])
        todo = i[((down[i] > 0) & (m[i] < hi[i])) | ((up[i] < 0) & (m[i] > lo[i]))]
        to = m[todo] + np.where(down[todo] > 0, times, -times) * s[todo]
        m[todo] = np.where((to > lo[todo]) & (to < hi[todo]), to, np.where(down[todo] > 0, np.ceil((lo[todo] + hi[todo]) / 2), np.floor((lo[todo] + hi[todo]) / 2)))
        times *= 2
    # the hat's pieces, from m outwards: first place, its logarithm there, its fall by place, places
    first = np.stack([-below, np.zeros(len(c)), np.ones(len(c)), above])
    slope = np.stack([up, down, up, down])
    way = np.array([-1.0, -1.0, 1.0, 1.0])[:, None]
    places = np.stack([m - below, below, above - 1, c - m - above + 1])
    fall = -way * slope
    fall = np.where(np.abs(fall) < 1e-12, 1e-12, fall)
    area = np.cumsum(np.exp(slope * first) * (np.expm1(-fall * places) / np.expm1(-fall)), axis=0)
    out, todo, rounds = np.zeros(len(c), np.int64), np.arange(len(c)), 0
    while len(todo):
        u = uniform(key[todo], step + 1 + 2 * rounds) * area[3, todo]
        piece = np.minimum((area[:, todo] <= u).sum(axis=0), 3)
        under = np.where(piece > 0, area[piece - 1, todo], 0.0)
        u = (u - under) / (area[piece, todo] - under)
        n, f = places[piece, todo], fall[piece, todo]
        j = np.clip(np.floor(-np.log1p(u * np.expm1(-f * n)) / f), 0, n - 1)
        k = first[piece, todo] + way[piece, 0] * j
        with np.errstate(divide="ignore"):
            keep = np.log(uniform(key[todo], step + 2 + 2 * rounds)) <= weight(todo, m[todo] + k) - top[todo] - slope[piece, todo] * k
        out[todo[keep]] = (m[todo] + k)[keep]
        todo, rounds = todo[~keep], rounds + 1
    return out, rounds


def seated(c: np.ndarray, new: np.ndarray, d: float, key: np.ndarray, step: int) -> tuple[np.ndarray, int]:
    """Tables of the `c` customers of each cell, given the weight `new` of a new one: a Gibbs step.

    Every cell is drawn as a whole: t tables weigh new^t times the weights of all seatings at
    t tables. Returns the tables, and the most proposals that a cell took.
    """
    t, rounds = np.minimum(c, 1), 0
    order = np.argsort(c, kind="stable")
    upto = np.searchsorted(c[order], np.arange(EXACT + 2))
    log, u = arrangements(d), uniform(key, step)

    def by_table(who: np.ndarray, rows: np.ndarray) -> None:
        w = np.log(np.maximum(new[who], 1e-300))[:, None] * np.arange(rows.shape[-1]) + rows
        w = np.cumsum(np.exp(w - w.max(axis=1, keepdims=True)), axis=1)
        t[who] = 1 + np.minimum((w < (u[who] * w[:, -1])[:, None]).sum(axis=1), c[who] - 1)

    for k in range(2, ALIKE + 1):
        who = order[upto[k] : upto[k + 1]]
        if len(who):
            by_table(who, log[k, 1 : k + 1])
    for i in range(upto[ALIKE + 1], upto[EXACT + 1], TOGETHER):
        who = order[i : min(i + TOGETHER, upto[EXACT + 1])]
        by_table(who, log[c[who], 1 : c[who[-1]] + 1])
    for i in range(upto[EXACT + 1], len(order), CELLS_AT_ONCE):
        who = order[i : i + CELLS_AT_ONCE]
        t[who], n = drawn(c[who], new[who], d, key[who], step)
        rounds = max(rounds, n)
    return t, rounds


def reseat(sizes: np.ndarray, tables: np.ndarray, take: np.ndarray, give: np.ndarray, new: np.ndarray, d: float, key: np.ndarray, step: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Takes `take` random customers of each cell away and seats `give`, in turn, one at a time.

    A cell is a dish in a restaurant; `sizes` has the customers at each table, cell after
    cell, and `tables` how many a cell has. A customer joins a table of n with weight
    n - d, and opens one with weight `new`. Returns the sizes and the tables after that.
    The model draws cells as a whole; this is the law that tests hold them to.
    """
    rounds = np.maximum(take, give)
    order = np.argsort(-rounds, kind="stable")
    rounds, take, give, new, key, t = rounds[order], take[order], give[order], new[order], key[order], tables[order].copy()
    room = t + give
    first = np.concatenate([[0], np.cumsum(room)])
    slots = np.zeros(first[-1], np.int64)
    # tables of a cell to the beginning of its room
    start = (np.cumsum(tables) - tables)[order]
    within = np.arange(int(t.sum())) - np.repeat(np.cumsum(t) - t, t)
    slots[np.repeat(first[:-1], t) + within] = sizes[np.repeat(start, t) + within]
    free = first[:-1] + t
    c = np.bincount(np.repeat(np.arange(len(t)), t), weights=sizes[np.repeat(start, t) + within], minlength=len(t)).astype(np.int64)
    for r in range(int(rounds[0]) if len(rounds) else 0):
        k = int(np.searchsorted(-rounds, -r, side="left"))  # cells with more rounds than r
        s, lo = slots[: first[k]], first[:k]
        empty = np.full(k, -1)
        who = np.flatnonzero(take[:k] > r)
        if len(who):
            upto = np.cumsum(s)
            at = np.searchsorted(upto, upto[lo[who]] - s[lo[who]] + np.floor(uniform(key[who], step + 3 * r) * c[who]).astype(np.int64), side="right")
            s[at] -= 1
            c[who] -= 1
            gone = s[at] == 0
            t[who[gone]] -= 1
            empty[who[gone]] = at[gone]
        who = np.flatnonzero(give[:k] > r)
        if len(who):
            upto = np.cumsum(np.where(s > 0, s - d, 0.0))
            old = np.maximum(c[who] - d * t[who], 0.0)
            fresh = uniform(key[who], step + 3 * r + 1) * (old + new[who]) < new[who]
            fresh |= t[who] == 0
            before = np.where(lo[who] > 0, upto[lo[who] - 1], 0.0)
            at = np.minimum(np.searchsorted(upto, before + uniform(key[who], step + 3 * r + 2) * old, side="right"), first[who + 1] - 1)
            fresh |= s[at] == 0  # rounding at a cell's end
            reuse = empty[who] >= 0
            at = np.where(fresh, np.where(reuse, empty[who], np.minimum(free[who], first[who + 1] - 1)), at)
            free[who] += fresh & ~reuse
            s[at] += 1
            c[who] += 1
            t[who] += fresh
    cell = np.repeat(order, room)[slots > 0]
    sizes = slots[slots > 0]
    back = np.argsort(cell, kind="stable")
    after = np.empty_like(t)
    after[order] = t
    return sizes[back], after


def discount(n1: float, n2: float) -> float:
    """From the numbers of dishes with one and with two customers, kept inside (0, 1)."""
    return float(np.clip(n1 / (n1 + 2 * n2), 0.1, 0.95)) if n1 and n2 else 0.5


class Spelling:
    """A byte model of words: symbols are bytes from 1 and 0 for a word's end (and before its start).

    Restaurants for two, one and no symbols of context. What it holds is bounded by the
    alphabet of 257 symbols and not by the corpus.
    """

    STRENGTH = 5.0

    def __init__(self, grams: dict[int, float] | None = None, sweeps: int = 4, seed: int = 0):
        s = self.STRENGTH
        key2 = np.array(sorted(grams or {}), dtype=np.int64)
        c2 = np.array([round(grams[k]) for k in key2.tolist()] if grams else [], dtype=np.int64)
        ctx2, at2 = np.unique(key2 // 257, return_inverse=True)
        key1, up2 = np.unique(key2 % 257**2, return_inverse=True)
        sym2, one, sym1 = key2 % 257, key1 // 257, key1 % 257
        d2, d = discount(np.sum(c2 == 1), np.sum(c2 == 2)), 0.5
        key = lambda k, n: (np.arange(n, dtype=np.uint64) << np.uint64(20)) + np.uint64(k)
        p0, p1 = np.full(257, 1 / 257), np.full((257, 257), 1 / 257)
        many = np.bincount(at2, minlength=len(ctx2)).astype(np.float64)  # tables by restaurant, at first one a dish
        for k in range(sweeps if len(key2) else 0):
            t2 = seated(c2, (s + d2 * many[at2]) * p1[one[up2], sym2], d2, key(seed, len(c2)), k << 20)[0]
            many = np.bincount(at2, weights=t2, minlength=len(ctx2))
            c1 = np.bincount(up2, weights=t2, minlength=len(key1)).astype(np.int64)
            t1 = seated(c1, (s + d * np.bincount(one, minlength=257)[one]) * p0[sym1], d, key(seed + 1, len(c1)), k << 20)[0]
            c0 = np.bincount(sym1, weights=t1, minlength=257)
            t0 = np.minimum(c0, 1)
            p0 = (c0 - d * t0 + (s + d * t0.sum()) / 257) / (s + c0.sum())
            own, tables, all1 = np.zeros((257, 257)), np.bincount(one, weights=t1, minlength=257), np.bincount(one, weights=c1, minlength=257)
            own[one, sym1] = c1 - d * t1
            p1 = (own + (s + d * tables)[:, None] * p0) / (s + all1)[:, None]
        p2 = np.zeros((len(ctx2), 257))
        if len(key2):
            p2[at2, sym2] = c2 - d2 * t2
            p2 = (p2 + (s + d2 * many)[:, None] * p1[ctx2 % 257]) / (s + np.bincount(at2, weights=c2))[:, None]
        self.log1, self.log2 = np.log(p1).astype(np.float32), np.log(p2).astype(np.float32)
        self.row = np.full(257 * 257, -1, np.int32)
        self.row[ctx2] = np.arange(len(ctx2))

    def words(self, values: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Probabilities of words whose bytes stand in `values`."""
        two, one, sym, word = symbols(values, starts)
        row = self.row[two * 257 + one]
        log = self.log1[one, sym]
        if len(self.log2):
            log = np.where(row >= 0, self.log2[row, sym], log)
        return np.exp(np.bincount(word, weights=log, minlength=len(starts) - 1))


def symbols(values: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, ...]:
    """(symbol before last, last symbol, symbol, word) for each byte and end of words."""
    n = np.diff(starts)
    word = np.repeat(np.arange(len(n)), n + 1)
    sym = np.zeros(len(word), np.int64)
    inner = np.ones(len(word), bool)
    inner[np.cumsum(n + 1) - 1] = False
    sym[inner] = values[starts[0] : starts[-1]].astype(np.int64) + 1
    one, two = np.zeros_like(sym), np.zeros_like(sym)
    one[1:], two[2:] = sym[:-1], sym[:-2]  # a word before ends with 0, which is right for `one`
    two[one == 0] = 0
    return two, one, sym, word


# ---- the model


class Shared:
    """What a pass holds fixed: the state of the restaurants that words share."""

    STRENGTH, ROOT_STRENGTH = 30.0, 100.0

    def __init__(self, first: Collected, c: np.ndarray, t: np.ndarray, root_c: float, root_t: float, spelling: Spelling):
        self.c, self.t, self.root_c, self.root_t, self.spelling = c.astype(np.float32), t.astype(np.float32), root_c, root_t, spelling
        self.d = discount(first[ONES], first[TWOS])
        self.root_d = discount(first[ROOT_ONES], first[ROOT_TWOS])

    def word(self, c: np.ndarray, t: np.ndarray, base: np.ndarray) -> np.ndarray:
        """Probability in the restaurant of all words, of words with `c` customers at `t` tables there."""
        return (c - self.root_d * t + (self.ROOT_STRENGTH + self.root_d * self.root_t) * base) / (self.ROOT_STRENGTH + self.root_c)

    def back(self, ctx: np.ndarray) -> np.ndarray:
        """Each context restaurant's weight of its parent."""
        return (self.STRENGTH + self.d * self.t[ctx].astype(np.float64)) / (self.STRENGTH + self.c[ctx])


class Chain:
    """Seatings of some words, in the contexts and in the restaurant of all words, sweep by sweep."""

    def __init__(self, shared: Shared, words: pa.Array, cells: np.ndarray, starts: np.ndarray, ones: np.ndarray, seed: int):
        self.shared, self.cells, self.ones = shared, cells, ones
        n = len(words)
        self.row = np.repeat(np.arange(n), np.diff(starts))
        self.root_key = np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words.to_pylist()), np.uint64, n)
        self.key = self.root_key[self.row] + cells["ctx"].astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)
        self.base = shared.spelling.words(*flat(words, "u1"))
        self.c = cells["c"].astype(np.int64)
        self.tables = np.ones(len(cells), np.int64)
        self.root_c = ones + np.diff(starts)
        self.root_tables = np.minimum(self.root_c, 1)
        self.step = 0

    def sweep(self) -> None:
        """The contexts given the parent, and the parent given the contexts' tables."""
        s, n = self.shared, len(self.ones)
        p = s.word(self.root_c, self.root_tables, self.base)
        new = (s.STRENGTH + s.d * s.t[self.cells["ctx"]]) * p[self.row]
        self.tables = seated(self.c, new, s.d, self.key, self.step << 32)[0]
        self.root_c = self.ones + np.bincount(self.row, weights=self.tables, minlength=n).astype(np.int64)
        self.root_tables = seated(self.root_c, (s.ROOT_STRENGTH + s.root_d * s.root_t) * self.base, s.root_d, self.root_key, self.step << 32)[0]
        self.step += 1

    def own(self) -> np.ndarray:
        """The part of a cell's probability that its own customers give."""
        s = self.shared
        return (self.c - s.d * self.tables) / (s.STRENGTH + s.c[self.cells["ctx"]])


def _chain(b: pa.RecordBatch, shared: Shared, seed: int) -> Chain:
    cells, starts = flat(b.column("cells"), CELL)
    return Chain(shared, b.column("word"), cells, starts, b.column("ones").to_numpy(), seed)


def _pass(words: DataFrame, shared: Shared, seed: int, burn: int, kept: int) -> Collected:
    """Totals of the samples that follow `burn` sweeps."""
    sent = words.sparkSession.sparkContext.broadcast(shared)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Sums()
        for b in batches:
            if not b.num_rows:
                continue
            chain = _chain(b, sent.value, seed)
            sums.add(SEEN, chain.base[chain.root_c > 0].sum())
            for k in range(burn + kept):
                chain.sweep()
                if k >= burn:
                    s = k - burn
                    sums.count(SAMPLE + s, chain.cells["ctx"], chain.tables)
                    sums.add(ROOT_C - 10 * (s + 1), chain.root_c.sum())
                    sums.add(ROOT_T - 10 * (s + 1), chain.root_tables.sum())
            sums.spell(flat(b.column("word"), "u1"), chain.root_tables.astype(float))
        yield from sums.batches()

    schema = ", ".join(f"{name} {kind}" for name, kind, _ in TOTALS)
    made = cut(words.filter("lead AND (ones > 0 OR length(cells) > 0)").select("word", "cells", "ones").mapInArrow(run, schema))
    found = Collected(made)
    drop(made)
    return found


class Model:
    """The totals with which the last pass's chains run, and those of each of its samples."""

    def __init__(self, shared: Shared, samples: list[Shared], seen: float, seed: int, burn: int, tokens: int, types: int):
        self.shared, self.samples, self.seen, self.seed, self.burn, self.tokens, self.types = shared, samples, seen, seed, burn, tokens, types

    def unknown(self, s: Shared) -> float:
        """Probability, in the restaurant of all words, of any word that training lacks: of a new table that spells none of the words seen."""
        return float(s.word(0.0, 0.0, np.clip(1 - self.seen, 1e-9, 1)))

    def probabilities(self, words: pa.Array, cells: np.ndarray, starts: np.ndarray, ones: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(a cell's own part averaged over the samples, a word's probability in the parent by sample)."""
        chain = Chain(self.shared, words, cells, starts, ones, self.seed)
        own, p = np.zeros(len(cells)), np.empty((len(self.samples), len(words)))
        for k in range(self.burn + len(self.samples)):
            chain.sweep()
            if k >= self.burn:
                own += chain.own() / len(self.samples)
                s = self.samples[k - self.burn]
                p[k - self.burn] = np.where(chain.root_c > 0, s.word(chain.root_c, chain.root_tables, chain.base), self.unknown(s))
        return own, p


def fit(gathered_: DataFrame, burn: int = 1, kept: int = 2, seed: int = 1) -> Model:
    """From the rows of `gathered`. Two passes over the training counts."""
    words = gathered_.filter("word IS NOT NULL")
    first = Collected(gathered_.select("field", "sums", "total", "value"))
    c, lone = first.context(CUSTOMERS), first.context(LONE)
    shared = Shared(first, c, lone + first.context(TABLES), first[ROOT_C], first[ROOT_T], Spelling(first.grams(), seed=seed))
    sample = lambda f, k, sp: Shared(first, c, lone + f.context(SAMPLE + k), f[ROOT_C - 10 * (k + 1)], f[ROOT_T - 10 * (k + 1)], sp)
    found = _pass(words, shared, seed, burn, 1)
    shared = sample(found, 0, Spelling(found.grams(), seed=seed))
    found = _pass(words, shared, seed + 1, burn, kept)
    return Model(shared, [sample(found, k, shared.spelling) for k in range(kept)], found[SEEN], seed + 1, burn, int(first[TOKENS]), int(first[TYPES]))


#: The word of the last row seen, its cells' own parts and its probabilities in the parent, for the chunks of it that follow.
Before = tuple[bytes, np.ndarray, np.ndarray] | None


def mean_probability(model: Model, b: pa.RecordBatch, before: Before = None) -> tuple[tuple[np.ndarray, ...], Before]:
    """For the occurrences of some words' rows: (word's number, context, place in its block, block, training count of each word, probability).

    A word's chain runs once, however many of its rows follow each other.
    """
    occ, at = flat(b.column("occ"), OCC)
    new = changes(b.column("word"))
    row = np.repeat(np.cumsum(new) - 1, np.diff(at))
    ctx, doc = (occ >> 12).astype(np.int64), occ & 4095
    blocks, _ = flat(b.column("blocks"), "<i8")
    block = np.repeat(blocks, flat(b.column("counts"), "<u4")[0])
    b = b.select(["word", "cells", "ones"]).take(pa.array(np.flatnonzero(new)))
    n, words = b.num_rows, b.column("word")
    cells, starts = flat(b.column("cells"), CELL)
    ones, cell_row = b.column("ones").to_numpy(), np.repeat(np.arange(n), np.diff(starts))
    c = np.bincount(cell_row, weights=cells["c"], minlength=n) + ones
    done = int(before is not None and words[0].as_py() == before[0])
    own, p = model.probabilities(words.slice(done), cells[starts[done] :], starts[done:] - starts[done], ones[done:])
    if done:
        own, p = np.concatenate([before[1], own]), np.concatenate([before[2], p], axis=1)
    before = words[n - 1].as_py(), own[starts[n - 1] :].copy(), p[:, n - 1 :].copy()
    have, want = cell_row << CONTEXT_BITS | cells["ctx"].astype(np.int64), row << CONTEXT_BITS | ctx
    mine = np.zeros(len(want))
    if len(have):
        i = np.minimum(np.searchsorted(have, want), len(have) - 1)
        mine = np.where(have[i] == want, own[i], 0.0)
    # contexts with one customer aren't in `cells`: those of the training occurrences here that have none
    lone = np.unique(want[(block & 1 == 0) & (mine == 0) & (ones > 0)[row]])
    if len(lone):
        s, i = model.shared, np.minimum(np.searchsorted(lone, want), len(lone) - 1)
        mine = np.where((lone[i] == want) & (mine == 0), (1 - s.d) / (s.STRENGTH + s.c[ctx]), mine)
    total = mine
    for k, s in enumerate(model.samples):
        total = total + s.back(ctx) * p[k][row] / len(model.samples)
    return (row, ctx, doc, block, c, total), before


def shares(b: pa.RecordBatch, size: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """A batch's rows in turn, as many at once as have `size` bytes of occurrences, or one."""
    import pyarrow.compute as pc

    upto, lo = np.cumsum(pc.binary_length(b.column("occ")).to_numpy()), 0
    while lo < b.num_rows:
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + size, side="right")))
        yield b.slice(lo, hi - lo)
        lo = hi


SUM = np.dtype([("doc", "<u2"), ("known", "<u4"), ("base", "<f8"), ("score", "<f4")])


def score(gathered_: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document."""
    sent = gathered_.sparkSession.sparkContext.broadcast(model)

    def score_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, held, before = sent.value, {}, None

        def flush() -> Iterator[pa.RecordBatch]:
            for block, sums in held.items():
                at = np.flatnonzero(sums[:, 3])
                x = np.empty(len(at), SUM)
                x["doc"], x["known"], x["base"], x["score"] = at, sums[at, 0], sums[at, 1], sums[at, 2]
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([x.tobytes()], pa.binary())], ["block", "sums"])
            held.clear()

        for b in (share for b in batches for share in shares(b)):
            (row, _, doc, block, c, p), before = mean_probability(model, b, before)
            known, base = c > 0, np.log10((c + 1) / (model.tokens + model.types + 1))
            values = np.stack([known[row], base[row], np.log10(p), np.ones(len(row))], axis=1)
            order = np.argsort(block, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(block[order])) + 1):
                into = held.setdefault(int(block[part[0]]), np.zeros((BLOCK, 4)))
                for k in range(4):
                    into[:, k] += np.bincount(doc[part], weights=values[part, k], minlength=BLOCK)
            if len(held) > 2000:
                yield from flush()
        yield from flush()

    def by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sums = None, np.zeros((BLOCK, 4))

        def out() -> pa.RecordBatch:
            at = np.flatnonzero(sums[:, 3])
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(at), now)), pa.array(at.astype(np.int32)), pa.array(sums[at, 0].astype(np.int64)), pa.array(sums[at, 1]), pa.array(sums[at, 2])], ["b", "p", "n_known", "base_score", "score"])

        for b in batches:
            for block, packed in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if block != now:
                    if now is not None:
                        yield out()
                    now = block
                    sums[:] = 0
                x = np.frombuffer(packed, SUM)
                for k, name in enumerate(("known", "base", "score")):
                    sums[x["doc"], k] += x[name]
                sums[x["doc"], 3] += 1  # present, whatever its sums are
        if now is not None:
            yield out()

    parts = gathered_.filter("word IS NOT NULL").select("word", "cells", "ones", "blocks", "counts", "occ").mapInArrow(score_words, "block long, sums binary")
    each = parts.repartition("block").sortWithinPartitions("block", "sums").mapInArrow(by_block, "b long, p int, n_known long, base_score double, score double")
    texts = gathered_.filter("doc IS NOT NULL").select(F.col("at").alias("block"), "doc.*")
    out = texts.join(each, (F.col("block") == F.col("b")) & (F.col("place") == F.col("p")))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))


def op2(docs: DataFrame) -> DataFrame:
    """Learns from the rows whose crc32(doc_id) mod 7 is not 2, and scores every row."""
    rows = gathered(occurrences(docs, held_out=bucket_of(F.col("doc_id").cast("string"), 7) == 2))
    return score(rows, fit(rows))
