"""SimHash near-duplicates: exact links at a small Hamming distance by vantage-point trees.

A fingerprint has 64 bits over the text's word shingles. Two fingerprints that
differ in at most `radius` bits agree on at least `blocks - radius` of `blocks` bit
blocks. For each choice of that many blocks there is a tree over the Hamming
distance restricted to those blocks, in which linked fingerprints are at distance
0: their distances to any vantage point are then equal, so by the triangle bound a
branch with another distance can't hold a link. The upper levels of every tree are
Spark columns (the distances to the tree's vantage points), and a leaf is a shard of
a shuffle. Within a shard, the members are ordered by their full distance to a
vantage point of the shard, and a member is held only against those whose distance
differs by at most `radius`.

A shard gives links that span its components, at most one less than its members, so
a dense group doesn't make all its pairs. Copies share one fingerprint and enter
once. Components come from randomised contraction, by joins and minima.

`keep_similar` is for a Jaccard similarity of word shingles, at which fingerprints differ
in many bits. It takes longer fingerprints. The upper levels of its trees measure the distance to
a vantage point on one sampled bit each, so that a pair in a shard has the restricted distance 0 again. Below,
a shard that is more than a leaf goes on as a vantage-point tree over the whole distance (`near_pairs`): branches whose
distances to a vantage point differ by more than the radius never meet. Pairs that are near by a wide
fingerprint too are linked if their shingles reach the similarity. So no link is
below it; `recall` gives the share of the pairs at a similarity that meet in a shard.

Defined cases: a null or empty text has fingerprint 0, linked like any other; a very long
text is hashed whole, in parts that bound memory;
repeated rows get the same component; an empty table gives an empty result; a null
id is larger than any id. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import cut, drop, text_or_empty

RADIUS = 4


def fingerprint(text: bytes, width: int = 4, seed: int = 42) -> int:
    """The 64 bits of a UTF-8 text: a bit is on if it is in over half the hashes of its shingles.

    bytes.lower and bytes.split act on A-Z and on the ASCII separators only.
    """
    w = text.lower().split()
    if not w:
        return 0
    if len(w) <= width:
        return xxhash.xxh64_intdigest(b" ".join(w), seed)
    flat = b" ".join(w)
    ends = list(accumulate(len(x) + 1 for x in w))
    starts = [0, *ends[: len(w) - width]]
    of = xxhash.xxh64_intdigest
    h = np.array([of(flat[s : e - 1], seed) for s, e in zip(starts, ends[width - 1 :], strict=True)], dtype="<u8")
    on = np.zeros(64, np.int64)
    for k in range(0, len(h), 1 << 16):  # bounds memory for very long texts
        part = h[k : k + (1 << 16)]
        on += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * on > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: Column | str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """(doc_id, fp long): fp holds the unsigned fingerprint's bits."""
    src = docs.select(text_or_empty(text_col).cast("binary").alias("t"), (F.col(id_col) if isinstance(id_col, str) else id_col).alias("doc_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t, width) for t in b.column(0).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, fp long")


def _vantage(*what: int) -> int:
    return xxhash.xxh64_intdigest(repr(what)) & (2**63 - 1)


def shards(fps: DataFrame, radius: int = RADIUS, blocks: int = 6, levels: int = 8) -> DataFrame:
    """(shard, fp): each fingerprint's leaf in every tree. A leaf is numbered by its tree and its path of distances."""
    edges = [64 * k // blocks for k in range(blocks + 1)]
    masks = [sum((1 << edges[k + 1]) - (1 << edges[k]) for k in kept) for kept in combinations(range(blocks), blocks - radius)]
    signed = lambda x: F.lit(x - (1 << 64) if x >> 63 else x)
    leaves = []
    for t, mask in enumerate(masks):
        path = F.lit(t).cast("long")
        for k in range(levels):
            path = path * 64 + F.bit_count(F.col("fp").bitwiseXOR(F.lit(_vantage(t, k))).bitwiseAND(signed(mask)))
        leaves.append(path)
    return fps.select("fp", F.explode(F.array(*leaves)).alias("shard"))


def _large(fp: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that span the components of one shard: breadth first, over members by distance to a vantage point."""
    d = np.bitwise_count(fp ^ fp[0]).astype(np.int64)
    order = np.argsort(d, kind="stable")
    fp, d = fp[order], d[order]
    free, out = np.ones(len(fp), bool), []
    for first in range(len(fp)):
        if not free[first]:
            continue
        free[first] = False
        queue = [first]
        while queue:
            x = queue.pop()
            lo, hi = np.searchsorted(d, (d[x] - radius, d[x] + radius + 1))
            near = np.flatnonzero(free[lo:hi]) + lo
            near = near[np.bitwise_count(fp[near] ^ fp[x]) <= radius]
            free[near] = False
            queue += near.tolist()
            out += [(int(fp[x]), int(y)) for y in fp[near]]
    return out


def links(fps: DataFrame, radius: int = RADIUS, blocks: int = 6, levels: int = 8, small: int = 6) -> DataFrame:
    """(a, b) among distinct fingerprints: links that connect whatever is linked, with no link beyond `radius`."""

    def emit(shard: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        cut_at = np.flatnonzero(np.diff(shard)) + 1
        start = np.concatenate([[0], cut_at])
        many = np.diff(np.concatenate([start, [len(shard)]]))
        left, right = [], []
        own = np.repeat(many, many)
        for k in range(1, small):
            i = np.flatnonzero((own[:-k] <= small) & (shard[:-k] == shard[k:])) if len(shard) > k else np.empty(0, np.int64)
            i = i[np.bitwise_count(fp[i] ^ fp[i + k]) <= radius]
            left.append(fp[i])
            right.append(fp[i + k])
        for s, n in zip(start[many > small], many[many > small], strict=True):
            if found := _large(fp[s : s + n], radius):
                a = np.array(found, dtype=np.uint64)
                left.append(a[:, 0])
                right.append(a[:, 1])
        a, b = np.concatenate(left), np.concatenate(right)
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [np.empty(0, np.int64), np.empty(0, np.uint64)]
        for b in batches:
            shard = np.concatenate([kept[0], b.column(0).to_numpy(zero_copy_only=False)])
            fp = np.concatenate([kept[1], b.column(1).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)])
            if not len(shard):
                continue
            last = int(np.searchsorted(shard, shard[-1]))  # the last shard may go on
            if last:
                yield from emit(shard[:last], fp[:last])
            kept = [shard[last:], fp[last:]]
        if len(kept[0]):
            yield from emit(*kept)

    dealt = shards(fps, radius, blocks, levels).select("shard", "fp").repartition("shard").sortWithinPartitions("shard", "fp")
    return dealt.mapInArrow(run, "a long, b long").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b); nodes are in one component if and only if they share a root.

    Each round, every node joins the neighbour (or itself) that is first in a
    pseudo-random order of the round, and the edges are contracted. A round leaves a
    fraction of the nodes, so rounds grow with the logarithm of the largest component.
    """
    edges, steps = cut(edges), []
    while not edges.isEmpty():
        salt = len(steps)
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
        order = lambda c, s=salt: F.struct(F.xxhash64(F.lit(s), c), F.col(c).alias("v"))
        best = both.groupBy("u").agg(F.min(order("v")).alias("m")).select("u", F.least("m", order("u"))["v"].alias("p"))
        steps.append(best := cut(best))
        moved = edges.join(best, F.col("a") == F.col("u")).select(F.col("p").alias("a"), "b")
        moved = moved.join(best, F.col("b") == F.col("u")).select("a", F.col("p").alias("b")).filter("a <> b")
        edges = cut(moved.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    if not steps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = steps[0].select(F.col("u").alias("node"), F.col("p").alias("root"))
    for s in steps[1:]:
        out = out.join(s, F.col("root") == F.col("u"), "left").select("node", F.coalesce("p", "root").alias("root"))
    return out


def cluster(docs: DataFrame, id_col: Column | str = "doc_id", text_col: str = "text", width: int = 4, radius: int = RADIUS, **how: int) -> DataFrame:
    """(doc_id, fp, component_id): the smallest id in reach. `id_col` may be any orderable expression."""
    fps = cut(fingerprints(docs, id_col, text_col, width))
    each = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = cut(components(links(each.select("fp"), radius, **how)))
    linked = each.join(roots, each.fp == roots.node).select("fp", "root", "first")
    least = linked.groupBy("root").agg(F.min("first").alias("least"))
    least = linked.join(least, "root").select(F.col("fp").alias("lfp"), "least")
    # a table of its own: a join whose sides are plain exchanges is split where one fingerprint has very many rows
    of = cut(each.join(least, F.col("fp") == F.col("lfp"), "left").select(F.col("fp").alias("cfp"), F.coalesce("least", "first").alias("component_id")))
    return fps.join(of, F.col("fp") == F.col("cfp")).select("doc_id", "fp", "component_id")


def row_key(id_col: str, text_col: str) -> Column:
    """Orders rows by id, nulls last, and then by the text's hash."""
    return F.struct(F.col(id_col).isNull().alias("n"), F.col(id_col).alias("d"), F.xxhash64(text_col).alias("t"))


def without(docs: DataFrame, key: Column, rows: DataFrame) -> DataFrame:
    """`docs` but for the rows whose key isn't kept, and one of each repeated row. `rows`: (k, kept boolean), a row per row of `docs`.

    Only the keys to be dropped and the repeated ones meet the documents.
    """
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__wl_row"), key.alias("__wl_k"))
    each = rows.groupBy("k").agg(F.min("kept").alias("kept"), F.count(F.lit(1)).alias("many")).filter("many > 1 OR NOT kept")
    each = each.select(F.col("k.d").alias("__wl_d"), F.col("k.t").alias("__wl_t"), "kept")
    same = lambda k: (F.col("__wl_k.t") == F.col("__wl_t")) & F.col("__wl_k.d").eqNullSafe(F.col("__wl_d"))
    rest = own.join(each.drop("kept"), same(each), "left_anti")
    again = own.join(each.filter("kept").drop("kept"), same(each), "left_semi").dropDuplicates(["__wl_k"])
    return rest.union(again).select("__wl_row.*")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, radius: int = RADIUS, **how: int) -> DataFrame:
    """One row of each component, that with the smallest (id, text hash); columns as in `docs`."""
    key = row_key(id_col, text_col)
    found = cluster(docs, key, text_col, width, radius, **how)
    return without(docs, key, found.select(F.col("doc_id").alias("k"), (F.col("doc_id") == F.col("component_id")).alias("kept")))


# ---- by similarity

#: The least similarity, as a fraction.
SHARE = (4, 5)
#: Bits of a long fingerprint, shards that each is dealt to, and bits that a shard's members have in common.
BITS, TABLES, SAMPLED = 128, 60, 14
#: Bits in which texts of the similarity may differ: the mean at 0.8 is 19.4, the standard deviation 4.1.
FAR = 30
#: Bits of a wide fingerprint, and in how many texts of the similarity may differ: the mean at 0.8 is 621, the standard deviation 23.
WIDE, WIDE_FAR = 4096, 690
#: Pairs of different roots that a leaf of a shard's tree has at most.
LEAF = 1 << 14
#: Rounds in which a shard's members are held against one of them only, and the shards of each.
STARS, STAR_TABLES = 2, 8


def shingles(text: bytes, width: int = 5, seed: int = 42) -> np.ndarray:
    """Distinct 64-bit hashes of a text's runs of `width` words, ascending; of fewer words: of the whole."""
    w = text.lower().split()
    if not w:
        return np.empty(0, np.uint64)
    flat, of = b" ".join(w), xxhash.xxh64_intdigest
    ends = list(accumulate(len(x) + 1 for x in w))
    starts = [0, *ends[: max(0, len(w) - width)]]
    ends = ends[width - 1 :] or ends[-1:]
    return np.unique(np.fromiter((of(flat[s : e - 1], seed) for s, e in zip(starts, ends, strict=True)), np.uint64, len(starts)))


def long_fingerprint(s: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Words of 64 bits over a set of shingles: the hashes, and what mixing makes of them for each further word."""
    out = np.zeros(bits // 64, np.uint64)
    for k in range(len(out) if len(s) else 0):
        on = np.zeros(64, np.int64)
        for i in range(0, len(s), 1 << 16):
            h = s[i : i + (1 << 16)] + np.uint64(k * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
            if k:
                h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
                h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
                h ^= h >> np.uint64(31)
            on += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[k] = np.packbits(2 * on > len(s), bitorder="little").view("<u8")[0]
    return out


def samples(tables: int = TABLES, sampled: int = SAMPLED, bits: int = BITS) -> np.ndarray:
    """The places of the bits that each table's shards have in common."""
    return np.array([np.argsort([_vantage(t, k) for k in range(bits)])[:sampled] for t in range(tables)])


def recall(differing: int, tables: int = TABLES, sampled: int = SAMPLED, bits: int = BITS) -> float:
    """The share of pairs with so many differing bits that meet in a shard."""
    hit = np.prod([max(0, bits - differing - i) / (bits - i) for i in range(sampled)])
    return float(1 - (1 - hit) ** tables)


def dealt(each: DataFrame, tables: range) -> DataFrame:
    """(s, h, n, f0, f1, root): every set's shard in each tree: its distances to the tree's vantage points, on a bit each."""
    places = samples()[tables.start : tables.stop]
    vantage = np.array([[_vantage(t, k, 0) & 1 for k in range(SAMPLED)] for t in tables], np.uint8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = 1 << np.arange(places.shape[1])
        for b in batches:
            fp = np.stack([b.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (2, 3)], axis=1)
            on = np.unpackbits(np.ascontiguousarray(fp).view(np.uint8).reshape(len(fp), -1), axis=1, bitorder="little")
            for t, at in enumerate(places):
                s = (tables.start + t) << SAMPLED | ((on[:, at] ^ vantage[t]) * weights).sum(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(s), *b.columns], ["s", *b.schema.names])

    return each.select("h", "n", "f0", "f1", "root").mapInArrow(run, "s long, h long, n int, f0 long, f1 long, root long")


def _may(a: str, b: str, share: tuple[int, int]) -> Column:
    """Whether two sets may reach the share: by their roots, sizes and fingerprints."""
    x, y = (lambda c: F.col(a + c)), (lambda c: F.col(b + c))
    far = F.bit_count(x("f0").bitwiseXOR(y("f0"))) + F.bit_count(x("f1").bitwiseXOR(y("f1")))
    return (x("root") != y("root")) & (F.least(x("n"), y("n")) * share[1] >= F.greatest(x("n"), y("n")) * share[0]) & (far <= FAR)


def star_pairs(rows: DataFrame, salt: int, share: tuple[int, int]) -> DataFrame:
    """(a, b): members of a shard with one of them, the first in a pseudo-random order."""
    one = F.struct(F.xxhash64(F.lit(salt), "h").alias("o"), "h", "n", "f0", "f1", "root")
    hubs = rows.groupBy("s").agg(F.min(one).alias("hub"), F.count(F.lit(1)).alias("many")).filter("many > 1").select(F.col("s").alias("hs"), "hub")
    met = rows.select("s", F.struct("h", "n", "f0", "f1", "root").alias("x")).join(hubs, F.col("s") == F.col("hs")).filter(_may("x.", "hub.", share))
    return met.select(F.least("x.h", "hub.h").alias("a"), F.greatest("x.h", "hub.h").alias("b")).distinct()


def _ranges(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, place) for each place from lo to hi of each row."""
    many = np.maximum(hi - lo, 0)
    row = np.repeat(np.arange(len(lo)), many)
    return row, np.arange(len(row)) + np.repeat(lo - (np.cumsum(many) - many), many)


def near_pairs(f: np.ndarray, root: np.ndarray, radius: int, leaf: int = LEAF) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) of rows whose roots differ, among them all within `radius` bits, each once: a vantage-point tree joined with itself.

    A node is two sets of rows (or one, with itself). One is split by the distance to a vantage
    point of its own, at a gap wider than the radius or at the median; by the triangle bound, each part meets only rows that are at most `radius` nearer or farther.
    A node is a leaf when few pairs of different roots are left. `root` ascends.
    """

    def distance(rows: np.ndarray, v: int) -> np.ndarray:
        return np.bitwise_count(f[rows] ^ f[v]).sum(axis=1, dtype=np.int64)

    def within(d: np.ndarray, of: np.ndarray) -> np.ndarray:
        return (d >= of.min() - radius) & (d <= of.max() + radius)

    stack: list[tuple[np.ndarray, np.ndarray | None]] = [(np.arange(len(f)), None)]
    while stack:
        a, b = stack.pop()
        if not len(a) or b is not None and not len(b):
            continue
        if b is None:
            after = np.searchsorted(root[a], root[a], side="right")
            many = int((len(a) - after).sum())
        else:
            if len(a) < len(b):
                a, b = b, a
            before, after = (np.searchsorted(root[b], root[a], side=x) for x in ("left", "right"))
            many = int((len(b) - after + before).sum())
        if many <= leaf or len(a) < 2:
            if many:
                i, j = _ranges(after, np.full(len(a), len(a if b is None else b)))
                if b is None:
                    yield a[i], a[j]
                else:
                    k, m = _ranges(np.zeros(len(a), np.int64), before)
                    yield np.concatenate([a[i], a[k]]), np.concatenate([b[j], b[m]])
            continue
        v = int(a[_vantage(len(a), int(a[0])) % len(a)])
        d = distance(a, v)
        up = np.sort(d)
        k = int(np.argmax(np.diff(up)))
        gap = up[k + 1] - up[k] > radius and min(k + 1, len(a) - k - 1) ** 2 >= len(a)
        inner = d <= (up[k] if gap else up[len(a) // 2])
        if inner.all():
            inner = d < d.max()
        if not inner.any():  # all as far: no bound tells them apart
            inner = np.arange(len(a)) < len(a) // 2
        near, far = a[inner], a[~inner]
        if b is None:
            stack += [(near, None), (far, None), (near[within(d[inner], d[~inner])], far[within(d[~inner], d[inner])])]
        else:
            e = distance(b, v)
            stack += [(near, b[within(e, d[inner])]), (far, b[within(e, d[~inner])])]


def met(rows: DataFrame, share: tuple[int, int], what: str) -> DataFrame:
    """What members of a shard whose roots differ make of each other, if they may reach the share.

    `what`: `some` gives (a, b), the shards and hashes of those that meet any; `nearest` gives
    (a, b), the hashes of each and its nearest; `all` gives the hashes of every pair.
    A column `wide` of `rows`, a fingerprint of WIDE bits, is held against WIDE_FAR.
    """
    wide = "wide" in rows.columns

    def pairs(s: np.ndarray, h: np.ndarray, n: np.ndarray, f0: np.ndarray, f1: np.ndarray, root: np.ndarray, *w: np.ndarray) -> Iterator[pa.RecordBatch]:
        # rows are in the order of (s, root); a row meets those behind its root's, up to its shard's end
        new = np.concatenate([[True], s[1:] != s[:-1]])
        ends = np.append(np.flatnonzero(new), len(s))[np.cumsum(new)]
        new |= np.concatenate([[True], root[1:] != root[:-1]])
        behind = np.append(np.flatnonzero(new), len(s))[np.cumsum(new)]
        many = ends - behind
        of = np.cumsum(np.concatenate([[True], s[1:] != s[:-1]])) - 1
        long = np.bincount(of, weights=many) > LEAF
        many = np.where(long[of], 0, many)
        upto = np.cumsum(many)
        least, other = np.full(len(s), np.iinfo(np.int64).max), np.full(len(s), -1)

        def nearer(i: np.ndarray, j: np.ndarray, d: np.ndarray) -> None:
            o = np.lexsort((d, i))
            o = o[np.diff(i[o], prepend=-1) > 0]
            o = o[d[o] < least[i[o]]]
            least[i[o]], other[i[o]] = d[o], j[o]

        def batch(a: np.ndarray, b: np.ndarray) -> Iterator[pa.RecordBatch]:
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        def leaves() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            lo = 0
            while lo < len(s):  # shards that are leaves, many at once
                hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + (1 << 20), side="right")))
                i, j = _ranges(behind[lo:hi], behind[lo:hi] + many[lo:hi])
                yield i + lo, j
                lo = hi
            for k in np.flatnonzero(long):
                lo, hi = np.searchsorted(of, (k, k + 1))
                for i, j in near_pairs(np.stack([f0[lo:hi], f1[lo:hi]], axis=1), root[lo:hi], FAR):
                    yield i + lo, j + lo

        for i, j in leaves():
            d = np.bitwise_count(f0[i] ^ f0[j]).astype(np.int64) + np.bitwise_count(f1[i] ^ f1[j])
            use = d <= FAR
            i, j, d = i[use], j[use], d[use]
            use = np.minimum(n[i], n[j]).astype(np.int64) * share[1] >= np.maximum(n[i], n[j]).astype(np.int64) * share[0]
            i, j, d = i[use], j[use], d[use]
            if w:
                for k in range(0, len(i), 1 << 14):  # bounds memory for dense shards
                    d[k : k + (1 << 14)] = np.bitwise_count(w[0][i[k : k + (1 << 14)]] ^ w[0][j[k : k + (1 << 14)]]).sum(axis=1)
                use = d <= WIDE_FAR
                i, j, d = i[use], j[use], d[use]
            if what == "all":
                yield from batch(np.minimum(h[i], h[j]), np.maximum(h[i], h[j]))
            elif len(i):
                nearer(i, j, d)
                nearer(j, i, d)
        found = np.flatnonzero(other >= 0)
        if what == "some":
            yield from batch(s[found], h[found])
        elif what == "nearest":
            yield from batch(np.minimum(h[found], h[other[found]]), np.maximum(h[found], h[other[found]]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[list[np.ndarray]] = []
        for b in batches:
            if not b.num_rows:
                continue
            now = [c.to_numpy(zero_copy_only=False) for c in b.columns[:6]]
            now[3:5] = [x.astype(np.int64).view(np.uint64) for x in now[3:5]]
            if wide:
                now.append(np.frombuffer(b"".join(b.column(6).to_pylist()), np.uint64).reshape(b.num_rows, -1))
            s = now[0]
            last = int(np.searchsorted(s, s[-1]))  # the last shard may go on
            if kept and kept[0][0][0] != s[0] or last:
                own = [x[:last] for x in now] if kept and kept[0][0][0] == s[0] else None
                if own is not None:
                    kept.append(own)
                if kept:
                    yield from pairs(*[np.concatenate(x) for x in zip(*kept, strict=True)])
                if own is None and last:
                    yield from pairs(*[x[:last] for x in now])
                kept = []
            kept.append([x[last:] for x in now])
        if kept:
            yield from pairs(*[np.concatenate(x) for x in zip(*kept, strict=True)])

    columns = ["s", "h", "n", "f0", "f1", "root", *["wide"] * wide]
    return rows.select(*columns).repartition("s").sortWithinPartitions("s", "root").mapInArrow(run, "a long, b long").distinct()


def sets(few: DataFrame, docs: DataFrame, key: Column, text_col: str, first: DataFrame, width: int, wide: bool = False) -> DataFrame:
    """(h, n, f0, f1, shingles, and their fingerprint of WIDE bits if asked for) of the hashes in `few`. `first`: (h, first), the key of a text for each hash."""
    few = few.distinct().join(first.select("h", "n", "f0", "f1", F.col("first").alias("k")), "h")
    texts = docs.select(key.alias("__wl_k"), text_or_empty(text_col).cast("binary").alias("t"))
    texts = texts.join(few, (F.col("__wl_k.t") == F.col("k.t")) & F.col("__wl_k.d").eqNullSafe(F.col("k.d"))).select("t", "h", "n", "f0", "f1")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                s = shingles(b.column(0)[i].as_py(), width)
                own = pa.ListArray.from_arrays(pa.array([0, len(s)], pa.int32()), pa.array(s.view(np.int64)))
                more = [pa.array([long_fingerprint(s, WIDE).tobytes()], pa.binary())] if wide else []
                yield pa.RecordBatch.from_arrays([*[c.slice(i, 1) for c in b.columns[1:]], own, *more], names)

    names = ["h", "n", "f0", "f1", "shingles", *["wide"] * wide]
    return cut(texts.mapInArrow(run, "h long, n int, f0 long, f1 long, shingles array<bigint>" + ", wide binary" * wide).dropDuplicates(["h"]))


def verified(pairs: DataFrame, whole: DataFrame, share: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) whose shingles in `whole` reach the share."""
    both = F.size(F.array_intersect("x", "y")).cast("long")
    one, two = (whole.select(F.col("h").alias(p), F.col("shingles").alias(x)) for p, x in (("a", "x"), ("b", "y")))
    return cut(pairs.join(two, "b").join(one, "a").filter(both * (share[0] + share[1]) >= share[0] * (F.size("x") + F.size("y"))).select("a", "b"))


def similar(docs: DataFrame, key: Column, text_col: str = "text", width: int = 5, share: tuple[int, int] = SHARE) -> DataFrame:
    """(k, kept): the key of every row, and whether it is the smallest of those that links of the similarity connect.

    First the members of a shard are held against one of them, which leaves few roots of a
    dense group. Of what is left, those that may reach the share with another root get a
    wide fingerprint; each is linked with its nearest, and then all that still may be linked are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i in range(b.num_rows):
                s = shingles(b.column(0)[i].as_py(), width)
                out.append((xxhash.xxh64_intdigest(s.tobytes()), len(s), *long_fingerprint(s).tolist()))
            x = np.array(out, np.uint64).reshape(-1, 4)
            h, n, f0, f1 = (x[:, k].copy().view(np.int64) for k in range(4))
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(h), pa.array(n.astype(np.int32)), pa.array(f0), pa.array(f1)], ["k", "h", "n", "f0", "f1"])

    src = docs.select(text_or_empty(text_col).cast("binary").alias("t"), key.alias("k"))
    base = cut(src.mapInArrow(run, f"k {src.schema['k'].dataType.simpleString()}, h long, n int, f0 long, f1 long"))
    each = cut(base.groupBy("h").agg(F.min("k").alias("first"), *[F.max(c).alias(c) for c in ("n", "f0", "f1")]))
    roots = None

    def rooted(rows: DataFrame) -> DataFrame:
        if roots is None:
            return rows.withColumn("root", F.col("h"))
        return rows.join(roots, F.col("h") == F.col("node"), "left").withColumn("root", F.coalesce("root", "h")).drop("node")

    def linked(found: DataFrame) -> None:
        nonlocal roots
        if roots is None:
            roots = cut(components(found))
        elif not found.isEmpty():
            for c in "ab":
                found = found.join(roots, F.col(c) == F.col("node"), "left").withColumn(c, F.coalesce("root", c)).drop("node", "root")
            more = cut(components(found.distinct()))
            now = more.select(F.col("node").alias("was"), F.col("root").alias("now"))
            moved = roots.join(now, F.col("root") == F.col("was"), "left").select("node", F.coalesce("now", "root").alias("root"))
            roots = cut(moved.union(more.join(roots, "node", "left_anti")))

    for k in range(STARS):
        pairs = cut(star_pairs(dealt(rooted(each), range(k * STAR_TABLES, (k + 1) * STAR_TABLES)), k, share))
        whole = sets(pairs.select(F.explode(F.array("a", "b")).alias("h")), docs, key, text_col, each, width)
        linked(verified(pairs, whole, share))
        drop(pairs, whole)
    some = cut(met(dealt(rooted(each), range(TABLES)), share, "some").select(F.col("a").alias("s"), F.col("b").alias("h")))
    whole = sets(some.select("h"), docs, key, text_col, each, width, wide=True)
    rows = cut(some.join(whole.drop("shingles"), "h"))
    for what in ("nearest", "all"):
        pairs = cut(met(rooted(rows), share, what))
        linked(verified(pairs, whole, share))
        drop(pairs)
    drop(some, whole, rows)
    least = each.join(roots, each.h == roots.node, "left").select("h", "first", F.coalesce("root", "h").alias("root"))
    keep = least.groupBy("root").agg(F.min("first").alias("least"))
    of = cut(least.join(keep, "root").select(F.col("h").alias("kh"), "least"))
    return base.join(of, F.col("h") == F.col("kh")).select("k", (F.col("k") == F.col("least")).alias("kept"))


def keep_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, share: tuple[int, int] = SHARE) -> DataFrame:
    """One row of each component of texts whose shingles have the similarity, that with the smallest (id, text hash); columns as in `docs`."""
    key = row_key(id_col, text_col)
    return without(docs, key, cut(similar(docs, key, text_col, width, share)))


def op9(docs: DataFrame) -> DataFrame:
    return cluster(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
