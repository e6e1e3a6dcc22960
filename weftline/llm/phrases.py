"""Phrase collocations from vertical positional inverted lists.

A shard is the texts of about `shard_words` words of one task; its words stand at positions, and
no two pieces of text touch. A list holds the sorted positions at which a word, or a phrase, starts
in a shard; the lengths of its lists add up to its exact frequency.

1. Words: each shard is inverted into lists. Words of `least` occurrences or more get an id.
2. Extension: a frequent phrase's positions, moved by its length, are merge-joined with the
   positions of the frequent words of the shard. The lengths of the lists that this gives are added
   up over the shards; phrases of `least` occurrences or more go back to the shards that have
   them, and are extended in turn, where what follows their first word is frequent too.
3. Scores: every phrase is cut in two at each place and its lowest score counts. A phrase
   inside a longer candidate that is half as frequent or more goes. The best of each language are
   found in parts first.

A frequent word or phrase has one list for each shard, so none is gathered in one place.

Defined cases: a null language is `und`; a null or empty text has no word; a very long text is taken
whole; repeated rows count again; ties go by score, frequency and phrase in the order of bytes; an
empty table gives an empty result; other columns of the input are not read.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import cut, drop, text_or_empty

SHARD_WORDS = 2_000_000
#: Salts of the first step of each language's best phrases.
PARTS = 64
#: A to Z in lower case, what ends a piece as a line end, what ends a word as a blank.
PLAIN = bytes.maketrans(string.ascii_uppercase.encode() + b".,;:!?\x0B\x0C\x0D\x09", string.ascii_lowercase.encode() + b"\n" * 9 + b" ")


def _invert(shard_words: int):
    """(lang, body) -> a list for each word of a language in a shard."""

    def invert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, langs, n = TaskContext.get().partitionId() << 20, {}, 0
        for batch in batches:
            for lang, body in zip(batch.column("lang").to_pylist(), batch.column("body"), strict=True):
                text = body.as_py().translate(PLAIN)
                langs.setdefault(lang, []).append(text)
                n += text.count(b" ") + text.count(b"\n") + 1
                if n >= shard_words:
                    yield from lists(shard, langs)
                    shard, langs, n = shard + 1, {}, 0
        yield from lists(shard, langs)

    def lists(shard: int, langs: dict[str, list[bytes]]) -> Iterator[pa.RecordBatch]:
        base = 0
        for lang, texts in langs.items():
            words, positions = numbered(b"\n".join(texts))
            if not len(words):
                continue
            positions += base
            base = int(positions[-1]) + 2
            words = words.dictionary_encode()
            codes, vocabulary = words.indices.to_numpy(), words.dictionary.cast(pa.string())
            order = np.argsort(codes, kind="stable")
            ends = np.r_[0, np.cumsum(np.bincount(codes, minlength=len(vocabulary)))].astype(np.int32)
            found = pa.ListArray.from_arrays(pa.array(ends), pa.array(positions[order].astype(np.int32)))
            for lo in range(0, len(vocabulary), 50_000):
                n = len(vocabulary[lo : lo + 50_000])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, shard)), pa.array([lang] * n, pa.string()), vocabulary[lo : lo + n], found[lo : lo + n]], names=["shard", "lang", "word", "positions"])

    return invert


def numbered(text: bytes) -> tuple[pa.Array, np.ndarray]:
    """The words of a text of words, blanks and line ends, and their positions, with a gap at line ends."""
    b = np.frombuffer(text, np.uint8)
    space = np.ones(len(b) + 2, bool)
    space[1:-1] = (b == 32) | (b == 10)
    first, end = np.flatnonzero(space[:-2] & ~space[1:-1]), np.flatnonzero(~space[:-1] & space[1:])
    line = np.searchsorted(np.flatnonzero(b == 10), first)
    positions = np.arange(len(first)) + np.cumsum(np.diff(line, prepend=line[:1]) > 0)
    offsets = np.r_[0, np.cumsum(end - first)].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(b[~space[1:-1]])]), positions


def merge_join(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places in two sorted arrays at which they have the same number."""
    if not len(right):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.searchsorted(right, left)
    at[at == len(right)] = 0
    same = np.flatnonzero(right[at] == left)
    return same, at[same]


def extended(ids: np.ndarray, lengths: np.ndarray, positions: np.ndarray, phrases: np.ndarray | None, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids of phrases of k + 1 words, how often each occurs) of a shard.

    ids, lengths, positions: the frequent words' lists. phrases: the frequent phrases of k words, a row of ids each (k of 1: all words).
    """
    order = np.argsort(ids)
    code = np.empty(len(ids), np.int64)
    code[order] = np.arange(len(ids))
    by_position = np.argsort(positions)
    at, word = positions[by_position].astype(np.int64), np.repeat(code, lengths)[by_position]
    sorted_ids = ids[order]
    rows = np.arange(len(at))[:, None]  # for each phrase met, the places of its words in `at`
    for width in range(1, k + 1):
        if width == k and phrases is not None:
            rows = rows[_among(word[rows], np.searchsorted(sorted_ids, phrases), len(ids))]
        if width == k and k > 1:  # what follows the first word is frequent too
            starts = at[rows[:, 0]]
            here, there = merge_join(starts + 1, starts)
            rows = np.c_[rows[here], rows[there, -1]]
        else:
            here, there = merge_join(at[rows[:, -1]] + 1, at)
            rows = np.c_[rows[here], there]
    key = np.zeros(len(rows), np.int64)
    first = np.arange(len(rows))
    for j in range(k + 1):
        _, first, key, n = np.unique(key * len(ids) + word[rows[:, j]], return_index=True, return_inverse=True, return_counts=True)
    return (sorted_ids[word[rows[first]]], n) if len(rows) else (np.zeros((0, k + 1), np.int64), np.zeros(0, np.int64))


def _among(rows: np.ndarray, wanted: np.ndarray, base: int) -> np.ndarray:
    """Which of `rows` are rows of `wanted`, too; numbers are below `base`."""
    key = np.zeros(len(rows) + len(wanted), np.int64)
    for j in range(rows.shape[1]):
        _, key = np.unique(key * base + np.r_[rows[:, j], wanted[:, j]], return_inverse=True)
    return np.isin(key[: len(rows)], key[len(rows) :])


def _extend(k: int):
    """Rows of a shard one after another: a word's id and positions, or packed ids of frequent phrases -> a row for each phrase of k + 1 words."""
    names = [f"id{i}" for i in range(1, k + 2)]

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, parts = None, []
        for batch in batches:
            shards = batch.column("shard").to_numpy()
            cuts = [0, *(np.flatnonzero(shards[1:] != shards[:-1]) + 1).tolist(), len(shards)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if lo < hi:
                    if shards[lo] != shard:
                        yield from whole(shard, parts)
                        shard, parts = shards[lo], []
                    parts.append(batch.slice(lo, hi - lo))
        yield from whole(shard, parts)

    def whole(shard: int, parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not parts:
            return
        table = pa.Table.from_batches(parts)
        words = table.filter(pa.compute.is_valid(table["positions"])).combine_chunks()
        phrases = None
        if k > 1:
            packs = table.filter(pa.compute.is_null(table["positions"]))["pack"].to_pylist()
            phrases = np.frombuffer(b"".join(packs), np.int64).reshape(-1, k)
        lists = words["positions"].combine_chunks()
        lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
        out, n = extended(words["id"].to_numpy(), pa.compute.list_value_length(lists).to_numpy(), lists.flatten().to_numpy(), phrases, k)
        for lo in range(0, len(n), 200_000):
            some = out[lo : lo + 200_000]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), shard)), *[pa.array(some[:, j]) for j in range(k + 1)], pa.array(n[lo : lo + 200_000].astype(np.int32))], names=["shard", *names, "n"])

    return extend


#: Rows of phrases that are packed at once.
PACKED = 2_000_000


def _pack(k: int):
    """(shard, id1.., a, lead) -> the lead rows, and a row for each shard with the ids of its phrases in one binary value."""
    ids = _ids(k)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += len(batch)
            if n >= PACKED:
                yield from packed(held)
                held, n = [], 0
        yield from packed(held)

    def packed(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not held:
            return
        table = pa.Table.from_batches(held)
        leads = table.filter(table["lead"])
        shards = table["shard"].to_numpy()
        order = np.argsort(shards, kind="stable")
        rows = np.stack([table[c].to_numpy()[order] for c in ids], axis=1)
        own, starts = np.unique(shards[order], return_index=True)
        packs = [rows[lo:hi].tobytes() for lo, hi in zip(starts, [*starts[1:], len(rows)], strict=True)]
        none = pa.nulls(len(own), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(own), *[none] * (k + 1), pa.array(packs, pa.binary())], names=["shard", *ids, "a", "pack"])
        yield from leads.select(["shard", *ids, "a"]).append_column("pack", pa.nulls(len(leads), pa.binary())).to_batches()

    return pack


def _extension(lists: DataFrame, known: DataFrame | None, k: int, least: int, again: bool) -> DataFrame:
    """Phrases of k + 1 words with `least` occurrences or more: rows of (id1.., a), and, if they are to be extended `again`, the ids that each shard has, packed."""
    rows = lists.select("shard", "id", "positions", F.lit(None).cast("binary").alias("pack"))
    if known is not None:
        rows = rows.unionByName(known.select("shard", F.lit(None).cast("long").alias("id"), F.lit(None).cast("array<int>").alias("positions"), "pack"))
    ids = _ids(k + 1)
    rows = rows.repartition("shard").sortWithinPartitions("shard")
    met = rows.mapInArrow(_extend(k), ", ".join(["shard long", *[f"{c} long" for c in ids], "n int"]))
    if not again:
        return met.groupBy(*ids).agg(F.sum("n").alias("a")).filter(F.col("a") >= least)
    # a phrase has a row for each shard at most
    each = Window.partitionBy(*ids)
    met = met.withColumns({"a": F.sum("n").over(each.orderBy("shard").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), "lead": F.row_number().over(each.orderBy("shard")) == 1})
    met = met.filter(F.col("a") >= least).drop("n")
    return met.mapInArrow(_pack(k + 1), ", ".join(["shard long", *[f"{c} long" for c in ids], "a long", "pack binary"]))


def _ids(k: int) -> list[str]:
    return [f"id{i}" for i in range(1, k + 1)]


def scored(k: int, phrases: dict[int, DataFrame]) -> DataFrame:
    """Phrases of k words with text, lang and the struct `best` of score, cut, l and r; phrases[1] has id, lang, word, a."""
    out, cuts = phrases[k], []
    for i in range(1, k + 1):
        w = phrases[1].select(F.col("id").alias(f"id{i}"), F.col("word").alias(f"w{i}"), F.col("a").alias(f"a{i}"), *([F.col("lang")] if i == 1 else []))
        out = out.join(w, f"id{i}")
    for j in range(1, k):
        l, r = F.col("a1"), F.col(f"a{k}")
        if j > 1:
            out = out.join(phrases[j].select(*_ids(j), F.col("a").alias(f"l{j}")), _ids(j))
            l = F.col(f"l{j}")
        if k - j > 1:
            out = out.join(phrases[k - j].select(*[F.col(f"id{i}").alias(f"id{i + j}") for i in range(1, k - j + 1)], F.col("a").alias(f"r{j}")), [f"id{i}" for i in range(j + 1, k + 1)])
            r = F.col(f"r{j}")
        cuts.append(F.struct(score(F.col("a"), l, r).alias("score"), F.lit(j).alias("k"), l.alias("l"), r.alias("r")))
    return out.select(*_ids(k), "lang", F.concat_ws(" ", *[f"w{i}" for i in range(1, k + 1)]).alias("phrase"), "a", F.array_min(F.array(*cuts)).alias("best"))


def score(a: Column, l: Column, r: Column) -> Column:
    """floor(1000000 * a * a / (l * r)), exactly: counts of up to 15 digits, products of up to 38."""
    wide = lambda c: c.cast("decimal(15,0)")
    up, down = (F.lit(1_000_000).cast("decimal(7,0)") * (wide(a) * wide(a)).cast("decimal(30,0)")).cast("decimal(38,0)"), (wide(l) * wide(r)).cast("decimal(30,0)")
    # what is divided has no remainder, so that the quotient is exact, too
    return ((up - up % down) / down).cast("bigint")


def covered(k: int, phrases: dict[int, DataFrame], longest: int) -> DataFrame | None:
    """(id1.., most): the frequency of the most frequent longer candidate around each phrase of k words."""
    out = None
    for m in range(k + 1, longest + 1):
        for lo in range(m - k + 1):
            part = phrases[m].select(*[F.col(f"id{lo + i}").alias(f"id{i}") for i in range(1, k + 1)], "a")
            out = part if out is None else out.unionByName(part)
    return out.groupBy(*_ids(k)).agg(F.max("a").alias("most")) if out is not None else None


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = 3, least: int = 10, half: tuple[int, int] = (50, 100), best: int = 2000, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's `best` phrases of 2 to `longest` words."""
    texts = docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"), text_or_empty(f"`{text_col}`").cast("binary").alias("body"))
    postings = cut(texts.mapInArrow(_invert(shard_words), "shard long, lang string, word string, positions array<int>"), "zstd")
    words = cut(postings.groupBy("lang", "word").agg(F.sum(F.size("positions")).alias("a")).withColumn("id", F.monotonically_increasing_id()))
    frequent = words.filter(F.col("a") >= least)
    lists = cut(postings.join(frequent.select("lang", "word", "id"), ["lang", "word"]).select("shard", "id", "positions"), "zstd")
    drop(postings)
    phrases, known = {1: frequent}, None
    for k in range(1, longest):
        last = k == longest - 1
        met = cut(_extension(lists, known, k, least, not last), "zstd")
        phrases[k + 1] = met if last else met.filter("pack IS NULL").drop("shard", "pack")
        known = None if last else met.filter("pack IS NOT NULL")
    total = words.groupBy("lang").agg(F.sum("a").alias("n"))
    out = None
    for k in range(2, longest + 1):
        some, around = scored(k, phrases), covered(k, phrases, longest)
        if around is not None:
            some = some.join(around, _ids(k), "left").filter(F.coalesce(F.col("most"), F.lit(0)) * half[1] < F.col("a") * half[0])
        some = some.select("lang", "phrase", "a", "best.l", "best.r", "best.score")
        out = some if out is None else out.unionByName(some)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    place = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    out = out.withColumn("__part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS))).withColumn("__place", place("lang", "__part")).filter(F.col("__place") <= best)
    out = out.withColumn("rank", place("lang").cast("bigint")).filter(F.col("rank") <= best).join(total, "lang")
    return out.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11(docs: DataFrame) -> DataFrame:
    return collocations(docs)


OP11_SQL = rf"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS t FROM documents),
p AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (SELECT unnest([1, 2, 3]) AS k))),
f AS (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL),
n AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND a >= 10),
cuts AS (
  SELECT c.lang, c.k, c.phrase, c.a, j, l.a AS l, r.a AS r, ((1000000::HUGEINT * c.a * c.a) // (l.a::HUGEINT * r.a))::BIGINT AS score
  FROM (SELECT *, unnest(range(1, k)) AS j FROM c) c
  JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:j], ' ')
  JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[j + 1:], ' ')),
b AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
x AS (SELECT lang, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase, a FROM c WHERE k = 3),
m AS (SELECT lang, phrase, max(a) AS most FROM x GROUP BY ALL),
s AS (
  SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank
  FROM b LEFT JOIN m ON m.lang = b.lang AND m.phrase = b.phrase WHERE b.k = 3 OR coalesce(100 * most < 50 * a, true))
SELECT s.lang, rank, s.phrase, a, l, r, n, score FROM s JOIN n ON n.lang = s.lang WHERE rank <= 2000
"""
