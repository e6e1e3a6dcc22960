"""Removing passages that an earlier document has too, by repeated-phrase automata.

A window is `window` consecutive words of one document. A word goes if a window that covers it
also starts in a document with a smaller id.

1. Anchors: of the phrases of `anchor` words in a window, the one with the least hash is the
   window's anchor, so equal windows have equal anchors, wherever they stand. Consecutive windows
   with one anchor are a span; about one word in 18 starts one.
2. Confirmed passages: spans that are alike count once, with their first and last document. Where
   documents share an anchor, the windows of its distinct spans are counted; a span with a window
   that a later document has too is a passage, and its words are fetched from its first document.
3. Automata: documents are dealt to shards of about `shard_bytes` of text. A passage goes to the
   shards whose documents have its anchor, once to each, however many documents that may be. Where an anchor has several
   passages, each goes only to the shards that have a span with one of its confirmed windows, so a phrase with
   many surroundings isn't sent once for each of them to all. A
   shard's task compiles the anchors of its passages to an Aho-Corasick automaton and streams the
   shard's documents through it. The windows around an occurrence are looked up among the confirmed
   ones; one of an earlier document is compared word by word, and extended along its passage. What
   matches goes.

Hashes choose the passages only; what goes is found by comparing words. A window is missed only if
two windows with one anchor have the same 64-bit digest.

Defined cases: a null or empty text has no word and loses none; a document with a null id isn't
earlier or later than another and loses none; repeated rows have one id, so neither is earlier; a
very long text is taken whole; an empty table gives an empty result; other columns of the input are
not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import cut, drop, text_or_empty

WINDOW = 50
ANCHOR = 16
#: Bytes of texts that are searched for spans together, and words whose bytes are hashed at once.
CHUNK = 2_000_000
WORDS_AT_ONCE = 300_000
#: An odd factor, so that its powers can be inverted modulo 2^64.
FACTOR = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit numbers, one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Hashed:
    """64-bit hashes of runs of words, from prefix sums over the words' hashes, and these from prefix sums over bytes."""

    def __init__(self, text: bytes):
        b = np.frombuffer(text, np.uint8)
        space = np.ones(len(b) + 2, bool)
        space[1:-1] = (b == 32) | ((b >= 9) & (b <= 13))
        #: Where each word starts, and where it ends.
        self.first, self.end = np.flatnonzero(space[:-2] & ~space[1:-1]), np.flatnonzero(~space[:-1] & space[1:])
        n = len(self.first)
        each = np.zeros(n, np.uint64)
        for g in range(0, n, WORDS_AT_ONCE):
            first, end = self.first[g : g + WORDS_AT_ONCE], self.end[g : g + WORDS_AT_ONCE]
            sums, back = self._sums(b[first[0] : end[-1]].astype(np.uint64) + np.uint64(1))
            each[g : g + WORDS_AT_ONCE] = mixed((sums[end - first[0]] - sums[first - first[0]]) * back[first - first[0]])
        self.sums, self.back = self._sums(each)

    @staticmethod
    def _sums(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sums of values times powers of the factor before each place, what brings a sum back from its place)."""
        n = len(values)
        power, sums = np.full(n + 1, FACTOR), np.zeros(n + 1, np.uint64)
        power[0] = 1
        np.cumsum(values * np.cumprod(power)[:n], out=sums[1:])
        power[1:] = INVERSE
        return sums, np.cumprod(power)

    def runs(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        return mixed((self.sums[start + length] - self.sums[start]) * self.back[start])


def least(values: np.ndarray, place: np.ndarray, width: int) -> np.ndarray:
    """For each run of `width` values (64 at most), the position of its least one: 58 bits of a value decide, of equals the place in the text, modulo 64."""
    low = np.uint64(63)
    key, reach = (values & ~low) | (place.astype(np.uint64) & low), 1
    while reach < width:
        step = min(reach, width - reach)
        key, reach = np.minimum(key[: len(key) - step], key[step:]), reach + step
    start = np.arange(len(key))
    return start + (((key & low).astype(np.int64) - place[: len(key)]) & 63)


def spans(texts: list[bytes], window: int, anchor: int) -> dict[str, np.ndarray]:
    """Spans of documents; doc: which of the texts."""
    h = Hashed(b" ".join(texts))
    n_words = len(h.first)
    if n_words < window:
        return {k: np.zeros(0, np.int64) for k in ("doc", "anchor", "digest", "start", "n", "at")}
    # the word at which each text starts, and the end
    starts = np.r_[np.searchsorted(h.first, np.cumsum([0, *(len(t) + 1 for t in texts[:-1])])), n_words]
    grams = h.runs(np.arange(n_words - anchor + 1), anchor)
    doc = np.repeat(np.arange(len(texts)), np.diff(starts))
    at = least(grams, np.arange(len(grams)) - starts[doc[: len(grams)]], window - anchor + 1)
    first = np.arange(n_words - window + 1)
    doc = doc[: len(first)]
    whole = first + window <= starts[doc + 1]
    first, doc, at = first[whole], doc[whole], at[whole]
    new = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (doc[1:] != doc[:-1]) | (first[1:] != first[:-1] + 1)]) if len(at) else np.zeros(0, np.int64)
    n = np.diff(np.r_[new, len(at)])
    lo = first[new]
    return {"doc": doc[new], "anchor": grams[at[new]].view(np.int64), "digest": h.runs(lo, n + (window - 1)).view(np.int64), "start": lo - starts[doc[new]], "n": n, "at": at[new] - lo}


def _find(window: int, anchor: int):
    """(doc_id, shard, body) -> a row for each span."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, rows, size = [], [], 0
            for i, body in enumerate(batch.column("body")):
                text = body.as_py()
                if len(text) >= 2 * window - 1:
                    texts.append(text)
                    rows.append(i)
                    size += len(text)
                if size >= CHUNK:
                    yield emit(batch, rows, spans(texts, window, anchor))
                    texts, rows, size = [], [], 0
            if rows:
                yield emit(batch, rows, spans(texts, window, anchor))

    def emit(batch: pa.RecordBatch, rows: list[int], found: dict) -> pa.RecordBatch:
        owner = pa.array(np.array(rows, np.int64)[found["doc"]])
        cols = [batch.column("doc_id").take(owner), batch.column("shard").take(owner), pa.array(found["anchor"]), pa.array(found["digest"]), *[pa.array(found[k].astype(np.int32)) for k in ("start", "n", "at")]]
        return pa.RecordBatch.from_arrays(cols, names=["doc_id", "shard", "anchor", "digest", "start", "n", "at"])

    return find


def _fetch(window: int):
    """(doc_id, body, spans) -> a row for each span, with its words and the digests of its windows."""

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                body = batch.column("body")[i].as_py()
                words = body.split()
                found = [s for s in batch.column("spans")[i].as_py() if s["start"] + s["n"] + window - 1 <= len(words)]
                if not found:
                    continue
                h = Hashed(body)
                digests = [h.runs(np.arange(s["start"], s["start"] + s["n"]), window).view(np.int64) for s in found]
                cols = [
                    pa.array(np.full(len(found), i)), *[pa.array([s[k] for s in found], pa.int64()) for k in ("anchor", "digest")], *[pa.array([s[k] for s in found], pa.int32()) for k in ("start", "at")],
                    pa.array([b" ".join(words[s["start"] : s["start"] + s["n"] + window - 1]) for s in found], pa.binary()), pa.array(digests, pa.list_(pa.int64())),
                    pa.array([s["many"] for s in found], pa.bool_()),
                ]
                last = pa.array([s["last"] for s in found], batch.column("doc_id").type)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(cols[0]), *cols[1:], last], names=["doc_id", "anchor", "digest", "start", "at", "words", "digests", "many", "last"])

    return fetch


class Automaton:
    """Passages of a shard: an automaton of their anchors' words, and their confirmed windows by digest. Texts are bytes, taken as Latin-1 strings."""

    def __init__(self, window: int, anchor: int):
        import ahocorasick

        self.window, self.anchor, self.anchors, self.passages, self.windows, self.automaton = window, anchor, set(), [], {}, ahocorasick.Automaton()

    def add(self, doc_id: object, passage: bytes, anchor: int, at: int, confirmed: list[int]) -> None:
        words = passage.split(b" ")
        if anchor not in self.anchors:
            self.anchors.add(anchor)
            self.automaton.add_word(" " + b" ".join(words[at : at + self.anchor]).decode("latin-1") + " ", 1)
        self.passages.append((doc_id, words, confirmed))

    def compiled(self) -> Automaton:
        if self.passages:
            self.automaton.make_automaton()
            whole, starts, at = [], [], []
            for n, (_, words, confirmed) in enumerate(self.passages):
                starts += [len(whole) + i for i in confirmed]
                at += [(n, i) for i in confirmed]
                whole += words
            for digest, (n, i) in zip(Hashed(b" ".join(whole)).runs(np.array(starts), self.window).tolist(), at, strict=True):
                doc_id, words, _ = self.passages[n]
                if digest not in self.windows or doc_id < self.windows[digest][0]:
                    self.windows[digest] = (doc_id, words, i)
        return self

    def repeated(self, doc_id: object, words: list[bytes]) -> bytearray:
        """A byte for each word: 1 if a passage of an earlier document covers it."""
        gone, window = bytearray(len(words)), self.window
        if not self.passages or doc_id is None or len(words) < window:
            return gone
        text = b" ".join(words)
        ends = [*self.automaton.iter(" " + text.decode("latin-1") + " ")]
        if not ends:
            return gone
        h = Hashed(text)
        digests = h.runs(np.arange(len(words) - window + 1), window).tolist()
        s, lo, hi = 0, 0, 0  # the next window, the last match
        for p in (np.searchsorted(h.end, [e - 1 for e, _ in ends]) + 1 - self.anchor).tolist():
            s = max(s, p + self.anchor - window)
            while s <= min(p, len(digests) - 1):
                if lo <= s and s + window <= hi:
                    s = hi - window + 1
                    continue
                found = self.windows.get(digests[s])
                if found is not None and found[0] < doc_id and words[s : s + window] == found[1][found[2] : found[2] + window]:
                    lo, hi = self._match(words, s, found[1], found[2])
                    gone[lo:hi] = b"\1" * (hi - lo)
                s += 1
        return gone

    def _match(self, words: list[bytes], s: int, passage: list[bytes], at: int) -> tuple[int, int]:
        """How far the equal windows at s and at `at` go on to both sides."""
        lo, hi = s - at, s - at + len(passage)
        if lo >= 0 and words[lo:hi] == passage:
            return lo, hi
        left, right = 0, self.window
        while left < min(s, at) and words[s - left - 1] == passage[at - left - 1]:
            left += 1
        while s + right < len(words) and at + right < len(passage) and words[s + right] == passage[at + right]:
            right += 1
        return s - left, s + right


def _strip(window: int, anchor: int, with_text: bool):
    """Rows of a shard, passages (at not null) before documents -> a row for each document."""

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, automaton, ready = None, None, False
        for batch in batches:
            rows, out, texts = [], [], []
            for i, (s, doc_id, body, hashed, at, confirmed) in enumerate(zip(*[batch.column(c).to_pylist() for c in ("shard", "doc_id", "body", "anchor", "at", "confirmed")], strict=True)):
                if s != shard:
                    shard, automaton, ready = s, Automaton(window, anchor), False
                if at is not None:
                    automaton.add(doc_id, body, hashed, at, confirmed)
                    continue
                if not ready:
                    automaton, ready = automaton.compiled(), True
                words = body.split()
                gone = automaton.repeated(doc_id, words)
                removed = gone.count(1)
                kept = b" ".join(words if not removed else [w for w, g in zip(words, gone, strict=True) if not g])
                rows.append(i)
                out.append((len(words), removed, hashlib.sha256(kept).hexdigest()))
                texts.append(kept if with_text else None)
            if rows:
                n, removed, digest = zip(*out, strict=True)
                cols = [batch.column("doc_id").take(pa.array(rows)), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(digest)]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_words", "n_removed", "kept", "kept_sha256"])

    return strip


def confirmed(texts: DataFrame, found: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """Passages and needs.

    Passages (anchor, doc_id, start, at, words, confirmed, hashes): spans with windows that a later document has too and no earlier one, where
    these windows start, and their digests. Needs (anchor, digest, doc_id, start): for the spans of anchors with several passages, which of these have
    the spans' windows; a window is in one passage, so a span has at most as many needs as windows.
    """
    kind = dict(texts.dtypes)["doc_id"]
    distinct = cut(found.groupBy("anchor", "digest").agg(F.min(F.struct("doc_id", "start", "n", "at")).alias("f"), F.max("doc_id").alias("last")).select("anchor", "digest", "f.*", "last"))
    shared = distinct.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("last").alias("hi"), (F.count(F.lit(1)) > 1).alias("many")).filter("lo < hi").select("anchor", "many")
    wanted = distinct.join(shared, "anchor").groupBy("doc_id").agg(F.collect_list(F.struct("anchor", "digest", "start", "n", "at", "last", "many")).alias("spans"))
    spans_ = texts.select("doc_id", "body").join(wanted, "doc_id").mapInArrow(_fetch(window), f"doc_id {kind}, anchor long, digest long, start int, at int, words binary, digests array<long>, many boolean, last {kind}")
    spans_ = cut(spans_)
    drop(distinct)
    windows = spans_.select("anchor", "doc_id", "start", "last", F.posexplode("digests").alias("i", "d"))
    windows = windows.groupBy("anchor", "d").agg(F.min(F.struct("doc_id", "start", "i")).alias("f"), F.max("last").alias("last"))
    keep = windows.filter("f.doc_id < last").select("anchor", "f.*").groupBy("anchor", "doc_id", "start").agg(F.array_distinct(F.collect_list("i")).alias("confirmed"))
    hashes = F.transform("confirmed", lambda i: F.get("digests", i))
    out = cut(spans_.join(keep, ["anchor", "doc_id", "start"]).select("anchor", "doc_id", "start", "at", "words", "confirmed", hashes.alias("hashes")), "zstd")
    held = out.join(several(out), "anchor", "left_semi").select("anchor", "doc_id", "start", F.explode("hashes").alias("d"))
    windows = spans_.filter("many").join(several(out), "anchor", "left_semi").select("anchor", "digest", F.explode("digests").alias("d"))
    needs = cut(windows.join(held, ["anchor", "d"]).select("anchor", "digest", "doc_id", "start").distinct())
    drop(spans_)
    return out, needs


def homes(passages: DataFrame) -> DataFrame:
    """(anchor, lo, hi): the first and the last place of each anchor's passages; rows that repeat a place count once."""
    place = F.struct("doc_id", "start")
    return passages.groupBy("anchor").agg(F.min(place).alias("lo"), F.max(place).alias("hi"))


def several(passages: DataFrame) -> DataFrame:
    """Anchors with more than one passage."""
    return homes(passages).filter("lo < hi").select("anchor")


def dealt(found: DataFrame, passages: DataFrame, needs: DataFrame) -> DataFrame:
    """(shard, anchor, doc_id, start): a passage once for each shard in which a later document may have one of its windows."""
    key, many = ["shard", "anchor", "doc_id", "start"], several(passages)
    # one row for each anchor and shard, however often it occurs there
    where = found.groupBy("anchor", "shard").agg(F.max("doc_id").alias("last"))
    one = homes(passages).filter("lo = hi").select("anchor", "lo.*")
    one = where.join(one, "anchor").filter("doc_id < last").select(key)
    spans_ = found.join(many, "anchor", "left_semi").groupBy("anchor", "digest", "shard").agg(F.max("doc_id").alias("last"))
    return one.unionByName(spans_.join(needs, ["anchor", "digest"]).filter("doc_id < last").select(key).distinct())


def strip_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, anchor: int = ANCHOR, shard_bytes: int = 8_000_000, with_text: bool = True) -> DataFrame:
    """(doc_id, n_words, n_removed, kept, kept_sha256) of every document; kept: its words that stay, joined by a space (null without `with_text`)."""
    spark, body = docs.sparkSession, text_or_empty(f"`{text_col}`").cast("binary")
    texts = docs.select(F.col(f"`{id_col}`").alias("doc_id"), body.alias("body"))
    kind = dict(texts.dtypes)["doc_id"]
    size = texts.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # several shards a partition even out their sizes
    shards = parts * max(4, -(-size // (shard_bytes * parts)))
    texts = texts.withColumn("shard", F.pmod(F.xxhash64("doc_id", "body"), F.lit(shards)).cast("int"))
    found = cut(texts.filter("doc_id IS NOT NULL").mapInArrow(_find(window, anchor), f"doc_id {kind}, shard int, anchor long, digest long, start int, n int, at int"))
    passages, needs = confirmed(texts.filter("doc_id IS NOT NULL"), found, window)
    pairs = cut(dealt(found, passages, needs))
    drop(found, needs)
    sent = pairs.join(passages, ["anchor", "doc_id", "start"]).select("shard", "doc_id", F.col("words").alias("body"), "anchor", "at", "confirmed")
    rows = sent.unionByName(texts.withColumns({"anchor": F.lit(None).cast("long"), "at": F.lit(None).cast("int"), "confirmed": F.lit(None).cast("array<int>")}))
    rows = rows.repartition("shard").sortWithinPartitions("shard", F.col("at").isNull())
    return rows.select("shard", "doc_id", "body", "anchor", "at", "confirmed").mapInArrow(_strip(window, anchor, with_text), f"doc_id {kind}, n_words long, n_removed long, kept string, kept_sha256 string")


def op13(docs: DataFrame) -> DataFrame:
    return strip_repeats(docs, with_text=False).select("doc_id", "n_words", "n_removed", "kept_sha256")


OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT row, doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50 AND doc_id IS NOT NULL),
h AS (SELECT row, doc_id, i, array_to_string(w[i:i + 49], ' ') AS x FROM p),
f AS (SELECT row, i, min(doc_id) OVER (PARTITION BY x) < doc_id AS again FROM h),
c AS (SELECT DISTINCT row, unnest(range(i, i + 50)) AS j FROM f WHERE again),
g AS (SELECT row, list(j) AS gone FROM c GROUP BY row)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
       sha256(coalesce(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda v, k: NOT list_contains(gone, k)) END, ' '), '')) AS kept_sha256
FROM d LEFT JOIN g USING (row)
"""
