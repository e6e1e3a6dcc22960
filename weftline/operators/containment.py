"""Which of many terms a text contains, in one pass over the text.

Containment has no equality to join by. Terms are dealt to `shards` by hash; a task reads the terms of its shard, builds an
Aho-Corasick automaton, and streams its texts through. Texts and terms come to a task by one shuffle:
terms go to each of the `buckets` of their shard and sort before the texts, so nothing goes through the driver, no job runs
to plan this one, and a task holds an automaton and a batch of texts. Its terms are measured while they are read:
above `most` code points the job fails with the number of shards that it takes, before the automaton is built.

Texts are sent once for each shard, so a glossary of ten million terms takes ten times the shuffle of one of a million,
and no more memory.

Defined cases: case is folded by SQL's lower() on both sides; an empty term is in every text that isn't null, a null term or text has no hit;
repeated terms and texts give a row each; a term occurs once a text, however often it is found.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as t

#: Code points of distinct terms that a task takes; a node of the automaton takes about 40 bytes, so at most some 400 MB.
MOST = 10_000_000


class Matcher:
    """Terms by number, found in lower-cased texts."""

    def __init__(self, terms: dict[str, list[int]]):
        self.everywhere = terms.pop("", [])
        self.automaton = ahocorasick.Automaton()
        for term, numbers in terms.items():
            self.automaton.add_word(term, (term, numbers))
        if len(self.automaton):
            self.automaton.make_automaton()

    def hits(self, text: str) -> list[int]:
        found = {term: numbers for _, (term, numbers) in self.automaton.iter(text)} if len(self.automaton) else {}
        return [*self.everywhere, *(n for numbers in found.values() for n in numbers)]


def contained(texts: DataFrame, terms: DataFrame, text: str, term: str, shards: int = 1, buckets: int | None = None, most: int = MOST) -> DataFrame:
    """Columns of texts and of terms, a row for each text and each term that it contains; their names differ."""
    buckets = buckets or int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left, right = texts.schema.fields, terms.schema.fields
    if clash := {f.name for f in left} & {f.name for f in right}:
        raise ValueError(f"columns of both sides: {sorted(clash)}")
    parts = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    names = [f"__l{i}" for i in range(len(left))], [f"__r{i}" for i in range(len(right))]  # mapInArrow takes no names with dots
    none = lambda fields, to: [F.lit(None).cast(f.dataType).alias(n) for f, n in zip(fields, to, strict=True)]
    mine, own = ([F.col(f"`{f.name}`").alias(n) for f, n in zip(fields, to, strict=True)] for fields, to in zip((left, right), names, strict=True))
    low_text, low_term = F.lower(F.col(f"`{text}`")), F.lower(F.col(f"`{term}`"))
    dealt_terms = terms.filter(low_term.isNotNull()).select(*none(left, names[0]), *own, low_term.alias("__low"), F.lit(0).alias("__kind"), (F.pmod(F.xxhash64(low_term), F.lit(shards)) * buckets).alias("__s"), parts(buckets).alias("__b"))
    dealt_terms = dealt_terms.withColumn("__to", (F.col("__s") + F.col("__b")).cast("int")).drop("__s", "__b")
    of_row = F.pmod(F.xxhash64(*mine), F.lit(buckets))
    dealt_texts = texts.filter(low_text.isNotNull()).select(*mine, *none(right, names[1]), low_text.alias("__low"), F.lit(1).alias("__kind"), of_row.alias("__b"), parts(shards).alias("__s"))
    dealt_texts = dealt_texts.withColumn("__to", (F.col("__s") * buckets + F.col("__b")).cast("int")).drop("__s", "__b")
    both = dealt_terms.unionByName(dealt_texts).repartitionById(shards * buckets, F.col("__to")).sortWithinPartitions("__kind")

    def matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers: dict[str, list[int]] = defaultdict(list)
        kept, matcher, table, size, n = [], None, None, 0, 0
        for b in batches:
            first = pc.sum(pc.equal(b.column("__kind"), 0)).as_py() or 0
            if first:
                kept.append(b.slice(0, first).select(names[1]))
                for low in b.column("__low")[:first].to_pylist():
                    size += 0 if low in numbers else len(low)
                    numbers[low].append(n)
                    n += 1
                if size > most:
                    raise MemoryError(f"terms of more than {most} code points in a task: raise shards above {shards}")
            if first == b.num_rows:
                continue
            if matcher is None:
                matcher, table = Matcher(numbers), pa.Table.from_batches(kept) if kept else None
            if table is None:
                return
            rows, hits = [], []
            for i, low in enumerate(b.column("__low")[first:].to_pylist(), first):
                found = matcher.hits(low)
                rows += [i] * len(found)
                hits += found
                if len(rows) >= 100_000:
                    yield from joined(b, table, rows, hits)
                    rows, hits = [], []
            yield from joined(b, table, rows, hits)

    def joined(b: pa.RecordBatch, table: pa.Table, rows: list[int], hits: list[int]) -> Iterator[pa.RecordBatch]:
        if rows:
            a, z = b.select(names[0]).take(pa.array(rows)), table.take(pa.array(hits)).combine_chunks()
            yield pa.RecordBatch.from_arrays([*a.columns, *[c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in z.columns]], [*names[0], *names[1]])

    hits = both.mapInArrow(matched, t.StructType([t.StructField(n, f.dataType) for f, n in zip([*left, *right], [*names[0], *names[1]], strict=True)]))
    return hits.toDF(*texts.columns, *terms.columns)
