"""Drawing documents that resemble a target corpus: importance resampling on hashed words.

A document's features are its runs of 1 to `longest` words, each hashed to one of `buckets`.
The gain of a bucket is the log ratio of its smoothed shares in the target texts and in the
documents. A document's weight is the sum of its features' gains: its words become an array of
buckets, over which `aggregate` adds up entries of a literal array of gains, so that scoring
neither explodes nor shuffles; only the bucket totals of the two tables do, added up where they
arise. Noise of the Gumbel law, from a hash of the id, makes the highest scores a draw without
replacement in proportion to the exponential of the weights.

The draw ranks scores by ranges: rows of ids and numbers are dealt to sorted ranges, and a row's
rank is its place in its range plus the sizes of the ranges before.

Defined cases: a null or empty text has no feature, weight 0, and isn't drawn; a null id is
hashed as an empty one and ranked last among its equals; a very long text counts whole; repeated
rows are scored alike and drawn separately; without target texts the target's shares are even;
an empty table gives an empty result; other columns of the input are not read.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import cut, documents

BUCKETS = 10_000
#: Words of lower-cased text: ASCII letters and digits, and all that isn't ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def tokens(text: Column) -> Column:
    """The words of a text, A to Z in lower case; an empty array for a null text."""
    low = F.translate(F.coalesce(text.cast("string"), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.regexp_extract_all(low, F.lit(WORD), F.lit(0))


def features(words: Column, longest: int = 1) -> Column:
    """All runs of 1 to `longest` consecutive words, joined by a space."""

    def runs(n: int) -> Column:
        starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(words, i, n), " "))

    return F.concat(words, *[runs(n) for n in range(2, longest + 1)]) if longest > 1 else words


def bucket_array(words: Column, buckets: int = BUCKETS, longest: int = 1) -> Column:
    return F.transform(features(words, longest), lambda f: (F.crc32(f.cast("binary")) % buckets).cast("int"))


def bucket_totals(texts: DataFrame, text_col: str = "text", buckets: int = BUCKETS, longest: int = 1) -> list[int]:
    """How many features of all texts are in each bucket; the driver gets `buckets` numbers at most."""
    words = texts.select(tokens(F.col(f"`{text_col}`")).alias("w"))
    each = words.select(F.explode(features(F.col("w"), longest)).alias("f")).select((F.crc32(F.col("f").cast("binary")) % buckets).alias("b"))
    totals = [0] * buckets
    for b, n in each.groupBy("b").count().collect():
        totals[b] = n
    return totals


def gains(source: list[int], target: list[int]) -> list[int]:
    """Thousandths of the log ratio of a bucket's smoothed shares, rounded down."""
    n, of_source, of_target = len(source), float(sum(source)), float(sum(target))
    return [math.floor(1000 * math.log((t + 1.0) * (of_source + n) / ((s + 1.0) * (of_target + n)))) for s, t in zip(source, target, strict=True)]


def weight(buckets: Column, gain: list[int]) -> Column:
    """The sum of the gains of an array's buckets. The gains are parsed from one string, which Catalyst folds to a literal array."""
    table = F.split(F.lit(",".join(map(str, gain))), ",").cast("array<bigint>")
    return F.aggregate(buckets, F.lit(0).cast("bigint"), lambda total, b: total + F.element_at(table, b + 1))


def noise(doc_id: Column, seed: str = "2024") -> Column:
    """Thousandths of a Gumbel draw, from a hash of seed and id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("bigint")


def ranked(rows: DataFrame, share: tuple[int, int]) -> DataFrame:
    """`rows` with their rank by score descending and id; null beyond floor(share[0] * rows / share[1])."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    placed = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftrightunsigned("__at", 33)
    # one row for each partition of the ranges
    sizes = sorted((r["p"], r["n"]) for r in placed.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())
    before, total = {}, 0
    for p, n in sizes:
        before[p], total = total, total + n
    starts = rows.sparkSession.createDataFrame(sorted(before.items()), "__p long, __before long")
    drawn = share[0] * total // share[1]
    rank = F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    out = placed.join(F.broadcast(starts), part == F.col("__p"), "left").withColumn("rank", F.when(rank <= drawn, rank))
    return out.select(*rows.columns, "rank")


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", buckets: int = BUCKETS, longest: int = 1, least_words: int = 20, share: tuple[int, int] = (10, 100), seed: str = "2024") -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every document; rank is null for what isn't drawn.

    Of the documents with `least_words` words, the share[0] / share[1] with the highest scores are drawn."""
    gain = gains(bucket_totals(docs, text_col, buckets, longest), bucket_totals(target, target_col, buckets, longest))
    found = docs.select(F.col(f"`{id_col}`").alias("doc_id"), tokens(F.col(f"`{text_col}`")).alias("w"))
    found = found.select("doc_id", F.size("w").alias("n_words"), bucket_array(F.col("w"), buckets, longest).alias("b"))
    scored = found.select("doc_id", F.size("b").cast("bigint").alias("n_features"), weight(F.col("b"), gain).alias("weight"), "n_words")
    scored = cut(scored.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)))
    enough = F.col("n_words") >= least_words
    out = ranked(scored.filter(enough).drop("n_words"), share).unionByName(scored.filter(~enough).drop("n_words").withColumn("rank", F.lit(None).cast("bigint")))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP12_SQL = rf"""
WITH crc AS (
  SELECT list(list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '{WORD}') AS w, row_number() OVER () AS row FROM documents),
dw AS (SELECT row, unnest(w) AS word FROM d),
tw AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '{WORD}')) AS word FROM benchmark),
v AS (SELECT word, hex(word) AS h FROM (SELECT word FROM dw UNION SELECT word FROM tw)),
b AS (
  SELECT word, xor(list_reduce(list_concat([4294967295], list_transform(range(length(h) // 2), lambda k: ('0x' || substr(h, 2 * k + 1, 2))::BIGINT)),
                               lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % {BUCKETS} AS bucket
  FROM v, crc),
s AS (SELECT bucket, count(*) AS s FROM dw JOIN b USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM tw JOIN b USING (word) GROUP BY bucket),
g AS (
  SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM dw) + {BUCKETS})::DOUBLE
                                 / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT count(*) FROM tw) + {BUCKETS})::DOUBLE)))::BIGINT AS gain
  FROM range({BUCKETS}) r(bucket) LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)),
w AS (SELECT row, sum(gain)::BIGINT AS weight FROM dw JOIN b USING (word) JOIN g USING (bucket) GROUP BY row),
r AS (
  SELECT doc_id, len(d.w)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000.0::DOUBLE * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score
  FROM d LEFT JOIN w USING (row)),
k AS (SELECT *, CASE WHEN n_features >= 20 THEN row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST) END AS place FROM r)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= (SELECT 10 * count(*) // 100 FROM r WHERE n_features >= 20) THEN place END AS rank FROM k
"""
