"""Mixing sources to target weights by systematic sampling.

Every source has a target number of words. A document's expected copies are its
source's target over its source's size. Within a source the expected copies are
prefix-summed, one random offset is added, and a document is emitted once for each
integer boundary that its part of the sum crosses. The order within a source is
size class (bits of the size) and then pseudo-random, so every size class gets
its share and the words taken come near the target.

A source may hold most of the rows: the prefix sum is made over (source, size
class, sub-bucket), and whole buckets are offset by sums of their counts.

Defined cases: null text has size 0; null source is a source of its own, ordered
last; a source of size 0 has target 0 and takes none; repeated rows are separate
documents; an empty table gives an empty result. Results depend on the rows and
the seed only. `mix` carries the input's columns under their own names; a clash
with a column it adds raises ValueError, `mixed` can't clash; a very long text counts
whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import cut, n_words, text_or_empty

#: Expected copies are summed as whole trillionths, so that sums don't depend on order.
UNIT = 1_000_000_000_000
ADDED = ("size", "source_size", "target", "copies", "taken")


def _hex(c: Column, start: int, digits: int) -> Column:
    return F.conv(F.substring(c, start, digits), 16, 10).cast("bigint")


def source_key(source: Column) -> Column:
    """Never null, and in the order of the sources: by code point, null last."""
    return F.coalesce(F.concat(F.lit("0"), source.cast("string")), F.lit("1"))


def source_targets(sized: DataFrame, weights: tuple[float, ...] = (1, 2, 3), share: float = 1.0, most: int = 3) -> DataFrame:
    """(skey, source_size, target) from rows of (skey, size).

    Weights repeat over the sources in order; targets share the total by weight. A
    target stops at `most` times its source's size and the excess is shared anew by
    weight. With sources ordered by the level at which they stop, the level sought is
    the first that the next source doesn't stop below. One row per source is
    windowed, never a row per document.
    """
    s = sized.groupBy("skey").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy("skey")) - 1
    s = s.withColumn("w", F.get(F.array(*[F.lit(float(x)) for x in weights]), F.pmod(place, F.lit(len(weights)))))
    s = s.withColumn("stop", (most * F.col("source_size")) / F.col("w"))
    upto = Window.orderBy("stop", "skey").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumn("left", F.sum("source_size").over(every) * F.lit(float(share)) - most * F.coalesce(F.sum("source_size").over(upto), F.lit(0)))
    s = s.withColumn("level", F.col("left") / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(upto), F.lit(0.0))))
    s = s.withColumn("level", F.min_by("level", F.when(F.col("stop") >= F.col("level"), F.struct("stop", "skey"))).over(every))
    stop = most * F.col("source_size").cast("double")
    return s.select("skey", "source_size", F.least(stop, F.coalesce(F.col("level") * F.col("w"), stop)).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", size: Column | None = None, text_col: str = "text", weights: tuple[float, ...] = (1, 2, 3), share: float = 1.0, most: int = 3, seed: str = "mix", sub_buckets: int = 256) -> DataFrame:
    """Every row of `docs` with size, source_size, target, copies and taken (copies times size)."""
    own = docs.columns
    if clash := set(ADDED) & set(own):
        raise ValueError(f"columns of the input would be overwritten: {sorted(clash)}")
    size = n_words(text_or_empty(text_col)) if size is None else size
    rows = docs.withColumns({
        "size": F.coalesce(size, F.lit(0)).cast("long"),
        "__skey": source_key(F.col(source_col)),
        "__k": F.md5(F.concat(F.lit(seed + "|"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary")),
        "__t": F.xxhash64(text_col) if text_col in own else F.lit(0).cast("long"),
    })
    rows = rows.withColumns({"__c": F.length(F.bin("size")), "__b": _hex(F.col("__k"), 1, 4) % sub_buckets})
    counts = cut(rows.groupBy(F.col("__skey").alias("skey"), "__c", "__b").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size")))
    # offsets of whole buckets: over the size classes of a source, and over the sub-buckets of a class
    before = lambda *keys: Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    classes = counts.groupBy("skey", "__c").agg(F.sum("n").alias("n")).withColumn("cn", F.coalesce(F.sum("n").over(before("skey").orderBy(F.desc("__c"))), F.lit(0)))
    offsets = counts.withColumn("bn", F.coalesce(F.sum("n").over(before("skey", "__c").orderBy("__b")), F.lit(0)))
    offsets = offsets.join(classes.drop("n"), ["skey", "__c"]).join(source_targets(counts, weights, share, most), "skey")
    offsets = offsets.select(F.col("skey").alias("__os"), F.col("__c").alias("__oc"), F.col("__b").alias("__ob"), (F.col("cn") + F.col("bn")).alias("__before"), "source_size", "target")
    out = rows.join(offsets, (F.col("__skey") == F.col("__os")) & (F.col("__c") == F.col("__oc")) & (F.col("__b") == F.col("__ob")))
    wide = lambda c: c.cast("decimal(38,0)")
    each = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") * UNIT)).otherwise(F.lit(0)).cast("decimal(18,0)")
    start = F.floor(_hex(F.md5(F.concat(F.lit(seed + "#"), F.col("__skey")).cast("binary")), 1, 8) / F.lit(4294967296.0) * UNIT).cast("decimal(18,0)")
    out = out.withColumns({"__e": each, "__u": start})
    within = Window.partitionBy("__skey", "__c", "__b").orderBy("__k", F.col(id_col), "size", "__t").rowsBetween(Window.unboundedPreceding, 0)
    end = wide(F.sum("__e").over(within)) + wide(F.col("__before").cast("decimal(19,0)") * F.col("__e")) + F.col("__u")
    out = out.withColumn("__end", wide(end))
    crossed = F.expr(f"(__end div {UNIT}) - ((__end - __e) div {UNIT})")
    out = out.withColumn("copies", crossed.cast("long")).withColumn("taken", F.col("copies") * F.col("size"))
    return out.select(*[F.col(f"`{c}`") for c in own], *ADDED)


def mixed(docs: DataFrame, **how: object) -> DataFrame:
    """The documents of the mix, each as often as it is taken, with the columns of `docs`."""
    key = {k: how.get(k, d) for k, d in (("id_col", "doc_id"), ("source_col", "source"), ("text_col", "text"))}
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__wl_row"), *[F.col(v).alias(d) for v, d in zip(key.values(), ("doc_id", "source", "text"), strict=True)])
    how = {k: v for k, v in how.items() if k not in key}
    return mix(packed, **how).filter("copies > 0").withColumn("__i", F.explode(F.sequence(F.lit(1), "copies"))).select("__wl_row.*")


def op4(docs: DataFrame) -> DataFrame:
    sized = docs.select("doc_id", "source", n_words(text_or_empty("text")).alias("n"))
    return mix(cut(sized), size=F.col("n"), text_col="").select("doc_id", "size", "source_size", "target", "taken")


OP4_SQL = f"""
WITH d AS (SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, coalesce('0' || source, '1') AS skey FROM documents),
k AS (SELECT *, md5('mix|' || coalesce(doc_id::VARCHAR, '')) AS k, length(bin(size)) AS c FROM d),
s AS (SELECT skey, sum(size)::BIGINT AS source_size, (((row_number() OVER (ORDER BY skey) - 1) % 3) + 1)::DOUBLE AS w FROM d GROUP BY skey),
l AS (
  SELECT *, 3 * source_size / w AS stop,
         (sum(source_size) OVER () * 1.0::DOUBLE - 3 * coalesce(sum(source_size) OVER p, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER p, 0)) AS level
  FROM s WINDOW p AS (ORDER BY 3 * source_size / w, skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT skey, source_size, least((3 * source_size)::DOUBLE, (SELECT level FROM l WHERE stop >= level ORDER BY stop, skey LIMIT 1) * w) AS target FROM l),
e AS (
  SELECT doc_id, size, source_size, target, skey, c, k,
         CASE WHEN source_size > 0 THEN floor(target / source_size * {UNIT}) ELSE 0 END::HUGEINT AS e,
         floor(('0x' || substr(md5('mix#' || skey), 1, 8))::BIGINT / 4294967296.0::DOUBLE * {UNIT})::HUGEINT AS u
  FROM k JOIN t USING (skey)),
r AS (
  SELECT *, sum(e) OVER (PARTITION BY skey ORDER BY c DESC, ('0x' || substr(k, 1, 4))::BIGINT % 256, k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::HUGEINT + u AS z
  FROM e)
SELECT doc_id, size, source_size, target, ((z // {UNIT}) - ((z - e) // {UNIT}))::BIGINT * size AS taken FROM r
"""
