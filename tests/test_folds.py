"""Folds: every rule against a plain loop, whole and cut into blocks of a few rows."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftline.operators import folds, segments
from weftline.streaming import state


def greedy(tokens, budget):
    b = t = 0
    out = []
    for x in tokens:
        if t > 0 and t + x > budget:
            b, t = b + 1, 0
        t += x
        out.append(b)
    return out


def cooldown(at, seconds):
    last, out = None, []
    for x in at:
        out.append(last is None or x - last >= seconds)
        if out[-1]:
            last = x
    return out


def lockout(rule, at, failed):
    s, out = (0, 0.0, 0.0), []
    for a, f in zip(at, failed, strict=True):
        s, o = rule.step(s, a, f)
        out.append(o)
    return out


def in_blocks(rule, columns, cuts):
    """Each block walked from the entry state that the summaries before it give."""
    now, out = rule.start, []
    for lo, hi in zip([0, *cuts], [*cuts, len(columns[0])], strict=True):
        part = [c[lo:hi] for c in columns]
        if lo < hi:
            end, told = rule.walk(now, *part)
            out += list(told)
            now = rule.through(np.array(rule.summary(*part)), now)
            assert [float(x) for x in now] == [float(x) for x in end]
    return out


times = st.lists(st.integers(0, 40), min_size=1, max_size=60).map(sorted)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 12), min_size=1, max_size=60), st.integers(1, 15), st.data())
def test_greedy_blocks_compose(tokens, budget, data):
    cuts = sorted(data.draw(st.lists(st.integers(0, len(tokens)), max_size=4)))
    assert in_blocks(folds.Greedy(budget), [np.array(tokens)], cuts) == greedy(tokens, budget)


@settings(max_examples=300, deadline=None)
@given(times, st.integers(0, 9), st.data())
def test_cooldown_blocks_compose(at, seconds, data):
    cuts = sorted(data.draw(st.lists(st.integers(0, len(at)), max_size=4)))
    assert in_blocks(folds.Cooldown(seconds), [np.array(at, float)], cuts) == cooldown(at, seconds)


@settings(max_examples=300, deadline=None)
@given(times, st.integers(1, 9), st.integers(0, 9), st.integers(1, 4), st.data())
def test_lockout_blocks_compose(at, window, lock, limit, data):
    failed = data.draw(st.lists(st.integers(0, 5).map(bool), min_size=len(at), max_size=len(at)))
    cuts = sorted(data.draw(st.lists(st.integers(0, len(at)), max_size=4)))
    rule = folds.Lockout(window, lock, limit)
    assert in_blocks(rule, [np.array(at, float), np.array(failed)], cuts) == lockout(rule, at, failed)


@pytest.mark.parametrize("block", [7, 100_000])
def test_folds_of_tables(spark, block):
    """A hot key, a null key, keys of one row, ties and zeros; a third of the rows have one key."""
    rng = random.Random(5)
    rows = [(k, i, float(rng.randrange(300)), rng.randrange(4) > 0, rng.choice([0, 0, 1, 5, 9, 30])) for k, n in ((None, 40), (1, 120), (2, 1), (3, 60), (4, 25)) for i in range(n)]
    df = spark.createDataFrame(rows, "key int, event_id long, at double, failed boolean, tokens int").repartition(5)
    by = {k: sorted([r for r in rows if r[0] == k], key=lambda r: (r[2], r[1])) for k in (None, 1, 2, 3, 4)}
    rule, expected = folds.Lockout(9, 12, 3), {}
    for k, own in by.items():
        outs = lockout(rule, [r[2] for r in own], [r[3] for r in own]), cooldown([r[2] for r in own], 10.0)
        expected |= {(k, r[1]): pair for r, *pair in zip(own, *outs, strict=True)}
    locks = {(r.key, r.event_id): r.o for r in folds.fold(df, ["key"], ["at", "event_id"], rule, "o", block).collect()}
    cool = {(r.key, r.event_id): r.o for r in folds.fold(df, ["key"], ["at", "event_id"], folds.Cooldown(10), "o", block).collect()}
    assert {k: [locks[k], cool[k]] for k in locks} == expected and len(cool) == len(rows)
    got = {(r.key, r.event_id): r.o for r in folds.fold(df, ["key"], ["event_id"], folds.Greedy(20), "o", block).collect()}
    assert got == {(k, i): b for k in by for i, b in enumerate(greedy([r[4] for r in rows if r[0] == k], 20))}


def test_nulls_and_empty_tables(spark):
    df = spark.createDataFrame([(1, 0, None), (1, 1, 30), (1, None, 5), (1, 2, None)], "job_id int, seq int, tokens int")
    assert sorted((r.seq, r.o) for r in folds.fold(df, ["job_id"], ["seq"], folds.Greedy(20), "o").collect()) == [(0, 0), (1, 0), (2, 1)]
    assert folds.fold(df.limit(0), ["job_id"], ["seq"], folds.Greedy(20), "o").collect() == []
    assert state.cooldown(df.select(F.col("job_id").alias("key"), F.lit(1).alias("event_id"), F.lit(None).cast("double").alias("at"))).collect() == []


def test_a_job_of_many_segments_is_split(spark):
    """One job holds nearly all rows; its blocks are walked by several tasks, with the batches of a plain loop."""
    n = 200_000
    df = spark.range(n).select(F.lit(1).alias("job_id"), F.col("id").cast("int").alias("seq"), (F.col("id") % 97 * 7).cast("int").alias("tokens"))
    df = df.unionByName(spark.createDataFrame([(2, 0, 9000), (2, 1, 5)], "job_id int, seq int, tokens int"))
    got = segments.greedy_batches(df, F.col("tokens"), budget=3000).withColumn("task", F.spark_partition_id()).collect()
    one = sorted((r.seq, r.batch) for r in got if r.job_id == 1)
    assert [b for _, b in one] == greedy([i % 97 * 7 for i in range(n)], 3000)
    assert [r.batch for r in got if r.job_id == 2] == [None, None]
