"""Folds over the rows of a key in order, in bounded memory, with long keys split over tasks.

A fold carries a small state from row to row, which no window function can express. Rows are sorted within
partitions and streamed in Arrow batches; only the state is carried on, so a key of any length takes the memory of a batch.

A key with more than `block` rows is cut into blocks by equal widths of its first order column. Each block is summed up on
its own: what state comes out, for any state that goes in. That function has few pieces, because two
walks that once reset at the same row are equal from there on. A walk over the summaries then gives each block its
entry state, and all blocks are walked at once. A block holds `block` rows if they are spread evenly; its summary
takes some tens of bytes a row of a block in memory, the walk itself doesn't.

Defined cases: a null key is a key; rows with a null in the first order column go (they have no place); null values
count as 0 or false; repeated rows are all kept; ties in the first order column are never cut apart.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as t

BLOCK = 65_536
State = list[float]


class Rule(Protocol):
    """A fold. `values` are the columns that it reads; numbers are doubles, so whole ones are exact to 2^53."""

    values: list[str]
    emits: str
    start: State

    def walk(self, state: State, *values: np.ndarray) -> tuple[State, np.ndarray | pa.Array]: ...

    def summary(self, *values: np.ndarray) -> list[float]: ...

    def through(self, summary: np.ndarray, state: State) -> State: ...


def _last_of_runs(rows: np.ndarray) -> np.ndarray:
    """Of adjacent rows that differ in the first column only, the last."""
    if len(rows) < 2:
        return rows
    return rows[np.append((rows[1:, 1:] != rows[:-1, 1:]).any(axis=1), True)]


class Greedy:
    """Batches filled in order up to a budget: state (batch, tokens in it). A text above the budget is a batch by itself."""

    values, emits, start = ["tokens"], "integer", [0.0, 0.0]

    def __init__(self, budget: int):
        self.budget = budget

    def _flush(self, sums: np.ndarray, i: int, held: float) -> tuple[int, float]:
        """Where the batch that holds `held` (before row i) is flushed, and what it has held till there."""
        n = len(sums) - 1
        if held == 0:  # an empty batch takes the first text that has tokens, of any size
            i = int(np.searchsorted(sums, sums[i], side="right"))
            if i > n:
                return n, 0.0
            held = sums[i] - sums[i - 1]
        j = max(int(np.searchsorted(sums, self.budget - held + sums[i], side="right")) - 1, i)
        return min(j, n), held + sums[min(j, n)] - sums[i]

    def walk(self, state: State, tokens: np.ndarray) -> tuple[State, np.ndarray]:
        batch, held = state
        sums, out, i = np.concatenate([[0.0], np.cumsum(tokens)]), np.empty(len(tokens), "int32"), 0
        while True:
            j, full = self._flush(sums, i, held)
            out[i:j] = batch
            if j == len(tokens):
                return [batch, full], out
            batch, held = batch + 1, float(tokens[j])
            out[j] = batch
            i = j + 1

    def _exits(self, sums: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        """(flushes, tokens held) at the end, for each row that starts a batch."""
        n = len(tokens)
        out = np.zeros((n, 2))
        for p in range(n - 1, -1, -1):
            j, full = self._flush(sums, p + 1, float(tokens[p]))
            out[p] = (0, full) if j == n else (out[j, 0] + 1, out[j, 1])
        return out

    def summary(self, tokens: np.ndarray) -> list[float]:
        sums = np.concatenate([[0.0], np.cumsum(tokens)])
        exits = self._exits(sums, tokens)
        some = np.flatnonzero(tokens)
        of_empty = exits[some[0]] if len(some) else np.zeros(2)
        ends, at = np.unique(sums[1:], return_index=True)  # the first row with each sum is where a batch overflows
        last = int(np.searchsorted(ends, self.budget, side="right")) + 1
        return [sums[-1], *of_empty, *np.column_stack([ends, exits[at]])[:last].ravel()]

    def through(self, summary: np.ndarray, state: State) -> State:
        batch, held = state
        if held == 0:
            return [batch + summary[1], summary[2]]
        table = summary[3:].reshape(-1, 3)
        j = int(np.searchsorted(table[:, 0], self.budget - held, side="right"))
        return [batch + 1 + table[j, 1], table[j, 2]] if j < len(table) else [batch, held + summary[0]]


class Cooldown:
    """True for the first row, then for the first at least `seconds` after the last true one: state (any yet, its time)."""

    values, emits, start = ["at"], "boolean", [0.0, 0.0]

    def __init__(self, seconds: float):
        self.seconds = seconds

    def _next(self, at: np.ndarray, last: float) -> int:
        """The first row with at - last >= seconds; the sum that is searched for may be rounded otherwise than the difference."""
        j = int(np.searchsorted(at, last + self.seconds))
        while j and at[j - 1] - last >= self.seconds:
            j -= 1
        while j < len(at) and at[j] - last < self.seconds:
            j += 1
        return j

    def walk(self, state: State, at: np.ndarray) -> tuple[State, np.ndarray]:
        some, last = state
        out = np.zeros(len(at), bool)
        i = self._next(at, last) if some else 0
        while i < len(at):
            out[i], some, last = True, 1.0, float(at[i])
            i = max(i + 1, self._next(at, last))
        return [some, last], out

    def summary(self, at: np.ndarray) -> list[float]:
        ends = np.empty(len(at))
        for p in range(len(at) - 1, -1, -1):
            j = max(p + 1, self._next(at, float(at[p])))
            ends[p] = ends[j] if j < len(at) else at[p]
        reach = self._next(at, float(at[0])) + 1
        return [ends[0], *_last_of_runs(np.column_stack([at, ends])[:reach]).ravel()]

    def through(self, summary: np.ndarray, state: State) -> State:
        if not state[0]:
            return [1.0, summary[0]]
        table = summary[1:].reshape(-1, 2)
        j = self._next(table[:, 0], state[1])
        return [1.0, table[j, 1]] if j < len(table) else state


class Lockout:
    """Every failure restarts the window; `limit` of them lock. A success clears the count.

    State: failures, the time of the last, the end of the lock, in seconds.
    """

    values, emits, start = ["at", "failed"], "string", [0.0, 0.0, 0.0]

    def __init__(self, window: float = 600, lock: float = 900, limit: int = 5):
        self.window, self.lock, self.limit = window, lock, limit

    def step(self, state: tuple, at: float, failed: bool) -> tuple[tuple, str]:
        n, last, until = state
        if at < until:
            return state, "locked"
        if not failed:
            return (0, 0.0, 0.0), "ok"
        n = n + 1 if n and at - last < self.window else 1
        if n >= self.limit:
            return (0, 0.0, at + self.lock), "lock"
        return (n, at, 0.0), "failed"

    def walk(self, state: State, at: np.ndarray, failed: np.ndarray) -> tuple[State, np.ndarray]:
        out, now = [], tuple(state)
        for a, f in zip(at.tolist(), failed.tolist(), strict=True):
            now, outcome = self.step(now, a, f)
            out.append(outcome)
        return [float(x) for x in now], np.array(out, object)

    def summary(self, at: np.ndarray, failed: np.ndarray) -> list[float]:
        """The state at the end from each row on, if the rows just before were k failures in a row within their windows."""
        n, k = len(at), self.limit
        ends = np.zeros((k, n + 1, 3))
        ends[1:, n, 0], ends[1:, n, 1] = np.arange(1, k), at[-1]
        for p in range(n - 1, -1, -1):
            near = p > 0 and at[p] - at[p - 1] < self.window
            for had in range(k):
                if not failed[p]:
                    ends[had, p] = ends[0, p + 1]
                elif (now := had + 1 if had and (near or p == 0) else 1) < k:
                    ends[had, p] = ends[now, p + 1]
                else:
                    q = max(p + 1, int(np.searchsorted(at, at[p] + self.lock)))
                    ends[had, p] = ends[0, q] if q < n else (0, 0, at[p] + self.lock)
        reach = int(np.searchsorted(at, at[0] + self.lock)) + 1
        return [at[0], *ends[:, 0].ravel(), *_last_of_runs(np.column_stack([at, ends[0, :n]])[:reach]).ravel()]

    def through(self, summary: np.ndarray, state: State) -> State:
        n, last, until = state
        first, counted, table = summary[0], summary[1 : 1 + 3 * self.limit].reshape(-1, 3), summary[1 + 3 * self.limit :].reshape(-1, 4)
        if first < until:
            p = int(np.searchsorted(table[:, 0], until))
            return table[p, 1:].tolist() if p < len(table) else state
        return counted[int(n) if n and first - last < self.window else 0].tolist()


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.RecordBatch, list[tuple[bool, int, int]]]]:
    """Batches with their stretches of equal keys: whether a key is new, from, to."""
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        cols, new = [b.column(k) for k in keys], np.zeros(b.num_rows - 1, bool)
        for c in cols:
            differ = pc.fill_null(pc.not_equal(c[1:], c[:-1]), False)
            new |= pc.or_(differ, pc.xor(pc.is_null(c[1:]), pc.is_null(c[:-1]))).to_numpy(zero_copy_only=False)
        edges = [0, *(np.flatnonzero(new) + 1).tolist(), b.num_rows]
        first = tuple(c[0].as_py() for c in cols)
        yield b, [(i > 0 or first != last, lo, hi) for i, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False))]
        last = tuple(c[-1].as_py() for c in cols)


def _numbers(b: pa.RecordBatch, rule: Rule) -> list[np.ndarray]:
    return [b.column(v).to_numpy(zero_copy_only=False) for v in rule.values]


def fold(rows: DataFrame, key: list[str], order: list[str], rule: Rule, out: str, block: int | None = BLOCK, keep: tuple[str, ...] = ()) -> DataFrame:
    """`rows` (key, order, the rule's values and what to `keep`) with what the rule says of each row in column `out`.

    Without a `block` each key is streamed through one task, for rules that have no summary.
    """
    kinds = {f.name: f.dataType for f in rows.schema}
    names = list(dict.fromkeys([*key, *order, *rule.values, *keep]))
    same = lambda a, b: reduce(Column.__and__, [a[k].eqNullSafe(b[f"__{k}"]) for k in key])
    place = F.col(order[0]).cast("double")
    fill = {v: F.coalesce(v, F.lit(False) if kinds[v] == t.BooleanType() else F.lit(0)) for v in rule.values if v not in (*order, *key)}
    rows = rows.select(names).filter(F.col(order[0]).isNotNull()).withColumns(fill)
    result = t.StructType([t.StructField(c, kinds[c]) for c in names]).add(out, t.DataType.fromDDL(rule.emits))
    long = rows.groupBy(*[F.col(k).alias(f"__{k}") for k in key]).agg(F.count(F.lit(1)).alias("__n"), F.min(place).alias("__lo"), F.max(place).alias("__hi")).filter(F.col("__n") > (block or BLOCK))
    blocks = F.ceil(F.col("__n") / (block or BLOCK))
    cut = F.least(F.floor((place - F.col("__lo")) / F.nullif(F.col("__hi") - F.col("__lo"), F.lit(0.0)) * blocks), blocks - 1)
    dealt = lambda how: rows.join(long, same(rows, long), how).select(*names, F.coalesce(cut, F.lit(0)).cast("long").alias("__block"))
    hashed = [*key, "__block"]

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, of = [], None

        def one() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*of, pa.array([rule.summary(*map(np.concatenate, zip(*held, strict=True)))], pa.list_(pa.float64()))], [*hashed, "__summary"])

        for b, parts in _groups(batches, hashed):
            cols = _numbers(b, rule)
            for new, lo, hi in parts:
                if new and held:
                    yield one()
                    held = []
                held.append([c[lo:hi] for c in cols])
                of = [b.column(k)[lo : lo + 1] for k in hashed]
        if held:
            yield one()

    def composed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = rule.start
        for b, parts in _groups(batches, key):
            entries = []
            for new, lo, hi in parts:
                if new:
                    state = rule.start
                for s in b.column("__summary")[lo:hi]:
                    entries.append([float(x) for x in state])
                    state = rule.through(s.values.to_numpy(), state)
            yield pa.RecordBatch.from_arrays([*[b.column(k) for k in hashed], pa.array(entries, pa.list_(pa.float64()))], [*hashed, "__entry"])

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = rule.start
        for b, parts in _groups(batches, key if block is None else hashed):
            cols, told, entry = _numbers(b, rule), [], None if block is None else b.column("__entry")
            for new, lo, hi in parts:
                if new:
                    state = rule.start if entry is None else entry[lo].as_py() or rule.start
                state, said = rule.walk(state, *[c[lo:hi] for c in cols])
                told.append(said)
            said = pa.concat_arrays(told) if isinstance(told[0], pa.Array) else pa.array(np.concatenate(told))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], said], [*names, out])

    if block is None:
        return rows.repartition(*key).sortWithinPartitions(*key, *order).mapInArrow(walked, result)
    of_block = [t.StructField(k, kinds[k]) for k in key] + [t.StructField("__block", t.LongType())]
    numbers = t.ArrayType(t.DoubleType())
    summaries = dealt("inner").repartition(*hashed).sortWithinPartitions(*hashed, *order).mapInArrow(summed, t.StructType([*of_block, t.StructField("__summary", numbers)]))
    entries = summaries.repartition(*key).sortWithinPartitions(*hashed).mapInArrow(composed, t.StructType([*of_block, t.StructField("__entry", numbers)]))
    entries = entries.select(*[F.col(k).alias(f"__{k}") for k in key], F.col("__block").alias("__of"), "__entry")
    all_rows = dealt("left")
    all_rows = all_rows.join(entries, same(all_rows, entries) & (all_rows["__block"] == entries["__of"]), "left").select(*names, "__block", "__entry")
    return all_rows.repartition(*hashed).sortWithinPartitions(*hashed, *order).mapInArrow(walked, result)
