"""Streams over events: the latest progress of a job, lockouts and cooldowns with exact expiry."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from weftline.operators.folds import Cooldown, Lockout, fold
from weftline.operators.jobs import TERMINAL

PROGRESS = "job_id long, seq long, status string, done int, total int"


def progress(messages: DataFrame) -> DataFrame:
    """JSON messages (value) -> the latest of each job, in update mode."""
    m = messages.select(F.from_json("value", PROGRESS).alias("m")).select("m.*")
    return m.groupBy("job_id").agg(F.max_by(F.struct("status", "done", "total"), "seq").alias("m"), F.max("seq").alias("seq")).select("job_id", "seq", "m.*")


LIVE = "job_id long, seq long, status string, done int, total int, ended boolean"


class ProgressProcessor(StatefulProcessor):
    """Messages of a job -> its newest of a batch, or the one that ends it; an ended job leaves no state.

    Messages that aren't newer than the last are dropped, those behind the end in the same batch too. What comes in
    later batches is a new run of the job. With `ttl_ms`, jobs that never end are forgotten that long after their last message; the query then
    runs batches without data too, so a trigger that ends with the data doesn't end it.
    """

    def __init__(self, ttl_ms: int | None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("newest", "seq long", **({"ttlDurationMs": self.ttl_ms} if self.ttl_ms else {}))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seen = self.state.get()[0] if self.state.exists() else None
        best = end = None
        for part in rows:
            part = part if seen is None else part[part["seq"] > seen]
            ends = part[part["status"].isin(TERMINAL)]
            if len(ends) and (end is None or ends["seq"].min() < end["seq"]):
                end = ends.loc[ends["seq"].idxmin()]
            if len(part) and (best is None or part["seq"].max() > best["seq"]):
                best = part.loc[part["seq"].idxmax()]
        if end is not None:
            self.state.clear()
        elif best is not None:
            self.state.update((int(best["seq"]),))
        shown = best if end is None else end
        if shown is not None:
            yield pd.DataFrame([[*shown[["job_id", "seq", "status", "done", "total"]], end is not None]], columns=["job_id", "seq", "status", "done", "total", "ended"])

    def close(self) -> None:
        pass


def live_progress(messages: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """A stream of JSON messages (value) -> the newest of each job in a batch, with `ended`; rows that are no messages go."""
    m = messages.select(F.from_json("value", PROGRESS).alias("m")).select("m.*").filter("job_id IS NOT NULL AND seq IS NOT NULL")
    return m.groupBy("job_id").transformWithStateInPandas(statefulProcessor=ProgressProcessor(ttl_ms), outputStructType=LIVE, outputMode="Append", timeMode="ProcessingTime" if ttl_ms else "None")


def follow(messages: DataFrame, jobs: list[int], each: Callable[[Row], None], checkpoint: str, seconds: float = 3600) -> set[int]:
    """Gives `each` the progress of some jobs and stops the query once all have ended, or the time is up; returns those that haven't.

    A job has one row a batch at most, so what the driver gets is bounded by the list. The query is stopped however this ends.
    """
    left, till = set(jobs), time.monotonic() + seconds

    def show(batch: DataFrame, _: int) -> None:
        for row in batch.filter(F.col("job_id").isin(jobs)).collect():
            if row["job_id"] in left:
                each(row)
            if row["ended"]:
                left.discard(row["job_id"])

    query = live_progress(messages).writeStream.foreachBatch(show).option("checkpointLocation", checkpoint).start()
    try:
        while left and time.monotonic() < till and not query.awaitTermination(0.2):
            pass
    finally:
        query.stop()
    return left


def to_messages(log: DataFrame) -> DataFrame:
    """Null fields are left out."""
    return log.select(F.to_json(F.struct("job_id", "seq", "status", "done", "total")).alias("value"))


class LockoutProcessor(StatefulProcessor):
    """Rows (user_id, event_id, at, failed) of a key in order -> (user_id, event_id, outcome)."""

    def __init__(self, rule: Lockout):
        self.rule = rule

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("lockout", "n int, last double, until double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = tuple(self.state.get()) if self.state.exists() else (0, 0.0, 0.0)
        got = pd.concat(list(rows)).sort_values(["at", "event_id"])
        out = []
        for event, at, failed in zip(got["event_id"], got["at"], got["failed"], strict=True):
            state, outcome = self.rule.step(state, float(at), bool(failed))
            out.append(outcome)
        self.state.update((int(state[0]), float(state[1]), float(state[2])))
        yield pd.DataFrame({"user_id": key[0], "event_id": got["event_id"], "outcome": out})

    def close(self) -> None:
        pass


LOCKOUT = "user_id long, event_id long, outcome string"


def lockout_stream(attempts: DataFrame, rule: Lockout | None = None) -> DataFrame:
    """A stream of attempts (user_id, event_id, at double, failed boolean) -> their outcome, with state by user."""
    return attempts.groupBy("user_id").transformWithStateInPandas(statefulProcessor=LockoutProcessor(rule or Lockout()), outputStructType=LOCKOUT, outputMode="Append", timeMode="None")


def lockout_batch(attempts: DataFrame, rule: Lockout | None = None) -> DataFrame:
    """The same over a table: a fold over each user's attempts in order."""
    return fold(attempts, ["user_id"], ["at", "event_id"], rule or Lockout(), "outcome").select("user_id", "event_id", "outcome")


def cooldown(requests: DataFrame, seconds: float = 60) -> DataFrame:
    """Requests (key, event_id, at) that go through: the first, and then the first after `seconds` from the last that did."""
    return fold(requests, ["key"], ["at", "event_id"], Cooldown(seconds), "passes").filter("passes").select("key", "event_id")


def run_available(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Drives a stream over what is there now and returns what it gave."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


def payload(row: dict) -> str:
    return json.dumps({k: v for k, v in row.items() if v is not None})
