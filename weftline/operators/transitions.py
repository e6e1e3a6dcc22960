"""Commands that change licences, each with its outcome, the audit row and the event for the cache.

A licence's commands act one after the other, each on what the one before left. The
licence itself comes first among its rows; the rest is a fold by licence (see `folds`), one shuffle for
commands and the licences that they name. Status, audit and events are columns of one outcome, so they can't disagree.

Outcomes: ok; conflict (suspended or revoked already, or an extension of a revoked licence); bad_state; bad_date (an end that is
null or not ahead); not_found; bad_kind. Only `ok` changes anything. Commands of one licence are in the order of (at, command_id);
those without a time are left out; repeated rows act again and get an outcome of their own.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions import scalars as S
from weftline.operators.folds import fold

# Fixed values.
EVENT_TYPES = {"activate": "activated", "suspend": "suspended", "revoke": "revoked", "extend": "extended", "expire": "expired"}
STATES = ["PENDING", "ACTIVE", "SUSPENDED", "REVOKED", "EXPIRED"]
KINDS = ["load", *EVENT_TYPES]
OUTCOME = pa.struct([("outcome", pa.string()), ("previous", pa.string()), ("status", pa.string()), ("old", pa.float64()), ("new", pa.float64())])
DAY = 86_400e6


class Transitions:
    """State: the licence's status by number (-1: no licence), its end in microseconds (nan: none), its term in days."""

    values, emits, start = ["kind_n", "micros", "until_n", "status_n", "days"], "struct<outcome:string,previous:string,status:string,old:double,new:double>", [-1.0, math.nan, 0.0]

    @staticmethod
    def step(status: int, end: float, days: float, kind: str, at: float, until: float) -> tuple[str, int, float]:
        """(outcome, status, end) of a command."""
        name = STATES[status] if status >= 0 else None
        if kind not in EVENT_TYPES:
            return "bad_kind", status, end
        if name is None:
            return "not_found", status, end
        if kind == "activate":
            return ("ok", 1, at + days * DAY if math.isnan(end) else end) if name == "PENDING" else ("bad_state", status, end)
        if kind == "suspend":
            return ("ok", 2, end) if name == "ACTIVE" else ("conflict" if name == "SUSPENDED" else "bad_state", status, end)
        if kind == "revoke":
            return ("conflict", status, end) if name == "REVOKED" else ("ok", 3, end)
        if kind == "extend":
            return ("conflict", status, end) if name == "REVOKED" else ("ok", status, until) if until > at else ("bad_date", status, end)
        return ("ok", 4, end) if name == "ACTIVE" and end < at else ("bad_state", status, end)

    def walk(self, state: list[float], kinds: np.ndarray, at: np.ndarray, until: np.ndarray, loaded: np.ndarray, days: np.ndarray) -> tuple[list[float], pa.Array]:
        status, end, term = int(state[0]), state[1], state[2]
        out = []
        for k, a, u, s, d in zip(kinds.tolist(), at.tolist(), until.tolist(), loaded.tolist(), days.tolist(), strict=True):
            if k == 0:
                status, end, term = s, u, d
                out.append(None)
                continue
            was, old = status, end
            outcome, status, end = self.step(status, end, term, KINDS[k] if k > 0 else "", a, u)
            name = lambda n: STATES[n] if n >= 0 else None
            out.append({"outcome": outcome, "previous": name(was), "status": name(status), "old": old, "new": end})
        return [float(status), end, term], pa.array(out, OUTCOME)


def _number(c: str, names: list[str]) -> Column:
    return F.coalesce((F.array_position(F.array(*map(F.lit, names)), F.col(c)) - 1).cast("int"), F.lit(-1))


def _micros(c: str) -> Column:
    return F.coalesce(F.unix_micros(F.col(c).cast("timestamp")).cast("double"), F.lit(math.nan))


def apply(licenses: DataFrame, commands: DataFrame) -> DataFrame:
    """Commands (license_id, command_id, kind, at, until, actor) -> what came of each.

    (license_id, command_id, at, kind, actor, outcome, previous, status, old_expired_at, expired_at).
    """
    named = licenses.join(commands.select(F.col("license_id").alias("id")), "id", "left_semi")
    term = F.coalesce(S.lookup(S.ACTIVATION_DAYS, F.col("tier"), "int"), F.lit(0)).cast("double")
    none = lambda c: F.lit(None).cast(commands.schema[c].dataType).alias(c)
    loads = named.select(F.col("id").alias("license_id"), none("command_id"), none("at"), none("kind"), none("actor"), F.lit(0).alias("kind_n"), F.lit(-math.inf).alias("micros"), _micros("expired_at").alias("until_n"), _number("status", STATES).alias("status_n"), term.alias("days"))
    told = F.when(F.col("kind").isin(list(EVENT_TYPES)), _number("kind", KINDS)).otherwise(-1)
    asked = commands.filter(F.col("at").isNotNull()).select("license_id", "command_id", "at", "kind", "actor", told.alias("kind_n"), _micros("at").alias("micros"), _micros("until").alias("until_n"), F.lit(-1).alias("status_n"), F.lit(0.0).alias("days"))
    done = fold(loads.unionByName(asked), ["license_id"], ["micros", "command_id"], Transitions(), "o", None, ("at", "kind", "actor")).filter("kind_n != 0")
    kind = commands.schema["at"].dataType
    time = lambda c: F.when(~F.isnan(c), F.timestamp_micros(F.col(c).cast("long")).cast(kind))
    return done.select("license_id", "command_id", "at", "kind", "actor", "o.outcome", "o.previous", "o.status", time("o.old").alias("old_expired_at"), time("o.new").alias("expired_at"))


def audit(outcomes: DataFrame) -> DataFrame:
    """A row for each change: who did what to which licence, and what was there before."""
    return outcomes.filter("outcome = 'ok'").select("license_id", "command_id", "at", S.lookup(EVENT_TYPES, F.col("kind")).alias("event_type"), "actor", F.col("previous").alias("previous_status"), "old_expired_at", F.col("expired_at").alias("new_expired_at"))


def cache_events(outcomes: DataFrame) -> DataFrame:
    """(license_id, command_id, event, ttl): suspended, revoked and expired licences leave the cache; an active one that is extended gets a new life in seconds."""
    event = F.when(F.col("kind").isin("suspend", "revoke", "expire"), "evict").when((F.col("kind") == "extend") & (F.col("status") == "ACTIVE"), "refresh")
    return outcomes.filter("outcome = 'ok'").withColumn("event", event).filter("event IS NOT NULL").select("license_id", "command_id", "event", F.when(F.col("event") == "refresh", S.ttl_seconds(F.col("expired_at"), F.col("at"))).alias("ttl"))


def current(licenses: DataFrame, outcomes: DataFrame, order: tuple[str, ...] = ("at", "command_id")) -> DataFrame:
    """Licences as the outcomes leave them: the last change of each counts."""
    last = outcomes.filter("outcome = 'ok'").groupBy(F.col("license_id").alias("__id")).agg(F.max_by(F.struct("status", "expired_at"), F.struct(*order)).alias("__last"))
    changed = licenses.join(last, licenses["id"] == last["__id"], "left")
    of = lambda c: F.when(F.col("__id").isNull(), F.col(c)).otherwise(F.col(f"__last.{c}")).alias(c)
    return changed.select(*[of(c) if c in ("status", "expired_at") else F.col(c) for c in licenses.columns])
