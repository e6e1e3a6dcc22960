"""Licence commands against a plain loop, and as a stream with a replay."""

import datetime as dt
import random

from weftline.operators import transitions as tr
from weftline.streaming import ledger

DAY = dt.timedelta(days=1)
T0 = dt.datetime(2024, 1, 1)
LICENSES = "id long, tier string, status string, expired_at timestamp_ntz"
COMMANDS = "license_id long, command_id long, kind string, at timestamp_ntz, until timestamp_ntz, actor string"


def given(seed=1, n=300):
    rng = random.Random(seed)
    licenses = [(i, rng.choice(["TRIAL", "PRO", "ENTERPRISE", None]), rng.choice(tr.STATES), rng.choice([None, T0 + DAY * rng.randrange(30)])) for i in range(12)]
    kinds = [*tr.EVENT_TYPES, "activate", "extend", "extend", "load", "other", None]
    commands = [(rng.choice([0, 0, 0, *range(14)]), c, rng.choice(kinds), T0 + DAY * rng.randrange(20), rng.choice([None, T0 + DAY * rng.randrange(40)]), f"a{c % 3}") for c in range(n)]
    return licenses, [*commands, (1, n, "revoke", None, None, "a")]


def expected(licenses, commands):
    now, out = {i: [tier, status, end] for i, tier, status, end in licenses}, {}
    for i, c, kind, at, until, _ in sorted((x for x in commands if x[3]), key=lambda x: (x[3], x[1])):
        tier, status, end = was = now.get(i, [None] * 3)
        result, new, to = "ok", status, end
        if kind not in tr.EVENT_TYPES:
            result = "bad_kind"
        elif i not in now:
            result = "not_found"
        elif kind == "activate" and status == "PENDING":
            new, to = "ACTIVE", end or at + DAY * {"TRIAL": 30, "PRO": 365, "ENTERPRISE": 730, None: 0}[tier]
        elif kind == "suspend" and status in ("ACTIVE", "SUSPENDED"):
            result, new = ("ok", "SUSPENDED") if status == "ACTIVE" else ("conflict", status)
        elif kind == "revoke":
            result, new = ("conflict", status) if status == "REVOKED" else ("ok", "REVOKED")
        elif kind == "extend":
            result = "conflict" if status == "REVOKED" else "ok" if until and until > at else "bad_date"
            to = until if result == "ok" else end
        elif kind == "expire" and status == "ACTIVE" and end and end < at:
            new = "EXPIRED"
        else:
            result = "bad_state"
        out[c] = (result, was[1], new, end, to)
        if i in now:
            now[i] = [tier, new, to]
    return out, {i: tuple(v[1:]) for i, v in now.items()}


def table(rows):
    return {r.command_id: (r.outcome, r.previous, r.status, r.old_expired_at, r.expired_at) for r in rows}


def test_commands_audit_and_events(spark):
    licenses, commands = given()
    want, end = expected(licenses, commands)
    assert {w[0] for w in want.values()} == {"ok", "conflict", "bad_state", "bad_date", "not_found", "bad_kind"}
    df, of = spark.createDataFrame(licenses, LICENSES), spark.createDataFrame(commands, COMMANDS)
    got = tr.apply(df, of)
    assert table(got.collect()) == want
    assert {r.id: (r.status, r.expired_at) for r in tr.current(df, got).collect()} == end
    changes = {c for c, w in want.items() if w[0] == "ok"}
    rows = tr.audit(got).collect()
    assert {r.command_id for r in rows} == changes and len(rows) == len(changes)
    by = {c[1]: c for c in commands}
    assert all((r.event_type, r.actor, r.previous_status) == (tr.EVENT_TYPES[by[r.command_id][2]], by[r.command_id][5], want[r.command_id][1]) for r in rows)
    for r in tr.cache_events(got).collect():
        kind, _, _, at, *_ = by[r.command_id][2:3] + (None, None) + by[r.command_id][3:4]
        assert (r.event, r.ttl) == (("refresh", int((want[r.command_id][4] - at).total_seconds())) if kind == "extend" else ("evict", None))
    assert tr.apply(df, of.limit(0)).collect() == [] and {r.outcome for r in tr.apply(df.limit(0), of).collect()} == {"not_found", "bad_kind"}


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    licenses, commands = given(2, 120)
    commands = sorted((c for c in commands if c[3]), key=lambda c: (c[3], c[1]))
    df, path, source = spark.createDataFrame(licenses, LICENSES), str(tmp_path / "ledger"), str(tmp_path / "in")
    for part in (commands[:50], commands[50:]):
        spark.createDataFrame(part, COMMANDS).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(COMMANDS).parquet(source)
        ledger.run(df, stream, path, str(tmp_path / "cp")).awaitTermination()
    want, end = expected(licenses, commands)
    read = lambda: (table(ledger.outcomes(df, path).collect()), {r.id: (r.status, r.expired_at) for r in ledger.current(df, path).collect()})
    assert read() == (want, end)
    ledger.write_batch(df, spark.createDataFrame(commands[50:], COMMANDS), path, 1)
    assert read() == (want, end)
