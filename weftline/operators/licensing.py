"""Licences, entitlements and the states that they pass through. `now` is always given."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import scalars as S
from weftline.functions import text as T

SORTS = {"issued_at": "issued_at", "expired_at": "expired_at", "tier": "tier_rank", "status": "state_rank"}


def search(licenses: DataFrame, tier: str | None = None, status: str | None = None, text: str | None = None, since: Column | None = None, until: Column | None = None) -> DataFrame:
    """Conjunction of the filters that are given. `text` matches hash or customer id; % and _ in it are wildcards."""
    tests = []
    if tier is not None:
        tests.append(F.col("tier") == tier)
    if status is not None:
        tests.append(F.col("status") == status)
    if text:
        tests.append(F.col("key_hash").ilike(f"%{text}%") | F.col("customer_id").cast("string").ilike(f"%{text}%"))
    if since is not None:
        tests.append(F.col("issued_at") >= since)
    if until is not None:
        tests.append(F.col("issued_at") <= until)
    return licenses.filter(reduce(lambda a, b: a & b, tests)) if tests else licenses


def page(rows: DataFrame, number: int, size: int, sort_by: str = "issued_at", direction: str = "desc") -> DataFrame:
    """An offset page. Enumerations sort by their declared order; nulls are last ascending and first descending; ids break ties."""
    rows = rows.withColumns({"tier_rank": S.tier_rank(F.col("tier")), "state_rank": S.state_rank(F.col("status"))})
    c = F.col(SORTS.get(sort_by, "issued_at"))
    rows = rows.orderBy(c.asc_nulls_last() if direction == "asc" else c.desc_nulls_first(), "id")
    return rows.offset((number - 1) * size).limit(size).drop("tier_rank", "state_rank")


def with_owner(licenses: DataFrame, users: DataFrame) -> DataFrame:
    """Adds the owner's address, or the id where there is none."""
    u = users.select(F.col("id").alias("uid"), "email")
    return licenses.join(u, F.col("customer_id") == F.col("uid"), "left").withColumn("owner", F.coalesce("email", F.col("customer_id").cast("string"))).drop("uid", "email")


def entitlement(users: DataFrame, licenses: DataFrame) -> DataFrame:
    """(id, tier): the best active licence's, superusers have the highest, null without one. Ends are not looked at."""
    best = licenses.filter((F.col("status") == "ACTIVE") & (S.tier_rank(F.col("tier")) > 0)).groupBy("customer_id").agg(F.max_by("tier", S.tier_rank(F.col("tier"))).alias("best"))
    out = users.join(best, F.col("id") == F.col("customer_id"), "left")
    return out.select("id", F.when(F.col("is_superuser"), S.TIERS[-1]).otherwise(F.col("best")).alias("tier"))


def quota(users: DataFrame, jobs: DataFrame, now: Column) -> DataFrame:
    """(user_id, used) since the first instant of now's month, up to now."""
    month = jobs.filter((F.col("created_at") >= S.month_start(now).cast("timestamp_ntz")) & (F.col("created_at") <= now))
    used = month.groupBy("user_id").agg(F.count(F.lit(1)).alias("used"))
    return users.join(used, F.col("id") == F.col("user_id"), "left").select(F.col("id").alias("user_id"), F.coalesce("used", F.lit(0)).cast("long").alias("used"))


def summary(users: DataFrame, licenses: DataFrame, jobs: DataFrame, now: Column) -> DataFrame:
    """Tier, limits, use and what is left (null: without limit)."""
    out = entitlement(users, licenses).join(quota(users, jobs, now), F.col("id") == F.col("user_id")).drop("user_id")
    limit = S.lookup(S.MONTHLY_QUOTA, F.col("tier"), "int")
    return out.withColumns({"max_bytes": S.lookup(S.MAX_BYTES, F.col("tier"), "bigint"), "quota": limit, "left": F.greatest(F.lit(0), limit - F.col("used"))})


def reconcile(licenses: DataFrame, now: Column, batch: int = 500) -> dict[str, DataFrame]:
    """The nightly run: `licenses` after it, `audit` rows, `warnings` for the coming week, and its `summary`.

    Set-based: what a transactional run does in windows is one projection; the number of
    windows is reported only.
    """
    due = (F.col("status") == "ACTIVE") & F.coalesce(F.col("expired_at") < now, F.lit(False))
    after = licenses.withColumn("status", F.when(due, "EXPIRED").otherwise(F.col("status")))
    audit = licenses.filter(due).select(F.col("id").alias("license_id"), F.lit("expired").alias("event_type"), F.col("status").alias("previous"))
    soon = licenses.filter((F.col("status") == "ACTIVE") & (F.col("expired_at") > now) & (F.col("expired_at") <= S.plus_days(now, F.lit(S.EXPIRY_WARNING_DAYS))))
    warnings = soon.select(F.col("id").alias("license_id"), S.days_left(F.col("expired_at"), now).alias("days_left"))
    n = F.count_if(due)
    return {"licenses": after, "audit": audit, "warnings": warnings, "summary": licenses.agg(n.alias("expired"), F.ceil(n / batch).cast("long").alias("batches"))}


def suspend(licenses: DataFrame, ids: list) -> DataFrame:
    """(id, outcome, status) of the ids that exist; if any can't be suspended, all keep their status.

    Outcomes: ok, conflict (suspended already), bad_state.
    """
    hit = licenses.filter(F.col("id").isin(ids))
    outcome = F.when(F.col("status") == "ACTIVE", "ok").when(F.col("status") == "SUSPENDED", "conflict").otherwise("bad_state")
    hit = hit.withColumn("outcome", outcome)
    failed = F.broadcast(hit.agg(F.coalesce(F.bool_or(F.col("outcome") != "ok"), F.lit(False)).alias("failed")))
    return hit.join(failed).select("id", "outcome", F.when(~F.col("failed"), "SUSPENDED").otherwise(F.col("status")).alias("status"))


def revoke(licenses: DataFrame, ids: list) -> DataFrame:
    """(id, outcome, previous, status): any state but revoked."""
    hit = licenses.filter(F.col("id").isin(ids))
    return hit.select("id", F.when(F.col("status") == "REVOKED", "conflict").otherwise("ok").alias("outcome"), F.col("status").alias("previous"), F.lit("REVOKED").alias("status"))


def extend(licenses: DataFrame, ids: list, until: Column, now: Column) -> DataFrame:
    """(id, outcome, expired_at, ttl): the new end lies ahead and the state stays as it is."""
    ok = (F.col("status") != "REVOKED") & (until > now)
    hit = licenses.filter(F.col("id").isin(ids))
    return hit.select("id", F.when(ok, "ok").when(F.col("status") == "REVOKED", "conflict").otherwise("bad_date").alias("outcome"), F.when(ok, until).otherwise(F.col("expired_at")).alias("expired_at"), F.when(ok, S.ttl_seconds(until, now)).alias("ttl"))


def activate(licenses: DataFrame, attempts: DataFrame, now: Column) -> DataFrame:
    """(license_id, winner, outcome, expired_at): of attempts (license_id, device, ts) the first wins if the licence is pending.

    A preset end is kept; else the tier's term counts from now.
    """
    first = attempts.groupBy("license_id").agg(F.min_by("device", F.struct("ts", "device")).alias("winner"))
    out = first.join(licenses, F.col("license_id") == F.col("id"))
    ok = F.col("status") == "PENDING"
    end = F.coalesce("expired_at", S.plus_days(now, S.lookup(S.ACTIVATION_DAYS, F.col("tier"), "int")))
    return out.select("license_id", F.when(ok, F.col("winner")).alias("winner"), F.when(ok, "ok").otherwise("bad_state").alias("outcome"), F.when(ok, end).otherwise(F.col("expired_at")).alias("expired_at"))


def first_by_key(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Replays of an idempotency key return the first row; rows without a key are all kept."""
    keyed = rows.filter(F.col(key).isNotNull()).withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("__n = 1").drop("__n")
    return keyed.unionByName(rows.filter(F.col(key).isNull()))


def request_path_checked(path: Column, excluded: list[str], prefix: str = "/v1/") -> Column:
    return path.startswith(prefix) & ~F.exists(F.array(*map(F.lit, excluded)), lambda p: path.startswith(p))


def listing(licenses: DataFrame) -> DataFrame:
    """What a client sees: names of tier and state, a masked key."""
    return licenses.select("id", S.tier_name(F.col("tier")).alias("tier"), F.lower("status").alias("status"), T.mask_key(F.col("key_hash")).alias("key"))
