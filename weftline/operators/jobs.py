"""Jobs: recent ones, admission, notifications, charts, and the latest state of an event log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import scalars as S

TERMINAL = ["done", "failed", "needs_review"]
REVIEWABLE = ["done", "needs_review"]


def recent(jobs: DataFrame, n: int = 50) -> DataFrame:
    return jobs.orderBy(F.desc("created_at"), F.desc("id")).limit(n)


def first_failure(*checks: tuple[Column, str]) -> Column:
    """The name of the first check that fails, null if none does. A null check counts as failed."""
    return F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for ok, name in checks])


def admission(uploads: DataFrame, targets: list[str]) -> DataFrame:
    """Adds `error` to uploads (tier, scanned, has_glossary, declared, ext, target, used)."""
    limit = S.lookup(S.MAX_BYTES, F.col("tier"), "bigint")
    quota = S.lookup(S.MONTHLY_QUOTA, F.col("tier"), "int")
    return uploads.withColumn("error", first_failure(
        (F.col("tier").isNotNull(), "no_license"),
        (~F.col("scanned") | (F.col("tier") != "TRIAL"), "ocr_not_allowed"),
        (~F.col("has_glossary") | (F.col("tier") != "TRIAL"), "glossary_not_allowed"),
        (F.col("declared") <= limit, "too_large"),
        (F.col("ext").isin("docx", "pptx", "pdf"), "bad_format"),
        (F.col("target").isin(targets), "bad_target"),
        (quota.isNull() | (F.col("used") < quota), "quota"),
    ))


def login(attempts: DataFrame) -> DataFrame:
    """Adds `outcome`: lockout, then credentials, then account state."""
    why = first_failure((~F.col("locked"), "locked"), (F.col("password_ok"), "bad_credentials"), (F.col("is_active"), "inactive"), (F.col("verified"), "unverified"))
    return attempts.withColumn("outcome", F.coalesce(why, F.lit("ok")))


def notifications(jobs: DataFrame, licenses: DataFrame, users: DataFrame, now: Column, n: int = 10) -> DataFrame:
    """(user_id, kind, ref, age): the user's ten latest jobs that ended, licences that end within a week or have ended, or that there is none.

    The limit on jobs comes before the filter on their state. Licence rows come first;
    ages rank by unit and then by their text, as they are shown.
    """
    w = Window.partitionBy("user_id").orderBy(F.desc("created_at"), F.desc("id"))
    ended = jobs.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= 10).filter(F.col("status").isin("done", "failed"))
    of_jobs = ended.select("user_id", F.concat(F.lit("job_"), "status").alias("kind"), F.col("id").cast("string").alias("ref"), S.relative_age(F.col("created_at"), now).alias("age"))
    active = licenses.filter(F.col("status") == "ACTIVE")
    ending = active.filter(F.col("expired_at") <= S.plus_days(now, F.lit(S.EXPIRY_WARNING_DAYS)))
    of_licenses = ending.select(F.col("customer_id").alias("user_id"), F.lit("license_expiring").alias("kind"), F.col("id").cast("string").alias("ref"), F.concat(S.days_left(F.col("expired_at"), now).cast("string"), F.lit(" days left")).alias("age"))
    none = users.join(active, users.id == active.customer_id, "left_anti").select(F.col("id").alias("user_id"), F.lit("no_license").alias("kind"), F.lit("").alias("ref"), F.lit("").alias("age"))
    rank = F.when(F.col("kind").isin("license_expiring", "no_license"), 0).when(F.col("age").endswith("m ago"), 1).when(F.col("age").endswith("h ago"), 2).when(F.col("age").endswith("d ago"), 3).otherwise(4)
    rows = of_jobs.unionByName(of_licenses).unionByName(none).withColumn("rank", rank)
    top = Window.partitionBy("user_id").orderBy("rank", "age", "kind", "ref")
    return rows.withColumn("place", F.row_number().over(top)).filter(F.col("place") <= n).drop("rank")


def monthly(jobs: DataFrame, now: Column, months: int = 6, words: int = 1200) -> DataFrame:
    """(month, jobs, words) of done jobs in the last months, zeros included; months are half open."""
    spine = jobs.sparkSession.range(months).select(F.add_months(F.date_trunc("month", now).cast("date"), -F.col("id").cast("int")).alias("month"))
    done = jobs.filter(F.col("status") == "done").groupBy(F.date_trunc("month", "created_at").cast("date").alias("m")).agg(F.count(F.lit(1)).alias("n"))
    return spine.join(done, F.col("month") == F.col("m"), "left").select(F.date_format("month", "yyyy-MM").alias("month"), F.coalesce("n", F.lit(0)).cast("long").alias("jobs"), (F.coalesce("n", F.lit(0)) * words).cast("long").alias("words"))


def latest_state(log: DataFrame, key: str, state: str, order: list[str]) -> DataFrame:
    """The last state of each key in an event log; any state may follow any other."""
    return log.groupBy(key).agg(F.max_by(state, F.struct(*order)).alias(state), F.count(F.lit(1)).alias("events"))


def progress(batches: DataFrame) -> DataFrame:
    """Running share of done segments over (job_id, batch, done, total)."""
    w = Window.partitionBy("job_id").orderBy("batch").rowsBetween(Window.unboundedPreceding, 0)
    return batches.withColumn("so_far", F.sum("done").over(w)).withColumn("share", F.col("so_far") / F.col("total"))


def members(users: DataFrame, workspace: int) -> DataFrame:
    """The workspace's owner and those who belong to it, with their role."""
    hit = users.filter((F.col("id") == workspace) | (F.col("workspace_id") == workspace))
    return hit.select("id", "email", F.when(F.col("id") == workspace, "owner").otherwise("member").alias("role"))


def fail_sessions(fails: DataFrame, gap: int, key: str = "user_id") -> DataFrame:
    """Failures in sessions that end after `gap` seconds without one; a failure exactly `gap` later starts a new session."""
    w = Window.partitionBy(key).orderBy("ts", "event_id")
    far = S.seconds_between(F.col("ts"), F.lag("ts").over(w)) >= gap
    s = fails.withColumn("session", F.sum(F.coalesce(far, F.lit(True)).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return s.groupBy(key, "session").agg(F.count(F.lit(1)).alias("fails"), F.min("ts").alias("started"), F.max("ts").alias("ended"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """`old` with the columns of matching rows in `new` where these are not null."""
    changes = new.select(*keys, *[F.col(c).alias(f"__{c}") for c in columns])
    return old.join(changes, keys, "left").withColumns({c: F.coalesce(f"__{c}", c) for c in columns}).drop(*[f"__{c}" for c in columns])


def insert_missing(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return old.unionByName(new.join(old, keys, "left_anti"))


def cascade(child: DataFrame, deleted: DataFrame, on: str, key: str = "id", keep: bool = False) -> DataFrame:
    """Rows of a child table after its parents went: gone too, or (`keep`) with a null reference."""
    gone = deleted.select(F.col(key).alias("__gone")).distinct()
    if not keep:
        return child.join(gone, F.col(on) == F.col("__gone"), "left_anti")
    return child.join(gone, F.col(on) == F.col("__gone"), "left").withColumn(on, F.when(F.col("__gone").isNull(), F.col(on))).drop("__gone")
