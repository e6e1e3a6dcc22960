"""Accounts: search, tokens, keys, invitations, preferences, and the guards of an administrator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import text as T


def search(users: DataFrame, text: str | None = None, admin: bool | None = None, active: bool | None = None) -> DataFrame:
    """Accounts that aren't deleted; each filter applies if it is given. % and _ in the text are wildcards."""
    out = users.filter(F.col("deleted_at").isNull())
    if text:
        out = out.filter(F.col("email").ilike(f"%{text}%") | F.col("name").ilike(f"%{text}%"))
    if admin is not None:
        out = out.filter(F.col("is_superuser") == admin)
    if active is not None:
        out = out.filter(F.col("is_active") == active)
    return out


def page(users: DataFrame, number: int, size: int) -> DataFrame:
    return users.orderBy(F.desc("created_at"), F.desc("id")).offset((number - 1) * size).limit(size)


def usable_tokens(tokens: DataFrame, now: Column) -> DataFrame:
    """Unused, and not past their end (the end itself still counts)."""
    return tokens.filter(F.col("used_at").isNull() & (F.col("expires_at") >= now))


def replace_tokens(tokens: DataFrame, now: Column) -> DataFrame:
    """When a user asks again, all unused tokens but the latest count as used."""
    latest = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("created_at"), F.desc("id"))) == 1
    return tokens.withColumn("__l", latest).withColumn("used_at", F.when(F.col("used_at").isNull() & ~F.col("__l"), now).otherwise(F.col("used_at"))).drop("__l")


def live_keys(keys: DataFrame) -> DataFrame:
    return keys.filter(F.col("revoked_at").isNull()).orderBy(F.desc("created_at"), F.desc("id"))


def pending_invites(invites: DataFrame, now: Column) -> DataFrame:
    """Pending and strictly before their end."""
    return invites.filter((F.col("status") == "pending") & (F.col("expires_at") > now))


def preferences(stored: Column, defaults: dict[str, str]) -> Column:
    """map<string,string> with each default where nothing is stored; a stored null counts as nothing."""
    d = F.create_map(*[F.lit(x) for kv in defaults.items() for x in kv])
    known = F.transform_values(d, lambda k, v: F.coalesce(F.try_element_at(stored, k), v))
    return F.coalesce(known, d)


def patched(stored: Column, patch: Column) -> Column:
    """A shallow merge: the patch's keys replace the stored ones."""
    empty = F.create_map().cast("map<string,string>")
    return F.map_zip_with(F.coalesce(stored, empty), F.coalesce(patch, empty), lambda k, a, b: F.coalesce(b, a))


def soft_delete(users: DataFrame, ids: list, now: Column) -> DataFrame:
    """Deleting again changes nothing."""
    hit = F.col("id").isin(ids) & F.col("deleted_at").isNull()
    return users.withColumns({"is_active": F.when(hit, False).otherwise(F.col("is_active")), "deleted_at": F.when(hit, now).otherwise(F.col("deleted_at"))})


def guard(users: DataFrame, changes: DataFrame) -> DataFrame:
    """Outcome of changes (actor, target, action: demote, deactivate or delete): own account, last administrator, unknown, ok."""
    admins = users.agg(F.count_if(F.col("is_superuser") & F.col("is_active") & F.col("deleted_at").isNull()).alias("admins"))
    known = users.select(F.col("id").alias("target"), "is_superuser", F.col("is_active").alias("was_active"))
    out = changes.join(known, "target", "left").join(F.broadcast(admins))  # one row
    last = F.col("is_superuser") & F.col("was_active") & (F.col("admins") <= 1)
    outcome = F.when(F.col("is_superuser").isNull(), "not_found").when(F.col("actor") == F.col("target"), "own_account").when(last, "last_admin").otherwise("ok")
    return out.select("actor", "target", "action", outcome.alias("outcome"))


def validated_terms(terms: DataFrame) -> DataFrame:
    """Terms to store, trimmed, with `error`: too short, or taken by an earlier row of the glossary."""
    t = terms.withColumns({c: T.strip(F.col(c)) for c in ("source_term", "target_term")})
    first = F.row_number().over(Window.partitionBy("glossary_id", "source_term").orderBy("id")) == 1
    short = (F.length("source_term") < 2) | (F.length("target_term") < 2)
    return t.withColumn("error", F.when(short, "too_short").when(~first, "duplicate"))
