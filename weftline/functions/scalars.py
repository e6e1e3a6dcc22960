"""Dates, licence vocabulary and layout arithmetic as columns. The clock is always an argument."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Order and vocabulary of licence tiers and states, limits and terms of plans.
TIERS = ["TRIAL", "PRO", "ENTERPRISE"]
STATES = ["PENDING", "ACTIVE", "EXPIRED", "SUSPENDED", "REVOKED"]
TIER_NAMES = {"TRIAL": "starter", "PRO": "professional", "ENTERPRISE": "enterprise"}
MAX_BYTES = {"TRIAL": 5 << 20, "PRO": 50 << 20, "ENTERPRISE": 100 << 20}
MONTHLY_QUOTA = {"TRIAL": 10}
ACTIVATION_DAYS = {"TRIAL": 30, "PRO": 365, "ENTERPRISE": 730}
PLANS = {"free": ("TRIAL", 1, 14), "pro": ("PRO", 3, 365), "business": ("ENTERPRISE", 10, 365)}
FEATURES = {
    "TRIAL": ["Document translation (DOCX, PDF, PPTX)", "Up to 1 device", "14-day validity"],
    "PRO": ["Document translation (DOCX, PDF, PPTX)", "Up to 3 devices", "Glossary / terminology support", "365-day validity"],
    "ENTERPRISE": ["Document translation (DOCX, PDF, PPTX)", "Up to 10 devices", "Glossary / terminology support", "Priority processing", "365-day validity"],
}
EXPIRY_WARNING_DAYS = 7


def literal_map(values: dict, kind: str) -> Column:
    return F.create_map(*[x for k, v in values.items() for x in (F.lit(k), F.lit(v))]).cast(f"map<string,{kind}>")


def lookup(values: dict, key: Column, kind: str = "string") -> Column:
    return F.try_element_at(literal_map(values, kind), key)


def tier_rank(c: Column) -> Column:
    """Place in the declared order from 1; 0 for an unknown tier, which loses against any."""
    return F.array_position(F.array(*map(F.lit, TIERS)), c)


def state_rank(c: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, STATES)), c)


def tier_name(c: Column) -> Column:
    return F.coalesce(lookup(TIER_NAMES, c), F.lit("unknown"))


def tier_from_name(c: Column) -> Column:
    return F.coalesce(lookup({v: k for k, v in TIER_NAMES.items()}, c), F.raise_error(F.concat(F.lit("unknown tier "), c)).cast("string"))


def features(tier: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[x for k, v in FEATURES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))]), F.upper(tier)), F.array().cast("array<string>"))


def month_start(now: Column) -> Column:
    return F.date_trunc("month", now)


def plus_days(ts: Column, days: Column) -> Column:
    return ts + F.make_dt_interval(days)


def seconds_between(later: Column, earlier: Column) -> Column:
    """Microseconds count; works for timestamps with and without zone."""
    return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / 1_000_000


def ttl_seconds(expires: Column, now: Column, least: int = 0) -> Column:
    return F.greatest(F.lit(least), F.floor(seconds_between(expires, now)).cast("long"))


def days_left(expires: Column, now: Column, round_up: bool = False) -> Column:
    """Whole days, down as a server does or up as a banner does."""
    return (F.ceil if round_up else F.floor)(seconds_between(expires, now) / 86400).cast("long")


def relative_age(ts: Column, now: Column) -> Column:
    s = F.floor(seconds_between(now, ts)).cast("long")
    ago = lambda n, unit: F.concat((s / n).cast("long").cast("string"), F.lit(unit + " ago"))
    return F.when(s < 60, "just now").when(s < 3600, ago(60, "m")).when(s < 86400, ago(3600, "h")).otherwise(ago(86400, "d"))


def parse_iso(c: Column) -> Column:
    """ISO time whose plus sign a form may have turned into a space; null if it isn't one."""
    return F.try_to_timestamp(F.regexp_replace(F.replace(c, F.lit("Z"), F.lit("+00:00")), r" (\d\d:\d\d)$", "+$1"))


def license_valid(state: Column, expires: Column, now: Column) -> Column:
    """At request time: active, and without an end or before it."""
    return (state == "ACTIVE") & (expires.isNull() | (expires > now))


def backoff(attempt: Column, base: float = 2.0) -> Column:
    return F.pow(F.lit(base), attempt + 1)


def expansion_ratio(source: Column, target: Column) -> Column:
    return F.when(F.length(source) > 0, F.length(target) / F.length(source))


def shrink(source: Column, target: Column, height: Column) -> Column:
    """`none`, `auto_adjusted` or `overflow` for a text frame of this height."""
    ratio = F.length(target) / F.greatest(F.length(source), F.lit(1))
    return F.when((ratio <= 1) | (height == 0), "none").when(1 / ratio >= 0.7, "auto_adjusted").otherwise("overflow")


ASPECT, LINE = 0.5, 1.2


def fit_scale(chars: Column, width: Column, height: Column, size: Column) -> Column:
    """The largest scale at which the characters fit: on one line if the box is lower than a line, else wrapped."""
    one_line = F.least(width / (chars * size * ASPECT), height / (size * LINE))
    wrapped = F.sqrt(width * height / (chars * size * size * (ASPECT * LINE)))
    return F.when((chars <= 0) | (width <= 0) | (height <= 0) | (size <= 0), 1.0).when(height < size * LINE, one_line).otherwise(wrapped)


def font_size(chars: Column, width: Column, height: Column, hint: Column) -> Column:
    """The first of 24, 18, 14, 10 and 8 points, none above the hint, at which wrapped lines fit; 8 if none does."""
    sizes = F.array(*[F.lit(float(x)) for x in (24, 18, 14, 10, 8)])
    lines = lambda s: F.ceil(chars / F.greatest(F.lit(1), F.floor(width / (s * ASPECT))))
    return F.coalesce(F.get(F.filter(sizes, lambda s: (s <= hint) & (lines(s) * s * LINE <= height)), F.lit(0)), F.lit(8.0))


def heading_level(size: Column, body: Column) -> Column:
    return F.when(body <= 0, 0).when(size / body >= 1.8, 1).when(size / body >= 1.4, 2).otherwise(0)


def bounds(polygon: Column, width: Column, height: Column) -> Column:
    """array<struct<x,y>> -> x0, y0, x1, y1 as parts of the page, kept within it."""
    part = lambda f, name, by: F.greatest(F.lit(0.0), F.least(F.lit(1.0), f(F.transform(polygon, lambda q: q[name])) / by))
    return F.array(part(F.array_min, "x", width), part(F.array_min, "y", height), part(F.array_max, "x", width), part(F.array_max, "y", height))


def points_to_mm(c: Column) -> Column:
    return c * 25.4 / 72


def emu_to_points(c: Column) -> Column:
    return c / 12700


def at_dpi(c: Column, dpi: Column) -> Column:
    return c * dpi / 72
