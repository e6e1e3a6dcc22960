"""Text functions as columns. Patterns are Unicode-aware; lengths are in code points."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, MapType, StringType, StructField, StructType

#: Java's classes are ASCII unless a pattern asks for Unicode.
U = "(?U)"


def strip(c: Column) -> Column:
    """Without white space at both ends, of any Unicode kind."""
    return F.regexp_replace(c, U + r"^\s+|\s+$", "")


def is_digits(c: Column) -> Column:
    """All characters are digits, superscripts and the like included; false for an empty text."""
    return c.rlike(r"^[\p{Nd}²³¹⁰⁴-⁹₀-₉①-⑨⑴-⑼⒈-⒐]+$")


def is_passthrough(c: Column) -> Column:
    """Blank, or nothing but digits: not worth translating."""
    s = strip(c)
    return (s == "") | is_digits(s)


def segment_id(text: Column, position: Column) -> Column:
    """The first 16 hexadecimal digits of SHA-256 over text, a zero byte and position."""
    return F.substring(F.sha2(F.concat(text, F.lit("\x00"), position), 256), 1, 16)


def key_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def is_license_key(c: Column) -> Column:
    return c.rlike("^[A-Z2-7]{4}(-[A-Z2-7]{4}){3}$")


def format_key(c: Column) -> Column:
    """Typed key -> up to four groups of four upper-case alphanumerics."""
    groups = F.regexp_extract_all(F.upper(F.regexp_replace(c, "[^A-Za-z0-9]", "")), F.lit(".{1,4}"), F.lit(0))
    return F.array_join(F.slice(groups, 1, 4), "-")


def mask_key(digest: Column) -> Column:
    """All but the last four digits of a key's hash."""
    return F.concat(F.lit("****-****-****-"), F.when(F.length(digest) >= 4, F.upper(F.right(digest, F.lit(4)))).otherwise("????"))


def is_ascii(c: Column) -> Column:
    return ~c.rlike(r"[^\x00-\x7F]")


def contains_ci(haystack: Column, needle: Column) -> Column:
    return F.contains(F.lower(haystack), F.lower(needle))


def path_part(position: Column, n: int = 2) -> Column:
    """The n-th dotted part as an integer, null if it isn't one."""
    return F.split_part(position, F.lit("."), F.lit(n)).try_cast("int")


def composed(s: pa.Array) -> pa.Array:
    plain = pc.fill_null(pc.string_is_ascii(s), True)
    if pc.all(plain).as_py() is not False:
        return s
    made = pa.array([unicodedata.normalize("NFC", x) for x in s.filter(pc.invert(plain)).to_pylist()], s.type)
    return pc.replace_with_mask(s, pc.invert(plain), made)


@F.arrow_udf(StringType())
def nfc(s: pa.Array) -> pa.Array:
    """Canonical composition; Spark has no built-in for it. ASCII is composed as it is."""
    return composed(s)


# Patterns of what a translation must not change, in the order in which they are masked.
PROTECTED = [
    r"https?://\S+",
    r"[\w.+-]+@[\w.-]+\.\w{2,}",
    r"\{\{[^}]+\}\}",
    r"\$\{[^}]+\}",
    r"<%=?\s*[^%]+%>",
    r"\d{4}-\d{2}-\d{2}(?:T[\d:Z.+\-]+)?",
    r"v\d+\.\d+[\.\d\w\-]*",
    r"</?[a-zA-Z][^>]*>",
]
MARK = "⟦T(\\d+)⟧"


def mask(text: str) -> tuple[str, dict[int, str]]:
    """Protected parts become numbered marks, pattern after pattern over the text as masked so far."""
    kept: dict[int, str] = {}

    def put(m: re.Match) -> str:
        kept[len(kept)] = m.group()
        return f"⟦T{len(kept) - 1}⟧"

    for p in PROTECTED:
        text = re.sub(p, put, text)
    return text, kept


@F.pandas_udf(StructType([StructField("masked", StringType()), StructField("tokens", MapType(IntegerType(), StringType()))]))
def mask_protected(s: pd.Series) -> pd.DataFrame:
    """struct(masked, tokens): numbering runs through all patterns, which needs a function."""
    out = [(None, None) if t is None else mask(t) for t in s]
    return pd.DataFrame({"masked": [o[0] for o in out], "tokens": [o[1] for o in out]})


def restore(masked: Column, tokens: Column) -> Column:
    """Marks become what they stand for; a mark of an unknown number stays. Later tokens first, so that a token that holds a mark is opened in turn."""
    entries = F.reverse(F.array_sort(F.map_entries(tokens)))
    return F.aggregate(entries, masked, lambda acc, e: F.replace(acc, F.concat(F.lit("⟦T"), e["key"].cast("string"), F.lit("⟧")), e["value"]))


def marks(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(MARK), F.lit(0))


def missing_marks(source: Column, target: Column) -> Column:
    """Marks of the source that the target lacks, in text order."""
    return F.array_sort(F.array_except(F.array_distinct(marks(source)), marks(target)))


def protected_counts(c: Column) -> Column:
    """How often each protected pattern occurs in the unmasked text."""
    return F.array(*[F.regexp_count(c, F.lit(U + p)) for p in PROTECTED])


SENTINEL = "|||"


def escape_sentinel(c: Column) -> tuple[Column, Column]:
    """(text with each literal separator as ⟦C0⟧, ⟦C1⟧ and so on, their number)."""
    parts = F.split(c, r"\|\|\|")
    pieces = F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.lit("⟦C"), (i - 1).cast("string"), F.lit("⟧"), p)))
    return F.array_join(pieces, ""), F.size(parts) - 1


def restore_sentinel(c: Column, n: Column) -> Column:
    places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(places, c, lambda acc, i: F.replace(acc, F.concat(F.lit("⟦C"), i.cast("string"), F.lit("⟧")), F.lit(SENTINEL)))


def token_estimate(c: Column) -> Column:
    """A quarter of the code points, rounded up: an estimate, as exact counts depend on a tokenizer that is passed in."""
    return F.ceil(F.length(c) / 4).cast("int")


def reflow(c: Column) -> Column:
    """Lines of a paragraph joined by a space; paragraphs are kept apart by a blank line, and empty ones go."""
    paragraphs = F.transform(F.split(c, "\n\n"), lambda p: F.array_join(F.filter(F.transform(F.split(p, "\n"), strip), lambda x: x != ""), " "))
    return F.array_join(F.filter(paragraphs, lambda p: p != ""), "\n\n")


def human_bytes(c: Column) -> Column:
    """In powers of 1024 with one decimal."""
    k = F.when(c < 1, 0).otherwise(F.least(F.lit(4), F.floor(F.log(2.0, c.cast("double")) / 10))).cast("int")
    return F.concat(F.format_number(c / F.pow(F.lit(1024.0), k), 1), F.lit(" "), F.get(F.array(*[F.lit(u) for u in ("B", "KB", "MB", "GB", "TB")]), k))


def initials(c: Column) -> Column:
    return F.upper(F.array_join(F.transform(F.slice(F.filter(F.split(strip(c), r"\s+"), lambda w: w != ""), 1, 2), lambda w: F.left(w, F.lit(1))), ""))


def breadcrumb(position: Column) -> Column:
    """A structural position for people: numbers from 1, `?` where there is none; other formats unchanged."""
    p = F.split(position, r"\.")
    n = lambda name: F.coalesce((F.get(p, F.array_position(p, F.lit(name)).cast("int")).try_cast("int") + 1).cast("string"), F.lit("?"))
    last_shape = F.coalesce((F.get(p, F.size(p) - F.array_position(F.reverse(p), F.lit("shape")).cast("int") + 1).try_cast("int") + 1).cast("string"), F.lit("?"))
    head = F.get(p, F.lit(0))
    table = F.array_contains(p, "table")
    return (
        F.when(head == "slide", F.when(F.array_contains(p, "notes"), F.concat(F.lit("Slide "), n("slide"), F.lit(" / Notes"))).otherwise(F.concat(F.lit("Slide "), n("slide"), F.lit(" / Shape "), F.when(F.array_contains(p, "shape"), last_shape).otherwise("?"))))
        .when(head == "master", F.concat(F.lit("Master "), n("master"), F.lit(" / Shape "), last_shape))
        .when((head == "page") & table, F.concat(F.lit("Page "), n("page"), F.lit(" / Table "), n("table"), F.lit(" / Row "), n("row"), F.lit(" / Col "), n("col")))
        .when((head == "page") & F.array_contains(p, "region"), F.concat(F.lit("Page "), n("page"), F.lit(" / Region "), F.coalesce(F.get(p, F.array_position(p, F.lit("region")).cast("int")), F.lit("?"))))
        .when((head == "page") & F.array_contains(p, "col"), F.concat(F.lit("Page "), n("page"), F.lit(" / Col "), n("col"), F.lit(" / Block "), n("block")))
        .when(head == "page", F.concat(F.lit("Page "), n("page"), F.lit(" / Block "), n("block")))
        .otherwise(position)
    )


# Names of fonts that hold symbols.
MATH_PREFIXES = ["AdvP", "CMSY", "CMR", "STIX", "MathFont", "MT"]
MATH_EXACT = ["Symbol", "ZapfDingbats", "Wingdings"]


def is_math_font(font: Column) -> Column:
    base = F.element_at(F.split(font, r"\+"), -1)
    prefix = F.lit(False)
    for p in MATH_PREFIXES:
        prefix = prefix | base.startswith(p)
    return font.isin(MATH_EXACT) | prefix | base.rlike("(?i)math|symbol|glyph")


def is_bold_font(font: Column) -> Column:
    return F.element_at(F.split(font, r"\+"), -1).rlike(r"\.B$|(?i)bold|black|heavy")


def is_italic_font(font: Column) -> Column:
    return F.element_at(F.split(font, r"\+"), -1).rlike(r"\.I$|(?i)italic|oblique")


def is_valid_email(c: Column) -> Column:
    return c.rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$")
