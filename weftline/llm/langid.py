"""Language identification by rank-order n-gram profiles.

A profile is the ranking of a text's letter n-grams (1 to 3 places; a word's border
is a place in those of 2 and 3) by count, cut at rank `size`. A document gets the language whose
profile is nearest by out-of-place distance: the sum, over the document's n-grams,
of the difference of ranks, or `size` where the profile lacks the n-gram. N-grams of
equal count share their mean rank; a text's cut keeps them together, a profile's keeps
the first by code, so nothing depends on the order of rows.

Defined cases: a null text or one without a letter is `und` with score 0, as is any
text if nothing was learned; very long texts are counted whole, in parts that bound
memory; rows with null language teach nothing; equal distances
go to the first language by code point; repeated rows count as often as they occur;
an empty table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import bucket_of, text_or_empty

UNKNOWN = "und"
#: Code points that a task counts at once; bounds its memory, not its results.
AT_ONCE = 1 << 20
#: A word's border; no letter has this code point.
BORDER = 1
#: Texts of a learned language score 0.31 or more on sf0.1; random letters, base64 and texts of languages that share neither script nor spelling 0.21 or less.
LEAST = 0.25


@cache
def letters() -> np.ndarray:
    """Whether a code point is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def grams(text: str) -> Iterator[np.ndarray]:
    """The n-grams of a text as numbers, 21 bits a place, repeats included; those of `AT_ONCE` code points at a time."""
    text, s = text.lower(), np.full(1, BORDER, np.int64)
    for at in range(0, len(text) + 1, AT_ONCE):
        a = np.frombuffer(text[at : at + AT_ONCE].encode("utf-32-le", "surrogatepass"), "<u4")
        letter = letters()[a]
        kept = letter.copy()
        kept[1:] |= letter[:-1]  # of a run of others, one border
        kept[:1] |= s[-1] != BORDER
        new = np.where(letter, a, BORDER)[kept].astype(np.int64)
        if at + AT_ONCE > len(text) and np.append(s, new)[-1] != BORDER:
            new = np.append(new, BORDER)
        n = len(s)
        s = np.concatenate([s, new])
        two, three = s[n - 1 : -1] << 21 | s[n:], s[: len(s) - 2] << 42 | s[1:-1] << 21 | s[2:]
        three = three[s[1:-1] != BORDER]
        yield np.concatenate([new[new != BORDER], two, three])
        s = s[-2:]


def counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams and their counts."""
    return summed([np.unique(g, return_counts=True) for g in grams(text)])


def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return keys, np.bincount(at, weights=np.concatenate([p[1] for p in parts]), minlength=len(keys)).astype(np.int64)


def ranks(counts: np.ndarray, size: int) -> np.ndarray:
    """Mean rank among equal counts, most frequent first, from 0; `inf` beyond the cut."""
    _, which, many = np.unique(-counts, return_inverse=True, return_counts=True)
    above = np.cumsum(many) - many
    return np.where(above < size, above + (many - 1) / 2, np.inf)[which]


def learn(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", size: int = 400, most_langs: int = 10_000) -> dict[str, dict[int, float]]:
    """language -> n-gram -> rank, over all rows with a language.

    Tasks emit counts by language and n-gram; what reaches the driver is at most `size`
    n-grams for each language. Of those that tie at the cut, the first by code stay.
    """
    src = docs.filter(F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), text_or_empty(text_col).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts: dict[str, list[str]] = {}
            sizes: dict[str, int] = {}
            parts: dict[str, list] = {}

            def close(lang: str) -> None:
                parts.setdefault(lang, []).append(counted("\n".join(texts.pop(lang))))  # noqa: B023
                sizes[lang] = 0  # noqa: B023

            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                texts.setdefault(lang, []).append(text)
                sizes[lang] = sizes.get(lang, 0) + len(text)
                if sizes[lang] > AT_ONCE // 2:
                    close(lang)
            for lang in list(texts):
                close(lang)
            for lang, found in parts.items():
                keys, n = summed(found)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys), pa.array(n)], ["lang", "gram", "n"])

    n = src.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    top = n.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).filter(F.col("r") <= size)
    by: dict[str, tuple[list[int], list[int]]] = {}
    found = top.select("lang", "gram", "n").limit(most_langs * size + 1).collect()
    for lang, gram, c in found:
        x = by.setdefault(lang, ([], []))
        x[0].append(gram)
        x[1].append(c)
    if len(by) > most_langs or len(found) > most_langs * size:
        raise ValueError(f"more than {most_langs} languages; is {lang_col} a language?")
    return {lang: dict(zip(g, ranks(np.array(c), size).tolist(), strict=True)) for lang, (g, c) in sorted(by.items())}


class Classifier:
    """Distances of texts to profiles."""

    def __init__(self, profiles: dict[str, dict[int, float]], size: int):
        self.langs, self.size = list(profiles), size
        self.grams = np.array(sorted({g for p in profiles.values() for g in p}), dtype=np.int64)
        self.ranks = np.array([[p.get(g, np.nan) for g in self.grams.tolist()] for p in profiles.values()])

    def __call__(self, text: str) -> tuple[str, float, float]:
        """Language, score (1 - distance / largest possible distance), and the lead over the second."""
        keys, n = counted(text)
        if not self.langs or not len(keys):
            return UNKNOWN, 0.0, 0.0
        r = ranks(n, self.size)
        use = r < np.inf
        keys, r = keys[use], r[use]
        at = np.minimum(np.searchsorted(self.grams, keys), len(self.grams) - 1)
        d = np.abs(np.where(self.grams[at] == keys, self.ranks[:, at], np.nan) - r)
        d = np.minimum(np.where(np.isnan(d), self.size, d), self.size).sum(axis=1) / (self.size * len(keys))
        best = int(np.argmin(d))
        lead = float(np.partition(d, 1)[1] - d[best]) if len(d) > 1 else 1.0
        return self.langs[best], float(1 - d[best]), lead


def identify(docs: DataFrame, profiles: dict[str, dict[int, float]], id_col: str = "doc_id", text_col: str = "text", size: int = 400, keep: tuple[Column, ...] = ()) -> DataFrame:
    """(doc_id, lang_pred, score, lead) and the columns in `keep`, one row per row of `docs`, by its text alone."""
    src = docs.select(text_or_empty(text_col).alias("__wl_text"), F.col(id_col).alias("doc_id"), *keep)
    add = "lang_pred string, score double, lead double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Classifier(profiles, size)
        for b in batches:
            found = [of(t) for t in b.column(0).to_pylist()]
            cols = [pa.array([f[k] for f in found], t) for k, t in enumerate((pa.string(), pa.float64(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], *cols], [*b.schema.names[1:], "lang_pred", "score", "lead"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[1:])
    return src.mapInArrow(run, f"{schema}, {add}")


def filter_language(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least: float = LEAST, **how: int) -> DataFrame:
    """The rows of `docs` whose text has a language: not `und`, and with a score of at least `least`. A null language becomes the one found.

    Profiles are learned from the non-null languages of the same rows.
    """
    profiles = learn(docs, lang_col, text_col, **how)
    lang = F.col(f"`{lang_col}`")
    row = F.struct(*[lang.cast("string").alias(c) if c == lang_col else F.col(f"`{c}`") for c in docs.columns]).alias("__wl_row")
    out = identify(docs, profiles, id_col, text_col, keep=(row,), **how).filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least))
    found = F.coalesce(F.col(f"__wl_row.`{lang_col}`"), F.col("lang_pred"))
    return out.select(*[found.alias(c) if c == lang_col else F.col(f"__wl_row.`{c}`") for c in docs.columns])


def op1(docs: DataFrame) -> DataFrame:
    """Learns from the rows whose crc32(doc_id) mod 4 is not 2, and predicts every row."""
    held_out = bucket_of(F.col("doc_id").cast("string"), 4) == 2
    profiles = learn(docs.filter(~held_out))
    return identify(docs, profiles, keep=(held_out.alias("held_out"),)).select("doc_id", "held_out", "lang_pred", "score", "lead")
