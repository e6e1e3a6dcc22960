"""Phrase collocations, importance resampling and repeated passages, against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import importance, phrases, substrings

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def key(row):
    return repr(tuple(row))


# --- phrases


def brute_phrases(rows, least, best, longest=3):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = [x for x in re.split(r"[\x20\x09]+", piece) if x]
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        kept, around = [], Counter()
        for q, b in candidates.items():
            for k in range(2, len(q)):
                for i in range(len(q) - k + 1):
                    around[q[i : i + k]] = max(around[q[i : i + k]], b)
        for p, a in candidates.items():
            if around[p] and 100 * around[p] >= 50 * a:
                continue
            cuts = [(1_000_000 * a * a // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p))]
            score, _, left, right = min(cuts)
            kept.append((score, a, " ".join(p), left, right))
        kept.sort(key=lambda x: (-x[0], -x[1], x[2].encode()))
        out += [(lang, i + 1, p, a, left, right, n[lang], s) for i, (s, a, p, left, right) in enumerate(kept[:best])]
    return sorted(out)


@pytest.mark.parametrize("longest", [2, 3, 4])
def test_collocations(docs, rows, longest):
    expected = brute_phrases([(r[2], r[1]) for r in rows], 10, 50, longest)
    found = phrases.collocations(docs, best=50, longest=longest, shard_words=3000)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, found.collect())) == expected
    assert {r[0] for r in expected} >= {"en", "fr"}


def test_collocations_do_not_depend_on_shards(docs):
    one, many = (sorted(map(tuple, phrases.collocations(docs, least=3, shard_words=n).collect())) for n in (10**9, 10))
    assert one == many and one


def test_collocations_by_hand(spark):
    texts = ["New York. new\tyork, NEW york!"] * 4 + ["a b c"] * 10 + ["b c"] * 11 + ["x x x x x x x x x x x x"] + ["É é. é É"] * 10
    df = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    found = {r.phrase: (r.a, r.l, r.r, r.n, r.score) for r in phrases.op11(df).collect()}
    n = 24 + 30 + 22 + 12 + 40
    assert found["new york"] == (12, 12, 12, n, 1_000_000)
    assert "a b" not in found  # inside "a b c", as frequent
    assert found["b c"] == (21, 21, 21, n, 1_000_000)  # "a b c" is less than half as frequent
    assert found["a b c"] == (10, 10, 21, n, 1_000_000 * 100 // 210)
    assert "x x" not in found and found["x x x"][0] == 10 and found["x x x"][4] == min(10**6 * 100 // (12 * 11), 10**6 * 100 // (11 * 12))
    assert found["É é"][0] == 10 and found["é É"][0] == 10  # only A to Z change


def test_merge_join():
    left, right = np.array([1, 4, 6, 9]), np.array([0, 4, 9, 11])
    a, b = phrases.merge_join(left, right)
    assert left[a].tolist() == [4, 9] == right[b].tolist()
    assert len(phrases.merge_join(left, right[:0])[0]) == 0


def test_score_is_exact_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    rows = [(10**12 - 1, 10**12 + 7, 10**12 + 3), (3, 7, 9), (10, 10, 10)]
    got = spark.createDataFrame(rows, "a long, l long, r long").select(phrases.score(F.col("a"), F.col("l"), F.col("r"))).collect()
    assert [r[0] for r in got] == [1_000_000 * a * a // (x * y) for a, x, y in rows]


# --- importance resampling


def brute_draw(docs, target, least_words=20, buckets=10_000, longest=1):
    def grams(text):
        w = re.findall(importance.WORD, (text or "").translate(LOWER))
        return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, longest + 1) for i in range(len(w) - k + 1)]

    s, t = Counter(b for _, x in docs for b in grams(x)[1]), Counter(b for x in target for b in grams(x)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets))))
    out = []
    for i, text in docs:
        n, x = grams(text)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, x))
        out.append([i, len(x), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    enough = sorted((r for r in out if r[5] >= least_words), key=lambda r: (-r[3], r[0] is None, r[0]))
    for place, r in enumerate(enough[: 10 * len(enough) // 100]):
        r[4] = place + 1
    return sorted(key(r[:5]) for r in out)


@pytest.mark.parametrize("longest", [1, 2])
def test_resampling(spark, docs, rows, longest):
    texts = [rows[3][1], None, "", "The house over the river " * 20, rows[3][1]]
    target = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "item_id long, text string")
    found = importance.resample(docs, target, longest=longest)
    assert found.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(key, found.collect())) == brute_draw([(r[0], r[1]) for r in rows], texts, longest=longest)


def test_resampling_with_null_ids_and_no_target(spark, empty):
    rows = [(None, "one two three " * 10), (None, None), (5, "one two " * 12), (5, "one two " * 12)] + [(i, f"w{i} " * 30) for i in range(10, 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(key, importance.resample(df, empty).collect())) == brute_draw(rows, [])


def test_resampling_prefers_the_target(spark):
    rng = random.Random(1)
    like = [" ".join(rng.choice("alpha beta gamma delta epsilon".split()) for _ in range(60)) for _ in range(100)]
    unlike = [" ".join(rng.choice("un deux trois quatre cinq".split()) for _ in range(60)) for _ in range(900)]
    df = spark.createDataFrame(list(enumerate(like + unlike)), "doc_id long, text string").repartition(5)
    found = importance.resample(df, spark.createDataFrame([("alpha beta gamma delta " * 50,)], "text string")).filter("rank IS NOT NULL").collect()
    assert len(found) == 100 and sorted(r["rank"] for r in found) == list(range(1, 101))
    assert sum(r.doc_id < 100 for r in found) == 100


def test_gains_are_one_literal(spark, docs):
    from pyspark.sql import functions as F

    df = docs.select(importance.weight(importance.bucket_array(importance.tokens(F.col("text"))), [1, 2] * 5000).alias("x"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "split" not in plan and "explode" not in plan


# --- repeated passages


def brute_strip(docs, window=50):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in docs]
    first = {}
    for (i, _), w in zip(docs, words, strict=True):
        if i is not None:
            for j in range(len(w) - window + 1):
                x = tuple(w[j : j + window])
                first[x] = min(first.get(x, i), i)
    out = []
    for (i, _), w in zip(docs, words, strict=True):
        gone = set()
        if i is not None:
            for j in range(len(w) - window + 1):
                if first[tuple(w[j : j + window])] < i:
                    gone |= set(range(j, j + window))
        kept = [x for j, x in enumerate(w) if j not in gone]
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(map(key, out))


def planted(rng, n=120):
    """Random texts with shared passages of all lengths around the window, copies, near copies and runs of one word."""
    prose = lambda k: [rng.choice(vocabulary) for _ in range(k)]
    vocabulary = [f"w{i}" for i in range(400)] + ["é", " ", "x\x1cy", "ab⟦"]
    passages = [prose(k) for k in (30, 49, 50, 51, 64, 90, 400)]
    docs = []
    for i in rng.sample(range(1000), n):
        w = prose(rng.choice([0, 3, 49, 50, 120, 300]))
        for _ in range(rng.choice([0, 1, 2, 3])):
            p = rng.choice(passages)
            lo = rng.randrange(max(1, len(p) - 60))
            at = rng.randrange(len(w) + 1)
            w[at:at] = p[lo : lo + rng.choice([50, 55, len(p)])]
        docs.append((i, w))
    base = prose(500)
    for i in range(1000, 1030):
        w = list(base)
        for _ in range(rng.choice([0, 1, 2, 8])):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        docs.append((i, w))
    docs += [(2000, ["a"] * 300), (2001, ["a"] * 70), (2002, ["a", "b"] * 80), (2003, ["b", "a"] * 60), (2004, ["a"] * 49), (None, base), (None, base)]
    docs += [docs[0], docs[0], (5000, prose(20_000) + base), (4999, base[100:200] + prose(3000))]
    return [(i, rng.choice([" ", "\n", " \t"]).join(w)) for i, w in docs] + [(6000, None), (6001, ""), (6002, " \n ")]


@pytest.mark.parametrize("seed", [1, 2])
def test_repeats_match_brute_force(spark, seed):
    docs = planted(random.Random(seed))
    df = spark.createDataFrame([(i, t, "x", 7) for i, t in docs], "doc_id long, text string, words string, shard long").repartition(6)
    found = substrings.strip_repeats(df, shard_bytes=20_000)
    assert sorted(map(key, found.select("doc_id", "n_words", "n_removed", "kept_sha256").collect())) == brute_strip(docs)
    assert all(hashlib.sha256(r.kept.encode()).hexdigest() == r.kept_sha256 for r in found.collect())


def test_repeats_of_the_common_rows(docs, rows):
    found = substrings.op13(docs)
    assert found.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    assert sorted(map(key, found.collect())) == brute_strip([(r[0], r[1]) for r in rows])


def test_repeats_with_text_ids_and_another_window(spark):
    rng = random.Random(4)
    docs = [(None if i is None else f"d{i}", t) for i, t in planted(rng, 60)]
    df = spark.createDataFrame(docs, "doc_id string, text string").repartition(4)
    assert sorted(map(key, substrings.strip_repeats(df, window=25, anchor=8).select("doc_id", "n_words", "n_removed", "kept_sha256").collect())) == brute_strip(docs, 25)


def test_a_passage_in_very_many_documents(spark):
    rng = random.Random(5)
    common = [f"c{i}" for i in range(60)]
    docs = [(i, " ".join([f"u{i}_{j}" for j in range(rng.randrange(5))] + common + [f"v{i}_{j}" for j in range(3)])) for i in range(3000)]
    found = substrings.op13(spark.createDataFrame(docs, "doc_id long, text string").repartition(8)).collect()
    assert {r.doc_id: r.n_removed for r in found} == {i: 60 if i else 0 for i in range(3000)}


def test_a_phrase_with_many_surroundings_goes_to_each_shard_once_a_window(spark):
    """Each surrounding is in two documents, so all are passages of the phrase's anchors; shards times passages would be the square."""
    rng, n = random.Random(9), 60
    phrase = [f"p{i}" for i in range(40)]
    around = [[f"l{i}_{j}" for j in range(40)] + phrase + [f"r{i}_{j}" for j in range(40)] for i in range(n)]
    docs = [(k * n + i, " ".join([f"x{k}_{i}", *w])) for k in range(2) for i, w in enumerate(around)]
    rng.shuffle(docs)
    texts = spark.createDataFrame(docs, "doc_id long, text string").select("doc_id", F.col("text").cast("binary").alias("body")).withColumn("shard", (F.col("doc_id") % 50).cast("int")).repartition(4)
    found = texts.mapInArrow(substrings._find(50, 16), "doc_id long, shard int, anchor long, digest long, start int, n int, at int").cache()
    passages, needs = substrings.confirmed(texts, found)
    assert passages.groupBy("anchor").count().agg(F.max("count")).first()[0] >= n
    assert substrings.dealt(found, passages, needs).count() <= found.count()
    got = substrings.strip_repeats(spark.createDataFrame(docs, "doc_id long, text string"), shard_bytes=5_000)
    assert {r.doc_id: r.n_removed for r in got.collect()} == {i: 120 if i >= n else 0 for i in range(2 * n)}


def test_every_window_has_one_anchor_by_its_words():
    rng = random.Random(6)
    words = [rng.choice([b"a", b"b", b"c"]) for _ in range(400)]
    found = substrings.spans([b" ".join(words)], 50, 16)
    covered = [s + i for s, n in zip(found["start"], found["n"], strict=True) for i in range(n)]
    assert covered == list(range(351))
    for s, n, at in zip(found["start"], found["n"], found["at"], strict=True):
        for i in range(n):
            alone = substrings.spans([b" ".join(words[s + i : s + i + 50])], 50, 16)
            assert alone["at"][0] == at - i


@pytest.mark.parametrize("op", [phrases.op11, substrings.op13, lambda d: importance.resample(d, d)])
def test_empty_tables(empty, op):
    assert op(empty).collect() == []


def test_a_text_of_several_megabytes(spark):
    rng = random.Random(7)
    long = " ".join(f"t{rng.randrange(50_000)}" for _ in range(500_000))
    df = spark.createDataFrame([(1, long, "en"), (2, "head " + long[: len(long) // 2], "en"), (3, "short text", "en")], "doc_id long, text string, lang string")
    assert len(long) > 3_000_000
    n = {r.doc_id: r.n_removed for r in substrings.op13(df).collect()}
    assert n[1] == 0 and n[2] > 240_000 and n[3] == 0
    assert {r.doc_id: r.n_features for r in importance.resample(df, df).collect()}[1] == 500_000
    assert {r.lang: r.n for r in phrases.collocations(df, least=2, best=1).collect()} == {"en": sum(len(t.split()) for _, t, _ in df.collect())}
