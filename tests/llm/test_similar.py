import random

import numpy as np

import corpus_pipeline
from weftline.llm import simhash


def sets_of(texts):
    out = []
    for t in texts:
        w = (t or "").lower().split()
        out.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    return out


def survivors(texts):
    """Smallest places of the components, by all pairs."""
    s, root = sets_of(texts), list(range(len(texts)))
    for i in range(len(s)):
        for j in range(i):
            both = len(s[i] & s[j])
            if 5 * both >= 4 * (len(s[i]) + len(s[j]) - both):
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    return [i for i, r in enumerate(root) if i == r]


def test_near_duplicates_match_all_pairs(spark):
    """Texts edited in a few places: similarities on both sides of 0.8, mostly far beyond 4 bits; chains, a common passage, copies."""
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(400)]
    prose = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    common, texts = prose(40), []
    for k in range(40):
        base = prose(rng.choice([30, 60, 120, 250])) + (common if k % 2 else [])
        for _ in range(6):
            texts.append(" ".join(base))
            for _ in range(rng.choice([0, 1, 1, 2, 3, 5])):
                base = [*base]
                base[rng.randrange(len(base))] = rng.choice(vocabulary)
    texts += [" ".join([f"x{i}", *prose(20), *common]) for i in range(200)]  # a passage that many texts have
    texts += [texts[0], None, "", "a b", "A  b"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    expected = survivors(texts)
    assert 100 < len(expected) < len(texts) - 50
    got = corpus_pipeline.near_duplicates(spark, docs, "")
    assert got.columns == docs.columns
    kept = sorted(r.doc_id for r in got.collect())
    print(len(kept), len(expected), sorted(set(kept) ^ set(expected)))
    assert set(expected) <= set(kept)  # nothing goes without a link
    assert len(kept) - len(expected) <= 0.03 * (len(texts) - len(expected))  # and few links are missed


def test_empty(empty):
    assert simhash.keep_similar(empty).count() == 0


def test_a_shards_tree_finds_what_all_pairs_find():
    """Families of near fingerprints, equal ones, and others: every pair within the radius once, and families don't meet."""
    rng = np.random.default_rng(4)
    centres = rng.integers(0, 2**63, (20, 2), dtype=np.uint64)
    flips = np.packbits(rng.random((20 * 100, 128)) < 0.05, axis=1).view(np.uint64)
    f = np.concatenate([np.repeat(centres, 100, axis=0) ^ flips, rng.integers(0, 2**63, (50, 2), dtype=np.uint64), np.repeat(centres[:1], 60, axis=0)])
    root = np.sort(rng.integers(0, len(f) // 2, len(f)))
    f = f[rng.permutation(len(f))]
    a, b = np.triu_indices(len(f), 1)
    near = (np.bitwise_count(f[a] ^ f[b]).sum(axis=1) <= 30) & (root[a] != root[b])
    expected = sorted(zip(a[near].tolist(), b[near].tolist(), strict=True))
    for leaf in (100, 1000, 1 << 30):
        found = list(simhash.near_pairs(f, root, 30, leaf))
        i, j = (np.concatenate(x) for x in zip(*found, strict=True))
        i, j = np.minimum(i, j), np.maximum(i, j)
        assert (root[i] != root[j]).all() and len(set(zip(i.tolist(), j.tolist(), strict=True))) == len(i)
        use = np.bitwise_count(f[i] ^ f[j]).sum(axis=1) <= 30
        assert sorted(zip(i[use].tolist(), j[use].tolist(), strict=True)) == expected
        assert leaf == 1 << 30 or len(i) < len(a) / 4


def test_long_shards_go_through_the_tree(spark):
    """What members of a shard make of each other is the same whether shards are leaves or trees."""
    rng = np.random.default_rng(5)
    f = np.repeat(rng.integers(0, 2**63, (4, 2), dtype=np.uint64), 120, axis=0) ^ np.packbits(rng.random((480, 128)) < 0.06, axis=1).view(np.uint64)
    rows = [(k % 3 // 2, k, 100, int(x), int(y), k // 2) for k, (x, y) in enumerate(f.view(np.int64).tolist())]
    df = spark.createDataFrame(rows, "s long, h long, n int, f0 long, f1 long, root long")
    expected = {(x[1], y[1]) for x in rows for y in rows if x[1] < y[1] and x[0] == y[0] and x[5] != y[5] and (x[3] ^ y[3]).__and__(2**64 - 1).bit_count() + (x[4] ^ y[4]).__and__(2**64 - 1).bit_count() <= simhash.FAR}
    assert len(expected) > simhash.LEAF / 2
    assert {(r.a, r.b) for r in simhash.met(df, simhash.SHARE, "all").collect()} == expected
