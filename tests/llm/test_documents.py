"""Every operator over documents against a plain version of its rules."""

import hashlib
import math
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from weftline.llm import fingerprints, langid, licenses, lm, mixing, packing, quality, simhash, tokencounts
from weftline.llm.common import n_words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def low(t):
    return (t or "").encode().lower().split()


@pytest.mark.parametrize("op", [langid.op1, lm.op2, mixing.op4, licenses.op5, packing.op6, fingerprints.op7, quality.op8, simhash.op9, tokencounts.op10])
def test_empty_tables(empty, op):
    assert op(empty).collect() == []


def test_language(docs, rows):
    got = langid.op1(docs).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    lang = {r[0]: (r[1], r[2]) for r in rows}
    for r in got:
        text, true = lang[r.doc_id]
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1
        if not re.search(r"[^\W\d_]", text or ""):
            assert (r.lang_pred, r.score) == ("und", 0)
        elif r.doc_id < 100:
            assert r.lang_pred == true


def code(gram):
    n = 0
    for c in gram:
        n = n << 21 | (langid.BORDER if c == "_" else ord(c))
    return n


def test_language_grams():
    got = Counter(np.concatenate(list(langid.grams("Ab, é1b"))).tolist())
    assert got == Counter(map(code, ["a", "b", "é", "b", "_a", "ab", "b_", "_é", "é_", "_b", "b_", "_ab", "ab_", "_é_", "_b_"]))


def plain_grams(text):
    """n-grams by code point, from the text with each run of others as one border."""
    t = "_" + "".join(c if c.isalpha() else "_" for c in text.lower()) + "_"
    while "__" in t:
        t = t.replace("__", "_")
    out = Counter(t.replace("_", "")) if t != "_" else Counter()
    for i in range(len(t) - 1):
        out[t[i : i + 2]] += 1
        if i + 2 < len(t) and t[i + 1] != "_":
            out[t[i : i + 3]] += 1
    return Counter({code(k): v for k, v in out.items() if t != "_"})


@pytest.mark.parametrize("at_once", [1, 2, 7, 1 << 20])
def test_long_texts_are_counted_as_a_whole(monkeypatch, at_once):
    monkeypatch.setattr(langid, "AT_ONCE", at_once)
    for text in ("", " ", "a", "ab", " a", "Ab, é1b", "abcdefghijklmnopqrstuvwxyz" * 3, "one  two\n\nthree ", "...x"):
        keys, n = langid.counted(text)
        assert dict(zip(keys.tolist(), n.tolist(), strict=True)) == plain_grams(text), text


def test_language_id_matches_brute_force(docs, rows):
    """Ranks, ties, cuts and distances of whole profiles."""
    size, held = 400, lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    learned = {}
    for r in rows:
        if r[2] is not None and not held(r[0]):
            learned.setdefault(r[2], Counter()).update(plain_grams(r[1] or ""))

    def rank(items):
        above = Counter()
        for _, n in items:
            above[n] += 1
        out, at = {}, 0
        for n in sorted(above, reverse=True):
            out[n], at = (at, at + (above[n] - 1) / 2), at + above[n]
        return {k: out[n] for k, n in items}

    profiles = {}
    for lang, c in learned.items():
        top = sorted(c.items(), key=lambda x: (-x[1], x[0]))[:size]
        profiles[lang] = {k: r for k, (_, r) in rank(top).items()}
    text = {r[0]: r[1] for r in rows}
    for r in langid.op1(docs).collect():
        own = {k: m for k, (first, m) in rank(list(plain_grams(text[r.doc_id] or "").items())).items() if first < size}
        if not own:
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        far = {lang: sum(min(size, abs(p[k] - m)) if k in p else size for k, m in own.items()) / (size * len(own)) for lang, p in profiles.items()}
        best = min(sorted(far), key=far.get)
        assert r.lang_pred == best
        assert r.score == pytest.approx(1 - far[best])


def test_language_distance_is_out_of_place():
    profiles = {"a": {code("x"): 0.0, code("xx"): 3.0}, "b": {code("_x"): 0.0}}
    lang, score, _ = langid.Classifier(profiles, 4)("xx")  # x twice: rank 0; _x, xx, x_, _xx, xx_ once: rank 3
    assert lang == "a"
    assert score == pytest.approx(1 - (0 + 0 + 4 * 4) / (4 * 6))


def test_language_filter_keeps_columns_and_rejects_texts_without_letters(docs, rows):
    out = langid.filter_language(docs, least=0.15)
    assert out.columns == docs.columns
    assert not {200, 201, 202, 204} & {r.doc_id for r in out.collect()}
    assert out.count() == len(rows) - 4


def test_pitman_yor_scores(docs, rows):
    got = lm.op2(docs).collect()
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    c = Counter()
    for r in rows:
        if not held(r[0]):
            c.update([*low(r[1]), b""])
    n, v = sum(c.values()), len(c)
    text = {r[0]: [*low(r[1]), b""] for r in rows}
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    for r in got:
        t = text[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(r.doc_id), len(t), sum(c[w] > 0 for w in t), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t))
        assert -1e9 < r.score < 0
    per = lambda name: sum(getattr(r, name) for r in got if r.held_out) / sum(r.n_tokens for r in got if r.held_out)
    assert per("score") > per("base_score")


def test_pitman_yor_with_nothing_learned(spark, empty):
    """Held-out rows only: every row comes back, every token is the unknown one."""
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 2][:3]
    docs = spark.createDataFrame([(i, t) for i, t in zip(held, ["a b", None, "c " * 500], strict=True)], "doc_id long, text string")
    got = {r.doc_id: r for r in lm.op2(docs).collect()}
    assert sorted(got) == held
    for r in got.values():
        assert (r.n_known, r.train_tokens, r.score) == (0, 0, 0.0)
    assert lm.op2(empty).count() == 0


def _lead(rows):
    return rows.filter("lead").select("word", "cells", "ones").toArrow().combine_chunks().to_batches()[0]


def test_pitman_yor_probabilities_sum_to_one(spark, docs):
    """Over all known words and the unknown one, in the parent and after each context."""
    rows = lm.gathered(lm.occurrences(docs))
    model, lone = lm.fit(rows), lm.Collected(rows.select("field", "sums", "total", "value")).context(lm.LONE)
    b = _lead(rows)
    cells, starts = lm.flat(b.column("cells"), lm.CELL)
    own, p = model.probabilities(b.column("word"), cells, starts, b.column("ones").to_numpy())
    for k, s in enumerate(model.samples):
        assert p[k].sum() + model.unknown(s) == pytest.approx(1, abs=1e-6)
    s = model.shared
    used = np.flatnonzero(s.c)
    mine = (np.bincount(cells["ctx"], weights=own, minlength=lm.CONTEXTS) + lone * (1 - s.d) / (s.STRENGTH + s.c))[used]
    assert mine + np.mean([x.back(used) for x in model.samples], axis=0) == pytest.approx(1, abs=1e-5)


def test_frequent_words_in_chunks_score_alike(docs):
    """Words whose occurrences pass through in chunks, behind their counts, get the same counts and scores."""

    def scores(many, size):
        rows = lm.gathered(lm.occurrences(docs, many=many), size)
        found = sorted(((r.doc_id, r.n_tokens, r.n_known), r.base_score, r.score) for r in lm.score(rows, lm.fit(rows)).collect())
        return rows.filter("word IS NOT NULL AND NOT lead").count(), found

    (none, whole), (some, parts) = scores(1 << 30, 1), scores(2, 1)
    assert none == 0 < some
    assert [x[0] for x in whole] == [x[0] for x in parts]
    assert [x[1] for x in whole] == pytest.approx([x[1] for x in parts])
    assert [x[2] for x in whole] == pytest.approx([x[2] for x in parts], rel=1e-2)


def test_pitman_yor_scores_match_a_plain_sampler(spark):
    """A sampler that seats one customer at a time with all counts exact, on a few dozen words."""
    rng = random.Random(5)
    vocab = ["ab", "cd", "abc", "d", "ee", "fa"]
    texts = [" ".join(rng.choices(vocab, weights=[8, 4, 2, 1, 1, 1], k=12)) for _ in range(12)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    rows = lm.gathered(lm.occurrences(docs))
    model = lm.fit(rows, burn=6, kept=6)
    got = {r.doc_id: r.score for r in lm.score(rows, model).collect()}
    s = model.shared
    pairs = [(u, w) for t in texts for u, w in zip(["<s>", *t.split()], [*t.split(), ""], strict=True)]
    words = sorted({w for _, w in pairs})
    at = np.concatenate([[0], np.cumsum([len(w) for w in words])])
    base = dict(zip(words, s.spelling.words(np.frombuffer("".join(words).encode(), np.uint8), at), strict=True))
    tables, root = {}, {w: [] for w in words}  # tables of a context and word; of a word in the parent

    def p_root(w):
        c, t = sum(map(sum, root.values())), sum(map(len, root.values()))
        return (max(0, sum(root[w]) - s.root_d * len(root[w])) + (s.ROOT_STRENGTH + s.root_d * t) * base[w]) / (s.ROOT_STRENGTH + c)

    def seat(at, new, d):
        k = rng.choices(range(len(at) + 1), [*[n - d for n in at], new])[0]
        if k == len(at):
            at.append(1)
            return True
        at[k] += 1
        return False

    def leave(at):
        k = rng.choices(range(len(at)), at)[0]
        at[k] -= 1
        if not at[k]:
            at.pop(k)
            return True
        return False

    def of(u):
        return [x for (v, _), x in tables.items() if v == u]

    def p(u, w):
        c, t = sum(map(sum, of(u))), sum(map(len, of(u)))
        x = tables.get((u, w), [])
        return (sum(x) - s.d * len(x) + (s.STRENGTH + s.d * t) * p_root(w)) / (s.STRENGTH + c)

    def join(u, w):
        t = sum(map(len, of(u)))
        if seat(tables.setdefault((u, w), []), (s.STRENGTH + s.d * t) * p_root(w), s.d):
            seat(root[w], (s.ROOT_STRENGTH + s.root_d * sum(map(len, root.values()))) * base[w], s.root_d)

    for u, w in pairs:
        join(u, w)
    sums, kept = np.zeros(len(pairs)), 0
    for k in range(25):
        for u, w in pairs:
            if leave(tables[u, w]):
                leave(root[w])
            join(u, w)
        if k >= 10:
            sums += [p(u, w) for u, w in pairs]
            kept += 1
    expected = np.split(np.log10(sums / kept), np.cumsum([len(t.split()) + 1 for t in texts])[:-1])
    for i, e in enumerate(expected):
        assert got[i] == pytest.approx(e.sum(), rel=0.03)


def test_seating_matches_exact_chinese_restaurant():
    """Given fixed weights, the number of tables follows the product of seating weights."""
    c, a, d = 4, 1.3, 0.4
    weight = Counter()

    def walk(n, tables, w):
        if n == c:
            weight[len(tables)] += w
            return
        walk(n + 1, [*tables, 1], w * a)
        for k in range(len(tables)):
            walk(n + 1, [*tables[:k], tables[k] + 1, *tables[k + 1 :]], w * (tables[k] - d))

    walk(1, [1], 1.0)
    expected = sum(t * w for t, w in weight.items()) / sum(weight.values())
    n = 20_000
    sizes, tables = np.full(n, c), np.ones(n, np.int64)
    for k in range(12):
        sizes, tables = lm.reseat(sizes, tables, np.full(n, c), np.full(n, c), np.full(n, a), d, np.arange(n, dtype=np.uint64) * np.uint64(2**40 + 7), k << 32)
    assert sizes.sum() == n * c and (sizes > 0).all() and tables.sum() == len(sizes)
    assert tables.mean() == pytest.approx(expected, rel=0.02)
    assert lm.seated(np.full(n, c), np.full(n, a), d, np.arange(n, dtype=np.uint64) * np.uint64(2**40 + 7), 5)[0].mean() == pytest.approx(expected, rel=0.02)


@pytest.mark.parametrize("d", [0.1, 0.6, 0.95])
@pytest.mark.parametrize("c", [64, 65, 300, 2000])
def test_seating_follows_its_law_for_any_number_of_customers(c, d):
    """t tables weigh new^t times the generalised Stirling numbers, here by their recurrence; one draw is enough."""
    log = np.full(c + 2, -np.inf)  # of c customers, by t
    log[0] = 0.0
    for k in range(1, c + 1):
        with np.errstate(divide="ignore"):
            log[1:] = np.logaddexp(log[:-1], log[1:] + np.log(np.maximum(k - 1 - d * np.arange(1, c + 2), 0.0)))
        log[0] = -np.inf
    t, n = np.arange(1, c + 1), 4000
    for new in (0.3, 10.0, 40.0, 1000.0):
        p = log[1:-1] + t * math.log(new)
        p = np.exp(p - p.max())
        p /= p.sum()
        got = np.sort(lm.seated(np.full(n, c), np.full(n, new), d, np.arange(n, dtype=np.uint64) * np.uint64(2**40 + 7), 5)[0])
        assert got[0] >= 1 and got[-1] <= c
        assert got.mean() == pytest.approx((t * p).sum(), rel=0.02)
        assert np.abs(np.cumsum(p) - np.searchsorted(got, t, side="right") / n).max() < 1.95 / math.sqrt(n)  # Kolmogorov, at 0.001


@pytest.mark.parametrize("c", [65, 300, 512])
def test_seatings_of_hundreds_are_drawn_from_a_table(c, monkeypatch):
    """No integral is evaluated for them, and what is drawn by integrals beyond has the same law."""
    n, d = 4000, 0.7
    cells, new, key = np.full(n, c), np.linspace(0.5, 40, n), np.arange(n, dtype=np.uint64) * np.uint64(2**40 + 7)
    far, _ = lm.drawn(cells, new, d, key, 5)
    monkeypatch.setattr(lm, "log_arrangements", None)
    got, rounds = lm.seated(cells, new, d, key, 5)
    assert rounds == 0 and got.min() >= 1 and got.max() <= c
    assert got.mean() == pytest.approx(far.mean(), rel=0.02)
    mixed = np.random.default_rng(3).permutation(np.repeat([1, 2, 64, c], n // 4))
    assert (lm.seated(mixed, new, d, key, 5)[0] == np.array([lm.seated(mixed[i : i + 1], new[i : i + 1], d, key[i : i + 1], 5)[0][0] for i in range(n)])).all()


def test_sums_by_context_cost_what_is_added():
    """A few contexts more take no array of all contexts."""
    sums = lm.Sums()
    sums.count(lm.TABLES, np.array([3, 3, 9], "<u4"))
    tracemalloc.start()
    sums.count(lm.TABLES, np.array([9, lm.START], "<u4"), np.array([1 << 33, 2]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < lm.CONTEXTS // 8
    assert {i: sums.by[lm.TABLES][i] for i in np.flatnonzero(sums.by[lm.TABLES]).tolist()} == {3: 2, 9: 1 + (1 << 33), lm.START: 2}


def test_chunks_of_a_word_share_its_chain(docs, monkeypatch):
    """In a batch and from batch to batch a word's seatings are sampled once, with the results of each row alone."""
    rows = lm.gathered(lm.occurrences(docs, many=2), 1)
    model = lm.fit(rows)
    found = rows.filter("word IS NOT NULL").select("word", "cells", "ones", "blocks", "counts", "occ").toArrow().combine_chunks().sort_by("word")
    alone = [lm.mean_probability(model, b)[0] for b in found.to_batches(max_chunksize=1)]
    seen, chain = Counter(), lm.Chain
    monkeypatch.setattr(lm, "Chain", lambda shared, words, *a: seen.update(words.to_pylist()) or chain(shared, words, *a))
    parts, before = [], None
    for b in (share for b in found.to_batches(max_chunksize=50) for share in lm.shares(b, 400)):
        assert b.num_rows == 1 or b.column("occ").nbytes <= 400 + 8 * (b.num_rows + 1)
        part, before = lm.mean_probability(model, b, before)
        parts.append(part)
    assert set(seen.values()) == {1} and len(seen) == len(set(found["word"].to_pylist())) < found.num_rows
    for k in (1, 2, 3, 5):
        assert np.concatenate([x[k] for x in parts]) == pytest.approx(np.concatenate([x[k] for x in alone]))
    assert np.concatenate([x[4][x[0]] for x in parts]).tolist() == np.concatenate([x[4][x[0]] for x in alone]).tolist()


def test_weights_of_seatings_keep_their_recurrence():
    """S(c + 1, t) = S(c, t - 1) + (c - d t) S(c, t), also where no table of them can be held."""
    for d in (0.1, 0.5, 0.95):
        for c in (100.0, 1e4, 1e6, 1e8):
            t = np.unique(np.geomspace(2, min(c, 1e6), 50).round())
            many = np.full(len(t), c)
            after, less, same = lm.log_arrangements(many + 1, t, d) + math.log(c + 1), lm.log_arrangements(many, t - 1, d), lm.log_arrangements(many, t, d)
            assert np.exp(less - after) + np.exp(same - after) * (c - d * t) == pytest.approx(1, abs=1e-4)


def test_seating_takes_and_gives():
    """Cells that shrink, grow and empty keep their customers."""
    sizes, tables = np.array([3, 1, 2, 5]), np.array([2, 1, 0, 1])
    take, give = np.array([4, 0, 0, 2]), np.array([0, 3, 2, 2])
    got, after = lm.reseat(sizes, tables, take, give, np.full(4, 0.5), 0.3, np.arange(4, dtype=np.uint64))
    cell = np.repeat(np.arange(4), after)
    assert np.bincount(cell, weights=got, minlength=4).tolist() == [0, 5, 2, 5]


def test_spelling_sums_to_one():
    values = np.frombuffer(b"abcab", np.uint8)
    two, one, sym, _ = lm.symbols(values, np.array([0, 3, 5]))
    grams, n = np.unique((two * 257 + one) * 257 + sym, return_counts=True)
    s = lm.Spelling(dict(zip(grams.tolist(), n.tolist(), strict=True)))
    assert np.exp(s.log1).sum(axis=1) == pytest.approx(1)
    assert np.exp(s.log2).sum(axis=1) == pytest.approx(1)
    assert s.words(values, np.array([0, 3, 5]))[0] > s.words(np.frombuffer(b"cba", np.uint8), np.array([0, 3]))[0]


def test_mix(docs, rows):
    got = mixing.op4(docs).collect()
    again = mixing.op4(docs.repartition(5)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    size = {r[0]: len(WORD.findall(r[1] or "")) for r in rows}
    per = defaultdict(int)
    for r in rows:
        per[r[3]] += size[r[0]]
    order = sorted((s for s in per if s is not None)) + [None] * (None in per)
    w = {s: 1 + i % 3 for i, s in enumerate(order)}
    total, target, fixed = sum(per.values()), {}, set()
    while True:
        level = (total - sum(3 * per[s] for s in fixed)) / sum(w[s] for s in order if s not in fixed)
        over = {s for s in order if s not in fixed and level * w[s] > 3 * per[s]}
        if not over:
            break
        fixed |= over
    target = {s: 3 * per[s] if s in fixed else level * w[s] for s in order}
    source, taken = {r[0]: r[3] for r in rows}, defaultdict(int)
    for r in got:
        s = source[r.doc_id]
        assert (r.size, r.source_size) == (size[r.doc_id], per[s])
        assert r.target == pytest.approx(target[s])
        assert r.size == 0 or r.taken % r.size == 0
        assert r.taken <= 3 * r.size
        taken[s] += r.taken
    largest = max(size.values())
    assert all(abs(taken[s] - target[s]) <= max(2 * largest, 0.1 * target[s]) for s in order)


def test_mixed_repeats_documents(docs):
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    expected = {r.doc_id: r.copies for r in mixing.mix(docs.select("doc_id", "source", "text").filter("doc_id <> 7")).collect()}
    got = Counter(r.doc_id for r in mixing.mixed(docs.filter("doc_id <> 7")).collect())
    assert got == Counter({k: v for k, v in expected.items() if v})


def test_mix_refuses_to_overwrite(docs):
    with pytest.raises(ValueError, match="size"):
        mixing.mix(docs)


def test_licenses(spark):
    mit = ["mit-grant", "mit-notice", "mit-warranty", "mit-liability"]
    full = ". ".join(licenses.SENTENCES[k].rstrip(".") for k in mit) + "."
    texts = [full, "Prose.\n" + licenses.SENTENCES["apache-ref"], "x " + licenses.SENTENCES["apache-ref"], "Licensed   under the APACHE license, version 2.0", None, "", full + "\n" + licenses.SENTENCES["cc0-ref"]]
    got = [(r.sentence_ids, r.licenses) for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).orderBy("doc_id").collect()]
    assert got == [(mit, ["MIT"]), (["apache-ref"], ["Apache-2.0"]), ([], []), (["apache-ref"], ["Apache-2.0"]), ([], []), ([], []), ([*mit, "cc0-ref"], ["CC0-1.0", "MIT"])]


def test_every_rule_is_found(spark):
    text = lambda ids: "\n".join(licenses.SENTENCES[i] for i in ids)
    df = spark.createDataFrame([(k, text(ids)) for k, (_, ids) in enumerate(licenses.RULES)], "doc_id int, text string")
    for r in licenses.scan(df).collect():
        assert r.licenses == [licenses.RULES[r.doc_id][0]]


def test_packing(docs, rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    expected = Counter()
    for r in rows:
        ids = [*tok.encode(r[1] or "", add_special_tokens=False).ids, 2]
        first = len(ids) % 1024 if len(ids) > 1024 else 0
        starts = [0] if len(ids) <= 1024 else ([0] if first else []) + list(range(first, len(ids), 1024))
        for k, s in enumerate(starts):
            part = ids[s : (starts[k + 1] if k + 1 < len(starts) else len(ids))]
            expected[r[0], k, s, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    got = packing.op6(docs).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == expected
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for x in by.values():
        at = 0
        for o, n in sorted(x):
            assert o == at
            at += n
        assert at <= 1024
    assert len(by) <= -(-sum(r.length for r in got) // 1024) + 1


def test_special_string_is_one_token_as_in_the_library():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = "a<|endoftext|> b 'll'x  \n\n\té12345 ½²"
    assert packing.byte_encoder()(t) == Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode(t, add_special_tokens=False).ids


def test_fullest_is_the_best_subset():
    import itertools
    import random

    rng = random.Random(1)
    for _ in range(200):
        left = {rng.randint(1, 30): rng.randint(1, 3) for _ in range(rng.randint(0, 6))}
        room = rng.randint(0, 60)
        best = max(sum(n * m for n, m in zip(left, ms, strict=True)) for ms in itertools.product(*[range(c + 1) for c in left.values()]) if sum(n * m for n, m in zip(left, ms, strict=True)) <= room)
        got = packing.fullest(left, room)
        assert all(m <= left[n] for n, m in got.items())
        assert sum(n * m for n, m in got.items()) == best


def test_sketches(docs, rows):
    got = {}
    for r in fingerprints.op7(docs).collect():
        got.setdefault(r.doc_id, r)
    text = {r[0]: r[1] or "" for r in rows}
    ids = sorted(text, reverse=True)
    paragraphs = lambda t: set(re.findall(r"[^\n]{1,200}", t))
    jaccard = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    assert set(got) == set(ids)
    for i, d in enumerate(ids):
        t, nxt = text[d], text[ids[(i + 1) % len(ids)]]
        third = len(t) // 3
        edited = t[: len(t) - third] + nxt[:third]
        r = got[d]
        if d != 7 and ids[(i + 1) % len(ids)] != 7 or d == 8:
            assert r.n_chars == len(t)
            assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
            assert r.near_edited == pytest.approx(jaccard(paragraphs(t), paragraphs(edited)))
            assert r.near_next == pytest.approx(jaccard(paragraphs(t), paragraphs(nxt)))
    assert len({got[100].fingerprint, got[101].fingerprint}) == 1


def test_peeling_recovers_digests(spark):
    from pyspark.sql import functions as F

    a, b = "\n".join(f"line {i}" for i in range(400)), "\n".join(f"line {i}" for i in range(100, 520))
    df = spark.createDataFrame([(a, b)], "a string, b string")
    df = df.select("*", *[fingerprints.entries(F.col(c)).alias(f"e{c}") for c in "ab"]).select("*", *[fingerprints.sketch(F.col(f"e{c}"), F.lit(fingerprints.CELLS).cast("long")).alias(f"f{c}") for c in "ab"])
    found = df.select(fingerprints.differing(F.col("a"), F.col("b"), F.col("fa"), F.col("fb"), F.size("ea") + F.size("eb")).alias("d")).head().d
    key = lambda t: xxhash.xxh64_intdigest(t.encode(), 42)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    assert {(x.k, x.n) for x in found} == {(signed(key(f"line {i}")), 1) for i in range(100)} | {(signed(key(f"line {i}")), -1) for i in range(400, 520)}


def measured(t):
    w = WORD.findall(t or "")
    lines = [x for x in (t or "").split("\n") if WORD.search(x)]
    tri = Counter(zip(w, w[1:], w[2:]))
    cover = {i + k for i, g in enumerate(zip(w, w[1:], w[2:])) if tri[g] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(cover)


def test_quality(docs, rows):
    text = {r[0]: r[1] for r in rows}
    got = quality.op8(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        m = measured(text[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == m
        assert r.base_failed == (m[0] < 50 or 100 * m[4] > 50 * m[0])
        assert not (r.base_failed and r.kept)


def test_quality_filter_is_native_and_keeps_columns(docs):
    out = quality.filter_quality(docs)
    assert out.columns == docs.columns
    kept = Counter(r.doc_id for r in quality.op8(docs).collect() if r.kept)
    assert Counter(r.doc_id for r in out.collect()) == kept
    assert "Python" not in out._jdf.queryExecution().toString()


def test_rule_table(docs):
    rule = quality.Rule("many", "n_words", 100, None)
    got = quality.judge(docs, rules=(rule,)).collect()
    assert all((r.failed_rules == []) == (r.n_words >= 100) for r in got)


def simhash_of(t):
    w = low(t)
    if not w:
        return 0
    sh = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    h = [xxhash.xxh64_intdigest(s, seed=42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(fps, radius):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    fs = list(fps)
    for i, a in enumerate(fs):
        for b in fs[:i]:
            if (a ^ b).bit_count() <= radius:
                root[find(a)] = find(b)
    return {f: find(f) for f in fs}


def test_simhash(docs, rows):
    fp = {r[0]: simhash_of(r[1]) for r in rows}
    of = classes(set(fp.values()), 4)
    first = defaultdict(lambda: 1 << 60)
    for d, f in fp.items():
        first[of[f]] = min(first[of[f]], d)
    got = simhash.op9(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.fingerprint == format(fp[r.doc_id], "016x")
        assert r.component_id == first[of[fp[r.doc_id]]]
    kept = [r.doc_id for r in simhash.keep_one(docs).collect()]
    assert sorted(kept) == sorted(set(first.values()))


def test_links_are_exact_on_dense_fingerprints(spark):
    """Random walks of few bits, so that chains, balls and lone fingerprints occur, in shards small and large."""
    import random

    rng = random.Random(5)
    fps = set()
    for _ in range(12):
        f = rng.getrandbits(64)
        for _ in range(rng.choice([1, 5, 60])):
            fps.add(f)
            g = f
            for _ in range(rng.choice([1, 2, 4, 5, 6])):
                g ^= 1 << rng.randrange(64)
            f = g if rng.random() < 0.5 else f
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    got = {r.node: r.root for r in simhash.components(simhash.links(df)).collect()}
    expected = classes(fps, 4)
    by_got, by_expected = defaultdict(set), defaultdict(set)
    for f in fps:
        by_got[got.get(signed(f), signed(f))].add(f)
        by_expected[expected[f]].add(f)
    assert {frozenset(x) for x in by_got.values()} == {frozenset(x) for x in by_expected.values()}


def test_token_counts(docs, rows):
    encode = packing.byte_encoder()
    text = {r[0]: r[1] or "" for r in rows}
    for r in tokencounts.op10(docs).collect():
        t = text[r.doc_id]
        n = len(t)
        e = t[: n // 3] + t[: n // 10] + t[n // 3 :]
        m = min(n // 2, len(e))
        e = e[:m] + e[min(m + 1, len(e)) :] + " (edited)"
        assert r.n_tokens == len(encode(t))
        assert r.edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
        assert r.n_tokens_edited == len(encode(e))


def test_word_count_column(docs, rows):
    got = docs.select(n_words(docs.text).alias("n")).collect()
    assert sorted(r.n or 0 for r in got) == sorted(len(WORD.findall(r[1] or "")) for r in rows)
