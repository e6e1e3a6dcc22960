"""Document fingerprints by invertible Bloom lookup sketches of paragraphs.

A text's paragraphs (lines, cut at `LINE` code points) are digested to 64 bits and
each digest is added to one cell of each of three tables. A cell holds a count and
the XORs of its digests and of their checksums. The sketch of one version minus that
of another leaves the differing digests only; cells with a single one of them are
peeled until none is left. If some are left, both versions are sketched anew in
larger tables. All of it is column expressions on one row.

Defined cases: a null text counts as empty; a text without paragraphs has the empty
sketch, and two such texts are alike with 1.0; a paragraph repeated in a text counts
once; equal texts have equal fingerprints; repeated rows are neighbours of each other
in `with_next`; the only row's next document is itself; an empty table gives an empty
result. Only the named columns are read.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import text_or_empty

LINE = 200
#: Cells in each of the three tables of the fingerprint itself.
CELLS = 8
#: Steps of peeling, a table each; sketches large enough need a dozen or two.
STEPS = 72
CHECK = 99


def given(body: str, **cols: Column) -> Column:
    """`body`, SQL over the fields of `v`, which are `cols` and are evaluated once.

    The larger expressions here are SQL texts: one made of thousands of Column calls
    takes the driver longer to build than many tables take to read.
    """
    return F.get(F.call_function("transform", F.array(F.struct(*[c.alias(k) for k, c in cols.items()])), F.expr(f"v -> {body}")), F.lit(0))


def let(name: str, value: str, body: str) -> str:
    """SQL for `body`, in which `name` is a value that is evaluated once."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


NONE = "named_struct('n', 0L, 'k', 0L, 'x', 0L)"


def _digests(text: str) -> str:
    return rf"array_distinct(transform(regexp_extract_all({text}, '[^\\n]{{1,{LINE}}}', 0), p -> xxhash64(p)))"


def _entries(keys: str) -> str:
    return f"transform({keys}, d -> named_struct('n', 1L, 'k', d, 'x', xxhash64(d, {CHECK})))"


def _placed(found: str, size: str, salt: int) -> str:
    """Entries with their places in the three tables, and the run of about sqrt(size) cells that each place is in."""
    places = ", ".join(f"pmod(xxhash64(e.k, {r + 3 * salt}), {size})" for r in range(3))
    one = let("p", f"array({places})", "named_struct('n', e.n, 'k', e.k, 'x', e.x, 'p', p, 'g', transform(p, y -> y div step))")
    return let("step", f"ceil(sqrt({size}))", f"transform({found}, e -> {one})")


def _table(placed: str, r: str, size: str) -> str:
    """Cells (n, k, x) of table `r`: what stands in a cell is summed and XORed.

    Entries are dealt to runs of cells and then to the cells of a run, so that work is
    the number of entries times sqrt(size) and not times size.
    """
    xor = lambda c: f"aggregate(m, 0L, (a, e) -> a ^ e.{c})"
    cell = f"if(size(m) = 0, {NONE}, named_struct('n', aggregate(m, 0L, (a, e) -> a + e.n), 'k', {xor('k')}, 'x', {xor('x')}))"
    cells = f"transform(sequence(g * step, least(g * step + step, {size}) - 1), i -> if(size(o) = 0, {NONE}, {let('m', f'filter(o, e -> get(e.p, {r}) = i)', cell)}))"
    runs = f"flatten(transform(sequence(0L, ({size} - 1) div step), g -> {let('o', f'filter({placed}, e -> get(e.g, {r}) = g)', cells)}))"
    return let("step", f"ceil(sqrt({size}))", runs)


def _sketch(found: str, size: str, salt: int) -> str:
    return let("q", _placed(found, size, salt), f"flatten(transform(array(0, 1, 2), r -> {_table('q', 'r', size)}))")


def _subtract(a: str, b: str) -> str:
    return f"zip_with({a}, {b}, (c, d) -> named_struct('n', c.n - d.n, 'k', c.k ^ d.k, 'x', c.x ^ d.x))"


def _peel(cells: str, size: str, salt: int) -> str:
    """The differing digests (k, n: 1 in the first version only, -1 in the second only), or null if peeling stops early.

    A step takes the cells with a single digest out of one table and out of the other
    two; the tables take turns (`a` is table j mod 3). It ends when each in turn had none.
    """
    single = f"abs(c.n) = 1 AND xxhash64(c.k, {CHECK}) = c.x"
    table = lambda r: f"slice({cells}, cast({size} * {r} + 1 AS int), cast({size} AS int))"
    start = f"named_struct('a', {table(0)}, 'b', {table(1)}, 'c', {table(2)}, 'found', cast(array() AS array<struct<k: bigint, n: bigint>>), 'idle', 0)"
    turned = "named_struct('a', s.b, 'b', s.c, 'c', s.a, 'found', s.found, 'idle', s.idle + 1)"
    without = lambda t, by: _subtract(f"s.{t}", _table("w", f"pmod(j + {by}, 3)", size))
    taken = f"named_struct('a', {without('b', 1)}, 'b', {without('c', 2)}, 'c', transform(s.a, c -> if({single}, {NONE}, c)), 'found', concat(s.found, transform(w, e -> named_struct('k', e.k, 'n', e.n))), 'idle', 0)"
    step = f"if(s.idle >= 3, s, {let('u', f'filter(s.a, c -> {single})', f'if(size(u) = 0, {turned}, {let("w", _placed("u", size, salt), taken)})')})"
    end = f"aggregate(sequence(0, {STEPS - 1}), {start}, (s, j) -> {step})"
    rest = "exists(concat(z.a, z.b, z.c), c -> c.n <> 0 OR c.k <> 0 OR c.x <> 0)"
    return let("z", end, f"if({rest}, null, z.found)")


def entries(text: Column) -> Column:
    """The text's distinct paragraph digests with their checksums, as single entries of a sketch."""
    return given(_entries(_digests("v.text")), text=text)


def sketch(found: Column, size: Column, salt: int = 0) -> Column:
    """Cells (n, k, x) of the three tables of `size` cells, one table after the other."""
    return given(_sketch("v.found", "v.size", salt), found=found, size=size.cast("long"))


def differing(text_a: Column, text_b: Column, cells_a: Column, cells_b: Column, n: Column) -> Column:
    """Digests that differ between two texts: from their fingerprints' cells, else from larger sketches.

    `n`: paragraphs of both. The second try has room for all of them; the third has
    twice that and other hashes. Digests that even that leaves are compared as sets.
    """

    def larger(salt: int, times: float) -> str:
        diff = _subtract(*[_sketch(_entries(f"t.{x}"), "sz", salt) for x in "ab"])
        return let("sz", f"ceil(v.n * {times}D) + 6", let("diff", diff, _peel("diff", "sz", salt)))

    only = lambda x, y, sign: f"transform(array_except({x}, {y}), k -> named_struct('k', k, 'n', {sign}L))"
    again = let("t", f"named_struct('a', {_digests('v.text_a')}, 'b', {_digests('v.text_b')})", f"coalesce({larger(1, 0.5)}, {larger(2, 1.0)}, concat({only('t.a', 't.b', 1)}, {only('t.b', 't.a', -1)}))")
    first = let("diff", _subtract("v.cells_a", "v.cells_b"), _peel("diff", f"{CELLS}L", 0))
    return given(f"coalesce({first}, {again})", text_a=text_a, text_b=text_b, cells_a=cells_a, cells_b=cells_b, n=n)


def as_string(cells: Column) -> Column:
    """The cells in hexadecimal, with a dot between cells."""
    return F.array_join(F.transform(cells, lambda c: F.lower(F.concat(F.hex(c["n"]), F.lit("-"), F.hex(c["k"]), F.lit("-"), F.hex(c["x"])))), ".")


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = 2000, most: int = 4096) -> DataFrame:
    """(doc_id, text, next_text): the text of the next document by descending numeric id; after the last comes the first.

    Ids are cut into ranges of about `rows` documents (at most `most` ranges, whose
    bounds are all that the driver gets). The first document of the following range is
    added to each range, so that one shuffle and a window over the range suffice.
    """
    src = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    n = src.count()
    parts = max(1, min(most, n // rows))
    cuts = src.agg(F.percentile_approx("doc_id", [k / parts for k in range(1, parts)] or [0.5], 20 * parts + 100)).head()[0] or []
    cuts, step = sorted(set(cuts)), max(1, int(len(cuts) ** 0.5))
    lit = lambda x: F.lit(x) if x else F.array().cast("array<bigint>")
    coarse = F.size(F.filter(lit(cuts[step - 1 :: step]), lambda b: b < F.col("doc_id")))
    part = coarse * step + F.size(F.filter(F.slice(lit(cuts), coarse * step + 1, F.lit(step)), lambda b: b < F.col("doc_id")))
    src = src.withColumn("part", F.coalesce(part, F.lit(0)))
    tops = sorted(src.groupBy("part").agg(F.max("doc_id").alias("top")).collect())
    follow = [(below["top"], here["part"]) for below, here in zip(tops[-1:] + tops[:-1], tops, strict=True)] or [(0, 0)]
    kind = f"array<struct<top:{src.schema['doc_id'].dataType.simpleString()},target:int>>"
    follow = docs.sparkSession.range(1).select(F.inline(F.from_json(F.lit(json.dumps([{"top": t, "target": p} for t, p in follow])), kind)))
    heads = src.join(F.broadcast(follow), F.col("doc_id").eqNullSafe(F.col("top"))).select("doc_id", "text", F.col("target").alias("part"), F.lit(True).alias("extra"))
    rows_ = src.select("doc_id", "text", "part", F.lit(False).alias("extra")).union(heads)
    order = Window.partitionBy("part").orderBy("extra", F.desc_nulls_last("doc_id"), F.xxhash64("text"))
    return rows_.withColumn("next_text", F.lead("text").over(order)).filter(~F.col("extra")).select("doc_id", "text", "next_text")


def compare(pairs: DataFrame, others: dict[str, str], text_col: str = "text") -> DataFrame:
    """Adds fp (cells of text) and for each `name: column` in others fp_name and near_name: shared paragraphs over all paragraphs of both."""
    # all entries, all sketches, all comparisons: large expressions are analysed with every later step
    texts = {"": text_col} | {f"_{name}": other for name, other in others.items()}
    df = pairs.withColumns({f"__e{k}": entries(F.col(t)) for k, t in texts.items()})
    df = df.withColumns({f"fp{k}": sketch(F.col(f"__e{k}"), F.lit(CELLS).cast("long")) for k in texts})

    def near(k: str, other: str) -> Column:
        n = F.size("__e") + F.size(f"__e{k}")
        return given("if(v.n = 0, 1D, (v.n - v.d) / (v.n + v.d))", n=n, d=F.size(differing(F.col(text_col), F.col(other), F.col("fp"), F.col(f"fp{k}"), n)))

    return df.withColumns({f"near{k}": near(k, t) for k, t in texts.items() if k})


def op7(docs: DataFrame) -> DataFrame:
    df = with_next(docs)
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    df = df.withColumn("edited", F.concat(F.substring("text", F.lit(1), n - third), F.substring("next_text", F.lit(1), third)))
    df = compare(df, {"edited": "edited", "next": "next_text"})
    return df.select("doc_id", n.cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), as_string(F.col("fp")).alias("fingerprint"), as_string(F.col("fp_edited")).alias("edited_fingerprint"), "near_edited", "near_next")
