from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from weftline.llm import packing, warc
from weftline.llm.tokencounts import Tree, pretoken_counter


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=12))
def test_plan_places_every_piece_once(histogram):
    used = Counter()
    for combo, times in packing.plan(histogram, 64):
        assert times > 0
        assert sum(n * m for n, m in combo.items()) <= 64
        for n, m in combo.items():
            used[n] += m * times
    assert used == Counter(histogram)


@given(st.integers(0, 5000))
def test_pieces_cover_a_document(n):
    parts = packing.split_at(n, 1024)
    assert [s for s, _ in parts] == [sum(k for _, k in parts[:i]) for i in range(len(parts))]
    assert sum(k for _, k in parts) == n
    assert all(k == 1024 for _, k in parts[1:])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=3000), max_size=5), st.integers(1, 19))
def test_frames_are_found_again(records, level):
    import zstandard

    content = b"".join(zstandard.ZstdCompressor(level=level, write_checksum=True).compress(r) for r in records)
    assert list(warc.frames(content)) == records


PATTERN, COUNT = pretoken_counter()


@settings(max_examples=80, deadline=None)
@given(st.text(max_size=200), st.integers(0, 220), st.integers(0, 40), st.text(max_size=30))
def test_tree_follows_any_edit(text, at, n, new):
    tree = Tree.of(text, PATTERN, COUNT)
    after, _ = tree.edit(text, at, at + n, new, PATTERN, COUNT)
    assert after == text[: min(at, len(text))] + new + text[min(at + n, len(text)) :]
    assert tree.tokens == sum(COUNT(p) for p in PATTERN.findall(after))
