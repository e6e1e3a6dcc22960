from hypothesis import given
from hypothesis import strategies as st

from weftline.functions import text as T
from weftline.streaming.state import Lockout


@given(st.lists(st.sampled_from(["https://e.org/a", "a@b.com", "{{x}}", "${y}", "<b>", "2024-01-02", "v1.2", " ", "words", "é"]), max_size=12))
def test_masks_open_again(parts):
    text = " ".join(parts)
    masked, kept = T.mask(text)
    for n in sorted(kept, reverse=True):
        masked = masked.replace(f"⟦T{n}⟧", kept[n])
    assert masked == text


@given(st.lists(st.tuples(st.floats(0, 400), st.booleans()), max_size=40))
def test_lockout_follows_five_failures(steps):
    rule, s, at, run = Lockout(), (0, 0.0, 0.0), 0.0, 0
    for gap, failed in steps:
        at += gap
        s, outcome = rule.step(s, at, failed)
        run = 0 if outcome in ("ok", "lock", "locked") else run + 1
        assert run < rule.limit
