import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tablewright.llm import suffix_arrays


def plain(text):
    return sorted(range(len(text)), key=lambda i: text[i:])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60))
def test_array_and_prefixes_equal_brute_force(text):
    array = suffix_arrays.suffix_array(np.array(text, dtype=np.int64), 4)
    assert array.tolist() == plain(text)
    expected = [0] * len(text)
    for a, b in zip(array, array[1:]):
        x, y = text[a:], text[b:]
        expected[b] = min(5, next((i for i, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y))))
    assert suffix_arrays.common_prefixes(np.array(text, dtype=np.int64), array, 5, lane=7).tolist() == expected


def test_recursion_and_doubling_agree(monkeypatch):
    draw = np.random.default_rng(3)
    text = np.concatenate([draw.integers(0, 5, 400)] * 3 + [draw.integers(0, 5, 50)])
    expected = plain(text.tolist())
    assert suffix_arrays.suffix_array(text, 5).tolist() == expected
    monkeypatch.setattr(suffix_arrays, "MOST_BUCKETS", 0)
    assert suffix_arrays.suffix_array(text, 5).tolist() == expected
