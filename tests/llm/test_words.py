import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from fleetcat.llm import words as W

from .helpers import shingles, words

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aAbB é\n\t\x0b\x1c\xa0zß日", max_size=40)), min_size=1, max_size=8)


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_words_and_shingles_are_those_of_plain_python(texts):
    raw, off = W.text_buffer(pa.array(texts, pa.string()))
    for i, j in W.slices(off, 16):
        w = W.Words(raw, off[i:j + 1])
        for k in (1, 2, 5):
            for t, s in zip(texts[i:j], W.shingle_sets(w, k)):
                assert len(s) == len(shingles(t, k))
        for r, t in enumerate(texts[i:j]):
            at = slice(w.bounds[r], w.bounds[r + 1])
            got = [bytes(w.bytes[a:b]).decode() for a, b in zip(w.starts[at], w.ends[at])]
            assert got == words(t)


def test_hashes_are_equal_for_equal_words_only_and_do_not_depend_on_place():
    raw, off = W.text_buffer(pa.array(["b a ab ba a", "ab", "aa a"]))
    h = W.Words(raw, off).hashes
    names = "b a ab ba a ab aa a".split()
    assert len(set(zip(names, h.tolist()))) == len(set(names)) == len(set(h.tolist()))


def test_sliced_arrays_and_chunks():
    arr = pa.chunked_array([pa.array(["x", None]), pa.array(["", "y z"])]).slice(1, 3)
    raw, off = W.text_buffer(arr)
    assert np.diff(W.Words(raw, off).bounds).tolist() == [0, 0, 2]


def test_minima_estimate_similarity():
    a, b = W.universal(512, 3)
    x = W.mix64(np.arange(1000, dtype=np.uint64))
    y = W.mix64(np.arange(200, 1200, dtype=np.uint64))
    assert abs((W.minima(x, a, b) == W.minima(y, a, b)).mean() - 800 / 1200) < 0.08
