import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from papyra.llm import text
from papyra.llm.text import ALNUM, SPACED, Words

from . import brute

SOME = st.lists(st.one_of(st.none(), st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=40), st.text(alphabet=" \t\nabAB1é İ", max_size=60)), max_size=6)


def spelled(words):
    return [[words.word(i).decode() for i in range(a, b)] for a, b in zip(words.first[:-1], words.first[1:], strict=True)]


@settings(max_examples=150, deadline=None)
@given(SOME)
def test_words(texts):
    arr = pa.array([None, *texts], pa.string()).slice(1)
    assert spelled(Words(arr)) == [brute.spaced(t) for t in texts]
    assert spelled(Words(arr, ALNUM, lower=True)) == [brute.alnum(t) for t in texts]


@settings(max_examples=80, deadline=None)
@given(SOME)
def test_hashes_follow_words(texts):
    words = Words(pa.array(texts, pa.string()))
    flat = [w for t in texts for w in brute.spaced(t)]
    h = words.hashes()
    assert len(set(h.tolist())) == len(set(flat)) and len(h) == len(flat)
    by = dict(zip(flat, h.tolist(), strict=True))
    assert [by[w] for w in flat] == h.tolist()


def test_hash_does_not_depend_on_the_slice(monkeypatch):
    t = pa.array(["a bb ccc " * 500 + "x" * 5000, "bb ccc"])
    one = Words(t).hashes()
    monkeypatch.setattr(text, "_SLICE", 64)
    assert (Words(t).hashes() == one).all()


def test_windows_stay_in_their_text():
    words = Words(pa.array(["a b c d", "a b", None, "b c d"]))
    got, at = words.windows(words.hashes(), 3)
    assert at.tolist() == [0, 1, 6] and got[1] == got[2] != got[0]


def test_blocks():
    batch = pa.RecordBatch.from_pydict({"text": ["a" * 10, None, "b" * 50, "c"]})
    assert [b.num_rows for b in text.blocks(iter([batch]), limit=12)] == [2, 1, 1]
    assert list(text.blocks(iter([batch.slice(0, 0)]))) == []


def test_spread():
    assert text.spread(np.array([0, 3]), 2, 6).tolist() == [True, True, False, True, True, False]
    assert re.fullmatch("x", "x") and SPACED[0x1C]


def test_packed_arrays():
    from papyra.llm.packed import pack, unpack

    arrays = [np.zeros(0, "<u8"), np.arange(3, dtype="<i8"), np.zeros(5000, "<u4"), np.random.default_rng(0).integers(0, 1 << 62, 999).astype("<u8"), np.array([True, False])]
    for source in (bytes, pa.py_buffer):
        got = unpack(source(pack(*arrays)), "<u8", "<i8", "<u4", "<u8", "?")
        assert all((a == b).all() and a.dtype == b.dtype for a, b in zip(arrays, got, strict=True))
