import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm.batches import slices, text_buffer
from quarry.llm.words import Lookup, shingle_hashes, text_shingles, word_hashes, word_spans

import pyarrow as pa


def words_of(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    return re.findall(r"[^\x20\x09-\x0D]+", low)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aAbÉé \t\n\x0b中\xa0", max_size=30), max_size=8))
def test_spans_and_shingles_match_regular_expression(texts):
    buf, off = text_buffer(pa.array(texts, pa.string()))
    s, e, woff = word_spans(buf, off)
    h = word_hashes(buf, s, e)
    want = [words_of(t) for t in texts]
    assert np.diff(woff).tolist() == [len(w) for w in want]
    flat = [w for row in want for w in row]
    by_word = {}
    for word, value in zip(flat, h.tolist()):
        assert by_word.setdefault(word, value) == value
    assert len(set(by_word.values())) == len(by_word)
    sh, so = shingle_hashes(h, woff, 3)
    by_run = {}
    for i, row in enumerate(want):
        runs = [tuple(row[j:j + 3]) for j in range(len(row) - 2)] if len(row) >= 3 else ([tuple(row)] if row else [])
        assert so[i + 1] - so[i] == len(runs)
        for run, value in zip(runs, sh[so[i]:so[i + 1]].tolist()):
            assert by_run.setdefault(run, value) == value
    assert len(set(by_run.values())) == len(by_run)


def test_nulls_and_slices():
    buf, off = text_buffer(pa.array([None, "ab", "", None], pa.string()).slice(0, 4))
    assert off.tolist() == [0, 0, 2, 2, 2]
    assert list(slices(np.array([0, 10, 10, 35, 36]), 10)) == [(0, 2), (2, 3), (3, 4)]
    sh, so = text_shingles(np.zeros(0, np.uint8), np.zeros(1, np.int64), 5)
    assert len(sh) == 0 and so.tolist() == [0]


def test_lookup():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 2**63, 5000).astype(np.uint64))
    table = Lookup(keys)
    assert (table.find(keys) == np.arange(len(keys))).all()
    assert (table.find(keys + np.uint64(1))[~np.isin(keys + np.uint64(1), keys)] == -1).all()
    assert Lookup(np.zeros(0, np.uint64)).find(keys[:3]).tolist() == [-1, -1, -1]
