"""Word spans, hashes and packing against plain Python."""

import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tillbook.llm.packing import by_bucket, ranges, sliding_min, unpack
from tillbook.llm.substring import COVER, PERIOD, is_cover
from tillbook.llm.tokens import SPACES, byte_table, pieces, text_buffers, window_hashes, word_hashes, word_spans

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="ab Z\té\n日\x0b", max_size=30)), max_size=12)


@given(TEXTS)
@settings(max_examples=200, deadline=None)
def test_words(texts):
    data, offsets = text_buffers(pa.array(texts, pa.string()))
    found = [[] for _ in texts]
    for a, b in pieces(offsets, 16):
        starts, ends, rows = word_spans(data, offsets[a:b + 1], byte_table(SPACES))
        for s, e, r in zip(starts, ends, rows):
            found[a + r].append(data[s:e].tobytes().decode())
    assert found == [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]


@given(st.lists(st.text(alphabet="abAB", min_size=1, max_size=6), min_size=1, max_size=20))
@settings(max_examples=100, deadline=None)
def test_hashes_follow_the_words(words):
    data, offsets = text_buffers(pa.array([" ".join(words)]))
    starts, ends, _ = word_spans(data, offsets, byte_table(SPACES))
    for lower in (False, True):
        h = word_hashes(data, starts, ends, lower)
        key = [w.lower() if lower else w for w in words]
        assert len(set(h.tolist())) == len(set(key))
        assert all((h[i] == h[j]) == (key[i] == key[j]) for i in range(len(key)) for j in range(len(key)))
        three = window_hashes(h, 3)
        grams = [tuple(key[i:i + 3]) for i in range(len(key) - 2)]
        assert len(three) == len(grams) and len(set(three.tolist())) == len(set(grams))


def test_sliced_and_null_buffers():
    column = pa.array(["x", None, "a b", "", "c"]).slice(1, 3)
    data, offsets = text_buffers(column)
    assert [data[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:])] == [b"", b"a b", b""]


def test_packing_and_ranges():
    bucket = np.array([2, 0, 2, 1])
    blobs = dict(by_bucket(bucket, [np.arange(4), np.arange(4, dtype=np.int32) * 10]))
    assert [c.tolist() for c in unpack(blobs[2], [np.int64, np.int32])] == [[0, 2], [0, 20]]
    assert ranges(np.array([5, 9]), np.array([2, 3])).tolist() == [5, 6, 9, 10, 11]
    x = np.random.default_rng(0).integers(0, 100, 50)
    assert sliding_min(x, 31).tolist() == [x[i:i + 31].min() for i in range(20)]


def test_difference_cover():
    assert is_cover(PERIOD, COVER)
    covered = {(i, j) for i in range(PERIOD) for j in range(PERIOD)
               if any((i + s) % PERIOD in COVER and (j + s) % PERIOD in COVER for s in range(PERIOD))}
    assert len(covered) == PERIOD * PERIOD
