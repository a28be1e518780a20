"""Copies of one text spread over the buckets of the grouped steps."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from llm_fixtures import make  # noqa: F401
from test_llm_texts import TOP, brute_repeats
from tillbook.llm import jaccard, substring

BUCKETS, N = 8, 400
TEXT = " ".join(f"c{i}" for i in range(120))


def batch(ids, **more):
    columns = {"o": pa.array(ids, pa.int64()), "th": pa.array([5] * len(ids), pa.int64()), "text": pa.array([TEXT] * len(ids))} | more
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def entries(found, kind):
    """Entries of a kind in each bucket."""
    out = Counter()
    for part in found:
        for bucket, k, blob in zip(*(part.column(c).to_pylist() for c in ("bucket", "kind", "blob"))):
            out[bucket] += int(np.frombuffer(blob, np.int64, 1)[0]) if k == kind else 0
    return out


@pytest.mark.parametrize("step", ["anchors", "windows", "sets"])
def test_copies_spread_over_buckets(step):
    ids = list(range(N))
    if step == "anchors":
        found = substring._anchor_map(50, substring.PERIOD, substring.COVER, BUCKETS)([batch(ids)])
    elif step == "windows":
        at = pa.array([[0, 31, 62]] * N, pa.list_(pa.int32()))
        found = substring._window_map(50, substring.PERIOD, BUCKETS)([batch(ids, at=at)])
    else:
        found = jaccard._posting_map(np.zeros(1 << 8, np.int64), 8, 3, 90, 10, BUCKETS)([batch([TOP - 1] * N)])
    count = entries(found, 1)
    assert len(count) == BUCKETS and max(count.values()) < 2 * sum(count.values()) / BUCKETS


def test_equal_rows_are_sent_once_a_batch():
    found = list(substring._anchor_map(50, substring.PERIOD, substring.COVER, BUCKETS)([batch([3] + [TOP - 1] * N)]))
    one = list(substring._anchor_map(50, substring.PERIOD, substring.COVER, BUCKETS)([batch([3, TOP - 1])]))
    assert [entries(found, k) for k in (0, 1)] == [entries(one, k) for k in (0, 1)]


def test_hot_copies_keep_their_results(make):
    rows = [(None, TEXT)] * 50 + [(i, TEXT) for i in range(50)]
    got = substring.remove_repeats(make(rows), bucket_bytes=1 << 12).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got) == brute_repeats(rows, 50)
    groups = jaccard.jaccard_groups(make(rows), k=3, percent=90, bucket_bytes=1 << 12).collect()
    assert Counter((r.doc_id, r.component_id) for r in groups) == Counter((i, 0) for i, _ in rows)
