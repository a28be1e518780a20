"""Ranked search against brute force, bounds against exact scores, odd tables."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from llm_fixtures import SCHEMA, corpus, make, rows  # noqa: F401
from tillbook.llm import signatures as S

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(ASCII))


def brute(rows, queries, top):
    """(item_id, rank, doc_id, score) of every distinct item row."""
    bags = [(d, Counter(terms(t)), len(terms(t))) for d, t in rows if terms(t)]
    n, total = len(bags), sum(b[2] for b in bags)
    df = Counter(t for _, bag, _ in bags for t in bag)
    out = []
    for item, text in set(queries):
        scored = []
        for d, bag, size in bags:
            m = 25 + 75 * size * n // total
            score = sum(k * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * bag[t] // (1000 * bag[t] + 8 * m))
                        for t, k in Counter(terms(text)).items() if t in bag)
            if score > 0:
                scored.append((-score, d is None, d or 0))
        out += [(item, k + 1, None if none else d, -s) for k, (s, none, d) in enumerate(sorted(scored)[:top])]
    return Counter(out)


def queries_of(rows, n=25):
    rng = random.Random(4)
    pool = [t for _, t in rows if t and len(t) > 30]
    out = [(i, " ".join(rng.choice(pool).split()[:rng.randint(1, 40)])) for i in range(n)]
    return out + [(90, "nowhere to-be found"), (91, ""), (92, None), (None, pool[0]), (0, out[0][1]), (5, "the of the"), (94, "ÉTÉ été 日本")]


def run(spark, docs, queries, **more):
    table = spark.createDataFrame([(i, t, 1) for i, t in queries], "item_id long, text string, doc_id int")
    return Counter(tuple(r) for r in S.search(docs, table, **more).select("item_id", "rank", "doc_id", "score").collect())


@pytest.mark.parametrize("top", [1, 10])
def test_search(spark, make, rows, top):
    queries = queries_of(rows)
    assert run(spark, make(rows), queries, top=top) == brute(rows, [q for q in queries if q[1]], top)


def test_blocks_of_items_and_many_copies(spark, make, rows, monkeypatch):
    """Items in several blocks; a third of the rows are copies of one text and the ids tie."""
    data = rows + [(20_000 + i % 60, rows[2][1]) for i in range(90)] + [(None, rows[2][1])] * 20
    queries = queries_of(rows) + [(200, rows[2][1])]
    expected = brute(data, [q for q in queries if q[1]], 10)
    monkeypatch.setattr(S, "ITEM_BYTES", 800)
    assert run(spark, make(data).repartition(5), queries) == expected


def test_joined_by_shuffle(spark, make, rows, monkeypatch):
    monkeypatch.setattr("tillbook.llm.common.BROADCAST_ROWS", 0)
    queries = queries_of(rows, 8)
    assert run(spark, make(rows), queries) == brute(rows, [q for q in queries if q[1]], 10)


def test_bounds_hold_and_are_near(spark, make):
    rng = random.Random(2)
    data = [(i, " ".join(rng.choice(["x", "y"]) * rng.randint(0, 2) + "t%d" % min(int(rng.expovariate(0.02)), 900) for _ in range(rng.choice([3, 60, 900]))))
            for i in range(400)]
    index = S.build_index(make(data))
    texts = [data[i][1][:400] for i in range(0, 400, 20)]
    items = S._Items(texts, index)
    exact = {}
    for q, text in enumerate(texts):
        for (_, _, d, s), _ in brute(data, [(q, text)], 400).items():
            exact[q, d] = s
    over = []
    for row in index.where("width is not null").collect():
        lens, ids = np.frombuffer(row.lens, np.int64), np.frombuffer(row.ids, np.int64)
        for a, item, bound in items.bounds(row.width, lens, np.frombuffer(row.slices, np.uint8).reshape(row.width, -1)):
            for i, q in enumerate(item):
                for j in range(bound.shape[1]):
                    true = exact.get((int(q), int(ids[a + j])), 0)
                    assert bound[i, j] >= true
                    over.append((bound[i, j] - true) / max(true, 1) if true else 0)
    assert len(over) == 400 * 20 and np.mean(over) < 0.2


@pytest.mark.parametrize("data", [[], [(1, None), (2, "")], [(3, "- . /")]])
def test_empty(spark, make, data):
    docs = make(data) if data else spark.createDataFrame([], SCHEMA)
    assert run(spark, docs, [(1, "some words")]) == Counter()
    assert run(spark, make([(1, "some words")]), []) == Counter()
