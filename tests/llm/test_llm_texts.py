"""Operators on words and shingles against brute force on small fixtures with odd cases."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from llm_fixtures import make, rows  # noqa: F401
from tillbook.llm import decontam, jaccard, substring
from tillbook.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LETTER = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TOP = 1 << 63


def brute_repeats(rows, window):
    words = [(TOP if i is None else i, WORD.findall(t or "")) for i, t in rows]
    first = {}
    for i, ws in words:
        for a in range(len(ws) - window + 1):
            key = tuple(ws[a:a + window])
            first[key] = min(first.get(key, TOP + 1), i)
    out = []
    for (i, t), (o, ws) in zip(rows, words):
        gone = {p for a in range(len(ws) - window + 1) if first[tuple(ws[a:a + window])] < o for p in range(a, a + window)}
        out.append((i, len(ws), len(gone), " ".join(w for p, w in enumerate(ws) if p not in gone)))
    return Counter(out)


@pytest.mark.parametrize("window,bucket", [(50, 32 << 20), (50, 1 << 10), (35, 1 << 12)])
def test_substring_dedup(make, rows, window, bucket):
    got = substring.remove_repeats(make(rows), window=window, bucket_bytes=bucket).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got) == brute_repeats(rows, window)
    assert all(sum(s.stop - s.start for s in r.spans) == r.n_removed for r in got)
    assert sum(r.n_removed for r in got) > 300


def test_substring_dedup_empty_and_cover(make, spark):
    assert substring.remove_repeats(make([])).count() == 0
    with pytest.raises(ValueError):
        substring.remove_repeats(make([]), cover=(0, 1))


def test_substring_hot_passage(make):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, f"a{i} {passage} b{i}") for i in range(400)]
    got = {r.doc_id: r for r in substring.remove_repeats(make(rows), bucket_bytes=1 << 12).collect()}
    assert got[0].n_removed == 0 and all(got[i].n_removed == 60 and got[i].kept == f"a{i} b{i}" for i in range(1, 400))


def brute_groups(rows, percent=90, k=3):
    sets = []
    for _, t in rows:
        ws = [w.translate(ASCII) for w in WORD.findall(t or "")]
        sets.append({tuple(ws[i:i + k]) for i in range(max(len(ws) - k + 1, 1))} if ws else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), TOP), TOP if d is None else d)
    return Counter((d, len(sets[i]), None if least[find(i)] == TOP else least[find(i)]) for i, (d, _) in enumerate(rows))


def ladder(n=240):
    """Near copies of one text, chains of edits, and small sets around every boundary."""
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(n):  # copies with one word changed, some with four
        ws = list(base)
        for j in range(1 if i % 3 else 4):
            ws[(i * 7 + j * 31) % 120] = f"c{i}_{j}"
        rows.append((1000 + i, " ".join(ws)))
    chain = list(base)
    for i in range(12):  # each a few words from the one before, the ends far apart
        chain = chain[2:] + [f"d{i}", f"e{i}"]
        rows.append((500 + i, " ".join(chain)))
    for size in range(1, 45):  # a set, the same with one word more, and one word changed at the end
        ws = [f"s{size}_{j}" for j in range(size + 2)]
        rows += [(5000 + size * 10, " ".join(ws)), (5001 + size * 10, " ".join(ws + ["more"])), (5002 + size * 10, " ".join(ws[:-1] + ["other"]))]
    return rows


@pytest.mark.parametrize("percent", [90, 80])
def test_jaccard_groups(make, rows, percent):
    got = jaccard.jaccard_groups(make(rows), k=3, percent=percent, bucket_bytes=1 << 12).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_groups(rows, percent, 3)


@pytest.mark.parametrize("top", [None, 40])
def test_jaccard_boundaries_and_hot_group(make, monkeypatch, top):
    if top is not None:  # any boundary between light and heavy sets gives the same result
        monkeypatch.setattr(jaccard, "boundary", lambda *a: top)
    rows = ladder()
    got = jaccard.jaccard_groups(make(rows), k=3, percent=90, bucket_bytes=1 << 13).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_groups(rows)


def test_jaccard_rounds_settle_lists_without_a_hub(make):
    """A group in which no set is near all others needs further rounds."""
    base = [f"b{i}" for i in range(60)]
    rows = []
    for i in range(40):
        ws = base + [f"x{(i + j) % 40}" for j in range(6)]
        rows.append((i, " ".join(ws)))
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_groups(make(rows), k=3, percent=90).collect()) == brute_groups(rows)


def test_large_sets_are_told_apart_by_wide_sketches(make):
    """Texts of thousands of words that share many rare shingles: some link, some just do not, one has half the words."""
    rng = random.Random(3)
    base = [f"v{i}" for i in range(3000)]
    rows = []
    for i, changes in enumerate([0, 1, 20, 49, 50, 51, 52, 53, 60, 90, 300, 900]):
        ws = list(base)
        for at in rng.sample(range(1, 1000), changes):
            ws[3 * at] = f"c{i}_{at}"
        rows.append((i, " ".join(ws)))
    rows += [(100, " ".join(base[:1500])), (101, " ".join(base[:2700])), (102, " ".join(base[:2730]))]
    for k, percent in ((3, 90), (5, 80)):
        got = jaccard.jaccard_groups(make(rows), k=k, percent=percent).collect()
        assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_groups(rows, percent, k)


def test_wide_sketches_never_exceed_the_difference():
    rng = np.random.default_rng(4)
    for n, m in ((700, 720), (1500, 1600), (4000, 4300), (9000, 20000)):
        words = [f"w{i}" for i in range(max(n, m) + 400)]
        a, b = words[:n], words[300:300 + m]
        table = pa.table({"c": ["a", "b"], "text": [" ".join(a), " ".join(b)]})
        wide = [x for out in jaccard._wide_map(1, 90)(table.to_batches()) for x in out.column("wide").to_pylist()]
        assert [8 * len(x) for x in wide] == [jaccard.sketch_width(n, 90), jaccard.sketch_width(m, 90)]
        assert jaccard._apart(*wide) <= len(set(a) ^ set(b))
        assert jaccard._apart(wide[0], wide[0]) == 0


def test_defaults_are_five_words_and_four_fifths(make):
    """A text of 100 words with two separate one-word edits is a near copy (86 of 106 shingles)."""
    ws = [f"q{i}" for i in range(100)]
    edited = ws[:30] + ["x"] + ws[31:70] + ["y"] + ws[71:]
    far = ws[:10] + ["s"] + ws[11:50] + ["t"] + ws[51:90] + ["u"] + ws[91:]  # three edits elsewhere: 81 of 111
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_groups(make([(1, " ".join(ws)), (2, " ".join(edited)), (3, " ".join(far))])).collect()}
    assert got == {1: 1, 2: 1, 3: 3}


def test_one_of_each_group(make, rows):
    kept = Counter((r.doc_id, r.text) for r in jaccard.one_of_each_group(make(rows)).collect())
    wordless = Counter((d, t) for d, t in rows if not WORD.findall(t or ""))
    assert all(kept[x] == n for x, n in wordless.items())
    groups = {c for _, n, c in brute_groups(rows, 80, 5) if n}
    with_words = [(d, t) for d, t in kept.elements() if WORD.findall(t or "")]
    assert {d for d, _ in with_words} == groups
    assert jaccard.jaccard_groups(make([])).count() == 0 and jaccard.one_of_each_group(make([])).count() == 0


def test_components(spark):
    edges = [(f"n{i:03}", f"n{i + 1:03}") for i in range(0, 90) if i % 30 != 29] + [("a", "a"), ("hub", "n000")] + [("hub", f"z{i}") for i in range(200)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u string, v string")).collect()}
    assert got["n029"] == got["z7"] == got["n000"] and got["n030"] == got["n059"] == "n030" and got["n089"] == "n060" and "a" not in got
    assert components(spark.createDataFrame([], "u string, v string")).count() == 0


ITEMS = [("7", "w1 W2 w3! w4 w5 w6 w7 w8 w9 w10 w11 w12"), ("8", "Naïve ÉTÉ"), ("9", "the"), ("10", ""), ("11", None), ("12", "never seen here at all x"),
         (None, "one"), ("7", "w1 W2 w3! w4 w5 w6 w7 w8 w9 w10 w11 w12"), ("13", "w2 w3 w4 w5 w6 w7 w8 w9 w10 w11"), ("14", "K k")]


def brute_leaks(rows, items, window=10):
    wins = []
    for item, t in items:
        ws = LETTER.findall((t or "").translate(ASCII))
        wins += [(item, tuple(ws[i:i + window])) for i in range(max(len(ws) - window + 1, 1))] if ws else []
    out = []
    for d, t in rows:
        ws = LETTER.findall((t or "").translate(ASCII))
        hit, ids = set(), set()
        for item, w in wins:
            for i in range(len(ws) - len(w) + 1):
                if tuple(ws[i:i + len(w)]) == w:
                    hit.update(range(i, i + len(w)))
                    ids.add(item)
        ids = sorted(ids - {None})
        out.append((d, len(ws), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return Counter(out)


def test_decontamination(make, spark, rows):
    planted = rows + [(70001, "x y " + ITEMS[0][1].replace("!", ".").upper() + " z"), (70002, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 x w12"),
                      (70003, "naïve été the the K\u212a k"), (70004, "w1,w2;w3 w4 w5 w6 w7 w8 w9 w10 w11 w12 w1 w2 w3 w4 w5 w6 w7 w8 w9 w10")]
    items = spark.createDataFrame([(*i, "x", "x") for i in ITEMS], "item_id string, text string, term string, words string")
    got = decontam.decontaminate(make(planted), items).collect()
    expected = brute_leaks(planted, ITEMS)
    assert Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got) == expected
    clean = decontam.clean_documents(make(planted), items)
    assert set(clean.columns) == set(make(planted).columns)
    assert clean.count() == sum(n for x, n in expected.items() if not x[-1])


def test_decontamination_empty(make, spark, rows):
    no_items = spark.createDataFrame([], "item_id long, text string")
    assert decontam.decontaminate(make(rows), no_items).where("contaminated").count() == 0
    assert decontam.decontaminate(make([]), no_items).count() == 0


def test_proximity(make, spark):
    items = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    docs = make([(1, "alpha beta gamma"), (2, "alpha beta x gamma"), (3, "alpha q q q q q gamma beta"), (4, "gamma")])
    windows = decontam.item_windows(items)
    found = decontam.matches(*decontam.index(docs, windows), slack=2)
    got = {(r.doc_id, r.exact) for r in found.collect()}
    assert (1, True) in got and (2, True) not in got and not [x for x in got if x[0] == 4]
    assert {d for d, _ in got} >= {1, 2}


@pytest.mark.parametrize("top", [11, 13, 20])
def test_jaccard_light_sets_of_two_sizes(make, monkeypatch, top):
    """Two extensions of one set link with it, not with each other, whichever of them has the smallest hash."""
    monkeypatch.setattr(jaccard, "boundary", lambda *a: top)
    rows = []
    for i in range(30):
        ws = [f"l{i}_{j}" for j in range(12)]
        rows += [(3 * i, " ".join(ws + ["one"])), (3 * i + 1, " ".join(ws + ["two"])), (3 * i + 2, " ".join(ws))]
        more = [f"m{i}_{j}" for j in range(12)]  # the other way round: one set within two, and two smaller ones within it
        rows += [(1000 + 4 * i, " ".join(more)), (1001 + 4 * i, " ".join(more[1:])), (1002 + 4 * i, " ".join(more[:-1]))]
    got = jaccard.jaccard_groups(make(rows), k=3, percent=90).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_groups(rows)


def test_one_of_each_group_keeps_unrelated_texts_of_equal_ids(make):
    """Null and repeated ids: texts without a link all stay, linked ones leave one."""
    text = lambda i: " ".join(f"u{i}_{j}" for j in range(40))
    alone = [(None, text(i)) for i in range(20)] + [(7, text(i)) for i in range(20, 30)]
    linked = [(None, text(40)), (None, text(40) + " more"), (None, text(40)), (7, text(41)), (7, text(41) + " more")]
    kept = Counter((r.doc_id, r.text) for r in jaccard.one_of_each_group(make(alone + linked)).collect())
    assert all(kept[x] == 1 for x in alone)
    assert sum(kept.values()) == len(alone) + 2 and sum(kept[x] for x in set(linked[:3])) == 1


def test_decontamination_null_ids(make, spark):
    """Documents without an id are found like others, and told apart by their texts."""
    docs = [(None, "x " + ITEMS[0][1]), (None, "y y " + ITEMS[0][1]), (None, "clean words only"), (None, "x " + ITEMS[0][1]), (4, ITEMS[0][1])]
    items = spark.createDataFrame(ITEMS, "item_id string, text string")
    got = decontam.decontaminate(make(docs), items).collect()
    expected = brute_leaks(docs, ITEMS)
    assert Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got) == expected
    assert [r.text for r in decontam.clean_documents(make(docs), items).collect()] == ["clean words only"]
