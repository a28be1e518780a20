"""Adaptive quality rules: counts against plain Python, sketches, cutoffs, odd tables."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from llm_fixtures import SCHEMA, corpus, make, rows  # noqa: F401
from tillbook.llm import rules as R

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    ws = WORD.findall(text)
    windows = [tuple(ws[i:i + 5]) for i in range(len(ws) - 4)]
    seen, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if seen[w] > 1:
            covered.update(range(i, i + 5))
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


def odd_texts():
    rng = random.Random(5)
    texts = [" ".join(rng.choice("ab") for _ in range(n)) for n in range(0, 40)]
    texts += ["a b c d e\n" * 7, "x\n\nx\n \nx\n", "a|b <c> $5 #tag", "日本 日本 日本 日本 日本 日本", "\x85 \xa0 a\x0bb\x0cc\rd", "q " * 5000]
    return texts


def test_counts(make, rows):
    data = [(i, t) for i, (_, t) in enumerate(rows)] + [(1000 + i, t) for i, t in enumerate(odd_texts())]
    got = {r.doc_id: tuple(r[1:6]) for r in R.judge(make(data)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()}
    assert got == {i: brute(t) for i, t in data}


def bucket(v):
    s = max(v.bit_length() - 6, 0)
    return v >> s << s


def test_sketches_merge_and_keep_their_error(spark):
    rng = random.Random(1)
    values = [rng.choice([0, 3, 70, 999, 10 ** 6]) + rng.randrange(1000) for _ in range(3000)]
    rows = spark.createDataFrame([("a" if i % 3 else "b", v) for i, v in enumerate(values)], "g string, v long")
    fine = R.sketch(rows, ["g"], {"symbols": F.col("v")})
    got = {(r.g, r.bucket): r.n for r in fine.collect()}
    assert got == dict(Counter(("a" if i % 3 else "b", bucket(v)) for i, v in enumerate(values)))
    whole = R.merged(fine.withColumn("k", F.lit(0)), ["k"])
    assert {r.bucket: r.n for r in whole.collect()} == dict(Counter(map(bucket, values)))
    q = R.quartiles(whole, ["k"]).first()
    for found, exact in ((q.q25_symbols, sorted(values)[len(values) // 4 - 1]), (q.q75_symbols, sorted(values)[3 * len(values) // 4 - 1])):
        assert found <= exact <= found * 33 / 32 + 1
    assert q.n_docs == len(values) and q.q25_repeats is None


def plain_quartiles(values):
    values = sorted(map(bucket, values))
    return values[-(-len(values) // 4) - 1], values[-(-3 * len(values) // 4) - 1]


def test_verdicts(make):
    """Every verdict recomputed: own, language's or overall cutoffs, junk out, other documents kept."""
    rng = random.Random(9)
    prose = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(n))
    data = [(i, prose(rng.randint(12, 200))) for i in range(400)]
    junk = [(1000 + i, " ".join(w + "$$" for w in prose(60).split())) for i in range(20)] + [(2000, prose(30) + " " + "ab cd ef gh ij " * 9)]
    table = make(data + junk, langs=("en", "en", "en", "fr", None), sources=("big", "big", "big", "small", None))
    got = R.judge(table, keep=("doc_id", "lang", "source"), least=100).collect()
    measured = {}
    for r in got:
        n_lines = max(r.n_lines, 1)
        measured[r.doc_id] = {"symbols": 1000 * r.n_symbols // r.n_words, "dup_lines": 1000 * r.n_dup_lines // n_lines,
                              "repeats": 1000 * r.n_repeat_words // r.n_words, "word_len": 1000 * r.word_chars // r.n_words}
    for r in got:
        own = [x.doc_id for x in got if (x.lang, x.source) == (r.lang, r.source)]
        lang = [x.doc_id for x in got if x.lang == r.lang]
        ids = own if len(own) >= 100 else lang if len(lang) >= 100 else [x.doc_id for x in got]
        bad = []
        for m, slack in R.SLACK.items():
            q1, q3 = plain_quartiles([measured[i][m] for i in ids])
            room = 3 * (q3 - q1) + slack + (R.SPREAD / r.n_words ** 0.5 if m == "word_len" else 0)
            if measured[r.doc_id][m] > q3 + room or m == "word_len" and measured[r.doc_id][m] < q1 - room:
                bad.append(m)
        assert sorted(set(r.failed)) == sorted(bad)
        assert r.kept == (not r.base_failed and not bad)
    assert all(r.kept == (r.doc_id < 1000) for r in got)


def test_filter_keeps_columns_and_repeated_rows(make, rows):
    docs = make(rows * 2, langs=("en",), sources=("s",))
    kept = R.good_documents(docs)
    assert kept.columns == docs.columns
    judged = R.judge(docs)
    assert kept.count() == judged.where("kept").count() and judged.count() == 2 * len(rows)


@pytest.mark.parametrize("data", [[], [(None, None)], [(1, ""), (1, "")]])
def test_tables_without_words(make, spark, data):
    docs = make(data) if data else spark.createDataFrame([], SCHEMA)
    got = R.judge(docs).collect()
    assert len(got) == len(data) and all(r.base_failed and not r.kept and r.n_words == 0 for r in got)
