"""Cross-tokenizer alignment against a plain loop over tokens, matrix products against dense ones."""

import hashlib
import os
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from llm_fixtures import SCHEMA, corpus, make, rows  # noqa: F401
from tillbook.llm import alignment as A

pytestmark = pytest.mark.skipif(not os.path.exists(os.path.join(A.FOLDER, A.FILES[0])), reason="vocabulary files are not installed")

ODD = ["<|endoftext|> and </s> <s> <unk> <0x41>", "▁under▁", "a\x00b", "ﬁne ½ Å Å", "  two  spaces ", " ", "\n", "é" * 300, "=" * 700, "👩‍👩‍👧 🇩🇪 日本語",
       "a b　c", "x" * 5000, "don't we'll I'VE", "﻿bom", "tab\tand\r\nline", "0123456789" * 20, "\u0000", "ᄀᄀᄀ각 क्षि", "٣٤٥ עברית"]


def tokens(text):
    from tokenizers import Tokenizer
    import sentencepiece
    if not hasattr(tokens, "sides"):
        t = Tokenizer.from_file(os.path.join(A.FOLDER, A.FILES[0]))
        t.encode_special_tokens = True
        letters = A._byte_letters()
        names = {i: bytes(letters[c] for c in n) for n, i in t.get_vocab(with_added_tokens=False).items()}
        tokens.sides = t, names, sentencepiece.SentencePieceProcessor(model_file=os.path.join(A.FOLDER, A.FILES[1]))
    t, names, sp = tokens.sides
    a, b = t.encode(" " + text, add_special_tokens=False).ids, sp.encode(text)
    pieces = [sp.id_to_piece(i) for i in b]
    return a, b, [names[i] for i in a], [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(b, pieces)]


def aligned(text):
    """(a, b, groups, overlaps) of one text by a loop over its tokens."""
    if not text:
        return [], [], [], Counter()
    a, b, left, right = tokens(text)
    whole = (" " + text).encode()
    if b"".join(left) != whole or b"".join(right) != whole:
        return [], [], [], Counter()
    ends = lambda parts: np.cumsum([len(p) for p in parts]).tolist()
    ea, eb = ends(left), ends(right)
    over = Counter()
    for i, (x, y) in enumerate(zip([0, *ea], ea)):
        for j, (u, v) in enumerate(zip([0, *eb], eb)):
            if min(y, v) > max(x, u):
                over[i, j] = min(y, v) - max(x, u)
    groups, i, j = [], 0, 0
    for cut in sorted(set(ea) & set(eb)):
        p, q = ea.index(cut) + 1, eb.index(cut) + 1
        groups.append((a[i:p], b[j:q]))
        i, j = p, q
    return a, b, groups, over


def brute(rows):
    found = [(d, *aligned(t)[:3]) for d, t in rows]
    links = [Counter((p, q) for x, y in g for p in x for q in y) for *_, g in found]
    holds = Counter(p for c in links for p in c)
    best = defaultdict(int)
    for (p, _), n in holds.items():
        best[p] = max(best[p], n)
    out = []
    for (d, a, b, g), c in zip(found, links):
        digest = hashlib.sha256(";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g).encode()).hexdigest() if a else ""
        out.append((d, len(a), len(b), len(g), sum(c.values()), sum(n for k, n in c.items() if holds[k] == best[k[0]]),
                    sum(n * holds[k] for k, n in c.items()), digest))
    return Counter(out)


def run(docs):
    return Counter(tuple(r) for r in A.align(docs).collect())


def test_align(spark, make, rows):
    data = rows + list(enumerate(ODD)) + [(None, ODD[0]), (3, ODD[0])]
    expected = brute(data)
    assert run(make(data)) == expected
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 9)  # many segments
    try:
        assert run(make(data).repartition(4)) == expected
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sum(n for (_, n_a, *_), n in expected.items() if n_a == 0) < len(data) / 4


def test_a_third_of_copies(make, rows):
    data = rows[:40] + [(i, rows[2][1]) for i in range(20)]
    assert run(make(data)) == brute(data)


def test_tokens_and_overlap_links(make):
    texts = [t for t in ODD if len(t) < 400] + ["plain words of a text, twice: plain words"]
    got = {r.doc_id: r for r in A.tokens_and_links(make(list(enumerate(texts)) + [(99, None)])).collect()}
    assert got[99].a_ids == [] and got[99].overlaps == []
    for i, t in enumerate(texts):
        a, b, groups, over = aligned(t)
        assert (got[i].a_ids, got[i].b_ids) == (a, b)
        assert {(x.a, x.b): x.n_bytes for x in got[i].overlaps} == dict(over)
        assert got[i].a_groups == [k for k, (x, _) in enumerate(groups) for _ in x]
        assert got[i].b_groups == [k for k, (_, y) in enumerate(groups) for _ in y]


def test_both_encoders_of_side_a_agree():
    """Every code point that the quicker encoder may see, between letters, digits, spaces and marks."""
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(os.path.join(A.FOLDER, A.FILES[0]))
    t.encode_special_tokens = True
    texts = [x.format(chr(c)) for c in range(0x250) for x in ("{0}", "a{0}b", "1{0} {0}2", "  {0}{0} !{0}", "it{0}s don't{0}", "{0}\n\n{0} x")]
    assert not any(A.UNUSUAL.search(x) for x in texts)
    assert A.vocabularies()[0].encode(texts) == [e.ids for e in t.encode_batch([" " + x for x in texts], add_special_tokens=False)]


def test_row_products():
    rng = np.random.default_rng(1)
    csr = lambda m: (np.r_[0, np.cumsum((m > 0).sum(1))], np.nonzero(m)[1], m[m > 0])
    for n, k, m in [(7, 5, 6), (1, 1, 1), (4, 9, 3), (5, 4, 0), (0, 3, 2)]:
        a, b = (rng.integers(0, 3, s) * rng.integers(0, 2, s) for s in ((n, k), (k, m)))
        (p, c, v), (q, d, w) = csr(a), csr(b)
        for dense, found in ((a @ b, A.row_products(p, c, q, d, v, w)), ((a > 0).astype(int) @ (b > 0), A.row_products(p, c, q, d))):
            ptr, col, val = found
            back = np.zeros((n, m), np.int64)
            back[np.repeat(np.arange(n), np.diff(ptr)), col] = val
            assert (back == dense).all()


@pytest.mark.parametrize("data", [[], [(1, None), (None, "")], [(5, "▁")]])
def test_tables_without_tokens(spark, make, data):
    docs = make(data) if data else spark.createDataFrame([], SCHEMA)
    assert run(docs) == Counter((d, 0, 0, 0, 0, 0, 0, "") for d, _ in data)
