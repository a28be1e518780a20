"""Fingerprints, language models, quality network and the pipeline."""

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from conftest import SF_ORACLE, SF_SMALL
from test_llm_texts import ASCII, ITEMS, WORD, brute_groups, brute_leaks
from llm_fixtures import make, rows  # noqa: F401
from tillbook.llm import fingerprints as fp
from tillbook.llm import langid, quality
from tillbook.llm.tokens import text_buffers


def plain_chunks(raw: bytes):
    h, out, at, since = 0, [], 0, 0
    for i, b in enumerate(raw):
        h = ((h << 1) + int(fp._GEAR[b])) & 0xFFFFFFFF
        n = i + 1 - at
        bits = fp.HARD_BITS if n < fp.NORMAL else fp.EASY_BITS
        if n >= fp.MOST or n >= fp.LEAST and h >> (32 - bits) == 0:
            out.append(raw[at:i + 1])
            at = i + 1
    return out + ([raw[at:]] if at < len(raw) else [])


def test_chunks_follow_the_plain_rule(rows):
    texts = [t or "" for _, t in rows]
    data, offsets = text_buffers(pa.array(texts))
    start, end, row = fp.chunks(data, offsets)
    for i, t in enumerate(texts):
        got = [data[a:b].tobytes() for a, b, r in zip(start, end, row) if r == i]
        assert got == plain_chunks(t.encode())


def brute_edited(rows):
    """Rows of distinct ids in descending order, null ids last, each with its edited text."""
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    texts = [t or "" for _, t in order]
    return [(d, t, t[:len(t) - len(t) // 2] + n[:len(t) // 2], n) for (d, _), t, n in zip(order, texts, texts[1:] + texts[:1])]


@pytest.mark.parametrize("part", [16 << 20, 2000])
def test_edited_likeness(make, rows, part, monkeypatch):
    seen, own = set(), []
    for d, t in rows:
        if d not in seen:
            seen.add(d)
            own.append((d, t))
    monkeypatch.setattr(fp.beside_next, "__defaults__", (part, 64))
    got = {r.doc_id: r for r in fp.edited_likeness(make(own)).collect()}
    prints = {r.doc_id: r.fingerprint for r in fp.fingerprint(make(own)).collect()}
    expected = brute_edited(own)
    assert len(got) == len(expected)
    for d, t, e, n in expected:
        r = got[d]
        assert (r.n_chars, r.edited_sha256, r.fingerprint) == (len(t), hashlib.sha256(e.encode()).hexdigest(), prints[d])
        a, b, c = (Counter(plain_chunks(x.encode())) for x in (t, e, n))
        share = lambda other: (sum(len(x) for x in a if x in other) / sum(map(len, a))) if a else float(not other)
        assert abs(r.near_edited - share(b)) < 1e-9 and abs(r.near_next - share(c)) < 1e-9
        assert abs(fp.likeness(r.fingerprint, r.edited_fingerprint) - r.near_edited) < 1e-9


def test_edited_likeness_repeated_rows_and_empty(make, rows):
    got = fp.edited_likeness(make(rows)).collect()
    assert Counter(r.doc_id for r in got) == Counter(d for d, _ in rows)
    by_text = {}
    for r in fp.fingerprint(make(rows)).collect():
        by_text.setdefault(r.doc_id, set()).add(r.fingerprint)
    assert fp.edited_likeness(make([])).count() == 0
    only = fp.edited_likeness(make([(5, "alone")])).collect()[0]
    assert (only.n_chars, only.edited_sha256, only.near_next) == (5, hashlib.sha256(b"alo" + b"al").hexdigest(), 1.0)


def language_counts(texts):
    """(contexts, symbols, counts) of texts as the operator's tasks count them, and the letters of each text."""
    data, offsets = text_buffers(pa.array(texts))
    context, last, _, n = langid._grams(*langid._code_points(data, offsets))
    return langid._added(context, last, np.ones(len(last), np.int64)), n.tolist()


def test_probabilities_sum_to_one():
    english, n = language_counts(["the quick brown fox jumps over the lazy dogs the the", "fox", None])
    assert n == [42, 3, 0]
    other, _ = language_counts(["Ελληνικά και ελληνικό", "𐐨𐐩𐐪 日本語"])
    model = langid.fit({"en": english, "xx": other})
    every = np.arange(langid.LETTERS, dtype=np.uint64)
    for context in (0, int(english[0][5]), int(other[0][7]), 12345, (1 << 63) - 1):
        whole = model.log_probs(np.full(len(every), context, np.uint64), every)
        assert np.allclose(np.exp2(whole.astype(float)).sum(axis=0), 1, atol=1e-3), context


def plain_symbols(text):
    words = "".join(c.lower() if len(c.lower()) == 1 and c.isalpha() else c if c.isalpha() else " " for c in text).split()
    return "   " + "".join(w + " " for w in words) if text.strip() else "   "


def plain_kneser_ney(texts):
    """Interpolated Kneser-Ney from dictionaries: a function of (context, symbol)."""
    grams = Counter(s[i - 3:i + 1] for s in map(plain_symbols, texts) for i in range(3, len(s)))
    levels = {4: grams}
    for k in (3, 2, 1):
        levels[k] = Counter(g[1:] for g in levels[k + 1])

    def prob(context, symbol):
        k = len(context) + 1
        level = levels[k]
        if k == 1:
            return 0.01 / langid.LETTERS + 0.99 * level[symbol] / sum(level.values())
        d = langid._discount(np.array(list(level.values())))
        after = [n for g, n in level.items() if g[:-1] == context]
        shorter = prob(context[1:], symbol)
        if not after:
            return shorter
        return (max(level[context + symbol] - d, 0) if level[context + symbol] else 0) / sum(after) + d * len(after) / sum(after) * shorter
    return prob


def test_scores_follow_the_plain_rule():
    texts = {"en": ["the cat and the dog sat on the mat", "a theme of cats"], "el": ["η γάτα και ο σκύλος", "γάτες και σκύλοι"], "zh": ["日本 語本 日本語", "語日"]}
    model = langid.fit({k: language_counts(v)[0] for k, v in texts.items()})
    for text in ["the cats", "Γάτα the 日本", "ქართული ენა", "мир", "mat 語本語 𐐨"]:
        data, offsets = text_buffers(pa.array([text]))
        got = model.log_probs(*langid._grams(*langid._code_points(data, offsets))[:2]).sum(axis=0)
        s = plain_symbols(text)
        for lang, value in zip(model.langs, got):
            prob = plain_kneser_ney(texts[lang])
            assert abs(value - sum(np.log2(prob(s[i - 3:i], s[i])) for i in range(3, len(s)))) < 0.01, (text, lang)


def invented(letters, seed, n, words=400):
    rng = np.random.default_rng(seed)
    vocab = ["".join(rng.choice(list(letters), rng.integers(2, 9))) for _ in range(words)]
    return [" ".join(vocab[i] for i in rng.zipf(1.3, rng.integers(15, 80)) % words) for _ in range(n)]


def test_languages_of_small_scripts(spark):
    latin = "abcdefghijklmnopqrstuvwxyzàâäåæçèéêëìíîïñòóôöøùúûüýþßœšžłńśźż"
    cyrillic, greek, georgian = (["".join(map(chr, range(a, b))) for a, b in ((0x430, 0x450), (0x3B1, 0x3CA), (0x10D0, 0x10F1))])
    texts = {f"latin{i}": invented(latin[i * 5:i * 5 + 30], i, 300) for i in range(6)}
    texts |= {"cyr1": invented(cyrillic, 11, 40), "cyr2": invented(cyrillic, 12, 40), "ell1": invented(greek, 13, 40), "ell2": invented(greek, 14, 40)}
    learned = [(t, k) for k, v in texts.items() for t in v[:len(v) * 3 // 4]]
    held = [(t, k) for k, v in texts.items() for t in v[len(v) * 3 // 4:]] + [(t, "none") for t in invented(georgian, 15, 50)]
    model = langid.train(spark.createDataFrame(learned, "text string, lang string"))
    got = langid.predict(spark.createDataFrame(held, "text string, lang string"), model, keep=("lang",)).collect()
    for lang in texts:
        own = [r for r in got if r.lang == lang]
        assert sum(r.lang_pred == lang and not r.rejected for r in own) >= 0.95 * len(own), lang
    assert all(r.rejected for r in got if r.lang == "none")


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF_ORACLE}/documents.parquet").withColumn("held_out", langid.held_out())
    model = langid.train(docs.where("not held_out"))
    got = langid.predict(docs, model, keep=("doc_id", "lang", "held_out")).where("held_out")
    right, n, rejected = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*"), F.sum(F.col("rejected").cast("int"))).first()
    assert right > 0.97 and n > 200 and rejected <= 0.01 * n
    other = spark.createDataFrame([(1, "привет мир " * 30), (2, "xq zvkj qqxz wvxk jjqz " * 20), (3, None), (4, "12 34 !!"), (5, "")], "doc_id long, text string")
    odd = {r.doc_id: r for r in langid.predict(other, model).collect()}
    assert odd[1].rejected and odd[2].rejected
    assert all(odd[i].lang_pred == "und" and odd[i].score == 0 and odd[i].rejected for i in (3, 4, 5))


def test_language_without_training(make, rows):
    docs = make(rows).withColumn("lang", F.lit(None).cast("string"))
    assert langid.train(docs) is None
    assert {r.lang_pred for r in langid.predict(docs, None).collect()} == {"und"}
    model = langid.train(make(rows))
    got = langid.predict(make(rows), model, keep=("doc_id", "text", "_text", "lang"))
    assert got.count() == len(rows) and {r.lang_pred for r in got.collect()} == {"en", "fr", "und"}
    assert langid.predict(make([]), model).count() == 0


def test_network_gradients():
    net = quality.Network(1)
    rng = np.random.default_rng(0)
    data = rng.integers(1, 255, (5, quality.CHUNK + quality.WIDTH - 1)).astype(np.uint8)
    count, target = np.array([2, 3]), np.array([0.0, 1.0], np.float32)

    def loss():
        offsets = np.array([0, 5 * data.shape[1]])
        pool = np.concatenate([net.activations(row)[:quality.CHUNK].max(axis=0)[None] for row in data])
        z = net.combine(pool, count).astype(np.float64) @ net.p["out"].astype(np.float64) + net.p["bias"][0]
        assert offsets[1]
        return float(np.mean(np.log1p(np.exp(z)) - target * z))
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    grads = quality._gradients(net, data, count, target)
    for name, at in (("out", (3,)), ("filters", (5, 2)), ("emb", (int(data[0, 7]), 1)), ("bias", (0,)), ("shift", (4,))):
        keep, step = net.p[name][at], 1e-6
        net.p[name][at] = keep + step
        up = loss()
        net.p[name][at] = keep - step
        down = loss()
        net.p[name][at] = keep
        assert abs((up - down) / (2 * step) - grads[name][at]) < 1e-4, name


def test_chunks_cover_the_text():
    raw = bytes(range(1, 256)) * 9
    n = int(quality.chunk_counts(np.array([len(raw)]))[0])
    parts = quality.text_chunks(raw, 10_000)
    assert len(parts) == n and (n - 1) * quality.STEP + quality.CHUNK >= len(raw)
    net = quality.Network(2)
    pool, count = net.pools(np.frombuffer(b"" + raw, np.uint8), np.array([0, 0, len(raw)]))
    assert count.tolist() == [1, n]
    one = np.concatenate([net.activations(np.frombuffer(p, np.uint8))[:quality.CHUNK].max(axis=0)[None] for p in parts])
    assert np.allclose(pool[1:], one, atol=1e-5)


def test_quality_held_out(spark):
    from tillbook.llm.queries import op8_quality_bytes
    got = op8_quality_bytes(spark, SF_ORACLE).join(spark.read.parquet(f"{SF_ORACLE}/labels.parquet"), "doc_id").where("held_out")
    rows = got.select("score", "quality", "predicted").collect()
    assert np.mean([r.quality == r.predicted for r in rows]) > 0.9
    good, bad = [r.score for r in rows if r.quality], [r.score for r in rows if not r.quality]
    assert np.mean([g > b for g in good for b in bad]) > 0.9


def test_quality_defined_cases(make, spark, rows):
    labels = spark.createDataFrame([(None, 1), (rows[1][0], None), (99999, 0)], "doc_id long, label int")
    assert quality.train(make(rows), labels) == 0.5
    assert quality.train(make(rows), spark.createDataFrame([(rows[2][0], 1)] * 2, "doc_id long, label int")) == 1.0
    net = quality.fit([[quality.text_chunks(b"good prose here", 3)[0]], [quality.text_chunks(b"BAD!! BAD!!", 3)[0]]] * 4, [1, 0] * 4)
    got = quality.predict(make(rows), net, keep=("doc_id", "o")).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert quality.predict(make([]), net).count() == 0


def test_pipeline_stages(spark, make, rows, scratch):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "benchmark_leaks", "source_mix", "shards"]
    planted = rows + [(70001, ITEMS[0][1] + " w13 of the w14 w15")]
    items = spark.createDataFrame(ITEMS[:1], "item_id string, text string")
    items.write.parquet(f"{scratch}/benchmark.parquet")
    docs = make(planted).select(*corpus_pipeline.COLUMNS)
    stage = dict(corpus_pipeline.STAGES)
    pairs = lambda df: [(r.doc_id, r.text) for r in df.collect()]
    spoken = stage["language"](spark, docs, scratch)
    assert set(spoken.columns) == set(corpus_pipeline.COLUMNS)
    # two texts are in neither of the languages taught here; those without letters go too
    letters = [(d, t) for d, t in planted if t and any(c.isalpha() for c in t) and t not in ("日本 " * 60, "two words")]
    assert Counter(pairs(spoken)) == Counter(letters)
    single = stage["near_duplicates"](spark, spoken, scratch)
    kept = pairs(single)
    assert {d for d, _ in kept} == {c for _, _, c in brute_groups(letters, 80, 5)}
    assert all(len(WORD.findall(t.translate(ASCII))) for _, t in kept)
    clean = stage["benchmark_leaks"](spark, single, scratch)
    hit = brute_leaks(kept, ITEMS[:1])
    assert Counter(d for d, _ in pairs(clean)) == Counter({x[0]: n for x, n in hit.items() if not x[-1]}) and 70001 not in {d for d, _ in pairs(clean)}
    mixed = stage["source_mix"](spark, clean, scratch)
    assert set(mixed.columns) == set(corpus_pipeline.COLUMNS)
    size = sum(len(WORD.findall(t)) for _, t in pairs(clean))
    assert abs(sum(len(WORD.findall(t)) for _, t in pairs(mixed)) - 1.5 * size) <= 60
    assert all(r.n_chars == len(r.text) for r in mixed.collect())
    placed = stage["shards"](spark, mixed, scratch).collect()
    assert Counter((r.doc_id, r.text) for r in placed) == Counter(pairs(mixed)) and {r.shard for r in placed} <= set(range(24))


def test_pipeline_run(spark):
    assert corpus_pipeline.run(spark, SF_SMALL).count() > 0


def test_quality_sample_of_repeated_ids(make, spark, monkeypatch):
    """An id with many rows takes one place of the sample, and long texts are learned whole."""
    long = " ".join(f"long{i}" for i in range(3000))
    docs = make([(0, f"copy {i}") for i in range(60)] + [(i, f"text {i}") for i in range(1, 9)] + [(9, long)] * 3)
    labels = spark.createDataFrame([(i, int(i > 4)) for i in range(10)] + [(0, 0), (77, 1)], "doc_id long, label int")
    seen = {}
    monkeypatch.setattr(quality, "fit", lambda texts, labels: seen.update(texts=texts, labels=labels))
    quality.train(docs, labels, max_rows=10)
    assert sorted(seen["labels"]) == [0] * 5 + [1] * 5
    whole = int(quality.chunk_counts(np.array([len(long)]))[0])
    assert whole > 100 and sorted(map(len, seen["texts"])) == [1] * 9 + [whole]
    quality.train(docs, labels, max_rows=6)
    assert len(seen["labels"]) == 6 and set(seen["labels"]) == {0, 1}


def test_gradients_do_not_depend_on_blocks(monkeypatch):
    net, rng = quality.Network(1), np.random.default_rng(0)
    data = rng.integers(1, 255, (9, quality.CHUNK + quality.WIDTH - 1)).astype(np.uint8)
    count, target = np.array([2, 7]), np.array([0.0, 1.0], np.float32)
    whole = quality._gradients(net, data, count, target)
    monkeypatch.setattr(quality, "_FIT_CHUNKS", 4)
    assert all(np.allclose(g, whole[k], atol=1e-5) for k, g in quality._gradients(net, data, count, target).items())
