"""Mixing, sharding, URL filters and revisits: exact properties and brute force."""

import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from llm_fixtures import make, rows  # noqa: F401
from tillbook.llm import mixing, sharding, urls, warc
from tillbook.llm.queries import URL_RULES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sized(rows):
    return [(d, len(WORD.findall(t or ""))) for d, t in rows]


def brute_targets(sizes, weights=(3, 1, 2), share=1.5, limit=2):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    total, capped = share * sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in capped]
        if not free:
            break
        level = (total - sum(limit * sizes[s] for s in capped)) / sum(weight[s] for s in free)
        over = [s for s in free if limit * sizes[s] < level * weight[s]]
        if not over:
            break
        capped.update(over)
    return {s: limit * sizes[s] if s in capped else level * weight[s] for s in order}


def test_mix(make, rows):
    docs = make(rows)
    got = mixing.mix_documents(docs, blocks=16).collect()
    sizes = Counter()
    for r in got:
        sizes[r.source] += r.size
    assert Counter((r.doc_id, r.size) for r in got) == Counter(sized(rows))
    targets = brute_targets(dict(sizes))
    taken = Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - targets[r.source]) < 1e-6
        assert r.taken in (0, r.size, 2 * r.size) and all(d.words == r.size for d in r.draws)  # whole texts only
        taken[r.source] += r.taken
    for s, t in targets.items():
        assert abs(taken[s] - t) <= min(0.02 * t, max(r.size for r in got if r.source == s) / 2) + 1, (s, taken[s], t)
    again = mixing.mix_documents(make(rows).repartition(7), blocks=16).collect()
    key = lambda r: (str(r.doc_id), r.size, str(r.source), r.taken)
    assert sorted(map(key, again)) == sorted(map(key, got))


def test_mix_splits_block_quotas_exactly(spark, make, rows):
    quotas = {0: 500, 1: 3, 2: 40, 7: 1000, 9: 1}
    draws = spark.createDataFrame(list(quotas.items()), "idx long, q long")
    got = {r.idx: r.ends for r in mixing.shard_quotas(draws, 6, seed=4).collect()}
    parts = {i: [b - a for a, b in zip([0] + e, e)] for i, e in got.items()}
    assert {i: sum(p) for i, p in parts.items()} == quotas and all(x >= 0 for p in parts.values() for x in p)
    assert all(abs(sum(p[s] for p in parts.values()) - sum(quotas.values()) / 6) <= 2 for s in range(6))
    assert max(parts[7]) - min(parts[7]) < 120


def test_hypergeometric(spark):
    n, t, k, m = 4000, 60, 20, 15
    rows = spark.range(n).select(mixing.hypergeometric(F.lit(t), F.lit(k), F.lit(m), (F.col("id") + 0.5) / n).alias("x"))
    got = Counter(r.x for r in rows.collect())
    from math import comb
    for x in range(m + 1):
        exact = comb(k, x) * comb(t - k, m - x) / comb(t, m)
        assert abs(got[x] / n - exact) < 0.002, x
    edge = spark.range(1).select(*[mixing.hypergeometric(F.lit(a), F.lit(b), F.lit(c), F.lit(0.3)) for a, b, c in
                                   [(5, 5, 3), (5, 0, 3), (5, 2, 5), (1, 1, 1), (5, 3, 0)]]).first()
    assert list(edge) == [3, 0, 2, 1, 0]


def test_mixture_rows(make, rows):
    docs = make(rows)
    plan = {(r.doc_id, r.text): r for r in mixing.mix_documents(docs, keep=("text",), blocks=8).collect()}
    copies = mixing.mixture(docs, keep=("lang",), blocks=8).collect()
    words, texts = Counter(), {t for _, t in rows}
    for c in copies:
        assert c.text in texts and len(WORD.findall(c.text or "")) == c.words and 0 <= c.shard < mixing.SHARDS
        words[c.source] += c.words
    taken = Counter()
    for r in mixing.mix_documents(docs, blocks=8).collect():
        taken[r.source] += r.taken
    assert +words == +taken and plan
    assert mixing.mix_documents(make([])).count() == 0 and mixing.mixture(make([])).count() == 0


@pytest.mark.parametrize("blocks", [2, 64])
def test_mix_opens_a_block_by_lanes_and_documents(make, blocks):
    rows = [(i, "w " * (1 + i * 7 % 50)) for i in range(3000)] + [(9000, "long " * 4000), (9001, "long " * 9000)]
    got = mixing.mix_documents(make(rows, sources=("a", "b")), blocks=blocks).collect()
    assert len(got) == len(rows) and all(r.taken in (0, r.size, 2 * r.size) for r in got)
    for s in "ab":
        target, taken = next(r.target for r in got if r.source == s), sum(r.taken for r in got if r.source == s)
        assert abs(taken - target) <= 25, (s, taken, target)


def test_write_mixture(make, rows, scratch, spark):
    mix = mixing.mixture(make(rows), blocks=8)
    mixing.write_mixture(mix, f"{scratch}/mix", tasks_per_shard=2)
    assert spark.read.parquet(f"{scratch}/mix").count() == mix.count()


def check_shards(got, rows, shards):
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter(
        (d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in rows)
    places = defaultdict(list)
    for r in got:
        places[r.shard].append(r.slot)
    assert all(sorted(p) == list(range(len(p))) for p in places.values()) and set(places) <= set(range(shards))


def test_shards(make, rows):
    got = sharding.shard_documents(make(rows), shards=5, keep=("text",)).collect()
    check_shards(got, rows, 5)
    sizes = Counter()
    for r in got:
        sizes[r.shard] += r.size
    largest = max(r.size for r in got)
    assert max(sizes.values()) - min(sizes.values()) <= largest
    again = sharding.shard_documents(make(rows).repartition(5), shards=5).collect()
    key = lambda r: (str(r.doc_id), r.text_crc32, r.shard, r.slot)
    assert sorted(map(key, again)) == sorted(map(key, got))
    assert sharding.shard_documents(make([])).count() == 0


def test_slot_map_versions(make, spark, scratch):
    rows = [(i, "x" * (i % 90)) for i in range(3000)]
    sizes = sharding.slot_sizes(sharding.with_slot(make(rows), virtual=256)).cache()
    path = f"{scratch}/map"
    sharding.save_slot_map(sharding.build_slot_map(sizes, 6), path)
    first = {r.vslot: r.shard for r in sharding.load_slot_map(spark, path).collect()}
    for shards in (8, 5):
        sharding.save_slot_map(sharding.edit_slot_map(sharding.load_slot_map(spark, path, 1), sizes, shards), path)
        edited = sharding.load_slot_map(spark, path).collect()
        assert {r.version for r in edited} == {2} and len(edited) == 256
        per = Counter()
        moved = 0
        weight = {r.vslot: r.bytes for r in sizes.groupBy("vslot").agg(F.sum("bytes").alias("bytes")).collect()}
        for r in edited:
            per[r.shard] += weight[r.vslot]
            moved += first[r.vslot] != r.shard
        assert max(per.values()) / (sum(per.values()) / shards) < 1.1 and len(per) == shards
        assert moved < 256 * 0.45
    assert {r.vslot: r.shard for r in sharding.load_slot_map(spark, path, 1).collect()} == first


def brute_verdict(url, rules, default="allow"):
    if url is None or "://" not in url:
        return "", "", None, default
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host):]).group()
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h) + len(p), len(h), v == "block", h + p, v) for v, h, p in rules
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *max(fits)[3:]) if fits and host else (host, path, None, default)


URLS = ["http://Example.COM/en/x?q=1", "https://www.example.com/en/#f", "https://a.www.example.com/en/", "http://x.net/es/y", "http://x.net/ES/y",
        "ftp://net/fr/", "http://example.com", "http://example.com?x=/en/", "http://badexample.com/en/1", "http://com/", "http://.com/", "com/en/", None, "",
        "://", "http://", "x://y://z.com/en/", "http://É.com/\n/en/", "http://a.net/en/?u=http://b.net/es/", "http://example.com./en/", "http://h.com:80/x"]


@pytest.mark.parametrize("rules", [URL_RULES, [], URL_RULES + [("block", "x.net", "/es/y"), ("allow", "example.com", "/en"), ("block", "com", "")]])
def test_url_filters(spark, rules):
    rows = [(i if i % 5 else None, u, "x", "x") for i, u in enumerate(URLS * 2)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, rule string")
    table = urls.rule_table(spark, rules) if rules else spark.createDataFrame([], "host string, path string, verdict string")
    got = urls.judge(pages, table).collect()
    assert Counter(map(tuple, got)) == Counter((i, *brute_verdict(u, rules)) for i, u, _, _ in rows)
    assert urls.judge(pages.limit(0), table).count() == 0


CAPTURES = "record_id long, url string, ts long, kind string, etag string, last_modified string, headers map<string,string>, payload_digest string, own string"


def test_revisits(spark):
    h = {"Content-Type": "text/html", "Date": "1", "ETAG": "a", "etag": "b", "X-Old": "kept"}
    new = {"date": "2", "Content-Length": "0", "Expires": "9", "X-New": None}
    rows = [
        (1, "http://www.A.com/x/", 10, "response", '"a"', "d1", h, "p1", "x"), (2, "https://a.com/x#f", 20, "response", None, "d2", h, "p2", "x"),
        (3, "https://a.com:443/x?utm_s=1", 30, "response", '"c"', None, None, "p3", "x"), (4, "https://a.com/x?b=1&a=2&ref=z", 30, "response", "", " ", h, "p4", "x"),
        (11, "http://a.com/x", 10, "revisit", '"a"', None, new, None, "x"),   # a response at the same time is not earlier
        (12, "http://a.com/x", 15, "revisit", 'W/"a"', "zz", new, None, "x"),
        (13, "http://a.com/x", 25, "revisit", '"q"', "d2", new, None, "x"),
        (14, "http://a.com/x", 25, "revisit", None, "other", new, None, "x"),
        (15, "http://a.com/x", 99, "revisit", None, "d1", None, None, "x"),
        (16, "http://A.com/x/?a=2&b=1", 99, "revisit", '"z"', None, new, None, "x"),
        (17, None, 99, "revisit", '"z"', None, new, None, "x"), (18, "http://a.com/x", None, "revisit", '"c"', None, new, None, "x"),
        (None, "http://a.com/x", 99, "revisit", '"c"', None, {}, None, "x"), (12, "http://a.com/x", 15, "revisit", 'W/"a"', "zz", new, None, "x"),
        (19, "http://other.com/", 99, "revisit", '"c"', None, new, None, "x"), (20, "http://a.com/x", 99, "request", '"c"', None, new, None, "x"),
    ]
    got = warc.resolve_revisits(spark.createDataFrame(rows, CAPTURES), rows_per_slice=2).collect()
    found = Counter((r.record_id, r.response_id, r.status, r.payload_digest) for r in got)
    assert found == Counter({(11, None, "no_response", None): 1, (12, 1, "resolved", "p1"): 2, (13, 2, "resolved", "p2"): 1, (14, 2, "changed", None): 1,
                             (15, 3, "no_validator", None): 1, (16, 4, "no_validator", None): 1, (17, None, "no_response", None): 1,
                             (18, None, "no_response", None): 1, (None, 3, "resolved", "p3"): 1, (19, None, "no_response", None): 1})
    merged = [dict((e.key, e.value) for e in r.headers) for r in got if r.record_id == 12][0]
    assert merged == {"content-type": "text/html", "date": "2", "etag": merged["etag"], "x-old": "kept", "expires": "9", "x-new": None}
    assert warc.resolve_revisits(spark.createDataFrame([], CAPTURES)).count() == 0


def test_revisits_of_a_hot_url(spark):
    rows = [(i, "http://hot.com/", i, "response" if i % 50 == 3 else "revisit", f'"{i // 50 if i % 50 >= 3 else i // 50 - 1}"', None, None, f"p{i}", "x") for i in range(2000)]
    got = warc.resolve_revisits(spark.createDataFrame(rows, CAPTURES), rows_per_slice=40).collect()
    assert len(got) == 1960
    for r in got:
        expected = r.record_id - (r.record_id - 3) % 50
        assert (r.response_id, r.status) == ((expected, "resolved") if expected >= 3 else (None, "no_response"))
