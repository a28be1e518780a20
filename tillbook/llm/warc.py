"""WARC revisit records: "not modified" captures resolved to the response they stand for.

A revisit is joined as of its time to the latest earlier full response of the same canonical URL. It is resolved
if the validators agree: the entity tags by weak comparison where both have one, else the Last-Modified values
where both have one. The merged record takes its headers from the response, replaced and extended by those headers of the
revisit that a 304 answer may update.

The as-of join has no task per URL: captures are cut into slices of sorted ranges, each slice carries its own
last response, and what earlier slices leave over is a running value over slices. Headers and payloads do not pass through the
ordering; only ids and validators do.

Defined cases: a null or hostless URL has no canonical form and resolves to nothing (`no_response`), as does a null time; a
response at the same time is not earlier; of several responses at one time the highest record id counts; a null or empty
validator is absent; neither pair present is `no_validator`, disagreement `changed`; null headers are none; of header names
equal but for case the first counts; repeated rows each resolve; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..core import cut_lineage
from ..operators.running import with_range_slices
from .common import ascii_lower

#: Headers that a 304 answer does not update: they describe the stored payload or one connection.
FIXED_HEADERS = ("connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive",
                 "proxy-authenticate", "proxy-authorization", "te", "trailer", "transfer-encoding", "upgrade")


def canonical_url(url: Column) -> Column:
    """Host lower-cased without `www.` and default port, path without closing slash, query sorted and without
    tracking parameters (`utm_*`, `ref`), no scheme and no fragment; null without a host."""
    bare = F.regexp_replace(F.regexp_replace(url, r"(?s)#.*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(ascii_lower(F.regexp_extract(bare, r"(?s)^([^/?]*)", 1)), r"^www\.", ""), r":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"(?s)^[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.array_join(F.sort_array(F.filter(F.split(F.regexp_extract(bare, r"(?s)^[^?]*\?(.*)$", 1), "&", -1),
                                               lambda p: (p != "") & ~p.startswith("utm_") & ~p.startswith("ref="))), "&")
    whole = F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(F.contains(url, F.lit("://")) & (host != ""), whole)


def _present(value: Column) -> Column:
    return F.when(F.trim(value) != "", F.trim(value))


def _clean_headers(headers: Column) -> Column:
    """Entries with lower-cased names, the first of equal names only."""
    entries = F.transform(F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>"))),
                          lambda h: F.struct(ascii_lower(h["key"]).alias("key"), h["value"].alias("value")))
    names = F.transform(entries, lambda h: h["key"])
    return F.filter(entries, lambda h, i: F.array_position(names, h["key"]) == i + 1)


def merged_headers(response: Column, revisit: Column) -> Column:
    """The response's header entries with the permitted ones of the revisit in their place, sorted by name."""
    news = F.filter(_clean_headers(revisit), lambda h: ~h["key"].isin(*FIXED_HEADERS))
    new_names = F.transform(news, lambda h: h["key"])
    kept = F.filter(_clean_headers(response), lambda h: ~F.array_contains(new_names, h["key"]))
    return F.sort_array(F.concat(kept, news))


def resolve_revisits(captures: DataFrame, rows_per_slice: int = 100_000) -> DataFrame:
    """(record_id, url_key, ts, response_id, status, payload_digest, headers) of each revisit.

    ``captures`` has record_id, url, ts, kind (`response` or `revisit`), etag, last_modified, headers (a map) and
    payload_digest. status is `resolved`, `changed`, `no_validator` or `no_response`; digest and headers are those of the
    merged record, null unless resolved. headers is an array of (key, value).
    """
    spark = captures.sparkSession
    rows = captures.where(F.col("kind").isin("response", "revisit")).select(
        "record_id", canonical_url(F.col("url")).alias("url_key"), "ts", (F.col("kind") == "response").cast("int").alias("full"),
        _present(F.col("etag")).alias("etag"), _present(F.col("last_modified")).alias("last_modified"), "headers", "payload_digest")
    timed = F.col("url_key").isNotNull() & F.col("ts").isNotNull()
    slim = rows.where(timed).select("url_key", "ts", "full", "record_id", "etag", "last_modified")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # at one time revisits sort before responses, so every response before a revisit is earlier
    ordered = cut_lineage(with_range_slices(slim, "url_key", ["ts", "full", "record_id"], n, rows_per_slice), "captures")
    response = F.when(F.col("full") == 1, F.struct("ts", "record_id", "etag", "last_modified"))
    inside = Window.partitionBy("url_key", "_slice").orderBy("ts", "full", "record_id").rowsBetween(Window.unboundedPreceding, 0)
    left = ordered.groupBy("url_key", "_slice").agg(F.max(response).alias("last"))
    before = Window.partitionBy("url_key").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    left = left.select("url_key", "_slice", F.last("last", ignorenulls=True).over(before).alias("carried"))
    seen = ordered.withColumn("own", F.last(response, ignorenulls=True).over(inside)).where("full = 0")
    found = seen.join(left, ["url_key", "_slice"]).select(
        "record_id", "url_key", "ts", "etag", "last_modified", F.coalesce("own", "carried").alias("r"))
    tag = lambda c: F.regexp_replace(c, r"^W/", "")
    both_tags = F.col("etag").isNotNull() & F.col("r.etag").isNotNull()
    both_dates = F.col("last_modified").isNotNull() & F.col("r.last_modified").isNotNull()
    status = (F.when(F.col("r").isNull(), "no_response")
              .when(both_tags, F.when(tag(F.col("etag")) == tag(F.col("r.etag")), "resolved").otherwise("changed"))
              .when(both_dates, F.when(F.col("last_modified") == F.col("r.last_modified"), "resolved").otherwise("changed"))
              .otherwise("no_validator"))
    found = found.select("record_id", "url_key", "ts", F.col("r.record_id").alias("response_id"), F.col("r.ts").alias("response_ts"), status.alias("status"))
    # repeated rows answer alike, so one answer for each (record, URL, time) is enough
    answers = found.groupBy("record_id", "url_key", "ts").agg(F.min(F.struct("response_id", "response_ts", "status")).alias("a"))
    revisits = rows.where("full = 0").select("record_id", "url_key", "ts", F.col("headers").alias("new_headers")).alias("v")
    answered = revisits.join(answers.alias("a"), F.col("v.record_id").eqNullSafe(F.col("a.record_id"))
                             & (F.col("v.url_key") == F.col("a.url_key")) & (F.col("v.ts") == F.col("a.ts")), "left")
    answered = answered.select("v.*", "a.a.response_id", "a.a.response_ts", F.coalesce("a.a.status", F.lit("no_response")).alias("status"))
    full = rows.where("full = 1").where(timed).groupBy("record_id", "url_key", "ts").agg(
        F.min(F.struct("payload_digest", F.map_entries("headers").alias("headers"))).alias("f"))
    hit = F.col("q.status") == "resolved"
    return answered.alias("q").join(full.alias("f"), hit & F.col("q.response_id").eqNullSafe(F.col("f.record_id")) & (F.col("q.url_key") == F.col("f.url_key"))
                                    & (F.col("q.response_ts") == F.col("f.ts")), "left").select(
        "q.record_id", "q.url_key", "q.ts", "q.response_id", "q.status", F.col("f.f.payload_digest").alias("payload_digest"),
        F.when(hit, merged_headers(F.map_from_entries("f.f.headers"), F.col("q.new_headers"))).alias("headers"))


def captures_of_pages(pages: DataFrame) -> DataFrame:
    """A crawl log of the pages table: a full capture of every page and a later revisit of it.

    Page n is captured at time 10 n and revisited 1,000,000 later under another spelling of its URL, every 13th 5 before its
    capture. Every 5th page has no entity tag, every 7th no Last-Modified; every 11th revisit brings a changed tag, and every 3rd a weak one.
    """
    i, digest = F.coalesce(F.col("page_id").cast("long"), F.lit(0).cast("long")), F.md5(F.coalesce("html", F.lit("")))
    tag = F.when(i % 5 != 0, F.concat(F.lit('"'), F.substring(digest, 1, 12), F.lit('"')))
    date = F.when(i % 7 != 0, F.concat(F.lit("day "), (i % 28).cast("string")))
    text = lambda x: F.lit(x)
    page = F.struct((i * 4).alias("record_id"), F.col("url"), (i * 10).alias("ts"), text("response").alias("kind"), tag.alias("etag"), date.alias("last_modified"),
                    F.create_map(text("Content-Type"), text("text/html"), text("Content-Length"), F.octet_length(F.coalesce("html", F.lit(""))).cast("string"),
                                 text("Cache-Control"), text("max-age=60"), text("Date"), (i * 10).cast("string")).alias("headers"), digest.alias("payload_digest"))
    changed = F.when(i % 11 == 0, text('"changed"')).when(i % 3 == 0, F.concat(text("W/"), tag)).otherwise(tag)
    later = F.when(i % 13 == 0, i * 10 - 5).otherwise(i * 10 + 1_000_000)
    revisit = F.struct((i * 4 + 1).alias("record_id"), F.concat(F.regexp_replace(F.col("url"), r"^https?://", "HTTP://"), text("#again")).alias("url"), later.alias("ts"),
                       text("revisit").alias("kind"), changed.alias("etag"), date.alias("last_modified"),
                       F.create_map(text("content-length"), text("0"), text("cache-control"), text("max-age=600"), text("Date"), later.cast("string"),
                                    text("Expires"), (later + 600).cast("string")).alias("headers"), F.lit(None).cast("string").alias("payload_digest"))
    return pages.select(F.explode(F.array(page, revisit)).alias("c")).select("c.*")
