"""URL filters by expressions of host suffixes and path prefixes.

A URL is expanded into every host suffix on label boundaries times every path prefix whose length some
rule has. The expressions are joined with the rules on the first 32 bits of their SHA-256, the whole
digest confirms each hit, and the longest rule that fits decides. DataFrame operations only.

Defined cases: a null URL or one without ``://`` has an empty host and path, fits no rule and gets the
default verdict; of two fitting rules of equal length the one with the longer host wins, then `block`;
repeated and null page ids each keep their row; an empty table gives no rows; an empty rule table gives
every URL the default. Other columns of the page table are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower


def with_host_path(pages: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, url, host, path) of each row."""
    rest = F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    return pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), ascii_lower(host).alias("host"),
                        F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1).alias("path"))


def rule_table(spark, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(host, path, verdict) rows from (verdict, host, path) tuples."""
    rows = spark.range(1).select(F.explode(F.array(*[
        F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict")) for v, h, p in rules])).alias("r"))
    return rows.select("r.*")


def _digests(df: DataFrame, expression) -> DataFrame:
    digest = F.sha2(expression.cast("binary"), 256)
    return df.withColumn("digest", digest).withColumn("short", F.substring("digest", 1, 8))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict) of every page; rule is host plus path of the deciding rule, else null.

    ``rules`` has host, path and verdict (`allow` or `block`). The lengths of rule paths go to the driver as
    a set of numbers (at most the longest path); hosts and paths stay distributed.
    """
    parts = with_host_path(pages)
    known = rules.select(F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), F.col("verdict"))
    lengths = sorted(r[0] for r in known.select(F.length("rule_path").alias("n")).distinct().collect() if r[0] is not None)
    known = _digests(known, F.concat("rule_host", F.lit("\n"), "rule_path"))
    urls = parts.where(F.col("host") != "").select("host", "path").distinct()
    labels = F.split("host", r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)),
                           lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.filter(F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths] or [F.lit(None).cast("string")]),
                        lambda x: x.isNotNull())
    expressions = (urls.withColumn("suffix", F.explode(suffixes)).withColumn("prefix", F.explode(prefixes)))
    expressions = _digests(expressions, F.concat("suffix", F.lit("\n"), "prefix")).withColumnRenamed("digest", "own_digest")
    hits = expressions.join(known, "short").where(F.col("own_digest") == F.col("digest"))
    rank = F.struct(F.length("rule_host") + F.length("rule_path"), F.length("rule_host"), (F.col("verdict") == "block").cast("int"))
    best = hits.groupBy("host", "path").agg(
        F.max_by(F.struct(F.concat("rule_host", "rule_path").alias("rule"), F.col("verdict")), rank).alias("best"))
    best = best.select(F.col("host").alias("best_host"), F.col("path").alias("best_path"), "best")
    # pages without a host fit no rule; a null key matches nothing, and AQE splits such keys on the left side
    key = F.when(F.col("host") != "", F.col("host"))
    return (parts.withColumn("key_host", key)
            .join(best, (F.col("key_host") == F.col("best_host")) & (F.col("path") == F.col("best_path")), "left")
            .select("page_id", "host", "path", F.col("best.rule").alias("rule"),
                    F.coalesce("best.verdict", F.lit(default)).alias("verdict")))
