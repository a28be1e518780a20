"""A join that splits its heavy keys by itself, whatever the session's skew settings.

Adaptive execution splits a skewed join only when no other operator relies on the join's partitioning. Here the heavy keys
are counted (a partial aggregate on the key column alone), and only their rows are salted: a key with n of N rows (that have a key) gets
about 2 * P * n / N salts over P partitions, its single row of the other side as many copies. A key is heavy if it holds
more than half of a partition's share, N / (2 * P), so there are fewer than 2 * P of them and fewer than 4 * P copies: the table of heavy keys
is broadcast within that bound at any size of the data. All other rows keep salt 0, and rows come out of one exchange.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def heavy_keys(rows: DataFrame, key: str, partitions: int) -> DataFrame:
    """key and _salts of the keys that hold over 1 / (2 * partitions) of the rows: fewer than 2 * partitions rows."""
    counts = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n")).scalar()  # of the same counts, so the rows are read once for both
    share = F.col("_n") * F.lit(2 * partitions) / total
    return counts.where(share > 1).select(key, F.ceil(share).cast("int").alias("_salts"))


def split_join(rows: DataFrame, other: DataFrame, key: str, how: str = "inner", partitions: int | None = None) -> DataFrame:
    """``rows`` (any number a key) joined on ``key`` with ``other`` (at most a few rows a key); ``how`` is inner or left."""
    n = partitions or max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    heavy = F.broadcast(heavy_keys(rows, key, n))  # fewer than 2 * n rows, see above
    place = F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns])  # depends on the row alone, so a retried task deals it alike
    # rows without a key match nothing; a left join spreads them over all partitions
    salts = F.when(F.col(key).isNull(), F.lit(n)).otherwise(F.coalesce("_salts", F.lit(1)))
    dealt = rows.join(heavy, key, "left").withColumn("_salt", F.pmod(place, salts).cast("int")).drop("_salts")
    copies = F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))
    spread = other.join(heavy, key, "left").withColumn("_salt", copies).drop("_salts")
    return dealt.join(spread, [key, "_salt"], how).drop("_salt")
