"""Day roll-ups of sales: period sums without reading the sales of whole days again (AGG2, AGG4, REP5, REP6).

Two tables hold partial sums per (product, day) and per (user, day), kept in buckets by month. ``refresh`` recomputes the months of
the days it is given from the sales and commits only them. Sums, counts and latest times merge exactly, so a period is the
merge of its whole days in the roll-up and of raw sales for the rest: the parts of days at its edges and whatever lies outside
``covered``, the span of days that the roll-up has.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..core import as_datetime, ts_lit
from ..sinks.buckets import BucketTable, month_bucket
from .joins import SUM_MONEY

DAY = dt.timedelta(days=1)


def _midnight(t: dt.datetime) -> dt.datetime:
    return dt.datetime(t.year, t.month, t.day)


class SalesRollup:
    """Partial sums of sales per product and day and per user and day, below ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        base = path.rstrip("/")
        self.tables = {key: BucketTable(spark, f"{base}/{key}", "day", month_bucket(), id_col="") for key in ("product_id", "user_id")}

    @staticmethod
    def _sums(sales: DataFrame, key: str) -> DataFrame:
        return sales.groupBy(key, F.to_date("transaction_date").alias("day")).agg(
            F.sum("quantity").cast("long").alias("units"), F.sum("total_amount").cast(SUM_MONEY).alias("amount"),
            F.count(F.lit(1)).alias("n"), F.max("transaction_date").alias("latest"))

    def refresh(self, sales: DataFrame, days: DataFrame | None = None) -> None:
        """Recompute the months of ``days`` (column day; None: all of them) from ``sales``, which must hold these months whole."""
        for key, table in self.tables.items():
            if days is None:
                table.commit(self._sums(sales.where("transaction_date is not null"), key))
                continue
            months = table.of(days.where("day is not null"), "day")  # one number a month
            spans = [(dt.datetime(m // 100, m % 100, 1), dt.datetime(m // 100 + m % 100 // 12, m % 100 % 12 + 1, 1)) for m in months]
            inside = F.lit(False)
            for lo, hi in spans:
                inside = inside | ((F.col("transaction_date") >= ts_lit(lo)) & (F.col("transaction_date") < ts_lit(hi)))
            table.commit(self._sums(sales.where(inside), key), months)

    def _period(self, key: str, sales: DataFrame, lo, hi, covered: tuple) -> DataFrame:
        """Partial sums of lo <= transaction_date < hi (None: open); ``covered`` is the first and last whole day of the roll-up."""
        first, after = _midnight(as_datetime(covered[0])), _midnight(as_datetime(covered[1])) + DAY
        start = first if lo is None else max(first, -(-(as_datetime(lo) - dt.datetime.min) // DAY) * DAY + dt.datetime.min)
        end = after if hi is None else min(after, _midnight(as_datetime(hi)))
        bounds = [] if lo is None else [F.col("transaction_date") >= ts_lit(lo)]
        bounds += [] if hi is None else [F.col("transaction_date") < ts_lit(hi)]
        if start >= end:  # no whole day inside
            return self._sums(_where(sales, bounds), key).drop("day")
        before, later = F.col("transaction_date") < ts_lit(start), F.col("transaction_date") >= ts_lit(end)
        sides = []
        if lo is None or as_datetime(lo) < start:
            sides.append(self._sums(_where(sales, [*bounds, before]), key))
        if hi is None or as_datetime(hi) > end:
            sides.append(self._sums(_where(sales, [*bounds, later]), key))
        table = self.tables[key]
        version = table.version()
        last = end - DAY
        months = [m for m in version.parts if start.year * 100 + start.month <= m <= last.year * 100 + last.month]
        out = table.read(months, version).where((F.col("day") >= F.lit(start.date())) & (F.col("day") <= F.lit(last.date())))
        for side in sides:
            out = out.unionByName(side)
        return out.drop("day")

    def product_sales(self, sales: DataFrame, covered: tuple, lo=None, hi=None) -> DataFrame:
        """product_id, total_sales, revenue of lo <= transaction_date < hi, as ``joins.product_sales`` gives them."""
        return self._period("product_id", sales, lo, hi, covered).groupBy("product_id").agg(
            F.sum("units").alias("total_sales"), F.sum("amount").cast(SUM_MONEY).alias("revenue"))

    def user_sales(self, sales: DataFrame, covered: tuple, lo=None, hi=None) -> DataFrame:
        """user_id, total_purchases, total_spent, last_purchase, as ``joins.user_sales`` gives them."""
        return self._period("user_id", sales, lo, hi, covered).groupBy("user_id").agg(
            F.sum("n").alias("total_purchases"), F.sum("amount").cast(SUM_MONEY).alias("total_spent"),
            F.max("latest").alias("last_purchase"))


def _where(df: DataFrame, tests: list[Column]) -> DataFrame:
    for test in tests:
        df = df.where(test)
    return df
