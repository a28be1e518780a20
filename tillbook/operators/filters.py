"""Row filters (FIL1, FIL2) and top-k (TOP1)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.periods import in_dates


def for_user(df: DataFrame, user, col: str = "user_id") -> DataFrame:
    """FIL1: rows of one user (a literal id) or of a whole set of users (a DataFrame with ``id``
    or ``col``), as a left semi join so the owner key stays a column and nothing is duplicated."""
    if isinstance(user, DataFrame):
        key = col if col in user.columns else "id"
        return df.join(user.select(F.col(key).alias(col)), col, "left_semi")
    return df.where(F.col(col) == F.lit(user))


def filter_orders(orders: DataFrame, status: str | None = None, dates=None, status_col: str = "status",
                  date_col: str = "created_at") -> DataFrame:
    """FIL2: orders by status and inclusive date range. Empty status and the page's literal
    'all' both mean every status; ``dates`` is a (first, last) pair of dates or None."""
    out = orders
    if status and status != "all":
        out = out.where(F.col(status_col) == status)
    if dates is not None:
        out = out.where(in_dates(date_col, dates))
    return out


def top_products(report: DataFrame, k: int = 5) -> DataFrame:
    """TOP1: the k products with most units sold (ties by id). Spark plans this as
    TakeOrderedAndProject: a top-k per partition, then a merge of k rows each."""
    return report.orderBy(F.col("total_sales").desc(), F.col("id").asc()).limit(k)
