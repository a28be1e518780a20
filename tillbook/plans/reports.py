"""Composite reports REP1-REP7: the reference's on-screen reports, exports and dashboard,
each a lazy DataFrame plan over whole tables.

Sorting is the last step of a report (the reference orders every list); it is a
range-partitioned global sort, so it scales, but callers that only aggregate
further can pass ``ordered=False`` and skip it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..core import cut_lineage
from ..functions.exprs import customer_tier, day_label, stock_flag, stock_status
from ..functions.periods import Period, export_period, export_range, report_period
from ..operators.aggregates import (dashboard_kpis, daily_sales, sales_total, user_activity)
from ..operators.filters import top_products
from ..operators.joins import inventory_with_sales, sales_detail, users_with_sales, with_product_sums, with_user_sums
from ..operators.rollup import SalesRollup
from ..sinks.files import export_csv
from ..sinks.report_store import StoredReport, save_report


def by_name(col: str):
    """Case-insensitive name order, as MySQL's default collation sorts."""
    return F.collate(F.col(col), "UTF8_LCASE")


def newest_sales(df: DataFrame) -> list:
    """Newest first; ties by the sale's id (the driver's line key where there is none)."""
    return [F.col("transaction_date").desc(), F.col("id" if "id" in df.columns else "sale_key")]


def products_by_name() -> list:
    return [by_name("name"), F.col("id")]


def users_by_name() -> list:
    return [by_name("full_name"), F.col("id")]


def by_revenue() -> list:
    return [F.col("revenue").desc(), F.col("id")]


def by_spend() -> list:
    return [F.col("total_spent").desc(), F.col("id")]


@dataclass
class SalesReport:
    sales: DataFrame
    total_revenue: DataFrame
    period: Period


def sales_report(sales: DataFrame, inventory: DataFrame, users: DataFrame, date_range: str, as_of,
                 start=None, end=None, ordered: bool = True) -> SalesReport:
    """REP1: sale rows with product and customer names in a PER1 period, newest first, and the total."""
    period = report_period(date_range, as_of, start, end)
    detail = sales_detail(sales, inventory, users, period)
    rows = detail.orderBy(*newest_sales(detail)) if ordered else detail
    return SalesReport(rows, sales_total(detail), period)


def inventory_report(inventory: DataFrame, sales: DataFrame, ordered: bool = True) -> DataFrame:
    """REP2: every product with all-time units and revenue and the two-level stock flag, by name."""
    out = inventory_with_sales(inventory, sales).withColumn("stock_flag", stock_flag("quantity"))
    return out.orderBy(*products_by_name()) if ordered else out


def user_activity_report(users: DataFrame, sales: DataFrame, as_of, ordered: bool = True) -> DataFrame:
    """REP3: purchases, last activity and active flag per user, by name. All time: the
    reference works out a period here and never uses it."""
    out = user_activity(users, sales, as_of)
    return out.orderBy(*users_by_name()) if ordered else out


def sales_export(sales: DataFrame, inventory: DataFrame, users: DataFrame, date_range: str, as_of,
                 start=None, end=None, ordered: bool = True) -> DataFrame:
    """REP4: the sales CSV rows under a PER2 period, newest first."""
    detail = sales_detail(sales, inventory, users, export_period(date_range, as_of, start, end))
    detail = detail.orderBy(*newest_sales(detail)) if ordered else detail
    return detail.select("transaction_date", "product_name", "customer_name", "quantity", "total_amount")


def inventory_export(inventory: DataFrame, sales: DataFrame, date_range: str, as_of, start=None, end=None,
                     ordered: bool = True, rollup: SalesRollup | None = None, covered: tuple | None = None) -> DataFrame:
    """REP5: every product with units and revenue *in the period* (unsold ones show 0), by revenue. With a ``rollup`` of
    the days ``covered`` only the sales outside these days are read."""
    if rollup is None:
        joined = inventory_with_sales(inventory, sales, export_period(date_range, as_of, start, end))
    else:
        joined = with_product_sums(inventory, rollup.product_sales(sales, covered, *export_range(date_range, as_of, start, end)))
    out = joined.select("id", "name", "description", F.col("quantity").alias("current_stock"),
                        "total_sales", "revenue")
    return out.orderBy(*by_revenue()) if ordered else out


def user_activity_export(users: DataFrame, sales: DataFrame, date_range: str, as_of, start=None, end=None,
                         ordered: bool = True, rollup: SalesRollup | None = None, covered: tuple | None = None) -> DataFrame:
    """REP6: purchases, spend and last purchase per user in the period (everyone listed), by spend; ``rollup`` as in REP5."""
    if rollup is None:
        joined = users_with_sales(users, sales, export_period(date_range, as_of, start, end))
    else:
        joined = with_user_sums(users, rollup.user_sales(sales, covered, *export_range(date_range, as_of, start, end)))
    out = joined.select("id", "full_name", "email", "role", "total_purchases", "total_spent", "last_purchase")
    return out.orderBy(*by_spend()) if ordered else out


def dashboard(sales: DataFrame, inventory: DataFrame, users: DataFrame, start, end, as_of) -> dict[str, DataFrame]:
    """REP7: the dashboard's data for a custom date range.

    cards (AGG11), daily revenue series with labels (AGG5), top 5 products by units
    (TOP1), the sales table (newest first), the inventory table with the three-level stock status
    (EXP3) and the customer table with spend and tier (EXP5). Sales follow the period; the
    inventory and customer tables are all-time, as the reports they come from.
    """
    period = report_period("custom", as_of, start, end)
    detail = sales_detail(sales, inventory, users, period)
    inv = inventory_report(inventory, sales, ordered=False)
    customers = users_with_sales(users, sales).select(
        "id", "full_name", "total_purchases", "total_spent", "last_purchase",
        customer_tier("last_purchase", as_of).alias("tier"))
    return {
        "cards": dashboard_kpis(detail, inventory, users),
        "sales": detail.orderBy(*newest_sales(detail)),
        "daily": daily_sales(detail).withColumn("label", day_label("day")),
        "top_products": top_products(inv).select("id", "name", "total_sales"),
        "inventory": inv.select("id", "name", "quantity", "total_sales", "revenue",
                                stock_status("quantity").alias("status")),
        "customers": customers,
    }


def generate_report(report_type: str, tables: dict[str, DataFrame], date_range: str, as_of, start=None, end=None,
                    ordered: bool = True):
    """On-screen report by type (the 'generateReport' action): sales -> SalesReport, inventory and
    user_activity -> DataFrame. Unknown types raise ValueError. ``store_report`` also keeps it."""
    if report_type == "sales":
        return sales_report(tables["sales"], tables["inventory"], tables["users"], date_range, as_of, start, end, ordered)
    if report_type == "inventory":
        return inventory_report(tables["inventory"], tables["sales"], ordered)
    if report_type == "user_activity":
        return user_activity_report(tables["users"], tables["sales"], as_of, ordered)
    raise ValueError(f"Invalid report type: {report_type}")


def store_report(report_type: str, tables: dict[str, DataFrame], date_range: str, as_of, author: int, path: str,
                 start=None, end=None) -> int:
    """Make a report by type and store it (SNK2) under a new id: its lines in their order, and for sales the total and the
    period. Readers see it once it is whole (``sinks.report_store``). The sale rows of the period are joined once: the total is
    the sum of the rows that are stored."""
    report = generate_report(report_type, tables, date_range, as_of, start, end, ordered=False)
    if report_type == "sales":
        rows = cut_lineage(report.sales, "report")
        stored = StoredReport("sales", rows, newest_sales(rows), sales_total(rows), report.period.start, report.period.end)
    elif report_type == "inventory":
        stored = StoredReport("inventory", report, products_by_name())
    else:
        stored = StoredReport("user_activity", report, users_by_name())
    return save_report(stored, author, as_of, path)


def export_report(report_type: str, tables: dict[str, DataFrame], date_range: str, as_of, out_dir: str,
                  start=None, end=None, single_file: bool = False) -> str:
    """The 'exportReport' action: the export rows of a type under a PER2 period, written as CSV
    with the reference's headers to ``<out_dir>/<type>_report_<date>.csv`` (a folder of parts, or one file with
    ``single_file``); returns that path."""
    if report_type == "sales":
        rows = sales_export(tables["sales"], tables["inventory"], tables["users"], date_range, as_of, start, end)
    elif report_type == "inventory":
        rows = inventory_export(tables["inventory"], tables["sales"], date_range, as_of, start, end)
    elif report_type == "user_activity":
        rows = user_activity_export(tables["users"], tables["sales"], date_range, as_of, start, end)
    else:
        raise ValueError(f"Invalid report type: {report_type}")
    return export_csv(rows, report_type, out_dir, as_of, single_file)
