"""Aggregations (AGG1-AGG14) and the latest-row-per-key operator (WIN1).

Every aggregate here is decomposable (sum, count, max, max_by, count_if), so
Spark runs a partial aggregate before the shuffle: a key holding a third of
all rows is reduced map-side to one row per task before it moves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..core import as_datetime
from ..functions.exprs import is_active
from .joins import SUM_MONEY, users_with_sales

ACTIVE_ORDER_STATES = ["pending", "processing", "in_transit", "out_for_delivery"]


def sales_total(detail: DataFrame) -> DataFrame:
    """AGG1: period revenue (0 when there are no rows)."""
    return detail.agg(F.coalesce(F.sum("total_amount"), F.lit(0)).cast(SUM_MONEY).alias("total_revenue"))


def user_activity(users: DataFrame, sales: DataFrame, as_of) -> DataFrame:
    """AGG3: purchases, last activity and the active flag per user (all time, as on screen)."""
    joined = users_with_sales(users, sales)
    return joined.select("id", "full_name", "role", "created_at", "total_purchases",
                         F.col("last_purchase").alias("last_activity"),
                         is_active("last_purchase", as_datetime(as_of)).alias("is_active"))


def daily_sales(detail: DataFrame) -> DataFrame:
    """AGG5: revenue per calendar day, days ascending, no gap filling."""
    return (detail.groupBy(F.to_date("transaction_date").alias("day"))
            .agg(F.sum("total_amount").cast(SUM_MONEY).alias("revenue"))
            .orderBy("day"))


def units_by_product(detail: DataFrame) -> DataFrame:
    """AGG6: units per product *name* (products sharing a name are merged, as on the chart)."""
    return detail.groupBy("product_name").agg(F.sum("quantity").cast("long").alias("units"))


def role_distribution(users: DataFrame) -> DataFrame:
    """AGG7: users per role."""
    return users.groupBy("role").agg(F.count(F.lit(1)).alias("users"))


def sales_kpis(detail: DataFrame) -> DataFrame:
    """AGG8: revenue, number of sale rows, distinct products sold."""
    return detail.agg(F.coalesce(F.sum("total_amount"), F.lit(0)).cast(SUM_MONEY).alias("total_revenue"),
                      F.count(F.lit(1)).alias("total_sales"),
                      F.count_distinct("product_id").alias("active_products"))


def inventory_kpis(report: DataFrame) -> DataFrame:
    """AGG9: revenue, units and product count of an inventory report."""
    return report.agg(F.coalesce(F.sum("revenue"), F.lit(0)).cast(SUM_MONEY).alias("total_revenue"),
                      F.coalesce(F.sum("total_sales"), F.lit(0)).cast("long").alias("total_sales"),
                      F.count(F.lit(1)).alias("active_products"))


def user_kpis(report: DataFrame) -> DataFrame:
    """AGG10: total purchases and active users. (The page also shows the purchase count as money;
    that is a display bug and is left out.)"""
    return report.agg(F.coalesce(F.sum("total_purchases"), F.lit(0)).cast("long").alias("total_purchases"),
                      F.count_if(F.col("is_active") == 1).alias("active_users"))


def dashboard_kpis(detail: DataFrame, inventory: DataFrame, users: DataFrame) -> DataFrame:
    """AGG11: the four dashboard cards in one pass: period revenue, sale rows, products, customers.

    The three inputs are narrowed to a tag and an amount, unioned and reduced by one
    global aggregate (no cross join of one-row frames).
    """
    tagged = (detail.select(F.lit("s").alias("kind"), F.col("total_amount").cast(SUM_MONEY).alias("amount"))
              .unionByName(inventory.select(F.lit("p").alias("kind"), F.lit(None).cast(SUM_MONEY).alias("amount")))
              .unionByName(users.select(F.lit("u").alias("kind"), F.lit(None).cast(SUM_MONEY).alias("amount"))))
    return tagged.agg(
        F.coalesce(F.sum(F.when(F.col("kind") == "s", F.col("amount"))), F.lit(0)).cast(SUM_MONEY).alias("total_sales"),
        F.count_if(F.col("kind") == "s").alias("total_orders"),
        F.count_if(F.col("kind") == "p").alias("active_products"),
        F.count_if(F.col("kind") == "u").alias("active_customers"))


def current_status(orders: DataFrame, tracking: DataFrame) -> DataFrame:
    """WIN1: each order with its newest tracking status (null when it has none).

    Newest = latest created_at, ties broken by the highest tracking id (two rows
    can share a second). ``max_by`` over a struct is a partial aggregate, so this
    is skew-safe, unlike a row_number window that puts a whole order in one task.
    """
    latest = (tracking.groupBy("order_id")
              .agg(F.max_by("status", F.struct("created_at", "id")).alias("current_status")))
    return orders.join(latest.withColumnRenamed("order_id", "id"), "id", "left")


def order_stats(orders_current: DataFrame) -> DataFrame:
    """AGG12, per customer: total, active and completed orders by current status.

    Active tests pending / processing / in_transit / out_for_delivery, as the page
    does; 'pending' is not a tracking status and order_placed / payment_received
    count as neither active nor completed. Every order counts in the total.
    """
    st = F.col("current_status")
    return orders_current.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("total_orders"),
        F.count_if(st.isin(ACTIVE_ORDER_STATES)).alias("active_orders"),
        F.count_if(st == "delivered").alias("completed_orders"))


def admin_order_stats(orders_current: DataFrame) -> DataFrame:
    """AGG13: total, pending, processing and delivered orders by current status."""
    st = F.col("current_status")
    return orders_current.agg(
        F.count(F.lit(1)).alias("total_orders"),
        F.count_if(st == "pending").alias("pending_orders"),
        F.count_if(st == "processing").alias("processing_orders"),
        F.count_if(st == "delivered").alias("delivered_orders"))


def cart_totals(lines: DataFrame) -> DataFrame:
    """AGG14: cart total and line count per user."""
    return lines.groupBy("user_id").agg(F.sum("subtotal").cast(SUM_MONEY).alias("total"),
                                        F.count(F.lit(1)).alias("items"))
