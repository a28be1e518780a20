"""Join operators (JOIN1-JOIN9). All equi joins.

Plan shape, chosen for scale: the fact side (sales, items, payments) is
filtered and aggregated to the join key *before* it meets a dimension, so the
shuffle carries one row per key instead of one per sale. No broadcast hints on
tables that grow with the data: AQE measures the real post-filter size at run
time and switches to a broadcast join only below
``spark.sql.adaptive.autoBroadcastJoinThreshold``; above it the join stays a
shuffle join, with AQE's skew-join split for a hot key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import subtotal
from ..sources.schemas import MONEY
from .skew import split_join

SUM_MONEY = "decimal(38,2)"


def _pred(df: DataFrame, predicate) -> DataFrame:
    if predicate is None:
        return df
    if callable(predicate):
        return df.where(predicate("transaction_date"))
    if isinstance(predicate, Column):
        return df.where(predicate)
    return df.where(predicate.contains("transaction_date"))


def sales_detail(sales: DataFrame, inventory: DataFrame, users: DataFrame, period=None) -> DataFrame:
    """JOIN1: sales with product and customer names (inner joins, two hops), period applied first."""
    s = _pred(sales, period)
    products = inventory.select(F.col("id").alias("product_id"), F.col("name").alias("product_name"))
    customers = users.select(F.col("id").alias("user_id"), F.col("full_name").alias("customer_name"))
    return s.join(products, "product_id").join(customers, "user_id")


def known_sales(sales: DataFrame, inventory: DataFrame, users: DataFrame, period=None) -> DataFrame:
    """The rows of JOIN1 without the names: sales whose product and customer exist, for sums that use neither name."""
    return (_pred(sales, period).join(inventory.select(F.col("id").alias("product_id")), "product_id", "left_semi")
            .join(users.select(F.col("id").alias("user_id")), "user_id", "left_semi"))


def product_sales(sales: DataFrame, period=None) -> DataFrame:
    """Sales pre-aggregated per product (partial aggregation map-side, one row per product shuffled)."""
    return (_pred(sales, period).groupBy("product_id")
            .agg(F.sum("quantity").cast("long").alias("total_sales"),
                 F.sum("total_amount").cast(SUM_MONEY).alias("revenue")))


def inventory_with_sales(inventory: DataFrame, sales: DataFrame, period=None) -> DataFrame:
    """JOIN2 / JOIN3: every product with its units and revenue; unsold (in the period) ones get 0.

    With a period this is the reference's "period in the ON clause": the filter
    goes on the sales side only, so products without sales in it still appear.
    """
    return with_product_sums(inventory, product_sales(sales, period))


def with_product_sums(inventory: DataFrame, sums: DataFrame) -> DataFrame:
    """Every product with the sums of ``product_sales`` or of a roll-up (``rollup.SalesRollup``)."""
    return (inventory.join(sums.withColumnRenamed("product_id", "id"), "id", "left")
            .withColumn("total_sales", F.coalesce("total_sales", F.lit(0).cast("long")))
            .withColumn("revenue", F.coalesce("revenue", F.lit(0).cast(SUM_MONEY))))


def user_sales(sales: DataFrame, period=None) -> DataFrame:
    return (_pred(sales, period).groupBy("user_id")
            .agg(F.count(F.lit(1)).alias("total_purchases"),
                 F.sum("total_amount").cast(SUM_MONEY).alias("total_spent"),
                 F.max("transaction_date").alias("last_purchase")))


def users_with_sales(users: DataFrame, sales: DataFrame, period=None) -> DataFrame:
    """JOIN4 / JOIN5: every user with purchase count, spend and last purchase; 0 / 0 / null if none."""
    return with_user_sums(users, user_sales(sales, period))


def with_user_sums(users: DataFrame, sums: DataFrame) -> DataFrame:
    """Every user with the sums of ``user_sales`` or of a roll-up."""
    return (users.join(sums.withColumnRenamed("user_id", "id"), "id", "left")
            .withColumn("total_purchases", F.coalesce("total_purchases", F.lit(0).cast("long")))
            .withColumn("total_spent", F.coalesce("total_spent", F.lit(0).cast(SUM_MONEY))))


def cart_lines(cart: DataFrame, inventory: DataFrame) -> DataFrame:
    """JOIN6: cart lines with product name, price, image and the line subtotal (inner join:
    a line whose product is gone disappears, as in the reference)."""
    products = inventory.select(F.col("id").alias("product_id"), "name", "price", "image")
    return cart.join(products, "product_id").withColumn("subtotal", subtotal("quantity", "price"))


def order_lines(items: DataFrame, inventory: DataFrame) -> DataFrame:
    """JOIN7: order lines with product name and image.

    Callers join the lines again by order, which keeps adaptive execution from splitting a hot product, so its rows
    are split here (``skew.split_join``)."""
    products = inventory.select(F.col("id").alias("product_id"), "name", "image")
    return split_join(items, products, "product_id")


def best_payment(payments: DataFrame) -> DataFrame:
    """One payment per order for receipts: completed first, then the latest, then the highest id.

    ``max_by`` is a partial aggregate, so a hot order is combined map-side.
    """
    rank = F.struct((F.col("status") == "completed").alias("done"), F.col("created_at"), F.col("id"))
    return (payments.groupBy("order_id")
            .agg(F.max_by("transaction_id", rank).alias("mpesa_transaction")))


def receipt_headers(orders: DataFrame, users: DataFrame, payments: DataFrame) -> DataFrame:
    """JOIN8: order + customer contact (inner) + the payment reference if any (left)."""
    contact = users.select(F.col("id").alias("user_id"), "full_name", "email", "phone")
    return (orders.join(contact, "user_id")
            .join(best_payment(payments).withColumnRenamed("order_id", "id"), "id", "left"))


def deletable(requests: DataFrame, sales: DataFrame, key: str = "product_id") -> DataFrame:
    """JOIN9: requested products with no sale ever (left anti join on the sold product ids).

    The ids are made distinct first: each task sends one row per product, so a product
    with a third of all sales is no heavier than any other."""
    sold = sales.select(F.col("product_id").alias(key)).distinct()
    return requests.join(sold, key, "left_anti")


__all__ = ["sales_detail", "known_sales", "product_sales", "inventory_with_sales", "user_sales", "users_with_sales",
           "cart_lines", "order_lines", "best_payment", "receipt_headers", "deletable", "SUM_MONEY", "MONEY"]
