"""Joins that split heavy keys without the session's help."""

import pytest
from pyspark.sql import functions as F

from tillbook.operators import joins as J
from tillbook.operators.skew import heavy_keys, split_join
from tillbook.plans import orders as O


@pytest.fixture
def plain_session(spark):
    """No broadcast of measured sides, no adaptive skew split, 24 partitions."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "24"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def _lines(spark, n=30_000, null_share=False):
    product = F.when(F.col("id") % 3 == 0, F.lit(None).cast("long") if null_share else F.lit(7)).otherwise(F.col("id") % 500)
    return spark.range(n).select(F.col("id").alias("item_key"), (F.col("id") % 4000).alias("order_id"), product.cast("long").alias("product_id"),
                                 F.lit(2).alias("quantity"))


def _inventory(spark, n=480):
    return spark.range(n).select("id", F.concat(F.lit("p"), "id").alias("name"), F.lit("i").alias("image"))


def _largest_share(df):
    per_task = [r["n"] for r in df.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()]
    return max(per_task) / sum(per_task)


def test_heavy_keys_are_bounded_and_counted(spark):
    rows = _lines(spark)
    got = {r["product_id"]: r["_salts"] for r in heavy_keys(rows, "product_id", 24).collect()}
    assert set(got) == {7} and 16 <= got[7] <= 18  # a third of the rows over 48 half shares
    assert heavy_keys(spark.range(100).withColumnRenamed("id", "product_id"), "product_id", 24).count() == 0
    assert heavy_keys(rows.limit(0), "product_id", 24).count() == 0
    assert heavy_keys(spark.range(10_000).select((F.col("id") % 50).alias("product_id")), "product_id", 40).count() < 80


def test_a_third_of_the_lines_on_one_product(plain_session):
    lines, inventory = _lines(plain_session), _inventory(plain_session)
    joined = J.order_lines(lines, inventory)
    assert _largest_share(joined) < 0.1
    usual = lines.join(inventory.withColumnRenamed("id", "product_id"), "product_id")
    assert _largest_share(usual) > 0.3
    cols = ["item_key", "order_id", "product_id", "quantity", "name", "image"]
    assert sorted(map(tuple, joined.select(cols).collect())) == sorted(map(tuple, usual.select(cols).collect()))


def test_left_join_spreads_rows_without_a_key(plain_session):
    lines, inventory = _lines(plain_session, null_share=True), _inventory(plain_session).withColumnRenamed("id", "product_id")
    joined = split_join(lines, inventory, "product_id", "left")
    assert _largest_share(joined) < 0.1
    cols = ["item_key", "product_id", "name"]
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(joined.select(cols).collect(), key=key) == sorted(lines.join(inventory, "product_id", "left").select(cols).collect(), key=key)


def test_receipts_of_hot_products(plain_session):
    spark = plain_session
    lines = _lines(spark).withColumn("price_per_unit", F.lit("1.00").cast("decimal(10,2)")).withColumn("subtotal", F.lit("2.00").cast("decimal(10,2)"))
    orders = spark.range(4010).select("id", F.lit(1).cast("long").alias("user_id"), F.lit("2.00").cast("decimal(10,2)").alias("total_amount"))
    users = spark.createDataFrame([(1, "a", "e", "0")], "id long, full_name string, email string, phone string")
    payments = spark.createDataFrame([], "id long, order_id long, transaction_id string, status string, created_at timestamp_ntz")
    got = O.receipts(orders, users, payments, lines, _inventory(spark, 500))
    assert got.count() == 30_000 + 10
    assert got.where("item_key is null").count() == 10
