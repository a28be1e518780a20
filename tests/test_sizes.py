"""What a step holds, shuffles and writes does not outgrow its rows."""

import pytest
from pyspark.sql import functions as F

from tillbook.operators.purchases import apply_purchases
from tillbook.plans import orders as O
from tillbook.plans import reports as R
from tillbook.sources.schemas import check_table


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def measured_broadcasts(spark):
    """Only adaptive execution broadcasts, by the sizes that it measures."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "1m"}
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _tracking(spark, n=3000):
    """Two null ids, one id twice, one order that does not exist, one null order."""
    row = spark.range(n)
    n_ = F.col("id")
    return row.select(F.when(n_ < 2, F.lit(None)).when(n_ == 3, F.lit(4)).otherwise(n_).cast("long").alias("id"),
                      F.when(n_ == 10, F.lit(10**6)).when(n_ != 11, n_ % 100).cast("long").alias("order_id"), F.lit("delivered").alias("status"),
                      F.lit("").alias("notes"), F.lit("2024-01-01").cast("timestamp_ntz").alias("created_at"))


def test_checks_join_lists_of_broken_keys(measured_broadcasts):
    spark = measured_broadcasts
    good, bad = check_table(_tracking(spark), "order_tracking", parents={"orders": spark.range(100).union(spark.range(5))})
    reasons = {r["reason"]: r["count"] for r in bad.groupBy("reason").count().collect()}
    assert reasons == {"id is null": 2, "order_id is null": 1, "duplicate id": 2, "order_id has no orders.id": 1}
    assert good.count() == 3000 - 6
    good.collect()
    ran = good._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    # neither the rows nor the parent's keys are sorted to be joined: a task holds the grouped keys or the rows, not both
    assert "SortMergeJoin" not in ran and ran.count("BroadcastHashJoin") >= 2


def test_history_is_dealt_by_order_once(spark):
    """Order 0 is long, order 3 has tracking only, order 4 nothing; a null order and lines of no order go."""
    sizes = {0: (23, 14), 1: (4, 2), 2: (1, 0), 3: (0, 7), 4: (0, 0)}
    items = [(f"k{j:02d}", o, f"n{o}-{j}") for o, (n, _) in sizes.items() for j in range(n)] + [("x", None, "gone"), ("y", 99, "gone")]
    log = [(o * 100 + j, o, f"s{o}-{j}", j // 2) for o, (_, n) in sizes.items() for j in range(n)]
    history = {
        "orders": spark.createDataFrame([(o, "u") for o in sizes] + [(None, "u")], "id long, user_id string"),
        "items": spark.createDataFrame(items, "item_key string, order_id long, name string"),
        "tracking": spark.createDataFrame(log, "id long, order_id long, status string, at int").select(
            "id", "order_id", "status", F.lit(None).cast("string").alias("location"), F.lit("").alias("notes"),
            (F.lit("2024-01-01").cast("timestamp_ntz") + F.expr("make_dt_interval(at)")).alias("created_at"))}
    want = set()
    for o, (n, m) in sizes.items():
        newest = sorted((x for x in log if x[1] == o), key=lambda x: (-x[3], -x[0]))
        for c in range(max(1, -(-n // 3), -(-m // 3))):
            want.add((o, c, tuple((j + 1, f"n{o}-{j}") for j in range(3 * c, min(n, 3 * c + 3))),
                      tuple((j + 1, newest[j][2]) for j in range(3 * c, min(m, 3 * c + 3)))))
    for rows_per_order in (8, 100):
        nested = O.nest_order_history(history, rows_per_chunk=3, rows_per_order=rows_per_order)
        got = [(r["id"], r["chunk"], tuple((x["position"], x["name"]) for x in r["items"]), tuple((x["position"], x["status"]) for x in r["tracking"]))
               for r in nested.collect()]
        assert len(got) == len(want) and set(got) == want
    ran = _plan(nested).split("Initial Plan")[0]
    assert ran.count("hashpartitioning(order_id") == 1 and "Window" not in ran


def test_a_stored_sales_report_is_joined_once(spark, scratch, monkeypatch):
    rows = [(1, 1, 5, "2.50"), (2, 2, 5, "1.00"), (3, 1, 6, "4.00"), (4, 9, 5, "8.00")]
    tables = {"sales": spark.createDataFrame(rows, "id long, user_id long, product_id long, amount string").select(
                  "id", "user_id", "product_id", F.lit(1).alias("quantity"), F.col("amount").cast("decimal(10,2)").alias("total_amount"),
                  F.lit("2001-07-30").cast("timestamp_ntz").alias("transaction_date")),
              "inventory": spark.createDataFrame([(5, "a"), (6, "b")], "id long, name string"),
              "users": spark.createDataFrame([(1, "x"), (2, "y")], "id long, full_name string")}
    stored = []
    monkeypatch.setattr(R, "save_report", lambda report, *rest: stored.append(report))
    R.store_report("sales", tables, "year", "2001-08-01 12:00:00", 1, scratch)
    assert "Join" not in _plan(stored[0].lines) and "Join" not in _plan(stored[0].total)
    assert [r["id"] for r in stored[0].lines.orderBy("id").collect()] == [1, 2, 3]
    assert str(stored[0].total.first()["total_revenue"]) == "7.50"


def test_refused_purchases_are_not_joined_again(spark):
    inventory = spark.createDataFrame([(1, 10, "2.00"), (2, None, "1.00")], "id long, quantity int, p string").select(
        "id", "quantity", F.col("p").cast("decimal(10,2)").alias("price"))
    asked = [("a", 1, 6), ("b", 1, 0), ("c", 1, 5), ("d", 1, 4), ("e", 7, 1), ("f", None, 1), ("g", None, None), ("h", 7, None), ("i", 2, 1), ("j", 1, 1)]
    requests = spark.createDataFrame(asked, "request_id string, product_id long, quantity int").select(
        "*", F.lit(1).cast("long").alias("user_id"), F.lit("2024-01-01").cast("timestamp_ntz").alias("requested_at"))
    out = apply_purchases(inventory, requests, slices=3, rows_per_slice=2)
    assert {r["request_id"] for r in out["sales"].collect()} == {"a", "d"}
    bad, gone, short = "Invalid quantity", "Product not found", "Insufficient quantity available"
    assert {r["request_id"]: r["message"] for r in out["rejects"].collect()} == {
        "b": bad, "c": short, "e": gone, "f": gone, "g": bad, "h": bad, "i": short, "j": short}
    assert "Join" not in _plan(out["rejects"])
