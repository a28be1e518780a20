"""Hand-made edge rows (FIXTURES.md, F2) that neither the seed nor the driver tables contain."""

import datetime as dt
from decimal import Decimal

import pytest

from tillbook.functions import exprs as X
from tillbook.functions.periods import export_period, minus_months, order_period, report_period
from tillbook.operators import aggregates as A
from tillbook.operators import cart as CART
from tillbook.operators import changes as CHG
from tillbook.operators import payments as PAY
from tillbook.operators.joins import best_payment
from tillbook.operators.purchases import apply_purchases
from tillbook.plans import reports as R
from tillbook.sinks import files as SNK
from tillbook.sources.schemas import SCHEMAS, check_table

T0 = dt.datetime(2024, 5, 15, 10, 0, 0)


def ts(days=0, seconds=0):
    return T0 - dt.timedelta(days=days, seconds=seconds)


def test_stock_rules(spark):
    df = spark.createDataFrame([(q,) for q in (-1, 0, 9, 10, 11)], "q int")
    got = {r["q"]: (r["flag"], r["status"]) for r in
           df.select("q", X.stock_flag("q").alias("flag"), X.stock_status("q").alias("status")).collect()}
    assert got == {-1: ("Low Stock", "Out of Stock"), 0: ("Low Stock", "Out of Stock"), 9: ("Low Stock", "Low Stock"),
                   10: ("In Stock", "Low Stock"), 11: ("In Stock", "In Stock")}


def test_activity_tiers_at_the_edges(spark):
    rows = [(1, ts(30)), (2, ts(30, 1)), (3, ts(31)), (4, ts(90)), (5, ts(91)), (6, None), (7, ts(29, 86399))]
    df = spark.createDataFrame(rows, "id long, last timestamp_ntz")
    got = {r["id"]: (r["tier"], r["active"]) for r in df.select(
        "id", X.customer_tier("last", T0).alias("tier"), X.is_active("last", T0).alias("active")).collect()}
    # exactly 30 days back: Active by whole days, but not active (the SQL test is strictly later)
    assert got[1] == ("Active", 0)
    assert got[2] == ("Active", 0)
    assert got[3] == ("Inactive", 0)
    assert got[4] == ("Inactive", 0)
    assert got[5] == ("Dormant", 0)
    assert got[6] == ("Dormant", 0)
    assert got[7] == ("Active", 1)


def test_current_status_ties_and_missing(spark):
    orders = spark.createDataFrame([(1, 7, "pending"), (2, 7, "pending")], "id long, user_id long, status string")
    tracking = spark.createDataFrame(
        [(10, 1, "order_placed", ts(1)), (11, 1, "payment_received", ts(1)), (9, 1, "delivered", ts(2))],
        "id long, order_id long, status string, created_at timestamp_ntz")
    got = {r["id"]: r["current_status"] for r in A.current_status(orders, tracking).collect()}
    assert got == {1: "payment_received", 2: None}  # same second: the higher tracking id wins


def test_best_payment_prefers_completed(spark):
    pays = spark.createDataFrame(
        [(1, 5, "WVa", "failed", ts(1)), (2, 5, "WVb", "completed", ts(2)), (3, 5, "WVc", "pending", ts(0)),
         (4, 6, "WVd", "pending", ts(3)), (5, 6, "WVe", "pending", ts(3))],
        "id long, order_id long, transaction_id string, status string, created_at timestamp_ntz")
    got = {r["order_id"]: r["mpesa_transaction"] for r in best_payment(pays).collect()}
    assert got == {5: "WVb", 6: "WVe"}


def replay_purchases(stock, requests):
    left, out = dict(stock), {}
    for rid, _, pid, q, _ in sorted(requests, key=lambda r: (r[4], r[0])):
        if q is None or q < 1:
            out[rid] = "Invalid quantity"
        elif pid not in left:
            out[rid] = "Product not found"
        elif q > left[pid]:
            out[rid] = "Insufficient quantity available"
        else:
            left[pid] -= q
            out[rid] = "ok"
    return out, left


def test_purchase_refusals(spark):
    inv = spark.createDataFrame([(1, "a", Decimal("2.50"), 10)], "id long, name string, price decimal(10,2), quantity int")
    reqs = [(1, 9, 99, 1, ts(5)), (2, 9, 1, 0, ts(4)), (3, 9, 1, 11, ts(3)), (4, 9, 1, 4, ts(2)), (5, 9, 1, 7, ts(1)),
            (6, 9, 1, 6, ts(0))]
    req = spark.createDataFrame(reqs, "request_id long, user_id long, product_id long, quantity int, requested_at timestamp_ntz")
    out = apply_purchases(inv, req)
    sales = {r["request_id"]: r["total_amount"] for r in out["sales"].collect()}
    rejects = {r["request_id"]: r["message"] for r in out["rejects"].collect()}
    assert sales == {4: Decimal("10.00"), 6: Decimal("15.00")}
    assert rejects == {1: "Product not found", 2: "Invalid quantity", 3: "Insufficient quantity available",
                       5: "Insufficient quantity available"}
    assert out["inventory"].first()["quantity"] == 0
    expected, _ = replay_purchases({1: 10}, reqs)
    assert {k for k, v in expected.items() if v == "ok"} == set(sales)


def test_cart_event_edges(spark):
    ev = [
        (1, 1, 10, "set", 5, ts(9)),        # set before any add: no line
        (2, 1, 10, "add", 2, ts(8)),
        (3, 1, 10, "add", 1, ts(7)),         # 3
        (4, 1, 10, "remove", None, ts(6)),
        (5, 1, 10, "add", 4, ts(5)),         # add after remove: 4
        (6, 1, 10, "set", 2, ts(4)),         # set: 2
        (7, 1, 10, "add", 1, ts(3)),         # 3
        (8, 2, 10, "add", 1, ts(9)),
        (9, 2, None, "checkout", None, ts(8)),
        (10, 2, 11, "add", 2, ts(7)),        # checkout then add: 2
        (11, 3, None, "checkout", None, ts(7)),   # checkout of an empty cart
        (12, 3, 12, "add", 0, ts(6)),        # quantity 0: rejected event
    ]
    df = spark.createDataFrame(ev, "event_id long, user_id long, product_id long, action string, quantity int, event_time timestamp_ntz")
    out = CART.fold_cart(df)
    got = {(r["user_id"], r["product_id"]): r["quantity"] for r in out["cart"].collect()}
    assert got == {(1, 10): 3, (2, 11): 2}
    assert [r["event_id"] for r in out["rejects"].collect()] == [12]


def test_checkout_empty_and_repeat(spark):
    cart = spark.createDataFrame([(1, 10, 2, ts(1), ts(1))],
                                 "user_id long, product_id long, quantity int, created_at timestamp_ntz, updated_at timestamp_ntz")
    inv = spark.createDataFrame([(10, "x", Decimal("1.25"), 5, None)],
                                "id long, name string, price decimal(10,2), quantity int, image string")
    reqs = spark.createDataFrame([("a", 1, "addr", ts(0)), ("b", 1, "addr", ts(0, -5)), ("c", 2, "addr", ts(0))],
                                 "request_id string, user_id long, delivery_address string, requested_at timestamp_ntz")
    out = CART.checkout(cart, inv, reqs, base_ids={"orders": 100, "tracking": 50, "order_items": 7})
    orders = out["orders"].collect()
    assert [(o["id"], o["total_amount"], o["request_id"]) for o in orders] == [(101, Decimal("2.50"), "a")]
    assert {r["request_id"]: r["message"] for r in out["rejects"].collect()} == {"b": "Cart is empty", "c": "Cart is empty"}
    assert [(t["id"], t["order_id"]) for t in out["order_tracking"].collect()] == [(51, 101)]
    assert [(i["id"], i["subtotal"]) for i in out["order_items"].collect()] == [(8, Decimal("2.50"))]
    assert out["cart"].count() == 0


def test_signups_case_and_phone(spark):
    users = spark.createDataFrame([(1, "A", "Jane@Example.com", "1234567890", "customer", ts(9))], SCHEMAS["users"])
    reqs = spark.createDataFrame([
        (1, "J", "jane@example.COM", "(123) 456-7890", "customer", ts(5)),   # taken (case)
        (2, "K", "k@x.io", "(123) 456-7890", "admin", ts(4)),                # ok
        (3, "K2", "K@X.io", "1234567890", "customer", ts(3)),                # same batch, later: taken
        (4, "L", "l@x.io", "123456789", "customer", ts(2)),                  # 9 digits
        (5, "M", "m@x.io", "1234567890", "master_admin", ts(1)),             # role not offered
        (6, "", "n@x.io", "1234567890", "customer", ts(1)),                  # missing field
    ], "request_id long, full_name string, email string, phone string, role string, requested_at timestamp_ntz")
    out = CHG.accept_signups(users, reqs)
    assert [(u["id"], u["email"], u["phone_digits"]) for u in out["users"].collect()] == [(2, "k@x.io", "1234567890")]
    assert {r["request_id"]: r["message"] for r in out["rejects"].collect()} == {
        1: "Email already exists", 3: "Email already exists", 4: "Please enter a valid 10-digit phone number",
        5: "Invalid role", 6: "Please fill in all fields"}


def test_name_order_is_case_insensitive(spark):
    inv = spark.createDataFrame([(1, "b", Decimal("1"), 1), (2, "A", Decimal("1"), 1), (3, "a", Decimal("1"), 1)],
                                "id long, name string, price decimal(10,2), quantity int")
    sales = spark.createDataFrame([], SCHEMAS["sales"])
    assert [r["id"] for r in R.inventory_report(inv, sales).collect()] == [2, 3, 1]


def test_csv_round_trip_with_awkward_text(spark, scratch):
    inv = spark.createDataFrame([(1, 'Jug, "big"\nand heavy', "desc, with comma", Decimal("1.00"), 3)],
                                "id long, name string, description string, price decimal(10,2), quantity int")
    sales = spark.createDataFrame([(1, 1, 1, 2, Decimal("2.00"), dt.datetime(2001, 3, 30))], SCHEMAS["sales"])
    export = R.inventory_export(inv, sales, "month", "2001-03-31 12:00:00")
    path = SNK.export_csv(export, "inventory", scratch, "2001-03-31 12:00:00")
    assert path.endswith("inventory_report_2001-03-31.csv")
    back = SNK.read_export(spark, path, "inventory").collect()
    assert len(back) == 1
    assert back[0]["Product"] == 'Jug, "big"\nand heavy' and back[0]["Description"] == "desc, with comma"
    assert (back[0]["Current Stock"], back[0]["Total Sales"], back[0]["Revenue"]) == (3, 2, Decimal("2.00"))


def test_periods():
    assert minus_months(dt.date(2001, 3, 31), 1) == dt.date(2001, 2, 28)
    assert minus_months(dt.date(2004, 3, 31), 1) == dt.date(2004, 2, 29)
    assert order_period("month", "2001-03-31") == (dt.date(2001, 3, 3), dt.date(2001, 3, 31))
    p = report_period("week", "2001-08-01 12:00:00")
    assert (p.start, p.end) == (dt.datetime(2001, 7, 25), dt.datetime(2001, 8, 1, 12))
    p = report_period("year", "2001-08-01 12:00:00")  # unknown names fall back to 30 days
    assert p.start == dt.datetime(2001, 7, 2)
    with pytest.raises(ValueError):
        export_period("custom", "2001-08-01", None, "2001-08-01")("transaction_date")


def test_check_table_reasons(spark):
    users = spark.createDataFrame([(1, "A", "a@x", "1", "customer", None), (2, "B", "a@x", "2", "boss", None),
                                   (3, "C", "c@x", "3", "admin", None)], SCHEMAS["users"])
    good, bad = check_table(users, "users")
    assert [r["id"] for r in good.collect()] == [3]
    assert {r["id"]: r["reason"] for r in bad.collect()} == {
        1: "duplicate email", 2: "role not in customer/admin/master_admin"}


def test_status_updates_pending_and_bulk(spark):
    orders = spark.createDataFrame([(1, 5, Decimal("1"), "pending", "x", ts(9), ts(9))], SCHEMAS["orders"])
    tracking = spark.createDataFrame([(40, 1, "order_placed", None, None, ts(9))], SCHEMAS["order_tracking"])
    reqs = spark.createDataFrame([(1, [1, 2], "out_for_delivery", "n", ts(3)), (2, [1], "delivered", "n", ts(2)),
                                  (3, [1], "pending", "n", ts(1)), (4, [1], "lost", "n", ts(1))],
                                 "request_id long, order_ids array<long>, status string, notes string, requested_at timestamp_ntz")
    out = CHG.apply_status_updates(orders, tracking, reqs)
    assert out["orders"].first()["status"] == "pending"  # latest order-status request
    assert [(t["id"], t["status"]) for t in out["order_tracking"].orderBy("id").collect()] == [
        (41, "out_for_delivery"), (42, "delivered")]
    assert {(r["request_id"], r["order_id"]): r["message"] for r in out["rejects"].collect()} == {
        (1, 2): "Order not found", (4, 1): "Invalid status"}


def test_payment_confirmations(spark):
    pays = spark.createDataFrame(
        [(1, 7, "WV1", "0712345678", Decimal("5"), "pending", None, None, ts(5), None),
         (2, 8, "WV2", "0712345678", Decimal("5"), "completed", "0", "Success", ts(5), ts(4))], SCHEMAS["payments"])
    orders = spark.createDataFrame([(7, 1, Decimal("5"), "pending", "x", ts(9), ts(9)),
                                    (8, 1, Decimal("5"), "processing", "x", ts(9), ts(9))], SCHEMAS["orders"])
    tracking = spark.createDataFrame([(3, 7, "order_placed", None, None, ts(9))], SCHEMAS["order_tracking"])
    conf = spark.createDataFrame([(1, "WV1", "0", "Success", ts(1)), (2, "WV1", "0", "Success", ts(0)),
                                  (3, "WV2", "0", "Success", ts(1)), (4, "WVZ", "0", "Success", ts(1))],
                                 "confirmation_id long, transaction_id string, result_code string, result_desc string, confirmed_at timestamp_ntz")
    out = PAY.apply_payments(pays, orders, tracking, conf)
    assert {r["confirmation_id"]: r["message"] for r in out["rejects"].collect()} == {
        2: "Duplicate confirmation", 3: "Payment already processed", 4: "Transaction not found"}
    assert {r["id"]: r["status"] for r in out["orders"].collect()} == {7: "processing", 8: "processing"}
    assert [(t["id"], t["order_id"], t["status"]) for t in out["order_tracking"].collect()] == [(4, 7, "payment_received")]
    assert {r["id"]: r["status"] for r in out["payments"].collect()} == {1: "completed", 2: "completed"}


def test_for_user_literal_and_table(spark):
    orders = spark.createDataFrame([(1, 5), (2, 6), (3, 5)], "id long, user_id long")
    from tillbook.operators.filters import filter_orders, for_user
    assert sorted(r["id"] for r in for_user(orders, 5).collect()) == [1, 3]
    users = spark.createDataFrame([(6,), (6,), (9,)], "id long")  # duplicates must not duplicate orders
    assert [r["id"] for r in for_user(orders, users).collect()] == [2]
    o = spark.createDataFrame([(1, "pending", dt.datetime(2001, 7, 31, 23, 59)), (2, "delivered", dt.datetime(2001, 8, 1))],
                              "id long, status string, created_at timestamp_ntz")
    assert filter_orders(o, "all").count() == 2 and filter_orders(o, "").count() == 2
    assert [r["id"] for r in filter_orders(o, None, ("2001-07-31", "2001-07-31")).collect()] == [1]
    assert [r["id"] for r in filter_orders(o, "delivered", order_period("today", "2001-08-01 09:00:00")).collect()] == [2]


def test_presets_and_custom_dates():
    from tillbook.functions.periods import preset_period
    p = preset_period("Last Month", "2001-03-15 10:00:00")
    assert (p.start, p.end) == (dt.datetime(2001, 2, 1), dt.datetime(2001, 2, 28, 23, 59, 59))
    p = preset_period("This Month", "2001-02-10")
    assert p.end == dt.datetime(2001, 2, 28, 23, 59, 59)
    assert order_period("admin_default", "2001-08-01") == (dt.date(2001, 7, 2), dt.date(2001, 8, 1))
    assert order_period("anything", "2001-08-01") is None
    with pytest.raises(ValueError):
        order_period("custom", "2001-08-01", "2001-07-01", None)
    with pytest.raises(ValueError):
        preset_period("Next Year", "2001-08-01")


def test_expression_labels(spark):
    df = spark.createDataFrame([("out_for_delivery", "", Decimal("1234567.5"), 42, dt.datetime(2001, 8, 1, 12))],
                               "s string, img string, m decimal(10,2), oid long, t timestamp_ntz")
    r = df.select(X.status_label("s").alias("a"), X.image_or_default("img").alias("b"), X.money("m").alias("c"),
                  X.payment_ref("oid", "t").alias("d"), X.day_label("t").alias("e"),
                  X.report_title("user_activity", "2001-08-01 12:00:00").alias("f")).first()
    assert r["a"] == "Out For Delivery" and r["b"] == X.DEFAULT_IMAGE and r["c"] == "1,234,567.50"
    assert r["d"] == "WV9966672000042" and r["e"] == "Aug 1" and r["f"] == "User_activity Report - 2001-08-01 12:00:00"


def test_product_changes_image_rules(spark):
    inv = spark.createDataFrame([(1, "a", "d", Decimal("1.00"), 5, "old.png", ts(9), ts(9)),
                                 (2, "b", "d", Decimal("1.00"), 5, "keep.png", ts(9), ts(9))], SCHEMAS["inventory"])
    req = spark.createDataFrame([
        ("r1", "update", 1, "A", Decimal("2.00"), 6, "d2", "new.png", ts(5)),
        ("r2", "update", 1, "A2", Decimal("3.00"), 7, "d3", "0", ts(4)),      # "0" gives no image
        ("r3", "update", 2, "B", Decimal("2.00"), 6, "d2", "", ts(5)),        # blank keeps the old one
        ("r4", "update", 99, "X", Decimal("2.00"), 6, "d2", None, ts(5)),     # unknown id
        ("r5", "add", None, "C", Decimal("4.00"), 9, "d", "", ts(3)),         # stored as given
        ("r6", "add", None, "D", Decimal("-1.00"), 9, "d", None, ts(3)),      # negative price
    ], "request_id string, action string, product_id long, name string, price decimal(10,2), quantity int, "
       "description string, image string, requested_at timestamp_ntz")
    out = CHG.apply_product_changes(inv, req)
    rows = {r["id"]: r for r in out["inventory"].collect()}
    assert (rows[1]["name"], rows[1]["price"], rows[1]["image"]) == ("A2", Decimal("3.00"), "new.png")
    assert (rows[2]["name"], rows[2]["image"]) == ("B", "keep.png")
    assert (rows[3]["name"], rows[3]["image"]) == ("C", "")
    assert {r["request_id"]: r["message"] for r in out["rejects"].collect()} == {
        "r4": "Product not found", "r6": "Failed to add product"}


def test_order_history_nesting_and_receipts(spark):
    from tillbook.plans import orders as O
    orders = spark.createDataFrame([(1, 5, Decimal("3.00"), "pending", "x", ts(3), ts(3)),
                                    (2, 5, Decimal("1.00"), "pending", "x", ts(1), ts(1)),
                                    (3, 6, Decimal("2.00"), "pending", "y", ts(2), ts(2))], SCHEMAS["orders"])
    items = spark.createDataFrame([("a", 1, 10, 1, Decimal("1.00"), Decimal("1.00")),
                                   ("b", 1, 11, 2, Decimal("1.00"), Decimal("2.00")),
                                   ("c", 3, 10, 2, Decimal("1.00"), Decimal("2.00"))],
                                  "item_key string, order_id long, product_id long, quantity int, "
                                  "price_per_unit decimal(10,2), subtotal decimal(10,2)")
    tracking = spark.createDataFrame([(20, 1, "order_placed", None, None, ts(3)),
                                      (21, 1, "payment_received", None, None, ts(2)),
                                      (22, 1, "processing", None, None, ts(2)),
                                      (23, 3, "order_placed", None, None, ts(2))], SCHEMAS["order_tracking"])
    inv = spark.createDataFrame([(10, "p10", Decimal("1.00"), 5, None), (11, "p11", Decimal("1.00"), 5, "i.png")],
                                "id long, name string, price decimal(10,2), quantity int, image string")
    hist = O.order_history(orders, items, tracking, inv, user=5)
    assert [r["id"] for r in hist["orders"].collect()] == [2, 1]  # user 5 only, newest first
    nested = {r["id"]: r for r in O.nest_order_history(hist).collect()}
    chunked = [r for r in O.nest_order_history(hist, rows_per_chunk=1).collect() if r["id"] == 1]
    assert [(r["chunk"], [t["id"] for t in r["tracking"]], [i["item_key"] for i in r["items"]]) for r in sorted(chunked, key=lambda r: r["chunk"])] == [
        (0, [22], ["a"]), (1, [21], ["b"]), (2, [20], [])]
    assert [t["id"] for t in nested[1]["tracking"]] == [22, 21, 20]  # newest first, same second by id
    assert nested[1]["current_status"] == "processing"
    assert nested[2]["tracking"] == [] and nested[2]["items"] == [] and nested[2]["current_status"] is None
    assert sorted(i["product_id"] for i in nested[1]["items"]) == [10, 11]
    users = spark.createDataFrame([(5, "Ann", "a@x", "1234567890", "customer", ts(9)),
                                   (6, "Bob", "b@x", "1234567891", "customer", ts(9))], SCHEMAS["users"])
    pays = spark.createDataFrame([(1, 1, "WV1", "0712345678", Decimal("3.00"), "failed", "1", "x", ts(2), None),
                                  (2, 1, "WV2", "0712345678", Decimal("3.00"), "completed", "0", "ok", ts(1), ts(1))],
                                 SCHEMAS["payments"])
    rec = O.receipts(orders, users, pays, items, inv).collect()
    by_order = {}
    for r in rec:
        by_order.setdefault(r["id"], []).append(r)
    assert {r["mpesa_transaction"] for r in by_order[1]} == {"WV2"} and len(by_order[1]) == 2
    assert by_order[2][0]["mpesa_transaction"] is None and by_order[2][0]["item_key"] is None
    assert by_order[3][0]["full_name"] == "Bob"


def test_check_table_foreign_keys_and_product_deletes(spark):
    orders = spark.createDataFrame([(1, 5, Decimal("1"), "pending", "x", ts(9), ts(9))], SCHEMAS["orders"])
    pays = spark.createDataFrame([(1, 1, "WV1", "0712345678", Decimal("1"), "pending", None, None, ts(1), None),
                                  (2, 9, "WV2", "0712345678", Decimal("1"), "pending", None, None, ts(1), None),
                                  (3, 1, "WV3", "0712345678", Decimal("1"), "paid", None, None, ts(1), None)],
                                 SCHEMAS["payments"])
    good, bad = check_table(pays, "payments", parents={"orders": orders})
    assert [r["id"] for r in good.collect()] == [1]
    assert {r["id"]: r["reason"] for r in bad.collect()} == {
        2: "order_id has no orders.id", 3: "status not in pending/completed/failed"}
    inv = spark.createDataFrame([(1, "a", "d", Decimal("1"), 1, None, ts(9), ts(9)),
                                 (2, "b", "d", Decimal("1"), 1, None, ts(9), ts(9))], SCHEMAS["inventory"])
    sales = spark.createDataFrame([(1, 5, 1, 1, Decimal("1"), ts(2))], SCHEMAS["sales"])
    req = spark.createDataFrame([("d1", 1), ("d2", 2), ("d3", 99)], "request_id string, product_id long")
    out = CHG.apply_product_deletes(inv, sales, req)
    assert [r["id"] for r in out["inventory"].collect()] == [1]
    assert {r["request_id"]: r["message"] for r in out["rejects"].collect()} == {
        "d1": "Cannot delete product with sales history"}
    assert sorted(r["request_id"] for r in out["deleted"].collect()) == ["d2", "d3"]  # unknown id: a no-op


def test_sequence_ids_dense_in_order_with_a_hot_value(spark):
    from tillbook.core import sequence_ids
    from pyspark.sql import functions as F
    df = spark.range(20000).select(F.when(F.col("id") % 2 == 0, F.lit(7)).otherwise(F.col("id")).alias("k"),
                                   F.col("id").alias("tie"))
    out = sequence_ids(df, ["k", "tie"], 100, slices=8).collect()
    got = sorted((r["id"], r["k"], r["tie"]) for r in out)
    assert [g[0] for g in got] == list(range(101, 20101))
    assert [(g[1], g[2]) for g in got] == sorted((g[1], g[2]) for g in got)
