"""The registered queries: one entry per operator of the inventory, each (spark, sf_dir) -> DataFrame.

Every query reads the driver's tables through the adapters in
``tillbook.sources.tables`` and runs over the whole tables. ``tillbook.oracle_sql``
holds the matching DuckDB SQL under the same keys; column names and types are
aligned on both sides (money sums DECIMAL(38,2), counts BIGINT).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .core import scratch_path, sequence_ids
from .functions import exprs as X
from .functions.periods import export_period, in_dates, order_period, preset_period, report_period
from .operators import aggregates as A
from .operators import cart as CART
from .operators import changes as CHG
from .operators import joins as J
from .operators import payments as PAY
from .operators.filters import filter_orders, for_user, top_products
from .operators.purchases import apply_purchases
from .operators.rollup import SalesRollup
from .plans import kept_tables as KEPT
from .plans import orders as O
from .plans import reports as R
from .sinks import files as SNK
from .sinks import report_store as STORE
from .sinks.buckets import BucketTable, hash_bucket
from .sources import tables as TB
from .sources.schemas import REPORT_TYPES, check_table
from .streaming import jobs as STR

# Fixed parameters of the registered queries (order dates run 1995-01-01 .. 2001-08-01).
AS_OF = "2001-08-01 12:00:00"
CUSTOM_START, CUSTOM_END = "2001-07-01", "2001-07-15"
DASH_START, DASH_END = "2001-07-01", "2001-07-31"
FIL2_STATUS, FIL2_DATES = "processing", ("1998-01-01", "1998-12-31")
FIL1_ROLE = "BUILDING"

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(name: str):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn
    return deco


def _period_table(df: DataFrame, ts_col: str, amount_col: str, named: list[tuple[str, object, object, object]]) -> DataFrame:
    """One scan, conditional aggregates per named range, then one row per range."""
    aggs = []
    for i, (_, pred, _, _) in enumerate(named):
        aggs.append(F.count_if(pred).alias(f"n{i}"))
        aggs.append(F.coalesce(F.sum(F.when(pred, F.col(amount_col))), F.lit(0)).cast(J.SUM_MONEY).alias(f"r{i}"))
    wide = df.agg(*aggs)
    rows = [F.struct(F.lit(name).alias("period"), F.lit(lo).cast("string").alias("period_start"),
                     F.lit(hi).cast("string").alias("period_end"),
                     F.col(f"n{i}").alias("row_count"), F.col(f"r{i}").alias("amount"))
            for i, (name, _, lo, hi) in enumerate(named)]
    return wide.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def _fmt(t) -> str | None:
    return None if t is None else str(t)


# ---------------------------------------------------------------- sources and sinks

@query("src1_read_inventory")
def _src1(spark, sf):
    return TB.inventory(spark, sf)


@query("src2_check_tables")
def _src2(spark, sf):
    """Rule checks: users (role enum, unique email), payments and tracking (enums, unique keys, FK to
    orders) and the folded cart (unique line, FKs to users and products)."""
    users = TB.users(spark, sf)
    orders = TB.orders(spark, sf)
    checked = {
        "users": check_table(users, "users"),
        "payments": check_table(TB.payments(spark, sf), "payments", parents={"orders": orders}),
        "order_tracking": check_table(TB.order_tracking(spark, sf), "order_tracking", parents={"orders": orders}),
        "cart": check_table(CART.fold_cart(TB.cart_events(spark, sf))["cart"], "cart",
                            parents={"users": users, "inventory": TB.inventory(spark, sf)}),
    }
    return _outcomes(checked)


@query("src2_check_flawed_tables")
def _src2f(spark, sf):
    """Rule checks over tables in which every kind of rule is broken by some rows."""
    tables = TB.flawed_tables(spark, sf)
    parents = {"users": TB.users(spark, sf), "inventory": TB.inventory(spark, sf), "orders": TB.orders(spark, sf)}
    return _outcomes({name: check_table(df, name, parents=parents) for name, df in tables.items()})


def _outcomes(checked):
    parts = []
    for name, (good, bad) in checked.items():
        parts.append(good.select(F.lit(name).alias("table_name"), F.lit("ok").alias("outcome")))
        parts.append(bad.select(F.lit(name).alias("table_name"), F.col("reason").alias("outcome")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("table_name", "outcome").agg(F.count(F.lit(1)).alias("row_count"))


# ---------------------------------------------------------------- periods and filters

def _per1_ranges():
    out = []
    for name in ["today", "week", "month", "year", "custom"]:
        p = report_period(name, AS_OF, CUSTOM_START, CUSTOM_END)
        out.append((name, p.contains("transaction_date"), _fmt(p.start), _fmt(p.end)))
    return out


@query("per1_report_periods")
def _per1(spark, sf):
    return _period_table(TB.sales(spark, sf), "transaction_date", "total_amount", _per1_ranges())


@query("per2_export_periods")
def _per2(spark, sf):
    named = []
    for name in ["today", "week", "month", "year", "custom", "all"]:
        pred = export_period(name, AS_OF, CUSTOM_START, CUSTOM_END)("transaction_date")
        named.append((name, pred, None, None))
    return _period_table(TB.sales(spark, sf), "transaction_date", "total_amount", named)


@query("per3_preset_periods")
def _per3(spark, sf):
    named = []
    for name in ["Today", "Yesterday", "Last 7 Days", "Last 30 Days", "This Month", "Last Month"]:
        p = preset_period(name, AS_OF)
        named.append((name, p.contains("transaction_date"), _fmt(p.start), _fmt(p.end)))
    return _period_table(TB.sales(spark, sf), "transaction_date", "total_amount", named)


@query("per4_order_periods")
def _per4(spark, sf):
    named = []
    for name in ["today", "week", "month", "custom"]:
        d = order_period(name, AS_OF, CUSTOM_START, CUSTOM_END)
        named.append((name, in_dates("created_at", d), str(d[0]), str(d[1])))
    return _period_table(TB.orders(spark, sf), "created_at", "total_amount", named)


@query("per5_admin_default_period")
def _per5(spark, sf):
    d = order_period("admin_default", AS_OF)
    return _period_table(TB.orders(spark, sf), "created_at", "total_amount",
                         [("admin_default", in_dates("created_at", d), str(d[0]), str(d[1]))])


@query("fil1_for_user")
def _fil1(spark, sf):
    users = TB.users(spark, sf).where(F.col("role") == FIL1_ROLE)
    return for_user(TB.orders(spark, sf), users)


@query("fil2_filter_orders")
def _fil2(spark, sf):
    return filter_orders(TB.orders(spark, sf), FIL2_STATUS, FIL2_DATES)


@query("fil3_clean_phone")
def _fil3(spark, sf):
    u = TB.users(spark, sf)
    return u.select("id", "phone", X.clean_phone("phone").alias("digits"),
                    X.valid_signup_phone("phone").alias("valid"))


@query("fil4_payment_phone")
def _fil4(spark, sf):
    p = TB.payments(spark, sf)
    return p.select("id", "phone_number", X.valid_payment_phone("phone_number").alias("valid"))


# ---------------------------------------------------------------- joins

def _tables(spark, sf, *names):
    return [getattr(TB, n)(spark, sf) for n in names]


@query("join1_sales_detail")
def _join1(spark, sf):
    s, i, u = _tables(spark, sf, "sales", "inventory", "users")
    return J.sales_detail(s, i, u)


@query("join2_inventory_sales")
def _join2(spark, sf):
    i, s = _tables(spark, sf, "inventory", "sales")
    return J.inventory_with_sales(i, s)


@query("join3_inventory_sales_period")
def _join3(spark, sf):
    i, s = _tables(spark, sf, "inventory", "sales")
    return J.inventory_with_sales(i, s, export_period("month", AS_OF))


@query("join4_users_sales")
def _join4(spark, sf):
    u, s = _tables(spark, sf, "users", "sales")
    return J.users_with_sales(u, s)


@query("join5_users_sales_period")
def _join5(spark, sf):
    u, s = _tables(spark, sf, "users", "sales")
    return J.users_with_sales(u, s, export_period("year", AS_OF))


@query("join7_order_lines")
def _join7(spark, sf):
    it, i = _tables(spark, sf, "order_items", "inventory")
    return J.order_lines(it, i)


@query("join8_receipt_headers")
def _join8(spark, sf):
    o, u, p = _tables(spark, sf, "orders", "users", "payments")
    return J.receipt_headers(o, u, p)


@query("join9_deletable_products")
def _join9(spark, sf):
    """Every product after the product-change job (its adds have no sales yet) as a delete request."""
    inv = CHG.apply_product_changes(TB.inventory(spark, sf), TB.product_change_requests(spark, sf))["inventory"]
    requests = inv.select(F.col("id").alias("product_id"), "name")
    return J.deletable(requests, TB.sales(spark, sf))


# ---------------------------------------------------------------- aggregates and windows

def _detail(spark, sf):
    """All sales of all time with product and customer names."""
    s, i, u = _tables(spark, sf, "sales", "inventory", "users")
    return J.sales_detail(s, i, u)


def _known(spark, sf):
    """The same sales without the names."""
    s, i, u = _tables(spark, sf, "sales", "inventory", "users")
    return J.known_sales(s, i, u)


@query("agg1_sales_total")
def _agg1(spark, sf):
    return A.sales_total(_known(spark, sf))


@query("agg2_product_totals")
def _agg2(spark, sf):
    i, s = _tables(spark, sf, "inventory", "sales")
    return J.inventory_with_sales(i, s).select("id", "total_sales", "revenue")


@query("agg3_user_activity")
def _agg3(spark, sf):
    u, s = _tables(spark, sf, "users", "sales")
    return A.user_activity(u, s, AS_OF)


@query("agg4_user_period_totals")
def _agg4(spark, sf):
    u, s = _tables(spark, sf, "users", "sales")
    return J.users_with_sales(u, s, export_period("year", AS_OF)).select(
        "id", "total_purchases", "total_spent", "last_purchase")


@query("agg5_daily_sales")
def _agg5(spark, sf):
    return A.daily_sales(_known(spark, sf))


@query("agg6_units_by_product_name")
def _agg6(spark, sf):
    return A.units_by_product(_detail(spark, sf))


@query("agg7_role_distribution")
def _agg7(spark, sf):
    return A.role_distribution(TB.users(spark, sf))


@query("agg8_sales_kpis")
def _agg8(spark, sf):
    return A.sales_kpis(_known(spark, sf))


@query("agg9_inventory_kpis")
def _agg9(spark, sf):
    i, s = _tables(spark, sf, "inventory", "sales")
    return A.inventory_kpis(R.inventory_report(i, s, ordered=False))


@query("agg10_user_kpis")
def _agg10(spark, sf):
    u, s = _tables(spark, sf, "users", "sales")
    return A.user_kpis(A.user_activity(u, s, AS_OF))


@query("agg11_dashboard_cards")
def _agg11(spark, sf):
    s, i, u = _tables(spark, sf, "sales", "inventory", "users")
    return R.dashboard(s, i, u, DASH_START, DASH_END, AS_OF)["cards"]


@query("agg12_customer_order_stats")
def _agg12(spark, sf):
    o, t = _tables(spark, sf, "orders", "order_tracking")
    return A.order_stats(A.current_status(o, t))


@query("agg13_admin_order_stats")
def _agg13(spark, sf):
    o, t = _tables(spark, sf, "orders", "order_tracking")
    return A.admin_order_stats(A.current_status(o, t))


@query("agg15_order_history_nested")
def _agg15(spark, sf):
    o, it, t, i = _tables(spark, sf, "orders", "order_items", "order_tracking", "inventory")
    nested = O.nest_order_history(O.order_history(o, it, t, i, ordered=False), rows_per_chunk=3)
    entry = lambda part, label: lambda x: F.struct(F.lit(part).alias("part"), x["position"].alias("position"), x[label].alias("label"))
    entries = F.concat(F.transform("items", entry("item", "name")), F.transform("tracking", entry("tracking", "status")))
    return nested.select("id", "user_id", "current_status", "chunk", F.explode_outer(entries).alias("e")).select(
        "id", "user_id", "current_status", "chunk", "e.part", "e.position", "e.label")


@query("win1_current_status")
def _win1(spark, sf):
    o, t = _tables(spark, sf, "orders", "order_tracking")
    return A.current_status(o, t).select("id", "user_id", "status", "current_status")


# ---------------------------------------------------------------- sorts and top-k (positions checked)

def _positions(df: DataFrame, order: list, cols: list[str]) -> DataFrame:
    return sequence_ids(df.select(*cols), order, 0, id_col="position")


@query("srt1_sales_newest_first")
def _srt1(spark, sf):
    d = _detail(spark, sf)
    return _positions(d, R.newest_sales(d),
                      ["sale_key", "transaction_date", "total_amount"])


@query("srt2_products_by_name")
def _srt2(spark, sf):
    i, s = _tables(spark, sf, "inventory", "sales")
    rep = R.inventory_report(i, s, ordered=False)
    return _positions(rep, R.products_by_name(), ["id", "name"])


@query("srt2_users_by_name")
def _srt2u(spark, sf):
    u, s = _tables(spark, sf, "users", "sales")
    rep = R.user_activity_report(u, s, AS_OF, ordered=False)
    return _positions(rep, R.users_by_name(), ["id", "full_name"])


@query("srt3_products_by_revenue")
def _srt3(spark, sf):
    i, s = _tables(spark, sf, "inventory", "sales")
    rep = R.inventory_export(i, s, "month", AS_OF, ordered=False)
    return _positions(rep, R.by_revenue(), ["id", "revenue"])


@query("srt3_users_by_spend")
def _srt3u(spark, sf):
    u, s = _tables(spark, sf, "users", "sales")
    rep = R.user_activity_export(u, s, "year", AS_OF, ordered=False)
    return _positions(rep, R.by_spend(), ["id", "total_spent"])


@query("srt4_orders_newest_first")
def _srt4(spark, sf):
    o, it, t, i = _tables(spark, sf, "orders", "order_items", "order_tracking", "inventory")
    return _positions(O.order_history(o, it, t, i, ordered=False)["orders"], O.newest_orders(), ["id", "created_at"])


@query("srt4_tracking_newest_first")
def _srt4t(spark, sf):
    o, it, t, i = _tables(spark, sf, "orders", "order_items", "order_tracking", "inventory")
    return _positions(O.order_history(o, it, t, i, ordered=False)["tracking"], O.newest_tracking(), ["id", "order_id", "created_at"])


@query("top1_top_products")
def _top1(spark, sf):
    i, s = _tables(spark, sf, "inventory", "sales")
    return top_products(R.inventory_report(i, s, ordered=False)).select("id", "name", "total_sales")


# ---------------------------------------------------------------- scalar expressions

@query("exp1_subtotal")
def _exp1(spark, sf):
    it = TB.order_items(spark, sf)
    return it.select("item_key", "quantity", "price_per_unit", X.subtotal("quantity", "price_per_unit").alias("line_total"))


@query("exp2_stock_flag")
def _exp2(spark, sf):
    return TB.inventory(spark, sf).select("id", "quantity", X.stock_flag("quantity").alias("stock_flag"))


@query("exp3_stock_status")
def _exp3(spark, sf):
    s, = _tables(spark, sf, "sales")
    # stock left after all-time sales may run out: shows all three levels
    left = J.inventory_with_sales(TB.stocked_inventory(spark, sf), s)
    stock = (F.col("quantity") - F.col("total_sales")).cast("long")
    return left.select("id", stock.alias("stock_left"), X.stock_status(stock).alias("stock_status"))


@query("exp4_is_active")
def _exp4(spark, sf):
    u, s = _tables(spark, sf, "users", "sales")
    return J.users_with_sales(u, s).select("id", "last_purchase", X.is_active("last_purchase", AS_OF).alias("is_active"))


@query("exp5_customer_tier")
def _exp5(spark, sf):
    u, s = _tables(spark, sf, "users", "sales")
    return J.users_with_sales(u, s).select("id", "last_purchase", X.customer_tier("last_purchase", AS_OF).alias("tier"))


@query("exp6_null_to_zero")
def _exp6(spark, sf):
    i, s = _tables(spark, sf, "inventory", "sales")
    return J.inventory_with_sales(i, s, export_period("week", AS_OF)).select("id", "total_sales", "revenue")


@query("exp7_image_default")
def _exp7(spark, sf):
    return TB.inventory(spark, sf).select("id", "image", X.image_or_default("image").alias("shown_image"))


@query("exp8_status_label")
def _exp8(spark, sf):
    return TB.order_tracking(spark, sf).select("id", "status", X.status_label("status").alias("label"))


@query("exp9_money_text")
def _exp9(spark, sf):
    u, s = _tables(spark, sf, "users", "sales")
    return J.users_with_sales(u, s).select("id", "total_spent", X.money("total_spent").alias("shown"))


@query("exp10_report_title")
def _exp10(spark, sf):
    return A.sales_total(_known(spark, sf)).select(X.report_title("sales", AS_OF).alias("title"),
                                                          "total_revenue")


@query("exp11_day_label")
def _exp11(spark, sf):
    return A.daily_sales(_known(spark, sf)).select("day", X.day_label("day").alias("label"), "revenue")


@query("exp12_payment_ref")
def _exp12(spark, sf):
    return TB.orders(spark, sf).select("id", X.payment_ref("id", "created_at").alias("transaction_id"))


@query("exp13_json_text")
def _exp13(spark, sf):
    i, s = _tables(spark, sf, "inventory", "sales")
    rep = J.inventory_with_sales(i, s)
    return rep.select("id", X.as_json("id", "name", "image", "total_sales", "revenue").alias("data"))


# ---------------------------------------------------------------- composite reports

@query("rep1_sales_report")
def _rep1(spark, sf):
    s, i, u = _tables(spark, sf, "sales", "inventory", "users")
    return R.sales_report(s, i, u, "month", AS_OF).sales


@query("rep1_sales_report_total")
def _rep1t(spark, sf):
    s, i, u = _tables(spark, sf, "sales", "inventory", "users")
    return R.sales_report(s, i, u, "custom", AS_OF, CUSTOM_START, CUSTOM_END).total_revenue


@query("rep2_inventory_report")
def _rep2(spark, sf):
    i, s = _tables(spark, sf, "inventory", "sales")
    return R.inventory_report(i, s)


@query("rep3_user_activity_report")
def _rep3(spark, sf):
    u, s = _tables(spark, sf, "users", "sales")
    return R.user_activity_report(u, s, AS_OF)


@query("rep4_sales_export")
def _rep4(spark, sf):
    s, i, u = _tables(spark, sf, "sales", "inventory", "users")
    return R.sales_export(s, i, u, "month", AS_OF)


@query("rep5_inventory_export")
def _rep5(spark, sf):
    i, s = _tables(spark, sf, "inventory", "sales")
    return R.inventory_export(i, s, "month", AS_OF)


@query("rep6_user_activity_export")
def _rep6(spark, sf):
    u, s = _tables(spark, sf, "users", "sales")
    return R.user_activity_export(u, s, "year", AS_OF)


def _dash(spark, sf):
    s, i, u = _tables(spark, sf, "sales", "inventory", "users")
    return R.dashboard(s, i, u, DASH_START, DASH_END, AS_OF)


@query("rep7_dashboard_sales")
def _rep7s(spark, sf):
    return _dash(spark, sf)["sales"]


@query("rep7_dashboard_daily")
def _rep7d(spark, sf):
    return _dash(spark, sf)["daily"]


@query("rep7_dashboard_inventory")
def _rep7i(spark, sf):
    return _dash(spark, sf)["inventory"]


@query("rep7_dashboard_customers")
def _rep7c(spark, sf):
    return _dash(spark, sf)["customers"]


@query("rep7_dashboard_top_products")
def _rep7t(spark, sf):
    return _dash(spark, sf)["top_products"]


@query("rep8_order_history")
def _rep8(spark, sf):
    o, it, t, i = _tables(spark, sf, "orders", "order_items", "order_tracking", "inventory")
    h = O.order_history(o, it, t, i)
    return h["orders"].select("id", "user_id", "total_amount", "status", "created_at", "current_status")


@query("rep8_order_history_lines")
def _rep8l(spark, sf):
    o, it, t, i = _tables(spark, sf, "orders", "order_items", "order_tracking", "inventory")
    return O.order_history(o, it, t, i, ordered=False)["items"]


@query("rep9_receipts")
def _rep9(spark, sf):
    o, u, p, it, i = _tables(spark, sf, "orders", "users", "payments", "order_items", "inventory")
    return O.receipts(o, u, p, it, i).select("id", "user_id", "total_amount", "full_name", "email", "phone",
                                             "mpesa_transaction", "item_key", "product_id", "item_quantity",
                                             "price_per_unit", "subtotal", "name")


@query("rep10_admin_orders")
def _rep10(spark, sf):
    o, t, u = _tables(spark, sf, "orders", "order_tracking", "users")
    out = O.admin_orders(o, t, u, *_tables(spark, sf, "order_items", "inventory"), "all", order_period("admin_default", AS_OF))["orders"]
    return out.select("id", "user_id", "customer_name", "customer_phone", "status", "current_status", "created_at")


def _admin_in_transit(spark, sf):
    o, t, u, it, i = _tables(spark, sf, "orders", "order_tracking", "users", "order_items", "inventory")
    return O.admin_orders(o, t, u, it, i, "in_transit", ordered=False)


@query("rep10_admin_order_items")
def _rep10i(spark, sf):
    """The lines of all orders now in transit."""
    return _admin_in_transit(spark, sf)["items"]


@query("rep10_admin_order_tracking")
def _rep10t(spark, sf):
    """The timelines of all orders now in transit."""
    return _admin_in_transit(spark, sf)["tracking"]


@query("rep8_order_history_tracking")
def _rep8t(spark, sf):
    o, it, t, i = _tables(spark, sf, "orders", "order_items", "order_tracking", "inventory")
    return O.order_history(o, it, t, i)["tracking"]


def _receipt_requests(spark, sf):
    """Every order's receipt asked for, finished orders by the wrong customer."""
    return TB.payment_requests(spark, sf).select("order_id", "user_id")


@query("rep9_requested_receipts")
def _rep9q(spark, sf):
    o, u, p, it, i = _tables(spark, sf, "orders", "users", "payments", "order_items", "inventory")
    return O.receipts_for(_receipt_requests(spark, sf), o, u, p, it, i)["receipts"].select(
        "id", "user_id", "email", "mpesa_transaction", "item_key", "item_quantity", "subtotal", "name")


@query("rep9_receipt_rejects")
def _rep9r(spark, sf):
    o, u, p, it, i = _tables(spark, sf, "orders", "users", "payments", "order_items", "inventory")
    return O.receipts_for(_receipt_requests(spark, sf), o, u, p, it, i)["rejects"]


# ---------------------------------------------------------------- change jobs (whole request tables)


def _purchases(spark, sf):
    return apply_purchases(TB.uncounted_inventory(spark, sf), TB.purchase_requests(spark, sf))


@query("chg3_purchases_sales")
def _chg3s(spark, sf):
    return _purchases(spark, sf)["sales"]


@query("chg3_purchases_rejects")
def _chg3r(spark, sf):
    return _purchases(spark, sf)["rejects"]


@query("chg3_purchases_stock")
def _chg3i(spark, sf):
    return _purchases(spark, sf)["inventory"].select("id", "quantity")


def _cart(spark, sf):
    return CART.fold_cart(TB.cart_events(spark, sf))["cart"]


@query("chg4_fold_cart")
def _chg4(spark, sf):
    return _cart(spark, sf)


@query("join6_cart_lines")
def _join6(spark, sf):
    return J.cart_lines(_cart(spark, sf), TB.inventory(spark, sf))


@query("agg14_cart_totals")
def _agg14(spark, sf):
    return A.cart_totals(J.cart_lines(_cart(spark, sf), TB.inventory(spark, sf)))


def _checkout(spark, sf):
    return CART.checkout(_cart(spark, sf), TB.inventory(spark, sf), TB.checkout_requests(spark, sf),
                         orders=TB.orders(spark, sf), tracking=TB.order_tracking(spark, sf))


@query("chg5_checkout_orders")
def _chg5o(spark, sf):
    return _checkout(spark, sf)["orders"]


@query("chg5_checkout_items")
def _chg5i(spark, sf):
    return _checkout(spark, sf)["order_items"]


@query("chg5_checkout_tracking")
def _chg5t(spark, sf):
    return _checkout(spark, sf)["order_tracking"]


@query("chg5_checkout_rejects")
def _chg5r(spark, sf):
    return _checkout(spark, sf)["rejects"]


@query("chg5_cart_left")
def _chg5c(spark, sf):
    return _checkout(spark, sf)["cart"]


def _open_payments(spark, sf):
    return PAY.open_payments(TB.orders(spark, sf), TB.payment_requests(spark, sf), payments=TB.payments(spark, sf))


@query("chg6_open_payments")
def _chg6(spark, sf):
    return _open_payments(spark, sf)["payments"]


@query("chg6_payment_rejects")
def _chg6r(spark, sf):
    return _open_payments(spark, sf)["rejects"]


def _apply_payments(spark, sf):
    return PAY.apply_payments(TB.payments(spark, sf), TB.orders(spark, sf), TB.order_tracking(spark, sf),
                              TB.payment_confirmations(spark, sf))


@query("chg7_payments_updated")
def _chg7p(spark, sf):
    return _apply_payments(spark, sf)["payments"]


@query("chg7_tracking_added")
def _chg7t(spark, sf):
    return _apply_payments(spark, sf)["order_tracking"]


@query("chg7_rejects")
def _chg7r(spark, sf):
    return _apply_payments(spark, sf)["rejects"]


@query("join11_orders_paid")
def _join11(spark, sf):
    return _apply_payments(spark, sf)["orders"]


def _status_updates(spark, sf):
    return CHG.apply_status_updates(TB.orders(spark, sf), TB.order_tracking(spark, sf),
                                    TB.status_update_requests(spark, sf))


@query("chg8_orders_updated")
def _chg8o(spark, sf):
    return _status_updates(spark, sf)["orders"]


@query("chg8_tracking_added")
def _chg8t(spark, sf):
    return _status_updates(spark, sf)["order_tracking"]


@query("chg8_rejects")
def _chg8r(spark, sf):
    return _status_updates(spark, sf)["rejects"]


def _signups(spark, sf):
    return CHG.accept_signups(TB.users(spark, sf), TB.signup_requests(spark, sf))


@query("chg9_new_users")
def _chg9u(spark, sf):
    return _signups(spark, sf)["users"]


@query("chg9_signup_rejects")
def _chg9r(spark, sf):
    return _signups(spark, sf)["rejects"]


@query("join10_new_signup_emails")
def _join10(spark, sf):
    return _signups(spark, sf)["users"].select("email")


def _product_changes(spark, sf):
    return CHG.apply_product_changes(TB.inventory(spark, sf), TB.product_change_requests(spark, sf))


@query("chg1_product_changes")
def _chg1(spark, sf):
    return _product_changes(spark, sf)["inventory"]


@query("chg1_product_rejects")
def _chg1r(spark, sf):
    return _product_changes(spark, sf)["rejects"]


def _product_deletes(spark, sf):
    inv = _product_changes(spark, sf)["inventory"]
    requests = inv.select(F.concat(F.lit("del-"), F.col("id")).alias("request_id"), F.col("id").alias("product_id"))
    return CHG.apply_product_deletes(inv, TB.sales(spark, sf), requests)


@query("chg2_product_deletes")
def _chg2(spark, sf):
    return _product_deletes(spark, sf)["inventory"]


@query("chg2_delete_rejects")
def _chg2r(spark, sf):
    return _product_deletes(spark, sf)["rejects"]


# ---------------------------------------------------------------- change jobs and look-ups on tables kept in buckets

BUCKETS = 8


def _kept(spark, name, df, key):
    table = BucketTable(spark, scratch_path(spark, f"kept-{name}"), key, hash_bucket(BUCKETS))
    table.commit(df)
    return table


def _kept_products(spark, sf):
    kept = _kept(spark, "inventory", TB.inventory(spark, sf), "id")
    return kept, KEPT.change_products(kept, TB.product_change_requests(spark, sf), "batch-1")


@query("chg1_kept_products")
def _chg1k(spark, sf):
    return _kept_products(spark, sf)[0].read()


@query("chg1_kept_rejects")
def _chg1kr(spark, sf):
    return _kept_products(spark, sf)[1]


@query("chg2_kept_products")
def _chg2k(spark, sf):
    kept, _ = _kept_products(spark, sf)
    requests = kept.read().select(F.concat(F.lit("del-"), F.col("id")).alias("request_id"), F.col("id").alias("product_id"))
    KEPT.delete_products(kept, TB.sales(spark, sf), requests, "batch-2")
    return kept.read()


def _kept_orders(spark, sf):
    o, t = _tables(spark, sf, "orders", "order_tracking")
    return _kept(spark, "orders", o, "id"), _kept(spark, "tracking", t, "order_id")


def _kept_payments(spark, sf):
    orders, tracking = _kept_orders(spark, sf)
    payments = _kept(spark, "payments", TB.payments(spark, sf), "transaction_id")
    before = tracking.version().max_id
    KEPT.confirm_payments(payments, orders, tracking, TB.payment_confirmations(spark, sf), "batch-1")
    return payments, orders, tracking.read().where(F.col("id") > before)


@query("chg7_kept_payments")
def _chg7k(spark, sf):
    return _kept_payments(spark, sf)[0].read()


@query("chg7_kept_tracking")
def _chg7kt(spark, sf):
    """The tracking rows that the confirmations added."""
    return _kept_payments(spark, sf)[2]


@query("join11_kept_orders")
def _join11k(spark, sf):
    return _kept_payments(spark, sf)[1].read()


@query("chg8_kept_orders")
def _chg8k(spark, sf):
    orders, tracking = _kept_orders(spark, sf)
    KEPT.update_statuses(orders, tracking, TB.status_update_requests(spark, sf), "batch-1")
    return orders.read()


@query("chg8_kept_tracking")
def _chg8kt(spark, sf):
    """The tracking rows that the updates added."""
    orders, tracking = _kept_orders(spark, sf)
    before = tracking.version().max_id
    KEPT.update_statuses(orders, tracking, TB.status_update_requests(spark, sf), "batch-1")
    return tracking.read().where(F.col("id") > before)


def _one_role_history(spark, sf):
    """The order history of the users of one role, from lines and tracking kept by order."""
    o, it, t, i = _tables(spark, sf, "orders", "order_items", "order_tracking", "inventory")
    users = TB.users(spark, sf).where(F.col("role") == FIL1_ROLE)
    return KEPT.history_of(o, _kept(spark, "items", it, "order_id"), _kept(spark, "tracking", t, "order_id"), i, users, ordered=False)


@query("rep8_kept_history")
def _rep8k(spark, sf):
    return _one_role_history(spark, sf)["orders"].select("id", "user_id", "status", "current_status")


@query("rep8_kept_lines")
def _rep8kl(spark, sf):
    return _one_role_history(spark, sf)["items"]


@query("win1_kept_status")
def _win1k(spark, sf):
    """The current status of the orders created in one year."""
    o, t = _tables(spark, sf, "orders", "order_tracking")
    chosen = filter_orders(o, None, FIL2_DATES)
    return KEPT.status_of(chosen, _kept(spark, "tracking", t, "order_id")).select("id", "user_id", "status", "current_status")


# ---------------------------------------------------------------- day roll-ups


def _rollup(spark, sf):
    """The roll-up of all sales, its last month made again as after a day's load; it covers the days up to the one before AS_OF."""
    s = TB.sales(spark, sf)
    rollup = SalesRollup(spark, scratch_path(spark, "rollup"))
    rollup.refresh(s)
    rollup.refresh(s, spark.sql("SELECT DATE '2001-07-31' AS day"))
    return s, rollup, ("1995-01-01", "2001-07-31")


@query("agg2_rollup_products")
def _agg2r(spark, sf):
    """Units and revenue per product of a period with a part of a day at its start, merged from days."""
    s, rollup, covered = _rollup(spark, sf)
    return rollup.product_sales(s, covered, "2000-03-15 06:30:00", "2001-06-01 00:00:00")


@query("agg4_rollup_users")
def _agg4r(spark, sf):
    """Purchases and spend per user of the last year, open at its end."""
    s, rollup, covered = _rollup(spark, sf)
    return rollup.user_sales(s, covered, "2000-08-01")


@query("rep5_rollup_export")
def _rep5r(spark, sf):
    s, rollup, covered = _rollup(spark, sf)
    return R.inventory_export(TB.inventory(spark, sf), s, "month", AS_OF, rollup=rollup, covered=covered)


@query("rep6_rollup_export")
def _rep6r(spark, sf):
    s, rollup, covered = _rollup(spark, sf)
    return R.user_activity_export(TB.users(spark, sf), s, "year", AS_OF, rollup=rollup, covered=covered)


# ---------------------------------------------------------------- sinks (written, then read back)


@query("snk1_export_csv")
def _snk1(spark, sf):
    i, s = _tables(spark, sf, "inventory", "sales")
    path = SNK.export_csv(R.inventory_export(i, s, "month", AS_OF), "inventory", scratch_path(spark, "export"), AS_OF)
    return SNK.read_export(spark, path, "inventory")


def _all_tables(spark, sf):
    return {n: getattr(TB, n)(spark, sf) for n in ("sales", "inventory", "users")}


def _exported(report_type, date_range, single_file):
    def run(spark, sf):
        path = R.export_report(report_type, _all_tables(spark, sf), date_range, AS_OF, scratch_path(spark, "export"),
                               single_file=single_file)
        return SNK.read_export(spark, path, report_type)
    return run


# as folders of part files, and as one file each
query("snk1_export_sales")(_exported("sales", "month", False))
query("snk1_export_user_activity")(_exported("user_activity", "year", False))
query("snk1_one_file_sales")(_exported("sales", "month", True))
query("snk1_one_file_inventory")(_exported("inventory", "month", True))
query("snk1_one_file_user_activity")(_exported("user_activity", "year", True))


def _report_store(spark, sf):
    """All three on-screen reports made and stored by user 1."""
    path, tables = scratch_path(spark, "report-store"), _all_tables(spark, sf)
    for report_type in REPORT_TYPES:
        R.store_report(report_type, tables, "month", AS_OF, 1, path)
    return path


@query("snk2_stored_reports")
def _snk2h(spark, sf):
    """The headers of the stored reports that keep every rule of the reports table."""
    headers = STORE.read_reports(spark, _report_store(spark, sf))
    return check_table(headers, "reports", parents={"users": TB.users(spark, sf)})[0].drop("data")


REPORT_LINE = "sale_key STRING, name STRING, full_name STRING, total_amount DECIMAL(38,2), revenue DECIMAL(38,2), total_purchases BIGINT"


@query("snk2_stored_report_lines")
def _snk2l(spark, sf):
    """Every line of the stored reports: its place, what it is about and its figure."""
    lines = STORE.read_report_lines(spark, _report_store(spark, sf))
    d = lines.select("id", "position", F.from_json("data", REPORT_LINE).alias("d"))
    return d.select("id", "position", F.coalesce("d.sale_key", "d.name", "d.full_name").alias("label"),
                    F.coalesce("d.total_amount", "d.revenue", F.col("d.total_purchases").cast("decimal(38,2)")).alias("figure"))


SNAPSHOT_FIELDS = "id BIGINT, name STRING, total_sales BIGINT, revenue DECIMAL(38,2)"


@query("snk2_report_snapshot")
def _snk2(spark, sf):
    i, s = _tables(spark, sf, "inventory", "sales")
    report = J.inventory_with_sales(i, s).select("id", "name", "total_sales", "revenue")
    path = scratch_path(spark, "reports")
    SNK.save_snapshot(report, "inventory", 1, AS_OF, path)
    back = SNK.read_snapshots(spark, path)
    return back.select("report_id", "title", "type", "generated_by", "generated_at",
                       F.from_json("data", SNAPSHOT_FIELDS).alias("d")).select(
        "report_id", "title", "type", "generated_by", "generated_at", "d.*")


# ---------------------------------------------------------------- streaming (run to the end of the input)

def _events_path(sf):
    return f"{sf.rstrip('/')}/events.parquet"


@query("str1_daily_sales_stream")
def _str1(spark, sf):
    sc = STR.new_scratch(spark, "str1")
    sales = STR.sales_from_events(STR.event_stream(spark, _events_path(sf)))
    STR.run_append(STR.stream_daily_sales(sales, "1 day"), sc["out"], sc["checkpoint"])
    return spark.read.parquet(sc["out"])


@query("str1_accounted_days_stream")
def _str1a(spark, sf):
    """Every day with its sums and whether it is closed; nothing is late in one batch."""
    sc = STR.new_scratch(spark, "str1a")
    sales = STR.sales_from_events(STR.event_stream(spark, _events_path(sf)))
    STR.stream_daily_sales_accounted(sales, sc["root"], sc["checkpoint"])
    return STR.accounted_days(spark, sc["root"])


@query("str2_current_status_stream")
def _str2(spark, sf):
    sc = STR.new_scratch(spark, "str2")
    tracking = STR.tracking_from_events(STR.event_stream(spark, _events_path(sf)))
    STR.run_updates(STR.stream_current_status(tracking), sc["out"], sc["checkpoint"])
    return STR.latest_rows(spark, sc["out"], "order_id")


@query("str3_product_totals_stream")
def _str3(spark, sf):
    sc = STR.new_scratch(spark, "str3")
    sales = STR.sales_from_events(STR.event_stream(spark, _events_path(sf)))
    products = TB.inventory(spark, sf).select(F.col("id").alias("product_id"), "name")
    STR.run_updates(STR.stream_product_totals(sales), sc["out"], sc["checkpoint"])
    return (products.join(STR.latest_rows(spark, sc["out"], "product_id"), "product_id", "left")
            .withColumn("total_sales", F.coalesce("total_sales", F.lit(0).cast("long")))
            .withColumn("revenue", F.coalesce("revenue", F.lit(0).cast(J.SUM_MONEY))))


def _str4(spark, sf):
    sc = STR.new_scratch(spark, "str4")
    requests = STR.purchase_requests_from_events(STR.event_stream(spark, _events_path(sf)))
    STR.stream_apply_purchases(requests, TB.inventory(spark, sf), sc["root"], sc["checkpoint"])
    return sc["root"]


@query("str4_purchases_stream_sales")
def _str4s(spark, sf):
    root = _str4(spark, sf)
    return spark.read.option("basePath", f"{root}/sales").parquet(f"{root}/sales").drop("batch")


@query("str4_purchases_stream_stock")
def _str4i(spark, sf):
    return STR.latest_stock(spark, _str4(spark, sf)).select("id", "quantity")


@query("src1_read_table")
def _src1b(spark, sf):
    """A stored inventory table (declared schema) read back by read_table."""
    path = SNK.write_table(TB.inventory(spark, sf), "inventory", scratch_path(spark, "inventory"))
    return TB.read_table(spark, path, "inventory")
