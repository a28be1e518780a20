"""Golden checks on the seed rows, worked out by hand."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tillbook.operators import aggregates as A
from tillbook.operators import joins as J
from tillbook.operators.filters import top_products
from tillbook.plans import reports as R
from tillbook.sources.seed import seed

AS_OF = "2024-05-15 10:00:00"


@pytest.fixture(scope="module")
def tables(spark):
    return seed(spark, AS_OF)


def test_sales_report_month_and_week(tables):
    month = R.sales_report(tables["sales"], tables["inventory"], tables["users"], "month", AS_OF)
    assert month.sales.count() == 10
    assert month.total_revenue.first()["total_revenue"] == Decimal("183.75")
    assert A.sales_kpis(month.sales).first()["active_products"] == 4
    week = R.sales_report(tables["sales"], tables["inventory"], tables["users"], "week", AS_OF)
    assert week.sales.count() == 7  # the row exactly 7 days back counts (midnight start)
    assert week.total_revenue.first()["total_revenue"] == Decimal("119.00")
    rows = week.sales.collect()
    assert [r["transaction_date"] for r in rows] == sorted((r["transaction_date"] for r in rows), reverse=True)
    assert {r["customer_name"] for r in rows} == {"Ada Finch", "Ben Cole"}


def test_units_and_revenue_per_product(tables):
    rep = {r["id"]: r for r in R.inventory_report(tables["inventory"], tables["sales"]).collect()}
    assert {k: (v["total_sales"], v["revenue"]) for k, v in rep.items()} == {
        1: (3, Decimal("37.50")), 2: (12, Decimal("75.00")), 3: (3, Decimal("24.00")), 4: (27, Decimal("47.25"))}
    assert {v["stock_flag"] for v in rep.values()} == {"In Stock"}
    names = [r["name"] for r in R.inventory_report(tables["inventory"], tables["sales"]).collect()]
    assert names == sorted(names, key=str.lower)


def test_user_activity_export_and_tiers(tables):
    out = {r["id"]: r for r in R.user_activity_export(tables["users"], tables["sales"], "all", AS_OF).collect()}
    assert (out[2]["total_purchases"], out[2]["total_spent"]) == (5, Decimal("84.25"))
    assert (out[3]["total_purchases"], out[3]["total_spent"]) == (5, Decimal("99.50"))
    for uid in (1, 4):
        assert (out[uid]["total_purchases"], out[uid]["total_spent"], out[uid]["last_purchase"]) == (0, Decimal("0.00"), None)
    order = [r["id"] for r in R.user_activity_export(tables["users"], tables["sales"], "all", AS_OF).collect()]
    assert order[:2] == [3, 2]
    act = {r["id"]: r for r in R.user_activity_report(tables["users"], tables["sales"], AS_OF).collect()}
    assert act[2]["is_active"] == 1 and act[3]["is_active"] == 1 and act[1]["is_active"] == 0
    dash = R.dashboard(tables["sales"], tables["inventory"], tables["users"], "2024-04-15", "2024-05-15", AS_OF)
    tiers = {r["id"]: r["tier"] for r in dash["customers"].collect()}
    assert tiers == {1: "Dormant", 2: "Active", 3: "Active", 4: "Dormant"}
    days = {r["id"]: r for r in J.users_with_sales(tables["users"], tables["sales"]).select(
        "id", F.timestamp_diff("DAY", "last_purchase", F.lit(AS_OF).cast("timestamp_ntz")).alias("d")).collect()}
    assert days[2]["d"] == 1 and days[3]["d"] == 2 and days[1]["d"] is None


def test_roles_and_top_products(tables):
    roles = {r["role"]: r["users"] for r in A.role_distribution(tables["users"]).collect()}
    assert roles == {"customer": 2, "admin": 1, "master_admin": 1}
    top = [r["id"] for r in top_products(R.inventory_report(tables["inventory"], tables["sales"], ordered=False)).collect()]
    assert top == [4, 2, 1, 3]


def test_dashboard_cards_and_daily(tables):
    dash = R.dashboard(tables["sales"], tables["inventory"], tables["users"], "2024-05-05", "2024-05-15", AS_OF)
    cards = dash["cards"].first()
    assert (cards["total_orders"], cards["active_products"], cards["active_customers"]) == (10, 4, 4)
    assert cards["total_sales"] == Decimal("183.75")
    daily = dash["daily"].collect()
    assert len(daily) == 10 and daily[0]["label"] == "May 5"
    assert [r["day"] for r in daily] == sorted(r["day"] for r in daily)


def test_report_dispatch_and_export(spark, tables, scratch):
    from tillbook.sinks.files import read_export
    rep = R.generate_report("sales", tables, "week", AS_OF)
    assert rep.sales.count() == 7
    assert R.generate_report("inventory", tables, "month", AS_OF).count() == 4
    with pytest.raises(ValueError):
        R.generate_report("all", tables, "month", AS_OF)
    path = R.export_report("user_activity", tables, "month", AS_OF, scratch)
    back = {r["User"]: r for r in read_export(spark, path, "user_activity").collect()}
    assert back["Ada Finch"]["Total Purchases"] == 5 and back["Ada Finch"]["Total Spent"] == Decimal("84.25")
    assert back["Site Owner"]["Last Purchase"] is None
    path = R.export_report("sales", tables, "today", AS_OF, scratch)
    assert read_export(spark, path, "sales").count() == 0  # nothing sold on as_of's own date
    with pytest.raises(ValueError):
        R.export_report("sales", tables, "custom", AS_OF, scratch, start="2024-05-01")
