"""Tables in buckets: what a batch writes and reads, commits, look-ups; day roll-ups against full scans."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from tillbook.operators import changes as CHG
from tillbook.operators import joins as J
from tillbook.operators import payments as PAY
from tillbook.operators.aggregates import current_status
from tillbook.operators.rollup import SalesRollup
from tillbook.plans import kept_tables as KEPT
from tillbook.plans import orders as O
from tillbook.sinks.buckets import BucketTable, hash_bucket, month_bucket
from tillbook.sources import tables as TB

REQUESTS = ("request_id string, action string, product_id long, name string, price decimal(10,2), quantity int, description string, "
            "image string, requested_at timestamp_ntz")


def same(a, b):
    cols = sorted(a.columns)
    key = lambda r: tuple((x is None, str(x)) for x in r)
    return sorted(a.columns) == sorted(b.columns) and sorted(map(key, a.select(cols).collect())) == sorted(map(key, b.select(cols).collect()))


def kept(spark, path, df, key, buckets=40):
    table = BucketTable(spark, path, key, hash_bucket(buckets))
    table.commit(df)
    return table


def change_requests(spark, updates, adds=2):
    from decimal import Decimal
    at = dt.datetime(2024, 3, 1)
    rows = [(f"u{i}", "update", i, f"new {i}", Decimal("3.00"), 5, "d", "", at) for i in updates]
    rows += [(f"a{k}", "add", None, f"add {k}", Decimal("1.00"), 1, "d", None, at) for k in range(adds)]
    return spark.createDataFrame(rows + [("x", "update", 10 ** 9, "none", Decimal("1.00"), 1, "d", None, at), ("n", None, None, None, None, None, None, None, at)], REQUESTS)


def test_a_batch_writes_only_its_buckets(spark, scratch):
    inventory = TB.inventory(spark, SF_SMALL)
    table = kept(spark, f"{scratch}/inventory", inventory, "id")
    assert len(table.version().parts) == 40 and same(table.read(), inventory)
    requests = change_requests(spark, [3, 77])
    full = CHG.apply_product_changes(inventory, requests)
    rejects = KEPT.change_products(table, requests, "b1")
    assert same(table.read(), full["inventory"]) and same(rejects, full["rejects"])
    written = [d for d in os.listdir(f"{scratch}/inventory/v=1") if d.startswith("bucket=")]
    touched = table.of(requests.where("action = 'update'"), "product_id")
    assert len(written) <= 5 and set(touched) & {int(w[7:]) for w in written}
    parts = table.version().parts
    assert all(parts[b] == [1] for b in table.of(requests.where("product_id in (3, 77)"), "product_id"))
    assert sum(vs == [0] for vs in parts.values()) >= 35  # the others are as they were
    # the same batch again changes nothing, another one does
    KEPT.change_products(table, requests, "b1")
    assert table.version().number == 1
    KEPT.change_products(table, change_requests(spark, [], adds=1), "b2")
    assert table.version().number == 2 and table.version().max_id == full["inventory"].agg(F.max("id")).first()[0] + 1


def test_unfinished_versions_and_second_writers(spark, scratch):
    rows = spark.range(100).select("id", (F.col("id") * 2).alias("v"))
    table = kept(spark, f"{scratch}/t", rows, "id", 4)
    os.makedirs(f"{scratch}/t/v=1/bucket=0")
    open(f"{scratch}/t/v=1/bucket=0/part-0.parquet", "wb").write(b"half written")
    os.makedirs(f"{scratch}/t/writers", exist_ok=True)
    open(f"{scratch}/t/writers/1", "w").close()
    assert same(table.read(), rows)
    with pytest.raises(RuntimeError):
        table.commit(rows.limit(0), [0])
    with pytest.raises(ValueError):
        table.forget(0)
    table.forget(1)
    emptied = table.commit(rows.limit(0), [0])
    assert 0 not in emptied.parts and same(table.read(), rows.where(F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(4)) != 0))
    with pytest.raises(ValueError):
        table.commit(rows.withColumn("w", F.lit(1)), [])
    for k in range(3):
        table.commit(spark.range(1000 + k, 1001 + k).select("id", F.lit(0).cast("long").alias("v")), [])
    before = table.read().count()
    assert table.compact(most=1) is not None and table.compact(most=1) is None
    assert table.read().count() == before and all(len(v) == 1 for v in table.version().parts.values())
    with pytest.raises(ValueError):
        BucketTable(spark, f"{scratch}/none", "id", hash_bucket(4)).read()


def test_empty_table_and_null_keys(spark, scratch):
    schema = "id long, v string"
    table = kept(spark, f"{scratch}/t", spark.createDataFrame([], schema), "id", 4)
    assert table.read().count() == 0 and table.read().columns == ["id", "v"] and table.version().max_id == 0
    table.commit(spark.createDataFrame([(None, "a"), (5, None)], schema), [])
    assert sorted(map(tuple, table.read().collect()), key=str) == sorted([(None, "a"), (5, None)], key=str)


def test_payments_and_statuses_equal_the_full_jobs(spark, scratch):
    o, t, p = (getattr(TB, n)(spark, SF_SMALL) for n in ("orders", "order_tracking", "payments"))
    confirmations = TB.payment_confirmations(spark, SF_SMALL).where("confirmation_id like '%7'")
    full = PAY.apply_payments(p, o, t, confirmations)
    tables = kept(spark, f"{scratch}/p", p, "transaction_id"), kept(spark, f"{scratch}/o", o, "id"), kept(spark, f"{scratch}/t", t, "order_id")
    rejects = KEPT.confirm_payments(*tables, confirmations, "b1")
    assert same(rejects, full["rejects"]) and same(tables[0].read(), full["payments"]) and same(tables[1].read(), full["orders"])
    assert same(tables[2].read(), t.unionByName(full["order_tracking"]))
    for table in tables:  # as after a failure between the commits: nothing is done twice
        assert table.version().number == 1
    KEPT.confirm_payments(*tables, confirmations, "b1")
    assert [table.version().number for table in tables] == [1, 1, 1]
    requests = TB.status_update_requests(spark, SF_SMALL)
    orders, log = tables[1].read(), tables[2].read()
    whole = CHG.apply_status_updates(orders, log, requests)
    assert same(KEPT.update_statuses(tables[1], tables[2], requests, "b2"), whole["rejects"])
    assert same(tables[1].read(), whole["orders"]) and same(tables[2].read(), log.unionByName(whole["order_tracking"]))


def test_look_ups_read_the_selected_buckets(spark, scratch):
    o, it, t, i = (getattr(TB, n)(spark, SF_SMALL) for n in ("orders", "order_items", "order_tracking", "inventory"))
    items, tracking = kept(spark, f"{scratch}/i", it, "order_id"), kept(spark, f"{scratch}/t", t, "order_id")
    user = o.groupBy("user_id").count().orderBy("count", "user_id").first()["user_id"]
    got = KEPT.history_of(o, items, tracking, i, user)
    full = O.order_history(o, it, t, i, user)
    assert all(same(got[k], full[k]) for k in full)
    chosen = o.where(F.col("user_id") == user)
    wanted = set(items.of(chosen, "id"))
    read = {int(f.split("bucket=")[1].split("/")[0]) for f in got["items"].inputFiles() if f"{scratch}/i/" in f}
    assert read and read <= wanted and len(wanted) < 40
    assert same(KEPT.status_of(chosen, tracking), current_status(chosen, t))


@pytest.fixture(scope="module")
def rolled(spark, tmp_path_factory):
    sales = TB.sales(spark, SF_SMALL).withColumn("transaction_date", F.col("transaction_date") + F.expr("make_dt_interval(0, CAST(quantity % 24 AS INT), 15)"))
    sales = spark.createDataFrame(sales.collect(), sales.schema)  # 6,000 rows, read once
    rollup = SalesRollup(spark, str(tmp_path_factory.mktemp("rollup")))
    rollup.refresh(sales)
    return sales, rollup


PERIODS = [(None, None), ("1996-01-01", "1996-02-01"), ("1996-01-01 00:00:01", "1996-02-01 23:59:59"), ("1997-05-05 10:00:00", "1997-05-05 12:00:00"),
           ("1997-05-05", "1997-05-06"), ("1997-05-05 06:00:00", "1997-05-07 18:00:00"), ("1990-01-01", "1991-01-01"), ("1999-12-31 23:00:00", None),
           (None, "1995-06-30 12:00:00"), ("2000-06-01", None), ("1998-01-01", "1997-01-01")]


@pytest.mark.parametrize("covered", [("1995-01-01", "2001-12-31"), ("1996-06-01", "1999-06-15")])
def test_rollup_equals_the_full_scan(spark, rolled, covered):
    sales, rollup = rolled
    for lo, hi in PERIODS:
        inside = sales.where((F.col("transaction_date") >= lo) if lo else F.lit(True)).where((F.col("transaction_date") < hi) if hi else F.lit(True))
        assert same(rollup.product_sales(sales, covered, lo, hi), J.product_sales(inside)), (lo, hi)
        assert same(rollup.user_sales(sales, covered, lo, hi), J.user_sales(inside)), (lo, hi)


def test_rollup_is_kept_up_to_date_by_month(spark, rolled, scratch):
    sales, _ = rolled
    early, late = sales.where("transaction_date < timestamp_ntz'1998-03-10 00:00:00'"), sales.where("transaction_date < timestamp_ntz'1998-05-01 00:00:00'")
    rollup = SalesRollup(spark, scratch)
    rollup.refresh(early)
    first = rollup.tables["product_id"].version()
    days = late.exceptAll(early).select(F.to_date("transaction_date").alias("day"))
    rollup.refresh(late, days)
    now = rollup.tables["product_id"].version()
    assert {m for m in now.parts if now.parts[m] != first.parts.get(m)} == {199803, 199804}
    assert same(rollup.product_sales(late, ("1995-01-01", "1998-04-30")), J.product_sales(late))


def test_rollup_period_reads_its_months_and_the_edge_days(spark, scratch):
    sales = TB.sales(spark, SF_SMALL)
    rollup = SalesRollup(spark, scratch)
    rollup.refresh(sales)
    out = rollup.product_sales(sales, ("1995-01-01", "2001-07-31"), "1997-02-03", "1997-04-01")
    files = out.inputFiles()
    assert files and all("/product_id/" in f for f in files)  # whole days: no raw sales at all
    assert {int(f.split("bucket=")[1].split("/")[0]) for f in files} <= {199702, 199703}
    edge = rollup.product_sales(sales, ("1995-01-01", "2001-07-31"), "1997-02-03 06:00:00", "1997-04-01")
    plan = edge._jdf.queryExecution().optimizedPlan().toString()  # raw sales of the first day's rest only
    assert "o_orderdate" in plan and "1997-02-03 06:00:00" in plan and "< 1997-02-04 00:00:00" in plan
