"""Streaming jobs: several micro-batches give the batch result, a restart replays nothing,
and rows behind the watermark are dropped."""

import datetime as dt
import os
import re
from decimal import Decimal
import shutil
import time

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from tillbook.operators.aggregates import daily_sales
from tillbook.operators.purchases import apply_purchases
from tillbook.sources import tables as TB
from tillbook.streaming import jobs as STR


@pytest.fixture(scope="module")
def event_files(tmp_path_factory):
    """The sf0.001 events split into three time-ordered files (written in that order)."""
    folder = tmp_path_factory.mktemp("events")
    table = pq.read_table(os.path.join(SF_SMALL, "events.parquet")).sort_by("ts")
    n = table.num_rows
    cuts = [0, n // 3, 2 * n // 3, n]
    for i in range(3):
        pq.write_table(table.slice(cuts[i], cuts[i + 1] - cuts[i]), os.path.join(folder, f"part-{i}.parquet"))
        time.sleep(1.1)
    return str(folder), table


def test_purchases_stream_in_batches_equals_batch_fold(spark, event_files, scratch):
    folder, _ = event_files
    inventory = TB.inventory(spark, SF_SMALL)
    requests = STR.purchase_requests_from_events(STR.event_stream(spark, folder, max_files_per_trigger=1))
    STR.stream_apply_purchases(requests, inventory, scratch)
    batches = sorted(os.listdir(os.path.join(scratch, "stock")))
    assert len(batches) == 3
    streamed = spark.read.option("basePath", f"{scratch}/sales").parquet(f"{scratch}/sales").drop("batch")
    batch = apply_purchases(inventory, STR.purchase_requests_from_events(spark.read.parquet(folder)))
    assert sorted(map(tuple, streamed.collect())) == sorted(map(tuple, batch["sales"].collect()))
    stock = {r["id"]: r["quantity"] for r in STR.latest_stock(spark, scratch).collect()}
    assert stock == {r["id"]: r["quantity"] for r in batch["inventory"].collect()}
    # a restart from the same checkpoint has nothing left to do and changes nothing
    STR.stream_apply_purchases(STR.purchase_requests_from_events(STR.event_stream(spark, folder, 1)),
                               inventory, scratch)
    assert sorted(os.listdir(os.path.join(scratch, "stock"))) == batches


def test_daily_stream_closes_days_and_drops_late_rows(spark, event_files, scratch):
    folder, table = event_files
    # a fourth file, written last, holding rows from the first day: behind the watermark by then
    late = table.slice(0, 50)
    pq.write_table(late, os.path.join(folder, "part-9-late.parquet"))
    try:
        sales = STR.sales_from_events(STR.event_stream(spark, folder, max_files_per_trigger=1))
        STR.run_append(STR.stream_daily_sales(sales, "1 day"), f"{scratch}/out", f"{scratch}/ckpt")
        got = {r["day"]: (r["revenue"], r["sales"]) for r in spark.read.parquet(f"{scratch}/out").collect()}
    finally:
        os.remove(os.path.join(folder, "part-9-late.parquet"))
    on_time = STR.sales_from_events(spark.read.parquet(*[os.path.join(folder, f"part-{i}.parquet") for i in range(3)]))
    last = on_time.agg(F.max("transaction_date")).first()[0]
    expected = {r["day"]: r["revenue"] for r in daily_sales(on_time.withColumn("product_name", F.lit("x"))).collect()}
    closed = {d: v for d, v in expected.items() if (d.toordinal() + 1) * 86400 <= last.toordinal() * 86400
              + last.hour * 3600 + last.minute * 60 + last.second - 86400}
    assert {d: v[0] for d, v in got.items()} == closed


def test_current_status_stream_equals_batch(spark, scratch):
    events_path = os.path.join(SF_SMALL, "events.parquet")
    tracking = STR.tracking_from_events(STR.event_stream(spark, events_path))
    STR.run_updates(STR.stream_current_status(tracking), f"{scratch}/out", f"{scratch}/ckpt")
    got = {r["order_id"]: r["current_status"] for r in STR.latest_rows(spark, f"{scratch}/out", "order_id").collect()}
    batch = STR.stream_current_status(STR.tracking_from_events(spark.read.parquet(events_path)))
    assert got == {r["order_id"]: r["current_status"] for r in batch.collect()}


def test_update_mode_over_several_batches_keeps_the_newest_row(spark, event_files, scratch):
    folder, _ = event_files
    tracking = STR.tracking_from_events(STR.event_stream(spark, folder, max_files_per_trigger=1))
    STR.run_updates(STR.stream_current_status(tracking), f"{scratch}/out", f"{scratch}/ckpt")
    assert len([d for d in os.listdir(f"{scratch}/out") if d.startswith("batch=")]) == 3
    got = {r["order_id"]: r["current_status"] for r in STR.latest_rows(spark, f"{scratch}/out", "order_id").collect()}
    batch = STR.stream_current_status(STR.tracking_from_events(spark.read.parquet(folder)))
    assert got == {r["order_id"]: r["current_status"] for r in batch.collect()}


def test_product_totals_stream_in_batches_equals_batch(spark, event_files, scratch):
    folder, _ = event_files
    sales = STR.sales_from_events(STR.event_stream(spark, folder, max_files_per_trigger=1))
    STR.run_updates(STR.stream_product_totals(sales), f"{scratch}/out", f"{scratch}/ckpt")
    got = {r["product_id"]: (r["total_sales"], r["revenue"])
           for r in STR.latest_rows(spark, f"{scratch}/out", "product_id").collect()}
    batch = STR.stream_product_totals(STR.sales_from_events(spark.read.parquet(folder)))
    assert got == {r["product_id"]: (r["total_sales"], r["revenue"]) for r in batch.collect()}


def test_compaction_bounds_what_readers_scan(spark, scratch):
    """Twelve batches in two runs with a restart: snapshots at every fifth, the reader starts from the last."""
    events = spark.read.parquet(os.path.join(SF_SMALL, "events.parquet")).orderBy("ts").toPandas()
    folder = f"{scratch}/in"
    os.makedirs(folder)
    for run in range(2):
        for i in range(6):
            k = run * 6 + i
            part = events.iloc[k * len(events) // 12:(k + 1) * len(events) // 12]
            spark.createDataFrame(part, STR.EVENTS_SCHEMA).coalesce(1).write.parquet(f"{scratch}/tmp{k}")
            name = [f for f in os.listdir(f"{scratch}/tmp{k}") if f.endswith(".parquet")][0]
            shutil.copy(f"{scratch}/tmp{k}/{name}", f"{folder}/part-{k:02}.parquet")
        stream = STR.event_stream(spark, folder, max_files_per_trigger=1)
        STR.run_updates(STR.stream_current_status(STR.tracking_from_events(stream)), f"{scratch}/out", f"{scratch}/ckpt",
                        key="order_id", compact_every=5)
    assert STR.finished_batches(spark, f"{scratch}/out") == list(range(12))
    assert STR.finished_batches(spark, f"{scratch}/out/_compact", "upto=") == [4, 9]
    latest = STR.latest_rows(spark, f"{scratch}/out", "order_id")
    assert not [f for f in latest.inputFiles() if "/batch=9/" in f or "/batch=0/" in f]
    got = {r["order_id"]: r["current_status"] for r in latest.collect()}
    batch = STR.stream_current_status(STR.tracking_from_events(spark.read.parquet(os.path.join(SF_SMALL, "events.parquet"))))
    assert got == {r["order_id"]: r["current_status"] for r in batch.collect()}


def test_stock_of_a_damaged_batch_is_an_error(spark, scratch):
    inventory = spark.createDataFrame([(1, "a", Decimal("2.00"), 60)], "id long, name string, price decimal(10,2), quantity int")
    rows = spark.range(1).coalesce(1).selectExpr("id AS request_id", "1L AS user_id", "1L AS product_id", "5 AS quantity", "timestamp_ntz'2024-01-01 00:00:00' AS requested_at")
    for k in range(2):
        rows.write.mode("append").parquet(f"{scratch}/in")
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", "1").parquet(f"{scratch}/in")
        if k:
            for name in os.listdir(f"{scratch}/state/stock/batch=0"):
                if name.endswith(".parquet"):
                    with open(f"{scratch}/state/stock/batch=0/{name}", "wb") as f:
                        f.write(b"damaged")
                    if os.path.exists(f"{scratch}/state/stock/batch=0/.{name}.crc"):
                        with open(f"{scratch}/state/stock/batch=0/.{name}.crc", "wb") as f:
                            f.write(b"damaged")
            with pytest.raises(Exception):
                STR.stream_apply_purchases(stream, inventory, f"{scratch}/state")
        else:
            STR.stream_apply_purchases(stream, inventory, f"{scratch}/state")
            assert STR.latest_stock(spark, f"{scratch}/state").first()["quantity"] == 55


def _request_batches(spark, folder, sizes, products=40, first=0):
    """One parquet file of requests per micro-batch; batch k asks for products around k only."""
    schema = "request_id long, user_id long, product_id long, quantity int, requested_at timestamp_ntz"
    k0 = len(os.listdir(folder)) if os.path.isdir(folder) else 0
    os.makedirs(folder, exist_ok=True)
    rows, rid = [], first
    for k, n in enumerate(sizes, start=k0):
        part = [(rid + i, 1, (3 * k + i % 5) % products, 1 + (rid + i) % 6, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=rid + i)) for i in range(n)]
        rid += n
        rows += part
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{folder}-tmp{k}")
        name = [f for f in os.listdir(f"{folder}-tmp{k}") if f.endswith(".parquet")][0]
        shutil.copy(f"{folder}-tmp{k}/{name}", f"{folder}/part-{k:03}.parquet")
        stamp = 1_700_000_000 + k
        os.utime(f"{folder}/part-{k:03}.parquet", (stamp, stamp))
    return schema, rows, rid


def _stream(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", "1").parquet(folder)


def test_stock_state_over_ten_batches_with_a_restart_and_an_unfinished_batch(spark, scratch):
    n_products = 4000
    inventory = spark.range(n_products).select("id", F.concat(F.lit("p"), "id").alias("name"), F.lit("2.00").cast("decimal(10,2)").alias("price"),
                                               (F.lit(20) + F.col("id") % 9).cast("int").alias("quantity"))
    folder, state = f"{scratch}/in", f"{scratch}/state"
    schema, rows, rid = _request_batches(spark, folder, [12] * 6, n_products)
    STR.stream_apply_purchases(_stream(spark, folder, schema), inventory, state, compact_every=4, buckets=16)
    assert STR.StockState(spark, state).bases() == [-1, 3]
    # an unfinished writer leaves a folder without _SUCCESS: it must not be read
    os.makedirs(f"{state}/stock/batch=99")
    open(f"{state}/stock/batch=99/part-0.parquet", "wb").write(b"half written")
    _, more, _ = _request_batches(spark, folder, [12] * 4, n_products, first=rid)
    other = inventory.withColumn("quantity", F.lit(0))  # ignored: the state already has a base
    STR.stream_apply_purchases(_stream(spark, folder, schema), other, state, compact_every=4, buckets=16)
    assert STR.finished_batches(spark, f"{state}/stock") == list(range(10))
    whole = apply_purchases(inventory, spark.createDataFrame(rows + more, schema))
    expected = {r["id"]: r["quantity"] for r in whole["inventory"].collect()}
    assert {r["id"]: r["quantity"] for r in STR.latest_stock(spark, state).collect()} == expected
    # a batch writes its own products only
    for k in range(10):
        assert spark.read.parquet(f"{state}/stock/batch={k}").count() <= 5
    # and reads only their buckets of the base
    asked = spark.createDataFrame([(7,), (8,)], "product_id long")
    one = STR.StockState(spark, state).before(10, asked)
    assert {r["id"]: r["quantity"] for r in one.collect()} == {k: expected[k] for k in (7, 8)}
    pruned = re.findall(r"PartitionFilters: \[([^\]]*bucket[^\]]*)\]", one._jdf.queryExecution().executedPlan().toString())
    assert pruned and all("bucket" in f for f in pruned)


def test_readers_of_an_empty_state(spark, scratch):
    with pytest.raises(ValueError):
        STR.latest_stock(spark, f"{scratch}/none")
    empty = STR.latest_rows(spark, f"{scratch}/none", "order_id", schema="order_id long, current_status string")
    assert empty.count() == 0 and empty.columns == ["order_id", "current_status"]
    assert STR.latest_rows(spark, f"{scratch}/none", "order_id").columns == ["order_id"]


def test_late_rows_are_accounted_for(spark, event_files, scratch):
    """Closed days, open days and late rows together are all rows; a restart and a compaction change nothing."""
    folder, table = event_files
    late = table.slice(0, 50)
    pq.write_table(late, os.path.join(folder, "part-9-late.parquet"))
    try:
        def run():
            sales = STR.sales_from_events(STR.event_stream(spark, folder, max_files_per_trigger=1))
            STR.stream_daily_sales_accounted(sales, scratch, compact_every=2)
        run()
        run()
        everything = STR.sales_from_events(spark.read.parquet(folder))
        all_rows, on_time = everything.count(), STR.sales_from_events(spark.read.parquet(*[os.path.join(folder, f"part-{i}.parquet") for i in range(3)]))
        n_late = STR.sales_from_events(spark.read.parquet(os.path.join(folder, "part-9-late.parquet"))).count()
    finally:
        os.remove(os.path.join(folder, "part-9-late.parquet"))
    days, behind = STR.accounted_days(spark, scratch), STR.late_rows(spark, scratch)
    assert behind.count() == n_late > 0 and {r["batch"] for r in behind.select("batch").distinct().collect()} == {3}
    assert days.agg(F.sum("sales")).first()[0] + behind.count() == all_rows
    assert {r["closed"] for r in days.collect()} == {True, False}
    expected = {r["day"]: r["revenue"] for r in daily_sales(on_time.withColumn("product_name", F.lit("x"))).collect()}
    assert {r["day"]: r["revenue"] for r in days.collect()} == expected
    assert STR.finished_batches(spark, f"{scratch}/_days", "upto=") == [1, 3]
    # the closed days are those that the append-mode stream gives
    out = f"{scratch}/append"
    pq.write_table(late, os.path.join(folder, "part-9-late.parquet"))
    try:
        STR.run_append(STR.stream_daily_sales(STR.sales_from_events(STR.event_stream(spark, folder, 1)), "1 day"), out, f"{scratch}/append-ckpt")
    finally:
        os.remove(os.path.join(folder, "part-9-late.parquet"))
    assert {tuple(r) for r in days.where("closed").select("day", "revenue", "sales").collect()} == {tuple(r) for r in spark.read.parquet(out).collect()}
