"""Exports as one file and stored reports: order, headers, atomic visibility, ids."""

import datetime as dt
import os
from concurrent.futures import ThreadPoolExecutor
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from tillbook.plans import reports as R
from tillbook.sinks import files as SNK
from tillbook.sinks import report_store as STORE
from tillbook.sinks.folders import Folder
from tillbook.sources import tables as TB
from tillbook.sources.schemas import check_table

AS_OF = "2001-08-01 12:00:00"


@pytest.fixture(scope="module")
def tables(spark):
    return {n: getattr(TB, n)(spark, SF_SMALL) for n in ("sales", "inventory", "users")}


def test_one_file_holds_all_parts_in_order(spark, scratch):
    rows = spark.range(1000).select(
        F.timestamp_seconds(F.col("id")).cast("timestamp_ntz").alias("transaction_date"),
        F.when(F.col("id") % 7 == 0, F.lit('quoted "x", and\na line')).otherwise(F.concat(F.lit("p"), "id")).alias("product_name"),
        F.when(F.col("id") % 5 > 0, F.lit("é c")).alias("customer_name"), F.col("id").cast("int").alias("quantity"),
        F.lit("1.50").cast("decimal(10,2)").alias("total_amount")).repartitionByRange(7, F.col("quantity").desc())
    sorted_rows = rows.sortWithinPartitions(F.col("quantity").desc())
    assert sorted_rows.rdd.getNumPartitions() > 1
    path = SNK.export_csv(sorted_rows, "sales", scratch, AS_OF, single_file=True)
    assert os.path.isfile(path) and path.endswith("sales_report_2001-08-01.csv")
    text = open(path, encoding="utf-8", newline="").read()
    assert text.startswith("Date,Product,Customer,Quantity,Total Amount\n") and text.count("Total Amount") == 1
    back = SNK.read_export(spark, path, "sales").collect()
    assert [r["Quantity"] for r in back] == list(range(999, -1, -1))
    assert back[-1]["Product"] == 'quoted "x", and\na line' and back[-1]["Customer"] is None
    assert [n for n in os.listdir(scratch) if "parts" in n or "merging" in n] == []
    # an export of the same day takes the place of the file
    again = SNK.export_csv(rows.limit(0), "sales", scratch, AS_OF, single_file=True)
    assert again == path and open(path).read() == "Date,Product,Customer,Quantity,Total Amount\n"


def test_unfinished_parts_are_not_merged(spark, scratch):
    os.makedirs(f"{scratch}/parts")
    open(f"{scratch}/parts/part-0.csv", "w").write("half")
    with pytest.raises(ValueError):
        Folder(spark, f"{scratch}/parts").merge(b"", "part-", f"{scratch}/out.csv")
    assert not os.path.exists(f"{scratch}/out.csv")


def test_stored_reports_are_seen_whole_or_not_at_all(spark, scratch, tables):
    path = f"{scratch}/store"
    assert STORE.read_reports(spark, path).count() == 0 and STORE.read_report_lines(spark, path).count() == 0
    first = R.store_report("sales", tables, "custom", AS_OF, 7, path, "2001-01-01", "2001-06-30")
    second = R.store_report("sales", tables, "custom", AS_OF, 7, path, "2001-01-01", "2001-06-30")  # the same second, its own id
    third = R.store_report("user_activity", tables, "month", AS_OF, 8, path)
    assert (first, second, third) == (1, 2, 3)
    report = R.sales_report(tables["sales"], tables["inventory"], tables["users"], "custom", AS_OF, "2001-01-01", "2001-06-30")
    total = report.total_revenue.first()[0]
    heads = {r["id"]: r for r in STORE.read_reports(spark, path).collect()}
    assert heads[1]["total_revenue"] == total and heads[1]["n_lines"] == report.sales.count() > 0
    assert heads[1]["period_start"] == dt.datetime(2001, 1, 1) and heads[1]["period_end"] == dt.datetime(2001, 6, 30, 23, 59, 59)
    assert heads[3]["total_revenue"] is None and heads[3]["data"] is None and heads[3]["generated_by"] == 8
    keys = [r["sale_key"] for r in report.sales.collect()]
    lines = (STORE.read_report_lines(spark, path, [1]).orderBy("position")
             .select("id", "position", F.get_json_object("data", "$.sale_key").alias("k")).collect())
    assert [r["k"] for r in lines] == keys and [r["position"] for r in lines] == list(range(1, len(keys) + 1))
    good, bad = check_table(STORE.read_reports(spark, path), "reports")
    assert good.count() == 3 and bad.count() == 0
    # a writer that died before its marker: everything is there but the marker
    os.remove(f"{path}/committed/{2:019d}")
    assert sorted(r["id"] for r in STORE.read_reports(spark, path).collect()) == [1, 3]
    assert {r["id"] for r in STORE.read_report_lines(spark, path).select("id").distinct().collect()} == {1, 3}
    assert R.store_report("inventory", tables, "month", AS_OF, 7, path) == 4  # a taken id is not used again


def test_ids_are_unique_among_writers(spark, scratch):
    with ThreadPoolExecutor(6) as pool:
        ids = list(pool.map(lambda _: STORE._take_id(spark, scratch), range(18)))
    assert sorted(ids) == list(range(1, 19))


def test_empty_and_unknown_reports(spark, scratch, tables):
    rid = R.store_report("sales", tables, "custom", AS_OF, 1, scratch, "1900-01-01", "1900-01-02")
    head = STORE.read_reports(spark, scratch).first()
    assert head["id"] == rid and head["n_lines"] == 0 and head["total_revenue"] == Decimal("0.00")
    assert STORE.read_report_lines(spark, scratch).count() == 0
    with pytest.raises(ValueError):
        R.store_report("profit", tables, "month", AS_OF, 1, scratch)
