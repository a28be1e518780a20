"""Sinks: the report CSV export (SNK1) and stored report snapshots (SNK2, see also ``report_store``).

Both write with Spark's own writers, one part file per task; an export can be merged into one file afterwards.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..core import as_datetime, ts_lit
from ..functions.exprs import as_json, report_title
from ..sources.schemas import conform
from .folders import Folder

# The reference's CSV headers, by report type, in column order.
CSV_HEADERS = {
    "sales": ["Date", "Product", "Customer", "Quantity", "Total Amount"],
    "inventory": ["Product", "Description", "Current Stock", "Total Sales", "Revenue"],
    "user_activity": ["User", "Email", "Role", "Total Purchases", "Total Spent", "Last Purchase"],
}
# Columns of the export DataFrames (REP4-REP6) that fill those headers.
CSV_SOURCE = {
    "sales": ["transaction_date", "product_name", "customer_name", "quantity", "total_amount"],
    "inventory": ["name", "description", "current_stock", "total_sales", "revenue"],
    "user_activity": ["full_name", "email", "role", "total_purchases", "total_spent", "last_purchase"],
}
CSV_TYPES = {
    "sales": [T.TimestampNTZType(), T.StringType(), T.StringType(), T.IntegerType(), T.DecimalType(10, 2)],
    "inventory": [T.StringType(), T.StringType(), T.IntegerType(), T.LongType(), T.DecimalType(38, 2)],
    "user_activity": [T.StringType(), T.StringType(), T.StringType(), T.LongType(), T.DecimalType(38, 2),
                      T.TimestampNTZType()],
}
CSV_OPTIONS = {"header": "true", "escape": '"', "quote": '"', "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss"}


def export_name(report_type: str, as_of) -> str:
    """``<type>_report_<date>.csv`` (the folder holding the part files)."""
    return f"{report_type}_report_{as_datetime(as_of).strftime('%Y-%m-%d')}.csv"


def export_csv(df: DataFrame, report_type: str, out_dir: str, as_of, single_file: bool = False) -> str:
    """SNK1: write an export DataFrame under the reference's headers; returns the path.

    By default the path is a folder of part files, each with the header. With ``single_file`` it is one CSV file with one
    header: the tasks write parts as before (no ``coalesce(1)``), and the finished parts are then joined in their order,
    which is the order of a sorted export. The merge copies bytes one file after another, so it is for files someone downloads.
    """
    if report_type not in CSV_HEADERS:
        raise ValueError(f"Invalid report type: {report_type}")
    cols = [F.col(src).alias(dst) for src, dst in zip(CSV_SOURCE[report_type], CSV_HEADERS[report_type])]
    out = df.select(*cols)
    path = f"{out_dir.rstrip('/')}/{export_name(report_type, as_of)}"
    if not single_file:
        out.write.mode("overwrite").options(**CSV_OPTIONS).csv(path)
        return path
    parts = Folder(df.sparkSession, f"{path}.parts-{uuid.uuid4().hex[:8]}")
    out.write.options(**{**CSV_OPTIONS, "header": "false"}).csv(parts.path)
    parts.merge((",".join(out.columns) + "\n").encode(), "part-", path)
    parts.delete()
    return path


def read_export(spark: SparkSession, path: str, report_type: str) -> DataFrame:
    """Read an export back with its declared column types (multi-line quoted fields allowed)."""
    schema = T.StructType([T.StructField(h, t, True)
                           for h, t in zip(CSV_HEADERS[report_type], CSV_TYPES[report_type])])
    return spark.read.schema(schema).options(multiLine="true", **CSV_OPTIONS).csv(path)


SNAPSHOT_SCHEMA = T.StructType([
    T.StructField("report_id", T.StringType(), False), T.StructField("title", T.StringType(), False),
    T.StructField("type", T.StringType(), False), T.StructField("generated_by", T.LongType(), False),
    T.StructField("generated_at", T.TimestampNTZType(), True), T.StructField("data", T.StringType(), True),
])


def save_snapshot(report: DataFrame, report_type: str, author: int, as_of, path: str,
                  report_id: str | None = None) -> str:
    """SNK2: add a report to the snapshot table, one row per report line with its JSON.

    The reference stores the whole report as one JSON cell; a report of a large
    table does not fit one cell, so each line is its own row, tied together by
    ``report_id`` (default: type and time). Each report has its own folder, which a repeated save replaces.
    """
    if report_type not in CSV_HEADERS:
        raise ValueError(f"Invalid report type: {report_type}")
    rid = report_id or f"{report_type}-{as_datetime(as_of).strftime('%Y%m%d%H%M%S')}"
    rows = report.select(
        report_title(report_type, as_of).alias("title"),
        F.lit(report_type).alias("type"), F.lit(int(author)).cast("long").alias("generated_by"),
        ts_lit(as_of).alias("generated_at"), as_json(*report.columns).alias("data"))
    rows.write.mode("overwrite").parquet(f"{path.rstrip('/')}/report_id={rid}")
    return rid


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    fields = [f for f in SNAPSHOT_SCHEMA if f.name != "report_id"] + [SNAPSHOT_SCHEMA["report_id"]]
    return spark.read.schema(T.StructType(fields)).option("basePath", path).parquet(path).select(*SNAPSHOT_SCHEMA.names)


def write_table(df: DataFrame, name: str, path: str, partition_by: list[str] | None = None,
                mode: str = "overwrite") -> str:
    """Store a model table with its declared schema (``sources.schemas``), as a new snapshot.
    ``partition_by`` may name declared columns or extra columns of ``df`` (kept as they are)."""
    writer = conform(df, name, keep=partition_by).write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return path
