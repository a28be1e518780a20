"""SNK2: stored reports as a header table and a line table, each report visible whole or not at all.

Below one folder:

* ``ids/<id>``: taken ids (empty files made atomically, so two writers never share an id);
* ``lines/report=<id>``: one row a report line: its place in the report's order and its JSON;
* ``headers/report=<id>``: one row: the ``reports`` columns (id, title, type, data, generated_by, generated_at), the report's
  total and period where it has them, and the number of its lines;
* ``committed/<id>``: made last. Readers list these markers and read only the folders they name, so a report that is
  being written, or whose writer died, is never seen; its id is not used again.

The reference keeps a report as one JSON cell; a report of a large table does not fit a cell, so its lines are rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..core import sequence_ids, ts_lit
from ..functions.exprs import as_json, report_title
from ..sources.schemas import REPORT_TYPES
from .folders import Folder

MONEY_TOTAL = "decimal(38,2)"
HEADERS = ("id bigint, title string, type string, data string, generated_by bigint, generated_at timestamp_ntz, "
           f"total_revenue {MONEY_TOTAL}, period_start timestamp_ntz, period_end timestamp_ntz, n_lines bigint")
LINES = "id bigint, position bigint, data string"


@dataclass
class StoredReport:
    """What ``save_report`` stores: the lines, their order, and the total (a one-row table) and period if the report has them."""

    type: str
    lines: DataFrame
    order: list
    total: DataFrame | None = None
    start: object = None
    end: object = None


def _take_id(spark: SparkSession, path: str) -> int:
    taken = Folder(spark, f"{path}/ids")
    after = max((int(n) for n in taken.names() if n.isdigit()), default=0)
    while not taken.mark(f"{(after := after + 1):019d}"):
        pass
    return after


def save_report(report: StoredReport, author: int, as_of, path: str) -> int:
    """Store a report under a new id, which is returned once readers can see it."""
    if report.type not in REPORT_TYPES:
        raise ValueError(f"Invalid report type: {report.type}")
    spark, path = report.lines.sparkSession, path.rstrip("/")
    report_id = _take_id(spark, path)
    columns = report.lines.columns
    lines = sequence_ids(report.lines, report.order, 0, id_col="_position").select(
        F.col("_position").alias("position"), as_json(*columns).alias("data"))
    lines.write.mode("overwrite").parquet(f"{path}/lines/report={report_id}")
    n_lines = spark.read.parquet(f"{path}/lines/report={report_id}").agg(F.count(F.lit(1)).alias("n_lines"))
    when = lambda t: F.lit(None).cast("timestamp_ntz") if t is None else ts_lit(t)
    total = report.total if report.total is not None else spark.range(1).select(F.lit(None).alias("total_revenue"))
    header = (n_lines.withColumn("one", F.lit(1))
              .join(total.select(F.col("total_revenue").cast(MONEY_TOTAL), F.lit(1).alias("one")), "one")  # one row each
              .select(report_title(report.type, as_of).alias("title"), F.lit(report.type).alias("type"),
                      F.lit(int(author)).cast("long").alias("generated_by"), ts_lit(as_of).alias("generated_at"), "total_revenue",
                      when(report.start).alias("period_start"), when(report.end).alias("period_end"), "n_lines"))
    header = header.withColumn("data", F.when(F.col("total_revenue").isNotNull() | F.col("period_start").isNotNull(),
                                              as_json("total_revenue", "period_start", "period_end", "n_lines")))
    header.coalesce(1).write.mode("overwrite").parquet(f"{path}/headers/report={report_id}")
    Folder(spark, f"{path}/committed").mark(f"{report_id:019d}")
    return report_id


def _committed(spark: SparkSession, path: str, table: str, schema: str, report_ids=None) -> DataFrame:
    ids = [int(n) for n in Folder(spark, f"{path}/committed").names() if n.isdigit()]
    ids = ids if report_ids is None else sorted(set(ids) & set(report_ids))
    if not ids:
        return spark.createDataFrame([], schema)
    stored = schema.replace("id bigint, ", "", 1)
    rows = (spark.read.schema(f"{stored}, report bigint").option("basePath", f"{path}/{table}")
            .parquet(*[f"{path}/{table}/report={i}" for i in ids]))
    names = [c.split()[0] for c in schema.split(", ")]
    return rows.withColumn("id", F.col("report").cast("long")).select(*names)


def read_reports(spark: SparkSession, path: str, report_ids=None) -> DataFrame:
    """The headers of all stored reports, or of the given ids."""
    return _committed(spark, path.rstrip("/"), "headers", HEADERS, report_ids)


def read_report_lines(spark: SparkSession, path: str, report_ids=None) -> DataFrame:
    """id, position and JSON of the lines of all stored reports, or of the given ids; a report's lines are in its own folder."""
    return _committed(spark, path.rstrip("/"), "lines", LINES, report_ids)
