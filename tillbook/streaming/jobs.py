"""Structured Streaming jobs STR1-STR4, re-aimed from the reference's append-only tables.

* STR1 daily revenue: event-time watermark + 1-day tumbling window, append mode;
  a day is emitted once the watermark passes its end, rows behind it are dropped. ``stream_daily_sales_accounted`` keeps
  the rows behind the watermark as a table of their own, and shows open days.
* STR2 current status per order: streaming max_by over (created_at, id) in update
  mode; each micro-batch writes only the orders it changed, under its batch id.
* STR3 units and revenue per product: streaming sums in update mode, written the
  same way; the product table is joined when the result is read.
* STR4 stock run-down: foreachBatch runs the batch purchase fold (CHG3) on each
  micro-batch against the stock of its own products. Outputs go to
  folders named by batch id, so a replayed batch rewrites the same files; only changed products
  are written, and read back through key buckets.

Sources are file streams over parquet; sinks are files under the shared
checkpoint folder. Nothing is collected to the driver.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..core import cut_lineage, scratch_path, ts_lit
from ..operators.joins import SUM_MONEY
from ..operators.purchases import apply_purchases
from ..sources.schemas import MONEY
from ..sources.tables import TRACKING_FROM_EVENT, _case, event_product

EVENTS_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType()),
])


def event_stream(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """File stream of event parquet files. ``path`` is a folder, or one file (then its folder is
    watched with a name filter, since a file source watches folders)."""
    reader = spark.readStream.schema(EVENTS_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    if path.endswith(".parquet"):
        folder, name = path.rstrip("/").rsplit("/", 1)
        return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.parquet(path)


def sales_from_events(events: DataFrame) -> DataFrame:
    """Purchase events as sales rows (works on a batch or a streaming DataFrame)."""
    return events.where(F.col("event_type") == "purchase").select(
        F.col("event_id").alias("sale_id"), F.col("user_id"),
        event_product().alias("product_id"),
        (F.lit(1) + F.floor("value").cast("long") % 9).cast("int").alias("quantity"),
        F.col("value").cast(MONEY).alias("total_amount"), F.col("ts").alias("transaction_date"))


def tracking_from_events(events: DataFrame) -> DataFrame:
    """Events as tracking rows (the same mapping as the batch adapter)."""
    return events.select(F.col("event_id").alias("id"), F.col("user_id").alias("order_id"),
                         _case("event_type", TRACKING_FROM_EVENT).alias("status"), F.col("ts").alias("created_at"))


def purchase_requests_from_events(events: DataFrame) -> DataFrame:
    """Every event as a purchase request of its product and 1-9 units."""
    return events.select(
        F.col("event_id").alias("request_id"), F.col("user_id"),
        event_product().alias("product_id"),
        (F.lit(1) + F.floor("value").cast("long") % 9).cast("int").alias("quantity"),
        F.col("ts").alias("requested_at"))


def event_time(col: str) -> F.Column:
    """TIMESTAMP_NTZ -> TIMESTAMP with the wall clock read as UTC, whatever the session zone."""
    return F.timestamp_seconds(F.unix_timestamp(F.col(col)))


def stream_daily_sales(sales: DataFrame, delay: str = "1 day") -> DataFrame:
    """STR1: revenue per calendar day from a sales stream (append mode)."""
    timed = sales.withColumn("_et", event_time("transaction_date")).withWatermark("_et", delay)
    agg = timed.groupBy(F.window("_et", "1 day").alias("w")).agg(
        F.sum("total_amount").cast(SUM_MONEY).alias("revenue"), F.count(F.lit(1)).alias("sales"))
    return agg.select(F.date_from_unix_date((F.unix_seconds(F.col("w.start")) / 86400).cast("int")).alias("day"),
                      "revenue", "sales")


DAYS = "day date, revenue decimal(38,2), sales bigint"


def stream_daily_sales_accounted(sales: DataFrame, state_dir: str, checkpoint: str | None = None, delay: dt.timedelta = dt.timedelta(days=1),
                                 compact_every: int = 20) -> None:
    """STR1 with nothing dropped: every row ends in a day's sums or in the late rows.

    The watermark of a batch is the latest sale of the batches before it less ``delay``, as in ``stream_daily_sales``. Rows of
    days that it has passed go to ``late/batch=<n>`` as they are; the others are summed by day into ``days/batch=<n>``.
    ``marks/batch=<n>``, one row with the latest sale so far, is written last and makes the batch count.
    Every ``compact_every``-th batch sums the days so far into ``_days/upto=<n>``. All folders are overwritten by a replay.
    """
    spark, base = sales.sparkSession, state_dir.rstrip("/")

    def fold(batch: DataFrame, batch_id: int) -> None:
        before = watermark(spark, base, delay, batch_id)
        end = F.date_add(F.to_date("transaction_date"), 1).cast("timestamp_ntz")
        is_late = F.lit(False) if before is None else F.coalesce(end <= ts_lit(before), F.lit(False))
        batch.where(is_late).write.mode("overwrite").parquet(f"{base}/late/batch={batch_id}")
        (batch.where(~is_late).groupBy(F.to_date("transaction_date").alias("day"))
         .agg(F.sum("total_amount").cast(SUM_MONEY).alias("revenue"), F.count(F.lit(1)).alias("sales"))
         .write.mode("overwrite").parquet(f"{base}/days/batch={batch_id}"))
        if (batch_id + 1) % compact_every == 0:
            days_so_far(spark, base, batch_id + 1, also=batch_id).write.mode("overwrite").parquet(f"{base}/_days/upto={batch_id}")
        so_far = None if before is None else before + delay
        (batch.agg(F.max(F.date_trunc("second", "transaction_date")).alias("latest"))
         .select(F.greatest("latest", F.lit(None).cast("timestamp_ntz") if so_far is None else ts_lit(so_far)).alias("latest"))
         .write.mode("overwrite").parquet(f"{base}/marks/batch={batch_id}"))

    q = (sales.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint or f"{base}/_checkpoint")
         .trigger(availableNow=True).start())
    q.awaitTermination()


def watermark(spark: SparkSession, state_dir: str, delay: dt.timedelta, before: int | None = None) -> dt.datetime | None:
    """The latest sale (to the second) of the finished batches (before batch ``before``) less ``delay``; None without any."""
    base = state_dir.rstrip("/")
    done = [n for n in finished_batches(spark, f"{base}/marks") if before is None or n < before]
    latest = spark.read.parquet(f"{base}/marks/batch={done[-1]}").first()["latest"] if done else None
    return None if latest is None else latest - delay


def days_so_far(spark: SparkSession, state_dir: str, before: int | None = None, also: int | None = None) -> DataFrame:
    """day, revenue, sales summed over the finished batches (before batch ``before``), from the last compaction on.

    A null day holds the sales without a time. ``also`` names a batch whose days are written but that does not count yet."""
    base = state_dir.rstrip("/")
    done = {n for n in finished_batches(spark, f"{base}/marks")} | ({also} if also is not None else set())
    done = sorted(n for n in done if before is None or n < before)
    # a compaction counts once its batch does
    start = max((n for n in finished_batches(spark, f"{base}/_days", "upto=") if n in done and n != also), default=None)
    paths = [f"{base}/days/batch={n}" for n in done if start is None or n > start]
    paths += [] if start is None else [f"{base}/_days/upto={start}"]
    if not paths:
        return spark.createDataFrame([], DAYS)
    return spark.read.schema(DAYS).parquet(*paths).groupBy("day").agg(
        F.sum("revenue").cast(SUM_MONEY).alias("revenue"), F.sum("sales").alias("sales"))


def accounted_days(spark: SparkSession, state_dir: str, delay: dt.timedelta = dt.timedelta(days=1)) -> DataFrame:
    """day, revenue, sales and whether the watermark has closed the day; the late rows are ``late_rows``."""
    mark = watermark(spark, state_dir, delay)
    end = F.date_add("day", 1).cast("timestamp_ntz")
    closed = F.lit(False) if mark is None else F.coalesce(end <= ts_lit(mark), F.lit(False))
    return days_so_far(spark, state_dir).withColumn("closed", closed)


def late_rows(spark: SparkSession, state_dir: str) -> DataFrame | None:
    """The sales that came after their day was closed, with the batch they came in; None while no batch has finished."""
    base = state_dir.rstrip("/")
    done = finished_batches(spark, f"{base}/marks")
    return spark.read.option("basePath", f"{base}/late").parquet(*[f"{base}/late/batch={n}" for n in done]) if done else None


def stream_current_status(tracking: DataFrame) -> DataFrame:
    """STR2: newest tracking status per order (complete / update mode)."""
    return tracking.groupBy("order_id").agg(
        F.max_by("status", F.struct("created_at", "id")).alias("current_status"),
        F.max("created_at").alias("status_at"))


def stream_product_totals(sales: DataFrame) -> DataFrame:
    """STR3: units and revenue per product id (complete / update mode)."""
    return sales.groupBy("product_id").agg(F.sum("quantity").cast("long").alias("total_sales"),
                                           F.sum("total_amount").cast(SUM_MONEY).alias("revenue"))


def run_append(df: DataFrame, out_path: str, checkpoint: str) -> None:
    """Run an append-mode stream over everything available now into parquet files."""
    q = (df.writeStream.outputMode("append").format("parquet").option("path", out_path)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()


def run_updates(df: DataFrame, out_path: str, checkpoint: str, key: str | None = None, compact_every: int = 10) -> None:
    """Run an aggregate in update mode: each micro-batch writes only the keys it changed to
    ``out_path/batch=<id>`` (overwrite, so a replayed batch rewrites the same folder).
    Nothing proportional to all keys is emitted per trigger.

    With ``key``, every ``compact_every``-th batch also writes the current row of each key to
    ``_compact/upto=<id>``, from which ``latest_rows`` starts: a reader's cost is bounded by the keys and the batches since."""
    base, spark = out_path.rstrip("/"), df.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/batch={batch_id}")
        if key is not None and (batch_id + 1) % compact_every == 0:
            # a batch being replayed must not start from a snapshot that already holds it
            latest_rows(spark, base, key, before=batch_id).write.mode("overwrite").parquet(f"{base}/_compact/upto={batch_id}")

    q = (df.writeStream.outputMode("update").foreachBatch(write)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()


def latest_rows(spark: SparkSession, out_path: str, key: str, before: int | None = None,
                schema: T.StructType | str | None = None) -> DataFrame:
    """Current value per key from an update-mode output: the row of the highest batch id
    (a partial max_by aggregate, no window), from the last snapshot (earlier than batch ``before``) and the batches after it.
    While no batch has finished the table is empty, with the columns of ``schema`` or, without one, the key alone (long)."""
    base = out_path.rstrip("/")
    snapshots = [n for n in finished_batches(spark, f"{base}/_compact", "upto=") if before is None or n < before]
    start = max(snapshots, default=-1)
    later = [f"{base}/batch={n}" for n in finished_batches(spark, base) if n > start and (before is None or n <= before)]
    parts = [spark.read.parquet(f"{base}/_compact/upto={start}").withColumn("batch", F.lit(start))] if snapshots else []
    if later:
        parts.append(spark.read.option("basePath", base).parquet(*later))
    if not parts:
        return spark.createDataFrame([], schema if schema is not None else f"`{key}` long")
    changes = reduce(lambda x, y: x.unionByName(y), parts)
    cols = [c for c in changes.columns if c not in (key, "batch")]
    newest = changes.groupBy(key).agg(F.max_by(F.struct(*cols), F.col("batch")).alias("_v"))
    return newest.select(key, "_v.*")


def finished_batches(spark: SparkSession, path: str, prefix: str = "batch=") -> list[int]:
    """Ids of the ``batch=<id>`` (or another prefix) folders below ``path`` whose writer has finished (``_SUCCESS`` is there)."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    folders = [f.getPath() for f in fs.listStatus(root) if f.getPath().getName().startswith(prefix)]
    return sorted(int(p.getName()[len(prefix):]) for p in folders
                  if fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def _bucket(key: str, buckets: int) -> F.Column:
    return F.pmod(F.xxhash64(F.col(key).cast("long")), F.lit(buckets)).cast("int")


class StockState:
    """The stock of a purchase stream under one folder: a base in key buckets and each batch's changed products.

    * ``_base/upto=<n>/buckets=<b>/bucket=<k>``: every product as of batch n (-1: the first inventory), in b buckets of the product id.
    * ``stock/batch=<n>``: only the products that batch n changed.

    The stock before a batch is read for that batch's products alone: their buckets of the last finished base and the
    changes written since. Every ``compact_every``-th batch folds the changes into a new base, so a batch reads at
    most that many changes. Folders count only once their writer has finished (``_SUCCESS``).
    """

    def __init__(self, spark: SparkSession, state_dir: str):
        self.spark, self.base = spark, state_dir.rstrip("/")

    def bases(self) -> list[int]:
        return finished_batches(self.spark, f"{self.base}/_base", "upto=")

    def write_base(self, products: DataFrame, upto: int, buckets: int) -> None:
        # a bucket is one file: rows are dealt by it, and the folders carry its number
        rows = products.withColumn("buckets", F.lit(buckets)).withColumn("bucket", _bucket("id", buckets))
        rows.repartition(F.col("bucket")).write.mode("overwrite").partitionBy("buckets", "bucket").parquet(f"{self.base}/_base/upto={upto}")

    def before(self, batch_id: int | None, products: DataFrame | None = None) -> DataFrame:
        """Stock rows before ``batch_id`` (None: after all finished batches); with ``products`` (product_id) only theirs."""
        spark = self.spark
        start = max((n for n in self.bases() if batch_id is None or n < batch_id), default=None)
        if start is None:
            raise ValueError(f"no finished stock below {self.base}")
        base = spark.read.parquet(f"{self.base}/_base/upto={start}")
        later = [f"{self.base}/stock/batch={n}" for n in finished_batches(spark, f"{self.base}/stock")
                 if n > start and (batch_id is None or n < batch_id)]
        if products is not None:
            buckets = base.select("buckets").first()
            if buckets is not None:
                touched = products.select(_bucket("product_id", buckets[0]).alias("b")).where("b is not null").distinct().collect()
                base = base.where(F.col("bucket").isin([r.b for r in touched]))  # at most one number a bucket
        rows = base.drop("buckets", "bucket").withColumn("batch", F.lit(start))
        if later:
            rows = rows.unionByName(spark.read.option("basePath", f"{self.base}/stock").parquet(*later))
        if products is not None:
            rows = rows.join(products.select(F.col("product_id").alias("id")), "id", "left_semi")
        if not later:
            return rows.drop("batch")
        cols = [c for c in rows.columns if c not in ("id", "batch")]
        newest = rows.groupBy("id").agg(F.max_by(F.struct(*cols), "batch").alias("_v")).select("id", "_v.*")
        return newest.select(*[c for c in rows.columns if c != "batch"])


def stream_apply_purchases(requests: DataFrame, inventory: DataFrame, state_dir: str,
                           checkpoint: str | None = None, compact_every: int = 20, buckets: int = 64) -> None:
    """STR4: fold each micro-batch of purchase requests into the stock (``StockState``).

    Batch n reads the stock of its own products after the last finished batch before it (batch ids can skip) and
    fails if that cannot be read; ``inventory`` is used only when no base has been written yet. It writes ``sales/batch=n``, ``rejects/batch=n`` and, last, the changed
    products as ``stock/batch=n``, all with overwrite, so a batch replayed after a failure produces the same files. What a batch
    writes follows the batch, not the stock. ``buckets`` should grow with the table, some 100 MB of products each.
    """
    spark, state = requests.sparkSession, StockState(requests.sparkSession, state_dir)
    base = state.base
    if not state.bases():
        state.write_base(inventory, -1, buckets)

    def fold(batch: DataFrame, batch_id: int) -> None:
        asked = batch.select("product_id").where("product_id is not null").distinct()
        before = cut_lineage(state.before(batch_id, asked), "stock")
        out = apply_purchases(before, batch)
        out["sales"].write.mode("overwrite").parquet(f"{base}/sales/batch={batch_id}")
        out["rejects"].write.mode("overwrite").parquet(f"{base}/rejects/batch={batch_id}")
        sold = out["sales"].select(F.col("product_id").alias("id")).distinct()
        out["inventory"].join(sold, "id", "left_semi").write.mode("overwrite").parquet(f"{base}/stock/batch={batch_id}")
        if (batch_id + 1) % compact_every == 0:
            state.write_base(state.before(batch_id + 1), batch_id, buckets)

    q = (requests.writeStream.foreachBatch(fold)
         .option("checkpointLocation", checkpoint or f"{base}/_checkpoint")
         .trigger(availableNow=True).start())
    q.awaitTermination()


def latest_stock(spark: SparkSession, state_dir: str) -> DataFrame:
    """The stock of every product after the last finished batch; the first inventory when none has finished."""
    return StockState(spark, state_dir).before(None)


def new_scratch(spark: SparkSession, name: str) -> dict[str, str]:
    root = scratch_path(spark, name)
    return {"root": root, "out": f"{root}/out", "checkpoint": f"{root}/_checkpoint"}
