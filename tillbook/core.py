"""Small shared helpers: time literals, sessions, lineage cuts, distributed ids.

Every helper here stays on the DataFrame API; nothing is pulled to the driver
except single numbers (a max id, a row count of the work left).
"""

from __future__ import annotations

import datetime as dt
import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

TS_FMT = "%Y-%m-%d %H:%M:%S"


def as_datetime(value) -> dt.datetime:
    """Accept a datetime, a date or 'YYYY-MM-DD[ HH:MM:SS]' text."""
    if isinstance(value, dt.datetime):
        return value
    if isinstance(value, dt.date):
        return dt.datetime(value.year, value.month, value.day)
    text = str(value).strip()
    for fmt in (TS_FMT, "%Y-%m-%dT%H:%M:%S", "%Y-%m-%d"):
        try:
            return dt.datetime.strptime(text, fmt)
        except ValueError:
            pass
    raise ValueError(f"not a date or timestamp: {value!r}")


def ts_lit(value) -> Column:
    """A TIMESTAMP_NTZ literal; built from text so the session time zone never shifts it."""
    return F.lit(as_datetime(value).strftime(TS_FMT)).cast(T.TimestampNTZType())


def build_session(master: str = "local[*]", shuffle_partitions: int = 8, app: str = "tillbook",
                  extra: dict | None = None) -> SparkSession:
    """Session for tests and the bench. On a cluster the caller's own session is used instead."""
    builder = (SparkSession.builder.master(master).appName(app)
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
               .config("spark.sql.adaptive.enabled", "true")
               .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
               .config("spark.sql.adaptive.skewJoin.enabled", "true")
               .config("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
               .config("spark.sql.session.timeZone", "UTC")
               .config("spark.sql.execution.arrow.pyspark.enabled", "true")
               .config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false")
               .config("spark.driver.memory", "8g"))
    for key, value in (extra or {}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    The cluster's setting always wins. Only when nothing is set (a local test
    session) do we pick a folder of our own, and only in local mode: a
    machine-local folder is never valid on a cluster.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set; point it at a shared folder")
        configured = os.path.join("/tmp", f"tillbook-ckpt-{uuid.uuid4().hex[:8]}")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint dir, for written intermediate tables."""
    base = ensure_checkpoint_dir(spark)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def cut_lineage(df: DataFrame, name: str = "cut") -> DataFrame:
    """End the lineage by writing the rows as parquet under spark.checkpoint.dir and reading them back.

    One job, columnar and compressed (an RDD checkpoint computes the plan twice
    and serialises rows); the files sit in the shared folder, so a lost executor
    never takes them along, and the read-back carries real sizes for AQE.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_scratch(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``cut_lineage`` with the path, for tables that ``delete_scratch`` removes once what is made of them has been written."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def delete_scratch(spark: SparkSession, *paths: str) -> None:
    """Delete folders that ``write_scratch`` made; no plan that is still to run may read them."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    for path in paths:
        if not path.startswith(f"{base}/"):
            raise ValueError(f"{path} is not a scratch folder")
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def max_id(df: DataFrame, col: str = "id") -> int:
    """Largest id of a table, 0 when empty (one number to the driver)."""
    row = df.agg(F.max(col).alias("m")).first()
    return int(row["m"]) if row is not None and row["m"] is not None else 0


def sequence_ids(df: DataFrame, order_cols: list, start: int, id_col: str = "id",
                 slices: int | None = None) -> DataFrame:
    """Dense ids start+1, start+2, ... following ``order_cols`` without a single-task window.

    Rows are range-partitioned on the order (sampled bounds; a value with many rows is split as
    far as the order columns tell its rows apart) and sorted inside each range;
    ``monotonically_increasing_id`` is then (range << 33) + position. The rows are written once,
    so a row's number can never change, and shifted by the row count of all
    earlier ranges. That table has one row per range, so its broadcast is bounded by the range count. One exchange.
    """
    spark = df.sparkSession
    n = slices or max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    order = [F.col(c) if isinstance(c, str) else c for c in order_cols]
    numbered = cut_lineage(df.repartitionByRange(n, *order).sortWithinPartitions(*order)
                           .withColumn("_at", F.monotonically_increasing_id()))
    numbered = (numbered.withColumn("_slice", F.shiftright("_at", 33).cast("int"))
                .withColumn("_rn", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_at"))
    sizes = numbered.groupBy("_slice").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    return (numbered.join(F.broadcast(offsets), "_slice")
            .withColumn(id_col, (F.lit(int(start)) + F.col("_off") + F.col("_rn")).cast("long"))
            .drop("_slice", "_rn", "_off"))


class Outputs(dict):
    """The result tables of a change job, each built on first access and then kept.

    Jobs that number new rows have to run Spark jobs while the DataFrame is built
    (the numbering is materialised once); with this mapping a caller that reads
    only one output never pays for the others.
    """

    def __init__(self, **builders):
        super().__init__()
        self._builders = builders

    def __missing__(self, key):
        if key not in self._builders:
            raise KeyError(key)
        value = self._builders[key]()
        self[key] = value
        return value

    def keys(self):
        return self._builders.keys()

    def __contains__(self, key):
        return key in self._builders

    def __iter__(self):
        return iter(self._builders)

    def __len__(self):
        return len(self._builders)

    def items(self):
        return [(k, self[k]) for k in self._builders]

    def values(self):
        return [self[k] for k in self._builders]
