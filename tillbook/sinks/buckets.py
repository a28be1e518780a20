"""Tables in buckets: a change job rewrites the buckets it touches and appends to the others.

Below one folder:

* ``v=<n>/bucket=<k>``: rows that version n wrote for bucket k;
* ``manifest/v=<n>``: for each bucket the versions whose rows make it up, with the largest id of the table and its schema. A version
  exists once its manifest is finished (``_SUCCESS``), so readers see all of a change or nothing, and a writer that died
  leaves nothing behind but files that nobody reads;
* ``writers/<n>``: made atomically before version n is written, so two writers of the same version cannot both go on.

The bucket of a row is a whole number that follows from one column: a hash of a key (``hash_bucket``) or a time span (``month_bucket``). A
manifest has a row for each bucket, which is the one thing that is collected: choose the number of buckets, not the data.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .folders import Folder

Rule = Callable[[str], Column]


def hash_bucket(buckets: int) -> Rule:
    """Buckets 0 to ``buckets`` - 1 by the value of a column of any type; null keys share one."""
    return lambda col: F.pmod(F.xxhash64(F.col(col).cast("string")), F.lit(buckets)).cast("int")


def month_bucket() -> Rule:
    """A bucket for each calendar month of a date or timestamp, as year * 100 + month; -1 without a time."""
    return lambda col: F.coalesce(F.year(col) * 100 + F.month(col), F.lit(-1)).cast("int")


@dataclass
class Version:
    number: int
    max_id: int
    schema: T.StructType
    label: str | None = None
    parts: dict[int, list[int]] = field(default_factory=dict)


class BucketTable:
    """A table at ``path`` whose rows are placed by ``rule`` of the column ``key``; all writers must name the same two."""

    def __init__(self, spark: SparkSession, path: str, key: str, rule: Rule, id_col: str = "id"):
        self.spark, self.path, self.key, self.rule, self.id_col = spark, path.rstrip("/"), key, rule, id_col

    def version(self) -> Version | None:
        """The newest finished version; None before the first."""
        names = [n for n in Folder(self.spark, f"{self.path}/manifest").names() if n.startswith("v=")]
        for n in sorted((int(n[2:]) for n in names), reverse=True):
            if "_SUCCESS" in Folder(self.spark, f"{self.path}/manifest/v={n}").names():
                rows = self.spark.read.parquet(f"{self.path}/manifest/v={n}").collect()  # one row a bucket
                schema = T.StructType.fromJson(json.loads(rows[0]["schema"]))
                return Version(n, rows[0]["max_id"], schema, rows[0]["label"], {r["bucket"]: r["versions"] for r in rows if r["bucket"] is not None})
        return None

    def of(self, keys: DataFrame, col: str) -> list[int]:
        """The buckets that the values of ``col`` fall into: at most one number a bucket."""
        return sorted(r["b"] for r in keys.select(self.rule(col).alias("b")).distinct().collect())

    def read(self, buckets: list[int] | None = None, version: Version | None = None) -> DataFrame:
        """The table, or its given buckets: only their files are listed and read."""
        version = version or self.version()
        if version is None:
            raise ValueError(f"no finished version below {self.path}")
        wanted = version.parts if buckets is None else {b: version.parts[b] for b in buckets if b in version.parts}
        paths = [f"{self.path}/v={v}/bucket={b}" for b, vs in wanted.items() for v in vs]
        if not paths:
            return self.spark.createDataFrame([], version.schema)
        return self.spark.read.schema(version.schema).parquet(*paths)

    def commit(self, rows: DataFrame, replaced: list[int] | None = None, label: str | None = None) -> Version:
        """A new version: ``rows`` take the place of the ``replaced`` buckets (None: of the whole table) and are added to any others.

        With a ``label`` (the name of a batch) the commit is done once: if the newest version has it, nothing is written.
        A bucket with many rows, such as one with a hot order, is written by several tasks."""
        before = self.version()
        if label is not None and before is not None and before.label == label:
            return before
        if before is not None:
            if sorted(rows.columns) != sorted(before.schema.names):
                raise ValueError(f"columns {rows.columns} are not those of the table, {before.schema.names}")
            rows = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in before.schema])
        number, schema = (before.number + 1 if before else 0), before.schema if before else rows.schema
        target = f"{self.path}/v={number}"
        if not Folder(self.spark, f"{self.path}/writers").mark(str(number)):
            raise RuntimeError(f"version {number} of {self.path} has another writer; if that one died, call forget({number})")
        placed = rows.withColumn("bucket", self.rule(self.key))
        placed.hint("rebalance", F.col("bucket")).write.mode("overwrite").partitionBy("bucket").parquet(target)
        written = [int(n[7:]) for n in Folder(self.spark, target).names() if n.startswith("bucket=")]
        kept = {} if replaced is None or before is None else {b: vs for b, vs in before.parts.items() if b not in set(replaced)}
        parts = {**kept, **{b: kept.get(b, []) + [number] for b in written}}
        added = 0
        if written and self.id_col in rows.columns and isinstance(schema[self.id_col].dataType, (T.LongType, T.IntegerType)):
            added = self.spark.read.schema(schema).parquet(*[f"{target}/bucket={b}" for b in written]).agg(F.max(self.id_col)).first()[0] or 0
        max_id = max(int(added), before.max_id if before else 0)
        lines = [(b, vs, max_id, schema.json(), label) for b, vs in sorted(parts.items())] or [(None, None, max_id, schema.json(), label)]
        (self.spark.createDataFrame(lines, "bucket int, versions array<int>, max_id long, schema string, label string").coalesce(1)
         .write.mode("overwrite").parquet(f"{self.path}/manifest/v={number}"))
        return Version(number, max_id, schema, label, parts)

    def forget(self, number: int) -> None:
        """Give up an unfinished version whose writer has died, so that it can be written again."""
        before = self.version()
        if number != (before.number + 1 if before else 0):
            raise ValueError(f"version {number} is not the one being written")
        for name in (f"v={number}", f"manifest/v={number}", f"writers/{number}"):
            Folder(self.spark, f"{self.path}/{name}").delete()

    def compact(self, most: int = 8) -> Version | None:
        """Rewrite the buckets that more than ``most`` versions make up; None if there are none."""
        many = [b for b, vs in self.version().parts.items() if len(vs) > most]
        return self.commit(self.read(many), many) if many else None

