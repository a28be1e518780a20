"""Declared model tables (SRC2): Spark schemas plus the NOT NULL / ENUM / UNIQUE / FK rules.

``check_table`` splits a DataFrame into rows that keep every rule and a
rejects DataFrame carrying the first broken rule as ``reason``.
"""

from __future__ import annotations


from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MONEY = T.DecimalType(10, 2)
TS = T.TimestampNTZType()

# Fixed values that must equal the reference's enums.
USER_ROLES = ["customer", "admin", "master_admin"]
REPORT_TYPES = ["sales", "inventory", "user_activity"]
ORDER_STATUSES = ["pending", "processing", "in_transit", "delivered", "cancelled"]
TRACKING_STATUSES = ["order_placed", "payment_received", "processing", "in_transit",
                     "out_for_delivery", "delivered", "cancelled"]
PAYMENT_STATUSES = ["pending", "completed", "failed"]


def _struct(*fields) -> T.StructType:
    return T.StructType([T.StructField(name, dtype, nullable) for name, dtype, nullable in fields])


SCHEMAS: dict[str, T.StructType] = {
    "users": _struct(("id", T.LongType(), False), ("full_name", T.StringType(), False),
                     ("email", T.StringType(), False), ("phone", T.StringType(), False),
                     ("role", T.StringType(), True), ("created_at", TS, True)),
    "inventory": _struct(("id", T.LongType(), False), ("name", T.StringType(), False),
                         ("description", T.StringType(), True), ("price", MONEY, False),
                         ("quantity", T.IntegerType(), False), ("image", T.StringType(), True),
                         ("created_at", TS, True), ("updated_at", TS, True)),
    "sales": _struct(("id", T.LongType(), False), ("user_id", T.LongType(), False),
                     ("product_id", T.LongType(), False), ("quantity", T.IntegerType(), False),
                     ("total_amount", MONEY, False), ("transaction_date", TS, True)),
    "reports": _struct(("id", T.LongType(), False), ("title", T.StringType(), False),
                       ("type", T.StringType(), False), ("data", T.StringType(), True),
                       ("generated_by", T.LongType(), False), ("generated_at", TS, True)),
    "cart": _struct(("id", T.LongType(), False), ("user_id", T.LongType(), False),
                    ("product_id", T.LongType(), False), ("quantity", T.IntegerType(), False),
                    ("created_at", TS, True), ("updated_at", TS, True)),
    "orders": _struct(("id", T.LongType(), False), ("user_id", T.LongType(), False),
                      ("total_amount", MONEY, False), ("status", T.StringType(), True),
                      ("delivery_address", T.StringType(), False), ("created_at", TS, True),
                      ("updated_at", TS, True)),
    "order_items": _struct(("id", T.LongType(), False), ("order_id", T.LongType(), False),
                           ("product_id", T.LongType(), False), ("quantity", T.IntegerType(), False),
                           ("price_per_unit", MONEY, False), ("subtotal", MONEY, False)),
    "order_tracking": _struct(("id", T.LongType(), False), ("order_id", T.LongType(), False),
                              ("status", T.StringType(), False), ("location", T.StringType(), True),
                              ("notes", T.StringType(), True), ("created_at", TS, True)),
    "payments": _struct(("id", T.LongType(), False), ("order_id", T.LongType(), False),
                        ("transaction_id", T.StringType(), False), ("phone_number", T.StringType(), False),
                        ("amount", MONEY, False), ("status", T.StringType(), True),
                        ("result_code", T.StringType(), True), ("result_desc", T.StringType(), True),
                        ("created_at", TS, True), ("completed_at", TS, True)),
}

ENUMS: dict[str, dict[str, list[str]]] = {
    "users": {"role": USER_ROLES},
    "reports": {"type": REPORT_TYPES},
    "orders": {"status": ORDER_STATUSES},
    "order_tracking": {"status": TRACKING_STATUSES},
    "payments": {"status": PAYMENT_STATUSES},
}

# Unique keys besides the primary key.
UNIQUE: dict[str, list[list[str]]] = {
    "users": [["email"]],
    "cart": [["user_id", "product_id"]],
    "payments": [["transaction_id"]],
}

# Text keys that are compared without regard to letter case, as sign-ups compare them.
CASELESS = {"email"}

# (column, parent table, parent column)
FOREIGN_KEYS: dict[str, list[tuple[str, str, str]]] = {
    "sales": [("user_id", "users", "id"), ("product_id", "inventory", "id")],
    "reports": [("generated_by", "users", "id")],
    "cart": [("user_id", "users", "id"), ("product_id", "inventory", "id")],
    "orders": [("user_id", "users", "id")],
    "order_items": [("order_id", "orders", "id"), ("product_id", "inventory", "id")],
    "order_tracking": [("order_id", "orders", "id")],
    "payments": [("order_id", "orders", "id")],
}


def conform(df: DataFrame, name: str, keep: list[str] | None = None) -> DataFrame:
    """Cast and order the columns of ``df`` to the declared schema (missing columns become null);
    ``keep`` names extra columns carried along unchanged (e.g. a partition column)."""
    cols = []
    for field in SCHEMAS[name].fields:
        if field.name in df.columns:
            cols.append(F.col(field.name).cast(field.dataType).alias(field.name))
        else:
            cols.append(F.lit(None).cast(field.dataType).alias(field.name))
    declared = {f.name for f in SCHEMAS[name].fields}
    return df.select(*cols, *[c for c in (keep or []) if c not in declared])


def _listed(keys: DataFrame, names: list[str], flag: str) -> DataFrame:
    """Broken keys, flagged, behind an exchange of their own: what grouped them is finished before the rows are joined, so
    no task holds both, and adaptive execution broadcasts a list that it measures to be short (then the rows are not sorted)."""
    return keys.select(*names, F.lit(True).alias(flag)).hint("rebalance")


def check_table(df: DataFrame, name: str, parents: dict[str, DataFrame] | None = None,
                enforce_pk: bool = True) -> tuple[DataFrame, DataFrame]:
    """Split ``df`` into (good, rejects) by the rules declared for table ``name``.

    Rules run as column predicates (NOT NULL, ENUM) and as lists of broken keys: the
    keys counted more than once (UNIQUE) and the keys that occur here but not in the
    parent (FK, only for parents passed in). Both lists are grouped with map-side
    partial results and join the rows as stages of their own (``_listed``). A row
    breaking several rules is rejected once, with the first reason in declaration order.
    """
    schema = SCHEMAS[name]
    parents = parents or {}
    reasons = []
    for field in schema.fields:
        if not field.nullable and field.name in df.columns:
            reasons.append(F.when(F.col(field.name).isNull(), F.lit(f"{field.name} is null")))
    for col, allowed in ENUMS.get(name, {}).items():
        if col in df.columns:
            reasons.append(F.when(F.col(col).isNotNull() & ~F.col(col).isin(allowed),
                                  F.lit(f"{col} not in {'/'.join(allowed)}")))
    marked = df
    keys = ([["id"]] if enforce_pk and "id" in df.columns else []) + UNIQUE.get(name, [])
    for i, key in enumerate(keys):
        if not all(k in df.columns for k in key):
            continue
        flag = f"_dup{i}"
        names = [f"_dupkey{i}_{k}" for k in key]
        marked = marked.withColumns({n: F.lower(k) if k in CASELESS else F.col(k) for n, k in zip(names, key)})
        dups = marked.groupBy(*names).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
        marked = marked.join(_listed(dups, names, flag), names, "left")
        reasons.append(F.when(F.col(flag), F.lit(f"duplicate {'+'.join(key)}")))
    for i, (col, parent, parent_col) in enumerate(FOREIGN_KEYS.get(name, [])):
        if parent not in parents or col not in df.columns:
            continue
        flag = f"_fk{i}"
        here = df.select(F.col(col), F.lit(False).alias("_there")).where(F.col(col).isNotNull())
        there = parents[parent].select(F.col(parent_col).alias(col), F.lit(True).alias("_there"))
        gone = here.union(there).groupBy(col).agg(F.max("_there").alias("_there")).where(~F.col("_there"))
        marked = marked.join(_listed(gone, [col], flag), col, "left")
        reasons.append(F.when(F.col(flag), F.lit(f"{col} has no {parent}.{parent_col}")))
    reason = F.coalesce(*reasons) if reasons else F.lit(None).cast("string")
    marked = marked.withColumn("reason", reason)
    helper = [c for c in marked.columns if c.startswith("_dup") or c.startswith("_fk")]
    marked = marked.drop(*helper)
    good = marked.where(F.col("reason").isNull()).drop("reason").select(*df.columns)
    rejects = marked.where(F.col("reason").isNotNull()).select(*df.columns, "reason")
    return good, rejects
