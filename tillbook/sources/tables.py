"""Reading tables (SRC1) and the adapters that view the driver's TPC-H-like tables as shop tables.

Adapters are pure projections (plus the lineitem-orders and lineitem-part
joins), so Catalyst prunes columns and pushes filters through them into the
parquet scans. Each one is mirrored by a CTE in the DuckDB oracle.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .schemas import MONEY, SCHEMAS, conform

# Fixed stand-in values for columns the driver tables do not have.
EPOCH_TS = "1994-01-01 00:00:00"
ORDER_STATUS_FROM_TPCH = {"F": "delivered", "O": "pending", "P": "processing"}
TRACKING_FROM_EVENT = {"signup": "order_placed", "click": "processing", "view": "in_transit",
                       "purchase": "delivered", "error": "cancelled"}
CART_ACTION_FROM_EVENT = {"click": "add", "view": "set", "error": "remove", "purchase": "checkout"}


def read_table(spark: SparkSession, path: str, name: str | None = None) -> DataFrame:
    """SRC1: read a stored model table. With ``name`` the declared schema is applied, so no inference pass."""
    reader = spark.read
    if name is not None:
        reader = reader.schema(SCHEMAS[name])
    return reader.parquet(path)


# Declared schemas of the driver's tables: reading with them skips schema inference
# (no parquet footer is opened to plan a query) and pins the types the adapters expect.
SOURCE_SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": ("o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
               "o_orderdate timestamp_ntz, o_orderpriority string"),
    "lineitem": ("l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                 "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
                 "l_linestatus string, l_shipdate timestamp_ntz"),
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}


def raw(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    reader = spark.read
    if table in SOURCE_SCHEMAS:
        reader = reader.schema(SOURCE_SCHEMAS[table])
    return reader.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def _case(col: str, mapping: dict[str, str]):
    expr = None
    for key, value in mapping.items():
        expr = (F.when(F.col(col) == key, value) if expr is None else expr.when(F.col(col) == key, value))
    return expr


def _ts(text: str):
    return F.lit(text).cast("timestamp_ntz")


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer -> users. Phone: ten digits from the key, shown as (ddd) ddd-dddd; nine digits when the balance is negative."""
    c = raw(spark, sf_dir, "customer")
    digits = F.lpad(F.col("c_custkey").cast("string"), 10, "0")
    shown = F.concat(F.lit("("), F.substring(digits, 1, 3), F.lit(") "), F.substring(digits, 4, 3),
                     F.lit("-"), F.substring(digits, 7, 4))
    return c.select(
        F.col("c_custkey").alias("id"),
        F.col("c_name").alias("full_name"),
        F.concat(F.lower(F.regexp_replace("c_name", "#", "")), F.lit("@example.com")).alias("email"),
        F.when(F.col("c_acctbal") < 0, F.substring(digits, 2, 9)).otherwise(shown).alias("phone"),
        F.col("c_mktsegment").alias("role"),
        _ts(EPOCH_TS).alias("created_at"),
    )


def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part -> inventory. Small sizes get no image (null below 5, blank below 10) so defaults show up."""
    p = raw(spark, sf_dir, "part")
    image = (F.when(F.col("p_size") < 5, F.lit(None).cast("string"))
             .when(F.col("p_size") < 10, F.lit(""))
             .otherwise(F.concat(F.lit("img/"), F.lower(F.regexp_replace("p_brand", "#", "")), F.lit(".png"))))
    return p.select(
        F.col("p_partkey").alias("id"),
        F.col("p_name").alias("name"),
        F.col("p_type").alias("description"),
        F.col("p_retailprice").cast(MONEY).alias("price"),
        F.col("p_size").cast("int").alias("quantity"),
        image.alias("image"),
        _ts(EPOCH_TS).alias("created_at"),
        _ts(EPOCH_TS).alias("updated_at"),
    )


def stocked_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inventory with ten units in stock for each unit of size, so that sales run some products out and not others."""
    return inventory(spark, sf_dir).withColumn("quantity", F.col("quantity") * 10)


def uncounted_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stocked inventory in which one product in a hundred and one was never counted (NULL stock)."""
    counted = stocked_inventory(spark, sf_dir)
    return counted.withColumn("quantity", F.when(F.col("id") % 101 != 17, F.col("quantity")))


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem x orders -> sales. Keeps the lineitem key columns, which together are unique.

    At scale this is a shuffle join of the two largest tables (or a broadcast of
    orders when AQE measures it small); only six columns cross the shuffle.
    """
    li = raw(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
                                               "l_quantity", "l_extendedprice")
    o = raw(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return li.join(o, li.l_orderkey == o.o_orderkey).select(
        F.col("o_custkey").alias("user_id"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_quantity").cast("int").alias("quantity"),
        F.col("l_extendedprice").cast(MONEY).alias("total_amount"),
        F.col("o_orderdate").alias("transaction_date"),
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("sale_key"),
    )


def purchase_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sale line as a purchase request, in order-date order (ties by the line key)."""
    s = sales(spark, sf_dir)
    return s.select(F.col("sale_key").alias("request_id"), "user_id", "product_id", "quantity",
                    F.col("transaction_date").alias("requested_at"))


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = raw(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("user_id"),
        F.col("o_totalprice").cast(MONEY).alias("total_amount"),
        _case("o_orderstatus", ORDER_STATUS_FROM_TPCH).alias("status"),
        F.col("o_orderpriority").alias("delivery_address"),
        F.col("o_orderdate").alias("created_at"),
        F.col("o_orderdate").alias("updated_at"),
    )


def order_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem -> order_items; the unit price comes from the product, the subtotal from the line."""
    li = raw(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
                                               "l_quantity", "l_extendedprice")
    p = raw(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    return li.join(p, li.l_partkey == p.p_partkey).select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("item_key"),
        F.col("l_orderkey").alias("order_id"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_quantity").cast("int").alias("quantity"),
        F.col("p_retailprice").cast(MONEY).alias("price_per_unit"),
        F.col("l_extendedprice").cast(MONEY).alias("subtotal"),
    )


def order_tracking(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = raw(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("order_id"),
        _case("event_type", TRACKING_FROM_EVENT).alias("status"),
        F.lit(None).cast("string").alias("location"),
        F.col("event_type").alias("notes"),
        F.col("ts").alias("created_at"),
    )


def payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = raw(spark, sf_dir, "events")
    kind = F.col("event_type")
    return e.select(
        F.col("event_id").alias("id"),
        F.floor(F.col("event_id") / 2).cast("long").alias("order_id"),
        F.concat(F.lit("WV"), F.col("event_id").cast("string")).alias("transaction_id"),
        F.when(kind == "error", F.col("user_id").cast("string"))
         .otherwise(F.lpad(F.col("user_id").cast("string"), 10, "0")).alias("phone_number"),
        F.col("value").cast(MONEY).alias("amount"),
        F.when(kind == "purchase", "completed").when(kind == "error", "failed").otherwise("pending").alias("status"),
        F.when(kind == "purchase", "0").when(kind == "error", "1").alias("result_code"),
        F.when(kind == "purchase", "Success").when(kind == "error", "Failed").alias("result_desc"),
        F.col("ts").alias("created_at"),
        F.when(kind == "purchase", F.col("ts")).alias("completed_at"),
    )


def event_product():
    """The product an event is about: 13 for each user, so that products grow with the users."""
    return F.col("user_id") * 13 + F.get_json_object("props", "$.k").cast("long") % 13


def cart_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events -> cart events (add / set / remove / checkout); sign-ups are not cart events."""
    e = raw(spark, sf_dir, "events").where(F.col("event_type") != "signup")
    return e.select(
        F.col("event_id"),
        F.col("user_id"),
        event_product().alias("product_id"),
        _case("event_type", CART_ACTION_FROM_EVENT).alias("action"),
        (F.lit(1) + F.floor("value").cast("long") % 9).cast("int").alias("quantity"),
        F.col("ts").alias("event_time"),
    )


def model_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {
        "users": users(spark, sf_dir),
        "inventory": inventory(spark, sf_dir),
        "sales": sales(spark, sf_dir),
        "orders": orders(spark, sf_dir),
        "order_items": order_items(spark, sf_dir),
        "order_tracking": order_tracking(spark, sf_dir),
        "payments": payments(spark, sf_dir),
    }


def flawed_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Copies of the shop tables with broken rows, chosen by the key modulo 50: a missing field (0), a parent that
    does not exist (1), a repeated key (2), a value outside its list (3). Reports are one row per supplier."""
    def flaw(df: DataFrame, key: str, **values) -> DataFrame:
        return df.withColumns({c: F.when(F.col(key) % 50 == k, v).otherwise(F.col(c)) for c, (k, v) in values.items()})

    none, gone = F.lit(None), lambda c: F.col(c) + UNKNOWN_ID_OFFSET
    role = F.when(F.col("role") == "BUILDING", "admin").when(F.col("role") == "MACHINERY", F.col("role")).otherwise("customer")
    before = F.upper(F.concat(F.lit("customer"), F.lpad((F.col("id") - 1).cast("string"), 9, "0"), F.lit("@example.com")))
    reports = raw(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("id"), F.col("s_name").alias("title"),
        F.element_at(F.array(*[F.lit(t) for t in ("sales", "inventory", "user_activity")]), (F.col("s_suppkey") % 3 + 1).cast("int")).alias("type"),
        F.lit("{}").alias("data"), (F.col("s_suppkey") + 1).alias("generated_by"), _ts(EPOCH_TS).alias("generated_at"))
    return {
        "users": flaw(users(spark, sf_dir).withColumn("role", role), "id", full_name=(0, none), email=(2, before)),
        "inventory": flaw(inventory(spark, sf_dir), "id", price=(0, none), name=(1, none)).withColumn(
            "id", F.when(F.col("id") % 50 == 2, F.col("id") - 1).otherwise(F.col("id"))),
        "sales": flaw(sales(spark, sf_dir), "user_id", quantity=(0, none), product_id=(1, gone("product_id"))),
        "orders": flaw(orders(spark, sf_dir), "id", total_amount=(0, none), user_id=(1, gone("user_id")), status=(3, F.lit("lost"))),
        "order_items": flaw(order_items(spark, sf_dir), "product_id", quantity=(0, none), order_id=(1, gone("order_id"))),
        "reports": flaw(reports, "id", title=(0, none), generated_by=(1, gone("generated_by")), type=(3, F.lit("weather"))),
    }


# ---------------------------------------------------------------- request tables for the change jobs
# Each is derived row by row from a whole driver table, so its size grows with the data.

CHECKOUT_AT, CHECKOUT_EARLY_AT = "2024-02-01 09:00:00", "2024-02-01 08:00:00"
CHANGE_AT, CHANGE_LATER_AT = "2024-03-01 00:00:00", "2024-03-02 00:00:00"
UNKNOWN_ID_OFFSET = 1_000_000_000


def checkout_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A checkout from every customer in credit (a negative balance sends none, so that cart stays);
    customers with a balance over 5000 also sent an earlier second one."""
    c = raw(spark, sf_dir, "customer")
    base = dict(user_id=F.col("c_custkey"), delivery_address=F.concat(F.lit("Nation "), F.col("c_nationkey")))
    first = c.where(F.col("c_acctbal") >= 0).select(F.concat(F.lit("co-"), F.col("c_custkey"), F.lit("-1")).alias("request_id"),
                     *[v.alias(k) for k, v in base.items()], _ts(CHECKOUT_AT).alias("requested_at"))
    second = c.where(F.col("c_acctbal") > 5000).select(
        F.concat(F.lit("co-"), F.col("c_custkey"), F.lit("-2")).alias("request_id"),
        *[v.alias(k) for k, v in base.items()], _ts(CHECKOUT_EARLY_AT).alias("requested_at"))
    return first.unionByName(second)


def payment_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A payment request per order, an hour after it; finished ('F') orders are asked for by the
    wrong customer, urgent ('5-...') ones come with an unusable phone."""
    o = raw(spark, sf_dir, "orders")
    return o.select(
        F.concat(F.lit("pay-"), F.col("o_orderkey")).alias("request_id"),
        F.col("o_orderkey").alias("order_id"),
        F.when(F.col("o_orderstatus") == "F", F.col("o_custkey") + 1).otherwise(F.col("o_custkey")).alias("user_id"),
        F.when(F.col("o_orderpriority").startswith("5"), F.lit("n/a"))
         .otherwise(F.lpad(F.col("o_custkey").cast("string"), 10, "0")).alias("phone_number"),
        (F.col("o_orderdate") + F.expr("INTERVAL 1 HOUR")).alias("requested_at"))


def payment_confirmations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Provider confirmations from events: views confirm their pending payment (small values fail, the next
    ones come without a code, large ones are confirmed twice), clicks name unknown transactions, purchases confirm
    payments that are already completed."""
    e = raw(spark, sf_dir, "events").where(F.col("event_type").isin("view", "click", "purchase"))
    tx = F.when(F.col("event_type") == "click", F.concat(F.lit("WVX"), F.col("event_id"))) \
        .otherwise(F.concat(F.lit("WV"), F.col("event_id")))
    code = F.when(F.col("value") < 5, F.lit("1")).when(F.col("value") < 10, F.lit(None)).otherwise(F.lit("0"))
    desc = F.when(F.col("value") < 5, F.lit("Failed")).otherwise(F.lit("Success"))
    once = e.select(F.col("event_id").alias("confirmation_id"), tx.alias("transaction_id"), code.alias("result_code"),
                    desc.alias("result_desc"), (F.col("ts") + F.expr("INTERVAL 1 MINUTE")).alias("confirmed_at"))
    again = e.where((F.col("event_type") == "view") & (F.col("value") > 100)).select(
        (F.col("event_id") + UNKNOWN_ID_OFFSET).alias("confirmation_id"), tx.alias("transaction_id"),
        code.alias("result_code"), desc.alias("result_desc"),
        (F.col("ts") + F.expr("INTERVAL 2 MINUTES")).alias("confirmed_at"))
    return once.unionByName(again)


STATUS_FROM_EVENT = {"signup": "pending", "click": "out_for_delivery", "view": "in_transit",
                     "purchase": "delivered", "error": "refunded"}


def status_update_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Admin status updates from events; clicks are bulk updates that also name an unknown order,
    errors ask for a status that does not exist, every 97th event for none."""
    e = raw(spark, sf_dir, "events")
    ids = F.when(F.col("event_type") == "click",
                 F.array(F.col("user_id"), F.col("user_id") + UNKNOWN_ID_OFFSET)).otherwise(F.array(F.col("user_id")))
    return e.select(F.col("event_id").alias("request_id"), ids.alias("order_ids"),
                    F.when(F.col("event_id") % 97 != 0, _case("event_type", STATUS_FROM_EVENT)).alias("status"),
                    F.concat(F.lit("update "), F.col("event_type")).alias("notes"), F.col("ts").alias("requested_at"))


def signup_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sign-ups from signup events: high values reuse a customer's email in other letter case,
    low values type a short phone, the highest ask for the master_admin role."""
    e = raw(spark, sf_dir, "events").where(F.col("event_type") == "signup")
    padded = F.lpad(F.col("user_id").cast("string"), 9, "0")
    return e.select(
        F.col("event_id").alias("request_id"),
        F.concat(F.lit("Customer#"), padded).alias("full_name"),
        F.when(F.col("value") >= 200, F.concat(F.lit("Customer"), padded, F.lit("@Example.com")))
         .otherwise(F.concat(F.lit("user"), F.col("user_id"), F.lit("@example.com"))).alias("email"),
        F.when(F.col("value") < 20, F.lit("12345"))
         .otherwise(F.concat(F.lit("(555) 010-"), F.lpad(F.col("user_id").cast("string"), 4, "0"))).alias("phone"),
        F.when(F.col("value") >= 300, "master_admin").when(F.col("value") >= 100, "admin")
         .otherwise("customer").alias("role"),
        F.col("ts").alias("requested_at"))


def product_change_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An update for every product (large ones get a second, later one with a blank image), an
    update of an unknown id, an add (negative balances give a negative price) and a request without
    an action per supplier."""
    p = raw(spark, sf_dir, "part")
    s = raw(spark, sf_dir, "supplier")
    first = p.select(
        F.concat(F.lit("up-"), F.col("p_partkey")).alias("request_id"), F.lit("update").alias("action"),
        F.col("p_partkey").alias("product_id"), F.upper("p_name").alias("name"),
        (F.col("p_retailprice").cast(MONEY) * F.lit(Decimal("1.1"))).cast(MONEY).alias("price"),
        (F.col("p_size") + 5).cast("int").alias("quantity"),
        F.concat(F.col("p_type"), F.lit(" (updated)")).alias("description"),
        F.when(F.col("p_size") < 25, F.lit("")).otherwise(
            F.concat(F.lit("img/new-"), F.lower(F.regexp_replace("p_brand", "#", "")), F.lit(".png"))).alias("image"),
        _ts(CHANGE_AT).alias("requested_at"))
    second = p.where(F.col("p_size") > 40).select(
        F.concat(F.lit("up2-"), F.col("p_partkey")).alias("request_id"), F.lit("update").alias("action"),
        F.col("p_partkey").alias("product_id"), F.col("p_name").alias("name"),
        (F.col("p_retailprice").cast(MONEY) * F.lit(Decimal("1.2"))).cast(MONEY).alias("price"),
        F.col("p_size").cast("int").alias("quantity"), F.col("p_type").alias("description"),
        F.lit("").alias("image"), _ts(CHANGE_LATER_AT).alias("requested_at"))
    unknown = s.select(
        F.concat(F.lit("upx-"), F.col("s_suppkey")).alias("request_id"), F.lit("update").alias("action"),
        (F.col("s_suppkey") + UNKNOWN_ID_OFFSET).alias("product_id"), F.col("s_name").alias("name"),
        F.lit(1).cast(MONEY).alias("price"), F.lit(1).alias("quantity"), F.lit("none").alias("description"),
        F.lit(None).cast("string").alias("image"), _ts(CHANGE_AT).alias("requested_at"))
    adds = s.select(
        F.concat(F.lit("add-"), F.col("s_suppkey")).alias("request_id"), F.lit("add").alias("action"),
        F.lit(None).cast("long").alias("product_id"), F.col("s_name").alias("name"),
        F.col("s_acctbal").cast(MONEY).alias("price"), F.lit(100).alias("quantity"),
        F.lit("new").alias("description"), F.lit(None).cast("string").alias("image"),
        _ts(CHANGE_AT).alias("requested_at"))
    no_action = adds.withColumn("request_id", F.concat(F.lit("no-"), F.col("request_id"))).withColumn(
        "action", F.lit(None).cast("string"))
    return first.unionByName(second).unionByName(unknown).unionByName(adds).unionByName(no_action)


__all__ = ["read_table", "raw", "users", "inventory", "sales", "purchase_requests", "orders", "order_items",
           "order_tracking", "payments", "cart_events", "model_tables", "conform"]
