"""Order views REP8-REP10: order history, receipts and the admin order list.

The reference nests items and tracking under each order of one user. Here the
views cover all users at once and stay flat (one DataFrame per level, keyed by
order id), because a nested array holds a whole group in one row; an order with
a huge tracking log would then sit in one task. ``nest_order_history`` builds
the nested shape for display when a caller asks for it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..core import cut_lineage
from ..operators.aggregates import current_status
from ..operators.filters import filter_orders, for_user
from ..operators.joins import order_lines, receipt_headers
from ..operators.payments import ORDER_NOT_FOUND
from ..operators.running import running_sum, with_range_slices


def newest_orders() -> list:
    """SRT4: orders newest first, ties by id."""
    return [F.col("created_at").desc(), F.col("id").desc()]


def newest_tracking() -> list:
    """SRT4: each order's tracking rows newest first, ties by id."""
    return [F.col("order_id"), F.col("created_at").desc(), F.col("id").desc()]


def _of_orders(orders: DataFrame, items: DataFrame, inventory: DataFrame, tracking: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The lines (with product name and image) and tracking rows of the given orders; both tables are
    reduced to these orders before anything is joined or aggregated."""
    keys = orders.select(F.col("id").alias("order_id"))
    return (order_lines(items.join(keys, "order_id", "left_semi"), inventory),
            tracking.join(keys, "order_id", "left_semi"))


def order_history(orders: DataFrame, items: DataFrame, tracking: DataFrame, inventory: DataFrame,
                  user=None, ordered: bool = True) -> dict[str, DataFrame]:
    """REP8 (flat): orders with current status (newest first), their lines with product
    name and image, and their tracking rows (newest first, ties by id)."""
    o = orders if user is None else for_user(orders, user)
    lines, track = _of_orders(o, items, inventory, tracking)
    with_status = current_status(o, tracking if user is None else track)
    if ordered:
        with_status = with_status.orderBy(*newest_orders())
        track = track.orderBy(*newest_tracking())
    return {"orders": with_status, "items": lines, "tracking": track}


def _entries(rows: DataFrame, order_cols: list[str], fields: list[str], name: str, rows_per_chunk: int) -> DataFrame:
    """(id, chunk, <name>): arrays of at most ``rows_per_chunk`` entries (position, *fields) in the given
    order. Positions are running counts over range slices, so an order with a huge log is numbered by many tasks."""
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sliced = cut_lineage(with_range_slices(rows.withColumn("_one", F.lit(1)), "order_id", order_cols, partitions), "entries")
    numbered = running_sum(sliced, "order_id", order_cols, "_one", "position", "_slice")
    chunk = F.floor((F.col("position") - 1) / rows_per_chunk).cast("long").alias("chunk")
    return numbered.groupBy(F.col("order_id").alias("id"), chunk).agg(
        F.sort_array(F.collect_list(F.struct("position", *fields))).alias(name))


def nest_order_history(history: dict[str, DataFrame], rows_per_chunk: int = 1000, rows_per_order: int = 100_000) -> DataFrame:
    """REP8 (nested): items[] (by item id) and tracking[] (newest first) per order and chunk.

    Chunk k of an order holds entries k * rows_per_chunk + 1 to (k + 1) * rows_per_chunk of both; every
    order has chunk 0, and most have no other. So no row grows with the log of one order.

    Lines and tracking are written once and dealt by order once: an order of at most ``rows_per_order`` rows is gathered and
    then cut into its chunks. Longer ones (of N rows fewer than N / ``rows_per_order`` orders, so their ids are broadcast) are numbered
    over range slices instead.
    """
    items, o = history["items"], history["orders"].where(F.col("id").isNotNull())
    key = "id" if "id" in items.columns else "item_key"
    fields = {"items": [key, *[c for c in items.columns if c not in ("order_id", key)]], "tracking": ["created_at", "id", "status", "location", "notes"]}
    newest = history["tracking"].withColumn("_late", -F.unix_micros(F.col("created_at").cast("timestamp"))).withColumn("_high", -F.col("id"))
    # both kinds of rows begin with what they are sorted by
    lines = items.select("order_id", F.struct(*fields["items"]).alias("items"))
    log = newest.select("order_id", F.struct("_late", "_high", *fields["tracking"]).alias("tracking"))
    rows = cut_lineage(lines.unionByName(log, allowMissingColumns=True).where(F.col("order_id").isNotNull()), "history")
    long = cut_lineage(rows.groupBy("order_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > rows_per_order).select("order_id"), "long")
    long_ids = F.broadcast(long.withColumnRenamed("order_id", "id"))

    gathered = (rows.join(F.broadcast(long), "order_id", "left_anti").repartition("order_id").groupBy(F.col("order_id").alias("id"))
                .agg(*[F.sort_array(F.collect_list(name)).alias(name) for name in fields]))
    whole = o.join(long_ids, "id", "left_anti").join(gathered, "id", "left")
    n_chunks = F.greatest(F.lit(1), *[F.ceil(F.coalesce(F.size(name), F.lit(0)) / rows_per_chunk) for name in fields])
    start = F.col("chunk") * rows_per_chunk

    def piece(name: str):
        entry = lambda x, i: F.struct((start + i + 1).cast("long").alias("position"), *[x[c].alias(c) for c in fields[name]])
        return F.coalesce(F.transform(F.slice(name, (start + 1).cast("int"), rows_per_chunk), entry), F.array()).alias(name)

    columns = ["id", *[c for c in o.columns if c != "id"]]
    nested = (whole.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), n_chunks.cast("long") - 1)))
              .select(*columns, "chunk", *[piece(name) for name in fields]))
    return nested if long.isEmpty() else nested.unionByName(_nested_long(
        rows.join(F.broadcast(long), "order_id", "left_semi"), o.join(long_ids, "id", "left_semi"), fields, rows_per_chunk).select(*nested.columns))


def _nested_long(rows: DataFrame, orders: DataFrame, fields: dict[str, list[str]], rows_per_chunk: int) -> DataFrame:
    """The chunks of orders with long logs, by positions that are numbered over range slices."""
    by = {"items": fields["items"][:1], "tracking": ["_late", "_high"]}
    items, track = [_entries(rows.where(F.col(name).isNotNull()).select("order_id", f"{name}.*"), by[name], fields[name], name, rows_per_chunk)
                    for name in fields]
    return (orders.join(items.join(track, ["id", "chunk"], "full"), "id")
            .withColumn("items", F.coalesce("items", F.array()))
            .withColumn("tracking", F.coalesce("tracking", F.array())))


def receipts_for(requests: DataFrame, orders: DataFrame, users: DataFrame, payments: DataFrame, items: DataFrame,
                 inventory: DataFrame) -> dict[str, DataFrame]:
    """REP9 for requested receipts (order_id, user_id): ``receipts`` of the orders that belong to the
    requesting user, and ``rejects`` with "Order not found" for the others."""
    owned = orders.select(F.col("id").alias("order_id"), "user_id")
    found = requests.select("order_id", "user_id").join(owned, ["order_id", "user_id"], "left_semi").distinct()
    rejects = (requests.join(owned, ["order_id", "user_id"], "left_anti").withColumn("message", F.lit(ORDER_NOT_FOUND)))
    keys = found.select("order_id")
    chosen = orders.join(keys.withColumnRenamed("order_id", "id"), "id", "left_semi")
    return {"receipts": receipts(chosen, users, payments.join(keys, "order_id", "left_semi"),
                                 items.join(keys, "order_id", "left_semi"), inventory), "rejects": rejects}


def receipts(orders: DataFrame, users: DataFrame, payments: DataFrame, items: DataFrame,
             inventory: DataFrame) -> DataFrame:
    """REP9 (flat): one row per receipt line: order, customer contact, payment reference
    and the line with its product name. Orders without lines keep one row with null line."""
    head = receipt_headers(orders, users, payments)
    lines = order_lines(items, inventory).drop("image").withColumnRenamed("order_id", "id")
    return head.join(lines.withColumnRenamed("quantity", "item_quantity"), "id", "left")


def admin_orders(orders: DataFrame, tracking: DataFrame, users: DataFrame, items: DataFrame, inventory: DataFrame,
                 status: str | None = None, dates=None, ordered: bool = True) -> dict[str, DataFrame]:
    """REP10: the admin order list. ``orders``: every order with current status, customer name and
    phone, filtered by current status and created date (FIL2), newest first; ``items`` and
    ``tracking``: the lines and the timeline of these orders."""
    contact = users.select(F.col("id").alias("user_id"), F.col("full_name").alias("customer_name"),
                           F.col("phone").alias("customer_phone"))
    in_dates = filter_orders(orders, None, dates)
    recent = tracking.join(in_dates.select(F.col("id").alias("order_id")), "order_id", "left_semi")
    out = filter_orders(current_status(in_dates, recent), status, None, status_col="current_status")
    lines, track = _of_orders(out, items, inventory, recent)
    listed = out.join(contact, "user_id", "left")
    if ordered:
        listed = listed.orderBy(*newest_orders())
        track = track.orderBy(*newest_tracking())
    return {"orders": listed, "items": lines, "tracking": track}
