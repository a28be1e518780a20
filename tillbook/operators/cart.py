"""CHG4 (cart state from cart events) and CHG5 (checkout of whole carts).

Cart rules, per (user, product), in event order: *add* sums into the line (or
opens it); *set* replaces the quantity only when the line is there; *remove*
deletes the line; *checkout* clears every line of the user.

Closed form used here (no per-key window, no expansion of a checkout into one
row per product): the last clearing event of a line is the later of its last
remove and its user's last checkout; the line exists iff an add follows it;
sets before that first add found no line; the quantity is the last set after
the first add plus the adds after that set, or else all adds after the clear.

Each step is a groupBy with map-side partial aggregation. The per-line and per-user results reach
the adds through (user, product, salt) keys, and the adds are summed per key before they meet per line, so a
single line with a huge share of events is spread over the salts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..core import Outputs, max_id, sequence_ids
from .joins import SUM_MONEY, cart_lines

# The messages and notes the reference writes (others are ours, in its style).
CART_EMPTY = "Cart is empty"
BAD_QUANTITY = "Please select a valid quantity"
ACTIONS = ["add", "set", "remove", "checkout"]

#: One line's events are joined in so many parts.
LINE_SALTS = 32


def _k(prefix: str = ""):
    return F.struct(F.col(prefix + "event_time").alias("t"), F.col(prefix + "event_id").alias("i"))


def fold_cart(events: DataFrame) -> dict[str, DataFrame]:
    """events: event_id, user_id, product_id, action, quantity, event_time.

    Returns ``cart`` (user_id, product_id, quantity, created_at, updated_at) and
    ``rejects`` (events with an unknown action or a quantity below 1).

    Two aggregation passes. Pass 1, per line: last remove, last set (and its
    quantity); per user: last checkout. The line was last cleared at R = the later
    of its last remove and its user's last checkout. Pass 2 joins that to the adds
    and, per line: A = first add after R (the line exists iff there is one), the
    adds after R, and the adds after the last set S. When S is after A the
    quantity is S's quantity plus the adds after S (a set after the line opened
    replaces it); otherwise every set came before A and found no line, so the
    quantity is the sum of the adds after R.
    """
    ev = events.select("event_id", "user_id", "product_id", "action", "quantity", "event_time")
    bad = (~F.col("action").isin(ACTIONS)) | F.col("action").isNull() | (
        F.col("action").isin("add", "set") & (F.col("quantity").isNull() | (F.col("quantity") < 1)))
    rejects = ev.where(bad).withColumn("message", F.lit(BAD_QUANTITY))
    ev = ev.where(~bad).withColumn("k", _k())
    act = F.col("action")

    per_line = (ev.where(act.isin("remove", "set")).groupBy("user_id", "product_id").agg(
        F.max(F.when(act == "remove", F.col("k"))).alias("_rm"),
        F.max(F.when(act == "set", F.col("k"))).alias("_set"),
        F.max_by(F.when(act == "set", F.col("quantity")), F.when(act == "set", F.col("k"))).alias("_set_qty")))
    per_user = ev.where(act == "checkout").groupBy("user_id").agg(F.max("k").alias("_co"))

    salt = F.pmod(F.xxhash64("event_id"), F.lit(LINE_SALTS)).alias("_salt")
    added = ev.where(act == "add").select("user_id", "product_id", salt, "quantity", "k")
    # the per-line and per-user values meet the small table of salted line keys first
    lines_info = (added.select("user_id", "product_id", "_salt").distinct()
                  .join(per_line, ["user_id", "product_id"], "left")
                  .join(per_user, "user_id", "left"))
    adds = (added.join(lines_info, ["user_id", "product_id", "_salt"], "left")
            .withColumn("_cleared", F.greatest("_rm", "_co")))
    live = F.col("_cleared").isNull() | (F.col("k") > F.col("_cleared"))
    after_set = F.col("_set").isNotNull() & (F.col("k") > F.col("_set"))
    lines = adds.groupBy("user_id", "product_id").agg(
        F.min(F.when(live, F.col("k"))).alias("_first_add"),
        F.sum(F.when(live, F.col("quantity"))).cast("long").alias("_adds_live"),
        F.max(F.when(live, F.col("k"))).alias("_last_live"),
        F.sum(F.when(after_set, F.col("quantity"))).cast("long").alias("_adds_after_set"),
        F.max(F.when(after_set, F.col("k"))).alias("_last_after_set"),
        F.max("_set").alias("_set"), F.max("_set_qty").alias("_set_qty"))
    set_counts = F.col("_set").isNotNull() & (F.col("_set") > F.col("_first_add"))
    cart = lines.where(F.col("_first_add").isNotNull()).select(
        "user_id", "product_id",
        F.when(set_counts, F.col("_set_qty") + F.coalesce("_adds_after_set", F.lit(0)))
         .otherwise(F.col("_adds_live")).cast("int").alias("quantity"),
        F.col("_first_add")["t"].alias("created_at"),
        F.when(set_counts, F.greatest("_set", "_last_after_set"))
         .otherwise(F.col("_last_live"))["t"].alias("updated_at"))
    return {"cart": cart, "rejects": rejects}


def checkout(cart: DataFrame, inventory: DataFrame, requests: DataFrame, orders: DataFrame | None = None,
             tracking: DataFrame | None = None, base_ids: dict | None = None) -> dict[str, DataFrame]:
    """CHG5. requests: request_id, user_id, delivery_address, requested_at.

    Per user, the first request (by time, then id) takes the whole cart: one order
    (total = sum of line subtotals at today's price, status pending), its items,
    a tracking row ``order_placed``; the cart of that user is cleared. A user with
    no cart lines (lines of deleted products do not count) and every later request
    of the same user are refused with "Cart is empty". New ids continue after the
    largest existing id (``base_ids`` may pin them).
    """
    base_ids = dict(base_ids or {})
    ids = Outputs(
        orders=lambda: base_ids["orders"] if "orders" in base_ids else (max_id(orders) if orders is not None else 0),
        tracking=lambda: base_ids["tracking"] if "tracking" in base_ids else (
            max_id(tracking) if tracking is not None else 0),
        order_items=lambda: base_ids.get("order_items", 0))

    lines = cart_lines(cart, inventory)
    totals = lines.groupBy("user_id").agg(F.sum("subtotal").cast(SUM_MONEY).alias("_total"))
    req = requests.select("request_id", "user_id", "delivery_address", "requested_at")
    # the first request of each user, whole, as a partial aggregate (no join back on the user)
    first = (req.groupBy("user_id")
             .agg(F.min(F.struct("requested_at", "request_id", "delivery_address")).alias("_first"))
             .select("user_id", "_first.*"))
    placed = first.join(totals, "user_id")

    def new_orders():
        return sequence_ids(placed, ["requested_at", "request_id"], ids["orders"]).select(
            "id", "user_id", F.col("_total").cast("decimal(10,2)").alias("total_amount"),
            F.lit("pending").alias("status"), "delivery_address",
            F.col("requested_at").alias("created_at"), F.col("requested_at").alias("updated_at"), "request_id")

    def order_of_user():
        return out["orders"].select(F.col("id").alias("order_id"), "user_id")

    def items():
        return sequence_ids(
            lines.join(order_of_user(), "user_id").select(
                "order_id", "product_id", "quantity", F.col("price").alias("price_per_unit"), "subtotal"),
            ["order_id", "product_id"], ids["order_items"])

    def new_tracking():
        # order ids are dense (base+1 .. base+n), so the tracking ids follow them one to one
        return out["orders"].select(
            (F.col("id") - F.lit(ids["orders"]) + F.lit(ids["tracking"])).alias("id"),
            F.col("id").alias("order_id"), F.lit("order_placed").alias("status"),
            F.lit(None).cast("string").alias("location"),
            F.lit("Order has been placed successfully").alias("notes"), "created_at")

    def refused():
        return (req.join(placed.select("request_id"), "request_id", "left_anti")
                .select("request_id", "user_id", "delivery_address", "requested_at")
                .withColumn("message", F.lit(CART_EMPTY)))

    out = Outputs(orders=new_orders, order_items=items, order_tracking=new_tracking,
                  cart=lambda: cart.join(placed.select("user_id"), "user_id", "left_anti"), rejects=refused)
    return out
