"""Table-wide change jobs: CHG1 (product add / update), CHG2 (product delete),
CHG8 (order status updates) and CHG9 (sign-ups).

Each job takes the current table(s) and a table of requests and returns the new
rows or the new table plus a ``rejects`` DataFrame carrying the reference's
message. Nothing is updated in place: callers write the result as a new snapshot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..core import Outputs, max_id, sequence_ids
from ..functions.exprs import clean_phone, valid_signup_phone
from ..sources.schemas import MONEY, ORDER_STATUSES, TRACKING_STATUSES
from .joins import deletable

# The messages and notes the reference writes (others are ours, in its style).
INVALID_ACTION = "Invalid action"
PRODUCT_NOT_FOUND = "Product not found"
ADD_FAILED = "Failed to add product"
UPDATE_FAILED = "Failed to update product"
HAS_SALES = "Cannot delete product with sales history"
ORDER_NOT_FOUND = "Order not found"
INVALID_STATUS = "Invalid status"
EMAIL_TAKEN = "Email already exists"
FILL_ALL = "Please fill in all fields"
BAD_PHONE = "Please enter a valid 10-digit phone number"
BAD_ROLE = "Invalid role"
SIGNUP_ROLES = ["customer", "admin"]


def apply_product_changes(inventory: DataFrame, requests: DataFrame, base_id: int | None = None) -> dict[str, DataFrame]:
    """CHG1. requests: request_id, action ('add' | 'update'), product_id (for updates), name, price,
    quantity, description, image, requested_at.

    Updates of one product apply in time order: name, price, quantity and description
    come from the latest one; the image from the latest one that gives an image
    (null, "" and "0" give none), else the old image stays; adds store the image as given. An unknown id changes nothing (refused with "Product
    not found"). Adds get new ids after the largest id. A missing name, price or
    quantity, or a negative price or stock, is refused, and so is an action that is
    neither of the two or null: every request ends applied or refused.
    """
    req = requests.select("request_id", "action", "product_id", "name", "price", "quantity", "description",
                          "image", "requested_at")
    incomplete = (F.col("name").isNull() | (F.trim(F.col("name")) == "") | F.col("price").isNull()
                  | F.col("quantity").isNull() | (F.col("price") < 0) | (F.col("quantity") < 0))
    known = inventory.select(F.col("id").alias("product_id"), F.lit(True).alias("_known"))
    marked = req.join(known, "product_id", "left").withColumn(
        "message",
        F.when(~F.coalesce(F.col("action").isin("add", "update"), F.lit(False)), F.lit(INVALID_ACTION))
        .when((F.col("action") == "update") & F.col("_known").isNull(), PRODUCT_NOT_FOUND)
        .when(incomplete & (F.col("action") == "add"), ADD_FAILED)
        .when(incomplete, UPDATE_FAILED))
    rejects = marked.where(F.col("message").isNotNull()).select(*req.columns, "message")
    ok = marked.where(F.col("message").isNull()).drop("_known", "message")

    order = F.struct("requested_at", "request_id")
    # an update sets the image only when one is given: null, "" and "0" keep the old one
    image_set = F.when(F.col("image").isNotNull() & ~F.col("image").isin("", "0"), F.col("image"))
    latest = (ok.where(F.col("action") == "update").groupBy("product_id").agg(
        F.max_by(F.struct("name", "price", "quantity", "description"), order).alias("_u"),
        F.max_by(image_set, F.when(image_set.isNotNull(), order)).alias("_img"),
        F.max("requested_at").alias("_at")))
    updated = (inventory.join(latest.withColumnRenamed("product_id", "id"), "id", "left")
               .select("id",
                       F.coalesce(F.col("_u.name"), F.col("name")).alias("name"),
                       F.coalesce(F.col("_u.description"), F.col("description")).alias("description"),
                       F.coalesce(F.col("_u.price").cast(MONEY), F.col("price")).alias("price"),
                       F.coalesce(F.col("_u.quantity").cast("int"), F.col("quantity")).alias("quantity"),
                       F.coalesce(F.col("_img"), F.col("image")).alias("image"),
                       "created_at",
                       F.coalesce(F.col("_at"), F.col("updated_at")).alias("updated_at")))

    def adds():
        start = base_id if base_id is not None else max_id(inventory)
        return sequence_ids(ok.where(F.col("action") == "add"), ["requested_at", "request_id"], start).select(
            "id", "name", "description", F.col("price").cast(MONEY).alias("price"),
            F.col("quantity").cast("int").alias("quantity"), "image",
            F.col("requested_at").alias("created_at"), F.col("requested_at").alias("updated_at"))

    out = Outputs(added=adds, inventory=lambda: updated.unionByName(out["added"]), rejects=lambda: rejects)
    return out


def apply_product_deletes(inventory: DataFrame, sales: DataFrame, requests: DataFrame) -> dict[str, DataFrame]:
    """CHG2. requests: request_id, product_id. A product with any sale is kept and the request
    refused ("Cannot delete product with sales history"); others are removed. Deleting an
    unknown id does nothing and is not an error, as in the reference."""
    req = requests.select("request_id", "product_id")
    free = deletable(req, sales)
    refused = req.join(free.select("request_id"), "request_id", "left_anti").withColumn("message", F.lit(HAS_SALES))
    gone = free.select(F.col("product_id").alias("id")).distinct()
    return Outputs(inventory=lambda: inventory.join(gone, "id", "left_anti"), deleted=lambda: free,
                   rejects=lambda: refused)


def apply_status_updates(orders: DataFrame, tracking: DataFrame, requests: DataFrame,
                         base_tracking_id: int | None = None) -> dict[str, DataFrame]:
    """CHG8. requests: request_id, order_ids (array of ids; one id for a single update), status,
    notes, requested_at.

    Each (request, order) pair: an unknown order is refused; a status known to
    neither the order nor the tracking list, or null, is refused. A tracking status appends a
    tracking row; an order status also becomes the order's status (the latest
    request wins). 'pending' exists for orders only: order status set, no tracking row.
    """
    pairs = requests.select("request_id", F.explode_outer("order_ids").alias("order_id"), "status", "notes",
                            "requested_at")
    known = orders.select(F.col("id").alias("order_id"), F.lit(True).alias("_known"))
    marked = pairs.join(known, "order_id", "left").withColumn(
        "message",
        F.when(F.col("_known").isNull(), ORDER_NOT_FOUND)
        .when(~F.coalesce(F.col("status").isin(TRACKING_STATUSES + ORDER_STATUSES), F.lit(False)), INVALID_STATUS))
    rejects = marked.where(F.col("message").isNotNull()).drop("_known")
    ok = marked.where(F.col("message").isNull()).drop("_known", "message")

    def new_tracking():
        start = base_tracking_id if base_tracking_id is not None else max_id(tracking)
        return sequence_ids(ok.where(F.col("status").isin(TRACKING_STATUSES)),
                            ["requested_at", "request_id", "order_id"], start).select(
            "id", "order_id", "status", F.lit(None).cast("string").alias("location"), "notes",
            F.col("requested_at").alias("created_at"))

    last = (ok.where(F.col("status").isin(ORDER_STATUSES)).groupBy("order_id")
            .agg(F.max_by("status", F.struct("requested_at", "request_id")).alias("_status"),
                 F.max("requested_at").alias("_at")))
    new_orders = (orders.join(last.withColumnRenamed("order_id", "id"), "id", "left")
                  .withColumn("status", F.coalesce("_status", "status"))
                  .withColumn("updated_at", F.coalesce("_at", "updated_at"))
                  .drop("_status", "_at"))
    return Outputs(orders=lambda: new_orders, order_tracking=new_tracking, rejects=lambda: rejects)


def accept_signups(users: DataFrame, requests: DataFrame, base_id: int | None = None) -> dict[str, DataFrame]:
    """CHG9 / JOIN10. requests: request_id, full_name, email, phone, role, requested_at.

    Refused: a missing field; a phone that is not ten digits once cleaned; a role
    other than customer or admin; an email already taken (compared in lower case,
    against the table and, within the batch, against earlier requests: the first
    request wins). Accepted rows get new ids after the largest id; phone and email
    are kept as typed; no password column exists.
    """
    req = requests.select("request_id", "full_name", "email", "phone", "role", "requested_at")
    missing = F.lit(False)
    for c in ["full_name", "email", "phone"]:
        missing = missing | F.col(c).isNull() | (F.trim(F.col(c)) == "")
    pre = req.withColumn("message", F.when(missing, FILL_ALL)
                         .when(~valid_signup_phone("phone"), BAD_PHONE)
                         .when(~F.coalesce(F.col("role").isin(SIGNUP_ROLES), F.lit(False)), BAD_ROLE))
    valid = pre.where(F.col("message").isNull()).withColumn("_email", F.lower(F.trim("email")))
    taken = users.select(F.lower(F.trim("email")).alias("_email"))
    fresh = valid.join(taken, "_email", "left_anti")
    # the first request per email, whole, as a partial aggregate (no join back on the email)
    winners = (fresh.groupBy("_email")
               .agg(F.min(F.struct("requested_at", "request_id", "full_name", "email", "phone", "role"))
                    .alias("_first"))
               .select("_email", "_first.*"))
    losers = (valid.join(winners.select("request_id"), "request_id", "left_anti")
              .withColumn("message", F.lit(EMAIL_TAKEN)).drop("_email"))
    rejects = pre.where(F.col("message").isNotNull()).unionByName(losers)

    def new_users():
        start = base_id if base_id is not None else max_id(users)
        return sequence_ids(winners, ["requested_at", "request_id"], start).select(
            "id", "full_name", "email", "phone", "role", F.col("requested_at").alias("created_at"),
            clean_phone("phone").alias("phone_digits"), "request_id")

    return Outputs(users=new_users, rejects=lambda: rejects)
