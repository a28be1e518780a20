"""CHG6 (open payments for orders) and CHG7 (apply payment confirmations), plus JOIN11.

The reference opens one mobile payment per request and marks it paid right
away; here both halves run over tables: a table of payment requests and a
table of confirmations from the payment provider.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..core import Outputs, max_id, sequence_ids
from ..functions.exprs import payment_ref, valid_payment_phone

# The messages and notes the reference writes (others are ours, in its style).
ORDER_NOT_FOUND = "Order not found"
BAD_PHONE = "Please enter a valid 10-digit phone number"
TX_NOT_FOUND = "Transaction not found"
ALREADY_DONE = "Payment already processed"
DUPLICATE = "Duplicate confirmation"
NO_RESULT = "Missing result code"
PAID_NOTE = "Payment confirmed via M-Pesa"


def open_payments(orders: DataFrame, requests: DataFrame, payments: DataFrame | None = None,
                  base_id: int | None = None) -> dict[str, DataFrame]:
    """CHG6. requests: request_id, order_id, user_id, phone_number, requested_at.

    The order must belong to the requesting user ("Order not found" otherwise) and
    the phone must be ten digits. A new pending payment carries the order total
    and a reference built from order id and request time (EXP12) and its own id, so that
    two requests for one order in one second differ.
    """
    req = requests.select("request_id", "order_id", "user_id", "phone_number", "requested_at")
    owned = orders.select(F.col("id").alias("order_id"), "user_id", F.col("total_amount").alias("amount"))
    joined = req.join(owned, ["order_id", "user_id"], "left")
    message = (F.when(~valid_payment_phone("phone_number"), BAD_PHONE)
               .when(F.col("amount").isNull(), ORDER_NOT_FOUND))
    marked = joined.withColumn("message", message)
    rejects = marked.where(F.col("message").isNotNull()).select(
        "request_id", "order_id", "user_id", "phone_number", "requested_at", "message")
    ok = marked.where(F.col("message").isNull())

    def new_payments():
        start = base_id if base_id is not None else (max_id(payments) if payments is not None else 0)
        return sequence_ids(ok, ["requested_at", "request_id"], start).select(
            "id", "order_id", F.concat(payment_ref("order_id", "requested_at"), F.lit("-"), F.col("id")).alias("transaction_id"),
            "phone_number",
            "amount", F.lit("pending").alias("status"), F.lit(None).cast("string").alias("result_code"),
            F.lit(None).cast("string").alias("result_desc"), F.col("requested_at").alias("created_at"),
            F.lit(None).cast("timestamp_ntz").alias("completed_at"), "request_id")

    return Outputs(payments=new_payments, rejects=lambda: rejects)


def apply_payments(payments: DataFrame, orders: DataFrame, tracking: DataFrame, confirmations: DataFrame,
                   base_tracking_id: int | None = None) -> dict[str, DataFrame]:
    """CHG7. confirmations: confirmation_id (unique), transaction_id, result_code, result_desc, confirmed_at.

    A confirmation without a result code is refused and does not count as the first one. The first confirmation of a pending payment applies: code '0' completes it
    (its order becomes processing, and a tracking row payment_received is
    written), any other code fails it. Unknown transactions, payments no longer
    pending and repeated confirmations are refused.
    """
    conf = confirmations.select("confirmation_id", "transaction_id", "result_code", "result_desc", "confirmed_at")
    # the first confirmation of each transaction (partial aggregate); the others are repeats
    first = (conf.where(F.col("result_code").isNotNull()).groupBy("transaction_id")
             .agg(F.min(F.struct("confirmed_at", "confirmation_id")).alias("_first"))
             .select(F.col("_first.confirmation_id").alias("confirmation_id"), F.lit(True).alias("_is_first")))
    pay = payments.select("transaction_id", F.col("status").alias("_pay_status"), F.col("order_id").alias("_order"))
    marked = (conf.join(first, "confirmation_id", "left").join(pay, "transaction_id", "left")
              .withColumn("message",
                          F.when(F.col("result_code").isNull(), NO_RESULT)
                          .when(F.col("_pay_status").isNull(), TX_NOT_FOUND)
                          .when(F.col("_pay_status") != "pending", ALREADY_DONE)
                          .when(F.col("_is_first").isNull(), DUPLICATE)))
    rejects = marked.where(F.col("message").isNotNull()).select(
        "confirmation_id", "transaction_id", "result_code", "confirmed_at", "message")
    applied = marked.where(F.col("message").isNull()).select(
        "transaction_id", "result_code", "result_desc", "confirmed_at", F.col("_order").alias("order_id"),
        (F.col("result_code") == "0").alias("_ok"))

    upd = applied.select("transaction_id", F.col("result_code").alias("_code"), F.col("result_desc").alias("_desc"),
                         F.col("confirmed_at").alias("_at"), "_ok")
    new_payments = (payments.join(upd, "transaction_id", "left")
                    .withColumn("status", F.when(F.col("_ok"), "completed").when(~F.col("_ok"), "failed")
                                .otherwise(F.col("status")))
                    .withColumn("result_code", F.coalesce("_code", "result_code"))
                    .withColumn("result_desc", F.coalesce("_desc", "result_desc"))
                    .withColumn("completed_at", F.when(F.col("_ok"), F.col("_at")).otherwise(F.col("completed_at")))
                    .drop("_code", "_desc", "_at", "_ok"))
    paid = applied.where("_ok")

    def new_tracking():
        start = base_tracking_id if base_tracking_id is not None else max_id(tracking)
        return sequence_ids(paid.select("order_id", "confirmed_at", "transaction_id"),
                            ["confirmed_at", "transaction_id"], start).select(
            "id", "order_id", F.lit("payment_received").alias("status"),
            F.lit(None).cast("string").alias("location"),
            F.lit(PAID_NOTE).alias("notes"), F.col("confirmed_at").alias("created_at"))

    return Outputs(payments=lambda: new_payments, orders=lambda: orders_paid(orders, paid),
                   order_tracking=new_tracking, rejects=lambda: rejects)


def orders_paid(orders: DataFrame, paid: DataFrame) -> DataFrame:
    """JOIN11: orders with a completed payment become processing (UPDATE ... JOIN as a left join);
    updated_at is the latest confirmation. Several payments of one order are combined first."""
    per_order = paid.groupBy("order_id").agg(F.max("confirmed_at").alias("_paid_at"))
    return (orders.join(per_order.withColumnRenamed("order_id", "id"), "id", "left")
            .withColumn("status", F.when(F.col("_paid_at").isNotNull(), "processing").otherwise(F.col("status")))
            .withColumn("updated_at", F.coalesce(F.col("_paid_at"), F.col("updated_at")))
            .drop("_paid_at"))
