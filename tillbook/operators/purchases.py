"""CHG3: apply a whole table of purchase requests against stock, in time order per product.

Rule (one request at a time, per product): an unknown product is refused; a product whose stock is
not known (NULL) has none to sell, so its requests are refused and its stock stays NULL; a
request larger than the stock left is refused and *later smaller ones may still
pass*; otherwise the stock falls and a sale of price x quantity is recorded.

That is a greedy fold, and a prefix sum alone is wrong after the first refusal.
It is computed exactly, all in Spark:

1. Round 1 is a running total in time order (per product and range slice, see ``running``; a request
   larger than the whole stock adds nothing to it and is refused). Rows whose running total fits are accepted; the first
   that does not fit is refused; what follows it waits.
2. In every later round, requests larger than the stock left are refused at once, in all slices: stock never
   rises. Of each product the first slice that still holds a request that fits is folded whole, one request after
   another, over its sorted array (at most ``rows_per_slice`` rows, in two levels, in time linear in the rows). Its product's stock falls, and the later slices wait.

A round settles one slice of every product, so there are at most as many rounds as the busiest product has slices, plus
one, whatever the quantities; most products have one or two slices. A hot product is spread over its slices, and its price,
stock and used units reach its rows through the (product, slice) keys, so no task ever holds the whole
product.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core import cut_lineage
from ..functions.exprs import subtotal
from .running import running_sum, with_range_slices

# The messages and notes the reference writes (others are ours, in its style).
INVALID_QUANTITY = "Invalid quantity"
PRODUCT_NOT_FOUND = "Product not found"
INSUFFICIENT = "Insufficient quantity available"

MESSAGES = {"invalid": INVALID_QUANTITY, "unknown": PRODUCT_NOT_FOUND, "refused": INSUFFICIENT}

ORDER = ["requested_at", "request_id"]
#: Rows that are folded at once inside a slice; near the root of the rows of a slice, so that both levels copy little.
BLOCK = 256


def _per_slice(rows: DataFrame, per_product: DataFrame) -> DataFrame:
    """Per-product values spread onto the (product, slice) keys present in ``rows``: a small
    table (one row per slice) that then joins the rows on both columns."""
    keys = rows.select("product_id", "_slice").distinct()
    return keys.join(per_product, "product_id", "left")


def _accepted(quantities: Column, left: Column) -> Column:
    """One boolean per quantity: does it still fit, taken in order, into what the accepted ones before it left of ``left``?

    Folded in two levels, because an array that grows by one entry is copied at each step: the flags of a block of
    ``BLOCK`` quantities are gathered first, then joined to those of the blocks before. The time of a row does not grow with the array.
    """
    start = lambda rest: F.struct(rest.alias("left"), F.array().cast("array<boolean>").alias("flags"))

    def one(state: Column, quantity: Column) -> Column:
        fits = quantity <= state["left"]
        return F.struct(F.when(fits, state["left"] - quantity).otherwise(state["left"]).alias("left"),
                        F.concat(state["flags"], F.array(fits)).alias("flags"))

    def block(state: Column, quantities: Column) -> Column:
        done = F.aggregate(quantities, start(state["left"]), one)
        # the block's result is needed twice: a one-entry array keeps it from being folded twice
        return F.transform(F.array(done), lambda d: F.struct(
            d["left"].alias("left"), F.concat(state["blocks"], F.array(d["flags"])).alias("blocks")))[0]

    n_blocks = F.ceil(F.size(quantities) / F.lit(BLOCK)).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), n_blocks - 1), lambda k: F.slice(quantities, k * BLOCK + 1, BLOCK))
    first = F.struct(left.alias("left"), F.array().cast("array<array<boolean>>").alias("blocks"))
    return F.flatten(F.aggregate(blocks, first, block)["blocks"])


def _fold_slices(rows: DataFrame, cols: list[str]) -> DataFrame:
    """Whole slices (product_id, _slice) folded in time order: the rows with ``_outcome`` accepted or refused."""
    items = F.sort_array(F.collect_list(F.struct(*ORDER, *[c for c in cols if c not in ORDER + ["product_id"]], "price")))
    folded = (rows.groupBy("product_id", "_slice").agg(items.alias("items"), F.first("left").alias("left"))
              .withColumn("quantities", F.transform("items", lambda x: x["quantity"]))
              .withColumn("fits", _accepted(F.col("quantities"), F.col("left"))))
    out = folded.select("product_id", "_slice", "left", F.explode(F.arrays_zip("items", "fits")).alias("r"))
    outcome = F.when(F.col("r.fits"), "accepted").otherwise("refused").alias("_outcome")
    return out.select(*[F.col(c) if c == "product_id" else F.col(f"r.items.{c}") for c in cols], "r.items.price", "left", "_slice", outcome)


def apply_purchases(inventory: DataFrame, requests: DataFrame, slices: int | None = None,
                    rows_per_slice: int = 100_000) -> dict[str, DataFrame]:
    """requests: request_id, user_id, product_id, quantity, requested_at (request_id unique, orderable).

    Returns ``sales`` (accepted: request_id, user_id, product_id, quantity, total_amount,
    transaction_date), ``rejects`` (the request plus ``message``), ``inventory`` (stock
    lowered) and ``rounds`` (a one-row DataFrame with the round count). ``slices`` is the
    number of sampled ranges the requests are cut into (default: the shuffle partitions);
    each range is cut further into chunks of ``rows_per_slice`` rows.
    """
    cols = ["request_id", "user_id", "product_id", "quantity", "requested_at"]
    spark = requests.sparkSession
    n = slices or max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    # Slice the requests once (written, so the slice numbers stay fixed). Every per-product value
    # (price, stock, used units) reaches the rows through the (product, slice) keys, so even a
    # product with a third of all requests is joined slice by slice, never in one task.
    sliced = cut_lineage(with_range_slices(requests.select(*cols), "product_id", ORDER, n, rows_per_slice),
                         "purchases")
    products = inventory.select(F.col("id").alias("product_id"), "price",
                                F.coalesce(F.col("quantity").cast("long"), F.lit(0)).alias("left"), F.lit(True).alias("_known"))
    # requests that name no product are refused without any join
    nameless = sliced.where(F.col("product_id").isNull())
    sliced = sliced.where(F.col("product_id").isNotNull())
    marked = sliced.join(_per_slice(sliced, products), ["product_id", "_slice"], "left")
    bad_qty = F.col("quantity").isNull() | (F.col("quantity") < 1)
    # requests that are refused at once are kept with the labelled rows, so the join that finds them runs once; the others wait,
    # and every waiting row carries its product's stock left ("left"), lowered after each round
    early = F.when(bad_qty, F.lit("invalid")).when(F.col("_known").isNull(), F.lit("unknown"))
    pending = marked.select(*cols, "price", "left", "_slice", early.alias("_early"))

    # round 1: running totals; a request that is refused at once, or larger than the stock, adds nothing
    fits = F.col("quantity") <= F.col("left")
    counted = pending.withColumn("_fit", F.when(F.col("_early").isNull() & fits, F.col("quantity")).otherwise(F.lit(0)))
    run = running_sum(counted, "product_id", ORDER, "_fit", "_run", "_slice")
    outcome = (F.when(F.col("_early").isNotNull(), F.col("_early"))
               .when(~fits, "refused")
               .when(F.col("_run") <= F.col("left"), "accepted")
               .when(F.col("_run") - F.col("quantity") <= F.col("left"), "refused")
               .otherwise("pending"))
    labelled = cut_lineage(run.withColumn("_outcome", outcome).drop("_run", "_fit", "_early"), "purchases")
    done, rounds = [], 1
    while True:
        done.append(labelled.where(F.col("_outcome") != "pending"))
        used = (labelled.where(F.col("_outcome") == "accepted").groupBy("product_id")
                .agg(F.sum("quantity").cast("long").alias("_used")))
        waiting = labelled.where(F.col("_outcome") == "pending").drop("_outcome")
        if waiting.isEmpty():
            break
        # the first slice of each product that still holds a request that fits, found from the least quantity of each slice; the
        # rows then meet their product's used units and that slice in one join
        least = waiting.groupBy("product_id", "_slice", "left").agg(F.min("quantity").alias("_least")).join(used, "product_id", "left")
        some = F.col("_least") <= F.col("left") - F.coalesce("_used", F.lit(0))
        per_slice = least.groupBy("product_id", "_slice").agg(F.max(F.when(some, 1)).alias("_some"), F.first("_used").alias("_used"))
        first = per_slice.where("_some = 1").groupBy("product_id").agg(F.min("_slice").alias("_first"))
        turn = per_slice.join(first, "product_id", "left").select("product_id", "_slice", "_used", "_first")
        placed = (waiting.join(turn, ["product_id", "_slice"], "left")
                  .withColumn("left", F.col("left") - F.coalesce("_used", F.lit(0))).drop("_used"))
        now = placed.where(fits & (F.col("_slice") == F.col("_first"))).drop("_first")
        rest = (placed.where(~fits | (F.col("_slice") != F.col("_first"))).drop("_first")
                .withColumn("_outcome", F.when(~fits, "refused").otherwise("pending")))
        labelled = cut_lineage(_fold_slices(now, cols).unionByName(rest), "purchases")
        rounds += 1

    resolved = reduce(DataFrame.unionByName, done)
    accepted = resolved.where(F.col("_outcome") == "accepted")
    sales = accepted.select(
        "request_id", "user_id", "product_id", "quantity",
        subtotal("quantity", "price").alias("total_amount"), F.col("requested_at").alias("transaction_date"))
    message = F.create_map(*[F.lit(x) for pair in MESSAGES.items() for x in pair])
    unsold = (resolved.where(F.col("_outcome") != "accepted").select(*cols, "_outcome")
              .unionByName(nameless.select(*cols, F.when(bad_qty, "invalid").otherwise("unknown").alias("_outcome"))))
    rejects = unsold.select(*cols, message[F.col("_outcome")].alias("message"))
    # stock only ever falls by accepted quantities
    taken = accepted.groupBy(F.col("product_id").alias("id")).agg(F.sum("quantity").cast("long").alias("_taken"))
    new_inventory = (inventory.join(taken, "id", "left")
                     .withColumn("quantity", (F.col("quantity") - F.coalesce("_taken", F.lit(0))).cast("int"))
                     .drop("_taken"))
    return {"sales": sales, "rejects": rejects, "inventory": new_inventory,
            "rounds": spark.range(1).select(F.lit(rounds).alias("rounds"))}
