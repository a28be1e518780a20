"""Change jobs and look-ups over tables kept in buckets (``sinks.buckets``).

The change jobs of ``operators`` take whole tables. Here a batch of requests reads only the buckets its keys fall into, runs the
same job on them and commits only them: CHG1, CHG2, CHG7 and CHG8 write in proportion to what a batch touches. New rows (added
products, tracking rows) are appended to their buckets, whose other rows are not read. Ids go on from the largest id kept in the manifest.

A ``batch`` name makes a job safe to run again after a failure: a table whose newest version was made by that batch is left as it is.

Tracking and order lines kept in buckets of the order id make REP8, REP10 and WIN1 look-ups: a selection of orders reads the
buckets of its ids, not the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..core import cut_lineage
from ..operators.aggregates import current_status
from ..operators.changes import apply_product_changes, apply_product_deletes, apply_status_updates
from ..operators.filters import for_user
from ..operators.payments import apply_payments
from ..sinks.buckets import BucketTable
from .orders import order_history


def change_products(inventory: BucketTable, requests: DataFrame, batch: str | None = None) -> DataFrame:
    """CHG1 on a kept inventory (buckets of ``id``); returns the rejects."""
    version = inventory.version()
    touched = inventory.of(requests.where((F.col("action") == "update") & F.col("product_id").isNotNull()), "product_id")
    out = apply_product_changes(inventory.read(touched, version), requests, base_id=version.max_id)
    rejects = cut_lineage(out["rejects"], "rejects")  # made from the version that is about to be replaced
    inventory.commit(out["inventory"], touched, batch)
    return rejects


def delete_products(inventory: BucketTable, sales: DataFrame, requests: DataFrame, batch: str | None = None) -> DataFrame:
    """CHG2 on a kept inventory; returns the rejects."""
    touched = inventory.of(requests.where("product_id is not null"), "product_id")
    out = apply_product_deletes(inventory.read(touched), sales, requests)
    rejects = cut_lineage(out["rejects"], "rejects")
    inventory.commit(out["inventory"], touched, batch)
    return rejects


def confirm_payments(payments: BucketTable, orders: BucketTable, tracking: BucketTable, confirmations: DataFrame,
                     batch: str | None = None) -> DataFrame:
    """CHG7 on kept payments (buckets of ``transaction_id``), orders (of ``id``) and tracking (of ``order_id``); returns the rejects.

    Three tables are committed one after another, payments last, so a batch that stopped half-way still finds its
    payments pending. Run again under the same ``batch`` name it skips the tables that already have it.
    """
    paid_in = payments.of(confirmations.where("transaction_id is not null"), "transaction_id")
    asked = payments.read(paid_in)
    named = asked.join(confirmations.select("transaction_id").distinct(), "transaction_id", "left_semi")
    ordered = orders.of(named.where("order_id is not null"), "order_id")
    log = tracking.version()
    out = apply_payments(asked, orders.read(ordered), tracking.read([], log), confirmations, base_tracking_id=log.max_id)
    rejects = cut_lineage(out["rejects"], "rejects")
    new_log = cut_lineage(out["order_tracking"], "tracking")
    orders.commit(out["orders"], ordered, batch)
    tracking.commit(new_log.select(*[f.name for f in log.schema]), [], batch)
    payments.commit(out["payments"], paid_in, batch)
    return rejects


def update_statuses(orders: BucketTable, tracking: BucketTable, requests: DataFrame, batch: str | None = None) -> DataFrame:
    """CHG8 on kept orders (buckets of ``id``) and tracking (of ``order_id``); returns the rejects."""
    named = requests.select(F.explode("order_ids").alias("order_id")).where("order_id is not null")
    touched, log = orders.of(named, "order_id"), tracking.version()
    out = apply_status_updates(orders.read(touched), tracking.read([], log), requests, base_tracking_id=log.max_id)
    rejects = cut_lineage(out["rejects"], "rejects")
    new_log = cut_lineage(out["order_tracking"], "tracking")
    orders.commit(out["orders"], touched, batch)
    tracking.commit(new_log.select(*[f.name for f in log.schema]), [], batch)
    return rejects


def history_of(orders: DataFrame, items: BucketTable, tracking: BucketTable, inventory: DataFrame, user=None,
               ordered: bool = True) -> dict[str, DataFrame]:
    """REP8 for a selection of orders (``user`` narrows it): lines and tracking come from the buckets of the selected ids."""
    chosen = orders if user is None else for_user(orders, user)
    return order_history(chosen, items.read(items.of(chosen, "id")), tracking.read(tracking.of(chosen, "id")), inventory,
                         ordered=ordered)


def status_of(orders: DataFrame, tracking: BucketTable) -> DataFrame:
    """WIN1 for a selection of orders, from the buckets of their ids."""
    return current_status(orders, tracking.read(tracking.of(orders, "id")))
