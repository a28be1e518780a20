"""SRC3: seed rows of a small garden shop, with 'now' given as ``as_of``. A test fixture, never a registered query."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession

from ..core import as_datetime
from .schemas import SCHEMAS

SEED_USERS = [
    (1, "Site Owner", "owner@example.com", "5550000001", "master_admin"),
    (2, "Ada Finch", "ada@example.com", "5550000002", "customer"),
    (3, "Ben Cole", "ben@example.com", "5550000003", "customer"),
    (4, "Cleo Staff", "cleo@example.com", "5550000004", "admin"),
]
SEED_IMAGE = "img/garden.png"
SEED_PRODUCTS = [
    (1, "Trowel", "Forged, ash handle", "12.50", 40),
    (2, "Clay Pot", "Unglazed, 20 cm", "6.25", 120),
    (3, "Hand Rake", "Short handle, five teeth", "8.00", 60),
    (4, "Seed Mix", "Meadow flowers, one bag", "1.75", 400),
]
# (days before as_of, user_id, product_id, quantity, total_amount)
SEED_SALES = [
    (1, 2, 4, 6, "10.50"),
    (2, 3, 1, 1, "12.50"),
    (3, 3, 3, 2, "16.00"),
    (4, 2, 2, 5, "31.25"),
    (5, 2, 4, 9, "15.75"),
    (6, 3, 2, 4, "25.00"),
    (7, 2, 3, 1, "8.00"),
    (8, 3, 1, 2, "25.00"),
    (9, 2, 2, 3, "18.75"),
    (10, 3, 4, 12, "21.00"),
]


def seed(spark: SparkSession, as_of) -> dict[str, DataFrame]:
    """users, inventory and sales of the seed block; created_at is as_of for users and products."""
    now = as_datetime(as_of)
    users = spark.createDataFrame([(i, n, e, p, r, now) for i, n, e, p, r in SEED_USERS], SCHEMAS["users"])
    inventory = spark.createDataFrame(
        [(i, n, d, Decimal(pr), q, SEED_IMAGE, now, now) for i, n, d, pr, q in SEED_PRODUCTS], SCHEMAS["inventory"])
    sales = spark.createDataFrame(
        [(k + 1, u, p, q, Decimal(t), now - dt.timedelta(days=days))
         for k, (days, u, p, q, t) in enumerate(SEED_SALES)], SCHEMAS["sales"])
    return {"users": users, "inventory": inventory, "sales": sales}
