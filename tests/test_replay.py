"""Replay properties: the set-based folds equal a plain event-by-event loop.

Generated inputs include a hot product holding about a third of all requests,
spread over many range slices, so the two-level running totals are exercised.
"""

import datetime as dt
import random
from decimal import Decimal

import pytest

from tillbook.operators import cart as CART
from tillbook.operators.purchases import apply_purchases

BASE = dt.datetime(2024, 1, 1)


def replay_purchases(stock, requests):
    left, ok, refused = dict(stock), set(), set()
    for rid, _, pid, q, _ in sorted(requests, key=lambda r: (r[4], r[0])):
        if q > left[pid]:
            refused.add(rid)
        else:
            left[pid] -= q
            ok.add(rid)
    return ok, refused, left


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_purchase_fold_matches_replay(spark, seed):
    rnd = random.Random(seed)
    products = {pid: rnd.randint(0, 400) for pid in range(12)}
    reqs = []
    for rid in range(1500):
        pid = 0 if rnd.random() < 0.34 else rnd.randrange(1, 12)  # product 0 is hot
        when = BASE + dt.timedelta(seconds=rnd.randrange(0, 48 * 3600))
        reqs.append((rid, rnd.randrange(50), pid, rnd.randint(1, 30), when))
    inv = spark.createDataFrame([(p, f"p{p}", Decimal("1.50"), q) for p, q in products.items()],
                                "id long, name string, price decimal(10,2), quantity int")
    req = spark.createDataFrame(reqs, "request_id long, user_id long, product_id long, quantity int, requested_at timestamp_ntz")
    out = apply_purchases(inv, req, slices=4, rows_per_slice=50)
    ok, refused, left = replay_purchases(products, reqs)
    assert {r["request_id"] for r in out["sales"].collect()} == ok
    assert {r["request_id"] for r in out["rejects"].collect()} == refused
    assert {r["id"]: r["quantity"] for r in out["inventory"].collect()} == left


def replay_cart(events):
    cart = {}
    for eid, user, product, action, qty, _ in sorted(events, key=lambda e: (e[5], e[0])):
        key = (user, product)
        if action == "add":
            cart[key] = cart.get(key, 0) + qty
        elif action == "set":
            if key in cart:
                cart[key] = qty
        elif action == "remove":
            cart.pop(key, None)
        elif action == "checkout":
            for k in [k for k in cart if k[0] == user]:
                del cart[k]
    return cart


@pytest.mark.parametrize("seed", [7, 8, 9])
def test_cart_fold_matches_replay(spark, seed):
    rnd = random.Random(seed)
    events = []
    for eid in range(1200):
        user = rnd.randrange(6)
        action = rnd.choices(["add", "set", "remove", "checkout"], [5, 3, 2, 1])[0]
        product = None if action == "checkout" else rnd.randrange(4)
        qty = rnd.randint(1, 9) if action in ("add", "set") else None
        when = BASE + dt.timedelta(seconds=rnd.randrange(0, 4000))  # many equal times: ties by event id
        events.append((eid, user, product, action, qty, when))
    df = spark.createDataFrame(events, "event_id long, user_id long, product_id long, action string, quantity int, event_time timestamp_ntz")
    got = {(r["user_id"], r["product_id"]): r["quantity"] for r in CART.fold_cart(df)["cart"].collect()}
    assert got == replay_cart(events)


def test_purchase_fold_with_a_burst_on_one_product(spark):
    """A third of the requests hit one product at the very same instant: only the request id orders
    them, and the range slices still split that burst."""
    rnd = random.Random(11)
    products = {pid: rnd.randint(50, 300) for pid in range(8)}
    burst = BASE + dt.timedelta(hours=5)
    reqs = []
    for rid in range(1200):
        if rid % 3 == 0:
            reqs.append((rid, 1, 0, rnd.randint(1, 9), burst))
        else:
            reqs.append((rid, 2, rnd.randrange(1, 8), rnd.randint(1, 30),
                         BASE + dt.timedelta(minutes=rnd.randrange(0, 600))))
    inv = spark.createDataFrame([(p, f"p{p}", Decimal("2.00"), q) for p, q in products.items()],
                                "id long, name string, price decimal(10,2), quantity int")
    req = spark.createDataFrame(reqs, "request_id long, user_id long, product_id long, quantity int, requested_at timestamp_ntz")
    out = apply_purchases(inv, req, slices=3, rows_per_slice=40)
    ok, refused, left = replay_purchases(products, reqs)
    assert {r["request_id"] for r in out["sales"].collect()} == ok
    assert {r["request_id"] for r in out["rejects"].collect()} == refused
    assert {r["id"]: r["quantity"] for r in out["inventory"].collect()} == left


def test_requests_of_an_uncounted_product_are_refused(spark):
    """NULL stock: every request ends as a sale or a reject, none is lost, and the stock stays unknown."""
    inv = spark.createDataFrame([(1, "a", Decimal("2.00"), None), (2, "b", Decimal("2.00"), 5)],
                                "id long, name string, price decimal(10,2), quantity int")
    reqs = [(k, 1, 1 + k % 2, 1 + k % 3, BASE + dt.timedelta(minutes=k)) for k in range(20)]
    req = spark.createDataFrame(reqs, "request_id long, user_id long, product_id long, quantity int, requested_at timestamp_ntz")
    out = apply_purchases(inv, req, slices=2, rows_per_slice=4)
    sold = {r["request_id"] for r in out["sales"].collect()}
    refused = {r["request_id"]: r["message"] for r in out["rejects"].collect()}
    assert len(sold) + len(refused) == 20 and not sold & set(refused)
    assert all(refused[k] == "Insufficient quantity available" for k in range(0, 20, 2))
    left = replay_purchases({1: 0, 2: 5}, reqs)
    assert sold == left[0]
    assert {r["id"]: r["quantity"] for r in out["inventory"].collect()} == {1: None, 2: left[2][2]}


@pytest.mark.parametrize("n", [1, 255, 256, 257, 3000])
def test_two_level_fold_of_one_slice(spark, n):
    """A single slice that is folded whole, at and around the block size."""
    rnd = random.Random(n)
    reqs = [(k, 1, 7, 10_000 if k == 0 else rnd.randint(1, 40), BASE + dt.timedelta(seconds=k)) for k in range(n + 1)]
    reqs[0] = (0, 1, 7, 30, BASE)
    stock = {7: 25 * n // 2}
    inv = spark.createDataFrame([(7, "p", Decimal("2.00"), stock[7])], "id long, name string, price decimal(10,2), quantity int")
    req = spark.createDataFrame(reqs, "request_id long, user_id long, product_id long, quantity int, requested_at timestamp_ntz")
    out = apply_purchases(inv, req, slices=1)
    ok, refused, left = replay_purchases(stock, reqs)
    assert {r["request_id"] for r in out["sales"].collect()} == ok
    assert {r["request_id"] for r in out["rejects"].collect()} == refused
    assert {r["id"]: r["quantity"] for r in out["inventory"].collect()} == left
