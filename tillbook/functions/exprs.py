"""Scalar expressions (EXP1-EXP13) and row checks (FIL3, FIL4). All built-in Column
expressions, so they stay inside whole-stage codegen; no Python UDFs.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..core import as_datetime, ts_lit
from ..sources.schemas import MONEY

# Fixed values shown by the reference's pages.
DEFAULT_IMAGE = "https://images.unsplash.com/photo-1548839140-29a749e1cf4d?auto=format&fit=crop&w=400"
LOW_STOCK, IN_STOCK, OUT_OF_STOCK = "Low Stock", "In Stock", "Out of Stock"
ACTIVE, INACTIVE, DORMANT = "Active", "Inactive", "Dormant"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def subtotal(quantity, price) -> Column:
    """EXP1: quantity x unit price as DECIMAL(10,2)."""
    return (_c(quantity).cast("decimal(10,0)") * _c(price)).cast(MONEY)


def stock_flag(quantity) -> Column:
    """EXP2: two levels, under 10 is Low Stock."""
    return F.when(_c(quantity) < 10, LOW_STOCK).otherwise(IN_STOCK)


def stock_status(quantity) -> Column:
    """EXP3: three levels, <=0 Out of Stock, <=10 Low Stock, else In Stock."""
    q = _c(quantity)
    return F.when(q <= 0, OUT_OF_STOCK).when(q <= 10, LOW_STOCK).otherwise(IN_STOCK)


def is_active(last_activity, as_of) -> Column:
    """EXP4: 1 when the last sale is later than as_of minus 30 days, else 0 (null too)."""
    cutoff = as_datetime(as_of) - dt.timedelta(days=30)
    return F.when(_c(last_activity) > ts_lit(cutoff), 1).otherwise(0)


def customer_tier(last_activity, as_of) -> Column:
    """EXP5: whole elapsed days since the last activity: <=30 Active, <=90 Inactive, else
    (and never) Dormant. From 30 up to 31 days EXP4 says inactive while this says Active."""
    days = F.timestamp_diff("DAY", _c(last_activity), ts_lit(as_of))
    return F.when(days <= 30, ACTIVE).when(days <= 90, INACTIVE).otherwise(DORMANT)


def image_or_default(image) -> Column:
    """EXP7: blank or missing image -> the default product picture."""
    return F.coalesce(F.nullif(_c(image), F.lit("")), F.lit(DEFAULT_IMAGE))


def status_label(status) -> Column:
    """EXP8: out_for_delivery -> Out For Delivery."""
    return F.initcap(F.regexp_replace(_c(status), "_", " "))


def money(value) -> Column:
    """EXP9: thousands separators and two decimals."""
    return F.format_number(_c(value), 2)


def report_title(report_type: str, as_of) -> Column:
    """EXP10: 'Sales Report - 2001-08-01 12:00:00' (first letter upper only)."""
    text = report_type[:1].upper() + report_type[1:]
    return F.concat(F.lit(f"{text} Report - "), F.date_format(ts_lit(as_of), "yyyy-MM-dd HH:mm:ss"))


def day_label(col) -> Column:
    """EXP11: month-day label as on the dashboard chart ('Aug 1')."""
    return F.date_format(_c(col), "MMM d")


def payment_ref(order_id, at) -> Column:
    """EXP12: 'WV' + epoch seconds + at least four digits of the order id (unique per order and second)."""
    oid = _c(order_id).cast("string")
    digits = F.when(F.length(oid) >= 4, oid).otherwise(F.lpad(oid, 4, "0"))
    return F.concat(F.lit("WV"), F.unix_timestamp(_c(at)).cast("string"), digits)


def as_json(*cols) -> Column:
    """EXP13: JSON text of a row; null fields are kept like the reference's encoder does."""
    return F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})


def clean_phone(col) -> Column:
    """FIL3, first half: keep digits only."""
    return F.regexp_replace(_c(col), r"\D", "")


def valid_signup_phone(col) -> Column:
    """FIL3: exactly ten digits once non-digits are dropped."""
    return F.coalesce(clean_phone(col).rlike(r"^\d{10}$"), F.lit(False))


def valid_payment_phone(col) -> Column:
    """FIL4: exactly ten digits as typed."""
    return F.coalesce(_c(col).rlike(r"^\d{10}$"), F.lit(False))
