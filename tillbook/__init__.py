"""tillbook: shop sales, stock, cart, order and payment analytics as Spark DataFrame jobs.

The main entry points, by area (see README.md for the full map):

* reading and checking tables: ``read_table``, ``check_table``, ``SCHEMAS``
* reports: ``sales_report``, ``inventory_report``, ``user_activity_report``, the three exports,
  ``dashboard``, ``generate_report``, ``export_report``
* orders: ``order_history``, ``nest_order_history``, ``receipts``, ``admin_orders``, ``current_status``
* change jobs: ``apply_purchases``, ``fold_cart``, ``checkout``, ``open_payments``, ``apply_payments``,
  ``apply_status_updates``, ``accept_signups``, ``apply_product_changes``, ``apply_product_deletes``
* sinks: ``export_csv``, ``save_snapshot``, ``write_table``
* streams: ``stream_daily_sales``, ``stream_current_status``, ``stream_product_totals``,
  ``stream_apply_purchases``
"""

from .core import build_session, cut_lineage, ensure_checkpoint_dir, sequence_ids, ts_lit
from .operators.aggregates import current_status
from .operators.cart import checkout, fold_cart
from .operators.changes import accept_signups, apply_product_changes, apply_product_deletes, apply_status_updates
from .operators.payments import apply_payments, open_payments
from .operators.purchases import apply_purchases
from .plans.orders import admin_orders, nest_order_history, order_history, receipts
from .plans.reports import (dashboard, export_report, generate_report, inventory_export, inventory_report,
                            sales_export, sales_report, user_activity_export, user_activity_report)
from .sinks.files import export_csv, save_snapshot, write_table
from .sources.schemas import SCHEMAS, check_table
from .sources.tables import read_table
from .streaming.jobs import (stream_apply_purchases, stream_current_status, stream_daily_sales,
                             stream_product_totals)

__all__ = [
    "build_session", "cut_lineage", "ensure_checkpoint_dir", "sequence_ids", "ts_lit",
    "read_table", "check_table", "SCHEMAS",
    "sales_report", "inventory_report", "user_activity_report", "sales_export", "inventory_export",
    "user_activity_export", "dashboard", "generate_report", "export_report",
    "order_history", "nest_order_history", "receipts", "admin_orders", "current_status",
    "apply_purchases", "fold_cart", "checkout", "open_payments", "apply_payments", "apply_status_updates",
    "accept_signups", "apply_product_changes", "apply_product_deletes",
    "export_csv", "save_snapshot", "write_table",
    "stream_daily_sales", "stream_current_status", "stream_product_totals", "stream_apply_purchases",
]
