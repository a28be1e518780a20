"""DuckDB oracle SQL for the registered queries (same keys as ``tillbook.registry.QUERIES``).

The driver tables are pre-registered as views. ``MODEL`` repeats the adapters
of ``tillbook.sources.tables`` as CTEs (prefixed ``m_`` so they never shadow a
driver table). Each query is written independently of the Spark code: periods
use DuckDB's own date arithmetic, latest-row picks use ROW_NUMBER, positions
use ROW_NUMBER over the full order.
"""

from __future__ import annotations

MODEL = r"""
m_users AS (
  SELECT c_custkey AS id, c_name AS full_name,
         lower(replace(c_name, '#', '')) || '@example.com' AS email,
         CASE WHEN c_acctbal < 0 THEN substr(d, 2, 9)
              ELSE '(' || substr(d, 1, 3) || ') ' || substr(d, 4, 3) || '-' || substr(d, 7, 4) END AS phone,
         c_mktsegment AS role, TIMESTAMP '1994-01-01 00:00:00' AS created_at
  FROM (SELECT *, lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS d FROM customer)),
m_inventory AS (
  SELECT p_partkey AS id, p_name AS name, p_type AS description,
         CAST(p_retailprice AS DECIMAL(10,2)) AS price, CAST(p_size AS INTEGER) AS quantity,
         CASE WHEN p_size < 5 THEN NULL WHEN p_size < 10 THEN ''
              ELSE 'img/' || lower(replace(p_brand, '#', '')) || '.png' END AS image,
         TIMESTAMP '1994-01-01 00:00:00' AS created_at, TIMESTAMP '1994-01-01 00:00:00' AS updated_at
  FROM part),
m_sales AS (
  SELECT o.o_custkey AS user_id, l.l_partkey AS product_id, CAST(l.l_quantity AS INTEGER) AS quantity,
         CAST(l.l_extendedprice AS DECIMAL(10,2)) AS total_amount, o.o_orderdate AS transaction_date,
         concat_ws('-', l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey) AS sale_key
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey),
m_orders AS (
  SELECT o_orderkey AS id, o_custkey AS user_id, CAST(o_totalprice AS DECIMAL(10,2)) AS total_amount,
         CASE o_orderstatus WHEN 'F' THEN 'delivered' WHEN 'O' THEN 'pending' WHEN 'P' THEN 'processing' END AS status,
         o_orderpriority AS delivery_address, o_orderdate AS created_at, o_orderdate AS updated_at
  FROM orders),
m_items AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS item_key, l_orderkey AS order_id,
         l_partkey AS product_id, CAST(l_quantity AS INTEGER) AS quantity,
         CAST(p_retailprice AS DECIMAL(10,2)) AS price_per_unit, CAST(l_extendedprice AS DECIMAL(10,2)) AS subtotal
  FROM lineitem JOIN part ON l_partkey = p_partkey),
m_tracking AS (
  SELECT event_id AS id, user_id AS order_id,
         CASE event_type WHEN 'signup' THEN 'order_placed' WHEN 'click' THEN 'processing'
              WHEN 'view' THEN 'in_transit' WHEN 'purchase' THEN 'delivered' WHEN 'error' THEN 'cancelled' END AS status,
         CAST(NULL AS VARCHAR) AS location, event_type AS notes, ts AS created_at
  FROM events),
m_payments AS (
  SELECT event_id AS id, event_id // 2 AS order_id, 'WV' || CAST(event_id AS VARCHAR) AS transaction_id,
         CASE WHEN event_type = 'error' THEN CAST(user_id AS VARCHAR)
              ELSE lpad(CAST(user_id AS VARCHAR), 10, '0') END AS phone_number,
         CAST(value AS DECIMAL(10,2)) AS amount,
         CASE WHEN event_type = 'purchase' THEN 'completed' WHEN event_type = 'error' THEN 'failed' ELSE 'pending' END AS status,
         CASE WHEN event_type = 'purchase' THEN '0' WHEN event_type = 'error' THEN '1' END AS result_code,
         CASE WHEN event_type = 'purchase' THEN 'Success' WHEN event_type = 'error' THEN 'Failed' END AS result_desc,
         ts AS created_at, CASE WHEN event_type = 'purchase' THEN ts END AS completed_at
  FROM events),
m_cart_events AS (
  SELECT event_id, user_id, user_id * 13 + CAST(json_extract_string(props, '$.k') AS BIGINT) % 13 AS product_id,
         CASE event_type WHEN 'click' THEN 'add' WHEN 'view' THEN 'set' WHEN 'error' THEN 'remove'
              WHEN 'purchase' THEN 'checkout' END AS action,
         CAST(1 + CAST(floor(value) AS BIGINT) % 9 AS INTEGER) AS quantity, ts AS event_time
  FROM events WHERE event_type <> 'signup'),
p_asof AS (SELECT TIMESTAMP '2001-08-01 12:00:00' AS now, DATE '2001-08-01' AS today),
m_current AS (
  SELECT order_id, status AS current_status FROM (
    SELECT order_id, status, row_number() OVER (PARTITION BY order_id ORDER BY created_at DESC, id DESC) AS rn
    FROM m_tracking) WHERE rn = 1),
m_product_sales AS (
  SELECT product_id, CAST(sum(quantity) AS BIGINT) AS total_sales,
         CAST(sum(total_amount) AS DECIMAL(38,2)) AS revenue FROM m_sales GROUP BY product_id),
m_inventory_report AS (
  SELECT i.*, CAST(coalesce(a.total_sales, 0) AS BIGINT) AS total_sales,
         CAST(coalesce(a.revenue, 0) AS DECIMAL(38,2)) AS revenue
  FROM m_inventory i LEFT JOIN m_product_sales a ON a.product_id = i.id),
m_user_sales AS (
  SELECT u.*, CAST(coalesce(a.n, 0) AS BIGINT) AS total_purchases,
         CAST(coalesce(a.spent, 0) AS DECIMAL(38,2)) AS total_spent, a.last_purchase
  FROM m_users u LEFT JOIN (SELECT user_id, count(*) AS n, sum(total_amount) AS spent,
                                   max(transaction_date) AS last_purchase FROM m_sales GROUP BY user_id) a
    ON a.user_id = u.id),
m_detail AS (
  SELECT s.*, i.name AS product_name, u.full_name AS customer_name
  FROM m_sales s JOIN m_inventory i ON s.product_id = i.id JOIN m_users u ON s.user_id = u.id),
m_month_detail AS (
  SELECT * FROM m_detail WHERE transaction_date BETWEEN
    (SELECT date_trunc('day', now - INTERVAL 30 DAY) FROM p_asof) AND (SELECT now FROM p_asof))
"""


def _sql(body: str) -> str:
    return "WITH " + MODEL.strip() + "\n" + body.strip()


def _with(extra: str, body: str) -> str:
    return "WITH " + MODEL.strip() + ",\n" + extra.strip() + "\n" + body.strip()


def _period_rows(table: str, ts: str, amount: str, periods: list[tuple[str, str, str | None, str | None]]) -> str:
    parts = []
    for name, cond, lo, hi in periods:
        lo_s = "NULL" if lo is None else f"'{lo}'"
        hi_s = "NULL" if hi is None else f"'{hi}'"
        parts.append(
            f"SELECT '{name}' AS period, CAST({lo_s} AS VARCHAR) AS period_start, CAST({hi_s} AS VARCHAR) AS period_end, "
            f"count(*) FILTER (WHERE {cond}) AS row_count, "
            f"CAST(coalesce(sum({amount}) FILTER (WHERE {cond}), 0) AS DECIMAL(38,2)) AS amount FROM {table}")
    return _sql("\nUNION ALL\n".join(parts))


T = "transaction_date"
ORACLE: dict[str, str] = {}

ORACLE["src1_read_inventory"] = _sql("SELECT * FROM m_inventory")



ORACLE["per1_report_periods"] = _period_rows("m_sales", T, "total_amount", [
    ("today", f"{T} BETWEEN TIMESTAMP '2001-08-01 00:00:00' AND TIMESTAMP '2001-08-01 12:00:00'",
     "2001-08-01 00:00:00", "2001-08-01 12:00:00"),
    ("week", f"{T} BETWEEN date_trunc('day', TIMESTAMP '2001-08-01 12:00:00' - INTERVAL 7 DAY) AND TIMESTAMP '2001-08-01 12:00:00'",
     "2001-07-25 00:00:00", "2001-08-01 12:00:00"),
    ("month", f"{T} BETWEEN date_trunc('day', TIMESTAMP '2001-08-01 12:00:00' - INTERVAL 30 DAY) AND TIMESTAMP '2001-08-01 12:00:00'",
     "2001-07-02 00:00:00", "2001-08-01 12:00:00"),
    ("year", f"{T} BETWEEN date_trunc('day', TIMESTAMP '2001-08-01 12:00:00' - INTERVAL 30 DAY) AND TIMESTAMP '2001-08-01 12:00:00'",
     "2001-07-02 00:00:00", "2001-08-01 12:00:00"),
    ("custom", f"{T} BETWEEN TIMESTAMP '2001-07-01 00:00:00' AND TIMESTAMP '2001-07-15 23:59:59'",
     "2001-07-01 00:00:00", "2001-07-15 23:59:59"),
])

ORACLE["per2_export_periods"] = _period_rows("m_sales", T, "total_amount", [
    ("today", f"CAST({T} AS DATE) = DATE '2001-08-01'", None, None),
    ("week", f"{T} >= DATE '2001-08-01' - INTERVAL 1 WEEK", None, None),
    ("month", f"{T} >= DATE '2001-08-01' - INTERVAL 1 MONTH", None, None),
    ("year", f"{T} >= DATE '2001-08-01' - INTERVAL 1 YEAR", None, None),
    ("custom", f"CAST({T} AS DATE) BETWEEN DATE '2001-07-01' AND DATE '2001-07-15'", None, None),
    ("all", "1 = 1", None, None),
])

ORACLE["per3_preset_periods"] = _period_rows("m_sales", T, "total_amount", [
    ("Today", f"{T} BETWEEN TIMESTAMP '2001-08-01 00:00:00' AND TIMESTAMP '2001-08-01 23:59:59'",
     "2001-08-01 00:00:00", "2001-08-01 23:59:59"),
    ("Yesterday", f"{T} BETWEEN TIMESTAMP '2001-07-31 00:00:00' AND TIMESTAMP '2001-07-31 23:59:59'",
     "2001-07-31 00:00:00", "2001-07-31 23:59:59"),
    ("Last 7 Days", f"{T} BETWEEN TIMESTAMP '2001-07-26 00:00:00' AND TIMESTAMP '2001-08-01 23:59:59'",
     "2001-07-26 00:00:00", "2001-08-01 23:59:59"),
    ("Last 30 Days", f"{T} BETWEEN TIMESTAMP '2001-07-03 00:00:00' AND TIMESTAMP '2001-08-01 23:59:59'",
     "2001-07-03 00:00:00", "2001-08-01 23:59:59"),
    ("This Month", f"{T} BETWEEN TIMESTAMP '2001-08-01 00:00:00' AND TIMESTAMP '2001-08-31 23:59:59'",
     "2001-08-01 00:00:00", "2001-08-31 23:59:59"),
    ("Last Month", f"{T} BETWEEN TIMESTAMP '2001-07-01 00:00:00' AND TIMESTAMP '2001-07-31 23:59:59'",
     "2001-07-01 00:00:00", "2001-07-31 23:59:59"),
])

ORACLE["per4_order_periods"] = _period_rows("m_orders", "created_at", "total_amount", [
    ("today", "CAST(created_at AS DATE) BETWEEN DATE '2001-08-01' AND DATE '2001-08-01'", "2001-08-01", "2001-08-01"),
    ("week", "CAST(created_at AS DATE) BETWEEN DATE '2001-07-25' AND DATE '2001-08-01'", "2001-07-25", "2001-08-01"),
    ("month", "CAST(created_at AS DATE) BETWEEN DATE '2001-07-01' AND DATE '2001-08-01'", "2001-07-01", "2001-08-01"),
    ("custom", "CAST(created_at AS DATE) BETWEEN DATE '2001-07-01' AND DATE '2001-07-15'", "2001-07-01", "2001-07-15"),
])

ORACLE["per5_admin_default_period"] = _period_rows("m_orders", "created_at", "total_amount", [
    ("admin_default", "CAST(created_at AS DATE) BETWEEN DATE '2001-08-01' - INTERVAL 30 DAY AND DATE '2001-08-01'",
     "2001-07-02", "2001-08-01"),
])

ORACLE["fil1_for_user"] = _sql(
    "SELECT o.* FROM m_orders o WHERE o.user_id IN (SELECT id FROM m_users WHERE role = 'BUILDING')")

ORACLE["fil2_filter_orders"] = _sql("""
SELECT * FROM m_orders WHERE status = 'processing'
  AND CAST(created_at AS DATE) BETWEEN DATE '1998-01-01' AND DATE '1998-12-31'""")

ORACLE["fil3_clean_phone"] = _sql("""
SELECT id, phone, regexp_replace(phone, '[^0-9]', '', 'g') AS digits,
       coalesce(regexp_matches(regexp_replace(phone, '[^0-9]', '', 'g'), '^[0-9]{10}$'), false) AS valid
FROM m_users""")

ORACLE["fil4_payment_phone"] = _sql("""
SELECT id, phone_number, coalesce(regexp_matches(phone_number, '^[0-9]{10}$'), false) AS valid FROM m_payments""")

ORACLE["join1_sales_detail"] = _sql("SELECT * FROM m_detail")
ORACLE["join2_inventory_sales"] = _sql("SELECT * FROM m_inventory_report")

_INV_PERIOD = """
SELECT i.*, CAST(coalesce(a.total_sales, 0) AS BIGINT) AS total_sales,
       CAST(coalesce(a.revenue, 0) AS DECIMAL(38,2)) AS revenue
FROM m_inventory i LEFT JOIN (
  SELECT product_id, sum(quantity) AS total_sales, sum(total_amount) AS revenue FROM m_sales
  WHERE {cond} GROUP BY product_id) a ON a.product_id = i.id"""

_USER_PERIOD = """
SELECT u.*, CAST(coalesce(a.n, 0) AS BIGINT) AS total_purchases,
       CAST(coalesce(a.spent, 0) AS DECIMAL(38,2)) AS total_spent, a.last_purchase
FROM m_users u LEFT JOIN (
  SELECT user_id, count(*) AS n, sum(total_amount) AS spent, max(transaction_date) AS last_purchase
  FROM m_sales WHERE {cond} GROUP BY user_id) a ON a.user_id = u.id"""

MONTH_EXPORT = f"{T} >= DATE '2001-08-01' - INTERVAL 1 MONTH"
YEAR_EXPORT = f"{T} >= DATE '2001-08-01' - INTERVAL 1 YEAR"
WEEK_EXPORT = f"{T} >= DATE '2001-08-01' - INTERVAL 1 WEEK"

ORACLE["join3_inventory_sales_period"] = _sql(_INV_PERIOD.format(cond=MONTH_EXPORT))
ORACLE["join4_users_sales"] = _sql("SELECT * FROM m_user_sales")
ORACLE["join5_users_sales_period"] = _sql(_USER_PERIOD.format(cond=YEAR_EXPORT))
ORACLE["join7_order_lines"] = _sql(
    "SELECT it.*, i.name, i.image FROM m_items it JOIN m_inventory i ON it.product_id = i.id")

_BEST_PAYMENT = """
m_best_payment AS (
  SELECT order_id, transaction_id AS mpesa_transaction FROM (
    SELECT order_id, transaction_id, row_number() OVER (
      PARTITION BY order_id ORDER BY (status = 'completed') DESC, created_at DESC, id DESC) AS rn
    FROM m_payments) WHERE rn = 1),
m_receipt_headers AS (
  SELECT o.*, u.full_name, u.email, u.phone, b.mpesa_transaction
  FROM m_orders o JOIN m_users u ON o.user_id = u.id LEFT JOIN m_best_payment b ON b.order_id = o.id)
"""
ORACLE["join8_receipt_headers"] = _with(_BEST_PAYMENT, "SELECT * FROM m_receipt_headers")


ORACLE["agg1_sales_total"] = _sql(
    "SELECT CAST(coalesce(sum(total_amount), 0) AS DECIMAL(38,2)) AS total_revenue FROM m_detail")
ORACLE["agg2_product_totals"] = _sql("SELECT id, total_sales, revenue FROM m_inventory_report")

_USER_ACTIVITY = """
SELECT id, full_name, role, created_at, total_purchases, last_purchase AS last_activity,
       CASE WHEN last_purchase > TIMESTAMP '2001-08-01 12:00:00' - INTERVAL 30 DAY THEN 1 ELSE 0 END AS is_active
FROM m_user_sales"""
ORACLE["agg3_user_activity"] = _sql(_USER_ACTIVITY)
ORACLE["agg4_user_period_totals"] = _sql(
    f"SELECT id, total_purchases, total_spent, last_purchase FROM ({_USER_PERIOD.format(cond=YEAR_EXPORT)})")
ORACLE["agg5_daily_sales"] = _sql("""
SELECT CAST(transaction_date AS DATE) AS day, CAST(sum(total_amount) AS DECIMAL(38,2)) AS revenue
FROM m_detail GROUP BY 1""")
ORACLE["agg6_units_by_product_name"] = _sql(
    "SELECT product_name, CAST(sum(quantity) AS BIGINT) AS units FROM m_detail GROUP BY 1")
ORACLE["agg7_role_distribution"] = _sql("SELECT role, count(*) AS users FROM m_users GROUP BY 1")
ORACLE["agg8_sales_kpis"] = _sql("""
SELECT CAST(coalesce(sum(total_amount), 0) AS DECIMAL(38,2)) AS total_revenue, count(*) AS total_sales,
       count(DISTINCT product_id) AS active_products FROM m_detail""")
ORACLE["agg9_inventory_kpis"] = _sql("""
SELECT CAST(coalesce(sum(revenue), 0) AS DECIMAL(38,2)) AS total_revenue,
       CAST(coalesce(sum(total_sales), 0) AS BIGINT) AS total_sales, count(*) AS active_products
FROM m_inventory_report""")
ORACLE["agg10_user_kpis"] = _sql(f"""
SELECT CAST(coalesce(sum(total_purchases), 0) AS BIGINT) AS total_purchases,
       count(*) FILTER (WHERE is_active = 1) AS active_users FROM ({_USER_ACTIVITY})""")

_DASH_DETAIL = ("SELECT * FROM m_detail WHERE transaction_date BETWEEN TIMESTAMP '2001-07-01 00:00:00' "
                "AND TIMESTAMP '2001-07-31 23:59:59'")
ORACLE["agg11_dashboard_cards"] = _sql(f"""
SELECT (SELECT CAST(coalesce(sum(total_amount), 0) AS DECIMAL(38,2)) FROM ({_DASH_DETAIL})) AS total_sales,
       (SELECT count(*) FROM ({_DASH_DETAIL})) AS total_orders,
       (SELECT count(*) FROM m_inventory) AS active_products,
       (SELECT count(*) FROM m_users) AS active_customers""")

_ORDERS_CURRENT = "SELECT o.*, c.current_status FROM m_orders o LEFT JOIN m_current c ON c.order_id = o.id"
ORACLE["agg12_customer_order_stats"] = _sql(f"""
SELECT user_id, count(*) AS total_orders,
       count(*) FILTER (WHERE current_status IN ('pending', 'processing', 'in_transit', 'out_for_delivery')) AS active_orders,
       count(*) FILTER (WHERE current_status = 'delivered') AS completed_orders
FROM ({_ORDERS_CURRENT}) GROUP BY user_id""")
ORACLE["agg13_admin_order_stats"] = _sql(f"""
SELECT count(*) AS total_orders, count(*) FILTER (WHERE current_status = 'pending') AS pending_orders,
       count(*) FILTER (WHERE current_status = 'processing') AS processing_orders,
       count(*) FILTER (WHERE current_status = 'delivered') AS delivered_orders
FROM ({_ORDERS_CURRENT})""")
ORACLE["agg15_order_history_nested"] = _sql("""
SELECT o.id, o.user_id, c.current_status, coalesce((e.position - 1) // 3, 0) AS chunk, e.part, e.position, e.label
FROM m_orders o LEFT JOIN m_current c ON c.order_id = o.id
LEFT JOIN (
  SELECT it.order_id, 'item' AS part, i.name AS label, row_number() OVER (PARTITION BY it.order_id ORDER BY it.item_key) AS position
  FROM m_items it JOIN m_inventory i ON it.product_id = i.id
  UNION ALL
  SELECT order_id, 'tracking', status, row_number() OVER (PARTITION BY order_id ORDER BY created_at DESC, id DESC)
  FROM m_tracking) e ON e.order_id = o.id""")
ORACLE["win1_current_status"] = _sql(
    "SELECT o.id, o.user_id, o.status, c.current_status FROM m_orders o LEFT JOIN m_current c ON c.order_id = o.id")

ORACLE["srt1_sales_newest_first"] = _sql("""
SELECT sale_key, transaction_date, total_amount,
       row_number() OVER (ORDER BY transaction_date DESC, sale_key ASC) AS position FROM m_detail""")
ORACLE["srt2_products_by_name"] = _sql(
    "SELECT id, name, row_number() OVER (ORDER BY lower(name), id) AS position FROM m_inventory")
ORACLE["srt2_users_by_name"] = _sql(
    "SELECT id, full_name, row_number() OVER (ORDER BY lower(full_name), id) AS position FROM m_users")
ORACLE["srt3_products_by_revenue"] = _sql(f"""
SELECT id, revenue, row_number() OVER (ORDER BY revenue DESC, id) AS position
FROM ({_INV_PERIOD.format(cond=MONTH_EXPORT)})""")
ORACLE["srt3_users_by_spend"] = _sql(f"""
SELECT id, total_spent, row_number() OVER (ORDER BY total_spent DESC, id) AS position
FROM ({_USER_PERIOD.format(cond=YEAR_EXPORT)})""")
ORACLE["srt4_orders_newest_first"] = _sql(
    "SELECT id, created_at, row_number() OVER (ORDER BY created_at DESC, id DESC) AS position FROM m_orders")
ORACLE["srt4_tracking_newest_first"] = _sql("""
SELECT id, order_id, created_at, row_number() OVER (ORDER BY order_id, created_at DESC, id DESC) AS position
FROM m_tracking WHERE order_id IN (SELECT id FROM m_orders)""")
ORACLE["top1_top_products"] = _sql(
    "SELECT id, name, total_sales FROM m_inventory_report ORDER BY total_sales DESC, id LIMIT 5")

ORACLE["exp1_subtotal"] = _sql(
    "SELECT item_key, quantity, price_per_unit, CAST(quantity * price_per_unit AS DECIMAL(10,2)) AS line_total FROM m_items")
ORACLE["exp2_stock_flag"] = _sql(
    "SELECT id, quantity, CASE WHEN quantity < 10 THEN 'Low Stock' ELSE 'In Stock' END AS stock_flag FROM m_inventory")
ORACLE["exp3_stock_status"] = _sql("""
SELECT id, CAST(quantity * 10 - total_sales AS BIGINT) AS stock_left,
       CASE WHEN quantity * 10 - total_sales <= 0 THEN 'Out of Stock'
            WHEN quantity * 10 - total_sales <= 10 THEN 'Low Stock' ELSE 'In Stock' END AS stock_status
FROM m_inventory_report""")
ORACLE["exp4_is_active"] = _sql("""
SELECT id, last_purchase,
       CASE WHEN last_purchase > TIMESTAMP '2001-08-01 12:00:00' - INTERVAL 30 DAY THEN 1 ELSE 0 END AS is_active
FROM m_user_sales""")
_TIER = """CASE WHEN date_sub('day', last_purchase, TIMESTAMP '2001-08-01 12:00:00') <= 30 THEN 'Active'
            WHEN date_sub('day', last_purchase, TIMESTAMP '2001-08-01 12:00:00') <= 90 THEN 'Inactive'
            ELSE 'Dormant' END"""
ORACLE["exp5_customer_tier"] = _sql(f"SELECT id, last_purchase, {_TIER} AS tier FROM m_user_sales")
ORACLE["exp6_null_to_zero"] = _sql(
    f"SELECT id, total_sales, revenue FROM ({_INV_PERIOD.format(cond=WEEK_EXPORT)})")
ORACLE["exp7_image_default"] = _sql("""
SELECT id, image, coalesce(nullif(image, ''),
  'https://images.unsplash.com/photo-1548839140-29a749e1cf4d?auto=format&fit=crop&w=400') AS shown_image
FROM m_inventory""")
ORACLE["exp8_status_label"] = _sql("""
SELECT id, status, array_to_string(list_transform(string_split(status, '_'),
         lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), ' ') AS label FROM m_tracking""")
ORACLE["exp9_money_text"] = _sql(
    "SELECT id, total_spent, format('{:,.2f}', total_spent) AS shown FROM m_user_sales")
ORACLE["exp10_report_title"] = _sql("""
SELECT 'Sales Report - 2001-08-01 12:00:00' AS title,
       CAST(coalesce(sum(total_amount), 0) AS DECIMAL(38,2)) AS total_revenue FROM m_detail""")
ORACLE["exp11_day_label"] = _sql("""
SELECT CAST(transaction_date AS DATE) AS day, strftime(CAST(transaction_date AS DATE), '%b %-d') AS label,
       CAST(sum(total_amount) AS DECIMAL(38,2)) AS revenue FROM m_detail GROUP BY 1, 2""")
ORACLE["exp12_payment_ref"] = _sql("""
SELECT id, 'WV' || CAST(CAST(epoch(created_at) AS BIGINT) AS VARCHAR)
       || CASE WHEN length(CAST(id AS VARCHAR)) >= 4 THEN CAST(id AS VARCHAR)
               ELSE lpad(CAST(id AS VARCHAR), 4, '0') END AS transaction_id FROM m_orders""")
ORACLE["exp13_json_text"] = _sql("""
SELECT id, CAST(to_json({'id': id, 'name': name, 'image': image, 'total_sales': total_sales, 'revenue': revenue})
       AS VARCHAR) AS data
FROM m_inventory_report""")

ORACLE["rep1_sales_report"] = _sql("SELECT * FROM m_month_detail")
ORACLE["rep1_sales_report_total"] = _sql("""
SELECT CAST(coalesce(sum(total_amount), 0) AS DECIMAL(38,2)) AS total_revenue FROM m_detail
WHERE transaction_date BETWEEN TIMESTAMP '2001-07-01 00:00:00' AND TIMESTAMP '2001-07-15 23:59:59'""")
ORACLE["rep2_inventory_report"] = _sql(
    "SELECT *, CASE WHEN quantity < 10 THEN 'Low Stock' ELSE 'In Stock' END AS stock_flag FROM m_inventory_report")
ORACLE["rep3_user_activity_report"] = _sql(_USER_ACTIVITY)
ORACLE["rep4_sales_export"] = _sql(f"""
SELECT transaction_date, product_name, customer_name, quantity, total_amount FROM m_detail WHERE {MONTH_EXPORT}""")
ORACLE["rep5_inventory_export"] = _sql(f"""
SELECT id, name, description, quantity AS current_stock, total_sales, revenue
FROM ({_INV_PERIOD.format(cond=MONTH_EXPORT)})""")
ORACLE["rep6_user_activity_export"] = _sql(f"""
SELECT id, full_name, email, role, total_purchases, total_spent, last_purchase
FROM ({_USER_PERIOD.format(cond=YEAR_EXPORT)})""")
ORACLE["rep7_dashboard_sales"] = _sql(_DASH_DETAIL)
ORACLE["rep7_dashboard_daily"] = _sql(f"""
SELECT CAST(transaction_date AS DATE) AS day, CAST(sum(total_amount) AS DECIMAL(38,2)) AS revenue,
       strftime(CAST(transaction_date AS DATE), '%b %-d') AS label FROM ({_DASH_DETAIL}) GROUP BY 1, 3""")
ORACLE["rep7_dashboard_inventory"] = _sql("""
SELECT id, name, quantity, total_sales, revenue,
       CASE WHEN quantity <= 0 THEN 'Out of Stock' WHEN quantity <= 10 THEN 'Low Stock' ELSE 'In Stock' END AS status
FROM m_inventory_report""")
ORACLE["rep7_dashboard_customers"] = _sql(
    f"SELECT id, full_name, total_purchases, total_spent, last_purchase, {_TIER} AS tier FROM m_user_sales")
ORACLE["rep7_dashboard_top_products"] = ORACLE["top1_top_products"]
ORACLE["rep8_order_history"] = _sql(f"""
SELECT id, user_id, total_amount, status, created_at, current_status FROM ({_ORDERS_CURRENT})""")
ORACLE["rep8_order_history_lines"] = ORACLE["join7_order_lines"]
ORACLE["rep9_receipts"] = _with(_BEST_PAYMENT, """
SELECT h.id, h.user_id, h.total_amount, h.full_name, h.email, h.phone, h.mpesa_transaction,
       l.item_key, l.product_id, l.quantity AS item_quantity, l.price_per_unit, l.subtotal, l.name
FROM m_receipt_headers h LEFT JOIN (
  SELECT it.*, i.name FROM m_items it JOIN m_inventory i ON it.product_id = i.id) l ON l.order_id = h.id""")
_IN_TRANSIT = "SELECT order_id FROM m_current WHERE current_status = 'in_transit' AND order_id IN (SELECT id FROM m_orders)"
ORACLE["rep10_admin_order_items"] = _sql(f"""
SELECT it.*, i.name, i.image FROM m_items it JOIN m_inventory i ON it.product_id = i.id WHERE it.order_id IN ({_IN_TRANSIT})""")
ORACLE["rep10_admin_order_tracking"] = _sql(f"SELECT * FROM m_tracking WHERE order_id IN ({_IN_TRANSIT})")
ORACLE["rep8_order_history_tracking"] = _sql("SELECT * FROM m_tracking WHERE order_id IN (SELECT id FROM m_orders)")
_ASKED = """
m_asked AS (SELECT o_orderkey AS order_id, CASE WHEN o_orderstatus = 'F' THEN o_custkey + 1 ELSE o_custkey END AS user_id FROM orders),
"""
ORACLE["rep9_requested_receipts"] = _with(_ASKED + _BEST_PAYMENT, """
SELECT h.id, h.user_id, h.email, h.mpesa_transaction, l.item_key, l.quantity AS item_quantity, l.subtotal, l.name
FROM m_receipt_headers h JOIN m_asked a ON a.order_id = h.id AND a.user_id = h.user_id LEFT JOIN (
  SELECT it.*, i.name FROM m_items it JOIN m_inventory i ON it.product_id = i.id) l ON l.order_id = h.id""")
ORACLE["rep9_receipt_rejects"] = _with(_ASKED + _BEST_PAYMENT, """
SELECT a.order_id, a.user_id, 'Order not found' AS message FROM m_asked a
WHERE NOT EXISTS (SELECT 1 FROM m_orders o WHERE o.id = a.order_id AND o.user_id = a.user_id)""")
ORACLE["rep10_admin_orders"] = _sql(f"""
SELECT o.id, o.user_id, u.full_name AS customer_name, u.phone AS customer_phone, o.status, o.current_status,
       o.created_at
FROM ({_ORDERS_CURRENT}) o LEFT JOIN m_users u ON u.id = o.user_id
WHERE CAST(o.created_at AS DATE) BETWEEN DATE '2001-07-02' AND DATE '2001-08-01'""")


# ---------------------------------------------------------------- change jobs

def _rsql(extra: str, body: str) -> str:
    return "WITH RECURSIVE " + MODEL.strip() + ",\n" + extra.strip() + "\n" + body.strip()


_CHG3 = """
m_preq AS (SELECT sale_key AS request_id, user_id, product_id, quantity, transaction_date AS requested_at FROM m_sales),
m_stock0 AS (SELECT id, price, CASE WHEN id % 101 = 17 THEN 0 ELSE CAST(quantity AS BIGINT) * 10 END AS stock FROM m_inventory),
m_pvalid AS (SELECT r.*, s.price FROM m_preq r JOIN m_stock0 s ON s.id = r.product_id WHERE r.quantity >= 1),
m_pseq AS (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY requested_at, request_id) AS rn FROM m_pvalid),
m_walk AS (
  SELECT id AS product_id, CAST(0 AS BIGINT) AS rn, stock, CAST(NULL AS BOOLEAN) AS ok FROM m_stock0
  UNION ALL
  SELECT w.product_id, q.rn, CASE WHEN q.quantity <= w.stock THEN w.stock - q.quantity ELSE w.stock END,
         q.quantity <= w.stock
  FROM m_walk w JOIN m_pseq q ON q.product_id = w.product_id AND q.rn = w.rn + 1),
m_pout AS (SELECT q.*, w.ok FROM m_pseq q JOIN m_walk w ON w.product_id = q.product_id AND w.rn = q.rn)
"""
ORACLE["chg3_purchases_sales"] = _rsql(_CHG3, """
SELECT request_id, user_id, product_id, quantity, CAST(quantity * price AS DECIMAL(10,2)) AS total_amount,
       requested_at AS transaction_date FROM m_pout WHERE ok""")
ORACLE["chg3_purchases_rejects"] = _rsql(_CHG3, """
SELECT request_id, user_id, product_id, quantity, requested_at,
       CASE WHEN quantity IS NULL OR quantity < 1 THEN 'Invalid quantity' ELSE 'Product not found' END AS message
FROM m_preq r WHERE quantity IS NULL OR quantity < 1 OR NOT EXISTS (SELECT 1 FROM m_stock0 s WHERE s.id = r.product_id)
UNION ALL
SELECT request_id, user_id, product_id, quantity, requested_at, 'Insufficient quantity available' FROM m_pout WHERE NOT ok""")
ORACLE["chg3_purchases_stock"] = _rsql(_CHG3, """
SELECT product_id AS id, CASE WHEN product_id % 101 <> 17 THEN CAST(arg_max(stock, rn) AS INTEGER) END AS quantity
FROM m_walk GROUP BY product_id""")

_CART = """
m_keys AS (SELECT DISTINCT user_id, product_id FROM m_cart_events WHERE action IN ('add', 'set', 'remove')),
m_clears AS (
  SELECT user_id, product_id, event_time, event_id FROM m_cart_events WHERE action = 'remove'
  UNION ALL
  SELECT k.user_id, k.product_id, c.event_time, c.event_id
  FROM m_cart_events c JOIN m_keys k ON k.user_id = c.user_id WHERE c.action = 'checkout'),
m_last_clear AS (
  SELECT user_id, product_id, event_time AS ct, event_id AS ci FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id, product_id ORDER BY event_time DESC, event_id DESC) AS rn
    FROM m_clears) WHERE rn = 1),
m_seg AS (
  SELECT e.* FROM m_cart_events e LEFT JOIN m_last_clear c ON c.user_id = e.user_id AND c.product_id = e.product_id
  WHERE e.action IN ('add', 'set')
    AND (c.ct IS NULL OR e.event_time > c.ct OR (e.event_time = c.ct AND e.event_id > c.ci))),
m_live AS (
  SELECT * FROM (
    SELECT *, sum(CASE WHEN action = 'add' THEN 1 ELSE 0 END) OVER (
      PARTITION BY user_id, product_id ORDER BY event_time, event_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS adds_so_far
    FROM m_seg) WHERE adds_so_far > 0),
m_tail AS (
  SELECT *, coalesce(sum(CASE WHEN action = 'set' THEN 1 ELSE 0 END) OVER (
      PARTITION BY user_id, product_id ORDER BY event_time, event_id
      ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS sets_after
  FROM m_live),
m_cart AS (
  SELECT user_id, product_id, CAST(sum(quantity) FILTER (WHERE sets_after = 0) AS INTEGER) AS quantity,
         min(event_time) FILTER (WHERE action = 'add') AS created_at,
         max(event_time) FILTER (WHERE sets_after = 0) AS updated_at
  FROM m_tail GROUP BY user_id, product_id),
m_lines AS (
  SELECT c.user_id, c.product_id, c.quantity, c.created_at, c.updated_at, i.name, i.price, i.image,
         CAST(c.quantity * i.price AS DECIMAL(10,2)) AS subtotal
  FROM m_cart c JOIN m_inventory i ON i.id = c.product_id)
"""
ORACLE["chg4_fold_cart"] = _with(_CART, "SELECT * FROM m_cart")
ORACLE["join6_cart_lines"] = _with(_CART, "SELECT * FROM m_lines")
ORACLE["agg14_cart_totals"] = _with(_CART, """
SELECT user_id, CAST(sum(subtotal) AS DECIMAL(38,2)) AS total, count(*) AS items FROM m_lines GROUP BY user_id""")

_CHECKOUT = _CART.rstrip().rstrip(",") + """,
m_creq AS (
  SELECT 'co-' || c_custkey || '-1' AS request_id, c_custkey AS user_id, 'Nation ' || c_nationkey AS delivery_address,
         TIMESTAMP '2024-02-01 09:00:00' AS requested_at FROM customer WHERE c_acctbal >= 0
  UNION ALL
  SELECT 'co-' || c_custkey || '-2', c_custkey, 'Nation ' || c_nationkey, TIMESTAMP '2024-02-01 08:00:00'
  FROM customer WHERE c_acctbal > 5000),
m_cfirst AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY requested_at, request_id) AS rn
                 FROM m_creq) WHERE rn = 1),
m_placed AS (
  SELECT f.request_id, f.user_id, f.delivery_address, f.requested_at, t.total
  FROM m_cfirst f JOIN (SELECT user_id, sum(subtotal) AS total FROM m_lines GROUP BY user_id) t ON t.user_id = f.user_id),
m_new_orders AS (
  SELECT (SELECT max(id) FROM m_orders) + row_number() OVER (ORDER BY requested_at, request_id) AS id, user_id,
         CAST(total AS DECIMAL(10,2)) AS total_amount, 'pending' AS status, delivery_address,
         requested_at AS created_at, requested_at AS updated_at, request_id FROM m_placed)
"""
ORACLE["chg5_checkout_orders"] = _with(_CHECKOUT, "SELECT * FROM m_new_orders")
ORACLE["chg5_checkout_items"] = _with(_CHECKOUT, """
SELECT o.id AS order_id, l.product_id, l.quantity, l.price AS price_per_unit, l.subtotal,
       row_number() OVER (ORDER BY o.id, l.product_id) AS id
FROM m_lines l JOIN m_new_orders o ON o.user_id = l.user_id""")
ORACLE["chg5_checkout_tracking"] = _with(_CHECKOUT, """
SELECT (SELECT max(id) FROM m_tracking) + row_number() OVER (ORDER BY id) AS id, id AS order_id,
       'order_placed' AS status, CAST(NULL AS VARCHAR) AS location,
       'Order has been placed successfully' AS notes, created_at FROM m_new_orders""")
ORACLE["chg5_checkout_rejects"] = _with(_CHECKOUT, """
SELECT request_id, user_id, delivery_address, requested_at, 'Cart is empty' AS message FROM m_creq
WHERE request_id NOT IN (SELECT request_id FROM m_placed)""")
ORACLE["chg5_cart_left"] = _with(_CHECKOUT, """
SELECT * FROM m_cart WHERE user_id NOT IN (SELECT user_id FROM m_placed)""")

_OPEN_PAY = """
m_payreq AS (
  SELECT 'pay-' || o_orderkey AS request_id, o_orderkey AS order_id,
         CASE WHEN o_orderstatus = 'F' THEN o_custkey + 1 ELSE o_custkey END AS user_id,
         CASE WHEN o_orderpriority LIKE '5%' THEN 'n/a' ELSE lpad(CAST(o_custkey AS VARCHAR), 10, '0') END AS phone_number,
         o_orderdate + INTERVAL 1 HOUR AS requested_at FROM orders),
m_paymarked AS (
  SELECT r.*, o.total_amount AS amount,
         CASE WHEN NOT coalesce(regexp_matches(r.phone_number, '^[0-9]{10}$'), false)
                THEN 'Please enter a valid 10-digit phone number'
              WHEN o.id IS NULL THEN 'Order not found' END AS message
  FROM m_payreq r LEFT JOIN m_orders o ON o.id = r.order_id AND o.user_id = r.user_id)
"""
ORACLE["chg6_open_payments"] = _with(_OPEN_PAY, """
SELECT id, order_id,
       'WV' || CAST(CAST(epoch(requested_at) AS BIGINT) AS VARCHAR)
         || CASE WHEN length(CAST(order_id AS VARCHAR)) >= 4 THEN CAST(order_id AS VARCHAR)
                 ELSE lpad(CAST(order_id AS VARCHAR), 4, '0') END || '-' || id AS transaction_id,
       phone_number, amount, 'pending' AS status, CAST(NULL AS VARCHAR) AS result_code,
       CAST(NULL AS VARCHAR) AS result_desc, requested_at AS created_at, CAST(NULL AS TIMESTAMP) AS completed_at,
       request_id
FROM (SELECT *, (SELECT max(id) FROM m_payments) + row_number() OVER (ORDER BY requested_at, request_id) AS id
      FROM m_paymarked WHERE message IS NULL)""")
ORACLE["chg6_payment_rejects"] = _with(_OPEN_PAY, """
SELECT request_id, order_id, user_id, phone_number, requested_at, message FROM m_paymarked WHERE message IS NOT NULL""")

_APPLY_PAY = """
m_conf AS (
  SELECT event_id AS confirmation_id,
         CASE WHEN event_type = 'click' THEN 'WVX' || event_id ELSE 'WV' || event_id END AS transaction_id,
         CASE WHEN value < 5 THEN '1' WHEN value < 10 THEN NULL ELSE '0' END AS result_code,
         CASE WHEN value < 5 THEN 'Failed' ELSE 'Success' END AS result_desc,
         ts + INTERVAL 1 MINUTE AS confirmed_at
  FROM events WHERE event_type IN ('view', 'click', 'purchase')
  UNION ALL
  SELECT event_id + 1000000000, 'WV' || event_id, CASE WHEN value < 5 THEN '1' ELSE '0' END,
         CASE WHEN value < 5 THEN 'Failed' ELSE 'Success' END, ts + INTERVAL 2 MINUTE
  FROM events WHERE event_type = 'view' AND value > 100),
m_cmsg AS (
  SELECT c.*, p.order_id,
         CASE WHEN c.result_code IS NULL THEN 'Missing result code'
              WHEN p.status IS NULL THEN 'Transaction not found'
              WHEN (p.status = 'pending') IS NOT TRUE THEN 'Payment already processed'
              WHEN row_number() OVER (PARTITION BY c.transaction_id, c.result_code IS NULL
                                      ORDER BY c.confirmed_at, c.confirmation_id) > 1
                THEN 'Duplicate confirmation' END AS message
  FROM m_conf c LEFT JOIN m_payments p ON p.transaction_id = c.transaction_id),
m_applied AS (SELECT * FROM m_cmsg WHERE message IS NULL)
"""
ORACLE["chg7_payments_updated"] = _with(_APPLY_PAY, """
SELECT p.id, p.order_id, p.transaction_id, p.phone_number, p.amount,
       CASE WHEN a.result_code = '0' THEN 'completed' WHEN a.result_code IS NOT NULL THEN 'failed' ELSE p.status END AS status,
       coalesce(a.result_code, p.result_code) AS result_code, coalesce(a.result_desc, p.result_desc) AS result_desc,
       p.created_at, CASE WHEN a.result_code = '0' THEN a.confirmed_at ELSE p.completed_at END AS completed_at
FROM m_payments p LEFT JOIN m_applied a ON a.transaction_id = p.transaction_id""")
ORACLE["chg7_tracking_added"] = _with(_APPLY_PAY, """
SELECT (SELECT max(id) FROM m_tracking) + row_number() OVER (ORDER BY confirmed_at, transaction_id) AS id, order_id,
       'payment_received' AS status, CAST(NULL AS VARCHAR) AS location, 'Payment confirmed via M-Pesa' AS notes,
       confirmed_at AS created_at FROM m_applied WHERE result_code = '0'""")
ORACLE["chg7_rejects"] = _with(_APPLY_PAY, """
SELECT confirmation_id, transaction_id, result_code, confirmed_at, message FROM m_cmsg WHERE message IS NOT NULL""")
ORACLE["join11_orders_paid"] = _with(_APPLY_PAY, """
SELECT o.id, o.user_id, o.total_amount, CASE WHEN pa.paid_at IS NOT NULL THEN 'processing' ELSE o.status END AS status,
       o.delivery_address, o.created_at, coalesce(pa.paid_at, o.updated_at) AS updated_at
FROM m_orders o LEFT JOIN (SELECT order_id, max(confirmed_at) AS paid_at FROM m_applied WHERE result_code = '0'
                           GROUP BY order_id) pa ON pa.order_id = o.id""")

_TRACK_ALL = ("'order_placed', 'payment_received', 'processing', 'in_transit', 'out_for_delivery', 'delivered', "
              "'cancelled'")
_ORDER_ALL = "'pending', 'processing', 'in_transit', 'delivered', 'cancelled'"
_STATUS_UPD = f"""
m_sreq AS (
  SELECT event_id AS request_id,
         CASE WHEN event_type = 'click' THEN [user_id, user_id + 1000000000] ELSE [user_id] END AS order_ids,
         CASE event_type WHEN 'signup' THEN 'pending' WHEN 'click' THEN 'out_for_delivery' WHEN 'view' THEN 'in_transit'
              WHEN 'purchase' THEN 'delivered' WHEN 'error' THEN 'refunded' END AS kind,
         CASE WHEN event_id % 97 <> 0 THEN kind END AS status,
         'update ' || event_type AS notes, ts AS requested_at FROM events),
m_spairs AS (SELECT request_id, unnest(order_ids) AS order_id, status, notes, requested_at FROM m_sreq),
m_smarked AS (
  SELECT p.*, CASE WHEN o.id IS NULL THEN 'Order not found'
                   WHEN (p.status IN ({_TRACK_ALL}, {_ORDER_ALL})) IS NOT TRUE THEN 'Invalid status' END AS message
  FROM m_spairs p LEFT JOIN m_orders o ON o.id = p.order_id),
m_sok AS (SELECT * FROM m_smarked WHERE message IS NULL)
"""
ORACLE["chg8_tracking_added"] = _with(_STATUS_UPD, f"""
SELECT (SELECT max(id) FROM m_tracking) + row_number() OVER (ORDER BY requested_at, request_id, order_id) AS id,
       order_id, status, CAST(NULL AS VARCHAR) AS location, notes, requested_at AS created_at
FROM m_sok WHERE status IN ({_TRACK_ALL})""")
ORACLE["chg8_orders_updated"] = _with(_STATUS_UPD, f"""
SELECT o.id, o.user_id, o.total_amount, coalesce(l.status, o.status) AS status, o.delivery_address, o.created_at,
       coalesce(l.last_at, o.updated_at) AS updated_at
FROM m_orders o LEFT JOIN (
  SELECT order_id, status, last_at FROM (
    SELECT order_id, status, max(requested_at) OVER (PARTITION BY order_id) AS last_at,
           row_number() OVER (PARTITION BY order_id ORDER BY requested_at DESC, request_id DESC) AS rn
    FROM m_sok WHERE status IN ({_ORDER_ALL})) WHERE rn = 1) l ON l.order_id = o.id""")
ORACLE["chg8_rejects"] = _with(_STATUS_UPD, """
SELECT order_id, request_id, status, notes, requested_at, message FROM m_smarked WHERE message IS NOT NULL""")

_SIGNUP = """
m_ureq AS (
  SELECT event_id AS request_id, 'Customer#' || lpad(CAST(user_id AS VARCHAR), 9, '0') AS full_name,
         CASE WHEN value >= 200 THEN 'Customer' || lpad(CAST(user_id AS VARCHAR), 9, '0') || '@Example.com'
              ELSE 'user' || user_id || '@example.com' END AS email,
         CASE WHEN value < 20 THEN '12345' ELSE '(555) 010-' || lpad(CAST(user_id AS VARCHAR), 4, '0') END AS phone,
         CASE WHEN value >= 300 THEN 'master_admin' WHEN value >= 100 THEN 'admin' ELSE 'customer' END AS role,
         ts AS requested_at FROM events WHERE event_type = 'signup'),
m_upre AS (
  SELECT *, CASE WHEN full_name IS NULL OR trim(full_name) = '' OR email IS NULL OR trim(email) = ''
                   OR phone IS NULL OR trim(phone) = '' THEN 'Please fill in all fields'
                 WHEN NOT coalesce(regexp_matches(regexp_replace(phone, '[^0-9]', '', 'g'), '^[0-9]{10}$'), false)
                   THEN 'Please enter a valid 10-digit phone number'
                 WHEN role IS NULL OR role NOT IN ('customer', 'admin') THEN 'Invalid role' END AS message
  FROM m_ureq),
m_uvalid AS (SELECT *, lower(trim(email)) AS lemail FROM m_upre WHERE message IS NULL),
m_ufresh AS (SELECT * FROM m_uvalid v WHERE NOT EXISTS (SELECT 1 FROM m_users u WHERE lower(trim(u.email)) = v.lemail)),
m_uwin AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lemail ORDER BY requested_at, request_id) AS rn
                 FROM m_ufresh) WHERE rn = 1),
m_new_users AS (
  SELECT (SELECT max(id) FROM m_users) + row_number() OVER (ORDER BY requested_at, request_id) AS id, full_name, email,
         phone, role, requested_at AS created_at, regexp_replace(phone, '[^0-9]', '', 'g') AS phone_digits, request_id
  FROM m_uwin)
"""
ORACLE["chg9_new_users"] = _with(_SIGNUP, "SELECT * FROM m_new_users")
ORACLE["join10_new_signup_emails"] = _with(_SIGNUP, "SELECT email FROM m_new_users")
ORACLE["chg9_signup_rejects"] = _with(_SIGNUP, """
SELECT request_id, full_name, email, phone, role, requested_at, message FROM m_upre WHERE message IS NOT NULL
UNION ALL
SELECT request_id, full_name, email, phone, role, requested_at, 'Email already exists' FROM m_uvalid
WHERE request_id NOT IN (SELECT request_id FROM m_uwin)""")

_PRODUCTS = """
m_chreq AS (
  SELECT 'up-' || p_partkey AS request_id, 'update' AS action, p_partkey AS product_id, upper(p_name) AS name,
         CAST(CAST(p_retailprice AS DECIMAL(10,2)) * 1.1 AS DECIMAL(10,2)) AS price, CAST(p_size + 5 AS INTEGER) AS quantity,
         p_type || ' (updated)' AS description,
         CASE WHEN p_size < 25 THEN '' ELSE 'img/new-' || lower(replace(p_brand, '#', '')) || '.png' END AS image,
         TIMESTAMP '2024-03-01 00:00:00' AS requested_at FROM part
  UNION ALL
  SELECT 'up2-' || p_partkey, 'update', p_partkey, p_name, CAST(CAST(p_retailprice AS DECIMAL(10,2)) * 1.2 AS DECIMAL(10,2)),
         CAST(p_size AS INTEGER), p_type, '', TIMESTAMP '2024-03-02 00:00:00' FROM part WHERE p_size > 40
  UNION ALL
  SELECT 'upx-' || s_suppkey, 'update', s_suppkey + 1000000000, s_name, CAST(1 AS DECIMAL(10,2)), 1, 'none',
         CAST(NULL AS VARCHAR), TIMESTAMP '2024-03-01 00:00:00' FROM supplier
  UNION ALL
  SELECT 'add-' || s_suppkey, 'add', CAST(NULL AS BIGINT), s_name, CAST(s_acctbal AS DECIMAL(10,2)), 100, 'new',
         CAST(NULL AS VARCHAR), TIMESTAMP '2024-03-01 00:00:00' FROM supplier
  UNION ALL
  SELECT 'no-add-' || s_suppkey, CAST(NULL AS VARCHAR), CAST(NULL AS BIGINT), s_name, CAST(s_acctbal AS DECIMAL(10,2)), 100,
         'new', CAST(NULL AS VARCHAR), TIMESTAMP '2024-03-01 00:00:00' FROM supplier),
m_chmarked AS (
  SELECT r.*, CASE WHEN (r.action IN ('add', 'update')) IS NOT TRUE THEN 'Invalid action'
                   WHEN r.action = 'update' AND i.id IS NULL THEN 'Product not found'
                   WHEN (r.name IS NULL OR trim(r.name) = '' OR r.price IS NULL OR r.quantity IS NULL OR r.price < 0
                         OR r.quantity < 0) AND r.action = 'add' THEN 'Failed to add product'
                   WHEN r.name IS NULL OR trim(r.name) = '' OR r.price IS NULL OR r.quantity IS NULL OR r.price < 0
                         OR r.quantity < 0 THEN 'Failed to update product' END AS message
  FROM m_chreq r LEFT JOIN m_inventory i ON i.id = r.product_id),
m_chok AS (SELECT * FROM m_chmarked WHERE message IS NULL),
m_chlast AS (
  SELECT product_id, name, price, quantity, description, max_at FROM (
    SELECT *, max(requested_at) OVER (PARTITION BY product_id) AS max_at,
           row_number() OVER (PARTITION BY product_id ORDER BY requested_at DESC, request_id DESC) AS rn
    FROM m_chok WHERE action = 'update') WHERE rn = 1),
m_chimg AS (
  SELECT product_id, image FROM (
    SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY requested_at DESC, request_id DESC) AS rn
    FROM m_chok WHERE action = 'update' AND image IS NOT NULL AND image NOT IN ('', '0')) WHERE rn = 1),
m_chinv AS (
  SELECT i.id, coalesce(l.name, i.name) AS name, coalesce(l.description, i.description) AS description,
         coalesce(l.price, i.price) AS price, coalesce(l.quantity, i.quantity) AS quantity,
         coalesce(g.image, i.image) AS image, i.created_at, coalesce(l.max_at, i.updated_at) AS updated_at
  FROM m_inventory i LEFT JOIN m_chlast l ON l.product_id = i.id LEFT JOIN m_chimg g ON g.product_id = i.id
  UNION ALL
  SELECT (SELECT max(id) FROM m_inventory) + row_number() OVER (ORDER BY requested_at, request_id), name, description,
         price, quantity, image, requested_at, requested_at
  FROM m_chok WHERE action = 'add')
"""
ORACLE["chg1_product_changes"] = _with(_PRODUCTS, "SELECT * FROM m_chinv")
ORACLE["chg1_product_rejects"] = _with(_PRODUCTS, """
SELECT request_id, action, product_id, name, price, quantity, description, image, requested_at, message
FROM m_chmarked WHERE message IS NOT NULL""")
ORACLE["chg2_product_deletes"] = _with(_PRODUCTS, """
SELECT * FROM m_chinv i WHERE EXISTS (SELECT 1 FROM m_sales s WHERE s.product_id = i.id)""")
ORACLE["chg2_delete_rejects"] = _with(_PRODUCTS, """
SELECT 'del-' || i.id AS request_id, i.id AS product_id, 'Cannot delete product with sales history' AS message
FROM m_chinv i WHERE EXISTS (SELECT 1 FROM m_sales s WHERE s.product_id = i.id)""")


# ---------------------------------------------------------------- sinks and streams

ORACLE["snk1_export_csv"] = _sql(f"""
SELECT name AS "Product", description AS "Description", quantity AS "Current Stock", total_sales AS "Total Sales",
       revenue AS "Revenue" FROM ({_INV_PERIOD.format(cond=MONTH_EXPORT)})""")
ORACLE["snk1_one_file_inventory"] = ORACLE["snk1_export_csv"]
ORACLE["snk1_export_sales"] = ORACLE["snk1_one_file_sales"] = _sql(f"""
SELECT transaction_date AS "Date", product_name AS "Product", customer_name AS "Customer", quantity AS "Quantity",
       total_amount AS "Total Amount" FROM m_detail WHERE {MONTH_EXPORT}""")
ORACLE["snk1_export_user_activity"] = ORACLE["snk1_one_file_user_activity"] = _sql(f"""
SELECT full_name AS "User", email AS "Email", role AS "Role", total_purchases AS "Total Purchases", total_spent AS "Total Spent",
       last_purchase AS "Last Purchase" FROM ({_USER_PERIOD.format(cond=YEAR_EXPORT)})""")
ORACLE["snk2_stored_reports"] = _sql("""
SELECT CAST(r.id AS BIGINT) AS id, r.label || ' Report - 2001-08-01 12:00:00' AS title, r.type, CAST(1 AS BIGINT) AS generated_by,
       TIMESTAMP '2001-08-01 12:00:00' AS generated_at,
       CASE WHEN r.id = 1 THEN (SELECT CAST(coalesce(sum(total_amount), 0) AS DECIMAL(38,2)) FROM m_month_detail) END AS total_revenue,
       CASE WHEN r.id = 1 THEN TIMESTAMP '2001-07-02 00:00:00' END AS period_start,
       CASE WHEN r.id = 1 THEN TIMESTAMP '2001-08-01 12:00:00' END AS period_end,
       CASE r.id WHEN 1 THEN (SELECT count(*) FROM m_month_detail) WHEN 2 THEN (SELECT count(*) FROM m_inventory)
                 ELSE (SELECT count(*) FROM m_users) END AS n_lines
FROM (VALUES (1, 'sales', 'Sales'), (2, 'inventory', 'Inventory'), (3, 'user_activity', 'User_activity')) r(id, type, label)""")
ORACLE["snk2_stored_report_lines"] = _sql("""
SELECT CAST(1 AS BIGINT) AS id, row_number() OVER (ORDER BY transaction_date DESC, sale_key) AS position, sale_key AS label,
       CAST(total_amount AS DECIMAL(38,2)) AS figure FROM m_month_detail
UNION ALL
SELECT 2, row_number() OVER (ORDER BY lower(name), id), name, revenue FROM m_inventory_report
UNION ALL
SELECT 3, row_number() OVER (ORDER BY lower(full_name), id), full_name, CAST(total_purchases AS DECIMAL(38,2)) FROM m_user_sales""")
ORACLE["snk2_report_snapshot"] = _sql("""
SELECT 'inventory-20010801120000' AS report_id, 'Inventory Report - 2001-08-01 12:00:00' AS title, 'inventory' AS type,
       CAST(1 AS BIGINT) AS generated_by, TIMESTAMP '2001-08-01 12:00:00' AS generated_at, id, name, total_sales, revenue
FROM m_inventory_report""")

_EVENT_SALES = """
m_esales AS (
  SELECT event_id AS sale_id, user_id, user_id * 13 + CAST(json_extract_string(props, '$.k') AS BIGINT) % 13 AS product_id,
         CAST(1 + CAST(floor(value) AS BIGINT) % 9 AS INTEGER) AS quantity, CAST(value AS DECIMAL(10,2)) AS total_amount,
         ts AS transaction_date FROM events WHERE event_type = 'purchase')
"""
ORACLE["str1_daily_sales_stream"] = _with(_EVENT_SALES, """
SELECT CAST(transaction_date AS DATE) AS day, CAST(sum(total_amount) AS DECIMAL(38,2)) AS revenue, count(*) AS sales
FROM m_esales GROUP BY 1
HAVING CAST(CAST(transaction_date AS DATE) AS TIMESTAMP) + INTERVAL 1 DAY
       <= (SELECT max(date_trunc('second', transaction_date)) - INTERVAL 1 DAY FROM m_esales)""")
ORACLE["str2_current_status_stream"] = _sql("""
SELECT c.order_id, c.current_status, m.status_at FROM m_current c
JOIN (SELECT order_id, max(created_at) AS status_at FROM m_tracking GROUP BY 1) m ON m.order_id = c.order_id""")
ORACLE["str3_product_totals_stream"] = _with(_EVENT_SALES, """
SELECT i.id AS product_id, i.name, CAST(coalesce(a.total_sales, 0) AS BIGINT) AS total_sales,
       CAST(coalesce(a.revenue, 0) AS DECIMAL(38,2)) AS revenue
FROM m_inventory i LEFT JOIN (SELECT product_id, sum(quantity) AS total_sales, sum(total_amount) AS revenue
                              FROM m_esales GROUP BY 1) a ON a.product_id = i.id""")

_STR4 = """
m_sreqs AS (
  SELECT event_id AS request_id, user_id, user_id * 13 + CAST(json_extract_string(props, '$.k') AS BIGINT) % 13 AS product_id,
         CAST(1 + CAST(floor(value) AS BIGINT) % 9 AS INTEGER) AS quantity, ts AS requested_at FROM events),
m_sstock0 AS (SELECT id, price, CAST(quantity AS BIGINT) AS stock FROM m_inventory),
m_sseq AS (
  SELECT r.*, s.price, row_number() OVER (PARTITION BY r.product_id ORDER BY r.requested_at, r.request_id) AS rn
  FROM m_sreqs r JOIN m_sstock0 s ON s.id = r.product_id WHERE r.quantity >= 1),
m_swalk AS (
  SELECT id AS product_id, CAST(0 AS BIGINT) AS rn, stock, CAST(NULL AS BOOLEAN) AS ok FROM m_sstock0
  UNION ALL
  SELECT w.product_id, q.rn, CASE WHEN q.quantity <= w.stock THEN w.stock - q.quantity ELSE w.stock END,
         q.quantity <= w.stock
  FROM m_swalk w JOIN m_sseq q ON q.product_id = w.product_id AND q.rn = w.rn + 1)
"""
ORACLE["str4_purchases_stream_sales"] = _rsql(_STR4, """
SELECT q.request_id, q.user_id, q.product_id, q.quantity, CAST(q.quantity * q.price AS DECIMAL(10,2)) AS total_amount,
       q.requested_at AS transaction_date
FROM m_sseq q JOIN m_swalk w ON w.product_id = q.product_id AND w.rn = q.rn WHERE w.ok""")
ORACLE["str4_purchases_stream_stock"] = _rsql(_STR4, """
SELECT product_id AS id, CAST(arg_max(stock, rn) AS INTEGER) AS quantity FROM m_swalk GROUP BY product_id""")
ORACLE["src1_read_table"] = ORACLE["src1_read_inventory"]
ORACLE["join9_deletable_products"] = _with(_PRODUCTS, """
SELECT i.id AS product_id, i.name FROM m_chinv i
WHERE NOT EXISTS (SELECT 1 FROM m_sales s WHERE s.product_id = i.id)""")
ORACLE["src2_check_tables"] = _with(_CART, """
SELECT 'users' AS table_name, outcome, count(*) AS row_count FROM (
  SELECT CASE WHEN id IS NULL THEN 'id is null' WHEN full_name IS NULL THEN 'full_name is null'
              WHEN email IS NULL THEN 'email is null' WHEN phone IS NULL THEN 'phone is null'
              WHEN role IS NOT NULL AND role NOT IN ('customer', 'admin', 'master_admin')
                THEN 'role not in customer/admin/master_admin'
              WHEN count(*) OVER (PARTITION BY id) > 1 THEN 'duplicate id'
              WHEN count(*) OVER (PARTITION BY lower(email)) > 1 THEN 'duplicate email'
              ELSE 'ok' END AS outcome FROM m_users) GROUP BY 1, 2
UNION ALL
SELECT 'payments' AS table_name, outcome, count(*) AS row_count FROM (
  SELECT CASE WHEN id IS NULL THEN 'id is null' WHEN order_id IS NULL THEN 'order_id is null'
              WHEN transaction_id IS NULL THEN 'transaction_id is null'
              WHEN phone_number IS NULL THEN 'phone_number is null' WHEN amount IS NULL THEN 'amount is null'
              WHEN status IS NOT NULL AND status NOT IN ('pending', 'completed', 'failed')
                THEN 'status not in pending/completed/failed'
              WHEN count(*) OVER (PARTITION BY id) > 1 THEN 'duplicate id'
              WHEN count(*) OVER (PARTITION BY transaction_id) > 1 THEN 'duplicate transaction_id'
              WHEN NOT EXISTS (SELECT 1 FROM m_orders o WHERE o.id = p.order_id) THEN 'order_id has no orders.id'
              ELSE 'ok' END AS outcome FROM m_payments p) GROUP BY 1, 2
UNION ALL
SELECT 'order_tracking' AS table_name, outcome, count(*) AS row_count FROM (
  SELECT CASE WHEN id IS NULL THEN 'id is null' WHEN order_id IS NULL THEN 'order_id is null'
              WHEN status IS NULL THEN 'status is null'
              WHEN status NOT IN ('order_placed', 'payment_received', 'processing', 'in_transit', 'out_for_delivery',
                                  'delivered', 'cancelled')
                THEN 'status not in order_placed/payment_received/processing/in_transit/out_for_delivery/delivered/cancelled'
              WHEN count(*) OVER (PARTITION BY id) > 1 THEN 'duplicate id'
              WHEN NOT EXISTS (SELECT 1 FROM m_orders o WHERE o.id = t.order_id) THEN 'order_id has no orders.id'
              ELSE 'ok' END AS outcome FROM m_tracking t) GROUP BY 1, 2
UNION ALL
SELECT 'cart' AS table_name, outcome, count(*) AS row_count FROM (
  SELECT CASE WHEN user_id IS NULL THEN 'user_id is null' WHEN product_id IS NULL THEN 'product_id is null'
              WHEN quantity IS NULL THEN 'quantity is null'
              WHEN count(*) OVER (PARTITION BY user_id, product_id) > 1 THEN 'duplicate user_id+product_id'
              WHEN NOT EXISTS (SELECT 1 FROM m_users u WHERE u.id = c.user_id) THEN 'user_id has no users.id'
              WHEN NOT EXISTS (SELECT 1 FROM m_inventory i WHERE i.id = c.product_id) THEN 'product_id has no inventory.id'
              ELSE 'ok' END AS outcome FROM m_cart c) GROUP BY 1, 2
""")

_FK = "WHEN NOT EXISTS (SELECT 1 FROM {parent} p WHERE p.id = t.{col}) THEN '{col} has no {name}.id'"
_TO = {name: lambda col, name=name: _FK.format(parent=f"m_{name}", col=col, name=name) for name in ("users", "inventory", "orders")}
_OFF = "CASE WHEN {key} % 50 = 1 THEN {col} + 1000000000 ELSE {col} END AS {col}"
ORACLE["src2_check_flawed_tables"] = _sql(f"""
SELECT 'users' AS table_name, outcome, count(*) AS row_count FROM (
  SELECT CASE WHEN full_name IS NULL THEN 'full_name is null'
              WHEN role NOT IN ('customer', 'admin', 'master_admin') THEN 'role not in customer/admin/master_admin'
              WHEN count(*) OVER (PARTITION BY lower(email)) > 1 THEN 'duplicate email' ELSE 'ok' END AS outcome
  FROM (SELECT CASE WHEN id % 50 <> 0 THEN full_name END AS full_name,
               CASE role WHEN 'BUILDING' THEN 'admin' WHEN 'MACHINERY' THEN role ELSE 'customer' END AS role,
               CASE WHEN id % 50 = 2 THEN upper('customer' || lpad(CAST(id - 1 AS VARCHAR), 9, '0') || '@example.com') ELSE email END AS email
        FROM m_users)) GROUP BY 1, 2
UNION ALL
SELECT 'inventory', outcome, count(*) FROM (
  SELECT CASE WHEN name IS NULL THEN 'name is null' WHEN price IS NULL THEN 'price is null'
              WHEN count(*) OVER (PARTITION BY id) > 1 THEN 'duplicate id' ELSE 'ok' END AS outcome
  FROM (SELECT CASE WHEN id % 50 = 2 THEN id - 1 ELSE id END AS id, CASE WHEN id % 50 <> 1 THEN name END AS name,
               CASE WHEN id % 50 <> 0 THEN price END AS price FROM m_inventory)) GROUP BY 1, 2
UNION ALL
SELECT 'sales', outcome, count(*) FROM (
  SELECT CASE WHEN quantity IS NULL THEN 'quantity is null' {_TO['users']('user_id')} {_TO['inventory']('product_id')} ELSE 'ok' END AS outcome
  FROM (SELECT user_id, CASE WHEN user_id % 50 <> 0 THEN quantity END AS quantity, {_OFF.format(key='user_id', col='product_id')} FROM m_sales) t) GROUP BY 1, 2
UNION ALL
SELECT 'orders', outcome, count(*) FROM (
  SELECT CASE WHEN total_amount IS NULL THEN 'total_amount is null'
              WHEN status NOT IN ('pending', 'processing', 'in_transit', 'delivered', 'cancelled')
                THEN 'status not in pending/processing/in_transit/delivered/cancelled'
              WHEN count(*) OVER (PARTITION BY id) > 1 THEN 'duplicate id' {_TO['users']('user_id')} ELSE 'ok' END AS outcome
  FROM (SELECT id, CASE WHEN id % 50 <> 0 THEN total_amount END AS total_amount, {_OFF.format(key='id', col='user_id')},
               CASE WHEN id % 50 = 3 THEN 'lost' ELSE status END AS status FROM m_orders) t) GROUP BY 1, 2
UNION ALL
SELECT 'order_items', outcome, count(*) FROM (
  SELECT CASE WHEN quantity IS NULL THEN 'quantity is null' {_TO['orders']('order_id')} {_TO['inventory']('product_id')} ELSE 'ok' END AS outcome
  FROM (SELECT product_id, CASE WHEN product_id % 50 <> 0 THEN quantity END AS quantity, {_OFF.format(key='product_id', col='order_id')} FROM m_items) t) GROUP BY 1, 2
UNION ALL
SELECT 'reports', outcome, count(*) FROM (
  SELECT CASE WHEN title IS NULL THEN 'title is null' WHEN type NOT IN ('sales', 'inventory', 'user_activity') THEN 'type not in sales/inventory/user_activity'
              WHEN count(*) OVER (PARTITION BY id) > 1 THEN 'duplicate id' {_TO['users']('generated_by')} ELSE 'ok' END AS outcome
  FROM (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 50 <> 0 THEN s_name END AS title, CASE WHEN s_suppkey % 50 = 3 THEN 'weather' ELSE 'sales' END AS type,
               CASE WHEN s_suppkey % 50 = 1 THEN s_suppkey + 1 + 1000000000 ELSE s_suppkey + 1 END AS generated_by FROM supplier) t) GROUP BY 1, 2
""")

# ---------------------------------------------------------------- tables kept in buckets, roll-ups, accounted days

for _name, _same in {"chg1_kept_products": "chg1_product_changes", "chg1_kept_rejects": "chg1_product_rejects",
                     "chg2_kept_products": "chg2_product_deletes", "chg7_kept_payments": "chg7_payments_updated",
                     "chg7_kept_tracking": "chg7_tracking_added", "join11_kept_orders": "join11_orders_paid",
                     "chg8_kept_orders": "chg8_orders_updated", "chg8_kept_tracking": "chg8_tracking_added",
                     "rep5_rollup_export": "rep5_inventory_export", "rep6_rollup_export": "rep6_user_activity_export"}.items():
    ORACLE[_name] = ORACLE[_same]
ORACLE["rep8_kept_history"] = _sql("""
SELECT o.id, o.user_id, o.status, c.current_status FROM m_orders o LEFT JOIN m_current c ON c.order_id = o.id
WHERE o.user_id IN (SELECT id FROM m_users WHERE role = 'BUILDING')""")
ORACLE["rep8_kept_lines"] = _sql("""
SELECT i.*, p.name, p.image FROM m_items i JOIN m_inventory p ON p.id = i.product_id JOIN m_orders o ON o.id = i.order_id
WHERE o.user_id IN (SELECT id FROM m_users WHERE role = 'BUILDING')""")
ORACLE["win1_kept_status"] = _sql("""
SELECT o.id, o.user_id, o.status, c.current_status FROM m_orders o LEFT JOIN m_current c ON c.order_id = o.id
WHERE o.created_at >= TIMESTAMP '1998-01-01 00:00:00' AND o.created_at < TIMESTAMP '1999-01-01 00:00:00'""")
ORACLE["agg2_rollup_products"] = _sql("""
SELECT product_id, CAST(sum(quantity) AS BIGINT) AS total_sales, CAST(sum(total_amount) AS DECIMAL(38,2)) AS revenue FROM m_sales
WHERE transaction_date >= TIMESTAMP '2000-03-15 06:30:00' AND transaction_date < TIMESTAMP '2001-06-01 00:00:00' GROUP BY product_id""")
ORACLE["agg4_rollup_users"] = _sql("""
SELECT user_id, count(*) AS total_purchases, CAST(sum(total_amount) AS DECIMAL(38,2)) AS total_spent, max(transaction_date) AS last_purchase
FROM m_sales WHERE transaction_date >= TIMESTAMP '2000-08-01 00:00:00' GROUP BY user_id""")
ORACLE["str1_accounted_days_stream"] = _with(_EVENT_SALES, """
SELECT CAST(transaction_date AS DATE) AS day, CAST(sum(total_amount) AS DECIMAL(38,2)) AS revenue, count(*) AS sales,
       CAST(CAST(transaction_date AS DATE) AS TIMESTAMP) + INTERVAL 1 DAY
         <= (SELECT max(date_trunc('second', transaction_date)) - INTERVAL 1 DAY FROM m_esales) AS closed
FROM m_esales GROUP BY 1""")
