"""Plain SQL definitions of the retail tables over the generated Parquet tables."""

from __future__ import annotations

import re

VIEWS: dict[str, str] = {
"v_orders": """
SELECT o.o_orderkey AS order_id, o.o_custkey AS customer_id, CAST(o.o_orderdate AS DATE) AS order_date,
  CASE WHEN o.o_orderstatus = 'F' AND o.o_orderkey % 4 = 0 THEN 'returned' WHEN o.o_orderstatus = 'F' THEN 'delivered'
       WHEN o.o_orderstatus = 'O' AND o.o_orderkey % 2 = 0 THEN 'paid'     WHEN o.o_orderstatus = 'O' THEN 'shipped'
       WHEN o.o_orderkey % 3 = 0 THEN 'created' ELSE 'cancelled' END AS order_status,
  CASE o.o_orderpriority WHEN '1-URGENT' THEN 'organic_search' WHEN '2-HIGH' THEN 'paid_search'
       WHEN '3-MEDIUM' THEN 'social_media' WHEN '4-NOT SPECIFIED' THEN 'email_campaign' ELSE 'referral' END AS order_source,
  CONCAT('method_', CAST(o.o_orderkey % 5 AS STRING)) AS payment_method, c.c_nationkey AS zip
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey""",
"v_payments": """
SELECT o_orderkey AS order_id, CAST(o_totalprice AS DECIMAL(12,2)) AS payment_value,
  CASE o_custkey % 5 WHEN 0 THEN 1 WHEN 1 THEN 3 WHEN 2 THEN 6 WHEN 3 THEN 9 ELSE 12 END AS installments
FROM orders""",
"v_order_items": """
SELECT l_orderkey * 10 + l_linenumber AS order_item_id, l_orderkey AS order_id, l_partkey AS product_id,
  CAST(l_quantity AS INT) AS quantity, CAST(l_extendedprice AS DECIMAL(12,2)) AS unit_price,
  CASE WHEN l_discount > 0 THEN CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_discount AS DECIMAL(4,2)) AS DECIMAL(18,4)) END AS discount_amount,
  CASE WHEN CAST(l_discount AS DECIMAL(4,2)) >= 0.06 THEN CONCAT('PROMO-', LPAD(CAST(l_partkey % 50 + 1 AS STRING), 4, '0')) END AS promo_id,
  l_suppkey AS src_supplier, l_returnflag AS src_flag, CAST(l_shipdate AS DATE) AS src_shipdate
FROM lineitem""",
"v_products": """
SELECT p_partkey AS product_id, CONCAT(p_name, ' #', CAST(p_partkey AS STRING)) AS product_name,
  CASE p_type WHEN 'ECONOMY' THEN 'Streetwear' WHEN 'STANDARD' THEN 'Outdoor' ELSE p_type END AS category,
  p_brand AS segment,
  CASE p_size % 6 WHEN 0 THEN 'S' WHEN 1 THEN 'M' WHEN 2 THEN 'L' WHEN 3 THEN 'XL' WHEN 4 THEN 'XXL' ELSE 'FREE' END AS size,
  CAST(p_retailprice AS DECIMAL(12,2)) AS price,
  CAST(CAST(p_retailprice AS DECIMAL(12,2)) * CAST(0.01 AS DECIMAL(4,2)) * CAST(50 + p_size % 30 AS DECIMAL(4,0)) AS DECIMAL(18,4)) AS cogs
FROM part""",
"v_customers": """
SELECT c_custkey AS customer_id,
  CASE WHEN c_acctbal < 0 THEN NULL WHEN c_acctbal < 2500 THEN '18-24' WHEN c_acctbal < 5000 THEN '25-34'
       WHEN c_acctbal < 7500 THEN '35-44' ELSE '45+' END AS age_group,
  CASE c_custkey % 3 WHEN 0 THEN 'Female' WHEN 1 THEN 'Male' ELSE 'Other' END AS gender,
  LOWER(c_mktsegment) AS acquisition_channel
FROM customer""",
"v_geography": """
SELECT n_nationkey AS zip, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey""",
"v_returns": """
SELECT l_orderkey AS order_id, l_partkey AS product_id,
  CASE l_linenumber WHEN 1 THEN 'wrong_size' WHEN 2 THEN 'wrong_size' WHEN 3 THEN 'defective' WHEN 4 THEN 'late'
       ELSE 'changed_mind' END AS return_reason
FROM lineitem WHERE l_returnflag = 'R'""",
"v_web_traffic": """
SELECT make_date(CAST(1999 + FLOOR((DAY(ts) - 1) / 12.0) AS INT), CAST((DAY(ts) - 1) % 12 + 1 AS INT), CAST(HOUR(ts) + 1 AS INT)) AS date,
  CASE event_type WHEN 'click' THEN 'organic_search' WHEN 'view' THEN 'paid_search' WHEN 'signup' THEN 'social_media'
       WHEN 'purchase' THEN 'email_campaign' ELSE 'direct' END AS traffic_source,
  CAST(COUNT(*) * 100 AS BIGINT) AS sessions, CAST(COUNT(DISTINCT user_id) AS BIGINT) AS unique_visitors,
  CAST(SUM(event_id % 7 + 1) * 100 AS BIGINT) AS page_views,
  AVG(CAST(CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END AS DOUBLE)) AS bounce_rate,
  AVG(CAST(event_id % 600 AS DOUBLE)) AS avg_session_duration_sec
FROM events GROUP BY 1, 2""",
"v_inventory": """
SELECT last_day(m) AS snapshot_date, product_id, product_name, category, stock_on_hand, units_sold, stockout_days,
  CASE WHEN stockout_days > 0 THEN 1 ELSE 0 END AS stockout_flag, CASE WHEN stock_on_hand > 3 * units_sold THEN 1 ELSE 0 END AS overstock_flag,
  30.0E0 * stock_on_hand / units_sold AS days_of_supply, 1.0E0 - stockout_days / 30.0E0 AS fill_rate,
  units_sold / (1.0E0 * units_sold + stock_on_hand) AS sell_through_rate
FROM (SELECT CAST(date_trunc('month', l.l_shipdate) AS DATE) AS m, p.product_id, p.product_name, p.category,
        CAST(MIN(l.l_partkey) % 97 AS BIGINT) AS stock_on_hand, CAST(SUM(l.l_quantity) AS BIGINT) AS units_sold,
        CAST(CASE WHEN MIN(l.l_partkey) % 3 = 0 THEN MIN(l.l_partkey) % 9 ELSE 0 END AS BIGINT) AS stockout_days
      FROM lineitem l JOIN v_products p ON l.l_partkey = p.product_id GROUP BY 1, 2, 3, 4) x""",
"v_master": """
SELECT i.order_item_id, i.order_id, o.customer_id, o.order_date, o.order_status, o.order_source, i.product_id, p.product_name, p.category,
  p.segment, i.quantity, i.discount_amount, i.promo_id,
  CAST(i.quantity * i.unit_price - COALESCE(i.discount_amount, 0) AS DECIMAL(18,4)) AS line_revenue,
  CAST(i.quantity * p.cogs AS DECIMAL(18,4)) AS line_cogs,
  CASE WHEN i.src_flag = 'R' THEN CAST(i.unit_price AS DECIMAL(18,4)) END AS refund_amount, i.src_supplier, i.src_shipdate
FROM v_order_items i JOIN v_orders o ON i.order_id = o.order_id JOIN v_products p ON i.product_id = p.product_id""",
"v_sales": """
SELECT order_date AS date, CAST(SUM(line_revenue) AS DECIMAL(18,4)) AS revenue, CAST(SUM(line_cogs) AS DECIMAL(18,4)) AS cogs
FROM v_master GROUP BY order_date""",
# --- steps shared by several queries ---
"once": """
SELECT * EXCLUDE (rn) FROM (SELECT m.*, ROW_NUMBER() OVER (PARTITION BY order_item_id ORDER BY
    order_id NULLS FIRST, product_id NULLS FIRST, src_supplier NULLS FIRST, src_shipdate NULLS FIRST, quantity NULLS FIRST,
    line_revenue NULLS FIRST, discount_amount NULLS FIRST, promo_id NULLS FIRST, refund_amount NULLS FIRST) AS rn
  FROM v_master m) WHERE rn = 1""",
"valid_once": """
SELECT *, CAST(date_trunc('month', order_date) AS DATE) AS month, line_revenue - COALESCE(refund_amount, 0) AS net_revenue,
  CASE WHEN COALESCE(promo_id, 'NO_PROMO') <> 'NO_PROMO' THEN 'Promo' ELSE 'Non-promo' END AS promo_group
FROM once WHERE order_status IN ('paid', 'shipped', 'delivered', 'returned')""",
"valid": """
SELECT *, CAST(date_trunc('month', order_date) AS DATE) AS month FROM v_orders
WHERE order_status IN ('paid', 'shipped', 'delivered', 'returned')""",
"orders_src": """
SELECT order_source AS source, COUNT(DISTINCT order_id) AS valid_orders FROM valid GROUP BY 1""",
"revenue_src": """
SELECT order_source AS source, SUM(net_revenue) AS net_revenue, SUM(line_revenue) AS gross_revenue,
  COUNT(DISTINCT order_item_id) AS order_items FROM valid_once GROUP BY 1""",
"traffic_src": """
SELECT traffic_source AS source, SUM(sessions) AS sessions, SUM(unique_visitors) AS unique_visitors, SUM(page_views) AS page_views,
  AVG(bounce_rate) AS avg_bounce_rate, AVG(avg_session_duration_sec) AS avg_session_duration_sec,
  SUM(bounce_rate * sessions) AS weighted_bounce, SUM(avg_session_duration_sec * sessions) AS weighted_duration
FROM v_web_traffic GROUP BY 1""",
"months": """
SELECT t.*, s.revenue, s.cogs, COALESCE(o.valid_orders, 0) AS valid_orders,
  COALESCE(o.valid_orders, 0) / CAST(t.sessions AS DOUBLE) * 100 AS conversion_rate
FROM (SELECT CAST(date_trunc('month', date) AS DATE) AS month, SUM(sessions) AS sessions, SUM(unique_visitors) AS unique_visitors,
        SUM(page_views) AS page_views, AVG(bounce_rate) AS avg_bounce_rate FROM v_web_traffic GROUP BY 1) t
JOIN (SELECT CAST(date_trunc('month', date) AS DATE) AS month, SUM(revenue) AS revenue, SUM(cogs) AS cogs FROM v_sales GROUP BY 1) s
  ON t.month = s.month
LEFT JOIN (SELECT month, COUNT(order_status) AS valid_orders FROM valid GROUP BY 1) o ON t.month = o.month""",
"win_orders": """
SELECT * FROM valid WHERE order_date BETWEEN (SELECT MIN(date) FROM v_web_traffic) AND (SELECT MAX(date) FROM v_web_traffic)""",
"win_lines": """
SELECT * FROM valid_once WHERE order_id IN (SELECT order_id FROM win_orders)""",
"win_level": """
SELECT order_id, order_source, customer_id, SUM(line_revenue) AS order_revenue, SUM(quantity) AS order_quantity
FROM win_lines GROUP BY 1, 2, 3""",
"win_value": """
SELECT order_source, SUM(order_revenue) AS revenue, COUNT(DISTINCT order_id) AS orders, COUNT(DISTINCT customer_id) AS customers,
  SUM(order_quantity) AS total_quantity FROM win_level GROUP BY 1""",
"dated_items": """
SELECT i.quantity * i.unit_price - COALESCE(i.discount_amount, 0) AS revenue, COALESCE(i.promo_id, 'NO_PROMO') <> 'NO_PROMO' AS is_promo,
  o.month FROM v_order_items i JOIN valid o ON i.order_id = o.order_id""",
"promo_months": """
SELECT month, SUM(revenue) AS total_revenue, SUM(CASE WHEN is_promo THEN revenue ELSE 0 END) AS promo_revenue,
  SUM(CASE WHEN is_promo THEN 1 ELSE 0 END) AS promo_order_items, COUNT(*) AS total_order_items FROM dated_items GROUP BY 1""",
"order_promos": """
SELECT *, CAST(date_trunc('month', order_date) AS DATE) AS month, CASE WHEN has_promo THEN 'Promo' ELSE 'Non-promo' END AS promo_group,
  revenue + discount AS gross_before_discount,
  COALESCE(CAST(discount AS DOUBLE) / NULLIF(CAST(revenue + discount AS DOUBLE), 0), 0) * 100 AS discount_pct
FROM (SELECT order_id, MIN(order_date) AS order_date, SUM(line_revenue) AS revenue, SUM(COALESCE(discount_amount, 0)) AS discount,
        SUM(quantity) AS quantity, BOOL_OR(promo_group = 'Promo') AS has_promo FROM valid_once GROUP BY 1) x""",
"inv": """
SELECT *, CAST(date_trunc('month', snapshot_date) AS DATE) AS month FROM v_inventory""",
"category_diag_base": """
SELECT category, AVG(sell_through_rate) AS avg_sell_through_rate, MEDIAN(sell_through_rate) AS median_sell_through_rate,
  AVG(stock_on_hand) AS avg_stock_on_hand, AVG(units_sold) AS avg_units_sold, SUM(stock_on_hand) AS total_stock_on_hand,
  SUM(units_sold) AS total_units_sold, AVG(days_of_supply) AS avg_days_of_supply, AVG(fill_rate) AS avg_fill_rate,
  AVG(overstock_flag) AS overstock_rate, AVG(stockout_flag) AS stockout_rate,
  AVG(overstock_flag) * 100 AS overstock_rate_pct, AVG(stockout_flag) * 100 AS stockout_rate_pct FROM inv GROUP BY 1""",
"aging_cells": """
SELECT b.aging_bucket, b.bucket_order, c.category, COALESCE(SUM(x.stock_on_hand * x.cogs), 0) AS inventory_value,
  AVG(x.stock_on_hand) AS avg_stock_on_hand, COUNT(x.product_id) AS sku_month_records, COALESCE(SUM(x.overstock_flag), 0) AS overstock_records
FROM (VALUES ('0-30 days', 1), ('31-60 days', 2), ('61-90 days', 3), ('91-180 days', 4), ('180+ days', 5)) b(aging_bucket, bucket_order)
CROSS JOIN (SELECT DISTINCT category FROM inv) c
LEFT JOIN (SELECT i.*, p.cogs, CASE WHEN days_of_supply >= 0 AND days_of_supply <= 30 THEN '0-30 days' WHEN days_of_supply > 30 AND days_of_supply <= 60 THEN '31-60 days'
     WHEN days_of_supply > 60 AND days_of_supply <= 90 THEN '61-90 days' WHEN days_of_supply > 90 AND days_of_supply <= 180 THEN '91-180 days'
     WHEN days_of_supply > 180 THEN '180+ days' END AS aging_bucket
   FROM inv i JOIN v_products p ON i.product_id = p.product_id) x
  ON x.aging_bucket = b.aging_bucket AND x.category = c.category
GROUP BY 1, 2, 3""",
"sku_perf": """
SELECT s.*, r.net_revenue, r.gross_revenue, r.total_quantity_ordered, r.order_item_count,
  (RANK() OVER (ORDER BY s.avg_sell_through_rate) + (COUNT(*) OVER (PARTITION BY s.avg_sell_through_rate) - 1) / 2.0E0) / COUNT(*) OVER () AS sell_through_rank_pct,
  (RANK() OVER (ORDER BY r.net_revenue) + (COUNT(*) OVER (PARTITION BY r.net_revenue) - 1) / 2.0E0) / COUNT(*) OVER () AS revenue_rank_pct
FROM (SELECT product_id, product_name, category, ROUND(AVG(sell_through_rate), 10) AS avg_sell_through_rate, SUM(units_sold) AS total_units_sold_inventory,
        AVG(stock_on_hand) AS avg_stock_on_hand, AVG(days_of_supply) AS avg_days_of_supply FROM inv GROUP BY 1, 2, 3) s
JOIN (SELECT product_id, product_name, category, SUM(net_revenue) AS net_revenue, SUM(line_revenue) AS gross_revenue,
        SUM(quantity) AS total_quantity_ordered, COUNT(DISTINCT order_item_id) AS order_item_count FROM valid_once GROUP BY 1, 2, 3) r
  USING (product_id, product_name, category)""",
}


def with_views(body: str, extra: dict[str, str] | None = None, materialized: frozenset[str] = frozenset()) -> str:
    """Prefix ``body`` with the definitions it uses, in order."""
    views = {**VIEWS, **(extra or {})}
    needed: set[str] = set()

    def visit(text: str) -> None:
        for word in set(re.findall(r"[a-z_0-9]+", text)) & set(views):
            if word not in needed:
                needed.add(word)
                visit(views[word])

    visit(body)
    kept = {n: " MATERIALIZED" if n in materialized else "" for n in views if n in needed}
    parts = [f"{n} AS{how} ({views[n].strip()})" for n, how in kept.items()]
    return f"WITH {', '.join(parts)} {body.strip()}" if parts else body.strip()
