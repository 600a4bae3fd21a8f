"""Reference SQL of the business questions and dashboard tables, one entry per query key."""

_MARGIN = "CAST(SUM(line_revenue) - SUM(line_cogs) - SUM(COALESCE(discount_amount, 0)) AS DOUBLE) / CAST(SUM(line_revenue) AS DOUBLE) * 100"
_LINE_SUMS = ("SUM(line_revenue) AS revenue, SUM(line_cogs) AS cogs, SUM(COALESCE(discount_amount, 0)) AS discount, "
              "SUM(quantity) AS quantity, COUNT(DISTINCT order_item_id) AS order_items")


def _bins(source: str, column: str) -> str:
    return f"""
SELECT bin, lo + (hi - lo) * bin / 40 AS bin_start, lo + (hi - lo) * (bin + 1) / 40 AS bin_end, records FROM (
  SELECT CAST(LEAST(FLOOR(({column} - lo) / (hi - lo) * 40), 39) AS INT) AS bin, lo, hi, COUNT(*) AS records
  FROM {source}, (SELECT MIN({column}) AS lo, MAX({column}) AS hi FROM {source}) s GROUP BY 1, 2, 3)"""


def _mix(attribute: str) -> str:
    return f"""
SELECT acquisition_channel, {attribute}, COUNT(DISTINCT customer_id) AS customers,
  COUNT(DISTINCT customer_id) / CAST(SUM(COUNT(DISTINCT customer_id)) OVER (PARTITION BY acquisition_channel) AS DOUBLE) * 100 AS share_pct
FROM v_customers WHERE acquisition_channel IS NOT NULL AND age_group IS NOT NULL AND gender IS NOT NULL GROUP BY 1, 2"""


def wide(inner: str, index: str, column: str, value: str, names: dict[str, str]) -> str:
    cols = ", ".join(f"COALESCE(MAX(CASE WHEN {column} = '{v}' THEN {value} END), 0) AS \"{n}\"" for v, n in names.items())
    return f"SELECT {index}, {cols} FROM ({inner}) z GROUP BY 1"


_PREF = """
SELECT order_source, category, SUM(quantity) AS quantity,
  CAST(SUM(quantity) AS DOUBLE) / CAST(SUM(SUM(quantity)) OVER (PARTITION BY order_source) AS DOUBLE) * 100 AS category_share_pct
FROM win_lines GROUP BY 1, 2"""
_UNITS = """
SELECT category, CASE WHEN promo_id IS NOT NULL THEN 'Promo' ELSE 'Non-promo' END AS promo_group, SUM(quantity) AS units_sold,
  CAST(SUM(quantity) AS DOUBLE) / CAST(SUM(SUM(quantity)) OVER (PARTITION BY category) AS DOUBLE) * 100 AS units_share_pct
FROM valid_once GROUP BY 1, 2"""
_SHARE = """
SELECT t.source AS traffic_source, t.sessions, COALESCE(v.revenue, 0) AS revenue,
  t.sessions / CAST(SUM(t.sessions) OVER () AS DOUBLE) * 100 AS traffic_share_pct,
  CAST(COALESCE(v.revenue, 0) AS DOUBLE) / CAST(SUM(COALESCE(v.revenue, 0)) OVER () AS DOUBLE) * 100 AS revenue_share_pct
FROM traffic_src t LEFT JOIN win_value v ON t.source = v.order_source"""
_INDEX = """
SELECT month, revenue, sessions, valid_orders, conversion_rate,
  CAST(revenue AS DOUBLE) / CAST(FIRST_VALUE(revenue) OVER (ORDER BY month) AS DOUBLE) * 100 AS revenue_index,
  CAST(sessions AS DOUBLE) / CAST(FIRST_VALUE(sessions) OVER (ORDER BY month) AS DOUBLE) * 100 AS sessions_index,
  conversion_rate / FIRST_VALUE(conversion_rate) OVER (ORDER BY month) * 100 AS conversion_index FROM months"""
_DISCOUNT = """
SELECT promo_group, COUNT(DISTINCT order_id) AS orders, SUM(revenue) AS revenue_after_discount, SUM(gross_before_discount) AS revenue_before_discount,
  SUM(discount) AS total_discount, CAST(SUM(gross_before_discount) AS DOUBLE) / COUNT(*) AS aov_before_discount,
  CAST(SUM(revenue) AS DOUBLE) / COUNT(*) AS aov_after_discount,
  CAST(SUM(gross_before_discount) AS DOUBLE) / COUNT(*) - CAST(SUM(revenue) AS DOUBLE) / COUNT(*) AS aov_discount_gap
FROM order_promos GROUP BY 1"""
_REGION = """
SELECT g.region, SUM(i.quantity * i.unit_price - COALESCE(i.discount_amount, 0)) AS revenue
FROM v_order_items i JOIN v_orders o ON i.order_id = o.order_id JOIN v_geography g ON o.zip = g.zip
WHERE o.order_status IS DISTINCT FROM 'cancelled' GROUP BY 1"""
_CHANNEL = """
SELECT COALESCE(t.source, r.source) AS channel, COALESCE(t.sessions, 0) AS sessions, COALESCE(t.unique_visitors, 0) AS unique_visitors,
  COALESCE(t.page_views, 0) AS page_views, COALESCE(t.avg_bounce_rate, 0) AS avg_bounce_rate, COALESCE(r.net_revenue, 0) AS net_revenue,
  COALESCE(r.gross_revenue, 0) AS gross_revenue, COALESCE(r.order_items, 0) AS valid_order_items
FROM traffic_src t FULL JOIN revenue_src r ON t.source = r.source"""
_CONVERSION = """
SELECT t.source AS channel, t.sessions, t.unique_visitors, t.avg_bounce_rate, t.avg_session_duration_sec, COALESCE(o.valid_orders, 0) AS valid_orders,
  COALESCE(o.valid_orders, 0) / CAST(t.sessions AS DOUBLE) * 100 AS conversion_rate
FROM traffic_src t LEFT JOIN orders_src o ON t.source = o.source"""
_SOURCES = """
SELECT COALESCE(t.source, r.source, o.source) AS source, COALESCE(t.sessions, 0) AS sessions, COALESCE(t.unique_visitors, 0) AS unique_visitors,
  COALESCE(t.weighted_bounce, 0) AS weighted_bounce, COALESCE(t.avg_session_duration_sec, 0) AS avg_session_duration_sec,
  COALESCE(t.weighted_bounce / t.sessions, 0) AS bounce_rate, COALESCE(r.net_revenue, 0) AS net_revenue,
  COALESCE(r.gross_revenue, 0) AS gross_revenue, COALESCE(r.order_items, 0) AS order_items, COALESCE(o.valid_orders, 0) AS valid_orders
FROM traffic_src t FULL JOIN revenue_src r ON t.source = r.source FULL JOIN orders_src o ON COALESCE(t.source, r.source) = o.source"""
_QUALITY = """
SELECT t.source AS traffic_source, t.sessions, t.unique_visitors, t.avg_bounce_rate, COALESCE(o.valid_orders, 0) AS orders, COALESCE(r.net_revenue, 0) AS revenue
FROM traffic_src t LEFT JOIN orders_src o ON t.source = o.source LEFT JOIN revenue_src r ON t.source = r.source"""
_SHARES = """, CAST(sessions AS DOUBLE) / CAST(SUM(sessions) OVER () AS DOUBLE) * 100 AS traffic_share_pct,
  CAST({r} AS DOUBLE) / CAST(SUM({r}) OVER () AS DOUBLE) * 100 AS revenue_share_pct,
  CAST({r} AS DOUBLE) / NULLIF(CAST(sessions AS DOUBLE), 0) AS revenue_per_session"""
CATEGORIES = ("Streetwear", "Outdoor", "LARGE", "MEDIUM", "PROMO", "SMALL")
AGES = ("18-24", "25-34", "35-44", "45+")
GENDERS = ("Female", "Male", "Other")

SQL: dict[str, str] = {
    # sources, filters, joins
    "scan_project": "SELECT order_id, order_date, order_status FROM v_orders",
    "valid_orders": "SELECT order_id, customer_id, order_date, order_status, order_source, payment_method, zip FROM valid",
    "master": "SELECT * FROM v_master",
    "master_dedup": "SELECT * FROM once",
    "join_contract": """
SELECT 'order_items' AS side, COUNT(*) AS keys, SUM(CASE WHEN n > 1 THEN 1 ELSE 0 END) AS repeated_keys, SUM(n) AS rows FROM (SELECT order_id, COUNT(*) AS n FROM v_order_items GROUP BY 1)
UNION ALL
SELECT 'orders' AS side, COUNT(*), SUM(CASE WHEN n > 1 THEN 1 ELSE 0 END), SUM(n) FROM (SELECT order_id, COUNT(*) AS n FROM v_orders GROUP BY 1)""",
    "monthly_traffic": """SELECT CAST(date_trunc('month', date) AS DATE) AS month, SUM(sessions) AS sessions, SUM(unique_visitors) AS unique_visitors,
  SUM(page_views) AS page_views, AVG(bounce_rate) AS avg_bounce_rate FROM v_web_traffic GROUP BY 1""",
    "monthly_sales": "SELECT CAST(date_trunc('month', date) AS DATE) AS month, SUM(revenue) AS revenue, SUM(cogs) AS cogs FROM v_sales GROUP BY 1",
    "orders_by_source": "SELECT source AS order_source, valid_orders FROM orders_src",
    # ten questions
    "q01_gap_days": """SELECT customer_id, order_id, order_date, gap_days FROM (SELECT customer_id, order_id, order_date,
  order_date - LAG(order_date) OVER (PARTITION BY customer_id ORDER BY order_date, order_id) AS gap_days FROM v_orders) x WHERE gap_days IS NOT NULL""",
    "q01_median_gap": """SELECT COUNT(gap) AS gaps, MEDIAN(gap) AS median_gap_days FROM (SELECT
  order_date - LAG(order_date) OVER (PARTITION BY customer_id ORDER BY order_date, order_id) AS gap FROM v_orders) x""",
    "q02_segment_margin": """SELECT segment, AVG(CAST(price - cogs AS DOUBLE) / CAST(price AS DOUBLE)) AS avg_gross_margin FROM v_products
GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1""",
    "q03_return_reason": """SELECT return_reason, COUNT(*) AS returns FROM v_returns r JOIN v_products p ON r.product_id = p.product_id
WHERE category = 'Streetwear' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1""",
    "q04_bounce": "SELECT traffic_source, AVG(bounce_rate) AS avg_bounce_rate FROM v_web_traffic GROUP BY 1 ORDER BY 2, 1 LIMIT 1",
    "q05_promo_rate": """SELECT COUNT(*) AS order_lines, SUM(CASE WHEN starts_with(COALESCE(promo_id, ''), 'PROMO-') THEN 1 ELSE 0 END) AS promo_lines,
  SUM(CASE WHEN starts_with(COALESCE(promo_id, ''), 'PROMO-') THEN 1 ELSE 0 END) / CAST(COUNT(*) AS DOUBLE) * 100 AS promo_rate_pct FROM v_order_items""",
    "q06_age_group": """SELECT age_group, SUM(n) AS total_orders, COUNT(*) AS total_customers, SUM(n) / CAST(COUNT(*) AS DOUBLE) AS avg_orders
FROM (SELECT c.customer_id, c.age_group, COUNT(o.order_id) AS n FROM v_customers c LEFT JOIN v_orders o ON c.customer_id = o.customer_id
  WHERE c.age_group IS NOT NULL GROUP BY 1, 2) x GROUP BY 1 ORDER BY avg_orders DESC, 1 LIMIT 1""",
    "q07_region_revenue": _REGION + " ORDER BY 2 DESC, 1 LIMIT 1",
    "q07_region_revenue_fmt": f"""SELECT region, CONCAT('$', format('{{:,}}', c // 100), '.', LPAD(CAST(c % 100 AS VARCHAR), 2, '0')) AS revenue
FROM (SELECT region, CAST(ROUND(revenue, 2) * 100 AS BIGINT) AS c FROM ({_REGION}) x) y""",
    "q08_cancel_payment": """SELECT payment_method, COUNT(*) AS cancellations FROM v_orders WHERE order_status = 'cancelled' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1""",
    "q09_size_return_rate": """SELECT COALESCE(s.size, r.size) AS size, s.n AS sold_lines, r.n AS returned_lines, r.n / CAST(s.n AS DOUBLE) * 100 AS return_rate_pct
FROM (SELECT size, COUNT(*) AS n FROM v_order_items i JOIN v_products p ON i.product_id = p.product_id WHERE size IN ('S', 'M', 'L', 'XL') GROUP BY 1) s
FULL JOIN (SELECT size, COUNT(*) AS n FROM v_returns i JOIN v_products p ON i.product_id = p.product_id WHERE size IN ('S', 'M', 'L', 'XL') GROUP BY 1) r ON s.size = r.size
ORDER BY 4 DESC NULLS LAST, 1 LIMIT 1""",
    "q10_installment": "SELECT installments, AVG(CAST(payment_value AS DOUBLE)) AS avg_payment FROM v_payments GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1",
    # traffic and channels
    "traffic_sales_monthly": """SELECT *, CAST(revenue AS DOUBLE) / sessions AS revenue_per_session, revenue - cogs AS profit FROM months""",
    "c01_index": _INDEX,
    "c01_long": f"""SELECT month, 'Revenue' AS metric, revenue_index AS index_value FROM ({_INDEX}) a UNION ALL
SELECT month, 'Sessions', sessions_index FROM ({_INDEX}) b UNION ALL SELECT month, 'Conversion Rate', conversion_index FROM ({_INDEX}) c""",
    "channel_summary": f"SELECT *, traffic_share_pct - revenue_share_pct AS share_gap_pct_point FROM (SELECT *{_SHARES.format(r='net_revenue')} FROM ({_CHANNEL}) x) y",
    "conversion_efficiency": f"""SELECT *, sessions / CAST(SUM(sessions) OVER () AS DOUBLE) * 100 AS traffic_share_pct, conversion_rate * 100 AS orders_per_10k_sessions,
  MEDIAN(conversion_rate) OVER () AS median_conversion_rate, conversion_rate >= MEDIAN(conversion_rate) OVER () AS at_or_above_median FROM ({_CONVERSION}) x""",
    "source_summary": f"""SELECT *, CAST(valid_orders AS DOUBLE) / NULLIF(CAST(sessions AS DOUBLE), 0) * 100 AS conversion_rate,
  CAST(valid_orders AS DOUBLE) / NULLIF(CAST(sessions AS DOUBLE), 0) * 10000 AS orders_per_10k_sessions,
  traffic_share_pct - revenue_share_pct AS traffic_minus_revenue_pp, source = 'social_media' AS is_social
FROM (SELECT *{_SHARES.format(r='net_revenue')} FROM ({_SOURCES}) x) y""",
    "c07_bounce": """SELECT source, sessions, weighted_bounce / sessions * 100 AS bounce_rate_pct,
  SUM(weighted_bounce) OVER () / SUM(sessions) OVER () * 100 AS overall_bounce_pct FROM traffic_src""",
    "c08_conversion": f"""SELECT *, MEDIAN(conversion_rate) OVER () AS median_conversion_rate FROM (SELECT source, sessions, valid_orders,
  CAST(valid_orders AS DOUBLE) / NULLIF(CAST(sessions AS DOUBLE), 0) * 100 AS conversion_rate FROM (
  SELECT COALESCE(t.source, o.source) AS source, COALESCE(t.sessions, 0) AS sessions, COALESCE(o.valid_orders, 0) AS valid_orders
  FROM traffic_src t FULL JOIN orders_src o ON t.source = o.source) x) y""",
    "source_quality": f"""SELECT *, CAST(orders AS DOUBLE) / sessions * 100 AS conversion_rate, traffic_share_pct - revenue_share_pct AS traffic_minus_revenue_pp
FROM (SELECT *{_SHARES.format(r='revenue')} FROM ({_QUALITY}) x) y""",
    "src_window_orders": "SELECT order_id, customer_id, order_date, order_status, order_source FROM win_orders",
    "src_window_lines": "SELECT order_item_id, order_id, customer_id, order_source, category, quantity, line_revenue FROM win_lines",
    "c25_conversion": """SELECT t.source AS traffic_source, t.sessions, COALESCE(o.orders, 0) AS orders, COALESCE(o.customers, 0) AS customers,
  COALESCE(o.orders, 0) / CAST(t.sessions AS DOUBLE) * 100 AS conversion_rate FROM traffic_src t LEFT JOIN (SELECT order_source,
  COUNT(DISTINCT order_id) AS orders, COUNT(DISTINCT customer_id) AS customers FROM win_orders GROUP BY 1) o ON t.source = o.order_source""",
    "source_value": "SELECT *, CAST(revenue AS DOUBLE) / orders AS aov FROM win_value",
    "c27_engagement": """SELECT source AS traffic_source, sessions, page_views AS total_page_views, weighted_bounce / sessions AS bounce_rate,
  weighted_duration / sessions AS avg_session_duration_sec, CAST(page_views AS DOUBLE) / sessions AS pages_per_session FROM traffic_src""",
    "c28_age_mix": _mix("age_group"),
    "c28_gender_mix": _mix("gender"),
    "c28_age_wide": wide(_mix("age_group"), "acquisition_channel", "age_group", "share_pct", {a: a for a in AGES}),
    "c28_gender_wide": wide(_mix("gender"), "acquisition_channel", "gender", "share_pct", {a: a for a in GENDERS}),
    "c29_repeat_rate": """SELECT order_source, COUNT(*) AS customers, SUM(CASE WHEN n > 1 THEN 1 ELSE 0 END) AS repeat_customers,
  SUM(CASE WHEN n > 1 THEN 1 ELSE 0 END) / CAST(COUNT(*) AS DOUBLE) * 100 AS repeat_rate_pct
FROM (SELECT order_source, customer_id, COUNT(DISTINCT order_id) AS n FROM win_level GROUP BY 1, 2) x GROUP BY 1""",
    "c30_share": f"SELECT *, traffic_share_pct - revenue_share_pct AS traffic_minus_revenue_pp FROM ({_SHARE}) x",
    "c30_share_long": f"""SELECT traffic_source, 'Traffic Share' AS share_type, traffic_share_pct AS share_pct FROM ({_SHARE}) a UNION ALL
SELECT traffic_source, 'Revenue Share', revenue_share_pct FROM ({_SHARE}) b""",
    "c31_product_pref": _PREF,
    "c31_wide": wide(_PREF, "order_source", "category", "category_share_pct", {c: c for c in CATEGORIES}),
    # promotions
    "promo_share_monthly": wide("""SELECT month, CASE WHEN is_promo THEN 'Promo' ELSE 'Non-promo' END AS g,
  CAST(SUM(revenue) AS DOUBLE) / CAST(SUM(SUM(revenue)) OVER (PARTITION BY month) AS DOUBLE) * 100 AS p FROM dated_items GROUP BY 1, 2""",
                                "month", "g", "p", {"Promo": "Promo", "Non-promo": "Non-promo"}),
    "c09_margin": f"SELECT promo_group, {_LINE_SUMS}, COUNT(DISTINCT order_id) AS orders, {_MARGIN} AS margin FROM valid_once GROUP BY 1",
    "overall_margin": f"SELECT SUM(line_revenue) AS revenue, SUM(line_cogs) AS cogs, SUM(COALESCE(discount_amount, 0)) AS discount, {_MARGIN} AS overall_margin FROM valid_once",
    "c10_aov": """SELECT promo_group, COUNT(*) AS orders, SUM(v) AS revenue, AVG(CAST(v AS DOUBLE)) AS aov, MEDIAN(CAST(v AS DOUBLE)) AS median_order_value,
  CAST(SUM(SUM(v)) OVER () AS DOUBLE) / CAST(SUM(COUNT(*)) OVER () AS DOUBLE) AS overall_aov
FROM (SELECT order_id, promo_group, SUM(line_revenue) AS v FROM valid_once GROUP BY 1, 2) x GROUP BY 1""",
    "c11_margin_monthly": f"SELECT month, promo_group, {_LINE_SUMS}, {_MARGIN} AS margin_pct FROM valid_once GROUP BY 1, 2",
    "c12_promo_share": """SELECT *, total_revenue - promo_revenue AS non_promo_revenue, CAST(promo_revenue AS DOUBLE) / CAST(total_revenue AS DOUBLE) * 100 AS promo_revenue_share_pct,
  100 - CAST(promo_revenue AS DOUBLE) / CAST(total_revenue AS DOUBLE) * 100 AS non_promo_revenue_share_pct,
  CAST(SUM(promo_revenue) OVER () AS DOUBLE) / CAST(SUM(total_revenue) OVER () AS DOUBLE) * 100 AS overall_promo_share_pct FROM promo_months""",
    "c13_promo_share_year": """SELECT YEAR(month) AS year, SUM(total_revenue) AS total_revenue, SUM(promo_revenue) AS promo_revenue, SUM(total_revenue - promo_revenue) AS non_promo_revenue,
  CAST(SUM(promo_revenue) AS DOUBLE) / CAST(SUM(total_revenue) AS DOUBLE) * 100 AS promo_revenue_share_pct FROM promo_months GROUP BY 1""",
    "order_promo": "SELECT * FROM order_promos",
    "c14_aov": """SELECT promo_group, SUM(revenue) AS revenue, COUNT(DISTINCT order_id) AS orders, CAST(SUM(revenue) AS DOUBLE) / COUNT(*) AS aov,
  CAST(SUM(SUM(revenue)) OVER () AS DOUBLE) / CAST(SUM(COUNT(*)) OVER () AS DOUBLE) AS overall_aov FROM order_promos GROUP BY 1""",
    "c15_orders_monthly": "SELECT month, promo_group, COUNT(DISTINCT order_id) AS orders FROM order_promos GROUP BY 1, 2",
    "c16_qty_per_order": """SELECT promo_group, COUNT(DISTINCT order_id) AS orders, SUM(quantity) AS total_quantity,
  CAST(SUM(quantity) AS DOUBLE) / COUNT(*) AS quantity_per_order FROM order_promos GROUP BY 1""",
    "c17_asp": "SELECT promo_group, SUM(revenue) AS revenue, SUM(quantity) AS total_quantity, CAST(SUM(revenue) AS DOUBLE) / CAST(SUM(quantity) AS DOUBLE) AS asp FROM order_promos GROUP BY 1",
    "c18_aov_discount": _DISCOUNT,
    "c18_aov_long": f"""SELECT promo_group, 'Before discount' AS aov_type, aov_before_discount AS aov FROM ({_DISCOUNT}) a UNION ALL
SELECT promo_group, 'After discount', aov_after_discount FROM ({_DISCOUNT}) b""",
    "c37_promo_units": _UNITS,
    "c37_promo_units_wide": wide(_UNITS, "category", "promo_group", "units_share_pct", {"Promo": "Promo", "Non-promo": "Non-promo"}),
    # inventory
    "c19_stock_sales": "SELECT month, SUM(stock_on_hand) AS total_stock_on_hand, SUM(units_sold) AS total_units_sold FROM inv GROUP BY 1",
    "c19_stock_sales_tail": "SELECT month, SUM(stock_on_hand) AS total_stock_on_hand, SUM(units_sold) AS total_units_sold FROM inv GROUP BY 1 ORDER BY 1 DESC LIMIT 12",
    "c20_category_stock": "SELECT category, AVG(stock_on_hand) AS avg_stock_on_hand, SUM(stock_on_hand) AS total_stock_on_hand, COUNT(DISTINCT product_id) AS products FROM inv GROUP BY 1",
    "c21_sell_through_bands": """
SELECT segment, n AS records, n / CAST(total AS DOUBLE) * 100 AS record_share_pct FROM (
  SELECT 'Dead stock risk (<0.3)' AS segment, SUM(CASE WHEN sell_through_rate < 0.3 THEN 1 ELSE 0 END) AS n, COUNT(*) AS total FROM inv UNION ALL
  SELECT 'Healthy (0.6-0.8)', SUM(CASE WHEN sell_through_rate BETWEEN 0.6 AND 0.8 THEN 1 ELSE 0 END), COUNT(*) FROM inv UNION ALL
  SELECT 'Stockout risk (>=0.9)', SUM(CASE WHEN sell_through_rate >= 0.9 THEN 1 ELSE 0 END), COUNT(*) FROM inv) x""",
    "c21_hist": _bins("inv", "sell_through_rate"),
    "c21_kde": """
SELECT point, gx AS x, SUM(EXP(-0.5 * POWER((gx - v) / w, 2))) / (n * w * SQRT(2 * PI())) AS density FROM (
  SELECT g.point, lo + (hi - lo) * g.point / 199 AS gx, n, s * POWER(CAST(n AS DOUBLE), -0.2) AS w FROM (SELECT COUNT(*) AS n, STDDEV_SAMP(sell_through_rate) AS s,
    MIN(sell_through_rate) AS lo, MAX(sell_through_rate) AS hi FROM inv) a, (SELECT UNNEST(range(200)) AS point) g) p,
  (SELECT sell_through_rate AS v FROM inv) d GROUP BY point, gx, n, w""",
    "c22_category_sales": "SELECT category, SUM(units_sold) AS total_units_sold, AVG(units_sold) AS avg_units_sold, COUNT(DISTINCT product_id) AS products FROM inv GROUP BY 1",
    "c23_category_str": """SELECT category, AVG(sell_through_rate) AS avg_sell_through, MEDIAN(sell_through_rate) AS median_sell_through, COUNT(*) AS records,
  SUM(units_sold) AS total_units_sold, SUM(stock_on_hand) AS total_stock_on_hand FROM inv GROUP BY 1""",
    "c24_stockout_risk": """SELECT category, COUNT(*) AS records, SUM(CASE WHEN stockout_days > 0 THEN 1 ELSE 0 END) AS stockout_records, SUM(stockout_days) AS total_stockout_days,
  SUM(units_sold) AS total_units_sold, AVG(units_sold) AS avg_units_sold, SUM(CASE WHEN stockout_days > 0 THEN 1 ELSE 0 END) / CAST(COUNT(*) AS DOUBLE) * 100 AS stockout_record_pct FROM inv GROUP BY 1""",
    "category_diag": "SELECT * FROM category_diag_base",
    "c32_box": """
SELECT b.category, q[1] AS q1, q[2] AS median, q[3] AS q3, MIN(CASE WHEN v >= q[1] - (q[3] - q[1]) * 1.5 AND v <= q[3] + (q[3] - q[1]) * 1.5 THEN v END) AS whisker_low,
  MAX(CASE WHEN v >= q[1] - (q[3] - q[1]) * 1.5 AND v <= q[3] + (q[3] - q[1]) * 1.5 THEN v END) AS whisker_high, COUNT(*) AS records, b.position
FROM (SELECT category, QUANTILE_CONT(sell_through_rate, [0.25, 0.5, 0.75]) AS q, ROW_NUMBER() OVER (ORDER BY ROUND(AVG(sell_through_rate), 10), category) AS position FROM inv GROUP BY 1) b
JOIN (SELECT category, sell_through_rate AS v FROM inv) x ON b.category = x.category GROUP BY b.category, q, b.position""",
    "c33_stock_units_long": """SELECT category, 'Avg Stock on Hand' AS metric, avg_stock_on_hand AS value FROM category_diag_base UNION ALL
SELECT category, 'Avg Units Sold', avg_units_sold FROM category_diag_base""",
    "c34_flag_mix": "SELECT category, overstock_rate_pct AS \"Overstock flag\", stockout_rate_pct AS \"Stockout flag\" FROM category_diag_base",
    "c35_dos_monthly": "SELECT month, AVG(days_of_supply) AS avg_days_of_supply FROM inv GROUP BY 1",
    "c35_dos_hist": _bins("inv", "days_of_supply"),
    "c36_fill_str": """
SELECT month, category, SUM(stock_on_hand) AS stock_on_hand, SUM(units_sold) AS units_sold, AVG(sell_through_rate) AS avg_sell_through_rate,
  AVG(days_of_supply) AS avg_days_of_supply, AVG(fill_rate) AS avg_fill_rate, AVG(overstock_flag) AS overstock_rate, AVG(stockout_flag) AS stockout_rate,
  AVG(overstock_flag) * 100 AS overstock_rate_pct, AVG(stockout_flag) * 100 AS stockout_rate_pct FROM inv GROUP BY 1, 2
ORDER BY ROUND(AVG(fill_rate), 10) DESC, ROUND(AVG(sell_through_rate), 10), month, category LIMIT 20""",
    "c38_dead_stock": """
SELECT product_id, product_name, category, AVG(stock_on_hand) AS avg_stock_on_hand, SUM(stock_on_hand) AS total_stock_on_hand, AVG(sell_through_rate) AS avg_sell_through_rate,
  AVG(days_of_supply) AS avg_days_of_supply, AVG(units_sold) AS avg_units_sold, ROUND(SUM(stock_on_hand) * (1 - LEAST(AVG(sell_through_rate), 1)), 8) AS dead_stock_score
FROM inv GROUP BY 1, 2, 3 ORDER BY dead_stock_score DESC, ROUND(AVG(sell_through_rate), 10), product_id LIMIT 15""",
    "c39_top_sku": """SELECT *, ROUND((sell_through_rank_pct + revenue_rank_pct) / 2, 10) AS combined_score FROM sku_perf
ORDER BY combined_score DESC, net_revenue DESC, product_id LIMIT 15""",
    "c40_aging": "SELECT * FROM aging_cells",
    "c40_bucket": """SELECT aging_bucket, bucket_order, SUM(inventory_value) AS total_inventory_value, SUM(sku_month_records) AS sku_month_records, SUM(overstock_records) AS overstock_records,
  CAST(SUM(inventory_value) AS DOUBLE) / CAST(SUM(SUM(inventory_value)) OVER () AS DOUBLE) * 100 AS value_share_pct FROM aging_cells GROUP BY 1, 2""",
}

SQL["order_quantity"] = f"SELECT order_id, revenue, quantity FROM ({SQL['order_promo']}) q"
# Stored copies give the rows of the tables they were made of.
SQL |= {f"stored_{name}": SQL[name]
        for name in ("order_promo", "c10_aov", "c29_repeat_rate", "src_window_orders", "source_value", "c25_conversion")}
