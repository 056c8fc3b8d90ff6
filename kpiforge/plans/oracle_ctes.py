"""DuckDB SQL twins of the models, used as the correctness oracle.

Each entry is (dependencies, SELECT body). ``with_ctes(final_sql, *names)`` emits a WITH
clause holding the named CTEs and their dependencies in dependency order. The SQL is written
independently of the DataFrame code (same semantics, different engine).
"""

from __future__ import annotations

from datetime import timedelta

from kpiforge import config
from kpiforge.sources.registry import registry_values_sql

SIM = config.SIM_DATE.isoformat()
SIM_NEXT = (config.SIM_DATE + timedelta(days=1)).isoformat()
WEB_SIM_NEXT = (config.WEB_SIM_DATE + timedelta(days=1)).isoformat()
WEB_SIM = config.WEB_SIM_DATE.isoformat()


def _sql_list(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


_STATUS_CASE = "CASE o_orderstatus " + " ".join(
    f"WHEN '{k}' THEN '{v}'" for k, v in config.ORDER_STATUS_MAP.items()
) + " ELSE 'created' END"

CTES: dict[str, tuple[list[str], str]] = {}


def cte(name: str, deps: list[str], body: str) -> None:
    CTES[name] = (deps, body)


cte("ship_stats", [], """
    SELECT l.l_orderkey AS order_id, min(l.l_shipdate) AS first_ship, max(l.l_shipdate) AS last_ship
    FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
    WHERE l.l_shipdate >= o.o_orderdate
    GROUP BY l.l_orderkey""")

cte("erp_orders", ["ship_stats"], f"""
    SELECT o.o_orderkey AS order_id, o.o_custkey AS customer_id,
           {_STATUS_CASE} AS order_status,
           o.o_orderdate AS order_purchase_timestamp,
           o.o_orderdate AS order_approved_at,
           CASE WHEN {_STATUS_CASE} IN ('delivered', 'shipped') THEN s.first_ship END AS order_delivered_carrier_date,
           CASE WHEN {_STATUS_CASE} = 'delivered' THEN s.last_ship END AS order_delivered_customer_date,
           o.o_orderdate + INTERVAL {config.PROMISE_DAYS} DAY AS order_estimated_delivery_date
    FROM orders o LEFT JOIN ship_stats s ON s.order_id = o.o_orderkey
    WHERE o.o_orderdate < TIMESTAMP '{SIM_NEXT}'""")

cte("stg_orders", ["erp_orders"], f"""
    SELECT order_id, customer_id,
           CASE WHEN order_status = 'delivered' AND dc IS NULL
                THEN CASE WHEN dcar IS NOT NULL THEN 'shipped' ELSE 'processing' END
                ELSE order_status END AS order_status,
           order_purchase_timestamp AS purchased_at,
           CAST(order_purchase_timestamp AS DATE) AS purchase_date,
           appr AS approved_at, dcar AS delivered_carrier_at, dc AS delivered_customer_at,
           order_estimated_delivery_date AS estimated_delivery_at
    FROM (
      SELECT *,
        CASE WHEN order_approved_at < TIMESTAMP '{SIM_NEXT}' THEN order_approved_at END AS appr,
        CASE WHEN order_delivered_carrier_date < TIMESTAMP '{SIM_NEXT}' THEN order_delivered_carrier_date END AS dcar,
        CASE WHEN order_delivered_customer_date < TIMESTAMP '{SIM_NEXT}' THEN order_delivered_customer_date END AS dc
      FROM erp_orders) m""")

cte("erp_order_items", [], f"""
    SELECT l.l_orderkey AS order_id, l.l_linenumber AS order_item_id, l.l_partkey AS product_id,
           l.l_suppkey AS seller_id, l.l_shipdate AS shipping_limit_date, l.l_extendedprice AS price,
           l.l_tax AS tax_rate, l.l_quantity AS quantity, l.l_discount AS discount,
           l.l_returnflag AS return_flag, l.l_linestatus AS line_status, o.o_orderdate AS _wm
    FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
    WHERE o.o_orderdate < TIMESTAMP '{SIM_NEXT}'""")

cte("stg_order_items", ["erp_order_items"], """
    SELECT order_id, CAST(order_item_id AS INTEGER) AS order_item_id, product_id, seller_id,
           shipping_limit_date AS shipping_limit_at,
           CAST(price AS DECIMAL(12,2)) AS price,
           CAST(round(CAST(price AS DECIMAL(12,2)) * CAST(tax_rate AS DECIMAL(4,2)), 2) AS DECIMAL(12,2)) AS freight_value
    FROM (
      SELECT *, row_number() OVER (PARTITION BY order_id, order_item_id
          ORDER BY shipping_limit_date DESC, product_id DESC, seller_id DESC, price DESC, quantity DESC,
                   discount DESC, tax_rate DESC, return_flag DESC, line_status DESC) AS rn
      FROM erp_order_items) r
    WHERE rn = 1""")

cte("stg_payments", [], f"""
    SELECT o_orderkey AS order_id, 1 AS payment_sequential,
           [{_sql_list(config.PAYMENT_TYPES)}][CAST(substr(o_orderpriority, 1, 1) AS INTEGER)] AS payment_type,
           CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS payment_installments,
           CAST(o_totalprice AS DECIMAL(12,2)) AS payment_value
    FROM orders WHERE o_orderdate < TIMESTAMP '{SIM_NEXT}'""")

cte("stg_customers", [], """
    SELECT c.c_custkey AS customer_id, c.c_custkey AS customer_unique_id,
           lpad(CAST(c.c_custkey % 100000 AS VARCHAR), 5, '0') AS zip_code_prefix,
           lower(c.c_mktsegment) AS city, upper(trim(n.n_name)) AS state_code
    FROM customer c LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey""")

cte("stg_sellers", [], """
    SELECT s.s_suppkey AS seller_id, lpad(CAST(s.s_suppkey % 100000 AS VARCHAR), 5, '0') AS zip_code_prefix,
           lower(s.s_name) AS city, upper(trim(n.n_name)) AS state_code
    FROM supplier s LEFT JOIN nation n ON n.n_nationkey = s.s_nationkey""")

cte("stg_category_translation", [], "SELECT DISTINCT * FROM (VALUES " + ", ".join(
    f"('{a}', '{b}')" for a, b in config.CATEGORY_TRANSLATION) + ") t(category_name_pt, category_name_en)")

cte("product_category", ["stg_category_translation"], """
    SELECT p.p_partkey AS product_id, lower(p.p_type) AS category_name_pt,
           coalesce(t.category_name_en, lower(p.p_type), 'unknown') AS category_name_en,
           CAST(p.p_size AS INTEGER) AS photos_qty, CAST(p.p_retailprice AS DECIMAL(12,2)) AS weight_g
    FROM part p LEFT JOIN stg_category_translation t ON t.category_name_pt = lower(p.p_type)""")

cte("stg_reviews", ["erp_orders"], f"""
    SELECT review_id, order_id, CAST(review_score AS INTEGER) AS review_score,
           CAST(review_creation_date AS TIMESTAMP) AS created_at, CAST(review_creation_date AS DATE) AS review_date
    FROM (
      SELECT order_id AS review_id, order_id, CAST(1 + order_id % 5 AS VARCHAR) AS review_score,
             strftime(CAST(order_delivered_customer_date AS DATE) + {config.REVIEW_DELAY_DAYS}, '%Y-%m-%d %H:%M:%S') AS review_creation_date
      FROM erp_orders WHERE order_delivered_customer_date IS NOT NULL) r
    WHERE review_creation_date < '{SIM_NEXT}'""")

cte("stg_geolocation", [], """
    SELECT lpad(CAST(c.c_custkey % 100000 AS VARCHAR), 5, '0') AS zip_code_prefix,
           CAST(CAST(c.c_acctbal AS DECIMAL(12,2)) / 250 AS DECIMAL(12,6)) AS lat,
           CAST(-74 + c.c_custkey % 50 AS DECIMAL(12,6)) AS lng,
           lower(c.c_mktsegment) AS city, upper(trim(lower(n.n_name))) AS state_code
    FROM customer c LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey""")

_CHANNELS = f"[{_sql_list(config.MARKETING_CHANNELS)}]"

cte("stg_marketing", [], f"""
    SELECT CAST(ts AS DATE) AS marketing_date, {_CHANNELS}[CAST(user_id % {len(config.MARKETING_CHANNELS)} + 1 AS INTEGER)] AS channel,
           CAST(count(*) FILTER (WHERE event_type IN ('view', 'click')) AS INTEGER) AS sessions,
           CAST(sum(CASE WHEN event_type = 'click' THEN CAST(value AS DECIMAL(12,2)) ELSE CAST(0 AS DECIMAL(12,2)) END) AS DECIMAL(12,2)) AS ad_spend
    FROM events GROUP BY 1, 2""")

cte("fct_marketing_daily", ["stg_marketing"], f"""
    SELECT marketing_date, channel, sessions, ad_spend FROM stg_marketing WHERE marketing_date <= DATE '{WEB_SIM}'""")

cte("web_orders_daily", [], f"""
    SELECT CAST(ts AS DATE) AS kpi_date, count(*) AS web_orders, sum(CAST(value AS DECIMAL(12,2))) AS web_revenue
    FROM events WHERE event_type = 'purchase' AND ts < TIMESTAMP '{WEB_SIM_NEXT}' GROUP BY 1""")

cte("order_item_totals", ["stg_order_items"], """
    SELECT order_id, count(*) AS items_count, sum(price) AS items_value, sum(freight_value) AS freight_value
    FROM stg_order_items GROUP BY order_id""")

cte("payment_totals", ["stg_payments"], """
    SELECT order_id, sum(payment_value) AS payment_value FROM stg_payments GROUP BY order_id""")

cte("int_orders", ["stg_orders", "stg_customers", "order_item_totals", "payment_totals"], """
    SELECT o.order_id, o.customer_id, c.customer_unique_id, c.state_code AS customer_state, o.order_status,
           o.order_status IN ('canceled', 'unavailable') AS is_canceled,
           o.purchased_at, o.purchase_date, o.approved_at, o.delivered_carrier_at, o.delivered_customer_at,
           CAST(o.delivered_customer_at AS DATE) AS delivery_date, o.estimated_delivery_at,
           CAST(round(CAST(date_diff('second', o.purchased_at, o.delivered_customer_at) AS DECIMAL(20,0)) / 86400, 3) AS DECIMAL(12,3)) AS delivery_days,
           CASE WHEN o.delivered_customer_at IS NOT NULL
                THEN CAST(o.delivered_customer_at AS DATE) <= CAST(o.estimated_delivery_at AS DATE) END AS is_on_time,
           row_number() OVER (PARTITION BY c.customer_unique_id ORDER BY o.purchased_at, o.order_id) = 1 AS is_first_order,
           CAST(coalesce(i.items_count, 0) AS BIGINT) AS items_count,
           CAST(coalesce(i.items_value, 0) AS DECIMAL(22,2)) AS items_value,
           CAST(coalesce(i.freight_value, 0) AS DECIMAL(22,2)) AS freight_value,
           CAST(coalesce(p.payment_value, 0) AS DECIMAL(22,2)) AS payment_value
    FROM stg_orders o
    JOIN stg_customers c USING (customer_id)
    LEFT JOIN order_item_totals i USING (order_id)
    LEFT JOIN payment_totals p USING (order_id)""")

cte("fct_orders", ["int_orders"], """
    SELECT order_id, customer_unique_id, customer_state AS state_code, order_status, is_canceled, is_first_order,
           purchased_at, purchase_date, approved_at, delivered_carrier_at, delivered_customer_at, delivery_date,
           estimated_delivery_at, delivery_days, is_on_time, items_count, items_value, freight_value, payment_value
    FROM int_orders""")

cte("fct_order_items", ["stg_order_items", "fct_orders", "product_category"], """
    SELECT i.order_id, i.order_item_id, i.product_id, i.seller_id, p.category_name_en, o.customer_unique_id,
           o.state_code, o.purchase_date, o.is_canceled, i.price, i.freight_value
    FROM stg_order_items i JOIN fct_orders o USING (order_id) JOIN product_category p USING (product_id)""")

cte("fct_payments", ["stg_payments", "fct_orders"], """
    SELECT p.order_id, p.payment_sequential, p.payment_type, p.payment_installments, p.payment_value, o.purchase_date
    FROM stg_payments p JOIN fct_orders o USING (order_id)""")

cte("fct_reviews", ["stg_reviews", "fct_orders"], """
    SELECT r.review_id, r.order_id, o.state_code, r.review_score, r.review_date, r.created_at
    FROM stg_reviews r JOIN fct_orders o USING (order_id)""")

cte("dim_date", [], f"""
    SELECT CAST(d AS DATE) AS date_day, CAST(isodow(d) AS INTEGER) AS iso_weekday, strftime(d, '%a') AS weekday_name,
           isodow(d) IN (6, 7) AS is_weekend, CAST(date_trunc('week', d) AS DATE) AS week_start,
           CAST(date_trunc('month', d) AS DATE) AS month_start, CAST(year(d) AS INTEGER) AS year,
           CAST(quarter(d) AS INTEGER) AS quarter, CAST(month(d) AS INTEGER) AS month
    FROM (SELECT unnest(generate_series(DATE '{config.CALENDAR_START}', DATE '{config.CALENDAR_END}', INTERVAL 1 DAY)) AS d) g""")

cte("region_seed", [], """
    SELECT upper(trim(n.n_name)) AS state_code,
           upper(substr(lower(n.n_name), 1, 1)) || substr(lower(n.n_name), 2) AS state_name,
           r.r_name AS macro_region
    FROM nation n LEFT JOIN region r ON r.r_regionkey = n.n_regionkey""")

cte("category_month_actuals", ["fct_order_items"], """
    SELECT CAST(date_trunc('month', purchase_date) AS DATE) AS month_start, category_name_en, sum(price) AS actual_gmv
    FROM fct_order_items WHERE NOT is_canceled GROUP BY 1, 2""")

cte("stg_budgets", ["category_month_actuals"], """
    SELECT CAST(month_start + INTERVAL 1 MONTH AS DATE) AS budget_month, category_name_en,
           CAST(greatest(round(actual_gmv / 100, 0), 1) * 100 AS DECIMAL(14,2)) AS budget_brl
    FROM category_month_actuals""")

cte("budget_vs_actual", ["stg_budgets", "category_month_actuals"], f"""
    SELECT b.budget_month AS month_start, b.category_name_en, 'category:' || b.category_name_en AS entity_id,
           b.budget_brl, coalesce(a.actual_gmv, 0) AS actual_gmv,
           coalesce(a.actual_gmv, 0) - b.budget_brl AS deviation_abs,
           round(CAST(coalesce(a.actual_gmv, 0) - b.budget_brl AS DOUBLE) / nullif(CAST(b.budget_brl AS DOUBLE), 0), 6) AS deviation_rate,
           last_day(b.budget_month) <= DATE '{SIM}' AS is_complete
    FROM stg_budgets b
    LEFT JOIN category_month_actuals a ON a.month_start = b.budget_month AND a.category_name_en = b.category_name_en
    WHERE b.budget_month <= DATE '{SIM}'""")

cte("dim_region", ["region_seed", "stg_geolocation"], """
    SELECT s.state_code, 'region:' || s.state_code AS entity_id, s.state_name, s.macro_region, c.centroid_lat, c.centroid_lng
    FROM region_seed s LEFT JOIN (
      SELECT state_code, round(CAST(sum(lat) AS DOUBLE) / count(lat), 4) AS centroid_lat,
             round(CAST(sum(lng) AS DOUBLE) / count(lng), 4) AS centroid_lng
      FROM stg_geolocation WHERE lat BETWEEN -34 AND 6 AND lng BETWEEN -74 AND -34
      GROUP BY state_code) c USING (state_code)""")

cte("dim_customer", ["int_orders"], """
    SELECT customer_unique_id, 'customer:' || customer_unique_id AS entity_id,
           arg_max(customer_state, (purchased_at, order_id)) AS state_code,
           min(purchased_at) AS first_order_at, max(purchased_at) AS last_order_at, count(*) AS orders_count
    FROM int_orders GROUP BY customer_unique_id""")

cte("dim_product", ["product_category"], """
    SELECT product_id, 'product:' || product_id AS entity_id, category_name_pt, category_name_en,
           'category:' || category_name_en AS category_entity_id, photos_qty, weight_g
    FROM product_category""")

cte("dim_seller", ["stg_sellers"], "SELECT seller_id, 'seller:' || seller_id AS entity_id, city, state_code FROM stg_sellers")

# --- KPI mart -----------------------------------------------------------------------------
cte("spine", ["fct_orders"], f"""
    SELECT CAST(d AS DATE) AS kpi_date
    FROM (SELECT unnest(generate_series((SELECT min(purchase_date) FROM fct_orders), DATE '{SIM}', INTERVAL 1 DAY)) AS d) g""")

cte("orders_agg", ["fct_orders"], """
    SELECT purchase_date AS kpi_date,
           CASE WHEN grouping(state_code) = 0 THEN 'region' ELSE 'total' END AS dimension,
           CASE WHEN grouping(state_code) = 0 THEN state_code ELSE 'all' END AS dimension_value,
           count(*) AS orders_all,
           count(*) FILTER (WHERE NOT is_canceled) AS orders_valid,
           count(*) FILTER (WHERE is_canceled) AS orders_canceled,
           count(*) FILTER (WHERE is_first_order) AS new_customers,
           count(*) FILTER (WHERE NOT is_first_order) AS returning_customers
    FROM fct_orders GROUP BY GROUPING SETS ((purchase_date), (purchase_date, state_code))""")

cte("orders_frame", ["spine", "orders_agg"], """
    SELECT s.kpi_date, 'total' AS dimension, 'all' AS dimension_value,
           coalesce(a.orders_all, 0) AS orders_all, coalesce(a.orders_valid, 0) AS orders_valid,
           coalesce(a.orders_canceled, 0) AS orders_canceled, coalesce(a.new_customers, 0) AS new_customers,
           coalesce(a.returning_customers, 0) AS returning_customers
    FROM spine s LEFT JOIN orders_agg a ON a.kpi_date = s.kpi_date AND a.dimension = 'total'
    UNION ALL
    SELECT * FROM orders_agg WHERE dimension <> 'total'""")

cte("items_agg", ["fct_order_items"], """
    SELECT purchase_date AS kpi_date,
           CASE WHEN grouping(state_code) = 0 THEN 'region' WHEN grouping(category_name_en) = 0 THEN 'category' ELSE 'total' END AS dimension,
           CASE WHEN grouping(state_code) = 0 THEN state_code WHEN grouping(category_name_en) = 0 THEN category_name_en ELSE 'all' END AS dimension_value,
           sum(price) AS gmv, sum(freight_value) AS freight, count(*) AS items, count(DISTINCT order_id) AS orders_with_items
    FROM fct_order_items WHERE NOT is_canceled
    GROUP BY GROUPING SETS ((purchase_date), (purchase_date, state_code), (purchase_date, category_name_en))""")

cte("items_frame", ["spine", "items_agg"], """
    SELECT s.kpi_date, 'total' AS dimension, 'all' AS dimension_value,
           coalesce(a.gmv, 0) AS gmv, coalesce(a.freight, 0) AS freight, coalesce(a.items, 0) AS items,
           coalesce(a.orders_with_items, 0) AS orders_with_items
    FROM spine s LEFT JOIN items_agg a ON a.kpi_date = s.kpi_date AND a.dimension = 'total'
    UNION ALL
    SELECT * FROM items_agg WHERE dimension <> 'total'""")

cte("delivery_agg", ["fct_orders"], """
    SELECT delivery_date AS kpi_date,
           CASE WHEN grouping(state_code) = 0 THEN 'region' ELSE 'total' END AS dimension,
           CASE WHEN grouping(state_code) = 0 THEN state_code ELSE 'all' END AS dimension_value,
           sum(delivery_days) AS delivery_days_sum, count(*) AS delivered,
           count(*) FILTER (WHERE is_on_time) AS delivered_on_time
    FROM fct_orders WHERE delivery_date IS NOT NULL
    GROUP BY GROUPING SETS ((delivery_date), (delivery_date, state_code))""")

cte("review_agg", ["fct_reviews"], """
    SELECT review_date AS kpi_date,
           CASE WHEN grouping(state_code) = 0 THEN 'region' ELSE 'total' END AS dimension,
           CASE WHEN grouping(state_code) = 0 THEN state_code ELSE 'all' END AS dimension_value,
           sum(review_score) AS score_sum, count(*) AS reviews
    FROM fct_reviews GROUP BY GROUPING SETS ((review_date), (review_date, state_code))""")

cte("marketing_frame", ["fct_marketing_daily", "web_orders_daily"], """
    SELECT m.kpi_date, 'total' AS dimension, 'all' AS dimension_value, m.sessions, m.ad_spend,
           coalesce(w.web_orders, 0) AS web_orders, coalesce(w.web_revenue, 0) AS web_revenue
    FROM (SELECT marketing_date AS kpi_date, sum(sessions) AS sessions, sum(ad_spend) AS ad_spend
          FROM fct_marketing_daily GROUP BY 1) m
    LEFT JOIN web_orders_daily w USING (kpi_date)""")

_D = "DECIMAL(38,6)"
cte("kpi_inputs", ["orders_frame", "items_frame", "delivery_agg", "review_agg", "marketing_frame"], f"""
    SELECT kpi_date, dimension, dimension_value, 'orders_count' AS kpi_key, 'sum' AS aggregation, CAST(orders_valid AS {_D}) AS numerator, CAST(NULL AS {_D}) AS denominator FROM orders_frame
    UNION ALL SELECT kpi_date, dimension, dimension_value, 'cancellation_rate', 'ratio', CAST(orders_canceled AS {_D}), CAST(orders_all AS {_D}) FROM orders_frame
    UNION ALL SELECT kpi_date, dimension, dimension_value, 'new_customers', 'sum', CAST(new_customers AS {_D}), NULL FROM orders_frame
    UNION ALL SELECT kpi_date, dimension, dimension_value, 'returning_customers', 'sum', CAST(returning_customers AS {_D}), NULL FROM orders_frame
    UNION ALL SELECT kpi_date, dimension, dimension_value, 'gmv', 'sum', CAST(gmv AS {_D}), NULL FROM items_frame
    UNION ALL SELECT kpi_date, dimension, dimension_value, 'avg_order_value', 'ratio', CAST(gmv AS {_D}), CAST(orders_with_items AS {_D}) FROM items_frame WHERE dimension <> 'category'
    UNION ALL SELECT kpi_date, dimension, dimension_value, 'freight_ratio', 'ratio', CAST(freight AS {_D}), CAST(gmv AS {_D}) FROM items_frame
    UNION ALL SELECT kpi_date, dimension, dimension_value, 'items_per_order', 'ratio', CAST(items AS {_D}), CAST(orders_with_items AS {_D}) FROM items_frame WHERE dimension <> 'category'
    UNION ALL SELECT kpi_date, dimension, dimension_value, 'delivery_time_avg_days', 'ratio', CAST(delivery_days_sum AS {_D}), CAST(delivered AS {_D}) FROM delivery_agg
    UNION ALL SELECT kpi_date, dimension, dimension_value, 'on_time_rate', 'ratio', CAST(delivered_on_time AS {_D}), CAST(delivered AS {_D}) FROM delivery_agg
    UNION ALL SELECT kpi_date, dimension, dimension_value, 'review_score_avg', 'ratio', CAST(score_sum AS {_D}), CAST(reviews AS {_D}) FROM review_agg
    UNION ALL SELECT kpi_date, dimension, dimension_value, 'conversion_rate', 'ratio', CAST(web_orders AS {_D}), CAST(sessions AS {_D}) FROM marketing_frame
    UNION ALL SELECT kpi_date, dimension, dimension_value, 'roas', 'ratio', CAST(web_revenue AS {_D}), CAST(ad_spend AS {_D}) FROM marketing_frame""")

_RATIO = "round(CAST({n} AS DOUBLE) / nullif(CAST({d} AS DOUBLE), 0), 6)"

cte("kpi_daily", ["kpi_inputs"], f"""
    SELECT kpi_date, kpi_key, dimension, dimension_value,
           CASE dimension WHEN 'region' THEN 'region:' || dimension_value
                          WHEN 'category' THEN 'category:' || dimension_value
                          ELSE 'kpi:' || kpi_key END AS entity_id,
           CASE WHEN aggregation = 'sum' THEN CAST(numerator AS DOUBLE)
                ELSE {_RATIO.format(n='numerator', d='denominator')} END AS value,
           numerator, denominator, aggregation
    FROM kpi_inputs""")

cte("kpi_budget", ["budget_vs_actual"], f"""
    SELECT month_start, 'budget_deviation' AS kpi_key,
           CASE WHEN grouping(category_name_en) = 0 THEN 'category' ELSE 'total' END AS dimension,
           CASE WHEN grouping(category_name_en) = 0 THEN category_name_en ELSE 'all' END AS dimension_value,
           CASE WHEN grouping(category_name_en) = 0 THEN 'category:' || category_name_en ELSE 'kpi:budget_deviation' END AS entity_id,
           'ratio' AS aggregation, CAST(sum(deviation_abs) AS {_D}) AS numerator, CAST(sum(budget_brl) AS {_D}) AS denominator
    FROM budget_vs_actual GROUP BY GROUPING SETS ((month_start), (month_start, category_name_en))""")

cte("kpi_monthly", ["kpi_daily", "kpi_budget"], f"""
    SELECT month_start, kpi_key, dimension, dimension_value, entity_id,
           CASE WHEN aggregation = 'sum' THEN CAST(numerator AS DOUBLE)
                ELSE {_RATIO.format(n='numerator', d='denominator')} END AS value,
           numerator, denominator, aggregation,
           last_day(month_start) <= DATE '{SIM}' AS is_complete
    FROM (
      SELECT CAST(date_trunc('month', kpi_date) AS DATE) AS month_start, kpi_key, dimension, dimension_value, entity_id,
             aggregation, sum(numerator) AS numerator, sum(denominator) AS denominator
      FROM kpi_daily GROUP BY 1, 2, 3, 4, 5, 6
      UNION ALL
      SELECT month_start, kpi_key, dimension, dimension_value, entity_id, aggregation, numerator, denominator FROM kpi_budget
    ) c""")


cte("registry", [], registry_values_sql())


def _order(names: tuple[str, ...]) -> list[str]:
    seen: list[str] = []

    def visit(n: str) -> None:
        if n in seen:
            return
        for d in CTES[n][0]:
            visit(d)
        seen.append(n)

    for n in names:
        visit(n)
    return seen


def with_ctes(final_sql: str, *names: str) -> str:
    """``WITH <named CTEs and dependencies> <final_sql>``."""
    parts = [f"{n} AS ({CTES[n][1]}\n)" for n in _order(names)]
    return "WITH " + ",\n".join(parts) + "\n" + final_sql
