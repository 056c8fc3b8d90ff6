"""Registered queries: data quality, operational tables, generators, analyst context."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kpiforge import config
from kpiforge.context import Ctx
from kpiforge.operators import kpi, marts, ops, quality, staging
from kpiforge.operators import anomaly
from kpiforge.plans.catalog import register
from kpiforge.plans.oracle_ctes import SIM_NEXT, cte, with_ctes
from kpiforge.sources import landing

SIM_D = config.SIM_DATE

# --- DQ specs (table -> Spark model; the oracle reads the CTE of the same name) -----------------
MODELS = {
    "erp_order_items": lambda ctx: landing.erp_order_items(ctx),
    "stg_orders": staging.stg_orders,
    "stg_order_items": staging.stg_order_items,
    "stg_payments": staging.stg_payments,
    "stg_customers": staging.stg_customers,
    "stg_sellers": staging.stg_sellers,
    "product_category": marts.product_category,
    "stg_reviews": staging.stg_reviews,
    "fct_marketing_daily": marts.fct_marketing_daily,
    "stg_budgets": marts.stg_budgets,
    "dim_date": marts.dim_date,
    "dim_region": marts.dim_region,
    "dim_customer": marts.dim_customer,
    "dim_product": marts.dim_product,
    "dim_seller": marts.dim_seller,
    "fct_orders": marts.fct_orders,
    "fct_order_items": marts.fct_order_items,
    "fct_payments": marts.fct_payments,
    "fct_reviews": marts.fct_reviews,
    "budget_vs_actual": marts.budget_vs_actual,
    "stg_category_translation": staging.stg_category_translation,
    "kpi_daily": kpi.kpi_daily,
    "kpi_monthly": kpi.kpi_monthly,
}

NOT_NULL = [
    ("stg_sellers", ["seller_id"]),
    ("stg_category_translation", ["category_name_pt"]),
    ("dim_date", ["date_day"]),
    ("dim_product", ["product_id", "category_name_en"]),
    ("dim_seller", ["seller_id"]),
    ("stg_orders", ["order_id", "customer_id", "order_status", "purchased_at"]),
    ("stg_order_items", ["order_id", "product_id", "price"]),
    ("stg_customers", ["customer_id", "customer_unique_id"]),
    ("stg_reviews", ["review_score"]),
    ("product_category", ["product_id", "category_name_en"]),
    ("dim_region", ["state_code", "entity_id", "state_name"]),
    ("dim_customer", ["customer_unique_id"]),
    ("fct_orders", ["order_id", "customer_unique_id", "state_code", "purchase_date"]),
    ("kpi_daily", ["kpi_date", "kpi_key", "value"]),
    ("kpi_monthly", ["kpi_key", "value"]),
]

UNIQUE = [
    ("erp_order_items", ["order_id", "order_item_id"]),
    ("stg_orders", ["order_id"]),
    ("stg_order_items", ["order_id", "order_item_id"]),
    ("stg_payments", ["order_id", "payment_sequential"]),
    ("stg_customers", ["customer_id"]),
    ("stg_sellers", ["seller_id"]),
    ("product_category", ["product_id"]),
    ("stg_reviews", ["review_id", "order_id"]),
    ("fct_marketing_daily", ["marketing_date", "channel"]),
    ("stg_budgets", ["budget_month", "category_name_en"]),
    ("dim_date", ["date_day"]),
    ("dim_region", ["state_code"]),
    ("dim_region", ["entity_id"]),
    ("dim_customer", ["customer_unique_id"]),
    ("dim_product", ["product_id"]),
    ("dim_seller", ["seller_id"]),
    ("stg_category_translation", ["category_name_pt"]),
    ("fct_orders", ["order_id"]),
    ("fct_order_items", ["order_id", "order_item_id"]),
    ("fct_payments", ["order_id", "payment_sequential"]),
    ("fct_reviews", ["review_id", "order_id"]),
    ("budget_vs_actual", ["month_start", "category_name_en"]),
    ("kpi_daily", ["kpi_date", "kpi_key", "dimension", "dimension_value"]),
    ("kpi_monthly", ["month_start", "kpi_key", "dimension", "dimension_value"]),
]

RELATIONSHIPS = [
    ("stg_orders", "customer_id", "stg_customers", "customer_id"),
    ("stg_order_items", "order_id", "stg_orders", "order_id"),
    ("dim_customer", "state_code", "dim_region", "state_code"),
    ("dim_seller", "state_code", "dim_region", "state_code"),
    ("fct_orders", "customer_unique_id", "dim_customer", "customer_unique_id"),
    ("fct_orders", "state_code", "dim_region", "state_code"),
    ("fct_orders", "purchase_date", "dim_date", "date_day"),
    ("fct_order_items", "product_id", "dim_product", "product_id"),
    ("fct_order_items", "seller_id", "dim_seller", "seller_id"),
    ("kpi_daily", "kpi_date", "dim_date", "date_day"),
]

ACCEPTED = [
    ("stg_orders", "order_status", config.ORDER_STATUSES),
    ("stg_payments", "payment_type", config.PAYMENT_TYPES),
    ("stg_reviews", "review_score", [1, 2, 3, 4, 5]),
    ("fct_marketing_daily", "channel", config.MARKETING_CHANNELS),
    ("kpi_daily", "kpi_key", config.DAILY_KPI_KEYS),
    ("kpi_daily", "dimension", config.DIMENSIONS),
    ("kpi_daily", "aggregation", config.AGGREGATIONS),
    ("kpi_monthly", "kpi_key", config.MONTHLY_KPI_KEYS),
]


def _m(ctx: Ctx, name: str) -> DataFrame:
    return MODELS[name](ctx)


def _lit(v) -> str:
    return str(v) if isinstance(v, int) else f"'{v}'"


def _union_sql(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)


_NN_SQL = _union_sql([
    f"SELECT '{t}' AS table_name, column_name, failures FROM (SELECT "
    + ", ".join(f"count(*) FILTER (WHERE {c} IS NULL) AS {c}" for c in cols)
    + f" FROM {t}) UNPIVOT (failures FOR column_name IN ({', '.join(cols)})) WHERE failures > 0"
    for t, cols in NOT_NULL
])


@register("dq_not_null", with_ctes(_NN_SQL, *{t for t, _ in NOT_NULL}))
def dq_not_null(ctx: Ctx) -> DataFrame:
    """NULL counts per column, one aggregation per table; failures only."""
    return quality.union_all([quality.not_null(t, _m(ctx, t), cols) for t, cols in NOT_NULL])


_UQ_SQL = _union_sql([
    f"SELECT '{t}' AS table_name, '{','.join(keys)}' AS key_columns, "
    f"concat_ws('|', {', '.join(f'CAST({k} AS VARCHAR)' for k in keys)}) AS key_value, count(*) AS n "
    f"FROM {t} GROUP BY {', '.join(keys)} HAVING count(*) > 1"
    for t, keys in UNIQUE
])


@register("dq_unique", with_ctes(_UQ_SQL, *{t for t, _ in UNIQUE}))
def dq_unique(ctx: Ctx) -> DataFrame:
    """Duplicate keys (single and combined columns)."""
    return quality.union_all([quality.unique(t, _m(ctx, t), keys) for t, keys in UNIQUE])


_REL_SQL = _union_sql([
    f"SELECT '{c}' AS table_name, '{fk}' AS column_name, CAST({fk} AS VARCHAR) AS orphan_key, count(*) AS n FROM {c} "
    f"WHERE {fk} IS NOT NULL AND {fk} NOT IN (SELECT {pk} FROM {p} WHERE {pk} IS NOT NULL) GROUP BY {fk}"
    for c, fk, p, pk in RELATIONSHIPS
])


@register("dq_relationships", with_ctes(_REL_SQL, *{x for c, _, p, _ in RELATIONSHIPS for x in (c, p)}))
def dq_relationships(ctx: Ctx) -> DataFrame:
    """Child keys without parent (anti joins)."""
    return quality.union_all(
        [quality.relationships(c, _m(ctx, c), fk, _m(ctx, p), pk) for c, fk, p, pk in RELATIONSHIPS]
    )


_ACC_SQL = _union_sql([
    f"SELECT '{t}' AS table_name, '{c}' AS column_name, CAST({c} AS VARCHAR) AS value, count(*) AS n FROM {t} "
    f"WHERE {c} IS NOT NULL AND {c} NOT IN ({', '.join(_lit(v) for v in vals)}) GROUP BY {c}"
    for t, c, vals in ACCEPTED
])


@register("dq_accepted", with_ctes(_ACC_SQL, *{t for t, _, _ in ACCEPTED}))
def dq_accepted(ctx: Ctx) -> DataFrame:
    """Values outside the accepted sets (NULL passes)."""
    return quality.union_all([quality.accepted_values(t, _m(ctx, t), c, vals) for t, c, vals in ACCEPTED])


@register("kpi_fresh", with_ctes(
    f"""SELECT max(kpi_date) AS latest_kpi_date, DATE '{SIM_D}' AS sim_date,
               coalesce(max(kpi_date) = DATE '{SIM_D}', false) AS passed
        FROM kpi_daily WHERE kpi_key NOT IN ('conversion_rate', 'roas')""", "kpi_daily"))
def kpi_fresh(ctx: Ctx) -> DataFrame:
    """The mart reaches the as-of date (order domain)."""
    d = kpi.kpi_daily(ctx).filter(~F.col("kpi_key").isin(ops.WEB_KPIS)).agg(F.max("kpi_date").alias("latest_kpi_date"))
    return d.select(
        "latest_kpi_date", F.lit(SIM_D).alias("sim_date"),
        F.coalesce(F.col("latest_kpi_date") == F.lit(SIM_D), F.lit(False)).alias("passed"),
    )


@register("registry_coverage", with_ctes(
    """SELECT 'missing_in_mart' AS problem, key AS kpi_key FROM registry
         WHERE grain = 'day' AND key NOT IN (SELECT kpi_key FROM kpi_daily)
       UNION ALL
       SELECT 'missing_in_mart', key FROM registry
         WHERE grain = 'month' AND key NOT IN (SELECT kpi_key FROM kpi_monthly)
       UNION ALL
       SELECT DISTINCT 'not_registered', kpi_key FROM kpi_monthly WHERE kpi_key NOT IN (SELECT key FROM registry)""",
    "registry", "kpi_daily", "kpi_monthly"))
def registry_coverage(ctx: Ctx) -> DataFrame:
    """Registry keys the marts miss, and mart keys the registry misses."""
    reg = anomaly.registry(ctx).select(F.col("key").alias("kpi_key"), "grain")
    daily = kpi.kpi_daily(ctx).select("kpi_key").distinct()
    monthly = kpi.kpi_monthly(ctx).select("kpi_key").distinct()
    miss_d = reg.filter(F.col("grain") == "day").join(daily, "kpi_key", "left_anti")
    miss_m = reg.filter(F.col("grain") == "month").join(monthly, "kpi_key", "left_anti")
    extra = monthly.join(reg, "kpi_key", "left_anti")
    return (
        miss_d.select(F.lit("missing_in_mart").alias("problem"), "kpi_key")
        .unionByName(miss_m.select(F.lit("missing_in_mart").alias("problem"), "kpi_key"))
        .unionByName(extra.select(F.lit("not_registered").alias("problem"), "kpi_key"))
    )


_ID_SOURCES = [
    ("dim_customer", "entity_id"), ("dim_product", "entity_id"), ("dim_product", "category_entity_id"),
    ("dim_region", "entity_id"), ("dim_seller", "entity_id"), ("kpi_daily", "entity_id"),
]


def _id_union_sql() -> str:
    return _union_sql([f"SELECT DISTINCT '{t}.{c}' AS source, {c} AS entity_id FROM {t}" for t, c in _ID_SOURCES])


def _audit_sql() -> str:
    valid = " OR ".join(
        f"(split_part(entity_id, ':', 1) = '{n}' AND regexp_full_match(entity_id, '{p}'))"
        for n, p in quality.ENTITY_PATTERNS.items()
    )
    known = ", ".join(f"'{n}'" for n in quality.ENTITY_PATTERNS)
    return (
        f"SELECT source, entity_id, split_part(entity_id, ':', 1) AS entity_type, "
        f"CASE WHEN split_part(entity_id, ':', 1) NOT IN ({known}) THEN 'unknown_type' ELSE 'pattern' END AS problem "
        f"FROM ({_id_union_sql()}) ids WHERE NOT ({valid})"
    )


@register("entity_id_audit", with_ctes(_audit_sql(), *{t for t, _ in _ID_SOURCES}))
def entity_id_audit(ctx: Ctx) -> DataFrame:
    """Entity ids of six mart columns that break the namespace patterns."""
    ids = quality.union_all([
        _m(ctx, t).select(F.lit(f"{t}.{c}").alias("source"), F.col(c).alias("entity_id")).distinct()
        for t, c in _ID_SOURCES
    ])
    return quality.entity_audit(ids)


_ADDITIVE = ["gmv", "orders_count", "new_customers", "returning_customers"]


@register("additivity_check", with_ctes(
    f"""SELECT kpi_date, kpi_key, dimension,
               CAST(sum(numerator) FILTER (WHERE dimension_value = 'all') AS DOUBLE) AS total,
               CAST(sum(numerator) FILTER (WHERE dimension_value <> 'all') AS DOUBLE) AS members_sum,
               CAST(coalesce(sum(numerator) FILTER (WHERE dimension_value = 'all'), 0)
                    - coalesce(sum(numerator) FILTER (WHERE dimension_value <> 'all'), 0) AS DOUBLE) AS difference
        FROM (SELECT kpi_date, kpi_key, numerator, dimension_value, 'region' AS dimension FROM kpi_daily
              WHERE kpi_key IN ({', '.join(repr(k) for k in _ADDITIVE)}) AND dimension IN ('total', 'region')
              UNION ALL
              SELECT kpi_date, kpi_key, numerator, dimension_value, 'category' FROM kpi_daily
              WHERE kpi_key = 'gmv' AND dimension IN ('total', 'category')) x
        GROUP BY kpi_date, kpi_key, dimension""", "kpi_daily"))
def additivity_check(ctx: Ctx) -> DataFrame:
    """Per day and additive KPI, total vs the sum of its members (difference must be 0)."""
    d = kpi.kpi_daily(ctx)
    reg = d.filter(F.col("kpi_key").isin(_ADDITIVE) & F.col("dimension").isin("total", "region")).withColumn(
        "dim", F.lit("region"))
    cat = d.filter((F.col("kpi_key") == "gmv") & F.col("dimension").isin("total", "category")).withColumn(
        "dim", F.lit("category"))
    x = reg.unionByName(cat)
    is_total = F.col("dimension_value") == "all"
    g = x.groupBy("kpi_date", "kpi_key", F.col("dim").alias("dimension")).agg(
        F.sum(F.when(is_total, F.col("numerator"))).alias("t"),
        F.sum(F.when(~is_total, F.col("numerator"))).alias("m"),
    )
    return g.select(
        "kpi_date", "kpi_key", "dimension",
        F.col("t").cast("double").alias("total"), F.col("m").cast("double").alias("members_sum"),
        (F.coalesce("t", F.lit(0)) - F.coalesce("m", F.lit(0))).cast("double").alias("difference"),
    )


_COUNT_TABLES = ["stg_orders", "stg_order_items", "stg_customers", "fct_orders", "fct_order_items", "kpi_daily", "kpi_monthly"]


@register("row_count_audit", with_ctes(
    _union_sql([f"SELECT '{t}' AS table_name, count(*) AS n FROM {t}" for t in _COUNT_TABLES]), *_COUNT_TABLES))
def row_count_audit(ctx: Ctx) -> DataFrame:
    """Row counts of the key tables in one union."""
    return quality.union_all([_m(ctx, t).agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("table_name"), "n")
                              for t in _COUNT_TABLES])


# --- ops: load log, watermarks, status, usage ------------------------------------------------------
cte("load_log", ["erp_orders", "erp_order_items", "stg_marketing", "stg_reviews"], f"""
    SELECT source || ':' || entity || ':' || strftime(month, '%Y-%m') AS load_id, source, entity, 'incremental' AS mode,
           last_day(month) AS sim_date, watermark_to, rows_loaded, 'success' AS status, CAST(NULL AS VARCHAR) AS error,
           CAST(last_day(month) + 1 AS TIMESTAMP) + INTERVAL 2 HOUR AS started_at,
           CAST(last_day(month) + 1 AS TIMESTAMP) + INTERVAL 2 HOUR + INTERVAL 5 MINUTE AS finished_at
    FROM (
      SELECT 'erp' AS source, 'orders' AS entity, CAST(date_trunc('month', order_purchase_timestamp) AS DATE) AS month,
             count(*) AS rows_loaded, max(order_purchase_timestamp) AS watermark_to FROM erp_orders GROUP BY 3
      UNION ALL SELECT 'erp', 'order_items', CAST(date_trunc('month', _wm) AS DATE), count(*), max(_wm) FROM erp_order_items GROUP BY 3
      UNION ALL SELECT 'erp', 'payments', CAST(date_trunc('month', o_orderdate) AS DATE), count(*), max(o_orderdate)
                FROM orders WHERE o_orderdate < TIMESTAMP '{SIM_NEXT}' GROUP BY 3
      UNION ALL SELECT 'legacy', 'reviews', CAST(date_trunc('month', created_at) AS DATE), count(*), max(created_at) FROM stg_reviews GROUP BY 3
      UNION ALL SELECT 'marketing', 'marketing_daily', CAST(date_trunc('month', marketing_date) AS DATE), count(*),
                max(CAST(marketing_date AS TIMESTAMP)) FROM stg_marketing GROUP BY 3) x""")
CTES_LOAD_DEPS = ["load_log", "stg_reviews"]


@register("load_log", with_ctes("SELECT * FROM load_log", *CTES_LOAD_DEPS))
def load_log(ctx: Ctx) -> DataFrame:
    """One load-log row per entity and monthly run."""
    return ops.load_log(ctx)


@register("watermark_lookup", with_ctes(
    """SELECT source, entity, arg_max(watermark_to, finished_at) AS watermark FROM load_log
       WHERE status = 'success' AND watermark_to IS NOT NULL GROUP BY source, entity""", *CTES_LOAD_DEPS))
def watermark_lookup(ctx: Ctx) -> DataFrame:
    """Last successful watermark of every entity, one pass."""
    return ops.watermark_lookup(ops.load_log(ctx))


_WM_CUT = SIM_D - timedelta(days=365)


@register("watermark_advance", with_ctes(
    f"""SELECT coalesce(p.source, n.source) AS source, coalesce(p.entity, n.entity) AS entity,
               coalesce(n.new_wm, p.watermark) AS watermark
        FROM (SELECT source, entity, arg_max(watermark_to, finished_at) AS watermark FROM load_log
              WHERE status = 'success' AND sim_date < DATE '{_WM_CUT}' GROUP BY source, entity) p
        FULL OUTER JOIN (SELECT 'erp' AS source, e.entity, max(o.o_orderdate) AS new_wm
                         FROM orders o JOIN (SELECT 'orders' AS entity UNION ALL SELECT 'payments') e ON true
                         WHERE o.o_orderdate > TIMESTAMP '{_WM_CUT}' AND o.o_orderdate < TIMESTAMP '{SIM_NEXT}'
                         GROUP BY e.entity
                         UNION ALL
                         SELECT 'erp', 'order_items', max(o.o_orderdate) FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
                         WHERE o.o_orderdate > TIMESTAMP '{_WM_CUT}' AND o.o_orderdate < TIMESTAMP '{SIM_NEXT}') n
        ON p.source = n.source AND p.entity = n.entity""", *CTES_LOAD_DEPS))
def watermark_advance(ctx: Ctx) -> DataFrame:
    """Next watermark = max of the newly extracted rows, else the previous one (entities
    without new rows keep theirs)."""
    log = ops.load_log(ctx).filter(F.col("sim_date") < F.lit(_WM_CUT))
    prev = ops.watermark_lookup(log)
    since = landing._ts(_WM_CUT)
    new = quality.union_all([
        landing.erp_orders(ctx, since, SIM_D).select(F.lit("erp").alias("source"), F.lit("orders").alias("entity"), "_wm"),
        landing.erp_order_items(ctx, since, SIM_D).select(F.lit("erp").alias("source"), F.lit("order_items").alias("entity"), "_wm"),
        landing.erp_payments(ctx, since, SIM_D).select(F.lit("erp").alias("source"), F.lit("payments").alias("entity"), "_wm"),
    ])
    return ops.watermark_advance(prev, new)


@register("pipeline_status", with_ctes(
    f"""SELECT DATE '{SIM_D}' AS sim_date, k.latest_kpi_date, l.last_successful_load_at, l.last_failed_load_at,
               CASE WHEN k.latest_kpi_date IS NULL THEN 'down' WHEN k.latest_kpi_date = DATE '{SIM_D}' THEN 'ok' ELSE 'stale' END AS status
        FROM (SELECT max(kpi_date) AS latest_kpi_date FROM kpi_daily WHERE kpi_key NOT IN ('conversion_rate', 'roas')) k,
             (SELECT max(finished_at) FILTER (WHERE status = 'success') AS last_successful_load_at,
                     max(finished_at) FILTER (WHERE status = 'failed') AS last_failed_load_at FROM load_log) l""",
    "kpi_daily", *CTES_LOAD_DEPS))
def pipeline_status(ctx: Ctx) -> DataFrame:
    """Freshness row with health status."""
    return ops.pipeline_status(ctx)


cte("llm_usage", [], f"""
    SELECT CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS usage_id, 'chat' AS purpose, 'mistral' AS provider,
           model, sim_date, tokens_out * 3 AS tokens_in, tokens_out,
           CAST((tokens_out * 3 * p_in + tokens_out * p_out) / 1000000 AS DECIMAL(18,10)) AS cost_eur,
           CAST(sim_date AS TIMESTAMP) + INTERVAL 7 HOUR AS created_at
    FROM (
      SELECT conv_id, turn, CAST(ceil(length(text) / 4) AS BIGINT) AS tokens_out,
             CASE WHEN turn <= 2 THEN 'mistral-small-latest' ELSE 'mistral-large-latest' END AS model,
             CAST(CASE WHEN turn <= 2 THEN {ops.MODEL_PRICES['mistral-small-latest'][0]} ELSE {ops.MODEL_PRICES['mistral-large-latest'][0]} END AS DECIMAL(10,4)) AS p_in,
             CAST(CASE WHEN turn <= 2 THEN {ops.MODEL_PRICES['mistral-small-latest'][1]} ELSE {ops.MODEL_PRICES['mistral-large-latest'][1]} END AS DECIMAL(10,4)) AS p_out,
             CAST(DATE '2024-01-01' + CAST(conv_id % 30 AS INTEGER) AS DATE) AS sim_date
      FROM conversations WHERE role = 'assistant') c""")
cte("usage_daily", ["llm_usage"], """
    SELECT CAST(created_at AS DATE) AS day, purpose, provider, model, count(*) AS calls,
           sum(tokens_in) AS tokens_in, sum(tokens_out) AS tokens_out, sum(cost_eur) AS cost_eur
    FROM llm_usage GROUP BY 1, 2, 3, 4""")


@register("usage_cost", with_ctes("SELECT * REPLACE (CAST(cost_eur AS DOUBLE) AS cost_eur) FROM llm_usage", "llm_usage"))
def usage_cost(ctx: Ctx) -> DataFrame:
    """Usage rows with cost from the price table."""
    return ops.llm_usage(ctx)


@register("usage_daily", with_ctes("SELECT * REPLACE (CAST(cost_eur AS DOUBLE) AS cost_eur) FROM usage_daily", "usage_daily"))
def usage_daily(ctx: Ctx) -> DataFrame:
    """Calls, tokens and cost per day, purpose, provider, model."""
    return ops.usage_daily(ops.llm_usage(ctx))


@register("usage_totals", with_ctes(
    "SELECT CAST(round(sum(cost_eur), 6) AS DOUBLE) AS total_cost_eur, sum(tokens_in + tokens_out) AS total_tokens FROM usage_daily",
    "usage_daily"))
def usage_totals(ctx: Ctx) -> DataFrame:
    """Total cost rounded to 6 decimals and total tokens."""
    return ops.usage_totals(ops.usage_daily(ops.llm_usage(ctx)))


# --- generators (deterministic parts) ------------------------------------------------------------
cte("orders_per_day", ["fct_orders"], """
    SELECT CAST(d AS DATE) AS day, coalesce(c.orders, 0) AS orders
    FROM (SELECT unnest(generate_series(min(purchase_date), max(purchase_date), INTERVAL 1 DAY)) AS d FROM fct_orders) s
    LEFT JOIN (SELECT purchase_date, count(*) AS orders FROM fct_orders GROUP BY 1) c ON c.purchase_date = CAST(s.d AS DATE)""")
cte("demand_blend", ["orders_per_day"], f"""
    SELECT day, orders, round(sm, 6) AS smooth, round(0.6 * orders + 0.4 * sm, 6) AS demand, round(f, 6) AS weekday_factor,
           round((0.6 * orders + 0.4 * sm) / ({ops.BASE_CONVERSION_RATE} * f), 3) AS expected_sessions
    FROM (SELECT day, orders,
                 greatest(avg(orders) OVER (ORDER BY day ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), 1.0) AS sm,
                 1.0 + 0.08 * sin(2 * pi() * ((dayofweek(day) + 6) % 7) / 7.0) AS f
          FROM orders_per_day) x""")


@register("demand_blend", with_ctes("SELECT * FROM demand_blend", "demand_blend"))
def demand_blend(ctx: Ctx) -> DataFrame:
    """Smoothed daily demand and the expected sessions."""
    return ops.demand_blend(ctx)


_SPLIT_SQL = _union_sql([
    f"SELECT day, '{n}' AS channel, CAST(round(expected_sessions * {s}, 0) AS BIGINT) AS sessions, "
    + (f"{ops.EMAIL_DAILY_COST} AS ad_spend" if c is None else f"round(CAST(round(expected_sessions * {s}, 0) AS BIGINT) * {c}, 2) AS ad_spend")
    + " FROM demand_blend"
    for n, s, c in ops.CHANNEL_SPLIT
])


@register("channel_split", with_ctes(_SPLIT_SQL, "demand_blend"))
def channel_split(ctx: Ctx) -> DataFrame:
    """Sessions and spend per channel from fixed shares and unit costs."""
    return ops.channel_split(ctx)


@register("budget_baseline", with_ctes(
    "SELECT month_start, category_name_en, CAST(greatest(round(actual_gmv / 100, 0), 1) * 100 AS DOUBLE) AS baseline FROM category_month_actuals",
    "category_month_actuals"))
def budget_baseline(ctx: Ctx) -> DataFrame:
    """Monthly category GMV of valid orders rounded to 100 (floor 100)."""
    from kpiforge.functions.columns import budget_round

    a = marts.category_month_actuals(ctx)
    return a.select("month_start", "category_name_en", budget_round(F.col("actual_gmv")).cast("double").alias("baseline"))
