"""Registered queries: sources, staging, star schema and KPI marts."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kpiforge import config
from kpiforge.context import Ctx
from kpiforge.operators import kpi, marts, staging
from kpiforge.plans import catalog
from kpiforge.plans.oracle_ctes import SIM, SIM_NEXT, WEB_SIM, with_ctes

# Star schema and mart queries: one lazy plan each (no intermediate writes).
register = functools.partial(catalog.register, materialize=False)
from kpiforge.sources import landing


def _dbl(*cols: str) -> str:
    return "* REPLACE (" + ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in cols) + ")"


# --- 2.1 sources ----------------------------------------------------------------------------
@register(
    "scan_incremental_orders",
    with_ctes(
        "SELECT order_id, customer_id, order_status, order_purchase_timestamp, order_approved_at, "
        "order_delivered_carrier_date, order_delivered_customer_date, order_estimated_delivery_date, "
        "order_purchase_timestamp AS _wm FROM erp_orders",
        "erp_orders",
    ),
)
def scan_incremental_orders(ctx: Ctx) -> DataFrame:
    """Orders up to the simulation date (first load: since = -inf)."""
    return landing.erp_orders(ctx, None, ctx.sim_date)


@register(
    "scan_incremental_items",
    f"""SELECT l.l_orderkey AS order_id, l.l_linenumber AS order_item_id, l.l_partkey AS product_id,
           l.l_suppkey AS seller_id, l.l_shipdate AS shipping_limit_date, l.l_extendedprice AS price,
           l.l_tax AS tax_rate, l.l_quantity AS quantity, l.l_discount AS discount,
           l.l_returnflag AS return_flag, l.l_linestatus AS line_status, o.o_orderdate AS _wm
    FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
    WHERE o.o_orderdate < TIMESTAMP '{SIM_NEXT}'""",
)
def scan_incremental_items(ctx: Ctx) -> DataFrame:
    """Line items cut by their parent order's timestamp."""
    return landing.erp_order_items(ctx, None, ctx.sim_date)


@register(
    "scan_full_master",
    """SELECT c.c_custkey AS customer_id, c.c_custkey AS customer_unique_id,
           lpad(CAST(c.c_custkey % 100000 AS VARCHAR), 5, '0') AS customer_zip_code_prefix,
           lower(c.c_mktsegment) AS customer_city, n.n_name AS customer_state
    FROM customer c LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey""",
)
def scan_full_master(ctx: Ctx) -> DataFrame:
    """Full reload of master data."""
    return landing.erp_customers(ctx)


@register(
    "scan_incremental_text_ts",
    with_ctes(
        f"""SELECT order_id AS review_id, order_id, CAST(1 + order_id % 5 AS VARCHAR) AS review_score,
               strftime(CAST(order_delivered_customer_date AS DATE) + {config.REVIEW_DELAY_DAYS}, '%Y-%m-%d %H:%M:%S') AS review_creation_date
        FROM erp_orders
        WHERE order_delivered_customer_date IS NOT NULL
          AND strftime(CAST(order_delivered_customer_date AS DATE) + {config.REVIEW_DELAY_DAYS}, '%Y-%m-%d %H:%M:%S') < '{SIM_NEXT}'""",
        "erp_orders",
    ),
)
def scan_incremental_text_ts(ctx: Ctx) -> DataFrame:
    """Review export cut by ISO-string comparison of the creation timestamp."""
    return landing.legacy_reviews(ctx)


@register(
    "scan_date_window",
    with_ctes(f"SELECT marketing_date AS date, channel, sessions, ad_spend FROM stg_marketing WHERE marketing_date <= DATE '{WEB_SIM}'", "stg_marketing"),
)
def scan_date_window(ctx: Ctx) -> DataFrame:
    """Marketing extract for an inclusive date window (to = as-of date)."""
    return landing.marketing_daily(ctx, None, ctx.web_sim_date)


@register("scan_budget", with_ctes(f"SELECT {_dbl('budget_brl')} FROM stg_budgets", "stg_budgets"))
def scan_budget(ctx: Ctx) -> DataFrame:
    """The whole controlling plan (visible at any as-of date)."""
    return marts.stg_budgets(ctx)


@register("dim_date", with_ctes("SELECT * FROM dim_date", "dim_date"))
def dim_date(ctx: Ctx) -> DataFrame:
    """S09 + F04-F06: generated calendar."""
    return marts.dim_date(ctx)


# --- 2.3 staging ----------------------------------------------------------------------------
@register(
    "latest_per_key",
    with_ctes(
        """SELECT * EXCLUDE (rn, _wm) FROM (
             SELECT *, row_number() OVER (PARTITION BY order_id, order_item_id
               ORDER BY shipping_limit_date DESC, product_id DESC, seller_id DESC, price DESC, quantity DESC,
                        discount DESC, tax_rate DESC, return_flag DESC, line_status DESC) AS rn
             FROM erp_order_items) r WHERE rn = 1""",
        "erp_order_items",
    ),
)
def latest_per_key(ctx: Ctx) -> DataFrame:
    """One row per (order_id, order_item_id) with a total tie-break."""
    raw = landing.erp_order_items(ctx).drop("_wm")
    return staging.latest_per_key(raw, ["order_id", "order_item_id"], staging.ITEM_ORDER)


@register(
    "distinct_pairs",
    with_ctes("SELECT DISTINCT category_name_pt, category_name_en FROM product_category", "product_category"),
)
def distinct_pairs(ctx: Ctx) -> DataFrame:
    """Distinct (source name, English name) pairs of the product catalogue."""
    return marts.product_category(ctx).select("category_name_pt", "category_name_en").distinct()


@register("staging_typed_items", with_ctes(f"SELECT {_dbl('price', 'freight_value')} FROM stg_order_items", "stg_order_items"))
def staging_typed_items(ctx: Ctx) -> DataFrame:
    """Typed items; freight rounded in decimal."""
    return staging.stg_order_items(ctx)


@register("stg_customers", with_ctes("SELECT * FROM stg_customers", "stg_customers"))
def stg_customers(ctx: Ctx) -> DataFrame:
    """Renamed customers with normalised state."""
    return staging.stg_customers(ctx)


@register("stg_sellers", with_ctes("SELECT * FROM stg_sellers", "stg_sellers"))
def stg_sellers(ctx: Ctx) -> DataFrame:
    return staging.stg_sellers(ctx)


@register("asof_mask_orders", with_ctes("SELECT * FROM stg_orders", "stg_orders"))
def asof_mask_orders(ctx: Ctx) -> DataFrame:
    """Timestamps after the as-of date masked, status rolled back."""
    return staging.stg_orders(ctx)


@register("fct_marketing_daily", with_ctes(f"SELECT {_dbl('ad_spend')} FROM fct_marketing_daily", "fct_marketing_daily"))
def fct_marketing_daily(ctx: Ctx) -> DataFrame:
    """Marketing rows up to the as-of date."""
    return marts.fct_marketing_daily(ctx)


@register(
    "dim_region",
    with_ctes(
        """SELECT s.state_code, 'region:' || s.state_code AS entity_id, s.state_name, s.macro_region,
                  c.centroid_lat, c.centroid_lng
           FROM region_seed s LEFT JOIN (
             SELECT state_code, round(CAST(sum(lat) AS DOUBLE) / count(lat), 4) AS centroid_lat,
                    round(CAST(sum(lng) AS DOUBLE) / count(lng), 4) AS centroid_lng
             FROM stg_geolocation WHERE lat BETWEEN -34 AND 6 AND lng BETWEEN -74 AND -34
             GROUP BY state_code) c USING (state_code)""",
        "region_seed",
        "stg_geolocation",
    ),
)
def dim_region(ctx: Ctx) -> DataFrame:
    """States with centroids of the valid geo points."""
    return marts.dim_region(ctx)


@register("kpi_spine", with_ctes("SELECT * FROM spine", "spine"))
def kpi_spine(ctx: Ctx) -> DataFrame:
    """Every day from the first purchase to the as-of date."""
    return kpi.date_spine(ctx)


# --- 2.4 joins / 2.10 composite models ---------------------------------------------------------
_INT_DEC = ("delivery_days", "items_value", "freight_value", "payment_value")


@register("int_orders", with_ctes(f"SELECT {_dbl(*_INT_DEC)} FROM int_orders", "int_orders"))
def int_orders(ctx: Ctx) -> DataFrame:
    """Orders enriched with customer, item and payment totals, first-order flag."""
    return marts.int_orders(ctx)


@register("fct_orders", with_ctes(f"SELECT {_dbl(*_INT_DEC)} FROM fct_orders", "fct_orders"))
def fct_orders(ctx: Ctx) -> DataFrame:
    return marts.fct_orders(ctx)


@register("first_order_flag", with_ctes("SELECT order_id, customer_unique_id, is_first_order FROM int_orders", "int_orders"))
def first_order_flag(ctx: Ctx) -> DataFrame:
    """Is this the customer's first order (purchase time, then order id)."""
    return marts.int_orders(ctx).select("order_id", "customer_unique_id", "is_first_order")


@register("product_category", with_ctes(f"SELECT {_dbl('weight_g')} FROM product_category", "product_category"))
def product_category(ctx: Ctx) -> DataFrame:
    """Translation lookup with a three-step fallback."""
    return marts.product_category(ctx)


@register("fct_order_items", with_ctes(f"SELECT {_dbl('price', 'freight_value')} FROM fct_order_items", "fct_order_items"))
def fct_order_items(ctx: Ctx) -> DataFrame:
    """Items x orders x products."""
    return marts.fct_order_items(ctx)


@register("fct_payments", with_ctes(f"SELECT {_dbl('payment_value')} FROM fct_payments", "fct_payments"))
def fct_payments(ctx: Ctx) -> DataFrame:
    """Payments enriched by their order."""
    return marts.fct_payments(ctx)


@register("fct_reviews", with_ctes("SELECT * FROM fct_reviews", "fct_reviews"))
def fct_reviews(ctx: Ctx) -> DataFrame:
    """Reviews enriched by their order."""
    return marts.fct_reviews(ctx)


@register(
    "budget_vs_actual",
    with_ctes(f"SELECT {_dbl('budget_brl', 'actual_gmv', 'deviation_abs')} FROM budget_vs_actual", "budget_vs_actual"),
)
def budget_vs_actual(ctx: Ctx) -> DataFrame:
    """Plan x actual per month and category."""
    return marts.budget_vs_actual(ctx)


@register("dim_customer", with_ctes(
    """SELECT customer_unique_id, 'customer:' || customer_unique_id AS entity_id,
              arg_max(customer_state, (purchased_at, order_id)) AS state_code,
              min(purchased_at) AS first_order_at, max(purchased_at) AS last_order_at, count(*) AS orders_count
       FROM int_orders GROUP BY customer_unique_id""",
    "int_orders",
))
def dim_customer(ctx: Ctx) -> DataFrame:
    """One row per real customer, state of the latest order."""
    return marts.dim_customer(ctx)


@register("dim_product", with_ctes(
    f"""SELECT product_id, 'product:' || product_id AS entity_id, category_name_pt, category_name_en,
               'category:' || category_name_en AS category_entity_id, photos_qty, CAST(weight_g AS DOUBLE) AS weight_g
        FROM product_category""",
    "product_category",
))
def dim_product(ctx: Ctx) -> DataFrame:
    return marts.dim_product(ctx)


@register("dim_seller", with_ctes(
    "SELECT seller_id, 'seller:' || seller_id AS entity_id, city, state_code FROM stg_sellers", "stg_sellers"))
def dim_seller(ctx: Ctx) -> DataFrame:
    return marts.dim_seller(ctx)


@register("order_item_totals", with_ctes(
    f"SELECT {_dbl('items_value', 'freight_value')} FROM order_item_totals", "order_item_totals"))
def order_item_totals(ctx: Ctx) -> DataFrame:
    """Items per order before joining (no fan-out)."""
    return marts.order_item_totals(ctx)


# --- KPI mart ---------------------------------------------------------------------------------
@register("kpi_orders_agg", with_ctes("SELECT * FROM orders_agg", "orders_agg"))
def kpi_orders_agg(ctx: Ctx) -> DataFrame:
    """Filtered counts under grouping sets (date), (date, state)."""
    return kpi.kpi_orders_agg(ctx)


@register("kpi_items_agg", with_ctes(f"SELECT {_dbl('gmv', 'freight')} FROM items_agg", "items_agg"))
def kpi_items_agg(ctx: Ctx) -> DataFrame:
    """Three grouping levels with a distinct count."""
    return kpi.kpi_items_agg(ctx)


@register("kpi_delivery_agg", with_ctes(f"SELECT {_dbl('delivery_days_sum')} FROM delivery_agg", "delivery_agg"))
def kpi_delivery_agg(ctx: Ctx) -> DataFrame:
    """Delivery measures by delivery date."""
    return kpi.kpi_delivery_agg(ctx)


@register("kpi_review_agg", with_ctes("SELECT * FROM review_agg", "review_agg"))
def kpi_review_agg(ctx: Ctx) -> DataFrame:
    """Review measures by review date."""
    return kpi.kpi_review_agg(ctx)


@register("kpi_marketing", with_ctes(f"SELECT {_dbl('ad_spend', 'web_revenue')} FROM marketing_frame", "marketing_frame"))
def kpi_marketing(ctx: Ctx) -> DataFrame:
    """Sessions and spend per day with the same day's web orders."""
    return kpi.kpi_marketing(ctx)


@register("kpi_totals_dense", with_ctes("SELECT * FROM orders_frame", "orders_frame"))
def kpi_totals_dense(ctx: Ctx) -> DataFrame:
    """Zero-filled totals on the spine + member rows."""
    return kpi.densify_totals(
        ctx, kpi.kpi_orders_agg(ctx), ["orders_all", "orders_valid", "orders_canceled", "new_customers", "returning_customers"]
    )


@register("kpi_unpivot", with_ctes(f"SELECT {_dbl('numerator', 'denominator')} FROM kpi_inputs", "kpi_inputs"))
def kpi_unpivot(ctx: Ctx) -> DataFrame:
    """Wide measures to long KPI rows (stack)."""
    return kpi.kpi_inputs(ctx)


@register("kpi_daily", with_ctes(f"SELECT {_dbl('numerator', 'denominator')} FROM kpi_daily", "kpi_daily"))
def kpi_daily(ctx: Ctx) -> DataFrame:
    """M07 (flagship): the long-format daily KPI mart."""
    return kpi.kpi_daily(ctx)


@register("kpi_budget", with_ctes(f"SELECT {_dbl('numerator', 'denominator')} FROM kpi_budget", "kpi_budget"))
def kpi_budget(ctx: Ctx) -> DataFrame:
    """A10: budget deviation per month, total and per category."""
    return kpi.kpi_budget(ctx)


@register("kpi_monthly", with_ctes(f"SELECT {_dbl('numerator', 'denominator')} FROM kpi_monthly", "kpi_monthly"))
def kpi_monthly(ctx: Ctx) -> DataFrame:
    """Monthly roll-up of numerators and denominators + budget rows."""
    return kpi.kpi_monthly(ctx)
