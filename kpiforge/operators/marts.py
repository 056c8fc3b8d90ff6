"""Intermediate models, facts and dimensions of the star schema."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kpiforge import config
from kpiforge.context import Ctx, model
from kpiforge.functions.columns import budget_round, elapsed_days, entity_id, safe_ratio
from kpiforge.operators import staging

ITEM_FACTS = [
    "order_id",
    "order_item_id",
    "product_id",
    "seller_id",
    "category_name_en",
    "customer_unique_id",
    "state_code",
    "purchase_date",
    "is_canceled",
    "price",
    "freight_value",
]


@model
def order_item_totals(ctx: Ctx) -> DataFrame:
    """Items per order pre-aggregated before the join (no fan-out of order rows)."""
    return staging.stg_order_items(ctx).groupBy("order_id").agg(
        F.count(F.lit(1)).alias("items_count"),
        F.sum("price").alias("items_value"),
        F.sum("freight_value").alias("freight_value"),
    )


@model
def payment_totals(ctx: Ctx) -> DataFrame:
    return staging.stg_payments(ctx).groupBy("order_id").agg(F.sum("payment_value").alias("payment_value"))


@model
def first_orders(ctx: Ctx) -> DataFrame:
    """First order per real customer (purchase time, then order id).

    A group by with map-side partial aggregation instead of a row_number window over the
    customer: a customer holding a large share of all orders is reduced before the shuffle.
    """
    o = staging.stg_orders(ctx).select("order_id", "customer_id", "purchased_at")
    c = staging.stg_customers(ctx).select("customer_id", "customer_unique_id")
    return (
        o.join(c, "customer_id")
        .groupBy("customer_unique_id")
        .agg(F.min(F.struct("purchased_at", "order_id")).alias("first"))
        .select(F.col("first.order_id").alias("order_id"), F.lit(True).alias("is_first_order"))
    )


@model
def int_orders(ctx: Ctx) -> DataFrame:
    """One enriched row per order (customer, measures, delivery facts, first-order flag)."""
    o = staging.stg_orders(ctx)
    c = staging.stg_customers(ctx).select("customer_id", "customer_unique_id", F.col("state_code").alias("customer_state"))
    joined = (
        o.join(c, "customer_id")
        .join(order_item_totals(ctx), "order_id", "left")
        .join(payment_totals(ctx), "order_id", "left")
        .join(first_orders(ctx), "order_id", "left")
    )
    return joined.select(
        "order_id",
        "customer_id",
        "customer_unique_id",
        "customer_state",
        "order_status",
        F.col("order_status").isin(*config.CANCELED_STATUSES).alias("is_canceled"),
        "purchased_at",
        "purchase_date",
        "approved_at",
        "delivered_carrier_at",
        "delivered_customer_at",
        F.to_date("delivered_customer_at").alias("delivery_date"),
        "estimated_delivery_at",
        elapsed_days("delivered_customer_at", "purchased_at").alias("delivery_days"),
        F.when(
            F.col("delivered_customer_at").isNotNull(),
            F.to_date("delivered_customer_at") <= F.to_date("estimated_delivery_at"),
        ).alias("is_on_time"),
        F.coalesce(F.col("is_first_order"), F.lit(False)).alias("is_first_order"),
        F.coalesce(F.col("items_count"), F.lit(0)).cast("bigint").alias("items_count"),
        F.coalesce(F.col("items_value"), F.lit(0)).cast("decimal(22,2)").alias("items_value"),
        F.coalesce(F.col("freight_value"), F.lit(0)).cast("decimal(22,2)").alias("freight_value"),
        F.coalesce(F.col("payment_value"), F.lit(0)).cast("decimal(22,2)").alias("payment_value"),
    )


@model(table=True)
def fct_orders(ctx: Ctx) -> DataFrame:
    return int_orders(ctx).select(
        "order_id",
        "customer_unique_id",
        F.col("customer_state").alias("state_code"),
        "order_status",
        "is_canceled",
        "is_first_order",
        "purchased_at",
        "purchase_date",
        "approved_at",
        "delivered_carrier_at",
        "delivered_customer_at",
        "delivery_date",
        "estimated_delivery_at",
        "delivery_days",
        "is_on_time",
        "items_count",
        "items_value",
        "freight_value",
        "payment_value",
    )


@model
def product_category(ctx: Ctx) -> DataFrame:
    """Products with English category; fallback: source-language name, then 'unknown'.
    The translation lookup is a fixed handful of rows, so it is broadcast."""
    p = staging.stg_products(ctx)
    tr = F.broadcast(staging.stg_category_translation(ctx))
    return p.join(tr, "category_name_pt", "left").select(
        "product_id",
        "category_name_pt",
        F.coalesce(F.col("category_name_en"), F.col("category_name_pt"), F.lit("unknown")).alias("category_name_en"),
        "photos_qty",
        "weight_g",
    )


@model(table=True)
def counted_order_items(ctx: Ctx) -> DataFrame:
    """Items with their category and order, and the marks by which orders are counted in sums.

    The products come first: the shuffle by product then carries no column of the orders, and the rows lie by
    order when they are marked. ``first_of_order``: one of an order's items; ``first_of_group``: one of its items of each day, region and
    category (canceled and other items apart).
    """
    i = staging.stg_order_items(ctx).select("order_id", "order_item_id", "product_id", "seller_id", "price", "freight_value")
    o = fct_orders(ctx).select("order_id", "customer_unique_id", "state_code", "purchase_date", "is_canceled")
    p = product_category(ctx).select("product_id", "category_name_en")
    group = ["category_name_en", "purchase_date", "state_code"]
    of_order = Window.partitionBy("order_id", "is_canceled").orderBy(*group)
    first = F.row_number().over(of_order) == 1
    same = reduce(Column.__and__, [F.lag(c).over(of_order).eqNullSafe(F.col(c)) for c in group])
    return i.join(p, "product_id").join(o, "order_id").select(
        *ITEM_FACTS, first.alias("first_of_order"), (first | ~same).alias("first_of_group")
    )


@model
def fct_order_items(ctx: Ctx) -> DataFrame:
    return counted_order_items(ctx).select(*ITEM_FACTS)


@model
def fct_payments(ctx: Ctx) -> DataFrame:
    p = staging.stg_payments(ctx)
    o = fct_orders(ctx).select("order_id", "purchase_date")
    return p.join(o, "order_id").select(
        "order_id", "payment_sequential", "payment_type", "payment_installments", "payment_value", "purchase_date"
    )


@model
def fct_reviews(ctx: Ctx) -> DataFrame:
    r = staging.stg_reviews(ctx)
    o = fct_orders(ctx).select("order_id", "state_code")
    return r.join(o, "order_id").select("review_id", "order_id", "state_code", "review_score", "review_date", "created_at")


@model
def fct_marketing_daily(ctx: Ctx) -> DataFrame:
    m = staging.stg_marketing(ctx)
    return m.filter(F.col("marketing_date") <= F.lit(ctx.web_sim_date)).select(
        "marketing_date", "channel", "sessions", "ad_spend"
    )


@model
def dim_date(ctx: Ctx) -> DataFrame:
    """Generated calendar (one row per day of the configured range)."""
    days = ctx.spark.range(1).select(
        F.explode(
            F.sequence(F.lit(config.CALENDAR_START), F.lit(config.CALENDAR_END), F.expr("INTERVAL 1 DAY"))
        ).alias("date_day")
    )
    iso = F.dayofweek("date_day")  # 1 = Sunday
    iso_weekday = ((iso + 5) % 7 + 1).cast("int")
    return days.select(
        "date_day",
        iso_weekday.alias("iso_weekday"),
        F.date_format("date_day", "E").alias("weekday_name"),
        iso_weekday.isin(6, 7).alias("is_weekend"),
        F.to_date(F.date_trunc("week", "date_day")).alias("week_start"),
        F.trunc("date_day", "month").alias("month_start"),
        F.year("date_day").alias("year"),
        F.quarter("date_day").alias("quarter"),
        F.month("date_day").alias("month"),
    )


@model
def dim_customer(ctx: Ctx) -> DataFrame:
    """One row per real customer; state of the latest order (ties by order id)."""
    o = int_orders(ctx)
    latest = F.max(F.struct("purchased_at", "order_id", "customer_state"))
    return o.groupBy("customer_unique_id").agg(
        latest.alias("latest"),
        F.min("purchased_at").alias("first_order_at"),
        F.max("purchased_at").alias("last_order_at"),
        F.count(F.lit(1)).alias("orders_count"),
    ).select(
        "customer_unique_id",
        entity_id("customer", "customer_unique_id").alias("entity_id"),
        F.col("latest.customer_state").alias("state_code"),
        "first_order_at",
        "last_order_at",
        "orders_count",
    )


@model
def dim_product(ctx: Ctx) -> DataFrame:
    p = product_category(ctx)
    return p.select(
        "product_id",
        entity_id("product", "product_id").alias("entity_id"),
        "category_name_pt",
        "category_name_en",
        entity_id("category", "category_name_en").alias("category_entity_id"),
        "photos_qty",
        "weight_g",
    )


@model
def region_seed(ctx: Ctx) -> DataFrame:
    """Static state list with macro region (nation x region, bounded size -> broadcastable)."""
    n = ctx.tables.nation.select("n_name", "n_regionkey")
    r = ctx.tables.region.select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
    return n.join(F.broadcast(r), "n_regionkey", "left").select(
        F.upper(F.trim("n_name")).alias("state_code"),
        F.concat(F.upper(F.substring(F.lower("n_name"), 1, 1)), F.substring(F.lower("n_name"), 2, 1 << 30)).alias("state_name"),
        F.col("r_name").alias("macro_region"),
    )


@model
def dim_region(ctx: Ctx) -> DataFrame:
    """States with the centroid of the valid geo points (outliers outside the box dropped)."""
    g = staging.stg_geolocation(ctx)
    inside = F.col("lat").between(-34, 6) & F.col("lng").between(-74, -34)
    centroids = g.filter(inside).groupBy("state_code").agg(
        F.round(F.sum("lat").cast("double") / F.count("lat"), 4).alias("centroid_lat"),
        F.round(F.sum("lng").cast("double") / F.count("lng"), 4).alias("centroid_lng"),
    )
    return region_seed(ctx).join(centroids, "state_code", "left").select(
        "state_code",
        entity_id("region", "state_code").alias("entity_id"),
        "state_name",
        "macro_region",
        "centroid_lat",
        "centroid_lng",
    )


@model
def dim_seller(ctx: Ctx) -> DataFrame:
    s = staging.stg_sellers(ctx)
    return s.select("seller_id", entity_id("seller", "seller_id").alias("entity_id"), "city", "state_code")


@model
def category_month_actuals(ctx: Ctx) -> DataFrame:
    """GMV of non-canceled items per month and category."""
    i = fct_order_items(ctx).filter(~F.col("is_canceled"))
    return i.groupBy(F.trunc("purchase_date", "month").alias("month_start"), "category_name_en").agg(
        F.sum("price").alias("actual_gmv")
    )


@model
def stg_budgets(ctx: Ctx) -> DataFrame:
    """Controlling plan: each month's budget per category is the previous month's actual GMV
    rounded to a multiple of 100 (floor 100). The whole plan is visible at any as-of date."""
    a = category_month_actuals(ctx)
    return a.select(
        F.add_months("month_start", 1).alias("budget_month"),
        "category_name_en",
        budget_round(F.col("actual_gmv")).cast("decimal(14,2)").alias("budget_brl"),
    )


@model
def budget_vs_actual(ctx: Ctx) -> DataFrame:
    b = stg_budgets(ctx).filter(F.col("budget_month") <= F.lit(ctx.sim_date))
    a = category_month_actuals(ctx).withColumnRenamed("month_start", "budget_month")
    actual = F.coalesce(F.col("actual_gmv"), F.lit(0).cast("decimal(22,2)"))
    return b.join(a, ["budget_month", "category_name_en"], "left").select(
        F.col("budget_month").alias("month_start"),
        "category_name_en",
        entity_id("category", "category_name_en").alias("entity_id"),
        "budget_brl",
        actual.alias("actual_gmv"),
        (actual - F.col("budget_brl")).alias("deviation_abs"),
        safe_ratio(actual - F.col("budget_brl"), F.col("budget_brl")).alias("deviation_rate"),
        (F.last_day("budget_month") <= F.lit(ctx.sim_date)).alias("is_complete"),
    )
