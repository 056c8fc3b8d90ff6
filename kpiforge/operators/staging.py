"""Staging layer: dedup, casts, renames, as-of masking. Lazy DataFrame functions (views)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kpiforge import config
from kpiforge.context import Ctx, model
from kpiforge.functions.columns import as_of_visible, col_or_name
from kpiforge.sources import landing


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[tuple[str, str]]) -> DataFrame:
    """Keep one row per key: the first by ``order`` (the newest load first).

    ``row_number() = 1`` is planned with a partial WindowGroupLimit before the shuffle, so a
    key that repeats many times is reduced map-side and never lands whole in one task.
    ``order`` is a list of (column, "asc"|"desc") and must be a total order (ties broken by further columns) to be deterministic.
    """
    cols = [F.col(c).desc() if d == "desc" else F.col(c).asc() for c, d in order]
    w = Window.partitionBy(*keys).orderBy(*cols)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")


# Tie-break for repeated (order_id, order_item_id): all loaded together, so the newest load
# does not decide; the remaining columns give a total order.
ITEM_ORDER = [
    ("shipping_limit_date", "desc"),
    ("product_id", "desc"),
    ("seller_id", "desc"),
    ("price", "desc"),
    ("quantity", "desc"),
    ("discount", "desc"),
    ("tax_rate", "desc"),
    ("return_flag", "desc"),
    ("line_status", "desc"),
]


def newest(ctx: Ctx, name: str) -> DataFrame | None:
    """An entity's rows from the raw tables, if the context has any: typed, the newest load of each key."""
    if ctx.raw is None:
        return None
    from kpiforge.operators.rawstore import ENTITIES

    return ctx.raw.newest(ENTITIES[name])


def source_rows(ctx: Ctx, name: str, landed: Callable[[Ctx], DataFrame]) -> DataFrame:
    """The newest loaded rows, or what ``landed`` extracts directly."""
    rows = newest(ctx, name)
    return landed(ctx) if rows is None else rows


@model(table=True)
def raw_orders(ctx: Ctx) -> DataFrame:
    """The landed ERP orders up to the as-of date (raw layer, read by the staged orders and by
    the review export)."""
    return source_rows(ctx, "orders", landing.erp_orders)


@model
def stg_orders(ctx: Ctx) -> DataFrame:
    """Orders as of the simulation date: later timestamps masked, status rolled back."""
    raw = raw_orders(ctx)
    sim = ctx.sim_date
    masked = raw.select(
        "order_id",
        "customer_id",
        F.col("order_status").alias("final_status"),
        F.col("order_purchase_timestamp").alias("purchased_at"),
        as_of_visible("order_approved_at", sim).alias("approved_at"),
        as_of_visible("order_delivered_carrier_date", sim).alias("delivered_carrier_at"),
        as_of_visible("order_delivered_customer_date", sim).alias("delivered_customer_at"),
        F.col("order_estimated_delivery_date").alias("estimated_delivery_at"),
    )
    status = (
        F.when(
            (F.col("final_status") == "delivered") & F.col("delivered_customer_at").isNull(),
            F.when(F.col("delivered_carrier_at").isNotNull(), F.lit("shipped")).otherwise(F.lit("processing")),
        )
        .otherwise(F.col("final_status"))
    )
    return masked.select(
        "order_id",
        "customer_id",
        status.alias("order_status"),
        "purchased_at",
        F.to_date("purchased_at").alias("purchase_date"),
        "approved_at",
        "delivered_carrier_at",
        "delivered_customer_at",
        "estimated_delivery_at",
    )


def _one_per_item(ctx: Ctx) -> DataFrame:
    order = ITEM_ORDER[: [c for c, _ in ITEM_ORDER].index("tax_rate") + 1]
    keys = ["order_id", "order_item_id"]
    return latest_per_key(landing.erp_order_items(ctx).select(*keys, *[c for c, _ in order]), keys, order)


@model(table=True)
def stg_order_items(ctx: Ctx) -> DataFrame:
    """Typed line items, one per (order_id, order_item_id). Money in decimal: the freight is
    price x tax rounded to cents, never rounded in floating point.

    The last columns of the tie-break decide between rows that are equal in all columns kept here, so they are not shuffled."""
    raw = source_rows(ctx, "order_items", _one_per_item)
    price = F.col("price").cast("decimal(12,2)")
    freight = F.round(price * F.col("tax_rate").cast("decimal(4,2)"), 2).cast("decimal(12,2)")
    return raw.select(
        "order_id",
        F.col("order_item_id").cast("int").alias("order_item_id"),
        "product_id",
        "seller_id",
        F.col("shipping_limit_date").alias("shipping_limit_at"),
        price.alias("price"),
        freight.alias("freight_value"),
    )


@model
def stg_payments(ctx: Ctx) -> DataFrame:
    raw = source_rows(ctx, "payments", landing.erp_payments)
    return raw.select(
        "order_id",
        F.col("payment_sequential").cast("int").alias("payment_sequential"),
        "payment_type",
        F.col("payment_installments").cast("int").alias("payment_installments"),
        F.col("payment_value").cast("decimal(12,2)").alias("payment_value"),
    )


@model
def stg_customers(ctx: Ctx) -> DataFrame:
    return source_rows(ctx, "customers", landing.erp_customers).select(
        "customer_id",
        "customer_unique_id",
        F.col("customer_zip_code_prefix").alias("zip_code_prefix"),
        F.col("customer_city").alias("city"),
        F.upper(F.trim(F.col("customer_state"))).alias("state_code"),
    )


@model
def stg_sellers(ctx: Ctx) -> DataFrame:
    return source_rows(ctx, "sellers", landing.erp_sellers).select(
        "seller_id",
        F.col("seller_zip_code_prefix").alias("zip_code_prefix"),
        F.col("seller_city").alias("city"),
        F.upper(F.trim(F.col("seller_state"))).alias("state_code"),
    )


@model
def stg_products(ctx: Ctx) -> DataFrame:
    return source_rows(ctx, "products", landing.erp_products).select(
        "product_id",
        F.col("product_category_name").alias("category_name_pt"),
        F.col("product_photos_qty").cast("int").alias("photos_qty"),
        F.col("product_weight_g").cast("decimal(12,2)").alias("weight_g"),
    )


@model
def stg_category_translation(ctx: Ctx) -> DataFrame:
    return (
        landing.category_translation(ctx)
        .select(
            F.col("product_category_name").alias("category_name_pt"),
            F.col("product_category_name_english").alias("category_name_en"),
        )
        .distinct()
    )


@model
def stg_reviews(ctx: Ctx) -> DataFrame:
    raw = source_rows(ctx, "reviews", lambda c: landing.legacy_reviews(c, orders=raw_orders(c)))
    return raw.select(
        "review_id",
        "order_id",
        F.col("review_score").cast("int").alias("review_score"),
        F.to_timestamp_ntz(F.col("review_creation_date")).alias("created_at"),
        F.to_date(F.col("review_creation_date")).alias("review_date"),
    )


@model
def stg_geolocation(ctx: Ctx) -> DataFrame:
    return landing.legacy_geolocation(ctx).select(
        F.col("geolocation_zip_code_prefix").alias("zip_code_prefix"),
        F.col("geolocation_lat").alias("lat"),
        F.col("geolocation_lng").alias("lng"),
        F.col("geolocation_city").alias("city"),
        F.upper(F.trim(F.col("geolocation_state"))).alias("state_code"),
    )


@model
def stg_marketing(ctx: Ctx) -> DataFrame:
    return source_rows(ctx, "daily", landing.marketing_daily).select(
        F.col("date").alias("marketing_date"),
        "channel",
        F.col("sessions").cast("int").alias("sessions"),
        F.col("ad_spend").cast("decimal(12,2)").alias("ad_spend"),
    )


def canceled(status: Column) -> Column:
    return status.isin(*config.CANCELED_STATUSES)
