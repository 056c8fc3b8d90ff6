"""Source extracts: the test tables re-expressed as the retail sources (ERP, legacy files,
marketing, controlling).

Each extract is a filtered Parquet read, so the incremental window reaches the scan as a pushed
filter. Child entities (items, payments) are cut by their parent order's timestamp, exactly like
an incremental load that follows the parent's watermark.
"""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kpiforge import config
from kpiforge.context import Ctx
from kpiforge.functions.columns import day_after_ts


def _ts(d: date) -> datetime:
    return datetime.combine(d, datetime.min.time())


def incremental_window(ts: Column, since: datetime | None, until: date | None) -> Column:
    """``since < ts < until + 1 day``; a NULL since is minus infinity, a NULL until unbounded."""
    cond = F.lit(True)
    if until is not None:
        cond = cond & (ts < F.lit(day_after_ts(until)))
    if since is not None:
        cond = cond & (ts > F.lit(since))
    return cond


def _status(code: Column) -> Column:
    expr = None
    for letter, status in config.ORDER_STATUS_MAP.items():
        expr = F.when(code == letter, F.lit(status)) if expr is None else expr.when(code == letter, F.lit(status))
    return expr.otherwise(F.lit("created"))


def erp_orders(
    ctx: Ctx, since: datetime | None = None, until: date | None = None, shipped_from: date | None = None
) -> DataFrame:
    """Orders with their final state and timestamps, incremental on the purchase timestamp.

    Carrier hand-over is the first and customer delivery the last ship date that is not before
    the purchase; the order table carries the final status only. One left join + one group by
    on the order key: the group by reuses the join's partitioning, so it adds no shuffle. Ship dates
    that count are not before a purchase after ``since``, so an incremental extract reads no older line items;
    with ``shipped_from``, the caller needs no order whose last item was shipped before that day.
    """
    until = ctx.sim_date if until is None else until
    o = ctx.tables.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate").filter(
        incremental_window(F.col("o_orderdate"), since, until)
    )
    li = ctx.tables.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_shipdate")
    if since is not None:
        li = li.filter(F.col("l_shipdate") > F.lit(since))
    if shipped_from is not None:
        li = li.filter(F.col("l_shipdate") >= F.lit(_ts(shipped_from)))
    valid_ship = F.when(F.col("l_shipdate") >= F.col("o_orderdate"), F.col("l_shipdate"))
    agg = (
        o.join(li, "o_orderkey", "left")
        .groupBy("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
        .agg(F.min(valid_ship).alias("first_ship"), F.max(valid_ship).alias("last_ship"))
    )
    status = _status(F.col("o_orderstatus"))
    return agg.select(
        F.col("o_orderkey").alias("order_id"),
        F.col("o_custkey").alias("customer_id"),
        status.alias("order_status"),
        F.col("o_orderdate").alias("order_purchase_timestamp"),
        F.col("o_orderdate").alias("order_approved_at"),
        F.when(status.isin("delivered", "shipped"), F.col("first_ship")).alias("order_delivered_carrier_date"),
        F.when(status == "delivered", F.col("last_ship")).alias("order_delivered_customer_date"),
        (F.col("o_orderdate") + F.expr(f"INTERVAL {config.PROMISE_DAYS} DAYS")).alias("order_estimated_delivery_date"),
        F.col("o_orderdate").alias("_wm"),
    )


def erp_order_items(ctx: Ctx, since: datetime | None = None, until: date | None = None) -> DataFrame:
    """Line items of the orders in the window (child scan through the parent's watermark)."""
    until = ctx.sim_date if until is None else until
    parents = ctx.tables.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate").filter(
        incremental_window(F.col("o_orderdate"), since, until)
    )
    li = ctx.tables.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice",
        "l_tax", "l_quantity", "l_discount", "l_returnflag", "l_linestatus",
    )
    return li.join(parents, "l_orderkey").select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("order_item_id"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_suppkey").alias("seller_id"),
        F.col("l_shipdate").alias("shipping_limit_date"),
        F.col("l_extendedprice").alias("price"),
        F.col("l_tax").alias("tax_rate"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_discount").alias("discount"),
        F.col("l_returnflag").alias("return_flag"),
        F.col("l_linestatus").alias("line_status"),
        F.col("o_orderdate").alias("_wm"),
    )


def erp_payments(ctx: Ctx, since: datetime | None = None, until: date | None = None) -> DataFrame:
    """One payment per order; type and installments follow the order priority digit."""
    until = ctx.sim_date if until is None else until
    o = ctx.tables.orders.select("o_orderkey", "o_orderdate", "o_orderpriority", "o_totalprice").filter(
        incremental_window(F.col("o_orderdate"), since, until)
    )
    digit = F.substring("o_orderpriority", 1, 1).cast("int")
    types = F.array(*[F.lit(x) for x in config.PAYMENT_TYPES])
    return o.select(
        F.col("o_orderkey").alias("order_id"),
        F.lit(1).alias("payment_sequential"),
        F.element_at(types, digit).alias("payment_type"),
        digit.alias("payment_installments"),
        F.col("o_totalprice").alias("payment_value"),
        F.col("o_orderdate").alias("_wm"),
    )


def erp_customers(ctx: Ctx) -> DataFrame:
    """Full scan of customer master data; the state is the customer's nation."""
    nation = F.broadcast(ctx.tables.nation.select(F.col("n_nationkey").alias("c_nationkey"), "n_name"))
    return (
        ctx.tables.customer.select("c_custkey", "c_nationkey", "c_mktsegment")
        .join(nation, "c_nationkey", "left")
        .select(
            F.col("c_custkey").alias("customer_id"),
            F.col("c_custkey").alias("customer_unique_id"),
            F.lpad((F.col("c_custkey") % 100000).cast("string"), 5, "0").alias("customer_zip_code_prefix"),
            F.lower(F.col("c_mktsegment")).alias("customer_city"),
            F.col("n_name").alias("customer_state"),
        )
    )


def erp_sellers(ctx: Ctx) -> DataFrame:
    nation = F.broadcast(ctx.tables.nation.select(F.col("n_nationkey").alias("s_nationkey"), "n_name"))
    return (
        ctx.tables.supplier.select("s_suppkey", "s_nationkey", "s_name")
        .join(nation, "s_nationkey", "left")
        .select(
            F.col("s_suppkey").alias("seller_id"),
            F.lpad((F.col("s_suppkey") % 100000).cast("string"), 5, "0").alias("seller_zip_code_prefix"),
            F.lower(F.col("s_name")).alias("seller_city"),
            F.col("n_name").alias("seller_state"),
        )
    )


def erp_products(ctx: Ctx) -> DataFrame:
    return ctx.tables.part.select(
        F.col("p_partkey").alias("product_id"),
        F.lower(F.col("p_type")).alias("product_category_name"),
        F.col("p_size").alias("product_photos_qty"),
        F.col("p_retailprice").alias("product_weight_g"),
    )


def category_translation(ctx: Ctx) -> DataFrame:
    """Translation lookup (fixed, a handful of rows)."""
    return ctx.spark.createDataFrame(
        config.CATEGORY_TRANSLATION, "product_category_name string, product_category_name_english string"
    )


def _first_shipped(since: str | None) -> date | None:
    """The earliest delivery whose review can be created after the text ``since``; None if that is no date."""
    try:
        return date.fromisoformat(since[:10]) - timedelta(days=config.REVIEW_DELAY_DAYS) if since else None
    except (ValueError, OverflowError):
        return None


def legacy_reviews(
    ctx: Ctx, since: str | None = None, until: date | None = None, orders: DataFrame | None = None
) -> DataFrame:
    """Review export of delivered orders, incremental by ISO *string* comparison like a file
    export (``since < created < until + 1 day`` as text). ``orders``: the landed orders, if
    already materialised (else extracted here)."""
    until = ctx.sim_date if until is None else until
    src = orders if orders is not None else erp_orders(ctx, None, until, _first_shipped(since))
    delivered = src.filter(
        F.col("order_delivered_customer_date").isNotNull()
    )
    created = F.date_format(
        F.to_date("order_delivered_customer_date") + F.lit(config.REVIEW_DELAY_DAYS), "yyyy-MM-dd HH:mm:ss"
    )
    out = delivered.select(
        F.col("order_id").alias("review_id"),
        F.col("order_id"),
        (F.lit(1) + F.col("order_id") % 5).cast("string").alias("review_score"),
        created.alias("review_creation_date"),
    )
    cond = F.col("review_creation_date") < F.lit((until + timedelta(days=1)).isoformat())
    if since is not None:
        cond = cond & (F.col("review_creation_date") > F.lit(since))
    return out.filter(cond)


def legacy_geolocation(ctx: Ctx) -> DataFrame:
    """One geo point per customer zip; a share of the points lies outside the valid box."""
    nation = F.broadcast(ctx.tables.nation.select(F.col("n_nationkey").alias("c_nationkey"), "n_name"))
    return (
        ctx.tables.customer.select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
        .join(nation, "c_nationkey", "left")
        .select(
            F.lpad((F.col("c_custkey") % 100000).cast("string"), 5, "0").alias("geolocation_zip_code_prefix"),
            (F.col("c_acctbal").cast("decimal(12,2)") / F.lit(250)).cast("decimal(12,6)").alias("geolocation_lat"),
            (F.lit(-74) + F.col("c_custkey") % 50).cast("decimal(12,6)").alias("geolocation_lng"),
            F.lower(F.col("c_mktsegment")).alias("geolocation_city"),
            F.lower(F.col("n_name")).alias("geolocation_state"),
        )
    )


def channel_of(user_id: Column) -> Column:
    channels = F.array(*[F.lit(c) for c in config.MARKETING_CHANNELS])
    return F.element_at(channels, (user_id % len(config.MARKETING_CHANNELS) + 1).cast("int"))


def marketing_daily(ctx: Ctx, date_from: date | None = None, date_to: date | None = None) -> DataFrame:
    """Daily sessions and ad spend per channel from the web events; window inclusive on both
    ends (an API extract ``from = since + 1 day``, ``to = until``)."""
    ev = ctx.tables.events.select("ts", "user_id", "event_type", "value")
    d = F.to_date("ts")
    if date_from is not None:
        ev = ev.filter(F.col("ts") >= F.lit(_ts(date_from)))
    if date_to is not None:
        ev = ev.filter(F.col("ts") < F.lit(day_after_ts(date_to)))
    is_session = F.col("event_type").isin("view", "click")
    spend = F.when(F.col("event_type") == "click", F.col("value").cast("decimal(12,2)")).otherwise(F.lit(0).cast("decimal(12,2)"))
    return ev.groupBy(d.alias("date"), channel_of(F.col("user_id")).alias("channel")).agg(
        F.count_if(is_session).alias("sessions"),
        F.sum(spend).cast("decimal(12,2)").alias("ad_spend"),
    )


def web_orders_daily(ctx: Ctx) -> DataFrame:
    """Web shop orders and revenue per day (purchase events), the numerators of conversion
    and ROAS, visible up to the web as-of date."""
    ev = ctx.tables.events.select("ts", "event_type", "value").filter(
        (F.col("event_type") == "purchase") & (F.col("ts") < F.lit(day_after_ts(ctx.web_sim_date)))
    )
    return ev.groupBy(F.to_date("ts").alias("kpi_date")).agg(
        F.count(F.lit(1)).alias("web_orders"),
        F.sum(F.col("value").cast("decimal(12,2)")).alias("web_revenue"),
    )
