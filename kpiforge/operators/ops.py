"""Operational tables derived from the data: load log and watermarks, LLM usage with cost,
pipeline status, and the deterministic parts of the demand/marketing generators."""

from __future__ import annotations

import math
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kpiforge.context import Ctx, model
from kpiforge.operators import kpi, marts
from kpiforge.sources import landing

# Web-domain KPIs live in another period; freshness is judged on the order domain.
WEB_KPIS = ["conversion_rate", "roas"]

# Prices in EUR per million tokens (input, output) per model.
MODEL_PRICES = {"mistral-small-latest": (0.1, 0.3), "mistral-large-latest": (2.0, 6.0)}

# Channel shares of the sessions and cost per session (None = fixed daily cost).
CHANNEL_SPLIT = [("organic", 0.40, 0.0), ("paid_search", 0.30, 0.85), ("paid_social", 0.18, 0.55), ("email", 0.12, None)]
EMAIL_DAILY_COST = 60.0
BASE_CONVERSION_RATE = 0.022


@model
def load_log(ctx: Ctx) -> DataFrame:
    """One load per entity and month (the incremental extracts of a monthly run):
    rows loaded, watermark window, status and times. Derived from the extracts themselves."""
    def monthly(entity: str, source: str, df: DataFrame, ts: str) -> DataFrame:
        return df.groupBy(F.trunc(F.to_date(ts), "month").alias("month")).agg(
            F.count(F.lit(1)).alias("rows_loaded"), F.max(ts).alias("watermark_to")
        ).select(F.lit(source).alias("source"), F.lit(entity).alias("entity"), "*")

    parts = [
        monthly("orders", "erp", landing.erp_orders(ctx), "_wm"),
        monthly("order_items", "erp", landing.erp_order_items(ctx), "_wm"),
        monthly("payments", "erp", landing.erp_payments(ctx), "_wm"),
        monthly("reviews", "legacy", landing.legacy_reviews(ctx).withColumn(
            "_wm", F.to_timestamp_ntz("review_creation_date")), "_wm"),
        monthly("marketing_daily", "marketing", landing.marketing_daily(ctx).withColumn(
            "_wm", F.to_timestamp_ntz(F.col("date").cast("string"))), "_wm"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    run_day = F.last_day("month")
    started = F.to_timestamp_ntz(F.concat(F.date_add(run_day, 1).cast("string"), F.lit(" 02:00:00")))
    return out.select(
        F.concat_ws(":", "source", "entity", F.date_format("month", "yyyy-MM")).alias("load_id"),
        "source",
        "entity",
        F.lit("incremental").alias("mode"),
        run_day.alias("sim_date"),
        "watermark_to",
        "rows_loaded",
        F.lit("success").alias("status"),
        F.lit(None).cast("string").alias("error"),
        started.alias("started_at"),
        (started + F.expr("INTERVAL 5 MINUTES")).alias("finished_at"),
    )


def watermark_lookup(log: DataFrame) -> DataFrame:
    """Newest successful non-NULL watermark per (source, entity), all entities in one pass."""
    ok = log.filter((F.col("status") == "success") & F.col("watermark_to").isNotNull())
    return ok.groupBy("source", "entity").agg(F.max_by("watermark_to", "finished_at").alias("watermark"))


def watermark_advance(previous: DataFrame, extracted: DataFrame, ts: str = "_wm") -> DataFrame:
    """New watermark = max timestamp of the extracted rows, or the previous one if empty.
    ``previous``: (source, entity, watermark); ``extracted``: rows with source, entity, ts."""
    new = extracted.groupBy("source", "entity").agg(F.max(ts).alias("new_wm"))
    return previous.join(new, ["source", "entity"], "full_outer").select(
        "source", "entity", F.coalesce("new_wm", "watermark").alias("watermark")
    )


@model
def llm_usage(ctx: Ctx) -> DataFrame:
    """One LLM call per assistant turn of the conversations; tokens estimated from
    the text (4 characters per token, prompt = 3 x answer), cost from the price table."""
    c = ctx.tables.conversations.filter(F.col("role") == "assistant")
    model = F.when(F.col("turn") <= 2, F.lit("mistral-small-latest")).otherwise(F.lit("mistral-large-latest"))
    out_tokens = F.ceil(F.length("text") / F.lit(4)).cast("bigint")
    price_in = F.when(model == "mistral-small-latest", F.lit(MODEL_PRICES["mistral-small-latest"][0])).otherwise(
        F.lit(MODEL_PRICES["mistral-large-latest"][0])
    ).cast("decimal(10,4)")
    price_out = F.when(model == "mistral-small-latest", F.lit(MODEL_PRICES["mistral-small-latest"][1])).otherwise(
        F.lit(MODEL_PRICES["mistral-large-latest"][1])
    ).cast("decimal(10,4)")
    day = F.date_add(F.lit(date(2024, 1, 1)), (F.col("conv_id") % 30).cast("int"))
    base = c.select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("usage_id"),
        F.lit("chat").alias("purpose"),
        F.lit("mistral").alias("provider"),
        model.alias("model"),
        day.alias("sim_date"),
        (out_tokens * 3).alias("tokens_in"),
        out_tokens.alias("tokens_out"),
        price_in.alias("p_in"),
        price_out.alias("p_out"),
        F.to_timestamp_ntz(F.concat(day.cast("string"), F.lit(" 07:00:00"))).alias("created_at"),
    )
    cost = ((F.col("tokens_in") * F.col("p_in") + F.col("tokens_out") * F.col("p_out")) / F.lit(1000000)).cast(
        "decimal(18,10)"
    )
    return base.select("usage_id", "purpose", "provider", "model", "sim_date", "tokens_in", "tokens_out", cost.alias("cost_eur"), "created_at")


def usage_daily(usage: DataFrame, since: date | None = None) -> DataFrame:
    """Calls, tokens and cost per day, purpose, provider and model."""
    u = usage if since is None else usage.filter(F.col("created_at") >= F.lit(since))
    return u.groupBy(F.to_date("created_at").alias("day"), "purpose", "provider", "model").agg(
        F.count(F.lit(1)).alias("calls"),
        F.sum("tokens_in").alias("tokens_in"),
        F.sum("tokens_out").alias("tokens_out"),
        F.sum("cost_eur").alias("cost_eur"),
    )


def usage_totals(daily: DataFrame) -> DataFrame:
    """Total cost (rounded to 6) and total tokens."""
    return daily.agg(
        F.round(F.sum("cost_eur"), 6).alias("total_cost_eur"),
        F.sum(F.col("tokens_in") + F.col("tokens_out")).alias("total_tokens"),
    )


@model
def pipeline_status(ctx: Ctx) -> DataFrame:
    """One row: as-of date, newest KPI date, last loads, health."""
    kpis = kpi.kpi_daily(ctx).filter(~F.col("kpi_key").isin(WEB_KPIS)).select(
        F.col("kpi_date"), F.lit(None).cast("timestamp_ntz").alias("finished_at"), F.lit(None).cast("string").alias("status")
    )
    loads = load_log(ctx).select(F.lit(None).cast("date").alias("kpi_date"), "finished_at", "status")
    both = kpis.unionByName(loads).agg(
        F.max("kpi_date").alias("latest_kpi_date"),
        F.max(F.when(F.col("status") == "success", F.col("finished_at"))).alias("last_successful_load_at"),
        F.max(F.when(F.col("status") == "failed", F.col("finished_at"))).alias("last_failed_load_at"),
    )
    return both.select(
        F.lit(ctx.sim_date).alias("sim_date"),
        "latest_kpi_date",
        "last_successful_load_at",
        "last_failed_load_at",
        F.when(F.col("latest_kpi_date").isNull(), F.lit("down"))
        .when(F.col("latest_kpi_date") == F.lit(ctx.sim_date), F.lit("ok"))
        .otherwise(F.lit("stale"))
        .alias("status"),
    )


@model
def orders_per_day(ctx: Ctx) -> DataFrame:
    """Orders per purchase day, missing days = 0 (spine from the first to the last day)."""
    o = marts.fct_orders(ctx)
    counts = o.groupBy(F.col("purchase_date").alias("day")).agg(F.count(F.lit(1)).alias("orders"))
    span = counts.agg(F.min("day").alias("a"), F.max("day").alias("b"))
    spine = span.select(F.explode(F.sequence("a", "b", F.expr("INTERVAL 1 DAY"))).alias("day"))
    return spine.join(counts, "day", "left").select("day", F.coalesce("orders", F.lit(0)).alias("orders"))


@model
def demand_blend(ctx: Ctx) -> DataFrame:
    """Centred 7-day mean of daily orders (edges: the days that exist), floored at
    1; demand = 0.6 x orders + 0.4 x smooth; expected sessions at the base conversion rate with
    a weekday sine factor. The moving mean is an explode to the 7 neighbouring days + group by,
    so the single calendar series never funnels into one window partition."""
    d = orders_per_day(ctx)
    spread = d.select(
        F.explode(F.sequence(F.date_sub("day", 3), F.date_add("day", 3), F.expr("INTERVAL 1 DAY"))).alias("target"),
        "orders",
    )
    smooth = spread.join(d.select(F.col("day").alias("target")), "target", "left_semi").groupBy("target").agg(
        (F.sum("orders") / F.count(F.lit(1))).alias("smooth")
    )
    j = d.join(smooth.withColumnRenamed("target", "day"), "day")
    weekday = (F.dayofweek("day") + 5) % 7  # Monday = 0
    factor = F.lit(1.0) + F.lit(0.08) * F.sin(F.lit(2 * math.pi) * weekday / F.lit(7.0))
    smooth_c = F.greatest(F.col("smooth"), F.lit(1.0))
    demand = F.lit(0.6) * F.col("orders") + F.lit(0.4) * smooth_c
    return j.select(
        "day",
        "orders",
        F.round(smooth_c, 6).alias("smooth"),
        F.round(demand, 6).alias("demand"),
        F.round(factor, 6).alias("weekday_factor"),
        F.round(demand / (F.lit(BASE_CONVERSION_RATE) * factor), 3).alias("expected_sessions"),
    )


@model
def channel_split(ctx: Ctx) -> DataFrame:
    """Expected sessions split over the channels by fixed shares; spend = sessions x cost
    per session, or the fixed daily cost (channels unrolled with stack, no cross join)."""
    d = demand_blend(ctx)
    parts = ", ".join(f"'{n}', CAST({s} AS DOUBLE), CAST({'NULL' if c is None else c} AS DOUBLE)" for n, s, c in CHANNEL_SPLIT)
    long = d.selectExpr("day", "expected_sessions", f"stack({len(CHANNEL_SPLIT)}, {parts}) as (channel, share, cps)")
    sessions = F.round(F.col("expected_sessions") * F.col("share"), 0).cast("bigint")
    spend = F.when(F.col("cps").isNull(), F.lit(EMAIL_DAILY_COST)).otherwise(F.round(sessions * F.col("cps"), 2))
    return long.select("day", "channel", sessions.alias("sessions"), spend.alias("ad_spend"))
