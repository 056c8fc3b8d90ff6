"""Registered queries: Structured Streaming (run with AvailableNow, result read back)."""

from __future__ import annotations

from pyspark.sql import DataFrame

from kpiforge.context import Ctx
from kpiforge.plans.catalog import register
from kpiforge.plans.oracle_ctes import SIM_NEXT
from kpiforge.streaming import streams


@register(
    "stream_incremental",
    f"""SELECT o_orderkey AS order_id, o_custkey AS customer_id, o_orderstatus AS order_status_code,
               o_orderdate AS order_purchase_timestamp, o_totalprice AS order_total
        FROM orders WHERE o_orderdate < TIMESTAMP '{SIM_NEXT}'""",
)
def stream_incremental(ctx: Ctx) -> DataFrame:
    """Restartable incremental load of the orders with a file stream."""
    return streams.stream_incremental_orders(ctx.spark, ctx.tables.sf_dir, ctx.sim_date)


@register(
    "stream_kpi_daily",
    """WITH d AS (
         SELECT CAST(ts AS DATE) AS kpi_date,
                count(*) FILTER (WHERE event_type IN ('view', 'click')) AS sessions,
                sum(CASE WHEN event_type = 'click' THEN CAST(value AS DECIMAL(12,2)) ELSE 0 END) AS ad_spend,
                count(*) FILTER (WHERE event_type = 'purchase') AS web_orders,
                sum(CASE WHEN event_type = 'purchase' THEN CAST(value AS DECIMAL(12,2)) ELSE 0 END) AS web_revenue
         FROM events GROUP BY 1)
       SELECT kpi_date, kpi_key, numerator, denominator, round(numerator / nullif(denominator, 0), 6) AS value FROM (
         SELECT kpi_date, 'conversion_rate' AS kpi_key, CAST(web_orders AS DOUBLE) AS numerator, CAST(sessions AS DOUBLE) AS denominator FROM d
         UNION ALL
         SELECT kpi_date, 'roas', CAST(web_revenue AS DOUBLE), CAST(ad_spend AS DOUBLE) FROM d) x""",
)
def stream_kpi_daily(ctx: Ctx) -> DataFrame:
    """Daily tumbling-window web KPIs (conversion rate, ROAS) from the event stream."""
    return streams.stream_kpi_daily(ctx.spark, ctx.tables.sf_dir)


@register(
    "stream_dedup",
    "SELECT CAST(ts AS DATE) AS day, event_type, count(DISTINCT event_id) AS events FROM events GROUP BY 1, 2",
)
def stream_dedup(ctx: Ctx) -> DataFrame:
    """Events without repeats of an id, counted per day and type."""
    return streams.stream_dedup(ctx.spark, ctx.tables.sf_dir)


@register(
    "stream_trailing_counts",
    """SELECT user_id, ws AS window_start, ws + INTERVAL 1 HOUR AS window_end, count(*) AS events
       FROM (SELECT user_id, ts, time_bucket(INTERVAL 5 MINUTE, ts) - to_minutes(CAST(k * 5 AS BIGINT)) AS ws
             FROM events, range(0, 12) r(k)) x
       WHERE ts >= ws AND ts < ws + INTERVAL 1 HOUR
       GROUP BY 1, 2, 3""",
)
def stream_trailing_counts(ctx: Ctx) -> DataFrame:
    """Per-client event counts in 1-hour windows sliding by 5 minutes."""
    return streams.stream_trailing_counts(ctx.spark, ctx.tables.sf_dir)
