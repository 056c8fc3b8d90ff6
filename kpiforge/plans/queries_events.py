"""Registered queries: daily findings through the event chain, context entries, evidence, JSON payloads.

The daily findings here come from the core scores (``anomaly.detect_core``), which SQL can check; the
operators behind them are those that the STL findings pass through.
"""

from __future__ import annotations

import re
from datetime import date, datetime, time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kpiforge import config
from kpiforge.context import Ctx, model
from kpiforge.functions import payload
from kpiforge.operators import analyst, anomaly, kpi, outbox
from kpiforge.plans.catalog import register
from kpiforge.plans.oracle_ctes import CTES, WEB_SIM_NEXT, _CHANNELS, cte, with_ctes
from kpiforge.plans.queries_context import ALLOWED_SQL, _signed_sql
from kpiforge.plans.queries_more import _SCOPE, _enqueue_sql, _fmt_sql
from kpiforge.sources import landing

#: Findings up to here are in the outbox already; the rest comes with this run.
SEEN_UNTIL = date(1998, 6, 30)
NOW = datetime.combine(config.SIM_DATE, time(6, 0))
_COLS = "event_id, event_type, dedup_key, type, kpi, period_start, period_end, severity, data_class, summary, created_at"

cte("detect_core", ["robust_score_core", "registry"], f"""
    SELECT *, CASE WHEN observed >= expected THEN 'up' ELSE 'down' END AS direction,
           CASE WHEN expected <> 0 THEN round((observed - expected) / abs(expected) * 100, 2) END AS deviation_pct
    FROM (
      SELECT 'anomaly' AS type, kpi_key, dimension, dimension_value,
             CASE dimension WHEN 'region' THEN 'region:' || dimension_value WHEN 'category' THEN 'category:' || dimension_value
                            ELSE 'kpi:' || kpi_key END AS entity_id,
             eval_day AS period_start, eval_day AS period_end, 'day' AS grain,
             CASE WHEN abs(score) >= bound * {config.CRITICAL_FACTOR} THEN 'critical' ELSE 'warning' END AS severity,
             observed, CASE WHEN unit = 'ratio' THEN least(greatest(expected, 0.0), 1.0) ELSE expected END AS expected,
             round(score, 3) AS score, 'median_mad' AS method, CAST(NULL AS DOUBLE) AS evidence_threshold, label, unit, data_class
      FROM (SELECT c.*, r.label, r.unit, r.data_class,
                   r.alert_threshold * CASE WHEN dimension = 'total' THEN 1.0 ELSE {config.MEMBER_THRESHOLD_FACTOR} END AS bound
            FROM robust_score_core c JOIN registry r ON r.key = c.kpi_key) s
      WHERE abs(score) >= bound) d""")
_ID = "substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12)"
cte("core_insight_rows", ["detect_core", "insight_rows"], f"""
    SELECT {_COLS} FROM insight_rows
    UNION ALL
    SELECT {_ID} AS event_id, 'insight' AS event_type, dedup_key, type, kpi_key AS kpi, period_start, period_end, severity, data_class,
           label || {_SCOPE} || ' am ' || strftime(period_start, '%d.%m.%Y') || ': ' || {_fmt_sql('observed', 'unit')}
             || ' statt erwartet ' || {_fmt_sql('expected', 'unit')} || ' (' || {_signed_sql('deviation_pct')} || ').' AS summary,
           CAST(CAST(period_end + 1 AS DATE) AS TIMESTAMP) + INTERVAL 6 HOUR AS created_at
    FROM (SELECT *, sha256(dedup_key) AS h FROM (
      SELECT *, type || ':' || kpi_key || ':' ||
               CASE WHEN dimension = 'total' THEN 'kpi:' || kpi_key
                    ELSE array_to_string(list_sort([entity_id, 'kpi:' || kpi_key]), ',') END
               || ':' || grain || ':' || CAST(period_start AS VARCHAR) || ':' || CAST(period_end AS VARCHAR) AS dedup_key
      FROM detect_core) a) b""")
cte("core_outbox_prev", ["core_insight_rows"], f"SELECT * FROM core_insight_rows WHERE period_end <= DATE '{SEEN_UNTIL}'")
_OWN = r"\b(insight_rows|outbox_prev)\b"  # the SQL of the monthly chain over the findings of this module
cte("core_outbox_new", ["core_insight_rows", "core_outbox_prev"], re.sub(_OWN, r"core_\1", CTES["outbox_new"][1]))
_DELIVERY = CTES["deliveries_prev"][1].split(" FROM (")[0]
cte("core_deliveries_prev", ["core_outbox_prev"], f"{_DELIVERY} FROM ({_enqueue_sql('core_outbox_prev')}) e")
cte("core_deliveries_new", ["core_insight_rows", "core_deliveries_prev"], f"""
    {_DELIVERY} FROM ({_enqueue_sql('core_insight_rows')}) e
    WHERE NOT EXISTS (SELECT 1 FROM core_deliveries_prev d WHERE d.event_id = e.event_id AND d.consumer = e.consumer)""")


@model
def core_findings(ctx: Ctx) -> DataFrame:
    return outbox.insight_rows(anomaly.detect_core(ctx).unionByName(anomaly.detect_monthly(ctx)))


def _seen(ctx: Ctx) -> DataFrame:
    return core_findings(ctx).where(F.col("period_end") <= F.lit(SEEN_UNTIL))


@register("daily_findings", with_ctes("SELECT * FROM detect_core", "detect_core"))
def daily_findings(ctx: Ctx) -> DataFrame:
    """Daily anomalies by the core scores with severity, clamped expectation, direction and deviation."""
    return anomaly.detect_core(ctx)


@register("finding_rows", with_ctes(f"SELECT {_COLS} FROM core_insight_rows", "core_insight_rows"))
def finding_rows(ctx: Ctx) -> DataFrame:
    """Outbox rows of the daily and monthly findings with ids, dedup keys and summaries of both grains."""
    return core_findings(ctx).select(*_COLS.split(", "))


@register("finding_insert_new", with_ctes(f"SELECT {_COLS} FROM core_outbox_new", "core_outbox_new"))
def finding_insert_new(ctx: Ctx) -> DataFrame:
    """The findings that an outbox with those of the first years does not hold yet."""
    return outbox.insert_new(core_findings(ctx), _seen(ctx)).select(*_COLS.split(", "))


@register("finding_enqueue", with_ctes("SELECT * FROM core_deliveries_new", "core_deliveries_new"))
def finding_enqueue(ctx: Ctx) -> DataFrame:
    """A delivery per new finding and consumer, pending or skipped."""
    empty = ctx.spark.createDataFrame([], "event_id string, consumer string")
    before = outbox.enqueue(_seen(ctx), empty, config.SIM_DATE, NOW)
    return outbox.enqueue(core_findings(ctx), before, config.SIM_DATE, NOW)


cte("recent_by_day", ["core_insight_rows"], f"""
    SELECT * FROM (
      SELECT *, row_number() OVER (PARTITION BY as_of ORDER BY CASE severity WHEN 'critical' THEN 0 ELSE 1 END, created_at, event_id) AS place
      FROM (SELECT period_end AS as_of, * FROM core_insight_rows UNION ALL SELECT CAST(period_end + 1 AS DATE), * FROM core_insight_rows) b
      WHERE type = 'anomaly' AND data_class IN {ALLOWED_SQL}) r
    WHERE place <= {analyst.MAX_ANOMALIES}""")


@register("recent_anomalies_by_day", with_ctes(
    "SELECT as_of, CAST(place AS INTEGER) AS place, 'insight:' || event_id AS id, severity, summary, data_class FROM recent_by_day", "recent_by_day"))
def recent_anomalies_by_day(ctx: Ctx) -> DataFrame:
    """For every as-of day the anomalies of its last two days, daily and monthly ones (top 20)."""
    return analyst.recent_anomalies(core_findings(ctx))


_NULL = "CAST(NULL AS VARCHAR)"
cte("context_entries", ["week_change", "top_drivers", "monthly_entries", "recent_by_day", "daily_registry"], f"""
    SELECT w.as_of, 'kpi' AS section, 0 AS place, w.id, {_NULL} AS parent, w.label, r.direction, r.data_origin, last_7_days_text AS current,
           previous_7_days_text AS previous, change_text AS change, {_NULL} AS severity, w.data_class
    FROM week_change w JOIN daily_registry r USING (kpi_key)
    UNION ALL
    SELECT d.as_of, 'driver', d.driver_rank, d.id, 'kpi:' || d.kpi_key, NULL, NULL, NULL, {_fmt_sql('d.last_7_days', 'unit')},
           {_fmt_sql('d.previous_7_days', 'unit')}, {_signed_sql('d.change_pct')}, NULL, NULL
    FROM top_drivers d JOIN daily_registry r USING (kpi_key) JOIN (SELECT DISTINCT kpi_key, as_of FROM week_change) w USING (kpi_key, as_of)
    UNION ALL
    SELECT d.as_of, 'month', 0, m.id, NULL, m.label, NULL, m.data_origin, m.value_text, m.month, NULL, NULL, m.data_class
    FROM (SELECT DISTINCT as_of FROM week_change) d JOIN monthly_entries m
      ON m.month_start = CASE WHEN last_day(as_of) = as_of THEN date_trunc('month', as_of) ELSE date_trunc('month', as_of) - INTERVAL 1 MONTH END
    UNION ALL
    SELECT as_of, 'anomaly', place, 'insight:' || event_id, NULL, summary, NULL, NULL, NULL, NULL, NULL, severity, data_class
    FROM recent_by_day WHERE as_of IN (SELECT as_of FROM week_change)""")


@register("context_entries", with_ctes("SELECT * REPLACE (CAST(place AS INTEGER) AS place) FROM context_entries", "context_entries"))
def context_entries(ctx: Ctx) -> DataFrame:
    """Every entry of every as-of day's context: KPIs with direction and data origin, drivers, months, anomalies."""
    return analyst.context_entries(ctx, core_findings(ctx))


def _cited(ctx: Ctx) -> DataFrame:
    """The entity references of each finding, cited on the day on which it ends."""
    refs = F.from_json(F.get_json_object("payload", "$.entity_refs"), "array<struct<type:string,id:string>>")
    return core_findings(ctx).select(
        F.col("period_end").alias("as_of"), F.col("event_id").alias("finding"), F.explode(refs).alias("r")
    ).select("as_of", "finding", F.col("r.id").alias("ref"))


@register("unsupported_evidence", with_ctes(
    """SELECT c.as_of, c.finding, c.ref FROM (
         SELECT period_end AS as_of, event_id AS finding,
                unnest(string_split(regexp_extract(dedup_key, '^[a-z_]+:[a-z0-9_]+:(.*):(day|month):[^:]*:[^:]*$', 1), ',')) AS ref
         FROM core_insight_rows) c
       WHERE NOT EXISTS (SELECT 1 FROM context_entries e WHERE e.as_of = c.as_of AND e.id = c.ref)""",
    "core_insight_rows", "context_entries"))
def unsupported_evidence(ctx: Ctx) -> DataFrame:
    """Entity references of findings that the context of the finding's day does not hold."""
    return analyst.unsupported_evidence(_cited(ctx), analyst.context_entries(ctx, core_findings(ctx)))


_PROPS = """'{"client":' || user_id || ',"info":{"props":' || replace(props, ' ', '') || ',"type":"' || event_type || '"}}'"""


@register("canonical_payloads", f"SELECT event_id, {_PROPS} AS whole, replace({_PROPS}, '\"client\":' || user_id || ',', '') AS public FROM events")
def canonical_payloads(ctx: Ctx) -> DataFrame:
    """event payloads in canonical key order at every level, and without the client and an internal note."""
    info = F.struct(F.col("event_type").alias("type"), F.parse_json("props").alias("props"))
    note = F.struct(F.col("event_type").alias("type"), F.col("value").alias("internal"), F.parse_json("props").alias("props"))
    raw = ctx.tables.events.select(
        "event_id", F.to_json(F.struct(info.alias("info"), F.col("user_id").alias("client"))).alias("p"),
        F.to_json(F.struct(note.alias("info"), F.col("user_id").alias("client"))).alias("q"),
    )
    public = payload.remove_path(payload.remove_path(F.col("q"), ["info", "internal"]), ["client"])
    return raw.select("event_id", payload.canonical(F.col("p")).alias("whole"), public.alias("public"))


def _frames(ctx: Ctx) -> dict[str, DataFrame]:
    """Sessions, orders and revenue per day, for the total and per channel, each from its own rows."""
    e = ctx.tables.events.where(F.col("ts") < F.lit(landing.day_after_ts(ctx.web_sim_date))).select(
        F.to_date("ts").alias("kpi_date"), landing.channel_of(F.col("user_id")).alias("channel"), "event_type", "value"
    )
    money = F.col("value").cast("decimal(12,2)")

    def frame(rows: DataFrame, **measures) -> DataFrame:
        return kpi.grouped_by_dimension(rows, "kpi_date", [("channel", "channel")], measures)

    clicks = e.where("event_type IN ('view', 'click')")
    spend = F.sum(F.when(F.col("event_type") == "click", money).otherwise(F.lit(0).cast("decimal(12,2)")))
    return {
        "marketing": frame(clicks, sessions=F.count(F.lit(1)), ad_spend=spend),
        "orders": frame(e.where("event_type = 'purchase'"), web_orders=F.count(F.lit(1))),
        # large purchases alone, so that days and channels without any are in the other frames only
        "items": frame(e.where("event_type = 'purchase' AND value >= 95"), web_revenue=F.sum(money)),
    }


cte("web_rows", [], f"""
    SELECT CAST(ts AS DATE) AS kpi_date, {_CHANNELS}[CAST(user_id % {len(config.MARKETING_CHANNELS)} + 1 AS INTEGER)] AS channel, event_type,
           CAST(value AS DECIMAL(12,2)) AS money, value FROM events WHERE ts < TIMESTAMP '{WEB_SIM_NEXT}'""")
_KEYS = "kpi_date, CASE WHEN grouping(channel) = 1 THEN 'total' ELSE 'channel' END AS dimension, CASE WHEN grouping(channel) = 1 THEN 'all' ELSE channel END AS dimension_value"
_SETS = "GROUP BY GROUPING SETS ((kpi_date), (kpi_date, channel))"


@register("web_frames", with_ctes(
    f"""SELECT kpi_date, dimension, dimension_value, sessions, CAST(ad_spend AS DOUBLE) AS ad_spend, web_orders, CAST(web_revenue AS DOUBLE) AS web_revenue,
               m.kpi_date IS NOT NULL AS in_marketing, o.kpi_date IS NOT NULL AS in_orders, i.kpi_date IS NOT NULL AS in_items
        FROM (SELECT {_KEYS}, count(*) AS sessions, sum(CASE WHEN event_type = 'click' THEN money ELSE CAST(0 AS DECIMAL(12,2)) END) AS ad_spend
              FROM web_rows WHERE event_type IN ('view', 'click') {_SETS}) m
        FULL JOIN (SELECT {_KEYS}, count(*) AS web_orders FROM web_rows WHERE event_type = 'purchase' {_SETS}) o USING (kpi_date, dimension, dimension_value)
        FULL JOIN (SELECT {_KEYS}, sum(money) AS web_revenue FROM web_rows WHERE event_type = 'purchase' AND value >= 95 {_SETS}) i
          USING (kpi_date, dimension, dimension_value)""", "web_rows"))
def web_frames(ctx: Ctx) -> DataFrame:
    """Sessions, orders and revenue joined three ways on (date, dimension, member), days and members of one input kept."""
    return kpi.join_frames(_frames(ctx), ["kpi_date", "dimension", "dimension_value"])
