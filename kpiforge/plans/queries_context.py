"""Registered queries: analyst context, markers, links, control-table checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kpiforge.context import Ctx
from kpiforge.functions.payload import remove_path
from kpiforge.operators import analyst, anomaly, kpi, ops, outbox
from kpiforge.plans import queries_more
from kpiforge.plans.catalog import register
from kpiforge.plans.oracle_ctes import SIM, cte, with_ctes
from kpiforge.plans.queries_more import _fmt_sql

W = analyst.WINDOW
ALLOWED_SQL = "('public', 'internal')"


def _pct_sql(c: str, p: str) -> str:
    return f"CASE WHEN {c} IS NOT NULL AND {p} IS NOT NULL AND {p} <> 0 THEN round(({c} - {p}) / abs({p}) * 100, 1) + 0.0 END"


def _signed_sql(x: str) -> str:
    de = f"translate(format('{{:,.1f}}', CAST(round(CAST(abs({x}) AS DECIMAL(38,6)), 1) AS DOUBLE)), ',.', '.,')"
    return f"CASE WHEN {x} IS NULL THEN '–' ELSE (CASE WHEN {x} > 0 THEN '+' WHEN {x} < 0 THEN '−' ELSE '±' END) || {de} || ' %' END"


def _val_sql(n: str, d: str, c: str) -> str:
    return f"CASE WHEN {c} > 0 THEN CASE WHEN additive THEN CAST({n} AS DOUBLE) ELSE CAST({n} AS DOUBLE) / nullif(CAST({d} AS DOUBLE), 0) END END"


cte("daily_registry", ["registry"], f"""
    SELECT key AS kpi_key, label, unit, direction, data_origin, data_class, entity_type FROM registry
    WHERE grain = 'day' AND data_class IN {ALLOWED_SQL}""")

cte("week_change", ["kpi_daily", "daily_registry"], f"""
    SELECT kpi_key, as_of, last_7_days, previous_7_days, change_pct, 'kpi:' || kpi_key AS id,
           {_fmt_sql('last_7_days', 'unit')} AS last_7_days_text,
           {_fmt_sql('previous_7_days', 'unit')} AS previous_7_days_text,
           {_signed_sql('change_pct')} AS change_text, label, data_class
    FROM (
      SELECT *, {_pct_sql('last_7_days', 'previous_7_days')} AS change_pct FROM (
        SELECT kpi_key, label, unit, data_class, kpi_date AS as_of,
               {_val_sql('sum(numerator) OVER c', 'sum(denominator) OVER c', 'count(*) OVER c')} AS last_7_days,
               {_val_sql('sum(numerator) OVER p', 'sum(denominator) OVER p', 'count(*) OVER p')} AS previous_7_days
        FROM (SELECT d.*, r.label, r.unit, r.data_class, d.aggregation = 'sum' AS additive,
                     date_diff('day', DATE '1970-01-01', d.kpi_date) AS dn
              FROM kpi_daily d JOIN daily_registry r USING (kpi_key) WHERE d.dimension = 'total') x
        WINDOW c AS (PARTITION BY kpi_key ORDER BY dn RANGE BETWEEN {W - 1} PRECEDING AND CURRENT ROW),
               p AS (PARTITION BY kpi_key ORDER BY dn RANGE BETWEEN {2 * W - 1} PRECEDING AND {W} PRECEDING)) y) z""")

cte("top_drivers", ["kpi_daily", "daily_registry"], f"""
    SELECT kpi_key, as_of, driver_rank, dimension || ':' || dimension_value AS id,
           round(cur, 6) AS last_7_days, round(prev, 6) AS previous_7_days, change_pct
    FROM (
      SELECT *, row_number() OVER (PARTITION BY kpi_key, dimension, as_of
                 ORDER BY CASE WHEN additive THEN abs(cur - prev) ELSE abs(change_pct) END DESC, dimension_value) AS driver_rank
      FROM (
        SELECT *, {_pct_sql('cur', 'prev')} AS change_pct FROM (
          SELECT *, row_number() OVER (PARTITION BY kpi_key, dimension, as_of ORDER BY volume DESC, dimension_value) AS vol_rank
          FROM (
            SELECT kpi_key, dimension, dimension_value, kpi_date AS as_of, additive,
                   {_val_sql('sum(numerator) OVER c', 'sum(denominator) OVER c', 'count(numerator) OVER c')} AS cur,
                   {_val_sql('sum(numerator) OVER p', 'sum(denominator) OVER p', 'count(numerator) OVER p')} AS prev,
                   CAST(coalesce(sum(denominator) OVER c, sum(numerator) OVER c, 0) AS DOUBLE) AS volume
            FROM (
              SELECT s.kpi_key, s.dimension, s.dimension_value, s.kpi_date, m.numerator, m.denominator, a.additive
              FROM (SELECT kpi_key, dimension, dimension_value,
                           CAST(unnest(generate_series(min(kpi_date), DATE '{SIM}', INTERVAL 1 DAY)) AS DATE) AS kpi_date
                    FROM kpi_daily d JOIN daily_registry r USING (kpi_key) WHERE d.dimension = r.entity_type
                    GROUP BY kpi_key, dimension, dimension_value) s
              LEFT JOIN kpi_daily m USING (kpi_key, dimension, dimension_value, kpi_date)
              JOIN (SELECT kpi_key, bool_and(aggregation = 'sum') AS additive
                    FROM kpi_daily d JOIN daily_registry r USING (kpi_key) WHERE d.dimension = r.entity_type GROUP BY kpi_key) a
                USING (kpi_key)) dense
            WINDOW c AS (PARTITION BY kpi_key, dimension, dimension_value ORDER BY kpi_date ROWS BETWEEN {W - 1} PRECEDING AND CURRENT ROW),
                   p AS (PARTITION BY kpi_key, dimension, dimension_value ORDER BY kpi_date ROWS BETWEEN {2 * W - 1} PRECEDING AND {W} PRECEDING)
          ) v WHERE cur IS NOT NULL AND prev IS NOT NULL
        ) r WHERE additive OR vol_rank <= {analyst.RATIO_CANDIDATES}
      ) q WHERE change_pct IS NOT NULL
    ) t WHERE driver_rank <= {analyst.TOP_DRIVERS}""")

cte("monthly_entries", ["kpi_monthly", "registry"], f"""
    SELECT m.kpi_key, m.month_start, 'kpi:' || m.kpi_key AS id, r.label, r.data_origin, strftime(m.month_start, '%m/%Y') AS month,
           {_fmt_sql('m.value', 'r.unit')} AS value_text, r.data_class
    FROM kpi_monthly m JOIN registry r ON r.key = m.kpi_key
    WHERE m.dimension = 'total' AND m.is_complete AND r.grain = 'month' AND r.data_class IN {ALLOWED_SQL}""")


@register("context_week_change", with_ctes("SELECT * FROM week_change", "week_change"))
def context_week_change(ctx: Ctx) -> DataFrame:
    """Last 7 vs previous 7 days per KPI for every as-of day, formatted."""
    return analyst.week_change(ctx)


@register("top_drivers", with_ctes("SELECT * FROM top_drivers", "top_drivers"))
def top_drivers(ctx: Ctx) -> DataFrame:
    """The three members behind each KPI's week change, every as-of day."""
    return analyst.top_drivers(ctx)


@register("context_monthly", with_ctes("SELECT * FROM monthly_entries", "monthly_entries"))
def context_monthly(ctx: Ctx) -> DataFrame:
    """Complete-month totals of the monthly KPIs, formatted."""
    return analyst.monthly_entries(ctx)


def all_findings(ctx: Ctx) -> DataFrame:
    """Outbox rows of the daily and the monthly findings."""
    return outbox.insight_rows(anomaly.detect_daily(ctx).unionByName(anomaly.detect_monthly(ctx)))


def documents(ctx: Ctx) -> DataFrame:
    return analyst.context_document(analyst.context_entries(ctx, all_findings(ctx)))


@register("context_document")
def context_document(ctx: Ctx) -> DataFrame:
    """The nested analyst context per as-of day as JSON, with drivers, directions, data origins and the
    daily and monthly findings (rows-only: the daily ones come from STL; its entries are checked in context_entries)."""
    return documents(ctx)


@register("latest_briefing")
def latest_briefing(ctx: Ctx) -> DataFrame:
    """The newest briefing a public/internal reader may see, one briefing per as-of day derived
    from its context document, without that internal context (rows-only)."""
    docs = documents(ctx)
    briefings = analyst.briefing_events(docs).filter(F.col("data_class").isin(analyst.ALLOWED_CLASSES))
    newest = briefings.orderBy(F.col("period_end").desc(), F.col("created_at").desc(), "event_id").limit(1)
    return newest.withColumn("payload", remove_path(F.col("payload"), ["details", "context"]))


@register("highest_class", with_ctes(
    """SELECT period_start, coalesce(arg_max(data_class, CASE data_class WHEN 'confidential' THEN 2 WHEN 'internal' THEN 1
                                                   WHEN 'public' THEN 0 END), 'public') AS data_class, count(*) AS insights
       FROM insight_rows GROUP BY period_start""", "insight_rows"))
def highest_class(ctx: Ctx) -> DataFrame:
    """Highest data class among each month's findings (drives the prompt's class)."""
    return queries_more.monthly_insights(ctx).groupBy("period_start").agg(
        analyst.highest_class(F.col("data_class")).alias("data_class"), F.count(F.lit(1)).alias("insights")
    )


@register("series_with_markers", with_ctes(
    """SELECT t.kpi_key, t.dimension, t.dimension_value, t.entity_id, t.month_start AS period, t.value,
              d.severity AS marker_severity, d.direction AS marker_direction
       FROM monthly_targets t
       LEFT JOIN detect_monthly d ON d.kpi_key = t.kpi_key AND d.entity_id = t.entity_id AND d.period_start = t.month_start""",
    "monthly_targets", "detect_monthly"))
def series_with_markers(ctx: Ctx) -> DataFrame:
    """Monitored monthly series with the anomaly marker of each point (entity + period)."""
    t = anomaly.monthly_targets(ctx)
    d = anomaly.detect_monthly(ctx).select(
        "kpi_key", "entity_id", F.col("period_start").alias("month_start"),
        F.col("severity").alias("marker_severity"), F.col("direction").alias("marker_direction"),
    )
    return t.join(d, ["kpi_key", "entity_id", "month_start"], "left").select(
        "kpi_key", "dimension", "dimension_value", "entity_id", F.col("month_start").alias("period"), "value",
        "marker_severity", "marker_direction",
    )


_LINK_FROM_SQL = f"CAST(period_end - CASE grain WHEN 'day' THEN {analyst.MAX_INSIGHT_LINK_DAYS['day'] - 1} ELSE {analyst.MAX_INSIGHT_LINK_DAYS['month'] - 1} END AS DATE)"


@register("insight_links", with_ctes(
    f"""SELECT kpi_key, entity_id, period_start, split_part(entity_id, ':', 1) AS entity_type,
              regexp_extract(entity_id, '^[^:]*:(.*)$', 1) AS entity_key,
              {_LINK_FROM_SQL} AS link_from, period_end AS link_to,
              '?kpi=' || kpi_key || CASE WHEN dimension = 'total' THEN '' ELSE '&dim=' || dimension END
                || '&from=' || CAST({_LINK_FROM_SQL} AS VARCHAR) || '&to=' || CAST(period_end AS VARCHAR) AS link
       FROM detect_monthly""", "detect_monthly"))
def insight_links(ctx: Ctx) -> DataFrame:
    """entity type/key of each finding and its deep link: a window of 30 days (daily) or
    365 days (monthly) that ends with the finding, both ends included."""
    d = anomaly.detect_monthly(ctx)
    etype, ekey = analyst.entity_split(F.col("entity_id"))
    days = analyst.MAX_INSIGHT_LINK_DAYS
    start = F.date_sub("period_end", F.when(F.col("grain") == "day", F.lit(days["day"] - 1)).otherwise(F.lit(days["month"] - 1)))
    dim = F.when(F.col("dimension") == "total", F.lit("")).otherwise(F.concat(F.lit("&dim="), F.col("dimension")))
    link = F.concat(F.lit("?kpi="), F.col("kpi_key"), dim, F.lit("&from="), start.cast("string"), F.lit("&to="),
                    F.col("period_end").cast("string"))
    return d.select("kpi_key", "entity_id", "period_start", etype.alias("entity_type"), ekey.alias("entity_key"),
                    start.alias("link_from"), F.col("period_end").alias("link_to"), link.alias("link"))


_CHECKS_SQL = """
    SELECT 'outbox.severity' AS check_name, count(*) FILTER (WHERE NOT (severity IN ('info', 'warning', 'critical'))) AS violations FROM insight_rows
    UNION ALL SELECT 'outbox.type', count(*) FILTER (WHERE NOT (type IN ('anomaly', 'briefing', 'forecast_deviation', 'data_quality'))) FROM insight_rows
    UNION ALL SELECT 'outbox.data_class', count(*) FILTER (WHERE NOT (data_class IN ('public', 'internal', 'confidential'))) FROM insight_rows
    UNION ALL SELECT 'deliveries.status', count(*) FILTER (WHERE NOT (status IN ('pending', 'delivered', 'failed', 'skipped'))) FROM transitioned
    UNION ALL SELECT 'deliveries.attempts', count(*) FILTER (WHERE NOT (attempts >= 0)) FROM transitioned
    UNION ALL SELECT 'usage.tokens', count(*) FILTER (WHERE NOT (tokens_in >= 0 AND tokens_out >= 0)) FROM llm_usage
    UNION ALL SELECT 'load_log.status', count(*) FILTER (WHERE NOT (status IN ('success', 'failed'))) FROM load_log
    UNION ALL SELECT 'load_log.mode', count(*) FILTER (WHERE NOT (mode IN ('full', 'incremental'))) FROM load_log"""


@register("dq_checks", with_ctes(_CHECKS_SQL, "insight_rows", "transitioned", "llm_usage", "load_log", "stg_reviews"))
def dq_checks(ctx: Ctx) -> DataFrame:
    """CHECK constraints of the control tables (outbox, deliveries, usage, load log)."""
    ev = queries_more.monthly_insights(ctx)
    tr = queries_more.transitioned(ctx)
    us = ops.llm_usage(ctx)
    lg = ops.load_log(ctx)
    parts = [
        analyst.check_violations("outbox.severity", ev, F.col("severity").isin("info", "warning", "critical")),
        analyst.check_violations("outbox.type", ev, F.col("type").isin("anomaly", "briefing", "forecast_deviation", "data_quality")),
        analyst.check_violations("outbox.data_class", ev, F.col("data_class").isin("public", "internal", "confidential")),
        analyst.check_violations("deliveries.status", tr, F.col("status").isin("pending", "delivered", "failed", "skipped")),
        analyst.check_violations("deliveries.attempts", tr, F.col("attempts") >= 0),
        analyst.check_violations("usage.tokens", us, (F.col("tokens_in") >= 0) & (F.col("tokens_out") >= 0)),
        analyst.check_violations("load_log.status", lg, F.col("status").isin("success", "failed")),
        analyst.check_violations("load_log.mode", lg, F.col("mode").isin("full", "incremental")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@register("ingest_checks", with_ctes(
    """SELECT t.source, t.entity, t.rows_present, l.new_rows,
              CASE WHEN t.rows_present > 0 THEN 'pass' ELSE 'fail' END AS rows_present_check,
              CASE WHEN l.new_rows > 0 THEN 'pass' ELSE 'warn' END AS new_rows_check
       FROM (SELECT source, entity, sum(rows_loaded) AS rows_present FROM load_log GROUP BY 1, 2) t
       JOIN (SELECT source, entity, rows_loaded AS new_rows FROM (
               SELECT *, row_number() OVER (PARTITION BY source, entity ORDER BY finished_at DESC, load_id DESC) AS rn
               FROM load_log) x WHERE rn = 1) l USING (source, entity)""", "load_log", "stg_reviews"))
def ingest_checks(ctx: Ctx) -> DataFrame:
    """Rows present per raw table, new rows of the latest load."""
    return analyst.ingest_checks(ops.load_log(ctx))
