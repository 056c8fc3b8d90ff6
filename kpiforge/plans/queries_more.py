"""Registered queries: query layer, detection, outbox, context, usage, pipeline status."""

from __future__ import annotations

from datetime import date, datetime, time, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kpiforge import config
from kpiforge.context import Ctx, model
from kpiforge.operators import anomaly, kpi, outbox, query
from kpiforge.plans.catalog import ORACLE, register
from kpiforge.plans.oracle_ctes import cte, with_ctes
from kpiforge.sources.registry import registry_values_sql


# --- fixed parameters of the registered query-layer calls ----------------------------------------
SIM_D = config.SIM_DATE
YEAR_START = SIM_D - timedelta(days=364)
BREAKDOWN_START, BREAKDOWN_END = query.PeriodWindow.latest("month", SIM_D).bounds
HISTORY_START = date(1992, 1, 1)
NOW = datetime.combine(SIM_D, time(6, 0))
OUTBOX_CUTOFF = SIM_D - timedelta(days=90)
PANEL_END = SIM_D - timedelta(days=40)



def _dbl(*cols: str) -> str:
    return "* REPLACE (" + ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in cols) + ")"


# --- query layer ------------------------------------------------------------------------------------
def _daily_rows(ctx: Ctx) -> DataFrame:
    return query.as_period(kpi.kpi_daily(ctx), "day")


def _monthly_rows(ctx: Ctx) -> DataFrame:
    return query.as_period(kpi.kpi_monthly(ctx), "month")


cte("daily_rows", ["kpi_daily"], "SELECT kpi_date AS period, * EXCLUDE (kpi_date) FROM kpi_daily")
cte("monthly_rows", ["kpi_monthly"], "SELECT month_start AS period, * EXCLUDE (month_start) FROM kpi_monthly")

_WINDOW_VALUE = (
    "CASE WHEN bool_and(aggregation = 'sum') THEN CAST(sum(numerator) AS DOUBLE) "
    "ELSE CAST(sum(numerator) AS DOUBLE) / nullif(CAST(sum(denominator) AS DOUBLE), 0) END"
)


@register(
    "kpi_window_value",
    with_ctes(
        f"""SELECT kpi_key, dimension, dimension_value, entity_id, {_WINDOW_VALUE} AS value
        FROM daily_rows WHERE period BETWEEN DATE '{YEAR_START}' AND DATE '{SIM_D}'
        GROUP BY kpi_key, dimension, dimension_value, entity_id""",
        "daily_rows",
    ),
)
def kpi_window_value(ctx: Ctx) -> DataFrame:
    """Every member's value over the last 365 days, ratios re-aggregated."""
    return query.window_values(_daily_rows(ctx), YEAR_START, SIM_D)


_P_START, _P_END = query.PeriodWindow.between("month", BREAKDOWN_START, BREAKDOWN_END).previous().bounds


def _wv(prefix: str) -> str:
    return (
        f"CASE WHEN {prefix}_rows > 0 THEN CASE WHEN {prefix}_sum THEN CAST({prefix}_num AS DOUBLE) "
        f"ELSE CAST({prefix}_num AS DOUBLE) / nullif(CAST({prefix}_den AS DOUBLE), 0) END END"
    )


@register(
    "kpi_breakdown",
    with_ctes(
        f"""SELECT *, row_number() OVER (PARTITION BY kpi_key, dimension
                 ORDER BY change_pct IS NULL, abs(change_pct) DESC, dimension_value) AS position
        FROM (
          SELECT kpi_key, dimension, dimension_value, coalesce(cur_entity, prev_entity) AS entity_id,
                 cur AS current, prev AS previous,
                 CASE WHEN cur IS NOT NULL AND prev IS NOT NULL THEN round(cur - prev, 6) END AS change_abs,
                 CASE WHEN cur IS NOT NULL AND prev IS NOT NULL AND prev <> 0 THEN round((cur - prev) / abs(prev) * 100, 2) END AS change_pct
          FROM (
            SELECT *, {_wv('c')} AS cur, {_wv('p')} AS prev FROM (
              SELECT kpi_key, dimension, dimension_value,
                     max(entity_id) FILTER (WHERE period BETWEEN DATE '{BREAKDOWN_START}' AND DATE '{BREAKDOWN_END}') AS cur_entity,
                     max(entity_id) FILTER (WHERE period BETWEEN DATE '{_P_START}' AND DATE '{_P_END}') AS prev_entity,
                     count(*) FILTER (WHERE period BETWEEN DATE '{BREAKDOWN_START}' AND DATE '{BREAKDOWN_END}') AS c_rows,
                     count(*) FILTER (WHERE period BETWEEN DATE '{_P_START}' AND DATE '{_P_END}') AS p_rows,
                     sum(numerator) FILTER (WHERE period BETWEEN DATE '{BREAKDOWN_START}' AND DATE '{BREAKDOWN_END}') AS c_num,
                     sum(denominator) FILTER (WHERE period BETWEEN DATE '{BREAKDOWN_START}' AND DATE '{BREAKDOWN_END}') AS c_den,
                     sum(numerator) FILTER (WHERE period BETWEEN DATE '{_P_START}' AND DATE '{_P_END}') AS p_num,
                     sum(denominator) FILTER (WHERE period BETWEEN DATE '{_P_START}' AND DATE '{_P_END}') AS p_den,
                     bool_and(aggregation = 'sum') FILTER (WHERE period BETWEEN DATE '{BREAKDOWN_START}' AND DATE '{BREAKDOWN_END}') AS c_sum,
                     bool_and(aggregation = 'sum') FILTER (WHERE period BETWEEN DATE '{_P_START}' AND DATE '{_P_END}') AS p_sum
              FROM monthly_rows WHERE period BETWEEN DATE '{_P_START}' AND DATE '{BREAKDOWN_END}'
              GROUP BY kpi_key, dimension, dimension_value) a) b) c""",
        "monthly_rows",
    ),
)
def kpi_breakdown(ctx: Ctx) -> DataFrame:
    """Last 12 months vs the 12 before, every KPI and dimension, one scan."""
    return query.breakdown(_monthly_rows(ctx), "month", BREAKDOWN_START, BREAKDOWN_END)


def _breakdown_sql(rows: str, start: date, end: date, p_start: date, p_end: date) -> str:
    cur = f"period BETWEEN DATE '{start}' AND DATE '{end}'"
    prev = f"period BETWEEN DATE '{p_start}' AND DATE '{p_end}'"
    return f"""SELECT *, row_number() OVER (PARTITION BY kpi_key, dimension
                 ORDER BY change_pct IS NULL, abs(change_pct) DESC, dimension_value) AS position
        FROM (
          SELECT kpi_key, dimension, dimension_value, coalesce(cur_entity, prev_entity) AS entity_id,
                 cur AS current, prev AS previous,
                 CASE WHEN cur IS NOT NULL AND prev IS NOT NULL THEN round(cur - prev, 6) END AS change_abs,
                 CASE WHEN cur IS NOT NULL AND prev IS NOT NULL AND prev <> 0 THEN round((cur - prev) / abs(prev) * 100, 2) END AS change_pct
          FROM (
            SELECT *, {_wv('c')} AS cur, {_wv('p')} AS prev FROM (
              SELECT kpi_key, dimension, dimension_value,
                     max(entity_id) FILTER (WHERE {cur}) AS cur_entity, max(entity_id) FILTER (WHERE {prev}) AS prev_entity,
                     count(*) FILTER (WHERE {cur}) AS c_rows, count(*) FILTER (WHERE {prev}) AS p_rows,
                     sum(numerator) FILTER (WHERE {cur}) AS c_num, sum(denominator) FILTER (WHERE {cur}) AS c_den,
                     sum(numerator) FILTER (WHERE {prev}) AS p_num, sum(denominator) FILTER (WHERE {prev}) AS p_den,
                     bool_and(aggregation = 'sum') FILTER (WHERE {cur}) AS c_sum,
                     bool_and(aggregation = 'sum') FILTER (WHERE {prev}) AS p_sum
              FROM {rows} WHERE period BETWEEN DATE '{p_start}' AND DATE '{end}'
              GROUP BY kpi_key, dimension, dimension_value) a) b) c"""


DAY_START, DAY_END = query.PeriodWindow.latest("day", SIM_D).bounds
_DP_START, _DP_END = query.PeriodWindow.between("day", DAY_START, DAY_END).previous().bounds


@register(
    "kpi_breakdown_daily",
    with_ctes(_breakdown_sql("daily_rows", DAY_START, DAY_END, _DP_START, _DP_END), "daily_rows"),
)
def kpi_breakdown_daily(ctx: Ctx) -> DataFrame:
    """Q03/Q04/F09 (day grain, default window): the last 90 days against the 90 before, every
    KPI and dimension member, one scan."""
    return query.breakdown(_daily_rows(ctx), "day", DAY_START, DAY_END)


@register(
    "breakdown_presentation",
    f"""SELECT b.kpi_key, b.dimension, b.dimension_value,
               CASE WHEN r.unit = 'ratio' THEN b.change_abs * 100 ELSE b.change_pct END AS change_shown,
               CASE WHEN r.unit = 'ratio' THEN 'pp' ELSE '%' END AS change_unit,
               CASE WHEN coalesce(CASE WHEN r.unit = 'ratio' THEN b.change_abs * 100 ELSE b.change_pct END, 0) = 0 THEN '•'
                    WHEN (CASE WHEN r.unit = 'ratio' THEN b.change_abs * 100 ELSE b.change_pct END) > 0 THEN '▲' ELSE '▼' END AS change_icon,
               CASE WHEN coalesce(CASE WHEN r.unit = 'ratio' THEN b.change_abs * 100 ELSE b.change_pct END, 0) = 0
                         OR r.direction = 'neutral' THEN 'neutral'
                    WHEN ((CASE WHEN r.unit = 'ratio' THEN b.change_abs * 100 ELSE b.change_pct END) > 0)
                         = (r.direction = 'higher_is_better') THEN 'good'
                    ELSE 'bad' END AS tone
        FROM ({ORACLE['kpi_breakdown']}) b LEFT JOIN ({registry_values_sql()}) r ON r.key = b.kpi_key""",
)
def breakdown_presentation(ctx: Ctx) -> DataFrame:
    """Breakdown changes as shown (pp for ratios, % otherwise), arrow and tone."""
    return query.change_presentation(
        query.breakdown(_monthly_rows(ctx), "month", BREAKDOWN_START, BREAKDOWN_END), anomaly.registry(ctx)
    )


@register(
    "kpi_series_top",
    with_ctes(
        f"""SELECT w.kpi_key, w.dimension, w.dimension_value, w.entity_id, w.period, w.value, v.member_rank
        FROM monthly_rows w JOIN (
              SELECT kpi_key, dimension, dimension_value,
                     row_number() OVER (PARTITION BY kpi_key, dimension ORDER BY sum(numerator) DESC NULLS LAST, dimension_value) AS member_rank
              FROM monthly_rows WHERE period BETWEEN DATE '{HISTORY_START}' AND DATE '{SIM_D}'
              GROUP BY kpi_key, dimension, dimension_value) v USING (kpi_key, dimension, dimension_value)
        WHERE v.member_rank <= 5 AND w.period BETWEEN DATE '{HISTORY_START}' AND DATE '{SIM_D}'""",
        "monthly_rows",
    ),
)
def kpi_series_top(ctx: Ctx) -> DataFrame:
    """Monthly series of the top 5 members of every KPI and dimension."""
    return query.series(_monthly_rows(ctx), HISTORY_START, SIM_D, None, 5)


@register(
    "kpi_series",
    with_ctes(
        f"""SELECT kpi_key, dimension, dimension_value, entity_id, period, value FROM daily_rows
        WHERE period BETWEEN DATE '{HISTORY_START}' AND DATE '{SIM_D}' AND dimension_value IN ('all')""",
        "daily_rows",
    ),
)
def kpi_series(ctx: Ctx) -> DataFrame:
    """Q02/L02 with an explicit member list (no top limit): daily total series of all KPIs."""
    return query.series(_daily_rows(ctx), HISTORY_START, SIM_D, ["all"])


_PIVOT_SQL = ", ".join(f"max(value) FILTER (WHERE kpi_key = '{k}') AS {k}" for k in config.MONTHLY_KPI_KEYS)


@register(
    "kpi_series_pivot",
    with_ctes(f"SELECT period, {_PIVOT_SQL} FROM monthly_rows WHERE dimension = 'total' GROUP BY period", "monthly_rows"),
)
def kpi_series_pivot(ctx: Ctx) -> DataFrame:
    """Period x KPI table of the monthly totals."""
    rows = _monthly_rows(ctx).filter(F.col("dimension") == "total")
    return rows.groupBy("period").pivot("kpi_key", config.MONTHLY_KPI_KEYS).agg(F.max("value"))


@register(
    "visible_kpis",
    with_ctes(
        """SELECT r.key, r.label, r.unit, r.grain, r.data_class, l.latest_date, l.latest_value
        FROM registry r LEFT JOIN (
          SELECT kpi_key, max(kpi_date) AS latest_date, arg_max_null(value, kpi_date) AS latest_value
          FROM kpi_daily WHERE dimension = 'total' GROUP BY kpi_key) l ON l.kpi_key = r.key
        WHERE r.data_class IN ('public')""",
        "registry",
        "kpi_daily",
    ),
)
def visible_kpis(ctx: Ctx) -> DataFrame:
    """KPIs a guest may see (public), with the latest total value from the mart."""
    reg = anomaly.registry(ctx).filter(F.col("data_class").isin("public"))
    d = kpi.kpi_daily(ctx).filter(F.col("dimension") == "total")
    latest = d.groupBy("kpi_key").agg(
        F.max("kpi_date").alias("latest_date"), F.max_by("value", "kpi_date").alias("latest_value")
    )
    return reg.join(latest.withColumnRenamed("kpi_key", "key"), "key", "left").select(
        "key", "label", "unit", "grain", "data_class", "latest_date", "latest_value"
    )


# --- monthly detection and the outbox --------------------------------------------------------------
cte("monthly_targets", ["kpi_monthly", "registry"], """
    SELECT * FROM (
      SELECT m.*, r.entity_type, r.alert_threshold,
             CASE WHEN m.dimension = 'total' THEN 0 ELSE row_number() OVER (
               PARTITION BY m.kpi_key, m.dimension, m.month_start
               ORDER BY coalesce(m.denominator, m.numerator) DESC NULLS LAST, m.dimension_value) END AS member_rank
      FROM kpi_monthly m JOIN registry r ON r.key = m.kpi_key
      WHERE r.alert_method = 'threshold' AND (m.dimension = 'total' OR m.dimension = r.entity_type)) t
    WHERE member_rank <= 5""")

cte("detect_monthly", ["monthly_targets", "registry"], """
    SELECT 'anomaly' AS type, s.kpi_key, s.dimension, s.dimension_value, s.entity_id,
           s.month_start AS period_start, last_day(s.month_start) AS period_end, 'month' AS grain,
           CASE WHEN raw_score >= 2 THEN 'critical' WHEN raw_score >= 1 THEN 'warning' END AS severity,
           round(s.value, 6) AS observed, 0.0 AS expected, round(raw_score, 3) AS score, 'threshold' AS method,
           s.alert_threshold AS evidence_threshold, r.label, r.unit, r.data_class,
           CASE WHEN s.value >= 0.0 THEN 'up' ELSE 'down' END AS direction, CAST(NULL AS DOUBLE) AS deviation_pct
    FROM (SELECT *, abs(value) / alert_threshold AS raw_score FROM monthly_targets
          WHERE is_complete AND value IS NOT NULL) s
    JOIN registry r ON r.key = s.kpi_key
    WHERE raw_score >= 1""")


def _de_sql(x: str, digits: int) -> str:
    return (
        f"translate(format('{{:,.{digits}f}}', CAST(round(CAST({x} AS DECIMAL(38,6)), {digits}) AS DOUBLE)), ',.', '.,')"
    )


def _fmt_sql(x: str, unit: str) -> str:
    return f"""CASE WHEN {x} IS NULL THEN '–'
        WHEN {unit} = 'BRL' THEN {_de_sql(x, 2)} || ' R$'
        WHEN {unit} = 'ratio' THEN {_de_sql(f'({x}) * 100', 2)} || ' %'
        WHEN {unit} = 'multiple' THEN {_de_sql(x, 2)} || '×'
        WHEN {unit} = 'days' THEN {_de_sql(x, 1)} || ' Tage'
        WHEN {unit} = 'score' THEN {_de_sql(x, 2)}
        WHEN {x} = floor({x}) THEN {_de_sql(x, 0)}
        ELSE {_de_sql(x, 2)} END"""


_SCOPE = """CASE WHEN dimension = 'total' THEN '' ELSE ' (' || CASE dimension WHEN 'region' THEN 'Region'
            WHEN 'category' THEN 'Kategorie' ELSE dimension END || ' ' || dimension_value || ')' END"""

cte("insight_rows", ["detect_monthly"], f"""
    SELECT substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) AS event_id,
           'insight' AS event_type, dedup_key, type, kpi_key AS kpi, period_start, period_end, severity, data_class,
           label || {_SCOPE} || ' ' || strftime(period_start, '%m/%Y') || ': ' || {_fmt_sql('observed', 'unit')}
             || ', Grenze ±' || {_fmt_sql('evidence_threshold', 'unit')} || ' überschritten.' AS summary,
           CAST(CAST(period_end + 1 AS DATE) AS TIMESTAMP) + INTERVAL 6 HOUR AS created_at
    FROM (SELECT *, sha256(dedup_key) AS h FROM (
      SELECT *, type || ':' || coalesce(kpi_key, '-') || ':' ||
               CASE WHEN dimension = 'total' THEN 'kpi:' || kpi_key
                    ELSE array_to_string(list_sort([entity_id, 'kpi:' || kpi_key]), ',') END
               || ':' || grain || ':' || CAST(period_start AS VARCHAR) || ':' || CAST(period_end AS VARCHAR) AS dedup_key
      FROM detect_monthly) a) b""")

cte("outbox_prev", ["insight_rows"], f"SELECT * FROM insight_rows WHERE period_end < DATE '{OUTBOX_CUTOFF}'")
cte("outbox_new", ["insight_rows", "outbox_prev"], """
    SELECT * EXCLUDE (rn) FROM (
      SELECT *, row_number() OVER (PARTITION BY dedup_key ORDER BY created_at, event_id) AS rn FROM insight_rows) u
    WHERE rn = 1 AND dedup_key NOT IN (SELECT dedup_key FROM outbox_prev)""")


def _enqueue_sql(events: str) -> str:
    parts = []
    for c in outbox.CONSUMERS:
        types = ", ".join(f"'{t}'" for t in c.types)
        sev = f"CASE severity WHEN 'info' THEN 0 WHEN 'warning' THEN 1 WHEN 'critical' THEN 2 ELSE 0 END"
        cls = f"CASE data_class WHEN 'public' THEN 0 WHEN 'internal' THEN 1 WHEN 'confidential' THEN 2 ELSE 0 END"
        admitted = (
            f"type IN ({types}) AND {sev} >= {config.SEVERITY_RANK[c.min_severity]} AND {cls} <= {config.DATA_CLASS_RANK[c.max_data_class]}"
            f" AND period_end >= DATE '{SIM_D - timedelta(days=c.max_age_days)}'"
        )
        parts.append(
            f"SELECT event_id, '{c.name}' AS consumer, CASE WHEN {admitted} THEN 'pending' ELSE 'skipped' END AS status FROM {events}"
        )
    return " UNION ALL ".join(parts)


_DELIVERY_COLS = (
    f"0 AS attempts, TIMESTAMP '{NOW}' AS next_attempt_at, CAST(NULL AS VARCHAR) AS last_error, CAST(NULL AS TIMESTAMP) AS delivered_at"
)
cte("deliveries_prev", ["outbox_prev"], f"SELECT *, {_DELIVERY_COLS} FROM ({_enqueue_sql('outbox_prev')}) e")
cte("deliveries_new", ["insight_rows", "deliveries_prev"], f"""
    SELECT e.*, {_DELIVERY_COLS} FROM ({_enqueue_sql('insight_rows')}) e
    WHERE NOT EXISTS (SELECT 1 FROM deliveries_prev d WHERE d.event_id = e.event_id AND d.consumer = e.consumer)""")
cte("deliveries_all", ["deliveries_prev", "deliveries_new"], "SELECT * FROM deliveries_prev UNION ALL SELECT * FROM deliveries_new")
cte("due_batch", ["deliveries_all", "insight_rows"], f"""
    SELECT * FROM (
      SELECT d.*, i.created_at, row_number() OVER (PARTITION BY d.consumer ORDER BY i.created_at, d.event_id) AS batch_pos
      FROM deliveries_all d JOIN insight_rows i USING (event_id)
      WHERE d.status = 'pending' AND d.next_attempt_at <= TIMESTAMP '{NOW}') x
    WHERE batch_pos <= {config.BATCH_SIZE}""")
cte("outcomes", ["due_batch"], """
    SELECT event_id, consumer, substr(sha256(event_id || '/' || consumer), 1, 1) NOT IN ('0', '1', '2', '3') AS success,
           'ConnectionError: simulated' AS error
    FROM due_batch""")
cte("transitioned", ["deliveries_all", "outcomes"], f"""
    SELECT event_id, consumer,
           CASE WHEN success THEN 'delivered' WHEN NOT success AND attempts + 1 >= {config.MAX_ATTEMPTS} THEN 'failed'
                WHEN NOT success THEN 'pending' ELSE status END AS status,
           CASE WHEN success IS NOT NULL THEN attempts + 1 ELSE attempts END AS attempts,
           CASE WHEN NOT success THEN TIMESTAMP '{NOW}' + to_minutes(CAST(pow(2, attempts) AS INTEGER) * {config.BASE_BACKOFF_MINUTES})
                ELSE next_attempt_at END AS next_attempt_at,
           CASE WHEN NOT success THEN substr(error, 1, 1000) WHEN success IS NOT NULL THEN NULL ELSE last_error END AS last_error,
           CASE WHEN success THEN TIMESTAMP '{NOW}' ELSE delivered_at END AS delivered_at,
           CASE WHEN NOT success AND attempts + 1 < {config.MAX_ATTEMPTS} THEN 'retrying'
                WHEN NOT success THEN 'failed' WHEN success THEN 'delivered' END AS outcome
    FROM deliveries_all d LEFT JOIN outcomes o USING (event_id, consumer)""")


@model
def monthly_insights(ctx: Ctx) -> DataFrame:
    return outbox.insight_rows(anomaly.detect_monthly(ctx))


@model
def outbox_prev(ctx: Ctx) -> DataFrame:
    """The outbox as saved by earlier runs (insights of periods before the cut-off)."""
    return monthly_insights(ctx).filter(F.col("period_end") < F.lit(OUTBOX_CUTOFF))


@model
def deliveries_prev(ctx: Ctx) -> DataFrame:
    empty = ctx.spark.createDataFrame([], "event_id string, consumer string")
    return outbox.enqueue(outbox_prev(ctx), empty, SIM_D, NOW)


@model
def deliveries_new(ctx: Ctx) -> DataFrame:
    return outbox.enqueue(monthly_insights(ctx), deliveries_prev(ctx), SIM_D, NOW)


@model
def deliveries_all(ctx: Ctx) -> DataFrame:
    return deliveries_prev(ctx).unionByName(deliveries_new(ctx))


@model
def due_batch(ctx: Ctx) -> DataFrame:
    return outbox.due(deliveries_all(ctx), monthly_insights(ctx), NOW)


def _outcomes(due: DataFrame) -> DataFrame:
    """A flaky consumer: about one delivery in four fails (deterministic by event and consumer)."""
    first = F.substring(F.sha2(F.concat_ws("/", "event_id", "consumer"), 256), 1, 1)
    return due.select("event_id", "consumer", (~first.isin("0", "1", "2", "3")).alias("success"),
                      F.lit("ConnectionError: simulated").alias("error"))


@model
def transitioned(ctx: Ctx) -> DataFrame:
    return outbox.transition(deliveries_all(ctx), _outcomes(due_batch(ctx)), NOW)


_DETECT_COLS = ("observed", "expected", "score", "evidence_threshold", "deviation_pct")


@register("detect_monthly", with_ctes("SELECT * FROM detect_monthly", "detect_monthly"))
def detect_monthly(ctx: Ctx) -> DataFrame:
    """Threshold rule on every complete month (total + top categories)."""
    return anomaly.detect_monthly(ctx)


@register("monitor_targets_monthly", with_ctes(
    f"SELECT kpi_key, dimension, dimension_value, entity_id, month_start, member_rank FROM monthly_targets", "monthly_targets"))
def monitor_targets_monthly(ctx: Ctx) -> DataFrame:
    """T01 (month grain): total + top members per complete month."""
    return anomaly.monthly_targets(ctx).select("kpi_key", "dimension", "dimension_value", "entity_id", "month_start", "member_rank")


_INSIGHT_COLS = "event_id, event_type, dedup_key, type, kpi, period_start, period_end, severity, data_class, summary, created_at"


@register("insight_rows", with_ctes(f"SELECT {_INSIGHT_COLS} FROM insight_rows", "insight_rows"))
def insight_rows(ctx: Ctx) -> DataFrame:
    """Outbox rows (ids, dedup keys, German summaries) of the monthly findings."""
    return monthly_insights(ctx).select(*_INSIGHT_COLS.split(", "))


@register("outbox_insert_new", with_ctes(f"SELECT {_INSIGHT_COLS} FROM outbox_new", "outbox_new"))
def outbox_insert_new(ctx: Ctx) -> DataFrame:
    """Findings not yet in the outbox (ON CONFLICT DO NOTHING as an anti join)."""
    return outbox.insert_new(monthly_insights(ctx), outbox_prev(ctx)).select(*_INSIGHT_COLS.split(", "))


@register("outbox_enqueue", with_ctes("SELECT * FROM deliveries_new", "deliveries_new"))
def outbox_enqueue(ctx: Ctx) -> DataFrame:
    """New delivery rows per consumer, pending or skipped."""
    return deliveries_new(ctx)


@register("outbox_due", with_ctes(
    "SELECT event_id, consumer, status, attempts, next_attempt_at, created_at, batch_pos FROM due_batch", "due_batch"))
def outbox_due(ctx: Ctx) -> DataFrame:
    """Due pending deliveries, oldest first, 100 per consumer."""
    return due_batch(ctx).select("event_id", "consumer", "status", "attempts", "next_attempt_at", "created_at", "batch_pos")


@register("delivery_transition", with_ctes("SELECT * FROM transitioned", "transitioned"))
def delivery_transition(ctx: Ctx) -> DataFrame:
    """Delivered / retry with exponential backoff / failed."""
    return transitioned(ctx)


@register("dispatch_stats", with_ctes(
    """SELECT coalesce(e.consumer, t.consumer) AS consumer, coalesce(e.enqueued, 0) AS enqueued,
              coalesce(t.delivered, 0) AS delivered, coalesce(t.retrying, 0) AS retrying, coalesce(t.failed, 0) AS failed
       FROM (SELECT consumer, count(*) AS enqueued FROM deliveries_new GROUP BY consumer) e
       FULL OUTER JOIN (SELECT consumer, count(*) FILTER (WHERE outcome = 'delivered') AS delivered,
                               count(*) FILTER (WHERE outcome = 'retrying') AS retrying,
                               count(*) FILTER (WHERE outcome = 'failed') AS failed
                        FROM transitioned GROUP BY consumer) t ON t.consumer = e.consumer""",
    "deliveries_new", "transitioned"))
def dispatch_stats(ctx: Ctx) -> DataFrame:
    """Enqueued / delivered / retrying / failed per consumer."""
    return outbox.dispatch_stats(transitioned(ctx), deliveries_new(ctx))


_ALLOWED = ["public", "internal"]


@register("insights_query", with_ctes(
    f"""SELECT {_INSIGHT_COLS} FROM insight_rows
        WHERE event_type = 'insight' AND type IN ('anomaly')
          AND CASE severity WHEN 'critical' THEN 2 WHEN 'warning' THEN 1 ELSE 0 END >= 1
          AND data_class IN ('public', 'internal')
        ORDER BY period_end DESC, CASE severity WHEN 'critical' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END, created_at DESC, event_id
        LIMIT 500""",
    "insight_rows"))
def insights_query(ctx: Ctx) -> DataFrame:
    """Filtered insight list, newest first, at most 500."""
    q = query.insights(monthly_insights(ctx), types=["anomaly"], min_severity="warning", classes=_ALLOWED)
    return q.orderBy(F.col("period_end").desc(), "_sev", F.col("created_at").desc(), "event_id").limit(500).select(
        *_INSIGHT_COLS.split(", ")
    )


@register("panel_deviations", f"SELECT * FROM ({ORACLE['kpi_breakdown']}) b WHERE position <= {query.PANEL_DEVIATIONS}")
def panel_deviations(ctx: Ctx) -> DataFrame:
    """The 12 strongest deviations of every KPI and dimension, last 12 months vs the 12 before."""
    rows = query.breakdown(_monthly_rows(ctx), "month", BREAKDOWN_START, BREAKDOWN_END)
    return rows.filter(F.col("position") <= query.PANEL_DEVIATIONS)


@register("panel_insights", with_ctes(
    f"""SELECT {_INSIGHT_COLS} FROM insight_rows
        WHERE event_type = 'insight' AND type = 'anomaly' AND severity IN ('warning', 'critical')
          AND data_class IN ('public', 'internal') AND period_end BETWEEN DATE '{YEAR_START}' AND DATE '{PANEL_END}'
        ORDER BY period_end DESC, CASE severity WHEN 'critical' THEN 0 ELSE 1 END, created_at DESC, event_id
        LIMIT {query.PANEL_INSIGHTS}""", "insight_rows"))
def panel_insights(ctx: Ctx) -> DataFrame:
    """The six newest anomalies that end inside a window (a year cut 40 days before its end)."""
    e = query.insights(monthly_insights(ctx), since=YEAR_START, types=["anomaly"], min_severity="warning", classes=_ALLOWED)
    return query.panel_insights(e, PANEL_END).select(*_INSIGHT_COLS.split(", "))


@register("latest_event", with_ctes(
    f"""SELECT {_INSIGHT_COLS} FROM insight_rows WHERE data_class IN ('public', 'internal')
        ORDER BY period_end DESC, created_at DESC, event_id LIMIT 1""", "insight_rows"))
def latest_event(ctx: Ctx) -> DataFrame:
    """The newest visible event (top-1)."""
    e = monthly_insights(ctx).filter(F.col("data_class").isin(_ALLOWED))
    return e.orderBy(F.col("period_end").desc(), F.col("created_at").desc(), "event_id").limit(1).select(*_INSIGHT_COLS.split(", "))


@register("recent_anomalies", with_ctes(
    f"""SELECT event_id, severity, summary FROM insight_rows
        WHERE type = 'anomaly' AND period_end BETWEEN DATE '{SIM_D - timedelta(days=1)}' AND DATE '{SIM_D}'
          AND data_class IN ('public', 'internal')
        ORDER BY CASE severity WHEN 'critical' THEN 0 ELSE 1 END, created_at, event_id LIMIT 20""", "insight_rows"))
def recent_anomalies(ctx: Ctx) -> DataFrame:
    """Anomalies of the last two days for the analyst context (top 20)."""
    e = monthly_insights(ctx).filter(
        (F.col("type") == "anomaly")
        & F.col("period_end").between(F.lit(SIM_D - timedelta(days=1)), F.lit(SIM_D))
        & F.col("data_class").isin(_ALLOWED)
    )
    sev = F.when(F.col("severity") == "critical", 0).otherwise(1)
    return e.orderBy(sev, "created_at", "event_id").limit(20).select("event_id", "severity", "summary")


# --- non-SQL detection (rows-only check) -----------------------------------------------------------
@register("robust_scores")
def robust_scores(ctx: Ctx) -> DataFrame:
    """Robust seasonal score of every monitored series and day (STL)."""
    return anomaly.robust_scores(ctx)


@register("detect_daily")
def detect_daily(ctx: Ctx) -> DataFrame:
    """Daily anomalies with clamped expectations, direction and deviation."""
    return anomaly.detect_daily(ctx)


@register("detect_run")
def detect_run(ctx: Ctx) -> DataFrame:
    """Backfill over every day and month -> found / stored (new to the outbox) per KPI,
    one pass: found rows are flagged new by a left join on the outbox's dedup keys."""
    found = outbox.insight_rows(anomaly.detect_daily(ctx).unionByName(anomaly.detect_monthly(ctx)))
    existing = outbox_prev(ctx).select("dedup_key", F.lit(True).alias("_seen"))
    flagged = found.join(existing, "dedup_key", "left")
    return flagged.groupBy("kpi").agg(
        F.count(F.lit(1)).alias("found"), F.count_if(F.col("_seen").isNull()).alias("stored")
    )
