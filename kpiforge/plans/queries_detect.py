"""Registered queries: the detector's relational parts with DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame

from kpiforge import config
from kpiforge.context import Ctx
from kpiforge.operators import anomaly
from kpiforge.plans.catalog import register
from kpiforge.plans.oracle_ctes import SIM, cte, with_ctes

W = config.WINDOW_DAYS

cte("alert_series", ["kpi_daily", "registry"], """
    SELECT d.*, r.entity_type, r.alert_threshold, r.min_history_days, r.unit
    FROM kpi_daily d JOIN registry r ON r.key = d.kpi_key
    WHERE r.alert_method = 'stl_mad' AND (d.dimension = 'total' OR d.dimension = r.entity_type)""")

cte("monitor_targets_daily", ["alert_series"], f"""
    SELECT kpi_key, dimension, dimension_value, entity_id, kpi_date AS eval_day, 0 AS member_rank
    FROM alert_series WHERE dimension = 'total'
    UNION ALL
    SELECT kpi_key, dimension, dimension_value, entity_id, kpi_date, member_rank FROM (
      SELECT *, row_number() OVER (PARTITION BY kpi_key, dimension, kpi_date
                                   ORDER BY coalesce(den120, num120) DESC NULLS LAST, dimension_value) AS member_rank
      FROM (
        SELECT s.kpi_key, s.dimension, s.dimension_value, s.entity_id, s.kpi_date, m.numerator IS NOT NULL AS has_row,
               sum(m.numerator) OVER w AS num120, sum(m.denominator) OVER w AS den120, count(m.numerator) OVER w AS rows120
        FROM (
          SELECT kpi_key, dimension, dimension_value, entity_id,
                 CAST(unnest(generate_series(min(kpi_date), DATE '{SIM}', INTERVAL 1 DAY)) AS DATE) AS kpi_date
          FROM alert_series
          WHERE dimension <> 'total' AND kpi_key IN (
            SELECT kpi_key FROM alert_series WHERE dimension <> 'total' GROUP BY kpi_key HAVING bool_and(aggregation = 'sum'))
          GROUP BY kpi_key, dimension, dimension_value, entity_id) s
        LEFT JOIN alert_series m USING (kpi_key, dimension, dimension_value, kpi_date)
        WINDOW w AS (PARTITION BY s.kpi_key, s.dimension, s.dimension_value ORDER BY s.kpi_date ROWS BETWEEN {W - 1} PRECEDING AND CURRENT ROW)
      ) v WHERE rows120 > 0
    ) r WHERE member_rank <= {config.TOP_MEMBERS} AND has_row""")

cte("series_densify", ["monitor_targets_daily", "alert_series"], f"""
    SELECT t.kpi_key, t.dimension, t.dimension_value, t.eval_day, t.day, a.value
    FROM (SELECT kpi_key, dimension, dimension_value, eval_day,
                 CAST(unnest(generate_series(eval_day - {W - 1}, eval_day, INTERVAL 1 DAY)) AS DATE) AS day
          FROM monitor_targets_daily) t
    LEFT JOIN alert_series a ON a.kpi_key = t.kpi_key AND a.dimension = t.dimension
         AND a.dimension_value = t.dimension_value AND a.kpi_date = t.day""")

cte("robust_score_core", ["series_densify", "registry"], f"""
    SELECT kpi_key, dimension, dimension_value, eval_day,
           round(observed + 1e-13, 9) AS observed, round(level + 1e-13, 9) AS level, round(center + 1e-13, 9) AS center,
           round(scale + 1e-13, 9) AS scale, round(level + center + 1e-13, 9) AS expected,
           round((observed - (level + center)) / scale + 1e-13, 9) AS score
    FROM (
      SELECT *, greatest({config.MAD_TO_SIGMA} * mad, {config.SCALE_FLOOR} * abs(level), 1e-9) AS scale FROM (
        SELECT kpi_key, dimension, dimension_value, eval_day, min_history_days,
               max(value) FILTER (WHERE day = eval_day) AS observed,
               max(level) FILTER (WHERE day = eval_day) AS level,
               count(value) FILTER (WHERE day < eval_day) AS history,
               count(err) AS errors, max(center) AS center,
               median(abs(err - center)) AS mad
        FROM (
          SELECT *, median(err) OVER (PARTITION BY kpi_key, dimension, dimension_value, eval_day) AS center FROM (
            SELECT *, CASE WHEN day < eval_day THEN value - level END AS err FROM (
              SELECT d.*, r.min_history_days,
                     CASE WHEN count(value) OVER p >= {config.LEVEL_DAYS // 2} THEN median(value) OVER p END AS level
              FROM series_densify d JOIN registry r ON r.key = d.kpi_key
              WINDOW p AS (PARTITION BY d.kpi_key, d.dimension, d.dimension_value, d.eval_day ORDER BY d.day
                           ROWS BETWEEN {config.LEVEL_DAYS} PRECEDING AND 1 PRECEDING)) a) b) c
        GROUP BY kpi_key, dimension, dimension_value, eval_day, min_history_days) g
      WHERE observed IS NOT NULL AND history >= min_history_days AND errors >= floor(min_history_days / 2)
        AND level IS NOT NULL AND mad IS NOT NULL) s""")


@register("monitor_targets", with_ctes("SELECT * FROM monitor_targets_daily", "monitor_targets_daily"))
def monitor_targets(ctx: Ctx) -> DataFrame:
    """T01/A15/A20/W06 (day grain, every day): total + top-5 members of additive KPIs by
    trailing 120-day volume."""
    return anomaly.monitor_targets_daily(ctx)


@register("series_densify", with_ctes("SELECT * FROM series_densify", "series_densify"))
def series_densify(ctx: Ctx) -> DataFrame:
    """Each monitored (series, day) with its trailing 120-day window, gaps NULL."""
    return anomaly.series_densify(ctx)


@register("robust_score_core", with_ctes("SELECT * FROM robust_score_core", "robust_score_core"))
def robust_score_core(ctx: Ctx) -> DataFrame:
    """Robust score with zero weekly component, by sliding medians."""
    return anomaly.robust_score_core(ctx)
