"""Registered queries: series window operators and per-client trailing counts."""

from __future__ import annotations

from pyspark.sql import DataFrame

from kpiforge import config
from kpiforge.context import Ctx
from kpiforge.operators import windows
from kpiforge.plans.catalog import register
from kpiforge.plans.oracle_ctes import cte, with_ctes

cte("dense_totals", ["alert_series"], """
    SELECT s.kpi_key, s.dimension, s.dimension_value, s.kpi_date, a.value
    FROM (SELECT kpi_key, dimension, dimension_value,
                 CAST(unnest(generate_series(min(kpi_date), max(kpi_date), INTERVAL 1 DAY)) AS DATE) AS kpi_date
          FROM alert_series WHERE dimension = 'total' GROUP BY 1, 2, 3) s
    LEFT JOIN (SELECT * FROM alert_series WHERE dimension = 'total') a USING (kpi_key, dimension, dimension_value, kpi_date)""")


@register("interpolate_gaps", with_ctes(
    """SELECT kpi_key, dimension, dimension_value, kpi_date, value,
              round(CASE WHEN value IS NOT NULL THEN value WHEN v0 IS NULL THEN v1 WHEN v1 IS NULL THEN v0
                         ELSE v0 + (v1 - v0) * (pos - p0) / (p1 - p0) END + 1e-13, 9) AS filled
       FROM (SELECT *, last_value(value IGNORE NULLS) OVER b AS v0,
                    last_value(CASE WHEN value IS NOT NULL THEN pos END IGNORE NULLS) OVER b AS p0,
                    first_value(value IGNORE NULLS) OVER a AS v1,
                    first_value(CASE WHEN value IS NOT NULL THEN pos END IGNORE NULLS) OVER a AS p1
             FROM (SELECT *, date_diff('day', DATE '1970-01-01', kpi_date) AS pos FROM dense_totals) x
             WINDOW b AS (PARTITION BY kpi_key, dimension, dimension_value ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                    a AS (PARTITION BY kpi_key, dimension, dimension_value ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) y""",
    "dense_totals"))
def interpolate_gaps(ctx: Ctx) -> DataFrame:
    """Gap-filled daily totals (linear by position, ends held)."""
    return windows.interpolate_gaps(ctx)


_LAGS = ", ".join(f"lag(value, {k * config.WEEKLY_PERIOD}) OVER w" for k in range(1, config.WEEKDAY_WEEKS + 1))


@register("weekday_effect_recent", with_ctes(
    f"""SELECT kpi_key, dimension, dimension_value, kpi_date, value,
               round(CASE WHEN n = 0 THEN NULL WHEN n % 2 = 1 THEN s[CAST((n + 1) / 2 AS INTEGER)]
                          ELSE (s[CAST(n / 2 AS INTEGER)] + s[CAST(n / 2 + 1 AS INTEGER)]) / 2 END + 1e-13, 9) AS same_weekday_median
        FROM (SELECT *, len(s) AS n FROM (
                SELECT *, list_sort(list_filter([{_LAGS}], lambda x: x IS NOT NULL)) AS s FROM dense_totals
                WINDOW w AS (PARTITION BY kpi_key, dimension, dimension_value ORDER BY kpi_date)) a) b""",
    "dense_totals"))
def weekday_effect_recent(ctx: Ctx) -> DataFrame:
    """Median of the same weekday over the last four weeks."""
    return windows.weekday_effect_recent(ctx)


@register("trailing_counts", """
    SELECT event_id, user_id, ts,
           count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW) AS events_last_hour
    FROM events""")
def trailing_counts(ctx: Ctx) -> DataFrame:
    """Per-client events in the trailing hour at each event (hour-bucket partitions)."""
    return windows.trailing_counts(ctx)


@register("stl_seasonal")
def stl_seasonal(ctx: Ctx) -> DataFrame:
    """Weekly STL component of each KPI total over its whole history (rows-only)."""
    return windows.stl_seasonal(ctx)
