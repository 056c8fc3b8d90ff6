"""Scalar column expressions shared by the models (all built-in, JVM-side)."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

from kpiforge import config

KPI_DEC = "decimal(38,6)"


def col_or_name(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_ratio(numerator: Column | str, denominator: Column | str, digits: int = 6) -> Column:
    """round(n / nullif(d, 0), digits) computed in double (ANSI mode would raise on d = 0)."""
    n = col_or_name(numerator).cast("double")
    d = col_or_name(denominator).cast("double")
    return F.round(n / F.nullif(d, F.lit(0.0)), digits)


def kpi_value(aggregation: Column | str, numerator: Column | str, denominator: Column | str) -> Column:
    """value = numerator for additive KPIs, else the rounded ratio."""
    agg = col_or_name(aggregation)
    return F.when(agg == "sum", col_or_name(numerator).cast("double")).otherwise(
        safe_ratio(numerator, denominator)
    )


def elapsed_days(later: Column | str, earlier: Column | str, digits: int = 3) -> Column:
    """Elapsed days between two timestamps, rounded (no `extract(epoch ...)` in Spark)."""
    secs = F.expr(f"timestampdiff(SECOND, {_sql(earlier)}, {_sql(later)})")
    return F.round(secs.cast("decimal(20,0)") / F.lit(86400), digits).cast("decimal(12,3)")


def _sql(c: Column | str) -> str:
    if isinstance(c, str):
        return f"`{c}`"
    raise TypeError("elapsed_days takes column names")


def as_of_visible(ts: Column | str, sim_date: date) -> Column:
    """Timestamp if it lies before the end of the simulated day, else NULL."""
    c = col_or_name(ts)
    return F.when(c < F.lit(_day_after(sim_date)), c)


def _day_after(d: date):
    from datetime import datetime

    return datetime.combine(d + timedelta(days=1), datetime.min.time())


def day_after_ts(d: date):
    return _day_after(d)


def entity_id(prefix: str, value: Column | str) -> Column:
    return F.concat(F.lit(prefix + ":"), col_or_name(value).cast("string"))


def rank_of(value: Column | str, ranks: dict[str, int], default: int = 0) -> Column:
    """Ordinal rank of a severity / data class via a CASE chain."""
    c = col_or_name(value)
    expr = None
    for name, rank in ranks.items():
        expr = F.when(c == name, F.lit(rank)) if expr is None else expr.when(c == name, F.lit(rank))
    return expr.otherwise(F.lit(default))


def severity_rank(value: Column | str) -> Column:
    return rank_of(value, config.SEVERITY_RANK)


def data_class_rank(value: Column | str) -> Column:
    return rank_of(value, config.DATA_CLASS_RANK)


def change_abs(current: Column, previous: Column) -> Column:
    return F.when(current.isNotNull() & previous.isNotNull(), F.round(current - previous, 6))


def change_pct(current: Column, previous: Column, digits: int = 2) -> Column:
    return F.when(
        current.isNotNull() & previous.isNotNull() & (previous != 0),
        F.round((current - previous) / F.abs(previous) * 100, digits),
    )


def severity_from_score(score: Column, threshold: Column) -> Column:
    """warning at |score| >= threshold, critical at >= 1.5 x threshold, else NULL."""
    a = F.abs(score)
    return F.when(a >= threshold * config.CRITICAL_FACTOR, F.lit("critical")).when(a >= threshold, F.lit("warning"))


def threshold_severity(score: Column) -> Column:
    return F.when(score >= 2, F.lit("critical")).when(score >= 1, F.lit("warning"))


def latest_complete_month(d: Column) -> Column:
    """First day of the latest month that is complete on date d."""
    first = F.trunc(d, "month")
    return F.when(F.last_day(d) == d, first).otherwise(F.add_months(first, -1))


def budget_round(x: Column) -> Column:
    """Round to a multiple of 100 with a floor of 100."""
    return F.greatest(F.round(x / F.lit(100), 0), F.lit(1)) * F.lit(100)


def canonical_json(*cols: str) -> Column:
    """JSON object of the given columns with keys in sorted order, no spaces."""
    return F.to_json(F.struct(*[F.col(c) for c in sorted(cols)]))


def drop_json_field(payload: Column, schema: str, path: str) -> Column:
    """the payload without one nested field (parse with the schema, dropFields, JSON)."""
    parsed = F.from_json(payload, schema)
    parent, _, leaf = path.rpartition(".")
    if not parent:
        return F.to_json(parsed.dropFields(leaf))
    return F.to_json(parsed.withField(parent, parsed.getField(parent).dropFields(leaf)))


DATE_PRESETS = {"7d": 7, "30d": 30, "90d": 90, "365d": 365}


def preset_window(end: Column, preset: str, grain: str = "day") -> tuple[Column, Column]:
    """(start, end) of a preset window ending at ``end``; month grain snaps to months."""
    days = DATE_PRESETS[preset]
    start = F.date_sub(end, days - 1)
    if grain == "month":
        return F.trunc(start, "month"), F.trunc(end, "month")
    return start, end


def de_number(x: Column, digits: int) -> Column:
    """German number format: 1.234,50 (NULL stays NULL)."""
    return F.translate(F.format_number(x, digits), ",.", ".,")
