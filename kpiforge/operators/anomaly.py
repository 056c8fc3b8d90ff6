"""Anomaly detection over the KPI marts, for every evaluation day at once (backfill).

Plan (all distributed, no driver loop over KPIs or days):
1. ``alert_series``: daily KPI rows of the alerting KPIs (registry broadcast: bounded by the
   number of KPIs), totals and the members of additive KPIs.
2. ``monitor_targets_daily``: per KPI and day, the total plus the top members by volume over
   the trailing 120 days (rolling window sums on a per-member day spine, rank per day).
3. ``score_days``: each (series, day) value is copied to the 120-day evaluation buckets whose
   trailing windows contain it (about 2 copies) -- the range join made an equi-join -- and
   ``applyInPandas`` per (series, bucket) scores all target days of the bucket with the
   batched STL kernel. Group size is bounded by 239 days, independent of the data volume.
4. ``robust_score_core``: the same score with the weekly component fixed at zero, by sliding order
   statistics over the same buckets (checkable against SQL).
5. Threshold detection on the monthly mart is plain SQL-able DataFrame code.
"""

from __future__ import annotations

from datetime import date

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kpiforge import config
from kpiforge.context import Ctx, model
from kpiforge.functions import orderstat, stl
from kpiforge.functions.columns import threshold_severity
from kpiforge.operators import kpi
from kpiforge.sources.registry import registry_df

BUCKET_DAYS = 120
SERIES_KEYS = ["kpi_key", "dimension", "dimension_value"]


def day_number(d: Column) -> Column:
    return F.datediff(d, F.lit(date(1970, 1, 1)))


@model
def registry(ctx: Ctx) -> DataFrame:
    return registry_df(ctx.spark)


@model
def alert_series(ctx: Ctx) -> DataFrame:
    """Daily rows of stl_mad KPIs: totals, and members of the KPI's entity type."""
    reg = F.broadcast(
        registry(ctx)
        .filter(F.col("alert_method") == "stl_mad")
        .select(F.col("key").alias("kpi_key"), "entity_type", "alert_threshold", "min_history_days", "unit")
    )
    d = kpi.kpi_daily(ctx).join(reg, "kpi_key")
    return d.filter((F.col("dimension") == "total") | (F.col("dimension") == F.col("entity_type")))


@model(table=True)
def monitor_targets_daily(ctx: Ctx) -> DataFrame:
    """T01 for every day: total + top members by trailing-120-day volume.

    Daily member series are monitored only for additive KPIs (ratio members are too noisy).
    Volume = coalesce(sum(denominator), sum(numerator)), DESC NULLS LAST, ties by member.
    """
    rows = alert_series(ctx)
    totals = rows.filter(F.col("dimension") == "total").select(
        *SERIES_KEYS, "entity_id", F.col("kpi_date").alias("eval_day"), F.lit(0).alias("member_rank")
    )
    members = rows.filter(F.col("dimension") != "total")
    additive = members.groupBy("kpi_key").agg(F.bool_and(F.col("aggregation") == "sum").alias("additive"))
    members = members.join(additive.filter("additive").select("kpi_key"), "kpi_key", "left_semi")
    # Per-member day spine from its first row to the as-of date (explode, no cross join).
    spans = members.groupBy(*SERIES_KEYS, "entity_id").agg(F.min("kpi_date").alias("first_day"))
    spine = spans.select(
        *SERIES_KEYS, "entity_id",
        F.explode(F.sequence("first_day", F.lit(ctx.sim_date), F.expr("INTERVAL 1 DAY"))).alias("kpi_date"),
    )
    dense = spine.join(
        members.select(*SERIES_KEYS, "kpi_date", "numerator", "denominator"), [*SERIES_KEYS, "kpi_date"], "left"
    )
    trailing = Window.partitionBy(*SERIES_KEYS).orderBy("kpi_date").rowsBetween(-(config.WINDOW_DAYS - 1), 0)
    vol = dense.select(
        *SERIES_KEYS, "entity_id", "kpi_date",
        F.sum("numerator").over(trailing).alias("num120"),
        F.sum("denominator").over(trailing).alias("den120"),
        F.count("numerator").over(trailing).alias("rows120"),
        F.col("numerator").isNotNull().alias("has_row"),
    ).filter(F.col("rows120") > 0)
    rank = Window.partitionBy("kpi_key", "dimension", "kpi_date").orderBy(
        F.coalesce("den120", "num120").desc_nulls_last(), F.col("dimension_value")
    )
    top = vol.withColumn("member_rank", F.row_number().over(rank)).filter(
        (F.col("member_rank") <= config.TOP_MEMBERS) & F.col("has_row")
    )
    return totals.unionByName(
        top.select(*SERIES_KEYS, "entity_id", F.col("kpi_date").alias("eval_day"), "member_rank")
    )


@model(table=True)
def robust_scores(ctx: Ctx) -> DataFrame:
    """Robust seasonal score of every monitored (series, day); members get the
    stricter member threshold."""
    keys = [*SERIES_KEYS, "entity_id"]
    threshold = F.col("alert_threshold") * F.when(F.col("dimension") == "total", F.lit(1.0)).otherwise(
        F.lit(config.MEMBER_THRESHOLD_FACTOR)
    )
    values = alert_series(ctx).select(*keys, "kpi_date", "value", threshold.alias("threshold"), "min_history_days")
    targets = monitor_targets_daily(ctx).select(*keys, F.col("eval_day").alias("kpi_date"))
    return score_days(values, targets, keys)


def _direction(observed: Column, expected: Column) -> Column:
    return F.when(observed >= expected, F.lit("up")).otherwise(F.lit("down"))


def _deviation_pct(observed: Column, expected: Column) -> Column:
    return F.when(expected != 0, F.round((observed - expected) / F.abs(expected) * 100, 2))


@model
def detect_daily(ctx: Ctx) -> DataFrame:
    """Anomalies of the daily detector with registry metadata; ratio expectations are
    clamped to [0, 1] before direction and deviation are derived."""
    reg = F.broadcast(registry(ctx).select(F.col("key").alias("kpi_key"), "label", "unit", "data_class"))
    s = robust_scores(ctx).filter(F.col("severity").isNotNull()).join(reg, "kpi_key")
    expected = F.when(F.col("unit") == "ratio", F.least(F.greatest(F.col("expected"), F.lit(0.0)), F.lit(1.0))).otherwise(
        F.col("expected")
    )
    return s.select(
        F.lit("anomaly").alias("type"),
        "kpi_key",
        "dimension",
        "dimension_value",
        "entity_id",
        F.col("eval_day").alias("period_start"),
        F.col("eval_day").alias("period_end"),
        F.lit("day").alias("grain"),
        "severity",
        F.col("observed"),
        expected.alias("expected"),
        F.round(F.col("score"), 3).alias("score"),
        F.lit("stl_mad").alias("method"),
        F.lit(None).cast("double").alias("evidence_threshold"),
        "label",
        "unit",
        "data_class",
    ).select(
        "*",
        _direction(F.col("observed"), F.col("expected")).alias("direction"),
        _deviation_pct(F.col("observed"), F.col("expected")).alias("deviation_pct"),
    )


@model
def monthly_targets(ctx: Ctx) -> DataFrame:
    """T01 (monthly): per threshold KPI and complete month, the total plus the top members by
    coalesce(sum(denominator), sum(numerator)); ratio members are allowed at month grain."""
    reg = F.broadcast(
        registry(ctx).filter(F.col("alert_method") == "threshold").select(
            F.col("key").alias("kpi_key"), "entity_type", "alert_threshold"
        )
    )
    m = kpi.kpi_monthly(ctx).join(reg, "kpi_key")
    m = m.filter((F.col("dimension") == "total") | (F.col("dimension") == F.col("entity_type")))
    rank = Window.partitionBy("kpi_key", "dimension", "month_start").orderBy(
        F.coalesce("denominator", "numerator").desc_nulls_last(), F.col("dimension_value")
    )
    ranked = m.withColumn("member_rank", F.when(F.col("dimension") == "total", F.lit(0)).otherwise(F.row_number().over(rank)))
    return ranked.filter(F.col("member_rank") <= config.TOP_MEMBERS)


@model
def detect_monthly(ctx: Ctx) -> DataFrame:
    """|value| / bound on every complete month (backfill of the monthly rule)."""
    reg = F.broadcast(registry(ctx).select(F.col("key").alias("kpi_key"), "label", "unit", "data_class"))
    t = monthly_targets(ctx).filter(F.col("is_complete") & F.col("value").isNotNull())
    score = F.abs(F.col("value")) / F.col("alert_threshold")
    s = t.select("*", score.alias("raw_score")).filter(F.col("raw_score") >= 1).join(reg, "kpi_key")
    return s.select(
        F.lit("anomaly").alias("type"),
        "kpi_key",
        "dimension",
        "dimension_value",
        "entity_id",
        F.col("month_start").alias("period_start"),
        F.last_day("month_start").alias("period_end"),
        F.lit("month").alias("grain"),
        threshold_severity(F.col("raw_score")).alias("severity"),
        F.round(F.col("value"), 6).alias("observed"),
        F.lit(0.0).alias("expected"),
        F.round(F.col("raw_score"), 3).alias("score"),
        F.lit("threshold").alias("method"),
        F.col("alert_threshold").alias("evidence_threshold"),
        "label",
        "unit",
        "data_class",
        _direction(F.col("value"), F.lit(0.0)).alias("direction"),
        F.lit(None).cast("double").alias("deviation_pct"),
    )


@model
def series_densify(ctx: Ctx) -> DataFrame:
    """Every monitored (series, evaluation day) with its trailing 120 days as rows
    (NULL where the series has no value). The range join is made an equi-join by exploding
    each target into its window days; windows hold exactly 120 rows whatever the data size."""
    t = monitor_targets_daily(ctx).select(*SERIES_KEYS, "eval_day")
    days = t.select(
        *SERIES_KEYS, "eval_day",
        F.explode(F.sequence(F.date_sub("eval_day", config.WINDOW_DAYS - 1), F.col("eval_day"), F.expr("INTERVAL 1 DAY"))).alias("day"),
    )
    values = alert_series(ctx).select(*SERIES_KEYS, F.col("kpi_date").alias("day"), "value")
    return days.join(values, [*SERIES_KEYS, "day"], "left")


def _spread_group(pdf: pd.DataFrame) -> pd.DataFrame:
    """Level and error spread of every target day of one (series, bucket) group."""
    lo = int(pdf["bucket"].iloc[0]) * BUCKET_DAYS - (config.WINDOW_DAYS - 1)
    values = np.full(BUCKET_DAYS + config.WINDOW_DAYS - 1, np.nan)
    values[pdf["day_num"].to_numpy() - lo] = pdf["value"].to_numpy(dtype=float)
    targets = np.sort(pdf.loc[pdf["is_target"], "day_num"].to_numpy()) - lo
    rows = orderstat.error_spread(values, targets.tolist(), config.WINDOW_DAYS, config.LEVEL_DAYS)
    out = pd.DataFrame(rows, columns=["level", "history", "errors", "center", "mad"])
    out.insert(0, "observed", values[targets])
    out.insert(0, "eval_day", pd.to_datetime(targets + lo, unit="D").date)
    for k in reversed(SERIES_KEYS):
        out.insert(0, k, pdf[k].iloc[0])
    return out


@model
def robust_score_core(ctx: Ctx) -> DataFrame:
    """T02/T04-T07 with the weekly component fixed at zero: causal level (median of the previous 14
    days, at least 7 present), one-step errors, center = median, scale = 1.4826 x MAD with the 1 % level
    floor, applicability gates, score. The medians slide over each series (``functions.orderstat``):
    a value row is copied to about two buckets of days, not to the 120 windows that hold it."""
    reg = F.broadcast(registry(ctx).select(F.col("key").alias("kpi_key"), "min_history_days"))
    win = [*SERIES_KEYS, "eval_day"]
    values = alert_series(ctx).select(*SERIES_KEYS, "kpi_date", "value")
    targets = monitor_targets_daily(ctx).select(*SERIES_KEYS, F.col("eval_day").alias("kpi_date"))
    schema = ", ".join(f"{k} string" for k in SERIES_KEYS) + (
        ", eval_day date, observed double, level double, history long, errors long, center double, mad double"
    )
    spread = bucketed(values, targets, SERIES_KEYS).groupBy(*SERIES_KEYS, "bucket").applyInPandas(_spread_group, schema)
    known = {c: F.nanvl(c, F.lit(None)) for c in ("observed", "level", "center", "mad")}
    agg = spread.withColumns(known).join(reg, "kpi_key")
    scale = F.greatest(
        F.lit(config.MAD_TO_SIGMA) * F.col("mad"), F.lit(config.SCALE_FLOOR) * F.abs(F.col("level")), F.lit(1e-9)
    )
    ok = (
        F.col("observed").isNotNull()
        & (F.col("history") >= F.col("min_history_days"))
        & (F.col("errors") >= F.floor(F.col("min_history_days") / 2))
        & F.col("level").isNotNull()
        & F.col("mad").isNotNull()
    )
    s = agg.filter(ok).select(*win, "observed", "level", "center", scale.alias("scale"))
    s = s.select("*", (F.col("level") + F.col("center")).alias("expected"))
    return s.select(
        *win,
        *[_tie_safe_round(F.col(c), 9).alias(c) for c in ("observed", "level", "center", "scale", "expected")],
        _tie_safe_round((F.col("observed") - F.col("expected")) / F.col("scale"), 9).alias("score"),
    )


@model
def detect_core(ctx: Ctx) -> DataFrame:
    """T08/T10 on the core scores: daily anomalies, members with the stricter threshold, ratio expectations clamped
    to [0, 1] before direction and deviation are derived."""
    reg = F.broadcast(registry(ctx).select(F.col("key").alias("kpi_key"), "label", "unit", "data_class", "alert_threshold"))
    factor = F.when(F.col("dimension") == "total", 1.0).otherwise(config.MEMBER_THRESHOLD_FACTOR)
    s = robust_score_core(ctx).join(reg, "kpi_key").withColumn("bound", F.col("alert_threshold") * factor)
    s = s.filter(F.abs("score") >= F.col("bound"))
    expected = F.when(F.col("unit") == "ratio", F.least(F.greatest("expected", F.lit(0.0)), F.lit(1.0))).otherwise(F.col("expected"))
    critical = F.abs("score") >= F.col("bound") * config.CRITICAL_FACTOR
    return s.select(
        F.lit("anomaly").alias("type"), "kpi_key", "dimension", "dimension_value",
        kpi.kpi_entity_id(F.col("dimension"), F.col("dimension_value"), F.col("kpi_key")).alias("entity_id"),
        F.col("eval_day").alias("period_start"), F.col("eval_day").alias("period_end"), F.lit("day").alias("grain"),
        F.when(critical, "critical").otherwise("warning").alias("severity"),
        "observed", expected.alias("expected"), F.round("score", 3).alias("score"), F.lit("median_mad").alias("method"),
        F.lit(None).cast("double").alias("evidence_threshold"), "label", "unit", "data_class",
    ).select(
        "*", _direction(F.col("observed"), F.col("expected")).alias("direction"),
        _deviation_pct(F.col("observed"), F.col("expected")).alias("deviation_pct"),
    )


def _tie_safe_round(x: Column, digits: int) -> Column:
    """Round after a 1e-13 nudge: values that sit exactly on a decimal half-way point (common
    for medians of short decimals) then round the same way in every engine."""
    return F.round(x + F.lit(1e-13), digits)


def _bucket_scorer(keys: list[str]):
    """pandas function scoring every target day of one (series, bucket) group."""
    out_cols = [*keys, "eval_day", "observed", "expected", "score", "severity", "threshold"]

    def score(pdf: pd.DataFrame) -> pd.DataFrame:
        targets = np.sort(pdf.loc[pdf["is_target"], "day_num"].to_numpy())
        if targets.size == 0:
            return pd.DataFrame(columns=out_cols)
        lo = int(pdf["bucket"].iloc[0]) * BUCKET_DAYS - (config.WINDOW_DAYS - 1)
        arr = np.full(BUCKET_DAYS + config.WINDOW_DAYS - 1, np.nan)
        arr[pdf["day_num"].to_numpy() - lo] = pdf["value"].to_numpy(dtype=float)
        starts = targets - lo - (config.WINDOW_DAYS - 1)
        windows = np.stack([arr[s : s + config.WINDOW_DAYS] for s in starts])
        threshold = float(pdf["threshold"].iloc[0])
        res = stl.stl_mad_batch(
            windows,
            np.full(len(starts), threshold),
            np.full(len(starts), int(pdf["min_history_days"].iloc[0])),
            level_days=config.LEVEL_DAYS,
            weekday_weeks=config.WEEKDAY_WEEKS,
            scale_floor=config.SCALE_FLOOR,
            mad_to_sigma=config.MAD_TO_SIGMA,
            critical_factor=config.CRITICAL_FACTOR,
        )
        ok = res["ok"]
        first = pdf.iloc[0]
        data = {k: first[k] for k in keys}
        data.update(
            eval_day=pd.to_datetime(targets[ok], unit="D").date,
            observed=res["observed"][ok],
            expected=res["expected"][ok],
            score=res["score"][ok],
            severity=np.where(res["severity"][ok] == "", None, res["severity"][ok]),
            threshold=threshold,
        )
        return pd.DataFrame(data, columns=out_cols)

    schema = ", ".join(f"{k} string" for k in keys) + (
        ", eval_day date, observed double, expected double, score double, severity string, threshold double"
    )
    return score, schema


def bucketed(values: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    """Every value row in the 120-day buckets whose trailing windows contain it (about 2 copies: the
    range join made an equi-join), for buckets with a target day.

    ``values``: keys + kpi_date and what else is needed (string keys); ``targets``: keys + kpi_date.
    The result has bucket, day_num and is_target instead of the date; a group (keys, bucket) holds at
    most 239 days whatever the data volume.
    """
    t = targets.select(*keys, "kpi_date", F.lit(True).alias("_t"))
    dn = day_number(F.col("kpi_date"))
    rest = [c for c in values.columns if c not in keys and c != "kpi_date"]
    exploded = values.join(t, [*keys, "kpi_date"], "left").select(
        *keys,
        dn.alias("day_num"),
        *rest,
        F.coalesce(F.col("_t"), F.lit(False)).alias("_t"),
        F.explode(F.sequence(F.floor(dn / BUCKET_DAYS), F.floor((dn + config.WINDOW_DAYS - 1) / BUCKET_DAYS))).alias("bucket"),
    ).select("*", (F.col("_t") & (F.floor(F.col("day_num") / BUCKET_DAYS) == F.col("bucket"))).alias("is_target")).drop("_t")
    live = exploded.filter("is_target").select(*keys, "bucket").distinct()
    return exploded.join(live, [*keys, "bucket"], "left_semi")


def score_days(values: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    """Robust seasonal score of every target (series, day), each day seeing only its own
    trailing window. ``values``: keys + kpi_date, value, threshold, min_history_days; ``targets``: keys + kpi_date.
    """
    fn, schema = _bucket_scorer(keys)
    return bucketed(values, targets, keys).groupBy(*keys, "bucket").applyInPandas(fn, schema)
