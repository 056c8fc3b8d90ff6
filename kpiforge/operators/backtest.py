"""Detector evaluation by injection (distributed; no loop over KPIs, days or thresholds).

1. Evaluation days per KPI total: days in [start, end] with a value.
2. Series-wide robust error sigma per KPI (one bounded group per KPI: its history up to end).
3. Injection days: the eval days are cut into chunks of 10 by position; one of the inner six
   days of each chunk is picked by a hash of (kpi, chunk, seed); the spike is
   +/- magnitude x sigma with the sign from another hash. Deterministic for a seed (a hash
   stream, not the reference's random-number stream).
4. Clean and dirty series are scored online (every eval day sees only its own history) with
   the same bucketed STL scoring as the detector.
5. Each (kpi, day) score is expanded to the candidate thresholds with an explode (no cross
   join) and counted: hits, false alarms on clean / dirty data; calibration picks the smallest
   threshold with at most 2 false alarms per 30 days, else the largest.
"""

from __future__ import annotations

from datetime import date, timedelta

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kpiforge import config
from kpiforge.context import Ctx, model
from kpiforge.functions import stl
from kpiforge.operators import anomaly

SPACING = 10
SEED = 42
MAGNITUDE = 6.0


def window(ctx: Ctx) -> tuple[date, date]:
    end = ctx.eval_end or ctx.sim_date
    return ctx.eval_start or end - timedelta(days=364), end


@model
def totals(ctx: Ctx) -> DataFrame:
    """Total series of the stl_mad KPIs (kpi_key, day, value, threshold, min history)."""
    s = anomaly.alert_series(ctx).filter(F.col("dimension") == "total")
    return s.select("kpi_key", F.col("kpi_date").alias("day"), "value", F.col("alert_threshold").alias("threshold"), "min_history_days")


@model
def eval_days(ctx: Ctx) -> DataFrame:
    start, end = window(ctx)
    t = totals(ctx).filter(F.col("day").between(F.lit(start), F.lit(end)) & F.col("value").isNotNull())
    pos = Window.partitionBy("kpi_key").orderBy("day")
    return t.select("kpi_key", "day", (F.row_number().over(pos) - 1).alias("pos"))


def _sigma_group(pdf: pd.DataFrame) -> pd.DataFrame:
    values = pdf.sort_values("day")["value"].to_numpy(dtype=float)
    values = values[~np.isnan(values)]
    sigma = stl.robust_error_sigma(values) if values.size >= 2 * stl.PERIOD else float("nan")
    return pd.DataFrame({"kpi_key": [pdf["kpi_key"].iloc[0]], "sigma": [sigma]})


@model
def robust_sigma(ctx: Ctx) -> DataFrame:
    """Robust spread of the causal one-step errors of each KPI total over the evaluation
    window and its 120-day lead-in (one group per KPI, bounded by the calendar)."""
    start, end = window(ctx)
    t = totals(ctx).filter(F.col("day").between(F.lit(start - timedelta(days=config.WINDOW_DAYS)), F.lit(end)))
    return t.select("kpi_key", "day", "value").groupBy("kpi_key").applyInPandas(_sigma_group, "kpi_key string, sigma double")


def _hash01(*cols) -> F.Column:
    """Deterministic uniform-ish integer in [0, 2^31) from the columns and the seed."""
    return F.pmod(F.xxhash64(*cols, F.lit(SEED)), F.lit(2**31))


@model
def injection_days(ctx: Ctx) -> DataFrame:
    """One injected day per 10-day chunk of eval days, among the chunk's inner six."""
    e = eval_days(ctx).select("*", F.floor(F.col("pos") / SPACING).alias("chunk"))
    size = e.groupBy("kpi_key", "chunk").agg(F.count(F.lit(1)).alias("n"))
    e = e.join(size, ["kpi_key", "chunk"])
    inner = F.least(F.col("n") - 2, F.lit(SPACING - 2)) - 2  # number of candidate positions
    pick = F.lit(2) + F.pmod(_hash01(F.col("kpi_key"), F.col("chunk")), F.greatest(inner, F.lit(1)))
    chosen = e.filter((inner > 0) & ((F.col("pos") - F.col("chunk") * SPACING) == pick))
    sign = F.when(F.pmod(_hash01(F.col("kpi_key"), F.col("chunk"), F.lit("sign")), F.lit(2)) == 0, F.lit(-1.0)).otherwise(F.lit(1.0))
    return chosen.select("kpi_key", "day", sign.alias("sign"))


@model
def dirty_series(ctx: Ctx) -> DataFrame:
    """The series with +/- magnitude x sigma added on the injection days."""
    inj = injection_days(ctx).join(robust_sigma(ctx), "kpi_key")
    t = totals(ctx).join(inj, ["kpi_key", "day"], "left")
    bump = F.coalesce(F.col("sign") * F.lit(MAGNITUDE) * F.col("sigma"), F.lit(0.0))
    return t.select("kpi_key", "day", (F.col("value") + bump).alias("value"), "threshold", "min_history_days")


@model
def online_scores(ctx: Ctx) -> DataFrame:
    """|score| of every eval day on clean and dirty data (each day sees only its past)."""
    clean = totals(ctx).withColumn("variant", F.lit("clean"))
    dirty = dirty_series(ctx).withColumn("variant", F.lit("dirty"))
    values = clean.unionByName(dirty).select(
        "kpi_key", "variant", F.lit("total").alias("dimension"), F.col("day").alias("kpi_date"), "value", "threshold", "min_history_days"
    )
    targets = eval_days(ctx).select("kpi_key", F.col("day").alias("kpi_date"))
    targets = targets.withColumn("variant", F.explode(F.array(F.lit("clean"), F.lit("dirty"))))
    scored = anomaly.score_days(values, targets, ["kpi_key", "variant"])
    return scored.select("kpi_key", "variant", F.col("eval_day").alias("day"), F.abs(F.col("score")).alias("score"))


@model
def backtest_thresholds(ctx: Ctx) -> DataFrame:
    """Per KPI and candidate threshold: days, injected, hits, false alarms."""
    reg = anomaly.registry(ctx).filter(F.col("alert_method") == "stl_mad").select(
        F.col("key").alias("kpi_key"), F.col("alert_threshold").alias("registry_threshold")
    )
    cands = F.array_distinct(F.array(*[F.lit(float(t)) for t in config.THRESHOLD_CANDIDATES], F.col("registry_threshold")))
    thresholds = F.broadcast(reg).select("kpi_key", F.explode(cands).alias("threshold"))
    days = eval_days(ctx).groupBy("kpi_key").agg(F.count(F.lit(1)).alias("days"))
    inj = injection_days(ctx).select("kpi_key", "day", F.lit(True).alias("injected"))
    sc = online_scores(ctx).join(inj, ["kpi_key", "day"], "left")
    # each score row against every candidate of its KPI (a handful per KPI)
    per = sc.join(F.broadcast(thresholds), "kpi_key")
    flagged = F.col("score") >= F.col("threshold")
    is_inj = F.coalesce(F.col("injected"), F.lit(False))
    counts = per.groupBy("kpi_key", "threshold").agg(
        F.count_if((F.col("variant") == "dirty") & flagged & is_inj).alias("hits"),
        F.count_if((F.col("variant") == "clean") & flagged).alias("false_alarms_clean"),
        F.count_if((F.col("variant") == "dirty") & flagged & ~is_inj).alias("false_alarms_injected"),
    )
    n_inj = injection_days(ctx).groupBy("kpi_key").agg(F.count(F.lit(1)).alias("injected"))
    out = thresholds.join(days, "kpi_key").join(n_inj, "kpi_key", "left").join(counts, ["kpi_key", "threshold"], "left")
    return out.select(
        "kpi_key", "threshold", "days",
        F.coalesce("injected", F.lit(0)).alias("injected"),
        F.coalesce("hits", F.lit(0)).alias("hits"),
        F.coalesce("false_alarms_clean", F.lit(0)).alias("false_alarms_clean"),
        F.coalesce("false_alarms_injected", F.lit(0)).alias("false_alarms_injected"),
    )


def calibrate(results: DataFrame) -> DataFrame:
    """Smallest threshold with clean false alarms per 30 days <= 2, else the largest."""
    fa_month = F.col("false_alarms_clean") / F.col("days") * 30
    g = results.groupBy("kpi_key").agg(
        F.min(F.when(fa_month <= config.MAX_FALSE_ALARMS_PER_MONTH, F.col("threshold"))).alias("ok_threshold"),
        F.max("threshold").alias("max_threshold"),
    )
    chosen = g.select("kpi_key", F.coalesce("ok_threshold", "max_threshold").alias("threshold"))
    return results.join(chosen, ["kpi_key", "threshold"]).select(
        "*",
        F.when(F.col("injected") > 0, F.round(F.col("hits") / F.col("injected"), 4)).alias("hit_rate"),
        F.round(F.col("false_alarms_clean") / F.col("days") * 30, 4).alias("fa_per_month_clean"),
        F.round(F.col("false_alarms_injected") / F.col("days") * 30, 4).alias("fa_per_month_injected"),
    )


def summary(results: DataFrame) -> DataFrame:
    """Overall hit rate and clean false alarms per KPI and 30 days."""
    return results.agg(
        F.sum("hits").alias("hits"),
        F.sum("injected").alias("injected"),
        F.round(F.sum("hits") / F.nullif(F.sum("injected"), F.lit(0)), 4).alias("hit_rate"),
        F.round(F.sum("false_alarms_clean") / F.sum("days") * 30, 4).alias("fa_per_month_clean"),
    )
