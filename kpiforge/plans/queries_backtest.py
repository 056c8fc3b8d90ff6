"""Registered queries: detector evaluation by injection (rows-only: the scores come from the
STL kernel, which SQL cannot express)."""

from __future__ import annotations

from pyspark.sql import DataFrame

from kpiforge.context import Ctx
from kpiforge.operators import backtest
from kpiforge.plans.catalog import register


@register("robust_sigma")
def robust_sigma(ctx: Ctx) -> DataFrame:
    """Robust one-step error spread of each KPI total (sizes the injected spikes)."""
    return backtest.robust_sigma(ctx)


@register("injection_days")
def injection_days(ctx: Ctx) -> DataFrame:
    """One injected day per 10-day chunk of evaluation days (inner six days)."""
    return backtest.injection_days(ctx)


@register("inject_spikes")
def inject_spikes(ctx: Ctx) -> DataFrame:
    """Series with +/- 6 sigma spikes on the injection days."""
    return backtest.dirty_series(ctx)


@register("online_scores")
def online_scores(ctx: Ctx) -> DataFrame:
    """|score| of every evaluation day, clean and dirty, each day seeing its past only."""
    return backtest.online_scores(ctx)


@register("backtest_thresholds")
def backtest_thresholds(ctx: Ctx) -> DataFrame:
    """Days, injected, hits and false alarms per KPI and candidate threshold."""
    return backtest.backtest_thresholds(ctx)


@register("calibrate_threshold")
def calibrate_threshold(ctx: Ctx) -> DataFrame:
    """Calibrated threshold per KPI (<= 2 false alarms per 30 days, else the largest)."""
    return backtest.calibrate(backtest.backtest_thresholds(ctx))


@register("backtest_summary")
def backtest_summary(ctx: Ctx) -> DataFrame:
    """Overall hit rate and false alarms per KPI and month at the calibrated thresholds."""
    return backtest.summary(backtest.calibrate(backtest.backtest_thresholds(ctx)))
