"""Robust seasonal detector: behaviour on a synthetic weekly series (level 100, weekday
pattern, N(0, 2) noise, 120 days)."""

from __future__ import annotations

from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from kpiforge.functions import stl
from kpiforge.functions.columns import latest_complete_month, severity_from_score, threshold_severity

PATTERN = np.array([0, 5, 8, 6, 3, -10, -12])


def weekly(n: int = 120) -> np.ndarray:
    rng = np.random.default_rng(0)
    return np.array([100 + PATTERN[i % 7] + rng.normal(0, 2) for i in range(n)])


def score(series: np.ndarray, threshold: float = 3.5, min_history: int = 56):
    return stl.stl_mad_batch(series[None, :], np.array([threshold]), np.array([min_history]))


def test_clean_series_is_not_flagged():
    r = score(weekly())
    assert r["ok"][0]
    assert r["severity"][0] == ""


def test_spike_is_critical_and_up():
    s = weekly()
    s[-1] += 40
    r = score(s)
    assert r["severity"][0] == "critical"
    assert r["observed"][0] > r["expected"][0]


def test_gaps_are_tolerated_and_drop_detected():
    s = weekly()
    s[40:45] = np.nan
    s[-1] -= 40
    r = score(s)
    assert r["ok"][0]
    assert r["severity"][0] == "critical"
    assert r["observed"][0] < r["expected"][0]


def test_missing_last_value_gives_no_result():
    s = weekly()
    s[-1] = np.nan
    assert not score(s)["ok"][0]


def test_short_history_gives_no_result():
    s = weekly()
    s[:90] = np.nan  # only 29 days of history left
    assert not score(s)["ok"][0]


def test_weekday_pattern_is_recovered():
    s = weekly()[:119]
    seasonal = stl.stl_seasonal(s[None, :])[0]
    by_weekday = np.array([seasonal[i::7].mean() for i in range(7)])
    assert np.abs(by_weekday - PATTERN).max() < 1.0


def test_batch_equals_single_rows():
    base = weekly()
    spike = base.copy()
    spike[-1] += 40
    both = stl.stl_mad_batch(np.stack([base, spike]), np.array([3.5, 3.5]), np.array([56, 56]))
    single = score(spike)
    assert both["score"][1] == pytest.approx(single["score"][0], rel=1e-12)


def test_threshold_rule_and_severity(spark):
    df = spark.createDataFrame([(0.2,), (-0.3,), (0.6,), (None,)], "v double")
    bound = 0.25
    out = df.select(threshold_severity(F.abs(F.col("v")) / bound).alias("s")).collect()
    assert [r.s for r in out] == [None, "warning", "critical", None]
    sev = spark.createDataFrame([(3.4,), (3.6,), (-5.3,)], "x double").select(
        severity_from_score(F.col("x"), F.lit(3.5)).alias("s")
    )
    assert [r.s for r in sev.collect()] == [None, "warning", "critical"]


def test_latest_complete_month(spark):
    df = spark.createDataFrame([(date(2018, 1, 31),), (date(2018, 2, 1),), (date(2018, 3, 15),)], "d date")
    got = [r.m for r in df.select(latest_complete_month(F.col("d")).alias("m")).collect()]
    assert got == [date(2018, 1, 1), date(2018, 1, 1), date(2018, 2, 1)]
