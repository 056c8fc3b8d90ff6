"""Seasonal component over the whole history; the backtest's window as an argument (sf0.001)."""

from __future__ import annotations

from datetime import date

import numpy as np

from kpiforge.context import Ctx
from kpiforge.functions import stl
from kpiforge.operators import backtest, windows

SF = "/root/testdata/sf0.001"


def test_every_day_gets_a_seasonal_component(spark):
    ctx = Ctx.of(spark, SF)
    days = windows.dense_totals(ctx).toPandas()
    got = windows.stl_seasonal(ctx).toPandas()
    assert got.groupby("kpi_key").size().to_dict() == days.groupby("kpi_key").size().to_dict()
    assert got.groupby("kpi_key").kpi_date.min().to_dict() == days.groupby("kpi_key").kpi_date.min().to_dict()
    assert got.groupby("kpi_key").size().max() > 365 + 119
    known = got[got.kpi_key.isin(days[days.value.notna()].kpi_key)]
    assert known.seasonal.notna().all()


def test_long_rows_are_fitted_like_short_ones(monkeypatch):
    rng = np.random.default_rng(3)
    n = 700
    y = 50 + np.arange(n) / 20 + 5 * np.sin(2 * np.pi * np.arange(n) / 7) + rng.normal(size=(2, n))
    y[:, 100] += 40
    banded = stl.stl_seasonal(y)
    monkeypatch.setattr(stl, "DENSE_DAYS", n)
    assert np.allclose(banded, stl.stl_seasonal(y), atol=1e-6)


def test_backtest_window_is_an_argument(spark):
    ctx = Ctx.of(spark, SF, eval_start=date(1997, 1, 1), eval_end=date(1997, 3, 31))
    days = backtest.eval_days(ctx).toPandas().day
    assert len(days) and days.min() >= date(1997, 1, 1) and days.max() <= date(1997, 3, 31)
