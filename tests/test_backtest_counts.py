"""Threshold sweep vs a plain recount of the same scores (sf0.001)."""

from __future__ import annotations

from kpiforge.context import Ctx
from kpiforge.operators import backtest

SF = "/root/testdata/sf0.001"


def test_threshold_counts_match_recount(spark):
    ctx = Ctx.of(spark, SF)
    scores = backtest.online_scores(ctx).toPandas()
    inj = backtest.injection_days(ctx).toPandas()
    days = backtest.eval_days(ctx).toPandas()
    res = backtest.backtest_thresholds(ctx).toPandas()
    assert len(res) > 0
    injected = {(r.kpi_key, r.day) for r in inj.itertuples()}
    for r in res.itertuples():
        s = scores[scores.kpi_key == r.kpi_key]
        dirty = s[(s.variant == "dirty") & (s.score >= r.threshold)]
        clean = s[(s.variant == "clean") & (s.score >= r.threshold)]
        hits = sum((r.kpi_key, d) in injected for d in dirty.day)
        assert r.hits == hits
        assert r.false_alarms_injected == len(dirty) - hits
        assert r.false_alarms_clean == len(clean)
        assert r.days == int((days.kpi_key == r.kpi_key).sum())
        assert r.injected == sum(k == r.kpi_key for k, _ in injected)
    # one injection per 10-day chunk at most, on an inner day of its chunk
    for kpi, grp in days.groupby("kpi_key"):
        pos = dict(zip(grp.day, grp.pos))
        chosen = [pos[d] for k, d in injected if k == kpi]
        assert len({p // 10 for p in chosen}) == len(chosen)
        assert all(2 <= p % 10 <= 7 for p in chosen)
