"""Sliding order statistics against numpy."""

from __future__ import annotations

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from kpiforge.functions.orderstat import SortedWindow, error_spread


@given(st.lists(st.integers(-9, 9), min_size=1, max_size=40), st.integers(-9, 9))
@settings(max_examples=200, deadline=None)
def test_sorted_window(numbers, center):
    w = SortedWindow()
    for x in [*numbers, 100, 100]:
        w.add(x)
    w.remove(100)
    w.remove(100)
    assert w.median() == np.median(numbers)
    assert w.deviation_median(center) == np.median(np.abs(np.array(numbers) - center))


def brute(values, t, window, days):
    start = max(t - window + 1, 0)
    own = values[start : t + 1]
    level = [np.median(p[p == p]) if (p == p).sum() >= days // 2 else np.nan for i in range(len(own)) for p in [own[max(0, i - days) : i]]]
    errors = (own - level)[:-1]
    errors = errors[errors == errors]
    center = np.median(errors) if len(errors) else None
    mad = np.median(np.abs(errors - center)) if len(errors) else None
    return level[-1], int((own[:-1] == own[:-1]).sum()), len(errors), center, mad


def test_error_spread_equals_every_window_alone():
    rng = np.random.default_rng(3)
    for gaps in (0.0, 0.3, 0.8):
        values = np.round(rng.normal(size=160), 1)
        values[rng.random(160) < gaps] = np.nan
        for window, days in ((40, 14), (10, 4), (200, 14)):
            targets = sorted(rng.choice(160, 70, replace=False).tolist())
            got = error_spread(values, targets, window, days)
            for t, row in zip(targets, got):
                want = brute(values, t, window, days)
                for a, b in zip(row, want):
                    assert (a is None and b is None) or (a != a and b != b) or abs(a - b) < 1e-12, (t, row, want)
