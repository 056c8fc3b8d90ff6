"""Batched robust STL (seasonal-trend decomposition by LOESS, Cleveland et al. 1990) and the
robust seasonal score, vectorised over many equally long windows at once.

Used inside ``applyInPandas``: one call scores all evaluation days of one (series, bucket)
group, so the per-row Python work is a handful of numpy operations on (B, n) arrays.
Parameters follow the published defaults for a weekly period: seasonal span 7, trend span 15,
low-pass span 9, local-linear fits, every point evaluated, robust fitting with 2 inner and
15 outer iterations and bisquare weights.
"""

from __future__ import annotations

import functools
import warnings

import numpy as np

PERIOD = 7
SEASONAL = 7
TREND = 15
LOW_PASS = 9
INNER = 2
OUTER = 15
#: Rows longer than this are smoothed neighbourhood by neighbourhood instead of by dense (n, n) matrices.
DENSE_DAYS = 512


@functools.lru_cache(maxsize=256)
def _geometry(n: int, q: int, xs: tuple, nleft: tuple, nright: tuple):
    """Static part of a LOESS pass (neighbour indices, tricube weights) for one layout."""
    xs_a, nl, nr = np.array(xs, dtype=float), np.array(nleft), np.array(nright)
    width = int((nr - nl).max()) + 1
    idx = nl[:, None] + np.arange(width)[None, :]
    valid = idx <= nr[:, None]
    idx = np.minimum(idx, n - 1)
    h = np.maximum(xs_a - nl, nr - xs_a).astype(float)
    if q > n:
        h = h + (q - n) // 2
    r = np.abs(idx - xs_a[:, None])
    hh = h[:, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        tri = np.where(r <= 0.001 * hh, 1.0, (1.0 - (r / hh) ** 3) ** 3)
    w = np.where(valid & (r <= 0.999 * hh), tri, 0.0)
    return xs_a, idx, w, h


@functools.lru_cache(maxsize=256)
def _moment_matrices(n: int, q: int, xs: tuple, nleft: tuple, nright: tuple):
    """Dense (n, m) tricube weight matrices W, W*x, W*x^2 for one layout, so a weighted
    local-linear pass over a whole batch is five matrix products."""
    xs_a, idx, w, h = _geometry(n, q, xs, nleft, nright)
    m = len(xs)
    dense = np.zeros((m, n))
    rows = np.repeat(np.arange(m), idx.shape[1])
    np.add.at(dense, (rows, idx.ravel()), w.ravel())
    x = np.arange(n, dtype=float)
    return xs_a, h, dense.T.copy(), (dense * x).T.copy(), (dense * x * x).T.copy()


def _loess(y: np.ndarray, q: int, xs: np.ndarray, nleft: np.ndarray, nright: np.ndarray, rw: np.ndarray | None):
    """Local linear fit with tricube weights at positions ``xs`` using the points
    [nleft, nright] (0-based, inclusive) of every row of ``y`` (B, n), optionally with
    robustness weights ``rw``. Uses the weighted moments S0..S2, T0, T1 of each neighbourhood:
    fit(xs) = T0/S0 + (xs - xbar) / var * (T1/S0 - xbar * T0/S0), the linear term dropped when
    the neighbourhood is degenerate (h = 0 or a spread below 0.001 (n - 1))."""
    n = y.shape[1]
    if n > DENSE_DAYS:
        return _loess_banded(y, q, xs, nleft, nright, rw)
    xs_a, h, w0, w1, w2 = _moment_matrices(n, q, tuple(np.asarray(xs, dtype=float)), tuple(nleft), tuple(nright))
    r = np.ones_like(y) if rw is None else rw
    ry = r * y
    s0 = r @ w0
    ok = s0 > 0
    s0 = np.where(ok, s0, 1.0)
    xbar = (r @ w1) / s0
    var = (r @ w2) / s0 - xbar * xbar
    t0 = (ry @ w0) / s0
    t1 = (ry @ w1) / s0
    lin = (h[None, :] > 0) & (np.sqrt(np.maximum(var, 0.0)) > 0.001 * (n - 1))
    slope = np.where(lin, (t1 - xbar * t0) / np.where(lin, var, 1.0), 0.0)
    ys = t0 + (xs_a[None, :] - xbar) * slope
    return ys, ok


def _loess_banded(y: np.ndarray, q: int, xs: np.ndarray, nleft: np.ndarray, nright: np.ndarray, rw: np.ndarray | None):
    """``_loess`` with the points of each neighbourhood gathered: memory grows with n * q, not n * n."""
    n = y.shape[1]
    xs_a, idx, w, h = _geometry(n, q, tuple(np.asarray(xs, dtype=float)), tuple(nleft), tuple(nright))
    x = idx - xs_a[:, None]  # distances, so the fit is wanted at 0
    r = w[None] if rw is None else w[None] * rw[:, idx]
    near = y[:, idx]
    s0 = r.sum(-1)
    ok = np.broadcast_to(s0 > 0, near.shape[:2])
    s0 = np.where(s0 > 0, s0, 1.0)
    xbar = (r * x).sum(-1) / s0
    var = (r * x * x).sum(-1) / s0 - xbar * xbar
    t0 = (r * near).sum(-1) / s0
    t1 = (r * x * near).sum(-1) / s0
    lin = (h[None, :] > 0) & (np.sqrt(np.maximum(var, 0.0)) > 0.001 * (n - 1))
    slope = np.where(lin, (t1 - xbar * t0) / np.where(lin, var, 1.0), 0.0)
    return t0 - xbar * slope, ok


def _smooth(y: np.ndarray, q: int, rw: np.ndarray | None) -> np.ndarray:
    """LOESS smoothing of every point with a window of q neighbours sliding along the row."""
    n = y.shape[1]
    x = np.arange(n)
    if q >= n:
        nleft = np.zeros(n, dtype=int)
        nright = np.full(n, n - 1)
    else:
        nsh = (q + 1) // 2
        nleft = np.clip(x - nsh + 1, 0, n - q)
        nright = nleft + q - 1
    ys, ok = _loess(y, q, x.astype(float), nleft, nright, rw)
    return np.where(ok, ys, y)


def _cycle_subseries(y: np.ndarray, rw: np.ndarray | None) -> np.ndarray:
    """Smooth each cycle-subseries and extend it by one point at both ends -> (B, n + 2p).
    Subseries of equal length are smoothed together in one batched pass."""
    B, n = y.shape
    out = np.empty((B, n + 2 * PERIOD))
    groups: dict[int, list[int]] = {}
    for j in range(PERIOD):
        groups.setdefault(len(range(j, n, PERIOD)), []).append(j)
    for k, js in groups.items():
        ys = np.stack([y[:, j::PERIOD] for j in js], axis=1).reshape(B * len(js), k)
        rws = None if rw is None else np.stack([rw[:, j::PERIOD] for j in js], axis=1).reshape(B * len(js), k)
        sm = _smooth(ys, SEASONAL, rws)
        left, okl = _loess(ys, SEASONAL, np.array([-1.0]), np.array([0]), np.array([min(SEASONAL, k) - 1]), rws)
        right, okr = _loess(ys, SEASONAL, np.array([float(k)]), np.array([max(0, k - SEASONAL)]), np.array([k - 1]), rws)
        left = np.where(okl, left, sm[:, :1])
        right = np.where(okr, right, sm[:, -1:])
        full = np.concatenate([left, sm, right], axis=1).reshape(B, len(js), k + 2)
        for i, j in enumerate(js):
            out[:, j::PERIOD] = full[:, i]
    return out


def _moving_average(x: np.ndarray, length: int) -> np.ndarray:
    c = np.cumsum(np.concatenate([np.zeros((x.shape[0], 1)), x], axis=1), axis=1)
    return (c[:, length:] - c[:, :-length]) / length


def _robust_weights(y: np.ndarray, fit: np.ndarray) -> np.ndarray:
    r = np.abs(y - fit)
    cmad = 6.0 * np.median(r, axis=1, keepdims=True)
    with np.errstate(divide="ignore", invalid="ignore"):
        bisq = (1.0 - (r / cmad) ** 2) ** 2
    return np.where(r <= 0.001 * cmad, 1.0, np.where(r <= 0.999 * cmad, bisq, 0.0))


def stl_seasonal(y: np.ndarray) -> np.ndarray:
    """Seasonal component of a robust STL fit for every row of y (B, n); no NaN allowed."""
    y = np.asarray(y, dtype=float)
    n = y.shape[1]
    trend = np.zeros_like(y)
    season = np.zeros_like(y)
    rw = None
    for outer in range(OUTER + 1):
        for _ in range(INNER):
            c = _cycle_subseries(y - trend, rw)
            low = _moving_average(_moving_average(_moving_average(c, PERIOD), PERIOD), 3)
            low = _smooth(low, LOW_PASS, None)
            season = c[:, PERIOD : PERIOD + n] - low
            trend = _smooth(y - season, TREND, rw)
        if outer == OUTER:
            break
        rw = _robust_weights(y, trend + season)
    return season


def interpolate_rows(y: np.ndarray) -> np.ndarray:
    """Linear interpolation of NaN gaps per row, both ends filled with the nearest value."""
    out = y.copy()
    x = np.arange(y.shape[1])
    for i in range(y.shape[0]):
        m = ~np.isnan(y[i])
        if m.any() and not m.all():
            out[i] = np.interp(x, x[m], y[i, m])
    return out


def _nanmedian(a: np.ndarray, axis: int) -> np.ndarray:
    with warnings.catch_warnings():
        warnings.simplefilter("ignore", RuntimeWarning)
        return np.nanmedian(a, axis=axis)


def stl_mad_batch(
    windows: np.ndarray,
    threshold: np.ndarray,
    min_history: np.ndarray,
    *,
    level_days: int = 14,
    weekday_weeks: int = 4,
    scale_floor: float = 0.01,
    mad_to_sigma: float = 1.4826,
    critical_factor: float = 1.5,
    seasonal_fn=stl_seasonal,
) -> dict[str, np.ndarray]:
    """Score the last value of every window (B, n) against its own history.

    The weekday effect comes from a robust STL of the (gap-interpolated) history; the level is
    the causal rolling median of the deseasonalised previous ``level_days`` values (at least
    half of them present); the spread is the MAD of the one-step errors over the window.
    Rows without a result have ok = False.
    """
    w = np.asarray(windows, dtype=float)
    B, n = w.shape
    observed = w[:, -1]
    hist = w[:, :-1]
    ok = ~np.isnan(observed) & ((~np.isnan(hist)).sum(1) >= min_history)
    seasonal = np.full(hist.shape, np.nan)
    if ok.any():
        seasonal[ok] = seasonal_fn(interpolate_rows(hist[ok]))
    deseason = w - np.concatenate([seasonal, np.full((B, 1), np.nan)], axis=1)
    pad = np.concatenate([np.full((B, level_days), np.nan), deseason], axis=1)
    win = np.lib.stride_tricks.sliding_window_view(pad, level_days, axis=1)[:, :n]
    cnt = (~np.isnan(win)).sum(-1)
    level = np.where(cnt >= level_days // 2, _nanmedian(win, -1), np.nan)
    errors = (deseason - level)[:, :-1]
    ok &= (~np.isnan(errors)).sum(1) >= (min_history // 2)
    center = _nanmedian(errors, 1)
    scale = mad_to_sigma * _nanmedian(np.abs(errors - center[:, None]), 1)
    last_level = level[:, -1]
    ok &= np.isfinite(scale) & ~np.isnan(last_level)
    with np.errstate(invalid="ignore"):
        scale = np.fmax(np.fmax(scale, scale_floor * np.abs(last_level)), 1e-9)
    same_wd = seasonal[:, -PERIOD * weekday_weeks :: PERIOD]
    expected = last_level + _nanmedian(same_wd, 1) + center
    with np.errstate(invalid="ignore", divide="ignore"):
        score = (observed - expected) / scale
    a = np.abs(score)
    severity = np.where(a >= threshold * critical_factor, "critical", np.where(a >= threshold, "warning", ""))
    return {
        "ok": ok,
        "observed": observed,
        "expected": expected,
        "score": score,
        "severity": severity,
        "level": last_level,
        "scale": scale,
        "center": center,
    }


def robust_error_sigma(values: np.ndarray) -> float:
    """Robust spread of the causal one-step errors over one whole series (sizes injections)."""
    y = np.asarray(values, dtype=float)[None, :]
    seasonal = stl_seasonal(interpolate_rows(y))
    deseason = y - seasonal
    level_days = 14
    pad = np.concatenate([np.full((1, level_days), np.nan), deseason], axis=1)
    win = np.lib.stride_tricks.sliding_window_view(pad, level_days, axis=1)[:, : y.shape[1]]
    cnt = (~np.isnan(win)).sum(-1)
    level = np.where(cnt >= level_days // 2, _nanmedian(win, -1), np.nan)
    err = (deseason - level)[0]
    err = err[~np.isnan(err)]
    if err.size == 0:
        return float("nan")
    return float(1.4826 * np.median(np.abs(err - np.median(err))))
