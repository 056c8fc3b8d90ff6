"""Order statistics of a sliding window: a sorted list with insert and delete."""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np


class SortedWindow:
    """The numbers in a window, sorted; median and median absolute deviation without sorting anew."""

    def __init__(self):
        self.values: list[float] = []

    def __len__(self) -> int:
        return len(self.values)

    def add(self, x: float) -> None:
        insort(self.values, x)

    def remove(self, x: float) -> None:
        del self.values[bisect_left(self.values, x)]

    def median(self) -> float:
        v, half = self.values, len(self.values) // 2
        return v[half] if len(v) % 2 else (v[half - 1] + v[half]) / 2

    def _deviation(self, center: float, rank: int) -> float:
        """The distance from ``center`` with ``rank`` smaller ones: the least d whose [center - d, center + d] holds
        rank + 1 values. The values nearest to the center are a stretch of the list; its start is found by bisection."""
        v, size = self.values, rank + 1
        low, high = 0, len(v) - size
        while low < high:
            mid = (low + high) // 2
            if center - v[mid] > v[mid + size] - center:
                low = mid + 1
            else:
                high = mid
        return max(center - v[low], v[low + size - 1] - center)

    def deviation_median(self, center: float) -> float:
        """Median of the distances from ``center``."""
        half = len(self.values) // 2
        upper = self._deviation(center, half)
        return upper if len(self.values) % 2 else (self._deviation(center, half - 1) + upper) / 2


def trailing_level(values: np.ndarray, days: int, least: int) -> np.ndarray:
    """Per position the median of the ``days`` values before it (NaN: missing, or fewer than ``least``)."""
    out, window = np.full(len(values), np.nan), SortedWindow()
    for i in range(len(values)):
        if len(window) >= least:
            out[i] = window.median()
        if values[i] == values[i]:
            window.add(values[i])
        if i >= days and values[i - days] == values[i - days]:
            window.remove(values[i - days])
    return out


def error_spread(values: np.ndarray, targets: list[int], window: int, days: int) -> list[tuple]:
    """Per target position (level, history, errors, center, mad) over the ``window`` positions that end there.

    A position's error is its value less the median of the ``days`` values before it, as far as they lie in the
    window and half of ``days`` of them are known; history counts the values and errors the errors before the target, center is
    the errors' median and mad the median of their distances from it (None without errors). Errors with all their days in the window do not depend on it and slide;
    the few at the window's start are put in for the target and taken out again.
    """
    least = days // 2
    level = trailing_level(values, days, least)
    error = values - level
    known = np.concatenate([[0], np.cumsum(values == values)])
    sliding, low, high, out = SortedWindow(), 0, 0, []
    for t in targets:
        start = max(t - window + 1, 0)
        first = start + days if t - window + 1 >= 0 else 0
        while high < t:
            if error[high] == error[high]:
                sliding.add(error[high])
            high += 1
        while low < min(first, t):
            if error[low] == error[low]:
                sliding.remove(error[low])
            low += 1
        edge, seen = [], SortedWindow()
        for d in range(start, min(first, t)):
            x = values[d]
            if x == x:
                if len(seen) >= least:
                    edge.append(x - seen.median())
                seen.add(x)
        for e in edge:
            sliding.add(e)
        center = sliding.median() if len(sliding) else None
        mad = sliding.deviation_median(center) if len(sliding) else None
        out.append((float(level[t]), int(known[t] - known[start]), len(sliding), center, mad))
        for e in edge:
            sliding.remove(e)
    return out
