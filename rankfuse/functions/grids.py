"""Parameter grids: driver-side lists, bounded by their length."""

from __future__ import annotations

import math


def geomspace(lo: float, hi: float, num: int) -> list[float]:
    """``num`` points from lo to hi, equal ratios: 10 ** (log10 lo + i * step)."""
    if num == 1:
        return [float(lo)]
    a, b = math.log10(lo), math.log10(hi)
    step = (b - a) / (num - 1)
    return [10.0 ** (a + i * step) for i in range(num)]


def linspace(lo: float, hi: float, num: int) -> list[float]:
    if num == 1:
        return [float(lo)]
    step = (hi - lo) / (num - 1)
    return [lo + i * step for i in range(num)]
