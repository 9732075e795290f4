"""Quantiles of Student's t distribution, for confidence intervals."""

from __future__ import annotations

import math


def _tail_fraction(x: float, a: float, b: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1 / ((1 - (a + b) * x / (a + 1)) or tiny)
    h = d
    for m in range(1, 400):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + step * d) or tiny)
            c = (1 + step / c) or tiny
            h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return h


def incomplete_beta(x: float, a: float, b: float) -> float:
    """Regularised, for x from 0 to 1."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _tail_fraction(x, a, b) / a
    return 1 - front * _tail_fraction(1 - x, b, a) / b


def two_sided(confidence: float, freedom: int) -> float:
    """t with ``confidence`` of the mass between -t and t."""
    low, high = 0.0, 1.0
    inside = lambda t: 1 - incomplete_beta(freedom / (freedom + t * t), freedom / 2, 0.5)
    while inside(high) < confidence:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if inside(mid) < confidence else (low, mid)
    return (low + high) / 2
