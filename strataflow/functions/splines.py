"""Periodic B-splines by the Cox-de Boor recursion."""

from __future__ import annotations

import numpy as np


def _pieces(x: np.ndarray, knots: np.ndarray, degree: int) -> np.ndarray:
    """All B-splines of the degree on the knots, each a column, at the points ``x``."""
    out = ((x[:, None] >= knots[:-1]) & (x[:, None] < knots[1:])).astype(float)
    for d in range(1, degree + 1):
        here, there = out[:, :-1], out[:, 1:]
        rise = (x[:, None] - knots[: -d - 1]) / (knots[d:-1] - knots[: -d - 1])
        fall = (knots[d + 1 :] - x[:, None]) / (knots[d + 1 :] - knots[1:-d])
        out = rise * here + fall * there
    return out


def periodic_basis(x, df: int = 4, degree: int = 3, lower: float = 1.0, upper: float = 4.0) -> np.ndarray:
    """``df`` columns of a periodic spline with ``df`` inner knots, evenly spaced between the boundaries.

    The ends of the period join smoothly: knots repeat with the period, and a spline that leaves at one
    end comes in at the other. Of the df + 1 splines, which sum to 1, the first is left out, as a model
    has an intercept. Points outside the boundaries are taken around.
    """
    n = df + 1
    if n <= degree:
        raise ValueError(f"a periodic spline of degree {degree} needs at least {degree} columns")
    step = (upper - lower) / n
    phase = np.mod(np.asarray(x, dtype=float) - lower, upper - lower) / step
    knots = np.arange(-degree, n + degree + 1, dtype=float)
    flat = _pieces(phase, knots, degree)
    # Splines a period apart are one.
    return sum(np.pad(part, ((0, 0), (0, n - part.shape[1]))) for part in (flat[:, :n], flat[:, n:]))[:, 1:]
