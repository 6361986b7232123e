"""Student t tail probability for arrays.

No statistics package is assumed on the executors, so the regularised incomplete beta function
is evaluated by its standard continued fraction (modified Lentz scheme).
"""

from __future__ import annotations

import math

import numpy as np


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Elementwise; degrees of freedom repeat a lot, so each distinct value is evaluated once."""
    values, where = np.unique(x, return_inverse=True)
    return np.array([math.lgamma(v) for v in values])[where].reshape(np.shape(x))


def _beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    tiny = 1e-300
    c = np.ones_like(x)
    d = 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 500):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        before = h.copy()
        for term in (even, odd):
            d = 1.0 + term * d
            d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1.0 + term / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
        if np.all(np.abs(h - before) <= 1e-15 * np.abs(h)):
            break
    return h


def incomplete_beta(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta I_x(a, b)."""
    a, b, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(b, float), np.asarray(x, float))
    inner = np.clip(x, 1e-300, 1.0 - 1e-16)
    front = np.exp(
        _log_gamma(a + b) - _log_gamma(a) - _log_gamma(b) + a * np.log(inner) + b * np.log1p(-inner)
    )
    swap = inner > (a + 1.0) / (a + b + 2.0)
    p, q, z = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1.0 - inner, inner)
    part = front * _beta_fraction(p, q, z) / p
    out = np.where(swap, 1.0 - part, part)
    return np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, out))


def two_sided_p(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """P(|T| > |t|) with ``df`` degrees of freedom; NaN where either input is unusable."""
    t, df = np.broadcast_arrays(np.asarray(t, float), np.asarray(df, float))
    usable = np.isfinite(t) & (df > 0)
    out = np.full(t.shape, np.nan)
    if usable.any():
        tt, dd = t[usable], df[usable]
        out[usable] = incomplete_beta(dd / 2.0, np.full_like(dd, 0.5), dd / (dd + tt * tt))
    return out
