"""Quasi-Poisson log-link regression of a block of short series, fitted together.

Arrays have a series axis first: ``x`` is (series, row, term), ``y``, ``pt`` and ``used`` are
(series, row). One pass of iteratively reweighted least squares updates all unfinished series of
the block. Terms that repeat earlier ones (aliased) are left out, in order.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

# A term whose part not explained by earlier terms is smaller than this, relatively, is aliased.
ALIAS_TOLERANCE = 1e-9

# Steps after convergence; each doubles the digits.
POLISH = 2

# A step that leaves the domain or raises the deviance is halved, this often at most.
HALVINGS = 30

# Linear predictors beyond this, about 1e300 counts or as small a part of one, are outside the domain.
FARTHEST = 690.0

OK, SATURATED, NO_ROWS, NO_PERSON_TIME, NOT_CONVERGED = range(5)
STATUS_NAMES = ("ok", "saturated", "no_rows", "zero_person_time", "not_converged")


@dataclass
class BlockFit:
    """Results per series (first axis); NaN where there is no answer."""

    status: np.ndarray
    n_obs: np.ndarray
    rank: np.ndarray
    iterations: np.ndarray
    deviance: np.ndarray
    dispersion: np.ndarray
    kept: np.ndarray
    estimate: np.ndarray
    std_error: np.ndarray
    mu: np.ndarray
    se_link: np.ndarray


def _orthonormal_terms(x: np.ndarray, used: np.ndarray):
    """Gram-Schmidt over the used rows, term by term: basis, triangular factor, kept terms.

    Fitting in this basis keeps the normal equations well conditioned whatever the scale of the
    terms (a time index next to event counts).
    """
    n_series, _, n_terms = x.shape
    masked = np.where(used[:, :, None], x, 0.0)
    basis = np.zeros_like(masked)
    factor = np.tile(np.eye(n_terms), (n_series, 1, 1))
    kept = np.zeros((n_series, n_terms), dtype=bool)
    for j in range(n_terms):
        rest = masked[:, :, j].copy()
        size = np.sqrt((rest**2).sum(axis=1))
        share = np.zeros((n_series, j))
        for _ in range(2):  # the second round removes what rounding left behind
            again = np.einsum("snk,sn->sk", basis[:, :, :j], rest)
            rest -= np.einsum("snk,sk->sn", basis[:, :, :j], again)
            share += again
        left = np.sqrt((rest**2).sum(axis=1))
        keep = left > ALIAS_TOLERANCE * size
        kept[:, j] = keep
        basis[:, :, j] = np.where(keep[:, None], rest / np.where(keep, left, 1.0)[:, None], 0.0)
        factor[:, :j, j] = np.where(keep[:, None], share, 0.0)
        factor[:, j, j] = np.where(keep, left, 1.0)
    return basis, factor, kept


def _in_basis(x: np.ndarray, factor: np.ndarray, kept: np.ndarray) -> np.ndarray:
    """The same basis evaluated on all rows, also those the fit did not use."""
    out = np.zeros_like(x)
    for j in range(x.shape[2]):
        rest = x[:, :, j] - np.einsum("snk,sk->sn", out[:, :, :j], factor[:, :j, j])
        out[:, :, j] = np.where(kept[:, None, j], rest / factor[:, None, j, j], 0.0)
    return out


def _solve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    try:
        return np.linalg.solve(a, b)
    except np.linalg.LinAlgError:
        return np.linalg.pinv(a, hermitian=True) @ b


def _information(basis: np.ndarray, weight: np.ndarray, kept: np.ndarray) -> np.ndarray:
    a = np.swapaxes(basis * weight[:, :, None], 1, 2) @ basis
    # Left-out terms get a unit diagonal, so their coefficient is 0 and the matrix stays regular.
    n_terms = kept.shape[1]
    return a + np.eye(n_terms) * (~kept)[:, None, :]


def _deviance(y: np.ndarray, mu: np.ndarray, used: np.ndarray) -> np.ndarray:
    """Twice the sum of mu * ((1 + r) log(1 + r) - r) with r = (y - mu) / mu.

    In r nothing nearly equal is subtracted, so the digits that hold do not depend on the size of the
    counts; for small r a few terms of the series are exact to the last digit.
    """
    safe_mu = np.where(used, mu, 1.0)
    with np.errstate(over="ignore"):
        r = np.where(used, (y - safe_mu) / safe_mu, 0.0)
    near = np.abs(r) < 1e-3
    far = np.where(near | (r <= -1) | (r > 1e3), 1.0, r)
    small = np.where(near, r, 0.0)
    series = small * small * (1 / 2 - small * (1 / 6 - small * (1 / 12 - small * (1 / 20 - small / 30))))
    part = np.where(near, series, (1 + far) * np.log1p(far) - far)
    part = np.where(r <= -1, 1.0, part)
    # Far above a tiny mean nothing cancels, and the ratio may not even be a number.
    above = np.where(r > 1e3, y, 1.0)
    whole = np.where(r > 1e3, above * (np.log(above) - np.log(safe_mu)) - (above - safe_mu), safe_mu * part)
    return 2.0 * np.where(used, whole, 0.0).sum(axis=1)


def _evaluated(basis: np.ndarray, coef: np.ndarray, off: np.ndarray, y: np.ndarray, used: np.ndarray):
    """Linear predictor, means and deviance of coefficients; the deviance is infinite outside the domain."""
    linear = np.einsum("snk,sk->sn", basis, coef) + off
    inside = ~(used & ~(np.abs(linear) < FARTHEST)).any(axis=1)
    mu = np.where(used & inside[:, None], np.exp(np.clip(linear, -FARTHEST, FARTHEST)), 1.0)
    dev = _deviance(y, mu, used & inside[:, None])
    return linear, mu, np.where(inside, dev, np.inf)


def _direction(basis, coef, off, y, used, kept) -> np.ndarray:
    """Newton's step from ``coef``, by singular values of the weighted terms instead of their products."""
    _, mu, _ = _evaluated(basis, coef, off, y, used)
    root = np.sqrt(np.where(used, mu, 0.0))
    pull = np.where(used, (y - mu) / np.where(used, root, 1.0), 0.0)
    inverse = np.linalg.pinv(basis * root[:, :, None], rcond=1e-14)
    return np.einsum("skn,sn->sk", inverse, pull) * kept


def fit_block(
    x: np.ndarray,
    y: np.ndarray,
    pt: np.ndarray,
    used: np.ndarray,
    tolerance: float,
    max_iterations: int,
) -> BlockFit:
    """Fit every series on its used rows and predict all of its rows.

    A series has converged when its deviance changes by less than ``tolerance``, relatively; it then
    takes ``POLISH`` more steps, which bring its coefficients to the last digits. Until then a step that
    leaves the domain, or raises the deviance by more than the tolerance, is halved, each series for itself.
    """
    n_series, n_rows, n_terms = x.shape
    n_obs = used.sum(axis=1)
    positive = np.where(pt > 0, pt, np.nan)
    offset = np.log(positive)
    no_time = (used & ~np.isfinite(offset)).any(axis=1)
    fitting = (n_obs > 0) & ~no_time

    nan = np.nan
    fit = BlockFit(
        status=np.where(n_obs == 0, NO_ROWS, np.where(no_time, NO_PERSON_TIME, OK)),
        n_obs=n_obs,
        rank=np.zeros(n_series, dtype=int),
        iterations=np.zeros(n_series, dtype=int),
        deviance=np.full(n_series, nan),
        dispersion=np.full(n_series, nan),
        kept=np.zeros((n_series, n_terms), dtype=bool),
        estimate=np.full((n_series, n_terms), nan),
        std_error=np.full((n_series, n_terms), nan),
        mu=np.full((n_series, n_rows), nan),
        se_link=np.full((n_series, n_rows), nan),
    )
    at = np.flatnonzero(fitting)
    if at.size == 0:
        return fit
    x, used, offset = x[at], used[at], offset[at]
    known_x = np.where(np.isfinite(x), x, 0.0)
    yy = np.where(used, y[at], 0.0)
    off = np.where(used, offset, 0.0)
    basis, factor, kept = _orthonormal_terms(known_x, used)

    # The first working values come from the counts; the first step must improve on a constant rate.
    mu = np.where(used, yy + 0.1, 1.0)
    eta = np.log(mu)
    total, time = yy.sum(axis=1), np.where(used, np.exp(off), 0.0).sum(axis=1)
    rate = np.log(np.maximum(total, 0.1) / time)
    coef = np.einsum("snk,s->sk", basis, rate)
    _, _, dev = _evaluated(basis, coef, off, yy, used)
    first = np.ones(at.size, dtype=bool)
    rounds = np.zeros(at.size, dtype=int)
    done = np.zeros(at.size, dtype=bool)
    failed = np.zeros(at.size, dtype=bool)
    polish = np.full(at.size, POLISH)
    for _ in range(max_iterations + POLISH):
        go = np.flatnonzero((~done | (polish > 0)) & ~failed & (done | (rounds < max_iterations)))
        if go.size == 0:
            break
        b, u, m = basis[go], used[go], mu[go]
        weight = np.where(u, m, 0.0)
        working = np.where(u, eta[go] - off[go] + (yy[go] - m) / m, 0.0)
        right = np.einsum("snk,sn->sk", b, weight * working)
        new = _solve(_information(b, weight, kept[go]), right[:, :, None])[:, :, 0]
        linear, new_mu, new_dev = _evaluated(b, new, off[go], yy[go], u)
        rounds[go] += 1
        bar = dev[go] + tolerance * (np.abs(dev[go]) + 0.1)
        astray = ~(new_dev <= bar) | ~np.isfinite(new_dev)
        cut = astray.copy()
        h = np.flatnonzero(astray & ~done[go])
        if h.size:
            # Weights that span many magnitudes spoil the normal equations: the step is solved for again, then shortened.
            here = coef[go[h]]
            way = _direction(b[h], here, off[go[h]], yy[go[h]], u[h], kept[go[h]])
            far = np.abs(np.einsum("snk,sk->sn", b[h], way) * u[h]).max(axis=1)
            part = np.log1p(far) / np.maximum(far, 1e-300)
            for _ in range(HALVINGS):
                new[h] = here + part[:, None] * way
                linear[h], new_mu[h], new_dev[h] = _evaluated(b[h], new[h], off[go[h]], yy[go[h]], u[h])
                astray[h] = ~(new_dev[h] <= bar[h]) | ~np.isfinite(new_dev[h])
                part = np.where(astray[h], part / 2, part)
                if not astray[h].any():
                    break
            # Close to the minimum a whole step and a shortened one are the same.
            cut[h] = part * far < np.minimum(far, 1) * 0.5
            cut[h] |= far > 1e-3
        # A step that goes astray after convergence is not taken.
        failed[go[astray]] = ~done[go[astray]]
        polish[go[astray]] = 0
        kept_step = ~astray
        good = go[kept_step]
        polish[good] -= done[good]
        change = np.abs(new_dev[kept_step] - dev[good])
        # A shortened step may change little far from the minimum; only a whole one tells.
        done[good] |= (change < tolerance * (np.abs(new_dev[kept_step]) + 0.1)) & ~first[good] & ~cut[kept_step]
        first[good] = False
        coef[good], mu[good], eta[good], dev[good] = (
            new[kept_step],
            new_mu[kept_step],
            linear[kept_step],
            new_dev[kept_step],
        )
    # What no step could improve stays where its series began or was last.
    never = np.flatnonzero(first)
    if never.size:
        eta[never], mu[never], dev[never] = _evaluated(basis[never], coef[never], off[never], yy[never], used[never])

    rank = kept.sum(axis=1)
    df = fit.n_obs[at] - rank
    pearson = np.where(used, (yy - mu) ** 2 / mu, 0.0).sum(axis=1)
    dispersion = np.where(df > 0, pearson / np.maximum(df, 1), nan)
    covariance = np.linalg.pinv(
        _information(basis, np.where(used, mu, 0.0), kept), hermitian=True
    ) * dispersion[:, None, None]
    back = np.linalg.inv(factor)
    estimate = np.einsum("sjk,sk->sj", back, coef)
    variance = np.einsum("sjk,skl,sjl->sj", back, covariance, back)

    everywhere = _in_basis(known_x, factor, kept)
    linear = np.einsum("snk,sk->sn", everywhere, coef) + offset
    with np.errstate(over="ignore", invalid="ignore"):
        all_mu = np.exp(linear)
        link_variance = np.einsum("snk,skl,snl->sn", everywhere, covariance, everywhere)
        se_link = np.sqrt(np.maximum(link_variance, 0.0))
        std_error = np.sqrt(np.maximum(variance, 0.0))
    no_prediction = ~np.isfinite(x).all(axis=2)
    all_mu[no_prediction] = nan
    se_link[no_prediction] = nan

    finished = done & ~failed
    fit.status[at] = np.where(finished, np.where(df > 0, OK, SATURATED), NOT_CONVERGED)
    fit.rank[at] = rank
    fit.iterations[at] = rounds
    fit.deviance[at] = dev
    fit.dispersion[at] = dispersion
    fit.kept[at] = kept
    fit.estimate[at] = np.where(kept, estimate, nan)
    fit.std_error[at] = np.where(kept, std_error, nan)
    fit.mu[at] = all_mu
    fit.se_link[at] = se_link
    return fit
