"""One segmented quasi-Poisson regression over all series together, by distributed reweighted least squares.

Each round is one pass over a written table of model rows: tasks send sums of products of the terms, one
row per model, which Spark adds up; the driver holds only matrices of terms by terms.
"""

from __future__ import annotations

import sys
from typing import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import quasipoisson
from ..functions.missing import as_col, plain_text
from ..functions.quasipoisson import FARTHEST, HALVINGS, NO_ROWS, NOT_CONVERGED, OK, POLISH, SATURATED, STATUS_NAMES
from ..functions.student_t import two_sided_p
from ..operators.filters import POST_EVENT_PATTERN, outcome_gate
from ..operators.windows import lagged_count
from ..sources.scratch import materialise
from .regression import MODELS, REMOVE_INTERVENTION, STEP_SLOPE, season_basis
from .series import SERIES

for _module in (sys.modules[__name__], quasipoisson):
    cloudpickle.register_pickle_by_value(_module)

# A term of which less than this share (squared) is left by earlier terms is aliased.
ALIAS_SHARE = 1e-11
# Levels that effects may have together: their number is that of the terms.
MOST_LEVELS = 500

RESULT = (
    "model string, status string, n_obs long, rank int, df_residual long, deviance double, dispersion double, "
    "parameter string, estimate double, std_error double, t_value double, p_value double"
)


def _terms(season: str | None, lagged: bool, effects: dict[str, list[str]]) -> dict[str, F.Column]:
    """All terms in order, as columns of the model rows."""
    number = {"time": as_col("time").cast("double"), "intrv": as_col("intrv").cast("double")}
    out = {"(Intercept)": F.lit(1.0)}
    if lagged:
        out["lag(n_events_sum)"] = as_col("__lag")
    out |= {"intrv": number["intrv"], "time": number["time"]}
    if season is not None:
        basis = season_basis(season)
        for i in range(len(basis[1])):
            level = F.create_map(*[F.lit(v) for q, values in basis.items() for v in (q, float(values[i]))])
            out[f"season_{i + 1}"] = level[as_col("quarter").cast("int")]
    out["intrv:time"] = number["intrv"] * number["time"]
    for c, levels in effects.items():
        for level in levels[1:]:
            out[f"{c}: {level}"] = (F.coalesce(plain_text(c), F.lit("NA")) == F.lit(level)).cast("double")
    return out


def _in_model(term: str, model: str) -> bool:
    if term in ("intrv", "intrv:time"):
        return model != REMOVE_INTERVENTION
    if term.startswith(("lag(", "season_")):
        return model != STEP_SLOPE
    return True


def _levels(rows: DataFrame, effects: Sequence[str]) -> dict[str, list[str]]:
    """Sorted levels of each effect column; the first is the one others are compared with."""
    if not effects:
        return {}
    pairs = F.array(*[F.struct(F.lit(c).alias("c"), F.coalesce(plain_text(c), F.lit("NA")).alias("v")) for c in effects])
    found = rows.select(F.inline(pairs)).distinct().limit(MOST_LEVELS + 1).collect()
    if len(found) > MOST_LEVELS:
        raise ValueError(f"effects have more than {MOST_LEVELS} levels")
    return {c: sorted(r["v"] for r in found if r["c"] == c) for c in effects}


class _Model:
    """What the driver knows of a model: its terms, the basis they are fitted in, and the last coefficients."""

    def __init__(self, name: str, at: list[int]):
        self.name, self.at = name, at
        self.basis = np.eye(len(at))
        self.kept = np.ones(len(at), bool)
        self.coef = self.last = None  # in the basis; None: counts stand for the means
        self.dev = np.inf
        self.rounds, self.left, self.halved = 0, POLISH, 0
        self.state = "new"
        self.n = 0

    def settle(self, products: np.ndarray) -> None:
        """Orthonormal basis of the terms from their products, in order; aliased terms have an empty column."""
        size = np.sqrt(np.maximum(np.diag(products), 1e-300))
        a = products / np.outer(size, size)
        k = len(self.at)
        factor, self.kept = np.zeros((k, k)), np.zeros(k, bool)
        for j in range(k):
            for i in range(j):
                if self.kept[i]:
                    factor[i, j] = (a[i, j] - factor[:i, i] @ factor[:i, j]) / factor[i, i]
            rest = a[j, j] - factor[:j, j] @ factor[:j, j]
            self.kept[j] = a[j, j] > 0 and rest > ALIAS_SHARE
            factor[j, j] = np.sqrt(rest) if self.kept[j] else 1.0
        own = factor[np.ix_(self.kept, self.kept)]
        self.basis = np.zeros((k, k))
        self.basis[np.ix_(self.kept, self.kept)] = np.linalg.inv(own)
        self.basis /= size[:, None]


def _sums(rows: DataFrame, models: list[_Model], fitting: bool) -> dict[str, np.ndarray]:
    """Per model: rows, deviance, Pearson sum, whether a mean left the domain, right side, products of its terms."""
    plans = [(m.name, m.at, m.basis, m.coef, m.name == REMOVE_INTERVENTION) for m in models]

    def partial(batches: Iterator[pa.RecordBatch]):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            n = batch.num_rows
            x = batch["x"].flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 0))
            y, off, before = (batch[c].to_numpy(zero_copy_only=False) for c in ("y", "off", "before"))
            for name, at, basis, coef, only_before in plans:
                if not n:
                    continue
                use = np.isfinite(x[:, at]).all(1) & (before if only_before else True)
                q, yy, o = x[np.ix_(use, at)] @ basis, y[use], off[use]
                k = len(at)
                if not fitting:
                    w, z, extra = np.ones(len(yy)), yy, np.array([len(yy), 0.0, 0.0, 0.0])
                else:
                    eta = q @ coef + o if coef is not None else np.log(yy + 0.1)
                    out = float(not (np.abs(eta) < FARTHEST).all())
                    w = np.exp(np.clip(eta, -FARTHEST, FARTHEST))
                    z = eta - o + (yy - w) / w
                    dev = quasipoisson._deviance(yy[None], w[None], np.ones((1, len(yy)), bool))[0]
                    extra = np.array([len(yy), dev, ((yy - w) ** 2 / w).sum(), out])
                part = np.concatenate([extra, q.T @ (w * z), (q.T @ (q * w[:, None])).ravel()])
                total[name] = total[name] + part if name in total else part
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total)), pa.array([v.tolist() for v in total.values()])], ["model", "v"])

    parts = rows.mapInArrow(partial, "model string, v array<double>")
    summed = parts.select("model", F.posexplode("v").alias("at", "v")).groupBy("model", "at").agg(F.sum("v").alias("v"))
    got: dict[str, np.ndarray] = {m.name: np.zeros(4 + len(m.at) + len(m.at) ** 2) for m in models}
    for r in summed.collect():
        got[r["model"]][r["at"]] = r["v"]
    return got


def _advance(m: _Model, v: np.ndarray, tolerance: float, max_iterations: int) -> None:
    """Take what a pass says about the model's coefficients, and choose the next ones."""
    k = len(m.at)
    m.n, dev, m.pearson, out = v[0], v[1], v[2], v[3]
    if m.coef is not None:
        worse = out > 0 or not dev <= m.dev + tolerance * (abs(m.dev) + 0.1)
        if worse and m.state == "converged":
            m.coef, m.state = m.last, "done"  # a step that goes astray after convergence is not taken
            return
        if worse and m.last is not None and m.halved < HALVINGS:
            m.coef, m.halved = (m.coef + m.last) / 2, m.halved + 1
            return
        if worse and m.last is not None:
            m.state = "failed"
            return
        if abs(dev - m.dev) < tolerance * (abs(dev) + 0.1) and not m.halved:
            m.state = "converged"
        m.dev = dev
        if m.state == "converged":
            m.left -= 1
    m.products = v[4 + k :].reshape(k, k) + np.diag((~m.kept).astype(float))
    if m.state == "converged" and m.left < 0:
        m.state = "done"
        return
    if m.rounds >= max_iterations and m.state != "converged":
        m.state = "failed"
        return
    m.last, m.coef, m.halved = m.coef, np.linalg.solve(m.products, v[4 : 4 + k]), 0
    m.rounds += 1


def fit_pooled(
    series: DataFrame,
    keys: Sequence[str] = SERIES,
    models: Sequence[str] = MODELS,
    lagged: bool = False,
    season: str | None = "wrap",
    effects: Sequence[str] = (),
    gate: str | None = POST_EVENT_PATTERN,
    outcome_col: str = "outcome_cohort_name",
    tolerance: float = 1e-8,
    max_iterations: int = 50,
) -> DataFrame:
    """The models of :func:`fit_segmented` fitted once to the rows of all series: a row per kept coefficient.

    ``effects`` are columns whose levels get a term of their own, compared with the first in text order
    (NULL is the level ``NA``). The lag stays within a series. Rows without counts, terms or positive
    person-time are left out. Aliased terms are left out in order. A model without rows has one row with its
    status and no parameter. All models share the passes.
    """
    if gate is not None and outcome_col in series.columns:
        series = outcome_gate(series, outcome_col, gate)
    if lagged:
        series = lagged_count(series, keys, "incidence_start_date", "n_events_sum", "__lag")
    levels = _levels(series, effects)
    terms = _terms(season, lagged, levels)
    fits = (as_col("person_years_sum") > 0) & as_col("n_events_sum").isNotNull()
    # A term without a value is not a number in the row; each model then looks at its own terms.
    nan = F.lit(float("nan"))
    rows = series.filter(fits).select(
        F.array(*[F.coalesce(t.cast("double"), nan) for t in terms.values()]).alias("x"),
        as_col("n_events_sum").cast("double").alias("y"),
        F.log(as_col("person_years_sum").cast("double")).alias("off"),
        F.coalesce(as_col("incidence_start_date") <= as_col("timepoint"), F.lit(False)).alias("before"),
    )
    rows = materialise(rows, "pooled")
    names = list(terms)
    all_models = [_Model(m, [i for i, t in enumerate(names) if _in_model(t, m)]) for m in models]
    for name, v in _sums(rows, all_models, fitting=False).items():
        m = next(m for m in all_models if m.name == name)
        m.n = v[0]
        m.settle(v[4 + len(m.at) :].reshape(len(m.at), -1))
        m.state = "going" if m.n else "empty"
    while active := [m for m in all_models if m.state in ("going", "converged")]:
        sums = _sums(rows, active, fitting=True)
        for m in active:
            _advance(m, sums[m.name], tolerance, max_iterations)
    out = [r for m in all_models for r in _result(m, names)]
    return series.sparkSession.createDataFrame(out, RESULT)


def _result(m: _Model, names: list[str]) -> list[tuple]:
    if m.state == "empty":
        return [(m.name, STATUS_NAMES[NO_ROWS], 0, 0, None, None, None, None, None, None, None, None)]
    rank, n = int(m.kept.sum()), int(m.n)
    df = n - rank
    status = NOT_CONVERGED if m.state == "failed" else OK if df > 0 else SATURATED
    dispersion = float(m.pearson) / df if df > 0 else None
    coef = m.coef if m.state == "done" else m.last
    estimate = m.basis @ coef
    spread = np.sqrt(np.maximum(np.diag(m.basis @ np.linalg.inv(m.products) @ m.basis.T), 0))
    out = []
    for j in np.flatnonzero(m.kept):
        head = (m.name, STATUS_NAMES[status], n, rank, df, float(m.dev), dispersion, names[m.at[j]], float(estimate[j]))
        if dispersion is None:
            out.append((*head, None, None, None))
            continue
        error = float(spread[j] * np.sqrt(dispersion))
        t = float(estimate[j]) / error if error else float("inf")
        p = float(two_sided_p(np.array([t]), np.array([df]))[0])
        out.append((*head, error, t, p))
    return out
