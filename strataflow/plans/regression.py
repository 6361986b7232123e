"""Segmented quasi-Poisson regression of every series, its predictions and diagnostics.

``fit_segmented`` runs once per (lagged or not) and returns one row per series and model with its
coefficients and fitted rows as arrays; every table below is a projection of that row. To feed
several tables from one fit, pass it through ``sources.scratch.materialise`` first.
"""

from __future__ import annotations

import sys
from statistics import NormalDist
from typing import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as T

from ..functions import numbers, quasipoisson, splines, student_t
from ..functions.missing import as_col, one_of
from ..functions.quasipoisson import NOT_CONVERGED, OK, SATURATED, STATUS_NAMES, fit_block
from ..functions.splines import periodic_basis
from ..functions.student_t import two_sided_p
from ..operators.filters import POST_EVENT_PATTERN, outcome_gate
from ..operators.projections import deviance_residuals
from ..operators.sets import bag_union
from ..operators.windows import lagged_count, nth_last_date
from ..sources.dims import literal_table
from .correlation import acf_of_arrays, pacf
from .series import FORECAST_NAMES, SERIES, forecast_columns

# The fitting code travels with the plan, so executors need numpy and pyarrow but not this package.
for _module in (sys.modules[__name__], quasipoisson, splines, student_t):
    cloudpickle.register_pickle_by_value(_module)

# ---- Fixed values: model specifications and their display names -----------------------------
WITH_INTERVENTION = "with_intervention"
REMOVE_INTERVENTION = "remove_intervention"
STEP_SLOPE = "step_slope"
MODELS = (WITH_INTERVENTION, REMOVE_INTERVENTION, STEP_SLOPE)

MODEL_LABELS = {
    WITH_INTERVENTION: "With Intervention",
    REMOVE_INTERVENTION: "Remove Intervention",
    STEP_SLOPE: "Step and slope only",
}

# Quarter -> seasonal columns. "wrap": the year closes on itself, so the fourth quarter shares the
# phase of the first; "full": each quarter has its own level. The columns span all levels, so
# fits and bands do not depend on the basis; only the season coefficients themselves do.
SEASON_BASIS = {
    "wrap": {1: (0.0, 0.0), 2: (1.0, 0.0), 3: (0.0, 1.0), 4: (0.0, 0.0)},
    "full": {1: (0.0, 0.0, 0.0), 2: (1.0, 0.0, 0.0), 3: (0.0, 1.0, 0.0), 4: (0.0, 0.0, 1.0)},
}
# ---- End of fixed values --------------------------------------------------------------------


def season_basis(mode: str) -> dict[int, tuple[float, ...]]:
    """Quarter -> seasonal columns; ``spline`` is a periodic cubic spline that closes at the fourth quarter."""
    if mode == "spline":
        return {q: tuple(row) for q, row in zip((1, 2, 3, 4), periodic_basis((1, 2, 3, 4)).tolist())}
    return SEASON_BASIS[mode]


def seasonal_basis(spark: SparkSession, mode: str = "wrap") -> DataFrame:
    """The seasonal term as a four-row table: quarter -> season_1, season_2, ..."""
    basis = season_basis(mode)
    width = len(basis[1])
    rows = [(q, *values) for q, values in basis.items()]
    return literal_table(spark, rows, ["quarter", *[f"season_{i + 1}" for i in range(width)]])


def design_terms(
    series: DataFrame, keys: Sequence[str] = SERIES, lagged: bool = False
) -> DataFrame:
    """The regression terms of each row: step, slope, their product, offset and, if asked, lag."""
    terms = series.withColumns(
        {
            "step": as_col("intrv").cast("double"),
            "slope": as_col("time").cast("double"),
            "step_slope": (as_col("intrv") * as_col("time")).cast("double"),
            "offset": F.when(as_col("person_years_sum") > 0, F.log(as_col("person_years_sum"))),
        }
    )
    if not lagged:
        return terms
    return lagged_count(terms, keys, "incidence_start_date", "n_events_sum", "lag_y")


_ROW = ("time", "date", "quarter", "intrv", "before", "y", "pt")
_COEFFICIENT = T.StructType(
    [
        T.StructField("parameter", T.StringType()),
        T.StructField("estimate", T.DoubleType()),
        T.StructField("std_error", T.DoubleType()),
        T.StructField("t_value", T.DoubleType()),
        T.StructField("p_value", T.DoubleType()),
    ]
)
_FITTED = T.StructType(
    [
        T.StructField("time", T.IntegerType()),
        T.StructField("date", T.DateType()),
        T.StructField("y", T.DoubleType()),
        T.StructField("pt", T.DoubleType()),
        T.StructField("used", T.BooleanType()),
        T.StructField("mu", T.DoubleType()),
        T.StructField("se_link", T.DoubleType()),
    ]
)
_RESULT = [
    T.StructField("model", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("n_obs", T.IntegerType()),
    T.StructField("rank", T.IntegerType()),
    T.StructField("df_residual", T.IntegerType()),
    T.StructField("deviance", T.DoubleType()),
    T.StructField("dispersion", T.DoubleType()),
    T.StructField("coefficients", T.ArrayType(_COEFFICIENT)),
    T.StructField("fitted", T.ArrayType(_FITTED)),
]

# Padded cells (series x rows x terms) worked on at a time inside a task, and rows per output batch.
_BLOCK_CELLS = 2_000_000
_PORTION_ROWS = 250_000


def _spec_terms(model: str, lagged: bool, season: str | None, block: dict[str, np.ndarray]):
    """Named terms of a model, main effects first, and the rows it may be fitted on."""
    terms = [("(Intercept)", np.ones_like(block["time"]))]
    if lagged and model != STEP_SLOPE:
        terms.append(("lag(n_events_sum)", block["lag"]))
    if model != REMOVE_INTERVENTION:
        terms.append(("intrv", block["intrv"]))
    terms.append(("time", block["time"]))
    if season is not None and model != STEP_SLOPE:
        basis = season_basis(season)
        for i in range(len(basis[1])):
            level = np.array([0.0, *[basis[q][i] for q in (1, 2, 3, 4)]])
            terms.append((f"season_{i + 1}", level[block["quarter"].astype(int)]))
    if model != REMOVE_INTERVENTION:
        terms.append(("intrv:time", block["intrv"] * block["time"]))
    used = block["present"] & np.isfinite(block["y"]) & np.isfinite(block["pt"])
    if model == REMOVE_INTERVENTION:
        used = used & (block["before"] > 0)
    x = np.stack([values for _, values in terms], axis=2)
    return [name for name, _ in terms], x, used & np.isfinite(x).all(axis=2)


def _blocks(lengths: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """Series of similar length together, so that padding to a rectangle wastes little."""
    by_length = np.argsort(lengths, kind="stable")
    start = 0
    while start < len(by_length):
        # Lengths ascend, so growing the block only raises the row count of its last series.
        stop = start + 1
        while (
            stop < len(by_length)
            and (stop + 1 - start) * max(lengths[by_length[stop]], 1) * width <= _BLOCK_CELLS
        ):
            stop += 1
        yield by_length[start:stop]
        start = stop


def _portions(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Cut a batch of packed series so that memory depends on rows, not on the number of series."""
    ends = np.cumsum(batch.column("time").value_lengths().to_numpy(zero_copy_only=False))
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + _PORTION_ROWS, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def _nullable(values: np.ndarray) -> pa.Array:
    values = np.asarray(values, dtype=float)
    return pa.array(values, mask=~np.isfinite(values))


def _lists(counts: np.ndarray, fields: dict[str, pa.Array]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    items = pa.StructArray.from_arrays(list(fields.values()), names=list(fields))
    return pa.ListArray.from_arrays(pa.array(offsets), items)


def _fit_batch(
    batch: pa.RecordBatch,
    keys: Sequence[str],
    models: Sequence[str],
    lagged: bool,
    season: str | None,
    tolerance: float,
    max_iterations: int,
) -> Iterator[pa.RecordBatch]:
    lengths = batch.column("time").value_lengths().to_numpy(zero_copy_only=False)
    lengths = np.asarray(lengths, dtype=np.int64)
    starts = np.concatenate([[0], np.cumsum(lengths)])[:-1].astype(np.int64)
    flat = {
        c: batch.column(c).flatten().to_numpy(zero_copy_only=False).astype(float)
        for c in _ROW
        if c != "date"
    }
    total, n_series = int(lengths.sum()), len(lengths)
    for model in models:
        mu, se_link = np.full(total, np.nan), np.full(total, np.nan)
        in_fit = np.zeros(total, dtype=bool)
        scalars = {c: np.zeros(n_series) for c in ("status", "n_obs", "rank", "deviance", "dispersion")}
        names: list[str] = []
        tables: dict[str, np.ndarray] = {}
        for members in _blocks(lengths, 8):
            row = np.arange(max(int(lengths[members].max()), 1))
            present = row[None, :] < lengths[members][:, None]
            place = np.where(present, starts[members][:, None] + row[None, :], 0)
            block = {c: np.where(present, v[place], 0.0) if total else np.zeros(place.shape) for c, v in flat.items()}
            block["present"] = present
            block["lag"] = np.concatenate(
                [np.full((len(members), 1), np.nan), block["y"][:, :-1]], axis=1
            )
            names, x, used = _spec_terms(model, lagged, season, block)
            fit = fit_block(
                x, block["y"], block["pt"], used, tolerance, max_iterations
            )
            where = place[present]
            mu[where], se_link[where], in_fit[where] = (
                fit.mu[present],
                fit.se_link[present],
                used[present],
            )
            for c in scalars:
                scalars[c][members] = getattr(fit, c)
            if not tables:
                shape = (n_series, len(names))
                tables = {c: np.full(shape, np.nan) for c in ("kept", "estimate", "std_error")}
            for c in tables:
                tables[c][members] = getattr(fit, c)

        status = scalars["status"].astype(int)
        df = scalars["n_obs"] - scalars["rank"]
        kept = tables["kept"] == 1.0
        with np.errstate(divide="ignore", invalid="ignore"):
            t_value = tables["estimate"] / tables["std_error"]
        p_value = two_sided_p(t_value, np.broadcast_to(df[:, None], t_value.shape))
        labels = np.broadcast_to(np.array(names, dtype=object), kept.shape)
        coefficients = _lists(
            kept.sum(axis=1),
            {
                "parameter": pa.array(labels[kept].tolist(), type=pa.string()),
                "estimate": _nullable(tables["estimate"][kept]),
                "std_error": _nullable(tables["std_error"][kept]),
                "t_value": _nullable(t_value[kept]),
                "p_value": _nullable(p_value[kept]),
            },
        )
        fitted = _lists(
            lengths,
            {
                "time": pa.array(flat["time"].astype(np.int32)),
                "date": batch.column("date").flatten(),
                "y": _nullable(flat["y"]),
                "pt": _nullable(flat["pt"]),
                "used": pa.array(in_fit),
                "mu": _nullable(mu),
                "se_link": _nullable(se_link),
            },
        )
        fitted_ok = np.isin(status, (OK, SATURATED, NOT_CONVERGED))
        counted = pa.array(df.astype(np.int32), mask=~fitted_ok)
        yield pa.RecordBatch.from_arrays(
            [
                *[batch.column(k) for k in keys],
                pa.array([model] * n_series, type=pa.string()),
                pa.array([STATUS_NAMES[s] for s in status], type=pa.string()),
                pa.array(scalars["n_obs"].astype(np.int32)),
                pa.array(scalars["rank"].astype(np.int32)),
                counted,
                _nullable(scalars["deviance"]),
                _nullable(scalars["dispersion"]),
                coefficients,
                fitted,
            ],
            names=[*keys, *[f.name for f in _RESULT]],
        )


def fit_segmented(
    series: DataFrame,
    keys: Sequence[str] = SERIES,
    models: Sequence[str] = MODELS,
    lagged: bool = False,
    season: str | None = "wrap",
    gate: str | None = POST_EVENT_PATTERN,
    outcome_col: str = "outcome_cohort_name",
    tolerance: float = 1e-8,
    max_iterations: int = 50,
) -> DataFrame:
    """Fit the models to every series: one row per series and model.

    * ``with_intervention``: (lag) + step * slope + season
    * ``remove_intervention``: (lag) + slope + season, on the rows up to the timepoint
    * ``step_slope``: step * slope

    all with offset log(person-years). Outcomes matching ``gate`` have no time before the event
    and are left out. A series that cannot be fitted gets a row with its ``status``.

    Input is one row per series and period, so the calendar bounds what is packed into one row;
    tasks then fit many packed series together in numpy. The packing groups by the keys the series
    windows are already partitioned by, so it adds no exchange.
    """
    keys = list(keys)
    if gate is not None and outcome_col in series.columns:
        series = outcome_gate(series, outcome_col, gate)
    before = as_col("incidence_start_date") <= as_col("timepoint")
    row = F.struct(
        as_col("time").cast("int").alias("time"),
        as_col("incidence_start_date").alias("date"),
        as_col("quarter").cast("int").alias("quarter"),
        as_col("intrv").cast("int").alias("intrv"),
        before.cast("int").alias("before"),
        as_col("n_events_sum").cast("double").alias("y"),
        as_col("person_years_sum").cast("double").alias("pt"),
    )
    key_cols = [as_col(k) for k in keys]
    packed = (
        series.groupBy(*key_cols)
        .agg(F.sort_array(F.collect_list(row)).alias("__rows"))
        .select(*key_cols, *[F.col("__rows")[c].alias(c) for c in _ROW])
    )
    settings = (keys, list(models), lagged, season, tolerance, max_iterations)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for portion in _portions(batch):
                yield from _fit_batch(portion, *settings)

    schema = T.StructType([packed.schema[k] for k in keys] + _RESULT)
    return packed.mapInArrow(fit, schema)


def predict_band(
    fits: DataFrame, keys: Sequence[str] = SERIES, level: float = 0.95
) -> DataFrame:
    """Predicted counts of every row with a symmetric normal band on the response scale.

    The band may go below zero; it is not cut.
    """
    z = NormalDist().inv_cdf(0.5 + level / 2.0)
    row = F.col("__row")
    half = F.lit(z) * row["mu"] * row["se_link"]
    return (
        fits.select(
            *[as_col(k) for k in keys], "model", "status", F.explode("fitted").alias("__row")
        )
        .withColumns(
            {
                **{c: row[c] for c in ("time", "date", "y", "pt", "used", "mu", "se_link")},
                "lower": row["mu"] - half,
                "upper": row["mu"] + half,
            }
        )
        .drop("__row")
    )


def counterfactual(
    fits: DataFrame, keys: Sequence[str] = SERIES, level: float = 0.95
) -> DataFrame:
    """What the time before the timepoint predicts for the whole series, with the observed lag."""
    return predict_band(fits.filter(as_col("model") == REMOVE_INTERVENTION), keys, level)


def _forecast(fits: DataFrame, keys: Sequence[str], decimals: int | None) -> DataFrame:
    rows = predict_band(fits, keys)

    def rate(c: str) -> Column:
        value = numbers.rate_per(c, "pt")
        return value if decimals is None else numbers.half_even(value, decimals)

    label = F.create_map(*[F.lit(x) for pair in MODEL_LABELS.items() for x in pair])
    return rows.select(
        *forecast_columns(
            rate("mu"), rate("lower"), rate("upper"), label[as_col("model")], as_col("date")
        )
    )


def forecast_table(series: DataFrame, keys: Sequence[str] = SERIES, season: str | None = "wrap") -> DataFrame:
    """Forecast rates per 100,000 of the three models, lagged fits, rounded for display.

    Rows a lagged model has no prediction for keep a NULL forecast.
    """
    return _forecast(fit_segmented(series, keys, lagged=True, season=season), keys, 2)


def forecast_table_monthly(series: DataFrame, keys: Sequence[str] = SERIES, season: str | None = "wrap") -> DataFrame:
    """The same on a monthly series."""
    return forecast_table(series, keys, season)


def forecast_plot_data(
    series: DataFrame,
    raw: DataFrame,
    keys: Sequence[str] = SERIES,
    season: str | None = "wrap",
    drop_last: int = 5,
) -> DataFrame:
    """Forecasts without lag, unrounded, with the observed rates, minus each series' last dates.

    ``raw`` is the output of ``raw_rate_series``; observed rates are shown for modelled series only.
    Both are rolled up, so the cut needs one window over the rows of a series and no join.
    """
    modelled = _forecast(fit_segmented(series, keys, lagged=False, season=season), keys, None)
    both = bag_union(
        modelled.withColumn("__modelled", F.lit(True)),
        raw.select(*modelled.columns, F.lit(False).alias("__modelled")),
    )
    # One row per series, model and period of the calendar: a series is small enough for a window.
    series_rows = W.partitionBy(*[as_col(c) for c in FORECAST_NAMES.values()])
    marked = both.withColumns(
        {
            "__cutoff": nth_last_date("Date", drop_last, over=series_rows),
            "__shown": F.bool_or("__modelled").over(series_rows),
        }
    )
    shown = marked.filter(as_col("__shown") & (as_col("Date") < as_col("__cutoff")))
    return shown.drop("__cutoff", "__shown", "__modelled")


def coefficients(fits: DataFrame, keys: Sequence[str] = SERIES) -> DataFrame:
    """One row per kept coefficient."""
    return fits.select(
        *[as_col(k) for k in keys],
        "model",
        "status",
        "n_obs",
        "rank",
        "df_residual",
        "deviance",
        "dispersion",
        F.inline("coefficients"),
    )


def coefficient_diagnostics(
    fits: DataFrame, keys: Sequence[str] = SERIES, decimals: int = 2
) -> DataFrame:
    """Coefficient table of the two seasonal models, rounded for display."""
    shown = coefficients(
        fits.filter(one_of("model", [WITH_INTERVENTION, REMOVE_INTERVENTION])), keys
    )
    label = F.create_map(*[F.lit(x) for pair in MODEL_LABELS.items() for x in pair])
    names = {
        "estimate": "Estimate",
        "std_error": "Std_Error",
        "t_value": "Statistics",
        "p_value": "P_value",
        "deviance": "deviance",
    }
    return shown.select(
        *[as_col(k) for k in keys],
        label[as_col("model")].alias("Model"),
        as_col("parameter").alias("Parameter"),
        *[numbers.half_even(old, decimals).alias(new) for old, new in names.items()],
    )


def _with_residuals() -> Column:
    fitted = [STATUS_NAMES[OK], STATUS_NAMES[NOT_CONVERGED]]
    return (as_col("model") == WITH_INTERVENTION) & one_of("status", fitted)


def residual_series(fits: DataFrame, keys: Sequence[str] = SERIES) -> DataFrame:
    """Deviance residuals of the with-intervention model, in time order by ``t``, with the fit's ``status``.

    A fit that did not converge keeps the residuals of its last step. A saturated fit reproduces its
    input; what is left is rounding noise, so it has no residuals.
    """
    fitted = fits.filter(_with_residuals())
    rows = predict_band(fitted, keys)
    kept = rows.filter(as_col("used") & as_col("mu").isNotNull())
    return deviance_residuals(kept, "y", "mu").withColumnRenamed("time", "t")


def residual_acf(fits: DataFrame, keys: Sequence[str] = SERIES) -> DataFrame:
    """Autocorrelation of the residuals and the fit's ``status``, straight from the arrays of the fit: nothing moves."""
    keys = [*keys, "status"]
    fitted = fits.filter(_with_residuals())
    kept = F.filter(as_col("fitted"), lambda row: row["used"] & row["mu"].isNotNull())
    residuals = F.transform(
        kept, lambda row: numbers.poisson_deviance_residual(row["y"], row["mu"])
    )
    rows = fitted.select(*[as_col(k) for k in keys], residuals.alias("__x"))
    return acf_of_arrays(rows, keys, "__x")


def residual_pacf(fits: DataFrame, keys: Sequence[str] = SERIES) -> DataFrame:
    """Partial autocorrelation of the residuals."""
    return pacf(residual_acf(fits, keys), [*keys, "status"])
