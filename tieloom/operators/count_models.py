"""Negative-binomial count models with log link, fitted as Spark aggregations.

The dispersion is 1, so the variance at mean m is m + m^2. A fit scans the design rows once
per Newton step. Each task turns its Arrow batches into a few sums per model, Spark adds the
sums up, and only numbers of size parameters x parameters reach the driver. All models of a
suite share the scans.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tieloom.operators.sparse_design import SparseRows
from tieloom.sources.tables import rows_to_table
from tieloom.staging import staged

INTERCEPT = "Intercept"
Term = str | tuple[str, str]


@dataclass(frozen=True)
class Model:
    """An outcome and its terms: column names, or pairs of them for a product."""

    name: str
    outcome: str
    terms: tuple[Term, ...]

    @property
    def parameters(self) -> list[str]:
        return [INTERCEPT] + [t if isinstance(t, str) else f"{t[0]}:{t[1]}" for t in self.terms]

    @property
    def columns(self) -> list[str]:
        used = [self.outcome]
        for term in self.terms:
            used += [term] if isinstance(term, str) else list(term)
        return list(dict.fromkeys(used))


@dataclass(frozen=True)
class Fit:
    """A fitted model with the sums that any of the covariance estimates needs."""

    model: Model
    coefficients: np.ndarray
    log_likelihood: float
    rows: int
    passes: int
    observed: np.ndarray
    expected: np.ndarray
    score_products: np.ndarray
    kind: str = "robust"
    bread: str = "observed"

    @property
    def covariance(self) -> np.ndarray:
        """HC0 around the chosen information, or the inverse of the expected information."""
        if self.kind == "model":
            return _inverse(self.expected)
        inverse = _inverse({"observed": self.observed, "expected": self.expected}[self.bread])
        return inverse @ self.score_products @ inverse

    def with_covariance(self, kind: str, bread: str = "observed") -> Fit:
        """The same fit with another covariance; the data is not read again."""
        return replace(self, kind=kind, bread=bread)

    def coefficient(self, parameter: str) -> float:
        return float(self.coefficients[self.model.parameters.index(parameter)])

    @property
    def standard_errors(self) -> np.ndarray:
        return np.sqrt(np.diag(self.covariance))


def with_products(columns: Sequence[str], factor: str, others: Sequence[str]) -> tuple[Term, ...]:
    """Terms for ``columns`` plus the product of ``factor`` with each of ``others``."""
    return tuple(columns) + tuple((factor, o) for o in others)


def _design(model: Model, data: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the model without missing values: the matrix and the outcome."""
    y = data[model.outcome]
    parts = [np.ones_like(y)] + [
        data[t] if isinstance(t, str) else data[t[0]] * data[t[1]] for t in model.terms
    ]
    x = np.column_stack(parts)
    complete = np.isfinite(y) & np.isfinite(x).all(axis=1)
    return x[complete], y[complete]


def _dense_batch(models: list[Model], batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    names = batch.schema.names
    data = {n: batch.column(k).to_numpy(zero_copy_only=False).astype(float) for k, n in enumerate(names)}
    for i, model in enumerate(models):
        yield i, *_design(model, data)


def _sparse_batch(models: list[Model], batch: pa.RecordBatch) -> Iterator[tuple[int, SparseRows, np.ndarray]]:
    """Outcome, columns and values of one model; rows without entries or with one that is not finite are left out."""
    y = batch.column(0).to_numpy(zero_copy_only=False).astype(float)
    sizes = np.nan_to_num(batch.column(1).value_lengths().to_numpy(zero_copy_only=False).astype(float)).astype(np.int64)
    column = batch.column(1).flatten().to_numpy(zero_copy_only=False)
    value = batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(float)
    owner = np.repeat(np.arange(len(y)), sizes)
    keep = np.isfinite(y) & (sizes > 0)
    keep &= np.bincount(owner, ~np.isfinite(value), len(y)) == 0
    entry = keep[owner]
    yield 0, SparseRows(sizes[keep], column[entry], value[entry], len(models[0].parameters)), y[keep]


def _gram(x: np.ndarray | SparseRows, weight: np.ndarray) -> np.ndarray:
    return x.gram(weight) if isinstance(x, SparseRows) else (x * weight[:, None]).T @ x


def _project(x: np.ndarray | SparseRows, v: np.ndarray) -> np.ndarray:
    return x.project(v) if isinstance(x, SparseRows) else x.T @ v


def _start_sums(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Sums of a weighted least squares fit to the log of the shifted outcome."""
    mean = y + 0.5
    weight = mean / (1 + mean)
    target = np.log(mean) + (y - mean) / mean
    return np.concatenate([[len(y)], _project(x, weight * target), _gram(x, weight).ravel()])


def _step_sums(x: np.ndarray, y: np.ndarray, beta: np.ndarray, full: bool) -> np.ndarray:
    """Log-likelihood, score and observed information; with ``full`` also what covariances need."""
    mean = np.exp(x @ beta)
    log_likelihood = np.sum(y * np.log(mean / (1 + mean)) - np.log1p(mean))
    residual = (y - mean) / (1 + mean)
    observed = _gram(x, mean * (1 + y) / (1 + mean) ** 2)
    sums = [[len(y), log_likelihood], _project(x, residual), observed.ravel()]
    if full:
        expected = _gram(x, mean / (1 + mean))
        squared = _gram(x, residual**2)
        sums += [expected.ravel(), squared.ravel()]
    return np.concatenate(sums)


def _summed(design: DataFrame, models: list[Model], sums_of, matrices=_dense_batch) -> dict[int, np.ndarray]:
    """Add up ``sums_of(i, x, y)`` over all design rows, for every model ``i``.

    ``matrices`` gives the models' matrices and outcomes of a batch.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, x, y in matrices(models, batch):
                part = sums_of(i, x, y)
                if part is not None:
                    totals[i] = totals[i] + part if i in totals else part
        if totals:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(list(totals), pa.int32()),
                    pa.array([v.tolist() for v in totals.values()], pa.list_(pa.float64())),
                ],
                names=["model", "sums"],
            )

    def added_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                totals[i] = totals[i] + np.array(part) if i in totals else np.array(part)
        if totals:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(totals), pa.int32()), pa.array([v.tolist() for v in totals.values()], pa.list_(pa.float64()))],
                names=["model", "sums"],
            )

    schema = "model int, sums array<double>"
    per_task = design.mapInArrow(partial, schema)
    # with many tasks their sums meet in a few before they are taken apart
    few = int(design.rdd.getNumPartitions() ** 0.5)
    if few > 4:
        per_task = per_task.repartition(few).mapInArrow(added_up, schema)
    added = (
        per_task.select("model", F.posexplode("sums").alias("position", "part"))
        .groupBy("model", "position")
        .agg(F.sum("part").alias("total"))
        .collect()
    )
    sizes: dict[int, int] = {}
    for row in added:
        sizes[row.model] = max(sizes.get(row.model, 0), row.position + 1)
    totals = {i: np.zeros(size) for i, size in sizes.items()}
    for row in added:
        totals[row.model][row.position] = row.total
    return totals


def _solve(information: np.ndarray, right: np.ndarray) -> np.ndarray:
    return _inverse(information) @ right


def _inverse(information: np.ndarray) -> np.ndarray:
    """Inverse after scaling the diagonal to 1; a pseudo-inverse if columns are collinear."""
    scale = np.sqrt(np.where(np.diag(information) > 0, np.diag(information), 1.0))
    return np.linalg.pinv(information / np.outer(scale, scale), hermitian=True) / np.outer(scale, scale)


def fit_models(
    rows: DataFrame,
    models: Sequence[Model],
    covariance: str = "robust",
    bread: str = "observed",
    tolerance: float = 1e-8,
    max_passes: int = 100,
) -> dict[str, Fit]:
    """Fit all models over the same rows; a model that cannot be fitted is reported and left out.

    ``covariance`` is ``"robust"`` (heteroscedasticity-consistent, HC0) or ``"model"``. The
    information matrix in it is ``"observed"`` or ``"expected"``. Rows where a column of a
    model is missing are left out of that model only.
    """
    models = list(models)
    columns = list(dict.fromkeys(c for m in models for c in m.columns))
    design = staged(rows.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in columns]), "design")
    return _fits(design, models, _dense_batch, covariance, bread, tolerance, max_passes)


def fit_sparse(
    rows: DataFrame,
    names: Sequence[str],
    name: str = "sparse",
    covariance: str = "robust",
    bread: str = "observed",
    tolerance: float = 1e-8,
    max_passes: int = 100,
) -> Fit:
    """Fit one model to the rows of ``sparse_design``, whose column names are ``names``."""
    model = Model(name, rows.columns[0], tuple(names[1:]))
    fits = _fits(staged(rows, "design"), [model], _sparse_batch, covariance, bread, tolerance, max_passes)
    if name not in fits:
        raise ValueError(f"model {name} could not be fitted")
    return fits[name]


def _fits(
    design: DataFrame, models: list[Model], matrices, covariance: str, bread: str, tolerance: float, max_passes: int
) -> dict[str, Fit]:
    """Newton's method for all models over a staged design."""
    beta: dict[int, np.ndarray] = {}
    for i, sums in _summed(design, models, lambda i, x, y: _start_sums(x, y), matrices).items():
        p = len(models[i].parameters)
        if sums[0] > 0:
            beta[i] = _solve(sums[1 + p :].reshape(p, p), sums[1 : 1 + p])
    open_fits = set(beta)
    before: dict[int, tuple[np.ndarray, float]] = {}
    passes = 1
    while open_fits and passes < max_passes:
        now = {i: beta[i] for i in open_fits}
        summed = _summed(
            design, models, lambda i, x, y: _step_sums(x, y, now[i], False) if i in now else None, matrices
        )
        passes += 1
        for i, sums in summed.items():
            p = len(beta[i])
            log_likelihood, score = sums[1], sums[2 : 2 + p]
            if not np.isfinite(sums).all():
                if i not in before:
                    open_fits.discard(i)
                    beta.pop(i)
                else:
                    beta[i] = (beta[i] + before[i][0]) / 2
                continue
            if i in before and log_likelihood < before[i][1] - 1e-9 * abs(before[i][1]):
                beta[i] = (beta[i] + before[i][0]) / 2
                continue
            step = _solve(sums[2 + p :].reshape(p, p), score)
            before[i] = (beta[i], log_likelihood)
            beta[i] = beta[i] + step
            # Twice the gain the step can still bring, so it compares with a change in deviance.
            if score @ step < max(tolerance, 1e-13 * abs(log_likelihood)):
                open_fits.discard(i)

    final = dict(beta)
    fits: dict[str, Fit] = {}
    summed = (
        _summed(design, models, lambda i, x, y: _step_sums(x, y, final[i], True) if i in final else None, matrices)
        if final
        else {}
    )
    for i, model in enumerate(models):
        if i not in summed or not np.isfinite(summed[i]).all() or i in open_fits:
            warnings.warn(f"model {model.name} could not be fitted", stacklevel=2)
            continue
        p, sums = len(final[i]), summed[i]
        at = 2 + p
        matrices = [sums[at + k * p * p : at + (k + 1) * p * p].reshape(p, p) for k in range(3)]
        fits[model.name] = Fit(
            model, final[i], float(sums[1]), int(sums[0]), passes + 1, *matrices, covariance, bread
        )
    return fits


def fit(rows: DataFrame, model: Model, **options) -> Fit:
    fits = fit_models(rows, [model], **options)
    if model.name not in fits:
        raise ValueError(f"model {model.name} could not be fitted")
    return fits[model.name]


def _p_value(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def _finite(value: float, places: int | None) -> float | None:
    if not math.isfinite(value):
        return None
    return round(value, places) if places is not None else value


COEFFICIENT_SCHEMA = (
    "position int, variable string, coefficient double, irr double, std_error double, z double, p_value double"
)


def coefficient_table(spark: SparkSession, fitted: Fit, places: int | None = 4) -> DataFrame:
    """Log-likelihood first, then one row per parameter; rounded unless ``places`` is None."""
    rows = [(0, "Log-Likelihood", _finite(fitted.log_likelihood, places), None, None, None, None)]
    for k, (name, b, se) in enumerate(
        zip(fitted.model.parameters, fitted.coefficients, fitted.standard_errors), start=1
    ):
        z = float(b / se) if se > 0 else math.nan
        numbers = [float(b), math.exp(b), float(se), z, _p_value(z)]
        rows.append((k, name, *[_finite(v, places) for v in numbers]))
    return rows_to_table(spark, rows, COEFFICIENT_SCHEMA)


def suite_table(
    spark: SparkSession, fits: dict[str, Fit], order: list[str], places: int | None = 4
) -> DataFrame:
    """One row per statistic and variable, one column per model; terms a model lacks are null.

    The last row tells which models of ``order`` could be fitted.
    """
    variables = list(dict.fromkeys(v for f in fits.values() for v in f.model.parameters))
    values: dict[tuple[str, str], dict[str, float | None]] = {("Log-Likelihood", ""): {}}
    for variable in variables:
        for statistic in ("Coefficient", "IRR", "P-value"):
            values[(statistic, variable)] = {}
    for name, f in fits.items():
        values[("Log-Likelihood", "")][name] = _finite(f.log_likelihood, places)
        for v, b, se in zip(f.model.parameters, f.coefficients, f.standard_errors):
            z = float(b / se) if se > 0 else math.nan
            values[("Coefficient", v)][name] = _finite(float(b), places)
            values[("IRR", v)][name] = _finite(math.exp(b), places)
            values[("P-value", v)][name] = _finite(_p_value(z), places)
    # 1 for a model that was fitted, 0 for one that was not
    values["Converged", ""] = {name: float(name in fits) for name in order}
    rows = [
        (k, statistic, variable, *[cells.get(m) for m in order])
        for k, ((statistic, variable), cells) in enumerate(values.items())
    ]
    models = ", ".join(f"`{m}` double" for m in order)
    return rows_to_table(spark, rows, f"position int, statistic string, variable string, {models}")
