"""Prediction grids, scenarios, intervals and marginal effects of fitted count models."""

from __future__ import annotations

from functools import reduce
from operator import add

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tieloom.operators.count_models import INTERCEPT, Fit

Z_95 = 1.959963984540054


def arange_points(start: float, stop: float, step: float) -> Column:
    """Array of ``start``, ``start + step``, ... below ``stop``."""
    n = int(np.ceil((stop - start) / step - 1e-9))
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.lit(start) + k * F.lit(step))


def linspace_points(low: Column, high: Column, n: int) -> Column:
    """Array of ``n`` evenly spaced values from ``low`` to ``high``."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(n - 1)), lambda k: low + (high - low) * k / F.lit(float(n - 1))
    )


def logspace_points(low: Column, high: Column, n: int) -> Column:
    """Array of ``n`` values from ``low`` to ``high`` that are evenly spaced in ``log(x + 1)``."""
    a, b = F.log10(low + 1), F.log10(high + 1)
    return F.transform(
        F.sequence(F.lit(0), F.lit(n - 1)),
        lambda k: F.pow(F.lit(10.0), a + (b - a) * k / F.lit(float(n - 1))) - 1,
    )


def wide_moments(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: mean, deviation, min and max of each column over its own non-null values."""
    stats = {"mean": F.avg, "sd": F.stddev_samp, "min": F.min, "max": F.max}
    return df.agg(
        *[f(F.col(f"`{c}`").cast("double")).alias(f"{s} {c}") for c in columns for s, f in stats.items()]
    )


def moment(statistic: str, column: str) -> Column:
    """A column of ``wide_moments``."""
    return F.col(f"`{statistic} {column}`")


def profile_grid(
    moments: DataFrame,
    predictors: list[str],
    swept: str,
    points: Column,
    held: dict[str, Column] | None = None,
    group: str = "women",
) -> DataFrame:
    """Predictors at their means, one swept over ``points``, ``group`` at 1 and 0.

    ``held`` fixes further predictors, for instance at mean plus one deviation. The grid is
    generated from the single row of ``moments``. Products of predictors are not columns of
    the grid; ``predict`` forms them from the swept values.
    """
    fixed = held or {}

    def value(c: str) -> Column:
        return fixed.get(c, moment("mean", c))

    others = [c for c in predictors if c not in (swept, group)]
    return (
        moments.withColumn("swept value", F.explode(points))
        .withColumn("group value", F.explode(F.array(F.lit(1), F.lit(0))))
        .select(
            F.col("group value").alias(group),
            F.col("swept value").alias(swept),
            *[value(c).alias(c) for c in others],
        )
    )


# Multiples of the standard deviation in the scenario sets.
CORNERS = [(1, 1), (1, -1), (-1, 1), (-1, -1), (0, 0)]
ONE_AT_A_TIME = [(1, 0), (0, 0), (-1, 0), (0, 1), (0, -1)]


def scenario_grid(
    moments: DataFrame,
    predictors: list[str],
    first: str,
    second: str,
    scenarios: list[tuple[int, int]],
    group: str = "women",
) -> DataFrame:
    """Two predictors at mean plus multiples of their deviation, ``group`` at 1 and 0."""
    steps = F.array(
        *[
            F.struct(F.lit(i + 1).alias("scenario"), F.lit(a).alias("step_a"), F.lit(b).alias("step_b"))
            for i, (a, b) in enumerate(scenarios)
        ]
    )
    others = [c for c in predictors if c not in (first, second, group)]
    return (
        moments.select("*", F.inline(steps))
        .withColumn("group value", F.explode(F.array(F.lit(1), F.lit(0))))
        .select(
            "scenario",
            F.col("group value").alias(group),
            (moment("mean", first) + F.col("step_a") * moment("sd", first)).alias(first),
            (moment("mean", second) + F.col("step_b") * moment("sd", second)).alias(second),
            *[moment("mean", c).alias(c) for c in others],
        )
    )


def _parameter_values(fitted: Fit) -> list[Column]:
    values = []
    for term in [INTERCEPT, *fitted.model.terms]:
        if term == INTERCEPT:
            values.append(F.lit(1.0))
        elif isinstance(term, str):
            values.append(F.col(f"`{term}`").cast("double"))
        else:
            values.append(F.col(f"`{term[0]}`").cast("double") * F.col(f"`{term[1]}`"))
    return values


def linear_predictor(fitted: Fit) -> Column:
    return reduce(
        add, [v * F.lit(float(b)) for v, b in zip(_parameter_values(fitted), fitted.coefficients)]
    )


def predict(grid: DataFrame, fitted: Fit, name: str = "predicted", scale: str = "response") -> DataFrame:
    """Adds the prediction on the ``"response"`` or the ``"link"`` scale."""
    eta = linear_predictor(fitted)
    return grid.withColumn(name, eta if scale == "link" else F.exp(eta))


def predict_interval(grid: DataFrame, fitted: Fit, z: float = Z_95, scale: str = "link") -> DataFrame:
    """Adds ``predicted``, ``std_error``, ``lower_bound`` and ``upper_bound``.

    ``scale="link"`` forms the interval on the link scale and transforms its ends;
    ``"response"`` takes the prediction plus and minus z times its standard error.
    """
    values = _parameter_values(fitted)
    cov = fitted.covariance
    variance = reduce(
        add,
        [
            values[i] * values[j] * F.lit(float(cov[i, j] * (1 if i == j else 2)))
            for i in range(len(values))
            for j in range(i, len(values))
        ],
    )
    out = grid.withColumn("eta", linear_predictor(fitted)).withColumn("eta_se", F.sqrt(variance))
    mean, se = F.exp("eta"), F.exp("eta") * F.col("eta_se")
    if scale == "link":
        bounds = [F.exp(F.col("eta") - z * F.col("eta_se")), F.exp(F.col("eta") + z * F.col("eta_se"))]
    else:
        bounds = [mean - z * se, mean + z * se]
    return out.withColumns(
        {"predicted": mean, "std_error": se, "lower_bound": bounds[0], "upper_bound": bounds[1]}
    ).drop("eta", "eta_se")


def marginal_effects(grid: DataFrame, fitted: Fit, variable: str, group: str = "women") -> DataFrame:
    """Adds the expected value and the effect of ``variable`` on it.

    ``marginal_effect`` uses the main coefficient alone; ``marginal_effect_total`` adds the
    coefficient of the product with ``group``, if the model has one.
    """
    main = F.lit(fitted.coefficient(variable))
    product = f"{group}:{variable}"
    slope = main
    if product in fitted.model.parameters:
        slope = main + F.lit(fitted.coefficient(product)) * F.col(group)
    expected = F.exp(linear_predictor(fitted))
    return grid.withColumn("expected_value", expected).withColumns(
        {
            "marginal_effect": main * F.col("expected_value"),
            "marginal_effect_total": slope * F.col("expected_value"),
        }
    )
