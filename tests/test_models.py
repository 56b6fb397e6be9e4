import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tieloom.operators import count_models as cm
from tieloom.operators import predictions
from tieloom.operators import sparse_design as sd
from tieloom.plans import model_suite
from tieloom.sources.tables import rows_to_table


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    data = []
    for k in range(600):
        women, x, z = k % 2, rng.random(), rng.gauss(0, 1)
        mean = math.exp(0.4 + 0.5 * women - 0.8 * x + 0.2 * z + 0.3 * women * x)
        y = np.random.default_rng(k).poisson(mean * rng.expovariate(1))
        data.append((women, x, None if k % 50 == 0 else z, int(y)))
    return rows_to_table(spark, data, "women int, x double, z double, y long").repartition(5)


FULL = cm.Model("full", "y", ("women", "x", "z", ("women", "x")))


def numpy_rows(df, model):
    pdf = df.toPandas().dropna(subset=model.columns)
    x = np.column_stack(
        [np.ones(len(pdf))] + [pdf[t] if isinstance(t, str) else pdf[t[0]] * pdf[t[1]] for t in model.terms]
    )
    return x, pdf[model.outcome].to_numpy(float)


def plain_fit(x, y):
    """Reweighted least squares on one machine."""
    mean = (y + y.mean()) / 2
    for _ in range(200):
        w, z = mean / (1 + mean), np.log(mean) + (y - mean) / mean
        beta = np.linalg.solve((x * w[:, None]).T @ x, (x * w[:, None]).T @ z)
        mean = np.exp(x @ beta)
    return beta, mean


@pytest.mark.parametrize("covariance,bread", [("robust", "observed"), ("robust", "expected"), ("model", "observed")])
def test_fit_against_one_machine(rows, covariance, bread):
    got = cm.fit(rows, FULL, covariance=covariance, bread=bread)
    x, y = numpy_rows(rows, FULL)
    beta, mean = plain_fit(x, y)
    assert got.rows == len(y) == 588
    assert got.coefficients == pytest.approx(beta, abs=1e-7)
    s = x * ((y - mean) / (1 + mean))[:, None]
    assert np.abs(s.sum(axis=0)).max() < 1e-4
    weight = {"observed": mean * (1 + y) / (1 + mean) ** 2, "expected": mean / (1 + mean)}
    a = np.linalg.inv((x * weight[bread][:, None]).T @ x)
    cov = a @ (s.T @ s) @ a if covariance == "robust" else np.linalg.inv((x * weight["expected"][:, None]).T @ x)
    assert got.covariance == pytest.approx(cov, rel=1e-5)
    assert got.log_likelihood == pytest.approx(np.sum(y * np.log(mean / (1 + mean)) - np.log1p(mean)))


def test_binary_predictor_has_closed_form(rows):
    got = cm.fit(rows, cm.Model("g", "y", ("women",)))
    y0, y1 = ([r.y for r in rows.filter(F.col("women") == w).collect()] for w in (0, 1))
    m0, m1 = np.mean(y0), np.mean(y1)
    assert got.coefficients == pytest.approx([math.log(m0), math.log(m1 / m0)])
    v0 = np.sum((y0 - m0) ** 2) / (len(y0) * m0) ** 2
    v1 = np.sum((y1 - m1) ** 2) / (len(y1) * m1) ** 2
    assert got.standard_errors == pytest.approx([math.sqrt(v0), math.sqrt(v0 + v1)])


def test_suite_shares_passes_and_reports_failures(spark, rows):
    models = [
        FULL,
        cm.Model("small", "y", ("x",)),
        cm.Model("collinear", "y", ("x", "x2")),
        cm.Model("hopeless", "nothing", ("x",)),
    ]
    data = rows.withColumn("x2", F.col("x") * 2).withColumn("nothing", F.lit(None).cast("double"))
    with pytest.warns(UserWarning, match="hopeless"):
        fits = cm.fit_models(data, models)
    assert set(fits) == {"full", "small", "collinear"}
    assert fits["full"].coefficients == pytest.approx(cm.fit(rows, FULL).coefficients, abs=1e-8)
    assert fits["small"].rows == 600
    # Collinear columns share the slope.
    b = fits["collinear"].coefficients
    assert b[1] + 2 * b[2] == pytest.approx(fits["small"].coefficients[1], abs=1e-6)
    table = cm.suite_table(spark, {k: fits[k] for k in ("full", "small")}, ["full", "small"]).collect()
    assert table[0].statistic == "Log-Likelihood" and table[0]["full"] is not None
    cells = {(r.statistic, r.variable): (r["full"], r["small"]) for r in table}
    assert cells[("Coefficient", "women:x")][1] is None
    assert cells[("IRR", "x")][1] == round(math.exp(fits["small"].coefficients[1]), 4)


def test_partitioning_does_not_change_a_fit(rows):
    a, b = cm.fit(rows, FULL), cm.fit(rows.coalesce(1), FULL)
    assert a.coefficients == pytest.approx(b.coefficients, abs=1e-9)


def test_coefficient_table(spark, rows):
    got = cm.fit(rows, FULL)
    table = cm.coefficient_table(spark, got).collect()
    assert [r.variable for r in table] == ["Log-Likelihood", "Intercept", "women", "x", "z", "women:x"]
    assert table[3].irr == round(math.exp(got.coefficients[2]), 4)
    assert 0 <= table[3].p_value <= 1


def test_nested_term_lists():
    models = model_suite.nested_models("y", ["c_A"])
    sizes = {m.name: len(m.terms) for m in models}
    assert list(sizes) == model_suite.NESTED_NAMES
    assert sizes["Model 1"] == 6 and sizes["Model 6"] == 10 and sizes["Model 11"] == 14
    by_name = {m.name: m.parameters for m in models}
    assert "women:constraint" in by_name["Model 9"] and "constraint" not in by_name["Model 11a"]
    assert "normalized_brokerage" not in by_name["Model 11b"]
    everything = model_suite.constraint_model("y", [f"p{k}" for k in range(7)], "all")
    assert len(everything.parameters) == 25


def test_predictions(spark, rows):
    fitted = cm.fit(rows, FULL)
    moments = predictions.wide_moments(rows, ["women", "x", "z"])
    grid = predictions.profile_grid(moments, ["women", "x", "z"], "x", predictions.arange_points(0.0, 1.1, 0.1))
    assert grid.count() == 22
    rows_ = predictions.marginal_effects(
        predictions.predict_interval(predictions.predict(grid, fitted, "link", "link"), fitted), fitted, "x"
    ).collect()
    mean_z = rows.agg(F.avg("z")).first()[0]
    b, v = fitted.coefficients, fitted.covariance
    for r in rows_:
        x = np.array([1, r.women, r.x, mean_z, r.women * r.x])
        assert r.z == pytest.approx(mean_z)
        assert r.link == pytest.approx(x @ b)
        se = math.sqrt(x @ v @ x)
        assert r.predicted == pytest.approx(math.exp(x @ b))
        assert r.lower_bound == pytest.approx(math.exp(x @ b - predictions.Z_95 * se))
        assert r.upper_bound == pytest.approx(math.exp(x @ b + predictions.Z_95 * se))
        assert r.marginal_effect == pytest.approx(b[2] * math.exp(x @ b))
        assert r.marginal_effect_total == pytest.approx((b[2] + b[4] * r.women) * math.exp(x @ b))
    wide = predictions.predict_interval(grid, fitted, z=10, scale="response").first()
    assert wide.upper_bound - wide.predicted == pytest.approx(10 * wide.std_error)


def test_scenarios_and_points(spark, rows):
    moments = predictions.wide_moments(rows, ["women", "x", "z"])
    got = predictions.scenario_grid(moments, ["women", "x", "z"], "x", "z", predictions.CORNERS).collect()
    assert len(got) == 10
    sd, mean = rows.agg(F.stddev("x"), F.avg("x")).first()
    assert {round(r.x, 9) for r in got} == {round(mean + k * sd, 9) for k in (-1, 0, 1)}
    points = spark.range(1).select(
        predictions.linspace_points(F.lit(2.0), F.lit(9.0), 100).alias("lin"),
        predictions.logspace_points(F.lit(2.0), F.lit(9.0), 100).alias("log"),
        predictions.arange_points(0.0, 1.0, 0.1).alias("ar"),
    ).first()
    assert points.lin == pytest.approx(np.linspace(2, 9, 100))
    assert points.log == pytest.approx(np.logspace(np.log10(3), np.log10(10), 100) - 1)
    assert points.ar == pytest.approx(np.arange(0, 1, 0.1))


def test_sparse_rows_give_the_dense_fit(spark):
    """500 values of an array, products with all of them, nulls and a value that is the reference."""
    rng = random.Random(11)
    data = []
    for k in range(6000):
        place = [f"v{k % 501:03d}"] + ([f"v{rng.randrange(501):03d}"] if k % 3 else [])
        x = None if k % 97 == 0 else rng.random()
        y = 1 + np.random.default_rng(k).poisson(1 + (k % 501) % 7)
        data.append((k % 2, x, None if k % 101 == 0 else place, int(y)))
    rows = rows_to_table(spark, data, "women int, x double, place array<string>, y long").repartition(4)
    values = [f"v{v:03d}" for v in range(1, 501)]
    sparse, names = sd.sparse_design(rows, "y", ["women", "x", sd.Places("place", "place", "v000")], "women", ["x"])
    got = cm.fit_sparse(sparse, names)
    # the dense form on one machine
    ok = [r for r in data if r[1] is not None and r[2] is not None]
    x = np.zeros((len(ok), 504))
    for i, (w, v, places, _) in enumerate(ok):
        x[i, [0, 1, 2, 503]] = 1, w, v, w * v
        for p in places:
            if p != "v000":
                x[i, 3 + values.index(p)] = 1
    y = np.array([r[3] for r in ok], float)
    beta, mean = plain_fit(x, y)
    assert names == ["Intercept", "women", "x", *[f"place_{v}" for v in values], "women:x"]
    assert got.rows == len(ok)
    assert got.coefficients == pytest.approx(beta, abs=1e-6)
    s = x * ((y - mean) / (1 + mean))[:, None]
    a = np.linalg.inv((x * (mean * (1 + y) / (1 + mean) ** 2)[:, None]).T @ x)
    assert got.standard_errors == pytest.approx(np.sqrt(np.diag(a @ (s.T @ s) @ a)), rel=1e-4)


def test_sparse_rows_hold_what_is_not_zero(spark):
    df = rows_to_table(
        spark, [(1, 0.0, "a", ["p", None, "p"], 2), (0, 3.0, None, ["r"], 1), (1, 2.0, "b", [], 4), (1, 1.0, "b", None, 5)],
        "women int, x double, one string, many array<string>, y long",
    )
    one, many = sd.Places("one", "one", "b"), sd.Places("many", "many")
    rows, names = sd.sparse_design(df, "y", ["women", "x", one, many], "women", ["x", many])
    assert names == ["Intercept", "women", "x", "one_a", "many_p", "many_r", "women:x", "women:many_p", "women:many_r"]
    got = {r.y: r["columns"] and dict(zip(r["columns"], r["values"])) for r in rows.collect()}
    assert got == {2: {0: 1, 1: 1, 3: 1, 4: 1, 7: 1}, 1: {0: 1, 2: 3, 5: 1}, 4: {0: 1, 1: 1, 2: 2, 6: 2}, 5: None}
    with pytest.raises(ValueError):
        cm.fit_sparse(rows.limit(0), names)
