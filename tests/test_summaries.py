import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from tests import graphs
from tieloom.operators import cohorts, densities, features, quantiles, summaries
from tieloom.functions.numeric import half_up
from tieloom.staging import fresh_path, staged
from tieloom.sources import tables
from tieloom.sources.tables import rows_to_table


def test_half_up(spark):
    df = rows_to_table(spark, [(0.285,), (1.005,), (-0.125,), (None,)], "x double")
    assert [r.y for r in df.select(half_up(F.col("x"), 2).alias("y")).collect()] == [0.29, 1.01, -0.13, None]


@pytest.mark.parametrize("n", [1, 2, 3, 10, 1001, 30_000])
def test_exact_medians(spark, n):
    """One group holds most rows; values repeat; nulls and a null group are kept apart."""
    rng = random.Random(n)
    rows = [("a" if k % 5 else None, float(rng.randint(0, max(2, n // 3))), rng.gauss(0, 1)) for k in range(n)]
    df = rows_to_table(spark, rows + [("a", None, None), ("c", None, None)], "g string, x double, y double")
    got = {(r.g, r.metric): r.median for r in quantiles.exact_medians(df.repartition(7), ["g"], ["x", "y"]).collect()}
    want = {}
    for g in {r[0] for r in rows}:
        for k, metric in ((1, "x"), (2, "y")):
            want[(g, metric)] = statistics.median(r[k] for r in rows if r[0] == g)
    assert got == pytest.approx(want)
    rough = quantiles.approximate_medians(df, ["g"], ["x"]).count()
    assert rough == len({g for g, _ in want})


def test_cohorts(spark):
    v = graphs.vertex_table(
        spark, [1, 2, 3, 4], focal={1, 2, 3},
        category={2: "male", 3: None},
        countries={1: ["A", "B"], 2: ["A", "A"]}, subject_areas={1: ["S1", "S2"]},
    )
    m = rows_to_table(spark, [(1, 4, 0.5), (2, 6, 0.0)], "id long, open_triads_count long, share double")
    got = {
        (r.category, r.country, r.subject): (r.mean, r.median, r.std_dev)
        for r in cohorts.cohort_stats(v, m, ["open_triads_count"], ["female", "male"], ["A", "B"], ["S1", "S2"]).collect()
    }
    assert got[("male", "A", "S1")] == (6.0, 6.0, None)
    assert set(got) == {("male", "A", "S1")} | {("female", c, s) for c in "AB" for s in ("S1", "S2")}
    assert cohorts.cohort_filter(v, "female", "B", "S2").count() == 1


def test_summaries(spark):
    df = rows_to_table(
        spark,
        [("female", 0.0, 2.0), ("female", 1.0, None), ("male", 0.0, 4.0), (None, 5.0, 5.0)], "g string, x double, y double"
    )
    shares = {r.g: r.pct_zero_x for r in summaries.zero_share(df, "g", "x", ["y"]).collect()}
    assert shares == {"female": 50.0, "male": 100.0, None: 0.0}
    table = {r.statistic: (r.x, r.y) for r in summaries.describe_table(df, ["x", "y"]).collect()}
    assert table["median"] == (0.5, 4.0) and table["max"] == (5.0, 5.0)
    turned = {r.metric: (r.female, r.male) for r in summaries.summary_transposed(df, "g", ["female", "male"], ["x"]).collect()}
    assert turned["x_mean"] == (0.5, 0.0) and turned["x_median"] == (0.5, 0.0)
    assert {r["column"]: r.missing for r in summaries.null_audit(df, ["g", "y"]).collect()} == {"g": 1, "y": 1}
    assert summaries.missing_rows(df, "y").count() == 1
    q = summaries.quadrant_share(df, "x", "y", (0.0, 3.0), (1.0, 5.0)).first()
    assert (q.low_low, q.high_high) == (0.25, 0.25)
    path = fresh_path(spark, "test-csv")
    small = summaries.group_summary(df, "g", ["x"])
    tables.write_summary_csv(small, path)
    assert sorted(tables.read_summary_csv(spark, path, small.schema).collect(), key=str) == sorted(small.collect(), key=str)


def test_features(spark):
    counts = rows_to_table(spark, [(1, 1, None, 3, 2), (2, None, None, None, 1)], "id long, `2009` long, `2010` long, `2011` long, `2012` long")
    rows = {r.id: r for r in features.year_features(counts, [2009, 2010, 2011], [2012]).collect()}
    assert (rows[1].baseline_output, rows[1].outcome_output, rows[1].avg_year_diff) == (4, 2, 1.5)
    assert (rows[2].baseline_output, rows[2].avg_year_diff) == (0, None)
    df = rows_to_table(
        spark,
        [(1, "female", ["A", "B"], ["S"]), (2, None, [], ["S"]), (3, "male", None, ["S", "T"])],
        "id long, category string, c array<string>, s array<string>",
    )
    crossed = features.cross_affiliation(df, "c", "s").select("id", "country", "subject").collect()
    assert sorted(map(tuple, crossed)) == [(1, "A", "S"), (1, "B", "S")]
    assert [r.w for r in df.select(features.women().alias("w")).collect()] == [1, 0, 0]
    hot = {r.id: (r.s_S, r.s_T) for r in features.multi_hot(df, "s", ["R", "S", "T"], "s", "R").collect()}
    assert hot == {1: (1, 0), 2: (1, 0), 3: (1, 1)}
    assert summaries.multi_affiliation(df, "c", "s").count() == 2
    assert features.exploded_attribute(df, "c", "x").count() == 2


def test_histogram_edges(spark):
    df = rows_to_table(spark, [(1, x) for x in (0.0, 1.9, 2.0, 4.0, 4.1)] + [(0, 1.0)], "g int, x double")
    got = {(r.g, r.bin): (r.rows, r.density) for r in densities.density_histogram(df, "x", "g", 0, 4, 2).collect()}
    assert got == {(1, 0): (2, 0.25), (1, 1): (2, 0.25), (1, 2): (1, None), (0, 0): (1, 0.5)}


def test_density_curve_integrates_to_one(spark):
    df = spark.range(500).select((F.col("id") % 2).alias("g"), (F.col("id") % 17).cast("double").alias("x"))
    rows = densities.density_curve(df, "x", "g").collect()
    for g in (0, 1):
        mine = sorted((r.x, r.density) for r in rows if r.g == g)
        step = mine[1][0] - mine[0][0]
        assert len(mine) == 200 and sum(d for _, d in mine) * step == pytest.approx(1, abs=5e-3)


def test_density_curve_against_a_plain_sum(spark, monkeypatch):
    """Uneven partitions, repeated values, names as groups, a group without spread, nulls; in small pieces."""
    monkeypatch.setattr(densities, "VALUES_AT_A_TIME", 7)
    monkeypatch.setattr(densities, "GROUPS_AT_A_TIME", 1)
    values = {"a": [(i * i % 31) / 3 for i in range(90)], "b": [float(i % 5) for i in range(40)], "flat": [2.0] * 6}
    rows = [(g, v) for g, vs in values.items() for v in vs] + [("a", None), ("empty", None)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(5)
    got = {}
    for r in densities.density_curve(df, "x", "g", points=30).collect():
        got.setdefault(r.g, []).append((r.point, r.x, r.density))
    assert got.pop("flat") == [(0, 2.0, None)] and set(got) == {"a", "b"}
    for g, found in got.items():
        x = values[g]
        width = statistics.stdev(x) * len(x) ** -0.2
        assert [p for p, _, _ in sorted(found)] == list(range(30))
        for _, at, density in found:
            want = sum(math.exp(-(((at - v) / width) ** 2) / 2) for v in x) / (len(x) * width * math.sqrt(2 * math.pi))
            assert density == pytest.approx(want, rel=1e-9)


def test_density_shuffles_sums_only(spark):
    df = staged(spark.range(20_000).select((F.col("id") % 2).alias("g"), (F.col("id") * 1.5).alias("x")).repartition(4), "values")
    plan = densities.density_curve(df, "x", "g")._jdf.queryExecution().executedPlan().toString()
    shuffled = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert shuffled and all("point" in line for line in shuffled)


def test_sketches_merge_upwards(spark):
    df = spark.range(60_000).select((F.col("id") % 3).alias("g"), (F.col("id") % 50).alias("h"), F.pmod(F.col("id") * 7919, F.lit(60_000)).cast("double").alias("x"))
    parts = quantiles.quantile_sketches(df, ["g", "h"], ["x"], 400)
    for keys in (["g"], []):
        for r in quantiles.sketched_quantile(quantiles.merged_sketches(parts, keys, 400)).collect():
            assert r.n == (20_000 if keys else 60_000) and abs(r["median"] - 30_000) <= 3 * quantiles.rank_error(400) * 60_000
    few = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 9.0), ("a", None), ("b", float("nan")), ("c", 4.0)], "g string, x double")
    got = {r.g: (r.n, r["median"]) for r in quantiles.sketched_quantile(quantiles.quantile_sketches(few, ["g"], ["x"])).collect()}
    assert got == {"a": (3, 2.0), "c": (1, 4.0)}


def test_seeded_sample_does_not_depend_on_partitions(spark):
    df = spark.range(1000).withColumnRenamed("id", "key")
    a = [r.key for r in densities.seeded_sample(df.repartition(9), "key", 30, 42).collect()]
    b = [r.key for r in densities.seeded_sample(df.coalesce(1), "key", 30, 42).collect()]
    assert a == b and len(set(a)) == 30
    assert a != [r.key for r in densities.seeded_sample(df, "key", 30, 43).collect()]
