"""All queries by name. Each takes a session and a data folder and returns a DataFrame.

Floating-point results are rounded here, so that they can be compared with another engine's.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tieloom.functions.arrays import has_entries, joined, share_a_value
from tieloom.functions.numeric import half_up, significant
from tieloom.operators import (
    batching,
    cohorts,
    count_models,
    densities,
    features,
    graph,
    neighbourhood,
    predictions,
    quantiles,
    second_order,
    sparse_design,
    summaries,
    triads,
    updates,
)
from tieloom.plans import ego_analysis, model_suite, part_network as pn
from tieloom.sources import tables
from tieloom.sources.bucketed import overwrite_part
from tieloom.staging import fresh_path, staged
from tieloom.streaming import resume

# Bounds of the two quadrants, sample sizes and batch counts of the reports.
LOW_QUADRANT = (0.2786, 0.01749)
HIGH_QUADRANT = (0.8092, 0.3887)
SAMPLE_ROWS, SAMPLE_SEED = 150, 42
BROKERAGE_BATCHES = 20
OPEN_ATTRIBUTES = ["category", "first_pub_year", "countries"]
# Bounds of the range filter query.
MOST_DEGREE, MORE_THAN = 60, 1

SUMMARY_COLUMNS = [
    "degree", "years_from_first_pub", "interdisciplinary_reach", "baseline_output",
    "normalized_brokerage", "constraint", "normalized_homophily", "avg_year_diff",
]
STATS_COLUMNS = [
    "degree", "pct_homophilic_collabs", "mean_collab_tenure", "mean_collab_pub_count", "interdisciplinary_reach",
]
PLACES = model_suite.dummies(pn.REGIONS, "country", pn.REFERENCE_REGION) + model_suite.dummies(
    pn.SUBJECTS, "subject", pn.REFERENCE_SUBJECT
)
PREDICTORS = ["women", *model_suite.KEY_PREDICTORS, *PLACES, *model_suite.CONTROLS]
DESIGN_ARGS = (pn.REGIONS, pn.SUBJECTS, pn.REFERENCE_REGION, pn.REFERENCE_SUBJECT)

_written: dict[tuple[str, str, str], DataFrame] = {}


def _once(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A table that several queries start from, written once per application."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _written:
        _written[key] = staged(build(), name, keep=True)
    return _written[key]


def _rounded(df: DataFrame, places: int = 8, columns: list[str] | None = None) -> DataFrame:
    doubles = [n for n, t in df.dtypes if t == "double" and (columns is None or n in columns)]
    return df.withColumns({c: half_up(F.col(f"`{c}`"), places) for c in doubles})


def _long_counts(df: DataFrame) -> DataFrame:
    """Integer columns as 64-bit, arrays as text."""
    fixed = {n: F.col(f"`{n}`").cast("long") for n, t in df.dtypes if t in ("int", "smallint", "tinyint")}
    fixed |= {n: joined(F.col(f"`{n}`")) for n, t in df.dtypes if t == "array<string>"}
    return df.withColumns(fixed) if fixed else df


def _report(df: DataFrame, places: int = 8) -> DataFrame:
    return _long_counts(_rounded(df, places))


def _annotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    net = pn.load(spark, sf_dir)
    return graph.annotated_edges(net.edges, graph.focals(net.vertices))


def _analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _once(
        spark, sf_dir, "analysis",
        lambda: ego_analysis.from_network(pn.load(spark, sf_dir), pn.BASELINE, pn.OUTCOME, pn.END_YEAR),
    )


def _multihot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model_suite.multihot_design(_analysis(spark, sf_dir), *DESIGN_ARGS)


def _exploded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model_suite.exploded_design(_analysis(spark, sf_dir), *DESIGN_ARGS)


# --- network -------------------------------------------------------------------------------


def bidirectional(spark, d):
    return graph.bidirectional(pn.load(spark, d).edges)


def cooccurrence_edges(spark, d):
    return pn.edges(spark, d)


def focals(spark, d):
    return _report(
        graph.focals(pn.load(spark, d).vertices).select(
            "id", "category", "first_pub_year", "pub_count", "subject_areas", "countries", "countries_wo_eu"
        )
    )


def degree(spark, d):
    net = pn.load(spark, d)
    return graph.degree(net.edges, graph.focals(net.vertices))


def degree_ranked(spark, d):
    net = pn.load(spark, d)
    degrees = graph.degree(net.edges, graph.focals(net.vertices))
    return resume.pending(degrees, None).orderBy(F.col("degree").asc(), F.col("id").asc())


def attribute_mix(spark, d):
    net = pn.load(spark, d)
    return _rounded(neighbourhood.attribute_mix(net.edges, graph.focals(net.vertices), net.vertices))


def homophily(spark, d):
    net = pn.load(spark, d)
    return _rounded(neighbourhood.homophily(net.edges, graph.focals(net.vertices), net.vertices))


def value_mix(spark, d):
    """Neighbours by every value that occurs, for a category, a year and an array of regions."""
    net = pn.load(spark, d)
    return _rounded(neighbourhood.value_mix(net.edges, graph.focals(net.vertices), net.vertices, OPEN_ATTRIBUTES))


def own_share(spark, d):
    net = pn.load(spark, d)
    return _rounded(neighbourhood.own_share(net.edges, graph.focals(net.vertices), net.vertices, OPEN_ATTRIBUTES))


def neighbor_means(spark, d):
    net = pn.load(spark, d)
    return neighbourhood.neighbour_means(net.edges, graph.focals(net.vertices), net.vertices, pn.END_YEAR)


def _reach(spark, d, mode):
    net = pn.load(spark, d)
    attributes = ["subject_areas", "countries", "countries_wo_eu"]
    return _rounded(neighbourhood.reach(net.edges, net.vertices, attributes, mode))


def reach_overlap(spark, d):
    return _reach(spark, d, "overlap")


def reach_exact(spark, d):
    return _reach(spark, d, "exact")


def window_totals(spark, d):
    """Compared and matching neighbours per vertex, by country; both ends need an entry."""
    net = pn.load(spark, d)
    mine, theirs = F.col("ego_countries"), F.col("alter_countries")
    return (
        neighbourhood.ego_ties(net.edges, net.vertices, net.vertices)
        .filter(has_entries(mine) & has_entries(theirs))
        .groupBy(F.col("ego").alias("id"))
        .agg(
            F.count("alter").alias("total_collabs"),
            F.count_if(share_a_value(mine, theirs)).alias("total_same_collabs"),
        )
    )


def exploded_attributes(spark, d):
    vertices = pn.load(spark, d).vertices
    parts = [
        features.exploded_attribute(vertices, c, "value").select("id", F.lit(c).alias("attribute"), "value")
        for c in ("subject_areas", "countries", "countries_wo_eu")
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def second_order_degree(spark, d):
    annotated = staged(_annotated(spark, d), "annotated")
    return _rounded(second_order.second_order_degree(annotated))


def second_order_paths(spark, d):
    net = pn.load(spark, d)
    return graph.second_order_paths(net.edges, graph.focals(net.vertices))


def two_paths(spark, d):
    net = pn.load(spark, d)
    return _rounded(graph.two_paths(net.edges, graph.focals(net.vertices)))


def neighbor_sets(spark, d):
    net = pn.load(spark, d)
    return graph.neighbour_sets(net.edges, graph.focals(net.vertices))


def neighbor_pairs(spark, d):
    net = pn.load(spark, d)
    return graph.neighbour_pairs(net.edges, graph.focals(net.vertices))


def open_pairs(spark, d):
    annotated = staged(_annotated(spark, d), "annotated")
    return triads.open_pairs(annotated, graph.focals(pn.load(spark, d).vertices))


def brokerage(spark, d):
    annotated = staged(_annotated(spark, d), "annotated")
    return triads.brokerage(annotated, graph.focals(pn.load(spark, d).vertices))


def constraint(spark, d):
    return triads.constraint(staged(_annotated(spark, d), "annotated"))


def triad_measures(spark, d):
    annotated = staged(_annotated(spark, d), "annotated")
    return triads.triad_measures(annotated, graph.focals(pn.load(spark, d).vertices))


def ego_subgraph(spark, d):
    net = pn.load(spark, d)
    return graph.ego_subgraph(net.edges, graph.focals(net.vertices))


def focal_stats(spark, d):
    net = pn.load(spark, d)
    return _rounded(ego_analysis.focal_stats(net.edges, net.vertices, net.yearly, pn.END_YEAR))


# --- sinks and batches ---------------------------------------------------------------------


def sink_roundtrip(spark, d):
    """Overwrite twice; the second content stays."""
    path = fresh_path(spark, "sink")
    tables.write_table(focals(spark, d).select("id"), path)
    tables.write_table(degree(spark, d), path)
    return tables.read_table(spark, path)


def dedupe_by_key(spark, d):
    """Incidence rows appended to one output, then compacted to one row per part."""
    path = fresh_path(spark, "dedupe")
    rows = pn.incidence(spark, d)
    early = F.col("year") <= pn.END_YEAR
    for part in (early, ~early):
        tables.append_table(rows.filter(part), path)
    tables.compact(spark, path, ["id"], ["context"])
    return _long_counts(tables.read_table(spark, path))


def batch_assign(spark, d):
    egos = graph.focals(pn.load(spark, d).vertices).select("id")
    return _long_counts(batching.assign_batches(egos, "id", BROKERAGE_BATCHES))


def append_resume(spark, d):
    """A constraint run that stops after some batches, runs one of them twice, and is resumed."""
    net = pn.load(spark, d)
    path = fresh_path(spark, "constraint")
    egos = graph.focals(net.vertices)
    ties = resume.ties_by_vertex(net.edges, egos)
    plan = resume.plan_batches(resume.pending(graph.degree(net.edges, egos), None), 4)
    resume.run_batches(ties, plan, path, range(2))
    resume.run_batches(ties, plan, path, [1])
    resume.run_batches(ties, plan, path, resume.unfinished(plan, tables.read_table(spark, path)))
    return tables.read_table(spark, path).drop("batch")


def _last_year_added(spark, d):
    before, added = pn.edges_before_and_of(spark, d, pn.END_YEAR)
    return staged(before, "before"), staged(added, "added")


def brokerage_update(spark, d):
    """Brokerage of the years before the last from scratch, then the last year's edges as deltas; ``changed`` egos were written."""
    before, added = _last_year_added(spark, d)
    egos = graph.focals(pn.load(spark, d).vertices)
    path = fresh_path(spark, "brokerage-log")
    for step, (had, new) in enumerate(((before.limit(0), before), (before, added))):
        overwrite_part(updates.brokerage_deltas(had, new, egos).withColumn("step", F.lit(step)), path, "step")
    log = tables.read_table(spark, path)
    changed = log.filter("step = 1").select("id", F.lit(True).alias("changed"))
    return updates.brokerage_from(log, egos).join(changed, "id", "left").withColumn("changed", F.col("changed").isNotNull().cast("long"))


def constraint_update(spark, d):
    """Constraint of the years before the last, replaced for the egos that the last year's edges touch."""
    before, added = _last_year_added(spark, d)
    egos = graph.focals(pn.load(spark, d).vertices)
    earlier = triads.constraint(staged(graph.annotated_edges(before, egos), "annotated"))
    now = staged(updates.constraint_changes(before, added, egos), "constraint_changes")
    kept = earlier.join(now.select("id"), "id", "left_anti").withColumn("touched", F.lit(0).cast("long"))
    return kept.unionByName(now.withColumn("touched", F.lit(1).cast("long")))


def csv_roundtrip(spark, d):
    """A group summary through a CSV file."""
    path = fresh_path(spark, "summary-csv")
    summary = zero_share(spark, d)
    tables.write_summary_csv(summary, path)
    return tables.read_summary_csv(spark, path, summary.schema)


# --- cohorts and summaries -----------------------------------------------------------------


def cohort_filter(spark, d):
    return cohorts.cohort_filter(pn.load(spark, d).vertices, "female", "EUROPE", "S2").select("id", "category")


def cohort_stats(spark, d):
    measures = _once(spark, d, "brokerage", lambda: brokerage(spark, d))
    return _rounded(
        cohorts.cohort_stats(
            pn.load(spark, d).vertices, measures,
            ["open_triads_count", "open_triads_per_neighbor"],
            ["female", "male"], pn.REGIONS, pn.SUBJECTS,
        ),
        6,
    )


def year_features(spark, d):
    return _report(
        features.year_features(pn.load(spark, d).yearly, pn.BASELINE, pn.OUTCOME)
        .join(
            pn.load(spark, d).vertices.select(
                "id", features.years_since_first(pn.END_YEAR).alias("years_from_first_pub")
            ),
            "id",
        )
        .select("id", "outcome_output", "baseline_output", "avg_year_diff", "years_from_first_pub")
    )


def analysis_table(spark, d):
    return _report(
        ego_analysis.from_network(pn.load(spark, d), pn.BASELINE, pn.OUTCOME, pn.END_YEAR)
    )


def analysis_required(spark, d):
    """The analysis table of the egos that are also in a further measure table, reach by country without the region."""
    net = pn.load(spark, d)
    measured = neighbourhood.reach(net.edges, net.vertices, ["countries_wo_eu"], "exact")
    return _report(ego_analysis.from_network(net, pn.BASELINE, pn.OUTCOME, pn.END_YEAR, (measured,)))


def range_filter(spark, d):
    """The analysis table within bounds, with the number of rows that each bound removes."""
    table = _analysis(spark, d)
    removed = table.agg(
        F.count_if(F.col("degree") > MOST_DEGREE).alias("above_degree"),
        F.count_if(F.col("baseline_output") <= MORE_THAN).alias("below_output"),
    )
    kept = ego_analysis.within(table, MOST_DEGREE, MORE_THAN).select("id", "degree", "baseline_output")
    return kept.crossJoin(F.broadcast(removed))


def null_audit(spark, d):
    stats = _once(spark, d, "focal-stats", lambda: focal_stats(spark, d))
    return summaries.null_audit(stats, [c for c in stats.columns if c != "id"])


def multi_affiliation(spark, d):
    return summaries.multi_affiliation(
        _analysis(spark, d).select("id", "countries_focal", "subjects_focal"), "countries_focal", "subjects_focal"
    ).select("id", F.size("countries_focal").cast("long").alias("n_countries"), F.size("subjects_focal").cast("long").alias("n_subjects"))


def quadrant_share(spark, d):
    return _rounded(
        summaries.quadrant_share(_analysis(spark, d), "normalized_brokerage", "constraint", LOW_QUADRANT, HIGH_QUADRANT)
    )


def group_summary(spark, d):
    return _rounded(summaries.group_summary(_analysis(spark, d), "category", SUMMARY_COLUMNS), 6)


def group_median(spark, d):
    return _rounded(
        summaries.group_median(_analysis(spark, d), "category", ["normalized_brokerage", "brokerage", "constraint"]), 6
    )


def approx_median(spark, d):
    """Medians by category from stored sketches of smaller groups; ``within``: its true rank is within the bound."""
    columns = ["normalized_brokerage", "brokerage", "constraint"]
    table = _analysis(spark, d)
    sketches = staged(quantiles.quantile_sketches(table, ["category", "years_from_first_pub"], columns), "sketches")
    found = staged(quantiles.sketched_quantile(quantiles.merged_sketches(sketches, ["category"])), "sketched")
    value, error = F.col("value"), quantiles.rank_error()
    ranks = (
        quantiles.long_format(table, ["category"], columns)
        .alias("v")
        .join(found.alias("f"), F.col("v.category").eqNullSafe(F.col("f.category")) & (F.col("v.metric") == F.col("f.metric")))
        .groupBy("f.category", "f.metric", "n", "median")
        .agg(F.count_if(value < F.col("median")).alias("below"), F.count_if(value <= F.col("median")).alias("upto"))
    )
    within = (F.col("below") <= (0.5 + error) * F.col("n")) & (F.col("upto") >= (0.5 - error) * F.col("n"))
    return _rounded(ranks.select("category", "metric", "n", "median", within.cast("long").alias("within")), 6)


def zero_share(spark, d):
    return _rounded(
        summaries.zero_share(
            _analysis(spark, d), "category", "normalized_brokerage", ["normalized_brokerage", "brokerage", "constraint"]
        ),
        6,
    )


def describe_table(spark, d):
    stats = _once(spark, d, "focal-stats", lambda: focal_stats(spark, d))
    return _report(summaries.describe_table(stats, STATS_COLUMNS), 6)


def summary_transposed(spark, d):
    return _rounded(
        summaries.summary_transposed(_analysis(spark, d), "category", ["female", "male"], SUMMARY_COLUMNS), 6
    )


def design_moments(spark, d):
    return _rounded(summaries.moments(_multihot(spark, d), PREDICTORS + ["rate_outcome", "outcome_output"]), 6)


# --- model design and models ---------------------------------------------------------------


def cross_affiliation(spark, d):
    return features.cross_affiliation(
        _analysis(spark, d).select("id", "countries_focal", "subjects_focal"), "countries_focal", "subjects_focal"
    ).select("id", "country", "subject")


def design_multihot(spark, d):
    return _report(_multihot(spark, d).select("id", *[f"`{c}`" for c in PREDICTORS]))


def design_exploded(spark, d):
    return _report(_exploded(spark, d).select("id", "country", "subject", *[f"`{c}`" for c in PREDICTORS]))


def design_interactions(spark, d):
    pairs = [("women", k) for k in model_suite.KEY_PREDICTORS]
    products = features.interactions(_multihot(spark, d), pairs)
    return _report(
        products.select(
            "id", *[F.col(f"`{a}:{b}`").alias(f"{a}_x_{b}") for a, b in pairs],
            features.above_zero("normalized_brokerage").alias("any_brokerage"),
            features.equals_one("baseline_output").alias("single_output"),
        )
    )


def _coefficients(spark, fitted, places):
    table = count_models.coefficient_table(spark, fitted, None)
    irr = F.when(F.col("irr").isNotNull(), significant(F.col("irr"), 6))
    return _long_counts(_rounded(table, places, ["coefficient", "std_error", "z", "p_value"]).withColumn("irr", irr))


def nb_by_group(spark, d):
    """Outcome by category, with robust and with model-based standard errors."""
    fitted = count_models.fit(
        _multihot(spark, d), count_models.Model("by group", "outcome_output", ("women",))
    )
    parts = [
        _coefficients(spark, fitted.with_covariance(k), 6).withColumn("covariance", F.lit(k))
        for k in ("robust", "model")
    ]
    return parts[0].unionByName(parts[1])


def _degree_model(spark, d):
    return count_models.fit(
        _multihot(spark, d), count_models.Model("degree", "outcome_output", ("degree",))
    )


def nb_two_param(spark, d):
    return _coefficients(spark, _degree_model(spark, d), 6)


def nb_full(spark, d):
    """All key predictors with products, on the rows per unit, country and subject."""
    fitted = count_models.fit(_exploded(spark, d), model_suite.main_model("outcome_output", PLACES))
    return _coefficients(spark, fitted, 4)


def nb_full_sparse(spark, d):
    """The same model from sparse rows, with the countries and subjects that occur."""
    crossed = features.cross_affiliation(_analysis(spark, d), "countries_focal", "subjects_focal")
    rows, names = sparse_design.sparse_design(
        crossed.withColumn("women", features.women()),
        "outcome_output",
        [
            "women", *model_suite.KEY_PREDICTORS,
            sparse_design.Places("country", "country", pn.REFERENCE_REGION),
            sparse_design.Places("subject", "subject", pn.REFERENCE_SUBJECT),
            *model_suite.CONTROLS,
        ],
        "women",
        model_suite.KEY_PREDICTORS,
    )
    return _coefficients(spark, count_models.fit_sparse(rows, names), 4)


def nb_rate_full(spark, d):
    """The full model of the other outcome, a rate."""
    fitted = count_models.fit(_exploded(spark, d), model_suite.main_model("rate_outcome", PLACES))
    return _coefficients(spark, fitted, 4)


def nb_model_suite(spark, d):
    models = model_suite.nested_models("outcome_output", PLACES)
    fits = count_models.fit_models(_exploded(spark, d), models)
    names = [m.name for m in models]
    table = count_models.suite_table(spark, fits, names, None)

    def shown(name):
        value = F.col(f"`{name}`")
        irr = F.when(value.isNotNull(), significant(value, 6))
        return F.when(F.col("statistic") == "IRR", irr).otherwise(
            half_up(F.when(F.col("statistic") != "IRR", value), 4)
        )

    return _long_counts(table.withColumns({n: shown(n) for n in names}))


def nb_all_products(spark, d):
    """Constraint, homophily and degree with products of women with these and with every place."""
    model = model_suite.constraint_model("outcome_output", PLACES, "all")
    return _coefficients(spark, count_models.fit(_multihot(spark, d), model, covariance="model"), 4)


# --- predictions and plot data -------------------------------------------------------------


def _moments(spark, d):
    return predictions.wide_moments(_multihot(spark, d), PREDICTORS)


def grid_points(spark, d):
    low, high = predictions.moment("min", "degree"), predictions.moment("max", "degree")
    grids = {
        "arange": predictions.arange_points(0.0, 1.0, 0.1),
        "linspace": predictions.linspace_points(low, high, 100),
        "logspace": predictions.logspace_points(low, high, 100),
    }
    named = F.array(*[F.struct(F.lit(n).alias("grid"), p.alias("points")) for n, p in grids.items()])
    return _report(
        _moments(spark, d)
        .select(F.inline(named))
        .select("grid", F.posexplode("points").alias("point", "value")),
        6,
    )


def profile_grid(spark, d):
    grid = predictions.profile_grid(
        _moments(spark, d), PREDICTORS, "normalized_brokerage", predictions.arange_points(0.0, 1.0, 0.1)
    )
    return _report(grid, 6)


def profile_grid_exploded(spark, d):
    """The grid for models of exploded rows: means over the rows that were fitted."""
    moments = predictions.wide_moments(_exploded(spark, d), PREDICTORS)
    grid = predictions.profile_grid(moments, PREDICTORS, "normalized_brokerage", predictions.arange_points(0.0, 1.0, 0.1))
    return _report(grid, 6)


def profile_grid_held(spark, d):
    low, high = predictions.moment("min", "constraint"), predictions.moment("max", "constraint")
    parts = []
    for sign in (1, -1):
        held = predictions.moment("mean", "normalized_brokerage") + sign * predictions.moment("sd", "normalized_brokerage")
        grid = predictions.profile_grid(
            _moments(spark, d), PREDICTORS, "constraint", predictions.linspace_points(low, high, 100),
            {"normalized_brokerage": held},
        )
        parts.append(grid.withColumn("deviations", F.lit(sign)))
    return _report(parts[0].unionByName(parts[1]), 6)


def scenario_grid(spark, d):
    parts = [
        predictions.scenario_grid(
            _moments(spark, d), PREDICTORS, "normalized_brokerage", "constraint", steps
        ).withColumn("scenario_set", F.lit(name))
        for name, steps in (("corners", predictions.CORNERS), ("one_at_a_time", predictions.ONE_AT_A_TIME))
    ]
    return _report(parts[0].unionByName(parts[1]), 6)


def _degree_grid(spark, d):
    low, high = predictions.moment("min", "degree"), predictions.moment("max", "degree")
    return predictions.profile_grid(
        _moments(spark, d), ["women", "degree"], "degree", predictions.linspace_points(low, high, 100)
    )


def predict_grid(spark, d):
    fitted = _degree_model(spark, d)
    grid = predictions.predict(_degree_grid(spark, d), fitted, "predicted_log", "link")
    return _report(predictions.predict(grid, fitted, "predicted", "response"), 5)


def predict_interval(spark, d):
    fitted = _degree_model(spark, d)
    return _report(predictions.predict_interval(_degree_grid(spark, d), fitted), 5)


def marginal_effects(spark, d):
    return _report(predictions.marginal_effects(_degree_grid(spark, d), _degree_model(spark, d), "degree"), 5)


def nb_multihot_model_cov(spark, d):
    """Two models on one row per unit, with standard errors from the information alone."""
    models = [model_suite.constraint_model("outcome_output", PLACES, crossed) for crossed in ("none", "key")]
    fits = count_models.fit_models(_multihot(spark, d), models, covariance="model")
    parts = [_coefficients(spark, fits[m.name], 4).withColumn("model", F.lit(m.name)) for m in models]
    return parts[0].unionByName(parts[1])


def _full_multihot(spark, d):
    return count_models.fit(_multihot(spark, d), model_suite.main_model("outcome_output", PLACES))


def predict_profile(spark, d):
    """The full model along one predictor, the others at their means, with effects of that predictor.

    Products are formed anew from the values of the grid.
    """
    fitted = _full_multihot(spark, d)
    grid = predictions.profile_grid(
        _moments(spark, d), PREDICTORS, "normalized_brokerage", predictions.arange_points(0.0, 1.0, 0.1)
    )
    grid = predictions.predict(grid, fitted, "predicted_log", "link")
    grid = predictions.marginal_effects(grid, fitted, "normalized_brokerage")
    return _report(
        grid.select("women", "normalized_brokerage", "predicted_log", "expected_value", "marginal_effect", "marginal_effect_total"), 4
    )


def predict_interval_full(spark, d):
    """Intervals of the full model along one predictor: of 95 % on the link scale, and plus and minus ten standard errors."""
    fitted = _full_multihot(spark, d)
    grid = predictions.profile_grid(
        _moments(spark, d), PREDICTORS, "normalized_brokerage", predictions.arange_points(0.0, 1.0, 0.1)
    )
    shown = ["women", "normalized_brokerage", "predicted", "std_error", "lower_bound", "upper_bound"]
    parts = [
        predictions.predict_interval(grid, fitted, z, scale).select(F.lit(scale).alias("scale"), *shown)
        for z, scale in ((predictions.Z_95, "link"), (10.0, "response"))
    ]
    return _report(parts[0].unionByName(parts[1]), 4)


def scenario_predictions(spark, d):
    """The full model for combinations of two predictors."""
    grid = predictions.scenario_grid(
        _moments(spark, d), PREDICTORS, "normalized_brokerage", "constraint", predictions.CORNERS
    )
    return _report(predictions.predict(grid, _full_multihot(spark, d)).select("scenario", "women", "predicted"), 4)


def predict_interval_response(spark, d):
    """Prediction plus and minus ten standard errors."""
    return _report(predictions.predict_interval(_degree_grid(spark, d), _degree_model(spark, d), 10.0, "response"), 4)


def log_outcomes(spark, d):
    return _rounded(
        _analysis(spark, d).select(
            "id",
            F.log1p("rate_outcome").alias("log_rate"),
            F.log1p(F.col("outcome_output").cast("double")).alias("log_outcome"),
            F.log10(F.col("degree") + F.lit(1.0)).alias("log10_degree"),
        )
    )


def seeded_sample(spark, d):
    rows = _multihot(spark, d).select(
        "id", "women", "normalized_brokerage", F.log1p("rate_outcome").alias("log_rate")
    )
    return _report(densities.seeded_sample(rows, "id", SAMPLE_ROWS, SAMPLE_SEED))


def density_histogram(spark, d):
    rows = _multihot(spark, d)
    parts = [
        densities.density_histogram(rows, column, "women", *bins).withColumn("series", F.lit(column))
        for column, bins in (("rate_outcome", (0, 40, 2)), ("outcome_output", (0, 18, 1)))
    ]
    return _report(parts[0].unionByName(parts[1]))


def density_curve(spark, d):
    rows = _multihot(spark, d)
    parts = [
        densities.density_curve(rows, column, "women", log_scale).withColumn("series", F.lit(column))
        for column, log_scale in (("constraint", False), ("degree", True))
    ]
    return _report(parts[0].unionByName(parts[1]), 6)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        cooccurrence_edges, bidirectional, focals, degree, degree_ranked, attribute_mix, homophily, value_mix, own_share,
        neighbor_means, reach_overlap, reach_exact, window_totals, exploded_attributes,
        second_order_degree, second_order_paths, two_paths, neighbor_sets, neighbor_pairs, open_pairs,
        brokerage, constraint, triad_measures, ego_subgraph, focal_stats, sink_roundtrip,
        dedupe_by_key, batch_assign, append_resume, brokerage_update, constraint_update, csv_roundtrip, cohort_filter, cohort_stats,
        year_features, analysis_table, analysis_required, range_filter, null_audit, multi_affiliation, quadrant_share, group_summary,
        group_median, approx_median, zero_share, describe_table, summary_transposed, design_moments,
        cross_affiliation, design_multihot, design_exploded, design_interactions, nb_by_group,
        nb_two_param, nb_full, nb_full_sparse, nb_rate_full, nb_model_suite, nb_all_products, grid_points, profile_grid, profile_grid_exploded, profile_grid_held,
        scenario_grid, predict_grid, predict_interval, marginal_effects, log_outcomes,
        nb_multihot_model_cov, predict_profile, predict_interval_full, scenario_predictions, predict_interval_response,
        seeded_sample, density_histogram, density_curve,
    )
}
