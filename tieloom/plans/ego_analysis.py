"""One row per focal vertex: all network measures, then the analysis table for the models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tieloom.operators.features import year_features, years_since_first
from tieloom.operators.graph import annotated_edges, focals
from tieloom.operators.neighbourhood import neighbourhood_measures
from tieloom.operators.second_order import second_order_degree
from tieloom.operators.triads import triad_measures
from tieloom.staging import lookup, staged


def focal_stats(
    edges: DataFrame,
    vertices: DataFrame,
    yearly: DataFrame,
    end_year: int,
    international: str = "exact",
    annotated: DataFrame | None = None,
) -> DataFrame:
    """Degree, neighbour mix, homophily, neighbour means, second-order degree, reach, counts.

    One row per focal vertex with an edge. ``annotated`` can pass in edges that are already
    annotated and written.
    """
    egos = focals(vertices)
    if annotated is None:
        annotated = staged(annotated_edges(edges, egos), "annotated")
    first_order = neighbourhood_measures(edges, egos, vertices, end_year, international)
    second_order = second_order_degree(annotated)
    return (
        first_order.join(second_order, "id", "left")
        .join(lookup(yearly), "id", "left")
        .select(
            "id",
            "degree",
            "pct_male_first_order",
            "pct_female_first_order",
            "category",
            "pct_homophilic_collabs",
            "mean_collab_tenure",
            "mean_collab_pub_count",
            "second_order_collab_mean_degree",
            "interdisciplinary_reach",
            "international_reach_with_eu",
            "international_reach_no_eu",
            *[f"`{c}`" for c in yearly.columns if c != "id"],
        )
    )


def analysis_table(
    stats: DataFrame,
    vertices: DataFrame,
    triads: DataFrame,
    normalized_homophily: DataFrame,
    rate: DataFrame,
    baseline: list[int],
    outcome: list[int],
    end_year: int,
    required: tuple[DataFrame, ...] = (),
) -> DataFrame:
    """Model input: all focal vertices with all measures. ``within`` bounds it.

    ``triads`` has brokerage and constraint, ``required`` lists further measure tables whose
    ids an ego must be in. All inputs have one row per ``id``, and all joins are on it.
    """
    who = focals(vertices).select("id", "first_pub_year", "subjects_focal", "countries_focal")
    table = (
        year_features(stats, baseline, outcome)
        .join(normalized_homophily.select("id", "normalized_homophily"), "id")
        .join(lookup(rate.select("id", "rate_outcome")), "id")
        .join(lookup(who), "id")
        .join(triads.filter(F.col("overall_constraint").isNotNull()), "id")
    )
    for other in required:
        table = table.join(other.select("id").hint("merge"), "id", "left_semi")  # may have a row per vertex
    return table.select(
        "id",
        "degree",
        "category",
        years_since_first(end_year).alias("years_from_first_pub"),
        "interdisciplinary_reach",
        "rate_outcome",
        "baseline_output",
        "outcome_output",
        F.col("open_triads_count").alias("brokerage"),
        F.col("open_triads_per_neighbor").alias("normalized_brokerage"),
        F.col("overall_constraint").alias("constraint"),
        F.col("pct_homophilic_collabs").alias("homophily"),
        "normalized_homophily",
        "avg_year_diff",
        "countries_focal",
        "subjects_focal",
    )


def within(table: DataFrame, max_degree: int | None = None, more_than: int | None = None) -> DataFrame:
    """Rows of the analysis table up to a degree and above a baseline output, where given."""
    if max_degree is not None:
        table = table.filter(F.col("degree") <= max_degree)
    if more_than is not None:
        table = table.filter(F.col("baseline_output") > more_than)
    return table


def from_network(
    network, baseline: list[int], outcome: list[int], end_year: int, required: tuple[DataFrame, ...] = ()
) -> DataFrame:
    """The analysis table of a network, from its edges, for the egos that are in all of ``required``.

    The normalized homophily of the input tables is not computed here; homophily itself
    stands in for it.
    """
    egos = focals(network.vertices)
    annotated = staged(annotated_edges(network.edges, egos), "annotated")
    stats = focal_stats(
        network.edges, network.vertices, network.yearly, end_year, annotated=annotated
    )
    stand_in = stats.select("id", F.col("pct_homophilic_collabs").alias("normalized_homophily"))
    return analysis_table(
        stats,
        network.vertices,
        triad_measures(annotated, egos),
        stand_in,
        network.rate,
        baseline,
        outcome,
        end_year,
        required,
    )
