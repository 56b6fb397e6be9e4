"""Cohorts: egos of one category, country and subject."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tieloom.operators.quantiles import exact_medians


def cohort_filter(vertices: DataFrame, category: str, country: str, subject: str) -> DataFrame:
    """Focal vertices of one cohort; a vertex with several entries is in several cohorts."""
    return vertices.filter(
        F.col("is_focal")
        & (F.col("category") == category)
        & F.array_contains("countries", country)
        & F.array_contains("subject_areas", subject)
    )


def cohort_stats(
    vertices: DataFrame,
    measures: DataFrame,
    columns: list[str],
    categories: list[str],
    countries: list[str],
    subjects: list[str],
) -> DataFrame:
    """Mean, median, extremes and deviation of measures for all cohorts in one job.

    An ego's measures do not depend on the cohort, so each ego is repeated for its countries
    and subjects. The pass that looks for the medians also takes the other statistics. One row per
    cohort and measure; null and NaN values are left out of all of them.
    """
    placed = (
        vertices.filter(F.col("is_focal") & F.col("category").isin(categories))
        .select("id", "category", F.explode(F.array_distinct("countries")).alias("country"), "subject_areas")
        .filter(F.col("country").isin(countries))
        .select("id", "category", "country", F.explode(F.array_distinct("subject_areas")).alias("subject"))
        .filter(F.col("subject").isin(subjects))
        .join(measures.select("id", *columns), "id")
    )
    keys = ["category", "country", "subject"]
    statistics = {"mean": F.avg("value"), "max": F.max("value"), "min": F.min("value"), "std_dev": F.stddev("value")}
    return exact_medians(placed, keys, columns, statistics)
