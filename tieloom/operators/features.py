"""Features of the analysis table and of the model design."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tieloom.functions.numeric import ratio, total_of, weighted_total


def year_features(counts: DataFrame, baseline: list[int], outcome: list[int]) -> DataFrame:
    """Output in both windows, and how late in the baseline window it was made on average.

    ``avg_year_diff`` is the output-weighted mean year less the first year; null without output.
    """
    base = total_of([str(y) for y in baseline])
    weighted = weighted_total([(str(y), y) for y in baseline])
    return counts.withColumns(
        {
            "outcome_output": total_of([str(y) for y in outcome]).cast("long"),
            "baseline_output": base.cast("long"),
            "avg_year_diff": ratio(weighted, base) - F.lit(baseline[0]),
        }
    )


def years_since_first(end_year: int, column: str = "first_pub_year") -> Column:
    """Years from the first publication to ``end_year``; null stays null."""
    return (F.lit(end_year) - F.col(column)).cast("int")


def women(column: str = "category") -> Column:
    """1 for female, 0 for every other value and for null."""
    return F.when(F.col(column) == "female", 1).otherwise(0).cast("int")


def above_zero(column: str) -> Column:
    return F.when(F.col(column) > 0, 1).otherwise(0).cast("int")


def equals_one(column: str) -> Column:
    return F.when(F.col(column) == 1, 1).otherwise(0).cast("int")


def exploded_attribute(df: DataFrame, column: str, name: str) -> DataFrame:
    """One row per array element; null and empty arrays give none."""
    return df.withColumn(name, F.explode(column))


def cross_affiliation(df: DataFrame, countries: str, subjects: str) -> DataFrame:
    """One row per country and subject of a unit, which therefore appears several times."""
    pairs = F.flatten(
        F.transform(
            countries,
            lambda c: F.transform(subjects, lambda s: F.struct(c.alias("country"), s.alias("subject"))),
        )
    )
    return df.select("*", F.explode(pairs).alias("pair")).select(
        *[f"`{c}`" for c in df.columns], "pair.country", "pair.subject"
    )


def one_hot(df: DataFrame, column: str, values: list[str], prefix: str, reference: str) -> DataFrame:
    """A 0/1 column per value except the reference."""
    return df.withColumns(
        {
            f"{prefix}_{v}": F.when(F.col(column) == v, 1).otherwise(0).cast("int")
            for v in values
            if v != reference
        }
    )


def multi_hot(df: DataFrame, column: str, values: list[str], prefix: str, reference: str) -> DataFrame:
    """A 0/1 column per value except the reference, from an array; several can be 1."""
    return df.withColumns(
        {
            f"{prefix}_{v}": F.array_contains(column, v).cast("int")
            for v in values
            if v != reference
        }
    )


def interactions(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Product columns named ``a:b``."""
    return df.withColumns({f"{a}:{b}": F.col(f"`{a}`") * F.col(f"`{b}`") for a, b in pairs})
