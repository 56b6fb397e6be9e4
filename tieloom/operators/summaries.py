"""Group summaries, describe tables, shares and audits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tieloom.functions.numeric import ratio
from tieloom.operators.quantiles import approximate_medians, exact_medians

STATISTICS = {"mean": F.avg, "min": F.min, "max": F.max, "stddev": F.stddev}


def null_audit(df: DataFrame, columns: list[str]) -> DataFrame:
    """Missing values per column, in one pass."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return counts.select(
        F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("missing")) for c in columns]))
    )


def missing_rows(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column).isNull())


def column_stats(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """One row per group and column with mean, min, max and standard deviation."""
    stats = df.groupBy(*keys).agg(
        *[f(F.col(f"`{c}`").cast("double")).alias(f"{s}__{c}") for c in columns for s, f in STATISTICS.items()]
    )
    rows = [
        F.struct(F.lit(c).alias("metric"), *[F.col(f"`{s}__{c}`").alias(s) for s in STATISTICS])
        for c in columns
    ]
    return stats.select(*keys, F.inline(F.array(*rows)))


def group_summary(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """One row per group; columns ``<column>_<statistic>``. A missing group value is a group."""
    return df.groupBy(key).agg(
        *[f(F.col(c).cast("double")).alias(f"{c}_{s}") for s, f in STATISTICS.items() for c in columns]
    )


def group_median(df: DataFrame, key: str, columns: list[str], approximate: bool = False) -> DataFrame:
    """One row per group and column with the median."""
    medians = approximate_medians if approximate else exact_medians
    return medians(df, [key], columns)


def zero_share(df: DataFrame, key: str, zero_column: str, mean_columns: list[str]) -> DataFrame:
    """Group means, and the percentage of rows where a column is exactly zero."""
    is_zero = F.when(F.col(zero_column) == 0, 1).otherwise(0)
    return df.groupBy(key).agg(
        *[F.avg(c).alias(f"avg_{c}") for c in mean_columns],
        (F.avg(is_zero) * 100).alias(f"pct_zero_{zero_column}"),
    )


def describe_table(df: DataFrame, columns: list[str], approximate: bool = False) -> DataFrame:
    """Rows mean, median, stddev, min, max in this order; one column per input column."""
    medians = approximate_medians if approximate else exact_medians
    order = ["mean", "median", "stddev", "min", "max"]
    long = column_stats(df, [], columns).join(medians(df, [], columns), "metric", "left")
    by_statistic = long.select(
        "metric",
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(i).alias("position"), F.lit(s).alias("statistic"), F.col(s).alias("value"))
                    for i, s in enumerate(order)
                ]
            )
        ),
    )
    return by_statistic.groupBy("position", "statistic").pivot("metric", columns).agg(F.first("value"))


def summary_transposed(df: DataFrame, key: str, groups: list[str], columns: list[str]) -> DataFrame:
    """One row per column and statistic, median included; one column per group."""
    stats = column_stats(df.filter(F.col(key).isin(groups)), [key], columns)
    medians = exact_medians(df.filter(F.col(key).isin(groups)), [key], columns)
    names = [*STATISTICS, "median"]
    return (
        stats.join(medians, [key, "metric"], "left")
        .select(
            key,
            F.inline(
                F.array(
                    *[
                        F.struct(F.concat_ws("_", F.col("metric"), F.lit(s)).alias("metric"), F.col(s).alias("value"))
                        for s in names
                    ]
                )
            ),
        )
        .groupBy("metric")
        .pivot(key, groups)
        .agg(F.first("value"))
    )


def quadrant_share(df: DataFrame, x: str, y: str, low: tuple[float, float], high: tuple[float, float]) -> DataFrame:
    """Share of rows at or below both low bounds, and at or above both high bounds."""
    both_low = (F.col(x) <= low[0]) & (F.col(y) <= low[1])
    both_high = (F.col(x) >= high[0]) & (F.col(y) >= high[1])
    n = F.count("*")
    return df.agg(
        ratio(F.count_if(both_low), n).alias("low_low"),
        ratio(F.count_if(both_high), n).alias("high_high"),
    )


def moments(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per column: mean, min, max and standard deviation over its own non-null values."""
    return column_stats(df, [], columns)


def multi_affiliation(df: DataFrame, *columns: str) -> DataFrame:
    """Rows where an array has more than one entry."""
    several = F.lit(False)
    for c in columns:
        several = several | F.coalesce(F.size(c) > 1, F.lit(False))
    return df.filter(several)
