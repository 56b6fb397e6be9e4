"""Exact medians of large groups, and quantile sketches to store and merge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tieloom.staging import staged

# A sketch of this accuracy errs by at most 1/accuracy of the rows; the bracket is ten times wider.
SKETCH_ACCURACY = 10_000
BRACKET = 0.001
# Bins that the bracket is cut into.
BINS = 4096
# Size of a stored sketch; groups of fewer values are kept whole.
SKETCH_K = 4_000


def long_format(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """One row per row and column: the keys, ``metric`` and ``value``."""
    pairs = [
        F.struct(F.lit(c).alias("metric"), F.col(f"`{c}`").cast("double").alias("value"))
        for c in columns
    ]
    return df.select(*keys, F.inline(F.array(*pairs)))


def exact_medians(
    df: DataFrame, keys: list[str], columns: list[str], also: dict[str, Column] | None = None
) -> DataFrame:
    """Median of each column per group: the keys, ``metric`` and ``median``; nulls and NaN are ignored.

    ``also`` names further aggregates of ``value``, which are taken in the first pass over the values.
    No pass brings a whole group into one task. A quantile sketch gives two values that enclose
    the median by its error bound. The range between them is cut into bins; counts per bin, rows
    below included, tell which bin or two hold the median, and only the distinct values of those
    are put in order.
    """
    values = long_format(df, keys, columns).filter(
        F.col("value").isNotNull() & ~F.isnan("value")
    )
    also = also or {}
    group = [*keys, "metric"]
    quantiles = F.percentile_approx(
        "value", [0.5 - BRACKET, 0.5 + BRACKET], SKETCH_ACCURACY
    )
    bracket = (
        values.groupBy(*group)
        .agg(quantiles.alias("q"), F.count("*").alias("n"), *[a.alias(f"also_{name}") for name, a in also.items()])
        .select(
            *[F.col(k).alias(f"b_{k}") for k in group], "n", F.col("q")[0].alias("lo"), F.col("q")[1].alias("hi"),
            *[f"also_{name}" for name in also],
        )
    )
    # Written down, its true size tells Spark whether it can be broadcast.
    bracket = staged(bracket, "bracket")
    same_group = [F.col(k).eqNullSafe(F.col(f"b_{k}")) for k in group]
    # where both ends of the bracket are one value, that is the median
    settled = bracket.filter("lo = hi")
    open_ends = bracket.filter("lo < hi").drop(*[f"also_{name}" for name in also])
    width = (F.col("hi") - F.col("lo")) / BINS
    place = F.when(F.col("value") < F.col("lo"), -1).when(width > 0, F.floor((F.col("value") - F.col("lo")) / width)).otherwise(0)
    binned = (
        values.join(open_ends, same_group)
        .filter(F.col("value") <= F.col("hi"))
        .withColumn("bin", place.cast("long"))
        .select(*group, "n", "bin", "value")
    )
    low_rank = F.floor((F.col("n") + 1) / 2)
    high_rank = F.floor((F.col("n") + 2) / 2)

    def at(rank, what):
        return F.min(F.when(F.col("upto") >= rank, F.col(what)))

    # at most BINS + 2 rows per group
    in_order = Window.partitionBy(*group).orderBy("bin")
    picked = (
        binned.groupBy(*group, "n", "bin")
        .agg(F.count("*").alias("rows"))
        .withColumn("upto", F.sum("rows").over(in_order))
        .withColumn("before", F.col("upto") - F.col("rows"))
        .groupBy(*group)
        .agg(at(low_rank, "bin").alias("low_bin"), at(high_rank, "bin").alias("high_bin"), at(low_rank, "before").alias("before"))
        .select(*[F.col(k).alias(f"b_{k}") for k in group], "low_bin", "high_bin", "before")
    )
    picked = staged(picked, "bins")
    by_value = Window.partitionBy(*group).orderBy("value")
    searched = (
        binned.join(picked, same_group)
        .filter(F.col("bin").isin(F.col("low_bin"), F.col("high_bin")))
        .groupBy(*group, "n", "before", "value")
        .agg(F.count("*").alias("rows"))
        .withColumn("upto", F.col("before") + F.sum("rows").over(by_value))
        .groupBy(*group)
        .agg(((at(low_rank, "value") + at(high_rank, "value")) / 2).alias("median"))
    )
    medians = settled.select(*[F.col(f"b_{k}").alias(k) for k in group], F.col("lo").alias("median")).unionByName(searched)
    if not also:
        return medians
    return medians.join(bracket, same_group).select(*group, *[F.col(f"also_{name}").alias(name) for name in also], "median")


def approximate_medians(
    df: DataFrame, keys: list[str], columns: list[str], accuracy: int = SKETCH_ACCURACY
) -> DataFrame:
    """As ``exact_medians``, in one pass, to within 1/accuracy of the rows."""
    return (
        long_format(df, keys, columns)
        .groupBy(*keys, "metric")
        .agg(F.percentile_approx("value", 0.5, accuracy).alias("median"))
        .filter("median IS NOT NULL")
    )


def quantile_sketches(df: DataFrame, keys: list[str], columns: list[str], k: int = SKETCH_K) -> DataFrame:
    """The keys, ``metric, n`` and a ``sketch`` of the values, for storing and merging; nulls are ignored."""
    return (
        long_format(df, keys, columns)
        .filter(F.col("value").isNotNull() & ~F.isnan("value"))
        .groupBy(*keys, "metric")
        .agg(F.count("*").alias("n"), F.kll_sketch_agg_double("value", F.lit(k)).alias("sketch"))
    )


def merged_sketches(sketches: DataFrame, keys: list[str], k: int = SKETCH_K) -> DataFrame:
    """Sketches of larger groups, by fewer keys, from those of smaller ones; values are not read again."""
    return sketches.groupBy(*keys, "metric").agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch", F.lit(k)).alias("sketch"))


def sketched_quantile(sketches: DataFrame, rank: float = 0.5, name: str = "median") -> DataFrame:
    """The least value that has a share ``rank`` of all values up to it, to within ``rank_error``."""
    return sketches.withColumn(name, F.kll_sketch_get_quantile_double("sketch", F.lit(rank))).drop("sketch")


def rank_error(k: int = SKETCH_K) -> float:
    """Share of the rows by which a sketched rank errs at most, with 99 % confidence."""
    return 2.296 / k**0.9723
