"""Open and closed triads of egos: brokerage, normalized brokerage, structural constraint.

All measures come from the closed triads only, which ``triangles`` finds; pairs and paths are never
written out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tieloom.functions.numeric import half_up, ratio
from tieloom.operators.graph import annotated_ties
from tieloom.operators.triangles import EDGES_PER_CELL, closed_pairs, indirect_shares


def brokerage_columns(n: Column, closed: Column) -> list[Column]:
    """Open triads and their share from the number of ties and of closed pairs; 0 without a pair."""
    pairs = F.shiftright(n * (n - 1), 1)
    open_pairs = pairs - closed
    return [
        F.coalesce(open_pairs, F.lit(0)).cast("long").alias("open_triads_count"),
        F.coalesce(half_up(ratio(open_pairs, pairs), 2), F.lit(0.0)).alias("open_triads_per_neighbor"),
    ]


def brokerage(annotated: DataFrame, egos: DataFrame, edges_per_cell: int = EDGES_PER_CELL) -> DataFrame:
    """Open triads per ego and their share of all neighbour pairs; 0 for egos without a pair."""
    sizes = (
        annotated_ties(annotated, of_egos=True)
        .groupBy(F.col("src").alias("id"))
        .agg(F.count("*").alias("n"))
    )
    return (
        egos.select("id")
        .join(sizes, "id", "left")
        .join(closed_pairs(annotated, edges_per_cell), "id", "left")
        .select("id", *brokerage_columns(F.col("n"), F.coalesce("closed_pairs", F.lit(0))))
    )


def open_pairs(annotated: DataFrame, egos: DataFrame) -> DataFrame:
    """Egos with at least one untied pair of neighbours, and how many they have."""
    return (
        brokerage(annotated, egos)
        .filter("open_triads_count > 0")
        .select("id", F.col("open_triads_count").alias("open_pairs"))
    )


def _contacts(annotated: DataFrame, edges_per_cell: int) -> DataFrame:
    """Per ego and neighbour: direct plus indirect share of tie strength, and closed triads."""
    direct = (
        annotated_ties(annotated, ("strength",), weight=True, of_egos=True)
        .select(
            F.col("src").alias("ego"),
            F.col("dst").alias("alter"),
            ratio(F.col("weight"), F.col("src_strength")).alias("share"),
            F.lit(0).cast("long").alias("triads"),
        )
    )

    indirect = indirect_shares(annotated, edges_per_cell)
    return (
        direct.unionByName(indirect)
        .groupBy("ego", "alter")
        .agg(F.sum("share").alias("share"), F.sum("triads").alias("triads"))
    )


def constraint(annotated: DataFrame, edges_per_cell: int = EDGES_PER_CELL) -> DataFrame:
    """Aggregate structural constraint per ego, to 4 decimals; egos without edges are absent."""
    return (
        _contacts(annotated, edges_per_cell)
        .groupBy(F.col("ego").alias("id"))
        .agg(F.sum(F.col("share") * F.col("share")).alias("raw"))
        .select("id", half_up(F.col("raw"), 4).alias("overall_constraint"))
    )


def triad_measures(annotated: DataFrame, egos: DataFrame, edges_per_cell: int = EDGES_PER_CELL) -> DataFrame:
    """Brokerage and constraint from one search for the closed triads.

    Each triad of an ego counts once for either neighbour, hence twice per ego.
    """
    per_ego = (
        _contacts(annotated, edges_per_cell)
        .groupBy(F.col("ego").alias("id"))
        .agg(
            F.count("*").alias("n"),
            F.shiftright(F.sum("triads"), 1).alias("closed"),
            half_up(F.sum(F.col("share") * F.col("share")), 4).alias("overall_constraint"),
        )
    )
    return (
        egos.select("id")
        .join(per_ego, "id", "left")
        .select("id", *brokerage_columns(F.col("n"), F.col("closed")), "overall_constraint")
    )
