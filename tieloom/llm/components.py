"""Connected components of an edge table by alternating stars, all in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tieloom.staging import staged


def _stars(edges: DataFrame, larger_only: bool) -> DataFrame:
    """Ties each vertex' neighbours to the least vertex of its neighbourhood."""
    if larger_only:  # every vertex sees all its neighbours and re-ties the larger ones
        ties = edges.select(F.inline(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))))
    else:  # every vertex sees the smaller ones
        ties = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    least = ties.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    tied = ties.join(least, "u")
    if larger_only:
        out = tied.where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = tied.select(F.inline(F.array(F.struct(F.col("v").alias("a"), F.col("m").alias("b")), F.struct(F.col("u").alias("a"), F.col("m").alias("b")))))
    return out.where(F.col("a") != F.col("b"))


def _are_stars(edges: DataFrame) -> bool:
    """Whether every vertex is a centre or has one edge, to a smaller centre."""
    ends = edges.select(
        F.inline(F.array(F.struct(F.col("a").alias("v"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("b").alias("v"), F.lit(0).alias("up"), F.lit(1).alias("down"))))
    )
    return ends.groupBy("v").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR up + down > 1").isEmpty()


def components(edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """``doc, comp``: each vertex of ``edges`` (``a, b``) with the least vertex it can reach; least vertices of
    several are left out.

    Loops are ignored. Edges point from larger to smaller vertices; they are written each round, and the work
    ends when they are stars. The number of rounds grows with the logarithm of the vertices.
    """
    edges = staged(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where(F.col("a") != F.col("b")).distinct(), "edges"
    )
    for _ in range(most_rounds):
        if _are_stars(edges):
            return edges.select(F.col("a").alias("doc"), F.col("b").alias("comp"))
        edges = staged(_stars(_stars(edges, True), False).distinct(), "edges")
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
