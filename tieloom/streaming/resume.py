"""Resumable measure runs in batches, for when one job over all egos is too large.

The ties are laid out by vertex once. A batch reads those of its egos and of their neighbours, without a shuffle
of the whole network, and replaces its own part of the output. So a batch that is run twice leaves the
same table, and a run that stopped is taken up by running the batches that are not whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tieloom.operators.batching import assign_batches
from tieloom.operators.graph import NOTES, annotated_edges
from tieloom.operators.triads import constraint
from tieloom.sources.bucketed import bucketed, overwrite_part, rows_of
from tieloom.staging import staged


def pending(degrees: DataFrame, done: DataFrame | None, max_degree: int | None = None) -> DataFrame:
    """Egos with edges that have no output yet, optionally only up to a degree."""
    todo = degrees.filter("degree > 0")
    if max_degree is not None:
        todo = todo.filter(F.col("degree") <= max_degree)
    if done is not None:
        todo = todo.join(done.select("id"), "id", "left_anti")
    return todo


def plan_batches(todo: DataFrame, batches: int) -> DataFrame:
    """``id, batch`` of the egos to do, written once; a resumed run must use the same plan."""
    return staged(assign_batches(todo.select("id"), "id", batches).select("id", "batch"), "batches")


def unfinished(plan: DataFrame, done: DataFrame | None) -> list[int]:
    """Batches with an ego that has no output yet."""
    left = plan if done is None else plan.join(done.select("id"), "id", "left_anti")
    return sorted(r["batch"] for r in left.select("batch").distinct().collect())


def ties_by_vertex(edges: DataFrame, egos: DataFrame, buckets: int | None = None) -> DataFrame:
    """Annotated ties in both directions, bucketed by ``src``."""
    ends = [[f"{a}{n} AS {b}{n}" for a, b in pair for n in ("", *(f"_{n}" for n in NOTES))] for pair in ((("src", "src"), ("dst", "dst")), (("dst", "src"), ("src", "dst")))]
    annotated = staged(annotated_edges(edges, egos), "annotated")
    return bucketed(annotated.selectExpr("weight", *ends[0]).unionByName(annotated.selectExpr("weight", *ends[1])), "src", "ties", buckets)


def batch_edges(ties: DataFrame, egos: DataFrame) -> DataFrame:
    """Annotated edges among ``egos`` and their neighbours, with only these ``egos`` marked as such.

    They hold all ties of each ego and all triads that it is in.
    """
    own = rows_of(ties, "src", egos.select("id"))
    members = own.select(F.col("dst").alias("id"), F.lit(False).alias("is_ego")).unionByName(egos.select("id", F.lit(True).alias("is_ego")))
    members = staged(members.groupBy("id").agg(F.max("is_ego").alias("is_ego")), "members")
    inside = rows_of(ties.where("src < dst").drop("src_is_ego", "dst_is_ego"), "src", members.withColumnRenamed("is_ego", "src_is_ego"))
    return inside.join(members.select(F.col("id").alias("dst"), F.col("is_ego").alias("dst_is_ego")), "dst")


def run_batches(
    ties: DataFrame,
    plan: DataFrame,
    path: str,
    only: Iterable[int] | None = None,
    measure: Callable[[DataFrame], DataFrame] = constraint,
) -> None:
    """Compute ``measure`` batch by batch, each from the edges around its egos, and write each to its part of ``path``.

    ``ties`` comes from ``ties_by_vertex``, ``plan`` from ``plan_batches``.
    """
    for number in only if only is not None else unfinished(plan, None):
        egos = staged(plan.where(F.col("batch") == number).select("id"), "egos")
        edges = staged(batch_edges(ties, egos), "batch_edges")
        overwrite_part(measure(edges).withColumn("batch", F.lit(number)), path, "batch")
