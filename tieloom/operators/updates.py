"""Measures after edges were added, from what the new edges touch.

Brokerage is kept as sums: ties and closed pairs of neighbours per ego. Added edges change them by signed
amounts, which are written to a log by step; the sums over the log are the state, and a step that
is run twice replaces its own part. A triangle with a new edge has an end of that edge in all three of its sides, so
the triangles among the edges around these ends are counted with and without the new ties, and what both counts
share cancels out. Constraint is no such sum. It changes for egos at an end of an added edge and for
neighbours of such an end, and is computed anew for them alone.

``before`` and ``added`` are canonical edges, read from written tables, as several jobs use them. A pair in both was tied before: its
weight grows, which moves constraint but no triad. Egos without a change have no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tieloom.operators.graph import annotated_edges, bidirectional, canonical_edges, ego_edges
from tieloom.operators.triads import brokerage_columns, constraint
from tieloom.operators.triangles import closed_pairs
from tieloom.staging import staged


def _ends(edges: DataFrame) -> DataFrame:
    return staged(edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct(), "ends")


def _around(edges: DataFrame, ends: DataFrame) -> DataFrame:
    """Edges with an end among ``ends``, whose true size tells Spark how to join."""
    flagged = edges
    for end in ("src", "dst"):
        flagged = flagged.join(ends.select(F.col("id").alias(end), F.lit(True).alias(f"{end}_in")), end, "left")
    return flagged.filter("src_in OR dst_in").select("src", "dst", "weight")


def brokerage_deltas(before: DataFrame, added: DataFrame, egos: DataFrame) -> DataFrame:
    """``id, ties, closed``: by how much the added edges change the ties and the closed pairs of egos.

    Negated, they are the change by which edges go: ``before`` is then what stays, ``added`` what goes.
    """
    fresh = staged(added.select("src", "dst", "weight").join(before.select("src", "dst"), ["src", "dst"], "left_anti"), "fresh")
    old = staged(_around(before, _ends(fresh)), "around")
    closed = [
        closed_pairs(staged(annotated_edges(edges, egos), "annotated")).select("id", F.lit(0).cast("long").alias("ties"), (sign * F.col("closed_pairs")).alias("closed"))
        for edges, sign in ((old.unionByName(fresh), 1), (old, -1))
    ]
    ties = (
        bidirectional(fresh)
        .select(F.col("src").alias("id"))
        .join(egos.select("id"), "id", "left_semi")
        .select("id", F.lit(1).cast("long").alias("ties"), F.lit(0).cast("long").alias("closed"))
    )
    return (
        ties.unionByName(closed[0])
        .unionByName(closed[1])
        .groupBy("id")
        .agg(F.sum("ties").alias("ties"), F.sum("closed").alias("closed"))
        .filter("ties <> 0 OR closed <> 0")
    )


def brokerage_from(deltas: DataFrame, egos: DataFrame) -> DataFrame:
    """``triads.brokerage`` from the sums of all deltas."""
    state = deltas.groupBy("id").agg(F.sum("ties").alias("ties"), F.sum("closed").alias("closed"))
    return egos.select("id").join(state, "id", "left").select("id", *brokerage_columns(F.col("ties"), F.col("closed")))


def touched_egos(after: DataFrame, added: DataFrame, egos: DataFrame) -> DataFrame:
    """Egos at an end of an added edge or tied to one in ``after``."""
    near = _around(after, _ends(added)).select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    return egos.select("id").join(near, "id", "left_semi")


def constraint_changes(before: DataFrame, added: DataFrame, egos: DataFrame) -> DataFrame:
    """``triads.constraint`` with the added edges, of the touched egos only."""
    after = staged(canonical_edges(before.select("src", "dst", "weight").unionByName(added.select("src", "dst", "weight"))), "after")
    touched = staged(touched_egos(after, added, egos), "touched")
    edges = staged(ego_edges(after, touched), "ego_edges")
    return constraint(staged(annotated_edges(edges, touched), "annotated"))
