"""The network as DataFrames: edge views, degrees, ego subgraph, path counts.

An edge table has one row per tied pair: ``src < dst`` and a ``weight``. ``canonical_edges``
brings any edge list into this form; the other functions rely on it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tieloom.functions.numeric import ratio

#: What annotated edges say of their ends.
NOTES = ("degree", "strength", "is_ego")


def canonical_edges(edges: DataFrame) -> DataFrame:
    """One row per pair with ``src < dst``: self-ties dropped, both directions added up."""
    return (
        edges.filter(F.col("src") != F.col("dst"))
        .select(
            F.least("src", "dst").alias("src"),
            F.greatest("src", "dst").alias("dst"),
            "weight",
        )
        .groupBy("src", "dst")
        .agg(F.sum("weight").alias("weight"))
    )


def bidirectional(edges: DataFrame) -> DataFrame:
    """Each edge in both directions, from a single scan of the edge table."""
    there = F.struct(F.col("src"), F.col("dst"), F.col("weight"))
    back = F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("weight"))
    return edges.select(F.inline(F.array(there, back)))


def focals(vertices: DataFrame) -> DataFrame:
    """The vertices that measures are computed for."""
    return vertices.filter("is_focal")


def endpoints(edges: DataFrame) -> DataFrame:
    """Degree and summed tie weight of every vertex that has an edge."""
    return (
        edges.select(F.explode(F.array("src", "dst")).alias("id"), "weight")
        .groupBy("id")
        .agg(F.count("*").alias("degree"), F.sum("weight").alias("strength"))
    )


def degree(edges: DataFrame, egos: DataFrame) -> DataFrame:
    """Incident edges per ego; egos without an edge are absent."""
    return endpoints(edges).select("id", "degree").join(egos.select("id"), "id")


def annotated_edges(edges: DataFrame, egos: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Edges with degree, strength and ego flag of both ends, and the ``carry`` columns of egos.

    The two look-ups join the edges to a table with one row per vertex. A vertex that holds
    a large part of the edges makes one side of such a join skewed and leaves the other at
    one row, which adaptive execution splits.
    """
    nodes = endpoints(edges).join(
        egos.select("id", F.lit(True).alias("is_ego"), *carry), "id", "left"
    ).withColumn("is_ego", F.coalesce("is_ego", F.lit(False)))
    out = edges.select("src", "dst", "weight")
    for end in ("src", "dst"):
        side = nodes.select(
            F.col("id").alias(end),
            F.col("degree").alias(f"{end}_degree"),
            F.col("strength").alias(f"{end}_strength"),
            F.col("is_ego").alias(f"{end}_is_ego"),
            *[F.col(c).alias(f"{end}_{c}") for c in carry],
        )
        out = out.join(side, end)
    return out


def annotated_ties(
    annotated: DataFrame,
    src: tuple[str, ...] = (),
    dst: tuple[str, ...] = (),
    weight: bool = False,
    of_egos: bool = False,
) -> DataFrame:
    """``annotated_edges`` in both directions, with only the annotations asked for.

    ``src`` and ``dst`` name them: ``degree``, ``strength``, ``is_ego``. With ``of_egos`` only
    ties that start at an ego are kept, and edges without one are dropped at the scan.
    """

    def view(a: str, b: str):
        return F.struct(
            F.col(a).alias("src"),
            F.col(b).alias("dst"),
            *[F.col(f"{a}_{n}").alias(f"src_{n}") for n in src],
            *[F.col(f"{b}_{n}").alias(f"dst_{n}") for n in dst],
            *([F.col("weight")] if weight else []),
            *([F.col(f"{a}_is_ego").alias("from_ego")] if of_egos else []),
        )

    if of_egos:
        annotated = annotated.filter("src_is_ego OR dst_is_ego")
    ties = annotated.select(F.inline(F.array(view("src", "dst"), view("dst", "src"))))
    return ties.filter("from_ego").drop("from_ego") if of_egos else ties


def ego_edges(edges: DataFrame, egos: DataFrame) -> DataFrame:
    """Edges with an end among the egos or their neighbours.

    They hold every tie of each ego and of each of its neighbours. Two look-ups against the
    member list flag the edges, so they are neither duplicated nor made distinct again.
    """
    ids = egos.select("id").distinct()
    neighbours = (
        bidirectional(edges)
        .join(ids.withColumnRenamed("id", "src"), "src", "left_semi")
        .select(F.col("dst").alias("id"))
    )
    members = ids.unionByName(neighbours).distinct()
    flagged = edges.select("src", "dst", "weight")
    for end in ("src", "dst"):
        flagged = flagged.join(
            members.select(F.col("id").alias(end), F.lit(True).alias(f"{end}_in")), end, "left"
        )
    return flagged.filter("src_in OR dst_in").select("src", "dst", "weight")


def ego_subgraph(edges: DataFrame, egos: DataFrame) -> DataFrame:
    """``ego_edges`` in both directions."""
    return bidirectional(ego_edges(edges, egos))


def neighbour_sets(edges: DataFrame, egos: DataFrame) -> DataFrame:
    """Size of each ego's neighbour set, without collecting the set."""
    return (
        bidirectional(edges)
        .join(egos.select(F.col("id").alias("src")), "src", "left_semi")
        .groupBy(F.col("src").alias("id"))
        .agg(F.count("*").alias("n_neighbours"))
    )


def neighbour_pairs(edges: DataFrame, egos: DataFrame) -> DataFrame:
    """Number of unordered neighbour pairs per ego, from the degree alone."""
    n = F.col("degree")
    return degree(edges, egos).select("id", F.shiftright(n * (n - 1), 1).alias("pairs"))


def second_order_paths(edges: DataFrame, egos: DataFrame) -> DataFrame:
    """Number of paths ego - a - b with b other than the ego.

    Every neighbour a adds its degree less one, so no path is written out.
    """
    return (
        annotated_ties(annotated_edges(edges, egos), dst=("degree",), of_egos=True)
        .groupBy(F.col("src").alias("id"))
        .agg(F.sum(F.col("dst_degree") - 1).alias("paths"))
    )


def two_paths(edges: DataFrame, egos: DataFrame) -> DataFrame:
    """Indirect paths ego - q - alter with three different ends, and their summed strength.

    A path has strength ``p_iq * p_qj``, where ``p_xy`` is the share of x's tie weight that
    goes to y. Over all alters j other than i this adds up to ``p_iq * (1 - p_qi)``.
    """
    to_q = ratio(F.col("weight"), F.col("src_strength"))
    back = ratio(F.col("weight"), F.col("dst_strength"))
    return (
        annotated_ties(
            annotated_edges(edges, egos), ("strength",), ("degree", "strength"), weight=True, of_egos=True
        )
        .groupBy(F.col("src").alias("id"))
        .agg(
            F.sum(F.col("dst_degree") - 1).alias("paths"),
            F.sum(to_q * (1 - back)).alias("indirect_strength"),
        )
    )
