"""Measures over an ego's direct neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tieloom.functions.arrays import has_entries, same_array, share_a_value
from tieloom.functions.numeric import half_up, ratio
from tieloom.operators.graph import bidirectional
from tieloom.staging import lookup, staged

# The categories that count towards the neighbour total.
CATEGORIES = ["male", "female", "unknown"]

ATTRIBUTES = ["category", "first_pub_year", "pub_count", "subject_areas", "countries", "countries_wo_eu"]


def ego_ties(edges: DataFrame, egos: DataFrame, vertices: DataFrame) -> DataFrame:
    """Ties of the egos with the attributes of both ends, ``ego_*`` and ``alter_*``.

    ``alter_known`` tells whether the neighbour is in the vertex table.
    """
    ego = egos.select(
        F.col("id").alias("ego"), *[F.col(c).alias(f"ego_{c}") for c in ATTRIBUTES]
    )
    alter = vertices.select(
        F.col("id").alias("alter"),
        F.lit(True).alias("alter_known"),
        *[F.col(c).alias(f"alter_{c}") for c in ATTRIBUTES],
    )
    return (
        bidirectional(edges)
        .select(F.col("src").alias("ego"), F.col("dst").alias("alter"))
        .join(lookup(ego), "ego")
        .join(lookup(alter), "alter", "left")
    )


def _reach_counts(column: str, match, name: str) -> list[Column]:
    mine, theirs = F.col(f"ego_{column}"), F.col(f"alter_{column}")
    comparable = has_entries(mine) & has_entries(theirs)
    return [
        F.count_if(comparable).alias(f"{name}_compared"),
        F.count_if(comparable & match(mine, theirs)).alias(f"{name}_same"),
    ]


def _reach(name: str) -> Column:
    return (F.lit(1) - ratio(F.col(f"{name}_same"), F.col(f"{name}_compared"))).alias(name)


def neighbourhood_measures(
    edges: DataFrame,
    egos: DataFrame,
    vertices: DataFrame,
    end_year: int,
    international: str = "exact",
) -> DataFrame:
    """All first-order measures of the egos from one aggregation over their ties.

    ``international="exact"`` compares whole country arrays, ``"overlap"`` asks for a common
    country. Subjects are always compared by overlap. Columns that a caller does not select
    are pruned, down to the vertex scan.
    """
    match = {"exact": same_array, "overlap": share_a_value}[international]
    known = F.coalesce("alter_known", F.lit(False))
    counted = (
        ego_ties(edges, egos, vertices)
        .groupBy(F.col("ego").alias("id"))
        .agg(
            F.count("*").alias("degree"),
            F.first("ego_category").alias("category"),
            *[F.count_if(known & (F.col("alter_category") == g)).alias(f"n_{g}") for g in CATEGORIES],
            F.count_if(known & F.col("alter_category").isNull()).alias("n_missing"),
            F.avg(F.lit(end_year) - F.col("alter_first_pub_year")).alias("mean_tenure"),
            F.avg("alter_pub_count").alias("mean_pubs"),
            *_reach_counts("subject_areas", share_a_value, "interdisciplinary_reach"),
            *_reach_counts("countries", match, "international_reach_with_eu"),
            *_reach_counts("countries_wo_eu", match, "international_reach_no_eu"),
        )
        .withColumn(
            "total_collabs",
            F.col("n_male") + F.col("n_female") + F.col("n_unknown") + F.col("n_missing"),
        )
    )
    total = F.col("total_collabs")
    own = F.when(F.col("category") == "male", F.col("n_male")).when(
        F.col("category") == "female", F.col("n_female")
    )
    return counted.select(
        "id",
        "degree",
        "category",
        "n_male",
        "n_female",
        "n_unknown",
        "n_missing",
        "total_collabs",
        (half_up(ratio(F.col("n_male"), total), 3) * 100).alias("pct_male_first_order"),
        (half_up(ratio(F.col("n_female"), total), 3) * 100).alias("pct_female_first_order"),
        ratio(own, total).alias("pct_homophilic_collabs"),
        half_up(F.col("mean_tenure"), 2).alias("mean_collab_tenure"),
        half_up(F.col("mean_pubs"), 2).alias("mean_collab_pub_count"),
        _reach("interdisciplinary_reach"),
        _reach("international_reach_with_eu"),
        _reach("international_reach_no_eu"),
    )


def attribute_mix(edges: DataFrame, egos: DataFrame, vertices: DataFrame) -> DataFrame:
    """Neighbour counts by category, and the shares of men and women in percent."""
    return (
        neighbourhood_measures(edges, egos, vertices, 0)
        .filter("total_collabs > 0")
        .select(
            "id", "n_male", "n_female", "n_unknown", "n_missing", "total_collabs",
            "pct_male_first_order", "pct_female_first_order",
        )
    )


def homophily(edges: DataFrame, egos: DataFrame, vertices: DataFrame) -> DataFrame:
    """Share of neighbours with the ego's category; null unless that is male or female."""
    return (
        neighbourhood_measures(edges, egos, vertices, 0)
        .filter("total_collabs > 0")
        .select("id", "category", "pct_homophilic_collabs")
    )


def neighbour_means(
    edges: DataFrame, egos: DataFrame, vertices: DataFrame, end_year: int
) -> DataFrame:
    """Mean tenure and mean output of the neighbours, to 2 decimals."""
    return (
        neighbourhood_measures(edges, egos, vertices, end_year)
        .filter("total_collabs > 0")
        .select("id", "mean_collab_tenure", "mean_collab_pub_count")
    )


def reach(edges: DataFrame, vertices: DataFrame, columns: list[str], mode: str = "overlap") -> DataFrame:
    """Share of neighbours that differ in an array attribute, for every vertex with edges.

    One row per vertex and attribute, all attributes from one aggregation. Only neighbours
    count where both ends have an entry.
    """
    match = {"exact": same_array, "overlap": share_a_value}[mode]
    counted = (
        ego_ties(edges, vertices, vertices)
        .groupBy(F.col("ego").alias("id"))
        .agg(*[count for c in columns for count in _reach_counts(c, match, c)])
    )
    rows = [F.struct(F.lit(c).alias("attribute"), _reach(c).alias("reach")) for c in columns]
    return counted.select("id", F.inline(F.array(*rows))).filter("reach IS NOT NULL")


def _values(df: DataFrame, column: str) -> Column:
    """The values of a scalar or array column as an array of text, without nulls and repeats; null counts as empty."""
    one = F.col(f"`{column}`")
    if df.schema[column].dataType.typeName() != "array":
        one = F.array(one)
    return F.array_distinct(F.array_compact(F.coalesce(one, F.array().cast("array<string>")).cast("array<string>")))


def value_mix(edges: DataFrame, egos: DataFrame, vertices: DataFrame, columns: list[str]) -> DataFrame:
    """Neighbours by value of any attributes: ``id, attribute, value, n, share``.

    No list of values is given or looked up. A neighbour with several values counts at each of them, one
    without any at the null value; the share is of all neighbours in the vertex table. Counts combine before
    they are shuffled by ego, attribute and value, so neither an ego's neighbours nor its values meet in a task.
    """
    def entries_of(column: str) -> Column:
        values = _values(vertices, column)
        listed = F.when(F.size(values) > 0, values).otherwise(F.array(F.lit(None).cast("string")))
        return F.transform(listed, lambda v: F.struct(F.lit(column).alias("attribute"), v.alias("value")))

    everyone = F.array(F.struct(F.lit(None).cast("string").alias("attribute"), F.lit(None).cast("string").alias("value")))
    alter = vertices.select(F.col("id").alias("dst"), F.concat(everyone, *map(entries_of, columns)).alias("entries"))
    counts = staged(
        bidirectional(edges)
        .join(egos.select(F.col("id").alias("src")), "src", "left_semi")
        .join(lookup(alter), "dst")
        .select(F.col("src").alias("id"), F.inline("entries"))
        .groupBy("id", "attribute", "value")
        .agg(F.count("*").alias("n")),
        "value_counts",
    )
    totals = counts.filter("attribute IS NULL").select("id", F.col("n").alias("total"))
    return (
        counts.filter("attribute IS NOT NULL")
        .join(totals, "id")
        .select("id", "attribute", "value", "n", ratio(F.col("n"), F.col("total")).alias("share"))
    )


def own_share(edges: DataFrame, egos: DataFrame, vertices: DataFrame, columns: list[str]) -> DataFrame:
    """Homophily in any attributes: ``id, attribute, n_neighbours, n_same, share``.

    A neighbour is the same if it has a value of the ego's. Egos without a value of an attribute have a null
    count and share there. Neighbours outside of the vertex table do not count.
    """
    mine = egos.select(F.col("id").alias("src"), *[_values(egos, c).alias(f"ego_{c}") for c in columns])
    theirs = vertices.select(F.col("id").alias("dst"), *[_values(vertices, c).alias(f"alter_{c}") for c in columns])
    counted = (
        bidirectional(edges)
        .join(lookup(mine), "src")
        .join(lookup(theirs), "dst")
        .groupBy(F.col("src").alias("id"))
        .agg(
            F.count("*").alias("n_neighbours"),
            *[
                F.sum(F.when(F.size(f"ego_{c}") > 0, F.arrays_overlap(f"ego_{c}", f"alter_{c}").cast("long"))).alias(f"same_{c}")
                for c in columns
            ],
        )
    )
    rows = [F.struct(F.lit(c).alias("attribute"), F.col(f"same_{c}").alias("n_same")) for c in columns]
    return counted.select("id", "n_neighbours", F.inline(F.array(*rows))).withColumn(
        "share", ratio(F.col("n_same"), F.col("n_neighbours"))
    )
