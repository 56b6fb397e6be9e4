"""Mixing of sources to target weights, with DataFrame functions only.

Sizes per source give the targets. Each document gets a hash-random key; the key range of a
source is cut into slices of about equal row number, so a source that holds a third of all rows
is many slices. Sums per slice, summed up along the source, give each slice's offset; a running
sum inside the slice gives each document's place. The source's budget is cut at that place,
whole epochs first.

Null texts have size 0, a null source is a source of its own and the last, repeated rows are
separate documents, an empty table gives an empty result. Sources of size 0 have target 0. Keys
depend on seed and id only, so reruns agree; equal ids are ordered by size. A null id takes part
like any other.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tieloom.llm.tables import small
from tieloom.llm.words import word_count
from tieloom.staging import staged

#: Weights dealt to the sources in code point order, repeating.
WEIGHTS = (3, 1, 2)
#: All targets together, as a multiple of all sizes, and one source's most, as a multiple of its size.
SHARE, MOST = 1.5, 2.0


def _source_key(source: Column) -> Column:
    """A join key without nulls."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """One row per source: ``source_key, source_rows, source_size, target``.

    Shares go by weight; a share above ``most`` times the size stops there and the excess is
    shared again. In order of size over weight the stopped sources come first, so sums along
    that order give the level at which the rest is shared.
    """
    per_source = sizes.groupBy("source_key").agg(
        F.min("source").alias("source"), F.count("*").alias("source_rows"), F.sum("size").alias("source_size")
    )
    place = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    weight = reduce(lambda rest, w: F.when(place % len(weights) == w[0], w[1]).otherwise(rest), enumerate(weights), F.lit(0))
    by_room = Window.orderBy("room", "source_key")
    every = Window.partitionBy()
    return (
        per_source.withColumn("weight", weight.cast("double"))
        .withColumn("most", F.lit(most) * F.col("source_size"))
        .withColumn("room", F.col("most") / F.col("weight"))
        .withColumn("budget", F.lit(share) * F.sum("source_size").over(every))
        .withColumn("stopped", F.coalesce(F.sum("most").over(by_room.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("weight_left", F.sum("weight").over(by_room.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (F.col("budget") - F.col("stopped")) / F.col("weight_left"))
        .withColumn("shared", F.min(F.when(F.col("level") < F.col("room"), F.struct("room", "level"))).over(every)["level"])
        .select(
            "source_key", "source_rows", "source_size",
            F.least("most", F.coalesce(F.col("shared") * F.col("weight"), F.col("most"))).alias("target"),
        )
    )


def mix_sizes(sizes: DataFrame, seed: str = "mix", slice_rows: int = 1024, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``sizes`` (``doc_id, source, size``) with ``source_size, target, taken``.

    ``sizes`` should be a written table: it is read three times. ``slice_rows`` is the least
    number of rows of a slice; it grows as the root of the rows, so that slices and the number of
    slices grow alike.
    """
    sizes = sizes.withColumn("source_key", _source_key(F.col("source")))
    targets = small(staged(source_targets(sizes, weights, share, most), "targets"))
    slice_size = max(slice_rows, math.isqrt(sizes.count()))
    key = F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    keyed = (
        sizes.join(targets, "source_key")
        .withColumn("key", key)
        .withColumn("slices", F.ceil(F.col("source_rows") / slice_size))
        .withColumn("slice", F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * F.col("slices") / F.lit(1 << 32)))
    )
    along = Window.partitionBy("source_key").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        keyed.groupBy("source_key", "slice").agg(F.sum("size").alias("slice_size"))
        .select("source_key", "slice", F.coalesce(F.sum("slice_size").over(along), F.lit(0)).alias("offset"))
    )
    inside = Window.partitionBy("source_key", "slice").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    budget = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    return (
        keyed.withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .join(offsets, ["source_key", "slice"])
        .withColumn("budget", budget)
        .withColumn("epochs", epochs)
        .withColumn("rest", F.col("budget") - F.col("epochs") * F.col("source_size") - F.col("before") - F.col("offset"))
        .withColumn("taken", F.col("epochs") * F.col("size") + F.greatest(F.lit(0), F.least("size", "rest")))
        .drop("source_key", "slice", "slices", "source_rows", "key", "before", "offset", "budget", "epochs", "rest")
    )


def mix(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", **options) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, source, size, source_size, target, taken``.

    ``taken`` is the number of words that the mix takes of the document, repeats counted: whole
    epochs, and of the document at the cut only the words up to it. Texts are read once; sizes
    are staged.
    """
    sizes = staged(
        docs.select(
            F.col(f"`{id_column}`").alias("doc_id"), F.col(f"`{source_column}`").alias("source"), word_count(F.col(f"`{text_column}`")).alias("size")
        ),
        "sizes",
    )
    return mix_sizes(sizes, **options)
