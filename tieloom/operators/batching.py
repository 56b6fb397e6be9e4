"""A global row index without a global sort task, and equal batches from it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tieloom.sources.tables import rows_to_table
from tieloom.staging import staged


def _indexed(df: DataFrame, key: str) -> tuple[DataFrame, int]:
    spark = df.sparkSession
    ranged = staged(
        df.repartitionByRange(key).withColumn("range_no", F.spark_partition_id()), "ranges"
    )
    # One row per range, so the driver holds as many numbers as there are partitions.
    counts = sorted(ranged.groupBy("range_no").count().collect())
    offsets, before = [], 0
    for range_no, rows in counts:
        offsets.append((range_no, before))
        before += rows
    shift = rows_to_table(spark, offsets, "range_no int, before long")
    rank = F.row_number().over(Window.partitionBy("range_no").orderBy(key)) - 1
    indexed = (
        ranged.withColumn("index", rank.cast("long"))
        .join(F.broadcast(shift), "range_no")
        .withColumn("index", F.col("index") + F.col("before"))
        .drop("range_no", "before")
    )
    return indexed, before


def global_index(df: DataFrame, key: str) -> DataFrame:
    """Adds ``index``: the 0-based rank of the row by ``key``, which must be unique.

    The rows are range-partitioned by key and written once, so that the ranges cannot move
    between the count and the numbering. Each range is numbered on its own and shifted by
    the rows in the ranges before it.
    """
    return _indexed(df, key)[0]


def assign_batches(df: DataFrame, key: str, batches: int) -> DataFrame:
    """Adds ``index`` and ``batch``: ``batches`` runs of equal size in key order.

    The last batch takes the remainder, and everything if there are fewer rows than batches.
    """
    indexed, rows = _indexed(df, key)
    size = rows // batches
    last = F.lit(batches - 1).cast("long")
    batch = F.least(F.floor(F.col("index") / F.lit(size)), last) if size else last
    return indexed.withColumn("batch", batch.cast("int"))
