"""Global positions of rows in a sorted order, without a task that sees all rows of a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tieloom.sources.tables import rows_to_table
from tieloom.staging import staged

#: Signs of whitespace that separate words.
SPACE = r"\x20\x09-\x0D"


def placed(df: DataFrame, *order: Column | str, drop: tuple[str, ...] = (), name: str = "placed") -> DataFrame:
    """``df`` with ``at``: 0, 1, 2 ... in the given order, over all rows. ``drop`` names columns that only order.

    The rows are dealt into ranges, so a key of any size is cut into several, and written once with
    their number in their range; the driver adds up one count per range. Rows that are equal in
    all columns of the order should be equal altogether: which comes first is then no matter.
    """
    ranged = staged(
        df.repartitionByRange(*order).sortWithinPartitions(*order)
        .withColumns({"range_no": F.spark_partition_id(), "row_no": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
        .drop(*drop),
        name,
    )
    before, offsets = 0, []
    for range_no, rows in sorted(ranged.groupBy("range_no").count().collect()):
        offsets.append((range_no, before))
        before += rows
    shift = rows_to_table(df.sparkSession, offsets, "range_no int, before long")
    return ranged.join(F.broadcast(shift), "range_no").withColumn("at", F.col("row_no") + F.col("before")).drop("range_no", "row_no", "before")
