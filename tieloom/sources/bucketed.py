"""Tables laid out by a key: bucketed files, read without a shuffle and by bucket."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tieloom.staging import fresh_path

#: Longest list of keys that is written into a filter, for Spark to choose buckets by.
LISTED_KEYS = 1_000


def bucketed(df: DataFrame, key: str, name: str, buckets: int | None = None, dealt: bool = False) -> DataFrame:
    """Write ``df`` once, in buckets by ``key``, and return the written table.

    A bucket is one file, sorted by key. There are as many as shuffle partitions by default: a join by the key
    then moves the other side only. ``dealt``: the rows are already in tasks by ``key``, as many as buckets.
    """
    spark = df.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"{name}_{uuid.uuid4().hex[:12]}"
    (df if dealt else df.repartition(buckets, key)).write.bucketBy(buckets, key).sortBy(key).option("path", fresh_path(spark, name)).saveAsTable(table)
    return spark.table(table)


def rows_of(table: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """Rows of a ``bucketed`` table whose key is among ``ids`` (a written table with ``id`` and further columns, which
    are added).

    A short list of keys also becomes a filter, by which only their buckets are read.
    """
    listed = [r[0] for r in ids.select("id").limit(LISTED_KEYS + 1).collect()]
    if len(listed) <= LISTED_KEYS:
        table = table.where(F.col(key).isin(listed))
    return table.join(ids.withColumnRenamed("id", key), key)


def overwrite_part(df: DataFrame, path: str, part: str) -> None:
    """Replace those parts of the table at ``path``, partitioned by ``part``, that ``df`` has rows of."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(part).parquet(path)
