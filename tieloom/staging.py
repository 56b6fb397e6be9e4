"""Written tables that cut lineage.

A table that several jobs read, or whose content must not change when a lost executor makes
Spark run a stage again, is written once to the shared folder in ``spark.checkpoint.dir`` and
read back. Reading it back as Parquet keeps column pruning and pushdown, which a plain
``checkpoint()`` would lose.
"""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def staging_root(spark: SparkSession) -> str:
    """Shared folder for staged tables, one subfolder per application.

    It lies in ``spark.checkpoint.dir``, or in the session's warehouse where that is unset.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{shared.rstrip('/')}/tieloom-{spark.sparkContext.applicationId}"


_blocks: list[list[str]] = []


@contextlib.contextmanager
def staging(spark: SparkSession) -> Iterator[None]:
    """Removes the tables staged within the block when it ends, however it ends.

    Results that read them must have been written or collected by then. Tables staged with
    ``keep`` stay.
    """
    _blocks.append([])
    try:
        yield
    finally:
        for path in _blocks.pop():
            table = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            table.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(table, True)


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{staging_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def staged(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write ``df`` once and return the written table."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    if _blocks and not keep:
        _blocks[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Tables of more rows than this are not sent to all tasks, however few bytes their files have.
LOOKUP_ROWS = 200_000


def lookup(df: DataFrame) -> DataFrame:
    """``df``, from a written table, to be joined by its key: by shuffle if it has many rows.

    Parquet files and shuffled blocks are compressed, so their bytes, by which Spark decides what to broadcast, say little of the
    memory that the rows take on the driver.
    """
    return df.hint("merge") if df.limit(LOOKUP_ROWS + 1).count() > LOOKUP_ROWS else df
