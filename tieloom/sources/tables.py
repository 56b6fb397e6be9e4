"""Parquet and CSV sources and sinks."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tieloom.schemas import conform


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Parquet scan; with a schema, only its columns are read and their types are checked."""
    df = spark.read.parquet(path)
    return conform(df, schema) if schema is not None else df


def write_table(df: DataFrame, path: str) -> None:
    """Replace the table at ``path``. ``df`` must not read from ``path``; see ``compact``."""
    df.write.mode("overwrite").parquet(path)


def append_table(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def dedupe_by_key(df: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """One row per key: the smallest by ``order``, then by all other columns.

    ``min`` of a struct combines map-side, so a key that holds most of the rows costs one
    row per task, and the survivor does not depend on the partitioning.
    """
    rest = [c for c in df.columns if c not in keys]
    first = [c for c in (order or []) if c in rest]
    ranked = first + [c for c in rest if c not in first]
    if not ranked:
        return df.distinct()
    best = F.min(F.struct(*[F.col(f"`{c}`") for c in ranked])).alias("best")
    return (
        df.groupBy(*keys)
        .agg(best)
        .select(*keys, *[F.col("best").getField(c).alias(c) for c in ranked])
        .select(*[f"`{c}`" for c in df.columns])
    )


def compact(spark: SparkSession, path: str, keys: list[str], order: list[str] | None = None) -> None:
    """Rewrite an appended output with one row per key.

    The result is written beside the output, as ``<path>.compacted``, and takes its place by two
    renames, by way of ``<path>.replaced``. A job that dies between them leaves both; the next call takes the
    complete copy up first, together with what was appended in the meantime.
    """
    here = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    output, kept, old = (here(f"{path.rstrip('/')}{end}") for end in ("", ".compacted", ".replaced"))
    files = output.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def move(source, target) -> None:
        if not files.rename(source, target):
            raise OSError(f"cannot move {source} to {target}")

    if files.exists(kept) and (files.exists(old) or not files.exists(output)):
        if files.exists(output):
            append_table(spark.read.parquet(kept.toString()), path)
            files.delete(kept, True)
        else:
            move(kept, output)
    elif files.exists(old) and not files.exists(output):
        move(old, output)
    files.delete(kept, True)
    files.delete(old, True)
    dedupe_by_key(spark.read.parquet(path), keys, order).write.parquet(kept.toString())
    move(output, old)
    move(kept, output)
    files.delete(old, True)


def write_summary_csv(df: DataFrame, path: str) -> None:
    """One CSV file with a header, for tables of summary size; only their rows meet in one task."""
    df.repartition(1).write.mode("overwrite").option("header", True).csv(path)


def read_summary_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def rows_to_table(spark: SparkSession, rows: list, schema: T.StructType | str) -> DataFrame:
    """A few driver-side rows, such as model coefficients, as a table.

    They go through Arrow, so that reading the table needs no Python worker.
    """
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    arrow = to_arrow_schema(schema)
    columns = list(zip(*rows)) or [()] * len(arrow)
    arrays = [pa.array(list(values), field.type) for values, field in zip(columns, arrow)]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, schema=arrow), schema)
