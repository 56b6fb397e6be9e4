"""Declared input schemas, and the check that a table read from disk follows them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

EDGES = T.StructType(
    [
        T.StructField("src", T.LongType()),
        T.StructField("dst", T.LongType()),
        T.StructField("weight", T.LongType()),
    ]
)

VERTICES = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("is_focal", T.BooleanType()),
        T.StructField("category", T.StringType()),
        T.StructField("first_pub_year", T.IntegerType()),
        T.StructField("pub_count", T.LongType()),
        T.StructField("subject_areas", T.ArrayType(T.StringType())),
        T.StructField("countries", T.ArrayType(T.StringType())),
        T.StructField("countries_wo_eu", T.ArrayType(T.StringType())),
        T.StructField("subjects_focal", T.ArrayType(T.StringType())),
        T.StructField("countries_focal", T.ArrayType(T.StringType())),
    ]
)

BROKERAGE = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("open_triads_count", T.LongType()),
        T.StructField("open_triads_per_neighbor", T.DoubleType()),
    ]
)

CONSTRAINT = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("overall_constraint", T.DoubleType()),
    ]
)


def yearly_counts(years) -> T.StructType:
    """Schema of the wide by-year count table: ``id`` and one count column per year."""
    return T.StructType(
        [T.StructField("id", T.LongType())]
        + [T.StructField(str(y), T.LongType()) for y in years]
    )


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Select the declared columns; fail on a missing column or another type."""
    found = {f.name: f.dataType.simpleString() for f in df.schema}
    wrong = [
        f"{f.name}: expected {f.dataType.simpleString()}, found {found.get(f.name, 'nothing')}"
        for f in schema
        if found.get(f.name) != f.dataType.simpleString()
    ]
    if wrong:
        raise ValueError("table does not follow its schema: " + "; ".join(wrong))
    return df.select(*[f"`{f.name}`" for f in schema])
