"""A co-occurrence network of parts, derived from order lines.

Parts are tied when they occur in the same order, and the tie weight is the number of shared
orders of the baseline window. The other columns play the roles that the operators expect.
"""

from __future__ import annotations

from functools import cached_property
from math import ceil

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tieloom.functions.arrays import one_or_two
from tieloom.schemas import EDGES, VERTICES, conform
from tieloom.sources.cooccurrence import cooccurrence_edges
from tieloom.staging import staged

BASELINE = [1995, 1996, 1997]
OUTCOME = [1998, 1999, 2000]
END_YEAR = 1997
AFTER_BASELINE = f"{END_YEAR + 1}-01-01"
LINES_PER_TASK = 500_000

# Categories of the part attributes.
FEMALE_TYPES = ["ECONOMY", "STANDARD"]
MALE_TYPES = ["PROMO", "LARGE"]
UNKNOWN_TYPES = ["SMALL"]
SUBJECT_WORDS = {
    "S1": ["anvil", "bolt", "blue", "cold"],
    "S2": ["gear", "gizmo", "hot", "large"],
    "S3": ["plate", "ring", "new", "old"],
    "S4": ["rod", "widget", "red", "small"],
}
SUBJECTS = ["S1", "S2", "S3", "S4"]
REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
REFERENCE_SUBJECT = "S1"
REFERENCE_REGION = "AMERICA"


class Network:
    """Edges, vertices, output per year, and mean line quantity in the outcome window, each written when it is first read.

    All come from ``incidence``, so order lines are joined to their orders once.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._from = spark, sf_dir

    @cached_property
    def incidence(self) -> DataFrame:
        return staged(counted_incidence(*self._from), "incidence", keep=True)

    @cached_property
    def edges(self) -> DataFrame:
        rows = self.incidence.filter(F.col("year") <= END_YEAR).select("id", "context")
        return conform(staged(cooccurrence_edges(rows, "id", "context"), "edges", keep=True), EDGES)

    @cached_property
    def vertices(self) -> DataFrame:
        return conform(staged(vertices(*self._from, self.incidence), "vertices", keep=True), VERTICES)

    @cached_property
    def yearly(self) -> DataFrame:
        return staged(yearly(self.incidence), "yearly", keep=True)

    @cached_property
    def rate(self) -> DataFrame:
        return staged(rate(self.incidence), "rate", keep=True)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str, before: str | None = None) -> DataFrame:
    """Order lines with the year of their order: ``id, context, year, quantity``.

    ``before`` is a date that orders must precede; it reaches the scan. Rows stay dealt by order, over as many tasks
    as their number asks for: they compress so well that tasks merged by bytes would hold many of them.
    """
    orders = _table(spark, sf_dir, "orders")
    if before is not None:
        orders = orders.filter(F.col("o_orderdate") < F.lit(before).cast(orders.schema["o_orderdate"].dataType))
    orders = orders.select(
        F.col("o_orderkey").alias("context"), F.year("o_orderdate").alias("year")
    )
    items = _table(spark, sf_dir, "lineitem")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), ceil(items.count() / LINES_PER_TASK))
    items = items.select(F.col("l_partkey").alias("id"), F.col("l_orderkey").alias("context"), F.col("l_quantity").alias("quantity"))
    return items.repartition(tasks, "context").join(orders.repartition(tasks, "context").hint("merge"), "context")


def incidence(spark: SparkSession, sf_dir: str, before: str | None = None) -> DataFrame:
    """One row per part and order."""
    return lines(spark, sf_dir, before).select("id", "context", "year").distinct()


def counted_incidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per part and order, with the number of its lines and their quantity."""
    return (
        lines(spark, sf_dir)
        .groupBy("context", "id", "year")
        .agg(F.count("quantity").alias("lines"), F.sum("quantity").alias("quantity"))
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cooccurrence_edges(incidence(spark, sf_dir, AFTER_BASELINE), "id", "context")


def edges_before_and_of(spark: SparkSession, sf_dir: str, year: int) -> tuple[DataFrame, DataFrame]:
    """Edges of the orders of earlier years, and those that the orders of ``year`` add."""
    rows = staged(incidence(spark, sf_dir, f"{year + 1}-01-01"), "incidence")
    return tuple(cooccurrence_edges(rows.filter(part), "id", "context") for part in (F.col("year") < year, F.col("year") == year))


def yearly(incidence: DataFrame) -> DataFrame:
    """Orders per part and year, null where there are none."""
    return (
        incidence.groupBy("id")
        .agg(*[F.sum(F.when(F.col("year") == y, F.lit(1))).alias(str(y)) for y in BASELINE + OUTCOME])
    )


def rate(incidence: DataFrame) -> DataFrame:
    return (
        incidence.filter(F.col("year").isin(OUTCOME))
        .groupBy("id")
        .agg(F.try_divide(F.sum("quantity"), F.sum("lines")).alias("rate_outcome"))
    )


def vertices(spark: SparkSession, sf_dir: str, incidence: DataFrame) -> DataFrame:
    nation_region = _table(spark, sf_dir, "nation").join(
        _table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )

    def region_of(key: str, name: str) -> DataFrame:
        return nation_region.select(F.col("n_nationkey").alias(key), F.col("r_name").alias(name))

    def subject_of(word) -> F.Column:
        group = F.lit(None).cast("string")
        for name, words in SUBJECT_WORDS.items():
            group = F.when(word.isin(words), name).otherwise(group)
        return group

    words = F.split("p_name", " ")
    size = F.col("p_size")
    countries = F.when(size == 50, F.array().cast("array<string>")).when(
        size != 49, one_or_two(F.col("first_region"), F.col("second_region"))
    )
    published = (
        incidence.filter(F.col("year") <= END_YEAR)
        .groupBy(F.col("id").alias("p_partkey"))
        .agg(F.count("*").alias("pub_count"))
    )
    return (
        _table(spark, sf_dir, "part")
        .withColumns({"first_nation": (F.col("p_partkey") % 25).cast("int"), "second_nation": size % 25})
        .join(region_of("first_nation", "first_region"), "first_nation")
        .join(region_of("second_nation", "second_region"), "second_nation")
        .join(published, "p_partkey", "left")
        .withColumns(
            {"subject_areas": one_or_two(subject_of(words[0]), subject_of(words[1])), "countries": countries}
        )
        .select(
            F.col("p_partkey").alias("id"),
            (size <= 5).alias("is_focal"),
            F.when(F.col("p_type").isin(FEMALE_TYPES), "female")
            .when(F.col("p_type").isin(MALE_TYPES), "male")
            .when(F.col("p_type").isin(UNKNOWN_TYPES), "unknown")
            .alias("category"),
            F.when(F.col("p_partkey") % 13 != 0, 1940 + size + F.col("p_partkey") % 7)
            .cast("int")
            .alias("first_pub_year"),
            F.coalesce("pub_count", F.lit(0)).cast("long").alias("pub_count"),
            "subject_areas",
            "countries",
            F.filter("countries", lambda c: c != "EUROPE").alias("countries_wo_eu"),
            F.col("subject_areas").alias("subjects_focal"),
            F.col("countries").alias("countries_focal"),
        )
    )


_written: dict[tuple[str, str], Network] = {}


def load(spark: SparkSession, sf_dir: str) -> Network:
    """The network of ``sf_dir``, whose tables are written once per application and read from there."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _written:
        _written[key] = Network(spark, sf_dir)
    return _written[key]
