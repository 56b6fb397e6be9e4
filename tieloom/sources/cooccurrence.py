"""Edges from incidence rows: two units are tied once for each context they share."""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tieloom.functions.numeric import copies, every_piece, piece_of
from tieloom.staging import staged

CONTEXT_ROWS_PER_PIECE = 2_000
#: Pairs of a task, about.
PAIRS_PER_TASK = 500_000


def cooccurrence_edges(
    incidence: DataFrame,
    unit: str,
    context: str,
    rows_per_piece: int = CONTEXT_ROWS_PER_PIECE,
    pairs_per_task: int = PAIRS_PER_TASK,
) -> DataFrame:
    """Canonical weighted edges ``src < dst``; ``weight`` counts the shared contexts.

    ``incidence`` has one row per unit and context. A context with many units is split: its
    rows are spread over pieces by unit, and the other side of the join is repeated for each
    piece, so no task holds a large context on both sides. There are as many tasks as the number of
    pairs asks for: rows of a context are few bytes, by which adaptive execution would merge them.
    """
    rows = staged(incidence.select(F.col(unit).alias("unit"), F.col(context).alias("context")), "incidence")
    units = F.col("units")
    pairs = rows.groupBy("context").agg(F.count("*").alias("units")).agg(F.sum(F.shiftright(units * (units - 1), 1))).first()[0] or 0
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), ceil(pairs / pairs_per_task))
    dealt = rows.repartition(tasks, "context")
    sizes = dealt.groupBy("context").agg(F.count("*").alias("units")).filter("units > 1")
    sized = dealt.join(sizes.hint("merge"), "context").withColumn("pieces", copies(units, rows_per_piece))
    left = sized.select(
        "context", F.col("unit").alias("src"), piece_of(F.col("unit"), F.col("pieces")).alias("piece")
    )
    right = sized.select(
        "context", F.col("unit").alias("dst"), every_piece(F.col("pieces")).alias("piece")
    )
    return (
        left.repartition(tasks, "context", "piece")
        .join(right.repartition(tasks, "context", "piece").hint("merge"), ["context", "piece"])
        .filter(F.col("src") < F.col("dst"))
        .select("src", "dst")
        .repartition(tasks, "src", "dst")
        .groupBy("src", "dst")
        .agg(F.count("*").alias("weight"))
    )
