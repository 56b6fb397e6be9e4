"""Plot data as tables: histograms, density curves and reproducible samples."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tieloom.functions.numeric import ratio
from tieloom.staging import staged

# The evaluation grid reaches this many bandwidths beyond the data.
GRID_CUT = 3
GRID_POINTS = 200
# Distinct values that meet the grid at a time, and groups whose sums a task holds before it gives them out.
VALUES_AT_A_TIME = 4_096
GROUPS_AT_A_TIME = 10_000


def density_histogram(df: DataFrame, column: str, group: str, start: float, stop: float, width: float) -> DataFrame:
    """Density per bin and group; bins are half-open, the last one includes its end.

    Rows below ``start`` and above ``stop`` are counted in bins -1 and ``bins``, which have no
    start and no density; densities are among the rows between.
    """
    bins = int(round((stop - start) / width))
    x = F.col(column)
    bin_no = F.least(F.floor((x - start) / width), F.lit(bins - 1))
    bin_no = F.when(x < start, -1).when(x > stop, bins).otherwise(bin_no).cast("int")
    counts = df.filter(x.isNotNull()).groupBy(group, bin_no.alias("bin")).agg(F.count("*").alias("rows"))
    between = (F.col("bin") >= 0) & (F.col("bin") < bins)
    totals = counts.groupBy(F.col(group).alias("of")).agg(F.sum(F.when(between, F.col("rows"))).alias("total"))
    return counts.join(totals, F.col(group).eqNullSafe(F.col("of"))).select(
        group,
        "bin",
        F.when(between, F.lit(float(start)) + F.col("bin") * F.lit(float(width))).alias("bin_start"),
        "rows",
        F.when(between, ratio(F.col("rows"), F.col("total") * F.lit(float(width)))).alias("density"),
    )


def _kernel_sums(points: int) -> Callable:
    """From batches of ``group, x, n, start, step, bandwidth`` to ``group, n, start, step, bandwidth, sums``: one array
    of ``points`` sums for each group of a task."""

    def run(batches):
        sums: dict = {}

        def given_out(kind: pa.DataType) -> pa.RecordBatch:
            known = [pa.array([of[i] for of, _ in sums.values()], pa.float64() if i else pa.int64()) for i in range(4)]
            held = pa.array([list(s) for _, s in sums.values()], pa.list_(pa.float64()))
            out = pa.RecordBatch.from_arrays([pa.array(list(sums), kind), *known, held], ["group", "n", "start", "step", "bandwidth", "sums"])
            sums.clear()
            return out

        for batch in batches:
            kind = batch.schema.field(0).type
            keys = batch.column(0).dictionary_encode()
            codes = keys.indices.to_numpy(zero_copy_only=False)
            x, n, start, step, bandwidth = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(1, 6))
            order = np.argsort(codes, kind="stable")
            cuts = np.flatnonzero(np.diff(codes[order])) + 1
            for mine in np.split(order, cuts) if len(order) else ():
                first = mine[0]
                grid = start[first] + np.arange(points) * step[first]
                values, rows = np.unique(x[mine], return_counts=True)
                of = (n[first], start[first], step[first], bandwidth[first])
                _, held = sums.setdefault(keys.dictionary[codes[first]].as_py(), (of, np.zeros(points)))
                for at in range(0, len(values), VALUES_AT_A_TIME):
                    z = (grid - values[at : at + VALUES_AT_A_TIME, None]) / bandwidth[first]
                    held += rows[at : at + VALUES_AT_A_TIME] @ np.exp(-z * z / 2)
            if len(sums) >= GROUPS_AT_A_TIME:
                yield given_out(kind)
        if sums:
            yield given_out(kind)

    return run


def density_curve(df: DataFrame, column: str, group: str, log_scale: bool = False, points: int = GRID_POINTS) -> DataFrame:
    """Gaussian kernel density per group on an even grid of ``points`` values.

    Bandwidth is the standard deviation times n^(-1/5). Each row adds its share to every point of its
    group's grid inside the task that reads it; what is shuffled are the sums, one per group, point and
    task. A group of one row or without spread has one row with a null density.
    """
    x = F.col(column).cast("double")
    values = df.select(group, (F.log1p(x) if log_scale else x).alias("x")).filter("x IS NOT NULL")
    spread = (
        values.groupBy(group)
        .agg(F.count("*").alias("n"), F.stddev_samp("x").alias("sd"), F.min("x").alias("low"), F.max("x").alias("high"))
        .withColumn("bandwidth", F.col("sd") * F.pow(F.col("n").cast("double"), F.lit(-0.2)))
        .withColumn("start", F.col("low") - GRID_CUT * F.col("bandwidth"))
        .withColumn("step", (F.col("high") - F.col("low") + 2 * GRID_CUT * F.col("bandwidth")) / F.lit(points - 1))
        .select(group, "n", "bandwidth", "start", "step", "low")
    )
    # Written down, its true size tells Spark whether it can be broadcast.
    every = staged(spread, "spread")
    spread = every.filter("bandwidth > 0")
    flat = every.filter("bandwidth IS NULL OR NOT bandwidth > 0").select(
        group, F.lit(0).alias("point"), F.col("low").alias("x"), F.lit(None).cast("double").alias("density")
    )
    kind = df.schema[group].dataType.simpleString()
    norm = F.col("n") * F.col("bandwidth") * F.sqrt(2 * F.pi())
    return (
        values.join(spread, group)
        .select(F.col(group).alias("group"), "x", "n", "start", "step", "bandwidth")
        .mapInArrow(_kernel_sums(points), f"group {kind}, n long, start double, step double, bandwidth double, sums array<double>")
        .select(F.col("group").alias(group), "n", "start", "step", "bandwidth", F.posexplode("sums").alias("point", "share"))
        .groupBy(group, "point", "n", "start", "step", "bandwidth")
        .agg(F.sum("share").alias("kernel_sum"))
        .select(
            group,
            "point",
            (F.col("start") + F.col("point") * F.col("step")).alias("x"),
            (F.col("kernel_sum") / norm).alias("density"),
        )
        .unionByName(flat)
    )


def seeded_sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """``n`` rows chosen by a hash of seed and key: the same rows however Spark partitions.

    Each task keeps its own best ``n`` rows before they are merged.
    """
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
    return df.orderBy(order, key).limit(n)
