"""Vertices two steps away, found from the lists that egos need or as a product of blocks of adjacency lists.

Where degrees are bounded, the ``lists`` of their neighbours are sent to the blocks of egos, which grows with the ties.
In a dense network the product of blocks sends fewer copies. The cheaper of the two is taken.

In the product, the ties of egos are packed into blocks by ego, and all ties into blocks by the vertex that is reached. Each
pair of an ego block and a reached block meets in a cell. There a bitmap, egos by reached vertices, is marked
along the ties of the vertices between, so a vertex counts once per ego however many ways lead to it; only sums per ego
leave. What is shuffled are copies of packed ties, never paths.

A vertex with more ties than a block holds has blocks of its own, cut by the vertex between. What
such blocks find is not whole by itself: they leave the distinct pairs of ego and reached vertex,
which are made distinct once more over all parts.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tieloom.functions.numeric import ratio
from tieloom.operators import lists
from tieloom.operators.graph import annotated_ties
from tieloom.operators.lists import ranges
from tieloom.operators.triangles import adjacency, places_in
from tieloom.sources.tables import rows_to_table
from tieloom.staging import staged

TIES_PER_BLOCK = 1_000_000
#: Marks of a bitmap, and ways that are followed, at a time.
MARKS_AT_A_TIME = 1 << 25

_ARRAYS = {"lows": np.int64, "highs": np.int64, "first": np.int64, "high": np.int32, "degrees": np.int64}
_PACKED = ", ".join(f"{name} binary" for name in _ARRAYS)


def _blocks(ties: DataFrame, owner: str, count: int, least: int, per_block: int, name: str) -> tuple[DataFrame, int]:
    """``ties`` (``low, high, degree, owner_degree``; ``degree`` belongs to ``high``) packed by ``owner``, an end, with the ``number`` of
    the block and ``whole``, whether it holds all ties of its owners. Also the number of blocks."""
    between = "high" if owner == "low" else "low"
    colours = max(least, ceil(count / per_block))
    hub = F.col("owner_degree") > per_block

    def key(yes: Column | None, no: Column) -> Column:
        return F.when(hub, yes).otherwise(no)

    keyed = ties.select(
        "low", "high", "degree", key(F.col(owner), F.pmod(F.xxhash64(owner), F.lit(colours))).alias("own"), (~hub).alias("whole"),
        key(F.pmod(F.xxhash64(between), F.ceil(F.col("owner_degree") / per_block)), F.lit(0)).alias("part"),
    )

    def pack(table: pa.Table) -> pa.Table:
        low, high, degree = (table.column(c).to_numpy() for c in ("low", "high", "degree"))
        lows, highs, first, _, places, _, high_at = adjacency(low, high)
        made = {"lows": lows, "highs": highs, "first": first, "high": places, "degrees": degree[high_at]}
        data = {c: pa.array([np.ascontiguousarray(made[c], kind).tobytes()], pa.binary()) for c, kind in _ARRAYS.items()}
        return pa.table({c: table.column(c)[:1] for c in ("own", "whole", "part")} | data)

    tasks = int(ties.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = keyed.repartition(max(tasks, min(colours, 100 * tasks)), "own", "whole", "part")  # not merged by their few bytes
    packed = staged(keyed.groupBy("own", "whole", "part").applyInArrow(pack, f"own long, whole boolean, part long, {_PACKED}"), name)
    rows = packed.select("own", "whole", "part").orderBy("own", "whole", "part").collect()  # one per block
    numbers = rows_to_table(ties.sparkSession, [(*r, i) for i, r in enumerate(rows)], "own long, whole boolean, part long, number int")
    return packed.join(F.broadcast(numbers), ["own", "whole", "part"]).drop("own", "part"), len(rows)


def _reached(egos: dict, onward: dict, whole: bool):
    """Ego, reached vertex, its degree and 1 per distinct pair; or, if ``whole``, ego, null and sums."""
    e, o = ({c: np.frombuffer(row[c], kind) for c, kind in _ARRAYS.items()} for row in (egos, onward))
    via = places_in(e["highs"], o["lows"])[e["high"]]
    known = np.flatnonzero(via >= 0)
    via, ego = via[known], np.repeat(np.arange(len(e["lows"])), np.diff(e["first"]))[known]
    bounds = np.searchsorted(ego, np.arange(len(e["lows"]) + 1))
    itself = places_in(e["lows"], o["highs"])
    width, steps = len(o["highs"]), np.diff(o["first"])[via]
    ways = np.concatenate([[0], np.cumsum(steps)])[bounds]
    low = 0
    while low < len(e["lows"]):
        high = min(low + max(1, MARKS_AT_A_TIME // width), max(low + 1, int(np.searchsorted(ways, ways[low] + MARKS_AT_A_TIME, side="right")) - 1))
        marks = np.zeros((high - low, width), bool)
        # the ways of an ego with very many are followed a part at a time
        at, end = bounds[low], bounds[high]
        while at < end:
            to = max(at + 1, at + int(np.searchsorted(np.cumsum(steps[at:end]), MARKS_AT_A_TIME, side="right")))
            marks[np.repeat(ego[at:to] - low, steps[at:to]), o["high"][ranges(o["first"][via[at:to]], steps[at:to])]] = True
            at = to
        own = itself[low:high]
        marks[np.flatnonzero(own >= 0), own[own >= 0]] = False
        if whole:
            yield e["lows"][low:high], None, marks @ o["degrees"], marks.sum(axis=1)
        else:
            i, j = np.nonzero(marks)
            yield e["lows"][low:high][i], o["highs"][j], o["degrees"][j], np.ones(len(i), np.int64)
        low = high


def second_order_degree(annotated: DataFrame, ties_per_block: int = TIES_PER_BLOCK) -> DataFrame:
    """Mean degree of the distinct vertices two steps away from each ego.

    ``annotated`` comes from ``annotated_edges`` and should be written, as it is counted first. A vertex b counts once per ego, however many
    neighbours lead to it, and also if it is a neighbour itself.
    """
    tasks = int(annotated.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    edges, ego_ties, paths, most = lists.totals(annotated)
    least = ceil((4 * tasks) ** 0.5)
    copies = 2 * edges * max(least, ceil(ego_ties / ties_per_block)) + ego_ties * max(least, ceil(2 * edges / ties_per_block))
    if most <= lists.TIES_PER_EGO and paths < copies:
        found = _listed(annotated, paths)
    else:
        found = _product(annotated, 2 * edges, ego_ties, least, ties_per_block)
    return found.groupBy("id").agg(ratio(F.sum("total"), F.sum("n")).alias("second_order_collab_mean_degree")).where(F.col("second_order_collab_mean_degree").isNotNull())


def _listed(annotated: DataFrame, paths: int, **options) -> DataFrame:
    """``id, total, n`` per cell: the degrees of an ego's distinct second-order vertices in the cell's piece, and their number."""
    own = annotated_ties(annotated, dst=("degree",), of_egos=True).select(F.col("src").alias("ego"), F.col("dst").alias("via"), F.col("dst_degree").alias("via_degree"))
    ties = annotated_ties(annotated, src=("degree",), dst=("degree",)).select(F.col("src").alias("owner"), F.col("dst").alias("member"), F.col("dst_degree").alias("value"), F.col("src_degree").alias("owner_degree"))

    def meet(mine: pa.Table, came: list[lists.Lists]) -> pa.Table:
        return pa.table(dict(zip(("id", "total", "n"), lists.distinct_ends(mine, came), strict=True)))

    return lists.in_cells(own, ties, paths, meet, "id long, total long, n long", **options)


def _product(annotated: DataFrame, ties: int, ego_ties: int, least: int, ties_per_block: int) -> DataFrame:
    """``id, total, n`` per ego and part of what it reaches, from the product of blocks."""
    tasks = int(annotated.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    first = annotated_ties(annotated, src=("degree",), of_egos=True).select(F.col("src").alias("low"), F.col("dst").alias("high"), F.lit(0).cast("long").alias("degree"), F.col("src_degree").alias("owner_degree"))
    onward = annotated_ties(annotated, dst=("degree",)).select(F.col("src").alias("low"), F.col("dst").alias("high"), F.col("dst_degree").alias("degree"), F.col("dst_degree").alias("owner_degree"))
    first, n_first = _blocks(first, "low", ego_ties, least, ties_per_block, "ego_blocks")
    onward, n_onward = _blocks(onward, "high", ties, least, ties_per_block, "reached_blocks")
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(max(n, 1) - 1)))
    columns = ["i", "r", "side", "whole", *_ARRAYS]
    left = first.withColumns({"i": F.col("number"), "side": F.lit(0)}).withColumn("r", numbers(n_onward)).select(columns)
    right = onward.withColumns({"r": F.col("number"), "side": F.lit(1)}).withColumn("i", numbers(n_first)).select(columns)
    cells = left.unionByName(right).repartition(max(tasks, min(n_first * n_onward // 2, 100 * tasks)), "i", "r")

    def meet(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda row: row["side"])
        long = pa.int64()
        parts = []
        if len(rows) == 2:
            for ego, reached, total, count in _reached(*rows, rows[0]["whole"] and rows[1]["whole"]):
                b = pa.nulls(len(ego), long) if reached is None else pa.array(reached, long)
                parts.append(pa.table({"id": pa.array(ego, long), "reached": b, "total": pa.array(total, long), "n": pa.array(count, long)}))
        return pa.concat_tables(parts) if parts else pa.table({c: pa.array([], long) for c in ("id", "reached", "total", "n")})

    found = cells.groupBy("i", "r").applyInArrow(meet, "id long, reached long, total long, n long")
    return found.groupBy("id", "reached").agg(
        F.when(F.col("reached").isNull(), F.sum("total")).otherwise(F.max("total")).alias("total"), F.when(F.col("reached").isNull(), F.sum("n")).otherwise(F.max("n")).alias("n")
    )
