"""Triangles of a network, found in the cells of a grid of colours.

Every vertex has one of k colours, by hash. A triangle a, b, c, named by degree from low to high, lies in
the cell of its three colours. Edges are dealt once into blocks by the colours of their ends and packed there as sorted
adjacency lists; a block is sent to the cells in which its edges can be the side ab, bc or ac, fewer than 3 k of
the k^3. What is shuffled are copies of packed edges, never paths. Inside a cell the lists of higher
neighbours of a and of b are intersected for each side ab, and what the triangles add to a side or a
corner is summed up before it leaves.

Edges point from the end of lower degree to the end of higher degree, so a vertex has at most
``sqrt(2 * edges)`` outgoing edges, whatever its degree. Vertices of a k-th of all edges have colours of their own. As
they have the highest degrees, they stand at the upper end of a triangle, and other vertices meet them
only there. The edges of such a vertex lie in the blocks of its colour, a k-th of them in each.

The copies grow with the power 1.5 of the edges, which a dense network needs. Where degrees are bounded, sending
``lists`` to the blocks of egos that need them moves less and grows with the edges; the cheaper of the two is taken.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tieloom.functions.numeric import ratio
from tieloom.operators import lists
from tieloom.operators.graph import annotated_ties
from tieloom.operators.lists import ranges
from tieloom.sources.tables import rows_to_table

#: Edges of a cell, about, and pairs of an intersection that are looked up at a time.
EDGES_PER_CELL = 1_000_000
PAIRS_AT_A_TIME = 1 << 20


def colours_for(edges: int, tasks: int, edges_per_cell: int = EDGES_PER_CELL) -> int:
    """Colours that keep a cell at about ``edges_per_cell`` edges and give each task some cells."""
    return max(2, ceil((3 * edges / edges_per_cell) ** 0.5), ceil((4 * tasks) ** (1 / 3)))


def oriented(annotated: DataFrame, *also: str) -> DataFrame:
    """Edges from ``low`` to ``high``, by degree and then by id, with shares of tie strength and ego flags, and the columns ``also``."""
    turned = annotated.selectExpr("*", "src_degree < dst_degree OR (src_degree = dst_degree AND src < dst) AS up")
    ends = []
    for n in ("", "_degree", "_strength", "_is_ego"):
        ends += [f"if(up, src{n}, dst{n}) AS low{n}", f"if(up, dst{n}, src{n}) AS high{n}"]
    return turned.selectExpr("weight", *ends).select(
        "low", "high", "low_degree", "high_degree", "low_is_ego", "high_is_ego",
        ratio(F.col("weight"), F.col("low_strength")).alias("up_share"), ratio(F.col("weight"), F.col("high_strength")).alias("down_share"), *also,
    )


def _coloured(edges: DataFrame, k: int, count: int) -> tuple[DataFrame, int]:
    """``edges`` with the colours ``x`` and ``y`` of their ends, and the number of colours.

    At most ``k`` vertices have the degree 2 * count / k, so their list is short.
    """
    most = max(2.0, 2 * count / k)
    hubs = edges.where(F.col("high_degree") >= most).select(F.explode(F.array(F.struct(F.col("low").alias("id"), F.col("low_degree").alias("d")), F.struct(F.col("high").alias("id"), F.col("high_degree").alias("d")))).alias("end"))
    hubs = [r["id"] for r in hubs.select("end.*").where(F.col("d") >= most).select("id").distinct().orderBy("id").collect()]
    plain = {c: F.pmod(F.xxhash64(end), F.lit(k)).cast("int") for c, end in (("x", "low"), ("y", "high"))}
    if not hubs:
        return edges.withColumns(plain), k
    named = rows_to_table(edges.sparkSession, [(h, k + i) for i, h in enumerate(hubs)], f"id {edges.schema['low'].dataType.simpleString()}, own int")
    for c, end in (("x", "low"), ("y", "high")):
        own = named.select(F.col("id").alias(end), F.col("own").alias(f"own_{c}"))
        edges = edges.join(F.broadcast(own), end, "left").withColumn(c, F.coalesce(f"own_{c}", plain[c])).drop(f"own_{c}")
    return edges, k + len(hubs)


def adjacency(low: np.ndarray, high: np.ndarray):
    """Sorted ids ``lows`` and ``highs``, the bounds ``first`` of the list of each low, the order of the edges by both
    ends, places of their ``high`` in ``highs``, and an edge of each low and each high."""
    lows, low_at, low_place = np.unique(low, return_index=True, return_inverse=True)
    highs, high_at, high_place = np.unique(high, return_index=True, return_inverse=True)
    order = np.lexsort((high_place, low_place))
    first = np.concatenate([[0], np.cumsum(np.bincount(low_place, minlength=len(lows)))])
    return lows, highs, first, order, high_place[order].astype(np.int32), low_at, high_at


class Block:
    """Edges as adjacency lists: ``first[i]`` to ``first[i + 1]`` are the places of the edges of ``lows[i]``, sorted
    by ``high``, which are places in ``highs``. Both lists of ids are sorted."""

    ARRAYS = {"lows": np.int64, "highs": np.int64, "first": np.int64, "high": np.int32, "low_ego": np.bool_, "high_ego": np.bool_, "up": np.float64, "down": np.float64}

    def __init__(self, **arrays: np.ndarray):
        self.__dict__.update(arrays)

    @classmethod
    def of(cls, low, high, low_ego, high_ego, up, down) -> Block:
        lows, highs, first, order, places, low_at, high_at = adjacency(low, high)
        return cls(lows=lows, highs=highs, first=first, high=places, low_ego=low_ego[low_at], high_ego=high_ego[high_at], up=up[order], down=down[order])

    def packed(self) -> dict[str, bytes]:
        return {name: np.ascontiguousarray(getattr(self, name), kind).tobytes() for name, kind in self.ARRAYS.items()}

    @classmethod
    def unpacked(cls, row: dict) -> Block:
        return cls(**{name: np.frombuffer(row[name], kind) for name, kind in cls.ARRAYS.items()})

    @property
    def low(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.lows)), np.diff(self.first))


_PACKED = ", ".join(f"{name} binary" for name in Block.ARRAYS)


def blocks(edges: DataFrame, tasks: int) -> DataFrame:
    """``x, y`` and a packed ``Block`` of the coloured edges of these colours, made in ``tasks`` tasks: adaptive
    execution goes by bytes and would merge them into a few."""

    def pack(table: pa.Table) -> pa.Table:
        columns = [table.column(c).to_numpy() for c in ("low", "high", "low_is_ego", "high_is_ego", "up_share", "down_share")]
        made = Block.of(*columns).packed()
        return pa.table({"x": table.column("x")[:1], "y": table.column("y")[:1], **{name: pa.array([data], pa.binary()) for name, data in made.items()}})

    return edges.select("x", "y", "low", "high", "low_is_ego", "high_is_ego", "up_share", "down_share").repartition(tasks, "x", "y").groupBy("x", "y").applyInArrow(pack, f"x int, y int, {_PACKED}")


def in_cells(packed: DataFrame, k: int, colours: int) -> DataFrame:
    """Each row of ``packed`` (``x, y, ...``) in every ``cell`` where its edges can be a side, with ``i, j, l``, the
    colours of the cell. The first ``k`` colours are those of vertices that share them."""
    every = F.sequence(F.lit(0), F.lit(colours - 1))
    cool, hot = F.slice(every, 1, k), F.slice(every, k + 1, max(1, colours - k))
    x, y = F.col("x"), F.col("y")

    def cells(others, i, j, l):  # noqa: E741
        return F.transform(others, lambda o: (F.coalesce(i, o).cast("long") * colours + F.coalesce(j, o)) * colours + F.coalesce(l, o))

    free = F.lit(None).cast("int")
    as_ab = cells(F.when(y >= k, hot).otherwise(every), x, y, free)
    as_bc = cells(F.when(x >= k, every).otherwise(cool), free, x, y)
    as_ac = cells(F.when(x >= k, hot).when(y >= k, every).otherwise(cool), x, free, y)
    placed = packed.withColumn("cell", F.explode(F.array_distinct(F.concat(as_ab, as_bc, as_ac))))
    return placed.withColumns(
        {"i": F.floor(F.col("cell") / (colours * colours)).cast("int"), "j": (F.floor(F.col("cell") / colours) % colours).cast("int"), "l": (F.col("cell") % colours).cast("int")}
    )


def places_in(of: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Where the sorted ids ``of`` stand in the sorted ids ``among``; -1 where they do not."""
    found = np.searchsorted(among, of)
    found[found == len(among)] = 0
    return np.where(among[found] == of, found, -1)


def intersected(ab: Block, bc: Block, ac: Block):
    """Triangles as places of edges in ``ab``, ``bc`` and ``ac``, a part at a time.

    For a side ab the shorter of the two lists of higher neighbours is looked up in the longer.
    """
    size = len(ac.highs)
    third = places_in(bc.highs, ac.highs)[bc.high]
    usable = np.flatnonzero(third >= 0)
    bc_first = np.searchsorted(usable, bc.first)
    lists = {"ac": (ac.first, np.arange(len(ac.high)), ac.high.astype(np.int64)), "bc": (bc_first, usable, third[usable])}
    a, b = places_in(ab.lows, ac.lows)[ab.low], places_in(ab.highs, bc.lows)[ab.high]
    sides = np.flatnonzero((a >= 0) & (b >= 0))
    ends = {"ac": a[sides], "bc": b[sides]}
    lengths = {name: np.diff(lists[name][0])[ends[name]] for name in lists}
    some = (lengths["ac"] > 0) & (lengths["bc"] > 0)
    from_b = lengths["bc"] <= lengths["ac"]
    for own, other, chosen in (("bc", "ac", some & from_b), ("ac", "bc", some & ~from_b)):
        first, place, c = lists[own]
        other_first, other_place, other_c = lists[other]
        keys = np.repeat(np.arange(len(other_first) - 1), np.diff(other_first)) * size + other_c
        part = np.flatnonzero(chosen)
        total = np.cumsum(lengths[own][part])
        at = 0
        while at < len(part):
            done = int(total[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(total, done + PAIRS_AT_A_TIME)))
            now = part[at:to]
            n = lengths[own][now]
            mine = ranges(first[ends[own][now]], n)
            side = np.repeat(now, n)
            wanted = ends[other][side] * size + c[mine]
            found = np.searchsorted(keys, wanted)
            found[found == len(keys)] = 0
            hit = keys[found] == wanted
            one, two = place[mine[hit]], other_place[found[hit]]
            yield sides[side[hit]], one if own == "bc" else two, two if own == "bc" else one
            at = to


def _sides(table: pa.Table) -> tuple[Block, Block, Block] | None:
    """The blocks of a cell by side; none if one is missing."""
    found = {}
    for row in table.to_pylist():
        found[row["x"], row["y"]] = row
    i, j, l = row["i"], row["j"], row["l"]  # noqa: E741
    if (i, j) not in found or (j, l) not in found or (i, l) not in found:
        return None
    return tuple(Block.unpacked(found[side]) for side in ((i, j), (j, l), (i, l)))


def closed_pairs(annotated: DataFrame, edges_per_cell: int = EDGES_PER_CELL) -> DataFrame:
    """Per ego, the number of neighbour pairs that are tied to each other. ``annotated`` should be a written table."""
    edges, _, paths, most = lists.totals(annotated)
    if _lists_move_less(annotated, edges, paths, most, edges_per_cell):
        return listed_pairs(annotated, paths)
    return _grid_pairs(annotated, edges, edges_per_cell)


def indirect_shares(annotated: DataFrame, edges_per_cell: int = EDGES_PER_CELL) -> DataFrame:
    """Per cell, ego and alter: the summed shares of tie strength by way of a third, and the number of triads.

    A way from i by q to j counts ``p_iq * p_qj``. Each triangle has two ways for each of its corners. ``annotated`` should be
    a written table.
    """
    edges, _, paths, most = lists.totals(annotated)
    if _lists_move_less(annotated, edges, paths, most, edges_per_cell):
        return listed_shares(annotated, paths)
    return _grid_shares(annotated, edges, edges_per_cell)


def _lists_move_less(annotated: DataFrame, edges: int, paths: int, most: int, edges_per_cell: int) -> bool:
    """Whether the lists that egos need, with each edge in that of its lower end, are fewer entries than the copies on a grid."""
    k = colours_for(edges, int(annotated.sparkSession.conf.get("spark.sql.shuffle.partitions")), edges_per_cell)
    return most <= lists.TIES_PER_EGO and paths // 2 < 3 * k * edges


def _listed(annotated: DataFrame, paths: int, meet, schema: str, weighted: bool, **options) -> DataFrame:
    """Own ties and lists in cells; where triads are only counted, without shares and weights, which hardly compress."""
    if not weighted:
        annotated = annotated.withColumns({c: F.lit(1).cast("long") for c in ("weight", "src_strength", "dst_strength")})
    half = lambda c: F.ceil(F.col(c) / F.lit(2))
    own = annotated_ties(annotated, ("strength",), ("degree", "strength"), weight=True, of_egos=True).select(
        F.col("src").alias("ego"), F.col("dst").alias("via"), half("dst_degree").alias("via_degree"),
        ratio(F.col("weight"), F.col("src_strength")).alias("share"), F.col("dst_strength").alias("strength"),
    )
    turned = oriented(annotated, "weight").select(F.col("low").alias("owner"), F.col("high").alias("member"), F.col("weight").alias("value"), half("low_degree").alias("owner_degree"))
    return lists.in_cells(own, turned, paths // 2, meet, schema, **options)


def listed_pairs(annotated: DataFrame, paths: int, **options) -> DataFrame:
    """``closed_pairs`` from the lists that egos need. ``paths`` are those of ``lists.totals``."""
    kind = annotated.schema["src"].dataType.simpleString()

    def count(mine: pa.Table, came: list[lists.Lists]) -> pa.Table:
        ego, _, _, triads = lists.closed_ways(mine, came)
        ids, at = np.unique(ego, return_inverse=True)
        return pa.table({"id": ids, "n": np.bincount(at, triads, len(ids)).astype(np.int64)})

    found = _listed(annotated, paths, count, f"id {kind}, n long", False, **options)
    return found.groupBy("id").agg(F.shiftright(F.sum("n"), 1).alias("closed_pairs"))  # either neighbour counts it


def listed_shares(annotated: DataFrame, paths: int, **options) -> DataFrame:
    """``indirect_shares`` from the lists that egos need."""
    kind = annotated.schema["src"].dataType.simpleString()

    def collect(mine: pa.Table, came: list[lists.Lists]) -> pa.Table:
        return pa.table(dict(zip(("ego", "alter", "share", "triads"), lists.closed_ways(mine, came), strict=True)))

    return _listed(annotated, paths, collect, f"ego {kind}, alter {kind}, share double, triads long", True, **options)


def _grid_pairs(annotated: DataFrame, edges: int, edges_per_cell: int) -> DataFrame:
    kind = annotated.schema["src"].dataType.simpleString()

    def count(table: pa.Table) -> pa.Table:
        ids, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if (sides := _sides(table)) is not None:
            ab, bc, _ = sides
            closed = {"a": np.zeros(len(ab.lows), np.int64), "b": np.zeros(len(ab.highs), np.int64), "c": np.zeros(len(bc.highs), np.int64)}
            low = ab.low
            for one, two, _ in intersected(*sides):
                for corner, place in (("a", low[one]), ("b", ab.high[one]), ("c", bc.high[two])):
                    closed[corner] += np.bincount(place, minlength=len(closed[corner]))
            for corner, names, ego in (("a", ab.lows, ab.low_ego), ("b", ab.highs, ab.high_ego), ("c", bc.highs, bc.high_ego)):
                keep = ego & (closed[corner] > 0)
                ids.append(names[keep])
                counts.append(closed[corner][keep])
        return pa.table({"id": np.concatenate(ids), "n": np.concatenate(counts)})

    found = _grid(annotated, edges, edges_per_cell).groupBy("cell").applyInArrow(count, f"id {kind}, n long")
    return found.groupBy("id").agg(F.sum("n").alias("closed_pairs"))


def _grid_shares(annotated: DataFrame, edges: int, edges_per_cell: int) -> DataFrame:
    kind = annotated.schema["src"].dataType.simpleString()

    def collect(table: pa.Table) -> pa.Table:
        parts = []
        if (sides := _sides(table)) is not None:
            ab, bc, ac = sides
            up = [np.zeros(len(s.high)) for s in sides]
            down = [np.zeros(len(s.high)) for s in sides]
            triads = [np.zeros(len(s.high), np.int64) for s in sides]
            for places in intersected(*sides):
                one, two, three = places
                ways = (
                    (ac.up[three] * bc.down[two], bc.up[two] * ac.down[three]),  # a to b, b to a
                    (ab.down[one] * ac.up[three], ac.down[three] * ab.up[one]),  # b to c, c to b
                    (ab.up[one] * bc.up[two], bc.down[two] * ab.down[one]),  # a to c, c to a
                )
                for k, (there, back) in enumerate(ways):
                    up[k] += np.bincount(places[k], weights=there, minlength=len(up[k]))
                    down[k] += np.bincount(places[k], weights=back, minlength=len(up[k]))
                    triads[k] += np.bincount(places[k], minlength=len(up[k]))
            for k, s in enumerate(sides):
                low = s.low
                for share, is_ego, ego, alter in ((up[k], s.low_ego[low], s.lows[low], s.highs[s.high]), (down[k], s.high_ego[s.high], s.highs[s.high], s.lows[low])):
                    keep = is_ego & (triads[k] > 0)
                    parts.append(pa.table({"ego": ego[keep], "alter": alter[keep], "share": share[keep], "triads": triads[k][keep]}))
        empty = np.zeros(0, np.int64)
        return pa.concat_tables(parts) if parts else pa.table({"ego": empty, "alter": empty, "share": np.zeros(0), "triads": empty})

    return _grid(annotated, edges, edges_per_cell).groupBy("cell").applyInArrow(collect, f"ego {kind}, alter {kind}, share double, triads long")


def _grid(annotated: DataFrame, count: int, edges_per_cell: int) -> DataFrame:
    """The blocks of the ``count`` edges in their cells, dealt out by cell."""
    tasks = int(annotated.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    k = colours_for(count, tasks, edges_per_cell)
    coloured, colours = _coloured(oriented(annotated), k, count)
    return in_cells(blocks(coloured, max(tasks, min(k * k // 2, 100 * tasks))), k, colours).repartition(max(tasks, min(k**3 // 4, 100 * tasks)), "cell")
