"""Lists of ties, sent to the blocks of egos that are tied to their owners.

Egos are dealt into blocks by hash. A block needs the lists of the vertices that its egos are tied to, and no others; a
list is sent once to each block that needs it. What is shuffled is thus at most the sum of the lists' lengths
over the egos' ties, which in a network of bounded degrees grows in proportion to the network, whereas the
copies of a product of blocks (``triangles``, ``second_order``) grow faster. In a dense network the product
sends less; callers compare the two.

Ties are grouped by owner first, and there each block's lists are cut out and packed as arrays. Lists that would be sent
too often from one group are spread over several by the vertex they lead to. A block whose egos have too many paths is
a row of cells, one for each piece of the vertices that lists lead to; its own ties are in all of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tieloom.functions.numeric import every_piece, piece_of

#: Paths of the egos of a cell, about; also the entries that leave a group of lists.
PATHS_PER_CELL = 4_000_000
#: Longest list of an ego.
TIES_PER_EGO = 1_000_000
#: Paths that are followed at a time.
PATHS_AT_A_TIME = 1 << 22


def totals(annotated: DataFrame) -> tuple[int, int, int, int]:
    """Edges, ties of egos, the degrees of their other ends added up, and the most ties of an ego."""

    def of_egos(value: Callable[[str, str], Column]) -> list[Column]:
        return [F.when(F.col(f"{a}_is_ego"), value(a, b)).otherwise(0) for a, b in (("src", "dst"), ("dst", "src"))]

    ties, paths, degrees = of_egos(lambda a, b: F.lit(1)), of_egos(lambda a, b: F.col(f"{b}_degree")), of_egos(lambda a, b: F.col(f"{a}_degree"))
    found = annotated.agg(F.count("*"), F.sum(ties[0] + ties[1]), F.sum(paths[0] + paths[1]), F.max(F.greatest(*degrees))).first()
    return tuple(int(n or 0) for n in found)


def _packed(values: np.ndarray) -> bytes:
    """Integers in as few bytes as the largest takes, first all lowest bytes, then the next: high ones are alike and compress."""
    if values.dtype.kind != "f":
        low, high = (int(values.min()), int(values.max())) if len(values) else (0, 0)
        values = values.astype(next(t for t in (np.int8, np.int16, np.int32, np.int64) if np.iinfo(t).min <= low and high <= np.iinfo(t).max))
    return np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.itemsize).T.tobytes()


def _unpacked(data: bytes, count: int, real: bool = False) -> np.ndarray:
    if not count:
        return np.zeros(0, np.float64 if real else np.int64)
    size = len(data) // count
    planes = np.frombuffer(data, np.uint8).reshape(size, count)
    return np.ascontiguousarray(planes.T).view(np.float64 if real else f"i{size}").ravel()


def _steps(values: np.ndarray) -> np.ndarray:
    """Differences of integers, which are small in sorted lists."""
    return np.diff(values.astype(np.int64), prepend=np.int64(0))


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, one after the other."""
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()))


_SENT = "block long, piece int, owners int, entries int, owner binary, length binary, member binary, value binary"


def _send(ties: pa.Table, needs: pa.Table) -> pa.Table:
    """The lists of a group cut out for each block, a row for each of its pieces."""
    out = {name: [] for name in ("block", "piece", "owners", "entries", "owner", "length", "member", "value")}
    if ties.num_rows and needs.num_rows:
        owner, member, value = (ties.column(c).to_numpy() for c in ("owner", "member", "value"))
        order = np.lexsort((member, owner))
        member, value = member[order], value[order]
        owners, first = np.unique(owner[order], return_index=True)
        first = np.append(first, len(order))
        block, pieces, wanted = (needs.column(c).to_numpy() for c in ("block", "pieces", "owner"))
        at = np.searchsorted(owners, wanted).clip(max=len(owners) - 1)
        known = owners[at] == wanted
        asked, of = np.unique(block[known] * len(owners) + at[known], return_index=True)
        block, at, pieces = asked // len(owners), asked % len(owners), pieces[known][of]
        bounds = np.append(np.flatnonzero(np.diff(block, prepend=-1)), len(block))
        for i, j in zip(bounds[:-1], bounds[1:], strict=True):
            own = at[i:j]
            length = first[own + 1] - first[own]
            entry = ranges(first[own], length)
            k = int(pieces[i])
            piece = (member[entry].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(k) if k > 1 else None
            for number in range(k):
                mine = entry if k == 1 else entry[piece == number]
                size = length if k == 1 else np.bincount(np.repeat(np.arange(len(own)), length)[piece == number], minlength=len(own))
                row = (int(block[i]), number, len(own), len(mine), _packed(_steps(owners[own])), _packed(size), _packed(_steps(member[mine])), _packed(value[mine]))
                for column, x in zip(out.values(), row, strict=True):
                    column.append(x)
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), *[pa.binary()] * 4)
    return pa.table({name: pa.array(values, kind) for (name, values), kind in zip(out.items(), kinds, strict=True)})


class Lists:
    """A row of lists: the ``owner`` and ``length`` of each, and the ``member`` and ``value`` of all entries."""

    def __init__(self, row: dict, real: bool):
        self.owner, self.length = np.cumsum(_unpacked(row["owner"], row["owners"]), dtype=np.int64), _unpacked(row["length"], row["owners"])
        self.member = np.cumsum(_unpacked(row["member"], row["entries"]), dtype=np.int64)
        self.value = _unpacked(row["value"], row["entries"], real)
        self.first = np.cumsum(self.length, dtype=np.int64) - self.length


def in_cells(
    own: DataFrame, lists: DataFrame, paths: int, meet: Callable[[pa.Table, list[Lists]], pa.Table], schema: str,
    paths_per_cell: int = PATHS_PER_CELL,
) -> DataFrame:
    """``meet`` of the own ties of a cell (``ego, via, via_degree`` and further columns) and of the lists it needs.

    ``lists`` has rows ``owner, member, value, owner_degree``. Both should come from written tables. A cell holds all ties of its
    egos, and all entries of the lists of their other ends that lead to its piece of the vertices.
    """
    spark = own.sparkSession
    real = lists.schema["value"].dataType.typeName() in ("double", "float")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(tasks, ceil(paths / paths_per_cell))
    groups, per_group = blocks, max(1, paths_per_cell)
    shuffled = max(tasks, min(blocks // 2, 100 * tasks))  # not merged by their few bytes

    own = own.withColumn("block", F.pmod(F.xxhash64("ego"), F.lit(blocks)))
    pieces = own.groupBy("block").agg(F.ceil(F.sum("via_degree") / F.lit(2 * paths_per_cell)).cast("int").alias("pieces"))
    placed = own.join(F.broadcast(pieces), "block")  # one row per block

    def group_of(owner: str, degree: str, part: Callable[[Column], Column]) -> list[Column]:
        parts = F.ceil(F.col(degree) * F.least(F.col(degree), F.lit(blocks)) / F.lit(per_group)).cast("int")
        return part(parts)

    left = lists.withColumn("part", group_of("owner", "owner_degree", lambda n: piece_of(F.col("member"), n)))
    right = placed.select("block", "pieces", F.col("via").alias("owner"), group_of("via", "via_degree", lambda n: every_piece(n)).alias("part"))
    number = F.pmod(F.xxhash64("owner", "part"), F.lit(groups)).alias("number")
    left = left.select(number, "owner", "member", "value").repartition(shuffled, "number")
    right = right.select(number, "block", "pieces", "owner").repartition(shuffled, "number")
    sent = left.groupBy("number").cogroup(right.groupBy("number")).applyInArrow(_send, _SENT)

    def cell(mine: pa.Table, came: pa.Table) -> pa.Table:
        return meet(mine, [Lists(row, real) for row in came.to_pylist()])

    columns = [c for c in own.columns if c not in ("block", "via_degree")]
    mine = placed.select("block", every_piece(F.col("pieces")).alias("piece"), *columns).repartition(shuffled, "block", "piece")
    came = sent.repartition(shuffled, "block", "piece")
    return mine.groupBy("block", "piece").cogroup(came.groupBy("block", "piece")).applyInArrow(cell, schema)


def paths_of(starts: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For ties that are followed by ``lengths`` entries from ``starts`` on: tie and entry of each path, a part at a time."""
    total, at = np.cumsum(lengths, dtype=np.int64), 0
    while at < len(total):
        done = int(total[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(total, done + PATHS_AT_A_TIME, side="right")))
        yield np.repeat(np.arange(at, to), lengths[at:to]), ranges(starts[at:to], lengths[at:to])
        at = to


class Own:
    """The ties of a cell's egos, by ``via`` and then by ego; ``ego`` are places in ``egos``, ``place`` those in ``vias``."""

    def __init__(self, table: pa.Table):
        ego, via = table.column("ego").to_numpy(), table.column("via").to_numpy()
        self.egos, ego = np.unique(ego, return_inverse=True)
        self.vias, place = np.unique(via, return_inverse=True)
        self.order = np.lexsort((ego, place))
        self.ego, self.place = ego[self.order], place[self.order]
        self.first = np.searchsorted(self.place, np.arange(len(self.vias) + 1))

    def followed(self, lists: Lists, kept: np.ndarray | None = None):
        """Tie and entry of the paths along the lists, a part at a time; of the entries, only those at ``kept``, in order."""
        at = np.searchsorted(self.vias, lists.owner)
        ties = np.diff(self.first)[at]
        tie, of = ranges(self.first[at], ties), np.repeat(np.arange(len(at)), ties)
        first, length = lists.first, lists.length
        if kept is not None:
            ends = np.searchsorted(kept, np.append(first, first[-1:] + length[-1:]))
            first, length = ends[:-1], np.diff(ends)
        for way, entry in paths_of(first[of], length[of]):
            yield tie[way], entry if kept is None else kept[entry]


def distinct_ends(mine: pa.Table, came: list[Lists]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Egos, the values of the distinct other vertices two steps away added up, and the number of these."""
    if not mine.num_rows or not came:
        return (np.zeros(0, np.int64),) * 3
    own = Own(mine)
    members, at, place = np.unique(np.concatenate([c.member for c in came]), return_index=True, return_inverse=True)
    value = np.concatenate([c.value for c in came])[at].astype(np.int64)
    found, fresh, waiting, start = np.zeros(0, np.int64), [], 0, 0
    for lists in came:
        places = place[start : start + len(lists.member)]
        start += len(lists.member)
        for tie, entry in own.followed(lists):
            fresh.append(own.ego[tie] * len(members) + places[entry])
            waiting += len(tie)
            if waiting > 2 * PATHS_AT_A_TIME:
                found, fresh, waiting = np.unique(np.concatenate([found, *fresh])), [], 0
    found = np.unique(np.concatenate([found, *fresh]))
    if len(members):
        ego, member = found // len(members), found % len(members)
        other = own.egos[ego] != members[member]
        ego, member = ego[other], member[other]
    else:
        ego = member = found
    size = len(own.egos)
    n, total = np.bincount(ego, minlength=size), np.zeros(size, np.int64)
    np.add.at(total, ego, value[member])
    return own.egos[n > 0], total[n > 0], n[n > 0]


def closed_ways(mine: pa.Table, came: list[Lists]):
    """Own ties in a cell, as ego and via, with the summed shares by way of a third vertex and the number of triads.

    Own ties have ``share``, of the ego's strength, and ``strength``, that of the other vertex. A list holds each edge between
    neighbours from one of its ends only; its value is the weight.
    """
    if not mine.num_rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
    own = Own(mine)
    share, strength = (mine.column(c).to_numpy()[own.order].astype(np.float64) for c in ("share", "strength"))
    sought = own.ego * len(own.vias) + own.place
    by_ego = np.argsort(sought)
    sought = sought[by_ego]
    added, triads = np.zeros(len(share)), np.zeros(len(share), np.int64)
    for lists in came:
        place = np.searchsorted(own.vias, lists.member).clip(max=len(own.vias) - 1)
        kept = np.flatnonzero(own.vias[place] == lists.member)
        if not len(kept):
            continue
        for one, entry in own.followed(lists, kept):
            wanted = own.ego[one] * len(own.vias) + place[entry]
            at = np.searchsorted(sought, wanted).clip(max=len(sought) - 1)
            hit = sought[at] == wanted
            one, two, weight = one[hit], by_ego[at[hit]], lists.value[entry[hit]].astype(np.float64)
            for near, far in ((one, two), (two, one)):
                added += np.bincount(far, share[near] * (weight / strength[near]), len(added))
                triads += np.bincount(far, minlength=len(added))
    met = triads > 0
    return own.egos[own.ego[met]], own.vias[own.place[met]], added[met], triads[met]
