"""Approximate nearest neighbours with learned partitions.

Fitting: of a bounded sample of the vectors (chosen by a hash of the id, ``sample_rows``) the graph
of each vector's nearest others is cut into parts of equal size with few edges between parts:
halving along principal directions, then moves and swaps that lower the cut and keep the balance.
A small network learns from the vectors in which parts their neighbours lie.

Index and search: the network names the most probable part of every vector and the several most
probable parts of each query. Parts are split into blocks by a hash of the id, so a part that holds
a third of all vectors is many blocks, and the queries of a part into chunks likewise. Each block
meets each chunk of its part in a group of its own and ranks its vectors for those queries, by exact
Euclidean distance in double precision; the best of all blocks are the answer. Blocks and chunks are
as many rows as twice the root of the number of vectors (``block_rows`` and ``query_chunk`` at
least): both are sent as often as the other side has pieces, so this keeps copies and groups small.

Vectors that are null, zero, or hold null or non-finite components take no part, nor do those of
another length than the commonest (the shorter, if tied). Null ids take no part. Equal vectors go to
the same part; equal distances are ordered by id. Repeated rows of an id are separate candidates.
Fewer candidates than ``k`` are all returned. Empty tables give empty results.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tieloom.staging import staged

SAMPLE_ROWS = 4096
PARTS, PROBES = 16, 13
BLOCK_ROWS = 512
QUERY_CHUNK = 256


@dataclass
class Router:
    """A network of one hidden layer over standardized vectors."""

    center: np.ndarray
    scale: float
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.maximum((x - self.center) / self.scale @ self.w1 + self.b1, 0) @ self.w2 + self.b2


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k nearest others of each row."""
    k = min(k, len(x) - 1)
    square = (x * x).sum(1)
    out = np.empty((len(x), k), np.int64)
    for i in range(0, len(x), 512):
        d = square[i : i + 512, None] - 2 * x[i : i + 512] @ x.T + square
        d[np.arange(len(d)), np.arange(i, i + len(d))] = np.inf
        out[i : i + 512] = np.argpartition(d, k - 1, axis=1)[:, :k] if k else 0
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, passes: int = 8, slack: float = 0.05) -> np.ndarray:
    """Part of each row: equal parts up to ``slack`` that cut few edges of the graph."""
    label = np.zeros(len(x), np.int64)
    pieces = [np.arange(len(x))]
    while len(pieces) < parts:
        halves = []
        for rows in pieces:
            own = x[rows] - x[rows].mean(0)
            direction = np.linalg.svd(own.T @ own)[0][:, 0] if len(rows) > 1 else np.ones(x.shape[1])
            order = rows[np.argsort(own @ direction, kind="stable")]
            halves += [order[: len(order) // 2], order[len(order) // 2 :]]
        pieces = halves
    for p, rows in enumerate(pieces):
        label[rows] = p
    n, most = len(x), int(np.ceil(len(x) / parts * (1 + slack)))
    source = np.repeat(np.arange(n), graph.shape[1])
    both = np.concatenate([np.stack([source, graph.ravel()]), np.stack([graph.ravel(), source])], axis=1)
    size = np.bincount(label, minlength=parts)
    for _ in range(passes):
        ties = np.zeros((n, parts), np.int32)
        np.add.at(ties, (both[0], label[both[1]]), 1)
        best = ties.argmax(1)
        gain = ties[np.arange(n), best] - ties[np.arange(n), label]
        moved, waiting = 0, {}
        for v in np.argsort(-gain, kind="stable"):
            a, b = int(label[v]), int(best[v])
            if gain[v] <= 0:
                break
            if size[b] < most:
                label[v], moved = b, moved + 1
                size[a] -= 1
                size[b] += 1
            elif waiting.get((b, a)):
                label[waiting[b, a].pop()], label[v], moved = a, b, moved + 2
            else:
                waiting.setdefault((a, b), []).append(v)
        if not moved:
            break
    return label


def train_router(x: np.ndarray, target: np.ndarray, hidden: int = 128, rounds: int = 60, seed: int = 5) -> Router:
    """Fits the network to soft part memberships by Adam."""
    rng = np.random.default_rng(seed)
    center, scale = x.mean(0), float(x.std()) or 1.0
    z = (x - center) / scale
    shape = ((x.shape[1], hidden), (hidden,), (hidden, target.shape[1]), (target.shape[1],))
    weights = [rng.normal(0, np.sqrt(2 / s[0]), s) if len(s) == 2 else np.zeros(s) for s in shape]
    first, second, step = [np.zeros(s) for s in shape], [np.zeros(s) for s in shape], 0
    for turn in range(rounds):
        order = rng.permutation(len(z))
        for i in range(0, len(z), 128):
            rows = order[i : i + 128]
            h = np.maximum(z[rows] @ weights[0] + weights[1], 0)
            out = h @ weights[2] + weights[3]
            p = np.exp(out - out.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            error = (p - target[rows]) / len(rows)
            back = (error @ weights[2].T) * (h > 0)
            gradients = (z[rows].T @ back, back.sum(0), h.T @ error, error.sum(0))
            step += 1
            rate = 2e-3 * 0.5 ** (turn / (rounds / 3)) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for w, g, m, v in zip(weights, gradients, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                w -= rate * m / (np.sqrt(v) + 1e-8)
    return Router(center, scale, *weights)


def fit_router(vectors: DataFrame, parts: int = PARTS, sample_rows: int = SAMPLE_ROWS, graph_k: int = 10) -> Router | None:
    """Router from a sample of ``vectors`` (``id, v``); None if there are too few to part."""
    rows = vectors.orderBy(F.xxhash64("id"), "id").limit(sample_rows).select("v").collect()
    x = np.unique(np.array([r["v"] for r in rows], np.float64), axis=0) if rows else np.zeros((0, 1))
    if len(x) < 4 * parts:
        return None
    graph = neighbour_graph(x, graph_k)
    label = balanced_parts(x, graph, parts)
    target = np.zeros((len(x), parts))
    np.add.at(target, (np.repeat(np.arange(len(x)), graph.shape[1]), label[graph.ravel()]), 1.0)
    target[np.arange(len(x)), label] += 1.0
    return train_router(x, target / target.sum(1, keepdims=True))


def _vectors(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float64) if len(column) else np.zeros((0, 1))


def routed(vectors: DataFrame, router: Router | None, probes: int) -> DataFrame:
    """``id, v`` with ``part``: one row for each of the ``probes`` most probable parts."""

    def run(batches):
        for batch in batches:
            x = _vectors(batch.column(1))
            if router is None:
                parts, rows = np.zeros(len(x), np.int32), np.arange(len(x))
            else:
                score = router.scores(x)
                n = min(probes, score.shape[1])
                parts = np.argsort(-score, axis=1, kind="stable")[:, :n].ravel().astype(np.int32)
                rows = np.repeat(np.arange(len(x)), n)
            taken = batch.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([taken.column(0), taken.column(1), pa.array(parts, pa.int32())], ["id", "v", "part"])

    kind = {f.name: f.dataType.simpleString() for f in vectors.schema}
    return vectors.select("id", "v").mapInArrow(run, f"id {kind['id']}, v {kind['v']}, part int")


def _ranked(queries: np.ndarray, query_ids: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int):
    """The k nearest of a block for each query, by distance, then id."""
    out = ([], [], [])
    for q, query_id in zip(queries, query_ids, strict=True):
        dev = x - q
        d = np.sqrt(np.einsum("ij,ij->i", dev, dev))
        d[ids == query_id] = np.inf
        if len(d) > k:
            near = np.flatnonzero(d <= np.partition(d, k - 1)[k - 1])
        else:
            near = np.arange(len(d))
        near = near[np.isfinite(d[near])]
        near = near[np.lexsort((ids[near], d[near]))][:k]
        out[0].append(np.full(len(near), query_id))
        out[1].append(ids[near])
        out[2].append(d[near])
    return [np.concatenate(c) if c else np.zeros(0) for c in out]


def _pieces(routes: DataFrame, most: int, name: str) -> DataFrame:
    """Per part the number of pieces of about ``most`` rows."""
    return routes.groupBy("part").agg(F.ceil(F.count("*") / most).cast("int").alias(name))


def grid(index: DataFrame, asked: DataFrame, pieces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vectors and queries (``part, id, v``) with ``block`` and ``chunk``: each vector once for each
    chunk of its part, each query once for each block of the part."""
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    return (
        index.join(pieces, "part").select("part", own("blocks").alias("block"), every("chunks").alias("chunk"), "id", "v"),
        asked.join(pieces, "part").select("part", every("blocks").alias("block"), own("chunks").alias("chunk"), "id", "v"),
    )


def search(
    vectors: DataFrame, is_query: Column, k: int = 10, id_column: str = "vec_id", vector_column: str = "embedding",
    parts: int = PARTS, probes: int = PROBES, sample_rows: int = SAMPLE_ROWS, block_rows: int = BLOCK_ROWS,
    query_chunk: int = QUERY_CHUNK,
) -> DataFrame:
    """``query_id, rank, <id_column>, score``: for each row that ``is_query`` (a Column of ``id``)
    marks, its ``k`` nearest found among all other rows."""
    vectors = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).alias("v"))
    vectors = vectors.where(F.col("id").isNotNull() & usable(F.col("v")))
    length = vectors.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    vectors = vectors.where(F.size("v") == (length["n"] if length else 0))
    router = fit_router(vectors, parts, sample_rows)
    index = staged(routed(vectors, router, 1), "index")
    asked = staged(routed(vectors.where(is_query), router, probes), "asked")
    least = 2 * int((length["count"] if length else 0) ** 0.5)
    pieces = F.broadcast(  # one row per part
        _pieces(index, max(block_rows, least), "blocks").join(_pieces(asked, max(query_chunk, least), "chunks"), "part")
    )
    rows, asked = grid(index, asked, pieces)

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        found = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        if left.num_rows and right.num_rows:
            found = _ranked(
                _vectors(right["v"].combine_chunks()), right["id"].to_numpy(), _vectors(left["v"].combine_chunks()), left["id"].to_numpy(), k
            )
        return pa.table([pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64()), pa.array(found[2], pa.float64())], names=["query_id", "id", "score"])

    key = ("part", "block", "chunk")
    candidates = rows.groupBy(*key).cogroup(asked.groupBy(*key)).applyInArrow(best, "query_id bigint, id bigint, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "id")).cast("int")
    return candidates.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_column), "score")
