"""Small networks and slow, plain versions of the measures to compare with."""

from __future__ import annotations

import random
from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession

from tieloom.schemas import EDGES, VERTICES
from tieloom.sources.tables import rows_to_table


def edge_table(spark: SparkSession, edges) -> DataFrame:
    rows = [(e[0], e[1], e[2] if len(e) > 2 else 1) for e in edges]
    return rows_to_table(spark, rows, EDGES)


def vertex_table(spark: SparkSession, ids, focal=None, **columns) -> DataFrame:
    """Vertices with default attributes; ``columns`` maps a column to {id: value}."""
    defaults = {
        "category": "female",
        "first_pub_year": 1990,
        "pub_count": 1,
        "subject_areas": ["S1"],
        "countries": ["EUROPE"],
        "countries_wo_eu": [],
        "subjects_focal": ["S1"],
        "countries_focal": ["EUROPE"],
    }
    rows = [
        (v, focal is None or v in focal)
        + tuple(columns.get(c, {}).get(v, default) for c, default in defaults.items())
        for v in ids
    ]
    return rows_to_table(spark, rows, VERTICES)


def hub_network(hub_share: int = 120, others: int = 60, seed: int = 7):
    """A network where vertices 0 and 1 are tied to most others, the rest at random."""
    rng = random.Random(seed)
    n = hub_share + others
    pairs = {(0, v) for v in range(1, hub_share)} | {(1, v) for v in range(2, n, 2)}
    while len(pairs) < 6 * n:
        a, b = sorted(rng.sample(range(2, n), 2))
        pairs.add((a, b))
    return [(a, b, rng.randint(1, 4)) for a, b in sorted(pairs)], list(range(n))


def neighbours(edges) -> dict[int, dict[int, int]]:
    out: dict[int, dict[int, int]] = defaultdict(dict)
    for a, b, w in edges:
        out[a][b] = out[b][a] = w
    return out


def open_pairs(edges, ego) -> int:
    nb = neighbours(edges)
    mine = sorted(nb[ego])
    return sum(b not in nb[a] for i, a in enumerate(mine) for b in mine[i + 1 :])


def constraint(edges, ego) -> float:
    nb = neighbours(edges)
    total = {v: sum(ties.values()) for v, ties in nb.items()}

    def p(i, j):
        return nb[i].get(j, 0) / total[i]

    return sum(
        (p(ego, j) + sum(p(ego, q) * p(q, j) for q in nb[ego] if q != j)) ** 2 for j in nb[ego]
    )


def second_order_mean(edges, ego) -> float | None:
    nb = neighbours(edges)
    reached = {b for a in nb[ego] for b in nb[a]} - {ego}
    return sum(len(nb[b]) for b in reached) / len(reached) if reached else None
