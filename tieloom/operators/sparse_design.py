"""Design rows as column numbers and values, for models with hundreds of dummies.

A row costs what it holds: entries that are zero are not stored, and the places of an open attribute
are found in the data instead of being listed. Fits add up products of the entries of a row only.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A fit solves systems of this size on the driver and sends sums of its square from each task.
MOST_PARAMETERS = 2_000
# Products of entries that are formed at a time.
CHUNK = 1 << 21


@dataclass(frozen=True)
class Places:
    """A dummy for every value of a scalar or array column, except the reference."""

    column: str
    prefix: str
    reference: str | None = None


class SparseRows:
    """Some rows of a design. ``column`` and ``value`` list the entries row by row, ``sizes`` tells how many a row has."""

    def __init__(self, sizes: np.ndarray, column: np.ndarray, value: np.ndarray, width: int):
        self.sizes, self.column, self.value, self.width = sizes, column.astype(np.int64), value, width
        self.owner = np.repeat(np.arange(len(sizes)), sizes)

    def __len__(self) -> int:
        return len(self.sizes)

    def __matmul__(self, beta: np.ndarray) -> np.ndarray:
        return np.bincount(self.owner, self.value * beta[self.column], len(self))

    def project(self, v: np.ndarray) -> np.ndarray:
        """The transposed matrix times ``v``."""
        return np.bincount(self.column, self.value * v[self.owner], self.width)

    def gram(self, weight: np.ndarray) -> np.ndarray:
        """Weighted products of all pairs of columns. Rows with equally many entries go together."""
        out = np.zeros(self.width * self.width)
        start = np.cumsum(self.sizes) - self.sizes
        for k in np.unique(self.sizes[self.sizes > 0]):
            rows = np.flatnonzero(self.sizes == k)
            for part in np.array_split(rows, -(-len(rows) * int(k) ** 2 // CHUNK)):
                at = start[part][:, None] + np.arange(k)
                column, value = self.column[at], self.value[at]
                place = column[:, :, None] * self.width + column[:, None, :]
                product = value[:, :, None] * value[:, None, :] * weight[part][:, None, None]
                out += np.bincount(place.ravel(), product.ravel(), len(out))
        return out.reshape(self.width, self.width)


def _is_array(df: DataFrame, column: str) -> bool:
    return df.schema[column].dataType.typeName() == "array"


def found_values(df: DataFrame, places: Places) -> list[str]:
    """The values of an attribute in order, without null and the reference."""
    value = F.explode(places.column) if _is_array(df, places.column) else F.col(f"`{places.column}`")
    distinct = df.select(value.alias("v")).filter("v IS NOT NULL").distinct()
    values = sorted(r.v for r in distinct.limit(MOST_PARAMETERS + 1).collect())
    if len(values) > MOST_PARAMETERS:
        raise ValueError(f"{places.column} has more than {MOST_PARAMETERS} values")
    return [v for v in values if v != places.reference]


def sparse_design(
    df: DataFrame, outcome: str, terms: Sequence[str | Places], factor: str | None = None, crossed: Sequence[str | Places] = ()
) -> tuple[DataFrame, list[str]]:
    """Rows ``outcome, columns, values`` and the names of the columns, the intercept first.

    ``terms`` are numeric columns and attributes, ``crossed`` those of them whose product with ``factor`` is a
    term too. A row where a numeric column or an array is null has null entries and is left out of a fit; a
    null scalar attribute has none of its dummies, like the reference.
    """
    names = ["Intercept"]
    entries: list[Column] = [F.array(F.struct(F.lit(0).alias("c"), F.lit(1.0).alias("v")))]
    complete = F.lit(True)
    found = {t: found_values(df, t) for t in dict.fromkeys([*terms, *crossed]) if isinstance(t, Places)}

    def add(term: str | Places, times: Column | None, prefix: str) -> None:
        scale = F.lit(1.0) if times is None else times
        at = len(names)
        if isinstance(term, str):
            names.append(prefix + term)
            entries.append(F.array(F.struct(F.lit(at).alias("c"), (F.col(f"`{term}`").cast("double") * scale).alias("v"))))
            return
        values = found[term]
        if not values:
            return
        names.extend(f"{prefix}{term.prefix}_{v}" for v in values)
        place = F.create_map(*[F.lit(x) for k, v in enumerate(values) for x in (v, at + k)])
        held = F.col(f"`{term.column}`")
        held = F.array_distinct(held) if _is_array(df, term.column) else F.array(held)
        known = F.filter(held, lambda v: v.isNotNull() & F.array_contains(F.map_keys(place), v))
        entries.append(F.transform(known, lambda v: F.struct(F.element_at(place, v).alias("c"), scale.alias("v"))))

    for term in terms:
        add(term, None, "")
        if isinstance(term, str) or _is_array(df, term.column):
            complete = complete & F.col(f"`{term if isinstance(term, str) else term.column}`").isNotNull()
    for term in crossed:
        add(term, F.col(f"`{factor}`").cast("double"), f"{factor}:")
    if len(names) > MOST_PARAMETERS:
        raise ValueError(f"more than {MOST_PARAMETERS} parameters")
    kept = F.when(complete, F.filter(F.concat(*entries), lambda e: e.v != 0))
    rows = df.select(F.col(f"`{outcome}`").cast("double").alias(outcome), kept.alias("entries")).select(
        outcome, F.col("entries.c").alias("columns"), F.col("entries.v").alias("values")
    )
    return rows, names
