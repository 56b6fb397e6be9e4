"""Rounding, division and year arithmetic on columns."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(value: Column, places: int) -> Column:
    """Round half away from zero in decimal, so ties do not depend on binary fractions."""
    return F.round(value.cast("decimal(28,10)"), places).cast("double")


def significant(value: Column, digits: int) -> Column:
    """Round to a number of significant digits."""
    return F.format_string(f"%.{digits - 1}e", value).cast("double")


def ratio(top: Column, bottom: Column) -> Column:
    """Quotient as double; null where the divisor is zero or either side is null."""
    return F.try_divide(top.cast("double"), bottom.cast("double"))


def total_of(columns) -> Column:
    """Sum of columns, null read as 0."""
    return reduce(add, [F.coalesce(F.col(f"`{c}`"), F.lit(0)) for c in columns])


def weighted_total(columns_and_weights) -> Column:
    """Sum of column times integer weight, null read as 0."""
    return reduce(
        add,
        [F.coalesce(F.col(f"`{c}`"), F.lit(0)) * F.lit(int(w)) for c, w in columns_and_weights],
    )


def copies(rows: Column, rows_per_copy: int) -> Column:
    """How many pieces a group of ``rows`` rows is split into; 1 for an ordinary group."""
    return (F.lit(1) + F.floor(rows / F.lit(rows_per_copy))).cast("int")


def piece_of(key: Column, pieces: Column) -> Column:
    """The piece, 0 to ``pieces`` - 1, that a row belongs to."""
    return F.pmod(F.xxhash64(key), pieces).cast("int")


def every_piece(pieces: Column) -> Column:
    """Generator that repeats a row once for each piece."""
    return F.explode(F.sequence(F.lit(0), pieces - F.lit(1)))
