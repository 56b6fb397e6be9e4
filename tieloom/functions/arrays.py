"""Predicates on attribute arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def has_entries(values: Column) -> Column:
    """True for an array with at least one element; false for null and empty arrays."""
    return F.coalesce(F.size(values) > 0, F.lit(False))


def share_a_value(left: Column, right: Column) -> Column:
    """True if the arrays have a non-null element in common."""
    return F.coalesce(F.arrays_overlap(left, right), F.lit(False))


def same_array(left: Column, right: Column) -> Column:
    """True if the arrays are equal element by element, in order."""
    return F.coalesce(left == right, F.lit(False))


def one_or_two(first: Column, second: Column) -> Column:
    """Array of two values, or of one if they are equal."""
    return F.when(first == second, F.array(first)).otherwise(F.array(first, second))


def joined(values: Column) -> Column:
    """Array shown as text, for reports."""
    return F.array_join(values, "|", "?")
