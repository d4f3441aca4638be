"""Vector clocks as array<int> columns. Clocks that are compared must be of equal, non-zero length."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _checked(a: Column, b: Column, result: Column) -> Column:
    ok = (F.size(a) == F.size(b)) & (F.size(a) > 0)
    return F.when(ok, result).otherwise(F.raise_error(F.lit("vector clocks need equal, non-zero lengths")).cast("boolean"))


def leq(a: Column, b: Column) -> Column:
    return _checked(a, b, F.forall(F.zip_with(a, b, lambda x, y: x <= y), lambda z: z))


def equal(a: Column, b: Column) -> Column:
    return _checked(a, b, a == b)


def differs(a: Column, b: Column) -> Column:
    return ~equal(a, b)


def less(a: Column, b: Column) -> Column:
    return leq(a, b) & ~equal(a, b)


def geq(a: Column, b: Column) -> Column:
    return leq(b, a)


def greater(a: Column, b: Column) -> Column:
    return less(b, a)


def concurrent(a: Column, b: Column) -> Column:
    return ~leq(a, b) & ~leq(b, a)


def merge(a: Column, b: Column) -> Column:
    """Elementwise maximum."""
    return F.zip_with(a, b, lambda x, y: F.greatest(x, y))


def with_slot(clock: Column, slot: Column | int, value: Column | int) -> Column:
    """The clock with one slot set; slots count from 0."""
    at = F.lit(slot) if isinstance(slot, int) else slot
    v = F.lit(value) if isinstance(value, int) else value
    return F.transform(clock, lambda x, i: F.when(i == at, v).otherwise(x))
