"""Aggregates of a group-by. Each takes positions of columns and is one Column expression over the group.

Several columns count as one pool: Sum(1, 2) adds both columns, Avg(1, 2) divides by rows times columns, and
Count counts rows whatever its columns are.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..types import SchemaError, same_type


class Aggregate:
    name = "Aggregate"

    def __init__(self, *columns: int) -> None:
        self.columns = columns

    def expression(self, cols: Sequence[Column], types: Sequence[T.DataType]) -> Column:
        raise NotImplementedError

    def __str__(self) -> str:
        return f"{self.name}<{', '.join(map(str, self.columns))}>"

    def _same(self, types: Sequence[T.DataType]) -> T.DataType:
        if not self.columns or not all(same_type(types[i], types[self.columns[0]]) for i in self.columns):
            raise SchemaError(f"{self} needs columns of one type")
        return types[self.columns[0]]


class Sum(Aggregate):
    """The sum in the columns' own type; a sum that does not fit raises."""

    name = "Sum"

    def expression(self, cols, types):
        own = self._same(types)
        total = F.sum(cols[self.columns[0]])
        for i in self.columns[1:]:
            total = total + F.sum(cols[i])
        return total.cast(own)


class Count(Aggregate):
    name = "Count"

    def expression(self, cols, types):
        return F.count(F.lit(1))


class Avg(Aggregate):
    name = "Avg"

    def expression(self, cols, types):
        self._same(types)
        total = F.sum(cols[self.columns[0]].cast("double"))
        for i in self.columns[1:]:
            total = total + F.sum(cols[i].cast("double"))
        return total / (F.count(F.lit(1)) * len(self.columns))


class Union(Aggregate):
    """The union of set columns, as a sorted array of distinct elements.

    Each task unites what it has read before it passes anything on.
    """

    name = "Union"

    def expression(self, cols, types):
        if not isinstance(self._same(types), T.ArrayType):
            raise SchemaError(f"{self} needs arrays")
        return F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.array_distinct(F.concat(*[cols[i] for i in self.columns]))))))


@dataclass
class UserAggregate(Aggregate):
    """An aggregate of the user's own: a function of the columns' expressions (or a grouped pandas UDF) to a Column."""

    label: str
    columns: tuple[int, ...]
    function: Callable[..., Column]

    def expression(self, cols, types):
        return self.function(*[cols[i] for i in self.columns])

    def __str__(self) -> str:
        return f"{self.label}<{', '.join(map(str, self.columns))}>"
