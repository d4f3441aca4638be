"""Collections: named relations that rules read and write.

A collection's state is a DataFrame of its columns, ``_hash`` (the tuple's hash) and ``_times`` (the logical times
at which the tuple was inserted). States are sets. What a rule adds is appended as a part of its own; parts are
united when they are read, and written as one when there are PARTS of them. Each kind allows certain rules as head:

table: merge, merge_later, delete_later    scratch, channel: merge    stdout: merge, merge_later
stdin, periodic: none
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import tuple_hash
from ..operators.relation import Relation
from ..types import SchemaError, schema_of
from .shared import written

MERGE, MERGE_LATER, DELETE_LATER = "<=", "+=", "-="
Body = Relation | Callable[[int], Relation]
PARTS = 8


@dataclass
class Rule:
    head: Collection
    op: str
    body: Body

    def relation(self, now: int) -> Relation:
        """The body's relation over the collections as they stand; ``now`` is the logical time."""
        return self.body(now) if callable(self.body) else self.body

    def debug_string(self) -> str:
        return f"{self.head.name} {self.op} {self.relation(0).debug_string()}"


class Collection:
    kind = "Collection"
    allowed: tuple[str, ...] = ()
    keeps = False  # whether tuples outlive a tick

    def __init__(self, spark: SparkSession, name: str, columns: Sequence[tuple[str, str]]) -> None:
        if name == "lineage":
            raise SchemaError("the name lineage is reserved")
        self.spark, self.name, self.schema = spark, name, schema_of(columns)
        self.names = self.schema.names
        self.empty = spark.createDataFrame([], self.schema).withColumn("_hash", F.lit(0).cast("long")).withColumn("_times", F.array().cast("array<int>"))
        self._whole: DataFrame | None = None  # one row a tuple
        self._parts: list[DataFrame] = []  # tuples added since, repeated or not
        self.later: list[DataFrame] = []
        self.deletes: list[DataFrame] = []

    @property
    def state(self) -> DataFrame:
        parts = [x for x in (self._whole, *self._parts) if x is not None]
        return self.empty if not parts else self._whole if not self._parts else self._united(parts)

    def _add(self, new: DataFrame) -> None:
        self._parts.append(new)
        if len(self._parts) >= PARTS:
            self._settle(self.state)

    def take(self, state: DataFrame) -> None:
        """A state from elsewhere, written already."""
        self._whole, self._parts, self.later, self.deletes = state, [], [], []

    def _settle(self, state: DataFrame | None) -> None:
        self._whole, self._parts = state if state is None else written(state, self.name), []

    # ---- reading

    def scan(self) -> Relation:
        return Relation.scan(self.state, self.name, self.names)

    def meta(self) -> Relation:
        return Relation.meta(self.state, self.name, self.names)

    @property
    def df(self) -> DataFrame:
        return self.state.select(*[F.col(f"`{n}`") for n in self.names])

    # ---- rules

    def _rule(self, op: str, body: Body) -> Rule:
        if op not in self.allowed:
            raise SchemaError(f"{self.kind} {self.name} can't be the head of {op}")
        return Rule(self, op, body)

    def merge(self, body: Body) -> Rule:
        return self._rule(MERGE, body)

    def merge_later(self, body: Body) -> Rule:
        return self._rule(MERGE_LATER, body)

    def delete_later(self, body: Body) -> Rule:
        return self._rule(DELETE_LATER, body)

    __le__ = merge

    # ---- state

    def _cols(self) -> list[Column]:
        return [F.col(f"`{n}`") for n in self.names]

    def stamped(self, rows: DataFrame, time: int) -> DataFrame:
        """Tuples with their hash and one time; repeated ones become one when parts are united."""
        return rows.select(*self._cols(), tuple_hash(*self._cols()).alias("_hash"), F.array(F.lit(time)).alias("_times"))

    def _united(self, parts: list[DataFrame]) -> DataFrame:
        both = parts[0]
        for p in parts[1:]:
            both = both.unionByName(p)
        times = F.array_sort(F.array_distinct(F.flatten(F.collect_set("_times"))))
        return both.groupBy(*self._cols(), "_hash").agg(times.alias("_times"))

    def apply(self, op: str, rows: DataFrame, time: int) -> None:
        """The effect of a rule on this head. rows are written already."""
        new = self.stamped(rows, time)
        if op == MERGE:
            self._add(new)
        elif op == MERGE_LATER:
            self.later.append(new)
        else:
            self.deletes.append(new)

    def tick(self) -> DataFrame | None:
        """Ends a tick: deferred merges, then deferred deletes. Returns the tuples that go."""
        gone = None
        if self.keeps:
            for new in self.later:
                self._add(new)
            if self.deletes:
                out = self.deletes[0].select(*self._cols())
                for d in self.deletes[1:]:
                    out = out.unionByName(d.select(*self._cols()))
                dead = out.distinct().select(*[F.col(f"`{n}`").alias(f"_d{i}") for i, n in enumerate(self.names)])
                on = [F.col(f"`{n}`").eqNullSafe(F.col(f"_d{i}")) for i, n in enumerate(self.names)]
                before = self.state
                gone = before.join(dead, on, "left_semi")
                self._settle(before.join(dead, on, "left_anti"))
        else:
            gone = self.state if self._parts or self._whole is not None else None
            self._settle(None)
        self.later, self.deletes = [], []
        return gone


class Table(Collection):
    kind, allowed, keeps = "Table", (MERGE, MERGE_LATER, DELETE_LATER), True


class Scratch(Collection):
    kind, allowed = "Scratch", (MERGE,)


class Channel(Collection):
    """The first column is the address of the node to send to; a merge sends and keeps nothing."""

    kind, allowed = "Channel", (MERGE,)

    def __init__(self, spark: SparkSession, name: str, columns: Sequence[tuple[str, str]]) -> None:
        super().__init__(spark, name, columns)
        if self.schema.fields[0].dataType.simpleString() != "string":
            raise SchemaError(f"the first column of channel {name} must be a string address")
        self.sent: list[tuple[int, DataFrame]] = []

    def apply(self, op: str, rows: DataFrame, time: int) -> None:
        self.sent.append((time, rows.select(*self._cols()).distinct()))

    def receive(self, rows: DataFrame, time: int) -> DataFrame:
        """A batch of messages; returns the new tuples."""
        new = self.stamped(written(rows.select(*self._cols()), self.name), time)
        self._add(new)
        return new


class Stdin(Collection):
    kind = "Stdin"

    def __init__(self, spark: SparkSession, name: str = "stdin") -> None:
        super().__init__(spark, name, [("stdin", "string")])

    receive = Channel.receive


class Stdout(Collection):
    """Lines go to ``out`` in order: merged ones at once, deferred ones at the tick. ``out`` is called for each line, or is
    the path of a folder to which Spark appends them as text, so that many lines need not pass the driver."""

    kind, allowed = "Stdout", (MERGE, MERGE_LATER)

    def __init__(self, spark: SparkSession, name: str = "stdout", out: Callable[[str], None] | str = print) -> None:
        super().__init__(spark, name, [("stdout", "string")])
        self.out = out

    def apply(self, op: str, rows: DataFrame, time: int) -> None:
        if op == MERGE:
            self._print(rows)
        else:
            self.later.append(rows.select("stdout").distinct())

    def _print(self, rows: DataFrame) -> None:
        lines = rows.select("stdout").distinct().orderBy("stdout")
        if isinstance(self.out, str):
            lines.write.mode("append").text(self.out)
        else:
            for r in lines.toLocalIterator():
                self.out(r[0])

    def tick(self) -> None:
        for rows in self.later:
            self._print(rows)
        self.later = []


@dataclass
class Timer:
    """The rows of a periodic: ids from 0, one for each period that has passed."""

    period_ms: int
    due_ms: int
    next_id: int = 0

    def fire(self, now_ms: int) -> list[tuple[int, int]]:
        rows = []
        while self.due_ms <= now_ms:
            rows.append((self.next_id, self.due_ms))
            self.next_id, self.due_ms = self.next_id + 1, self.due_ms + self.period_ms
        return rows


class Periodic(Collection):
    """(id, time): a row for each period; cleared at the tick, never written by rules."""

    kind = "Periodic"

    def __init__(self, spark: SparkSession, name: str, period_ms: int) -> None:
        super().__init__(spark, name, [("id", "bigint"), ("time", "timestamp")])
        self.timer = Timer(period_ms, period_ms)

    def fire(self, now_ms: int, time: int) -> DataFrame | None:
        due = self.timer.fire(now_ms)
        if not due:
            return None
        rows = self.spark.createDataFrame(due, "id bigint, ms bigint").select("id", F.timestamp_millis("ms").alias("time"))
        new = self.stamped(rows, time)
        self._add(new)
        return new


