"""History of collections and edges of provenance, as append-only Parquet tables.

Events (seq, op, _hash, time, ptime, columns) are appended per collection; the interval in which a tuple lived is
derived: an insertion ends at the first later deletion of its hash in log order, which also ends insertions and
deletions at the same logical time.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import tuple_hash
from ..operators.relation import ID, LINEAGE
from .shared import folders, shared_dir

EDGE = "dep_node string, dep_collection string, dep_hash bigint, dep_time int, rule int, inserted boolean, ptime timestamp, node string, collection string, hash bigint, time int"


def intervals(events: DataFrame) -> DataFrame:
    """events: seq, op (I or D), _hash, time, ptime and others. Insertions with time_deleted and ptime_deleted."""
    after = Window.partitionBy("_hash").orderBy("seq").rowsBetween(1, Window.unboundedFollowing)
    dead = F.col("op") == "D"
    out = events.withColumn("time_deleted", F.min(F.when(dead, F.col("time"))).over(after)).withColumn("ptime_deleted", F.min(F.when(dead, F.col("ptime"))).over(after))
    return out.where("op = 'I'").drop("op", "seq").withColumnRenamed("time", "time_inserted").withColumnRenamed("ptime", "ptime_inserted")


def as_of(history: DataFrame, time: int) -> DataFrame:
    """The rows of an interval table that live at a logical time; one that came and went at once counts at its own."""
    came, went = F.col("time_inserted"), F.col("time_deleted")
    return history.where(((came == time) & (came == went)) | ((came <= time) & (went.isNull() | (went > time))))


class History:
    """Tables of one or more nodes below ``root``."""

    def __init__(self, spark: SparkSession, root: str | None = None, clock=lambda: datetime.now(timezone.utc)) -> None:
        self.spark, self.root, self.clock = spark, root or f"{shared_dir(spark)}/history", clock
        self._seq: int | None = None

    @property
    def seq(self) -> int:
        """The number of the last event, also of earlier runs."""
        if self._seq is None:
            self._seq = self._last()
        return self._seq

    @seq.setter
    def seq(self, value: int) -> None:
        self._seq = value

    def _last(self) -> int:
        if not folders(self.spark, f"{self.root}/events"):
            return 0
        return self.spark.read.schema("seq long").parquet(f"{self.root}/events/*/*").agg(F.max("seq")).first()[0] or 0

    def _append(self, df: DataFrame, *path: str) -> None:
        df.write.mode("append").parquet("/".join([self.root, *path]))

    def register(self, node: str, address: str, collections: list[tuple], rules: list[tuple]) -> None:
        """The catalog: nodes, collections (name, kind, column names, types), rules (number, is_bootstrap, text)."""
        make = self.spark.createDataFrame
        self._append(make([(node, address)], "node string, address string"), "nodes")
        self._append(make([(node, *c) for c in collections], "node string, collection string, kind string, columns array<string>, types array<string>"), "collections")
        if rules:
            self._append(make([(node, *r) for r in rules], "node string, rule int, is_bootstrap boolean, text string"), "rules")

    def log(self, node: str, collection: str, rows: DataFrame, names: list[str], op: str, time: int) -> None:
        """Distinct tuples inserted (I) or deleted (D) at a time."""
        self.seq += 1
        cols = [F.col(f"`{n}`") for n in names]
        rows = rows.select(*cols).distinct()
        self._append(rows.select(F.lit(self.seq).cast("long").alias("seq"), F.lit(op).alias("op"), tuple_hash(*cols).alias("_hash"), F.lit(time).alias("time"), F.lit(self.clock()).cast("timestamp").alias("ptime"), *cols), "events", node, collection)

    def derived(self, node: str, collection: str, rows: DataFrame, names: list[str], rule: int, inserted: bool, time: int, more: DataFrame | None = None) -> None:
        """Edges from each tuple's lineage, one row an edge; ``more`` has edges of groups: a tuple and ``_id`` a row."""
        cols = [F.col(f"`{n}`") for n in names]
        e = rows.select(tuple_hash(*cols).alias("hash"), F.explode(LINEAGE).alias("d"))
        if more is not None:
            e = e.unionByName(more.select(tuple_hash(*cols).alias("hash"), F.col(ID).alias("d")))
        e = e.distinct()
        now = F.lit(self.clock()).cast("timestamp")
        self._append(e.select(F.lit(node).alias("dep_node"), F.col("d.collection").alias("dep_collection"), F.col("d.hash").alias("dep_hash"), F.col("d.time").alias("dep_time"), F.lit(rule).alias("rule"), F.lit(inserted).alias("inserted"), now.alias("ptime"), F.lit(node).alias("node"), F.lit(collection).alias("collection"), "hash", F.lit(time).alias("time")), "edges")

    def networked(self, node: str, collection: str, new: DataFrame, dep_node: str, dep_time: int, time: int) -> None:
        """Edges of received messages: the same tuple in the sender's channel at its clock."""
        none = F.lit(None)
        e = new.select(F.lit(dep_node).alias("dep_node"), F.lit(collection).alias("dep_collection"), F.col("_hash").alias("dep_hash"), F.lit(dep_time).alias("dep_time"), none.cast("int").alias("rule"), F.lit(True).alias("inserted"), none.cast("timestamp").alias("ptime"), F.lit(node).alias("node"), F.lit(collection).alias("collection"), F.col("_hash").alias("hash"), F.lit(time).alias("time"))
        self._append(e, "edges")

    # ---- reading

    def _read(self, *path: str) -> DataFrame:
        return self.spark.read.parquet("/".join([self.root, *path]))

    def table(self, name: str) -> DataFrame:
        """nodes, collections or rules; a node that started again is in it once."""
        return self._read(name).distinct()

    def edges(self) -> DataFrame:
        return self._read("edges").select(*[x.split()[0] for x in EDGE.split(", ")])

    def history(self, node: str, collection: str) -> DataFrame:
        return intervals(self._read("events", node, collection))

    def at(self, node: str, collection: str, time: int) -> DataFrame:
        return as_of(self.history(node, collection), time)


class MemoryHistory(History):
    """The same tables as plans over what rules have written, without files of their own; they end with the session."""

    def __init__(self, spark: SparkSession, clock=lambda: datetime.now(timezone.utc)) -> None:
        super().__init__(spark, "memory", clock)
        self._tables: dict[tuple[str, ...], DataFrame] = {}

    def _last(self) -> int:
        return 0

    def _append(self, df: DataFrame, *path: str) -> None:
        was = self._tables.get(path)
        self._tables[path] = df if was is None else was.unionByName(df)

    def _read(self, *path: str) -> DataFrame:
        return self._tables[path]


class NoHistory:
    """Logs nothing."""

    def register(self, *_):
        pass

    log = derived = networked = register
