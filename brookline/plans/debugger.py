"""Provenance queries over interval tables and edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.history import History
from ..sources.shared import written

KEY = ["node", "collection", "hash", "time"]


def backward(history: History, node: str, collection: str, tuple_hash: int, time: int) -> DataFrame:
    """One step back: the edges into the latest insertion of a tuple that lives at ``time``."""
    live = history.at(node, collection, time).where(F.col("_hash") == tuple_hash).agg(F.max("time_inserted").alias("t"))
    e = history.edges().where((F.col("node") == node) & (F.col("collection") == collection) & (F.col("hash") == tuple_hash))
    return e.join(live, F.col("time") == F.col("t")).drop("t")


def forward(history: History, node: str, collection: str, tuple_hash: int, time: int) -> DataFrame:
    """One step on (an addition of this library): the edges out of one insertion of a tuple."""
    return history.edges().where((F.col("dep_node") == node) & (F.col("dep_collection") == collection) & (F.col("dep_hash") == tuple_hash) & (F.col("dep_time") == time))


def nodes(history: History) -> DataFrame:
    return history.table("nodes").select("node", "address")


def address(history: History, node: str) -> str:
    (row,) = history.table("nodes").where(F.col("node") == node).select("address").collect()
    return row[0]


def rule_texts(history: History, node: str, bootstrap: bool = False) -> DataFrame:
    """rule (its number), text: of a node's rules, or of its bootstrap rules, in order."""
    return history.table("rules").where((F.col("node") == node) & (F.col("is_bootstrap") == bootstrap)).select("rule", "text").orderBy("rule")


def collections(history: History, node: str) -> DataFrame:
    return history.table("collections").where(F.col("node") == node).drop("node")


def closure(edges: DataFrame, start: DataFrame) -> DataFrame:
    """All ids that the ids of ``start`` (node, collection, hash, time) come from, itself included, with the least number
    of steps. A frontier join a step; each step's frontier is written, and what was found before is written as one every few steps."""
    e = edges.select(*KEY, *[f"dep_{k}" for k in KEY]).distinct()
    found = written(start.select(*KEY).distinct().withColumn("steps", F.lit(0)), "closure")
    frontier, step = found, 0
    while not frontier.isEmpty():
        step += 1
        if step % 8 == 0:
            found = written(found, "closure")
        reached = frontier.select(*KEY).join(e, KEY).select(*[F.col(f"dep_{k}").alias(k) for k in KEY]).distinct()
        frontier = written(reached.join(found, KEY, "left_anti").withColumn("steps", F.lit(step)), "closure")
        found = found.unionByName(frontier)
    return found


def rule_at_time(time: Column, bootstrap_rules: int, rules: int) -> Column:
    """rule_at of a column of times."""
    head = bootstrap_rules + 1 if bootstrap_rules else 0
    return F.when(time <= head, time - 1).otherwise(head + (time - head - 1) % (rules + 2))


def rule_at(time: int, bootstrap_rules: int, rules: int) -> int:
    """Index of what runs at a logical time in the list: bootstrap rules and their tick (if any), receive, rules, tick."""
    head = bootstrap_rules + 1 if bootstrap_rules else 0
    return time - 1 if time <= head else head + (time - head - 1) % (rules + 2)
