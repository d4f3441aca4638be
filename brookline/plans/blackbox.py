"""Lineage of opaque services: what a response depends on, stated in SQL or as a Python function.

Requests start with (dst_addr, src_addr, id bigint), responses with (addr, id bigint). SQL is a template with the
named parameter :id; Python is a callable, never stored source text.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..types import SchemaError, same_type

#: collection, hash, time of insertion, physical time of insertion
COLUMNS = ["collection", "hash", "time_inserted", "ptime_inserted"]


def check_channels(request: T.StructType, response: T.StructType) -> None:
    want = (("request", request, [T.StringType(), T.StringType(), T.LongType()]), ("response", response, [T.StringType(), T.LongType()]))
    for what, schema, types in want:
        if len(schema) < len(types) or not all(same_type(f.dataType, t) for f, t in zip(schema.fields, types, strict=False)):
            raise SchemaError(f"a {what} starts with {[t.simpleString() for t in types]}")


class BlackBoxes:
    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self._boxes: dict[str, tuple[str, object, Callable[[], DataFrame] | None]] = {}

    def register_sql(self, response: str, sql: str, requests: Callable[[], DataFrame]) -> None:
        """sql returns COLUMNS for the response :id; requests gives the request's history (id and COLUMNS)."""
        self._boxes[response] = ("sql", sql, requests)

    def register_python(self, response: str, f: Callable[[SparkSession, int], DataFrame]) -> None:
        self._boxes[response] = ("python", f, None)

    def kind(self, response: str) -> str:
        return self._boxes[response][0] if response in self._boxes else "regular"

    def lineage(self, response: str, response_id: int) -> DataFrame:
        """The tuples a response depends on, the newest first; for SQL the request itself is one of them."""
        kind, how, requests = self._boxes[response]
        if kind == "python":
            return how(self.spark, response_id)
        user = self.spark.sql(how, args={"id": response_id}).select(*COLUMNS)
        own = requests().where(F.col("id") == response_id).select(*COLUMNS)
        return user.unionByName(own).distinct().orderBy(F.desc("ptime_inserted"))

    def lineage_of(self, response: str, ids: DataFrame) -> DataFrame:
        """The tuples that each of many responses depends on: id and COLUMNS, distinct. ids: one column of response ids.

        SQL runs once as a lateral subquery, with :id as the id of the outer row; a Python function is given the ids as
        a DataFrame and returns id and COLUMNS.
        """
        kind, how, requests = self._boxes[response]
        asked = ids.toDF("id").distinct()
        if kind == "python":
            return how(self.spark, asked).select("id", *COLUMNS).distinct()
        body = re.sub(r":id\b", "asked.id", how)
        user = self.spark.sql("SELECT asked.id, found.* FROM {asked} AS asked, LATERAL (" + body + ") AS found", asked=asked).select("id", *COLUMNS)
        own = requests().join(asked, "id", "left_semi").select("id", *COLUMNS)
        return user.unionByName(own).distinct()
