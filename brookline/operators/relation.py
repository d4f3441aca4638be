"""Relational algebra over DataFrames with provenance.

A Relation is a DataFrame with columns by position (c0, c1, ...), names for them, and a hidden column ``_lineage``:
the ids of the tuples each row comes from. Catalyst drops the hidden column, and all work for it, from plans that
do not read it. A group may come from any number of tuples, so from a group-by on lineage is kept beside the rows, as a
DataFrame with a row for each tuple and id, which is evaluated only if it is read. Operators keep duplicates; only the
head of a rule has set semantics.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Callable, Iterable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.aggregates import Aggregate
from ..sources.shared import written
from ..types import SchemaError, require_same

LINEAGE, ID = "_lineage", "_id"
ID_TYPE = "struct<collection:string,hash:bigint,time:int>"
LINEAGE_TYPE = f"array<{ID_TYPE}>"
#: Pickled bytes up to which a constant relation is a part of the plan.
SMALL = 1 << 20


class Fields:
    """A row's columns for expressions: by position or by name."""

    def __init__(self, names: Sequence[str]) -> None:
        self.names = list(names)

    def __getitem__(self, key: int | str) -> Column:
        return F.col(f"c{key if isinstance(key, int) else self.names.index(key)}")

    def __getattr__(self, name: str) -> Column:
        try:
            return self[name]
        except ValueError:
            raise AttributeError(name) from None

    def __iter__(self):
        return (F.col(f"c{i}") for i in range(len(self.names)))

    def __len__(self) -> int:
        return len(self.names)


class Relation:
    def __init__(self, df: DataFrame, names: Sequence[str], text: str, edges: DataFrame | None = None) -> None:
        """edges: columns of the relation and ``_id``, one row for each id that a tuple comes from beside those in ``_lineage``."""
        self._df, self.names, self.text, self._edges = df, list(names), text, edges

    def _like(self, f: Callable[[DataFrame, str], DataFrame], names: Sequence[str], text: str) -> Relation:
        """The relation of f(frame, column to keep), made of the rows and of the edges."""
        return Relation(f(self._df, LINEAGE), names, text, None if self._edges is None else f(self._edges, ID))

    # ---- construction

    @staticmethod
    def of(df: DataFrame, text: str = "Iterable") -> Relation:
        """Any DataFrame, without lineage."""
        cols = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(df.columns)]
        return Relation(df.select(*cols, F.array().cast(LINEAGE_TYPE).alias(LINEAGE)), df.columns, text)

    @staticmethod
    def iterable(spark: SparkSession, rows: Iterable[tuple] | Callable[[], Iterable[tuple]], schema: str | T.StructType) -> Relation:
        """A constant relation; a callable is read anew at each evaluation of the rule.

        A small one becomes rows of the plan, whose size Spark knows: a join sends it to all tasks. Rows that come from
        Python count as endless, so the other side would be shuffled and sorted by its keys, often few.
        """
        data = list(rows() if callable(rows) else rows)
        df = spark.createDataFrame(data, schema)
        variant = re.search('[tT]ype":"variant"', df.schema.json())  # has no way back from Arrow
        return Relation.of(df if variant or len(pickle.dumps(data)) > SMALL else spark.createDataFrame(df.toArrow(), df.schema))

    @staticmethod
    def scan(df: DataFrame, name: str, names: Sequence[str]) -> Relation:
        """A stored collection: columns, ``_hash`` and ``_times``. Its lineage is all ids of the tuple."""
        ids = F.transform("_times", lambda t: F.struct(F.lit(name).alias("collection"), F.col("_hash").alias("hash"), t.alias("time")))
        return Relation(df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)], ids.alias(LINEAGE)), names, f"Collection({name})")

    @staticmethod
    def meta(df: DataFrame, name: str, names: Sequence[str]) -> Relation:
        """One row for each tuple and time of insertion: (tuple, id); its lineage is that id."""
        one = df.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("c0"), "_hash", F.explode("_times").alias("time"))
        one = one.select("c0", F.struct(F.lit(name).alias("collection"), F.col("_hash").alias("hash"), "time").alias("c1"))
        return Relation(one.withColumn(LINEAGE, F.array("c1")), ["tuple", "id"], f"MetaCollection({name})")

    # ---- reading

    @property
    def df(self) -> DataFrame:
        """The rows under their names, without lineage; repeated names get their position appended."""
        seen: set[str] = set()
        out = []
        for i, n in enumerate(self.names):
            n = n if n not in seen else f"{n}_{i}"
            seen.add(n)
            out.append(F.col(f"c{i}").alias(n))
        return self._df.select(*out)

    @property
    def lineage(self) -> DataFrame:
        """A row for each tuple and id (``_id``) that it comes from."""
        own = self._df.select(*self._cols(), F.explode(LINEAGE).alias(ID))
        return own if self._edges is None else own.unionByName(self._edges)

    @property
    def with_lineage(self) -> DataFrame:
        """The rows with an array of ids. Of a grouped relation each array is one row: for groups of moderate size."""
        if self._edges is None:
            return self._df
        ids = self.lineage.groupBy(*[F.col(c).alias(f"_g{c}") for c in self._cols()]).agg(F.sort_array(F.collect_set(ID)).alias("_ids"))
        on = F.lit(True)
        for c in self._cols():
            on = on & F.col(c).eqNullSafe(F.col(f"_g{c}"))
        return self._df.drop(LINEAGE).join(ids, on, "left").select(*self._cols(), F.coalesce("_ids", F.array().cast(LINEAGE_TYPE)).alias(LINEAGE))

    @property
    def types(self) -> list[T.DataType]:
        return [self._df.schema[f"c{i}"].dataType for i in range(len(self.names))]

    def debug_string(self) -> str:
        return self.text

    def named(self, *names: str) -> Relation:
        if len(names) != len(self.names):
            raise SchemaError(f"{len(self.names)} columns, {len(names)} names")
        return Relation(self._df, names, self.text, self._edges)

    def _cols(self) -> list[str]:
        return [f"c{i}" for i in range(len(self.names))]

    # ---- operators

    def map(self, f: Callable[[Fields], Sequence[Column]], names: Sequence[str] | None = None) -> Relation:
        """Columns computed from columns; may change arity and types."""
        out = list(f(Fields(self.names)))
        names = list(names) if names else [f"x{i}" for i in range(len(out))]
        return self._like(lambda df, keep: df.select(*[c.alias(f"c{i}") for i, c in enumerate(out)], keep), names, f"Map({self.text})")

    def map_udf(self, f: Callable[..., tuple], schema: str | T.StructType, impure: bool = False) -> Relation:
        """A Python function of a row's values to a tuple, in Arrow batches. An impure one is never evaluated twice by
        the optimizer; the rule that holds it is written before it is read by several consumers."""
        schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema

        def run(*cols: pd.Series) -> pd.DataFrame:
            return pd.DataFrame([f(*row) for row in zip(*cols, strict=True)], columns=schema.names)

        def annotated(*cols):  # pandas_udf reads the annotations
            return run(*cols)

        annotated.__annotations__ = {"cols": pd.Series, "return": pd.DataFrame}
        call = F.pandas_udf(annotated, schema)
        call = call.asNondeterministic() if impure else call
        text = f"Map({self.text})"
        called = lambda df, keep: df.select(call(*[F.col(c) for c in self._cols()]).alias("r"), keep)
        made = lambda df, keep: df.select(*[F.col("r")[n].alias(f"c{i}") for i, n in enumerate(schema.names)], keep)
        if impure and self._edges is not None:  # called once a row; its results are written and joined with the edges
            once = written(self._df.select(call(*[F.col(c) for c in self._cols()]).alias("r"), *self._cols(), LINEAGE), "impure")
            on = F.lit(True)
            for c in self._cols():
                on = on & F.col(c).eqNullSafe(F.col(f"_e{c}"))
            edges = self._edges.select(*[F.col(c).alias(f"_e{c}") for c in self._cols()], ID).join(once.drop(LINEAGE), on)
            return Relation(made(once, LINEAGE), schema.names, text, made(edges, ID))
        return self._like(lambda df, keep: made(called(df, keep), keep), schema.names, text)

    def filter(self, f: Callable[[Fields], Column]) -> Relation:
        return self._like(lambda df, keep: df.where(f(Fields(self.names))), self.names, f"Filter({self.text})")

    def filter_udf(self, f: Callable[..., bool]) -> Relation:
        def run(*cols):
            return pd.Series([bool(f(*row)) for row in zip(*cols, strict=True)])

        run.__annotations__ = {"cols": pd.Series, "return": pd.Series}
        return self._like(lambda df, keep: df.where(F.pandas_udf(run, "boolean")(*[F.col(c) for c in self._cols()])), self.names, f"Filter({self.text})")

    def project(self, *at: int) -> Relation:
        """Columns by position; they may repeat, reorder, or be none."""
        if any(not 0 <= i < len(self.names) for i in at):
            raise SchemaError(f"positions {at} of {len(self.names)} columns")
        return self._like(lambda df, keep: df.select(*[F.col(f"c{i}").alias(f"c{k}") for k, i in enumerate(at)], keep), [self.names[i] for i in at], f"Project<{', '.join(map(str, at))}>({self.text})")

    def _beside(self, other: Relation, join: Callable[[DataFrame, DataFrame], DataFrame], text: str) -> Relation:
        """The pairs that ``join`` makes, and the edges of both sides: each side's own joined with the other's rows."""
        n = len(self.names)
        moved = [F.col(f"c{i}").alias(f"c{n + i}") for i in range(len(other.names))]
        cols = [f"c{i}" for i in range(n + len(other.names))]
        pairs = join(self._df.withColumnRenamed(LINEAGE, "_left"), other._df.select(*moved, F.col(LINEAGE).alias("_right")))
        edges = None
        if self._edges is not None:
            edges = join(self._edges, other._df.select(*moved)).select(*cols, ID)
        if other._edges is not None:
            more = join(self._df.drop(LINEAGE), other._edges.select(*moved, ID)).select(*cols, ID)
            edges = more if edges is None else edges.unionByName(more)
        return Relation(pairs.select(*cols, F.array_union("_left", "_right").alias(LINEAGE)), [*self.names, *other.names], text, edges)

    def cross(self, other: Relation) -> Relation:
        """All pairs; an equality that a later filter adds turns it into an equi-join."""
        return self._beside(other, lambda left, right: left.crossJoin(right), f"Cross({self.text}, {other.text})")

    def hash_join(self, other: Relation, left_keys: Sequence[int], right_keys: Sequence[int]) -> Relation:
        """Inner equi-join that keeps both sides' keys; key types must be equal."""
        require_same([self.types[i] for i in left_keys], [other.types[i] for i in right_keys], "join keys")
        on = [F.col(f"c{a}") == F.col(f"c{len(self.names) + b}") for a, b in zip(left_keys, right_keys, strict=True)]
        text = f"HashJoin<LeftKeys<{', '.join(map(str, left_keys))}>, RightKeys<{', '.join(map(str, right_keys))}>>({self.text}, {other.text})"
        return self._beside(other, lambda left, right: left.join(right, on, "inner"), text)

    def group_by(self, keys: Sequence[int], *aggregates: Aggregate) -> Relation:
        """Keys, then aggregates. Without keys an empty input gives no row; without aggregates the keys are made distinct.

        A group's lineage is a row for each id, joined with the group by its keys when it is read.
        """
        cols, types = [F.col(c) for c in self._cols()], self.types
        made = [a.expression(cols, types).alias(f"a{i}") for i, a in enumerate(aggregates)]
        grouped = self._df.groupBy(*[F.col(f"c{k}").alias(f"k{i}") for i, k in enumerate(keys)])
        out = grouped.agg(*made) if made and keys else self._df.select(*[F.col(f"c{k}").alias(f"k{i}") for i, k in enumerate(keys)]).distinct() if keys else grouped.agg(*made, F.count(F.lit(1)).alias("_n")).where("_n > 0")
        final = [F.col(f"k{i}").alias(f"c{i}") for i in range(len(keys))] + [F.col(f"a{i}").alias(f"c{len(keys) + i}") for i in range(len(aggregates))]
        names = [self.names[k] for k in keys] + [str(a) for a in aggregates]
        text = f"GroupBy<Keys<{', '.join(map(str, keys))}>, {', '.join(map(str, aggregates))}>({self.text})"
        ids = self.lineage.select(*[F.col(f"c{k}").alias(f"e{i}") for i, k in enumerate(keys)], ID).distinct()
        on = F.lit(True)
        for i in range(len(keys)):
            on = on & F.col(f"k{i}").eqNullSafe(F.col(f"e{i}"))
        edges = ids.join(out, on) if keys else ids.crossJoin(out)
        return Relation(out.select(*final, F.array().cast(LINEAGE_TYPE).alias(LINEAGE)), names, text, edges.select(*final, ID))

    def flat_map(self, f: Callable[[Fields], Column], names: Sequence[str] | None = None) -> Relation:
        """A row for each element of an array expression; struct elements become columns."""
        kind = self._df.select(f(Fields(self.names)).alias("e")).schema["e"].dataType.elementType
        out = [F.col("e")[n].alias(f"c{i}") for i, n in enumerate(kind.names)] if isinstance(kind, T.StructType) else [F.col("e").alias("c0")]
        names = list(names) if names else (kind.names if isinstance(kind, T.StructType) else ["x0"])
        return self._like(lambda df, keep: df.select(F.explode(f(Fields(self.names))).alias("e"), keep).select(*out, keep), names, f"FlatMap({self.text})")

    def flat_map_udf(self, f: Callable[..., Iterable[tuple]], schema: str | T.StructType) -> Relation:
        """A Python function of a row's values to any number of tuples, in Arrow batches."""
        schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema

        def run(*cols):
            return pd.Series([[dict(zip(schema.names, t, strict=True)) for t in f(*row)] for row in zip(*cols, strict=True)])

        run.__annotations__ = {"cols": pd.Series, "return": pd.Series}
        call = F.pandas_udf(run, T.ArrayType(schema))
        return self.flat_map(lambda r: call(*r), schema.names)
