"""Declared schemas: column lists of relations, their equality, and the types they may not hold."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import types as T

#: Types a collection can store, and the name each has in the catalog of collections.
SQL_NAMES = {
    T.BooleanType: "boolean",
    T.StringType: "text",
    T.ShortType: "smallint",
    T.IntegerType: "integer",
    T.LongType: "bigint",
    T.FloatType: "real",
    T.DoubleType: "double precision",
    T.TimestampType: "timestamptz",
}


class SchemaError(TypeError):
    """A head and a body, or two key lists, whose types are not equal."""


def schema_of(columns: Sequence[tuple[str, str]]) -> T.StructType:
    """StructType of (name, DDL type) pairs; every column is required."""
    names = [n for n, _ in columns]
    if len(set(names)) != len(names):
        raise SchemaError(f"repeated column names: {names}")
    fields = T.StructType.fromDDL(", ".join(f"`{n}` {t}" for n, t in columns)).fields if columns else []
    for f in fields:
        forbid_maps(f.dataType)
    return T.StructType([T.StructField(f.name, f.dataType, False) for f in fields])


def forbid_maps(t: T.DataType) -> None:
    """Maps have no equality, so no set semantics."""
    if isinstance(t, T.MapType):
        raise SchemaError("collections can't hold maps")
    if isinstance(t, T.ArrayType):
        forbid_maps(t.elementType)
    if isinstance(t, T.StructType):
        for f in t.fields:
            forbid_maps(f.dataType)


def same_type(a: T.DataType, b: T.DataType) -> bool:
    """Equality but for nullability, at any depth."""
    return a.simpleString() == b.simpleString()


def require_same(head: Sequence[T.DataType], body: Sequence[T.DataType], what: str) -> None:
    if len(head) != len(body) or not all(same_type(a, b) for a, b in zip(head, body, strict=True)):
        raise SchemaError(f"{what}: {[t.simpleString() for t in head]} and {[t.simpleString() for t in body]} are not equal")


def sql_name(t: T.DataType) -> str:
    """The catalog's name of a column type."""
    if isinstance(t, T.ArrayType):
        return f"{sql_name(t.elementType)}[]"
    if isinstance(t, T.DecimalType):
        return f"numeric({t.precision})"
    return SQL_NAMES.get(type(t), t.simpleString())
