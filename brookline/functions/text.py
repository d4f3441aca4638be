"""Scalar helpers on strings, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def split_words(s: Column) -> Column:
    """Pieces between spaces, without empty ones."""
    return F.filter(F.split(s, " "), lambda x: x != "")


def crunch_whitespace(s: Column) -> Column:
    """Newlines become spaces, runs of spaces one space."""
    return F.regexp_replace(F.translate(s, "\n", " "), " +", " ")


def join_words(words: Column) -> Column:
    return F.array_join(words, ", ")


def rand_int(low: int, high: int, seed: int | None = None) -> Column:
    """Uniform integers of [low, high)."""
    return (F.floor((F.rand() if seed is None else F.rand(seed)) * (high - low)) + low).cast("int")


def random_alphanum(n: int, seed: int | None = None) -> Column:
    return F.randstr(F.lit(n)) if seed is None else F.randstr(F.lit(n), F.lit(seed))


def random_id(seed: int | None = None) -> Column:
    """Uniform 64-bit integers, negative ones too."""
    half = lambda k: F.floor((F.rand() if seed is None else F.rand(seed + k)) * (1 << 32)).cast("long")
    return F.shiftleft(half(0), 32).bitwiseOR(half(1))


def zipf_weights(n: int, alpha: float) -> list[float]:
    """Weights 1 / (i + 1)^alpha."""
    return [(i + 1.0) ** -alpha for i in range(n)]


def tuple_hash(*cols: Column) -> Column:
    """The hash that identifies a tuple within its collection; columns are required, so nulls can't collide."""
    return F.xxhash64(*cols) if cols else F.lit(0).cast("long")
