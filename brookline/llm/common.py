"""Shared folders and written intermediate tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.shared import delete, shared_dir

WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Folders made since the innermost ``settled`` began.
_made: list[list[str]] = []


def new_folder(spark: SparkSession, name: str) -> str:
    at = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    if _made:
        _made[-1].append(at)
    return at


def written(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(df: DataFrame) -> None:
    """Deletes the files of a table that nothing reads any more."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        delete(df.sparkSession, folder)


def settled(spark: SparkSession, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """What ``make`` returns, as a written table; the tables that it wrote on the way are deleted."""
    _made.append([])
    try:
        df = make()
    finally:
        made = _made.pop()
    out = written(df, name)
    for folder in made:
        delete(spark, folder)
    return out


#: A table that is joined by key is sent to all tasks if it has so many rows at most.
FEW = 1 << 15


def beside(rows: DataFrame, small: DataFrame, key: list[str], few: bool | None = None, spread: int = 32) -> DataFrame:
    """rows with the columns of ``small``, which has one row a key (inner join).

    A small table of at most FEW rows (counted, unless ``few`` says so) is sent to all tasks. Otherwise no key meets in
    one task: each row goes with one of ``spread`` salts and the small table with all of them.
    """
    if few is None:
        few = small.limit(FEW + 1).count() <= FEW
    if few:
        return rows.join(F.broadcast(small), key)
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64(*rows.columns), F.lit(spread)).cast("int"))
    return salted.join(small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(spread - 1)))), [*key, "__salt"]).drop("__salt")


def running(df: DataFrame, line: list[Column], sums: dict[str, Column], name: str) -> DataFrame:
    """df with, for each name of ``sums``, the sum over all rows before in the order of ``line``.

    The rows are dealt into ranges and written; each range is summed by itself, and what comes before a range from one
    row a range. Equal places in the order count in any order.
    """
    ranged = written(df.repartitionByRange(*line).withColumn("__part", F.spark_partition_id()), name)
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = ranged.groupBy("__part").agg(*[F.sum(c).alias(f"__{k}") for k, c in sums.items()])
    ahead = ahead.select("__part", *[F.coalesce(F.sum(f"__{k}").over(before), F.lit(0)).alias(f"__{k}") for k in sums])
    here = Window.partitionBy("__part").orderBy(*line).rowsBetween(Window.unboundedPreceding, -1)
    own = ranged.withColumns({k: F.coalesce(F.sum(c).over(here), F.lit(0)) for k, c in sums.items()})
    return own.join(F.broadcast(ahead), "__part").select(*df.columns, *[(F.col(k) + F.col(f"__{k}")).alias(k) for k in sums])


def remainder(doc_id: Column | str, n: int) -> Column:
    """crc32 of doc_id as text, modulo n; a null doc_id counts as empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % n


def word_count(text: Column) -> Column:
    """Number of words of a text, in the JVM; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
