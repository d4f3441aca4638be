"""Mixing sources to target weights by systematic sampling.

Every document of a source has the same expected number of copies, target / source_size. The
documents of a source are put in one fixed order (size, hash of doc_id, doc_id); the running sum of
expected copies plus one random offset per source crosses integers, and a document is emitted once
per integer crossed. Ordering by size keeps the words taken near the target.

Ranks come from a range partitioning with offsets per partition, so a source that holds a third
of all rows is spread over many tasks. The only things that meet in one task are the per-source
sums (one row a source).

Defined results: a null text has size 0; a null source is a source of its own, last in order; null
doc_ids are ordered first; repeated rows are separate documents; an empty table gives no rows; a
source whose documents are all of size 0 has target 0 and no copies. Other input columns, whatever
their names, are not touched.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import running, word_count, written

WEIGHTS = (3, 1, 2)


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_size) with target added: share of all sizes split by weight, none above cap times its source.

    Water filling: sources in order of cap * size / weight; the first ones are held at their cap and
    the rest share what is left by weight. Sources are ranked and summed range by range, so they may be many.
    """
    name = F.col("source").asc_nulls_last()
    ranked = running(sizes, [name], {"rank": F.lit(1)}, "mix-sources")
    full = F.lit(float(cap)) * F.col("source_size")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    t = ranked.withColumn("weight", w).withColumn("ratio", full / F.col("weight")).drop("rank")
    t = running(t, [F.col("ratio").asc(), name], {"held": F.col("source_size"), "taken": F.col("weight")}, "mix-ratios")
    t = written(t, "mix-levels")
    every = t.agg(F.sum("source_size").alias("total"), F.sum("weight").alias("weights"))
    t = t.crossJoin(F.broadcast(every)).withColumn("level", (F.lit(float(share)) * F.col("total") - F.lit(float(cap)) * F.col("held")) / (F.col("weights") - F.col("taken")))
    # the first source whose ratio is not below the level it would get sets the level for all after it
    first = t.agg(F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", F.col("source").isNull().alias("none"), "source", F.col("level").alias("at"))))["at"].alias("set"))
    t = t.crossJoin(F.broadcast(first))
    return t.select("source", "source_size", F.when(F.col("set").isNull(), full).otherwise(F.least(full, F.col("set") * F.col("weight"))).alias("target"))


def systematic_copies(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.5, cap: float = 2.0, seed: int = 0, apart: Column | None = None) -> DataFrame:
    """Per document: doc_id, text_hash, source, size, source_size, target, copies. ``apart``: what tells rows of one doc_id apart, the text at least."""
    text_hash = F.xxhash64("text") if apart is None else apart
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), text_hash.alias("text_hash"), F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("key"))
    line = [F.col("source").asc_nulls_last(), "size", "key", "doc_id", "text_hash"]
    sized = written(sized.repartitionByRange(*line).withColumn("part", F.spark_partition_id()), "mix-sizes")
    targets = source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, cap)
    parts = sized.groupBy("part", "source").agg(F.count("*").alias("n"))
    ahead = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.col("source").alias("of"), F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))
    parts = parts.join(targets.withColumnRenamed("source", "to"), F.col("of").eqNullSafe(F.col("to"))).drop("to")
    here = Window.partitionBy("part", "source").orderBy(*line[1:])
    ranked = sized.withColumn("rank", F.row_number().over(here))
    ranked = ranked.join(parts.withColumnRenamed("part", "p"), (F.col("part") == F.col("p")) & F.col("source").eqNullSafe(F.col("of")))
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce("source", F.lit("")))), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rank = F.col("ahead") + F.col("rank")
    copies = F.floor(rank * each + offset) - F.floor((rank - 1) * each + offset)
    return ranked.select("doc_id", "text_hash", "source", "size", "source_size", "target", copies.cast("long").alias("copies"))


def mixed(docs: DataFrame, **options: object) -> DataFrame:
    """The documents of the mix, each as often as it is taken, with the columns of docs."""
    whole = F.xxhash64(*[F.to_json(F.struct(F.col(f"`{f.name}`"))) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in docs.schema.fields])
    copies = systematic_copies(docs, apart=whole, **options)
    # equal rows can't be told apart: their copies are added up and one of them carries the sum
    key = ["doc_id", "source", "text_hash"]
    total = copies.groupBy(*key).agg(F.sum("copies").alias("copies"), F.count("*").alias("rows")).where("copies > 0")
    total = total.select(*[F.col(c).alias(f"__{c}") for c in [*key, "copies", "rows"]])
    given = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), whole.alias("__hash"))
    row = F.col("__row")
    found = given.join(total, row["doc_id"].eqNullSafe(F.col("__doc_id")) & row["source"].eqNullSafe(F.col("__source")) & (F.col("__hash") == F.col("__text_hash")))
    once = found.where("__rows = 1").unionByName(found.where("__rows > 1").dropDuplicates(["__doc_id", "__source", "__text_hash"]))
    return once.select("__row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies")))).select("__row.*")


def query(docs: DataFrame) -> DataFrame:
    return systematic_copies(docs).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


ORACLE = r"""
WITH d AS (SELECT doc_id, source, md5(coalesce(doc_id::VARCHAR, '')) AS k, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight FROM s),
r AS (SELECT *, 2.0::DOUBLE * source_size / weight AS ratio FROM w),
l AS (SELECT *, (1.5::DOUBLE * (sum(source_size) OVER ())::BIGINT - 2.0::DOUBLE * coalesce(sum(source_size) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT)
  / sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
f AS (SELECT *, (SELECT level FROM l WHERE ratio >= level ORDER BY ratio, source NULLS LAST LIMIT 1) AS lv FROM l),
t AS (SELECT source, source_size, CASE WHEN lv IS NULL THEN 2.0::DOUBLE * source_size ELSE least(2.0::DOUBLE * source_size, lv * weight) END AS target,
  ('0x' || substr(md5('0:' || coalesce(source, '')), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE AS u FROM f),
n AS (SELECT d.doc_id, d.size, t.source_size, t.target, t.u, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0::DOUBLE END AS e,
  row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.k, d.doc_id) AS rank FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (floor(rank * e + u) - floor((rank - 1) * e + u))::BIGINT * size AS taken, (floor(rank * e + u) - floor((rank - 1) * e + u))::BIGINT AS copies FROM n
"""
