"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line.

Each query is warmed up once, then run RUNS times; its time is the median. The result is written to Spark's
noop sink, so nothing is collected. lineage_ratio is a join with group-by read with and without its lineage column.
"""

import json
import os
import time
from statistics import median

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))
HEADLINE = [
    "revenue_per_nation", "map_expr", "filter_expr", "project_reorder_repeat", "join_single", "join_multi_key", "agg_sum", "agg_avg", "agg_sum_variadic", "agg_union_sets", "agg_keys_only",
    "flat_map_explode", "cross_theta", "rule_sequential_visibility", "rule_deferred_delete", "closure_by_ticks", "kvs_program", "lineage_join", "lineage_group_by",
    "history_intervals", "history_as_of", "bb_last_write", "bb_set_append", "bb_vector_clock", "bb_byte_range", "bb_object_copy",
]


def timed(run) -> float:
    began = time.perf_counter()
    run().write.format("noop").mode("overwrite").save()
    return time.perf_counter() - began


def lineage_ratio(spark) -> float:
    from brookline.functions.aggregates import Count
    from brookline.operators.relation import Relation

    def scan(name: str, *cols: str):
        df = spark.read.parquet(f"{SF_DIR}/{name}.parquet").select(*cols).withColumn("_hash", F.xxhash64(*cols)).withColumn("_times", F.array(F.lit(1)))
        return Relation.scan(df, name, cols)

    grouped = scan("orders", "o_orderkey", "o_custkey").hash_join(scan("customer", "c_custkey", "c_nationkey"), [1], [0]).group_by([3], Count())
    runs = {"off": lambda: grouped.df, "on": lambda: grouped.lineage}
    took = {k: [timed(f) for _ in range(RUNS + 1)][1:] for k, f in runs.items()}
    return median(took["on"]) / median(took["off"])


def tick_seconds(spark, rows: int, ticks: int = 10) -> float:
    from brookline.operators.relation import Relation
    from brookline.plans.program import Program

    src = Relation.of(spark.range(rows).toDF("x"))
    node = Program(spark, "bench").table("t", [("x", "bigint")]).bootstrap(lambda c: [c.t <= src]).rules(lambda c: [c.t.merge(lambda now: c.t.scan().map(lambda r: [r[0] + 1]))]).start()
    node.bootstrap_tick()
    node.tick()
    began = time.perf_counter()
    for _ in range(ticks):
        node.tick()
    return (time.perf_counter() - began) / ticks


def main() -> None:
    from brookline.queries import QUERIES

    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINE:
        timed(lambda: QUERIES[name](spark, SF_DIR))
        took[name] = round(median(timed(lambda: QUERIES[name](spark, SF_DIR)) for _ in range(RUNS)), 3)
    more = {"lineage_ratio": round(lineage_ratio(spark), 2), "tick_s_1k": round(tick_seconds(spark, 1000), 3), "tick_s_100k": round(tick_seconds(spark, 100_000), 3)}
    print(json.dumps({"metric": "total median seconds of headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(SF_DIR.rstrip("/")), **more}))


if __name__ == "__main__":
    main()
