"""Registered queries over the given tables and the DuckDB SQL for each."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import text as tx
from .functions import vclock
from .functions.aggregates import Avg, Count, Sum, Union, UserAggregate
from .operators.relation import LINEAGE, Relation
from .plans import debugger, patterns
from .plans.blackbox import BlackBoxes
from .plans.debugger import closure
from .plans.program import Executor, Program, deliver
from .sources.history import History, MemoryHistory, as_of, intervals
from .sources.shared import shared_dir, written
from .streaming.run import run_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with its SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _read(spark: SparkSession, d: str, name: str, *cols: str) -> Relation:
    df = spark.read.parquet(f"{d}/{name}.parquet")
    return Relation.of(df.selectExpr(*cols) if cols else df)


# ---- relational algebra


@query("""SELECT n.n_name AS nation, sum(CAST(round(l_extendedprice * (1 - l_discount) * 10000) AS BIGINT))::BIGINT AS revenue
FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey JOIN nation n ON c_nationkey = n_nationkey GROUP BY 1""")
def revenue_per_nation(spark, d):
    c = _read(spark, d, "customer", "c_custkey", "c_nationkey")
    o = _read(spark, d, "orders", "o_custkey", "o_orderkey")
    line = _read(spark, d, "lineitem", "l_orderkey", "cast(round(l_extendedprice * (1 - l_discount) * 10000) as bigint) as revenue")
    n = _read(spark, d, "nation", "n_nationkey", "n_name")
    sums = c.hash_join(o, [0], [0]).hash_join(line, [3], [0]).group_by([1], Sum(5))
    return sums.hash_join(n, [0], [0]).project(3, 1).named("nation", "revenue").df


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def scan_collection(spark, d):
    src = _read(spark, d, "nation", "n_nationkey", "n_name", "n_regionkey")
    node = Program(spark, "scan").table("t", [("n_nationkey", "int"), ("n_name", "string"), ("n_regionkey", "int")]).rules(lambda c: [c.t.merge(src)]).start()
    node.tick()
    return node["t"].scan().df


@query("SELECT o_orderkey, o_orderstatus FROM orders")
def scan_iterable(spark, d):
    return _read(spark, d, "orders", "o_orderkey", "o_orderstatus").df


@query("SELECT l_orderkey * 10 + l_linenumber AS line, CAST(l_quantity AS INTEGER) + 1 AS quantity FROM lineitem")
def map_expr(spark, d):
    return _read(spark, d, "lineitem", "l_orderkey", "l_linenumber", "cast(l_quantity as int) as l_quantity").map(lambda r: [r.l_orderkey * 10 + r[1], r[2] + 1], ["line", "quantity"]).df


@query("SELECT l_orderkey, l_returnflag || '/' || l_linestatus AS flags, l_linenumber * 2 AS twice FROM lineitem")
def map_udf(spark, d):
    return _read(spark, d, "lineitem", "l_orderkey", "l_returnflag", "l_linestatus", "l_linenumber").map_udf(lambda k, r, s, n: (k, f"{r}/{s}", 2 * n), "l_orderkey bigint, flags string, twice int").df


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey % 2 = 0 AND l_linenumber % 2 = 0")
def filter_expr(spark, d):
    return _read(spark, d, "lineitem", "l_orderkey", "l_linenumber").filter(lambda r: (r[0] % 2 == 0) & (r[1] % 2 == 0)).df


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_orderkey + l_linenumber) % 3 = 0")
def filter_udf(spark, d):
    return _read(spark, d, "lineitem", "l_orderkey", "l_linenumber").filter_udf(lambda k, n: (k + n) % 3 == 0).df


@query("SELECT p_size AS a, p_partkey AS b, p_size AS c FROM part")
def project_reorder_repeat(spark, d):
    return _read(spark, d, "part", "p_partkey", "p_name", "p_size").project(2, 0, 2).named("a", "b", "c").df


@query("SELECT r_name, n_name FROM region, nation")
def cross(spark, d):
    return _read(spark, d, "region", "r_name").cross(_read(spark, d, "nation", "n_name")).df


@query("SELECT r_name, n_name FROM region, nation WHERE r_regionkey < n_regionkey")
def cross_theta(spark, d):
    return _read(spark, d, "region").cross(_read(spark, d, "nation")).filter(lambda r: r.r_regionkey < r.n_regionkey).project(1, 3).df


@query("SELECT l_orderkey, l_linenumber, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def join_single(spark, d):
    return _read(spark, d, "lineitem", "l_orderkey", "l_linenumber").hash_join(_read(spark, d, "orders", "o_orderkey", "o_custkey"), [0], [0]).project(0, 1, 3).df


@query("SELECT a.l_orderkey, a.l_linenumber, b.l_partkey FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber")
def join_multi_key(spark, d):
    a, b = _read(spark, d, "lineitem", "l_orderkey", "l_linenumber"), _read(spark, d, "lineitem", "l_linenumber", "l_orderkey", "l_partkey")
    return a.hash_join(b, [0, 1], [1, 0]).project(0, 1, 4).df


@query("SELECT c_custkey, o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey AND c_custkey = o_orderkey")
def join_repeated_key(spark, d):
    return _read(spark, d, "customer", "c_custkey").hash_join(_read(spark, d, "orders", "o_custkey", "o_orderkey"), [0, 0], [0, 1]).project(0, 2).df


@query("SELECT s_nationkey, s_name, n_nationkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def join_keeps_both_keys(spark, d):
    return _read(spark, d, "supplier", "s_nationkey", "s_name").hash_join(_read(spark, d, "nation", "n_nationkey", "n_name"), [0], [0]).df


@query("SELECT l_suppkey, sum(l_orderkey)::BIGINT AS total FROM lineitem GROUP BY 1")
def agg_sum(spark, d):
    return _read(spark, d, "lineitem", "l_suppkey", "l_orderkey").group_by([0], Sum(1)).named("l_suppkey", "total").df


@query("SELECT l_returnflag, l_linestatus, count(*)::BIGINT AS n FROM lineitem GROUP BY ALL")
def agg_count(spark, d):
    return _read(spark, d, "lineitem", "l_returnflag", "l_linestatus", "l_partkey").group_by([0, 1], Count(2, 2)).named("l_returnflag", "l_linestatus", "n").df


@query("SELECT o_orderpriority, round(avg(o_custkey), 6) AS mean FROM orders GROUP BY 1")
def agg_avg(spark, d):
    return _read(spark, d, "orders", "o_orderpriority", "o_custkey").group_by([0], Avg(1)).map(lambda r: [r[0], F.round(r[1], 6)], ["o_orderpriority", "mean"]).df


@query("SELECT l_returnflag, (sum(l_partkey) + sum(l_suppkey) + sum(l_partkey))::BIGINT AS total FROM lineitem GROUP BY 1")
def agg_sum_variadic(spark, d):
    return _read(spark, d, "lineitem", "l_returnflag", "l_partkey", "l_suppkey").group_by([0], Sum(1, 2, 1)).named("l_returnflag", "total").df


@query("SELECT l_returnflag, round((sum(l_partkey) + sum(l_suppkey)) / (2.0 * count(*)), 6)::DOUBLE AS mean FROM lineitem GROUP BY 1")
def agg_avg_variadic(spark, d):
    return _read(spark, d, "lineitem", "l_returnflag", "l_partkey", "l_suppkey").group_by([0], Avg(1, 2)).map(lambda r: [r[0], F.round(r[1], 6)], ["l_returnflag", "mean"]).df


@query("SELECT o_custkey, count(*)::BIGINT AS n FROM orders GROUP BY 1")
def agg_count_no_cols(spark, d):
    return _read(spark, d, "orders", "o_custkey").group_by([0], Count()).named("o_custkey", "n").df


@query("""SELECT s_nationkey, len(list_distinct(flatten(list([s_suppkey % 7, s_suppkey % 5]))))::INTEGER AS n,
array_to_string(list_sort(list_distinct(flatten(list([s_suppkey % 7, s_suppkey % 5])))), ',') AS members FROM supplier GROUP BY 1""")
def agg_union_sets(spark, d):
    r = _read(spark, d, "supplier", "s_nationkey", "array(s_suppkey % 7) as a", "array(s_suppkey % 5) as b").group_by([0], Union(1, 2))
    return r.map(lambda r: [r[0], F.size(r[1]), F.array_join(F.transform(r[1], lambda x: x.cast("string")), ",")], ["s_nationkey", "n", "members"]).df


@query("SELECT sum(l_linenumber::BIGINT)::BIGINT AS total, count(*)::BIGINT AS n FROM lineitem")
def agg_no_keys(spark, d):
    return _read(spark, d, "lineitem", "cast(l_linenumber as bigint) as x").group_by([], Sum(0), Count()).named("total", "n").df


@query("SELECT sum(l_orderkey)::BIGINT AS total FROM lineitem WHERE l_linenumber < 0 HAVING count(*) > 0")
def agg_no_keys_empty(spark, d):
    return _read(spark, d, "lineitem", "l_orderkey", "l_linenumber").filter(lambda r: r[1] < 0).group_by([], Sum(0)).named("total").df


@query("SELECT DISTINCT l_shipdate::DATE AS day, l_returnflag FROM lineitem")
def agg_keys_only(spark, d):
    return _read(spark, d, "lineitem", "cast(l_shipdate as date) as day", "l_returnflag").group_by([0, 1]).df


@query("SELECT l_suppkey, max(l_partkey) - min(l_partkey) AS spread FROM lineitem GROUP BY 1")
def agg_user_defined(spark, d):
    spread = UserAggregate("Spread", (1,), lambda x: F.max(x) - F.min(x))
    return _read(spark, d, "lineitem", "l_suppkey", "l_partkey").group_by([0], spread).named("l_suppkey", "spread").df


@query("SELECT word, count(*)::BIGINT AS n FROM (SELECT unnest(string_split(text, ' ')) AS word FROM documents) WHERE word <> '' GROUP BY 1")
def flat_map_explode(spark, d):
    return _read(spark, d, "documents", "text").flat_map(lambda r: tx.split_words(r.text), ["word"]).group_by([0], Count()).named("word", "n").df


@query("""SELECT doc_id, len(list_filter(string_split(text, ' '), lambda x: x <> ''))::INTEGER AS pieces, length(regexp_replace(replace(text, chr(10), ' '), ' +', ' ', 'g'))::INTEGER AS crunched,
array_to_string([lang, source], ', ') AS joined FROM documents""")
def text_helpers(spark, d):
    r = _read(spark, d, "documents", "doc_id", "text", "lang", "source")
    return r.map(lambda r: [r[0], F.size(tx.split_words(r.text)), F.length(tx.crunch_whitespace(r.text)), tx.join_words(F.array(r.lang, r.source))], ["doc_id", "pieces", "crunched", "joined"]).df


@query("SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END AS code FROM lineitem WHERE l_returnflag IN ('A', 'N', 'R')")
def iterable_constant(spark, d):
    """A constant relation, read anew at each evaluation, joined with a table."""
    codes = Relation.iterable(spark, lambda: [("A", 1), ("N", 2), ("R", 3)], "flag string, code int")
    return _read(spark, d, "lineitem", "l_returnflag", "l_orderkey", "l_linenumber").hash_join(codes, [0], [0]).project(1, 2, 4).df


@query("SELECT l_suppkey, (max(l_partkey) - min(l_partkey))::BIGINT AS spread FROM lineitem GROUP BY 1")
def agg_pandas_udaf(spark, d):
    """A user's aggregate as a grouped pandas function."""

    def spread(x):
        return int(x.max() - x.min())

    spread.__annotations__ = {"x": pd.Series, "return": int}
    return _read(spark, d, "lineitem", "l_suppkey", "l_partkey").group_by([0], UserAggregate("Spread", (1,), F.pandas_udf(spread, "bigint"))).named("l_suppkey", "spread").df


@query("SELECT s_suppkey, i AS step, s_suppkey * i AS times FROM supplier, range(7) r(i) WHERE i < s_suppkey % 7")
def flat_map_udf(spark, d):
    """A Python function of a row to any number of rows."""
    return _read(spark, d, "supplier", "s_suppkey").flat_map_udf(lambda k: [(k, i, k * i) for i in range(k % 7)], "s_suppkey bigint, step bigint, times bigint").df


@query("SELECT count(*)::BIGINT AS n, count(*)::BIGINT AS ids, true AS in_range, true AS alphanumeric, true AS both_signs FROM orders")
def random_helpers(spark, d):
    """Random ids do not collide, other random values keep to their range."""
    r = spark.read.parquet(f"{d}/orders.parquet").select(tx.random_id(7).alias("id"), tx.rand_int(3, 9, 7).alias("i"), tx.random_alphanum(12, 7).alias("s"))
    return r.agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"), F.bool_and(F.col("i").between(3, 8)).alias("in_range"), F.bool_and(F.col("s").rlike("^[A-Za-z0-9]{12}$")).alias("alphanumeric"), ((F.min("id") < 0) & (F.max("id") > 0)).alias("both_signs"))


# ---- rules and ticks


def _orders(spark: SparkSession, d: str) -> Relation:
    return _read(spark, d, "orders", "o_custkey", "o_orderstatus")


KV = [("k", "bigint"), ("v", "string")]


@query("SELECT DISTINCT o_custkey AS k, o_orderstatus AS v FROM orders")
def rule_merge_set(spark, d):
    src = _orders(spark, d)
    node = Program(spark, "set").table("t", KV).rules(lambda c: [c.t <= src, c.t <= src]).start()
    node.tick()
    return node["t"].df


@query("SELECT DISTINCT o_custkey + 1 AS k, o_orderstatus AS v FROM orders")
def rule_sequential_visibility(spark, d):
    """What the first rule merges, the second reads in the same tick."""
    src = _orders(spark, d)
    node = Program(spark, "seq").table("t", KV).table("u", KV).rules(lambda c: [c.t.merge(src), c.u.merge(lambda now: c.t.scan().map(lambda r: [r[0] + 1, r[1]]))]).start()
    node.tick()
    return node["u"].df


@query("""WITH s AS (SELECT DISTINCT o_custkey AS k FROM orders) SELECT DISTINCT k + i AS k FROM s, range(3) r(i)""")
def rule_self_snapshot(spark, d):
    """t <= t + 1 sees t as it stood before: one step a tick."""
    src = _read(spark, d, "orders", "o_custkey")
    node = Program(spark, "self").table("t", [("k", "bigint")]).bootstrap(lambda c: [c.t.merge(src)]).rules(lambda c: [c.t.merge(lambda now: c.t.scan().map(lambda r: [r[0] + 1]))]).start()
    node.bootstrap_tick()
    node.tick()
    node.tick()
    return node["t"].df


@query("""WITH s AS (SELECT DISTINCT o_custkey AS k, o_orderstatus AS v FROM orders) SELECT 'later' AS at, k, v FROM s UNION ALL SELECT 'seen', k, v FROM s""")
def rule_deferred_merge(spark, d):
    """+= shows at the tick: a copy made in the first tick is empty, in the second it is not."""
    src = _orders(spark, d)
    node = Program(spark, "later").table("t", KV).table("seen", KV).rules(lambda c: [c.t.merge_later(src), c.seen.merge(lambda now: c.t.scan())]).start()
    node.tick()
    first = node["seen"].df.withColumn("at", F.lit("early"))
    node.tick()
    return first.unionByName(node["seen"].df.withColumn("at", F.lit("seen"))).unionByName(node["t"].df.withColumn("at", F.lit("later"))).select("at", "k", "v")


@query("SELECT DISTINCT o_custkey AS k, o_orderstatus AS v FROM orders WHERE o_orderstatus <> 'F'")
def rule_deferred_delete(spark, d):
    src = _orders(spark, d)
    node = Program(spark, "del").table("t", KV).rules(lambda c: [c.t.merge(src), c.t.delete_later(lambda now: c.t.scan().filter(lambda r: r.v == "F"))]).start()
    node.tick()
    return node["t"].df


@query("SELECT DISTINCT o_custkey AS k, o_orderstatus AS v FROM orders WHERE o_orderstatus = 'O'")
def rule_merge_then_delete(spark, d):
    """A tuple that is both merged and deleted in a tick goes."""
    src = _orders(spark, d)
    node = Program(spark, "both").table("t", KV).rules(lambda c: [c.t.merge_later(src), c.t.delete_later(src.filter(lambda r: r[1] != "O"))]).start()
    node.tick()
    return node["t"].df


@query("SELECT 'kept' AS what, count(*)::BIGINT AS n FROM (SELECT DISTINCT o_custkey, o_orderstatus FROM orders) UNION ALL SELECT 'scratch', 0")
def scratch_cleared(spark, d):
    src = _orders(spark, d)
    node = Program(spark, "scratch").table("t", KV).scratch("s", KV).rules(lambda c: [c.s.merge(src), c.t.merge(lambda now: c.s.scan())]).start()
    node.tick()
    count = lambda name, what: node[name].df.agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "n")
    return count("t", "kept").unionByName(count("s", "scratch"))


@query("SELECT c_custkey AS k, t AS time FROM customer, (VALUES (1), (3), (5)) v(t)")
def meta_collection(spark, d):
    """A tuple carries the time of each insertion: three ticks, three rows."""
    src = _read(spark, d, "customer", "c_custkey")
    node = Program(spark, "meta").table("t", [("k", "bigint")]).rules(lambda c: [c.t.merge(src)]).start()
    for _ in range(3):
        node.tick()
    return node["t"].meta().map(lambda r: [r.tuple["k"], r.id["time"]], ["k", "time"]).df


@query("SELECT DISTINCT c_mktsegment AS v, t AS time FROM customer, (VALUES (1), (3)) v(t)")
def logical_time(spark, d):
    src = _read(spark, d, "customer", "c_mktsegment")
    node = Program(spark, "clock").table("t", [("v", "string"), ("time", "int")]).rules(lambda c: [c.t.merge(lambda now: src.map(lambda r: [r[0], F.lit(now)]))]).start()
    node.tick()
    node.tick()
    return node["t"].df


@query("""WITH e AS (SELECT event_id AS a, lead(event_id, 1) OVER w AS b1, lead(event_id, 2) OVER w AS b2, lead(event_id, 3) OVER w AS b3, lead(event_id, 4) OVER w AS b4 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT a, b FROM (SELECT a, unnest([b1, b2, b3, b4]) AS b FROM e) WHERE b IS NOT NULL""")
def closure_by_ticks(spark, d):
    """Paths over successor pairs of a user's events; recursion goes one step further each tick."""
    ev = spark.read.parquet(f"{d}/events.parquet")
    nxt = ev.select("event_id", F.lead("event_id").over(Window.partitionBy("user_id").orderBy("event_id")).alias("b")).where("b is not null")
    src, pair = Relation.of(nxt), [("a", "bigint"), ("b", "bigint")]
    step = lambda c: c.path.scan().hash_join(c.edge.scan(), [1], [0]).project(0, 3)
    node = Program(spark, "paths").table("edge", pair).table("path", pair).bootstrap(lambda c: [c.edge.merge(src), c.path.merge(src)]).rules(lambda c: [c.path.merge(lambda now: step(c))]).start()
    node.bootstrap_tick()
    for _ in range(3):
        node.tick()
    return node["path"].df


@query("SELECT n_name, i AS id, 1000 * (i + 1) AS ms, 'p' AS timer FROM nation, range(3) r(i) UNION ALL SELECT n_name, 0, 3000, 'q' FROM nation")
def periodic_timers(spark, d):
    """Two timers: a row for each period that has passed, gone at the tick; each meets a table while it is there."""
    names, cols = _read(spark, d, "nation", "n_name"), [("n_name", "string"), ("id", "bigint"), ("at", "timestamp"), ("timer", "string")]
    row = lambda name: lambda r: [r[2], r[0], r[1], F.lit(name)]
    node = Program(spark, "timers").table("nation", [("n_name", "string")]).table("seen", cols).periodic("p", 1000).periodic("q", 3000).bootstrap(lambda c: [c.nation.merge(names)])
    node = node.rules(lambda c: [c.seen.merge(lambda now, t=t: getattr(c, t).scan().cross(c.nation.scan()).map(row(t))) for t in ("p", "q")]).start()
    node.run([500, 1000, 3100])
    return node["seen"].df.select("n_name", "id", F.unix_millis("at").alias("ms"), "timer")


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


@query("SELECT upper(p_name) AS line, 'now' AS told FROM part WHERE p_size > 25 GROUP BY 1 UNION ALL SELECT lower(p_name), 'later' FROM part GROUP BY 1")
def stdin_stdout(spark, d):
    """Lines that come in are printed at once by one rule and at the tick by another."""
    lines = _read(spark, d, "part", "concat(p_size, ' ', p_name) as stdin")
    sized = lambda c: c.stdin.scan().map(lambda r: [F.substring_index(r[0], " ", 1).cast("int"), F.regexp_replace(r[0], "^[0-9]+ ", "")], ["size", "name"])
    at = _folder(spark, "stdout")
    node = Program(spark, "lines").stdin().stdout(at).rules(lambda c: [c.stdout.merge(lambda now: sized(c).filter(lambda r: r[0] > 25).map(lambda r: [F.concat(F.lit("now "), F.upper(r[1]))])), c.stdout.merge_later(lambda now: sized(c).map(lambda r: [F.concat(F.lit("later "), F.lower(r[1]))]))]).start()
    node.run([("stdin", lines.df)])
    said = spark.read.text(at)
    return said.select(F.regexp_replace("value", "^[a-z]+ ", "").alias("line"), F.substring_index("value", " ", 1).alias("told"))


@query("SELECT 'chat' AS via, o_orderpriority AS text, count(*)::BIGINT AS n FROM orders GROUP BY 2 UNION ALL SELECT 'timer', 'tick', 2")
def run_loop(spark, d):
    """The loop of a node: bootstrap, then receipts, lines and timers, a tick after each."""
    src = _read(spark, d, "orders", "'n' as addr", "o_orderkey as id", "o_orderpriority as text")
    cols = [("id", "bigint"), ("text", "string"), ("via", "string")]
    node = Program(spark, "n").channel("ch", [("addr", "string"), ("id", "bigint"), ("text", "string")]).periodic("p", 10).stdin().table("seen", cols).table("on", [("x", "int")])
    node = node.bootstrap(lambda c: [c.on.merge(Relation.iterable(spark, [(1,)], "x int"))]).rules(
        lambda c: [
            c.seen.merge(lambda now: c.ch.scan().cross(c.on.scan()).map(lambda r: [r[1], r[2], F.lit("chat")])),
            c.seen.merge(lambda now: c.p.scan().map(lambda r: [r[0], F.lit("tick"), F.lit("timer")])),
        ]
    ).start()
    half = lambda k: src.filter(lambda r: r[1] % 2 == k).df
    node.run([("ch", half(0)), 10, ("ch", half(1)), 20])
    return node["seen"].scan().group_by([2, 1], Count()).named("via", "text", "n").df


# ---- programs


@query("SELECT 'client' || (o_orderkey % 10) AS addr, o_orderkey AS id, c_name AS value FROM orders JOIN customer ON o_custkey = c_custkey")
def kvs_program(spark, d):
    """The rules-only key-value store: customers are set, then each order gets its customer's name."""
    sets = _read(spark, d, "customer", "'server' as dst", "'loader' as src", "c_custkey as id", "cast(c_custkey as string) as k", "c_name as v")
    gets = _read(spark, d, "orders", "'server' as dst", "concat('client', o_orderkey % 10) as src", "o_orderkey as id", "cast(o_custkey as string) as k")
    node = kvs(spark).start()
    node.receive("set_request", sets.df)
    node.tick()
    node.receive("get_request", gets.df)
    node.tick()
    out = [df for name, _, df in node.take_sent() if name == "get_response"]
    return out[-1]


def kvs(spark: SparkSession) -> Program:
    head = [("dst_addr", "string"), ("src_addr", "string"), ("id", "bigint")]
    p = Program(spark, "server").table("kvs", [("key", "string"), ("value", "string")])
    p.channel("set_request", [*head, ("key", "string"), ("value", "string")]).channel("set_response", [("addr", "string"), ("id", "bigint")])
    p.channel("get_request", [*head, ("key", "string")]).channel("get_response", [("addr", "string"), ("id", "bigint"), ("value", "string")])
    return p.rules(
        lambda c: [
            c.get_response.merge(lambda now: c.kvs.scan().hash_join(c.get_request.scan(), [0], [3]).project(3, 4, 1)),
            c.kvs.delete_later(lambda now: c.kvs.scan().hash_join(c.set_request.scan(), [0], [3]).project(0, 1)),
            c.kvs.merge_later(lambda now: c.set_request.scan().project(3, 4)),
            c.set_response.merge(lambda now: c.set_request.scan().project(1, 2)),
        ]
    )


@query("SELECT DISTINCT s_name AS addr, n_name || ' joined' AS msg FROM supplier, nation")
def chat_multicast(spark, d):
    """Members are suppliers; each message is sent on to every member."""
    node = Program(spark, "chat").table("nodelist", [("client", "string"), ("nick", "string")]).channel("connect", [("server", "string"), ("client", "string"), ("nick", "string")]).channel("mcast", [("addr", "string"), ("msg", "string")])
    node = node.rules(lambda c: [c.nodelist.merge(lambda now: c.connect.scan().project(1, 2)), c.mcast.merge(lambda now: c.mcast.scan().cross(c.nodelist.scan()).project(2, 1))]).start()
    node.receive("connect", _read(spark, d, "supplier", "'chat' as server", "s_name as client", "s_name as nick").df)
    node.tick()
    node.receive("mcast", _read(spark, d, "nation", "'chat' as addr", "concat(n_name, ' joined') as msg").df)
    node.tick()
    return node.take_sent()[-1][2]


HEAD = [("dst_addr", "string"), ("src_addr", "string"), ("id", "bigint")]


@query("SELECT 'client' || (o_orderkey % 10) AS addr, o_orderkey AS id, CASE WHEN o_custkey % 2 = 0 THEN c_name ELSE '' END AS value FROM orders JOIN customer ON o_custkey = c_custkey")
def kvs_black_box(spark, d):
    """A store outside the program, of which rules see only what a service answers; an absent key reads as the empty string."""
    store = written(spark.read.parquet(f"{d}/customer.parquet").where("c_custkey % 2 = 0").select(F.col("c_custkey").cast("string").alias("k"), "c_name"), "store")
    answer = lambda df: df.join(store, F.col("key") == F.col("k"), "left").select(F.col("src_addr").alias("addr"), "id", F.coalesce("c_name", F.lit("")).alias("value"))
    node = Program(spark, "kvs").channel("get_request", [*HEAD, ("key", "string")]).channel("get_response", [("addr", "string"), ("id", "bigint"), ("value", "string")])
    node = node.rules(lambda c: [c.get_response.merge(lambda now: Relation.of(answer(c.get_request.df)))]).start()
    node.receive("get_request", _read(spark, d, "orders", "'kvs' as dst", "concat('client', o_orderkey % 10) as src", "o_orderkey as id", "cast(o_custkey as string) as k").df)
    node.tick()
    return node.take_sent()[0][2]


@query("SELECT DISTINCT c_name AS line FROM customer WHERE c_custkey % 3 = 0")
def kvs_command_line(spark, d):
    """SET and GET lines are split and sent to the store; its answers are printed. Other lines are ignored."""
    at = _folder(spark, "stdout")
    parts = lambda c, n, word: c.split.scan().filter(lambda r: (F.size(r[0]) == n) & (F.get(r[0], F.lit(0)) == word))
    part = lambda r, i: F.get(r[0], F.lit(i))
    to = lambda r: [F.lit("server"), F.lit("client"), tx.tuple_hash(r[0])]
    client = Program(spark, "client").stdin().stdout(at).scratch("split", [("parts", "array<string>")]).channel("get_request", [*HEAD, ("key", "string")]).channel("set_request", [*HEAD, ("key", "string"), ("value", "string")])
    client = client.channel("get_response", [("addr", "string"), ("id", "bigint"), ("value", "string")]).rules(
        lambda c: [
            c.split.merge(lambda now: c.stdin.scan().map(lambda r: [tx.split_words(r[0])])),
            c.get_request.merge(lambda now: parts(c, 2, "GET").map(lambda r: [*to(r), part(r, 1)])),
            c.set_request.merge(lambda now: parts(c, 3, "SET").map(lambda r: [*to(r), part(r, 1), part(r, 2)])),
            c.stdout.merge(lambda now: c.get_response.scan().project(2)),
        ]
    ).start()
    server = kvs(spark).start()
    lines = _read(spark, d, "customer", "concat('SET  k', c_custkey, ' ', replace(c_name, ' ', '_')) as line", "concat('GET k', c_custkey) as ask", "c_custkey")
    for rows in (lines.project(0).df, lines.filter(lambda r: r[2] % 3 == 0).project(1).df.unionByName(lines.map(lambda r: [F.concat(F.lit("PUT k"), r[2])], ["ask"]).df)):
        client.receive("stdin", rows.toDF("stdin"))
        client.tick()
        deliver(client, [server])
        server.tick()
    for name, _, rows in server.take_sent():
        if name == "get_response":
            client.receive(name, rows)
    client.tick()
    return spark.read.text(at).select(F.col("value").alias("line"))


@query("SELECT DISTINCT n_name AS line FROM nation")
def chat_client(spark, d):
    """A client joins, sends its lines, and prints what the server sends to all members."""
    at = _folder(spark, "stdout")
    connect, mcast = [("server", "string"), ("client", "string"), ("nick", "string")], [("addr", "string"), ("msg", "string")]
    server = Program(spark, "chat").table("nodelist", [("client", "string"), ("nick", "string")]).channel("connect", connect).channel("mcast", mcast)
    server = server.rules(lambda c: [c.nodelist.merge(lambda now: c.connect.scan().project(1, 2)), c.mcast.merge(lambda now: c.mcast.scan().cross(c.nodelist.scan()).project(2, 1))]).start()
    client = Program(spark, "me").stdin().stdout(at).channel("connect", connect).channel("mcast", mcast).bootstrap(lambda c: [c.connect.merge(Relation.iterable(spark, [("chat", "me", "nick")], "s string, c string, n string"))])
    client = client.rules(lambda c: [c.mcast.merge(lambda now: c.stdin.scan().map(lambda r: [F.lit("chat"), r[0]])), c.stdout.merge(lambda now: c.mcast.scan().project(1))]).start()
    client.bootstrap_tick()
    deliver(client, [server])
    server.tick()
    client.receive("stdin", _read(spark, d, "nation", "n_name").df)
    client.tick()
    deliver(client, [server])
    server.tick()
    deliver(server, [client])
    client.tick()
    return spark.read.text(at).select(F.col("value").alias("line"))


@query("SELECT s_name AS addr, 'ping ' || i AS msg FROM supplier, range(3) r(i)")
def ping_client(spark, d):
    """A client that sends a message each period; the server passes them on to all members."""
    mcast = [("addr", "string"), ("msg", "string")]
    server = Program(spark, "chat").table("nodelist", [("client", "string")]).channel("mcast", mcast).bootstrap(lambda c: [c.nodelist.merge(_read(spark, d, "supplier", "s_name"))])
    server = server.rules(lambda c: [c.mcast.merge(lambda now: c.mcast.scan().cross(c.nodelist.scan()).project(2, 1))]).start()
    client = Program(spark, "ping").periodic("p", 1000).channel("mcast", mcast).rules(lambda c: [c.mcast.merge(lambda now: c.p.scan().map(lambda r: [F.lit("chat"), F.concat(F.lit("ping "), r[0].cast("string"))]))]).start()
    server.bootstrap_tick()
    client.run([1000, 2500, 3000])
    deliver(client, [server])
    server.tick()
    return server.take_sent()[-1][2]


@query("""WITH m AS (SELECT max(CASE WHEN user_id % 3 = 0 THEN event_id END)::INTEGER AS a, max(CASE WHEN user_id % 3 = 1 THEN event_id END)::INTEGER AS b, max(CASE WHEN user_id % 3 = 2 THEN event_id END)::INTEGER AS c FROM events)
SELECT 'r0' AS node, '10,' || b || ',' || c AS clock FROM m UNION ALL SELECT 'r1', a || ',10,' || c FROM m UNION ALL SELECT 'r2', a || ',' || b || ',10' FROM m""")
def gossip_clocks(spark, d):
    """Three replicas send their clocks to one another; each takes the elementwise maximum and sets its own slot to its time."""
    ev = spark.read.parquet(f"{d}/events.parquet")
    clock = [("clock", "array<int>")]

    def replica(i: int) -> Executor:
        own = ev.where(F.col("user_id") % 3 == i).agg(F.max("event_id").cast("int").alias("e"))
        start = Relation.of(own.select(vclock.with_slot(F.array(*[F.lit(0)] * 3), i, F.col("e")).alias("clock")))
        p = Program(spark, f"r{i}").table("clock", clock).channel("merge", [("addr", "string"), *clock]).bootstrap(lambda c: [c.clock.merge(start)])
        to = lambda c: Relation.iterable(spark, [(f"r{k}",) for k in range(3) if k != i], "addr string").cross(c.clock.scan())
        both = lambda c: c.merge.scan().cross(c.clock.scan())
        all_ = UserAggregate("Max", (1, 2), lambda a, b: F.array(*[F.max(F.greatest(F.get(a, F.lit(k)), F.get(b, F.lit(k)))) for k in range(3)]))
        rules = lambda c: [
            c.merge.merge(lambda now: to(c)),
            c.clock.delete_later(lambda now: both(c).project(2)),
            c.clock.merge_later(lambda now: both(c).group_by([], all_).map(lambda r: [vclock.with_slot(r[0], i, now)])),
        ]
        return p.rules(rules).start()

    nodes = [replica(i) for i in range(3)]
    for n in nodes:
        n.bootstrap_tick()
        n.tick()
    sent = [(n, n.take_sent()) for n in nodes]
    for n in nodes:
        rows = [df.where(F.col("addr") == n.address) for m, out in sent if m is not n for _, _, df in out]
        n.receive("merge", rows[0].unionByName(rows[1]))
        n.tick()
    out = [n["clock"].df.select(F.lit(n.name).alias("node"), F.array_join(F.transform("clock", lambda x: x.cast("string")), ",").alias("clock")) for n in nodes]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("""SELECT 'c' AS addr, p_partkey AS id, p_size > 1 AND NOT list_contains(list_transform(range(2, p_size), lambda x: p_size % x = 0), true) AS is_prime FROM part""")
def primality_service(spark, d):
    """A service whose answers come from a Python function of the request."""
    head = [("dst_addr", "string"), ("src_addr", "string"), ("id", "bigint")]
    node = Program(spark, "prime").channel("request", [*head, ("x", "int")]).channel("response", [("addr", "string"), ("id", "bigint"), ("is_prime", "boolean")])
    node = node.rules(lambda c: [c.response.merge(lambda now: c.request.scan().map_udf(lambda dst, src, i, x: (src, i, x > 1 and all(x % y for y in range(2, x))), "addr string, id bigint, is_prime boolean", impure=True))]).start()
    node.receive("request", _read(spark, d, "part", "'prime' as dst", "'c' as src", "p_partkey as id", "p_size as x").df)
    node.tick()
    return node.take_sent()[0][2]


@query("""SELECT 'pong' AS node, o_orderkey AS x FROM orders UNION ALL SELECT 'ping', o_orderkey FROM orders""")
def ping_pong(spark, d):
    """Two nodes send all tuples of a channel back and forth; each receipt is kept with its node."""
    def node(name: str, other: str) -> Program:
        p = Program(spark, name).channel("c", [("addr", "string"), ("x", "bigint")]).table("got", [("x", "bigint")])
        return p.rules(lambda c: [c.got.merge(lambda now: c.c.scan().project(1)), c.c.merge(lambda now: c.c.scan().map(lambda r: [F.lit(other), r[1]]))])

    src = _read(spark, d, "orders", "'pong' as addr", "o_orderkey as x")
    ping = node("ping", "pong").bootstrap(lambda c: [c.c.merge(src)]).start()
    pong = node("pong", "ping").start()
    ping.bootstrap_tick()
    for a, b in ((ping, pong), (pong, ping)):
        deliver(a, [b])
        b.tick()
    return pong["got"].df.withColumn("node", F.lit("pong")).unionByName(ping["got"].df.withColumn("node", F.lit("ping"))).select("node", "x")


# ---- provenance


def _stored(spark: SparkSession, node: str, src: Relation, columns: list[tuple[str, str]], name: str = "t") -> Executor:
    p = Program(spark, node).table(name, columns).rules(lambda c: [getattr(c, name).merge(src)]).start()
    p.tick()
    return p


@query("SELECT o_orderkey, c_custkey, 'customer' AS collection FROM orders JOIN customer ON o_custkey = c_custkey UNION ALL SELECT o_orderkey, c_custkey, 'orders' FROM orders JOIN customer ON o_custkey = c_custkey")
def lineage_join(spark, d):
    """A joined row comes from one tuple of each side."""
    node = Program(spark, "lj").table("customer", [("c", "bigint")]).table("orders", [("o", "bigint"), ("c", "bigint")])
    c, o = _read(spark, d, "customer", "c_custkey"), _read(spark, d, "orders", "o_orderkey", "o_custkey")
    node = node.rules(lambda x: [x.customer.merge(c), x.orders.merge(o)]).start()
    node.tick()
    j = node["orders"].scan().hash_join(node["customer"].scan(), [1], [0]).with_lineage
    return j.select(F.col("c0").alias("o_orderkey"), F.col("c2").alias("c_custkey"), F.explode(LINEAGE).alias("id")).select("o_orderkey", "c_custkey", F.col("id.collection").alias("collection"))


@query("SELECT c_nationkey, c_custkey FROM customer")
def lineage_group_by(spark, d):
    """A group comes from all its tuples; ids lead back to their keys."""
    node = _stored(spark, "lg", _read(spark, d, "customer", "c_custkey", "c_nationkey"), [("c_custkey", "bigint"), ("c_nationkey", "int")])
    g = node["t"].scan().group_by([1], Count()).lineage.select(F.col("c0").alias("nation"), F.col("_id.hash").alias("of"))
    return g.join(node["t"].state, F.col("of") == F.col("_hash")).select(F.col("nation").alias("c_nationkey"), "c_custkey")


def _log(spark: SparkSession, d: str) -> DataFrame:
    """Events as a log of one relation of users: errors delete, all others insert."""
    ev = spark.read.parquet(f"{d}/events.parquet")
    return ev.select(F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", "D").otherwise("I").alias("op"), tx.tuple_hash(F.col("user_id")).alias("_hash"), F.col("event_id").cast("int").alias("time"), F.col("ts").alias("ptime"), "user_id")


_INTERVALS = """i AS (SELECT user_id, event_id AS time_inserted, min(CASE WHEN event_type = 'error' THEN event_id END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS time_deleted, event_type FROM events)"""


@query(f"WITH {_INTERVALS} SELECT user_id, time_inserted::INTEGER AS time_inserted, time_deleted::INTEGER AS time_deleted FROM i WHERE event_type <> 'error'")
def history_intervals(spark, d):
    return intervals(_log(spark, d)).select("user_id", "time_inserted", "time_deleted")


@query(f"WITH {_INTERVALS}, m AS (SELECT max(event_id) // 2 AS t FROM events) SELECT user_id, time_inserted::INTEGER AS time_inserted FROM i, m WHERE event_type <> 'error' AND time_inserted <= t AND (time_deleted IS NULL OR time_deleted > t)")
def history_as_of(spark, d):
    log = _log(spark, d)
    half = log.agg(F.max("time")).first()[0] // 2
    return as_of(intervals(log), half).select("user_id", "time_inserted")


_STEPS = """e AS (SELECT event_id AS a, lag(event_id) OVER w AS b, lag(event_type) OVER w AS t FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))"""


def _edges(spark: SparkSession, d: str) -> DataFrame:
    """Each event comes from its user's last one, if that was a view or click."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    e = spark.read.parquet(f"{d}/events.parquet").select("event_id", F.lag("event_id").over(w).alias("b"), F.lag("event_type").over(w).alias("t")).where("t in ('view', 'click')")
    fixed = lambda p: [F.lit("n").alias(f"{p}node"), F.lit("t").alias(f"{p}collection"), F.lit(0).alias(f"{p}time")]
    return e.select(*fixed(""), F.col("event_id").alias("hash"), *fixed("dep_"), F.col("b").alias("dep_hash"))


@query(f"WITH {_STEPS} SELECT a AS tuple, b AS dep FROM e WHERE t IN ('view', 'click')")
def backward_lineage(spark, d):
    """One step back from every tuple, through edges kept by a history."""
    ev = spark.read.parquet(f"{d}/events.parquet")
    w = Window.partitionBy("user_id").orderBy("event_id")
    src = ev.select("event_id", F.lag("event_id").over(w).alias("b"), F.lag("event_type").over(w).alias("t"))
    raw = _read(spark, d, "events", "event_id")
    prev = Relation.of(src.where("t in ('view', 'click')").select("event_id", "b"))
    history = History(spark, f"{shared_dir(spark)}/history-{spark.sparkContext.applicationId}-{id(src)}")
    p = Program(spark, "n").table("t", [("x", "bigint")]).table("p", [("a", "bigint"), ("b", "bigint")]).table("s", [("x", "bigint")])
    p = p.bootstrap(lambda c: [c.t.merge(raw), c.p.merge(prev)])
    node = p.rules(lambda c: [c.s.merge(lambda now: c.t.scan().hash_join(c.p.scan(), [0], [1]).project(1))]).start(history)
    node.bootstrap_tick()
    node.tick()
    edges = history.edges().where("collection = 's' and dep_collection = 't'")
    t, s = node["t"].state, node["s"].state
    return edges.join(s.select(F.col("_hash").alias("hash"), F.col("x").alias("tuple")), "hash").join(t.select(F.col("_hash").alias("dep_hash"), F.col("x").alias("dep")), "dep_hash").select("tuple", "dep")


@query(f"""WITH RECURSIVE {_STEPS}, s AS (SELECT max(event_id) AS x FROM events GROUP BY user_id),
c AS (SELECT x, x AS id, 0 AS steps FROM s UNION SELECT c.x, e.b, c.steps + 1 FROM c JOIN e ON e.a = c.id WHERE e.t IN ('view', 'click')) SELECT id, min(steps)::INTEGER AS steps FROM c GROUP BY 1""")
def lineage_closure(spark, d):
    """All that each user's last event comes from."""
    start = spark.read.parquet(f"{d}/events.parquet").groupBy("user_id").agg(F.max("event_id").alias("hash"))
    start = start.select(F.lit("n").alias("node"), F.lit("t").alias("collection"), "hash", F.lit(0).alias("time"))
    return closure(_edges(spark, d), start).select(F.col("hash").alias("id"), "steps")


@query(f"WITH {_STEPS} SELECT a AS tuple, b AS dep, 0 AS rule FROM e WHERE t IN ('view', 'click') AND a = (SELECT max(a) FROM e WHERE t IN ('view', 'click'))")
def backward_step(spark, d):
    """One step back from one tuple, over a history in memory."""
    src = written(_edges(spark, d).select(F.col("hash").alias("a"), F.col("dep_hash").alias("b")), "pairs")
    last = src.agg(F.max("a")).first()[0]
    history = MemoryHistory(spark)
    p = Program(spark, "n").table("t", [("x", "bigint")]).table("p", [("a", "bigint"), ("b", "bigint")]).table("s", [("x", "bigint")])
    p = p.bootstrap(lambda c: [c.t.merge(_read(spark, d, "events", "event_id")), c.p.merge(Relation.of(src))])
    node = p.rules(lambda c: [c.s.merge(lambda now: c.t.scan().hash_join(c.p.scan(), [0], [1]).project(1))]).start(history)
    node.bootstrap_tick()
    node.tick()
    of = spark.range(1).select(tx.tuple_hash(F.lit(last).cast("bigint")).alias("h")).first()[0]
    e = debugger.backward(history, "n", "s", of, node.time).where("dep_collection = 't'")
    t = node["t"].state.select(F.col("_hash").alias("dh"), F.col("x").alias("dep"))
    return e.join(t, F.col("dep_hash") == F.col("dh")).select(F.lit(last).alias("tuple"), "dep", "rule")


@query("SELECT o_orderkey AS x, 'a' AS dep_node, 1 AS dep_time, 1 AS time FROM orders UNION ALL SELECT o_orderkey, 'b', 1, 2 FROM orders")
def networked_lineage(spark, d):
    """A message comes from the same tuple in the sender's channel; what the receiver stores comes from the message."""
    history = History(spark, _folder(spark, "history"))
    src = _read(spark, d, "orders", "'b' as addr", "o_orderkey as x")
    cols = [("addr", "string"), ("x", "bigint")]
    a = Program(spark, "a").channel("c", cols).rules(lambda c: [c.c.merge(src)]).start(history)
    b = Program(spark, "b").channel("c", cols).table("got", [("x", "bigint")]).rules(lambda c: [c.got.merge(lambda now: c.c.scan().project(1))]).start(history)
    a.tick()
    deliver(a, [b])
    b.tick()
    e = history.edges().where("node = 'b'")
    rows = src.df.select("x", tx.tuple_hash(F.col("addr"), F.col("x")).alias("of")).unionByName(src.df.select("x", tx.tuple_hash(F.col("x")).alias("of")))
    return e.join(rows, F.col("hash") == F.col("of")).select("x", "dep_node", "dep_time", "time")


@query("""SELECT 'kept' AS collection, 'Table' AS kind, 2 AS n_columns, count(*)::BIGINT AS tuples, 's <= Collection(kept)' AS rule FROM (SELECT DISTINCT o_custkey, o_orderstatus FROM orders)
UNION ALL SELECT 's', 'Scratch', 2, count(*)::BIGINT, 'kept <= Iterable' FROM (SELECT DISTINCT o_custkey, o_orderstatus FROM orders)""")
def catalog(spark, d):
    """The catalog's collections with their tuples over all time, and the rules of the node, the bootstrap ones too."""
    history = History(spark, _folder(spark, "history"))
    src = _orders(spark, d)
    node = Program(spark, "n").table("kept", KV).scratch("s", KV).bootstrap(lambda c: [c.kept.merge(src)]).rules(lambda c: [c.s.merge(lambda now: c.kept.scan())]).start(history)
    node.run([])
    node.tick()
    counts = [history.history("n", c).agg(F.countDistinct("_hash").alias("tuples")).select(F.lit(c).alias("of"), "tuples") for c in ("kept", "s")]
    texts = debugger.rule_texts(history, "n").select(F.lit("kept").alias("c"), F.col("text").alias("rule")).unionByName(debugger.rule_texts(history, "n", True).select(F.lit("s").alias("c"), F.col("text").alias("rule")))
    found = debugger.collections(history, "n").join(counts[0].unionByName(counts[1]), F.col("collection") == F.col("of")).join(texts, F.col("collection") == F.col("c"))
    assert debugger.address(history, "n") == "n" and debugger.nodes(history).count() == 1
    return found.select("collection", "kind", F.size("columns").alias("n_columns"), "tuples", "rule")


@query("SELECT event_id, CASE WHEN event_id <= 3 THEN event_id - 1 ELSE 3 + (event_id - 4) % 5 END AS rule FROM events WHERE event_id > 0")
def rule_at_times(spark, d):
    """What runs at each logical time of a node with two bootstrap rules and three rules."""
    return spark.read.parquet(f"{d}/events.parquet").where("event_id > 0").select("event_id", debugger.rule_at_time(F.col("event_id"), 2, 3).alias("rule"))


# ---- lineage of opaque services


def _boxes(spark: SparkSession, d: str) -> BlackBoxes:
    """Views are answered by a store of purchases: each depends on its user's last purchase, stated in SQL or in Python."""
    view = f"store_{uuid.uuid4().hex[:12]}"
    ev = spark.read.parquet(f"{d}/events.parquet").select("event_id", "user_id", "event_type", F.xxhash64("event_id").alias("hash"), F.col("event_id").cast("int").alias("time_inserted"), F.col("ts").alias("ptime_inserted"))
    ev.createOrReplaceTempView(view)
    sql = f"""SELECT 'purchase' AS collection, max_by(w.hash, w.event_id) AS hash, max(w.time_inserted) AS time_inserted, max_by(w.ptime_inserted, w.event_id) AS ptime_inserted
    FROM {view} w JOIN {view} r ON w.user_id = r.user_id AND w.event_id <= r.event_id WHERE r.event_id = :id AND w.event_type = 'purchase' HAVING count(*) > 0"""
    own = ev.where("event_type = 'view'").select(F.col("event_id").alias("id"), F.lit("view").alias("collection"), "hash", "time_inserted", "ptime_inserted")

    def python(spark: SparkSession, ids: DataFrame) -> DataFrame:
        asked = ev.join(ids, F.col("event_id") == F.col("id"), "left_semi")
        last = patterns.last_write(ev.where("event_type = 'purchase'").withColumn("v", F.struct("hash", "ptime_inserted")), asked, "user_id", "event_id", "v").where("write_time is not null")
        return last.select(F.col("event_id").alias("id"), F.lit("purchase").alias("collection"), "v.hash", F.col("write_time").cast("int").alias("time_inserted"), "v.ptime_inserted")

    boxes = BlackBoxes(spark)
    boxes.register_sql("response", sql, lambda: own)
    boxes.register_python("other", python)
    boxes.register_python("pure", lambda spark, ids: own.select("id", *own.columns[1:]).limit(0))
    return boxes


_LAST = """(SELECT g.event_id AS id, max(s.event_id)::INTEGER AS time_inserted FROM events g JOIN events s ON s.user_id = g.user_id AND s.event_id <= g.event_id WHERE g.event_type = 'view' AND s.event_type = 'purchase' GROUP BY 1)"""


@query(f"SELECT id, 'purchase' AS collection, time_inserted FROM {_LAST} UNION ALL SELECT event_id, 'view', event_id::INTEGER FROM events WHERE event_type = 'view'")
def bb_sql_dispatch(spark, d):
    """Lineage stated in SQL, for all responses at once: what the template gives, and the request itself."""
    views = _kind(spark, d, "view").select("event_id")
    return _boxes(spark, d).lineage_of("response", views).select("id", "collection", "time_inserted")


@query(f"SELECT id, 'purchase' AS collection, time_inserted FROM {_LAST}")
def bb_python_dispatch(spark, d):
    """Lineage stated as a Python function, and that of a pure function, which is empty."""
    boxes, views = _boxes(spark, d), _kind(spark, d, "view").select("event_id")
    found = boxes.lineage_of("other", views).unionByName(boxes.lineage_of("pure", views))
    return found.select("id", "collection", "time_inserted")


def _kind(spark: SparkSession, d: str, kind: str) -> DataFrame:
    return spark.read.parquet(f"{d}/events.parquet").where(F.col("event_type") == kind)


@query("""SELECT g.user_id, g.event_id, max(s.event_id) AS write_time, arg_max(s.value, s.event_id) AS value FROM (SELECT * FROM events WHERE event_type = 'view') g
LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') s ON s.user_id = g.user_id AND s.event_id <= g.event_id GROUP BY 1, 2""")
def bb_last_write(spark, d):
    return patterns.last_write(_kind(spark, d, "purchase"), _kind(spark, d, "view"), "user_id", "event_id", "value")


@query("""WITH g AS (SELECT user_id, event_id, (SELECT max(event_id) FROM events s WHERE s.event_type = 'signup' AND s.user_id = g.user_id AND s.event_id <= g.event_id) AS set_at FROM events g WHERE event_type = 'view')
SELECT user_id, event_id, set_at, (SELECT count(*) FROM events a WHERE a.event_type = 'click' AND a.user_id = g.user_id AND a.event_id <= g.event_id AND (set_at IS NULL OR a.event_id > set_at))::BIGINT AS appends FROM g""")
def bb_set_append(spark, d):
    return patterns.set_then_appends(_kind(spark, d, "signup"), _kind(spark, d, "click"), _kind(spark, d, "view"), "user_id", "event_id")


@query("""WITH g AS (SELECT user_id, event_id, (SELECT max(event_id) FROM events s WHERE s.event_type = 'signup' AND s.user_id = g.user_id AND s.event_id <= g.event_id) AS set_at FROM events g WHERE event_type = 'view')
SELECT user_id, event_id, set_at, (SELECT count(*) FROM events a WHERE a.event_type = 'click' AND a.user_id = g.user_id AND (set_at IS NULL OR a.event_id > set_at))::BIGINT AS appends FROM g""")
def bb_set_append_unbounded(spark, d):
    return patterns.set_then_appends(_kind(spark, d, "signup"), _kind(spark, d, "click"), _kind(spark, d, "view"), "user_id", "event_id", bounded=False)


@query("""WITH g AS (SELECT user_id, event_id, (SELECT max(event_id) FROM events s WHERE s.event_type = 'signup' AND s.user_id = g.user_id AND s.event_id <= g.event_id) AS set_at FROM events g WHERE event_type = 'view')
SELECT user_id, event_id, 'set' AS kind, set_at AS write_time FROM g WHERE set_at IS NOT NULL
UNION ALL SELECT g.user_id, g.event_id, 'append', a.event_id FROM g JOIN events a ON a.user_id = g.user_id WHERE a.event_type = 'click' AND a.event_id <= g.event_id AND (set_at IS NULL OR a.event_id > set_at)""")
def bb_set_append_rows(spark, d):
    """The writes themselves that each read depends on."""
    return patterns.set_append_lineage(_kind(spark, d, "signup"), _kind(spark, d, "click"), _kind(spark, d, "view"), "user_id", "event_id")


_CLOCKS = """k AS (SELECT user_id, event_id, event_type, (event_id % 3)::INTEGER AS slot, (event_id // 1000)::INTEGER AS g, event_id::INTEGER AS t FROM events),
c AS (SELECT *, CASE WHEN slot = 0 THEN t ELSE g END AS c0, CASE WHEN slot = 1 THEN t ELSE g END AS c1, CASE WHEN slot = 2 THEN t ELSE g END AS c2 FROM k),
w AS (SELECT * FROM c WHERE event_type = 'purchase'), r AS (SELECT * FROM c WHERE event_type = 'view'),
seen AS (SELECT r.event_id AS read, w.event_id AS write, w.c0, w.c1, w.c2, r.c0 AS r0, r.c1 AS r1, r.c2 AS r2 FROM r JOIN w USING (user_id) WHERE NOT (w.c0 >= r.c0 AND w.c1 >= r.c1 AND w.c2 >= r.c2 AND (w.c0 > r.c0 OR w.c1 > r.c1 OR w.c2 > r.c2))),
causal AS (SELECT read, write FROM seen a WHERE NOT EXISTS (SELECT 1 FROM seen b WHERE b.read = a.read AND a.c0 <= b.c0 AND a.c1 <= b.c1 AND a.c2 <= b.c2 AND (a.c0 < b.c0 OR a.c1 < b.c1 OR a.c2 < b.c2) AND b.c0 <= b.r0 AND b.c1 <= b.r1 AND b.c2 <= b.r2))"""


def _causal(spark: SparkSession, d: str) -> DataFrame:
    ev = spark.read.parquet(f"{d}/events.parquet")
    gossip = F.floor(F.col("event_id") / 1000).cast("int")
    clock = vclock.with_slot(F.array(gossip, gossip, gossip), (F.col("event_id") % 3).cast("int"), F.col("event_id").cast("int"))
    e = ev.select("user_id", "event_type", F.col("event_id").alias("id"), clock.alias("clock"))
    return patterns.causal_candidates(e.where("event_type = 'purchase'"), e.where("event_type = 'view'"), "user_id")


@query(f"WITH {_CLOCKS} SELECT read, write FROM causal")
def bb_vector_clock(spark, d):
    return _causal(spark, d)


@query(f"WITH {_CLOCKS}, ranked AS (SELECT read, write, row_number() OVER (PARTITION BY read ORDER BY write DESC)::INTEGER AS rank FROM causal), truth AS (SELECT r.event_id AS read, max(w.event_id) AS write FROM r JOIN w ON r.user_id = w.user_id AND w.event_id <= r.event_id GROUP BY 1) SELECT read, write, rank FROM ranked JOIN truth USING (read, write)")
def bb_rank(spark, d):
    """Rank of the last write by time in the causal lineage list, newest first."""
    truth = patterns.last_write(_kind(spark, d, "purchase"), _kind(spark, d, "view"), "user_id", "event_id", "value").where("write_time is not null")
    return patterns.rank_of(_causal(spark, d), truth.select(F.col("event_id").alias("read"), F.col("write_time").alias("write")), "read", "write", F.col("write"))


@query("""WITH w AS (SELECT user_id AS f, event_id AS write, floor(value)::BIGINT AS s, event_id % 40 AS n FROM events WHERE event_type = 'purchase'),
r AS (SELECT user_id AS f, event_id AS read, floor(value / 2)::BIGINT AS a, floor(value / 2)::BIGINT + 30 AS b FROM events WHERE event_type = 'view'),
p AS (SELECT read, write, unnest(range(greatest(s, a), least(s + n, b))) AS byte FROM r JOIN w USING (f) WHERE write < read AND s < b AND s + n > a AND n > 0)
SELECT DISTINCT read, write FROM (SELECT read, byte, max(write) AS write FROM p GROUP BY 1, 2)""")
def bb_byte_range(spark, d):
    w = _kind(spark, d, "purchase").select("user_id", F.col("event_id").alias("time"), F.floor("value").alias("start"), (F.col("event_id") % 40).alias("size"))
    half = F.floor(F.col("value") / 2)
    r = _kind(spark, d, "view").select("user_id", F.col("event_id").alias("time"), half.alias("start"), (half + 30).alias("stop"))
    return patterns.byte_range(w, r, "user_id")


@query("""WITH RECURSIVE n AS (SELECT max(user_id) + 1 AS n FROM events), ev AS (SELECT user_id AS o, event_id AS w, CASE WHEN event_type = 'click' THEN (user_id * 7 + event_id) % n END AS source, event_type = 'signup' AS made FROM events, n WHERE event_type IN ('signup', 'click')),
iv AS (SELECT *, coalesce(lead(w) OVER (PARTITION BY o ORDER BY w), 9223372036854775807) AS until FROM ev),
c AS (SELECT o AS object, o AS fin, max(w) AS upto, 0 AS steps FROM ev GROUP BY o UNION ALL SELECT c.object, iv.source, iv.w - 1, c.steps + 1 FROM c JOIN iv ON iv.o = c.fin AND iv.w <= c.upto AND iv.until > c.upto WHERE NOT iv.made)
SELECT c.object, c.fin AS origin, iv.w AS origin_time, c.steps::INTEGER AS steps FROM c JOIN iv ON iv.o = c.fin AND iv.w <= c.upto AND iv.until > c.upto WHERE iv.made""")
def bb_object_copy(spark, d):
    """Users as objects: signups create, clicks copy from another; where each object's content comes from."""
    n = spark.read.parquet(f"{d}/events.parquet").agg(F.max("user_id")).first()[0] + 1
    made = _kind(spark, d, "signup").select(F.col("user_id").alias("object"), F.col("event_id").alias("time"))
    copies = _kind(spark, d, "click").select(F.col("user_id").alias("object"), ((F.col("user_id") * 7 + F.col("event_id")) % n).alias("source"), F.col("event_id").alias("time"))
    return patterns.copied_from(made, copies)


@query("""WITH c AS (SELECT event_id, [(event_id % 5)::INTEGER, (user_id % 5)::INTEGER] AS a, [(user_id % 3)::INTEGER, (event_id % 3)::INTEGER] AS b FROM events)
SELECT event_id, a[1] <= b[1] AND a[2] <= b[2] AS leq, a[1] <= b[1] AND a[2] <= b[2] AND a <> b AS less, NOT (a[1] <= b[1] AND a[2] <= b[2]) AND NOT (b[1] <= a[1] AND b[2] <= a[2]) AS concurrent, greatest(a[1], b[1]) || ',' || greatest(a[2], b[2]) AS merged FROM c""")
def vector_clocks(spark, d):
    a, b = (F.array(F.expr(f"cast({x} as int)"), F.expr(f"cast({y} as int)")) for x, y in (("event_id % 5", "user_id % 5"), ("user_id % 3", "event_id % 3")))
    ev = spark.read.parquet(f"{d}/events.parquet").select("event_id", a.alias("a"), b.alias("b"))
    x, y = F.col("a"), F.col("b")
    return ev.select("event_id", vclock.leq(x, y).alias("leq"), vclock.less(x, y).alias("less"), vclock.concurrent(x, y).alias("concurrent"), F.array_join(F.transform(vclock.merge(x, y), lambda v: v.cast("string")), ",").alias("merged"))


# ---- streaming


@query("SELECT user_id, event_type, count(*)::BIGINT AS n FROM events GROUP BY ALL")
def stream_channel(spark, d):
    """Events stream into a channel, a receipt and a tick for each micro-batch; the table equals the batch result."""
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    source = spark.readStream.schema(schema).parquet(f"{d}/[e]vents.parquet")  # as a pattern: the table may be one file
    messages = source.select(F.lit("n").alias("addr"), "event_id", "user_id", "event_type")
    cols = [("event_id", "bigint"), ("user_id", "bigint"), ("event_type", "string")]
    node = Program(spark, "n").channel("ev", [("addr", "string"), *cols]).table("seen", cols).rules(lambda c: [c.seen.merge(lambda now: c.ev.scan().project(1, 2, 3))]).start()
    run_stream(node, messages, "ev", f"{shared_dir(spark)}/stream-{tempfile.mktemp(dir='')}").awaitTermination()
    return node["seen"].scan().group_by([1, 2], Count()).named("user_id", "event_type", "n").df
