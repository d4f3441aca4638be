"""Lineage patterns, vector clocks, helpers and streaming on small inputs."""

import pytest
from pyspark.sql import functions as F

from brookline.functions import text, vclock
from brookline.plans import patterns
from brookline.operators.relation import Relation
from brookline.plans.blackbox import BlackBoxes, check_channels
from brookline.plans.program import Program
from brookline.streaming.run import run_stream
from brookline.types import SchemaError, schema_of


def test_last_write_across_cells_and_ties(spark):
    w = spark.createDataFrame([("a", 1, 10), ("a", 5, 50), ("a", 9000, 90), ("b", 3, 30)], "k string, t bigint, v int")
    r = spark.createDataFrame([("a", 0), ("a", 5), ("a", 8999), ("a", 20000), ("b", 2), ("c", 1)], "k string, t bigint")
    got = {(x.k, x.t): (x.write_time, x.v) for x in patterns.last_write(w, r, "k", "t", "v", cell=4).collect()}
    assert got == {("a", 0): (None, None), ("a", 5): (5, 50), ("a", 8999): (5, 50), ("a", 20000): (9000, 90), ("b", 2): (None, None), ("c", 1): (None, None)}
    strict = {x.t: x.write_time for x in patterns.last_write(w, r.where("k = 'a'"), "k", "t", "v", cell=4, inclusive=False).collect()}
    assert strict[5] == 1


def test_byte_range(spark):
    w = spark.createDataFrame([("f", 1, 0, 10), ("f", 2, 5, 10), ("f", 3, 7, 0), ("f", 9, 0, 100)], "f string, time bigint, start bigint, size bigint")
    r = spark.createDataFrame([("f", 5, 0, 20), ("f", 6, 6, 9), ("f", 7, 3, 3)], "f string, time bigint, start bigint, stop bigint")
    assert sorted(map(tuple, patterns.byte_range(w, r, "f", cell=4).collect())) == [(5, 1), (5, 2), (6, 2)]


def test_byte_range_equals_brute_force(spark):
    import random

    rng = random.Random(1)
    writes = [("f", t, rng.randrange(60), rng.randrange(25)) for t in range(0, 80, 2)]
    reads = [("f", t, a, a + rng.randrange(20)) for t in range(1, 80, 4) for a in (rng.randrange(60),)]
    want = set()
    for _, t, a, b in reads:
        for byte in range(a, b):
            on = [w for _, w, s, n in writes if w < t and s <= byte < s + n]
            want |= {(t, max(on))} if on else set()
    w, r = spark.createDataFrame(writes, "f string, time bigint, start bigint, size bigint"), spark.createDataFrame(reads, "f string, time bigint, start bigint, stop bigint")
    for cell in (7, 1 << 16):
        assert {tuple(x) for x in patterns.byte_range(w, r, "f", cell=cell).collect()} == want


def test_sets_and_appends_equal_brute_force(spark):
    import random

    rng = random.Random(2)
    log = [(rng.choice("ab"), t, rng.choice("sarr")) for t in range(60)] + [("c", 5, "r"), ("c", 6, "a"), (None, 7, "r")]
    log += [("d", 3, "s"), ("d", 3, "a"), ("d", 3, "r")]
    of = lambda x: spark.createDataFrame([(k, t) for k, t, y in log if y == x], "k string, t bigint")
    for bounded in (True, False):
        counts, rows = set(), set()
        for k, t, y in log:
            if y == "r":
                at = max((u for j, u, z in log if (j, z) == (k, "s") and u <= t), default=None)
                after = [u for j, u, z in log if (j, z) == (k, "a") and (at is None or u >= at) and (u <= t or not bounded)]
                counts.add((k, t, at, len(after)))
                rows |= {(k, t, "append", u) for u in after} | ({(k, t, "set", at)} if at is not None else set())
        for cell in (4, 4096):
            assert {tuple(x) for x in patterns.set_then_appends(of("s"), of("a"), of("r"), "k", "t", bounded, cell).collect()} == counts
            assert {tuple(x) for x in patterns.set_append_lineage(of("s"), of("a"), of("r"), "k", "t", bounded, cell).collect()} == rows


def test_copies_follow_the_newest(spark):
    made = spark.createDataFrame([("x", 1), ("y", 2), ("x", 9)], "object string, time bigint")
    copies = spark.createDataFrame([("z", "x", 5), ("v", "z", 6)], "object string, source string, time bigint")
    got = {(r.object, r.origin, r.origin_time, r.steps) for r in patterns.copied_from(made, copies).collect()}
    assert got == {("x", "x", 9, 0), ("y", "y", 2, 0), ("z", "x", 1, 1), ("v", "x", 1, 2)}


def test_vector_clocks(spark):
    df = spark.createDataFrame([([1, 2], [1, 3]), ([1, 2], [2, 1]), ([1, 1], [1, 1])], "a array<int>, b array<int>")
    a, b = F.col("a"), F.col("b")
    got = [tuple(r) for r in df.select(vclock.less(a, b), vclock.concurrent(a, b), vclock.equal(a, b), vclock.geq(b, a), vclock.differs(a, b)).collect()]
    assert got == [(True, False, False, True, True), (False, True, False, False, True), (False, False, True, True, False)]
    assert df.select(vclock.with_slot(vclock.merge(a, b), 1, 9)).first()[0] == [1, 9]
    with pytest.raises(Exception, match="vector clocks"):
        spark.createDataFrame([([1], [1, 2])], "a array<int>, b array<int>").select(vclock.leq(a, b)).collect()


def test_gossip_reaches_all_replicas(spark):
    clock = [("clock", "array<int>")]

    def replica(i):
        mine = lambda now: lambda r: [vclock.with_slot(vclock.merge(r[1], r[2]), i, now)]
        p = Program(spark, f"r{i}").table("clock", clock).channel("merge", [("addr", "string"), *clock])
        from brookline.operators.relation import Relation

        start = Relation.iterable(spark, [([0, 0],)], "clock array<int>")
        p = p.bootstrap(lambda c: [c.clock <= start])
        return p.rules(
            lambda c: [
                c.merge.merge(lambda now: c.clock.scan().map(lambda r: [F.lit(f"r{1 - i}"), vclock.with_slot(r[0], i, now)])),
                c.clock.delete_later(lambda now: c.merge.scan().cross(c.clock.scan()).project(2)),
                c.clock.merge_later(lambda now: c.merge.scan().cross(c.clock.scan()).map(mine(now))),
            ]
        )

    from brookline.plans.program import deliver

    a, b = replica(0).start(), replica(1).start()
    for n in (a, b):
        n.bootstrap_tick()
    a.tick()
    deliver(a, [b])
    b.tick()
    (got,) = [r.clock for r in b["clock"].df.collect()]
    assert got[0] > 0 and got[1] > 0


def test_text_helpers(spark):
    df = spark.createDataFrame([(" a  b\n c ",)], "s string")
    assert df.select(text.split_words(F.col("s"))).first()[0] == ["a", "b\n", "c"]
    assert df.select(text.crunch_whitespace(F.col("s"))).first()[0] == " a b c "
    assert df.select(text.rand_int(3, 5, 1)).first()[0] in (3, 4) and len(df.select(text.random_alphanum(7, 1)).first()[0]) == 7
    assert text.zipf_weights(3, 1.0) == [1.0, 0.5, 1 / 3]


def test_black_boxes(spark):
    check_channels(schema_of([("d", "string"), ("s", "string"), ("id", "bigint"), ("x", "int")]), schema_of([("a", "string"), ("id", "bigint")]))
    with pytest.raises(SchemaError):
        check_channels(schema_of([("d", "string"), ("id", "bigint")]), schema_of([("a", "string"), ("id", "bigint")]))
    cols = "collection string, hash bigint, time_inserted int, ptime_inserted timestamp"
    spark.sql("select 'kvs' collection, 7L hash, 1 time_inserted, timestamp'2024-01-01' ptime_inserted, 3L id").createOrReplaceTempView("writes")
    boxes = BlackBoxes(spark)
    request = spark.sql("select 3L id, 'f_request' collection, 9L hash, 2 time_inserted, timestamp'2024-01-02' ptime_inserted")
    boxes.register_sql("f_response", "select collection, hash, time_inserted, ptime_inserted from writes where id = :id", lambda: request)
    assert [r.collection for r in boxes.lineage("f_response", 3).collect()] == ["f_request", "kvs"]
    boxes.register_python("g_response", lambda s, i: s.createDataFrame([], cols))
    assert boxes.lineage("g_response", 1).count() == 0
    assert [boxes.kind(x) for x in ("f_response", "g_response", "h")] == ["sql", "python", "regular"]


def test_stream_takes_up_where_it_ended(spark, tmp_path):
    """A node that starts anew has its tables and clock again; timers fire in the stream; lines too can be streamed."""
    src = tmp_path / "in"
    add = lambda rows: spark.createDataFrame([(x,) for x in rows], "stdin string").coalesce(1).write.mode("append").parquet(str(src))
    lines = lambda: spark.readStream.schema("stdin string").parquet(str(src))

    def node():
        p = Program(spark, "n").stdin().periodic("p", 10).table("t", [("v", "string")]).table("beats", [("id", "bigint")]).table("boot", [("x", "int")])
        p = p.bootstrap(lambda c: [c.boot.merge(Relation.iterable(spark, [(1,)], "x int"))])
        return p.rules(lambda c: [c.t.merge(lambda now: c.stdin.scan()), c.beats.merge(lambda now: c.p.scan().project(0))]).start()

    add(["a", "b"])
    first = node()
    run_stream(first, lines(), "stdin", str(tmp_path / "ck"), clock=lambda: 25).awaitTermination()
    assert {r.v for r in first["t"].df.collect()} == {"a", "b"} and {r.id for r in first["beats"].df.collect()} == {0, 1}
    add(["c"])
    second = node()
    run_stream(second, lines(), "stdin", str(tmp_path / "ck")).awaitTermination()
    assert {r.v for r in second["t"].df.collect()} == {"a", "b", "c"} and second["boot"].df.count() == 1
    assert second.time > first.time and {tuple(r)[:-2]: list(r._times) for r in first["t"].state.collect()}.items() <= {tuple(r)[:-2]: list(r._times) for r in second["t"].state.collect()}.items()
    third = node()
    run_stream(third, lines(), "stdin", str(tmp_path / "ck")).awaitTermination()
    assert third.time == second.time and {r.v for r in third["t"].df.collect()} == {"a", "b", "c"}


def test_stream_in_order_and_no_replay(spark, tmp_path):
    src = tmp_path / "in"
    spark.createDataFrame([(2, "b"), (1, "a"), (3, "c")], "seq int, v string").coalesce(1).write.parquet(str(src))
    messages = spark.readStream.schema("seq int, v string").parquet(str(src)).select(F.lit("n").alias("addr"), "seq", "v")
    cols = [("seq", "int"), ("v", "string")]

    def make():
        p = Program(spark, "n").channel("ch", [("addr", "string"), *cols]).table("t", [*cols, ("now", "int")])
        return p.rules(lambda c: [c.t.merge(lambda now: c.ch.scan().map(lambda r: [r.seq, r.v, F.lit(now)]))]).start()

    n, seen = make(), []
    run_stream(n, messages, "ch", str(tmp_path / "ck"), after=lambda node, i: seen.append(i), order="seq").awaitTermination()
    assert sorted((r.seq, r.now) for r in n["t"].df.collect()) == [(1, 2), (2, 5), (3, 8)]
    run_stream(n, messages, "ch", str(tmp_path / "ck"), after=lambda node, i: seen.append(i), order="seq").awaitTermination()
    assert seen == [0] and n["t"].df.count() == 3
