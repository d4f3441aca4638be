"""Programs against their traces by logical time."""

import pytest
from pyspark.sql import functions as F

from brookline.operators.relation import Relation
from brookline.plans.debugger import backward, closure, forward, rule_at
from brookline.plans.program import Program, deliver, service_shim
from brookline.queries import kvs
from brookline.sources.history import History
from brookline.types import SchemaError

X = [("x", "int")]


def state(node, name):
    return {tuple(r)[:-2]: list(r._times) for r in node[name].state.collect()}


def zero(spark):
    return Relation.iterable(spark, [(0,)], "x int")


def plus1(c):
    return c.scan().map(lambda r: [r[0] + 1])


def test_simple(spark):
    p = Program(spark, "n").table("t", X).scratch("s", X)
    n = p.rules(lambda c: [c.t <= zero(spark), c.s.merge(lambda now: c.t.scan()), c.t.merge(lambda now: plus1(c.s))]).start()
    n.tick()
    assert state(n, "t") == {(0,): [1], (1,): [3]} and state(n, "s") == {}
    n.tick()
    assert state(n, "t") == {(0,): [1, 5], (1,): [3, 7], (2,): [7]}
    assert n.time == 8


def test_logical_time(spark):
    p = Program(spark, "n").table("t", X)
    n = p.rules(lambda c: [c.t.merge(lambda now: zero(spark).map(lambda r: [F.lit(now)]))]).start()
    n.tick()
    n.tick()
    assert state(n, "t") == {(1,): [1], (3,): [3]}


def test_complex(spark):
    lines = []
    p = Program(spark, "n").table("t", X).scratch("s", X).stdout(lines.append).bootstrap(lambda c: [c.t <= zero(spark)])
    p = p.rules(
        lambda c: [
            c.t.merge(lambda now: c.t.scan().map(lambda r: [(r[0] + 1) * 2])),
            c.s.merge(lambda now: c.t.scan()),
            c.t.delete_later(lambda now: c.s.scan().filter(lambda r: r[0] % 2 == 0)),
            c.stdout.merge(lambda now: c.t.scan().map(lambda r: [r[0].cast("string")])),
        ]
    )
    n = p.start()
    n.bootstrap_tick()
    assert state(n, "t") == {(0,): [1]}
    n.tick()
    assert state(n, "t") == {} and lines == ["0", "2"]
    n.tick()
    assert lines == ["0", "2"]


def test_merge_before_delete(spark):
    both = Relation.iterable(spark, [("b",), ("c",)], "x string")
    ab = Relation.iterable(spark, [("a",), ("b",)], "x string")
    n = Program(spark, "n").table("t", [("x", "string")]).rules(lambda c: [c.t.merge_later(ab), c.t.delete_later(both)]).start()
    n.tick()
    assert set(state(n, "t")) == {("a",)}


def test_ping_pong(spark):
    def node(name, other):
        return Program(spark, name).channel("c", [("addr", "string"), ("x", "int")]).rules(lambda c: [c.c.merge(lambda now: c.c.scan().map(lambda r: [F.lit(other), r[1]]))])

    first = Relation.iterable(spark, [("pong", 42)], "addr string, x int")
    ping, pong = node("ping", "pong").bootstrap(lambda c: [c.c <= first]).start(), node("pong", "ping").start()
    ping.bootstrap_tick()
    assert state(ping, "c") == {}
    assert deliver(ping, [ping, pong]) == 1 and state(pong, "c") == {("pong", 42): [1]}
    pong.tick()
    assert state(pong, "c") == {} and deliver(pong, [ping, pong]) == 1
    assert state(ping, "c") == {("ping", 42): [3]}
    ping.tick()
    deliver(ping, [pong])
    assert state(pong, "c") == {("pong", 42): [4]}


def test_periodics_earliest_first(spark):
    n = Program(spark, "n").periodic("p", 1).periodic("q", 3).start()
    n.fire(1)
    assert [r.id for r in n["p"].df.collect()] == [0] and n["q"].df.count() == 0
    n.tick()
    n.fire(3)
    assert sorted(r.id for r in n["p"].df.collect()) == [1, 2] and [r.id for r in n["q"].df.collect()] == [0]


def test_permissions_and_types(spark):
    p = Program(spark, "n").table("t", X).scratch("s", X).stdin()
    c = p.collections
    with pytest.raises(SchemaError):
        c["s"].delete_later(zero(spark))
    with pytest.raises(SchemaError):
        c["stdin"].merge(zero(spark))
    with pytest.raises(SchemaError):
        Program(spark, "m").table("t", [("x", "bigint")]).rules(lambda c: [c.t <= zero(spark)]).start()
    with pytest.raises(SchemaError):
        p.table("lineage", X)
    with pytest.raises(SchemaError):
        Program(spark, "m").channel("c", X)


def test_kvs(spark):
    n = kvs(spark).start()
    get, put = "dst string, src string, id bigint, k string", "dst string, src string, id bigint, k string, v string"
    n.receive("set_request", spark.createDataFrame([("server", "me", 1, "a", "1")], put))
    n.receive("get_request", spark.createDataFrame([("server", "me", 2, "a")], get))
    n.tick()
    sent = {(name, tuple(r)) for name, _, df in n.take_sent() for r in df.collect()}
    assert sent == {("set_response", ("me", 1))}  # a get in the tick of the set sees the old state
    n.receive("get_request", spark.createDataFrame([("server", "me", 3, "a"), ("server", "me", 4, "z")], get))
    n.receive("set_request", spark.createDataFrame([("server", "me", 5, "a", "1")], put))
    n.tick()
    sent = {(name, tuple(r)) for name, _, df in n.take_sent() for r in df.collect()}
    assert ("get_response", ("me", 3, "1")) in sent and len(sent) == 2
    assert n["kvs"].df.count() == 0  # setting a key to its value again loses it: merge comes before delete


def test_service_shim(spark):
    p = Program(spark, "svc")
    n = p.rules(service_shim(p, {"len": ([("s", "string")], "n", "int", len)})).start()
    n.receive("len_request", spark.createDataFrame([("svc", "me", 1, "abc")], "d string, s string, id bigint, x string"))
    n.tick()
    assert [tuple(r) for _, _, df in n.take_sent() for r in df.collect()] == [("me", 1, 3)]


def test_history_and_provenance(spark, tmp_path):
    h = History(spark, f"file://{tmp_path}/h")
    p = Program(spark, "n").table("t", X).scratch("s", X).bootstrap(lambda c: [c.t <= zero(spark)])
    n = p.rules(lambda c: [c.s.merge(lambda now: plus1(c.t)), c.t.merge(lambda now: c.s.scan())]).start(h)
    n.bootstrap_tick()
    n.tick()
    n.tick()
    assert {(r.rule, r.is_bootstrap, r.text) for r in h.table("rules").collect()} == {(0, True, "t <= Iterable"), (0, False, "s <= Map(Collection(t))"), (1, False, "t <= Collection(s)")}
    rows = {(r.x, r.time_inserted, r.time_deleted) for r in h.history("n", "s").collect()}
    assert rows == {(1, 3, 5), (1, 6, 8), (2, 6, 8)}
    assert {(r.x, r.time_inserted) for r in h.at("n", "t", 4).collect()} == {(0, 1), (1, 4)}
    assert {r.x for r in h.at("n", "s", 4).collect()} == {1} and h.at("n", "s", 5).count() == 0
    hashes = {r.x: r._hash for r in n["t"].state.collect()}
    back = [(r.dep_collection, r.dep_hash, r.dep_time, r.rule) for r in backward(h, "n", "t", hashes[2], 7).collect()]
    assert back == [("s", hashes[2], 6, 1)]
    start = spark.createDataFrame([("n", "t", hashes[2], 7)], "node string, collection string, hash bigint, time int")
    found = {(r.collection, r.hash, r.time, r.steps) for r in closure(h.edges(), start).collect()}
    assert found == {("t", hashes[2], 7, 0), ("s", hashes[2], 6, 1), ("t", hashes[1], 4, 2), ("s", hashes[1], 3, 3), ("t", hashes[0], 1, 4)}
    assert forward(h, "n", "t", hashes[0], 1).count() == 2
    assert [rule_at(t, 1, 2) for t in range(1, 8)] == [0, 1, 2, 3, 4, 5, 2] and rule_at(1, 0, 2) == 0


def test_history_in_memory_and_after_a_restart(spark, tmp_path):
    from brookline.plans import debugger
    from brookline.sources.history import MemoryHistory

    def run(h, zero_at=0):
        p = Program(spark, "n", "host:1").table("t", X).scratch("s", X).bootstrap(lambda c: [c.t <= zero(spark)])
        n = p.rules(lambda c: [c.s.merge(lambda now: plus1(c.t)), c.t.merge(lambda now: c.s.scan())]).start(h)
        n.run([])
        n.tick()

    memory, disk = MemoryHistory(spark), History(spark, f"file://{tmp_path}/h")
    run(memory)
    run(disk)
    rows = lambda h, c: sorted((r.x, r.time_inserted, r.time_deleted or 0) for r in h.history("n", c).collect())
    edges = lambda h: sorted((r.dep_hash, r.dep_time, r.rule, r.hash, r.time) for r in h.edges().collect())
    assert rows(memory, "s") == rows(disk, "s") and rows(memory, "t") == rows(disk, "t") and edges(memory) == edges(disk)
    again = History(spark, f"file://{tmp_path}/h")
    assert again.seq == disk.seq > 0
    run(again)
    assert len(rows(again, "s")) == 2 * len(rows(memory, "s")) and all(d for _, _, d in rows(again, "s"))
    assert debugger.address(again, "n") == "host:1" and [r.node for r in debugger.nodes(again).collect()] == ["n"]
    assert [r.text for r in debugger.rule_texts(again, "n").collect()] == ["s <= Map(Collection(t))", "t <= Collection(s)"]
    assert [r.text for r in debugger.rule_texts(again, "n", True).collect()] == ["t <= Iterable"]
    assert {r.collection for r in debugger.collections(again, "n").collect()} == {"t", "s"}


def test_many_parts_are_one_state(spark):
    """More merges than parts that a collection keeps: times and tuples are as ever, also after deletes."""
    p = Program(spark, "n").table("t", X)
    n = p.rules(lambda c: [c.t.merge(lambda now: zero(spark)), c.t.merge(lambda now: zero(spark).map(lambda r: [F.lit(now)]))]).start()
    for _ in range(6):
        n.tick()
    assert state(n, "t") == {(0,): [1, 4, 7, 10, 13, 16], **{(t,): [t] for t in range(2, 18, 3)}}


def test_sent_tuples_come_and_go_at_once(spark, tmp_path):
    h = History(spark, f"file://{tmp_path}/h")
    src = Relation.iterable(spark, [("b", 1)], "addr string, x int")
    a = Program(spark, "a").channel("c", [("addr", "string"), ("x", "int")]).rules(lambda c: [c.c <= src]).start(h)
    b = Program(spark, "b").channel("c", [("addr", "string"), ("x", "int")]).start(h)
    a.tick()
    assert [(r.time_inserted, r.time_deleted) for r in h.history("a", "c").collect()] == [(1, 1)]
    assert h.at("a", "c", 1).count() == 1 and h.at("a", "c", 2).count() == 0
    deliver(a, [b])
    e = h.edges().where("node = 'b'").collect()
    assert [(r.dep_node, r.dep_time, r.rule, r.time) for r in e] == [("a", 1, None, 1)]
