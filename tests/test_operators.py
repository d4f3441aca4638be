"""Operators and aggregates on small literal inputs."""

import datetime
import decimal

import pytest
from pyspark.sql import functions as F

from brookline.functions.aggregates import Avg, Count, Sum, Union, UserAggregate
from brookline.operators.relation import LINEAGE, Relation
from brookline.types import SchemaError, schema_of

PAIRS = [(0, 0), (0, 1), (1, 2), (1, 3), (1, 4), (2, 5)]


def rows(rel):
    return sorted(tuple(r) for r in rel.df.collect())


def rel(spark, data, schema="k int, v int"):
    return Relation.iterable(spark, data, schema)


def test_constant_is_sent_to_all_tasks(spark):
    """A join with a constant of few keys neither shuffles nor sends nor sorts the other side."""
    codes = rel(spark, [("A", 1), ("N", 2), ("R", 3), (None, 4)], "flag string, code int")
    assert rows(codes.filter(lambda r: r[0].isNotNull())) == [("A", 1), ("N", 2), ("R", 3)]
    other = Relation.of(spark.range(1000).selectExpr("substr('ANRX', cast(id % 4 + 1 as int), 1) as f", "id"))
    for joined, side in ((other.hash_join(codes, [0], [0]), "BuildRight"), (codes.hash_join(other, [0], [0]), "BuildLeft")):
        plan = joined.df._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and side in plan and "SortMergeJoin" not in plan and "hashpartitioning" not in plan
        assert joined.df.count() == 750


def test_constants_keep_values_and_types(spark):
    at = datetime.datetime(2024, 3, 10, 2, 30)
    schema = "a string, b int, c array<int>, d map<string,int>, e struct<x:bigint,y:string>, f timestamp, g date, h decimal(10,2), i binary, j double, k boolean"
    data = [("A", 1, [1, None], {"k": 2}, (1, "x"), at, at.date(), decimal.Decimal("1.20"), b"\x00\x01", 1.5, True), (None,) * 11, ("A", 1, [], {}, (None, None), at, None, None, b"", 0.0, False)]
    for given in (data, [], data[1:2]):
        df, want = rel(spark, given, schema).df, spark.createDataFrame(given, schema)
        assert df.schema == want.schema and df.collect() == want.collect()
    assert rel(spark, [(1, None)], "k int, v variant").df.collect() == [(1, None)]
    wide = [(0, "x" * (1 << 21)), (1, "y")]
    assert [len(r.v) for r in rel(spark, wide, "k int, v string").df.sort("k").collect()] == [1 << 21, 1]


def test_count_sum_avg(spark):
    r = rel(spark, PAIRS)
    assert rows(r.group_by([0], Count(1))) == [(0, 2), (1, 3), (2, 1)]
    assert rows(r.group_by([0], Count())) == [(0, 2), (1, 3), (2, 1)]
    assert rows(r.group_by([0], Sum(1))) == [(0, 1), (1, 9), (2, 5)]
    assert rows(r.group_by([0], Avg(1))) == [(0, 0.5), (1, 3.0), (2, 5.0)]


def test_several_columns_are_one_pool(spark):
    data = [(0, 0, 0, 0), (0, 1, 1, 1), (1, 2, 2, 2), (1, 3, 3, 3), (1, 4, 4, 4), (2, 5, 5, 5)]
    r = rel(spark, data, "k int, a int, b int, c int")
    assert rows(r.group_by([0], Sum(1, 2, 3, 1, 2, 3))) == [(0, 6), (1, 54), (2, 30)]
    r = rel(spark, [(0, 0, 2), (0, 1, 3), (1, 2, 5), (1, 3, 6), (1, 4, 7), (2, 5, 5)], "k int, a int, b int")
    assert rows(r.group_by([0], Avg(1, 2))) == [(0, 1.5), (1, 4.5), (2, 5.0)]


def test_union_of_sets(spark):
    r = rel(spark, [(0, [0], [2]), (0, [1], [3]), (1, [2], [5]), (1, [3, 2], [6])], "k int, a array<int>, b array<int>")
    assert rows(r.group_by([0], Union(1))) == [(0, [0, 1]), (1, [2, 3])]
    assert rows(r.group_by([0], Union(1, 2))) == [(0, [0, 1, 2, 3]), (1, [2, 3, 5, 6])]


def test_no_keys(spark):
    assert rows(rel(spark, [(1,), (2,), (3,)], "x int").group_by([], Count())) == [(3,)]
    assert rows(rel(spark, [], "x int").group_by([], Count())) == []


def test_keys_only_and_user_aggregate(spark):
    assert rows(rel(spark, PAIRS).group_by([0])) == [(0,), (1,), (2,)]
    spread = UserAggregate("Spread", (1,), lambda x: F.max(x) - F.min(x))
    assert rows(rel(spark, PAIRS).group_by([0], spread)) == [(0, 1), (1, 2), (2, 0)]


def test_sum_that_does_not_fit_raises(spark):
    with pytest.raises(Exception, match="OVERFLOW"):
        rows(rel(spark, [(0, 2147483647), (0, 1)]).group_by([0], Sum(1)))


@pytest.mark.parametrize("left,right", [([], []), ([(1,)], []), ([], [(1,)])])
def test_join_empty(spark, left, right):
    assert rows(rel(spark, left, "x int").hash_join(rel(spark, right, "y int"), [0], [0])) == []


def test_join_many_to_many_and_repeated_keys(spark):
    a, b = rel(spark, [(1, "a"), (1, "b"), (2, "c")], "x int, s string"), rel(spark, [(1, "p"), (1, "q"), (3, "r")], "y int, t string")
    assert rows(a.hash_join(b, [0], [0])) == [(1, "a", 1, "p"), (1, "a", 1, "q"), (1, "b", 1, "p"), (1, "b", 1, "q")]
    c, d = rel(spark, [(1,), (2,), (3,)], "x int"), rel(spark, [(1, 1), (1, 2), (2, 2), (2, 3), (3, 3), (3, 1)], "a int, b int")
    assert rows(c.hash_join(d, [0, 0], [0, 1])) == [(1, 1, 1), (2, 2, 2), (3, 3, 3)]


def test_join_keys_must_be_equal_types(spark):
    with pytest.raises(SchemaError):
        rel(spark, [(1,)], "x int").hash_join(rel(spark, [(1,)], "y bigint"), [0], [0])


def test_bag_semantics_and_project(spark):
    r = rel(spark, PAIRS).project(0)
    assert rows(r.group_by([0], Count())) == [(0, 2), (1, 3), (2, 1)]
    assert rows(rel(spark, [(1, 2)]).project(1, 0, 1)) == [(2, 1, 2)]
    with pytest.raises(SchemaError):
        r.project(3)


def test_map_filter_flat_map_cross(spark):
    r = rel(spark, PAIRS)
    assert rows(r.filter(lambda x: x.v % 2 == 0).map(lambda x: [x.k + x.v])) == [(0,), (3,), (5,)]
    assert rows(r.filter_udf(lambda k, v: v > 3)) == [(1, 4), (2, 5)]
    assert rows(r.map_udf(lambda k, v: (str(k + v),), "s string")) == [("0",), ("1",), ("3",), ("4",), ("5",), ("7",)]
    assert rows(rel(spark, [(2,), (0,)], "x int").flat_map(lambda x: F.array_repeat(x.x, x.x))) == [(2,), (2,)]
    assert len(rows(r.cross(rel(spark, [(7,), (8,)], "z int")))) == 12


def test_debug_strings(spark):
    r = rel(spark, PAIRS)
    assert r.group_by([0, 1]).debug_string() == "GroupBy<Keys<0, 1>, >(Iterable)"
    assert r.hash_join(r, [0, 1], [1, 0]).debug_string() == "HashJoin<LeftKeys<0, 1>, RightKeys<1, 0>>(Iterable, Iterable)"
    assert r.project(0).filter(lambda x: x[0] > 1).debug_string() == "Filter(Project<0>(Iterable))"


def stored(spark, data, name="t", times=(42,)):
    df = spark.createDataFrame([(x, x, list(times)) for x in data], "x int, _hash bigint, _times array<int>")
    return Relation.scan(df, name, ["x"])


def lineage(r):
    out = {}
    for row in r.with_lineage.collect():
        out[tuple(row)[:-1]] = {(i.collection, i.hash, i.time) for i in row[LINEAGE]}
    return out


def test_lineage(spark):
    t, r = stored(spark, [1, 2, 3]), stored(spark, [1, 2], "r", (9, 10))
    assert lineage(t.filter(lambda x: x[0] > 1).map(lambda x: [x[0] * 10]))[(20,)] == {("t", 2, 42)}
    assert lineage(t.hash_join(r, [0], [0]))[(1, 1)] == {("t", 1, 42), ("r", 1, 9), ("r", 1, 10)}
    assert lineage(t.cross(r))[(3, 2)] == {("t", 3, 42), ("r", 2, 9), ("r", 2, 10)}
    assert lineage(t.group_by([], Count()))[(3,)] == {("t", 1, 42), ("t", 2, 42), ("t", 3, 42)}
    assert lineage(rel(spark, [(1, 2)]))[(1, 2)] == set()


def test_lineage_of_groups_goes_on(spark):
    """What a group comes from stays with it through maps, filters, joins, impure functions and further groups."""
    t, r = stored(spark, [1, 2, 3, 4]), stored(spark, [0, 1], "r", (9,))
    odd = t.map(lambda x: [x[0] % 2, x[0]]).group_by([0], Count())
    ids = {0: {("t", 2, 42), ("t", 4, 42)}, 1: {("t", 1, 42), ("t", 3, 42)}}
    assert lineage(odd) == {(k, 2): v for k, v in ids.items()}
    assert lineage(odd.filter(lambda x: x[0] == 1).map(lambda x: [x[0] * 10, x[1]]).project(0)) == {(10,): ids[1]}
    small = r.map(lambda x: [x[0]])
    assert lineage(odd.hash_join(small, [0], [0])) == {(k, 2, k): v | {("r", k, 9)} for k, v in ids.items()}
    assert lineage(small.hash_join(odd, [0], [0])) == {(k, k, 2): v | {("r", k, 9)} for k, v in ids.items()}
    assert lineage(odd.map_udf(lambda k, n: (k + n,), "x bigint", impure=True)) == {(k + 2,): v for k, v in ids.items()}
    assert lineage(odd.flat_map_udf(lambda k, n: [(k,)] * n, "x bigint")) == {(k,): v for k, v in ids.items()}
    assert lineage(odd.group_by([1], Count())) == {(2, 2): ids[0] | ids[1]}
    assert lineage(odd.cross(small)) == {(k, 2, j): v | {("r", j, 9)} for k, v in ids.items() for j in (0, 1)}


def test_unread_lineage_is_pruned(spark, tmp_path):
    spark.createDataFrame([(1, 1, [1])], "x int, _hash bigint, _times array<int>").write.parquet(str(tmp_path / "t"))
    r = Relation.scan(spark.read.parquet(str(tmp_path / "t")), "t", ["x"]).project(0)
    plan = r.df._jdf.queryExecution().executedPlan().toString()
    assert "_times" not in plan and "_hash" not in plan


def test_schemas():
    with pytest.raises(SchemaError):
        schema_of([("a", "map<string,int>")])
    with pytest.raises(SchemaError):
        schema_of([("a", "int"), ("a", "int")])
