"""Random programs: the engine against a plain interpreter of its semantics."""

import random

import pytest

from brookline.functions.aggregates import Count
from brookline.operators.relation import Relation
from brookline.plans.program import Program

TABLES, SCRATCH = ("a", "b"), ("s",)


def bodies(rng):
    """A random relational expression of one column, as (engine, interpreter) functions."""
    x, y = rng.choice(TABLES + SCRATCH), rng.choice(TABLES + SCRATCH)
    k, data = rng.randrange(1, 4), [(rng.randrange(6),) for _ in range(3)]
    return rng.choice(
        [
            (lambda c, spark: Relation.iterable(spark, data, "x int"), lambda st: set(data)),
            (lambda c, spark: getattr(c, x).scan(), lambda st: set(st[x])),
            (lambda c, spark: getattr(c, x).scan().map(lambda r: [(r[0] + k) % 10]), lambda st: {((v + k) % 10,) for (v,) in st[x]}),
            (lambda c, spark: getattr(c, x).scan().filter(lambda r: r[0] % 2 == 0), lambda st: {t for t in st[x] if t[0] % 2 == 0}),
            (lambda c, spark: getattr(c, x).scan().hash_join(getattr(c, y).scan(), [0], [0]).project(1), lambda st: set(st[x]) & set(st[y])),
            (lambda c, spark: getattr(c, x).scan().group_by([], Count()).map(lambda r: [r[0].cast("int")]), lambda st: {(len(st[x]),)} if st[x] else set()),
        ]
    )


@pytest.mark.parametrize("seed", range(4))
def test_random_program(spark, seed):
    rng = random.Random(seed)
    heads = [(rng.choice(TABLES), rng.choice(["merge", "merge_later", "delete_later"])) if rng.random() < 0.8 else ("s", "merge") for _ in range(4)]
    rules = [(h, op, *bodies(rng)) for h, op in heads]

    def declared(c):
        return [getattr(getattr(c, h), op)(lambda now, f=f: f(c, spark)) for h, op, f, _ in rules]

    p = Program(spark, "n")
    for t in TABLES:
        p.table(t, [("x", "int")])
    node = p.scratch("s", [("x", "int")]).rules(declared).start()

    state, time = {n: {} for n in TABLES + SCRATCH}, 0
    for _ in range(2):
        node.tick()
        later, gone = [], []
        for h, op, _, f in rules:
            time += 1
            new = f(state)
            if op == "merge":
                for t in new:
                    state[h] = {**state[h], t: state[h].get(t, set()) | {time}}
            else:
                (later if op == "merge_later" else gone).append((h, new, time))
        time += 1
        for h, new, at in later:
            for t in new:
                state[h] = {**state[h], t: state[h].get(t, set()) | {at}}
        for h, new, _ in gone:
            state[h] = {t: v for t, v in state[h].items() if t not in new}
        state["s"] = {}
        for n in state:
            assert {(r.x,): set(r._times) for r in node[n].state.collect()} == state[n]
    assert node.time == time
