"""Programs: declared collections and rules, run in ticks of logical time.

Rules run once a tick, in order; what one merges the next can read; a rule reads its head as it stood before.
Each rule is one Spark job whose result is written once and then read for the head, the history and the edges.
The clock starts at 0 and moves on before each rule, each receipt and each end of a tick.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from types import SimpleNamespace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.relation import ID, LINEAGE
from ..sources.collections import DELETE_LATER, Channel, Collection, Periodic, Rule, Scratch, Stdin, Stdout, Table
from ..sources.history import History, NoHistory
from ..sources.shared import delete, folders, written
from ..types import SchemaError, require_same, sql_name

Rules = Callable[[SimpleNamespace], Sequence[Rule]]


class Program:
    """Declares a node; every method returns the program."""

    def __init__(self, spark: SparkSession, name: str, address: str = "") -> None:
        self.spark, self.name, self.address = spark, name, address or name
        self.collections: dict[str, Collection] = {}
        self._bootstrap: Rules | None = None
        self._rules: Rules | None = None

    def _add(self, c: Collection) -> Program:
        if c.name in self.collections:
            raise SchemaError(f"collection {c.name} is declared twice")
        self.collections[c.name] = c
        return self

    def table(self, name: str, columns: Sequence[tuple[str, str]]) -> Program:
        return self._add(Table(self.spark, name, columns))

    def scratch(self, name: str, columns: Sequence[tuple[str, str]]) -> Program:
        return self._add(Scratch(self.spark, name, columns))

    def channel(self, name: str, columns: Sequence[tuple[str, str]]) -> Program:
        return self._add(Channel(self.spark, name, columns))

    def stdin(self) -> Program:
        return self._add(Stdin(self.spark))

    def stdout(self, out: Callable[[str], None] | str = print) -> Program:
        return self._add(Stdout(self.spark, out=out))

    def periodic(self, name: str, period_ms: int) -> Program:
        return self._add(Periodic(self.spark, name, period_ms))

    def bootstrap(self, rules: Rules) -> Program:
        if self._bootstrap is not None:
            raise SchemaError("bootstrap rules are registered already")
        self._bootstrap = rules
        return self

    def rules(self, rules: Rules) -> Program:
        if self._rules is not None:
            raise SchemaError("rules are registered already")
        self._rules = rules
        return self

    def start(self, history: History | None = None) -> Executor:
        return Executor(self, history or NoHistory())


class Executor:
    def __init__(self, program: Program, history: History | NoHistory) -> None:
        self.spark, self.name, self.address, self.history = program.spark, program.name, program.address, history
        self.collections, self.time = program.collections, 0
        space = SimpleNamespace(**self.collections)
        self.bootstrap_rules = list(program._bootstrap(space)) if program._bootstrap else []
        self.rules = list(program._rules(space)) if program._rules else []
        for r in [*self.bootstrap_rules, *self.rules]:
            require_same([f.dataType for f in r.head.schema.fields], r.relation(0).types, r.debug_string())
        catalog = [(c.name, c.kind, c.names, [sql_name(f.dataType) for f in c.schema.fields]) for c in self.collections.values()]
        texts = [(i, boot, r.debug_string()) for boot, rules in ((True, self.bootstrap_rules), (False, self.rules)) for i, r in enumerate(rules)]
        history.register(self.name, self.address, catalog, texts)

    def __getitem__(self, name: str) -> Collection:
        return self.collections[name]

    def bootstrap_tick(self) -> None:
        if self.bootstrap_rules:
            self._run(self.bootstrap_rules)

    def tick(self) -> None:
        self._run(self.rules)

    def _run(self, rules: list[Rule]) -> None:
        for i, rule in enumerate(rules):
            self._execute(i, rule)
        self.time += 1
        for c in self.collections.values():
            gone = c.tick()
            if gone is not None:
                self.history.log(self.name, c.name, gone, c.names, "D", self.time)

    def _execute(self, number: int, rule: Rule) -> None:
        self.time += 1
        head, names = rule.head, rule.head.names
        relation = rule.relation(self.time)
        body, edges = relation._df, relation._edges
        keep_lineage = not isinstance(self.history, NoHistory)
        cols = [F.col(f"c{i}").alias(n) for i, n in enumerate(names)]
        rows = written(body.select(*cols, *([LINEAGE] if keep_lineage else [])), f"{head.name}-rule")
        insert = rule.op != DELETE_LATER
        if keep_lineage:
            self.history.log(self.name, head.name, rows, names, "I" if insert else "D", self.time)
            if insert and isinstance(head, Channel | Stdout):
                self.history.log(self.name, head.name, rows, names, "D", self.time)
            more = None if edges is None else edges.toDF(*names, ID)
            self.history.derived(self.name, head.name, rows, names, number, insert, self.time, more)
        head.apply(rule.op, rows, self.time)

    def receive(self, channel: str, rows: DataFrame, dep_node: str | None = None, dep_time: int = 0) -> None:
        """A batch of messages for a channel (or lines for stdin), visible until the tick."""
        self.time += 1
        c = self.collections[channel]
        require_same([f.dataType for f in c.schema.fields], [f.dataType for f in rows.schema.fields], f"messages of {channel}")
        new = c.receive(rows.toDF(*c.names), self.time)
        self.history.log(self.name, channel, new, c.names, "I", self.time)
        if dep_node is not None:
            self.history.networked(self.name, channel, new, dep_node, dep_time, self.time)

    def fire(self, now_ms: int) -> None:
        """Rows of all periodics that are due, the earliest first."""
        self.time += 1
        timers = [c for c in self.collections.values() if isinstance(c, Periodic)]
        for c in sorted(timers, key=lambda c: c.timer.due_ms):
            new = c.fire(now_ms, self.time)
            if new is not None:
                self.history.log(self.name, c.name, new, c.names, "I", self.time)

    def run(self, events: Iterable[tuple[str, DataFrame] | int]) -> None:
        """The loop of a node: bootstrap if it has not run, then a receipt and a tick for each event.

        An event is a channel (or "stdin") with a batch of messages, or a time in milliseconds, at which due periodics fire.
        Events may come without end.
        """
        if self.time == 0:
            self.bootstrap_tick()
        for e in events:
            self.fire(e) if isinstance(e, int) else self.receive(*e)
            self.tick()

    # ---- restarts

    def snapshot(self, root: str, batch: int) -> None:
        """Writes the tables and the clock below root/batch; the clock comes last and completes it. Older snapshots but one go."""
        for c in self.collections.values():
            if isinstance(c, Table):
                c.state.write.mode("overwrite").parquet(f"{root}/{batch}/{c.name}")
        self.spark.createDataFrame([(self.time, batch)], "time int, batch long").coalesce(1).write.mode("overwrite").parquet(f"{root}/{batch}/_clock")
        done = folders(self.spark, root)
        for old in sorted(int(x) for x in done if x.isdigit() and int(x) < batch)[:-1]:
            delete(self.spark, f"{root}/{old}")

    def restore(self, root: str) -> int | None:
        """Takes up the last complete snapshot; returns its batch, None if there is none."""
        for batch in sorted((int(x) for x in folders(self.spark, root) if x.isdigit()), reverse=True):
            if "_SUCCESS" in folders(self.spark, f"{root}/{batch}/_clock"):
                for c in self.collections.values():
                    if isinstance(c, Table):
                        c.take(self.spark.read.schema(c.empty.schema).parquet(f"{root}/{batch}/{c.name}"))
                self.time = self.spark.read.schema("time int, batch long").parquet(f"{root}/{batch}/_clock").first()[0]
                return batch
        return None

    def take_sent(self) -> list[tuple[str, int, DataFrame]]:
        """(channel, time, messages) that rules have sent since the last call."""
        out = [(c.name, t, df) for c in self.collections.values() if isinstance(c, Channel) for t, df in c.sent]
        for c in self.collections.values():
            if isinstance(c, Channel):
                c.sent = []
        return sorted(out, key=lambda x: x[1])


def deliver(sender: Executor, nodes: Sequence[Executor]) -> int:
    """Hands what a node has sent to the nodes addressed, one receipt for each batch and node; returns the receipts."""
    n = 0
    for channel, time, rows in sender.take_sent():
        address = F.col(f"`{rows.columns[0]}`")
        for node in nodes:
            mine = rows.where(address == node.address)
            if not mine.isEmpty():
                node.receive(channel, mine, sender.name, time)
                n += 1
    return n


def service_shim(program: Program, methods: dict[str, tuple[Sequence[tuple[str, str]], str, str, Callable[..., object]]]) -> Rules:
    """Request and reply channels for each method, and rules that answer requests by a Python function.

    methods: name -> (argument columns, reply column, its type, function of the arguments). Requests start with
    (dst_addr, src_addr, id), replies with (addr, id). Returns the rules; the program adds its own to them.
    """
    for name, (args, reply, kind, _) in methods.items():
        program.channel(f"{name}_request", [("dst_addr", "string"), ("src_addr", "string"), ("id", "bigint"), *args])
        program.channel(f"{name}_reply", [("addr", "string"), ("id", "bigint"), (reply, kind)])

    def rules(c: SimpleNamespace) -> list[Rule]:
        out = []
        for name, (_, reply, kind, f) in methods.items():
            request, answer = getattr(c, f"{name}_request"), getattr(c, f"{name}_reply")
            out.append(answer.merge(lambda now, request=request, f=f, reply=reply, kind=kind: request.scan().map_udf(lambda dst, src, i, *a: (src, i, f(*a)), f"addr string, id bigint, `{reply}` {kind}", impure=True)))
        return out

    return rules
