"""Lineage patterns of stores, as set operations over logs of writes and reads: all requests at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vclock
from ..sources.shared import written


def last_write(writes: DataFrame, reads: DataFrame, key: str, time: str, value: str, cell: int = 4096, inclusive: bool = True) -> DataFrame:
    """As-of join: reads with the last write of their key at or before them, as ``write_time`` and ``value``.

    Times are cut into cells; the last write before a cell comes from one row per key and cell, so a key that
    holds a large part of all rows is spread over its cells, and no read meets more than its cell's writes.
    """
    slot = F.floor(F.col(time) / cell)
    log = writes.select(F.col(key).alias("k"), F.col(time).alias("t"), F.lit(0 if inclusive else 1).alias("o"), F.struct(F.col(time).alias("t"), F.col(value).alias("v")).alias("w"), slot.alias("cell"), F.lit(None).cast(writes.schema[time].dataType).alias("r"))
    ask = reads.select(F.col(key).alias("k"), F.col(time).alias("t"), F.lit(1 if inclusive else 0).alias("o"), F.lit(None).cast(log.schema["w"].dataType).alias("w"), slot.alias("cell"), F.col(time).alias("r"))
    both = log.unionByName(ask)
    cells = both.groupBy("k", "cell").agg(F.max_by("w", "w.t").alias("last"))
    earlier = Window.partitionBy("k").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(F.col("k").alias("ck"), F.col("cell").alias("cc"), F.last("last", True).over(earlier).alias("carried"))
    inside = Window.partitionBy("k", "cell").orderBy("t", "o").rowsBetween(Window.unboundedPreceding, -1)
    both = both.withColumn("own", F.last("w", True).over(inside)).where("r is not null")
    out = both.join(cells, F.col("k").eqNullSafe(F.col("ck")) & (F.col("cell") == F.col("cc"))).select("k", "r", F.coalesce("own", "carried").alias("w"))
    return out.select(F.col("k").alias(key), F.col("r").alias(time), F.col("w.t").alias("write_time"), F.col("w.v").alias(value))


def _set_append_log(sets: DataFrame, appends: DataFrame, reads: DataFrame, key: str, time: str, cell: int) -> tuple[DataFrame, DataFrame]:
    """The log of sets (1), appends (2) and reads (3) with running figures inside each key's cell, and one row a key and cell
    with what earlier cells hand over. At one time a set comes before appends, and both before reads."""
    log = None
    for df, kind in ((sets, 1), (appends, 2), (reads, 3)):
        part = df.select(F.col(key).alias("k"), F.col(time).alias("t"), F.lit(kind).alias("kind"))
        log = part if log is None else log.unionByName(part)
    log = log.withColumn("cell", F.floor(F.col("t") / cell))
    up = Window.partitionBy("k", "cell").orderBy("t", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    is_set, one = F.col("kind") == 1, (F.col("kind") == 2).cast("long")
    log = log.withColumn("own_set", F.max(F.when(is_set, F.col("t"))).over(up)).withColumn("own_seen", F.sum(one).over(up))
    log = log.withColumn("own_at", F.last(F.when(is_set, F.col("own_seen")), True).over(up))
    cells = log.groupBy("k", "cell").agg(F.sum(one).alias("n"), F.max("own_set").alias("set"), F.max(F.when(is_set, F.struct("t", "own_seen")))["own_seen"].alias("at"))
    before = Window.partitionBy("k").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("seen_before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    cells = cells.withColumn("set_before", F.last("set", True).over(before)).withColumn("at_before", F.last(F.col("seen_before") + F.col("at"), True).over(before))
    cells = cells.withColumn("every", F.sum("n").over(Window.partitionBy("k")))
    return log, cells.select(F.col("k").alias("ck"), F.col("cell").alias("cc"), "seen_before", "set_before", "at_before", "every")


def set_then_appends(sets: DataFrame, appends: DataFrame, reads: DataFrame, key: str, time: str, bounded: bool = True, cell: int = 4096) -> DataFrame:
    """For each read: how many writes it depends on, the last set before it and the appends after that set.

    ``bounded`` counts appends up to the read; otherwise later ones too. Figures run inside a key's cell of time and are handed
    from cell to cell, so a key that holds a large part of all rows is spread over its cells, and no read meets all writes.
    """
    log, cells = _set_append_log(sets, appends, reads, key, time, cell)
    out = log.where("kind = 3").join(cells, F.col("k").eqNullSafe(F.col("ck")) & (F.col("cell") == F.col("cc")))
    set_at = F.coalesce("own_set", "set_before")
    at = F.when(F.col("own_set").isNotNull(), F.col("seen_before") + F.col("own_at")).otherwise(F.coalesce("at_before", F.lit(0)))
    seen = F.col("seen_before") + F.col("own_seen") if bounded else F.col("every")
    return out.select(F.col("k").alias(key), F.col("t").alias(time), set_at.alias("set_at"), (seen - at).alias("appends"))


def set_append_lineage(sets: DataFrame, appends: DataFrame, reads: DataFrame, key: str, time: str, bounded: bool = True, cell: int = 4096) -> DataFrame:
    """For each read a row for each write it depends on: kind (set or append) and write_time. Reads without a set have all appends.

    Appends are met by key and cell of time only, in the cells between the set and the read.
    """
    found = set_then_appends(sets, appends, reads, key, time, bounded, cell).select(F.col(key).alias("k"), F.col(time).alias("t"), "set_at").distinct()
    a = appends.select(F.col(key).alias("ak"), F.col(time).alias("at")).withColumn("ac", F.floor(F.col("at") / cell))
    ends = a.groupBy("ak").agg(F.min("ac").alias("lo"), F.max("ac").alias("hi")).withColumnRenamed("ak", "ek")
    first = F.greatest("lo", F.floor(F.coalesce("set_at", F.col("lo") * cell) / cell))
    last = F.least("hi", F.floor(F.col("t") / cell)) if bounded else F.col("hi")
    spread = found.join(ends, F.col("k").eqNullSafe(F.col("ek"))).where(first <= last).withColumn("c", F.explode(F.sequence(first, last)))
    after = F.col("set_at").isNull() | (F.col("at") >= F.col("set_at"))
    met = spread.join(a, F.col("k").eqNullSafe(F.col("ak")) & (F.col("c") == F.col("ac"))).where(after & (F.col("at") <= F.col("t")) if bounded else after)
    own = found.where("set_at is not null").select(F.col("k").alias(key), F.col("t").alias(time), F.lit("set").alias("kind"), F.col("set_at").alias("write_time"))
    return own.unionByName(met.select(F.col("k").alias(key), F.col("t").alias(time), F.lit("append").alias("kind"), F.col("at").alias("write_time")))


def causal_candidates(writes: DataFrame, reads: DataFrame, key: str) -> DataFrame:
    """Vector-clock lineage: (read, write) where the write's clock is not after the read's and no other such write of
    the key is after it. writes, reads: key, id, clock. Pairs are made within a key; keys are sharded by the caller."""
    w = writes.select(F.col(key).alias("k"), F.col("id").alias("write"), F.col("clock").alias("wc"))
    r = reads.select(F.col(key).alias("k"), F.col("id").alias("read"), F.col("clock").alias("rc"))
    seen = r.join(w, "k").where(~vclock.greater(F.col("wc"), F.col("rc")))
    later = seen.select("read", F.col("write").alias("write2"), F.col("wc").alias("wc2"))
    beaten = seen.join(later, "read").where(vclock.less(F.col("wc"), F.col("wc2")) & vclock.leq(F.col("wc2"), F.col("rc"))).select("read", "write").distinct()
    return seen.select("read", "write").join(beaten, ["read", "write"], "left_anti")


def byte_range(writes: DataFrame, reads: DataFrame, file: str, cell: int = 1 << 16) -> DataFrame:
    """(read, write) for each write that is the newest before the read on some byte of the read's range.

    writes: file, time, start, size; reads: file, time, start, stop. Ranges are cut into cells of bytes, so the
    join is by file and cell. Within a read's cell the ends of the writes cut it into pieces, and each piece has one newest
    write; nothing is made for each byte. Zero-length writes cover nothing.
    """
    cells = lambda a, b: F.explode(F.sequence(F.floor(a / cell), F.floor((b - 1) / cell)))
    w = writes.where("size > 0").select(F.col(file).alias("f"), F.col("time").alias("write"), F.col("start").alias("ws"), (F.col("start") + F.col("size")).alias("we"))
    w = w.select("*", cells(F.col("ws"), F.col("we")).alias("cell"))
    r = reads.where("stop > start").select(F.col(file).alias("f"), F.col("time").alias("read"), F.col("start").alias("rs"), F.col("stop").alias("re"))
    r = r.select("*", cells(F.col("rs"), F.col("re")).alias("cell"))
    p = r.join(w, ["f", "cell"]).where("write < read and ws < re and we > rs")
    lo, hi = F.greatest("ws", "rs", F.col("cell") * cell), F.least("we", "re", (F.col("cell") + 1) * cell)
    p = written(p.where(lo < hi).select("f", "read", "cell", "write", lo.alias("lo"), hi.alias("hi")), "byte-ranges")
    # a piece begins where a write begins, or where one ends inside another
    begins = p.select("f", "read", "cell", F.col("lo").alias("at")).unionByName(p.select("f", "read", "cell", F.col("hi").alias("at"))).distinct()
    begins = begins.groupBy("f", "read", "cell").agg(F.sort_array(F.collect_list("at")).alias("begins"))
    pieces = p.join(begins, ["f", "read", "cell"]).select("f", "read", "cell", "write", F.explode(F.filter("begins", lambda x: (x >= F.col("lo")) & (x < F.col("hi")))).alias("at"))
    return pieces.groupBy("f", "read", "cell", "at").agg(F.max("write").alias("write")).select("read", "write").distinct()


def copied_from(creations: DataFrame, copies: DataFrame) -> DataFrame:
    """(object, origin, steps): the newest creation that an object's content comes from, through chains of copies.

    creations: object, time; copies: object, source, time. Each round replaces an open end (object, time) by
    its newest creation or copy up to then, found by an as-of join over cells of time; ends that are creations are done.
    """
    events = creations.select("object", "time", F.lit(None).cast(copies.schema["source"].dataType).alias("source")).unionByName(copies.select("object", "time", "source"))
    events = events.select(F.col("object").alias("o"), F.col("time").alias("at"), F.struct("source", F.col("source").isNull().alias("made")).alias("v"))
    events = written(events.groupBy("o", "at").agg(F.max_by("v", "v.made").alias("v")), "copied-events")
    open_ = events.groupBy("o").agg(F.max("at").alias("upto")).select(F.col("o").alias("object"), F.col("o").alias("end"), "upto", F.lit(0).alias("steps"))
    done = None
    while True:
        asked = open_.select(F.col("end").alias("o"), F.col("upto").alias("at")).distinct()
        last = last_write(events, asked, "o", "at", "v").where("write_time is not null")
        pick = open_.join(last, (F.col("end") == F.col("o")) & (F.col("upto") == F.col("at")))
        pick = written(pick.select("object", "end", "steps", F.col("write_time").alias("at"), "v.source", "v.made"), "copied-ends")
        ended = pick.where("made").select("object", F.col("end").alias("origin"), F.col("at").alias("origin_time"), "steps")
        done = ended if done is None else done.unionByName(ended)
        more = pick.where("not made")
        if more.isEmpty():
            return done
        # a copy reads its source as of just before it
        open_ = more.select("object", F.col("source").alias("end"), (F.col("at") - 1).alias("upto"), (F.col("steps") + 1).alias("steps"))


def rank_of(lineage: DataFrame, truth: DataFrame, read: str, write: str, newest: Column) -> DataFrame:
    """Rank (from 1, newest first) of each read's true write in its lineage list; reads without it are left out."""
    ranked = lineage.withColumn("rank", F.row_number().over(Window.partitionBy(read).orderBy(newest.desc())))
    return ranked.join(truth, [read, write]).select(read, write, "rank")
