"""Near-duplicates: SuperMinHash signatures, banding, verification on full sets, union-find groups.

A text's set is its distinct 5-word shingles (words lower-cased A-Z); with fewer words the whole
sequence is the one shingle. Texts are linked where 100 * |intersection| >= 75 * |union|.

1. Texts with the same word sequence form a class; only its smallest doc_id goes on.
2. SuperMinHash: every shingle gets, level by level, the next slot of its own random permutation and
   a random rank; level j holds ranks in [j, j + 1), so a document stops at the first level that
   can't lower any slot. All documents of a chunk take a level at once.
3. ``bands`` bands of ``rows`` signature slots. A pair at 0.75 misses all 32 bands of 4 with
   probability 5e-6.
4. In every bucket of a band the member that shares most buckets with others is the pivot, and all
   members are compared with it on the full sets. A base text and its copies are one component then.
5. The texts that share a bucket with a pivot are its group; every candidate pair lies in a group. In
   groups that still hold two or more components, those outside the pivot's component are compared
   with the others on the full sets, in blocks of bounded bytes and rows: large groups are cut by distance to
   the pivot, and by the triangle inequality most block pairs need no comparison. Pairs within a
   component are not made, only links are emitted, and no group is collected.
6. Links are grouped by union-find inside each task, then by star contraction across tasks.

Defined results: null or empty texts have n_shingles 0 and are their own component; a null doc_id
is never linked (it has no id to report) and is its own row with a null component; repeated rows
and ties share the class of the smallest doc_id; empty tables give no rows; other columns are
ignored, whatever their names; a doc_id that is not of an integer type is an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import beside, drop_written, written
from .textvec import LOWER, Chunk, chunks, hash_words, mix, windows, words

SLOTS, ROWS, WIDTH = 128, 4, 5
BLOCK_BYTES, BLOCK_ROWS = 2 << 20, 2000
SLICE = 1024  # rows of a block that are compared at once
PAIRS = 2000  # pairs with one pivot that a task gets
PERCENT = 75
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def shingles(c: Chunk, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes of a chunk in row order, where each row's start, and a key of each row's word sequence."""
    w = words(c)
    h = hash_words(LOWER[c.data], w)
    s, at = windows(h, w.row, width)
    row = w.row[at]
    short = np.flatnonzero((w.per_row > 0) & (w.per_row < width))
    order = np.arange(len(w)) - w.first[w.row]
    weight = mix((order.astype(np.uint64) + np.uint64(1)) * _GOLDEN) | np.uint64(1)
    zero = np.zeros(1, np.uint64)
    a, b = (np.concatenate([zero, np.cumsum(x, dtype=np.uint64)]) for x in (h * weight, mix(h ^ weight)))
    key = np.stack([mix(a[w.first[1:]] - a[w.first[:-1]]), mix(b[w.first[1:]] - b[w.first[:-1]] + w.per_row.astype(np.uint64))], 1)
    s, row = np.concatenate([s, key[short, 0]]), np.concatenate([row, short])
    by = np.lexsort((s, row))
    s, row = s[by], row[by]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (row[1:] != row[:-1])
    s, row = s[new], row[new]
    return s, np.searchsorted(row, np.arange(len(c) + 1)), key


def superminhash(s: np.ndarray, first: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """Signatures (rows x slots) of sets given as runs of hashes: level * 2^32 + rank; all ones for an empty set."""
    rows = len(first) - 1
    out = np.full(rows * slots, ~np.uint64(0))
    row = np.repeat(np.arange(rows), np.diff(first))
    perm = None
    for level in range(slots):
        if not len(s):
            break
        r = mix(s + np.uint64((level + 1) * int(_GOLDEN) % (1 << 64)))
        k = level + ((r >> np.uint64(32)) * np.uint64(slots - level) >> np.uint64(32)).astype(np.int64)
        if level == 0:
            pos = k
        else:
            i = np.arange(len(s))
            pos = perm[i, k].astype(np.int64)
            perm[i, k] = perm[i, level]
        np.minimum.at(out, row * slots + pos, np.uint64(level << 32) | (r & np.uint64(0xFFFFFFFF)))
        open_ = out.reshape(rows, slots).max(1) >= np.uint64((level + 1) << 32)
        go = open_[row]
        if level == 0:
            s, row, k = s[go], row[go], k[go]
            perm = np.broadcast_to(np.arange(slots, dtype=np.uint8 if slots <= 256 else np.uint16), (len(s), slots)).copy()
            perm[np.arange(len(s)), k] = 0
        elif not go.all():
            s, row, perm = s[go], row[go], perm[go]
    return out.reshape(rows, slots)


def signatures(docs: DataFrame, slots: int = SLOTS, rows: int = ROWS, width: int = WIDTH) -> DataFrame:
    """docs: doc_id, text. doc_id, n_shingles, key_a, key_b, bands (one hash a band)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in chunks(b.column(1)):
                s, first, key = shingles(c, width)
                sig = superminhash(s, first, slots)
                n = np.diff(first)
                band = np.zeros((len(c), slots // rows), np.uint64)
                for k in range(rows):
                    band = band * _GOLDEN + mix(sig[:, k::rows])
                band = mix(band + np.arange(slots // rows, dtype=np.uint64) * _GOLDEN).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).slice(c.rows.start, len(c)), pa.array(n), pa.array(key[:, 0].view(np.int64)), pa.array(key[:, 1].view(np.int64)),
                        pa.ListArray.from_arrays(pa.array(np.arange(len(c) + 1, dtype=np.int32) * band.shape[1]), pa.array(band.ravel())),
                    ],
                    ["doc_id", "n_shingles", "key_a", "key_b", "bands"],
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_shingles long, key_a long, key_b long, bands array<long>")


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b. node, comp: the smallest node reachable, for nodes with an edge.

    Each task contracts its own edges by union-find; then large-star and small-star steps until
    nothing changes. Edges are kept as (larger, smaller).
    """

    def union_find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (p := parent.setdefault(x, x)) != x:
                parent[x] = x = parent[p]
            return x

        for batch in batches:
            for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x, y = root(x), root(y)
                parent[max(x, y)] = min(x, y)
            if len(parent) > 1_000_000:  # bounded memory: hand on what is contracted so far
                yield forest(parent, root)
                parent.clear()
        yield forest(parent, root)

    def forest(parent: dict[int, int], root) -> pa.RecordBatch:
        pairs = [(x, root(x)) for x in list(parent)]
        pairs = [(x, r) for x, r in pairs if x != r]
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in pairs], pa.int64()), pa.array([r for _, r in pairs], pa.int64())], ["hi", "lo"])

    e = written(edges.select("a", "b").mapInArrow(union_find, "hi long, lo long").distinct(), "neardup-edges")
    while True:
        # large star: every neighbour above a node goes to the least of the node and its neighbours
        both = e.unionByName(e.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        least = both.groupBy(F.col("hi").alias("node")).agg(F.least(F.min("lo"), F.col("hi")).alias("least"))
        large = e.join(least, e["lo"] == least["node"]).select("hi", F.col("least").alias("lo"))
        large = large.where("hi > lo")
        # small star: a node and its neighbours below go to the least of them
        below = large.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("least"))
        small = large.join(below, large["hi"] == below["node"]).select(F.explode(F.array(F.struct(F.col("hi"), F.col("least").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("least").alias("lo")))).alias("e")).select("e.*")
        new = written(small.where("hi > lo").distinct(), "neardup-edges")
        old_sum = e.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        new_sum = new.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        drop_written(e)
        e = new
        if old_sum == new_sum:
            break
    roots = e.select(F.col("lo").alias("node"), F.col("lo").alias("comp")).distinct()
    return e.select(F.col("hi").alias("node"), F.col("lo").alias("comp")).unionByName(roots)


def _label(df: DataFrame, comps: DataFrame, column: str, name: str) -> DataFrame:
    """df with the component of the id in ``column``: the id itself where it has no link yet."""
    c = comps.select(F.col("node").alias("__n"), F.col("comp").alias("__c"))
    return df.join(c, F.col(column) == F.col("__n"), "left").withColumn(name, F.coalesce("__c", column)).drop("__n", "__c")


def _similarity(pairs: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """pairs a, b with the sizes of intersection and union of their full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both, union = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                sets = []
                for i in (2, 3):
                    mine: list[np.ndarray] = []
                    for c in chunks(part.column(i)):
                        h, first, _ = shingles(c, width)
                        mine += np.split(h, first[1:-1])
                    sets.append(mine)
                for k, (x, y) in enumerate(zip(*sets, strict=True)):
                    both[lo + k] = len(np.intersect1d(x, y, assume_unique=True))
                    union[lo + k] = len(x) + len(y) - both[lo + k]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(both), pa.array(union)], ["a", "b", "both", "all"])

    # a pivot may stand in a large part of all pairs: its text goes to a task for every PAIRS of them
    parts = pairs.groupBy("b").agg(F.ceil(F.count("*") / PAIRS).cast("int").alias("parts"))
    dealt = beside(pairs.select("a", "b"), parts, ["b"]).withColumn("part", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int")).drop("parts")
    right = texts.toDF("b", "tb").join(parts, "b").select("b", "tb", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    joined = dealt.join(texts.toDF("a", "ta"), "a").join(right, ["b", "part"]).select("a", "b", "ta", "tb")
    return joined.mapInArrow(run, "a long, b long, both long, all long")


def _compared(rows: DataFrame, percent: int, width: int) -> DataFrame:
    """Links between the members of each block pair.

    rows: pivot, s, t, other (False: of block s, not of t), stray, id, comp, text; all rows of a block pair come
    one after another. Strays are compared with all members of other components, SLICE at a time: a
    product of 0/1 matrices over the shingles that both sides have counts every intersection.
    """

    def links(ids: list[int], comps: list[int], mine: list[bool], against: list[bool], texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        sets: list[np.ndarray] = []
        for c in chunks(pa.array(texts, pa.large_string())):
            h, first, _ = shingles(c, width)
            sets += np.split(h, first[1:-1])
        doc, comp, lefts, right = np.array(ids), np.array(comps), np.flatnonzero(mine), np.flatnonzero(against)
        size = np.array([len(x) for x in sets])
        y = [sets[i] for i in right]
        hy, ry = np.concatenate(y), np.repeat(np.arange(len(y)), size[right])
        for left in np.split(lefts, np.arange(SLICE, len(lefts), SLICE)):
            x = [sets[i] for i in left]
            hx, rx = np.concatenate(x), np.repeat(np.arange(len(x)), size[left])
            both = np.intersect1d(hx, hy)
            counts = np.zeros((len(x), len(y)))
            for part in np.split(both, np.arange(2048, len(both), 2048)):
                sides = []
                for h, r, n in ((hx, rx, len(x)), (hy, ry, len(y))):
                    at = np.minimum(np.searchsorted(part, h), max(0, len(part) - 1))
                    hit = part[at] == h if len(part) else np.zeros(len(h), bool)
                    m = np.zeros((n, len(part)), np.float32)
                    m[r[hit], at[hit]] = 1
                    sides.append(m)
                counts += sides[0] @ sides[1].T
            union = size[left][:, None] + size[right] - counts
            ok = (counts > 0) & (100 * counts >= percent * union) & (comp[left][:, None] != comp[right])
            i, j = np.nonzero(ok)
            yield doc[left[i]], doc[right[j]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def done() -> Iterator[pa.RecordBatch]:
            other, stray, ids, comps, texts = (list(x) for x in zip(*held, strict=True))
            same = not any(other) and key[1] == key[2]
            for a, b in links(ids, comps, [st if same else o for o, st in zip(other, stray, strict=True)], [not o for o in other], texts):
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for b in batches:
            cols = [c.to_pylist() for c in b.columns]
            for pivot, s, t, *rest in zip(*cols, strict=True):
                if (pivot, s, t) != key and held:
                    yield from done()
                    held = []
                key = (pivot, s, t)
                held.append(rest)
        if held:
            yield from done()

    order = ["pivot", "s", "t"]
    rows = rows.select(*order, "other", "stray", "id", "comp", "text").repartition(*[F.col(c) for c in order]).sortWithinPartitions(*order)
    return rows.mapInArrow(run, "a long, b long").distinct()


def _block_pairs(groups: DataFrame, texts: DataFrame, block_bytes: int, near: float, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """groups: pivot, id, d, comp, stray. The rows of the block pairs that may hold links, as _compared takes them.

    A group of up to ``block_bytes`` and ``block_rows`` is one block: short texts make many rows, and memory goes with rows. Larger ones are cut into
    strays and others, by distance to the pivot, then by hash, so that each pair of two blocks of strays, or of
    strays and others, is compared whole and once. Of two blocks whose distances differ by more than ``near`` no pair can be
    linked (triangle inequality), and blocks without strays are not compared with one another. The distance says nothing where
    an id has several texts, or the pivot has: these stand in cell 0, which meets all cells.
    """
    sized = texts.groupBy("id").agg(F.sum(F.octet_length("text")).alias("bytes"), F.count("*").alias("rows"))
    g = groups.join(sized, "id")
    parts = F.greatest(F.sum("bytes") / block_bytes, F.sum("rows") / block_rows)
    vague = F.max((F.col("id") == F.col("pivot")) & (F.col("rows") > 1))
    g = beside(g, g.groupBy("pivot").agg(parts.alias("total"), vague.alias("vague")), ["pivot"])
    whole = F.col("total") <= 1
    cell = F.when(whole | F.col("vague") | (F.col("rows") > 1), F.lit(0)).otherwise(F.floor(F.col("d") * 16) + 1).cast("int")
    g = g.withColumn("cell", cell).withColumn("apart", ~whole & F.col("stray"))
    n = g.groupBy("pivot", "cell", "apart").agg(F.ceil(parts).cast("int").alias("parts"))
    g = beside(g, n, ["pivot", "cell", "apart"]).withColumn("block", F.struct("cell", "apart", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part")))
    g = written(g.select("pivot", "id", "comp", "stray", "block"), "neardup-blocks")
    blocks = g.groupBy("pivot", "block").agg(F.max("stray").alias("stray"))
    reach = int(near * 16) + 1
    pairs = blocks.where("stray").select("pivot", F.col("block").alias("s")).join(blocks.select("pivot", F.col("block").alias("t"), F.col("stray").alias("t_stray")), "pivot")
    close = (F.abs(F.col("s.cell") - F.col("t.cell")) <= reach) | (F.col("s.cell") == 0) | (F.col("t.cell") == 0)
    # two blocks of strays meet once
    pairs = pairs.where(close & (~F.col("t_stray") | (F.col("s") <= F.col("t")))).select("pivot", "s", "t")
    right = g.join(pairs.withColumn("block", F.col("t")), ["pivot", "block"]).withColumn("other", F.lit(False))
    left = g.where("stray").join(pairs.where("s != t").withColumn("block", F.col("s")), ["pivot", "block"]).withColumn("other", F.lit(True))
    return right.unionByName(left).join(texts, "id")


def near_duplicates(docs: DataFrame, percent: int = PERCENT, slots: int = SLOTS, rows: int = ROWS, width: int = WIDTH, block_bytes: int = BLOCK_BYTES, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """docs: doc_id, text, other columns ignored. Per row: doc_id, n_shingles, component_id, kept, class_id."""
    if docs.schema["doc_id"].dataType.typeName() not in ("byte", "short", "integer", "long", "void"):
        raise TypeError(f"doc_id is {docs.schema['doc_id'].dataType.simpleString()}, not an integer")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sigs = written(signatures(docs, slots, rows, width), "neardup-signatures")
    named = sigs.where("n_shingles > 0 and doc_id is not null")
    best = F.min_by("bands", "doc_id")
    classes = written(named.groupBy("key_a", "key_b").agg(F.min("doc_id").alias("id"), F.count("*").alias("n"), best.alias("bands")), "neardup-classes")
    bands = classes.select("id", F.explode("bands").alias("band")).distinct()
    shared = bands.groupBy("band").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("band")
    found = written(bands.join(shared, "band"), "neardup-buckets")
    ids = found.select("id").distinct()
    texts = written(docs.join(ids, docs["doc_id"] == ids["id"]).groupBy("id", F.xxhash64("text")).agg(F.first("text").alias("text")).select("id", "text"), "neardup-texts")
    linked = F.col("both") * 100 >= F.col("all") * percent

    # every member of a bucket against its pivot, the member that shares most buckets with others
    sized = found.join(found.groupBy("band").agg(F.count("*").alias("n")), "band")
    sized = sized.join(sized.groupBy("id").agg(F.sum("n").alias("weight")), "id")
    pivot = sized.groupBy("band").agg(F.max(F.struct("weight", (-F.col("id")).alias("id"))).alias("p")).select("band", (-F.col("p.id")).alias("pivot"))
    sized = written(sized.join(pivot, "band").select("band", "id", "n", "pivot"), "neardup-sized")
    star = sized.where("id != pivot").select(F.col("id").alias("a"), F.col("pivot").alias("b")).distinct()
    star = written(_similarity(star, texts, width).groupBy("a", "b").agg(F.max_by(F.struct("both", "all"), F.col("both") / F.col("all")).alias("s")).select("a", "b", "s.*"), "neardup-star")
    edges = star.where(linked).select("a", "b")
    comps = written(components(edges), "neardup-components")
    away = star.select(F.col("a").alias("id"), F.col("b").alias("pivot"), (1 - F.col("both") / F.col("all")).alias("d"))
    groups = sized.select("pivot", "id").distinct().join(away, ["id", "pivot"], "left").withColumn("d", F.coalesce("d", F.lit(0.0)))
    of = written(_label(groups.select("pivot").distinct(), comps, "pivot", "of"), "neardup-pivots")
    groups = beside(_label(groups, comps, "id", "comp"), of, ["pivot"])
    groups = written(groups.withColumn("stray", F.col("comp") != F.col("of")), "neardup-groups")
    open_ = written(groups.groupBy("pivot").agg(F.max("stray").alias("any")).where("any").select("pivot"), "neardup-open")
    rest = written(_compared(_block_pairs(beside(groups, open_, ["pivot"]), texts, block_bytes, 1 - percent / 100, block_rows), percent, width), "neardup-links")
    comps = written(components(edges.unionByName(rest)), "neardup-components")
    many = classes.where("n > 1").select("key_a", "key_b", F.col("id").alias("class_id"))
    out = sigs.select("doc_id", "n_shingles", "key_a", "key_b").join(many, ["key_a", "key_b"], "left")
    out = out.withColumn("class_id", F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id")).otherwise(F.col("doc_id")))
    out = _label(out, comps, "class_id", "component_id")
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"), "class_id")


def deduplicated(docs: DataFrame, **options: object) -> DataFrame:
    """The documents of which each group keeps the one with the smallest doc_id; equal rows stay once."""
    found = near_duplicates(docs, **options).groupBy("doc_id").agg(F.max("kept").alias("kept"), F.count("*").alias("rows"))
    found = found.where("not kept or rows > 1").withColumnRenamed("doc_id", "id")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    d = rows.join(found, F.col("row.doc_id") == F.col("id"), "left").where("kept is null or kept")
    once = d.where("rows > 1").withColumn("hash", F.xxhash64("row.text")).dropDuplicates(["id", "hash"])
    return d.where("rows is null").select("row").unionByName(once.select("row")).select(*[F.col(f"row.`{c}`") for c in docs.columns])


def query(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs)
