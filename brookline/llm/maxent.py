"""Language-model scoring: a hashed maximum-entropy model with class-factored softmax.

Counts. Every task counts the words of its texts; Spark sums the counts by word hash over all training
texts. Every text's words are then looked up: the ``head`` most frequent words (a fixed number) are
sent to all tasks as an array; the rest is joined with the counts by hash, as (word, text) rows that
each task has already summed.

Model. All words of the head are in nested classes of ``WIDE`` members by rank: P(token | history) is the product of one
softmax over WIDE members for each class on the way to the token, two for the most frequent words, up to five for the rarest.
One class holds the words outside the head, where a word's share is its smoothed count. A softmax sums
the bias row of its class, which starts at the log of the counts (so an untrained model is the base), and hashed
rows of weights for the features: previous token, the token before it (skip), and in the outermost softmax both together.

Rounds of distributed gradient updates: in round k the texts whose hash falls in slice k are read;
each task takes Adagrad steps from the shared weights, the weight changes of all tasks are summed
by Spark per row in proportion to their tokens, and the next round starts there. Every
training text is used once. The weights are a table of fixed size.

Scoring runs over batches of tokens: gathered weight rows, softmaxes, sums by text.

Defined results: a null text is empty and has one token, its end; a null doc_id is hashed as
empty text; repeated rows count each time in training and get equal scores; without training texts the
counts are 0 and the model is the base; other columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import remainder, written
from .textvec import LOWER, Chunk, chunks, hash_words, mix, runs, words

HEAD = 1 << 17
WIDE = 16
#: Nibbles of a word's place within each outermost class: six classes of 16 words, four of 256, three of 4096, two of 65536. One more holds all other words.
DEPTHS = (1, 1, 1, 1, 1, 1, 2, 2, 2, 2, 3, 3, 3, 4, 4)
LEVELS = 1 + max(DEPTHS)
TAIL = len(DEPTHS)
FEATURES = 1 << 16  # rows of weights, beside one for each class
ROUNDS = 2
RATE = 0.3
END = np.uint64(0x5EED5EED5EED5EED)


def tokens(c: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of each row, then its end; the row of each."""
    w = words(c)
    h = hash_words(LOWER[c.data], w)
    n = w.per_row + 1
    out = np.full(len(w) + len(c), END)
    last = np.cumsum(n) - 1
    inside = np.ones(len(out), bool)
    inside[last] = False
    out[inside] = h
    return out, np.repeat(np.arange(len(c)), n)


def counts(texts: DataFrame) -> DataFrame:
    """text. word (hash), c: counts over all texts, summed per task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            u, inv = np.unique(np.concatenate([x for x, _ in held]), return_inverse=True)
            return u, np.bincount(inv, np.concatenate([x for _, x in held])).astype(np.int64)

        def batch(u: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(n)], ["word", "c"])

        for b in batches:
            for c in chunks(b.column(0)):
                held.append(np.unique(tokens(c)[0], return_counts=True))
                if sum(len(x) for x, _ in held) > 3_000_000:
                    held = [merged()]
                    if len(held[0][0]) > 1_500_000:  # bounded memory: hand on and start anew
                        yield batch(*held[0])
                        held = []
        if held:
            yield batch(*merged())

    return texts.select("text").mapInArrow(run, "word long, c long").groupBy("word").agg(F.sum("c").alias("c"))


@functools.cache
def tree() -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """For each rank of the head, then for the words outside: softmaxes on its way, their classes, its members of them; and the number of classes."""
    n = 1 + sum(WIDE**d for d in DEPTHS)
    depth, node, child = np.ones(n, np.int8), np.zeros((n, LEVELS), np.int32), np.zeros((n, LEVELS), np.int8)
    first, classes = 0, 1
    for k, d in enumerate(DEPTHS):
        place, mine = np.arange(WIDE**d), slice(first, first + WIDE**d)
        depth[mine], child[mine, 0] = 1 + d, k
        for j in range(d):
            node[mine, j + 1] = classes + place // WIDE ** (d - j)
            child[mine, j + 1] = place // WIDE ** (d - 1 - j) % WIDE
            classes += WIDE**j
        first += WIDE**d
    child[-1, 0] = TAIL
    return depth, node, child, classes


@dataclass
class Model:
    head: np.ndarray  # sorted hashes of the most frequent tokens
    head_c: np.ndarray
    rank: np.ndarray  # of each of them, by count
    total: int
    distinct: int
    tail_mass: float
    w: np.ndarray  # rows of classes, then rows of features

    def look_up(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each token is in the head, and its index there."""
        if not len(self.head):
            return np.zeros(len(h), bool), np.zeros(len(h), np.int64)
        i = np.minimum(np.searchsorted(self.head, h), len(self.head) - 1)
        return self.head[i] == h, i

    def ranks(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        known, i = self.look_up(h)
        return known, i, np.where(known, self.rank[i], len(tree()[0]) - 1) if len(self.rank) else np.full(len(h), len(tree()[0]) - 1)


def untrained(head: np.ndarray, c: np.ndarray, total: int, distinct: int) -> Model:
    """head, c: words and counts, the most frequent first. The bias of each member is the log of its smoothed count: the base."""
    depth, node, child, classes = tree()
    order = np.argsort(head)
    tail = float(total - c.sum() + 0.5 * (distinct + 1 - len(c)))
    mass = np.zeros(classes * WIDE)
    for j in range(LEVELS):
        at = np.flatnonzero(depth[: len(c)] > j)
        mass += np.bincount(node[at, j] * WIDE + child[at, j], c[at] + 0.5, len(mass))
    mass[TAIL] = tail
    mass = mass.reshape(classes, WIDE)
    share = mass / np.maximum(mass.sum(1, keepdims=True), 1e-9)
    w = np.zeros((classes + FEATURES, WIDE), np.float32)
    w[:classes] = np.where(mass > 0, np.log(np.maximum(share, 1e-13)), -30.0)
    return Model(head[order], c[order], order.astype(np.int64), total, distinct, tail, w)


def histories(token: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of each token's features: the previous token, the one before, both. A text's first ones have a beginning before them."""
    one = np.concatenate([np.zeros(1, np.uint64), token[:-1]])
    two = np.concatenate([np.zeros(2, np.uint64), token[:-2]])[: len(token)]
    same1, same2 = np.zeros(len(token), bool), np.zeros(len(token), bool)
    same1[1:], same2[2:] = row[1:] == row[:-1], row[2:] == row[:-2]
    one, two = np.where(same1, one, np.uint64(1)), np.where(same2, two, np.uint64(1))
    return mix(one + np.uint64(11)), mix(two + np.uint64(13)), mix(one * np.uint64(31) + mix(two) + np.uint64(12))


def softmaxes(rank: np.ndarray, f: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """All softmaxes of some tokens, the outermost of each first: whose they are, the member taken, and rows of weights to be summed (the last list is for the outermost ones only)."""
    depth, node, child, classes = tree()
    d = depth[rank]
    of = [np.flatnonzero(d > j) for j in range(int(d.max()) if len(d) else 1)]
    token = np.concatenate(of)
    cls, took = (np.concatenate([a[rank[at], j] for j, at in enumerate(of)]) for a in (node, child))
    salt = mix(cls.astype(np.uint64) + np.uint64(1 << 40))
    hashed = lambda h, s: (classes + (mix(h ^ s) & np.uint64(FEATURES - 1)).astype(np.int64))
    return token, took.astype(np.int64), [cls.astype(np.int64), hashed(f[0][token], salt), hashed(f[1][token], salt + np.uint64(1)), hashed(f[2], salt[: len(rank)] + np.uint64(2))]


def _logits(w: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
    s = w.take(rows[0], 0)
    for r in rows[1:]:
        s[: len(r)] += w.take(r, 0)
    return s


def log_p(m: Model, rank: np.ndarray, f: tuple) -> np.ndarray:
    """Natural log probability of each token; for one outside the head that of its class."""
    token, took, rows = softmaxes(rank, f)
    s = _logits(m.w, rows)
    s -= s.max(1, keepdims=True)
    own = s[np.arange(len(took)), took].astype(float)
    return np.bincount(token, own - np.log(np.exp(s).sum(1)), len(rank))


def _steps(m: Model, h: np.ndarray, row: np.ndarray, squares: np.ndarray, rate: float) -> None:
    """Adagrad steps on the tokens, a block at a time; changes m's weights."""
    rank = m.ranks(h)[2]
    f = histories(h, row)
    for lo in range(0, len(h), 8192):
        part = slice(lo, lo + 8192)
        _, took, rows = softmaxes(rank[part], tuple(x[part] for x in f))
        s = _logits(m.w, rows)
        s -= s.max(1, keepdims=True)
        np.exp(s, out=s)
        s /= s.sum(1, keepdims=True)
        s[np.arange(len(took)), took] -= 1
        at, g = _summed(rows, s)
        sq = squares.take(at, 0) + g * g
        squares[at] = sq
        m.w[at] -= rate * g / np.sqrt(sq + 1)


def _summed(rows: list[np.ndarray], g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows of all features, and the sum of gradients of each; most are held once or a few times."""
    key = np.concatenate([(r.astype(np.uint64) << np.uint64(20)) | np.arange(len(r), dtype=np.uint64) for r in rows])
    key.sort()
    at, src = (key >> np.uint64(20)).astype(np.int64), (key & np.uint64((1 << 20) - 1)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    many = np.diff(np.concatenate([first, [len(at)]]))
    out = g.take(src[first], 0)
    for k in range(1, 4):
        more = np.flatnonzero((many > k) & (many <= 4))
        out[more] += g.take(src[first[more] + k], 0)
    hot = np.flatnonzero(many > 4)
    if len(hot):
        size = many[hot]
        out[hot] = np.add.reduceat(g.take(src[runs(first[hot], size)], 0), np.cumsum(size) - size)
    return at[first], out


def fit(train: DataFrame, counted: DataFrame, head: int = HEAD, rounds: int = ROUNDS, rate: float = RATE) -> Model:
    """train: doc_id, text; counted: word, c of the same texts."""
    total, distinct = counted.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    # the most frequent words: whole cells of log count, as many as fit into ``head``
    cell = F.floor(F.log2("c") * 16)
    cells = sorted(((r[0], r[1]) for r in counted.groupBy(cell.alias("cell")).count().collect()), reverse=True)  # 1024 at most
    held, least = 0, None
    for x, n in cells:
        held += n
        if held > head:
            break
        least = x
    top = counted.where(cell >= F.lit(least) if least is not None else F.lit(False)).toArrow()
    h, c = top.column("word").to_numpy().view(np.uint64), top.column("c").to_numpy()
    by = np.lexsort((h, -c))
    m = untrained(h[by], c[by], int(total), int(distinct))
    spark = train.sparkSession
    slices = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), "text", F.lit("slice")), F.lit(rounds))
    for k in range(rounds):
        sent = spark.sparkContext.broadcast(m)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            old = sent.value
            mine = Model(old.head, old.head_c, old.rank, old.total, old.distinct, old.tail_mass, old.w.copy())
            squares, n = np.zeros_like(mine.w), 0
            for b in batches:
                for c in chunks(b.column(0)):
                    t, row = tokens(c)
                    _steps(mine, t, row, squares, rate)
                    n += len(t)
            used = np.flatnonzero((mine.w != old.w).any(1))
            delta = (mine.w - old.w)[used] * np.float32(n)
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(np.full(len(used), float(n))), pa.ListArray.from_arrays(pa.array(np.arange(len(used) + 1, dtype=np.int32) * WIDE), pa.array(delta.ravel()))], ["row", "n", "delta"])

        changes = train.where(slices == k).select("text").mapInArrow(run, "row int, n double, delta array<float>")
        summed = changes.groupBy("row").agg(F.sum("n").alias("n"), *[F.sum(F.get("delta", F.lit(i))).alias(f"d{i}") for i in range(WIDE)]).toArrow()
        w, row, n = m.w.copy(), summed.column("row").to_numpy(), np.maximum(summed.column("n").to_numpy(), 1)
        for i in range(WIDE):
            w[row, i] += (summed.column(f"d{i}").to_numpy() / n).astype(np.float32)
        m = Model(m.head, m.head_c, m.rank, m.total, m.distinct, m.tail_mass, w)
        sent.unpersist()
    return m


def score(docs: DataFrame, m: Model, counted: DataFrame, keep: list[Column]) -> DataFrame:
    """keep columns, n_tokens, n_known, train_tokens, base_score, score (both log10)."""
    sent = docs.sparkSession.sparkContext.broadcast(m)
    given = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), F.coalesce("text", F.lit("")).alias("text"))
    kind = given.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        base = m.total + 0.5 * (m.distinct + 1)
        log_base, log_tail = np.log10(base), np.log10(m.tail_mass) if m.tail_mass > 0 else 0.0
        for b in batches:
            for c in chunks(b.column(2)):
                h, row = tokens(c)
                known, i, rank = m.ranks(h)
                f = histories(h, row)
                lp = np.concatenate([log_p(m, rank[lo : lo + 16384], tuple(x[lo : lo + 16384] for x in f)) for lo in range(0, len(h), 16384)]) / np.log(10)
                own = np.log10(np.where(known, m.head_c[i] if len(m.head_c) else 0, 0) + 0.5)
                lp -= np.where(known, 0.0, log_tail)
                size = np.bincount(row, minlength=len(c))
                sums = [np.bincount(row, x, len(c)) for x in (known, np.where(known, own, 0.0) - log_base, lp)]
                # words outside the head: one row for each text and word, to be joined with the counts
                out = np.flatnonzero(~known)
                pair = np.stack([row[out].astype(np.uint64), h[out]], 1)
                by = np.lexsort((pair[:, 1], pair[:, 0]))
                pair = pair[by]
                new = np.ones(len(pair), bool)
                new[1:] = (pair[1:] != pair[:-1]).any(1)
                at = np.flatnonzero(new)
                times = np.diff(np.concatenate([at, [len(pair)]]))
                own_rows = np.arange(c.rows.start, c.rows.start + len(c))
                rows = pa.array(np.concatenate([own_rows, own_rows[pair[at, 0].astype(np.int64)]]))
                none = lambda k, t: pa.nulls(k, t)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).take(rows), b.column(1).take(rows), pa.concat_arrays([none(len(c), pa.int64()), pa.array(pair[at, 1].view(np.int64))]), pa.array(np.concatenate([size, times]).astype(np.int64)),
                        *(pa.concat_arrays([pa.array(x), none(len(at), pa.float64())]) for x in sums),
                    ],
                    ["doc_id", "h", "word", "n", "known", "base", "model"],
                )

    found = written(given.mapInArrow(run, f"doc_id {kind}, h long, word long, n long, known double, base double, model double"), "maxent-scored")
    # a word that few texts hold may still fill a large part of all rows: its rows are summed with the count attached by a join that Spark can split
    tail = found.where("word is not null").select("doc_id", "h", "word", "n").join(counted.select(F.col("word").alias("w"), "c"), F.col("word") == F.col("w"), "left")
    tail = tail.groupBy("doc_id", "h").agg(F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("t_known"), F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + F.lit(0.5))).alias("t_log"))
    tail = tail.withColumnsRenamed({"doc_id": "td", "h": "th"})
    # equal rows have equal keys: their own figures are the same, those of the tail have been added up
    same = lambda d, h, e, g: F.col(d).eqNullSafe(F.col(e)) & (F.col(h) == F.col(g))
    whole = found.where("word is null").groupBy("doc_id", "h").agg(F.count("*").alias("rows"), *[F.first(c).alias(c) for c in ("n", "known", "base", "model")]).join(tail, same("doc_id", "h", "td", "th"), "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    whole = whole.select(
        F.col("doc_id").alias("kd"), F.col("h").alias("kh"), F.col("n").alias("n_tokens"), (F.col("known") + zero("t_known") / F.col("rows")).cast("long").alias("n_known"), F.lit(m.total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce(F.col("t_log") / F.col("rows"), F.lit(0.0))).alias("base_score"), (F.col("model") + F.coalesce(F.col("t_log") / F.col("rows"), F.lit(0.0))).alias("score"),
    )
    rows = docs.select(F.col("doc_id").alias("__d"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("__h"), *keep)
    return rows.join(whole, same("__d", "__h", "kd", "kh")).drop("__d", "__h", "kd", "kh")


def query(docs: DataFrame) -> DataFrame:
    held = remainder("doc_id", 5) == 1
    train = docs.where(~held).select("doc_id", "text")
    counted = written(counts(train), "maxent-counts")
    return score(docs, fit(train, counted), counted, [F.col("doc_id"), held.alias("held_out")])
