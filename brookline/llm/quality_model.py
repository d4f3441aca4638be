"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or abstain on every text. Expectation-maximisation
(two classes, votes independent given the class) estimates each labeller's accuracy without true
labels. Votes form at most 3^8 patterns, so counting patterns over all texts, pre-aggregated in every
task, is all that EM needs from the corpus. The posterior of a text's pattern is its soft label; on a
bounded sample (at most ``max_train`` texts, those with the smallest hash of doc_id and text, equal rows once, and
at most ``max_pairs`` features) the soft labels train a linear scorer over hashed features: shapes of words, pairs of shapes, and cells of the
labellers' statistics. Every text is scored; those under ``threshold`` are rejected.

Defined results: a null text, or one without words, has no evidence: all labellers abstain and its score is that
of the bias alone, but it is not kept, since it holds nothing; null doc_ids are kept as they are; repeated rows
get equal scores; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_written, written
from .textvec import LOWER, Chunk, chunks, hash_words, mix, words

BUCKETS = 1 << 14
MAX_TRAIN, MAX_PAIRS = 20_000, 12_000_000
CELLS = 12
THRESHOLD = 0.1  # a text is rejected on clear evidence only
#: name, least share for one vote, and for the other: (statistic, good below, bad above) or the reverse where good > bad.
LABELLERS = (
    ("symbols", 0.05, 0.3),  # symbol characters a word
    ("tails", 0.05, 0.3),  # words that end in two or more punctuation marks
    ("capitals", 0.2, 0.5),  # capitals among ASCII letters
    ("bars", 0.02, 0.15),  # words that are one punctuation mark
    ("stutter", 0.03, 0.2),  # words equal to the one before
    ("repeats", 0.5, 0.8),  # words seen before in the text, scaled for length
    ("lines", 0.2, 0.5),  # lines seen before in the text
    ("sameness", 0.25, 0.4),  # share of the most frequent word
)
N = len(LABELLERS)
_CLASS = np.full(256, 1, np.uint8)
_CLASS[ord("a") : ord("z") + 1] = _CLASS[0x80:] = 1
_CLASS[ord("A") : ord("Z") + 1] = 2
_CLASS[ord("0") : ord("9") + 1] = 3
_PUNCT = np.zeros(256, bool)
_PUNCT[[x for x in range(0x21, 0x7F) if not chr(x).isalnum()]] = True
_CLASS[_PUNCT] = np.flatnonzero(_PUNCT)
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(x) for x in "#*$%&|<>^~=\\{}[]@_"]] = True
_LINE = np.zeros(256, bool)
_LINE[0x0A] = True


def _repeated(key: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Items of each row seen before in it, and the count of its most frequent item."""
    order = np.lexsort((key, row))
    k, r = key[order], row[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (r[1:] != r[:-1])
    at = np.flatnonzero(new)
    runs = np.diff(np.concatenate([at, [len(k)]]))
    most = np.zeros(rows, np.int64)
    np.maximum.at(most, r[at], runs)
    return np.bincount(r, ~new, rows), most


def statistics(c: Chunk) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """rows x labellers, and what the features are made of."""
    w, data, rows = words(c), c.data, len(c)
    n = np.maximum(w.per_row, 1)
    h = hash_words(LOWER[data], w)
    punct = _PUNCT[data]
    last, before = (np.maximum(w.end - k, 0) for k in (1, 2))
    tail = punct[last] & punct[before] & (w.end - w.start > 2) if len(w) else np.zeros(0, bool)
    bar = punct[last] & (w.end - w.start == 1) if len(w) else np.zeros(0, bool)
    upper, lower = c.per_row(_CLASS[data] == 2), c.per_row((data >= 0x61) & (data <= 0x7A))
    same = np.zeros(len(w), bool)
    same[1:] = (h[1:] == h[:-1]) & (w.row[1:] == w.row[:-1])
    seen, most = _repeated(h, w.row, rows)
    lw = words(c, _LINE)
    again, _ = _repeated(hash_words(data, lw), lw.row, rows)
    by = lambda x: np.bincount(w.row, x, rows) / n
    s = np.stack(
        [
            c.per_row(_SYMBOL[data]) / n, by(tail), upper / np.maximum(upper + lower, 1), by(bar), by(same),
            (seen / n) / np.minimum(1.0, 0.5 + n / 2000), again / np.maximum(lw.per_row, 1), np.where(w.per_row >= 20, most / n, 0.0),
        ], 1,
    )
    cls = _CLASS[data]
    change = np.ones(len(data), bool)
    change[1:] = cls[1:] != cls[:-1]
    if len(w):
        change[w.start] = True
    return s, {"n": w.per_row, "row": w.row, "shape": hash_words(cls, w, change)}


def votes(s: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A pattern of votes for each row: base-3 digits, 0 abstain, 1 good, 2 bad."""
    code = np.zeros(len(s), np.int64)
    for k, (_, good, bad) in enumerate(LABELLERS):
        v = np.where(s[:, k] <= good, 1, np.where(s[:, k] >= bad, 2, 0))
        code += np.where(n > 0, v, 0) * 3**k
    return code


def expectation_maximisation(pattern: np.ndarray, count: np.ndarray, rounds: int = 50) -> dict[str, np.ndarray]:
    """Prior of good, accuracies P(vote | class) as labellers x class x vote, and the posterior of every pattern."""
    every = (np.arange(3**N)[:, None] // 3 ** np.arange(N)) % 3
    seen, total = every[pattern], count.astype(float)
    good, bad = (seen == 1).sum(1), (seen == 2).sum(1)
    q = (good + 1) / (good + 3 * bad + 2)  # a start that leans to bad where any labeller says so
    prior, table = 0.5, np.full((N, 2, 3), 1 / 3)
    for _ in range(rounds if len(pattern) else 0):
        prior = float((q * total).sum() / total.sum())
        for k in range(N):
            for cls, weight in ((0, (1 - q) * total), (1, q * total)):
                x = np.bincount(seen[:, k], weight, 3) + 1.0
                table[k, cls] = x / x.sum()
        q = _posterior(seen, prior, table)
    return {"prior": np.array(prior), "accuracy": table, "posterior": _posterior(every, prior, table)}


def _posterior(v: np.ndarray, prior: float, table: np.ndarray) -> np.ndarray:
    log = np.stack([np.log(np.maximum(p, 1e-9)) + sum(np.log(table[k, cls])[v[:, k]] for k in range(N)) for cls, p in ((0, 1 - prior), (1, prior))], 1)
    d = np.clip(log[:, 0] - log[:, 1], -50, 50)
    return 1 / (1 + np.exp(d))


def features(s: np.ndarray, x: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, bucket and weight: shares of word shapes and of pairs of them, and cells of the statistics."""
    row, shape = x["row"], x["shape"]
    pair = np.flatnonzero(row[1:] == row[:-1]) if len(row) else row
    h = np.concatenate([mix(shape + np.uint64(1)), mix(shape[pair] * np.uint64(31) + shape[pair + 1] + np.uint64(2))])
    r = np.concatenate([row, row[pair]])
    bucket = (h >> np.uint64(50)).astype(np.int64)
    key, times = np.unique(r * BUCKETS + bucket, return_counts=True)
    n = np.maximum(x["n"], 1)
    rows = key // BUCKETS
    cell = np.minimum((s * CELLS).astype(np.int64), CELLS)
    ids = (mix(np.arange(N * (CELLS + 1), dtype=np.uint64) + np.uint64(1 << 50)) >> np.uint64(50)).astype(np.int64).reshape(N, CELLS + 1)
    some = np.flatnonzero(x["n"] > 0)
    return (
        np.concatenate([rows, np.repeat(some, N)]),
        np.concatenate([key % BUCKETS, ids[np.arange(N), cell[some]].ravel()]),
        np.concatenate([times / n[rows], np.full(len(some) * N, 1.0)]),
    )


def labellers(docs: DataFrame) -> dict[str, np.ndarray]:
    """EM over the vote patterns of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(3**N, np.int64)
        for b in batches:
            for c in chunks(b.column(0)):
                s, x = statistics(c)
                n += np.bincount(votes(s, x["n"]), minlength=3**N)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], ["pattern", "n"])

    seen = docs.select("text").mapInArrow(run, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).toArrow().sort_by("pattern")
    return expectation_maximisation(seen.column("pattern").to_numpy(), seen.column("n").to_numpy())


def sampled(docs: DataFrame, em: dict[str, np.ndarray], max_train: int = MAX_TRAIN, max_pairs: int = MAX_PAIRS) -> pa.Table:
    """k, q, bucket, weight of the training sample: soft labels and features. Rows and bytes are bounded, whatever ids repeat."""
    top = 1 << 62
    total = max(1, docs.count())
    docs = docs.where(F.length("text") > 0).withColumn("k", F.shiftrightunsigned(F.xxhash64(F.col("doc_id").cast("string"), "text"), 2))
    few = docs.where(F.col("k") < F.lit(min(top - 1, top // total * max_train)))
    last = few.select("k").distinct().orderBy("k").limit(max_train).agg(F.max("k")).first()[0]
    posterior = em["posterior"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in chunks(b.column(1)):
                s, x = statistics(c)
                row, bucket, weight = features(s, x)
                by = np.argsort(row, kind="stable")
                off = pa.array(np.searchsorted(row[by], np.arange(len(c) + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(c.rows.start, len(c)), pa.array(posterior[votes(s, x["n"])]), pa.ListArray.from_arrays(off, pa.array(bucket[by].astype(np.int32))), pa.ListArray.from_arrays(off, pa.array(weight[by].astype(np.float32)))], ["k", "q", "bucket", "weight"])

    kind = "k long, q double, bucket array<int>, weight array<float>"
    if last is None:
        return docs.sparkSession.createDataFrame([], kind).toArrow()
    made = written(few.where(F.col("k") <= last).select("k", "text").mapInArrow(run, kind).dropDuplicates(["k"]), "quality-sample")
    sizes = made.select("k", F.size("bucket").alias("n")).toArrow().sort_by("k")  # narrow rows, ``max_train`` at most
    fits = np.cumsum(sizes.column("n").to_numpy()) <= max_pairs
    upto = sizes.column("k").to_numpy()[max(0, int(fits.sum()) - 1)]
    got = made.where(F.col("k") <= int(upto)).toArrow().sort_by("k")
    drop_written(made)
    return got


def train(docs: DataFrame, em: dict[str, np.ndarray], max_train: int = MAX_TRAIN, passes: int = 60, max_pairs: int = MAX_PAIRS) -> np.ndarray:
    """Weights of the scorer, the bias last. docs: doc_id, text."""
    got = sampled(docs, em, max_train, max_pairs)
    w, sq = np.zeros(BUCKETS + 1), np.full(BUCKETS + 1, 1e-3)
    if not got.num_rows:
        return w
    q = got.column("q").to_numpy()
    lists = got.column("bucket").combine_chunks()
    row = np.repeat(np.arange(len(q)), np.diff(lists.offsets.to_numpy()))
    bucket, weight = lists.values.to_numpy(), got.column("weight").combine_chunks().values.to_numpy().astype(float)
    for _ in range(passes):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, weight * w[bucket], len(q)) + w[-1], -30, 30)))
        g = (p - q) / len(q)
        grad = np.append(np.bincount(bucket, weight * g[row], BUCKETS), g.sum()) + 1e-6 * w
        sq += grad * grad * len(q)
        w -= 0.5 * grad * np.sqrt(len(q)) / np.sqrt(sq)
    return w


def classify(docs: DataFrame, w: np.ndarray, em: dict[str, np.ndarray], keep: list[Column], threshold: float = THRESHOLD) -> DataFrame:
    """keep columns, score, posterior, n_words, kept."""
    sent = docs.sparkSession.sparkContext.broadcast((w, em["posterior"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, posterior = sent.value
        for b in batches:
            for c in chunks(b.column(b.num_columns - 1)):
                s, x = statistics(c)
                row, bucket, weight = features(s, x)
                p = 1 / (1 + np.exp(-np.clip(np.bincount(row, weight * w[bucket], len(c)) + w[-1], -30, 30)))
                kept = [b.column(i).slice(c.rows.start, len(c)) for i in range(b.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(p), pa.array(posterior[votes(s, x["n"])]), pa.array(x["n"].astype(np.int64)), pa.array((p >= threshold) & (x["n"] > 0))], [*b.schema.names[:-1], "score", "posterior", "n_words", "kept"])

    given = docs.select(*keep, "text")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema.fields[:-1])
    return given.mapInArrow(run, f"{fields}, score double, posterior double, n_words long, kept boolean")


def fit_and_classify(docs: DataFrame, keep: list[Column], threshold: float = THRESHOLD, max_train: int = MAX_TRAIN) -> DataFrame:
    em = labellers(docs)
    return classify(docs, train(docs.select("doc_id", "text"), em, max_train), em, keep, threshold)


def accepted(docs: DataFrame, **options: object) -> DataFrame:
    """The documents that the classifier keeps, with the columns of docs."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")
    return fit_and_classify(docs, [row], **options).where("kept").select("__row.*")


def query(docs: DataFrame) -> DataFrame:
    return fit_and_classify(docs, [F.col("doc_id")])
