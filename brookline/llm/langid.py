"""Language identification of mixed-language text.

Script ranges narrow the candidate languages of each word; hashed letter trigrams score each word
under each candidate; Viterbi with a penalty for switching labels runs of words. A text's language
is the one whose spans hold the most letters, its score the share of letters there.

The model is fitted on a bounded sample of rows with a language: about ``max_train`` of them, drawn by a hash
of doc_id and text, with room dealt out over the languages so that a rare one is read whole and none is
left out. It is a table of trigram buckets x languages with at most ``NUMBERS`` numbers: the more languages, the fewer
buckets (2^15 for up to 128 languages). All rows are predicted, whole texts, in blocks of bounded memory.

Defined results: a null text, or one without letters (of any code point), is ``und`` with score 0; rows with a null
language are not learned from; with nothing to learn from, all texts are ``und``; ties go to the
language first in code point order; repeated rows get equal results; other columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import remainder
from .textvec import SPACE, chunks, runs

BITS, NUMBERS = 15, 1 << 22
MAX_TRAIN = 20_000
LEAST = 20  # expected rows of each language in the sample, if it has them
EVEN = 1e6  # letters that every language's counts are scaled to, so that rare languages don't gain by smoothing
SWITCH = 6.0
STEPS = 4096  # words of a text that are scored at once
#: Code point ranges of scripts, as in the Unicode block list.
SCRIPTS = [
    ("latin", 0x0041, 0x024F), ("greek", 0x0370, 0x03FF), ("cyrillic", 0x0400, 0x052F), ("armenian", 0x0530, 0x058F),
    ("hebrew", 0x0590, 0x05FF), ("arabic", 0x0600, 0x077F), ("devanagari", 0x0900, 0x097F), ("bengali", 0x0980, 0x09FF),
    ("tamil", 0x0B80, 0x0BFF), ("telugu", 0x0C00, 0x0C7F), ("thai", 0x0E00, 0x0E7F), ("georgian", 0x10A0, 0x10FF),
    ("hangul", 0x1100, 0x11FF), ("latin", 0x1E00, 0x1EFF), ("greek", 0x1F00, 0x1FFF), ("kana", 0x3040, 0x30FF),
    ("han", 0x3400, 0x9FFF), ("hangul", 0xAC00, 0xD7AF), ("latin", 0xFF21, 0xFF5A),
]
NAMES = [*dict.fromkeys(n for n, _, _ in SCRIPTS), "other"]


#: Letters have code points below this one: of those above, none is a letter in Unicode.
POINTS = 1 << 18


@functools.cache
def letters() -> tuple[np.ndarray, np.ndarray]:
    """For code points below POINTS: the lower-case letter (0: not a letter), and the script."""
    low, script = np.zeros(POINTS, np.uint32), np.full(POINTS, len(NAMES) - 1, np.uint8)
    for c in range(POINTS):
        x = chr(c)
        if x.isalpha():
            y = x.lower()
            low[c] = ord(y) if len(y) == 1 else c
    for name, a, b in SCRIPTS:
        script[a : b + 1] = NAMES.index(name)
    return low, script


def spelled(data: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """The letters of a chunk in words: trigram bucket and script of each, the word of each, the row of each word."""
    low, script = letters()
    cp = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    row_at = np.searchsorted(lead, off)  # row offsets in code points
    cp = np.where(cp < POINTS, cp, 0)
    gap = np.zeros(len(cp) + 1, bool)
    gap[row_at] = True
    gap[:-1] |= SPACE[np.minimum(cp, 255)] & (cp < 256)
    unit = np.cumsum(gap[:-1])
    at = np.flatnonzero(low[cp])
    letter, unit = low[cp[at]].astype(np.uint64), unit[at]
    new = np.ones(len(at), bool)
    new[1:] = unit[1:] != unit[:-1]
    before, after = np.concatenate([[np.uint64(0)], letter[:-1]]) if len(at) else letter, np.concatenate([letter[1:], [np.uint64(0)]]) if len(at) else letter
    before = np.where(new, np.uint64(0), before)
    after = np.where(np.concatenate([new[1:], [True]]) if len(at) else new, np.uint64(0), after)
    h = (before * np.uint64(0x9E3779B1) + letter) * np.uint64(0x85EBCA77C2B2AE63) + after * np.uint64(0xC2B2AE3D27D4EB4F)
    first = np.flatnonzero(new)
    return {"bucket": ((h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(49)).astype(np.int64), "script": script[cp[at]], "first": first, "row": np.searchsorted(row_at, at[first], "right") - 1}


def _level(counts: list[int], room: int) -> float:
    """The greatest level at which rows cut off at it fit into the room."""
    left, by = room, sorted(counts)
    for i, n in enumerate(by):
        if n * (len(by) - i) >= left:
            return left / (len(by) - i)
        left -= n
    return float(by[-1]) if by else 0.0


def fit(train: DataFrame, max_train: int = MAX_TRAIN, numbers: int = NUMBERS) -> dict:
    """train: doc_id, text, lang. The model: languages, log probabilities by bucket, candidates by script."""
    train = train.where("lang is not null and text is not null")
    sizes = sorted(((r[0], r[1]) for r in train.groupBy("lang").count().collect()), key=lambda x: x[0].encode())  # a row for each language
    k, top = len(sizes), 1 << 30
    if not k:
        return {"names": [], "log": np.zeros((1, 0), np.float32), "candidates": np.ones((len(NAMES), 0), bool), "shift": 0}
    level = max(LEAST, _level([n for _, n in sizes], max_train))
    bits = BITS
    while k << bits > numbers and bits > 6:
        bits -= 1
    buckets = 1 << bits
    size = buckets + len(NAMES)
    share = train.sparkSession.createDataFrame([(x, i, min(top, int(top * level / n) + 1)) for i, (x, n) in enumerate(sizes)], "of string, i int, below long")
    key = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), "text"), F.lit(top))
    sample = train.join(F.broadcast(share) if k <= 1 << 16 else share, F.col("lang") == F.col("of")).where(key < F.col("below"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k * size, np.int64)
        for b in batches:
            langs = b.column(1).to_numpy()
            for c in chunks(b.column(0)):
                x = spelled(c.data, c.off)
                row = np.repeat(x["row"], np.diff(np.concatenate([x["first"], [len(x["bucket"])]])))
                base = langs[c.rows][row].astype(np.int64) * size
                at = np.concatenate([base + (x["bucket"] >> (BITS - bits)), base + buckets + x["script"]])
                if len(at) * 8 > len(total):
                    total += np.bincount(at, minlength=len(total))
                else:
                    np.add.at(total, at, 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["at", "n"])

    seen = sample.select("text", "i").mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()  # ``numbers`` rows at most, and one for each script and language
    n = np.zeros(k * size)
    n[seen.column("at").to_numpy()] = seen.column("n").to_numpy()
    n = n.reshape(k, size).T
    held = np.flatnonzero(n[:buckets].sum(0))
    names, grams, scripts = [sizes[i][0] for i in held], n[:buckets, held], n[buckets:, held]
    log = np.log((grams * (EVEN / np.maximum(grams.sum(0), 1)) + 0.5) / (EVEN + 0.5 * buckets))
    log = (log - log.mean(1, keepdims=True)).astype(np.float32) if names else log.astype(np.float32)
    candidates = scripts >= 0.01 * np.maximum(scripts.sum(0), 1)
    candidates[~candidates.any(1)] = True
    return {"names": names, "log": log, "candidates": candidates, "shift": BITS - bits}


def viterbi(scores: np.ndarray | Callable[[np.ndarray], np.ndarray], row: np.ndarray, rows: int, switch: float) -> np.ndarray:
    """The best language index of each word; row is ascending. All rows take a step at a time, longest first.

    scores: words x languages, or a function of word indexes that gives their rows; it is called for STEPS
    words of each row at once, so that memory does not grow with words x languages.
    """
    n = len(row)
    length = np.bincount(row, minlength=rows)
    start = np.concatenate([[0], np.cumsum(length)])[:-1]
    order = np.argsort(-length, kind="stable")
    start, length = start[order], length[order]
    steps = int(length[0]) if n else 0
    active = np.searchsorted(-length, -np.arange(steps), "left")  # rows longer than t
    of = scores if callable(scores) else lambda at: scores[at]
    k = of(np.zeros(0, np.int64)).shape[1]
    moved, best = np.zeros((n, -(-k // 8)), np.uint8), np.zeros(n, np.int16 if k < 1 << 15 else np.int32)
    v = np.zeros((rows, k), np.float32)
    for t in range(steps):
        m = active[t]
        if t % STEPS == 0:
            many = np.minimum(length[:m], t + STEPS) - t
            s, off = of(runs(start[:m] + t, many)), np.cumsum(many) - many - t
        at, x = start[:m] + t, v[:m]
        if t:
            b = x.argmax(1)
            top = x[np.arange(m), b][:, None] - np.float32(switch)
            moved[at], best[at] = np.packbits(top > x, axis=1), b
            x = np.maximum(x, top)
        v[:m] = x + s[off[:m] + t]
    label, out = np.zeros(rows, np.int64), np.zeros(n, best.dtype)
    for t in range(steps - 1, -1, -1):
        m = active[t]
        at = start[:m] + t
        ends = length[:m] == t + 1
        label[:m] = np.where(ends, v[:m].argmax(1), label[:m])
        out[at] = label[:m]
        gone = moved[at, label[:m] >> 3] >> (7 - (label[:m] & 7)).astype(np.uint8) & 1
        label[:m] = np.where(gone == 1, best[at], label[:m])
    return out


def predict(docs: DataFrame, model: dict, keep: list[Column], switch: float = SWITCH) -> DataFrame:
    """keep columns, then lang_pred, score, spans: (first word, end word, language), counting words with letters."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        names, k = np.array(["und", *m["names"]], object), len(m["names"])
        limit = min(4 << 20, max(1 << 16, (16 << 20) // max(1, k)))
        for b in batches:
            for c in chunks(b.column(b.num_columns - 1), limit):
                x = spelled(c.data, c.off)
                first, row, rows = x["first"], x["row"], len(c)
                lang, score = np.zeros(rows, np.int64), np.zeros(rows)
                spans, span_off = (np.zeros(0, np.int64),) * 3, np.zeros(rows + 1, np.int32)
                if k and len(first):
                    size = np.diff(np.concatenate([first, [len(x["bucket"])]]))
                    bucket = x["bucket"] >> m["shift"]

                    def scores(at: np.ndarray, m=m, x=x, bucket=bucket, size=size, first=first) -> np.ndarray:
                        s = np.zeros((len(at), k), np.float32)
                        block = max(1, (1 << 21) // k)
                        for lo in range(0, len(at), block):
                            part = at[lo : lo + block]
                            n = size[part]
                            s[lo : lo + block] = np.add.reduceat(m["log"][bucket[runs(first[part], n)]], np.cumsum(n) - n)
                        s[~m["candidates"][x["script"][first[at]]]] = -50.0
                        return np.maximum(s, s.max(1, keepdims=True) - 20) if len(at) else s  # one odd word can't outweigh its neighbours

                    label = viterbi(scores, row, rows, switch)
                    total = np.bincount(row, size, rows)
                    # letters by row and language, of the languages that occur only
                    pair, inverse = np.unique(row * k + label, return_inverse=True)
                    held = np.bincount(inverse, size)
                    by = np.lexsort((pair % k, -held, pair // k))
                    lead = by[np.searchsorted((pair // k)[by], np.flatnonzero(total))]
                    lang[pair[lead] // k] = pair[lead] % k + 1
                    score[pair[lead] // k] = held[lead] / total[pair[lead] // k]
                    cut = np.ones(len(label), bool)
                    cut[1:] = (label[1:] != label[:-1]) | (row[1:] != row[:-1])
                    at = np.flatnonzero(cut)
                    base = np.searchsorted(row, np.arange(rows))[row[at]]
                    spans = (at - base, np.concatenate([at[1:], [len(label)]]) - base, label[at].astype(np.int64) + 1)
                    span_off = np.searchsorted(row[at], np.arange(rows + 1)).astype(np.int32)
                parts = pa.StructArray.from_arrays([pa.array(spans[0], pa.int32()), pa.array(spans[1], pa.int32()), pa.array(names[spans[2]], pa.string())], ["start", "end", "lang"])
                kept = [b.column(i).slice(c.rows.start, rows) for i in range(b.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(names[lang], pa.string()), pa.array(score), pa.ListArray.from_arrays(pa.array(span_off), parts)], [*b.schema.names[:-1], "lang_pred", "score", "spans"])

    given = docs.select(*keep, "text")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema.fields[:-1])
    return given.mapInArrow(run, f"{fields}, lang_pred string, score double, spans array<struct<start:int,end:int,lang:string>>")


def query(docs: DataFrame) -> DataFrame:
    held = remainder("doc_id", 5) == 0
    model = fit(docs.where(~held).select("doc_id", "text", "lang"))
    found = predict(docs, model, [F.col("doc_id"), held.alias("held_out")])
    return found.select("doc_id", "held_out", "lang_pred", "score", F.size("spans").alias("n_spans"))
