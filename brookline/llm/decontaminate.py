"""Benchmark decontamination by template windows.

Texts are made canonical: case and punctuation go, and numbers, names (capitalised words, of any script with
capitals) and units after a number become typed placeholders. A run of one type is one placeholder, so a value may
have any number of words. Windows of ``width`` canonical words of each text are hash-joined with those
of the benchmark items (an item shorter than that is one window). Whether a capitalised word that opens a sentence is
a name can't be told from the text, so both readings are kept. Each text has six kinds of windows:

* ``TEMPLATE``: capitalised words inside a sentence are names;
* ``OPENED``: those that open a sentence are names too;
* ``FOLDED``: names are plain words, so a copy in other case is found although its names can't be told;
* ``EXACT``: every word is plain, for items made of values and for verbatim passages;
* ``SHORT``, ``SHORT_OPENED``: template words without joining runs, for items of at most ``width`` words.

Template, opened and folded windows count where they hold ``least_words`` plain words, short ones where they hold one. The windows of one kind,
text and item are joined over all diagonals (shifts) in ascending order of both, where staying on a
diagonal is preferred. They are a match where they are ``coverage`` of the item's windows, or cover
``covered`` of the words that its windows hold (inserted words split windows, not words), or are a verbatim
passage of ``verbatim`` words; its slots, the values under placeholders, must map consistently: an item's
value to one value of the text. So a question with other numbers or names is caught.

Windows of the texts first pass a bitmap of fixed size (2^26 bits) made of the items' window
hashes, so only likely partners are shuffled; the join itself is exact on 64-bit hashes. The bitmap
is the only broadcast and does not grow.

Defined results: null or empty texts and items match nothing; null ids are kept as they are;
repeated rows get equal results; empty tables give no matches; other columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .textvec import LOWER, Chunk, chunks, hash_words, mix, windows, words

WIDTH = 8
BITS = 26
#: Names of units, as they stand after a number.
UNITS = (
    "mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams kilogram kilograms pound pounds ounce ounces lb oz "
    "ml l liter liters litre litres gallon gallons second seconds minute minutes hour hours day days week weeks month months year years "
    "percent dollar dollars cent cents euro euros degree degrees watt watts volt volts mph kmh meter meters metre metres"
).split()
NUMBER, NAME, UNIT = np.uint64(101), np.uint64(102), np.uint64(103)
TEMPLATE, FOLDED, EXACT, SHORT, OPENED, SHORT_OPENED = range(6)

_KEEP = np.zeros(256, bool)
_KEEP[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_DIGIT, _UPPER, _STOP = (np.zeros(256, bool) for _ in range(3))
_DIGIT[0x30:0x3A] = True
_UPPER[0x41:0x5B] = True
_STOP[[ord(x) for x in ".!?:\n"]] = True


@functools.cache
def _cases() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For code points below 2^16: the lower-case one (itself if it has none of as many bytes), whether it is a capital, a small or caseless letter."""
    low, upper, small = np.arange(1 << 16), np.zeros(1 << 16, bool), np.zeros(1 << 16, bool)
    for c in range(0x80, 1 << 16):
        x = chr(c)
        if x.isalpha():
            y = x.lower()
            upper[c], small[c] = x.isupper() or x.istitle(), not (x.isupper() or x.istitle())
            if len(y) == 1 and 0x80 <= ord(y) < 1 << 16 and (c < 0x800) == (ord(y) < 0x800):
                low[c] = ord(y)
    return low, upper, small


def _folded(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The lower-cased bytes of UTF-8 text, and where capitals and other letters begin."""
    out, upper, small = LOWER[data], _UPPER[data], (data >= 0x61) & (data <= 0x7A)
    if (data >= 0x80).any():
        low, is_upper, is_small = _cases()
        two, three = np.flatnonzero((data & 0xE0) == 0xC0), np.flatnonzero((data & 0xF0) == 0xE0)
        byte = lambda at: data[at].astype(np.int64)
        point = (((byte(two) & 0x1F) << 6) | (byte(two + 1) & 0x3F), ((byte(three) & 0x0F) << 12) | ((byte(three + 1) & 0x3F) << 6) | (byte(three + 2) & 0x3F))
        for at, cp in zip((two, three), point, strict=True):
            upper[at], small[at] = is_upper[cp], is_small[cp]
            to = low[cp]
            at, to = at[to != cp], to[to != cp]
            if at.size and to.max() < 0x800:
                out[at], out[at + 1] = 0xC0 | (to >> 6), 0x80 | (to & 0x3F)
            elif at.size:
                out[at], out[at + 1], out[at + 2] = 0xE0 | (to >> 12), 0x80 | ((to >> 6) & 0x3F), 0x80 | (to & 0x3F)
        small |= (data & 0xF8) == 0xF0
    return out, upper, small


def canonical(c: Chunk) -> dict[str, np.ndarray]:
    """Words of a chunk with letters or digits: value hash, row, and whether a number, a unit, a capitalised word, the opening of a sentence stand there."""
    w = words(c)
    data = c.data
    low, upper, small = _folded(data)
    value = hash_words(low, w, _KEEP[data])
    digits = np.concatenate([[0], np.cumsum(_DIGIT[data])])
    kept = np.concatenate([[0], np.cumsum(_KEEP[data])])
    number = (digits[w.end] - digits[w.start] > 0) & (2 * (digits[w.end] - digits[w.start]) >= kept[w.end] - kept[w.start])
    stops = np.concatenate([[0], np.cumsum(_STOP[data])])
    opens = np.ones(len(w), bool)  # first of its row, or a stop since the last word's start
    opens[1:] = (w.row[1:] != w.row[:-1]) | (stops[w.start[1:]] > stops[w.start[:-1]])
    smalls = np.concatenate([[0], np.cumsum(small)])
    capital = (upper[w.start] if len(w) else np.zeros(0, bool)) & ~number & (smalls[w.end] > smalls[w.start])
    has = kept[w.end] > kept[w.start]
    x = {"value": value[has], "row": w.row[has], "number": number[has], "capital": capital[has], "opens": opens[has]}
    after = np.zeros(len(x["row"]), bool)
    after[1:] = x["number"][:-1] & (x["row"][1:] == x["row"][:-1])
    return {**x, "unit": after & ~x["number"] & np.isin(x["value"], _units())}


def _typed(x: dict[str, np.ndarray], name: np.ndarray) -> dict[str, np.ndarray]:
    """Template words: placeholders for numbers, units and these names."""
    template = np.where(x["number"], NUMBER, np.where(name, NAME, np.where(x["unit"], UNIT, x["value"])))
    return {"template": template, "value": x["value"], "row": x["row"], "slot": x["number"] | name | x["unit"]}


@functools.cache
def _units() -> np.ndarray:
    (c,) = chunks(pa.array([" ".join(UNITS)]))
    return hash_words(c.data, words(c))


def _joined(x: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Runs of one type of placeholder as one. Its value is that of the run; for names that of the last word, as any capitalised word may stand before a name."""
    n = len(x["row"])
    new = np.ones(n, bool)
    new[1:] = ~x["slot"][1:] | (x["template"][1:] != x["template"][:-1]) | ~x["slot"][:-1] | (x["row"][1:] != x["row"][:-1])
    at = np.flatnonzero(new)
    if len(at) == n:
        return x
    place = (np.arange(n) - at[np.cumsum(new) - 1]).astype(np.uint64)
    value = np.add.reduceat(np.where(place > 0, mix(x["value"] + place), x["value"]), at)
    value = np.where(x["template"][at] == NAME, x["value"][np.concatenate([at[1:], [n]]) - 1], value)
    return {"template": x["template"][at], "value": value, "row": x["row"][at], "slot": x["slot"][at]}


def kinds(c: Chunk) -> tuple[dict[str, np.ndarray], ...]:
    """The words of a chunk in the six kinds."""
    x = canonical(c)
    inside, opened, folded = (_typed(x, name) for name in (x["capital"] & ~x["opens"], x["capital"], np.zeros(len(x["row"]), bool)))
    exact = {**folded, "template": x["value"], "slot": np.zeros(len(x["row"]), bool)}
    return _joined(inside), _joined(folded), exact, inside, _joined(opened), opened


def _template_windows(x: dict[str, np.ndarray], kind: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and index of the first word of each window of n canonical words."""
    h, at = windows(x["template"], x["row"], n)
    return mix(h ^ np.uint64(n + (kind << 32))), at


def _emit(b: pa.RecordBatch, c: Chunk, x: dict, h: np.ndarray, at: np.ndarray, kind: int, n: int, first: np.ndarray) -> pa.RecordBatch:
    """Key columns, kind, words, hash as long, position of the window in the text, slot values in order (none if exact)."""
    row = x["row"][at]
    held = 0 if kind == EXACT else n
    slots = np.stack([np.where(x["slot"][at + k], x["value"][at + k], np.uint64(0)) for k in range(n)], 1).view(np.int64) if len(at) and held else np.zeros((0, n), np.int64)
    off = np.arange(len(at) + 1, dtype=np.int32) * held
    keys = [b.column(i).take(pa.array(row + c.rows.start)) for i in range(b.num_columns - 1)]
    same = [pa.array(np.full(len(at), v, np.int32)) for v in (kind, n)]
    return pa.RecordBatch.from_arrays([*keys, *same, pa.array(h.view(np.int64)), pa.array((at - first[row]).astype(np.int32)), pa.ListArray.from_arrays(pa.array(off), pa.array(slots.ravel()))], [*b.schema.names[:-1], "kind", "n", "window", "pos", "slots"])


WINDOW = "kind int, n int, window long, pos int, slots array<long>"


def item_windows(items: DataFrame, width: int = WIDTH, least_words: int = 4) -> DataFrame:
    """items: item_id, text. item_id, kind, n, window, pos, slots, n_windows and n_words of the item in that kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in chunks(b.column(1)):
                for kind, x in enumerate(kinds(c)):
                    first = np.searchsorted(x["row"], np.arange(len(c)))
                    count = np.bincount(x["row"], minlength=len(c))
                    plain = np.concatenate([[0], np.cumsum(~x["slot"])])
                    for n in range(1, width + 1):
                        h, at = _template_windows(x, kind, n)
                        words_in = count[x["row"][at]]
                        if kind in (SHORT, SHORT_OPENED):
                            ok = (words_in == n) & (plain[at + n] > plain[at])
                        else:
                            ok = (np.minimum(words_in, width) == n) & ((plain[at + n] - plain[at] >= least_words) | (kind == EXACT))
                        yield _emit(b, c, x, h[ok], at[ok], kind, n, first)

    kind = items.schema["item_id"].dataType.simpleString()
    w = items.select("item_id", "text").mapInArrow(run, f"item_id {kind}, {WINDOW}").distinct()
    covered = F.array_distinct(F.flatten(F.collect_set(F.expr("sequence(pos, pos + n - 1)"))))
    n = w.groupBy("item_id", "kind").agg(F.countDistinct("pos").alias("n_windows"), F.size(covered).alias("n_words"))
    n = n.withColumnsRenamed({"item_id": "i", "kind": "k"})
    return w.join(n, F.col("item_id").eqNullSafe(F.col("i")) & (F.col("kind") == F.col("k"))).drop("i", "k")


def bitmap(item_win: DataFrame, bits: int = BITS) -> np.ndarray:
    """2^bits bits, set where an item's window hash falls; made per partition of the hash space, so of fixed size on the driver."""
    slots = item_win.select(F.shiftrightunsigned("window", 64 - bits).alias("s")).distinct()
    packed = slots.groupBy(F.shiftright("s", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s % 64 as int))")).alias("bits")).toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[packed.column("word").to_numpy()] = packed.column("bits").to_numpy()
    return out.view(np.uint64)


def _chain(hits: list[tuple]) -> list[int]:
    """The longest chain of hits (pos, item_pos, ...), in order of pos, that ascends in both; a change of diagonal costs half a hit."""
    places = {p: i + 1 for i, p in enumerate(sorted({h[1] for h in hits}))}
    tree: list[tuple[float, int]] = [(0.0, -1)] * (len(places) + 1)  # Fenwick tree of maxima over item positions
    diagonal: dict[int, tuple[float, int]] = {}
    back, best, at = [-1] * len(hits), (0.0, -1), 0
    while at < len(hits):
        end = at
        new = []
        while end < len(hits) and hits[end][0] == hits[at][0]:
            pos, item_pos = hits[end][:2]
            score, before = diagonal.get(pos - item_pos, (0.0, -1))
            i = places[item_pos] - 1
            while i > 0:
                if tree[i][0] - 0.5 > score:
                    score, before = tree[i][0] - 0.5, tree[i][1]
                i &= i - 1
            back[end] = before
            new.append((score + 1, end))
            end += 1
        for x in new:
            pos, item_pos = hits[x[1]][:2]
            diagonal[pos - item_pos] = x
            i = places[item_pos]
            while i < len(tree):
                if x[0] >= tree[i][0]:
                    tree[i] = x
                i += i & -i
            best = max(best, x)
        at = end
    out, k = [], best[1]
    while k >= 0:
        out.append(k)
        k = back[k]
    return out[::-1]


def _longest_run(hits: list[tuple]) -> int:
    """The most hits of one diagonal without a gap."""
    last: dict[tuple[int, int], int] = {}
    for pos, item_pos, *_ in hits:
        last[pos, item_pos] = last.get((pos - 1, item_pos - 1), 0) + 1
    return max(last.values())


def judged(hits: list[tuple], kind: int, n: int, n_windows: int, n_words: int, coverage: float, covered: float, consistent: float, verbatim: int) -> tuple[float, float] | None:
    """Coverage and agreement of the best match of one text with an item; hits: pos, item_pos, pairs of slot values."""
    hits = sorted(hits, key=lambda h: h[:2])
    found: list[tuple[float, float]] = []

    def judge(some: list[tuple]) -> None:
        at = {h[1] for h in some}
        share = len(at) / n_windows
        words_held = len({p + k for p in at for k in range(n)}) if share < coverage else 0
        if share >= coverage or words_held >= covered * n_words or (kind == EXACT and _longest_run(some) + n - 1 >= verbatim):
            pairs = {p for h in some for p in h[2]}
            agree = len({p[0] for p in pairs}) / len(pairs) if pairs else 1.0
            if agree >= consistent:
                found.append((share, agree))

    diagonals: dict[int, list[tuple]] = {}
    for h in hits:
        diagonals.setdefault(h[0] - h[1], []).append(h)
    for some in diagonals.values():
        judge(some)
    # a chain whose slots disagree gives way to the next one
    while not found and len(diagonals) > 1:
        places = len({h[1] for h in hits})
        if places < coverage * n_windows and places * n < covered * n_words:
            break
        chain = _chain(hits)
        judge([hits[k] for k in chain])
        gone = set(chain)
        hits = [h for k, h in enumerate(hits) if k not in gone]
    return (max(x for x, _ in found), max(y for _, y in found)) if found else None


def matches(docs: DataFrame, items: DataFrame, width: int = WIDTH, coverage: float = 0.5, consistent: float = 0.9, least_words: int = 4, bits: int = BITS, covered: float = 0.8, verbatim: int = 13) -> DataFrame:
    """doc_id, text_hash, item_id, coverage, slots_agreeing: texts that hold an item or a variant of it."""
    item_win = written(item_windows(items, width, least_words), "decontaminate-items")
    sorts = sorted((r[0], r[1]) for r in item_win.select("kind", "n").distinct().collect())  # at most 6 x ``width``
    sent = docs.sparkSession.sparkContext.broadcast(bitmap(item_win, bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        present = sent.value
        for b in batches:
            for c in chunks(b.column(2)):
                of = kinds(c)
                first = [np.searchsorted(x["row"], np.arange(len(c))) for x in of]
                for kind, n in sorts:
                    h, at = _template_windows(of[kind], kind, n)
                    s = h >> np.uint64(64 - bits)
                    hit = (present[s >> np.uint64(6)] >> (s & np.uint64(63))) & np.uint64(1) == 1
                    if hit.any():
                        yield _emit(b, c, of[kind], h[hit], at[hit], kind, n, first[kind])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, found = [], []
            for k, (kind, n, n_windows, n_words, hits) in enumerate(zip(*(b.column(i).to_pylist() for i in range(3, 8)), strict=True)):
                x = judged([(h["pos"], h["item_pos"], [(f["i"], f["d"]) for f in h["filled"]]) for h in hits], kind, n, n_windows, n_words, coverage, covered, consistent, verbatim)
                if x is not None:
                    at.append(k)
                    found.append(x)
            keys = [b.column(i).take(pa.array(at, pa.int64())) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*keys, *(pa.array([x[i] for x in found], pa.float64()) for i in range(2))], ["doc_id", "text_hash", "item_id", "coverage", "agreeing"])

    given = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    doc_type, item_type = given.schema["doc_id"].dataType.simpleString(), items.schema["item_id"].dataType.simpleString()
    found = given.mapInArrow(run, f"doc_id {doc_type}, text_hash long, {WINDOW}").drop("kind", "n")
    it = item_win.select("item_id", "kind", "n", "n_windows", "n_words", F.col("window").alias("w"), F.col("pos").alias("item_pos"), F.col("slots").alias("item_slots"))
    pairs = found.join(it, F.col("window") == F.col("w"))
    key = ["doc_id", "text_hash", "item_id", "kind", "n", "n_windows", "n_words"]
    # an item's value must stand for one value of the text
    filled = F.filter(F.arrays_zip(F.col("item_slots").alias("i"), F.col("slots").alias("d")), lambda z: z["i"] != 0)
    pairs = pairs.select(*key, F.struct("pos", "item_pos", filled.alias("filled")).alias("hit"))
    hits = pairs.groupBy(*key).agg(F.collect_set("hit").alias("hits"))
    places = F.size(F.array_distinct(F.transform("hits", lambda h: h["item_pos"])))
    # what can't be a match on any diagonals is left out before they are looked at
    enough = (places >= coverage * F.col("n_windows")) | (places * F.col("n") >= covered * F.col("n_words")) | ((F.col("kind") == EXACT) & (places + F.col("n") - 1 >= verbatim))
    cover = hits.where(enough).select("doc_id", "text_hash", "item_id", "kind", "n", "n_windows", "n_words", "hits").mapInArrow(judge, f"doc_id {doc_type}, text_hash long, item_id {item_type}, coverage double, agreeing double")
    return cover.groupBy("doc_id", "text_hash", "item_id").agg(F.max("coverage").alias("coverage"), F.max("agreeing").alias("slots_agreeing"))


def clean(docs: DataFrame, items: DataFrame, **options: object) -> DataFrame:
    """The documents that hold no benchmark item."""
    found = matches(docs, items, **options).select(F.col("doc_id").alias("d"), "text_hash").distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    left = rows.join(found, F.col("row.doc_id").eqNullSafe(F.col("d")) & (F.xxhash64("row.text") == F.col("text_hash")), "left_anti")
    return left.select(*[F.col(f"row.`{c}`") for c in docs.columns])


def query(docs: DataFrame, items: DataFrame) -> DataFrame:
    found = matches(docs, items)
    per = found.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"), F.max("coverage").alias("coverage"))
    narrow = docs.select("doc_id", F.xxhash64("text").alias("h"))
    per = per.withColumnRenamed("doc_id", "d")
    out = narrow.join(per, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("text_hash")), "left")
    return out.select("doc_id", F.col("item_ids").isNotNull().alias("contaminated"), F.coalesce("item_ids", F.array().cast(per.schema["item_ids"].dataType)).alias("item_ids"), F.coalesce("coverage", F.lit(0.0)).alias("coverage"))
