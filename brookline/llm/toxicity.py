"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

Inputs are words and characters: a word's vector is its own embedding (words frequent in training)
plus the mean embedding of its hashed letter n-grams (trigrams, and its first four and five letters).
Every text is cut into windows of ``WINDOW`` words that overlap by half; both directions read each
window, attention pools the states, and the text's score is the highest of its windows.

Fitting. A bounded sample of labelled rows (at most ``max_train`` of each label, those with the
smallest hash of doc_id) is read by the driver; of a text over ``max_chars`` it reads ``PIECES`` pieces, evenly
spread over the whole text, with ``max_chars`` characters together. So rows and bytes are bounded, whatever ids
repeat. Of a doc_id with both labels the toxic one holds. The first embedding dimension starts at log odds of words and n-grams. A label belongs to a text, so each epoch takes from every
text the windows that the model so far finds most toxic, and from clean texts random ones too.
All rows are scored, whole texts.

Defined results: a null or empty text, and one without letters or digits, gets the share of toxic rows
in the sample; without labels of both kinds every text gets that share (0 with no labels); repeated
rows get equal scores; null ids have no label; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import remainder, written
from .textvec import LOWER, Chunk, chunks, hash_words, mix, runs, words

WINDOW, STRIDE = 32, 16
DIM, HIDDEN = 8, 8
VOCABULARY, GRAMS = 4096, 1 << 16
MAX_TRAIN, MAX_CHARS, PIECES = 2000, 20_000, 10
_KEEP = np.zeros(256, bool)
_KEEP[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


class Text:
    """Words of a chunk with letters or digits: row of each, index of its distinct word; hash and n-grams of the distinct words."""

    def __init__(self, c: Chunk) -> None:
        w, data = words(c), c.data
        low = LOWER[data]
        latin = np.zeros(len(data), bool)
        latin[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        low = np.where(latin, low + 0x20, low).astype(np.uint8)
        keep = _KEEP[data]
        h = hash_words(low, w, keep)
        some = np.flatnonzero(h)
        self.row, self.rows = w.row[some], len(c)
        self.hash, at, self.word = np.unique(h[some], return_index=True, return_inverse=True)
        start, end = w.start[some[at]], w.end[some[at]]
        size = end - start
        of = np.repeat(np.arange(len(at)), size)
        byte = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(start, size)
        kept = keep[byte]
        of, letter = of[kept], low[byte[kept]].astype(np.uint64) + np.uint64(1)
        n = np.bincount(of, minlength=len(at)) if len(at) else np.zeros(0, np.int64)
        first = np.cumsum(n) - n
        place = np.arange(len(of)) - first[of] if len(of) else of
        pad = lambda k: np.where(place >= k, np.concatenate([np.zeros(k, np.uint64), letter])[: len(letter)], np.uint64(0))
        a, b, c4, c5 = (pad(k) for k in (1, 2, 3, 4))
        three = mix(letter * np.uint64(1 << 16) + a * np.uint64(1 << 32) + b * np.uint64(1 << 48) + np.uint64(3))
        four = mix(letter + a * np.uint64(1 << 9) + b * np.uint64(1 << 18) + c4 * np.uint64(1 << 27) + np.uint64(1 << 60))
        five = mix(letter + a * np.uint64(1 << 9) + b * np.uint64(1 << 18) + c4 * np.uint64(1 << 27) + c5 * np.uint64(1 << 36) + np.uint64(1 << 61))
        gram = np.concatenate([three, four[place == 3], five[place == 4]])
        owner = np.concatenate([of, of[place == 3], of[place == 4]])
        by = np.argsort(owner, kind="stable")
        self.gram = (gram[by] >> np.uint64(48)).astype(np.int32)
        self.n_grams = np.bincount(owner, minlength=len(at)) if len(at) else np.zeros(0, np.int64)

    @classmethod
    def of(cls, texts: pa.Array) -> Text:
        """Many texts as one, read a chunk at a time."""
        parts = [cls(c) for c in chunks(texts)]
        t = cls.__new__(cls)
        t.rows = len(texts)
        rows = np.cumsum([0, *(p.rows for p in parts)])
        t.row = np.concatenate([p.row + r for p, r in zip(parts, rows, strict=False)])
        t.hash, first, same = np.unique(np.concatenate([p.hash for p in parts]), return_index=True, return_inverse=True)
        begin = np.cumsum([0, *(len(p.hash) for p in parts)])
        t.word = np.concatenate([same[p.word + k] for p, k in zip(parts, begin, strict=False)])
        n = np.concatenate([p.n_grams for p in parts])
        t.n_grams = n[first]
        t.gram = np.concatenate([p.gram for p in parts])[runs((np.cumsum(n) - n)[first], t.n_grams)]
        return t

    def grams_of(self, which: np.ndarray) -> np.ndarray:
        """Positions in ``gram`` of all n-grams of some distinct words, word by word."""
        return runs((np.cumsum(self.n_grams) - self.n_grams)[which], self.n_grams[which])

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """Indexes of distinct words plus 1 by window and step (0: padding), and the row of each window."""
        n = np.bincount(self.row, minlength=self.rows)
        per = np.where(n > 0, np.maximum(1, -(-(n - (WINDOW - STRIDE)) // STRIDE)), 0)
        row = np.repeat(np.arange(self.rows), per)
        k = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
        begin = (np.cumsum(n) - n)[row] + k * STRIDE
        at = begin[:, None] + np.arange(WINDOW)
        inside = at < (np.cumsum(n))[row][:, None]
        return np.where(inside, self.word[np.minimum(at, max(0, len(self.word) - 1))] + 1, 0) if len(self.word) else np.zeros((0, WINDOW), np.int64), row


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class Network:
    """Parameters and passes; ``vocabulary`` holds sorted word hashes, embeddings 1.. belong to them."""

    def __init__(self, vocabulary: np.ndarray, rng: np.random.Generator) -> None:
        g = lambda *s: (rng.standard_normal(s) * 0.3).astype(np.float32)
        self.vocabulary = vocabulary
        self.p = {"word": 0.1 * g(len(vocabulary) + 1, DIM), "gram": 0.1 * g(GRAMS, DIM), "pad": np.zeros((1, DIM), np.float32)}
        for d in ("f", "b"):
            self.p |= {f"x{d}": g(DIM, 3 * HIDDEN), f"u{d}": g(HIDDEN, 3 * HIDDEN), f"c{d}": np.zeros(3 * HIDDEN, np.float32)}
        self.p |= {"att": g(2 * HIDDEN), "out": g(2 * HIDDEN), "bias": np.zeros(1, np.float32)}
        self.prior = 0.0

    def ids(self, t: Text) -> np.ndarray:
        if not len(self.vocabulary):
            return np.zeros(len(t.hash), np.int64)
        i = np.minimum(np.searchsorted(self.vocabulary, t.hash), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[i] == t.hash, i + 1, 0)

    def vectors(self, t: Text, which: np.ndarray | None = None) -> np.ndarray:
        """Vectors of the padding and of the distinct words, or of some of them."""
        n = t.n_grams if which is None else t.n_grams[which]
        gram = t.gram if which is None else t.gram[t.grams_of(which)]
        ids = self.ids(t) if which is None else self.ids(t)[which]
        mean = np.add.reduceat(self.p["gram"][gram], np.cumsum(n) - n) / n[:, None].astype(np.float32) if len(gram) else np.zeros((len(n), DIM), np.float32)
        return np.concatenate([self.p["pad"], self.p["word"][ids] + 2 * mean])

    def direction(self, d: str, proj: np.ndarray, win: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
        n, steps = win.shape
        u, h = self.p[f"u{d}"], np.zeros((n, HIDDEN), np.float32)
        out, tape = np.empty((steps, n, HIDDEN), np.float32), []
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            x, hu = proj[win[:, t]], h @ u
            g = sigmoid(x[:, : 2 * HIDDEN] + hu[:, : 2 * HIDDEN])
            r, z = g[:, :HIDDEN], g[:, HIDDEN:]
            new = np.tanh(x[:, 2 * HIDDEN :] + r * hu[:, 2 * HIDDEN :])
            if keep:
                tape.append((t, h, r, z, new, hu[:, 2 * HIDDEN :]))
            h = new + z * (h - new)
            out[t] = h
        return out, tape

    def forward(self, vec: np.ndarray, win: np.ndarray, keep: bool = False) -> tuple:
        both, tapes = [], []
        for d in ("f", "b"):
            out, tape = self.direction(d, vec @ self.p[f"x{d}"] + self.p[f"c{d}"], win, keep)
            both.append(out)
            tapes.append(tape)
        score = both[0] @ self.p["att"][:HIDDEN] + both[1] @ self.p["att"][HIDDEN:]
        score = np.where(win.T > 0, score, np.float32(-1e9))
        a = np.exp(score - score.max(0))
        a /= a.sum(0)
        pooled = np.concatenate([np.einsum("tn,tnh->nh", a, x) for x in both], 1)
        p = sigmoid(pooled @ self.p["out"] + self.p["bias"][0])
        return (p, a, pooled, both, tapes) if keep else (p,)

    def gradients(self, vec: np.ndarray, win: np.ndarray, y: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of the mean log loss: of the shared parameters, and of the vectors."""
        p, a, pooled, both, tapes = self.forward(vec, win, True)
        n = len(y)
        dl = ((p - y) / n).astype(np.float32)
        g = {"out": pooled.T @ dl, "bias": np.array([dl.sum()], np.float32), "att": np.zeros(2 * HIDDEN, np.float32)}
        dpool = dl[:, None] * self.p["out"]
        dvec = np.zeros_like(vec)
        dots = [np.einsum("tnh,nh->tn", x, dpool[:, k * HIDDEN : (k + 1) * HIDDEN]) for k, x in enumerate(both)]
        da = dots[0] + dots[1]
        ds = a * (da - (a * da).sum(0))
        for k, d in enumerate("fb"):
            g["att"][k * HIDDEN : (k + 1) * HIDDEN] = np.einsum("tn,tnh->h", ds, both[k])
            dout = a[:, :, None] * dpool[None, :, k * HIDDEN : (k + 1) * HIDDEN] + ds[:, :, None] * self.p["att"][k * HIDDEN : (k + 1) * HIDDEN]
            u, wx = self.p[f"u{d}"], self.p[f"x{d}"]
            gu, gx, gc = np.zeros_like(u), np.zeros_like(wx), np.zeros(3 * HIDDEN, np.float32)
            dh = np.zeros((n, HIDDEN), np.float32)
            for t, h, r, z, new, hn in reversed(tapes[k]):
                dh = dh + dout[t]
                dz, dnew = dh * (h - new), dh * (1 - z)
                dn = dnew * (1 - new * new)
                dr = dn * hn
                dpre = np.concatenate([dr * r * (1 - r), dz * z * (1 - z), dn], 1)
                dhu = np.concatenate([dpre[:, : 2 * HIDDEN], dn * r], 1)
                gu += h.T @ dhu
                gx += vec[win[:, t]].T @ dpre
                gc += dpre.sum(0)
                np.add.at(dvec, win[:, t], dpre @ wx.T)
                dh = dh * z + dhu @ u.T
            g |= {f"u{d}": gu, f"x{d}": gx, f"c{d}": gc}
        return g, dvec

    def step(self, t: Text, win: np.ndarray, y: np.ndarray, state: dict, rate: float) -> None:
        """One Adagrad step on windows of a chunk's distinct words."""
        used = np.unique(win)
        used = used[used > 0] - 1
        local = np.where(win > 0, np.searchsorted(used, win - 1) + 1, 0)
        g, dvec = self.gradients(self.vectors(t, used), local, y)
        gw, gg = np.zeros((len(self.p["word"]), DIM), np.float32), np.zeros((GRAMS, DIM), np.float32)
        np.add.at(gw, self.ids(t)[used], dvec[1:])
        gw[0] = 0
        n = t.n_grams[used]
        np.add.at(gg, t.gram[t.grams_of(used)], np.repeat(2 * dvec[1:] / n[:, None].astype(np.float32), n, axis=0))
        g |= {"word": gw, "gram": gg, "pad": dvec[:1]}
        for k, v in g.items():
            s = state.setdefault(k, np.full_like(self.p[k], 1e-6))
            s += v * v
            self.p[k] -= (rate * v / np.sqrt(s)).astype(np.float32)


def _log_odds(pos: np.ndarray, neg: np.ndarray, n_pos: int, n_neg: int, least: int) -> np.ndarray:
    lo = np.log((pos + 0.5) / (n_pos + 1)) - np.log((neg + 0.5) / (n_neg + 1))
    return np.where(pos + neg >= least, np.clip(lo, -3, 3), 0.0).astype(np.float32)


def _pieces(text: Column, max_chars: int) -> Column:
    """The text, or of a long one PIECES pieces from its start to its end."""
    wide = max_chars // PIECES
    at = F.transform(F.sequence(F.lit(0), F.lit(PIECES - 1)), lambda i: F.substring(text, (F.floor(i * (F.char_length(text) - wide) / (PIECES - 1)) + 1).cast("int"), F.lit(wide)))
    return F.when(F.char_length(text) <= max_chars, text).otherwise(F.array_join(at, "\n"))


def sampled(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, max_chars: int = MAX_CHARS) -> tuple[DataFrame, dict[int, int]]:
    """k, doc_id, text, y of the training sample, and the number of labelled ids by label.

    The sample is drawn from the labels, so that only its bounded set of ids is sent to the texts.
    """
    top = 1 << 30
    given = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("y"))
    counts = {r[0]: r[1] for r in given.groupBy("y").count().collect()}
    share = {y: min(top, top * max_train // max(1, counts.get(y, 0))) for y in (0, 1)}
    key = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(top))
    of = lambda y: given.where((F.col("y") == y) & (key < share[y])).select(key.alias("k"), F.col("doc_id").alias("__id"), "y").orderBy("k", "__id").limit(max_train)
    chosen = of(0).unionByName(of(1))
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("__id")).where(F.length("text") > 0)
    texts = written(texts.select("k", "doc_id", _pieces(F.col("text"), max_chars).alias("text"), "y").withColumn("h", F.xxhash64("text")), "toxicity-sample")
    line = ["k", "doc_id", "h"]
    parts = []
    for y in (0, 1):  # ids may repeat, so rows are counted anew, by narrow keys; equal rows are one
        own = texts.where(F.col("y") == y)
        last = own.select(*line).distinct().orderBy(*line).limit(max_train).agg(F.max(F.struct(*line))).first()[0]
        upto = F.lit(False) if last is None else F.struct(*line) <= F.struct(*[F.lit(v).cast(texts.schema[c].dataType) for c, v in zip(line, last, strict=True)])
        parts.append(own.where(upto).dropDuplicates(line))
    return parts[0].unionByName(parts[1]).drop("h"), counts


def fit(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, max_chars: int = MAX_CHARS, epochs: int = 6, seed: int = 7) -> Network:
    """docs: doc_id, text; labels: doc_id, toxic (0 or 1)."""
    sample, counts = sampled(docs, labels, max_train, max_chars)
    sample = sample.toArrow().sort_by([("k", "ascending"), ("doc_id", "ascending"), ("text", "ascending")])
    y = sample.column("y").to_numpy().astype(np.float32)
    rng = np.random.default_rng(seed)
    total = sum(counts.values())
    if len(y) == 0 or y.min() == y.max():
        net = Network(np.zeros(0, np.uint64), rng)
        net.prior = float(counts.get(1, 0) / total) if total else 0.0
        net.p["out"][:], net.p["bias"][:] = 0, np.log((net.prior + 1e-6) / (1 - net.prior + 1e-6))
        return net
    t = Text.of(sample.column("text").combine_chunks())
    n_pos, n_neg = int(y.sum()), int(len(y) - y.sum())

    def by_label(item: np.ndarray, row: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        pair = np.unique(row.astype(np.int64) * size + item)
        r, i = pair // size, pair % size
        return np.bincount(i[y[r] == 1], minlength=size), np.bincount(i[y[r] == 0], minlength=size)

    pos, neg = by_label(t.word, t.row, len(t.hash))
    lo = _log_odds(pos, neg, n_pos, n_neg, 5)
    chosen = np.sort(np.argsort(-(np.abs(lo) * np.log1p(pos + neg)), kind="stable")[:VOCABULARY])
    chosen = chosen[(pos + neg)[chosen] >= 5]
    net = Network(t.hash[chosen], rng)
    net.prior = counts.get(1, 0) / total
    net.p["word"][1:, 0] = lo[chosen] / 2
    gpos, gneg = np.zeros(GRAMS, np.int64), np.zeros(GRAMS, np.int64)
    for lo in range(0, t.rows, 128):
        part = slice(*np.searchsorted(t.row, [lo, lo + 128]))
        word = t.word[part]
        more = by_label(t.gram[t.grams_of(word)], np.repeat(t.row[part], t.n_grams[word]), GRAMS)
        gpos, gneg = gpos + more[0], gneg + more[1]
    net.p["gram"][:, 0] = _log_odds(gpos, gneg, n_pos, n_neg, 5) / 2
    win, row = t.windows()
    vec0 = net.vectors(t)[:, 0]
    heat = vec0[win].max(1)  # before the first epoch the log odds rank the windows
    state: dict[str, np.ndarray] = {}
    for epoch in range(epochs):
        if epoch:
            vec = net.vectors(t)
            heat = np.concatenate([net.forward(vec, win[i : i + 8192])[0] for i in range(0, len(win), 8192)])
        order = np.lexsort((-heat, row))
        rank = np.arange(len(order)) - np.searchsorted(row[order], row[order])
        hot = order[rank < np.where(y[row[order]] == 1, 1, 2)]
        clean = rng.permutation(np.flatnonzero(y[row] == 0))[:n_neg]
        batch = rng.permutation(np.concatenate([hot, clean]))
        for i in range(0, len(batch), 256):
            b = batch[i : i + 256]
            net.step(t, win[b], y[row[b]], state, 0.05 if epoch < epochs - 2 else 0.02)
    return net


def score(docs: DataFrame, net: Network, keep: list[Column]) -> DataFrame:
    """keep columns, score, n_windows, at: the window (first word) with the highest score."""
    sent = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = sent.value
        for b in batches:
            for c in chunks(b.column(b.num_columns - 1), 1 << 19):
                t = Text(c)
                win, row = t.windows()
                best, where = np.full(len(c), net.prior), np.zeros(len(c), np.int64)
                if len(win):
                    vec = net.vectors(t)
                    p = np.concatenate([net.forward(vec, win[i : i + 4096])[0] for i in range(0, len(win), 4096)]).astype(float)
                    first = np.searchsorted(row, np.arange(len(c)))
                    has = np.flatnonzero(np.bincount(row, minlength=len(c)))
                    best[has] = np.maximum.reduceat(p, first[has])
                    order = np.lexsort((-p, row))
                    where[has] = (order[first[has]] - first[has]) * STRIDE
                kept = [b.column(i).slice(c.rows.start, len(c)) for i in range(b.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(best), pa.array(np.bincount(row, minlength=len(c)).astype(np.int64)), pa.array(where)], [*b.schema.names[:-1], "score", "n_windows", "at"])

    given = docs.select(*keep, "text")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema.fields[:-1])
    return given.mapInArrow(run, f"{fields}, score double, n_windows long, at long")


def query(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    held = remainder("doc_id", 3) == 1
    net = fit(docs, labels.where(~held).select("doc_id", "toxic"))
    out = score(docs, net, [F.col("doc_id"), held.alias("held_out")])
    return out.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_windows")
