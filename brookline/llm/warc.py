"""Deterministic sharded WARC writer and reader.

Writing. Records are put in order of (page_id, digest) and cut into shards of about ``shard_bytes`` by the exact
running sum of their sizes, which is taken over narrow rows, range by range; so shards depend neither on partitions nor
executors, and any spread of 64-bit ids gives even ones. There are at most ``MOST`` shards (they grow beyond
that), so that their first keys may be sent to all tasks, where a binary search finds each record's
shard and payloads are shuffled once. Rows that share page_id and payload and outgrow a shard are split over several
by url, and rows equal in all three travel as one with their number. Each shard is written by one
task as a stream of gzip members (a record each), rolled to a new file once ``roll_bytes`` compressed
bytes are reached. Headers and digests are made anew from the payload. A file is written under a
temporary name that carries the task attempt and renamed when complete; the manifest, a Parquet
table committed by Spark, lists the files of successful attempts only. A task that runs twice
writes the same bytes under the same final name.

Reading. The manifest's files are spread over tasks and read record by record; lengths and digests
are checked against the headers.

Of records with equal payloads of at least ``least_dup`` bytes the one with the smallest page_id is
a response, the others are revisits that carry the payload's digest and length and refer to it.

Defined results: a null html is an empty payload; a null page_id is written without an id and comes
first; a repeated page_id is one record a row, and of equal rows the first is the response that
the others refer to; a null url is written as an empty target; an empty table gives an empty
manifest and no records; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_folder, running, written

SHARD_BYTES, ROLL_BYTES, LEAST_DUP = 64 << 20, 32 << 20, 100
MOST, MOST_TASKS = 1 << 18, 1 << 16
OVERHEAD = 512  # of a record, beside its payload
EPOCH = "1970-01-01T00:00:00Z"
_NAMES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def record_id(page_id: int | None, order: int | str, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMES, f'{page_id}/{order}/{digest}')}>"


def header(fields: dict[str, object], block: bytes) -> bytes:
    lines = [f"{k}: {v}" for k, v in (*fields.items(), ("Content-Length", len(block))) if v is not None]
    return ("WARC/1.1\r\n" + "\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def gzipped(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


class _Shard:
    """The files of one shard: the open one under a temporary name, complete ones under their own."""

    def __init__(self, store: fs.FileSystem, root: str, shard: int, roll: int) -> None:
        self.store, self.root, self.shard, self.roll = store, root, shard, roll
        self.seq, self.out, self.done = 0, None, []

    def add(self, data: bytes) -> None:
        if self.out is None:
            self.name = f"shard-{self.shard:08d}-{self.seq:05d}.warc.gz"
            self.temp = f"{self.root}/_temporary/{self.name}.{uuid.uuid4().hex}"
            self.out = self.store.open_output_stream(self.temp, compression=None)
            self.size, self.records, self.sha = 0, 0, hashlib.sha256()
            info = gzipped(header({"WARC-Type": "warcinfo", "WARC-Record-ID": record_id(None, self.seq, self.name), "WARC-Date": EPOCH, "WARC-Filename": self.name, "Content-Type": "application/warc-fields"}, b"format: WARC File Format 1.1\r\n"))
            self._put(info)
        self._put(data)
        self.records += 1
        if self.size >= self.roll:
            self.close()

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.sha.update(data)
        self.size += len(data)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.store.move(self.temp, f"{self.root}/{self.name}")
            self.done.append((self.name, self.shard, self.seq, self.records, self.size, self.sha.hexdigest()))
            self.out, self.seq = None, self.seq + 1


class Cuts:
    """The first (page_id, digest) of each shard in order, null ids before all; and the keys that fill shards alone."""

    def __init__(self, rows: list[tuple[int | None, str, int]], heavy: dict[tuple[int | None, str], tuple[int, str]]) -> None:
        none, some = [r for r in rows if r[0] is None], [r for r in rows if r[0] is not None]
        self.none = np.array([r[1] for r in none], "S64")
        self.page, self.digest = np.array([r[0] for r in some], np.int64), np.array([r[1] for r in some], "S64")
        self.shard = np.array([r[2] for r in [*none, *some]], np.int32)
        self.heavy = heavy

    def find(self, page: pa.Array, digest: pa.Array) -> np.ndarray:
        """The shard of each key: that of the last cut at or before it."""
        null, d = page.is_null().to_numpy(zero_copy_only=False), np.array(digest.to_pylist(), "S64")
        x = page.fill_null(0).to_numpy()
        lo, hi = np.searchsorted(self.page, x, "left"), np.searchsorted(self.page, x, "right")
        at = lo
        for v in np.unique(x[(lo < hi) & ~null]):  # pages at which one or more shards begin
            mine = np.flatnonzero((x == v) & ~null)
            first, last = lo[mine[0]], hi[mine[0]]
            at[mine] = first + np.searchsorted(self.digest[first:last], d[mine], "right")
        at = np.where(null, np.searchsorted(self.none, d, "right"), at + len(self.none)) - 1
        return self.shard[np.maximum(at, 0)] if len(self.shard) else np.zeros(len(x), np.int32)


def _placed(p: DataFrame, shard_bytes: int) -> tuple[DataFrame, Cuts, int]:
    """p: page_id, digest, bytes. A narrow table of the distinct keys, where shards are cut, and the number of shards."""
    line = [F.col("page_id").asc_nulls_first(), F.col("digest")]
    keys = p.groupBy("page_id", "digest").agg(F.count("*").alias("n"), F.max("bytes").alias("bytes"), F.min("url").alias("url"))
    keys = keys.withColumn("held", F.col("n") * (F.col("bytes") + OVERHEAD))
    placed = written(running(keys, line, {"at": F.col("held")}, "warc-order"), "warc-keys")
    total = placed.agg(F.sum("held")).first()[0] or 0
    size = max(shard_bytes, -(-total // MOST))
    keys, placed = placed, placed.withColumn("from", F.floor(F.col("at") / size).cast("int")).withColumn("to", F.floor((F.col("at") + F.col("held")) / size).cast("int"))
    key = F.struct(F.col("page_id").isNotNull().alias("some"), "page_id", "digest")
    cuts = placed.groupBy("from").agg(F.min(key).alias("k")).select("k.page_id", "k.digest", "from").collect()  # MOST rows at most
    heavy = placed.where(F.col("held") > size).select("page_id", "digest", "from", "to", "url").collect()
    found = Cuts(sorted((tuple(r) for r in cuts), key=lambda r: r[2]), {(r[0], r[1]): (max(1, r["to"] - r["from"]), r["url"]) for r in heavy})
    return keys.select("page_id", "digest", "n", "bytes"), found, len(cuts) + sum(m for m, _ in found.heavy.values())


def write(pages: DataFrame, shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES, least_dup: int = LEAST_DUP) -> str:
    """Writes pages (page_id, url, html) as archives; returns their folder, which holds the manifest."""
    spark = pages.sparkSession
    root = new_folder(spark, "warc")
    store, at = fs.FileSystem.from_uri(root)
    store.create_dir(f"{at}/_temporary", recursive=True)
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    p = p.withColumn("digest", F.sha2(F.col("html").cast("binary"), 256)).withColumn("bytes", F.octet_length("html").cast("long"))
    keys, cuts, shards = _placed(p.select("page_id", "digest", "bytes", "url"), shard_bytes)
    sent = spark.sparkContext.broadcast(cuts)

    # which records revisit another: only ids and digests are shuffled for it, the payloads once
    large = keys.where(F.col("bytes") >= least_dup)
    first = large.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1 and refers_to is not null").select(F.col("digest").alias("d"), "refers_to")
    marks = large.join(first, (F.col("digest") == F.col("d")) & ~F.col("page_id").eqNullSafe(F.col("refers_to"))).select("page_id", "digest", "refers_to")

    def place(page: pa.Array, digest: pa.Array) -> pa.Array:
        c = sent.value
        alone = [c.heavy.get(k, (0, ""))[0] for k in zip(page.to_pylist(), digest.to_pylist(), strict=True)] if c.heavy else [0] * len(page)
        return pa.StructArray.from_arrays([pa.array(c.find(page, digest)), pa.array(alone, pa.int32())], ["shard", "many"])

    place.__annotations__ = {"page": pa.Array, "digest": pa.Array, "return": pa.Array}
    placed = F.arrow_udf(place, "shard int, many int")("page_id", "digest")
    rows = p.select("page_id", "digest", F.lit(1).alias("kind"), "url", "html", F.lit(None).cast("long").alias("refers_to"), placed.alias("at"))
    light = rows.where("at.many = 0").select("at.shard", "page_id", "digest", "kind", "url", "html", "refers_to", F.lit(1).cast("long").alias("n"), F.lit(-1).cast("long").alias("ordinal"))
    noted = marks.select("page_id", "digest", F.lit(0).alias("kind"), F.lit("").alias("url"), F.lit("").alias("html"), "refers_to", placed.alias("at")).where("at.many = 0")
    all_ = light.unionByName(noted.select("at.shard", "page_id", "digest", "kind", "url", "html", "refers_to", F.lit(1).cast("long").alias("n"), F.lit(-1).cast("long").alias("ordinal")))
    if cuts.heavy:
        per = max(1, shard_bytes // OVERHEAD)
        same = rows.where("at.many > 0").groupBy("page_id", "digest", "url", "at").agg(F.first("html").alias("html"), F.count("*").alias("n"))
        same = same.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / per))).alias("piece"))
        shard = F.col("at.shard") + F.pmod(F.xxhash64("url", "piece"), F.col("at.many")).cast("int")
        m = marks.select(F.col("page_id").alias("mp"), F.col("digest").alias("md"), "refers_to")
        same = same.join(m, F.col("page_id").eqNullSafe(F.col("mp")) & (F.col("digest") == F.col("md")), "left")
        all_ = all_.unionByName(same.select(shard.alias("shard"), "page_id", "digest", F.lit(1).alias("kind"), "url", "html", "refers_to", F.least(F.lit(per), F.col("n") - F.col("piece") * per).cast("long").alias("n"), (F.col("piece") * per).alias("ordinal")))
    rows = all_.repartitionByRange(min(MOST_TASKS, max(1, shards)), "shard").sortWithinPartitions("shard", "page_id", "digest", "kind", "url", "ordinal")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = fs.FileSystem.from_uri(root)
        open_, mark, last, done = None, None, None, []
        for b in batches:
            names = b.schema.names
            cols = [b.column(names.index(x)) for x in ("shard", "page_id", "digest", "kind", "url", "html", "refers_to", "n", "ordinal")]
            for k in range(b.num_rows):
                shard, page, digest, kind, url, html, ref, n, ordinal = (c[k].as_py() for c in cols)
                if kind == 0:
                    mark = (page, digest, ref)
                    continue
                if open_ is None or open_.shard != shard:
                    if open_ is not None:
                        open_.close()
                        done += open_.done
                    open_ = _Shard(store, at, shard, roll_bytes)
                body = html.encode()
                if ref is None and mark is not None and mark[:2] == (page, digest):
                    ref = mark[2]
                for i in range(n):
                    if ordinal < 0:
                        order = last[2] + 1 if last is not None and last[:2] == (page, digest) else 0
                        last = (page, digest, order)
                    else:  # one of many equal keys: the first is the one with the least url
                        order = ordinal + i
                        order = f"{url}/{order}" if order or url != sent.value.heavy[page, digest][1] else 0
                    again = ref is not None or (order != 0 and len(body) >= least_dup)
                    to = ref if ref is not None else page
                    fields = {
                        "WARC-Type": "revisit" if again else "response", "WARC-Record-ID": record_id(page, order, digest), "WARC-Date": EPOCH, "WARC-Target-URI": "".join(x for x in url if x >= " "),
                        "WARC-Payload-Digest": f"sha256:{digest}", "WARC-Page-ID": page, "WARC-Payload-Length": len(body), "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if again else None,
                        "WARC-Refers-To": record_id(to, 0, digest) if again else None, "WARC-Refers-To-Page-ID": to if again else None, "Content-Type": "text/html; charset=utf-8",
                    }
                    open_.add(gzipped(header(fields, b"" if again else body)))
        if open_ is not None:
            open_.close()
            done += open_.done
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], t) for i, t in enumerate((pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string()))], ["file", "shard", "seq", "records", "bytes", "sha256"])

    rows.mapInArrow(run, "file string, shard int, seq int, records long, bytes long, sha256 string").write.parquet(f"{root}/manifest")
    store.delete_dir(f"{at}/_temporary")
    return root


def _records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Records of a gzip file with a member for each, read in blocks."""
    z, data, rest = zlib.decompressobj(31), [], b""
    while block := rest or stream.read(1 << 20):
        data.append(z.decompress(block))
        rest = z.unused_data
        if z.eof:
            whole = b"".join(data)
            head, _, body = whole.partition(b"\r\n\r\n")
            fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
            yield fields, body[: int(fields["Content-Length"])]
            z, data = zlib.decompressobj(31), []


def read(spark: SparkSession, root: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, url, file of the records of the manifest's files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = fs.FileSystem.from_uri(root)
        for b in batches:
            for name in b.column(0).to_pylist():
                rows: list[tuple] = []
                with store.open_input_stream(f"{at}/{os.path.basename(name)}", compression=None) as stream:
                    for f, body in _records(stream):
                        kind = f["WARC-Type"]
                        if kind == "warcinfo":
                            continue
                        digest = f["WARC-Payload-Digest"].removeprefix("sha256:")
                        if kind == "response" and (hashlib.sha256(body).hexdigest() != digest or len(body) != int(f["WARC-Payload-Length"])):
                            raise ValueError(f"{name}: payload of {f['WARC-Record-ID']} does not match its digest")
                        page, ref = f.get("WARC-Page-ID"), f.get("WARC-Refers-To-Page-ID")
                        rows.append((page and int(page), int(f["WARC-Payload-Length"]), digest, kind, ref and int(ref), f["WARC-Target-URI"], name))
                        if len(rows) == 4096:
                            yield _batch(rows)
                            rows = []
                yield _batch(rows)

    files = spark.read.schema("file string, shard int, seq int, records long, bytes long, sha256 string").parquet(f"{root}/manifest").select("file")
    n = max(1, files.count())
    return files.repartition(n).mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, file string")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "file"])


def query(pages: DataFrame) -> DataFrame:
    return read(pages.sparkSession, write(pages)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = r"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest AS d, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first_id IS NULL OR first_id = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first_id = page_id THEN NULL ELSE first_id END AS refers_to
FROM p LEFT JOIN f ON payload_digest = d AND payload_bytes >= 100
"""
