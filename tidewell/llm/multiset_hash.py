"""Document fingerprints: a homomorphic multiset hash of paragraphs.

Each paragraph (line) is hashed to a wide vector: EXACT lanes modulo 2**64, all of one 256-bit blake2b digest of its
bytes and so independent of each other, and LANES lanes modulo 2**32 into which each of its 8-byte windows adds
plus or minus one (a count sketch). A document's fingerprint is the sum of its paragraphs' vectors, so the order of
paragraphs does not matter, and a paragraph is inserted or deleted by adding or subtracting its vector. Equal
multisets have equal fingerprints; the cosine of the signed lanes estimates how much of their windows two documents
share (exactly up to 2**31 windows to a lane, some hundred GB of text).
"""

from __future__ import annotations

import base64
import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLOCK_BYTES, mix, span_hashes, width

LANES = 128
EXACT = 4
WINDOW = 8
SAMPLED = 100  # rows of the sample that tells a bucket's bounds
_U = np.uint64


def vectors(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The signed lanes (int32) and the exact lanes (uint64) of each text."""
    n = len(texts)
    lanes, exact = np.zeros((n, LANES), np.int32), np.zeros((n, EXACT), _U)
    a = 0
    while a < n:
        b, size = a + 1, len(texts[a])
        while b < n and size + len(texts[b]) < BLOCK_BYTES // 2:
            size += len(texts[b]) + 1
            b += 1
        lanes[a:b], exact[a:b] = _vectors(texts[a:b]) if size <= BLOCK_BYTES else _long(texts[a])
        a = b
    return lanes, exact


def _long(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A long text, some paragraphs at a time; a paragraph that is long itself is hashed in one go."""
    lanes, exact = np.zeros((1, LANES), np.int32), np.zeros((1, EXACT), _U)
    a = 0
    while a <= len(text):
        b = text.find(b"\n", min(len(text), a + BLOCK_BYTES // 2))
        b = len(text) if b < 0 else b
        l, e = _vectors([text[a:b]])
        lanes += l
        exact += e
        a = b + 1
    return lanes, exact


def _vectors(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    n = len(texts)
    data = np.frombuffer(b"\n".join(texts) + b"\n" + bytes(WINDOW), np.uint8)
    size = len(data) - WINDOW
    ends = np.flatnonzero(data[:size] == 10)
    starts = np.r_[0, ends[:-1] + 1]
    # a paragraph's text: the number of texts that end before it
    stop = np.cumsum(np.array([len(t) + 1 for t in texts])) - 1
    owner = np.searchsorted(stop, ends)
    raw = memoryview(data)
    digests = b"".join([hashlib.blake2b(raw[a:b], digest_size=8 * EXACT).digest() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
    exact = np.add.reduceat(np.frombuffer(digests, "<u8").reshape(-1, EXACT), np.searchsorted(owner, np.arange(n)), axis=0)
    # windows: at each place of a paragraph that has WINDOW bytes left; a shorter one is one window by itself
    long = ends - starts >= WINDOW
    mark = np.zeros(size + 1, np.int8)
    np.add.at(mark, starts[long], 1)
    np.add.at(mark, ends[long] - WINDOW + 1, -1)
    at = np.flatnonzero(np.cumsum(mark[:-1]))
    words = np.ndarray((size,), "<u8", data.tobytes(), strides=(1,))
    short = ~long & (ends > starts)
    u = np.concatenate([mix(words[at]), span_hashes(data[:size], starts[short], ends[short])])
    who = np.concatenate([np.repeat(owner[long], (ends - starts)[long] - WINDOW + 1), owner[short]])
    place = who * (2 * LANES) + (u >> _U(64 - LANES.bit_length())).astype(np.int64)
    count = np.bincount(place, minlength=n * 2 * LANES).reshape(n, LANES, 2)
    return (count[:, :, 0] - count[:, :, 1]).astype(np.int32), exact


def encoded(lanes: np.ndarray, exact: np.ndarray) -> list[str]:
    return [base64.b64encode(a.astype("<i4").tobytes() + b.astype("<u8").tobytes()).decode() for a, b in zip(lanes, exact, strict=True)]


def decoded(text: str) -> tuple[np.ndarray, np.ndarray]:
    raw = base64.b64decode(text)
    return np.frombuffer(raw[: 4 * LANES], "<i4").copy(), np.frombuffer(raw[4 * LANES :], "<u8").copy()


def fingerprint(text: str | None) -> str:
    return encoded(*vectors([(text or "").encode()]))[0]


def changed(mark: str, inserted: list[str] = (), deleted: list[str] = ()) -> str:
    """The fingerprint after paragraphs are inserted and deleted, without the document."""
    lanes, exact = decoded(mark)
    for sign, paragraphs in ((1, inserted), (-1, deleted)):
        for p in paragraphs:
            l, e = vectors([p.encode()])
            lanes = lanes + l[0] if sign > 0 else lanes - l[0]
            exact = exact + e[0] if sign > 0 else exact - e[0]
    return encoded(lanes[None], exact[None])[0]


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """0 to 1 for rows of fingerprints: 1 for equal ones, else the cosine of the signed lanes."""
    x, y = a[0].astype(np.float64), b[0].astype(np.float64)
    norm = np.sqrt((x * x).sum(axis=1) * (y * y).sum(axis=1))
    cos = np.where(norm > 0, (x * y).sum(axis=1) / np.maximum(norm, 1e-300), 0)
    same = (a[0] == b[0]).all(axis=1) & (a[1] == b[1]).all(axis=1)
    return np.where(same, 1.0, np.clip(cos, 0, 1))


def edit(text: str, following: str) -> str:
    """The text with its last third replaced by as many characters from the start of another (or all it has)."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def with_next(docs: DataFrame) -> DataFrame:
    """Rows (bucket, guest, doc_id, text) partitioned by bucket and sorted so that each row's next document, by
    descending doc_id, follows it; the last document is followed by the first.

    Rows of one id follow each other by descending hash of their texts. Buckets are ranges of (id, hash) between
    quantiles of a bounded sample, SAMPLED rows per bucket, so an id that a third of all rows has is many buckets.
    The first row of each bucket (one per bucket, bounded by their number) also goes to the bucket before it, as a
    guest, so no window over the whole table is needed.
    """
    spark = docs.sparkSession
    key, h = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))), F.xxhash64(F.coalesce("text", F.lit("")))
    keyed = docs.select("doc_id", "text", F.struct(key.alias("key"), h.alias("h")).alias("at"))
    count = 2 * width(spark)
    rate = count * SAMPLED / max(1, docs.count()) * (1 << 30)
    some = keyed.where(F.pmod(F.xxhash64("at.key", "at.h"), F.lit(1 << 30)) < rate).select("at.key", "at.h").collect()
    some = sorted((r[0], r[1]) for r in some)
    cuts = sorted({some[i * len(some) // count] for i in range(1, count)}) if some else []
    # the bucket is the number of cuts up to the row: first among every step-th cut, then within one step
    step = max(1, round(len(cuts) ** 0.5))
    told = lambda x, kind: F.from_json(F.lit(json.dumps(x)), kind)
    entry = [{"key": k, "h": h} for k, h in cuts]
    coarse = told(entry[::step], "array<struct<key:long,h:long>>")
    fine = told([entry[i : i + step] for i in range(0, len(cuts), step)], "array<array<struct<key:long,h:long>>>")
    i = F.size(F.filter(coarse, lambda c: c <= F.col("at")))
    j = F.when(i > 0, (i - 1) * step + F.size(F.filter(F.element_at(fine, i), lambda c: c <= F.col("at")))).otherwise(0) if cuts else F.lit(0)
    placed = keyed.withColumn("bucket", j.cast("int"))
    heads = sorted((r[0], r[1][0], r[1][1]) for r in placed.groupBy("bucket").agg(F.max("at")).collect())
    targets = [(*head, heads[k + 1][0] if k + 1 < len(heads) else heads[0][0]) for k, (_, *head) in enumerate(heads)]
    guests = spark.createDataFrame(targets, "key long, h long, host int")
    alone = F.array(F.struct(F.col("bucket").alias("b"), F.lit(False).alias("guest")))
    both = F.concat(alone, F.array(F.struct(F.col("host").alias("b"), F.lit(True).alias("guest"))))
    met = (F.col("at.key") == guests["key"]) & (F.col("at.h") == guests["h"])
    rows = placed.join(F.broadcast(guests), met, "left").select("doc_id", "text", "at", F.explode(F.when(F.col("host").isNotNull(), both).otherwise(alone)).alias("x"))
    rows = rows.select("doc_id", "text", "at", F.col("x.b").alias("bucket"), F.col("x.guest").alias("guest")).repartition(width(spark), "bucket")
    return rows.sortWithinPartitions("bucket", "guest", F.desc("at"), F.desc_nulls_last("text")).select("bucket", "guest", "doc_id", "text")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for each row.

    A null text is empty. Rows of one doc_id follow each other by a hash of their texts; a null doc_id comes last. A
    table of one row is followed by itself; an empty table gives no row. Other columns are ignored.
    """
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def told(rows: list[tuple]) -> pa.RecordBatch:
        """Of all rows but the last, which only follows; guests are not told of."""
        texts = [r[3] for r in rows]
        marks = vectors([t.encode() for t in texts])
        own = [i for i in range(len(rows) - 1) if not rows[i][1]]
        edits = [edit(texts[i], texts[i + 1]).encode() for i in own]
        new = vectors(edits) if own else (marks[0][:0], marks[1][:0])
        mine = (marks[0][own], marks[1][own])
        after = (marks[0][[i + 1 for i in own]], marks[1][[i + 1 for i in own]])
        return pa.RecordBatch.from_arrays([
            pa.array([rows[i][2] for i in own], pa.int64()), pa.array([len(texts[i]) for i in own], pa.int64()),
            pa.array([hashlib.sha256(e).hexdigest() for e in edits], pa.string()),
            pa.array(encoded(*mine), pa.string()), pa.array(encoded(*new), pa.string()),
            pa.array(likeness(mine, new), pa.float64()), pa.array(likeness(mine, after), pa.float64()),
        ], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                for row in zip(*(part.column(i).to_pylist() for i in range(3)), (t or "" for t in part.column(3).to_pylist()), strict=True):
                    held.append(row)
                    size += len(row[3])
                    if size > BLOCK_BYTES // 2 and len(held) > 1:
                        yield told(held)
                        held, size = held[-1:], len(row[3])
        if len(held) > 1:
            yield told(held)

    return with_next(docs).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op2_fingerprints(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return fingerprints(table(spark, sf_dir, "documents"))
