"""Quality classifier: a byte-level convolutional network in numpy.

``filters`` learned filters of ``TAPS`` bytes slide over the whole text. Their outputs are max-pooled in chunks
of ``2 * HOP`` bytes that overlap by ``HOP``; the pooled values, rectified, are averaged over the chunks and
maximised over them, and a logistic unit combines both into one probability. Weights are learned with Adam on
a bounded sample of labelled rows (``max_rows``), whose texts are read whole. Both learning and scoring read every
byte of a text, long ones in pieces, so that only the outputs of one piece are held.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_mod, text_buffers

TAPS = 5
HOP = 128
PIECE = 1 << 16  # bytes whose filter outputs are held at once
_LOW = np.float32(-1e30)


@dataclass
class Cnn:
    taps: np.ndarray  # (TAPS, 256, filters)
    bias: np.ndarray  # (filters,)
    out: np.ndarray  # (2 * filters,)
    out_bias: float


def convolve(taps: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Filter outputs at each position that has TAPS bytes."""
    n = len(x) - TAPS + 1
    y = taps[0].take(x[:n], axis=0)
    for t in range(1, TAPS):
        y += taps[t].take(x[t : t + n], axis=0)
    return y


def block_maxima(net: Cnn, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maxima of the filters over each HOP positions of each text, and the blocks a text has (one at least).

    A text of n bytes has n + 1 positions; beyond its end there are zero bytes.
    """
    lens = np.diff(off)
    blocks = (lens + 1 + HOP - 1) // HOP
    out = np.empty((int(blocks.sum()), len(net.bias)), np.float32)
    first = np.r_[0, np.cumsum(blocks)]
    a = 0
    while a < len(lens):
        if lens[a] + TAPS > PIECE:  # a long text, in pieces of whole blocks
            text = np.concatenate([raw[off[a] : off[a + 1]], np.zeros(TAPS, np.uint8)])
            step = PIECE // HOP * HOP
            for k in range(0, int(lens[a]) + 1, step):
                y = convolve(net.taps, text[k : k + step + TAPS - 1])
                y = y[: int(lens[a]) + 1 - k]
                at = first[a] + k // HOP
                cuts = np.arange(0, len(y), HOP)
                out[at : at + len(cuts)] = np.maximum.reduceat(y, cuts, axis=0)
            a += 1
            continue
        b = a + 1
        room = PIECE - int(lens[a]) - TAPS
        while b < len(lens) and lens[b] + TAPS <= room:
            room -= int(lens[b]) + TAPS
            b += 1
        size = lens[a:b] + TAPS
        begin = np.r_[0, np.cumsum(size)]
        x = np.zeros(int(begin[-1]) + TAPS, np.uint8)
        x[np.arange(int(off[b] - off[a])) + np.repeat(np.arange(b - a) * TAPS, lens[a:b])] = raw[off[a] : off[b]]
        y = convolve(net.taps, x)[: begin[-1]]
        # positions after the first one beyond a text's end would reach into the next text
        y[(begin[1:, None] - np.arange(1, TAPS)).ravel()] = _LOW
        n = blocks[a:b]
        inner = np.arange(int(n.sum())) - np.repeat(np.r_[0, np.cumsum(n)[:-1]], n)
        out[first[a] : first[b]] = np.maximum.reduceat(y, np.repeat(begin[:-1], n) + inner * HOP, axis=0)
        a = b
    return out, first


def scores(net: Cnn, raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    if len(off) < 2:
        return np.zeros(0)
    m, first = block_maxima(net, raw, off)
    m = np.maximum(m + net.bias, 0)
    last = np.zeros(len(m), bool)
    last[first[1:] - 1] = True
    chunk = m.copy()
    chunk[:-1] = np.where(last[:-1, None], m[:-1], np.maximum(m[:-1], m[1:]))
    # the last block stands alone as a chunk only in a text of one block
    weight = np.where(last & (np.repeat(np.diff(first), np.diff(first)) > 1), np.float32(0), np.float32(1))
    mean = np.add.reduceat(chunk * weight[:, None], first[:-1], axis=0) / np.add.reduceat(weight, first[:-1])[:, None]
    most = np.maximum.reduceat(chunk, first[:-1], axis=0)
    z = np.concatenate([mean, most], axis=1).astype(np.float64) @ net.out + net.out_bias
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(texts: list[bytes], gold: list[int], filters: int = 12, epochs: int = 6, batch: int = 16, rate: float = 0.01, seed: int = 11) -> Cnn:
    rng = np.random.default_rng(seed)
    share = min(max(float(np.mean(gold)) if gold else 0.5, 0.01), 0.99)
    net = Cnn((rng.standard_normal((TAPS, 256, filters)) * 0.05).astype(np.float32), np.full(filters, 0.05, np.float32), rng.standard_normal(2 * filters) * 0.1, float(np.log(share / (1 - share))))
    if len(set(gold)) < 2:
        net.out[:] = 0
        return net
    params = [net.taps, net.bias, net.out]
    m1, m2 = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    b1 = b2 = 0.0
    step, rounds = 0, epochs * -(-len(texts) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for s in range(0, len(order), batch):
            grads = [np.zeros_like(p) for p in params]
            gb = 0.0
            for i in order[s : s + batch]:
                gb += backward(net, texts[i], gold[i], grads) / batch
            step += 1
            lr = rate * min(1.0, 2.0 * (1 - step / (rounds + 1)))
            c1, c2 = 1 - 0.9**step, 1 - 0.999**step
            for p, g, u, v in zip(params, grads, m1, m2, strict=True):
                g /= batch
                u += 0.1 * (g - u)
                v += 0.001 * (g * g - v)
                p -= (lr * (u / c1) / (np.sqrt(v / c2) + 1e-8)).astype(p.dtype)
            b1 += 0.1 * (gb - b1)
            b2 += 0.001 * (gb * gb - b2)
            net.out_bias -= lr * (b1 / c1) / (b2**0.5 / c2**0.5 + 1e-8)
    return net


def backward(net: Cnn, text: bytes, y: int, grads: list[np.ndarray]) -> float:
    """Adds the gradients of the log loss of one text; returns that of the output bias."""
    f = len(net.bias)
    n = len(text) + 1
    blocks = -(-n // HOP)
    x = np.zeros(blocks * HOP + TAPS - 1, np.uint8)
    x[: len(text)] = np.frombuffer(text, np.uint8)
    best, pos = np.empty((blocks, f), np.float32), np.empty((blocks, f), np.int64)
    for k in range(0, blocks, PIECE // HOP):
        to = min(blocks, k + PIECE // HOP)
        conv = convolve(net.taps, x[k * HOP : to * HOP + TAPS - 1])
        conv[max(0, n - k * HOP) :] = _LOW
        conv = conv.reshape(to - k, HOP, f)
        arg = conv.argmax(axis=1)
        best[k:to] = np.take_along_axis(conv, arg[:, None], axis=1)[:, 0]
        pos[k:to] = arg + np.arange(k, to)[:, None] * HOP
    if blocks > 1:
        right = best[1:] > best[:-1]
        pos = np.where(right, pos[1:], pos[:-1])
        best = np.where(right, best[1:], best[:-1])
    m = best + net.bias
    h = np.maximum(m, 0)
    k = len(h)
    top = h.argmax(axis=0)
    feat = np.concatenate([h.mean(axis=0), h[top, np.arange(f)]])
    d = 1 / (1 + np.exp(-np.clip(feat @ net.out + net.out_bias, -40, 40))) - y
    grads[2] += d * feat
    g = np.tile(d * net.out[:f] / k, (k, 1))
    g[top, np.arange(f)] += d * net.out[f:]
    g *= m > 0
    grads[1] += g.sum(axis=0)
    col = np.broadcast_to(np.arange(f), pos.shape).ravel()
    for t in range(TAPS):
        grads[0][t] += np.bincount(x[pos + t].ravel().astype(np.int64) * f + col, g.ravel(), minlength=256 * f).reshape(256, f).astype(np.float32)
    return float(d)


def labelled_rows(docs: DataFrame, labels: DataFrame, label: str, max_rows: int) -> list[tuple[str, int]]:
    """At most ``max_rows`` labelled texts, whole, by a hash of the id.

    An id labelled several times counts once, with its largest label. The sampled labels are bounded by
    ``max_rows``, and so are broadcast.
    """
    some = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("y"))
    total = some.count()
    if not total:
        return []
    h = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 30))
    rate = (max_rows + 3 * max_rows**0.5) / total * (1 << 30)
    few = some.select("*", h.alias("h")).where(F.col("h") < rate)
    rows = docs.where(F.col("text").isNotNull()).join(F.broadcast(few), "doc_id").select(F.col("text").alias("t"), "y", "h", "doc_id")
    # by the hash, the first max_rows: repeated rows of one id are told apart by their texts' hashes
    rows = rows.withColumn("o", F.xxhash64("t")).orderBy("h", "doc_id", "o").limit(max_rows).select("t", "y").collect()
    return [(r["t"], r["y"]) for r in rows]


def classify(docs: DataFrame, train_docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = 3000, keep: list[str] | None = None, **options) -> DataFrame:
    """doc_id, score for every row of ``docs`` (doc_id, text), by a network fitted to ``train_docs`` and ``labels`` (doc_id, label).

    A null text is scored as an empty one; repeated rows are scored each; an empty table gives no row. An id that is
    labelled several times has its largest label, a null label is none. Without labels of both kinds every score is
    the share of label 1 (one half where there is none). Other columns are ignored, but for those in ``keep``,
    which are returned as they are before the score.
    """
    rows = labelled_rows(train_docs, labels, label, max_rows)
    held = docs.sparkSession.sparkContext.broadcast(fit([t.encode() for t, _ in rows], [y for _, y in rows], **options))

    names = keep or ["doc_id"]
    plain = docs.select(*names, F.col("text").alias("_scored"))
    schema = T.StructType([*plain.schema.fields[:-1], T.StructField("score", T.DoubleType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(scores(held.value, *text_buffers(batch.column(len(names)))), pa.float64())], names=[*names, "score"])

    return plain.mapInArrow(score, schema)


def op3_quality(spark, sf_dir: str) -> DataFrame:
    from .common import table

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    learn = crc_mod(F.col("doc_id"), 5) != 0
    out = classify(docs, docs.where(learn), labels.where(learn))
    return out.select("doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
