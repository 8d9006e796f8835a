"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

The model is trained on the driver with FTRL-proximal (elastic net: L1 gives the sparsity, L2 the shrinkage)
on a bounded sample, at most ``per_lang`` rows of each language, and then calibrated with one temperature on rows
of the sample that training left out. Only the rows are bounded: whole texts are read, on the executors, and the
driver gets their n-gram counts. Scoring covers every character of every text.

n-grams are of 1 to 3 lower-cased code points, hashed into ``2**bits`` features. The term frequency is the
share of the text's n-grams; with it the score of a text is a mean over its n-grams, so a text of any length
is scored in blocks with constant memory.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_mod

_U4 = np.uint32
BLOCK_CHARS = 1 << 18
HELD_BACK = 5  # one row in so many is kept for the temperature


@dataclass(frozen=True)
class LanguageModel:
    langs: tuple[str, ...]
    weights: np.ndarray  # (features, languages) float32, idf folded in
    bias: np.ndarray
    temperature: float
    bits: int


def grams(text: str, bits: int) -> np.ndarray:
    """Feature numbers of all 1- to 3-grams of the lower-cased text; white space is one blank."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), _U4)
    return code_grams(np.where((c == 32) | ((c >= 9) & (c <= 13)), _U4(32), c), bits)


def code_grams(c: np.ndarray, bits: int) -> np.ndarray:
    shift = _U4(32 - bits)
    h = (c + _U4(1)) * _U4(0x9E3779B1)
    out = [h >> shift]
    for k in (1, 2):
        if len(c) > k:
            h = ((h[: len(c) - k] ^ (h[: len(c) - k] >> _U4(15))) * _U4(0x85EBCA77) + (c[k:] + _U4(1)) * _U4(0xC2B2AE3D)).astype(_U4)
            out.append((h ^ (h >> _U4(13))) * _U4(0x27D4EB2F) >> shift)
    return np.concatenate(out)


def blocks(text: str) -> Iterator[tuple[str, int]]:
    """(piece, sign) of a text: a long one's pieces share two characters, whose own n-grams are then taken off once."""
    if len(text) <= BLOCK_CHARS:
        yield text, 1
        return
    for a in range(0, len(text), BLOCK_CHARS):
        yield text[max(0, a - 2) : a + BLOCK_CHARS], 1
        if a:
            yield text[a - 2 : a], -1


def features(text: str, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of a text and their term frequencies."""
    count = np.zeros(1 << bits, np.int64)
    total = 0
    for piece, sign in blocks(text):
        g = grams(piece, bits)
        total += sign * len(g)
        count += sign * np.bincount(g, minlength=1 << bits)
    i = np.flatnonzero(count)
    return i, count[i] / max(1, total)


def examples(text: str, place: int, bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """The features of a training text and, as short texts are to be told apart too, of a short piece of it."""
    out = [features(text, bits)]
    if len(text) > 80:
        a = place % (len(text) - 40)
        out.append(features(text[a : a + 8 + place % 32], bits))
    return out


def train(rows: list[tuple[str, str]], bits: int = 16, seed: int = 7, **options) -> LanguageModel:
    """A model of the rows (text, lang)."""
    places = np.random.default_rng(seed).integers(0, 1 << 30, len(rows)).tolist()
    return fit([(k, lang, i, tf) for k, ((text, lang), place) in enumerate(zip(rows, places, strict=True)) for i, tf in examples(text, place, bits)], bits, seed=seed, **options)


def fit(data: list[tuple[int, str, np.ndarray, np.ndarray]], bits: int = 16, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.05, l2: float = 1e-4, epochs: int = 3, scale: float = 8.0, seed: int = 7) -> LanguageModel:
    """FTRL-proximal over examples (source row, lang, n-grams, term frequencies).

    All examples of every HELD_BACK-th source row are kept for the temperature, so that none of their texts is
    trained on, not even a piece of one; they don't count for the idf either.
    """
    langs = tuple(sorted({lang for _, lang, _, _ in data}))
    if not langs:
        return LanguageModel((), np.zeros((1 << bits, 0), np.float32), np.zeros(0), 1.0, bits)
    size, k = 1 << bits, len(langs)
    rng = np.random.default_rng(seed)
    number = {lang: y for y, lang in enumerate(langs)}
    keep = [(i, tf, number[lang]) for row, lang, i, tf in data if row % HELD_BACK == HELD_BACK - 1]
    fit = [(i, tf, number[lang]) for row, lang, i, tf in data if row % HELD_BACK != HELD_BACK - 1]
    df = np.zeros(size)
    for i, _, _ in fit:
        df[i] += 1
    idf = np.log((1 + len(fit)) / (1 + df)) + 1
    z, s = np.zeros((size, k)), np.zeros((size, k))
    zb, sb = np.zeros(k), np.zeros(k)

    def weigh(z, s):
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(s)) / alpha + l2))

    for _ in range(epochs):
        for j in rng.permutation(len(fit)):
            i, tf, y = fit[j]
            x = scale * tf * idf[i]
            w, b = weigh(z[i], s[i]), -zb * alpha / (beta + np.sqrt(sb))
            p = softmax(x @ w + b)
            p[y] -= 1
            g = x[:, None] * p
            g2 = g * g
            z[i] += g - (np.sqrt(s[i] + g2) - np.sqrt(s[i])) / alpha * w
            s[i] += g2
            p2 = p * p
            zb += p - (np.sqrt(sb + p2) - np.sqrt(sb)) / alpha * b
            sb += p2
    w, b = weigh(z, s), -zb * alpha / (beta + np.sqrt(sb))
    weights = (scale * idf[:, None] * w).astype(np.float32)
    if not keep:  # too few rows to keep any
        return LanguageModel(langs, weights, b, 1.0, bits)
    logits = np.array([tf @ weights[i] + b for i, tf, _ in keep])
    gold = np.array([y for _, _, y in keep])
    return LanguageModel(langs, weights, b, fit_temperature(logits, gold), bits)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit_temperature(logits: np.ndarray, gold: np.ndarray) -> float:
    """The temperature with the least log loss, by golden section over its logarithm."""
    def loss(t: float) -> float:
        p = softmax(logits / math.exp(t))
        return float(-np.log(np.maximum(p[np.arange(len(gold)), gold], 1e-12)).mean())

    a, b, r = math.log(0.05), math.log(20.0), (math.sqrt(5) - 1) / 2
    for _ in range(40):
        c, d = b - r * (b - a), a + r * (b - a)
        if loss(c) < loss(d):
            b = d
        else:
            a = c
    return math.exp((a + b) / 2)


def predict(model: LanguageModel, texts: list[str]) -> tuple[list[str], list[float]]:
    total, count = np.zeros((len(texts), len(model.langs))), np.zeros(len(texts))
    group: list[int] = []
    held = 0

    def flush() -> None:
        nonlocal group, held
        parts = [grams(texts[i], model.bits) for i in group]
        lens = np.array([len(p) for p in parts])
        w = model.weights[np.concatenate(parts)]
        total[group] = np.add.reduceat(w, np.r_[0, np.cumsum(lens)[:-1]], axis=0, dtype=np.float64)
        count[group] = lens
        group, held = [], 0

    for i, text in enumerate(texts):
        if len(text) > BLOCK_CHARS:
            for piece, sign in blocks(text):
                g = grams(piece, model.bits)
                total[i] += sign * model.weights[g].sum(axis=0, dtype=np.float64)
                count[i] += sign * len(g)
        elif text:
            group.append(i)
            held += len(text)
            if held > BLOCK_CHARS:
                flush()
    if group:
        flush()
    p = softmax((total / np.maximum(count, 1)[:, None] + model.bias) / model.temperature)
    best = p.argmax(axis=1)
    return [model.langs[b] for b in best], p[np.arange(len(texts)), best].tolist()


def sampled_examples(docs: DataFrame, lang_col: str, per_lang: int, bits: int) -> list[tuple[int, str, np.ndarray, np.ndarray]]:
    """The examples of at most ``per_lang`` rows of each language, chosen by a hash of id and text; texts are read whole, on the executors."""
    known = docs.where(F.col("text").isNotNull() & F.col(lang_col).isNotNull())
    sizes = {r[0]: r[1] for r in known.groupBy(lang_col).count().collect()}
    if not sizes:
        return []
    h = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30))
    rate = F.create_map(*[F.lit(x) for lang, n in sorted(sizes.items()) for x in (lang, min(1.0, (per_lang + 3 * math.sqrt(per_lang)) / n) * (1 << 30))])
    some = known.where(h < rate[F.col(lang_col)]).select(F.col(lang_col).alias("lang"), h.alias("h"), F.xxhash64("text").alias("t"), "text")
    # rows alike in id and text are one; what is left of a language is little more than per_lang rows, and cut there
    one = some.groupBy("lang", "h", "t").agg(F.first("text").alias("text"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h", "t"))
    rows = one.withColumn("place", place).where(F.col("place") <= per_lang).drop("place")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 64):
                part = batch.slice(a, 64)
                out = []
                for k, (lang, h, t, text) in enumerate(zip(*(c.to_pylist() for c in part.columns), strict=True)):
                    out += [(lang, h, t, k, piece, i.astype(np.int32), tf) for piece, (i, tf) in enumerate(examples(text, t % (1 << 30), bits))]
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(zip(*out, strict=True), fields, strict=True)], names=[n for n, _ in fields])

    fields = [("lang", pa.string()), ("h", pa.int64()), ("t", pa.int64()), ("k", pa.int64()), ("piece", pa.int64()), ("i", pa.list_(pa.int32())), ("tf", pa.list_(pa.float64()))]
    found = rows.mapInArrow(read, "lang string, h long, t long, k long, piece long, i array<int>, tf array<double>").toArrow()
    flat = [found.column(n).to_numpy() if n not in ("lang", "i", "tf") else found.column(n) for n, _ in fields]
    lang = np.array(flat[0].to_pylist(), object)
    order = np.lexsort((flat[4], flat[3], flat[2], flat[1], lang.astype(str)))
    out, count = [], dict.fromkeys(sizes, 0)
    for j in order.tolist():
        count[lang[j]] += int(flat[4][j] == 0)
        if count[lang[j]] <= per_lang:  # the text's hash stands for the source row, so that copies stay together
            out.append((int(flat[2][j]), lang[j], flat[5][j].values.to_numpy(), flat[6][j].values.to_numpy()))
    return out


def identify(docs: DataFrame, labelled: DataFrame, per_lang: int = 600, lang_col: str = "lang", keep: list[str] | None = None, **options) -> DataFrame:
    """doc_id, lang_pred, score for every row of ``docs`` (doc_id, text), by a model of ``labelled`` (doc_id, text, lang).

    A null text, or one without a letter, is ``und`` with score 0, and so is every text if there is no labelled row.
    Equally likely languages: the first by name. Repeated rows are scored each, an empty table gives no row, texts
    of any length are scored whole, in blocks. Columns besides those named are ignored, but for those in ``keep``,
    which are returned as they are before lang_pred and score.
    """
    bits = options.pop("bits", 16)
    model = fit(sampled_examples(labelled, lang_col, per_lang, bits), bits, **options)
    held = docs.sparkSession.sparkContext.broadcast(model)
    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    names = keep or ["doc_id"]
    plain = docs.select(*names, F.when(letters, F.col("text")).alias("_scored"))
    schema = T.StructType([*plain.schema.fields[:-1], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in batches:
            texts = batch.column(len(names)).to_pylist()
            at = [i for i, t in enumerate(texts) if t is not None] if model.langs else []
            pred, value = ["und"] * len(texts), [0.0] * len(texts)
            if at:
                for i, lang, p in zip(at, *predict(model, [texts[i] for i in at]), strict=True):
                    pred[i], value[i] = lang, p
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(pred, pa.string()), pa.array(value, pa.float64())], names=[*names, "lang_pred", "score"])

    return plain.mapInArrow(score, schema)


def op9_language_id(spark, sf_dir: str) -> DataFrame:
    from .common import table

    docs = table(spark, sf_dir, "documents")
    out = identify(docs, docs.where(crc_mod(F.col("doc_id"), 3) != 1))
    return out.select("doc_id", (crc_mod(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score")
