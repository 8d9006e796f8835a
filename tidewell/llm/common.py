"""Shared helpers: shared-folder paths, Arrow text buffers, and vectorised word hashing over UTF-8 bytes.

Texts reach Python as Arrow string columns. The helpers below read their buffers without building
Python strings, in blocks of at most ``BLOCK_BYTES``, so memory stays bounded for any batch or text.
"""

from __future__ import annotations

import functools
import hashlib
import os
import secrets
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK_BYTES = 1 << 20
_U = np.uint64
LONG_SPAN = 64
#: Masks of the first 0 to 8 bytes of a little-endian number.
_LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], _U)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, what: str) -> str:
    """A fresh path in the folder of ``spark.checkpoint.dir``. Where that is unset, it is a local one in local mode (tests), else an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "tidewell-shared")
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: its lineage is cut, and lost executors lose nothing."""
    spark = df.sparkSession
    path = shared_dir(spark, what)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.tidewell_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that ``written`` made, once nothing that is still to run reads them."""
    for df in tables:
        spark = df.sparkSession
        files = spark._jvm.org.apache.hadoop.fs
        path = files.Path(df.tidewell_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release_memory(spark: SparkSession) -> None:
    """Has the Python workers give back what earlier stages have left in them: tokenizers' words, and freed memory that the allocators keep.

    A worker serves stage after stage, so without this the largest need of each adds up. It runs a few empty tasks for each core.
    """

    def run(batches):
        import ctypes
        import gc

        from tidewell.llm import packing

        for _ in batches:
            pass
        packing.word_tokens.cache_clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            pass
        yield from ()

    tasks = 4 * max(1, spark.sparkContext.defaultParallelism)
    spark.range(0, tasks, 1, tasks).mapInArrow(run, "id long").write.format("noop").mode("overwrite").save()


def width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def crc_mod(col, n: int):
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % F.lit(n)


def text_buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; a null text is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, off


def row_blocks(off: np.ndarray, limit: int = BLOCK_BYTES):
    """Ranges of rows whose texts have at most ``limit`` bytes together, or one row that alone has more."""
    a, n = 0, len(off) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + limit, side="right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finisher that spreads the bits of 64-bit hashes."""
    h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
    h = (h ^ (h >> _U(29))) * _U(0xBF58476D1CE4E5B9)
    return h ^ (h >> _U(32))


def find_words(data: np.ndarray, cuts: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of word bytes; ``cuts`` (row boundaries) end a word as well."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    w = is_word[data]
    start = w.copy()
    start[1:] &= ~w[:-1]
    end = w.copy()
    end[:-1] &= ~w[1:]
    inner = cuts[(cuts > 0) & (cuts < n)]
    start[inner] |= w[inner]
    end[inner - 1] |= w[inner - 1]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, equal for equal bytes wherever they stand, and in every run.

    They have no key, so they are for sketches alone; what equality decides takes ``keyed_hashes``.

    Spans of up to LONG_SPAN bytes are mixed eight bytes at a time, so that two of at most eight bytes and one length
    never have the same hash; longer ones are hashed by blake2b.
    """
    size = ends - starts
    h = size.astype(_U) * _U(0x94D049BB133111EB)
    if not len(h):
        return h
    eights = _eights(data)
    long = np.flatnonzero(size > LONG_SPAN)
    some, at = slice(None), 0
    while True:
        left = size[some] - at
        here = eights[starts[some] + at] & _LOW_BYTES[np.minimum(left, 8)]
        h[some] = mix((h[some] ^ mix(here + _U(at))) * _U(0x9E3779B97F4A7C15))
        at += 8
        some = np.flatnonzero((size > at) & (size <= LONG_SPAN))
        if not len(some):
            break
    if len(long):
        raw = data.tobytes()
        spans = zip(starts[long].tolist(), ends[long].tolist(), strict=True)
        h[long] = np.frombuffer(b"".join(hashlib.blake2b(raw[a:b], digest_size=8).digest() for a, b in spans), "<u8")
    return h


def _eights(data: np.ndarray) -> np.ndarray:
    """The little-endian number at each place of some bytes, with zeros after the last one."""
    return np.ndarray((len(data),), "<u8", data.tobytes() + bytes(8), strides=(1,))


def word_key() -> bytes:
    """A fresh key for ``keyed_hashes``: one for all tasks of a run, so that nobody can choose words that meet in it."""
    return secrets.token_bytes(16)


@functools.lru_cache(maxsize=64)
def _lanes(key: bytes) -> np.ndarray:
    """Two lanes of random 64-bit numbers: one to begin with, one for the length and one for each four bytes."""
    return np.frombuffer(hashlib.shake_128(key).digest(2 * (2 + LONG_SPAN // 4) * 8), "<u8").reshape(2, -1)


def keyed_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, key: bytes) -> np.ndarray:
    """64-bit hashes of byte spans under a key; two given spans meet in one of 2^64 keys, whatever they are.

    The halves are the high halves of two sums of a span's length and four-byte parts, each times a random number
    (which is strongly universal); longer spans than LONG_SPAN have keyed blake2b digests.
    """
    size = ends - starts
    if not len(size):
        return np.zeros(0, _U)
    lanes = _lanes(key)
    sums = lanes[:, :1] + size.astype(_U) * lanes[:, 1:2]
    eights = _eights(data)
    some, at = slice(None), 0
    while True:
        here = eights[starts[some] + at] & _LOW_BYTES[np.minimum(size[some] - at, 8)]
        low, high = here & _U(0xFFFFFFFF), here >> _U(32)
        for lane, own in zip(sums, lanes, strict=True):
            lane[some] += low * own[2 + at // 4] + high * own[3 + at // 4]
        at += 8
        some = np.flatnonzero((size > at) & (size <= LONG_SPAN))
        if not len(some):
            break
    h = (sums[0] & _U(0xFFFFFFFF00000000)) | (sums[1] >> _U(32))
    long = np.flatnonzero(size > LONG_SPAN)
    if len(long):
        raw = data.tobytes()
        spans = zip(starts[long].tolist(), ends[long].tolist(), strict=True)
        h[long] = np.frombuffer(b"".join(hashlib.blake2b(raw[a:b], digest_size=8, key=key).digest() for a, b in spans), "<u8")
    return h


def same_bytes(one: np.ndarray, starts: np.ndarray, ends: np.ndarray, other: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Whether spans of some bytes and spans of others are alike, pair by pair."""
    size = ends - starts
    same = size == last - first
    x, y = _eights(one), _eights(other)
    some, at = np.flatnonzero(same & (size > 0) & (size <= LONG_SPAN)), 0
    while len(some):
        differ = (x[starts[some] + at] ^ y[first[some] + at]) & _LOW_BYTES[np.minimum(size[some] - at, 8)]
        same[some[differ != 0]] = False
        at += 8
        some = some[(size[some] > at) & (differ == 0)]
    for i in np.flatnonzero(same & (size > LONG_SPAN)).tolist():
        same[i] = np.array_equal(one[starts[i] : ends[i]], other[first[i] : last[i]])
    return same


def numbered(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, key: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
    """Distinct hashes of some words, rising, the first word of each, each word's number among them, and whether words of one number are alike."""
    hashes, first, number = np.unique(keyed_hashes(data, starts, ends, key), return_index=True, return_inverse=True)
    number = number.ravel()
    return hashes, first, number, bool(same_bytes(data, starts, ends, data, starts[first][number], ends[first][number]).all())


def next_key(key: bytes) -> bytes:
    """The key to try where two words meet under ``key``."""
    return hashlib.blake2b(key, digest_size=16).digest()


def lower_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t
