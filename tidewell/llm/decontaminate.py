"""Benchmark decontamination with an FM-index of each training shard.

A shard is a few MB of texts (or a part of one that is longer; parts share the words that a window can span). Its
words, numbered by its own vocabulary, with a separator after each text, have a suffix array, their Burrows-Wheeler
transform in a wavelet matrix, and suffix positions sampled at every SAMPLE-th place and at the starts of texts.
All windows of the benchmark are searched backward at once by ranks in the wavelet matrix; their rows are traced to
sampled positions; the occurrences, merged, are the spans to remove. The index knows nothing of the benchmark.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import find_words, keyed_hashes, lower_table, next_key, numbered, row_blocks, same_bytes, text_buffers, word_key, written

WINDOW = 13
SAMPLE = 8
SHARD_BYTES = 2 << 20
SHARD_WORDS = 1 << 19
BENCHMARK_BYTES = 32 << 20  # of benchmark text searched for at once (about 3 bytes broadcast for each of these); more goes in further passes
_LOWER = lower_table()
#: A word byte of lower-cased text: a digit, a small letter, or any byte of a character beyond ASCII.
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True


def words_of(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The lower-cased bytes of some texts, where their words start and end, and how many each text has."""
    data = _LOWER[raw[off[0] : off[-1]]]
    cuts = off - off[0]
    starts, ends = find_words(data, cuts, _WORD)
    return data, starts, ends, np.diff(np.searchsorted(starts, cuts))


class FmIndex:
    """Over symbols 0 (separator; the text ends with one) to ``alphabet`` - 1."""

    def __init__(self, text: np.ndarray, alphabet: int):
        n = len(text)
        sa = suffix_order(text)
        last = text[sa - 1]  # the symbol before each suffix; before the first one stands the last separator
        self.size = n
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=alphabet))])[:alphabet]
        self.levels = max(1, int(alphabet - 1).bit_length())
        self.ones, self.bits, self.zeros = [], [], []
        seq = last.astype(np.int32)
        for level in range(self.levels - 1, -1, -1):
            bit = (seq & np.int32(1 << level)) != 0
            count = np.zeros(n + 1, np.int32)
            np.cumsum(bit, out=count[1:])
            self.ones.append(count)
            self.bits.append(bit)
            self.zeros.append(int(n - count[-1]))
            seq = np.concatenate([seq[~bit], seq[bit]])
        self.begin = self._descend(np.arange(alphabet), np.zeros(alphabet, np.int64))
        kept = (sa % SAMPLE == 0) | (last == 0)
        self.kept, self.rank = kept, np.cumsum(kept) - 1
        self.sampled = sa[kept]

    def _descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k, level in enumerate(range(self.levels - 1, -1, -1)):
            one = self.ones[k][at]
            at = np.where((symbol >> level) & 1, self.zeros[k] + one, at - one)
        return at

    def _step(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The first row of a symbol plus its rank before ``at`` in the transform."""
        return self.before[symbol] + self._descend(symbol, at) - self.begin[symbol]

    def search(self, symbols: np.ndarray, first: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The patterns that occur, and the rows (low, high) of the suffixes that start with each.

        Pattern i is ``symbols[first[i] : first[i] + lengths[i]]``; one with symbol 0 occurs nowhere.
        """
        at = first + lengths - 1  # the next symbol, from the last on
        active = np.flatnonzero((lengths > 0) & (symbols[np.where(lengths > 0, at, 0)] > 0))
        low, high = np.zeros(len(active), np.int64), np.full(len(active), self.size, np.int64)
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        step = 1
        while len(active):
            c = symbols[at[active] - step + 1]
            low, high = self._step(c, low), self._step(c, high)
            alive = (low < high) & (c > 0)
            over = alive & (lengths[active] == step)
            done.append((active[over], low[over], high[over]))
            on = alive & ~over
            active, low, high = active[on], low[on], high[on]
            step += 1
        found, low, high = (np.concatenate(x) if done else np.zeros(0, np.int64) for x in (list(zip(*done, strict=True)) or [[], [], []]))
        return found, low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows."""
        out, at, todo, steps = np.zeros(len(rows), np.int64), rows.astype(np.int64), np.arange(len(rows)), 0
        while len(todo):
            here = at[todo]
            done = self.kept[here]
            out[todo[done]] = self.sampled[self.rank[here[done]]] + steps
            todo = todo[~done]
            here = here[~done]
            symbol, where = np.zeros(len(here), np.int64), here
            for k in range(self.levels):
                bit, one = self.bits[k][where], self.ones[k][where]
                symbol = symbol * 2 + bit
                where = np.where(bit, self.zeros[k] + one, where - one)
            at[todo] = self.before[symbol] + where - self.begin[symbol]
            steps += 1
        return out


def suffix_order(text: np.ndarray) -> np.ndarray:
    """The suffix array by prefix doubling, of the suffixes not yet told apart alone.

    Each separator (0) differs from all others, so that no comparison goes beyond a text's end. A suffix's rank is
    the place of the first one that it equals so far.
    """
    n = len(text)
    separators = text == 0
    rank = np.where(separators, np.cumsum(separators) - 1, int(separators.sum()) + text.astype(np.int64))
    order = np.argsort(rank, kind="stable")
    key, places, h = rank[order], np.arange(n), 1
    while True:
        # of ``places`` in the order, runs of one key are what is not told apart
        fresh = np.r_[True, key[1:] != key[:-1]] if len(key) else np.zeros(0, bool)
        starts = np.flatnonzero(fresh)
        rank[order[places]] = np.repeat(places[starts], np.diff(np.r_[starts, len(key)]))
        places = places[~(fresh & np.r_[fresh[1:], True])] if len(key) else places
        if not len(places):
            return order
        own = order[places]
        # own + h is in the text: a suffix that ends before differs by its separator
        key = rank[own] * n + rank[np.minimum(own + h, n - 1)]
        by = np.argsort(key, kind="stable")
        key, order[places] = key[by], own[by]
        h *= 2


@dataclass
class Windows:
    """The windows of some benchmark items, as parts of the items' words; about 25 bytes for each word, and the distinct words."""

    key: bytes  # of the word hashes
    vocabulary: np.ndarray  # the distinct words' hashes
    letters: np.ndarray  # their bytes, one word after another
    cuts: np.ndarray
    symbols: np.ndarray  # the items' words one after another, as places in the vocabulary
    first: np.ndarray  # of each window in ``symbols``
    lengths: np.ndarray
    items: np.ndarray  # the window's item, a number into ``ids``
    ids: list[str | None]


def windows_of(items: list[tuple[str | None, str | None]]) -> Windows:
    column = pa.array([t or "" for _, t in items], pa.large_string())
    none = np.zeros(0, np.int64)
    data, starts, ends, counts = words_of(*text_buffers(column)) if items else (np.zeros(0, np.uint8), none, none, none)
    key, alike = word_key(), False
    while not alike:
        key = next_key(key)
        vocabulary, first, symbols, alike = numbered(data, starts, ends, key)
    size = (ends - starts)[first]
    cuts = np.r_[0, np.cumsum(size)]
    letters = data[np.arange(cuts[-1]) + np.repeat(starts[first] - cuts[:-1], size)]
    # an item of n words has n - WINDOW + 1 windows, or a shorter one if it has any word
    many = np.where(counts > 0, np.maximum(1, counts - WINDOW + 1), 0)
    begin = np.r_[0, np.cumsum(counts)[:-1]] if len(counts) else counts
    inner = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
    return Windows(
        key, vocabulary, letters, cuts, symbols.astype(np.int32), (np.repeat(begin, many) + inner).astype(np.int32), np.repeat(np.minimum(counts, WINDOW), many).astype(np.int8),
        np.repeat(np.arange(len(items)), many).astype(np.int32), [i for i, _ in items],
    )


def search_shard(w: Windows, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of each text; occurrences as text, first word (counted in the shard), length and window."""
    data, starts, ends, counts = words_of(raw, off)
    row = np.repeat(np.arange(len(counts)), counts)
    found = []
    for a in range(0, len(starts) if len(w.first) else 0, SHARD_WORDS - WINDOW + 1):
        b = min(len(starts), a + SHARD_WORDS)
        start, which = search_words(w, data, starts[a:b], ends[a:b], row[a:b])
        found.append((start + a, which))
        if b == len(starts):
            break
    start, which = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    return counts, row[start], start, w.lengths[which].astype(np.int64), which


def shard_numbers(w: Windows, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """How many distinct words a shard has, the number of each of its words, from 1, and of each benchmark word (0: not there).

    Hashes only sort the words: where two that differ meet, in the shard or with the benchmark, all are hashed anew.
    """
    key, asked = w.key, w.vocabulary
    while True:
        vocabulary, first, number, alike = numbered(data, starts, ends, key)
        at = np.minimum(np.searchsorted(vocabulary, asked), len(vocabulary) - 1)
        met = np.flatnonzero(vocabulary[at] == asked)
        here = first[at[met]]
        if alike and same_bytes(data, starts[here], ends[here], w.letters, w.cuts[met], w.cuts[met + 1]).all():
            there = np.zeros(len(asked), np.int64)
            there[met] = at[met] + 1
            return len(vocabulary), number + 1, there
        key = next_key(key)
        asked = keyed_hashes(w.letters, w.cuts[:-1], w.cuts[1:], key)


def search_words(w: Windows, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word and window of each occurrence in the words of a shard; ``row`` is the text that each is of."""
    distinct, symbol, number = shard_numbers(w, data, starts, ends)
    # the words with a separator after each text
    last = np.flatnonzero(np.r_[row[1:] != row[:-1], True])
    word = np.insert(np.arange(len(starts)), last + 1, -1)
    text = np.where(word >= 0, symbol[word], 0)
    index = FmIndex(text, distinct + 1)
    found, low, high = index.search(number[w.symbols], w.first, w.lengths)
    size = high - low
    rows = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(low, size)
    return word[index.locate(rows)], np.repeat(found, size)


def mark_spans(docs: DataFrame, benchmark: DataFrame, text: str = "text", limit: int = BENCHMARK_BYTES) -> DataFrame:
    """``docs`` with n_words, spans (array of begin and end, in words, merged and sorted) and items (array of ids
    as strings, distinct) of the ``benchmark`` (item_id, text) in each text.

    Null and empty texts have no words; texts of any length are searched whole, repeated rows each. An item without
    a text or words occurs nowhere; one without an id is searched for, but not named. Items of one id count once.
    Empty tables give no row, or no span. A benchmark larger than ``limit`` bytes is searched for in several passes
    over each row, one bounded broadcast each; between them the rows are written, and the broadcast is let go. Every
    column of ``docs`` is returned; those named like a new one are replaced.
    """
    names = [c for c in docs.columns if c not in ("n_words", "spans", "items")]
    size = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    passes = max(1, -(-size // limit))
    out = docs.select(*names, F.lit(0).cast("long").alias("n_words"), F.array().cast("array<struct<begin:int,end:int>>").alias("spans"), F.array().cast("array<string>").alias("items"))
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(passes))
    k = names.index(text)
    for p in range(passes):
        some = benchmark.where(F.col("text").isNotNull() & (part == p)).select(F.col("item_id").cast("string"), "text").distinct().collect()
        held = docs.sparkSession.sparkContext.broadcast(windows_of([(r[0], r[1]) for r in some]))
        out = out.mapInArrow(_searcher(held, k, len(names)), T.StructType(out.schema.fields))
        if p < passes - 1:
            out = written(out, "spans")
            held.destroy()
    return out


def _searcher(held, k: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = held.value
        for batch in batches:
            raw, off = text_buffers(batch.column(k))
            old_spans, old_items = batch.column(width + 1).to_pylist(), batch.column(width + 2).to_pylist()
            n_words = np.zeros(batch.num_rows, np.int64)
            for a, b in row_blocks(off, SHARD_BYTES):
                counts, row, start, length, which = search_shard(w, raw, off[a : b + 1])
                n_words[a:b] = counts
                if not len(row):
                    continue
                first = np.r_[0, np.cumsum(counts)]
                order = np.lexsort((start, row))
                begin, end, row, which = (start - first[row])[order], (start + length - first[row])[order], row[order], which[order]
                for x, y in _groups(row):
                    i = a + int(row[x])
                    old_spans[i] = merged([(s["begin"], s["end"]) for s in old_spans[i]] + list(zip(begin[x:y].tolist(), end[x:y].tolist(), strict=True)))
                    some = np.unique(which[x:y])
                    ids = {w.ids[j] for j in np.unique(w.items[some]).tolist()} - {None}
                    old_items[i] = sorted(ids.union(old_items[i]))
            fields = list(batch.schema)[:width]
            columns = [*batch.columns[:width], pa.array(n_words, pa.int64()), pa.array(old_spans, pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))), pa.array(old_items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields] + ["n_words", "spans", "items"])

    return run


def _groups(sorted_rows: np.ndarray) -> Iterator[tuple[int, int]]:
    cuts = np.flatnonzero(np.diff(sorted_rows)) + 1
    yield from zip(np.r_[0, cuts].tolist(), np.r_[cuts, len(sorted_rows)].tolist(), strict=True)


def merged(spans: list[tuple[int, int]]) -> list[dict[str, int]]:
    out: list[list[int]] = []
    for begin, end in sorted(spans):
        if out and begin <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([begin, end])
    return [{"begin": b, "end": e} for b, e in out]


def judged(marked: DataFrame) -> DataFrame:
    """Adds n_hit, n_items, items_sha256 and contaminated (a twentieth of the words or more are hit)."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + (x["end"] - x["begin"]))
    return marked.withColumn("n_hit", hit).withColumns({
        "n_items": F.size("items").cast("long"), "items_sha256": F.sha2(F.array_join(F.array_sort("items"), ","), 256),
        "contaminated": (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")),
    })


def op8_decontamination(spark, sf_dir: str) -> DataFrame:
    from .common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return judged(mark_spans(docs, table(spark, sf_dir, "benchmark"))).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
