"""N-gram Jaccard self-join by T-occurrence search, and its groups.

A document's set is its distinct word shingles, hashed to 64 bits. Documents with equal sets are one class. A
class that is to link with another of Jaccard similarity t needs a common shingle among its first
n - ceil(t n) + 1 ones in any fixed order of shingles. The order puts frequent shingles, counted over all
documents, last, so few classes meet; it changes the work, never the result.

Each class stands in one block: those with the same least shingle, in parts of bounded size. The search has two
rounds, and in both a job is the inverted lists of one block, searched by DivideSkip: short lists are merged by
a heap that skips what cannot reach the overlap, long ones are probed by binary search for the candidates left.

1. Every block is searched by its own classes (and so are blocks by the greatest shingle, which need not be but join
   what the least one parts). Components of these links name the classes.
2. Inverted lists of the leading shingles tell which classes of two blocks, not yet in one component, can link by
   their sizes and places. One of the two is sent to the other's block, once, however many lists they share; the
   block itself is sent once for all its queries. So near copies of each other cost no rows per pair.

Before sets are shipped, profiles (how many of a set's shingles lie in each of some equal ranges of hashes) bound
the overlap from above and rule out nearly all false candidates.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import math
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, find_words, keyed_hashes, lower_table, mix, row_blocks, text_buffers, width, word_key, written
from .components import components

#: Classes and shingles of a block at most (a class with more shingles is a block of its own).
BLOCK = 256
BLOCK_SHINGLES = 1 << 19
#: Entries of the table of frequent shingles at most, and shingles counted at once.
FREQUENT = 1 << 18
COUNTED = 1 << 21
#: Classes of a list that one task reads; a longer list is dealt into pairs of parts.
LIST = 1 << 18
#: Hashed ids of the classes whose texts are read again at most, so that the table of them may be broadcast.
BUCKETS = 1 << 20
#: DivideSkip's weight of a probe against a merge.
PROBE = 0.01
_U = np.uint64
_LOWER = lower_table()
_WORD = np.ones(256, bool)
_WORD[[32, 9, 10, 11, 12, 13]] = False
_K = _U(0x9FB21C651E98DF25)
_NONE = np.zeros(0, np.int64)


# --- sets ------------------------------------------------------------------------------------------------------


class Shingles(NamedTuple):
    """How texts become sets in one run: shingles of so many words, which are hashed under the run's key."""

    words: int
    key: bytes


def shingle_sets(raw: np.ndarray, off: np.ndarray, shingles: Shingles) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    size = shingles.words
    data = _LOWER[raw[off[0] : off[-1]]]
    cuts = off - off[0]
    starts, ends = find_words(data, cuts, _WORD)
    h = keyed_hashes(data, starts, ends, shingles.key)
    first = np.searchsorted(starts, cuts)
    full = np.zeros(0, _U)
    if len(h) >= size:
        full = h[: len(h) - size + 1].copy()
        for k in range(1, size):
            full = (full ^ (full >> _U(31))) * _K + h[k : len(h) - size + 1 + k]
        full = mix(full)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= size:
            yield np.unique(full[a : b - size + 1])
        elif b > a:
            whole = _U(b - a)
            with np.errstate(over="ignore"):
                for x in h[a:b]:
                    whole = (whole ^ (whole >> _U(31))) * _K + x
            yield mix(np.array([whole], _U))
        else:
            yield np.zeros(0, _U)


def sets_of(column, shingles: Shingles) -> Iterator[np.ndarray]:
    raw, off = text_buffers(column)
    for a, b in row_blocks(off):
        yield from shingle_sets(raw, off[a : b + 1], shingles)


def signature(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


# --- the order of shingles ----------------------------------------------------------------------------------------


class Counter:
    """The most frequent of many shingles, in bounded memory: after each COUNTED ones, those seen once are forgotten."""

    def __init__(self, most: int = FREQUENT):
        self.most = most
        self.tokens, self.counts = np.zeros(0, _U), _NONE
        self.parts: list[np.ndarray] = []
        self.held = 0

    def add(self, tokens: np.ndarray) -> None:
        self.parts.append(tokens)
        self.held += len(tokens)
        if self.held >= COUNTED:
            self.settle()

    def settle(self) -> None:
        if not self.parts:
            return
        tokens, counts = np.unique(np.concatenate(self.parts), return_counts=True)
        self.parts, self.held = [], 0
        if len(self.tokens):
            tokens, back = np.unique(np.concatenate([tokens, self.tokens]), return_inverse=True)
            counts = np.bincount(back, np.concatenate([counts, self.counts])).astype(np.int64)
        keep = counts > 1
        if keep.sum() > self.most:
            keep = counts > np.partition(counts, len(counts) - self.most)[len(counts) - self.most]
        self.tokens, self.counts = tokens[keep], counts[keep]


def frequent_shingles(docs: DataFrame, shingles: Shingles) -> tuple[np.ndarray, np.ndarray]:
    """The FREQUENT most frequent shingles of all documents at most, sorted, and about how many have each."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter()
        for batch in batches:
            for s in sets_of(batch.column(0), shingles):
                counter.add(s)
        counter.settle()
        if len(counter.tokens):
            yield pa.RecordBatch.from_arrays([pa.array(counter.tokens.view(np.int64)), pa.array(counter.counts)], names=["t", "k"])

    found = written(docs.select("text").mapInArrow(count, "t long, k long").groupBy("t").agg(F.sum("k").alias("k")), "frequent")
    least, total = 2, 0
    for low, n in sorted(found.groupBy(F.floor(F.log2("k") * 8).alias("low")).agg(F.count("*"), F.max("k")).select("max(k)", "count(1)").collect(), reverse=True):
        total += n
        if total > FREQUENT:
            least = low + 1
            break
    table = found.where(F.col("k") >= least).toArrow()
    discard(found)
    tokens, counts = table.column(0).to_numpy().view(_U), table.column(1).to_numpy()
    order = np.argsort(tokens)
    return tokens[order], counts[order]


def leading(s: np.ndarray, common: np.ndarray, counts: np.ndarray, percent: int) -> np.ndarray:
    """The first n - ceil(t n) + 1 shingles: rare ones by hash, then common ones by count and hash."""
    p = len(s) - -(-percent * len(s) // 100) + 1
    if not len(common):
        return s[:p]
    at = np.minimum(np.searchsorted(common, s), len(common) - 1)
    known = common[at] == s
    rare = s[~known]
    if len(rare) >= p:
        return rare[:p]
    late, n = s[known], counts[at[known]]
    return np.concatenate([rare, late[np.lexsort((late, n))[: p - len(rare)]]])


# --- profiles -----------------------------------------------------------------------------------------------------


def profile(s: np.ndarray) -> bytes:
    """How many shingles lie in each of B equal ranges of hashes, a byte each (255: or more); B is a power of two near n / 2."""
    bits = max(4, math.ceil(math.log2(max(2, len(s))) - 1))
    return np.minimum(np.bincount((s >> _U(64 - bits)).astype(np.int64), minlength=1 << bits), 255).astype(np.uint8).tobytes()


class Outlines:
    """The profiles of a block's sets; one of twice as many ranges is folded to compare it, a full byte counts as unbounded."""

    def __init__(self, profiles: list[bytes], sizes: np.ndarray):
        self.sizes = sizes
        levels: dict[int, list[int]] = {}
        for i, p in enumerate(profiles):
            levels.setdefault(len(p), []).append(i)
        self.stacks = {w: (np.array(ids), np.stack([np.frombuffer(profiles[i], np.uint8) for i in ids])) for w, ids in levels.items()}
        self.folded: dict[tuple[int, int], np.ndarray] = {}

    @staticmethod
    def fold(m: np.ndarray, w: int) -> np.ndarray:
        m = np.where(m == 255, 1 << 20, m.astype(np.int32))
        return m.reshape(*m.shape[:-1], w, -1).sum(axis=-1)

    def may_link(self, outline: bytes, n: int, ok: np.ndarray, percent: int) -> np.ndarray:
        """Flags those of the sets flagged in ``ok`` that a set with this profile can link with."""
        out = np.zeros(len(self.sizes), bool)
        mine = np.frombuffer(outline, np.uint8)
        ok = ok & near_sizes(n, self.sizes, percent)
        for full, (ids, stack) in self.stacks.items():
            some = ok[ids]
            if not some.any():
                continue
            w = min(full, len(mine))
            if (full, w) not in self.folded:
                self.folded[full, w] = self.fold(stack, w)
            bound = np.minimum(self.folded[full, w][some], self.fold(mine, w)).sum(axis=1)
            out[ids[some]] = bound >= overlap_needed(n, self.sizes[ids[some]], percent)
        return out


def near_sizes(n, sizes, percent: int):
    return 100 * np.minimum(n, sizes) >= percent * np.maximum(n, sizes)


def overlap_needed(n, sizes, percent: int):
    return -(-percent * (n + sizes) // (100 + percent))


# --- DivideSkip ---------------------------------------------------------------------------------------------------


class InvertedLists:
    """For each shingle of some sets, the rising numbers of those that have it."""

    def __init__(self, sets: list[np.ndarray]):
        self.count = len(sets)
        self.sizes = np.array([len(s) for s in sets], np.int64)
        tokens, owner = np.concatenate(sets), np.repeat(np.arange(self.count), self.sizes)
        order = np.argsort(tokens, kind="stable")
        tokens, self.owner = tokens[order], owner[order]
        first = np.flatnonzero(np.r_[True, tokens[1:] != tokens[:-1]])
        self.tokens, self.begin = tokens[first], np.r_[first, len(tokens)]
        # lists and their entries as one rising sequence, for probes of many lists at once
        self.packed = np.repeat(np.arange(len(first)), np.diff(self.begin)) * self.count + self.owner

    def partners(self, s: np.ndarray, ok: np.ndarray, percent: int) -> list[int]:
        """Those of the sets flagged in ``ok`` that link with ``s``, by rising number."""
        ok = ok & near_sizes(len(s), self.sizes, percent)
        if not ok.any():
            return []
        at = np.minimum(np.searchsorted(self.tokens, s), len(self.tokens) - 1)
        lists = at[self.tokens[at] == s]
        need = -(-percent * len(s) // 100)  # the overlap that any partner has at least
        if len(lists) < need:
            return []
        length = self.begin[lists + 1] - self.begin[lists]
        order = np.argsort(length, kind="stable")
        lists, length = lists[order], length[order]
        longs = min(need - 1, int(need / (PROBE * math.log2(max(2, int(length[-1]))) + 1)))
        cut = len(lists) - longs
        # the short lists' entries that may be partners, as lists of numbers
        inner = np.arange(int(length[:cut].sum())) - np.repeat(np.r_[0, np.cumsum(length[:cut])[:-1]], length[:cut])
        entries = self.owner[inner + np.repeat(self.begin[lists[:cut]], length[:cut])]
        keep = ok[entries]
        if not keep.any():
            return []
        cuts = np.r_[0, np.cumsum(np.bincount(np.repeat(np.arange(cut), length[:cut])[keep], minlength=cut))].tolist()
        flat = entries[keep].tolist()
        merged = list(merge_skip([flat[a:b] for a, b in itertools.pairwise(cuts) if b > a], need - longs))
        if not merged:
            return []
        found, have = np.array([x for x, _ in merged]), np.array([n for _, n in merged])
        total = overlap_needed(len(s), self.sizes[found], percent)
        left, long = longs, lists[cut:]
        while left and len(found):
            some = long[longs - left : longs - left + max(1, 200_000 // len(found))]
            keys = some[:, None] * self.count + found
            have = have + (self.packed[np.minimum(np.searchsorted(self.packed, keys), len(self.packed) - 1)] == keys).sum(axis=0)
            left -= len(some)
            alive = have + left >= total
            found, have, total = found[alive], have[alive], total[alive]
        return found[have >= total].tolist()


def merge_skip(lists: list[list[int]], least: int) -> Iterator[tuple[int, int]]:
    """(entry, lists it is in) of the entries in at least ``least`` of some rising lists, by a heap of their heads.

    Where the top entry is in too few, the lists before the next entry that can be in enough skip to it.
    """
    heap = [(x[0], k, 0) for k, x in enumerate(lists)]
    heapq.heapify(heap)
    while len(heap) >= least:
        top = heap[0][0]
        popped = [heapq.heappop(heap)]
        while heap and heap[0][0] == top:
            popped.append(heapq.heappop(heap))
        if len(popped) >= least:
            yield top, len(popped)
            bound = top + 1
        else:
            while len(popped) < least - 1:
                popped.append(heapq.heappop(heap))
            bound = heap[0][0]
        for _, k, at in popped:
            x = lists[k]
            at = bisect_left(x, bound, at)
            if at < len(x):
                heapq.heappush(heap, (x[at], k, at))


class Names:
    """The components, by name, of a job's sets; those that a link joins have one name from then on."""

    def __init__(self, names: Iterable[int], every: bool):
        self.of = np.array(list(names), np.int64)
        self.now: dict[int, int] = {}
        self.every = every

    def open(self, name: int) -> np.ndarray:
        """Flags the sets of other components than ``name``'s, or all."""
        return np.ones(len(self.of), bool) if self.every else self.of != self.current(name)

    def current(self, name: int) -> int:
        while name in self.now:
            name = self.now[name]
        return name

    def link(self, name: int, i: int) -> bool:
        """Notes that a set of component ``name`` links with set i; false if that says nothing new."""
        if self.every:
            return True
        mine, other = self.current(name), int(self.of[i])
        if mine == other:
            return False
        self.now[other] = mine
        self.of[self.of == other] = mine
        return True


def search(lists: InvertedLists, names: Names, queries: Iterable[tuple[int, int, np.ndarray]], percent: int) -> Iterator[tuple[int, int]]:
    """(query, set) of the links that DivideSkip finds; ``queries`` are (first set to link with, name, shingles)."""
    for k, (first, name, s) in enumerate(queries):
        ok = names.open(name)
        ok[:first] = False
        for i in lists.partners(s, ok, percent):
            if names.link(name, i):
                yield k, i


# --- lists of leading shingles ------------------------------------------------------------------------------------


def can_link(n1: np.ndarray, p1: np.ndarray, n2: np.ndarray, p2: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of these sizes that first meet at these places of the order can reach the similarity."""
    return near_sizes(n1, n2, percent) & (np.minimum(n1 - p1, n2 - p2) >= overlap_needed(n1, n2, percent))


class Meetings:
    """(class, block) for the classes of some lists that are to be searched for in a block of others.

    A list's rows are (own, n, place, block, weight, label). Of two classes, the one in the lighter block is sent.
    """

    def __init__(self, percent: int):
        self.percent = percent
        self.found: list[np.ndarray] = []
        self.held = 0

    def add(self, own: np.ndarray, block: np.ndarray) -> None:
        if len(own):
            self.found.append(np.unique(np.stack([own, block], axis=1), axis=0))
            self.held += len(self.found[-1])

    def take(self) -> np.ndarray:
        out = np.unique(np.concatenate(self.found), axis=0) if self.found else np.zeros((0, 2), np.int64)
        self.found, self.held = [], 0
        return out

    def sent(self, x: tuple, y: tuple) -> np.ndarray:
        """Whether row x (n, place, block, weight, label) is to be sent to y's block."""
        (n1, p1, b1, w1, l1), (n2, p2, b2, w2, l2) = x, y
        return (l1 != l2) & ((w1 < w2) | ((w1 == w2) & (b1 < b2))) & can_link(n1, p1, n2, p2, self.percent)

    def same_length(self, own: np.ndarray, rest: np.ndarray, begin: np.ndarray, m: int) -> None:
        """Lists of ``m`` rows each, all pairs at once."""
        i, j = np.triu_indices(m, 1)
        step = max(1, 500_000 // len(i))
        for a in range(0, len(begin), step):
            x, y = (begin[a : a + step, None] + i).ravel(), (begin[a : a + step, None] + j).ravel()
            apart = (rest[4][x] != rest[4][y]) & (rest[2][x] != rest[2][y])
            x, y = x[apart], y[apart]
            for u, v in ((x, y), (y, x)):
                ok = self.sent(tuple(c[u] for c in rest), tuple(c[v] for c in rest))
                self.add(own[u[ok]], rest[2][v[ok]])

    def one(self, own: np.ndarray, rest: np.ndarray) -> None:
        """A long list: rows alike in all but the class are compared once, with the least place of each size in a block."""
        if (rest[4] == rest[4][0]).all():
            return
        kinds, back = np.unique(rest, axis=1, return_inverse=True)
        order = np.argsort(back.ravel(), kind="stable")
        first = np.searchsorted(back.ravel()[order], np.arange(kinds.shape[1] + 1))
        # the first of the kinds that differ in place alone has the least place
        by = np.lexsort((kinds[1], kinds[0], kinds[2], kinds[4]))
        some = kinds[:, by]
        lead = np.r_[True, (some[0, 1:] != some[0, :-1]) | (some[2, 1:] != some[2, :-1]) | (some[4, 1:] != some[4, :-1])]
        targets = some[:, lead]
        step = max(1, 1_000_000 // targets.shape[1])
        for a in range(0, kinds.shape[1], step):
            ok = self.sent(tuple(c[a : a + step, None] for c in kinds), tuple(c[None] for c in targets))
            x, y = np.nonzero(ok)
            pairs = np.unique(np.stack([x + a, targets[2][y]], axis=1), axis=0) if len(x) else np.zeros((0, 2), np.int64)
            count = (first[1:] - first[:-1])[pairs[:, 0]]
            inner = np.arange(int(count.sum())) - np.repeat(np.r_[0, np.cumsum(count)[:-1]], count) if len(pairs) else _NONE
            self.add(own[order[inner + np.repeat(first[pairs[:, 0]], count)]], np.repeat(pairs[:, 1], count))


def meetings(rows: DataFrame, percent: int) -> DataFrame:
    """Distinct (own, block) from rows (token, cell, own, n, place, block, weight, label); lists are read one after another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = Meetings(percent)
        held = [_NONE] * 8

        def out(limit: int) -> Iterator[pa.RecordBatch]:
            if met.held > limit and len(p := met.take()):
                yield pa.RecordBatch.from_arrays([pa.array(p[:, 0]), pa.array(p[:, 1])], names=["own", "block"])

        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                held = [np.concatenate([h, c.to_numpy()]) for h, c in zip(held, batch.columns, strict=True)]
            token, cell, own = held[:3]
            rest = np.stack(held[3:])
            begin = np.flatnonzero(np.r_[True, (token[1:] != token[:-1]) | (cell[1:] != cell[:-1])]) if len(token) else _NONE
            length = np.diff(np.r_[begin, len(token)])
            keep = len(token)
            if len(begin) and batch is not None:  # the last list may go on
                keep, begin, length = int(begin[-1]), begin[:-1], length[:-1]
            for m in np.unique(length[length > 1]).tolist():
                if m <= 32:
                    met.same_length(own, rest, begin[length == m], m)
                    yield from out(500_000)
                    continue
                for a in begin[length == m].tolist():
                    met.one(own[a : a + m], rest[:, a : a + m])
                    yield from out(500_000)
            held = [h[keep:] for h in held]
        yield from out(0)

    dealt = rows.repartition(width(rows.sparkSession), "token", "cell").sortWithinPartitions("token", "cell")
    return dealt.select("token", "cell", "own", "n", "place", "block", "weight", "label").mapInArrow(run, "own long, block long").distinct()


def in_cells(rows: DataFrame, common: np.ndarray, counts: np.ndarray) -> DataFrame:
    """``rows`` with a cell: 0, but where a list is longer than LIST its rows are dealt into parts, and a cell is a pair of parts."""
    long = counts > LIST
    spark = rows.sparkSession
    table = spark.createDataFrame(list(zip(common[long].view(np.int64).tolist(), (-(-counts[long] // LIST)).tolist(), strict=True)), "token long, parts long")
    part = F.pmod(F.xxhash64("own"), F.col("parts"))
    cells = F.transform(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda o: F.least(part, o) * F.col("parts") + F.greatest(part, o))
    return rows.join(F.broadcast(table), "token", "left").withColumn("cell", F.explode(F.when(F.col("parts").isNull(), F.array(F.lit(0).cast("long"))).otherwise(cells))).drop("parts")


# --- the join -----------------------------------------------------------------------------------------------------


def text_hash():
    return F.xxhash64("text").alias("th")


def described(docs: DataFrame, shingles: Shingles, percent: int, common: np.ndarray, counts: np.ndarray) -> DataFrame:
    """doc_id, th (the text's hash), n (set size), sig (16 bytes), the leading shingles, the profile, the least and the greatest shingle of each row."""
    held = docs.sparkSession.sparkContext.broadcast((common, counts))
    kept = [c for c in docs.columns if c == "key"]

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, counts = held.value
        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                part = batch.slice(a, 1000)
                n, sig, lead, outline, ends = [], [], [], [], ([], [])
                for s in sets_of(part.column(1), shingles):
                    n.append(len(s))
                    sig.append(signature(s))
                    outline.append(profile(s))
                    for end, x in zip(ends, (s[:1], s[-1:]), strict=True):
                        end.append(int(x.view(np.int64)[0]) if len(s) else None)
                    lead.append(leading(s, common, counts, percent).view(np.int64) if len(s) else s.view(np.int64))
                offsets = np.r_[0, np.cumsum([len(x) for x in lead])].astype(np.int32)
                tokens = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(lead), pa.int64()))
                columns = [part.column(0), part.column(2), pa.array(n, pa.int64()), pa.array(sig, pa.binary()), tokens, pa.array(outline, pa.binary()), *(pa.array(e, pa.int64()) for e in ends), *part.columns[3:]]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "th", "n", "sig", "lead", "profile", "head", "tail", *kept])

    kind = "doc_id long, th long, n long, sig binary, lead array<long>, profile binary, head long, tail long" + "".join(f", {c} binary" for c in kept)
    out = written(docs.select("doc_id", "text", text_hash(), *kept).mapInArrow(describe, kind), "shingles")
    held.destroy()
    return out


def in_blocks(classes: DataFrame, end: str) -> DataFrame:
    """sig, block, weight (classes in the block, about) of the classes that share their ``end`` (head or tail) with others."""
    shared = classes.groupBy(end).agg(F.count("*").alias("c"), F.sum("n").alias("total")).where("c > 1")
    parts = F.greatest(F.ceil(F.col("c") / BLOCK), F.ceil(F.col("total") / BLOCK_SHINGLES))
    placed = classes.select("sig", end).join(shared.select(end, "c", parts.alias("parts")).hint("merge"), end)
    part = F.pmod(F.xxhash64("sig"), F.col("parts"))
    return placed.select("sig", F.xxhash64(end, part, F.lit(end)).alias("block"), F.ceil(F.col("c") / F.col("parts")).alias("weight"))


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for a in range(0, batch.num_rows, 256):
            yield from zip(*(c.to_pylist() for c in batch.slice(a, 256).columns), strict=True)


def jobs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple], Iterator[tuple]]]:
    """The jobs of rows (job, query, sig, ...) sorted by these: the block's rows, and the queries that come to it."""
    for job, rows in itertools.groupby(rows_of(batches), key=lambda r: r[0]):
        indexed, later = [], iter(())
        for row in rows:
            if row[1]:
                later = itertools.chain([row], rows)
                break
            if not indexed or indexed[-1][2] != row[2]:
                indexed.append(row)
        yield job, indexed, later


def by_job(rows: DataFrame) -> DataFrame:
    return rows.repartition(width(rows.sparkSession), "job").sortWithinPartitions("job", "query", "sig")


def batches_of(rows: Iterator[tuple], kinds: dict[str, pa.DataType], step: int = 5000) -> Iterator[pa.RecordBatch]:
    while some := list(itertools.islice(rows, step)):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), kinds.values(), strict=True)], names=list(kinds))


def survivors(jobs: DataFrame, classes: DataFrame, percent: int, own: bool, every: bool) -> DataFrame:
    """Those rows of ``jobs`` (job, query, sig, label) that may link, by their profiles. With ``own``, blocks are searched by their own classes."""
    rows = jobs.join(classes.select("sig", "n", "profile").hint("merge"), "sig").select("job", "query", "sig", "label", "n", "profile")

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for job, indexed, queries in jobs_of(batches):
            if not indexed:
                continue
            outlines = Outlines([r[5] for r in indexed], np.array([r[4] for r in indexed], np.int64))
            names = np.array([r[3] for r in indexed], np.int64)
            alive, numbers = np.zeros(len(indexed), bool), np.arange(len(indexed))
            for k, (_, _, sig, label, n, outline) in enumerate(indexed if own else queries):
                ok = numbers > k if own else numbers >= 0
                may = outlines.may_link(outline, n, ok if every else ok & (names != label), percent)
                if may.any():
                    alive |= may
                    if own:
                        alive[k] = True
                    else:
                        yield job, 1, sig, label
            for i in np.flatnonzero(alive).tolist():
                yield job, 0, indexed[i][2], indexed[i][3]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batches_of(found(batches), {"job": pa.int64(), "query": pa.int32(), "sig": pa.binary(), "label": pa.int64()})

    return by_job(rows).mapInArrow(run, "job long, query int, sig binary, label long")


def links_of(rows: DataFrame, sets: DataFrame, percent: int, own: bool, every: bool) -> DataFrame:
    """Links (u, v) of signatures found in the jobs; ``rows`` are (job, query, sig, label), ``sets`` (sig, shingles)."""
    rows = rows.join(sets.hint("merge"), "sig").select("job", "query", "sig", "label", "shingles")

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for _, indexed, queries in jobs_of(batches):
            if not indexed:
                continue
            sets = [np.frombuffer(r[4], _U) for r in indexed]
            lists, names = InvertedLists(sets), Names((r[3] for r in indexed), every)
            if own:
                asked = ((k + 1, indexed[k][3], s) for k, s in enumerate(sets))
                yield from ((indexed[k][2], indexed[i][2]) for k, i in search(lists, names, asked, percent))
                continue
            for _, _, sig, label, shingles in queries:
                yield from ((sig, indexed[i][2]) for _, i in search(lists, names, [(0, label, np.frombuffer(shingles, _U))], percent))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batches_of(found(batches), {"u": pa.binary(), "v": pa.binary()})

    return by_job(rows).mapInArrow(run, "u binary, v binary")


def sets_again(docs: DataFrame, wanted: DataFrame, shingles: Shingles) -> DataFrame:
    """sig, shingles of the classes in ``wanted`` (sig, rep, th), whose texts are read again.

    Rows are met by id and text hash, so rows that share an id, or have none, meet their own class alone.
    """
    bucket = F.pmod(F.xxhash64("rep", "th"), F.lit(BUCKETS))
    buckets = wanted.select(bucket.alias("bucket")).distinct()
    few = docs.select(F.col("doc_id").alias("rep"), text_hash(), "text").withColumn("bucket", bucket).join(F.broadcast(buckets), "bucket", "left_semi")
    texts = few.join(wanted.hint("merge"), ["rep", "th"]).select("sig", "text")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                sets = list(sets_of(part.column(1), shingles))
                own = [i for i, (s, sig) in enumerate(zip(sets, part.column(0).to_pylist(), strict=True)) if signature(s) == sig]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(own, pa.int64())), pa.array([sets[i].tobytes() for i in own], pa.binary())], names=["sig", "shingles"])

    # rows of one id and text are one
    return texts.mapInArrow(packed, "sig binary, shingles binary").dropDuplicates(["sig"])


def found_links(jobs: DataFrame, docs: DataFrame, classes: DataFrame, shingles: Shingles, percent: int, own: bool, every: bool) -> DataFrame:
    """The links of some jobs, as a written table."""
    left = written(survivors(jobs, classes, percent, own, every), "survivors")
    wanted = classes.select("sig", "rep", "th").join(left.select("sig").distinct().hint("merge"), "sig")
    sets = written(sets_again(docs, wanted, shingles), "sets")
    links = written(links_of(left, sets, percent, own, every), "found")
    discard(left, sets)
    return links


def joined(docs: DataFrame, size: int, percent: int, every: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows, classes and links of ``docs`` (doc_id, text and maybe key): enough links for the components, or every one."""
    shingles = Shingles(size, word_key())
    common, counts = frequent_shingles(docs, shingles)
    rows = described(docs, shingles, percent, common, counts)
    of_class = [F.min(F.struct("doc_id", "th")).alias("least"), F.count("*").alias("copies"), *[F.first(c).alias(c) for c in ("n", "lead", "profile", "head", "tail")]]
    classes = written(rows.where("n > 0").groupBy("sig").agg(*of_class).withColumns({"own": F.xxhash64("sig"), "rep": F.col("least.doc_id"), "th": F.col("least.th")}).drop("least"), "classes")
    placed = written(in_blocks(classes, "head"), "blocks")
    inside = placed if every else placed.unionByName(in_blocks(classes, "tail"))
    jobs = inside.select(F.col("block").alias("job"), F.lit(0).alias("query"), "sig", F.xxhash64("sig").alias("label"))
    links = found_links(jobs, docs, classes, shingles, percent, True, every)
    known = None if every else components(links)

    # a class with a head of its own is a block of its own
    slim = classes.select("sig", "own", "n").join(placed.hint("merge"), "sig", "left")
    slim = slim.select("sig", "own", "n", F.coalesce("block", "own").alias("block"), F.coalesce("weight", F.lit(1).cast("long")).alias("weight"))
    if known is not None:
        slim = slim.join(known.select(F.col("node").alias("sig"), F.xxhash64("root").alias("label")).hint("merge"), "sig", "left").withColumn("label", F.coalesce("label", "own"))
    else:
        slim = slim.withColumn("label", F.col("own"))
    slim = written(slim, "named")
    listed = classes.select("sig", "lead").join(slim.hint("merge"), "sig")
    listed = listed.select("own", "n", "block", "weight", "label", F.posexplode("lead").alias("place", "token"))
    listed = listed.withColumn("place", F.col("place").cast("long"))
    sent = written(meetings(in_cells(listed, common, counts), percent), "meetings")
    queries = sent.select(F.col("block").alias("job"), "own").join(slim.select("own", "sig", "label").hint("merge"), "own").select("job", F.lit(1).alias("query"), "sig", "label")
    asked = sent.select(F.col("block").alias("job")).distinct()
    indexed = slim.select(F.col("block").alias("job"), F.lit(0).alias("query"), "sig", "label").join(asked.hint("merge"), "job", "left_semi")
    more = found_links(queries.unionByName(indexed), docs, classes, shingles, percent, False, every)
    discard(sent, placed, slim)
    return rows, classes, links.unionByName(more)


LOW = -(1 << 63)


def keyed(docs: DataFrame, key: str | None = None) -> DataFrame:
    return docs.select(F.coalesce("doc_id", F.lit(LOW)).alias("doc_id"), "text", *([F.col(key).alias("key")] if key else []))


def jaccard_links(docs: DataFrame, size: int = 4, percent: int = 85) -> tuple[DataFrame, DataFrame]:
    """Every link between different sets of ``docs`` (doc_id, text), and which rows have which set.

    The first result is (u, v), u < v, the signatures of two linked classes, each pair once. The second has a row
    (doc_id, n_shingles, sig, n_links) for each row of ``docs``: n_links counts the other rows that it links with,
    copies of its own set among them; a null or empty text, or one without words, has none.
    """
    rows, classes, links = joined(keyed(docs), size, percent, True)
    pairs = links.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    sides = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    partners = sides.join(classes.select(F.col("sig").alias("v"), "copies").hint("merge"), "v").groupBy(F.col("u").alias("sig")).agg(F.sum("copies").alias("others"))
    degree = classes.select("sig", "copies").join(partners.hint("merge"), "sig", "left").select("sig", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    told = of_rows(rows.select("doc_id", "n", "sig"), classes, degree)
    return pairs, told.select(F.when(F.col("doc_id") != LOW, F.col("doc_id")).alias("doc_id"), F.col("n").alias("n_shingles"), "sig", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))


def of_rows(rows: DataFrame, classes: DataFrame, told: DataFrame) -> DataFrame:
    """``rows`` with the other columns of ``told`` (sig, ...), null for empty sets.

    Classes that hold more than one in 4096 of all copies are fewer than 4096 and broadcast; so no key of the
    shuffled join has more rows than that.
    """
    some = rows.where("n > 0")
    total = classes.agg(F.sum("copies")).first()[0] or 0
    hot = classes.where(F.col("copies") > max(64, total >> 12)).select("sig")
    few = told.join(F.broadcast(hot), "sig", "left_semi")
    rest = told.join(F.broadcast(hot), "sig", "left_anti")
    out = some.join(F.broadcast(few), "sig").unionByName(some.join(F.broadcast(hot), "sig", "left_anti").join(rest.hint("merge"), "sig", "left"))
    return out.unionByName(rows.where("n = 0"), allowMissingColumns=True)


def jaccard_groups(docs: DataFrame, size: int = 4, percent: int = 85, key: str | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id reachable by links) for each row of ``docs`` (doc_id, text).

    Sets of ``size``-word shingles link at ``percent`` hundredths of Jaccard similarity or more. A null text, or
    one without words, has an empty set and stands alone; so component_id is its own doc_id. Repeated rows, and
    rows of one doc_id with several texts, are rows of their own, which all carry that id. A null doc_id counts
    as less than all others and stays null. An empty table gives no row. Other columns are ignored, but for a
    binary ``key``: with it, the result has that column too, and ``component``, which is the same for rows of one
    component and for no others, whatever their ids; it is null for an empty set.
    """
    docs = keyed(docs, key)
    rows, classes, links = joined(docs, size, percent, False)
    roots = components(links)
    # the least id of each class, then of each component; only linked classes are in ``roots``
    least = roots.join(classes.select("sig", "rep"), roots["node"] == F.col("sig")).groupBy("root").agg(F.min("rep").alias("least"))
    linked = roots.join(least, "root").select(F.col("node").alias("sig"), "least", "root")
    told = classes.select("sig", "rep").join(linked.hint("merge"), "sig", "left").select("sig", F.coalesce("least", "rep").alias("component"), F.coalesce("root", "sig").alias("root"))
    out = of_rows(rows.select("doc_id", "n", "sig", *["key"] * bool(key)), classes, told)
    whole = lambda c: F.when(c != LOW, c)
    return out.select(whole(F.col("doc_id")).alias("doc_id"), F.col("n").alias("n_shingles"), whole(F.coalesce("component", "doc_id")).alias("component_id"), *([F.col("key").alias(key), F.col("root").alias("component")] if key else []))


def op10_jaccard(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return jaccard_groups(table(spark, sf_dir, "documents"))
