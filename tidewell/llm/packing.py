"""Vector bin packing of tokenised examples into training sequences.

Each example is a vector of demands (tokens, one segment, loss-bearing tokens), each sequence a bin with a limit
on every one of them. The open bin repeatedly takes the waiting example with the largest dot product of its
demand and the bin's free room, both as shares of the limits. Where no waiting example fits whole, one is cut
so that the bin is full; its rest waits on. A bin that another limit (or the end of a partition) closes before it
is full is cut into sequences whose lengths are powers of two, which need no padding. A partition is packed in
one pass with a bounded pool, so no row is shuffled; sequences never span partitions.

A piece as long as a sequence has the largest dot product that there is, so it gets a bin of its own at once. Of
a waiting example only the ids that are not yet placed are held.
"""

from __future__ import annotations

import functools
import os
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keyed_hashes, lower_table, row_blocks, same_bytes, text_buffers, word_key

CACHE_WORDS = 400_000
END_ID = 1
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _classes() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of bytes: small letters for capital ones; 0 white space, 1 letter, 2 digit, 3 mark; those left to the tokenizer."""
    kind = np.full(256, 3, np.uint8)
    kind[[9, 10, 13, 32]] = 0
    kind[97:123] = kind[128:] = 1
    kind[48:58] = 2
    odd = np.ones(256, bool)
    odd[[9, 10, 13]] = odd[32:127] = odd[0x80:0xC0] = odd[0xC3] = False
    return lower_table(), kind, odd


_LOWER, _KIND, _ODD = _classes()
_SLOTS = 1 << 20
#: After an apostrophe that starts a run of marks, these letters belong to it.
_CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


class WordTokens:
    """Token ids of texts, word by word.

    The vocabulary splits a text into runs of letters, single digits, runs of marks and a few contractions, in
    small letters, and never joins what white space parts. Such words are found over the bytes of many texts at
    once, hashed under a key of the process, and looked up in a bounded table; the tokenizer sees each new one once.
    The bytes of a word are compared with those that the table has under its hash. A text with a word that differs,
    with characters other than ASCII and the letters from U+00C0 to U+00FF, or with ``<|``, goes to the tokenizer as
    it is.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.key = word_key()
        self.forget()

    def forget(self) -> None:
        self.slot_hash, self.slot_word = np.zeros(_SLOTS, np.uint64), np.zeros(_SLOTS, np.int32)
        self.number: dict[int, int] = {}
        self.first, self.flat = [0], np.zeros(0, np.uint32)
        self.offsets = np.zeros(1, np.int64)
        self.letters, self.letter_ends = np.zeros(0, np.uint8), np.zeros(1, np.int64)  # the bytes of all words

    def plain(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, hashes: list[int], words: list[str]) -> None:
        """New words, many of them in one text for the tokenizer."""
        parts = [self.flat]
        for a in range(0, len(words), 512):
            part = words[a : a + 512]
            e = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            cuts = np.searchsorted(np.array(e.word_ids), np.arange(1, len(part) + 1))
            self.first += (self.first[-1] + cuts).tolist()
            parts.append(np.array(e.ids, np.uint32))
        for h in hashes:
            self.number[h] = len(self.number)
        self.flat, self.offsets = np.concatenate(parts), np.array(self.first)
        raw = [w.encode() for w in words]
        self.letters = np.concatenate([self.letters, np.frombuffer(b"".join(raw), np.uint8)])
        self.letter_ends = np.concatenate([self.letter_ends, self.letter_ends[-1] + np.cumsum([len(r) for r in raw])])

    def numbers(self, h: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The numbers of words by their hashes."""
        slot = (h & np.uint64(_SLOTS - 1)).astype(np.int64)
        out = self.slot_word[slot].astype(np.int64)
        miss = np.flatnonzero(self.slot_hash[slot] != h)
        if len(miss):
            u, at, back = np.unique(h[miss], return_index=True, return_inverse=True)
            keys = u.tolist()
            new = [i for i, x in enumerate(keys) if x not in self.number]
            if new:
                spots = miss[at[new]]
                raw = data.tobytes()
                self.learn([keys[i] for i in new], [raw[a:b].decode() for a, b in zip(starts[spots].tolist(), ends[spots].tolist(), strict=True)])
            numbers = np.array([self.number[x] for x in keys])
            out[miss] = numbers[back]
            own = (u & np.uint64(_SLOTS - 1)).astype(np.int64)
            free = self.slot_hash[own] == 0
            self.slot_hash[own[free]], self.slot_word[own[free]] = u[free], numbers[free]
            # where two new words meet in a free slot, the later one has it: its hash and number were set in one order
        return out

    def block(self, raw: np.ndarray, off: np.ndarray) -> list[np.ndarray | None]:
        """Ids of each text, None for those left to the tokenizer."""
        data = _LOWER[raw[off[0] : off[-1]]]
        cuts = off - off[0]
        n = len(data)
        if not n:
            return [np.zeros(0, np.uint32)] * (len(off) - 1)
        if len(self.number) > CACHE_WORDS:
            self.forget()
        after = np.append(data[1:], np.uint8(0))
        lead = data == 0xC3
        # capital letters beyond ASCII: the second byte 80 to 9E, but 97 (a sign, as is B7)
        second = np.append(False, lead[:-1])
        data = np.where(second & (data >= 0x80) & (data <= 0x9E) & (data != 0x97), data + np.uint8(32), data)
        sign = second & ((data == 0x97) | (data == 0xB7))
        bad = _ODD[data] | sign | ((data == 60) & (after == 124))
        odd = np.zeros(len(cuts) - 1, bool)
        if bad.any():
            odd[np.searchsorted(cuts, np.flatnonzero(bad), side="right") - 1] = True
        kind = _KIND[data]
        start = np.ones(n, bool)
        start[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
        inner = cuts[(cuts > 0) & (cuts < n)]
        start[inner] = True
        quotes = np.flatnonzero((data == 39) & start)
        if len(quotes):
            row_end = cuts[np.searchsorted(cuts, quotes, side="right")]
            for c in _CONTRACTIONS:
                k = len(c)
                q = quotes[quotes + k < row_end]
                for j, ch in enumerate(c):
                    q = q[data[q + 1 + j] == ord(ch)]
                start[q + 1] = False
                rest = q[q + 1 + k < n] + 1 + k
                start[rest] = True
        start &= kind > 0
        starts = np.flatnonzero(start)
        # a word ends where the next one starts, or before at white space or the end of its text
        limit = np.append(starts[1:], n)
        gap = np.append(np.flatnonzero(kind == 0), n)
        ends = np.minimum(limit, gap[np.searchsorted(gap, starts)])
        if odd.any():
            own = ~odd[np.searchsorted(cuts, starts, side="right") - 1]
            starts, ends = starts[own], ends[own]
        words = self.numbers(keyed_hashes(data, starts, ends, self.key), data, starts, ends)
        known = same_bytes(data, starts, ends, self.letters, self.letter_ends[words], self.letter_ends[words + 1])
        if not known.all():
            odd[np.searchsorted(cuts, starts[~known], side="right") - 1] = True
        size = self.offsets[words + 1] - self.offsets[words]
        total = np.r_[0, np.cumsum(size)]
        ids = self.flat[np.arange(total[-1]) + np.repeat(self.offsets[words] - total[:-1], size)]
        place = total[np.searchsorted(starts, cuts)].tolist()
        return [None if o else ids[a:b] for o, a, b in zip(odd.tolist(), place, place[1:], strict=False)]

    def encode(self, column) -> list[np.ndarray]:
        """Ids of the rows of an Arrow column of texts; a null text has none."""
        raw, off = text_buffers(column)
        out: list[np.ndarray | None] = []
        for a, b in row_blocks(off, 1 << 20):
            out += self.block(raw, off[a : b + 1])
        left = [i for i, ids in enumerate(out) if ids is None]
        if left:
            for i, ids in zip(left, self.plain([column[i].as_py() for i in left]), strict=True):
                out[i] = ids
        return out


@functools.lru_cache(maxsize=2)
def word_tokens(path: str) -> WordTokens:
    return WordTokens(path)


class VectorPacker:
    """Packs examples given by ``add``; ``pieces`` of (key, start, stop, sequence, offset) come as bins close.

    ``loss_from`` is the place in an example from which its tokens bear loss: 0 for plain documents, the length
    of the prompt for instruction data.
    """

    def __init__(self, tokens: int = 2048, segments: int = 64, loss: int | None = None, pool: int = 1024):
        self.limit = np.array([tokens, segments, tokens if loss is None else loss], float)
        self.pool = pool
        self.keys: list = []
        self.waiting = np.zeros((0, 3), np.int64)  # start, stop, loss_from
        self.incoming: list[tuple[int, int, int]] = []
        self.load = 0  # tokens that wait
        self.sequences = 0

    def add(self, key, length: int, loss_from: int = 0) -> Iterator[tuple]:
        start, size = 0, int(self.limit[0])
        while length - start >= size and min(size, max(0, start + size - loss_from)) <= self.limit[2]:
            yield key, start, start + size, self.sequences, 0
            self.sequences += 1
            start += size
        if start < length:
            self.keys.append(key)
            self.incoming.append((start, length, loss_from))
            self.load += length - start
        if len(self.keys) >= self.pool or self.load > self.pool * size:
            yield from self.drain(self.pool // 2, self.pool * size // 2)

    def finish(self) -> Iterator[tuple]:
        yield from self.drain(0, 0)

    def drain(self, examples: int, tokens: int) -> Iterator[tuple]:
        """Closes bins until at most so many examples with so many tokens wait."""
        if self.incoming:
            self.waiting = np.concatenate([self.waiting, np.array(self.incoming, np.int64)])
            self.incoming = []
        while len(self.keys) > examples or self.load > tokens:
            placed = self.fill()
            self.load -= sum(stop - start for _, start, stop in placed)
            yield from self.close(placed)

    def fill(self) -> list[tuple]:
        """The pieces of one bin."""
        free, placed = self.limit.copy(), []
        while self.keys and free[0] > 0 and free[1] > 0:
            w = self.waiting
            demand = np.empty((len(w), 3))
            demand[:, 0] = w[:, 1] - w[:, 0]
            demand[:, 1] = 1
            demand[:, 2] = np.maximum(0, w[:, 1] - np.maximum(w[:, 0], w[:, 2]))
            fits = (demand <= free).all(axis=1)
            dot = demand @ (free / self.limit / self.limit)
            # the last segment of a bin goes to a piece that fills it, where there is one
            whole = fits if free[1] > 1 else fits & (demand[:, 0] == free[0])
            if whole.any():
                i = int(np.where(whole, dot, -1).argmax())
                stop = int(w[i, 1])
            else:
                i = int(demand[:, 0].argmax()) if free[2] > 0 else int((w[:, 2] - w[:, 0]).argmax())
                stop = self.cut(w[i], free)
                if stop <= w[i, 0]:
                    break
            start = int(w[i, 0])
            placed.append((self.keys[i], start, stop))
            free -= (stop - start, 1, max(0, stop - max(start, int(w[i, 2]))))
            if stop == w[i, 1]:
                self.keys[i] = self.keys[-1]
                w[i] = w[-1]
                self.keys.pop()
                self.waiting = w[:-1]
            else:
                w[i, 0] = stop
        return placed

    @staticmethod
    def cut(item: np.ndarray, free: np.ndarray) -> int:
        """Where to cut an example so that its first part fits."""
        start, stop, loss_from = (int(x) for x in item)
        return min(stop, start + int(free[0]), max(start, loss_from) + int(free[2]))

    def close(self, placed: list[tuple]) -> Iterator[tuple]:
        """The pieces of a bin: one sequence if it is full, else sequences of falling powers of two."""
        total, size = sum(stop - start for _, start, stop in placed), int(self.limit[0])
        sizes = [size] if total == size else [1 << b for b in range(total.bit_length()) if total >> b & 1]
        room, offset = sizes.pop(), 0
        for key, start, stop in placed:
            while start < stop:
                take = min(room - offset, stop - start)
                yield key, start, start + take, self.sequences, offset
                start, offset = start + take, offset + take
                if offset == room:
                    self.sequences += 1
                    room, offset = sizes.pop() if sizes else 0, 0


def pack_rows(rows: Iterable[tuple[int | None, bytes, int]], packer: VectorPacker, base: int) -> Iterator[tuple]:
    """Pieces (as SCHEMA has them) of examples (id, ids as bytes, the place from which they bear loss)."""
    held: dict[int, tuple[int | None, bytes, int, int]] = {}  # id, its tokens, those not yet placed and where they begin

    def told(pieces: Iterator[tuple]) -> Iterator[tuple]:
        for key, start, stop, sequence, offset in pieces:
            doc_id, total, data, first = held[key]
            yield doc_id, start, stop - start, zlib.crc32(data[4 * (start - first) : 4 * (stop - first)]), total, base + sequence, offset
            # the pieces of an example come in its order; what is placed is dropped once it is half of what is held
            if stop == total:
                del held[key]
            elif stop - first >= total - stop:
                held[key] = doc_id, total, data[4 * (stop - first) :], stop

    for key, (doc_id, data, loss_from) in enumerate(rows):
        held[key] = doc_id, len(data) // 4, data, 0
        yield from told(packer.add(key, len(data) // 4, loss_from))
    yield from told(packer.finish())


def pack_documents(docs: DataFrame, tokenizer_path: str, tokens: int = 2048, segments: int = 64, loss: int | None = None, end_id: int = END_ID, prompt: str | None = None) -> DataFrame:
    """One row per piece (SCHEMA) of the examples (doc_id, text) packed into sequences.

    An example is the ids of its text and ``end_id``. With ``prompt``, a column of texts, the ids of that one come
    before them, and bear no loss; ``loss`` limits the loss-bearing tokens of a sequence (by default all tokens may
    bear it). A null or empty text has the end id alone, a null prompt no ids; repeated rows are examples of their
    own, a null id stays null. Texts of any length are cut, never shortened. No row is left out; an empty table
    gives no row. Other columns, of whatever names, are ignored.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, end = word_tokens(tokenizer_path), np.array([end_id], "<u4").tobytes()

        def rows():
            for batch in batches:
                for a in range(0, batch.num_rows, 1000):
                    part = batch.slice(a, 1000)
                    leads = coder.encode(part.column(2)) if prompt else [np.zeros(0, "<u4")] * part.num_rows
                    for doc_id, lead, ids in zip(part.column(0).to_pylist(), leads, coder.encode(part.column(1)), strict=True):
                        yield doc_id, lead.astype("<u4").tobytes() + ids.astype("<u4").tobytes() + end, len(lead)

        context = TaskContext.get()
        base = (context.partitionId() if context else 0) << 33
        held: list[tuple] = []
        schema = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=schema)

        for row in pack_rows(rows(), VectorPacker(tokens, segments, loss), base):
            held.append(row)
            if len(held) >= 10_000:
                yield batch_of(held)
                held = []
        if held:
            yield batch_of(held)

    return docs.select("doc_id", "text", *[prompt] * bool(prompt)).mapInArrow(pack, SCHEMA)


def instruction_examples(conversations: DataFrame) -> DataFrame:
    """doc_id (the conversation's), prompt, text: each assistant turn of ``conversations`` (conv_id, turn, role, text) after the turn before it.

    The prompt is null where there is no turn before. Repeated turns, and turns of one number, are examples of
    their own, each after each of those before it.
    """
    answers = conversations.where(F.col("role") == "assistant").select(F.col("conv_id").alias("doc_id"), "turn", "text")
    before = conversations.select(F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).alias("turn"), F.col("text").alias("prompt"))
    return answers.join(before, ["doc_id", "turn"], "left").select("doc_id", "prompt", "text")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_packing(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return pack_documents(table(spark, sf_dir, "documents"), default_tokenizer())
