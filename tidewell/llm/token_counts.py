"""Token counts by a linear longest-match automaton over a word-piece vocabulary.

The vocabulary is a trie of bytes. Each node has a failure link, the node to go on from when the next byte does
not match, and the number of pieces that following it completes. Reading a word byte by byte and adding those
numbers gives the length of its greedy longest-match split in time linear in the word, with no piece built.
A word that has no full split is one unknown token.
"""

from __future__ import annotations

import base64
import functools
from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

CACHE_WORDS = 300_000
_NO = -1


class LongestMatch:
    """``first`` are the pieces that may start a word, ``later`` those that may go on with one."""

    def __init__(self, first: Iterable[bytes], later: Iterable[bytes]):
        self.next: list[dict[int, int]] = [{}, {}]  # node 0 starts a word, node 1 goes on with one
        ends: list[bool] = [False, False]
        for root, pieces in ((0, first), (1, later)):
            for piece in pieces:
                node = root
                for b in piece:
                    to = self.next[node].get(b)
                    if to is None:
                        to = self.next[node][b] = len(self.next)
                        self.next.append({})
                        ends.append(False)
                    node = to
                ends[node] |= bool(piece)
        n = len(self.next)
        self.fail, self.popped = [_NO] * n, [0] * n
        queue = deque([0, 1])
        while queue:
            node = queue.popleft()
            for b, to in self.next[node].items():
                if ends[to]:
                    self.fail[to], self.popped[to] = 1, 1
                else:
                    # drop pieces from the front of what was read before b until b can follow
                    at, pops = self.fail[node], self.popped[node]
                    while at != _NO and b not in self.next[at]:
                        pops += self.popped[at]
                        at = self.fail[at]
                    if at != _NO:
                        self.fail[to], self.popped[to] = self.next[at][b], pops
                queue.append(to)

    def count(self, word: bytes) -> int:
        """Pieces of the greedy split, or -1 if there is none; the empty word has 0."""
        if not word:
            return 0
        node, n = 0, 0
        for b in word:
            while (to := self.next[node].get(b)) is None:
                n += self.popped[node]
                node = self.fail[node]
                if node == _NO:
                    return -1
            node = to
        while node != 1:
            n += self.popped[node]
            node = self.fail[node]
            if node == _NO:
                return -1
        return n


def rank_file_pieces(path: str) -> tuple[list[bytes], list[bytes]]:
    """Pieces of a byte-level rank file: those after a blank start words, those without one go on with them."""
    with open(path, "rb") as f:
        pieces = [base64.b64decode(line.split()[0]) for line in f if line.strip()]
    first = [p[1:] for p in pieces if p[:1] == b" " and len(p) > 1]
    return first, [p for p in pieces if not p.isspace() and p[:1] != b" "]


@functools.lru_cache(maxsize=2)
def automaton(path: str) -> tuple[LongestMatch, dict[bytes, int]]:
    return LongestMatch(*rank_file_pieces(path)), {}


def token_counts(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """doc_id, n_words, n_tokens, n_unknown of each row of ``docs`` (doc_id, text).

    Words are what ASCII white space leaves; an unknown word is one token. A null or empty text has none.
    Repeated rows are counted each; other columns are ignored; an empty table gives no row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match, known = automaton(vocabulary_path)
        for batch in batches:
            words_of, tokens, unknown = [], [], []
            for a in range(0, batch.num_rows, 64):
                for text in batch.column(1).slice(a, 64).cast(pa.binary()).to_pylist():
                    words = (text or b"").split()
                    try:
                        n = list(map(known.__getitem__, words))
                    except KeyError:
                        if len(known) > CACHE_WORDS:
                            known.clear()
                        fresh = {w: match.count(w) for w in set(words) if w not in known}
                        n = [fresh[w] if w in fresh else known[w] for w in words]
                        known.update((w, k) for w, k in fresh.items() if len(w) <= 64)
                    bad = n.count(-1)
                    words_of.append(len(words))
                    tokens.append(sum(n) + 2 * bad)
                    unknown.append(bad)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (words_of, tokens, unknown))], names=["doc_id", "n_words", "n_tokens", "n_unknown"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_words long, n_tokens long, n_unknown long")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def op5_token_counts(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return token_counts(table(spark, sf_dir, "documents"), default_vocabulary())
