"""Personal data by a skip-chain conditional random field over number-like and address-like tokens.

Patterns with checks find the base spans. The field then labels every token that holds a digit or an ``@`` (no other
can be of a kind): its nodes are those tokens, chain edges join neighbours that one blank parts, and skip edges join a
token to the first one of its document with the same letters and digits, the same last seven digits, or the same
part before the ``@``. Tokens of base spans are fixed to their kind. Loopy belief propagation passes messages along
all edges at once, ``ROUNDS`` times, so a phone number that one place of a document shows plainly labels its other
places, and a pattern that swallowed two numbers at once (and failed its check) is told apart token by token. What the
field labels becomes a span only if it passes the check of its kind.

Weights are learned by pseudo-likelihood (each token given its neighbours' base labels) on a bounded sample: the
tokens of about ``sample_docs`` documents chosen by a hash of id and text and read whole on the executors, of which at
most ``per_label`` of each label, by hash, reach the driver. Tokens inside a match that failed its check have no known label: they are left
out, as targets and as neighbours. Every document is searched whole.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, table, written

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)
BITS, ROUNDS, SURE = 14, 20, 0.5
# The patterns of the contract. A match starts nowhere inside a run of digits, and no part gives back what it took, so
# that long runs are read once; both change no match.
AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
ACTIVE = re.compile(r"[0-9@]")
RUN = re.compile(r"[0-9]+|[A-Z]+|[a-z]+|(.)\1*", re.S)
#: What the field may call an address: a host without a dot too.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*")

#: What a number that the field labels may be made of.
NUMBER = {2: re.compile(r"[0-9\x20.-]+"), 3: re.compile(r"\+?[0-9\x20().-]+")}

Span = tuple[int, int, int]  # start, end, kind


def digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(number: str) -> bool:
    double = [0, 2, 4, 6, 8, 1, 3, 5, 7, 9]
    return sum(double[int(c)] if k % 2 else int(c) for k, c in enumerate(reversed(number))) % 10 == 0


def passes(kind: int, text: str) -> bool:
    """The check of a kind on the text of a match."""
    if KINDS[kind] == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in text.split("."))
    if KINDS[kind] == "card":
        return 12 <= len(d := digits(text)) <= 19 and luhn(d)
    return KINDS[kind] == "email" or 9 <= len(digits(text)) <= 15


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the address pattern: only the run of its characters before an ``@`` can start one."""
    end = 0
    for m in AT.finditer(text):
        if m.start() < end:
            continue
        a = m.start()
        while a > end and LOCAL_END.match(text, a - 1):
            a -= 1
        if a < m.start():
            yield a, m.end()
            end = m.end()


def base_spans(text: str) -> tuple[list[Span], list[Span]]:
    """(spans, failed matches), the spans by start, then kind."""
    found = [(a, b, 0) for a, b in emails(text)]
    failed = []
    for kind, pattern in ((1, IP), (2, CARD), (3, PHONE)):
        for m in pattern.finditer(text):
            (found if passes(kind, m[0]) else failed).append((*m.span(), kind))
    return sorted(found, key=lambda s: (s[0], s[2])), failed


@dataclass
class Nodes:
    starts: list[int]
    ends: list[int]
    labels: list[int]  # of base spans; 0 if none; -1 if unknown
    chain: list[tuple[int, int]]
    skip: list[tuple[int, int]]


def tokens(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words that hold a digit or an ``@``."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    blank = np.concatenate([[-1], np.flatnonzero((c == 32) | ((c >= 9) & (c <= 13))), [len(c)]])
    at = np.unique(np.searchsorted(blank, np.flatnonzero(((c >= 48) & (c <= 57)) | (c == 64))))
    return blank[at - 1] + 1, blank[at]


def keys(token: str) -> list[str]:
    """What a token shares with others that are joined to it."""
    plain = "".join(c for c in token.lower() if c.isalnum())
    out = ["w" + plain] if len(plain) > 3 else []
    if len(d := digits(token)) >= 7:
        out.append("d" + d[-7:])
    if "@" in token and len(local := token.lower().partition("@")[0].lstrip("(<[\"'")) > 2:
        out.append("l" + local)
    return out


def nodes(text: str, base: list[Span], failed: list[Span]) -> Nodes:
    starts, ends = (x.tolist() for x in tokens(text))
    labels = [0] * len(starts)
    edge = np.array(ends)
    for a, b, label in [(a, b, -1) for a, b, _ in failed] + [(a, b, kind + 1) for a, b, kind in reversed(base)]:
        i = int(np.searchsorted(edge, a, side="right"))
        while i < len(starts) and starts[i] < b:
            labels[i] = label
            i += 1
    chain = [(i, i + 1) for i in range(len(starts) - 1) if starts[i + 1] == ends[i] + 1 and text[ends[i]] == " "]
    first: dict[str, int] = {}
    near, skip = set(chain), set()
    for i, (a, b) in enumerate(zip(starts, ends, strict=True)):
        for k in keys(text[a:b]):
            if (j := first.setdefault(k, i)) != i and (j, i) not in near:
                skip.add((j, i))
    return Nodes(starts, ends, labels, chain, sorted(skip))


def shape(token: str) -> tuple[str, str]:
    """(runs of digits and letters with the lengths of digits', runs alone)"""
    long, short = [], []
    for m in RUN.finditer(token):
        c = token[m.start()]
        kind = "9" if "0" <= c <= "9" else "A" if "A" <= c <= "Z" else "a" if "a" <= c <= "z" else c
        long.append(f"{kind}{m.end() - m.start()}" if kind == "9" else kind)
        short.append(kind)
    return "".join(long), "".join(short)


def features(text: str, n: Nodes) -> list[list[int]]:
    """Hashed features of each node."""
    words = [text[a:b] for a, b in zip(n.starts, n.ends, strict=True)]
    shapes = [shape(w) for w in words]
    after, before = dict(n.chain), {j: i for i, j in n.chain}
    out = []
    for i, w in enumerate(words):
        d, bare = digits(w), w.strip(".,;:!?()[]<>\"'")
        said = ["bias", "s" + shapes[i][0], "c" + shapes[i][1], f"n{min(len(d), 20)}", f"@{min(w.count('@'), 2)}", f"+{w[:1] == '+'}", f"l{12 <= len(d) <= 19 and luhn(d)}", f"b{shape(bare)[0]}"]
        said += [f"o{bool(IP.fullmatch(bare) and passes(1, bare))}", f"e{bool(EMAIL.fullmatch(bare))}"]
        said += [f"p{shapes[before[i]][1] if i in before else '-'}", f"f{shapes[after[i]][1] if i in after else '-'}"]
        out.append([zlib.crc32(s.encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1) for s in said])
    return out


@dataclass(frozen=True)
class Field:
    weights: np.ndarray  # (features, labels)
    chain: np.ndarray  # (labels, labels): from a token to the next
    skip: np.ndarray  # (labels, labels), symmetric


def marginals(scores: np.ndarray, chain: np.ndarray, skip: np.ndarray, field: Field, rounds: int = ROUNDS) -> np.ndarray:
    """Beliefs of all nodes after ``rounds`` of damped messages along all edges at once; exact on a tree once messages have crossed it."""
    n, k = scores.shape
    c, s = (np.asarray(e, np.int64).reshape(-1, 2) for e in (chain, skip))
    src = np.concatenate([c[:, 0], s[:, 0], c[:, 1], s[:, 1]])
    dst = np.concatenate([c[:, 1], s[:, 1], c[:, 0], s[:, 0]])
    half = len(src) // 2
    if half:
        kind = np.concatenate([np.zeros(len(c), int), np.ones(len(s), int), np.full(len(c), 2), np.ones(len(s), int)])
        pair = np.stack([field.chain, field.skip, field.chain.T])
        back = np.concatenate([np.arange(half, 2 * half), np.arange(half)])
        m = np.zeros((2 * half, k))
        gathered = lambda: np.stack([np.bincount(dst, m[:, j], n) for j in range(k)], axis=1)
        for _ in range(rounds):
            x = (scores + gathered())[src] - m[back]
            x = (x - x.max(axis=1, keepdims=True))[:, :, None] + pair[kind]
            top = x.max(axis=1)
            new = top + np.log(np.exp(x - top[:, None, :]).sum(axis=1))
            m = 0.5 * m + 0.5 * (new - new.max(axis=1, keepdims=True))
        scores = scores + gathered()
    p = np.exp(scores - scores.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def trained(found: list[tuple[list[int], int, list[int], list[int], list[int]]], steps: int = 150, l2: float = 2e-4) -> Field | None:
    """The field of examples (features, label, labels before, after, and joined by skips); None without a base span or without any other token."""
    k = len(LABELS)
    y = np.array([e[1] for e in found], int)
    if not len(y) or not y.any() or y.all():
        return None
    f = np.array([e[0] for e in found])
    near = np.zeros((3, len(y), k))
    for i, e in enumerate(found):
        for part, labels in enumerate(e[2:]):
            for label in labels:
                near[part, i, label] += 1
    weights, pairs = np.zeros((1 << BITS, k)), np.zeros((2, k, k))
    share = 1 / np.bincount(y, minlength=k).clip(1)[y]  # each label counts alike
    share /= share.sum()
    want, used = np.eye(k)[y], np.unique(f)
    moments = [[np.zeros((len(used), k)), np.zeros((len(used), k))], [np.zeros_like(pairs), np.zeros_like(pairs)]]
    place = np.searchsorted(used, f)
    own = np.zeros((len(used), k))
    for t in range(1, steps + 1):
        score = own[place].sum(axis=1) + near[0] @ pairs[0] + near[1] @ pairs[0].T + near[2] @ pairs[1]
        p = np.exp(score - score.max(axis=1, keepdims=True))
        g = (p / p.sum(axis=1, keepdims=True) - want) * share[:, None]
        by_feature = np.stack([np.bincount(place.ravel(), np.repeat(g[:, j], place.shape[1]), len(used)) for j in range(k)], axis=1) + l2 * own
        joined = near[2].T @ g
        by_pair = np.stack([near[0].T @ g + (near[1].T @ g).T, (joined + joined.T) / 2]) + l2 * pairs
        for x, grad, (m, v) in ((own, by_feature, moments[0]), (pairs, by_pair, moments[1])):
            m += 0.1 * (grad - m)
            v += 0.01 * (grad * grad - v)
            x -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    weights[used] = own
    return Field(weights, pairs[0], pairs[1])


def examples(text: str) -> list[tuple[list[int], int, list[int], list[int], list[int]]]:
    """What training takes of a document: its nodes of known label, and their neighbours' labels as far as known."""
    n = nodes(text, *base_spans(text))
    near = [[[], [], []] for _ in n.labels]
    for i, j in n.chain:
        near[j][0].append(i)
        near[i][1].append(j)
    for i, j in n.skip:
        near[i][2].append(j)
        near[j][2].append(i)
    known = lambda at: [n.labels[j] for j in at if n.labels[j] >= 0]
    return [(f, label, *map(known, near[i])) for i, (f, label) in enumerate(zip(features(text, n), n.labels, strict=True)) if label >= 0]


def fitted(docs: DataFrame, sample_docs: int = 20_000, per_label: int = 4_000) -> Field | None:
    """The field of a bounded sample of ``docs`` (doc_id, text)."""
    rate = min(1.0, sample_docs / max(1, docs.count()))
    h = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30))
    rows = docs.where((h < F.lit(int(rate * (1 << 30)))) & F.col("text").rlike("[0-9@]")).select(h.alias("h"), "text")
    kind = "h long, place long, label int, features array<int>, before array<int>, after array<int>, joined array<int>"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for h, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if found := examples(text):
                    f, y, a, b, s = zip(*found, strict=True)
                    numbers = pa.list_(pa.int32())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([h] * len(y), pa.int64()), pa.array(range(len(y)), pa.int64()), pa.array(y, pa.int32()), *(pa.array(x, numbers) for x in (f, a, b, s))],
                        names=["h", "place", "label", "features", "before", "after", "joined"],
                    )

    told = written(rows.mapInArrow(read, kind), "personal-tokens")
    best = [told.where(F.col("label") == label).orderBy(F.xxhash64("h", "place"), "features").limit(per_label) for label in range(len(LABELS))]
    found = [(list(r.features), r.label, list(r.before)[:8], list(r.after)[:8], list(r.joined)[:8]) for part in best for r in part.collect()]
    discard(told)
    return trained(found)


def trimmed(text: str, a: int, b: int, kind: int) -> tuple[int, int]:
    """A token's ends without what no span of the kind begins or ends with."""
    inner = text[a:b]
    if KINDS[kind] == "email":
        m = EMAIL.search(inner)
    elif KINDS[kind] == "ip":
        m = IP.search(inner)
    else:
        m = re.search(r"[+(]?[0-9].*(?<=[0-9])|[0-9]" if KINDS[kind] == "phone" else r"[0-9].*(?<=[0-9])|[0-9]", inner, re.S)
    return (a + m.start(), a + m.end()) if m else (a, a)


def added(text: str, n: Nodes, label: np.ndarray, base: list[Span]) -> list[Span]:
    """Spans of the nodes labelled by the field: runs of neighbours of one label that pass its check together, else those that pass alone."""
    linked = {i for i, _ in n.chain}
    starts, reach = [a for a, _, _ in base], list(accumulate((b for _, b, _ in base), max))
    out, i, end = [], 0, 0
    while i < len(label):
        kind, j = int(label[i]) - 1, i
        while kind >= 2 and j in linked and label[j + 1] == label[i] and not text.startswith("+", n.starts[j + 1]):
            j += 1
        if kind >= 0:
            for a, b in [(i, j)] + [(k, k) for k in range(i, j + 1)] * (j > i):
                s, e = trimmed(text, n.starts[a], n.ends[b], kind)
                before = bisect_left(starts, e)
                if end <= s < e and (kind not in NUMBER or NUMBER[kind].fullmatch(text, s, e)) and passes(kind, text[s:e]) and not (before and reach[before - 1] > s):
                    out.append((s, e, kind))
                    end = e
        i = j + 1
    return out


def all_spans(texts: list[str], field: Field | None) -> list[list[tuple[int, int, int, bool]]]:
    """(start, end, kind, base) of each text, by start and kind. The fields of several texts are one graph without edges between them."""
    out, parts, at = [], [], 0
    for text in texts:
        base, failed = base_spans(text) if ACTIVE.search(text) else ([], [])
        out.append([(*s, True) for s in base])
        if field is not None and ACTIVE.search(text):
            n = nodes(text, base, failed)
            parts.append((len(out) - 1, text, n, base, at))
            at += len(n.starts)
    if parts:
        scores = np.concatenate([field.weights[np.array(features(text, n))].sum(axis=1) for _, text, n, _, _ in parts])
        fixed = np.concatenate([np.array(n.labels) for _, _, n, _, _ in parts])
        scores[fixed > 0] = np.where(np.eye(len(LABELS), dtype=bool)[fixed[fixed > 0]], 0.0, -60.0)
        moved = lambda which: np.concatenate([np.array(getattr(n, which), np.int64).reshape(-1, 2) + at for _, _, n, _, at in parts])
        p = marginals(scores, moved("chain"), moved("skip"), field)
        label = np.where(p.max(axis=1) >= SURE, p.argmax(axis=1), 0)
        label[fixed > 0] = 0  # base spans are there already
        for k, text, n, base, at in parts:
            out[k] = sorted(out[k] + [(*s, False) for s in added(text, n, label[at : at + len(n.starts)], base)], key=lambda s: (s[0], s[2], s[1]))
    return out


def personal_spans(docs: DataFrame, field: Field | None, key: str = "doc_id") -> DataFrame:
    """(key, spans) of every row of ``docs`` (key, text); spans has start, end (code points, exclusive), kind and base, by start and kind.

    A null or empty text has no span. Repeated rows and null keys count row by row; an empty table gives no row; columns
    besides the two are ignored. Texts of any length are searched whole. Spans of different kinds may overlap, as the
    patterns are matched kind by kind; the field adds none that overlaps a base span.
    """
    held = docs.sparkSession.sparkContext.broadcast(field)
    plain = docs.select(F.col(key).alias("__key"), F.coalesce("text", F.lit("")).alias("text"))
    item = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("base", pa.bool_())])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                found = all_spans(part.column(1).to_pylist(), held.value)
                rows = [[{"start": s, "end": e, "kind": KINDS[k], "base": b} for s, e, k, b in own] for own in found]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, pa.list_(item))], names=["__key", "spans"])

    kind = plain.schema["__key"].dataType.simpleString()
    return plain.mapInArrow(search, f"__key {kind}, spans array<struct<start:long,end:long,kind:string,base:boolean>>").withColumnRenamed("__key", key)


def redacted(text: str, spans: list[tuple[int, int, str]]) -> str:
    """``text`` with its kind in brackets for each span; of overlapping ones, the first's kind for all of them."""
    out, end = [], 0
    for a, b, kind in sorted(spans):
        if a >= end:
            out += [text[end:a], f"[{kind}]"]
        end = max(end, b)
    return "".join([*out, text[end:]])


def op11_personal_data(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = personal_spans(docs, fitted(docs))
    base = F.filter("spans", lambda s: s["base"])
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    number = lambda k: F.size(F.filter(base, lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *map(number, KINDS), F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
