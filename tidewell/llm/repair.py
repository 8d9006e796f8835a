"""Conversation repair: the cheapest edits that make a conversation's roles read ``(s?(ua)+)?``.

A backward dynamic program over (turn, grammar state) gives the cost to go; a forward walk then takes at each turn the
edit of the least letter among those that keep to it: D (delete), I (insert), K (keep), R (rerole). The grammar
decides each edit's role, so a state and a letter name one transition, and the walk's letters are the least of all
cheapest ones.

No conversation has to fit a task. Turns are put in order by ranges and cut into segments of at most 4096 turns; each
segment's program is run for every state at its end, which gives a 4 x 4 table of costs, and tables are chained along
a conversation (a few numbers for each segment). Costs to go at the ends of segments known, all segments are walked at
once from each of the four states, and a second chain tells in which one each begins. The tables of costs to go repeat
(they differ by bounded amounts), so a step is a look-up.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table, written

BLANKS = " \t\n\x0b\x0c\r"
#: States: nothing yet, after a system turn, after a user's, after an assistant's. The first and the last may end.
NEXT = (2, 2, 3, 2)
ROLE_AT = ("user", "user", "assistant", "user")
KEEP = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}
INITIALS, FAULTS = "suao", ("none", "blank", "duplicate", "truncated")
LEGAL = {"su", "ua", "au"}
DELETE, REROLE, INSERT, TRUNCATED = 2, 1, 5, 5
NEVER = 1 << 60
#: The cost to go after the last turn.
END = (0, 2 * INSERT, INSERT, 0)
SEGMENT_BITS = 12


def normal(v) -> tuple[int, tuple[int, ...]]:
    low = min(v)
    return low, tuple(x - low if x < NEVER else NEVER for x in v)


@cache
def step(code: int, after: tuple[int, ...]):
    """(what to add, costs to go, moves) before a turn of a kind, of those after it; a move is the letters and the state after them."""
    initial, fault = INITIALS[code // 4], FAULTS[code % 4]
    more = TRUNCATED if fault == "truncated" else 0
    taken: list[dict[str, tuple[int, int]]] = []  # by state: letter -> (cost, state after)
    for q in range(4):
        ways = {"D": (DELETE, q)}
        if fault in ("none", "truncated"):
            if (initial, q) in KEEP:
                ways["K"] = (more, KEEP[initial, q])
            ways["R"] = (REROLE + more, NEXT[q])
        taken.append({k: (c + after[to] if after[to] < NEVER else NEVER, to) for k, (c, to) in ways.items()})
    cost = [min(c for c, _ in ways.values()) for ways in taken]
    for _ in range(2):  # two inserts reach every state that inserts reach
        cost = [min(c, INSERT + cost[NEXT[q]]) if cost[NEXT[q]] < NEVER else c for q, c in enumerate(cost)]
    moves = []
    for q in range(4):
        letters, at = "", q
        while True:
            tight = [k for k, (c, _) in taken[at].items() if c == cost[at]] + ["I"] * (INSERT + cost[NEXT[at]] == cost[at])
            if cost[at] >= NEVER or (letters := letters + min(tight))[-1] != "I":
                break
            at = NEXT[at]
        moves.append((letters, taken[at][letters[-1]][1] if letters else at))
    return *normal(cost), tuple(moves)


def backward(codes: bytes, after: tuple[int, ...]):
    """(costs to go before the first turn, moves of each turn from the last)."""
    total, v = normal(after)
    moves = []
    for code in reversed(codes):
        add, v, move = step(code, v)
        total += add
        moves.append(move)
    return tuple(x + total if x < NEVER else NEVER for x in v), moves


def cost_table(codes: bytes) -> list[int]:
    """Costs from each state before a segment to each state after it, row by row."""
    columns = [backward(codes, tuple(0 if q == at else NEVER for q in range(4)))[0] for at in range(4)]
    return [columns[q][p] for p in range(4) for q in range(4)]


def through(costs: list[int], after) -> tuple[int, ...]:
    return tuple(min((costs[4 * p + q] + after[q] for q in range(4) if costs[4 * p + q] < NEVER), default=NEVER) for p in range(4))


def walks(codes: bytes, after: tuple[int, ...], last: bool) -> tuple[list[int], list[str]]:
    """The state after a segment and the letters of its edits, from each state before it. The last one also inserts what is missing at the end."""
    _, moves = backward(codes, after)
    moves.reverse()
    exits, audits = [], []
    for q in range(4):
        parts = []
        for move in moves:
            letters, q = move[q]
            parts.append(letters)
        while last and END[q]:
            parts.append("I")
            q = NEXT[q]
        exits.append(q)
        audits.append("".join(parts))
    return exits, audits


def _rows(batches: Iterator[pa.RecordBatch], size: int = 512) -> Iterator[tuple]:
    for batch in batches:
        for a in range(0, batch.num_rows, size):
            yield from zip(*(c.to_pylist() for c in batch.slice(a, size).columns), strict=True)


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 512) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _mapped(df: DataFrame, work, kind: str) -> DataFrame:
    """``work`` on the rows of each partition, one by one."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = to_arrow_schema(_parse_datatype_string(kind))
    return df.mapInArrow(lambda batches: _batches(work(_rows(batches)), schema), kind)


def ordered(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, face, initial, fault and pos, written: turns in order, null ones first, then by a digest of role and text.

    Null roles and texts are one space. ``pos`` is a number in that order, without gaps inside a part of the table.
    Ranges are cut by narrow keys, and copies of a row by their number too, so no conversation fills a task.
    """
    some = turns.select("conv_id", "turn", *[F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")])
    face = F.unhex(F.sha2(F.concat_ws(":", F.length("role").cast("string"), "role", "text"), 256))
    last = F.right(F.rtrim("text", F.lit(BLANKS)), F.lit(1))
    fault = F.when(last == "", "blank").when(~last.isin(".", "!", "?"), "truncated").otherwise("none")
    initial = F.left("role", F.lit(1))
    keyed = some.withColumns({"face": face, "fault": fault, "initial": initial, "copy": F.monotonically_increasing_id()})
    order = ["conv_id", "turn", "face", "copy"]
    return written(keyed.repartitionByRange(*order).sortWithinPartitions(*order).drop("copy").withColumn("pos", F.monotonically_increasing_id()), "turns")


def segments(turns: DataFrame) -> DataFrame:
    """conv_id, first, codes, costs, blank, duplicate, truncated, illegal, head and tail of each segment, written."""
    kind = f"conv_id {turns.schema['conv_id'].dataType.simpleString()}, first long, codes binary, costs array<long>, blank long, duplicate long, truncated long, illegal long, head string, tail string"
    seen = turns.groupBy("conv_id", "face").agg(F.min("pos").alias("first"), F.count("*").alias("n")).where("n > 1").alias("s")
    t = turns.select("conv_id", "face", "pos", "initial", "fault").alias("t")
    met = t.join(seen, F.col("t.conv_id").eqNullSafe(F.col("s.conv_id")) & (F.col("t.face") == F.col("s.face")), "left")
    fault = F.when((F.col("fault") != "blank") & (F.col("first") < F.col("pos")), "duplicate").otherwise(F.col("fault"))
    block = F.shiftright("pos", SEGMENT_BITS)
    rows = met.select("t.conv_id", "pos", "initial", fault.alias("fault"), block.alias("block")).repartition("block").sortWithinPartitions("pos")

    def cut(rows):
        def told():
            codes = bytes(INITIALS.index(i if i in ("s", "u", "a") else "o") * 4 + FAULTS.index(f) for i, f in held)
            count = {f: sum(x == f for _, x in held) for f in FAULTS}
            illegal = sum(a + b not in LEGAL for (a, _), (b, _) in zip(held, held[1:], strict=False))
            return conv, first, codes, cost_table(codes), count["blank"], count["duplicate"], count["truncated"], illegal, held[0][0], held[-1][0]

        held, conv, first, at = [], None, None, None
        for c, pos, initial, fault, block in rows:
            if held and (c != conv or block != at):
                yield told()
                held = []
            if not held:
                conv, first, at = c, pos, block
            held.append((initial, fault))
        if held:
            yield told()

    return written(_mapped(rows, cut, kind), "segments")


def chained_costs(found: DataFrame) -> DataFrame:
    """conv_id, first, after, last, cost and seam of each segment: the costs to go at its end, whether it is its conversation's last,
    the cost from its start on, and whether the pair of turns at its end is illegal."""
    kind = f"conv_id {found.schema['conv_id'].dataType.simpleString()}, first long, after array<long>, last boolean, cost long, seam long"

    def chain(rows):
        conv, after, head, any_yet = None, END, None, False
        for c, first, costs, own_head, tail in rows:
            last = not any_yet or c != conv
            if last:
                conv, after, head, any_yet = c, END, None, True
            seam = int(not last and tail + head not in LEGAL)
            before = through(costs, after)
            yield c, first, list(after), last, before[0], seam
            after, head = before, own_head

    rows = found.select("conv_id", "first", "costs", "head", "tail").repartition("conv_id").sortWithinPartitions("conv_id", F.desc("first"))
    return written(_mapped(rows, chain, kind), "segment-costs")


def edits(found: DataFrame, costs: DataFrame) -> DataFrame:
    """conv_id, first, state and audit of each segment: the state that it begins in and the letters of its edits, written."""
    conv = f"conv_id {found.schema['conv_id'].dataType.simpleString()}"

    def walk(rows):
        for c, first, codes, after, last in rows:
            yield c, first, *walks(codes, tuple(after), last)

    def chain(rows):
        conv, state, any_yet = None, 0, False
        for c, first, exits in rows:
            if not any_yet or c != conv:
                conv, state, any_yet = c, 0, True
            yield first, state
            state = exits[state]

    ways = written(_mapped(found.select("conv_id", "first", "codes").join(costs.select("first", "after", "last"), "first").select("conv_id", "first", "codes", "after", "last"), walk, f"{conv}, first long, exits array<int>, audits array<string>"), "walks")
    begun = _mapped(ways.select("conv_id", "first", "exits").repartition("conv_id").sortWithinPartitions("conv_id", "first"), chain, "first long, state int")
    return written(ways.select("conv_id", "first", "audits").join(begun, "first").select("conv_id", "first", "state", F.col("audits")[F.col("state")].alias("audit")), "edits")


def _edited(rows) -> Iterator[tuple]:
    """(conv_id, pos, letter, role, text) in order, and before each segment (conv_id, None, its letters, None, None), of turns and of the letters before them."""
    letters, at, q, conv = "", 0, 0, None

    def insert():
        nonlocal at, q
        while at < len(letters) and letters[at] == "I":
            role, q, at = ROLE_AT[q], NEXT[q], at + 1
            yield conv, pos, "I", role, ""

    pos = None
    for c, p, kind, role, text in rows:
        if kind == 0:
            conv, letters, at, q = c, text, 0, int(role)
            yield conv, None, letters, None, None
            continue
        pos = p
        yield from insert()
        letter, at = letters[at], at + 1
        if letter == "R":
            role, q = ROLE_AT[q], NEXT[q]
        elif letter == "K":
            q = KEEP[role[:1], q]
        yield conv, pos, letter, role, text
        if at < len(letters) and not letters[at:].strip("I"):  # what is missing at the end
            yield from insert()


def _met(turns: DataFrame, letters: DataFrame) -> DataFrame:
    own = turns.select("conv_id", "pos", F.lit(1).alias("kind"), "role", "text")
    return own.unionByName(letters.select("conv_id", F.col("first").alias("pos"), F.lit(0).alias("kind"), F.col("state").cast("string").alias("role"), F.col("audit").alias("text")))


def repaired_turns(turns: DataFrame, letters: DataFrame) -> DataFrame:
    """conv_id, pos, seq, edit, role and text of every turn and inserted turn; rows of edit D are the deleted ones. ``pos``, ``seq`` is their order."""

    def rows_of(rows):
        seq, at = 0, None
        for c, pos, letter, role, text in _edited(rows):
            if pos is not None:
                seq, at = (seq + 1 if pos == at else 0), pos
                yield c, pos, seq, letter, role, text

    rows = _met(turns, letters)
    by = F.shiftright("pos", SEGMENT_BITS)
    kind = f"conv_id {turns.schema['conv_id'].dataType.simpleString()}, pos long, seq int, edit string, role string, text string"
    return _mapped(rows.repartition(by).sortWithinPartitions("pos", "kind"), rows_of, kind)


def digests(turns: DataFrame, letters: DataFrame) -> DataFrame:
    """conv_id, audit and repaired_sha256. One hash reads its conversation from end to end, as a sorted stream, in the memory of a few turns."""

    def hashed(rows):
        conv, audit, sha, any_yet, line = None, [], None, False, False
        for c, pos, letter, role, text in _edited(rows):
            if not any_yet or c != conv:
                if any_yet:
                    yield conv, "".join(audit), sha.hexdigest()
                conv, audit, sha, any_yet, line = c, [], hashlib.sha256(), True, False
            if pos is None:
                audit.append(letter)
            elif letter != "D":
                sha.update(("\n" * line + role + ":" + text).encode("utf-8", "surrogatepass"))
                line = True
        if any_yet:
            yield conv, "".join(audit), sha.hexdigest()

    rows = _met(turns, letters).repartition("conv_id").sortWithinPartitions("conv_id", "pos", "kind")
    return _mapped(rows, hashed, f"conv_id {turns.schema['conv_id'].dataType.simpleString()}, audit string, repaired_sha256 string")


def repaired(turns: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 of each conversation of ``turns`` (conv_id, turn, role, text).

    A null conv_id is a conversation of its own. Null roles and texts are one space, so such a text is blank. Turns of
    one number, or without one, are in the order of a digest of role and text; repeated rows are duplicates. An empty
    table gives no row; other columns are ignored. A number of gaps beyond a long is null.
    """
    t = ordered(turns)
    found = segments(t)
    costs = chained_costs(found)
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    parts = [
        t.groupBy("conv_id").agg(F.coalesce(F.max(wide("turn")) - F.min(wide("turn")) + 1 - F.count_distinct("turn"), F.lit(0)).try_cast("long").alias("gaps")),
        found.groupBy("conv_id").agg(*[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")]),
        costs.groupBy("conv_id").agg(F.sum("seam").alias("illegal"), F.min_by("cost", "first").alias("cost")),
        digests(t, edits(found, costs)),
    ]
    both = parts[0]
    for part in parts[1:]:
        both = both.unionByName(part, allowMissingColumns=True)
    return both.groupBy("conv_id").agg(*[F.sum(c).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], F.max("audit").alias("audit"), F.max("repaired_sha256").alias("repaired_sha256"))


def damage(rows: DataFrame) -> DataFrame:
    """The contract's faults: by crc32 of ``conv_id:turn`` some rows go, or lose their text, its stops or their role, or are there twice."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    some = rows.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), kind.alias("kind")).where("kind != 0")
    changed = some.withColumns({"text": F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")), "role": F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))})
    return changed.withColumn("copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).select("conv_id", "turn", "role", "text")


def op13_repair(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    out = repaired(damage(rows)).unionByName(rows.select("conv_id"), allowMissingColumns=True)  # those that lost all rows too
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return out.groupBy("conv_id").agg(
        *[zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], F.coalesce(F.max("audit"), F.lit("")).alias("audit"),
        F.coalesce(F.max("repaired_sha256"), F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"),
    )
