"""Repairs against every sequence of edits, by the words of the contract."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from tidewell.llm import repair as R

COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def fault_list(rows):
    out, seen = [], set()
    for role, text in rows:
        body = re.findall(r"[^\x20\x09-\x0D]", text)
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def all_edits(rows):
    """The cheapest (cost, letters, turns) of every sequence of edits with few inserts in a row."""
    faults = fault_list(rows)
    gap = [[]] + [[("I", 5, r, "")] for r in ("user", "assistant")] + [[("I", 5, a, ""), ("I", 5, b, "")] for a, b in (("user", "assistant"), ("assistant", "user"))]
    each = []
    for (role, text), f in zip(rows, faults, strict=True):
        more = 5 if f == "truncated" else 0
        ways = [("D", 2, None, None)]
        if f in ("", "truncated"):
            ways += [("K", more, role, text), ("R", 1 + more, "user", text), ("R", 1 + more, "assistant", text)]
        each += [gap, [[w] for w in ways]]
    best = None
    for pick in itertools.product(*each, gap):
        edits = [e for part in pick for e in part]
        left = [(r, t) for _, _, r, t in edits if r is not None]
        if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "?" for r, _ in left)):
            it = (sum(e[1] for e in edits), "".join(e[0] for e in edits), left)
            best = it if best is None or it[:2] < best[:2] else best
    return best


def digest(turns):
    return hashlib.sha256("\n".join(f"{r}:{t}" for r, t in turns).encode()).hexdigest()


def slow(rows):
    """The same by a plain recursion, for longer conversations: (cost, letters) are compared as they are."""
    faults, nxt = fault_list(rows), {"": "u", "s": "u", "u": "a", "a": "u"}
    full = {"u": "user", "a": "assistant"}
    best = {(len(rows), q): x for q, x in {"": (0, "", ()), "a": (0, "", ()), "u": (5, "I", (("assistant", ""),)), "s": (10, "II", (("user", ""), ("assistant", "")))}.items()}
    for i in range(len(rows) - 1, -1, -1):
        (role, text), f = rows[i], faults[i]
        own = {}
        for q in ("", "s", "u", "a"):
            ways = [("D", 2, q, ())]
            if f in ("", "truncated"):
                more = 5 if f else 0
                if role[:1] == nxt[q] or (q == "" and role[:1] == "s"):
                    ways.append(("K", more, role[:1], ((role, text),)))
                ways.append(("R", 1 + more, nxt[q], ((full[nxt[q]], text),)))
            own[q] = min((c + best[i + 1, to][0], k + best[i + 1, to][1], t + best[i + 1, to][2]) for k, c, to, t in ways)
        for _ in range(2):
            own = {q: min(own[q], (5 + own[nxt[q]][0], "I" + own[nxt[q]][1], ((full[nxt[q]], ""), *own[nxt[q]][2]))) for q in own}
        best |= {(i, q): x for q, x in own.items()}
    return best[0, ""]


TEXTS = ["Yes.", "No!", "well", " \t", "", "Why?", "A long answer. ", "é"]
ROLES = ["user", "assistant", "system", "tool", "", "User"]


def made(rng, n):
    return [(rng.choice(ROLES[:3] * 3 + ROLES), rng.choice(TEXTS)) for _ in range(n)]


def plain(rows, turns=None):
    faults = fault_list(rows)
    cost, audit, left = slow(rows)
    pairs = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    known = [t for t in (turns if turns is not None else range(len(rows))) if t is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    return (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), pairs, cost, audit, digest(left))


def test_plain_recursion_against_all_edits():
    rng = random.Random(5)
    for n in [0, 1, 1, 2, 2, 2, 3, 3]:
        for _ in range(12 if n < 3 else 3):
            rows = made(rng, n)
            cost, audit, left = all_edits(rows)
            assert slow(rows) == (cost, audit, tuple(left))


@pytest.mark.parametrize("bits", [12, 2])
def test_repairs(spark, monkeypatch, bits):
    monkeypatch.setattr(R, "SEGMENT_BITS", bits)
    rng = random.Random(bits)
    convs = {k: made(rng, rng.choice([1, 2, 3, 5, 9, 40])) for k in range(120)} | {None: made(rng, 7), 500: made(rng, 900)}
    rows = [(c, i, r, t, "x") for c, turns in convs.items() for i, (r, t) in enumerate(turns)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, audit string").repartition(5)
    found = {r.conv_id: tuple(r[c] for c in COLUMNS) for r in R.repaired(df).collect()}
    assert found == {c: plain(turns) for c, turns in convs.items()}
    # the rows themselves, in order
    t = R.ordered(df)
    parts = R.segments(t)
    out = R.repaired_turns(t, R.edits(parts, R.chained_costs(parts))).orderBy("pos", "seq").collect()
    for c, turns in convs.items():
        own = [r for r in out if r.conv_id == c]
        assert "".join(r.edit for r in own) == slow(turns)[1] and tuple((r.role, r.text) for r in own if r.edit != "D") == slow(turns)[2]


def test_odd_rows(spark):
    rows = [(1, None, "user", "Hi."), (1, 3, "assistant", "Ho."), (2, None, None, None), (3, 1, "user", None), (3, 9, None, "Yes."), (4, 1, "user", "Hi."), (4, 1, "user", "Hi."), (4, 2, "assistant", "x" * 300_000 + ".")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = {r.conv_id: tuple(r[c] for c in COLUMNS) for r in R.repaired(df).collect()}
    want = {1: [("user", "Hi."), ("assistant", "Ho.")], 2: [(" ", " ")], 3: [("user", " "), (" ", "Yes.")], 4: [("user", "Hi."), ("user", "Hi."), ("assistant", rows[-1][3])]}
    assert found == {c: plain(want[c], [r[1] for r in rows if r[0] == c]) for c in want}
    assert R.repaired(df.where("conv_id > 4")).count() == 0


def test_query(spark, sf):
    given = spark.read.parquet(f"{sf}/conversations.parquet").collect()
    want: dict = {}
    for r in sorted(given, key=lambda r: (r.conv_id, r.turn)):
        own = want.setdefault(r.conv_id, ([], []))
        kind = zlib.crc32(f"{r.conv_id}:{r.turn}".encode()) % 20
        role, text = ("user" if kind == 4 else r.role), ("" if kind == 1 else re.sub("[.!?]", "", r.text) if kind == 2 else r.text)
        for _ in range({0: 0, 3: 2}.get(kind, 1)):
            own[0].append((role, text))
            own[1].append(r.turn)
    found = {r.conv_id: tuple(r[c] for c in COLUMNS) for r in R.op13_repair(spark, sf).collect()}
    assert found == {c: plain(*x) for c, x in want.items()}


def test_query_of_lost_and_null_rows(spark, tmp_path):
    lost = next(t for t in range(1000) if zlib.crc32(f"7:{t}".encode()) % 20 == 0)
    spark.createDataFrame([(7, lost, "user", "Hi."), (None, None, None, None)], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    found = {r.conv_id: tuple(r[c] for c in COLUMNS) for r in R.op13_repair(spark, str(tmp_path)).collect()}
    assert found[7] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())
    kind = zlib.crc32(b" : ") % 20
    assert kind > 4 and found[None] == plain([(" ", " ")], [None])
