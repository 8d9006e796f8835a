"""Personal data: base spans against plain patterns, messages against enumeration, and what the field adds."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from tidewell.llm import personal_data as P

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def check_digit(d):
    total = 0
    for k, c in enumerate(reversed([int(x) for x in d])):
        total += c if k % 2 == 0 else sum(divmod(2 * c, 10))
    return total % 10 == 0


def plain(text):
    out = []
    for k, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else 0, "card": 12 <= len(d) <= 19 and check_digit(d), "phone": 9 <= len(d) <= 15}[kind]
            if good:
                out.append((m.start(), k, m.end(), kind))
    return [f"{kind}:{a}:{b}" for a, _, b, kind in sorted(out)]


def card(rng, prefix="4"):
    d = prefix + "".join(rng.choice("0123456789") for _ in range(14))
    return next(d + c for c in "0123456789" if check_digit(d + c))


def phone(rng):
    return f"+1 ({rng.randint(200, 999)}) 555-{rng.randint(0, 9999):04d}"


def test_base_spans_against_plain_patterns():
    rng = random.Random(1)
    parts = ["a", "é", "7", "42", "123456", "@", ".", "..", "-", "+", " ", "(", ")", "x@y.z", "10.0.0.1", "256.1.1.1", "1.2.3.4.5.6.7.8", "+33 1 23 45 67 89", "4111 1111 1111 1111", "\n", "a.b+c@d-e.fr", "@q.r@s.t", "0000001.2.3.4"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert [f"{P.KINDS[k]}:{a}:{b}" for a, b, k in P.base_spans(text)[0]] == plain(text), text


def test_long_runs_take_no_square_time():
    for text in ("a" * 400_000, "1" * 400_000, "999." * 100_000, "+1" + " " * 400_000, "a@" * 200_000, "1 " * 200_000 + "@"):
        assert P.all_spans([text], None)[0] == []


def test_messages_against_enumeration():
    rng = np.random.default_rng(2)
    field = P.Field(np.zeros((1, 3)), rng.normal(size=(3, 3)), (s := rng.normal(size=(3, 3))) + s.T)
    scores = rng.normal(size=(6, 3))
    for chain, skip in (([(0, 1), (1, 2)], [(0, 4), (2, 5)]), ([(3, 4)], []), ([], [])):
        p = np.zeros((6, 3))
        for y in itertools.product(range(3), repeat=6):
            w = sum(scores[i, y[i]] for i in range(6)) + sum(field.chain[y[i], y[j]] for i, j in chain) + sum(field.skip[y[i], y[j]] for i, j in skip)
            for i in range(6):
                p[i, y[i]] += np.exp(w)
        assert np.allclose(P.marginals(scores, chain, skip, field, 80), p / p.sum(axis=1, keepdims=True), atol=1e-6)
    # a loop: beliefs stay near the exact ones if edges are weak
    weak = P.Field(field.weights, field.chain * 0.2, field.skip * 0.2)
    chain, skip, p = [(0, 1), (1, 2)], [(0, 2)], np.zeros((3, 3))
    for y in itertools.product(range(3), repeat=3):
        p[range(3), y] += np.exp(sum(scores[i, y[i]] for i in range(3)) + weak.chain[y[0], y[1]] + weak.chain[y[1], y[2]] + weak.skip[y[0], y[2]])
    assert np.allclose(P.marginals(scores[:3], chain, skip, weak), p / p.sum(axis=1, keepdims=True), atol=0.02)


@pytest.fixture(scope="module")
def field(spark):
    rng = random.Random(3)
    rows = []
    for i in range(400):
        it = [phone(rng), card(rng), f"{'.'.join(str(rng.randint(0, 255)) for _ in range(4))}", f"u{i}.x@mail{i % 7}.example.com", f"chapter {i} of 2{i % 10}", f"AKIA{rng.randint(10**8, 10**9)}", f"version 2.{i}."]
        rng.shuffle(it)
        rows.append((i, " ".join("the words between " + x for x in it[:4] + it[: i % 3])))
    return P.fitted(spark.createDataFrame(rows, "doc_id long, text string"))


def found(text, field):
    return [(P.KINDS[k], text[a:b], base) for a, b, k, base in P.all_spans([text], field)[0]]


def test_field_parts_what_a_pattern_swallowed(field):
    rng = random.Random(9)
    for _ in range(30):
        one, two = phone(rng), card(rng)
        text = f"call me {one} {two} today"
        assert plain(text) == [] and found(text, field) == [("phone", one, False), ("card", two, False)]
    hexed = next(t for k in range(10**4) if P.luhn(P.digits(t := f"35f6899{k:04d}02e0a6fc36")) and len(P.digits(t)) > 11)
    assert found(f"password={hexed} token {hexed}", field) == []
    assert found("in chapter 12 of 30, version 2.1. of 1999, key AKIA123456789", field) == []


def test_skip_edges_carry_labels(field):
    text = "reach us at +1 (415) 555-0199 by day, as 415-555-0199 by night"
    alone = P.Field(field.weights, field.chain, np.zeros_like(field.skip))
    assert ("phone", "+1 (415) 555-0199", True) in found(text, field)
    n = P.nodes(text, *P.base_spans(text))
    scores = field.weights[np.array(P.features(text, n))].sum(axis=1)
    scores[np.array(n.labels) == 4] = np.where(np.arange(5) == 4, 0.0, -60.0)
    last = len(n.starts) - 1
    assert n.skip and P.marginals(scores, n.chain, n.skip, field)[last, 4] > P.marginals(scores, n.chain, n.skip, alone)[last, 4]


def test_query(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    out = P.op11_personal_data(spark, sf).collect()
    assert len(out) == len(texts)
    for r in out:
        want = plain(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x.startswith(k + ":") for x in want) for k in PLAIN]
        said = r.spans.split(",") if r.spans else []
        assert set(want) <= set(said) and said == sorted(said, key=lambda x: (int(x.split(":")[1]), list(PLAIN).index(x.split(":")[0])))
        assert want or not said or re.search("[0-9]{9}|[0-9].*[+(]", texts[r.doc_id])


def test_odd_rows(spark, field):
    rows = [(1, None, "x"), (None, "", "y"), (2, "a@b.c", "z"), (2, "a@b.c", "z"), (3, "é" * 200_000 + " a@b.c", "w")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    out = sorted(((r.doc_id or 0, [(s.start, s.end, s.kind, s.base) for s in r.spans]) for r in P.personal_spans(df, field).collect()), key=str)
    assert out == [(0, []), (1, []), (2, [(0, 5, "email", True)]), (2, [(0, 5, "email", True)]), (3, [(200_001, 200_006, "email", True)])]
    assert P.personal_spans(df.where("doc_id > 3"), field).count() == 0 and P.fitted(df.where("doc_id > 3")) is None and P.fitted(df.where("doc_id = 1")) is None
    assert P.redacted("I am a@b.c, ok", [(5, 10, "email")]) == "I am [email], ok"
