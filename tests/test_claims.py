"""Names, containment joins, dictionaries, launch claims and backtests against plain Python."""

import random
import re
import time
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tidewell.operators import audit as A
from tidewell.operators import dictionary as W
from tidewell.operators import discovery as D
from tidewell.operators import launch as L
from tidewell.operators import names as N
from tidewell.operators import text as X
from tidewell.operators import trend as T


def one(spark, values, build, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i long, v {kind}").select("i", build(F.col("v")).alias("k")).collect()
    return [r.k for r in sorted(rows)]


COMPANIES = ["㈜아모레퍼시픽", "주식회사 아모레퍼시픽", "(주)아모레 퍼시픽", "Acme Co., Ltd.", "ACME co ltd", "Incas Corporation", "Income Inc", "ＡＢＣ corp.", "", None, "주식회사", "유한책임회사 가나"]


def test_company_keys_meet_and_stay(spark):
    keys = one(spark, COMPANIES, N.company_key)
    assert keys[:3] == ["아모레퍼시픽"] * 3 and keys[3:8] == ["acme", "acme", "incas", "income", "abc"] and keys[8:] == ["", "", "", "가나"]
    assert one(spark, keys, N.company_key) == keys  # a key is its own key
    assert one(spark, ["VT Cosmetics", "V.T", "vt"], lambda c: N.brand_key(c, {"vtcosmetics": "vt"})) == ["vt"] * 3


@pytest.mark.parametrize(
    ("name", "brand", "keep", "want"),
    [
        ("[올영픽] 라네즈 워터 선 크림 50ml 기획", "라네즈", False, "워터 선크림"), ("라네즈 네오쿠션 세트 SPF 50+ PA+++", None, False, "라네즈 네오쿠션"), ("[SPF50+ PA+++] [촉촉] 크림 2입", None, True, "촉촉 크림"),
        ("토너패드 70매", None, False, "패드"), ("NEW Renewal Cream (30 g)", None, False, "renewal cream"), ("A.B 1.5 크림.", None, False, "a b 1.5 크림"), ("마스크팩1 x 3", None, False, "마스크 1"), (None, None, False, ""),
    ],
)
def test_product_names(spark, name, brand, keep, want):
    df = spark.createDataFrame([(name, brand)], "n string, b string")
    assert df.select(N.product_name(F.col("n"), F.col("b"), keep_brackets=keep).alias("k")).first().k == want


def test_line_keys_lose_the_longest_spelling_first(spark):
    df = spark.createDataFrame([("차앤박 프로폴리스 앰플", ["차앤박", "cnp"]), ("CNP Labo Ampule", ["cnp", "cnplabo"]), ("아이오페 크림", None), (None, ["x"])], "n string, k array<string>")
    assert [r.k for r in df.select(N.line_key(F.col("n"), F.col("k")).alias("k")).collect()] == ["프로폴리스앰플", "ampule", "아이오페크림", ""]


def test_containment_against_all_pairs(spark):
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("abc") for _ in range(n))
    texts = [(i, rng.randint(0, 1), word(rng.randint(0, 12))) for i in range(120)] + [(200, 0, None)]
    names = [(i, rng.randint(0, 1), word(rng.randint(0, 5))) for i in range(60)] + [(200, 0, None), (7, 0, "ab"), (7, 0, "ab")]
    t, n = spark.createDataFrame(texts, "i long, b long, text string"), spark.createDataFrame(names, "j long, b long, name string")
    got = Counter((r.text.i, r.name.j) for r in L.contained(t, "text", n, "name", ["b"]).collect())
    assert got == Counter((i, j) for i, b, x in texts for j, c, y in names if b == c and x is not None and y and y in x)


# --- dictionaries ---------------------------------------------------------------------------------------------------


def in_texts(spark, texts, surfaces, words="크림|cream", **options):
    s = spark.createDataFrame([(x.surface, x.canonical, x.kind, x.tier, i) for i, x in enumerate(surfaces)], "surface string, canonical string, kind string, tier string, place long")
    df = spark.createDataFrame([(i, t, "own") for i, t in enumerate(texts)], "i long, t string, kind string")
    out = W.dictionary_hits(df, "t", s, words, **options).collect()
    assert {r.kind for r in out} <= {"own"}
    return {r.i: [tuple(h) for h in r.hits] for r in out}


def by_pattern(spark, texts, surfaces, words="크림|cream", **options):
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    return {r.i: [tuple(h) for h in r.h] for r in df.select("i", X.surface_hits(F.col("t"), surfaces, words, **options).alias("h")).collect()}


def test_automaton_against_one_pattern(spark):
    rng = random.Random(8)
    parts = ["라네즈", "라네", "네즈", "ab", "abc", "bc", "c", "Ab C", "크림", " ", ".", "é", "İ", "x"]
    names = ["라네즈", "라네", "네즈", "ab", "abc", "bc", "C", "ab c", "é", "Abc"]
    surfaces = [X.Surface(s, s.lower() + rng.choice(["", "1"]), "brand", rng.choice(["link", "link", "near", "stop"])) for s in names]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(400)]
    for sides in ({}, {"left": "", "right": ""}, {"right": "(?=은|는|$|[^가-힣])"}):
        want = by_pattern(spark, texts, surfaces, **sides)
        assert sum(map(len, want.values())) > 100
        assert in_texts(spark, texts, surfaces, **sides) == want
    assert in_texts(spark, texts, surfaces, limit=60) == by_pattern(spark, texts, surfaces)  # in parts
    assert in_texts(spark, ["x", None, ""], []) == {0: [], 1: [], 2: []}


def test_many_names_take_no_more_time():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(9))
    names = [word() for _ in range(100_000)]
    text = " ".join(rng.choice(names) if rng.random() < 0.01 else word() for _ in range(60_000))

    def taken(some):
        automaton = W._automaton(str(len(some)), tuple((n, "k", n, False) for n in some))
        began = time.perf_counter()
        found = sum(1 for _ in automaton.iter(text))
        return time.perf_counter() - began, found

    few, many = min(taken(names[:1000])[0] for _ in range(3)), min(taken(names)[0] for _ in range(3))
    assert many < 15 * few and taken(names)[1] >= len(re.findall(" ", text)) * 0.005


# --- launch -----------------------------------------------------------------------------------------------------------


def test_title_tags(spark):
    titles = ["[NEW] a", "a new b", "(Renewal) [new]", "【신상품】 [NEW]", "[NEW 신상]", "", None, "[best] (new)"]
    assert one(spark, titles, lambda c: L.title_tag(c, ["신상", "NEW"])) == ["NEW", None, "NEW", "신상", "신상", None, None, "NEW"]


def test_registration_claims(spark):
    refs = spark.createDataFrame([(1, "a", "waterdrop"), (2, "a", "wat"), (3, "b", "waterdrop"), (4, "a", "sunmilk")], "product_ref long, brand string, line string")
    brands = spark.createDataFrame([("a", "lane"), ("a", "laneige"), ("b", "beau"), ("b", "")], "brand string, key string")
    day = "2024-01-0"
    regs = [(1, "laneigewaterdrop", "oem", day + "1"), (2, "waterdropplus", "laneige", day + "2"), (3, "beauwater", "oem", day + "3"), (4, "waterdrop", "oem", day + "4"), (5, "lanewat", "oem", day + "5"), (6, "lanesunmilk", "lane", None)]
    r = spark.createDataFrame(regs, "report_seq long, item_key string, entp_key string, d string").withColumn("report_date", F.to_date("d"))
    got = sorted((x.product_ref, x.source_ref, x.strength) for x in L.registration_claims(refs, r, brands).collect())
    assert got == [(1, "1", "exact"), (1, "2", "partial"), (3, "3", "partial"), (4, "6", "exact")]


def test_claims_of_products_without_members_are_withdrawn(spark):
    refs = spark.createDataFrame([(1, "a", "waterdrop"), (2, "a", "sunmilk")], "product_ref long, brand string, line string")
    members = spark.createDataFrame([("s", "k1", 1, True), ("s", "k2", 1, False)], "source string, product_key string, product_ref long, primary boolean")
    regs = spark.createDataFrame([(9, "lanesunmilk", "oem", None)], "report_seq long, item_key string, entp_key string, report_date date")
    brands = spark.createDataFrame([("a", "lane")], "brand string, key string")
    seen = spark.sql("select 's' source, 'k1' product_key, date '2024-02-01' captured_on, date '2024-01-05' written_on union all select 's', 'k1', date '2024-01-01', null union all select 's', 'k2', date '2024-03-01', null union all select 's', 'gone', date '2020-01-01', null")
    titles = spark.sql("select 's' source, 'k1' product_key, '[NEW] x' title, date '2024-01-01' first_seen_on, date '2024-01-01' captured_on union all select 's', 'k1', 'x', date '2024-01-01', date '2024-01-02'")
    out = L.claims(refs, members, regs, brands, seen.select("source", "product_key", "captured_on"), seen.select("source", "product_key", "written_on"), titles, ["NEW"]).collect()
    assert sorted((r.product_ref, r.axis, str(r.claimed_on), r.source_ref, r.strength) for r in out) == [(1, "old_review", "2024-01-05", "s:k1", "exact"), (1, "vendor_board", "2024-01-01", "s:k1", "exact"), (1, "vendor_board", "2024-03-01", "s:k2", "partial")]


# --- backtest ---------------------------------------------------------------------------------------------------------


def test_backtest_sees_no_later_quarter(spark):
    """Rows about a target are the same whatever came after the quarters that they look at."""
    quarters = [f"{y}Q{q}" for y in range(2019, 2023) for q in range(1, 5)]
    rng = random.Random(6)
    cells = [(t, q, n, n + rng.randint(0, 3)) for t in "abc" for q in quarters for n in [rng.choice([0, 5, 20, 60])]]
    panel, channels = [(q, 4) for q in quarters], [(t, q, c, n) for t, q, n, _ in cells for c in "xy" if n]

    def run(cells):
        d = spark.createDataFrame
        return T.backtest(d(cells, "topic string, quarter string, mentions long, raw long"), d(panel, "quarter string, channels_total long"), d(channels, "topic string, quarter string, channel string, n long")).collect()

    out = run(cells)
    assert out and {r.expected for r in out} <= set(T.EXPECTED.values())
    changed = [(t, q, n * 7 + 1 if q == "2022Q4" else n, raw) for t, q, n, raw in cells]
    early = lambda rows: sorted(tuple(r) for r in rows if r.target < "2021Q2")
    assert early(run(changed)) == early(out) and len(early(out)) > 0


# --- audits and reviews -----------------------------------------------------------------------------------------------


def test_audit_of_keys(spark):
    rows = [("p1", "Centella Asiatica"), ("p2", "centella asiatica"), ("p1", "Centella Asiatica"), ("p3", "마데카소사이드 (1%)"), ("p4", "Water Glycerin Centella Asiatica Niacinamide Parfum Limonene Citral"), ("p5", None), ("p5", "")]
    names = spark.createDataFrame(rows, "product string, name string")
    terms = spark.createDataFrame([("cica", "centella"), ("cica", "마데카 소사이드"), ("none", "zzz"), ("none", " ")], "key string, term string")
    out = {r.key: (r.rows, r.products, [tuple(x) for x in r["names"]]) for r in A.audit(names, terms, 2).collect()}
    assert out == {"cica": (5, 4, [("Centella Asiatica", 2), ("Water Glycerin Centella Asiatica Niacinamide Parfum Limonene Citral", 1)]), "none": (0, 0, [])}
    bad = spark.createDataFrame([(None, "asiatica"), ("cica", "Limonene"), ("none", "water")], "key string, bad string")
    assert sorted(map(str, map(tuple, A.denied(names, terms, bad).collect()))) == ["('cica', 'Limonene', 'p4')", "('cica', 'asiatica', None)"]


def test_all_violations_of_a_record_are_listed(spark):
    docs = spark.createDataFrame([(1, "I warm the tube first every morning", "0" * 16), (1, "x", None), (2, "y", "bad"), (3, "z", None)], "doc_id long, text string, author_hash string")
    claim = "struct<summary:string,span:string>"
    good = ("s", "warm the tube")
    rows = [(1, "observed", "", "none", True, "every evening", None, good, ("", "warm"), None, good, good), (2, None, None, None, None, None, None, *[None] * 5), (2, "wish", "r", "c", None, None, "y", *[None] * 5), (9, "wish", "r", "c", None, None, "y", *[None] * 5)]
    obs = spark.createDataFrame(rows, "doc_id long, disposition string, reason string, candidate string, recurring boolean, recurrence_span string, span string, " + ", ".join(f"{f} {claim}" for f in D.FIELDS))
    cands = spark.createDataFrame([("c", "n", "l", "available", "r", None, "unassessed", "r"), ("d", None, "", None, None, None, "odd", "")], "candidate string, need string, limitations string, technical string, technical_reason string, references string, feasibility string, feasibility_reason string")
    found = sorted((r.subject, r.key, r.violation) for r in D.violations(docs, obs, cands).collect())
    assert [v for s, k, v in found if s == "observation" and k == "1"] == sorted(["no reason", "undeclared candidate", "ungrounded requirement", "ungrounded behavior", "recurrence without its span"])
    assert [v for s, k, v in found if s == "observation" and k == "2"] == ["no reason", "no supporting span", "unknown disposition"]
    assert [(k, v) for s, k, v in found if s == "document"] == [("1", "duplicate document"), ("2", "author is no stored hash"), ("2", "reviewed twice"), ("3", "not reviewed"), ("9", "review of an unknown document")]
    assert [(k, v) for s, k, v in found if s == "candidate"] == [("c", "available without references"), *[("d", v) for v in sorted(["no need", "no limitations", "unknown technical status", "unknown feasibility status", "no technical reason", "no feasibility reason"])]]


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=30))
def test_folding_places(text):
    assert len(W.folded(text)) == len(text)
