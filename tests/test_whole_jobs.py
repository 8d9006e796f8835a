"""Queries over whole tables, and the linker's acceptance rule, against brute force."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F
from tidewell.operators import graph, ledger, linker, sinks
from tidewell.operators import text as X
from tidewell.plans import registry
from tidewell.plans.text import PART_RULE


def by_side(parts):
    """{part: 1 if the first name alone has it, 2 if the second alone, 3 if both}"""
    told = {}
    for side, own in ((1, parts[0]), (2, parts[1])):
        for part in own:
            told[part] = told.get(part, 0) | side
    return told


def last_form(rule, name):
    """The last form that a walk through a name's letters meets, the longest of those that begin at one place."""
    at, last = 0, ""
    while at < len(name):
        here = max((f for f in rule.forms if name.startswith(f, at)), key=len, default="")
        last, at = here or last, at + max(1, len(here))
    return dict(rule.form_map).get(last, last)


def accepts(rule, a, b):
    """(accepted, jaccard, dice) by which side has what."""
    joined = ["".join(n.split(" ")) for n in (a, b)]
    words = by_side([[w for w in n.split() if len(w) > 1 or w.isdigit()] for n in (a, b)])
    telling = {w: side for w, side in words.items() if w not in rule.stop}
    met = sum(side == 3 for side in telling.values())
    letters = by_side([{x + y for x, y in itertools.pairwise(n)} for n in joined])
    sizes = [sum(bool(side & bit) for side in letters.values()) for bit in (1, 2)]
    jaccard = met / len(telling) if telling else 0.0
    dice = round(2 * sum(side == 3 for side in letters.values()) / sum(sizes), 3) if all(sizes) else 0.0
    figures = by_side([[w for w in n.split() if not w.strip("0123456789.")] for n in (a, b)])
    told_apart = [w for w, side in telling.items() if side < 3 and w in rule.discriminators and sum(w in n for n in joined) == 1]
    alike = last_form(rule, joined[0]) == last_form(rule, joined[1]) and not told_apart and all(side == 3 for side in figures.values())
    return alike and (met > 0 and jaccard >= 0.5 or dice >= 0.7 or met > 1 and dice >= 0.6), jaccard, dice


def decided(spark, rule, pairs):
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    d = df.select("i", linker.accepts(rule, linker.described(rule, F.col("a")), linker.described(rule, F.col("b"))).alias("d")).orderBy("i")
    return [(r.d.accepted, r.d.jaccard, r.d.dice) for r in d.collect()]


RULE = linker.AcceptRule(stop=frozenset({"cream"}), discriminators=frozenset({"mini"}), forms=("cream", "serum", "eyecream", "balm"), form_map=(("balm", "serum"),))


def test_acceptance_rule(spark):
    cases = [
        ("green tea cream", "green tea cream", True), ("green tea cream", "green tea calm cream", True),
        ("green tea cream", "green tea serum", False),  # form
        ("green tea balm", "green tea serum", True),  # a form that counts as the other
        ("green tea cream", "mini green tea cream", False),  # discriminator
        ("green minitea cream", "green mini tea cream", True),  # by characters it does not differ
        ("green tea 20 cream", "green tea 30 cream", False),  # number
        ("abc cream", "xyz cream", False),  # generic words are no evidence
        ("greentea cream", "green tea cream", True),  # Dice alone
        ("", "", False), ("a", "a", False), ("5", "5", True),
    ]
    assert [x[0] for x in decided(spark, RULE, [c[:2] for c in cases])] == [c[2] for c in cases]
    words = ["green", "tea", "cream", "serum", "mini", "balm", "5", "7.5", "x", "calm"]
    rng = random.Random(1)
    pairs = [[" ".join(rng.choice(words) for _ in range(rng.randint(0, 5))) for _ in "ab"] for _ in range(300)]
    assert decided(spark, RULE, pairs) == [accepts(RULE, *p) for p in pairs]


def test_pair_decisions_cover_the_whole_table(spark, sf):
    rows = spark.read.parquet(f"{sf}/part.parquet").collect()
    want = {}
    for a, b in itertools.combinations(sorted(rows, key=lambda r: r.p_partkey), 2):
        if a.p_brand == b.p_brand:
            want[a.p_partkey, b.p_partkey] = accepts(PART_RULE, a.p_name, b.p_name)
    got = registry.QUERIES["dc6_pair_decisions"](spark, sf).collect()
    assert len(got) == len(want) and {(r.a, r.b): (r.accepted, r.jaccard, r.dice) for r in got} == want
    assert {ok for ok, _, _ in want.values()} == {True, False}


def test_candidates_lose_no_accepted_pair(spark):
    rng = random.Random(2)
    words = ["green", "tea", "cream", "serum", "mini", "balm", "calm", "greentea", "aloe", "aloevera", "vera", "rose"]
    names = sorted({" ".join(rng.choice(words) for _ in range(rng.randint(1, 6))) for _ in range(150)})
    df = spark.createDataFrame([("b", n) for n in names], "block string, name string").withColumn("d", linker.described(RULE, F.col("name")))
    got = {(r.m, r.n) for r in linker.candidate_pairs(df).collect()}
    want = {(a, b) for a in names for b in names if a != b and accepts(RULE, a, b)[0]}
    assert want <= got and len(want) > 50


def test_clusters_by_rule(spark):
    rows = [
        ("b", 1, "x", "red pen"), ("b", 2, "y", "red pen xl"), ("b", 3, "z", "red pen 2"), ("b", 4, "y", "red pens"), ("b", 5, "x", "red pen"), ("b", 6, "z", "red pens"),
        ("c", 7, "x", "red pen"), (None, 8, "x", "red pen"), ("c", 9, None, "red pen"), ("c", 10, "y", None), ("c", 11, "z", ""),
    ]
    df = spark.createDataFrame(rows, "brand string, k int, site string, name string")
    rule = linker.AcceptRule(discriminators=frozenset({"xl"}))
    got = {r.k: (r.cluster, r.sites) for r in linker.clusters(df, "brand", "k", "site", "name", rule).collect()}
    assert got == {1: (1, 3), 4: (1, 3), 5: (1, 3), 6: (1, 3), 2: (2, 1), 3: (3, 1), 7: (7, 1), 8: (8, 1), 9: (9, 0), 10: (10, 1), 11: (11, 1)}
    assert linker.clusters(df.limit(0), "brand", "k", "site", "name", rule).count() == 0


def test_connected(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(50)] + [(5, 5)]
    up = {}

    def root(i):
        while up.setdefault(i, i) != i:
            i = up[i]
        return i

    for a, b in edges:
        if a != b:
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in graph.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in up}


def test_conditional_upsert_with_nulls(spark):
    old = spark.createDataFrame([(1, None, 5.0), (2, "x", 1.0), (3, "y", None), (5, "v", 2.0)], "k long, a string, b double")
    new = spark.createDataFrame([(2, None, 9.0), (4, None, None), (3, "z", 2.0), (5, "w", 1.0)], "k long, a string, b double")
    got = sinks.conditional_upsert(old, new, ["k"], ["a", "b"], F.col("new.b") > F.col("old.b")).orderBy("k").collect()
    assert [tuple(r) for r in got] == [(1, None, 5.0), (2, None, 9.0), (3, "y", None), (4, None, None), (5, "v", 2.0)]


def test_terms_of_any_script_match(spark):
    docs = [(1, "이 수분크림을 발라요 The Cream"), (2, "no thecream here, cream."), (3, None), (4, ""), (5, "한a 비타민C"), (6, "Été, été; étés"), (7, "x1 a-b cream cream")]
    terms = ["수분크림", "cream", "THE cream", "한", "림을", "", "한a", "비타민c", "été", "x1", "a-b"]
    got = sorted((r.id, r.term, r.span_start) for r in X.match_terms(spark.createDataFrame(docs, "id long, text string"), "text", spark.createDataFrame([(t,) for t in terms], "term string"), "term", "id").collect())
    want = []
    for i, text in docs:
        for t in terms:
            low = t.lower()
            pattern = rf"(?<![a-z0-9]){re.escape(low)}(?![a-z0-9])" if re.match("[a-z0-9]", low) else re.escape(low)
            if t and text and (m := re.search(pattern, text.lower())):
                want.append((i, t, m.start()))
    assert got == sorted(want)


def test_term_shapes(spark):
    rows = [("B", "new shine cream"), (None, "shine cream"), ("B", "shine"), ("B", "cream"), (None, "shine"), ("B", "B shine cream"), (None, None)]
    df = spark.createDataFrame([(*r, ["cream"]) for r in rows], "brand string, name string, generic array<string>")
    got = [r.t for r in df.select(X.candidate_terms(F.col("brand"), F.col("name"), F.col("generic")).alias("t")).collect()]
    assert got == [["B new shine cream", "new shine cream", "B new shine"], ["shine cream"], ["B shine"], [], ["shine"], ["B shine cream", "shine cream", "B shine"], []]


def test_whole_tables_come_out(spark, sf):
    part, supplier = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("part", "supplier"))
    terms = registry.QUERIES["dc20_candidate_terms"](spark, sf).collect()
    assert len(terms) == part.count() and max(len(r.terms) for r in terms) == 3
    assert registry.QUERIES["j29_containment_whole"](spark, sf).select("brand").distinct().count() == part.select("p_brand").distinct().count()
    assert registry.QUERIES["gr3_edge_layers_whole"](spark, sf).where("layer = 2").count() == supplier.count()


def test_layers_and_feedback_edges(spark, sf):
    df = lambda edges: spark.createDataFrame(edges, "a string, b string")
    chain = [(f"n{i:03}", f"n{i + 1:03}") for i in range(120)] + [("n000", "n119")]
    assert {r.node: r.layer for r in graph.layers(df(chain), "a", "b").collect()} == {f"n{i:03}": i for i in range(121)}
    with pytest.raises(ValueError):
        graph.layers(df([("a", "b"), ("b", "a")]), "a", "b")
    rng = random.Random(3)
    for _ in range(20):
        edges = sorted({(rng.choice("abcdefgh"), rng.choice("abcdefgh")) for _ in range(14)})
        back = graph.feedback_edges(edges)
        reach = {x: {x} for e in edges for x in e}
        for _ in range(8):
            for x, y in edges:
                for z in reach:
                    if x in reach[z]:
                        reach[z].add(y)
        assert all(x in reach[y] for x, y in back)  # each closes a cycle
        left = [e for e in edges if e not in back]
        if left:
            graph.layers(df(left), "a", "b")  # without them there is none
    found = registry.QUERIES["gr3_feedback_edges"](spark, sf).collect()
    assert {r.feedback for r in found} == {True, False} and graph.layers(df([(r.a, r.b) for r in found if not r.feedback]), "a", "b").count() == len({x for r in found for x in (r.a, r.b)})


def test_singletons_and_batches(spark):
    rows = [(1, 1, True), (1, 2, False), (2, 3, False), (None, 4, True)]
    df = spark.createDataFrame(rows, "k int, v int, active boolean")
    got = ledger.active_singleton(df, "k", F.col("active"), "v").collect()
    assert {(r.k, r.v) for r in got} == {(1, 1), (2, None), (None, 4)}
    with pytest.raises(Exception, match="more than one active row of 1"):
        ledger.active_singleton(df.withColumn("active", F.lit(True)), "k", F.col("active"), "v").collect()
    for n, size in ((0, 3), (1, 3), (6, 3), (7, 3), (1000, 64)):
        batches = [r.batch for r in ledger.request_batches(spark.range(n), "id", size).orderBy("id").collect()]
        first = n % size or size
        assert batches == [0 if i < first else 1 + (i - first) // size for i in range(n)]
