import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F
from tidewell.functions import scalars as S
from tidewell.operators import graph, linker, sinks, windows
from tidewell.operators import joins as J
from tidewell.operators import text as X


def test_asof_takes_the_latest_and_keeps_unmatched(spark):
    left = spark.createDataFrame([(1, 5), (1, 1), (2, 9)], "k int, t int")
    right = spark.createDataFrame([(1, 2, "a"), (1, 5, "b"), (1, 6, "c")], "k int, at int, v string")
    got = {(r.k, r.t): r.v for r in J.asof_backward(left, right, ["k"], "t", "at", ["v"]).collect()}
    assert got == {(1, 5): "b", (1, 1): None, (2, 9): None}


def test_interval_join_equals_a_plain_theta_join(spark):
    points = spark.range(0, 200).select((F.col("id") % 3).alias("k"), (F.col("id") * 7 % 97).alias("at"), "id")
    spans = spark.range(0, 40).select((F.col("id") % 3).alias("k"), (F.col("id") * 5 % 90).alias("b"), (F.col("id") * 5 % 90 + F.col("id") % 11).alias("e"), F.col("id").alias("s"))
    got = J.interval_join(points, spans, ["k"], "at", "b", "e", 8).select("id", "s").collect()
    want = points.join(spans, "k").where("at >= b and at < e").select("id", "s").collect()
    assert sorted(got) == sorted(want)


def test_reconcile(spark):
    old = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "k int, v string")
    new = spark.createDataFrame([(2, None), (3, "d"), (4, "e")], "k int, v string")
    assert {(r.k, r.change) for r in J.reconcile(old, new, ["k"], ["v"]).collect()} == {(1, "removed"), (3, "changed"), (4, "added")}


def test_coalesce_merge_keeps_first_values(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k int, v string, first int")
    new = spark.createDataFrame([(1, None, 9), (3, "c", 3)], "k int, v string, first int")
    got = {r.k: (r.v, r.first) for r in sinks.coalesce_merge(old, new, ["k"], ["v"], ["first"]).collect()}
    assert got == {1: ("a", 1), 2: ("b", 2), 3: ("c", 3)}


def test_mid_rank_of_ties(spark):
    df = spark.createDataFrame([("x", 1.0), ("x", 2.0), ("x", 2.0), ("y", 5.0)], "k string, v double")
    got = sorted((r.k, r.v, r.m) for r in df.select("k", "v", windows.mid_rank("v", ["k"]).alias("m")).collect())
    assert got == [("x", 1.0, pytest.approx(1 / 6)), ("x", 2.0, pytest.approx(2 / 3)), ("x", 2.0, pytest.approx(2 / 3)), ("y", 5.0, 1.0)]


def test_chunks_lose_no_character(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice("ab. !\n?다한") for _ in range(rng.randint(0, 400))) for _ in range(300)] + [None, "", " \n", "x" * 200, "  a  "]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for limit in (5, 17, 60):
        for r in df.select("t", X.chunks(F.col("t"), limit).alias("c")).collect():
            assert all(0 < len(p) <= limit and p == p.strip() for p in r.c)
            assert "".join("".join(p.split()) for p in r.c) == "".join((r.t or "").split())


def test_chunks_are_cut_at_the_foremost_mark(spark):
    cases = [
        ("aaaa. bb cc", 10, ["aaaa. bb", "cc"]),  # the full stop is not past the middle, a blank is
        ("aaaaaa. b c d", 10, ["aaaaaa.", "b c d"]),  # past the middle a full stop goes before blanks
        ("aaaaaa! b. c dd", 10, ["aaaaaa!", "b. c dd"]),  # the full stop's blank lies beyond the limit
        ("aaaaaa? b c dd", 10, ["aaaaaa?", "b c dd"]),
        ("abcdefghijkl", 10, ["abcdefghij", "kl"]),
        ("short", 10, ["short"]),
        ("aaaaa bbb\nccc", 10, ["aaaaa bbb", "ccc"]),
    ]
    got = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(cases)], "i int, t string").select("i", X.chunks(F.col("t"), 10).alias("c")).orderBy("i").collect()
    assert [r.c for r in got] == [c for _, _, c in cases]


def test_list_names(spark):
    def plain(text):
        body = re.sub(r"\[[^\]]*\]", " ", text or "")
        hidden = body
        while m := re.search(r"\([^()]*\)", hidden):  # the innermost pairs first
            hidden = hidden[: m.start()] + "x" * len(m[0]) + hidden[m.end() :]
        cuts = [-1, *(m.start() for m in re.finditer("[,@]", hidden)), len(body)]
        return [n for a, b in zip(cuts, cuts[1:], strict=False) if (n := body[a + 1 : b].strip())]

    rng = random.Random(3)
    texts = ["Water, Oil (a, b), [mark] Salt @ Wax", "A (b, C, D", None, "", "a (b (c, d), e), f)", "(" * 300 + ",", "x, " * 9000] + ["".join(rng.choice("ab ,@()[]") for _ in range(rng.randint(0, 30))) for _ in range(500)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: r.n for r in df.select("i", X.list_names(F.col("t")).alias("n")).collect()}
    assert plain(texts[0]) == ["Water", "Oil (a, b)", "Salt", "Wax"] and got == {i: plain(t) for i, t in enumerate(texts)}


def test_polarity_order(spark):
    rules = X.PolarityRules(positive=r"\bgood\b", negative=r"\bbad\b", negated_positive=r"never again", wish=r"\bwish\b", aspects=(("sticky", "sticky", False), ("scent", "scent", True)))
    texts = ["so sticky", "not sticky, good", "the scent", "bad scent", "never again", "good", "nothing here"]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", X.judged(rules, F.col("t")).alias("p")).orderBy("i").collect()
    assert [r.p.polarity for r in got] == ["complaint", "satisfied", "neutral", "complaint", "complaint", "satisfied", "neutral"]
    assert [r.p.aspect for r in got][:4] == ["sticky", "sticky", "scent", "scent"]


def test_clusters_hold_one_item_per_site(spark):
    rows = [("b", 1, "x", "red pen"), ("b", 2, "y", "red pen"), ("b", 3, "y", "red pen xl"), ("b", 4, "z", "blue")]
    df = spark.createDataFrame(rows, "brand string, k int, site string, name string")
    got = {r.k: r.cluster for r in linker.clusters(df, "brand", "k", "site", "name", linker.AcceptRule()).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4}


def test_feedback_edges():
    assert graph.feedback_edges([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")]) == {("c", "a")}


def test_iso_seconds_and_normal_text(spark):
    df = spark.createDataFrame([("PT1M5S",), ("P1DT2H",), ("x",), (None,)], "d string").select(S.iso_seconds(F.col("d")).alias("s"))
    assert [r.s for r in df.collect()] == [65, 93600, None, None]
    assert S.normal_text("a&amp;amp;b \x00 c dＡ") == "a&b c dA"


def test_csv_reader_keeps_empty_strings(spark, tmp_path):
    from tidewell.sources.readers import read_csv

    path = tmp_path / "x.csv"
    path.write_text('﻿id,name,day\n1,"",2024-01-02\n2,"a ""q"", b\nc",\n', encoding="utf-8")
    rows = read_csv(spark, f"file://{path}", "id int, name string, day date").orderBy("id").collect()
    assert [(r.id, r.name, r.day) for r in rows] == [(1, "", dt.date(2024, 1, 2)), (2, 'a "q", b\nc', None)]


def test_manifest_check(spark):
    from tidewell.sources.readers import manifest_violations

    docs = spark.createDataFrame([(1, "a"), (2, "a"), (2, "b")], "doc_id int, kind string")
    assert {(r.kind, r.problem) for r in manifest_violations(docs, "doc_id", "kind", {"a": 2, "b": 2}).collect()} == {("b", "count"), ("", "repeated id")}
