"""Rules over whole tables, loaders, outputs and shops' answers, case by case."""

import json
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F
from tidewell.functions import scalars
from tidewell.operators import graph
from tidewell.operators import rules as R
from tidewell.operators import text as X
from tidewell.sources import loaders as S
from tidewell.sources import shops as P


def test_months_with_an_untrusted_row_are_unknown(spark):
    rows = spark.createDataFrame([("01", "a", True), ("01", "b", False), ("01", "b", True), ("02", "a", True), ("03", "a", None)], "month string, need string, ok boolean")
    out = R.trusted_months(rows, "month", ["need"], F.col("ok"), {"n": F.lit(True)}).collect()
    assert sorted((r.month, r.need, r.n) for r in out) == [("01", "a", None), ("01", "b", None), ("02", "a", 1), ("03", "a", None)]


def test_windows_go_by_the_calendar(spark):
    rows = [("a", "2020Q1", 10), ("a", "2021Q1", 6), ("b", "2021Q2", 6), ("a", "2019Q3", 99), ("b", "2021Q4", 5)]
    df = spark.createDataFrame(rows, "topic string, quarter string, n long")
    last = spark.range(1).select(R.quarter_index(F.lit("2021Q4"))).first()[0]
    got = {r.topic: (r.prior, r.recent, r.delta) for r in R.window_shares(df, last).collect()}
    assert got == {"a": (100.0, 50.0, -50.0), "b": (0.0, 50.0, 50.0)}
    assert R.panel_sensitivity(spark.createDataFrame([], "topic string, quarter string, product long, every long"), 1, 1.0).count() == 0


def test_lost_verdicts_are_no_flips(spark):
    rows = [("base", "a", 1, "rising"), ("base", "a", 2, "thin"), ("base", "b", 1, "peak"), ("x", "a", 1, "falling"), ("x", "a", 2, "rising"), ("x", "b", 1, "thin"), ("y", "a", 1, "rising")]
    out = R.verdict_changes(spark.createDataFrame(rows, "variant string, topic string, q int, verdict string"), ["topic", "q"], ["topic"]).collect()
    assert sorted(map(tuple, out)) == [("x", "a", 1, 1, 0), ("x", "b", 1, 0, 1), ("y", "a", 1, 0, 0), ("y", "b", 1, 0, 1)]
    dropped = R.variants(spark.range(4), {"even": F.col("id") % 2 == 0, "none": F.lit(None).cast("boolean")})
    assert {r.variant: r["count"] for r in dropped.groupBy("variant").count().collect()} == {"base": 4, "even": 2, "none": 4}


def test_confirmed_answers_come_before_hints(spark):
    known = spark.createDataFrame([("g", "x bad", "positive")], "topic_group string, topic_name string, polarity string")
    rows = spark.createDataFrame([(1, "g", " x bad "), (2, None, "x bad"), (3, "g", "so so bad"), (4, "g", None)], "i long, grp string, name string")
    out = {r.i: r.polarity for r in R.confirmed_polarity(rows, "grp", "name", known, ["so so"], ["bad"]).collect()}
    assert out == {1: "positive", 2: "negative", 3: "neutral", 4: "positive"}


@pytest.mark.parametrize(
    ("a", "b", "want"),
    [
        (("line", "s", "1", None, None, {"spf": "50"}), ("line", "s", "1", None, None, {"spf": "30"}), "distinct"), (("line", "s", "1", None, None, {"spf": "50"}), ("line", "s", "1", None, None, {"shade": "3"}), "same_line"),
        (("listing", "s", "1", None, ["a"], None), ("variant", "s", "1", "a", None, None), "listing_contains_variant"), (("variant", "s", "1", "b", None, None), ("listing", "s", "1", None, ["a"], None), "unresolved"),
        (("variant", "s", "1", "a", None, None), ("variant", "s", "1", "b", None, None), "distinct"), (("variant", "s", "1", "a", None, None), ("variant", "s", "1", "a", None, {"spf": None}), "same_variant"),
        (("listing", "s", "1", None, None, None), ("listing", "t", "1", None, None, None), "unresolved"), (("variant", "s", "1", None, None, None), ("line", "s", "1", None, None, None), "invalid"),
        (("line", "s", "", None, None, None), ("line", "s", "1", None, None, None), "invalid"), ((None, "s", "1", None, None, None), ("line", "s", "1", None, None, None), "invalid"),
    ],
)
def test_identity(spark, a, b, want):
    kind = "struct<level:string,source:string,product_id:string,variant_key:string,variant_keys:array<string>,attributes:map<string,string>>"
    df = spark.createDataFrame([(a, b)], f"a {kind}, b {kind}")
    assert df.select(R.identity_relation(F.col("a"), F.col("b")).alias("r")).first().r == want


def test_the_gate_names_its_reason(spark):
    kind = "snapshot_id long, active boolean, lineage string, text_parts array<string>"
    gate = lambda *rows: R.live_gate(spark.createDataFrame(list(rows), kind), "live", "description")
    assert gate((1, False, "archive", None), (2, True, "live", ["title", "description"])) == 2
    for rows, said in [([], "nothing"), ([(1, True, "archive", None)], "never made anew"), ([(1, True, "live", None)], "have no"), ([(1, True, "live", None), (2, True, "live", None)], "more than one")]:
        with pytest.raises(R.GateClosed, match=said):
            gate(*rows)


def test_rounding_to_a_thresholds_places(spark):
    df = spark.createDataFrame([(2 / 3,), (0.665,), (0.6649,), (0.675,), (None,)], "x double")
    assert [r.m for r in df.select(R.meets(F.col("x"), "0.67").alias("m")).collect()] == [True, False, False, True, None]


def test_places_of_many_matches(spark, monkeypatch):
    texts = ["", None, "ab" * 7, "xaxbx" * 40, "é😀a" * 1500]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    import re

    for block in (1, 3, 512):
        monkeypatch.setattr(scalars, "BLOCK", block)
        got = {r.i: [tuple(x) for x in r.s] for r in df.select("i", scalars.spans(F.col("t"), "[ab]").alias("s")).collect()}
        assert got == {i: [(m.start(), m.end(), m[0]) for m in re.finditer("[ab]", t or "")] for i, t in enumerate(texts)}


def test_layers_of_a_graph_with_several_ends(spark):
    df = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("d", "c"), ("a", "b")], "a string, b string")
    assert {r.node: r.layer for r in graph.layers(df, "a", "b").collect()} == {"a": 0, "d": 0, "b": 1, "c": 2}
    assert graph.layers(df.limit(0), "a", "b").count() == 0


def test_a_fingerprint_is_of_the_rows_alone(spark):
    rows = [(i, None if i % 7 == 0 else f"x{i % 5}") for i in range(300)]
    mark = lambda r, n=1: X.fingerprint(spark.createDataFrame(r, "a long, b string").repartition(n), ["a", "b"]).first()[0]
    assert mark(rows) == mark(rows[::-1], 7) != mark(rows + rows[:1]) and mark(rows) != mark([*rows[1:], (0, "")])


# --- loaders and outputs -----------------------------------------------------------------------------------------------


def test_brand_surfaces_and_versions(spark):
    brands = spark.createDataFrame([("A", "a", "aa|b|", "s", 1), ("B", "b", "aa|old", "", 2), ("C", "c", None, None, 3)], "canonical string, surface string, aliases string, sources string, place long")
    stop = spark.createDataFrame([("C", "stop", "why"), ("B", "cooc_required", "near")], "brand string, tier string, reason string")
    dropped = spark.createDataFrame([("B", "old", "drop"), ("A", "aa", "keep")], "brand string, alias string, decision string")
    rows = S.brand_surfaces(brands, stop, dropped)
    stored = spark.createDataFrame([("brand", "Z", "a", "link", 1)], "kind string, canonical string, surface string, tier string, version int")
    one = S.load_versioned(stored, rows, 2, ["kind", "surface"], "place")
    assert sorted((r.canonical, r.surface, r.tier, r.version) for r in one.collect()) == [("A", "a", "link", 2), ("A", "aa", "link", 2), ("B", "b", "near", 2), ("C", "c", "stop", 2), ("Z", "a", "link", 1)]
    assert S.load_versioned(one, rows, 2, ["kind", "surface"], "place").count() == 5
    spelled = S.fan_out_surfaces(spark.createDataFrame([("k", "x||y", 1), ("l", None, 2)], "c string, s string, p long"), "ingredient", "c", "s", "p")
    assert sorted((r.canonical, r.surface) for r in spelled.collect()) == [("k", "x"), ("k", "y")]


def test_outputs(spark):
    rows = spark.createDataFrame([(1, 'say "a", b', None), (2, "line\nbreak", "|")], "i long, t string, u string")
    assert S.csv_text(rows, ["i", "t", "u"]) == '﻿i,t,u\n1,"say ""a"", b",\n2,"line\nbreak",|'
    assert S.markdown_text(rows, ["i", "u"]) == "| i | u |\n| - | - |\n| 1 |  |\n| 2 | \\| |"
    with pytest.raises(ValueError, match="more than 1 rows"):
        S.csv_text(rows, ["i"], 1)
    assert S.file_name("wish", None, "csv", datetime(2024, 3, 4, 5, 6)) == "needs.wish.20240304-0506.csv" and S.file_name("wish", "all", "csv", datetime(2024, 3, 4)).startswith("needs.wish.all.")
    kept = S.kept_metadata(spark.createDataFrame([(1, '{"likes": 3, "author": "x", "pinned": "no"}'), (2, "[broken")], "i long, meta string"), "meta", {"likes": "bigint", "pinned": "boolean"})
    assert kept.columns == ["i", "likes", "pinned"] and sorted((r.i, r.likes) for r in kept.collect()) == [(1, 3), (2, None)]


def test_missing_tables_are_left_out(spark, tmp_path):
    spark.createDataFrame([(1, "x")], "a long, b string").write.parquet(f"{tmp_path}/one")
    out = R.union_present(spark, {"one": f"{tmp_path}/one", "two": f"{tmp_path}/two"}, "a long, c string").collect()
    assert [tuple(r) for r in out] == [(1, None, "one")]


# --- shops -------------------------------------------------------------------------------------------------------------


def answers(spark, *bodies):
    return spark.createDataFrame([(f"k{i}" if b is not ... else None, b) for i, b in enumerate(bodies)], "key string, body string").withColumn("at", F.lit(date(2024, 5, 1)))


def test_reviews_of_odd_answers(spark):
    row = {"reviewId": 7, "reviewScore": True, "content": None, "profileDto": "x", "createdDateTime": "2024.02.30"}
    bodies = [json.dumps(x) for x in ({"data": {"goodsReviewList": [row, 3, None, {"reviewScore": 3}]}}, {"data": []}, {"data": {"goodsReviewList": {}}}, [1], {})] + ["<html>", "", None]
    out = P.reviews(answers(spark, *bodies)).collect()
    assert [tuple(r)[2:] for r in out] == [("7", None, None, None, None)]
    assert {r.key: r.ends for r in P.walk_ends(answers(spark, *bodies[:2])).collect()} == {"k0": True, "k1": False}


def test_flight_objects_by_balanced_braces(spark):
    flight = 'a:{"x": "}", "idProduct": "1", "in": {"y": "\\\\\\"{", "idProduct": "2"}, "productRank": [4]}{"no": {}}}{"idProduct": "3"'
    df = spark.createDataFrame([("k", flight), ("e", ""), ("n", None)], "key string, t string")
    assert sorted(r.object for r in P.objects_with(df, "key", "t", "idProduct").collect()) == sorted([flight[2 : flight.index('{"no"')], '{"y": "\\\\\\"{", "idProduct": "2"}'])
    pieces = [json.dumps(flight[:40])[1:-1], json.dumps(flight[40:])[1:-1]]
    html = "".join(f'<script>self.__next_f.push([1,"{p}"])</script>' for p in pieces)
    got = spark.createDataFrame([(html,), ("<html>",), (None,)], "h string").select(P.flight_text(F.col("h")).alias("t")).collect()
    assert [r.t for r in got] == [flight, "", ""]


def test_boards_of_odd_pages(spark):
    def page(props):
        return f'<script id="__NEXT_DATA__" type="x">{json.dumps({"props": {"pageProps": props}})}</script>'

    rows = [{"product": {"id": 5, "name": None, "price": 9}}, {"product": {}}, {"product": {"id": "6"}, "goods": {"price": "9"}, "is_rank_new": True}]
    bodies = [page({"r": {"data": rows}, "trendingThemeId": 12}), page({"r": {"data": 3}}), page([]), "<script>", None]
    out = P.board_records(answers(spark, *bodies), [("hot", "r", None)]).collect()
    assert sorted((r.kind, r.category, r["rank"], r.product_key, r.name, r.price, r.fresh) for r in out) == [("price", "12", 1, "5", None, 9.0, None), ("rank", "12", 1, "5", "", 9.0, None), ("rank", "12", 2, "6", "", None, True)]


def test_terms_of_both_scripts(spark):
    from tidewell.operators import retrieval as Q
    from tidewell.operators.names import nfkc

    texts = ["SPF50+ sun-cream PA++ a", "선크림은 SPF50+ 라네즈에서 산 워터선크림이 좋아요", "ＡＢＣ cream 가", None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string").select("i", nfkc("t").alias("t"))
    got = {r.i: r.w for r in df.select("i", Q.search_tokens(F.col("t"), ["선크림", "라네", "x y"]).alias("w")).collect()}
    assert got[0] == ["spf50+", "sun-cream", "pa+", "a"] and got[2] == ["abc", "cream"] and got[3] == got[4] == []
    assert got[1] == ["선크림", "라네즈", "라네", "워터선크림", "선크림", "좋아요", "spf50+"]
    asked = {r.i: r.w for r in spark.createDataFrame([(0, "the cream the"), (1, "the of")], "i long, t string").select("i", Q.query_tokens(F.col("t"), ["the", "of"]).alias("w")).collect()}
    assert asked == {0: ["cream"], 1: ["the", "of"]}


def test_rules_of_a_versioned_dictionary(spark):
    rows = [
        ("aspect", "dry", "dry", False, 2, True, 3), ("aspect", "sting", "sting(?:s|ing)", False, 1, True, 3), ("aspect", "sting", "burns", False, 3, True, 3), ("positive", None, "love", None, 1, True, 3), ("positive", None, "great", None, 2, True, 3),
        ("negative", None, "awful", None, 1, True, 3), ("negative", None, "old", None, 1, False, 2), ("wish", None, "hope", None, None, True, 3),
    ]
    kind = "slot string, name string, pattern string, neutral boolean, place long, active boolean, version int"
    df = spark.createDataFrame(rows, kind)
    rules = X.rules_of(X.PolarityRules, df)
    assert rules.positive == "(?:love)|(?:great)" and rules.negative == "(?:awful)" and rules.negated_positive == X.NEVER and [a[0] for a in rules.aspects] == ["sting", "dry"]
    said = spark.createDataFrame([(0, "it burns, awful"), (1, "not dry, love it"), (2, "great")], "i long, s string").select("i", X.judged(rules, F.col("s")).alias("p")).collect()
    assert {r.i: (r.p.aspect, r.p.polarity) for r in said} == {0: ("sting", "complaint"), 1: ("dry", "satisfied"), 2: (None, "satisfied")}
    assert X.rules_of(X.PolarityRules, df, 2).negative == "(?:old)" and X.rules_of(X.WishRules, df.where("slot = 'none'").unionByName(spark.createDataFrame([("launch", None, "make it", None, 1, True, 1)], kind))).launch == "(?:make it)"
    with pytest.raises(ValueError, match="more than one active"):
        X.rules_of(X.PolarityRules, df.withColumn("active", F.lit(True)))
    with pytest.raises(ValueError, match="no slot"):
        X.rules_of(X.WishRules, df.where("slot = 'negative'"))


def test_terms_are_counted_in_their_row(spark):
    from tidewell.operators import retrieval as Q

    df = spark.createDataFrame([(0, ["b", "a", "b"]), (1, []), (2, ["x"] * 5000 + ["y"]), (3, None)], "i long, w array<string>")
    got = {r.i: [tuple(x) for x in r.c] for r in df.select("i", Q.term_counts(F.col("w")).alias("c")).collect()}
    assert got == {0: [("a", 1), ("b", 2)], 1: [], 2: [("x", 5000), ("y", 1)], 3: []}


# --- queues and caches ------------------------------------------------------------------------------------------------


def test_queue_outcomes_in_order(spark):
    from tidewell.operators import work as K

    jobs = spark.createDataFrame([("a", "t", "queued"), ("b", "t", "running"), ("a", "u", "done")], "kind string, target string, state string")
    wanted = [("a", "t", 1), ("a", "u", 2), ("a", "u", 3), ("c", "t", 4), ("d", "t", 5), ("a", "v", 6), ("a", "w", 7)]
    out = K.enqueued(jobs, spark.createDataFrame(wanted, "kind string, target string, place long"), 5, 3).collect()
    assert {r.place: r.outcome for r in out} == {1: "duplicate", 2: "enqueued", 3: "duplicate", 4: "enqueued", 5: "per_target", 6: "enqueued", 7: "capped"}
    assert {r.outcome for r in K.enqueued(jobs, spark.createDataFrame(wanted, "kind string, target string, place long"), 1, 3).collect()} == {"duplicate", "per_target", "capped"}


def test_the_latest_artifact_keeps_the_last_limit(spark):
    from tidewell.operators import work as K

    day = lambda d: datetime(2024, 1, d)
    rows = [
        ("kept", 1, day(1), day(9)), ("kept", 2, day(2), None), ("kept", 3, day(2), None), ("stale", 4, day(1), day(9)), ("stale", 5, day(2), day(3)),
        ("never", 6, day(1), None), ("undated", 7, None, day(9)), ("undated", 8, day(2), day(3)), ("unnamed", None, day(2), day(9)), ("unnamed", 9, day(1), None), ("not asked", 10, day(1), day(9)),
    ]
    artifacts = spark.createDataFrame(rows, "k string, identifier long, fetched_at timestamp_ntz, fresh_until timestamp_ntz")
    asked = spark.createDataFrame([(k,) for k in ("kept", "stale", "never", "undated", "unnamed", "unknown", None)], "k string")
    got = {r.k: (r.artifact, r.fetch) for r in K.cached_or_fetch(asked, artifacts, ["k"], day(5)).collect()}
    none = (None, True)
    assert got == {"kept": (3, False), "stale": none, "never": none, "undated": (7, False), "unnamed": (9, False), "unknown": none, None: none}


@pytest.mark.parametrize("name", ["st7_cached_artifacts", "dc4_card_types"])
def test_rows_of_the_next_larger_tables(spark, name):
    from tidewell.plans import compare, registry

    sf = "/root/testdata/sf0.01"  # the smallest tables don't have these cases
    assert compare.differences(registry.QUERIES[name](spark, sf), compare.connect(sf), registry.ORACLE_SQL[name]) is None


def test_strength_is_rounded_from_the_double(spark):
    from tidewell.operators import work as K

    values = [294.715, 276.335, 270.715, -294.715, 2.675, 0.125, 1.005, 1e308, float("inf"), float("nan"), None]
    df = spark.createDataFrame([(x,) for x in values], "x double")
    got = [r.s for r in df.select(K.card_strength(F.lit("fad_risk"), F.lit(None).cast("double"), F.col("x")).alias("s")).collect()]
    assert [str(x) for x in got] == ["294.71", "276.33", "270.71", "-294.71", "2.68", "0.13", "1.0", "1e+308", "inf", "nan", "0.0"]
    assert [r.s for r in df.limit(3).select(K.card_strength(F.lit("product_gap"), -F.col("x"), F.lit(1.0)).alias("s")).collect()] == [294.71, 276.33, 270.71]


def test_routes_that_can_not_be_compared(spark):
    from tidewell.operators import work as K

    arm = spark.createDataFrame([("c", "x", 1, None), ("c", "y", 2, date(2024, 1, 2))], "c string, v string, place int, at date")
    with pytest.raises(K.IncomparableWindow, match="first listing"):
        K.route_comparison(arm, arm, ["c"], "v", "place", "at", "2024-01-01")
    assert {r.side for r in K.route_comparison(arm, arm, ["c"], "v", "place", "at").collect()} == {"both"}
