"""Match positions, and the rules of polarity, wishes and names that stand on them."""

import random
import re

import pytest
from pyspark.sql import functions as F
from tidewell.functions.scalars import spans
from tidewell.operators import text as X


def test_spans_are_the_matches(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab한 é.") for _ in range(rng.randint(0, 40))) for _ in range(200)] + [None, "", "a", "ab" * 300]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for pattern in ("a", "ab?", "(?<=b)a+", r"(?:한|é)\s?", "b(?! )", r"\.$", "(?!)"):
        got = {r.i: [tuple(x) for x in r.s] for r in df.select("i", spans(F.col("t"), pattern).alias("s")).collect()}
        assert got == {i: [(m.start(), m.end(), m[0]) for m in re.finditer(pattern, t or "")] for i, t in enumerate(texts)}, pattern


ENGLISH = X.PolarityRules(
    positive=r"\b(?:good|soft|love)\b", negative=r"\b(?:bad|awful|very dry)\b", negated_positive=r"never again|not worth", wish=r"\bwish\b", negated_tail=r"without and", context=r"other cream .{0,4}$", skin=r"for those with", warning=r"careful",
    contrast=r"but this one", aspects=(("dry", r"\bdry(?:ness)?\b", False), ("smell", r"\bsmells?\b", True), ("sticky", r"\bsticky\b", False)),
)


@pytest.fixture(scope="module")
def said(spark):
    def of(column, texts):
        df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
        return [tuple(r.x) for r in df.select("i", column(F.col("t")).alias("x")).orderBy("i").collect()]

    return of


def test_polarity_by_the_first_rule_that_holds(said):
    cases = {
        "for those with dry skin, careful": ("dry", "complaint", "warning-to-others"),
        "for those with oily skin: dry and good": ("dry", "satisfied", "skin-ctx+pos"),
        "for those with dry skin": ("dry", "neutral", "skin-context"),
        "awful": (None, "complaint", "neg-only"),
        "the other cream dry, awful": ("dry", "complaint", "neg-only"),
        "so good": (None, "satisfied", "pos-only"),
        "other cream dry": ("dry", "neutral", "context-only"),
        "it is a cream": (None, "neutral", "no-aspect"),
        None: (None, "neutral", "no-aspect"),
        "": (None, "neutral", "no-aspect"),
        "not dry but this one is sticky and bad": ("sticky", "complaint", "contrast-tail-raw"),
        "it was dry but this one I love": ("dry", "satisfied", "contrast-tail-pos"),
        "no dry patches. also it is sticky, good": ("sticky", "satisfied", "mostly-negated+pos"),
        "it is sticky": ("sticky", "complaint", "aspect-raw"),
        "it is sticky and good": ("sticky", "complaint", "aspect-raw"),
        "awful smell": ("smell", "complaint", "neutral-aspect+neg"),
        "a good smell": ("smell", "satisfied", "neutral-aspect+pos"),
        "a smell": ("smell", "neutral", "neutral-aspect-only"),
        "never again, not dry": ("dry", "complaint", "aspect-negated+neg"),
        "without dryness": ("dry", "satisfied", "aspect-negated"),
        "dry it is not": ("dry", "satisfied", "aspect-negated"),
        "I wish it was good": (None, "neutral", "no-aspect"),
        "I wish, without and good": (None, "satisfied", "pos-only"),
        "never again": (None, "complaint", "neg-only"),
    }
    got = said(lambda c: X.judged(ENGLISH, c), list(cases))
    assert dict(zip(cases, got, strict=True)) == cases


def test_negation_is_near(said):
    far = "dry" + " so" * 8 + " not"
    assert said(lambda c: X.judged(ENGLISH, c), [far, "dry so not"]) == [("dry", "complaint", "aspect-raw"), ("dry", "satisfied", "aspect-negated")]
    assert said(lambda c: X.judged(X.PolarityRules("a", "b", X.NEVER, X.NEVER), c), ["a", "b", "ab"]) == [(None, "satisfied", "pos-only"), (None, "complaint", "neg-only"), (None, "neutral", "no-aspect")]


WISHES = X.WishRules(
    launch=r"please (?:release|make)|come out again|should come out", launched=r"(?:was|were) released", again=r"come out again", not_launch=r"come out to the show", less=r"\bless\s+", content=r"video|review", content_no_market=r"video", over_content=r"please release",
    channel=r"channel", asked=r"why is there no \w+", asked_not=r"where", demand=r"want to see a (?:video|review)", request=r"please(?: do| show)?\b", request_bad=r"\bthanks\b|click", request_object=r"video|review|tutorial", hope=r"\b(?:hope|wish)\b", not_hope=r"hope not",
)


def test_wish_classes(said):
    cases = {
        "please release a big size": ("a", "please release"),
        "it were released, please make it": ("n", ""),
        "it was released, it should come out again": ("a", "should come out"),
        "spots should come out to the show": ("n", ""),
        "less should come out": ("n", ""),
        "why is there no refill": ("a", "why is there no refill"),
        "where and why is there no refill": ("n", ""),
        "please release it, and a review": ("a", "please release"),
        "a video on your channel, please release": ("b", "please"),
        "want to see a video": ("b", "want to see a video"),
        "want to see a video, thanks": ("n", ""),
        "a tutorial please": ("b", "please"),
        "a tutorial that is a very long way before it, please": ("n", ""),
        "video click please. one more review please do": ("b", "please do"),
        "I hope so": ("c", "hope"),
        "I hope not": ("n", ""),
        "nothing": ("n", ""),
        None: ("n", ""),
    }
    got = said(lambda c: X.wish_class(WISHES, c), list(cases))
    assert dict(zip(cases, got, strict=True)) == cases


def test_surface_hits(spark):
    some = [
        X.Surface("라네즈", "laneige", "brand"), X.Surface("라네", "rane", "brand"), X.Surface("Dew", "dew", "brand", "near"), X.Surface("dew drop", "dewdrop", "format"), X.Surface("the", "the", "brand", "stop"), X.Surface("DEW", "second", "brand"), X.Surface("a.b", "ab", "brand"),
    ]
    texts = ["라네즈 크림", "라네 크림", "라네즈는", "the dew was cold", "DEW cream", "Dew " + "x" * 30 + " cream", "dew drop", "a.b axb", None, "", "dewy Dew cream"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    rows = df.select("i", F.explode(X.surface_hits(F.col("t"), some, "크림|cream")).alias("h")).collect()
    assert sorted((r.i, r.h.canonical, r.h.surface, r.h.start, r.h.near) for r in rows) == [
        (0, "laneige", "라네즈", 0, True), (1, "rane", "라네", 0, True), (4, "dew", "DEW", 0, True), (6, "dewdrop", "dew drop", 0, False), (7, "ab", "a.b", 0, False), (10, "dew", "Dew", 5, True),
    ]
    endings = df.select("i", F.explode(X.surface_hits(F.col("t"), some, "크림", right="(?=은|는|$|[^가-힣])")).alias("h")).where("i = 2").collect()
    assert [r.h.canonical for r in endings] == ["laneige"]
    assert df.select(F.size(X.surface_hits(F.col("t"), [], "x")).alias("n")).agg(F.max("n")).first()[0] == 0
