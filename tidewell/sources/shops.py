"""What shops answer, as rows: boards in page properties, flight payloads, reviews, statistics, surveys and summaries.

Payloads are parsed once to VARIANT, whose paths give null where an answer has another shape, so one odd entry costs one
row. An answer with several outputs gives one table with a ``kind``, of one parse and one explode; ``of_kind`` takes a part.
Payload tables are (key, at, body): what was asked for, when, and the text of the answer; an unreadable body gives no row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The script that holds a page's properties, a piece of a flight payload, characters of a piece of a text, features of a summary.
PROPERTIES = r'(?s)<script id="__NEXT_DATA__"[^>]*>(.*?)</script>'
FLIGHT = r'(?s)self\.__next_f\.push\(\[1,"((?:[^"\\]|\\.)*+)"\]\)'
PIECE = 4096
FEATURES = 3


def at_path(v: Column | str, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, path, kind)


def elements(v: Column | str, path: str) -> Column:
    """The elements of an array at a path; none where there is none."""
    return F.coalesce(at_path(v, path, "array<variant>"), F.array().cast("array<variant>"))


def number(v: Column, path: str) -> Column:
    """A number at a path: texts and truth values are none."""
    return F.when(F.schema_of_variant(at_path(v, path, "variant")).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), at_path(v, path, "double"))


def filled(c: Column) -> Column:
    """Null for an empty text."""
    return F.nullif(c, F.lit(""))


def parsed(payloads: DataFrame) -> DataFrame:
    """(key, at, v): readable bodies alone."""
    return payloads.select("key", "at", F.try_parse_json("body").alias("v")).where("v is not null")


def of_kind(records: DataFrame, kind: str, *columns: str) -> DataFrame:
    return records.where(F.col("kind") == kind).select("key", "at", *columns)


# --- reviews, statistics, surveys, summaries ----------------------------------------------------------------------


def reviews(payloads: DataFrame) -> DataFrame:
    """(key, at, review_key, rating, body, author_hash, written_on) of pages of reviews. A review without an id is none; an author is kept as a hash."""
    r = parsed(payloads).select("key", "at", F.explode(elements("v", "$.data.goodsReviewList")).alias("r")).where("key is not null")
    name = filled(at_path("r", "$.profileDto.memberNickname"))
    return r.select(
        "key", "at", at_path("r", "$.reviewId").alias("review_key"), number(F.col("r"), "$.reviewScore").alias("rating"), F.trim(at_path("r", "$.content")).alias("body"), F.left(F.sha2(name, 256), F.lit(16)).alias("author_hash"),
        F.to_date(F.try_to_timestamp(F.left(at_path("r", "$.createdDateTime"), F.lit(10)), F.lit("yyyy.MM.dd"))).alias("written_on"),
    ).where("review_key is not null")


def walk_ends(payloads: DataFrame, stop_at: float = 3.0) -> DataFrame:
    """(key, at, ends): whether a page of reviews, in the order of rising ratings, has come to the rating at which a walk stops."""
    ratings = F.transform(elements("v", "$.data.goodsReviewList"), lambda r: number(r, "$.reviewScore"))
    return parsed(payloads).select("key", "at", F.exists(ratings, lambda x: F.coalesce(x == stop_at, F.lit(False))).alias("ends"))


def _record(kind: str, **fields: Column) -> Column:
    """One row of several outputs: the fields that the output has, null for all others."""
    kinds = {"name": "string", "topic": "string", "grp": "string", "body": "string", "rank": "int", "share": "double", "count": "bigint", "average": "double", "shares": "array<double>", "positive": "double", "negative": "double"}
    return F.struct(F.lit(kind).alias("kind"), *[fields.get(n, F.lit(None)).cast(t).alias(n) for n, t in kinds.items()])


def statistics(payloads: DataFrame) -> DataFrame:
    """Records ``stats`` (count, average, shares of 5 to 1 stars) and ``topic`` (topic, name, grp, share, rank) of a product's statistics.

    A survey's answers are ranked from 1 within their question; those without a code or a name are not counted. The
    product is what was asked for, else what the answer names.
    """
    v = parsed(payloads).select(F.coalesce("key", at_path("v", "$.data.goodsNumber")).alias("key"), "at", at_path("v", "$.data", "variant").alias("d")).where("key is not null and d is not null")
    stars = F.transform(elements("d", "$.ratingDistribution.ratingStatDtos"), lambda s: F.struct(number(s, "$.rating").alias("rating"), number(s, "$.percentage").alias("share")))
    share = lambda n: F.try_element_at(F.filter(stars, lambda s: s["rating"] == n), F.lit(-1))["share"]
    own = _record("stats", count=at_path("d", "$.reviewCount", "bigint"), average=number(F.col("d"), "$.ratingDistribution.averageRating"), shares=F.array(*[share(n) for n in (5, 4, 3, 2, 1)]))

    def answers(q: Column) -> Column:
        known = F.filter(elements(q, "$.answerDtos"), lambda a: filled(at_path(a, "$.answerCode")).isNotNull() & filled(at_path(a, "$.answerName")).isNotNull())
        return F.transform(known, lambda a, i: _record("topic", topic=at_path(a, "$.answerCode"), name=at_path(a, "$.answerName"), grp=filled(at_path(q, "$.questionName")), share=number(a, "$.answerPercentage"), rank=i + 1))

    topics = F.flatten(F.transform(elements("d", "$.satisfactionStats"), answers))
    return v.select("key", "at", F.explode(F.concat(F.array(own), topics)).alias("r")).select("key", "at", "r.*")


def summaries(payloads: DataFrame, features: int = FEATURES) -> DataFrame:
    """Records ``stats`` (positive, negative) where either is said, and ``summary`` (rank, name, body) of the features that have a title."""
    v = parsed(payloads).select("key", "at", at_path("v", "$.data", "variant").alias("d")).where("key is not null and d is not null")
    d = F.col("d")
    plus, minus = number(d, "$.positiveRatio"), number(d, "$.negativeRatio")
    rows = [F.when(plus.isNotNull() | minus.isNotNull(), _record("stats", positive=plus, negative=minus))]
    for n in range(1, features + 1):
        title = filled(at_path(d, f"$.feature{n}Title"))
        rows.append(F.when(title.isNotNull(), _record("summary", rank=F.lit(n), name=title, body=filled(at_path(d, f"$.feature{n}Description")))))
    return v.select("key", "at", F.explode(F.array_compact(F.array(*rows))).alias("r")).select("key", "at", "r.*")


# --- boards in page properties ------------------------------------------------------------------------------------


def board_records(pages: DataFrame, boards: Sequence[tuple[str, str, str | None]]) -> DataFrame:
    """(key, at, board, category, category_name, rank, product_key and the fields of kinds ``rank``, ``price`` and ``topic``).

    ``pages`` have the HTML in ``body``; ``boards`` are (board, property with its rows, property with its theme or null). Ranks
    count the rows that name a product, by its ``product.id``. A board without a theme of its own goes by ``trendingThemeId``.
    """
    v = pages.select("key", "at", at_path(F.try_parse_json(filled(F.regexp_extract("body", PROPERTIES, 1))), "$.props.pageProps", "variant").alias("p")).where("p is not null")

    def board(name: str, rows: str, theme: str | None) -> Column:
        if theme is None:
            category, said = F.coalesce(filled(at_path("p", "$.trendingThemeId")), F.lit(name)), F.lit(None).cast("string")
        else:
            category = F.coalesce(filled(at_path("p", f"$.{theme}.data.id")), filled(at_path("p", f"$.{theme}.id")), F.lit(name))
            said = F.coalesce(at_path("p", f"$.{theme}.data.name"), at_path("p", f"$.{theme}.name"))
        known = F.filter(elements("p", f"$.{rows}.data"), lambda r: at_path(r, "$.product.id").isNotNull())
        return F.transform(known, lambda r, i: F.struct(F.lit(name).alias("board"), category.alias("category"), said.alias("category_name"), (i + 1).alias("rank"), r.alias("row")))

    found = v.select("key", "at", F.explode(F.concat(*[board(*b) for b in boards])).alias("b")).select("key", "at", "b.*")
    row = F.col("row")
    product, price = at_path(row, "$.product.id"), F.coalesce(number(row, "$.goods.price"), F.when(at_path(row, "$.goods", "variant").isNull(), number(row, "$.product.price")))
    kinds = "struct<kind:string,name:string,brand:string,volume:string,price:double,discount:double,reviews:bigint,rating:double,moved:bigint,fresh:boolean,topic:string,sentence:string,positive:boolean,score:double,place:int>"

    def record(kind: str, **fields: Column) -> Column:
        names = [x.partition(":")[0] for x in kinds[7:-1].split(",")]
        return F.struct(*[(F.lit(kind) if n == "kind" else fields.get(n, F.lit(None))).alias(n) for n in names]).cast(kinds)

    ranked = record(
        "rank", name=F.coalesce(at_path(row, "$.product.name"), F.lit("")), brand=at_path(row, "$.brand.name"), volume=filled(at_path(row, "$.product.package_info")), price=price, discount=number(row, "$.goods.discount_rate"),
        reviews=at_path(row, "$.product.review_count", "bigint"), rating=number(row, "$.product.review_rating"), moved=at_path(row, "$.rank_delta", "bigint"), fresh=at_path(row, "$.is_rank_new", "boolean"),
    )
    priced = F.when(price.isNotNull(), record("price", price=price, discount=number(row, "$.goods.discount_rate")))
    topics = F.filter(elements(row, "$.product.product_topics"), lambda t: at_path(t, "$.review_topic.id").isNotNull() & filled(at_path(t, "$.review_topic.name")).isNotNull())
    of_topic = F.transform(topics, lambda t, i: record(
        "topic", topic=at_path(t, "$.review_topic.id"), name=at_path(t, "$.review_topic.name"), sentence=filled(at_path(t, "$.review_topic.sentence")), positive=at_path(t, "$.is_positive", "boolean"), score=number(t, "$.score"),
        reviews=at_path(t, "$.review_count", "bigint"), place=i + 1,
    ))
    return found.select("key", "at", "board", "category", "category_name", "rank", product.alias("product_key"), F.explode(F.concat(F.array_compact(F.array(ranked, priced)), of_topic)).alias("r")).select("key", "at", "board", "category", "category_name", "rank", "product_key", "r.*")


# --- flight payloads ----------------------------------------------------------------------------------------------


def flight_text(html: Column) -> Column:
    """The pieces of a page's flight payload, unescaped and put together; empty without any."""
    pieces = F.regexp_extract_all(html, F.lit(FLIGHT), 1)
    # a piece may be longer than the 20 million characters that the parser takes by itself
    said = F.transform(pieces, lambda p: F.try_element_at(F.from_json(F.concat(F.lit('["'), p, F.lit('"]')), "array<string>", {"maxStringLen": str(2**31 - 1)}), F.lit(1)))
    return F.coalesce(F.array_join(F.array_compact(said), ""), F.lit(""))


def objects_with(rows: DataFrame, key: str, text: str, marker: str) -> DataFrame:
    """(key, start, object): the innermost objects in a text that have a key ``marker`` of their own, by balanced braces.

    Braces inside strings don't count: escapes are blotted out, and a token is all up to the next brace or marker outside
    other strings. At each depth the opening and closing braces of a row alternate, so one running count per (row, depth)
    pairs them. Objects whose brace is never closed are none. Texts are cut into pieces, and an object is put together
    of its own, so that no row carries a whole text for each object. ``key`` is unique.
    """
    quiet = rf'(?:[^"{{}}]++|"(?!\Q{marker}\E")[^"]*+")'
    tokens = F.regexp_extract_all(F.regexp_replace(text, r"(?s)\\.", "__"), F.lit(rf'{quiet}*+(?:[{{}}]|"\Q{marker}\E")|{quiet}++|"'), 0)
    from pyspark.sql import Window

    kind = F.when(F.col("token").endswith("{"), 1).when(F.col("token").endswith("}"), -1).when(F.col("token").endswith(f'"{marker}"'), 0)
    t = rows.select(key, F.posexplode(tokens).alias("i", "token")).select(key, "i", kind.alias("kind"), F.length("token").cast("long").alias("size"))
    along = Window.partitionBy(key).orderBy("i")
    placed = t.select(key, "i", "kind", F.sum(F.coalesce("kind", F.lit(0))).over(along).alias("depth"), (F.sum("size").over(along) - 1).alias("at"))
    some = placed.where("kind is not null").withColumn("level", F.col("depth") + F.when(F.col("kind") == -1, 1).otherwise(0))
    turn = F.count_if(F.col("kind") == 1).over(Window.partitionBy(key, "level").orderBy("i"))
    whole = some.withColumn("turn", turn).where("turn > 0 and level > 0").groupBy(key, "level", "turn").agg(
        F.min(F.when(F.col("kind") == 1, F.col("at"))).alias("start"), F.min(F.when(F.col("kind") == -1, F.col("at"))).alias("stop"), F.bool_or(F.col("kind") == 0).alias("has"),
    )
    pieces = rows.select(key, F.posexplode(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), 0)).alias("piece", "said"))
    first, last = (F.floor(F.col(c) / PIECE).cast("int") for c in ("start", "stop"))
    spans = whole.where("has and stop is not null").select(key, "start", "stop", F.explode(F.sequence(first, last)).alias("piece"))
    begin, end = F.greatest(F.col("start") - F.col("piece") * PIECE, F.lit(0)), F.least(F.col("stop") + 1 - F.col("piece") * PIECE, F.lit(PIECE))
    cut = spans.join(pieces, [key, "piece"]).select(key, "start", "piece", F.substring(F.col("said"), (begin + 1).cast("int"), (end - begin).cast("int")).alias("said"))
    return cut.groupBy(key, "start").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", "said"))), lambda x: x["said"]), "").alias("object"))


def flight_products(pages: DataFrame) -> DataFrame:
    """(key, at, product_key, rank, name, brand, volume) of the products in a page's flight payload; ``key`` is unique. Ranks may be wrapped in an array."""
    f = pages.select("key", flight_text(F.col("body")).alias("flight"))
    o = objects_with(f, "key", "flight", "idProduct").select("key", F.try_parse_json("object").alias("o")).where("o is not null").join(pages.select("key", "at"), "key")
    rank = F.coalesce(at_path("o", "$.productRank", "int"), at_path("o", "$.productRank[0]", "int"))
    out = o.select("key", "at", filled(at_path("o", "$.idProduct")).alias("product_key"), rank.alias("rank"), filled(at_path("o", "$.productTitle")).alias("name"), at_path("o", "$.brand.brandTitle").alias("brand"), filled(at_path("o", "$.volume")).alias("volume"))
    return out.where("product_key is not null and rank is not null and name is not null")


def flight_reviews(pages: DataFrame) -> DataFrame:
    """(key, at, review_key, body, rating, product_key, product_name): the feed of recent reviews in a flight payload, with the product that each has inside."""
    f = pages.select("key", flight_text(F.col("body")).alias("flight"))
    o = objects_with(f, "key", "flight", "idreviewcomment").select("key", F.try_parse_json("object").alias("o")).where("o is not null").join(pages.select("key", "at"), "key")
    out = o.select("key", "at", filled(at_path("o", "$.idreviewcomment")).alias("review_key"), filled(at_path("o", "$.reviewText")).alias("body"), number(F.col("o"), "$.rating").alias("rating"), at_path("o", "$.product.idProduct").alias("product_key"), at_path("o", "$.product.productTitle").alias("product_name"))
    return out.where("review_key is not null and body is not null")


# --- search trends ------------------------------------------------------------------------------------------------


def _points(series: Column) -> Column:
    """(month, ratio) of a series' data: periods of seven characters or more, ratios that are numbers."""
    some = F.filter(elements(series, "$.data"), lambda p: (F.schema_of_variant(at_path(p, "$.period", "variant")) == "STRING") & (F.length(at_path(p, "$.period")) >= 7))
    return F.transform(some, lambda p: F.struct(F.left(at_path(p, "$.period"), F.lit(7)).alias("month"), number(p, "$.ratio").alias("ratio")))


def trend_points(payloads: DataFrame) -> DataFrame:
    """(key, at, series, terms, month, ratio) of answers whose series name themselves; one without a name is none."""
    s = parsed(payloads).select("key", "at", F.explode(elements("v", "$.results")).alias("s"))
    named = s.where(F.schema_of_variant(at_path("s", "$.title", "variant")) == "STRING").withColumn("series", filled(at_path("s", "$.title"))).where("series is not null")
    terms = F.transform(elements("s", "$.keywords"), lambda t: at_path(t, "$"))
    return named.select("key", "at", "series", terms.alias("terms"), F.explode(_points(F.col("s"))).alias("p")).select("key", "at", "series", "terms", "p.*")


def positional_points(payloads: DataFrame, terms: str = "terms") -> DataFrame:
    """(key, at, series, month, ratio) of answers whose series are those of the request's ``terms``, by position; more series than terms are cut off, entries that are no objects keep their place."""
    s = payloads.select("key", "at", terms, F.try_parse_json("body").alias("v")).where("v is not null").select("key", "at", terms, F.posexplode(elements("v", "$.results")).alias("i", "s"))
    return s.where(F.col("i") < F.size(terms)).select("key", "at", F.col(terms)[F.col("i")].alias("series"), F.explode(_points(F.col("s"))).alias("p")).select("key", "at", "series", "p.*")
