"""Queries of shops' answers: each builds the answers from the tables, so that SQL over the same tables tells what parsing must give."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import shops as P
from .base import Catalog

catalog = Catalog()
query = catalog.query
C = F.col


def payloads(rows, key, body):
    return rows.select(key.cast("string").alias("key"), F.lit("2024-05-01").cast("date").alias("at"), body.alias("body"))


def review_pages(t):
    """A page of reviews for each order: its line items; some lack an id, some a name, some entries are no objects."""
    one = F.struct(
        F.when(C("l_linenumber") != 5, F.concat_ws("-", "l_orderkey", "l_linenumber")).alias("reviewId"), F.when(C("l_quantity") % 7 != 0, C("l_quantity") % 5 + 1).alias("reviewScore"),
        F.concat(F.lit(' say "{'), C("l_returnflag"), F.lit('}" \\ ')).alias("content"), F.struct(F.when(C("l_suppkey") % 3 != 0, C("l_suppkey").cast("string")).alias("memberNickname")).alias("profileDto"),
        F.when(C("l_linestatus") == "F", F.date_format("l_shipdate", "yyyy.MM.dd")).otherwise("soon").alias("createdDateTime"),
    )
    listed = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.to_json(one))).alias("rows"))
    body = F.concat(F.lit('{"data": {"goodsReviewList": [17, "x", null, '), F.array_join("rows", ", "), F.lit("]}}"))
    return payloads(listed, C("l_orderkey"), F.when(C("l_orderkey") % 50 == 0, F.lit("<html>busy</html>")).otherwise(body))


_REVIEWS = """r AS (SELECT l_orderkey AS k, concat_ws('-', l_orderkey, l_linenumber) AS review_key, CASE WHEN l_quantity % 7 <> 0 THEN l_quantity % 5 + 1 END AS rating, concat('say "{', l_returnflag, '}" \\') AS body, CASE WHEN l_suppkey % 3 <> 0 THEN substr(sha256(CAST(l_suppkey AS VARCHAR)), 1, 16) END AS author_hash,
CASE WHEN l_linestatus = 'F' THEN strftime(l_shipdate, '%Y-%m-%d') END AS written_on, l_linenumber FROM lineitem WHERE l_orderkey % 50 <> 0)"""


@query("sc20_reviews", f"WITH {_REVIEWS} SELECT review_key, rating, body, author_hash, written_on FROM r WHERE l_linenumber <> 5")
def _(t):
    return P.reviews(review_pages(t)).select("review_key", "rating", "body", "author_hash", F.date_format("written_on", "yyyy-MM-dd").alias("written_on"))


@query("sc20_walk_ends", f"WITH {_REVIEWS} SELECT CAST(k AS VARCHAR) AS key, coalesce(bool_or(rating = 3), false) AS ends FROM r GROUP BY 1")
def _(t):
    return P.walk_ends(review_pages(t)).select("key", "ends")


@query("sc20_statistics", """SELECT kind, key, topic, name, grp, share, rank, count, average, five FROM (
SELECT 'stats' AS kind, CAST(o_custkey AS VARCHAR) AS key, CAST(NULL AS VARCHAR) AS topic, CAST(NULL AS VARCHAR) AS name, CAST(NULL AS VARCHAR) AS grp, CAST(NULL AS DOUBLE) AS share, CAST(NULL AS INT) AS rank, count(*) AS count, CAST(count(*) % 5 AS DOUBLE) AS average, CASE WHEN count(*) % 2 = 0 THEN CAST(count(*) AS DOUBLE) END AS five FROM orders GROUP BY o_custkey
UNION ALL SELECT 'topic', CAST(o_custkey AS VARCHAR), o_orderpriority, concat('p ', o_orderpriority), 'how', CAST(n AS DOUBLE), CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS INT), NULL, NULL, NULL FROM (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders WHERE o_orderpriority <> '5-LOW' GROUP BY 1, 2))""")
def _(t):
    of = t.orders.groupBy("o_custkey", "o_orderpriority").agg(F.count("*").alias("n"))
    answer = F.struct(F.when(C("o_orderpriority") != "5-LOW", C("o_orderpriority")).alias("answerCode"), F.concat(F.lit("p "), "o_orderpriority").alias("answerName"), C("n").alias("answerPercentage"))
    g = of.groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("o_orderpriority", F.to_json(answer).alias("a")))), lambda x: x["a"]).alias("answers"), F.sum("n").alias("n"))
    stars = F.concat(F.lit('[{"rating": 4, "percentage": 1}, 3'), F.when(C("n") % 2 == 0, F.concat(F.lit(', {"rating": 5, "percentage": '), "n", F.lit("}"))).otherwise(', {"rating": 5, "percentage": "much"}'), F.lit("]"))
    body = F.concat(F.lit('{"data": {"goodsNumber": "'), "o_custkey", F.lit('", "reviewCount": '), "n", F.lit(', "ratingDistribution": {"averageRating": '), C("n") % 5, F.lit(', "ratingStatDtos": '), stars, F.lit('}, "satisfactionStats": [{"questionName": "how", "answerDtos": ['), F.array_join("answers", ","), F.lit(']}, {"questionName": "why"}, 5]}}'))
    s = P.statistics(payloads(g, F.when(C("o_custkey") % 2 == 0, C("o_custkey")), body))
    return s.select("kind", "key", "topic", "name", "grp", "share", "rank", "count", "average", C("shares")[0].alias("five"))


@query("sc20_summaries", """SELECT 'stats' AS kind, CAST(p_partkey AS VARCHAR) AS key, CAST(NULL AS INT) AS rank, CAST(NULL AS VARCHAR) AS name, CAST(NULL AS VARCHAR) AS body, CAST(p_size AS DOUBLE) AS positive, CASE WHEN p_size % 2 = 0 THEN CAST(100 - p_size AS DOUBLE) END AS negative FROM part WHERE p_size % 5 <> 0 OR p_size % 2 = 0
UNION ALL SELECT 'summary', CAST(p_partkey AS VARCHAR), CAST(1 AS INT), p_name, p_type, NULL, NULL FROM part UNION ALL SELECT 'summary', CAST(p_partkey AS VARCHAR), CAST(3 AS INT), p_brand, NULL, NULL, NULL FROM part WHERE p_size > 10""".replace("CAST(p_size AS DOUBLE) AS positive", "CASE WHEN p_size % 5 <> 0 THEN CAST(p_size AS DOUBLE) END AS positive"))
def _(t):
    said = F.struct(
        F.when(C("p_size") % 5 != 0, C("p_size")).alias("positiveRatio"), F.when(C("p_size") % 2 == 0, 100 - C("p_size")).alias("negativeRatio"), C("p_name").alias("feature1Title"), C("p_type").alias("feature1Description"), F.lit("").alias("feature2Title"), F.lit("b").alias("feature2Description"),
        F.when(C("p_size") > 10, C("p_brand")).alias("feature3Title"), F.lit("").alias("feature3Description"), F.lit("no").alias("feature4Title"),
    )
    s = P.summaries(payloads(t.part, C("p_partkey"), F.to_json(F.struct(said.alias("data")))))
    return s.select("kind", "key", "rank", "name", "body", "positive", "negative")


@query("sc19_boards", """WITH b AS (SELECT n_nationkey, n_name, n_regionkey, s_suppkey, s_name, s_acctbal, row_number() OVER (PARTITION BY n_nationkey ORDER BY s_suppkey) AS rank FROM nation JOIN supplier ON n_nationkey = s_nationkey WHERE s_suppkey % 9 <> 4)
SELECT kind, CAST(n_nationkey AS VARCHAR) AS key, 'hot' AS board, CASE WHEN n_regionkey = 0 THEN 'hot' ELSE CAST(n_regionkey AS VARCHAR) END AS category, CAST(rank AS INT) AS rank, CAST(s_suppkey AS VARCHAR) AS product_key, CASE kind WHEN 'rank' THEN s_name WHEN 'topic' THEN 'moist' END AS name,
CASE WHEN kind IN ('rank', 'price') THEN s_acctbal END AS price, CASE WHEN kind = 'topic' THEN 't1' END AS topic, CASE WHEN kind = 'topic' THEN CAST(1 AS INT) END AS place FROM b, (VALUES ('rank'), ('price'), ('topic')) k(kind) WHERE kind <> 'topic' OR s_suppkey % 2 = 0""")
def _(t):
    topics = F.when(C("s_suppkey") % 2 == 0, '[{"review_topic": {"id": "t0", "name": ""}}, 4, {"review_topic": {"id": "t1", "name": "moist"}, "is_positive": true}]').otherwise("{}")
    row = F.concat(F.lit('{"product": {"id": '), F.when(C("s_suppkey") % 9 == 4, "null").otherwise(C("s_suppkey").cast("string")), F.lit(', "name": "'), "s_name", F.lit('", "price": 1, "product_topics": '), topics, F.lit('}, "goods": {"price": '), "s_acctbal", F.lit("}}"))
    g = t.nation.join(t.supplier, C("n_nationkey") == C("s_nationkey")).groupBy("n_nationkey", "n_regionkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", row.alias("r")))), lambda x: x["r"]), ", ").alias("rows"))
    theme = F.when(C("n_regionkey") == 0, "7").otherwise(F.concat(F.lit('{"data": {"id": "'), "n_regionkey", F.lit('", "name": "n"}}')))
    body = F.concat(F.lit('<html><script id="__NEXT_DATA__" type="application/json">{"props": {"pageProps": {"hotTheme": '), theme, F.lit(', "hotRows": {"data": ["x", '), "rows", F.lit("]}}}}</script>"))
    s = P.board_records(payloads(g, C("n_nationkey"), body), [("hot", "hotRows", "hotTheme"), ("none", "noRows", None)])
    return s.select("kind", "key", "board", "category", "rank", "product_key", "name", "price", "topic", "place")


def flights(t):
    """A page for each brand, with its parts as objects inside others, and with braces and quotes in their texts."""
    said = F.to_json(F.struct(
        F.concat(F.lit("r"), "p_partkey").alias("idreviewcomment"), F.concat(F.lit('so {good} "'), "p_type", F.lit('" \\')).alias("reviewText"), (C("p_size") % 5 + 1).alias("rating"),
        F.struct(C("p_partkey").cast("string").alias("idProduct"), F.array(C("p_size")).alias("productRank"), C("p_name").alias("productTitle"), F.struct(C("p_brand").alias("brandTitle")).alias("brand"), F.concat("p_size", F.lit(" {ml}")).alias("volume")).alias("product"),
    ))
    g = t.part.groupBy("p_brand").agg(F.array_join(F.array_sort(F.collect_list(said)), ",").alias("rows"))
    flight = F.concat(F.lit('7:{"a": "}{ idProduct", "list": ['), "rows", F.lit('], "open": {"idProduct": "never closed"'))
    escaped = F.replace(F.replace(flight, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    # in two pieces, cut between objects; through arrays of one, so that each text is made once
    once = lambda c, f: F.element_at(F.transform(F.array(c), f), 1)
    halves = lambda x, cut: F.concat(F.substring(x, F.lit(1), cut), F.lit('"])</script><script>self.__next_f.push([1,"'), F.substring(x, cut + 1, F.length(x)))
    two = once(escaped, lambda x: once(F.locate(r"},{\"idreviewcomment", x) + 1, lambda cut: F.when(cut > 1, halves(x, cut)).otherwise(x)))
    return payloads(g, C("p_brand"), F.concat(F.lit('<script>self.__next_f.push([1,"'), two, F.lit('"])</script>')))


@query("sc19_flight_products", "SELECT p_brand AS key, CAST(p_partkey AS VARCHAR) AS product_key, CAST(p_size AS INT) AS rank, p_name AS name, p_brand AS brand, concat(p_size, ' {ml}') AS volume FROM part")
def _(t):
    return P.flight_products(flights(t)).drop("at")


@query("sc19_flight_reviews", "SELECT p_brand AS key, concat('r', p_partkey) AS review_key, concat('so {good} \"', p_type, '\" \\') AS body, CAST(p_size % 5 + 1 AS DOUBLE) AS rating, CAST(p_partkey AS VARCHAR) AS product_key, p_name AS product_name FROM part")
def _(t):
    return P.flight_reviews(flights(t)).drop("at")
