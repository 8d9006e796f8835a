"""Metric families over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import metrics as M
from ..operators import trend as T
from ..operators import windows as W
from .base import Catalog

catalog = Catalog()
query = catalog.query
C = F.col

_MENTIONS = """m AS (SELECT o_orderpriority AS scope, l_returnflag AS need_key, CASE WHEN l_linestatus = 'O' THEN 'neg' ELSE 'pos' END AS polarity, l_discount AS strength,
 concat(l_orderkey, '/', l_linenumber) AS ref, strftime(l_shipdate, '%Y-%m') AS month, CAST(l_suppkey AS VARCHAR) AS product, l_quantity % 5 + 1 AS rating FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def mentions(t):
    o = t.orders.select(C("o_orderkey").alias("l_orderkey"), C("o_orderpriority").alias("scope"))
    return t.lineitem.join(o, "l_orderkey").select(
        "scope", C("l_returnflag").alias("need_key"), F.when(C("l_linestatus") == "O", "neg").otherwise("pos").alias("polarity"), C("l_discount").alias("strength"),
        F.concat_ws("/", C("l_orderkey").cast("string"), C("l_linenumber").cast("string")).alias("ref"), S.month_of(C("l_shipdate")).alias("month"), C("l_suppkey").cast("string").alias("product"), (C("l_quantity") % 5 + 1).alias("rating"),
    )


@query("flagship_need_month", f"""WITH {_MENTIONS}
SELECT scope, need_key, month, count(*) FILTER (WHERE polarity = 'neg') AS neg, count(*) FILTER (WHERE polarity = 'pos') AS pos, count(*) FILTER (WHERE polarity = 'neg') * 1.0 / count(*) AS unresolved FROM m GROUP BY 1, 2, 3""")
def flagship(t):
    m = mentions(t).groupBy("scope", "need_key", "month").agg(F.count_if(C("polarity") == "neg").alias("neg"), F.count_if(C("polarity") == "pos").alias("pos"))
    return m.withColumn("unresolved", S.ratio(C("neg"), C("neg") + C("pos")))


@query("ag10_need_grouping_sets", f"""WITH {_MENTIONS}
SELECT scope, need_key, coalesce(month, '') AS month, coalesce(product, '') AS product, count(*) FILTER (WHERE polarity = 'neg') AS neg, count(*) FILTER (WHERE polarity = 'pos') AS pos, avg(strength) FILTER (WHERE polarity = 'neg') AS strength_mean,
 count(DISTINCT ref) FILTER (WHERE polarity = 'neg') AS neg_refs, count(*) FILTER (WHERE polarity = 'neg' AND strength >= 0.06) AS strong, count(*) FILTER (WHERE polarity = 'neg') * 1.0 / count(*) AS unresolved,
 count(*) FILTER (WHERE polarity = 'neg' AND strength >= 0.06) * 1.0 / nullif(count(*) FILTER (WHERE polarity = 'neg'), 0) AS strong_share
FROM m GROUP BY GROUPING SETS ((scope, need_key), (scope, need_key, month), (scope, need_key, product))""")
def _(t):
    return M.need_metrics(mentions(t), [[], ["month"], ["product"]], ["month", "product"])


@query("ag2_nullable_population", f"""WITH {_MENTIONS}, p AS (SELECT scope, bool_or(rating > 5) AS any_high FROM m GROUP BY scope)
SELECT m.scope, need_key, CASE WHEN any_high THEN count(*) FILTER (WHERE polarity = 'neg') END AS neg FROM m JOIN p ON m.scope = p.scope GROUP BY m.scope, need_key, any_high""")
def _(t):
    m = mentions(t)
    p = m.groupBy("scope").agg(F.bool_or(C("rating") > 5).alias("any_high"))
    n = m.groupBy("scope", "need_key").agg(F.count_if(C("polarity") == "neg").alias("neg"))
    return n.join(F.broadcast(p), "scope").select("scope", "need_key", F.when(C("any_high"), C("neg")).alias("neg"))


@query("ag4_low_share", f"""WITH {_MENTIONS}, d AS (SELECT product, count(*) FILTER (WHERE rating <= 2) AS low, count(*) AS n, (count(*) FILTER (WHERE rating <= 2) < 150 OR bool_or(rating > 3)) AS complete FROM m GROUP BY product)
SELECT m.product, count(DISTINCT CASE WHEN rating <= 2 AND complete THEN ref END) AS low_mentions, max(low) AS low, max(n) AS n, round(100.0 * count(DISTINCT CASE WHEN rating <= 2 AND complete THEN ref END) / max(n), 4) AS pct FROM m JOIN d ON m.product = d.product GROUP BY m.product""")
def _(t):
    m = mentions(t)
    d = M.denominators(m, ["product"], "rating", 2, 150)
    low = F.count_distinct(F.when((C("rating") <= 2) & C("complete"), C("ref")))
    return m.join(d, "product").groupBy("product").agg(low.alias("low_mentions"), F.max("low").alias("low"), F.max("n").alias("n")).withColumn("pct", F.round(100.0 * C("low_mentions") / C("n"), 4))


@query("ag8_persistence", f"WITH {_MENTIONS} SELECT scope, need_key, count(DISTINCT month) FILTER (WHERE polarity = 'neg') AS months, count(DISTINCT product) FILTER (WHERE polarity = 'neg') AS products, count(DISTINCT month) AS months_total FROM m GROUP BY 1, 2")
def _(t):
    neg = C("polarity") == "neg"
    return mentions(t).groupBy("scope", "need_key").agg(F.count_distinct(F.when(neg, C("month"))).alias("months"), F.count_distinct(F.when(neg, C("product"))).alias("products"), F.count_distinct("month").alias("months_total"))


@query("ag9_consensus", "SELECT p_brand, CASE WHEN count(DISTINCT p_type) = 1 THEN max(p_type) END AS kind, CASE WHEN count(DISTINCT p_size) = 1 THEN max(p_size) END AS size FROM part GROUP BY 1")
def _(t):
    return t.part.groupBy("p_brand").agg(M.consensus("p_type").alias("kind"), M.consensus("p_size").alias("size"))


@query("ag11_rollup_synonyms", f"""WITH {_MENTIONS}, s AS (SELECT CASE need_key WHEN 'R' THEN 'A' ELSE need_key END AS need_key, scope, polarity FROM m)
SELECT scope, need_key, count(*) AS n FROM m GROUP BY 1, 2 UNION ALL SELECT 'all', need_key, count(*) FROM s GROUP BY 2""")
def _(t):
    m = mentions(t).select("scope", "need_key")
    canonical = t.spark.createDataFrame([("R", "A")], "need_key string, canonical string")
    folded = m.join(F.broadcast(canonical), "need_key", "left").select(F.lit("all").alias("scope"), F.coalesce("canonical", "need_key").alias("need_key"))
    return m.unionByName(folded).groupBy("scope", "need_key").agg(F.count("*").alias("n"))


@query("ag12_wish_cells", """
SELECT coalesce(p_type, '') AS format, coalesce(p_brand, '') AS brand, count(*) AS mentions, count(DISTINCT p_size) AS channels, CAST(sum(least(p_size, 30)) AS BIGINT) AS capped, max_by(p_partkey, (p_size, -p_partkey)) AS loudest
FROM part GROUP BY GROUPING SETS ((p_type), (p_brand), (p_type, p_brand))""")
def _(t):
    return t.spark.sql(
        "SELECT IF(grouping(p_type) = 1, '', p_type) AS format, IF(grouping(p_brand) = 1, '', p_brand) AS brand, count(*) AS mentions, count(DISTINCT p_size) AS channels, sum(least(p_size, 30)) AS capped, "
        "max_by(p_partkey, struct(p_size, -p_partkey)) AS loudest FROM {p} GROUP BY p_type, p_brand GROUPING SETS ((p_type), (p_brand), (p_type, p_brand))", p=t.part)  # fmt: skip


@query("ag13_reconciliation", """
SELECT p_brand, count(*) FILTER (WHERE p_type = 'PROMO') AS a, count(*) FILTER (WHERE p_size > 25) AS b, count(*) FILTER (WHERE p_type = 'PROMO' AND p_size > 25) AS both,
 count(*) FILTER (WHERE p_type = 'PROMO') + count(*) FILTER (WHERE p_size > 25) - count(*) FILTER (WHERE p_type = 'PROMO' AND p_size > 25) = count(*) FILTER (WHERE p_type = 'PROMO' OR p_size > 25) AS agrees FROM part GROUP BY 1""")
def _(t):
    a, b = C("p_type") == "PROMO", C("p_size") > 25
    g = t.part.groupBy("p_brand").agg(F.count_if(a).alias("a"), F.count_if(b).alias("b"), F.count_if(a & b).alias("both"), F.count_if(a | b).alias("either"))
    return g.select("p_brand", "a", "b", "both", (C("a") + C("b") - C("both") == C("either")).alias("agrees"))


@query("ag14_rank_daily", """
WITH e AS (SELECT event_type AS board, user_id, ts, strftime(ts + INTERVAL 9 HOUR, '%Y-%m-%d') AS day, CAST(json_extract(props, '$.k') AS BIGINT) AS rank, CAST(floor(value) AS BIGINT) AS price FROM events),
c AS (SELECT board, day, count(DISTINCT ts) AS captures FROM e GROUP BY 1, 2), m AS (SELECT board, user_id, day, price, count(*) AS n FROM e GROUP BY 1, 2, 3, 4), p AS (SELECT board, user_id, day, min_by(price, (-n, price)) AS price FROM m GROUP BY 1, 2, 3)
SELECT e.board, e.user_id, e.day, count(DISTINCT ts) AS seen, avg(rank) AS mean_rank, min(rank) AS best, max(rank) AS worst, any_value(p.price) AS price, any_value(captures) AS captures, count(DISTINCT ts) * 1.0 / any_value(captures) AS presence
FROM e JOIN c ON e.board = c.board AND e.day = c.day JOIN p ON p.board = e.board AND p.user_id = e.user_id AND p.day = e.day GROUP BY 1, 2, 3""")
def _(t):
    s = t.events.select(C("event_type").alias("board"), "user_id", "ts", F.get_json_object("props", "$.k").cast("long").alias("rank"), F.floor("value").alias("price"))
    return M.rank_daily(s, ["board"], "user_id", "ts", S.kst_day(C("ts")), "rank", "price")


@query("ag16_latest_category", "SELECT user_id, max_by(event_type, (ts, event_id)) AS latest FROM events WHERE event_type <> 'error' GROUP BY 1")
def _(t):
    return t.events.where("event_type <> 'error'").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("latest"))


@query("ag18_hits_per_ref", r"""
SELECT doc_id, word, count(*) AS hits FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents) WHERE word IN ('the', 'und', 'les', 'que') GROUP BY 1, 2""")
def _(t):
    w = t.documents.select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), 0)).alias("word"))
    return w.where(C("word").isin("the", "und", "les", "que")).groupBy("doc_id", "word").agg(F.count("*").alias("hits"))


_ORDERS = """o AS (SELECT o_orderpriority AS topic, concat(year(o_orderdate), 'Q', quarter(o_orderdate)) AS quarter, c_mktsegment AS channel, o_orderstatus AS status FROM orders JOIN customer ON o_custkey = c_custkey)"""


def quarter_rows(t):
    c = t.customer.select(C("c_custkey").alias("o_custkey"), C("c_mktsegment").alias("channel"))
    return t.orders.join(c, "o_custkey").select(C("o_orderpriority").alias("topic"), S.quarter_of(C("o_orderdate")).alias("quarter"), "channel", C("o_orderstatus").alias("status"))


@query("ag19_quarter_documents", f"WITH {_ORDERS} SELECT quarter, count(*) AS documents, count(DISTINCT channel) AS channels FROM o GROUP BY 1")
def _(t):
    return quarter_rows(t).groupBy("quarter").agg(F.count("*").alias("documents"), F.count_distinct("channel").alias("channels"))


@query("ag21_counted_raw", f"WITH {_ORDERS} SELECT topic, quarter, count(*) FILTER (WHERE status <> 'P') AS counted, count(*) AS raw FROM o GROUP BY 1, 2")
def _(t):
    return quarter_rows(t).groupBy("topic", "quarter").agg(F.count_if(C("status") != "P").alias("counted"), F.count("*").alias("raw"))


@query("ag24_entropy", f"""WITH {_ORDERS}, n AS (SELECT topic, quarter, channel, count(*) AS n FROM o GROUP BY 1, 2, 3), p AS (SELECT *, n * 1.0 / sum(n) OVER (PARTITION BY topic, quarter) AS p FROM n)
SELECT topic, quarter, CASE WHEN count(*) <= 1 THEN 0 ELSE sum(-p * ln(p)) / ln(count(*)) END AS entropy, count(*) AS parts FROM p GROUP BY 1, 2""")
def _(t):
    n = quarter_rows(t).groupBy("topic", "quarter", "channel").agg(F.count("*").alias("n"))
    return T.entropy(n, ["topic", "quarter"])


_TREND = _ORDERS + """, tt AS (SELECT DISTINCT topic FROM o), qq AS (SELECT DISTINCT quarter FROM o), n AS (SELECT topic, quarter, count(*) FILTER (WHERE status <> 'P') AS mentions, count(*) AS raw FROM o GROUP BY 1, 2),
g AS (SELECT topic, quarter, coalesce(mentions, 0) AS mentions, coalesce(raw, 0) AS raw FROM tt CROSS JOIN qq LEFT JOIN n USING (topic, quarter)),
c AS (SELECT *, coalesce(mentions * 1.0 / nullif(sum(mentions) OVER (PARTITION BY quarter), 0), 0) AS composition FROM g), b AS (SELECT topic, median(composition) AS baseline FROM c GROUP BY 1),
ch AS (SELECT topic, quarter, channel, count(*) AS n FROM o WHERE status <> 'P' GROUP BY 1, 2, 3), pr AS (SELECT *, n * 1.0 / sum(n) OVER (PARTITION BY topic, quarter) AS p FROM ch),
e AS (SELECT topic, quarter, CASE WHEN count(*) <= 1 THEN 0 ELSE sum(-p * ln(p)) / ln(count(*)) END AS entropy, count(*) AS parts FROM pr GROUP BY 1, 2), pn AS (SELECT quarter, count(DISTINCT channel) AS total FROM o GROUP BY 1),
q AS (SELECT topic, quarter, mentions, composition, baseline, CAST(sum(CASE WHEN composition > baseline THEN 1 ELSE 0 END) OVER w AS BIGINT) AS above, count(*) OVER w AS "window", coalesce(entropy, 0) AS entropy, coalesce(coalesce(parts, 0) * 1.0 / total, 0) AS breadth,
 0.5 * coalesce(coalesce(parts, 0) * 1.0 / total, 0) + 0.5 * coalesce(entropy, 0) AS diffusion, coalesce(mentions * 1.0 / nullif(raw, 0), 1) AS unique_ratio, coalesce(parts, 0) AS channels
 FROM c JOIN b USING (topic) LEFT JOIN e USING (topic, quarter) LEFT JOIN pn USING (quarter) WINDOW w AS (PARTITION BY topic ORDER BY quarter ROWS BETWEEN 3 PRECEDING AND CURRENT ROW))"""


def trend(t):
    o = quarter_rows(t)
    n = o.groupBy("topic", "quarter").agg(F.count_if(C("status") != "P").alias("mentions"), F.count("*").alias("raw"))
    grid = T.dense_grid(o.select("topic").distinct(), o.select("quarter").distinct(), n, ["topic", "quarter"], {"mentions": 0, "raw": 0})
    channels = o.where("status <> 'P'").groupBy("topic", "quarter", "channel").agg(F.count("*").alias("n"))
    return T.quarter_metrics(grid, o.groupBy("quarter").agg(F.count_distinct("channel").alias("channels_total")), channels)


@query("ag22_trend_quarter", f"WITH {_TREND} SELECT * FROM q")
def _(t):
    return trend(t)


@query("dc1_trend_verdicts", f"""WITH {_TREND}, s AS (SELECT *, (rank() OVER w - 1 + count(*) OVER (PARTITION BY quarter ORDER BY mentions RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) / 2.0 / count(*) OVER (PARTITION BY quarter) AS mid FROM q WINDOW w AS (PARTITION BY quarter ORDER BY mentions)),
v AS (SELECT *, round(43.75 * mid + 31.25 * least(1.0, breadth) + 25.0 * least(1.0, unique_ratio), 1) AS strength, lag(composition) OVER t AS prev, max(composition) OVER (PARTITION BY topic ORDER BY quarter ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS m3, max(composition) OVER (PARTITION BY topic) AS peak FROM s WINDOW t AS (PARTITION BY topic ORDER BY quarter))
SELECT topic, quarter, strength, CASE WHEN strength < 50 THEN 'thin' WHEN m3 < 0.01 THEN 'new' WHEN above = "window" AND "window" = 4 THEN 'persistent' WHEN (composition - prev) / nullif(prev, 0) >= 0.35 THEN 'rising' WHEN (composition - prev) / nullif(prev, 0) <= -0.35 THEN 'falling' WHEN composition = peak THEN 'peak' ELSE 'steady' END AS verdict FROM v""")
def _(t):
    return T.judged(trend(t)).select("topic", "quarter", "strength", "verdict")


@query("dc2_grid_violations", f"""WITH {_TREND} SELECT topic, count(*) AS cells FROM q GROUP BY topic HAVING count(*) <> (SELECT count(*) FROM qq) OR abs(min(composition)) > 1""")
def _(t):
    q = trend(t)
    expected = q.select("quarter").distinct().count()
    return q.groupBy("topic").agg(F.count("*").alias("cells"), F.min("composition").alias("low")).where((C("cells") != expected) | (F.abs("low") > 1)).select("topic", "cells")


@query("ag26_launch_interval", """
WITH a AS (SELECT l_partkey, l_returnflag AS axis, min(l_shipdate) AS lo, min(l_shipdate + INTERVAL 30 DAY) AS hi, count(*) AS n FROM lineitem GROUP BY 1, 2)
SELECT l_partkey, strftime(max(lo), '%Y-%m-%d') AS lower, strftime(min(hi), '%Y-%m-%d') AS upper, count(*) AS axes, CAST(sum(n) AS BIGINT) AS claims, min_by(axis, (hi, axis)) AS upper_axis FROM a GROUP BY 1""")
def _(t):
    claims = t.lineitem.select("l_partkey", C("l_returnflag").alias("axis"), C("l_shipdate").cast("date").alias("lo"), F.date_add(C("l_shipdate").cast("date"), 30).alias("hi"))
    i = M.launch_interval(claims, "l_partkey", "axis", "lo", "hi")
    return i.withColumns({"lower": F.date_format("lower", "yyyy-MM-dd"), "upper": F.date_format("upper", "yyyy-MM-dd")})


@query("dc3_launch_verdict", """
WITH a AS (SELECT l_partkey, l_returnflag AS axis, min(l_shipdate) AS lo, min(l_shipdate + INTERVAL 30 DAY) AS hi FROM lineitem GROUP BY 1, 2), i AS (SELECT l_partkey, CAST(max(lo) AS DATE) AS lo, CAST(min(hi) AS DATE) AS hi FROM a GROUP BY 1), r AS (SELECT DATE '1996-03-31' AS d)
SELECT l_partkey, CASE WHEN lo > hi THEN 'conflict' WHEN lo >= DATE '1995-12-31' THEN 'new' WHEN lo >= DATE '1995-09-30' THEN 'recent' WHEN hi < DATE '1995-03-31' THEN 'established' ELSE 'within_year' END AS verdict FROM i""")
def _(t):
    claims = t.lineitem.select("l_partkey", C("l_returnflag").alias("axis"), C("l_shipdate").cast("date").alias("lo"), F.date_add(C("l_shipdate").cast("date"), 30).alias("hi"))
    i = M.launch_interval(claims, "l_partkey", "axis", "lo", "hi")
    return i.select("l_partkey", M.launch_verdict(C("lower"), C("upper"), F.lit("1996-03-31").cast("date")).alias("verdict"))


@query("ag29_percentiles", "SELECT event_type, percentile_cont(0.9) WITHIN GROUP (ORDER BY value) AS p90, percentile_disc(0.5) WITHIN GROUP (ORDER BY value) AS p50 FROM events GROUP BY 1")
def _(t):
    return t.events.groupBy("event_type").agg(F.expr("percentile_cont(0.9) within group (order by value)").alias("p90"), F.expr("percentile_disc(0.5) within group (order by value)").alias("p50"))


@query("ag30_ordered_keys", "SELECT p_brand, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS kinds FROM part GROUP BY 1")
def _(t):
    return t.part.groupBy("p_brand").agg(F.array_join(F.array_sort(F.collect_set("p_type")), ",").alias("kinds"))


@query("ag32_route_rollup", "SELECT source, count(*) AS n, min(doc_id) AS first, max(doc_id) AS last FROM documents GROUP BY 1")
def _(t):
    return t.documents.groupBy("source").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))


@query("ag36_window_shares", f"""WITH {_ORDERS}, r AS (SELECT quarter, dense_rank() OVER (ORDER BY quarter DESC) AS k FROM (SELECT DISTINCT quarter FROM o)), x AS (SELECT topic, k FROM o JOIN r USING (quarter))
SELECT topic, round(100.0 * count(*) FILTER (WHERE k <= 4) / (SELECT count(*) FROM x WHERE k <= 4) - 100.0 * count(*) FILTER (WHERE k BETWEEN 5 AND 8) / (SELECT count(*) FROM x WHERE k BETWEEN 5 AND 8), 2) AS delta_pp FROM x GROUP BY 1""")
def _(t):
    o = quarter_rows(t)
    r = o.select("quarter").distinct().withColumn("k", F.dense_rank().over(Window.orderBy(C("quarter").desc())))
    g = o.join(F.broadcast(r), "quarter").groupBy("topic").agg(F.count_if(C("k") <= 4).alias("a"), F.count_if(C("k").between(5, 8)).alias("b"))
    every = Window.partitionBy()
    return g.select("topic", F.round(100.0 * C("a") / F.sum("a").over(every) - 100.0 * C("b") / F.sum("b").over(every), 2).alias("delta_pp"))


@query("ag37_backtest_cutoffs", f"""WITH {_ORDERS}, k AS (SELECT unnest(['1997Q4', '1998Q4', '1999Q4']) AS cutoff)
SELECT cutoff, topic, count(*) AS until, count(DISTINCT quarter) AS quarters FROM o JOIN k ON quarter <= cutoff GROUP BY 1, 2""")
def _(t):
    n = quarter_rows(t).groupBy("topic", "quarter").agg(F.count("*").alias("n"))
    cut = n.withColumn("cutoff", F.explode(F.array(F.lit("1997Q4"), F.lit("1998Q4"), F.lit("1999Q4")))).where("quarter <= cutoff")
    return cut.groupBy("cutoff", "topic").agg(F.sum("n").alias("until"), F.count("*").alias("quarters"))


@query("ag38_variant_flips", f"""WITH {_ORDERS}, v AS (SELECT topic, count(*) * 1.0 / (SELECT count(*) FROM o) AS base FROM o GROUP BY 1), w AS (SELECT topic, count(*) * 1.0 / (SELECT count(*) FROM o WHERE status <> 'P') AS kept FROM o WHERE status <> 'P' GROUP BY 1)
SELECT topic, round((kept - base) * 100, 3) AS diff_pp, (base >= 0.2) <> (kept >= 0.2) AS flipped FROM v JOIN w USING (topic)""")
def _(t):
    g = quarter_rows(t).groupBy("topic").agg(F.count("*").alias("all"), F.count_if(C("status") != "P").alias("kept"))
    s = g.select("topic", W.share("all", []).alias("base"), W.share("kept", []).alias("kept"))
    return s.select("topic", F.round((C("kept") - C("base")) * 100, 3).alias("diff_pp"), ((C("base") >= 0.2) != (C("kept") >= 0.2)).alias("flipped"))


@query("ag39_reaction_groups", "SELECT conv_id, md5(text) AS digest, count(*) AS documents, bool_or(role = 'assistant') AS any_assistant FROM conversations GROUP BY 1, 2")
def _(t):
    return t.conversations.groupBy("conv_id", F.md5(C("text").cast("binary")).alias("digest")).agg(F.count("*").alias("documents"), F.bool_or(C("role") == "assistant").alias("any_assistant"))


@query("ag41_source_shares", """WITH n AS (SELECT lang, source, count(*) AS n FROM documents GROUP BY 1, 2)
SELECT lang, source, n * 1.0 / sum(n) OVER (PARTITION BY lang) AS share, row_number() OVER (PARTITION BY lang ORDER BY n DESC, source) AS place FROM n""")
def _(t):
    n = t.documents.groupBy("lang", "source").agg(F.count("*").alias("n"))
    return n.select("lang", "source", W.share("n", ["lang"]).alias("share"), F.row_number().over(Window.partitionBy("lang").orderBy(C("n").desc(), "source")).cast("long").alias("place"))


@query("ag42_positive_rate", """
WITH n AS (SELECT user_id, event_type, arg_max({'v': value, 'p': event_type IN ('purchase', 'view')}, (ts, value)) AS r FROM events GROUP BY 1, 2)
SELECT user_id, sum(CASE WHEN r.p THEN r.v ELSE 0 END) / sum(r.v) AS positive_rate FROM n GROUP BY 1""")
def _(t):
    return M.positive_rate(t.events, "user_id", "event_type", "ts", "value", C("event_type").isin("purchase", "view"))


@query("ag44_standardised_rate", """
WITH a AS (SELECT o_orderpriority AS s, count(*) FILTER (WHERE o_totalprice > 250000) AS h, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), b AS (SELECT o_orderpriority AS s, count(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY 1)
SELECT sum(b.n * 1.0 / (SELECT sum(n) FROM b) * a.h / a.n) AS rate FROM a JOIN b USING (s)""")
def _(t):
    def arm(status):
        return t.orders.where(C("o_orderstatus") == status).groupBy(C("o_orderpriority").alias("s")).agg(F.count_if(C("o_totalprice") > 250000).alias("h"), F.count("*").alias("n"))

    return M.standardised(arm("F"), arm("O"), "s", "h", "n")


@query("ag45_term_lift", r"""
WITH w AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS token, lang = 'fr' AS topical FROM documents), s AS (SELECT count(DISTINCT doc_id) FILTER (WHERE topical) AS t, count(DISTINCT doc_id) FILTER (WHERE NOT topical) AS c FROM w),
d AS (SELECT token, count(*) FILTER (WHERE topical) AS df, count(*) FILTER (WHERE NOT topical) AS control FROM w GROUP BY 1)
SELECT token, df, control, (df * 1.0 / t) / (greatest(control, 1) * 1.0 / c) AS lift FROM d, s WHERE df >= 5 AND (df * 1.0 / t) / (greatest(control, 1) * 1.0 / c) >= 2""")
def _(t):
    w = t.documents.select("doc_id", (C("lang") == "fr").alias("topical"), F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), 0))).alias("token"))
    return M.lift(w, "doc_id", "token", "topical", 5, 2.0)


@query("ag47_confusion", """
WITH p AS (SELECT quality AS gold, CASE WHEN contains(text, '!!') OR contains(text, '|') THEN 0 ELSE 1 END AS pred FROM labels JOIN documents USING (doc_id)), l AS (SELECT unnest([0, 1]) AS label)
SELECT label, count(*) FILTER (WHERE gold = label) AS support, count(*) FILTER (WHERE pred = label) AS predicted, count(*) FILTER (WHERE gold = label AND pred = label) AS hit,
 count(*) FILTER (WHERE gold = label AND pred = label) * 1.0 / nullif(count(*) FILTER (WHERE pred = label), 0) AS "precision", count(*) FILTER (WHERE gold = label AND pred = label) * 1.0 / nullif(count(*) FILTER (WHERE gold = label), 0) AS recall FROM p, l GROUP BY 1""")
def _(t):
    p = t.labels.join(t.documents, "doc_id").select(C("quality").alias("gold"), F.when(C("text").contains("!!") | C("text").contains("|"), 0).otherwise(1).alias("pred"))
    return M.confusion(p, "gold", "pred")


@query("ag49_axis_slack", """
WITH a AS (SELECT l_partkey, min(l_shipdate) AS lo FROM lineitem GROUP BY 1), k AS (SELECT l_partkey, l_returnflag AS axis, date_diff('day', lo, l_shipdate) AS slack FROM lineitem JOIN a USING (l_partkey))
SELECT axis, median(slack) AS slack, count(*) FILTER (WHERE slack <= 90) * 1.0 / count(*) AS hit_rate, count(DISTINCT l_partkey) AS products FROM k GROUP BY 1""")
def _(t):
    a = t.lineitem.groupBy("l_partkey").agg(F.min("l_shipdate").alias("lo"))
    k = t.lineitem.join(a, "l_partkey").select("l_partkey", C("l_returnflag").alias("axis"), F.datediff("l_shipdate", "lo").alias("slack"))
    return k.groupBy("axis").agg(F.median("slack").alias("slack"), S.ratio(F.count_if(C("slack") <= 90), F.count("*")).alias("hit_rate"), F.count_distinct("l_partkey").alias("products"))


@query("ag50_quota", "SELECT event_type, CAST(sum(CASE WHEN value > 20 THEN CAST(floor(value) AS BIGINT) ELSE 0 END) AS BIGINT) + CAST(ceil(count(*) FILTER (WHERE value <= 20) / 50.0) AS BIGINT) AS spent FROM events GROUP BY 1")
def _(t):
    known = F.sum(F.when(C("value") > 20, F.floor("value")).otherwise(0))
    return t.events.groupBy("event_type").agg((known + F.ceil(F.count_if(C("value") <= 20) / 50)).alias("spent"))


@query("ag52_generic_tokens", "SELECT token, count(DISTINCT p_brand) AS brands FROM (SELECT p_brand, unnest(string_split(p_name, ' ')) AS token FROM part) GROUP BY 1 HAVING count(DISTINCT p_brand) >= 3")
def _(t):
    return t.part.select("p_brand", F.explode(F.split("p_name", " ")).alias("token")).groupBy("token").agg(F.count_distinct("p_brand").alias("brands")).where("brands >= 3")


@query("ag53_corroboration", "SELECT user_id, count(DISTINCT (event_type, CAST(ts AS DATE))) AS pairs, count(DISTINCT CAST(ts AS DATE)) AS days, bool_or(value > 200) AS loud, least(count(*), 3) AS capped FROM events GROUP BY 1")
def _(t):
    day = F.to_date("ts")
    return t.events.groupBy("user_id").agg(F.count_distinct(F.struct("event_type", day)).alias("pairs"), F.count_distinct(day).alias("days"), F.bool_or(C("value") > 200).alias("loud"), F.least(F.count("*"), F.lit(3)).alias("capped"))


@query("ag54_rising_needs", """
WITH n AS (SELECT event_type AS need, day(ts) > 15 AS late, count(*) AS n FROM events GROUP BY 1, 2), s AS (SELECT need, late, n, n * 1.0 / sum(n) OVER (PARTITION BY late) AS share FROM n)
SELECT a.need, round(a.share - b.share, 6) AS delta FROM s a JOIN s b ON a.need = b.need AND a.late AND NOT b.late WHERE a.n >= 20 AND a.share > b.share""")
def _(t):
    n = t.events.groupBy(C("event_type").alias("need"), (F.dayofmonth("ts") > 15).alias("late")).agg(F.count("*").alias("n"))
    s = n.withColumn("share", W.share("n", ["late"]))
    g = s.groupBy("need").agg(F.max(F.when(C("late"), C("share"))).alias("a"), F.max(F.when(~C("late"), C("share"))).alias("b"), F.max(F.when(C("late"), C("n"))).alias("n"))
    return g.where("n >= 20 and a > b").select("need", F.round(C("a") - C("b"), 6).alias("delta"))


@query("ag55_top_dimension", "SELECT p_brand, CAST(sum(p_size) AS BIGINT) AS total FROM part WHERE p_brand <> '' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def _(t):
    return t.part.where("p_brand <> ''").groupBy("p_brand").agg(F.sum("p_size").alias("total")).orderBy(C("total").desc(), "p_brand").limit(5)


@query("dc19_freshness", """
WITH l AS (SELECT user_id, max(ts) AS last FROM events GROUP BY 1) SELECT user_id, CASE WHEN last IS NULL THEN 'never' WHEN TIMESTAMP '2024-01-31' - last > INTERVAL 2 DAY THEN 'stalled' WHEN TIMESTAMP '2024-01-31' - last > INTERVAL 1 DAY THEN 'late' ELSE 'ok' END AS state FROM l""")
def _(t):
    age = F.lit("2024-01-31").cast("timestamp_ntz") - C("last")
    return t.events.groupBy("user_id").agg(F.max("ts").alias("last")).select("user_id", F.when(C("last").isNull(), "never").when(age > F.expr("INTERVAL 2 DAYS"), "stalled").when(age > F.expr("INTERVAL 1 DAY"), "late").otherwise("ok").alias("state"))


@query("dc21_request_batches", "WITH p AS (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS pos, (5 - (SELECT count(*) FROM part) % 5) % 5 AS pad FROM part) SELECT p_partkey, (pos + pad) // 5 AS batch FROM p")
def _(t):
    n = t.part.count()
    pos = F.row_number().over(Window.orderBy("p_partkey")) - 1
    return t.part.select("p_partkey", F.floor((pos + (5 - n % 5) % 5) / 5).alias("batch"))


@query("v5_contract_violations", """
SELECT conv_id, 'ordinals' AS kind FROM conversations GROUP BY conv_id HAVING min(turn) <> 0 OR max(turn) <> count(*) - 1 OR count(DISTINCT turn) <> count(*)
UNION ALL SELECT conv_id, 'long' FROM conversations GROUP BY conv_id HAVING max(length(text)) > 800""")
def _(t):
    g = t.conversations.groupBy("conv_id").agg(F.min("turn").alias("a"), F.max("turn").alias("b"), F.count("*").alias("n"), F.count_distinct("turn").alias("d"), F.max(F.length("text")).alias("m"))
    kinds = F.array_compact(F.array(F.when((C("a") != 0) | (C("b") != C("n") - 1) | (C("d") != C("n")), "ordinals"), F.when(C("m") > 800, "long")))
    return g.select("conv_id", F.explode(kinds).alias("kind"))


@query("st10_hour_health", """
SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS errors, round(percentile_cont(0.9) WITHIN GROUP (ORDER BY value), 4) AS p90 FROM events GROUP BY 1""")
def _(t):
    return t.events.groupBy(F.date_format(F.date_trunc("hour", "ts"), "yyyy-MM-dd HH").alias("hour")).agg(F.count("*").alias("n"), F.count_if(C("event_type") == "error").alias("errors"), F.round(F.expr("percentile_cont(0.9) within group (order by value)"), 4).alias("p90"))


@query("tk3_best_per_type", "SELECT p_type, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice DESC, p_partkey) AS n FROM part) WHERE n = 1")
def _(t):
    return W.first_by(t.part, ["p_type"], C("p_retailprice").desc(), C("p_partkey")).select("p_type", "p_partkey")
