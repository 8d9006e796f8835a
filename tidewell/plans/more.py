"""Further operators of the inventory: decisions, invariants, incremental steps, lookups and plug-ins."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import registry as U
from ..functions import scalars as S
from ..operators import metrics as M
from ..operators import trend as T
from ..operators import text as X
from ..operators import windows as W
from .base import Catalog
from .metrics import _ORDERS, _TREND, quarter_rows, trend

catalog = Catalog()
query = catalog.query
C = F.col


@query("sc6_active_singleton", "SELECT p_type, max(p_size) AS version FROM part GROUP BY 1 HAVING count(DISTINCT p_type) = 1")
def _(t):
    g = t.part.groupBy("p_type").agg(F.max("p_size").alias("version"), F.count_distinct("p_type").alias("n"))
    return g.select("p_type", F.when(C("n") == 1, C("version")).otherwise(F.raise_error(F.lit("more than one active"))).cast("int").alias("version"))


@query("sc7_run_identity", "SELECT note, min(o_orderkey) AS run_id, substr(sha256(note), 1, 12) AS stamp FROM (SELECT concat(o_orderpriority, '/', o_orderstatus) AS note, o_orderkey FROM orders) GROUP BY 1")
def _(t):
    o = t.orders.select(F.concat_ws("/", "o_orderpriority", "o_orderstatus").alias("note"), "o_orderkey")
    return o.groupBy("note").agg(F.min("o_orderkey").alias("run_id")).withColumn("stamp", F.substring(F.sha2(C("note"), 256), 1, 12))


@query("sc13_identity_check", "SELECT doc_id FROM documents WHERE length(text) <> n_chars OR source IS NULL OR source NOT IN (SELECT source FROM documents WHERE source IS NOT NULL GROUP BY 1 HAVING count(*) >= 3)")
def _(t):
    known = t.documents.where("source is not null").groupBy("source").count().where("count >= 3").select("source", F.lit(True).alias("known"))
    return t.documents.join(F.broadcast(known), "source", "left").where((F.length("text") != C("n_chars")) | C("known").isNull()).select("doc_id")


@query("sc13_identity_whole", "SELECT doc_id FROM documents WHERE length(text) <> n_chars OR source IS NULL OR source NOT IN (SELECT source FROM documents WHERE source IS NOT NULL)")
def _(t):
    known = t.documents.where("source is not null").select("source").distinct().withColumn("known", F.lit(True))
    return t.documents.join(F.broadcast(known), "source", "left").where((F.length("text") != C("n_chars")) | C("known").isNull()).select("doc_id")


@query("sc22_caption_text", "SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS transcript FROM conversations WHERE trim(text) <> '' GROUP BY 1")
def _(t):
    said = F.array_sort(F.collect_list(F.struct("turn", "text")))
    return t.conversations.where(F.trim("text") != "").groupBy("conv_id").agg(F.array_join(F.transform(said, lambda s: s["text"]), " ").alias("transcript"))


@query("sc19_parsed_pages")
def _(t):
    from ..sources.readers import parse_pages

    return parse_pages(t.pages)


@query("pf4_scope_filter", "SELECT p_partkey, 'all' AS scope FROM part WHERE p_type = 'PROMO' AND p_brand <> '' UNION ALL SELECT p_partkey, p_brand FROM part WHERE p_brand = 'Brand#5'")
def _(t):
    p = t.part
    return p.where("p_type = 'PROMO' and p_brand <> ''").select("p_partkey", F.lit("all").alias("scope")).unionByName(p.where("p_brand = 'Brand#5'").select("p_partkey", C("p_brand").alias("scope")))


@query("pf5_scope_expansion", "SELECT DISTINCT p_brand AS scope FROM part WHERE p_type = 'PROMO' UNION SELECT 'all'")
def _(t):
    return t.part.where("p_type = 'PROMO'").select(C("p_brand").alias("scope")).union(t.spark.createDataFrame([("all",)], "scope string")).distinct()


@query("pf6_first_of_list", "SELECT p_partkey, axis, CASE axis WHEN 'form' THEN split_part(p_name, ' ', 1) ELSE p_type END AS value FROM part, (VALUES ('form'), ('kind')) v(axis)")
def _(t):
    p = t.part.withColumn("axis", F.explode(F.array(F.lit("form"), F.lit("kind"))))
    return p.select("p_partkey", "axis", F.when(C("axis") == "form", F.element_at(F.split("p_name", " "), 1)).otherwise(C("p_type")).alias("value"))


@query("pf15_already_done", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1 AND toxic = 0)")
def _(t):
    return t.documents.select("doc_id").join(t.labels.where("quality = 1 and toxic = 0").select("doc_id"), "doc_id", "left_anti")


@query("pf16_month_trust", "SELECT strftime(o_orderdate, '%Y-%m') AS month, CASE WHEN count(*) FILTER (WHERE o_totalprice > 490000) = 0 THEN count(*) FILTER (WHERE o_orderstatus = 'F') END AS trusted FROM orders GROUP BY 1")
def _(t):
    g = t.orders.groupBy(S.month_of(C("o_orderdate")).alias("month")).agg(F.count_if(C("o_totalprice") > 490000).alias("bad"), F.count_if(C("o_orderstatus") == "F").alias("n"))
    return g.select("month", F.when(C("bad") == 0, C("n")).alias("trusted"))


@query("pf21_health_status", """
SELECT user_id, CASE WHEN count(*) FILTER (WHERE event_type = 'error') > count(*) / 3 THEN 'blocked' WHEN count(*) FILTER (WHERE event_type = 'purchase') > 0 THEN 'yielded' WHEN count(*) < 5 THEN 'cancelled' ELSE 'idle' END AS status FROM events GROUP BY 1""")
def _(t):
    g = t.events.groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(C("event_type") == "error").alias("e"), F.count_if(C("event_type") == "purchase").alias("p"))
    return g.select("user_id", F.when(C("e") > C("n") / 3, "blocked").when(C("p") > 0, "yielded").when(C("n") < 5, "cancelled").otherwise("idle").alias("status"))


@query("j17_preaggregated_counts", "SELECT c_custkey, coalesce(f, 0) AS f, coalesce(p, 0) AS p FROM customer LEFT JOIN (SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) FILTER (WHERE o_orderstatus = 'P') AS p FROM orders GROUP BY 1) ON c_custkey = o_custkey")
def _(t):
    g = t.orders.groupBy(C("o_custkey").alias("c_custkey")).agg(F.count_if(C("o_orderstatus") == "F").alias("f"), F.count_if(C("o_orderstatus") == "P").alias("p"))
    return t.customer.select("c_custkey").join(g, "c_custkey", "left").na.fill(0)


@query("j23_quotes_outside", "SELECT l_orderkey, l_linenumber FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN part ON l_partkey = p_partkey WHERE o_orderkey IS NULL OR p_partkey IS NULL OR l_shipdate < o_orderdate")
def _(t):
    j = t.lineitem.join(t.orders, C("l_orderkey") == C("o_orderkey"), "left").join(t.part, C("l_partkey") == C("p_partkey"), "left")
    return j.where(C("o_orderkey").isNull() | C("p_partkey").isNull() | (C("l_shipdate") < C("o_orderdate"))).select("l_orderkey", "l_linenumber")


@query("j24_dictionary_lookups", "SELECT c_custkey, n_name, r_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def _(t):
    n = t.nation.join(F.broadcast(t.region), C("n_regionkey") == C("r_regionkey"), "left")
    return t.customer.join(n, C("c_nationkey") == C("n_nationkey"), "left").select("c_custkey", "n_name", "r_name")


@query("j34_source_pair", "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') * 1.0 / count(*) - count(*) FILTER (WHERE o_orderstatus = 'O') * 1.0 / count(*) AS gap FROM orders GROUP BY 1")
def _(t):
    g = t.orders.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.count_if(C("o_orderstatus") == "F").alias("a"), F.count_if(C("o_orderstatus") == "O").alias("b"))
    return g.select("o_orderpriority", (C("a") / C("n") - C("b") / C("n")).alias("gap"))


@query("j35_seen_split", "SELECT d.doc_id, l.doc_id IS NOT NULL AS seen FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id")
def _(t):
    return t.documents.select("doc_id").join(t.labels.select("doc_id").distinct().withColumn("s", F.lit(True)), "doc_id", "left").select("doc_id", C("s").isNotNull().alias("seen"))


@query("j37_shared_basket", "SELECT l_partkey, count(*) AS n FROM lineitem WHERE l_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'N') GROUP BY 1")
def _(t):
    li = t.lineitem
    both = li.where("l_returnflag = 'R'").select("l_partkey").intersect(li.where("l_returnflag = 'N'").select("l_partkey"))
    return li.join(both, "l_partkey", "left_semi").groupBy("l_partkey").agg(F.count("*").alias("n"))


@query("j41_first_observation", "SELECT event_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'signup' AND value > 150) OR ts >= TIMESTAMP '2024-01-25'")
def _(t):
    old = t.events.where("event_type = 'signup' and value > 150").select("user_id").distinct().withColumn("old", F.lit(True))
    return t.events.join(old, "user_id", "left").where(C("old").isNull() | (C("ts") >= F.lit("2024-01-25").cast("timestamp_ntz"))).select("event_id")


@query("ag15_price_events", """
WITH c AS (SELECT event_id, user_id, ts, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events WHERE event_type = 'purchase') SELECT event_id, round((value - prev) / prev * 100, 4) AS pct FROM c WHERE prev IS NOT NULL AND prev <> value""")
def _(t):
    return W.changes(t.events.where("event_type = 'purchase'"), ["user_id"], ["ts", "event_id"], "value").select("event_id", S.scaled_round(S.quotient(C("value") - C("previous"), C("previous")) * 100, 4).alias("pct"))


@query("ag17_denominators", "SELECT l_partkey, count(*) FILTER (WHERE l_quantity <= 5) AS low, count(*) AS n, (count(*) FILTER (WHERE l_quantity <= 5) < 3 OR bool_or(l_quantity > 6)) AS complete FROM lineitem GROUP BY 1")
def _(t):
    return M.denominators(t.lineitem, ["l_partkey"], "l_quantity", 5, 3)


@query("ag31_having_invariants", f"WITH {_ORDERS} SELECT topic, quarter, count(*) AS n FROM o GROUP BY 1, 2 HAVING count(DISTINCT channel) < 3 OR count(*) > 60")
def _(t):
    g = quarter_rows(t).groupBy("topic", "quarter").agg(F.count("*").alias("n"), F.count_distinct("channel").alias("c"))
    return g.where("c < 3 or n > 60").select("topic", "quarter", "n")


@query("ag33_first_seen_dates", "SELECT user_id, strftime(min(ts), '%Y-%m-%d') AS first_day FROM events GROUP BY 1")
def _(t):
    return t.events.groupBy("user_id").agg(F.date_format(F.min("ts"), "yyyy-MM-dd").alias("first_day"))


@query("ag35_opportunity", f"""WITH {_TREND}, a35 AS (SELECT topic, quarter, (mentions - min(mentions) OVER w) * 1.0 / nullif(max(mentions) OVER w - min(mentions) OVER w, 0) AS m, diffusion FROM q WINDOW w AS (PARTITION BY quarter)), b35 AS (SELECT topic, quarter, coalesce(m, 0) * 0.6 + diffusion * 0.4 AS x FROM a35)
SELECT topic, quarter, round(CASE WHEN max(x) OVER w > min(x) OVER w THEN 100 * (x - min(x) OVER w) / (max(x) OVER w - min(x) OVER w) ELSE 0 END, 6) AS score FROM b35 WINDOW w AS (PARTITION BY quarter)""")
def _(t):
    b = trend(t).select("topic", "quarter", (W.min_max("mentions", ["quarter"]) * 0.6 + C("diffusion") * 0.4).alias("x"))
    return b.select("topic", "quarter", F.round(W.min_max("x", ["quarter"]) * 100, 6).alias("score"))


@query("ag40_role_split", "SELECT o_orderpriority, count(*) AS n, CASE WHEN count(*) >= 300 THEN round(count(*) FILTER (WHERE o_orderstatus = 'P') * 1.0 / count(*), 6) END AS rate FROM orders GROUP BY 1")
def _(t):
    g = t.orders.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.count_if(C("o_orderstatus") == "P").alias("p"))
    return g.select("o_orderpriority", "n", F.when(C("n") >= 300, F.round(C("p") / C("n"), 6)).alias("rate"))


@query("ag51_census", "SELECT lang, count(*) AS n, max(doc_id) AS last, count(DISTINCT source) AS sources FROM documents GROUP BY 1")
def _(t):
    return t.documents.groupBy("lang").agg(F.count("*").alias("n"), F.max("doc_id").alias("last"), F.count_distinct("source").alias("sources"))


@query("wn7_peak", f"WITH {_TREND} SELECT topic, quarter FROM (SELECT topic, quarter, composition, max(composition) OVER (PARTITION BY topic) AS m FROM q) WHERE composition = m")
def _(t):
    q = trend(t).withColumn("m", F.max("composition").over(Window.partitionBy("topic")))
    return q.where("composition = m").select("topic", "quarter")


@query("wn13_in_progress", f"WITH {_ORDERS} SELECT DISTINCT quarter, quarter >= '2001Q2' AS in_progress FROM o")
def _(t):
    return quarter_rows(t).select("quarter").distinct().withColumn("in_progress", C("quarter") >= "2001Q2")


@query("tk4_quote_order", "SELECT p_brand, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY coalesce(r, 99), p_retailprice DESC, p_partkey) AS n FROM part LEFT JOIN (VALUES ('PROMO', 1), ('ECONOMY', 2)) v(k, r) ON p_type = k) WHERE n = 1")
def _(t):
    rank = t.spark.createDataFrame([("PROMO", 1), ("ECONOMY", 2)], "p_type string, r int")
    p = t.part.join(F.broadcast(rank), "p_type", "left")
    return W.first_by(p, ["p_brand"], F.coalesce("r", F.lit(99)), C("p_retailprice").desc(), C("p_partkey")).select("p_brand", "p_partkey")


@query("tk7_over_fetch_fold", "SELECT user_id, min(n) AS best FROM (SELECT user_id, row_number() OVER (ORDER BY value DESC, event_id) AS n FROM events) WHERE n <= 40 GROUP BY 1 ORDER BY 2 LIMIT 10")
def _(t):
    top = t.events.orderBy(C("value").desc(), "event_id").limit(40).withColumn("n", F.row_number().over(Window.orderBy(C("value").desc(), "event_id")).cast("long"))
    return top.groupBy("user_id").agg(F.min("n").alias("best")).orderBy("best").limit(10)


@query("tk13_last_months", "SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders GROUP BY 1 ORDER BY 1 DESC LIMIT 24")
def _(t):
    return t.orders.groupBy(S.month_of(C("o_orderdate")).alias("month")).agg(F.count("*").alias("n")).orderBy(C("month").desc()).limit(24)


@query("tk14_most_common", "SELECT p_brand, p_name, n FROM (SELECT p_brand, p_name, count(*) AS n, row_number() OVER (PARTITION BY p_brand ORDER BY count(*) DESC, p_name) AS k FROM part GROUP BY 1, 2) WHERE k <= 2")
def _(t):
    return W.top_by(t.part.groupBy("p_brand", "p_name").agg(F.count("*").alias("n")), ["p_brand"], 2, C("n").desc(), C("p_name"))


@query("so5_symmetric_difference", "SELECT a.p_partkey, len(list_filter(string_split(a.p_name, ' '), lambda x: NOT list_contains(string_split(b.p_name, ' '), x))) AS only_a FROM part a JOIN part b ON a.p_partkey + 1 = b.p_partkey")
def _(t):
    b = t.part.select((C("p_partkey") - 1).alias("p_partkey"), F.split("p_name", " ").alias("other"))
    return t.part.join(b, "p_partkey").select("p_partkey", F.size(F.array_except(F.split("p_name", " "), "other")).cast("long").alias("only_a"))


@query("so8_inline_values", "SELECT n_name, tag FROM nation JOIN (VALUES (0, 'a'), (1, 'b')) v(k, tag) ON n_regionkey = k")
def _(t):
    v = t.spark.sql("SELECT * FROM VALUES (0, 'a'), (1, 'b') AS v(k, tag)")
    return t.nation.join(F.broadcast(v), C("n_regionkey") == C("k")).select("n_name", "tag")


@query("dc4_card_rules", f"""WITH {_TREND} SELECT topic, quarter, CASE WHEN composition >= 1.5 * baseline THEN 'surge' WHEN composition <= 0.5 * baseline THEN 'drop' ELSE 'steady' END AS card,
 list_filter([CASE WHEN mentions < 5 THEN 'few mentions' END, CASE WHEN channels < 4 THEN 'few channels' END], lambda x: x IS NOT NULL) AS limits FROM q""")
def _(t):
    card = F.when(C("composition") >= 1.5 * C("baseline"), "surge").when(C("composition") <= 0.5 * C("baseline"), "drop").otherwise("steady")
    limits = F.array_compact(F.array(F.when(C("mentions") < 5, "few mentions"), F.when(C("channels") < 4, "few channels")))
    return trend(t).select("topic", "quarter", card.alias("card"), limits.alias("limits"))


@query("dc10_pattern_hiding", "SELECT p_brand, p_name FROM (SELECT DISTINCT p_brand, p_name FROM part) a WHERE p_brand <> 'Brand#1' OR p_name NOT IN (SELECT p_name FROM part WHERE p_brand = 'Brand#2')")
def _(t):
    p = t.part.select("p_brand", "p_name").distinct()
    own = p.where("p_brand = 'Brand#2'").select("p_name")
    return p.where("p_brand <> 'Brand#1'").unionByName(p.where("p_brand = 'Brand#1'").join(own, "p_name", "left_anti"))


@query("dc11_confirmed_first", "SELECT c_custkey, coalesce(v.p, CASE WHEN c_acctbal < 0 THEN 'negative' WHEN contains(c_mktsegment, 'MACH') THEN 'neutral' ELSE 'positive' END) AS polarity FROM customer LEFT JOIN (VALUES ('FURNITURE', 'neutral')) v(k, p) ON c_mktsegment = k")
def _(t):
    table = t.spark.createDataFrame([("FURNITURE", "neutral")], "c_mktsegment string, p string")
    hint = F.when(C("c_acctbal") < 0, "negative").when(C("c_mktsegment").contains("MACH"), "neutral").otherwise("positive")
    return t.customer.join(F.broadcast(table), "c_mktsegment", "left").select("c_custkey", F.coalesce("p", hint).alias("polarity"))


@query("dc14_baseline_check", "SELECT event_type, round(avg(value), 1) AS metric, round(avg(value), 1) >= 50.0 AS meets FROM events GROUP BY 1")
def _(t):
    return t.events.groupBy("event_type").agg(F.round(F.avg("value"), 1).alias("metric")).withColumn("meets", C("metric") >= 50.0)


@query("dc16_combined_onset", "SELECT user_id, greatest(min(ts) FILTER (WHERE event_type = 'view'), min(ts) FILTER (WHERE event_type = 'click')) = min(ts) FILTER (WHERE event_type = 'view') AS view_last FROM events GROUP BY 1")
def _(t):
    first = lambda k: F.min(F.when(C("event_type") == k, C("ts")))
    g = t.events.groupBy("user_id").agg(first("view").alias("v"), first("click").alias("c"))
    return g.select("user_id", (F.greatest("v", "c") == C("v")).alias("view_last"))


@query("dc18_identity_relation", "SELECT a.p_partkey, CASE WHEN a.p_brand <> b.p_brand THEN 'distinct' WHEN a.p_name = b.p_name AND a.p_type = b.p_type THEN 'same_variant' WHEN a.p_name = b.p_name THEN 'same_line' ELSE 'related' END AS relation FROM part a JOIN part b ON a.p_partkey + 25 = b.p_partkey")
def _(t):
    b = t.part.select((C("p_partkey") - 25).alias("p_partkey"), C("p_brand").alias("b"), C("p_name").alias("n"), C("p_type").alias("k"))
    relation = F.when(C("p_brand") != C("b"), "distinct").when((C("p_name") == C("n")) & (C("p_type") == C("k")), "same_variant").when(C("p_name") == C("n"), "same_line").otherwise("related")
    return t.part.join(b, "p_partkey").select("p_partkey", relation.alias("relation"))


@query("dc20_search_terms", "SELECT p_partkey, [concat(p_brand, ' ', p_name), p_name] AS terms FROM part")
def _(t):
    terms = F.array(F.concat_ws(" ", "p_brand", "p_name"), C("p_name"), F.concat_ws(" ", C("p_brand"), F.element_at(F.split("p_name", " "), 2)))
    return t.part.select("p_partkey", F.slice(F.array_distinct(terms), 1, 2).alias("terms"))


@query("dc20_candidate_terms", """
WITH g AS (SELECT split_part(p_name, ' ', 2) AS term FROM part WHERE p_name LIKE '% %' GROUP BY 1 HAVING count(DISTINCT p_brand) >= 3)
SELECT p_partkey, CASE WHEN split_part(p_name, ' ', 2) IN (SELECT term FROM g) THEN [concat(p_brand, ' ', p_name), p_name, concat(p_brand, ' ', split_part(p_name, ' ', 1))] ELSE [concat(p_brand, ' ', p_name)] END AS terms FROM part""")
def _(t):
    # only last words count as category words here: every brand has the others, which tell its parts apart
    last = t.part.where(C("p_name").contains(" ")).select("p_brand", F.element_at(F.split("p_name", " "), -1).alias("term"))
    generic = last.groupBy("term").agg(F.count_distinct("p_brand").alias("n")).where("n >= 3").agg(F.collect_list("term").alias("generic"))
    return t.part.crossJoin(F.broadcast(generic)).select("p_partkey", X.candidate_terms(C("p_brand"), C("p_name"), C("generic")).alias("terms"))


@query("v2_grid_violations", f"WITH {_TREND} SELECT 'closure' AS kind, quarter FROM q GROUP BY quarter HAVING abs(sum(composition) - 1) > 1e-6 UNION ALL SELECT 'range', quarter FROM q WHERE entropy > 1.000001 OR breadth > 1 OR unique_ratio > 1")
def _(t):
    q = trend(t)
    closure = q.groupBy("quarter").agg(F.sum("composition").alias("s")).where("abs(s - 1) > 1e-6").select(F.lit("closure").alias("kind"), "quarter")
    return closure.unionByName(q.where("entropy > 1.000001 or breadth > 1 or unique_ratio > 1").select(F.lit("range").alias("kind"), "quarter"))


@query("v6_author_allow_list", "SELECT event_id FROM events WHERE len(list_filter(json_keys(props), lambda x: x <> 'k')) > 0 OR regexp_matches(props, '[A-Za-z0-9._]+@')")
def _(t):
    return t.events.where((F.size(F.array_except(F.json_object_keys("props"), F.array(F.lit("k")))) > 0) | C("props").rlike("[A-Za-z0-9._]+@")).select("event_id")


@query("v7_backfill_report", "SELECT c_mktsegment, count(*) AS n, count(*) FILTER (WHERE upper(c_mktsegment) IS DISTINCT FROM c_mktsegment) AS to_change FROM customer GROUP BY 1")
def _(t):
    return t.customer.groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.count_if(~F.upper("c_mktsegment").eqNullSafe(C("c_mktsegment"))).alias("to_change"))


@query("gr2_cluster_rows", "SELECT p_name AS cluster, min(p_partkey) AS anchor, count(*) AS members, count(DISTINCT p_brand) >= 2 AS cross_brand FROM part GROUP BY 1")
def _(t):
    return t.part.groupBy(C("p_name").alias("cluster")).agg(F.min("p_partkey").alias("anchor"), F.count("*").alias("members"), (F.count_distinct("p_brand") >= 2).alias("cross_brand"))


@query("rt12_coverage", "SELECT d.lang, count(*) AS corpus, count(l.doc_id) AS stored, count(*) - count(l.doc_id) AS missing FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1")
def _(t):
    s = t.labels.select("doc_id").withColumn("s", F.lit(1))
    g = t.documents.join(s, "doc_id", "left").groupBy("lang").agg(F.count("*").alias("corpus"), F.count("s").alias("stored"))
    return g.withColumn("missing", C("corpus") - C("stored"))


@query("st5_late_missing", "SELECT event_id FROM events WHERE event_type = 'purchase' AND event_id NOT IN (SELECT event_id FROM events WHERE value > 30)")
def _(t):
    return t.events.where("event_type = 'purchase'").join(t.events.where("value > 30").select("event_id"), "event_id", "left_anti").select("event_id")


@query("st7_freshness_cache", "SELECT user_id, max_by(event_id, (ts, event_id)) AS newest FROM events WHERE ts > TIMESTAMP '2024-01-20' GROUP BY 1")
def _(t):
    return t.events.where(C("ts") > F.lit("2024-01-20").cast("timestamp_ntz")).groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("newest"))


@query("st8_queue_caps", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE event_type = 'signup') WHERE n <= 3")
def _(t):
    return W.top_by(t.events.where("event_type = 'signup'"), ["user_id"], 3, C("ts"), C("event_id")).select("user_id", "event_id")


@query("st9_hour_buckets", "SELECT DISTINCT user_id, event_type, strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour FROM events")
def _(t):
    return t.events.select("user_id", "event_type", F.date_format(F.date_trunc("hour", "ts"), "yyyy-MM-dd HH").alias("hour")).distinct()


@query("st12_rematch_plan", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) OR (SELECT count(*) FROM region) <> 5")
def _(t):
    changed = t.region.count() != 5
    return t.documents.select("doc_id") if changed else t.documents.select("doc_id").join(t.labels.select("doc_id"), "doc_id", "left_anti")


def _junk_predictor():
    def predict(texts: pd.Series) -> pd.Series:
        return texts.map(lambda s: "junk" if s is None or "!!" in s or "|" in s else "fine")

    return predict


U.register("quality", "rules", _junk_predictor)


@query("ud3_batch_predictor", "SELECT doc_id, CASE WHEN contains(text, '!!') OR contains(text, '|') THEN 'junk' ELSE 'fine' END AS label FROM documents")
def _(t):
    return t.documents.select("doc_id", U.batch_function(U.implementation("quality", "rules").build)("text").alias("label"))
