"""Scans, projections, joins, windows, top-k, set operations and sinks over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import joins as J
from ..operators import sinks as K
from ..operators import windows as W
from .base import Catalog

catalog = Catalog()
query = catalog.query
C = F.col


# --- scans -----------------------------------------------------------------------------------------------------


@query("sc1_keyset_page", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE (l_orderkey, l_linenumber, l_quantity) > (100, 2, 10.0) ORDER BY l_orderkey, l_linenumber, l_quantity LIMIT 500")
def _(t):
    return J.keyset_page(t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity"), ["l_orderkey", "l_linenumber", "l_quantity"], [100, 2, 10.0], 500)


@query("sc2_month_slices", "SELECT strftime(coalesce(l_shipdate, TIMESTAMP '1970-01-01'), '%Y-%m') AS month, count(*) AS n FROM lineitem GROUP BY 1")
def _(t):
    return t.lineitem.groupBy(S.month_of(F.coalesce("l_shipdate", F.lit("1970-01-01").cast("timestamp"))).alias("month")).agg(F.count("*").alias("n"))


@query("sc3_since_cutoff_scan", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate <= TIMESTAMP '1999-06-30'")
def _(t):
    return t.orders.where((C("o_orderdate") >= F.lit("1997-01-01").cast("timestamp")) & (C("o_orderdate") <= F.lit("1999-06-30").cast("timestamp"))).select("o_orderkey", "o_orderpriority")


@query("sc5_active_dictionary", """
WITH d AS (SELECT p_brand AS ruleset, p_name AS pattern, max(p_size) AS version FROM part GROUP BY 1, 2)
SELECT ruleset, pattern, version FROM d WHERE ruleset IN ('Brand#1', 'Brand#2', 'Brand#3') AND version >= 25""")
def _(t):
    d = t.part.groupBy(C("p_brand").alias("ruleset"), C("p_name").alias("pattern")).agg(F.max("p_size").alias("version"))
    return d.where(C("ruleset").isin("Brand#1", "Brand#2", "Brand#3") & (C("version") >= 25))


@query("sc10_typed_coercions", """
SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS k_int, TRY_CAST(event_type AS DOUBLE) AS bad_number,
       nullif(event_type, 'view') AS kind, strftime(ts, '%Y-%m-%d') AS day FROM events""")
def _(t):
    return t.events.select("event_id", F.expr("try_cast(get_json_object(props, '$.k') as int)").alias("k_int"), F.expr("try_cast(event_type as double)").alias("bad_number"), F.nullif("event_type", F.lit("view")).alias("kind"), F.date_format("ts", "yyyy-MM-dd").alias("day"))


@query("sc11_manifest_counts", """
WITH m AS (SELECT lang, count(*) AS measured, count(DISTINCT doc_id) AS ids FROM documents GROUP BY lang),
d AS (SELECT unnest(['en', 'fr', 'de', 'es', 'xx']) AS lang)
SELECT d.lang, coalesce(measured, 0) AS measured, coalesce(measured = ids, true) AS ids_unique FROM d LEFT JOIN m USING (lang)""")
def _(t):
    declared = t.spark.createDataFrame([(x,) for x in ("en", "fr", "de", "es", "xx")], "lang string")
    m = t.documents.groupBy("lang").agg(F.count("*").alias("measured"), F.countDistinct("doc_id").alias("ids"))
    return declared.join(m, "lang", "left").select("lang", F.coalesce("measured", F.lit(0)).alias("measured"), F.coalesce(C("measured") == C("ids"), F.lit(True)).alias("ids_unique"))


@query("sc12_roster_mismatch", """
SELECT s_suppkey, s_nationkey, c_nationkey FROM supplier LEFT JOIN customer ON s_suppkey = c_custkey WHERE s_nationkey IS DISTINCT FROM c_nationkey""")
def _(t):
    return t.supplier.join(t.customer, C("s_suppkey") == C("c_custkey"), "left").where(~C("s_nationkey").eqNullSafe(C("c_nationkey"))).select("s_suppkey", "s_nationkey", "c_nationkey")


@query("sc14_unified_documents", """
SELECT concat('web:', doc_id) AS doc_id, 'documents' AS arm, length(text) AS n FROM documents
UNION ALL SELECT concat('talk:', conv_id, '/', turn), 'conversations', length(text) FROM conversations
UNION ALL SELECT concat('page:', page_id), 'pages', length(html) FROM pages
UNION ALL SELECT concat('bench:', item_id), 'benchmark', length(text) FROM benchmark
UNION ALL SELECT concat('event:', event_id), 'events', length(props) FROM events""")
def _(t):
    def arm(df, name, key, text):
        return df.select(key.alias("doc_id"), F.lit(name).alias("arm"), F.length(text).cast("long").alias("n"))

    return (
        arm(t.documents, "documents", F.concat(F.lit("web:"), C("doc_id").cast("string")), "text")
        .unionByName(arm(t.conversations, "conversations", F.concat(F.lit("talk:"), C("conv_id").cast("string"), F.lit("/"), C("turn").cast("string")), "text"))
        .unionByName(arm(t.pages, "pages", F.concat(F.lit("page:"), C("page_id").cast("string")), "html"))
        .unionByName(arm(t.benchmark, "benchmark", F.concat(F.lit("bench:"), C("item_id").cast("string")), "text"))
        .unionByName(arm(t.events, "events", F.concat(F.lit("event:"), C("event_id").cast("string")), "props"))
    )


@query("sc15_nested_json", """
SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, strftime(ts, '%Y-%m') AS month FROM events WHERE json_extract(props, '$.k') IS NOT NULL""")
def _(t):
    parsed = t.events.select("event_id", "ts", F.from_json("props", "k long").alias("p"))
    return parsed.where("p.k is not null").select("event_id", C("p.k").alias("k"), S.month_of(C("ts")).alias("month"))


@query("sc16_positional_terms", """
WITH e AS (SELECT user_id, list(event_type ORDER BY ts, event_id) AS kinds FROM events GROUP BY user_id),
x AS (SELECT user_id, unnest(kinds) AS kind, unnest(range(len(kinds))) AS pos FROM e)
SELECT user_id, pos, kind, ['alpha', 'beta', 'gamma'][pos + 1] AS term FROM x WHERE pos < 3""")
def _(t):
    kinds = F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))), lambda s: s["event_type"])
    e = t.events.groupBy("user_id").agg(kinds.alias("kinds")).select("user_id", F.posexplode("kinds").alias("pos", "kind"))
    terms = F.array(F.lit("alpha"), F.lit("beta"), F.lit("gamma"))
    return e.where("pos < 3").select("user_id", C("pos").cast("long").alias("pos"), "kind", F.element_at(terms, C("pos") + 1).alias("term"))


@query("sc18_page_fields", r"""
SELECT page_id, regexp_extract(html, '<title>(.*?)</title>', 1) AS title, regexp_extract(html, '<html lang="([a-z]+)"', 1) AS lang,
       CAST(len(regexp_extract_all(html, '<a href="[^"]*"')) AS BIGINT) AS links FROM pages""")
def _(t):
    return t.pages.select("page_id", F.regexp_extract("html", "<title>(.*?)</title>", 1).alias("title"), F.regexp_extract("html", '<html lang="([a-z]+)"', 1).alias("lang"), F.size(F.regexp_extract_all("html", F.lit('<a href="[^"]*"'), 0)).cast("long").alias("links"))


@query("sc21_record_fan_out", """
SELECT 'rank' AS kind, event_id AS k, CAST(user_id AS DOUBLE) AS v FROM events
UNION ALL SELECT 'product', user_id, CAST(count(*) AS DOUBLE) FROM events GROUP BY user_id
UNION ALL SELECT 'price', event_id, value FROM events WHERE value IS NOT NULL AND event_type = 'purchase'""")
def _(t):
    e = t.events
    rank = e.select(F.lit("rank").alias("kind"), C("event_id").alias("k"), C("user_id").cast("double").alias("v"))
    product = e.groupBy("user_id").count().select(F.lit("product").alias("kind"), C("user_id").alias("k"), C("count").cast("double").alias("v"))
    price = e.where("value is not null and event_type = 'purchase'").select(F.lit("price").alias("kind"), C("event_id").alias("k"), C("value").alias("v"))
    return rank.unionByName(product).unionByName(price)


@query("sc23_payload_digest", """
SELECT event_type AS kind, sha256(props) AS digest, substr(sha256(props), 1, 2) AS shard, count(*) AS n FROM events GROUP BY 1, 2, 3""")
def _(t):
    d = F.sha2(C("props"), 256)
    return t.events.groupBy(C("event_type").alias("kind"), d.alias("digest"), F.substring(d, 1, 2).alias("shard")).agg(F.count("*").alias("n"))


@query("sc24_vector_store_check", """
SELECT len(embedding) AS dim, count(*) AS n, bool_and(abs(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))) - 1) < 1e-3) AS normalized
FROM embeddings GROUP BY 1""")
def _(t):
    norm = F.sqrt(S.dot(C("embedding"), C("embedding")))
    return t.embeddings.groupBy(F.size("embedding").cast("long").alias("dim")).agg(F.count("*").alias("n"), F.bool_and(F.abs(norm - 1) < 1e-3).alias("normalized"))


# --- projections and predicates --------------------------------------------------------------------------------


@query("pf1_text_unit", """
SELECT concat(l_orderkey, '/', l_linenumber) AS ref, strftime(l_shipdate, '%Y-%m') AS month,
       CASE WHEN l_shipdate >= TIMESTAMP '2001-01-01' THEN 'month' ELSE 'year' END AS resolution FROM lineitem""")
def _(t):
    return t.lineitem.select(F.concat_ws("/", C("l_orderkey").cast("string"), C("l_linenumber").cast("string")).alias("ref"), S.month_of(C("l_shipdate")).alias("month"), F.when(C("l_shipdate") >= F.lit("2001-01-01").cast("timestamp"), "month").otherwise("year").alias("resolution"))


@query("pf2_category_map", """
SELECT p_partkey, CASE WHEN p_type = 'ECONOMY' AND p_brand = 'Brand#5' THEN 'exact' WHEN p_type = 'PROMO' THEN 'shared'
  WHEN regexp_matches(p_name, 'bolt$') THEN 'bolt' WHEN regexp_matches(p_name, '^(cold|hot)') THEN 'thermal' END AS category FROM part""")
def _(t):
    exact = t.spark.createDataFrame([("Brand#5", "ECONOMY", "exact")], "p_brand string, p_type string, exact string")
    shared = t.spark.createDataFrame([("PROMO", "shared")], "p_type string, shared string")
    rules = F.when(C("p_name").rlike("bolt$"), "bolt").when(C("p_name").rlike("^(cold|hot)"), "thermal")
    return t.part.join(F.broadcast(exact), ["p_brand", "p_type"], "left").join(F.broadcast(shared), "p_type", "left").select("p_partkey", F.coalesce("exact", "shared", rules).alias("category"))


@query("pf3_product_axis", """
SELECT o_orderkey, CASE WHEN nullif(o_orderstatus, 'P') IS NOT NULL THEN o_orderstatus WHEN o_custkey % 2 = 0 THEN concat('unlinked:', o_orderpriority, ':', o_custkey) ELSE '' END AS product FROM orders""")
def _(t):
    return t.orders.select("o_orderkey", F.when(F.nullif("o_orderstatus", F.lit("P")).isNotNull(), C("o_orderstatus")).when(C("o_custkey") % 2 == 0, F.concat(F.lit("unlinked:"), C("o_orderpriority"), F.lit(":"), C("o_custkey").cast("string"))).otherwise("").alias("product"))


@query("pf7_month_quarter", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS month, concat(year(o_orderdate), 'Q', quarter(o_orderdate)) AS quarter FROM orders")
def _(t):
    return t.orders.select("o_orderkey", S.month_of(C("o_orderdate")).alias("month"), S.quarter_of(C("o_orderdate")).alias("quarter"))


@query("pf8_content_type", """
SELECT event_id, CASE WHEN TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) IS NULL THEN 'unknown' WHEN CAST(json_extract_string(props, '$.k') AS DOUBLE) <= 60 THEN 'short' ELSE 'long' END AS content_type FROM events""")
def _(t):
    d = F.expr("try_cast(get_json_object(props, '$.k') as double)")
    return t.events.select("event_id", F.when(d.isNull(), "unknown").when(d <= 60, "short").otherwise("long").alias("content_type"))


@query("pf9_quality_flags", """
SELECT conv_id, turn, CASE WHEN trim(coalesce(text, '')) = '' THEN 'empty_text' WHEN row_number() OVER (PARTITION BY conv_id, text ORDER BY turn) > 1 THEN 'duplicate_in_parent' ELSE '' END AS flags FROM conversations""")
def _(t):
    n = F.row_number().over(Window.partitionBy("conv_id", "text").orderBy("turn"))
    return t.conversations.select("conv_id", "turn", F.when(F.trim(F.coalesce("text", F.lit(""))) == "", "empty_text").when(n > 1, "duplicate_in_parent").otherwise("").alias("flags"))


@query("pf10_hash_flags", "SELECT c_custkey, substr(sha256(concat('youtube:', c_name)), 1, 24) AS author, regexp_matches(c_mktsegment, 'FURN|AUTO') AS promo FROM customer")
def _(t):
    return t.customer.select("c_custkey", F.substring(F.sha2(F.concat(F.lit("youtube:"), C("c_name")), 256), 1, 24).alias("author"), C("c_mktsegment").rlike("FURN|AUTO").alias("promo"))


@query("pf13_precision_edges", "SELECT o_orderkey, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS first_day, strftime(last_day(o_orderdate), '%Y-%m-%d') AS last_day FROM orders")
def _(t):
    return t.orders.select("o_orderkey", F.date_format(F.trunc("o_orderdate", "MM"), "yyyy-MM-dd").alias("first_day"), F.date_format(F.last_day("o_orderdate"), "yyyy-MM-dd").alias("last_day"))


@query("pf14_ownership", """
WITH owner AS (SELECT * FROM (VALUES ('1-URGENT', '1997-01'), ('2-HIGH', '1999-06')) v(scope, since))
SELECT o_orderkey FROM orders LEFT JOIN owner ON o_orderpriority = scope AND strftime(o_orderdate, '%Y-%m') >= since WHERE scope IS NULL""")
def _(t):
    owners = t.spark.createDataFrame([("1-URGENT", "1997-01"), ("2-HIGH", "1999-06")], "scope string, since string")
    return t.orders.join(F.broadcast(owners), (C("o_orderpriority") == C("scope")) & (S.month_of(C("o_orderdate")) >= C("since")), "left_anti").select("o_orderkey")


@query("pf17_api_builder", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice >= 100000 ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 50 OFFSET 10")
def _(t):
    from ..operators.api import select_rows

    return select_rows(t.orders, ["o_orderkey", "o_totalprice"], [("o_orderpriority", "eq", "1-URGENT"), ("o_totalprice", "gte", 100000)], [("o_totalprice", "desc"), ("o_orderkey", "asc")], 50, 10)


@query("pf19_no_later_rewrite", """
SELECT o_orderkey FROM orders a WHERE NOT EXISTS (SELECT 1 FROM orders b WHERE b.o_custkey = a.o_custkey AND b.o_orderstatus = 'F' AND b.o_orderdate > a.o_orderdate)""")
def _(t):
    last = t.orders.where("o_orderstatus = 'F'").groupBy(C("o_custkey").alias("k")).agg(F.max("o_orderdate").alias("last"))
    return t.orders.join(last, (C("o_custkey") == C("k")) & (C("last") > C("o_orderdate")), "left_anti").select("o_orderkey")


@query("pf20_severity", """
SELECT event_id, CASE event_type WHEN 'error' THEN 3 WHEN 'signup' THEN 1 ELSE 0 END AS status_level, CASE WHEN value > 150 THEN 2 WHEN value > 80 THEN 1 ELSE 0 END AS fresh_level,
greatest(CASE event_type WHEN 'error' THEN 3 WHEN 'signup' THEN 1 ELSE 0 END, CASE WHEN value > 150 THEN 2 WHEN value > 80 THEN 1 ELSE 0 END) AS worst FROM events""")
def _(t):
    a = F.when(C("event_type") == "error", 3).when(C("event_type") == "signup", 1).otherwise(0)
    b = F.when(C("value") > 150, 2).when(C("value") > 80, 1).otherwise(0)
    return t.events.select("event_id", a.alias("status_level"), b.alias("fresh_level"), F.greatest(a, b).alias("worst"))


@query("pf22_json_keys", "SELECT event_id, json_extract(props, '$.k') IS NOT NULL AS has_k, list_has_any(json_keys(props), ['author', 'k']) AS has_any FROM events")
def _(t):
    return t.events.select("event_id", F.get_json_object("props", "$.k").isNotNull().alias("has_k"), F.arrays_overlap(F.json_object_keys("props"), F.array(F.lit("author"), F.lit("k"))).alias("has_any"))


@query("pf24_prefix_position", "SELECT p_partkey, starts_with(p_name, 'cold') AS pre, strpos(p_name, 'dg') > 0 AS pos, p_name ILIKE '%BOLT%' AS lk FROM part")
def _(t):
    return t.part.select("p_partkey", C("p_name").startswith("cold").alias("pre"), C("p_name").contains("dg").alias("pos"), C("p_name").ilike("%BOLT%").alias("lk"))


# --- joins -----------------------------------------------------------------------------------------------------


@query("j1_panel_join", "SELECT o_orderkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment IN ('FURNITURE', 'MACHINERY')")
def _(t):
    panel = t.customer.where(C("c_mktsegment").isin("FURNITURE", "MACHINERY")).select(C("c_custkey").alias("o_custkey"), "c_mktsegment")
    return t.orders.select("o_orderkey", "o_custkey").join(panel, "o_custkey").select("o_orderkey", "c_mktsegment")


@query("j2_semi_exists", "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def _(t):
    return t.orders.join(t.lineitem.where("l_returnflag = 'R'"), C("o_orderkey") == C("l_orderkey"), "left_semi").select("o_orderkey")


@query("j4_parent_self_join", """
SELECT c.conv_id, c.turn, length(p.text) AS parent_length FROM conversations c JOIN conversations p ON c.conv_id = p.conv_id AND c.turn - 1 = p.turn""")
def _(t):
    p = t.conversations.select("conv_id", (C("turn") + 1).alias("turn"), F.length("text").cast("long").alias("parent_length"))
    return t.conversations.select("conv_id", "turn").join(p, ["conv_id", "turn"])


@query("j5_anti_unmatched", "SELECT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def _(t):
    return t.documents.select("doc_id").join(t.labels.select("doc_id"), "doc_id", "left_anti")


@query("j6_deferred_counts", "SELECT source, count(DISTINCT d.doc_id) AS deferred FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) GROUP BY source")
def _(t):
    return t.documents.select("doc_id", "source").join(t.labels.select("doc_id"), "doc_id", "left_anti").groupBy("source").agg(F.countDistinct("doc_id").alias("deferred"))


@query("j7_row_value_join", """
SELECT a.l_orderkey, a.l_linenumber, count(*) AS n FROM lineitem a JOIN lineitem b ON (a.l_orderkey, a.l_partkey, a.l_suppkey, a.l_linenumber, a.l_returnflag, a.l_linestatus, a.l_quantity, a.l_discount) =
 (b.l_orderkey, b.l_partkey, b.l_suppkey, b.l_linenumber, b.l_returnflag, b.l_linestatus, b.l_quantity, b.l_discount) GROUP BY 1, 2""")
def _(t):
    keys = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_quantity", "l_discount"]
    return t.lineitem.select(keys).join(t.lineitem.select(keys), keys).groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"))


@query("j8_population_semi", "SELECT count(*) AS n, sum(l_quantity) AS quantity FROM lineitem JOIN (SELECT DISTINCT p_partkey FROM part WHERE p_size > 20) p ON l_partkey = p_partkey")
def _(t):
    return t.lineitem.join(t.part.where("p_size > 20"), C("l_partkey") == C("p_partkey"), "left_semi").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"))


@query("j9_lateral_candidates", """
SELECT e.event_id, r.event_id AS candidate, count(*) OVER (PARTITION BY e.event_id) AS candidates, row_number() OVER (PARTITION BY e.event_id ORDER BY r.ts, r.event_id) AS place
FROM events e JOIN events r ON date_trunc('hour', e.ts) = date_trunc('hour', r.ts) AND list_contains(['signup', 'view'], r.event_type) WHERE e.event_type = 'purchase'""")
def _(t):
    h = F.date_trunc("hour", "ts")
    e = t.events.where("event_type = 'purchase'").select("event_id", h.alias("h"))
    r = t.events.where(F.array_contains(F.array(F.lit("signup"), F.lit("view")), C("event_type"))).select(C("event_id").alias("candidate"), C("ts").alias("at"), h.alias("h"))
    return J.ranked_pairs(e, "event_id", r, "h", "candidate", "at").withColumnRenamed("count", "candidates")


@query("j10_correlated_counts", "SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS orders FROM customer")
def _(t):
    n = t.orders.groupBy(C("o_custkey").alias("c_custkey")).agg(F.count("*").alias("orders"))
    return t.customer.select("c_custkey").join(n, "c_custkey", "left").select("c_custkey", F.coalesce("orders", F.lit(0)).alias("orders"))


@query("j11_nearest_in_time", """
SELECT event_id, other FROM (SELECT p.event_id, v.event_id AS other, row_number() OVER (PARTITION BY p.event_id ORDER BY abs(epoch_us(p.ts) - epoch_us(v.ts)), v.event_id) AS n
FROM events p JOIN events v ON p.user_id = v.user_id AND v.event_type = 'view' WHERE p.event_type = 'purchase') WHERE n = 1""")
def _(t):
    p = t.events.where("event_type = 'purchase'").select("event_id", "user_id", S.micros(C("ts")).alias("a"))
    v = t.events.where("event_type = 'view'").select(C("event_id").alias("other"), "user_id", S.micros(C("ts")).alias("b"))
    return J.nearest(p, v, ["user_id"], F.abs(C("a") - C("b")), ["event_id"], [C("other")]).select("event_id", "other")


@query("j12_asof_backward", """
SELECT p.event_id, (SELECT max_by(v.value, (v.ts, v.event_id)) FROM events v WHERE v.user_id = p.user_id AND v.event_type = 'view' AND v.ts <= p.ts) AS seen FROM events p WHERE p.event_type = 'purchase'""")
def _(t):
    p = t.events.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    v = t.events.where("event_type = 'view'").select("user_id", C("ts").alias("at"), C("value").alias("seen"))
    return J.asof_backward(p, v, ["user_id"], "ts", "at", ["seen"]).select("event_id", "seen")


@query("j13_range_window_means", """
WITH c AS (SELECT event_id, user_id, epoch_us(ts) // 3600000000 AS h FROM events WHERE event_type = 'purchase'), v AS (SELECT user_id, epoch_us(ts) // 3600000000 AS h, value FROM events WHERE event_type = 'view')
SELECT c.event_id, avg(v.value) FILTER (WHERE v.h < c.h) AS before_mean, avg(v.value) FILTER (WHERE v.h >= c.h) AS after_mean, count(v.value) AS n
FROM c LEFT JOIN v ON c.user_id = v.user_id AND v.h >= c.h - 6 AND v.h < c.h + 24 GROUP BY c.event_id""")
def _(t):
    hour = F.floor(S.micros(C("ts")) / 3600000000)
    c = t.events.where("event_type = 'purchase'").select("event_id", "user_id", hour.alias("h"))
    v = t.events.where("event_type = 'view'").select("user_id", hour.alias("at"), "value")
    hits = J.interval_join(v, c.withColumns({"begin": C("h") - 6, "end": C("h") + 24}), ["user_id"], "at", "begin", "end", 24)
    means = hits.groupBy("event_id").agg(F.avg(F.when(C("at") < C("h"), C("value"))).alias("before_mean"), F.avg(F.when(C("at") >= C("h"), C("value"))).alias("after_mean"), F.count("value").alias("n"))
    return c.select("event_id").join(means, "event_id", "left").select("event_id", "before_mean", "after_mean", F.coalesce("n", F.lit(0)).alias("n"))


@query("j14_absent_value", "SELECT p_partkey, coalesce(n, 101) AS rank FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45 GROUP BY 1) ON p_partkey = l_partkey")
def _(t):
    n = t.lineitem.where("l_returnflag = 'R' and l_quantity > 45").groupBy(C("l_partkey").alias("p_partkey")).agg(F.count("*").alias("n"))
    return t.part.select("p_partkey").join(n, "p_partkey", "left").select("p_partkey", F.coalesce("n", F.lit(101)).alias("rank"))


@query("j15_compound_outer", "SELECT o_orderkey, c_name FROM orders LEFT JOIN customer ON o_orderstatus = 'F' AND o_custkey = c_custkey AND c_acctbal > 0")
def _(t):
    return t.orders.join(t.customer, (C("o_orderstatus") == "F") & (C("o_custkey") == C("c_custkey")) & (C("c_acctbal") > 0), "left").select("o_orderkey", "c_name")


@query("j16_membership_join", "SELECT p_partkey, k FROM part JOIN (VALUES ('red,blue', 'hue'), ('cold,hot', 'heat'), ('small,large', 'size')) v(words, k) ON list_contains(string_split(words, ','), split_part(p_name, ' ', 1))")
def _(t):
    v = t.spark.createDataFrame([("red,blue", "hue"), ("cold,hot", "heat"), ("small,large", "size")], "words string, k string")
    w = v.select("k", F.explode(F.split("words", ",")).alias("word"))
    return t.part.select("p_partkey", F.split_part("p_name", F.lit(" "), F.lit(1)).alias("word")).join(F.broadcast(w), "word").select("p_partkey", "k")


@query("j18_left_group", "SELECT n_nationkey, count(c_custkey) AS customers, round(sum(c_acctbal), 2) AS balance FROM nation LEFT JOIN customer ON n_nationkey = c_nationkey GROUP BY 1")
def _(t):
    return t.nation.join(t.customer, C("n_nationkey") == C("c_nationkey"), "left").groupBy("n_nationkey").agg(F.count("c_custkey").alias("customers"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query("j20_rescale", """
WITH m AS (SELECT o_orderpriority AS g, strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders GROUP BY 1, 2)
SELECT p.g, p.month, CASE WHEN a.n > 0 THEN p.n * 100.0 / a.n END AS rescaled FROM m p LEFT JOIN m a ON a.g = '1-URGENT' AND a.month = p.month""")
def _(t):
    m = t.orders.groupBy(C("o_orderpriority").alias("g"), S.month_of(C("o_orderdate")).alias("month")).agg(F.count("*").alias("n"))
    a = m.where("g = '1-URGENT'").select("month", C("n").alias("anchor"))
    return m.join(a, "month", "left").select("g", "month", F.when(C("anchor") > 0, C("n") * 100.0 / C("anchor")).alias("rescaled"))


@query("j21_scalar_filter", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderdate = (SELECT max(o_orderdate) FROM orders WHERE o_orderstatus = 'F')")
def _(t):
    last = t.orders.where("o_orderstatus = 'F'").agg(F.max("o_orderdate").alias("last"))
    return t.orders.join(F.broadcast(last), C("o_orderdate") == C("last")).select("o_orderkey", "o_totalprice")


@query("j22_unjudged_cells", """
SELECT DISTINCT o_orderpriority, o_orderstatus FROM orders o WHERE NOT EXISTS (SELECT 1 FROM orders x WHERE x.o_orderpriority = o.o_orderpriority AND x.o_orderstatus = o.o_orderstatus AND x.o_totalprice > 499000)
AND EXISTS (SELECT 1 FROM orders y WHERE y.o_orderpriority = o.o_orderpriority AND y.o_totalprice > 490000)""")
def _(t):
    o = t.orders.select("o_orderpriority", "o_orderstatus").distinct()
    return o.join(t.orders.where("o_totalprice > 499000"), ["o_orderpriority", "o_orderstatus"], "left_anti").join(t.orders.where("o_totalprice > 490000").select("o_orderpriority"), "o_orderpriority", "left_semi")


@query("j28_blocked_best_pairs", """
WITH p AS (SELECT p_brand, p_partkey, p_size, p_retailprice FROM part), s AS (SELECT a.p_partkey AS a, b.p_partkey AS b, abs(a.p_size - b.p_size) AS d FROM p a JOIN p b ON a.p_brand = b.p_brand AND a.p_partkey <> b.p_partkey),
r AS (SELECT a, b, d, row_number() OVER (PARTITION BY a ORDER BY d, b) AS n FROM s)
SELECT x.a, x.b, x.d FROM r x JOIN r y ON x.a = y.b AND x.b = y.a WHERE x.n = 1 AND y.n = 1 AND x.a < x.b""")
def _(t):
    from ..operators.linker import mutual_best

    return mutual_best(t.part, "p_partkey", ["p_brand"], "p_size")


@query("j29_containment_join", """
SELECT DISTINCT a.p_name AS short, b.p_brand AS brand FROM (SELECT DISTINCT split_part(p_name, ' ', 2) AS p_name FROM part) a JOIN (SELECT DISTINCT p_brand, p_name FROM part) b ON list_contains(string_split(b.p_name, ' '), a.p_name)""")
def _(t):
    a = t.part.select(F.split_part("p_name", F.lit(" "), F.lit(2)).alias("short")).distinct()
    b = t.part.select(C("p_brand").alias("brand"), "p_name").distinct()
    # whole words meet by equality: the contained part is one of the words
    return b.select("brand", F.explode(F.split("p_name", " ")).alias("short")).join(a, "short").distinct().select("short", "brand")


@query("j29_containment_whole", """
SELECT DISTINCT a.p_name AS short, b.p_brand AS brand FROM (SELECT DISTINCT split_part(p_name, ' ', 2) AS p_name FROM part WHERE p_name LIKE '% %') a JOIN (SELECT DISTINCT p_brand, p_name FROM part) b ON contains(b.p_name, a.p_name)""")
def _(t):
    from ..operators.launch import contained

    a = t.part.where("p_name like '% %'").select(F.split_part("p_name", F.lit(" "), F.lit(2)).alias("short")).distinct()
    b = t.part.select(C("p_brand").alias("brand"), "p_name").distinct()
    return contained(b, "p_name", a, "short").select("name.short", "text.brand").distinct()


@query("j31_same_quarter_last_year", """
WITH q AS (SELECT o_orderpriority AS topic, year(o_orderdate) AS y, quarter(o_orderdate) AS q, count(*) AS n FROM orders GROUP BY 1, 2, 3)
SELECT a.topic, concat(a.y, 'Q', a.q) AS quarter, CASE WHEN a.n >= 5 AND b.n >= 5 THEN a.n * 1.0 / b.n - 1 END AS velocity FROM q a LEFT JOIN q b ON a.topic = b.topic AND b.y = a.y - 1 AND b.q = a.q""")
def _(t):
    q = t.orders.groupBy(C("o_orderpriority").alias("topic"), S.quarter_of(C("o_orderdate")).alias("quarter")).agg(F.count("*").alias("n"))
    b = q.select("topic", C("quarter").alias("pq"), C("n").alias("pn"))
    a = q.withColumn("pq", S.previous_year_quarter(C("quarter")))
    return a.join(b, ["topic", "pq"], "left").select("topic", "quarter", F.when((C("n") >= 5) & (C("pn") >= 5), C("n") / C("pn") - 1).alias("velocity"))


@query("j32_dense_grid", """
WITH t AS (SELECT DISTINCT o_orderpriority AS topic FROM orders), q AS (SELECT DISTINCT concat(year(o_orderdate), 'Q', quarter(o_orderdate)) AS quarter FROM orders),
n AS (SELECT o_orderpriority AS topic, concat(year(o_orderdate), 'Q', quarter(o_orderdate)) AS quarter, count(*) AS n FROM orders WHERE o_totalprice > 450000 GROUP BY 1, 2)
SELECT topic, quarter, coalesce(n, 0) AS n FROM t CROSS JOIN q LEFT JOIN n USING (topic, quarter)""")
def _(t):
    from ..operators.trend import dense_grid

    o = t.orders.select(C("o_orderpriority").alias("topic"), S.quarter_of(C("o_orderdate")).alias("quarter"), "o_totalprice")
    n = o.where("o_totalprice > 450000").groupBy("topic", "quarter").agg(F.count("*").alias("n"))
    return dense_grid(o.select("topic").distinct(), o.select("quarter").distinct(), n, ["topic", "quarter"], {"n": 0})


@query("j33_axis_drift", "SELECT DISTINCT event_type FROM events WHERE event_type NOT IN ('view', 'click', 'purchase')")
def _(t):
    known = t.spark.createDataFrame([("view",), ("click",), ("purchase",)], "event_type string")
    return t.events.select("event_type").distinct().join(F.broadcast(known), "event_type", "left_anti")


@query("j39_token_subset", """
WITH p AS (SELECT DISTINCT p_brand, p_name, string_split(p_name, ' ') AS w FROM part)
SELECT a.p_brand, a.p_name, CASE WHEN count(b.p_name) > 0 THEN 'partial' ELSE 'exact' END AS strength FROM p a LEFT JOIN p b ON a.p_brand = b.p_brand AND a.p_name <> b.p_name AND list_has_all(b.w, [a.w[2]]) GROUP BY 1, 2""")
def _(t):
    p = t.part.select("p_brand", "p_name").distinct()
    b = p.select("p_brand", C("p_name").alias("other"), F.split("p_name", " ").alias("words"))
    a = p.withColumn("word", F.element_at(F.split("p_name", " "), 2))
    subset = F.size(F.array_except(F.array("word"), "words")) == 0
    hit = a.join(b, "p_brand").where((C("p_name") != C("other")) & subset).select("p_brand", "p_name").distinct().withColumn("hit", F.lit(True))
    return p.join(hit, ["p_brand", "p_name"], "left").select("p_brand", "p_name", F.when(C("hit"), "partial").otherwise("exact").alias("strength"))


@query("j40_route_compare", """
WITH a AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'view' AND value > 100), b AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'click' AND value > 100)
SELECT coalesce(a.user_id, b.user_id) AS user_id, CASE WHEN b.user_id IS NULL THEN 'only_a' WHEN a.user_id IS NULL THEN 'only_b' ELSE 'shared' END AS side FROM a FULL JOIN b ON a.user_id = b.user_id""")
def _(t):
    e = t.events.where("value > 100")
    a = e.where("event_type = 'view'").select("user_id").distinct().withColumn("a", F.lit(True))
    b = e.where("event_type = 'click'").select("user_id").distinct().withColumn("b", F.lit(True))
    return a.join(b, "user_id", "full_outer").select("user_id", F.when(C("b").isNull(), "only_a").when(C("a").isNull(), "only_b").otherwise("shared").alias("side"))


@query("j45_spelling_closure", """
WITH p AS (SELECT DISTINCT p_type AS canonical, p_name AS surface FROM part)
SELECT a.surface, count(DISTINCT b.surface) AS spellings FROM p a JOIN p b ON a.canonical = b.canonical GROUP BY a.surface""")
def _(t):
    p = t.part.select(C("p_type").alias("canonical"), C("p_name").alias("surface")).distinct()
    return p.join(p.select("canonical", C("surface").alias("other")), "canonical").groupBy("surface").agg(F.countDistinct("other").alias("spellings"))


# --- windows and top-k -----------------------------------------------------------------------------------------


@query("wn3_latest_per_key", "SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def _(t):
    return W.first_by(t.events, ["user_id"], C("ts").desc(), C("event_id").desc()).select("user_id", "event_id", "value")


@query("wn4_mid_rank", """
SELECT p_partkey, ((SELECT count(*) FROM part b WHERE b.p_brand = a.p_brand AND b.p_size < a.p_size) + (SELECT count(*) FROM part b WHERE b.p_brand = a.p_brand AND b.p_size <= a.p_size)) / 2.0 /
 (SELECT count(*) FROM part b WHERE b.p_brand = a.p_brand) AS mid FROM part a WHERE (SELECT count(*) FROM part b WHERE b.p_brand = a.p_brand) > 1""")
def _(t):
    n = F.count("*").over(Window.partitionBy("p_brand"))
    return t.part.select("p_partkey", W.mid_rank("p_size", ["p_brand"]).alias("mid"), n.alias("n")).where("n > 1").drop("n")


@query("wn5_trailing_above", """
WITH q AS (SELECT o_orderpriority AS topic, concat(year(o_orderdate), 'Q', quarter(o_orderdate)) AS quarter, count(*) AS n FROM orders GROUP BY 1, 2), b AS (SELECT topic, median(n) AS base FROM q GROUP BY topic)
SELECT topic, quarter, CAST(sum(CASE WHEN n > base THEN 1 ELSE 0 END) OVER w AS BIGINT) AS above, count(*) OVER w AS size FROM q JOIN b USING (topic) WINDOW w AS (PARTITION BY topic ORDER BY quarter ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)""")
def _(t):
    q = t.orders.groupBy(C("o_orderpriority").alias("topic"), S.quarter_of(C("o_orderdate")).alias("quarter")).agg(F.count("*").alias("n"))
    base = q.groupBy("topic").agg(F.median("n").alias("base"))
    w = Window.partitionBy("topic").orderBy("quarter").rowsBetween(-3, 0)
    return q.join(base, "topic").select("topic", "quarter", F.sum((C("n") > C("base")).cast("int")).over(w).alias("above"), F.count("*").over(w).alias("size"))


@query("wn6_prior_below", """
WITH q AS (SELECT user_id, CAST(epoch_us(ts) // 86400000000 AS BIGINT) AS day, count(*) AS n FROM events GROUP BY 1, 2)
SELECT user_id, day, coalesce(max(n) OVER w < 3, false) AS quiet_before FROM q WINDOW w AS (PARTITION BY user_id ORDER BY day ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)""")
def _(t):
    q = t.events.groupBy("user_id", F.floor(S.micros(C("ts")) / 86400000000).alias("day")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("user_id").orderBy("day").rowsBetween(-3, -1)
    return q.select("user_id", "day", F.coalesce(F.max("n").over(w) < 3, F.lit(False)).alias("quiet_before"))


@query("wn8_value_changes", """
SELECT event_id, previous FROM (SELECT event_id, value, lag(value) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS previous FROM events) WHERE previous <> value""")
def _(t):
    return W.changes(t.events, ["user_id", "event_type"], ["ts", "event_id"], "value").select("event_id", "previous")


@query("wn9_share", "SELECT o_orderpriority, o_orderstatus, count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY o_orderpriority) AS share FROM orders GROUP BY 1, 2")
def _(t):
    return t.orders.groupBy("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n")).select("o_orderpriority", "o_orderstatus", W.share("n", ["o_orderpriority"]).alias("share"))


@query("wn11_min_max", "SELECT p_partkey, CASE WHEN max(p_size) OVER w > min(p_size) OVER w THEN (p_size - min(p_size) OVER w) * 1.0 / (max(p_size) OVER w - min(p_size) OVER w) ELSE 0 END AS scaled FROM part WINDOW w AS (PARTITION BY p_brand)")
def _(t):
    return t.part.select("p_partkey", W.min_max("p_size", ["p_brand"]).alias("scaled"))


@query("wn12_onset", """
WITH m AS (SELECT user_id, CAST(epoch_us(ts) // 86400000000 AS BIGINT) AS day, CAST(count(*) AS DOUBLE) AS n FROM events GROUP BY 1, 2), a AS (SELECT *, CASE WHEN n > 1 THEN 1 ELSE 0 END AS act FROM m),
b AS (SELECT user_id, day, act, coalesce(sum(1 - act) OVER (PARTITION BY user_id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS quiet, min(act) OVER (PARTITION BY user_id ORDER BY day ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING) AS ahead FROM a)
SELECT user_id, min(day) AS onset FROM b WHERE act = 1 AND quiet >= 2 AND ahead = 1 GROUP BY user_id""")
def _(t):
    m = t.events.groupBy("user_id", F.floor(S.micros(C("ts")) / 86400000000).alias("day")).agg(F.count("*").cast("double").alias("n"))
    return W.onset(m, ["user_id"], "day", "n", 1.0, 2, 2)


@query("wn15_confirmed_quarter", """
WITH q AS (SELECT DISTINCT concat(year(o_orderdate), 'Q', quarter(o_orderdate)) AS quarter FROM orders) SELECT quarter FROM q ORDER BY quarter DESC LIMIT 1 OFFSET 1""")
def _(t):
    return t.orders.select(S.quarter_of(C("o_orderdate")).alias("quarter")).distinct().orderBy(C("quarter").desc()).offset(1).limit(1)


@query("tk2_top3_per_cell", "SELECT l_returnflag, l_linestatus, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS n FROM lineitem) WHERE n <= 3")
def _(t):
    return W.top_by(t.lineitem, ["l_returnflag", "l_linestatus"], 3, C("l_extendedprice").desc(), C("l_orderkey"), C("l_linenumber")).select("l_returnflag", "l_linestatus", "l_orderkey", "l_linenumber")


@query("tk8_hash_sample", "SELECT c_mktsegment, c_custkey FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5(CAST(c_custkey AS VARCHAR)), c_custkey) AS n FROM customer) WHERE n <= 5")
def _(t):
    return W.top_by(t.customer, ["c_mktsegment"], 5, F.md5(C("c_custkey").cast("string").cast("binary")), C("c_custkey")).select("c_mktsegment", "c_custkey")


@query("tk9_nulls_last", "SELECT event_id, k FROM (SELECT event_id, nullif(CAST(json_extract(props, '$.k') AS BIGINT), 0) AS k FROM events) ORDER BY k DESC NULLS LAST, event_id LIMIT 100")
def _(t):
    return t.events.select("event_id", F.nullif(F.get_json_object("props", "$.k").cast("long"), F.lit(0)).alias("k")).orderBy(C("k").desc_nulls_last(), "event_id").limit(100)


@query("tk11_default_scope", "SELECT o_orderpriority AS scope FROM orders GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1")
def _(t):
    return t.orders.groupBy(C("o_orderpriority").alias("scope")).count().orderBy(C("count").desc(), "scope").limit(1).select("scope")


@query("tk12_latest_populated", """
SELECT c_custkey, o_orderkey FROM (SELECT c_custkey, o_orderkey, row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM customer JOIN orders ON c_custkey = o_custkey
WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)) WHERE n = 1""")
def _(t):
    o = t.orders.join(t.lineitem.select(C("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_semi")
    return W.first_by(t.customer.join(o, C("c_custkey") == C("o_custkey")), ["c_custkey"], C("o_orderdate").desc(), C("o_orderkey").desc()).select("c_custkey", "o_orderkey")


# --- set operations --------------------------------------------------------------------------------------------


@query("so1_union_padded", "SELECT c_custkey AS k, c_name AS name, c_acctbal AS balance, NULL AS size FROM customer UNION ALL SELECT p_partkey, p_name, NULL, p_size FROM part")
def _(t):
    a = t.customer.select(C("c_custkey").alias("k"), C("c_name").alias("name"), C("c_acctbal").alias("balance"))
    return a.unionByName(t.part.select(C("p_partkey").alias("k"), C("p_name").alias("name"), C("p_size").alias("size")), allowMissingColumns=True)


@query("so2_union_distinct", "SELECT c_nationkey AS n FROM customer UNION SELECT s_nationkey FROM supplier")
def _(t):
    return t.customer.select(C("c_nationkey").alias("n")).union(t.supplier.select("s_nationkey")).distinct()


@query("so3_key_except", "SELECT event_id, list_filter(json_keys(props), lambda x: x <> 'z') AS extra FROM events WHERE len(list_filter(json_keys(props), lambda x: x <> 'z')) > 0")
def _(t):
    return t.events.select("event_id", F.array_except(F.json_object_keys("props"), F.array(F.lit("z"))).alias("extra")).where(F.size("extra") > 0)


@query("so4_intersect", "SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT l_partkey FROM lineitem WHERE l_quantity > 49")
def _(t):
    return t.lineitem.where("l_returnflag = 'R'").select("l_partkey").intersect(t.lineitem.where("l_quantity > 49").select("l_partkey"))


@query("so6_dictionary_diff", """
WITH o AS (SELECT p_brand, p_name, max(p_size) AS s FROM part WHERE p_partkey % 3 <> 0 GROUP BY 1, 2), n AS (SELECT p_brand, p_name, max(p_size) AS s FROM part WHERE p_partkey % 5 <> 0 GROUP BY 1, 2)
SELECT coalesce(o.p_brand, n.p_brand) AS p_brand, coalesce(o.p_name, n.p_name) AS p_name, CASE WHEN o.p_brand IS NULL THEN 'added' WHEN n.p_brand IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM o FULL JOIN n ON o.p_brand = n.p_brand AND o.p_name = n.p_name WHERE o.s IS DISTINCT FROM n.s""")
def _(t):
    old, new = (t.part.where(f"p_partkey % {k} <> 0").groupBy("p_brand", "p_name").agg(F.max("p_size").alias("s")) for k in (3, 5))
    return J.reconcile(old, new, ["p_brand", "p_name"], ["s"])


# --- sinks -----------------------------------------------------------------------------------------------------


def _halves(t):
    old = t.customer.where("c_custkey % 3 <> 0").select("c_custkey", "c_name", "c_acctbal")
    new = t.customer.where("c_custkey % 2 = 0").select("c_custkey", F.upper("c_name").alias("c_name"), F.when(C("c_custkey") % 4 == 0, C("c_acctbal") + 1).alias("c_acctbal"))
    return old, new


_OLD_NEW = "WITH o AS (SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey % 3 <> 0), n AS (SELECT c_custkey, upper(c_name) AS c_name, CASE WHEN c_custkey % 4 = 0 THEN c_acctbal + 1 END AS c_acctbal FROM customer WHERE c_custkey % 2 = 0) "


@query("sk1_append_ignore", _OLD_NEW + "SELECT * FROM o UNION ALL SELECT * FROM n WHERE c_custkey NOT IN (SELECT c_custkey FROM o)")
def _(t):
    old, new = _halves(t)
    return K.append_ignore(old, new, ["c_custkey"], [C("c_name")])


@query("sk2_overwrite_upsert", _OLD_NEW + "SELECT * FROM n UNION ALL SELECT * FROM o WHERE c_custkey NOT IN (SELECT c_custkey FROM n)")
def _(t):
    return K.overwrite_upsert(*_halves(t), ["c_custkey"])


@query("sk3_coalesce_merge", _OLD_NEW + "SELECT coalesce(o.c_custkey, n.c_custkey) AS c_custkey, coalesce(n.c_acctbal, o.c_acctbal) AS c_acctbal, coalesce(o.c_name, n.c_name) AS c_name FROM o FULL JOIN n ON o.c_custkey = n.c_custkey")
def _(t):
    return K.coalesce_merge(*_halves(t), ["c_custkey"], ["c_acctbal"], ["c_name"])


@query("sk4_conditional_upsert", _OLD_NEW + """
SELECT coalesce(o.c_custkey, n.c_custkey) AS c_custkey, CASE WHEN o.c_name IS NULL OR (n.c_name IS NOT NULL AND n.c_acctbal > o.c_acctbal) THEN n.c_name ELSE o.c_name END AS c_name,
CASE WHEN o.c_name IS NULL OR (n.c_name IS NOT NULL AND n.c_acctbal > o.c_acctbal) THEN n.c_acctbal ELSE o.c_acctbal END AS c_acctbal FROM o FULL JOIN n ON o.c_custkey = n.c_custkey""")
def _(t):
    return K.conditional_upsert(*_halves(t), ["c_custkey"], ["c_name", "c_acctbal"], C("new.c_acctbal") > C("old.c_acctbal"))


@query("sk5_replace_slice", "SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '5-LOW') UNION ALL SELECT o_orderkey, o_orderpriority, -o_totalprice FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW') AND o_orderstatus = 'F'")
def _(t):
    old = t.orders.select("o_orderkey", "o_orderpriority", "o_totalprice")
    new = t.orders.where("o_orderpriority in ('1-URGENT', '5-LOW') and o_orderstatus = 'F'").select("o_orderkey", "o_orderpriority", (-C("o_totalprice")).alias("o_totalprice"))
    return K.replace_slice(old, new, ["o_orderpriority"])


@query("sk6_withdraw", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority <> '1-URGENT' OR o_totalprice > 200000")
def _(t):
    o = t.orders.select("o_orderkey", "o_orderpriority")
    return K.withdraw(o, t.orders.where("o_totalprice > 200000").select("o_orderkey"), ["o_orderkey"], "o_orderpriority", ["1-URGENT"])


@query("sk7_tail_prune", "SELECT c.conv_id, c.turn FROM conversations c LEFT JOIN (SELECT conv_id, max(turn) AS size FROM conversations WHERE conv_id % 2 = 0 GROUP BY 1) s ON c.conv_id = s.conv_id WHERE size IS NULL OR c.turn < size")
def _(t):
    sizes = t.conversations.where("conv_id % 2 = 0").groupBy("conv_id").agg(F.max("turn").alias("size"))
    return K.tail_prune(t.conversations.select("conv_id", "turn"), sizes, "conv_id", "turn", "size")


@query("sk8_orphans", "SELECT DISTINCT p_brand, p_type FROM part EXCEPT (SELECT p_brand, p_type FROM part WHERE p_size > 10 UNION SELECT p_brand, p_type FROM part WHERE p_retailprice > 1500)")
def _(t):
    return K.orphans(t.part, t.part.where("p_size > 10"), t.part.where("p_retailprice > 1500"), key=["p_brand", "p_type"])
