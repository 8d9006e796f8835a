"""Queries of run ledgers, cells' lineage, readings and small lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ledger as G
from .base import Catalog

catalog = Catalog()
query = catalog.query
C = F.col


@query("sc4_cutoff_scan", "SELECT k.cutoff, count(*) AS rows, max(ts) AS newest FROM events JOIN (VALUES (TIMESTAMP '2024-01-08'), (TIMESTAMP '2024-01-20')) k(cutoff) ON ts <= k.cutoff GROUP BY 1")
def _(t):
    parts = [t.events.where(C("ts") <= F.lit(c).cast("timestamp_ntz")).agg(F.lit(c).cast("timestamp_ntz").alias("cutoff"), F.count("*").alias("rows"), F.max(C("ts").cast("timestamp_ntz")).alias("newest")) for c in ("2024-01-08", "2024-01-20")]
    return parts[0].unionByName(parts[1]).where("rows > 0")


@query("sc6_active_singleton_guarded", "SELECT n_regionkey, CASE WHEN min(n_nationkey) % 2 = 0 THEN min(n_nationkey) END AS n_nationkey FROM nation GROUP BY 1")
def _(t):
    first = t.nation.groupBy("n_regionkey").agg(F.min("n_nationkey").alias("first"))
    return G.active_singleton(t.nation.join(first, "n_regionkey"), "n_regionkey", (C("n_nationkey") == C("first")) & (C("first") % 2 == 0), "n_nationkey")


_LEDGER = "l AS (SELECT o_orderkey AS run_id, concat_ws('/', o_orderpriority, o_orderstatus) AS note FROM orders WHERE o_orderstatus <> 'P'), w AS (SELECT DISTINCT concat_ws('/', o_orderpriority, o_orderstatus) AS note FROM orders UNION SELECT DISTINCT c_mktsegment FROM customer)"


@query("sc7_reopened_runs", f"WITH {_LEDGER}, f AS (SELECT note, min(run_id) AS run_id FROM l GROUP BY 1), n AS (SELECT note, row_number() OVER (ORDER BY note) AS k FROM w WHERE note NOT IN (SELECT note FROM f)) SELECT note, run_id, true AS reopened FROM f JOIN w USING (note) UNION ALL SELECT note, (SELECT max(run_id) FROM l) + k, false FROM n")
def _(t):
    note = F.concat_ws("/", "o_orderpriority", "o_orderstatus").alias("note")
    runs = t.orders.where("o_orderstatus <> 'P'").select(C("o_orderkey").alias("run_id"), note)
    return G.run_of_note(runs, t.orders.select(note).unionByName(t.customer.select(C("c_mktsegment").alias("note"))))


@query("dc21_remainder_first_batches", "WITH p AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS k, count(*) OVER () AS n FROM orders) SELECT o_orderkey, CAST((k + (7 - n % 7) % 7) // 7 AS BIGINT) AS batch FROM p")
def _(t):
    return G.request_batches(t.orders.select("o_orderkey"), "o_orderkey", 7)


# mentions: a line item is one of its order's priority (category), of its flag (need), folded over the flags R and A in the rollup
_CELLS = [{"scope": "all", "need_key": "RA", "month": None, "product_ref": None}, {"scope": "1-URGENT", "need_key": "R", "month": None, "product_ref": None}, {"scope": "all", "need_key": "N", "month": "1997-03", "product_ref": None}, {"scope": "5-LOW", "need_key": "N", "month": "1998-01", "product_ref": "7"}]
_MENTIONS = "m AS (SELECT o_orderpriority AS category, l_returnflag AS need_key, CASE WHEN l_returnflag = 'N' THEN 'N' ELSE 'RA' END AS rollup, CASE WHEN l_linenumber <= 2 THEN 'generic' ELSE 'category' END AS aspect_scope, strftime(l_shipdate, '%Y-%m') AS month, CAST(l_partkey AS VARCHAR) AS product_axis, CASE WHEN l_quantity > 25 THEN 'v1' WHEN l_quantity > 5 THEN 'v2' ELSE 'v0' END AS ext, CASE WHEN l_linestatus = 'F' THEN 'wish' ELSE 'need' END AS kind FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"


@query("pf18_cell_lineage", f"""WITH {_MENTIONS}, x AS (SELECT * FROM m WHERE kind = 'need' AND ext IN ('v1', 'v2'))
SELECT 0 AS cell, count(*) AS n FROM x WHERE rollup = 'RA' AND aspect_scope = 'generic' UNION ALL SELECT 1, count(*) FROM x WHERE category = '1-URGENT' AND need_key = 'R'
UNION ALL SELECT 2, count(*) FROM x WHERE rollup = 'N' AND aspect_scope = 'generic' AND month = '1997-03' UNION ALL SELECT 3, count(*) FROM x WHERE category = '5-LOW' AND need_key = 'N' AND month = '1998-01' AND product_axis = '7'""")
def _(t):
    m = t.lineitem.join(t.orders, C("l_orderkey") == C("o_orderkey")).select(
        C("o_orderpriority").alias("category"), C("l_returnflag").alias("need_key"), F.when(C("l_returnflag") == "N", "N").otherwise("RA").alias("need_key_rollup"), F.when(C("l_linenumber") <= 2, "generic").otherwise("category").alias("aspect_scope"),
        F.date_format("l_shipdate", "yyyy-MM").alias("month"), C("l_partkey").cast("string").alias("product_axis"), F.when(C("l_quantity") > 25, "v1").when(C("l_quantity") > 5, "v2").otherwise("v0").alias("extractor_version"), F.when(C("l_linestatus") == "F", "wish").otherwise("need").alias("kind"),
    )
    counts = m.agg(*[F.count_if(G.need_cell(c, ["v1", "v2"])).alias(str(i)) for i, c in enumerate(_CELLS)])
    return counts.select(F.posexplode(F.array(*[C(str(i)) for i in range(len(_CELLS))])).alias("cell", "n"))


@query("ag5_denominators", "SELECT b.p_brand, CASE WHEN count(p.p_partkey) > 0 THEN coalesce(sum(CASE WHEN p.p_size % 3 = 0 THEN coalesce(p.p_size, 0) END), 0) END AS low, CASE WHEN count(p.p_partkey) > 0 THEN count(CASE WHEN p.p_size % 3 = 0 THEN 1 END) END AS parts FROM (SELECT DISTINCT p_brand FROM part) b LEFT JOIN (SELECT * FROM part WHERE p_size > 47) p ON b.p_brand = p.p_brand GROUP BY 1")
def _(t):
    return G.denominators(t.part, t.part.where("p_size > 47").withColumn("one", F.lit(1)), "p_brand", C("p_size") % 3 == 0, {"low": "p_size", "parts": "one"})


@query("ag27_first_of_ordered", "SELECT l_orderkey, first(l_partkey ORDER BY l_shipdate, l_partkey) AS part FROM lineitem GROUP BY 1")
def _(t):
    return t.lineitem.groupBy("l_orderkey").agg(F.min(F.struct("l_shipdate", "l_partkey"))["l_partkey"].alias("part"))


@query("tk15_latest_run", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1")
def _(t):
    return t.orders.where("o_orderstatus = 'F'").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(1).select("o_orderkey", C("o_orderdate").cast("timestamp_ntz").alias("o_orderdate"))


@query("j19_stage_latest_rows", "WITH s AS (SELECT DISTINCT event_type FROM events UNION SELECT 'never'), a AS (SELECT event_type, max_by(event_id, (ts, event_id)) AS last_run FROM events GROUP BY 1), b AS (SELECT event_type, max_by(event_id, (ts, event_id)) AS last_ran FROM events WHERE value > 50 GROUP BY 1) SELECT * FROM s LEFT JOIN a USING (event_type) LEFT JOIN b USING (event_type)")
def _(t):
    stages = t.events.select("event_type").distinct().unionByName(t.spark.createDataFrame([("never",)], "event_type string"))
    latest = lambda df, name: df.groupBy("event_type").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias(name))
    return stages.join(latest(t.events, "last_run"), "event_type", "left").join(latest(t.events.where("value > 50"), "last_ran"), "event_type", "left")


@query("j38_rows_with_product", "SELECT l_orderkey, l_linenumber, p_name, p_brand FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size < 40) p ON l_partkey = p_partkey")
def _(t):
    return t.lineitem.join(t.part.where("p_size < 40"), C("l_partkey") == C("p_partkey"), "left").select("l_orderkey", "l_linenumber", "p_name", "p_brand")


@query("j43_gold_against_predictions", "WITH g AS (SELECT doc_id, quality AS gold FROM labels WHERE quality IS NOT NULL), p AS (SELECT doc_id, CAST(n_chars > 200 AS INT) AS said FROM documents) SELECT count(*) AS golds, count(said) AS met, count(CASE WHEN gold = said THEN 1 END) AS agreed FROM g LEFT JOIN p USING (doc_id)")
def _(t):
    met = t.labels.where("quality is not null").select("doc_id", C("quality").alias("gold")).join(t.documents.select("doc_id", (C("n_chars") > 200).cast("int").alias("said")), "doc_id", "left")
    return met.agg(F.count("*").alias("golds"), F.count("said").alias("met"), F.count_if(C("gold") == C("said")).alias("agreed"))


@query("j44_texts_of_ids", "SELECT doc_id, md5(text) AS digest FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def _(t):
    ids = t.labels.where("toxic = 1").select("doc_id").distinct()
    return t.documents.join(ids, "doc_id", "left_semi").select("doc_id", F.md5(C("text").cast("binary")).alias("digest"))


@query("pf11_quotable", "SELECT event_id FROM events e WHERE value >= 10 AND user_id % 10 <> 3 AND (event_type, user_id % 10) IN (SELECT event_type, user_id % 10 FROM events GROUP BY 1, 2 HAVING count(*) >= 20)")
def _(t):
    e = t.events.withColumn("cell", C("user_id") % 10)
    judged = e.groupBy("event_type", "cell").agg(F.count("*").alias("n")).where("n >= 20").select("event_type", "cell")
    return e.where((C("value") >= 10) & (C("cell") != 3)).join(judged, ["event_type", "cell"], "left_semi").select("event_id")


@query("pf12_axes_in_rule", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority <> ALL (SELECT unnest(['5-LOW', '3-MEDIUM']))")
def _(t):
    return t.orders.where(~C("o_orderpriority").isin("5-LOW", "3-MEDIUM")).select("o_orderkey", "o_orderpriority")


_SHARES = "s AS (SELECT o_orderpriority AS topic, c_nationkey AS cell, 100.0 * count(CASE WHEN o_orderstatus = 'F' THEN 1 END) / count(*) AS a, 100.0 * count(CASE WHEN o_orderstatus = 'O' THEN 1 END) / count(*) AS b, 100.0 * count(CASE WHEN o_orderstatus = 'P' THEN 1 END) / count(*) AS c FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"


def shares(t):
    g = t.orders.join(t.customer, C("o_custkey") == C("c_custkey")).groupBy(C("o_orderpriority").alias("topic"), C("c_nationkey").alias("cell"))
    return g.agg(*[(F.lit(100.0) * F.count_if(C("o_orderstatus") == x) / F.count("*")).alias(n) for n, x in (("a", "F"), ("b", "O"), ("c", "P"))])


@query("dc5_share_readings", f"""WITH {_SHARES} SELECT topic, cell, CASE WHEN b >= 20 AND a < 25 THEN 'consumer only' WHEN b - a >= 20 THEN 'consumer lead' WHEN a - b >= 20 THEN 'creator lead' WHEN b > 0 AND a < 40 AND c > a * 0.8 THEN 'comment only' ELSE '' END AS reading,
CASE WHEN a > 45 AND b >= 30 THEN 'gap, happy' WHEN a > 45 THEN 'gap, unhappy' WHEN b >= 30 THEN 'saturated' ELSE 'quiet, unhappy' END AS rating FROM s""")
def _(t):
    return shares(t).select("topic", "cell", G.share_reading(C("a"), C("b"), C("c"), 20, 25, 40, 0.8).alias("reading"), G.rating_reading(C("b"), C("a"), 30, 45).alias("rating"))


@query("dc5_holdout_verdicts", f"""WITH {_SHARES}, d AS (SELECT cell, topic, a - b AS diff, CASE WHEN a > 30 THEN rank() OVER (PARTITION BY cell ORDER BY a DESC, topic) END AS ra, CASE WHEN b > 30 THEN rank() OVER (PARTITION BY cell ORDER BY b DESC, topic) END AS rb FROM s),
g AS (SELECT cell, count(CASE WHEN ra IS NOT NULL AND rb IS NOT NULL THEN 1 END) AS n, max(CASE WHEN ra IS NOT NULL AND rb IS NOT NULL THEN abs(diff) END) AS most, list(topic ORDER BY ra) FILTER (ra IS NOT NULL AND rb IS NOT NULL) AS x, list(topic ORDER BY rb) FILTER (ra IS NOT NULL AND rb IS NOT NULL) AS y FROM d GROUP BY 1)
SELECT cell, CASE WHEN n = 0 THEN 'thin' WHEN most <= 6 THEN 'reproduced' WHEN x[1:2] = y[1:2] THEN 'rank only' ELSE 'broken' END AS verdict FROM g""")
def _(t):
    from pyspark.sql import Window

    ranked = lambda c: F.when(C(c) > 30, F.rank().over(Window.partitionBy("cell").orderBy(F.desc(c), "topic")))
    rows = shares(t).select("cell", "topic", (C("a") - C("b")).alias("rate_diff"), ranked("a").alias("seen_rank"), ranked("b").alias("holdout_rank"))
    return G.holdout_verdict(rows, "cell", 2, 6)


def status_edges(t):
    """Steps between an order's priority and its status, one way for finished orders and the other for open ones."""
    o = t.orders.select(C("o_orderpriority").alias("p"), C("o_orderstatus").alias("s"))
    return o.where("s = 'F'").select(C("p").alias("a"), C("s").alias("b")).unionByName(o.where("s = 'O'").select(C("s").alias("a"), C("p").alias("b"))).unionByName(t.spark.createDataFrame([("F", "O")], "a string, b string")).distinct()


@query("gr3_feedback_edges")
def _(t):
    from ..operators.graph import feedback_table

    return feedback_table(status_edges(t), "a", "b")
