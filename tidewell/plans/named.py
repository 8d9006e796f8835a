"""Queries of operators that others use inside, each by itself."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.scalars import ratio
from ..operators import metrics as M
from ..operators import retrieval as R
from ..operators import sinks as K
from ..operators import trend as T
from ..operators.api import page_rows
from .base import Catalog
from .metrics import _MENTIONS, _ORDERS, _TREND, mentions, quarter_rows, trend
from .text import _POSTINGS, index, terms

catalog = Catalog()
query = catalog.query
C = F.col


@query("ag1_need_totals", f"WITH {_MENTIONS} SELECT scope, need_key, count(CASE WHEN polarity = 'neg' THEN 1 END) AS neg, count(CASE WHEN polarity = 'pos' THEN 1 END) AS pos, count(DISTINCT CASE WHEN polarity = 'neg' THEN ref END) AS neg_refs FROM m GROUP BY 1, 2")
def _(t):
    return M.need_metrics(mentions(t), [[]], ["month"]).select("scope", "need_key", "neg", "pos", "neg_refs")


@query("ag3_unresolved_ratio", f"WITH {_MENTIONS} SELECT scope, need_key, month, count(CASE WHEN polarity = 'neg' THEN 1 END) * 1.0 / count(*) AS unresolved FROM m GROUP BY 1, 2, 3")
def _(t):
    return M.need_metrics(mentions(t), [["month"]], ["month"]).select("scope", "need_key", "month", "unresolved")


@query("ag6_population_share", f"WITH {_MENTIONS}, n AS (SELECT scope, need_key, product, count(*) AS n FROM m GROUP BY 1, 2, 3), d AS (SELECT product, count(*) AS total FROM m WHERE CAST(product AS INT) % 7 <> 0 GROUP BY 1) SELECT scope, need_key, product, CASE WHEN total > 0 THEN n * 1.0 / total END AS share FROM n LEFT JOIN d USING (product)")
def _(t):
    m = mentions(t)
    n = m.groupBy("scope", "need_key", "product").agg(F.count("*").alias("n"))
    # a product whose population was not collected has no share, not a share of 0
    d = m.where(C("product").cast("int") % 7 != 0).groupBy("product").agg(F.count("*").alias("total"))
    return n.join(d, "product", "left").select("scope", "need_key", "product", ratio(C("n"), C("total")).alias("share"))


@query("ag7_strength_of_needs", f"WITH {_MENTIONS} SELECT scope, need_key, avg(CASE WHEN polarity = 'neg' THEN strength END) AS strength_mean, count(CASE WHEN polarity = 'neg' AND strength >= 0.06 THEN 1 END) * 1.0 / nullif(count(CASE WHEN polarity = 'neg' THEN 1 END), 0) AS strong_share FROM m GROUP BY 1, 2")
def _(t):
    return M.need_metrics(mentions(t), [[]], ["month"]).select("scope", "need_key", "strength_mean", "strong_share")


@query("ag20_topic_channel_counts", f"WITH {_ORDERS} SELECT topic, quarter, channel, count(*) AS n FROM o WHERE status <> 'P' GROUP BY 1, 2, 3")
def _(t):
    return quarter_rows(t).where("status <> 'P'").groupBy("topic", "quarter", "channel").agg(F.count("*").alias("n"))


@query("ag23_median_baselines", f"WITH {_TREND} SELECT DISTINCT topic, baseline FROM q")
def _(t):
    return trend(t).select("topic", "baseline").distinct()


@query("ag25_unique_ratios", f"WITH {_TREND} SELECT topic, quarter, unique_ratio FROM q")
def _(t):
    return trend(t).select("topic", "quarter", "unique_ratio")


@query("ag28_filtered_counts", "SELECT l_suppkey, count(*) FILTER (WHERE l_returnflag = 'R') AS returned, count(DISTINCT l_orderkey) FILTER (WHERE l_discount > 0.05) AS cheap_orders, sum(l_quantity) FILTER (WHERE l_linestatus = 'O') AS open_quantity, bool_or(l_tax > 0.07) FILTER (WHERE l_quantity > 40) AS any_taxed FROM lineitem GROUP BY 1")
def _(t):
    return t.lineitem.groupBy("l_suppkey").agg(
        F.count_if(C("l_returnflag") == "R").alias("returned"), F.count_distinct(F.when(C("l_discount") > 0.05, C("l_orderkey"))).alias("cheap_orders"), F.sum(F.when(C("l_linestatus") == "O", C("l_quantity"))).alias("open_quantity"),
        F.bool_or(F.when(C("l_quantity") > 40, C("l_tax") > 0.07)).alias("any_taxed"),
    )


@query("ag34_evidence_strength", f"""WITH {_TREND} SELECT topic, quarter, round(43.75 * (rank() OVER w - 1 + count(*) OVER (PARTITION BY quarter ORDER BY mentions RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) / 2.0 / count(*) OVER (PARTITION BY quarter) + 31.25 * least(1.0, breadth) + 25.0 * least(1.0, unique_ratio), 1) AS strength FROM q WINDOW w AS (PARTITION BY quarter ORDER BY mentions)""")
def _(t):
    return T.judged(trend(t)).select("topic", "quarter", "strength")


@query("wn1_group_sizes", "SELECT l_orderkey, l_linenumber, count(*) OVER (PARTITION BY l_orderkey) AS lines, count(CASE WHEN l_returnflag = 'R' THEN 1 END) OVER (PARTITION BY l_orderkey) AS returned FROM lineitem")
def _(t):
    w = Window.partitionBy("l_orderkey")
    return t.lineitem.select("l_orderkey", "l_linenumber", F.count("*").over(w).alias("lines"), F.count_if(C("l_returnflag") == "R").over(w).alias("returned"))


@query("wn2_row_numbers", "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS n FROM orders")
def _(t):
    return t.orders.select("o_custkey", "o_orderkey", F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), "o_orderkey")).cast("long").alias("n"))


@query("wn10_positional_ranks", "WITH n AS (SELECT p_brand, p_type, count(*) AS n, min(p_partkey) AS first FROM part GROUP BY 1, 2) SELECT p_brand, p_type, n, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, first) AS rank FROM n")
def _(t):
    # equal counts keep the order in which they were first seen
    n = t.part.groupBy("p_brand", "p_type").agg(F.count("*").alias("n"), F.min("p_partkey").alias("first"))
    return n.select("p_brand", "p_type", "n", F.row_number().over(Window.partitionBy("p_brand").orderBy(F.desc("n"), "first")).cast("long").alias("rank"))


@query("tk1_mixed_order", "SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment DESC, c_acctbal, c_custkey DESC) AS place FROM customer")
def _(t):
    w = Window.partitionBy("c_nationkey").orderBy(F.desc("c_mktsegment"), "c_acctbal", F.desc("c_custkey"))
    return t.customer.select("c_custkey", F.row_number().over(w).cast("long").alias("place"))


@query("tk5_bm25_top", f"""WITH {_POSTINGS}, d AS (SELECT term, count(*) AS df FROM x GROUP BY 1), s AS (SELECT query, doc_id, round(sum(greatest(0, ln((n - df + 0.5) / (df + 0.5) + 1)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / average))), 4) AS score FROM x JOIN d USING (term) JOIN qt USING (term), z GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc_id) AS place FROM s WHERE score > 0) SELECT query, doc_id, place FROM r WHERE place <= 3""")
def _(t):
    return R.bm25(index(t), terms(t), "doc_id", 3).select("query", "doc_id", C("place").cast("long").alias("place"))


_DOT = "list_sum(list_transform(list_zip(embedding, e), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE)))"


@query("tk6_masked_vector_top", f"""WITH q AS (SELECT vec_id AS query, embedding AS e FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT query, vec_id AS doc_id, {_DOT} AS similarity FROM embeddings, q WHERE label IN (1, 3) AND vec_id % 9 <> 4), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, doc_id) AS place FROM s) SELECT query, doc_id, place FROM r WHERE place <= 5""")
def _(t):
    q = t.embeddings.where(C("vec_id") % 50 == 0).select(C("vec_id").alias("q"), C("embedding").alias("v"))
    # every ninth vector is no number, and goes
    broken = F.when(C("vec_id") % 9 == 4, F.transform("embedding", lambda x: F.lit(float("nan")).cast("float"))).otherwise(C("embedding"))
    store = t.embeddings.select(C("vec_id").alias("doc_id"), broken.alias("embedding"), "label")
    return R.vector_search(store, "doc_id", "embedding", q, "q", "v", 5, C("label").isin(1, 3)).select("query", "doc_id", C("place").cast("long").alias("place"))


@query("tk10_pages", """WITH p AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC NULLS LAST, o_orderkey) - 1 AS k FROM orders WHERE o_orderstatus = 'F'), n AS (SELECT count(*) AS n FROM p), f AS (SELECT o_orderkey, CAST(k // 7 AS INT) AS page FROM p WHERE k < 21) SELECT page, o_orderkey, CASE WHEN (page + 1) * 7 < n THEN (page + 1) * 7 END AS next_offset FROM f, n""")
def _(t):
    out = None
    for page in range(3):
        rows = page_rows(t.orders, ["o_orderkey"], [("o_orderstatus", "eq", "F")], [("o_totalprice", "desc"), ("o_orderkey", "asc")], 7, 7 * page)
        rows = rows.select(F.lit(page).alias("page"), "o_orderkey", "next_offset")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("so7_distinct_projection", "SELECT DISTINCT o_orderpriority, o_orderstatus FROM orders")
def _(t):
    return t.orders.select("o_orderpriority", "o_orderstatus").distinct()


@query("j3_used_mentions", "SELECT l_orderkey, l_linenumber, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN (SELECT p_partkey FROM part WHERE p_size % 2 = 0) p ON l_partkey = p_partkey")
def _(t):
    used = t.part.where(C("p_size") % 2 == 0).select(C("p_partkey").alias("l_partkey"))
    return t.lineitem.join(used, "l_partkey", "left_semi").join(t.orders.select(C("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey").select("l_orderkey", "l_linenumber", "o_custkey")


@query("j35_seen_and_held_out", "SELECT doc_id, doc_id IN (SELECT doc_id FROM labels) AS seen FROM documents WHERE coalesce(text, '') <> ''")
def _(t):
    # rows without a text make no piece, so they are in neither arm
    roster = t.labels.select("doc_id").distinct().withColumn("there", F.lit(True))
    return t.documents.where(F.coalesce("text", F.lit("")) != "").join(roster, "doc_id", "left").select("doc_id", C("there").isNotNull().alias("seen"))


@query("j36_orphans", "SELECT DISTINCT p_brand, p_type FROM part p WHERE NOT EXISTS (SELECT 1 FROM part u WHERE u.p_size > 40 AND u.p_brand = p.p_brand AND u.p_type = p.p_type) AND NOT EXISTS (SELECT 1 FROM part u WHERE u.p_size < 5 AND u.p_brand = p.p_brand AND u.p_type = p.p_type)")
def _(t):
    return K.orphans(t.part, t.part.where("p_size > 40"), t.part.where("p_size < 5"), key=["p_brand", "p_type"])


@query("j42_postings_of_queries", f"WITH {_POSTINGS} SELECT query, term, doc_id, tf, length FROM x JOIN qt USING (term)")
def _(t):
    q = terms(t)
    return index(t).of(q).join(F.broadcast(q), "term").select("query", "term", "doc_id", "tf", "length")


@query("pf23_changed_rows", "WITH a AS (SELECT p_partkey, CASE WHEN p_size % 3 <> 0 THEN p_size % 4 END AS x, CASE WHEN p_size % 5 <> 0 THEN p_size % 4 END AS y FROM part) SELECT p_partkey FROM a WHERE x IS DISTINCT FROM y")
def _(t):
    x, y = F.when(C("p_size") % 3 != 0, C("p_size") % 4), F.when(C("p_size") % 5 != 0, C("p_size") % 4)
    return t.part.where(~x.eqNullSafe(y)).select("p_partkey")
