"""Queries of rules over whole tables, loaders, outputs and predictors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import registry as P
from ..operators import launch as L
from ..operators import names as N
from ..operators import retrieval as Q
from ..operators import rules as R
from ..operators import text as X
from ..operators import trend as T
from ..shared import shared_path
from ..sources import loaders as S
from .base import Catalog
from .metrics import _ORDERS, quarter_rows

catalog = Catalog()
query = catalog.query
C = F.col


@query("pf16_trusted_months", """WITH r AS (SELECT strftime(l_shipdate, '%Y-%m') AS month, l_returnflag AS need, l_linestatus = 'F' AS low, NOT (l_shipdate BETWEEN TIMESTAMP '1995-03-02' AND TIMESTAMP '1996-08-30' AND l_suppkey % 20 = 3) AS ok FROM lineitem)
SELECT month, need, CASE WHEN bool_and(all_ok) THEN count(*) END AS n, CASE WHEN bool_and(all_ok) THEN count(CASE WHEN low THEN 1 END) END AS low FROM (SELECT *, min(CAST(ok AS INT)) OVER (PARTITION BY month) = 1 AS all_ok FROM r) GROUP BY 1, 2""")
def _(t):
    ok = ~(C("l_shipdate").between(F.lit("1995-03-02").cast("timestamp_ntz"), F.lit("1996-08-30").cast("timestamp_ntz")) & (C("l_suppkey") % 20 == 3))
    rows = t.lineitem.withColumns({"month": F.date_format("l_shipdate", "yyyy-MM"), "need": C("l_returnflag")})
    return R.trusted_months(rows, "month", ["need"], ok, {"n": F.lit(True), "low": C("l_linestatus") == "F"})


_PANEL = f"""WITH {_ORDERS}, c AS (SELECT topic, quarter, CAST(substr(quarter, 1, 4) AS INT) * 4 + CAST(right(quarter, 1) AS INT) - 1 AS i, count(CASE WHEN status <> 'P' AND channel IN ('BUILDING', 'MACHINERY') THEN 1 END) AS product, count(*) AS every FROM o GROUP BY 1, 2, 3),
l AS (SELECT max(i) AS l, count(DISTINCT quarter) AS quarters FROM c WHERE product > 0), w AS (SELECT topic, sum(CASE WHEN l - i BETWEEN 5 AND 8 AND product > 0 THEN product END) AS pp, sum(CASE WHEN l - i BETWEEN 1 AND 4 AND product > 0 THEN product END) AS pr, sum(CASE WHEN l - i BETWEEN 5 AND 8 THEN every END) AS ep, sum(CASE WHEN l - i BETWEEN 1 AND 4 THEN every END) AS er,
 count(CASE WHEN product >= {{least}} THEN 1 END) AS okp, count(CASE WHEN every >= {{least}} THEN 1 END) AS oka FROM c, l GROUP BY 1), s AS (SELECT *, coalesce(100.0 * pr / sum(pr) OVER (), 0) - coalesce(100.0 * pp / sum(pp) OVER (), 0) AS a, coalesce(100.0 * er / sum(er) OVER (), 0) - coalesce(100.0 * ep / sum(ep) OVER (), 0) AS b FROM w)"""


@query("ag36_panel_sensitivity", _PANEL.replace("{least}", "3") + " SELECT topic, okp AS quarters_ok_product, oka AS quarters_ok_all, round(a, 2) AS delta_product_pp, round(b, 2) AS delta_all_pp, round(b - a, 2) AS difference_pp, 2 * okp > quarters AS sample_ok, 2 * okp > quarters AND round(a, 2) * round(b, 2) < 0 AND greatest(abs(round(a, 2)), abs(round(b, 2))) >= 0.5 AS flipped FROM s, l")
def _(t):
    counts = quarter_rows(t).groupBy("topic", "quarter").agg(F.count_if((C("status") != "P") & C("channel").isin("BUILDING", "MACHINERY")).alias("product"), F.count("*").alias("every"))
    return R.panel_sensitivity(counts, 3, 0.5)


_VARIANTS = _ORDERS.replace("o_orderstatus AS status", "o_orderstatus AS status, o_orderkey % 7 = 0 AS ad, o_orderkey % 5 = 0 AS promo") + """, vs AS (SELECT 'base' AS variant UNION ALL SELECT 'ad' UNION ALL SELECT 'promo' UNION ALL SELECT 'both'), ov AS (SELECT * FROM o, vs WHERE NOT (variant IN ('ad', 'both') AND ad) AND NOT (variant IN ('promo', 'both') AND promo)),
n AS (SELECT variant, topic, quarter, count(*) FILTER (WHERE status <> 'P') AS mentions, count(*) AS raw FROM ov GROUP BY 1, 2, 3), g AS (SELECT variant, topic, quarter, coalesce(mentions, 0) AS mentions, coalesce(raw, 0) AS raw FROM (SELECT * FROM vs CROSS JOIN (SELECT DISTINCT topic FROM o) CROSS JOIN (SELECT DISTINCT quarter FROM o)) LEFT JOIN n USING (variant, topic, quarter)),
c AS (SELECT *, coalesce(mentions * 1.0 / nullif(sum(mentions) OVER (PARTITION BY variant, quarter), 0), 0) AS composition FROM g), b AS (SELECT variant, topic, median(composition) AS baseline FROM c GROUP BY 1, 2), ch AS (SELECT variant, topic, quarter, count(DISTINCT channel) AS parts FROM ov WHERE status <> 'P' GROUP BY 1, 2, 3), pn AS (SELECT variant, quarter, count(DISTINCT channel) AS total FROM ov GROUP BY 1, 2),
q AS (SELECT variant, topic, quarter, mentions, composition, sum(CASE WHEN composition > baseline THEN 1 ELSE 0 END) OVER w AS above, count(*) OVER w AS "window", coalesce(coalesce(parts, 0) * 1.0 / total, 0) AS breadth, coalesce(mentions * 1.0 / nullif(raw, 0), 1) AS unique_ratio
 FROM c JOIN b USING (variant, topic) LEFT JOIN ch USING (variant, topic, quarter) LEFT JOIN pn USING (variant, quarter) WINDOW w AS (PARTITION BY variant, topic ORDER BY quarter ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)),
s AS (SELECT *, (rank() OVER w - 1 + count(*) OVER (PARTITION BY variant, quarter ORDER BY mentions RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) / 2.0 / count(*) OVER (PARTITION BY variant, quarter) AS mid FROM q WINDOW w AS (PARTITION BY variant, quarter ORDER BY mentions)),
v AS (SELECT *, round(43.75 * mid + 31.25 * least(1.0, breadth) + 25.0 * least(1.0, unique_ratio), 1) AS strength, lag(composition) OVER t AS prev, max(composition) OVER (PARTITION BY variant, topic ORDER BY quarter ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS m3, max(composition) OVER (PARTITION BY variant, topic) AS peak FROM s WINDOW t AS (PARTITION BY variant, topic ORDER BY quarter)),
d AS (SELECT variant, topic, quarter, CASE WHEN strength < 50 THEN 'thin' WHEN m3 < 0.01 THEN 'new' WHEN above = "window" AND "window" = 4 THEN 'persistent' WHEN (composition - prev) / nullif(prev, 0) >= 0.35 THEN 'rising' WHEN (composition - prev) / nullif(prev, 0) <= -0.35 THEN 'falling' WHEN composition = peak THEN 'peak' ELSE 'steady' END AS verdict FROM v)"""


@query("ag38_variant_verdicts", f"WITH {_VARIANTS} SELECT x.variant, b.topic, count(*) AS judged, count(CASE WHEN d.verdict <> 'thin' AND d.verdict <> b.verdict THEN 1 END) AS flipped, count(CASE WHEN d.verdict = 'thin' THEN 1 END) AS lost FROM d b, (SELECT variant FROM vs WHERE variant <> 'base') x JOIN d ON d.variant = x.variant AND d.topic = b.topic AND d.quarter = b.quarter WHERE b.variant = 'base' AND b.verdict <> 'thin' GROUP BY 1, 2")
def _(t):
    c = t.customer.select(C("c_custkey").alias("o_custkey"), C("c_mktsegment").alias("channel"))
    from ..functions.scalars import quarter_of

    o = t.orders.join(c, "o_custkey").select(C("o_orderpriority").alias("topic"), quarter_of(C("o_orderdate")).alias("quarter"), "channel", C("o_orderstatus").alias("status"), "o_orderkey")
    ad, promo = C("o_orderkey") % 7 == 0, C("o_orderkey") % 5 == 0
    v = R.variants(o, {"ad": ad, "promo": promo, "both": ad | promo})
    n = v.groupBy("variant", "topic", "quarter").agg(F.count_if(C("status") != "P").alias("mentions"), F.count("*").alias("raw"))
    names = t.spark.createDataFrame([(x,) for x in ("base", "ad", "promo", "both")], "variant string")
    grid = T.dense_grid(o.select("topic").distinct().crossJoin(F.broadcast(names)), o.select("quarter").distinct(), n, ["variant", "topic", "quarter"], {"mentions": 0, "raw": 0})
    channels = v.where("status <> 'P'").groupBy("variant", "topic", "quarter", "channel").agg(F.count("*").alias("n"))
    m = T.quarter_metrics(grid, v.groupBy("variant", "quarter").agg(F.count_distinct("channel").alias("channels_total")), channels, ["variant"])
    return R.verdict_changes(T.judged(m, by=["variant"]), ["topic", "quarter"], ["topic"])


_CONFIRMED = [("Brand#1", "small ring", "negative"), ("Brand#1", "red widget", "neutral"), ("Brand#2", "new gear", "negative")]


@query("dc11_polarity_of_names", f"""WITH k(topic_group, topic_name, said) AS (VALUES {', '.join(str(x) for x in _CONFIRMED)}) SELECT p_partkey, coalesce(said, CASE WHEN contains(p_name, 'gear') OR contains(p_name, 'old') THEN 'neutral' WHEN contains(p_name, 'red') OR contains(p_name, 'ring') THEN 'negative' ELSE 'positive' END) AS polarity
FROM part LEFT JOIN k ON p_brand = topic_group AND p_name = topic_name""")
def _(t):
    known = t.spark.createDataFrame(_CONFIRMED, "topic_group string, topic_name string, polarity string")
    rows = t.part.select("p_partkey", "p_brand", F.concat(F.lit(" "), "p_name", F.lit(" ")).alias("n"))
    return R.confirmed_polarity(rows, "p_brand", "n", known, ["gear", "old"], ["red", "ring"]).select("p_partkey", "polarity")


@query("dc16_onsets_of_sources", """WITH a AS (SELECT l_partkey, l_returnflag AS api, l_suppkey, min(CASE WHEN l_quantity > 30 THEN strftime(l_shipdate, '%Y-%m') END) AS onset FROM lineitem GROUP BY 1, 2, 3), b AS (SELECT l_partkey, api, min(onset) AS onset FROM a GROUP BY 1, 2)
SELECT l_partkey, max(onset) AS onset, coalesce(string_agg(CASE WHEN onset IS NOT NULL THEN api END, ',' ORDER BY api), '') AS answered FROM b GROUP BY 1""")
def _(t):
    series = t.lineitem.groupBy("l_partkey", C("l_returnflag").alias("api"), "l_suppkey").agg(F.min(F.when(C("l_quantity") > 30, F.date_format("l_shipdate", "yyyy-MM"))).alias("onset"))
    return R.combined_onset(series, ["l_partkey"], "api", "onset").withColumn("answered", F.array_join("answered", ","))


_SIDES = "concat('s', p_partkey % 2) AS source, CAST(p_partkey // 4 AS VARCHAR) AS pid, CASE p_partkey % 3 WHEN 0 THEN 'listing' WHEN 1 THEN 'variant' ELSE CASE WHEN p_partkey % 13 = 0 THEN 'odd' ELSE 'variant' END END AS level, CASE WHEN p_partkey % 11 <> 0 THEN CAST(p_size % 3 AS VARCHAR) END AS option, p_size % 4 AS shade, p_size % 5 AS spf"


@query("dc18_identity_relations", f"""WITH p AS (SELECT p_partkey, p_brand, {_SIDES} FROM part), x AS (SELECT a.p_partkey AS a, b.p_partkey AS b, a.source = b.source AND a.pid = b.pid AS same, a.level AS la, b.level AS lb, a.option AS oa, b.option AS ob,
 (a.shade <> 0 AND b.shade <> 0 AND a.shade <> b.shade) OR (a.shade = 1 AND b.shade = 1 AND a.spf <> b.spf) AS differ FROM p a JOIN p b ON a.pid = b.pid AND a.p_partkey < b.p_partkey)
SELECT a, b, CASE WHEN la = 'odd' OR lb = 'odd' OR (la = 'variant' AND oa IS NULL) OR (lb = 'variant' AND ob IS NULL) THEN 'invalid' WHEN differ THEN 'distinct' WHEN NOT same THEN 'unresolved' WHEN la = lb AND la = 'variant' THEN CASE WHEN oa = ob THEN 'same_variant' ELSE 'distinct' END WHEN la = lb THEN concat('same_', la)
WHEN la = 'listing' AND ob IN ('0', '1') OR lb = 'listing' AND oa IN ('0', '1') THEN 'listing_contains_variant' ELSE 'unresolved' END AS relation FROM x""")
def _(t):
    k, size = C("p_partkey"), C("p_size")
    level = F.when(k % 3 == 0, "listing").when((k % 3 == 2) & (k % 13 == 0), "odd").otherwise("variant")
    known = F.map_filter(F.create_map(F.lit("shade"), F.when(size % 4 != 0, (size % 4).cast("string")), F.lit("spf"), F.when(size % 4 == 1, (size % 5).cast("string"))), lambda n, v: v.isNotNull())
    side = F.struct(level.alias("level"), F.concat(F.lit("s"), (k % 2).cast("string")).alias("source"), F.floor(k / 4).cast("string").alias("product_id"), F.when(k % 11 != 0, (size % 3).cast("string")).alias("variant_key"), F.array(F.lit("0"), F.lit("1")).alias("variant_keys"), known.alias("attributes"))
    p = t.part.select("p_partkey", side.alias("side"), F.floor(k / 4).alias("pid"))
    a, b = p.select(C("p_partkey").alias("a"), C("side").alias("x"), "pid"), p.select(C("p_partkey").alias("b"), C("side").alias("y"), "pid")
    return a.join(b, "pid").where("a < b").select("a", "b", R.identity_relation(C("x"), C("y")).alias("relation"))


@query("st12_rematched_units", "SELECT 'same' AS dictionary, doc_id FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT 'changed', doc_id FROM documents UNION ALL SELECT 'first', doc_id FROM documents")
def _(t):
    docs, stored = t.documents.select("doc_id"), t.documents.where("doc_id % 3 <> 0").select("doc_id", F.lit("d1/m1").alias("stamp"))
    plans = [("same", stored, "d1/m1"), ("changed", stored, "d2/m1"), ("first", stored.limit(0), "d2/m1")]
    out = [R.rematch(docs, "doc_id", s, stamp).select(F.lit(name).alias("dictionary"), "doc_id") for name, s, stamp in plans]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("dc14_meets_thresholds", "SELECT l_orderkey, l_linenumber, round_even(l_quantity / 75, 2) >= 0.33 AS two, round_even(l_quantity / 75, 3) >= 0.333 AS three FROM lineitem")
def _(t):
    share = C("l_quantity").cast("double") / 75
    return t.lineitem.select("l_orderkey", "l_linenumber", R.meets(share, "0.33").alias("two"), R.meets(share, "0.333").alias("three"))


@query("dc13_gated_documents", "SELECT source, count(*) AS n FROM documents GROUP BY 1")
def _(t):
    snapshots = t.documents.groupBy("source").agg(F.max("doc_id").alias("m")).orderBy(F.desc("m"), "source").withColumn("snapshot_id", F.row_number().over(R.Window.orderBy(F.desc("m"), "source")))
    told = snapshots.select("snapshot_id", (C("snapshot_id") == 1).alias("active"), F.when(C("snapshot_id") == 1, "live").otherwise("archive").alias("lineage"), F.array(F.lit("title"), F.lit("description")).alias("text_parts"))
    R.live_gate(told, "live", "description")
    return t.documents.groupBy("source").agg(F.count("*").alias("n"))


@query("sc8_union_of_present", "SELECT 'orders' AS arm, count(*) AS n FROM orders UNION ALL SELECT 'more', count(*) FROM orders")
def _(t):
    paths = {"orders": f"{t.folder}/orders.parquet", "more": f"{t.folder}/orders.parquet", "absent": f"{t.folder}/no_such_table.parquet"}
    return R.union_present(t.spark, paths, "o_orderkey long, o_custkey long").groupBy("arm").agg(F.count("*").alias("n"))


_BRANDS = "SELECT p_brand AS canonical, min(p_name) AS surface, concat(lower(p_brand), '||', min(p_name), '|', max(p_name)) AS aliases, CASE WHEN count(*) % 2 = 0 THEN 'x' ELSE '' END AS sources, min(p_partkey) AS place FROM part GROUP BY p_brand"


@query("sc25_brand_surfaces", f"""WITH b AS ({_BRANDS}), s AS (SELECT canonical, surface, 0 AS k, place, 0 AS i FROM b UNION ALL SELECT canonical, lower(canonical), 1, place, 0 FROM b WHERE canonical <> 'Brand#3' UNION ALL SELECT canonical, surface, 1, place, 2 FROM b UNION ALL SELECT canonical, split_part(aliases, '|', 4), 1, place, 3 FROM b),
r AS (SELECT *, row_number() OVER (PARTITION BY surface ORDER BY k, place, i) AS n FROM s) SELECT canonical, surface, CASE canonical WHEN 'Brand#4' THEN 'stop' WHEN 'Brand#5' THEN 'near' ELSE 'link' END AS tier, 3 AS version FROM r WHERE n = 1""")
def _(t):
    b = t.part.groupBy(C("p_brand").alias("canonical")).agg(F.min("p_name").alias("surface"), F.concat_ws("|", F.lower(F.first("p_brand")), F.lit(""), F.min("p_name"), F.max("p_name")).alias("aliases"), F.when(F.count("*") % 2 == 0, "x").otherwise("").alias("sources"), F.min("p_partkey").alias("place"))
    stop = t.spark.createDataFrame([("Brand#4", "stop", "r"), ("Brand#5", "cooc_required", "r")], "brand string, tier string, reason string")
    dropped = t.spark.createDataFrame([("Brand#3", "brand#3", "drop"), ("Brand#6", "brand#6", "keep")], "brand string, alias string, decision string")
    rows = S.brand_surfaces(b, stop, dropped)
    empty = t.spark.createDataFrame([], "kind string, canonical string, surface string, tier string, version int")
    once = S.load_versioned(empty, rows, 3, ["kind", "surface"], "place")
    return S.load_versioned(once, rows, 3, ["kind", "surface"], "place").drop("kind")


@query("sc25_labelled_rows", "SELECT 'quality' AS task, CAST(doc_id AS VARCHAR) AS ref, CASE WHEN doc_id % 5 = 0 THEN 'holdout' ELSE 'dev' END AS split, CAST(quality AS VARCHAR) AS gold, toxic = 1 AS marked FROM labels")
def _(t):
    rows = t.labels.select("doc_id", F.when(C("doc_id") % 5 == 0, "holdout").otherwise("dev").alias("split"), "quality", F.lit("t").alias("text"), F.when(C("toxic") == 1, "1").otherwise("").alias("toxic"))
    return S.labelled_rows(rows, "quality", "doc_id", "split", "quality", "text", ["toxic"]).select("task", "ref", "split", "gold", (F.size("extra") > 0).alias("marked"))


@query("sk9_csv_lines", """SELECT concat_ws(',', CAST(page_id AS VARCHAR), CASE WHEN regexp_matches(url, '[",\\n]') THEN concat('"', replace(url, '"', '""'), '"') ELSE url END, CASE WHEN regexp_matches(h, '[",\\n]') THEN concat('"', replace(h, '"', '""'), '"') ELSE h END) AS line FROM (SELECT page_id, coalesce(url, '') AS url, coalesce(substr(html, 1, 200), '') AS h FROM pages)""")
def _(t):
    return S.csv_lines(t.pages.select("page_id", "url", F.substring("html", 1, 200).alias("h")), ["page_id", "url", "h"])


def _long_predictor():
    return lambda texts: texts.str.len().gt(400).map({True: "1", False: "0"})


if ("quality", "length") not in P._known:
    P.register("quality", "length", _long_predictor)


@query("ud4_evaluated_predictors", """WITH r AS (SELECT CASE WHEN doc_id % 5 = 0 THEN 'holdout' ELSE 'dev' END AS split, CAST(quality AS VARCHAR) AS gold, CASE WHEN length(text) > 400 THEN '1' ELSE '0' END AS said FROM labels JOIN documents USING (doc_id)), l AS (SELECT DISTINCT split, unnest([gold, said]) AS label FROM r)
SELECT 'length' AS implementation, split, label, count(CASE WHEN gold = label THEN 1 END) AS support, count(CASE WHEN gold = label AND said = label THEN 1 END) AS hit, count(CASE WHEN said = label THEN 1 END) AS predicted FROM l JOIN r USING (split) GROUP BY 1, 2, 3""")
def _(t):
    rows = t.labels.join(t.documents.select("doc_id", "text"), "doc_id").select(F.when(C("doc_id") % 5 == 0, "holdout").otherwise("dev").alias("split"), C("quality").cast("string").alias("gold"), "text")
    out = None
    for name in P.implementations("quality"):
        scored = P.evaluated("quality", name, rows, "text", "gold", ["split"])
        out = scored if out is None else out.unionByName(scored)
    return out.where("implementation = 'length'").select("implementation", "split", "label", "support", "hit", "predicted")


@query("ud5_formula_on_files", "SELECT o_orderpriority AS label, count(*) AS n, sum(o_totalprice) AS total FROM orders GROUP BY 1")
def _(t):
    from ..sources.readers import read_csv

    # the formula that the SQL has on the table, on the CSV files that the table was written to
    formula = lambda df: df.groupBy(C("o_orderpriority").alias("label")).agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total"))
    path = shared_path(t.spark, "orders-csv")
    t.orders.select("o_orderkey", "o_orderpriority", "o_totalprice").write.csv(path, header=True)
    return read_csv(t.spark, path, "o_orderkey long, o_orderpriority string, o_totalprice double").transform(formula)


@query("gr4_table_fingerprint", """WITH h AS (SELECT sha256(to_json({'p_partkey': p_partkey, 'p_name': p_name, 'p_brand': p_brand, 'p_size': p_size})) AS h FROM part), b AS (SELECT substr(h, 1, 4) AS b, sha256(string_agg(h, '' ORDER BY h)) AS d FROM h GROUP BY 1) SELECT sha256(string_agg(concat(b, d), '' ORDER BY b)) AS fingerprint FROM b""")
def _(t):
    return X.fingerprint(t.part, ["p_partkey", "p_name", "p_brand", "p_size"])


@query("j29_containment_pairs", "SELECT DISTINCT a.p_name AS short, b.p_brand AS brand FROM (SELECT DISTINCT replace(p_name, ' ', '') AS p_name FROM part) a JOIN (SELECT DISTINCT p_brand, concat(p_type, replace(p_name, ' ', ''), '-', p_size) AS p_name FROM part) b ON contains(b.p_name, a.p_name)")
def _(t):
    a = t.part.select(F.replace("p_name", F.lit(" "), F.lit("")).alias("short")).distinct()
    b = t.part.select(C("p_brand").alias("brand"), F.concat("p_type", F.replace("p_name", F.lit(" "), F.lit("")), F.lit("-"), C("p_size").cast("string")).alias("long")).distinct()
    return L.contained(b, "long", a, "short").select("name.short", "text.brand").distinct()


@query("fn_search_tokens", r"WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+(?:[+\-][a-z0-9]+)*\+?') AS w FROM documents) SELECT doc_id, len(w) AS n, md5(array_to_string(w, ' ')) AS terms, len(list_filter(w, lambda x: x NOT IN ('the', 'of', 'und'))) AS kept FROM t")
def _(t):
    w, kept = Q.search_tokens(C("text"), ["선크림"]), Q.query_tokens(C("text"), ["the", "of", "und"])
    n = F.size(F.filter(kept, lambda x: ~x.isin("the", "of", "und")))
    return t.documents.select("doc_id", N.nfkc("text").alias("text")).select("doc_id", F.size(w).cast("long").alias("n"), F.md5(F.array_join(w, " ").cast("binary")).alias("terms"), n.cast("long").alias("kept"))
