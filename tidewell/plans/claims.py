"""Queries of launch claims, backtests, dictionaries, names, audits and reviewed observations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audit as A
from ..operators import discovery as D
from ..operators import launch as L
from ..operators import metrics as M
from ..operators import names as N
from ..operators import trend as T
from ..operators.dictionary import dictionary_hits
from ..shared import written
from .base import Catalog
from .metrics import _ORDERS, quarter_rows

catalog = Catalog()
query = catalog.query
C = F.col


# --- backtest -------------------------------------------------------------------------------------------------------

_GRID = _ORDERS + """, tt AS (SELECT DISTINCT topic FROM o), qq AS (SELECT DISTINCT quarter FROM o), n AS (SELECT topic, quarter, count(*) FILTER (WHERE status <> 'P') AS mentions, count(*) AS raw FROM o GROUP BY 1, 2),
g0 AS (SELECT topic, quarter, coalesce(mentions, 0) AS mentions, coalesce(raw, 0) AS raw FROM tt CROSS JOIN qq LEFT JOIN n USING (topic, quarter)),
f AS (SELECT topic, quarter, coalesce(mentions * 1.0 / nullif(sum(mentions) OVER (PARTITION BY quarter), 0), 0) AS share FROM g0),
m0 AS (SELECT topic, quarter AS target, row_number() OVER t AS i, count(*) OVER (PARTITION BY topic) AS n, 100 * avg(share) OVER (t ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS before, 100 * avg(share) OVER (t ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS excl, 100 * avg(share) OVER (t ROWS BETWEEN 2 FOLLOWING AND 5 FOLLOWING) AS after FROM f WINDOW t AS (PARTITION BY topic ORDER BY quarter)),
m AS (SELECT * FROM m0 WHERE i >= 4 AND i + 5 <= n)"""
_BACK = _GRID + """, qi AS (SELECT quarter, row_number() OVER (ORDER BY quarter) - 1 AS i, count(*) OVER () AS n, lag(quarter) OVER (ORDER BY quarter) AS target FROM qq), cuts AS (SELECT quarter AS cutoff, target FROM qi WHERE i >= 4 AND i + 4 < n),
g AS (SELECT cutoff, target, topic, quarter, mentions, raw FROM g0 JOIN cuts ON quarter <= cutoff), c AS (SELECT *, coalesce(mentions * 1.0 / nullif(sum(mentions) OVER (PARTITION BY cutoff, quarter), 0), 0) AS composition FROM g),
b AS (SELECT cutoff, topic, median(composition) AS baseline FROM c GROUP BY 1, 2), ch AS (SELECT topic, quarter, count(DISTINCT channel) AS parts FROM o WHERE status <> 'P' GROUP BY 1, 2), pn AS (SELECT quarter, count(DISTINCT channel) AS total FROM o GROUP BY 1),
q AS (SELECT cutoff, target, topic, quarter, mentions, composition, sum(CASE WHEN composition > baseline THEN 1 ELSE 0 END) OVER w AS above, count(*) OVER w AS "window", coalesce(coalesce(parts, 0) * 1.0 / total, 0) AS breadth, coalesce(mentions * 1.0 / nullif(raw, 0), 1) AS unique_ratio
 FROM c JOIN b USING (cutoff, topic) LEFT JOIN ch USING (topic, quarter) LEFT JOIN pn USING (quarter) WINDOW w AS (PARTITION BY cutoff, topic ORDER BY quarter ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)),
s AS (SELECT *, (rank() OVER w - 1 + count(*) OVER (PARTITION BY cutoff, quarter ORDER BY mentions RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) / 2.0 / count(*) OVER (PARTITION BY cutoff, quarter) AS mid FROM q WINDOW w AS (PARTITION BY cutoff, quarter ORDER BY mentions)),
v AS (SELECT *, round(43.75 * mid + 31.25 * least(1.0, breadth) + 25.0 * least(1.0, unique_ratio), 1) AS strength, lag(composition) OVER t AS prev, max(composition) OVER (PARTITION BY cutoff, topic ORDER BY quarter ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS m3, max(composition) OVER (PARTITION BY cutoff, topic) AS peak FROM s WINDOW t AS (PARTITION BY cutoff, topic ORDER BY quarter)),
d AS (SELECT target, topic, 100 * composition AS at_cutoff, CASE WHEN strength < 50 THEN 'thin' WHEN m3 < 0.01 THEN 'new' WHEN above = "window" AND "window" = 4 THEN 'persistent' WHEN (composition - prev) / nullif(prev, 0) >= 0.35 THEN 'rising' WHEN (composition - prev) / nullif(prev, 0) <= -0.35 THEN 'falling' WHEN composition = peak THEN 'peak' ELSE 'steady' END AS verdict FROM v WHERE quarter = target)"""


def grid(t):
    o = quarter_rows(t)
    n = o.groupBy("topic", "quarter").agg(F.count_if(C("status") != "P").alias("mentions"), F.count("*").alias("raw"))
    counts = T.dense_grid(o.select("topic").distinct(), o.select("quarter").distinct(), n, ["topic", "quarter"], {"mentions": 0, "raw": 0})
    return counts, o.groupBy("quarter").agg(F.count_distinct("channel").alias("channels_total")), o.where("status <> 'P'").groupBy("topic", "quarter", "channel").agg(F.count("*").alias("n"))


@query("ag37_backtest", _BACK.join(["WITH ", """ SELECT target, topic, verdict, round(before, 2) AS before_pp, round(excl, 2) AS before_excl_pp, round(after, 2) AS after_pp, round(at_cutoff, 2) AS at_cutoff_pp, CASE verdict WHEN 'falling' THEN 'fall_held' WHEN 'peak' THEN 'peak_gone' ELSE 'rise_held' END AS expected, CASE WHEN after > before THEN 'rose' ELSE 'fell' END AS actual,
CASE verdict WHEN 'falling' THEN after < before WHEN 'peak' THEN after < at_cutoff ELSE after > before END AS hit, CASE verdict WHEN 'falling' THEN after < excl WHEN 'peak' THEN after < at_cutoff ELSE after > excl END AS hit_level FROM d JOIN m USING (target, topic) WHERE verdict IN ('rising', 'new', 'falling', 'peak')"""]))
def _(t):
    return T.backtest(*grid(t))


@query("ag37_base_rate", f"WITH {_GRID} SELECT count(*) AS cells, round(100.0 * count(CASE WHEN after > before THEN 1 END) / count(*), 2) AS base_rate, round(100.0 * count(CASE WHEN after > excl THEN 1 END) / count(*), 2) AS base_level_rate FROM m WHERE before <> 0 OR after <> 0")
def _(t):
    return T.backtest_base_rate(grid(t)[0])


# --- names ------------------------------------------------------------------------------------------------------------

# a listing's title: its name with what sellers add
_LISTED = "concat(CASE WHEN p_size % 3 = 0 THEN 'New ' ELSE '' END, p_name, ' [', p_type, '] ', CAST(p_size AS {text}), ' ml ', p_brand, CASE WHEN p_size % 4 = 0 THEN ' gift-set' ELSE '' END)"
RULES = N.NameRules(noise=r"(?i)\[[^\]]*\]|\b\d+ ?ml\b", glued=(), words=("New", "gift-set"), synonyms=(("gizmo|widget", "thing"), ("ring", "band")))
_BARE = "trim(regexp_replace(regexp_replace(replace(lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace({x}, '(?i)\\[[^\\]]*\\]|\\b[0-9]+ ?ml\\b', ' ', 'g'), '\\bNew\\b|\\bgift-set\\b', ' ', 'g'), 'gizmo|widget', 'thing', 'g'), 'ring', 'band', 'g')), lower({b}), ' '), '[^a-z0-9_.]+', ' ', 'g'), ' +', ' ', 'g'))"
_KEY = "regexp_replace(lower({x}), '[^0-9a-z]', '', 'g')"
_FILER = "CASE WHEN p_partkey % 5 = 0 THEN concat(p_brand, ' Inc.') WHEN p_partkey % 5 = 1 THEN 'Acme Co., Ltd.' ELSE 'Oem Corporation' END"
_FILER_KEY = "regexp_replace(regexp_replace(lower({x}), '\\bco\\.?,? *ltd\\b\\.?|\\bcorp(oration)?\\b\\.?|\\binc\\b\\.?', ' ', 'g'), '[^0-9a-z]', '', 'g')"


@query("pf_product_names", f"SELECT p_partkey, {_BARE.format(x=_LISTED.format(text='VARCHAR'), b='p_brand')} AS name, {_FILER_KEY.format(x=_FILER)} AS filer, {_KEY.format(x='p_brand')} AS brand FROM part")
def _(t):
    listed = F.expr(_LISTED.format(text="STRING"))
    return t.part.select("p_partkey", N.product_name(listed, C("p_brand"), RULES).alias("name"), N.company_key(F.expr(_FILER)).alias("filer"), N.folded(C("p_brand")).alias("brand"))


# --- launch claims ----------------------------------------------------------------------------------------------------

_ITEM = "concat(CASE WHEN p_partkey % 4 = 3 THEN '' ELSE upper(p_brand) END, {name}, CASE WHEN p_partkey % 4 = 1 THEN ' Plus' ELSE '' END)"
_ITEM_NAME = _ITEM.format(name="CASE WHEN p_partkey % 4 = 2 THEN substr(p_name, 1, length(p_name) - 2) ELSE p_name END")
_CLAIMS = f"""p AS (SELECT p_partkey, p_brand, p_name, min(p_partkey) OVER (PARTITION BY p_brand, p_name) AS ref, concat('s', p_partkey % 3) AS source FROM part),
refs AS (SELECT DISTINCT ref, p_brand AS brand, replace({_BARE.format(x='p_name', b="'#'")}, ' ', '') AS line FROM p), k AS (SELECT DISTINCT p_brand AS brand, {_KEY.format(x='p_brand')} AS key FROM part),
reg AS (SELECT p_partkey AS seq, {_KEY.format(x=_ITEM_NAME)} AS item, {_FILER_KEY.format(x=_FILER)} AS filer, DATE '1995-01-01' + CAST(p_size * 20 AS INT) AS day FROM part WHERE p_partkey % 3 = 0),
rl AS (SELECT brand, seq, day, replace(item, key, '') AS registered FROM reg JOIN k ON filer = key OR contains(item, key)),
mf AS (SELECT ref AS product_ref, 'mfds' AS axis, 'not_before' AS direction, day AS claimed_on, CAST(seq AS VARCHAR) AS source_ref, CASE WHEN registered = line THEN 'exact' ELSE 'partial' END AS strength, CAST(NULL AS VARCHAR) AS note FROM refs JOIN rl USING (brand) WHERE length(line) >= 4 AND length(registered) >= 4 AND (contains(line, registered) OR contains(registered, line))),
li AS (SELECT source, l_partkey, CAST(l_shipdate AS DATE) AS day, l_returnflag AS flag, l_quantity, p_name, ref, ref = p_partkey AS own FROM lineitem JOIN p ON l_partkey = p_partkey),
bd AS (SELECT CASE flag WHEN 'N' THEN 'vendor_board' ELSE 'old_review' END AS axis, source, l_partkey, ref, own, min(day) AS day FROM li WHERE flag IN ('N', 'R') GROUP BY ALL),
ti AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY day DESC, title DESC) AS place FROM (SELECT *, concat(p_name, CASE WHEN l_quantity > 40 THEN ' (our best) [new]' WHEN l_quantity > 25 THEN ' [NEW] (best)' WHEN l_quantity > 10 THEN ' [Renewal] new' ELSE '' END) AS title FROM li WHERE flag = 'A')),
tg AS (SELECT *, CASE WHEN contains(title, '(our best)') THEN 'best' WHEN contains(title, '[NEW]') THEN 'NEW' END AS tag FROM ti WHERE place = 1),
cl AS (SELECT * FROM mf UNION ALL SELECT ref, axis, 'not_after', day, concat(source, ':', l_partkey), CASE WHEN own THEN 'exact' ELSE 'partial' END, NULL FROM bd UNION ALL SELECT ref, 'vendor_title_tag', 'not_after', day - 10, concat(source, ':', l_partkey), CASE WHEN own THEN 'exact' ELSE 'partial' END, tag FROM tg WHERE tag IS NOT NULL)"""


def launch_claims(t):
    from pyspark.sql import Window

    p = t.part.withColumns({"ref": F.min("p_partkey").over(Window.partitionBy("p_brand", "p_name")), "source": F.concat(F.lit("s"), (C("p_partkey") % 3).cast("string"))})
    p = written(p, "listings")  # all claims read it
    refs = p.select(C("ref").alias("product_ref"), C("p_brand").alias("brand"), N.line_key(C("p_name"), F.array(), RULES).alias("line")).distinct()
    brands = t.part.select(C("p_brand").alias("brand"), N.folded(C("p_brand")).alias("key")).distinct()
    registrations = t.part.where("p_partkey % 3 = 0").select(
        C("p_partkey").alias("report_seq"), N.folded(F.expr(_ITEM_NAME)).alias("item_key"), N.company_key(F.expr(_FILER)).alias("entp_key"), F.date_add(F.lit("1995-01-01").cast("date"), (C("p_size") * 20).cast("int")).alias("report_date"),
    )
    members = p.select("source", C("p_partkey").alias("product_key"), C("ref").alias("product_ref"), (C("ref") == C("p_partkey")).alias("primary"))
    seen = t.lineitem.join(p.select(C("p_partkey").alias("product_key"), "source", "p_name"), C("l_partkey") == C("product_key")).withColumn("day", C("l_shipdate").cast("date"))
    q = C("l_quantity")
    titles = seen.where("l_returnflag = 'A'").select(
        "source", "product_key", F.concat("p_name", F.when(q > 40, " (our best) [new]").when(q > 25, " [NEW] (best)").when(q > 10, " [Renewal] new").otherwise("")).alias("title"), F.date_sub("day", 10).alias("first_seen_on"), C("day").alias("captured_on"),
    )
    boards = seen.where("l_returnflag = 'N'").select("source", "product_key", C("day").alias("captured_on"))
    reviews = seen.where("l_returnflag = 'R'").select("source", "product_key", C("day").alias("written_on"))
    return L.claims(refs, members, registrations, brands, boards, reviews, titles, ["best", "NEW"])


@query("dc15_launch_claims", f"WITH {_CLAIMS} SELECT product_ref, axis, direction, strftime(claimed_on, '%Y-%m-%d') AS claimed_on, source_ref, strength, note FROM cl")
def _(t):
    return launch_claims(t).withColumn("claimed_on", F.date_format("claimed_on", "yyyy-MM-dd"))


@query("j30_listing_claims", f"WITH {_CLAIMS} SELECT axis, strength, count(*) AS claims, count(DISTINCT product_ref) AS products, strftime(min(claimed_on), '%Y-%m-%d') AS earliest FROM cl WHERE axis <> 'mfds' GROUP BY 1, 2")
def _(t):
    site = launch_claims(t).where(C("axis") != L.REGISTRATION)
    return site.groupBy("axis", "strength").agg(F.count("*").alias("claims"), F.count_distinct("product_ref").alias("products"), F.date_format(F.min("claimed_on"), "yyyy-MM-dd").alias("earliest"))


@query("dc3_claim_verdicts", f"""WITH {_CLAIMS}, a AS (SELECT product_ref, axis, min(CASE WHEN direction = 'not_before' THEN claimed_on END) AS lo, min(CASE WHEN direction = 'not_after' THEN claimed_on END) AS hi FROM cl WHERE axis <> 'vendor_title_tag' GROUP BY 1, 2), i AS (SELECT product_ref, max(lo) AS lo, min(hi) AS hi FROM a GROUP BY 1)
SELECT product_ref, CASE WHEN lo IS NULL AND hi IS NULL THEN 'unknown' WHEN lo > hi THEN 'conflict' WHEN lo >= DATE '1995-12-31' THEN 'new' WHEN lo >= DATE '1995-09-30' THEN 'recent' WHEN hi < DATE '1995-03-31' THEN 'established' WHEN lo IS NULL THEN 'not_after' ELSE 'within_year' END AS verdict FROM i""")
def _(t):
    i = M.launch_interval(L.claim_bounds(launch_claims(t)), "product_ref", "axis", "lower", "upper")
    return i.select("product_ref", M.launch_verdict(C("lower"), C("upper"), F.lit("1996-03-31").cast("date")).alias("verdict"))


# --- dictionaries -----------------------------------------------------------------------------------------------------

@query("j25_dictionary_links", r"""WITH s AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{5,}')) AS name FROM benchmark), w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS word FROM documents)
SELECT doc_id, name AS canonical, count(*) AS n FROM w JOIN s ON word = name GROUP BY 1, 2""")
def _(t):
    names = t.benchmark.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{5,}"), 0)).alias("surface")).distinct()
    surfaces = names.select("surface", C("surface").alias("canonical"), F.lit("word").alias("kind"), F.lit("link").alias("tier"))
    hits = dictionary_hits(t.documents.select("doc_id", "text"), "text", surfaces, "x")
    return hits.select("doc_id", F.explode("hits").alias("h")).groupBy("doc_id", C("h.canonical").alias("canonical")).agg(F.count("*").alias("n"))


_TERMS = [("metal", "rod"), ("metal", "GearRing"), ("metal", "ring"), ("thing", "gizmo"), ("thing", "wid get"), ("none", "zzz")]
_FORBIDDEN = [(None, "Blue"), ("metal", "small r"), ("thing", "gad")]
_PART_NAMES = "nm AS (SELECT p_partkey % 97 AS product, CASE WHEN p_size % 6 = 0 THEN concat(p_name, ' ', p_name, ' ', p_type, ' x y') ELSE p_name END AS name FROM part)"
_CAUGHT = f"""{_PART_NAMES}, te(key, term) AS (VALUES {', '.join(f"('{k}', '{x}')" for k, x in _TERMS)}), hit AS (SELECT DISTINCT key, product, name, rid FROM (SELECT *, row_number() OVER () AS rid FROM nm) JOIN te ON contains(lower(replace(name, ' ', '')), lower(replace(term, ' ', ''))))"""


def part_names(t):
    name = F.when(C("p_size") % 6 == 0, F.concat_ws(" ", "p_name", "p_name", "p_type", F.lit("x y"))).otherwise(C("p_name"))
    return t.part.select((C("p_partkey") % 97).alias("product"), name.alias("name"))


@query("ag43_ingredient_audit", f"""WITH {_CAUGHT}, c AS (SELECT key, name, count(*) AS n, row_number() OVER (PARTITION BY key ORDER BY count(*) DESC, name) AS k FROM hit GROUP BY 1, 2),
t AS (SELECT key, count(*) AS rows, count(DISTINCT product) AS products FROM hit GROUP BY 1), l AS (SELECT key, string_agg(concat(name, '=', n), '|' ORDER BY k) AS names FROM c WHERE k <= 5 GROUP BY 1) SELECT key, coalesce(rows, 0) AS rows, coalesce(products, 0) AS products, coalesce(names, '') AS names FROM (SELECT DISTINCT key FROM te) LEFT JOIN t USING (key) LEFT JOIN l USING (key)""")
def _(t):
    a = A.audit(part_names(t), t.spark.createDataFrame(_TERMS, "key string, term string"))
    return a.withColumn("names", F.array_join(F.transform("names", lambda x: F.concat_ws("=", x["name"], x["n"].cast("string"))), "|"))


@query("ag43_denied_names", f"""WITH {_CAUGHT}, fo(of, bad) AS (VALUES {', '.join(f"({'NULL' if k is None else repr(k)}, '{x}')" for k, x in _FORBIDDEN)}), m AS (SELECT DISTINCT key, bad, product, length(name) - length(replace(name, ' ', '')) >= 5 OR length(name) >= 120 AS lump FROM hit JOIN fo ON (of IS NULL OR of = key) AND contains(lower(replace(name, ' ', '')), lower(replace(bad, ' ', ''))))
SELECT DISTINCT key, bad, CAST(NULL AS VARCHAR) AS product FROM m WHERE NOT lump UNION ALL SELECT DISTINCT key, bad, CAST(product AS VARCHAR) FROM m WHERE lump AND NOT EXISTS (SELECT 1 FROM m x WHERE x.key = m.key AND x.bad = m.bad AND NOT x.lump)""")
def _(t):
    return A.denied(part_names(t), t.spark.createDataFrame(_TERMS, "key string, term string"), t.spark.createDataFrame(_FORBIDDEN, "key string, bad string"))


# --- reviewed observations --------------------------------------------------------------------------------------------

# a review of the labelled documents: spans are cut from the texts, some of them wrong
_DISPOSITION = "CASE WHEN doc_id % 11 < 6 THEN 'observed' WHEN doc_id % 11 = 6 THEN 'wish' WHEN doc_id % 11 = 7 THEN 'promotion' WHEN doc_id % 11 = 8 THEN 'satisfied' WHEN doc_id % 11 = 9 THEN 'odd' END"
_SPAN = "CASE WHEN doc_id % 13 = 4 THEN 'nowhere to be found' WHEN doc_id % 13 = 5 THEN '' ELSE substr(text, 3, 20) END"
_OTHER = "CASE WHEN doc_id % 17 = 2 THEN 'not in the text at all' ELSE substr(text, 1, 12) END"
_CANDIDATE = "CASE WHEN doc_id % 19 = 7 THEN 'undeclared' WHEN doc_id % 23 <> 1 THEN concat('c', doc_id % 5) END"
_RECURRING = "CASE WHEN doc_id % 29 <> 3 THEN doc_id % 3 = 1 END"
_AUTHOR = "CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 31 = 2 THEN 'jo' ELSE substr(md5(CAST(doc_id % 40 AS {text})), 1, 16) END"
_SPECS = [("c0", "n", "l", "available", "r", "ref", "unassessed", "r"), ("c1", "n", "l", "available", "r", "", "existing_process_hypothesis", "r"), ("c2", "", "l", "unassessed", "r", "", "incompatible", "r"), ("c3", "n", "l", "unassessed", "", "", "maybe", "r"), ("c4", "n", None, "odd", "r", "", "unassessed", "")]
_SPEC_KINDS = "candidate string, need string, limitations string, technical string, technical_reason string, references string, feasibility string, feasibility_reason string"
_REVIEW = f"""d AS (SELECT doc_id, text, source, DATE '2024-01-01' + CAST(doc_id % 6 // 2 AS INT) AS published, {_AUTHOR.format(text='VARCHAR')} AS author FROM documents), o AS (SELECT doc_id, {_DISPOSITION} AS disposition, CASE WHEN doc_id % 37 <> 0 THEN 'r' END AS reason, {_CANDIDATE} AS candidate, {_RECURRING} AS recurring, {_SPAN} AS span, {_OTHER} AS other FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)),
sp(candidate, need, limitations, technical, technical_reason, refs, feasibility, feasibility_reason) AS (VALUES {', '.join('(' + ', '.join('NULL' if x is None else f"'{x}'" for x in s) + ')' for s in _SPECS)})"""


def review(t):
    e = lambda x: F.expr(x.format(text="STRING"))
    docs = t.documents.select("doc_id", "text", "source", F.date_add(F.lit("2024-01-01").cast("date"), F.floor(C("doc_id") % 6 / 2).cast("int")).alias("published_at"), e(_AUTHOR).alias("author_hash"))
    field = lambda span: F.struct(F.lit("s").alias("summary"), e(span).alias("span"))
    seen = t.documents.join(t.labels.select("doc_id").distinct(), "doc_id", "left_semi").select(
        "doc_id", e(_DISPOSITION).alias("disposition"), F.when(C("doc_id") % 37 != 0, "r").alias("reason"), e(_CANDIDATE).alias("candidate"), e(_RECURRING).alias("recurring"), e(_OTHER).alias("recurrence_span"), e(_SPAN).alias("span"),
        *[field(_SPAN if f in ("behavior", "burden") else "substr(text, 1, 5)").alias(f) for f in D.FIELDS],
    )
    return docs, seen, t.spark.createDataFrame(_SPECS, _SPEC_KINDS)


@query("dc17_review_violations", f"""WITH {_REVIEW}, x AS (SELECT o.*, d.text, d.author, (SELECT count(*) FROM sp WHERE sp.candidate = o.candidate) > 0 AS declared, coalesce(disposition = 'observed', false) AS seen, disposition IS DISTINCT FROM 'observed' AS unseen, span <> '' AND contains(text, span) AS ok, contains(text, other) AS other_ok FROM o JOIN d USING (doc_id))
SELECT 'document' AS subject, CAST(doc_id AS VARCHAR) AS key, 'author is no stored hash' AS violation FROM d WHERE author = 'jo' UNION ALL SELECT 'document', CAST(doc_id AS VARCHAR), 'not reviewed' FROM d WHERE doc_id NOT IN (SELECT doc_id FROM o)
UNION ALL SELECT 'observation', CAST(doc_id AS VARCHAR), unnest([CASE WHEN disposition IS NULL OR disposition = 'odd' THEN 'unknown disposition' END, CASE WHEN reason IS NULL THEN 'no reason' END, CASE WHEN candidate IS NOT NULL AND NOT declared THEN 'undeclared candidate' END, CASE WHEN seen AND text = '' THEN 'ungrounded context' END, CASE WHEN seen AND text = '' THEN 'ungrounded requirement' END, CASE WHEN seen AND text = '' THEN 'ungrounded trade_off' END,
 CASE WHEN seen AND NOT ok THEN 'ungrounded behavior' END, CASE WHEN seen AND NOT ok THEN 'ungrounded burden' END, CASE WHEN seen AND candidate IS NULL THEN 'no candidate' END, CASE WHEN seen AND recurring IS NULL THEN 'recurrence not said' END, CASE WHEN seen AND recurring AND NOT (other <> '' AND other_ok) THEN 'recurrence without its span' END, CASE WHEN unseen AND NOT ok THEN 'no supporting span' END]) FROM x
UNION ALL SELECT 'candidate', candidate, unnest([CASE WHEN need = '' THEN 'no need' END, CASE WHEN limitations IS NULL THEN 'no limitations' END, CASE WHEN technical = 'odd' THEN 'unknown technical status' END, CASE WHEN technical = 'available' AND refs = '' THEN 'available without references' END, CASE WHEN feasibility = 'maybe' THEN 'unknown feasibility status' END, CASE WHEN technical_reason = '' THEN 'no technical reason' END, CASE WHEN feasibility_reason = '' THEN 'no feasibility reason' END]) FROM sp""".join(["SELECT * FROM (", ") WHERE violation IS NOT NULL"]))
def _(t):
    return D.violations(*review(t))


_SORTED = f"""{_REVIEW}, c AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) > 1 AS copy FROM d), so AS (SELECT doc_id, candidate, CASE WHEN copy THEN 'duplicate' WHEN disposition IS DISTINCT FROM 'observed' THEN concat_ws(': ', disposition, reason) WHEN author IS NULL THEN 'no author' END AS rejected, recurring, source, author, published FROM o JOIN c USING (doc_id))"""


@query("dc17_rejected_observations", f"WITH {_SORTED} SELECT doc_id, candidate, rejected FROM so")
def _(t):
    docs, seen, _ = review(t)
    return D.sorted_out(docs, seen).select("doc_id", "candidate", "rejected")


@query("ag53_ranked_candidates", f"""WITH {_SORTED}, g AS (SELECT candidate, count(DISTINCT (source, author)) AS users, count(DISTINCT published) AS dates, coalesce(bool_or(recurring), false) AS recurring FROM so WHERE rejected IS NULL GROUP BY 1),
r AS (SELECT candidate, coalesce(users, 0) AS users, coalesce(dates, 0) AS dates, coalesce(recurring, false) AS recurring, technical = 'available' AS av, feasibility = 'existing_process_hypothesis' AS ex, technical = 'contradictory' OR feasibility = 'incompatible' AS conflict FROM sp LEFT JOIN g USING (candidate)),
w AS (SELECT *, concat_ws('/', CAST(recurring AS INT), least(users, 3), CAST(dates > 1 AS INT), CAST(av AS INT), CAST(ex AS INT)) AS score, concat_ws('; ', CASE WHEN users < 2 THEN 'too few users' END, CASE WHEN NOT recurring AND dates < 2 THEN 'repeatability unestablished' END, CASE WHEN conflict THEN 'technical or feasibility conflict' END) AS reasons FROM r),
z AS (SELECT candidate, CAST(row_number() OVER (ORDER BY score DESC, candidate) AS INT) AS place FROM w WHERE reasons = '') SELECT candidate, users, dates, score, reasons, place FROM w LEFT JOIN z USING (candidate)""")
def _(t):
    docs, seen, specs = review(t)
    r = D.ranked_candidates(D.sorted_out(docs, seen), specs)
    return r.select("candidate", "users", "dates", F.array_join(C("score").cast("array<string>"), "/").alias("score"), F.array_join("reasons", "; ").alias("reasons"), "place")
