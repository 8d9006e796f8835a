"""Text, retrieval, matching and streaming queries over the driver's tables."""

from __future__ import annotations

import hashlib

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import linker as L
from ..operators import retrieval as R
from ..operators import text as X
from ..operators.derived import derived_folder, files_fingerprint
from ..shared import shared_root
from .base import Catalog

catalog = Catalog()
query = catalog.query
C = F.col

_QUERIES = [("q1", "the erinan"), ("q2", "und der"), ("q3", "nosuchword of")]
_POSTINGS = r"""t AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents), p AS (SELECT doc_id, len(w) AS length, unnest(w) AS term FROM t), x AS (SELECT term, doc_id, length, count(*) AS tf FROM p GROUP BY 1, 2, 3),
z AS (SELECT count(*) AS n, avg(len(w)) AS average FROM t), qt AS (SELECT * FROM (VALUES ('q1', 'the'), ('q1', 'erinan'), ('q2', 'und'), ('q2', 'der'), ('q3', 'nosuchword'), ('q3', 'of')) v(query, term))"""
_BM25 = _POSTINGS + """, d AS (SELECT term, count(*) AS df FROM x GROUP BY 1), s AS (SELECT query, doc_id, round(sum(greatest(0, ln((n - df + 0.5) / (df + 0.5) + 1)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / average))), 4) AS score
 FROM x JOIN d USING (term) JOIN qt USING (term), z GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc_id) AS place FROM s WHERE score > 0)"""
_VEC = """vq AS (SELECT concat('q', vec_id // 50 + 1) AS query, embedding AS q FROM embeddings WHERE vec_id IN (0, 50, 100)), vs AS (SELECT query, vec_id AS doc_id, list_sum(list_transform(list_zip(embedding, q), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE))) AS similarity FROM embeddings, vq),
vr AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, doc_id) AS place FROM vs)"""


def index(t):
    """The index of the documents, written once for each state of their files."""
    mark = files_fingerprint(t.spark, [f"{t.folder}/documents.parquet"], "latin", R.TERM_BUCKETS)
    root = f"{shared_root(t.spark)}/index-{hashlib.sha256(t.folder.encode()).hexdigest()[:16]}"
    return R.StoredIndex(t.spark, derived_folder(t.spark, root, mark, lambda folder: R.build_index(t.documents, "doc_id", R.latin_tokens(C("text")), folder)))


def terms(t):
    q = t.spark.createDataFrame(_QUERIES, "query string, text string")
    return q.select("query", F.explode(R.latin_tokens(C("text"))).alias("term"))


def vectors(t, k):
    q = t.embeddings.where(C("vec_id").isin(0, 50, 100)).select(F.concat(F.lit("q"), (C("vec_id") / 50 + 1).cast("int").cast("string")).alias("q"), C("embedding").alias("v"))
    return R.vector_search(t.embeddings.withColumnRenamed("vec_id", "doc_id"), "doc_id", "embedding", q, "q", "v", k)


@query("rt2_inverted_index", f"WITH {_POSTINGS} SELECT term, doc_id, length, tf FROM x")
def _(t):
    return index(t).postings.select("term", "doc_id", "length", "tf")


@query("rt3_bm25", f"WITH {_BM25} SELECT query, doc_id, score, place FROM r WHERE place <= 10")
def _(t):
    return R.bm25(index(t), terms(t), "doc_id").withColumn("place", C("place").cast("long"))


@query("rt4_vector_queries", """WITH q AS (SELECT vec_id AS query, embedding AS e FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT query, vec_id AS doc_id, list_sum(list_transform(list_zip(embedding, e), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE))) AS similarity FROM embeddings, q),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, doc_id) AS place FROM s) SELECT query, doc_id, round(similarity, 6) AS similarity, place FROM r WHERE place <= 10""")
def _(t):
    q = t.embeddings.where(C("vec_id") % 50 == 0).select(C("vec_id").alias("q"), C("embedding").alias("v"))
    found = R.vector_search(t.embeddings.withColumnRenamed("vec_id", "doc_id"), "doc_id", "embedding", q, "q", "v", 10)
    return found.select("query", "doc_id", F.round("similarity", 6).alias("similarity"), C("place").cast("long").alias("place"))


@query("rt4_vector_search", f"WITH {_VEC} SELECT query, doc_id, round(similarity, 6) AS similarity, place FROM vr WHERE place <= 10")
def _(t):
    return vectors(t, 10).select("query", "doc_id", F.round("similarity", 6).alias("similarity"), C("place").cast("long").alias("place"))


@query("rt5_hybrid_fusion", f"""WITH {_BM25}, {_VEC}, e AS (SELECT query, doc_id, place, 0 AS i FROM r WHERE place <= 40 UNION ALL SELECT query, doc_id, place, 1 FROM vr WHERE place <= 40), g AS (SELECT query, doc_id, sum(1.0 / (60 + place)) AS score, min_by(place, i) AS f FROM e GROUP BY 1, 2)
SELECT query, doc_id, round(score, 8) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 12) DESC, f, doc_id) AS n FROM g) WHERE n <= 10""")
def _(t):
    fused = R.fuse([R.bm25(index(t), terms(t), "doc_id", 40), vectors(t, 40)], "doc_id")
    return fused.where("place <= 10").select("query", "doc_id", F.round("score", 8).alias("score"))


@query("rt8_held_out_gold", f"WITH {_POSTINGS} SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM x WHERE term IN ('the', 'of'))")
def _(t):
    q = t.spark.createDataFrame([("q", "the"), ("q", "of")], "query string, term string")
    return R.held_out(t.documents.select(F.lit("q").alias("query"), "doc_id"), index(t), q, "doc_id").select("doc_id")


@query("rt10_evidence_fold", f"WITH {_BM25} SELECT query, source, min(place) AS best, string_agg(CAST(doc_id AS VARCHAR), ' … ' ORDER BY place) AS evidence FROM r JOIN documents USING (doc_id) WHERE place <= 20 GROUP BY 1, 2")
def _(t):
    r = R.bm25(index(t), terms(t), "doc_id", 20).join(t.documents.select("doc_id", "source"), "doc_id").withColumn("piece", C("doc_id").cast("string"))
    return R.folded(r, "source", "piece", 1000).select("query", "source", C("best").cast("long").alias("best"), "evidence")


@query("rt11_token_frequency", f"WITH {_POSTINGS} SELECT query, term, count(x.doc_id) AS df FROM qt LEFT JOIN x USING (term) GROUP BY 1, 2")
def _(t):
    return terms(t).join(index(t).terms.select("term", "df"), "term", "left").select("query", "term", F.coalesce("df", F.lit(0)).alias("df"))


@query("dc12_grounding", f"WITH {_POSTINGS}, m AS (SELECT query, term FROM qt WHERE length(term) >= 4 AND term NOT IN (SELECT term FROM x)) SELECT qt.query, count(m.term) = 0 AS ok FROM qt LEFT JOIN m ON qt.query = m.query AND qt.term = m.term GROUP BY 1")
def _(t):
    return R.grounding(terms(t), index(t)).select("query", "ok")


@query("ag46_bm25_statistics", f"WITH {_POSTINGS} SELECT term, count(*) AS df, round(greatest(0, ln((any_value(n) - count(*) + 0.5) / (count(*) + 0.5) + 1)), 6) AS idf FROM x, z GROUP BY 1")
def _(t):
    df = index(t).terms.crossJoin(F.broadcast(index(t).sizes))
    return df.select("term", "df", F.round(F.greatest(F.lit(0.0), F.log((C("n") - C("df") + 0.5) / (C("df") + 0.5) + 1)), 6).alias("idf"))


@query("ag48_retrieval_scores", f"""WITH {_BM25}, g AS (SELECT DISTINCT query, doc_id FROM qt JOIN x USING (term) JOIN documents USING (doc_id) WHERE lang = CASE query WHEN 'q2' THEN 'de' ELSE 'en' END), h AS (SELECT r.query, r.doc_id, r.place, g.doc_id AS gold FROM r LEFT JOIN g USING (query, doc_id) WHERE place <= 10)
SELECT q.query, coalesce(count(gold) / 10.0, 0) AS "precision", coalesce(1.0 / min(CASE WHEN gold IS NOT NULL THEN place END), 0) AS reciprocal, count(gold) > 0 AS hit FROM (SELECT DISTINCT query FROM g) q LEFT JOIN h USING (query) GROUP BY 1""")
def _(t):
    # a document is right for a query if it has any of its terms and is of the query's language
    q = terms(t)
    told = index(t).of(q).join(F.broadcast(q), "term").select("query", "doc_id").distinct().join(t.documents.select("doc_id", "lang"), "doc_id")
    gold = told.where(C("lang") == F.when(C("query") == "q2", "de").otherwise("en")).select("query", "doc_id")
    return R.evaluated(R.bm25(index(t), q, "doc_id"), gold, "doc_id", 10)


_ENGINES = f"""WITH {_BM25}, {_VEC}, ok AS (SELECT query FROM qt GROUP BY 1 HAVING count(CASE WHEN length(term) >= 4 AND term NOT IN (SELECT term FROM x) THEN 1 END) = 0), b AS (SELECT * FROM r WHERE query IN (SELECT query FROM ok)), v AS (SELECT * FROM vr WHERE query IN (SELECT query FROM ok)),
e AS (SELECT query, doc_id, place, 0 AS i FROM b WHERE place <= 40 UNION ALL SELECT query, doc_id, place, 1 FROM v WHERE place <= 40), g AS (SELECT query, doc_id, sum(1.0 / (60 + place)) AS score, min_by(place, i) AS f FROM e GROUP BY 1, 2),
h AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 12) DESC, f, doc_id) AS place FROM g)
SELECT 'bm25' AS engine, query, doc_id, place FROM b WHERE place <= 10 UNION ALL SELECT 'vector', query, doc_id, place FROM v WHERE place <= 10 UNION ALL SELECT 'hybrid', query, doc_id, place FROM h WHERE place <= 10"""


@query("rt6_engines", _ENGINES)
def _(t):
    store = t.embeddings.withColumnRenamed("vec_id", "doc_id")
    v = t.embeddings.where(C("vec_id").isin(0, 50, 100)).select(F.concat(F.lit("q"), (C("vec_id") / 50 + 1).cast("int").cast("string")).alias("query"), C("embedding").alias("vector"))
    parts = [R.search(e, index(t), store, terms(t), v, "doc_id").select(F.lit(e).alias("engine"), "query", "doc_id", C("place").cast("long").alias("place")) for e in ("bm25", "vector", "hybrid")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_ALIASES = [("article", "the"), ("article", "der"), ("article", "les"), ("joint", "and"), ("joint", "und"), ("joint", "et"), ("joint", "and"), ("pair", "the anea"), ("none", " ")]
_ALIAS_SQL = "al AS (SELECT DISTINCT topic, trim(alias) AS query FROM (VALUES ('article', 'the'), ('article', 'der'), ('article', 'les'), ('joint', 'and'), ('joint', 'und'), ('joint', 'et'), ('joint', 'and'), ('pair', 'the anea'), ('none', ' ')) v(topic, alias) WHERE trim(alias) <> '')"


def aliases(t):
    return t.spark.createDataFrame(_ALIASES, "topic string, alias string")


def gold(t):
    """RT7: the documents that match any alias of a topic."""
    terms = aliases(t).where(F.trim("alias") != "").distinct()
    return X.match_terms(t.documents.select("doc_id", "text"), "text", terms, "alias", "doc_id").select("topic", "doc_id").distinct()


_GOLD_SQL = _ALIAS_SQL + ", g AS (SELECT DISTINCT topic, doc_id FROM documents JOIN al ON regexp_matches(lower(text), concat('(^|[^a-z0-9])', query, '([^a-z0-9]|$)')))"


@query("rt7_topic_gold", f"WITH {_GOLD_SQL} SELECT topic, doc_id FROM g")
def _(t):
    return gold(t)


@query("rt9_alias_queries", f"WITH {_ALIAS_SQL} SELECT DISTINCT query, topic, unnest(regexp_extract_all(lower(query), '[a-z0-9]+')) AS term FROM al")
def _(t):
    return R.alias_queries(aliases(t), "topic", "alias", R.latin_tokens)


@query("rt8_held_out_topic_gold", f"""WITH {_GOLD_SQL}, tk AS (SELECT DISTINCT topic, query, unnest(regexp_extract_all(lower(query), '[a-z0-9]+')) AS term FROM al), w AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents)
SELECT DISTINCT al.query, g.doc_id FROM g JOIN al USING (topic) WHERE NOT EXISTS (SELECT 1 FROM tk JOIN w USING (term) WHERE tk.query = al.query AND w.doc_id = g.doc_id)""")
def _(t):
    q = R.alias_queries(aliases(t), "topic", "alias", R.latin_tokens)
    return R.held_out(gold(t).join(F.broadcast(q.select("query", "topic").distinct()), "topic").select("query", "doc_id").distinct(), index(t), q, "doc_id")


@query("j26_topic_match", r"""
SELECT doc_id, topic FROM documents, (VALUES ('the'), ('und'), ('anea'), ('les')) v(topic) WHERE regexp_matches(lower(text), concat('(^|[^a-z0-9])', topic, '([^a-z0-9]|$)'))""")
def _(t):
    topics = t.spark.createDataFrame([("the",), ("und",), ("anea",), ("les",)], "topic string")
    return X.match_terms(t.documents.select("doc_id", "text"), "text", topics, "topic", "doc_id").select("doc_id", "topic")


@query("j27_first_span", r"""
WITH m AS (SELECT doc_id, topic, regexp_matches(lower(text), concat('(^|[^a-z0-9])', topic, '([^a-z0-9]|$)')) AS hit, length(regexp_extract(lower(text), concat('^((?s:.*?)(^|[^a-z0-9]))', topic, '([^a-z0-9]|$)'), 1)) AS start FROM documents, (VALUES ('the'), ('und'), ('anea'), ('les')) v(topic))
SELECT doc_id, min_by(topic, (start, topic)) AS topic, min(start) AS span_start FROM m WHERE hit GROUP BY 1""")
def _(t):
    topics = t.spark.createDataFrame([("the",), ("und",), ("anea",), ("les",)], "topic string")
    m = X.match_terms(t.documents.select("doc_id", "text"), "text", topics, "topic", "doc_id")
    return m.groupBy("doc_id").agg(F.min_by("topic", F.struct("span_start", "topic")).alias("topic"), F.min("span_start").cast("long").alias("span_start"))


@query("rt1_chunks")
def _(t):
    return X.chunk_table(t.documents, "doc_id", "text", S.normalized)


@query("rt1_plain_chunks", r"""
WITH c AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(regexp_replace(text, '^\s+|\s+$', '', 'g'), concat('(?s)\s*(.{1,500}$|.{251,498}\. |.{251,498}! |.{251,498}\? |.{251,497}다\. |.{251,497}요\. |.{251,499}', chr(10), '|.{251,499} |.{1,500})'), 1), lambda p: regexp_replace(p, '\s+$', '')), lambda p: p <> '') AS p FROM documents)
SELECT doc_id, CAST(i - 1 AS INTEGER) AS ordinal, md5(p[i]) AS digest FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM c)""")
def _(t):
    return X.chunk_table(t.documents, "doc_id", "text").select("doc_id", "ordinal", "digest")


@query("ud6_sentences", r"""
WITH s AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(replace(replace(replace(text, '. ', '.' || chr(1)), '! ', '!' || chr(1)), '? ', '?' || chr(1)), chr(1) || '|\n+'), lambda x: trim(x)), lambda x: length(x) > 4) AS a, trim(text) AS w FROM documents)
SELECT doc_id, CAST(CASE WHEN len(a) > 0 THEN len(a) WHEN length(w) > 0 THEN 1 ELSE 0 END AS INTEGER) AS n FROM s""")
def _(t):
    return t.documents.select("doc_id", F.size(X.sentences(C("text"))).alias("n"))


@query("sc17_page_text")
def _(t):
    return t.pages.select("page_id", S.unescaped(F.regexp_replace("html", "<[^>]+>", " ")).alias("text"))


@query("pf_text_normalized")
def _(t):
    return t.documents.select("doc_id", S.normalized("text").alias("text"))


_DEEP = r"\([^()]*\)"
for _ in range(7):
    _DEEP = rf"\((?:[^()]|{_DEEP})*\)"


@query("ag43_list_names", f"""WITH n AS (SELECT doc_id, unnest(regexp_extract_all(regexp_replace(text, '\\[[^\\]]*\\]', ' ', 'g'), '(?:{_DEEP}|[^,@(]|\\()+')) AS name FROM documents), s AS (SELECT doc_id, regexp_replace(name, '^[\\s]+|[\\s]+$', '', 'g') AS name FROM n) SELECT name, count(*) AS n, count(DISTINCT doc_id) AS docs FROM s WHERE name <> '' GROUP BY 1 HAVING count(*) >= 3""")
def _(t):
    return t.documents.select("doc_id", F.explode(X.list_names(C("text"))).alias("name")).groupBy("name").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("docs")).where("n >= 3")


_RULES = X.PolarityRules(positive=r"\b(?:the|than)\b", negative=r"\b(?:re|edsh)\b", negated_positive=r"not the", wish=r"\bwish\b", aspects=(("anea", r"anea", False), ("eriner", r"erin", True)), before=r"\b(?:in|of)\s*$", after=r"^.{0,14}?\b(?:is|was)\b", context=r"\bwas\b.{0,6}$", skin=r"\bfor the\b", warning=r"\bnot\b", contrast=r"\bbut\b")
_SENTENCES = r"""sn AS (SELECT doc_id, unnest(CASE WHEN len(a) > 0 THEN a WHEN length(w) > 0 THEN [w] ELSE [] END) AS sentence FROM (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(replace(replace(replace(text, '. ', '.' || chr(1)), '! ', '!' || chr(1)), '? ', '?' || chr(1)), chr(1) || '|\n+'), lambda x: trim(x)), lambda x: length(x) > 4) AS a, trim(text) AS w FROM documents))"""


def candidates(t):
    return X.candidate_sentences(t.documents.withColumn("rating", C("doc_id") % 5 + 1), "doc_id", "text", "rating", r"\bif\b", r"anea|erin")


@query("dc8_candidate_sentences", f"WITH {_SENTENCES}, k AS (SELECT DISTINCT doc_id, sentence, CASE WHEN regexp_matches(sentence, '\\bif\\b') THEN 'wish' WHEN regexp_matches(sentence, 'anea|erin') THEN 'complaint' WHEN doc_id % 5 + 1 <= 2 THEN 'low_rating' END AS kind FROM sn) SELECT kind, count(*) AS n, count(DISTINCT doc_id) AS docs FROM k WHERE kind IS NOT NULL GROUP BY 1")
def _(t):
    return candidates(t).groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("docs"))


@query("dc9_rule_polarity")
def _(t):
    return candidates(t).select("doc_id", "sentence", "kind", X.judged(_RULES, C("sentence")).alias("p")).select("doc_id", "sentence", "kind", "p.aspect", "p.polarity", "p.reason")


_WISHES = X.WishRules(
    launch=r"then the|that in", launched=r"\bwas\b", again=r"again", not_launch=r"\bfrom\b", less=r"\bnot\s*", content=r"\bis\b", content_no_market=r"\bis\b", over_content=r"then the", channel=r"\bare\b", asked=r"\bwhat\b", asked_not=r"\bhow\b",
    demand=r"\bwith the\b", request=r"\bthe\b", request_bad=r"\bby\b", request_object=r"\bfor\b", hope=r"\bbe\b", not_hope=r"\bnot\b",
)


@query("dc7_wish_classes")
def _(t):
    s = t.documents.select("doc_id", F.explode(F.array_distinct(X.sentences(C("text"), 3))).alias("sentence"))
    return s.select("doc_id", "sentence", X.wish_class(_WISHES, C("sentence")).alias("w")).select("doc_id", "sentence", "w.kind", "w.marker")


_SURFACES = [X.Surface("The", "the", "brand"), X.Surface("then", "then", "brand", "near"), X.Surface("und", "and", "brand"), X.Surface("der", "der", "format"), X.Surface("and", "and", "brand", "near"), X.Surface("of", "of", "brand", "stop")]


@query("j25_surface_links", r"""
WITH w AS (SELECT doc_id, text, regexp_extract_all(text, '(?i)then|and|der|the|und') AS m, regexp_split_to_array(text, '(?i)then|and|der|the|und') AS g FROM documents),
h AS (SELECT doc_id, text, lower(m[k]) AS surface, k, CAST(list_sum(list_transform(g[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:k - 1], lambda x: length(x))), 0) AS INTEGER) AS start FROM (SELECT doc_id, text, m, g, unnest(range(1, len(m) + 1)) AS k FROM w)),
n AS (SELECT doc_id, surface, start, regexp_matches(substr(text, greatest(start - 25, 0) + 1, start + length(surface) + 25 - greatest(start - 25, 0)), 'er') AS near FROM h)
SELECT doc_id, CASE surface WHEN 'und' THEN 'and' ELSE surface END AS canonical, CASE surface WHEN 'der' THEN 'format' ELSE 'brand' END AS kind, start, near FROM n WHERE near OR surface NOT IN ('then', 'and', 'und')""")
def _(t):
    hits = t.documents.select("doc_id", F.explode(X.surface_hits(C("text"), _SURFACES, "er", "", "")).alias("h"))
    return hits.select("doc_id", "h.canonical", "h.kind", "h.start", "h.near")


PART_RULE = L.AcceptRule(stop=frozenset({"new", "plate", "rod", "ring"}), discriminators=frozenset({"large", "small"}), forms=("plate", "rod", "widget", "gear", "gizmo", "ring", "bolt", "anvil"))


# names with what the rule looks at, and the decision on names a and b
_NAMES = """f AS (SELECT *, list_filter(tok, lambda w: w NOT IN ('new', 'plate', 'rod', 'ring')) AS sig, list_distinct(list_transform(range(1, len(glued)), lambda i: substr(glued, i, 2))) AS grams, coalesce(list_last(regexp_extract_all(glued, 'widget|anvil|gizmo|plate|bolt|gear|ring|rod')), '') AS form
 FROM (SELECT DISTINCT p_brand AS block, p_name AS name, replace(p_name, ' ', '') AS glued, list_distinct(list_filter(string_split(p_name, ' '), lambda w: length(w) >= 2)) AS tok FROM part)),
u AS (SELECT a.block, a.name AS m, b.name AS n, a.form = b.form AS formed, len(list_intersect(a.sig, b.sig)) AS sig, len(list_intersect(a.tok, b.tok)) AS tok, len(list_distinct(list_concat(a.sig, b.sig))) AS joint, CASE WHEN len(a.grams) > 0 AND len(b.grams) > 0 THEN round_even(2.0 * len(list_intersect(a.grams, b.grams)) / (len(a.grams) + len(b.grams)), 3) ELSE 0 END AS dice,
 len(list_filter(['large', 'small'], lambda d: list_contains(a.sig, d) <> list_contains(b.sig, d) AND contains(a.glued, d) <> contains(b.glued, d))) AS differ FROM f a JOIN f b USING (block)),
d AS (SELECT *, CASE WHEN joint > 0 THEN sig / joint ELSE 0.0 END AS jaccard, formed AND differ = 0 AND ((sig >= 1 AND sig / joint >= 0.5) OR dice >= 0.7 OR (sig >= 2 AND dice >= 0.6)) AS accepted FROM u)"""
_BEST = """s AS (SELECT DISTINCT p_brand AS block, p_partkey % 3 AS site, p_name AS name FROM part),
best AS (SELECT block, site, name, other_site, other_name, tok, sig, dice FROM (SELECT d.block, a.site, d.m AS name, b.site AS other_site, d.n AS other_name, d.tok, d.sig, d.dice, row_number() OVER (PARTITION BY d.block, a.site, d.m, b.site ORDER BY d.sig DESC, d.dice DESC, d.n) AS place
 FROM d JOIN s a ON d.block = a.block AND d.m = a.name JOIN s b ON d.block = b.block AND d.n = b.name WHERE accepted AND a.site <> b.site) WHERE place = 1),
mutual AS (SELECT x.* FROM best x JOIN best y ON x.block = y.block AND x.site = y.other_site AND x.name = y.other_name AND x.other_site = y.site AND x.other_name = y.name)"""
_CLUSTERS = f"""WITH RECURSIVE {_NAMES}, {_BEST}, e AS (SELECT concat_ws('/', block, site, name) AS a, concat_ws('/', block, other_site, other_name) AS b, dice FROM mutual),
item AS (SELECT p_brand, p_partkey, p_partkey % 3 AS site, concat_ws('/', p_brand, p_partkey % 3, p_name) AS node FROM part), reach AS (SELECT DISTINCT node AS a, node AS b FROM item UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a),
c AS (SELECT reach.a AS node, min(item.p_partkey) AS cluster, count(DISTINCT item.site) AS sites FROM reach JOIN item ON reach.b = item.node GROUP BY 1), g AS (SELECT a AS node, max(dice) AS score FROM e GROUP BY 1),
r AS (SELECT p_brand, p_partkey, site, cluster, sites, score FROM item JOIN c USING (node) LEFT JOIN g USING (node))"""


def part_clusters(t):
    items = t.part.select("p_brand", "p_partkey", (C("p_partkey") % 3).alias("site"), "p_name")
    return L.clusters(items, "p_brand", "p_partkey", "site", "p_name", PART_RULE)


@query("gr1_entity_clusters", f"{_CLUSTERS} SELECT * FROM r")
def _(t):
    return part_clusters(t)


@query("gr1_candidate_matches", f"WITH {_NAMES}, {_BEST} SELECT best.block, best.site, best.name, best.other_site, best.other_name, best.tok AS shared_tok, best.sig AS shared_sig, best.dice, m.name IS NOT NULL AS mutual FROM best LEFT JOIN mutual m ON best.block = m.block AND best.site = m.site AND best.name = m.name AND best.other_site = m.other_site AND best.other_name = m.other_name")
def _(t):
    return L.best_matches(t.part.withColumn("site", C("p_partkey") % 3), "p_brand", "site", "p_name", PART_RULE)


@query("gr2_product_refs", f"{_CLUSTERS} SELECT concat('p:', cluster) AS ref, p_brand, max(sites) AS sites, count(*) AS members, max(score) AS best_score FROM r WHERE sites > 1 GROUP BY cluster, p_brand")
def _(t):
    several = part_clusters(t).where("sites > 1")
    return several.groupBy("cluster", "p_brand").agg(F.max("sites").alias("sites"), F.count("*").alias("members"), F.max("score").alias("best_score")).select(F.concat(F.lit("p:"), C("cluster").cast("string")).alias("ref"), "p_brand", "sites", "members", "best_score")


@query("dc6_pair_decisions", f"WITH {_NAMES} SELECT a.p_partkey AS a, b.p_partkey AS b, accepted, jaccard, dice FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_partkey < b.p_partkey JOIN d ON d.block = a.p_brand AND d.m = a.p_name AND d.n = b.p_name")
def _(t):
    return L.pair_decisions(t.part, "p_brand", "p_partkey", "p_name", PART_RULE)


@query("dc6_pair_scores", """
WITH p AS (SELECT p_brand, p_name, string_split(p_name, ' ') AS w FROM part GROUP BY 1, 2), u AS (SELECT a.p_brand AS brand, a.p_name AS a, b.p_name AS b, len(list_intersect(a.w, b.w)) AS met, len(list_distinct(list_concat(a.w, b.w))) AS joint FROM p a JOIN p b ON a.p_brand = b.p_brand AND a.p_name < b.p_name) SELECT brand, a, b, met * 1.0 / joint AS jaccard FROM u WHERE met > 0""")
def _(t):
    # names meet by a word of theirs: those without one have no score but 0
    p = t.part.select(C("p_brand").alias("brand"), "p_name").distinct().withColumn("w", S.token_set(C("p_name")))
    by_word = p.select("*", F.explode("w").alias("word"))
    a, b = by_word.select("brand", "word", C("p_name").alias("a"), C("w").alias("x")), by_word.select("brand", "word", C("p_name").alias("b"), C("w").alias("y"))
    return a.join(b, ["brand", "word"]).where("a < b").select("brand", "a", "b", S.jaccard(C("x"), C("y")).alias("jaccard")).distinct()


@query("gr4_dictionary_fingerprint", """WITH h AS (SELECT sha256(to_json({'r_regionkey': r_regionkey, 'r_name': r_name})) AS h FROM region), b AS (SELECT substr(h, 1, 4) AS b, sha256(string_agg(h, '' ORDER BY h)) AS d FROM h GROUP BY 1) SELECT sha256(string_agg(concat(b, d), '' ORDER BY b)) AS fingerprint FROM b""")
def _(t):
    return X.fingerprint(t.region, ["r_regionkey", "r_name"])


@query("gr3_edge_layers", """
WITH RECURSIVE e AS (SELECT DISTINCT n_regionkey AS a, 100 + n_nationkey AS b FROM nation UNION SELECT DISTINCT 100 + s_nationkey, 1000 + s_suppkey FROM supplier),
l AS (SELECT a AS node, 0 AS layer FROM e WHERE a NOT IN (SELECT b FROM e) UNION ALL SELECT b, layer + 1 FROM l JOIN e ON l.node = e.a) SELECT node, max(layer) AS layer FROM l GROUP BY 1""")
def _(t):
    from ..operators.graph import layers

    a = t.nation.select(C("n_regionkey").cast("long").alias("a"), (C("n_nationkey") + 100).cast("long").alias("b"))
    b = t.supplier.select((C("s_nationkey") + 100).cast("long").alias("a"), (C("s_suppkey") + 1000).alias("b"))
    return layers(a.union(b).distinct(), "a", "b")


@query("gr3_edge_layers_whole", """
WITH RECURSIVE e AS (SELECT DISTINCT n_regionkey AS a, 100 + n_nationkey AS b FROM nation UNION SELECT DISTINCT 100 + s_nationkey, 1000 + s_suppkey FROM supplier),
l AS (SELECT a AS node, 0 AS layer FROM e WHERE a NOT IN (SELECT b FROM e) UNION ALL SELECT b, layer + 1 FROM l JOIN e ON l.node = e.a) SELECT node, max(layer) AS layer FROM l GROUP BY 1""")
def _(t):
    from ..operators.graph import layers

    a = t.nation.select(C("n_regionkey").cast("long").alias("a"), (C("n_nationkey") + 100).cast("long").alias("b"))
    b = t.supplier.select((C("s_nationkey") + 100).cast("long").alias("a"), (C("s_suppkey") + 1000).alias("b"))
    return layers(a.union(b).distinct(), "a", "b")


@query("st1_tumbling_counts", "SELECT strftime(time_bucket(INTERVAL 6 HOUR, ts), '%Y-%m-%d %H') AS slot, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def _(t):
    from ..streaming.jobs import tumbling_counts, replayed

    return replayed(t.spark, f"{t.folder}/events.parquet", lambda s: tumbling_counts(s, "ts", "6 hours", ["event_type"], "value"), "complete").select(F.date_format("slot", "yyyy-MM-dd HH").alias("slot"), "event_type", "n", F.round("total", 2).alias("total"))


@query("st4_first_seen", "SELECT user_id, event_type, count(*) AS rows FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY 1, 2")
def _(t):
    from ..streaming.jobs import first_seen, replayed

    return replayed(t.spark, f"{t.folder}/events.parquet", lambda s: first_seen(s, ["user_id", "event_type"]), "append").groupBy("user_id", "event_type").agg(F.count("*").alias("rows"))


@query("st3_routed_kinds", "SELECT event_type AS kind, count(*) AS n FROM events WHERE event_type IN ('view', 'purchase') GROUP BY 1 UNION ALL SELECT 'dead', count(*) FROM events WHERE event_type NOT IN ('view', 'purchase')")
def _(t):
    from ..streaming.jobs import routed

    return routed(t.spark, f"{t.folder}/events.parquet", "event_type", ["view", "purchase"])


@query("wn14_duplicate_flags", "SELECT doc_id, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) > 1 AS duplicate FROM documents")
def _(t):
    return t.documents.select("doc_id", (F.row_number().over(Window.partitionBy(F.md5(C("text").cast("binary"))).orderBy("doc_id")) > 1).alias("duplicate"))
