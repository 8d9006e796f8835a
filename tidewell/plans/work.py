"""Queries of queues, caches, health, coverage, routes, cards, trend answers and manifests."""

from __future__ import annotations

import json
from datetime import datetime

from pyspark.sql import functions as F

from ..functions.scalars import scaled_round
from ..operators import work as K
from ..shared import shared_path
from ..sources import shops as P
from ..streaming import passes as S
from .base import Catalog
from .text import _SENTENCES, candidates

catalog = Catalog()
query = catalog.query
C = F.col

_JOBS = "j AS (SELECT event_type AS kind, user_id AS target, CASE event_id % 4 WHEN 0 THEN 'queued' WHEN 1 THEN 'running' ELSE 'done' END AS state FROM events WHERE ts < TIMESTAMP '2024-01-10'), w AS (SELECT concat(event_type, event_id % 3) AS kind, user_id AS target, event_id AS place FROM events WHERE ts >= TIMESTAMP '2024-01-10')"


@query("st8_enqueued_jobs", f"""WITH {_JOBS}, a AS (SELECT * FROM j WHERE state <> 'done'), n AS (SELECT count(*) + 400 AS depth, count(*) AS held FROM a), x AS (SELECT *, row_number() OVER (PARTITION BY kind, target ORDER BY place) > 1 OR EXISTS (SELECT 1 FROM a WHERE a.kind = w.kind AND a.target = w.target) AS dup FROM w),
y AS (SELECT x.*, coalesce(h, 0) + coalesce(count(CASE WHEN NOT dup THEN 1 END) OVER (PARTITION BY x.target ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) >= 40 AS over FROM x LEFT JOIN (SELECT target, count(*) AS h FROM a GROUP BY 1) t USING (target)),
z AS (SELECT place, row_number() OVER (ORDER BY place) AS k FROM y WHERE NOT dup AND NOT over) SELECT place, CASE WHEN dup THEN 'duplicate' WHEN over THEN 'per_target' WHEN k <= depth - held THEN 'enqueued' ELSE 'capped' END AS outcome FROM y LEFT JOIN z USING (place), n""")
def _(t):
    cut = C("ts") < F.lit("2024-01-10").cast("timestamp_ntz")
    state = F.when(C("event_id") % 4 == 0, "queued").when(C("event_id") % 4 == 1, "running").otherwise("done")
    jobs = t.events.where(cut).select(C("event_type").alias("kind"), C("user_id").alias("target"), state.alias("state"))
    wanted = t.events.where(~cut).select(F.concat("event_type", (C("event_id") % 3).cast("string")).alias("kind"), C("user_id").alias("target"), C("event_id").alias("place"))
    return K.enqueued(jobs, wanted, jobs.where(C("state").isin(*K.ACTIVE)).count() + 400, 40).select("place", "outcome")


@query("st8_claimed_jobs", "WITH d AS (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS k FROM events WHERE ts <= TIMESTAMP '2024-01-20') SELECT event_id AS identifier, CAST(k // 300 AS INT) AS pass FROM d WHERE k < 900")
def _(t):
    s = S.Passes(t.spark, shared_path(t.spark, "claims"))
    jobs = t.events.select(C("event_id").alias("identifier"), C("ts").alias("scheduled_at"))
    for _ in range(3):
        K.claim_pass(s, jobs, 300, datetime(2024, 1, 20))
    return s.all("claimed", S.T.StructType([jobs.schema["identifier"]]))


@query("st7_cached_artifacts", """WITH a AS (SELECT user_id, max_by(event_id, (ts, event_id)) AS id, max_by(CASE WHEN event_id % 5 <> 0 THEN ts + to_days(CAST(event_id % 9 AS INT)) END, (ts, event_id)) AS until FROM events WHERE event_type = 'view' GROUP BY 1), q AS (SELECT DISTINCT user_id FROM events)
SELECT user_id, CASE WHEN until > TIMESTAMP '2024-01-31 12:00:00' THEN id END AS artifact, NOT coalesce(until > TIMESTAMP '2024-01-31 12:00:00', false) AS fetch FROM q LEFT JOIN a USING (user_id)""")
def _(t):
    until = F.when(C("event_id") % 5 != 0, C("ts") + F.make_dt_interval((C("event_id") % 9).cast("int")))
    artifacts = t.events.where("event_type = 'view'").select("user_id", C("event_id").alias("identifier"), C("ts").alias("fetched_at"), until.alias("fresh_until"))
    out = K.cached_or_fetch(t.events.select("user_id").distinct(), artifacts, ["user_id"], datetime(2024, 1, 31, 12))
    return out.select("user_id", "artifact", "fetch")


@query("st9_hourly_captures", "WITH c AS (SELECT user_id, date_trunc('hour', ts) AS hour, min((ts, event_id)) AS m FROM events GROUP BY 1, 2) SELECT user_id, strftime(hour, '%Y-%m-%d %H') AS hour, m[2] AS event_id FROM c")
def _(t):
    s = S.Passes(t.spark, shared_path(t.spark, "captures"))
    rows = t.events.select("user_id", F.date_trunc("hour", C("ts")).cast("timestamp_ntz").alias("hour"), "ts", "event_id")
    for until in ("2024-01-11", "2024-01-11", "2025-01-01"):  # a pass run again adds nothing
        S.observe_pass(s, rows, ["user_id", "hour"], "ts", datetime.fromisoformat(until))
    return s.all("observed", rows.schema).select("user_id", F.date_format("hour", "yyyy-MM-dd HH").alias("hour"), "event_id")


@query("pf21_queue_status", """WITH h AS (SELECT date_trunc('hour', ts) AS hour, count(CASE WHEN event_id % 31 = 0 THEN 1 END) AS fly, count(CASE WHEN event_type = 'purchase' THEN 1 END) AS ok, count(CASE WHEN event_type IN ('error', 'click') THEN 1 END) AS bad, count(CASE WHEN event_type = 'error' THEN 1 END) AS blocked, count(*) AS n FROM events GROUP BY 1)
SELECT strftime(hour, '%Y-%m-%d %H') AS hour, CASE WHEN fly > 0 THEN 'running' WHEN ok > 0 AND bad > 0 THEN 'partial' WHEN ok > 0 THEN 'ok' WHEN bad > 0 AND bad = blocked THEN 'blocked' WHEN bad > 0 THEN 'failed' ELSE 'cancelled' END AS status FROM h""")
def _(t):
    kind = C("event_type")
    g = t.events.groupBy(F.date_format("ts", "yyyy-MM-dd HH").alias("hour")).agg(F.count_if(C("event_id") % 31 == 0).alias("fly"), F.count_if(kind == "purchase").alias("ok"), F.count_if(kind.isin("error", "click")).alias("bad"), F.count_if(kind == "error").alias("blocked"), F.count("*").alias("n"))
    return g.select("hour", K.queue_status(C("fly"), C("ok"), C("bad"), C("blocked"), C("n")).alias("status"))


@query("pf21_run_status", "WITH s AS (SELECT l_orderkey, count(CASE WHEN l_returnflag <> 'N' THEN 1 END) AS other FROM lineitem WHERE l_quantity > 20 GROUP BY 1) SELECT o_orderkey AS run_id, CASE WHEN o_orderstatus = 'O' AND other = 0 THEN 'yielded' WHEN o_orderstatus = 'O' THEN 'partial' ELSE o_orderstatus END AS status FROM orders LEFT JOIN s ON o_orderkey = l_orderkey")
def _(t):
    runs = t.orders.select(C("o_orderkey").alias("run_id"), F.when(C("o_orderstatus") == "O", "partial").otherwise(C("o_orderstatus")).alias("status"))
    sources = t.lineitem.where("l_quantity > 20").select(C("l_orderkey").alias("run_id"), F.when(C("l_returnflag") == "N", "skipped").otherwise("ok").alias("outcome"))
    return K.run_status(runs, sources)


@query("rt12_coverage_notes", """WITH c AS (SELECT event_type, count(*) AS n, max(ts) AS m FROM events GROUP BY 1), s AS (SELECT event_type, count(*) AS n, max(ts) AS m FROM (SELECT event_type, ts FROM events WHERE event_type <> 'click' OR value > 20 UNION ALL SELECT event_type, ts FROM events WHERE event_type = 'view' AND event_id < 50 UNION ALL SELECT 'gone', ts FROM events WHERE event_id < 3) GROUP BY 1)
SELECT event_type, s.n AS stored, coalesce(c.n, 0) AS corpus, nullif(concat_ws('; ', CASE WHEN s.n < coalesce(c.n, 0) THEN concat(c.n - s.n, ' missing') WHEN s.n > coalesce(c.n, 0) THEN concat(s.n - coalesce(c.n, 0), ' left over') END, CASE WHEN s.m IS DISTINCT FROM c.m THEN 'changed since' END), '') AS note FROM s LEFT JOIN c USING (event_type)""")
def _(t):
    e = t.events.select("event_type", "ts", "value", "event_id")
    stored = e.where("event_type <> 'click' or value > 20").unionByName(e.where("event_type = 'view' and event_id < 50")).unionByName(e.where("event_id < 3").withColumn("event_type", F.lit("gone")))
    return K.coverage(stored, e, "event_type", "ts")


_PATTERNS = "p AS (SELECT CASE WHEN p_size % 3 = 0 THEN 'generic' ELSE p_brand END AS scope, p_type AS aspect, CASE WHEN p_partkey % 4 <> 0 THEN p_partkey % 2 = 0 END AS neutral, p_partkey AS pattern FROM part)"


@query("dc10_visible_patterns", f"WITH {_PATTERNS} SELECT scope, pattern FROM p WHERE scope = 'Brand#1' UNION ALL SELECT scope, pattern FROM p g WHERE scope = 'generic' AND NOT EXISTS (SELECT 1 FROM p o WHERE o.scope = 'Brand#1' AND o.aspect = g.aspect AND o.neutral IS NOT DISTINCT FROM g.neutral)")
def _(t):
    p = t.part.select(F.when(C("p_size") % 3 == 0, "generic").otherwise(C("p_brand")).alias("scope"), C("p_type").alias("aspect"), F.when(C("p_partkey") % 4 != 0, C("p_partkey") % 2 == 0).alias("neutral"), C("p_partkey").alias("pattern"))
    return K.visible_patterns(p, "Brand#1").select("scope", "pattern")


@query("j40_compared_routes", """WITH a AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS place FROM orders WHERE o_orderkey % 3 <> 0 AND o_orderdate >= TIMESTAMP '1997-01-01'), b AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders WHERE o_orderkey % 5 <> 0 AND o_orderdate >= TIMESTAMP '1997-01-01')
SELECT coalesce(a.o_custkey, b.o_custkey) AS o_custkey, coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, CASE WHEN a.place IS NULL THEN 'second' WHEN b.place IS NULL THEN 'first' ELSE 'both' END AS side FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey""")
def _(t):
    from pyspark.sql import Window

    listed = lambda df, *order: df.withColumn("place", F.row_number().over(Window.partitionBy("o_custkey").orderBy(*order)))
    one = listed(t.orders.where(C("o_orderkey") % 3 != 0), F.desc("o_orderdate"), "o_orderkey")
    two = listed(t.orders.where(C("o_orderkey") % 5 != 0), F.desc("o_totalprice"), "o_orderkey")
    return K.route_comparison(one, two, ["o_custkey"], "o_orderkey", "place", "o_orderdate", "1997-01-01").drop("place")


_CELL = "c AS (SELECT o_custkey AS cell, CASE WHEN o_custkey % 6 <> 0 THEN round(sum(CASE WHEN o_orderstatus = 'F' THEN 10.0 ELSE -7.0 END), 2) END AS gap, CASE count(*) % 5 WHEN 0 THEN 'rising' WHEN 1 THEN 'steady' WHEN 2 THEN 'thin' WHEN 3 THEN 'new' END AS comment, CASE count(*) % 3 WHEN 0 THEN 'steady' WHEN 1 THEN 'falling' END AS video, CAST(count(*) AS DOUBLE) AS share, CASE WHEN o_custkey % 4 <> 0 THEN round(max(o_totalprice) / 1000, 3) END AS score FROM orders GROUP BY 1)"


@query("dc4_card_types", f"""WITH {_CELL}, k AS (SELECT *, coalesce(gap, 0) AS g, CASE WHEN coalesce(gap, 0) >= 20 AND comment <> 'thin' THEN 'product_gap' WHEN (coalesce(comment, '') IN ('rising', 'new') OR coalesce(video, '') IN ('rising', 'new')) AND abs(coalesce(gap, 0)) < 20 THEN 'verified_growth' WHEN coalesce(comment, '') IN ('rising', 'new') THEN 'fad_risk' WHEN comment = 'steady' AND video = 'steady' AND share >= 6 THEN 'saturated' END AS card FROM c)
SELECT cell, card, round(CASE card WHEN 'product_gap' THEN abs(g) ELSE coalesce(score, 0) END, 2) AS strength, concat_ws('; ', CASE WHEN comment = 'thin' THEN 'comments: on hold, thin' END, CASE WHEN share = 1 THEN 'comments: one source alone' END, CASE WHEN cell % 10 = 3 THEN 'found by generic words: cream, sun' END, 'always') AS limits FROM k WHERE card IS NOT NULL""")
def _(t):
    n, status = F.count("*"), F.when(C("o_orderstatus") == "F", 10.0).otherwise(-7.0)
    g = t.orders.groupBy(C("o_custkey").alias("cell")).agg(
        F.round(F.sum(status), 2).alias("gap"), F.when(n % 5 == 0, "rising").when(n % 5 == 1, "steady").when(n % 5 == 2, "thin").when(n % 5 == 3, "new").alias("comment"), F.when(n % 3 == 0, "steady").when(n % 3 == 1, "falling").alias("video"),
        n.cast("double").alias("share"), scaled_round(F.max("o_totalprice") / 1000, 3).alias("score"),
    )
    g = g.withColumns({"gap": F.when(C("cell") % 6 != 0, C("gap")), "score": F.when(C("cell") % 4 != 0, C("score"))})
    g = g.withColumn("card", K.card_rules(C("gap"), C("comment"), C("video"), C("share"), 20, ["thin"], ["rising", "new"], ["steady"], 6)).where("card is not null")
    used = F.when(C("cell") % 10 == 3, F.array(F.lit("sun"), F.lit("milk"), F.lit("cream")))
    limits = K.card_limits({"comments": (F.when(C("comment") == "thin", "thin"), C("share") == 1)}, used, F.array(F.lit("cream"), F.lit("sun")), "always")
    return g.select("cell", "card", K.card_strength(C("card"), C("gap"), C("score")).alias("strength"), F.array_join(limits, "; ").alias("limits"))


_SERIES = "WITH m AS (SELECT o_custkey, o_orderpriority AS term, strftime(o_orderdate, '%Y-%m') AS month, round(sum(o_totalprice), 2) AS ratio, count(*) AS n FROM orders GROUP BY 1, 2, 3)"


def trend_answers(t):
    m = t.orders.groupBy("o_custkey", C("o_orderpriority").alias("term"), F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.round(F.sum("o_totalprice"), 2).alias("ratio"), F.count("*").alias("n"))
    point = F.concat(F.lit('{"period": "'), "month", F.lit('-01", "ratio": '), F.when(C("n") % 3 == 0, "true").when(C("n") % 3 == 2, '"9"').otherwise(C("ratio").cast("string")), F.lit("}"))
    s = m.groupBy("o_custkey", "term").agg(F.array_join(F.array_sort(F.collect_list(point)), ", ").alias("points"))
    series = F.concat(F.lit('{"title": "'), F.when(C("term") != "5-LOW", C("term")).otherwise(""), F.lit('", "keywords": ["'), "term", F.lit('"], "data": [7, {"period": "2024"}, {"period": 202401, "ratio": 1}, '), "points", F.lit("]}"))
    g = s.groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("term", series.alias("s")))), lambda x: x["s"]).alias("series"), F.array_sort(F.collect_list("term")).alias("all"))
    body = F.concat(F.lit('{"results": ['), F.array_join("series", ", "), F.lit(', "odd"]}'))
    return g.select(C("o_custkey").cast("string").alias("key"), F.lit("2024-05-01").cast("date").alias("at"), body.alias("body"), F.slice("all", 1, 2).alias("terms"))


@query("sc15_trend_points", f"{_SERIES} SELECT CAST(o_custkey AS VARCHAR) AS key, term AS series, term AS terms, month, CASE WHEN n % 3 = 1 THEN ratio END AS ratio FROM m WHERE term <> '5-LOW'")
def _(t):
    return P.trend_points(trend_answers(t).drop("terms")).select("key", "series", F.array_join("terms", "|").alias("terms"), "month", "ratio")


@query("sc16_positional_points", f"{_SERIES}, r AS (SELECT *, dense_rank() OVER (PARTITION BY o_custkey ORDER BY term) AS i FROM m) SELECT CAST(o_custkey AS VARCHAR) AS key, term AS series, month, CASE WHEN n % 3 = 1 THEN ratio END AS ratio FROM r WHERE i <= 2")
def _(t):
    return P.positional_points(trend_answers(t)).select("key", "series", "month", "ratio")


@query("sc11_manifest_problems", "WITH n AS (SELECT source, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY 1), m AS (SELECT source, n + CASE WHEN n % 2 = 0 THEN 1 ELSE 0 END AS declared FROM n) SELECT source AS kind, 'count' AS problem FROM m JOIN n USING (source) WHERE declared <> n UNION ALL SELECT 'absent', 'count' UNION ALL SELECT DISTINCT '', 'repeated id' FROM (SELECT doc_id FROM documents GROUP BY 1 HAVING count(*) > 1)")
def _(t):
    from ..sources.readers import manifest_violations

    # the manifest is a JSON file beside the rows, read as Spark reads it
    counts = {r[0]: r[1] + (r[1] % 2 == 0) for r in t.documents.where("source is not null").groupBy("source").count().collect()}
    folder = shared_path(t.spark, "manifest")
    t.spark.createDataFrame([(json.dumps({"documents": {"by_source": counts | {"absent": 3}}}),)], "value string").coalesce(1).write.text(folder)
    told = t.spark.read.text(folder).select(F.explode(F.from_json(F.get_json_object("value", "$.documents.by_source"), "map<string,bigint>")).alias("kind", "declared"))
    return manifest_violations(t.documents.where("source is not null"), "doc_id", "source", {r.kind: r.declared for r in told.collect()})


@query("dc8_sentence_rows", f"WITH {_SENTENCES}, k AS (SELECT DISTINCT doc_id, sentence, CASE WHEN regexp_matches(sentence, '\\bif\\b') THEN 'wish' WHEN regexp_matches(sentence, 'anea|erin') THEN 'complaint' WHEN doc_id % 5 + 1 <= 2 THEN 'low_rating' END AS kind FROM sn) SELECT doc_id, md5(sentence) AS sentence, kind FROM k WHERE kind IS NOT NULL")
def _(t):
    return candidates(t).select("doc_id", F.md5(C("sentence").cast("binary")).alias("sentence"), "kind")
