"""Queries of incremental work: cursors, retries, re-fetching, frozen observations, stale slices and derived caches."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from ..operators.derived import derived, files_fingerprint
from ..shared import shared_path
from ..streaming import passes as P
from .base import Catalog

catalog = Catalog()
query = catalog.query
C = F.col


def store(t, what: str) -> P.Passes:
    return P.Passes(t.spark, shared_path(t.spark, what))


class Killed(Exception):
    """Stands for the end of a process."""


def killed(*_):
    raise Killed


@query("st1_cursor_batches", "WITH n AS (SELECT count(*) AS n FROM events), r AS (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS k FROM events) SELECT event_id, CAST(k // (n // 4) AS INT) AS pass FROM r, n WHERE k < 3 * (n // 4)")
def _(t):
    s, rows = store(t, "cursor-batches"), t.events.select("event_id", "ts")
    size = rows.count() // 4
    good = lambda both: F.lit(None).cast("string")
    for ends in (None, killed, None, None):
        try:
            P.run_pass(s, rows, "ts", "event_id", size, good, **({"before_commit": ends} if ends else {}))
        except Killed:  # what it wrote counts for nothing, and the next run has its number
            pass
    return s.all("tried", P._tried(rows.schema)).select("event_id", "pass")


# an item is unreadable for good, or refused until its third or fourth attempt, and three are allowed
_REFUSED = "CASE WHEN event_id % 50 = 3 THEN 'unreadable' WHEN event_id % 10 = 7 AND {n} <= 2 + event_id % 3 % 2 THEN 'refused' END"


def refused(both):
    return F.expr(_REFUSED.format(n="attempt"))


def unreadable(error):
    return error == "unreadable"


@query("st2_retried_stream", f"""WITH a AS (SELECT event_id, attempt, {_REFUSED.format(n='attempt')} AS error FROM events, (VALUES (1), (2), (3)) v(attempt)),
o AS (SELECT event_id, min(CASE WHEN error IS NULL OR error = 'unreadable' OR attempt = 3 THEN attempt END) AS attempts FROM a GROUP BY 1)
SELECT event_id, CAST(attempts AS INT) AS attempts, error, CASE WHEN error IS NULL THEN 'done' ELSE 'dead' END AS state FROM o JOIN a USING (event_id) WHERE attempt = attempts""")
def _(t):
    from ..streaming.jobs import file_stream

    s, state = store(t, "retried"), shared_path(t.spark, "retried-state")
    stream = file_stream(t.spark, f"{t.folder}/events.parquet").select("event_id", "ts", "value")
    for ends in (killed, None):  # it dies before its first commit, and is started again
        q = P.tried_stream(stream, s, refused, state, unreadable, 3, **({"before_commit": ends} if ends else {}))
        try:
            q.awaitTermination()
        except Exception:
            if ends is None:
                raise
    P.drained(s, stream.schema, refused, unreadable, 3)
    return s.all("tried", P._tried(stream.schema)).where(C("state") != P.WAITING).select("event_id", C("attempt").alias("attempts"), "error", "state")


@query("st2_cursor_retries", f"""WITH n AS (SELECT count(*) AS n FROM events), r AS (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS k FROM events), p AS (SELECT event_id FROM r, n WHERE k < n // 3),
a AS (SELECT event_id, attempt, {_REFUSED.format(n='attempt')} AS error FROM p, (VALUES (1), (2), (3)) v(attempt)) SELECT attempt, coalesce(error, '') AS error, count(*) AS n FROM a WHERE attempt = 1 OR event_id % 10 = 7 GROUP BY 1, 2""")
def _(t):
    rows = t.events.select("event_id", "ts")
    first = P.next_batch(rows, "ts", "event_id", None, rows.count() // 3)
    s = store(t, "cursor-retries")
    P.run_pass(s, first, "ts", "event_id", first.count(), refused, unreadable)
    for _ in range(3):  # nothing new: what waits is tried until it is done or dead
        P.run_pass(s, first, "ts", "event_id", first.count(), refused, unreadable)
    tried = s.all("tried", P._tried(first.schema))
    return tried.groupBy("attempt", F.coalesce("error", F.lit("")).alias("error")).agg(F.count("*").alias("n"))


_FETCHES = [(0, "1996-06-01"), (1, "1996-12-01"), (2, "1997-12-01")]
_LISTED = " UNION ALL ".join(f"SELECT {k} AS pass, o_orderkey AS item, o_orderdate AS at, o_orderdate >= TIMESTAMP '{now}' - INTERVAL 300 DAY AS recent FROM orders WHERE o_orderdate < TIMESTAMP '{now}' AND (o_custkey + {k}) % 3 <> 0" for k, now in _FETCHES)


@query("st6_refetch_window", f"WITH l AS ({_LISTED}) SELECT CAST(pass AS INT) AS pass, item, recent FROM l WHERE recent OR NOT EXISTS (SELECT 1 FROM l b WHERE b.item = l.item AND b.pass < l.pass)")
def _(t):
    s = store(t, "fetches")
    for k, now in _FETCHES:
        listed = t.orders.where((C("o_orderdate") < F.lit(now).cast("timestamp_ntz")) & ((C("o_custkey") + k) % 3 != 0)).select(C("o_orderkey").alias("item"), C("o_orderdate").alias("at"))
        P.fetch_pass(s, listed, "item", "at", datetime.fromisoformat(now), 300)
    return s.all("fetched", P.T.StructType.fromDDL("item long, recent boolean")).select("pass", "item", "recent")


_CUTOFFS = ["2024-01-05", "2024-01-12", "2024-03-01"]


@query("st11_first_observations", f"""WITH e AS (SELECT user_id, event_type, ts + to_days(CAST(event_id * 7 % 11 AS INT)) AS seen, event_id, value FROM events), f AS (SELECT user_id, event_type, min((seen, event_id)) AS m FROM e GROUP BY 1, 2)
SELECT e.user_id, e.event_type, e.event_id, CASE {' '.join(f"WHEN seen <= TIMESTAMP '{c}' THEN {k}" for k, c in enumerate(_CUTOFFS))} END AS pass, value + 1000 * CASE {' '.join(f"WHEN seen <= TIMESTAMP '{c}' THEN {k}" for k, c in enumerate(_CUTOFFS))} END AS value
FROM e JOIN f ON e.user_id = f.user_id AND e.event_type = f.event_type AND (e.seen, e.event_id) = f.m WHERE seen <= TIMESTAMP '{_CUTOFFS[-1]}'""")
def _(t):
    s = store(t, "observations")
    seen = (C("ts") + F.make_dt_interval((C("event_id") * 7 % 11).cast("int"))).alias("seen")
    kinds = None
    for k, cutoff in enumerate(_CUTOFFS):  # the source says something else each time
        rows = t.events.select("user_id", "event_type", seen, "event_id", (C("value") + 1000 * k).alias("value"))
        P.observe_pass(s, rows, ["user_id", "event_type"], "seen", datetime.fromisoformat(cutoff))
        kinds = rows.schema
    return s.all("observed", kinds).select("user_id", "event_type", "event_id", "pass", "value")


@query("st13_stale_months", """WITH m AS (SELECT strftime(l_shipdate, '%Y-%m') AS month, count(*) AS n, sum(l_quantity) AS quantity FROM lineitem GROUP BY 1)
SELECT month, n, quantity, CASE WHEN month LIKE '1996%' OR month LIKE '1997-0%' THEN 3 ELSE 0 END AS run FROM m""")
def _(t):
    s = store(t, "months")
    rows = t.lineitem.select(F.date_format("l_shipdate", "yyyy-MM").alias("month"), "l_quantity")
    months = rows.select(C("month").alias("slice")).distinct()
    P.rewrite_slices(s, "mentions", rows, "month", months)  # run 0, marks 0 and 1
    try:
        P.rewrite_slices(s, "mentions", rows.limit(0), "month", months.where("slice like '1996%'"), midway=killed)  # run 2 dies
    except Killed:
        pass
    P.rewrite_slices(s, "mentions", rows, "month", months.where("slice like '1997-0%'"))  # run 3 makes good what run 2 left
    out = t.spark.read.parquet(f"{s.folder}/mentions")
    return out.groupBy("month").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"), F.max("run").alias("run"))


@query("sk10_derived_cache", "SELECT p_brand, count(*) AS parts, min(p_retailprice) AS least, 1 AS builds FROM part GROUP BY 1")
def _(t):
    built = []

    def build():
        built.append(1)
        return t.part.groupBy("p_brand").agg(F.count("*").alias("parts"), F.min("p_retailprice").alias("least"))

    root, mark = shared_path(t.spark, "derived"), files_fingerprint(t.spark, [f"{t.folder}/part.parquet"], "brands")
    derived(t.spark, root, mark, build)
    return derived(t.spark, root, mark, build).withColumn("builds", F.lit(len(built)))
