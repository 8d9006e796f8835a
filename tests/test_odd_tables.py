"""Queries against their SQL on tables with odd values, and at shapes that small tables lack."""

import duckdb
from tidewell.plans import compare, registry


def same(spark, folder, name, **tables):
    """Writes the tables by their SELECT texts and compares the query with its SQL on them."""
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for table, rows in tables.items():
        con.execute(f"COPY ({rows}) TO '{folder}/{table}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return compare.differences(registry.QUERIES[name](spark, str(folder)), con, registry.ORACLE_SQL[name])


def test_price_events_after_a_price_of_zero(spark, tmp_path):
    prices = "0.0, 5.0, -0.0, 3.0, 0.0, -2.0, NULL, 4.0, 4.0, 7.0, 'nan'::DOUBLE, 'inf'::DOUBLE, 1.0, 2.94715, 8.68574"
    rows = f"SELECT i AS event_id, TIMESTAMP '2024-01-01' + INTERVAL (i) HOUR AS ts, 1::BIGINT AS user_id, 'purchase' AS event_type, ([{prices}])[i] AS value FROM range(1, 16) r(i)"
    assert same(spark, tmp_path, "ag15_price_events", events=rows) is None


def test_flight_pages_of_many_objects(spark):
    """Objects that lie in several pieces of a text, in each other and beside thousands of others, in time that grows with the text."""
    from tidewell.sources import shops as P

    inner = ['{"id": %d, "é😀": "%s}{\\\\\\"", "in": {"y": {}}}' % (i, "x" * (i % 97 * (100 if i % 50 == 0 else 1))) for i in range(6000)]  # noqa: UP031
    flight = '{"id": "outer", "list": [' + ",".join(inner) + ']}, "odd": "'
    df = spark.createDataFrame([("k", flight), ("lone", '{"id": 1, "a": "id"} "never closed {"id": 2} }')], "key string, t string")
    got = P.objects_with(df, "key", "t", "id").collect()
    assert sorted(r.object for r in got if r.key == "k") == sorted([*inner, flight[: flight.rindex("}") + 1]])
    assert [r.object for r in got if r.key == "lone"] == ['{"id": 1, "a": "id"}']


def test_flight_pieces_of_any_length(spark):
    """A piece longer than the JSON parser's own limit of 20 million characters is read."""
    from pyspark.sql import functions as F
    from tidewell.sources import shops as P

    html = F.concat(F.lit('self.__next_f.push([1,"'), F.repeat(F.lit("a\\\\"), F.lit(11_000_000)), F.lit('"])'))
    assert spark.range(1).select(F.length(P.flight_text(html))).first()[0] == 22_000_000


def test_closest_pairs_of_odd_keys(spark, tmp_path):
    """Nulls, keys with several rows, brands of one part, values far apart."""
    for seed in range(6):
        keys, sizes = ("i", "(h // 7) % 9") if seed % 2 else ("h % 60", "(h // 7) % 40")
        rows = f"""SELECT CASE WHEN h % 23 = 0 THEN NULL ELSE {keys} END::BIGINT AS p_partkey, CASE WHEN h % 19 = 0 THEN NULL ELSE concat('b', h % {3 + seed * 4}) END AS p_brand,
        CASE WHEN h % {2 if seed > 3 else 5} = 0 THEN NULL ELSE {sizes} * {sizes} END::INT AS p_size, 1.0::DOUBLE AS p_retailprice FROM (SELECT i, (hash(i + {seed * 1000}) % 100003)::BIGINT AS h FROM range(120) r(i))"""
        folder = tmp_path / str(seed)
        folder.mkdir()
        assert same(spark, folder, "j28_blocked_best_pairs", part=rows) is None


def test_candidates_of_an_hour_are_placed_once(spark, tmp_path, monkeypatch):
    """Ids of several rows, null ids and times, an hour of several slices; no shuffle carries pairs."""
    from tidewell.operators import joins

    monkeypatch.setattr(joins, "SLICE", 16)
    rows = """SELECT CASE WHEN i % 41 = 0 THEN NULL WHEN i % 13 = 0 THEN i // 100 ELSE i END::BIGINT AS event_id, CASE WHEN i % 29 = 0 THEN NULL ELSE TIMESTAMP '2024-01-01' + INTERVAL ((i * i) % 3000) MINUTE * (i % 3) END AS ts,
    (i % 5)::BIGINT AS user_id, (['purchase', 'view', 'signup', 'click'])[i % 7 % 4 + 1] AS event_type, 1.0::DOUBLE AS value FROM range(900) r(i)"""
    assert same(spark, tmp_path, "j9_lateral_candidates", events=rows) is None
    plan = registry.QUERIES["j9_lateral_candidates"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan()
    names = []
    while plan.nodeName() != "Join":  # pairs come of the last join, and no window or aggregate stands above it
        names.append(plan.nodeName())
        plan = plan.children().apply(0)
    assert set(names) <= {"Project", "Union"}


def test_launch_claims_keep_their_plan_small(spark, sf):
    """The driver holds a plan's generated code: what several joins read is written, and one join serves names of all lengths."""
    plan = registry.QUERIES["dc15_launch_claims"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan.split("\n")) < 250


def test_vector_search_of_odd_vectors(spark, monkeypatch):
    """Copies, opposite zeros, nulls, other lengths and values that are no numbers, in blocks of a few rows: as by rows alone."""
    import random

    from pyspark.sql import Window
    from pyspark.sql import functions as F
    from tidewell.functions.scalars import dot
    from tidewell.operators import retrieval as R

    monkeypatch.setattr(R, "BLOCK_ROWS", 16)
    monkeypatch.setattr(R, "BLOCK_QUERIES", 4)
    rng = random.Random(5)
    some = [[rng.uniform(-1, 1) for _ in range(7)] for _ in range(40)]
    vectors = [rng.choice(some) if rng.random() < 0.7 else [rng.uniform(-1, 1) / 3 for _ in range(7)] for _ in range(300)]
    vectors += [None, [], [0.0] * 7, [-0.0] * 7, [1.0, None] + [0.5] * 5, [1.0] * 3, [float("nan")] * 7, [float("inf")] + [0.0] * 6, [1e30] * 7]
    df = spark.createDataFrame(list(enumerate(vectors)), "id long, v array<float>").withColumn("name", F.concat(F.lit("n"), F.col("id").cast("string"))).repartition(3)
    queries = df.where("id % 20 = 0 or id >= 298").select(F.col("id").alias("q"), F.col("v").alias("w"))
    for key, k in (("id", 3), ("name", 400)):
        got = R.vector_search(df, key, "v", queries, "q", "w", k, F.col("id") != 17)
        every = df.where("id != 17").crossJoin(queries.select(F.col("q").alias("query"), "w")).select("query", key, dot(F.col("v"), F.col("w")).alias("similarity")).where("not isnan(similarity)")
        want = every.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("similarity"), key))).where(F.col("place") <= k)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
        assert "MapInArrow" in got._jdf.queryExecution().optimizedPlan().toString()


def test_pair_decisions_meet_in_cells(spark, tmp_path, monkeypatch):
    """Names of several cells, keys of several rows and null keys and brands; pairs of items come of no join."""
    from tidewell.operators import linker

    monkeypatch.setattr(linker, "CELL", 5)
    rows = """SELECT CASE WHEN i % 31 = 0 THEN NULL WHEN i % 17 = 0 THEN i // 3 ELSE i END::BIGINT AS p_partkey, CASE WHEN i % 43 = 0 THEN NULL ELSE concat('b', i % 2) END AS p_brand,
    concat((['red', 'large', 'new'])[i % 3 + 1], ' ', (['ring', 'rod', 'gear', 'bolt plate'])[i % 4 + 1]) AS p_name FROM range(200) r(i)"""
    assert same(spark, tmp_path, "dc6_pair_decisions", part=rows) is None
