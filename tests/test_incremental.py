"""Passes against replays: ends between write and commit, poisoned rows, ties and nulls; derived tables against changed files."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from tidewell.operators.derived import derived, derived_folder, files_fingerprint
from tidewell.streaming import passes as P
from tidewell.streaming.jobs import file_stream

START = datetime(2024, 1, 1)
ROWS = "id long, at timestamp_ntz, kind string"


class Killed(Exception):
    pass


def killed(*_):
    raise Killed


def replay(items, size, kinds, allowed, rounds):
    """[(id, attempt, state)] of each pass, by a plain loop."""
    queue, waiting, out = sorted((at, i) for i, at, _ in items if at is not None), [], []
    for k in range(rounds):
        waiting.sort()
        again, waiting = waiting[:size], waiting[size:]
        fresh, queue = queue[: size - len(again)], queue[size - len(again) :]
        done = []
        for since, i, n in [(since, i, n + 1) for since, i, n in again] + [(k, i, 1) for _, i in fresh]:
            bad = kinds[i] in ("final", "always") or kinds[i] == "twice" and n <= 2
            state = "done" if not bad else "dead" if kinds[i] == "final" or n >= allowed else "waiting"
            done.append((i, n, state))
            if state == "waiting":
                waiting.append((since, i, n))
        out.append(sorted(done))
    return out


@pytest.fixture
def items():
    rng = random.Random(4)
    kinds = ["good"] * 6 + ["final", "always", "twice"]
    # several items of one instant, one without an instant
    return [(i, START + timedelta(minutes=30 * rng.randint(0, 9)), rng.choice(kinds)) for i in range(60)] + [(60, None, "good")]


def attempt(both):
    return F.when(F.col("kind") == "final", "unreadable").when((F.col("kind") == "always") | ((F.col("kind") == "twice") & (F.col("attempt") <= 2)), "refused")


def test_passes_against_a_replay(spark, items, tmp_path):
    df = spark.createDataFrame(items, ROWS)
    s = P.Passes(spark, f"file://{tmp_path}/s")
    want = replay(items, 17, {i: k for i, _, k in items}, 3, 7)
    for k in range(7):
        if k in (0, 3):  # it dies between write and commit
            with pytest.raises(Killed):
                P.run_pass(s, df, "at", "id", 17, attempt, lambda e: e == "unreadable", before_commit=killed)
        P.run_pass(s, df, "at", "id", 17, attempt, lambda e: e == "unreadable")
    got = [[] for _ in range(7)]
    for r in s.all("tried", P._tried(df.schema)).collect():
        got[r["pass"]].append((r.id, r.attempt, r.state))
    assert [sorted(x) for x in got] == want
    dead = {i for x in want for i, _, state in x if state == "dead"}
    assert dead == {i for i, at, k in items if k in ("final", "always")} and not want[-1]


def test_a_waiting_item_that_is_gone(spark, tmp_path):
    df = spark.createDataFrame([(1, START, "always"), (2, START, "good")], ROWS)
    s = P.Passes(spark, f"file://{tmp_path}/s")
    assert P.run_pass(s, df, "at", "id", 5, attempt) == {"waiting": 1, "done": 1}
    assert P.run_pass(s, df.where("id = 2"), "at", "id", 5, attempt) == {}
    assert P.run_pass(s, df.limit(0), "at", "id", 5, attempt) == {}


def test_stream_that_dies_in_a_batch(spark, items, tmp_path):
    for part in range(4):
        spark.createDataFrame([x for x in items if x[0] % 4 == part], ROWS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    s, final = P.Passes(spark, f"file://{tmp_path}/s"), lambda e: e == "unreadable"
    ends = []

    def once(number):
        if number == 2 and not ends:
            ends.append(number)
            raise Killed

    for _ in range(2):
        q = P.tried_stream(file_stream(spark, f"{tmp_path}/in", 1), s, attempt, f"{tmp_path}/state", final, 3, once)
        try:
            q.awaitTermination()
        except Exception:
            assert ends == [2]
    P.drained(s, spark.read.parquet(f"{tmp_path}/in").schema, attempt, final, 3)
    got = sorted((r.id, r.attempt, r.state) for r in s.all("tried", P._tried(spark.createDataFrame([], ROWS).schema)).collect())
    steps = {"good": ["done"], "final": ["dead"], "always": ["waiting", "waiting", "dead"], "twice": ["waiting", "waiting", "done"]}
    assert got == sorted((i, n + 1, state) for i, _, kind in items for n, state in enumerate(steps[kind]))


def test_python_work_fails_row_by_row(spark):
    def work(row):
        if row["id"] % 3 == 0:
            raise ValueError("no\nsecond line")

    out = P.isolated(spark.createDataFrame([(i, "x") for i in range(9)], "id long, t string"), work).collect()
    assert {r.id: r.error for r in out} == {i: "ValueError: no" if i % 3 == 0 else None for i in range(9)}


def test_what_is_fetched(spark, tmp_path):
    s, now = P.Passes(spark, f"file://{tmp_path}/s"), datetime(2024, 6, 1)
    listed = [("new", now - timedelta(days=2)), ("old", now - timedelta(days=90)), ("undated", None), (None, now), ("both", now), ("both", None), ("edge", now - timedelta(days=30))]
    df = spark.createDataFrame(listed, "video string, at timestamp_ntz")
    fetched = lambda: sorted((r["pass"], r.video, r.recent) for r in s.all("fetched", P.T.StructType.fromDDL("video string, recent boolean")).collect())
    P.fetch_pass(s, df, "video", "at", now, 30)
    first = [(0, "both", True), (0, "edge", True), (0, "new", True), (0, "old", False), (0, "undated", False)]
    assert fetched() == first
    P.fetch_pass(s, df.unionByName(spark.createDataFrame([("older", now - timedelta(days=50))], df.schema)), "video", "at", now + timedelta(days=1), 30)
    assert fetched() == sorted([*first, (1, "both", True), (1, "new", True), (1, "older", False)])


def test_first_observations_are_frozen(spark, tmp_path):
    s, kind = P.Passes(spark, f"file://{tmp_path}/s"), "k string, j long, seen timestamp_ntz, v long"
    day = lambda n: START + timedelta(days=n)
    one = spark.createDataFrame([("a", 1, day(1), 10), ("a", 1, day(0), 11), ("a", None, day(0), 12), ("b", 1, day(5), 13), ("c", 1, None, 14)], kind)
    with pytest.raises(Killed):
        P.observe_pass(s, one, ["k", "j"], "seen", day(2), killed)
    assert P.observe_pass(s, one, ["k", "j"], "seen", day(2)) == 2
    two = spark.createDataFrame([("a", 1, day(0), 99), ("a", None, day(0), 99), ("b", 1, day(5), 99)], kind)
    assert [P.observe_pass(s, two, ["k", "j"], "seen", day(9)) for _ in range(2)] == [1, 0]
    assert sorted((r.k, r.j or 0, r.v, r["pass"]) for r in s.all("observed", one.schema).collect()) == [("a", 0, 12, 0), ("a", 1, 11, 0), ("b", 1, 99, 1)]


def test_stale_slices_are_named_and_rewritten(spark, tmp_path):
    s = P.Passes(spark, f"file://{tmp_path}/s")
    rows = lambda *x: spark.createDataFrame(list(x), "month string, v long")
    names = lambda *x: spark.createDataFrame([(m,) for m in x], "slice string")
    table = lambda: sorted((r.month, r.v, r.run) for r in spark.read.parquet(f"{s.folder}/t").collect())
    assert P.rewrite_slices(s, "t", rows(("01", 1), ("02", 2), ("03", 3)), "month", names("01", "02", "03", None)) == []
    with pytest.raises(Killed):
        P.rewrite_slices(s, "t", rows(("02", 20)), "month", names("02", "03"), killed)
    assert sorted(r.slice for r in P.stale_slices(s).collect()) == ["02", "03"]
    with pytest.raises(Killed):  # the next one dies as well
        P.rewrite_slices(s, "t", rows(("01", 10), ("02", 20), ("03", 3)), "month", names("01"), killed)
    assert P.rewrite_slices(s, "t", rows(("01", 10), ("02", 20)), "month", names()) == ["01", "02", "03"]
    assert table() == [("01", 10, 4), ("02", 20, 4)] and P.stale_slices(s).count() == 0  # 03 has no rows any more
    assert P.rewrite_slices(s, "t", rows(("02", 21)), "month", names("02")) == []
    assert table() == [("01", 10, 4), ("02", 21, 6)]


def test_derived_tables_follow_their_files(spark, tmp_path):
    source, root, built = f"{tmp_path}/in", f"file://{tmp_path}/out", []

    def add(v):
        spark.createDataFrame([(v,)], "v long").coalesce(1).write.mode("append").parquet(source)

    def total(*parameters):
        def build():
            built.append(1)
            return spark.read.parquet(source).agg(F.sum("v").alias("s"))

        return derived(spark, root, files_fingerprint(spark, [source], *parameters), build).first()[0]

    add(1)
    assert [total(), total(), len(built)] == [1, 1, 1]
    add(5)
    assert [total(), total(), len(built)] == [6, 6, 2]
    assert [total("other"), len(built)] == [6, 3]
    kept = [p.name for p in (tmp_path / "out").iterdir()]
    assert len(kept) == 2 and not any(n.startswith("_") for n in kept)  # the newest other one stays


def test_derived_folder_of_two_builders_and_of_a_dead_one(spark, tmp_path):
    root = f"file://{tmp_path}/out"

    def build(path):
        if not (tmp_path / "out" / "f").exists():  # another one is faster
            derived_folder(spark, root, "f", lambda p: spark.range(3).write.parquet(p))
        spark.range(3).write.parquet(path)

    assert spark.read.parquet(derived_folder(spark, root, "f", build)).count() == 3
    with pytest.raises(Killed):
        derived_folder(spark, root, "g", lambda p: (spark.range(1).write.parquet(p), killed()))
    assert spark.read.parquet(derived_folder(spark, root, "g", lambda p: spark.range(2).write.parquet(p), half_age=0)).count() == 2
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["f", "g"]
