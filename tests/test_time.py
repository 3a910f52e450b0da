"""Joins by time, sessions and records that come in batches, against brute force."""

import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from kinfold.operators import entities, matching, temporal
from kinfold.plans import registry
from kinfold.scratch import Scratch
from kinfold.sources.companies import company_records, records_of_pages
from kinfold.streaming import incremental, sessions

T0 = datetime(2024, 1, 1)
LEFT, RIGHT = "k string, ts timestamp, name string", "k string, at timestamp, v long, w string"


def times(n, seed, days=9, key=lambda i: "hot" if i % 3 == 0 else f"k{i % 5}"):
    rng = random.Random(seed)
    return [(key(i), T0 + timedelta(seconds=rng.randrange(days * 86_400) // 60 * 60)) for i in range(n)]


def test_asof_join(spark):
    """A hot key, equal times on both sides, days without a right row, nulls, repeated rows, clashing names."""
    left = [(k, t, f"n{i}") for i, (k, t) in enumerate(times(150, 1))] + [(None, T0, "x"), ("hot", None, "y"), ("none", T0, "z")] + [("hot", T0, "a")] * 2
    right = [(k, t, i, None if i % 4 else "w") for i, (k, t) in enumerate(times(120, 2, 3))] + [(None, T0, 1, "q"), ("hot", None, 1, "q"), ("hot", T0, 7, "a"), ("hot", T0, 7, "b"), ("hot", T0, 7, None)]
    before = lambda k, t: [(x[1], x[2], x[3] is not None, x[3] or "") for x in right if None not in (k, t, x[1]) and x[0] == k and x[1] <= t]
    best = lambda x: (x[1], x[3] if x[2] else None)
    want = Counter((*r, *(best(max(before(*r[:2]))) if before(*r[:2]) else (None, None))) for r in left)
    for seconds in (600, 86_400, 10**9):
        got = temporal.asof_join(spark.createDataFrame(left, LEFT), spark.createDataFrame(right, RIGHT), "k", "ts", "at", ("v", "w"), seconds)
        assert got.columns == ["k", "ts", "name", "v", "w"] and Counter(map(tuple, got.collect())) == want
    nothing = temporal.asof_join(spark.createDataFrame(left, LEFT), spark.createDataFrame([], RIGHT), "k", "ts", "at", ("v",))
    assert nothing.where("v is not null").count() == 0 and nothing.count() == len(left)


def test_ranges_are_cut_into_nodes(spark):
    """Each second of a range lies in one node, and a long range has few."""
    rng = random.Random(4)
    cases = [(0, 1), (15, 17), (16, 32), (5, 5), (3, 700), (255, 4097), (1_700_000_000, 1_800_000_000)] + [(a, a + rng.randrange(3000)) for a in (rng.randrange(5000) for _ in range(40))]
    df = spark.createDataFrame(cases, "a long, b long").select("a", "b", temporal.nodes_of_range(F.col("a"), F.col("b")).alias("n"))
    for r in df.collect():
        spans = sorted((p * 16**s, (p + 1) * 16**s) for s, p in r.n)
        assert len(spans) <= 2 * 15 * temporal.STEPS and (not spans if r.a == r.b else spans[0][0] == r.a and spans[-1][1] == r.b)
        assert all(x[1] == y[0] for x, y in zip(spans[:-1], spans[1:], strict=True))


def test_interval_join(spark):
    points = [(k, t + timedelta(microseconds=i % 3)) for i, (k, t) in enumerate(times(150, 5))] + [(None, T0), ("hot", None), ("hot", T0), ("hot", T0)]
    rng = random.Random(6)
    ranges = [(k, t, t + timedelta(seconds=rng.choice([0, 1, 59, 3600, 200_000, 10**9]), microseconds=rng.choice([0, 1])), i) for i, (k, t) in enumerate(times(60, 7))] + [(None, T0, T0 + timedelta(1), 98), ("hot", T0 + timedelta(1), T0, 99), ("hot", None, T0, 100), ("hot", datetime(1950, 1, 1), datetime(2100, 1, 1), 101)]
    got = temporal.interval_join(spark.createDataFrame(points, "k string, ts timestamp"), spark.createDataFrame(ranges, "k string, a timestamp, b timestamp, i long"), "k", "ts", "a", "b")
    want = Counter((k, t, a, b, i) for k, t in points for q, a, b, i in ranges if None not in (k, t, a) and k == q and a <= t < b)
    assert Counter((r.k, r.ts, r.a, r.b, r.i) for r in got.collect()) == want and want
    assert got.limit(0).count() == temporal.interval_join(spark.createDataFrame([], "k string, ts timestamp"), spark.createDataFrame(ranges, "k string, a timestamp, b timestamp, i long"), "k", "ts", "a", "b").count() == 0
    plan = registry.QUERIES["interval_join"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_ranges_of_a_day_are_few_nodes(spark):
    """32 nodes on average, of three steps, so a point is there three times."""
    rng = random.Random(9)
    days = [(t, t + timedelta(days=1), i) for i, (_, t) in enumerate(times(400, 10))] + [(T0, T0 + timedelta(seconds=rng.randrange(1, 3000)), -1)]
    df = spark.createDataFrame(days, "a timestamp, b timestamp, i long")
    nodes = temporal.laid(df, "a", "b").where("i >= 0")
    assert {r.step for r in nodes.select("step").distinct().collect()} == {2, 3, 4} and nodes.count() <= 400 * 40


EVENTS = "user_id long, ts timestamp, value double"


def islands(rows, minutes=30):
    out = Counter()
    for user in {r[0] for r in rows if None not in r[:2]}:
        run = []
        for t, v in [*sorted((r[1], r[2]) for r in rows if r[0] == user and r[1] is not None), (datetime(2100, 1, 1), 0)]:
            if run and t - run[-1][0] >= timedelta(minutes=minutes):
                out[user, run[0][0], run[-1][0], len(run), round(sum(x or 0 for _, x in run), 6)] += 1
                run = []
            run.append((t, v))
    return out


def told(df):
    return Counter((r.user_id, r.session_start, r.session_end, r.n_events, round(r.total_value or 0, 6)) for r in df.collect())


def test_sessions_of_a_stream(spark, tmp_path):
    """Four files in order; gaps of just under and just the half hour; nulls; a row too late for its session; then the stream goes on."""
    rng = random.Random(8)
    rows = [(i % 3, T0 + timedelta(minutes=rng.randrange(60 * 24 * 4)), float(i)) for i in range(240)] + [(7, T0, 1.0), (7, T0 + timedelta(minutes=29, seconds=59), 1.0), (7, T0 + timedelta(minutes=60), 1.0), (None, T0, 1.0), (3, None, 1.0)]
    rows.sort(key=lambda r: r[1] or T0)
    assert told(sessions.sessions(spark.createDataFrame(rows, EVENTS))) == islands(rows)
    feed, root = str(tmp_path / "feed"), str(tmp_path / "root")
    put = lambda part: spark.createDataFrame(part, EVENTS).coalesce(1).write.mode("append").parquet(feed)
    for k in range(4):
        put(rows[k * len(rows) // 4 : (k + 1) * len(rows) // 4])
    got = told(sessions.run(spark, feed, root, end=False))
    # the last hour's sessions are still open
    assert got < islands(rows)
    put([(0, T0 - timedelta(days=3), 5.0), (1, T0 + timedelta(days=5), 2.0)])
    late = told(sessions.run(spark, feed, root))
    assert late == islands([*rows, (1, T0 + timedelta(days=5), 2.0)])


def test_sessions_of_an_empty_stream(spark, tmp_path):
    spark.createDataFrame([], EVENTS).write.parquet(str(tmp_path / "feed"))
    assert sessions.run(spark, str(tmp_path / "feed"), str(tmp_path / "root")).count() == 0


@pytest.mark.parametrize("parts", [1, 4])
def test_records_in_batches(spark, sf_dir, tmp_path, parts):
    """The golden ids are those of all records at once, whatever the batches; doing one again changes nothing."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    records = Scratch(spark).keep(company_records(spark, sf_dir))
    prep = Scratch(spark).keep(matching.prepare(records))
    whole = entities.golden_entities(prep, matching.score(matching.compare(matching.candidate_pairs(prep)), matching.FIXED))
    want = {r.record_id: r.golden_entity_id for r in whole.collect()}
    assert len(set(want.values())) < len(want)
    feed, root = str(tmp_path / "feed"), str(tmp_path / "store")
    for k in range(parts):
        pages.where(F.col("page_id") % parts == k).coalesce(1).write.mode("append").parquet(feed)
    store = incremental.run(spark, feed, records_of_pages, matching.FIXED, root)
    state = lambda: {r.record_id: r.golden_entity_id for r in store.golden().collect()}
    assert state() == want
    incremental.run(spark, feed, records_of_pages, matching.FIXED, root)
    assert state() == want
    # the last batch once more, with repeats and records that are stored already
    stored = spark.read.parquet(f"{root}/records")
    numbers = sorted(r.batch for r in stored.select("batch").distinct().collect())
    assert len(numbers) == parts
    again = Scratch(spark).keep(records.join(stored.where(F.col("batch").isin(numbers[0], numbers[-1])), "record_id", "left_semi"))
    incremental.absorb(again.union(again), numbers[-1], store, matching.FIXED)
    assert state() == want
    incremental.absorb(records, numbers[-1] + 1, store, matching.FIXED)
    assert state() == want
    incremental.absorb(records.limit(0), numbers[-1] + 2, store, matching.FIXED)
    assert state() == want and store.golden(0).count() == 0
