"""Reconciliation, time, cubes, sketches and streams against brute force."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from veridrift.operators import cubes, reconcile, sketches, temporal
from veridrift.streaming import events

START = datetime(2024, 1, 1)
MINUTE = 60_000_000


def at(minutes):
    return None if minutes is None else START + timedelta(minutes=minutes)


# reconciliation
def bags(rows):
    out = {}
    for k, v in rows:
        out.setdefault(k, []).append(v)
    return {k: sorted(v, key=repr) for k, v in out.items()}


def brute_reconcile(a, b):
    a, b = bags(a), bags(b)
    out = []
    for k in {*a, *b}:
        x, y = a.get(k, []), b.get(k, [])
        if x != y:
            out.append((k, "missing" if not y else "unexpected" if not x else "different", len(x), len(y)))
    return sorted(out, key=repr)


def reconciled(spark, a, b):
    made = reconcile.reconcile(*[spark.createDataFrame(x, "k string, v string") for x in (a, b)], ["k"], ["v"])
    return made, sorted((tuple(r) for r in made.differences.collect()), key=repr)


def test_reconciliation_compares_only_what_differs(spark):
    n = 20_000
    a = [(f"k{i}", f"v{i}") for i in range(n)]
    b = [(k, v + "!" if i % 5000 == 7 else v) for i, (k, v) in enumerate(a) if i % 7000 != 3] + [("new", "x")]
    made, got = reconciled(spark, a, b)
    assert got == brute_reconcile(a, b) and len(got) == 8
    assert made.ranges <= 8 and made.rows <= 8 * reconcile.FEW and made.levels >= 2


def test_reconciliation_of_bags_and_nulls(spark):
    r = random.Random(1)
    value = lambda: r.choice(["x", "y", None])
    a = [(r.choice(["a", "b", "c", None, f"k{r.randrange(40)}"]), value()) for _ in range(300)]
    b = [x for x in a if r.random() < 0.95] + [("z", None), ("z", None)]
    assert reconciled(spark, a, b)[1] == brute_reconcile(a, b)
    made, got = reconciled(spark, a, list(reversed(a)))
    assert got == [] and made.rows == 0 and made.levels == 1
    assert reconciled(spark, a, [])[1] == brute_reconcile(a, []) and reconciled(spark, [], [])[1] == []


# time
def timed(seed, n, keys="abc", span=2000):
    r = random.Random(seed)
    return [(i, r.choice([*keys, "a", "a", None]), r.choice([r.randrange(span), r.randrange(span), None])) for i in range(n)]


@pytest.mark.parametrize("block", [1, 50, 5000])
def test_asof_equals_brute_force(spark, block):
    left, right = timed(1, 300), timed(2, 120)
    frame = lambda rows: spark.createDataFrame([(i, k, at(t)) for i, k, t in rows], "i long, k string, t timestamp")
    got = {r["i"]: r["asof_i"] for r in temporal.asof_join(frame(left), frame(right), "k", "t", "k", "t", ["i"], ["i"], block * MINUTE).collect()}
    want = {}
    for i, k, t in left:
        found = [(u, j) for j, m, u in right if k is not None and m == k and u is not None and t is not None and u <= t]
        want[i] = max(found)[1] if found else None
    assert got == want and any(v is not None for v in want.values())


@pytest.mark.parametrize(("low", "high"), [(-30, 60), (0, 0), (10, 200)])
def test_interval_join_equals_brute_force(spark, low, high):
    left, right = timed(3, 200), timed(4, 200)
    frame = lambda rows, c: spark.createDataFrame([(i, k, at(t)) for i, k, t in rows], f"{c}i long, {c}k string, {c}t timestamp")
    joined = temporal.interval_join(frame(left, "l"), frame(right, "r"), "lk", "lt", "rk", "rt", low * MINUTE, high * MINUTE)
    got = sorted((r["li"], r["ri"]) for r in joined.collect())
    assert got == sorted((i, j) for i, k, t in left for j, m, u in right if k == m is not None and None not in (t, u) and low <= u - t <= high)
    assert "NestedLoop" not in joined._jdf.queryExecution().executedPlan().toString() and "Cartesian" not in joined._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(("back", "block"), [(100, 100), (100, 777), (0, 1)])
def test_range_sums_equal_brute_force(spark, back, block):
    rows = timed(5, 300)
    df = spark.createDataFrame([(i, k, at(t), i) for i, k, t in rows], "i long, k string, t timestamp, v long")
    got = {r["i"]: (r["n"], r["s"]) for r in temporal.range_sums(df, "k", "t", {"n": F.lit(1), "s": F.col("v")}, back * MINUTE, block * MINUTE).collect()}
    for i, k, t in rows:
        here = [j for j, m, u in rows if m == k and u is not None and t is not None and t - back <= u <= t]
        assert got[i] == ((None, None) if k is None or t is None else (len(here), sum(here)))
    with pytest.raises(ValueError, match="as long as the frame"):
        temporal.range_sums(df, "k", "t", {}, 10, 5)


# states
def test_merged_cube_equals_one_of_all(spark):
    r = random.Random(6)
    rows = [(r.choice(["a", "b", None]), r.randrange(3), r.choice([None, r.randrange(1000) / 100])) for _ in range(500)]
    df = spark.createDataFrame(rows, "x string, y long, v double")
    states = [cubes.state(df.where(f"y = {y}"), ["x", "y"], ["v"]) for y in range(3)]
    one = cubes.cube(cubes.merged([cubes.merged(states[:2], ["x", "y"], ["v"]), states[2]], ["x", "y"], ["v"]), ["x", "y"], ["v"])
    all_ = df.cube("x", "y").agg(F.grouping_id().alias("level"), F.count("*"), F.count("v"), F.sum(F.col("v").cast("decimal(28,4)")).cast("double"), F.min("v"), F.max("v"))
    key = lambda rs: sorted((tuple(None if x is None else round(x, 9) if isinstance(x, float) else x for x in r) for r in rs), key=repr)
    assert key(one.drop("v_mean").collect()) == key(all_.collect())


def test_sketch_errors_are_within_their_bounds(spark):
    df = spark.range(0, 60_000, 1, 4).select((F.col("id") % 6).alias("part"), (F.col("id") * 7 % 20_000).alias("k"), (F.col("id") % 997).cast("double").alias("v"))
    stored = sketches.states(df, ["part"], "k", "v")
    row = sketches.merged(stored, []).select("rows", sketches.distinct(F.col("hll")), sketches.quantile(F.col("kll"), 0.9), F.theta_sketch_estimate("theta")).first()
    assert row[0] == 60_000 and abs(row[1] - 20_000) <= sketches.HLL_ERROR * 20_000 and abs(row[2] / 997 - 0.9) <= sketches.RANK_ERROR and abs(row[3] - 20_000) <= sketches.THETA_ERROR * 20_000
    two = df.withColumn("half", F.when(F.col("k") < 12_000, "low").otherwise("high")).unionByName(df.where("k between 8000 and 11999").withColumn("half", F.lit("high")))
    by = {r["half"]: r for r in sketches.merged(sketches.states(two, ["half", "part"], "k", "v"), ["half"]).collect()}
    frame = spark.createDataFrame([(bytes(by["low"]["theta"]), bytes(by["high"]["theta"]))], "a binary, b binary")
    assert abs(frame.select(sketches.overlap(F.col("a"), F.col("b"))).first()[0] - 4000) <= sketches.THETA_ERROR * 20_000


# streams
def arrive(spark, path, batches):
    for rows in batches:
        spark.createDataFrame([(i, at(t), k, float(v)) for i, t, k, v in rows], "i long, ts timestamp, k string, v double").coalesce(1).write.mode("append").parquet(path)
    return events.arrivals(spark, path, "i long, ts timestamp, k string, v double")


BATCHES = [[(1, 0, "a", 1), (2, 14, "a", 2)], [(3, 50, "b", 3), (4, 12, "a", 4)], [(5, 3, "a", 5), (6, 49, "b", 6)], [(7, 2, "a", 7)], [(9, 5000, "end", 0)]]


def test_windows_and_late_rows(spark, tmp_path):
    stream = arrive(spark, f"{tmp_path}/in", BATCHES)
    for window, want in (
        (events.tumbling(F.col("ts"), "10 minutes"), {(0, "a", 2), (10, "a", 2), (40, "b", 1), (50, "b", 1)}),
        (events.sliding(F.col("ts"), "20 minutes", "10 minutes"), {(-10, "a", 2), (0, "a", 4), (10, "a", 2), (30, "b", 1), (40, "b", 2), (50, "b", 1)}),
        (events.session(F.col("ts"), "5 minutes"), {(0, "a", 2), (12, "a", 2), (49, "b", 2)}),
    ):
        got = events.exhausted(events.counts(stream, window, ["k"], "v", delay="30 minutes"))
        assert {((r["start"] - START).total_seconds() / 60, r["k"], r["n"]) for r in got.collect()} == want
    plain = events.exhausted(events.counts(stream, events.tumbling(F.col("ts"), "10 minutes"), ["k"], "v", delay="30 minutes"))
    assert events.late_rows(spark.read.parquet(f"{tmp_path}/in").where("k != 'end'"), plain).first()[0] == 1


def test_state_is_kept_from_batch_to_batch(spark, tmp_path):
    stream = arrive(spark, f"{tmp_path}/in", [[(1, 0, "a", 1), (2, 1, "a", 1), (3, 1, "b", 5)], [(4, 2, "a", 2), (5, 3, "b", 5)], [(6, 4, "a", 2), (7, 4, "b", 4)]])
    got = {(r["key"], r["at"], r["value"], r["before"]) for r in events.exhausted(events.drifts(stream, "k", "v", "i")).collect()}
    assert got == {("a", 4, 2.0, 1.0), ("b", 7, 4.0, 5.0)}
