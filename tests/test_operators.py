"""Selection, bootstrap and calibration on small tables."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from veridrift.functions.identifiers import parse_sample, parse_split_sample
from veridrift.functions.numeric import close, finite, within
from veridrift.operators import bootstrap, calibration, checks, metrics, selection


def test_close_and_finite(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1.0, 1.0 + 5e-10, True), (1.0, 1.0 + 5e-9, False), (1e12, 1e12 + 100.0, True), (nan, nan, False), (inf, inf, False), (None, 1.0, False), (0.0, 1e-9, True)]
    df = spark.createDataFrame(rows, "a double, b double, want boolean")
    got = df.select(close(F.col("a"), F.col("b")).alias("x"), "want", finite(F.col("a")).alias("f"), "a").collect()
    for r, (a, b, want) in zip(got, rows, strict=True):
        assert r["x"] is want
        assert r["f"] is (a is not None and math.isfinite(a))
        if a is not None and math.isfinite(a):
            assert math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9) is want
    assert df.select(within(F.col("a"))).collect()[3][0] is False


def test_bootstrap_equals_numpy(spark):
    rng = np.random.default_rng(5)
    diffs = rng.normal(0, 0.1, 12)
    df = spark.createDataFrame([("s", f"g{i:02}", float(d)) for i, d in enumerate(diffs)], "strategy string, group_id string, diff double")
    index = np.random.default_rng(20260827).integers(0, 12, size=(2000, 12))
    low, high = np.percentile(diffs[index].mean(axis=1), [2.5, 97.5])
    got = bootstrap.paired_bootstrap(df, bootstrap.numpy_index(spark, 12, 2000, 20260827), 2000).first()
    assert (got["low"], got["high"]) == pytest.approx((low, high), abs=1e-12)
    assert got["draws"] == 2000


def test_capture_is_a_mean_of_ratios(spark):
    picks = spark.createDataFrame([("s", 0.2, 0.4, 0.2, False), ("s", 0.9, 0.9, 0.0, True), ("s", 0.0, 0.0, 0.0, True)], "strategy string, selected_quality double, optimal_quality double, regret double, top1_correct boolean")
    assert metrics.leaderboard(picks).first()["quality_capture"] == pytest.approx(0.75)


def test_lexicographic_and_checkpoint_choice(spark):
    rows = [("a", 0.1, 0.8), ("b", 0.1, 0.9), ("c", 0.2, 1.0), ("d", 0.1, 0.9)]
    df = spark.createDataFrame(rows, "name string, regret double, capture double")
    assert selection.lexicographic(df, [("regret", True), ("capture", False)], "name").first()["name"] == "b"
    # more valid samples come before a higher mean
    two = spark.createDataFrame([("x", 30, 0.5180), ("y", 28, 0.5457)], "name string, valid int, mean double")
    assert selection.lexicographic(two, [("valid", False), ("mean", False)], "name").first()["name"] == "x"


def test_identifiers(spark):
    df = spark.createDataFrame([("v3_015_c2_s77",), ("lora_dev_test_210_c0_s5",), ("odd",)], "id string")
    a, b, c = df.select(parse_sample(F.col("id")).alias("p"), parse_split_sample(F.col("id")).alias("q")).collect()
    assert tuple(a["p"]) == ("v3_015", 2, 77)
    assert tuple(b["q"]) == ("lora", "dev_test", "210", 0, 5)
    assert tuple(c["p"]) == (None, None, None)


def test_normalisation_and_gate(spark):
    df = spark.createDataFrame([(1.0,), (5.0,), (9.0,), (None,)], "x double")
    up = [r[0] for r in df.select(calibration.normalized(F.col("x"), F.lit(2.0), F.lit(8.0))).collect()]
    down = [r[0] for r in df.select(calibration.normalized(F.col("x"), F.lit(2.0), F.lit(8.0), False)).collect()]
    assert up == [0.0, 0.5, 1.0, None] and down == [1.0, 0.5, 0.0, None]
    assert [r[0] for r in df.select(calibration.normalized(F.col("x"), F.lit(2.0), F.lit(2.0))).collect()] == [0.0, 0.0, 0.0, None]
    gates = spark.createDataFrame([({"a": True, "b": True},), ({"a": True, "b": None},), ({},)], "checks map<string, boolean>")
    assert [r[0] for r in gates.select(calibration.gate(F.col("checks"))).collect()] == [True, False, False]
    assert [r[0] for r in calibration.failed_checks(gates).collect()] == ["b"]


def test_asset_drift_modes(spark):
    rows = [("a", i, 1.0 + i * 8e-10) for i in range(4)] + [("b", 0, 1.0), ("b", 1, 1.1)]
    df = spark.createDataFrame(rows, "k string, i int, v double")
    assert {r["k"] for r in checks.asset_drift(df, ["k"], "v").collect()} == {"a", "b"}
    # a chain of small drifts passes where each is held against the one before
    assert {r["k"] for r in checks.asset_drift(df, ["k"], "v", ["i"]).collect()} == {"b"}


def test_guarded_and_weighted(spark):
    df = spark.createDataFrame([(0.5, 1.0), (1.0, 3.0), (None, 5.0)], "v double, w double")
    assert df.agg(selection.weighted_mean("v", "w")).first()[0] == pytest.approx(3.5 / 4)
    assert df.select(selection.guarded(F.lit("new"), F.lit("old"), F.col("v") > 0.7)).collect() == [("old",), ("new",), ("old",)]


def test_splits_keep_groups_whole(spark):
    df = spark.range(2000).withColumn("g", F.expr("id % 200"))
    split = df.withColumn("split", selection.split_of(F.col("g"), {"a": 0.5, "b": 0.3, "c": 0.2}))
    assert selection.leaked_groups(split, "g", "split").count() == 0
    shares = {r["split"]: r["n"] / 200 for r in split.select("g", "split").distinct().groupBy("split").agg(F.count("*").alias("n")).collect()}
    assert set(shares) == {"a", "b", "c"} and abs(shares["a"] - 0.5) < 0.15


def test_top_k_is_limited_before_the_shuffle(spark):
    df = spark.range(1000).withColumn("g", F.expr("id % 10"))
    plan = selection.first_k(df, ["g"], [F.col("id")], 2)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
