"""The learned selector against NumPy."""

import hashlib

import numpy as np
import pytest
from oracle import SF
from pyspark.sql import functions as F

from veridrift.operators import ranker, selection
from veridrift.plans import fixture, registry


def newton(d, ridge, steps=60):
    w = np.zeros(d.shape[1])
    for _ in range(steps):
        s = 1 / (1 + np.exp(d @ w))
        w = w + np.linalg.solve((d * (s * (1 - s))[:, None]).T @ d + ridge * np.eye(len(w)), d.T @ s - ridge * w)
    return w


def pairs_of(groups, quality, tie, x):
    out = []
    for g in np.unique(groups):
        at = np.flatnonzero(groups == g)
        best = at[np.lexsort((tie[at], -quality[at]))[0]]
        out += [x[best] - x[i] for i in at if quality[i] < quality[best]]
    return np.array(out)


def test_coefficients_equal_numpy(spark):
    r = np.random.default_rng(4)
    n = 1200
    groups, tie = r.integers(0, 300, n), np.arange(n)
    x = np.column_stack([r.normal(size=n), 100 * r.random(n), np.full(n, 3.0)])
    quality = np.round((x[:, 0] + 0.01 * x[:, 1] + r.normal(size=n)).clip(-1, 1), 1)
    rows = spark.createDataFrame([(int(g), float(q), int(t), *map(float, v)) for g, q, t, v in zip(groups, quality, tie, x, strict=True)], "g long, q double, t long, a double, b double, c double").repartition(5)
    unit = ranker.scales(rows, ["a", "b", "c"])
    assert unit["a"] == pytest.approx(x[:, 0].std()) and unit["c"] == 1.0
    pairs = ranker.pairs_with_best(rows, "g", "q", "t", ["a", "b", "c"])
    d = pairs_of(groups, quality, tie, x)
    assert pairs.count() == len(d)
    grid = [(("a", "b"), 0.5), (("a",), 10.0), (("c", "b", "a"), 1e-3)]
    for model, (names, ridge) in zip(ranker.fit(pairs, grid, unit), grid, strict=True):
        u = np.array([unit[f] for f in names])
        want = newton(d[:, ["abc".index(f) for f in names]] / u, ridge) / u
        assert model.weights == pytest.approx(want.tolist(), rel=1e-7, abs=1e-9)


def test_steps_are_halved_and_separable_data_ends(spark):
    rows = spark.createDataFrame([(g, float(k), k, float(k * 50)) for g in range(20) for k in range(3)], "g long, q double, t long, a double")
    pairs = ranker.pairs_with_best(rows, "g", "q", "t", ["a"])
    (model,) = ranker.fit(pairs, [(("a",), 1e-6)], {"a": 1.0})
    assert model.weights[0] == pytest.approx(newton(np.array([[50.0], [100.0]] * 20), 1e-6)[0], rel=1e-6) and model.weights[0] > 0
    assert ranker.fit(pairs.limit(0), [(("a",), 1.0)], {"a": 1.0})[0].weights == (0.0,)


def test_learned_selection_equals_numpy(spark):
    rows = fixture.candidates(spark, SF).orderBy("group_id", "k").toPandas()
    part = [int(hashlib.md5(f"7:{g}".encode()).hexdigest()[:8], 16) / 2**32 for g in rows["group_id"]]
    split = np.array(["train" if s < 0.7 else "validation" if s < 0.85 else "test" for s in part])
    train = rows[split == "train"]
    want = {}

    def board(name, at, score):
        here = rows[split == at].assign(s=-np.round(score[split == at], 9))
        best = here.sort_values(["group_id", "quality", "sample_id"], ascending=[True, False, True]).groupby("group_id").first()
        pick = here.sort_values(["group_id", "s", "k"]).groupby("group_id").first()
        regret = best["quality"] - pick["quality"]
        return len(pick), regret.mean(), (pick["quality"] / best["quality"]).mean(), (pick["sample_id"] == best["sample_id"]).mean()

    scores = {}
    for s, names in registry.RANKING.items():
        x = train[names].to_numpy(dtype=float)
        u = np.array([v if v else 1.0 for v in x.std(axis=0)])
        d = pairs_of(train["group_id"].to_numpy(), train["quality"].to_numpy(), train["k"].to_numpy(), x)
        for r, ridge in registry.RIDGES.items():
            w = newton(d / u, ridge) / u
            for f, share in registry.FUSIONS.items():
                scores[f"{s}/{r}/{f}"] = share * (rows[names].to_numpy(dtype=float) @ w) + (1 - share) * 10 * rows["l_discount"].to_numpy()
    want = {name: board(name, "validation", score) for name, score in scores.items()}
    chosen = min(want, key=lambda m: (want[m][1], -want[m][2], -want[m][3], m))
    got = {r["model"]: r for r in registry.queries()["learned_selection"](spark, SF).collect()}
    assert len(got) == 27 and [m for m, r in got.items() if r["chosen"]] == [chosen]
    for name, (n, regret, capture, top) in want.items():
        r = got[name]
        assert (r["groups"], r["mean_regret"], r["quality_capture"], r["top1_accuracy"]) == (n, *map(pytest.approx, (regret, capture, top)))
    n, regret, capture, top = board(chosen, "test", scores[chosen])
    r = got[chosen]
    assert (r["test_groups"], r["test_mean_regret"], r["test_quality_capture"], r["test_top1_accuracy"]) == (n, *map(pytest.approx, (regret, capture, top)))
    assert all(r["test_groups"] is None for m, r in got.items() if m != chosen)


def test_no_group_in_two_splits(spark):
    rows = fixture.candidates(spark, SF).withColumn("split", selection.split_of(F.col("group_id"), registry.SHARES, 7))
    assert selection.leaked_groups(rows, "group_id", "split").isEmpty()
    assert {r["split"] for r in rows.select("split").distinct().collect()} == set(registry.SHARES)
