"""Learned selection: a pairwise ranker fitted by Newton steps over distributed sums.

In each group the best candidate should score above every other: the ranker's loss is logistic in the
difference between the best one's features and another's, plus a ridge.  (Others of equal quality say
nothing and are left out.)  Pairing with the best alone keeps the pairs as many as the candidates,
however large a group is.

A Newton step needs sums over the pairs, of the loss, its gradient and its curvature.  They are one
aggregation, with partial sums before the shuffle, for all models of a grid at once; the driver
solves systems as large as the number of features.  A step that doesn't lower the loss is halved.

Models are chosen on groups that they weren't fitted on: splits are by group, so no group is in two.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridrift.operators import metrics, selection
from veridrift.sources.tables import materialize

#: Newton steps at most, and the largest part of a step that ends them.
STEPS, SMALL_STEP = 60, 1e-10


@dataclass(frozen=True)
class Model:
    """Weights of scaled features: the score of a candidate is their sum."""

    features: tuple[str, ...]
    weights: tuple[float, ...]

    def score(self) -> Column:
        return sum((F.lit(w) * F.col(f) for f, w in zip(self.features, self.weights, strict=True)), F.lit(0.0))


def pairs_with_best(rows: DataFrame, group: str, quality: str, tie: str, features: list[str]) -> DataFrame:
    """The best candidate's features less another's, for each other of lower quality in its group."""
    x = F.struct(*[F.col(f).cast("double").alias(f) for f in features]).alias("x")
    wanted = rows.where(F.col(quality).isNotNull()).select(F.col(group).alias("g"), F.col(quality).alias("q"), F.col(tie).alias("t"), x)
    best = wanted.groupBy("g").agg(F.max_by(F.struct("q", "x"), F.struct("q", -F.col("t"))).alias("best"))
    both = wanted.join(best, "g").where("q < best.q")
    return both.select(*[(F.col(f"best.x.{f}") - F.col(f"x.{f}")).alias(f) for f in features])


def scales(rows: DataFrame, features: list[str]) -> dict[str, float]:
    """Standard deviations, 1 for features that are constant."""
    found = rows.agg(*[F.stddev_pop(F.col(f).cast("double")).alias(f) for f in features]).first()
    return {f: float(found[f]) if found[f] else 1.0 for f in features}


def _sums(model: int, names: list[str], weights: np.ndarray, unit: dict[str, float]) -> list[Column]:
    d = [F.col(f) / F.lit(unit[f]) for f in names]
    z = sum((F.lit(float(w)) * x for w, x in zip(weights, d, strict=True)), F.lit(0.0))
    below = 1 / (1 + F.exp(z))  # the chance of the wrong order
    curve = below * (1 - below)
    out = [F.sum(F.greatest(-z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z)))).alias(f"m{model}_loss")]
    out += [F.sum(below * x).alias(f"m{model}_g{i}") for i, x in enumerate(d)]
    out += [F.sum(curve * d[i] * d[j]).alias(f"m{model}_h{i}_{j}") for i in range(len(d)) for j in range(i, len(d))]
    return out


def fit(pairs: DataFrame, grid: list[tuple[tuple[str, ...], float]], unit: dict[str, float]) -> list[Model]:
    """A model for each (features, ridge), from stored ``pairs``; features are divided by ``unit``."""
    at = [np.zeros(len(names)) for names, _ in grid]
    before: list[tuple[np.ndarray, float] | None] = [None] * len(grid)
    step = [np.zeros(len(names)) for names, _ in grid]
    live = set(range(len(grid)))
    for _ in range(STEPS):
        if not live:
            break
        row = pairs.agg(F.count("*").alias("n"), *[c for m in sorted(live) for c in _sums(m, list(grid[m][0]), at[m], unit)]).first()
        if not row["n"]:
            break
        for m in sorted(live):
            (names, ridge), w = grid[m], at[m]
            p = len(names)
            loss = row[f"m{m}_loss"] + ridge / 2 * float(w @ w)
            if before[m] is not None and loss > before[m][1] + 1e-9 * abs(before[m][1]):
                step[m] = step[m] / 2
                at[m] = before[m][0] + step[m]
                if np.abs(step[m]).max(initial=0) < SMALL_STEP:
                    at[m] = before[m][0]
                    live.discard(m)
                continue
            gradient = np.array([row[f"m{m}_g{i}"] for i in range(p)]) - ridge * w
            curvature = ridge * np.eye(p)
            for i in range(p):
                for j in range(i, p):
                    curvature[i, j] += row[f"m{m}_h{i}_{j}"]
                    curvature[j, i] = curvature[i, j]
            step[m] = np.linalg.lstsq(curvature, gradient, rcond=None)[0]
            before[m] = (w, loss)
            at[m] = w + step[m]
            if np.abs(step[m]).max(initial=0) < SMALL_STEP:
                live.discard(m)
    return [Model(names, tuple(float(x) / unit[f] for x, f in zip(w, names, strict=True))) for (names, _), w in zip(grid, at, strict=True)]


@dataclass
class Learned:
    """The models of a grid by name, how they did on the validation groups, which is chosen, and how that did on the test groups."""

    models: dict[str, Column]
    fitted: dict[str, Model]
    validation: DataFrame
    chosen: str | None
    test: DataFrame


def learn(
    rows: DataFrame,
    group: str,
    sample: str,
    quality: str,
    tie: str,
    sets: dict[str, list[str]],
    ridges: dict[str, float],
    weights: dict[str, float],
    utility: Column,
    shares: dict[str, float],
    seed: int = 0,
) -> Learned:
    """Fit a grid of rankers on the train groups and choose one on the validation groups.

    A model of the grid is a set of features, a ridge, and the weight of the ranker against
    ``utility``, a score that is given.  ``shares`` are those of the splits train, validation and
    test.  The choice is by least regret, then most capture, then top-1 accuracy, then name.
    """
    split = materialize(rows.withColumn("split", selection.split_of(F.col(group), shares, seed)), "split")
    features = list(dict.fromkeys(f for fs in sets.values() for f in fs))
    train = split.where("split = 'train'")
    unit = scales(train, features)
    pairs = materialize(pairs_with_best(train, group, quality, tie, features), "pairs")
    grid = list(product(sets, ridges))
    made = dict(zip(grid, fit(pairs, [(tuple(sets[s]), ridges[r]) for s, r in grid], unit), strict=True))
    scores = {f"{s}/{r}/{w}": F.lit(share) * made[s, r].score() + F.lit(1 - share) * utility for (s, r), (w, share) in product(grid, weights.items())}

    def picked(part: str, names: list[str]) -> DataFrame:
        # scores are rounded, so that candidates alike in all features tie in every engine
        orders = {name: [-F.round(scores[name], 9), F.col(tie)] for name in names}
        picks = selection.pick_strategies(split.where(F.col("split") == part), group, sample, quality, orders)
        return metrics.leaderboard(picks)

    validation = materialize(picked("validation", list(scores)), "validation")
    first = selection.lexicographic(validation, [("mean_regret", True), ("quality_capture", False), ("top1_accuracy", False)], "strategy").first()
    chosen = first["strategy"] if first else None
    return Learned(scores, {f"{s}/{r}": m for (s, r), m in made.items()}, validation, chosen, picked("test", [chosen] if chosen else list(scores)[:1]))
