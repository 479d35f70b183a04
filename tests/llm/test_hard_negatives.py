"""Hard negatives against a brute-force version in whole numbers."""

import math
import random

import pytest
from pyspark.sql import functions as F

from veridrift.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int, slot string, score string"


def brute(rows, positives=5, negatives=5):
    key = lambda s, i: (-s, i is None, i or 0)
    part = [
        (i, [math.floor(256 * x) for x in v], (label + 1) % 10 if i is not None and i % 7 == 0 else label)
        for i, v, label, *_ in rows
        if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))  # noqa: B905, E731
    out = []
    for at, (i, v, label) in enumerate(part):
        if i is None or i % 100:
            continue
        scored = [(dot(v, w), j, m == label) for k, (j, w, m) in enumerate(part) if k != at]
        for ps, pid, _ in sorted((s for s in scored if s[2]), key=lambda s: key(s[0], s[1]))[:positives]:
            near = sorted((s for s in scored if not s[2] and 80 * ps <= 100 * s[0] <= 100 * ps), key=lambda s: key(s[0], s[1]))
            out += [(i, pid, r + 1, nid, ps, ns) for r, (ns, nid, _) in enumerate(near[:negatives])]
    return sorted(out, key=repr)


def run(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    label = F.col("label").cast("long")
    moved = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    found = hn.hard_negatives(df, F.col("vec_id"), moved, F.col("embedding"), F.col("vec_id") % 100 == 0)
    return sorted((tuple(r) for r in found.collect()), key=repr)


def made(n, seed, low=-1.0, high=1.0, dims=4, labels=3):
    r = random.Random(seed)
    return [(i, [r.randrange(-8, 9) / 8 * (high - low) / 2 for _ in range(dims)], r.randrange(labels), "x", "y") for i in range(n)]


@pytest.mark.parametrize("blocks", [(2048, 1024, 16 << 20), (7, 3, 4 * 8 * 2)])
def test_equals_brute_force(spark, monkeypatch, blocks):
    for name, value in zip(("BLOCK", "ANCHORS", "WAVE_BYTES"), blocks, strict=True):
        monkeypatch.setattr(hn, name, value)
    rows = made(700, 1)
    assert run(spark, rows) == brute(rows) != []


def test_edges(spark):
    rows = made(250, 2)
    rows += [(100, rows[100][1], rows[100][2], "x", "y")] * 2  # repeated anchors
    rows += [(None, rows[100][1], rows[100][2], None, None), (None, rows[100][1], 1 - rows[100][2] % 2, None, None)]
    rows += [(300, None, 1, "", ""), (400, [0.5], 1, "", ""), (500, [], 1, "", ""), (600, [1.0, None], 1, "", ""), (700, [float("nan")], 1, "", ""), (800, [float("inf")] * 4, 1, "", "")]
    rows += [(900, [0.5] * 4, None, "", ""), (-100, [0.25] * 4, 1, "", ""), (1000, [0.5] * 4, 2, "", "")]
    rows += [(5000 + i, [0.5] * 4, i % 3, "", "") for i in range(60)]  # ties
    assert run(spark, rows) == brute(rows)


def test_empty(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, [0.5], 1, "", "")]) == []
    assert run(spark, [(100, [0.5], 1, "", "")]) == []


def test_large_components_are_exact(spark):
    rows = [(i * 50, [2.0**20 + i, 2.0**21 - 3 * i, 1.0], i % 2, "", "") for i in range(9)]
    assert run(spark, rows) == brute(rows) != []
    with pytest.raises(Exception, match="isn't a long"):
        run(spark, [(100, [1e30], 1, "", ""), (101, [1e30], 1, "", "")])
