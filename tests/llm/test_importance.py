"""Importance resampling against a brute-force version."""

import hashlib
import math
import random
import zlib

import regex
from pyspark.sql import functions as F

from veridrift.llm import importance

ASCII = str.maketrans(importance.UPPER, importance.LOWER)


def grams(text, longest=2):
    words = regex.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(ASCII))
    return words, [" ".join(words[i : i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1)]


def brute(docs, target, percent=25, least=20, buckets=10_000, longest=2, seed=7):
    count = lambda texts: [x for t in texts for x in (zlib.crc32(g.encode()) % buckets for g in grams(t, longest)[1])]
    s, t = [0] * buckets, [0] * buckets
    for b in count(x[1] for x in docs):
        s[b] += 1
    for b in count(target):
        t[b] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + buckets) / ((s[b] + 1) * (sum(t) + buckets)))) for b in range(buckets)]
    rows = []
    for i, text in docs:
        words, found = grams(text, longest)
        own = [gain[zlib.crc32(g.encode()) % buckets] for g in found]
        weight = sum(own) // len(own) if own else 0
        score = None
        if i is not None:
            h = int(hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append((i, len(words), len(found), weight, score))
    may = sorted((r for r in rows if r[1] >= least and r[4] is not None), key=lambda r: (-r[4], r[0]))
    drawn = may[: percent * len(may) // 100]
    ranks = {}
    for n, r in enumerate(drawn):
        ranks.setdefault(r, []).append(n + 1)
    placed = [(*r, ranks[r].pop(0) if ranks.get(r) else None) for r in sorted(rows, key=repr)]
    return sorted(placed, key=repr)


def run(spark, docs, target, **more):
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"at": F.lit(1), "r": F.lit("x"), "weight": F.lit(0), "score": F.lit(1)})
    found = importance.resample(df, spark.createDataFrame([(t,) for t in target], "text string").withColumn("item_id", F.lit(1)), **more)
    assert found.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    return sorted((tuple(r) for r in found.collect()), key=repr)


def texts(n, seed):
    r = random.Random(seed)
    words = ["Straße", "naïve", "ÀB", "x1", "Über", "don't", "a-b", "日本", "the", "THE", "of", "z_z", "Ω", "q\x00r", "é"] + [f"w{i}" for i in range(60)]
    return [(i, r.choice([" ", "\n", "  ", ", "]).join(r.choices(words, k=r.choice([0, 1, 2, 19, 20, 25, 80])))) for i in range(n)]


def test_equals_brute_force(spark):
    docs, target = texts(400, 1), [t for _, t in texts(30, 2)]
    assert run(spark, docs, target) == brute(docs, target)


def test_parameters(spark, monkeypatch):
    monkeypatch.setattr(importance, "ROWS", 3)
    docs, target = texts(120, 3), [t for _, t in texts(9, 4)]
    more = {"percent": 60, "buckets": 97, "longest": 3, "seed": 11}
    assert run(spark, docs, target, **more, least_words=2) == brute(docs, target, **more, least=2)


def test_edges(spark):
    docs = [*texts(60, 5), (None, "only here"), (None, "a " * 40), (1000, None), (1001, ""), (1002, " ... "), (1003, "word"), (1004, "long " * 60_000), (5, "again " * 30), (5, "again " * 30)]
    for target in (["again and again", None, ""], [], [None]):
        assert run(spark, docs, target) == brute(docs, target)
    assert run(spark, [], ["a b"]) == []


def test_ties_go_to_the_smaller_id(spark):
    df = spark.createDataFrame([(i, 100, 5, 0, i // 7) for i in range(50)], "doc_id long, n_words long, n_features long, weight long, score long")
    got = {r["doc_id"]: r["rank"] for r in importance.ranked(df.repartition(5), F.lit(True), 30).collect()}
    order = sorted(range(50), key=lambda i: (-(i // 7), i))[:15]
    assert got == {i: order.index(i) + 1 if i in order else None for i in range(50)}
