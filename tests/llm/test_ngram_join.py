"""The similarity join against all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from veridrift.llm import ngram_join


def brute_set(text, size):
    words = (text or "").encode().lower().split()
    if not words:
        return set()
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))}


def brute(rows, size=4, percent=85):
    sets = [brute_set(t, size) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * shared >= percent * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[root(i)] = min(doc, least.get(root(i), doc))
    return sorted(((doc, len(sets[i]), least.get(root(i))) for i, (doc, _) in enumerate(rows)), key=repr)


def run(spark, rows, **more):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"row": F.lit("x"), "n": F.lit(1), "same": F.lit(0), "rep": F.lit(2)})
    return sorted((tuple(r) for r in ngram_join.similar_groups(df, **more).collect()), key=repr)


def edited(r, words, edits):
    words = list(words)
    for _ in range(edits):
        words[r.randrange(len(words))] = f"e{r.randrange(10**6)}"
    return words


def corpus(seed, families=12, size=12):
    """Families around the threshold: copies with edits, chains of edits, shared passages."""
    r = random.Random(seed)
    out = []
    word = lambda: f"w{r.randrange(3000)}"
    passage = [word() for _ in range(60)]
    for f in range(families):
        base = [word() for _ in range(r.choice([5, 30, 100, 300]))]
        if f % 3 == 0:
            base[len(base) // 2 : len(base) // 2] = passage
        last = base
        for _ in range(size):
            last = edited(r, last if f % 2 else base, r.choice([0, 1, 1, 2, 3, max(1, len(base) // 60)]))
            out.append(" ".join(last))
    r.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize(("seed", "block"), [(1, 2048), (2, 3)])
def test_equals_brute_force(spark, monkeypatch, seed, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "TOGETHER", 2 * block)
    rows = corpus(seed)
    want = brute(rows)
    assert run(spark, rows) == want
    assert len({c for _, _, c in want}) < 0.8 * len(rows)


def test_other_parameters(spark):
    rows = corpus(3, families=6)
    assert run(spark, rows, size=2, percent=60) == brute(rows, 2, 60)
    assert run(spark, rows, size=5, percent=100) == brute(rows, 5, 100)


def test_edges(spark):
    long = " ".join(f"x{i}" for i in range(40_000))
    rows = [(9, None), (8, ""), (7, " \t\n"), (6, "one two"), (5, "ONE  two\x0b"), (4, "one two three four"), (3, "one two three four"), (20, long), (19, long + " end")]
    rows += [(2, "one two"), (2, "quite another text of seven words"), (2, "quite another text of seven words"), (None, "one two"), (None, "alone without an id"), (-5, "É é É é"), (-6, "é É é É"), (11, "a a a a a a a"), (10, "a a a a")]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []
    assert run(spark, [(1, None)]) == [(1, 0, 1)]


def test_a_large_group_of_near_copies_stays_in_proportion(spark, monkeypatch):
    """Members of a group meet in many lists; candidates stay a small multiple of them."""
    tested = []
    whole = ngram_join.verified
    monkeypatch.setattr(ngram_join, "verified", lambda stored, pairs, *a: tested.append(pairs.count()) or whole(stored, pairs, *a))
    r = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join(edited(r, base, r.choice([1, 2, 3, 4])))) for i in range(600)]
    assert run(spark, rows) == brute(rows)
    assert sum(tested) < 40 * len(rows)


def test_filters_never_refuse_a_link():
    r = np.random.default_rng(1)
    for _ in range(300):
        n = int(r.integers(1, 400))
        x = np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
        y = np.unique(np.concatenate([x[r.random(len(x)) < 0.93], r.integers(0, 1 << 63, int(r.integers(0, 20)), dtype=np.uint64)]))
        shared = len(np.intersect1d(x, y))
        if not len(y) or 100 * shared < 85 * (len(x) + len(y) - shared):
            continue
        cut = ngram_join.opened([ngram_join.parts_of(h) for h in (x, y)])
        assert ngram_join.differing(cut, np.array([0]), np.array([1]))[0] <= ngram_join.may_differ(np.array(len(x) + len(y)), 85)
        assert set(x[: ngram_join.prefix_length(len(x), 85)]) & set(y[: ngram_join.prefix_length(len(y), 85)])
