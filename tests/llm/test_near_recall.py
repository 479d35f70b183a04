"""Near-duplicates at the edge of the similarity, and lists of many entries, against brute force."""

import random

import numpy as np
from test_simhash import roots

from veridrift.llm import near_duplicates


def similarity(a, b):
    return len(a & b) / len(a | b)


def edge_pair(r, n, low, high):
    """Two texts of n words whose similarity is in the range."""
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(7))
    for _ in range(1000):
        base = [word() for _ in range(n)]
        other = list(base)
        for at in r.sample(range(n), r.randint(0, n // 40)):
            other[at] = word()
        other = other[: n - r.randint(1, max(1, n // 6))]
        a, b = (set(near_duplicates.shingles(" ".join(x), 5).tolist()) for x in (base, other))
        if low <= similarity(a, b) < high:
            return " ".join(base), " ".join(other)
    raise AssertionError("no such pair")


def test_every_pair_at_the_edge_is_found(spark):
    r = random.Random(3)
    texts = [t for _ in range(600) for t in edge_pair(r, r.choice([10, 40, 120, 300]), 0.8, 0.87)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    got = {x["doc_id"]: x["component_id"] for x in near_duplicates.groups(df).collect()}
    assert got == {i: i - i % 2 for i in range(len(texts))}
    far = [t for _ in range(100) for t in edge_pair(r, 120, 0.7, 0.8)]
    df = spark.createDataFrame(list(enumerate(far)), "doc_id long, text string")
    assert near_duplicates.keep_one(df).count() == len(far)


def links_of(texts):
    sets = [set(near_duplicates.shingles(t, 5).tolist()) for t in texts]
    return [(i, j) for i in range(len(sets)) for j in range(i) if similarity(sets[i], sets[j]) >= 0.8]


def test_lists_give_all_pairs_whatever_their_length(spark, monkeypatch):
    """All entries in each list, with partners that are similar to each other but not to the first."""
    r = random.Random(6)
    texts = [t for _ in range(4) for t in edge_pair(r, 60, 0.8, 0.87)]
    head, tail = ([f"{w}{i}" for i in range(60)] for w in "ht")
    for lost in range(0, 30, 2):  # neighbours are similar, the ends are not; templates share the head
        texts.append(" ".join(head[lost:] + tail[:lost]))
        texts += edge_pair(r, 40, 0.8, 0.87)
    rows = [(i, t) for i, t in enumerate(texts)]
    every = lambda h: np.arange(near_duplicates.BANDS * (len(h) > 0), dtype=np.int64)
    monkeypatch.setattr(near_duplicates, "bands", every)
    got = {x["doc_id"]: x["component_id"] for x in near_duplicates.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(texts) > 24 and got == roots(range(len(texts)), links_of(texts))


def test_large_groups_of_near_copies(spark):
    """Groups whose members differ from their source in a few words, and less so from some others."""
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(7))
    texts = []
    for size, edits in ((400, 3), (300, 4), (200, 2)):
        base = [word() for _ in range(90)]
        for _ in range(size):
            copy = list(base)
            for at in r.sample(range(90), r.randint(1, edits)):
                copy[at] = word()
            texts.append(" ".join(copy))
    got = {x["doc_id"]: x["component_id"] for x in near_duplicates.groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)).collect()}
    links = links_of(texts)
    joined = sum(got[i] == got[j] for i, j in links)
    assert joined == len(links) and got == roots(range(len(texts)), links)


def test_edge_cases(spark):
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(7))
    text = lambda n=60: " ".join(word() for _ in range(n))
    a, b, c, large = text(), text(), text(30_000), (1 << 53) + 1
    rows = [(1, a), (1, b), (1, a), (None, c), (None, c), (None, text()), (large, c + " end"), (5, None), (6, ""), (None, " "), (large + 1, text())]
    df = spark.createDataFrame([(*x, 1, 2) for x in rows], "doc_id long, text string, row int, bands int")
    kept = near_duplicates.keep_one(df)
    assert kept.schema == df.schema
    got = sorted((x["doc_id"] or 0, len(x["text"] or "")) for x in kept.collect())
    assert got == sorted([(1, len(a)), (1, len(b)), (0, len(rows[5][1])), (large, len(c) + 4), (5, 0), (large + 1, len(rows[10][1]))])
    assert near_duplicates.keep_one(df.limit(0)).count() == 0
