"""The near-duplicate stage finds its first pairs by SimHash fingerprints, through the index on byte positions."""

import random

import numpy as np
from test_near_recall import links_of
from test_simhash import roots

from veridrift.llm import near_duplicates


def copies(r, groups, n=600):
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(7))
    texts = []
    for size in groups:
        base = [word() for _ in range(n)]
        texts.append(" ".join(base))
        for _ in range(size - 1):
            other = list(base)
            other[r.randrange(n)] = word()
            texts.append(" ".join(other))
    return texts


def near_prints(texts):
    """Links of fingerprints within the distance, by brute force."""
    prints = [np.uint64(near_duplicates.majority(near_duplicates.shingles(t, 5)) & (1 << 64) - 1) for t in texts]
    return [(i, j) for i in range(len(texts)) for j in range(i) if int(prints[i] ^ prints[j]).bit_count() <= near_duplicates.DISTANCE]


def test_the_index_alone_finds_what_is_within_its_distance(spark, monkeypatch):
    """Without the second index, groups are those of the fingerprints' links that are similar."""
    texts = copies(random.Random(5), (2, 2, 2, 5, 40, 1, 1))
    monkeypatch.setattr(near_duplicates, "bands", lambda h: np.zeros(0, dtype=np.int64))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {x["doc_id"]: x["component_id"] for x in near_duplicates.groups(df).collect()}
    similar = set(links_of(texts))
    links = [x for x in near_prints(texts) if x in similar]
    assert len(links) > 100 and got == roots(range(len(texts)), links)
    assert near_duplicates.keep_one(df).count() == len(set(got.values())) < len(texts)
