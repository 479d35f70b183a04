import random

import numpy as np
import pytest
import xxhash

from veridrift.llm import near_duplicates, simhash
from veridrift.llm.components import components


def brute_print(text, k):
    words = [w for w in (text or "").encode().lower().split()]
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + k]), 42) for i in range(max(1, len(words) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(nodes, edges):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_components(spark):
    r = random.Random(4)
    chain = [(i, i + 1) for i in range(100, 140)]
    star = [(7, i) for i in range(1000, 1300)]
    rest = [(r.randrange(2000, 2600), r.randrange(2000, 2600)) for _ in range(300)]
    edges = chain + star + rest + [(5, 5), (6, 6), (6, 7)]
    got = {x["node"]: x["component"] for x in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == roots({n for e in edges for n in e}, edges)


@pytest.mark.parametrize("width", [1, 3, 4])
def test_links_equal_brute_force(spark, width, monkeypatch):
    monkeypatch.setattr(simhash, "width_for", lambda n, m: width)
    r = random.Random(width)
    fps = {r.getrandbits(64) for _ in range(150)}
    for f in list(fps):
        for _ in range(r.choice([0, 1, 3])):
            g = f
            for b in r.sample(range(64), r.randint(1, 6)):
                g ^= 1 << b
            fps.add(g)
    base = r.getrandbits(64)
    fps |= {base ^ (1 << a) ^ (1 << b) for a in range(12) for b in range(a)}  # a long list
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame(list(zip(signed, range(len(fps)), strict=True)), "fp long, rep long")
    edges = [(e["u"], e["v"]) for e in simhash.link_edges(df, len(fps), 4).collect()]
    a = np.array(fps, dtype=np.uint64)
    want = [(i, j) for i in range(len(a)) for j in (np.flatnonzero(np.bitwise_count(a[i] ^ a[i + 1 :]) <= 4) + i + 1).tolist()]
    assert set(map(tuple, map(sorted, edges))) <= set(want)
    assert roots(range(len(a)), edges) == roots(range(len(a)), want)


def test_query_on_edge_rows(spark):
    texts = [None, "", " \n", "one", "ONE", "a b c d e f", "A B C D E F", "é É x y z", "x " * 300, "a b c d e f"]
    rows = [(i, t, 9) for i, t in enumerate(texts)] + [(3, "one", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    got = simhash.near_duplicates(df, 4, 4).collect()
    assert len(got) == len(rows)
    for g in got:
        assert g["fingerprint"] == f"{brute_print(texts[g['doc_id']], 4):016x}"
    by = {g["doc_id"]: g["component_id"] for g in got}
    assert by[0] == by[1] == by[2] == 0 and by[3] == by[4] == 3 and by[5] == by[6] == by[9] == 5
    assert simhash.near_duplicates(df.limit(0), 4, 4).count() == 0


def test_similar_groups_equal_brute_force(spark):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    texts = []
    for _ in range(30):
        base = [word() for _ in range(120)]
        texts.append(" ".join(base))
        for _ in range(r.choice([0, 1, 4])):
            other = list(base)
            other[r.randrange(120)] = word()
            texts.append(" ".join(other))
    texts += ["", None, texts[0], " "]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sets = [set(near_duplicates.shingles(t, 5).tolist()) for t in texts]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if (not sets[i] and not sets[j]) or (sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]))]
    want = {k for k, v in roots(range(len(sets)), links).items() if k == v}
    kept = near_duplicates.keep_one(df.union(df.where("doc_id = 2")))
    got = [x["doc_id"] for x in kept.collect()]
    assert sorted(got) == sorted(want) and kept.columns == df.columns
    assert near_duplicates.keep_one(df.limit(0)).count() == 0


def test_components_in_one_pass_and_by_rounds(spark):
    import random

    dice = random.Random(3)
    pairs = [(dice.randrange(400), dice.randrange(400)) for _ in range(230)] + [(i, i + 1) for i in range(1000, 1100)] + [(7000, 7000)]
    above = {x: x for p in pairs for x in p}
    for _ in above:
        for u, v in pairs:
            above[u] = above[v] = min(above[u], above[v])
    edges = spark.createDataFrame(pairs, "u long, v long")
    for held in (7, 100, 1 << 18):
        assert {tuple(r) for r in components(edges, held).collect()} == set(above.items())

    def jobs(group: str, **held: int) -> int:
        spark.sparkContext.setJobGroup(group, group)
        components(edges, **held).count()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    assert 2 * jobs("components-once") < jobs("components-rounds", held=7)  # what fits a task takes no rounds
