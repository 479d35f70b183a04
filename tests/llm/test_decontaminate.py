import hashlib
import random
import re

from veridrift.llm import decontaminate as d

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, n):
    windows = {}
    for item, text in items:
        w = words(text)
        k = min(n, len(w))
        for s in range(len(w) - k + 1) if w else ():
            windows.setdefault(tuple(w[s : s + k]), set()).add(item)
    out = []
    for doc, text in docs:
        w = words(text)
        hit, found = set(), set()
        for k in {len(x) for x in windows}:
            for s in range(len(w) - k + 1):
                for item in windows.get(tuple(w[s : s + k]), ()):
                    hit |= set(range(s, s + k))
                    found.add(item)
        names = ",".join(sorted(str(i) for i in found if i is not None))
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def frames(spark, docs, items):
    a = spark.createDataFrame([(*x, 1, "w") for x in docs], "doc_id long, text string, at int, words string").repartition(3)
    b = spark.createDataFrame([(*x, 2, 3) for x in items], "item_id long, text string, n int, term int")
    return a, b


def test_equals_brute_force(spark):
    r = random.Random(6)
    vocab = ["a", "b", "c", "Été", "x1", "ß", "日本"]
    text = lambda n: "".join(r.choice(vocab) + r.choice([" ", ", ", "!\n", "-"]) for _ in range(n))
    items = [(i, text(r.randint(1, 14))) for i in range(30)] + [(90, None), (91, "..."), (None, "a b c d e"), (93, "only"), (94, "a b c d e")]
    docs = [(i, text(r.randint(0, 60))) for i in range(120)]
    docs += [(500, None), (501, ""), (502, " . "), (503, items[0][1] * 3), (503, items[0][1] * 3), (None, "ONLY"), (505, "say only that"), (506, "the passage " * 500)]
    a, b = frames(spark, docs, items)
    got = sorted((tuple(x) for x in d.decontaminate(a, b, 5).collect()), key=repr)
    assert got == brute(docs, items, 5)


def test_shuffled_joins_give_the_same(spark, monkeypatch):
    docs = [(i, f"w{i % 7} common text of some length here {i}") for i in range(60)]
    items = [(1, "common text of some length here"), (2, "w3 common text of")]
    a, b = frames(spark, docs, items)
    monkeypatch.setattr(d, "SMALL", 0)
    assert sorted((tuple(x) for x in d.decontaminate(a, b, 4).collect()), key=repr) == brute(docs, items, 4)


def test_keep_clean_and_empty(spark):
    docs = [(1, "one two three four"), (2, "clean"), (None, None), (3, "zero one two three")]
    a, b = frames(spark, docs, [(7, "one two three")])
    kept = d.keep_clean(a, b, 3)
    assert sorted(x["doc_id"] or 0 for x in kept.collect()) == [0, 2] and kept.columns == a.columns
    assert d.decontaminate(a.limit(0), b, 3).count() == 0
    assert [x["contaminated"] for x in d.decontaminate(a, b.limit(0), 3).collect()] == [False] * 4


def test_proximity(spark):
    docs = [(1, "red fox saw blue sky and a red sky"), (2, "red " + "x " * 30 + "sky"), (3, None), (4, "sky red")]
    a, _ = frames(spark, docs, [(1, "x")])
    got = {(x["doc_id"], x["start"], x["end"]) for x in d.proximity(a, ["red", "sky"], 4).collect()}
    assert got == {(1, 7, 8), (1, 4, 7), (4, 0, 1)}


def test_rows_of_one_id_are_judged_apart(spark):
    item = "one two three four five six seven eight nine ten"
    rows = [(None, f"x {item} y"), (None, "clean words"), (None, None), (1, item), (1, "other words"), (1, item), (2, "fine"), (2, "fine"), ((1 << 53) + 1, "large")]
    docs = spark.createDataFrame([(*x, 0) for x in rows], "doc_id long, text string, row int")
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    kept = d.keep_clean(docs, items, 10)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in kept.collect()) == [(0, ""), (0, "clean words"), (1, "other words"), (2, "fine"), (2, "fine"), ((1 << 53) + 1, "large")]
