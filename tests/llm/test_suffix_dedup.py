import hashlib
import random

import numpy as np
import pytest

from veridrift.llm import suffix_dedup as s


def brute(rows):
    """The contract, string by string; a null id is larger than all."""
    order = [s.NO_ID if i is None else i for i, _ in rows]
    first = {}
    for i, (_, t) in zip(order, rows, strict=True):
        b = (t or "").encode()
        for k in range(len(b) - 49):
            x = b[k : k + 50]
            first[x] = min(i, first.get(x, i))
    out = []
    for i, (doc, t) in zip(order, rows, strict=True):
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, dtype=bool)
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < i:
                gone[k : k + 50] = True
        n = int(gone.sum())
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        kept = bytes(c for c, g in zip(b, gone, strict=False) if not g)
        out.append((doc, len(b), n, spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def corpus(seed):
    r = random.Random(seed)
    syllables = ["ba", "é", "lo", "mi ", "nu", "\n", "x "]
    text = lambda n: "".join(r.choice(syllables) for _ in range(n))
    shared = [text(r.choice([15, 30, 60, 200])) for _ in range(12)]
    rows = []
    for i in range(120):
        t = "".join(r.choice([text(r.randint(0, 40)), r.choice(shared), r.choice(shared)[r.randint(0, 9) :], ""]) for _ in range(5))
        rows.append((i * 3 % 120, t))
    rows += [(7, rows[0][1]), (7, rows[0][1]), (None, rows[3][1]), (None, shared[0]), (500, None), (501, ""), (502, "a" * 300), (503, "a" * 90), (504, "short")]
    rows.append((505, "".join(shared) * 3))
    return rows


@pytest.mark.parametrize(("seed", "block", "chunk"), [(1, 2 << 20, 1 << 20), (2, 900, 1 << 20), (3, 400, 333), (4, 5000, 100)])
def test_equals_brute_force(spark, monkeypatch, seed, block, chunk):
    monkeypatch.setattr(s, "BLOCK_BYTES", block)
    monkeypatch.setattr(s, "CHUNK", chunk)
    rows = corpus(seed)
    df = spark.createDataFrame([(*x, 0) for x in rows], "doc_id long, text string, block int").repartition(3)
    # worker processes don't see the patched sizes, so the blocks' functions are run here as well
    got = sorted((tuple(x) for x in s.deduplicate(df).collect()), key=repr)
    assert got == brute(rows)
    assert local(rows, block) == brute(rows)


def local(rows, block):
    """The same stages without Spark, with the sizes of the test."""
    blocks, held = [], []
    for row in rows:
        held.append(row)
        if sum(len((t or "").encode()) for _, t in held) >= block:
            blocks.append(held)
            held = []
    blocks.append(held)
    opened = []
    for b in blocks:
        texts = [(t or "").encode() for _, t in b]
        ids = np.array([s.NO_ID if i is None else i for i, _ in b], dtype=np.int64)
        opened.append((ids, np.cumsum([len(t) for t in texts]).astype(np.int64), np.frombuffer(b"".join(texts), dtype=np.uint8)))
    named = [np.unique(s.segments(data, ends)[2]) for _, ends, data in opened]
    names, n = np.unique(np.concatenate(named), return_counts=True)
    shared = names[n > 1]
    runs = {i: [] for i in range(len(blocks))}
    sent = []
    for i, (ids, ends, data) in enumerate(opened):
        for row in s.one_block(i, [s.pack40(np.intersect1d(shared, named[i]))], ids, ends, data, 3):
            if row[0] < 0:
                runs[i] += zip(np.frombuffer(row[4], "<i4"), np.frombuffer(row[5], "<i4"), strict=True)
            else:
                sent.append(row)
    for p in range(3):
        mine = [x for x in sent if x[0] == p]
        if not mine:
            continue
        key = s.unpack40(b"".join(x[2] for x in mine))
        doc = np.frombuffer(b"".join(x[3] for x in mine), "<i8")
        place = np.frombuffer(b"".join(x[4] for x in mine), "<i4")
        count = np.frombuffer(b"".join(x[5] for x in mine), "u1").astype(np.int64)
        data = np.frombuffer(b"".join(x[6] for x in mine), np.uint8)
        owner = np.repeat([x[1] for x in mine], [len(x[5]) for x in mine])
        size = count + 49
        whole, cells = s.repeated(data, np.cumsum(size) - size, count, key, doc)
        for w in np.flatnonzero(whole):
            runs[owner[w]].append((place[w], count[w]))
        for w, c in cells:
            runs[owner[w]].append((place[w] + c, 1))
    out = []
    for i, (b, (_, ends, data)) in enumerate(zip(blocks, opened, strict=True)):
        gone = np.zeros(len(data) + 1, dtype=bool)
        for a, n in runs[i]:
            gone[a : a + n + 49] = True
        low = 0
        for (doc, _), end in zip(b, ends.tolist(), strict=True):
            m = gone[low:end]
            spans = sum(1 for k in range(len(m)) if m[k] and (k == 0 or not m[k - 1]))
            out.append((doc, end - low, int(m.sum()), spans, hashlib.sha256(data[low:end][~m].tobytes()).hexdigest()))
            low = end
    return sorted(out, key=repr)


def test_suffix_order():
    r = np.random.default_rng(3)
    data = r.integers(97, 99, 4000).astype(np.uint8)
    start = r.integers(0, 3900, 700)
    length = r.integers(1, 90, 700)
    group = r.integers(0, 5, 700)
    order = s.suffix_order(data, start, length, group)
    got = [(group[i], data[start[i] : start[i] + length[i]].tobytes()) for i in order]
    assert got == sorted(got) and sorted(order.tolist()) == list(range(700))


def test_collisions_are_found(monkeypatch):
    """With a hash that says everything is equal, the bytes still decide."""
    data = np.frombuffer(("".join(f"{i:050d}" for i in (1, 2, 1, 3, 2))).encode(), dtype=np.uint8)
    monkeypatch.setattr(s.Hashes, "part", lambda self, start, length: np.zeros(len(start), dtype=np.uint64))
    one = np.zeros(5, dtype=np.int64)
    runs = s.equal_runs(data, np.arange(5) * 50, one + 50, one, s.Hashes(data))
    assert np.flatnonzero(s.later(*runs, np.arange(5))).tolist() == [2, 4]


def test_matches_come_from_the_suffix_order(monkeypatch):
    """A wrong order loses them."""
    rows = corpus(5)
    assert local(rows, 900) == brute(rows)
    monkeypatch.setattr(s, "suffix_order", lambda data, start, length, group, h=None: np.lexsort((np.arange(len(start)) * 7919 % 10007, group)))
    assert local(rows, 900) != brute(rows)


def test_minimizer_places():
    r = random.Random(8)
    data = np.frombuffer("".join(r.choice("ab ") for _ in range(3000)).encode(), dtype=np.uint8)
    start, strings, key = s.segments(data, np.array([1200, 3000]))
    h = s.Hashes(data)
    place = s.minimizer_places(h, start, strings + 49, key)
    assert (place >= strings - 1).all() and (place <= s.LENGTH - s.GRAM).all()
    assert (s.mixed(h.part(start + place, s.GRAM)) >> np.uint64(24) == key).all()


def test_empty_table(spark):
    assert s.deduplicate(spark.createDataFrame([], "doc_id long, text string")).count() == 0
