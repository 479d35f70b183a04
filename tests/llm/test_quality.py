import random
import re
from collections import Counter

import numpy as np
import pytest

from veridrift.llm import quality_classifier as c
from veridrift.llm import quality_rules as q


def brute(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    n = len(words)
    grams = Counter(tuple(words[i : i + 5]) for i in range(n - 4))
    covered = {k for i in range(n - 4) if grams[tuple(words[i : i + 5])] > 1 for k in range(i, i + 5)}
    seen, again = set(), 0
    for line in text.split("\n"):
        if re.search("[^\x20\x09-\x0d]", line):
            again += line in seen
            seen.add(line)
    return n, sum(map(len, words)), sum(x in "#*$%&|<>" for x in text), again, len(covered)


TEXTS = [None, "", " \n ", "one", "a b c d e a b c d e", "x " * 40, "line\nline\n line\nline", "é\xa0ü # * $\x85|", "a\x1cb c d", "&%" * 50]


@pytest.mark.parametrize("text", TEXTS)
def test_counts(text):
    assert q.measure(text)[:5] == brute(text)


def test_counts_of_random_texts():
    r = random.Random(4)
    for _ in range(200):
        t = "".join(r.choice(["a", "b", "é", " ", " ", "\n", "\t", "#"]) for _ in range(r.randint(0, 200)))
        assert q.measure(t)[:5] == brute(t)


def test_chi2():
    assert q.chi2_quantile(0.95, 5) == pytest.approx(11.0705, abs=1e-3)
    assert q.consistency(0.999999) == pytest.approx(1, abs=1e-3)


def prose(r, n=80):
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(3, 8))) for _ in range(n)) + "."


def test_outliers_go_and_clean_texts_stay(spark):
    r = random.Random(3)
    rows = [(i, prose(r), ["en", "de"][i % 2], f"s{i % 2}") for i in range(600)]
    bad = [(1000 + i, " ".join(w + "$$$" for w in prose(r).split()), "en", "s0") for i in range(20)]
    bad += [(1100 + i, prose(r).upper(), "de", "s1") for i in range(20)]
    odd = [(2000, None, None, None), (2001, "", "xx", None), (2002, prose(r), None, None), (2003, "word " * 60, "en", "s0"), (None, prose(r), "en", "s0"), (0, rows[0][1], "en", "s0")]
    df = spark.createDataFrame([(*x, 1) for x in rows + bad + odd], "doc_id long, text string, lang string, source string, n_words int")
    got = q.judge(df).collect()
    assert len(got) == len(rows + bad + odd)
    kept = {(g["doc_id"], g["kept"]) for g in got}
    assert {(i, True) for i, *_ in rows} <= kept and {(i, False) for i, *_ in bad} <= kept
    assert {(2000, False), (2001, False), (2002, True), (2003, False), (None, True)} <= kept
    by = {x[0]: brute(x[1]) for x in rows + bad + odd}
    assert all(tuple(g[k] for k in q.COUNTS) == by[g["doc_id"]] for g in got)
    assert q.judge(df.limit(0)).count() == 0


def fast_mcd(x, groups):
    """Distances by the same rules in NumPy: x in whole multiples, groups as (language, source)."""
    langs = [g[0] for g in groups]
    keys, every = sorted(set(groups)), np.arange(len(x))
    of = {g: np.array([i for i, h in enumerate(groups) if h == g]) for g in keys}
    least = np.diag([f[3] ** 2 for f in q.FEATURES])
    n_of = lambda rows: {g: [i for i in rows if groups[i] == g] for g in keys}

    def shrunk(stat, rows):
        """``stat`` (of row numbers) of each group with its language's and that of all."""
        out = {}
        for g, own in n_of(rows).items():
            if own:
                lang = [i for i in rows if langs[i] == g[0]]
                w = lambda n, a, b: (n * a + q.SHARED_ROWS * b) / (n + q.SHARED_ROWS)
                out[g] = [w(len(own), a, w(len(lang), b, c)) for a, b, c in zip(stat(own), stat(lang), stat(list(rows)), strict=True)]
        return out

    def quartiles(rows):
        low, mid, high = np.percentile(x[rows] / q.SCALE, [25, 50, 75], axis=0)
        return mid, np.diag(((high - low) / 1.349) ** 2)

    def d2(estimates):
        out = np.zeros(len(x))
        for g, rows in of.items():
            mu, s = estimates[g]
            off = x[rows] / q.SCALE - mu
            out[rows] = np.einsum("ij,jk,ik->i", off, np.linalg.inv(s + least), off)
        return out

    def both(factor):
        return lambda rows: (x[rows].mean(axis=0) / q.SCALE, np.cov(x[rows].T / q.SCALE, bias=True) * factor if len(rows) > 1 else np.zeros((q.P, q.P)))

    def bent(first, kind):
        y = np.zeros(x.shape)
        for g, rows in of.items():
            z = (x[rows] / q.SCALE - first[g][0]) / np.sqrt(np.diag(first[g][1] + least))
            y[rows] = np.tanh(z) if kind == "tanh" else z / np.maximum(np.sqrt((z**2).sum(axis=1)), 1e-300)[:, None]
        y = np.round(y * q.SCALE) / q.SCALE
        out = {}
        for g, (shape,) in shrunk(lambda rows: (y[rows].T @ y[rows] / len(rows),), every).items():
            size = np.sqrt(np.diag(shape))
            r = shape / np.where(np.outer(size, size) > 0, np.outer(size, size), 1)
            np.fill_diagonal(r, 1)
            spread = np.sqrt(np.diag(first[g][1]))
            out[g] = [first[g][0], r * np.outer(spread, spread)]
        return out

    def concentrate(estimates, steps):
        seen = set()
        for _ in range(steps):
            far, core = d2(estimates), []
            bins = np.floor(np.log2(far + 1e-6) * q.BINS)
            for rows in of.values():
                last = np.sort(bins[rows])[int(np.ceil(len(rows) * q.CORE)) - 1]
                core += [i for i in rows if bins[i] <= last]
            if tuple(sorted(core)) in seen:
                break
            seen.add(tuple(sorted(core)))
            estimates = shrunk(both(q.consistency(q.CORE)), sorted(core))
        return estimates

    first = shrunk(quartiles, every)
    begun = [concentrate(s, q.SHORT) for s in (first, bent(first, "tanh"), bent(first, "sign"))]
    size = lambda s: round(np.linalg.slogdet(s + least)[1], 6)
    estimates = concentrate({g: min((b[g] for b in begun), key=lambda e: size(e[1])) for g in keys}, q.STEPS)
    inside = [i for i in every if d2(estimates)[i] <= q.chi2_quantile(0.975, q.P)]
    return np.sqrt(d2(estimates | shrunk(both(q.consistency(0.975)), inside)))


def test_the_least_determinant_is_taken(spark):
    """Correlated statistics and a cluster of outliers: no start alone does better in any group."""
    r = np.random.default_rng(5)
    rows = []
    for g in range(3):
        n = 400
        t = r.normal(size=n)
        x = np.column_stack([6 + 0.3 * t, 0.2 + 0.06 * t, 0.1 + 0.01 * r.normal(size=n), 0.1 + 0.01 * r.normal(size=n), 0.2 - 0.05 * t + 0.01 * r.normal(size=n)])
        x[: 20 * (g + 1)] += [0.8, -0.2, 0.1, 0.0, 0.3]
        rows += [(f"g{g}", "en", *map(int, np.round(q.SCALE * v))) for v in x]
    df = spark.createDataFrame(rows, "grp string, lang string, " + ", ".join(f"x{i} long" for i in range(q.P))).repartition(3)
    size = lambda e: {k["grp"]: np.linalg.slogdet(np.array(k["pr"]).reshape(q.P, q.P))[1] for k in e.collect()}
    first = q.start(df)
    starts = [q.concentrated(df, s, q.SHORT)[0] for s in (first, q.directions(df, first, "tanh"), q.directions(df, first, "sign"))]
    sizes, best = [size(s) for s in starts], size(q.least_determinant(starts))
    assert all(best[g] == pytest.approx(max(s[g] for s in sizes), abs=1e-6) for g in best) and len(best) == 3
    _, taken = q.concentrated(df, q.least_determinant(starts))
    assert 0 < taken < q.STEPS
    assert set(size(q.robust(df))) == set(best)


def test_tables_without_languages_and_sources(spark):
    r = random.Random(6)
    df = spark.createDataFrame([(i, prose(r, 40)) for i in range(50)], "doc_id long, text string")
    assert q.judge(df).where("kept").count() == 50


def test_verdicts_equal_numpy(spark):
    """Groups of all sizes, down to one row, with outliers in them."""
    r = random.Random(11)
    rows = []
    for lang, source, n in (("en", "a", 300), ("en", "b", 40), ("en", "c", 1), ("de", "a", 90), ("de", "b", 3), ("fr", "a", 2)):
        for _ in range(n):
            text = prose(r, r.randint(20, 120))
            if r.random() < 0.06:
                text = r.choice([text.upper(), text.replace(" ", " ### "), text.replace(" ", "longer")[:400] + " " + prose(r, 12)])
            rows.append((len(rows), text, lang, source))
    got = {x["doc_id"]: x for x in q.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(4)).collect()}
    judged = [x for x in rows if not got[x[0]]["base_failed"]]
    x = np.array([q.statistics(q.measure(t)) for _, t, _, _ in judged])
    want = fast_mcd(x, [(lang, source) for *_, lang, source in judged])
    assert len(judged) > 400
    for (i, *_), d in zip(judged, want, strict=True):
        assert got[i]["distance"] == pytest.approx(d, rel=1e-6), i
        assert got[i]["kept"] == (d * d <= q.CUTOFF)
    assert 10 < sum(not x["kept"] for x in got.values()) < 60


def test_label_model_finds_the_classes():
    r = random.Random(7)
    patterns, truth = Counter(), Counter()
    for _ in range(20_000):
        kind = r.choices([0, 1, 2], [0.85, 0.1, 0.05])[0]
        rates = [(0.002, 0.001, 0.003), (0.9, 0.6, 0.01), (0.02, 0.1, 0.8)][kind]
        v = tuple(int(r.random() < p) for p in rates)
        patterns[v] += 1
        truth[v] += kind > 0
    model = c.fit_votes(dict(patterns), 0.2)
    for v, n in patterns.items():
        if n > 50:
            assert model.positive(np.array([v]))[0] == pytest.approx(truth[v] / n, abs=0.15)


def corpus():
    r = random.Random(9)
    rows, labels = [], []
    for i in range(1200):
        text, toxic = prose(r, 60), 0
        if i % 10 == 0:
            text, toxic = text + " " + " ".join(r.sample(["vexadu", "vexalo", "vexami", "vexari"], 3)), 1
        elif i % 10 == 1:
            text = " ".join(w + "###" for w in text.split())
        elif i % 10 == 2:
            text = text.upper()
        rows.append((i, text, "en", "s", len(text)))
        labels.append((i, toxic))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = corpus()
    odd = [(5000, None, None, None, None), (5001, "", "en", "s", 0), (None, rows[3][1], "en", "s", 1), (3, rows[3][1], "en", "s", 1)]
    df = spark.createDataFrame([(*x, 7) for x in rows + odd], "doc_id long, text string, lang string, source string, n_chars long, kept int")
    known = spark.createDataFrame([x for x in labels if x[0] % 3] + [(None, 1), (4, None)], "doc_id long, toxic int")
    model, _ = c.fit(df, known)
    got = {r["doc_id"]: r["kept"] for r in c.score_with(df, model).collect()}
    held = [x for x in labels if x[0] % 3 == 0]
    assert np.mean([got[i] == (i % 10 > 2) for i, _ in held]) > 0.97
    assert all(got[i] for i, _ in held if i % 10 > 2)
    assert got[5000] and got[5001]
    assert got == {r["doc_id"]: r["kept"] for r in c.score(df, known).collect()}
    kept = c.keep(df, known)
    assert kept.schema == df.schema and {r["doc_id"] for r in kept.collect()} == {k for k, v in got.items() if v}
    empty, _ = c.fit(df.limit(0), known.limit(0))
    assert all(r["kept"] for r in c.score_with(df, empty).collect())


def noisy(r, n, rates, share):
    """Vote patterns, their truth, and a known part, of labellers with such rates."""
    patterns, truth, known = Counter(), Counter(), Counter()
    for i in range(n):
        bad = int(r.random() < share)
        v = tuple(int(r.random() < p) for p in rates[bad])
        patterns[v] += 1
        truth[v] += bad
        if i % 4 == 0:
            known[v, (1,) * len(v), bad] += 1
    return patterns, truth, known


def test_noisy_labellers_are_found_out():
    """One of three has five false votes in a hundred: a lone vote of it means little."""
    r = random.Random(21)
    rates = ((0.002, 0.05, 0.003), (0.7, 0.6, 0.65))
    patterns, truth, known = noisy(r, 40_000, rates, 0.1)
    for labels, off in ((known, 0.1), (None, 0.1)):
        model = c.fit_votes(dict(patterns), 0.2, labels)
        for v, n in patterns.items():
            if n > 50:
                assert model.positive(np.array([v]))[0] == pytest.approx(truth[v] / n, abs=off), (v, labels is None)
    model = c.fit_votes(dict(patterns), 0.2, known)
    assert model.rates == pytest.approx(np.array(rates), abs=0.06)
    # known documents of one class tell nothing
    one = {k: n for k, n in known.items() if k[2] == 0}
    assert c.fit_votes(dict(patterns), 0.2, one).rates.tolist() == c.fit_votes(dict(patterns), 0.2).rates.tolist()


def test_labels_leave_the_estimate_to_the_votes():
    """Few labels beside many votes: the rates with them are as good as without, and far better than those of the labels alone."""
    rates = ((0.002, 0.05, 0.003), (0.6, 0.5, 0.4))
    with_, without, alone = [], [], []
    for seed in range(8):
        r = random.Random(seed)
        patterns, _, _ = noisy(r, 20_000, rates, 0.1)
        known = Counter()
        for _ in range(400):
            bad = int(r.random() < 0.1)
            known[tuple(int(r.random() < p) for p in rates[bad]), (1, 1, 1), bad] += 1
        of_bad = {v: n for (v, _, bad), n in known.items() if bad}
        share = [sum(n for v, n in of_bad.items() if v[i]) / sum(of_bad.values()) for i in range(3)]
        alone.append(float(np.abs(np.array(share) - np.array(rates[1])).max()))
        for labels, off in ((dict(known), with_), (None, without)):
            model = c.fit_votes(dict(patterns), 0.2, labels)
            off.append(float(np.abs(model.rates[1] - np.array(rates[1])).max()) if len(model.rates) == 2 else 1.0)
    assert np.mean(with_) <= np.mean(without) + 5e-3, (with_, without)
    assert np.mean(with_) < 0.5 * np.mean(alone), (with_, alone)
    assert max(with_) < 0.06


def test_labellers_that_know_kinds_of_their_own():
    r = random.Random(22)
    patterns, truth = Counter(), Counter()
    for _ in range(30_000):
        kind = r.choices(range(8), [0.86] + [0.02] * 7)[0]
        v = tuple(int(r.random() < (0.95 if j + 1 == kind else 0.001)) for j in range(7))
        patterns[v] += 1
        truth[v] += kind > 0
    model = c.fit_votes(dict(patterns), 0.15)
    assert all(model.positive(np.array([v]))[0] > 0.6 for v in patterns if sum(v) == 1)
    assert model.positive(np.zeros((1, 7)))[0] < 0.1


def test_samples_are_never_empty(spark):
    for count in (0, 10, 6_000, 10**7, 6 * 10**9, 2 * 10**10, 10**13):
        share = c.share_of(c.TRAINED, count)
        assert share > 0 and share / c.HASHES == pytest.approx(min(1, c.TRAINED / max(1, count)))
    rows = spark.range(200_000).where(c.some_of(c.F.xxhash64("id"), 6_000, 200_000)).count()
    assert 5_500 < rows < 6_500


def test_buckets_are_packed_without_loss():
    r = random.Random(23)
    for n in (0, 1, 5, 900):
        held = np.array(sorted(r.sample(range(c.BUCKETS), n)), dtype=np.int64)
        assert c.unpack_buckets(c.pack_buckets(held)).tolist() == held.tolist()
    edge = np.array([0, 65535, 131070, 131071, c.BUCKETS - 1], dtype=np.int64)
    assert c.unpack_buckets(c.pack_buckets(edge)).tolist() == edge.tolist()


def test_capitals_are_counted_by_character():
    assert q.measure("A" * 50 + "\u0130" + "b" * 50)[7] == 51 and q.measure("ABc")[7] == 2


def test_very_long_and_odd_texts(spark):
    r = random.Random(24)
    rows, labels = corpus()
    long = prose(r, 60_000)
    large = (1 << 53) + 1
    odd = [(large, long, "en", "s", 0), (None, "### $$$ %%%", "en", "s", 0), (large + 1, long.upper(), "en", "s", 0)]
    df = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = {x["doc_id"]: x["kept"] for x in c.score(df, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    assert got[large] and not got[large + 1] and not got[None]
