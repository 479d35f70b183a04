"""Quality rules: base counts, then robust multivariate outliers per language and source.

Each text gives counts, and a vector of transformed statistics that are smoothed towards fixed
priors, so that short texts are not outliers for being short.  For each language and source the
minimum covariance determinant estimates centre and scatter, deterministically, from three starts:
medians and quartile ranges alone, and with the correlations of hyperbolic tangents, or of spatial
signs, of the values so standardised.  Concentration steps keep the ``CORE`` share of rows nearest by
Mahalanobis distance and estimate again.  After ``SHORT`` of them from each start, each group goes on
from the start with the least determinant, until a step brings back rows that an earlier one kept
(as groups are weighed with others, steps can go in circles); the number of steps is logged, and
``STEPS`` are the most.  A last step
estimates from all rows within the usual 97.5 % bound.  A document whose squared distance exceeds
``cutoff`` is rejected.

Every estimate of a group, of whatever size, is weighed with that of its language as if that were
``SHARED_ROWS`` more rows, and that of a language with that of all rows alike.  So a group of many
rows stands for itself, one of a few is held against its language, and none goes unjudged.

How it scales.  Texts are read once, where they lie; the steps run over a narrow stored table.
Every estimate is a sum of whole numbers, and every rank a histogram, both with partial sums
before the shuffle, so a source with a third of all rows costs no more than another, and the
result doesn't depend on the order of rows.  The estimates are a row per group, and broadcast
only when counted and below ``SMALL``.

Edge cases.  A null text has no words and fails the base rules.  A null language or source is
the same group as an empty one.  Documents that fail the base rules take no part in the
estimates.  A table without languages or sources is one of empty ones.  Repeated rows count as often as they stand there.  An empty table gives an empty
result.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import logging
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veridrift.llm.batches import with_made
from veridrift.llm.scratch import materialize

log = logging.getLogger(__name__)

SYMBOLS = "#*$%&|<>"
NGRAM = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: Share of rows that a concentration step keeps.
CORE = 0.75
STEPS = 20
#: Steps from each start before the least determinant decides.
SHORT = 2
#: Rows that the estimate of the language counts beside a group's own.
SHARED_ROWS = 100.0
#: Statistics are whole multiples of 1/SCALE, for sums that don't depend on their order.
SCALE = 10_000
#: Squared distances fall into bins of 1/BINS of a power of two.
BINS = 64
SMALL = 100_000
#: Squared Mahalanobis distance above which a document is rejected.
CUTOFF = 40.0

#: name, prior mean, prior weight, least standard deviation.
FEATURES = (
    ("word_length", 6.0, 50.0, 0.30),
    ("symbols", 0.0, 100.0, 0.05),
    ("dup_lines", 0.0, 10.0, 0.10),
    ("repeats", 0.0, 50.0, 0.08),
    ("upper", 0.03, 100.0, 0.06),
)
P = len(FEATURES)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_UPPER = re.compile(r"[^\W\d_a-z]")


def repeat_words(words: list[bytes], size: int = NGRAM) -> int:
    """Words that lie in a window of ``size`` words found twice or more."""
    n = len(words)
    if n <= size:
        return 0
    # windows with different hashes are different; only texts with equal ones are looked at again
    one = np.fromiter(map(hash, words), dtype=np.int64, count=n).view(np.uint64)
    mixed = one[: n - size + 1].copy()
    for i in range(1, size):
        mixed *= np.uint64(0x9E3779B97F4A7C15)
        mixed += one[i : n - size + 1 + i]
    mixed.sort()
    if not (mixed[1:] == mixed[:-1]).any():
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-1]))
    windows = [line[a:b] for a, b in zip(starts[: n - size + 1].tolist(), (ends[size - 1 :] - 1).tolist(), strict=True)]
    often = Counter(windows)
    found = np.array([often[w] > 1 for w in windows])
    edge = np.zeros(n + 1, dtype=np.int64)
    edge[: n - size + 1] += found
    edge[size:] -= found
    return int((np.cumsum(edge)[:n] > 0).sum())


def measure(text: str | None) -> tuple[int, ...]:
    """The base counts, then lines with a word, characters, letters and upper-case letters."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    white = sum(text.count(c) for c in " \t\n\v\f\r")
    seen: set[str] = set()
    lines = again = 0
    for line in text.split("\n"):
        if line.strip(" \t\v\f\r"):
            lines += 1
            again += line in seen
            seen.add(line)
    symbols = sum(text.count(c) for c in SYMBOLS)
    lower = text.lower()
    upper = 0
    if lower != text and len(lower) == len(text):
        a, b = (np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype="<u4") for t in (text, lower))
        upper = int(np.count_nonzero(a != b))
    elif lower != text:  # one that becomes two letters in lower case
        upper = sum(c != c.lower() for c in text)
    return len(words), len(text) - white, symbols, again, repeat_words(words), lines, len(text), upper


def statistics(m: tuple[int, ...]) -> list[int]:
    """The transformed vector in whole multiples of 1/SCALE."""
    n, chars, symbols, again, repeats, lines, length, upper = m
    made = []
    for (name, prior, weight, _), (a, b) in zip(FEATURES, ((chars, n), (symbols, length), (again, lines), (repeats, n), (upper, length)), strict=True):
        mean = (a + prior * weight) / (b + weight)
        made.append(round(SCALE * (mean if name == "word_length" else math.sqrt(mean))))
    return made


def with_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, source), the counts and the transformed vector of every row."""

    def work(texts: list[str | None]) -> list[list]:
        return [list(c) for c in zip(*((*m[:5], *statistics(m)) for m in map(measure, texts)), strict=True)]

    keys = [(F.coalesce(F.col(c).cast("string"), F.lit("")) if c in docs.columns else F.lit("")).alias(c) for c in ("lang", "source")]
    made = ", ".join(f"{c} long" for c in [*COUNTS, *(f"x{i}" for i in range(P))])
    return with_made(docs.select("doc_id", *keys, "text"), ["doc_id", "lang", "source"], "text", made, work)


def chi2_cdf(x: float, k: int) -> float:
    """Chi-squared distribution, by the series of the incomplete gamma function."""
    a, z = k / 2, x / 2
    if z <= 0:
        return 0.0
    term = total = 1 / a
    n = a
    while term > total * 1e-15:
        n += 1
        term *= z / n
        total += term
    return total * math.exp(-z + a * math.log(z) - math.lgamma(a))


def chi2_quantile(q: float, k: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if chi2_cdf(middle, k) < q else (low, middle)
    return low


def consistency(share: float) -> float:
    """What makes the scatter of the nearest ``share`` of normal rows that of all rows."""
    return share / chi2_cdf(chi2_quantile(share, P), P + 2)


def near(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= SMALL else df


#: Languages and all rows, beside the groups.
LEVELS = ("own", "lang", "all")


def weighed(n: float, own: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """What ``n`` rows say, with what is shared as ``SHARED_ROWS`` more."""
    return (n * own + SHARED_ROWS * shared) / (n + SHARED_ROWS)


def leveled(groups: DataFrame, columns: list[str], summed) -> DataFrame:
    """Per group its columns as ``own_``, those of its language as ``lang_`` and of all as ``all_``.

    ``summed`` makes the columns of (grp, lang), of (lang) or of nothing.
    """
    named = lambda df, level: df.withColumnsRenamed({c: f"{level}_{c}" for c in columns})
    own, lang, every = (named(summed(keys), level) for keys, level in zip((["grp", "lang"], ["lang"], []), LEVELS, strict=True))
    return own.join(near(materialize(lang, "languages")), "lang").crossJoin(F.broadcast(every))  # one row


def start(rows: DataFrame) -> DataFrame:
    """Estimates from medians and quartile ranges of each statistic, by exact histograms."""
    cells = rows.select("grp", "lang", F.posexplode(F.array(*[F.col(f"x{i}") for i in range(P)])).alias("i", "x"))
    cells = materialize(cells.groupBy("grp", "lang", "i", "x").agg(F.count("*").alias("n")), "cells")

    def marks(keys: list[str]) -> DataFrame:
        # values are whole multiples of 1/SCALE, so a histogram has few cells however many rows
        each = cells.groupBy(*keys, "i").agg(F.percentile("x", F.array(*[F.lit(q) for q in (0.25, 0.5, 0.75)]), F.col("n")).alias("q"), F.sum("n").alias("n"))
        return each.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("i", "q"))).alias("m"), F.max("n").alias("n"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for r in pdf.to_dict("records"):
                q = {level: np.array([list(x["q"]) for x in r[f"{level}_m"]]) / SCALE for level in LEVELS}
                middle = {k: v[:, 1] for k, v in q.items()}
                spread = {k: ((v[:, 2] - v[:, 0]) / 1.349) ** 2 for k, v in q.items()}
                mu, scatter = (weighed(r["own_n"], x["own"], weighed(r["lang_n"], x["lang"], x["all"])) for x in (middle, spread))
                out.append((r["grp"], mu.tolist(), inverse(np.diag(scatter))))
            yield pd.DataFrame(out, columns=["grp", "mu", "pr"])

    return leveled(rows, ["m", "n"], marks).mapInPandas(run, "grp string, mu array<double>, pr array<double>")


def inverse(scatter: np.ndarray) -> list[float]:
    """The inverse, row by row, of a scatter matrix with the least variances added."""
    return np.linalg.inv(scatter + np.diag([f[3] ** 2 for f in FEATURES])).ravel().tolist()


def distances(rows: DataFrame, estimates: DataFrame) -> DataFrame:
    """``rows`` with ``d2``, the squared Mahalanobis distance in their group; ``estimates`` have a row
    for each group, and are stored first, as they are counted."""
    joined = rows.join(near(materialize(estimates, "estimates")), "grp")
    off = [F.col(f"x{i}") / F.lit(float(SCALE)) - F.col("mu")[i] for i in range(P)]
    d2 = sum((F.col("pr")[i * P + j] * off[i] * off[j] for i in range(P) for j in range(P)), F.lit(0.0))
    return joined.withColumn("d2", d2).drop("mu", "pr")


PAIRS = [(i, j) for i in range(P) for j in range(i, P)]
SUMS = ["n", *(f"s{i}" for i in range(P)), *(f"s{i}_{j}" for i, j in PAIRS)]


def sums(rows: DataFrame) -> DataFrame:
    """Per group the exact sums that centre and scatter follow from."""
    wide = lambda c: F.sum(c.cast("decimal(38,0)"))
    made = [wide(F.col(f"x{i}")).alias(f"s{i}") for i in range(P)]
    made += [wide(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"s{i}_{j}") for i, j in PAIRS]
    return materialize(rows.groupBy("grp", "lang").agg(F.count("*").cast("decimal(38,0)").alias("n"), *made), "sums")


def moments(r: dict, level: str, factor: float) -> tuple[float, np.ndarray, np.ndarray]:
    """Rows, centre and scatter of a group, its language or all."""
    n = int(r[f"{level}_n"])
    scatter = np.zeros((P, P))
    for i, j in PAIRS:
        exact = n * int(r[f"{level}_s{i}_{j}"]) - int(r[f"{level}_s{i}"]) * int(r[f"{level}_s{j}"])
        scatter[i, j] = scatter[j, i] = exact / (n * n * SCALE * SCALE)
    return n, np.array([int(r[f"{level}_s{i}"]) / (n * SCALE) for i in range(P)]), scatter * factor


def estimate(totals: DataFrame, factor: float) -> DataFrame:
    """Centre and inverse scatter of each group from ``sums``."""

    def summed(keys: list[str]) -> DataFrame:
        return totals.groupBy(*keys).agg(*[F.sum(c).cast("decimal(38,0)").alias(c) for c in SUMS])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for r in pdf.to_dict("records"):
                (n, *own), (m, *lang), (_, *every) = (moments(r, level, factor) for level in LEVELS)
                mu, scatter = (weighed(n, a, weighed(m, b, c)) for a, b, c in zip(own, lang, every, strict=True))
                out.append((r["grp"], mu.tolist(), inverse(scatter)))
            yield pd.DataFrame(out, columns=["grp", "mu", "pr"])

    return leveled(totals, SUMS, summed).mapInPandas(run, "grp string, mu array<double>, pr array<double>")


def core_of(rows: DataFrame, estimates: DataFrame) -> DataFrame:
    """The ``CORE`` share of each group that is nearest under ``estimates``."""
    binned = distances(rows, estimates).withColumn("bin", F.floor(F.log2(F.col("d2") + F.lit(1e-6)) * BINS).cast("int"))
    cells = binned.groupBy("grp", "bin").agg(F.count("*").alias("n"))
    cells = cells.withColumn("upto", F.sum("n").over(Window.partitionBy("grp").orderBy("bin")))
    cells = cells.withColumn("all", F.sum("n").over(Window.partitionBy("grp")))
    last = cells.where(F.col("upto") >= F.ceil(F.col("all") * CORE)).groupBy("grp").agg(F.min("bin").alias("last"))
    return binned.join(near(materialize(last, "last")), "grp").where("bin <= last")


def directions(rows: DataFrame, first: DataFrame, kind: str) -> DataFrame:
    """Estimates with the centres and spreads of ``first``, and correlations of standardised values.

    These are hyperbolic tangents (``tanh``) or divided by their length (``sign``), in whole
    multiples of 1/SCALE, so that their sums are exact.
    """
    z = [(F.col(f"x{i}") / F.lit(float(SCALE)) - F.col("mu")[i]) * F.sqrt(F.col("pr")[i * P + i]) for i in range(P)]
    if kind == "tanh":
        y = [F.tanh(v) for v in z]
    else:
        length = F.sqrt(sum((v * v for v in z), F.lit(0.0)))
        y = [F.when(length > 0, v / length).otherwise(F.lit(0.0)) for v in z]
    bent = rows.join(near(first), "grp").select("grp", "lang", *[F.round(v * SCALE).cast("long").alias(f"y{i}") for i, v in enumerate(y)])
    names = ["n", *(f"s{i}_{j}" for i, j in PAIRS)]
    made = [F.sum((F.col(f"y{i}") * F.col(f"y{j}")).cast("decimal(38,0)")).alias(f"s{i}_{j}") for i, j in PAIRS]
    totals = materialize(bent.groupBy("grp", "lang").agg(F.count("*").cast("decimal(38,0)").alias("n"), *made), "bent")

    def summed(keys: list[str]) -> DataFrame:
        return totals.groupBy(*keys).agg(*[F.sum(c).cast("decimal(38,0)").alias(c) for c in names])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for r in pdf.to_dict("records"):
                shape = {}
                for level in LEVELS:
                    shape[level] = m = np.zeros((P, P))
                    for i, j in PAIRS:
                        m[i, j] = m[j, i] = int(r[f"{level}_s{i}_{j}"]) / (int(r[f"{level}_n"]) * SCALE * SCALE)
                both = weighed(int(r["own_n"]), shape["own"], weighed(int(r["lang_n"]), shape["lang"], shape["all"]))
                out.append((r["grp"], list(r["mu"]), correlated(both, np.array(r["pr"]).reshape(P, P))))
            yield pd.DataFrame(out, columns=["grp", "mu", "pr"])

    return leveled(totals, names, summed).join(near(first), "grp").mapInPandas(run, "grp string, mu array<double>, pr array<double>")


def correlated(shape: np.ndarray, inverse_diagonal: np.ndarray) -> list[float]:
    """The inverse scatter with the spreads of ``inverse_diagonal`` and the correlations of ``shape``."""
    size = np.sqrt(np.diag(shape))
    wide = np.outer(size, size)
    r = np.divide(shape, wide, out=np.zeros((P, P)), where=wide > 0)
    np.fill_diagonal(r, 1.0)
    spread = np.sqrt((1 / np.diag(inverse_diagonal) - [f[3] ** 2 for f in FEATURES]).clip(0))
    return inverse(r * np.outer(spread, spread))


def least_determinant(candidates: list[DataFrame]) -> DataFrame:
    """Of the estimates of each group those whose scatter has the least determinant; the first of equal ones."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            # the scatter's inverse is stored: its determinant is the largest
            pdf["size"] = [round(float(np.linalg.slogdet(np.array(x).reshape(P, P))[1]), 6) for x in pdf["pr"]]
            yield pdf[["grp", "mu", "pr", "start", "size"]]

    every = None
    for i, c in enumerate(candidates):
        c = c.select("grp", "mu", "pr", F.lit(i).alias("start"))
        every = c if every is None else every.unionByName(c)
    sized = every.mapInPandas(run, "grp string, mu array<double>, pr array<double>, start int, size double")
    best = sized.groupBy("grp").agg(F.max_by(F.struct("mu", "pr"), F.struct("size", -F.col("start"))).alias("best"))
    return best.select("grp", "best.*")


def concentrated(rows: DataFrame, estimates: DataFrame, steps: int = STEPS) -> tuple[DataFrame, int]:
    """Estimates after concentration steps, and how many kept rows that none before had kept."""
    seen, taken = set(), 0
    for _ in range(steps):
        totals = sums(core_of(rows, estimates))
        now = totals.agg(F.count("*"), F.sum(F.xxhash64("grp", *SUMS).cast("decimal(38,0)"))).first()
        if tuple(now) in seen:
            break
        seen.add(tuple(now))
        taken += 1
        estimates = materialize(estimate(totals, consistency(CORE)), "estimates")
    return estimates, taken


def robust(rows: DataFrame) -> DataFrame:
    """The estimates of all groups after concentration from the best start."""
    first = materialize(start(rows), "estimates")
    starts = [first, *[materialize(directions(rows, first, kind), "estimates") for kind in ("tanh", "sign")]]
    best = materialize(least_determinant([concentrated(rows, s, SHORT)[0] for s in starts]), "estimates")
    estimates, taken = concentrated(rows, best)
    log.info("concentration ended after %d steps", taken)
    return estimates


def judge(docs: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """Counts, base verdict, distance and final verdict of every row of documents."""
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    stats = materialize(with_statistics(docs).withColumn("base_failed", failed), "statistics")
    result = ["doc_id", *COUNTS, "base_failed"]
    rows = stats.where("not base_failed").withColumn("grp", F.to_json(F.struct("lang", "source")))
    estimates = robust(rows)
    inside = distances(rows, estimates).where(F.col("d2") <= chi2_quantile(0.975, P))
    final = estimate(sums(inside), consistency(0.975))
    # a group none of whose rows is inside keeps the estimate that it had
    final = final.unionByName(estimates.join(final.select("grp"), "grp", "left_anti"))
    judged = distances(rows, final).withColumn("distance", F.sqrt("d2"))
    judged = judged.select(*result, "distance", (F.col("d2") <= cutoff).alias("kept"))
    lost = stats.where("base_failed").select(*result, F.lit(None).cast("double").alias("distance"), F.lit(False).alias("kept"))
    return judged.union(lost)
