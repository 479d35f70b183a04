"""Quality and toxicity classifier from weak labels.

Heuristic labellers vote on each document or are silent; they overlap, each misses much, and none
is always right.  Expectation-maximisation over the counts of all vote patterns estimates how
often each labeller votes on good and on bad documents, and with that the posterior label of each
pattern.  Documents with posterior labels then train a linear scorer over hashed words and hashed
statistics, which scores every document.  The model has two heads of this kind, junk and toxic.

Both rates of a labeller are estimated, on good and on bad documents; known labels, where there
are some of both classes, weigh most in that.  Among the labellers
of the toxic head are word lists that are learned from labelled documents by language, each list
from a half of them, so that they can disagree; a list's rates are counted on the other half.

How it scales.  The texts are read once for features: the votes and the packed buckets of every
document are stored, and the counts, the training sample and the scores come from that table.
Votes are counted as patterns, of which there are at most 128 however many documents; the counts
cover all of them.  The labelled sample is at most about ``LABELLED`` rows and the training
sample ``TRAINED``, both chosen by a hash in 2**62 parts, so they are never empty for want of a
share; what reaches the driver is word statistics, patterns and the buckets of the training
sample.

Edge cases.  A text without words (null and empty ones too) has no votes and scores zero, so it is
kept.  Labels with nulls are left out.  Without labelled
documents the word lists are empty; with no documents at all the model keeps everything.
Repeated rows are scored alike.  Other columns pass through unchanged, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veridrift.llm.batches import arrow_schema, parts, release, with_made
from veridrift.llm.quality_rules import measure
from veridrift.llm.scratch import materialize, owned

#: Most labelled documents that word lists and rates are learned from, and most that train the scorer.
LABELLED = 20_000
TRAINED = 6_000
BUCKETS = 1 << 20
#: Words that a task remembers the buckets of.
KNOWN_WORDS = 200_000
#: Parts of a hash that samples are chosen by.
HASHES = 1 << 62
#: What labellers are taken for beforehand: how often they vote on good and on bad texts.
FALSE_VOTES, TRUE_VOTES = 0.002, 0.3
#: Rows that the prior counts where labels are known.  A known row is one row, like any other.
PRIOR_ROWS = 20.0
#: Texts of fewer words aren't held to repeat themselves.
FEW_WORDS = 40
#: Hashed features that a head keeps.
KEPT_FEATURES = 4096
#: Standard deviations by which its classes differ, and texts that hold it, at least.
LEAST_GAIN, LEAST_SEEN = 4.0, 4.0
#: A learned word stands in so many toxic texts at least, so many times as often as in others of
#: its language, and with so much evidence (a likelihood ratio); words of a list and language.
LEAST_TEXTS, LEAST_ODDS, LEAST_EVIDENCE, LIST_SIZE = 3, 20.0, 18.0, 300
#: Different words of a learned list that make a vote.
LEAST_HITS = 2
#: Letters of a word's beginning that count as a token of their own.
STEM = 5

#: Scores above which a document is rejected.
JUNK_LIMIT, TOXIC_LIMIT = 0.5, 0.3

#: A short list of plain English insults to begin with, a parameter of ``fit``; what else marks
#: toxic texts, in whatever language, is learned.
INSULTS = frozenset("clown disgusting idiot loser moron pathetic scum stupid trash worthless".split())

JUNK = ("symbols", "capitals", "repeats", "windows", "marks", "variety", "lines")
TOXIC = ("insults", "list_a", "list_b")
_WORD = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class Lists:
    """What the labellers of the toxic head know."""

    insults: frozenset = INSULTS
    a: frozenset = frozenset()
    b: frozenset = frozenset()


def features(text: str | None) -> tuple[dict[str, float], set[str]]:
    """Statistics that labellers look at, and the distinct words of a text."""
    text = text or ""
    n, _, symbols, again, windows, lines, length, upper = measure(text)
    words = text.split()
    n1 = max(1, n)
    same = sum(map(str.__eq__, words, words[1:])) if n > 1 else 0
    found = set(_WORD.findall(text.lower()))
    stats = {
        "n": n,
        "symbols": symbols / n1,
        "capitals": upper / max(1, length),
        "repeats": same / n1,
        "windows": windows / n1 if n >= FEW_WORDS else 0.0,
        "marks": text.count("!") / n1,
        "variety": len(found) / math.sqrt(n1),
        "lines": again / max(1, lines) if n >= FEW_WORDS else 0.0,
    }
    return stats, found


def junk_votes(s: dict[str, float]) -> tuple[int, ...]:
    """1 where a labeller takes the text for junk; each knows one kind of junk only."""
    n = s["n"]
    return tuple(
        int(x)
        for x in (
            s["symbols"] > 0.2,
            s["capitals"] > 0.35,
            n >= 5 and s["repeats"] > 0.25,
            s["windows"] > 0.5,
            s["marks"] > 0.3,
            n >= 20 and s["variety"] < 1.5,
            s["lines"] > 0.5,
        )
    )


@dataclass
class Votes:
    """The label model: shares of the latent kinds, the first of them good and the others bad, and
    how often each labeller votes in each kind."""

    share: np.ndarray
    rates: np.ndarray

    def joint(self, votes: np.ndarray, heard: np.ndarray | float = 1.0) -> np.ndarray:
        """Log chance of each kind together with each row of votes, of the labellers that were heard."""
        return np.log(self.share) + (heard * votes) @ np.log(self.rates).T + (heard * (1 - votes)) @ np.log(1 - self.rates).T

    def positive(self, votes: np.ndarray) -> np.ndarray:
        """Chance to be bad for each row of votes."""
        return 1 - chances(self.joint(votes))[:, 0]


def chances(joint: np.ndarray) -> np.ndarray:
    p = np.exp(joint - joint.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


#: Counts of known documents by votes, which labellers were heard, and whether the document is bad.
Known = dict[tuple[tuple[int, ...], tuple[int, ...], int], int]


@dataclass
class Evidence:
    """Rows of votes with their counts; ``shut`` is -inf for the kinds that a row can't be."""

    votes: np.ndarray
    heard: np.ndarray
    count: np.ndarray
    bad: np.ndarray  # -1 where that isn't known

    def joint(self, model: Votes) -> np.ndarray:
        shut = np.zeros((len(self.votes), len(model.share)))
        shut[self.bad == 0, 1:] = -np.inf
        shut[self.bad == 1, 0] = -np.inf
        return model.joint(self.votes, self.heard) + shut

    def likelihood(self, model: Votes) -> float:
        return float(self.count @ np.logaddexp.reduce(self.joint(model), axis=1))

    def expect(self, model: Votes, hold: np.ndarray, rounds: int = 300) -> Votes:
        """Expectation-maximisation from ``model``, whose rates are those of the prior too.

        ``hold``: rows that the prior of each kind counts; its shares count as many as the first.
        """
        start, shares = model.rates, model.share * hold[0]
        for _ in range(rounds):
            p = chances(self.joint(model)) * self.count[:, None]
            share = p.sum(axis=0) + shares
            rates = (p.T @ (self.heard * self.votes) + start * hold[:, None]) / (p.T @ self.heard + hold[:, None])
            model = Votes((share / share.sum()).clip(1e-6, 1), rates.clip(1e-5, 0.995))
        return model


def fit_votes(patterns: dict[tuple[int, ...], int], prior: float, known: Known | None = None) -> Votes:
    """The label model of the counts of all vote patterns; all rates are estimated.

    Rows with a known label, where both classes are there, count as they are: they tell their class
    and weigh no more than others, so few labels leave the estimate to the votes.  The model
    has two classes whose labellers vote independently, unless bad documents of several kinds, each
    mostly the matter of one labeller, explain the votes better by more than their further
    parameters (Akaike's criterion).
    """
    known = known if known and len({bad for _, _, bad in known}) == 2 else {}
    rows = [(v, (1,) * len(v), -1, n) for v, n in patterns.items()] + [(v, heard, bad, n) for (v, heard, bad), n in known.items()]
    votes, heard, bad, count = (np.array(x, dtype=np.float64) for x in zip(*rows, strict=True))
    evidence, m = Evidence(votes, heard, count, bad), votes.shape[1]
    hold = (lambda k: np.full(k, PRIOR_ROWS / k)) if known else lambda k: np.array([50.0] + [4.0] * (k - 1))
    models = []
    for starts in (np.full((1, m), TRUE_VOTES), np.full((m, m), 0.05) + 0.75 * np.eye(m)):
        k = len(starts)
        begin = Votes(np.array([1 - prior] + [prior / k] * k), np.vstack([np.full(m, FALSE_VOTES), starts]))
        models.append(evidence.expect(begin, hold(k + 1)))
    active = int((votes.sum(axis=0) > 0).sum())
    further = active + (active + 1) * active - (1 + 2 * active)
    two, kinds = models
    if active < 3 and not known:  # votes of two can't tell which of them errs
        return kinds
    return kinds if evidence.likelihood(kinds) - evidence.likelihood(two) > max(0, further) else two


def tokens(word: str) -> tuple[str, ...]:
    """A word, and the beginning of a longer one."""
    return (word, word[:STEM] + "*") if len(word) > STEM else (word,)


def bucket(token: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(token.encode("utf-8", "surrogatepass"), 7) % BUCKETS


def stat_tokens(s: dict[str, float]) -> list[str]:
    """Statistics in steps, as tokens to be hashed like words."""
    return [f"\0{k}:{min(12, int(10 * s[k]))}" for k in JUNK] + [f"\0listed:{min(4, int(s['listed']))}"]


def pack_buckets(buckets: np.ndarray) -> bytes:
    """Ascending numbers as steps of two bytes; 65535 is a step with more to come."""
    steps = np.diff(buckets, prepend=0)
    more = steps // 65535
    out = np.full(len(steps) + int(more.sum()), 65535, dtype="<u2")
    out[np.cumsum(more + 1) - 1] = steps % 65535
    return out.tobytes()


def unpack_buckets(packed: bytes) -> np.ndarray:
    steps = np.frombuffer(packed, dtype="<u2")
    return np.cumsum(steps, dtype=np.int64)[steps != 65535]


@dataclass
class Head:
    """A linear scorer: a constant and the weights of its buckets."""

    constant: float = -10.0
    weights: dict[int, float] = field(default_factory=dict)
    votes: Votes | None = None

    def dense(self) -> np.ndarray:
        out = np.zeros(BUCKETS, dtype=np.float32)
        out[list(self.weights)] = list(self.weights.values())
        return out


@dataclass
class Model:
    junk: Head
    toxic: Head
    lists: Lists


def train(rows: list[np.ndarray], target: np.ndarray, rounds: int = 300) -> Head:
    """Logistic regression on the present buckets that tell the classes apart best.

    Full-batch gradient steps with a momentum; labels are posteriors, not rounded.
    """
    if not rows or target.sum() < 1 or (1 - target).sum() < 1:
        return Head(constant=-10.0)
    length = np.array([len(r) for r in rows])
    at, cols = np.repeat(np.arange(len(rows), dtype=np.int32), length), np.concatenate(rows)
    names, cols = np.unique(cols, return_inverse=True)
    cols = cols.astype(np.int32)
    with_pos = np.bincount(cols, target[at], len(names))
    with_neg = np.bincount(cols, (1 - target)[at], len(names))
    pos, neg = target.sum(), (1 - target).sum()
    a, b = (with_pos + 0.5) / (pos + 1), (with_neg + 0.5) / (neg + 1)
    gain = np.abs(a - b) / np.sqrt((a + b) * (1 / pos + 1 / neg))
    keep = np.argsort(-gain, kind="stable")[:KEPT_FEATURES]
    least = min(LEAST_GAIN, 0.6 * math.sqrt(min(pos, neg)))  # a class of few texts can't show more
    keep = keep[(gain[keep] > least) & ((with_pos + with_neg)[keep] >= LEAST_SEEN)]
    place = np.full(len(names), -1, dtype=np.int32)
    place[keep] = np.arange(len(keep))
    cols = place[cols]
    at, cols = at[cols >= 0], cols[cols >= 0]
    w, c = np.zeros(len(keep)), math.log(pos / neg)
    move, move_c, n = np.zeros(len(keep)), 0.0, len(rows)
    seen = np.bincount(cols, minlength=len(keep)) + 20
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(c + np.bincount(at, w[cols], n)).clip(-500, 500)))
        off = target - p
        move = 0.9 * move + (np.bincount(cols, off[at], len(keep)) - 0.2 * w) / seen
        move_c = 0.9 * move_c + off.sum() / n
        w += 0.3 * move
        c += 0.3 * move_c
    return Head(float(c), {int(names[k]): float(x) for k, x in zip(keep, w, strict=True)})


def some_of(hashed: Column, wanted: int, count: int) -> Column:
    """About ``wanted`` of ``count`` rows by a hash; all of them where there are no more."""
    return F.pmod(hashed, F.lit(HASHES)) < F.lit(share_of(wanted, count))


def share_of(wanted: int, count: int) -> int:
    """``wanted`` of ``count`` in ``HASHES`` parts, at least one."""
    return min(HASHES, max(1, HASHES * wanted // max(1, count)))


def labelled_sample(labels: DataFrame | None) -> DataFrame | None:
    """(doc_id, quality, toxic) of at most about ``LABELLED`` labelled ids; None without labels."""
    if labels is None:
        return None
    quality = F.col("quality") if "quality" in labels.columns else F.lit(None).cast("int")
    known = labels.where("doc_id is not null and toxic is not null").select("doc_id", quality.alias("quality"), "toxic")
    n = known.count()
    if n == 0:
        return None
    chosen = known.where(some_of(F.xxhash64("doc_id", F.lit("labelled")), LABELLED, n))
    return materialize(chosen.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic")), "labelled")


def language(docs: DataFrame) -> Column:
    return F.coalesce(F.col("lang").cast("string"), F.lit("")) if "lang" in docs.columns else F.lit("")


def contexts(text: str) -> set[tuple[str, str]]:
    """The words of a text, each with those before and after it where it first stands."""
    words = _WORD.findall(text.lower())
    first: dict[str, str] = {}
    for before, word, after in zip(["", *words], words, [*words[1:], ""], strict=False):
        first.setdefault(word, f"{before}_{after}")
    return set(first.items())


def learn_lists(docs: DataFrame, sample: DataFrame | None, insults: frozenset = INSULTS) -> Lists:
    """Words that mark toxic texts of a language, from each half of the labelled texts."""
    if sample is None:
        return Lists(insults)
    # the sample has LABELLED rows or so, whatever the number of labels
    texts = docs.select("doc_id", language(docs).alias("lang"), "text").join(F.broadcast(sample.select("doc_id", "toxic")), "doc_id")
    texts = texts.where("text is not null").withColumn("digest", F.xxhash64("text")).dropDuplicates(["digest"])
    half = F.col("digest").bitwiseAND(F.lit(1)).cast("int").alias("half")
    texts = materialize(texts.select(half, "lang", (F.col("toxic") > 0).cast("long").alias("bad"), "text"), "labelled-texts")

    def words(held: list[str]) -> list[list]:
        return [[sorted({f"{x} {around}" for v, around in contexts(t) for x in tokens(v)}) for t in held]]

    found = with_made(texts, ["half", "lang", "bad"], "text", "words array<string>", words)
    sizes = texts.groupBy("half", "lang").agg(F.sum("bad").alias("nt"), F.sum(1 - F.col("bad")).alias("nc"))
    # a word counts once for each of its surroundings, so that near copies of a text count once
    listed = found.select("half", "lang", "bad", F.explode("words").alias("word")).distinct()
    counts = listed.withColumn("word", F.substring_index("word", " ", 1)).groupBy("half", "lang", "word")
    counts = counts.agg(F.sum("bad").alias("t"), F.sum(1 - F.col("bad")).alias("c")).where(F.col("t") >= LEAST_TEXTS).join(sizes, ["half", "lang"])
    odds = (F.col("t") / F.col("nt")) / ((F.col("c") + 0.5) / F.greatest(F.col("nc"), F.lit(1)))
    n = F.col("t") + F.col("c")
    of = lambda x, size: F.when(x > 0, x * F.log(x * (F.col("nt") + F.col("nc")) / (n * size))).otherwise(F.lit(0.0))
    evidence = 2 * (of(F.col("t"), F.col("nt")) + of(F.col("c"), F.col("nc")))
    chosen = counts.withColumn("evidence", evidence).where((odds >= LEAST_ODDS) & (F.col("evidence") >= LEAST_EVIDENCE))
    place = F.row_number().over(Window.partitionBy("half", "lang").orderBy(F.desc("evidence"), "word"))
    rows = chosen.withColumn("place", place).where(F.col("place") <= LIST_SIZE).select("half", "word").collect()
    return Lists(insults, *(frozenset(r["word"] for r in rows if r["half"] == h) for h in (0, 1)))


FEATURES = "worded boolean, junk int, toxic int, buckets binary"


def bits(votes: tuple[int, ...]) -> int:
    return sum(v << i for i, v in enumerate(votes))


def votes_of(number: int, names: tuple[str, ...]) -> tuple[int, ...]:
    return tuple(number >> i & 1 for i in range(len(names)))


def feature_work(lists: Lists):
    """What makes the columns of ``FEATURES`` of a list of texts; it remembers words from call to call."""
    known: dict[str, tuple[tuple[int, ...], int]] = {}
    #: by which lists a form is known, as bits
    by: dict[str, int] = {}
    for i, forms in enumerate((lists.insults, lists.a, lists.b)):
        for form in forms:
            by[form] = by.get(form, 0) | 1 << i

    def look(word: str) -> tuple[tuple[int, ...], int]:
        stem = word[:STEM] + "*"
        held = by.get(word, 0) | (by.get(stem, 0) if len(word) > STEM else 0)
        known[word] = made = (tuple(map(bucket, tokens(word))), held)
        return made

    def one(text: str | None) -> tuple[bool, int, int, bytes]:
        s, words = features(text)
        found: list[int] = []
        held: list[int] = []  # for words of any list
        for w in words:
            buckets, lists_of = known.get(w) or look(w)
            found += buckets
            if lists_of:
                held.append(lists_of)
        s["listed"] = sum(x > 1 for x in held)
        many = [sum(x >> i & 1 for x in held) for i in range(3)] if held else (0, 0, 0)
        votes = (int(many[0] > 0), int(many[1] >= LEAST_HITS), int(many[2] >= LEAST_HITS))
        found += map(bucket, stat_tokens(s))
        at = np.array(found, dtype=np.int64)
        at.sort()
        packed = pack_buckets(at[np.concatenate(([True], at[1:] != at[:-1]))])
        return s["n"] > 0, bits(junk_votes(s)), bits(votes), packed

    def work(texts: list[str | None]) -> list[list]:
        if len(known) > KNOWN_WORDS:
            known.clear()
        return [list(c) for c in zip(*map(one, texts), strict=True)]

    work.done = known.clear
    return work


def featured(docs: DataFrame, lists: Lists, carried: list[str]) -> DataFrame:
    """Votes, as bits, and buckets of every row; the columns ``carried`` as they are in ``doc``."""
    whole = F.struct(*[F.col(f"`{c}`") for c in carried]).alias("doc")
    df = docs.select(whole, F.xxhash64(F.coalesce("text", F.lit(""))).alias("digest"), "text")
    return with_made(df, ["doc", "digest"], "text", FEATURES, feature_work(lists))


def known_votes(table: DataFrame, sample: DataFrame | None, label: str, head: str, names: tuple[str, ...]) -> Known:
    """Votes on labelled documents; a learned list is heard on the half that it isn't learned from."""
    if sample is None:
        return {}
    bad = (F.col("label") == 0) if label == "quality" else (F.col("label") > 0)
    half = F.col("digest").bitwiseAND(F.lit(1)).alias("half")
    cast = table.select(F.col("doc.doc_id").alias("doc_id"), half, F.col(head).alias("votes"))
    cast = cast.join(F.broadcast(sample.select("doc_id", F.col(label).alias("label"))), "doc_id").where("label is not null")
    known: Known = {}
    for r in cast.groupBy(bad.cast("int").alias("bad"), "half", "votes").agg(F.count("*").alias("n")).collect():
        heard = tuple(int(name != ("list_a", "list_b")[r["half"]]) for name in names)
        key = (votes_of(r["votes"], names), heard, r["bad"])
        known[key] = known.get(key, 0) + r["n"]
    return known


def fit(docs: DataFrame, labels: DataFrame | None = None, insults: frozenset = INSULTS, carried: list[str] | None = None) -> tuple[Model, DataFrame]:
    """The model of a corpus, and the stored features of its documents.

    ``labels``: (doc_id, toxic) of some documents, and ``quality`` (0 is junk) where there is such
    a column.  ``carried``: columns of the documents that the features come with, all by default.
    """
    sample = labelled_sample(labels)
    lists = learn_lists(docs, sample, insults)
    carried = docs.columns if carried is None else list(dict.fromkeys(["doc_id", *carried]))
    table = materialize(featured(docs, lists, carried), "features")
    # copies of a text train as one, and are counted as often as they stand there
    chosen = table.where(F.col("worded") & some_of(F.col("digest"), TRAINED, table.count()))
    train_on = chosen.select("digest", "junk", "toxic", "buckets").dropDuplicates(["digest"]).orderBy("digest").limit(2 * TRAINED).collect()
    rows = [unpack_buckets(r["buckets"]) for r in train_on]
    heads = {}
    for name, names, label, prior in (("junk", JUNK, "quality", 0.15), ("toxic", TOXIC, "toxic", 0.1)):
        counts = {votes_of(r[name], names): r["n"] for r in table.groupBy(name).agg(F.count("*").alias("n")).collect()}
        if not counts:
            heads[name] = Head()
            continue
        votes = fit_votes(counts, prior, known_votes(table, sample, label, name, names))
        cast = np.array([votes_of(r[name], names) for r in train_on], dtype=np.float64).reshape(-1, len(names))
        heads[name] = train(rows, votes.positive(cast))
        heads[name].votes = votes
    return Model(heads["junk"], heads["toxic"], lists), table


def scores(table: DataFrame, model: Model) -> DataFrame:
    """(doc, junk_score, toxic_score) of every row of features."""
    sparse = [(h.constant, np.array(list(h.weights), dtype=np.int64), np.array(list(h.weights.values()))) for h in (model.junk, model.toxic)]
    shared = table.sparkSession.sparkContext.broadcast(sparse)  # at most KEPT_FEATURES weights a head
    ddl = "junk_score double, toxic_score double"
    types = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads = []
        for constant, at, weights in shared.value:
            dense = np.zeros(BUCKETS)
            dense[at] = weights
            heads.append((constant, dense))
        for batch in batches:
            for part in parts(batch):
                held = [unpack_buckets(b) for b in part.column("buckets").to_pylist()]
                worded = np.array(part.column("worded").to_pylist())
                ends = np.cumsum([len(h) for h in held])
                flat = np.concatenate(held)
                new = []
                for constant, dense in heads:
                    sums = np.diff(np.concatenate(([0.0], np.cumsum(dense[flat])))[np.concatenate(([0], ends))])
                    score = np.where(worded, 1 / (1 + np.exp(-(constant + sums).clip(-500, 500))), 0.0)
                    new.append(pa.array(score))
                yield pa.RecordBatch.from_arrays([part.column("doc"), *new], ["doc", *types.names])
        release()

    kind = table.schema["doc"].dataType.simpleString()
    return table.select("doc", "worded", "buckets").mapInArrow(run, f"doc {kind}, {ddl}")


def judged(table: DataFrame, model: Model, limit: float = JUNK_LIMIT, toxic_limit: float = TOXIC_LIMIT) -> DataFrame:
    good = (F.col("junk_score") <= limit) & (F.col("toxic_score") <= toxic_limit)
    return scores(table, model).withColumn("kept", good)


def score(docs: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """(doc_id, junk_score, toxic_score, kept) of every row, by a model that is fitted to them."""
    model, table = fit(docs, labels, carried=["doc_id"])
    return judged(table, model).select("doc.doc_id", "junk_score", "toxic_score", "kept")


def score_with(docs: DataFrame, model: Model) -> DataFrame:
    """The same by a model that is there already."""
    return judged(featured(docs, model.lists, ["doc_id"]), model).select("doc.doc_id", "junk_score", "toxic_score", "kept")


def keep(docs: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """The rows that are kept, with all their columns as they were."""
    with owned() as mine:
        model, table = fit(docs, labels)
        mine.sweep(docs.sparkSession, table)
    return judged(table, model).where("kept").select("doc.*")
