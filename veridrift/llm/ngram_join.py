"""Similarity join of word n-gram sets by rare-first prefix filtering.

Two sets link when 100 * intersection >= ``percent`` * union.  All sets are put in one order of
their n-grams, rare ones first; then sets that link share an n-gram among the first
n - ceil(percent * n / 100) + 1 of each (n: the size), so joining those prefixes finds every pair.
The order is by how many n-grams of documents fall into the *bucket* of an n-gram's hash (in eighths
of powers of two), then by the hash: the table of ``BUCKETS`` bytes has one size whatever the corpus,
so it can be sent to every task, and any order that all sets share is right.  What is common stands out in its bucket
and comes last, so passages that many documents share don't make candidates.

Candidates pass three filters before any set is fetched:

* length: 100 * smaller size >= percent * larger size;
* positional: before and after the shared n-gram, no more n-grams can be shared than the shorter
  side has there;
* suffix: pivots of the hash cut both sets into ``PARTS``, and the counts of the parts must not
  differ by more than the sets may differ.  (Fixed pivots take the place of recursive ones, so a
  set is described once by half a byte for each part; counts are kept up to 15, and saturated ones
  only differ by less.)

What is left is verified by whole sets, once for each pair: pairs are distinct, and later rounds
leave out what was tested before.

How it scales.  Equal sets are one entry.  A list (the entries with one prefix n-gram) gives its
pairs in three rounds.  First its smallest entry is paired with the others.  Then, in lists that
links don't connect, each entry is paired with the likeliest of another component.  Last, in lists
that are still apart, come all pairs of different components that pass the filters, of entries that
had such a pair in the second round (components only grow, so no others can have one).  So a group of
near copies gives pairs in proportion to its members, and no link between components is lost.
Rounds two and three compare in the tasks, by blocks of ``BLOCK`` entries, a pair of blocks being a
unit of work of its own; joins on the n-gram are equi-joins that adaptive execution can split.
Texts are read again for the prefixes, and for the sets of candidates.

Edge cases.  Words are lower-cased in ASCII and split at ASCII white space.  Fewer words than an
n-gram make one n-gram of them all; a null text or one without words has an empty set and links
with nothing, not even an equal one.  Rows are told apart by an inner number: repeated rows link by
their texts, and null ids count as the largest, so a component is null only where all its ids are.
Empty tables give empty results; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridrift.llm.batches import parts, release, with_made
from veridrift.llm.components import components
from veridrift.llm.scratch import materialize, owned

#: Buckets of the n-gram counts, in ranges that are added up apart; parts of the suffix filter.
BUCKETS, RANGES, PARTS = 1 << 25, 64, 512
#: Entries of a block of a list; entries, and pairs, that a task compares at once.
BLOCK, TOGETHER, COMPARED = 2048, 4096, 4096
SEED = 42
FACTORS = np.random.default_rng(SEED).integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Hashes of the distinct n-grams of a text, in order: words are hashed, and joined by their places."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    w = np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, words)), dtype="<u8")
    width = min(size, len(w))
    n = len(w) - width + 1
    total = np.full(n, width, dtype=np.uint64)
    for i in range(width):
        total += w[i : i + n] * FACTORS[i]
    h = np.sort(mixed(total))
    return h[np.append(True, h[1:] != h[:-1])]


def parts_of(h: np.ndarray) -> bytes:
    """How many of the hashes lie in each part, half a byte each."""
    count = np.minimum(np.bincount((h >> np.uint64(55)).astype(np.int64), minlength=PARTS), 15).astype(np.uint8)
    return (count[::2] | count[1::2] << 4).tobytes()


def opened(cut: list[bytes]) -> np.ndarray:
    """The counts of parts, a row for each set."""
    packed = np.frombuffer(b"".join(cut), dtype=np.uint8).reshape(-1, PARTS // 2)
    return np.concatenate([packed & 15, packed >> 4], axis=1)


def differing(cut: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """By how much the counts of the rows ``x`` and ``y`` differ."""
    out = np.zeros(len(x), dtype=np.int64)
    for low in range(0, len(x), COMPARED):
        a, b = (cut[i[low : low + COMPARED]] for i in (x, y))
        out[low : low + COMPARED] = (np.maximum(a, b) - np.minimum(a, b)).sum(axis=1, dtype=np.int64)
    return out


def bucket(h: np.ndarray) -> np.ndarray:
    """The bucket of each hash: its first 25 bits."""
    return (h >> np.uint64(39)).astype(np.int64)


def packed(counts: np.ndarray) -> bytes:
    """The buckets that have counts, as steps, and the counts."""
    at = np.flatnonzero(counts)
    return np.stack([np.diff(at, prepend=0).astype(np.uint32), counts[at]]).tobytes()


def numbered(docs: DataFrame) -> DataFrame:
    """(row, doc_id, text), stored: rows keep their numbers."""
    return materialize(docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text"), "numbered")


def described(stored: DataFrame, size: int) -> DataFrame:
    """Rows (row, doc_id, n, same) of the texts, and rows (part, counts) with each task's counts of a range of buckets, in a table."""
    schema = "row long, doc_id long, n int, same binary, part int, counts binary"
    names = ["row", "doc_id", "n", "same", "part", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        counts = np.zeros(BUCKETS, dtype=np.uint32)  # a task has fewer documents than that holds
        for batch in batches:
            for piece in parts(batch):
                sizes, digests = [], []
                for text in piece.column("text"):
                    h = shingle_set(text.as_py(), size)
                    sizes.append(len(h))
                    digests.append(xxhash.xxh3_128_digest(h.tobytes()))
                    np.add.at(counts, bucket(h), np.uint32(1))
                none = pa.nulls(piece.num_rows)
                columns = [piece.column("row"), piece.column("doc_id"), pa.array(sizes, pa.int32()), pa.array(digests, pa.binary()), none.cast(pa.int32()), none.cast(pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names)
        none = pa.nulls(RANGES)
        ranges = [packed(x) for x in np.split(counts, RANGES)]
        columns = [none.cast(pa.int64()), none.cast(pa.int64()), none.cast(pa.int32()), none.cast(pa.binary()), pa.array(range(RANGES), pa.int32()), pa.array(ranges, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names)
        release()

    return materialize(stored.select("row", "doc_id", "text").mapInArrow(run, schema), "described")


def bucket_counts(made: DataFrame) -> np.ndarray:
    """The counts of all tasks added up, in eighths of powers of two: ``BUCKETS`` bytes, on the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, counts in zip(batch.column("part").to_pylist(), batch.column("counts"), strict=True):
                sums.setdefault(part, np.zeros(BUCKETS // RANGES, dtype=np.uint64))
                at, new = np.frombuffer(counts.as_py(), dtype=np.uint32).reshape(2, -1)
                sums[part][np.cumsum(at, dtype=np.int64)] += new
        steps = [np.minimum(np.log2(x + 1.0) * 8, 255).astype(np.uint8).tobytes() for x in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(steps, pa.binary())], ["part", "counts"])

    added = made.where("part is not null").select("part", "counts").repartition(RANGES, "part").mapInArrow(run, "part int, counts binary")
    out = np.zeros((RANGES, BUCKETS // RANGES), dtype=np.uint8)
    for row in materialize(added, "counts").collect():  # RANGES rows, BUCKETS bytes in all
        out[row["part"]] = np.frombuffer(row["counts"], dtype=np.uint8)
    return out.reshape(-1)


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def prefixed(stored: DataFrame, counts: np.ndarray, size: int, percent: int) -> DataFrame:
    """(row, n, keys, parts): the size of each set, the n-grams of its prefix in order, and the counts of its parts."""
    sent = stored.sparkSession.sparkContext.broadcast(counts)  # BUCKETS bytes

    def work(texts: list[str | None]) -> list[list]:
        sizes, keys, cut = [], [], []
        for text in texts:
            h = shingle_set(text, size)
            order = np.lexsort((h, sent.value[bucket(h)]))
            keys.append(h[order[: prefix_length(len(h), percent)]].view(np.int64) if len(h) else np.zeros(0, dtype=np.int64))
            cut.append(parts_of(h))
            sizes.append(len(h))
        return [sizes, keys, cut]

    return with_made(stored.select("row", "text"), ["row"], "text", "n int, keys array<long>, parts binary", work)


def entries_of(made: DataFrame) -> DataFrame:
    """A row for each different set that isn't empty: ``rep``, the row of its smallest id, and ``head`` to compare by."""
    head = F.min(F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "row")).alias("head")
    rows = made.where("n > 0").groupBy("same").agg(head, F.first("n").alias("n"))
    return materialize(rows.select(F.col("head.row").alias("rep"), "head", "same", "n"), "entries")


def texts_of(stored: DataFrame, entries: DataFrame) -> DataFrame:
    """The stored rows that are an entry's ``rep``.

    Every task gets a bit for each row (4 KB for 32,768 rows of a partition) and reads its own texts:
    neither these nor what is made of them is shuffled to find each set's row.
    """
    at = F.bitmap_bit_position(F.col("rep") + 1).alias("at")
    marks = entries.select(F.bitmap_bucket_number(F.col("rep") + 1).alias("bucket"), at).groupBy("bucket").agg(F.bitmap_construct_agg("at").alias("marks"))
    rows = stored.withColumns({"bucket": F.bitmap_bucket_number(F.col("row") + 1), "at": F.bitmap_bit_position(F.col("row") + 1)})
    byte = "cast(conv(hex(substring(marks, cast(at div 8 as int) + 1, 1)), 16, 10) as int)"
    return rows.join(F.broadcast(marks), "bucket").where(f"(shiftright({byte}, cast(at % 8 as int)) & 1) = 1").select(*stored.columns)


def needed(n: Column, m: Column, percent: int) -> Column:
    """The least intersection of linked sets of these sizes."""
    return F.ceil(percent * (n.cast("long") + m) / (100 + percent))


def possible(x: str, y: str, percent: int) -> Column:
    """The length and positional filters, on (n, pos) of two entries of a list."""
    at = lambda side, c: F.col(f"{side}{c}")
    n, m, i, j = at(x, "n"), at(y, "n"), at(x, "pos"), at(y, "pos")
    most = F.least(i, j) + 1 + F.least(n - i - 1, m - j - 1)
    return (100 * F.least(n, m).cast("long") >= percent * F.greatest(n, m).cast("long")) & (most >= needed(n, m, percent))


def first_pairs(listed: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (u, v) of the smallest entry of each list with the others."""
    first = listed.groupBy("key").agg(F.min(F.struct("n", "rep", "pos")).alias("f")).select("key", *[F.col(f"f.{c}").alias(f"f_{c}") for c in ("n", "rep", "pos")])
    met = listed.join(first, "key").where("rep != f_rep").where(possible("", "f_", percent))
    return met.select(F.least("rep", "f_rep").alias("u"), F.greatest("rep", "f_rep").alias("v")).distinct()


def suffixed(pairs: DataFrame, index: DataFrame, percent: int) -> DataFrame:
    """The pairs that pass the suffix filter."""
    sides = pairs
    for side in ("u", "v"):
        sides = sides.join(index.select(F.col("rep").alias(side), F.col("n").alias(f"n_{side}"), F.col("parts").alias(f"p_{side}")), side)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cut = opened(batch.column("p_u").to_pylist() + batch.column("p_v").to_pylist())
                n = batch.column("n_u").to_numpy().astype(np.int64) + batch.column("n_v").to_numpy()
                at = np.arange(batch.num_rows)
                keep = differing(cut, at, at + batch.num_rows) <= may_differ(n, percent)
                yield batch.select(["u", "v"]).filter(pa.array(keep))

    return sides.select("u", "v", "n_u", "n_v", "p_u", "p_v").mapInArrow(judge, "u long, v long")


def may_differ(total: np.ndarray, percent: int) -> np.ndarray:
    """N-grams in one of two linked sets only, at most, by the sum of their sizes."""
    return total - 2 * -(-percent * total // (100 + percent))


def apart_pairs(listed: DataFrame, index: DataFrame, percent: int, every: bool) -> DataFrame:
    """Distinct pairs (u, v) of different components in the lists that aren't connected, past all filters.

    For each entry the likeliest of another component (by the counts of parts), or with ``every`` all.
    """
    tasks = int(listed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    known = index.select("rep", "component", "parts")
    named = listed.join(known.select("rep", "component"), "rep")
    apart = named.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("size")).where("low != high")
    blocks = F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks")
    rows = listed.join(apart.select("key", blocks), "key").join(known, "rep")
    rows = rows.withColumn("mine", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumns({"low": F.least("mine", "other"), "high": F.greatest("mine", "other")}).drop("other", "blocks")
    rows = rows.repartition(tasks, "key", "low", "high").sortWithinPartitions("key", "low", "high", "rep")
    unit = ("key", "low", "high")

    def pairs_of(t: pa.Table) -> pa.RecordBatch:
        """The pairs of whole units: each entry with the one a step further on, for all units at once."""
        rep, n, pos, component, mine, low, high, key = (t.column(c).to_numpy().astype(np.int64) for c in ("rep", "n", "pos", "component", "mine", "low", "high", "key"))
        begin = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])))
        size = np.diff(np.append(begin, len(key)))
        ends = np.repeat(begin + size, size)
        cut = opened(t.column("parts").to_pylist())
        at, found, others = np.arange(len(key)), [], []
        for step in range(1, int(size.max())):
            at = at[at + step < ends[at]]
            x, y = at, at + step
            may = (component[x] != component[y]) & ((low[x] == high[x]) | (mine[x] != mine[y])) & (100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y]))
            x, y = x[may], y[may]
            most = np.minimum(pos[x], pos[y]) + 1 + np.minimum(n[x] - pos[x], n[y] - pos[y]) - 1
            may = most >= -(-percent * (n[x] + n[y]) // (100 + percent))
            found.append(x[may])
            others.append(y[may])
        x, y = (np.concatenate([np.zeros(0, dtype=np.int64), *z]) for z in (found, others))
        differ = differing(cut, x, y)
        passed = differ <= may_differ(n[x] + n[y], percent)
        x, y, differ = x[passed], y[passed], differ[passed]
        if not every:
            x, y, differ = np.concatenate([x, y]), np.concatenate([y, x]), np.tile(differ, 2)
            order = np.lexsort((rep[y], differ, x))
            x, y = x[order], y[order]
            likeliest = np.append(True, x[1:] != x[:-1])[: len(x)]
            x, y = x[likeliest], y[likeliest]
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(rep[x], rep[y])), pa.array(np.maximum(rep[x], rep[y]))], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            # units end where the next begins; what is held is whole units up to the last beginning
            units = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in unit])
            begin = np.flatnonzero((units[:, 1:] != units[:, :-1]).any(axis=0)) + 1
            if held and tuple(units[:, 0]) != tuple(held[-1].column(c)[-1].as_py() for c in unit):
                begin = np.append(0, begin)
            low = 0
            for b in begin.tolist():
                held.append(batch.slice(low, b - low))
                low = b
                if sum(h.num_rows for h in held) >= TOGETHER:
                    yield pairs_of(pa.Table.from_batches(held).combine_chunks())
                    held = []
            held.append(batch.slice(low))
        if held:
            yield pairs_of(pa.Table.from_batches(held).combine_chunks())
        release()

    return rows.select(*unit, "rep", "n", "pos", "component", "mine", "parts").mapInArrow(run, "u long, v long").distinct()


def verified(stored: DataFrame, pairs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs whose sets link."""
    nodes = pairs.select(F.explode(F.array("u", "v")).alias("row")).distinct()
    texts = stored.select("row", "text").join(nodes, "row", "left_semi")
    sets = materialize(with_made(texts, ["row"], "text", "s binary", lambda held: [[shingle_set(t, size).tobytes() for t in held]]), "sets")

    def links(a: pa.Scalar, b: pa.Scalar) -> bool:
        x, y = (np.frombuffer(s.as_buffer(), dtype=np.uint64) for s in (a, b))
        shared = len(np.intersect1d(x, y, assume_unique=True))
        return 100 * shared >= percent * (len(x) + len(y) - shared)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in parts(batch):
                keep = [links(a, b) for a, b in zip(piece.column("su"), piece.column("sv"), strict=True)]
                yield piece.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))
        release()

    both = pairs.join(sets.select(F.col("row").alias("u"), F.col("s").alias("su")), "u").join(sets.select(F.col("row").alias("v"), F.col("s").alias("sv")), "v")
    return materialize(both.select("u", "v", "su", "sv").mapInArrow(judge, "u long, v long"), "links")


def similar_groups(docs: DataFrame, size: int = 4, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of (doc_id, text)."""
    with owned() as mine:
        stored = numbered(docs)
        both = described(stored, size)
        made = materialize(both.where("row is not null").select("row", "doc_id", "n", "same"), "sizes")
        counts = bucket_counts(both)
        mine.sweep(docs.sparkSession, stored, made)
    entries = entries_of(made)
    index = prefixed(texts_of(stored, entries), counts, size, percent).withColumnRenamed("row", "rep")
    index = materialize(index, "index")
    postings = index.select(F.posexplode("keys").alias("pos", "key"), "rep", "n")
    shared = postings.groupBy("key").count().where("count > 1").select("key")
    listed = materialize(postings.join(shared, "key"), "listed")

    tested = materialize(suffixed(first_pairs(listed, percent), index, percent), "pairs")
    links = verified(stored, tested, size, percent)
    joined = _joined(index, links)
    for every in (False, True):
        likely = materialize(apart_pairs(listed, joined, percent, every), "likely")
        if likely.isEmpty():
            break
        listed = listed.join(likely.select(F.explode(F.array("u", "v")).alias("rep")).distinct(), "rep", "left_semi")
        pairs = materialize(likely.join(tested, ["u", "v"], "left_anti"), "pairs")
        if pairs.isEmpty():
            continue
        more = verified(stored, pairs, size, percent)
        tested, links = tested.union(pairs), links.union(more)
        joined = _joined(index, links)
    heads = entries.join(joined.select("rep", "component"), "rep")
    least = heads.groupBy("component").agg(F.min("head")["doc_id"].alias("component_id"))
    whole = heads.select("same", "component").join(least, "component").select("same", "component_id", F.lit(True).alias("worded"))
    rows = made.join(whole, "same", "left")
    return rows.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("worded"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def _joined(index: DataFrame, links: DataFrame) -> DataFrame:
    """The entries with the component that links make of them."""
    found = index.select("rep", "n", "parts").join(components(links).withColumnRenamed("node", "rep"), "rep", "left")
    return materialize(found.withColumn("component", F.coalesce("component", "rep")), "connected")
