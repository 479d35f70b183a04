"""Groups of near-duplicates by shingle similarity: SimHash by byte positions, then bands of MinHash values.

First the index of ``simhash`` on byte positions, with count filtering, links SimHash fingerprints
of the sets that differ in at most ``DISTANCE`` of 64 bits, and what it links is verified by the
similarity of the sets of 64-bit shingle hashes.  It misses none within that distance, but texts
at the edge of the similarity lie further apart (at 0.8 some 10 of 64 bits differ).  So what these
links leave apart is sought by a second index, whose posting lists are keyed by a band: ``ROWS`` of the least values of the distinct word shingles of a
text under as many hash functions.  Texts whose shingle sets have a Jaccard similarity s share a
given band with a chance of s**ROWS, so at 0.8 none of ``BANDS`` with one of 0.59**24, 3 in a
million, whatever the lengths; others rarely meet, and unrelated ones never.  In a list, pairs
whose SimHash fingerprints of 128 bits differ in more than ``FAR`` are passed over (19 of them
differ on average at 0.8, 24 for the shortest texts, with deviations of 4), and what remains is
verified in the same way.

How it scales.  Equal shingle sets are one entry, with partial minima before the shuffle.  The first
index returns a forest for each of its lists.  In the second, first
each list, whatever its length, pairs its entries with that of the smallest number, where links don't connect them yet, so a large
group of near copies gives pairs in proportion to its members; this is an equi-join on the key,
which adaptive execution splits where a list has very many entries.  Then, in the lists whose
entries verified links don't connect, the pairs between different components follow, each in the
first list that has both.  They are compared in the tasks, by sketches of ``BITS`` bits that differ
in 10 % of them at 0.8 (``APART`` is five deviations more), and what can be similar is verified
there by its sets; a pair that links of the task connect by then is needless, so a task returns
fewer links than it has entries, and no pairs move.  A list of more than ``BLOCK`` entries is cut
into blocks, each pair of blocks a unit of work of its own, so no task holds more than two blocks.
So each pair of a list is verified, passed over or needless; the comparisons (not the rows) of a
list grow with its components times its entries.  Links are grouped by distributed connected components.  Texts are read
again only for documents in a candidate pair or in a list that isn't connected.

Edge cases.  Rows are told apart by an inner number: texts decide, not ids.  Texts without words
(null ones too) are copies of one another.  Fewer words than a shingle make one shingle.  Of a
group the row of the smallest id stays, one with a null id only where all are null, and of equal
ids the first row; so of repeated rows one stays, and different texts of one id are different
documents.  Empty tables stay empty; other columns pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridrift.llm.batches import parts, release, with_made
from veridrift.llm.components import components
from veridrift.llm.simhash import link_edges
from veridrift.llm.scratch import materialize, owned

SEED, WORDS = 42, 5
#: Bits of 64 in which fingerprints that the index on byte positions links may differ.
DISTANCE = 4
#: Bands and values in each; bits of 128 in which the fingerprints of a candidate pair may differ.
BANDS, ROWS, FAR = 24, 4, 48
#: Bits of the sketches of entries that aren't connected; bits that may differ; entries of a block.
BITS, APART, BLOCK = 2048, 273, 512
#: Odd factors: the hash functions of the least values, and how those of a band are joined.
FACTORS = np.random.default_rng(SEED).integers(0, 1 << 63, (BANDS + 1) * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BIT_FACTORS = np.random.default_rng(SEED + 1).integers(0, 1 << 63, BITS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None, size: int) -> np.ndarray:
    """Hashes of the distinct shingles of a text."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    line, n = b" ".join(words), len(words)
    if n <= size:
        return np.array([xxhash.xxh64_intdigest(line, SEED)], dtype=np.uint64)
    view = memoryview(line)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-1]))
    one = xxhash.xxh64_intdigest
    cuts = zip(starts[: n - size + 1].tolist(), (ends[size - 1 :] - 1).tolist(), strict=True)
    return np.unique(np.array([one(view[a:b], SEED) for a, b in cuts], dtype=np.uint64))


def second(h: np.ndarray) -> np.ndarray:
    """Another 64 bits from a hash."""
    h = h * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def majority(h: np.ndarray) -> int:
    ones = np.zeros(64, dtype=np.int64)
    for low in range(0, len(h), 65536):
        ones += np.unpackbits(h[low : low + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<i8")[0])


def bands(h: np.ndarray) -> np.ndarray:
    """The keys of a set's posting lists; none for an empty set."""
    if not len(h):
        return np.zeros(0, dtype=np.int64)
    parts = [(h[low : low + 2048, None] * FACTORS[: BANDS * ROWS]).min(axis=0) for low in range(0, len(h), 2048)]
    least = second(np.min(parts, axis=0)).reshape(BANDS, ROWS) * FACTORS[BANDS * ROWS :]
    return second(least.sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def sketch(h: np.ndarray) -> bytes:
    """One bit of the least value under each of ``BITS`` hash functions."""
    h = second(h)
    parts_ = [(h[low : low + 256, None] * BIT_FACTORS).min(axis=0) for low in range(0, len(h), 256)]
    return np.packbits((second(np.min(parts_, axis=0)) & np.uint64(1)).astype(bool)).tobytes()


def numbered(docs: DataFrame) -> DataFrame:
    """(doc, row): the documents with all their columns in one, and a number of each row."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")
    return materialize(docs.select(whole, F.monotonically_increasing_id().alias("row")), "numbered")


def with_prints(stored: DataFrame, size: int) -> DataFrame:
    """(row, doc_id, a, b, n, same, bands): fingerprint, size and digest of the set, and its keys."""

    def work(texts: list[str | None]) -> list[list]:
        import xxhash

        sets = [shingles(t, size) for t in texts]
        return [
            [majority(h) for h in sets],
            [majority(second(h)) for h in sets],
            [len(h) for h in sets],
            [xxhash.xxh3_128_digest(h.tobytes()) for h in sets],
            [bands(h) for h in sets],
        ]

    texts = stored.select("row", F.col("doc.doc_id").alias("doc_id"), F.col("doc.text").alias("text"))
    return with_made(texts, ["row", "doc_id"], "text", "a long, b long, n long, same binary, bands array<long>", work)


def entries_of(prints: DataFrame) -> DataFrame:
    """One row for each different set: ``rep``, the row of its smallest id, and ``head`` to compare by."""
    head = F.min(F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "row")).alias("head")
    made = prints.groupBy("same").agg(head, *[F.first(c).alias(c) for c in ("a", "b", "n", "bands")])
    return materialize(made.select(F.col("head.row").alias("rep"), "head", "same", "a", "b", "n", "bands"), "print-entries")


def close(x: str, y: str, similarity: float) -> Column:
    """Whether the sets of two entries can be similar: by their sizes, and by the bits that differ."""
    at = lambda side, c: F.col(f"{side}.{c}")
    differ = sum((F.bit_count(at(x, c).bitwiseXOR(at(y, c))) for c in ("a", "b")), F.lit(0))
    sizes = F.least(at(x, "n"), at(y, "n")) >= similarity * F.greatest(at(x, "n"), at(y, "n"))
    return sizes & (differ <= FAR)


def ordered(x: str, y: str) -> list[Column]:
    return [F.least(x, y).alias("u"), F.greatest(x, y).alias("v")]


def lists_of(postings: DataFrame, *more: Column) -> DataFrame:
    """The first entry of each list with two entries or more."""
    return postings.groupBy("key").agg(F.min("rep").alias("first"), F.count("*").alias("size"), *more).where("size > 1")


def indexed_pairs(entries: DataFrame) -> DataFrame:
    """Distinct pairs (u, v) that the index on byte positions links: a forest of each of its lists."""
    prints = materialize(entries.select(F.col("a").alias("fp"), "rep"), "fingerprints")
    edges = link_edges(prints, prints.count(), DISTANCE)
    return edges.select(*ordered("u", "v")).distinct()


def first_pairs(entries: DataFrame, similarity: float) -> DataFrame:
    """Distinct pairs (u, v) of the first entry of each list with those of another component."""
    postings = entries.select(F.explode("bands").alias("key"), "rep")
    met = postings.join(lists_of(postings).select("key", "first"), "key").where("rep != first").select("first", "rep").distinct()
    prints = entries.select("rep", "a", "b", "n", "component")
    sides = met.join(prints.alias("x"), F.col("first") == F.col("x.rep")).join(prints.alias("y"), met["rep"] == F.col("y.rep"))
    apart = F.col("x.component") != F.col("y.component")
    return sides.where(apart & close("x", "y", similarity)).select(*ordered("x.rep", "y.rep"))


def other_links(stored: DataFrame, entries: DataFrame, size: int, similarity: float) -> DataFrame:
    """Links (u, v) that join other entries of a list whose ``component`` differs."""
    tasks = int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    postings = entries.select(F.posexplode("bands").alias("band", "key"), "rep", "component")
    apart = lists_of(postings, F.min("component").alias("low"), F.max("component").alias("high")).where("low != high and size > 2")
    blocks = F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks")
    listed = materialize(postings.join(apart.select("key", "first", blocks), "key").where("rep != first").select("key", "band", "rep", "blocks"), "listed")
    nodes = listed.select(F.col("rep").alias("row")).distinct()
    texts = stored.select("row", F.col("doc.text").alias("text")).join(nodes, "row", "left_semi")

    def work(held: list[str | None]) -> list[list]:
        sets = [shingles(t, size) for t in held]
        return [[sketch(h) for h in sets], [h.tobytes() for h in sets]]

    sketched = with_made(texts, ["row"], "text", "sketch binary, s binary", work)
    known = entries.select("rep", "component", "n", "bands").join(sketched.withColumnRenamed("row", "rep"), "rep")
    known = materialize(known, "sketches")
    mine = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int").alias("mine")
    rows = listed.join(known, "rep").withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumn("low", F.least("mine", "other")).withColumn("high", F.greatest("mine", "other")).drop("other", "blocks")
    rows = rows.repartition(tasks, "key", "low", "high").sortWithinPartitions("key", "low", "high")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            for part in parts(batch):
                for row in part.to_pylist():
                    if held and any(held[0][c] != row[c] for c in ("key", "low", "high")):
                        yield links_between(held, similarity)
                        held = []
                    held.append(row)
        if held:
            yield links_between(held, similarity)
        release()

    return rows.mapInArrow(run, "u long, v long")


def similar(a: bytes, b: bytes, similarity: float) -> bool:
    n, m = len(a) // 8, len(b) // 8
    if min(n, m) < similarity * max(n, m):
        return False
    shared = len(np.intersect1d(np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8"), assume_unique=True))
    return shared >= similarity * (n + m - shared)


def links_between(rows: list[dict], similarity: float) -> pa.RecordBatch:
    """Links between entries in different components, of a block or of two, as far as they join
    what isn't joined yet.

    Entries of the largest component meet the others, never themselves; the likeliest pairs of an
    entry come first.
    """
    rep, component, n, mine = (np.array([r[c] for r in rows]) for c in ("rep", "component", "n", "mine"))
    band, low, high = rows[0]["band"], rows[0]["low"], rows[0]["high"]
    found: list[tuple[int, int]] = []
    names, members = np.unique(component, return_counts=True)
    main = names[members.argmax()]
    if len(names) > 1:
        sketches = np.frombuffer(b"".join(r["sketch"] for r in rows), dtype="<u8").reshape(len(rows), -1)
        earlier = np.array([r["bands"][:band] for r in rows], dtype=np.int64).reshape(len(rows), band)
        at, first = np.arange(len(rows)), component.copy()
        for x in np.flatnonzero(first != main):
            may = (component != component[x]) & ((first == main) | (at > x))
            may &= np.minimum(n, n[x]) >= similarity * np.maximum(n, n[x])
            if low != high:
                may &= mine != mine[x]
            y = np.flatnonzero(may)
            differ = np.bitwise_count(sketches[y] ^ sketches[x]).sum(axis=1)
            likely = differ <= APART
            y, differ = y[likely], differ[likely]
            y = y[np.argsort(differ, kind="stable")]
            y = y[~(earlier[y] == earlier[x]).any(axis=1)]  # such a pair belongs to another list
            for k in y.tolist():
                if component[k] != component[x] and similar(rows[x]["s"], rows[k]["s"], similarity):
                    found.append((min(rep[x], rep[k]), max(rep[x], rep[k])))
                    component[component == component[k]] = component[x]
    u, v = (np.array([f[i] for f in found], dtype=np.int64) for i in (0, 1))
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])


def verified(stored: DataFrame, pairs: DataFrame, size: int, similarity: float) -> DataFrame:
    """The pairs whose sets of shingles are similar."""
    nodes = materialize(pairs.select(F.explode(F.array("u", "v")).alias("row")).distinct(), "nodes")
    texts = stored.select("row", F.col("doc.text").alias("text")).join(nodes, "row", "left_semi")
    known = materialize(with_made(texts, ["row"], "text", "s binary", lambda held: [[shingles(t, size).tobytes() for t in held]]), "sets")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch):
                keep = [similar(a.as_py(), b.as_py(), similarity) for a, b in zip(part.column("su"), part.column("sv"), strict=True)]
                yield part.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))
        release()

    both = pairs.join(known.select(F.col("row").alias("u"), F.col("s").alias("su")), "u")
    both = both.join(known.select(F.col("row").alias("v"), F.col("s").alias("sv")), "v")
    return both.select("u", "v", "su", "sv").mapInArrow(judge, "u long, v long")


def grouped(stored: DataFrame, size: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """The prints of all rows, and the entries with ``component``, the smallest row of their group."""
    prints = materialize(with_prints(stored, size), "prints")
    entries = entries_of(prints)
    links = entries.select(F.col("rep").alias("u"), F.col("rep").alias("v")).limit(0)

    def joined(to: DataFrame) -> DataFrame:
        found = to.join(components(links).withColumnRenamed("node", "rep"), "rep", "left")
        return found.withColumn("component", F.coalesce("component", "rep"))

    connected = entries.withColumn("component", F.col("rep"))
    for step in (indexed_pairs, lambda e: first_pairs(e, similarity)):
        pairs = materialize(step(connected.where("n > 0")), "pairs")
        more = materialize(verified(stored, pairs, size, similarity), "links")
        if not more.isEmpty():
            links = links.union(more)
            connected = materialize(joined(entries), "connected")
    more = materialize(other_links(stored, connected.where("n > 0"), size, similarity), "links")
    if not more.isEmpty():
        links = links.union(more)
        connected = materialize(joined(entries), "connected")
    return prints, connected


def groups(docs: DataFrame, size: int = WORDS, similarity: float = 0.8) -> DataFrame:
    """(doc_id, component_id) of every row; the component is the group's smallest id."""
    prints, connected = grouped(numbered(docs), size, similarity)
    least = connected.groupBy("component").agg(F.min("head")["doc_id"].alias("component_id"))
    whole = connected.select("same", "component").join(least, "component")
    return prints.join(whole, "same").select("doc_id", "component_id")


def keep_one(docs: DataFrame, size: int = WORDS, similarity: float = 0.8) -> DataFrame:
    """One row of each group, that of the smallest id, with all its columns."""
    with owned() as mine:
        stored = numbered(docs)
        _, connected = grouped(stored, size, similarity)
        kept = materialize(connected.groupBy("component").agg(F.min("head")["row"].alias("row")).select("row"), "kept")
        one = stored.join(kept, "row", "left_semi").select("doc.*")
        mine.sweep(docs.sparkSession, one)
    return one
