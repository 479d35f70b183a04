"""Near-duplicates by SimHash, through an inverted index on byte positions with count filtering.

Fingerprints of 64 bits link when at most ``distance`` bits differ.  Each differing bit spoils one
of the 8 bytes at most, so linked fingerprints agree in at least ``8 - distance`` byte positions:
the guaranteed minimum.  The index posts each distinct fingerprint under combinations of its
positional bytes.  Two that agree in t of 8 positions agree in ``width`` of the first
``8 - t + width`` positions, for any width up to t; so one posting for each choice of ``width``
among those positions finds every pair.  Within a posting list the shared positional bytes of
pairs are tallied, pairs below the minimum are dropped, and the rest are verified bit by bit.

How it scales.  Documents with equal fingerprints are one entry, with partial minima before the
shuffle, so copies cost nothing more.  ``width`` grows with the number of distinct fingerprints,
which holds the expected length of a posting list down.  A task compares its posting lists in
memory of its own size, and returns for each list a forest that connects what is linked: at most
one edge for each entry but the first.  Short lists are compared pair by pair; in a long list an
entry that was linked needs no second comparison, so a group of near copies costs one pass.

Edge cases.  A null or empty text has no words and fingerprint zero, linked like any other.
Fewer words than a shingle make one shingle of them all.  Fingerprints link by numbers of their
own, whatever the ids of their documents, so a document without an id connects others like any
other; a component is named by its smallest id, and is null only where all its ids are.  Ids are
whole numbers.  Repeated rows come back as often.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veridrift.llm.batches import with_made
from veridrift.llm.components import components
from veridrift.llm.scratch import materialize

SEED = 42
BYTES = 8


def fingerprints(texts: list[str | None], shingle: int) -> np.ndarray:
    """64-bit fingerprints (as signed integers): each bit is the majority over shingle hashes."""
    import xxhash

    one = xxhash.xxh64_intdigest
    out = np.zeros(len(texts), dtype=np.uint64)
    for at, text in enumerate(texts):
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not words:
            continue
        line = b" ".join(words)
        n = len(words)
        if n <= shingle:
            out[at] = one(line, SEED)
            continue
        view = memoryview(line)
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = np.concatenate(([0], ends[:-1]))
        cuts = zip(starts[: n - shingle + 1].tolist(), (ends[shingle - 1 :] - 1).tolist(), strict=True)
        hashes = np.array([one(view[a:b], SEED) for a, b in cuts], dtype="<u8")
        ones = np.zeros(64, dtype=np.int64)
        for low in range(0, len(hashes), 65536):
            part = hashes[low : low + 65536].view(np.uint8).reshape(-1, 8)
            ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        bits = np.packbits(2 * ones > len(hashes), bitorder="little")
        out[at] = bits.view("<u8")[0]
    return out.view(np.int64)


def with_fingerprint(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, fp) of every row."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return with_made(ids, ["doc_id"], "text", "fp long", lambda texts: [fingerprints(texts, shingle)])


def links_within(keys: np.ndarray, fps: np.ndarray, reps: np.ndarray, minimum: int, distance: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """A forest over the entries of each posting list (equal ``keys``, sorted) that link.

    Pairs are tallied by equal byte positions first, then verified by differing bits.
    """
    out = []
    n = len(keys)
    if n == 0:
        return out

    def verified(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        x = fps[i] ^ fps[j]
        tally = (x.view(np.uint8).reshape(-1, BYTES) == 0).sum(axis=1)
        keep = tally >= minimum
        keep[keep] = np.bitwise_count(x[keep]) <= distance
        return keep

    begin = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    size = np.diff(np.append(begin, n))
    # short lists, all at once: entry i against entry i + step of the same list
    short = size <= 32
    ends = np.repeat(begin + size, size)
    in_short = np.repeat(short, size)
    at = np.flatnonzero(in_short)
    for step in range(1, int(size[short].max(initial=1))):
        at = at[at + step < ends[at]]
        keep = verified(at, at + step)
        if keep.any():
            out.append((reps[at[keep]], reps[at[keep] + step]))
    for b, s in zip(begin[~short].tolist(), size[~short].tolist(), strict=True):
        out += long_list(fps[b : b + s], reps[b : b + s], minimum, distance)
    return out


def long_list(fps: np.ndarray, reps: np.ndarray, minimum: int, distance: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """The forest of one long posting list, by growing one component after the other.

    Each entry is compared once with those that no component has yet; one that has been linked
    is out of every later comparison, which makes large groups of near copies cheap and leaves
    no link between components out.
    """
    u, v = [], []
    left = np.arange(len(fps))
    while len(left):
        front, left = [left[0]], left[1:]
        while front and len(left):
            x = front.pop()
            y = fps[left] ^ fps[x]
            tally = (y.view(np.uint8).reshape(-1, BYTES) == 0).sum(axis=1)
            near = tally >= minimum
            near[near] = np.bitwise_count(y[near]) <= distance
            if near.any():
                got = left[near]
                left = left[~near]
                front += got.tolist()
                u.append(reps[got])
                v.append(np.full(len(got), reps[x]))
    return [(np.concatenate(u), np.concatenate(v))] if u else []


def width_for(distinct: int, minimum: int) -> int:
    """Positions in a posting's key: as few as keep the expected list length below about 16."""
    for width in range(1, minimum):
        if distinct <= 16 << (8 * width):
            return width
    return minimum


def link_edges(entries: DataFrame, distinct: int, distance: int) -> DataFrame:
    """Edges (u, v) between representatives whose fingerprints link; ``entries``: (fp, rep)."""
    minimum = BYTES - distance
    if minimum < 1:
        raise ValueError("byte positions need a distance below 8")
    width = width_for(distinct, minimum)
    chosen = list(combinations(range(BYTES - minimum + width), width))
    spark = entries.sparkSession
    # The postings of a list meet in a task; lists are hashed over many tasks of bounded size.
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), distinct * len(chosen) // 500_000)
    masks = [sum(0xFF << (8 * p) for p in c) for c in chosen]
    signed = [m - (1 << 64) if m >= 1 << 63 else m for m in masks]
    keys = F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m))) for i, m in enumerate(signed)])
    postings = entries.select(F.explode(keys).alias("key"), "fp", "rep").repartition(tasks, "key")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [(f["key"].to_numpy(), f["fp"].to_numpy(), f["rep"].to_numpy()) for f in frames]
        if not held:
            return
        key, fp, rep = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((rep, key))
        for u, v in links_within(key[order], fp[order].view(np.uint64), rep[order], minimum, distance):
            yield pd.DataFrame({"u": u, "v": v})

    return postings.mapInPandas(run, "u long, v long")


def near_duplicates(docs: DataFrame, shingle: int, distance: int) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of (doc_id, text)."""
    prints = materialize(with_fingerprint(docs, shingle), "fingerprints")
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    entries = materialize(least.withColumn("rep", F.monotonically_increasing_id()), "entries")
    edges = link_edges(entries.select("fp", "rep"), entries.count(), distance)
    joined = entries.join(components(edges).withColumnRenamed("node", "rep"), "rep", "left")
    grouped = joined.select("fp", "least", F.coalesce("component", "rep").alias("component"))
    named = grouped.groupBy("component").agg(F.min("least").alias("component_id"))
    whole = grouped.join(named, "component").select("fp", "component_id")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return prints.join(whole, "fp").select("doc_id", hexed.alias("fingerprint"), "component_id")
