"""Hard negatives of anchors by blocked dense products.

The anchors are dealt into waves of at most ``WAVE_BYTES``.  A wave is one float64 matrix, sent to
all tasks once (its size is fixed, so the broadcast doesn't grow with the data); each task holds it
against its rows, block by block, as one matrix product for each block.  The first pass keeps the
best ``positives`` rows of an anchor's own label, the second the best ``negatives`` rows of other
labels whose score lies in the window of each positive.  Both are kept by (score, id), which can be
merged: a task returns no more than its own best, and the best of all tasks are found by a ranked
window that Spark limits before the shuffle.

Scores are sums of whole numbers.  Products in float64 are exact below 2**53; a block whose
largest components could pass that is multiplied in whole numbers of any size instead, and a score
that isn't a long then raises ``OverflowError``, as Spark's own arithmetic would.

How it scales.  Rows are never shuffled but once, to be dealt evenly; a wave costs two reads of
them.  The work is anchors times rows, which the task is; no pairs leave a task but an anchor's
best.  Equal vectors in any number are ties, met in blocks of ``BLOCK`` rows.

Edge cases.  Rows with a null label, a null vector, or a null or non-finite component take no part.
Vectors of different length are compared as if the shorter ended in zeros.  Rows are told apart by
an inner number, not by their ids: of repeated rows each is an anchor, and a positive of the others.
A row without an id is no anchor; among equal scores it comes last.  Other columns are ignored.  An
empty table, or one without anchors, gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veridrift.llm.batches import release
from veridrift.llm.scratch import materialize

#: Bytes of the matrix of a wave of anchors; rows of a block; anchors of a block.
WAVE_BYTES, BLOCK, ANCHORS = 16 << 20, 2048, 1024
EXACT = float(1 << 53)
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def prepared(vectors: DataFrame, vec_id: Column, label: Column, vector: Column, anchor: Column) -> DataFrame:
    """(row, id, label, v, anchor) of the rows that take part, dealt evenly; ``v`` in whole numbers as doubles."""
    finite = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * 256).cast("double"))
    rows = vectors.where(label.isNotNull() & vector.isNotNull() & finite).select(
        vec_id.cast("long").alias("id"), label.cast("long").alias("label"), whole.alias("v"), F.coalesce(anchor, F.lit(False)).alias("anchor")
    )
    spark = vectors.sparkSession
    if rows.rdd.getNumPartitions() < spark.sparkContext.defaultParallelism:  # a small table in few files
        rows = rows.repartition(spark.sparkContext.defaultParallelism)
    return materialize(rows.withColumn("row", F.monotonically_increasing_id()), "vectors")


def matrix(v: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """A row for each list, padded with zeros to ``width``."""
    v = v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v
    sizes = np.asarray(v.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)
    flat = v.flatten().to_numpy(zero_copy_only=False)
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of all rows of ``a`` with all rows of ``b``, as longs, exactly."""
    most = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * max(1, a.shape[1])
    if most < EXACT:
        return (a @ b.T).astype(np.int64)
    whole = np.array([[int(x) for x in r] for r in a], dtype=object).reshape(a.shape) @ np.array([[int(x) for x in r] for r in b], dtype=object).reshape(b.shape).T
    if any(abs(x) >> 63 for x in whole.flat):
        raise OverflowError("a score isn't a long")
    return whole.astype(np.int64)


class Best:
    """The first ``k`` (score, id) of each slot, in the order of score down, id up; mergeable."""

    def __init__(self, k: int) -> None:
        self.k = k
        self.slot = self.score = self.id = self.none = np.zeros(0, dtype=np.int64)

    def floor(self, slots: int) -> np.ndarray:
        """The score that a newcomer must reach in each slot."""
        out = np.full(slots, np.iinfo(np.int64).min)
        full = np.bincount(self.slot, minlength=slots) >= self.k
        last = np.append(self.slot[1:] != self.slot[:-1], True)[: len(self.slot)]
        out[self.slot[last]] = self.score[last]
        out[~full] = np.iinfo(np.int64).min
        return out

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray, none: np.ndarray) -> None:
        slot, score, ids, none = (np.concatenate(x) for x in ((self.slot, slot), (self.score, score), (self.id, ids), (self.none, none)))
        order = np.lexsort((ids, none, -score, slot))
        slot = slot[order]
        begin = np.flatnonzero(np.append(True, slot[1:] != slot[:-1])) if len(slot) else slot
        place = np.arange(len(slot)) - np.repeat(begin, np.diff(np.append(begin, len(slot))))
        order = order[place < self.k]
        self.slot, self.score, self.id, self.none = slot[place < self.k], score[order], ids[order], none[order]

    def offer(self, may: np.ndarray, scores: np.ndarray, slots: np.ndarray, ids: np.ndarray, none: np.ndarray, total: int) -> None:
        """Rows of the block that ``may`` stand in the slots: a row of ``scores`` for each of ``slots``."""
        may = may & (scores >= self.floor(total)[slots][:, None])
        if may.sum() > 8 * self.k * max(1, len(slots)) and scores.shape[1] > self.k:  # raise the floor within the block first
            held = np.where(may, scores, np.iinfo(np.int64).min)
            cut = scores.shape[1] - self.k
            may &= scores >= np.partition(held, cut, axis=1)[:, cut][:, None]
        x, y = np.nonzero(may)
        if len(x):
            self.add(slots[x], scores[x, y], ids[y], none[y])


def best_rows(stored: DataFrame, sent, k: int) -> DataFrame:
    """(slot, score, id): the best of each task's rows for each slot of a wave.

    ``sent`` is the broadcast wave: its matrix, labels, row numbers, and windows (anchor, low, high)
    of rows with other labels; without windows, slots are the anchors and rows those of their label.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wave = sent.value
        anchors, windows = wave["v"], wave["windows"]
        total = len(anchors) if windows is None else len(windows[0])
        best = Best(k)
        for batch in batches:
            for low in range(0, batch.num_rows, BLOCK):
                part = batch.slice(low, BLOCK)
                label, row = (part.column(c).to_numpy(zero_copy_only=False) for c in ("label", "row"))
                none = np.asarray(part.column("id").is_null().to_numpy(zero_copy_only=False), dtype=np.int64)
                ids = part.column("id").fill_null(0).to_numpy(zero_copy_only=False)
                block = matrix(part.column("v"), anchors.shape[1])
                for a in range(0, len(anchors), ANCHORS):
                    own = np.arange(a, min(a + ANCHORS, len(anchors)))
                    if windows is None:
                        for name in np.intersect1d(wave["label"][own], label):
                            mine, there = own[wave["label"][own] == name], np.flatnonzero(label == name)
                            scores = products(anchors[mine], block[there])
                            best.offer(row[there] != wave["row"][mine][:, None], scores, mine, ids[there], none[there], total)
                        continue
                    scores = products(anchors[own], block)
                    other = label != wave["label"][own][:, None]
                    lows, highs = np.searchsorted(windows[0], [own[0], own[-1] + 1])
                    for nth in range(int(wave["most"])):  # the windows of an anchor, one after the other
                        slots = np.arange(lows, highs)[wave["nth"][lows:highs] == nth]
                        at = windows[0][slots] - a
                        mine = scores[at]
                        best.offer(other[at] & (mine >= windows[1][slots][:, None]) & (mine <= windows[2][slots][:, None]), mine, slots, ids, none, total)
        ids = pa.array(best.id, pa.int64(), mask=best.none.astype(bool))
        yield pa.RecordBatch.from_arrays([pa.array(best.slot, pa.int64()), pa.array(best.score, pa.int64()), ids], ["slot", "score", "id"])
        release()

    found = stored.select("row", "id", "label", "v").mapInArrow(run, "slot long, score long, id long")
    order = Window.partitionBy("slot").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(
    vectors: DataFrame, vec_id: Column, label: Column, vector: Column, anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    For each row where ``anchor`` holds, its first ``positives`` other rows of its label, and for
    each of those the first ``negatives`` rows of other labels with low * positive <= 100 * negative
    <= high * positive.  Components are floored after multiplying by 256.
    """
    spark = vectors.sparkSession
    stored = prepared(vectors, vec_id, label, vector, anchor)
    n, width = stored.agg(F.count_if("anchor"), F.max(F.size("v"))).first()
    width = max(1, width or 0)
    each = max(1, WAVE_BYTES // (8 * width))
    waves = -(-n // each)
    made = []
    for wave in range(waves):
        rows = stored.where(F.col("anchor") & (F.pmod(F.xxhash64("row"), F.lit(waves)) == wave)).toArrow()
        for begin in range(0, rows.num_rows, each):  # hashing deals unevenly; the bound holds
            made.append(_wave(stored, rows.slice(begin, each), width, positives, negatives, low, high))
    if not made:
        return spark.createDataFrame([], RESULT)
    return reduce(DataFrame.unionByName, made)


def _wave(stored: DataFrame, rows: pa.Table, width: int, positives: int, negatives: int, low: int, high: int) -> DataFrame:
    spark = stored.sparkSession
    own = {"v": matrix(rows.column("v"), width), "label": rows.column("label").to_numpy(), "row": rows.column("row").to_numpy(), "windows": None}
    first = best_rows(stored, spark.sparkContext.broadcast(own), positives).orderBy("slot", "rank").toArrow()  # ``positives`` of each anchor of a wave at most
    slot, score = first.column("slot").to_numpy(), first.column("score").to_numpy()
    starts = np.searchsorted(slot, slot)
    # whole numbers of any size: a bound times a score may pass a long
    lows = np.array([max(-(1 << 63), -(-low * int(s) // 100)) for s in score], dtype=np.int64)
    highs = np.array([min((1 << 63) - 1, high * int(s) // 100) for s in score], dtype=np.int64)
    own |= {"windows": (slot, lows, highs), "nth": np.arange(len(slot)) - starts, "most": positives}
    found = best_rows(stored, spark.sparkContext.broadcast(own), negatives)
    ids = rows.column("id").to_numpy()
    named = pa.table([pa.array(np.arange(len(slot))), pa.array(ids[slot]), first.column("id"), first.column("score")], ["slot", "anchor_id", "positive_id", "positive_score"])
    whose = spark.createDataFrame(named)
    out = found.join(F.broadcast(whose), "slot").select(  # bounded by the wave
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
    return materialize(out, "negatives")
