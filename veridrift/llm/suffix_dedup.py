"""Removal of repeated byte strings across documents by hash-compared suffix sorting.

A byte goes if it lies in a string of ``length`` bytes that also starts in a document with a
smaller id.  Strings are judged on the input, and never cross documents.

Every string of ``length`` bytes has one minimizer: of the grams in it the one with the least
hash.  Equal strings have equal minimizers at equal places, so strings meet by the hash of the
minimizer, and neighbouring strings with one minimizer travel as one segment, a few dozen bytes.
Where segments meet, the suffixes that start in them are sorted: two are compared by prefix
polynomial hashes, with a binary search for their longest common extension, in a merge sort that
works on all groups at once.  Neighbours in that order whose common extension is as long as a
string (first: as whole segments of equal length) are one run, verified byte by byte, and what
stands in a larger document than the smallest of its run goes.  Whole segments that go are out
before single strings are sorted, so copies are cheap.

Stages:
1. Documents are packed into blocks as they are read, without a shuffle.
2. Each block names its minimizer hashes, once each; those of two blocks or more come back.
3. Each block sorts and sends segments of shared minimizers.  Of equal segments in a block only
   those of the smallest document are sent: the others are decided there, so a line or a text that
   stands in very many documents counts once for each block.
4. Where segments meet, the strings to go are named by block and place.
5. What is left of minimizers with very many segments meets once more, by strings.
6. Each block cuts them out.

How it scales.  Hashes and segments move as packed arrays, split by hash over as many tasks as
the input needs (``PART_BYTES`` of text for each); a task holds its own part only.  A minimizer of
more segments than ``hot_limit`` (of a passage that very many documents share, in contexts of their
own) is dealt over as many parts, by the bytes of its segments: equal ones meet, each part keeps the
strings of the smallest document of its runs, and these are dealt by their own hash, over as many
parts as all of them need.  A task takes one part, not several, and text comes to Python by ``BATCH_BYTES``.  So no task
sorts more than a bounded number of suffixes of one minimizer.  Equal strings have equal hashes, so
what has a hash of its own is left out of the sorting.  No pairs of documents are ever made.  Shuffle files go when the table of their stage is written, and tables
when the next stages don't read them.

Edge cases.  A null text has no bytes.  A null id is larger than every other, and equal ids (null
or repeated) are never smaller than one another, so repeated rows of one id don't remove each
other.  Texts under ``length`` bytes keep all.  An empty table gives an empty result.  Other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import contextlib
import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridrift.llm.scratch import materialize, owned

LENGTH, GRAM = 50, 20
#: Bytes of text in a block (a longer document is a block), and handled at once in it.
BLOCK_BYTES, CHUNK = 2 << 20, 1 << 18
#: Bytes of rows that come to Python at once (a larger row comes alone).
BATCH_BYTES = 16 << 20
#: How a table of blocks is written: Spark reads the rows of a row group at once, so these have a few blocks each.
BLOCK_ROWS = {"parquet.block.size": str(8 << 20), "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "4"}
#: Bytes of text whose hashes or segments one task handles.
PART_BYTES = 8 << 20
#: Bytes of segments that are sorted at once; a task takes its part in slices of the hash.
SLICE_BYTES = 2 << 20
#: Segments of one minimizer that are sorted in one place: so many, or one for each ``HOT_SHARE``
#: bytes of text up to ``MOST_HOT``, as strings of hot minimizers move one by one.
HOT, MOST_HOT, HOT_SHARE = 1 << 13, 1 << 16, 1 << 17
#: Parts of bytes that are compared at once.
COMPARED = 1 << 14
NO_ID = np.iinfo(np.int64).max
BASE = 0x9E3779B97F4A7C15 | 1

RESULT = "doc_id {id}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class Hashes:
    """Prefix polynomial hashes of a byte array; the hash of any part of it in constant time."""

    _forth = _powers(BASE, 1 << 16)
    _back = _powers(pow(BASE, -1, 1 << 64), 1 << 16)

    @classmethod
    def _grown(cls, n: int) -> None:
        if len(cls._forth) < n:
            size = 1 << (n - 1).bit_length()
            cls._forth, cls._back = _powers(BASE, size), _powers(pow(BASE, -1, 1 << 64), size)

    def __init__(self, data: np.ndarray):
        self._grown(len(data) + 1)
        self.prefix = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self._forth[: len(data)], dtype=np.uint64, out=self.prefix[1:])

    def part(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        return (self.prefix[start + length] - self.prefix[start]) * self._back[start]

    def all(self, length: int) -> np.ndarray:
        n = len(self.prefix) - length
        return (self.prefix[length:] - self.prefix[:n]) * self._back[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def segments(data: np.ndarray, ends: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, strings, minimizer) of each run of strings with one minimizer.

    ``ends``: where each document ends in ``data``.  A segment of s strings has
    ``s + length - 1`` bytes.  Minimizers are hashes of 40 bits; the rightmost is taken of equal ones.
    """
    starts, counts, keys = [], [], []
    for low in range(0, max(0, len(data) - length + 1), CHUNK):
        part = data[low : low + CHUNK + length - 1]
        h = mixed(Hashes(part).all(gram))
        x = (h >> np.uint64(24) << np.uint64(24)) | (np.uint64(0xFFFFFF) - np.arange(len(h), dtype=np.uint64))
        have, want = 1, length - gram + 1
        while 2 * have <= want:
            x = np.minimum(x[:-have], x[have:])
            have *= 2
        if have < want:
            x = np.minimum(x[: len(x) - (want - have)], x[want - have :])
        at = np.arange(low, low + len(x))
        inside = at + length <= ends[np.searchsorted(ends, at, side="right")]
        new = np.ones(len(x), dtype=bool)
        new[1:] = (x[1:] != x[:-1]) | ~inside[:-1]
        new &= inside
        last = np.ones(len(x), dtype=bool)
        last[:-1] = (x[1:] != x[:-1]) | ~inside[1:]
        last &= inside
        a, b = np.flatnonzero(new), np.flatnonzero(last)
        starts.append(at[a])
        counts.append(b - a + 1)
        keys.append(x[a] >> np.uint64(24))
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(starts), np.concatenate(counts), np.concatenate(keys)


def pack40(keys: np.ndarray) -> bytes:
    return keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def unpack40(blob: bytes) -> np.ndarray:
    out = np.zeros((len(blob) // 5, 8), dtype=np.uint8)
    out[:, :5] = np.frombuffer(blob, dtype=np.uint8).reshape(-1, 5)
    return out.view("<u8").ravel()


def equal_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether the parts at a and at b agree in ``length`` bytes."""
    out = np.ones(len(a), dtype=bool)
    for low in range(0, len(a), COMPARED):
        x, y, n = a[low : low + COMPARED], b[low : low + COMPARED], length[low : low + COMPARED]
        steps = np.arange(int(n.max(initial=0)))
        mask = steps < n[:, None]
        i, j = np.where(mask, x[:, None] + steps, 0), np.where(mask, y[:, None] + steps, 0)
        out[low : low + COMPARED] = ((data[i] == data[j]) | ~mask).all(axis=1)
    return out


def gathered(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The parts of ``data``, one after the other."""
    out = [np.zeros(0, dtype=np.uint8)]
    for low in range(0, len(start), COMPARED):
        x, n = start[low : low + COMPARED], length[low : low + COMPARED]
        steps = np.arange(int(n.max()))
        mask = steps < n[:, None]
        out.append(data[np.where(mask, x[:, None] + steps, 0)[mask]])
    return np.concatenate(out)


def common_extension(h: Hashes, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Length of the longest common extension of the suffixes at a and b, by binary search where
    they differ at all."""
    out = most.copy()
    differ = np.flatnonzero(h.part(a, most) != h.part(b, most))
    a, b, high = a[differ], b[differ], most[differ] - 1
    low = np.zeros(len(differ), dtype=np.int64)
    while True:
        at = np.flatnonzero(low < high)
        if not len(at):
            break
        middle = (low[at] + high[at] + 1) >> 1
        same = h.part(a[at], middle) == h.part(b[at], middle)
        low[at] = np.where(same, middle, low[at])
        high[at] = np.where(same, high[at], middle - 1)
    out[differ] = low
    return out


def first_bytes(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The first eight bytes of each suffix as a number in their order, shorter ones with zeros."""
    out = np.zeros(len(start), dtype=np.uint64)
    for k in range(8):
        out = (out << np.uint64(8)) | np.where(k < length, data[np.minimum(start + k, len(data) - 1)], 0).astype(np.uint64)
    return out


def suffix_order(data: np.ndarray, start: np.ndarray, length: np.ndarray, group: np.ndarray, h: Hashes | None = None) -> np.ndarray:
    """The order of suffixes (of bounded length) by group, then bytes: a merge sort, of all that agree
    in group and first bytes at once, whose comparisons go by the longest common extension."""
    h = h or Hashes(data)
    if not len(start):
        return np.zeros(0, dtype=np.int64)
    prefix = first_bytes(data, start, length)
    order = np.lexsort((prefix, group))
    g, p = group[order], prefix[order]
    first = np.flatnonzero(np.concatenate(([True], (g[1:] != g[:-1]) | (p[1:] != p[:-1]))))
    size = np.diff(np.append(first, len(order)))
    base, total = np.repeat(first, size), np.repeat(size, size)
    width = 1

    def before(a: np.ndarray, b: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
        most = np.minimum(length[a], length[b])
        l = common_extension(h, start[a], start[b], most)  # noqa: E741
        whole = l == most
        x = data[np.minimum(start[a] + l, len(data) - 1)].astype(np.int64)
        y = data[np.minimum(start[b] + l, len(data) - 1)].astype(np.int64)
        shorter, equal = length[a] < length[b], length[a] == length[b]
        return np.where(whole, shorter | (equal & or_equal), x < y)

    while width < int(size.max(initial=0)):
        live = np.flatnonzero(total > width)
        inside = live - base[live]
        run = inside // width
        low = base[live] + (run ^ 1) * width
        end = base[live] + total[live]
        high = np.minimum(low + width, end)
        low = np.minimum(low, end)
        left, right = low.copy(), high
        odd = run % 2 == 1
        while True:
            open_ = np.flatnonzero(left < right)
            if not len(open_):
                break
            middle = (left[open_] + right[open_]) >> 1
            # elements of the earlier run stand before equal ones of the later run
            goes = before(order[middle], order[live[open_]], odd[open_])
            left[open_] = np.where(goes, middle + 1, left[open_])
            right[open_] = np.where(goes, right[open_], middle)
        place = base[live] + (run // 2) * 2 * width + (inside - run * width) + (left - low)
        new = order.copy()
        new[place] = order[live]
        order = new
        width *= 2
    return order


def equal_runs(data: np.ndarray, start: np.ndarray, length: np.ndarray, group: np.ndarray, h: Hashes) -> tuple[np.ndarray, np.ndarray]:
    """(order, run): the suffix order, and along it the number of each run of equal ones.

    Neighbours are equal if their longest common extension is all of both.  If the bytes say
    otherwise, hashes have collided, and the bytes themselves are sorted.
    """
    order = suffix_order(data, start, length, group, h)
    if not len(order):
        return order, order
    a, b = order[:-1], order[1:]
    same = (group[a] == group[b]) & (length[a] == length[b])
    x, y = a[same], b[same]
    same[same] = common_extension(h, start[x], start[y], length[x]) == length[x]
    x, y = a[same], b[same]
    if not equal_bytes(data, start[x], start[y], length[x]).all():
        texts = [data[i : i + n].tobytes() for i, n in zip(start.tolist(), length.tolist(), strict=True)]
        order = np.array(sorted(range(len(start)), key=lambda i: (group[i], texts[i])))
        same = np.array([group[i] == group[j] and texts[i] == texts[j] for i, j in zip(order[:-1], order[1:], strict=True)], dtype=bool)
    return order, np.concatenate(([0], np.cumsum(~same)))


def later(order: np.ndarray, run: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which ones stand in a larger document than the smallest of their run."""
    out = np.zeros(len(doc), dtype=bool)
    if len(order):
        least = np.full(run[-1] + 1, NO_ID)
        np.minimum.at(least, run, doc[order])
        out[order] = doc[order] > least[run]
    return out


def minimizer_places(h: Hashes, start: np.ndarray, nbytes: np.ndarray, key: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """Where in each segment its minimizer starts: the last of its grams with that hash."""
    if not len(start):
        return np.zeros(0, dtype=np.int64)
    grams = nbytes - gram + 1
    seg = np.repeat(np.arange(len(start)), grams)
    first = np.cumsum(grams) - grams
    place = np.arange(len(seg)) - first[seg]
    values = mixed(h.part(start[seg] + place, gram)) >> np.uint64(24)
    return np.maximum.reduceat(np.where(values == key[seg], place, -1), first)


def numbered_groups(*columns: np.ndarray) -> np.ndarray:
    """A number for each different row of the columns."""
    out = np.zeros(len(columns[0]), dtype=np.int64)
    for c in columns:
        _, n = np.unique(c, return_inverse=True)
        out = out * (int(n.max(initial=0)) + 1) + n
    return out


def repeats(values: np.ndarray) -> np.ndarray:
    """Which values there are twice or more."""
    order = np.argsort(values, kind="stable")
    same = values[order[1:]] == values[order[:-1]]
    out = np.zeros(len(values), dtype=bool)
    out[order] = np.append(same, False) | np.append(False, same) if len(values) else False
    return out


def repeated(data: np.ndarray, start: np.ndarray, strings: np.ndarray, key: np.ndarray, doc: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(whole, cells): segments to go as a whole, and (segment, string) of single strings to go.

    ``cells`` is an array of pairs.
    """
    n = len(start)
    whole = np.zeros(n, dtype=bool)
    none = np.zeros((0, 2), dtype=np.int64)
    if not n:
        return whole, none
    h = Hashes(data)
    nbytes = strings + length - 1
    at = np.flatnonzero(repeats(h.part(start, nbytes)))
    whole[at] = later(*equal_runs(data, start[at], nbytes[at], numbered_groups(key[at]), h), doc[at])

    # what is left, where a minimizer has it in two documents or more
    rest = np.flatnonzero(~whole)
    names, inverse = np.unique(key[rest], return_inverse=True)
    low, high = np.full(len(names), NO_ID), np.full(len(names), -NO_ID)
    np.minimum.at(low, inverse, doc[rest])
    np.maximum.at(high, inverse, doc[rest])
    rest = rest[(low < high)[inverse]]
    if not len(rest):
        return whole, none
    seg = np.repeat(rest, strings[rest])
    string = np.arange(len(seg)) - np.repeat(np.cumsum(strings[rest]) - strings[rest], strings[rest])
    at = np.flatnonzero(repeats(h.part(start[seg] + string, length)))
    seg, string = seg[at], string[at]
    place = np.zeros(n, dtype=np.int64)
    used = np.unique(seg)
    place[used] = minimizer_places(h, start[used], nbytes[used], key[used])
    group = numbered_groups(key[seg], place[seg] - string)
    goes = later(*equal_runs(data, start[seg] + string, np.full(len(seg), length), group, h), doc[seg])
    return whole, np.stack([seg[goes], string[goes]], axis=1)


BLOCKS = "block long, ids binary, sizes binary, data binary"
SENT = "part int, block long, keys binary, docs binary, places binary, strings binary, data binary, hot boolean"
MET = "block long, cuts binary, part int, owners binary, docs binary, places binary, data binary"


def make_blocks(docs: DataFrame) -> DataFrame:
    """Documents in blocks: ids, sizes (the complement for a null id) and the bytes of their texts one after the other."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = TaskContext.get().partitionId() << 32
        ids: list[int] = []
        texts: list[bytes] = []
        none: list[bool] = []
        held = 0

        def block() -> pd.DataFrame:
            size = np.array([len(t) for t in texts], dtype="<i8")
            row = (number, np.array(ids, dtype="<i8").tobytes(), np.where(none, ~size, size).tobytes(), b"".join(texts))
            none.clear()
            ids.clear()
            texts.clear()
            return pd.DataFrame([row], columns=["block", "ids", "sizes", "data"])

        for pdf in frames:
            for doc_id, without, text in zip(pdf["doc_id"], pdf["without"], pdf["text"], strict=True):
                ids.append(int(doc_id))
                none.append(bool(without))
                texts.append((text or "").encode("utf-8", "surrogatepass"))
                held += len(texts[-1])
                if held >= BLOCK_BYTES:
                    yield block()
                    number, held = number + 1, 0
        if ids:
            yield block()

    id_ = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id")
    return docs.select(id_, F.col("doc_id").isNull().alias("without"), "text").mapInPandas(run, BLOCKS)


def _opened(ids: bytes, sizes: bytes, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    size = np.frombuffer(sizes, dtype="<i8")
    return np.frombuffer(ids, dtype="<i8"), np.cumsum(np.where(size < 0, ~size, size)), np.frombuffer(data, dtype=np.uint8)


def _split(part: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each part number and the places that have it."""
    order = np.argsort(part, kind="stable")
    edges = np.flatnonzero(np.diff(part[order])) + 1
    for places in np.split(order, edges):
        if len(places):
            yield int(part[places[0]]), places


def _edges(values: np.ndarray) -> list[tuple[int, int]]:
    """Where each run of equal values begins and ends."""
    edge = np.flatnonzero(np.append(np.append(True, values[1:] != values[:-1]), True)).tolist() if len(values) else []
    return list(zip(edge[:-1], edge[1:], strict=True))


def hot_limit(total: int) -> int:
    """Segments of one minimizer that are sorted in one place, for so many bytes of text."""
    return max(HOT, min(MOST_HOT, total // HOT_SHARE))


def string_parts(sent: DataFrame) -> int:
    """Parts that the strings of all hot segments need, were none of them decided before."""
    segments_ = sent.where("hot").agg(F.sum(F.length("strings"))).first()[0] or 0
    return -(-segments_ * (LENGTH - GRAM + 1) * (LENGTH + 20) // PART_BYTES)


def shared_keys(blocks: DataFrame, parts: int, limit: int | None = None) -> DataFrame:
    """(block, keys, hot): minimizer hashes of each block that another block has too, and of those with
    more than ``limit`` segments in all the number of parts to deal them over."""
    limit = limit or HOT

    def name(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for block, ids, sizes, data in zip(pdf["block"], pdf["ids"], pdf["sizes"], pdf["data"], strict=True):
                _, ends, array = _opened(ids, sizes, data)
                keys, count = np.unique(segments(array, ends)[2], return_counts=True)
                count = np.minimum(count, 65535).astype("<u2")
                part = (keys % np.uint64(parts)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                # packed once and cut: there are as many rows as parts
                part, k, c = part[order], pack40(keys[order]), count[order].tobytes()
                rows = [(int(part[a]), block, k[5 * a : 5 * b], c[2 * a : 2 * b]) for a, b in _edges(part)]
                yield pd.DataFrame(rows, columns=["part", "block", "keys", "counts"])

    def meet(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        blocks, blobs, counts = [], [], []
        for pdf in frames:
            blocks += pdf["block"].tolist()
            blobs += pdf["keys"].tolist()
            counts += pdf["counts"].tolist()
        if not blobs:
            return
        keys, count = unpack40(b"".join(blobs)), np.frombuffer(b"".join(counts), dtype="<u2").astype(np.int64)
        owner = np.repeat(np.arange(len(blobs)), [len(b) // 5 for b in blobs])
        order = np.argsort(keys, kind="stable")
        k = keys[order]
        first = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
        size = np.diff(np.append(first, len(k)))
        found, ways = np.zeros(len(keys), dtype=bool), np.zeros(len(keys), dtype=np.int64)
        found[order] = np.repeat(size > 1, size)
        ways[order] = np.repeat(-(-np.add.reduceat(count[order], first) // limit), size)
        owner, keys, ways = owner[found], keys[found], ways[found]
        k, at_hot = pack40(keys), np.flatnonzero(ways > 1)
        hot = np.stack([keys[at_hot].astype("<i8"), ways[at_hot]], axis=1).tobytes()
        upto = np.append(0, np.cumsum(ways > 1))
        rows = [(blocks[owner[a]], k[5 * a : 5 * b], hot[16 * upto[a] : 16 * upto[b]]) for a, b in _edges(owner)]
        yield pd.DataFrame(rows, columns=["block", "keys", "hot"])

    named = blocks.mapInPandas(name, "part int, block long, keys binary, counts binary")
    return named.repartitionById(parts, "part").mapInPandas(meet, "block long, keys binary, hot binary")


def with_side(blocks: DataFrame, side: DataFrame, columns: tuple[str, ...], parts: int) -> DataFrame:
    """Blocks and what else is known of them (in the first columns), together: the rows of ``side`` come before a block's own."""
    empty = F.lit(None).cast("binary")
    held = [F.col(c) for c in columns] + [empty] * (3 - len(columns))
    a = side.select("block", F.lit(0).alias("kind"), *[x.alias(c) for x, c in zip(held, ("ids", "sizes", "data"), strict=True)])
    b = blocks.select("block", F.lit(1).alias("kind"), "ids", "sizes", "data")
    return a.union(b).repartition(parts, "block").sortWithinPartitions("block", "kind")


def send_segments(blocks: DataFrame, keys: DataFrame, parts: int) -> DataFrame:
    """Segments of shared minimizers by part; and, as part -1, what a block decides by itself."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split(" ")[0] for x in SENT.split(", ")]
        known: list[bytes] = []
        hot: list[bytes] = []
        for pdf in frames:
            for block, kind, ids, sizes, data in zip(pdf["block"], pdf["kind"], pdf["ids"], pdf["sizes"], pdf["data"], strict=True):
                if kind == 0:
                    known.append(ids)
                    hot.append(sizes)
                    continue
                rows = one_block(block, known, *_opened(ids, sizes, data), parts, hot)
                known, hot = [], []
                yield pd.DataFrame(rows, columns=names)

    return with_side(blocks, keys, ("keys", "hot"), parts).mapInPandas(run, SENT)


def one_block(block: int, known: list[bytes], ids: np.ndarray, ends: np.ndarray, data: np.ndarray, parts: int, hot: Sequence[bytes] = ()) -> list[tuple]:
    start, strings, key = segments(data, ends)
    if not len(start):
        return []
    doc = ids[np.searchsorted(ends, start, side="right")]
    shared = np.unique(unpack40(b"".join(known)))
    names, inverse = np.unique(key, return_inverse=True)
    low, high = np.full(len(names), NO_ID), np.full(len(names), -NO_ID)
    np.minimum.at(low, inverse, doc)
    np.maximum.at(high, inverse, doc)
    place = np.searchsorted(shared, names)
    outside = np.zeros(len(names), dtype=bool)
    ok = place < len(shared)
    outside[ok] = shared[place[ok]] == names[ok]
    use = np.flatnonzero((outside | (low < high))[inverse])
    start, strings, key, doc = start[use], strings[use], key[use], doc[use]
    if not len(start):
        return []
    # equal segments in the block: all but those of the smallest document are decided here
    nbytes = strings + LENGTH - 1
    h = Hashes(data)
    digest = h.part(start, nbytes)
    at = np.flatnonzero(repeats(digest))
    gone = at[later(*equal_runs(data, start[at], nbytes[at], numbered_groups(key[at]), h), doc[at])]
    rows: list[tuple] = []
    if len(gone):
        rows.append((-1, block, None, None, start[gone].astype("<i4").tobytes(), strings[gone].astype("<i4").tobytes(), None, False))
    stay = np.ones(len(start), dtype=bool)
    stay[gone] = False
    left = np.flatnonzero(stay)
    # a hot minimizer is dealt over several parts, by the bytes of its segments
    pairs = np.frombuffer(b"".join(hot), dtype="<i8").reshape(-1, 2)
    pairs = pairs[np.argsort(pairs[:, 0])]
    names = pairs[:, 0].astype(np.uint64)
    place = np.minimum(np.searchsorted(names, key[left]), max(0, len(names) - 1))
    is_hot = names[place] == key[left] if len(names) else np.zeros(len(left), dtype=bool)
    dealt = key[left].copy()
    dealt[is_hot] += mixed(digest[left][is_hot]) % pairs[place[is_hot], 1].astype(np.uint64)
    code = (dealt % np.uint64(parts)).astype(np.int64) * 2 + is_hot
    order = np.argsort(code, kind="stable")
    code, i = code[order], left[order]
    k, d, at, n = pack40(key[i]), doc[i].astype("<i8").tobytes(), start[i].astype("<i4").tobytes(), strings[i].astype("u1").tobytes()
    content, upto = gathered(data, start[i], nbytes[i]).tobytes(), np.append(0, np.cumsum(nbytes[i])).tolist()
    for a, b in _edges(code):
        rows.append((int(code[a] // 2), block, k[5 * a : 5 * b], d[8 * a : 8 * b], at[4 * a : 4 * b], n[a:b], content[upto[a] : upto[b]], bool(code[a] % 2)))
    return rows


def _held(frames: Iterator[pd.DataFrame], columns: tuple[str, ...]) -> dict[str, list]:
    """All values of the columns."""
    held: dict[str, list] = {c: [] for c in columns}
    for pdf in frames:
        for c in columns:
            held[c] += pdf[c].tolist()
    return held


def _cuts(block: np.ndarray, at: np.ndarray, count: np.ndarray) -> list[tuple[int, bytes]]:
    """(block, cuts) of runs (start, strings)."""
    return [(int(block[k[0]]), np.stack([at[k], count[k]], axis=1).astype("<i4").tobytes()) for _, k in _split(block)]


def decide(sent: DataFrame, parts: int) -> DataFrame:
    """The columns of ``MET``: in ``cuts`` runs (start, strings) of strings to go, from all segments of a
    part; and, with one of ``parts`` others by their hash, the other strings of hot minimizers."""
    names = [x.split(" ")[0] for x in MET.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = _held(frames, ("block", "keys", "docs", "places", "strings", "data", "hot"))
        if not held["block"]:
            return
        count = [len(x) for x in held["strings"]]
        owner, hot = np.repeat(np.array(held["block"], dtype=np.int64), count), np.repeat(np.array(held["hot"], dtype=bool), count)
        take = lambda c, kind: np.frombuffer(b"".join(held.pop(c)), dtype=kind)
        key = unpack40(b"".join(held.pop("keys")))
        doc, place, strings, data = take("docs", "<i8"), take("places", "<i4"), take("strings", "u1"), take("data", np.uint8)
        nbytes = strings.astype(np.int64) + LENGTH - 1
        start = np.cumsum(nbytes) - nbytes
        slices = -(-len(data) // SLICE_BYTES)
        of_slice = (mixed(key) % np.uint64(max(1, slices))).astype(np.int64) * 2 + hot
        for number, i in _split(of_slice):
            mine = gathered(data, start[i], nbytes[i])
            n = nbytes[i]
            begin, s = np.cumsum(n) - n, strings[i].astype(np.int64)
            whole, cells = repeated(mine, begin, s, key[i], doc[i])
            w = np.flatnonzero(whole)
            who = np.concatenate([owner[i][w], owner[i][cells[:, 0]]])
            at = np.concatenate([place[i][w], place[i][cells[:, 0]] + cells[:, 1]])
            many = np.concatenate([s[w], np.ones(len(cells), dtype=np.int64)])
            yield pd.DataFrame([(*x, None, None, None, None, None) for x in _cuts(who, at, many)], columns=names)
            if number % 2 == 0:
                continue
            # the strings that stay here, each by itself
            first = np.cumsum(s) - s
            stay = np.repeat(~whole, s)
            stay[first[cells[:, 0]] + cells[:, 1]] = False
            seg = np.repeat(np.arange(len(s)), s)
            x = np.flatnonzero(stay)
            string, seg = x - first[seg[x]], seg[x]
            digest = mixed(Hashes(mine).part(begin[seg] + string, LENGTH))
            out = []
            for p, k in _split((digest % np.uint64(parts)).astype(np.int64)):
                o, t = i[seg[k]], string[k]
                texts = gathered(mine, begin[seg[k]] + t, np.full(len(k), LENGTH)).tobytes()
                out.append((None, None, p, owner[o].astype("<i8").tobytes(), doc[o].astype("<i8").tobytes(), (place[o] + t).astype("<i4").tobytes(), texts))
            yield pd.DataFrame(out, columns=names).astype({"part": "Int32"})

    return sent.mapInPandas(run, MET)


def decide_strings(met: DataFrame) -> DataFrame:
    """(block, cuts): runs of strings to go, from the single strings of a part."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = _held(frames, ("owners", "docs", "places", "data"))
        if not held["docs"]:
            return
        take = lambda c, kind: np.frombuffer(b"".join(held.pop(c)), dtype=kind)
        owner, doc, place, data = take("owners", "<i8"), take("docs", "<i8"), take("places", "<i4"), take("data", np.uint8)
        eight = data.reshape(-1, LENGTH)[:, :48].copy().view("<u8")
        of_slice = np.bitwise_xor.reduce(mixed(eight.ravel()).reshape(eight.shape), axis=1) % np.uint64(-(-len(data) // SLICE_BYTES))
        for _, i in _split(of_slice.astype(np.int64)):
            size = np.full(len(i), LENGTH)
            mine, begin = gathered(data, i * LENGTH, size), np.arange(len(i)) * LENGTH
            h = Hashes(mine)
            digest = h.part(begin, LENGTH)
            at = np.flatnonzero(repeats(digest))
            goes = i[at[later(*equal_runs(mine, begin[at], size[at], numbered_groups(digest[at]), h), doc[i[at]])]]
            yield pd.DataFrame(_cuts(owner[goes], place[goes], np.ones(len(goes), dtype=np.int64)), columns=["block", "cuts"])

    return met.mapInPandas(run, "block long, cuts binary")


def cut_out(blocks: DataFrame, cuts: DataFrame, parts: int, id_type: str) -> DataFrame:
    """The result rows of every document, from its block and the runs of strings to go."""
    names = [x.split(" ")[0] for x in RESULT.split(", ")]

    def rows_of(ids: np.ndarray, ends: np.ndarray, data: np.ndarray, known: list[bytes]) -> list[tuple]:
        runs = np.frombuffer(b"".join(known), dtype="<i4").reshape(-1, 2).astype(np.int64)
        edge = np.zeros(len(data) + 1, dtype=np.int32)
        np.add.at(edge, runs[:, 0], 1)
        np.add.at(edge, runs[:, 0] + runs[:, 1] + LENGTH - 1, -1)
        gone = np.cumsum(edge)[:-1] > 0
        out, low = [], 0
        for doc_id, end in zip(ids.tolist(), ends.tolist(), strict=True):
            mask = gone[low:end]
            n = int(mask.sum())
            spans = int(mask[0]) + int((mask[1:] & ~mask[:-1]).sum()) if n else 0
            kept = data[low:end][~mask] if n else data[low:end]
            out.append((doc_id, end - low, n, spans, hashlib.sha256(kept.tobytes()).hexdigest()))
            low = end
        return out

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: list[bytes] = []
        for pdf in frames:
            for kind, ids, sizes, data in zip(pdf["kind"], pdf["ids"], pdf["sizes"], pdf["data"], strict=True):
                if kind == 0:
                    known.append(ids)
                    continue
                made = pd.DataFrame(rows_of(*_opened(ids, sizes, data), known), columns=names)
                known = []
                made["without"] = np.frombuffer(sizes, dtype="<i8") < 0
                yield made

    made = with_side(blocks, cuts, ("cuts",), parts).mapInPandas(run, RESULT.format(id="long") + ", without boolean")
    return made.withColumn("doc_id", F.when(~F.col("without"), F.col("doc_id")).cast(id_type)).drop("without")


@contextlib.contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """Rows come to Python by ``BATCH_BYTES`` (10,000 blocks of text would be 20 GB), in what is written inside."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def deduplicate(docs: DataFrame) -> DataFrame:
    """Bytes removed and kept of every row of (doc_id, text); the columns of ``RESULT``."""
    spark = docs.sparkSession
    with owned() as mine, _small_batches(spark):
        blocks = materialize(make_blocks(docs), "blocks", BLOCK_ROWS)
        total = blocks.agg(F.sum(F.length("data"))).first()[0] or 0
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // PART_BYTES))
        keys = materialize(shared_keys(blocks, parts, hot_limit(total)), "keys")
        # Part -1, which a block decided by itself, goes on as it is.
        sent = materialize(send_segments(blocks, keys, parts), "segments")
        own = sent.where("part = -1").select("block", own_cuts("places", "strings").alias("cuts"))
        more = max(parts, string_parts(sent))
        met = materialize(decide(sent.where("part >= 0").repartitionById(parts, "part"), more), "met")
        left = decide_strings(met.where("part is not null").select("part", "owners", "docs", "places", "data").repartitionById(more, "part"))
        cuts = materialize(met.where("part is null").select("block", "cuts").union(own).union(left), "cuts")
        mine.sweep(spark, blocks, cuts)
    return cut_out(blocks, cuts, parts, docs.schema["doc_id"].dataType.simpleString())


def own_cuts(places: str, strings: str):
    """Two packed columns of starts and counts as one of pairs."""

    @F.pandas_udf("binary")
    def paired(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([np.stack([np.frombuffer(x, "<i4"), np.frombuffer(y, "<i4")], axis=1).tobytes() for x, y in zip(a, b, strict=True)], dtype=object)

    return paired(places, strings)
