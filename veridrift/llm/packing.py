"""Packing of token sequences by multiway differencing.

Each document is turned into token ids; full windows are cut off its front, and what remains is
cut into pieces.  Karmarkar-Karp differencing then spreads the pieces of a block over as few
windows as can hold them: every piece starts as a partial partition of its own, the two partial
partitions with the largest imbalance are merged with their loads opposed (the fullest window of
one with the emptiest of the other), and so on until one is left, whose windows are near equal.
If its fullest window is above the capacity, the block gets one window more and is packed again.

How it scales.  There is no shuffle: a task packs the rows that it reads, block by block.  Full
windows leave at once and a block holds a bounded number of tokens, so memory doesn't grow with
the input.  Only a block's
last window is not near full, that is one in about a hundred.  Sequence ids are unique over all
tasks, and depend on how the input is split.

Edge cases.  A null or empty text is one piece with the end id alone.  Repeated rows and null
document ids are packed like any other.  A document of any length is cut, never shortened.  An
empty table gives an empty result.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
import json
import re
import struct
import unicodedata
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from veridrift.llm.batches import arrow_schema, parts, release

WINDOW = 2048
END_ID = 1
#: Tokens of a block: windows that are balanced together.
BLOCK_TOKENS = 96 * WINDOW
#: Windows above the least number that a block may have before its pieces are cut smaller.
SPARE = 0.005
#: Known words of a tokenizer; the table starts anew beyond that.
CACHE = 200_000

PIECES = "doc_id {id}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class WordEncoder:
    """Ids of whole texts from the word tokenizer in a file.

    That tokenizer normalises, splits a text into words and encodes each by itself.  For plain
    texts (Latin letters below U+0130, no controls, already composed) the normalised words are
    found here, and each distinct one is encoded once, by the tokenizer's own model; any other
    text goes to the tokenizer as it is, and so does every text where the file names another
    normaliser, split or kind of model.  The ids are the same either way.
    """

    ODD = re.compile("[\x00-\x08\x0e-\x1f\x7f-\x9f\u0130-\U0010ffff]|<\\|")
    #: The tokenizer's own split, over plain texts; letters come first, as no other kind begins with one.
    WORDS = re.compile(r"[^\W\d_²³¹¼½¾]+|[\d²³¹¼½¾]|'(?:s|t|re|ve|m|ll|d)|(?:[^\s\w]|_)+")

    # How the word tokenizer's file names its normaliser, its split and what follows
    FORM = {
        "truncation": None,
        "padding": None,
        "post_processor": None,
        "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
        "pre_tokenizer": {
            "type": "Sequence",
            "pretokenizers": [
                {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
                {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
            ],
        },
    }

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        with open(path, encoding="utf-8") as file:
            written = json.load(file)
        self.plain = (
            all(written[k] == v for k, v in self.FORM.items())
            and written["model"]["type"] == "BPE"
            and not written["model"].get("dropout")
            and all(t["content"].startswith("<|") for t in written["added_tokens"])
        )
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        hidden = [b for b in range(256) if b not in set(shown)]
        # byte-level models write each byte as one printable character
        self.letters = {b: b for b in shown} | {b: 256 + i for i, b in enumerate(hidden)}
        self.known: dict[str, bytes] = {}

    def word(self, word: str) -> bytes:
        written = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
        ids = [t.id for t in self.model.tokenize(written)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def words(self, text: str) -> list[str] | None:
        """The normalised words of a plain text."""
        if not self.plain or self.ODD.search(text) or not unicodedata.is_normalized("NFC", text):
            return None
        return self.WORDS.findall(text.lower())

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.known) > CACHE:
            self.known.clear()
        split = [self.words(t) for t in texts]
        new = set().union(*[w for w in split if w is not None]).difference(self.known)
        self.known |= {w: self.word(w) for w in new}
        out = []
        for text, words in zip(texts, split, strict=True):
            if words is None:
                out.append(np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4"))
            else:
                out.append(np.frombuffer(b"".join(map(self.known.__getitem__, words)), dtype="<u4"))
        return out


_ENCODERS: dict[str, WordEncoder] = {}


def word_encoder(path: str) -> WordEncoder:
    """The encoder of this worker, whose known words last from task to task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def differencing(sizes: list[int], ways: int) -> list[list[int]]:
    """Spread items over ``ways`` windows by Karmarkar-Karp; the item numbers of each window.

    A partial partition is a list of (load, items) by descending load, empty windows left out, so
    a merge costs as much as the windows that it fills.
    """
    heap: list[tuple[int, int, list[tuple[int, int]]]] = []
    # a window's items are a tree: leaf numbers are items, the others are joins of two
    joins: list[tuple[int, int]] = []
    n = len(sizes)
    for i, size in enumerate(sizes):
        heap.append((-size, i, [(size, i)]))
    heapq.heapify(heap)
    tie = n
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        if len(a) < len(b):
            a, b = b, a
        # a's windows from the emptiest up meet b's from the fullest down
        free = ways - len(a)
        moved = b[: max(0, free)]
        merged = a + moved
        rest = b[len(moved) :]
        if rest:
            k = len(a) - len(rest)
            merged = a[:k] + moved
            for (x, i), (y, j) in zip(reversed(a[k:]), rest, strict=True):
                joins.append((i, j))
                merged.append((x + y, n + len(joins) - 1))
        merged.sort(key=lambda w: -w[0])
        if len(merged) == ways:
            low = merged[-1][0]
            imbalance = merged[0][0] - low
        else:
            imbalance = merged[0][0]
        heapq.heappush(heap, (-imbalance, tie, merged))
        tie += 1
    windows = []
    for _, root in heap[0][2] if heap else []:
        items, stack = [], [root]
        while stack:
            x = stack.pop()
            if x < n:
                items.append(x)
            else:
                stack += joins[x - n]
        windows.append(items)
    return windows


def pack_block(rest: list[tuple[int, int, int]], window: int) -> tuple[list[tuple[int, int, int]], list[list[int]]]:
    """Pieces (document, start, length) and the pieces of each window.

    ``rest`` has a piece under ``window`` for each document.  Pieces are cut to a half of
    the window, then a quarter and so on, until hardly a window is above the least number.
    """
    total = sum(x[2] for x in rest)
    least = -(-total // window)
    most = max(1, window // 2)
    while True:
        pieces = [
            (doc, start + at, min(most, length - at))
            for doc, start, length in rest
            for at in range(0, length, most)
        ]
        allowed = least + max(1, int(least * SPARE)) if most > window // 32 else len(pieces)
        ways = least
        while ways <= allowed:
            windows = differencing([p[2] for p in pieces], ways)
            if max((sum(pieces[i][2] for i in w) for w in windows), default=0) <= window:
                return pieces, windows
            ways += 1
        most //= 2


class Packer:
    """Packs the documents of a task; rows of pieces gather in ``out``.

    Full windows of a document are out at once; only what remains of it is held until its block
    is packed, so a document of any length costs the block less than a window.
    """

    def __init__(self, sequence: int, window: int, keep_ids: bool):
        self.sequence, self.window, self.keep_ids = sequence, window, keep_ids
        self.out: list[tuple] = []
        #: (document id, ids in all, place of the remainder, its ids)
        self.held: list[tuple[object, int, int, np.ndarray]] = []
        self.tokens = 0

    def put(self, doc_id: object, total: int, start: int, ids: np.ndarray, offset: int) -> None:
        row = (doc_id, start, len(ids), zlib.crc32(ids.tobytes()), total, self.sequence, offset)
        self.out.append((*row, ids.tolist()) if self.keep_ids else row)

    def add(self, doc_id: object, ids: np.ndarray) -> None:
        full = len(ids) // self.window * self.window
        for start in range(0, full, self.window):
            self.put(doc_id, len(ids), start, ids[start : start + self.window], 0)
            self.sequence += 1
        if full < len(ids):
            self.held.append((doc_id, len(ids), full, ids[full:].copy()))
            self.tokens += len(ids) - full
        if self.tokens >= BLOCK_TOKENS:
            self.settle()

    def settle(self) -> None:
        """Pack the block that is held."""
        pieces, windows = pack_block([(i, 0, len(h[3])) for i, h in enumerate(self.held)], self.window)
        for items in windows:
            offset = 0
            for i in sorted(items):
                doc, start, length = pieces[i]
                doc_id, total, full, ids = self.held[doc]
                self.put(doc_id, total, full + start, ids[start : start + length], offset)
                offset += length
            self.sequence += 1
        self.held.clear()
        self.tokens = 0


def pack(docs: DataFrame, encoder: Callable[[], object], window: int = WINDOW, keep_ids: bool = False) -> DataFrame:
    """Pieces of all documents and their places in sequences of at most ``window`` ids.

    ``encoder`` makes an object with ``encode(list of texts) -> list of id arrays``; each
    document is followed by ``END_ID``.  With ``keep_ids`` the ids of a piece come with it.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    ddl = PIECES.format(id=id_type) + (", ids array<long>" if keep_ids else "")
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        packer = Packer((context.partitionId() if context else 0) << 40, window, keep_ids)
        coder = encoder()

        def rows() -> pa.RecordBatch:
            columns = list(zip(*packer.out, strict=True)) or [()] * len(schema)
            packer.out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)

        for batch in batches:
            for part in parts(batch):
                texts = ["" if t is None else t for t in part.column("text").to_pylist()]
                for doc_id, ids in zip(part.column("doc_id").to_pylist(), coder.encode(texts), strict=True):
                    packer.add(doc_id, np.append(ids, np.uint32(END_ID)).astype("<u4"))
                    if len(packer.out) >= 2000:
                        yield rows()
        packer.settle()
        yield rows()
        release()

    return docs.select("doc_id", "text").mapInArrow(run, ddl)


def tokenizer_pack(docs: DataFrame, path: str, window: int = WINDOW) -> DataFrame:
    """``pack`` with the word tokenizer in the file ``path``, which every worker can read."""
    return pack(docs, lambda: word_encoder(path), window)
