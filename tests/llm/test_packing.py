import random
import zlib

import numpy as np
import pytest

from veridrift.llm import packing

path = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


def test_differencing_is_a_partition():
    r = random.Random(3)
    for ways in (1, 2, 5, 9):
        sizes = [r.randint(1, 50) for _ in range(40)]
        windows = packing.differencing(sizes, ways)
        assert sorted(i for w in windows for i in w) == list(range(40)) and len(windows) <= ways
        loads = [sum(sizes[i] for i in w) for w in windows]
        assert max(loads) - min(loads) <= 0.1 * max(loads)
    assert packing.differencing([8, 7, 6, 5, 4], 2) and packing.differencing([], 3) == []


def test_windows_rise_when_capacity_is_exceeded():
    pieces, windows = packing.pack_block([(i, 0, 60) for i in range(3)], 100)
    assert max(sum(pieces[i][2] for i in w) for w in windows) <= 100
    assert sum(p[2] for p in pieces) == 180


TEXTS = ["", "One two  three", "<|endoftext|> x", "naïve Σίσυφος İstanbul", "a\x1cb", "é", "ＦＵＬＬ ½ ² it's", "𝔘𝔫𝔦 code 日本語", None]


def test_encoder_equals_tokenizer():
    from tokenizers import Tokenizer

    r = random.Random(5)
    letters = "aAéÉß ø\n\t'sdt.,!#12²ªº_-\x85\xa0"
    texts = [t or "" for t in TEXTS] + ["".join(r.choice(letters) for _ in range(60)) for _ in range(300)]
    want = [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in packing.WordEncoder(path).encode(texts)] == want


def test_every_id_lies_in_one_piece(spark):
    from tokenizers import Tokenizer

    r = random.Random(2)
    texts = TEXTS + [" ".join(r.choice(["alpha", "beta,", "gamma"]) for _ in range(r.choice([3, 90, 400, 6000]))) for _ in range(150)]
    rows = [(i, t, "x") for i, t in enumerate(texts)]
    rows[0] = (None, "", "x")
    df = spark.createDataFrame(rows, "doc_id long, text string, start string").repartition(2)
    got = packing.tokenizer_pack(df, path).collect()
    tok = Tokenizer.from_file(path)
    pieces = {}
    for g in got:
        pieces.setdefault(g["doc_id"], []).append(g)
    for i, t, _ in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [1]
        mine = sorted(pieces[i], key=lambda g: g["start"])
        at = 0
        for g in mine:
            assert g["start"] == at and g["doc_tokens"] == len(ids)
            assert g["ids_crc32"] == zlib.crc32(np.array(ids[at : at + g["length"]], dtype="<u4").tobytes())
            at += g["length"]
        assert at == len(ids)
    loads = {}
    for g in sorted(got, key=lambda g: g["offset"]):
        assert g["offset"] == loads.get(g["sequence_id"], 0)
        loads[g["sequence_id"]] = g["offset"] + g["length"]
    assert max(loads.values()) <= packing.WINDOW
    assert sum(loads.values()) > 0.95 * packing.WINDOW * (len(loads) - 4)
    assert packing.tokenizer_pack(df.limit(0), path).count() == 0


def test_memory_of_a_block_is_bounded():
    """Documents of whole windows leave nothing behind, and long ones less than a window."""
    packer = packing.Packer(0, 2048, False)
    for i in range(50):
        packer.add(i, np.zeros(20 * 2048, dtype="<u4"))
        packer.add(i, np.zeros(20 * 2048 + 5, dtype="<u4"))
    assert packer.tokens == 250 and sum(len(h[3]) for h in packer.held) == 250 and all(h[3].base is None for h in packer.held)
    packer.settle()
    assert len(packer.out) == 50 * 41 and not packer.held


def test_other_tokenizers_go_to_the_library(tmp_path):
    import json

    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as file:
        other = json.load(file)
    other["normalizer"]["normalizers"].pop()  # no lower-casing
    (tmp_path / "t.json").write_text(json.dumps(other))
    coder = packing.WordEncoder(str(tmp_path / "t.json"))
    want = Tokenizer.from_file(str(tmp_path / "t.json")).encode("One Two THREE", add_special_tokens=False).ids
    assert coder.encode(["One Two THREE"])[0].tolist() == want and packing.WordEncoder(path).plain
