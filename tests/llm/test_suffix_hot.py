"""A passage that very many documents share, in contexts of their own."""

import random

import numpy as np
from pyspark.sql import functions as F
from test_suffix_dedup import brute

from veridrift.llm import suffix_dedup as s


def documents():
    r = random.Random(4)
    own = lambda n: "".join(r.choice("abcdefghij ") for _ in range(n))
    passage, end = own(90), own(12)
    rows = [(i * 7 % 400, own(60) + passage + r.choice([end, ""]) + own(60)) for i in range(400)]
    return [*rows, (None, rows[5][1]), (3, rows[9][1]), (500, own(30) + passage[20:70] + own(30))]


def test_a_hot_minimizer_is_dealt_over_parts(spark, monkeypatch):
    monkeypatch.setattr(s, "BLOCK_BYTES", 4000)
    monkeypatch.setattr(s, "HOT", 20, raising=False)
    rows = documents()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    blocks = s.materialize(s.make_blocks(docs), "blocks")
    sent = s.send_segments(blocks, s.shared_keys(blocks, 97), 97).where("part >= 0")
    met: dict[tuple, int] = {}
    for x in sent.select("part", "keys").collect():
        for key in s.unpack40(x["keys"]).tolist():
            met[x["part"], key] = met.get((x["part"], key), 0) + 1
    assert max(met.values()) < 60  # some 400 share each end of the passage
    assert sorted((tuple(x) for x in s.deduplicate(docs).collect()), key=repr) == brute(rows)


def test_strings_of_hot_minimizers_meet_by_themselves(spark, monkeypatch):
    """What no part of a hot minimizer decides alone goes on, and is decided there."""
    monkeypatch.setattr(s, "BLOCK_BYTES", 4000)
    monkeypatch.setattr(s, "HOT", 20, raising=False)
    docs = spark.createDataFrame(documents(), "doc_id long, text string").repartition(3)
    blocks = s.materialize(s.make_blocks(docs), "blocks")
    sent = s.send_segments(blocks, s.shared_keys(blocks, 97), 97).where("part >= 0").repartition(97, "part")
    met = s.materialize(s.decide(sent, 97), "met").where("part is not null")
    assert met.where(F.length("data") % s.LENGTH != 0).isEmpty() and not met.isEmpty()
    cuts = s.decide_strings(met.repartition(97, "part")).collect()
    assert sum(len(np.frombuffer(x["cuts"], "<i4")) // 2 for x in cuts) > 0
