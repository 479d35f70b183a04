"""Ids that are null, extreme or repeated."""

import hashlib

from pyspark.sql import functions as F

from veridrift.llm import decontaminate, sharding, simhash, suffix_dedup


def test_documents_without_ids_connect_others(spark, monkeypatch):
    """A - B - C link in a chain whose middle has no id; D, without one, is alone."""
    prints = {"a": 0b0, "b": 0b111, "c": 0b111111, "d": (1 << 60) - 1, "e": 0b111 << 50}
    monkeypatch.setattr(simhash, "with_fingerprint", lambda docs, shingle: docs.select("doc_id", F.element_at(F.create_map(*[F.lit(x) for kv in prints.items() for x in kv]), F.col("text")).cast("long").alias("fp")))
    rows = [(1, "a"), (None, "b"), (2, "c"), (None, "d"), (None, "e"), (7, "e")]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4, 4).collect()
    by = sorted(((r["doc_id"], int(r["fingerprint"], 16), r["component_id"]) for r in got), key=repr)
    assert by == sorted([(1, 0, 1), (None, 7, 1), (2, 63, 1), (None, prints["d"], None), (None, prints["e"], 1), (7, prints["e"], 1)], key=repr)


def test_the_largest_id_stays(spark):
    most, passage = (1 << 63) - 1, "the same passage of more than fifty bytes stands in all of them " * 2
    rows = [(most, passage + "x"), (None, passage + "y"), (1, passage), (-(1 << 63), "short")]
    got = {(r["doc_id"], r["n_bytes"]): r["n_removed"] for r in suffix_dedup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    n = len(passage)
    assert {k[0] for k in got} == {most, None, 1, -(1 << 63)}
    assert got[(1, n)] == 0 and got[(most, n + 1)] == n == got[(None, n + 1)] and got[(-(1 << 63), 5)] == 0


def test_items_of_one_id_count_once(spark):
    text = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(1, f"so {text} it is"), (2, "nothing")], "doc_id long, text string")
    items = spark.createDataFrame([(5, text), (5, text), (6, text), (None, text)], "item_id long, text string")
    got = {r["doc_id"]: r for r in decontaminate.decontaminate(docs, items, 10).collect()}
    assert got[1]["n_items"] == 2 and got[1]["items_sha256"] == hashlib.sha256(b"5,6").hexdigest() and got[1]["n_hit"] == 10
    assert got[2]["n_items"] == 0 and not got[2]["contaminated"]


def test_resharding_with_clashing_names(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i}", i % 3, "x", i, i) for i in range(40)], "doc_id long, text string, shard int, document_shard string, _row int, document__row int")
    got = sharding.reshard_files(docs, F.col("shard"), 5).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(40)) and {r["shard"] for r in got} == set(range(5))
    source, target = f"{tmp_path}/old", f"{tmp_path}/new"
    docs.drop("document_shard").write.partitionBy("shard").parquet(source)
    manifest = sharding.rewrite_shards(spark, source, target, 4).collect()
    found = [r for m in manifest for r in spark.read.parquet(m["path"]).collect()]
    assert sorted((r["doc_id"], r["_row"], r["document__row"]) for r in found) == [(i, i, i) for i in range(40)]
