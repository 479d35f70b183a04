"""Rewriting shards: every row once, also those without an id or with a repeated one."""

from collections import Counter

from pyspark.sql import functions as F
from test_sharding import check

from veridrift.llm import queries, scratch, sharding

ROWS = [(i if i % 5 else None, "t" * (i % 97), i % 3) for i in range(1, 400)] + [(7, "same", 0)] * 5 + [(7, "other", 1), (None, None, 2), (8, "x" * 9000, 0)]


def test_null_and_repeated_ids_are_kept_once_each(spark, tmp_path):
    spark.createDataFrame(ROWS, "doc_id long, text string, shard int").write.partitionBy("shard").parquet(str(tmp_path / "old"))
    manifest = sharding.rewrite_shards(spark, str(tmp_path / "old"), str(tmp_path / "new"), 5).collect()
    assert any(m["rewritten"] for m in manifest)
    found = Counter()
    for m in manifest:
        files = spark.read.parquet(m["path"])
        assert files.columns == ["doc_id", "text"]
        found.update((r["doc_id"], r["text"]) for r in files.collect())
    assert found == Counter((i, t) for i, t, _ in ROWS)


def test_query_rewrites_files(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame([(i, t, f"s{k}", 3, 4) for i, t, k in ROWS], "doc_id long, text string, source string, shard int, _row int")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    made = []
    monkeypatch.setattr(sharding, "scratch_path", lambda spark, name: made.append(scratch.scratch_path(spark, name)) or made[-1])
    got = queries.op1_resharding(spark, str(tmp_path))
    assert got.columns == [c.split(" ")[0] for c in sharding.RESULT.split(", ")]
    got = got.collect()
    check([(i, t) for i, t, _ in ROWS], got, queries.NEW_SHARDS)
    new = next(p for p in made if "new-shards" in p)
    written = spark.read.parquet(new).groupBy("shard").agg(F.count("*").alias("n")).collect()
    counts = Counter(r["shard"] for r in got)
    assert written and all(counts[w["shard"]] == w["n"] for w in written)
    assert {r["shard"] for r in got if r["moved"]} <= {w["shard"] for w in written}
