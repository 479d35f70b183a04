"""What one task of the suffix order holds, whatever the input."""

from pyspark.sql import functions as F
from test_suffix_dedup import brute
from test_suffix_hot import documents

from veridrift.llm import suffix_dedup as s


def test_strings_of_hot_minimizers_take_as_many_parts_as_they_need(spark, monkeypatch):
    for name, value in (("BLOCK_BYTES", 4000), ("HOT", 20), ("PART_BYTES", 1 << 16)):
        monkeypatch.setattr(s, name, value)
    rows = documents()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    held, met_parts, strings, decide = [], [], s.decide_strings, s.decide
    task = F.spark_partition_id().alias("task")

    def watched_strings(met):
        held.extend(r["n"] for r in met.groupBy(task).agg(F.sum(F.length("data")).alias("n")).collect())
        return strings(met)

    def watched_decide(sent, parts):
        met_parts.extend(r["n"] for r in sent.groupBy(task).agg(F.count_distinct("part").alias("n")).collect())
        return decide(sent, parts)

    monkeypatch.setattr(s, "decide_strings", watched_strings)
    monkeypatch.setattr(s, "decide", watched_decide)
    assert sorted((tuple(x) for x in s.deduplicate(docs).collect()), key=repr) == brute(rows)
    assert sum(held) > 8 * s.PART_BYTES and max(held) <= s.PART_BYTES
    assert set(met_parts) == {1}


def test_minimizers_are_hot_by_a_share_of_the_text():
    """At a fixed number nearly all strings of a large table would move one by one."""
    assert s.hot_limit(1 << 20) == s.HOT and s.hot_limit(6 << 30) > 5 * s.HOT and s.hot_limit(1 << 50) == s.MOST_HOT


def test_a_row_group_holds_few_blocks(spark, monkeypatch):
    monkeypatch.setattr(s, "BLOCK_BYTES", 4000)
    sizes, write = {}, s.materialize

    def watched(df, name, *options):
        sizes[name] = options
        return write(df, name, *options)

    monkeypatch.setattr(s, "materialize", watched)
    s.deduplicate(spark.createDataFrame(documents(), "doc_id long, text string"))
    assert int(sizes["blocks"][0]["parquet.block.size"]) <= 8 << 20
