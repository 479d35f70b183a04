"""What the similarity join leaves on disk and shuffles."""

import time

from pyspark.sql import functions as F

from veridrift.llm import ngram_join as j


def shuffle_files(spark) -> int:
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(files.apply(i).getName().startswith("shuffle_") for i in range(files.length()))


def test_shuffle_files_of_counts_go(spark):
    docs = spark.createDataFrame([(i, f"a{i} b c d e{i} f") for i in range(50)], "doc_id long, text string")
    made = j.described(j.numbered(docs.repartition(3)), 4)
    before = shuffle_files(spark)
    assert j.bucket_counts(made).any()
    end = time.time() + 10
    while shuffle_files(spark) > before and time.time() < end:
        time.sleep(0.2)
    assert shuffle_files(spark) <= before


def test_texts_of_representatives(spark):
    ids = [0, 1, 7, 8, 32766, 32767, 32768, 32769, 65535, 65536, (1 << 33) - 1, 1 << 33, (1 << 33) + 1, (5 << 33) + 40000]
    stored = spark.createDataFrame([(i, None, f"t{i}") for i in ids], "row long, doc_id long, text string")
    for chosen in (ids[::2], ids[1::2], ids[:3], []):
        entries = spark.createDataFrame([(i,) for i in chosen], "rep long")
        found = j.texts_of(stored, entries)
        assert sorted(r["row"] for r in found.collect()) == chosen and found.columns == stored.columns
    texts = spark.range(100).select(F.col("id").alias("row"), F.lit(None).cast("long").alias("doc_id"), F.lit("a b").alias("text"))
    plan = j.texts_of(texts, texts.select(F.col("row").alias("rep")))._jdf.queryExecution().optimizedPlan().toString()
    assert "rightHint=(strategy=broadcast)" in plan  # texts stay where they are
