"""Intermediate tables belong to the work that wrote them."""

import sys
import threading
from pathlib import Path

from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from oracle import SF  # noqa: E402

import corpus_pipeline  # noqa: E402
from veridrift.llm import queries, simhash  # noqa: E402
from veridrift.llm.components import components  # noqa: E402
from veridrift.llm.scratch import materialize, owned  # noqa: E402


def test_a_result_made_between_two_stages_lives(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    first = materialize(stages["quality_classifier"](spark, docs, SF), "stage")
    between = queries.op3_simhash(spark, SF)
    n = between.count()
    second = stages["simhash_near_dedup"](spark, first, SF)
    assert second.count() <= first.count() and between.count() == n == docs.count()
    stages["benchmark_decontamination"](spark, second, SF).count()
    assert between.count() == n


def test_two_threads(spark):
    edges = spark.range(300).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v")).where("u % 100 != 99")
    docs = spark.createDataFrame([(i, "a b c d e f g" if i % 3 else f"w{i} x y z") for i in range(60)], "doc_id long, text string")
    found, failed = {}, []

    def work(name, make, times):
        try:
            for _ in range(times):
                found[name] = make()
        except Exception as error:  # noqa: BLE001
            failed.append(error)

    jobs = [
        ("components", lambda: components(edges).select("component").distinct().count(), 2),
        ("simhash", lambda: simhash.near_duplicates(docs, 4, 4).select("component_id").distinct().count(), 2),
    ]
    threads = [threading.Thread(target=work, args=job) for job in jobs]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed and found == {"components": 3, "simhash": 21}


def test_only_what_was_written_inside_is_swept(spark):
    outside = materialize(spark.range(3), "outside")
    with owned() as outer:
        kept = materialize(spark.range(4), "kept")
        with owned() as inner:
            lost = materialize(spark.range(5), "lost")
        assert len(outer.paths) == 2 and len(inner.paths) == 1
        outer.sweep(spark, kept)
    assert outside.count() == 3 and kept.count() == 4 and len(outer.paths) == 1
    try:
        spark.read.parquet(lost.inputFiles()[0]).count()
    except Exception:  # noqa: BLE001
        return
    raise AssertionError("it is still there")
