"""Files that must be one: no task reads more than it writes."""

from oracle import SF
from pyspark.sql import functions as F

from veridrift.plans import registry
from veridrift.plans.fixture import table


def test_a_single_file_is_chosen_in_all_tasks(spark):
    one = registry.one_file(spark.range(0, 1000, 1, 8).withColumn("read", F.spark_partition_id()).where("id % 10 = 0"))
    assert one.rdd.getNumPartitions() == 1 and {r["read"] for r in one.collect()} == set(range(8))


def test_a_task_for_each_file(spark):
    line = table(spark, SF, "lineitem").select((F.col("l_orderkey") % 16).alias("p"))
    tasks = registry.in_parts(line, F.col("p"), 16).groupBy(F.spark_partition_id().alias("task")).agg(F.count_distinct("p").alias("n")).collect()
    assert [r["n"] for r in tasks] == [1] * 16


def test_queries_take_no_whole_table_into_one_task(spark, monkeypatch):
    """What a query writes as one file comes through ``one_file``."""
    seen, one = [], registry.one_file
    monkeypatch.setattr(registry, "one_file", lambda df: seen.append(1) or one(df))
    registry.queries()["resumable_run"](spark, SF)
    assert len(seen) == 2
    registry.queries()["streamed_drift"](spark, SF)
    assert len(seen) == 2 + registry.BATCHES
