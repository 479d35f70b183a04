"""Extension: the row checks and the leaderboard over a stream of group results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridrift.functions.numeric import close, dominated, within
from veridrift.operators.metrics import leaderboard
from veridrift.sources.records import GROUP_ROW


def stream_group_rows(spark: SparkSession, path: str, kind: str = "json") -> DataFrame:
    """Group results from files as they arrive."""
    return spark.readStream.schema(GROUP_ROW).option("mode", "FAILFAST").format(kind).load(path)


def row_violations(rows: DataFrame) -> DataFrame:
    """Rows that fail a check which needs no other row; append mode, no state."""
    q, best = F.col("selected_quality"), F.col("optimal_quality")
    bad_range = ~(within(q) & within(best) & dominated(q, best))
    bad_regret = ~close(F.col("regret"), best - q)
    check = F.when(bad_range, "quality_range").when(bad_regret, "regret")
    return rows.withColumn("check", check).where(F.col("check").isNotNull())


def running_leaderboard(rows: DataFrame) -> DataFrame:
    """The leaderboard so far; complete or update mode, state of one row per strategy."""
    return leaderboard(rows)
