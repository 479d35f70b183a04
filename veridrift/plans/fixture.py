"""Queries over the TPC-H-like tables.

Those tables have no strategies or candidates, so the queries work by analogy: an order is a
prompt group, its first four lineitems are the candidates, quantity / 50 is the quality, and
discount and tax are what a rule can see.  ``documents`` and ``labels`` stand in for assets and
their coverage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridrift.operators import selection

SEED = 20260827
UNIQUE_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
N = 4
STRATEGIES = ("direct", "random", "rule", "oracle")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(group_id, k, sample_id, quality, l_discount, l_tax, l_extendedprice) of the first four of each order."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", *UNIQUE_ORDER, "l_quantity", "l_discount", "l_tax")
    first = selection.first_k(line, ["l_orderkey"], [F.col(c) for c in UNIQUE_ORDER], N)
    named = first.select(
        F.col("l_orderkey").alias("group_id"),
        "k",
        F.concat(F.col("l_orderkey").cast("string"), F.lit("_c"), F.col("k").cast("string")).alias("sample_id"),
        (F.col("l_quantity") / 50).alias("quality"),
        "l_discount",
        "l_tax",
        "l_extendedprice",
    )
    return selection.complete_groups(named, "group_id", N)


def picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = {
        "direct": [F.col("k")],
        "random": [selection.hash_order(F.col("sample_id"), SEED), F.col("k")],
        "rule": [-F.col("l_discount"), F.col("l_tax"), F.col("k")],
        "oracle": [-F.col("quality"), F.col("sample_id")],
    }
    return selection.pick_strategies(candidates(spark, sf_dir), "group_id", "sample_id", "quality", orders)


#: The same in SQL, to be put before a query.
SQL = f"""
WITH ranked AS (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(UNIQUE_ORDER)}) - 1 AS k FROM lineitem
), cand AS (
  SELECT l_orderkey AS group_id, k, l_orderkey::varchar || '_c' || k::varchar AS sample_id,
         l_quantity / 50 AS quality, l_discount, l_tax,
         count(*) OVER (PARTITION BY l_orderkey) AS n
  FROM ranked WHERE k < {N}
), candidates AS (SELECT * FROM cand WHERE n = {N}),
chosen AS (
  SELECT *,
    row_number() OVER (PARTITION BY group_id ORDER BY k) AS r_direct,
    row_number() OVER (PARTITION BY group_id ORDER BY md5('{SEED}:' || sample_id), k) AS r_random,
    row_number() OVER (PARTITION BY group_id ORDER BY l_discount DESC, l_tax, k) AS r_rule,
    row_number() OVER (PARTITION BY group_id ORDER BY quality DESC, sample_id) AS r_oracle
  FROM candidates
), best AS (SELECT group_id, sample_id AS optimal_id, quality AS optimal_quality FROM chosen WHERE r_oracle = 1),
picks AS (
  SELECT s.strategy, c.group_id, c.sample_id AS selected_id, c.quality AS selected_quality, optimal_id, optimal_quality,
         optimal_quality - c.quality AS regret, c.sample_id = optimal_id AS top1_correct
  FROM (VALUES ('direct'), ('random'), ('rule'), ('oracle')) s(strategy)
  JOIN chosen c ON (s.strategy = 'direct' AND r_direct = 1) OR (s.strategy = 'random' AND r_random = 1)
                OR (s.strategy = 'rule' AND r_rule = 1) OR (s.strategy = 'oracle' AND r_oracle = 1)
  JOIN best b USING (group_id)
)
"""
