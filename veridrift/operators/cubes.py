"""Grouping sets from stored states that are merged with those of new data.

The state of a table is a row for each combination of its dimensions, with sums that can be added:
counts, sums, least and greatest values.  New rows make a state of their own, of themselves alone;
states are merged by adding up, and every grouping set follows from the merged state, never from
rows again.  Sums are exact decimals, so a merged state is the same whatever the order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_PARTS = ("rows", "n", "sum", "least", "most")


def state(rows: DataFrame, dimensions: list[str], values: list[str], scale: int = 4) -> DataFrame:
    """(dimensions..., rows, and n, sum, least, most of each value)."""
    made = [F.count("*").alias("rows")]
    for v in values:
        x = F.col(v).cast(f"decimal(28,{scale})")
        made += [F.count(v).alias(f"{v}_n"), F.sum(x).alias(f"{v}_sum"), F.min(v).alias(f"{v}_least"), F.max(v).alias(f"{v}_most")]
    return rows.groupBy(*dimensions).agg(*made)


def _added(values: list[str]) -> list:
    out = [F.sum("rows").alias("rows")]
    for v in values:
        out += [F.sum(f"{v}_n").alias(f"{v}_n"), F.sum(f"{v}_sum").alias(f"{v}_sum"), F.min(f"{v}_least").alias(f"{v}_least"), F.max(f"{v}_most").alias(f"{v}_most")]
    return out


def merged(states: list[DataFrame], dimensions: list[str], values: list[str]) -> DataFrame:
    """One state of several."""
    every = states[0]
    for s in states[1:]:
        every = every.unionByName(s)
    return every.groupBy(*dimensions).agg(*_added(values))


def cube(stored: DataFrame, dimensions: list[str], values: list[str]) -> DataFrame:
    """All grouping sets of a state: dimensions, ``level`` (GROUPING_ID), and the final values."""
    sets = stored.cube(*dimensions).agg(F.grouping_id().alias("level"), *_added(values))
    final = [c for v in values for c in (F.col(f"{v}_n"), F.col(f"{v}_sum").cast("double").alias(f"{v}_sum"), (F.col(f"{v}_sum").cast("double") / F.nullif(F.col(f"{v}_n"), F.lit(0))).alias(f"{v}_mean"), F.col(f"{v}_least"), F.col(f"{v}_most"))]
    return sets.select(*dimensions, "level", "rows", *final)
