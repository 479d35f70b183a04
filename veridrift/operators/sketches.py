"""Mergeable sketches: stored states of distinct counts, sets and quantiles, merged later.

A state is a few kilobytes whatever it has seen.  States of parts (days, files, partitions) are
stored as columns of a table and merged when asked; rows are not read again.  Errors, at three
standard deviations: a HyperLogLog of 2**k registers is off by 3 * 1.04 / sqrt(2**k) of the count; a
theta sketch of 2**k entries by 3 / sqrt(2**k) of it, and an overlap by that of the union; the rank of
a KLL quantile by about 3 / k**0.9 of all rows (0.0165 at k = 200 is its stated 99 % bound).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HLL_BITS, THETA_BITS, KLL_K = 12, 12, 200
#: Stated bounds: of a distinct count, of a set relative to the union, of a rank.
HLL_ERROR, THETA_ERROR, RANK_ERROR = 3 * 1.04 / math.sqrt(1 << HLL_BITS), 3 / math.sqrt(1 << THETA_BITS), 0.0165


def states(rows: DataFrame, by: list[str], key: str, value: str) -> DataFrame:
    """(by..., rows, hll, theta, kll): the sketches of ``key`` and ``value`` of each part."""
    return rows.groupBy(*by).agg(
        F.count("*").alias("rows"),
        F.hll_sketch_agg(key, HLL_BITS).alias("hll"),
        F.theta_sketch_agg(key, THETA_BITS).alias("theta"),
        F.kll_sketch_agg_double(F.col(value).cast("double"), KLL_K).alias("kll"),
    )


def merged(stored: DataFrame, by: list[str]) -> DataFrame:
    """The states of parts as one for each of ``by``."""
    return stored.groupBy(*by).agg(F.sum("rows").alias("rows"), F.hll_union_agg("hll").alias("hll"), F.theta_union_agg("theta", THETA_BITS).alias("theta"), F.kll_merge_agg_double("kll", KLL_K).alias("kll"))


def distinct(hll: Column) -> Column:
    return F.hll_sketch_estimate(hll)


def quantile(kll: Column, q: float) -> Column:
    return F.kll_sketch_get_quantile_double(kll, F.lit(q))


def overlap(a: Column, b: Column) -> Column:
    """How many keys two theta states share."""
    return F.theta_sketch_estimate(F.theta_intersection(a, b))
