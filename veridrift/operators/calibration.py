"""Percentile calibration, thresholds and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridrift.functions.numeric import holds
from veridrift.operators.quantiles import wide_percentiles


def bounds(rows: DataFrame, columns: list[str], low: float = 0.05, high: float = 0.95) -> DataFrame:
    """(metric, low, high): interpolated percentiles of each column, by histograms of ``rows``, which is read once a pass."""
    return wide_percentiles(rows, columns, {"low": low, "high": high})


def normalized(value: Column, low: Column, high: Column, positive: Column | bool = True, degenerate: float | None = 0.0) -> Column:
    """Place between the bounds, clipped to [0, 1], and turned round where lower is better.

    Equal bounds carry no information; every value then gets ``degenerate`` (a choice of this
    library, NULL for none).
    """
    place = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (value - low) / F.nullif(high - low, F.lit(0.0))))
    up = F.lit(positive) if isinstance(positive, bool) else positive
    turned = F.when(up, place).otherwise(1.0 - place)
    return F.when(value.isNull(), F.lit(None)).when(high == low, F.lit(degenerate)).otherwise(turned)


def composite(parts: dict[str, float]) -> Column:
    """Weighted mean of normalised metrics; the weights are a parameter, as none are given."""
    total = sum(parts.values())
    return sum((F.lit(w / total) * F.col(c) for c, w in parts.items()), F.lit(0.0))


def threshold(rows: DataFrame, column: str, q: float) -> DataFrame:
    """One row: the percentile; null where there are no values."""
    return wide_percentiles(rows, [column], {"threshold": q}).agg(F.max("threshold").alias("threshold"))


def gate(checks: Column) -> Column:
    """AND over a map of named checks; an unknown check doesn't pass, nor does an empty map."""
    return F.forall(F.map_values(checks), lambda c: holds(c)) & (F.size(checks) > 0)


def failed_checks(rows: DataFrame, checks: str = "checks") -> DataFrame:
    """The named checks that don't hold."""
    return rows.select(F.explode(checks).alias("name", "ok")).where(~holds(F.col("ok"))).select("name")
