"""Extension: events as a stream, by windows of event time and by state of their keys.

Windows are closed by a watermark: ``delay`` behind the latest event of the batches before.  Rows
that come for a window that was closed before their batch (by the watermark of the batch before
it) are late; they are left out of the window's count, and
counted (``late_rows``).  Keyed state holds the last value of each key, so a drift is seen as a sequential audit sees
it: each value against the one before, whatever batch that came in.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from veridrift.sources.tables import scratch_path

#: Values further apart than this have drifted.
TOLERANCE = 1e-9
#: Groups of keys whose last values are one state.
BUCKETS = 1024


def tumbling(time: Column, width: str) -> Column:
    return F.window(time, width)


def sliding(time: Column, width: str, slide: str) -> Column:
    return F.window(time, width, slide)


def session(time: Column, gap: str) -> Column:
    return F.session_window(time, gap)


def counts(events: DataFrame, window: Column, keys: list[str], value: str, time: str = "ts", delay: str = "10 minutes") -> DataFrame:
    """(start, end, keys..., n, total): append mode gives a window once, when the watermark passes it."""
    grouped = events.withWatermark(time, delay).groupBy(window.alias("w"), *keys)
    total = F.sum(F.col(value).cast("decimal(28,4)")).cast("double")
    return grouped.agg(F.count("*").alias("n"), total.alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n", "total")


def drifts(events: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """(key, at, value, before): values that differ from the one before of their key, in order within a batch.

    A state holds the last values of all keys of a bucket, as a state for each key costs milliseconds a batch.
    """

    def run(_: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = dict(zip(*state.get, strict=True)) if state.exists else {}
        rows = pd.concat(list(frames)).sort_values(["key", "at"])
        key, value = rows["key"], rows["value"].to_numpy()
        first, end = ~key.duplicated().to_numpy(), ~key.duplicated("last").to_numpy()
        before, known = np.append(value[:1], value[:-1]), ~first
        names = key[first].tolist()
        before[first] = [last.get(k, 0.0) for k in names]
        known[first] = [k in last for k in names]
        near = np.abs(value - before) <= np.maximum(TOLERANCE * np.maximum(np.abs(value), np.abs(before)), TOLERANCE)
        last.update(zip(names, value[end].tolist(), strict=True))
        state.update((list(last), list(last.values())))
        yield pd.DataFrame({"key": key, "at": rows["at"], "value": value, "before": before})[known & ~near]

    kind = events.schema[key].dataType.simpleString()
    rows = events.where(F.col(key).isNotNull() & F.col(value).isNotNull()).select(F.col(key).alias("key"), F.col(order).cast("long").alias("at"), F.col(value).cast("double").alias("value"))
    buckets = rows.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(BUCKETS))).groupBy("bucket")
    return buckets.applyInPandasWithState(run, f"key {kind}, at long, value double, before double", f"keys array<{kind}>, before array<double>", "append", GroupStateTimeout.NoTimeout)


def arrivals(spark: SparkSession, path: str, schema, files: int = 1) -> DataFrame:
    """Parquet files as a stream, so many for each batch, oldest first."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def exhausted(stream: DataFrame) -> DataFrame:
    """What a stream has given when all that is there has been read.

    Windows that the last watermark doesn't pass stay open; end the input with a row far ahead.
    """
    spark = stream.sparkSession
    base = scratch_path(spark, "stream")
    query = stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def late_rows(read: DataFrame, counted: DataFrame) -> DataFrame:
    """One row: how many of the rows that a stream has ``read`` are in no window of ``counted``.

    (The stream's own metric counts what partial sums have made of late rows.)
    """
    return read.agg(F.count("*").alias("all")).crossJoin(counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))).select((F.col("all") - F.col("n")).alias("late"))
