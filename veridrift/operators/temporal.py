"""As-of joins, interval joins and range frames over time, cut into blocks of time.

A key may hold a third of all rows, so nothing here gathers a key.  Time is cut into blocks of
``block`` microseconds, and work is dealt by key and block:

* ``asof_join``: in a block, a row takes the last match at or before it in the block.  Where there is
  none, it takes what is carried over: the last match of the nearest earlier block of its key that
  has any.  Only the blocks of a key, a row each, meet in one window.
* ``interval_join``: blocks as wide as the interval; a row is put into the two blocks that its
  matches can lie in, so the join is an equality of key and block, with the exact test after it.
* ``range_sums``: sums over the rows of a key up to ``back`` before each row.  Rows near the end of a
  block are also put into the next one, as a halo that counts but isn't returned.

Times are timestamps with or without a zone; a null time or key matches nothing, and has null sums.
Joins are outer on the left where they say so.  Equal times are peers, as in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def micros(time: Column) -> Column:
    """Microseconds since 1970, of a timestamp with or without a zone."""
    return F.unix_micros(time.cast("timestamp"))


def asof_join(left: DataFrame, right: DataFrame, left_key: str, left_time: str, right_key: str, right_time: str, keep: list[str], tie: list[str], block: int) -> DataFrame:
    """``left`` with the columns ``keep`` of the latest row of ``right`` at or before its time, by key.

    ``keep`` come as ``asof_<name>``, null where there is no such row.  Of rows at one time the one that is
    last by ``tie`` counts.
    """
    value = F.struct(micros(F.col(right_time)).alias("t"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(tie)], F.struct(*keep).alias("kept"))
    events = right.where(F.col(right_key).isNotNull() & F.col(right_time).isNotNull()).select(F.col(right_key).alias("k"), micros(F.col(right_time)).alias("t"), value.alias("v"))
    # of rows at one time one stays; it comes before the left rows of that time
    events = events.groupBy("k", "t").agg(F.max("v").alias("v"))
    whole = F.struct(*[F.col(f"`{c}`") for c in left.columns]).alias("row")
    rows = left.select(F.col(left_key).alias("k"), micros(F.col(left_time)).alias("t"), F.lit(1).alias("side"), whole, F.lit(None).cast(events.schema["v"].dataType).alias("v"))
    both = rows.unionByName(events.select("k", "t", F.lit(0).alias("side"), F.lit(None).cast(rows.schema["row"].dataType).alias("row"), "v"))
    both = both.withColumn("b", F.floor(F.col("t") / block))
    inside = Window.partitionBy("k", "b").orderBy("t", "side").rowsBetween(Window.unboundedPreceding, 0)
    near = both.withColumn("near", F.last("v", ignorenulls=True).over(inside)).where("side = 1")
    ends = events.groupBy("k", F.floor(F.col("t") / block).alias("b")).agg(F.max("v").alias("end"))
    asked = both.where("side = 1 and k is not null and t is not null").select("k", "b").distinct()
    earlier = Window.partitionBy("k").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    carried = asked.join(ends, ["k", "b"], "full_outer").withColumn("carried", F.last("end", ignorenulls=True).over(earlier)).select("k", "b", "carried")
    found = near.join(carried, ["k", "b"], "left").withColumn("v", F.coalesce("near", "carried"))
    return found.select("row.*", *[F.col(f"v.kept.{c}").alias(f"asof_{c}") for c in keep])


def interval_join(left: DataFrame, right: DataFrame, left_key: str, left_time: str, right_key: str, right_time: str, low: int, high: int) -> DataFrame:
    """Pairs of rows of equal key with low <= right time - left time <= high, in microseconds; columns of both."""
    width = max(1, high - low)
    whole = lambda df, name: F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(name)
    t = micros(F.col(left_time))
    first = F.floor((t + low) / width)
    asked = left.select(whole(left, "l"), F.col(left_key).alias("k"), t.alias("t"), F.explode(F.array(first, first + 1)).alias("b"))
    u = micros(F.col(right_time))
    there = right.select(whole(right, "r"), F.col(right_key).alias("k"), u.alias("u"), F.floor(u / width).alias("b"))
    return asked.join(there, ["k", "b"]).where((F.col("u") - F.col("t")).between(low, high)).select("l.*", "r.*")


def range_sums(rows: DataFrame, key: str, time: str, values: dict[str, Column], back: int, block: int) -> DataFrame:
    """``rows`` with a sum for each of ``values`` over the rows of its key from ``back`` microseconds before its time up to it, peers included."""
    if block < back:
        raise ValueError("a block must be as long as the frame")
    whole = F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row")
    named = rows.select(whole, F.col(key).alias("k"), micros(F.col(time)).alias("t"), *[v.alias(f"v{i}") for i, v in enumerate(values.values())])
    own = F.floor(F.col("t") / block)
    halo = F.when((own + 1) * block - F.col("t") <= back, F.array(own, own + 1)).otherwise(F.array(own))
    placed = named.withColumn("b", F.explode(halo)).withColumn("mine", own == F.col("b"))
    frame = Window.partitionBy("k", "b").orderBy("t").rangeBetween(-back, 0)
    summed = placed.withColumns({name: F.sum(f"v{i}").over(frame) for i, name in enumerate(values)}).where("mine")
    lost = named.where("t is null").select("row.*", *[F.lit(None).cast(summed.schema[n].dataType).alias(n) for n in values])
    # a null key is no key
    known = {n: F.when(F.col("k").isNotNull(), F.col(n)) for n in values}
    return summed.select("row.*", *[c.alias(n) for n, c in known.items()]).unionByName(lost)
