"""Keyed state over a stream: a state for a bucket of keys, not for each key."""

from veridrift.streaming import events


def test_states_do_not_grow_with_keys(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(events, "BUCKETS", 4)
    nan = float("nan")
    batches = [[(k, 0, k * 1.0) for k in range(60)], [(k, 1, k + (k % 2)) for k in range(60)] + [(99, 5, nan), (99, 6, 1.0)]]
    for i, rows in enumerate(batches):
        spark.createDataFrame([(k, a, float(v)) for k, a, v in rows], "k long, i long, v double").repartition(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = events.arrivals(spark, f"{tmp_path}/in", "k long, i long, v double")
    plan = events.drifts(stream, "k", "v", "i")
    assert "bucket" in plan._jdf.queryExecution().logical().toString()
    got = {(r["key"], r["at"], r["value"]): r["before"] for r in events.exhausted(plan).collect()}
    got.pop((99, 6, 1.0))  # a NaN before is written as null
    assert got == {(k, 1, k + 1.0): float(k) for k in range(1, 60, 2)}
