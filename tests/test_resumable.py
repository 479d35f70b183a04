"""Runs that are stopped, resumed, and run again over changed input."""

import os
import shutil

import pytest
from pyspark.sql import functions as F

from veridrift.operators.resumable import Run


def source(spark, path, n=10):
    for p in range(n):
        spark.range(p * 10, p * 10 + p).select("id", (F.col("id") * 2).alias("x")).coalesce(1).write.parquet(f"{path}/p={p:02d} a+b%")
    return str(path)


def doubled(df):
    return df.select("unit", "id", (F.col("x") + 1).alias("y"))


def rows(df):
    return sorted((r["id"], r["y"]) for r in df.select("id", "y").collect())


@pytest.fixture
def made(spark, tmp_path):
    return source(spark, tmp_path / "in"), str(tmp_path / "out")


def test_stopped_and_resumed_equals_undisturbed(spark, made, tmp_path):
    src, out = made
    whole = Run(spark, src, str(tmp_path / "whole"), doubled, {"v": 1})
    assert whole.resume() and len(whole.read) == 1
    run = Run(spark, src, out, doubled, {"v": 1}, wave_units=3)
    assert not run.resume(waves=1, label="first")
    first = run.read
    again = Run(spark, src, out, doubled, {"v": 1}, wave_units=3)
    assert again.resume(label="second")
    assert [len(w) for w in first + again.read] == [3, 3, 3, 1]
    assert not {u for w in first for u in w} & {u for w in again.read for u in w}
    assert rows(again.result()) == rows(whole.result()) == [(p * 10 + i, 2 * (p * 10 + i) + 1) for p in range(10) for i in range(p)]
    assert {r["label"] for r in again.result().select("label").distinct().collect()} == {"first", "second"}
    assert again.resume() and again.read == []  # nothing is left, nothing is read


def test_stopped_inside_a_wave(spark, made):
    """Output that no ledger file names isn't there; it is done again and can be removed."""
    src, out = made

    class Stop(Exception):
        pass

    run = Run(spark, src, out, doubled, {}, wave_units=4)
    run.resume(waves=1)
    run._commit = lambda *a: (_ for _ in ()).throw(Stop())
    with pytest.raises(Stop):
        run.resume()
    broken = Run(spark, src, out, lambda df: (_ for _ in ()).throw(Stop()), {}, wave_units=4)
    with pytest.raises(Stop):
        broken.resume()
    after = Run(spark, src, out, doubled, {}, wave_units=4)
    assert after.finished().count() == 4 and after.resume() and [len(w) for w in after.read] == [4, 2]
    assert len(rows(after.result())) == 45 and after.vacuum() == 1 and len(rows(after.result())) == 45


def test_changed_added_and_removed_input(spark, made):
    src, out = made
    run = Run(spark, src, out, doubled, {})
    run.resume()
    shutil.rmtree(f"{src}/p=04 a+b%")
    spark.range(500, 503).select("id", F.lit(0).cast("long").alias("x")).coalesce(1).write.parquet(f"{src}/p=04 a+b%")
    spark.range(900, 901).select("id", F.lit(5).cast("long").alias("x")).coalesce(1).write.parquet(f"{src}/new")
    shutil.rmtree(f"{src}/p=09 a+b%")
    spark.catalog.clearCache()
    again = Run(spark, src, out, doubled, {})
    assert again.resume()
    assert [sorted(u.split("/")[0] for u in w) for w in again.read] == [["new", "p=04 a+b%"]]
    got = dict(rows(again.result()))
    assert {500: 1, 501: 1, 502: 1, 900: 6}.items() <= got.items() and not {40, 90} & set(got) and len(got) == 45 - 4 - 9 + 4


def test_parameters_and_content(spark, made):
    src, out = made
    Run(spark, src, out, doubled, {"v": 1}).resume()
    other = Run(spark, src, out, lambda df: df.select("unit", "id", F.lit(0).alias("y")), {"v": 2})
    with pytest.raises(ValueError, match="nothing is finished"):
        other.result()
    assert other.resume() and len(other.read[0]) == 10 and {y for _, y in rows(other.result())} == {0}
    by_bytes = Run(spark, src, out, doubled, {"v": 3}, content=True)
    by_bytes.resume()
    file = next(os.path.join(d, f) for d, _, fs in os.walk(src) for f in fs if f.endswith(".parquet"))
    os.utime(file, (1, 1))
    same = Run(spark, src, out, doubled, {"v": 3}, content=True)
    assert same.resume() and same.read == []


def test_two_runs_beside_each_other_count_once(spark, made):
    src, out = made
    one, two = (Run(spark, src, out, doubled, {}) for _ in range(2))
    left = sorted(two.left().collect(), key=lambda r: r["unit"])
    one.resume()
    two._do(left, "beside")
    assert len(rows(one.result())) == 45
