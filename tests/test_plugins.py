"""The data source and the table function, by SQL."""

import pytest

from veridrift.sources import plugins

A, B = "a" * 64, "b" * 64


@pytest.fixture
def lists(spark, tmp_path):
    plugins.register(spark)
    (tmp_path / "sub").mkdir()
    (tmp_path / "one.txt").write_text(f"{A}  docs/1\n{B.upper()}  docs/2 with space\n\nnonsense\n{A}  other/3")
    (tmp_path / "sub" / "two.txt").write_text(f"{B}  docs/4\n")
    (tmp_path / "_hidden").write_text(f"{A}  docs/9\n")
    spark.sql(f"CREATE OR REPLACE TEMPORARY VIEW lists USING hash_list OPTIONS (path '{tmp_path}')")
    return tmp_path


def test_lines(spark, lists):
    got = sorted((tuple(r) for r in spark.sql("SELECT * FROM lists").collect()), key=repr)
    assert got == sorted([("one.txt", 1, "docs/1", A), ("one.txt", 2, "docs/2 with space", B), ("one.txt", 4, None, None), ("one.txt", 5, "other/3", A), ("sub/two.txt", 1, "docs/4", B)], key=repr)


def test_filters_reach_the_source(spark, lists):
    q = spark.sql("SELECT path FROM lists WHERE path LIKE 'docs/%' AND list IN ('one.txt', 'x') AND line > 1")
    assert [r[0] for r in q.collect()] == ["docs/2 with space"]
    assert spark.sql("SELECT count(*) FROM lists WHERE list = 'sub/two.txt'").first()[0] == 1
    assert spark.sql("SELECT count(*) FROM lists WHERE path IS NULL").first()[0] == 1
    (lists / "one.txt").chmod(0o644)
    reader = plugins.HashListReader(str(lists))
    from pyspark.sql.datasource import EqualTo, GreaterThan

    left = list(reader.pushFilters([EqualTo(("list",), "sub/two.txt"), GreaterThan(("line",), 1)]))
    assert [type(f) for f in left] == [GreaterThan] and [p.name for p in reader.partitions()] == ["sub/two.txt"]


def test_table_function(spark, lists):
    spark.createDataFrame([(1, 3, 5.0), (1, 1, 2.0), (1, 2, 2.0), (2, 1, 7.0), (2, 2, None), (2, 3, 7.5), (3, 1, 1.0)], "k long, at long, v double").createOrReplaceTempView("seen")
    got = spark.sql("SELECT * FROM last_seen(TABLE(SELECT k, at, v FROM seen) PARTITION BY k ORDER BY at)").collect()
    assert sorted(tuple(r) for r in got) == [(1, 3, 5.0, 2.0), (2, 3, 7.5, 7.0)]
