"""Running a query and its SQL side by side."""

from __future__ import annotations

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.001"


def duck(sf_dir: str = SF):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(round(r[i], 8) if isinstance(r[i], float) else r[i] for i in order) for r in rows), key=repr)


def same(spark, query, sql: str, sf_dir: str = SF) -> None:
    df = query(spark, sf_dir)
    found = duck(sf_dir).execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(names)
    assert plain([tuple(r) for r in df.collect()], df.columns) == plain(found.fetchall(), names)
