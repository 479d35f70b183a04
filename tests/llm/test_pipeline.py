"""The stages on a small corpus with planted cases."""

import random

import corpus_pipeline


def test_stages(spark, tmp_path):
    r = random.Random(1)
    word = lambda: "".join(r.choice("abcdefghijklmno") for _ in range(r.randint(3, 8)))
    text = lambda n=90: " ".join(word() for _ in range(n)) + "."
    rows = [[i, text(), "en", "s", 0] for i in range(300)]
    item = text(30)
    rows[10][1] = rows[9][1]
    words = rows[20][1].split()
    words[40] = "changed"
    rows[21][1] = " ".join(words)
    rows[30][1] = text(20) + " " + item + " " + text(20)
    rows[40][1] += " mail me.1@mail.example.com or 4785380592391139"
    for i in range(50, 60):
        rows[i][1] = " ".join(w + "***" for w in rows[i][1].split())
    for i in range(70, 76):
        rows[i][1] += " you idiot and moron"
    spark.createDataFrame([tuple(x) for x in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(70 <= i < 76)) for i in range(0, 300, 2)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    after = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        assert name == "packing" or out.columns == docs.columns
        docs = spark.read.parquet(str(tmp_path / name))
        after[name] = docs.collect()
    ids = lambda name: {x["doc_id"] for x in after[name]}
    assert set(range(300)) - ids("quality_classifier") == {*range(50, 60), *range(70, 76)}
    assert ids("quality_classifier") - ids("simhash_near_dedup") == {10, 21}
    assert ids("simhash_near_dedup") - ids("benchmark_decontamination") == {30}
    clean = {x["doc_id"]: x["text"] for x in after["pii"]}
    assert len(clean) == len(after["benchmark_decontamination"])
    assert "me.1@" not in clean[40] and "4785380592391139" not in clean[40] and clean[41] == rows[41][1]
    assert ids("packing") == ids("pii")
    assert sum(x["length"] for x in after["packing"]) == sum({x["doc_id"]: x["doc_tokens"] for x in after["packing"]}.values())


def stages(spark, docs, folder):
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(folder)).write.parquet(str(folder / f"out-{name}"))
        docs = spark.read.parquet(str(folder / f"out-{name}"))
        yield name, docs


def test_edge_cases(spark, tmp_path):
    r = random.Random(4)
    text = lambda n=80: " ".join("".join(r.choice("abcdefghijklmno") for _ in range(r.randint(3, 8))) for _ in range(n))
    item, large, long = text(20), (1 << 53) + 1, text(40_000)
    rows = [(i, text()) for i in range(40)]
    one = text()
    odd = [(None, text()), (None, f"{text(20)} {item}"), (None, None), (50, ""), (large, text()), (large + 1, long), (60, one), (60, one), (60, text()), (61, f"{one} {item}")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, row string, doc int, kept boolean"
    docs = spark.createDataFrame([(*x, "en", "s", 0, "r", 1, True) for x in rows + odd], schema)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(20)] + [(None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item), (None, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {}
    for name, out in stages(spark, spark.read.parquet(str(tmp_path / "documents.parquet")), tmp_path):
        got[name] = out
        assert name == "packing" or out.schema == docs.schema
    ids = lambda name: sorted(x["doc_id"] or 0 for x in got[name].select("doc_id").collect())
    assert got["quality_classifier"].count() == len(rows + odd)
    # copies: two of the row 60, and the null text with the empty one
    assert ids("simhash_near_dedup") == sorted([*range(40), 0, 0, 50, large, large + 1, 60, 60, 61])
    # the hit without an id goes, the other row without an id stays
    assert ids("benchmark_decontamination") == sorted([*range(40), 0, 50, large, large + 1, 60, 60])
    assert ids("pii") == ids("benchmark_decontamination") and max(len(x["text"] or "") for x in got["pii"].collect()) == len(long)
    packed = got["packing"].where("start = 0").select("doc_id").collect()
    assert sorted(x["doc_id"] or 0 for x in packed) == ids("pii")


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for _, out in stages(spark, spark.read.parquet(str(tmp_path / "documents.parquet")), tmp_path):
        assert out.count() == 0
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
