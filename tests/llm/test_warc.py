"""WARC round trips, with magic inside payloads and split files."""

import hashlib

import pytest

from veridrift.llm import warc


def expected(rows):
    first = {}
    for page, _, html in rows:
        b = (html or "").encode()
        if len(b) >= warc.REVISIT_FROM and page is not None:
            first[b] = min(page, first.get(b, page))
    out = []
    for page, _, html in rows:
        b = (html or "").encode()
        again = len(b) >= warc.REVISIT_FROM and b in first and first[b] != page
        out.append((page, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first[b] if again else None))
    return sorted(out, key=repr)


FAKE = (
    "x\r\n\r\nWARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:666>\r\nWARC-Payload-Digest: sha256:0\r\n"
    "Content-Length: 4\r\n\r\nabcd\r\n\r\nWARC/1.0\r\nnot a header\r\n\r\n"
)


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_round_trip(spark, tmp_path, compression):
    long = "é" * 5000
    rows = [
        (1, "http://a", "<p>one</p>"), (2, "http://b", long), (3, "http://c", long), (4, None, None), (5, "http://e", ""), (6, "a\r\nb", FAKE),
        (7, "http://g", FAKE * 40), (8, "http://h", "WARC/1.0\r\n"), (9, "http://i", "end WARC/1.0\r\n"), (10, "http://j", FAKE * 40), (11, "u", "short"), (12, "u", "short"),
    ]
    rows += [(100 + i, f"http://x/{i}", f"page {i} " * (i % 50)) for i in range(200)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumnRenamed("url", "url").repartition(3)
    warc.write_archives(df, str(tmp_path / "w"), compression)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
    try:
        got = warc.read_archives(spark, str(tmp_path / "w")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert all(r["verified"] for r in got)
    found = sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got), key=repr)
    assert found == expected(rows)


def test_null_ids_and_repeats(spark):
    text = "z" * 200
    rows = [(None, "u", text), (3, "u", text), (3, "u", text), (9, None, text)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, payload int")
    got = sorted(((r["page_id"], r["record_type"], r["refers_to"]) for r in warc.round_trip(df).collect()), key=repr)
    assert got == sorted([(None, "revisit", 3), (3, "response", None), (3, "response", None), (9, "revisit", 3)], key=repr)


def test_empty_table(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.round_trip(df).count() == 0
