"""Pages that quote whole records of other writers."""

import hashlib

import pytest

from veridrift.llm import warc

QUOTED = (
    "see\r\n\r\nWARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: {id}\r\nWARC-Refers-To: {to}\r\nWARC-Payload-Digest: sha256:0\r\n"
    "Content-Length: {n}\r\n\r\n{block}\r\n\r\nand more"
)


def quoted(kind="response", id="<urn:page:6>", to="<urn:page:7>", block="abcd", n=None):  # noqa: A002
    return QUOTED.format(kind=kind, id=id, to=to, block=block, n=len(block) if n is None else n)


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_quoted_records_are_payload(spark, tmp_path, compression):
    uuid = "<urn:uuid:f81d4fae-7dec-11d0-a765-00a0c91e6bf6>"
    pages = [quoted(id=uuid), quoted(to=uuid), quoted(id="<urn:page:1_0>"), quoted(id="<urn:page:" + "9" * 19 + ">"), quoted(n="9" * 5000)]
    pages += [quoted(kind="revisit", block="HTTP/1.1 200 OK\r\nContent-Length: " + n + "\r\n\r\n") for n in ("many", "-1", "9" * 30)]
    pages += [quoted(id=uuid) + "\r\n\r\n" + quoted(kind="request", id=uuid), "plain"]
    df = spark.createDataFrame([(i, "u", t) for i, t in enumerate(pages)], "page_id long, url string, html string")
    warc.write_archives(df, str(tmp_path / "w"), compression)
    got = warc.read_archives(spark, str(tmp_path / "w")).collect()
    want = [(i, len(t), hashlib.sha256(t.encode()).hexdigest(), True) for i, t in enumerate(pages)]
    assert sorted((r["page_id"], r["payload_bytes"], r["payload_digest"], r["verified"]) for r in got) == want
