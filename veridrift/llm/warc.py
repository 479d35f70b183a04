"""WARC archives: writing with revisit records, and reading by boundary-chain verification.

Reading splits the archives at the record magic wherever it stands, also inside payloads.  Each
task turns its fragments into candidates: the offset of a magic, and the offset at which the next
record must start if this one is real, from its headers.  Pointer jumping from the start of each
file keeps the candidates that the chain reaches; every other magic was payload, and its fragment
is joined to the record that it stands in.

How it scales.  Files are split like any text, so a file is read by many tasks; their fragment
lengths, summed by split, give offsets in the file.  Jumping doubles the reach with each round,
so the rounds grow with the logarithm of the records in a file, over tables without payloads.
Payloads are moved again only for records that hold a magic.  Equal payloads meet by digest with
partial minima, and the join back to the pages can be split where one payload is very common.

Edge cases.  A null html is an empty payload.  A null url is left out, and control characters in
a url are percent-encoded.  Payloads under ``REVISIT_FROM`` bytes are never revisits.  Repeated
rows of the smallest page are all responses; null page ids are written empty and refer like any
other page.  A file that doesn't start with a record has none.  Empty tables give an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veridrift.llm.scratch import materialize, scratch_path

# Fixed values of the format
VERSION = "WARC/1.0"
CRLF = "\r\n"
MAGIC = VERSION + CRLF
#: Ids as the writer makes them.
URN = re.compile(r"<urn:page:(-?[0-9]{1,19})?>", re.ASCII)
#: Payloads of fewer bytes are always stored.
REVISIT_FROM = 100
DATE = "2024-01-01T00:00:00Z"

PARSED = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, verified boolean"
FRAGMENTS = f"file string, block long, local long, octets long, delta long, whole boolean, {PARSED}"


def with_types(pages: DataFrame) -> DataFrame:
    """Pages with payload, its size and digest, and whether a smaller page has the same."""
    payload = F.coalesce("html", F.lit(""))
    sized = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        "url",
        payload.alias("payload"),
        F.octet_length(payload).cast("long").alias("payload_bytes"),
        F.sha2(payload.cast("binary"), 256).alias("payload_digest"),
    )
    first = sized.where(F.col("payload_bytes") >= REVISIT_FROM).groupBy("payload_digest")
    first = first.agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return sized.join(first, "payload_digest", "left").withColumn("again", again)


def write_archives(pages: DataFrame, path: str, compression: str = "gzip") -> None:
    """One record per page in files below ``path``; revisits carry headers only.

    A compressed file is read by one task; files are as large as what a task writes.  With
    ``compression`` "none" a file is split when read.
    """
    typed = with_types(pages)
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    safe = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    header = lambda name, value: F.concat(F.lit(name + ": "), value, F.lit(CRLF))
    size = F.col("payload_bytes").cast("string")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), size, F.lit(CRLF + CRLF))
    block = F.concat(http, F.when(F.col("again"), F.lit("")).otherwise(F.col("payload")))
    record = F.concat(
        F.lit(MAGIC),
        header("WARC-Type", F.when(F.col("again"), F.lit("revisit")).otherwise(F.lit("response"))),
        header("WARC-Record-ID", urn("page_id")),
        header("WARC-Date", F.lit(DATE)),
        F.coalesce(header("WARC-Target-URI", safe), F.lit("")),
        header("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
        F.when(F.col("again"), header("WARC-Refers-To", urn("first"))).otherwise(F.lit("")),
        header("Content-Type", F.lit("application/http; msgtype=response")),
        header("Content-Length", F.octet_length("block").cast("string")),
        F.lit(CRLF),
        F.col("block"),
        F.lit(CRLF),
    )
    # the writer ends each line with the second of the two line ends after a block
    typed.withColumn("block", block).select(record.alias("value")).write.option("lineSep", CRLF).option("compression", compression).text(path)


def parse_record(content: bytes) -> tuple[int | None, tuple | None]:
    """Bytes from the magic to the next record, and the record's fields.

    ``content`` follows a magic.  The first is None where no record head can be read; the fields
    are None where the block isn't all there, or where ids and sizes aren't of the writer's form,
    as in a record that a page quotes.
    """
    head, found, _ = content.partition(b"\r\n\r\n")
    if not found:
        return None, None
    fields: dict[str, str] = {}
    for line in head.split(b"\r\n"):
        name, colon, value = line.partition(b": ")
        if not colon:
            return None, None
        fields[name.decode("utf-8", "replace").lower()] = value.decode("utf-8", "replace")
    length = fields.get("content-length", "")
    if not re.fullmatch(r"[0-9]{1,18}", length, re.ASCII) or "warc-type" not in fields or "warc-record-id" not in fields:
        return None, None
    begin = len(head) + 4
    end = begin + int(length)
    delta = len(MAGIC) + end + 4
    if content[end : end + 4] != b"\r\n\r\n":
        return delta, None
    block = content[begin:end]
    http, _, payload = block.partition(b"\r\n\r\n")
    stated = next((x.split(b": ", 1)[1] for x in http.split(b"\r\n") if x.lower().startswith(b"content-length: ")), b"")
    digest = fields.get("warc-payload-digest", "").removeprefix("sha256:")
    ids = [URN.fullmatch(fields[name]) for name in ("warc-record-id", "warc-refers-to") if name in fields]
    ids = [m and (int(m[1]) if m[1] else None, m) for m in ids]
    if not all(ids) or any(x is not None and not -(1 << 63) <= x < 1 << 63 for x, _ in ids) or not re.fullmatch(rb"[0-9]{0,18}", stated):
        return delta, None
    if fields["warc-type"] == "revisit":
        size, own = int(stated or 0), digest
    else:
        size, own = len(payload), hashlib.sha256(payload).hexdigest()
    return delta, (
        ids[0][0],
        fields.get("warc-target-uri"),
        size,
        own,
        fields["warc-type"],
        ids[1][0] if len(ids) > 1 else None,
        own == digest,
    )


def fragments(spark: SparkSession, path: str, content: bool = False) -> DataFrame:
    """What stands between magics, with its place in its split of a file and what it parses to.

    With ``content`` the bytes come with it.
    """
    text = spark.read.option("lineSep", MAGIC).text(path)
    text = text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("content"))
    empty = (None,) * 7
    with_content = content
    schema = FRAGMENTS + (", content binary" if with_content else "")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.rsplit(" ", 1)[0] for x in schema.split(", ")]
        split, local = None, 0
        for pdf in frames:
            out = []
            for file, block, content in zip(pdf["file"], pdf["block"], pdf["content"], strict=True):
                if split != (file, block):
                    split, local = (file, block), 0
                content = bytes(content)
                delta, fields = parse_record(content)
                whole = fields is not None and delta == len(content) + len(MAGIC)
                out.append((file, block, local, len(content), delta, whole, *(fields if whole else empty), *([content] if with_content else [])))
                local += len(content) + len(MAGIC)
            made = pd.DataFrame(out, columns=names)
            for name in ("delta", "page_id", "payload_bytes", "refers_to"):
                made[name] = made[name].astype("Int64")
            yield made

    return text.mapInPandas(run, schema)


def reachable(candidates: DataFrame) -> DataFrame:
    """(file, start) of the candidates (file, start, next) on the chain from offset 0 of each file."""
    reach = materialize(candidates.where("start = 0").select("file", "start"), "reach")
    jumps = candidates.where("next > start").select("file", "start", "next")
    known = reach.count()
    while True:
        ahead = reach.join(jumps, ["file", "start"]).select("file", F.col("next").alias("start"))
        new = ahead.join(candidates.select("file", "start"), ["file", "start"], "left_semi")
        reach = materialize(reach.union(new).distinct(), "reach")
        now = reach.count()
        if now == known:
            return reach
        known = now
        second = jumps.select("file", F.col("start").alias("next"), F.col("next").alias("after"))
        jumps = materialize(jumps.join(second, ["file", "next"]).select("file", "start", F.col("after").alias("next")), "jumps")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the archives below ``path``; the columns of ``PARSED``."""
    parts = materialize(fragments(spark, path), "fragments")
    files = materialize(parts.select("file").distinct().withColumn("number", F.monotonically_increasing_id()), "files")
    splits = parts.groupBy("file", "block").agg(F.sum(F.col("octets") + len(MAGIC)).alias("length"))
    before = F.sum("length").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    splits = splits.select("file", "block", F.coalesce(before, F.lit(0)).alias("base")).join(files, "file")
    splits = materialize(splits, "splits")
    start = F.col("base") + F.col("local") - len(MAGIC)
    fields = [x.split(" ")[0] for x in PARSED.split(", ")]
    placed = parts.join(splits, ["file", "block"]).withColumn("start", start).where("start >= 0")
    placed = placed.select(F.col("number").alias("file"), "start", "delta", "whole", F.struct("file", "block", "local").alias("place"), *fields)
    candidates = materialize(placed.select("file", "start", (F.col("start") + F.col("delta")).alias("next")), "candidates")
    reach = reachable(candidates)

    # Records that hold a magic: their fragments run up to the next record, and are read again.
    real = placed.join(reach, ["file", "start"])
    marked = candidates.select("file", "start").join(reach.withColumn("real", F.lit(True)), ["file", "start"], "left")
    order = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, 0)
    owner = F.last(F.when(F.col("real"), F.col("start")), ignorenulls=True).over(order)
    owned = materialize(marked.withColumn("owner", owner).where("owner is not null"), "owned")
    broken = owned.where("owner != start").select("file", "owner")
    broken = materialize(broken.union(real.where("not whole").select("file", F.col("start").alias("owner"))).distinct(), "broken")
    plain = real.where("whole").join(broken.select("file", F.col("owner").alias("start")), ["file", "start"], "left_anti").select(*fields)
    if broken.isEmpty():
        return plain
    pieces = owned.join(broken, ["file", "owner"]).join(placed.select("file", "start", "place"), ["file", "start"])
    pieces = materialize(pieces.select("place.*", F.col("file").alias("number"), "owner", "start"), "pieces")
    contents = fragments(spark, path, content=True).select("file", "block", "local", "content").join(pieces, ["file", "block", "local"])

    def mend(frames: pd.DataFrame) -> pd.DataFrame:
        whole = MAGIC.encode().join(bytes(x) for x in frames.sort_values("start")["content"])
        _, got = parse_record(whole)
        made = pd.DataFrame([got] if got else [], columns=fields)
        for name in ("page_id", "payload_bytes", "refers_to"):
            made[name] = made[name].astype("Int64")
        return made

    return plain.union(contents.groupBy("number", "owner").applyInPandas(mend, PARSED))


def round_trip(pages: DataFrame) -> DataFrame:
    """Write all pages to archives in the shared folder, and read them back."""
    spark = pages.sparkSession
    path = scratch_path(spark, "archives")
    write_archives(pages, path)
    return read_archives(spark, path)
