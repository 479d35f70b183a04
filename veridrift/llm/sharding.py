"""Resharding by minimum-cost flow: near-equal shards with the fewest bytes moved.

The old layout gives every row an old shard.  The new shards have equal byte capacities.  A
minimum-cost flow from old shard sizes to new capacities (staying is free, moving costs its
bytes) says how many bytes go from each old shard to each new one; the flow is then cut into
blocks of rows, and only shards that lose or gain rows are rewritten.

How it scales.  Text is read once for its length, once for the rewriting, and once where the
result is derived from what was written.  Rows of an old shard form a
line, ordered by descending size class and by hash sub-bucket, and the sub-buckets are as many as
keep each one small, however large a hot old shard is.  The driver sees one aggregate per
sub-bucket (a few per shuffle partition), never rows, but for those rows that are larger than a
64th of a shard: there are at most 64 times the number of shards of these, and they are placed
one by one, the largest first.

Edge cases.  A null text has zero bytes and the checksum of the empty text.  Null or repeated ids
are rows like any other.  Any row counts 8 bytes besides its text, so no shard line is
degenerate.  An empty table gives an empty result.  Other columns are written along, whatever
their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veridrift.llm.scratch import materialize, scratch_path

ROW_OVERHEAD = 8
#: Rows above 1/FINE of a shard are placed singly.
FINE = 64
#: Rows up to which the plan is broadcast to the rewriting.
SMALL = 500_000
#: Sub-buckets per shuffle partition, over all old shards.
BUCKETS_PER_PARTITION = 4

RESULT = "doc_id {id}, size long, text_crc32 long, law string, shard int, slot long, grown_shard int, old_shard int, moved boolean"


def min_cost_flow(supply: list[int], demand: list[int], cost) -> dict[tuple[int, int], int]:
    """Units to send from each source to each sink at the least total ``cost(i, j)``.

    Successive shortest augmenting paths over the residual graph.  Sources and sinks are shards,
    so the graph has a few hundred edges.  The totals of supply and demand must agree.
    """
    if sum(supply) != sum(demand):
        raise ValueError("supply and demand differ")
    n, m = len(supply), len(demand)
    sent: dict[tuple[int, int], int] = {}
    left, room = list(supply), list(demand)
    while any(left):
        # Bellman-Ford from all sources that still have supply
        dist = [0 if left[i] else None for i in range(n)] + [None] * m
        came: list[int | None] = [None] * (n + m)
        changed = True
        while changed:
            changed = False
            for i in range(n):
                if dist[i] is None:
                    continue
                for j in range(m):
                    d = dist[i] + cost(i, j)
                    if dist[n + j] is None or d < dist[n + j]:
                        dist[n + j], came[n + j], changed = d, i, True
            for (i, j), units in sent.items():
                if units and dist[n + j] is not None:
                    d = dist[n + j] - cost(i, j)
                    if dist[i] is None or d < dist[i]:
                        dist[i], came[i], changed = d, n + j, True
        end = min((j for j in range(m) if room[j]), key=lambda j: (dist[n + j], j))
        path, node = [], n + end
        while came[node] is not None:
            path.append((came[node], node))
            node = came[node]
        units = min(left[node], room[end], *(sent[(b, a - n)] for a, b in path if a >= n))
        left[node] -= units
        room[end] -= units
        for a, b in path:
            if a < n:
                sent[(a, b - n)] = sent.get((a, b - n), 0) + units
            else:
                sent[(b, a - n)] -= units
    return {k: v for k, v in sent.items() if v}


def level(loads: list[int], extra: int) -> list[int]:
    """How much of ``extra`` to add to each load so that the loads become as equal as they can."""
    order = sorted(range(len(loads)), key=lambda j: (loads[j], j))
    add = [0] * len(loads)
    for k in range(len(order), 0, -1):
        low = order[:k]
        goal, rest = divmod(sum(loads[j] for j in low) + extra, k)
        if goal >= loads[low[-1]]:
            for at, j in enumerate(low):
                add[j] = goal - loads[j] + (1 if at < rest else 0)
            return add
    return add


@dataclass
class Plan:
    """What the driver decides: single rows, and for each old shard its cuts along the line."""

    single: list[tuple[int, int]]
    cuts: dict[int, list[tuple[int, int]]]
    flow: dict[tuple[int, int], int]


def plan_transfers(singles: list[tuple[int, int]], old_bytes: dict[int, int], shards: int) -> Plan:
    """``singles``: (size, old shard) of large rows, the largest first; ``old_bytes``: the rest."""
    loads = [0] * shards
    total = sum(old_bytes.values()) + sum(size for size, _ in singles)
    share = total / shards if shards else 0
    placed = []
    for size, old in singles:
        stays = old < shards and loads[old] + size <= share
        target = old if stays else min(range(shards), key=lambda j: (loads[j], j))
        loads[target] += size
        placed.append((size, target))
    olds = sorted(old_bytes)
    flow = min_cost_flow(
        [old_bytes[o] for o in olds],
        level(loads, sum(old_bytes.values())),
        lambda i, j: int(olds[i] != j),
    )
    flow = {(olds[i], j): units for (i, j), units in flow.items()}
    cuts: dict[int, list[tuple[int, int]]] = {}
    for old in olds:
        end, line = 0, []
        for j in sorted((j for o, j in flow if o == old), key=lambda j: (j != old, j)):
            end += flow[(old, j)]
            line.append((end, j))
        cuts[old] = line
    return Plan(placed, cuts, flow)


def assign(rows: DataFrame, shards: int, key: bool = False) -> DataFrame:
    """Give each row of (doc_id, size, text_crc32, old_shard) its new shard and slot.

    ``rows`` is read several times; pass a materialised table.  Slots of a shard run from 0
    without gaps.  The result has the columns of ``RESULT``, and with ``key`` the rows' column
    ``_row``, which identifies them.
    """
    spark = rows.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    own = ["_row"] if key else []
    schema = RESULT.format(id=id_type) + "".join(f", {c} {rows.schema[c].dataType.simpleString()}" for c in own)
    rows = rows.select("doc_id", "size", "text_crc32", "old_shard", *own)
    total = rows.agg(F.sum("size")).first()[0]
    if total is None:
        return spark.createDataFrame([], schema)
    large = max(1, total // (shards * FINE))
    singles = rows.where(F.col("size") > large).orderBy(F.desc("size"), "doc_id", "text_crc32", "old_shard", *own).collect()
    small = rows.where(F.col("size") <= large).withColumn("size_class", F.floor(F.log2("size")).cast("int"))

    classes = small.groupBy("old_shard", "size_class").agg(F.count("*").alias("n")).collect()
    most = max(1, sum(c["n"] for c in classes) // (BUCKETS_PER_PARTITION * partitions))
    ways = spark.createDataFrame(
        [(c["old_shard"], c["size_class"], -(-c["n"] // most)) for c in classes], "old_shard int, size_class int, ways long"
    )
    # one row per old shard and power of two: a few hundred
    small = small.join(F.broadcast(ways), ["old_shard", "size_class"]).withColumn(
        "sub", F.expr("pmod(xxhash64(doc_id, size, text_crc32), ways)")
    )
    bucket = ["old_shard", "size_class", "sub"]
    buckets = small.groupBy(*bucket).agg(F.sum("size").alias("bytes")).collect()
    buckets.sort(key=lambda b: (b["old_shard"], -b["size_class"], b["sub"]))
    old_bytes: dict[int, int] = {}
    starts = []
    for b in buckets:
        start = old_bytes.get(b["old_shard"], 0)
        starts.append((b, start))
        old_bytes[b["old_shard"]] = start + b["bytes"]
    plan = plan_transfers([(r["size"], r["old_shard"]) for r in singles], old_bytes, shards)

    lines = []
    for b, start in starts:
        inside, low = [], 0
        for end, target in plan.cuts[b["old_shard"]]:
            if end > start and low < start + b["bytes"]:
                inside.append((end, target))
            low = end
        lines.append((b["old_shard"], b["size_class"], b["sub"], start, inside))
    known = spark.createDataFrame(lines, "old_shard int, size_class int, sub long, start long, cuts array<struct<until:long,target:int>>")
    order = Window.partitionBy(*bucket).orderBy("doc_id", "size", "text_crc32", *own)
    middle = F.col("start") + F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size") / 2
    target = F.expr("coalesce(filter(cuts, c -> middle < c.until)[0].target, element_at(cuts, -1).target)")
    piece = [*bucket, "shard"]
    cut = (
        small.join(F.broadcast(known), bucket)  # a few rows per shuffle partition
        .withColumn("middle", middle)
        .withColumn("shard", target)
        .withColumn("at", F.row_number().over(Window.partitionBy(*piece).orderBy("doc_id", "size", "text_crc32", *own)))
        .select("doc_id", "size", "text_crc32", *piece, "at", *own)
    )
    cut = materialize(cut, "cut")

    next_slot = [0] * shards
    placed = []
    for r, (_, shard) in zip(singles, plan.single, strict=True):
        placed.append((r["doc_id"], r["size"], r["text_crc32"], "bytes", shard, next_slot[shard], None, r["old_shard"], r["old_shard"] != shard, *(r[c] for c in own)))
        next_slot[shard] += 1
    pieces = cut.groupBy(*piece).agg(F.count("*").alias("n")).collect()
    pieces.sort(key=lambda p: (p["old_shard"], -p["size_class"], p["sub"], p["shard"]))
    begins = []
    for p in pieces:
        begins.append((*(p[c] for c in piece), next_slot[p["shard"]]))
        next_slot[p["shard"]] += p["n"]
    begins = spark.createDataFrame(begins, "old_shard int, size_class int, sub long, shard int, begin long")
    rest = cut.join(F.broadcast(begins), piece).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("begin") + F.col("at") - 1).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "old_shard",
        (F.col("old_shard") != F.col("shard")).alias("moved"),
        *own,
    )
    return spark.createDataFrame(placed, schema).union(rest)


def measure(docs: DataFrame, old_shard: Column, *own: str) -> DataFrame:
    """(doc_id, size, text_crc32, old_shard) of every row, and the columns ``own``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        "doc_id",
        (F.octet_length(text).cast("long") + ROW_OVERHEAD).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        old_shard.cast("int").alias("old_shard"),
        *own,
    )


def reshard(docs: DataFrame, old_shard: Column, shards: int) -> DataFrame:
    """New shard and slot of every document, from its old shard: the plan alone."""
    return assign(materialize(measure(docs, old_shard), "sizes"), shards)


def rewrite_planned(docs: DataFrame, source: str, target: str, shards: int, stored_row: bool, names: dict[str, str] | None = None) -> tuple[DataFrame, list[tuple[int, str, bool]]]:
    """The plan of the stored ``docs``, with ``_row``, and (shard, path, rewritten) once written.

    ``names``: columns that are written by another name than they have here.
    """
    where = materialize(assign(materialize(measure(docs, F.col("shard"), "_row"), "sizes"), shards, key=True), "plan")
    moved = where.where("moved").select("old_shard", "shard").distinct().collect()
    affected = sorted({r["old_shard"] for r in moved} | {r["shard"] for r in moved})
    old = {r["old_shard"] for r in where.select("old_shard").distinct().collect()}
    gained = {r["shard"] for r in moved} | {r["shard"] for r in where.where("not moved").select("shard").distinct().collect()}
    if affected:
        new = where.select("_row", F.col("shard").alias("_new_shard"))
        new = F.broadcast(new) if where.count() <= SMALL else new
        stored = docs.where(F.col("shard").isin(affected)).join(new, "_row")
        kept = [c for c in docs.columns if c != "shard" and (c != "_row" or stored_row)]
        stored.select(*[F.col(f"`{c}`").alias((names or {}).get(c, c)) for c in kept], F.col("_new_shard").alias("shard")).write.partitionBy("shard").parquet(target)
    full = [s for s in range(shards) if s in gained]
    return where, [(s, f"{target if s in affected else source}/shard={s}", s in affected) for s in full]


def rewrite_shards(spark: SparkSession, source: str, target: str, shards: int) -> DataFrame:
    """Reshard a table stored as ``source/shard=K/``; write what changes below ``target``.

    Rows are told apart by their place in the files, so null and repeated ids are rows like any
    other.  Only old shards that lose rows and new shards that gain rows are rewritten.  Returns
    (shard, path, rewritten): where each new shard that has rows now is.
    """
    docs = spark.read.parquet(source)
    place = F.concat_ws("#", F.col("_metadata.file_path"), F.col("_metadata.row_index").cast("string"))
    own = {c: unused("document_row", docs.columns) for c in docs.columns if c.lower() == "_row"}
    named = docs.select(*docs.columns, place.alias("_place")) if not own else docs.select(*docs.columns, place.alias("_place")).withColumnsRenamed(own)
    _, manifest = rewrite_planned(named.withColumnRenamed("_place", "_row"), source, target, shards, False, {new: old for old, new in own.items()})
    return spark.createDataFrame(manifest, "shard int, path string, rewritten boolean")


def unused(name: str, columns: list[str]) -> str:
    """``name``, with as many underscores as make it differ from all ``columns``."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def reshard_files(docs: DataFrame, old_shard: Column, shards: int) -> DataFrame:
    """Lay out the old shards as files, rewrite the affected ones, and read all new shards back.

    The columns of ``RESULT``; ids, sizes, checksums and shards are those of the files.
    """
    spark = docs.sparkSession
    if docs.isEmpty():
        return reshard(docs, old_shard, shards)
    source, target = scratch_path(spark, "old-shards"), scratch_path(spark, "new-shards")
    free = [F.col(f"`{c}`").alias(c if c.lower() not in ("shard", "_row") else unused(f"document_{c}", docs.columns)) for c in docs.columns]
    laid = docs.select(*free, F.monotonically_increasing_id().alias("_row"), old_shard.cast("int").alias("shard"))
    laid.write.option("compression", "zstd").partitionBy("shard").parquet(source)
    where, manifest = rewrite_planned(spark.read.parquet(source), source, target, shards, True)
    found = None
    for base in (source, target):
        paths = [path for _, path, _ in manifest if path.startswith(base + "/")]
        if paths:
            read = measure(spark.read.option("basePath", base).parquet(*paths), F.col("shard"), "_row").withColumnRenamed("old_shard", "shard")
            found = read if found is None else found.union(read)
    where = where.drop("doc_id", "size", "text_crc32", "shard")
    return found.join(where, "_row").select(*[c.split(" ")[0] for c in RESULT.split(", ")])
