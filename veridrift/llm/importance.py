"""Importance resampling towards a target, on hashed word n-grams counted by DuckDB.

Each task holds a DuckDB of its own in memory.  For a part of its rows, SQL splits texts into
words, unnests them with their places, makes the longer n-grams by a window over the words of a
row, and hashes every n-gram with a registered function (CRC-32 modulo the number of buckets).  So a task gives the counts of buckets of each row, and, at its end, those of all its
rows.  Spark writes both to the shared folder, adds the tasks' counts up, makes the gain of each
bucket, and scores every row from its own counts, without a second look at the texts.

Scores are a mean gain of the row's n-grams plus Gumbel noise that depends on its id, so the
highest ones are a draw without replacement in proportion to the weights.  Ranks need no task that
sees all rows: scores are whole numbers of a bounded range (gains and noise are logarithms), so a
histogram of them is bounded too; it gives the score at which the draw ends and the first rank of
each score, and rows of one score are numbered among themselves.

How it scales.  Texts are read once and not shuffled; counts are a few bytes for each different
n-gram of a row; a task sends one row of bucket totals.  What is broadcast is one row of gains, by
the number of buckets, and the histogram, by the range of scores.

Edge cases.  A null or empty text, or one without words, has no n-grams: weight 0.  A row without
an id gets no noise: its score and rank are null, and it isn't among the rows drawn from.  Repeated
rows score alike and stand one after the other.  An empty target has no counts, an empty table
gives an empty result.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veridrift.llm.batches import release, slices
from veridrift.llm.scratch import materialize

BUCKETS, LONGEST, SEED = 10_000, 2, 7
#: Rows and bytes that DuckDB counts at once; a longer text is counted alone.
ROWS, BYTES = 512, 1 << 20
#: Parts after which a task takes a new DuckDB, as one keeps what it has allocated.
FRESH = 4
#: Words of a text, lower-cased in ASCII only: whatever lies between these bytes.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
COUNTED = "id long, words long, features long, buckets array<int>, counts array<long>, total boolean"


def counting_sql(longest: int) -> str:
    """Rows (r, words, features, buckets, counts) of the texts in ``part`` (r, text), in order of r; buckets are in order."""
    gram = lambda k: " || ' ' || ".join(["w", *[f"w{i}" for i in range(1, k)]])
    hashed = " UNION ALL ".join(f"SELECT r, bucket_of({gram(k)}) AS bucket FROM placed" + f" WHERE w{k - 1} IS NOT NULL" * (k > 1) for k in range(1, longest + 1))
    leads = "".join(f", lead(w, {i}) OVER text_words AS w{i}" for i in range(1, longest))
    return f"""
WITH split AS (SELECT r, list_filter(regexp_split_to_array(translate(text, '{UPPER}', '{LOWER}'), '{SEPARATORS}'), lambda x: x <> '') AS ws FROM part),
words AS (SELECT r, unnest(ws) AS w, unnest(range(len(ws))) AS place FROM split),
placed AS (SELECT r, w{leads} FROM words WINDOW text_words AS (PARTITION BY r ORDER BY place)),
hashed AS ({hashed}),
filled AS (SELECT r, bucket, count(*) AS n FROM hashed GROUP BY ALL),
listed AS (SELECT r, sum(n)::bigint AS features, list(bucket ORDER BY bucket) AS buckets, list(n ORDER BY bucket) AS counts FROM filled GROUP BY r)
SELECT r, len(ws)::bigint AS words, coalesce(features, 0)::bigint AS features, coalesce(buckets, []) AS buckets, coalesce(counts, []) AS counts
FROM split LEFT JOIN listed USING (r) ORDER BY r"""


def connection(buckets: int):
    """A DuckDB in memory, on one thread and without files, that knows ``bucket_of``."""
    import duckdb

    db = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})

    def bucket_of(grams):
        grams = grams.combine_chunks() if isinstance(grams, pa.ChunkedArray) else grams
        crcs = np.fromiter(map(zlib.crc32, grams.cast(pa.binary()).to_numpy(zero_copy_only=False)), dtype=np.int64, count=len(grams))
        return pa.array((crcs % buckets).astype(np.int32))

    db.create_function("bucket_of", bucket_of, ["VARCHAR"], "INTEGER", type="arrow")
    return db


def counted(rows: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """The counts of every row of (id, text), and a row ``total`` for each task."""
    sql = counting_sql(longest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        db, counts = connection(buckets), itertools.count(1)
        names = ["id", "words", "features", "buckets", "counts", "total"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.bool_()]
        sums = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for piece in slices(batch, ROWS, BYTES):
                texts = piece.column("text").fill_null("")
                part = pa.table([pa.array(np.arange(len(texts))), texts], ["r", "text"])
                db.register("part", part)
                made = db.sql(sql).to_arrow_table().combine_chunks()
                db.unregister("part")
                if next(counts) % FRESH == 0:
                    db.close()
                    release()
                    db = connection(buckets)
                columns = [made.column(c).combine_chunks().cast(k) for c, k in zip(names[1:5], kinds[1:5], strict=True)]
                np.add.at(sums, columns[2].flatten().to_numpy(zero_copy_only=False), columns[3].flatten().to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays([piece.column("id"), *columns, pa.array([False] * len(texts))], names)
        at = np.flatnonzero(sums)
        last = [[None], [0], [int(sums.sum())], [at.astype(np.int32)], [sums[at]], [True]]
        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(last, kinds, strict=True)], names)
        db.close()
        release()

    return rows.select(F.col("id").cast("long").alias("id"), "text").mapInArrow(run, COUNTED)


def totals(counts: DataFrame) -> DataFrame:
    """(bucket, n): the tasks' totals added up; a row for each bucket at most."""
    return counts.where("total").select(F.explode(F.arrays_zip("buckets", "counts")).alias("x")).groupBy(F.col("x.buckets").alias("bucket")).agg(F.sum("x.counts").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """One row: ``gains``, an array with the gain of each bucket, from the bucket totals of both sides."""
    spark = source.sparkSession
    both = spark.range(buckets).withColumnRenamed("id", "bucket").join(source.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left").fillna(0, ["s", "t"])
    listed = both.agg(F.array_sort(F.collect_list(F.struct("bucket", "s", "t"))).alias("x"), F.sum("s").cast("double").alias("all_s"), F.sum("t").cast("double").alias("all_t"))

    def gain(x: Column) -> Column:
        s, t = x["s"].cast("double"), x["t"].cast("double")
        return F.floor(1000 * F.log((t + 1) * (F.col("all_s") + buckets) / ((s + 1) * (F.col("all_t") + buckets))))

    return listed.select(F.transform("x", gain).alias("gains"))


def noise(doc: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, from a hash of the id that every engine has."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), doc.cast("string")), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h.cast("double") + 0.5) / 4294967296.0)))


def ranked(scored: DataFrame, eligible: Column, percent: int) -> DataFrame:
    """``scored`` with ``rank``: 1, 2, ... for floor(percent * N / 100) of the N eligible rows, by score down and id up."""
    may = eligible & F.col("score").isNotNull()
    spark = scored.sparkSession
    histogram = scored.where(may).groupBy("score").count().orderBy(F.desc("score")).collect()  # bounded by the range of scores
    drawn = sum(r["count"] for r in histogram) * percent // 100
    firsts, before = [], 0
    for r in histogram:
        if before >= drawn:
            break
        firsts.append((r["score"], before))
        before += r["count"]
    if not firsts:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    starts = F.broadcast(spark.createDataFrame(firsts, "score long, before long"))
    # rows that can't be drawn are numbered by themselves, dealt by their ids
    lot = F.when(may & (F.col("score") >= firsts[-1][0]), F.lit(0)).otherwise(1 + F.pmod(F.xxhash64("doc_id", "weight", "n_features"), F.lit(1 << 20)))
    lots = scored.withColumn("_may", lot)
    drawable = lots.where("_may = 0").join(starts, "score")
    place = F.row_number().over(Window.partitionBy("score").orderBy("doc_id")) + F.col("before")
    named = drawable.withColumn("rank", F.when(place <= drawn, place).cast("long")).drop("before")
    rest = lots.where("_may > 0").withColumn("rank", F.lit(None).cast("long"))
    return named.unionByName(rest).drop("_may")


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, buckets: int = BUCKETS, longest: int = LONGEST, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of every row of ``docs`` (doc_id, text); ``target`` has (text)."""
    source = materialize(counted(docs.select(F.col("doc_id").alias("id"), "text"), buckets, longest), "buckets")
    wanted = materialize(counted(target.select(F.lit(None).cast("long").alias("id"), "text"), buckets, longest), "buckets")
    table = gains(totals(source), totals(wanted), buckets)
    rows = source.where("not total").crossJoin(F.broadcast(table))  # one row
    summed = F.aggregate(F.zip_with("buckets", "counts", lambda b, n: F.get("gains", b) * n), F.lit(0).cast("long"), lambda a, x: a + x)
    mean = F.when(F.col("features") == 0, F.lit(0).cast("long")).otherwise(F.expr("(summed - pmod(summed, features)) div features"))
    weighed = rows.withColumn("summed", summed).select(F.col("id").alias("doc_id"), F.col("words").alias("n_words"), F.col("features").alias("n_features"), mean.alias("weight"))
    scored = materialize(weighed.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "scores")
    return ranked(scored, F.col("n_words") >= least_words, percent).select("doc_id", "n_words", "n_features", "weight", "score", "rank")
