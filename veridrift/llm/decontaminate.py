"""Benchmark decontamination with a positional inverted index, in DataFrame operations only.

The words of all documents that also occur in the benchmark are stored as postings (term,
document, position), each segment of the index sorted by term.  The index gives the frequency of
every benchmark term.  For each window of an item the rarest term is the anchor; its postings,
less the anchor's place in the item, are the possible alignments of item and document.  The lists
of the item's other terms, adjusted by their own offsets, are intersected with those alignments,
and a run of consecutive matches as long as a window is an exact occurrence.

How it scales.  The documents are tokenised once, and what follows reads the index alone, which
has no text.  A common word costs postings, spread over the tasks that read it, but never a
meeting of all of them: only the rarest term of a window is looked up before anything else.
Tables of the benchmark are broadcast only when counted and below ``SMALL`` rows; beyond that the
same joins are shuffled.  Joins on alignments are keyed by document, so a passage that stands in
very many documents is spread like the documents.

Edge cases.  A null or empty text has no words, no hits and no items.  An item without words has
no window; one of fewer words than a window is one window.  Rows with a null or repeated
``doc_id`` are told apart by an inner row number.  Null item ids are counted, but not named in
the digest.  Empty tables give empty results, or no hits.  Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veridrift.llm.scratch import materialize, owned

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Between words: ASCII but digits and lower-case letters.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Rows up to which a table of the benchmark is broadcast.
SMALL = 200_000


def pieces(text: Column) -> Column:
    """Words in order; the first and the last piece may be empty."""
    return F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BETWEEN)


def text_digest(text: Column) -> Column:
    """64 bits of a text; a null one counts as empty."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def near(df: DataFrame) -> DataFrame:
    """``df``, to be broadcast if it has few rows; ``df`` is a stored table, so counting is cheap."""
    return F.broadcast(df) if df.count() <= SMALL else df


def item_words(items: DataFrame) -> DataFrame:
    """(item, item_id, p, word, n): the words of every item in order, ``item`` a row number."""
    words = F.filter(pieces(F.col("text")), lambda w: w != "")
    listed = items.select(F.monotonically_increasing_id().alias("item"), F.col("item_id").cast("string").alias("item_id"), words.alias("words"))
    return listed.select("item", "item_id", F.size("words").alias("n"), F.posexplode("words").alias("p", "word"))


def build_index(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Postings (row, at, term) of the terms in ``vocabulary`` (word, term), and a row per document.

    The document's row has ``at`` 0, its doc_id, n_words and the digest of its text; its term is
    null unless the first piece is a term itself.
    """
    split = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", text_digest(F.col("text")).alias("digest"), pieces(F.col("text")).alias("words"))
    n = F.size("words") - F.when(F.col("words")[0] == "", 1).otherwise(0)
    n = n - F.when((F.size("words") > 1) & (F.element_at("words", -1) == ""), 1).otherwise(0)
    split = split.select("row", "doc_id", "digest", n.cast("long").alias("n_words"), F.posexplode("words").alias("at", "word"))
    marked = split.join(near(vocabulary), "word", "left").where((F.col("at") == 0) | F.col("term").isNotNull())
    first = F.col("at") == 0
    stored = marked.select(
        "row",
        F.when(first, F.col("doc_id")).alias("doc_id"),
        F.when(first, F.col("n_words")).alias("n_words"),
        F.when(first, F.col("digest")).alias("digest"),
        "at",
        "term",
    )
    return materialize(stored.sortWithinPartitions("term", "row", "at"), "index")


def anchors(places: DataFrame, frequency: DataFrame, window: int) -> DataFrame:
    """(item, p, term): for each window the place of its rarest term; none where a term is missing."""
    counted = places.join(frequency, "term", "left").select("item", "n", "p", "term", F.coalesce("n_postings", F.lit(0)).alias("f"))
    length = F.least(F.lit(window), F.col("n"))
    first = F.greatest(F.lit(0), F.col("p") - length + 1)
    last = F.least(F.col("p"), F.col("n") - length)
    of_windows = counted.select("item", "p", "term", "f", F.explode(F.sequence(first, last)).alias("s"))
    rarest = of_windows.groupBy("item", "s").agg(F.min(F.struct("f", "p", "term")).alias("least"))
    return rarest.where("least.f > 0").select("item", "least.p", "least.term").distinct()


def occurrences(docs: DataFrame, benchmark: DataFrame, window: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The index, the items' places, and (row, item, start, length) of exact phrase matches.

    A match is a maximal run of item words in a document that is at least a window long.
    """
    words = materialize(item_words(benchmark), "item-words")
    vocabulary = materialize(words.select("word").distinct().withColumn("term", F.monotonically_increasing_id()), "vocabulary")
    places = materialize(words.join(near(vocabulary), "word").select("item", "item_id", "n", "p", "term"), "places")
    index = build_index(docs, vocabulary)
    postings = index.where(F.col("term").isNotNull()).select("row", "at", "term")

    frequency = materialize(postings.groupBy("term").agg(F.count("*").alias("n_postings")), "frequency")
    chosen = materialize(anchors(places, frequency, window), "anchors")
    aligned = postings.join(near(chosen), "term").select("row", "item", (F.col("at") - F.col("p")).alias("shift")).distinct()
    aligned = materialize(aligned, "alignments")

    wanted = aligned.join(near(places.select("item", "n", "p", "term")), "item").select(
        "row", "item", "shift", "n", "p", "term", (F.col("shift") + F.col("p")).alias("at")
    )
    rows = materialize(aligned.select("row").distinct(), "rows")
    listed = postings.join(near(rows), "row", "left_semi")
    matched = wanted.join(listed, ["row", "at", "term"]).select("row", "item", "shift", "n", "p")
    run = F.col("p") - F.row_number().over(Window.partitionBy("row", "item", "shift").orderBy("p"))
    runs = (
        matched.withColumn("run", run)
        .groupBy("row", "item", "shift", "n", "run")
        .agg(F.min("p").alias("p"), F.count("*").alias("length"))
        .where(F.col("length") >= F.least(F.lit(window), F.col("n")))
        .select("row", "item", (F.col("shift") + F.col("p")).alias("start"), F.col("length").cast("int").alias("length"))
    )
    return index, places, materialize(runs, "runs")


def proximity(docs: DataFrame, terms: list[str], within: int) -> DataFrame:
    """(doc_id, start, end): spans of at most ``within`` words that hold all ``terms``.

    Each span starts at an occurrence of the rarest term's nearest companions; positions count
    words from 0.  The terms are distinct lower-case words.
    """
    spark = docs.sparkSession
    wanted = sorted(set(terms))
    vocabulary = materialize(spark.createDataFrame([(w, i) for i, w in enumerate(wanted)], "word string, term long"), "terms")
    index = build_index(docs, vocabulary)
    names = index.where("at = 0").select("row", "doc_id")
    postings = materialize(index.where(F.col("term").isNotNull()).select("row", "at", "term"), "postings")
    lists = {i: postings.where(F.col("term") == i) for i in range(len(wanted))}
    order = sorted(lists, key=lambda i: (lists[i].count(), i))
    found = lists[order[0]].select("row", F.col("at").alias("low"), F.col("at").alias("high"))
    for i in order[1:]:
        more = lists[i].select("row", F.col("at"))
        # equal blocks of ``within`` words, or neighbouring ones, hold every pair in reach
        block = F.floor(F.col("low") / within)
        found = found.select("row", "low", "high", F.explode(F.array(block - 1, block, block + 1)).alias("block"))
        more = more.withColumn("block", F.floor(F.col("at") / within))
        found = (
            found.join(more, ["row", "block"])
            .select("row", F.least("low", "at").alias("low"), F.greatest("high", "at").alias("high"))
            .where(F.col("high") - F.col("low") < within)
            .distinct()
        )
    return found.join(names, "row").select("doc_id", F.col("low").alias("start"), F.col("high").alias("end"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int) -> DataFrame:
    """Per document: words, words in occurrences of windows, items found, and their digest."""
    index, places, runs = occurrences(docs, benchmark, window)
    covered = runs.select("row", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("length") - 1)).alias("at")).distinct()
    hits = covered.groupBy("row").agg(F.count("*").alias("n_hit"))
    named = runs.select("row", "item").distinct().join(near(places.select("item", "item_id").distinct()), "item")
    found = named.groupBy("row").agg(F.array_sort(F.collect_set("item_id")).alias("ids")).withColumn("n_items", F.size("ids").cast("long"))
    known = hits.join(found, "row")
    zero = F.lit(0).cast("long")
    return (
        index.where("at = 0")
        .select("row", "doc_id", "n_words")
        .join(known, "row", "left")
        .select(
            "doc_id",
            "n_words",
            F.coalesce("n_hit", zero).alias("n_hit"),
            F.coalesce("n_items", zero).alias("n_items"),
            F.sha2(F.coalesce(F.array_join("ids", ","), F.lit("")), 256).alias("items_sha256"),
            F.col("n_hit").isNotNull().alias("contaminated"),
        )
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame, window: int) -> DataFrame:
    """The rows without a hit, with all their columns.

    A row's own text decides: rows with one id, or none, are judged apart by the digest of their text.
    """
    with owned() as mine:
        index, _, runs = occurrences(docs, benchmark, window)
        hit = index.where("at = 0").join(runs.select("row").distinct(), "row", "left_semi")
        found = materialize(hit.select(F.col("doc_id").alias("found_id"), F.col("digest").alias("found")).distinct(), "contaminated")
        same = docs["doc_id"].eqNullSafe(found["found_id"]) & (text_digest(docs["text"]) == found["found"])
        clean = docs.join(near(found), same, "left_anti")
        mine.sweep(docs.sparkSession, clean)
    return clean
