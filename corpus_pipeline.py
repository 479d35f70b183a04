"""A corpus pipeline of five stages over documents.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written, and read again as
the next stage's documents.  The first four return the columns of documents: what a stage rejects
is gone, and what it rewrites is rewritten.  The last returns the packed pieces.  A stage begins
by removing the scratch tables of this pipeline's stages before it, but for those that its documents read.

Edge cases.  Stages judge rows, not ids: rows without an id are kept or rejected by their texts,
and stay without one; of rows alike in a group of near-duplicates one stays.  Null and empty texts
aren't junk, are copies of one another, have no hits and nothing to replace, and are packed as the
end id alone.  Very long texts are taken whole.  Empty tables stay empty through all stages.  Other
columns pass through the first four stages, whatever their names.
"""

from __future__ import annotations

import functools
import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridrift.llm import decontaminate, near_duplicates, packing, pii, quality_classifier
from veridrift.llm.queries import PII_KEY, TOKENIZER
from veridrift.llm.scratch import materialize, owned
from veridrift.sources.tables import Tables

#: The scratch tables of the pipeline that runs in this thread.
_running = threading.local()

#: Words of a benchmark window.
WINDOW = 10


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _stage(work: Stage) -> Stage:
    """``work`` after the tables of earlier stages are gone; the first stage begins anew."""

    @functools.wraps(work)
    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if work.__name__ == "classify":
            _running.tables = Tables()
        tables = _tables()
        tables.sweep(spark, docs)
        with owned() as mine:
            out = work(spark, docs, sf_dir)
        tables.paths += mine.paths
        return out

    return stage


def _tables() -> Tables:
    if not hasattr(_running, "tables"):
        _running.tables = Tables()
    return _running.tables


@_stage
def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Junk and toxic documents go, by a model that is fitted to these documents."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_classifier.keep(docs, labels)


@_stage
def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose sets of 5-word shingles are similar by 0.8 or more, one stays."""
    return near_duplicates.keep_one(docs)


@_stage
def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a window of a benchmark item occurs go."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.keep_clean(docs, items, WINDOW)


@_stage
def pseudonymous(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data become keyed pseudonyms; n_chars follows the text where there is such a column."""
    new = pii.pseudonymize(docs, PII_KEY)
    if "n_chars" in docs.columns:
        new = new.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return new.select(*docs.columns)


@_stage
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents as pieces of sequences of at most 2048 tokens."""
    import public_tokenizers

    return packing.tokenizer_pack(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("quality_classifier", classify),
    ("simhash_near_dedup", near_duplicate),
    ("benchmark_decontamination", uncontaminated),
    ("pii", pseudonymous),
    ("packing", packed),
]

#: The fitted model, the index and the tokenizer have no form in SQL; tests hold the stages
#: against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        made = stage(spark, docs, sf_dir)
        with owned() as mine:
            docs = materialize(made, name)
        _tables().paths += mine.paths
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {}
