"""Experiment records: explicit schemas, and readers that fail on what doesn't fit them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, DoubleType, MapType, StringType, StructField, StructType

GROUP_ROW = (
    "group_id string, strategy string, selected_sample_id string, selected_quality double, qualified boolean, "
    "technically_valid boolean, optimal_sample_id string, optimal_quality double, regret double, top1_correct boolean"
)
_VALIDATION = "groups bigint, mean_selected_quality double, top1_accuracy double, mean_regret double, quality_capture double"
_WEIGHTS = "weights struct<pairwise double, utility double>"
_SUMMARY = (
    "struct<groups bigint, mean_q double, pass_rate double, adherence_rate double, technical_valid_rate double, gpu_seconds_per_group double>"
)
_BOUNDS = "map<string, struct<low double, high double, direction string>>"

#: DDL of each kind of record.  Keyed objects are maps: inference would make them structs.
SCHEMAS = {
    "strategy_evaluation": (
        "schema_version string, evaluation_split string, test_used_for_model_or_threshold_selection boolean, groups bigint, "
        "bootstrap_draws bigint, bootstrap_seed bigint, strategies map<string, struct<groups bigint, mean_quality double, "
        "qualified_rate double, technical_valid_rate double, top1_accuracy double, mean_regret double, quality_capture double, "
        "two_d_candidates_per_group bigint, three_d_calls_per_group bigint>>, comparisons_vs_direct map<string, struct<"
        "mean_quality_delta double, mean_quality_delta_95_ci array<double>, qualified_rate_delta double>>, "
        f"group_results array<struct<{GROUP_ROW}>>"
    ),
    "model_selection": (
        "schema_version string, model_selection struct<split string, priority array<string>, test_used_for_selection boolean>, "
        "selected struct<name string, ranking_name string, ranking_feature_set string, ranking_model_name string, "
        f"quality_feature_set string, {_WEIGHTS}>, validation struct<{_VALIDATION}>, test struct<{_VALIDATION}>, "
        "group_counts map<string, bigint>, resample_suggestion_threshold double, selection_candidates array<struct<name string, "
        f"{_WEIGHTS}, validation struct<{_VALIDATION}>>>"
    ),
    "calibration": (
        f"scoring_version string, source string, quality_threshold_percentile bigint, quality_threshold double, metrics {_BOUNDS}, "
        "normalization struct<calibration_version string, normalization_source_split string, low_percentile double, "
        f"high_percentile double, training_records bigint, metrics {_BOUNDS}>, test_used_for_fitting boolean"
    ),
    "gate": "schema_version string, checks map<string, boolean>, test_used_for_selection boolean",
    "freeze": "schema_version string, stage string, status string, counts map<string, bigint>, correction_reason string",
    "generation_summary": (
        "schema_version string, status string, candidate_split_counts map<string, bigint>, unique_seeds bigint, "
        "seed_coverage_rate double, image_resolutions map<string, bigint>, adherence_coverage_rate double, final_test_used boolean"
    ),
    "checkpoint_selection": (
        "schema_version string, purpose string, final_test_used boolean, selection_rule string, selected_checkpoint string, "
        "metrics map<string, struct<samples bigint, technically_valid bigint, mean_quality_score_v2 double, "
        "median_quality_score_v2 double, high_quality bigint>>"
    ),
    "final_comparison": (
        f"schema_version string, base_summary {_SUMMARY}, lora_summary {_SUMMARY}, paired_bootstrap struct<iterations bigint, "
        "seed bigint, mean_q_difference_lora_minus_base double, ci95_low double, ci95_high double>, "
        "pass_rate_relative_uplift double, decision string"
    ),
    "asset_manifest": "assets array<struct<glb string, glb_sha256 string, preview string, preview_sha256 string>>",
}
HASH_LINE = r"^([0-9a-fA-F]{64})  (.+)$"


def read_record(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """A row for each JSON document; raises when it isn't UTF-8 JSON of the declared types.

    Numbers may be written as strings or as booleans, and flags as 0 and 1, as long as they are
    numbers; they are read as they are written, and cast.
    """
    schema = StructType.fromDDL(SCHEMAS[kind])
    reader = spark.read.schema(as_written(schema)).option("multiLine", True).option("mode", "FAILFAST").option("encoding", "UTF-8")
    return reader.json(path).select(*[typed(F.col(f.name), f.dataType).alias(f.name) for f in schema.fields])


def as_written(kind: DataType) -> DataType:
    """The type with strings in place of numbers and flags."""
    if isinstance(kind, StructType):
        return StructType([StructField(f.name, as_written(f.dataType)) for f in kind.fields])
    if isinstance(kind, ArrayType):
        return ArrayType(as_written(kind.elementType))
    if isinstance(kind, MapType):
        return MapType(kind.keyType, as_written(kind.valueType))
    return StringType()


def typed(value: Column, kind: DataType) -> Column:
    """The value as written, cast to ``kind``; what isn't a number there raises in ANSI mode."""
    if isinstance(kind, StructType):
        return F.when(value.isNotNull(), F.struct(*[typed(value[f.name], f.dataType).alias(f.name) for f in kind.fields]))
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda x: typed(x, kind.elementType))
    if isinstance(kind, MapType):
        return F.transform_values(value, lambda _, x: typed(x, kind.valueType))
    if isinstance(kind, StringType):
        return value
    plain = F.regexp_replace(F.trim(value), '^"(NaN|-?Infinity)"$', "$1")  # bare ones come back in quotes
    told = F.when(plain == "true", F.lit("1")).when(plain == "false", F.lit("0")).otherwise(plain)
    if isinstance(kind, BooleanType):
        return told.cast("double") != 0
    return told.cast(kind) if isinstance(kind, DoubleType) else F.when(told.rlike("^[+-]?[0-9]+$"), told.cast(kind)).otherwise(told.cast("double").cast(kind))


def read_group_rows(spark: SparkSession, path: str, kind: str = "json") -> DataFrame:
    """Group results as a table of their own (JSON lines, CSV with a header, or Parquet)."""
    reader = spark.read.schema(GROUP_ROW).option("mode", "FAILFAST")
    return reader.csv(path, header=True) if kind == "csv" else reader.format(kind).load(path)


def read_hash_list(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of each line ``digest  path``; a malformed line gives NULLs."""
    return hash_lines(spark.read.text(path))


def hash_lines(lines: DataFrame) -> DataFrame:
    """(path, sha256) of the lines in ``value``, empty ones left out."""
    lines = lines.where(F.length("value") > 0)
    part = lambda i: F.nullif(F.regexp_extract("value", HASH_LINE, i), F.lit(""))
    return lines.select(part(2).alias("path"), F.lower(part(1)).alias("sha256"))


def read_digests(spark: SparkSession, root: str, pattern: str | None = None) -> DataFrame:
    """(path below root, sha256, length) of every file below ``root``."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    base = root.rstrip("/").split(":", 1)[-1].lstrip("/")
    below = F.regexp_replace("path", r"^[a-zA-Z][a-zA-Z0-9+.-]*:/*", "")
    return reader.load(root).select(
        F.substring(below, len(base) + 2, 1 << 30).alias("path"),
        F.sha2("content", 256).alias("sha256"),
        "length",
    )
