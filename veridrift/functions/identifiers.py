"""Structured sample identifiers: ``{group}_c{index}_s{seed}``, with or without a prefix and split."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PLAIN = r"^(.+)_c(\d+)_s(\d+)$"
SPLIT = r"^([^_]+)_(train|validation|dev_test)_(.+)_c(\d+)_s(\d+)$"


def _part(value: Column, pattern: str, at: int) -> Column:
    return F.nullif(F.regexp_extract(value, pattern, at), F.lit(""))


def parse_sample(value: Column) -> Column:
    """struct(group, candidate, seed); NULL fields where the id has another form."""
    return F.struct(
        _part(value, PLAIN, 1).alias("group"),
        _part(value, PLAIN, 2).cast("int").alias("candidate"),
        _part(value, PLAIN, 3).cast("long").alias("seed"),
    )


def parse_split_sample(value: Column) -> Column:
    """struct(prefix, split, group, candidate, seed) of an id that names its split."""
    return F.struct(
        _part(value, SPLIT, 1).alias("prefix"),
        _part(value, SPLIT, 2).alias("split"),
        _part(value, SPLIT, 3).alias("group"),
        _part(value, SPLIT, 4).cast("int").alias("candidate"),
        _part(value, SPLIT, 5).cast("long").alias("seed"),
    )


def expected_seed(base: int, group_number: Column, candidate: Column, per_group: int) -> Column:
    """Seeds are dealt in order: ``base + per_group * group + candidate``."""
    return F.lit(base) + F.lit(per_group) * group_number.cast("long") + candidate.cast("long")
