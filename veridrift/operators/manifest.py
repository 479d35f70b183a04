"""Manifests: flattening, containment of paths, and digests against files."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("glb", "preview")

# Fixed value: a message part that tests of such manifests look for
MISMATCH = "checksum mismatch"


def flatten_assets(doc: DataFrame, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """(asset, kind, path, sha256): a row for each file of each asset."""
    return files_of(doc.select(F.posexplode("assets").alias("asset", "a")).select("asset", "a.*"), kinds)


def files_of(assets: DataFrame, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """(asset, kind, path, sha256) of assets in a table, of any size."""
    cells = [F.struct(F.lit(k).alias("kind"), F.col(k).alias("path"), F.lower(F.col(f"{k}_sha256")).alias("sha256")) for k in kinds]
    return assets.select("asset", F.inline(F.array(*cells)))


def escapes(path: Column) -> Column:
    """Whether a relative path leaves its root: absolute, or more steps up than down somewhere."""
    steps = F.filter(F.split(path, "[/\\\\]"), lambda s: ~s.isin("", "."))
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("least"))

    def step(at, s):
        depth = at["depth"] + F.when(s == "..", -1).otherwise(1)
        return F.struct(depth.alias("depth"), F.least(at["least"], depth).alias("least"))

    return path.isNull() | path.rlike(r"^(/|\\|[A-Za-z]:)") | F.aggregate(steps, start, step, lambda at: at["least"] < 0)


def resolve_inside(root: Path, relative: str) -> Path:
    """The path with its links resolved; raises where that isn't below ``root``."""
    path = (root / relative).resolve()
    if not path.is_relative_to(root.resolve()):
        raise ValueError(f"asset path leaves the root: {relative}")
    return path


def file_status(manifest: DataFrame, digests: DataFrame) -> DataFrame:
    """The manifest with a status for each file: ok, mismatch, missing or escapes."""
    actual = digests.select("path", F.col("sha256").alias("actual"))
    status = (
        F.when(escapes(F.col("path")), "escapes")
        .when(F.col("actual").isNull(), "missing")
        .when(F.col("actual") == F.col("sha256"), "ok")
        .otherwise("mismatch")
    )
    return manifest.join(actual, "path", "left").withColumn("status", status)


def manifest_violations(statuses: DataFrame) -> DataFrame:
    """Messages for what isn't ok."""
    said = (
        F.when(F.col("status") == "escapes", F.concat(F.lit("asset path leaves the root: "), F.coalesce("path", F.lit("none"))))
        .when(F.col("status") == "missing", F.concat(F.lit("asset is missing: "), "path"))
        .otherwise(F.concat(F.lit(f"asset {MISMATCH}: "), "path"))
    )
    return statuses.where("status != 'ok'").select("path", "status", said.alias("message"))


def repeated_digests(digests: DataFrame, digest: str = "sha256") -> DataFrame:
    return digests.groupBy(digest).agg(F.count("*").alias("n")).where("n > 1")
