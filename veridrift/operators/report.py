"""The audit from records to a report, and a runner for sequences of commands."""

from __future__ import annotations

import json
import subprocess
import sys
from pathlib import Path

from py4j.protocol import Py4JJavaError
from pyspark.errors.exceptions.captured import CapturedException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridrift.operators import checks, manifest
from veridrift.sources.records import read_digests, read_record


class AuditFailure(ValueError):
    """The first violation, in the order of a sequential audit."""


def assemble(evaluation: DataFrame, final: DataFrame, n_assets: int) -> DataFrame:
    """The report of records whose checks have all passed."""
    passed = evaluation.select(F.lit("passed").alias("status"))
    return summary(evaluation.select("groups"), checks.recomputed_means(evaluation), final.select("decision"), evaluation.select(F.lit(n_assets).alias("n_assets")), passed)


def summary(groups: DataFrame, means: DataFrame, final: DataFrame, assets: DataFrame, status: DataFrame) -> DataFrame:
    """One row with the status, scope, recomputed means and what was not redone, from one-row tables.

    ``assets`` has the number of assets that were verified as ``n_assets``.
    """
    # fixed values: the names of the report's fields
    return groups.crossJoin(means).crossJoin(final).crossJoin(status).crossJoin(assets).select(
        F.col("status"),
        F.lit("consistency of records and checksums of assets; no model inference").alias("scope"),
        F.col("groups").alias("stage1_groups"),
        F.col("means").alias("stage1_recomputed_mean_quality"),
        F.col("decision").alias("final_decision"),
        F.lit(False).alias("final_bootstrap_recomputed"),
        F.lit(False).alias("final_raw_group_records_in_repository"),
        F.col("n_assets").alias("showcase_assets_verified"),
    )


def audit(spark: SparkSession, evaluation: str, final: str, assets: str | None = None, root: str | None = None) -> DataFrame:
    """The report of an audit that passes; raises ``AuditFailure`` with the first violation."""
    first = read_record(spark, evaluation, "strategy_evaluation")
    last = read_record(spark, final, "final_comparison")
    for found in (checks.check_evaluation(first), checks.check_final(last)):
        if message := checks.first_violation(found):
            raise AuditFailure(message)
    n = 0
    if assets:
        doc = read_record(spark, assets, "asset_manifest")
        listed = manifest.flatten_assets(doc)
        if not root or "://" not in root:  # links can be followed where the files are local
            for r in listed.select("path").where("path is not null").distinct().toLocalIterator():
                contained(Path(root or "."), r["path"])
        status = manifest.file_status(listed, read_digests(spark, root))
        row = manifest.manifest_violations(status).orderBy("path").first()
        if row:
            raise AuditFailure(row["message"])
        n = doc.select(F.size("assets")).first()[0]
    return assemble(first, last, n)


def contained(root: Path, path: str) -> None:
    """Raise where a path, its links followed, isn't below ``root``."""
    try:
        manifest.resolve_inside(root, path)
    except ValueError as error:
        raise AuditFailure(str(error)) from None


def pretty(report: DataFrame) -> str:
    """Indented JSON of a one-row report, other scripts kept."""
    return json.dumps(json.loads(report.toJSON().first()), indent=2, ensure_ascii=False)


def run_audit(spark: SparkSession, **paths: str) -> int:
    """Print the report and return 0, or the failure on standard error and 1.

    Failures are violations, records that can't be read or don't fit their schema, and files that
    aren't there; any other error goes on to the caller.
    """
    try:
        print(pretty(audit(spark, **paths)))
    except (ValueError, OSError, KeyError, CapturedException, Py4JJavaError) as error:
        print(f"Audit failed: {error}", file=sys.stderr)
        return 1
    return 0


def run_in_order(commands: list[tuple[list[str], Path]], env: dict[str, str] | None = None) -> int:
    """Run commands one after the other; stop at the first status that isn't zero, and return it."""
    for command, directory in commands:
        status = subprocess.run(command, cwd=directory, env=env).returncode
        if status:
            return status
    return 0
