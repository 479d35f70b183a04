"""Consistency checks over an experiment record: all violations in one table.

A violation has the place at which a sequential audit would meet it, so its first row, in the
order of ``ORDER``, is the one that such an audit reports.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veridrift.functions.numeric import close, dominated, finite, holds, number, within
from veridrift.sources.tables import materialize

# The strategies that an evaluation must hold, the size of the final comparison,
# and its recorded decision.
STRATEGIES = ("direct", "random_top1", "structure_top1", "ready_v2_top1", "ready_v3_top1", "oracle_all4")
FINAL_GROUPS = 64
FINAL_DECISION = "keep_base_sana"
FINAL_RATES = ("mean_q", "pass_rate", "adherence_rate", "technical_valid_rate")

#: Declared strategies that are sent to all tasks at most.
SMALL = 10_000
# Declared metric, and the column of the group rows whose mean it must be
METRICS = (
    ("mean_quality", "selected_quality"),
    ("mean_regret", "regret"),
    ("top1_accuracy", "top1_correct"),
    ("qualified_rate", "qualified"),
    ("technical_valid_rate", "technically_valid"),
)
# Message parts that tests of such records look for
DUPLICATES, RANGE, MEAN_DIFFERENCE = "duplicate or missing", "quality range", "final mean difference"

ORDER = ("phase", "strategy_pos", "step", "row_pos", "item")
VIOLATION = (*ORDER, "check", "subject", "message")


def _violation(df: DataFrame, phase: int, check: str, message: Column, *, strategy: Column | None = None, step: int = 0, row: Column | None = None, item: Column | int = 0, subject: Column | None = None) -> DataFrame:
    nothing = F.lit(0)
    return df.select(
        F.lit(phase).alias("phase"),
        (nothing if strategy is None else strategy).cast("int").alias("strategy_pos"),
        F.lit(step).alias("step"),
        (nothing if row is None else row).cast("long").alias("row_pos"),
        (F.lit(item) if isinstance(item, int) else item).cast("int").alias("item"),
        F.lit(check).alias("check"),
        (F.lit(None) if subject is None else subject).cast("string").alias("subject"),
        message.alias("message"),
    )


def declared(doc: DataFrame) -> DataFrame:
    """A row per declared strategy: its place in the document, name and aggregates."""
    return doc.select("groups", F.posexplode("strategies").alias("strategy_pos", "strategy", "d"))


def group_rows(doc: DataFrame) -> DataFrame:
    """The group results, with their place in the document."""
    return doc.select(F.posexplode("group_results").alias("row_pos", "r")).select("row_pos", "r.*")


def set_difference(found: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """Keys on one side only, with the side (``missing`` or ``unexpected``)."""
    a = found.select(key).distinct().withColumn("found", F.lit(True))
    b = expected.select(key).distinct().withColumn("expected", F.lit(True))
    sides = a.join(b, key, "full_outer").where("found is null or expected is null")
    return sides.select(key, F.when(F.col("found").isNull(), "missing").otherwise("unexpected").alias("side"))


def duplicate_groups(rows: DataFrame, strategy: str = "strategy", group: str = "group_id") -> DataFrame:
    """Strategies whose rows aren't one per group: rows and distinct groups."""
    counted = rows.groupBy(strategy).agg(F.count("*").alias("rows"), F.count_distinct(F.col(group)).alias("distinct_groups"))
    return counted.where("rows != distinct_groups")


def asset_drift(values: DataFrame, key: list[str], value: str, order: list[str] | None = None) -> DataFrame:
    """Assets whose value isn't the same wherever it stands.

    With ``order`` each value is held against the one before it, as a sequential audit does (a
    chain of small drifts passes); without, the largest against the smallest.
    """
    if order:
        before = F.lag(value).over(Window.partitionBy(*key).orderBy(*order))
        seen = values.withColumn("before", before).withColumn("turn", F.row_number().over(Window.partitionBy(*key).orderBy(*order)))
        return seen.where((F.col("turn") > 1) & ~close(F.col(value), F.col("before"))).drop("turn")
    spread = values.groupBy(*key).agg(F.min(value).alias("low"), F.max(value).alias("high"))
    return spread.where(~close(F.col("low"), F.col("high")))


def different_cover(rows: DataFrame, strategy: str, group: str, distinct: bool = False) -> DataFrame:
    """Groups that some strategies have and others don't.

    Equal sets have every (group, strategy) pair, so counts by group find what differs without
    gathering any set.  ``distinct``: each pair stands there once already.
    """
    pairs = rows.select(strategy, group) if distinct else rows.select(strategy, group).distinct()
    total = pairs.agg(F.count_distinct(F.col(strategy)).alias("n_strategies"))
    return pairs.groupBy(group).agg(F.count("*").alias("n")).join(F.broadcast(total)).where("n != n_strategies")  # one row


def declared_against_recomputed(rows: DataFrame, aggregates: DataFrame, metrics=METRICS) -> DataFrame:
    """(strategy, item, metric, declared, recomputed) for each pair, joined so that neither side is lost."""
    means = rows.groupBy("strategy").agg(*[F.avg(number(F.col(c))).alias(f"avg_{m}") for m, c in metrics])
    both = aggregates.join(means, "strategy", "full_outer")
    cells = F.inline(F.array(*[F.struct(F.lit(i).alias("item"), F.lit(m).alias("metric"), number(F.col(m)).alias("declared"), F.col(f"avg_{m}").alias("recomputed")) for i, (m, _) in enumerate(metrics)]))
    keep = [c for c in ("strategy", "strategy_pos") if c in both.columns]
    return both.select(*keep, cells)


def check_evaluation(doc: DataFrame, strategies=STRATEGIES, exact_assets: bool = True) -> DataFrame:
    """Every violation of a strategy evaluation."""
    return check_rows(declared(doc), group_rows(doc), strategies, exact_assets)


def check_rows(named: DataFrame, rows: DataFrame, strategies=STRATEGIES, exact_assets: bool = True, metrics=METRICS) -> DataFrame:
    """Every violation of an evaluation in two tables, of any size.

    ``named``: (groups, strategy_pos, strategy, d) with the declared aggregates in ``d``; ``rows``:
    the group results with ``row_pos``.  Both are stored once, whatever they come from.
    """
    spark = named.sparkSession
    expected = spark.range(1).select(F.explode(F.array(*[F.lit(s) for s in strategies])).alias("strategy"))
    used = dict.fromkeys(["strategy", "group_id", "row_pos", "selected_sample_id", "selected_quality", "optimal_sample_id", "optimal_quality", "regret", *[c for _, c in metrics]])
    # what is read more than once is stored: the declared strategies, the rows, and the rows' sums by strategy and group
    named, rows = materialize(named, "declared"), materialize(rows.select(*used), "group-rows")
    value = {m: number(F.col(c)) for m, c in metrics}
    sums = [x for m, v in value.items() for x in (F.sum(v).alias(f"sum_{m}"), F.count(v).alias(f"n_{m}"))]
    cells = materialize(rows.groupBy("strategy", "group_id").agg(F.count("*").alias("rows"), *sums), "cells")
    means = [(F.sum(f"sum_{m}") / F.nullif(F.sum(f"n_{m}"), F.lit(0))).alias(f"avg_{m}") for m, _ in metrics]
    counts = materialize(cells.groupBy("strategy").agg(F.sum("rows").alias("rows"), F.count("group_id").alias("found"), *means), "counts")
    near = F.broadcast(named) if named.count() <= SMALL else named
    placed = rows.join(near.select("strategy", "strategy_pos"), "strategy")
    say = F.concat
    found = [
        _violation(set_difference(named, expected, "strategy"), 1, "key_set", say(F.lit("expected exactly the known strategies: "), "strategy", F.lit(" is "), "side"), subject=F.col("strategy")),
        _violation(set_difference(counts, expected, "strategy"), 2, "row_set", say(F.lit("rows of strategies that aren't as expected: "), "strategy", F.lit(" is "), "side"), subject=F.col("strategy")),
    ]
    held = named.join(counts.select("strategy", "rows", "found"), "strategy", "left").fillna(0, ["rows", "found"])
    at = {"strategy": F.col("strategy_pos"), "subject": F.col("strategy")}
    found += [
        _violation(held.where((F.col("rows") != F.col("found")) | ~holds(F.col("found") == F.col("groups"))), 3, "uniqueness", say("strategy", F.lit(f": {DUPLICATES} groups")), step=1, **at),
        _violation(held.where(~holds(F.col("d.groups") == F.col("found"))), 3, "declared_count", say("strategy", F.lit(": declared number of groups differs")), step=2, **at),
    ]
    q, best = number(F.col("selected_quality")), number(F.col("optimal_quality"))
    in_range = within(q) & within(best) & dominated(q, best)
    inside = {"step": 3, "row": F.col("row_pos"), **at}
    found += [
        _violation(placed.where(~in_range), 3, "quality_range", say("strategy", F.lit(f": invalid {RANGE}")), item=1, **inside),
        _violation(placed.where(~close(number(F.col("regret")), best - q)), 3, "regret", say("strategy", F.lit(" regret: isn't the optimal less the selected quality")), item=2, **inside),
    ]
    assets = placed.select(
        "strategy", "strategy_pos", "row_pos", "group_id",
        F.inline(F.array(F.struct(F.lit(3).alias("item"), F.col("selected_sample_id").alias("sample_id"), q.alias("value")), F.struct(F.lit(4).alias("item"), F.col("optimal_sample_id").alias("sample_id"), best.alias("value")))),
    )
    if exact_assets:
        drift = asset_drift(assets, ["group_id", "sample_id"], "value", ["strategy_pos", "row_pos", "item"])
    else:
        drift = assets.join(asset_drift(assets, ["group_id", "sample_id"], "value").select("group_id", "sample_id"), ["group_id", "sample_id"], "left_semi")
    found.append(_violation(drift, 3, "same_asset", say(F.lit("asset with several qualities: "), "sample_id"), item=F.col("item"), **inside))
    both = counts.join(named.select("strategy", "strategy_pos", "d.*").drop("rows", "found"), "strategy")
    cells_ = F.inline(F.array(*[F.struct(F.lit(i).alias("item"), F.lit(m).alias("metric"), number(F.col(m)).alias("declared"), F.col(f"avg_{m}").alias("recomputed")) for i, (m, _) in enumerate(metrics)]))
    lost = named.join(counts.select("strategy"), "strategy", "left_anti").select("strategy", "strategy_pos", "d.*").withColumns({f"avg_{m}": F.lit(None).cast("double") for m, _ in metrics})
    wrong = both.select("strategy", "strategy_pos", cells_).unionByName(lost.select("strategy", "strategy_pos", cells_)).where(~close(F.col("declared"), F.col("recomputed")))
    found.append(_violation(wrong, 3, "declared_mean", say("strategy", F.lit(" "), "metric", F.lit(": isn't the mean of its rows")), step=4, item=F.col("item"), **at))
    cover = different_cover(cells.join(near.select("strategy"), "strategy", "left_semi"), "strategy", "group_id", distinct=True)
    found.append(_violation(cover, 4, "coverage", say(F.lit("not every strategy covers group "), "group_id"), subject=F.col("group_id")))
    return reduce(DataFrame.unionByName, found)


def recomputed_means(doc: DataFrame) -> DataFrame:
    """One row: map of strategy to mean selected quality, from the group rows."""
    return means_of(group_rows(doc))


def means_of(rows: DataFrame) -> DataFrame:
    """One row: map of strategy to mean selected quality."""
    means = rows.groupBy("strategy").agg(F.avg("selected_quality").alias("mean"))
    return means.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("strategy", "mean")))).alias("means"))


def check_final(doc: DataFrame, groups: int = FINAL_GROUPS, decision: str = FINAL_DECISION) -> DataFrame:
    """Every violation of a final two-arm comparison."""
    base, other, boot = "base_summary", "lora_summary", "paired_bootstrap"
    sized = holds(F.col(f"{base}.groups") == groups) & holds(F.col(f"{other}.groups") == groups)
    rates = doc.select(F.inline(F.array(*[F.struct(F.lit(i).alias("item"), F.lit(m).alias("metric"), number(F.col(f"{arm}.{m}")).alias("value")) for i, (arm, m) in enumerate((a, m) for a in (base, other) for m in FINAL_RATES)])))
    difference = close(F.col(f"{other}.mean_q") - F.col(f"{base}.mean_q"), F.col(f"{boot}.mean_q_difference_lora_minus_base"))
    low, high = F.col(f"{boot}.ci95_low"), F.col(f"{boot}.ci95_high")
    # the interval needn't hold the mean
    interval = finite(low) & finite(high) & holds(low <= high)
    return reduce(
        DataFrame.unionByName,
        [
            _violation(doc.where(~sized), 1, "final_groups", F.lit(f"expected {groups} groups in both arms")),
            _violation(rates.where(~within(F.col("value"))), 2, "final_rate", F.concat(F.lit("invalid final "), "metric"), item=F.col("item"), subject=F.col("metric")),
            _violation(doc.where(~difference), 3, "final_difference", F.lit(f"{MEAN_DIFFERENCE}: isn't that of the means")),
            _violation(doc.where(~interval), 4, "final_interval", F.lit("interval of the final difference is invalid")),
            _violation(doc.where(~holds(F.col("decision") == decision)), 5, "final_decision", F.lit("final decision isn't the recorded one")),
        ],
    )


def first_violation(violations: DataFrame) -> str | None:
    """The message that a sequential audit would stop with, or None."""
    row = violations.orderBy(*ORDER, "message").select("message").first()
    return row[0] if row else None
