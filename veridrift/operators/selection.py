"""Picking candidates: best of N, best of k, rules, lexicographic choice, grids and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veridrift.functions.numeric import holds, ratio


def first_k(candidates: DataFrame, group: list[str], order: list[Column | str], k: int, name: str = "k") -> DataFrame:
    """The first k candidates of each group and their index from 0; the plan limits them before the shuffle."""
    window = Window.partitionBy(*group).orderBy(*order)
    ranked = candidates.withColumn("_rank", F.row_number().over(window)).where(F.col("_rank") <= k)
    return ranked.withColumn(name, F.col("_rank") - 1).drop("_rank")


def top_one(candidates: DataFrame, group: list[str], order: list[Column | str]) -> DataFrame:
    """The first candidate of each group; end ``order`` with a unique key."""
    return first_k(candidates, group, order, 1, "_k").drop("_k")


def complete_groups(candidates: DataFrame, group: str, n: int) -> DataFrame:
    """Candidates of groups that have exactly n of them."""
    size = F.count("*").over(Window.partitionBy(group))
    return candidates.withColumn("_n", size).where(F.col("_n") == n).drop("_n")


def hash_order(sample: Column, seed: int) -> Column:
    """A random-looking order that is the same in every engine."""
    return F.md5(F.concat(F.lit(f"{seed}:"), sample.cast("string")))


def pick_strategies(candidates: DataFrame, group: str, sample: str, quality: str, orders: dict[str, list[Column]]) -> DataFrame:
    """A row per strategy and group: what each picked, and the best candidate, in one grouping.

    ``orders`` maps a strategy to the columns by which its smallest candidate is picked.
    """
    best = F.struct((-F.col(quality)).alias("a"), F.col(sample).alias("b"))
    what = F.struct(F.col(sample).alias("id"), F.col(quality).alias("q"))
    picks = [F.min_by(what, F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])).alias(s) for s, order in orders.items()]
    grouped = candidates.groupBy(group).agg(F.min_by(what, best).alias("_best"), *picks)
    cells = F.array(*[F.struct(F.lit(s).alias("strategy"), F.col(f"{s}.id").alias("selected_id"), F.col(f"{s}.q").alias("selected_quality")) for s in orders])
    rows = grouped.select(F.col(group).alias("group_id"), F.col("_best.id").alias("optimal_id"), F.col("_best.q").alias("optimal_quality"), F.inline(cells))
    return rows.withColumns({"regret": F.col("optimal_quality") - F.col("selected_quality"), "top1_correct": F.col("selected_id") == F.col("optimal_id")})


def gated_rank(candidates: DataFrame, group: list[str], gate: Column, order: list[Column]) -> DataFrame:
    """The best candidate that passes a gate; the best of all where none does."""
    return top_one(candidates.withColumn("gate_passed", holds(gate)), group, [F.desc("gate_passed"), *order])


def best_of_budget(candidates: DataFrame, group: list[str], index: str, quality: str, budgets: list[int]) -> DataFrame:
    """Mean over groups of the best quality among the first b candidates, for each budget b."""
    best = candidates.groupBy(*group).agg(*[F.max(F.when(F.col(index) < b, F.col(quality))).alias(f"b{b}") for b in budgets])
    cells = F.array(*[F.struct(F.lit(b).alias("budget"), F.col(f"b{b}").alias("best")) for b in budgets])
    return best.select(F.inline(cells)).groupBy("budget").agg(F.count("best").alias("groups"), F.avg("best").alias("mean_best"))


def lexicographic(candidates: DataFrame, priorities: list[tuple[str, bool]], tie: str) -> DataFrame:
    """The one row that is first by each priority in turn (name, ascending), then by ``tie``."""
    keys = [F.asc(c) if up else F.desc(c) for c, up in priorities]
    return candidates.orderBy(*keys, F.asc(tie)).limit(1)


def grid(spark: SparkSession, **choices: list) -> DataFrame:
    """All combinations of a few literal choices: one row, exploded along each axis in turn."""
    out = spark.range(0, 1, 1, 1)
    for name, values in choices.items():
        out = out.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return out.select(*choices)


def fused_score(scores: dict[str, float]) -> Column:
    """Weighted sum of score columns."""
    return sum((F.lit(w) * F.col(c) for c, w in scores.items()), F.lit(0.0))


def split_of(group: Column, shares: dict[str, float], seed: int = 0) -> Column:
    """A split for each *group*, by a hash that every engine has."""
    slot = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), group.cast("string"))), 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))
    names, upto = list(shares), 0.0
    out = F.lit(names[-1])
    bounds = []
    for name in names[:-1]:
        upto += shares[name]
        bounds.append((name, upto))
    for name, bound in reversed(bounds):
        out = F.when(slot < bound, name).otherwise(out)
    return out


def leaked_groups(rows: DataFrame, group: str, split: str) -> DataFrame:
    """Groups that stand in more than one split."""
    return rows.groupBy(group).agg(F.count_distinct(F.col(split)).alias("splits")).where("splits > 1")


def guarded(candidate: Column, original: Column, accepted: Column) -> Column:
    """The candidate where all constraints hold, the original otherwise."""
    return F.when(holds(accepted), candidate).otherwise(original)


def weighted_mean(value: str, weight: str) -> Column:
    return ratio(F.sum(F.col(value) * F.col(weight)), F.sum(F.when(F.col(value).isNotNull(), F.col(weight))))
