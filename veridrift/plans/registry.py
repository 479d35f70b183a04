"""Queries of the library by name, and the equivalent SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veridrift.functions import identifiers
from veridrift.functions.numeric import close, dominated, within
from veridrift.operators import bootstrap, calibration, checks, cubes, manifest, metrics, ranker, reconcile, report, resumable, selection, sketches, temporal
from veridrift.plans import fixture
from veridrift.plans.fixture import SQL, candidates, picks, table
from veridrift.sources import plugins, records
from veridrift.sources.tables import materialize, scratch_path
from veridrift.streaming import events as events_stream

#: Resamples of the bootstrap whose index SQL can make too.
DRAWS = 200

_QUERIES: dict = {}
_ORACLES: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _ORACLES[f.__name__] = sql
        return f

    return add


def _round(*names: str) -> dict:
    return {n: F.round(F.col(n), 9) for n in names}


@_query(
    SQL
    + """SELECT strategy, count(*) AS groups, round(avg(selected_quality), 9) AS mean_quality,
    round(avg(top1_correct::int::double), 9) AS top1_accuracy, round(avg(regret), 9) AS mean_regret,
    round(avg(selected_quality / nullif(optimal_quality, 0)), 9) AS quality_capture FROM picks GROUP BY strategy"""
)
def strategy_leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each strategy picks, and how good it is."""
    return metrics.leaderboard(picks(spark, sf_dir)).withColumns(_round("mean_quality", "top1_accuracy", "mean_regret", "quality_capture"))


@_query(SQL + "SELECT group_id, optimal_id, optimal_quality FROM best")
def best_of_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B1: the best candidate of each group."""
    best = selection.top_one(candidates(spark, sf_dir), ["group_id"], [F.desc("quality"), F.asc("sample_id")])
    return best.select("group_id", F.col("sample_id").alias("optimal_id"), F.col("quality").alias("optimal_quality"))


@_query(SQL + "SELECT strategy, group_id, selected_id, selected_quality, optimal_id, optimal_quality, regret, top1_correct FROM picks")
def strategy_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row of every strategy and group."""
    return picks(spark, sf_dir)


@_query(
    SQL
    + """, budgets AS (SELECT b.budget, group_id, max(quality) AS best FROM candidates
    JOIN (VALUES (1), (2), (4)) b(budget) ON k < b.budget GROUP BY 1, 2)
    SELECT budget, count(*) AS groups, round(avg(best), 9) AS mean_best FROM budgets GROUP BY budget"""
)
def best_of_k_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best of the first 1, 2 and 4."""
    return selection.best_of_budget(candidates(spark, sf_dir), ["group_id"], "k", "quality", [1, 2, 4]).withColumns(_round("mean_best"))


@_query(
    SQL
    + """SELECT group_id, sample_id, gate_passed FROM (
    SELECT *, l_discount >= 0.05 AS gate_passed,
      row_number() OVER (PARTITION BY group_id ORDER BY l_discount >= 0.05 DESC, quality DESC, sample_id) AS r FROM candidates) WHERE r = 1"""
)
def gated_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A structural gate, then the ranking."""
    chosen = selection.gated_rank(candidates(spark, sf_dir), ["group_id"], F.col("l_discount") >= 0.05, [F.desc("quality"), F.asc("sample_id")])
    return chosen.select("group_id", "sample_id", "gate_passed")


@_query(
    SQL
    + """SELECT p.strategy, count(*) AS groups, round(avg(p.selected_quality - b.selected_quality), 9) AS mean_delta
    FROM picks p JOIN picks b ON p.group_id = b.group_id AND b.strategy = 'direct' WHERE p.strategy <> 'direct' GROUP BY p.strategy"""
)
def paired_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differences from a baseline in the same group."""
    return metrics.paired_delta(picks(spark, sf_dir), "direct").withColumns(_round("mean_delta"))


@_query(
    SQL
    + f""", n AS (SELECT count(*) AS n FROM best),
    d AS (SELECT p.strategy, p.group_id, p.selected_quality - b.selected_quality AS diff,
      row_number() OVER (PARTITION BY p.strategy ORDER BY p.group_id) - 1 AS pos
      FROM picks p JOIN picks b ON p.group_id = b.group_id AND b.strategy = 'direct' WHERE p.strategy <> 'direct'),
    i AS (SELECT draw, ('0x' || substr(md5('{fixture.SEED}:' || draw || ':' || slot), 1, 8))::bigint % (SELECT n FROM n) AS pos
      FROM range({DRAWS}) a(draw), range((SELECT n FROM n)) b(slot)),
    m AS (SELECT strategy, draw, avg(diff) AS m FROM i JOIN d USING (pos) GROUP BY 1, 2)
    SELECT strategy, count(*) AS draws, round(quantile_cont(m, 0.025), 9) AS low, round(quantile_cont(m, 0.975), 9) AS high FROM m GROUP BY strategy"""
)
def paired_bootstrap_md5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentile bootstrap of the paired differences of all groups, with an index that every engine has."""
    chosen = materialize(picks(spark, sf_dir), "picks")
    return bootstrap.md5_bootstrap(metrics.paired_differences(chosen, "direct"), DRAWS, fixture.SEED).withColumns(_round("low", "high"))


@_query()
def paired_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """10,000 resamples of the paired differences of all groups, with NumPy's own generator."""
    chosen = materialize(picks(spark, sf_dir), "picks")
    return bootstrap.pcg64_bootstrap(metrics.paired_differences(chosen, "direct"), 10_000, fixture.SEED)


@_query(
    """SELECT l_orderkey AS group_id, count(*) AS "rows", count(DISTINCT l_linenumber) AS distinct_groups
    FROM lineitem GROUP BY l_orderkey HAVING count(*) <> count(DISTINCT l_linenumber)"""
)
def uniqueness_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows against distinct keys."""
    line = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("group_id"), "l_linenumber")
    return checks.duplicate_groups(line, "group_id", "l_linenumber")


@_query(
    """SELECT coalesce(o.o_orderkey, l.l_orderkey) AS key, CASE WHEN l.l_orderkey IS NULL THEN 'missing' ELSE 'unexpected' END AS side
    FROM (SELECT DISTINCT l_orderkey FROM lineitem) l FULL JOIN (SELECT DISTINCT o_orderkey FROM orders) o ON o_orderkey = l_orderkey
    WHERE l.l_orderkey IS NULL OR o.o_orderkey IS NULL"""
)
def key_set_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys on one side only."""
    found = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key"))
    return checks.set_difference(found, table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key")), "key")


@_query(
    """WITH p AS (SELECT DISTINCT l_returnflag AS strategy, l_orderkey AS group_id FROM lineitem),
    t AS (SELECT count(DISTINCT strategy) AS n_strategies FROM p)
    SELECT group_id, count(*) AS n, any_value(n_strategies) AS n_strategies FROM p, t GROUP BY group_id HAVING count(*) <> any_value(n_strategies)"""
)
def coverage_set_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that not every return flag has."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("strategy"), F.col("l_orderkey").alias("group_id"))
    return checks.different_cover(rows, "strategy", "group_id")


@_query(
    """WITH m AS (SELECT l_orderkey, sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)) AS s FROM lineitem GROUP BY 1)
    SELECT count(*) AS orders, count(*) FILTER (WHERE s IS NULL) AS without_lines,
    count(*) FILTER (WHERE s IS NOT NULL AND NOT abs(s - o_totalprice) <= greatest(1e-9 * greatest(abs(s), abs(o_totalprice)), 1e-9)) AS mismatched,
    count(*) FILTER (WHERE abs(s - o_totalprice) <= greatest(1e-9 * greatest(abs(s), abs(o_totalprice)), 1e-9)) AS agreed
    FROM orders LEFT JOIN m ON l_orderkey = o_orderkey"""
)
def declared_vs_recomputed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A declared total against the total of its rows, within the tolerance."""
    price = F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))
    sums = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum(price).alias("s"))
    both = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").join(sums, "o_orderkey", "left")
    same = close(F.col("s"), F.col("o_totalprice"))
    return both.agg(
        F.count("*").alias("orders"),
        F.count_if(F.col("s").isNull()).alias("without_lines"),
        F.count_if(F.col("s").isNotNull() & ~same).alias("mismatched"),
        F.count_if(same).alias("agreed"),
    )


@_query(
    SQL
    + """SELECT strategy, metric, round(value, 9) AS value FROM (
      SELECT strategy, avg(selected_quality) AS mean_quality, avg(regret) AS mean_regret, avg(top1_correct::int::double) AS top1_accuracy FROM picks GROUP BY 1)
    UNPIVOT (value FOR metric IN (mean_quality, mean_regret, top1_accuracy))"""
)
def metric_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aggregates as (strategy, metric, value) rows."""
    board = metrics.leaderboard(picks(spark, sf_dir)).select("strategy", "mean_quality", "mean_regret", "top1_accuracy")
    return board.unpivot(["strategy"], ["mean_quality", "mean_regret", "top1_accuracy"], "metric", "value").withColumns(_round("value"))


@_query(
    """SELECT l_partkey, l_suppkey, min(l_discount) AS low, max(l_discount) AS high FROM lineitem GROUP BY 1, 2
    HAVING NOT abs(max(l_discount) - min(l_discount)) <= greatest(1e-9 * greatest(abs(max(l_discount)), abs(min(l_discount))), 1e-9)"""
)
def asset_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One value per asset, wherever it stands."""
    return checks.asset_drift(table(spark, sf_dir, "lineitem"), ["l_partkey", "l_suppkey"], "l_discount")


@_query(
    """WITH o AS (SELECT l_partkey, l_suppkey, l_discount AS value, l_orderkey, lag(l_discount) OVER w AS before, row_number() OVER w AS turn FROM lineitem
      WINDOW w AS (PARTITION BY l_partkey, l_suppkey ORDER BY l_orderkey, l_linenumber, l_extendedprice, l_quantity, l_discount))
    SELECT l_partkey, l_suppkey, l_orderkey, value, before FROM o
    WHERE turn > 1 AND NOT abs(value - before) <= greatest(1e-9 * greatest(abs(value), abs(before)), 1e-9)"""
)
def asset_drift_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A20 as a sequential audit does it: each value against the one before."""
    rows = table(spark, sf_dir, "lineitem").withColumn("value", F.col("l_discount"))
    order = ["l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity", "l_discount"]
    return checks.asset_drift(rows, ["l_partkey", "l_suppkey"], "value", order).select("l_partkey", "l_suppkey", "l_orderkey", "value", "before")


@_query(
    """SELECT count(*) AS "rows", count(*) FILTER (WHERE NOT (l_quantity / 50 BETWEEN 0 AND 1)) AS bad_quality,
    count(*) FILTER (WHERE NOT (l_tax BETWEEN 0 AND 0.05)) AS bad_tax, count(*) FILTER (WHERE NOT (l_tax <= l_discount + 1e-9)) AS not_dominated FROM lineitem"""
)
def range_and_finite_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges, finite values and dominance, with nothing passing for want of a value."""
    return table(spark, sf_dir, "lineitem").agg(
        F.count("*").alias("rows"),
        F.count_if(~within(F.col("l_quantity") / 50)).alias("bad_quality"),
        F.count_if(~within(F.col("l_tax"), 0.0, 0.05)).alias("bad_tax"),
        F.count_if(~dominated(F.col("l_tax"), F.col("l_discount"))).alias("not_dominated"),
    )


_SPLIT_SQL = """CASE WHEN ('0x' || substr(md5('7:' || l_orderkey), 1, 8))::bigint / 4294967296.0::double < 0.7 THEN 'train'
    WHEN ('0x' || substr(md5('7:' || l_orderkey), 1, 8))::bigint / 4294967296.0::double < 0.7 + 0.15 THEN 'validation' ELSE 'test' END"""


def _split(spark: SparkSession, sf_dir: str) -> DataFrame:
    shares = {"train": 0.7, "validation": 0.15, "test": 0.15}
    return table(spark, sf_dir, "lineitem").withColumn("split", selection.split_of(F.col("l_orderkey"), shares, 7))


@_query(f"""SELECT split, count(*) AS "rows", count(DISTINCT l_orderkey) AS groups FROM (SELECT l_orderkey, {_SPLIT_SQL} AS split FROM lineitem) GROUP BY split""")
def group_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole groups in a split."""
    return _split(spark, sf_dir).groupBy("split").agg(F.count("*").alias("rows"), F.count_distinct(F.col("l_orderkey")).alias("groups"))


@_query(
    f"""SELECT l_orderkey, count(DISTINCT split) AS splits FROM (
    SELECT l_orderkey, CASE WHEN l_linenumber = 7 THEN 'test' ELSE {_SPLIT_SQL} END AS split FROM lineitem) GROUP BY 1 HAVING count(DISTINCT split) > 1"""
)
def split_leakage_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups in two splits, here those whose seventh line was put into the test split."""
    spoilt = F.when(F.col("l_linenumber") == 7, "test").otherwise(F.col("split"))
    return selection.leaked_groups(_split(spark, sf_dir).withColumn("split", spoilt), "l_orderkey", "split")


@_query(
    SQL
    + """SELECT strategy FROM (SELECT strategy, avg(regret) AS r, avg(selected_quality / nullif(optimal_quality, 0)) AS c, avg(top1_correct::int::double) AS t
    FROM picks WHERE strategy <> 'oracle' GROUP BY 1) ORDER BY r, c DESC, t DESC, strategy LIMIT 1"""
)
def lexicographic_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least regret, then most capture, then top-1 accuracy."""
    board = metrics.leaderboard(picks(spark, sf_dir)).where("strategy != 'oracle'")
    order = [("mean_regret", True), ("quality_capture", False), ("top1_accuracy", False)]
    return selection.lexicographic(board, order, "strategy").select("strategy")


@_query(
    """SELECT a || '/' || b || '/' || c AS name, count(l_orderkey) AS "rows" FROM (SELECT DISTINCT l_returnflag AS a FROM lineitem), (SELECT DISTINCT l_linestatus AS b FROM lineitem),
    (SELECT DISTINCT l_linenumber AS c FROM lineitem) LEFT JOIN lineitem ON l_returnflag = a AND l_linestatus = b AND l_linenumber = c GROUP BY ALL"""
)
def candidate_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All combinations of the choices that the lines know, and how many lines each has."""
    line = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber")
    row = line.agg(*[F.array_sort(F.collect_set(c)).alias(c) for c in line.columns]).first()  # a few flags and numbers
    name = lambda: F.concat_ws("/", *[F.col(c).cast("string") for c in line.columns])
    counts = line.groupBy(name().alias("name")).agg(F.count("*").alias("rows"))
    grid = selection.grid(spark, **{c: row[c] for c in line.columns}).select(name().alias("name"))
    return grid.join(counts, "name", "left").fillna(0, ["rows"])


@_query(
    SQL
    + """SELECT w AS weight, round(avg(quality), 9) AS mean_quality FROM (
      SELECT w, quality, row_number() OVER (PARTITION BY w, group_id ORDER BY round(w * l_discount * 10 + (1 - w) * (1 - l_tax * 12.5), 9) DESC, k) AS r
      FROM candidates, (SELECT i / 10.0::double AS w FROM range(11) t(i))) WHERE r = 1 GROUP BY w"""
)
def score_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two scores fused with each weight, and what the best fused score picks."""
    scored = candidates(spark, sf_dir).withColumns({"pairwise": F.col("l_discount") * 10, "utility": 1 - F.col("l_tax") * 12.5})
    best = {i: F.min_by(F.col("quality"), F.struct((-F.round(selection.fused_score({"pairwise": i / 10, "utility": 1 - i / 10}), 9)).alias("a"), F.col("k").alias("b"))) for i in range(11)}
    grouped = scored.groupBy("group_id").agg(*[c.alias(f"w{i}") for i, c in best.items()])
    cells = F.array(*[F.struct(F.lit(i / 10).alias("weight"), F.col(f"w{i}").alias("q")) for i in best])
    return grouped.select(F.inline(cells)).groupBy("weight").agg(F.round(F.avg("q"), 9).alias("mean_quality"))


#: Sets of features, ridges, and weights of the ranker against a given score: 27 models.
RANKING = {"price": ["l_extendedprice"], "terms": ["l_discount", "l_tax"], "all": ["l_extendedprice", "l_discount", "l_tax", "k"]}
RIDGES, FUSIONS = {"weak": 0.01, "middle": 1.0, "strong": 100.0}, {"w3": 0.3, "w7": 0.7, "w10": 1.0}
SHARES = {"train": 0.7, "validation": 0.15, "test": 0.15}


@_query()
def learned_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rankers fitted on train groups, one chosen on validation groups and held against test groups."""
    rows = candidates(spark, sf_dir)
    found = ranker.learn(rows, "group_id", "sample_id", "quality", "k", RANKING, RIDGES, FUSIONS, F.col("l_discount") * 10, SHARES, 7)
    board = found.validation.withColumnsRenamed({"strategy": "model"}).withColumn("chosen", F.col("model") == found.chosen)
    tested = found.test.select(F.col("strategy").alias("model"), *[F.col(c).alias(f"test_{c}") for c in found.test.columns if c != "strategy"])
    joined = board.join(F.broadcast(tested), "model", "left")  # one row
    return joined.withColumns({c: F.round(c, 9) for c, t in joined.dtypes if t == "double"})


def in_parts(rows: DataFrame, part: Column, n: int) -> DataFrame:
    """A task for each part from 0 to n - 1: hashes of few values meet in some tasks and leave others empty."""
    return rows.repartitionById(n, part.cast("int"))


def one_file(rows: DataFrame) -> DataFrame:
    """For a file that has to be one: what it has is chosen in all tasks, and only that goes to the one that writes (``coalesce`` reads everything there)."""
    return rows.repartition(1)


_UNIT = "lpad((l_orderkey % 16)::varchar, 2, '0')"


@_query(
    f"""WITH s AS (SELECT {_UNIT} AS p, l_orderkey, l_quantity / 50 AS q, l_linenumber AS n FROM lineitem),
    g AS (SELECT p, l_orderkey, max(q) AS best, count(*) AS n FROM s WHERE NOT (p = '07' AND n > 4) AND NOT (p = '02' AND n > 2) GROUP BY ALL)
    SELECT p, CASE WHEN p = '02' THEN 'changed' WHEN p < '04' THEN 'begun' ELSE 'resumed' END AS made, count(*) AS groups, sum(n)::bigint AS "rows", round(avg(best), 9) AS mean_best
    FROM g GROUP BY p"""
)
def resumable_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run over 16 files that is stopped after four, resumed, and run again as a file changes.

    Before it is resumed a file that wasn't read yet changes too; each unit tells which call made it.
    """
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    base = scratch_path(spark, "resumable")
    placed = line.withColumn("p", F.lpad((F.col("l_orderkey") % 16).cast("string"), 2, "0"))
    in_parts(placed, F.pmod("l_orderkey", F.lit(16)), 16).write.partitionBy("p").parquet(f"{base}/in")

    def best(rows: DataFrame) -> DataFrame:
        return rows.groupBy("unit", "l_orderkey").agg(F.max(F.col("l_quantity") / 50).alias("best"), F.count("*").alias("n"))

    def change(p: str, upto: int) -> None:
        few = placed.where((F.col("p") == p) & (F.col("l_linenumber") <= upto)).drop("p")
        one_file(few).write.mode("overwrite").parquet(f"{base}/in/p={p}")

    run = resumable.Run(spark, f"{base}/in", f"{base}/out", best, {"best": 1}, wave_units=2)
    run.resume(waves=2, label="begun")
    change("07", 4)
    run.resume(label="resumed")
    change("02", 2)
    run.resume(label="changed")
    p = F.regexp_extract("unit", "p=([0-9]+)", 1).alias("p")
    return run.result().groupBy(p, F.col("label").alias("made")).agg(F.count("*").alias("groups"), F.sum("n").alias("rows"), F.round(F.avg("best"), 9).alias("mean_best"))


_METRICS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@_query(
    " UNION ALL ".join(
        f"SELECT '{m}' AS metric, round(quantile_cont({m}, 0.05), 9) AS low, round(quantile_cont({m}, 0.95), 9) AS high FROM lineitem" for m in _METRICS
    )
)
def calibration_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """5th and 95th percentiles."""
    return calibration.bounds(table(spark, sf_dir, "lineitem"), list(_METRICS)).withColumns(_round("low", "high"))


@_query(
    """WITH b AS (SELECT quantile_cont(l_quantity, 0.05) AS lq, quantile_cont(l_quantity, 0.95) AS hq, quantile_cont(l_tax, 0.05) AS lt, quantile_cont(l_tax, 0.95) AS ht FROM lineitem),
    s AS (SELECT l_returnflag, least(1.0, greatest(0.0, (l_quantity - lq) / (hq - lq))) AS q, 1.0 - least(1.0, greatest(0.0, (l_tax - lt) / (ht - lt))) AS t FROM lineitem, b)
    SELECT l_returnflag, count(*) AS n, round(avg(0.75::double * q + 0.25::double * t), 9) AS score FROM s GROUP BY 1"""
)
def calibrated_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values between their bounds, turned where lower is better, and composed."""
    line = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_quantity", "l_tax")
    of = lambda m: F.max(F.when(F.col("metric") == m, F.struct("low", "high"))).alias(f"b_{m}")
    q = calibration.bounds(line, ["l_quantity", "l_tax"]).agg(of("l_quantity"), of("l_tax"))
    both = line.crossJoin(F.broadcast(q))  # one row
    scored = both.select(
        "l_returnflag",
        calibration.normalized(F.col("l_quantity"), F.col("b_l_quantity.low"), F.col("b_l_quantity.high")).alias("q"),
        calibration.normalized(F.col("l_tax"), F.col("b_l_tax.low"), F.col("b_l_tax.high"), positive=False).alias("t"),
    )
    return scored.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.round(F.avg(calibration.composite({"q": 3.0, "t": 1.0})), 9).alias("score"))


@_query(
    """WITH v AS (SELECT 'constant' AS metric, 0.0::double AS value FROM lineitem UNION ALL SELECT 'l_linenumber', l_linenumber::double FROM lineitem),
    b AS (SELECT metric, quantile_cont(value, 0.05) AS low, quantile_cont(value, 0.95) AS high FROM v GROUP BY metric)
    SELECT metric, low, high, CASE WHEN low = high THEN 0.0::double ELSE round(least(1.0, greatest(0.0, (value - low) / (high - low))), 9) END AS score, count(*) AS n
    FROM v JOIN b USING (metric) GROUP BY ALL"""
)
def degenerate_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal bounds give a defined score, beside a metric whose bounds differ."""
    rows = table(spark, sf_dir, "lineitem").select(F.lit(0.0).alias("constant"), F.col("l_linenumber").cast("double").alias("l_linenumber"))
    b = calibration.bounds(rows, ["constant", "l_linenumber"])
    values = rows.unpivot([], ["constant", "l_linenumber"], "metric", "value").join(F.broadcast(b), "metric")  # two rows
    scored = values.withColumn("score", F.round(calibration.normalized(F.col("value"), F.col("low"), F.col("high")), 9))
    return scored.groupBy("metric", "low", "high", "score").agg(F.count("*").alias("n"))


@_query(
    SQL
    + """, t AS (SELECT quantile_cont(quality, 0.7) AS threshold FROM candidates)
    SELECT strategy, round(any_value(threshold), 9) AS threshold, round(avg((selected_quality >= threshold)::int::double), 9) AS qualified_rate FROM picks, t GROUP BY strategy"""
)
def threshold_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A threshold at the 70th percentile, and the share of picks that reach it."""
    t = calibration.threshold(materialize(candidates(spark, sf_dir).select("quality"), "qualities"), "quality", 0.7)
    rows = picks(spark, sf_dir).crossJoin(F.broadcast(t))  # one row
    rate = F.avg((F.col("selected_quality") >= F.col("threshold")).cast("double"))
    return rows.groupBy("strategy").agg(F.round(F.first("threshold"), 9).alias("threshold"), F.round(rate, 9).alias("qualified_rate"))


@_query(
    SQL
    + """, b AS (SELECT strategy, avg(selected_quality) AS q, avg(regret) AS r FROM picks GROUP BY 1)
    SELECT (SELECT q FROM b WHERE strategy = 'rule') > (SELECT q FROM b WHERE strategy = 'random') AS rule_above_random,
    (SELECT r FROM b WHERE strategy = 'oracle') = 0 AS oracle_without_regret,
    (SELECT q FROM b WHERE strategy = 'rule') > (SELECT q FROM b WHERE strategy = 'random') AND (SELECT r FROM b WHERE strategy = 'oracle') = 0 AS allowed"""
)
def boolean_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Allowed where every named check holds."""
    board = metrics.leaderboard(picks(spark, sf_dir))
    of = lambda s, c: F.max(F.when(F.col("strategy") == s, F.col(c)))
    wide = board.agg(of("rule", "mean_quality").alias("rule"), of("random", "mean_quality").alias("random"), of("oracle", "mean_regret").alias("regret"))
    named = wide.select((F.col("rule") > F.col("random")).alias("rule_above_random"), (F.col("regret") == 0).alias("oracle_without_regret"))
    checked = F.create_map(F.lit("a"), F.col("rule_above_random"), F.lit("b"), F.col("oracle_without_regret"))
    return named.withColumn("allowed", calibration.gate(checked))


@_query(
    """SELECT lang, count(*) AS total, count(l.doc_id) AS covered, round(count(l.doc_id)::double / count(*), 9) AS rate
    FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id) GROUP BY lang"""
)
def coverage_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents and their share."""
    labels = table(spark, sf_dir, "labels").select("doc_id").distinct().withColumn("labelled", F.lit(True))
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang").join(labels, "doc_id", "left")
    return metrics.coverage(docs, F.col("labelled").isNotNull(), ["lang"]).withColumns(_round("rate"))


@_query("SELECT l.doc_id FROM labels l WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = l.doc_id AND d.source <> 'src1')")
def orphan_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels without a document, here after the documents of a source were withdrawn."""
    left = table(spark, sf_dir, "documents").where("source != 'src1'").select("doc_id")
    return table(spark, sf_dir, "labels").select("doc_id").join(left, "doc_id", "left_anti")


@_query("SELECT lang || ':' || source AS key, count(*) AS n FROM documents GROUP BY 1")
def category_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by a composite key."""
    return metrics.histogram(table(spark, sf_dir, "documents"), "lang", "source")


@_query(
    SQL + "SELECT strategy, count(*) AS n, round(avg(selected_quality), 9) AS mean, round(median(selected_quality), 9) AS median FROM picks GROUP BY strategy"
)
def median_mean_by_arm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centre of each arm."""
    stored = materialize(picks(spark, sf_dir).select("strategy", "selected_quality"), "qualities")
    return metrics.center_by(stored, "strategy", "selected_quality").withColumns(_round("mean", "median"))


@_query(
    SQL
    + """, b AS (SELECT strategy, avg(selected_quality) AS q FROM picks GROUP BY 1)
    SELECT b.strategy, round((b.q - d.q) / nullif(d.q, 0), 9) AS uplift FROM b, b d WHERE d.strategy = 'direct'"""
)
def relative_uplift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relative to the baseline."""
    board = metrics.leaderboard(picks(spark, sf_dir)).select("strategy", "mean_quality")
    base = board.where("strategy = 'direct'").select(F.col("mean_quality").alias("base"))
    return board.crossJoin(F.broadcast(base)).select("strategy", F.round(metrics.relative_uplift(F.col("base"), F.col("mean_quality")), 9).alias("uplift"))  # one row


@_query(
    SQL
    + """, w AS (SELECT group_id, sum(quality * l_discount) / nullif(sum(l_discount), 0) AS weighted, avg(quality) AS plain FROM candidates GROUP BY 1)
    SELECT count(*) AS groups, round(avg(weighted), 9) AS mean_weighted, round(avg(CASE WHEN weighted >= plain THEN weighted ELSE plain END), 9) AS mean_guarded FROM w"""
)
def guarded_weighting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted means, taken only where they don't lose to the plain ones."""
    by_group = candidates(spark, sf_dir).groupBy("group_id").agg(selection.weighted_mean("quality", "l_discount").alias("weighted"), F.avg("quality").alias("plain"))
    safe = selection.guarded(F.col("weighted"), F.col("plain"), F.col("weighted") >= F.col("plain"))
    return by_group.agg(F.count("*").alias("groups"), F.round(F.avg("weighted"), 9).alias("mean_weighted"), F.round(F.avg(safe), 9).alias("mean_guarded"))


@_query(SQL + """SELECT sample_id, regexp_extract(sample_id || '_s' || (1000 + 10 * group_id + k), '^(.+)_c(\\d+)_s(\\d+)$', 1) AS "group", k::int AS candidate, (1000 + 10 * group_id + k)::bigint AS seed, true AS seed_ok FROM candidates""")
def parsed_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids taken apart, and their seeds checked against the rule."""
    rows = candidates(spark, sf_dir)
    seed = 1000 + 10 * F.col("group_id") + F.col("k")
    rows = rows.withColumn("p", identifiers.parse_sample(F.concat("sample_id", F.lit("_s"), seed.cast("string"))))
    ok = F.col("p.seed") == identifiers.expected_seed(1000, F.col("group_id"), F.col("p.candidate"), 10)
    return rows.select("sample_id", "p.group", "p.candidate", "p.seed", ok.alias("seed_ok"))


@_query("SELECT sha256(text) AS sha256, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def checksum_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests that stand for more than one document."""
    return manifest.repeated_digests(table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("sha256")))


@_query(
    """SELECT status, count(*) AS n FROM (
      SELECT CASE WHEN doc_id % 7 = 3 THEN 'escapes' WHEN doc_id % 5 = 0 THEN 'missing' WHEN doc_id % 3 = 0 THEN 'mismatch' ELSE 'ok' END AS status FROM documents) GROUP BY status"""
)
def manifest_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest of the documents held against their digests, some of them spoilt."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))
    name = F.concat(F.lit("docs/"), F.col("doc_id").cast("string"))
    path = F.when(F.expr("doc_id % 7 = 3"), F.concat(F.lit("docs/../../"), name)).otherwise(name)
    listed = docs.select(path.alias("path"), F.when(F.expr("doc_id % 3 = 0"), F.sha2("sha256", 256)).otherwise(F.col("sha256")).alias("sha256"))
    there = docs.where("doc_id % 5 != 0").select(name.alias("path"), "sha256")
    return manifest.file_status(listed, there).groupBy("status").agg(F.count("*").alias("n"))


_CLOSE_SQL = "abs({a} - {b}) <= greatest(1e-9 * greatest(abs({a}), abs({b})), 1e-9)"
_DECLARED = (("mean_quality", "selected_quality"), ("mean_regret", "regret"), ("top1_accuracy", "top1_correct"))


def _declared(rows: DataFrame) -> DataFrame:
    """What a record would declare of its rows: a row per strategy."""
    place = F.array_position(F.array(*[F.lit(s) for s in fixture.STRATEGIES]), F.col("strategy")) - 1
    by = rows.groupBy("strategy").agg(F.count_distinct(F.col("group_id")).alias("groups"), *[F.avg(F.col(c).cast("double")).alias(m) for m, c in _DECLARED])
    return by.select("groups", place.cast("int").alias("strategy_pos"), "strategy", F.struct("groups", *[m for m, _ in _DECLARED]).alias("d"))


def _results(rows: DataFrame) -> DataFrame:
    """Picks in the form of the group results of a record."""
    return rows.withColumnsRenamed({"selected_id": "selected_sample_id", "optimal_id": "optimal_sample_id"}).withColumn("row_pos", F.col("group_id"))


def _spoilt(rows: DataFrame) -> DataFrame:
    """Picks with a violation of each kind."""
    at = lambda s, k: (F.col("strategy") == s) & (F.col("group_id") % 1000 == k)
    kept = rows.where(~at("oracle", 4)).unionByName(rows.where(at("direct", 5)))
    return kept.withColumns(
        {
            "selected_quality": F.when(at("random", 2), 1.5).otherwise(F.col("selected_quality")),
            "regret": F.when(at("rule", 3), F.col("regret") + 0.25).otherwise(F.col("regret")),
        }
    )


_SPOILT_SQL = """, r AS (SELECT strategy, group_id, selected_id, optimal_id, CASE WHEN strategy = 'random' AND group_id % 1000 = 2 THEN 1.5 ELSE selected_quality END AS q,
      optimal_quality AS o, CASE WHEN strategy = 'rule' AND group_id % 1000 = 3 THEN regret + 0.25 ELSE regret END AS regret, top1_correct::int::double AS t
      FROM (SELECT * FROM picks WHERE NOT (strategy = 'oracle' AND group_id % 1000 = 4) UNION ALL SELECT * FROM picks WHERE strategy = 'direct' AND group_id % 1000 = 5))"""


@_query(
    SQL
    + _SPOILT_SQL
    + f""", n AS (SELECT count(*) AS n FROM best), c AS (SELECT strategy, count(*) AS n_rows, count(DISTINCT group_id) AS found FROM r GROUP BY 1),
    d AS (SELECT strategy, avg(selected_quality) AS q, avg(regret) AS g, avg(top1_correct::int::double) AS t FROM picks GROUP BY 1),
    m AS (SELECT strategy, avg(q) AS q, avg(regret) AS g, avg(t) AS t FROM r GROUP BY 1),
    a AS (SELECT group_id, selected_id AS id, q AS v FROM r UNION ALL SELECT group_id, optimal_id, o FROM r),
    s AS (SELECT count(*) AS n, min(v) AS low, max(v) AS high FROM a GROUP BY group_id, id),
    v AS (SELECT 'key_set' AS "check", 1 AS n UNION ALL SELECT 'row_set', 1
      UNION ALL SELECT 'uniqueness', count(*) FROM c, n WHERE n_rows <> found OR found <> n.n
      UNION ALL SELECT 'declared_count', count(*) FROM c, n WHERE found <> n.n
      UNION ALL SELECT 'quality_range', count(*) FROM r WHERE NOT (q BETWEEN 0 AND 1 AND o BETWEEN 0 AND 1 AND q <= o + 1e-9)
      UNION ALL SELECT 'regret', count(*) FROM r WHERE NOT {_CLOSE_SQL.format(a='regret', b='(o - q)')}
      UNION ALL SELECT 'same_asset', coalesce(sum(n), 0) FROM s WHERE NOT {_CLOSE_SQL.format(a='low', b='high')}
      UNION ALL SELECT 'declared_mean', count(*) FROM (SELECT d.q AS x, m.q AS y FROM d JOIN m USING (strategy) UNION ALL SELECT d.g, m.g FROM d JOIN m USING (strategy)
        UNION ALL SELECT d.t, m.t FROM d JOIN m USING (strategy)) WHERE NOT {_CLOSE_SQL.format(a='x', b='y')}
      UNION ALL SELECT 'coverage', count(*) FROM (SELECT group_id FROM (SELECT DISTINCT strategy, group_id FROM r) GROUP BY 1 HAVING count(*) <> 4))
    SELECT "check", n::bigint AS n FROM v WHERE n > 0"""
)
def evaluation_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All checks of an evaluation over spoilt picks, violations by check."""
    rows = picks(spark, sf_dir)
    found = checks.check_rows(_declared(rows), _results(_spoilt(rows)), (*fixture.STRATEGIES, "absent"), exact_assets=False, metrics=_DECLARED)
    return found.groupBy("check").agg(F.count("*").alias("n"))


@_query(
    SQL
    + """, a AS (SELECT strategy, count(*) AS groups, avg(selected_quality) AS q, avg(top1_correct::int::double) AS t FROM picks GROUP BY 1),
    b AS (SELECT * FROM a WHERE strategy = 'direct'), l AS (SELECT * FROM a WHERE strategy = 'rule')
    SELECT 'final_groups' AS "check", NULL AS subject FROM b, l WHERE b.groups <> 64 OR l.groups <> 64
    UNION ALL SELECT 'final_rate', 'adherence_rate' FROM l WHERE NOT (t + 1 BETWEEN 0 AND 1)
    UNION ALL SELECT 'final_difference', NULL FROM b, l WHERE NOT abs((l.q - b.q) - (l.q - b.q + 0.1)) <= 1e-9
    UNION ALL SELECT 'final_interval', NULL FROM b, l WHERE NOT l.q - b.q + 0.1 <= l.q - b.q - 0.1
    UNION ALL SELECT 'final_decision', NULL WHERE 'keep' <> 'other'"""
)
def final_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A comparison of two arms in which each declared value is spoilt."""
    by = {r: F.max(F.when(F.col("strategy") == r, F.struct(F.col("groups").cast("long").alias("groups"), F.col("mean_quality").alias("q"), F.col("top1_accuracy").alias("t")))) for r in ("direct", "rule")}
    arms = metrics.leaderboard(picks(spark, sf_dir)).agg(by["direct"].alias("b"), by["rule"].alias("l"))
    arm = lambda x, more: F.struct(F.col(f"{x}.groups").alias("groups"), F.col(f"{x}.q").alias("mean_q"), F.col(f"{x}.t").alias("pass_rate"), (F.col(f"{x}.t") + more).alias("adherence_rate"), F.lit(1.0).alias("technical_valid_rate"))
    off = F.col("l.q") - F.col("b.q")
    boot = F.struct((off + 0.1).alias("mean_q_difference_lora_minus_base"), (off + 0.1).alias("ci95_low"), (off - 0.1).alias("ci95_high"))
    doc = arms.select(arm("b", 0.0).alias("base_summary"), arm("l", 1.0).alias("lora_summary"), boot.alias("paired_bootstrap"), F.lit("other").alias("decision"))
    return checks.check_final(doc, decision="keep").select("check", "subject")


@_query(
    SQL
    + """SELECT item, count(*) AS n, count(DISTINCT id) AS assets, round(avg(v), 9) AS mean_value FROM (
      SELECT 'selected' AS item, selected_id AS id, selected_quality AS v FROM picks UNION ALL SELECT 'optimal', optimal_id, optimal_quality FROM picks) GROUP BY item"""
)
def asset_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row as its selected and its optimal asset."""
    of = lambda x: F.struct(F.lit(x).alias("item"), F.col(f"{x}_id").alias("id"), F.col(f"{x}_quality").alias("v"))
    cells = picks(spark, sf_dir).select(F.inline(F.array(of("selected"), of("optimal"))))
    return cells.groupBy("item").agg(F.count("*").alias("n"), F.count_distinct(F.col("id")).alias("assets"), F.round(F.avg("v"), 9).alias("mean_value"))


@_query(SQL + "SELECT strategy, round(avg(selected_quality), 9) AS mean FROM picks GROUP BY strategy")
def recomputed_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The map of strategies to recomputed means, entry by entry."""
    return checks.means_of(picks(spark, sf_dir)).select(F.explode("means").alias("strategy", "mean")).withColumns(_round("mean"))


@_query(
    """WITH f AS (SELECT doc_id, 'glb' AS kind, doc_id % 11 = 4 AS out FROM documents UNION ALL SELECT doc_id, 'preview', false FROM documents)
    SELECT kind, CASE WHEN out THEN 'escapes' WHEN kind = 'preview' AND doc_id % 5 = 0 THEN 'missing' WHEN kind = 'glb' AND doc_id % 3 = 0 THEN 'mismatch' ELSE 'ok' END AS status,
    count(*) AS n FROM f GROUP BY ALL"""
)
def manifest_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two files of each asset, flattened and held against what is there."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))
    name = lambda k: F.concat(F.lit(f"{k}/"), F.col("doc_id").cast("string"))
    assets = docs.select(
        F.col("doc_id").alias("asset"),
        F.when(F.expr("doc_id % 11 = 4"), F.concat(F.lit("../"), name("glb"))).otherwise(name("glb")).alias("glb"),
        F.when(F.expr("doc_id % 3 = 0"), F.sha2("digest", 256)).otherwise(F.upper("digest")).alias("glb_sha256"),
        name("preview").alias("preview"),
        F.col("digest").alias("preview_sha256"),
    )
    there = docs.select(name("glb").alias("path"), F.col("digest").alias("sha256"))
    there = there.union(docs.where("doc_id % 5 != 0").select(name("preview"), "digest"))
    return manifest.file_status(manifest.files_of(assets), there).groupBy("kind", "status").agg(F.count("*").alias("n"))


_SPLIT_ID_SQL = "CASE WHEN k = 3 THEN 'plain_' ELSE 'lora_' || CASE k WHEN 0 THEN 'train' WHEN 1 THEN 'validation' ELSE 'dev_test' END || '_' END || 'v2_' || group_id || '_c' || k || '_s' || (2000 + 4 * group_id + k)"


@_query(
    SQL
    + f""", i AS (SELECT {_SPLIT_ID_SQL} AS id FROM candidates), p AS (SELECT id, '^([^_]+)_(train|validation|dev_test)_(.+)_c(\\d+)_s(\\d+)$' AS x FROM i)
    SELECT id, nullif(regexp_extract(id, x, 1), '') AS prefix, nullif(regexp_extract(id, x, 2), '') AS split, nullif(regexp_extract(id, x, 3), '') AS "group",
    nullif(regexp_extract(id, x, 4), '')::int AS candidate, nullif(regexp_extract(id, x, 5), '')::bigint AS seed FROM p"""
)
def split_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids that name their split, taken apart; others give nulls."""
    rows = candidates(spark, sf_dir)
    split = F.when(F.col("k") == 0, "train").when(F.col("k") == 1, "validation").otherwise("dev_test")
    front = F.when(F.col("k") == 3, "plain_").otherwise(F.concat(F.lit("lora_"), split, F.lit("_")))
    seed = 2000 + 4 * F.col("group_id") + F.col("k")
    name = F.concat(front, F.lit("v2_"), F.col("group_id").cast("string"), F.lit("_c"), F.col("k").cast("string"), F.lit("_s"), seed.cast("string"))
    return rows.select(name.alias("id")).select("id", identifiers.parse_split_sample(F.col("id")).alias("p")).select("id", "p.*")


@_query(
    """SELECT CASE WHEN doc_id % 4 <> 1 THEN 'docs/' || doc_id END AS path, CASE WHEN doc_id % 4 <> 1 THEN sha256(text) END AS sha256
    FROM documents WHERE doc_id % 9 <> 0"""
)
def hash_list_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of digests and paths, with empty and malformed ones among them."""
    docs = table(spark, sf_dir, "documents")
    gap = F.when(F.expr("doc_id % 4 = 1"), " ").otherwise("  ")
    line = F.concat(F.upper(F.sha2("text", 256)), gap, F.lit("docs/"), F.col("doc_id").cast("string"))
    return records.hash_lines(docs.select(F.when(F.expr("doc_id % 9 = 0"), "").otherwise(line).alias("value")))


_WRONG_SQL = f"""(SELECT count(*) FILTER (WHERE NOT (q BETWEEN 0 AND 1 AND o BETWEEN 0 AND 1 AND q <= o + 1e-9)) + count(*) FILTER (WHERE NOT {_CLOSE_SQL.format(a='regret', b='(o - q)')})
      + abs(count(*) - count(DISTINCT strategy || ':' || group_id)) + abs(count(*) - 4 * count(DISTINCT group_id)) FROM {{}})"""


@_query(
    SQL
    + _SPOILT_SQL
    + f""", clean AS (SELECT strategy, group_id, selected_quality AS q, optimal_quality AS o, regret FROM picks),
    m AS (SELECT strategy, avg(selected_quality) AS mean FROM picks GROUP BY 1),
    a AS (SELECT count(*) FILTER (WHERE doc_id % 3 <> 0 AND doc_id % 5 <> 0)::bigint AS n FROM documents)
    SELECT CASE WHEN {_WRONG_SQL.format('clean')} = 0 THEN 'passed' ELSE 'failed' END AS status, CASE WHEN {_WRONG_SQL.format('r')} = 0 THEN 'passed' ELSE 'failed' END AS spoilt_status,
    (SELECT count(*) FROM best) AS groups, (SELECT n FROM a) AS assets,
    CASE WHEN (SELECT mean FROM m WHERE strategy = 'rule') > (SELECT mean FROM m WHERE strategy = 'direct') THEN 'take_rule' ELSE 'keep_direct' END AS decision,
    strategy, round(mean, 9) AS mean FROM m"""
)
def audit_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of the picks, and of the same when spoilt, with a decision, and the assets whose files are as listed."""
    rows = materialize(picks(spark, sf_dir), "picks")
    named = materialize(_declared(rows), "declared")
    status = lambda r: checks.check_rows(named, _results(r), fixture.STRATEGIES, exact_assets=False, metrics=_DECLARED).agg(F.when(F.count("*") == 0, "passed").otherwise("failed").alias("status"))
    of = lambda s: F.max(F.when(F.col("strategy") == s, F.col("d.mean_quality")))
    decision = named.agg(F.when(of("rule") > of("direct"), "take_rule").otherwise("keep_direct").alias("decision"))
    bad = _asset_files(spark, sf_dir, ("glb", "preview")).groupBy("asset").agg(F.bool_and(F.col("status") == "ok").alias("ok"))
    made = report.summary(named.select("groups").limit(1), checks.means_of(rows), decision, bad.agg(F.count_if("ok").alias("n_assets")), status(rows))
    spoilt = status(_spoilt(rows)).select(F.col("status").alias("spoilt_status"))
    means = F.explode("stage1_recomputed_mean_quality").alias("strategy", "mean")
    told = made.crossJoin(spoilt).select("status", "spoilt_status", F.col("stage1_groups").alias("groups"), F.col("showcase_assets_verified").alias("assets"), F.col("final_decision").alias("decision"), means)  # one row
    return told.withColumns(_round("mean"))


def _asset_files(spark: SparkSession, sf_dir: str, kinds: tuple[str, ...]) -> DataFrame:
    """A manifest of two files for each document, held against what is there: every third has another digest, every fifth lacks one."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))
    name = lambda k: F.concat(F.lit(f"{k}/"), F.col("doc_id").cast("string"))
    columns = [c for k in kinds for c in (name(k).alias(k), F.when(F.expr("doc_id % 3 = 0"), F.sha2("digest", 256)).otherwise(F.col("digest")).alias(f"{k}_sha256"))]
    there = docs.where("doc_id % 5 != 0").select(F.explode(F.array(*[name(k) for k in kinds])).alias("path"), F.col("digest").alias("sha256"))
    return manifest.file_status(manifest.files_of(docs.select(F.col("doc_id").alias("asset"), *columns), kinds), there)


@_query(
    """WITH s AS (SELECT lang, source, count(*) AS n, count(text) AS texts, avg(n_chars::double) AS mean, bool_and(n_chars > 0) AS filled FROM documents WHERE source IS NOT NULL GROUP BY ALL)
    SELECT lang || '/' || source AS name, filled AND texts = n AS allowed, (filled IS NOT TRUE)::int + (texts <> n)::int AS failed, round(mean, 6) AS threshold, n AS training_records FROM s"""
)
def record_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON documents of gates and calibrations, a file for each language and source, read back by their schemas.

    Numbers are written as strings, and flags as 0 and 1.
    """
    docs = table(spark, sf_dir, "documents").where("source is not null")
    by = docs.groupBy("lang", "source").agg(F.count("*").alias("n"), F.count("text").alias("texts"), F.avg("n_chars").alias("mean"), F.bool_and(F.col("n_chars") > 0).alias("filled"))
    name = F.concat_ws("/", "lang", "source")
    base = scratch_path(spark, "records")
    gate = F.struct(name.alias("schema_version"), F.create_map(F.lit("filled"), F.col("filled").cast("int"), F.lit("whole"), (F.col("texts") == F.col("n")).cast("int")).alias("checks"), F.lit("false").alias("test_used_for_selection"))
    bounds = F.struct(name.alias("scoring_version"), F.col("mean").cast("string").alias("quality_threshold"), F.struct(F.col("n").cast("string").alias("training_records")).alias("normalization"))
    # a document for each key: as many small files as there are languages and sources
    for kind, value in (("gate", gate), ("calibration", bounds)):
        by.repartition("lang", "source").select(F.to_json(value).alias("value"), F.concat_ws("-", "lang", "source").alias("key")).write.partitionBy("key").text(f"{base}/{kind}")
    gates = records.read_record(spark, f"{base}/gate/*", "gate")
    calibrations = records.read_record(spark, f"{base}/calibration/*", "calibration")
    ok = gates.select(F.col("schema_version").alias("name"), calibration.gate(F.col("checks")).alias("allowed"), F.size(F.map_filter("checks", lambda _, v: ~v)).alias("failed"))
    return ok.join(calibrations.select(F.col("scoring_version").alias("name"), F.round("quality_threshold", 6).alias("threshold"), "normalization.training_records"), "name")


@_query(
    """WITH s AS (SELECT source, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY 1)
    SELECT source, sha256(source || ' has ' || n || chr(10)) AS actual, CASE WHEN n % 3 = 0 THEN 'mismatch' WHEN n % 3 = 1 THEN 'unlisted' ELSE 'ok' END AS status,
      strlen(source || ' has ' || n || chr(10))::bigint AS length FROM s"""
)
def hash_list_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files as bytes, their digests, and a hash list of them that is read as text; some lines are wrong, some lack."""
    by = table(spark, sf_dir, "documents").where("source is not null").groupBy("source").agg(F.count("*").alias("n"))
    line = F.concat(F.col("source"), F.lit(" has "), F.col("n").cast("string"))
    base = scratch_path(spark, "hashes")
    by.repartition("source").select(line.alias("value"), F.col("source").alias("key")).write.partitionBy("key").text(f"{base}/files")
    there = materialize(records.read_digests(spark, f"{base}/files", "*.txt"), "digests")
    key = F.regexp_extract("path", "^key=([^/]*)/", 1)
    known = there.withColumn("source", key).join(by, "source")
    listed = known.where("n % 3 != 1").select(F.concat(F.when(F.col("n") % 3 == 0, F.sha2("sha256", 256)).otherwise(F.upper("sha256")), F.lit("  "), F.col("path")).alias("value"))
    listed.write.text(f"{base}/lists")
    status = manifest.file_status(records.read_hash_list(spark, f"{base}/lists"), there).select("path", "status")
    return there.join(status, "path", "left").select(key.alias("source"), F.col("sha256").alias("actual"), F.coalesce("status", F.lit("unlisted")).alias("status"), "length")


@_query(
    """WITH l AS (SELECT 'docs/' || doc_id AS path, sha256(text) AS h, doc_id FROM documents),
    f AS (SELECT path, CASE WHEN doc_id % 89 = 5 THEN sha256(h) ELSE h END AS h FROM l WHERE doc_id % 97 <> 3 UNION ALL SELECT 'extra/' || path, h FROM l WHERE doc_id % 83 = 7)
    SELECT coalesce(l.path, f.path) AS path, CASE WHEN f.path IS NULL THEN 'missing' WHEN l.path IS NULL THEN 'unexpected' ELSE 'different' END AS status,
    (l.path IS NOT NULL)::bigint AS listed_rows, (f.path IS NOT NULL)::bigint AS found_rows
    FROM l FULL JOIN f ON l.path = f.path WHERE l.path IS NULL OR f.path IS NULL OR l.h IS DISTINCT FROM f.h"""
)
def manifest_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest of all documents against what is there, by hash trees; some are missing, changed or too many."""
    listed = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("docs/"), F.col("doc_id").cast("string")).alias("path"), F.sha2("text", 256).alias("h"))
    found = listed.where("doc_id % 97 != 3").select("path", F.when(F.expr("doc_id % 89 = 5"), F.sha2("h", 256)).otherwise(F.col("h")).alias("h"))
    found = found.union(listed.where("doc_id % 83 = 7").select(F.concat(F.lit("extra/"), F.col("path")), "h"))
    return reconcile.reconcile(listed, found, ["path"], ["h"]).differences


#: Microseconds of a day.
DAY = 86_400_000_000


@_query(
    """WITH o AS (SELECT o_custkey, o_orderdate, max(o_orderkey) AS k FROM orders GROUP BY ALL),
    e AS (SELECT event_id, user_id, ts - INTERVAL 9131 DAY AS t FROM events),
    j AS (SELECT event_id, o_custkey, o.o_orderdate, k FROM e ASOF LEFT JOIN o ON user_id = o_custkey AND t >= o_orderdate)
    SELECT event_id, k AS asof_o_orderkey, round(o_totalprice, 9) AS asof_o_totalprice FROM j LEFT JOIN orders p ON p.o_orderkey = k AND p.o_custkey = j.o_custkey AND p.o_orderdate = j.o_orderdate"""
)
def asof_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: each event with the last order of its user before it, 25 years back, where the orders are."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", (F.col("ts") - F.expr("INTERVAL 9131 DAY")).alias("t"))
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice")
    found = temporal.asof_join(events, orders, "user_id", "t", "o_custkey", "o_orderdate", ["o_orderkey", "o_totalprice"], ["o_orderkey"], 90 * DAY)
    return found.select("event_id", "asof_o_orderkey", F.round("asof_o_totalprice", 9).alias("asof_o_totalprice"))


@_query(
    """SELECT c.event_id AS click_id, v.event_id AS view_id FROM events c JOIN events v ON c.user_id = v.user_id AND c.event_type = 'click' AND v.event_type = 'view'
    AND v.ts BETWEEN c.ts - INTERVAL 1 HOUR AND c.ts + INTERVAL 6 HOUR"""
)
def clicks_near_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: views from an hour before to six hours after each click of a user."""
    events = table(spark, sf_dir, "events")
    of = lambda kind: events.where(F.col("event_type") == kind).select(F.col("event_id").alias(f"{kind}_id"), F.col("user_id").alias(f"{kind}_user"), F.col("ts").alias(f"{kind}_ts"))
    pairs = temporal.interval_join(of("click"), of("view"), "click_user", "click_ts", "view_user", "view_ts", -DAY // 24, DAY // 4)
    return pairs.select("click_id", "view_id")


@_query(
    """SELECT event_id, count(*) OVER w AS events_of_day, round(sum(value) OVER w, 6) AS value_of_day FROM events
    WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW)"""
)
def sums_of_a_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: events and their values of a user in the day up to each event, by blocks of two days with halo rows."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value")
    summed = temporal.range_sums(events, "user_id", "ts", {"events_of_day": F.lit(1), "value_of_day": F.col("value")}, DAY, 2 * DAY)
    return summed.select("event_id", "events_of_day", F.round("value_of_day", 6).alias("value_of_day"))


@_query(
    """SELECT event_type, part, day, grouping_id(event_type, part, day)::bigint AS level, count(*) AS "rows", count(value) AS value_n, sum(value::decimal(28,4))::double AS value_sum,
    round(sum(value::decimal(28,4))::double / nullif(count(value), 0), 9) AS value_mean, min(value) AS value_least, max(value) AS value_most
    FROM (SELECT *, user_id % 5 AS part, dayofmonth(ts) // 10 AS day FROM events) GROUP BY CUBE (event_type, part, day)"""
)
def merged_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: a cube from a stored state of ten days, merged with those of two later parts, each read once."""
    events = table(spark, sf_dir, "events").select("event_type", (F.col("user_id") % 5).alias("part"), F.floor(F.dayofmonth("ts") / 10).alias("day"), "value", F.dayofmonth("ts").alias("d"))
    dims = ["event_type", "part", "day"]
    stored = None
    for part in ("d < 10", "d between 10 and 19", "d > 19"):
        new = cubes.state(events.where(part), dims, ["value"])
        stored = materialize(new if stored is None else cubes.merged([stored, new], dims, ["value"]), "cube-state")
    return cubes.cube(stored, dims, ["value"]).withColumns({**_round("value_mean"), "level": F.col("level").cast("long")})


@_query(
    """WITH c AS (SELECT event_type, count(*) AS "rows", count(DISTINCT user_id) AS users FROM events GROUP BY 1)
    SELECT event_type, "rows", users, true AS users_within, true AS median_within, true AS shared_within FROM c"""
)
def merged_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: users and values by event type from stored sketches of each day, held against exact ones within the stated bounds.

    Shared users are those of a type that views have too, from the states alone.
    """
    events = table(spark, sf_dir, "events").select("event_type", F.to_date("ts").alias("day"), "user_id", "value")
    stored = materialize(sketches.states(events, ["event_type", "day"], "user_id", "value"), "sketches")
    by = materialize(sketches.merged(stored, ["event_type"]), "merged-sketches")
    views = F.broadcast(by.where("event_type = 'view'").select(F.col("theta").alias("view_theta")))  # one row
    told = by.crossJoin(views).select("event_type", "rows", sketches.distinct(F.col("hll")).alias("about"), sketches.quantile(F.col("kll"), 0.5).alias("median"), sketches.overlap(F.col("theta"), F.col("view_theta")).alias("shared"))
    seen = events.where("event_type = 'view'").select("user_id").distinct().withColumn("views", F.lit(1))
    users = events.groupBy("event_type", "user_id").agg(F.count("*").alias("n")).join(seen, "user_id", "left")
    exact = users.groupBy("event_type").agg(F.count("user_id").alias("users"), F.count("views").alias("both"))
    ranks = events.join(F.broadcast(told.select("event_type", "median")), "event_type").groupBy("event_type").agg(F.avg((F.col("value") < F.col("median")).cast("double")).alias("below"), F.avg((F.col("value") <= F.col("median")).cast("double")).alias("upto"))
    all_ = told.join(exact, "event_type").join(ranks, "event_type")
    within = lambda about, exact, bound: F.abs(F.col(about) - F.col(exact)) <= bound
    return all_.select(
        "event_type", "rows", "users",
        within("about", "users", sketches.HLL_ERROR * F.col("users")).alias("users_within"),
        ((F.col("below") <= 0.5 + sketches.RANK_ERROR) & (F.col("upto") >= 0.5 - sketches.RANK_ERROR)).alias("median_within"),
        within("shared", "both", sketches.THETA_ERROR * (F.col("users") + F.lit(1))).alias("shared_within"),
    )


#: Batches in which events arrive, and minutes that the watermark stays behind.
BATCHES, DELAY = 6, 60
_ARRIVAL = "CASE WHEN event_id % 50 = 0 THEN 5 ELSE least(4, dayofmonth(ts) // 6) END"


@_query(
    f"""WITH a AS (SELECT *, {_ARRIVAL} AS batch, time_bucket(INTERVAL 6 HOUR, ts) AS start FROM events),
    w AS (SELECT b AS batch, (SELECT max(ts) - INTERVAL {DELAY} MINUTE FROM a WHERE batch < b - 1) AS mark FROM range({BATCHES}) t(b)),
    k AS (SELECT a.*, mark IS NOT NULL AND start + INTERVAL 6 HOUR <= date_trunc('milliseconds', mark) AS late FROM a JOIN w USING (batch))
    SELECT start, start + INTERVAL 6 HOUR AS "end", event_type, count(*) AS n, sum(value::decimal(28,4))::double AS total, (SELECT count(*) FROM k WHERE late) AS late FROM k WHERE NOT late GROUP BY ALL"""
)
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: windows of six hours over events that arrive in six batches, read as a stream until exhausted; every fiftieth comes last, most of them late."""
    rows = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "value", F.expr(_ARRIVAL.replace("dayofmonth(ts) // 6", "dayofmonth(ts) div 6")).cast("int").alias("batch"))
    base = scratch_path(spark, "arrivals")
    for b in range(BATCHES):
        one_file(rows.where(F.col("batch") == b).drop("batch")).write.mode("append").parquet(base)
    last = rows.agg(F.max("ts").alias("ts")).where("ts is not null")
    last.select(F.lit(-1).cast("long").alias("event_id"), (F.col("ts") + F.expr("INTERVAL 10 DAY")).alias("ts"), F.lit("end").alias("event_type"), F.lit(0.0).alias("value")).coalesce(1).write.mode("append").parquet(base)
    stream = events_stream.arrivals(spark, base, rows.drop("batch").schema)
    found = events_stream.exhausted(events_stream.counts(stream, events_stream.tumbling(F.col("ts"), "6 hours"), ["event_type"], "value", delay=f"{DELAY} minutes"))
    found = found.where("event_type != 'end'")
    timed = found.select(F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "event_type", "n", "total")
    return timed.crossJoin(F.broadcast(events_stream.late_rows(rows, found)))  # one row


@_query(
    f"""WITH a AS (SELECT event_id, user_id, value, {_ARRIVAL} AS batch FROM events WHERE user_id IS NOT NULL AND value IS NOT NULL),
    o AS (SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY batch, event_id) AS before FROM a)
    SELECT user_id AS key, event_id AS at, value, before FROM o WHERE NOT abs(value - before) <= greatest(1e-9 * greatest(abs(value), abs(before)), 1e-9)"""
)
def streamed_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension, A20: each value of a user against the one before, by state that is kept from batch to batch."""
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "value", F.expr(_ARRIVAL.replace("dayofmonth(ts) // 6", "dayofmonth(ts) div 6")).cast("int").alias("batch"))
    base = scratch_path(spark, "arrivals")
    for b in range(BATCHES):
        one_file(rows.where(F.col("batch") == b).drop("batch")).write.mode("append").parquet(base)
    stream = events_stream.arrivals(spark, base, rows.drop("batch").schema)
    return events_stream.exhausted(events_stream.drifts(stream, "user_id", "value", "event_id"))


@_query(
    """SELECT lang || '.txt' AS list, count(*) AS files, count(DISTINCT sha256(text)) AS digests FROM documents
    WHERE lang IN ('de', 'fr') AND ('docs/' || doc_id) LIKE 'docs/1%' AND text IS NOT NULL GROUP BY lang"""
)
def hash_list_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension, B32: hash lists of each language, read in SQL by a data source that is known by its name; other lists aren't opened."""
    docs = table(spark, sf_dir, "documents").where("text is not null and lang is not null")
    base = scratch_path(spark, "hash-lists")
    line = F.concat(F.sha2("text", 256), F.lit("  docs/"), F.col("doc_id").cast("string"))
    docs.select(line.alias("value"), "lang").write.partitionBy("lang").text(base)
    plugins.register(spark)
    view = f"hash_lists_{uuid.uuid4().hex}"
    spark.sql(f"CREATE TEMPORARY VIEW {view} USING hash_list OPTIONS (path '{base}')")
    names = [r[0] for r in spark.sql(f"SELECT DISTINCT list FROM {view} WHERE list LIKE 'lang=de/%' OR list LIKE 'lang=fr/%'").collect()]  # a name for each file
    told = ", ".join(f"'{n}'" for n in names) or "''"
    return spark.sql(
        f"""SELECT regexp_extract(list, 'lang=([a-z]+)/', 1) || '.txt' AS list, count(*) AS files, count(DISTINCT sha256) AS digests
        FROM {view} WHERE list IN ({told}) AND path LIKE 'docs/1%' GROUP BY 1"""
    )


@_query(
    """WITH o AS (SELECT user_id, event_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events WHERE value IS NOT NULL)
    SELECT user_id AS key, event_id AS at, value, before FROM o WHERE NOT abs(value - before) <= greatest(1e-9 * greatest(abs(value), abs(before)), 1e-9)"""
)
def last_seen_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension, A20: the last-seen rule as a function that takes a table, in SQL."""
    plugins.register(spark)
    view = f"seen_{uuid.uuid4().hex}"
    table(spark, sf_dir, "events").select(F.col("user_id").cast("long").alias("k"), F.col("event_id").cast("long").alias("at"), F.col("value").cast("double").alias("v")).createTempView(view)
    return spark.sql(f"SELECT * FROM last_seen(TABLE(SELECT k, at, v FROM {view}) PARTITION BY k ORDER BY at)")


@_query(
    """SELECT label, count(*) AS n, round(avg(list_dot_product(embedding::double[], embedding::double[])), 6) AS mean_square FROM embeddings GROUP BY label"""
)
def embedding_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: squared norms of the embeddings by label."""
    square = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg(square), 6).alias("mean_square"))


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)
