"""Reconciliation of two tables by hash trees: only ranges whose digests differ are compared.

Rows lie on a line by a hash of their key.  A node of the tree is a range of it, and its digest is
the number of its rows and two sums of their hashes, which partial sums make before the shuffle.
From the root, both tables give the digests of the children of the nodes that differ; what agrees is
never looked at again.  A level costs a scan of both tables and shuffles ``WAYS`` rows for each task
and open node at most.  When the ranges that differ are small, their rows are compared as they are.

So what is shuffled grows with the differences and not with the tables, unless most ranges differ;
then there is nothing to save and the descent ends.  Open nodes are sent to the tasks where they are
counted and few.

Rows are compared as a bag: a key is reported with its number of rows on both sides when it is on
one side only (``missing``: from the found side, ``unexpected``: from the listed one), or has other
values or another number of rows (``different``).  Null keys are keys like any other.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridrift.sources.tables import materialize

#: Bits of a level; bits of the line; rows of a range that needn't be cut; open nodes that are sent to all tasks.
STEP, LINE, FEW, SMALL = 8, 60, 64, 100_000
WAYS = 1 << STEP


def _hash(seed: int, columns: list[str]) -> Column:
    """A hash in which a null differs from nothing, and its column from another."""
    return F.xxhash64(F.lit(seed), *[x for c in columns for x in (F.col(c).isNull(), F.col(c))])


def _placed(rows: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """``rows`` with their place on the line, and two hashes of all that is compared."""
    named = rows.select(*keys, *values)
    place = F.shiftrightunsigned(_hash(1, keys), 64 - LINE)
    return named.withColumns({"place": place, "h1": _hash(2, [*keys, *values]), "h2": _hash(3, [*keys, *values])})


def _digests(rows: DataFrame, bits: int, side: str) -> DataFrame:
    node = F.shiftright("place", LINE - bits).alias("node")
    wide = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    return rows.groupBy(node).agg(F.count("*").alias(f"n_{side}"), F.struct(F.count("*").alias("n"), wide("h1").alias("a"), wide("h2").alias("b")).alias(side))


def _near(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= SMALL else df


@dataclass
class Reconciled:
    """The differences, and what it took to find them: levels, ranges and rows that were compared."""

    differences: DataFrame
    levels: int
    ranges: int
    rows: int


def reconcile(listed: DataFrame, found: DataFrame, keys: list[str], values: list[str]) -> Reconciled:
    """``differences``: (keys..., status, listed_rows, found_rows).  Both tables are scanned once a level."""
    left, right = (_placed(t, keys, values) for t in (listed, found))
    bits, nodes, compared = 0, None, 0
    while True:
        bits = min(LINE, bits + STEP)
        both = _digests(left, bits, "l").join(_digests(right, bits, "r"), "node", "full_outer")
        both = materialize(both.select("node", F.coalesce("n_l", F.lit(0)).alias("n_l"), F.coalesce("n_r", F.lit(0)).alias("n_r"), (~F.col("l").eqNullSafe(F.col("r"))).alias("differs")), "digests")
        total, open_, inside = both.agg(F.count("*"), F.count_if("differs"), F.sum(F.when(F.col("differs"), F.col("n_l") + F.col("n_r")))).first()
        nodes = both.where("differs").select("node")
        compared = inside or 0
        if not open_:
            return Reconciled(_compared(left.limit(0), right.limit(0), keys), bits // STEP, 0, 0)
        here = lambda rows, b=bits, n=nodes, k=open_: rows.withColumn("node", F.shiftright("place", LINE - b)).join(_near(n, k), "node", "left_semi").drop("node")
        left, right = here(left), here(right)
        if bits == LINE or compared <= FEW * open_ or 2 * open_ > total:
            return Reconciled(_compared(left, right, keys), bits // STEP, open_, compared)


def _compared(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    def by_key(rows: DataFrame, side: str) -> DataFrame:
        wide = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
        bag = rows.groupBy(*[F.col(k).alias(f"{side}_{i}") for i, k in enumerate(keys)]).agg(F.count("*").alias(f"{side}_n"), wide("h1").alias(f"{side}_a"), wide("h2").alias(f"{side}_b"))
        return bag

    same = [F.col(f"l_{i}").eqNullSafe(F.col(f"r_{i}")) for i in range(len(keys))]
    both = by_key(left, "l").join(by_key(right, "r"), same, "full_outer")
    status = F.when(F.col("r_n").isNull(), "missing").when(F.col("l_n").isNull(), "unexpected").when((F.col("l_n") != F.col("r_n")) | (F.col("l_a") != F.col("r_a")) | (F.col("l_b") != F.col("r_b")), "different")
    named = [F.when(F.col("l_n").isNotNull(), F.col(f"l_{i}")).otherwise(F.col(f"r_{i}")).alias(k) for i, k in enumerate(keys)]
    zero = F.lit(0).cast("long")
    return both.select(*named, status.alias("status"), F.coalesce("l_n", zero).alias("listed_rows"), F.coalesce("r_n", zero).alias("found_rows")).where("status is not null")
