"""Connected components of a large graph by alternating large-star and small-star steps.

The edges stay in tables.  First each task makes stars of its own edges, ``HELD`` at a time, so it
holds no more whatever the graph.  Where all edges fit into that, these stars are the components,
in one pass.  Otherwise rounds follow: each is two grouped minima and two joins, written to the
shared folder, and the number of rounds grows with the logarithm of the longest chain.  A node with
very many edges costs partial minima before the shuffle, and its side of a join can be split.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veridrift.llm.scratch import materialize, owned
from veridrift.sources.tables import Tables

#: Edges that a task holds at once.
HELD = 1 << 18


def _stars(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    """(u, v): the smallest node that these edges connect each node with, itself included."""
    above: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := above.setdefault(x, x)) != x:
            above[x] = above[up]
            x = above[x]
        return x

    for batch in held:
        for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), strict=True):
            a, b = root(u), root(v)
            above[max(a, b)] = min(a, b)
    nodes = list(above)
    return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], ["u", "v"])


def _contracted(edges: DataFrame, held: int) -> DataFrame:
    """Edges (u, v), with u = v for the centre, of the stars that each task makes of ``held`` edges at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        room = held
        for batch in batches:
            while batch.num_rows > room:
                yield _stars([*kept, batch.slice(0, room)])
                kept, batch, room = [], batch.slice(room), held
            kept.append(batch)
            room -= batch.num_rows
        if kept:
            yield _stars(kept)

    return edges.mapInArrow(run, "u long, v long")


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link the neighbours of each node to the smallest of the node and its neighbours.

    Large star does so for the neighbours above the node, small star for those below it.
    """
    both = edges if not large else edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    if not large:  # u > v in every stored edge
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        moved = both.join(least, "u").select(F.col("v").alias("u"), "m")
        return moved.union(least.select("u", "m")).where("u > m").select("u", F.col("m").alias("v")).distinct()
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    moved = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), "m")
    return moved.where("u > m").select("u", F.col("m").alias("v")).distinct()


def components(edges: DataFrame, held: int = HELD) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of an edge (u, v).

    Nodes are non-null integers; loops and repeated edges do no harm.  A task holds ``held`` edges.
    """
    with owned() as mine:
        return _components(edges, held, mine)


def _components(edges: DataFrame, held: int, mine: Tables) -> DataFrame:
    edges = materialize(
        edges.select(F.greatest("u", "v").cast("long").alias("u"), F.least("u", "v").cast("long").alias("v")).distinct(),
        "edges",
    )
    count = edges.count()
    stars = materialize(_contracted(edges.coalesce(max(1, -(-count // held))), held), "star")
    mine.sweep(stars.sparkSession, stars)
    if count <= held:
        return stars.select(F.col("u").alias("node"), F.col("v").alias("component"))
    edges = stars
    loops = edges.where("u = v")
    live = edges.where("u > v")
    before = None
    while True:
        live = materialize(_star(_star(live, True), False), "star")
        mine.sweep(live.sparkSession, edges, live)  # not the round before
        # both stars leave a forest of stars exactly when nothing changes any more
        now = live.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if before == tuple(now):
            break
        before = tuple(now)
    roots = live.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    found = live.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
    alone = loops.select(F.col("u").alias("node")).join(found.select("node"), "node", "left_anti")
    return found.union(alone.select("node", F.col("node").alias("component")))
