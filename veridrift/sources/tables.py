"""Intermediate tables in the shared folder of the cluster.

Iterative operators cut lineage by writing a Parquet table and reading it back.  The table
survives the loss of any executor, its size is known to the planner, and its columns are pruned
by later reads.  The folder is the one named in ``spark.checkpoint.dir``; only a local session
without that setting gets one of its own.

Tables belong to whoever wrote them: inside ``owned()`` those of this thread are noted, and only
they can be swept.  Work elsewhere, in other threads or between two steps, keeps its own.
"""

from __future__ import annotations

import atexit
import contextlib
import threading
import uuid
from collections.abc import Iterator
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_OWN = "/tmp/checkpoints/veridrift"
#: Removes the shuffle files of a query when the query ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.  Raises on a cluster that names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return _OWN


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark).rstrip('/')}/veridrift-{uuid.uuid4().hex[:12]}-{name}"
    atexit.register(remove, spark, path)
    return path


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system of ``path``, and the path in its form."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def remove(spark: SparkSession, path: str) -> None:
    """Delete ``path`` through Hadoop's file system API, if the session still runs."""
    try:
        if spark.sparkContext._jvm is None or spark.sparkContext._jsc is None:
            return
        system, where = file_system(spark, path)
        system.delete(where, True)
    except Exception:  # the session has ended; nothing more can be done
        return


class Tables:
    """The intermediate tables of one piece of work."""

    def __init__(self) -> None:
        self.paths: list[str] = []

    def sweep(self, spark: SparkSession, *needed: DataFrame) -> None:
        """Remove the tables of this work that no DataFrame in ``needed`` reads."""
        read = {root for df in needed for root in roots(df)}
        for path in [p for p in self.paths if p.rsplit("/", 1)[1] not in read]:
            remove(spark, path)
            self.paths.remove(path)


_owner: ContextVar[Tables | None] = ContextVar("owner", default=None)


@contextlib.contextmanager
def owned() -> Iterator[Tables]:
    """Note the tables that are written inside, in this thread; what is left then is the outer owner's."""
    outer, mine = _owner.get(), Tables()
    token = _owner.set(mine)
    try:
        yield mine
    finally:
        _owner.reset(token)
        if outer is not None:
            outer.paths += mine.paths


#: Writers at work in all threads, and the setting as it was before the first of them.
_writers, _before, _lock = [0], ["false"], threading.Lock()


@contextlib.contextmanager
def _cleaned(spark: SparkSession) -> Iterator[None]:
    """Shuffle files go when their query ends, for as long as any thread writes a table."""
    with _lock:
        if not _writers[0]:
            _before[0] = spark.conf.get(_CLEANUP, "false")
            spark.conf.set(_CLEANUP, "true")
        _writers[0] += 1
    try:
        yield
    finally:
        with _lock:
            _writers[0] -= 1
            if not _writers[0]:
                spark.conf.set(_CLEANUP, _before[0])


def materialize(df: DataFrame, name: str, options: dict[str, str] | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder, with such options, and read it back with the same schema.

    The table takes the place of the shuffle files of its query, which Spark removes.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with _cleaned(spark):
        df.write.options(compression="zstd", **(options or {})).parquet(path)
    if (owner := _owner.get()) is not None:
        owner.paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


def roots(df: DataFrame) -> set[str]:
    """Names of the folders and files that a DataFrame reads, however it was made from them."""
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    found: set[str] = set()
    for i in range(leaves.length()):
        leaf = leaves.apply(i)
        if leaf.getClass().getSimpleName() == "LogicalRelation" and leaf.relation().getClass().getSimpleName() == "HadoopFsRelation":
            paths = leaf.relation().location().rootPaths()
            found |= {paths.apply(j).getName() for j in range(paths.length())}
    return found
