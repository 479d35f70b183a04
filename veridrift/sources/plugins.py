"""Extension: what plugs into SQL by name: a data source of hash lists, and a function of a table.

``hash_list`` reads files of lines ``digest  path`` below a folder, a task for each file.  It gives
(list, line, path, sha256); malformed lines have nulls.  Comparisons of ``list`` decide which files are
opened at all, and a beginning or a value of ``path`` which lines leave the reader; what can't be pushed
down is left to Spark.  Files are read through Arrow's file systems, by the scheme of their path.

``last_seen(TABLE(...) PARTITION BY ... ORDER BY ...)`` holds each row's value against the one before in
its partition, as a sequential audit does, and gives (key, at, value, before) where they differ.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith
from pyspark.sql.functions import udtf
from pyspark.sql.types import Row, StructType

from veridrift.sources.records import HASH_LINE

#: Values further apart than this have drifted.
TOLERANCE = 1e-9


def _file_system(path: str):
    from pyarrow import fs

    if re.match(r"^[a-zA-Z][a-zA-Z0-9+.-]*:", path):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


class HashList(InputPartition):
    """A file of a hash list, and its name below the folder."""

    def __init__(self, path: str, name: str) -> None:
        super().__init__(path)
        self.path, self.name = path, name


class HashListReader(DataSourceReader):
    def __init__(self, folder: str) -> None:
        self.folder = folder
        self.lists: list[set[str]] = []
        self.paths: list[set[str]] = []
        self.beginnings: list[str] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if isinstance(f, EqualTo) and column in ("list", "path"):
                (self.lists if column == "list" else self.paths).append({f.value})
            elif isinstance(f, In) and column in ("list", "path"):
                (self.lists if column == "list" else self.paths).append(set(f.value))
            elif isinstance(f, StringStartsWith) and column == "path":
                self.beginnings.append(f.value)
            else:
                yield f

    def partitions(self) -> list[HashList]:
        from pyarrow import fs

        system, base = _file_system(self.folder)
        base = base.rstrip("/")
        found = system.get_file_info(fs.FileSelector(base, recursive=True))
        named = [HashList(f.path, f.path[len(base) + 1 :]) for f in found if f.is_file and not f.base_name.startswith((".", "_"))]
        return sorted((p for p in named if all(p.name in names for names in self.lists)), key=lambda p: p.name)

    def read(self, partition: HashList) -> Iterator[tuple]:
        system, _ = _file_system(self.folder)
        with system.open_input_stream(partition.path) as stream:
            left, n = b"", 0
            while block := stream.read(1 << 20):
                *lines, left = (left + block).split(b"\n")
                for line in lines:
                    n += 1
                    yield from self._row(partition.name, n, line)
            if left:
                yield from self._row(partition.name, n + 1, left)

    def _row(self, name: str, n: int, line: bytes) -> Iterator[tuple]:
        if not line:
            return
        m = re.match(HASH_LINE, line.decode())
        path, digest = (m[2], m[1].lower()) if m else (None, None)
        if all(path in p for p in self.paths) and all(path is not None and path.startswith(b) for b in self.beginnings):
            yield name, n, path, digest


class HashListSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "hash_list"

    def schema(self) -> str:
        return "list string, line long, path string, sha256 string"

    def reader(self, schema: StructType) -> HashListReader:
        return HashListReader(self.options["path"])


class LastSeen:
    """Values that differ from the one before of their partition, in the order that the call asks for."""

    def __init__(self) -> None:
        self.before: float | None = None

    def eval(self, row: Row):
        key, at, value = row[0], row[1], row[2]
        if value is None:
            return
        before, self.before = self.before, value
        if before is not None and not abs(value - before) <= max(TOLERANCE * max(abs(value), abs(before)), TOLERANCE):
            yield key, at, value, before


def register(spark: SparkSession) -> None:
    """Make ``hash_list`` and ``last_seen`` known to a session, and let filters reach data sources in Python."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(HashListSource)
    spark.udtf.register("last_seen", udtf(LastSeen, returnType="key long, at long, value double, before double"))
