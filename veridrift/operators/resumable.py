"""Resumable runs over files: a ledger of what is finished, committed atomically.

A run applies a transformation to every file below a folder, a wave of files at a time.  Each wave is
one Spark job that reads only its own files; when its output is written, one ledger file that names
its units is renamed into place, and from then on the units are finished.  A run that is stopped
anywhere leaves at most one wave of output that no ledger file names, which nobody reads.  The next
run looks at the ledger and takes up what is left.

A unit is finished for a digest of its input and for the parameters of the run.  A file that has
changed has another digest, and other parameters another key, so both are done anew, and what is
there from before is passed over, not deleted.  Digests come from names, lengths and times, which
cost a listing; with ``content`` they are SHA-256 of the bytes, for stores whose times can't be trusted.

The transformation gets the rows of a wave with the column ``unit`` and must keep it; each unit has
to be the same whatever others are beside it (nothing may be grouped across units).  Two runs beside
each other may do a unit twice; the result takes it once, from the wave with the smaller name.

What the driver holds is the list of files, as Spark's own planning does.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridrift.sources.tables import file_system, remove

ENTRY = "unit string, digest string, parameters string, wave string, label string"
#: Bytes of input of a wave.
WAVE_BYTES = 1 << 38


def file_units(spark: SparkSession, source: str, content: bool = False) -> DataFrame:
    """(unit, file, length, digest) of every file below ``source``; the unit is the path below it.

    Hidden files and those of committers (names with a leading dot or underscore) are none.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(source)
    system, where = file_system(spark, source)
    base = system.makeQualified(where).toUri().getPath().rstrip("/") + "/"
    path = F.regexp_replace("path", "^[a-zA-Z][a-zA-Z0-9+.-]*:(//[^/]*)?", "")
    unit = F.substring(path, len(base) + 1, 1 << 30)
    mark = F.sha2("content", 256) if content else F.sha2(F.concat_ws("|", unit, F.col("length").cast("string"), F.unix_micros("modificationTime").cast("string")), 256)
    named = files.select(unit.alias("unit"), F.col("path").alias("file"), "length", mark.alias("digest"))
    return named.where(~F.col("unit").rlike("(^|/)[._]"))


@dataclass
class Run:
    """A run of ``transform`` with ``parameters`` over the files below ``source``, kept below ``root``."""

    spark: SparkSession
    source: str
    root: str
    transform: Callable[[DataFrame], DataFrame]
    parameters: dict
    content: bool = False
    wave_bytes: int = WAVE_BYTES
    wave_units: int = 1 << 20
    #: What the last call of ``resume`` has read: a list of units for each wave.
    read: list[list[str]] = field(default_factory=list)

    @property
    def key(self) -> str:
        return hashlib.sha256(json.dumps(self.parameters, sort_keys=True, default=str).encode()).hexdigest()

    def units(self) -> DataFrame:
        return file_units(self.spark, self.source, self.content)

    def ledger(self) -> DataFrame:
        """(unit, digest, wave, label): what is finished with these parameters, once for each digest."""
        system, where = file_system(self.spark, f"{self.root}/ledger")
        if not system.exists(where):
            return self.spark.createDataFrame([], ENTRY).drop("parameters")
        entries = self.spark.read.schema(ENTRY).json(f"{self.root}/ledger").where(F.col("parameters") == self.key)
        return entries.groupBy("unit", "digest").agg(F.min(F.struct("wave", "label")).alias("first")).select("unit", "digest", "first.*")

    def left(self) -> DataFrame:
        """The units that aren't finished as they are now."""
        return self.units().join(self.ledger(), ["unit", "digest"], "left_anti")

    def resume(self, waves: int | None = None, label: str = "") -> bool:
        """Do what is left, or so many waves of it; whether all is finished then."""
        todo = sorted(self.left().collect(), key=lambda r: r["unit"])
        self.read = []
        while todo and (waves is None or len(self.read) < waves):
            wave, size = [], 0
            while todo and len(wave) < self.wave_units and (not wave or size + todo[0]["length"] <= self.wave_bytes):
                size += todo[0]["length"]
                wave.append(todo.pop(0))
            self._do(wave, label)
        return not todo

    def _do(self, wave: list, label: str) -> None:
        name = uuid.uuid4().hex
        files = [r["file"] for r in wave]
        path = F.regexp_replace(F.url_decode(F.regexp_replace(F.col("_metadata.file_path"), r"\+", "%2B")), "^[a-zA-Z][a-zA-Z0-9+.-]*:(//[^/]*)?", "")
        rows = self.spark.read.parquet(*files)
        base = len(wave[0]["file"]) - len(wave[0]["unit"])
        plain = F.length(F.regexp_replace(F.lit(wave[0]["file"][:base]), "^[a-zA-Z][a-zA-Z0-9+.-]*:(//[^/]*)?", ""))
        out = self.transform(rows.withColumn("unit", F.substr(path, plain + 1)))
        self.read.append([r["unit"] for r in wave])
        out.write.option("compression", "zstd").parquet(f"{self.root}/data/wave={name}")
        entries = [{"unit": r["unit"], "digest": r["digest"], "parameters": self.key, "wave": name, "label": label} for r in wave]
        self._commit(name, "".join(json.dumps(e) + "\n" for e in entries))

    def _commit(self, name: str, text: str) -> None:
        """A ledger file appears whole or not at all."""
        final, hidden = f"{self.root}/ledger/{name}.json", f"{self.root}/ledger/_{name}"
        system, where = file_system(self.spark, hidden)
        stream = system.create(where, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        if not system.rename(where, file_system(self.spark, final)[1]):
            raise OSError(f"the ledger of wave {name} could not be committed")

    def finished(self) -> DataFrame:
        """(unit, digest, wave, label) of the units that are finished as they are now."""
        return self.ledger().join(self.units().select("unit", "digest"), ["unit", "digest"], "left_semi")

    def result(self) -> DataFrame:
        """The output rows of finished units, with ``unit`` and the ``label`` of the call that made them."""
        valid = self.finished().select("wave", "unit", "label")
        waves = sorted(r["wave"] for r in valid.select("wave").distinct().collect())
        if not waves:
            raise ValueError("nothing is finished")
        # only waves that hold something valid are read; what they hold of other units is passed over
        data = self.spark.read.option("basePath", f"{self.root}/data").parquet(*[f"{self.root}/data/wave={w}" for w in waves])
        return data.join(valid, ["wave", "unit"]).drop("wave")

    def vacuum(self) -> int:
        """Remove the waves that no finished unit needs; how many.  Not beside a run."""
        needed = {r["wave"] for r in self.finished().select("wave").distinct().collect()}
        system, where = file_system(self.spark, f"{self.root}/data")
        found = [s.getPath().getName().removeprefix("wave=") for s in system.listStatus(where)] if system.exists(where) else []
        gone = [w for w in found if w not in needed]
        for w in gone:
            remove(self.spark, f"{self.root}/data/wave={w}")
        return len(gone)
