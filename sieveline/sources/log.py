"""A keyed table that only grows: batches of rows, and numbered versions that name the batches in force.

A version is one small file, moved to its number in one rename after all its data is there. A write that is lost before
that leaves the last version as it was, and one that comes second to a number fails instead of hiding the first. Of
several rows of a key the last one counts. Compaction writes the state as one batch; batches that no kept version
names are deleted by ``vacuum`` alone.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Digits of a version's name, so that names have their numbers' order.
DIGITS = 12


class LostRace(RuntimeError):
    """Another writer has published this version."""


class Log:
    """``schema``: the columns, of which ``key`` are those that name a row."""

    def __init__(self, spark: SparkSession, folder: str, schema: str, *key: str) -> None:
        self.spark, self.folder, self.schema, self.key = spark, folder.rstrip("/"), schema, key
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._system = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    # ---- versions

    def _versions(self) -> list[int]:
        place = self._path(f"{self.folder}/versions")
        if not self._system.exists(place):
            return []
        return sorted(int(s.getPath().getName()) for s in self._system.listStatus(place) if s.getPath().getName().isdigit())

    def version(self) -> int:
        """The number of the last version, 0 before the first."""
        return max(self._versions(), default=0)

    def batches(self, version: int | None = None) -> list[str]:
        """Names of a version's batches, oldest first."""
        number = self.version() if version is None else version
        return self._named(f"{self.folder}/versions/{number:0{DIGITS}}") if number else []

    def _named(self, path: str) -> list[str]:
        stream = self._system.open(self._path(path))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _publish(self, number: int, batches: list[str]) -> None:
        draft, place = self._path(f"{self.folder}/drafts/{uuid.uuid4().hex}"), self._path(f"{self.folder}/versions/{number:0{DIGITS}}")
        out = self._system.create(draft, False)
        out.write(bytearray(json.dumps(batches).encode()))
        out.close()
        self._system.mkdirs(place.getParent())
        if self._system.exists(place) or not self._system.rename(draft, place):
            raise LostRace(f"version {number} of {self.folder} is there already")

    # ---- rows

    def _read(self, batches: list[str]) -> DataFrame:
        columns = f"{self.schema}, _version long, _row long"
        if not batches:
            return self.spark.createDataFrame([], columns)
        return self.spark.read.schema(columns).parquet(*[f"{self.folder}/data/{b}" for b in batches])

    def state(self, version: int | None = None) -> DataFrame:
        """The last row of each key, as of a version or now."""
        return self.last(self._read(self.batches(version)))

    def last(self, rows: DataFrame) -> DataFrame:
        """The last of the given rows of this log by key."""
        own = [c for c in rows.columns if c[0] != "_" and c not in self.key]
        last = rows.groupBy(*self.key).agg(F.max_by(F.struct(*own), F.struct("_version", "_row")).alias("last"))
        return last.select(*self.key, "last.*").select(*[c for c in rows.columns if c[0] != "_"])

    def state_of(self, keys: DataFrame) -> DataFrame:
        """The state of the rows that ``keys``, some of the key's columns, name."""
        rows = self.state()
        return rows.join(keys.distinct(), keys.columns, "left_semi")

    def added(self, since: int) -> DataFrame:
        """Rows of the batches that versions after ``since`` added, as they were written, with _version and _row, which order them."""
        before = set(self.batches(since)) if since else set()
        return self._read([b for b in self.batches() if b not in before])

    def _written(self, rows: DataFrame, number: int) -> str:
        batch = f"{number:0{DIGITS}}-{uuid.uuid4().hex}"
        wanted = [c for c in self._read([]).columns if c[0] != "_"]
        shaped = rows.select(*wanted, F.lit(number).cast("long").alias("_version"), F.monotonically_increasing_id().alias("_row"))
        shaped.write.parquet(f"{self.folder}/data/{batch}")
        return batch

    def append(self, rows: DataFrame) -> int:
        """Rows that replace those of their keys; the new version's number. What ``rows`` reads may be this log's state."""
        now = self.version()
        self._publish(now + 1, [*self.batches(now), self._written(rows, now + 1)])
        return now + 1

    def compact(self) -> int:
        """The state as one batch of a new version."""
        now = self.version()
        self._publish(now + 1, [self._written(self.state(now), now + 1)])
        return now + 1

    def vacuum(self, keep: int = 2) -> None:
        """Delete versions but the last ``keep``, and what none of those names: for times when nothing writes."""
        versions = self._versions()
        for number in versions[:-keep]:
            self._system.delete(self._path(f"{self.folder}/versions/{number:0{DIGITS}}"), False)
        held = {b for number in versions[-keep:] for b in self.batches(number)}
        data = self._path(f"{self.folder}/data")
        for status in self._system.listStatus(data) if self._system.exists(data) else []:
            if status.getPath().getName() not in held:
                self._system.delete(status.getPath(), True)
        self._system.delete(self._path(f"{self.folder}/drafts"), True)
