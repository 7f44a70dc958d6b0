"""Intermediate tables in a folder that all machines share: what is used twice is made once, and lost executors cost little."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextvars import ContextVar
from weakref import WeakKeyDictionary

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

_own_folder: list[str] = []
_places: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
#: Open scopes of this thread, the innermost last: a stage and a page that run at once have their own.
_scopes: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())
#: Tables that are there still; what no scope has deleted goes when the driver's process ends.
_left: dict[str, SparkSession] = {}

#: While a table is written: its shuffle files go as soon as it is there, Arrow batches stay small, small tables are
#: written in few files, and a small file counts as 64 KB, not 4 MB, so that a task reads some thousand of them and not 32.
WRITING = {
    "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
    "spark.sql.files.openCostInBytes": str(64 << 10),
}
#: Stored tables are read in a partition for each so many bytes, by ``settled``.
PART_BYTES = 8 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir.

    Where that is unset: a folder in the warehouse, or with a local master, where there is one machine, a temporary
    one. A warehouse in the machines' own file systems is refused, as each machine would see another one.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
        if _at(spark, warehouse)[1].getScheme() == "file":
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share: the warehouse is a local folder of each")
        return f"{warehouse}/sieveline-tables"
    if not _own_folder:
        _own_folder.append("file://" + tempfile.mkdtemp(prefix="sieveline-"))
    return _own_folder[0]


class _Settings:
    """Settings that hold while any table is written: set by the first writer of a session, put back by the last."""

    def __init__(self) -> None:
        self.lock, self.writers, self.before = threading.Lock(), 0, {}

    def __call__(self, spark: SparkSession) -> contextlib.AbstractContextManager:
        return self._held(spark)

    @contextlib.contextmanager
    def _held(self, spark: SparkSession) -> Iterator[None]:
        with self.lock:
            if not self.writers:
                self.before = {k: spark.conf.get(k, None) for k in WRITING}
                for k, v in WRITING.items():
                    spark.conf.set(k, v)
            self.writers += 1
        try:
            yield
        finally:
            with self.lock:
                self.writers -= 1
                for k, v in self.before.items() if not self.writers else ():
                    spark.conf.unset(k) if v is None else spark.conf.set(k, v)


_writing: WeakKeyDictionary[SparkSession, _Settings] = WeakKeyDictionary()


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    with _writing.setdefault(spark, _Settings())(spark):
        df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    _places[table] = path
    _left[path] = spark
    if _scopes.get():
        _scopes.get()[-1].append(path)
    return table


def _at(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def removed(spark: SparkSession, path: str) -> None:
    place, system = _at(spark, path)
    system.delete(place, True)
    _left.pop(path, None)


@atexit.register
def _swept() -> None:
    """Deletes what is left when the process ends; a driver that is killed leaves it to the shared folder's own rules."""
    for path, spark in list(_left.items()):
        if SparkContext._active_spark_context is spark.sparkContext:
            with contextlib.suppress(Exception):  # the session may be ending as well
                removed(spark, path)


def dropped(*tables: DataFrame) -> None:
    """Delete the files behind tables made by ``stored`` that nothing reads any more."""
    for table in tables:
        removed(table.sparkSession, _places[table])


def settled(table: DataFrame) -> DataFrame:
    """A stored table in as many partitions as its bytes ask for; a table of one partition needs no exchange at all."""
    place, system = _at(table.sparkSession, _places[table])
    return table.coalesce(1 + int(system.getContentSummary(place).getLength()) // PART_BYTES)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end the tables that were stored inside it; results have to be written before that."""
    own: list[str] = []
    outer = _scopes.set((*_scopes.get(), own))
    try:
        yield
    finally:
        _scopes.reset(outer)
        for path in own:
            removed(spark, path)
