"""Tables in a global order without one task for it, and files that executors write."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from ..tables import stored

# ---- order ----------------------------------------------------------------------------------------------------------

#: monotonically_increasing_id has the partition above these bits, the row in it below.
LOCAL_BITS = 33


def offsets(counts: list[tuple]) -> dict:
    """Rows before each key, from (key, rows) in order."""
    out, total = {}, 0
    for key, n in counts:
        out[key] = total
        total += n
    return out


def _after(table: DataFrame, key: str, starts: dict, local: Column) -> DataFrame:
    """``place``: the key's offset and the local number. One number a partition or file goes round, as zipWithIndex sends it."""
    if not starts:
        return table.withColumn("place", F.lit(0).cast("long"))
    kind = table.schema[key].dataType.simpleString()
    known = table.sparkSession.createDataFrame(list(starts.items()), f"{key} {kind}, ahead long")
    return table.join(F.broadcast(known), key).withColumn("place", F.col("ahead") + local).drop("ahead")


def ranked(rows: DataFrame, *order: Column | str) -> DataFrame:
    """The rows with ``place``, their rank from 0 in a total order, stored in that order.

    Ranges of the order are sorted apart; a row's place is its number in its range behind the rows of earlier ranges.
    What is equal in ``order`` stands together in one range, so ties of many rows should be broken by further columns.
    """
    local = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    table = stored(local.withColumn("_part", F.shiftright("_at", LOCAL_BITS)), "ranked")
    counts = table.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()  # a number a range
    starts = offsets(sorted((r["_part"], r["n"]) for r in counts))
    return _after(table, "_part", starts, F.col("_at").bitwiseAND(F.lit((1 << LOCAL_BITS) - 1))).drop("_part", "_at")


def places(rows: DataFrame, by: str, *order: Column | str) -> DataFrame:
    """The rows with ``place``, their number from 1 among the rows of equal ``by`` (null is a value), in a total order.

    As a row number over a window, but no task holds all rows of one value: ranks of all, less the value's first rank.
    """
    table = ranked(rows, by, *order)
    firsts = table.groupBy(F.col(by).alias("_by")).agg((F.min("place") - 1).alias("_ahead"))
    both = table.join(firsts, F.col(by).eqNullSafe(F.col("_by")))
    return both.withColumn("place", F.col("place") - F.col("_ahead")).drop("_by", "_ahead")


def numbered(table: DataFrame) -> DataFrame:
    """A file table's rows with ``place``: their number from 0, files by name, rows as they stand in them.

    For readers that take each file whole (as CSV with line ends in its fields), where a file's rows have rising numbers.
    """
    named = table.withColumns({"_file": F.col("_metadata.file_path"), "_at": F.monotonically_increasing_id()})
    local = stored(named.drop("_metadata"), "numbered")
    counts = local.groupBy("_file").agg(F.min("_at").alias("first"), F.count(F.lit(1)).alias("n")).collect()  # a row a file
    starts, firsts = offsets(sorted((r["_file"], r["n"]) for r in counts)), {r["_file"]: r["first"] for r in counts}
    return _after(local, "_file", {k: v - firsts[k] for k, v in starts.items()}, F.col("_at")).drop("_file", "_at")


# ---- files ----------------------------------------------------------------------------------------------------------

#: Spark's names of stores that Arrow knows by another one.
SCHEMES = {"s3a": "s3", "s3n": "s3", "abfss": "abfs"}
STAGING = "_staging-"
#: Settings of Spark's object store that Arrow's needs too, by Arrow's names.
S3_SETTINGS = {"access_key": "fs.s3a.access.key", "secret_key": "fs.s3a.secret.key", "session_token": "fs.s3a.session.token", "endpoint_override": "fs.s3a.endpoint", "region": "fs.s3a.endpoint.region"}


@dataclass(frozen=True)
class Store:
    """A folder that tasks can write to, with what Spark's settings say of it."""

    folder: str
    settings: tuple[tuple[str, str], ...] = ()

    @staticmethod
    def at(spark: SparkSession, folder: str) -> Store:
        place = spark._jvm.org.apache.hadoop.fs.Path(folder)
        conf = spark._jsc.hadoopConfiguration()
        whole = place.getFileSystem(conf).makeQualified(place).toString()
        known = {k: conf.get(v) for k, v in S3_SETTINGS.items() if conf.get(v)} if whole.startswith("s3") else {}
        return Store(whole.rstrip("/"), tuple(known.items()))

    def opened(self) -> tuple[fs.FileSystem, str]:
        scheme, _, rest = self.folder.partition(":")
        name = SCHEMES.get(scheme, scheme)
        if name == "s3":
            return fs.S3FileSystem(**dict(self.settings)), rest.lstrip("/")
        if name == "file":
            return fs.LocalFileSystem(), "/" + rest.lstrip("/")
        return fs.FileSystem.from_uri(quote(f"{name}:{rest}", safe=":/@"))


class FilesSource(DataSource):
    """Rows of (name, body) as files of these names in a folder: ``df.write.format("named_files").option("path", folder)``."""

    @classmethod
    def name(cls) -> str:
        return "named_files"

    def schema(self) -> str:
        return "name string, body string"

    def writer(self, schema: StructType, overwrite: bool) -> FilesWriter:
        known = {k[len("store.") :]: v for k, v in self.options.items() if k.startswith("store.")}
        return FilesWriter(Store(self.options["path"], tuple(known.items())), self.options["run"])


class FilesWriter(DataSourceArrowWriter):
    """Each task writes into a staging folder of its own and moves its files to their places at its end.

    So a task that is lost or tried twice leaves no half file, no names come to the driver, and what remains to be
    done there is to delete the staging folder, with what failed tasks left in it. If the job fails, whole files of
    tasks that had ended stay, and a later run writes them again.
    """

    def __init__(self, store: Store, run: str) -> None:
        self.store, self.run = store, run

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        system, root = self.store.opened()
        stage = f"{root}/{STAGING}{self.run}/{uuid.uuid4().hex}"
        names: list[str] = []
        for batch in iterator:
            for name, body in zip(batch.column("name").to_pylist(), batch.column("body").to_pylist(), strict=True):
                if not names:
                    system.create_dir(stage)
                with system.open_output_stream(f"{stage}/{len(names)}") as out:
                    out.write((body or "").encode())
                names.append(name)
        for folder in {os.path.dirname(n) for n in names}:
            system.create_dir(f"{root}/{folder}".rstrip("/"))
        for at, name in enumerate(names):
            system.move(f"{stage}/{at}", f"{root}/{name}")
        return WriterCommitMessage()

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        self._cleared()

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._cleared()

    def _cleared(self) -> None:
        system, root = self.store.opened()
        stage = f"{root}/{STAGING}{self.run}"
        if system.get_file_info(stage).type == fs.FileType.Directory:
            system.delete_dir(stage)


def write_files(rows: DataFrame, folder: str, name: str, body: str, *order: Column | str) -> None:
    """A file for each different name, written by the tasks that hold its rows; of several rows of one name the last in ``order`` wins.

    A null name is left out, a null body is an empty file. Names can have folders in them. Without an order the
    greatest body wins.
    """
    spark = rows.sparkSession
    spark.dataSource.register(FilesSource)
    last = Window.partitionBy("name").orderBy(F.desc("last"))
    named = rows.select(F.col(name).alias("name"), F.col(body).alias("body"), F.struct(*(order or (body,))).alias("last"))
    one = named.where("name IS NOT NULL").withColumn("n", F.row_number().over(last)).where("n = 1").select("name", "body")
    store = Store.at(spark, folder)
    place = spark._jvm.org.apache.hadoop.fs.Path(store.folder)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(place)  # there even if no row is
    options = {"path": store.folder, "run": uuid.uuid4().hex} | {f"store.{k}": v for k, v in store.settings}
    one.write.format("named_files").options(**options).mode("append").save()


def write_ordered_csv(df: DataFrame, path: str, *order: Column | str) -> None:
    """CSV files in order: part by part in the order of their names, each part sorted. ``numbered`` gives the order when they are read."""
    keep = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}  # the writer would strip fields else
    rows = df.orderBy(*order) if order else df
    rows.write.mode("overwrite").csv(path, header=True, quote='"', escape='"', emptyValue="", **keep)
