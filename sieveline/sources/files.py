"""Articles from files: Spark lists and reads them; Python is met only for PDF and XML bodies."""

from __future__ import annotations

import io
import os
from collections.abc import Iterator
from dataclasses import replace
from itertools import islice
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..tables import stored
from .sinks import Store

SUFFIXES = ("pdf", "txt", "md")


class UnsupportedFileType(ValueError):
    """A path whose suffix has no reader."""


def _name(path: str = "path"):
    return F.element_at(F.split(path, "/"), -1)


#: The suffixes as a glob that holds whatever their case.
GLOB = "*.{" + ",".join("".join(f"[{c}{c.upper()}]" for c in suffix) for suffix in SUFFIXES) + "}"


def _contents(spark: SparkSession, path: str) -> DataFrame:
    """Spark's reader of whole files, held to the suffixes; it leaves out files of no length."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", GLOB).load(path)


def _described(paths: DataFrame, skip_readme: bool) -> DataFrame:
    named = paths.withColumns(
        {"suffix": F.lower(F.regexp_extract(_name(), r"\.([^.]+)$", 1)), "stem": F.regexp_replace(_name(), r"(?<=.)\.[^.]+$", "")}
    )
    return named.where(F.lower("stem") != "readme") if skip_readme else named


def _checked(spark: SparkSession, path: str) -> None:
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(root):
        raise FileNotFoundError(path)
    if not system.getFileStatus(root).isDirectory() and path.rsplit(".", 1)[-1].lower() not in SUFFIXES:
        raise UnsupportedFileType(path)


LISTED = "path string, folder boolean, length long"
#: Folders that a task lists at most before it hands their names on.
FOLDERS_A_TASK = 64


#: Entries of a folder that go on in one batch.
ENTRIES_A_BATCH = 16_384


def _entries(system: fs.FileSystem, place: str) -> Iterator[tuple[str, bool, int]]:
    """Name, whether it is a folder, and length. A local folder comes entry by entry; other stores' listings are held whole in the task."""
    if not isinstance(system, fs.LocalFileSystem):
        for i in system.get_file_info(fs.FileSelector(place)):
            yield i.base_name, i.type == fs.FileType.Directory, i.size or 0
        return
    with os.scandir(place) as found:
        for i in found:
            try:
                yield i.name, i.is_dir(), 0 if i.is_dir() else i.stat().st_size
            except FileNotFoundError:  # a link to nothing
                yield i.name, False, 0


def _children(store: Store):
    """What stands in each folder of a batch. Names that Spark's readers leave out, with . or _ in front, are left out."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder in batch.column("path").to_pylist():
                seen = (e for e in _entries(*replace(store, folder=folder).opened()) if e[0][0] not in "._")
                while some := list(islice(seen, ENTRIES_A_BATCH)):
                    names, folders, lengths = zip(*some, strict=True)
                    arrays = [
                        pa.array([f"{folder}/{n}" for n in names], pa.string()), pa.array(folders, pa.bool_()), pa.array(lengths, pa.int64())
                    ]
                    yield pa.RecordBatch.from_arrays(arrays, ["path", "folder", "length"])

    return rows


def _below(folders: DataFrame, n: int, store: Store) -> DataFrame:
    """What stands in n folders, as a table that tasks write."""
    dealt = folders.select("path").repartition(-(-n // FOLDERS_A_TASK), "path")
    return stored(dealt.mapInArrow(_children(store), LISTED), "folders")


def tree(spark: SparkSession, path: str) -> DataFrame:
    """path and length of every file under a folder: tasks list the folders of one depth, a table of them is the next one's.

    No name comes to the driver, however many there are. Stores are those of ``sinks.Store``.
    """
    store = Store.at(spark, path)
    level, files = spark.createDataFrame([(store.folder, True, 0)], LISTED), None
    while True:
        folders = level.where("folder")
        n = folders.count()
        if not n:
            return files if files is not None else level.select("path", "length").limit(0)
        level = _below(folders, n, store)
        own = level.where("NOT folder").select("path", "length")
        files = own if files is None else files.unionByName(own)


#: Files that a task reads at most, about, and bytes of them that go on in one batch.
FILES_A_TASK, BATCH_BYTES = 1024, 8 << 20


def _bytes_of(store: Store):
    """The content of each file of a batch, under the store's folder; compressed ones, by their suffix, are unpacked, as Spark does."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = store.opened()
        made = lambda: pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(bodies, pa.binary())], ["path", "content"])
        paths, bodies, size = [], [], 0
        for batch in batches:
            for path in batch.column("path").to_pylist():
                with system.open_input_stream(root + path[len(store.folder) :]) as file:
                    bodies.append(file.read())
                paths.append(path)
                size += len(bodies[-1])
                if size >= BATCH_BYTES:
                    yield made()
                    paths, bodies, size = [], [], 0
        yield made()

    return rows


def folder_contents(spark: SparkSession, path: str) -> DataFrame:
    """path and content of each file that stands in a folder itself, or of the one file: listed and read in tasks.

    No name comes to the driver, where Spark's own readers hold the names of all their files.
    """
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    status = root.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(root)
    one = spark.createDataFrame([(status.getPath().toString(),)], "path string")
    if status.isDirectory():
        store = Store.at(spark, path)
        own = _below(one, 1, store).where("NOT folder").select("path")
    else:
        store, own = Store.at(spark, status.getPath().getParent().toString()), one
    dealt = own.repartition(max(1, -(-own.count() // FILES_A_TASK)), "path")
    return dealt.mapInArrow(_bytes_of(store), "path string, content binary")


def _listed(spark: SparkSession, path: str) -> DataFrame:
    """path and length of every file of the suffixes, those of no length too."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    status = root.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(root)
    if status.isDirectory():
        return tree(spark, path).where(F.lower("path").rlike(rf"\.({'|'.join(SUFFIXES)})$"))
    return spark.createDataFrame([(status.getPath().toString(), status.getLen())], "path string, length long")


def list_files(spark: SparkSession, path: str, skip_readme: bool = False) -> DataFrame:
    """path, length, suffix and stem of the articles under a folder, or of the one file; files of no length are listed too."""
    _checked(spark, path)
    return _described(_listed(spark, path), skip_readme)


@F.pandas_udf(T.StringType())
def pdf_text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Text of PDF bytes by pdfplumber, else pypdf; null where neither can read them."""
    for batch in batches:
        yield batch.map(_pdf_text)


def _pdf_text(raw: bytes | None) -> str | None:
    def by_plumber(raw: bytes) -> str:
        import pdfplumber

        with pdfplumber.open(io.BytesIO(raw)) as pdf:
            return "\n".join(page.extract_text() or "" for page in pdf.pages)

    def by_pypdf(raw: bytes) -> str:
        import pypdf

        return "\n".join(page.extract_text() or "" for page in pypdf.PdfReader(io.BytesIO(raw)).pages)

    for read in (by_plumber, by_pypdf) if raw else ():
        try:
            text = read(raw)
        except Exception:  # a broken file or a missing reader must not end the task
            continue
        if text.strip():
            return text
    return None


def load_texts(spark: SparkSession, path: str, skip_readme: bool = False) -> DataFrame:
    """file, stem, suffix and text of every article, in a null text if it can't be read.

    Plain text is UTF-8 with replacement characters; all line ends become \\n.
    """
    _checked(spark, path)
    content = _described(_contents(spark, path).select("path", "content"), skip_readme)
    plain = F.regexp_replace(F.make_valid_utf8(F.col("content").cast("string")), r"\r\n?", "\n")
    is_pdf = F.col("suffix") == "pdf"
    # one scan for all kinds; what is no PDF goes through Python as a null
    read = content.withColumn("from_pdf", pdf_text(F.when(is_pdf, F.col("content"))))
    read = read.select("path", "stem", "suffix", F.when(is_pdf, F.col("from_pdf")).otherwise(plain).alias("text"))
    blank = _described(_listed(spark, path).where("length = 0").select("path"), skip_readme)  # that reader leaves them out
    blank = blank.select("path", "stem", "suffix", F.when(~is_pdf, F.lit("")).alias("text"))
    return read.unionByName(blank).withColumnRenamed("path", "file")


#: Elements of a journal article's body that are kept, and what stands in front of their text.
MARKS = {"title": "\n## ", "p": ""}


def flat_xml_text(xml: str | None) -> str | None:
    """Headings and paragraphs of a journal article's body in document order; null without a body or if malformed.

    An element's text is that of everything inside it, with single spaces. Only the first body counts.
    """
    open_, out, depth = [], [], 0
    try:
        parser = ElementTree.XMLPullParser(("start", "end"))
        parser.feed(xml or "")
        parser.close()
        for event, node in parser.read_events():
            kind = node.tag.rpartition("}")[2]
            if event == "start":
                depth += bool(depth) or (node.tag == "body" and not out)
                if depth > 1 and kind in MARKS:
                    out.append("")  # its place is where it starts
                    open_.append(len(out) - 1)
                elif depth == 1:
                    out.append("")
            elif depth:
                if depth > 1 and kind in MARKS:
                    text = " ".join("".join(node.itertext()).split())
                    out[open_.pop()] = MARKS[kind] + text if text else ""
                depth -= 1
    except ElementTree.ParseError:
        return None
    return "\n".join(x for x in out if x).strip() or None


@F.pandas_udf(T.StringType())
def xml_text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in batches:
        yield batch.map(flat_xml_text)
