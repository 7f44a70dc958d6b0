"""Registry, verdict and manifest tables from CSV and JSON, and writers for what the stages make."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normal_doi, strip
from ..operators import article, records
from ..tables import stored
from .files import folder_contents
from .sinks import numbered, write_files, write_ordered_csv

ID_COLUMN, DOI_COLUMN, TITLE_COLUMN = "Reference ID", "DOI", "Title"
FLAT = "paper_id string, modality string, row_index int, row_label string, figure_ref string, source_quote string, fields_json string, summary_paragraph string"
VERDICTS = "paper_id string, modality string, field_name string, verdict string, confidence string, explanation string, evidence_quote string"
MANIFEST = "file string, paper_id string, match_method string, confidence double, status string"


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def is_folder(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory()


CSV = {"header": True, "multiLine": True, "quote": '"', "escape": '"', "inferSchema": False, "encoding": "UTF-8"}


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text, quotes doubled inside quotes, line ends allowed in fields; nothing is null."""
    return spark.read.csv(path, **CSV).na.fill("")


def as_registry(wide: DataFrame, ord: str | None = None) -> DataFrame:
    """ord, paper_id, doi and title in front of the table's own columns; rows without an ID go.

    ord is the column that holds the registry's order, left out of its own columns; without one, rows have rising
    numbers as they come, which is the order of a registry of one file.
    """
    own = [c for c in wide.columns if c not in ("ord", "paper_id", ord)]
    text = lambda name: F.col(f"`{name}`") if name in wide.columns else F.lit("")
    keyed = wide.withColumn("ord", F.col(f"`{ord}`") if ord else F.monotonically_increasing_id())
    named = keyed.withColumns(
        {"paper_id": strip(text(ID_COLUMN)), "doi_key": normal_doi(text(DOI_COLUMN)), "title_key": strip(text(TITLE_COLUMN))}
    ).where("paper_id <> ''")
    return named.select("ord", "paper_id", "doi_key", "title_key", *[F.col(f"`{c}`") for c in own])


def for_matching(registry: DataFrame) -> DataFrame:
    """ord, paper_id, doi and title, as the matching operators take them."""
    return registry.select("ord", "paper_id", F.col("doi_key").alias("doi"), F.col("title_key").alias("title"))


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """A registry of one file or of several, which follow one another by name: ord counts all rows from 0."""
    return as_registry(read_ordered_csv(spark, path), "place")


def read_ordered_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV's rows as ``read_csv`` gives them, with ``place``, their number from 0: files by name, rows as they stand in them."""
    rows = spark.read.csv(path, **CSV)
    return numbered(rows.select(*[F.coalesce(f"`{c}`", F.lit("")).alias(c) for c in rows.columns], "_metadata"))


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV with a known schema, by column name; empty if the file is not there. Any column *_field is field_name."""
    want = spark.createDataFrame([], schema)
    if not exists(spark, path):
        return want
    got = read_csv(spark, path)
    for c in got.columns:
        if c.endswith("_field") and "field_name" not in got.columns:
            got = got.withColumnRenamed(c, "field_name")
    return got.select(*[(F.col(f.name) if f.name in got.columns else F.lit("")).try_cast(f.dataType).alias(f.name) for f in want.schema])


def read_flat(spark: SparkSession, path: str) -> DataFrame:
    """Flattened extractions, their fields as a map again."""
    rows = read_table(spark, path, FLAT)
    return rows.withColumn(
        "fields", F.coalesce(F.from_json("fields_json", "map<string,string>"), F.create_map().cast("map<string,string>"))
    ).drop("fields_json")


def read_json_by_key(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """key (the file's stem), json and value of a folder of JSON files; value is null where one is malformed or empty.

    The files are listed and read here, by tasks, into a stored table: the driver holds no names.
    """
    rows = folder_contents(spark, path).select(F.col("content").cast("string").alias("json"), F.element_at(F.split("path", "/"), -1).alias("name"))
    rows = stored(rows, "json-files")
    return rows.select(F.regexp_replace("name", r"\.json$", "").alias("key"), "json", F.from_json("json", schema).alias("value"))


def read_prompts(spark: SparkSession, path: str) -> DataFrame:
    """modality and prompt: a text file for each modality, without white space around."""
    rows = spark.read.text(path, wholetext=True).select(
        F.regexp_replace(F.col("_metadata.file_name"), r"\.txt$", "").alias("modality"), strip("value").alias("prompt")
    )
    return rows.where(F.col("modality").isin(*records.MODALITIES))


def write_flat(flat: DataFrame, path: str) -> None:
    """By paper, modality and row."""
    rows = flat.select(
        "paper_id",
        "modality",
        "row_index",
        "row_label",
        "figure_ref",
        "source_quote",
        F.to_json("fields").alias("fields_json"),
        "summary_paragraph"
    )
    write_ordered_csv(rows, path, "paper_id", "modality", "row_index")


def write_verdicts(verdicts: DataFrame, path: str) -> None:
    """Worst first, then by paper, modality and field; the explanation breaks ties."""
    columns = ["paper_id", "modality", "field_name", "verdict", "confidence", "explanation", "evidence_quote"]
    order = [records.severity("verdict"), "paper_id", "modality", "field_name", "explanation"]
    write_ordered_csv(verdicts.select(*columns), path, *order)


def write_fetch_manifest(cache: DataFrame, path: str) -> None:
    """How each paper's text was fetched: all but the text."""
    columns = ["paper_id", "doi", "pmid", "pmcid", "text_source", "status", "fetched_at", "error"]
    write_ordered_csv(cache.select(*columns), path, "paper_id")


def write_scrape_manifest(manifest: DataFrame, path: str) -> None:
    """Which file was matched to which paper, in the files' order."""
    write_ordered_csv(manifest.select("file", "paper_id", "match_method", "confidence", "status"), path, F.split("file", "/"))


def write_side_by_side(rows: DataFrame, path: str) -> None:
    """Recorded beside found values, in the registry's order."""
    order = ["ord", "mod_ord", "field_ord", "kind", "row_index"]
    shown = rows.select(
        "paper_id",
        "title",
        "modality",
        "field_name",
        "row_label",
        "recorded_value",
        F.col("found_value").alias("reextracted_value"),
        "source_quote",
        "figure_ref",
        F.struct(*order).alias("_order")
    )
    # sorted before the order's columns go
    shown = shown.repartitionByRange("_order").sortWithinPartitions("_order").drop("_order")
    write_ordered_csv(shown, path)


def write_summary(articles: DataFrame, path: str) -> None:
    """The seven columns of the summary, by source file."""
    write_ordered_csv(article.summary_rows(articles), path, "source_file")


def indented_json(*columns: Column | str) -> Column:
    """A row's columns as one indented JSON object; other letters than ASCII's stay as they are."""
    return F.to_json(F.struct(*columns), {"pretty": "true", "ignoreNullFields": "false"})


def write_json_by_key(df: DataFrame, folder: str, key: str) -> None:
    """An indented JSON file for each row, named by its key; ``read_json_by_key`` reads them."""
    write_files(df.select(F.concat(key, F.lit(".json")).alias("name"), indented_json("*").alias("body")), folder, "name", "body")


def write_articles(articles: DataFrame, folder: str) -> None:
    """An indented JSON file for each article, named by its file's stem; of two with one stem the later path wins."""
    stem = F.regexp_replace(F.element_at(F.split("source_file", "/"), -1), r"(?<=.)\.[^.]+$", "")
    shaped = articles.withColumn("sections", F.map_from_entries("sections"))
    rows = shaped.select(F.concat(stem, F.lit(".json")).alias("name"), indented_json("*").alias("body"), F.split("source_file", "/").alias("path"))
    write_files(rows, folder, "name", "body", "path")
