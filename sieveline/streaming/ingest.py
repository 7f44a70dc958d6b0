"""New article files as a stream (an extension: batch ingest is ``sources.files``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.article import parse_articles

BINARY = "path string, modificationTime timestamp, length long, content binary"


def article_stream(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    """Fields of each text or Markdown article that appears under ``folder``, once each."""
    files = spark.readStream.format("binaryFile").schema(BINARY).option("pathGlobFilter", "*.{txt,md,TXT,MD}").option("recursiveFileLookup", "true").option(
        "maxFilesPerTrigger", files_per_trigger
    ).load(folder)
    text = F.regexp_replace(F.make_valid_utf8(F.coalesce("content", F.lit(b"")).cast("string")), r"\r\n?", "\n")
    return parse_articles(files.select(F.col("path").alias("source_file"), text.alias("text")))


def keep(articles: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Append to a Parquet table all that is there now, then stop; a rerun goes on where this one ended."""
    return articles.writeStream.format("parquet").option("path", table).option(
        "checkpointLocation", checkpoint
    ).trigger(availableNow=True).start()
