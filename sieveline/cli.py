"""Articles to structured records, and the stages of the audit.

``python -m sieveline.cli input [-o out] [--summary-csv folder]`` parses one article (JSON to a file or to the screen)
or a folder of them (a JSON file for each, named by its stem).
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators.article import parse_articles
from .sources import files, sinks, tables
from .tables import stored


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("input", help="an article or a folder of articles (PDF, TXT, MD)")
    parser.add_argument("-o", "--output", help="file for one article's JSON (printed without it), folder for those of a folder")
    parser.add_argument("--summary-csv", help="folder for the summary table of a folder's articles")
    given = parser.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    try:
        texts = files.load_texts(spark, given.input)
    except (FileNotFoundError, files.UnsupportedFileType) as error:
        print(f"error: {error}", file=sys.stderr)
        return 1
    readable = texts.where("text IS NOT NULL")
    articles = parse_articles(readable, source_file="file")
    if tables.is_folder(spark, given.input):
        articles = stored(articles, "articles")  # parsed once for both sinks
        tables.write_articles(articles, given.output or "extracted")
        print(f"{articles.count()} articles written to {given.output or 'extracted'}")
        if given.summary_csv:
            tables.write_summary(articles, given.summary_csv)
    else:
        shaped = articles.withColumn("sections", F.map_from_entries("sections")).select(tables.indented_json("*").alias("body"))
        if given.output:
            folder, _, name = given.output.rpartition("/")
            sinks.write_files(shaped.withColumn("name", F.lit(name)), folder or ".", "name", "body")
        else:
            for row in shaped.collect():  # one article
                print(row.body)
    failed = [r.file for r in texts.where("text IS NULL").select("file").toLocalIterator()]
    for file in failed:
        print(f"error: no text in {file}", file=sys.stderr)
    return int(bool(failed))


if __name__ == "__main__":
    raise SystemExit(main())
