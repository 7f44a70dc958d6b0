"""Substring search by an index of trigrams, built once for a table and read for each term."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a part of the table at most: what a candidate makes a search read.
PART_ROWS = 1 << 12
SIZE = 3


#: A match at each place that has three letters behind it, so that one scan of a text gives all runs.
RUNS = rf"(?s)(?=(.{{{SIZE}}}))"


def trigrams(text: Column | str) -> Column:
    """The distinct runs of three letters in lower case; none for shorter texts."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(RUNS), 1))


class TextIndex:
    """A table's rows in parts, and which rows have which trigram in any of their texts.

    Postings are sorted by trigram over range partitions, so a trigram of a third of the rows is spread over several
    files and a search reads only the blocks of its trigrams. A row is a candidate if it has all of the term's; only the
    parts with candidates are read, and the term is looked for in those. Terms of fewer than three letters read all.
    """

    def __init__(self, spark: SparkSession, folder: str, texts: Callable[[], list[Column]]) -> None:
        self.spark, self.folder, self.texts = spark, folder, texts

    @staticmethod
    def build(rows: DataFrame, texts: Callable[[], list[Column]], folder: str) -> TextIndex:
        """``texts`` are the columns that are searched, made anew for each use; ``folder`` has to be one that all machines see."""
        index = TextIndex(rows.sparkSession, f"{folder.rstrip('/')}/{uuid.uuid4().hex}", texts)
        local = rows.withColumn("_row", F.monotonically_increasing_id())
        part = F.shiftright("_row", PART_ROWS.bit_length() - 1)
        local.withColumn("_part", part).write.partitionBy("_part").parquet(f"{index.folder}/rows")
        all_texts = F.array_distinct(F.flatten(F.array(*[trigrams(t) for t in texts()])))
        postings = index.rows().select("_part", "_row", F.explode(all_texts).alias("gram"))
        ordered = postings.repartitionByRange("gram", "_row").sortWithinPartitions("gram", "_row")
        ordered.write.parquet(f"{index.folder}/postings")
        return index

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/rows").withColumn("_part", F.col("_part").cast("long"))

    def candidates(self, term: str) -> DataFrame | None:
        """_part and _row of the rows that have all of a term's trigrams; None for a term that has none."""
        low = term.lower()
        grams = {low[i : i + SIZE] for i in range(len(low) - SIZE + 1)}
        if not grams:
            return None
        found = self.spark.read.parquet(f"{self.folder}/postings").where(F.col("gram").isin(*grams))
        return found.groupBy("_part", "_row").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(grams)).select("_part", "_row")

    def read(self, term: str) -> DataFrame:
        """The rows that are looked at: the candidates, out of the parts that have any."""
        found = self.candidates(term)
        if found is None:
            return self.rows()
        parts = [r["_part"] for r in found.select("_part").distinct().collect()]  # a number a part
        return self.rows().where(F.col("_part").isin(*parts)).join(found, ["_part", "_row"], "left_semi")

    def search(self, term: str) -> DataFrame:
        """The rows with the term in any of their texts, whatever the case; all rows for an empty term."""
        hit = F.lit(not term)
        for text in self.texts():
            hit = hit | F.contains(F.lower(F.coalesce(text, F.lit(""))), F.lit(term.lower()))
        return self.read(term).where(hit).drop("_part", "_row")
