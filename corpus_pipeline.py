"""A corpus pipeline: five operators of the llm subpackage, one after another, each on all that the last one kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.llm import decontam, langid, mixing, sharding, simhash
from sieveline.llm.common import ID_KEYS, keyed, removed, scratch, shared_folder, stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SHARDS = 16


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a language (null, empty, no letter) go; lang holds what was predicted."""
    found = langid.identify_rows(docs.select(*COLUMNS), langid.learn(docs))
    return found.where(F.col("lang_pred") != langid.NO_LANGUAGE).withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies one row stays, that of smallest doc_id; rows without a doc_id stay only where no other is in the class."""
    return simhash.keep_one(docs.select(*COLUMNS))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that benchmark passages make up a twentieth of, or more, go. Null and empty texts stay, as does any row whose own text is clean."""
    found = decontam.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where("contaminated")
    bad = found.select(
        F.coalesce("doc_id", F.lit(0)).alias("key_id"), F.col("doc_id").isNull().alias("key_null"), F.col("text_hash").alias("key_text")
    ).distinct()
    return keyed(docs.select(*COLUMNS)).join(bad, ID_KEYS, "left_anti").select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each whole repetition, and one with the first words for a part; documents that the mix leaves out go, those without words too.

    Rows of one doc_id and text, of which near-dedup leaves none, are each taken as often as the one taken most.
    """
    taken = mixing.mix(docs).where("taken > 0").withColumns(
        {"key_id": F.coalesce("doc_id", F.lit(0)), "key_null": F.col("doc_id").isNull(), "key_text": F.col("text_hash")}
    )
    taken = stored(taken.groupBy(*ID_KEYS).agg(F.max("taken").alias("taken"), F.max("size").alias("size")), "mix")
    rows = keyed(docs.select(*COLUMNS)).join(taken, ID_KEYS)
    whole, part = F.floor(F.col("taken") / F.col("size")).cast("int"), (F.col("taken") % F.col("size")).cast("int")
    pieces = F.split("text", r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")  # each with the white space before its word
    cut = F.when(part > 0, F.array(F.array_join(F.slice(pieces, F.lit(1), part), ""))).otherwise(F.array().cast("array<string>"))
    spread = rows.withColumn("whole", whole).select(
        "*", F.posexplode(F.concat(F.array_repeat(F.col("text"), whole), cut)).alias("at", "taken_text")
    )
    n_chars = F.when(F.col("at") < F.col("whole"), F.col("n_chars")).otherwise(F.length("taken_text").cast("long"))
    return spread.select("doc_id", F.col("taken_text").alias("text"), "lang", "source", n_chars.alias("n_chars"))


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every row that is left, null and empty texts included."""
    return sharding.assign(docs, SHARDS)


STAGES = [
    ("language_id", language), ("simhash_near_dedup", near_dedup), ("decontamination", decontaminate), ("mixing", mix), ("sharding", shard)
]

#: Learned labels can't be told in SQL; tests/llm holds the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents; each result is written to the shared folder and read again, then the one before goes."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = f"{shared_folder(spark)}/stage-{name}-{uuid.uuid4().hex}"
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            removed(spark, before)
        before = path
    return docs
