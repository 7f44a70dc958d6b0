"""Mixing sources to target weights by capped water-filling, with seeded whole and fractional repetitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

WORDS = r"[^\x20\x09-\x0D]+"
#: Leading hexadecimal digits of a draw that make its bucket: 4,096 buckets.
BUCKET_DIGITS = 3


def n_words(text: str = "text"):
    return F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(WORDS)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """Adds target to rows (source, source_size): source order is by code point, null last.

    Water rises in all sources in proportion to their weights; a source is full at ``most`` times its size. Sorted
    by how early they fill up, the full ones are a prefix, so prefix sums over the sources (not the documents) give
    the level.
    """
    everything = Window.partitionBy()
    weight = F.get(
        F.array(*[F.lit(float(w)) for w in weights]),
        (F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    )
    capped = sources.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    capped = capped.withColumn(
        "total", F.sum("source_size").over(everything) * F.lit(float(share))
    ).withColumn("full_at", F.col("cap") / F.col("weight"))
    by_level = everything.orderBy("full_at", F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    behind = by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(behind)
    ranked = capped.withColumn("level", level).withColumn("full", F.col("full_at") <= F.col("level"))
    reached = F.max(F.when(~F.col("full"), F.col("level"))).over(everything)
    return ranked.withColumn("reached", reached).select(
        "source", "source_size", F.when(F.col("full"), F.col("cap")).otherwise(F.col("reached") * F.col("weight")).alias("target")
    )


def mix(documents: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 17) -> DataFrame:
    """doc_id, source, size, source_size, target, taken and text_hash (Spark's xxhash64) for each row.

    size counts the words (null: 0); source_size sums them. Sources weigh ``weights`` in turn by code point, null
    last, and share ``share`` of all words; none gets over ``most`` times its size. Every document is taken as often
    as the target holds its source whole; the rest of the target goes once more through the source's documents in
    an order seeded by ``seed``, doc_id and text, whole documents first and a part of the one at the end, so that a
    source's taken words add up to its target, rounded. taken <= most * size for each document if most is whole.
    Rows of equal doc_id and text stand side by side in that order. Columns besides doc_id, text and source are not read. An empty table gives an empty result.

    The order is by hash, so its buckets are ranges of it: sums per (source, bucket) and a prefix scan over these
    tell where each bucket starts, and a source of any size is spread over 4,096 keys.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    draw = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.md5(text)))
    sized = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        n_words().alias("size"),
        F.xxhash64(F.col("text").cast("string")).alias("text_hash"),
        draw.alias("draw")
    )
    sized = stored(sized.withColumn("bucket", F.substring("draw", 1, BUCKET_DIGITS)), "op7-sized")
    buckets = stored(sized.groupBy("source", "bucket").agg(F.sum("size").alias("words")), "op7-buckets")
    sources = targets(buckets.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, most)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    quotas = sources.withColumn("whole", whole).withColumn(
        "rest", F.floor(F.col("target") + 0.5).cast("long") - F.col("whole") * F.col("source_size")
    )
    ahead = F.coalesce(
        F.sum("words").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    placed = buckets.withColumn("ahead", ahead).join(
        quotas.withColumnRenamed("source", "q_source"), F.expr("source <=> q_source")
    ).drop("q_source", "words")
    keys = placed.withColumnsRenamed({"source": "p_source", "bucket": "p_bucket"})
    rows = sized.join(keys, F.expr("bucket = p_bucket AND source <=> p_source"))
    own = Window.partitionBy("source", "bucket").orderBy("draw", "doc_id", "size", "text_hash").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("ahead") + F.coalesce(F.sum("size").over(own), F.lit(0))
    extra = F.least("size", F.greatest(F.col("rest") - start, F.lit(0)))
    return rows.select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        (F.col("whole") * F.col("size") + extra).cast("long").alias("taken"),
        "text_hash"
    )
