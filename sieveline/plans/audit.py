"""The audit of a registry against its articles, stage by stage; each stage is a table that the next one reads."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..operators import matching, records, score
from ..sources import files, providers, tables
from ..sources.log import Log
from ..tables import stored


def scrape(spark: SparkSession, folder: str, registry: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The manifest and the cache rows of the articles in a folder. ``registry`` comes from ``tables``."""
    texts, known = files.load_texts(spark, folder, skip_readme=True), tables.for_matching(registry)
    manifest = matching.settle_claims(matching.match_files(texts, known))
    return manifest, providers.local_cache(texts, manifest, known)


def scrape_stage(spark: SparkSession, folder: str, registry_csv: str, out: str) -> Row:
    """Articles of a folder into ``out``: manifest (CSV) and cache (a log, see ``local_log``); returns what was found and what is missing."""
    registry = tables.read_registry(spark, registry_csv)
    manifest, cache = scrape(spark, folder, registry)
    manifest = stored(manifest, "scrape-manifest")
    tables.write_scrape_manifest(manifest, f"{out}/manifest")
    local_log(spark, f"{out}/cache").append(cache)
    return matching.scrape_totals(tables.for_matching(registry), manifest).first()


def local_log(spark: SparkSession, folder: str) -> Log:
    """The cache of local articles: the last row of a paper counts."""
    return Log(spark, folder, providers.LOCAL_CACHE, "paper_id")


def fetch_stage(
    spark: SparkSession, registry_csv: str, cache_table: str, out: str, literature: Callable, connections: int = 1
) -> list[Row]:
    """Texts of papers that the cache lacks or that failed, appended to it; the manifest (CSV) of all. Returns counts by outcome.

    The cache is a log: a run that is lost before its end leaves it as it was.
    """
    registry = tables.for_matching(tables.read_registry(spark, registry_csv))
    cache = Log(spark, cache_table, providers.CACHE, "paper_id")
    cache.append(providers.fetch_texts(providers.to_do(registry, cache.state()), literature, connections))
    whole = cache.state()
    tables.write_fetch_manifest(whole, f"{out}/fetch_manifest")
    return providers.fetch_counts(whole).collect()


def compare_stage(spark: SparkSession, registry_csv: str, flat_csv: str, out: str) -> None:
    """What was recorded beside what was found, as a CSV."""
    registry = tables.read_registry(spark, registry_csv)
    tables.write_side_by_side(records.side_by_side(registry, tables.read_flat(spark, flat_csv)), f"{out}/side_by_side")


def score_stage(spark: SparkSession, registry_csv: str, verdicts_csv: str) -> str:
    """The reliability report of the verdicts so far."""
    return reliability_report(tables.read_table(spark, verdicts_csv, tables.VERDICTS), tables.read_registry(spark, registry_csv))


def chosen_papers(registry: DataFrame, paper_id: str | None = None, limit: int | None = None) -> DataFrame:
    """One paper, or the first ``limit`` of the registry's order; 0 and None mean all."""
    rows = registry.where(F.col("paper_id") == paper_id) if paper_id else registry
    return rows.orderBy("ord").limit(limit) if limit else rows


def pairs(papers: DataFrame, cache: DataFrame, modalities: list[str] | None = None) -> DataFrame:
    """paper_id, modality, text and text_source of papers that have a text."""
    read = cache.where("coalesce(text, '') <> ''").select("paper_id", "text", "text_source")
    kinds = records.audited_fields(papers.sparkSession, modalities).select("modality").distinct()
    return papers.select("paper_id").join(read, "paper_id").crossJoin(F.broadcast(kinds))  # four rows at most


def _open(work: DataFrame, done: DataFrame, force: bool) -> DataFrame:
    return work if force else work.join(done.select("paper_id", "modality"), ["paper_id", "modality"], "left_anti")


def extraction_messages(work: DataFrame, prompts: DataFrame) -> DataFrame:
    """work and the message for each pair. ``prompts``: modality, prompt."""
    return work.join(prompts, "modality").withColumn("message", providers.extraction_message("text", "text_source", "prompt"))


def reextract(work: DataFrame, done: DataFrame, prompts: DataFrame, model: Callable, force: bool = False) -> DataFrame:
    """paper_id, modality, json and error of the pairs without a result yet (all with force)."""
    return providers.answers(extraction_messages(_open(work, done, force), prompts), model, contract=providers.EXTRACTION)


def verification_messages(work: DataFrame, registry: DataFrame, flat: DataFrame) -> DataFrame:
    """work and the message for each pair: the recorded values of its fields, with the fresh results as context."""
    audited = records.audited_fields(registry.sparkSession)
    values = records.recorded_values(registry).join(audited, "field_name").groupBy("paper_id", "modality")
    values = values.agg(F.array_sort(F.collect_list(F.struct("field_ord", "field_name", "recorded_value"))).alias("values"))
    context = work.join(values, ["paper_id", "modality"]).join(records.modality_summaries(flat), ["paper_id", "modality"], "left")
    summary = F.coalesce("summary", F.lit("(no re-extraction available for this modality)"))
    return context.withColumn("message", providers.verification_message("text", "text_source", summary, "values"))


def verify(work: DataFrame, done: DataFrame, registry: DataFrame, flat: DataFrame, model: Callable, force: bool = False) -> DataFrame:
    """The same as ``reextract`` for verdicts on the recorded values."""
    return providers.answers(verification_messages(_open(work, done, force), registry, flat), model, contract=providers.VERIFICATION)


def reliability_report(verdicts: DataFrame, registry: DataFrame) -> str:
    """The report's numbers come from two scans: the score's, and one for all breakdowns."""
    fields = score.breakdowns(verdicts, "field_name").where("level = 'field_name'").withColumnRenamed("value", "field_name")
    return score.report(score.reliability(verdicts).first(), fields.collect(), registry.count())
