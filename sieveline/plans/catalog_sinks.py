"""Registered queries of sinks that write texts, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import article, dashboard, matching, records
from ..operators.search import TextIndex
from ..sources import tables
from ..sources.log import Log
from ..streaming import claims
from ..tables import stored
from . import audit
from . import catalog
from .catalog import _WORD_COUNT, A, FOUR, POINTS, SIDE, V, WEIGHTS, _board, _flat, _query, _registry
from .catalog_stages import _folder
from .scored_log import ScoredLog
from .inputs import ARTICLES, FILES, VERDICTS, article_part, derived


@_query(
    f"SELECT CAST(doc_id AS VARCHAR) AS stem, {article_part('title')} AS title, coalesce({article_part('doi')}, '') AS doi, "
    f"{article_part('results')} AS results FROM documents"
)
def article_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An indented JSON file for each article, read again."""
    path = _folder(spark, "records")
    parsed = article.parse_articles(derived(spark, sf_dir, ARTICLES), source_file="doc_id")
    tables.write_articles(parsed.withColumn("source_file", F.concat(F.lit("in/"), F.col("source_file").cast("string"), F.lit(".txt"))), path)
    back = tables.read_json_by_key(spark, path, "title string, doi string, sections map<string,string>")
    doi = F.coalesce("value.doi", F.lit("")).alias("doi")
    return back.select(F.col("key").alias("stem"), "value.title", doi, F.col("value.sections")["results"].alias("results"))


_SUMMARY = ", ".join(
    [f"{article_part('title')} AS title", f"{article_part('authors', '; ')} AS authors"]
    + [f"coalesce({article_part(c)}, '') AS {c}" for c in ("doi", "journal", "publication_year")]
)


@_query(
    f"WITH d AS (SELECT doc_id, {_SUMMARY} FROM documents) SELECT CAST(doc_id AS VARCHAR) AS source_file, title, authors, doi, journal, publication_year, "
    f"CAST({_WORD_COUNT} AS VARCHAR) AS word_count, row_number() OVER (ORDER BY doc_id) - 1 AS place FROM d JOIN {A} USING (doc_id)"
)
def summary_from_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary of all articles in files, by source, and the order in which they are read again."""
    path = _folder(spark, "summary")
    tables.write_summary(article.parse_articles(derived(spark, sf_dir, ARTICLES), source_file="doc_id"), path)
    return tables.read_ordered_csv(spark, path)


@_query(
    f"""WITH s AS (SELECT *, CAST({POINTS} AS DECIMAL(4,2)) AS p, CAST({WEIGHTS} AS DECIMAL(4,2)) AS w FROM {V}),
a AS (SELECT count(*) AS n, count(*) FILTER (p IS NOT NULL AND w IS NOT NULL) AS scored, count(DISTINCT paper_id) AS papers, {FOUR.replace('{}', '')},
 CAST(sum(p * w) AS DOUBLE) AS wp, CAST(sum(w) FILTER (p IS NOT NULL) AS DOUBLE) AS ww FROM s), t AS (SELECT count(*) AS total FROM documents)
SELECT concat('Reliability score: ', round_even((wp + 2.5::DOUBLE) / (ww + 5.0::DOUBLE) * 10, 1), '/10  (raw, unshrunk: ', round_even(wp / ww * 10, 1), '/10)', chr(10),
 'Based on ', scored, ' scored field-verdicts across ', papers, '/', total, ' papers audited (', n, ' total verdicts including unverifiable).', chr(10),
 CASE WHEN papers < total * 0.2 THEN concat('CAUTION: only ', papers, '/', total, ' papers have been audited so far - this score is a provisional estimate, ',
  'not a corpus-wide reliability figure. It will change, possibly a lot, as more papers are audited.', chr(10)) ELSE '' END, chr(10),
 'Verdict breakdown: match=', match, ', partial=', partial, ', mismatch=', mismatch, ', unverifiable=', unverifiable) AS head FROM a, t"""
)
def report_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text report down to the breakdown by field."""
    text = audit.reliability_report(derived(spark, sf_dir, VERDICTS), _registry(spark, sf_dir))
    return spark.createDataFrame([(text.split("\n\nBy field:")[0],)], "head string")


_TITLED = "contains(lower(concat(paper_id, ' ', title)), '{}')"


@_query(catalog.oracle_sql()["dashboard_search"])
def indexed_dashboard_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The overview's search by trigrams."""
    index = TextIndex.build(_board(spark, sf_dir), dashboard.searchable(dashboard.SEARCHED), _folder(spark, "board-index"))
    return dashboard.with_status(index.search("SRC1"), "missing").select("id", "matched")


@_query(
    f"SELECT event_id, CASE WHEN event_id % 9 = 0 THEN '' ELSE evidence_quote END AS shown_quote, 'son 77' AS term FROM {V} WHERE verdict = 'mismatch' AND contains(lower(explanation), 'son 77') "
    f"UNION ALL SELECT event_id, CASE WHEN event_id % 9 = 0 THEN '' ELSE evidence_quote END, 'st-1' FROM {V} WHERE verdict = 'mismatch' AND contains(lower(paper_id), 'st-1')"
)
def indexed_verdict_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two searches of the verdicts with one index."""
    columns = ["paper_id", "field_name", "explanation", "modality"]
    index = TextIndex.build(derived(spark, sf_dir, VERDICTS), dashboard.searchable(columns), _folder(spark, "verdict-index"))
    one, two = (
        dashboard.verdict_view(index.search(term), "mismatch").select("event_id", "shown_quote", F.lit(term.lower()).alias("term"))
        for term in ("SON 77", "ST-1")
    )
    return one.unionByName(two)


@_query(
    f"WITH {SIDE} SELECT paper_id, count(DISTINCT field_name) AS n_fields, count(*) AS n_rows FROM rows WHERE {_TITLED.format('st-12')} OR {_TITLED.format('study tha')} GROUP BY paper_id"
)
def indexed_review_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The review's search by trigrams of papers; only the papers found are nested."""
    registry = _registry(spark, sf_dir)
    papers = registry.select("paper_id", "title")
    index = TextIndex.build(papers, dashboard.review_text, _folder(spark, "review-index"))
    found = index.search("ST-12").unionByName(index.search("Study Tha"))
    nested = dashboard.review_of(records.side_by_side(registry, _flat(spark, sf_dir)), found)
    n_rows = F.aggregate("fields", F.lit(0).cast("long"), lambda n, f: n + F.size(f["rows"]))
    return nested.select("paper_id", F.size("fields").cast("long").alias("n_fields"), n_rows.alias("n_rows"))


@_query(
    """WITH b AS (SELECT doc_id, 1 AS n, text FROM documents WHERE doc_id % 3 > 0 UNION ALL SELECT doc_id, 2, concat(source, ' again') FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, 3, lang FROM documents WHERE doc_id % 5 = 1)
SELECT concat('ST-', doc_id) AS paper_id, max_by(concat('batch ', n), n) AS status, md5(coalesce(max_by(coalesce(text, ''), n), '')) AS digest FROM b GROUP BY doc_id"""
)
def cache_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cache written in three batches, compacted between the second and the third: of each paper the last row."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    log = Log(spark, _folder(spark, "log"), "paper_id string, status string, text string", "paper_id")
    batches = [("doc_id % 3 > 0", F.col("text")), ("doc_id % 2 = 0", F.concat("source", F.lit(" again"))), ("doc_id % 5 = 1", F.col("lang"))]
    for n, (which, text) in enumerate(batches, 1):
        key = F.concat(F.lit("ST-"), F.col("doc_id").cast("string")).alias("paper_id")
        log.append(docs.where(which).select(key, F.lit(f"batch {n}").alias("status"), text.alias("text")))
        if n == 2:
            log.compact()
    return log.state().select("paper_id", "status", F.md5(F.coalesce("text", F.lit(""))).alias("digest"))


_CHANGED = "CASE WHEN event_id % 10 = 3 THEN 'match' ELSE verdict END"
_LAST = f"(SELECT paper_id, explanation, {_CHANGED} AS verdict, confidence FROM {V}) AS v"


@_query(catalog.oracle_sql()["reliability_score"].replace(f"FROM {V}", f"FROM {_LAST}"))
def score_after_appends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score of a log of verdicts in three appends, the last of which changes some of the first: from sums by paper."""
    rows = derived(spark, sf_dir, VERDICTS)
    log = ScoredLog(spark, _folder(spark, "scored"), "paper_id string, explanation string, verdict string, confidence string", "paper_id", "explanation")
    changed = F.when(F.col("event_id") % 10 == 3, "match").otherwise(F.col("verdict"))
    log.append(rows.where("event_id % 10 < 5"))
    log.append(rows.where("event_id % 10 >= 5").withColumn("verdict", changed))
    log.append(rows.where("event_id % 10 = 3").withColumn("verdict", changed))
    return log.score()


@_query(catalog.oracle_sql()["claim_manifest"])
def streamed_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest from a stream of matches in three batches, each of which writes the claims that it changes."""
    found = stored(matching.match_files(derived(spark, sf_dir, FILES), _registry(spark, sf_dir)), "matches")
    source, log = _folder(spark, "arriving"), _folder(spark, "claims")
    for k in range(3):
        found.where(F.pmod(F.xxhash64("file"), F.lit(3)) == k).write.mode("append").parquet(source)
        stream = spark.readStream.schema(found.schema).parquet(source)
        claims.follow(stream, log, f"{log}-marks").awaitTermination()
    return claims.claims_log(spark, log).state()
