"""Registered queries of the library's own operators, each with DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import html_escaped, normal_doi
from ..operators import article, dashboard, matching, records, score
from ..sources import files as file_sources
from ..sources import providers, sinks

from .inputs import ARTICLES, FILES, FLAT, REGISTRY, VERDICTS, article_part, derived, sql

FLAGSHIP = "reliability_score"
Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_oracles: dict[str, str] = {}


def _query(oracle: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        _queries[f.__name__] = f
        if oracle:
            _oracles[f.__name__] = oracle
        return f

    return keep


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_oracles)


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived registry with the audited columns under their real names."""
    names = {
        "anatomical": dashboard.ANATOMICAL,
        "photometry": dashboard.PHOTOMETRY,
        "ephys": dashboard.EPHYS,
        "functional": dashboard.FUNCTIONAL,
        "who": dashboard.YEAR
    }
    return derived(spark, sf_dir, REGISTRY).withColumnsRenamed(names)


def _flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derived(spark, sf_dir, FLAT)
    some = F.create_map(F.lit("note"), F.col("note"), F.lit("turn"), F.col("row_index").cast("string"))
    return rows.withColumn("fields", F.when(F.col("has_fields"), some).otherwise(F.create_map().cast("map<string,string>")))


V = f"({sql(VERDICTS)}) AS v"
POINTS = "CASE verdict WHEN 'match' THEN 1.0 WHEN 'partial' THEN 0.5 WHEN 'mismatch' THEN 0.0 END"
WEIGHTS = "CASE confidence WHEN 'high' THEN 1.0 WHEN 'medium' THEN 0.65 WHEN 'low' THEN 0.35 END"
FOUR = ", ".join(f"count(*) FILTER (verdict = '{v}') AS {{}}{v}" for v in score.VERDICTS)


@_query(f"""
WITH s AS (SELECT *, CAST({POINTS} AS DECIMAL(4,2)) AS p, CAST({WEIGHTS} AS DECIMAL(4,2)) AS w FROM {V}),
a AS (SELECT count(*) AS n_field_verdicts, count(*) FILTER (p IS NOT NULL AND w IS NOT NULL) AS n_scored_verdicts, count(DISTINCT nullif(paper_id, '')) AS n_papers_audited, {FOUR.replace('{}', 'n_')},
 CAST(coalesce(sum(p * w), 0) AS DOUBLE) AS weighted_points, CAST(coalesce(sum(w) FILTER (p IS NOT NULL), 0) AS DOUBLE) AS weighted_weight FROM s)
SELECT *, weighted_points / nullif(weighted_weight, 0) AS raw_fraction, (weighted_points + 2.5::DOUBLE) / (weighted_weight + 5.0::DOUBLE) AS shrunk_fraction,
 round_even(weighted_points / nullif(weighted_weight, 0) * 10, 1) AS raw_score_10, round_even((weighted_points + 2.5::DOUBLE) / (weighted_weight + 5.0::DOUBLE) * 10, 1) AS shrunk_score_10 FROM a""")
def reliability_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.reliability(derived(spark, sf_dir, VERDICTS))


@_query(f"SELECT field_name, {FOUR.replace('{}', '')} FROM {V} GROUP BY field_name")
def verdicts_by_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.verdict_counts(derived(spark, sf_dir, VERDICTS), "field_name")


@_query(f"SELECT modality, {FOUR.replace('{}', '')} FROM {V} GROUP BY modality")
def verdicts_by_modality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.verdict_counts(derived(spark, sf_dir, VERDICTS), "modality")


@_query(f"SELECT {FOUR.replace('{}', '')} FROM {V}")
def verdict_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.verdict_counts(derived(spark, sf_dir, VERDICTS))


@_query(
    f"SELECT CASE WHEN grouping(field_name) = 0 THEN 'field_name' WHEN grouping(modality) = 0 THEN 'modality' ELSE 'all' END AS level, coalesce(field_name, modality, '') AS value, {FOUR.replace('{}', '')} FROM {V} GROUP BY GROUPING SETS ((field_name), (modality), ())"
)
def verdict_breakdowns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overall, by field and by modality in one scan."""
    return score.breakdowns(derived(spark, sf_dir, VERDICTS), "field_name", "modality")


@_query(f"SELECT count(DISTINCT paper_id) < (SELECT count(*) FROM documents) * 0.2 AS provisional FROM {V}")
def provisional_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    audited = score.reliability(derived(spark, sf_dir, VERDICTS)).select("n_papers_audited")
    total = _docs(spark, sf_dir).agg(F.count(F.lit(1)).alias("total"))
    return audited.join(total).select(score.is_provisional(F.col("n_papers_audited"), F.col("total")).alias("provisional"))


@_query(r"""SELECT doc_id, array_to_string(list_distinct_in_order, '|') AS emails, CAST(len(list_distinct_in_order) AS BIGINT) AS n_emails FROM
 (SELECT doc_id, list_filter(e, lambda x, i: list_position(e, x) = i) AS list_distinct_in_order FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[\p{L}\p{M}\p{N}_.+-]+@[\p{L}\p{M}\p{N}_-]+\.[\p{L}\p{M}\p{N}_.-]+') AS e FROM documents) AS x) AS y""")
def emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _docs(spark, sf_dir).select("doc_id", article.emails_of(F.coalesce("text", F.lit(""))).alias("e"))
    return found.select("doc_id", F.array_join("e", "|").alias("emails"), F.size("e").cast("long").alias("n_emails"))


@_query(
    r"SELECT doc_id, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\s\x0B\x1C-\x1F\x{85}\p{Z}]+')) AS BIGINT) AS word_count FROM documents"
)
def word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", article.word_count(F.coalesce("text", F.lit(""))).cast("long").alias("word_count"))


A = f"({sql(ARTICLES)}) AS a"
FIELDS = [
    "title", "authors", "first_email", "keywords", "doi", "journal", "publication_year", "refs", "section_names", "results", "abstract"
]


@_query(
    f"SELECT doc_id, {', '.join(f'{article_part(f)} AS {f}' for f in FIELDS)}, md5({article_part('bodies')}) AS bodies_md5, CAST(length({article_part('bodies')}) AS INTEGER) AS bodies_length FROM documents"
)
def article_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All fields, and of the sections every name and whole body."""
    parsed = article.parse_articles(derived(spark, sf_dir, ARTICLES), source_file="doc_id")
    names = F.array_join(F.transform("sections", lambda s: s["name"]), "|")
    bodies = F.array_join(F.transform("sections", lambda s: F.concat(F.lit("<"), s["name"], F.lit(">"), s["body"])), "")
    return parsed.withColumn("bodies", bodies).select(
        F.col("source_file").alias("doc_id"),
        "title",
        F.array_join("authors", "|").alias("authors"),
        F.get("emails", F.lit(0)).alias("first_email"),
        F.array_join("keywords", "|").alias("keywords"),
        "doi",
        "journal",
        "publication_year",
        F.array_join(F.transform("references", lambda r: F.concat(F.lit("["), r, F.lit("]"))), "").alias("refs"),
        names.alias("section_names"),
        F.get(F.filter("sections", lambda s: s["name"] == "results"), F.lit(0))["body"].alias("results"),
        "abstract",
        F.md5("bodies").alias("bodies_md5"),
        F.length("bodies").alias("bodies_length"),
    )


_SUMMARY = ["title", "doi", "journal", "publication_year"]
_WORD_COUNT = r"CAST(len(regexp_extract_all(text, '[^\s\x0B\x1C-\x1F\x{85}\p{Z}]+')) AS INTEGER)"


@_query(
    f"WITH d AS (SELECT doc_id, {article_part('authors', '; ')} AS authors, {', '.join(f'{article_part(f)} AS {f}' for f in _SUMMARY)} FROM documents) "
    f"SELECT doc_id AS source_file, title, authors, doi, journal, publication_year, {_WORD_COUNT} AS word_count FROM d JOIN {A} USING (doc_id)"
)
def article_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return article.summary_rows(article.parse_articles(derived(spark, sf_dir, ARTICLES), source_file="doc_id"))


@_query("SELECT doc_id, CASE WHEN doc_id % 6 < 4 THEN concat('10.1/', doc_id) END AS doi FROM documents")
def doi_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each form of a DOI, and among them blank and absent ones."""
    own = F.col("doc_id").cast("string")
    forms = [F.concat(F.lit(head), own, F.lit("/ ")) for head in ("https://doi.org/10.1/", " HTTP://dx.DOI.org/10.1/", "10.1/", "/10.1/")]
    given = F.get(F.array(*forms, F.lit(" \t"), F.lit(None).cast("string")), (F.col("doc_id") % 6).cast("int"))
    return _docs(spark, sf_dir).select("doc_id", normal_doi(given).alias("doi"))


WORDS = "list_distinct(regexp_extract_all(lower({}), '[a-z0-9]+'))"


def _title_sql(files: str, registry: str) -> str:
    return f"""h AS (SELECT file, unnest({WORDS.format('substring(text, 1, 4000)')}) AS w FROM {files}), t0 AS (SELECT ord, paper_id, {WORDS.format('title')} AS ws FROM {registry}),
t AS (SELECT ord, paper_id, len(ws) AS n, unnest(ws) AS w FROM t0), o AS (SELECT file, ord, paper_id, count(*) / max(n) AS score FROM h JOIN t USING (w) GROUP BY ALL HAVING count(*) / max(n) >= 0.5),
title AS (SELECT file, paper_id, score FROM o QUALIFY row_number() OVER (PARTITION BY file ORDER BY score DESC, ord) = 1)"""


@_query(f"""WITH f AS (SELECT doc_id AS file, coalesce(text, '') AS text FROM documents), r AS (SELECT item_id AS ord, CAST(item_id AS VARCHAR) AS paper_id, text AS title FROM benchmark),
{_title_sql('f', 'r')} SELECT file, paper_id, CAST(score AS DOUBLE) AS score FROM title""")
def title_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _docs(spark, sf_dir).select(F.col("doc_id").alias("file"), F.coalesce("text", F.lit("")).alias("text"))
    registry = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(
        F.col("item_id").alias("ord"), F.col("item_id").cast("string").alias("paper_id"), F.col("text").alias("title")
    )
    return matching.by_title(files, registry)


F_SQL, R_SQL = sql(FILES), sql(REGISTRY)
KEY = "regexp_replace(lower({}), '[-_\\s]+', '', 'g')"
NAMED = f"named AS (SELECT file, r.paper_id FROM f JOIN (SELECT {KEY.format('paper_id')} AS k, min_by(paper_id, ord) AS paper_id FROM r GROUP BY 1) AS r ON {KEY.format('stem')} = r.k)"
CITED = r"""found AS (SELECT file, rtrim(nullif(regexp_extract(substring(text, 1, 3000), '10\.1234/doc[^\s]+'), ''), ').,;') AS doi FROM f), cited AS (SELECT file, r.paper_id FROM found JOIN r USING (doi))"""
MANIFEST = f"""f AS ({F_SQL}), r AS ({R_SQL}), ok AS (SELECT * FROM f WHERE trim(text, ' ') <> ''), n0 AS (SELECT * FROM ok), {NAMED.replace('FROM f ', 'FROM ok ')}, rest AS (SELECT * FROM ok WHERE file NOT IN (SELECT file FROM named)),
{CITED.replace('FROM f)', 'FROM rest)')}, last AS (SELECT * FROM rest WHERE file NOT IN (SELECT file FROM cited)), {_title_sql('last', 'r')},
m AS (SELECT file, paper_id, 'filename' AS match_method, 1.0::DOUBLE AS confidence FROM named UNION ALL SELECT file, paper_id, 'doi', 0.95 FROM cited UNION ALL SELECT file, paper_id, 'title', round_even(CAST(score AS DOUBLE), 3) FROM title),
manifest AS (SELECT f.file, coalesce(m.paper_id, '') AS paper_id, CASE WHEN trim(f.text, ' ') = '' THEN 'extraction_failed' ELSE coalesce(match_method, 'unmatched') END AS match_method, coalesce(confidence, 0.0) AS confidence,
 CASE WHEN trim(f.text, ' ') = '' THEN 'failed' WHEN m.paper_id IS NULL THEN 'unmatched' ELSE 'matched' END AS status FROM f LEFT JOIN m USING (file)),
claims AS (SELECT file, paper_id, match_method, confidence, CASE WHEN status <> 'matched' THEN status WHEN max(confidence) OVER (PARTITION BY paper_id, status ORDER BY file ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= confidence THEN 'duplicate_match'
 WHEN max(confidence) OVER (PARTITION BY paper_id, status ORDER BY file ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) > confidence THEN 'superseded' ELSE 'matched' END AS status FROM manifest)"""


@_query(f"WITH f AS ({F_SQL}), r AS ({R_SQL}), {NAMED} SELECT file, paper_id FROM named")
def filename_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.by_file_name(derived(spark, sf_dir, FILES), _registry(spark, sf_dir))


@_query(f"WITH f AS ({F_SQL}), r AS ({R_SQL}), {CITED} SELECT file, paper_id FROM cited")
def doi_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.by_doi(derived(spark, sf_dir, FILES), _registry(spark, sf_dir))


@_query(f"WITH {MANIFEST} SELECT file, paper_id, match_method, CAST(confidence AS DOUBLE) AS confidence, status FROM claims")
def claim_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _manifest(spark, sf_dir)


def _manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.settle_claims(matching.match_files(derived(spark, sf_dir, FILES), _registry(spark, sf_dir)), "file")


@_query(f"WITH {MANIFEST} SELECT paper_id FROM r WHERE paper_id NOT IN (SELECT paper_id FROM claims WHERE status = 'matched')")
def missing_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.missing_papers(_registry(spark, sf_dir), _manifest(spark, sf_dir)).select("paper_id")


@_query(f"""WITH {MANIFEST} SELECT (SELECT count(DISTINCT paper_id) FROM claims WHERE status = 'matched') AS matched, (SELECT count(*) FROM claims WHERE status IN ('unmatched', 'failed')) AS unmatched_files,
 (SELECT count(*) FROM r WHERE paper_id NOT IN (SELECT paper_id FROM claims WHERE status = 'matched')) AS missing""")
def scrape_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.scrape_totals(_registry(spark, sf_dir), _manifest(spark, sf_dir))


L = sql(FLAT)
DETAIL = "CASE WHEN has_fields THEN concat('note: ', note, '; turn: ', row_index) ELSE '' END"


@_query(f"""SELECT paper_id, modality, CAST(row_number() OVER (PARTITION BY paper_id, modality ORDER BY row_index) - 1 AS INTEGER) AS row_index, row_label, figure_ref, source_quote, {DETAIL} AS detail, trim(summary_paragraph) AS summary_paragraph FROM ({L}) AS l
 UNION ALL SELECT DISTINCT concat('EMPTY-', conv_id), 'ephys', 0, '(summary only - no itemized rows returned)', '', '', '', '' FROM conversations""")
def flatten_extractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = _flat(spark, sf_dir)
    item = F.struct("row_index", "row_label", "figure_ref", "source_quote", "fields")
    grouped = flat.groupBy("paper_id", "modality").agg(
        F.array_sort(F.collect_list(F.struct("row_index", F.to_json(item).alias("item")))).alias("items"),
        F.min("summary_paragraph").alias("s")
    )
    made = F.concat(
        F.lit('{"rows": ['),
        F.array_join(F.transform("items", lambda i: i["item"]), ","),
        F.lit('], "summary_paragraph": " '),
        "s",
        F.lit(' "}')
    )
    empty = derived(spark, sf_dir, "SELECT DISTINCT conv_id FROM {conversations}").select(
        F.concat(F.lit("EMPTY-"), F.col("conv_id").cast("string")).alias("paper_id"),
        F.lit("ephys").alias("modality"),
        F.lit('{"rows": []}').alias("json")
    )
    raw = grouped.select("paper_id", "modality", made.alias("json")).unionByName(empty)
    out = records.flatten_extractions(raw)
    return out.select(
        "paper_id",
        "modality",
        "row_index",
        "row_label",
        "figure_ref",
        "source_quote",
        records.detail("fields").alias("detail"),
        "summary_paragraph"
    )


@_query(
    f"SELECT paper_id, modality, row_index, CASE WHEN has_fields THEN concat(row_label, ' — ', {DETAIL}) ELSE row_label END AS value FROM ({L}) AS l"
)
def rendered_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(spark, sf_dir).select("paper_id", "modality", "row_index", records.rendered("row_label", "fields").alias("value"))


@_query(f"""WITH l AS ({L}), x AS (SELECT paper_id, modality, min_by(summary_paragraph, row_index) AS s, string_agg(CASE WHEN has_fields THEN concat('- ', row_label, ': ', {DETAIL}, CASE WHEN figure_ref <> '' THEN concat(' [', figure_ref, ']') ELSE '' END) END, chr(10) ORDER BY row_index) AS b FROM l GROUP BY ALL)
SELECT paper_id, modality, CASE WHEN s = '' AND b IS NULL THEN '(model returned no itemized data)' WHEN s = '' THEN b WHEN b IS NULL THEN concat('Overall summary: ', s) ELSE concat('Overall summary: ', s, chr(10), b) END AS summary FROM x""")
def modality_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.modality_summaries(_flat(spark, sf_dir))


ANSWER = "concat(paper_id, '/', event_id // 20)"


@_query(f"""SELECT {ANSWER} AS paper_id, modality, field_name, CASE WHEN event_id % 13 = 0 THEN 'unverifiable' ELSE verdict END AS verdict, CASE WHEN event_id % 13 = 0 THEN '' ELSE confidence END AS confidence, explanation, evidence_quote,
 CAST(row_number() OVER (PARTITION BY paper_id, event_id // 20, modality ORDER BY event_id) - 1 AS INTEGER) AS ord FROM {V}""")
def flatten_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of several verdicts, some without a verdict and a confidence, and some without any verdict at all."""
    rows = derived(spark, sf_dir, VERDICTS).withColumn(
        "paper_id", F.concat("paper_id", F.lit("/"), F.floor(F.col("event_id") / 20).cast("string"))
    )
    told = [F.when(F.col("event_id") % 13 != 0, F.col(c)).alias(c) for c in ("verdict", "confidence")]
    one = F.struct("event_id", F.struct(F.col("field_name").alias("x_field"), *told, "explanation", "evidence_quote").alias("v"))
    grouped = rows.groupBy("paper_id", "modality").agg(
        F.array_sort(F.collect_list(F.struct("event_id", F.to_json(one["v"]).alias("v")))).alias("vs")
    )
    made = F.concat(F.lit('{"verdicts": ['), F.array_join(F.transform("vs", lambda v: v["v"]), ","), F.lit("]}"))
    none = grouped.select("paper_id", F.lit("none").alias("modality"), F.lit('{"verdicts": []}').alias("json"))
    return records.flatten_verdicts(grouped.select("paper_id", "modality", made.alias("json")).unionByName(none))


SIDE = f"""r AS ({R_SQL}), l AS ({L}), audit(mod_ord, modality, field_ord, field_name) AS (VALUES {', '.join(f"({i}, '{m}', {j}, '{f}')" for i, (m, fields) in enumerate(records.MODALITIES.items()) for j, f in enumerate(fields))}),
base AS (SELECT ord, mod_ord, field_ord, paper_id, title, modality, field_name, coalesce(CASE field_name WHEN 'Anatomical connections' THEN anatomical WHEN 'Photometry Data' THEN photometry WHEN 'Electrophysiology Data' THEN ephys WHEN 'Purpose of this circuit' THEN functional END, '') AS recorded_value FROM r, audit),
g AS (SELECT paper_id, modality, min_by(summary_paragraph, row_index) AS s, count(*) FILTER (has_fields) AS n FROM l GROUP BY ALL),
rows AS (SELECT b.*, 0 AS kind, 0 AS row_index, '' AS row_label, '[not re-extracted yet]' AS found_value, '' AS source_quote, '' AS figure_ref FROM base b LEFT JOIN g USING (paper_id, modality) WHERE g.paper_id IS NULL
 UNION ALL SELECT b.*, 0, 0, '(overall summary)', s, '', '' FROM base b JOIN g USING (paper_id, modality) WHERE s <> ''
 UNION ALL SELECT b.*, 1, row_index, row_label, concat(row_label, ' — ', {DETAIL}), source_quote, figure_ref FROM base b JOIN l USING (paper_id, modality) WHERE has_fields
 UNION ALL SELECT b.*, 0, 0, '', '[model returned no data]', '', '' FROM base b JOIN g USING (paper_id, modality) WHERE s = '' AND n = 0)"""


@_query(
    f"WITH {SIDE} SELECT ord, CAST(mod_ord AS INTEGER) AS mod_ord, CAST(field_ord AS INTEGER) AS field_ord, paper_id, title, modality, field_name, recorded_value, CAST(kind AS INTEGER) AS kind, CAST(row_index AS INTEGER) AS row_index, row_label, found_value, source_quote, figure_ref FROM rows"
)
def side_by_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.side_by_side(_registry(spark, sf_dir), _flat(spark, sf_dir))


SEVERITY = "CASE verdict WHEN 'mismatch' THEN 0 WHEN 'partial' THEN 1 WHEN 'unverifiable' THEN 2 WHEN 'match' THEN 3 ELSE 99 END"


@_query(
    f"SELECT event_id, verdict, {SEVERITY} AS severity, row_number() OVER (PARTITION BY paper_id ORDER BY {SEVERITY}, event_id) AS place FROM {V}"
)
def triage_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of each verdict among those of its paper, worst first."""
    rows = derived(spark, sf_dir, VERDICTS).withColumn("severity", records.severity("verdict"))
    rows = rows.select("paper_id", "severity", "event_id", "verdict")
    return sinks.places(rows, "paper_id", "severity", "event_id").select("event_id", "verdict", "severity", "place")


@_query(f"""WITH r AS ({R_SQL}) SELECT event_id, v.paper_id, v.field_name, verdict, coalesce(title, '') AS title, coalesce(CASE v.field_name WHEN 'Anatomical connections' THEN anatomical WHEN 'Electrophysiology Data' THEN ephys WHEN 'Purpose of this circuit' THEN functional END, '') AS recorded_value
 FROM {V} LEFT JOIN (SELECT * FROM r) AS r ON r.paper_id = v.paper_id AND v.field_name <> 'Verification of Zona Incerta Targeting'""")
def verdicts_with_recorded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.with_recorded(derived(spark, sf_dir, VERDICTS), _registry(spark, sf_dir)).select(
        "event_id", "paper_id", "field_name", "verdict", "title", "recorded_value"
    )


BOARD = f"""{MANIFEST}, last_claim AS (SELECT paper_id, max_by(confidence, file) AS confidence, max_by(match_method, file) AS match_method FROM claims WHERE paper_id <> '' GROUP BY 1),
board AS (SELECT ord, r.paper_id AS id, title, '' AS authors, coalesce(doi, '') AS doi, concat('animal ', lang) AS animal_model, trim(split_part(who, ';', -1), ' ') AS year, coalesce(trim(anatomical, ' '), '') AS anatomical_text, trim(photometry, ' ') AS photometry_text, trim(ephys, ' ') AS ephys_text, coalesce(trim(anatomical, ' '), '') <> '' AS has_anatomical,
 coalesce(trim(photometry, ' '), '') <> '' AS has_photometry, coalesce(trim(ephys, ' '), '') <> '' AS has_ephys, coalesce(trim(functional, ' '), '') <> '' AS has_functional, c.paper_id IS NOT NULL AS matched, CAST(c.confidence AS DOUBLE) AS confidence, match_method FROM (SELECT r.*, functional AS lang FROM r) AS r LEFT JOIN last_claim AS c ON r.paper_id = c.paper_id)"""
BOARD_COLUMNS = [
    "ord",
    "id",
    "title",
    "authors",
    "year",
    "doi",
    "animal_model",
    "anatomical_text",
    "photometry_text",
    "ephys_text",
    "has_anatomical",
    "has_photometry",
    "has_ephys",
    "has_functional",
    "matched",
    "confidence",
    "match_method"
]


def _board(spark: SparkSession, sf_dir: str) -> DataFrame:
    registry = _registry(spark, sf_dir).withColumnsRenamed({"title": dashboard.TITLE, "doi": dashboard.DOI_COLUMN})
    registry = registry.withColumn(dashboard.ANIMAL, F.concat(F.lit("animal "), F.col(f"`{dashboard.FUNCTIONAL}`")))
    return dashboard.paper_rows(registry, dashboard.last_claims(_manifest(spark, sf_dir), "file"))


@_query(f"WITH {BOARD} SELECT {', '.join(BOARD_COLUMNS)} FROM board")
def dashboard_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _board(spark, sf_dir).select(*BOARD_COLUMNS)


@_query(
    f"WITH {BOARD} SELECT id, matched FROM board WHERE NOT matched AND (contains(lower(id), 'src1') OR contains(lower(title), 'src1') OR contains(lower(doi), 'src1') OR contains(lower(anatomical_text), 'src1') OR contains(lower(photometry_text), 'src1') OR contains(lower(ephys_text), 'src1'))"
)
def dashboard_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboard.searched(dashboard.with_status(_board(spark, sf_dir), "missing"), "SRC1").select("id", "matched")


@_query(
    f"WITH r AS ({R_SQL}) SELECT paper_id, row_number() OVER (PARTITION BY functional ORDER BY split_part(paper_id, '-', 1), CAST(split_part(paper_id, '-', 2) AS BIGINT)) AS place FROM r"
)
def natural_id_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _registry(spark, sf_dir).select("paper_id", F.col(f"`{dashboard.FUNCTIONAL}`").alias("functional"))
    return sinks.places(rows, "functional", *dashboard.natural_order("paper_id")).select("paper_id", "place")


@_query(f"""WITH {BOARD}, s AS (SELECT count(DISTINCT paper_id) AS audited, count(*) FILTER (verdict = 'mismatch') AS mismatches, count(*) FILTER (verdict = 'partial') AS partials,
 CAST(sum(CAST({POINTS} AS DECIMAL(4,2)) * CAST({WEIGHTS} AS DECIMAL(4,2))) AS DOUBLE) AS p, CAST(sum(CAST({WEIGHTS} AS DECIMAL(4,2))) FILTER ({POINTS} IS NOT NULL) AS DOUBLE) AS w FROM {V})
SELECT (SELECT count(*) FROM board) AS papers, (SELECT count(*) FROM board WHERE matched) AS matched, (SELECT count(*) FROM board WHERE NOT matched) AS missing, audited, mismatches, partials,
 round_even(p / nullif(w, 0) * 10, 1) AS raw_score_10, round_even((p + 2.5::DOUBLE) / (w + 5.0::DOUBLE) * 10, 1) AS shrunk_score_10 FROM s""")
def dashboard_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboard.tiles(_board(spark, sf_dir), derived(spark, sf_dir, VERDICTS))


@_query(
    f"SELECT event_id, CASE WHEN event_id % 9 = 0 THEN '' ELSE evidence_quote END AS shown_quote FROM {V} WHERE verdict = 'mismatch' AND (contains(lower(paper_id), 'st-1') OR contains(lower(field_name), 'st-1') OR contains(lower(explanation), 'st-1') OR contains(lower(modality), 'st-1'))"
)
def verdict_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboard.verdict_view(derived(spark, sf_dir, VERDICTS), "mismatch", "ST-1").select("event_id", "shown_quote")


@_query(
    f"WITH {MANIFEST} SELECT CASE WHEN status = 'matched' THEN 'local_txt' ELSE status END AS outcome, count(*) AS n FROM claims GROUP BY 1"
)
def fetch_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = _manifest(spark, sf_dir)
    return providers.fetch_counts(manifest.select(F.when(F.col("status") == "matched", "local_txt").alias("text_source"), "status"))


@_query(
    f"WITH {MANIFEST} SELECT paper_id FROM r WHERE paper_id NOT IN (SELECT paper_id FROM claims WHERE status <> 'superseded' AND paper_id <> '')"
)
def work_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Papers still to be fetched: those without a claim that holds."""
    cache = _manifest(spark, sf_dir).where("paper_id <> ''").select(
        "paper_id", F.when(F.col("status") == "superseded", "failed").otherwise("ok").alias("status")
    )
    return providers.to_do(_registry(spark, sf_dir).select("paper_id"), cache)


LABEL = """CASE doc_id % 6 WHEN 0 THEN 'FULL TEXT (from a locally supplied text file)' WHEN 1 THEN 'UNKNOWN SOURCE' WHEN 2 THEN 'FULL TEXT (from PubMed Central)'
 WHEN 3 THEN 'ABSTRACT ONLY (full text was not available - treat missing details as ''not explicitly stated'' rather than guessing from an abstract-limited view)' WHEN 4 THEN 'FULL TEXT (extracted from a locally supplied PDF)' ELSE 'other' END"""


@_query(
    f"""SELECT doc_id, concat('<paper_text source="', {LABEL}, '">', chr(10), text, chr(10), '</paper_text>', chr(10), chr(10), '<extraction_instructions>', chr(10), lang, chr(10), '</extraction_instructions>') AS message FROM documents"""
)
def extraction_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["local_txt", "", "pmc_fulltext", "pubmed_abstract", "local_pdf", "other"]
    source = F.get(F.array(*[F.lit(n) for n in names]), (F.col("doc_id") % 6).cast("int"))
    return _docs(spark, sf_dir).select("doc_id", providers.extraction_message("text", source, "lang").alias("message"))


@_query(
    """SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') AS escaped FROM pages"""
)
def html_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", html_escaped("html").alias("escaped"))


_SPACE = r"[\s\x0B\x1C-\x1F\x{85}\p{Z}]+"


@_query(rf"""WITH p AS (SELECT doc_id, list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(regexp_replace(x, '{_SPACE}', ' ', 'g'), ' ')) AS ps FROM documents)
SELECT doc_id, array_to_string(list_prepend('## Part', list_filter(ps, lambda x: x <> '')), chr(10)) AS text FROM p""")
def article_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Body text of articles in XML made of the documents' lines."""
    lines = F.array_join(
        F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.concat(F.lit("<p>"), html_escaped(x), F.lit("</p>"))), ""
    )
    xml = F.concat(F.lit("<article><front/><body><sec><title>Part</title>"), lines, F.lit("</sec></body></article>"))
    return _docs(spark, sf_dir).select("doc_id", xml.alias("xml")).select("doc_id", file_sources.xml_text("xml").alias("text"))


from . import catalog_sinks, catalog_stages  # noqa: E402, F401  these register more queries
