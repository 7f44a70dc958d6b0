"""Registered queries of the audit's stages, orders, filters, sources and sinks, with DuckDB SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import dashboard, records, score
from ..sources import files, providers, sinks, tables
from ..tables import shared_folder
from . import audit, runner
from .catalog import (
    _board,
    _docs,
    _flat,
    _manifest,
    _query,
    _registry,
    BOARD,
    DETAIL,
    FOUR,
    L,
    MANIFEST,
    R_SQL,
    SEVERITY,
    SIDE,
    V,
)
from .inputs import VERDICTS, derived

# ---- choosing work --------------------------------------------------------------------------------------------------

#: A text cache: every eleventh paper has none.
CACHE = """SELECT concat('ST-', doc_id) AS paper_id, CASE WHEN doc_id % 11 = 5 THEN '' ELSE text END AS text, CASE doc_id % 3 WHEN 0 THEN 'local_txt' WHEN 1 THEN 'pmc_fulltext' ELSE '' END AS text_source FROM documents"""
PICKED = ["functional", "ephys"]


def _cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = F.when(F.col("doc_id") % 3 == 0, "local_txt").when(F.col("doc_id") % 3 == 1, "pmc_fulltext").otherwise("")
    text = F.when(F.col("doc_id") % 11 == 5, "").otherwise(F.col("text"))
    return _docs(spark, sf_dir).select(
        F.concat(F.lit("ST-"), F.col("doc_id").cast("string")).alias("paper_id"), text.alias("text"), source.alias("text_source")
    )


@_query(f"WITH r AS ({R_SQL}) SELECT ord, paper_id FROM r ORDER BY ord LIMIT 60")
def first_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The limit is the feature: the first papers in the registry's order."""
    return audit.chosen_papers(_registry(spark, sf_dir), limit=60).select("ord", "paper_id")


@_query(f"WITH r AS ({R_SQL}) SELECT ord, paper_id, title FROM r WHERE paper_id = 'ST-17'")
def one_paper(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.chosen_papers(_registry(spark, sf_dir), "ST-17", 3).select("ord", "paper_id", "title")


PAIRS = f"""r AS ({R_SQL}), c AS ({CACHE}), pairs AS (SELECT paper_id, m.modality, text, text_source FROM r JOIN c USING (paper_id), (VALUES ('ephys'), ('functional')) AS m(modality) WHERE text <> '')"""


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.pairs(_registry(spark, sf_dir), _cache(spark, sf_dir), PICKED)


@_query(f"WITH {PAIRS} SELECT paper_id, modality, text_source, CAST(length(text) AS INTEGER) AS n_chars FROM pairs")
def work_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Papers that have a text, with the modalities asked for."""
    return _pairs(spark, sf_dir).select("paper_id", "modality", "text_source", F.length("text").alias("n_chars"))


LABELLED = "CASE text_source WHEN 'local_txt' THEN 'FULL TEXT (from a locally supplied text file)' WHEN 'pmc_fulltext' THEN 'FULL TEXT (from PubMed Central)' ELSE 'UNKNOWN SOURCE' END"
SUMMARIES = f"""x AS (SELECT paper_id, modality, min_by(summary_paragraph, row_index) AS s, string_agg(CASE WHEN has_fields THEN concat('- ', row_label, ': ', {DETAIL}, CASE WHEN figure_ref <> '' THEN concat(' [', figure_ref, ']') ELSE '' END) END, chr(10) ORDER BY row_index) AS b FROM l GROUP BY ALL),
sums AS (SELECT paper_id, modality, CASE WHEN s = '' AND b IS NULL THEN '(model returned no itemized data)' WHEN s = '' THEN b WHEN b IS NULL THEN concat('Overall summary: ', s) ELSE concat('Overall summary: ', s, chr(10), b) END AS summary FROM x)"""


@_query(f"""WITH {PAIRS}, l AS ({L}), {SUMMARIES}, m AS (SELECT p.paper_id, p.modality, concat('<paper_text source="', {LABELLED}, '">', chr(10), text, chr(10), '</paper_text>', chr(10), chr(10), '<fresh_independent_reextraction>', chr(10),
 coalesce(summary, '(no re-extraction available for this modality)'), chr(10), '</fresh_independent_reextraction>', chr(10), chr(10), '<recorded_values>', chr(10), CASE modality WHEN 'ephys' THEN concat('Electrophysiology Data: "', coalesce(ephys, ''), '"')
 ELSE concat('Purpose of this circuit: "', coalesce(functional, ''), '"', chr(10), 'Necessity vs. sufficiency or Both: ""') END, chr(10), '</recorded_values>') AS message FROM pairs AS p JOIN r USING (paper_id) LEFT JOIN sums USING (paper_id, modality))
SELECT paper_id, modality, md5(message) AS digest, CAST(length(message) AS INTEGER) AS n_chars FROM m""")
def verification_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = audit.verification_messages(_pairs(spark, sf_dir), _registry(spark, sf_dir), _flat(spark, sf_dir))
    return made.select("paper_id", "modality", F.md5("message").alias("digest"), F.length("message").alias("n_chars"))


@_query(r"SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\s\x0B\x1C-\x1F\x{85}\p{Z}]+')) >= 200 AS kept FROM documents")
def full_text_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a fetched full text is long enough to be taken."""
    return _docs(spark, sf_dir).select("doc_id", providers.long_enough("text").alias("kept"))


@_query(f"""WITH {MANIFEST} SELECT file AS source_file, paper_id, coalesce(r.doi, '') AS doi, CASE WHEN file LIKE '%.pdf' THEN 'local_pdf' ELSE 'local_txt' END AS text_source, 'ok' AS status, match_method, CAST(confidence AS DOUBLE) AS match_confidence, md5(text) AS digest, true AS stamped
 FROM claims JOIN f USING (file) LEFT JOIN r USING (paper_id) WHERE status = 'matched'""")
def local_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cache rows of files that were matched."""
    from .catalog import FILES

    texts = derived(spark, sf_dir, FILES).withColumn("suffix", F.lit("txt"))
    rows = providers.local_cache(texts, _manifest(spark, sf_dir), _registry(spark, sf_dir))
    return rows.select(
        "source_file",
        "paper_id",
        F.coalesce("doi", F.lit("")).alias("doi"),
        "text_source",
        "status",
        "match_method",
        F.col("match_confidence").cast("double").alias("match_confidence"),
        F.md5("text").alias("digest"),
        F.rlike("fetched_at", F.lit(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\.\d{3}(Z|[+-]\d\d:\d\d)$")).alias("stamped"),
    )


@_query(
    f"""WITH c AS ({CACHE}) SELECT (SELECT count(*) FROM c WHERE text <> '') AS cached, (SELECT count(*) FROM ({L}) AS l) AS extracted, (SELECT count(*) FROM {V}) AS verified"""
)
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runner.status_counts(_cache(spark, sf_dir), _flat(spark, sf_dir), derived(spark, sf_dir, VERDICTS))


# ---- pages and orders -----------------------------------------------------------------------------------------------


@_query(f"""WITH {SIDE}, f AS (SELECT paper_id, min(title) AS title, mod_ord, field_ord, min(field_name) AS field_name, min(recorded_value) AS recorded_value, CAST(count(*) AS INTEGER) AS n_rows, md5(string_agg(concat(row_label, '=', found_value), '|' ORDER BY kind, row_index)) AS digest FROM rows GROUP BY paper_id, mod_ord, field_ord)
SELECT paper_id, title, field_name, recorded_value, CAST(row_number() OVER (PARTITION BY paper_id ORDER BY mod_ord, field_ord) - 1 AS INTEGER) AS place, n_rows, digest FROM f""")
def review_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The review's nested groups: papers, their fields in order, and each field's rows."""
    nested = dashboard.nested(records.side_by_side(_registry(spark, sf_dir), _flat(spark, sf_dir)))
    spread = nested.select("paper_id", "title", F.posexplode("fields").alias("place", "f"))
    told = F.array_join(F.transform("f.rows", lambda r: F.concat(r["row_label"], F.lit("="), r["found_value"])), "|")
    return spread.select(
        "paper_id", "title", "f.field_name", "f.recorded_value", "place", F.size("f.rows").alias("n_rows"), F.md5(told).alias("digest")
    )


@_query(
    f"WITH {SIDE} SELECT DISTINCT paper_id FROM rows WHERE contains(lower(concat(paper_id, ' ', title)), 'st-1') OR contains(lower(concat(paper_id, ' ', title)), 'study t')"
)
def review_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Papers whose ID or title has either of two terms."""
    nested = dashboard.nested(records.side_by_side(_registry(spark, sf_dir), _flat(spark, sf_dir)))
    return dashboard.review_searched(nested, "ST-1").select("paper_id").union(
        dashboard.review_searched(nested, "Study T").select("paper_id")
    ).distinct()


RECORDED = f"""r AS ({R_SQL}), j AS (SELECT v.*, coalesce(title, '') AS title FROM {V} LEFT JOIN r ON r.paper_id = v.paper_id AND v.field_name <> 'Verification of Zona Incerta Targeting')"""


@_query(
    f"WITH {RECORDED} SELECT event_id FROM j WHERE verdict IN ('partial', 'unverifiable') AND contains(lower(concat(paper_id, ' ', title, ' ', field_name, ' ', modality)), 'ephys')"
)
def triage_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of the kinds that are ticked, with the term in what is searched."""
    rows = records.with_recorded(derived(spark, sf_dir, VERDICTS), _registry(spark, sf_dir))
    return dashboard.triage_filtered(rows, ["partial", "unverifiable"], "EPHYS").select("event_id")


OTHER = "CASE verdict WHEN 'mismatch' THEN 0 WHEN 'partial' THEN 1 WHEN 'unverifiable' THEN 2 WHEN 'match' THEN 3 ELSE 9 END"


@_query(f"SELECT event_id, row_number() OVER (PARTITION BY paper_id ORDER BY {OTHER} DESC, event_id) AS place FROM {V}")
def verdict_order_down(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dashboard's order by verdict, turned round: unknown verdicts first."""
    rows = derived(spark, sf_dir, VERDICTS)
    rows = rows.select("paper_id", "verdict", "event_id")
    return sinks.places(rows, "paper_id", *dashboard.verdict_order("verdict", True), "event_id").select("event_id", "place")


def _places(rows: DataFrame, key: str, down: bool) -> DataFrame:
    narrow = rows.select("year", *dict.fromkeys((key, "ord", "id")))
    return sinks.places(narrow, "year", *dashboard.order_columns(key, down), "ord").select("id", "place")


@_query(f"WITH {BOARD} SELECT id, row_number() OVER (PARTITION BY year ORDER BY coalesce(confidence, -1) DESC, ord) AS place FROM board")
def confidence_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _places(_board(spark, sf_dir), "confidence", True)


@_query(f"WITH {BOARD} SELECT id, row_number() OVER (PARTITION BY year ORDER BY matched, ord) AS place FROM board")
def matched_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _places(_board(spark, sf_dir), "matched", False)


@_query(f"WITH {BOARD} SELECT id, row_number() OVER (PARTITION BY year ORDER BY lower(title) DESC, ord) AS place FROM board")
def cell_text_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order of a click on a column: by the cells' text, whatever its case."""
    return _places(_board(spark, sf_dir), "title", True)


@_query(
    f"WITH {SIDE} SELECT paper_id, dense_rank() OVER (PARTITION BY modality, field_name ORDER BY paper_id) AS place FROM (SELECT DISTINCT paper_id, modality, field_name FROM rows WHERE field_name = 'Photometry Data') AS x"
)
def string_id_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Papers by ID as a text, so that ST-10 comes before ST-2."""
    rows = records.side_by_side(
        _registry(spark, sf_dir), _flat(spark, sf_dir)
    ).where("field_name = 'Photometry Data'").select("paper_id", "modality", "field_name").distinct()
    # papers differ within a modality, so their ranks have no ties
    return sinks.places(rows.select("modality", "paper_id"), "modality", *dashboard.review_order()).select("paper_id", "place")


@_query("SELECT doc_id, concat('10.1/', doc_id) AS label FROM documents")
def doi_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a DOI link shows: no resolver's address."""
    heads = F.get(F.array(F.lit("https://doi.org/"), F.lit("http://dx.doi.org/"), F.lit("")), (F.col("doc_id") % 3).cast("int"))
    return _docs(spark, sf_dir).select(
        "doc_id", dashboard.doi_label(F.concat(heads, F.lit("10.1/"), F.col("doc_id").cast("string"))).alias("label")
    )


@_query(f"""WITH c AS (SELECT field_name, {FOUR.replace('{}', '')} FROM {V} GROUP BY field_name) SELECT field_name, concat('  ', field_name, ': ', concat_ws(', ', CASE WHEN match > 0 THEN concat('match=', match) END,
 CASE WHEN partial > 0 THEN concat('partial=', partial) END, CASE WHEN mismatch > 0 THEN concat('mismatch=', mismatch) END, CASE WHEN unverifiable > 0 THEN concat('unverifiable=', unverifiable) END)) AS line FROM c WHERE match + partial + mismatch + unverifiable > 0""")
def report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.breakdown(score.verdict_counts(derived(spark, sf_dir, VERDICTS), "field_name"))


# ---- sinks and sources, there and back ------------------------------------------------------------------------------


def _folder(spark: SparkSession, name: str) -> str:
    import uuid

    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@_query(
    """SELECT doc_id, place, concat('AIM-', doc_id) AS paper_id, CASE WHEN doc_id % 3 > 0 THEN concat('10.1/', doc_id) END AS doi, trim(text, ' ' || chr(9) || chr(10)) AS title
 FROM (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS place FROM documents) AS d WHERE doc_id % 9 <> 4"""
)
def registry_from_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registry written as CSV files in order, titles of many lines and quotes included, and read again in that order; rows without an ID are left out."""
    doc = F.col("doc_id").cast("string")
    wide = _docs(spark, sf_dir).select(
        F.when(F.col("doc_id") % 9 == 4, " ").otherwise(F.concat(F.lit(" AIM-"), doc)).alias(tables.ID_COLUMN),
        F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.concat(F.lit("https://doi.org/10.1/"), doc)).alias(tables.DOI_COLUMN),
        F.col("text").alias(tables.TITLE_COLUMN),
        "doc_id",
    )
    path = _folder(spark, "registry")
    sinks.write_ordered_csv(wide, path, "doc_id")
    back = tables.read_registry(spark, path)
    return back.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("ord").alias("place"),
        "paper_id",
        F.col("doi_key").alias("doi"),
        F.col("title_key").alias("title")
    )


def _placed(columns: str, rows: str, order: str) -> str:
    """SQL of the rows with their place in a written table."""
    return f"SELECT {columns}, row_number() OVER (ORDER BY {order}) - 1 AS place FROM {rows}"


@_query(
    _placed(
        f"paper_id, modality, row_index, row_label, figure_ref, source_quote, {DETAIL} AS detail, summary_paragraph",
        f"({L}) AS l",
        "paper_id, modality, row_index"
    )
)
def flat_from_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark, "flat")
    tables.write_flat(_flat(spark, sf_dir), path)
    places = tables.read_ordered_csv(spark, path).select("paper_id", "modality", F.col("row_index").cast("int").alias("row_index"), "place")
    return tables.read_flat(spark, path).join(places, ["paper_id", "modality", "row_index"]).select(
        "paper_id",
        "modality",
        "row_index",
        "row_label",
        "figure_ref",
        "source_quote",
        records.detail("fields").alias("detail"),
        "summary_paragraph",
        "place"
    )


@_query(
    _placed(
        "paper_id, modality, field_name, verdict, confidence, explanation, evidence_quote",
        V,
        f"{SEVERITY}, paper_id, modality, field_name, explanation"
    )
)
def verdicts_from_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts in files, worst first, and the order in which they are read again."""
    path = _folder(spark, "verdicts")
    tables.write_verdicts(derived(spark, sf_dir, VERDICTS), path)
    return tables.read_ordered_csv(spark, path)


@_query(
    f"WITH {MANIFEST} " + _placed("file, paper_id, match_method, CAST(confidence AS DOUBLE) AS confidence, status", "claims", "string_split(file, '/')")
)
def manifest_from_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark, "manifest")
    tables.write_scrape_manifest(_manifest(spark, sf_dir), path)
    return tables.read_ordered_csv(spark, path).withColumn("confidence", F.col("confidence").cast("double"))


@_query(
    f"WITH c AS ({CACHE}) " + _placed(
        "paper_id, '10.1/x' AS doi, '' AS pmid, 'PMC1' AS pmcid, text_source, CASE WHEN text = '' THEN 'failed' ELSE 'ok' END AS status, '2026-01-01T00:00:00' AS fetched_at, "
        "CASE WHEN text = '' THEN concat('a \"quoted\", broken', chr(10), 'reason') ELSE '' END AS error",
        "c",
        "paper_id"
    )
)
def fetch_manifest_from_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = F.col("text") == ""
    none = F.lit(None).cast("string")
    rows = _cache(spark, sf_dir).select(
        "paper_id",
        F.lit("10.1/x").alias("doi"),
        none.alias("pmid"),
        F.lit("PMC1").alias("pmcid"),
        "text_source",
        F.when(failed, "failed").otherwise("ok").alias("status"),
        F.lit("2026-01-01T00:00:00").alias("fetched_at"),
        F.when(failed, 'a "quoted", broken\nreason').alias("error")
    )
    path = _folder(spark, "fetched")
    tables.write_fetch_manifest(rows, path)
    return tables.read_ordered_csv(spark, path)


@_query(
    f"WITH {SIDE} " + _placed(
        "paper_id, title, modality, field_name, row_label, recorded_value, found_value AS reextracted_value, source_quote, figure_ref",
        "rows",
        "ord, mod_ord, field_ord, kind, row_index"
    )
)
def side_by_side_from_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark, "side")
    tables.write_side_by_side(records.side_by_side(_registry(spark, sf_dir), _flat(spark, sf_dir)), path)
    return tables.read_ordered_csv(spark, path)


_SAFE = """replace(replace(replace(replace(replace(CAST(coalesce({}, '') AS VARCHAR), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), chr(39), '&#x27;')"""
_CELLS = ", ".join(f"'<td>', {_SAFE.format(c)}, '</td>'" for c in dashboard.TRIAGE)
_BLOB = f"lower(concat_ws(' ', {', '.join(_SAFE.format(c) for c in ('paper_id', 'title', 'field_name', 'modality'))}))"
_TRIAGE_ORDER = ", ".join([SEVERITY, "paper_id", "field_name", *[c for c in dashboard.TRIAGE if c not in ("paper_id", "field_name")]])


@_query(
    f"""WITH {RECORDED}, t AS (SELECT j.* EXCLUDE (title), j.title AS title, coalesce(CASE j.field_name WHEN 'Anatomical connections' THEN anatomical WHEN 'Electrophysiology Data' THEN ephys WHEN 'Purpose of this circuit' THEN functional END, '') AS recorded_value
 FROM j LEFT JOIN r ON r.paper_id = j.paper_id AND j.field_name <> 'Verification of Zona Incerta Targeting'),
p AS (SELECT *, row_number() OVER (ORDER BY {_TRIAGE_ORDER}) - 1 AS place FROM t),
h AS (SELECT place, concat('<tr data-kind=''', {_SAFE.format('verdict')}, ''' data-search=''', {_BLOB}, '''>', {_CELLS}, '</tr>') AS html FROM p)
SELECT place // 300 + 1 AS n, count(*) AS n_rows, md5(string_agg(html, '' ORDER BY place)) AS digest FROM h GROUP BY 1"""
)
def triage_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of each page of the verdicts, rendered in tasks and numbered by prefix sums."""
    rows = records.with_recorded(derived(spark, sf_dir, VERDICTS), _registry(spark, sf_dir))
    inside = F.regexp_extract("body", r"(?s)<tbody>(.*)</tbody>", 1)
    return dashboard.triage_pages(rows, 300).select(
        "n", (F.size(F.split(inside, "<tr data-kind=")) - 1).cast("long").alias("n_rows"), F.md5(inside).alias("digest")
    )


@_query(f"WITH {RECORDED} " + _placed("event_id", "j", f"{SEVERITY}, paper_id, j.field_name, event_id"))
def triage_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of each verdict among all, worst first: ranges of the order, ranked without one task for all."""
    rows = records.with_recorded(derived(spark, sf_dir, VERDICTS), _registry(spark, sf_dir))
    return sinks.ranked(rows, records.severity("verdict"), "paper_id", "field_name", "event_id").select("event_id", "place")


@_query(
    "SELECT concat('item-', item_id) AS key, text, CAST(length(text) AS INTEGER) AS n_chars, false AS malformed FROM benchmark UNION ALL SELECT 'odd', NULL, -1, true"
)
def json_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indented JSON files, one for each key, and one that is no JSON."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    path = _folder(spark, "keyed")
    rows = items.select(F.concat(F.lit("item-"), F.col("item_id").cast("string")).alias("key"), "text", F.length("text").alias("n_chars"))
    tables.write_json_by_key(rows, path, "key")
    odd = spark.range(1).select(F.lit("odd.json").alias("name"), F.lit("{not json").alias("body"))
    sinks.write_files(odd, path, "name", "body")
    back = tables.read_json_by_key(spark, path, "text string, n_chars int")
    return back.select(
        "key", "value.text", F.coalesce("value.n_chars", F.lit(-1)).alias("n_chars"), F.col("value.text").isNull().alias("malformed")
    )


@_query(
    r"""SELECT concat('item ', item_id) AS stem, CASE item_id % 3 WHEN 0 THEN 'md' ELSE 'txt' END AS suffix, CASE WHEN item_id % 5 = 0 THEN '' ELSE concat(text, chr(10), 'é', chr(10)) END AS text FROM benchmark"""
)
def loaded_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text files in folders, some without any content, beside a readme and a file of another kind."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").withColumn("id", F.col("item_id").cast("string"))
    name = F.concat(
        F.when(F.col("item_id") % 2 == 0, "sub folder/").otherwise(""),
        F.lit("item "),
        "id",
        F.when(F.col("item_id") % 3 == 0, ".MD").otherwise(".txt")
    )
    body = F.when(F.col("item_id") % 5 == 0, "").otherwise(F.concat("text", F.lit("\r\né\r")))
    path = _folder(spark, "articles")
    sinks.write_files(items.select(name.alias("name"), body.alias("body")), path, "name", "body")
    others = spark.createDataFrame([("README.md", "no"), ("notes.doc", "no"), ("sub folder/readme.txt", "no")], "name string, body string")
    sinks.write_files(others, path, "name", "body")
    return files.load_texts(spark, path, skip_readme=True).select("stem", "suffix", "text")


@_query(f"""WITH {MANIFEST} SELECT file, row_number() OVER (PARTITION BY status ORDER BY string_split(file, '/')) AS place FROM claims""")
def path_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files by the parts of their paths."""
    return sinks.places(_manifest(spark, sf_dir).select("file", "status"), "status", F.split("file", "/")).select("file", "place")
