"""Inputs that both engines derive from the test tables with the same SQL text.

The tables hold no articles, registry or verdicts, so these are made of whole tables by plain projections. Each
article holds its document's whole text, each extracted row its turn's. {name} stands for a table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("documents", "benchmark", "events", "conversations", "labels")

VERDICTS = """SELECT concat('ST-', CAST(user_id % 71 AS STRING)) AS paper_id,
 CASE WHEN event_type IN ('click', 'view') THEN 'anatomical' WHEN event_type = 'purchase' THEN 'ephys' ELSE 'functional' END AS modality,
 CASE event_type WHEN 'click' THEN 'Anatomical connections' WHEN 'view' THEN 'Verification of Zona Incerta Targeting' WHEN 'purchase' THEN 'Electrophysiology Data' ELSE 'Purpose of this circuit' END AS field_name,
 CASE (event_id + user_id) % 6 WHEN 0 THEN 'match' WHEN 1 THEN 'match' WHEN 2 THEN 'partial' WHEN 3 THEN 'mismatch' WHEN 4 THEN 'unverifiable' ELSE 'odd' END AS verdict,
 CASE user_id % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN 'low' ELSE '' END AS confidence,
 concat('reason ', CAST(event_id AS STRING)) AS explanation, CASE WHEN event_id % 9 = 0 THEN 'Not explicitly stated' ELSE event_type END AS evidence_quote, event_id
 FROM {events}"""

# Parts of articles, in several forms each, chosen by doc_id, so that no field is the same in all.
_TITLE = "concat('A sample study of ', replace(replace(substring(coalesce(text, ''), 1, 60), chr(10), ' '), '@', ' '))"
_FRONT = {
    "journal": "CASE WHEN doc_id % 6 = 1 THEN '' WHEN doc_id % 6 = 2 THEN concat('Proceedings of Things', chr(10)) ELSE concat('Journal of Sample Studies', chr(10)) END",
    "banner": "CASE WHEN doc_id % 5 = 0 THEN concat('ORIGINAL CONTRIBUTION', chr(10)) ELSE '' END",
    "title": f"{_TITLE}, chr(10)",
    "people": "CASE doc_id % 3 WHEN 0 THEN 'Ann Bee, Cy D. Dee and Eff Gee*' WHEN 1 THEN 'Uma V. Wye 1 & Ivo Jay 2' ELSE concat('Department of Things', chr(10), 'Ann Bee, Cy Dee') END, chr(10)",
    "mail": "'mail', CAST(doc_id AS STRING), '@lab.example.org', chr(10)",
    "year": "'Received: 3 May ', CAST(1990 + doc_id % 30 AS STRING), chr(10)",
    "doi": "CASE WHEN doc_id % 4 = 3 THEN 'No identifier' ELSE concat('DOI: 10.1234/doc.', CAST(doc_id AS STRING), '.') END, chr(10)",
    "abstract": "CASE WHEN doc_id % 7 = 3 THEN 'Abstract: ' ELSE concat('Abstract', chr(10)) END, substring(coalesce(text, ''), 1, 200), chr(10)",
    "keywords": "CASE doc_id % 4 WHEN 0 THEN concat('Keywords: alpha, Beta ; gamma.', chr(10)) WHEN 1 THEN concat('Index terms - delta; eps', chr(10)) WHEN 2 THEN concat('KEY WORDS: one', chr(10)) ELSE '' END",
}
_BACK = {
    "introduction": "'1. Introduction', chr(10), substring(coalesce(text, ''), 201), chr(10)",
    "results": "CASE WHEN doc_id % 2 = 0 THEN concat('IV. Results', chr(10), 'Found it.', chr(10)) ELSE concat('2.1 Methods', chr(10), 'Did it.', chr(10), 'Findings', chr(10), 'Found it.', chr(10), 'RESULTS', chr(10), 'And more.', chr(10)) END",
    "references": "CASE doc_id % 4 WHEN 0 THEN concat('References', chr(10), '[1] First paper, 2001.', chr(10), '[2] Second', chr(10), 'paper.') WHEN 1 THEN concat('Bibliography', chr(10), '1. One work of ', CAST(doc_id AS STRING), chr(10), '2. Another work')"
    " WHEN 2 THEN concat('References', chr(10), 'Bee A. A work without numbers', chr(10), 'tiny', chr(10), 'Dee C. Another of them') ELSE '' END",
}
ARTICLES = f"SELECT doc_id, concat({', '.join([*_FRONT.values(), *_BACK.values()])}) AS text FROM {{documents}}"

# What the fields of these articles are, for the oracles.
ARTICLE_PARTS = {
    "title": "trim({title}, ' ')",
    "authors": "CASE doc_id % 3 WHEN 0 THEN 'Ann Bee{sep}Cy D. Dee{sep}Eff Gee' WHEN 1 THEN 'Uma V. Wye{sep}Ivo Jay' ELSE '' END",
    "first_email": "concat('mail', doc_id, '@lab.example.org')",
    "keywords": "CASE doc_id % 4 WHEN 0 THEN 'alpha|Beta|gamma' WHEN 1 THEN 'delta|eps' WHEN 2 THEN 'one' ELSE '' END",
    "doi": "CASE WHEN doc_id % 4 <> 3 THEN concat('10.1234/doc.', doc_id) END",
    "journal": "CASE doc_id % 6 WHEN 1 THEN NULL WHEN 2 THEN 'Proceedings of Things' ELSE 'Journal of Sample Studies' END",
    "publication_year": "CAST(1990 + doc_id % 30 AS VARCHAR)",
    "refs": "CASE doc_id % 4 WHEN 0 THEN '[First paper, 2001.][Second paper.]' WHEN 1 THEN concat('[One work of ', doc_id, '][Another work]') WHEN 2 THEN '[Bee A. A work without numbers][Dee C. Another of them]' ELSE '' END",
    "section_names": "concat(CASE WHEN doc_id % 7 = 3 THEN '' ELSE 'abstract|' END, 'introduction', CASE WHEN doc_id % 2 = 0 THEN '' ELSE '|methods' END, '|results')",
    "results": "CASE WHEN doc_id % 2 = 0 THEN 'Found it.' ELSE concat('Found it.', chr(10), 'And more.') END",
    "abstract": "nullif(trim(substring(coalesce(text, ''), 1, 200), chr(10) || ' '), '')",
}
_BLANK = r"[\s\x0B\x1C-\x1F\x{85}\p{Z}]+"
_BODY = r"regexp_replace(regexp_replace(regexp_replace(%s, '\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]', chr(10), 'g'), '^BLANK', ''), 'BLANK$', '')".replace("BLANK", _BLANK)
# Names and whole bodies of all sections, as one text.
ARTICLE_PARTS["bodies"] = f"""concat(CASE WHEN doc_id % 7 = 3 THEN '' ELSE concat('<abstract>', {_BODY % "substring(coalesce(text, ''), 1, 200)"}) END,
 '<introduction>', {_BODY % "substring(coalesce(text, ''), 201)"}, CASE WHEN doc_id % 2 = 0 THEN '' ELSE '<methods>Did it.' END, '<results>', {ARTICLE_PARTS["results"]})""".replace("{", "{{").replace("}", "}}")


def article_part(name: str, sep: str = "|") -> str:
    """SQL, over documents, of a field of the derived articles."""
    return ARTICLE_PARTS[name].format(title=_TITLE, sep=sep)


REGISTRY = """SELECT doc_id AS ord, concat('ST-', CAST(doc_id AS STRING)) AS paper_id, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE concat('10.1234/doc.', CAST(doc_id AS STRING)) END AS doi,
 concat('Study ', replace(substring(coalesce(text, ''), 1, 60), chr(10), ' ')) AS title, concat('Ann Bee; Cy Dee', CASE WHEN doc_id % 2 = 0 THEN '' ELSE concat('; ', CAST(1990 + doc_id % 30 AS STRING)) END) AS who,
 CASE WHEN doc_id % 2 = 0 THEN source ELSE ' ' END AS anatomical, CASE WHEN doc_id % 5 = 0 THEN lang ELSE '' END AS photometry, CASE WHEN doc_id % 7 = 0 THEN concat(' ', source) ELSE '' END AS ephys, lang AS functional
 FROM {documents}"""

FILES = """SELECT concat('in/', CASE doc_id % 5 WHEN 0 THEN 'st_' WHEN 1 THEN 'ST ' ELSE 'scan' END, CAST(doc_id AS STRING), '.txt') AS file,
 concat(CASE doc_id % 5 WHEN 0 THEN 'st_' WHEN 1 THEN 'ST ' ELSE 'scan' END, CAST(doc_id AS STRING)) AS stem, CASE WHEN doc_id % 11 = 5 THEN ' ' ELSE text END AS text FROM ({articles}) AS a"""

FLAT = """SELECT concat('ST-', CAST(conv_id AS STRING)) AS paper_id, CASE conv_id % 4 WHEN 0 THEN 'anatomical' WHEN 1 THEN 'photometry' WHEN 2 THEN 'ephys' ELSE 'functional' END AS modality,
 CAST(turn AS INT) AS row_index, role AS row_label, CASE WHEN turn % 3 = 0 THEN 'Fig. 1' ELSE '' END AS figure_ref, coalesce(text, '') AS source_quote,
 coalesce(text, '') AS note, turn % 5 <> 4 AND conv_id % 10 <> 9 AS has_fields, CASE WHEN conv_id % 3 = 0 THEN '' ELSE concat('Summary of ', CAST(conv_id AS STRING)) END AS summary_paragraph FROM {conversations}"""


def sql(text: str, **tables: str) -> str:
    """The SQL with tables' names, or other derived inputs, filled in."""
    named = {t: t for t in TABLES} | {"articles": ARTICLES} | tables
    for _ in range(2):
        text = text.format(**named)
    return text


def derived(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """The derived input as a DataFrame; tables stay lazy, so columns are pruned at the scan."""
    text = text.replace("{articles}", ARTICLES)
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if "{" + t + "}" in text}
    return spark.sql(text, **used)
