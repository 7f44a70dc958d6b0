"""The overview of papers: rows, tiles, filters, orders and pages."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from ..functions.text import html_escaped, strip
from ..sources.sinks import ranked, write_files
from ..tables import stored
from .pages import FILTER, OVERVIEW, SORT, page
from .records import SEVERITY, severity
from .score import reliability, verdict_counts

# The registry's column names.
TITLE, AUTHORS, DOI_COLUMN, YEAR, ANIMAL = "Title", "Authors", "DOI", "Authors and Publication Year", "Animal Model"
ANATOMICAL, PHOTOMETRY, EPHYS, FUNCTIONAL = "Anatomical connections", "Photometry Data", "Electrophysiology Data", "Purpose of this circuit"
SEARCHED = ["id", "title", "authors", "doi", "anatomical_text", "photometry_text", "ephys_text"]


def last_claims(manifest: DataFrame, ord_column: str = "ord", matched_only: bool = False) -> DataFrame:
    """The last manifest row of each paper, whatever its status unless matched_only."""
    rows = manifest.where("coalesce(paper_id, '') <> ''")
    rows = rows.where("status = 'matched'") if matched_only else rows
    return rows.groupBy("paper_id").agg(
        F.max_by(F.struct("confidence", "match_method"), ord_column).alias("claim")
    ).select("paper_id", "claim.confidence", "claim.match_method")


def paper_rows(registry: DataFrame, claims: DataFrame) -> DataFrame:
    """The 16 columns of the overview, and ord. Columns that the registry lacks are empty."""
    text = lambda name: F.coalesce(F.col(f"`{name}`"), F.lit("")) if name in registry.columns else F.lit("")
    year = strip(F.element_at(F.split(text(YEAR), ";"), -1))
    given = registry.select(
        "ord", "paper_id", text(TITLE).alias("title"), text(AUTHORS).alias("authors"), year.alias("year"), text(DOI_COLUMN).alias("doi"), text(ANIMAL).alias("animal_model"),
        strip(text(ANATOMICAL)).alias("anatomical_text"), strip(text(PHOTOMETRY)).alias("photometry_text"), strip(text(EPHYS)).alias("ephys_text"), strip(text(FUNCTIONAL)).alias("functional_text"),
    )
    joined = given.join(claims.withColumn("there", F.lit(True)), "paper_id", "left")
    flags = [(F.col(f"{kind}_text") != "").alias(f"has_{kind}") for kind in ("anatomical", "photometry", "ephys", "functional")]
    return joined.select(
        "ord",
        F.col("paper_id").alias("id"),
        "title",
        "authors",
        "year",
        "doi",
        "animal_model",
        "anatomical_text",
        "photometry_text",
        "ephys_text",
        *flags,
        F.coalesce("there", F.lit(False)).alias("matched"),
        F.col("confidence").cast("double").alias("confidence"),
        "match_method"
    )


def searched(rows: DataFrame, term: str, columns: list[str] | None = None) -> DataFrame:
    """Rows with the term in one of the columns, whatever the case."""
    if not term:
        return rows
    hit = F.lit(False)
    for c in columns or SEARCHED:
        hit = hit | F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(term.lower()))
    return rows.where(hit)


def with_status(rows: DataFrame, chip: str) -> DataFrame:
    return rows.where("matched") if chip == "matched" else rows.where("NOT matched") if chip == "missing" else rows


def natural_order(c: Column | str) -> list[Column]:
    """AIM-2 before AIM-10: the prefix, then the number behind it."""
    parts = F.split(c, "-")
    return [
        F.get(parts, F.lit(0)),
        F.try_to_number(
            F.nullif(F.regexp_extract(F.coalesce(F.get(parts, F.lit(1)), F.lit("")), r"^\s*(\d+)", 1), F.lit("")), F.lit("999999999999")
        )
    ]


def order_columns(key: str = "id", down: bool = False) -> list[Column]:
    """By natural id, by confidence (none counts as -1), by matched, or by a column's text whatever its case."""
    by = {
        "id": natural_order("id"), "confidence": [F.coalesce("confidence", F.lit(-1.0))], "matched": [F.col("matched")]
    }.get(key, [F.lower(F.col(key).cast("string"))])
    return [c.desc() if down else c.asc() for c in by]


def ordered(rows: DataFrame, key: str = "id", down: bool = False) -> DataFrame:
    return rows.orderBy(*order_columns(key, down), "ord")


def verdict_order(verdict: Column | str, down: bool = False) -> list[Column]:
    """By severity, unknown verdicts behind the known ones (and in front if turned round)."""
    by = severity(verdict, 9)
    return [by.desc() if down else by.asc()]


def triage_filtered(rows: DataFrame, shown: list[str], term: str = "") -> DataFrame:
    """Verdicts of the kinds in ``shown``, with the term in ID, title, field or modality."""
    blob = F.lower(F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in ("paper_id", "title", "field_name", "modality")]))
    return rows.where(F.col("verdict").isin(*shown) & F.contains(blob, F.lit(term.lower())))


def review_order() -> list[Column]:
    """Papers by ID as a text."""
    return [F.col("paper_id").asc()]


def nested(side_by_side: DataFrame) -> DataFrame:
    """paper_id, title and fields: of each paper its fields in order, each with its rows. A paper's rows are few."""
    row = F.struct("mod_ord", "field_ord", "kind", "row_index", "row_label", "found_value", "source_quote", "figure_ref")
    fields = side_by_side.groupBy("paper_id", "mod_ord", "field_ord", "field_name").agg(
        F.min("title").alias("title"), F.min("recorded_value").alias("recorded_value"), F.array_sort(F.collect_list(row)).alias("rows")
    )
    field = F.struct(
        "mod_ord",
        "field_ord",
        "field_name",
        "recorded_value",
        F.transform("rows", lambda r: r.dropFields("mod_ord", "field_ord")).alias("rows")
    )
    papers = fields.groupBy("paper_id").agg(F.min("title").alias("title"), F.array_sort(F.collect_list(field)).alias("fields"))
    return papers.withColumn("fields", F.transform("fields", lambda f: f.dropFields("mod_ord", "field_ord")))


def review_of(side_by_side: DataFrame, papers: DataFrame) -> DataFrame:
    """``nested`` of some papers alone: rows of others go before anything is nested. ``papers`` has paper_id."""
    return nested(side_by_side.join(papers.select("paper_id").distinct(), "paper_id", "left_semi"))


def searchable(columns: list[str]) -> Callable[[], list[Column]]:
    """What an index of ``search.TextIndex`` holds for ``searched`` in these columns."""
    return lambda: [F.col(c) for c in columns]


def review_text() -> list[Column]:
    """What the review is searched in."""
    return [F.concat("paper_id", F.lit(" "), F.coalesce("title", F.lit("")))]


def review_searched(papers: DataFrame, term: str) -> DataFrame:
    """Papers with the term in their ID or title."""
    return papers.where(F.contains(F.lower(F.concat("paper_id", F.lit(" "), F.coalesce("title", F.lit("")))), F.lit(term.lower())))


def verdict_view(verdicts: DataFrame, chip: str = "all", term: str = "") -> DataFrame:
    """Verdicts by severity, unknown ones before none; the quote of nothing stated is not shown."""
    shown = verdicts if chip == "all" else verdicts.where(F.col("verdict") == chip)
    quote = F.when(
        F.lower(strip(F.coalesce("evidence_quote", F.lit("")))) == "not explicitly stated", ""
    ).otherwise(F.coalesce("evidence_quote", F.lit("")))
    return searched(
        shown, term, ["paper_id", "field_name", "explanation", "modality"]
    ).withColumn("shown_quote", quote).orderBy(*verdict_order("verdict"), "paper_id", "field_name")


def doi_label(c: Column | str) -> Column:
    return F.regexp_replace(c, r"^https?://(dx\.)?doi\.org/", "")


def tiles(rows: DataFrame, verdicts: DataFrame) -> DataFrame:
    """One row: papers, matched, missing, audited, mismatches, partials and the scores."""
    papers = rows.agg(
        F.count(F.lit(1)).alias("papers"), F.count_if("matched").alias("matched"), F.count_if(~F.col("matched")).alias("missing")
    )
    score = reliability(verdicts).select(
        F.col("n_papers_audited").alias("audited"),
        F.col("n_mismatch").alias("mismatches"),
        F.col("n_partial").alias("partials"),
        "raw_score_10",
        "shrunk_score_10"
    )
    return papers.join(score)


def embedded(rows: list[Row]) -> str:
    """JSON that is safe inside a script element."""
    return json.dumps([r.asDict(True) for r in rows], ensure_ascii=False).replace("</", "<\\/")


def overview_page(rows: list[Row], verdicts: list[Row], template: str = OVERVIEW) -> str:
    """The template with both tables in place of its two marks; text in the data is never taken for a mark."""
    parts = {"__DATA_JSON__": embedded(rows), "__VERIFICATION_JSON__": embedded(verdicts)}
    out, rest = [], template
    while True:
        at = {rest.find(k): k for k in parts if k in rest}
        if not at:
            return "".join([*out, rest])
        first = min(at)
        out += [rest[:first], parts[at[first]]]
        rest = rest[first + len(at[first]) :]


TRIAGE = ["paper_id", "title", "modality", "field_name", "verdict", "confidence", "recorded_value", "explanation", "evidence_quote"]


def _counted(verdicts: DataFrame) -> str:
    """The page's line of totals."""
    n = verdict_counts(verdicts).first()
    total = verdicts.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("paper_id").alias("papers")).first()
    told = " | ".join(f"{v}: {n[v]}" for v in SEVERITY)
    return f"<p>{total['n']} verdicts on {total['papers']} papers: {told}</p>"


#: Rows of a page, where a table has more than one page should hold.
PAGE_ROWS = 5000


def _tag(name: str, *inside: Column | str) -> Column:
    return F.concat(F.lit(f"<{name}>"), *[F.lit(x) if isinstance(x, str) else x for x in inside], F.lit(f"</{name}>"))


def _paged(rows: DataFrame, html: Column, most: int) -> DataFrame:
    """n (from 1) and html: that of a page's rows, joined in their order. ``rows`` has page and place; a page has ``most`` rows at most."""
    each = rows.select("page", "place", html.alias("html"))
    whole = each.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("place", "html"))).alias("parts"))
    joined = F.array_join(F.transform("parts", lambda p: p["html"]), "")
    return whole.select((F.col("page") + 1).alias("n"), joined.alias("html"))


def _placed(rows: DataFrame, most: int | None, *order: Column | str) -> DataFrame:
    """The rows with place and page; without ``most`` all are on one page, for tables that fit on it."""
    return ranked(rows, *order).withColumn("page", F.floor(F.col("place") / most) if most else F.lit(0).cast("long"))


def _at_least_one(pages: DataFrame) -> DataFrame:
    """An empty table has one page, without rows."""
    first = pages.sparkSession.range(1).select((F.col("id") + 1).alias("n"))
    return first.join(pages, "n", "full").select("n", F.coalesce("html", F.lit("")).alias("html"))


def _around(pages: DataFrame, title: str, before: str, after: str, *scripts: str) -> DataFrame:
    """n and body: each page's rows inside the page that they are on."""
    head, tail = page(title, f"{before}\0{after}", *scripts).split("\0")
    return _at_least_one(pages).select("n", F.concat(F.lit(head), "html", F.lit(tail)).alias("body"))


def _triage(verdicts: DataFrame, most: int | None) -> DataFrame:
    rows = _placed(verdicts, most, severity("verdict"), "paper_id", "field_name", *[F.col(c) for c in TRIAGE if c not in ("paper_id", "field_name")])
    cell = lambda c: html_escaped(F.col(c).cast("string"))
    blob = F.lower(F.concat_ws(" ", *[cell(c) for c in ("paper_id", "title", "field_name", "modality")]))
    row = F.concat(
        F.lit("<tr data-kind='"), cell("verdict"), F.lit("' data-search='"), blob, F.lit("'>"), *[_tag("td", cell(c)) for c in TRIAGE], F.lit("</tr>")
    )
    boxes = "".join(f"<label><input type='checkbox' class='kind' value='{v}' checked> {v}</label> " for v in SEVERITY)
    head = "".join(f"<th>{c}</th>" for c in TRIAGE)
    before = f"{_counted(verdicts)}<input type='search' id='search' placeholder='paper, title, field or modality'><p>{boxes}</p><table><thead><tr>{head}</tr></thead><tbody>"
    return _around(_paged(rows, row, most), "Verification", before, "</tbody></table>", FILTER, SORT)


def triage_page(verdicts: DataFrame) -> str:
    """All verdicts with recorded values on one page, worst first. See ``triage_pages`` for more than a page should hold."""
    return _triage(verdicts, None).first()["body"]


def triage_pages(verdicts: DataFrame, most: int = PAGE_ROWS) -> DataFrame:
    """n and body of pages of ``most`` rows each. Rows are ranked in ranges of their order and rendered where they are."""
    return _triage(verdicts, most)


def _review(side_by_side: DataFrame, most: int | None) -> DataFrame:
    shown = ["title", "field_name", "recorded_value", "row_label", "found_value", "source_quote", "figure_ref"]
    rows = _placed(side_by_side, most, "paper_id", "mod_ord", "field_ord", "kind", "row_index", *shown)
    safe = rows.select("page", "place", *[html_escaped(c).alias(c) for c in ("paper_id", *shown)])
    before = Window.partitionBy("page").orderBy("place")  # a page's rows
    paper, field = (F.lag(c).over(before) for c in ("paper_id", "field_name"))
    told = safe.withColumns({"new_paper": ~paper.eqNullSafe(F.col("paper_id")), "new_field": ~field.eqNullSafe(F.col("field_name")), "first": paper.isNull()})
    some = lambda c, head, tail: F.when(F.col(c) != "", F.concat(F.lit(head), c, F.lit(tail))).otherwise("")
    opened = F.concat(
        F.when(F.col("first"), "").otherwise("</section>"),
        F.lit("<section data-search='"), F.lower(F.concat("paper_id", F.lit(" "), "title")), F.lit("'>"), _tag("h2", F.col("paper_id"), ": ", F.col("title"))
    )
    headed = F.concat(_tag("h3", F.col("field_name")), _tag("p", "Recorded: ", F.col("recorded_value")))
    row = F.concat(
        F.when(F.col("new_paper"), opened).otherwise(""),
        F.when(F.col("new_paper") | F.col("new_field"), headed).otherwise(""),
        F.lit("<p>"), _tag("b", F.col("row_label")), F.lit(" "), F.col("found_value"), some("source_quote", " <q>", "</q>"), some("figure_ref", " [", "]"), F.lit("</p>")
    )
    pages = _paged(told, row, most).withColumn("html", F.concat("html", F.lit("</section>")))
    return _around(pages, "Review", "<input type='search' id='search' placeholder='paper or title'>", "", FILTER)


def review_page(side_by_side: DataFrame) -> str:
    """Papers by ID, their fields in order, and what was found for each beside what was recorded, all on one page."""
    return _review(side_by_side, None).first()["body"]


def review_pages(side_by_side: DataFrame, most: int = PAGE_ROWS) -> DataFrame:
    """n and body of pages of ``most`` rows each; a paper that goes on has its headings again on the next page."""
    return _review(side_by_side, most)


def write_pages(pages: DataFrame, folder: str) -> int:
    """Each page as page-N.html, written by the tasks that rendered it; the number of pages.

    Pages that an earlier, longer run left in the folder are deleted.
    """
    spark = pages.sparkSession
    rows = stored(pages.select(F.format_string("page-%d.html", "n").alias("name"), "body"), "pages")
    write_files(rows, folder, "name", "body")
    n = rows.count()
    path = spark._jvm.org.apache.hadoop.fs.Path
    system = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    left = n + 1
    while system.exists(path(f"{folder}/page-{left}.html")):
        system.delete(path(f"{folder}/page-{left}.html"), False)
        left += 1
    return n
