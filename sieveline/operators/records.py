"""Structured extraction results and verdicts: flattening, rendering and lining up against recorded values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip

# Modalities and the registry columns audited under each, in order.
MODALITIES = {
    "anatomical": ["Anatomical connections", "Verification of Zona Incerta Targeting"],
    "photometry": ["Photometry Data"],
    "ephys": ["Electrophysiology Data"],
    "functional": ["Purpose of this circuit", "Necessity vs. sufficiency or Both"],
}
SUMMARY_ONLY = "(summary only - no itemized rows returned)"
NOT_YET = "[not re-extracted yet]"
NO_DATA = "[model returned no data]"
SEVERITY = {"mismatch": 0, "partial": 1, "unverifiable": 2, "match": 3}

EXTRACTION = "struct<rows: array<struct<row_label: string, figure_ref: string, source_quote: string, fields: map<string, string>>>, summary_paragraph: string>"
VERIFICATION = "struct<verdicts: array<struct<field_name: string, verdict: string, confidence: string, explanation: string, evidence_quote: string>>>"


def audited_fields(spark: SparkSession, modalities: list[str] | None = None) -> DataFrame:
    """modality, mod_ord, field_name, field_ord of all modalities, or of those named."""
    unknown = set(modalities or ()) - set(MODALITIES)
    if unknown:
        raise ValueError(f"unknown modalities: {sorted(unknown)}")
    rows = [
        (m, i, f, j) for i, (m, fields) in enumerate(MODALITIES.items()) for j, f in enumerate(fields) if not modalities or m in modalities
    ]
    return spark.createDataFrame(rows, "modality string, mod_ord int, field_name string, field_ord int")


def _or(c: Column | str, other: str = "") -> Column:
    return F.coalesce(c, F.lit(other))


def flatten_extractions(raw: DataFrame) -> DataFrame:
    """paper_id, modality, row_index, row_label, figure_ref, source_quote, fields, summary_paragraph.

    ``raw`` has paper_id, modality and json. A row for each item; a result without items gives one placeholder.
    """
    parsed = raw.select("paper_id", "modality", F.from_json("json", EXTRACTION).alias("r"))
    spread = parsed.select(
        "paper_id",
        "modality",
        strip(_or("r.summary_paragraph")).alias("summary_paragraph"),
        F.posexplode_outer("r.rows").alias("row_index", "item")
    )
    none = F.col("row_index").isNull()
    return spread.select(
        "paper_id", "modality", F.coalesce("row_index", F.lit(0)).alias("row_index"), F.when(none, SUMMARY_ONLY).otherwise(_or("item.row_label")).alias("row_label"), _or("item.figure_ref").alias("figure_ref"),
        _or("item.source_quote").alias("source_quote"), F.coalesce(
            "item.fields", F.create_map().cast("map<string,string>")
        ).alias("fields"), "summary_paragraph",
    )


def flatten_verdicts(raw: DataFrame) -> DataFrame:
    """paper_id, modality, field_name, verdict, confidence, explanation, evidence_quote and ord; no row for no verdicts."""
    # the field's key in the model's answer ends in _field whatever the registry is called
    text = F.regexp_replace("json", r'"[A-Za-z]+_field"(\s*:)', '"field_name"$1')
    spread = raw.select("paper_id", "modality", F.from_json(text, VERIFICATION).alias("r")).select(
        "paper_id", "modality", F.posexplode("r.verdicts").alias("ord", "v")
    )
    return spread.select(
        "paper_id",
        "modality",
        _or("v.field_name").alias("field_name"),
        _or("v.verdict", "unverifiable").alias("verdict"),
        *[_or(f"v.{c}").alias(c) for c in ("confidence", "explanation", "evidence_quote")],
        "ord"
    )


def detail(fields: Column | str) -> Column:
    return F.array_join(
        F.transform(F.map_entries(fields), lambda e: F.concat(e["key"], F.lit(": "), F.coalesce(e["value"], F.lit("None")))), "; "
    )


def rendered(label: Column | str, fields: Column | str) -> Column:
    """"label — key: value; key: value", or whichever part there is."""
    label, body = _or(label), detail(fields)
    return F.when((label != "") & (body != ""), F.concat(label, F.lit(" — "), body)).when(label != "", label).otherwise(body)


def modality_summaries(flat: DataFrame) -> DataFrame:
    """paper_id, modality, summary: a block of text for each pair."""
    item = F.concat(
        F.lit("- "),
        _or("row_label"),
        F.lit(": "),
        detail("fields"),
        F.when(_or("figure_ref") != "", F.concat(F.lit(" ["), "figure_ref", F.lit("]"))).otherwise("")
    )
    line = F.when(F.size("fields") > 0, item)
    grouped = flat.groupBy("paper_id", "modality").agg(
        F.min_by("summary_paragraph", "row_index").alias("head"),
        F.array_sort(F.collect_list(F.when(line.isNotNull(), F.struct("row_index", line.alias("line"))))).alias("items")
    )
    head = strip(_or("head"))
    parts = F.concat(
        F.when(head != "", F.array(F.concat(F.lit("Overall summary: "), head))).otherwise(F.array().cast("array<string>")),
        F.transform("items", lambda i: i["line"])
    )
    return grouped.select(
        "paper_id",
        "modality",
        F.when(F.size(parts) > 0, F.array_join(parts, "\n")).otherwise("(model returned no itemized data)").alias("summary")
    )


def recorded_values(registry: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """paper_id, title, ord, field_name, recorded_value: the audited columns turned into rows; absent ones are empty."""
    wanted = fields or [f for own in MODALITIES.values() for f in own]
    have = [F.coalesce(F.col(f"`{f}`"), F.lit("")).alias(f) if f in registry.columns else F.lit("").alias(f) for f in wanted]
    return registry.select(
        "paper_id", (F.col("title") if "title" in registry.columns else F.col("title_key")).alias("title"), "ord", *have
    ).unpivot(["paper_id", "title", "ord"], [f"`{f}`" for f in wanted], "field_name", "recorded_value")


def side_by_side(registry: DataFrame, flat: DataFrame, audited: DataFrame | None = None) -> DataFrame:
    """What was recorded beside what was found, for every paper, modality and field; see ``ord`` to ``row_index`` for the order.

    For each: the summary, if any, and the items that have fields; a placeholder if there is neither, and another if
    nothing was extracted yet. The rows of a pair are few, so they travel as one array and the join is on the pair.
    """
    audited = audited if audited is not None else audited_fields(registry.sparkSession)
    item = F.struct(
        F.lit(1).alias("kind"),
        "row_index",
        _or("row_label").alias("row_label"),
        rendered("row_label", "fields").alias("found_value"),
        _or("source_quote").alias("source_quote"),
        _or("figure_ref").alias("figure_ref")
    )
    grouped = flat.groupBy("paper_id", "modality").agg(
        strip(_or(F.min_by("summary_paragraph", "row_index"))).alias("head"),
        F.collect_list(F.when(F.size("fields") > 0, item)).alias("items")
    )
    shape = "array<struct<kind: int, row_index: int, row_label: string, found_value: string, source_quote: string, figure_ref: string>>"
    single = lambda kind, label, value: F.array(
        F.struct(
            F.lit(kind).alias("kind"),
            F.lit(0).alias("row_index"),
            F.lit(label).alias("row_label"),
            value.alias("found_value"),
            F.lit("").alias("source_quote"),
            F.lit("").alias("figure_ref")
        )
    ).cast(shape)
    some = F.concat(
        F.when(F.col("head") != "", single(0, "(overall summary)", F.col("head"))).otherwise(F.array().cast(shape)),
        F.col("items").cast(shape)
    )
    rows = F.when(
        F.col("items").isNull(), single(0, "", F.lit(NOT_YET))
    ).when(F.size(some) > 0, some).otherwise(single(0, "", F.lit(NO_DATA)))
    wide = recorded_values(registry).join(audited, "field_name").join(grouped, ["paper_id", "modality"], "left")
    return wide.select("ord", "mod_ord", "field_ord", "paper_id", "title", "modality", "field_name", "recorded_value", F.inline(rows))


def severity(verdict: Column | str, other: int = 99) -> Column:
    known = F.create_map(*[F.lit(x) for pair in SEVERITY.items() for x in pair])
    return F.coalesce(F.try_element_at(known, F.coalesce(verdict, F.lit(""))), F.lit(other))


def triaged(verdicts: DataFrame, *order: Column | str) -> DataFrame:
    """Worst verdicts first; ``order`` breaks ties."""
    return verdicts.orderBy(severity("verdict"), *order)


def with_recorded(verdicts: DataFrame, registry: DataFrame) -> DataFrame:
    """Each verdict with the value it judges, found by paper and column name."""
    values = recorded_values(registry, [c for c in registry.columns if c not in ("ord", "paper_id", "title", "doi")])
    return verdicts.join(
        values.select("paper_id", "title", "field_name", "recorded_value"), ["paper_id", "field_name"], "left"
    ).withColumns({c: F.coalesce(c, F.lit("")) for c in ("title", "recorded_value")})
