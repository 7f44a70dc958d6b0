"""Reliability of recorded values from verdicts: a confidence-weighted mean drawn to a neutral prior."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

# Points of verdicts, weights of confidences, and the prior's score and strength.
POINTS = {"match": "1.0", "partial": "0.5", "mismatch": "0.0"}
WEIGHTS = {"high": "1.0", "medium": "0.65", "low": "0.35"}
PRIOR_SCORE, PRIOR_STRENGTH = 0.5, 5.0
VERDICTS = ["match", "partial", "mismatch", "unverifiable"]


def _decimal(values: dict[str, str], c: Column | str) -> Column:
    table = F.create_map(*[x for k, v in values.items() for x in (F.lit(k), F.lit(v).cast("decimal(4,2)"))])
    return F.try_element_at(table, F.coalesce(c, F.lit("")))


SUMS = ["n_field_verdicts", "n_scored_verdicts", *[f"n_{v}" for v in VERDICTS], "points", "weight"]


def _sums() -> list[Column]:
    """Counts, and sums of decimals: they can be added up in any order and from any parts."""
    point, weight = _decimal(POINTS, "verdict"), _decimal(WEIGHTS, "confidence")
    scored = point.isNotNull() & weight.isNotNull()
    exact = lambda c: F.coalesce(F.sum(F.when(scored, c)), F.lit(0)).cast("decimal(28,4)")
    return [
        F.count(F.lit(1)).alias("n_field_verdicts"), F.count_if(scored).alias("n_scored_verdicts"),
        *[F.count_if(F.col("verdict") == v).alias(f"n_{v}") for v in VERDICTS], exact(point * weight).alias("points"), exact(weight).alias("weight")
    ]


def paper_sums(verdicts: DataFrame) -> DataFrame:
    """paper_id and what ``from_sums`` needs of each paper's verdicts."""
    return verdicts.groupBy("paper_id").agg(*_sums())


def from_sums(papers: DataFrame) -> DataFrame:
    """The row of ``reliability`` from ``paper_sums``: equal to the last digit, as all that is added up is exact."""
    total = papers.agg(
        F.count_distinct(F.when(F.col("n_field_verdicts") > 0, F.nullif("paper_id", F.lit("")))).alias("n_papers_audited"),
        *[F.coalesce(F.sum(c), F.lit(0)).cast("decimal(28,4)" if c in ("points", "weight") else "long").alias(c) for c in SUMS]
    )
    return _scored(total)


def reliability(verdicts: DataFrame) -> DataFrame:
    """One row: counts, weighted sums, fractions and scores out of ten; raw ones are null without a scored verdict.

    Unverifiable and unknown verdicts, and unknown confidences, count as verdicts but are not scored. Sums are of
    decimals, so they do not depend on the order of rows.
    """
    return _scored(verdicts.agg(F.count_distinct(F.nullif("paper_id", F.lit(""))).alias("n_papers_audited"), *_sums()))


def _scored(sums: DataFrame) -> DataFrame:
    shown = sums.select(
        "n_field_verdicts", "n_scored_verdicts", "n_papers_audited", *[f"n_{v}" for v in VERDICTS],
        F.col("points").cast("double").alias("weighted_points"), F.col("weight").cast("double").alias("weighted_weight")
    )
    raw = F.try_divide("weighted_points", F.nullif("weighted_weight", F.lit(0.0)))
    shrunk = (F.col("weighted_points") + PRIOR_SCORE * PRIOR_STRENGTH) / (F.col("weighted_weight") + PRIOR_STRENGTH)
    return shown.withColumns(
        {"raw_fraction": raw, "shrunk_fraction": shrunk, "raw_score_10": F.bround(raw * 10, 1), "shrunk_score_10": F.bround(shrunk * 10, 1)}
    )


def verdict_counts(verdicts: DataFrame, by: str | None = None) -> DataFrame:
    """The four verdicts counted, zeros included, overall or by a column; unknown verdicts still open a group."""
    counts = [F.count_if(F.col("verdict") == v).alias(v) for v in VERDICTS]
    return verdicts.groupBy(F.coalesce(by, F.lit("unknown")).alias(by)).agg(*counts) if by else verdicts.agg(*counts)


def breakdowns(verdicts: DataFrame, *by: str) -> DataFrame:
    """The counts of ``verdict_counts`` overall and by each column, in one scan: level (a column's name, or all), value, and the four.

    GROUPING SETS: rows go to a set for each column and one for all, and are combined before the shuffle.
    """
    named = verdicts.select("verdict", *[F.coalesce(c, F.lit("unknown")).alias(c) for c in by])
    sets = named.groupingSets([[F.col(c)] for c in by] + [[]], *by)
    counts = sets.agg(*[F.count_if(F.col("verdict") == v).alias(v) for v in VERDICTS], *[F.grouping(c).alias(f"_{c}") for c in by])
    level, value = F.lit("all"), F.lit("")
    for c in by:
        level, value = F.when(F.col(f"_{c}") == 0, c).otherwise(level), F.when(F.col(f"_{c}") == 0, F.col(c)).otherwise(value)
    return counts.select(level.alias("level"), value.alias("value"), *VERDICTS)


def is_provisional(audited: Column, total: Column) -> Column:
    """Under a fifth of the papers audited."""
    return audited < total * 0.2


def breakdown(counts: DataFrame, by: str = "field_name") -> DataFrame:
    """The lines of the report's last part in order: ``by`` and line, for groups with any of the four verdicts."""
    some = F.array_compact(F.array(*[F.when(F.col(v) > 0, F.concat(F.lit(f"{v}="), F.col(v).cast("string"))) for v in VERDICTS]))
    return counts.where(F.size(some) > 0).select(
        by, F.concat(F.lit("  "), by, F.lit(": "), F.array_join(some, ", ")).alias("line")
    ).orderBy(by)


def report(result: Row, fields: list[Row], total_papers: int) -> str:
    """The text report of one result row and the counts by field_name."""
    audited = result["n_papers_audited"]
    out = [
        f"Reliability score: {result['shrunk_score_10']}/10  (raw, unshrunk: {result['raw_score_10']}/10)",
        f"Based on {result['n_scored_verdicts']} scored field-verdicts across {audited}/{total_papers} papers audited "
        f"({result['n_field_verdicts']} total verdicts including unverifiable).",
    ]
    if audited < total_papers * 0.2:
        out.append(
            f"CAUTION: only {audited}/{total_papers} papers have been audited so far - this score is a provisional estimate, "
            "not a corpus-wide reliability figure. It will change, possibly a lot, as more papers are audited."
        )
    out += ["", "Verdict breakdown: " + ", ".join(f"{v}={result[f'n_{v}']}" for v in VERDICTS), "", "By field:"]
    for row in sorted(fields, key=lambda r: r["field_name"]):
        if any(row[v] for v in VERDICTS):
            out.append(f"  {row['field_name']}: " + ", ".join(f"{v}={row[v]}" for v in VERDICTS if row[v]))
    return "\n".join(out)
