"""Pages hold every row, whatever their number."""

import re

from pyspark.sql import Row
from pyspark.sql import functions as F

from sieveline.operators import dashboard


def test_every_row_is_on_a_page(spark, tmp_path):
    n = 5003
    key = F.format_string("P%05d", "id")
    text = [F.lit("").alias(c) for c in ("title", "recorded_value")]
    verdicts = spark.range(n).select(
        key.alias("paper_id"),
        *text,
        F.lit("f").alias("field_name"),
        F.lit("ephys").alias("modality"),
        F.lit("match").alias("verdict"),
        *[F.lit("").alias(c) for c in ("confidence", "explanation", "evidence_quote")]
    )
    side = spark.range(n).select(
        key.alias("paper_id"),
        *text,
        F.lit("f").alias("field_name"),
        *[F.lit(0).alias(c) for c in ("mod_ord", "field_ord", "kind", "row_index")],
        *[F.lit("").alias(c) for c in ("row_label", "found_value", "source_quote", "figure_ref")]
    )
    want = [f"P{i:05}" for i in range(n)]
    assert re.findall(
        r"(?:<td>|<h2>)(P\d{5})", dashboard.triage_page(verdicts)
    ) == re.findall(r"(?:<td>|<h2>)(P\d{5})", dashboard.review_page(side)) == want
    for name, pages in (("t", dashboard.triage_pages(verdicts, 2000)), ("r", dashboard.review_pages(side, 2000))):
        (tmp_path / name).mkdir()
        (tmp_path / name / "page-4.html").write_text("left by a longer run")
        assert dashboard.write_pages(pages, f"file://{tmp_path}/{name}") == 3
        parts = [re.findall(r"(?:<td>|<h2>)(P\d{5})", (tmp_path / name / f"page-{k}.html").read_text()) for k in (1, 2, 3)]
        assert sum(parts, []) == want and max(map(len, parts)) == 2000 and not (tmp_path / name / "page-4.html").exists()
    assert dashboard.review_pages(side.limit(0)).count() == 1 and "<td>" not in dashboard.triage_page(verdicts.limit(0))


def test_pages_can_be_searched_and_sorted(spark):
    rows = [
        ("P-1", "A <b> 'title'", "ephys", "F", "mismatch", "high", "rec", "why", "q"),
        ("P-2", "T", "functional", "G", "odd", "low", "r", "w", "")
    ]
    verdicts = spark.createDataFrame(
        rows,
        "paper_id string, title string, modality string, field_name string, verdict string, confidence string, recorded_value string, explanation string, evidence_quote string"
    )
    page = dashboard.triage_page(verdicts)
    assert "data-search='p-1 a &lt;b&gt; &#x27;title&#x27; f ephys'" in page and "data-kind='odd'" in page
    assert "2 verdicts on 2 papers: mismatch: 1 | partial: 0 | unverifiable: 0 | match: 0" in page and page.count("class='kind'") == 4 and "localeCompare" in page
    side = spark.createDataFrame(
        [("P-1", "T & U", 0, 0, "f", "rec", 0, 0, "l", "found", "", "")],
        "paper_id string, title string, mod_ord int, field_ord int, field_name string, recorded_value string, kind int, row_index int, row_label string, found_value string, source_quote string, figure_ref string"
    )
    review = dashboard.review_page(side)
    assert "<section data-search='p-1 t &amp; u'>" in review and review.count("</section>") == 1 and "id='search'" in review
    board = dashboard.overview_page([Row(id="P-1", title="</script>", matched=True)], [Row(paper_id="P-1", verdict="match")])
    assert "__DATA_JSON__" not in board and "__VERIFICATION_JSON__" not in board and board.count("</script>") == 1
    assert '"matched": true' in board and all(
        f'data-chip="{c}"' in board for c in ("all", "matched", "missing", "mismatch", "partial", "unverifiable", "match")
    )


def test_nested_review_and_filters(spark):
    side = spark.createDataFrame([("P-2", "T", 0, 0, "f", "rec", k, i, f"l{k}{i}", "x", "", "") for k, i in ((1, 1), (0, 0), (1, 0))] + [("P-10", "Z", 1, 0, "g", "", 0, 0, "", "y", "", "")],
        "paper_id string, title string, mod_ord int, field_ord int, field_name string, recorded_value string, kind int, row_index int, row_label string, found_value string, source_quote string, figure_ref string")
    papers = dashboard.nested(side).orderBy(*dashboard.review_order()).collect()
    assert [p.paper_id for p in papers] == ["P-10", "P-2"] and [r.row_label for r in papers[1].fields[0].rows] == ["l00", "l10", "l11"]
    assert [r.paper_id for r in dashboard.review_searched(dashboard.nested(side), "z").collect()] == ["P-10"]
