"""The derived inputs hold whole texts: nothing of a long document or turn is cut off before an operator sees it."""

from sieveline.plans import catalog

LONG = " ".join(f"word{i}" for i in range(400)) + " last@behind.example end"


def test_long_texts_reach_the_operators(spark, tmp_path):
    spark.createDataFrame(
        [(1, LONG, "en", "s")], "doc_id long, text string, lang string, source string"
    ).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(
        [(1, 0, "user", LONG)], "conv_id long, turn long, role string, text string"
    ).write.parquet(str(tmp_path / "conversations.parquet"))
    text = catalog.derived(spark, str(tmp_path), catalog.ARTICLES).first().text
    assert text.replace("\nIndex terms - delta; eps\n1. Introduction\n", "").count(LONG) == 1
    assert catalog.article_summary(spark, str(tmp_path)).first().word_count > 400
    assert "last@behind.example" in catalog.article.parse_articles(
        catalog.derived(spark, str(tmp_path), catalog.ARTICLES), source_file="doc_id"
    ).first().emails
    row = catalog.flatten_extractions(spark, str(tmp_path)).where("paper_id = 'ST-1'").first()
    assert row.source_quote == LONG and f"note: {LONG}" in row.detail
    assert LONG in catalog.modality_summaries(spark, str(tmp_path)).first().summary
