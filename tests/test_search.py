"""The trigram index: it finds what a scan finds, and reads few rows for it."""

import random

from pyspark.sql import functions as F

from sieveline.operators import dashboard, search


def test_search_equals_scan(spark, tmp_path):
    rnd = random.Random(4)
    words = ["alpha", "Beta", "gam", "ÉTÉ", "a b", "", "x", "St-1", "tstx", "the", "𝒳yz"]
    rows = [(i, None if rnd.random() < 0.1 else " ".join(rnd.choices(words, k=rnd.randint(0, 6))), rnd.choice(words)) for i in range(600)]
    frame = spark.createDataFrame(rows, "i int, a string, b string")
    index = search.TextIndex.build(frame, dashboard.searchable(["a", "b"]), f"file://{tmp_path}")
    for term in ("alph", "BETA", "été", "a b", "x", "", "st-1 x", "none of it", "𝒳yz", "ma a"):
        got = sorted(r.i for r in index.search(term).collect())
        want = sorted(r.i for r in dashboard.searched(frame, term, ["a", "b"]).collect())
        assert got == want, term
        assert index.search(term).columns == ["i", "a", "b"]


def test_few_rows_are_read(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(search, "PART_ROWS", 256)
    frame = spark.range(20_000).select("id", F.concat(F.lit("common words for all "), F.when(F.col("id") % 5000 == 7, F.concat(F.lit("needle "), "id"))
                                                        .otherwise("hay")).alias("text")).coalesce(1)
    index = search.TextIndex.build(frame, dashboard.searchable(["text"]), f"file://{tmp_path}")
    assert index.candidates("needle").count() == 4 == index.search("Needle").count()
    read = index.read("needle")
    parts = {r["_part"] for r in index.candidates("needle").select("_part").collect()}
    assert len(parts) == 4 and read.count() == 4
    scans = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in scans and "_part" in scans.split("PartitionFilters")[1]
    assert index.rows().where(F.col("_part").isin(*parts)).count() <= 4 * 256
    assert "PushedFilters: [In(gram" in index.candidates("needle")._jdf.queryExecution().executedPlan().toString()


def test_trigrams_take_one_scan_of_a_text(spark):
    """Whatever the letters, and without arrays of them."""
    texts = ["", "ab", "abc", "ABCabc", "a\nb\nc", "éÉx", "𝒳yz𝒳", None, "aaaaa"]
    frame = spark.createDataFrame([(t,) for t in texts], "t string").select("t", search.trigrams("t").alias("g"))
    for r in frame.collect():
        low = (r.t or "").lower()
        assert {low[i : i + 3] for i in range(len(low) - 2)} <= set(r.g) and len(r.g) == len(set(r.g))
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "split" not in plan and "zip_with" not in plan and plan.count("regexp_extract_all") == 1


def test_only_papers_found_are_nested(spark):
    side = spark.createDataFrame([(p, "T", 0, 0, "f", "rec", 1, i, f"l{i}", "x", "", "") for p in ("P-1", "P-2") for i in range(3)],
        "paper_id string, title string, mod_ord int, field_ord int, field_name string, recorded_value string, kind int, row_index int, row_label string, found_value string, source_quote string, figure_ref string")
    got = dashboard.review_of(side, spark.createDataFrame([("P-2",)], "paper_id string")).collect()
    assert [(p.paper_id, len(p.fields[0].rows)) for p in got] == [("P-2", 3)]
