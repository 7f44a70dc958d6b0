"""Order over several files, and files that executors write whole or not at all."""

import os
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from sieveline.plans import catalog
from sieveline.sources import sinks, tables


def test_ranked_equals_sorting(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice("abc"), rnd.choice([None, 1, 2, 3]), i) for i in range(5000)]
    frame = spark.createDataFrame(rows, "a string, b int, i int").repartition(7)
    got = sinks.ranked(frame, "a", F.desc("b"), "i")
    assert "SinglePartition" not in got._jdf.queryExecution().executedPlan().toString()
    want = sorted(rows, key=lambda r: (r[0], -(r[1] or 0), r[2]))
    assert [tuple(r)[:3] for r in sorted(got.collect(), key=lambda r: r.place)] == want
    assert sorted(r.place for r in got.select("place").collect()) == list(range(5000))
    assert sinks.ranked(frame.limit(0), "a").collect() == []


def test_places_equal_row_numbers(spark):
    rnd = random.Random(4)
    rows = [(rnd.choice(["a", "a", "a", "b", None]), rnd.choice([None, 1, 2, 3]), i) for i in range(4000)]
    frame = spark.createDataFrame(rows, "a string, b int, i int").repartition(5)
    want = []
    for value in ("a", "b", None):
        own = sorted((r for r in rows if r[0] == value), key=lambda r: (-(r[1] or 0), r[2]))
        want += [(*r, n) for n, r in enumerate(own, 1)]
    got = sinks.places(frame, "a", F.desc("b"), "i")
    assert {tuple(r) for r in got.collect()} == set(want) and got.count() == 4000
    assert sinks.places(frame.limit(0), "a", "i").collect() == []
    assert got.schema["place"].dataType.simpleString() == "bigint"


def test_order_of_papers_is_not_one_task(spark):
    """Half of all papers have one year; no task may sort them all."""
    rows = [(i, f"ST-{i}", "x" if i % 2 else str(i % 30), None if i % 3 else i % 5 / 5, i % 4 > 0, f"T {i % 9}") for i in range(3000)]
    board = spark.createDataFrame(rows, "ord long, id string, year string, confidence double, matched boolean, title string").repartition(4)
    keys = {
        "confidence": (True, lambda r: (-(-1 if r[3] is None else r[3]), r[0])),
        "matched": (False, lambda r: (r[4], r[0])),
        "title": (False, lambda r: (r[5], r[0]))
    }
    for key, (down, order) in keys.items():
        got = catalog.catalog_stages._places(board, key, down)
        assert "Window" not in got._jdf.queryExecution().executedPlan().toString()
        want = set()
        for year in {r[2] for r in rows}:
            want |= {(r[1], n) for n, r in enumerate(sorted((r for r in rows if r[2] == year), key=order), 1)}
        assert {tuple(r) for r in got.collect()} == want


def test_ordered_csv_in_several_files(spark, tmp_path):
    rows = [(i, f'line "{i}",\nand more \\ ' if i % 3 else "") for i in range(3000)]
    frame = spark.createDataFrame(rows, "i int, text string").repartition(5)
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else so few rows go to one file
    try:
        sinks.write_ordered_csv(frame, f"{tmp_path}/out", F.desc("i"))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert len(list((tmp_path / "out").glob("part-*.csv"))) == 3
    back = tables.read_ordered_csv(spark, f"{tmp_path}/out").collect()
    assert {(2999 - r.place, r.text) for r in back} == set(rows)


def test_registry_of_several_files(spark, tmp_path):
    """Files follow one another by name, whatever their sizes."""
    (tmp_path / "a.csv").write_text('"Reference ID","DOI","Title"\n' + "".join(f'"A-{i}","","t\n{i}"\n' for i in range(200)))
    (tmp_path / "b.csv").write_text('"Reference ID","DOI","Title"\n"A-1","","again"\n" ","","none"\n')
    (tmp_path / "c.csv").write_text('"Reference ID","DOI","Title"\n"C","",""\n')
    got = sorted((r.ord, r.paper_id) for r in tables.read_registry(spark, str(tmp_path)).collect())
    assert got == [(i, f"A-{i}") for i in range(200)] + [(200, "A-1"), (202, "C")]


def files_in(folder):
    return sorted(os.path.relpath(os.path.join(d, f), folder) for d, _, names in os.walk(folder) for f in names)


def test_files_are_written_by_tasks(spark, tmp_path):
    rows = spark.range(200).select(
        F.format_string("sub %d/n%03d.txt", F.col("id") % 3, F.col("id") % 150).alias("name"), F.repeat(F.col("id").cast("string"), 50).alias("body"), "id"
    )
    sinks.write_files(rows.repartition(6), f"file://{tmp_path}", "name", "body", "id")
    assert len(files_in(tmp_path)) == 150 and not any("_staging" in f for f in files_in(tmp_path))
    for k in range(150):
        last = k + 150 if k < 50 else k
        assert (tmp_path / f"sub {k % 3}" / f"n{k:03}.txt").read_text() == str(last) * 50
    odd = spark.createDataFrame([(None, "x"), ("empty", None), ("ü.txt", "é")], "name string, body string")
    sinks.write_files(odd, f"file://{tmp_path}/odd", "name", "body")
    assert files_in(tmp_path / "odd") == ["empty", "ü.txt"] and (tmp_path / "odd" / "ü.txt").read_text() == "é"
    sinks.write_files(odd.limit(0), f"file://{tmp_path}/none", "name", "body")
    assert files_in(tmp_path / "none") == [] and (tmp_path / "none").is_dir()


def test_a_failed_task_leaves_no_half_file(spark, tmp_path):
    @F.udf("string")
    def broken(i):
        if i == 77:
            raise ValueError("lost")
        return "x" * 1000

    rows = spark.range(100).select(F.col("id").cast("string").alias("name"), broken("id").alias("body"))
    (tmp_path / "5").write_text("as it was")
    with pytest.raises(PySparkException):
        sinks.write_files(rows, f"file://{tmp_path}", "name", "body")
    left = files_in(tmp_path)
    assert "77" not in left and not any("_staging" in f for f in left)
    assert all((tmp_path / f).read_text() in ("x" * 1000, "as it was") for f in left)


def test_stores_of_other_schemes():
    from pyarrow import fs

    known = sinks.Store("s3a://bucket/some folder", (("access_key", "k"), ("secret_key", "s"), ("region", "eu-west-1")))
    system, place = known.opened()
    assert isinstance(system, fs.S3FileSystem) and place == "bucket/some folder"
    assert sinks.Store("file:/tmp/a b").opened()[1] == "/tmp/a b" == sinks.Store("file:///tmp/a b").opened()[1]
