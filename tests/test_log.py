"""The cache's log: last row wins, versions stay readable, and a lost write changes nothing."""

import pytest
from pyspark.sql import functions as F

from sieveline.operators import score
from sieveline.sources.log import Log, LostRace

SCHEMA = "k string, n int, v string"


def state(log, version=None):
    return {(r.k, r.n): r.v for r in log.state(version).collect()}


def made(spark, folder):
    return Log(spark, f"file://{folder}/log", SCHEMA, "k", "n")


def test_last_row_wins(spark, tmp_path):
    log, rows = made(spark, tmp_path), lambda *r: spark.createDataFrame(list(r), SCHEMA)
    assert state(log) == {} and log.version() == 0
    log.append(rows(("a", 1, "x"), ("a", 2, "y"), (None, None, "z"), ("a", 1, "x2")).coalesce(1))
    log.append(rows(("a", 2, None), ("b", 1, "w")))
    want = {("a", 1): "x2", ("a", 2): None, (None, None): "z", ("b", 1): "w"}
    assert state(log) == want
    assert state(log, 1) == {("a", 1): "x2", ("a", 2): "y", (None, None): "z"}
    assert sorted((r.k, r.n) for r in log.added(1).collect()) == [("a", 2), ("b", 1)]
    assert log.compact() == 3 and len(log.batches()) == 1 and state(log) == want and state(log, 2) == want
    log.append(log.state().where("k = 'b'").withColumn("v", F.lit("of itself")))
    log.vacuum(1)
    assert state(log) == want | {("b", 1): "of itself"} and log.version() == 4
    assert len(list((tmp_path / "log" / "data").iterdir())) == 2 and not (tmp_path / "log" / "drafts").exists()


def test_a_lost_write_leaves_the_old_state(spark, tmp_path, monkeypatch):
    log = made(spark, tmp_path)
    log.append(spark.createDataFrame([("a", 1, "old")], SCHEMA))

    @F.udf("string")
    def broken(k):
        raise ValueError("lost")

    with pytest.raises(Exception, match="lost"):
        log.append(spark.createDataFrame([("a", 1, "new")], SCHEMA).withColumn("v", broken("k")))
    assert state(log) == {("a", 1): "old"}
    real = log._publish

    def crash(number, batches):
        raise KeyboardInterrupt

    monkeypatch.setattr(log, "_publish", crash)  # all data is there, the version is not
    with pytest.raises(KeyboardInterrupt):
        log.append(spark.createDataFrame([("a", 1, "new")], SCHEMA))
    assert state(made(spark, tmp_path)) == {("a", 1): "old"}
    monkeypatch.setattr(log, "_publish", real)
    log.append(spark.createDataFrame([("a", 1, "third")], SCHEMA))
    log.vacuum(1)
    assert state(log) == {("a", 1): "third"} and len(list((tmp_path / "log" / "data").iterdir())) == 2
    with pytest.raises(LostRace):
        log._publish(2, [])


def test_breakdowns_read_once(spark):
    rows = [("P", "m1", "f1", "match"), ("P", "m1", "f2", "partial"), ("Q", "m2", "f1", "odd"), ("Q", None, None, "match")]
    frame = spark.createDataFrame(rows, "paper_id string, modality string, field_name string, verdict string")
    got = {(r.level, r.value): tuple(r)[2:] for r in score.breakdowns(frame, "field_name", "modality").collect()}
    for by in ("field_name", "modality"):
        for r in score.verdict_counts(frame, by).collect():
            assert got.pop((by, r[by])) == tuple(r)[1:]
    assert got == {("all", ""): (2, 1, 0, 0)}
    assert score.breakdowns(frame.limit(0), "modality").collect() == []  # no rows, no levels
