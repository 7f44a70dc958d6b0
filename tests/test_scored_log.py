"""The score of a growing log: equal to the full one after each append, and read from the delta."""

import random

import pytest

from sieveline.operators import score
from sieveline.plans.scored_log import ScoredLog

SCHEMA = "paper_id string, field_name string, verdict string, confidence string"


def rows_of(rnd, papers, n):
    kinds, sure = [*score.VERDICTS, "odd", None], ["high", "medium", "low", ""]
    return [(rnd.choice(papers), f"f{rnd.randrange(4)}", rnd.choice(kinds), rnd.choice(sure)) for _ in range(n)]


def test_score_after_each_append(spark, tmp_path, monkeypatch):
    rnd = random.Random(8)
    log = ScoredLog(spark, f"file://{tmp_path}", SCHEMA, "paper_id", "field_name")
    assert log.score().first() == score.reliability(spark.createDataFrame([], SCHEMA)).first()
    state = {}
    for papers in (["a", "b", ""], ["c", "d"], ["a", "c", "e"]):
        rows = rows_of(rnd, papers, 12)
        log.append(spark.createDataFrame(rows, SCHEMA).coalesce(1))
        state |= {r[:2]: r for r in rows}
        full = score.reliability(spark.createDataFrame(list(state.values()), SCHEMA)).first()
        assert log.score().first() == full
    # a run that is lost between both writes
    real = log._followed
    monkeypatch.setattr(log, "_followed", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
    lost = [("b", "f1", "mismatch", "high"), ("z", "f1", "match", "low")]
    with pytest.raises(KeyboardInterrupt):
        log.append(spark.createDataFrame(lost, SCHEMA))
    monkeypatch.setattr(log, "_followed", real)
    state |= {r[:2]: r for r in lost}
    assert log.score().first() == score.reliability(spark.createDataFrame(list(state.values()), SCHEMA)).first()


def test_new_papers_read_the_delta_alone(spark, tmp_path, monkeypatch):
    log = ScoredLog(spark, f"file://{tmp_path}", SCHEMA, "paper_id", "field_name")
    log.append(spark.createDataFrame([("a", "f", "match", "high")], SCHEMA))
    read = []
    real = log.verdicts._read
    monkeypatch.setattr(log.verdicts, "_read", lambda batches: read.append(list(batches)) or real(batches))
    log.append(spark.createDataFrame([("b", "f", "partial", "low")], SCHEMA))
    log.score()
    assert log.verdicts.batches()[0] not in {b for batches in read for b in batches}
