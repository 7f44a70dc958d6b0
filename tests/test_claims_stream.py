"""Arriving files: the log of changed claims ends with the rows that settling all of them at once gives."""

import random
import uuid

from sieveline.operators import matching
from sieveline.streaming import claims


def test_chain_equals_plain_rules():
    rnd = random.Random(5)
    for _ in range(300):
        files = [(f"d/{rnd.choice(['', 'a/'])}f{i:02}", "title", rnd.choice([0.5, 0.6, 0.95, 1.0])) for i in range(rnd.randint(1, 9))]
        rnd.shuffle(files)
        chain, status = [], {}
        for f in files:
            status |= claims.settled(chain, *f)
            status |= dict.fromkeys(chain[:-1], "superseded") | {chain[-1]: "matched"}
        order = sorted(files, key=lambda f: f[0].split("/"))
        for i, f in enumerate(order):
            before = any(g[2] >= f[2] for g in order[:i])
            behind = any(g[2] > f[2] for g in order[i + 1 :])
            assert status[f] == ("duplicate_match" if before else "superseded" if behind else "matched")


def test_three_batches_end_as_one(spark, tmp_path):
    rnd = random.Random(6)
    rows = [(f"in/f{i:03}", f"P{rnd.randrange(12)}", "title", rnd.choice([0.5, 0.667, 0.95, 1.0]), "matched") for i in range(150)]
    rows += [(f"in/g{i}", "", "unmatched", 0.0, "unmatched") for i in range(5)]
    rnd.shuffle(rows)
    source, log = str(tmp_path / "in"), f"file://{tmp_path}/log"
    n = []
    for part in (rows[:60], rows[60:100], rows[100:]):
        spark.createDataFrame(part, claims.MATCHES).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(claims.MATCHES).parquet(source)
        claims.follow(stream, log, str(tmp_path / "mark")).awaitTermination()
        n.append(claims.claims_log(spark, log).version())
    assert n == [1, 2, 3]
    got = {r.file: r.status for r in claims.claims_log(spark, log).state().collect()}
    want = {r.file: r.status for r in matching.settle_claims(spark.createDataFrame(rows, claims.MATCHES)).collect()}
    assert got == want
    changed = claims.claims_log(spark, log).added(2)
    assert changed.count() < 120  # the last batch's files and what they change, not all


def test_a_batch_runs_its_state_once(spark, tmp_path):
    """A look whether a batch is empty runs the stateful step and its Python workers as well."""
    rows = [(f"in/f{i:03}", f"P{i % 7}", "title", 0.5 + i % 3 / 10, "matched") for i in range(60)]
    source, log = str(tmp_path / "in"), f"file://{tmp_path}/log"
    notes = tmp_path / "notes"
    notes.mkdir()

    def seen(frames):
        for f in frames:
            (notes / uuid.uuid4().hex).write_text("\n".join(f["file"]))
            yield f

    spark.createDataFrame(rows, claims.MATCHES).coalesce(1).write.parquet(source)
    stream = spark.readStream.schema(claims.MATCHES).parquet(source)
    counted = claims.changed_claims
    claims.changed_claims = lambda matches: counted(matches).mapInPandas(seen, claims.MATCHES)
    try:
        claims.follow(stream, log, str(tmp_path / "mark")).awaitTermination()
    finally:
        claims.changed_claims = counted
    looked = [x for n in notes.iterdir() for x in n.read_text().split()]
    assert claims.claims_log(spark, log).state().count() == 60 and len(looked) == 60
    claims.follow(stream, log, str(tmp_path / "mark")).awaitTermination()
    assert claims.claims_log(spark, log).version() == 1
