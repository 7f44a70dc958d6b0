"""The pipeline's stages, each against a brute-force version on its own input."""

import os
import re
from collections import Counter

import corpus_pipeline as pipeline
from sieveline.llm import common, langid

from .test_op1_op4_op5_op7 import brute_contamination, brute_targets, shards_hold
from .test_op9_op10 import brute_components, brute_print

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score int, taken string, fp array<int>"
REST = (1, "x", [2])


def made(spark):
    rows = [(*r, *REST) for r in spark.read.parquet(f"{DATA}/documents.parquet").limit(120).select(*pipeline.COLUMNS).collect()]
    item = spark.read.parquet(f"{DATA}/benchmark.parquet").first().text
    long = "the long house of many words " * 30000
    odd = [
        (5000, None),
        (5001, ""),
        (5002, "1 2 3"),
        (5003, item),
        (5004, rows[3][1]),
        (5004, rows[3][1]),
        (None, item),
        (None, "a clean text without any number, of its own"),
        (5005, long)
    ]
    odd += [(5006, "two texts have this number, and this is the one"), (5006, "while the other says something else entirely")]
    return spark.createDataFrame(rows + [(i, t, "en", "src1", len(t or ""), *REST) for i, t in odd], SCHEMA)


def again(spark, df):
    return spark.createDataFrame(df.collect(), df.schema)


def test_stages_equal_brute_force(spark):
    docs = made(spark)
    assert [name for name, _ in pipeline.STAGES] == ["language_id", "simhash_near_dedup", "decontamination", "mixing", "sharding"]
    # language: texts without a letter go, all else stays whole, and its lang is what the model says word by word
    model = langid.learn(docs)
    one = again(spark, pipeline.language(spark, docs, DATA))
    assert one.columns == pipeline.COLUMNS
    before = [(r.doc_id, r.text) for r in docs.collect() if any(c.isalpha() for c in r.text or "")]
    assert Counter((r.doc_id, r.text) for r in one.collect()) == Counter(before) and len(before) > 120
    for r in one.limit(40).collect():
        own = Counter(lang for _, lang in langid.label_words(model, r.text)).most_common(2)
        assert r.lang == own[0][0] or len(own) > 1 and own[0][1] < 1.2 * own[1][1]
    # near copies: of each class the row of smallest doc_id stays, once
    two = again(spark, pipeline.near_dedup(spark, one, DATA))
    rows = one.collect()
    comp = brute_components({k: brute_print(r.text) for k, r in enumerate(rows)})
    classes = {}
    for k, c in comp.items():
        classes.setdefault(c, []).append(rows[k])
    kept = Counter()
    for members in classes.values():
        ids = [r.doc_id for r in members if r.doc_id is not None]
        kept[min(ids) if ids else None] += 1
    assert Counter(r.doc_id for r in two.collect()) == kept and two.columns == pipeline.COLUMNS and kept[None] == 1 and kept[5006] == 2
    # benchmark passages
    three = again(spark, pipeline.decontaminate(spark, two, DATA))
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    bad = {k for k, x in brute_contamination([(k, r.text) for k, r in enumerate(two.collect())], bench).items() if x[4]}
    assert Counter((r.doc_id, r.text) for r in three.collect()) == Counter(
        (r.doc_id, r.text) for k, r in enumerate(two.collect()) if k not in bad
    )
    assert bad and None in {r.doc_id for r in three.collect()}
    # mixing: what is left of each source is near its target, and rows are whole texts or fronts of them
    four = again(spark, pipeline.mix(spark, three, DATA))
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t)
    sizes, got, text = {}, {}, {}
    for r in three.collect():
        sizes[r.source] = sizes.get(r.source, 0) + len(words(r.text))
        text.setdefault(r.doc_id, []).append(words(r.text))
    for r in four.collect():
        own = words(r.text)
        assert any(t[: len(own)] == own for t in text[r.doc_id]) and r.n_chars is not None
        got[r.source] = got.get(r.source, 0) + len(own)
    assert all(abs(got.get(s, 0) - want) <= 0.5 + 1e-6 for s, want in brute_targets(sizes).items()) and four.columns == pipeline.COLUMNS
    most = Counter((r.doc_id, r.text) for r in four.collect())
    assert max(most.values()) <= 2
    # shards
    shards_hold([(r.doc_id, r.text, r.source) for r in four.collect()], pipeline.shard(spark, four, DATA).collect())


def test_run_leaves_one_table(spark, tmp_path):
    made(spark).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{DATA}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    folder = common.shared_folder(spark).removeprefix("file://")
    before = set(os.listdir(folder))
    assert pipeline.run(spark, str(tmp_path)).count() > 100
    assert len(set(os.listdir(folder)) - before) == 1


def test_run_of_nothing(spark, tmp_path):
    made(spark).limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{DATA}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert pipeline.run(spark, str(tmp_path)).count() == 0
    assert pipeline.ORACLE_SQL is None
