"""The CRF against a plain recursion; both classifiers on held-out rows and awkward ones."""

import zlib

import numpy as np
import pyarrow as pa
import pytest

from sieveline.llm import crf, langid, quality

DATA = "/root/testdata/sf0.01"


def plain_marginals(emissions, offsets, transitions, first):
    out = np.zeros_like(emissions)
    moves = np.zeros_like(transitions)
    t, f = np.exp(transitions), np.exp(first)
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        e = np.exp(emissions[a:b])
        if not len(e):
            continue
        fw, bw = np.zeros_like(e), np.ones_like(e)
        fw[0] = f * e[0]
        for k in range(1, len(e)):
            fw[k] = (fw[k - 1] @ t) * e[k]
        for k in range(len(e) - 2, -1, -1):
            bw[k] = t @ (e[k + 1] * bw[k + 1])
        z = fw[-1].sum()
        out[a:b] = fw * bw / z
        for k in range(1, len(e)):
            moves += fw[k - 1][:, None] * t * (e[k] * bw[k])[None] / z
    return out, moves


@pytest.mark.parametrize("piece", [1, 3, 128])
def test_marginals_equal_the_plain_recursion(piece, monkeypatch):
    monkeypatch.setattr(crf, "PIECE", piece)
    rng = np.random.default_rng(3)
    offsets = np.array([0, 0, 1, 9, 9, 11, 24])
    emissions, transitions, first = rng.normal(size=(24, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    got, moves = crf.marginals(emissions, np.arange(24), offsets, transitions, first, True, np.float64)
    want, want_moves = plain_marginals(emissions, offsets, transitions, first)
    assert np.allclose(got, want) and np.allclose(moves, want_moves)
    assert crf.marginals(emissions, np.zeros(0, int), np.array([0, 0]), transitions, first)[0].shape == (0, 3)


def test_fit_learns_sticky_labels():
    rng = np.random.default_rng(4)
    labels = np.concatenate([np.repeat(rng.integers(0, 2), 20) for _ in range(60)])
    seen = np.where(rng.random(len(labels)) < 0.7, labels, 1 - labels)  # what is seen errs in 30 %
    features = crf.Features(2, [(np.arange(2), np.arange(2), True)])
    offsets = np.arange(0, len(labels) + 1, 20)
    weights, transitions, first = crf.fit(features, seen, offsets, np.eye(2)[labels], 2, 60, 0.3, 1e-6)
    chance, _ = crf.marginals(features.sums(weights), seen, offsets, transitions, first)
    assert (chance.argmax(1) == labels).mean() > 0.9 and transitions[0, 0] > transitions[0, 1]


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = langid.learn(docs)
    lang = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    got = langid.identify(docs, model).collect()
    assert len(got) == len(lang) and all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    kept = [r for r in got if r.held_out]
    assert np.mean([lang[r.doc_id] == r.lang_pred for r in kept]) > 0.97


def test_language_edges(spark):
    schema = "doc_id long, text string, lang string, score double"
    rows = [(i, t, g, 0.0) for i, (t, g) in enumerate([("the house and the tree", "en"), ("das Haus und der Baum", "de")] * 20)]
    rows += [
        (100, None, "en", 0.0),
        (101, "", None, 0.0),
        (102, "12 — !!", "de", 0.0),
        (None, "das Haus", "en", 0.0),
        (103, "den " * 30000, None, 0.0)
    ]
    df = spark.createDataFrame(rows, schema)
    got = {r.doc_id: r for r in langid.identify(df, langid.learn(df)).collect()}
    assert [got[k].lang_pred for k in (100, 101, 102)] == ["und"] * 3 and got[None].lang_pred == "de" and not got[None].held_out
    assert got[0].lang_pred == "en" and got[1].lang_pred == "de"
    empty = spark.createDataFrame([], schema)
    assert langid.identify(empty, langid.learn(empty)).count() == 0
    assert {r.lang_pred for r in langid.identify(df, langid.learn(empty)).collect()} == {"und"}


def test_words_of_mixed_text(spark):
    df = spark.createDataFrame(
        [
            (i, t, g) for i,
            (t, g) in enumerate([("the house and the tree with the mouse", "en"), ("das Haus und der Baum mit der Maus", "de")] * 20)
        ],
        "doc_id long, text string, lang string"
    )
    got = langid.label_words(langid.learn(df), "the house and the tree. Das Haus und der Baum")
    assert [x[1] for x in got[:5]] == ["en"] * 5 and [x[1] for x in got[6:]] == ["de"] * 4


def test_quality_held_out(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    got = quality.classify(docs, quality.learn(docs, labels)).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    label = {r.doc_id: r.quality for r in labels.collect()}
    kept = [(r.score, label[r.doc_id]) for r in got if r.held_out and r.doc_id in label]
    good, bad = [s for s, q in kept if q], [s for s, q in kept if not q]
    assert np.mean([[g > b for g in good] for b in bad]) > 0.95
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)


def test_quality_edges(spark):
    docs = spark.createDataFrame(
        [(1, None, 3), (2, "", 3), (None, "x", 3), (3, "\n\n", 3), (4, "w " * 50000, 3)], "doc_id long, text string, quality int"
    )
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality.classify(docs, quality.learn(docs, none)).collect()} == {0.5}
    one = spark.createDataFrame(
        [(2, 1, 0), (4, 0, 0), (4, 0, 0), (9, 1, 0), (None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int"
    )
    got = quality.classify(docs, quality.learn(docs, one)).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    assert quality.classify(docs.limit(0), None).count() == 0


def test_lines_never_cross_texts():
    features, sizes, lines = quality.line_features(pa.array(["a b\nc", "", None, "\n"]))
    assert lines.tolist() == [0, 2, 3, 4, 6] and sizes.tolist() == [4, 2, 1, 1, 1, 1] and len(features) == 6


def test_samples_are_bounded_where_ids_repeat(spark, monkeypatch):
    """One labelled doc_id has 1,500 of 3,000 rows: 10 of each class, or language, reach the task that fits, whatever it repeats."""
    from pyspark.sql import functions as F

    from sieveline.llm import common, langid, quality

    ids = [(i, f"text number {i} with some words") for i in range(1500)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(1500)], "doc_id long, quality int")
    for kind in ("different", "equal"):
        known = labels.where(~quality.held_out())
        hot = common.least_drawn(known, "quality", 10, "doc_id").first().doc_id
        rows = ids + [(hot, f"again {i}" if kind == "different" else "again") for i in range(1500)]
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        picked = common.least_drawn(known, "quality", 10, "doc_id")
        assert picked.count() == 20
        drawn = common.drawn_texts(docs, picked, "quality", 10, "doc_id")
        assert {r["quality"]: r["count"] for r in drawn.groupBy("quality").count().collect()} == {0: 10, 1: 10}
        spoken = docs.withColumn("lang", F.when(F.col("doc_id") % 3 == 0, "en").otherwise("fr"))
        some = common.least_drawn(spoken.select("doc_id", "lang"), "lang", 10, "doc_id")
        assert some.count() == 20
        both = common.drawn_texts(spoken, some, "lang", 10, "doc_id", "lang")
        assert {r["lang"]: r["count"] for r in both.groupBy("lang").count().collect()} == {"en": 10, "fr": 10}
    monkeypatch.setattr(langid, "MOST_LANGUAGES", 1)
    with pytest.raises(ValueError, match="languages"):
        langid.learn(spoken)
