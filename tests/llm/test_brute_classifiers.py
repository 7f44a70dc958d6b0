"""The queries of both classifiers against plain versions that work word by word and line by line."""

import math
import re

import numpy as np
import pytest

from sieveline.llm import common, langid, quality, queries

DATA = "/root/testdata/sf0.001"
MASK = (1 << 64) - 1
KEYS = [int(x) for x in common.BYTE_KEYS]


def stirred(x):
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & MASK
    x = (x ^ x >> 27) * 0x94D049BB133111EB & MASK
    return x ^ x >> 31


def number(word):
    return stirred(sum(KEYS[b] * pow(common.BASE, i, 1 << 64) for i, b in enumerate(word)) & MASK)


def feature(word, kind):
    return stirred((number(word) + kind * 0x9E3779B97F4A7C15) & MASK) & (langid.TABLE - 1)


def chances(emissions, transitions, first):
    """Forward and backward, one element at a time."""
    t = np.exp(np.asarray(transitions, float))
    e = np.exp(emissions - emissions.max(1, keepdims=True))
    forward, backward = np.zeros_like(e), np.ones_like(e)
    for k in range(len(e)):
        forward[k] = (np.exp(np.asarray(first, float)) if k == 0 else forward[k - 1] @ t) * e[k]
        forward[k] /= forward[k].sum()
    for k in range(len(e) - 2, -1, -1):
        backward[k] = t @ (e[k + 1] * backward[k + 1])
        backward[k] /= backward[k].sum()
    out = forward * backward
    return out / out.sum(1, keepdims=True)


def plain_language(model, text, seen):
    words = re.findall(rb"[a-z\x80-\xff]+", (text or "").lower().encode())
    if not words or not any(c.isalpha() for c in text):
        return "und", 0.0
    lexicon = dict(zip(model.lexicon.numbers.tolist(), model.lexicon.language.tolist(), strict=True))
    rows = []
    for w in words:
        if w not in seen:
            ids = [feature(w, 1)]
            for k in (1, 2, 3):
                if len(w) >= k:
                    ids += [feature(w[:k], 10 + k), feature(w[-k:], 20 + k)]
            for k in (2, 3):
                ids += [feature(w[i : i + k], 30 + k) for i in range(len(w) - k + 1)]
            if number(w) in lexicon:
                ids.append(langid.TABLE + lexicon[number(w)])
            seen[w] = model.weights[ids].astype(float).sum(0)
        rows.append(seen[w])
    mean = chances(np.array(rows), model.transitions, model.first).mean(0)
    return model.languages[int(mean.argmax())], float(mean.max())


def test_language_query_equals_a_plain_version(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model, seen = langid.learn(docs), {}
    text = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    got = queries.op6_language_id(spark, DATA).collect()
    assert len(got) == len(text)
    for r in got:
        name, score = plain_language(model, text[r.doc_id], seen)
        assert (r.lang_pred == name or abs(score - 1 / len(model.languages)) < 0.05) and r.score == pytest.approx(score, abs=2e-3), r.doc_id


def share(line, inside):
    return sum(bool(inside[b]) for b in line)


def plain_lines(text):
    lines = (text or "").encode().split(b"\n")
    out = []
    for k, line in enumerate(lines):
        words = re.findall(rb"[^\x20\x09-\x0d]+", line)
        n = max(1, len(words))
        full = max(1, len(line))
        upper, lower, digit, stop, bar, shout, symbol = (
            share(line, t) for t in (quality.UPPER, quality.LOWER, quality.DIGIT, quality.STOP, quality.BAR, quality.SHOUT, quality.SYMBOL)
        )
        letters = max(1, upper + lower)
        next_to = sum(words[i] == words[i - 1] for i in range(1, len(words)))
        near = sum(any(i >= lag and words[i] == words[i - lag] for lag in range(1, quality.LAGS + 1)) for i in range(len(words)))
        marked = sum(bool((quality.SYMBOL | quality.SHOUT)[w[-1]]) for w in words)
        own = [
            math.log1p(len(line)),
            math.log1p(len(words)),
            upper / letters,
            digit / full,
            stop / full,
            bar / n,
            shout / n,
            symbol / full,
            (upper + lower) / full
        ]
        out.append([*own, next_to / n, near / n, float(k > 0 and line == lines[k - 1]), letters / n, marked / n, math.log1p(len(lines))])
    return out, [len(line) + 1 for line in lines]


def plain_quality(model, text):
    features, sizes = plain_lines(text)
    bins = [[int(np.searchsorted(e, x, "right")) for e, x in zip(model.edges, row, strict=True)] for row in features]
    none, step = [quality.BINS] * quality.FEATURES, quality.FEATURES * (quality.BINS + 1)
    emissions = []
    for k in range(len(bins)):
        three = (bins[k], bins[k - 1] if k else none, bins[k + 1] if k + 1 < len(bins) else none)
        emissions.append(
            sum(model.weights[part * step + f * (quality.BINS + 1) + b] for part, row in enumerate(three) for f, b in enumerate(row))
        )
    good = chances(np.array(emissions), model.transitions, model.first)[:, 1]
    raw = min(1 - 1e-6, max(1e-6, float(np.dot(good, sizes) / sum(sizes))))
    return 1 / (1 + math.exp(-min(30, max(-30, model.curve[0] * math.log(raw / (1 - raw)) + model.curve[1]))))


def test_quality_query_equals_a_plain_version(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.learn(docs, labels)
    text = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    got = queries.op2_quality_classifier(spark, DATA).collect()
    assert len(got) == len(text)
    for r in got:
        want = plain_quality(model, text[r.doc_id])
        assert r.score == pytest.approx(want, abs=5e-3), r.doc_id
        assert r.predicted == int(r.score >= 0.5)


def test_quality_of_repeated_rows_and_names_that_clash(spark):
    rows = [(1, "good words here", 0.1, True), (1, "good words here", 0.1, True), (2, None, 0.2, False)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double, held_out boolean")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0)], "doc_id long, quality int")
    got = quality.classify(docs, quality.learn(docs, labels)).collect()
    assert sorted(r.doc_id for r in got) == [1, 1, 2] and len({r.score for r in got if r.doc_id == 1}) == 1


def test_switches_are_learned(spark):
    """A text that changes its language midway is labelled word by word; transitions from one language to another are not shut off."""
    en, de = "the house and the tree with the mouse", "das Haus und der Baum mit der Maus"
    df = spark.createDataFrame(
        [(i, t, g, "x") for i, (t, g) in enumerate([(en, "en"), (de, "de")] * 40)],
        "doc_id long, text string, lang string, lang_pred string"
    )
    model = langid.learn(df)
    got = [lang for _, lang in langid.label_words(model, f"{en} {de} {en}")]
    assert got == ["en"] * 8 + ["de"] * 8 + ["en"] * 8
    assert {langid.TABLE} <= set(model.lexicon.features(model.lexicon.numbers)[0].tolist()) and len(model.lexicon.numbers) > 8
    assert "lang_pred" in langid.identify_rows(df, model).columns and langid.identify_rows(df, model).first().lang_pred in ("en", "de")
