"""Document quality from line labels of a linear-chain CRF.

Every line of a text is good or bad. Its features are binned counts of its own (length, letters, capitals, symbols,
bars, repeats of words at short distances, ...) and those of the line before and behind. Forward-backward marginals
of "good", weighted by the lines' lengths, give a document's raw quality; a logistic curve fitted on the training
documents turns it into the score.

Training documents are a documented bounded sample: ``per_class`` labelled documents of each class, those of least
hash. A document's label stands for its lines at first; in a second pass lines of bad documents take the labels
that the first model gives them, as such documents have good lines too. The model is fitted in a task and only its
weights come to the driver.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BYTE_KEYS, NOT_SPACE, Rolling, drawn_texts, least_drawn, sliced, text_bytes, word_spans
from .crf import Features, fit, marginals

BINS = 8
LAGS = 6


def _table(*wanted: int) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(wanted)] = True
    return out


UPPER = _table(*range(0x41, 0x5B))
LOWER = _table(*range(0x61, 0x7B), *range(0x80, 0x100))
DIGIT = _table(*range(0x30, 0x3A))
STOP = _table(*b".,;:?'\"-")
BAR = _table(*b"|")
SHOUT = _table(*b"!")
SYMBOL = _table(*(b for b in range(0x21, 0x7F) if not (UPPER | LOWER | DIGIT | STOP | BAR | SHOUT)[b]))
FEATURES = 15


def line_features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features (lines x FEATURES), the lines' bytes plus 1, and n + 1 offsets of the texts' lines. A text has a line at least."""
    data, offsets = text_bytes(texts)
    cuts = np.flatnonzero(data == 10)
    begins = np.concatenate([offsets[:-1], cuts + 1])
    doc = np.concatenate([np.arange(len(offsets) - 1), np.searchsorted(offsets, cuts, "right") - 1])
    order = np.lexsort((begins, doc))
    begins, doc = begins[order], doc[order]
    stops = np.empty(len(begins), np.int64)
    lines = np.searchsorted(doc, np.arange(len(offsets)))
    if len(begins):
        stops[:-1] = begins[1:] - 1
        stops[lines[1:] - 1] = offsets[1:]
    size = stops - begins

    def share(inside: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(data) + 1, np.int32 if len(data) < 1 << 31 else np.int64)
        np.cumsum(inside[data], out=sums[1:])
        return sums[stops] - sums[begins]

    starts, ends, _ = word_spans(data, offsets, NOT_SPACE)
    numbers = Rolling(BYTE_KEYS[data]).of(starts, ends)
    a, b = np.searchsorted(starts, begins), np.searchsorted(starts, stops)
    n_words = b - a
    near = np.zeros(len(numbers), bool)
    line_of = np.repeat(np.arange(len(a)), n_words) if len(numbers) else np.zeros(0, np.int64)
    next_to = None
    for lag in range(1, LAGS + 1):
        same = np.zeros(len(numbers), bool)
        same[lag:] = (numbers[lag:] == numbers[:-lag]) & (line_of[lag:] == line_of[:-lag])
        near |= same
        next_to = same if lag == 1 else next_to
    count = lambda x: np.concatenate([[0], np.cumsum(x)])[b] - np.concatenate([[0], np.cumsum(x)])[a]
    counts = [share(x) for x in (UPPER, LOWER, DIGIT, STOP, BAR, SHOUT, SYMBOL)]
    letters, words, full = np.maximum(counts[0] + counts[1], 1), np.maximum(n_words, 1), np.maximum(size, 1)
    whole = Rolling(BYTE_KEYS[data]).of(begins, stops)
    again = np.zeros(len(size))
    again[1:] = (whole[1:] == whole[:-1]) & (doc[1:] == doc[:-1])
    marked = np.zeros(len(numbers), bool)  # words that end in a symbol or a shout
    marked[:] = (SYMBOL | SHOUT)[data[ends - 1]] if len(ends) else False
    out = np.stack(
        [np.log1p(size), np.log1p(n_words), counts[0] / letters, counts[2] / full, counts[3] / full, counts[4] / words, counts[5] / words, counts[6] / full, (counts[0] + counts[1]) / full,
         count(next_to) / words, count(near) / words, again, letters / words, count(marked) / words, np.log1p((lines[1:] - lines[:-1])[doc])], 1,
    )
    return out, size + 1, lines


class Model:
    def __init__(
        self, edges: list[np.ndarray], weights: np.ndarray, transitions: np.ndarray, first: np.ndarray, curve: tuple[float, float]
    ) -> None:
        self.edges, self.weights, self.transitions, self.first, self.curve = edges, weights, transitions, first, curve

    def ids(self, features: np.ndarray, lines: np.ndarray) -> np.ndarray:
        """Active weights of each line: a bin of each feature of its own, of the line before and of the line behind."""
        own = np.stack([np.searchsorted(e, features[:, f], "right") for f, e in enumerate(self.edges)], 1)
        before, behind = np.full_like(own, BINS), np.full_like(own, BINS)
        before[1:], behind[:-1] = own[:-1], own[1:]
        filled = np.diff(lines) > 0
        before[lines[:-1][filled]] = BINS
        behind[lines[1:][filled] - 1] = BINS
        base = np.arange(own.shape[1]) * (BINS + 1)
        step = own.shape[1] * (BINS + 1)
        return np.concatenate([own + base, before + base + step, behind + base + 2 * step], 1)

    def raw(self, texts: pa.Array) -> np.ndarray:
        features, sizes, lines = line_features(texts)
        if not len(features):
            return np.zeros(0)
        good = self.lines(self.ids(features, lines), lines)[:, 1]
        return weighted(good, sizes, lines)

    def lines(self, ids: np.ndarray, lines: np.ndarray) -> np.ndarray:
        return marginals(self.weights[ids].sum(1), np.arange(len(ids)), lines, self.transitions, self.first)[0].astype(np.float64)

    def score(self, texts: pa.Array) -> np.ndarray:
        return curved(self.raw(texts), self.curve)


def weighted(good: np.ndarray, sizes: np.ndarray, lines: np.ndarray) -> np.ndarray:
    top, bottom = np.concatenate([[0], np.cumsum(good * sizes)]), np.concatenate([[0], np.cumsum(sizes)])
    return np.clip((top[lines[1:]] - top[lines[:-1]]) / (bottom[lines[1:]] - bottom[lines[:-1]]), 0, 1)


def _logit(x: np.ndarray) -> np.ndarray:
    x = np.clip(x, 1e-6, 1 - 1e-6)
    return np.log(x / (1 - x))


def curved(raw: np.ndarray, curve: tuple[float, float]) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(curve[0] * _logit(raw) + curve[1], -30, 30)))


def _fit_curve(raw: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Logistic regression on one variable by Newton's method; the slope is never negative."""
    x, (a, b) = _logit(raw), (1.0, 0.0)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        w = p * (1 - p)
        g = np.array([((label - p) * x).sum() - 1e-2 * (a - 1), (label - p).sum() - 1e-2 * b])
        h = np.array([[(w * x * x).sum() + 1e-2, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-2]])
        step = np.linalg.solve(h, g)
        a, b = a + float(np.clip(step[0], -1, 1)), b + float(np.clip(step[1], -1, 1))
    return max(a, 1e-3), b


def train(texts: pa.Array, label: np.ndarray, rounds: int = 60) -> Model:
    features, sizes, lines = line_features(texts)
    edges = [np.unique(np.quantile(features[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(FEATURES)]
    model = Model(edges, np.zeros((3 * FEATURES * (BINS + 1), 2)), np.zeros((2, 2)), np.zeros(2), (1.0, 0.0))
    ids = model.ids(features, lines)
    of_line = np.repeat(label, np.diff(lines))
    active = Features(len(ids), [(column, np.arange(len(ids)), True) for column in ids.T])
    targets = np.eye(2)[of_line]
    for turn in range(2):
        model.weights, model.transitions, model.first = fit(
            active, np.arange(len(ids)), lines, targets, len(model.weights), rounds, 0.2, 1e-5
        )
        if turn == 0:
            chance = model.lines(ids, lines)
            targets = np.where((of_line == 0)[:, None], chance, targets)
            worst = np.array([lines[k] + chance[lines[k] : lines[k + 1], 1].argmin() for k in np.flatnonzero(label == 0)], np.int64)
            targets[worst] = [1.0, 0.0]  # a bad document has one bad line at least
    model.curve = _fit_curve(weighted(model.lines(ids, lines)[:, 1], sizes, lines), label)
    return model


def held_out(column: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(column).cast("string")) % 3 == 1, F.lit(False))


def learn(documents: DataFrame, labels: DataFrame, per_class: int = 1000) -> Model | None:
    """Fit on per_class labelled documents of each class, of least hash, among doc_ids whose crc32 mod 3 is not 1.

    Of several labels of one doc_id the lower counts. Of rows that repeat a doc_id each different text is drawn from
    once. The sample, 2 x per_class texts at most, is gathered in one task and fitted there. Without labelled rows
    there is no model.
    """
    known = labels.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")
    ).where("doc_id IS NOT NULL AND quality IN (0, 1)")
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality")).where(~held_out())
    picked = least_drawn(known, "quality", per_class, "doc_id")
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    sample = drawn_texts(docs, picked, "quality", per_class, "doc_id")  # 2 x per_class rows at most

    def fitted(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("text", "ascending")]).combine_chunks()
        model = train(table.column("text").combine_chunks(), table.column("quality").to_numpy())
        return pa.table({"model": pa.array([pickle.dumps(model)], pa.binary())})

    found = sample.groupBy().applyInArrow(fitted, "model binary").collect()
    return pickle.loads(found[0]["model"]) if found else None


def classify(documents: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher: better) and predicted (1 if score >= 0.5) for each row.

    A null or empty text is one empty line and is scored like any other. Without any labelled document all scores
    are 0.5. Repeated rows get equal rows; a very long text is scored whole, by itself; an empty table gives an empty
    result. Labels, lang, source and doc_id are not read for the score.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            score = model.score(batch.column("text")) if model else np.full(batch.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("held_out"),
                    pa.array(score, pa.float64()),
                    pa.array((score >= 0.5).astype(np.int32))
                ],
                ["doc_id", "held_out", "score", "predicted"]
            )

    docs = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held_out().alias("held_out")
    )
    return docs.mapInArrow(rows, "doc_id long, held_out boolean, score double, predicted int")
