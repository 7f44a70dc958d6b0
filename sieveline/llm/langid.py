"""Language of the words of code-switched texts, and of each text, by a linear-chain CRF.

Words are runs of letters (lower-cased). A word's features are its first and last one to three bytes, its inner
2- and 3-byte grams, the word itself, and the languages whose learned lexicon it stands in; learned transitions carry
the language from word to word. A text's language is the one with the most words in expectation, its score their
share: the mean marginal.

Training texts are a documented bounded sample: ``per_language`` labelled texts of each language, those of least
hash; lang serves as label of all their words, and only there. Half of them are spliced, the front of one to the back
of one in another language, so that the transitions learn from switches too. The model is fitted in a task and only
its weights come to the driver. All texts are then labelled, whole.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BYTE_KEYS, U64, Rolling, drawn_texts, least_drawn, mixed, ragged, sliced, text_bytes, word_spans
from .crf import Features, fit, marginals

TABLE = 1 << 17
NO_LANGUAGE = "und"
#: Languages that a model learns at most: its weights are a number for each feature and language.
MOST_LANGUAGES = 256
#: A word is in a language's lexicon if so many texts have it and so great a share of them are in that language.
LEXICON_TEXTS, LEXICON_SHARE = 3, 0.9
LETTER = np.zeros(256, bool)
LETTER[0x61:0x7B] = LETTER[0x80:] = True


def _key(hashes: np.ndarray, kind: int) -> np.ndarray:
    return (mixed(hashes + U64(kind * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) & U64(TABLE - 1)).astype(np.int64)


class Lexicon:
    """Words (as numbers, rising) and the language of each."""

    def __init__(self, numbers: np.ndarray, language: np.ndarray) -> None:
        self.numbers, self.language = numbers, language

    def features(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, bool]:
        at = np.minimum(np.searchsorted(self.numbers, numbers), max(0, len(self.numbers) - 1))
        there = np.flatnonzero(self.numbers[at] == numbers) if len(self.numbers) else np.zeros(0, np.int64)
        return TABLE + self.language[at[there]], there, True

    @staticmethod
    def learned(numbers: np.ndarray, text: np.ndarray, language: np.ndarray, n_languages: int) -> Lexicon:
        """From the words of labelled texts: their numbers, the text of each, and each text's language."""
        words, of = np.unique(numbers, return_inverse=True)
        pairs = np.unique(of * (len(language) + 1) + text)
        of, text = np.divmod(pairs, len(language) + 1)
        counts = np.zeros((len(words), n_languages), np.int64)
        np.add.at(counts, (of, language[text]), 1)
        total = counts.sum(1)
        kept = (total >= LEXICON_TEXTS) & (counts.max(1) >= LEXICON_SHARE * total)
        return Lexicon(words[kept], counts.argmax(1)[kept])


NO_LEXICON = Lexicon(np.zeros(0, U64), np.zeros(0, np.int64))


def word_kinds(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, Features]:
    """Kind of each word, n + 1 offsets of the texts' words, the kinds' numbers, and their features but the lexicon's."""
    data, offsets = text_bytes(pc.utf8_lower(texts))
    starts, ends, words = word_spans(data, offsets, LETTER)
    rolling = Rolling(BYTE_KEYS[data])
    numbers = rolling.of(starts, ends)
    kinds, distinct = pd.factorize(numbers)
    first = np.empty(len(distinct), np.int64)
    first[kinds[::-1]] = np.arange(len(kinds))[::-1]
    a, b = starts[first], ends[first]
    sizes = b - a
    n = len(a)
    columns = [(_key(numbers[first], 1), np.arange(n), True)]
    for k in (1, 2, 3):
        some = np.flatnonzero(sizes >= k)
        columns.append((_key(rolling.of(a[some], a[some] + k), 10 + k), some, True))
        columns.append((_key(rolling.of(b[some] - k, b[some]), 20 + k), some, True))
    for k in (2, 3):
        count = np.maximum(sizes - k + 1, 0)
        at = ragged(a, count)
        columns.append((_key(rolling.of(at, at + k), 30 + k), np.repeat(np.arange(n), count), False))
    return kinds, words, numbers[first], Features(n, columns)


class Model:
    """Learned languages, weights, transitions, lexicon; small enough (TABLE x languages) to go with the tasks."""

    def __init__(
        self, languages: list[str], weights: np.ndarray, transitions: np.ndarray, first: np.ndarray, lexicon: Lexicon = NO_LEXICON
    ) -> None:
        self.languages, self.weights, self.transitions, self.first = languages, weights.astype(np.float32), transitions, first
        self.lexicon = lexicon

    def words(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Marginals of each word, and the texts' offsets into them."""
        kinds, words, numbers, features = word_kinds(texts)
        if not len(kinds) or not self.languages:
            return np.zeros((len(kinds), len(self.languages))), words
        features = Features(features.n, [*features.columns, self.lexicon.features(numbers)])
        chance, _ = marginals(features.sums(self.weights), kinds, words, self.transitions, self.first)
        return chance, words

    def texts(self, texts: pa.Array) -> tuple[list[str], list[float]]:
        chance, words = self.words(texts)
        n = np.diff(words)
        totals = np.zeros((len(n), len(self.languages)))
        if chance.size:
            totals[n > 0] = np.add.reduceat(chance, words[:-1][n > 0], axis=0, dtype=np.float64)
        best = totals.argmax(1) if len(self.languages) else np.zeros(len(n), np.int64)
        names, scores = [], []
        plain = _has_ascii_letter(texts)
        for k, text in enumerate(texts):
            if not self.languages or not n[k] or not (plain[k] or any(c.isalpha() for c in text.as_py())):
                names.append(NO_LANGUAGE)
                scores.append(0.0)
            else:
                names.append(self.languages[best[k]])
                scores.append(float(min(1.0, max(0.0, totals[k, best[k]] / n[k]))))
        return names, scores


def _has_ascii_letter(texts: pa.Array) -> np.ndarray:
    data, offsets = text_bytes(texts)
    seen = np.concatenate([[0], np.cumsum(((data | 32) >= 97) & ((data | 32) <= 122))])
    return seen[offsets[1:]] > seen[offsets[:-1]]


def held_out(column: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(column).cast("string")) % 5 == 0, F.lit(False))


NOTHING = Model([], np.zeros((TABLE, 0)), np.zeros((0, 0)), np.zeros(0))


def spliced(words: np.ndarray, language: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of words, and n + 1 offsets of training sequences: every other text whole, the rest front to back of the next in another language."""
    pieces, sizes = [], []
    turned = [k for k in range(len(language)) if k % 2]
    for k in range(0, len(language), 2):
        pieces.append(np.arange(words[k], words[k + 1]))
        sizes.append(len(pieces[-1]))
    for at, k in enumerate(turned):
        other = next((j for j in turned[at + 1 :] + turned[:at] if language[j] != language[k]), k)
        middle = [(words[j] + words[j + 1] + 1) // 2 for j in (k, other)]
        pieces += [np.arange(words[k], middle[0]), np.arange(middle[1], words[other + 1])]
        sizes.append(len(pieces[-2]) + len(pieces[-1]))
    return np.concatenate(pieces) if pieces else np.zeros(0, np.int64), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def train(sample: pa.Table, rounds: int) -> Model:
    """Fit on rows (doc_id, lang, text)."""
    # rows come in no fixed order; a fixed one, that mixes languages, makes reruns agree
    sample = sample.sort_by([("draw", "ascending"), ("doc_id", "ascending"), ("lang", "ascending"), ("text", "ascending")]).combine_chunks()
    names = sample.column("lang").to_pylist()
    languages = sorted(set(names))
    kinds, words, numbers, features = word_kinds(sample.column("text").combine_chunks())
    if not len(kinds):
        return NOTHING
    label = np.array([languages.index(x) for x in names])
    text = np.repeat(np.arange(len(label)), np.diff(words))
    lexicon = Lexicon.learned(numbers[kinds], text, label, len(languages))
    features = Features(features.n, [*features.columns, lexicon.features(numbers)])
    places, offsets = spliced(words, label)
    targets = np.eye(len(languages))[label[text[places]]]
    return Model(languages, *fit(features, kinds[places], offsets, targets, TABLE + len(languages), rounds, 0.3, 1e-6), lexicon)


def learn(documents: DataFrame, per_language: int = 150, rounds: int = 15) -> Model:
    """Fit on the per_language texts of least hash of each language, among doc_ids whose crc32 mod 5 is not 0.

    Ids and languages alone are looked at first, then the texts picked; of rows that repeat a doc_id each different text
    is drawn from once. The sample, per_language x languages texts at most, is gathered in one task and fitted there.
    More than MOST_LANGUAGES languages are an error, as the model has a weight for each feature and language.
    """
    named = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")
    )
    usable = named.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & ~held_out())
    n_languages = usable.select("lang").distinct().count()
    if n_languages > MOST_LANGUAGES:
        raise ValueError(f"{n_languages} languages to learn; at most {MOST_LANGUAGES} are")
    picked = least_drawn(usable.select("doc_id", "lang"), "lang", per_language, "doc_id")
    # per_language x MOST_LANGUAGES rows at most are sent to all tasks
    sample = drawn_texts(usable.where("text IS NOT NULL"), picked, "lang", per_language, "doc_id", "lang")
    sample = sample.withColumn("draw", F.xxhash64("doc_id"))

    def fitted(table: pa.Table) -> pa.Table:
        return pa.table({"model": pa.array([pickle.dumps(train(table, rounds))], pa.binary())})

    found = sample.groupBy().applyInArrow(fitted, "model binary").collect()
    return pickle.loads(found[0]["model"]) if found else NOTHING


def identify_rows(documents: DataFrame, model: Model) -> DataFrame:
    """The same rows, with lang_pred and score behind their other columns; columns of these names are replaced."""
    documents = documents.drop("lang_pred", "score")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            names, scores = model.texts(batch.column("text").fill_null(""))
            columns = [*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "lang_pred", "score"])

    out = T.StructType([*documents.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return documents.mapInArrow(rows, out)


def identify(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred and score for each row.

    ``und`` with score 0 for null texts and texts without a letter (and for all if nothing could be learned). Repeated
    rows get equal rows, a tie goes to the first language by name, a very long text is labelled whole, and an empty
    table gives an empty result.
    lang, source and doc_id are not read for the prediction.
    """
    docs = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held_out().alias("held_out")
    )
    return identify_rows(docs, model).select("doc_id", "held_out", "lang_pred", "score")


def label_words(model: Model, text: str) -> list[tuple[str, str]]:
    """(word, language) of one text: the general use of the model, word by word."""
    lowered = pa.array([text])
    chance, _ = model.words(lowered)
    data, offsets = text_bytes(pc.utf8_lower(lowered))
    starts, ends, _ = word_spans(data, offsets, LETTER)
    raw = data.tobytes()
    return [
        (raw[a:b].decode(), model.languages[k]) for a, b, k in zip(starts.tolist(), ends.tolist(), chance.argmax(1).tolist(), strict=True)
    ]
