"""Shared helpers: the shared folder, bounded Arrow batches, byte-level words and hashes.

Rules all operators of this subpackage keep:

* ``doc_id`` identifies a document. Rows that repeat a (doc_id, text) pair give equal result rows.
* A null text is a text of no words and no bytes; an empty table gives an empty result.
* Columns that the operator does not name are ignored, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..tables import dropped, removed, scratch, settled, shared_folder, stored

__all__ = ["dropped", "removed", "scratch", "settled", "shared_folder", "stored"]

U64 = np.uint64

#: Multiplier of the rolling hashes and its inverse mod 2**64.
BASE = 0x9E3779B97F4A7C15
BASE_INV = pow(BASE, -1, 1 << 64)

#: Bytes of text that are looked at together.
SLICE = (1 << 20) - 64


def keyed(documents: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The rows with what tells them apart, without nulls: ID_KEYS, that is doc_id (0 if null), whether it is null, and the text's hash."""
    text = F.col("text").cast("string")
    return documents.withColumns(
        {"key_id": F.coalesce(F.col(doc_id).cast("long"), F.lit(0)), "key_null": F.col(doc_id).isNull(), "key_text": F.xxhash64(text)}
    )


#: Counts by value that are sent to all tasks at most.
MOST_VALUES = 1 << 16


def least_drawn(rows: DataFrame, by: str, most: int, *order: str) -> DataFrame:
    """Of each value of ``by`` the ``most`` rows of least hash of ``order`` (then by order itself).

    First only rows stay whose hash is among the least of so many different ones as the value has, by a margin, so that
    what is ranked does not grow with the table. The margin is four times and 64 rows, far beyond chance and the error
    of the counts. Rows that repeat count once.
    """
    unit = F.shiftrightunsigned(F.xxhash64(*order), 11) * F.lit(2.0**-53)
    drawn = rows.select(by, *order).withColumn("draw", unit)
    counts = drawn.groupBy(by).agg(F.approx_count_distinct("draw", 0.05).alias("n_rows"))
    few = counts.count() <= MOST_VALUES  # else the join is dealt out by value
    thin = drawn.join(F.broadcast(counts) if few else counts, by)
    thin = thin.where(F.col("draw") * F.col("n_rows") < 4 * most + 64).drop("n_rows").distinct()
    place = F.row_number().over(Window.partitionBy(by).orderBy("draw", *order))
    return thin.withColumn("place", place).where(F.col("place") <= most).drop("place", "draw")


def drawn_texts(texts: DataFrame, picked: DataFrame, by: str, most: int, *on: str) -> DataFrame:
    """The rows of ``texts`` (doc_id, text and others) that ``picked`` names by ``on``, ``most`` of each value of ``by`` at most.

    A doc_id that repeats has all its different texts among the rows to draw from, and each (doc_id, text) once: what
    is gathered of them does not grow with how often an id repeats. ``picked`` goes to all tasks.
    """
    asked = texts.join(F.broadcast(picked), list(on)).withColumn("text_hash", F.xxhash64("text"))
    few = least_drawn(asked.select("doc_id", "text_hash", by).distinct(), by, most, "doc_id", "text_hash")
    rows = asked.join(F.broadcast(few), ["doc_id", "text_hash", by])
    return rows.groupBy("doc_id", "text_hash", by).agg(F.first("text").alias("text")).select("doc_id", "text", by)


ID_KEYS = ["key_id", "key_null", "key_text"]


def sliced(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about ``most`` bytes of ``column``; a longer text stands alone."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        texts = batch.column(batch.schema.get_field_index(column))
        ends = np.cumsum(_lengths(texts))
        at = 0
        while at < n:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + most, "right")))
            yield batch.slice(at, to - at)
            at = to


def _lengths(texts: pa.Array) -> np.ndarray:
    _, offsets = text_bytes(texts)
    return np.diff(offsets)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts end to end, and n + 1 offsets into them. Null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("" if pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type) else b"")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    if offsets is None or len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


#: Byte classes of words: all but white space, and the bytes of [^\x00-\x2F\x3A-\x60\x7B-\x7F] once A-Z are lower-cased.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, 9, 10, 11, 12, 13]] = False
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def word_spans(data: np.ndarray, offsets: np.ndarray, in_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and n + 1 offsets of each text's words."""
    inside = in_word[data]
    begin, end = inside.copy(), inside.copy()
    if len(data):
        begin[1:] &= ~inside[:-1]
        end[:-1] &= ~inside[1:]
        cuts = offsets[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < len(data))]
        begin[cuts] = inside[cuts]
        end[cuts - 1] = inside[cuts - 1]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offsets)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**n mod 2**64 at least. One table of 8 MB a base is kept for reuse; a longer one is made each time."""
    if n <= SLICE and base in _powers:
        return _powers[base]
    out = np.full(max(n, SLICE) + 1, base, U64)
    out[0] = 1
    out = np.multiply.accumulate(out)
    if n <= SLICE:
        _powers[base] = out
    return out


class Rolling:
    """Hashes of any run of a sequence of numbers, from one pass of prefix sums."""

    def __init__(self, values: np.ndarray, base: int = BASE) -> None:
        n = len(values)
        self.base_inv = powers(pow(base, -1, 1 << 64), n)
        self.sums = np.zeros(n + 1, U64)
        np.cumsum(values.astype(U64) * powers(base, n)[:n], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((self.sums[ends] - self.sums[starts]) * self.base_inv[starts])

    def grams(self, k: int) -> np.ndarray:
        """Of the k values from each position on."""
        n = len(self.sums) - k
        return mixed((self.sums[k:] - self.sums[:-k]) * self.base_inv[:n]) if n > 0 else np.zeros(0, U64)


#: Random numbers of the byte values, so that short words differ in all bits.
BYTE_KEYS = mixed(np.arange(1, 257, dtype=U64) * U64(0xD1B54A32D192ED03))


def window_least(keys: np.ndarray, width: int) -> np.ndarray:
    """Least of keys[i : i + width] for every i that has a whole window; three passes whatever the width."""
    n = len(keys)
    if n < width:
        return keys[:0]
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(U64).max, U64)
    padded[:n] = keys
    grid = padded.reshape(blocks, width)
    left = np.minimum.accumulate(grid, 1).ravel()
    right = np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(right[: n - width + 1], left[width - 1 : n])


def chosen(hashes: np.ndarray, width: int) -> np.ndarray:
    """Winnowing: for every window of ``width`` hashes, the place of its least hash, the leftmost of equals."""
    bits = max(1, int(len(hashes)).bit_length())
    mask = U64((1 << bits) - 1)
    least = window_least((hashes & ~mask) | np.arange(len(hashes), dtype=U64), width)
    return (least & mask).astype(np.int64)


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... (counts[0] of them), starts[1], ..."""
    total = int(counts.sum())
    out = np.ones(total, np.int64)
    full = counts > 0
    starts, counts = starts[full], counts[full]
    if not len(starts):
        return np.zeros(0, np.int64)
    heads = np.cumsum(counts) - counts
    out[heads] = starts
    out[heads[1:]] -= starts[:-1] + counts[:-1] - 1
    return np.cumsum(out)
