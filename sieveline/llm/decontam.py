"""Benchmark decontamination by winnowing.

Of every window of w neighbouring k-grams the one of least hash is kept, so any shared span of k + w - 1 words has
a fingerprint in common whatever stands around it. Documents keep the fingerprints that any item has. Each of these is
extended to both sides, to the windows of a whole match that hold it, a few a fingerprint; and these meet the items'
windows by 128-bit digests of their words. So a common fingerprint of many documents and many items makes no product:
only what agrees word by word ever meets, and each window of a document meets one row.

A window has 13 words, or all words of a shorter item; each such length has fingerprints of its own kind. Before
the join, documents' fingerprints pass a Bloom filter of FILTER_BITS bits filled from the benchmark. Its size does
not depend on either table; a benchmark that fills it makes it useless, not wrong. Fingerprints carry the few words
around them that an extension can need, so no text is shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, BYTE_KEYS, LOWER, Rolling, chosen, sliced, stored, text_bytes, word_spans

FILTER_BITS = 1 << 23
HITS = pa.list_(pa.struct([("kind", pa.int32()), ("h", pa.int64()), ("at", pa.int32()), ("ahead", pa.int32()), ("around", pa.string())]))
HIT_TYPE = "array<struct<kind: int, h: bigint, at: int, ahead: int, around: string>>"


def gram(width: int) -> int:
    """k for windows of ``width`` words; the windows of k-grams then have width - k + 1 members."""
    return min(width, width // 2 + 2)


def _hits(batch: pa.RecordBatch, kinds: list[int], seen: np.ndarray | None, whole_only: int | None) -> tuple[pa.Array, np.ndarray]:
    """Fingerprints of each text as a list, and the numbers of words.

    With whole_only (items) a kind below it takes the texts of exactly so many words, and the kind itself all longer.
    """
    data, offsets = text_bytes(batch.column("text"))
    data = LOWER[data]
    starts, ends, words = word_spans(data, offsets, ALNUM)
    n_words = np.diff(words)
    rolling = Rolling(Rolling(BYTE_KEYS[data]).of(starts, ends))
    ends_of = np.repeat(words[1:], n_words)
    starts_of = np.repeat(words[:-1], n_words)
    found: list[tuple[np.ndarray, ...]] = []
    for width in kinds:
        k = gram(width)
        grams = rolling.grams(k)
        picks = chosen(grams, width - k + 1)
        fits = np.arange(len(picks)) + width <= ends_of[: len(picks)]
        if whole_only is not None and width < whole_only:
            fits &= (ends_of - starts_of)[: len(picks)] == width
        picks = picks[fits]
        picks = picks[np.flatnonzero(np.diff(picks, prepend=-1))]
        hashes = grams[picks]
        if seen is not None:
            bit = hashes & np.uint64(FILTER_BITS - 1)
            kept = (seen[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) == 1
            picks, hashes = picks[kept], hashes[kept]
        low = np.maximum(starts_of[picks], picks - (width - k))
        high = np.minimum(ends_of[picks], picks + width)
        found.append(
            (
                np.full(len(picks), width),
                hashes.view(np.int64),
                picks - starts_of[picks],
                picks - low,
                low,
                high,
                np.searchsorted(words, picks, "right") - 1
            )
        )
    kind, h, at, ahead, low, high, doc = (np.concatenate([f[i] for f in found]) for i in range(7))
    order = np.argsort(doc, kind="stable")
    raw = data.tobytes()
    around = [
        b" ".join(raw[a:b] for a, b in zip(starts[x:y].tolist(), ends[x:y].tolist(), strict=True)) for x,
        y in zip(low[order].tolist(), high[order].tolist(), strict=True)
    ]
    flat = pa.StructArray.from_arrays(
        [
            pa.array(kind[order].astype(np.int32)),
            pa.array(h[order]),
            pa.array(at[order].astype(np.int32)),
            pa.array(ahead[order].astype(np.int32)),
            pa.array(around, pa.binary()).cast(pa.string())
        ],
        ["kind", "h", "at", "ahead", "around"]
    )
    counts = np.bincount(doc, minlength=batch.num_rows)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), flat), n_words


def _scan(kinds: list[int], seen: np.ndarray | None, whole_only: int | None):
    """Rows with a number of their own (they are stored, so it stays), an id, the text's hash, and its fingerprints."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        for batch in sliced(batches, "text"):
            hits, n_words = _hits(batch, kinds, seen, whole_only)
            own = np.arange(number, number + batch.num_rows)
            number += batch.num_rows
            arrays = [pa.array(own), batch.column("id"), batch.column("text_hash"), pa.array(n_words, pa.int64()), hits]
            yield pa.RecordBatch.from_arrays(arrays, ["row", "id", "text_hash", "n_words", "hits"])

    return rows


SCANNED = f"row long, id long, text_hash long, n_words long, hits {HIT_TYPE}"


def _texts(table: DataFrame, key: str) -> DataFrame:
    text = F.col("text").cast("string")
    return table.select(F.col(key).cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))


WINDOWS = "kind int, d1 long, d2 long, low int, high int"


def _extended(key: str):
    """Rows (key, kind, d1, d2, low, high): the windows around each fingerprint, with digests of their words."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, kinds, low, digests = [], [], [], []
            cells = zip(*(batch.column(c).to_pylist() for c in (key, "kind", "at", "ahead", "around")), strict=True)
            for who, width, at, ahead, around in cells:
                words, k = around.split(" "), gram(width)
                for start in range(max(0, ahead + k - width), min(ahead, len(words) - width) + 1):
                    own.append(who)
                    kinds.append(width)
                    low.append(at - ahead + start)
                    digests.append(hashlib.blake2b(" ".join(words[start : start + width]).encode(), digest_size=16).digest())
            pairs = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            kind, first = np.array(kinds, np.int32), np.array(low, np.int32)
            arrays = [pa.array(own, pa.int64()), pa.array(kind), *[pa.array(pairs[:, c]) for c in (0, 1)], pa.array(first), pa.array(first + kind)]
            yield pa.RecordBatch.from_arrays(arrays, [key, "kind", "d1", "d2", "low", "high"])

    return rows


def _covered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """row, n_hit (words in any span), spans and sets."""
    for batch in batches:
        n_hit = []
        for spans in batch.column("spans").to_pylist():
            upto = total = 0
            for a, b in sorted((s["low"], s["high"]) for s in spans):
                total += max(0, b - max(a, upto))
                upto = max(upto, b)
            n_hit.append(total)
        columns = [batch.column(c) for c in ("row", "spans", "sets")]
        yield pa.RecordBatch.from_arrays([columns[0], pa.array(n_hit, pa.int64()), *columns[1:]], ["row", "n_hit", "spans", "sets"])


#: sha256 of no items.
NO_ITEMS = hashlib.sha256(b"").hexdigest()


def contamination(documents: DataFrame, benchmark: DataFrame, width: int = 13, share: int = 20) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, text_hash, items and spans (of hit words) for each row.

    Words are [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after lower-casing A-Z. A word is hit if it lies in any occurrence
    of ``width`` consecutive words of an item, or of all words of an item of fewer; items without words, and null
    item_ids or texts, have no windows. contaminated: n_hit > 0 and share * n_hit >= n_words. Null and empty texts
    have no words. Each row is judged by its own text: null and repeated doc_ids make no difference. text_hash is
    Spark's xxhash64 of the text. Columns besides doc_id, item_id and text are not read.

    An item of a null or repeated text or id is one of each (id, text). A very long text is looked at in one piece, its
    fingerprints alone go on. An empty table of documents gives an empty result; an empty benchmark hits nothing.
    Hashes of 64 bits name sets of items; which words agree is told by digests of 128 bits.
    """
    items = _texts(benchmark, "item_id").where("id IS NOT NULL AND text IS NOT NULL")
    kinds = list(range(1, width + 1))
    known = stored(items.mapInArrow(_scan(kinds, None, width), SCANNED).select(F.col("id").alias("item_id"), F.inline("hits")), "op5-items")
    present = sorted(r[0] for r in known.select("kind").distinct().collect()) or [width]
    bit = F.col("h").bitwiseAND(F.lit(FILTER_BITS - 1))
    cell_bit = F.call_function("shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(F.lit(63)).cast("int"))
    seen = np.zeros(FILTER_BITS // 64, np.uint64)
    for cell, bits in known.groupBy(F.shiftright(bit, 6).alias("cell")).agg(F.bit_or(cell_bit).alias("bits")).collect():
        seen[cell] = np.uint64(bits & (1 << 64) - 1)
    scan = stored(_texts(documents, "doc_id").mapInArrow(_scan(present, seen, None), SCANNED), "op5-scan")
    there = known.select(F.col("kind").alias("i_kind"), F.col("h").alias("i_h")).distinct()
    hits = scan.select("row", F.inline("hits")).join(there, F.expr("h = i_h AND kind = i_kind"), "left_semi")
    windows = hits.mapInArrow(_extended("row"), f"row long, {WINDOWS}")
    # the items of each window as one number, as windows of a passage have the same ones
    digest = ["kind", "d1", "d2"]
    owners = known.mapInArrow(_extended("item_id"), f"item_id long, {WINDOWS}").groupBy(*digest)
    owners = stored(owners.agg(F.array_sort(F.collect_set("item_id")).alias("items")).withColumn("owned", F.xxhash64("items")), "op5-owners")
    met = windows.join(owners.select(*digest, "owned"), digest)
    spans = met.groupBy("row").agg(F.collect_set(F.struct("low", "high")).alias("spans"), F.array_sort(F.collect_set("owned")).alias("sets"))
    counted = spans.mapInArrow(_covered, "row long, n_hit long, spans array<struct<low: int, high: int>>, sets array<long>")
    counted = stored(counted.withColumn("sets_key", F.xxhash64("sets")), "op5-counted")
    # documents that met the same sets of items have the same items: each combination is looked up once
    lists = owners.groupBy("owned").agg(F.first("items").alias("items"))
    combined = counted.groupBy("sets_key").agg(F.first("sets").alias("sets")).select("sets_key", F.explode("sets").alias("owned"))
    each = combined.join(lists, "owned").select("sets_key", F.explode("items").alias("item")).distinct()
    named = each.groupBy("sets_key").agg(F.array_sort(F.collect_list("item")).alias("items"))
    as_text = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    named = named.select("sets_key", "items", F.size("items").cast("long").alias("n_items"), F.sha2(as_text, 256).alias("items_sha256"))
    counted = counted.join(named, "sets_key").select("row", "n_hit", "n_items", "items_sha256", "items", "spans")
    joined = scan.select("row", F.col("id").alias("doc_id"), "text_hash", "n_words").join(counted, "row", "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return joined.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.coalesce("items_sha256", F.lit(NO_ITEMS)).alias("items_sha256"),
        ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated"),
        "text_hash",
        "items",
        "spans",
    )
