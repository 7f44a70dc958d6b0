"""SimHash near-duplicates through an inverted index over byte positions with count filtering.

A 64-bit fingerprint has eight positional bytes, in four pieces of two. Two fingerprints that differ in at most two
bits share at least six bytes (the guaranteed minimum of matches) and at least two pieces. The index lists the
distinct fingerprints by the content of each two pieces: six lists a fingerprint, keyed by 32 bits. Within a list the
shared positional bytes of each pair are tallied, pairs that reach six are retained, and these are verified bit by
bit. A list of over LONG members is cut before it is gathered, by the content of two more bytes, in each of the six
ways, since a pair that counts shares two of the other four bytes as well. What is long even then holds at most 65,536
fingerprints that differ in two known bytes: all its pairs share six bytes, so a tally would keep them all, and they
are verified by looking up the 136 neighbours of each member instead of trying all pairs. So no list costs the square
of its size, and none is in one task whole. Links are contracted to stars inside each task; components of these give the
classes.

Fingerprints are computed in Python, where one call of a C library hashes a shingle: with column expressions
(xxhash64 over exploded shingles, bits summed in lanes) the same takes 1.6 times as long.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ID_KEYS, dropped, keyed, ragged, sliced, stored
from .components import components, stars

SEED = 42
SHINGLE = 3
BITS = 2
#: The pieces of two bytes that key a list, for each kind of list, and how many bytes a linked pair shares at least.
KINDS = list(combinations(range(4), 2))
LEAST = 8 - BITS
LONG = 256
PAIRS = 1 << 20
_ONES = [0, *(1 << k for k in range(16))]
NEAR = np.unique(np.array([a | b for a in _ONES for b in _ONES], np.int64))[1:]


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned; 0 for a text of no words."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    flat = b" ".join(words)
    if len(words) <= shingle:
        return _majority([xxhash.xxh64_intdigest(flat, SEED)])
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    starts = np.cumsum(sizes) - sizes
    ends = (starts + sizes - 1)[shingle - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return _majority([digest(flat[a:b], SEED) for a, b in zip(starts.tolist(), ends)])  # noqa: B905


def _majority(hashes: list[int]) -> int:
    tally = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), 65536):
        part = np.array(hashes[lo : lo + 65536], np.uint64).view(np.uint8).reshape(-1, 8)
        tally += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * tally > len(hashes), bitorder="little").view(np.uint64)[0])


def _fingerprint_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches, "text"):
        prints = np.array([fingerprint(t) for t in batch.column("text").to_pylist()], np.uint64)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("text_hash"), pa.array(prints.view(np.int64))], ["doc_id", "text_hash", "fp"]
        )


def tallied(members: np.ndarray, heads: np.ndarray, tails: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked pairs of fingerprints that stand in one list, lists being members[heads[i] : tails[i]]."""
    sizes = tails - heads
    upto = np.concatenate([[0], np.cumsum(sizes * (sizes - 1) // 2)])
    at = 0
    while at < len(heads):
        to = max(at + 1, int(np.searchsorted(upto, upto[at] + PAIRS, "right")) - 1)
        left = ragged(heads[at:to], sizes[at:to])
        behind = np.repeat(tails[at:to], sizes[at:to]) - left - 1
        right = ragged(left + 1, behind)
        a, b = members[np.repeat(left, behind)], members[right]
        differ = a ^ b
        shared = (differ.view(np.uint8).reshape(-1, 8) == 0).sum(1)
        kept = np.flatnonzero(shared >= LEAST)
        kept = kept[np.bitwise_count(differ[kept]) <= BITS]
        yield a[kept], b[kept]
        at = to


def neighbours(members: np.ndarray, free: tuple[int, ...]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Stars over the linked sets of ``members`` (distinct, alike outside the bytes ``free``)."""
    codes = np.zeros(len(members), np.int64)
    for k, byte in enumerate(free):
        codes |= ((members >> np.uint64(8 * byte)) & np.uint64(255)).astype(np.int64) << (8 * k)
    place = np.full(1 << 16, -1, np.int64)
    place[codes] = np.arange(len(members))
    for start in codes.tolist():
        if place[start] < 0:
            continue
        root, found = place[start], []
        place[start] = -1
        front = np.array([start])
        while len(front):
            near = np.unique((front[:, None] ^ NEAR).ravel())
            front = near[place[near] >= 0]
            found.append(place[front])
            place[front] = -1
        others = np.concatenate(found)
        if len(others):
            yield members[np.full(len(others), root)], members[others]


def _cut(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    heads = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return heads, np.append(heads[1:], len(keys))


def _byte_mask(byte: int) -> np.uint64:
    return np.uint64(255 << 8 * byte)


def _rest(kind: int) -> list[int]:
    """The bytes that do not key a kind of list."""
    return [b for b in range(8) if b // 2 not in KINDS[kind]]


def _cuts(kind: int) -> list[tuple[int, int]]:
    """The pairs of bytes that cut its long lists."""
    return list(combinations(_rest(kind), 2))


def refined(members: np.ndarray, kind: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links in a long list: by two more bytes, then by tally or, in what is still long, by neighbours."""
    rest = _rest(kind)
    for fixed in _cuts(kind):
        keys = members & (_byte_mask(fixed[0]) | _byte_mask(fixed[1]))
        order = np.argsort(keys, kind="stable")
        own = members[order]
        heads, tails = _cut(keys[order])
        short = tails - heads <= LONG
        yield from tallied(own, heads[short], tails[short])
        free = tuple(b for b in rest if b not in fixed)
        for a, b in zip(heads[~short].tolist(), tails[~short].tolist(), strict=True):
            yield from neighbours(own[a:b], free)


def _edge_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by list (kind, content, part, sub); lists are whole within a partition. Part is -1 where a list is not cut."""
    rest: list[np.ndarray] = []
    found: list[tuple[np.ndarray, np.ndarray]] = []
    n_found = 0

    def linked(rows: np.ndarray) -> None:
        nonlocal found, n_found
        new = (rows[1:, :4] != rows[:-1, :4]).any(1)
        heads = np.flatnonzero(np.concatenate([[True], new]))
        tails = np.append(heads[1:], len(rows))
        members = np.ascontiguousarray(rows[:, 4]).view(np.uint64)
        some, long = tails - heads > 1, tails - heads > LONG
        parts = [*tallied(members, heads[some & ~long], tails[some & ~long])]
        for a, b in zip(heads[long].tolist(), tails[long].tolist(), strict=True):
            kind, part = int(rows[a, 0]), int(rows[a, 2])
            free = tuple(x for x in _rest(kind) if x not in _cuts(kind)[part])
            parts.append(stars(neighbours(members[a:b], free) if part >= 0 else refined(members[a:b], kind)))
        found += parts
        n_found += sum(len(a) for a, _ in parts)
        if n_found > PAIRS:
            found = [stars(found)]
            n_found = len(found[0][0])

    for batch in batches:
        rows = np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(5)], 1)
        if not len(rows):
            continue
        fresh = np.flatnonzero((rows[:, :4] != rows[-1, :4]).any(1))
        if rest and not len(fresh) and (rows[0, :4] == rest[-1][-1, :4]).all():
            rest.append(rows)  # one list goes on
            continue
        rows = np.concatenate([*rest, rows])
        last = np.flatnonzero((rows[:, :4] != rows[-1, :4]).any(1))
        upto = int(last[-1]) + 1 if len(last) else 0
        rest = [rows[upto:]]
        if upto:
            linked(rows[:upto])
    if rest:
        linked(np.concatenate(rest))
    a, b = stars(found)
    yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])


def fingerprints(documents: DataFrame) -> DataFrame:
    """doc_id, text_hash (Spark's xxhash64) and fp (the unsigned fingerprint's bits as a long) of each row."""
    text = F.col("text").cast("string")
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))
    return docs.mapInArrow(_fingerprint_rows, "doc_id long, text_hash long, fp long")


LIST = ["kind", "content", "part", "sub"]


def _cut_lists(index: DataFrame) -> DataFrame:
    """Rows (kind, content, part, sub, fp): as they are (part -1), or in long lists six times, by two more bytes each."""
    long = stored(index.groupBy("kind", "content").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > LONG), "op10-long")
    whole = lambda rows: rows.select("kind", "content", F.lit(-1).alias("part"), F.lit(0).cast("long").alias("sub"), "fp")
    if long.isEmpty():
        return whole(index)
    masks = [[_signed(sum(255 << 8 * b for b in cut)) for cut in _cuts(k)] for k in range(len(KINDS))]
    subs = F.get(F.array(*[F.array(*[F.lit(m) for m in own]) for own in masks]), F.col("kind"))
    of_long = index.join(long.drop("n"), ["kind", "content"], "left_semi")
    cut = of_long.select("kind", "content", "fp", F.posexplode(subs).alias("part", "mask"))
    cut = cut.select("kind", "content", "part", F.col("fp").bitwiseAND(F.col("mask")).alias("sub"), "fp")
    return whole(index.join(long.drop("n"), ["kind", "content"], "left_anti")).unionByName(cut)


def _classes(documents: DataFrame) -> DataFrame:
    """doc_id, text_hash, fp, root (a fingerprint of the class) and component_id of each row."""
    prints = stored(fingerprints(documents), "op10-prints")
    nodes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "op10-nodes")
    masks = [_signed(sum(0xFFFF << (16 * piece) for piece in kind)) for kind in KINDS]
    kinds = [F.struct(F.lit(k).alias("kind"), F.col("fp").bitwiseAND(F.lit(mask)).alias("content")) for k, mask in enumerate(masks)]
    index = nodes.select("fp", F.explode(F.array(*kinds)).alias("list")).select("list.kind", "list.content", "fp")
    lists = _cut_lists(index)
    edges = lists.repartition(*LIST).sortWithinPartitions(*LIST, "fp").mapInArrow(_edge_rows, "a long, b long")
    roots = components(edges).withColumnsRenamed({"node": "fp"})
    named = nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = stored(named.join(ids, "root").select("fp", "root", "component_id"), "op10-classes")
    dropped(nodes)
    return prints.join(classes, "fp")


def near_duplicates(documents: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, a row for each row.

    Fingerprints of 3-word shingles (A-Z lower-cased, repeats counted) link at two or fewer differing bits;
    component_id is the smallest doc_id that can be reached over links. Null, empty and blank texts have the
    fingerprint zero and are linked like any other. Equal fingerprints are one node, so copies cost nothing; null
    doc_ids belong to their component but can't name it, and a component of nothing else has a null id. A very long
    text is hashed whole, shingle by shingle. An empty table gives an empty result. Columns besides doc_id and text
    are not read.
    """
    return _classes(documents).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(documents: DataFrame) -> DataFrame:
    """One row of each class of near duplicates: that of least doc_id, of several such the one whose text has the least hash.

    A class without any doc_id keeps one row too. Of rows of one doc_id and one text any may be the one.
    """
    kept = _classes(documents).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    kept = kept.groupBy("root").agg(F.min("doc_id").alias("doc_id"), F.min("text_hash").alias("key_text"))
    kept = kept.select(F.coalesce("doc_id", F.lit(0)).alias("key_id"), F.col("doc_id").isNull().alias("key_null"), "key_text")
    return keyed(documents).join(kept, ID_KEYS).dropDuplicates(ID_KEYS).drop(*ID_KEYS)


def _signed(x: int) -> int:
    x &= (1 << 64) - 1
    return x - (1 << 64) if x >> 63 else x
