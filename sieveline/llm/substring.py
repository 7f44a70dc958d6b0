"""Substring dedup by level-wise doubling of word windows.

A window that repeats is made of shorter windows that repeat. So windows of FIRST words come first, all of them;
where both halves of a window of twice the length repeat it is a candidate at the next level, and so on up to the
length asked for (13 is two overlapping windows of 8). Only what survived a level is looked at in the next one, and
the search ends when nothing survives.

Documents are stored once in packs of about PACK bytes, each with a number. At each level a pack sends the sorted
distinct hashes of its candidates, cut by their leading bits into ranges; whoever gets a range finds the hashes that
two documents have and answers each pack with one bit a hash. So a passage of a third of all documents is one number
a pack, no place is ever a row, and answers are small. The ranges follow the size of the input, so that each has
about RANGE hashes.

At the last level a pack sends, of each distinct candidate, the 128-bit BLAKE2 digest of the words themselves, joined by
one space, and the least doc_id that has it in the pack, and is answered whether another pack has a smaller one. Which
of its own documents come later it sees by itself. Shorter levels only pass candidates on.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BYTE_KEYS, NOT_SPACE, Rolling, dropped, ragged, stored, text_bytes, word_spans

FIRST = 4
PACK = 1 << 20
RANGE = 1 << 20
#: Base of the second rolling hash, with which a pack tells its own windows apart.
SECOND = 0xD1342543DE82EF95
#: 2**LEAST_BITS ranges at least.
LEAST_BITS = 7
U64 = np.uint64
PACKS = "pack long, n_bytes long, body binary, ends binary, ids binary, known binary"
ANSWERS = "pack long, r int, bits binary, n long"
MARKS = "array<struct<level: int, r: int, bits: binary>>"


def lengths(width: int) -> list[int]:
    """Window lengths: FIRST, then twice the one before, up to ``width``: 13 gives 4, 8 and 13."""
    out = [min(FIRST, width)]
    while out[-1] < width:
        out.append(min(2 * out[-1], width))
    return out


# ---- packs ----------------------------------------------------------------------------------------------------------


def _pack_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = TaskContext.get().partitionId() << 33
    held: list[pa.RecordBatch] = []
    size = 0

    def packed() -> pa.RecordBatch:
        nonlocal held, size, number
        table = pa.Table.from_batches(held).combine_chunks()
        data, offsets = text_bytes(table.column("text"))
        ids = table.column("doc_id")
        cells = [
            number, len(data), data.tobytes(), offsets.tobytes(), ids.fill_null(0).to_numpy().tobytes(), ids.is_valid().to_numpy().tobytes()
        ]
        kinds = [pa.int64(), pa.int64(), *[pa.binary()] * 4]
        held, size, number = [], 0, number + 1
        return pa.RecordBatch.from_arrays(
            [pa.array([c], k) for c, k in zip(cells, kinds, strict=True)], ["pack", "n_bytes", "body", "ends", "ids", "known"]
        )

    for batch in batches:
        sizes = np.diff(text_bytes(batch.column("text"))[1]) + 16  # a row without text has its weight too
        ends = np.cumsum(sizes)
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + PACK - size, "right")))
            held.append(batch.slice(at, to - at))
            size += int(ends[to - 1] - base)
            at = to
            if size >= PACK or at < batch.num_rows:
                yield packed()
    if held:
        yield packed()


class Pack:
    """The words of a pack's documents."""

    def __init__(self, row: dict) -> None:
        self.number = row["pack"]
        self.data = np.frombuffer(row["body"], np.uint8)
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.known = np.frombuffer(row["known"], bool)
        offsets = np.frombuffer(row["ends"], np.int64)
        self.starts, self.ends, self.words = word_spans(self.data, offsets, NOT_SPACE)
        self.doc = np.repeat(np.arange(len(self.ids)), np.diff(self.words))
        self.marks = sorted(row["marks"] or [], key=lambda m: (m["level"], m["r"]))

    def joined(self, keep: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The words of a mask, a space behind each, and the place where each of them starts (and all end)."""
        starts, sizes = self.starts[keep], (self.ends - self.starts)[keep]
        at = np.concatenate([[0], np.cumsum(sizes + 1)])
        flat = np.full(int(at[-1]), 0x20, np.uint8)
        flat[ragged(at[:-1], sizes)] = self.data[ragged(starts, sizes)]
        return flat.tobytes(), at

    def whole(self, length: int) -> np.ndarray:
        """Where a window of ``length`` words lies within a document that has an id."""
        place = np.arange(len(self.doc))
        return np.flatnonzero((place + length <= self.words[1:][self.doc]) & self.known[self.doc])

    def answered(self, level: int, parts: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        """A yes or no for each of the windows that the pack sent at a level, ``cuts`` being the ranges' offsets."""
        own = {m["r"]: m["bits"] for m in self.marks if m["level"] == level}
        found = np.zeros(int(cuts[-1]), bool)
        for part, a, b in zip(parts.tolist(), cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if part in own:
                found[a:b] = np.unpackbits(np.frombuffer(own[part], np.uint8), count=b - a)
        return found

    def candidates(self, steps: list[int], level: int, bits: int) -> np.ndarray:
        """Starts of the windows that a level looks at: those whose parts survived all levels before."""
        numbers = Rolling(BYTE_KEYS[self.data]).of(self.starts, self.ends)
        self.numbers, self.rolling = numbers, Rolling(numbers)
        starts = self.whole(steps[0])
        for k in range(level):
            alive = np.zeros(len(self.doc) + 1, bool)
            cells, _, owner = distinct(self.hashes(starts, steps[k]))
            alive[starts[self.answered(k, *ranges(cells >> U64(64 - bits)))[owner]]] = True
            starts = self.whole(steps[k + 1])
            starts = starts[alive[starts] & alive[starts + steps[k + 1] - steps[k]]]
        return starts

    def hashes(self, starts: np.ndarray, length: int) -> np.ndarray:
        return self.rolling.of(starts, starts + length)

    def grouped(self, starts: np.ndarray, length: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray]]:
        """Of the windows' distinct sequences, in order: one start each, the least doc_id, each window's place among them, and their ranges.

        Windows of a pack are told apart by 128 bits of rolling hashes, the first 64 of which say the range.
        """
        wide = np.stack([self.hashes(starts, length), Rolling(self.numbers, SECOND).of(starts, starts + length)], 1)
        cells, order, owner = distinct(wide)
        heads = np.flatnonzero(np.diff(owner[order], prepend=-1))
        least = np.minimum.reduceat(self.ids[self.doc[starts[order]]], heads)
        return starts[order][heads], least, owner, ranges(cells[:, 0] >> U64(64 - bits))

    def digests(self, starts: np.ndarray, length: int) -> np.ndarray:
        """n x 2 numbers: the 128-bit digest of each window's words."""
        flat, at = self.joined(np.ones(len(self.starts), bool))
        digest = hashlib.blake2b
        cells = b"".join(
            [
                digest(flat[a:b], digest_size=16).digest() for a,
                b in zip(at[starts].tolist(), (at[starts + length] - 1).tolist(), strict=True)
            ]
        )
        return np.frombuffer(cells, U64).reshape(-1, 2)


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys in order, the order (stable) of all, and for each key its place among the distinct ones."""
    wide = keys.ndim == 2
    order = np.lexsort((keys[:, 1], keys[:, 0])) if wide else np.argsort(keys, kind="stable")
    ranked = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = (ranked[1:] != ranked[:-1]).any(1) if wide else ranked[1:] != ranked[:-1]
    owner = np.empty(len(keys), np.int64)
    owner[order] = np.cumsum(new) - 1
    return ranked[new], order, owner


def ranges(part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of sorted numbers of ranges, and n + 1 offsets of each one's members."""
    part = part.astype(np.int64)
    heads = np.flatnonzero(np.diff(part, prepend=-1))
    return part[heads], np.append(heads, len(part))


# ---- levels ---------------------------------------------------------------------------------------------------------


def _each_pack(made: Callable[[Pack], Iterator[pa.RecordBatch]]):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                yield from made(Pack(batch.slice(k, 1).to_pylist()[0]))

    return rows


def _sent(pack: Pack, parts: np.ndarray, cuts: np.ndarray, columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    """A row for each range: the pack, and the range's piece of each column (bools as bits)."""
    arrays = [pa.array(parts, pa.int32()), pa.array([pack.number] * len(parts), pa.int64())]
    pairs = list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))
    for column in columns.values():
        pieces = [np.packbits(column[a:b]) if column.dtype == bool else column[a:b] for a, b in pairs]
        arrays.append(pa.array([x.tobytes() for x in pieces], pa.binary()))
    return pa.RecordBatch.from_arrays(arrays, ["r", "pack", *columns])


def _level(steps: list[int], level: int, bits: int):
    """Rows (r, pack, keys, twice): distinct hashes of candidates, and whether two documents of the pack have them."""

    def made(pack: Pack) -> Iterator[pa.RecordBatch]:
        starts = pack.candidates(steps, level, bits)
        if not len(starts):
            return
        cells, order, owner = distinct(pack.hashes(starts, steps[level]))
        doc = pack.ids[pack.doc[starts[order]]]
        heads = np.flatnonzero(np.diff(owner[order], prepend=-1))
        twice = np.minimum.reduceat(doc, heads) < np.maximum.reduceat(doc, heads)
        yield _sent(pack, *ranges(cells >> U64(64 - bits)), {"keys": cells, "twice": twice})

    return _each_pack(made)


def _parts(table: pa.Table, width: int) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Packs, the offsets of each pack's keys, and all keys of a range."""
    keys = [np.frombuffer(k.as_buffer(), U64) for k in table.column("keys")]
    offsets = np.concatenate([[0], np.cumsum([len(k) for k in keys])]) // width
    flat = np.concatenate(keys)
    return table.column("pack").to_pylist(), offsets, flat.reshape(-1, width) if width > 1 else flat


def _answers(table: pa.Table, packs: list[int], offsets: np.ndarray, found: np.ndarray) -> pa.Table:
    bits = [np.packbits(found[a:b]).tobytes() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
    counts = np.add.reduceat(found, offsets[:-1], dtype=np.int64)
    return pa.table({"pack": packs, "r": table.column("r"), "bits": pa.array(bits, pa.binary()), "n": pa.array(counts)})


def _repeated(table: pa.Table) -> pa.Table:
    """Of a range: which hashes come from two packs, or from two documents of one."""
    packs, offsets, keys = _parts(table, 1)
    _, _, owner = distinct(keys)
    sizes = np.diff(offsets).tolist()
    twice = np.concatenate(
        [np.unpackbits(np.frombuffer(t.as_buffer(), np.uint8), count=n) for t, n in zip(table.column("twice"), sizes, strict=True)]
    )
    found = np.bincount(owner, 1 + twice) > 1
    return _answers(table, packs, offsets, found[owner])


def _last_level(steps: list[int], bits: int):
    """Rows (r, pack, keys, ids): digests of distinct candidates and the least doc_id of each."""

    def made(pack: Pack) -> Iterator[pa.RecordBatch]:
        starts = pack.candidates(steps, len(steps) - 1, bits)
        if not len(starts):
            return
        firsts, least, _, (parts, cuts) = pack.grouped(starts, steps[-1], bits)
        yield _sent(pack, parts, cuts, {"keys": pack.digests(firsts, steps[-1]), "ids": least})

    return _each_pack(made)


def _later_ones(table: pa.Table) -> pa.Table:
    """Of a range: which digests a smaller doc_id has in another pack."""
    packs, offsets, keys = _parts(table, 2)
    _, order, owner = distinct(keys)
    own = np.concatenate([np.frombuffer(x.as_buffer(), np.int64) for x in table.column("ids")])
    heads = np.flatnonzero(np.diff(owner[order], prepend=-1))
    return _answers(table, packs, offsets, own > np.minimum.reduceat(own[order], heads)[owner])


def _kept_rows(steps: list[int], bits: int, searched: bool):
    def made(pack: Pack) -> Iterator[pa.RecordBatch]:
        gone = np.zeros(len(pack.doc), bool)
        starts = pack.candidates(steps, len(steps) - 1, bits) if searched else np.zeros(0, np.int64)
        if len(starts):
            _, least, owner, (parts, cuts) = pack.grouped(starts, steps[-1], bits)
            elsewhere = pack.answered(len(steps) - 1, parts, cuts)
            later = starts[elsewhere[owner] | (pack.ids[pack.doc[starts]] > least[owner])]
            gone[ragged(later, np.full(len(later), steps[-1]))] = True
        flat, at = pack.joined(~gone)
        left = np.concatenate([[0], np.cumsum(~gone)])[pack.words]
        texts = [flat[a : max(a, b - 1)] for a, b in zip(at[left[:-1]].tolist(), at[left[1:]].tolist(), strict=True)]
        n_words = np.diff(pack.words)
        arrays = [
            pa.array(pack.ids, mask=~pack.known),
            pa.array(n_words, pa.int64()),
            pa.array(n_words - np.diff(left), pa.int64()),
            pa.array(texts, pa.binary()).cast(pa.string()),
            pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()),
        ]
        yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_words", "n_removed", "kept_text", "kept_sha256"])

    return _each_pack(made)


def _marked(packs: DataFrame, answers: list[DataFrame]) -> DataFrame:
    """Packs with what they were answered at all levels so far."""
    if not answers:
        return packs.withColumn("marks", F.lit(None).cast(MARKS))
    rows = None
    for k, table in enumerate(answers):
        own = table.select("pack", F.struct(F.lit(k).alias("level"), "r", "bits").alias("mark"))
        rows = own if rows is None else rows.unionByName(own)
    return packs.join(rows.groupBy("pack").agg(F.collect_list("mark").alias("marks")), "pack", "left")


def remove_repeated_windows(documents: DataFrame, width: int = 13) -> DataFrame:
    """Remove each word covered by a window of ``width`` words that also starts in a document of smaller doc_id.

    Words are runs of anything but ASCII white space. Windows are judged on the input. Returns doc_id, n_words,
    n_removed, kept_text (kept words joined by one space) and its kept_sha256, a row for each row. Texts that are
    null, empty or of fewer than ``width`` words lose nothing. Rows of the same doc_id are one document: they take
    nothing from each other, whatever their texts. A null doc_id neither takes nor loses anything. A very long text is a
    pack of its own. An empty table gives an empty result. Columns besides doc_id and text are not read.
    """
    if width < 1:
        raise ValueError("width has to be a word at least")
    steps = lengths(width)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    packs = stored(docs.mapInArrow(_pack_rows, PACKS), "op8-packs")
    n_bytes = packs.agg(F.sum("n_bytes")).first()[0] or 0
    bits = max(LEAST_BITS, (n_bytes // (6 * RANGE)).bit_length())
    answers: list[DataFrame] = []
    for level in range(len(steps)):
        last = level == len(steps) - 1
        sent = "r int, pack long, keys binary, " + ("ids binary" if last else "twice binary")
        rows = _marked(packs, answers).mapInArrow(_last_level(steps, bits) if last else _level(steps, level, bits), sent)
        answers.append(stored(rows.groupBy("r").applyInArrow(_later_ones if last else _repeated, ANSWERS), f"op8-level-{steps[level]}"))
        if not last and not answers[-1].agg(F.sum("n")).first()[0]:
            break
    searched = len(answers) == len(steps)
    kept = _marked(packs, answers).mapInArrow(
        _kept_rows(steps, bits, searched), "doc_id long, n_words long, n_removed long, kept_text string, kept_sha256 string"
    )
    return kept
