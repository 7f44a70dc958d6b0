"""Exact substring dedup over bytes with suffix arrays built by two-stage sorting.

A suffix is "small" if it sorts before its successor (the suffix one byte further on) and "large" otherwise. Only
the small ones are sorted directly: the stretches between neighbouring small places are named in order, and names
are doubled, which takes integers alone. The large ones follow from one scan of the buckets (suffixes by first byte)
in order: whoever precedes the suffix just met goes to the next free place of its own bucket. Then the common
prefixes of neighbours in the order are computed, byte for byte, and a place with a prefix of ``least`` bytes in
common with a neighbour repeats.

Distribution. The anchor of a place p of a text is the least hash of the 32-byte grams within the ``least`` bytes
from p on. Two places with the same ``least`` bytes have equal anchors, so suffixes are dealt out by anchor and equal
ones meet. Neighbouring places of one anchor are a run; the run's bytes and the ``least`` bytes behind them are a
snippet, known by its 128-bit BLAKE2 digest. Digests alone are counted first: a snippet that occurs twice repeats as
a whole, an anchor with one snippet needs no sorting, and of equal snippets one is cut out of one text. Snippets that
share an anchor are sorted together in blocks of ``block`` bytes. An anchor whose snippets pass ``bucket_bytes`` is
searched anew, with its snippets as the texts and the grams in another order, which deals them out by what stands
around the common gram. Should that not do either, LEVELS times over, what is left is dealt out by digests of the
``least`` bytes of each place.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BYTE_KEYS, Rolling, dropped, mixed, ragged, settled, sliced, stored, text_bytes, window_least

GRAM = 32
LEVELS = 3
#: Runs are cut at so many places.
RUN = 2048
U64 = np.uint64
SYMBOLS, SYMBOL_BITS, STOP = 7, 9, 511


# ---- the suffix array of a block ------------------------------------------------------------------------------------


def refined(rank: np.ndarray, some: np.ndarray, words: np.ndarray, doubling: bool = False) -> np.ndarray:
    """Splits groups of equal rank by ``words``; a rank is the number of those in groups before. Returns whose group is still shared."""
    # ranks that double are small enough to be one number with the rank before
    order = np.argsort(rank[some] * len(rank) + words) if doubling else np.lexsort((words, rank[some]))
    some, words = some[order], words[order]
    old = rank[some]
    place = np.arange(len(some))
    group = np.ones(len(some), bool)
    group[1:] = old[1:] != old[:-1]
    part = group.copy()
    part[1:] |= words[1:] != words[:-1]
    rank[some] = old + np.maximum.accumulate(np.where(part, place, 0)) - np.maximum.accumulate(np.where(group, place, 0))
    alone = part & np.append(part[1:], True)
    return some[~alone]


def ordered_small(text: np.ndarray, small: np.ndarray, depth: int) -> np.ndarray:
    """The places ``small`` (all small ones, rising) in the order of the first ``depth`` values of their suffixes.

    Stretches, each from a small place to the next, are compared by SYMBOLS values at a time, with STOP behind them:
    where one ends inside another, its last place is small and the other's is large, and small ones sort behind.
    """
    n, m = len(text), len(small)
    wide = np.concatenate([text.astype(np.int64) + 1, np.zeros(SYMBOLS, np.int64)])
    packed = np.zeros(n, np.int64)
    for k in range(SYMBOLS):
        packed |= wide[k : n + k] << (SYMBOL_BITS * (SYMBOLS - 1 - k))
    ends = np.flatnonzero(text[small] == 0)
    last = ends[np.searchsorted(ends, np.arange(m))]
    sizes = np.ones(m, np.int64)
    sizes[:-1] += small[1:] - small[:-1]
    sizes[ends] = 1
    sizes = np.minimum(sizes, depth + 1)
    rank = np.zeros(m, np.int64)
    some, at = np.arange(m), 0
    while len(some):
        left = sizes[some] - at
        words = packed[np.minimum(small[some] + at, n - 1)]
        short = left < SYMBOLS
        gap = SYMBOL_BITS * (SYMBOLS - left[short])
        words[short] = ((words[short] >> gap) << gap) | (STOP << (gap - SYMBOL_BITS))
        some = refined(rank, some, words)
        at += SYMBOLS
        some = some[sizes[some] >= at]
    step = 1
    heads = np.bincount(rank, minlength=m)
    some = np.flatnonzero(heads[rank] > 1)
    while True:
        some = some[(some + step <= last[some]) & (small[np.minimum(some + step, last[some])] - small[some] < depth)]
        if not len(some):
            return small[np.argsort(rank, kind="stable")]
        some = refined(rank, some, rank[some + step], True)
        step *= 2


def two_stage_order(text: np.ndarray, large: np.ndarray, domain: np.ndarray, depth: int) -> np.ndarray:
    """The places of ``domain`` in the order of the first ``depth`` values of their suffixes.

    ``text`` holds bytes plus 1, and 0 behind each piece, which ends suffixes. With a place of a large suffix,
    ``domain`` (a mask) holds the next place too.
    """
    small = ordered_small(text, np.flatnonzero(~large), depth)
    small = small[domain[small]]
    # stage two: bucket by bucket, those before the suffixes met take the next places of their own buckets
    heads = text[small]
    values = np.unique(text[domain])
    lows, highs = np.searchsorted(heads, values), np.searchsorted(heads, values, "right")
    waiting: dict[int, list[np.ndarray]] = {int(v): [] for v in values}
    induced = domain & large
    out = []
    for value, low, high in zip(values.tolist(), lows, highs, strict=True):
        wave = np.concatenate(waiting.pop(value) or [small[:0]])
        bucket = [wave]
        while len(wave):  # large suffixes of this same bucket
            back = wave[wave > 0] - 1
            wave = back[(text[back] == value) & induced[back]]
            bucket.append(wave)
        bucket.append(small[low:high])
        met = np.concatenate(bucket)
        out.append(met)
        back = met[met > 0] - 1
        back = back[(text[back] > value) & induced[back]]
        if len(back):
            own = text[back]
            order = np.argsort(own, kind="stable")
            back, own = back[order], own[order]
            cuts = np.flatnonzero(np.diff(own)) + 1
            for part, v in zip(np.split(back, cuts), own[np.concatenate([[0], cuts])].tolist(), strict=True):
                waiting[v].append(part)
    return np.concatenate(out) if out else small


def common_prefixes(raw: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """The bytes that each suffix has in common with the one before it in the order, ``most`` at most; 0 for the first."""
    words = np.concatenate([raw, np.zeros(most + 16, np.uint8)]).astype(U64)
    for shift in (1, 2, 4):  # eight bytes from each place on
        words = (words[:-shift] << U64(8 * shift)) | words[shift:]
    out = np.zeros(len(order), np.int64)
    some = np.arange(1, len(order))
    for at in range(0, most, 8):
        if not len(some):
            break
        differ = words[order[some] + at] ^ words[order[some - 1] + at]
        unlike = differ != 0
        for k in range(1, 8):
            out[some[unlike]] += differ[unlike] < U64(1 << 8 * k)
        some = some[~unlike]
        out[some] += 8
    return np.minimum(out, most)


def repeated_starts(snippets: list[bytes], runs: list[int], counts: list[int], least: int) -> list[np.ndarray]:
    """For each snippet, the places of its run (0 to run - 1) whose ``least`` bytes occur at two places at least."""
    sizes = np.array([len(s) for s in snippets], np.int64)
    starts = np.cumsum(sizes + 1) - sizes - 1
    raw = np.frombuffer(b"\0".join(snippets) + b"\0", np.uint8)
    text = raw.astype(np.int16) + 1
    text[starts + sizes] = 0
    n, runs_of = len(text), np.array(runs, np.int64)
    owned = np.zeros(n, bool)
    owned[ragged(starts, runs_of)] = True
    # a suffix is large if the next value that differs from its first is smaller
    change = np.flatnonzero(text[:-1] != text[1:])
    turn = change[np.minimum(np.searchsorted(change, np.arange(n)), max(len(change) - 1, 0))] if len(change) else np.zeros(n, np.int64)
    large = (text[turn] > text[np.minimum(turn + 1, n - 1)]) & (text > 0)
    del turn, change
    # the next small suffix behind each run is needed to place the large ones before it
    small_at = np.flatnonzero(~large)
    last = small_at[np.searchsorted(small_at, starts + runs_of - 1)]
    domain = np.zeros(n, bool)
    domain[ragged(starts, last - starts + 1)] = True
    order = two_stage_order(text, large, domain, least)
    order = order[owned[order]]
    same = np.flatnonzero(common_prefixes(raw, order, least) >= least)
    twice = np.zeros(n, bool)
    twice[order[same]] = twice[order[same - 1]] = True
    for at, run, many in zip(starts.tolist(), runs, counts, strict=True):
        if many > 1:
            twice[at : at + run] = True
    return [np.flatnonzero(twice[a : a + r]) for a, r in zip(starts.tolist(), runs, strict=True)]


# ---- dealing out ----------------------------------------------------------------------------------------------------


def anchored_runs(data: np.ndarray, offsets: np.ndarray, least: int, level: int) -> tuple[np.ndarray, ...]:
    """Anchor, text, first and last place (in all the data) of each run, and whether its anchor gram comes twice in it.

    Only then can two places of one run have the same ``least`` bytes.
    """
    grams = Rolling(BYTE_KEYS[data]).grams(GRAM)
    if level:
        grams = mixed(grams ^ mixed(np.array([level], U64)))
    width = least - GRAM + 1
    anchors = window_least(grams, width)
    ends = np.repeat(offsets[1:], np.diff(offsets))
    whole = np.flatnonzero(np.arange(len(anchors)) + least <= ends[: len(anchors)])
    if not len(whole):
        none = np.zeros(0, np.int64)
        return none.view(U64), none, none, none, none.astype(bool)
    own = anchors[whole]
    new = np.ones(len(whole), bool)
    new[1:] = (own[1:] != own[:-1]) | (np.diff(whole) != 1)
    place = np.arange(len(whole))
    new |= (place - np.maximum.accumulate(np.where(new, place, 0))) % RUN == 0
    heads = np.flatnonzero(new)
    first, last, anchor = whole[heads], whole[np.append(heads[1:], len(whole)) - 1], own[heads]
    # grams that are the least of some window: the greatest least of the windows that hold them is their own
    edge = np.full(width - 1, np.iinfo(U64).max, U64)
    least_of = np.flatnonzero(grams == ~window_least(np.concatenate([edge, ~anchors, edge]), width)[: len(grams)])
    a, b = np.searchsorted(least_of, first), np.searchsorted(least_of, last + width)
    hits = grams[least_of[ragged(a, b - a)]] == np.repeat(anchor, b - a)
    again = np.bincount(np.repeat(np.arange(len(a)), b - a), hits, len(a)) > 1
    return anchor, np.searchsorted(offsets, first, "right") - 1, first, last, again


def _digests(raw: bytes, starts: list[int], ends: list[int]) -> np.ndarray:
    made = b"".join([hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(starts, ends, strict=True)])
    return np.frombuffer(made, np.int64).reshape(-1, 2)


INDEX = "k1 long, k2 long, n long, h long, s1 long, s2 long, first long, run long, again boolean"


def _index_rows(least: int, level: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "body"):
            data, offsets = text_bytes(batch.column("body"))
            anchor, doc, first, last, again = anchored_runs(data, offsets, least, level)
            digests = _digests(data.tobytes(), first.tolist(), (last + least).tolist())
            of = pa.array(doc)
            arrays = [batch.column(c).take(of) for c in ("k1", "k2", "n")]
            arrays += [
                pa.array(x) for x in (anchor.view(np.int64), digests[:, 0], digests[:, 1], first - offsets[doc], last - first + 1, again)
            ]
            yield pa.RecordBatch.from_arrays(arrays, ["k1", "k2", "n", "h", "s1", "s2", "first", "run", "again"])

    return rows


BODIES = "h long, s1 long, s2 long, n long, run long, hot boolean, body binary"


def _body_rows(least: int):
    """Cuts the snippets that were picked out of their texts; of equal texts in a partition the first serves."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in sliced(batches, "body"):
            out: list[tuple] = []
            for k1, k2, body, picks in zip(*(batch.column(c) for c in ("k1", "k2", "body", "picks")), strict=True):
                key = (k1.as_py(), k2.as_py())
                if key in seen:
                    continue
                seen.add(key)
                raw = memoryview(body.as_buffer())
                out += [
                    (
                        p["h"], p["s1"], p["s2"], p["n"], p["run"], p["hot"], bytes(raw[p["first"] : p["first"] + p["run"] - 1 + least])
                    ) for p in picks.as_py()
                ]
                if len(out) >= 2048:
                    yield _made(out)
                    out = []
            if out:
                yield _made(out)

    return rows


def _made(out: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 5 + [pa.bool_(), pa.binary()]
    return pa.RecordBatch.from_arrays(
        [pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)], ["h", "s1", "s2", "n", "run", "hot", "body"]
    )


def _spans_of(found: np.ndarray) -> list[dict[str, int]]:
    cuts = np.flatnonzero(np.diff(found) != 1) + 1
    heads = np.concatenate([[0], cuts])
    tails = np.concatenate([cuts, [len(found)]]) - 1
    return [{"a": a, "b": b} for a, b in zip(found[heads].tolist(), found[tails].tolist(), strict=True)]


SPANS = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
SPANS_TYPE = "array<struct<a: long, b: long>>"


def _sorted_rows(least: int, block: int):
    """Rows come sorted by anchor; whole anchors are gathered up to ``block`` bytes and their suffixes sorted."""

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        found = repeated_starts([r[5] for r in rows], [r[3] for r in rows], [r[4] for r in rows], least)
        out = [(r[1], r[2], _spans_of(f)) for r, f in zip(rows, found, strict=True) if len(f) and r[4] == 1]
        return pa.RecordBatch.from_arrays(
            [pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], SPANS)],
            ["s1", "s2", "spans"]
        )

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("h", "s1", "s2", "run", "n", "body")), strict=True):
                if held and row[:3] == held[-1][:3]:
                    continue  # the same snippet out of an equal text; n counts it
                if size >= block and row[0] != held[-1][0]:
                    yield solve(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[5])
        if held:
            yield solve(held)

    return rows


PLACES = pa.struct([("s1", pa.int64()), ("s2", pa.int64()), ("at", pa.int64())])


def _exploded_rows(least: int):
    """What no anchor deals out: the 128-bit digests of the ``least`` bytes from each place on.

    A slice of snippets gives one row a digest, with its places, so a string that all documents have is a row a slice.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "body", 1 << 19):
            data, offsets = text_bytes(batch.column("body"))
            runs = batch.column("run").to_numpy().astype(np.int64)
            at = ragged(offsets[:-1], runs)
            of = np.repeat(np.arange(batch.num_rows), runs)
            digests = _digests(data.tobytes(), at.tolist(), (at + least).tolist())
            order = np.lexsort((digests[:, 1], digests[:, 0]))
            ranked, of, at = digests[order], of[order], (at - offsets[of])[order]
            heads = np.flatnonzero(np.concatenate([[True], (ranked[1:] != ranked[:-1]).any(1)]))
            pick = pa.array(of)
            places = pa.StructArray.from_arrays(
                [batch.column("s1").take(pick), batch.column("s2").take(pick), pa.array(at)], fields=list(PLACES)
            )
            total = np.add.reduceat(batch.column("n").to_numpy()[of], heads)
            lists = pa.ListArray.from_arrays(pa.array(np.append(heads, len(order)).astype(np.int32)), places)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ranked[heads, 0]), pa.array(ranked[heads, 1]), pa.array(total), lists], ["w1", "w2", "n", "places"]
            )

    return rows


def _exploded(hot: DataFrame, least: int) -> DataFrame:
    distinct = hot.dropDuplicates(["s1", "s2"])
    wide = stored(
        distinct.mapInArrow(_exploded_rows(least), "w1 long, w2 long, n long, places array<struct<s1: long, s2: long, at: long>>"),
        "op3-places"
    )
    twice = wide.groupBy("w1", "w2").agg(F.sum("n").alias("total")).where("total > 1").drop("total")
    own = wide.join(twice, ["w1", "w2"]).select(F.inline("places"))
    single = own.join(hot.where("n = 1").select("s1", "s2"), ["s1", "s2"], "left_semi")  # the others are marked as a whole
    return single.groupBy("s1", "s2").agg(F.collect_list(F.struct(F.col("at").alias("a"), F.col("at").alias("b"))).alias("spans"))


def repeats(texts: DataFrame, least: int, block: int, bucket_bytes: int, level: int = 0) -> DataFrame:
    """(k1, k2, marks) of the texts (k1, k2, n, body) with a place whose ``least`` bytes occur twice; marks hold ranges of places."""
    index = stored(texts.mapInArrow(_index_rows(least, level), INDEX), "op3-index")
    kinds = index.groupBy("h", "s1", "s2").agg(
        F.sum("n").alias("n"), F.first("k1").alias("k1"), F.first("k2").alias("k2"), F.first("first").alias("first"), F.first("run").alias("run"), F.max("again").alias("again")
    )
    kinds = stored(kinds, "op3-kinds")
    anchors = kinds.groupBy("h").agg(
        F.count(F.lit(1)).alias("kinds"), F.max("again").alias("any_again"), F.sum(F.col("run") + F.lit(least - 1)).alias("bytes")
    )
    shared = anchors.where("kinds > 1 OR any_again").select("h", (F.col("bytes") > bucket_bytes).alias("hot"))
    picks = kinds.join(shared, "h").groupBy("k1", "k2").agg(
        F.collect_list(F.struct("h", "s1", "s2", "n", "run", "first", "hot")).alias("picks")
    )
    bodies = stored(texts.join(picks, ["k1", "k2"]).mapInArrow(_body_rows(least), BODIES), "op3-bodies")
    usual = bodies.where("NOT hot").repartition("h").sortWithinPartitions("h", "s1", "s2")
    found = usual.mapInArrow(_sorted_rows(least, block), f"s1 long, s2 long, spans {SPANS_TYPE}")
    hot = bodies.where("hot")
    if not hot.isEmpty():
        if level + 1 < LEVELS:
            deeper = repeats(
                hot.select(F.col("s1").alias("k1"), F.col("s2").alias("k2"), "n", "body"), least, block, bucket_bytes, level + 1
            )
            # what occurs twice anyway is marked as a whole
            deeper = deeper.join(kinds.where("n = 1").select(F.col("s1").alias("k1"), F.col("s2").alias("k2")), ["k1", "k2"], "left_semi")
            found = found.unionByName(deeper.select(F.col("k1").alias("s1"), F.col("k2").alias("s2"), F.flatten("marks").alias("spans")))
        else:
            found = found.unionByName(_exploded(hot, least))
    whole = kinds.where("n > 1").select(
        "s1", "s2", F.array(F.struct(F.lit(0).cast("long").alias("a"), (F.col("run") - 1).alias("b"))).alias("spans")
    )
    found = stored(found.unionByName(whole), "op3-found")
    dropped(bodies, kinds)
    shifted = F.transform("spans", lambda s: F.struct((s["a"] + F.col("first")).alias("a"), (s["b"] + F.col("first")).alias("b")))
    marks = stored(index.join(settled(found), ["s1", "s2"]).groupBy("k1", "k2").agg(F.collect_set(shifted).alias("marks")), "op3-marks")
    dropped(index, found)
    return marks


# ---- the operator ---------------------------------------------------------------------------------------------------


def _kept_rows(least: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            out = []
            for text, marks in zip(batch.column("text").to_pylist(), batch.column("marks").to_pylist(), strict=True):
                raw = (text or "").encode()
                spans: list[list[int]] = []
                for a, b in sorted((m["a"], m["b"] + least) for part in marks or () for m in part):
                    if spans and a <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], b)
                    else:
                        spans.append([a, b])
                kept, at = [], 0
                for a, b in spans:
                    kept.append(raw[at:a])
                    at = b
                body = b"".join([*kept, raw[at:]])
                out.append(
                    (
                        len(raw),
                        len(raw) - len(body),
                        len(spans),
                        hashlib.sha256(body).hexdigest(),
                        body,
                        [{"a": a, "b": b} for a, b in spans]
                    )
                )
            columns = [
                pa.array([x[i] for x in out], kind) for i,
                kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), SPANS))
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *columns], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans"]
            )

    return rows


OUT = f"doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, spans {SPANS_TYPE}"


def remove_repeated_bytes(documents: DataFrame, least: int = 400, block: int = 1 << 19, bucket_bytes: int = 1 << 20) -> DataFrame:
    """Remove each byte covered by a string of ``least`` bytes that also starts anywhere else, same text included.

    Strings are judged on the input and never cross texts. Returns doc_id, n_bytes, n_removed, n_spans (maximal
    removed runs), kept_sha256, kept (binary) and spans (removed runs, end exclusive), a row for each row. Null and
    empty texts have 0 bytes. A row's result hangs on its text alone and on all other rows' texts: rows without a
    doc_id and rows that repeat one count like any other. Columns besides doc_id and text are not read. ``block``
    bounds the bytes of a suffix array, together with ``bucket_bytes``, which bounds those of one anchor's snippets.
    """
    if least <= 2 * GRAM:
        raise ValueError(f"least has to be over {2 * GRAM} bytes")
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # a text is known by the first 128 bits of its SHA-256; short ones match nothing and get any number
    digest = F.sha2("text", 256)
    long_enough = F.coalesce(F.octet_length("text") >= least, F.lit(False))
    keys = [
        F.when(
            long_enough, F.conv(F.substring(digest, at, 16), 16, -10).cast("long")
        ).otherwise(F.monotonically_increasing_id()) for at in (1, 17)
    ]
    docs = docs.withColumns({"k1": keys[0], "k2": keys[1]})
    texts = docs.where(F.octet_length("text") >= least).select(
        "k1", "k2", F.lit(1).cast("long").alias("n"), F.col("text").cast("binary").alias("body")
    )
    marks = repeats(texts, least, block, bucket_bytes)
    return docs.join(marks, ["k1", "k2"], "left").select("doc_id", "text", "marks").mapInArrow(_kept_rows(least), OUT)
