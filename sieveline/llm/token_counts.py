"""Token counts of the documents of flat token files, by a separator scan.

A flat token file is nothing but token ids of a fixed width, each document followed by the end-of-document id; it
has no index. It is read in blocks of equal size that know nothing of each other. Within a block one vectorised
comparison finds the separators. A prefix scan over each file's blocks (tokens, separators and the last separator
so far) then stitches the documents that cross block borders. What is shuffled is the separators' places alone.

``packed`` makes such files' blocks out of documents with a public tokenizer's vocabulary; each of its partitions
is a file.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.sinks import Store
from .common import stored

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
END = 50256
#: Fixed value: how texts are split before merging, as published with this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BLOCKS = "file string, block long, payload binary"

_encodings: dict[str, object] = {}


def encoding(path: str):
    if path not in _encodings:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        _encodings[path] = tiktoken.Encoding("flat", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


def packed(documents: DataFrame, block_tokens: int = 1 << 16, vocabulary: str = VOCABULARY, end: int = END, width: int = 2) -> DataFrame:
    """Blocks (file, block, payload) of flat files of ids of ``width`` bytes, and beside them the doc_ids that end in each block.

    The doc_ids are no part of the files; they only name the documents afterwards. A null or empty text is a
    document of no tokens. An id that does not fit, or that is ``end``, is an error.
    """
    kind, most = np.dtype(f"<u{width}"), 1 << 8 * width

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(vocabulary).encode_ordinary
        file, block = f"part-{TaskContext.get().partitionId()}", 0
        held: list[np.ndarray] = []
        ends: list[tuple[int, int | None]] = []  # where each document ends, from the block's start
        size = 0

        def cut(n: int) -> pa.RecordBatch:
            nonlocal held, ends, size, block
            flat = np.concatenate(held) if held else np.zeros(0, kind)
            inside = [i for at, i in ends if at < n]
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array([file]),
                    pa.array([block], pa.int64()),
                    pa.array([flat[:n].tobytes()], pa.binary()),
                    pa.array([inside], pa.list_(pa.int64()))
                ],
                ["file", "block", "payload", "doc_ids"]
            )
            held, ends, size, block = [flat[n:]], [(at - n, i) for at, i in ends if at >= n], size - n, block + 1
            return out

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = np.array([*encode(text.as_py() or ""), end], np.int64)
                if ids.max() >= most or (ids[:-1] == end).any():
                    raise ValueError(f"ids of this vocabulary do not fit in {width} bytes, or {end} is one of them")
                held.append(ids.astype(kind))
                size += len(held[-1])
                ends.append((size - 1, doc_id))
                while size >= block_tokens:
                    yield cut(block_tokens)
        if size:
            yield cut(size)

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(rows, f"{BLOCKS}, doc_ids array<long>")


def blocks_of_files(
    spark: SparkSession, path: str, block_bytes: int = 1 << 17, glob: str = "*", whole: int = 1 << 28, piece: int = 1 << 26
) -> DataFrame:
    """Blocks (file, block, payload) of the flat token files under ``path``; block_bytes is a multiple of the ids' width.

    Files of up to ``whole`` bytes come through Spark's reader, from any store. Larger ones, which that reader takes
    as one value each and refuses beyond 2 GB, are read in pieces of about ``piece`` bytes, many at once, by Arrow's
    file systems (local, HDFS, S3 and the like, s3a with the keys and the endpoint of Spark's settings). A file without
    a byte has no blocks.
    """
    store = Store.at(spark, path)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                yield from _cut(name, 0, content.as_buffer(), block_bytes)

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, first, n in zip(*(batch.column(c).to_pylist() for c in ("path", "first", "blocks")), strict=True):
                system, place = replace(store, folder=name).opened()
                with system.open_input_file(place) as file:
                    for k in range(first, first + n):
                        yield from _cut(name, k, pa.py_buffer(file.read_at(block_bytes, k * block_bytes)), block_bytes)

    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    small = files.where(F.col("length") <= whole).select("path", "content").mapInArrow(rows, BLOCKS)
    step = max(1, piece // block_bytes)
    n_blocks = F.ceil(F.col("length") / block_bytes)
    starts = files.where(F.col("length") > whole).select(
        "path", n_blocks.alias("all"), F.explode(F.sequence(F.lit(0), n_blocks - 1, F.lit(step))).alias("first")
    )
    pieces = starts.select(
        "path", "first", F.least(F.lit(step), F.col("all") - F.col("first")).alias("blocks")
    ).repartition("path", "first")
    return small.unionByName(pieces.mapInArrow(ranges, BLOCKS))


def _cut(name: str, first: int, raw: pa.Buffer, block_bytes: int) -> Iterator[pa.RecordBatch]:
    for k, at in enumerate(range(0, raw.size, block_bytes), first):
        cells = [
            pa.array([name]),
            pa.array([k], pa.int64()),
            pa.array([raw.slice(at, min(block_bytes, raw.size - at)).to_pybytes()], pa.binary())
        ]
        yield pa.RecordBatch.from_arrays(cells, ["file", "block", "payload"])


def scanned(blocks: DataFrame, end: int = END, width: int = 2) -> DataFrame:
    """file, block, n (tokens), seps (places of separators); doc_ids is passed on if it is there."""
    named = "doc_ids" in blocks.columns

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, seps = [], []
            for payload in batch.column("payload"):
                raw = payload.as_buffer()
                if raw.size % width:
                    raise ValueError(f"a block of {raw.size} bytes does not hold whole ids of {width} bytes")
                ids = np.frombuffer(raw, f"<u{width}")
                n.append(len(ids))
                seps.append(np.flatnonzero(ids == end))
            columns = [batch.column("file"), batch.column("block"), pa.array(n, pa.int64()), pa.array(seps, pa.list_(pa.int64()))]
            names = ["file", "block", "n", "seps"]
            if named:
                columns.append(batch.column("doc_ids"))
                names.append("doc_ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    picked = blocks.select("file", "block", "payload", *(["doc_ids"] if named else []))
    return picked.mapInArrow(rows, "file string, block long, n long, seps array<long>" + ", doc_ids array<long>" * named)


def stitched(scan: DataFrame) -> DataFrame:
    """file, ordinal (from 0), first_token, n_tokens (without the separator) and closed for every document of every file.

    Tokens behind a file's last separator are a document that is not closed. The prefix scan over a file's blocks
    sees three numbers a block (tokens, separators, the last separator); the separators join its result.
    """
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = scan.select("file", "block", "n", F.size("seps").alias("n_seps"), F.try_element_at("seps", F.lit(-1)).alias("last_sep"))
    sums = sums.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("last", F.col("base") + F.col("last_sep"))
    linked = sums.select(
        "file", "block", "n", "base", "n_seps", "last", F.coalesce(
            F.sum("n_seps").over(before), F.lit(0)
        ).alias("ordinal0"), F.coalesce(F.max("last").over(before), F.lit(-1)).alias("previous")
    )
    starts = linked.select(F.col("file").alias("in_file"), F.col("block").alias("in_block"), "base", "ordinal0", "previous")
    joined = scan.select("file", "block", "seps").join(starts, F.expr("file = in_file AND block = in_block"))
    spread = joined.select("file", "base", "ordinal0", "previous", F.expr("seps AS all_seps"), F.posexplode("seps").alias("k", "at"))
    start = F.when(F.col("k") > 0, F.col("base") + F.get("all_seps", F.col("k") - 1)).otherwise(F.col("previous")) + 1
    documents = spread.select(
        "file",
        (F.col("ordinal0") + F.col("k")).alias("ordinal"),
        start.alias("first_token"),
        (F.col("base") + F.col("at") - start).alias("n_tokens"),
        F.lit(True).alias("closed")
    )
    files = linked.groupBy("file").agg(
        F.sum("n").alias("total"), F.coalesce(F.max("last"), F.lit(-1)).alias("last"), F.sum("n_seps").alias("ordinal")
    )
    tails = files.where("last + 1 < total").select(
        "file",
        "ordinal",
        (F.col("last") + 1).alias("first_token"),
        (F.col("total") - F.col("last") - 1).alias("n_tokens"),
        F.lit(False).alias("closed")
    )
    return documents.unionByName(tails)


def token_counts(documents: DataFrame, block_tokens: int = 1 << 16, vocabulary: str = VOCABULARY, end: int = END) -> DataFrame:
    """doc_id, n_tokens, file and ordinal of each row, counted from the flat token stream of the documents.

    Null and empty texts have 0 tokens. Repeated rows give repeated rows; a null doc_id stays null. A very long text is
    encoded whole and its tokens lie in several blocks; an empty table gives an empty result.
    """
    scan = stored(scanned(packed(documents, block_tokens, vocabulary, end), end), "op1-scan")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    names = scan.select("file", "doc_ids", F.coalesce(F.sum(F.size("doc_ids")).over(before), F.lit(0)).alias("ordinal0"))
    names = names.select("file", "ordinal0", F.posexplode("doc_ids").alias("k", "doc_id")).select(
        "file", (F.col("ordinal0") + F.col("k")).alias("ordinal"), "doc_id"
    )
    return stitched(scan).join(names, ["file", "ordinal"]).select("doc_id", "n_tokens", "file", "ordinal")
