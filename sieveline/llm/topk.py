"""Exact top-k inner products by block-at-a-time pruning.

Vectors are dealt into ranges that are alike in their largest components (which, and of what sign), and packed into
blocks with a forward index (the block's rows as one matrix) and, per dimension, the block's greatest and least value. For a query
these give an upper bound of all scores in the block: the sum over dimensions of the query's value times whichever
extreme suits its sign. Each query visits blocks by falling bound and stops where the bound falls below its k-th
score.

Queries come in chunks and blocks in groups. First every chunk sees the groups' extremes alone, and each strip of its
queries picks the group of the highest bounds; scores there give each query a k-th score to beat. Then the extremes are looked at again, and
only pairs of a chunk and a group in which some query's bound still reaches its k-th score get the group's rows. So
neither side is broadcast or gathered, and rows travel after bounds. The lists of a query from all groups are merged
at the end. How much the bounds skip depends on the vectors; README has figures.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, stored

SCALE = 64.0
#: The largest components whose places and signs order the vectors.
LEAD = 3
#: A chunk's queries are taken in so many strips when its first groups are picked.
STRIPS = 16
PACKED = "part int, dim int, n int, ids binary, rows binary, high binary, low binary"
CELLS = ["dim", "n", "ids", "rows", "high", "low"]
NONE = -(1 << 63)
LAST = (1 << 63) - 1


def _valid(table: DataFrame) -> DataFrame:
    """vec_id and embedding of the rows that take part, and lead: the places and signs of their largest components."""
    given = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    sized = F.array_sort(
        F.transform("embedding", lambda x, at: F.struct((-F.abs(x)).alias("size"), (2 * at + F.when(x > 0, 1).otherwise(0)).alias("side")))
    )
    lead = F.transform(F.slice(sized, 1, LEAD), lambda c: c["side"])
    return given.where(F.col("vec_id").isNotNull() & F.coalesce(finite, F.lit(False))).withColumn("lead", lead)


def _pack(size: int):
    """Rows of (vec_id, embedding) into blocks of ``size`` whole vectors; part numbers the partition they come from."""

    def packed(part: int, ids: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
        cells = [part, rows.shape[1], len(ids), ids.tobytes(), rows.tobytes(), rows.max(0).tobytes(), rows.min(0).tobytes()]
        kinds = [pa.int32(), pa.int32(), pa.int32(), *[pa.binary()] * 4]
        return pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(cells, kinds, strict=True)], ["part", *CELLS])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, ids, vectors = TaskContext.get().partitionId(), [], []
        for batch in batches:
            for vec_id, vector in zip(batch.column("vec_id").to_pylist(), batch.column("embedding"), strict=True):
                scaled = np.floor(SCALE * vector.values.to_numpy(zero_copy_only=False))
                if len(scaled) and np.abs(scaled).max() >= 2.0**62:
                    raise OverflowError(f"vector {vec_id} has a component that does not fit in 64 bits")
                ids.append(vec_id)
                vectors.append(scaled.astype(np.int64))
                if len(ids) == size:
                    yield packed(part, np.array(ids, np.int64), _stack(vectors))
                    ids, vectors = [], []
        if ids:
            yield packed(part, np.array(ids, np.int64), _stack(vectors))

    return rows


def _stack(vectors: list[np.ndarray]) -> np.ndarray:
    out = np.zeros((len(vectors), max(1, max(map(len, vectors)))), np.int64)
    for row, v in zip(out, vectors, strict=True):
        row[: len(v)] = v
    return out


def _wide(x: np.ndarray, dim: int) -> np.ndarray:
    return x if x.shape[-1] == dim else np.pad(x, [(0, 0)] * (x.ndim - 1) + [(0, dim - x.shape[-1])])


def _read(table: pa.Table, *columns: str) -> list[tuple[np.ndarray, ...]]:
    """The blocks of a table: each column as numbers, ``rows`` as a matrix."""
    out = []
    for row in table.to_pylist():
        cells = {c: np.frombuffer(row[c], np.int64) for c in columns}
        if "rows" in cells:
            cells["rows"] = cells["rows"].reshape(row["n"], row["dim"])
        out.append(tuple(cells[c] for c in columns))
    return out


def bounds(queries: np.ndarray, extremes: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """queries x blocks: no score in the block is higher. Exact: in floats only where these hold all sums."""
    dim = max([queries.shape[1], *(h.shape[0] for h, _ in extremes)])
    high, low = (np.stack([_wide(b[k], dim) for b in extremes]) for k in (0, 1))
    queries = _wide(queries, dim)
    kind = _kind(queries, dim, max(int(np.abs(high).max(initial=0)), int(np.abs(low).max(initial=0))))
    return np.maximum(queries, 0).astype(kind) @ high.T.astype(kind) + np.minimum(queries, 0).astype(kind) @ low.T.astype(kind)


def _kind(queries: np.ndarray, dim: int, most: int) -> type:
    return np.float64 if dim * max(1, most) * int(np.abs(queries).max(initial=0)) < 1 << 53 else object


def best(queries: np.ndarray, blocks: list, k: int, beat: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each query the k best (score, id), ties to the smaller id; NONE counts of missing ones. Last: blocks visited.

    blocks are (ids, rows, high, low). beat: scores that only higher or equal ones are of use against.
    """
    dim = max([queries.shape[1], *(b[1].shape[1] for b in blocks)])
    roofs = bounds(queries, [(b[2], b[3]) for b in blocks])
    queries = _wide(queries, dim)
    matrices = [_wide(b[1], dim) for b in blocks]
    kind = _kind(queries, dim, max(int(np.abs(m).max(initial=0)) for m in matrices))
    q = queries.astype(kind)
    order = np.argsort(-roofs, axis=1, kind="stable")
    scores = np.full((len(q), k), NONE, np.int64)
    ids = np.full((len(q), k), LAST, np.int64)
    floor = np.full(len(q), NONE, np.int64) if beat is None else beat.copy()
    visited = np.zeros(len(q), np.int64)
    active = np.arange(len(q))
    for turn in range(len(blocks)):
        at = order[active, turn]
        alive = roofs[active, at] >= floor[active]
        active, at = active[alive], at[alive]
        if not len(active):
            break
        visited[active] += 1
        for b in np.unique(at).tolist():
            who = active[at == b]
            exact = q[who] @ matrices[b].T.astype(kind)
            if kind is object and len(exact) and max(map(abs, exact.ravel().tolist())) > LAST:
                raise OverflowError("a score does not fit in 64 bits")
            found = exact.astype(np.int64)
            mask = found >= floor[who][:, None]
            some = np.flatnonzero(mask.any(1))
            if not len(some):
                continue
            who, found, mask = who[some], found[some], mask[some]
            width = int(mask.sum(1).max())
            keep = np.argsort(~mask, axis=1, kind="stable")[:, :width]
            inside = np.take_along_axis(mask, keep, 1)
            new_scores = np.where(inside, np.take_along_axis(found, keep, 1), NONE)
            new_ids = np.where(inside, blocks[b][0][keep], LAST)
            all_scores, all_ids = np.concatenate([scores[who], new_scores], 1), np.concatenate([ids[who], new_ids], 1)
            top = np.lexsort((all_ids, ~all_scores), axis=1)[:, :k]
            scores[who], ids[who] = np.take_along_axis(all_scores, top, 1), np.take_along_axis(all_ids, top, 1)
            floor[who] = np.maximum(floor[who], scores[who, -1])
    return scores, ids, visited


FOUND = "c int, query_id long, q_at int, vec_id long, score long"


def _search(k: int):
    """Of a chunk of queries and a group of blocks: the rows of each query's k best that beat what it has."""

    def pair(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        blocks = _read(right, "ids", "rows", "high", "low")
        columns: list[list[np.ndarray]] = [[], [], [], []]
        for own, rows, beat in _read(left, "ids", "rows", "beat") if blocks else []:
            scores, ids, _ = best(rows, blocks, k, beat)
            there = scores > NONE
            for column, x in zip(
                columns,
                (np.repeat(own, there.sum(1)), np.repeat(np.arange(len(own)), there.sum(1)), ids[there], scores[there]),
                strict=True
            ):
                column.append(x)
        made = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in columns]
        return pa.table(
            {
                "c": pa.array([key[0].as_py()] * len(made[0]), pa.int32()),
                "query_id": made[0],
                "q_at": pa.array(made[1], pa.int32()),
                "vec_id": made[2],
                "score": made[3]
            }
        )

    return pair


PROMISES = "c int, g int, strip int, mean double, reached boolean"


def _promise(strip: int):
    """Of a chunk and a group's extremes, for each strip of queries: the mean of their highest bounds, and whether any reaches what it has to beat."""

    def pair(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        extremes = _read(right, "high", "low")
        columns: list[list] = [[], [], []]
        for rows, beat in _read(left, "rows", "beat") if extremes else []:
            top = bounds(rows, extremes).max(1)
            heads = np.arange(0, len(top), strip)
            sizes = np.diff(np.append(heads, len(top)))
            columns[0] += range(len(heads))
            columns[1] += (np.add.reduceat(top.astype(np.float64), heads) / sizes).tolist()
            columns[2] += np.logical_or.reduceat(np.asarray(top >= beat, bool), heads).tolist()
        own = [pa.array([key[k].as_py()] * len(columns[0]), pa.int32()) for k in (0, 1)]
        kinds = (pa.int32(), pa.float64(), pa.bool_())
        return pa.table([*own, *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], ["c", "g", "strip", "mean", "reached"])

    return pair


def _paired(chunks: DataFrame, n_groups: int, groups: DataFrame, n_chunks: int, made, schema: str) -> DataFrame:
    """Every chunk with every group's extremes."""
    left = chunks.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(n_groups - 1)))).groupBy("c", "g")
    right = groups.select("g", "dim", "n", "high", "low").withColumn(
        "c", F.explode(F.sequence(F.lit(0), F.lit(n_chunks - 1)))
    ).groupBy("c", "g")
    return left.cogroup(right).applyInArrow(made, schema)


def _scored(pairs: DataFrame, chunks: DataFrame, groups: DataFrame, k: int) -> DataFrame:
    """Pairs (c, g) with the chunks' queries and the groups' rows."""
    left = pairs.select("c", "g").join(chunks, "c").groupBy("c", "g")
    right = pairs.select(
        F.col("c").alias("with_c"), F.col("g").alias("with_g")
    ).join(groups, F.col("with_g") == F.col("g")).drop("g").groupBy("with_c", "with_g")
    return left.cogroup(right).applyInArrow(_search(k), FOUND)


def _best_rows(found: DataFrame, k: int) -> DataFrame:
    """Each query's k best rows."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def _raised(chunks: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """The chunks with their queries' k-th scores as what is to be beaten."""
    kth = found.groupBy("c", "q_at").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("kth")).where(F.col("n") >= k)
    lists = kth.groupBy("c").agg(F.collect_list(F.struct("q_at", "kth")).alias("kths"))  # a chunk's queries at most

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            beats = []
            for beat, kths in zip(batch.column("beat"), batch.column("kths").to_pylist(), strict=True):
                own = np.frombuffer(beat.as_buffer(), np.int64).copy()
                for x in kths or ():
                    own[x["q_at"]] = x["kth"]
                beats.append(own.tobytes())
            at = batch.schema.get_field_index("beat")
            yield batch.set_column(at, "beat", pa.array(beats, pa.binary())).drop_columns(["kths"])

    return chunks.join(lists, "c", "left").mapInArrow(rows, chunks.schema)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, block: int = 64, chunk: int = 1024, group: int = 16384) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k best vectors by integer inner product.

    Both tables have vec_id and embedding; components become floor(64 * x). Vectors that are null, hold null or
    non-finite components, or have a null vec_id take no part; shorter ones count as filled with zeros. Queries are
    rows of the vectors: one row of the query's own vec_id and vector is left out. Ties go to the smaller vec_id;
    fewer candidates give fewer rows. A vec_id that repeats among the queries is asked once, with its least vector;
    among the candidates each row counts. A component or score that does not fit in 64 bits is an error. Columns
    besides vec_id and embedding are not read.
    """
    asked = _valid(queries).groupBy("vec_id").agg(F.min(F.struct("embedding", "lead")).alias("x")).select("vec_id", "x.embedding", "x.lead")
    known = _valid(vectors)
    n_groups = max(1, math.ceil(vectors.agg(F.count(F.lit(1))).first()[0] / group))
    n_chunks = max(1, math.ceil(asked.agg(F.count(F.lit(1))).first()[0] / chunk))
    packed = lambda rows, n, size: rows.repartitionByRange(n, "lead", "vec_id").sortWithinPartitions("lead", "vec_id").mapInArrow(_pack(size), PACKED)
    groups = stored(packed(known, n_groups, block).withColumnRenamed("part", "g"), "op9-blocks")
    chunks = stored(packed(asked, n_chunks, chunk), "op9-queries")
    # each pack is a chunk; chunks are numbered by their partitions and first ids alone
    headed = chunks.withColumn("head", F.substring("ids", 1, 8))
    number = (F.row_number().over(Window.orderBy("part", "head")) - 1).cast("int")
    numbers = headed.select("part", "head", number.alias("c"))
    nothing = F.expr(f"CAST(repeat(unhex('{np.int64(NONE).tobytes().hex()}'), n) AS BINARY)")
    numbered = headed.join(numbers, ["part", "head"]).select("c", *CELLS, nothing.alias("beat"))
    n_groups = (groups.agg(F.max("g")).first()[0] or 0) + 1
    chunks_at, n_chunks = stored(numbered, "op9-chunks"), max(1, chunks.count())
    dropped(chunks)
    depth = k + 1  # the query's own row is among them
    promise = _promise(max(1, chunk // STRIPS))
    promises = _paired(chunks_at, n_groups, groups, n_chunks, promise, PROMISES)
    home = stored(
        promises.groupBy("c", "strip").agg(F.max_by("g", F.struct("mean", "g")).alias("g")).select("c", "g").distinct(), "op9-home"
    )
    first = stored(_scored(home, chunks_at, groups, depth), "op9-first")
    raised = stored(_raised(chunks_at, first, depth), "op9-raised")
    open_ = _paired(raised, n_groups, groups, n_chunks, promise, PROMISES).where("reached").select("c", "g").distinct()
    open_ = stored(open_.join(home, ["c", "g"], "left_anti"), "op9-open")
    rest = _scored(open_, raised, groups, depth)
    found = _best_rows(first.unionByName(rest), depth)
    squares = _own_scores(asked)
    own = F.row_number().over(
        Window.partitionBy("query_id", (F.col("vec_id") == F.col("query_id")) & (F.col("score") == F.col("own_score"))).orderBy("place")
    )
    marked = found.join(squares, "query_id").withColumn(
        "mine", (F.col("vec_id") == F.col("query_id")) & (F.col("score") == F.col("own_score")) & (own == 1)
    )
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("place"))
    return marked.where("NOT mine").withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _own_scores(asked: DataFrame) -> DataFrame:
    """query_id and own_score: the query's product with itself (a score that does not fit was an error before)."""
    scaled = F.transform("embedding", lambda x: F.floor(SCALE * x).cast("decimal(20,0)"))
    total = F.aggregate(scaled, F.lit(0).cast("decimal(38,0)"), lambda s, x: (s + x * x).cast("decimal(38,0)"))
    return asked.select(F.col("vec_id").alias("query_id"), total.cast("long").alias("own_score"))
