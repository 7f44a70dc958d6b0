"""Shards of equal row counts that keep equal texts together: balanced label propagation, in DataFrame operations only.

Documents of equal text are linked. Documents of one group that have the same label are interchangeable, so the
state is kept per cell (group, first label, label) with a count: copies are never expanded. In each round every
cell looks at its group's most frequent label (of equals, that of the emptiest shard; later on room counts for more)
and asks to move there; a shard admits what its quota of linked rows allows, whole groups at a time by a seeded hash.
A group of over a sixteenth of a shard is too coarse for that. There are at most 16 such groups a shard whatever the
table's size, so the driver gives them shards by their counts: a group stays whole if it fits in a shard, and a larger
one takes whole shards and a rest. At the end shards above their exact size hand over documents without links first;
rows of large groups are ranked by doc_id, which bounds every key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, stored

BUCKETS = 1024
#: Groups of over this part of a shard are placed by their counts: at most COARSE x shards.
COARSE = 16


def _unit(*columns: Column | str) -> Column:
    """A number in [0, 1) from the hash of columns."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 11) * F.lit(2.0**-53)


def _lookup(values: list[float], index: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), index)


def _packed(sizes: list[int], exact: list[int]) -> list[list[tuple[int, int]]]:
    """For each group its (shard, rows), largest group first. Of two fits the one that splits fewer rows is taken."""
    return min(
        (_fitted(sizes, exact, tight) for tight in (True, False)),
        key=lambda found: sum(sum(n for _, n in parts) for parts in found if len(parts) > 1)
    )


def _fitted(sizes: list[int], exact: list[int], tight: bool) -> list[list[tuple[int, int]]]:
    """Whole shards for what exceeds one, then the rests, each in the fullest (or else the emptiest) shard that has room; those without one are split last."""
    room, out, rests = list(exact), [[] for _ in sizes], []

    def put(at: int, k: int, n: int) -> None:
        room[k] -= n
        out[at].append((k, n))

    for at, size in enumerate(sizes):
        while size > max(exact):
            k = room.index(max(room))
            if room[k] < exact[k]:
                break
            put(at, k, room[k])
            size -= exact[k]
        rests.append((size, at))
    late = []
    for size, at in sorted(rests, key=lambda r: (-r[0], r[1])):
        fits = [k for k in range(len(room)) if room[k] >= size]
        if fits:
            put(at, (min if tight else max)(fits, key=lambda k: (room[k], -k)), size)
        else:
            late.append((size, at))
    for size, at in late:
        for k in sorted(range(len(room)), key=lambda k: (-room[k], k)):
            n = min(size, room[k])
            if n:
                put(at, k, n)
                size -= n
    return [[p for p in parts if p[1]] for parts in out]


def assign(documents: DataFrame, shards: int = 16, rounds: int = 8, slack: float = 0.02, seed: int = 5) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for each row; the law is ``rows``.

    Shards differ by one row at most; slots are gapless from 0 in each. size: UTF-8 bytes of the text and 1 (a null
    text is empty, and equals other empty texts). Repeated rows are rows of their own. A null doc_id is a value
    like any other. A very long text counts by its bytes and travels as a hash. An empty table gives an empty result.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # a number of its own for each row, stored with it: rows without a doc_id are told apart by it when they are ranked
    rows = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.monotonically_increasing_id().alias("row"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64(text).alias("same")
    )
    base = stored(rows.withColumn("first", F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(shards)).cast("int")), "op4-base")
    group = ["same", "text_crc32", "size"]
    counts = base.groupBy(*group, "first").count().groupBy(*group).agg(F.sum("count").alias("many"))
    n = base.count()
    if n == 0:
        return _shape(base.withColumns({"shard": F.lit(0), "slot": F.lit(0).cast("long")}))
    linked = stored(counts.where("many > 1").withColumn("unit", F.xxhash64(*group)), "op4-linked")
    exact = [n // shards + (k < n % shards) for k in range(shards)]
    large = sorted(
        ((r["unit"], r["many"]) for r in linked.where(F.col("many") > n // shards // COARSE).select("unit", "many").collect()),
        key=lambda g: (-g[1], g[0])
    )
    parts = dict(zip((u for u, _ in large), _packed([m for _, m in large], exact), strict=True))
    home = F.try_element_at(
        F.create_map(*[F.lit(x) for u, p in parts.items() for x in (u, p[0][0] if len(p) == 1 else -1)]), F.col("unit")
    ) if parts else F.lit(None).cast("int")
    tagged = stored(base.join(linked.withColumn("home", home).drop("many"), group, "left").drop("same"), "op4-tagged")
    dropped(base)
    dropped(linked)
    free = [e - sum(m for p in parts.values() for at, m in p if at == k) for k, e in enumerate(exact)]
    cells = tagged.where("unit IS NOT NULL AND home IS NULL").groupBy("unit", "first").agg(F.count(F.lit(1)).alias("n"))
    cells = stored(cells.withColumn("label", _dealt(free, seed) if parts and sum(free) else F.col("first")), "op4-cells")
    roofs = [f * (1 - slack) for f in free]  # for linked rows: the others make room at the end
    loads, behind = [0] * shards, cells
    for turn in range(rounds):
        tally = cells.groupBy("unit", "label").agg(F.sum("n").alias("here"))
        room = [max(0.0, roof - load) / (n / shards * (1 - slack)) for roof, load in zip(roofs, loads, strict=True)]
        pull = F.col("here") + _lookup(room, F.col("label")) * (
            F.lit(0.9) if turn < rounds // 2 else F.sum("here").over(Window.partitionBy("unit"))
        )
        best = tally.withColumn("pull", pull).groupBy("unit").agg(
            F.max_by("label", F.struct("pull", F.xxhash64("unit", "label"))).alias("best")
        )
        asking = stored(cells.join(best, "unit"), "op4-asking")
        flows = {(r["label"], r["best"]): r["n"] for r in asking.groupBy("label", "best").agg(F.sum("n").alias("n")).collect()}  # shards x shards
        dropped(behind)
        behind = asking
        loads, coming, going = (
            [sum(n for pair, n in flows.items() if k == pair[end] and (not moving or pair[0] != pair[1])) for k in range(shards)] for end,
            moving in ((0, False), (1, True), (0, True))
        )
        if not sum(coming):
            cells = asking
            break
        admit = [
            min(1.0, max(0.0, (roof - load + out / 2) / come)) if come else 0.0 for roof,
            load,
            out,
            come in zip(roofs, loads, going, coming, strict=True)
        ]
        moved = F.when(_unit(F.lit(seed + turn), "unit") < _lookup(admit, F.col("best")), F.col("best")).otherwise(F.col("label"))
        cells = asking.select("unit", "first", "n", moved.alias("label"))
    split = {u: p for u, p in parts.items() if len(p) > 1}
    rest = tagged.where("coalesce(home, 0) >= 0") if split else tagged
    placed = rest.join(
        cells.select("unit", "first", "label"), ["unit", "first"], "left"
    ).withColumn("label", F.coalesce("home", "label", "first"))
    return _shape(_balanced(placed.unionByName(_split(tagged.where("home = -1"), split, seed)) if split else placed, n, shards, seed))


def _by_row(seed: int) -> Column:
    """A hash of doc_id and text; of rows without a doc_id, of their own number, as those of one text are interchangeable."""
    known = F.xxhash64(F.lit(seed), "doc_id", "text_crc32", "size")
    return F.when(F.col("doc_id").isNull(), F.xxhash64(F.lit(seed), "text_crc32", "size", "row")).otherwise(known)


def _dealt(free: list[int], seed: int) -> Column:
    """A first label for each cell, in proportion to the room that large groups leave."""
    at = _unit(F.lit(seed + 2), "unit", "first") * F.lit(float(sum(free)))
    label = F.lit(max(k for k, f in enumerate(free) if f))
    for k in reversed(range(len(free))):
        label = F.when(at < float(sum(free[: k + 1])), F.lit(k)).otherwise(label) if free[k] else label
    return label


def _split(rows: DataFrame, split: dict[int, list[tuple[int, int]]], seed: int) -> DataFrame:
    """Labels for the rows of split groups: as many for each shard as it was given, in the order of a hash."""
    ends = {u: [(sum(m for _, m in p[: i + 1]), k) for i, (k, _) in enumerate(p)] for u, p in split.items()}
    ranked = _ranked(rows.withColumn("order", _by_row(seed + 1)).withColumn("bucket", _bucket()), "unit", "op4-split")
    label = F.lit(None).cast("int")
    for u, own in ends.items():
        inside = F.lit(own[-1][1])
        for end, k in reversed(own[:-1]):
            inside = F.when(F.col("rank") < end, F.lit(k)).otherwise(inside)
        label = F.when(F.col("unit") == u, inside).otherwise(label)
    return ranked[0].withColumn("label", label).drop("order", "bucket", "ahead", "rank")


def _loads(rows: DataFrame, shards: int) -> list[int]:
    """n by label, as a list: one number a shard."""
    found = {r["label"]: r["n"] for r in rows.collect()}
    return [int(found.get(k, 0)) for k in range(shards)]


def _bucket() -> Column:
    return F.shiftrightunsigned("order", 64 - BUCKETS.bit_length() + 1)


def _ranked(keyed: DataFrame, key: str, label: str) -> tuple[DataFrame, DataFrame]:
    """The rows with their rank in the key, by bucket and order, and the number of rows by key and bucket."""
    keyed = stored(keyed, label)
    buckets = stored(keyed.groupBy(key, "bucket").agg(F.count(F.lit(1)).alias("n")), f"{label}-buckets")
    starts = buckets.select(
        key,
        "bucket",
        F.coalesce(
            F.sum("n").over(Window.partitionBy(key).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("ahead")
    )
    own = F.row_number().over(Window.partitionBy(key, "bucket").orderBy("order", "unit", "doc_id", "text_crc32", "size")) - 1
    return keyed.join(starts, [key, "bucket"]).withColumn("rank", F.col("ahead") + own), buckets


def _balanced(rows: DataFrame, n: int, shards: int, seed: int) -> DataFrame:
    """Exact sizes. Documents are ranked in each shard, those of large groups first, those without links last; ranks beyond the shard's size go where there is room."""
    large = F.col("home").isNotNull()
    order = F.when(~large & F.col("unit").isNotNull(), F.xxhash64(F.lit(seed), "unit")).otherwise(_by_row(seed))
    kind = F.when(large, 0).when(F.col("unit").isNotNull(), 1).otherwise(2)
    ranked, buckets = _ranked(rows.withColumn("order", order).withColumn("bucket", kind * BUCKETS + _bucket()), "label", "op4-keyed")
    loads = _loads(buckets.groupBy("label").agg(F.sum("n").alias("n")), shards)
    exact = [n // shards + (k < n % shards) for k in range(shards)]
    over, room = [max(0, a - b) for a, b in zip(loads, exact, strict=True)], [max(0, b - a) for a, b in zip(loads, exact, strict=True)]
    surplus = _lookup([sum(over[:k]) - exact[k] for k in range(shards)], F.col("label")) + F.col("rank")
    shard, slot = F.lit(shards - 1), F.lit(0).cast("long")
    for k in reversed(range(shards)):  # surplus documents fill the rooms from the first shard on
        if room[k]:
            inside = F.col("surplus") < sum(room[: k + 1])
            shard, slot = F.when(inside, k).otherwise(shard), F.when(inside, F.col("surplus") - sum(room[:k]) + loads[k]).otherwise(slot)
    stays = F.col("rank") < _lookup(exact, F.col("label"))
    return ranked.withColumn("surplus", surplus).withColumns(
        {"shard": F.when(stays, F.col("label")).otherwise(shard), "slot": F.when(stays, F.col("rank")).otherwise(slot)}
    )


def _shape(rows: DataFrame) -> DataFrame:
    return rows.select(
        "doc_id",
        "size",
        F.col("text_crc32").cast("long").alias("text_crc32"),
        F.lit("rows").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard")
    )
