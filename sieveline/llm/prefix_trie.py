"""The trie of conversations that share their first turns, a row for each node, without walking the trie.

Of the conversations that pass through a node the one of smallest id owns it. Who owns a node owns all of its own path
below, so each conversation owns a path's end, from some depth on, and (owner, depth) names a node. Sums over a subtree
then need no recursion: of each member that passes through a node, the tokens from there on count as often as they
occur, and once for each node that it owns; childless nodes count at their owner. One group-by of the prefixes adds up
the difference.

A prefix is known by its depth and the sums of four hashes of 32 bits of each of its (place, role, text), 128 bits in
all: sums are cumulative windows, and no conversation or node has to be in one place. Windows run over blocks of
4,096 turns, with the sums of earlier blocks added; what many conversations share is combined before it is
shuffled. Owners are found by an aggregate and marked by a join whose hot side Spark can split, as a window over a
prefix could not be split.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, stored

BLOCK = 4096
#: Turns that a conversation takes from the first of its hundred, at most.
HEADS = 6
NODE = ["depth", "p1", "p2"]
EMPTY = hashlib.sha256().hexdigest()


def placed_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, place (from 1), role, text_md5 and tokens (code points) of each turn with a conv_id, in order of turn (null first), role and text_md5."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.shiftright(F.col("turn").cast("long"), 12).alias("block"),
        role.alias("role"),
        F.md5(text).alias("text_md5"),
        F.char_length(text).cast("long").alias("tokens")
    )
    turns = stored(turns, "op12-turns")
    counts = turns.groupBy("conv_id", "block").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("block")).rowsBetween(Window.unboundedPreceding, -1)
    ahead = counts.select("conv_id", "block", F.sum("n").over(earlier).alias("ahead")).where("ahead > 0").alias("a")
    within = F.row_number().over(Window.partitionBy("conv_id", "block").orderBy(F.asc_nulls_first("turn"), "role", "text_md5"))
    own = turns.withColumn("within", within).alias("t").join(ahead, F.expr("t.conv_id = a.conv_id AND t.block <=> a.block"), "left")
    return stored(
        own.select("t.conv_id", (F.col("within") + F.coalesce("ahead", F.lit(0))).alias("place"), "role", "text_md5", "tokens"), "op12-placed"
    )


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The conversations (conv_id, length) and their rebuilt turns (conv_id, length, depth from 1, role, text_md5, tokens).

    A conversation starts with the first turns of the first one of its hundred, as many as a checksum of its id says, and goes on with its own.
    """
    own = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("own"))
    named = own.select(
        "conv_id", "own", (F.col("conv_id") - F.col("conv_id") % 100).alias("head"), (F.crc32(F.col("conv_id").cast("string")) % HEADS).alias("h")
    )
    heads = own.select(F.col("conv_id").alias("head"), F.col("own").alias("there"))
    taken = F.least("h", F.coalesce("there", F.lit(0)))
    convs = named.join(heads, "head", "left").select(
        "conv_id", "head", "h", taken.alias("taken"), (taken + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("length")
    )
    convs = stored(convs, "op12-convs")
    rest = ["role", "text_md5", "tokens"]
    behind = turns.join(convs, "conv_id").where("place > h").select(
        "conv_id", "length", (F.col("place") - F.col("h") + F.col("taken")).alias("depth"), *rest
    )
    first = turns.where((F.col("place") < HEADS) & (F.col("conv_id") % 100 == 0)).withColumnRenamed("conv_id", "head")
    front = first.join(convs.where("taken > 0"), "head").where("place <= taken").select(
        "conv_id", "length", F.col("place").alias("depth"), *rest
    )
    return convs.select("conv_id", "length"), front.unionByName(behind)


def _lanes(salt: int) -> list[Column]:
    own = F.xxhash64(F.lit(salt), "depth", "role", "text_md5")
    return [own.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(own, 32)]


def _prefixes(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """conv_id, length, depth, p1, p2, before (the tokens of earlier turns) and tokens; depth 0, the root, included."""
    lanes = ["a", "b", "c", "d"]
    values = dict(zip(lanes, [*_lanes(1), *_lanes(2)], strict=True))
    turns = turns.withColumns(values | {"block": F.shiftright("depth", 12)})
    turns = stored(turns.select("conv_id", "length", "depth", "block", *lanes, "tokens"), "op12-rebuilt")
    sums = turns.where(F.col("length") >= BLOCK).groupBy("conv_id", "block").agg(*[F.sum(x).alias(x) for x in (*lanes, "tokens")])
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ahead = sums.select("conv_id", "block", *[F.coalesce(F.sum(x).over(earlier), F.lit(0)).alias(f"{x}0") for x in (*lanes, "tokens")])
    so_far = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    running = turns.select("conv_id", "length", "depth", "block", "tokens", *[F.sum(x).over(so_far).alias(f"{x}1") for x in (*lanes, "tokens")])
    whole = running.join(ahead, ["conv_id", "block"], "left")
    total = lambda x: F.col(f"{x}1") + F.coalesce(f"{x}0", F.lit(0))
    nodes = whole.select(
        "conv_id", "length", "depth", F.xxhash64("depth", total("a"), total("b")).alias("p1"), F.xxhash64("depth", total("c"), total("d")).alias("p2"),
        (total("tokens") - F.col("tokens")).alias("before"), "tokens"
    )
    none = F.lit(0).cast("long")
    return nodes.unionByName(convs.select("conv_id", "length", *[none.alias(c) for c in ("depth", "p1", "p2", "before", "tokens")]))


def trie(conversations: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of each node; see the module.

    The remainder of a negative conv_id is negative. Null roles and texts are empty; turns of one number (or none) stand in order of role and of the text's MD5; rows
    that repeat are turns of their own. Rows without a conv_id are left out, as no conversation can be named by them.
    A very long text counts by its code points and travels as its MD5; a conversation of any length is taken in blocks.
    An empty table gives an empty result.
    """
    turns = placed_turns(conversations)
    convs, both = rebuilt(turns)
    steps = stored(_prefixes(convs, both), "op12-steps")
    # stored, so that both sides of the join are dealt out for it: a side that an aggregate has dealt out can't be split
    owners = stored(steps.groupBy(*NODE).agg(F.min("conv_id").alias("owner"), F.max("length").alias("longest")), "op12-owners")
    marked = stored(steps.join(owners, NODE), "op12-marked")
    mine = F.col("owner") == F.col("conv_id")
    own = marked.groupBy("conv_id").agg(
        F.min(F.when(mine, F.col("depth"))).alias("from_depth"),
        F.coalesce(F.min(F.when(mine, F.col("before"))), F.max(F.col("before") + F.col("tokens"))).alias("shared"),
        F.max(F.when(~mine, F.col("owner"))).alias("above"),  # owners rise along a path: the last of those before
        F.max((mine & (F.col("depth") == F.col("length")) & (F.col("longest") == F.col("depth"))).cast("long")).alias("leaf")
    )
    parent = F.when(F.col("depth") > F.col("from_depth"), F.col("conv_id")).when(F.col("depth") > 0, F.col("above"))
    below = (F.col("depth") < F.col("length")) & (F.col("depth") + 1 >= F.col("from_depth"))
    nodes = marked.join(own, "conv_id").groupBy(*NODE).agg(
        F.min(F.struct(F.col("conv_id"), parent.alias("parent"))).alias("top"),
        F.count(F.lit(1)).alias("n_convs"),
        F.count_if(below).alias("n_children"),
        F.sum("leaf").alias("n_leaves"),
        F.sum(F.greatest(F.col("shared") - F.col("before"), F.lit(0))).alias("saved_tokens")
    )
    return nodes.join(_ends(marked), NODE, "left").select(
        F.col("top.conv_id").alias("conv_id"), "depth", F.col("top.parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
        "saved_tokens", F.coalesce("sha", F.lit(EMPTY)).alias("ends_sha256")
    )


def _ends(marked: DataFrame) -> DataFrame:
    """Of each node where conversations end, the SHA-256 of their ids: chunks of 4,096 numbers are joined first, and a task hashes them as they come."""
    ends = marked.where("depth = length").select(*NODE, "conv_id", F.shiftright("conv_id", 12).alias("chunk"))
    ids = F.concat_ws(",", F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")))
    chunks = ends.groupBy(*NODE, "chunk").agg(ids.alias("ids"))
    ordered = chunks.repartition(*NODE).sortWithinPartitions(*NODE, "chunk")
    return ordered.mapInArrow(_hashed, "depth long, p1 long, p2 long, sha string")


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    node, digest = None, hashlib.sha256()
    names = ["depth", "p1", "p2", "sha"]
    for batch in batches:
        out: list[tuple] = []
        for *now, ids in zip(*[batch.column(batch.schema.get_field_index(c)).to_pylist() for c in (*NODE, "ids")], strict=True):
            if now != node:
                if node:
                    out.append((*node, digest.hexdigest()))
                node, digest = now, hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(ids.encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], names)
    if node:
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*node, digest.hexdigest())], names)
