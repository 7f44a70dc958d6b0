"""Connected components of an edge table by alternating star contractions, all in DataFrame joins."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, settled, stored


def stars(links: Iterable[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The links that a task holds, contracted: each node but the least of its set, and that least one."""
    held = [x for x in links if len(x[0])]
    if not held:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    ends = [np.concatenate([x[k] for x in held]) for k in (0, 1)]
    nodes, places = np.unique(np.concatenate(ends), return_inverse=True)
    a, b = places[: len(ends[0])], places[len(ends[0]) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        after = root.copy()
        np.minimum.at(after, root[a], low)
        np.minimum.at(after, root[b], low)
        while (after[after] != after).any():
            after = after[after]
        if (after == root).all():
            break
        root = after
    moved = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[moved], nodes[root[moved]]


def components(edges: DataFrame) -> DataFrame:
    """Rows (node, root) for every node of ``edges`` (a, b: longs); root is the least node that can be reached.

    Each round: every node's greater neighbours are linked to the least node in its neighbourhood, then every node
    and its smaller neighbours are. A round either changes the links or the search is over, and stars are all that
    is left after about log(n) rounds. A node of any degree is handled by aggregates with map-side combining and
    joins whose hot side can be split. Each round is written to the shared folder, and read in as many partitions as
    its bytes ask for: few links are contracted without any exchange.
    """
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    mark = None
    while True:
        own = settled(now)
        both = own.unionByName(own.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        upward = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = stored(upward.where("a <> b").distinct(), "links")
        # every edge now points from the greater node to the smaller
        own = settled(large)
        least = own.groupBy("a").agg(F.min("b").alias("m"))
        between = own.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        small = stored(between.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "links")
        dropped(now, large)
        now = small
        new = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if new == mark:
            break
        mark = new
    roots = settled(now).groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
