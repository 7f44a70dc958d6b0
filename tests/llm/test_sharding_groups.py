"""Groups of equal texts that fit in a shard stay in one; larger ones take whole shards and a rest."""

import random

from sieveline.llm import sharding

from .test_op1_op4_op5_op7 import make, shards_hold


def homes(spark, rows):
    got = sharding.assign(make(spark, rows)).collect()
    shards_hold(rows, got)
    text, home = {i: t for i, t, _ in rows}, {}
    for r in got:
        home.setdefault(text[r.doc_id], []).append(r.shard)
    return home


def test_groups_up_to_a_shard_stay_whole(spark):
    sizes = [100, 99, 90, 62, 62, 40, 38, 26, 26, 25, 25, 17, 16, 230]  # a shard has 100 rows
    rows = [(1000 * g + i, f"group {g}", "a") for g, n in enumerate(sizes) for i in range(n)]
    rows += [(100_000 + i, f"pair {i // 2}", "a") for i in range(300)]
    rows += [(200_000 + i, f"alone {i}", "a") for i in range(1600 - len(rows))]
    random.Random(6).shuffle(rows)
    home = homes(spark, rows)
    assert [len(set(home[f"group {g}"])) for g in range(len(sizes) - 1)] == [1] * (len(sizes) - 1)
    shards = home[f"group {len(sizes) - 1}"]
    assert sorted(shards.count(k) for k in set(shards)) == [30, 100, 100]
    assert sum(len(set(s)) > 1 for t, s in home.items() if t.startswith("pair")) <= 3


def test_groups_that_fit_nowhere_are_split_exactly(spark):
    rows = [(1000 * g + i, f"group {g}", "a") for g in range(20) for i in range(80)]
    home = homes(spark, rows)
    assert sum(len(set(s)) == 1 for s in home.values()) == 16
    assert sharding._packed([7, 4, 3], [3, 3, 3, 3, 2])[0][:2] == [(0, 3), (1, 3)]
