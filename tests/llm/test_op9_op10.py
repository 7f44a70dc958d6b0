import random
import re

import numpy as np
import pytest
import xxhash

from sieveline.llm.components import components, stars
from sieveline.llm.simhash import KINDS, near_duplicates, neighbours, refined, tallied
from sieveline.llm import topk
from sieveline.llm.common import stored
from sieveline.llm.topk import best, top_k


def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints):
    comp = {i: i for i in prints}
    changed = True
    while changed:
        changed = False
        for a in prints:
            for b in prints:
                if (prints[a] ^ prints[b]).bit_count() <= 2 and comp[a] != comp[b]:
                    comp[a] = comp[b] = min(comp[a], comp[b])
                    changed = True
    return comp


def test_near_duplicates_equal_brute_force(spark):
    rnd = random.Random(5)
    base = [" ".join(rnd.choice("abcdefg") * rnd.randint(1, 3) for _ in range(rnd.choice([4, 60, 900]))) for _ in range(25)]
    texts = [None, "", "\t", "one", "One two", "Élan É", *base]
    for t in base:
        for _ in range(3):
            w = t.split()
            w[rnd.randrange(len(w))] = rnd.choice(["q", "r", "A"])
            texts.append(" ".join(w))
    ids = rnd.sample(range(1000), len(texts))
    df = spark.createDataFrame([(i, t, 0, "k") for i, t in zip(ids, texts, strict=True)], "doc_id long, text string, fp int, root string")
    got = near_duplicates(df).collect()
    prints = {i: brute_print(t) for i, t in zip(ids, texts, strict=True)}
    assert {r.doc_id: r.fingerprint for r in got} == {i: f"{p:016x}" for i, p in prints.items()}
    want = brute_components(prints)
    assert {r.doc_id: r.component_id for r in got} == want
    assert len(set(want.values())) < len(want) - 20


def test_near_duplicates_edges(spark):
    schema = "doc_id long, text string"
    assert near_duplicates(spark.createDataFrame([], schema)).count() == 0
    got = near_duplicates(spark.createDataFrame([(None, "a b c"), (7, "A b c"), (7, "A b c"), (3, None)], schema)).collect()
    assert sorted((r.doc_id or 0, r.component_id) for r in got) == [(0, 7), (3, 3), (7, 7), (7, 7)]


def grouped(members, links):
    comp = list(range(len(members)))
    at = {int(m): i for i, m in enumerate(members)}
    for x, y in links:
        for a, b in zip(x.tolist(), y.tolist(), strict=True):
            one, two = comp[at[a]], comp[at[b]]
            comp = [one if c == two else c for c in comp]
    return comp


def as_sets(comp):
    return sorted(sorted(i for i, c in enumerate(comp) if c == k) for k in set(comp))


@pytest.mark.parametrize("spread", [8, 14, 32])
def test_long_lists_give_what_all_pairs_give(spread):
    """900 fingerprints alike in two pieces: lists that stay long after the cut, that get short, and sparse ones."""
    rnd = np.random.default_rng(spread)
    bits = rnd.choice(32, spread, replace=False) if spread < 32 else np.arange(32)
    codes = set()
    while len(codes) < min(900, 2**spread - 1):
        codes.add(int(sum(1 << int(b) for b in bits if rnd.random() < (0.5 if spread < 32 else 0.06))))
    members = np.array([0x1122334400000000 ^ (c << 32) ^ 0x55667788 for c in sorted(codes)], np.uint64)  # pieces 0 and 1 shared
    got = grouped(members, refined(members, KINDS.index((0, 1))))
    want = brute_components({i: int(m) for i, m in enumerate(members)})
    assert as_sets(got) == as_sets([want[i] for i in range(len(members))])
    all_pairs = [*tallied(members, np.array([0]), np.array([len(members)]))]
    assert all(int(d).bit_count() <= 2 for x, y in all_pairs for d in x ^ y)
    assert as_sets(grouped(members, all_pairs)) == as_sets(got)
    a, b = stars(refined(members, KINDS.index((0, 1))))
    assert len(a) < len(members) and (b < a).all() and as_sets(grouped_stars(members, a, b)) == as_sets(got)


def grouped_stars(members, a, b):
    at = {int(m): i for i, m in enumerate(members)}
    comp = list(range(len(members)))
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        comp[at[x]] = at[y]
    return comp


def test_neighbours_of_many_codes():
    free = (5, 7)
    codes = np.random.default_rng(1).choice(1 << 16, 900, replace=False).astype(np.uint64)
    members = np.uint64(0x11) | ((codes & np.uint64(255)) << np.uint64(40)) | ((codes >> np.uint64(8)) << np.uint64(56))
    got = [*neighbours(members, free)]
    assert sum(len(x) for x, _ in got) < len(members)
    want = brute_components({i: int(m) for i, m in enumerate(members)})
    assert as_sets(grouped(members, got)) == as_sets([want[i] for i in range(len(members))])


def test_components_of_chains_and_stars(spark):
    edges = [(i + 1, i) for i in range(100, 160)] + [(7, k) for k in range(500, 700)] + [(-5, -9), (-9, -5), (3, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(100, 161)} == {100} and {got[i] for i in range(500, 700)} == {7} and got[-5] == -9
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_top(rows, k, every):
    vectors = [
        (i, np.floor(64 * np.array(v, float)).astype(int)) for i,
        v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)
    ]
    out, seen = set(), set()
    for at, (qi, q) in enumerate(vectors):
        if qi % every == 0 and qi not in seen:
            seen.add(qi)
            m = lambda v: int(sum(a * b for a, b in zip(q.tolist(), v.tolist(), strict=False)))
            best = sorted((-m(v), i) for j, (i, v) in enumerate(vectors) if j != at)[:k]
            out |= {(qi, r, i, -s) for r, (s, i) in enumerate(best, 1)}
    return out


def test_top_k_equals_brute_force(spark):
    rnd = random.Random(9)
    rows = [(i, [rnd.choice([-1.0, -0.25, 0.0, 0.1, 0.5]) for _ in range(8)], 1, "x") for i in range(700)]
    rows += [
        (i, v, 1, "x") for i,
        v in [
            (1000, None), (1020, [1.0, None]), (1040, [float("nan")]), (1060, [float("inf")]), (1080, []), (1100, [2.0] * 3), (None, [1.0])
        ]
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int, lead string")
    for block, chunk, group in ((64, 1024, 16384), (16, 8, 100)):
        got = top_k(df, df.where("vec_id % 20 = 0"), 20, block, chunk, group).collect()
        assert {tuple(r) for r in got} == brute_top([r[:2] for r in rows], 20, 20)
        assert len(got) == len({tuple(r) for r in got})


def test_top_k_edges(spark):
    schema = "vec_id long, embedding array<double>"
    assert top_k(spark.createDataFrame([], schema), spark.createDataFrame([], schema)).count() == 0
    df = spark.createDataFrame([(0, [1.0]), (5, [1.0]), (6, [1.0])], schema)
    assert sorted(tuple(r) for r in top_k(df, df.where("vec_id % 20 = 0")).collect()) == [(0, 1, 5, 4096), (0, 2, 6, 4096)]
    # of rows with one vec_id a bad one goes, and the others are candidates of each other
    df = spark.createDataFrame([(0, [1.0, None]), (0, [0.5]), (0, [1.0]), (7, [2.0])], schema)
    assert sorted(tuple(r) for r in top_k(df, df.where("vec_id = 0")).collect()) == [(0, 1, 7, 4096), (0, 2, 0, 2048)]
    # large scores are exact, and what does not fit is said
    big = 2.0**24
    df = spark.createDataFrame([(20, [big, 1.0]), (1, [big, 2.0]), (2, [big, 3.0])], schema)
    got = {r.vec_id: r.score for r in top_k(df, df.where("vec_id = 20")).collect()}
    assert got == {i: 2**60 + 64 * 64 * v for i, v in ((1, 2), (2, 3))}
    for huge in (1e300, 2.0**40):
        df = spark.createDataFrame([(0, [huge]), (1, [huge])], schema)
        with pytest.raises(Exception, match="64 bits"):
            top_k(df, df.where("vec_id = 0")).collect()


def test_blocks_are_skipped():
    rnd = np.random.default_rng(2)
    blocks = []
    for level in (50, 10, 1, 1, 1, 1):
        rows = rnd.integers(0, level + 1, (64, 6))
        blocks.append((rnd.choice(10**6, 64, replace=False), rows, rows.max(0), rows.min(0)))
    queries = rnd.integers(1, 9, (10, 6))
    scores, _, visited = best(queries, blocks, 5)
    assert visited.max() < len(blocks)
    again, _, fewer = best(queries, blocks, 5, scores[:, -1])
    assert (again == scores).all() and fewer.sum() <= visited.sum()


def test_pairs_without_hope_get_no_rows(spark, monkeypatch):
    """Clusters along different axes: most pairs of a chunk and a group are never given rows."""
    sizes = {}

    def counted(df, label):
        table = stored(df, label)
        sizes[label] = table.count()
        return table

    monkeypatch.setattr(topk, "stored", counted)
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in np.eye(16)[i % 16] * (-1 if i % 32 > 15 else 1) + rng.normal(0, 0.01, 16)]) for i in range(2000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {tuple(r) for r in top_k(df, df.where("vec_id % 20 = 0"), 20, 16, 16, 64).collect()}
    assert got == brute_top(rows, 20, 20)
    assert sizes["op9-open"] < 0.5 * sizes["op9-home"] * 2000 / 64


def test_long_lists_are_cut_before_they_are_gathered(spark, monkeypatch):
    """Fingerprints that share half of their bytes: the same links by lists that are cut, however short a long list is."""
    import numpy as np
    from pyspark.sql import functions as F

    from sieveline.llm import simhash

    rnd = np.random.default_rng(10)
    base = rnd.integers(0, 1 << 16, 3000, np.uint64) | np.uint64(0xABCD_1234 << 32)
    near = base[:500] ^ (np.uint64(1) << rnd.integers(0, 64, 500, np.uint64))
    prints = np.unique(np.concatenate([base, near]))
    rows = [(int(x),) for x in prints.view(np.int64)]
    masks = [simhash._signed(sum(0xFFFF << (16 * piece) for piece in kind)) for kind in simhash.KINDS]
    kinds = [F.struct(F.lit(k).alias("kind"), F.col("fp").bitwiseAND(F.lit(m)).alias("content")) for k, m in enumerate(masks)]
    index = spark.createDataFrame(rows, "fp long").select("fp", F.explode(F.array(*kinds)).alias("list")).select("list.kind", "list.content", "fp")
    monkeypatch.setattr(simhash, "LONG", 40)  # of the driver's side: tasks keep theirs
    cut = simhash._cut_lists(index)
    sizes = cut.groupBy(*simhash.LIST).count()
    assert cut.where("part >= 0").count() > 0 and sizes.where("part < 0").agg({"count": "max"}).first()[0] <= 40
    ordered = cut.repartition(*simhash.LIST).sortWithinPartitions(*simhash.LIST, "fp")
    found = ordered.mapInArrow(simhash._edge_rows, "a long, b long")
    root = {r.node: r.root for r in simhash.components(found).collect()}
    want = {int(x): int(x) for x in prints.view(np.int64)}

    def top(x):
        while want[x] != x:
            x = want[x]
        return x

    flat = prints.view(np.int64).tolist()
    for i, x in enumerate(prints):
        for j in np.flatnonzero(np.bitwise_count(prints[i + 1 :] ^ x) <= 2).tolist():
            a, b = top(flat[i]), top(flat[i + 1 + j])
            want[max(a, b)] = min(a, b)
    groups = lambda name: {frozenset(y for y in flat if name(y) == r) for r in set(map(name, flat))}
    assert groups(lambda x: root.get(x, x)) == groups(top)
