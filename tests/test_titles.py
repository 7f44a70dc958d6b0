"""The positional prefix index of titles: it loses no pair, and looks at few."""

import random

from pyspark.sql import functions as F

from sieveline.operators import matching

REGISTRY = "ord long, paper_id string, doi string, title string"


def made(spark, seed, n_titles, n_files, n_words, heavy):
    """Words of very different frequency; every file begins with a title, whole or in part."""
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(n_words)]
    weights = [1 / (i + 1) ** heavy for i in range(n_words)]
    some = lambda n: rnd.choices(words, weights, k=n)
    titles = [some(rnd.randint(1, 12)) for _ in range(n_titles)]
    files = [rnd.choice(titles)[: rnd.randint(1, 12)] + some(rnd.randint(0, 60)) for _ in range(n_files)]
    registry = spark.createDataFrame([(i, f"P{i}", "", " ".join(t)) for i, t in enumerate(titles)], REGISTRY)
    heads = spark.createDataFrame([(f"f{i}", " ".join(w)) for i, w in enumerate(files)], "file string, text string")
    return titles, files, registry, heads.select("file", matching.head_words("text").alias("words"))


def test_candidates_hold_every_pair_of_their_share(spark):
    titles, files, registry, heads = made(spark, 1, 150, 120, 80, 0.7)
    index = matching.TitleIndex(heads, registry)
    first = {}
    for i, t in enumerate(titles):
        first.setdefault(frozenset(t), i)
    for share in (1.0, 0.65, 0.5):
        want = {(f"f{k}", o) for k, w in enumerate(files) for t, o in first.items() if len(t & set(w)) >= share * len(t) - 1e-9}
        found = {tuple(r) for r in index.candidates(share).collect()}
        assert want <= found and len(found) < len(files) * len(first)
        kept = index.scored(index.candidates(share)).where(F.col("score") >= share - 1e-9)
        assert {(r.file, r.ord) for r in kept.collect()} == want
        best = {}
        for k, w in enumerate(files):
            for t, o in first.items():
                score = len(t & set(w)) / len(t)
                if score >= share - 1e-9:
                    best[f"f{k}"] = min(best.get(f"f{k}", (0, 0)), (-score, o))
        got = {r.file: (-r.score, int(r.paper_id[1:])) for r in index.best(share).collect()}
        assert got == best


def test_few_pairs_are_looked_at(spark):
    """Files that hold a whole title leave at the first level, which looks up one word of each title."""
    titles, files, registry, heads = made(spark, 2, 2000, 1000, 3000, 0.9)
    index = matching.TitleIndex(heads, registry)
    top = index.candidates(1.0)
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert top.count() < 0.03 * len(titles) * len(files)
    assert index.places.count() <= sum(len(set(w)) for w in files)


def test_whole_titles_come_in_blocks_and_files_leave_with_the_first(spark, monkeypatch):
    """Files leave with the block of their first whole title; when none is left the last block is not looked at."""
    monkeypatch.setattr(matching, "FIRST_TITLES", 10)
    titles, files, registry, heads = made(spark, 3, 400, 90, 60, 0.8)
    sizes = [b.count() for b in matching.TitleIndex(heads, registry).blocks()]
    assert len(sizes) == 3 and sum(sizes) == len({frozenset(t) for t in titles})
    seen, first_whole = [], matching.TitleIndex.first_whole
    monkeypatch.setattr(matching.TitleIndex, "first_whole", staticmethod(lambda h, t: seen.append(h.count()) or first_whole(h, t)))
    best = {}
    for k, w in enumerate(files):
        own = [(-len(set(t) & set(w)) / len(set(t)), i) for i, t in enumerate(titles) if 2 * len(set(t) & set(w)) >= len(set(t))]
        best |= {f"f{k}": min(own)} if own else {}
    index = matching.TitleIndex(heads, registry)
    assert {r.file: (-r.score, int(r.paper_id[1:])) for r in index.best().collect()} == best
    assert len(seen) == 2 and seen[0] == 90 > seen[1]


def test_claims_of_one_paper_need_no_window_over_its_files(spark):
    """A frame of all files behind each file would look at half a billion pairs here; rows of one file stay one claim."""
    rnd = random.Random(4)
    many = spark.range(30_000).selectExpr(
        "concat('in/f', id) AS file", "'P' AS paper_id", "'title' AS match_method",
        "round(0.5 + pmod(xxhash64(id), 400) / 1000D, 3) AS confidence", "'matched' AS status"
    )
    rows = [("in/g", "Q", "doi", 0.95, "matched")] * 2 + [("in/x", "", "unmatched", 0.0, "unmatched")]
    rows += [(f"in/{i}", f"R{rnd.randint(0, 9)}", "title", rnd.choice([0.5, 0.6, 0.7]), "matched") for i in range(300)]
    settled = matching.settle_claims(many.unionByName(spark.createDataFrame(rows, many.schema)), "file")
    assert "unboundedfollowing" not in settled._jdf.queryExecution().executedPlan().toString().lower()
    got = sorted(((r.file, r.paper_id, r.confidence), r.status) for r in settled.collect())
    whole, want = sorted([*map(tuple, many.collect()), *rows]), []
    top = {}
    for file, paper, _, confidence, status in whole:
        want.append([(file, paper, confidence), status if status != "matched" else "duplicate_match"])
        if status == "matched" and confidence > top.get(paper, (0, None))[0]:
            if paper in top:
                top[paper][1][1] = "superseded"
            want[-1][1] = "matched"
            top[paper] = (confidence, want[-1])
    assert [tuple(w) for w in sorted(want)] == got


def test_candidates_share_several_words_of_a_front(spark):
    """A single common word makes no candidate of a title that needs more, and no pair of the share is lost by that."""
    titles, files, registry, heads = made(spark, 5, 80, 70, 60, 0.6)
    first = {}
    for i, t in enumerate(titles):
        first.setdefault(frozenset(t), i)
    sets = {o: t for t, o in first.items()}
    found = {tuple(r) for r in matching.TitleIndex(heads, registry).candidates(0.5).collect()}
    for file, o in found:
        assert len(sets[o] & set(files[int(file[1:])])) >= min(4, -(-len(sets[o]) // 2))
    want = {(f"f{k}", o) for k, w in enumerate(files) for o, t in sets.items() if 2 * len(t & set(w)) >= len(t)}
    assert want <= found
