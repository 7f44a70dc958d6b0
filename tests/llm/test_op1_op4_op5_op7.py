import hashlib
import random
import re
import struct
import zlib
from collections import Counter

import pytest

from sieveline.llm import decontam, mixing, sharding, token_counts

EXTRA = "doc_id long, text string, source string, h long, size string, n_words int"


def make(spark, rows):
    return spark.createDataFrame([(i, t, s, 1, "x", 2) for i, t, s in rows], EXTRA)


def test_token_counts_over_many_blocks(spark):
    rnd = random.Random(1)
    rows = [(i, " ".join(rnd.choice(["the", "Été", "x1", "!!", "\n"]) for _ in range(rnd.choice([0, 1, 5, 300]))), "a") for i in range(80)]
    rows += [(100, None, "a"), (100, None, "a"), (None, "a b", "a")]
    encode = token_counts.encoding(token_counts.VOCABULARY).encode_ordinary
    want = Counter((i, len(encode(t or ""))) for i, t, _ in rows)
    for block in (1 << 16, 7):
        got = token_counts.token_counts(make(spark, rows), block).collect()
        assert Counter((r.doc_id, r.n_tokens) for r in got) == want
    assert token_counts.token_counts(make(spark, [])).count() == 0


def test_flat_files_without_index(spark, tmp_path):
    ids = [5, 9, 9, 1, 9, 7, 7, 7, 7, 7, 9, 3]
    (tmp_path / "a.bin").write_bytes(struct.pack(f"<{len(ids)}I", *ids))
    (tmp_path / "b.bin").write_bytes(struct.pack("<2I", 9, 9))
    for block in (4, 8, 1024):
        scan = token_counts.scanned(token_counts.blocks_of_files(spark, str(tmp_path), block), 9, 4)
        got = sorted((r.file[-5:], r.ordinal, r.first_token, r.n_tokens, r.closed) for r in token_counts.stitched(scan).collect())
        assert got == [
            ("a.bin", 0, 0, 1, True),
            ("a.bin", 1, 2, 0, True),
            ("a.bin", 2, 3, 1, True),
            ("a.bin", 3, 5, 5, True),
            ("a.bin", 4, 11, 1, False),
            ("b.bin", 0, 0, 0, True),
            ("b.bin", 1, 1, 0, True)
        ]


def test_large_flat_files_are_read_in_pieces(spark, tmp_path):
    rnd = random.Random(6)
    ids = [rnd.choice([9, 1, 2, 3, 4, 5]) for _ in range(5000)]
    (tmp_path / "a b.bin").write_bytes(struct.pack(f"<{len(ids)}H", *ids))
    (tmp_path / "none.bin").write_bytes(b"")
    want = [len(x) for x in " ".join(map(str, ids)).replace(" ", "").split("9")]
    for whole, piece in ((1 << 28, 64), (0, 64), (0, 1 << 20)):
        scan = token_counts.scanned(token_counts.blocks_of_files(spark, f"file://{tmp_path}", 32, whole=whole, piece=piece), 9, 2)
        got = [r.n_tokens for r in token_counts.stitched(scan).orderBy("ordinal").collect()]
        assert got == want or got == want[:-1] and not want[-1]


def test_ids_that_do_not_fit_are_errors(spark):
    with pytest.raises(Exception, match="do not fit"):
        token_counts.token_counts(
            make(spark, [(1, "some words", "a")]), end=token_counts.encoding(token_counts.VOCABULARY).encode_ordinary("some")[0]
        ).collect()
    scan = token_counts.scanned(token_counts.packed(make(spark, [(1, "some words", "a")]), end=70000, width=4), 70000, 4)
    assert [r.closed for r in token_counts.stitched(scan).collect()] == [True]


def test_token_counts_of_a_long_text(spark):
    df = spark.createDataFrame(
        [(1, "the word " * 200000, "x", 1, 2), (2, "a", "y", 3, 4)], "doc_id long, text string, file string, n_tokens int, ordinal int"
    )
    encode = token_counts.encoding(token_counts.VOCABULARY).encode_ordinary
    assert {
        r.doc_id: r.n_tokens for r in token_counts.token_counts(df).collect()
    } == {1: len(encode("the word " * 200000)), 2: len(encode("a"))}


def brute_contamination(docs, items, width=13):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - width + 1)) if w and i is not None else ():
            windows.setdefault(tuple(w[k : k + width]), set()).add(i)
    sizes = {len(w) for w in windows}
    out = {}
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    found |= windows[tuple(w[k : k + n])]
        digest = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
        out[d] = (len(w), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(w))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_contamination_equals_brute_force(spark, seed):
    rnd = random.Random(seed)
    vocabulary = ["a", "b", "cé", "D", "e5", "Éa"]
    text = lambda n, own=vocabulary: rnd.choice([" ", ", ", "-"]).join(rnd.choice(own) for _ in range(n))
    items = [(i, text(n)) for i, n in enumerate([1, 2, 3, 5, 12, 13, 14, 20, 40, 40])] + [(50, None), (51, "?"), (None, "zz zz"), (9, None)]
    items = [x for x in items if x[1] is None or len(x[1]) > 3 or x[0] in (50, 51)] + [(77, items[-6][1])]
    other = [f"w{i}" for i in range(30)]
    docs = [(100, None), (101, ""), (102, "..."), (103, items[8][1] if items[8][1] else "")]
    for i in range(40):
        piece = rnd.choice([x[1] for x in items if x[1]]).split(" ")
        a = rnd.randrange(len(piece))
        docs.append(
            (i, f"{text(rnd.randrange(60), other)} {' '.join(piece[a : a + rnd.randrange(30)]).upper()} {text(rnd.randrange(60), other)}")
        )
    benchmark = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, n_words int")
    got = decontam.contamination(make(spark, [(i, t, "a") for i, t in docs]), benchmark).collect()
    assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got} == brute_contamination(docs, items)
    assert len(got) == len(docs)


def test_contamination_edges(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    one = spark.createDataFrame([(1, "x y")], "item_id long, text string")
    assert decontam.contamination(make(spark, []), one).count() == 0
    got = decontam.contamination(make(spark, [(None, "X, y z", "a"), (1, "x y", "a"), (1, "x y", "a")]), one).collect()
    assert sorted((r.doc_id or 0, r.n_hit) for r in got) == [(0, 2), (1, 2), (1, 2)]
    assert [r.contaminated for r in decontam.contamination(make(spark, [(1, "x y", "a")]), none).collect()] == [False]
    # rows are judged one by one, whether or not they have a doc_id
    two = spark.createDataFrame([(1, "a b"), (2, "c d")], "item_id long, text string")
    got = decontam.contamination(
        make(spark, [(None, "a b", "a"), (None, "c d e", "a"), (None, "q", "a"), (3, "a b", "a"), (3, "q", "a")]), two
    ).collect()
    assert sorted((r.doc_id or 0, r.n_words, r.n_hit, r.n_items) for r in got) == [
        (0, 1, 0, 0), (0, 2, 2, 1), (0, 3, 2, 1), (3, 1, 0, 0), (3, 2, 2, 1)
    ]


def test_contamination_by_items_that_share_a_passage(spark):
    passage = " ".join(f"p{i}" for i in range(30))
    items = [(i, f"own{i} {passage} end{i}") for i in range(1000)]
    long = f"{'z ' * 200000}{passage}{' z' * 200000}"
    docs = [(1, passage), (2, f"x {passage} y"), (3, f"own7 {passage}"), (4, long)]
    got = decontam.contamination(
        make(spark, [(i, t, "a") for i, t in docs]), spark.createDataFrame(items, "item_id long, text string")
    ).collect()
    assert {r.doc_id: (r.n_hit, r.n_items, r.contaminated) for r in got} == {
        1: (30, 1000, True), 2: (30, 1000, True), 3: (31, 1000, True), 4: (30, 1000, False)
    }


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, full = 1.5 * sum(sizes.values()), set()
    while True:
        rest = total - sum(2 * sizes[s] for s in full)
        free = sum(w for s, w in weights.items() if s not in full)
        target = {s: 2.0 * sizes[s] if s in full else rest * weights[s] / free for s in sizes}
        over = {s for s in sizes if s not in full and target[s] >= 2 * sizes[s]}
        if not over:
            return target
        full |= over


def test_mix(spark):
    rnd = random.Random(3)
    rows = [(i, " ".join("w" * rnd.choice([0, 1, 3, 50])), rnd.choice(["a", "a", "a", "b", "Z", "é", None, "c0"])) for i in range(400)]
    rows += [(1000, None, "only null"), (1001, "x y z\x0bq", "one"), (None, "a b", None), (1002, "p q", "a"), (1002, "p q", "a")]
    got = mixing.mix(make(spark, rows)).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + size(t)
    want = brute_targets(sizes)
    assert Counter((r.doc_id, r["size"], r.source_size) for r in got) == Counter((i, size(t), sizes[s]) for i, t, s in rows)
    taken = {}
    for r in got:
        assert r.target == pytest.approx(want[r.source]) and 0 <= r.taken <= 2 * r["size"]
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert all(abs(taken[s] - want[s]) <= 0.5 + 1e-6 for s in want)
    again = mixing.mix(make(spark, rows[::-1]).repartition(7)).collect()
    assert Counter((r.doc_id, r.taken) for r in again) == Counter((r.doc_id, r.taken) for r in got)
    assert Counter(
        (r.doc_id, r.taken) for r in mixing.mix(make(spark, rows), seed=2).collect()
    ) != Counter((r.doc_id, r.taken) for r in got)
    assert mixing.mix(make(spark, [])).count() == 0
    one = [(None, "w " * 300000, "a"), (None, "v", "a"), (7, "u", "b")]  # a very long text among rows without a doc_id
    got = {r["size"]: r.taken for r in mixing.mix(make(spark, one)).where("source = 'a'").collect()}
    assert set(got) == {300000, 1} and abs(sum(got.values()) - (1.5 * 300002 - 2)) <= 1
    assert [r.taken for r in mixing.mix(make(spark, [(1, None, None)])).collect()] == [0]


def shards_hold(rows, got, shards=16):
    crc = lambda t: zlib.crc32((t or "").encode())
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter(
        (i, len((t or "").encode()) + 1, crc(t)) for i, t, _ in rows
    )
    slots = {k: sorted(r.slot for r in got if r.shard == k) for k in range(shards)}
    assert all(s == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert all(r.law == "rows" and r.grown_shard is None for r in got)


def test_sharding(spark):
    rnd = random.Random(4)
    rows = [(i, f"text {i}", "a") for i in range(1500)]
    rows += [(2000 + i, f"copy {i % 60}", "a") for i in range(300)] + [(5000 + i, "hot", "a") for i in range(700)]
    rows += [(9000, None, "a"), (9001, "", "a"), (None, "n", "a"), (None, "n", "a")]
    rnd.shuffle(rows)
    got = sharding.assign(make(spark, rows)).collect()
    shards_hold(rows, got)
    home, text = {}, {i: t for i, t, _ in rows}
    for r in got:
        home.setdefault(text[r.doc_id], set()).add(r.shard)
    split = [t for t, s in home.items() if t and t.startswith("copy") and len(s) > 1]
    assert len(split) <= 6, split
    again = sharding.assign(make(spark, rows[::-1]).repartition(5)).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))


def cut_edges(text, shard):
    """The share of pairs of equal texts that stand in two shards, largest groups left out (no shard holds them)."""
    groups = {}
    for i, t in text.items():
        groups.setdefault(t, []).append(shard[i])
    pairs = cut = 0
    for members in groups.values():
        counts = Counter(members).values()
        n = sum(counts)
        pairs += n * (n - 1) // 2
        cut += n * (n - 1) // 2 - sum(c * (c - 1) // 2 for c in counts)
    return cut / pairs


def test_sharding_cuts_few_edges(spark):
    """Against shards by hash, which cut 15 of 16 edges."""
    rnd = random.Random(7)
    rows = [(i, f"text {i}", "a") for i in range(1000)] + [(2000 + i, f"copy {rnd.randrange(90)}", "a") for i in range(1500)]
    got = sharding.assign(make(spark, rows)).collect()
    text = {i: t for i, t, _ in rows}
    found = cut_edges(text, {r.doc_id: r.shard for r in got})
    plain = cut_edges(text, {i: zlib.crc32(str(i).encode()) % 16 for i in text})
    assert plain > 0.9 and found < 0.02, (found, plain)


def test_sharding_without_doc_ids(spark):
    rows = [(None, f"t{i % 700}", "a") for i in range(1400)] + [(None, "hot", "a")] * 900 + [(None, None, "a")] * 5
    got = sharding.assign(make(spark, rows)).collect()
    shards_hold(rows, got)
    again = sharding.assign(make(spark, rows[::-1]).repartition(3)).collect()
    assert Counter((r.text_crc32, r.shard) for r in again) == Counter((r.text_crc32, r.shard) for r in got)


def test_sharding_edges(spark):
    assert sharding.assign(make(spark, [])).count() == 0
    for n in (1, 5, 17):
        rows = [(i % 4, "same" if i % 2 else None, "a") for i in range(n)]
        shards_hold(rows, sharding.assign(make(spark, rows)).collect())


def test_sharding_stays_in_the_jvm(spark):
    plan = sharding.assign(make(spark, [(i, "t", "a") for i in range(9)]))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_common_fingerprints_make_no_product(spark):
    """1,000 documents and 400 items share nine common words, and no window: few rows go on, and nothing is hit."""
    shared = "nine words that stand in all of them here"
    side = lambda kind, i, k: " ".join(f"{kind}{i}w{j}" for j in range(k))
    docs = [(i, f"{side('d', i, 8)} {shared} {side('e', i, 8)}") for i in range(1000)]
    items = [(i, f"{side('b', i, 8)} {shared} {side('c', i, 8)}") for i in range(400)]
    items.append((400, f"{side('d', 7, 8)} {shared}"))  # one document is contaminated
    documents = spark.createDataFrame(docs, "doc_id long, text string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    scan = documents.selectExpr("doc_id AS id", "text", "xxhash64(text) AS text_hash").mapInArrow(decontam._scan([13], None, None), decontam.SCANNED)
    prints = scan.selectExpr("sum(size(hits))").first()[0]
    windows = scan.selectExpr("row", "inline(hits)").mapInArrow(decontam._extended("row"), f"row long, {decontam.WINDOWS}").count()
    assert windows <= 10 * prints
    found = {r.doc_id: (r.n_hit, r.items) for r in decontam.contamination(documents, benchmark).where("n_hit > 0").collect()}
    assert found == {7: (17, [400])}
