import hashlib
import random

import numpy as np
import pytest

from sieveline.llm.substring import remove_repeated_windows
from sieveline.llm.suffix_dedup import remove_repeated_bytes, repeated_starts

SCHEMA = "doc_id long, text string, at string, h long"


def brute_words(rows, width=13):
    first, out = {}, {}
    split = {d: (t or "").encode().split() for d, t in rows}
    for d in sorted(x for x in split if x is not None):
        w = split[d]
        for i in range(len(w) - width + 1):
            first.setdefault(tuple(w[i : i + width]), d)
    for d, w in split.items():
        gone = set()
        for i in range(len(w) - width + 1) if d is not None else ():
            if first[tuple(w[i : i + width])] < d:
                gone |= set(range(i, i + width))
        kept = [x for i, x in enumerate(w) if i not in gone]
        out[d] = (len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest())
    return out


def brute_bytes(rows, least):
    seen, out = {}, {}
    raws = {d: (t or "").encode() for d, t in rows}
    for _, t in rows:
        r = (t or "").encode()
        for i in range(len(r) - least + 1):
            seen[r[i : i + least]] = seen.get(r[i : i + least], 0) + 1
    for d, r in raws.items():
        gone = np.zeros(len(r) + 1, bool)
        for i in range(len(r) - least + 1):
            if seen[r[i : i + least]] > 1:
                gone[i : i + least] = True
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        kept = bytes(b for b, g in zip(r, gone, strict=False) if not g)
        out[d] = (len(r), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


def corpus(seed, n=60):
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 6))) for _ in range(400)]
    shared = [" ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(10, 90))) for _ in range(5)]
    texts = [None, "", " \n ", "one two", "a" * 900, "a" * 450 + "b", "b" + "a" * 700, " ".join(["x"] * 40)]
    for _ in range(n):
        parts = [" ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(0, 60))) for _ in range(3)]
        texts.append(f"{parts[0]} {rnd.choice(shared)}{rnd.choice(['', ' ', chr(10)])}{parts[1]}" + rnd.choice(["", rnd.choice(shared)]))
    texts += [texts[10], texts[10], texts[12] + " z", "y " + texts[12]]
    ids = rnd.sample(range(-50, 1000), len(texts))
    return list(zip(ids, texts, strict=True))


def test_substring_equals_brute_force(spark):
    rows = corpus(1)
    got = remove_repeated_windows(spark.createDataFrame([(d, t, "x", 1) for d, t in rows], SCHEMA)).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == brute_words(rows)
    assert all(hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256 for r in got)


def test_substring_other_widths(spark):
    rows = corpus(2, 30)
    got = remove_repeated_windows(spark.createDataFrame([(d, t, "x", 1) for d, t in rows], SCHEMA), 40).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == brute_words(rows, 40)


@pytest.mark.parametrize("width", [1, 3, 4, 8, 9])
def test_substring_of_few_words(spark, width):
    rows = corpus(5, 12)
    got = remove_repeated_windows(spark.createDataFrame([(d, t, "x", 1) for d, t in rows], SCHEMA), width).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == brute_words(rows, width)


def test_substring_of_long_texts(spark):
    """A text longer than a pack, and columns named like the results."""
    rnd = random.Random(8)
    long = " ".join(str(rnd.randrange(50000)) for _ in range(250000))
    rows = [
        (5, long),
        (6, "x " + long[1000:90000]),
        (7, "\u00e9t\u00e9 \u00a0 x" * 30),
        (8, "\u00e9t\u00e9 \u00a0 x" * 30),
        (2, long[200000:201000])
    ]
    df = spark.createDataFrame([(d, t, "x", 1, b"") for d, t in rows], "doc_id long, text string, kept_text string, pack int, marks binary")
    got = remove_repeated_windows(df).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == brute_words(rows)


def test_substring_edges(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert remove_repeated_windows(empty).count() == 0
    words = " ".join(f"w{i}" for i in range(20))
    rows = [(1, words, None, None), (1, words, None, None), (None, words, None, None), (2, words, None, None)]
    got = remove_repeated_windows(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.doc_id or 0, r.n_removed) for r in got) == [(0, 0), (1, 0), (1, 0), (2, 20)]


def test_suffix_array_block():
    rnd = random.Random(3)
    for _ in range(60):
        least = rnd.choice([3, 5, 8])
        snippets = [bytes(rnd.choice(b"\x00ab\xff") for _ in range(rnd.randint(least, 40))) for _ in range(rnd.randint(1, 12))]
        runs = [len(s) - least + 1 for s in snippets]
        counts = [rnd.choice([1, 1, 1, 2]) for _ in snippets]
        seen = {}
        for s, c in zip(snippets, counts, strict=True):
            for i in range(len(s) - least + 1):
                seen[s[i : i + least]] = seen.get(s[i : i + least], 0) + c
        want = [[i for i in range(r) if seen[s[i : i + least]] > 1] for s, r in zip(snippets, runs, strict=True)]
        assert [f.tolist() for f in repeated_starts(snippets, runs, counts, least)] == want


def test_suffix_dedup_equals_brute_force(spark):
    rows = corpus(4)
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], SCHEMA)
    for least, bucket in ((400, 1 << 20), (100, 1 << 20), (100, 2000), (100, 0)):  # the last two deal large anchors out anew
        got = remove_repeated_bytes(df, least, bucket_bytes=bucket).collect()
        assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == brute_bytes(rows, least), (least, bucket)


def test_suffix_dedup_of_long_runs_and_copies(spark):
    """Periodic texts, where one run holds equal strings; copies and rows without a doc_id; names that clash."""
    rows = [(1, "a" * 9000), (2, "xy" * 3000), (3, "xyz" * 200 + "q"), (None, "ab" * 150), (None, "ab" * 150), (4, "k" * 401), (5, None)]
    rows += [(10 + i, " ".join(f"v{j * j % 977}" for j in range(300))) for i in range(20)]
    df = spark.createDataFrame([(d, t, b"k", [1], 5) for d, t in rows], "doc_id long, text string, kept binary, spans array<int>, body int")
    for bucket in (1 << 20, 1000):
        got = remove_repeated_bytes(df, 400, bucket_bytes=bucket).where("doc_id IS NOT NULL").collect()
        want = {d: x for d, x in brute_bytes(rows, 400).items() if d is not None}
        assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == want
    assert len(remove_repeated_bytes(df).collect()) == len(rows)


def test_suffix_dedup_edges(spark):
    assert remove_repeated_bytes(spark.createDataFrame([], SCHEMA)).count() == 0
    text = "".join(map(str, range(400)))
    rows = [(1, text, None, None), (None, text, None, None), (2, text + "!", None, None)]
    got = remove_repeated_bytes(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.doc_id or 0, r.n_removed) for r in got) == [(0, len(text)), (1, len(text)), (2, len(text))]


def test_last_level_sends_one_key_a_pack(spark, monkeypatch):
    """A passage of 20,000 documents is one number in each pack, at the last level as at those before."""
    from sieveline.llm import substring

    passage = " ".join(f"shared{i}" for i in range(13))
    rows = [(i, f"{passage} own{i} word{i}") for i in range(20_000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    seen = []
    real = substring.stored

    def kept(df, label):
        if "level" in label:
            seen.append((label, df))
        return real(df, label)

    monkeypatch.setattr(substring, "stored", kept)
    found = substring.remove_repeated_windows(frame).collect()
    assert sum(r.n_removed for r in found) == 13 * 19_999 and min(r.n_words - r.n_removed for r in found) == 2
    packs = real(frame.select("doc_id", "text").mapInArrow(substring._pack_rows, substring.PACKS), "test-packs")
    answers = []
    steps, bits = substring.lengths(13), substring.LEAST_BITS
    for level in range(3):
        last = level == 2
        sent = "r int, pack long, keys binary, " + ("ids binary" if last else "twice binary")
        made = substring._last_level(steps, bits) if last else substring._level(steps, level, bits)
        rows = real(substring._marked(packs, answers).mapInArrow(made, sent), "test-sent")
        if last:
            assert max(len(r["keys"]) // 16 for r in rows.collect()) == 1
        answers.append(rows.groupBy("r").applyInArrow(substring._later_ones if last else substring._repeated, substring.ANSWERS))


def test_long_texts(spark):
    """Texts of more than a slice, beside short ones: brute force of both operators."""
    rnd = random.Random(9)
    block = "".join(rnd.choice("abcdefgh ") for _ in range(900_000))
    long = block + " " + "".join(rnd.choice("ijklmnop ") for _ in range(400_000))
    rows = [(5, long), (6, "x " + long[1000:3000]), (7, None), (8, "short"), (9, block[:600_000] + "!")]
    frame = spark.createDataFrame([(*r, "y", 1) for r in rows], SCHEMA)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in remove_repeated_windows(frame).collect()}
    assert got == brute_words(rows)
    seen = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in remove_repeated_bytes(frame).collect()}
    raws = {d: (t or "").encode() for d, t in rows}
    keys = {}
    for d, r in raws.items():  # strings of 400 bytes by digest
        for i in range(len(r) - 399):
            keys.setdefault(hashlib.blake2b(r[i : i + 400], digest_size=8).digest(), []).append((d, i))
    gone = {d: np.zeros(len(r) + 1, bool) for d, r in raws.items()}
    for places in keys.values():
        if len(places) > 1:
            for d, i in places:
                gone[d][i : i + 400] = True
    for d, r in raws.items():
        g = gone[d]
        kept = np.frombuffer(r, np.uint8)[~g[:-1]].tobytes()
        assert seen[d] == (len(r), int(g.sum()), int((g[1:] & ~g[:-1]).sum() + g[0]), hashlib.sha256(kept).hexdigest())
