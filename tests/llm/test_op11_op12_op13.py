"""Line rules, the prefix trie and the repair of conversations against brute force."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from sieveline.llm import line_rules, prefix_trie, turn_repair

DOCS = "doc_id long, text string, source string, line long, host string, n long"
TURNS = "conv_id long, turn long, role string, text string, depth int, audit string"
REST = (1, "x", 2)


def norm(line):
    return re.sub("[0-9]", "0", " ".join(re.findall(r"[^ \t\n\x0b\f\r]+", line)).lower())


def brute_rules(rows, max_docs, max_share, least_left):
    word = re.compile(r"[^ \t\n\x0b\f\r]+")
    texts = defaultdict(set)
    for _, text, host in rows:
        texts[host].add(text or "")
    seen = Counter((h, x) for h, own in texts.items() for t in own for x in {norm(line) for line in t.split("\n") if word.search(line)})
    out = []
    for doc, text, host in rows:
        text = text or ""
        words, lines = word.findall(text), [x for x in text.split("\n") if word.search(x)]
        grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        count = Counter(grams)
        again = {i + k for i, g in enumerate(grams) if count[g] > 1 for k in range(5)}
        gone = sum(len(word.findall(x)) for x in lines if max_docs < seen[host, norm(x)] > max_share * len(texts[host]))
        failed = len(words) < 10 or 100 * len(again) > 20 * len(words)
        symbols = sum(c in "#*$%&|<>" for c in text)
        kept = not failed and len(words) - gone >= least_left * len(words)
        out.append((doc, len(words), len("".join(words)), symbols, len(lines) - len(set(lines)), len(again), failed, kept, gone))
    return Counter(out)


def test_line_rules_equal_brute_force(spark):
    rnd = random.Random(11)
    vocabulary = ["".join(rnd.choice("abcdeé#|9") for _ in range(rnd.randint(1, 6))) for _ in range(300)]
    say = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    foot, menu = "Page 12 of 40\tAll rights\x0breserved", "Home | News | Contact"
    rows = [(i, None if i == 3 else "", "h0") for i in range(5)] + [(5, " \n\t\n ", None), (6, "one", None), (None, say(30), None)]
    for i in range(10, 150):
        parts = [say(rnd.randint(0, 40)) for _ in range(rnd.randint(1, 4))]
        if rnd.random() < 0.5:
            parts.insert(rnd.randint(0, len(parts)), rnd.choice([foot, foot.upper().replace("1", "7"), menu]))
        if rnd.random() < 0.3:
            parts += rnd.sample(parts, 1) * 2
        rows.append((i, "\n".join(parts), rnd.choice(["h0", "h0", "h1", None])))
    rows += [(200 + i, "\n".join([menu] * 4 + [say(5)]), "h1") for i in range(8)]
    rows += [(300 + i % 20, "the same text of ten words or more stands here again and again\nand a second line", "h2") for i in range(40)]
    long = say(250_000)
    rows += [(400, long, "h2"), (401, f"{long}\n{long}", "h2")]
    docs = spark.createDataFrame([(*r, *REST) for r in rows], DOCS)
    for max_docs, max_share, least in ((10, 0.05, 0.5), (2, 0.3, 0.8)):
        got = line_rules.line_rules(docs, "source", max_docs, max_share, least)
        want = brute_rules(rows, max_docs, max_share, least)
        assert Counter(tuple(r) for r in got.collect()) == want
        assert sum(n for r, n in want.items() if not r[6] and not r[7]) >= 3
    assert line_rules.line_rules(docs.limit(0)).collect() == []


def test_line_rules_take_no_python(spark):
    docs = spark.createDataFrame([(1, "a b", "h", *REST)], DOCS)
    plan = line_rules.measured(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def brute_trie(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            key = (turn is not None, turn or 0, role or "", hashlib.md5((text or "").encode()).hexdigest())
            turns[conv].append((key, (role or "", text or "")))
    own = {c: [t for _, t in sorted(v)] for c, v in turns.items()}
    whole = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        whole[c] = own.get(c - int(math.fmod(c, 100)), [])[:h] + mine[h:]
    members = defaultdict(list)
    for c, path in whole.items():
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
    out = set()
    for node, own in members.items():
        below = [n for n in members if n[: len(node)] == node]
        children = [n for n in below if len(n) == len(node) + 1]
        leaves = sum(not any(len(x) > len(n) and x[: len(n)] == n for x in below) for n in below)
        saved = sum((len(members[n]) - 1) * len(n[-1][1]) for n in below if n)
        ends = ",".join(str(c) for c in sorted(own) if len(whole[c]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        out.add((min(own), len(node), parent, len(own), len(children), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def made_conversations(seed, n=60):
    rnd = random.Random(seed)
    texts = ["Yes.", "No", "Who?", "é ü", "", None, "  ", "And then\nwhat!", "so "]
    roles = ["user", "assistant", "system", "tool", None, "", "User"]
    rows = []
    for c in rnd.sample(range(0, 350), n) + [-5, -7, 100, 200]:
        for turn in range(rnd.randint(1, 9)):
            role = rnd.choice(["user", "assistant"][turn % 2 :]) if rnd.random() < 0.7 else rnd.choice(roles)
            rows.append((c, turn * rnd.randint(1, 2) if rnd.random() < 0.95 else None, role, rnd.choice(texts) if rnd.random() < 0.6 else f"w{rnd.random()}."))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_equals_brute_force(spark, seed, monkeypatch):
    rows = made_conversations(seed, 150)
    rows += [(500 + i, t, "user", f"the same {t}") for i in range(40) for t in range(4)] + [(None, 1, "user", "nobody's")] + rows[5:9]
    if seed == 2:  # blocks of few turns, so that paths go through several
        rows += [(600, t, "user", f"long {t % 3}") for t in range(9000)][::-1]
        rows += [(634, t, "user", f"long {t % 3}") for t in range(9000)]
        rows = [r for r in rows if r[0] is None or r[0] >= 500] + [(600, 1, "user", "é" * 400_000)]
    got = {tuple(r) for r in prefix_trie.trie(spark.createDataFrame([(*r, *REST[:1], "x") for r in rows], TURNS)).collect()}
    assert got == (brute_trie(rows) if seed == 1 else quick_trie(rows))


def quick_trie(rows):
    """For long paths: children and sums from the nodes in order of depth, longest first."""
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            key = (turn is not None, turn or 0, role or "", hashlib.md5((text or "").encode()).hexdigest())
            turns[conv].append((key, (role or "", text or "")))
    own = {c: [t for _, t in sorted(v)] for c, v in turns.items()}
    nodes, count = {(): 0}, itertools.count(1)  # by parent and turn
    up, tokens, members, ends = [None], [0], [[]], [[]]
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 6
        at, path = 0, own.get(c - c % 100, [])[:h] + own[c][h:]
        members[0].append(c)
        for turn in path:
            if (at, turn) not in nodes:
                nodes[at, turn] = next(count)
                up.append(at)
                tokens.append(len(turn[1]))
                members.append([])
                ends.append([])
            at = nodes[at, turn]
            members[at].append(c)
        ends[at].append(c)
    depth = [0]
    for p in up[1:]:
        depth.append(depth[p] + 1)
    saved = [(len(m) - 1) * t for m, t in zip(members, tokens, strict=True)]
    children = Counter(up[1:])
    leaves = [int(not children[i]) for i in range(len(up))]
    for i in range(len(up) - 1, 0, -1):
        saved[up[i]] += saved[i]
        leaves[up[i]] += leaves[i]
    sha = [hashlib.sha256(",".join(map(str, e)).encode()).hexdigest() for e in ends]
    return {
        (min(members[i]), depth[i], None if up[i] is None else min(members[up[i]]), len(members[i]), children[i], leaves[i], saved[i], sha[i])
        for i in range(len(up))
    }


def test_trie_of_nothing_and_of_turnless_conversations(spark):
    frame = lambda rows: spark.createDataFrame([(*r, 1, "x") for r in rows], TURNS)
    assert prefix_trie.trie(frame([])).collect() == []
    few = [(c, 0, "user", "a") for c in range(101, 140)]  # without the first of their hundred
    got = {tuple(r) for r in prefix_trie.trie(frame(few)).collect()}
    assert got == brute_trie(few) and max(r[1] for r in got) == 1


def damaged_rows(rows):
    out = defaultdict(list)
    ids = {r[0] for r in rows}
    keyed = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        keyed.append(((turn is not None, turn or 0, role, hashlib.md5(text.encode()).hexdigest()), conv, turn, role, text, kind))
    for _, conv, turn, role, text, kind in sorted(keyed, key=lambda r: r[0]):
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out[conv] += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return {c: out[c] for c in ids}


GRAMMAR = re.compile(r"(s?(ua)+)?")


def brute_repair(rows):
    """All ways to keep, give another role or delete, with inserts where they may stand: cheapest first, then by audit."""
    out = {}
    for conv, own in damaged_rows(rows).items():
        faults, seen = [], set()
        for _, role, text in own:
            bare = re.sub(r"[ \t\n\x0b\f\r]", "", text)
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = [t for t, _, _ in own if t is not None]
        initials = [r[:1] for _, r, _ in own]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
        options = []
        for (_, role, text), fault in zip(own, faults, strict=True):
            late = 5 * (fault == "truncated")
            each = [(2, "D", "", None)]
            if fault not in ("blank", "duplicate"):
                each += [(late, "K", role[:1], (role, text))] if role else []  # an empty role has no initial to keep
                each += [(1 + late, "R", "u", ("user", text)), (1 + late, "R", "a", ("assistant", text))]
            options.append(each)
        gap = [(0, "", "", ())] + [(5, "I", x, ((ROLE[x], ""),)) for x in "ua"] + [(10, "II", x + y, ((ROLE[x], ""), (ROLE[y], ""))) for x in "ua" for y in "ua"]
        stack = [(0, "", "", ())]
        for each in [*options, None]:
            after = {}
            for cost, audit, word, made in stack:
                for g in gap:
                    for e in each or [(0, "", "", None)]:
                        w = word + g[2] + e[2]
                        if not PREFIX.fullmatch(w):
                            continue
                        new = (cost + g[0] + e[0], audit + g[1] + e[1], w, made + g[3] + ((e[3],) if e[3] else ()))
                        key = w[-1:] if w else "none"
                        if key not in after or new[:2] < after[key][:2]:
                            after[key] = new
            stack = list(after.values())
        best = min(x for x in stack if GRAMMAR.fullmatch(x[2]))
        whole = "\n".join(f"{r}:{t}" for r, t in best[3])
        count = Counter(faults)
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, count["blank"], count["duplicate"], count["truncated"], illegal, best[0], best[1], hashlib.sha256(whole.encode()).hexdigest()), best[3]
    return out


ROLE = {"u": "user", "a": "assistant"}
PREFIX = re.compile(r"s?(ua)*u?")


def full_search(own_options, most=2):
    """Cheapest and least audit over whole audits, with no state in between."""
    found = []
    gaps = [()] + [tuple(p) for k in range(1, most + 1) for p in itertools.product("ua", repeat=k)]
    for picked in itertools.product(*own_options):
        for ins in itertools.product(gaps, repeat=len(picked) + 1):
            word = "".join("".join(g) + p[2] for g, p in zip(ins, [*picked, (0, "", "")], strict=True))
            if GRAMMAR.fullmatch(word):
                audit = "".join("I" * len(g) + p[1] for g, p in zip(ins, [*picked, (0, "", "")], strict=True))
                found.append((sum(p[0] for p in picked) + 5 * sum(map(len, ins)), audit))
    return min(found)


@pytest.mark.parametrize("seed", [3, 4])
def test_repair_equals_brute_force(spark, seed):
    rows = made_conversations(seed, 250)
    rows += [(700, t, "xyz"[t % 3], f"other roles {t}.") for t in range(40)] + [(None, t, "user", f"nobody's {t}.") for t in range(5)]
    rows += [(701, None, "user", f"without numbers {t}.") for t in range(7)] + [(702, 0, "user", "a" * 300_000)] + rows[:5]
    rows += [(c, 3, "assistant", "alone.") for c in range(900, 940)]  # some lose their only row
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], TURNS)
    want = brute_repair(rows)
    got = {r[0]: tuple(r)[1:] for r in turn_repair.repair(frame).collect()}
    assert got == {c: w for c, (w, _) in want.items()}
    assert any(w[6] == "" and w[5] == 0 for w, _ in want.values()) and {ch for w, _ in want.values() for ch in w[6]} == set("KRD")
    made = defaultdict(list)
    for r in turn_repair.repaired_turns(frame).collect():
        made[r.conv_id].append((r.place, r.role, r.text))
    assert {c: [x[1:] for x in sorted(v)] for c, v in made.items()} == {c: list(m) for c, (_, m) in want.items() if m}
    assert turn_repair.repair(frame.limit(0)).collect() == [] and turn_repair.repaired_turns(frame.limit(0)).collect() == []


def test_states_lose_no_audit(spark):
    """Keeping one audit a state is as good as trying all: short conversations of all initials."""
    rows, options = [], {}
    for conv, word in enumerate("".join(w) for n in range(4) for w in itertools.product("suax", repeat=n)):
        options[conv] = [[(2, "D", ""), (0, "K", x), (1, "R", "u"), (1, "R", "a")] for x in word]
        rows += [(conv, k, x, 0) for k, x in enumerate(word)]
    conv, k, initial, fault = (list(x) for x in zip(*rows, strict=True))
    import duckdb
    import numpy as np
    import pyarrow as pa

    runs = [turn_repair._Open() for _ in options]
    turn_repair._advanced(duckdb.connect(":memory:"), runs, np.array(conv), pa.array(initial), np.array(fault))
    for c, own in options.items():
        assert runs[c].row(c)[-2:] == full_search(own, 1 if len(own) == 3 else 2), c


def test_long_conversations_go_on_from_batch_to_batch(spark, monkeypatch):
    rnd = random.Random(7)
    rows = [(1, t, rnd.choice(["user", "assistant", "system"]), f"turn {t}{rnd.choice(['.', ''])}") for t in range(3000)]
    rows += [(2, t, "tool", f"turn {t}.") for t in range(700)] + [(3, 0, "user", "hi."), (3, 1, "assistant", "ho.")]
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], TURNS)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "450")
    try:
        got = {r[0]: tuple(r)[1:] for r in turn_repair.repair(frame).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == {c: w for c, (w, _) in brute_repair(rows).items()}
