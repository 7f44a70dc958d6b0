"""Repair of conversations whose turns were damaged: the cheapest edits that give a system turn at most, then pairs of user and assistant.

Two passes over the rows, each dealt out by conversation and in the order of turns. The first takes no text, only what
the grammar asks of a row: a recursive DuckDB query advances all conversations of a batch by one turn at a time and
keeps, for each state of the grammar, the least cost and of equal ones the least audit (the edits' initials). A
conversation goes on from batch to batch with its states. The second pass takes the texts, behind a row with the
audit, and applies it as they come. A conversation of any length thus holds no more in a task than its audit; as its
result is one digest of its texts in order, one task has to read them all.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

HAS_WORD = r"[^\x20\x09-\x0D]"
NO_END = r"[^\x20\x09-\x0D.!?][\x20\x09-\x0D]*\z"
#: Ascending order has nulls first.
ORDER = ["conv_id", "turn", "tie_role", "tie_text", "copy"]
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 1, 2, 5, 5
#: Turns that one recursive query advances at most, so that the audits it compares stay short.
ROUND = 256

#: States of the grammar: nothing yet, behind the system turn, behind a user's, behind an assistant's.
STEPS = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
#: What inserted turns lead to; more than two in a row come back to where one or two were.
INSERTED = [("", "", 0), ("s", "s", 0), ("u", "u", 0), ("a", "a", 0), ("", "u", 1), ("s", "u", 1), ("u", "a", 1), ("a", "u", 1), ("", "a", 2), ("s", "a", 2), ("u", "u", 2), ("a", "a", 2)]
ROLES = {"u": "user", "a": "assistant"}


def _moves() -> str:
    """state, initial that a kept row must have (null: any), edits, state behind and cost, as SQL rows."""
    rows = []
    for start, then, n in INSERTED:
        lead, cost = "I" * n, n * INSERT
        rows.append(f"('{start}', NULL, '{lead}D', '{then}', {cost + DELETE})")
        for (at, emits), to in STEPS.items():
            if at == then:
                rows.append(f"('{start}', '{emits}', '{lead}K', '{to}', {cost + KEEP})")
                if emits in ROLES:
                    rows.append(f"('{start}', NULL, '{lead}R', '{to}', {cost + REROLE})")
    return ", ".join(rows)


#: asked: conv, k (from 1), initial, gone (has to be deleted), late (cut off). known: conv, state, cost, rank (the place
#: of its audit so far among the conversation's). Audits of equal cost have equal lengths, so ranks compare first.
ADVANCE = f"""
WITH RECURSIVE moves(state, needs, edits, upto, cost) AS (VALUES {_moves()}),
walk(conv, state, k, best) USING KEY (conv, state) AS (
  SELECT conv, state, 0, {{'cost': cost, 'rank': rank, 'audit': ''}} FROM known
  UNION
  SELECT w.conv, m.upto, w.k + 1, min({{'cost': w.best.cost + m.cost + CASE WHEN r.late AND right(m.edits, 1) <> 'D' THEN {CUT_OFF} ELSE 0 END, 'rank': w.best.rank, 'audit': w.best.audit || m.edits}})
  FROM walk w JOIN asked r ON r.conv = w.conv AND r.k = w.k + 1 JOIN moves m ON m.state = w.state AND (m.needs IS NULL OR m.needs = r.initial) AND (NOT r.gone OR right(m.edits, 1) = 'D')
  GROUP BY w.conv, m.upto, w.k)
SELECT w.conv, w.state, w.best.cost, w.best.rank, w.best.audit FROM walk w JOIN (SELECT conv, max(k) AS k FROM asked GROUP BY conv) USING (conv, k)
"""

AUDIT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, dropped, and what orders them: rows damaged by a checksum of conversation and turn; nulls are one space.

    Rows of one turn stand in order of role and of the text's MD5, before damage; a repeated row stands behind its first.
    """
    or_space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(or_space("conv_id"), F.lit(":"), or_space("turn"))) % 20
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), or_space("role").alias("tie_role"),
        or_space("text").alias("whole"), kind.alias("kind")
    )
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("whole", ".!?", "")).otherwise(F.col("whole"))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select(
        "conv_id", "turn", "tie_role", F.md5("whole").alias("tie_text"), F.explode(copies).alias("copy"), (F.col("kind") == 0).alias("dropped"),
        F.when(F.col("kind") == 4, "user").otherwise(F.col("tie_role")).alias("role"), text.alias("text")
    )


def faulted(rows: DataFrame) -> DataFrame:
    """The rows without their texts, dealt out by conversation and in order; fault is 0, or that of the first that holds."""
    seen = [F.xxhash64(F.lit(k), "role", "text").alias(f"seen{k}") for k in (1, 2)]
    narrow = rows.select(
        "conv_id", "turn", "tie_role", "tie_text", "copy", "dropped", F.substring("role", 1, 1).alias("initial"), *seen,
        F.rlike("text", F.lit(HAS_WORD)).alias("has_word"), F.rlike("text", F.lit(NO_END)).alias("no_end")
    ).repartition("conv_id")  # the window and the order below need no further exchange
    again = F.row_number().over(Window.partitionBy("conv_id", "dropped", "seen1", "seen2").orderBy(*ORDER[1:])) > 1
    fault = F.when(~F.col("has_word"), BLANK).when(F.col("again"), DUPLICATE).when(F.col("no_end"), TRUNCATED).otherwise(0)
    return narrow.withColumn("again", again).withColumn("fault", fault).sortWithinPartitions(*ORDER).select(
        "conv_id", "turn", "dropped", "initial", "fault"
    )


class _Open:
    """What is known of a conversation so far."""

    def __init__(self) -> None:
        self.counts = np.zeros(4, np.int64)  # blank, duplicate, truncated, illegal
        self.turns: tuple[int, int, int] | None = None  # least, greatest, different ones
        self.initial: str | None = None
        self.states: dict[str, tuple[int, str]] = {"": (0, "")}

    def row(self, conv_id: int | None) -> tuple:
        low, high, n = self.turns or (1, 0, 0)
        behind = {"": "", "a": "", "u": "I", "s": "II"}
        cost, audit = min((c + INSERT * len(behind[s]), a + behind[s]) for s, (c, a) in self.states.items())
        blank, duplicate, truncated, illegal = self.counts.tolist()
        return conv_id, high - low + 1 - n, blank, duplicate, truncated, illegal, cost, audit


def _starts(ids: pa.Array) -> np.ndarray:
    """Where another conversation starts; null is an id like any other."""
    values, null = ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False)
    return np.flatnonzero(np.r_[True, (values[1:] != values[:-1]) | (null[1:] != null[:-1])])


def _audited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import duckdb

    db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "512MB", "temp_directory": ""})
    names = [x.split()[0] for x in AUDIT.split(", ")]
    held: tuple[int | None, _Open] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        ids, turn, dropped, initial, fault = (batch.column(batch.schema.get_field_index(c)) for c in ("conv_id", "turn", "dropped", "initial", "fault"))
        starts = _starts(ids)
        own = [ids[int(at)].as_py() for at in starts]
        runs = [_Open() for _ in own]
        done = []
        if held:
            if held[0] == own[0]:
                runs[0] = held[1]
            else:
                done.append(held[1].row(held[0]))
        run = np.repeat(np.arange(len(own)), np.diff(np.r_[starts, batch.num_rows]))
        there = np.flatnonzero(~dropped.to_numpy(zero_copy_only=False))
        _counted(runs, run[there], turn.take(pa.array(there)), initial.take(pa.array(there)).to_pylist(), fault.to_numpy()[there])
        _advanced(db, runs, run[there], initial.take(pa.array(there)), fault.to_numpy()[there])
        done += [r.row(i) for r, i in zip(runs[:-1], own[:-1], strict=True)]
        held = own[-1], runs[-1]
        if done:
            yield _audit_batch(done, names)
    if held:
        yield _audit_batch([held[1].row(held[0])], names)


def _audit_batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in columns[:-1]], pa.array(columns[-1], pa.string())], names)


def _counted(runs: list[_Open], run: np.ndarray, turn: pa.Array, initial: list[str], fault: np.ndarray) -> None:
    """Adds the rows' faults, turn numbers and illegal neighbours to their conversations."""
    for kind in (BLANK, DUPLICATE, TRUNCATED):
        for at, n in enumerate(np.bincount(run[fault == kind], minlength=len(runs)).tolist()):
            runs[at].counts[kind - 1] += n
    before = None
    for at, now in zip(run.tolist(), initial, strict=True):
        conv = runs[at]
        last = conv.initial if at != before else last  # noqa: F821
        if last is not None and last + now not in ("su", "ua", "au"):
            conv.counts[3] += 1
        before, last = at, now
        conv.initial = now
    for at, now in zip(run.tolist(), turn.to_pylist(), strict=True):
        if now is not None:  # in order: the greatest so far is the last
            low, high, n = runs[at].turns or (now, None, 0)
            runs[at].turns = low, now, n + (now != high)


def _advanced(db, runs: list[_Open], run: np.ndarray, initial: pa.Array, fault: np.ndarray) -> None:
    """Takes the conversations' states over their rows, ROUND rows of each at a time."""
    if not len(run):
        return
    heads = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
    place = np.arange(len(run)) - np.repeat(heads, np.diff(np.r_[heads, len(run)]))
    gone, late = (fault == BLANK) | (fault == DUPLICATE), fault == TRUNCATED
    for start in range(0, int(place.max()) + 1, ROUND):
        now = np.flatnonzero((place >= start) & (place < start + ROUND))
        asked = pa.table({
            "conv": pa.array(run[now], pa.int32()), "k": pa.array(place[now] - start + 1, pa.int32()), "initial": initial.take(pa.array(now)),
            "gone": pa.array(gone[now]), "late": pa.array(late[now])
        })
        audits, known = {}, []
        for conv in np.unique(run[now]).tolist():
            ranked = sorted((audit, state, cost) for state, (cost, audit) in runs[conv].states.items())
            audits[conv] = [audit for audit, _, _ in ranked]
            known += [(conv, state, cost, rank) for rank, (_, state, cost) in enumerate(ranked)]
            runs[conv].states = {}
        columns = zip(("conv", "state", "cost", "rank"), zip(*known, strict=True), (pa.int32(), pa.string(), pa.int64(), pa.int32()), strict=True)
        db.register("asked", asked)
        db.register("known", pa.table({name: pa.array(values, kind) for name, values, kind in columns}))
        for conv, state, cost, rank, audit in db.execute(ADVANCE).fetchall():
            runs[conv].states[state] = cost, audits[conv][rank] + audit
        db.unregister("asked")
        db.unregister("known")


def audits(conversations: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost and audit of each conv_id."""
    return faulted(damaged(conversations)).mapInArrow(_audited, AUDIT)


def _behind_audits(conversations: DataFrame) -> DataFrame:
    """The rows that were not dropped, in order, each conversation's behind a row with its audit."""
    found = stored(audits(conversations), "op13-audits")
    own = [c for c in found.columns if c != "conv_id"]
    rows = damaged(conversations).where("NOT dropped")
    heads = found.withColumns({"head": F.lit(0), "turn": F.lit(None).cast("long"), "copy": F.lit(0)}).withColumns(
        {c: F.lit(None).cast("string") for c in ("tie_role", "tie_text", "role", "text")}
    )
    blank = {c: F.lit(None).cast(found.schema[c].dataType) for c in own}
    both = heads.unionByName(rows.drop("dropped").withColumns(blank | {"head": F.lit(1)}))
    ordered = both.repartition("conv_id").sortWithinPartitions("conv_id", "head", *ORDER[1:])
    return ordered.select("conv_id", "head", *own, "role", "text")


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(head row, None) for a conversation, then (conv_id, place, edit, role, text) of its turns: edits K, R and I, as they come."""
    audit, at, state, place, conv_id = "", 0, "", 0, None

    def step(initial: str) -> str:
        return STEPS[state, initial]

    def inserted() -> Iterator[tuple]:
        nonlocal at, state, place
        while at < len(audit) and audit[at] == "I":
            initial = "a" if state == "u" else "u"
            place, at, state = place + 1, at + 1, step(initial)
            yield conv_id, place, "I", ROLES[initial], ""

    for batch in batches:
        names = batch.schema.names
        for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            own = dict(zip(names, row, strict=True))
            if not own["head"]:
                yield own, None
                conv_id, audit, at, state, place = own["conv_id"], own["audit"], 0, "", 0
                yield from inserted()  # those of a conversation without rows
                continue
            edit, at = audit[at], at + 1
            if edit != "D":
                initial = own["role"][:1] if edit == "K" else "a" if state == "u" else "u"
                place, state = place + 1, step(initial)
                yield conv_id, place, edit, own["role"] if edit == "K" else ROLES[initial], own["text"]
            yield from inserted()


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in AUDIT.split(", ")]
    head, digest, first, out = None, hashlib.sha256(), True, []

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        audits = _audit_batch([r[:-1] for r in rows], names)
        return pa.RecordBatch.from_arrays([*audits.columns, pa.array([r[-1] for r in rows])], [*names, "repaired_sha256"])

    for item in _turns(batches):
        if item[1] is None:
            if head:
                out.append((*[head[c] for c in names], digest.hexdigest()))
            head, digest, first = item[0], hashlib.sha256(), True
            if len(out) >= 4096:
                yield batch_of(out)
                out = []
            continue
        digest.update(f"{'' if first else chr(10)}{item[3]}:".encode())
        digest.update(item[4].encode())
        first = False
    if head:
        out.append((*[head[c] for c in names], digest.hexdigest()))
        yield batch_of(out)


def _written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names, out, size = ["conv_id", "place", "edit", "role", "text"], [], 0

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    for item in _turns(batches):
        if item[1] is not None:
            out.append(item)
            size += len(item[4])
        if size > 1 << 20 or len(out) >= 4096:
            yield batch_of(out)
            out, size = [], 0
    if out:
        yield batch_of(out)


def repair(conversations: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of each conv_id, after the damage of ``damaged``.

    Edits: K keeps a row (its role's initial is the grammar's), R gives it the role that fits, D deletes it (as it must
    blank and duplicate ones), I inserts an empty turn; a row that is cut off and stays costs more. Of the cheapest
    edits the least audit is taken. gaps: turn numbers between the least and the greatest that no row has.

    Nulls are one space; an empty role has no initial, so its row can't be kept as it is; rows without a conv_id are one conversation, of a null id. A conversation that lost all rows has zeros
    and an empty audit. Rows that repeat are duplicates; very long texts stay in their rows, which pass one by one;
    an empty table gives an empty result.
    """
    return _behind_audits(conversations).mapInArrow(_digested, AUDIT + ", repaired_sha256 string")


def repaired_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, place (from 1), edit (K, R or I), role and text of the turns that ``repair`` leaves."""
    return _behind_audits(conversations).mapInArrow(_written, "conv_id long, place long, edit string, role string, text string")
