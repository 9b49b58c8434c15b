"""Repair of the turn structure of conversations, at least cost.

A repaired conversation reads, by the initials of its roles, as nothing or as an optional s and
then one or more pairs ua.  Keep costs 0, Rerole (to user or assistant) 3, Delete 4, Insert (a
user's or assistant's turn without text) 3; a truncated row that is not deleted adds 3; blank rows
and duplicates have to go.  Four states (nothing yet, after s, after u, after a) say what may
follow, and each edit leads from a state to one other, so the edits' initials fix the result.

Rows that repeat an earlier one are found by a window over conversation, role and text.  Then rows are dealt to
tasks by conversation and sorted there.  A task gathers conversations up to ``BATCH`` rows, puts those of like
length (powers of two) into one tensor, time first, and walks it backward: at each time the costs of all states of
all conversations in one step.  These costs are stored, each less the least of its time, so that a byte holds one;
forward, all conversations take at each time the least letter that keeps the least cost.

Defined cases: nulls of role and text are one space, so such rows are blank; rows without a turn come
first; rows of one turn are in order of role and text; a null conv_id is one conversation.  Repeated
rows are duplicates.  An empty table gives no rows.  A conversation without rows gives zeros, an empty
audit and the hash of the empty string.  Roles that begin with none of s, u, a can't be kept.  Very
long texts are whole rows.  A conversation stays with one task, as its hash runs over all its text; texts of one
conversation beyond ``SPOOL`` bytes lie in an unnamed file of the task meanwhile, so that a conversation of
very many rows needs some 30 bytes a row of memory.  Further columns are dropped.
"""

from __future__ import annotations

import hashlib
from array import array
from collections import defaultdict
from collections.abc import Iterator
from sys import intern
from tempfile import SpooledTemporaryFile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import crc_mod

#: Costs of the edits, and what an undeleted truncated row adds.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Rows of conversations that are repaired together, and bytes of one's text that stay in memory.
BATCH, SPOOL = 16_384, 64 << 20
#: White space of the contract, as a list of characters to trim.
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"

START, SYSTEM, USER, ASSISTANT, NOWHERE = range(5)
#: The state after a row is kept, by its initial and the state before; after rerole or insert, by the state before.
KEPT = np.full((4, 4), NOWHERE)
KEPT["sua".index("s"), START] = SYSTEM
KEPT["sua".index("u"), [START, SYSTEM, ASSISTANT]] = USER
KEPT["sua".index("a"), USER] = ASSISTANT
FORCED = np.array([USER, USER, ASSISTANT, USER])
#: What is missing at the end: nothing, user and assistant, assistant, nothing.
END = np.array([0, 2 * INSERT, INSERT, 0])
#: More than any difference of two states' costs.
FAR = 100
SOUND, DOOMED, SHORT = range(3)


def edits(initials: np.ndarray, faults: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least costs and letters of conversations of rows[c] rows each: initials and faults are time by conversation, initials as
    places in "sua" or 3, faults SOUND, DOOMED or SHORT.  Letters are step by conversation, 0 where a step does nothing."""
    times, n = initials.shape
    every = np.arange(n)
    costs, falls = np.full((times + 1, n, 5), FAR, np.int8), np.zeros((times, n), np.int8)
    costs[times, :, :4] = END
    extra = np.array([0, FAR, TRUNCATED, 0], np.int16)  # the last beyond a conversation's end
    for t in range(times - 1, -1, -1):
        then = costs[t + 1].astype(np.int16)
        kept = np.take_along_axis(then, KEPT[initials[t]], 1)
        now = np.minimum(then[:, :4] + DELETE, np.minimum(kept, then[:, FORCED] + REROLE) + extra[faults[t]][:, None])
        now[:, [USER, ASSISTANT]] = np.minimum(now[:, [USER, ASSISTANT]], now[:, [ASSISTANT, USER]] + INSERT)
        now[:, [START, SYSTEM]] = np.minimum(now[:, [START, SYSTEM]], now[:, [USER]] + INSERT)
        there, least = t < rows, now.min(axis=1)
        falls[t] = np.where(there, least, 0)
        costs[t, :, :4] = np.where(there[:, None], now - least[:, None], then[:, :4])
    state, letters = np.zeros(n, int), np.zeros((3 * times + 3, n), np.uint8)
    for t in range(times + 1):
        there, ending = t < rows, t == rows
        own, then = costs[t].astype(np.int16), costs[min(t + 1, times)].astype(np.int16)
        fall = falls[t].astype(np.int16) if t < times else np.zeros(n, np.int16)
        for k in range(2):
            cost = own[every, state]
            dropped = there & (cost + fall == then[every, state] + DELETE)
            put = (there | ending) & ~dropped & (cost == own[every, FORCED[state]] + INSERT)
            letters[3 * t + k, put] = ord("I")
            state = np.where(put, FORCED[state], state)
        if t == times:
            break
        cost = own[every, state] + fall
        dropped = there & (cost == then[every, state] + DELETE)
        to = KEPT[initials[t], state]
        kept = there & ~dropped & (cost == then[every, to] + extra[faults[t]])
        moved = there & ~dropped & ~kept
        letters[3 * t + 2] = np.where(dropped, ord("D"), np.where(kept, ord("K"), np.where(moved, ord("R"), 0)))
        state = np.where(kept, to, np.where(moved, FORCED[state], state))
    return falls.sum(axis=0, dtype=np.int64) + costs[0, :, START], letters


class Talk:
    """A conversation in order: its counts, and what its repair needs."""

    def __init__(self, key):
        self.key, self.roles, self.initials, self.faults = key, [], array("b"), array("b")
        self.size, self.text = array("q"), SpooledTemporaryFile(SPOOL)
        self.turns, self.first, self.last = 0, None, None  # distinct turns, in order
        self.counts, self.illegal = [0, 0, 0], 0

    def add(self, turn, role: str, text: str, blank: bool, again: bool, short: bool) -> None:
        raw = text.encode("utf-8", "surrogatepass")
        fault = 0 if blank else 1 if again else 2 if short else None
        if fault is None:
            self.faults.append(SOUND)
        else:
            self.counts[fault] += 1
            self.faults.append(SHORT if fault == 2 else DOOMED)
        if self.roles and self.roles[-1][:1] + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.initials.append("sua".index(role[:1]) if role[:1] in ("s", "u", "a") else 3)
        self.roles.append(intern(role))
        self.size.append(len(raw))
        self.text.write(raw)
        if turn is not None:
            self.turns += turn != self.last
            self.first, self.last = turn if self.first is None else self.first, turn

    def gaps(self) -> int:
        return self.last - self.first + 1 - self.turns if self.turns else 0

    def repaired(self, audit: bytes) -> Iterator[tuple[str, bytes, str]]:
        """role, text (UTF-8) and edit of each turn that is left."""
        self.text.seek(0)
        state, i = START, 0
        for letter in audit.decode():
            if letter == "I":
                state = FORCED[state]
                yield ("user" if state == USER else "assistant"), b"", letter
                continue
            raw, role = self.text.read(self.size[i]), self.roles[i]
            if letter == "K":
                state = KEPT[self.initials[i], state]
            elif letter == "R":
                state = FORCED[state]
                role = "user" if state == USER else "assistant"
            if letter != "D":
                yield role, raw, letter
            i += 1


def _talks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[Talk]]:
    """Whole conversations of sorted rows, so many that they have BATCH rows or a little more."""
    held: list[Talk] = []
    rows = 0
    for b in batches:
        for key, turn, role, text, gone, blank, again, short in zip(*(c.to_pylist() for c in b.columns)):
            if not held or held[-1].key != key:
                if rows >= BATCH:
                    yield held
                    held, rows = [], 0
                held.append(Talk(key))
            if not gone:
                held[-1].add(turn, role, text, blank, again, short)
                rows += 1
    if held:
        yield held


def _edited(talks: list[Talk]) -> Iterator[tuple[Talk, int, bytes]]:
    """Each conversation with its cost and audit; those of like length in one tensor."""
    alike = defaultdict(list)
    for t in talks:
        alike[len(t.roles).bit_length()].append(t)
    for bucket in alike.values():
        rows = np.array([len(t.roles) for t in bucket])
        initials, faults = np.full((2, rows.max(), len(bucket)), 3, np.int8)
        for c, t in enumerate(bucket):
            initials[: rows[c], c], faults[: rows[c], c] = t.initials, t.faults
        costs, letters = edits(initials, faults, rows)
        for t, cost, audit in zip(bucket, costs.tolist(), np.ascontiguousarray(letters.T)):
            yield t, cost, audit[audit != 0].tobytes()


def _sorted(rows: DataFrame) -> DataFrame:
    """Rows of conversations (conv_id, turn, role, text and, if some are to be left out, gone) as tasks take them."""
    role, text = (F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text"))
    gone = F.col("gone") if "gone" in rows.columns else F.lit(False)
    df = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), role, text, gone.alias("gone"))
    end = F.right(F.rtrim("text", F.lit(BLANKS)), F.lit(1))
    same = Window.partitionBy("conv_id", "role", "text", "gone").orderBy(F.asc_nulls_first("turn"))
    again = F.row_number().over(same) > 1
    df = df.select("conv_id", "turn", "role", "text", "gone", (end == "").alias("blank"), again.alias("again"), (~end.isin(".", "!", "?")).alias("short"))
    # of equal rows the one that isn't a repetition comes first
    return df.repartition("conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "role", "text", "again")


def repair(conversations: DataFrame) -> DataFrame:
    """The repaired rows: conv_id, turn (from 0, without gaps), role, text and edit (K, R or I)."""
    kind = conversations.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for talks in _talks(batches):
            for talk, _, audit in _edited(talks):
                part = []
                for i, (role, raw, edit) in enumerate(talk.repaired(audit)):
                    part.append((talk.key, i, role, raw.decode("utf-8", "surrogatepass"), edit))
                    if len(part) == BATCH:
                        yield _batch(part, names)
                        part = []
                if part:
                    yield _batch(part, names)

    names = ["conv_id", "turn", "role", "text", "edit"]
    return _sorted(conversations).mapInArrow(run, f"conv_id {kind}, turn long, role string, text string, edit string")


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows])


def summary(rows: DataFrame) -> DataFrame:
    """A row for each conversation: counts of its faults, the cost and letters of its edits and the hash of what is left."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for talks in _talks(batches):
            out = []
            for talk, cost, audit in _edited(talks):
                digest, first = hashlib.sha256(), True
                for role, raw, _ in talk.repaired(audit):
                    digest.update(b"" if first else b"\n")
                    digest.update(role.encode("utf-8", "surrogatepass") + b":" + raw)
                    first = False
                out.append((talk.key, talk.gaps(), *talk.counts, talk.illegal, cost, audit.decode(), digest.hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*out), types)], names=names)

    key = pa.int64() if kind == "bigint" else None
    types = [key] + [pa.int64()] * 6 + [pa.string()] * 2
    counts = ", ".join(f"{c} long" for c in names[1:7])
    return _sorted(rows).mapInArrow(run, f"conv_id {kind}, {counts}, audit string, repaired_sha256 string")


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and gone after the damage that crc32 of conv_id:turn (null: one space) names; dropped rows are
    marked gone, so that their conversation stays known."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    k = crc_mod(F.concat(text("conv_id"), F.lit(":"), text("turn")), 20)
    df = conversations.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), k.alias("k"))
    said = F.when(F.col("k") == 1, "").when(F.col("k") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    df = df.select("conv_id", "turn", F.when(F.col("k") == 4, "user").otherwise(F.col("role")).alias("role"), said.alias("text"), (F.col("k") == 0).alias("gone"), F.explode(F.sequence(F.lit(1), F.when(F.col("k") == 3, 2).otherwise(1))).alias("copy"))
    return df.drop("copy")


def op11(conversations: DataFrame) -> DataFrame:
    return summary(damaged(conversations))
