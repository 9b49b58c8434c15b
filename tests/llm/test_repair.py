"""Repair of conversations against a search over all edits, and on odd tables."""

import hashlib
import random
import re
import zlib
from functools import lru_cache

import numpy as np
import pytest

from turnloom.llm import repair

WS = re.compile(r"[^\x20\x09-\x0D]")
GOOD = re.compile(r"(s?(ua)+)?\Z")


def least(rows):
    """The cheapest edits of (role, text, fault) rows, the ASCII-least of these, and the result: all edits are tried, with at most
    two inserts in a row (a third would lead back to where the first began)."""

    def may_follow(done, role):
        """done with role's initial, cut to its last pair, if that can still become a good conversation."""
        return re.sub(r"(ua)+(?=u?\Z)", "ua", done + role[0]) if role and re.match(r"s?(ua)*u?\Z", done + role[0]) else None

    @lru_cache(None)
    def rest(i, done, inserted):
        options = []
        if i == len(rows) and GOOD.match(done):
            options.append((0, "", ()))
        for role in ("user", "assistant"):
            if inserted < 2 and (longer := may_follow(done, role)):
                c, a, t = rest(i, longer, inserted + 1)
                options.append((c + 3, "I" + a, ((role, ""),) + t))
        if i < len(rows):
            role, text, fault = rows[i]
            c, a, t = rest(i + 1, done, 0)
            options.append((c + 4, "D" + a, t))
            for to, letter, cost in ((role, "K", 0), ("user", "R", 3), ("assistant", "R", 3)):
                if fault in (None, "short") and (longer := may_follow(done, to)):
                    c, a, t = rest(i + 1, longer, 0)
                    options.append((c + cost + 3 * (fault == "short"), letter + a, ((to, text),) + t))
        return min(options, default=(10**6, "", ()))

    return rest(0, "", 0)


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        last = WS.findall(text)[-1:]
        out.append((role, text, "blank" if not last else "again" if (role, text) in seen else "short" if last[0] not in ".!?" else None))
        seen.add((role, text))
    return out


def brute(conversations):
    """conv_id, turn, role, text rows: the contract in plain Python."""
    out = {}
    by = {}
    for conv, turn, role, text in conversations:
        by.setdefault(conv, [])
        role, text = (" " if x is None else x for x in (role, text))
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        by[conv] += [(turn, "user" if k == 4 else role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    for conv, rows in by.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        turns = [t for t, _, _ in rows if t is not None]
        marked = faults([r[1:] for r in rows])
        count = lambda f: sum(m[2] == f for m in marked)
        cost, audit, kept = least(tuple(marked))
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(marked, marked[1:]))
        text = "\n".join(f"{r}:{t}" for r, t in kept)
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, count("blank"), count("again"), count("short"), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


def test_edits_against_all_edits():
    chance = random.Random(5)
    talks = []
    for _ in range(400):
        n = chance.randrange(0, 9)
        talks.append(tuple((chance.choice(["system", "user", "assistant", "user", "assistant", "tool", ""]), chance.choice(["a.", "b", "c!", "d?"]), chance.choice([None, None, "short", "blank", "again"])) for _ in range(n)))
    rows = np.array([len(t) for t in talks])
    initials, marks = np.full((2, rows.max(), len(talks)), 3, np.int8)
    for c, t in enumerate(talks):
        for i, (role, _, fault) in enumerate(t):
            initials[i, c] = "sua".index(role[0]) if role[:1] and role[0] in "sua" else 3
            marks[i, c] = {None: repair.SOUND, "short": repair.SHORT}.get(fault, repair.DOOMED)
    costs, letters = repair.edits(initials, marks, rows)
    for c, t in enumerate(talks):
        cost, audit, _ = least(t)
        assert (int(costs[c]), letters[:, c][letters[:, c] != 0].tobytes().decode()) == (cost, audit), t


def made(seed, n):
    chance = random.Random(seed)
    out = []
    for conv in range(n):
        for turn in range(chance.randrange(1, 9)):
            role = chance.choice(["user", "assistant", "user", "assistant", "system", None, "tool", ""])
            text = chance.choice(["Yes.", "No", "", None, " \t\n", "Well?!", "é…", "𝒳.", "one\ntwo. \x0b", "a." * 50])
            out.append((conv if conv else None, chance.choice([turn, turn, turn, turn + 5, None]), role, text))
    return out


@pytest.mark.parametrize("batch", [7, 16_384])
def test_summary_against_plain(spark, monkeypatch, batch):
    monkeypatch.setattr(repair, "BATCH", batch)
    monkeypatch.setattr(repair, "SPOOL", 16 if batch == 7 else 1 << 20)
    rows = made(batch, 60)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = repair.op11(df).collect()
    assert len(got) == len({r[0] for r in rows})
    assert {r[0]: tuple(r)[1:] for r in got} == brute(rows)


def test_odd_tables(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert repair.op11(spark.createDataFrame([], schema)).collect() == []
    long = "word " * 400_000 + "end."
    rows = [(1, 0, "user", long), (1, 1, "assistant", "Yes."), (2, 0, "assistant", "Yes."), (2, 0, "assistant", "Yes."), (3, None, None, None)]
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, schema).select("*", *[F.lit("x").alias(c) for c in ("k", "copy", "blank", "short", "audit", "cost", "said")])
    got = {r[0]: tuple(r)[1:] for r in repair.op11(df).collect()}
    assert got == brute(rows)


def test_repaired_rows(spark):
    rows = [(7, 3, "user", "One."), (7, 4, "user", "Two."), (7, 5, "assistant", "Three"), (8, 0, "assistant", "   ")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = [tuple(r) for r in repair.repair(df).orderBy("conv_id", "turn").collect()]
    # two inserts, or one row given to the other role, cost three and three with the cut row
    cost, audit, kept = least(tuple(faults([r[2:] for r in rows[:3]])))
    assert [(r[2], r[3]) for r in got] == list(kept) and [r[1] for r in got] == list(range(len(kept))) and {r[0] for r in got} == {7}


def test_a_long_conversation(spark):
    """A conversation of very many rows, in one tensor: every row has its letter, and what is left alternates."""
    n = 30_000
    df = spark.range(n).selectExpr("1L AS conv_id", "id AS turn", "CASE WHEN id % 7 = 3 THEN 'tool' WHEN id % 2 = 0 THEN 'user' ELSE 'assistant' END AS role", "concat('Turn ', id, '.') AS text")
    r = repair.summary(df).first()
    assert len(r["audit"].replace("I", "")) == n and r["cost"] == 3 * r["audit"].count("I") + 4 * r["audit"].count("D") + 3 * r["audit"].count("R")
    roles = [x[0] for x in repair.repair(df).orderBy("turn").select("role").collect()]
    assert roles == ["user", "assistant"] * (len(roles) // 2)
