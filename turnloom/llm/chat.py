"""Chat formatting by a grammar round trip.

A conversation is a run of turns.  A turn is a line "### <Role>: ", its text and "</turn>",
each turn followed by a line end::

    conversation = { "### " name ": " text "</turn>\\n" }

Texts can hold what looks like a mark.  A backslash makes the next character plain; what is
escaped grows until the parser gives back the same turns: nothing; then the control strings
("###", "</turn>") and backslashes before "\\", "#", "<"; then every "\\", "#" and "<".  The
parser is deterministic and is all that decides: it reads a name up to ": ", then the text up
to the first unescaped "</turn>", and takes "\\" as an escape only before "\\", "#", "<", ":".

The loss mask is the spans, in the formatted text, of the texts of assistant turns.

Rows come in sorted by conversation and turn from one shuffle by conversation, and stream:
one conversation is held at a time.  A conversation is one formatted text, so one that holds
a large share of all rows is as long as that text is.

Defined cases: a null text or role is empty; rows of one turn number are ordered by role, then
text; repeated rows are turns of their own; null conversation ids are one conversation; without rows
the result is empty.  Further columns are dropped.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import arrow_batches

OPEN, CLOSE = "### ", "</turn>"
_SPECIAL = re.compile(r"\\(?=[\\#<:])|#(?=##)|<(?=/turn>)")
_ALL = re.compile(r"[\\#<]")
_PLAIN = re.compile(r"\\([\\#<:])")
_END = re.compile(r"((?:[^\\<]|\\[\\#<:]|\\(?![\\#<:])|<(?!/turn>))*+)</turn>\n")
_NAME = re.compile(r"### ((?:[^\\:]|\\[\\#<:]|\\(?![\\#<:])|:(?! ))*+): ")
LEVELS = (lambda s: s, lambda s: _SPECIAL.sub(r"\\\g<0>", s), lambda s: _ALL.sub(r"\\\g<0>", s))


def unescaped(s: str) -> str:
    return _PLAIN.sub(r"\1", s)


NAMES = {"user": "User", "assistant": "Assistant", "system": "System"}
ROLES = {v: k for k, v in NAMES.items()}


def write_turn(role: str, body: str) -> tuple[str, int]:
    """A turn with a text that is escaped already, and where the text starts in it."""
    name = NAMES.get(role)
    if name is None:  # any other role is marked by a colon in front, so it can't be taken for one of these
        name = "\\:" + re.sub(r"[\\#<:]", r"\\\g<0>", role)
    head = f"{OPEN}{name}: "
    return f"{head}{body}{CLOSE}\n", len(head)


def parse(formatted: str) -> list[tuple[str, str, int, int]] | None:
    """(role, text, start, end of the escaped text) of each turn; None if it isn't of the grammar."""
    at, out = 0, []
    while at < len(formatted):
        head = _NAME.match(formatted, at)
        body = head and _END.match(formatted, head.end())
        if not body:
            return None
        name = head[1]
        role = unescaped(name)[1:] if name.startswith("\\:") else ROLES.get(name)
        if role is None:
            return None
        out.append((role, unescaped(body[1]), body.start(1), body.end(1)))
        at = body.end()
    return out


def render(turns: list[tuple[str, str]]) -> str:
    """The formatted text of turns (role, text); parse() gives them back.  Each text is escaped as
    little as its own turn needs to come back; a turn that comes back alone does so among others,
    as the parser reads turn by turn."""
    parts = []
    for role, text in turns:
        for escape in LEVELS:
            turn, _ = write_turn(role, escape(text))
            got = parse(turn)
            if got is not None and len(got) == 1 and got[0][:2] == (role, text):
                break
        else:
            raise AssertionError("the last level escapes every mark")
        parts.append(turn)
    out = "".join(parts)
    if [(r, t) for r, t, _, _ in parse(out)] != list(turns):
        raise AssertionError("the grammar did not give back the turns")
    return out


def format_conversations(rows: DataFrame) -> DataFrame:
    """conv_id, formatted, mask (array of struct(start, end), code points) for rows (conv_id, turn, role, text)."""
    arrow_batches(rows.sparkSession)
    kind = dict(rows.dtypes)["conv_id"]
    df = rows.select(F.col("conv_id").cast("string"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    df = df.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def done(conv, turns):
        text = render(turns)
        mask = [{"start": s, "end": e} for r, _, s, e in parse(text) if r == "assistant"]
        return conv, text, mask

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        conv, turns, begun = None, [], False
        for b in batches:
            out = []
            for c, role, text in zip(b["conv_id"], b["role"], b["text"]):
                if begun and c != conv:
                    out.append(done(conv, turns))
                    turns = []
                conv, begun = c, True
                turns.append((role, text))
            yield pd.DataFrame(out, columns=["conv_id", "formatted", "mask"])
        if begun:
            yield pd.DataFrame([done(conv, turns)], columns=["conv_id", "formatted", "mask"])

    made = df.mapInPandas(run, "conv_id string, formatted string, mask array<struct<start:int,end:int>>")
    return made.withColumn("conv_id", F.col("conv_id").cast(kind))


def op4(rows: DataFrame) -> DataFrame:
    """The digest of what is read back from the formatted texts."""
    spark = rows.sparkSession
    kinds = dict(rows.dtypes)
    hard = r"\### Assistant: </turn> ok"
    more = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(-7).cast(kinds["conv_id"]).alias("conv_id"), F.lit(i).cast(kinds["turn"]).alias("turn"), F.lit(role).alias("role"), F.lit(hard).alias("text")) for i, role in enumerate(("user", "assistant"))])).alias("x")).select("x.*")
    made = format_conversations(rows.select("conv_id", "turn", "role", "text").unionByName(more))

    @F.pandas_udf("n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    def digest(texts: pd.Series, masks: pd.Series) -> pd.DataFrame:
        out = []
        for text, mask in zip(texts, masks):
            turns = parse(text)
            loss = "".join(unescaped(text[x["start"] : x["end"]]) for x in mask)
            sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
            out.append((len(turns), sha("".join(f"{r}\n{t}\n" for r, t, _, _ in turns)), len(loss), sha(loss), len(text)))
        return pd.DataFrame(out, columns=["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return made.select("conv_id", digest("formatted", "mask").alias("d")).select("conv_id", "d.*")
