"""Dialogues: from turn rows to arrays and back, rendering, parsing, and the record formats.

Assembling is one shuffle by conversation; all else is local to a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import answer_json, strip
from ..schema import SYSTEM_PROMPT, TAG, TURNS

HEADER = r"(?iU)^(user|bot)\s*:\s*(.+)$"


def assemble(rows: DataFrame) -> DataFrame:
    """conv_id, system, turns (role user or bot) for rows (conv_id, turn, role, text)."""
    all_ = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    df = rows.groupBy("conv_id").agg(all_.alias("x"))
    turn = lambda x: F.struct(F.when(x["role"] == "assistant", "bot").otherwise(x["role"]).alias("role"), x["text"].alias("content"))
    return df.select(
        "conv_id",
        F.get(F.filter("x", lambda x: x["role"] == "system"), F.lit(0))["text"].alias("system"),
        F.transform(F.filter("x", lambda x: x["role"] != "system"), turn).alias("turns"),
    )


def with_gold(df: DataFrame) -> DataFrame:
    """A last bot turn is the gold answer and leaves the turns; gold is null otherwise."""
    last = F.element_at("turns", -1)
    bot = last["role"] == "bot"
    return df.withColumn("gold", F.when(bot, last["content"])).withColumn("turns", F.when(bot, F.expr("slice(turns, 1, size(turns) - 1)")).otherwise(F.col("turns")))


def users(turns: Column) -> Column:
    return F.filter(turns, lambda t: t["role"] == "user")


def last_user(turns: Column) -> Column:
    return F.try_element_at(users(turns), F.lit(-1))["content"]


def render(turns: Column) -> Column:
    """Lines "role: content"."""
    return F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit(": "), t["content"])), "\n")


def _let(value: Column, then) -> Column:
    """then(value), which is computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def parse(blob: Column) -> Column:
    """Turns of a rendered dialogue: a line "role: text" begins a turn, another line that is not
    blank goes on with the turn before, lines before the first turn are dropped.  Linear in the text."""

    def line(x: Column) -> Column:
        role = F.lower(F.regexp_extract(x, HEADER, 1))
        return _let(role, lambda r: F.struct(r.alias("role"), strip(F.when(r != "", F.regexp_extract(x, HEADER, 2)).otherwise(x)).alias("text")))

    def turns(lines: Column) -> Column:
        heads = F.filter(F.transform(lines, lambda x, i: F.when(x["role"] != "", i)), lambda i: i.isNotNull())

        def turn(heads: Column, i: Column, k: Column) -> Column:
            own = F.slice(lines, i + 1, F.coalesce(F.get(heads, k + 1), F.size(lines)) - i)
            return F.struct(F.get(lines, i)["role"].alias("role"), F.array_join(F.transform(F.filter(own, lambda x, j: (j == 0) | (x["text"] != "")), lambda x: x["text"]), " ").alias("content"))

        return _let(heads, lambda h: F.transform(h, lambda i, k: turn(h, i, k)))

    return _let(F.transform(F.split(blob, "\n"), line), turns)


def explode_turns(df: DataFrame, key: str = "conv_id") -> DataFrame:
    """Rows (key, turn, role, text) of arrays of turns."""
    return df.select(key, F.posexplode("turns").alias("turn", "t")).select(key, F.col("turn").cast("long").alias("turn"), F.col("t.role").alias("role"), F.col("t.content").alias("text"))


# --- record formats ------------------------------------------------------------------------


def _part(who: str, value: Column) -> Column:
    return F.struct(F.lit(who).alias("from"), value.alias("value"))


def to_conversations(turns: Column, answer: Column, system: str = SYSTEM_PROMPT) -> Column:
    """System, the turns as human and gpt with the last one tagged, and the answer as JSON;
    null unless the last turn is the user's."""
    body = F.transform(turns, lambda t, i: F.struct(F.when(t["role"] == "user", "human").otherwise("gpt").alias("from"), F.when(i == F.size(turns) - 1, F.concat(F.lit(TAG), t["content"])).otherwise(t["content"]).alias("value")))
    out = F.concat(F.array(_part("system", F.lit(system))), body, F.array(_part("gpt", answer_json(strip(answer)))))
    return F.when(F.try_element_at(turns, F.lit(-1))["role"] == "user", out)


def messages_to_conversations(messages: Column, system: str = SYSTEM_PROMPT) -> Column:
    """Of a messages record: needs three messages, a user's blob and an assistant's answer, and a last turn of the user."""
    of = lambda role: F.get(F.filter(messages, lambda m: m["role"] == role), F.lit(0))["content"]
    return F.when((F.size(messages) >= 3) & of("user").isNotNull() & of("assistant").isNotNull(), to_conversations(parse(of("user")), of("assistant"), system))


def messages(turns: Column, answer: Column, system: str = SYSTEM_PROMPT) -> Column:
    """The messages record of a sample: system, the rendered dialogue, the answer."""
    m = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    return F.array(m("system", F.lit(system)), m("user", render(turns)), m("assistant", answer))


def untagged(c: Column) -> Column:
    return F.regexp_replace(c, "^" + TAG, "")


def compact(conversations: Column) -> Column:
    """Without system and answer, the tag taken off; from and value stay."""
    rest = F.filter(conversations, lambda x: x["from"] != "system")
    return F.transform(F.slice(rest, 1, F.size(rest) - 1), lambda x: F.struct(x["from"].alias("from"), untagged(x["value"]).alias("value")))


def gold_of(conversations: Column) -> Column:
    last = F.element_at(conversations, -1)
    return F.when(last["from"] == "gpt", F.get_json_object(last["value"], "$.rewrite_message"))


def to_turns(conversations: Column) -> Column:
    return F.transform(compact(conversations), lambda x: F.struct(F.when(x["from"] == "human", "user").otherwise("bot").alias("role"), x["value"].alias("content")))


def from_compact(dialogue: Column, answer: Column, system: str = SYSTEM_PROMPT) -> Column:
    """The conversations of a compact dialogue (from, value) with its answer."""
    return to_conversations(F.transform(dialogue, lambda x: F.struct(F.when(x["from"] == "human", "user").otherwise("bot").alias("role"), x["value"].alias("content"))), answer, system)


def augmented_record(dialogue: Column, answer: Column, meta: Column) -> Column:
    """The record of a variant: its conversations, and the original's meta with augmented set."""
    return F.struct(from_compact(dialogue, answer).alias("conversations"), meta.withField("augmented", F.lit(True)).alias("meta"))


def chat_role(c: Column) -> Column:
    """Names of chat templates; unknown ones stay."""
    return F.when(c == "human", "user").when(c == "gpt", "assistant").when(c == "bot", "assistant").otherwise(c)


def chat_messages(conversations: Column) -> Column:
    return F.transform(conversations, lambda x: F.struct(chat_role(x["from"]).alias("role"), x["value"].alias("content")))


def prompt_and_gold(conversations: Column) -> Column:
    """struct(prompt, gold): all chat messages but the last, and the last one's content; fails where the last is not the assistant's."""
    m = chat_messages(conversations)
    last = F.try_element_at(m, F.lit(-1))
    bad = F.raise_error(F.lit("the last part of a sample must be the assistant's")).cast("struct<prompt:" + TURNS + ",gold:string>")
    return F.when(last["role"].eqNullSafe("assistant"), F.struct(F.slice(m, 1, F.size(m) - 1).alias("prompt"), last["content"].alias("gold"))).otherwise(bad)


#: Names of the conversation format's columns and tags.
SHAREGPT = {"messages": "conversations", "role_tag": "from", "content_tag": "value", "user_tag": "human", "assistant_tag": "gpt", "system_tag": "system"}


def mapped(df: DataFrame, names: dict[str, str] = SHAREGPT) -> Column:
    """Messages (role, content) of records whose column and tags have other names; roles without a tag keep theirs."""
    role = F.create_map(*[F.lit(x) for tag, to in (("user_tag", "user"), ("assistant_tag", "assistant"), ("system_tag", "system")) for x in (names[tag], to)])
    one = lambda x: F.struct(F.coalesce(F.try_element_at(role, x[names["role_tag"]]), x[names["role_tag"]]).alias("role"), x[names["content_tag"]].alias("content"))
    return F.transform(df[names["messages"]], one)


def seed_samples(df: DataFrame) -> DataFrame:
    """Records (conversations, meta) as seed samples; context_required is taken from meta and true where absent."""
    return df.select(
        to_turns(F.col("conversations")).alias("turns"), gold_of(F.col("conversations")).alias("rewrite"), F.coalesce("meta.domain", F.lit("navigation")).alias("domain"),
        F.coalesce("meta.context_required", F.lit(True)).alias("context_required"), F.col("meta.pattern").alias("pattern"),
    ).withColumns({"user_turns": F.size(users(F.col("turns"))), "total_turns": F.size("turns")})
