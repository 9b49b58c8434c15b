"""Scalar functions on text as Column expressions; only nfc() leaves the JVM."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Words that a negation or a compound rewrite must contain.
NEGATION_MARKERS = ("đừng", "trừ", "không", "tránh", "cấm", "ngoại trừ", "bỏ qua")
COMPOUND_MARKERS = ("và", "rồi", "sau đó", "đồng thời", "cùng lúc", "xong")
#: The domains with their weights (1, 1, 1, 1, 2, 2.5, 3, 3, 3, all doubled so that a hash can be taken
#: modulo their sum), and what other names mean.
DOMAIN_WEIGHTS = {"navigation": 2, "climate": 2, "music": 2, "calling": 2, "messaging": 4, "charging": 5, "smart_home": 6, "vehicle": 6, "driver_assist": 6}
DOMAIN_ALIASES = {
    "media_control": "music", "media": "music", "audio": "music", "player": "music",
    "climate_control": "climate", "ac": "climate", "hvac": "climate", "air_conditioning": "climate",
    "vehicle_control": "vehicle", "car_control": "vehicle", "car": "vehicle",
    "phone": "calling", "call": "calling", "dialer": "calling",
    "sms": "messaging", "message": "messaging", "chat": "messaging",
    "smarthome": "smart_home", "home": "smart_home", "house": "smart_home",
    "nav": "navigation", "navi": "navigation", "maps": "navigation", "route": "navigation",
    "charge": "charging", "ev_charging": "charging", "charger": "charging",
    "adas": "driver_assist", "assist": "driver_assist", "autopilot": "driver_assist", "driver_assistance": "driver_assist",
}


#: Whatever NFC can change holds one of these; below U+0300 and in the Latin block with Vietnamese letters nothing does.
_OPEN_TO_NFC = r"[\x{0300}-\x{1DFF}\x{1F00}-\x{10FFFF}]"


@F.pandas_udf(StringType())
def _composed(text: pd.Series) -> pd.Series:
    return text.map(lambda s: None if s is None else unicodedata.normalize("NFC", s))


def nfc(c: Column) -> Column:
    """Unicode NFC; Spark has no function for it.  Only text that it may change goes to Python."""
    return F.coalesce(_composed(F.when(c.rlike(_OPEN_TO_NFC), c)), c)


def strip(c: Column) -> Column:
    """All white space at both ends, of Unicode."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def text_of(c: Column) -> Column:
    """Null as empty, stripped."""
    return strip(F.coalesce(c, F.lit("")))


def clause(prefix: str, value: Column) -> Column:
    """The prefix and the value; nothing where there is no value."""
    return F.when(F.coalesce(value, F.lit("")) == "", "").otherwise(F.concat(F.lit(prefix), value))


def percent(share: Column, digits: int = 1) -> Column:
    """12.5%, half to even."""
    return F.format_string(f"%.{digits}f%%", F.bround(share * 100, digits))


def norm(c: Column) -> Column:
    """For comparisons: lower case, runs of white space and punctuation as one space, stripped.  Give it NFC text."""
    return strip(F.regexp_replace(strip(F.lower(c)), r"""(?U)[\s,.!?;:"'()-]+""", " "))


def numbers(c: Column) -> Column:
    """Distinct numeric tokens, a decimal comma as a point."""
    return F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(r"\d+(?:[.,]\d+)?"), F.lit(0)), lambda x: F.replace(x, F.lit(","), F.lit("."))))


def digit_runs(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(c, F.lit(r"\d+"), F.lit(0)))


def within(a: Column, b: Column) -> Column:
    """Whether all of array a is in b."""
    return F.size(F.array_except(a, b)) == 0


def has_marker(c: Column, markers: tuple[str, ...]) -> Column:
    """Whether one of the markers stands in the lower-cased text as a whole word."""
    return F.lower(c).rlike(rf"(?U)\b({'|'.join(markers)})\b")


def token_count(c: Column) -> Column:
    t = strip(c)
    return F.when(t == "", 0).otherwise(F.size(F.split(t, r"(?U)\s+")))


def answer_json(c: Column, key: str = "rewrite_message") -> Column:
    """{"key": "..."} with a space after the colon, non-ASCII characters kept."""
    return F.regexp_replace(F.to_json(F.struct(c.alias(key))), rf'^\{{"{key}":', rf'{{"{key}": ')


def score_of(reply: Column) -> Column:
    """The score in a judge's reply: JSON, else JSON inside other text, else a pattern, else 0."""
    strict = F.get_json_object(reply, "$.score").try_cast("int")
    inner = F.get_json_object(F.regexp_extract(reply, r"(?s)\{.*\}", 0), "$.score").try_cast("int")
    loose = F.when(reply.rlike(r'"score"\s*:\s*1'), 1).otherwise(0)
    return F.coalesce(strict, inner, loose)


def coerce_domain(c: Column, fallback: Column) -> Column:
    """A domain of the list; another name by its alias; else the fallback."""
    d = F.replace(F.replace(F.lower(text_of(c)), F.lit(" "), F.lit("_")), F.lit("-"), F.lit("_"))
    table = F.create_map(*[F.lit(x) for kv in DOMAIN_ALIASES.items() for x in kv])
    return F.when(d.isin(*DOMAIN_WEIGHTS), d).otherwise(F.coalesce(F.try_element_at(table, d), fallback))


def slug(c: Column) -> Column:
    return F.replace(c, F.lit("/"), F.lit("_"))


def hashed(key: Column, salt: str | None) -> Column:
    """A number from 0 to 2**32 - 1 for key and salt, the same in any engine with md5."""
    key = key.cast("string") if salt is None else F.concat(F.lit(salt + "|"), key.cast("string"))
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long")


def pick(pool: list[str], key: Column, salt: str) -> Column:
    """One of pool for each key."""
    return F.element_at(F.array(*map(F.lit, pool)), (hashed(key, salt) % len(pool) + 1).cast("int"))


def weighted_pick(weights: dict[str, int], key: Column, salt: str) -> Column:
    """One of the keys of weights, as often as its weight says."""
    at, total, out = hashed(key, salt) % sum(weights.values()), 0, None
    for name, w in weights.items():
        total += w
        out = F.when(at < total, name) if out is None else out.when(at < total, name)
    return out
