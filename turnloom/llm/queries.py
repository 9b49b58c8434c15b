"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .shared import table


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import html

    return html.op1(table(spark, sf_dir, "pages"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import substrings

    return substrings.op2(table(spark, sf_dir, "documents"))


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import chat

    return chat.op4(table(spark, sf_dir, "conversations"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import decontam

    return decontam.op3(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import rules

    return rules.op6(table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import packing

    return packing.op5(table(spark, sf_dir, "documents"))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import lm

    return lm.op7(table(spark, sf_dir, "documents"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality

    return quality.op8(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import simhash

    return simhash.op9(table(spark, sf_dir, "documents"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import pii

    return pii.op10(table(spark, sf_dir, "documents"))


def op11_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import repair

    return repair.op11(table(spark, sf_dir, "conversations"))


def op12_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import mixing

    return mixing.op12(table(spark, sf_dir, "documents"))


def op13_rolling_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import rolling

    return rolling.op13(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_html_extraction, op2_substring_dedup, op3_decontamination, op4_chat_formatting, op5_packing, op6_quality_rules, op7_lm_scoring, op8_quality_classifier, op9_simhash, op10_pii, op11_structure_repair, op12_source_mixing, op13_rolling_windows)}


_WORDS = """regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"""

OP3 = f"""
WITH b AS (SELECT item_id::VARCHAR AS id, {_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT id, least(len(w), 13) AS size, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS k FROM b, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS t(i) WHERE len(w) > 0),
d AS (SELECT row_number() OVER () AS uid, doc_id, {_WORDS} AS w FROM documents),
dw AS (SELECT uid, i, size, array_to_string(w[i:i + size - 1], ' ') AS k FROM d, (SELECT DISTINCT size FROM win) s, unnest(range(1, len(w) - size + 2)) AS t(i)),
f AS (SELECT DISTINCT uid, i, size, id FROM dw JOIN win USING (size, k)),
h AS (SELECT uid, count(DISTINCT p) AS n_hit FROM f, unnest(range(i, i + size)) AS t(p) GROUP BY uid),
n AS (SELECT uid, count(DISTINCT id) AS n_items, string_agg(DISTINCT id, ',' ORDER BY id) AS ids FROM f GROUP BY uid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated FROM d LEFT JOIN h USING (uid) LEFT JOIN n USING (uid)
"""

OP6 = """
WITH d AS (SELECT row_number() OVER () AS uid, doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
x AS (SELECT uid, i, array_to_string(w[i:i + 7], ' ') AS k FROM d, unnest(range(1, len(w) - 6)) AS t(i)),
y AS (SELECT uid, i, count(*) OVER (PARTITION BY uid, k) AS n FROM x),
r AS (SELECT uid, count(DISTINCT p) AS n_repeat_words FROM y, unnest(range(i, i + 8)) AS t(p) WHERE n > 1 GROUP BY uid),
l AS (SELECT uid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT uid, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY uid),
e AS (SELECT uid, doc_id, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_lines, 0) AS n_lines,
  coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(w) < 20 OR 100 * coalesce(n_repeat_words, 0) > 30 * len(w) AS base_failed
  FROM d LEFT JOIN r USING (uid) LEFT JOIN l USING (uid)),
f AS (SELECT *, base_failed OR n_symbols * 10 > n_words OR n_dup_lines * 10 > n_lines * 3 OR word_chars < n_words * 3 OR word_chars > n_words * 10 AS failed FROM e),
g AS (SELECT source, count(*)::DOUBLE AS n, sum(failed::INT)::DOUBLE AS bad, bad / n AS rate FROM f WHERE source IS NOT NULL GROUP BY source),
o AS (SELECT *, count(*) OVER () - 1 AS k, sum(n) OVER () - n AS on_, sum(bad) OVER () - bad AS obad, sum(rate) OVER () - rate AS orate, sum(rate * rate) OVER () - rate * rate AS orate2, sum(1 / n) OVER () - 1 / n AS oinv FROM g),
m AS (SELECT source, n, bad, least(greatest(obad / on_, 1e-3), 1 - 1e-3) AS mean, orate2 / k - (orate / k) * (orate / k) AS var, oinv / k AS inv FROM o WHERE k > 0),
s AS (SELECT *, least(greatest(mean * (1 - mean) / greatest(var - mean * (1 - mean) * inv, 1e-6) - 1, 2.0), 1000.0) AS strength FROM m),
v AS (SELECT source, mean, strength, (bad + mean * strength) / (n + strength) AS rate, n + strength + 1 AS size FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT coalesce(rate - 2 * sqrt(rate * (1 - rate) / size) > mean + 2 * sqrt(mean * (1 - mean) / (strength + 1)), false) AS kept FROM f LEFT JOIN v USING (source)
"""


def _crc32(text: str) -> str:
    """crc32 of an ASCII text, bit by bit."""
    byte = "list_reduce(list_prepend(xor(a, b), range(8)), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda c: ascii(c)::BIGINT)), lambda a, b: {byte}), 4294967295::BIGINT)"


#: What each state (0 nothing, 1 after s, 2 after u, 3 after a) becomes when a row is kept, and by rerole or insert.
_NEXT = "CASE WHEN r = 's' AND {x} = 0 THEN 1 WHEN r = 'u' AND {x} IN (0, 1, 3) THEN 2 WHEN r = 'a' AND {x} = 2 THEN 3 END"


def _step(x: int) -> str:
    """The cheapest edit of a row in state x: cost, letters and text of all that follows; insertions apart."""
    forced, role = (3, "assistant") if x == 2 else (2, "user")
    kept = f"list_extract([s0, s1, s2, s3], ({_NEXT.format(x=x)}) + 1)"
    options = [
        f"{{'c': s{x}.c + 4, 'a': 'D' || s{x}.a, 't': s{x}.t}}",
        f"CASE WHEN fault IN ('sound', 'short') THEN {{'c': s{forced}.c + 3 + extra, 'a': 'R' || s{forced}.a, 't': chr(10) || '{role}:' || said || s{forced}.t}} END",
        f"CASE WHEN fault IN ('sound', 'short') AND ({_NEXT.format(x=x)}) IS NOT NULL THEN {{'c': {kept}.c + extra, 'a': 'K' || {kept}.a, 't': chr(10) || role || ':' || said || {kept}.t}} END",
    ]
    return f"list_min(list_filter([{', '.join(options)}], lambda o: o IS NOT NULL))"


def _put(x: int, to: int, role: str, names: str) -> str:
    return f"least({names}{x}, {{'c': {names}{to}.c + 3, 'a': 'I' || {names}{to}.a, 't': chr(10) || '{role}:' || {names}{to}.t}})"


OP11 = f"""
WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS said, {_crc32("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS k FROM conversations),
d AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN translate(said, '.!?', '') ELSE said END AS said FROM k, unnest(range(CASE WHEN k = 3 THEN 2 ELSE 1 END)) WHERE k <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, said) AS i,
  regexp_extract(said, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS last FROM d),
e AS (SELECT *, left(role, 1) AS r, CASE WHEN last = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, said ORDER BY i) > 1 THEN 'again' WHEN last IN ('.', '!', '?') THEN 'sound' ELSE 'short' END AS fault, lead(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS following FROM o),
f AS (SELECT *, CASE WHEN fault = 'short' THEN 3 ELSE 0 END AS extra FROM e),
n AS (SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'again') AS duplicate, count(*) FILTER (fault = 'short') AS truncated,
  count(*) FILTER (following IS NOT NULL AND r || following NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM f GROUP BY conv_id),
p(conv_id, i, s0, s1, s2, s3) AS (
  SELECT conv_id, n, {{'c': 0, 'a': '', 't': ''}}, {{'c': 6, 'a': 'II', 't': chr(10) || 'user:' || chr(10) || 'assistant:'}}, {{'c': 3, 'a': 'I', 't': chr(10) || 'assistant:'}}, {{'c': 0, 'a': '', 't': ''}} FROM n
  UNION ALL
  SELECT conv_id, i - 1, {_put(0, 2, "user", "v")}, {_put(1, 2, "user", "v")}, v2, v3 FROM (SELECT conv_id, i, b0 AS v0, b1 AS v1, {_put(2, 3, "assistant", "b")} AS v2, {_put(3, 2, "user", "b")} AS v3 FROM (
    SELECT p.conv_id, p.i, {_step(0)} AS b0, {_step(1)} AS b1, {_step(2)} AS b2, {_step(3)} AS b3 FROM p JOIN f ON p.conv_id IS NOT DISTINCT FROM f.conv_id AND p.i = f.i)))
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  coalesce(s0.c, 0)::BIGINT AS cost, coalesce(s0.a, '') AS audit, sha256(coalesce(s0.t[2:], '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN n ON c.conv_id IS NOT DISTINCT FROM n.conv_id LEFT JOIN p ON c.conv_id IS NOT DISTINCT FROM p.conv_id AND p.i = 0
"""

OP13 = f"""
WITH d AS (SELECT doc_id, source, lang, length(text) AS len, 60 * CAST(floor((doc_id + {_crc32("doc_id::VARCHAR")} % 1000) / 6) AS BIGINT) AS event_s FROM documents),
w AS (SELECT *, 1800 AS window_s, count(*) OVER w AS n, sum(len) OVER w AS total, count(DISTINCT lang) OVER w AS langs, list_sort(list(len) FILTER (len IS NOT NULL) OVER w) AS l FROM d WHERE event_s IS NOT NULL WINDOW w AS (PARTITION BY source ORDER BY event_s RANGE BETWEEN 1800 PRECEDING AND 60 PRECEDING)
  UNION ALL SELECT *, 86400, count(*) OVER w, sum(len) OVER w, count(DISTINCT lang) OVER w, list_sort(list(len) FILTER (len IS NOT NULL) OVER w) FROM d WHERE event_s IS NOT NULL WINDOW w AS (PARTITION BY source ORDER BY event_s RANGE BETWEEN 86400 PRECEDING AND 60 PRECEDING)
  UNION ALL SELECT *, unnest([1800, 86400]), 0, 0, 0, [] FROM d WHERE event_s IS NULL)
SELECT doc_id, window_s::BIGINT AS window_s, event_s, n::BIGINT AS n_events, coalesce(total, 0)::BIGINT AS sum_chars, langs::BIGINT AS n_langs,
  l[(len(l) + 1) // 2]::BIGINT AS median_chars, l[(99 * len(l) + 99) // 100]::BIGINT AS high_chars FROM w
"""


def oracle_sql() -> dict[str, str]:
    """For queries that SQL can express; the others are tested against plain Python."""
    return {"op3_decontamination": OP3, "op6_quality_rules": OP6, "op11_structure_repair": OP11, "op13_rolling_windows": OP13}
