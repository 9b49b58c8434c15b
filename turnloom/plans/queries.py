"""The engine's queries over the driver's tables, each with the SQL that another engine runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import hooks, storage
from ..functions import text as X
from ..operators import contain, dedup, dialogue, evaluate, sample, validate
from ..schema import PATTERNS, SYSTEM_PROMPT
from ..sources import ingest
from ..streaming import resume
from . import templates

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql.strip()
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- pieces of SQL for the other engine ------------------------------------------------------


def h(key: str, salt: str) -> str:
    return f"(('0x' || substr(md5('{salt}|' || {key}), 1, 8))::BIGINT)"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def norm(x: str) -> str:
    return strip(f"regexp_replace({strip(f'lower({x})')}, '[\\s,.!?;:\"''()-]+', ' ', 'g')")


def numbers(x: str) -> str:
    return f"list_distinct(list_transform(regexp_extract_all({x}, '\\d+(?:[.,]\\d+)?'), lambda n: replace(n, ',', '.')))"


def runs(x: str) -> str:
    return f"list_distinct(regexp_extract_all({x}, '\\d+'))"


def inside(a: str, b: str) -> str:
    return f"(len(list_filter({a}, lambda x: NOT list_contains({b}, x))) = 0)"


def marker(x: str, words: tuple[str, ...]) -> str:
    return f"regexp_matches(lower({x}), '(^|[^\\p{{L}}\\p{{N}}_])({'|'.join(words)})($|[^\\p{{L}}\\p{{N}}_])')"


def tokens(x: str) -> str:
    return f"(CASE WHEN {strip(x)} = '' THEN 0 ELSE len(regexp_split_to_array({strip(x)}, '\\s+')) END)"


def answer(x: str) -> str:
    return f"'{{\"rewrite_message\": ' || to_json({x})::VARCHAR || '}}'"


CONV = """
conv AS (SELECT conv_id, turn, CASE role WHEN 'assistant' THEN 'bot' ELSE role END AS role, text FROM conversations WHERE role <> 'system'),
dlg AS (SELECT conv_id, list({'role': role, 'content': text} ORDER BY turn) AS all_turns FROM conv GROUP BY conv_id),
gd AS (SELECT conv_id, all_turns, CASE WHEN all_turns[-1].role = 'bot' THEN all_turns[-1].content END AS gold,
  CASE WHEN all_turns[-1].role = 'bot' THEN all_turns[1:len(all_turns) - 1] ELSE all_turns END AS turns FROM dlg)
"""
USERS = "list_filter(turns, lambda t: t.role = 'user')"
RENDER = "array_to_string(list_transform(turns, lambda t: t.role || ': ' || t.content), chr(10))"


def _pattern(key: str) -> str:
    return f"CASE {h(key, 'pattern')} % 8 " + " ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(PATTERNS)) + " END"


def _domain(key: str, salt: str = "domain") -> str:
    at, out = 0, "CASE"
    for name, w in X.DOMAIN_WEIGHTS.items():
        at += w
        out += f" WHEN {h(key, salt)} % {sum(X.DOMAIN_WEIGHTS.values())} < {at} THEN '{name}'"
    return out + " END"


SAMPLES = f"""
WITH {CONV}, s AS (SELECT conv_id, turns, {USERS}[-1].content AS last_user, coalesce(gold, {USERS}[-1].content) AS rewrite, gold,
  {h('conv_id', 'ctx')} % 3 <> 0 AS context_required, len({USERS})::INT AS user_turns, {_domain('conv_id')} AS domain, {_pattern('conv_id')} AS pattern FROM gd)
"""


def dialogues(spark: SparkSession, sf: str) -> DataFrame:
    return dialogue.with_gold(dialogue.assemble(table(spark, sf, "conversations")))


def samples(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as accepted samples: context, domain and pattern by hash."""
    key, last = F.col("conv_id"), dialogue.last_user(F.col("turns"))
    return dialogues(spark, sf).select(
        "conv_id", "turns", last.alias("last_user"), F.coalesce("gold", last).alias("rewrite"), "gold",
        (X.hashed(key, "ctx") % 3 != 0).alias("context_required"), F.size(dialogue.users(F.col("turns"))).alias("user_turns"),
        X.weighted_pick(X.DOMAIN_WEIGHTS, key, "domain").alias("domain"), X.pick(list(PATTERNS), key, "pattern").alias("pattern"),
    )


def big(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("long")


def listed(c: Column) -> Column:
    return F.array_join(F.array_sort(c), ",")


# --- dialogues -----------------------------------------------------------------------------


@query(f"""WITH {CONV} SELECT conv_id, len(turns)::BIGINT AS n_turns, len({USERS})::BIGINT AS user_turns,
  array_to_string(list_transform(turns, lambda t: t.role), '>') AS shape FROM (SELECT conv_id, all_turns AS turns FROM dlg)""")
def q01_dialogue_assemble(spark, sf):
    t = F.col("turns")
    df = dialogue.assemble(table(spark, sf, "conversations"))
    return df.select("conv_id", big(F.size(t)).alias("n_turns"), big(F.size(dialogue.users(t))).alias("user_turns"), F.array_join(F.transform(t, lambda x: x["role"]), ">").alias("shape"))


@query(f"WITH {CONV} SELECT conv_id, {RENDER} AS blob FROM (SELECT conv_id, all_turns AS turns FROM dlg)")
def q02_dialogue_render(spark, sf):
    return dialogue.assemble(table(spark, sf, "conversations")).select("conv_id", dialogue.render(F.col("turns")).alias("blob"))


@query(f"""WITH {CONV}, l AS (SELECT conv_id, turn, role, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM conv),
  t AS (SELECT conv_id, turn, any_value(role) AS role, string_agg({strip('line')}, ' ' ORDER BY k) AS content FROM l WHERE {strip('line')} <> '' GROUP BY conv_id, turn)
  SELECT conv_id, count(*)::BIGINT AS n_turns, string_agg(role || '=' || content, '|' ORDER BY turn) AS contents FROM t GROUP BY conv_id""")
def q03_blob_parse_roundtrip(spark, sf):
    df = dialogue.assemble(table(spark, sf, "conversations")).select("conv_id", dialogue.parse(dialogue.render(F.col("turns"))).alias("turns"))
    return df.select("conv_id", big(F.size("turns")).alias("n_turns"), F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("="), t["content"])), "|").alias("contents"))


@query(f"WITH {CONV} SELECT conv_id, {USERS}[-1].content AS last_user, gold, len(turns)::BIGINT AS n_turns FROM gd")
def q04_last_user_and_gold(spark, sf):
    return dialogues(spark, sf).select("conv_id", dialogue.last_user(F.col("turns")).alias("last_user"), "gold", big(F.size("turns")).alias("n_turns"))


_LF = f"""{SAMPLES}, lf AS (SELECT conv_id, list_concat([{{'from': 'system', 'value': '{SYSTEM_PROMPT}'}}],
  list_transform(turns, lambda t, i: {{'from': CASE WHEN t.role = 'user' THEN 'human' ELSE 'gpt' END, 'value': CASE WHEN i = len(turns) THEN '<REWRITE>' || chr(10) || t.content ELSE t.content END}}),
  [{{'from': 'gpt', 'value': {answer(strip('rewrite'))}}}]) AS c FROM s WHERE turns[-1].role = 'user')"""


def conversations_records(spark, sf):
    df = samples(spark, sf)
    return df.withColumn("conversations", dialogue.to_conversations(F.col("turns"), F.col("rewrite"))).filter("conversations is not null")


@query(f"{_LF} SELECT conv_id, len(c)::BIGINT AS n, array_to_string(list_transform(c, lambda x: x['from']), ',') AS roles, c[-2].value AS last_human, c[-1].value AS answer FROM lf")
def q05_lf_convert(spark, sf):
    c = F.col("conversations")
    return conversations_records(spark, sf).select(
        "conv_id", big(F.size(c)).alias("n"), F.array_join(F.transform(c, lambda x: x["from"]), ",").alias("roles"), F.element_at(c, -2)["value"].alias("last_human"), F.element_at(c, -1)["value"].alias("answer")
    )


@query(f"{SAMPLES} SELECT conv_id, {RENDER} AS blob, {strip('rewrite')} AS gold, len({USERS})::BIGINT AS user_turns, domain, context_required FROM s")
def q06_lf_decode(spark, sf):
    meta = F.struct("domain", "context_required", "pattern").alias("meta")
    df = conversations_records(spark, sf).select("conversations", meta, "conv_id")
    c = F.col("conversations")
    return df.select("conv_id", dialogue.render(dialogue.to_turns(c)).alias("blob"), dialogue.gold_of(c).alias("gold"), big(F.size(F.filter(dialogue.compact(c), lambda x: x["from"] == "human"))).alias("user_turns"), "meta.domain", "meta.context_required")


@query(f"""{_LF} SELECT conv_id, array_to_string(list_transform(c, lambda x: CASE x['from'] WHEN 'human' THEN 'user' WHEN 'gpt' THEN 'assistant' ELSE x['from'] END), ',') AS roles,
  sum(len(x.value))::BIGINT AS chars FROM (SELECT conv_id, c, unnest(c) AS x FROM lf) GROUP BY conv_id, c""")
def q07_chat_role_map(spark, sf):
    m = dialogue.chat_messages(F.col("conversations"))
    df = conversations_records(spark, sf).select("conv_id", m.alias("m"))
    return df.select("conv_id", F.array_join(F.transform("m", lambda x: x["role"]), ",").alias("roles"), big(F.aggregate("m", F.lit(0), lambda a, x: a + F.char_length(x["content"]))).alias("chars"))


# --- text ----------------------------------------------------------------------------------


@query(f"SELECT doc_id, {norm('nfc_normalize(text)')} AS normal FROM documents")
def q08_text_norm(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.norm(X.nfc(F.col("text"))).alias("normal"))


@query(f"SELECT doc_id, array_to_string(list_sort({numbers('text')}), ',') AS found FROM documents")
def q09_numeric_tokens(spark, sf):
    return table(spark, sf, "documents").select("doc_id", listed(X.numbers(F.col("text"))).alias("found"))


@query(f"SELECT doc_id, array_to_string(list_sort({runs('text')}), ',') AS found FROM documents")
def q10_digit_slots(spark, sf):
    return table(spark, sf, "documents").select("doc_id", listed(X.digit_runs(F.col("text"))).alias("found"))


_CORPUS = templates.corpus_sql()


@query(f"SELECT sample_id, {marker('rewrite', X.NEGATION_MARKERS)} AS negation, {marker('blob', X.COMPOUND_MARKERS)} AS compound, {tokens('rewrite')}::BIGINT AS n FROM ({_CORPUS})")
def q11_marker_search(spark, sf):
    df = templates.corpus(spark)
    return df.select("sample_id", X.has_marker(F.col("rewrite"), X.NEGATION_MARKERS).alias("negation"), X.has_marker(F.col("blob"), X.COMPOUND_MARKERS).alias("compound"), big(X.token_count(F.col("rewrite"))).alias("n"))


# --- validation ----------------------------------------------------------------------------

#: Candidates from templates with faults put in by their place; text that both engines run.
_FAULTY = """SELECT sample_id, blob, last_user, n_turns, context_required,
  CASE WHEN (ord + part) % 13 = 0 THEN '' WHEN (ord + part) % 13 = 1 THEN 'ok' WHEN (ord + part) % 13 = 2 THEN last_user || ' !' WHEN (ord + part) % 13 = 3 THEN rewrite || ' 99'
    WHEN (ord + part) % 13 = 4 THEN repeat(rewrite, 20) WHEN (ord + part) % 13 = 5 THEN rewrite || ' và không' ELSE rewrite END AS rewrite,
  CASE WHEN (ord + part) % 17 = 0 THEN '' ELSE domain END AS domain,
  CASE (ord + part) % 11 WHEN 0 THEN 'negation' WHEN 1 THEN 'compound_intent' WHEN 2 THEN 'irrelevant_context' WHEN 3 THEN '' WHEN 4 THEN 'other' WHEN 5 THEN 'negation' ELSE 'correction' END AS pattern
  FROM corpus"""
_SAID = "regexp_replace(blob, '(^|\\n)(user|bot): ', ' ', 'g')"
_OWN = "regexp_replace(regexp_replace(blob, '(^|\\n)bot: [^\\n]*', '', 'g'), '(^|\\n)user: ', ' ', 'g')"
_REASON = f"""CASE WHEN pattern = '' THEN 'no_pattern' WHEN pattern NOT IN ({', '.join(f"'{p}'" for p in PATTERNS)}) THEN 'bad_pattern'
  WHEN n_turns < CASE WHEN context_required = false THEN 1 ELSE 3 END THEN 'too_few_turns'
  WHEN {strip('rewrite')} = '' OR domain = '' THEN 'missing_field'
  WHEN length({strip('rewrite')}) NOT BETWEEN 5 AND 240 THEN 'rewrite_length'
  WHEN {tokens('last_user')} > 25 THEN 'final_user_too_long'
  WHEN coalesce(context_required, true) AND {norm('rewrite')} = {norm('last_user')} THEN 'rewrite_equals_final_turn'
  WHEN NOT {inside(numbers('rewrite'), numbers(_SAID))} THEN 'hallucinated_numbers'
  WHEN pattern = 'irrelevant_context' AND len(list_filter({numbers('rewrite')}, lambda n: list_contains({numbers(_SAID)}, n) AND NOT list_contains({numbers(_OWN)}, n))) > 0 THEN 'leaked_bot_number'
  WHEN pattern = 'negation' AND NOT {marker('rewrite', X.NEGATION_MARKERS)} THEN 'negation_marker_missing'
  WHEN pattern = 'compound_intent' AND NOT {marker('rewrite', X.COMPOUND_MARKERS)} THEN 'compound_connector_missing' END"""
_CHECKED = f"WITH corpus AS ({_CORPUS}), faulty AS ({_FAULTY}), checked AS (SELECT *, {_REASON} AS reason FROM faulty)"


def faulty(spark) -> DataFrame:
    templates.corpus(spark).createOrReplaceTempView("turnloom_corpus")
    return spark.sql(_FAULTY.replace("FROM corpus", "FROM turnloom_corpus").replace("blob, last_user", "turns, blob, last_user"))


def checked(spark) -> DataFrame:
    c = F.col
    return faulty(spark).withColumn("reason", validate.ingest_reason(c("turns"), c("rewrite"), c("domain"), c("pattern"), c("context_required")))


@query(f"{_CHECKED} SELECT sample_id, pattern, reason FROM checked")
def q12_validate_bench(spark, sf):
    return checked(spark).select("sample_id", "pattern", "reason")


#: Conversations in which some turns are missing or of another kind.
_BROKEN = f"""WITH {CONV}, b AS (SELECT conv_id, list({{'role': CASE WHEN conv_id % 7 = 1 AND turn = 2 THEN 'other' ELSE role END, 'content': CASE WHEN conv_id % 9 = 2 AND turn = 1 THEN ' ' ELSE text END}} ORDER BY turn) AS turns
  FROM conv WHERE NOT (conv_id % 5 = 0 AND turn = 1) GROUP BY conv_id),
  v AS (SELECT conv_id, turns, CASE WHEN conv_id % 4 = 0 THEN turns[-1].content || ' 7' WHEN conv_id % 4 = 1 THEN {USERS}[-1].content ELSE 'A request that stands alone.' END AS rewrite, conv_id % 3 <> 0 AS ctx FROM b),
  w AS (SELECT *, list_filter(list_transform(turns, lambda t, i: CASE WHEN t.role NOT IN ('user', 'bot') OR {strip('t.content')} = '' THEN 'bad_turn' WHEN i > 1 AND turns[greatest(i - 1, 1)].role = t.role THEN 'not_alternating' END), lambda r: r IS NOT NULL)[1] AS in_turn FROM v)"""


@query(f"""{_BROKEN} SELECT conv_id, CASE WHEN coalesce({strip('rewrite')}, '') = '' THEN 'missing_field' WHEN length({strip('rewrite')}) NOT BETWEEN 5 AND 240 THEN 'rewrite_length' WHEN in_turn IS NOT NULL THEN in_turn
  WHEN turns[1].role <> 'user' THEN 'not_start_user' WHEN turns[-1].role <> 'user' THEN 'not_end_user' WHEN len({USERS}) <> 2 THEN 'wrong_user_turns'
  WHEN NOT {inside(numbers('rewrite'), numbers("array_to_string(list_transform(turns, lambda t: t.content), ' ')"))} THEN 'hallucinated_number'
  WHEN ctx AND {norm('rewrite')} = {norm(USERS + '[-1].content')} THEN 'ctx_but_identical'
  WHEN NOT ctx AND NOT {inside(numbers('rewrite'), numbers(USERS + '[-1].content'))} THEN 'noctx_pulled_number' END AS reason FROM w""")
def q13_validate_bulk(spark, sf):
    c, turn = F.col("conv_id"), F.col("turn")
    rows = table(spark, sf, "conversations").filter((F.col("role") != "system") & ~((c % 5 == 0) & (turn == 1)))
    rows = rows.withColumn("role", F.when((c % 7 == 1) & (turn == 2), "other").otherwise(F.col("role"))).withColumn("text", F.when((c % 9 == 2) & (turn == 1), " ").otherwise(F.col("text")))
    df = dialogue.assemble(rows)
    t = F.col("turns")
    rewrite = F.when(c % 4 == 0, F.concat(F.element_at(t, -1)["content"], F.lit(" 7"))).when(c % 4 == 1, dialogue.last_user(t)).otherwise("A request that stands alone.")
    df = df.withColumn("rewrite", rewrite)
    return df.select("conv_id", validate.bulk_reason(t, F.col("rewrite"), F.lit("navigation"), c % 3 != 0, F.lit(2)).alias("reason"))


_VARIANTS = f"""{SAMPLES}, p AS (SELECT conv_id, list_transform(turns, lambda t: {{'from': CASE WHEN t.role = 'user' THEN 'human' ELSE 'gpt' END, 'value': t.content}}) AS d, rewrite FROM s),
  o AS (SELECT conv_id, d, rewrite, CASE WHEN conv_id % 6 = 0 THEN d[2:] WHEN conv_id % 6 = 1 THEN list_transform(d, lambda x: {{'from': 'human', 'value': x.value}}) WHEN conv_id % 6 = 2 THEN d
    ELSE list_transform(d, lambda x: {{'from': x['from'], 'value': x.value || ' nhé'}}) END AS other,
    CASE WHEN conv_id % 6 = 2 THEN rewrite WHEN conv_id % 6 = 3 THEN ' ' ELSE rewrite || ' 5' END AS other_rewrite FROM p)"""


def variant_rows(spark, sf) -> DataFrame:
    part = lambda who, v: F.struct(who.alias("from"), v.alias("value"))
    df = samples(spark, sf).select("conv_id", "rewrite", F.transform("turns", lambda t: part(F.when(t["role"] == "user", "human").otherwise("gpt"), t["content"])).alias("d"))
    k, d, r = F.col("conv_id") % 6, F.col("d"), F.col("rewrite")
    other = (
        F.when(k == 0, F.slice(d, 2, F.size(d)))
        .when(k == 1, F.transform(d, lambda x: part(F.lit("human"), x["value"])))
        .when(k == 2, d)
        .otherwise(F.transform(d, lambda x: part(x["from"], F.concat(x["value"], F.lit(" nhé")))))
    )
    new = F.when(k == 2, r).when(k == 3, " ").otherwise(F.concat(r, F.lit(" 5")))
    return df.withColumns({"other": other, "other_rewrite": new})


@query(f"""{_VARIANTS} SELECT conv_id, {strip('other_rewrite')} <> '' AND len(d) = len(other) AND len(list_filter(list_zip(d, other), lambda z: z[1]['from'] <> z[2]['from'] OR {strip('z[2].value')} = '')) = 0
  AND coalesce(other[-1]['from'] = 'human', false) AND {inside(runs('rewrite'), runs('other_rewrite'))} AND NOT ({strip('other_rewrite')} = rewrite AND d = other) AS ok FROM o""")
def q14_validate_variant(spark, sf):
    ok = validate.variant_ok(F.col("d"), F.col("rewrite"), F.col("other"), F.col("other_rewrite"))
    return variant_rows(spark, sf).select("conv_id", ok.alias("ok"))


@query(f"{_CHECKED} SELECT reason, count(*) AS n FROM checked WHERE reason IS NOT NULL GROUP BY reason")
def q15_reject_counts(spark, sf):
    return validate.counters(checked(spark))


@query(f"""{_CHECKED}, r AS (SELECT *, row_number() OVER (PARTITION BY last_user, rewrite, reason IS NULL ORDER BY sample_id) AS rn FROM checked)
  SELECT count(*) AS raw, count(*) FILTER (reason = 'no_pattern') AS no_pattern, count(*) FILTER (reason = 'bad_pattern') AS bad_pattern, count(*) FILTER (reason NOT IN ('no_pattern', 'bad_pattern')) AS rejected,
  count(*) FILTER (reason IS NULL AND rn > 1) AS duplicate, count(*) FILTER (reason IS NULL AND rn = 1) AS kept, avg(context_required::INT::DOUBLE) FILTER (reason IS NULL AND rn = 1) AS context_share FROM r""")
def q16_ingest_stats(spark, sf):
    return validate.ingest_stats(checked(spark), ["last_user", "rewrite"], ["sample_id"])


@query(f"SELECT conv_id, CASE WHEN {h('conv_id', 'hard')} % 10 = 0 THEN 'drop' WHEN {h('conv_id', 'soft')} % 11 < 8 THEN 'fix' ELSE 'keep' END AS verdict FROM (SELECT DISTINCT conv_id FROM conversations)")
def q17_qc_verdict(spark, sf):
    key = F.col("conv_id")
    return table(spark, sf, "conversations").select("conv_id").distinct().select("conv_id", validate.qc_verdict(X.hashed(key, "soft") % 11, X.hashed(key, "hard") % 10 == 0).alias("verdict"))


# --- deduplication and merging -------------------------------------------------------------


@query("SELECT min(doc_id) AS doc_id, text, arg_min(source, doc_id) AS source FROM documents GROUP BY text")
def q18_dedup_first(spark, sf):
    return dedup.first_wins(table(spark, sf, "documents").select("doc_id", "text", "source"), ["text"], ["doc_id"])


@query("SELECT max(doc_id) AS doc_id, text, arg_max(source, doc_id) AS source, min(doc_id) AS first_order FROM documents GROUP BY text")
def q19_dedup_last(spark, sf):
    return dedup.last_wins(table(spark, sf, "documents").select("doc_id", "text", "source"), ["text"], ["doc_id"])


@query(f"""{SAMPLES}, v AS (SELECT conv_id, last_user || CASE WHEN conv_id % 2 = 0 THEN '' ELSE ' nhé' END AS last_user, rewrite, true AS is_variant FROM s WHERE conv_id % 3 = 0),
  u AS (SELECT conv_id, last_user, rewrite, false AS is_variant FROM s UNION ALL SELECT * FROM v)
  SELECT conv_id, last_user, rewrite, is_variant FROM (SELECT *, row_number() OVER (PARTITION BY last_user, rewrite ORDER BY is_variant, conv_id) AS rn FROM u) WHERE rn = 1""")
def q20_augment_merge(spark, sf):
    s = samples(spark, sf).select("conv_id", "last_user", "rewrite")
    v = s.filter("conv_id % 3 = 0").withColumn("last_user", F.concat("last_user", F.when(F.col("conv_id") % 2 == 0, "").otherwise(" nhé")))
    return dedup.augmented(s, v, "conv_id", ["last_user", "rewrite"])


@query("SELECT doc_id, text FROM documents d WHERE doc_id % 2 = 0 UNION ALL SELECT min(doc_id), text FROM documents WHERE doc_id % 2 = 1 AND text NOT IN (SELECT text FROM documents WHERE doc_id % 2 = 0) GROUP BY text")
def q21_append_anti(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    return dedup.append(d.filter("doc_id % 2 = 0"), d.filter("doc_id % 2 = 1"), ["text"], ["doc_id"])


@query("SELECT DISTINCT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def q22_decontam_exact(spark, sf):
    return contain.contained(table(spark, sf, "documents"), table(spark, sf, "benchmark"), "doc_id", "item_id")


# --- sampling ------------------------------------------------------------------------------

_SPLIT = f"""WITH x AS (SELECT d.doc_id, d.lang || '|' || coalesce((l.quality = 1)::VARCHAR, 'na') AS stratum FROM documents d LEFT JOIN labels l USING (doc_id)),
  r AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY {h('doc_id', 'split')}, doc_id) AS rn, count(*) OVER (PARTITION BY stratum) AS n FROM x),
  v AS (SELECT *, CASE WHEN round_even(n * 0.1, 0) = 0 AND n >= 3 THEN 1 ELSE round_even(n * 0.1, 0) END AS v FROM r), t AS (SELECT *, least(round_even(n * 0.8, 0), n - v) AS t FROM v),
  z AS (SELECT doc_id, stratum, CASE WHEN rn <= t THEN 'train' WHEN rn <= t + v THEN 'valid' ELSE 'test' END AS split FROM t)"""


def split_rows(spark, sf):
    d, y = table(spark, sf, "documents").select("doc_id", "lang"), table(spark, sf, "labels").select("doc_id", "quality")
    df = d.join(y, "doc_id", "left").select("doc_id", sample.stratum(F.col("lang"), F.col("quality") == 1).alias("stratum"))
    return sample.split(df, "stratum", "doc_id").select("doc_id", "stratum", "split")


@query(f"{_SPLIT} SELECT doc_id, stratum, split FROM z")
def q23_strat_split(spark, sf):
    return split_rows(spark, sf)


@query(f"{_SPLIT} SELECT split, count(*) AS n FROM z GROUP BY split")
def q24_split_sizes(spark, sf):
    return evaluate.distribution(split_rows(spark, sf), "split")


@query(f"""WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY {h('doc_id', 'down')}, doc_id) AS rn, (SELECT greatest(1, 90 // count(DISTINCT source)) FROM documents) AS per FROM documents),
  a AS (SELECT doc_id, source FROM r WHERE rn <= per), b AS (SELECT doc_id, source FROM r WHERE rn > per ORDER BY {h('doc_id', 'down-rest')}, doc_id LIMIT (SELECT 90 - count(*) FROM a)) SELECT * FROM a UNION ALL SELECT * FROM b""")
def q25_strat_downsample_topup(spark, sf):
    return sample.downsampled(table(spark, sf, "documents").select("doc_id", "source"), "source", 90, "doc_id", "down")


@query(f"""{SAMPLES}, n AS (SELECT count(*) FILTER (context_required) AS need, count(*) FILTER (NOT context_required) AS free FROM s), p AS (SELECT least(free, 60 // 3) AS f, least(need, 60 - least(free, 60 // 3)) AS t FROM n),
  r AS (SELECT conv_id, context_required, row_number() OVER (PARTITION BY context_required ORDER BY {h('conv_id', 'ratio')}, conv_id) AS rn FROM s)
  SELECT conv_id, context_required FROM r, p WHERE rn <= CASE WHEN context_required THEN t ELSE f END""")
def q26_ratio_balance(spark, sf):
    return sample.ratio_balanced(samples(spark, sf).select("conv_id", "context_required"), "context_required", 60, "conv_id", "ratio")


@query("""WITH t(total) AS (VALUES (3000), (500)), c AS (SELECT total, ctx, round_even(total * 2 / 3.0, 0)::BIGINT AS w FROM t, (VALUES (true), (false)) x(ctx)), n AS (SELECT total, ctx, CASE WHEN ctx THEN w ELSE total - w END AS n FROM c),
  p AS (SELECT total, ctx, n, k, round_even(n * share, 0)::BIGINT AS q FROM n JOIN (VALUES (true, 2, 0.45), (true, 3, 0.35), (true, 4, 0.2), (false, 1, 0.55), (false, 2, 0.45)) s(ctx, k, share) USING (ctx))
  SELECT total::BIGINT AS total, ctx AS context_required, k::BIGINT AS user_turns, (q + CASE WHEN k = max(k) OVER w THEN n - sum(q) OVER w ELSE 0 END)::BIGINT AS quota FROM p WINDOW w AS (PARTITION BY total, ctx)""")
def q27_quota_plan(spark, sf):
    rows = [(t, *k, v) for t in (3000, 500) for k, v in sample.quota_plan(t).items()]
    return spark.createDataFrame(rows, "total long, context_required boolean, user_turns long, quota long")


@query(f"""{SAMPLES}, q(context_required, user_turns, quota) AS (VALUES (true, 2, 45), (true, 3, 35), (true, 4, 20), (false, 1, 28), (false, 2, 22)), h AS (SELECT context_required, user_turns, count(*) AS have FROM s GROUP BY 1, 2),
  d AS (SELECT q.*, coalesce(have, 0)::BIGINT AS have, greatest(0, quota - coalesce(have, 0))::BIGINT AS need FROM q LEFT JOIN h USING (context_required, user_turns))
  SELECT context_required, user_turns::BIGINT AS user_turns, quota::BIGINT AS quota, have, need, CASE WHEN need > 0 THEN greatest(1, ceil(need * 2.2 / CASE WHEN user_turns >= 4 THEN 2 WHEN user_turns = 3 THEN 3 ELSE 4 END))::BIGINT ELSE 0 END AS calls FROM d""")
def q28_deficit_calls(spark, sf):
    quota = sample.quota_table(spark, {(True, 2): 45, (True, 3): 35, (True, 4): 20, (False, 1): 28, (False, 2): 22})
    df = sample.deficits(quota, samples(spark, sf), sample.samples_per_call(F.col("user_turns")), 2.2)
    return df.select("context_required", big("user_turns").alias("user_turns"), big("quota").alias("quota"), big("have").alias("have"), big("need").alias("need"), big("calls").alias("calls"))


@query(f"""{SAMPLES}, g AS (SELECT context_required, user_turns, count(*) AS n, min(conv_id) AS first FROM s GROUP BY 1, 2),
  t AS (SELECT g.*, least(n, coalesce(quota, 0)) AS take FROM g LEFT JOIN (VALUES (true, 2, 12), (true, 3, 9), (false, 1, 6), (false, 2, 5)) q(context_required, user_turns, quota) USING (context_required, user_turns)),
  f AS (SELECT *, n - take AS spare, 60 - sum(take) OVER () AS missing, coalesce(sum(n - take) OVER (ORDER BY n - take DESC, first ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM t),
  k AS (SELECT *, take + greatest(0, least(spare, missing - before)) AS final FROM f), r AS (SELECT conv_id, context_required, user_turns, row_number() OVER (PARTITION BY context_required, user_turns ORDER BY conv_id) AS rn FROM s)
  SELECT conv_id, context_required, user_turns::BIGINT AS user_turns FROM r JOIN k USING (context_required, user_turns) WHERE rn <= final""")
def q29_capped_select(spark, sf):
    quota = {(True, 2): 12, (True, 3): 9, (False, 1): 6, (False, 2): 5}
    return sample.capped(samples(spark, sf).select("conv_id", "context_required", "user_turns"), ["context_required", "user_turns"], quota, 60, "conv_id").withColumn("user_turns", big("user_turns"))


@query(f"SELECT conv_id, k, {_domain("(conv_id || '-' || k)", 'batch')} AS domain FROM (SELECT DISTINCT conv_id FROM conversations), (SELECT unnest([1, 2, 3])::BIGINT AS k)")
def q30_weighted_domain_pick(spark, sf):
    df = table(spark, sf, "conversations").select("conv_id").distinct().select("conv_id", F.explode(F.array(*[F.lit(i).cast("long") for i in (1, 2, 3)])).alias("k"))
    return df.withColumn("domain", X.weighted_pick(X.DOMAIN_WEIGHTS, F.concat_ws("-", "conv_id", "k"), "batch"))


@query(f"SELECT doc_id, {h('doc_id', 'shuffle')} AS h FROM documents ORDER BY h, doc_id LIMIT 100")
def q31_hash_shuffle_limit(spark, sf):
    return sample.take(table(spark, sf, "documents").select("doc_id"), 100, "doc_id", "shuffle")


@query(f"""{SAMPLES}, f AS (SELECT conv_id, domain, user_turns FROM s WHERE context_required ORDER BY CASE WHEN user_turns = 3 THEN 0 ELSE 1 END, conv_id LIMIT 9)
  SELECT conv_id, domain, user_turns::BIGINT AS user_turns FROM f ORDER BY {h('conv_id', 'shots')}, conv_id LIMIT 3""")
def q32_fewshot_select(spark, sf):
    pool = samples(spark, sf).select("conv_id", "context_required", "domain", "user_turns")
    return sample.few_shots(pool, True, 3, 3, "conv_id").select("conv_id", "domain", big("user_turns").alias("user_turns"))


# --- templates -----------------------------------------------------------------------------

_SHOWN = "SELECT sample_id, blob, rewrite, context_required FROM (SELECT *, row_number() OVER (PARTITION BY blob, rewrite ORDER BY sample_id) AS rn FROM"
_PAIRS, _PERMS, _AFTER = ("T32",), ("T40", "T41"), ("T58", "T59", "T60", "T61")
_PLAIN = tuple(f"T{i:02d}" for i in range(1, 62) if f"T{i:02d}" not in _PAIRS + _PERMS + _AFTER)


def _shown(spark, only):
    return dedup.first_wins(templates.corpus(spark, only).select("sample_id", "blob", "rewrite", "context_required"), ["blob", "rewrite"], ["sample_id"])


@query(f"{_SHOWN} ({templates.corpus_sql(_PLAIN)})) WHERE rn = 1")
def q33_tmpl_product(spark, sf):
    return _shown(spark, _PLAIN)


@query(f"{_SHOWN} ({templates.corpus_sql(_PAIRS)})) WHERE rn = 1")
def q34_tmpl_combos(spark, sf):
    return _shown(spark, _PAIRS)


@query(f"{_SHOWN} ({templates.corpus_sql(_PERMS)})) WHERE rn = 1")
def q35_tmpl_perms(spark, sf):
    return _shown(spark, _PERMS)


@query(f"{_SHOWN} ({templates.corpus_sql(_AFTER)})) WHERE rn = 1")
def q36_tmpl_context(spark, sf):
    return _shown(spark, _AFTER)


@query(f"SELECT gen_id, grp, context_required, user_turns::BIGINT AS user_turns, count(*) AS n FROM ({_CORPUS}) GROUP BY ALL")
def q37_tmpl_distribution(spark, sf):
    df = templates.corpus(spark).withColumn("user_turns", big("user_turns"))
    return evaluate.distribution(df, "gen_id", "grp", "context_required", "user_turns")


# --- loosely formatted input ---------------------------------------------------------------

_NAMES = "Climate Control|ev-charging|navigation|Phone|unknown thing| SMS |Smart Home|autopilot|audio|route|Vehicle|".split("|")


@query(
    "SELECT i::BIGINT AS i, name, coalesce(CASE WHEN d IN (" + ", ".join(f"'{k}'" for k in X.DOMAIN_WEIGHTS) + ") THEN d END, alias, 'navigation') AS domain FROM (SELECT i, name, replace(replace(lower(trim(name)), ' ', '_'), '-', '_') AS d FROM (VALUES "
    + ", ".join(f"({i}, '{n}')" for i, n in enumerate(_NAMES)) + ") x(i, name)) LEFT JOIN (VALUES " + ", ".join(f"('{a}', '{k}')" for a, k in X.DOMAIN_ALIASES.items()) + ") m(a, alias) ON d = a"
)
def q38_domain_coerce(spark, sf):
    df = spark.createDataFrame(list(enumerate(_NAMES)), "i long, name string")
    return df.select("i", "name", X.coerce_domain(F.col("name"), F.lit("navigation")).alias("domain"))


_ITEM = lambda k: f"""'{{"rewrite": "r' || conv_id || '-{k}", "domain": "navigation"}}'"""
#: Payload texts of five shapes, in SQL that both engines run.
_PAYLOADS = f"""SELECT conv_id, CASE conv_id % 5 WHEN 0 THEN '{{"samples": [' || {_ITEM(0)} || ', 3, ' || {_ITEM(1)} || ']}}' WHEN 1 THEN '[' || {_ITEM(0)} || ', ' || {_ITEM(1)} || ']' WHEN 2 THEN ' ' || {_ITEM(0)}
  WHEN 3 THEN {_ITEM(0)} || ',' || chr(10) || chr(10) || 'no json' || chr(10) || {_ITEM(1)} || ', ' ELSE 'Here:' || chr(10) || '```json' || chr(10) || '{{"samples": [' || {_ITEM(0)} || ']}}' || chr(10) || '```' END AS value
  FROM (SELECT DISTINCT conv_id FROM conversations) AS ids"""


@query(f"""WITH ids AS (SELECT DISTINCT conv_id FROM conversations), k AS (SELECT conv_id, unnest(CASE WHEN conv_id % 5 IN (0, 1, 3) THEN [0, 1] ELSE [0] END) AS k FROM ids)
  SELECT conv_id, 'r' || conv_id || '-' || k AS rewrite, 'navigation' AS domain FROM k""")
def q39_payload_shapes(spark, sf):
    table(spark, sf, "conversations").createOrReplaceTempView("turnloom_conversations")
    df = spark.sql(_PAYLOADS.replace("FROM conversations", "FROM turnloom_conversations"))
    return ingest.samples(ingest.payload_items(df)).select("conv_id", "rewrite", "domain")


@query("""WITH ids AS (SELECT DISTINCT conv_id FROM conversations) SELECT conv_id, k::BIGINT AS pos, 'q' || k || ' {' AS rewrite FROM ids, (SELECT unnest([0, 1, 2]) AS k) WHERE k < 3 - CASE WHEN conv_id % 2 = 0 THEN 1 ELSE 0 END""")
def q40_json_recovery(spark, sf):
    whole = '{"note": "[", "samples": [' + ", ".join(f'{{"rewrite": "q{k} {{", "turns": []}}' for k in range(3)) + "]}"
    cut = whole[: whole.rindex("turns") + 3]
    df = table(spark, sf, "conversations").select("conv_id").distinct().withColumn("text", F.when(F.col("conv_id") % 2 == 0, cut).otherwise(whole))
    return ingest.samples(ingest.recovered(df, "text")).select("conv_id", big("pos").alias("pos"), "rewrite")


_REPLIES = ['{"score": 1}', 'Sure: {"score": 1, "reason": "ok"} done', '{"score": 1, "reason": "cut', '{"score": 0}', "no", '{"other": 2}', 'x "score" : 1', '{"score": "1"}']


@query("SELECT i::BIGINT AS i, s::BIGINT AS score FROM (VALUES (0, 1), (1, 1), (2, 1), (3, 0), (4, 0), (5, 0), (6, 1), (7, 1)) x(i, s)")
def q41_score_parse(spark, sf):
    return spark.createDataFrame(list(enumerate(_REPLIES)), "i long, reply string").select("i", big(X.score_of(F.col("reply"))).alias("score"))


# --- judging and evaluation ----------------------------------------------------------------

_SCORE = lambda salt: f"CASE WHEN {h('conv_id', salt)} % 11 = 0 THEN NULL ELSE {h('conv_id', salt)} % 2 END"


@query(f"{SAMPLES} SELECT CASE WHEN x IS NULL THEN 'judge_error' WHEN x = 1 THEN 'rejected_too_easy' ELSE 'kept_hard' END AS outcome, count(*) AS n FROM (SELECT {_SCORE('weak')} AS x FROM s) GROUP BY outcome")
def q42_difficulty_filter(spark, sf):
    df = samples(spark, sf).withColumn("score", hooks.stub_score(F.col("conv_id"), "weak"))
    return evaluate.distribution(df.withColumn("outcome", validate.difficulty(F.col("score"))), "outcome")


@query(f"{SAMPLES} SELECT conv_id, domain FROM s WHERE {_SCORE('self')} = 1")
def q43_judge_filter(spark, sf):
    return samples(spark, sf).filter(hooks.stub_score(F.col("conv_id"), "self") == 1).select("conv_id", "domain")


@query(f"""{SAMPLES}, x AS (SELECT 'org/small' AS model, pattern, {_SCORE('org/small')} AS score FROM s UNION ALL SELECT 'org/large', pattern, {_SCORE('org/large')} FROM s)
  SELECT model, pattern, count(*) AS n, avg(coalesce(score, 0)::DOUBLE) AS accuracy FROM x GROUP BY GROUPING SETS ((model), (model, pattern))""")
def q44_eval_accuracy(spark, sf):
    rows = evaluate.models_by_records(["org/small", "org/large"], samples(spark, sf).select("conv_id", "pattern"))
    score = F.when(F.col("model") == "org/small", hooks.stub_score(F.col("conv_id"), "org/small")).otherwise(hooks.stub_score(F.col("conv_id"), "org/large"))
    return evaluate.accuracy(rows.withColumn("score", score))


@query(f"""{SAMPLES} SELECT conv_id, gold, CASE WHEN {h('conv_id', 'base')} % 3 = 0 THEN last_user ELSE 'Request: ' || last_user END AS base_output,
  CASE WHEN {h('conv_id', 'tuned')} % 3 = 0 THEN last_user ELSE 'Request: ' || last_user END AS finetuned_output FROM s""")
def q45_compare_side_by_side(spark, sf):
    s = samples(spark, sf).select("conv_id", "gold", "last_user")
    rows = evaluate.models_by_records(["base", "tuned"], s)
    out = F.when(F.col("model") == "base", hooks.stub_predict(F.col("last_user"), F.col("conv_id"), "base")).otherwise(hooks.stub_predict(F.col("last_user"), F.col("conv_id"), "tuned"))
    return evaluate.side_by_side(rows.withColumn("output", out), {"base": "base_output", "tuned": "finetuned_output"}, "conv_id", "gold")


@query(f"""{SAMPLES} SELECT 'context_required' AS by, context_required::VARCHAR AS value, count(*) AS n FROM s GROUP BY value UNION ALL SELECT 'user_turns', user_turns::VARCHAR, count(*) FROM s GROUP BY user_turns
  UNION ALL SELECT 'domain', domain, count(*) FROM s GROUP BY domain""")
def q46_final_report(spark, sf):
    return evaluate.report(samples(spark, sf))


@query(f"""SELECT sample_id, CASE WHEN regexp_matches(last_user, '^\\D*\\d+\\s*(độ|độ C)?\\D{{0,12}}$') AND regexp_matches(blob, '(?i)(điều h[oò]|máy lạnh|AC)')
  THEN 'Đặt điều hòa ở ' || regexp_extract(last_user, '(\\d+)', 1) || ' độ.' ELSE last_user END AS baseline FROM ({_CORPUS})""")
def q47_rule_baseline(spark, sf):
    return templates.corpus(spark).select("sample_id", evaluate.rule_baseline(F.col("last_user"), F.col("blob")).alias("baseline"))


@query("SELECT min(doc_id) AS doc_id, text FROM documents GROUP BY text")
def q48_stream_resume(spark, sf):
    """The table as a stream of one file and one batch; what is accepted, each text once."""
    place = storage.place(spark, "stream")
    docs = table(spark, sf, "documents")
    folder = docs.inputFiles()[0].split("/")[-1] != "documents.parquet"
    # a stream takes a folder or a pattern; this one fits that file alone
    source = spark.readStream.schema(docs.schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf}/documents.parquet" if folder else f"{sf}/documents.parque[t]")
    resume.waves(source.select("doc_id", "text"), f"{place}/accepted", f"{place}/checkpoint", ["text"], ["doc_id"]).awaitTermination()
    return resume.accepted(spark, f"{place}/accepted", "doc_id long, text string").select("doc_id", "text")


@query("""SELECT k::BIGINT AS user_turns, CASE WHEN k = 1 THEN 'user' ELSE array_to_string(list_transform(range(k - 1), lambda i: 'user → bot'), ' → ') || ' → user' END AS skeleton,
  CASE WHEN k >= 4 THEN 2 WHEN k = 3 THEN 3 ELSE 4 END::BIGINT AS samples FROM (SELECT unnest([1, 2, 3, 4, 5]) AS k)""")
def q49_prompt_skeleton(spark, sf):
    from .prompts import skeleton

    df = spark.range(1, 6).select(F.col("id").alias("user_turns"))
    return df.select("user_turns", skeleton(F.col("user_turns")).alias("skeleton"), big(sample.samples_per_call(F.col("user_turns"))).alias("samples"))


@query(f"{SAMPLES} SELECT replace(m, '/', '_') AS model_slug, count(*) AS n FROM s, (SELECT unnest(['org/small', 'org/large', 'plain']) AS m) GROUP BY m")
def q50_model_slug_partition(spark, sf):
    rows = evaluate.models_by_records(["org/small", "org/large", "plain"], samples(spark, sf).select("conv_id"))
    return evaluate.distribution(rows.withColumn("model_slug", X.slug(F.col("model"))), "model_slug")


# --- validators on turns with faults, reports, further forms ---------------------------------

#: Dialogues in which some parts are missing, of another kind, too long or decomposed.
_ODD = f"""{SAMPLES}, o AS (SELECT conv_id, conv_id % 12 <> 0 AS present, CASE conv_id % 12
    WHEN 1 THEN list_transform(turns, lambda t, i: CASE WHEN i = 2 THEN NULL ELSE t END) WHEN 2 THEN list_transform(turns, lambda t, i: {{'role': CASE WHEN i = 1 THEN 'other' ELSE t.role END, 'content': t.content}})
    WHEN 3 THEN list_transform(turns, lambda t, i: {{'role': t.role, 'content': CASE WHEN i = 1 THEN ' ' ELSE t.content END}}) WHEN 4 THEN turns[1:len(turns) - 1]
    WHEN 5 THEN list_transform(turns, lambda t, i: {{'role': t.role, 'content': CASE WHEN i = len(turns) THEN repeat('từ ', 26) ELSE t.content END}})
    WHEN 6 THEN list_transform(turns, lambda t, i: {{'role': t.role, 'content': CASE WHEN i = len(turns) THEN 'Mở bài hát ấy!' ELSE t.content END}}) ELSE turns END AS turns,
  CASE WHEN conv_id % 12 IN (6, 7) THEN 'mo' || chr(795) || chr(777) || ' ba' || chr(768) || 'i ha' || chr(769) || 't a' || chr(770) || chr(769) || 'y' ELSE 'A request that stands alone.' END AS rewrite,
  CASE WHEN conv_id % 12 = 8 THEN ' ' ELSE domain END AS domain, context_required, pattern FROM s)"""


def odd_samples(spark, sf) -> DataFrame:
    df = samples(spark, sf).select("conv_id", "turns", "domain", "context_required", "pattern")
    k, turns = F.col("conv_id") % 12, F.col("turns")
    last = F.size(turns) - 1
    put = lambda where, role, content: F.transform(turns, lambda t, i: F.struct(F.when(where(i), role(t)).otherwise(t["role"]).alias("role"), F.when(where(i), content(t)).otherwise(t["content"]).alias("content")))
    own = lambda name: lambda t: t[name]
    at, first = (lambda i: i == last), (lambda i: i == 0)
    odd = (
        F.when(k == 1, F.transform(turns, lambda t, i: F.when(i != 1, t)))
        .when(k == 2, put(first, lambda t: F.lit("other"), own("content")))
        .when(k == 3, put(first, own("role"), lambda t: F.lit(" ")))
        .when(k == 4, F.slice(turns, 1, F.greatest(last, F.lit(0))))
        .when(k == 5, put(at, own("role"), lambda t: F.lit("từ " * 26)))
        .when(k == 6, put(at, own("role"), lambda t: F.lit("Mở bài hát ấy!")))
        .otherwise(turns)
    )
    rewrite = F.when(k.isin(6, 7), "mo\u031b\u0309 ba\u0300i ha\u0301t a\u0302\u0301y").otherwise("A request that stands alone.")
    return df.select("conv_id", (k != 0).alias("present"), odd.alias("turns"), rewrite.alias("rewrite"), F.when(k == 8, " ").otherwise(F.col("domain")).alias("domain"), "context_required", "pattern")


_FIRST_FAULT = lambda bad, more: f"list_filter(list_transform(turns, lambda t, i: CASE WHEN t IS NULL THEN 'turn_not_dict' WHEN coalesce(t.role NOT IN ('user', 'bot'), true) OR coalesce({strip('t.content')}, '') = '' THEN '{bad}' {more} END), lambda r: r IS NOT NULL)[1]"
_TURNS_TEXT = "array_to_string(list_transform(turns, lambda t: t.content), ' ')"


@query(f"""{_ODD} SELECT conv_id, CASE WHEN NOT present THEN 'not_dict' WHEN len(turns) < CASE WHEN context_required THEN 3 ELSE 1 END THEN 'too_few_turns' WHEN {strip('domain')} = '' THEN 'missing_field'
  WHEN {_FIRST_FAULT('bad_role_or_empty', '')} IS NOT NULL THEN {_FIRST_FAULT('bad_role_or_empty', '')} WHEN turns[-1].role <> 'user' THEN 'not_ending_user' WHEN {tokens('turns[-1].content')} > 25 THEN 'final_user_too_long'
  WHEN context_required AND {norm('nfc_normalize(rewrite)')} = {norm('nfc_normalize(turns[-1].content)')} THEN 'rewrite_equals_final_turn' WHEN pattern = 'negation' THEN 'negation_marker_missing'
  WHEN pattern = 'compound_intent' THEN 'compound_connector_missing' END AS reason FROM o""")
def q51_validate_bench_turns(spark, sf):
    c = F.col
    return odd_samples(spark, sf).select("conv_id", validate.bench_reason(c("turns"), c("rewrite"), c("domain"), c("pattern"), c("context_required"), c("present")).alias("reason"))


@query(f"""{_ODD} SELECT conv_id, CASE WHEN NOT present THEN 'not_dict' WHEN {strip('domain')} = '' THEN 'missing_field'
  WHEN {_FIRST_FAULT('bad_turn', "WHEN i > 1 AND turns[greatest(i - 1, 1)].role = t.role THEN 'not_alternating'")} IS NOT NULL THEN {_FIRST_FAULT('bad_turn', "WHEN i > 1 AND turns[greatest(i - 1, 1)].role = t.role THEN 'not_alternating'")}
  WHEN len(turns) = 0 OR turns[1].role <> 'user' THEN 'not_start_user' WHEN turns[-1].role <> 'user' THEN 'not_end_user' WHEN len({USERS}) <> 2 THEN 'wrong_user_turns'
  WHEN context_required AND {norm('nfc_normalize(rewrite)')} = {norm('nfc_normalize(' + USERS + '[-1].content)')} THEN 'ctx_but_identical' END AS reason FROM o""")
def q52_validate_bulk_turns(spark, sf):
    c = F.col
    return odd_samples(spark, sf).select("conv_id", validate.bulk_reason(c("turns"), c("rewrite"), c("domain"), c("context_required"), F.lit(2), c("present")).alias("reason"))


@query(f"""{SAMPLES}, a AS (SELECT DISTINCT pattern, last_user, rewrite FROM s WHERE conv_id % 4 = 0), n AS (SELECT min(conv_id) AS conv_id, pattern, last_user, rewrite FROM s WHERE conv_id % 4 <> 0 GROUP BY ALL),
  f AS (SELECT n.*, row_number() OVER (PARTITION BY pattern ORDER BY conv_id) AS rn FROM n ANTI JOIN a USING (pattern, last_user, rewrite)) SELECT conv_id, pattern FROM f WHERE rn <= 5""")
def q53_pattern_target(spark, sf):
    s = samples(spark, sf).select("conv_id", "pattern", "last_user", "rewrite")
    key = ["pattern", "last_user", "rewrite"]
    new = dedup.not_in(dedup.first_wins(s.filter("conv_id % 4 <> 0"), key, ["conv_id"]), s.filter("conv_id % 4 = 0"), key)
    return sample.target_cut(new, ["pattern"], 5, "conv_id").select("conv_id", "pattern")


_PREFER, _DEPART = "CASE WHEN conv_id % 3 = 0 THEN NULL WHEN conv_id % 3 = 1 THEN '' ELSE 'tránh phà' END", "CASE WHEN conv_id % 2 = 0 THEN 'bảy giờ' END"


@query(f"""SELECT conv_id, 'Đi tới ' || conv_id || CASE WHEN coalesce({_PREFER}, '') = '' THEN '' ELSE ', ưu tiên ' || {_PREFER} END || CASE WHEN {_DEPART} IS NULL THEN '' ELSE ' và khởi hành ' || {_DEPART} END || '.' AS rewrite
  FROM (SELECT DISTINCT conv_id FROM conversations)""")
def q54_conditional_clauses(spark, sf):
    from .prompts import navigation_request

    ids = table(spark, sf, "conversations").select("conv_id").distinct()
    return ids.select("conv_id", navigation_request(F.lit("Đi tới"), F.col("conv_id").cast("string"), F.expr(_PREFER), F.expr(_DEPART)).alias("rewrite"))


@query(f"{SAMPLES}, g AS (SELECT domain, count(*) AS n FROM s GROUP BY domain) SELECT domain, n, n / sum(n) OVER () AS share, printf('%.1f%%', round_even(n / sum(n) OVER () * 100, 1)) AS percent FROM g")
def q55_percent_report(spark, sf):
    return evaluate.shares(samples(spark, sf), "domain")


@query(f"""{SAMPLES}, r AS (SELECT conv_id, turns[-1].role = 'user' AND conv_id % 5 <> 0 AND (SELECT count(*) FROM unnest(turns) AS x(t) WHERE trim(t.content) <> '') > 0 AS ok FROM s)
  SELECT count(*) FILTER (ok) AS converted, count(*) FILTER (NOT ok) AS skipped FROM r""")
def q56_conversion_report(spark, sf):
    """Messages records, of which a fifth lost its assistant, to conversations: how many were converted and skipped."""
    df = samples(spark, sf).withColumn("m", dialogue.messages(F.col("turns"), F.col("rewrite")))
    m = F.when(F.col("conv_id") % 5 == 0, F.filter("m", lambda x: x["role"] != "assistant")).otherwise(F.col("m"))
    return evaluate.outcomes(df, dialogue.messages_to_conversations(m).isNotNull(), ("converted", "skipped"))


@query("SELECT conv_id, count(*) AS n, sum(length(text))::BIGINT AS chars FROM conversations GROUP BY conv_id")
def q57_json_lines(spark, sf):
    """The table written as JSON lines, absent fields absent, and read back strictly."""
    from ..sources import sinks

    to = storage.place(spark, "json-lines")
    sinks.jsonl(table(spark, sf, "conversations"), to)
    back = ingest.jsonl(spark, to, "conv_id long, turn long, role string, text string")
    return back.groupBy("conv_id").agg(F.count("*").alias("n"), F.sum(F.char_length("text")).alias("chars"))


@query(f"""{_VARIANTS}, g AS (SELECT conv_id, {strip('other_rewrite')} <> '' AND len(d) = len(other) AND len(list_filter(list_zip(d, other), lambda z: z[1]['from'] <> z[2]['from'] OR {strip('z[2].value')} = '')) = 0
  AND coalesce(other[-1]['from'] = 'human', false) AND {inside(runs('rewrite'), runs('other_rewrite'))} AND NOT ({strip('other_rewrite')} = rewrite AND d = other) AS ok, conv_id % 7 = 0 AS failed FROM o)
  SELECT count(*) FILTER (ok AND NOT failed) AS kept, count(*) FILTER (NOT ok OR failed) AS dropped FROM g""")
def q58_paraphrase_report(spark, sf):
    """Replies of a paraphrase hook, of which a seventh failed: variants kept and dropped."""
    df = variant_rows(spark, sf)
    reply = F.when(F.col("conv_id") % 7 != 0, F.to_json(F.struct(F.col("other").alias("dialogue"), F.col("other_rewrite").alias("rewrite"))))
    df = hooks.paraphrased(df.select("conv_id", F.col("d").alias("dialogue"), "rewrite", F.struct(F.lit("music").alias("domain")).alias("meta"), reply.alias("reply")))
    return evaluate.outcomes(df, F.col("variant").isNotNull() & F.col("variant.meta.augmented"), ("kept", "dropped"))


@query(f"""{SAMPLES} SELECT conv_id, 'system,' || array_to_string(list_transform(turns, lambda t: CASE t.role WHEN 'user' THEN 'user' ELSE 'assistant' END), ',') AS roles,
  {answer(strip('rewrite'))} AS gold FROM s WHERE turns[-1].role = 'user'""")
def q59_prompt_and_gold(spark, sf):
    p = dialogue.prompt_and_gold(F.col("conversations"))
    df = conversations_records(spark, sf).select("conv_id", p.alias("p"))
    return df.select("conv_id", F.array_join(F.transform("p.prompt", lambda x: x["role"]), ",").alias("roles"), "p.gold")
