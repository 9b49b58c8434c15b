"""Queries over the given tables for state, row numbers, filters, publishing, alignment and rules that need text with faults."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import hooks, storage
from ..functions import text as X
from ..operators import align, bloom, dedup, dialogue, evaluate, rowids, sample, validate
from ..schema import PATTERNS
from ..sources import ingest, payloads, sinks
from ..sources.publish import Store
from ..streaming import keyed
from .queries import _LF, QUERIES, SAMPLES, SQL, USERS, _SCORE, big, conversations_records, h, inside, marker, norm, numbers, query, samples, split_rows, strip, table, tokens

__all__ = ["QUERIES", "SQL"]


@query("SELECT doc_id FROM documents WHERE doc_id % 3 <> 0 AND text NOT IN (SELECT text FROM documents WHERE doc_id % 3 = 0 AND text IS NOT NULL)")
def q60_not_in_by_filter(spark, sf):
    """Texts of two thirds of the documents that the other third lacks; a Bloom filter is asked first."""
    d = table(spark, sf, "documents").select("doc_id", "text")
    return bloom.not_in(d.filter("doc_id % 3 <> 0"), d.filter("doc_id % 3 = 0"), ["text"]).select("doc_id")


#: Waves that the documents come in, and rows that each source has room for.
_WAVES, _ROOM = 4, 7


@query(f"""WITH f AS (SELECT min(doc_id) AS doc_id FROM documents GROUP BY text), r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM f JOIN documents USING (doc_id))
  SELECT doc_id, source FROM r WHERE rn <= {_ROOM} AND source IS NOT NULL""")
def q61_keyed_waves(spark, sf):
    """Documents in waves of several files: the first of each text, at most so many of each source.  The stream is stopped and started
    again in the middle and holds what it has seen as state."""
    docs = table(spark, sf, "documents").select("doc_id", "source", "text")
    place = storage.place(spark, "waves")
    step = docs.agg(F.max("doc_id")).first()[0] // _WAVES + 1
    quota = {(r["source"],): _ROOM for r in docs.select("source").distinct().collect()}  # a row for each source
    for part in (0, 1):
        for wave in range(part * _WAVES // 2, (part + 1) * _WAVES // 2):
            docs.filter(F.floor(F.col("doc_id") / step) == wave).write.mode("append").parquet(f"{place}/in")
            source = spark.readStream.schema(docs.schema).parquet(f"{place}/in")
            keyed.waves(source, f"{place}/accepted", f"{place}/checkpoint", ["text"], ["doc_id"], ["source"], quota).awaitTermination()
    return spark.read.schema(docs.schema).parquet(f"{place}/accepted").select("doc_id", "source")


@query(f"""{SAMPLES} SELECT row_number() OVER (ORDER BY conv_id) - 1 AS row_id, conv_id, rewrite, CASE WHEN {h('conv_id', 'line')} % 3 = 0 THEN last_user ELSE 'Request: ' || last_user END AS pred FROM s""")
def q62_predictions_by_line(spark, sf):
    """Predictions in JSON lines without ids, in several files, meet the records by the number of their line."""
    place = storage.place(spark, "lines")
    s = samples(spark, sf).select("conv_id", "rewrite", "last_user")
    records = rowids.numbered(s, ["conv_id"])
    preds = s.select("conv_id", hooks.stub_predict(F.col("last_user"), F.col("conv_id"), "line").alias("pred"))
    preds.repartitionByRange(5, "conv_id").sortWithinPartitions("conv_id").select("pred").write.json(place)
    return evaluate.zipped(records, rowids.json_lines(spark, place, "pred string")).select("row_id", "conv_id", "rewrite", "pred")


@query("SELECT conv_id, turn, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY text) AS rn FROM conversations) WHERE rn = 1")
def q63_published_merge(spark, sf):
    """Two halves of the conversations, and the first again, merged into one published table; a write that fails in between changes nothing."""
    place = storage.place(spark, "published")
    c = table(spark, sf, "conversations").select("conv_id", "turn", "text")
    key, order = ["conv_id", "turn"], ["text"]
    sinks.merged(c.filter("conv_id % 2 = 0"), key, order, place)
    broken = c.withColumn("text", F.when(F.col("turn") == 1, F.raise_error(F.lit("stopped"))).otherwise(F.col("text")))
    try:
        Store(spark, place).publish(broken)
    except Exception as e:  # the failure that is put in; any other is raised
        if "stopped" not in str(e):
            raise
    sinks.merged(c.filter("conv_id % 2 = 1"), key, order, place)
    sinks.merged(c.filter("conv_id % 2 = 0"), key, order, place)
    return Store(spark, place).read("conv_id long, turn long, text string")


_WORDS = lambda x: f"list_filter(string_split({norm(f'nfc_normalize({x})')}, ' '), lambda w: w <> '')"
_DIALOGUE = "array_to_string(list_transform(turns, lambda t: t.content), ' ')"


@query(f"""WITH RECURSIVE {SAMPLES.strip().removeprefix('WITH')}, a AS (SELECT conv_id, domain, gold, CASE WHEN conv_id % 3 = 0 THEN last_user WHEN conv_id % 3 = 1 THEN 'Request 7: ' || coalesce(gold, '') ELSE reverse(coalesce(gold, '')) END AS pred, {_DIALOGUE} AS said FROM s),
  w AS (SELECT *, {_WORDS("coalesce(gold, '')")} AS g, {_WORDS('pred')} AS p, {_WORDS('said')} AS d, {numbers("coalesce(gold, '')")} AS gn, {numbers('pred')} AS pn FROM a),
  l(conv_id, k, r) AS (SELECT conv_id, 0, list_transform(g, lambda x: 0) FROM w UNION ALL
    SELECT conv_id, k + 1, list_transform(range(1, len(c) + 1), lambda j: list_max(c[1:j])) FROM (SELECT l.conv_id, k, list_transform(g, lambda x, j: CASE WHEN x = p[k + 1] THEN 1 + CASE WHEN j = 1 THEN 0 ELSE r[j - 1] END ELSE r[j] END) AS c FROM l JOIN w USING (conv_id) WHERE k < len(p))),
  m AS (SELECT w.*, coalesce(r[-1], 0) AS matched, list_filter(p, lambda x: NOT list_contains(d, x)) AS f, len(list_filter(gn, lambda x: list_contains(pn, x))) AS shared FROM w JOIN l USING (conv_id) WHERE k = len(p))
  SELECT domain, count(*) AS n, sum(matched) / nullif(sum(len(p)), 0) AS word_precision, sum(matched) / nullif(sum(len(g)), 0) AS word_recall, 2 * sum(matched) / nullif(sum(len(g)) + sum(len(p)), 0) AS word_f1,
    sum(shared) / nullif(sum(len(pn)), 0) AS slot_precision, sum(shared) / nullif(sum(len(gn)), 0) AS slot_recall, 2 * sum(shared) / nullif(sum(len(gn)) + sum(len(pn)), 0) AS slot_f1,
    avg((len(f) > 0)::INT) AS hallucinated, sum(len(f)) / nullif(sum(len(p)), 0) AS foreign_share FROM m GROUP BY domain""")
def q64_alignment_by_domain(spark, sf):
    """Words and numeric slots of predictions against the gold texts, and words that the dialogue doesn't have, by domain."""
    gold = F.coalesce("gold", F.lit(""))
    k = F.col("conv_id") % 3
    pred = F.when(k == 0, F.col("last_user")).when(k == 1, F.concat(F.lit("Request 7: "), gold)).otherwise(F.reverse(gold))
    said = F.array_join(F.transform("turns", lambda t: t["content"]), " ")
    rows = samples(spark, sf).select("domain", "gold", pred.alias("pred"), said.alias("said"))
    return align.report(align.compared(rows, "gold", "pred", "said"), "domain")


@query(f"""{SAMPLES}, b AS (SELECT DISTINCT domain, user_turns AS for_turns, c AS for_context FROM s, (VALUES (true), (false)) x(c)), o AS (SELECT DISTINCT domain, context_required AS for_context, true AS own FROM s),
  m AS (SELECT b.*, s.conv_id, row_number() OVER (PARTITION BY b.domain, for_turns, for_context ORDER BY CASE WHEN user_turns = for_turns THEN 0 ELSE 1 END, conv_id) AS rn
    FROM b LEFT JOIN o USING (domain, for_context) JOIN s ON s.domain = b.domain AND (own IS NULL OR s.context_required = b.for_context)),
  r AS (SELECT *, row_number() OVER (PARTITION BY domain, for_turns, for_context ORDER BY {h('conv_id', 'shots')}, conv_id) AS k FROM m WHERE rn <= 6) SELECT domain, for_context, for_turns::BIGINT AS for_turns, conv_id FROM r WHERE k <= 2""")
def q65_few_shots_of_all(spark, sf):
    """Few-shot examples for every bucket of every domain in one plan."""
    pool = samples(spark, sf).select("conv_id", "context_required", "domain", "user_turns")
    return sample.few_shots_of(pool, 2, "conv_id", ["domain"]).select("domain", "for_context", big("for_turns").alias("for_turns"), "conv_id")


# --- rules over texts with faults ----------------------------------------------------------

#: Samples with faults put in by their number, in SQL that both engines run.
_FAULTY = """SELECT conv_id, turns, last_user, said, own, context_required,
  CASE conv_id % 13 WHEN 0 THEN '' WHEN 1 THEN 'ok' WHEN 2 THEN last_user || ' !' WHEN 3 THEN base || ' 99' WHEN 4 THEN repeat('word ', 60) WHEN 5 THEN base || ' và không' WHEN 6 THEN base || ' 7' ELSE base END AS rewrite,
  CASE WHEN conv_id % 17 = 0 THEN '' ELSE domain END AS domain,
  CASE conv_id % 11 WHEN 0 THEN 'negation' WHEN 1 THEN 'compound_intent' WHEN 2 THEN 'irrelevant_context' WHEN 3 THEN '' WHEN 4 THEN 'other' WHEN 5 THEN 'negation' WHEN 6 THEN 'irrelevant_context' ELSE 'correction' END AS pattern FROM base"""
_BASE = f"""{SAMPLES}, numbered AS (SELECT * REPLACE (CASE WHEN conv_id % 2 = 0 THEN list_transform(turns, lambda t, i: {{'role': t.role, 'content': CASE WHEN t.role = 'bot' THEN '7 ' || t.content ELSE t.content END}}) ELSE turns END AS turns) FROM s),
  base AS (SELECT *, {_DIALOGUE} AS said, array_to_string(list_transform({USERS}, lambda t: t.content), ' ') AS own, 'A request that stands alone.' AS base FROM numbered), faulty AS ({_FAULTY})"""
_REASON = f"""CASE WHEN pattern = '' THEN 'no_pattern' WHEN pattern NOT IN ({', '.join(f"'{p}'" for p in PATTERNS)}) THEN 'bad_pattern'
  WHEN len(turns) < CASE WHEN context_required = false THEN 1 ELSE 3 END THEN 'too_few_turns' WHEN {strip('rewrite')} = '' OR domain = '' THEN 'missing_field'
  WHEN length({strip('rewrite')}) NOT BETWEEN 5 AND 240 THEN 'rewrite_length' WHEN len(list_filter(turns, lambda t: {strip('t.content')} = '')) > 0 THEN 'bad_role_or_empty'
  WHEN turns[-1].role <> 'user' THEN 'not_ending_user' WHEN {tokens('turns[-1].content')} > 25 THEN 'final_user_too_long'
  WHEN coalesce(context_required, true) AND {norm('rewrite')} = {norm('turns[-1].content')} THEN 'rewrite_equals_final_turn'
  WHEN NOT {inside(numbers('rewrite'), numbers('said'))} THEN 'hallucinated_numbers'
  WHEN pattern = 'irrelevant_context' AND len(list_filter({numbers('rewrite')}, lambda n: list_contains({numbers('said')}, n) AND NOT list_contains({numbers('own')}, n))) > 0 THEN 'leaked_bot_number'
  WHEN pattern = 'negation' AND NOT {marker('rewrite', X.NEGATION_MARKERS)} THEN 'negation_marker_missing'
  WHEN pattern = 'compound_intent' AND NOT {marker('rewrite', X.COMPOUND_MARKERS)} THEN 'compound_connector_missing' END"""
_CHECKED = f"{_BASE}, checked AS (SELECT *, {_REASON} AS reason FROM faulty)"


def checked(spark, sf) -> DataFrame:
    """Conversations as candidates of an ingest with the reason why each is rejected."""
    c = F.col
    s = samples(spark, sf)
    own = F.when(c("conv_id") % 2 == 0, F.transform("turns", lambda t: F.struct(t["role"].alias("role"), F.when(t["role"] == "bot", F.concat(F.lit("7 "), t["content"])).otherwise(t["content"]).alias("content")))).otherwise(c("turns"))
    text = lambda turns: F.array_join(F.transform(turns, lambda t: t["content"]), " ")
    base = s.withColumn("turns", own).withColumn("said", text("turns")).withColumn("own", text(F.filter("turns", lambda t: t["role"] == "user"))).withColumn("base", F.lit("A request that stands alone."))
    faulty = spark.sql(_FAULTY.replace("FROM base", "FROM {base}"), base=base)
    return faulty.withColumn("reason", validate.ingest_reason(c("turns"), c("rewrite"), c("domain"), c("pattern"), c("context_required")))


@query(f"{_CHECKED} SELECT conv_id, pattern, reason FROM checked")
def q66_validate_texts(spark, sf):
    return checked(spark, sf).select("conv_id", "pattern", "reason")


@query(f"{_CHECKED} SELECT coalesce(reason, 'kept') AS reason, count(*) AS n FROM checked GROUP BY ALL")
def q67_counters_of_the_write(spark, sf):
    """Kept rows are written; the counts of reasons come from that run, with no second pass."""
    df = checked(spark, sf)
    reasons = ["no_pattern", "bad_pattern", "too_few_turns", "missing_field", "rewrite_length", "turn_not_dict", "bad_role_or_empty", "not_ending_user", "final_user_too_long", "rewrite_equals_final_turn", "hallucinated_numbers", "leaked_bot_number", "negation_marker_missing", "compound_connector_missing"]
    to = storage.place(spark, "kept")
    got = sinks.jsonl_counted(df, to, F.col("reason").isNull(), {r: F.col("reason") == r for r in reasons} | {"kept": F.col("reason").isNull()})
    if got["kept"] != ingest.jsonl(spark, to, "conv_id long").count():
        raise ValueError("the counter differs from what was written")
    return spark.createDataFrame([(k, v) for k, v in got.items() if k != "rows" and v], "reason string, n long")


@query(f"""{_CHECKED}, k AS (SELECT *, row_number() OVER (PARTITION BY last_user, rewrite ORDER BY conv_id) AS rn FROM checked WHERE reason IS NULL)
  SELECT count(*) AS raw, count(*) FILTER (reason = 'no_pattern') AS no_pattern, count(*) FILTER (reason = 'bad_pattern') AS bad_pattern, count(*) FILTER (reason NOT IN ('no_pattern', 'bad_pattern')) AS rejected,
  (SELECT count(*) FROM k WHERE rn > 1) AS duplicate, (SELECT count(*) FROM k WHERE rn = 1) AS kept, (SELECT avg(context_required::INT::DOUBLE) FROM k WHERE rn = 1) AS context_share FROM checked""")
def q68_ingest_stats(spark, sf):
    return validate.ingest_stats(checked(spark, sf), ["last_user", "rewrite"], ["conv_id"])


_NAMED = """CASE conv_id % 9 WHEN 0 THEN 'Climate Control' WHEN 1 THEN 'ev-charging' WHEN 2 THEN domain WHEN 3 THEN 'unknown ' || conv_id WHEN 4 THEN ' SMS ' WHEN 5 THEN upper(domain) WHEN 6 THEN 'autopilot' WHEN 7 THEN '' END"""


@query(f"""{SAMPLES}, n AS (SELECT conv_id, user_turns, {_NAMED} AS name, domain AS wanted, last_user FROM s), d AS (SELECT *, replace(replace(lower(trim(coalesce(name, ''))), ' ', '_'), '-', '_') AS d FROM n)
  SELECT conv_id, coalesce(CASE WHEN d IN ({', '.join(f"'{k}'" for k in X.DOMAIN_WEIGHTS)}) THEN d END, alias, wanted) AS domain, {marker('last_user', X.COMPOUND_MARKERS)} AS compound, {tokens('last_user')}::BIGINT AS tokens,
  CASE WHEN user_turns >= 4 THEN 2 WHEN user_turns = 3 THEN 3 ELSE 4 END::BIGINT AS samples, {_SCORE('reply')}::BIGINT AS score
  FROM d LEFT JOIN (VALUES {', '.join(f"('{a}', '{k}')" for a, k in X.DOMAIN_ALIASES.items())}) m(a, alias) ON d = a""".replace(f"{_SCORE('reply')}::BIGINT", f"coalesce({_SCORE('reply')}, 0)::BIGINT"))
def q69_domains_markers_scores(spark, sf):
    """Domains as models name them, markers and tokens of the last turn, samples to ask for, and scores read from replies of four kinds."""
    s = samples(spark, sf)
    score = hooks.stub_score(F.col("conv_id"), "reply").cast("string")
    k = F.col("conv_id") % 4
    reply = F.when(score.isNull(), "no score").when(k == 0, F.concat(F.lit('{"score": '), score, F.lit("}"))).when(k == 1, F.concat(F.lit('Sure: {"score": '), score, F.lit(', "reason": "so"} done'))).when(k == 2, F.concat(F.lit('{"score": '), score, F.lit(', "reason": "cut'))).otherwise(F.concat(F.lit('x "score" : '), score))
    name = F.expr(_NAMED)
    return s.select(
        "conv_id", X.coerce_domain(name, F.col("domain")).alias("domain"), X.has_marker(F.col("last_user"), X.COMPOUND_MARKERS).alias("compound"), big(X.token_count(F.col("last_user"))).alias("tokens"),
        big(sample.samples_per_call(F.col("user_turns"))).alias("samples"), big(X.score_of(reply)).alias("score"),
    )


_LINE = """CASE conv_id % 4 WHEN 0 THEN '{"samples": [{"rewrite": "r' || conv_id || '-0"}, 3, {"rewrite": "r' || conv_id || '-1"}]}' WHEN 1 THEN ' {"rewrite": "r' || conv_id || '-0"}, ' WHEN 2 THEN 'no json ' || conv_id ELSE '[{"rewrite": "r' || conv_id || '"}]' END"""


@query("SELECT conv_id, 'r' || conv_id || '-' || k AS rewrite FROM (SELECT conv_id, unnest(CASE conv_id % 4 WHEN 0 THEN [0, 1] ELSE [0] END) AS k FROM (SELECT DISTINCT conv_id FROM conversations) WHERE conv_id % 4 < 2)")
def q70_payload_source(spark, sf):
    """Payload lines of conversations, good and bad, written as text and read through the data source, whose partitions are cut by bytes."""
    place = storage.place(spark, "payloads")
    ids = table(spark, sf, "conversations").select("conv_id").distinct()
    ids.select(F.expr(_LINE).alias("value")).write.text(place)
    payloads.register(spark)
    items = spark.read.format("payloads").option("lines", "true").option("partitionBytes", str(8 << 20)).load(place)
    got = ingest.samples(items).select("rewrite")
    return got.select(F.regexp_extract("rewrite", r"^r(\d+)-", 1).cast("long").alias("conv_id"), "rewrite")


_OVER = "(VALUES (true, 2, 12), (true, 3, 9), (false, 1, 6), (false, 2, 5))"


@query(f"""{SAMPLES}, g AS (SELECT context_required, user_turns, count(*) AS n, min(conv_id) AS first FROM s GROUP BY 1, 2),
  t AS (SELECT g.*, least(n, coalesce(quota, 0)) AS take FROM g LEFT JOIN {_OVER} q(context_required, user_turns, quota) USING (context_required, user_turns)),
  f AS (SELECT *, sum(take) OVER () - 8 AS extra, coalesce(sum(take) OVER (ORDER BY take DESC, first ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM t),
  k AS (SELECT *, take - greatest(0, least(take, extra - before)) AS final FROM f), r AS (SELECT conv_id, context_required, user_turns, row_number() OVER (PARTITION BY context_required, user_turns ORDER BY conv_id) AS rn FROM s)
  SELECT conv_id, context_required, user_turns::BIGINT AS user_turns FROM r JOIN k USING (context_required, user_turns) WHERE rn <= final""")
def q71_capped_over_quota(spark, sf):
    """A cap below the sum of the quotas: the largest buckets are trimmed first."""
    quota = {(True, 2): 12, (True, 3): 9, (False, 1): 6, (False, 2): 5}
    return sample.capped(samples(spark, sf).select("conv_id", "context_required", "user_turns"), ["context_required", "user_turns"], quota, 8, "conv_id").withColumn("user_turns", big("user_turns"))


@query(SQL["q24_split_sizes"])
def q72_split_files(spark, sf):
    """Splits written as a folder each, with a line cut off in one; read back, bad lines dropped."""
    place = storage.place(spark, "splits")
    sinks.by_split(split_rows(spark, sf), place)
    spark.range(1).select(F.lit('{"doc_id": 1, "str').alias("value")).write.mode("append").text(f"{place}/split=test")
    rows = ingest.jsonl(spark, place, "doc_id long, stratum string, split string", "tolerant")
    return evaluate.distribution(rows.filter("doc_id IS NOT NULL"), "split")


@query(f"""{_LF}, x AS (SELECT lf.conv_id, s.* EXCLUDE (conv_id) FROM lf JOIN s USING (conv_id)), m AS (SELECT conv_id, {strip('rewrite')} AS rewrite, domain, CASE WHEN conv_id % 3 = 0 THEN true ELSE context_required END AS context_required, len({USERS})::BIGINT AS user_turns, 1::BIGINT AS source_rank FROM x WHERE conv_id % 2 = 1)
  SELECT * FROM m UNION ALL SELECT conv_id, rewrite, domain, context_required, user_turns::BIGINT, 0::BIGINT FROM s WHERE conv_id % 2 = 0""")
def q73_seed_pool(spark, sf):
    """Curated samples and, after them, records converted to samples; context_required is true where meta has none."""
    kept = samples(spark, sf)
    meta = F.struct(F.lit(None).cast("string").alias("intent"), "pattern", "domain", F.when(F.col("conv_id") % 3 != 0, F.col("context_required")).alias("context_required")).alias("meta")
    records = conversations_records(spark, sf).filter("conv_id % 2 = 1").select("conv_id", "conversations", meta)
    of_records = dialogue.seed_samples(records.withColumn("meta", F.col("meta").withField("pattern", F.col("conv_id").cast("string"))))  # the number travels as the pattern
    curated = kept.filter("conv_id % 2 = 0").select("turns", "rewrite", "domain", "context_required", F.col("conv_id").cast("string").alias("pattern"), "user_turns", F.size("turns").alias("total_turns"))
    pool = dedup.union_all(curated, of_records)
    return pool.select(F.col("pattern").cast("long").alias("conv_id"), "rewrite", "domain", "context_required", big("user_turns").alias("user_turns"), big("source_rank").alias("source_rank"))


@query(f"""{_LF} SELECT conv_id, CASE WHEN conv_id % 5 = 0 THEN 'validation' ELSE 'train' END AS split, array_to_string(list_transform(c, lambda x: CASE x['from'] WHEN 'human' THEN 'user' WHEN 'gpt' THEN 'assistant' ELSE x['from'] END), ',') AS roles FROM lf""")
def q74_training_messages(spark, sf):
    """Records in two files as a trainer reads them: conversations renamed, other columns gone."""
    place = storage.place(spark, "train")
    number = F.transform("conversations", lambda x, i: F.struct(x["from"].alias("from"), F.when(i == 0, F.col("conv_id").cast("string")).otherwise(x["value"]).alias("value")))
    records = conversations_records(spark, sf).select("conv_id", number.alias("conversations"), F.struct("domain").alias("meta"))
    for name, of in (("train", "conv_id % 5 <> 0"), ("valid", "conv_id % 5 = 0")):
        sinks.jsonl(records.filter(of).drop("conv_id"), f"{place}/{name}")
    got = ingest.training(spark, f"{place}/train", f"{place}/valid")
    return got.select(F.get("messages", F.lit(0))["content"].cast("long").alias("conv_id"), "split", F.array_join(F.transform("messages", lambda m: m["role"]), ",").alias("roles"))


@query(f"{SAMPLES} SELECT conv_id, row_number() OVER (ORDER BY conv_id) - 1 AS row_id FROM s QUALIFY (row_number() OVER (ORDER BY conv_id) - 1) % 3 <> 1")
def q75_rows_without_an_answer(spark, sf):
    """Resume by row number: rows that the cache of answers lacks."""
    rows = rowids.numbered(samples(spark, sf).select("conv_id"), ["conv_id"])
    cache = rows.filter("row_id % 3 = 1").select("row_id", F.lit("answer").alias("reply"))
    return hooks.uncached(rows, cache, ["row_id"]).select("conv_id", "row_id")


@query("SELECT conv_id, count(*) FILTER (role <> 'system') AS turns, sum(length(text)) FILTER (role <> 'system')::BIGINT AS chars FROM conversations GROUP BY conv_id HAVING count(*) FILTER (role <> 'system') > 0")
def q76_comparison_file(spark, sf):
    """Dialogues written for comparison without their system messages, by a file that blank lines were added to."""
    place = storage.place(spark, "comparison")
    c = table(spark, sf, "conversations")
    rows = c.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("content"))).alias("dialogue"))
    sinks.comparison(rows, place)
    spark.range(3).select(F.lit("\t ").alias("value")).write.mode("append").text(place)
    there = ingest.existing(spark, [place, f"{place}-missing"])  # what is not there is left out
    got = ingest.jsonl(spark, there, "conv_id long, dialogue array<struct<role:string,content:string>>", "blanks").filter(F.size("dialogue") > 0)
    return got.select("conv_id", big(F.size("dialogue")).alias("turns"), F.aggregate("dialogue", F.lit(0).cast("long"), lambda a, t: a + F.char_length(t["content"])).alias("chars"))


@query(f"""{SAMPLES}, p AS (SELECT pattern, count(*) AS have FROM s GROUP BY pattern) SELECT pattern, have, greatest(0, 40 - have)::BIGINT AS deficit, CASE WHEN have < 40 THEN greatest(1, floor(((40 - have) * 2.5 + 7) / 8))::BIGINT ELSE 0 END AS batches FROM p""")
def q77_batches_by_pattern(spark, sf):
    """Batches of eight that each pattern still needs for forty samples."""
    have = evaluate.distribution(samples(spark, sf), "pattern").withColumnRenamed("n", "have")
    need = F.greatest(F.lit(0).cast("long"), F.lit(40) - F.col("have"))
    return have.select("pattern", "have", need.alias("deficit"), F.when(need > 0, sample.batches(need, 8, 2.5)).otherwise(0).cast("long").alias("batches"))
