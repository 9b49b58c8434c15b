"""Functions, operators, sources and sinks on hand-made cases."""

import json
import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from turnloom import hooks
from turnloom.functions import text as X
from turnloom.operators import contain, dedup, dialogue, evaluate, sample, validate
from turnloom.plans import prompts, templates
from turnloom.schema import SAMPLE, TURNS
from turnloom.sources.publish import Store
from turnloom.sources import ingest, sinks
from turnloom.streaming import resume


def one(spark, make, *values):
    df = spark.createDataFrame([(v,) for v in values], "c string")
    return [r[0] for r in df.select(make(F.col("c"))).collect()]


def test_text(spark):
    assert [sorted(x) for x in one(spark, X.numbers, "27,5 và 4.2 và 27,5", "")] == [["27.5", "4.2"], []]
    assert sorted(one(spark, X.digit_runs, "27,5 và 4.2")[0]) == ["2", "27", "4", "5"]
    assert one(spark, lambda c: X.norm(X.nfc(c)), "A, b -- c!", "  é  ", "(X)") == ["a b c", "é", "x"]
    assert one(spark, lambda c: X.has_marker(c, ("và",)), "a và b", "vàng", "và", "Và!") == [True, False, True, True]
    assert one(spark, X.token_count, "", " \n", "a  b\tc") == [0, 0, 3]
    assert one(spark, X.answer_json, 'a "b" é/\n') == ['{"rewrite_message": "a \\"b\\" é/\\n"}']
    assert one(spark, X.score_of, '{"score":1}', 'so {"score": 1} there', '{"score": 1, "x', "garbage", '{"score": 0}', "{}") == [1, 1, 1, 0, 0, 0]
    assert one(spark, lambda c: X.coerce_domain(c, F.lit("f")), "Smart Home", "HVAC", "zzz", None) == ["smart_home", "climate", "f", "f"]
    assert one(spark, X.slug, "a/b/c") == ["a_b_c"]
    assert one(spark, lambda c: X.hashed(c, "abc"), "1") == [2554197281]
    assert set(one(spark, lambda c: X.weighted_pick({"a": 1, "b": 3}, c, "s"), *map(str, range(50)))) == {"a", "b"}


def test_parse_blob(spark):
    got = one(spark, dialogue.parse, "lost\nuser: a\n  more \n\nBOT : x\nuser:\nuser:  y ", "", "none")
    assert [[tuple(t) for t in x] for x in got] == [[("user", "a more"), ("bot", "x user:"), ("user", "y")], [], []]


def test_formats_round_trip(spark):
    turns = [("user", "a"), ("bot", "b: c"), ("user", 'd "e"')]
    df = spark.createDataFrame([(turns, "f \\ g")], f"turns {TURNS}, answer string")
    df = df.withColumn("c", dialogue.to_conversations(F.col("turns"), F.col("answer")))
    r = df.select(dialogue.to_turns(F.col("c")).alias("t"), dialogue.gold_of(F.col("c")).alias("g"), F.expr("c[3].value").alias("tagged"), dialogue.messages_to_conversations(dialogue.messages(F.col("turns"), F.col("answer"))).alias("m"), "c").first()
    assert [tuple(t) for t in r["t"]] == turns and r["g"] == "f \\ g" and r["tagged"] == '<REWRITE>\nd "e"' and r["m"] == r["c"]
    back = df.withColumn("d", dialogue.from_compact(dialogue.compact(F.col("c")), F.col("answer"))).first()
    assert back["d"] == back["c"]
    assert spark.createDataFrame([(turns[:2], "x")], f"turns {TURNS}, answer string").select(dialogue.to_conversations(F.col("turns"), F.col("answer"))).first()[0] is None
    chat = df.select(F.transform(dialogue.chat_messages(F.col("c")), lambda x: x["role"])).first()[0]
    assert chat == ["system", "user", "assistant", "user", "assistant"]
    seed = dialogue.seed_samples(df.select(F.col("c").alias("conversations"), F.expr("cast(null as struct<domain:string,context_required:boolean,pattern:string>)").alias("meta"))).first()
    assert (seed["domain"], seed["context_required"], seed["user_turns"], seed["total_turns"]) == ("navigation", True, 2, 3)


U, B = lambda t: ("user", t), lambda t: ("bot", t)
GOOD = [U("mở nhạc"), B("bài 7?"), U("bài đó")]
BENCH = [
    (None, GOOD, "Phát bài 7.", "music", "correction", None),
    ("too_few_turns", GOOD[:1], "Phát bài 7.", "music", "correction", None),
    (None, GOOD[2:], "bài đó", "music", "correction", False),
    ("too_few_turns", None, "Phát bài 7.", "music", "correction", None),
    ("missing_field", GOOD, "  ", "music", "correction", None),
    ("missing_field", GOOD, "Phát bài 7.", None, "correction", None),
    ("rewrite_length", GOOD, "ab", "music", "correction", None),
    ("rewrite_length", GOOD, "a" * 241, "music", "correction", None),
    ("turn_not_dict", [U("a"), None, ("x", "y")], "Phát bài 7.", "music", "correction", None),
    ("bad_role_or_empty", [("x", "a"), None, U("b")], "Phát bài 7.", "music", "correction", None),
    ("bad_role_or_empty", [U("a"), B(" "), U("b")], "Phát bài 7.", "music", "correction", None),
    ("not_ending_user", [U("a"), B("b"), U("c"), B("d")], "Phát bài.", "music", "correction", None),
    ("final_user_too_long", [U("a"), B("b"), U("c " * 26)], "Phát bài.", "music", "correction", None),
    ("rewrite_equals_final_turn", [U("a"), B("b"), U("Mở, nhạc!")], "mở nhạc", "music", "correction", None),
    ("rewrite_equals_final_turn", [U("a"), B("b"), U("Mở nhạc ấy")], unicodedata.normalize("NFD", "mở nhạc ấy"), "music", "correction", None),
    ("hallucinated_numbers", GOOD, "Phát bài 8.", "music", "correction", None),
    ("leaked_bot_number", GOOD, "Phát bài 7.", "music", "irrelevant_context", None),
    ("negation_marker_missing", GOOD, "Phát bài 7.", "music", "negation", None),
    (None, GOOD, "Đừng phát bài 7.", "music", "negation", None),
    ("compound_connector_missing", GOOD, "Phát vàng 7.", "music", "compound_intent", None),
    (None, GOOD, "Phát 7 và tắt.", "music", "compound_intent", None),
    ("no_pattern", [], "", "", " ", None),
    ("bad_pattern", [], "", "", "other", None),
]


def test_bench_reasons(spark):
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(BENCH)], f"i int, want string, turns {TURNS}, rewrite string, domain string, pattern string, ctx boolean")
    c = F.col
    got = df.select("i", "want", validate.ingest_reason(c("turns"), c("rewrite"), c("domain"), c("pattern"), c("ctx")).alias("got")).orderBy("i").collect()
    assert [(r["i"], r["want"]) for r in got] == [(r["i"], r["got"]) for r in got]
    assert df.select(validate.bench_reason(c("turns"), c("rewrite"), c("domain"), c("pattern"), present=F.lit(False))).first()[0] == "not_dict"


BULK = [
    (None, GOOD, "Phát bài 7.", "music", True, 2),
    ("missing_field", None, "Phát bài 7.", "music", True, 2),
    ("rewrite_length", GOOD, "ab", "music", True, 2),
    ("turn_not_dict", [None], "Phát bài.", "music", True, 1),
    ("bad_turn", [U("")], "Phát bài.", "music", True, 1),
    ("not_alternating", [U("a"), U("b"), ("x", "c")], "Phát bài.", "music", True, 2),
    ("not_start_user", [], "Phát bài.", "music", True, 2),
    ("not_start_user", [B("a"), U("b")], "Phát bài.", "music", True, 1),
    ("not_end_user", [U("a"), B("b")], "Phát bài.", "music", True, 1),
    ("wrong_user_turns", GOOD, "Phát bài 7.", "music", True, 3),
    ("hallucinated_number", GOOD, "Phát bài 8.", "music", True, 2),
    ("ctx_but_identical", [U("a"), B("b"), U("mở nhạc.")], "Mở nhạc", "music", True, 2),
    ("ctx_but_identical", [U("a"), B("b"), U(unicodedata.normalize("NFD", "mở nhạc."))], "Mở nhạc", "music", True, 2),
    (None, [U("a"), B("b"), U("mở nhạc.")], "Mở nhạc", "music", False, 2),
    ("noctx_pulled_number", GOOD, "Phát bài 7.", "music", False, 2),
]


def test_bulk_reasons(spark):
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(BULK)], f"i int, want string, turns {TURNS}, rewrite string, domain string, ctx boolean, n int")
    c = F.col
    got = df.select("i", "want", validate.bulk_reason(c("turns"), c("rewrite"), c("domain"), c("ctx"), c("n")).alias("got")).orderBy("i").collect()
    assert [(r["i"], r["want"]) for r in got] == [(r["i"], r["got"]) for r in got]


def test_variants(spark):
    d = [("human", "a 5"), ("gpt", "b"), ("human", "c")]
    cases = [
        (True, d, "r 5", [("human", "x 5"), ("gpt", "b"), ("human", "c")], "r2 5"),
        (False, d, "r 5", None, "r2 5"),
        (False, d, "r 5", d[:2], "r2 5"),
        (False, d, "r 5", [("gpt", "a"), ("gpt", "b"), ("human", "c")], "r2 5"),
        (False, d, "r 5", [("human", " "), ("gpt", "b"), ("human", "c")], "r2 5"),
        (False, d[:2], "r 5", [("human", "z"), ("gpt", "b")], "r2 5"),
        (False, d, "r 5", [("human", "z"), ("gpt", "b"), ("human", "c")], "r2"),
        (False, d, "r 5", d, "r 5"),
        (True, d, "r 5", d, "r2 5"),
        (False, d, "r 5", d, ""),
    ]
    t = "array<struct<from:string,value:string>>"
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(cases)], f"i int, want boolean, d {t}, r string, o {t}, s string")
    got = df.select("i", "want", validate.variant_ok(F.col("d"), F.col("r"), F.col("o"), F.col("s")).alias("got")).orderBy("i").collect()
    assert [(r["i"], r["want"]) for r in got] == [(r["i"], r["got"]) for r in got]


def test_validators_go_to_python_once_for_nfc(spark):
    df = spark.createDataFrame([(1, *BENCH[0][1:])], f"i int, turns {TURNS}, rewrite string, domain string, pattern string, ctx boolean")
    c = F.col
    plan = df.select(validate.ingest_reason(c("turns"), c("rewrite"), c("domain"), c("pattern"), c("ctx")))._jdf.queryExecution().toString()
    physical = plan[plan.index("== Physical Plan") :]
    assert physical.count("ArrowEvalPython") == 1 and "BatchEvalPython" not in physical


def test_assembly_is_one_exchange(spark):
    df = dialogue.with_gold(dialogue.assemble(spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_verdicts(spark):
    df = spark.createDataFrame([(9, False), (7, False), (10, True)], "soft int, hard boolean")
    assert [r[0] for r in df.select(validate.qc_verdict(F.col("soft"), F.col("hard"))).collect()] == ["keep", "fix", "drop"]
    df = spark.createDataFrame([(1,), (0,), (None,)], "s int")
    assert [r[0] for r in df.select(validate.difficulty(F.col("s"))).collect()] == ["rejected_too_easy", "kept_hard", "judge_error"]


def test_plans():
    assert sample.quota_plan(3000) == {(True, 2): 900, (True, 3): 700, (True, 4): 400, (False, 1): 550, (False, 2): 450}
    assert sample.quota_plan(500) == {(True, 2): 150, (True, 3): 117, (True, 4): 66, (False, 1): 92, (False, 2): 75}
    assert sample.ratio_plan(1138, 609, 2000) == (1138, 609) and sample.ratio_plan(1138, 609, 0) == (1138, 569)
    assert sample.batches_needed(10, 5, 2.5) == 5 and sample.batches_needed(0, 5, 1.6) == 1
    assert sample.cap_plan([("a", 10), ("b", 2), ("c", 9)], {"a": 3, "b": 5, "c": 3}, 12) == {"a": 7, "b": 2, "c": 3}
    assert sample.cap_plan([("a", 10), ("b", 5)], {"a": 9, "b": 5}, 4) == {"a": 0, "b": 4}
    r = random.Random(1)
    for _ in range(300):
        sizes = [(k, r.randint(0, 20)) for k in "abcde"[: r.randint(1, 5)]]
        cap, quota = r.randint(0, 60), {k: r.randint(0, 15) for k in "abcd"}
        got = sample.cap_plan(sizes, quota, cap)
        assert sum(got.values()) == min(cap, sum(n for _, n in sizes)) and all(0 <= got[k] <= n for k, n in sizes)


@pytest.mark.parametrize("n,want", [(1, (1, 0, 0)), (2, (2, 0, 0)), (3, (2, 1, 0)), (5, (4, 1, 0)), (10, (8, 1, 1)), (15, (12, 2, 1)), (25, (20, 2, 3)), (35, (28, 4, 3))])
def test_split_sizes(spark, n, want):
    got = {r["split"]: r["count"] for r in sample.split(spark.range(n).withColumn("s", F.lit("x")), "s", "id").groupBy("split").count().collect()}
    assert tuple(got.get(k, 0) for k in ("train", "valid", "test")) == want


def test_downsample_and_shots(spark):
    df = spark.range(100).withColumn("g", (F.col("id") % 7).cast("string"))
    got = sample.downsampled(df, "g", 30, "id", "s")
    assert got.count() == 30 and got.groupBy("g").count().agg(F.min("count")).first()[0] >= 4 and sample.downsampled(df, "g", 200, "id", "s").count() == 100
    pool = spark.createDataFrame([(i, i % 2 == 0, 1 + i % 3) for i in range(30)], "id int, context_required boolean, user_turns int")
    picks = sample.few_shots(pool, True, 2, 2, "id").collect()
    assert len(picks) == 2 and all(r["context_required"] for r in picks)
    assert sample.few_shots(pool.filter("not context_required"), True, 2, 2, "id").count() == 2


def test_dedup(spark):
    df = spark.createDataFrame([(1, "a", "x"), (2, "a", "y"), (3, "b", "z"), (4, None, "n"), (5, None, "m")], "id int, k string, v string")
    assert sorted(r["id"] for r in dedup.first_wins(df, ["k"], ["id"]).collect()) == [1, 3, 4]
    assert {(r["k"], r["v"], r["first_order"]) for r in dedup.last_wins(df, ["k"], ["id"]).collect()} == {("a", "y", 1), ("b", "z", 3), (None, "m", 4)}
    once = dedup.first_wins(df, ["k"], ["id"])
    assert sorted(map(tuple, dedup.first_wins(once, ["k"], ["id"]).collect()), key=repr) == sorted(map(tuple, once.collect()), key=repr)
    new = spark.createDataFrame([(9, "b", "q"), (10, "c", "q"), (11, "c", "r")], "id int, k string, v string")
    assert sorted(r["id"] for r in dedup.append(df, new, ["k"], ["id"]).collect()) == [1, 2, 3, 4, 5, 10]
    nulls = spark.createDataFrame([(20, None, "q"), (21, None, "r"), (22, "d", "r")], "id int, k string, v string")
    assert sorted(r["id"] for r in dedup.append(df, nulls, ["k"], ["id"]).collect()) == [1, 2, 3, 4, 5, 22]
    assert {(r["k"], r["n"], r["v"]) for r in dedup.sized(df, ["k"], ["id"], "v").collect()} == {("a", 2, "x"), ("b", 1, "z"), (None, 2, "n")}
    assert [r["source_rank"] for r in dedup.union_all(df.limit(1), new.limit(1)).orderBy("source_rank").collect()] == [0, 1]


def test_evaluation(spark):
    df = spark.createDataFrame([("m", "p", 1), ("m", "p", 0), ("m", "q", None)], "model string, pattern string, score int")
    got = {(r["model"], r["pattern"]): (r["n"], round(r["accuracy"], 3)) for r in evaluate.accuracy(df).collect()}
    assert got == {("m", None): (3, 0.333), ("m", "p"): (2, 0.5), ("m", "q"): (1, 0.0)}
    d = spark.createDataFrame([([("system", "s"), ("user", "u")],)], f"d {TURNS}")
    assert [tuple(t) for t in d.select(evaluate.without_system(F.col("d"))).first()[0]] == [("user", "u")]


def test_templates(spark):
    n = {r["gen_id"]: r["count"] for r in templates.corpus(spark).groupBy("gen_id").count().collect()}
    with pytest.raises(ValueError):
        templates.corpus(spark, ("T99",))
    said = templates.corpus(spark, ("T53",)).selectExpr("regexp_extract(blob, 'mở bài ([^\n]*)', 1) as a", "regexp_extract(blob, 'sang bài ([^\n]*)', 1) as b").collect()
    assert len(said) == 36 and all(r["a"] and r["b"] and r["a"] != r["b"] for r in said)
    assert len(n) == 61 and sum(v for k, v in n.items() if k in templates.SINGLE) == 442 and sum(n.values()) == 442 + 1747
    df = templates.corpus(spark, templates.SINGLE)
    assert df.filter("blob rlike '[{}]' or rewrite rlike '[{}]' or blob is null or rewrite is null").count() == 0
    assert {r[0] for r in templates.corpus(spark).filter("grp <> 'x'").groupBy("context_required").count().collect()} == {None, True, False}


def test_prompt(spark):
    df = spark.range(1).select(prompts.prompt(F.lit("[]"), F.array(F.lit("music")), F.lit(2), F.lit(True), F.lit(3), F.lit(7)).alias("p"))
    assert "user → bot → user" in df.first()[0] and "Seed 7" in df.first()[0]


def test_json_lines(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"rewrite": "é", "user_turns": 2}\n\n{"rewrite": "b"}\n')
    assert [r["rewrite"] for r in ingest.jsonl(spark, str(p), SAMPLE, "blanks").collect()] == ["é", "b"]
    p.write_text('{"rewrite": "é"}\n{bad\n{"rewrite": "b"}\n')
    assert sorted(r["rewrite"] for r in ingest.jsonl(spark, str(p), SAMPLE, "tolerant").collect()) == ["b", "é"]
    with pytest.raises(Exception):
        ingest.jsonl(spark, str(p), SAMPLE).collect()
    assert ingest.existing(spark, [str(p), str(p) + "x"]) == [str(p)] and ingest.first_existing(spark, None, [str(tmp_path / "**" / "*.jsonl")], []) == str(p)
    assert ingest.whole_files(spark, [str(p)]).count() == 1
    assert ingest.literal(spark, '[{"role": "user", "content": "x"}]', TURNS).first()["r"][0]["content"] == "x"


PAYLOADS = {
    '{"samples": [{"rewrite": "a"}, 3, {"rewrite": "b"}]}': ["a", "b"],
    '[{"rewrite": "a"}, "x"]': ["a"],
    '  {"rewrite": "a"} ': ["a"],
    '{"rewrite": "a"},\nnope\n\n{"rewrite": "b"}': ["a", "b"],
    '{"rewrite": "a"}\n[{"rewrite": "no"}]\n{"samples": [{"rewrite": "b"}]}': ["a", "b"],
    '{"samples": [{"rewrite": "a"}]}\n{"rewrite": "b"},': ["a", "b"],
    'Text\n```json\n{"samples": [{"rewrite": "a"}]}\n```\n```{"rewrite": "no"}```': ["a"],
    "": [],
    '{"samples": []}': [],
    '{\n  "samples": [\n    {"rewrite": "a"},\n    {"rewrite": "b"}\n  ]\n}': ["a", "b"],
}


@pytest.mark.parametrize("text", PAYLOADS)
def test_payloads(spark, text):
    got = ingest.samples(ingest.payload_items(spark.createDataFrame([(1, text)], "id int, value string"))).orderBy("pos")
    assert [r["rewrite"] for r in got.collect()] == PAYLOADS[text]


def test_recovery(spark):
    whole = json.dumps({"note": "[{", "samples": [{"rewrite": 'a } " \\', "turns": []}, {"rewrite": "b"}, {"rewrite": "c"}]})
    texts = [whole, whole[:-12], '[{"rewrite": "x"}, {"rew', '{"samples": [{"a": 1,}, {"rewrite": "y"}', "nothing", None, '{"samples": [{"rewrite": "p"}, "a { b", {"rewrite": "q"}, "c', "["]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    got = {}
    for r in ingest.samples(ingest.recovered(df, "t")).orderBy("id", "pos").collect():
        got.setdefault(r["id"], []).append(r["rewrite"])
    assert got == {0: ['a } " \\', "b", "c"], 1: ['a } " \\', "b"], 2: ["x"], 3: ["y"], 6: ["p", "q"]}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "é", None, "train", "a/b"), (2, "x", "y", "test", "c")], "id int, t string, n string, split string, model string")
    sinks.jsonl(df, str(tmp_path / "j"))
    lines = [x for p in (tmp_path / "j").glob("part*") for x in p.read_text().splitlines()]
    assert any("é" in x and '"n"' not in x for x in lines)
    sinks.by_split(df, str(tmp_path / "s"))
    sinks.by_model(df, str(tmp_path / "m"))
    assert {p.name for p in (tmp_path / "s").iterdir() if p.is_dir()} == {"split=train", "split=test"} and (tmp_path / "m" / "model_slug=a_b").is_dir()
    assert sinks.merged(df, ["id"], ["id"], str(tmp_path / "g")) == 1
    assert sinks.merged(df.withColumn("id", F.col("id") + 1), ["id"], ["id"], str(tmp_path / "g")) == 2
    assert sorted(r["id"] for r in Store(spark, str(tmp_path / "g")).read("id int, t string").collect()) == [1, 2, 3]


def test_stream(spark, tmp_path):
    src, out, mark = (str(tmp_path / x) for x in ("src", "out", "mark"))
    schema = "id int, k string, b string"
    quota = spark.createDataFrame([("p", 2), ("q", 5)], "b string, quota int")

    def run(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        resume.waves(spark.readStream.schema(schema).parquet(src), out, mark, ["k"], ["id"], ["b"], quota).awaitTermination()
        return sorted(r["id"] for r in resume.accepted(spark, out, schema).collect())

    assert run([(1, "a", "p"), (2, "a", "p"), (3, "b", "q")]) == [1, 3]
    assert run([(4, "a", "p"), (5, "c", "p"), (6, "d", "p"), (7, "e", "r")]) == [1, 3, 5]
    assert run([(8, "f", "q")]) == [1, 3, 5, 8]


def test_hooks(spark):
    tries, pauses = [], []

    def flaky(x):
        tries.append(x)
        if len(tries) < 3:
            raise ValueError("no")
        return x + 1

    assert hooks.retried(flaky, 3, 1.0, sleep=pauses.append)(1) == 2 and pauses == [1.0, 2.0]
    assert hooks.retried(lambda: 1 / 0, 2, failure=lambda e: f"{hooks.FAILED} {e}", sleep=pauses.append)().startswith(hooks.FAILED)
    df = spark.range(10)
    assert hooks.applied(df, lambda: lambda b: b.assign(id=b["id"] * 2), "id long").agg(F.sum("id")).first()[0] == 90
    assert hooks.uncached(df, spark.range(4), ["id"]).count() == 6


def test_entry_without_llm(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0


def test_long_blobs_are_parsed_in_linear_time(spark):
    import time

    blob = "\n".join(f"user: line {i}\nmore {i}\n\nbot: x" for i in range(30_000))
    began = time.time()
    got = one(spark, lambda c: F.transform(dialogue.parse(c), lambda t: t["content"]), blob)[0]
    assert len(got) == 60_000 and got[0] == "line 0 more 0" and got[-1] == "x" and time.time() - began < 20


def test_reports(spark):
    df = spark.createDataFrame([("a", "m", True), ("a", None, False), ("b", "m", None)], "k string, reason string, ok boolean")
    assert {(r["k"], r["n"], r["percent"]) for r in evaluate.shares(df, "k").collect()} == {("a", 2, "66.7%"), ("b", 1, "33.3%")}
    assert tuple(evaluate.outcomes(df, F.col("ok"), ("kept", "dropped")).first()) == (1, 2)
    assert tuple(evaluate.call_report(df.withColumn("ok", F.col("k") == "a"), 30, 15.0).first()) == (2, 1, "67%", 30, 2.0)
    assert evaluate.call_report(df.limit(0), 0, 0.0).first()["success"] == "0%"
    rows = spark.createDataFrame([(1, "x", None, True, "f"), (2, "x", None, True, "f"), (3, "y", "no_pattern", False, "g"), (4, None, None, False, "g"), (5, None, None, False, "g")], "id int, k string, reason string, context_required boolean, file string")
    got = validate.ingest_stats(rows, ["k"], ["id"], files="file").first().asDict()
    assert got == {"raw": 5, "no_pattern": 1, "bad_pattern": 0, "rejected": 0, "duplicate": 2, "kept": 2, "context_share": 0.5, "files": 2}
    assert validate.ingest_stats(rows.limit(0), ["k"], ["id"]).first()["raw"] == 0
    assert validate.known_patterns(None) and validate.known_patterns(["negation"]) == ["negation"]
    with pytest.raises(ValueError):
        validate.known_patterns(["x"])
    assert sorted(r["id"] for r in sample.target_cut(rows, ["k"], 1, "id").collect()) == [1, 3, 4]


def test_record_forms(spark):
    c = [("system", "s"), ("human", "a"), ("gpt", "g")]
    t = "array<struct<from:string,value:string>>"
    df = spark.createDataFrame([(c,)], f"conversations {t}")
    r = df.select(dialogue.prompt_and_gold(F.col("conversations")).alias("p")).first()["p"]
    assert r["gold"] == "g" and [tuple(x) for x in r["prompt"]] == [("system", "s"), ("user", "a")]
    for bad in (c[:2], []):
        with pytest.raises(Exception, match="assistant"):
            spark.createDataFrame([(bad,)], f"conversations {t}").select(dialogue.prompt_and_gold(F.col("conversations"))).collect()
    assert [tuple(x) for x in df.select(dialogue.mapped(df)).first()[0]] == [("system", "s"), ("user", "a"), ("assistant", "g")]
    other = spark.createDataFrame([([("H", "a"), ("z", "b")],)], "talk array<struct<who:string,said:string>>")
    names = {"messages": "talk", "role_tag": "who", "content_tag": "said", "user_tag": "H", "assistant_tag": "A", "system_tag": "S"}
    assert [tuple(x) for x in other.select(dialogue.mapped(other, names)).first()[0]] == [("user", "a"), ("z", "b")]


def test_services(spark):
    pauses, seen = [], []

    def send(client, prompt):
        seen.append(client)
        if len(seen) < 4:
            error = RuntimeError("too many" if len(seen) < 3 else "broken pipe")
            error.status = 429 if len(seen) < 3 else None
            raise error
        return prompt.upper()

    call = hooks.service(["k1", "k2"], send, sleep=pauses.append, clock=lambda: 0.0)
    # both keys rest, for one second and for two; then the pipe breaks
    assert call("x") == "X" and seen == ["k1", "k2", "k1", "k1"] and pauses == [1.0, 0.5, 1.0]
    assert hooks.service(["k"], lambda c, p: 1 / 0, tries=2, sleep=pauses.append)("x") is None
    sizes = hooks.applied(spark.range(10).coalesce(1), lambda: lambda b: b.assign(id=len(b)), "id long", chunk=4).collect()
    assert sorted(r["id"] for r in sizes) == [2, 2, 4, 4, 4, 4, 4, 4, 4, 4]
    df = spark.createDataFrame([(1, "a"), (2, "b")], "i int, p string")
    got = {r["i"]: (r["reply"], r["ok"]) for r in hooks.called(df, "p", lambda: lambda p: None if p == "b" else p * 2).collect()}
    assert got == {1: ("aa", True), 2: (None, False)}


def test_paraphrases_and_smoke(spark):
    d = [("human", "a 5"), ("gpt", "b"), ("human", "c")]
    good = json.dumps({"dialogue": [{"from": f, "value": f" {v} x "} for f, v in d], "rewrite": "r2 5"})
    df = spark.createDataFrame([(i, d, "r 5", ("music",), reply) for i, reply in enumerate((good, good.replace("5", "6"), "no", None))], "i int, dialogue array<struct<from:string,value:string>>, rewrite string, meta struct<domain:string>, reply string")
    got = {r["i"]: r["variant"] for r in hooks.paraphrased(df).collect()}
    assert got[1] is got[2] is got[3] is None and got[0]["meta"].asDict() == {"domain": "music", "augmented": True}
    assert [x["from"] for x in got[0]["conversations"]] == ["system", "human", "gpt", "human", "gpt"] and got[0]["conversations"][1]["value"] == "a 5 x"
    reply = json.dumps({"samples": [{"turns": [{"role": "user", "content": "đi"}, {"role": "bot", "content": "đâu"}, {"role": "user", "content": "ga"}], "rewrite": "Đi tới ga.", "domain": "navigation"}]})
    rows = prompts.smoke(spark, lambda: lambda p: reply).collect()
    assert {(r["ctx"], r["want"]): r["reason"] for r in rows} == {(True, 2): None, (True, 3): "wrong_user_turns", (False, 1): "wrong_user_turns", (False, 2): None}


def test_settings():
    from turnloom.sources.config import settings

    text = "a: 1  # one\nb:\n  c: 'x # y'\n  d: [1, two, 3.5]\n  e:\n    - p\n    - 2e-4\nf: true\ng:\nh: ~\n"
    assert settings(text) == {"a": 1, "b": {"c": "x # y", "d": [1, "two", 3.5], "e": ["p", 2e-4]}, "f": True, "g": None, "h": None}
    with pytest.raises(ValueError):
        settings("a: 1\n   b: 2\n")


def test_requests_seeds_and_training_files(spark, tmp_path):
    assert ingest.request(spark, '{"conversation": [{"role": "user", "content": "x"}]}').first()["turns"][0]["content"] == "x"
    for bad in ('{"conversation": []}', "{}", '{"conversation": [{"role": "system", "content": "x"}]}', '{"conversation": [{"role": "user", "content": ""}]}', "no"):
        with pytest.raises(ValueError):
            ingest.request(spark, bad)
    rec = {"conversations": [{"from": "system", "value": "s"}, {"from": "human", "value": "<REWRITE>\nx"}, {"from": "gpt", "value": '{"rewrite_message": "y"}'}], "meta": {"domain": "music"}}
    (tmp_path / "t.json").write_text(json.dumps(rec))
    (tmp_path / "v.json").write_text(json.dumps({"messages": [{"role": "user", "content": "q"}], "other": 1}))
    got = {r["split"]: [m["role"] for m in r["messages"]] for r in ingest.training(spark, str(tmp_path / "t.json"), str(tmp_path / "v.json")).collect()}
    assert got == {"train": ["system", "user", "assistant"], "validation": ["user"]}
    from turnloom.schema import CONVERSATIONS_RECORD

    pool = ingest.seed_pool(spark.createDataFrame([(1, "z")], "id int, rewrite string"), spark.read.schema(CONVERSATIONS_RECORD).json(str(tmp_path / "t.json")))
    assert [(r["rewrite"], r["domain"], r["source_rank"]) for r in pool.orderBy("source_rank").collect()] == [("z", None, 0), ("y", "music", 1)]
    keys = hooks.Keys(["a", "b"])
    assert [keys()[1] for _ in range(3)] == ["a", "b", "a"]


def test_exact_decontamination_of_odd_items(spark):
    docs = [
        (1, "say abc and abcdefghijklmnopqrst here"), (2, "a \\E b \\Q c"), (3, None), (4, ""), (5, "ab"), (5, "ab"), (None, "x \t\n y  one two three four five six seven eight nine ten z"),
        (6, "zz abcdefghijklmnop qq more of it"), (7, "one two three four five six seven eight nine tenth"), (8, "é\u00a0ü one two"), (9, "\n"), (10, "xone two three four five"),
    ]
    items = [
        (1, "abc"), (2, "abcdefghijklmnopqrst"), (3, "a \\E b"), (4, ""), (5, None), (6, "\\Q c"), (7, "ab"), (8, "\\E"), (9, "abcdefghijklmnop qq"), (10, "abcdef"), (11, "abcdefgh"), (12, " "), (13, "\t\n"),
        (14, "one two three four five six seven eight nine ten"), (15, "one two three four"), (15, "two three"), (None, " two "), (16, "o"), (17, "é\u00a0ü"), (18, "\n"), (19, "e two three f"), (20, "three four five six seven eight"),
    ]
    want = sorted({(i, k) for i, t in docs for k, x in items if t is not None and x is not None and x in t}, key=repr)
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for limit in (contain.BROADCAST_BYTES, -1):
        assert sorted(map(tuple, contain.contained(d, b, "doc_id", "item_id", limit=limit).collect()), key=repr) == want
        assert contain.contained(d, b.limit(0), "doc_id", "item_id", limit=limit).count() == 0
    for k in range(len(items)):
        own = [x for x in items[k : k + 1] if x[1] is not None]
        got = contain.contained(d.coalesce(1), spark.createDataFrame(own, "item_id long, text string").coalesce(1), "doc_id", "item_id")
        assert sorted(map(tuple, got.collect()), key=repr) == sorted({(i, n) for i, t in docs for n, x in own if t is not None and x in t}, key=repr)


def test_exact_decontamination_at_any_place(spark):
    r = random.Random(3)
    docs = [(i, " ".join(r.choice(["a", "bc", "d.", "é", "", "fgh"]) for _ in range(r.randint(0, 60)))) for i in range(120)]
    items = [(k, t[x : x + r.choice([1, 2, 5, 9, 20, 60])]) for k, (_, t) in enumerate(docs) for x in [r.randrange(len(t) + 1)]]
    want = sorted((i, k) for i, t in docs for k, x in items if x in t)
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert sorted(map(tuple, contain.contained(d, b, "doc_id", "item_id").collect())) == want
