"""State, row numbers, filters, publishing, alignment, heads of groups, services."""

import json
import random
import time
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from turnloom import hooks
from turnloom.operators import align, bloom, contain, dedup, rowids, sample
from turnloom.sources import ingest, sinks
from turnloom.sources.publish import Conflict, Store
from turnloom.streaming import keyed


# --- Bloom filters -------------------------------------------------------------------------


def test_filter_knows_its_keys_and_few_others(spark):
    own, foreign = spark.range(5000).select("id", F.concat(F.lit("k"), "id").alias("k")), spark.range(5000, 15_000).select("id", F.concat(F.lit("k"), "id").alias("k"))
    table = bloom.built(own, ["id", "k"], 5000)
    assert bloom.asked(own, ["id", "k"], table, 5000, "known").filter("NOT known").count() == 0
    false = bloom.asked(foreign, ["id", "k"], table, 5000, "known").filter("known").count()
    assert 0 <= false < 300, false
    assert bloom.asked(own, ["id", "k"], bloom.built(own.limit(0), ["id", "k"], 0), 0, "known").filter("known").count() == 0


@pytest.mark.parametrize("filter_bytes,key_bytes", [(bloom.FILTER_BYTES, bloom.KEY_BYTES), (bloom.FILTER_BYTES, -1), (0, 0)])
def test_anti_join_with_a_filter(spark, monkeypatch, filter_bytes, key_bytes):
    monkeypatch.setattr(bloom, "FILTER_BYTES", filter_bytes)
    monkeypatch.setattr(bloom, "KEY_BYTES", key_bytes)
    chance = random.Random(2)
    word = lambda: chance.choice([None, "", "a", "b", "x" * 3000, *map(str, range(40))])
    rows = [(i, word(), chance.choice([None, 1, 2])) for i in range(300)] + [(900, "a", 1)] * 50
    df = spark.createDataFrame(rows, "id int, s string, n int")
    other = spark.createDataFrame([(word(), chance.choice([None, 1, 2])) for _ in range(60)], "s string, n int")
    for o in (other, other.limit(0)):
        want = sorted(map(tuple, dedup.not_in(df, o, ["s", "n"]).collect()), key=repr)
        got = bloom.not_in(df, o, ["s", "n"])
        assert got.columns == df.columns and sorted(map(tuple, got.collect()), key=repr) == want
    assert bloom.not_in(df.limit(0), other, ["s", "n"]).count() == 0


def test_only_hits_and_false_positives_go_on(spark):
    """Of 20,000 rows with 100 known keys, some hundred keys reach the exact join."""
    df = spark.range(20_000).select(F.concat(F.lit("t"), "id").alias("k"))
    other = spark.range(50_000, 52_000).unionByName(spark.range(100)).select(F.concat(F.lit("t"), "id").alias("k"))
    known = bloom.known_keys(df, other, ["k"])
    assert known.count() == 100
    table = bloom.built(other, ["k"], 2100)
    assert bloom.asked(df, ["k"], table, 2100, "m").filter("m").count() < 100 + 600


# --- row numbers ---------------------------------------------------------------------------


def test_numbers_in_order(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("v"), F.lit("x").alias("__id"))
    got = rowids.numbered(df.drop("__id"), ["v"], start=5).collect()
    want = {v: i + 5 for i, v in enumerate(sorted(i * 7919 % 1009 for i in range(1000)))}
    assert {r["v"]: r["row_id"] for r in got} == want
    assert rowids.numbered(df.limit(0), ["v"]).count() == 0
    same = rowids.numbered(spark.range(50).select(F.lit(1).alias("v")), ["v"])
    assert sorted(r["row_id"] for r in same.collect()) == list(range(50))
    sums = rowids.running(spark.createDataFrame([(3, 1), (1, 10), (2, 5), (None, 2)], "o int, n int"), ["o"], "n", "before")
    assert {r["o"]: r["before"] for r in sums.collect()} == {None: 0, 1: 2, 2: 12, 3: 17}


def test_lines_of_split_files(spark, tmp_path):
    """Part files beyond five digits come after shorter ones; files are split by bytes; empty lines are lines."""
    texts = {"part-00000.txt": [f"a{i}" for i in range(4000)], "part-00001.txt": ["", "b", ""], "part-100000.txt": ["z"], "part-99999.txt": [f"y{i}é" for i in range(900)], "part-00003.txt": []}
    for name, rows in texts.items():
        (tmp_path / name).write_text("".join(r + "\n" for r in rows))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    spark.conf.set("spark.sql.files.openCostInBytes", "100")
    try:
        got = {r["row_id"]: r["value"] for r in rowids.lines(spark, str(tmp_path)).collect()}
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 5
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    names = ["part-00000.txt", "part-00001.txt", "part-00003.txt", "part-99999.txt", "part-100000.txt"]
    assert got == dict(enumerate(x for n in names for x in texts[n]))


def test_records_of_lines(spark, tmp_path):
    (tmp_path / "p.json").write_text('{"a": 1}\n{"a": null, "b": "x"}\n')
    got = rowids.json_lines(spark, str(tmp_path / "p.json"), "a int, b string", start=1).orderBy("row_id")
    assert [tuple(r) for r in got.collect()] == [(1, 1, None), (2, None, "x")]
    (tmp_path / "p.json").write_text('{"a": 1}\n{"a"\n')
    with pytest.raises(Exception):
        rowids.json_lines(spark, str(tmp_path / "p.json"), "a int").collect()


# --- heads of groups -----------------------------------------------------------------------


@pytest.mark.parametrize("n", [3, 1500])
def test_heads_of_hot_groups(spark, monkeypatch, n):
    """Above Spark's own limit, too, no task gets a whole group: its rows are cut level by level."""
    df = spark.range(9000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise((F.col("id") % 30).cast("string")).alias("g"), (F.col("id") * 7919 % 9001).alias("v"))
    want = {}
    for r in df.collect():
        want.setdefault(r["g"], []).append(r["v"])
    got = {}
    for r in sample.target_cut(df, ["g"], n, "v").collect():
        got.setdefault(r["g"], []).append(r["v"])
    assert {g: sorted(v) for g, v in got.items()} == {g: sorted(v)[:n] for g, v in want.items()}
    plan = sample.target_cut(df, ["g"], n, "v")._jdf.queryExecution().optimizedPlan().toString()
    assert ("WindowGroupLimit" in plan) == (n == 3) and plan.count("Window [") == (1 if n == 3 else 3)
    capped = sample.capped(df, ["g"], {("hot",): 2000}, 4000, "v")
    assert capped.count() == 4000


@pytest.mark.parametrize("cap", [3, 10, 57, 200, 5000])
def test_caps_of_many_buckets(spark, monkeypatch, cap):
    """The plan by prefix sums takes what the plan on the driver takes."""
    chance = random.Random(9)
    rows = [(i, chance.choice(["p", "q", None, *"abcdefgh"[: 1 + i % 8]])) for i in range(300)]
    df, quota = spark.createDataFrame(rows, "id long, b string"), {("p",): 20, ("q",): 3, (None,): 9, ("a",): 30, ("zz",): 5}
    one = sorted(r["id"] for r in sample.capped(df, ["b"], quota, cap, "id").collect())
    monkeypatch.setattr(sample, "FEW_BUCKETS", 2)
    assert sorted(r["id"] for r in sample.capped(df, ["b"], quota, cap, "id").collect()) == one and len(one) == min(cap, 300)


def test_few_shots_of_every_bucket(spark):
    chance = random.Random(4)
    rows = [(i, chance.choice(["d", "e", None]), chance.choice([True, False, None]), chance.randrange(1, 5)) for i in range(120)] + [(900 + i, "only", True, 2) for i in range(9)]
    df = spark.createDataFrame(rows, "id int, domain string, context_required boolean, user_turns int")
    got = {}
    for r in sample.few_shots_of(df, 2, "id", ["domain"]).collect():
        got.setdefault((r["domain"], r["for_context"], r["for_turns"]), []).append(r["id"])
    for (domain, context, turns), ids in got.items():
        pool = df.filter(F.col("domain").eqNullSafe(domain))
        assert sorted(ids) == sorted(r["id"] for r in sample.few_shots(pool, context, turns, 2, "id").collect()), (domain, context, turns)
    assert len(got) == 2 * len({(r[1], r[3]) for r in rows})


# --- waves with state ----------------------------------------------------------------------

ROWS = "id int, k string, b string"


def stepped(spark, at, waves, quota):
    out = []
    for rows in waves:
        if rows is not None:
            spark.createDataFrame(rows, ROWS).repartition(2).write.mode("append").parquet(f"{at}/in")
        keyed.waves(spark.readStream.schema(ROWS).parquet(f"{at}/in"), f"{at}/out", f"{at}/mark", ["k"], ["id"], ["b"], quota, bands=4).awaitTermination()
        out.append(sorted(r["id"] for r in spark.read.schema(ROWS).parquet(f"{at}/out").collect()))
    return out


def test_waves_hold_keys_and_counts_as_state(spark, tmp_path):
    chance = random.Random(6)
    quota = {("p",): 4, ("q",): 9}
    rows = [(i, chance.choice([None, "hot", "hot", *"abcdefghijklmnopqrstuvwxyz"]), chance.choice(["p", "q", "r", None])) for i in range(90)]
    cut = [rows[:30], rows[30:31], None, rows[31:]]
    steps = stepped(spark, str(tmp_path / "many"), cut, quota)
    assert steps[1] == steps[2]  # a start without new files adds nothing
    first, full = {}, {"p": 0, "q": 0}
    for i, k, b in rows:
        first.setdefault(k, (i, b))
    want = []
    for i, b in sorted(first.values()):
        if b in full and full[b] < quota[(b,)]:
            full[b] += 1
            want.append(i)
    assert steps[-1] == want == stepped(spark, str(tmp_path / "one"), [rows], quota)[-1]


# --- publishing ----------------------------------------------------------------------------


def test_readers_see_whole_versions(spark, tmp_path):
    store, schema = Store(spark, str(tmp_path / "t")), "id long, t string"
    assert store.manifest() is None and store.read(schema).count() == 0
    df = spark.range(10).withColumn("t", F.lit("é"))
    assert store.publish(df) == 1
    broken = df.withColumn("t", F.when(F.col("id") == 7, F.raise_error(F.lit("stopped"))).otherwise("x"))
    with pytest.raises(Exception, match="stopped"):
        store.publish(broken)
    folders = lambda: sorted(p.name for p in (tmp_path / "t").iterdir() if p.name.startswith("data-"))
    assert store.versions() == [1] and store.read(schema).count() == 10 and len(folders()) == 1  # what failed is gone
    (tmp_path / "t" / "data-killed").mkdir()  # what a killed writer leaves
    (tmp_path / "t" / "data-killed" / "part-0.json").write_text('{"id": 99}\n')
    assert store.read(schema).count() == 10
    assert store.publish(df.limit(3)) == 2 and store.read(schema).count() == 3 and store.read(schema, 1).count() == 10
    with pytest.raises(Conflict):
        store.publish(df, parent=1)
    assert store.versions() == [1, 2] and store.read(schema).count() == 3 and len(folders()) == 3
    assert "data-killed" in store.vacuum() and store.versions() == [2] and store.read(schema).count() == 3 and len(folders()) == 1


def test_counters_come_from_the_write(spark, tmp_path):
    df = spark.range(100).withColumn("reason", F.when(F.col("id") % 4 == 0, "a").when(F.col("id") % 5 == 0, "b"))
    got = sinks.jsonl_counted(df, str(tmp_path / "x"), F.col("reason").isNull(), {"a": F.col("reason") == "a", "b": F.col("reason") == "b", "none": F.col("reason") == "c"})
    assert got == {"rows": 100, "a": 25, "b": 15, "none": 0} and spark.read.json(str(tmp_path / "x")).count() == 60
    assert sinks.jsonl_counted(df.limit(0), str(tmp_path / "y"), F.lit(True), {}) == {"rows": 0}


# --- alignment -----------------------------------------------------------------------------


def longest(a, b):
    @lru_cache(None)
    def best(i, j):
        return 0 if i == len(a) or j == len(b) else 1 + best(i + 1, j + 1) if a[i] == b[j] else max(best(i + 1, j), best(i, j + 1))

    return best(0, 0)


def test_common_words_against_plain():
    chance = random.Random(8)
    for _ in range(300):
        a, b = ([chance.choice("abcd") for _ in range(chance.randrange(14))] for _ in range(2))
        assert align.common(a, b) == longest(tuple(a), tuple(b))
    assert align.common(list(map(str, range(5000))), list(map(str, range(0, 5000, 2)))) == 2500


def test_comparison_and_report(spark):
    rows = [("m", "Mở nhạc số 5!", "mở bài số 5 và 7", "user: mở nhạc 5"), ("m", None, "", None), ("n", "a", "b c. a", "A c"), ("z", "", None, "x")]
    got = align.compared(spark.createDataFrame(rows, "domain string, gold string, pred string, said string"), "gold", "pred", "said").collect()
    assert [(r["matched"], r["gold_words"], r["pred_words"], r["foreign"], r["foreign_words"], r["both_slots"]) for r in got] == [(3, 4, 6, ["bài số", "và 7"], 4, 1), (0, 0, 0, [], 0, 0), (1, 1, 3, ["b"], 1, 0), (0, 0, 0, [], 0, 0)]
    by = {r["domain"]: r for r in align.report(align.compared(spark.createDataFrame(rows, "domain string, gold string, pred string, said string"), "gold", "pred", "said"), "domain").collect()}
    assert by["m"]["word_precision"] == 0.5 and by["m"]["word_recall"] == 0.75 and by["m"]["hallucinated"] == 0.5 and by["z"]["word_precision"] is None


# --- services ------------------------------------------------------------------------------


class Limited(Exception):
    def __init__(self, status, after=None):
        super().__init__(f"failed to generate ({status})")
        self.status, self.headers = status, {"Retry-After": after} if after else {}


def test_what_a_service_says():
    class Response:
        status_code, headers = 429, {"Retry-After": "3"}

    held = RuntimeError("x")
    held.response = Response()
    assert hooks.asks_to_wait(held) == 3 and hooks.asks_to_wait(Limited(429)) == 0 and hooks.asks_to_wait(Limited(429, "soon")) == 0
    assert hooks.asks_to_wait(Limited(500)) is None and hooks.asks_to_wait(RuntimeError("rate 429: failed to generate")) is None


def test_batches_of_like_length(spark):
    df = spark.range(1000).select("id", (F.col("id") * 7919 % 500).alias("n"))
    seen = lambda: lambda b: b.assign(size=len(b), most=b["n"].max())[["id", "n", "size", "most"]]
    got = hooks.by_length(df.repartition(3), "n", seen, "id long, n long, size long, most long", 4000, window=200).collect()
    assert sorted(r["id"] for r in got) == list(range(1000)) and all(r["size"] * r["most"] <= 4000 or r["size"] == 1 for r in got)
    padded = sum(r["most"] for r in got) / sum(r["n"] for r in got)
    assert padded < 1.15, padded  # 2.0 in the order in which the rows come
    assert hooks.by_length(df.limit(0), "n", seen, "id long, n long, size long, most long", 10).count() == 0


def test_keys_are_leased_to_one_task(spark, tmp_path):
    """A service that notes its calls sees each key from one task alone and no more calls a second than agreed."""
    keys = ["k0", "k1", "k2", "k3", "k4"]

    def make(own):
        from pyspark import TaskContext

        key, task = own[0], TaskContext.get().partitionId()

        def call(prompt):
            with open(tmp_path / f"{key}.{task}", "a") as f:
                f.write(f"{time.monotonic()}\n")
            return f"{key}:{prompt}"

        return call

    df = spark.range(60).select("id", F.concat(F.lit("p"), "id").alias("p"))
    got = hooks.leased(df, "p", keys, make, rate=20.0, tasks=3).collect()
    assert len(got) == 60 and all(r["reply"].split(":")[1] == r["p"] and r["ok"] for r in got)
    notes = sorted(tmp_path.iterdir())
    assert sorted(p.name.split(".")[0] for p in notes) == keys  # one file, so one task, for each key
    for p in notes:
        at = sorted(map(float, p.read_text().split()))
        assert all(b - a > 0.04 for a, b in zip(at, at[1:])), at


# --- time that grows with the length of a text ------------------------------------------------


def test_exact_containment_is_linear(spark):
    items = spark.createDataFrame([(1, "needle"), (2, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen")], "item_id int, text string")
    took = []
    for n in (20_000, 40_000, 320_000):
        text = " ".join(f"w{i}" for i in range(n - 16)) + " one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen needle"
        df = spark.createDataFrame([(n, text)], "doc_id int, text string")
        began = time.time()
        assert sorted(tuple(r) for r in contain.contained(df, items, "doc_id", "item_id").collect()) == [(n, 1), (n, 2)]
        took.append(time.time() - began)
    assert took[2] < 12 * took[1] + 3, took


def test_blank_lines_of_any_white_space(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"a": 1}\n\t\n   \n{"a": 2}\n\n', encoding="utf-8")
    assert [r["a"] for r in ingest.jsonl(spark, str(tmp_path / "x.json"), "a int", "blanks").collect()] == [1, 2]


def test_service_reply_is_json_free_of_rate(spark):
    """Words of an error's text say nothing: only its status does."""
    naps = []
    assert hooks.service(["k"], lambda c, p: (_ for _ in ()).throw(RuntimeError("failed to generate")), tries=3, sleep=naps.append)("x") is None
    assert naps == [0.5, 1.0] and json.dumps(naps)


# --- payloads as a data source ----------------------------------------------------------------

SHAPES = {
    "a.json": '{"samples": [{"rewrite": "é"}, 3, {"rewrite": "b", "n": 1.5}]}', "b.txt": ' [{"rewrite": "c"}, [1], {"rewrite": "d"}] ', "c.json": '{"rewrite": "e"}', "d.txt": 'x\n{"rewrite": "f"},\n\n[{"rewrite": "no"}]\n{"samples": [{"rewrite": "g"}]}\n{"a": 1, "a": 2}\n{"a": NaN}',
    "e.md": 'Here:\n```json\n{"samples": [{"rewrite": "h"}]}\n```\n{"rewrite": "no"}', "f.json": "", "g.txt": "[", "_h.json": '{"rewrite": "hidden"}', "i.json": '{"rewrite": "j"} {"rewrite": "k"}', "k.txt": "```\n[]\n```",
}


def test_payload_source_reads_as_the_expressions_do(spark, tmp_path):
    from turnloom.sources import payloads

    payloads.register(spark)
    for name, text in SHAPES.items():
        (tmp_path / name).write_text(text, encoding="utf-8")
    whole = ingest.payload_items(ingest.whole_files(spark, [str(tmp_path / n) for n in SHAPES if n[0] != "_"]))
    want = sorted((r["file"].split("/")[-1], r["pos"], json.loads(r["item"])["rewrite"] if "rewrite" in r["item"] else r["item"]) for r in whole.collect())
    for size in ("1", "134217728"):
        got = spark.read.format("payloads").option("partitionBytes", size).load(str(tmp_path))
        assert sorted((r["file"].split("/")[-1], r["pos"], json.loads(r["item"])["rewrite"] if "rewrite" in r["item"] else r["item"]) for r in got.collect()) == want
    assert [w[2] for w in want] == ["é", "b", "c", "d", "e", "f", "g", "h"]
    assert spark.read.format("payloads").option("glob", "c*").load(str(tmp_path)).count() == 1
    (tmp_path / "none").mkdir()
    assert spark.read.format("payloads").load(str(tmp_path / "none")).count() == 0


@pytest.mark.parametrize("step", [1, 7, 64, 10_000])
def test_lines_are_cut_by_bytes_and_none_is_lost(spark, tmp_path, step):
    from turnloom.sources import payloads

    payloads.register(spark)
    rows = [f'{{"rewrite": "é{i}{"x" * (i % 11)}"}}' + ("," if i % 3 == 0 else "") for i in range(60)] + ["bad", "", '{"rewrite": "last"}']
    (tmp_path / "p.jsonl").write_text("\n".join(rows) + ("\n" if step == 7 else ""), encoding="utf-8")
    for small in (1, 5, 1 << 20):
        with open(tmp_path / "p.jsonl", "rb") as f:
            size = len(f.read())
            got = [x for at in range(0, size, step) for x in payloads.lines_of(f, at, min(at + step, size), small)]
        assert [t for _, t in got] == [r for r in rows if r]
    if step > 7:
        df = spark.read.format("payloads").option("partitionBytes", str(step)).load(str(tmp_path))
        assert [json.loads(r["item"])["rewrite"] for r in df.orderBy("pos").collect()] == [json.loads(r.rstrip(","))["rewrite"] for r in rows if r not in ("bad", "")]


def test_payload_stream_goes_on_where_it_stopped(spark, tmp_path):
    from turnloom.sources import payloads

    payloads.register(spark)
    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()

    def run(*names):
        for n in names:
            (folder / n).write_text(f'{{"samples": [{{"rewrite": "{n}1"}}, {{"rewrite": "{n}2"}}]}}')
        stream = spark.readStream.format("payloads").load(str(folder))
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "mark")).trigger(availableNow=True).start().awaitTermination()
        return sorted(json.loads(r["item"])["rewrite"] for r in spark.read.schema("file string, pos long, item string").parquet(out).collect())

    assert run("a.json") == ["a.json1", "a.json2"]
    assert run() == ["a.json1", "a.json2"]
    assert run("b.json", "c.json") == [f"{n}.json{k}" for n in "abc" for k in (1, 2)]
