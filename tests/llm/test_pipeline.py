import corpus_pipeline
from tests.llm import brute
from turnloom.llm import packing, quality


def test_stages(spark, monkeypatch):
    """Each stage by a plain version of its rule, on its own input."""
    import os

    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    bench = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    y = spark.read.parquet(f"{sf}/labels.parquet")
    at = lambda d: {r["doc_id"]: r["text"] for r in d.collect()}
    (_, s8), (_, s9), (_, s3), (_, s10), (_, s5) = corpus_pipeline.STAGES
    a = s8(spark, docs, sf)
    assert a.columns == docs.columns
    assert set(at(a)) == {r["doc_id"] for r in quality.op8(docs, y).collect() if r["predicted"]}
    a = a.cache()
    b = s9(spark, a, sf).cache()
    assert b.columns == docs.columns and set(at(b)) == {r[2] for r in brute.op9(list(at(a).items()))}
    c = s3(spark, b, sf).cache()
    assert c.columns == docs.columns and set(at(c)) == {r[0] for r in brute.op3(list(at(b).items()), bench) if not r[5]}
    d = s10(spark, c, sf).cache()
    assert d.columns == docs.columns and d.dtypes == docs.dtypes
    before, after = at(c), at(d)
    assert before.keys() == after.keys() and not any(brute.pii(t) for t in after.values())
    assert all(after[k] == t for k, t in before.items() if not brute.pii(t) and "=" not in t and ":" not in t and "55" not in t)
    tk = Tokenizer.from_file(packing.tokenizer_path())
    tk.encode_special_tokens = True
    brute.op5([tuple(r) for r in s5(spark, d, sf).collect()], list(after.items()), lambda t: tk.encode(t, add_special_tokens=False).ids)
    assert corpus_pipeline.run(spark, sf).selectExpr("sum(length)").first()[0] == s5(spark, d, sf).selectExpr("sum(length)").first()[0]


def test_stages_on_odd_tables(spark, tmp_path):
    """Nulls, empty and repeated rows, clashing columns and an empty table go through every stage."""
    from pyspark.sql import functions as F

    sf = str(tmp_path)
    line = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"
    good = "This is a plain text about one thing and another, number "
    made = [(1, line, "en", "a", 1), (2, good + "two.", "en", "a", 1), (2, good + "two.", "en", "a", 1), (None, good + "nine", None, None, None), (3, None, None, None, None), (4, "", "en", "a", 0), (5, "Mail a@b.cd now " + good, "en", "a", 1)]
    docs = spark.createDataFrame(made, "doc_id long, text string, lang string, source string, n_chars long").select("*", *[F.lit("x").alias(c) for c in ("spans", "score", "fp", "h", "a", "b", "hit", "row", "base", "more", "w", "n", "cut", "wide", "ids")])
    spark.createDataFrame([(1, line)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    spark.createDataFrame([(i, 1) for i in range(1, 6)], "doc_id long, quality int").write.parquet(f"{sf}/labels.parquet")
    now = docs
    sizes = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, sf)
        assert now.columns == docs.columns and stage(spark, docs.limit(0), sf).count() == 0, name
        now = now.cache()
        sizes.append(now.count())
    got = {(r["doc_id"], r["text"]) for r in now.collect()}
    assert sizes[0] == 7 and sizes[3] == sizes[2] and not any(t == line for _, t in got) and any("[EMAIL]" in (t or "") for _, t in got)
    pieces = corpus_pipeline.STAGES[-1][1](spark, now, sf)
    assert pieces.count() == sizes[3] and corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), sf).count() == 0
    spark.createDataFrame(made, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{sf}/documents.parquet")
    assert corpus_pipeline.run(spark, sf).count() == sizes[3]
