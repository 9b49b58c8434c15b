"""What Spark sizes too low, by a compressed file or before an explode, is not broadcast of itself."""

import pytest
from pyspark.sql import functions as F

from turnloom.llm import decontam, shared, simhash


@pytest.fixture
def small_broadcasts(spark):
    """Tables above 12 MB can't be broadcast, as if the driver had no memory for them; Spark's own threshold stays."""
    key = "spark.sql.maxBroadcastTableSize"
    before = spark.conf.get(key)
    spark.conf.set(key, "12m")
    yield
    spark.conf.set(key, before)


@pytest.fixture
def taken_for_small(spark):
    """Spark takes every table for small enough to broadcast, and none above 64 KB can be."""
    keys = {"spark.sql.autoBroadcastJoinThreshold": "8g", "spark.sql.maxBroadcastTableSize": "64k"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def _many(spark, n):
    """So many documents with fingerprints of their own, and copies of every tenth."""
    word = lambda k: F.concat(F.lit("w"), F.hex(F.xxhash64("id", F.lit(k))))
    made = spark.range(n).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *map(word, range(5))).alias("text"))
    return made.unionByName(made.filter("doc_id % 10 = 0").withColumn("doc_id", F.col("doc_id") + n))


def test_near_dedup(spark, small_broadcasts):
    left = simhash.dedup(_many(spark, 10_000))
    assert left.count() == 10_000 and left.filter("doc_id >= 10000").isEmpty()


def test_simhash(spark, small_broadcasts):
    got = simhash.op9(_many(spark, 10_000))
    assert got.count() == 11_000
    assert got.filter("doc_id >= 10000 and component_id = doc_id - 10000").count() == 1_000


def test_simhash_at_any_size_taken(spark, taken_for_small):
    """Copies alone, so that the joins that give documents their components hold all rows."""
    got = simhash.op9(_many(spark, 5_000))
    assert got.count() == 5_500
    assert got.filter("component_id = if(doc_id >= 5000, doc_id - 5000, doc_id)").count() == 5_500


def test_components_at_any_size_taken(spark, taken_for_small):
    """Chains of four nodes, and one hub."""
    at = spark.range(5_000).withColumn("at", F.col("id") * 4)
    chains = [at.select((F.col("at") + i).alias("a"), (F.col("at") + i + 1).alias("b")) for i in range(3)]
    hub = spark.range(1, 5_000).select(F.lit(100_000).cast("long").alias("a"), (F.col("id") + 100_000).alias("b"))
    got = simhash.components(chains[0].unionByName(chains[1]).unionByName(chains[2]).unionByName(hub))
    assert got.count() == 25_000
    assert got.filter("root = if(node >= 100000, 100000, node - node % 4)").count() == 25_000


def test_places_in_decontamination(spark):
    """Of the texts with places, and of them alone, the keys are broadcast and not the places; the windows are."""
    item = " ".join(f"v{i}" for i in range(13))
    docs = spark.createDataFrame([(1, f"a {item} b"), (2, "c")], "doc_id long, text string")
    found = decontam.hits(docs, spark.createDataFrame([(1, item)], "item_id long, text string"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") == 2 and plan.count("SortMergeJoin") == 1
    assert found.count() == 1


def test_salted_copies(spark, small_broadcasts):
    right = shared.stored(spark.range(30_000).select("id", (F.col("id") * 2).alias("twice")), "salted")
    got = shared.looked_up(spark.range(30_000), right, ["id"], "inner", 10, F.col("id"))
    assert got.filter("twice = 2 * id").count() == 30_000
