"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint has 64 bits.  Two that differ in at most 3 bits differ in at most one bit in one
of their two halves of 32 bits.  So each distinct fingerprint is indexed, for each half, by
the half itself and by the half with one bit left out, for each of the 32 bits.  Rows in which
the bit left out is 0 meet those in which it is 1: an equality join finds each pair of halves
that differ in one bit once, and no pair of equal halves.  Pairs found are verified by
bit_count(a ^ b).  A fingerprint has at most C(64,1) + C(64,2) + C(64,3) = 43,744 others
within 3 bits, so links grow with the number of distinct fingerprints, and copies, which share
a fingerprint, add none.

Components are found by alternating stars (large and small), each round a written table.  What
belongs to a fingerprint, a node or a root with very many rows is broadcast to them.

Defined cases: a null or empty text, or one of white space, has the fingerprint 0 and is
linked like any other.  A very long text is hashed whole, in blocks of shingles.  A null doc_id never names a component; a component without any other
id has a null id.  Repeated rows each give a row.  Further columns are dropped.
"""

from __future__ import annotations

from itertools import repeat

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import arrow_batches, joined_by_size, merged, stored

SHINGLE = 3
SEED = 42
BITS = 3
#: Shingles whose bits are counted at once.
BLOCK = 1 << 15


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Unsigned; 0 for a text without words."""
    import numpy as np
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        runs, n = iter([b" ".join(words)]), 1
    else:
        n = len(words) - shingle + 1
        runs = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    ones = np.zeros(64, np.int64)
    hashes = map(xxhash.xxh64_intdigest, runs, repeat(seed))
    for k in range(0, n, BLOCK):
        h = np.fromiter(hashes, np.uint64, min(BLOCK, n - k))
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED, *keep: Column) -> DataFrame:
    """doc_id, keep, fp (long, the unsigned value's bits)."""
    arrow_batches(docs.sparkSession)

    @F.pandas_udf("long")
    def fps(texts: pd.Series) -> pd.Series:
        found = [fingerprint(t, shingle, seed) for t in texts]
        return pd.Series([x - (1 << 64) if x >> 63 else x for x in found], dtype="int64")

    return docs.select("doc_id", *keep, fps("text").alias("fp"))


def links(fps: DataFrame, bits: int = BITS) -> DataFrame:
    """Pairs a, b of the distinct values fp that differ in 1 to 3 bits; each pair at least once.  A value gives 66 rows."""
    if not 0 < bits <= 3:
        raise ValueError("two halves allow for 1 to 3 bits")
    half = F.when(F.col("seg") == 0, F.col("fp").bitwiseAND(0xFFFFFFFF)).otherwise(F.shiftrightunsigned("fp", 32))
    at = fps.select("fp", F.explode(F.array(F.lit(0), F.lit(1))).alias("seg")).select("fp", "seg", half.alias("half"))
    rows = at.select("fp", "seg", "half", F.explode(F.sequence(F.lit(0), F.lit(32))).alias("bit"))
    one = F.expr("if(bit = 32, 0L, shiftleft(1L, bit))")
    rows = rows.select(
        "fp",
        (F.col("seg") * (1 << 40) + F.col("bit") * (1 << 32) + F.col("half").bitwiseAND(F.bitwise_not(one))).alias("key"),
        (F.col("half").bitwiseAND(one) != 0).alias("set"),
        (F.col("bit") == 32).alias("whole"),
    )
    a = rows.filter("whole or not set").select("key", "whole", F.col("fp").alias("a"))
    b = rows.filter("whole or set").select("key", F.col("fp").alias("b"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))).between(1, bits)
    return a.join(merged(b), "key").filter(near & (~F.col("whole") | (F.col("a") < F.col("b")))).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def components(edges: DataFrame) -> DataFrame:
    """node, root (the least node that it reaches) for the nodes of edges (a, b)."""
    e = stored(edges.select("a", "b").filter("a <> b").distinct(), "edges")
    size = lambda t: tuple(t.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).collect()[0])
    last = size(e)
    if not last[0]:
        return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    while True:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = joined_by_size(both.filter("v > u"), least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()
        large = stored(large, "large-star")
        low = large.groupBy(F.col("b").alias("u")).agg(F.min("a").alias("m"), F.count("*").alias("n"))
        small = joined_by_size(large.withColumnRenamed("b", "u"), low, "u")
        pairs = small.select(F.col("m").alias("a"), F.col("a").alias("b")).filter("a <> b").unionByName(low.select(F.col("m").alias("a"), F.col("u").alias("b")))
        e = stored(pairs.distinct(), "small-star")
        now = size(e)
        if now == last:
            break
        last = now
    return e.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(e.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())


def groups(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED, bits: int = BITS) -> DataFrame:
    """doc_id, fp, component_id for each row of docs."""
    found = stored(fingerprints(docs, shingle, seed), "fingerprints")
    nodes = stored(found.groupBy("fp").agg(F.min("doc_id").alias("id"), F.count("*").alias("n")), "nodes")
    at = stored(rooted(nodes, bits), "roots")
    ids = at.groupBy("root").agg(F.min("id").alias("component_id"), F.count("*").alias("n"))
    of_fp = joined_by_size(at.select("fp", "root", F.col("n").alias("rows")), ids, "root")
    return joined_by_size(found, of_fp.select("fp", "component_id", F.col("rows").alias("n")), "fp").select("doc_id", "fp", "component_id")


def rooted(nodes: DataFrame, bits: int) -> DataFrame:
    """nodes (fp, n and others) with root, the least fingerprint that theirs reaches."""
    roots = components(links(nodes.select("fp"), bits)).withColumnRenamed("node", "fp")
    return nodes.join(merged(roots), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def dedup(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED, bits: int = BITS) -> DataFrame:
    """docs with one row of each component: of the smallest doc_id (null ids last), then of the smallest hash of the text."""
    rows = stored(fingerprints(docs, shingle, seed, F.xxhash64("text").alias("h")), "fingerprints")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h"))
    nodes = stored(rows.groupBy("fp").agg(best.alias("best"), F.count("*").alias("n")), "nodes")
    stay = stored(rooted(nodes, bits).groupBy("root").agg(F.min("best").alias("x")).select(F.col("x.doc_id").alias("__id"), F.col("x.h").alias("__h")), "near-kept")
    docs = docs.withColumn("__hash", F.xxhash64("text"))
    on = lambda df: F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__hash") == F.col("__h"))
    left = docs.join(merged(stay), on(docs), "left_semi")
    again = stored(rows.groupBy(F.col("doc_id").alias("__id"), F.col("h").alias("__h")).count().filter("count > 1").select("__id", "__h"), "near-repeated")
    if again.isEmpty():
        return left.drop("__hash")
    once = left.join(merged(again), on(left), "left_semi").dropDuplicates(["doc_id", "__hash"])
    return left.join(merged(again), on(left), "left_anti").unionByName(once).drop("__hash")


def op9(docs: DataFrame) -> DataFrame:
    return groups(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
