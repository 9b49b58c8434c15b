"""Bloom filters as tables, and anti-joins that look there first.

A filter has a row for each block: a number and eight words of 64 bits.  A key's hash names one block and
one bit in each of its words, so a filter is built by ``bit_or`` over blocks, which sums before the shuffle,
and asked by one join on the block.  With ``BITS`` bits a key some 1 % of foreign keys are taken for known.

``not_in`` gives what ``dedup.not_in`` gives.  Rows whose key the filter doesn't know are new and stay where they
are.  The keys of the others, hits and false positives, are what is shuffled; a second filter, over these
keys, thins out the other side before it.  Both filters are broadcast up to ``FILTER_BYTES``; where other has
too many keys for that, the plain anti-join does the work.

Defined cases: nulls equal each other, as in ``dedup.first_wins``.  An empty filter knows no key.  Very long
keys are hashed whole and compared whole.  Repeated rows stay repeated.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import stored
from . import dedup

WORDS, WORD_BITS, BITS = 8, 64, 12
#: Most bytes of a filter that is broadcast, and what a row of it takes there; most bytes of exact keys that are broadcast.
FILTER_BYTES, ROW_BYTES, KEY_BYTES = 256 << 20, 128, 32 << 20


def blocks_for(keys: int) -> int:
    return max(1, -(-keys * BITS // (WORDS * WORD_BITS)))


def _places(key: list[Column], blocks: int) -> tuple[Column, list[Column]]:
    """The block of a key and its bit in each word."""
    h = F.xxhash64(*key)
    bits = F.xxhash64(h, F.lit(1))
    at = [F.shiftright(bits, 6 * i).bitwiseAND(F.lit(WORD_BITS - 1)).cast("int") for i in range(WORDS)]
    return F.pmod(h, F.lit(blocks)), [F.call_function("shiftleft", F.lit(1).cast("long"), a) for a in at]


def built(df: DataFrame, key: list[str], keys: int) -> DataFrame:
    """The filter over df's keys (block, w0 to w7), sized for so many."""
    block, bits = _places([F.col(c) for c in key], blocks_for(keys))
    named = df.select(block.alias("block"), *[b.alias(f"b{i}") for i, b in enumerate(bits)])
    return named.groupBy("block").agg(*[F.bit_or(f"b{i}").alias(f"w{i}") for i in range(WORDS)])


def asked(df: DataFrame, key: list[str], bloom: DataFrame, keys: int, name: str) -> DataFrame:
    """df with name: whether the filter, which is broadcast, may know the row's key."""
    block, bits = _places([F.col(c) for c in key], blocks_for(keys))
    words = bloom.select(F.col("block").alias("__block"), *[F.col(f"w{i}").alias(f"__w{i}") for i in range(WORDS)])
    got = df.withColumn("__at", block).join(F.broadcast(words), F.col("__at") == F.col("__block"), "left")
    known = reduce(lambda a, b: a & b, [F.col(f"__w{i}").bitwiseAND(b) != 0 for i, b in enumerate(bits)])
    return got.withColumn(name, F.coalesce(known, F.lit(False))).select(*df.columns, name)


def _broadcast_fits(keys: int) -> bool:
    return blocks_for(keys) * ROW_BYTES <= FILTER_BYTES


def _bytes(df: DataFrame, cols: list[str]) -> int:
    size = reduce(lambda a, b: a + b, [F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) + 48 for c in cols])
    return df.agg(F.coalesce(F.sum(size.cast("long")), F.lit(0))).first()[0]


def known_keys(df: DataFrame, other: DataFrame, key: list[str]) -> DataFrame | None:
    """The keys (__k0, ...) of df that other has, exactly, as a stored table; None where other has too many for a filter."""
    n = other.count()
    if not _broadcast_fits(n):
        return None
    bloom = stored(built(other, key, n), "bloom")
    names = [f"__k{i}" for i in range(len(key))]
    maybe = asked(df.select(*[F.col(c) for c in key]), key, bloom, n, "__maybe").filter("__maybe")
    maybe = stored(maybe.select(*[F.col(c).alias(k) for c, k in zip(key, names)]).distinct(), "maybe")
    m = maybe.count()
    theirs = other.select(*[F.col(c).alias(k) for c, k in zip(key, names)])
    if _broadcast_fits(m):
        theirs = asked(theirs, names, stored(built(maybe, names, m), "bloom"), m, "__maybe").filter("__maybe").drop("__maybe")
    theirs = theirs.distinct().select(*[F.col(k).alias(f"__o{i}") for i, k in enumerate(names)])
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__o{i}")) for i, k in enumerate(names)])
    return stored(maybe.join(theirs, on, "left_semi"), "known")


def not_in(df: DataFrame, other: DataFrame, key: list[str]) -> DataFrame:
    """Rows of df whose key other does not have."""
    known = known_keys(df, other, key)
    if known is None:
        return dedup.not_in(df, other, key)
    on = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__k{i}")) for i, c in enumerate(key)])
    if _bytes(known, known.columns) <= KEY_BYTES:
        return df.join(F.broadcast(known), on, "left_anti")
    n = known.count()
    told = asked(df, key, stored(built(known, known.columns, n), "bloom"), n, "__maybe")
    return told.filter("NOT __maybe").drop("__maybe").unionByName(told.filter("__maybe").drop("__maybe").join(known, on, "left_anti"))
