"""Exact deduplication: the first (or last) of each key, in a stated order; never by chance.

First-wins is a min_by over the key, which sums partially before the shuffle, so that a hot key
(one utterance that a third of all rows repeat) sends a row for each task and not all rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_wins(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The row of each key with the least order; order should end in a unique column."""
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    return df.groupBy(*key).agg(F.min_by(row, F.struct(*order)).alias("__row")).select("__row.*")


def last_wins(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The values of the last row of each key, with ``first_order``, the place of its first row."""
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    return df.groupBy(*key).agg(F.max_by(row, F.struct(*order)).alias("__row"), F.min(F.struct(*order)).alias("__first")).select("__row.*", F.col(f"__first.{order[0]}").alias("first_order"))


def sized(df: DataFrame, key: list[str], order: list[str], *values: str) -> DataFrame:
    """key, n (rows of that key, of which one is kept and the others are duplicates) and values of the first."""
    return df.groupBy(*key).agg(F.count("*").alias("n"), *[F.min_by(v, F.struct(*order)).alias(v) for v in values])


def union_all(*dfs: DataFrame) -> DataFrame:
    """One after the other, with source_rank, the place of each source."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [d.withColumn("source_rank", F.lit(i)) for i, d in enumerate(dfs)])


def not_in(df: DataFrame, other: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key other does not have (resume, append, remainder); nulls equal each other, as in ``first_wins``."""
    known = other.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(key)]).distinct()
    on = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__k{i}")) for i, c in enumerate(key)])
    return df.join(known, on, "left_anti").select(*df.columns)


def append(existing: DataFrame, new: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """existing and, after it, the first of each key of new that it lacks."""
    return existing.unionByName(not_in(first_wins(new, key, order), existing, key), allowMissingColumns=True)


def augmented(originals: DataFrame, variants: DataFrame, index: str, key: list[str]) -> DataFrame:
    """Originals and then their variants (left lookup by index); the first of each key stays, originals before variants."""
    found = originals.select(index).join(variants, index).withColumn("is_variant", F.lit(True))
    both = originals.withColumn("is_variant", F.lit(False)).unionByName(found, allowMissingColumns=True)
    return first_wins(both, key, ["is_variant", index])
