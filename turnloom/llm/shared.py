"""What the operators of this subpackage share: reading tables, and tables that cut lineage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import cleanup, shared_dir, stored

__all__ = ["arrow_batches", "ascii_lower", "cleanup", "crc_mod", "few", "joined_by_size", "looked_up", "merged", "shared_dir", "space_words", "stored", "table"]

#: Rows in a batch that goes to Python.  Texts can be long, so batches are short.
ARROW_ROWS = 400

#: A-Z and a-z, for the lower-casing of ASCII letters alone.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: White space of the contracts: the space and the five controls from tab to carriage return.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_batches(spark: SparkSession) -> None:
    """Keeps the batches that go to Python small, whatever the session had."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def few(df: DataFrame, rows: int) -> bool:
    """Whether a stored table has at most so many rows, so that it may be broadcast."""
    return df.count() <= rows


def merged(df: DataFrame) -> DataFrame:
    """df as a side of a join that shuffles both sides, whatever Spark takes its size for.  Spark sizes a stored table by its
    compressed file and leaves out what an explode adds, so of itself it may broadcast a table far above its threshold
    and end the driver.  What is broadcast here is said so and bounded by its rows."""
    return df.hint("merge")


def looked_up(left: DataFrame, right: DataFrame, on: list[str], how: str, rows: int, salt: Column, salts: int = 16) -> DataFrame:
    """left with what right (a stored table) has for it: right is broadcast up to so many rows; beyond that it is
    dealt to salts copies, so that the rows of a hot key, told apart by salt, meet in as many tasks."""
    if few(right, rows):
        return left.join(F.broadcast(right), on, how)
    dealt = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.withColumn("__salt", F.pmod(F.xxhash64(salt), F.lit(salts)).cast("int")).join(merged(dealt), [*on, "__salt"], how).drop("__salt")


#: Rows of one key above which it is joined by a broadcast of its row: of n rows at most n / HOT keys have so many.
HOT = 100_000


def joined_by_size(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """left joined with right (a row for each key of on, which is not null, and n, the rows that left has for it): keys
    with many rows by broadcast, so that no task meets them all, others in a shuffle.  n is dropped."""
    many, few_ = right.filter(F.col("n") > HOT).drop("n"), right.filter(F.col("n") <= HOT).drop("n")
    return left.join(F.broadcast(many), on).unionByName(left.join(merged(few_), on))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def space_words(text: Column) -> Column:
    """Words between white space of the contracts; null has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda x: x != "")


def crc_mod(key: Column, n: int) -> Column:
    return F.crc32(key.cast("string").cast("binary")) % n
