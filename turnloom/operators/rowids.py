"""Dense numbers of rows, without a task that sees all rows.

``numbered`` numbers rows in a stated order: they are dealt by range of the order and sorted inside their
partitions; counts of partitions, summed up, give what stands before each.

``lines`` numbers the lines of files as they stand.  Files stay splittable: a line carries its file and the
byte at which its split begins, and its place among the lines that its task read.  A count for each split
and prefix sums over these counts, by file and byte, give what stands before a split.

``running`` makes such prefix sums.  Only sums of partitions (a number for each) reach the driver.

Defined cases: rows of equal order are told apart by chance, unless the order ends in a unique column; numbers
are dense all the same.  Null orders come first.  Empty tables and files give no rows.  Part files are in the
order of their numbers, also where these have more digits, others by name.  Empty lines are lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import stored

#: The places of a row in its partition are the lower bits of monotonically_increasing_id, the partition the upper ones.
_ROW_BITS = 33
#: Most splits whose sums are broadcast.
FEW_SPLITS = 100_000


def _ranged(df: DataFrame, order: list[Column | str]) -> DataFrame:
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(n, *order).sortWithinPartitions(*order)


def _before(sums: DataFrame, part: Column, start: int) -> Column:
    """What stands before a partition, from sums (part, n), a row for each partition."""
    before, total = {}, start
    for p, n in sorted(tuple(r) for r in sums.collect()):
        before[p], total = total, total + n
    return F.element_at(F.array(*[F.lit(before.get(p, total)).cast("long") for p in range(max(before, default=0) + 1)]), part + 1)


def numbered(df: DataFrame, order: list[Column | str], name: str = "row_id", start: int = 0) -> DataFrame:
    """df with dense numbers from start on in that order."""
    kept = stored(_ranged(df, order).withColumn("__id", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("__id", _ROW_BITS).cast("int")
    offset = _before(kept.groupBy(part.alias("part")).agg(F.count("*").alias("n")), part, start)
    return kept.withColumn(name, offset + F.col("__id").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))).drop("__id")


def running(df: DataFrame, order: list[Column | str], value: str, name: str, start: int = 0) -> DataFrame:
    """df with name: start and the sum of value (not null) over all rows before, in that order."""
    kept = stored(_ranged(df, order).withColumn("__part", F.spark_partition_id()), "running")
    offset = _before(kept.groupBy("__part").agg(F.sum(value).alias("n")), F.col("__part"), start)
    own = F.sum(value).over(Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return kept.withColumn(name, offset + F.coalesce(own, F.lit(0))).drop("__part")


def lines(spark: SparkSession, path: str | list[str], name: str = "row_id", start: int = 0) -> DataFrame:
    """value and the dense number of each line of the files, file after file."""
    read = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("byte"))
    kept = stored(read.withColumn("id", F.monotonically_increasing_id()), "lines")
    folder = F.regexp_extract("file", r"^(.*/)", 1)
    number = F.regexp_extract("file", r"/part-(\d+)[^/]*$", 1).try_cast("long")
    splits = kept.groupBy("file", "byte").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    splits = running(splits.select("*", folder.alias("folder"), number.alias("number")), ["folder", "number", "file", "byte"], "n", "before", start)
    splits = splits.select("file", "byte", "first", "before")
    few = splits.count() <= FEW_SPLITS
    got = kept.join(F.broadcast(splits) if few else splits, ["file", "byte"])
    return got.select("value", (F.col("before") + F.col("id") - F.col("first")).alias(name))


def json_lines(spark: SparkSession, path: str | list[str], schema: str, name: str = "row_id", start: int = 0) -> DataFrame:
    """Records of JSON lines with the number of their line; a bad line is an error."""
    got = lines(spark, path, name, start)
    return got.select(name, F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select(name, "r.*")
