"""Waves that can be resumed: candidates come in as files, the accepted table is the state.

Each batch keeps the first of each key that is not accepted yet, as long as quotas have room,
and is written once under its batch id; a repeated batch overwrites its own folder.  Of the
accepted table a batch reads the columns of the key and of the bucket alone.  Null keys equal
each other.  No task ranks more rows of a bucket than the largest quota lets in from each task."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.dedup import first_wins, not_in
from ..operators.sample import heads


def accepted(spark: SparkSession, path: str, schema: str, before: int | None = None) -> DataFrame:
    """The accepted rows, of batches before one if given."""
    df = spark.read.schema(schema + ", batch long").parquet(path)
    return df if before is None else df.filter(F.col("batch") < before)


def waves(source: DataFrame, path: str, checkpoint: str, key: list[str], order: list[str], bucket: list[str] | None = None, quota: DataFrame | None = None) -> StreamingQuery:
    """Runs over all files that are there and stops."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields)

    def step(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{path}/batch=-1")  # once, so that there is a table
        old = accepted(spark, path, schema, n)
        new = not_in(first_wins(batch, key, order), old, key)
        if quota is not None:
            have = old.groupBy(*bucket).agg(F.count("*").alias("have"))
            room = quota.join(have, bucket, "left").select(*bucket, (F.col("quota") - F.coalesce("have", F.lit(0))).alias("room")).filter("room > 0")
            most = room.agg(F.max("room")).first()[0] or 0
            new = heads(new.join(room, bucket), bucket, most, order, "rn").filter("rn <= room").select(*source.columns)
        new.write.mode("overwrite").parquet(f"{path}/batch={n}")

    return source.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
