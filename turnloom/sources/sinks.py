"""Writers of JSON lines: absent fields stay absent, non-ASCII characters stay as they are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.text import slug
from ..operators.dedup import append
from ..operators.evaluate import without_system
from .publish import Store


def jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("ignoreNullFields", "true").json(path)


def jsonl_counted(df: DataFrame, path: str, keep: Column, counters: dict[str, Column]) -> dict[str, int]:
    """Writes the rows of df that keep holds for and returns how many rows, of all, each counter holds for.  Counters come from the
    run that writes: they are sums of the tasks that the write has taken, so a task that is run again counts once."""
    seen = Observation()
    told = df.observe(seen, F.count("*").alias("rows"), *[F.count_if(F.coalesce(c, F.lit(False))).alias(f"c_{i}") for i, c in enumerate(counters.values())])
    jsonl(told.filter(F.coalesce(keep, F.lit(False))), path)
    got = seen.get
    return {"rows": got["rows"]} | {name: got[f"c_{i}"] for i, name in enumerate(counters)}


def by_split(df: DataFrame, path: str, split: str = "split") -> None:
    """One folder for each split."""
    df.write.mode("overwrite").partitionBy(split).option("ignoreNullFields", "true").json(path)


def by_model(df: DataFrame, path: str) -> None:
    """Predictions, one folder for each model."""
    df.withColumn("model_slug", slug(F.col("model"))).write.mode("overwrite").partitionBy("model_slug").option("ignoreNullFields", "true").json(path)


def merged(new: DataFrame, key: list[str], order: list[str], path: str) -> int:
    """Publishes what path holds (as last published there) and, after it, the first of each key of new that it lacks; readers see the
    old version until the new one is whole.  Returns the new version."""
    store = Store(new.sparkSession, path)
    known = store.versions()
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in new.schema.fields)
    return store.publish(append(store.read(schema), new, key, order), parent=known[-1] if known else 0)


def comparison(df: DataFrame, path: str) -> None:
    jsonl(df.withColumn("dialogue", without_system(F.col("dialogue"))), path)
