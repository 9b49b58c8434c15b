"""Waves with keyed state: what was seen and how full each bucket is lie in Spark's state store.

A wave reads no accepted rows; its cost grows with its own rows.  Three steps in one stream:

* each task keeps, of what it reads, the first row of each key in its Arrow batches, so a hot key (one
  utterance that a third of all rows repeat) goes on as a few rows;
* ``FirstSeen`` holds the keys seen, dealt by hash to ``bands`` groups.  Of a wave's rows it passes on the first of each
  key that it has not seen, and of these at most as many of a bucket as the largest quota: more can't be let in;
* ``Room`` holds a count for each bucket and lets in the first rows, as many as there is room for; it keeps no more
  rows than that while it reads, so a hot bucket takes bounded memory.

So waves, stopped and started at any place, give the rows that one run over all of them gives, if the order
agrees with the order of waves: the first of each key, and of these the first of each bucket.  A key counts as seen with its
first row even if its bucket is full.  Buckets without a quota let nothing in.

Results are written by Spark's file sink, which takes each wave once.  Defined cases: null keys equal each
other, null buckets have no quota; empty waves add nothing; very long keys are held as their SHA-256.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

#: Groups that keys are dealt to.  A group's distinct keys of one wave are in memory at once: raise it for large waves.  It stays with a checkpoint.
BANDS = 64
_KEY, _BAND, _BUCKET = "key", "band", "bucket"


def _first(rows: pd.DataFrame, by: str, order: list[str], n: int) -> pd.DataFrame:
    """The first n rows of each value of by."""
    return rows.sort_values(order, kind="stable", na_position="first").groupby(by, sort=False, dropna=False).head(n)


class FirstSeen(StatefulProcessor):
    def __init__(self, order: list[str], most: int):
        self.order, self.most = order, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "key string", "one boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = None
        for chunk in rows:
            both = chunk if held is None else pd.concat([held, chunk], ignore_index=True)
            held = _first(both, _KEY, self.order, 1)
        if held is None:
            return
        new = held[[not self.seen.containsKey((k,)) for k in held[_KEY]]]
        for k in new[_KEY]:
            self.seen.updateValue((k,), (True,))
        if len(new):
            yield _first(new, _BUCKET, self.order, self.most).drop(columns=[_KEY, _BAND])

    def close(self) -> None:
        pass


class Room(StatefulProcessor):
    def __init__(self, order: list[str], quota: dict[str, int]):
        self.order, self.quota = order, quota

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.let_in = handle.getValueState("let_in", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = self.let_in.get()[0] if self.let_in.exists() else 0
        room, held = self.quota.get(key[0], 0) - before, None
        for chunk in rows:
            if room > 0:
                both = chunk if held is None else pd.concat([held, chunk], ignore_index=True)
                held = _first(both, _BUCKET, self.order, room)
        if held is not None and len(held):
            self.let_in.update((before + len(held),))
            yield held.drop(columns=[_BUCKET])

    def close(self) -> None:
        pass


def accepting(source: DataFrame, key: list[str], order: list[str], bucket: list[str], quota: dict[tuple, int], bands: int = BANDS) -> DataFrame:
    """The rows of a stream that are let in; quota by the values of bucket, a row for each bucket and so a small table."""
    own = {f.name: f"c{i}" for i, f in enumerate(source.schema.fields)}  # state operators rename some names, as those with a leading underscore
    schema = ", ".join(f"{own[f.name]} {f.dataType.simpleString()}" for f in source.schema.fields)
    by = [own[c] for c in order]
    name = lambda cols: F.to_json(F.struct(*[F.col(own[c]).cast("string").alias(f"v{i}") for i, c in enumerate(cols)]))
    limits = {_named(values): n for values, n in quota.items() if None not in values}
    rows = source.select(*[F.col(f"`{c}`").alias(n) for c, n in own.items()]).withColumn(_KEY, F.sha2(name(key), 256)).withColumn(_BUCKET, name(bucket))
    rows = rows.withColumn(_BAND, F.pmod(F.xxhash64(_KEY), F.lit(bands)).cast("int"))

    def fewer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield _first(b, _KEY, by, 1)

    rows = rows.mapInPandas(fewer, f"{schema}, {_KEY} string, {_BUCKET} string, {_BAND} int")
    new = rows.groupBy(_BAND).transformWithStateInPandas(FirstSeen(by, max(limits.values(), default=0)), f"{schema}, {_BUCKET} string", "append", "none")
    got = new.groupBy(_BUCKET).transformWithStateInPandas(Room(by, limits), schema, "append", "none")
    return got.select(*[F.col(n).alias(c) for c, n in own.items()])


def _named(values: tuple) -> str:
    """A bucket's name, as to_json writes it in Spark."""
    text = lambda v: str(v).lower() if isinstance(v, bool) else str(v)
    return json.dumps({f"v{i}": text(v) for i, v in enumerate(values)}, ensure_ascii=False, separators=(",", ":"))


def waves(source: DataFrame, path: str, checkpoint: str, key: list[str], order: list[str], bucket: list[str], quota: dict[tuple, int], bands: int = BANDS) -> StreamingQuery:
    """Runs over all files that are there and stops; called again with the same checkpoint, it goes on.  The quota and bands must stay as they were."""
    conf = source.sparkSession.conf
    conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return accepting(source, key, order, bucket, quota, bands).writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
