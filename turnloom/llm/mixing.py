"""Mixing sources to target weights by pivotal dependent rounding.

Sources share what is asked for by weight; no target is above ``most`` times its source, and the
excess is shared again by weight until none is.  Each document of a source is then wanted target /
size times: the whole part is taken for certain, the rest is a probability that has to become 0 or 1.

Two documents with such probabilities meet: one gives words to the other, at random, until one of
both is 0 or 1.  That keeps the words of the two together exactly and each probability on average.
Documents are dealt by hash to blocks of some ``BLOCK`` rows inside their source; a block lets its
documents meet in order of size, the largest first, so that one, mostly a small one, stays open.
What stays open goes up: blocks of blocks do the same, down to one document for each source, which is
rounded to the nearer end.  That would leave half a long document too much or too little in a small source, so
documents of the last block that make up for it are turned over, each as long as it brings the sum nearer.

Identical rows (source, id, size) are one row with a count: their certain copies need no meeting and
their common rest is one probability.  Sums over sources are a row for each source; target shares come
from sums over that table, round by round, and nothing but those sums reaches the driver.

Defined cases: a null text has no words and nothing is taken of it; a source without words has the target 0.
Null sources are one source, the last.  Null ids are kept and told apart by size alone.  Repeated rows are
taken each.  Very long texts are single rows.  An empty table gives no rows.  Further columns are dropped.
Choices depend on ids, sizes and sources alone, so reruns agree whatever the partitions.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.rowids import numbered
from .shared import SPACE, looked_up, stored

WEIGHTS = (3, 1, 2)
SHARE, MOST = 1.5, 2.0
#: Documents that meet in one block.
BLOCK = 4096
#: Most sources whose targets are broadcast, and rows of one kind above which they are dealt out anew.
FEW_SOURCES, COPIES = 100_000, 100_000


def targets(sources: DataFrame, share: float = SHARE, most: float = MOST) -> DataFrame:
    """sources (source, n, source_size, weight) with target: share of all sizes by weight, at most most times the source's size."""
    df = stored(sources.withColumn("target", F.lit(None).cast("double")), "mixing")
    left = share * (df.agg(F.sum("source_size")).first()[0] or 0)
    while True:
        open_ = F.col("target").isNull()
        weights = df.filter(open_).agg(F.sum("weight")).first()[0]
        if not weights:
            return df
        limit, fair = most * F.col("source_size"), left * F.col("weight") / weights
        over = open_ & (fair > limit)
        n, size = df.agg(F.count_if(over), F.sum(F.when(over, limit))).first()
        if not n:
            return df.withColumn("target", F.coalesce("target", fair))
        df = stored(df.withColumn("target", F.when(over, limit).otherwise(F.col("target"))), "mixing")
        left -= size


def meet(rows: list[tuple[float, float]], chance: random.Random) -> tuple[list[float], int | None]:
    """Probabilities after all (size, probability) of rows, in order, have met, and the place of the one that stays open, if any."""
    x = [p for _, p in rows]
    now = None
    for j, (size, _) in enumerate(rows):
        if now is None:
            now = j
            continue
        other = rows[now][0]
        room, held = (1 - x[now]) * other, x[now] * other
        space, has = (1 - x[j]) * size, x[j] * size
        up, down = min(room, has), min(held, space)
        if chance.random() * (up + down) < down:  # now gains up, j gives it
            x[now] = 1.0 if up == room else min(x[now] + up / other, 1.0)
            x[j] = 0.0 if up == has else max(x[j] - up / size, 0.0)
        else:
            x[now] = 0.0 if down == held else max(x[now] - down / other, 0.0)
            x[j] = 1.0 if down == space else min(x[j] + down / size, 1.0)
        now = next((k for k in (now, j) if 0 < x[k] < 1), None)
    return x, now


def settle(sizes: np.ndarray, x: np.ndarray, left: int) -> None:
    """Rounds the row that is open to the nearer end; rows then turn over, that which brings the sum of words nearest first, as long
    as one brings it nearer."""
    owed = sizes[left] * x[left]
    x[left] = float(x[left] >= 0.5)
    owed -= sizes[left] * x[left]
    while True:
        turned = np.flatnonzero((x == (0.0 if owed > 0 else 1.0)) & (sizes < 2 * abs(owed)))
        if not len(turned):
            return
        best = turned[np.argmin(np.abs(sizes[turned] - abs(owed)))]
        x[best] = 1 - x[best]
        owed -= sizes[best] * (1 if x[best] else -1)


def _level(docs: DataFrame, level: int, last: bool) -> DataFrame:
    """The rows of docs (source_key, block, doc, size, whole, chance) after all of a block have met; open marks what is left, of the last level none."""

    def run(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values(["size", "doc"], ascending=[False, True], na_position="first", kind="stable").reset_index(drop=True)
        x, left = meet(list(zip(b["size"].tolist(), b["chance"].tolist())), random.Random(f"{level}|{key[0]}|{key[1]}"))
        x = np.array(x, float)
        if last and left is not None:
            settle(b["size"].to_numpy("float64"), x, left)
            left = None
        b["chance"] = x
        b["open"] = b.index == (-1 if left is None else left)
        return b

    names = ["source_key", "block", "doc", "size", "whole", "chance"]
    schema = "source_key string, block long, doc string, size long, whole long, chance double, open boolean"
    return docs.select(*names).groupBy("source_key", "block").applyInPandas(run, schema)


def rounded(docs: DataFrame) -> Iterator[DataFrame]:
    """docs (source_key, doc, size, whole, chance, n rows of the source) level by level with chance 0 or 1."""
    blocks = F.greatest(F.lit(1), F.ceil(F.col("n") / BLOCK)).cast("long")
    now = docs.withColumn("block", F.pmod(F.xxhash64("doc", "size"), blocks))
    most = docs.agg(F.max(blocks)).first()[0] or 1
    level = 0
    while True:
        met = stored(_level(now, level, most == 1), f"mixing{level}")
        yield met.filter("NOT open").drop("open", "block")
        if most == 1:
            return
        now = met.filter("open").drop("open").withColumn("block", F.expr(f"block div {BLOCK}"))
        most, level = -(-most // BLOCK), level + 1


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """doc_id, size, source_size, target, copies (how often the document is taken) and taken (its words in the mix)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    words = F.coalesce(F.size(F.filter(F.split("text", SPACE), lambda w: w != "")), F.lit(0)).cast("long")
    rows = docs.select(F.col("doc_id").cast("string").alias("doc"), "source", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("null")).alias("source_key"), F.when(F.col("text").isNull(), 0).otherwise(words).cast("long").alias("size"))
    alike = stored(rows.groupBy("source", "source_key", "doc", "size").agg(F.count("*").alias("same")), "mixing")
    sources = stored(alike.groupBy("source", "source_key").agg(F.sum("same").alias("n"), F.sum(F.col("size") * F.col("same")).alias("source_size")), "mixing")
    ranks = numbered(sources, [F.asc_nulls_last("source")], "place")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights)).cast("int") + 1)
    sources = stored(targets(ranks.withColumn("weight", weight), share, most).select("source_key", "n", "source_size", "target"), "mixing")
    got = looked_up(alike.drop("source"), sources, ["source_key"], "inner", FEW_SOURCES, F.col("doc"))
    times = F.coalesce(F.try_divide(F.col("target"), F.col("source_size")), F.lit(0.0))
    got = got.withColumn("whole", F.floor(times)).withColumn("rest", (times - F.floor(times)) * F.col("same"))
    got = got.withColumn("more", F.floor("rest")).withColumn("chance", F.col("rest") - F.floor("rest"))
    meets = (F.col("chance") > 0) & (F.col("size") > 0)
    one = ["source_key", "doc", "size"]
    open_ = got.filter(meets)
    sure = got.select(*one, F.col("whole").alias("copies"), (F.col("same") - F.col("more") - meets.cast("int")).alias("rows"))
    sure = sure.unionByName(got.select(*one, (F.col("whole") + 1).alias("copies"), F.col("more").alias("rows"))).filter("rows > 0")
    few = sure.filter(F.col("rows") <= COPIES).select(*one, "copies", F.explode(F.sequence(F.lit(1).cast("long"), "rows")))
    parts = sure.filter(F.col("rows") > COPIES).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1, F.lit(COPIES).cast("long"))).alias("at"))
    many = parts.repartition("doc", "at").select(*one, "copies", F.explode(F.sequence("at", F.least(F.col("at") + COPIES, F.col("rows")) - 1)))
    out = few.unionByName(many).drop("col")
    for level in rounded(open_):
        out = out.unionByName(level.select(*one, (F.col("whole") + F.col("chance")).cast("long").alias("copies")))
    out = looked_up(out, sources.drop("n"), ["source_key"], "inner", FEW_SOURCES, F.col("doc"))
    return out.select(F.col("doc").cast(kind).alias("doc_id"), "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def op12(docs: DataFrame) -> DataFrame:
    return mix(docs)
