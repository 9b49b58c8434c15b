"""Which of a set of items stand verbatim in which texts: equality joins on hashes, then ``contains``.

An item of three words or more (between white space) has inner words, which are whole words of
any text that holds it, and stand there side by side.  Of 2c - 1 words side by side, c stand in
one of the chunks of c words that a text is cut into.  So a text is looked up by the hashes of
its chunks (c is 1, 2, 4 or 8), an item by those of the c runs of c words at its head.  Shorter
items are looked up by the first characters of their longest word among the pieces of as many
characters of a text's words, items of white space by their first character.  What is found is
verified.  No text is looked up by a prefix alone and nothing is left out.

Hashes of a text go on with its id and its own hash, never with the text, so work is linear in the
length of a text.  Items of at most ``BROADCAST_BYTES`` are broadcast, else (item, text hash) pairs are
joined on salted hashes.  The texts found are joined back to be verified: the pairs found are broadcast with
their items up to as many bytes, beyond that both sides are dealt by id and hash.

Defined cases: null texts and null items match nothing, an empty item stands in each text that
is not null.  Repeated rows give one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import stored

CLASSES = (1, 2, 4, 8)
GRAM = 4
BROADCAST_BYTES = 32 << 20
SALTS = 16


def _words(text: Column) -> Column:
    return F.split(text, r"\s+")


def _keyed(items: DataFrame) -> DataFrame:
    """item_id, item, kind (a class, 0 for empty, -1 for white space, -1 - n for grams of n) and h, one row for each key."""
    w = _words(F.col("item"))
    df = items.withColumn("__edge", w).withColumn("__inner", F.slice(w, 2, F.greatest(F.size(w) - 2, F.lit(0))))
    n = F.size("__inner")
    kind = F.lit(None).cast("int")
    for c in reversed(CLASSES):
        kind = F.coalesce(kind, F.when(n >= 2 * c - 1, c))
    longest = F.array_max(F.transform("__edge", lambda x: F.struct(F.length(x).alias("n"), x.alias("x"))))
    df = df.withColumn("__longest", longest)
    short = F.when(F.col("item") == "", 0).when(F.col("__longest.n") == 0, -1).otherwise(-1 - F.least(F.col("__longest.n"), F.lit(GRAM)))
    df = df.withColumn("kind", F.coalesce(kind, short).cast("int"))
    head = F.when(F.col("kind") < -1, F.substring(F.col("__longest.x"), F.lit(1), -1 - F.col("kind"))).when(F.col("kind") == -1, F.substring("item", 1, 1)).otherwise("")
    runs = F.transform(F.sequence(F.lit(1), F.col("kind")), lambda i: F.xxhash64("kind", F.slice("__inner", i, F.col("kind"))))
    keys = F.when(F.col("kind") > 0, runs).otherwise(F.array(F.xxhash64("kind", head)))
    return df.select("item_id", "item", "kind", F.explode(F.array_distinct(keys)).alias("h"))


def _hashes(kind: int, values: Column) -> Column:
    return F.transform(values, lambda x: F.xxhash64(F.lit(kind), x))


def _chunks(words: Column, size: int) -> Column:
    """Words cut into whole chunks."""
    last = F.floor(F.size(words) / size).cast("int") - 1
    at = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.slice(words, i * size + 1, size))


def _grams(words: Column, size: int) -> Column:
    pattern = F.lit(rf"(?s)(?=(.{{{size}}}))")
    return F.array_distinct(F.flatten(F.transform(F.array_distinct(words), lambda w: F.regexp_extract_all(w, pattern, F.lit(1)))))


def _looked_up(text: Column, words: Column, kinds: list[int]) -> Column:
    """The hashes under which a text may find items of these kinds."""
    empty, space = F.array(F.lit("")), F.array_distinct(F.regexp_extract_all(text, F.lit(r"(\s)"), F.lit(1)))
    found = [_chunks(words, k) if k > 0 else empty if k == 0 else space if k == -1 else _grams(words, -1 - k) for k in kinds]
    return F.concat(*map(_hashes, kinds, found))


def contained(docs: DataFrame, items: DataFrame, doc_id: str, item_id: str, text: str = "text", limit: int = BROADCAST_BYTES) -> DataFrame:
    """doc_id, item_id: the items whose text stands in the text of a document."""
    items = _keyed(items.filter(F.col(text).isNotNull()).select(F.col(item_id).alias("item_id"), F.col(text).alias("item")).distinct())
    size = items.agg(F.coalesce(F.sum(F.octet_length("item") + 64), F.lit(0)).alias("bytes"), F.sort_array(F.collect_set("kind")).alias("kinds")).first()
    d = docs.filter(F.col(text).isNotNull()).select(F.col(doc_id).alias("__id"), F.col(text).alias("__text"))
    if not size["kinds"]:
        return d.limit(0).select(F.col("__id").alias(doc_id), F.lit(None).cast(items.schema["item_id"].dataType).alias(item_id))
    looked = _looked_up(F.col("__text"), F.col("__words"), size["kinds"])
    keys = d.withColumn("__words", _words(F.col("__text"))).select("__id", F.xxhash64("__text").alias("__hash"), F.explode(F.array_distinct(looked)).alias("h"))
    ids = items.select("item_id", "h").distinct()
    if size["bytes"] <= limit:
        pairs = keys.join(F.broadcast(ids), "h")
    else:
        salted = ids.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        pairs = keys.withColumn("salt", F.pmod(F.xxhash64("__id", "__hash"), F.lit(SALTS)).cast("int")).join(salted, ["h", "salt"])
    pairs = stored(pairs.select(F.col("__id").alias("__of"), "__hash", "item_id").distinct(), "contained")
    texts = items.select("item_id", "item").distinct()
    # by id, as an id may have several texts: each is tried
    found = pairs.join(F.broadcast(texts) if size["bytes"] <= limit else texts, pairs["item_id"].eqNullSafe(texts["item_id"])).select("__of", "__hash", pairs["item_id"], "item")
    few = limit >= 0 and found.agg(F.coalesce(F.sum(F.octet_length("item") + 64), F.lit(0))).first()[0] <= limit
    on = F.col("__id").eqNullSafe(F.col("__of")) & (F.xxhash64("__text") == F.col("__hash"))
    got = d.join(F.broadcast(found) if few else found, on)
    return got.filter(F.contains("__text", "item")).select(F.col("__id").alias(doc_id), F.col("item_id").alias(item_id)).distinct()
