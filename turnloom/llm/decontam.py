"""Benchmark decontamination by a broadcast hash set of benchmark word windows (native).

A text's words are runs of ASCII letters and digits or of code points from U+0080; A-Z are
lower-cased.  A benchmark item gives all windows of 13 consecutive words; a shorter item, if
it has words, is one window.  A document word inside any occurrence of a window is hit.

Every occurrence of a window of L words covers one whole chunk of k = (L + 1) // 2 document
words that starts at a multiple of k.  So the scan hashes only those chunks, a hash for each
k words, and joins them with the hashes of all runs of k words of the windows.  A chunk goes on with
the text's own hash (96 bits) and its place, never with words, so work is linear in the length of a text.

Places found are gathered by text, once for all its copies.  The texts that have some are read again,
one of each, and the windows around the places are joined, as strings, with the benchmark's.

The chunk hashes are broadcast, ``BROADCAST_CHUNKS`` at a time: a benchmark with more of them (some
two million words) takes a pass over the documents for each such part.  So the plan is the same
at any size.  Windows are broadcast up to ``BROADCAST_WINDOWS``, else the windows found are joined with
them on salted keys.  Hits are kept by text and joined back to the documents: broadcast up to
``BROADCAST_HITS`` (words hit, or texts), else on salted keys.

Defined cases: a null or empty text has no words and is never hit.  A very long text is one row
with an array of its words; time grows with its length.  Null item ids name no item, repeated ids one.  Repeated document
rows each give a row.  Further columns are dropped (``clean`` keeps all).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import ascii_lower, looked_up, merged, stored

WINDOW = 13
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Of a text as it is, before A-Z are lower-cased.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
REST = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*"
#: Most chunk hashes (about 60 bytes each in a hash set), windows (about 150) and words hit or texts that are broadcast at once.
BROADCAST_CHUNKS, BROADCAST_WINDOWS, BROADCAST_HITS = 2_000_000, 500_000, 1_000_000


def words(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS), lambda x: x != "")


def _runs(n: Column, length: int) -> Column:
    """Starts, from 0, of the runs of so many words among n."""
    return F.when(n >= length, F.sequence(F.lit(0), n - length)).otherwise(F.array().cast("array<int>"))


def _texts(array: Column, starts: Column, length: int) -> Column:
    return F.transform(starts, lambda s: F.array_join(F.slice(array, s + 1, length), " "))


def windows(bench: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item_id string, length int, window string), distinct."""
    w = bench.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("w")).withColumn("n", F.size("w"))
    short = w.filter(f"n between 1 and {window - 1}").select("item_id", F.col("n").alias("length"), F.array_join("w", " ").alias("window"))
    full = w.filter(F.col("n") >= window).select("item_id", F.lit(window).alias("length"), F.explode(_texts(F.col("w"), _runs(F.col("n"), window), window)).alias("window"))
    return short.unionByName(full).distinct()


def _chunk_runs(wins: DataFrame) -> DataFrame:
    """(length, h): the hashes of all runs of k words of the windows."""
    runs = F.transform(F.sequence(F.lit(0), F.col("length") - F.col("k")), lambda s: F.xxhash64("length", F.slice("w", s + 1, F.col("k"))))
    return wins.select("length", F.split("window", " ").alias("w"), F.expr("(length + 1) div 2").cast("int").alias("k")).select(F.explode(runs).alias("h")).distinct()


def _text_key() -> list[Column]:
    """96 bits of a text, null as empty: what its hits are found by."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return [F.xxhash64(text).alias("a"), F.hash(text, F.lit(7)).alias("b")]


def _aligned(length: int) -> Column:
    """(l, i, h) of the whole chunks of the words w."""
    k = (length + 1) // 2
    return F.expr(f"transform(if(size(w) >= {length}, sequence(0, size(w) div {k} - 1), cast(array() as array<bigint>)), i -> struct({length} as l, int(i * {k}) as at, xxhash64({length}, slice(w, int(i * {k} + 1), {k})) as h))")


def hits(docs: DataFrame, bench: DataFrame, window: int = WINDOW, limits: tuple[int, int] | None = None) -> DataFrame:
    """a, b (of the text), n (its words), hit (sorted positions of words that are hit), items (sorted): texts with a hit,
    once each.  limits: of chunk hashes and of windows that are broadcast at once."""
    most_chunks, most_windows = limits or (BROADCAST_CHUNKS, BROADCAST_WINDOWS)
    wins = stored(windows(bench, window), "decontam-windows")
    lengths = sorted(r["length"] for r in wins.select("length").distinct().collect())
    nothing = "a long, b int, n int, hit array<int>, items array<string>"
    if not lengths:
        return docs.sparkSession.createDataFrame([], nothing)
    chunks = stored(_chunk_runs(wins), "decontam-chunks")
    items = stored(wins.groupBy("window").agg(F.collect_set("item_id").alias("ids")), "decontam-items")
    scan = docs.select(*_text_key(), words(F.col("text")).alias("w"))
    scan = scan.select("a", "b", F.explode(F.concat(*map(_aligned, lengths))).alias("c")).select("a", "b", F.col("c.l").alias("l"), F.col("c.at").alias("at"), F.col("c.h").alias("h"))
    passes = -(-chunks.count() // most_chunks)
    found = reduce(DataFrame.unionByName, [scan.join(F.broadcast(chunks.filter(F.pmod("h", F.lit(passes)) == p)), "h", "left_semi") for p in range(passes)])
    places = stored(found.groupBy("a", "b").agg(F.collect_set(F.struct("l", "at")).alias("c")), "decontam-places")
    texts = looked_up(docs.select(*_text_key(), "text", F.monotonically_increasing_id().alias("row")), places.select("a", "b"), ["a", "b"], "left_semi", BROADCAST_HITS, F.col("row"))
    texts = texts.select("a", "b", "text").dropDuplicates(["a", "b"]).join(merged(places), ["a", "b"]).select("a", "b", "c", words(F.col("text")).alias("w"))
    first, last = "greatest(0, c.at + (c.l + 1) div 2 - c.l)", "least(c.at, size(w) - c.l)"
    around = F.expr(f"flatten(transform(c, c -> if({last} >= {first}, transform(sequence(int({first}), int({last})), s -> struct(s, c.l as l, array_join(slice(w, s + 1, c.l), ' ') as window)), array())))")
    spread = texts.select("a", "b", F.size("w").alias("n"), F.explode(F.array_distinct(around)).alias("x")).select("a", "b", "n", "x.s", "x.l", "x.window")
    hit = looked_up(spread, items, ["window"], "inner", most_windows, F.struct("a", "s"))
    by_text = hit.groupBy("a", "b", "n").agg(F.collect_set(F.struct("s", "l")).alias("x"), F.array_distinct(F.flatten(F.collect_set("ids"))).alias("items"))
    return by_text.select("a", "b", "n", F.array_sort(F.array_distinct(F.flatten(F.transform("x", lambda x: F.sequence(x["s"], x["s"] + x["l"] - 1))))).alias("hit"), F.array_sort("items").alias("items"))


def contaminated() -> Column:
    return (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words"))


def report(docs: DataFrame, bench: DataFrame, window: int = WINDOW, limits: tuple[int, int] | None = None) -> DataFrame:
    """A row for each document: doc_id, n_words, n_hit, items (sorted array of strings), contaminated."""
    found = stored(hits(docs, bench, window, limits), "decontam-hits")
    n = F.size(words(F.col("text"))).cast("long")
    words_hit = found.agg(F.coalesce(F.sum(F.size("hit") + F.size("items")), F.lit(0))).first()[0]
    rows = docs.select("doc_id", n.alias("n_words"), *_text_key(), F.monotonically_increasing_id().alias("row"))
    rows = looked_up(rows, found.select("a", "b", "hit", "items"), ["a", "b"], "left", BROADCAST_HITS if words_hit <= BROADCAST_HITS else -1, F.col("row"))
    out = rows.select("doc_id", "n_words", F.coalesce(F.size("hit"), F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    return out.withColumn("contaminated", contaminated())


def clean(docs: DataFrame, bench: DataFrame, mode: str = "documents", window: int = WINDOW, limits: tuple[int, int] | None = None) -> DataFrame:
    """docs without contaminated documents (mode "documents"), or with the hit words and what
    follows them up to the next word cut from contaminated texts (mode "spans"); columns stay."""
    if mode not in ("documents", "spans"):
        raise ValueError(mode)
    bad = stored(hits(docs, bench, window, limits).filter(F.size("hit") * 20 >= F.col("n")).select("a", "b", *(["hit"] if mode == "spans" else [])), "decontam-bad")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__doc"), "text", *_text_key(), F.monotonically_increasing_id().alias("row"))
    if mode == "documents":
        return looked_up(rows, bad, ["a", "b"], "left_anti", BROADCAST_HITS, F.col("row")).select("__doc.*")
    words_hit = bad.agg(F.coalesce(F.sum(F.size("hit")), F.lit(0))).first()[0]
    rows = looked_up(rows, bad, ["a", "b"], "left", BROADCAST_HITS if words_hit <= BROADCAST_HITS else -1, F.col("row"))
    pieces = F.regexp_extract_all("text", F.lit(WORD + REST), F.lit(0))
    keep = F.array_except(F.sequence(F.lit(0), F.size(pieces) - 1), "hit")
    left = F.concat(F.regexp_extract("text", "^" + REST, 0), F.array_join(F.transform(keep, lambda i: F.get(pieces, i)), ""))
    text = F.when(F.col("hit").isNotNull(), left).otherwise(F.col("text"))
    return rows.select(*[text.alias("text") if c == "text" else F.col(f"__doc.`{c}`").alias(c) for c in docs.columns])


def op3(docs: DataFrame, bench: DataFrame) -> DataFrame:
    return report(docs, bench).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated"
    )
