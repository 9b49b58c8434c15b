"""Substring deduplication by sliding sentence spans.

A text is cut after words that end in ".", "!" or "?", at line ends, and, where ``WINDOW``
words in a row hold no such end, after the one of them with the least CRC (the last of equal
ones): winnowing, so a cut depends on the ``WINDOW`` - 1 words on each side of it alone and
two cuts are ``WINDOW`` words apart at most.  At each sentence, as the parts are called here,
begins one span: the shortest run of at least two sentences with at least 15 words.  Of a
passage of 49 words that stands anywhere in two texts, the cuts after its words 9 to 40 are
the same in both (its last word may be a line end in one); the first of these is after word
17 at the latest, and a span that begins there ends 23 words later at the latest.  So the
passage holds a whole span, wherever it begins and ends.  Spans are hashed (96 bits, white
space within lines made even), and the hashes meet in one global shuffle, where each span
but the first of its kind, by doc_id, text hash and place, is found.  The sentences that those
cover are removed.

Only hashes and places are shuffled, once; the texts are, once, for the removal, where only those
with a covered sentence go to Python.  Hot spans, which would meet in one task, stay out of that
shuffle: tasks that each see a million spans or more, however small the files are, name those that they
see ``NAMED`` times in a million; of all named, those that make up more than 1/100,000 of all spans (so
100,000 at most, which are broadcast) are summed to their first places, in each task first, and all
others of them are not the first.  So a task gets 1/100,000 of all spans for one span, or little more.

Defined cases: a null or empty text has no sentences and stays.  A very long text is one row with
an array of hashes.  Rows with one doc_id and one text are one document: each gets its result.  Rows with a null doc_id come first in order.
Further columns stay (``dedup``).
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import arrow_batches, stored

LEAST_WORDS, LEAST_SENTENCES, WINDOW = 15, 2, 9
#: A span is hot if it makes up more than this share of all spans and LEAST rows; tasks name those they see so often in CHUNK spans.
HOT, LEAST, NAMED = 1 / 100_000, 1000, 8
CHUNK = 1 << 20
#: Values of words that a process keeps, those that it sees first: frequent ones are among them.
KNOWN = 200_000
_WORD = re.compile(r"\S+")


class Values(dict):
    """What winnowing compares, by word: 0 for an end of a sentence."""

    def __missing__(self, word: str) -> int:
        got = 0 if word[-1] in ".!?" else 1 + (crc32(word.encode("utf-8", "surrogatepass")) >> 2)
        if len(self) < KNOWN and len(word) < 64:
            self[word] = got
        return got


_values = Values()


def cut(text: str | None) -> tuple[list[str], list[int], list[tuple[int, int]]]:
    """The words, and of each sentence its first word and its start and end in the text."""
    text = text or ""
    words = text.split()
    if not words:
        return [], [], []
    sizes = list(map(len, words))
    if sum(sizes) + len(words) - 1 == len(text):  # one character in each gap
        at = list(accumulate((n + 1 for n in sizes), initial=0))
        to = [a + n for a, n in zip(at, sizes)]
        lines, i = [], text.find("\n")
        while i >= 0:
            lines.append(bisect_left(to, i))
            i = text.find("\n", i + 1)
    else:
        spots = [m.span() for m in _WORD.finditer(text)]
        at, to = [a for a, _ in spots], [b for _, b in spots]
        lines = [k for k in range(len(words) - 1) if "\n" in text[to[k] : at[k + 1]]]
    v = np.fromiter(map(_values.__getitem__, words), np.int64, len(words))
    v[lines] = 0
    v[-1] = 0
    stop = v == 0
    if len(v) >= WINDOW:
        key = (v << 32) - np.arange(len(v))  # of equal values the last is the least
        least = key
        for k in (1, 2, 4, WINDOW - 8):
            least = np.minimum(least[:-k], least[k:])
        stop[-least & 0xFFFFFFFF] = True
    stops = np.flatnonzero(stop).tolist()
    heads = [0, *(e + 1 for e in stops[:-1])]
    return words, heads, [(at[s], to[e]) for s, e in zip(heads, stops)]


def sentences(text: str | None) -> list[tuple[int, int]]:
    """Starts and ends, without white space around."""
    return cut(text)[2]


def ends(words: list[int]) -> list[int]:
    """The ends of the spans that begin at the first sentences, in order; words: of each sentence."""
    out, j, n = [], 0, 0
    for i in range(len(words)):
        while j < len(words) and (n < LEAST_WORDS or j - i < LEAST_SENTENCES):
            n += words[j]
            j += 1
        if n < LEAST_WORDS or j - i < LEAST_SENTENCES:
            break
        out.append(j)
        n -= words[i]
    return out


def hashes(text: str | None) -> tuple[np.ndarray, np.ndarray, int]:
    """Two parts of the hash of each span (the spans begin at the sentences 0, 1, 2 ...), and how many sentences there are."""
    from xxhash import xxh3_64_digest, xxh3_128_digest

    words, heads, _ = cut(text)
    tails = [*heads[1:], len(words)]
    codes = [xxh3_64_digest(" ".join(words[s:e]).encode("utf-8", "surrogatepass")) for s, e in zip(heads, tails)]
    joined = b"".join(codes)
    digests = b"".join([xxh3_128_digest(joined[8 * i : 8 * j]) for i, j in enumerate(ends([e - s for s, e in zip(heads, tails)]))])
    h = np.frombuffer(digests, ">u8").reshape(-1, 2)
    low = (h[:, 1].astype(np.uint64) ^ np.uint64(1 << 63)).view(np.int64)
    return low, ((h[:, 0] >> np.uint64(32)).astype(np.int64) - (1 << 31)).astype(np.int32), len(heads)


def runs(text: str | None) -> tuple[list[tuple[int, int]], int]:
    """``hashes`` as pairs of numbers."""
    a, b, n = hashes(text)
    return list(zip(a.tolist(), b.tolist())), n


def spans(docs: DataFrame) -> DataFrame:
    """doc_id, h (hash of the text), r: n (sentences) and arrays a, b (the hash of the span that begins at each sentence)."""
    arrow_batches(docs.sparkSession)

    @F.pandas_udf("n int, a array<long>, b array<int>")
    def found(texts: pd.Series) -> pd.DataFrame:
        a, b, n = zip(*map(hashes, texts)) if len(texts) else ((), (), ())
        return pd.DataFrame({"n": pd.Series(n, dtype="int32"), "a": pd.Series(a, dtype=object), "b": pd.Series(b, dtype=object)})

    return docs.select("doc_id", F.xxhash64("text").alias("h"), found("text").alias("r"))


def hot_spans(found: DataFrame) -> DataFrame:
    """The values of a that are too frequent to meet in one task; 1 / HOT rows at most."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0

        def named():
            own, n = np.unique(np.concatenate(held), return_counts=True)
            kept = n >= min(NAMED, max(2, NAMED * size // CHUNK))  # a last part that is smaller names as many as its size asks for
            return pd.DataFrame({"a": own[kept], "n": n[kept]})

        for b in batches:
            for x in b["a"]:
                held.append(np.asarray(x, np.int64))
                size += len(x)
            if size >= CHUNK:
                yield named()
                held, size = [], 0
        if size:
            yield named()

    total = found.agg(F.sum(F.size("r.a"))).first()[0] or 0
    got = found.select("r.a").coalesce(max(1, total // (2 * CHUNK))).mapInPandas(run, "a long, n long").groupBy("a").agg(F.sum("n").alias("n"))
    return stored(got.filter(F.col("n") > max(total * HOT, LEAST)).select("a"), "hot-spans")


def covered(docs: DataFrame) -> DataFrame:
    """doc_id, h, n (sentences), cover (the sentences where spans begin that are not the first of their kind; null without
    any): a row for each document."""
    found = stored(spans(docs), "spans")
    hot = F.broadcast(hot_spans(found))
    rows = found.select("doc_id", "h", F.posexplode(F.arrays_zip("r.a", "r.b")).alias("i", "x")).select("doc_id", "h", "i", "x.a", "x.b")
    order = Window.partitionBy("a", "b").orderBy("doc_id", "h", "i")
    later = rows.join(hot, "a", "left_anti").withColumn("rank", F.dense_rank().over(order)).filter("rank > 1").select("doc_id", "h", "i")
    if not hot.isEmpty():
        own, place = rows.join(hot, "a"), F.struct("doc_id", "h", "i")
        first = own.groupBy("a", "b").agg(F.min(place).alias("first"))  # one for each hot span
        later = later.unionByName(own.join(F.broadcast(first), ["a", "b"]).filter(~place.eqNullSafe(F.col("first"))).select("doc_id", "h", "i"))
    # a document's own row and its places meet by the document
    both = found.select("doc_id", "h", F.col("r.n").alias("n"), F.lit(None).cast("int").alias("i")).unionByName(later.withColumn("n", F.lit(None).cast("int")), allowMissingColumns=True)
    return both.groupBy("doc_id", "h").agg(F.max("n").alias("n"), F.collect_set("i").alias("cover")).withColumn("cover", F.when(F.size("cover") > 0, F.col("cover")))


def removed(text: str, cover: list) -> tuple[str, int]:
    """The text left without the spans that begin at the sentences of cover, and how many sentences went."""
    words, heads, at = cut(text)
    gone, end = set(), ends([e - s for s, e in zip(heads, [*heads[1:], len(words)])])
    for i in cover:
        gone.update(range(i, end[i]))
    out = [text[s : at[k + 1][0] if k + 1 < len(at) else len(text)] for k, (s, _) in enumerate(at) if k not in gone]
    return "".join(out).rstrip(), len(gone)


def dedup(docs: DataFrame) -> DataFrame:
    """docs with the text that is left, n_sentences and n_removed."""
    arrow_batches(docs.sparkSession)
    cover = covered(docs).select(F.col("doc_id").alias("__id"), F.col("h").alias("__h"), F.col("n").alias("__n"), F.col("cover").alias("__cover"))
    df = docs.drop("n_sentences", "n_removed").withColumn("__hash", F.xxhash64("text"))
    df = df.join(cover, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__hash") == F.col("__h")), "left")

    @F.pandas_udf("text string, n long")
    def left(texts: pd.Series, covers: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(None, 0) if c is None else removed(t, c) for t, c in zip(texts, covers)], columns=["text", "n"])

    df = df.withColumn("__r", left(F.when(F.col("__cover").isNotNull(), F.col("text")), "__cover"))
    text = F.when(F.col("__cover").isNull(), F.col("text")).otherwise(F.col("__r.text"))
    keep = [text.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns if c not in ("n_sentences", "n_removed")]
    return df.select(*keep, F.col("__n").cast("long").alias("n_sentences"), F.col("__r.n").alias("n_removed"))


def op2(docs: DataFrame) -> DataFrame:
    return dedup(docs.select("doc_id", "text")).select("doc_id", "n_sentences", "n_removed", "text")
