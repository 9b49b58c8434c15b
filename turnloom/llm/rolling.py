"""Counts and order statistics over the past of each row, by source and time.

A row's window of W seconds holds all rows of its source with event_s - W <= their time < event_s, so
all rows of a source and time have the same windows.  Rows are first reduced to source, time, length,
language and a count (partial sums before the shuffle), so that repeated rows are one.

Each source is cut into chunks of ``CHUNK`` seconds.  A chunk gets its own rows and, as its halo, all
rows of the longest window before it: a row goes to 1 + W / CHUNK chunks, and no chunk needs another.
Chunks are dealt by range over the counts of rows, so a source that holds a third of all rows lies in as
many tasks as its share asks for.  What a task holds is the reduced rows of one chunk and its halo.

Inside a chunk, time is cut into blocks of at most W seconds.  A window in a block is the end of the W
seconds before the block and the beginning of the block.  Both are sorted once by length and kept as
linked lists: rows leave the older list; in the newer one, all rows are taken out from the last to the
first and put back in reverse.  For each rank a pointer in each list parts what lies below it; it moves by
as many places as the rank does.  Counts, sums and languages come from prefix sums and difference arrays.

Defined cases: null sources are one source.  A null id (or one whose time is beyond 64 bits) has no time:
its row lies in no window and its own windows are empty.  A null text has no length but counts as a row; an
empty one has length 0; very long texts count as a number.  Null languages count in no window's languages.
Repeated rows count each and are returned each.  An empty table gives no rows.  Further columns are dropped.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import crc_mod, joined_by_size, stored

WINDOWS = (1800, 86_400)
CHUNK = 21_600
#: Ranks as parts of a hundred: the median and the high value.
RANKS = (50, 99)
#: Seconds of a tick; times are multiples of it.
TICK = 60


class Live:
    """Rows in order of length as a linked list; rank pointers part what lies below them."""

    def __init__(self, n: int, ranks: int):
        self.next, self.prev, self.at = list(range(1, n + 2)) + [0], list(range(-1, n + 1)), [0] * ranks
        self.next[n], self.prev[0] = n, -1
        self.first = 0
        self.end = n

    def out(self, i: int) -> None:
        a, b = self.prev[i], self.next[i]
        self.prev[b] = a
        if a < 0:
            self.first = b
        else:
            self.next[a] = b

    def back(self, i: int) -> None:
        a, b = self.prev[i], self.next[i]
        self.prev[b] = i
        if a < 0:
            self.first = i
        else:
            self.next[a] = i


def ranked(old: tuple[list, list, list], new: tuple[list, list, list], ticks: list[int], window: int, ranks: tuple[int, ...] = RANKS) -> list[list]:
    """For each tick (ascending) and rank the length at that rank in the window, None where it is empty.  old and new are times
    (ascending), lengths and counts of the rows of the block before and of the block."""
    (told, lold, nold), (tnew, lnew, nnew) = old, new
    n_old, n_new = len(told), len(tnew)
    order = sorted(range(n_old + n_new), key=lambda i: (lold[i] if i < n_old else lnew[i - n_old], i))
    place, values, weights, global_ = ([0] * n_old, [0] * n_new), ([], []), ([], []), ([], [])
    for g, i in enumerate(order):
        side, row = (0, i) if i < n_old else (1, i - n_old)
        place[side][row] = len(values[side])
        values[side].append((lold, lnew)[side][row])
        weights[side].append((nold, nnew)[side][row])
        global_[side].append(g)
    far = n_old + n_new
    for side in (0, 1):
        global_[side].append(far)
    lists = (Live(n_old, len(ranks)), Live(n_new, len(ranks)))
    for row in reversed(range(n_new)):
        lists[1].out(place[1][row])
    for side in (0, 1):
        lists[side].at = [lists[side].first] * len(ranks)
    below = [0] * len(ranks)
    m, gone, come = sum(nold), 0, 0
    out = []
    old_, new_ = lists
    for q in ticks:
        while gone < n_old and told[gone] < q - window:
            i, w = place[0][gone], nold[gone]
            for k in range(len(ranks)):
                if i < old_.at[k]:
                    below[k] -= w
                elif i == old_.at[k]:
                    old_.at[k] = old_.next[i]
            old_.out(i)
            m -= w
            gone += 1
        while come < n_new and tnew[come] < q:
            i, w = place[1][come], nnew[come]
            g = global_[1][i]
            for k in range(len(ranks)):
                if g < min(global_[0][old_.at[k]], global_[1][new_.at[k]]):
                    below[k] += w
                elif i < new_.at[k]:
                    new_.at[k] = i
            new_.back(i)
            m += w
            come += 1
        if not m:
            out.append([None] * len(ranks))
            continue
        row = []
        for k, share in enumerate(ranks):
            rank = -(-share * m // 100)
            while below[k] >= rank:
                a, b = old_.prev[old_.at[k]], new_.prev[new_.at[k]]
                side, i = (0, a) if b < 0 or (a >= 0 and global_[0][a] > global_[1][b]) else (1, b)
                lists[side].at[k] = i
                below[k] -= weights[side][i]
            while True:
                a, b = old_.at[k], new_.at[k]
                side, i = (0, a) if global_[0][a] < global_[1][b] else (1, b)
                if below[k] + weights[side][i] >= rank:
                    break
                below[k] += weights[side][i]
                lists[side].at[k] = lists[side].next[i]
            row.append(values[side][i])
        out.append(row)
    return out


def features(rows: pd.DataFrame, begin: int, end: int, windows: tuple[int, ...] = WINDOWS) -> pd.DataFrame:
    """For each time of rows (event_s, length or null, lang, n) in [begin, end) and each window: the row of features.  rows hold
    all of their source from begin less the longest window on."""
    rows = rows.sort_values("event_s", kind="stable")
    times, n = rows["event_s"].to_numpy("int64"), rows["n"].to_numpy("int64")
    known = rows["length"].notna().to_numpy()
    lengths = pd.to_numeric(rows["length"]).fillna(0).to_numpy("int64")
    ticks = np.unique(times[(times >= begin) & (times < end)])
    count, chars = np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0], np.cumsum(lengths * n)])
    upto = np.searchsorted(times, ticks, "left")
    own = count[np.searchsorted(times, ticks, "right")] - count[upto]
    lang = pd.factorize(rows["lang"])[0]
    spoken = np.flatnonzero(lang >= 0)  # a row is heard until its window ends or its language comes again
    spoken = spoken[np.argsort(lang[spoken], kind="stable")]
    when, following = times[spoken], np.full(len(spoken), np.iinfo("int64").max)
    again = np.flatnonzero(lang[spoken][1:] == lang[spoken][:-1])
    following[again] = when[again + 1]
    kt, kl, kn = (x[known].tolist() for x in (times, lengths, n))
    out = []
    for w in windows:
        low = np.searchsorted(times, ticks - w, "left")
        heard = np.zeros(len(ticks) + 1, "int64")
        np.add.at(heard, np.searchsorted(ticks, when, "right"), 1)
        np.add.at(heard, np.searchsorted(ticks, np.minimum(when + w, following), "right"), -1)
        at = []
        step = min(w, end - begin)
        for b in range(begin, end, step):
            inside = ticks[(ticks >= b) & (ticks < b + step)].tolist()
            if inside:
                i, j, k = (bisect_left(kt, x) for x in (b - w, b, b + step))
                at += ranked((kt[i:j], kl[i:j], kn[i:j]), (kt[j:k], kl[j:k], kn[j:k]), inside, w)
        d = {"event_s": ticks, "window_s": w, "own": own, "n_events": count[upto] - count[low], "sum_chars": chars[upto] - chars[low], "n_langs": np.cumsum(heard)[:-1]}
        for k, c in enumerate(("median_chars", "high_chars")):
            d[c] = pd.array([r[k] for r in at], dtype="Int64")
        out.append(pd.DataFrame(d))
    return pd.concat(out, ignore_index=True)


def timed(docs: DataFrame) -> DataFrame:
    """doc_id, source_key, event_s, length and lang of each row."""
    x = F.try_add(F.col("doc_id").cast("long"), crc_mod(F.col("doc_id"), 1000))
    at = F.try_multiply(F.lit(TICK).cast("long"), F.expr("(x - pmod(x, 6)) div 6"))
    df = docs.select("doc_id", x.alias("x"), F.coalesce(F.concat(F.lit("s"), "source"), F.lit("null")).alias("source_key"), F.length("text").cast("long").alias("length"), F.col("lang").cast("string").alias("lang"))
    return df.select("doc_id", "source_key", at.alias("event_s"), "length", "lang")


def rolling(rows: DataFrame, windows: tuple[int, ...] = WINDOWS, chunk: int = CHUNK) -> DataFrame:
    """source_key, event_s, window_s, own (rows of that source and time) and features, of rows (source_key, event_s, length, lang)."""
    alike = rows.groupBy("source_key", "event_s", "length", "lang").agg(F.count("*").alias("n"))
    place = lambda t: F.expr(f"({t} - pmod({t}, {chunk})) div {chunk}")
    cut = alike.withColumn("chunk", F.explode(F.sequence(place("event_s"), place(f"(event_s + {max(windows)})"))))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        begin = int(key[1]) * chunk
        got = features(b, begin, begin + chunk, windows)
        got.insert(0, "source_key", key[0])
        return got

    schema = "source_key string, event_s long, window_s long, own long, n_events long, sum_chars long, n_langs long, median_chars long, high_chars long"
    return cut.repartitionByRange(parts, "source_key", "chunk").groupBy("source_key", "chunk").applyInPandas(run, schema)


def op13(docs: DataFrame) -> DataFrame:
    rows = stored(timed(docs), "rolling")
    key = F.concat("source_key", F.lit("|"), F.col("event_s").cast("string")).alias("key")
    got = stored(rolling(rows.filter("event_s IS NOT NULL")).select(key, F.col("own").alias("n"), "window_s", "n_events", "sum_chars", "n_langs", "median_chars", "high_chars"), "rolling")
    names = ["n_events", "sum_chars", "n_langs", "median_chars", "high_chars"]
    out = ["doc_id", "window_s", "event_s", *names]
    found = joined_by_size(rows.filter("event_s IS NOT NULL").select("doc_id", "event_s", key), got, "key").select(*out)
    none = [F.lit(v).cast("long").alias(c) for c, v in zip(names, (0, 0, 0, None, None))]
    timeless = rows.filter("event_s IS NULL").select("doc_id", F.explode(F.array(*[F.lit(w).cast("long") for w in WINDOWS])).alias("window_s"), "event_s", *none)
    return found.unionByName(timeless)
