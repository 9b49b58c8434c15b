"""Quality classifier on supervised subword embeddings.

A text's features are its words (between white space), the character n-grams of 3 to 5 code
points inside a word, the ends of the word counting as characters, and, in one bucket, pairs
of one word twice in succession; each is hashed to a bucket that has a learned vector.  A document is the mean of its features' vectors, and a softmax
over two classes follows.  Both are trained by stochastic gradient descent in numpy.

Training takes at most ``sample`` labelled documents, those with the smallest hashes of their
ids, and their whole texts; their feature counts are made on the executors.  As the document
vector is a mean, a feature adds vector . (w1 - w0) to the score, one number for each bucket:
that table (``BUCKETS`` numbers) is what scoring needs, and scoring is one pass without a
shuffle.  Texts are hashed in blocks of code points, so a long one needs no more memory.

Defined cases: a null or empty text has no features and gets the score of the intercept.
Labels that are null are not learned from, nor are
rows with a null doc_id, which are not held out; of several labels of one id the largest counts, of
several texts the least; without labels of both classes the score is the
share of class 1 (0.5 without labels).  Repeated rows each give a row.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import arrow_batches, crc_mod

BUCKETS = 1 << 17
DIM = 12
SAMPLE = 5000
EPOCHS = 6
#: Few labels are gone through more often, until there are as many steps.
STEPS = 600
BATCH = 50
RATE = 60.0
THRESHOLD = 0.3
#: Code points that are hashed at once; longer words are cut there.
BLOCK = 1 << 19
_MARK = 1
_BASE = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = []


def _word_powers() -> list[np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64, for prefix hashes."""
    if not _powers:
        inverse = pow(_BASE, -1, 1 << 64)
        for b in (_BASE, inverse):
            x = np.full(2 * BLOCK + 16, b, np.uint64)
            x[0] = 1
            _powers.append(np.cumprod(x))
    return _powers


def _mix(h: np.ndarray, kind: int) -> np.ndarray:
    h = (h + np.uint64(kind)) * np.uint64(0xFF51AFD7ED558CCD)
    return ((h >> np.uint64(40)) % np.uint64(BUCKETS - 1)).astype(np.int32)


def _hashed(cp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and buckets of the features of code points that begin and end with a mark."""
    mark = cp == _MARK
    marks = np.concatenate(([0], np.cumsum(mark)))
    x = cp.astype(np.uint64)
    where, what = [], []
    grams = x.copy()
    for n in range(2, 6):
        grams = grams[:-1] * np.uint64(0x100000001B3) + x[n - 1 :]
        if n > 2:
            m = len(grams)
            if m <= 0:
                break
            inner = marks[n - 1 : n - 1 + m] - marks[1 : 1 + m]
            at = np.flatnonzero(inner == 0)
            where.append(at)
            what.append(_mix(grams[at], n))
    ends = np.flatnonzero(mark)
    start, stop = ends[:-1] + 1, ends[1:]
    some = stop > start
    start, stop = start[some], stop[some]
    up, down = _word_powers()
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(x * up[: len(x)])))
    word = (sums[stop] - sums[start]) * down[start]
    where.append(start)
    what.append(_mix(word, 1))
    twice = start[1:][word[1:] == word[:-1]]
    where.append(twice)
    what.append(np.full(len(twice), BUCKETS - 1, np.int32))
    return np.concatenate(where), np.concatenate(what)


def blocks(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, bucket) of all features of texts, block by block."""
    parts, rows, size = [], [], 0

    def flush():
        cp = np.concatenate([*parts, [_MARK]]).astype(np.uint32)
        owner = np.concatenate(rows)
        cp[(cp == 32) | ((cp >= 9) & (cp <= 13))] = _MARK
        at, what = _hashed(cp)
        return owner[np.minimum(at, len(owner) - 1)], what

    for k, t in enumerate(texts):
        if not t:
            continue
        cp = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)
        for i in range(0, len(cp), BLOCK):
            part = cp[i : i + BLOCK]
            parts += [np.array([_MARK], np.uint32), part]
            rows.append(np.full(len(part) + 1, k, np.int64))
            size += len(part)
            if size >= BLOCK:
                yield flush()
                parts, rows, size = [], [], 0
    if parts:
        yield flush()


def counts(docs: DataFrame) -> DataFrame:
    """label and packed feature counts for rows with label and text."""
    arrow_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(label, pack([what for _, what in blocks([text])])) for label, text in zip(b["label"], b["text"])], columns=["label", "features"])

    return docs.select("label", "text").mapInPandas(run, "label int, features binary")


def pack(parts: list[np.ndarray]) -> bytes:
    """The buckets in parts and how often each occurs, small enough for thousands of texts on the driver."""
    own, n = np.unique(np.concatenate(parts) if parts else np.zeros(0, np.int32), return_counts=True)
    return zlib.compress(np.diff(own, prepend=0).astype("<i4").tobytes() + n.astype("<i4").tobytes(), 1)


def unpack(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The buckets and the share of each."""
    own, n = np.frombuffer(zlib.decompress(packed), "<i4").reshape(2, -1)
    return np.cumsum(own, dtype=np.int32), (n / max(n.sum(), 1)).astype(np.float32)


def train(rows: list[tuple[int, bytes]], seed: int = 7, epochs: int = EPOCHS, rate: float = RATE) -> tuple[np.ndarray, float]:
    """What each bucket adds to the log-odds of class 1, and the intercept."""
    y = np.array([r[0] for r in rows], np.float32)
    mean = float(y.mean()) if len(y) else 0.5
    prior = float(np.log((mean + 1e-3) / (1 - mean + 1e-3)))
    if not len(y) or not 0 < mean < 1:
        return np.zeros(BUCKETS, np.float32), prior
    rng = np.random.default_rng(seed)
    table = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    w = rng.normal(0, 0.1, (DIM, 2)).astype(np.float32)
    bias = np.array([-prior / 2, prior / 2], np.float32)
    each = -(-len(rows) // BATCH)
    epochs = max(epochs, -(-STEPS // each))
    steps, done = epochs * each, 0
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for k in range(0, len(order), BATCH):
            feats = {i: unpack(rows[i][1]) for i in order[k : k + BATCH]}  # unpacked for a batch at a time
            pick = [i for i, f in feats.items() if len(f[0])]
            if not pick:
                continue
            idx = np.concatenate([feats[i][0] for i in pick])
            x = np.concatenate([feats[i][1] for i in pick])
            n = np.array([len(feats[i][0]) for i in pick])
            starts = np.concatenate(([0], np.cumsum(n)[:-1]))
            doc = np.add.reduceat(table[idx] * x[:, None], starts, axis=0)
            z = doc @ w + bias
            z -= z.max(axis=1, keepdims=True)
            p = np.exp(z)
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(pick)), y[pick].astype(int)] -= 1
            lr = rate * (1 - done / steps)
            back = p @ w.T
            w -= 0.05 * lr / len(pick) * (doc.T @ p)
            bias -= 0.05 * lr / len(pick) * p.sum(axis=0)
            step = np.repeat(back * (lr / len(pick)), n, axis=0) * x[:, None]
            own, at = np.unique(idx, return_inverse=True)
            table[own] -= np.stack([np.bincount(at, step[:, d], len(own)) for d in range(DIM)], axis=1).astype(np.float32)
            done += 1
    return table @ (w[:, 1] - w[:, 0]), float(bias[1] - bias[0])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, learn: Column | None = None) -> tuple[np.ndarray, float]:
    """docs (doc_id, text), labels (doc_id, quality): the model from at most so many labelled rows."""
    ids = labels.filter("doc_id is not null and quality is not null")
    if learn is not None:
        ids = ids.filter(learn)
    ids = ids.groupBy("doc_id").agg(F.max("quality").cast("int").alias("label"))
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # at most sample rows are broadcast
    rows = counts(docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.max("label").alias("label"), F.min("text").alias("text"))).toArrow()
    return train(sorted(zip(rows["label"].to_pylist(), rows["features"].to_pylist())))


def score(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """docs with score, the probability of class 1, and predicted."""
    from pyspark.sql.functions import pandas_udf

    arrow_batches(docs.sparkSession)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # BUCKETS numbers

    @pandas_udf("double")
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        weight, bias = shared.value
        for b in batches:
            total, n = np.zeros(len(b)), np.zeros(len(b))
            for row, what in blocks(list(b)):
                total += np.bincount(row, weight[what], len(b))
                n += np.bincount(row, minlength=len(b))
            yield pd.Series(1 / (1 + np.exp(-(total / np.maximum(n, 1) + bias))))

    return docs.withColumn("score", scores(F.col("text"))).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def held_out() -> Column:
    return F.coalesce(crc_mod(F.col("doc_id"), 5) == 0, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """docs with score and predicted; learned from labels of documents that are not held out."""
    return score(docs, fit(docs, labels, sample, crc_mod(F.col("doc_id"), 5) != 0))


def keep(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """docs without the rows that the classifier rejects; columns stay."""
    packed = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"))
    return classify(packed, labels, sample).filter("predicted = 1").select("__row.*")


def op8(docs: DataFrame, labels: DataFrame) -> DataFrame:
    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    model = fit(docs, labels, learn=crc_mod(F.col("doc_id"), 5) != 0)
    return score(rows, model).select("doc_id", "held_out", "score", "predicted")
