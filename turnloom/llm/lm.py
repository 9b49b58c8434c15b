"""A log-bilinear language model, trained by noise-contrastive estimation.

Tokens are words in lower case and one end for each text.  The ``HEAD`` most frequent words and
the end have vectors of their own; every other token falls into one of ``TAIL`` classes by its
spelling (characters beyond ASCII, last character, length), which has a vector as a word has, and
inside such a class a token has the share of its smoothed count.

A token is predicted from the ``CONTEXT`` tokens before it, each of which (one of the ``CONTEXTS``
most frequent words, or a class by spelling) has a vector r, and each place a weight c: place k
gives the log-bilinear distribution p_k(w) ~ exp(q_w . (c_k * r_u) + b_w), and the model is their
mixture, with the unigram distribution, by weights that depend on the nearest token.  Each p_k is
divided by its exact sum over all words, which batched matrix products give once for every
context and place, so the probabilities of all tokens after a text sum to one.

Training starts from a small model, of the ``WORDS`` most frequent words and the classes by
spelling, one class from the class before it: noise-contrastive estimation in expectation on
the pair counts of all training texts, by numpy on the driver.  From there each task goes over
all tokens of its training documents with sampled noise (noise-contrastive estimation, unigram
noise, AdaGrad by rows), and counts what the places explained, which gives the mixture's weights.
What the tasks change is merged by blocks of rows: rows seen seldom get the sum of the changes,
rows seen often their mean, by a = n / (n + ``STEPS``) of each task (sent in half precision).

Counts of the ``HEAD`` most frequent tokens go to the workers.  Other tokens are joined with the counts;
none of them is frequent in training texts, and those frequent in held-out texts are joined by broadcast.

Defined cases: a null or empty text is one end.  A very long text is one row with its numbers as
binary.  Rows with a null doc_id are training rows.  Repeated rows count and are scored each.
Further columns are dropped.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from copy import copy
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import arrow_batches, crc_mod, stored

#: Classes of the small model: the end, words, and classes by spelling.
WORDS, TAIL = 959, 64
CLASSES = 1 + WORDS + TAIL
HEAD = 200_000
#: Words that have vectors as contexts; others are contexts by their spelling.
CONTEXTS = 8191
DIM = 16
NOISE = 20
ROUNDS = 250
#: Held-out texts with a token outside of the head above which it is joined by broadcast.
HOT = 100_000
#: Distinct tokens that a task counts before it passes them on.
DISTINCT = 300_000
ADD = 0.1
#: Pairs that each class adds to its own, dealt as all tokens are: a class seen seldom predicts as all do.
SHRINK = 100.0
#: Tokens that predict (a third one gave no more at sf0.1, at a third more time); positions and noise tokens (by place) of a step; updates at which a task counts for half; rows in a block.
#: Then the rate, what AdaGrad's sums begin with, and how many noise tokens weigh as much as a token.
CONTEXT, STEP, SAMPLES, STEPS, BLOCK = 2, 1024, (64, 32), 20.0, 1024
RATE, SQUARE, FAKES = 0.05, 1.0, 10
#: Bits for a place among the rows that a step changes.
PLACE_BITS = 20
#: What the places count for the vectors that they share.
WEIGHTS = (1.0, 0.2)
#: Steps after which the mixture's weights follow.
HELD = 40
#: How the places' weights and the mixture's (the places', the unigram's) begin, and the tokens that this start counts as.
PLACES, MIXTURE, BELIEF = (1.0, 0.5), (0.75, 0.2, 0.05), 50.0


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


#: By last byte: letters (and bytes beyond ASCII), full stops, commas and others.
_LAST = [2 * (0 if b > 127 or 97 <= b <= 122 else 1 if b == 46 else 2 if b == 44 else 3) for b in range(256)]


def spelling(token: bytes) -> int:
    """The class by spelling, from 0 to TAIL - 1."""
    return _LAST[token[-1]] + (len(token) > 7) + (0 if token.isascii() else _beyond_ascii(token))


def _beyond_ascii(token: bytes) -> int:
    i = next(i for i, b in enumerate(token) if b > 127)
    return 8 * (1 + (token[i] * 31 + token[i + 1 if i + 1 < len(token) else i]) % 7)


def held_out() -> Column:
    return F.coalesce(crc_mod(F.col("doc_id"), 10) == 0, F.lit(False))


def token_counts(docs: DataFrame) -> DataFrame:
    """token (binary), n: over all rows of docs."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c: Counter = Counter()
        for b in batches:
            for t in b["text"]:
                c.update(tokens(t))
                if len(c) > DISTINCT:
                    yield pd.DataFrame({"token": list(c), "n": list(c.values())})
                    c.clear()
        if c:
            yield pd.DataFrame({"token": list(c), "n": list(c.values())})

    return docs.select("text").mapInPandas(run, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n"))


def frequent(counts: DataFrame, most: int) -> dict[bytes, int]:
    """The counts of the most frequent tokens, at most so many, by falling count: those above a
    threshold that the sizes of bands of counts (eight to a doubling) give.  No task sees more
    than its share; any token left out has a count of at most 1.1 * total / most."""
    band = F.floor(F.log2("n") * 8).cast("int")
    sizes = sorted(((r[0], r[1]) for r in counts.groupBy(band.alias("b")).count().collect()), reverse=True)
    got, least = 0, None
    for b, size in sizes:
        got += size
        if got > most:
            break
        least = b
    if least is None:
        return {}
    top = counts.filter(band >= least).toArrow().to_pydict()
    return dict(sorted(((bytes(t), n) for t, n in zip(top["token"], top["n"])), key=lambda x: (-x[1], x[0])))


class Model:
    """The small model; of a size that the corpus does not change."""

    def __init__(self, left: np.ndarray, right: np.ndarray, bias: np.ndarray):
        self.left, self.right, self.bias = left, right, bias
        s = left @ right.T + bias
        top = s.max(axis=1)
        self.log_sum = (top + np.log(np.exp(s - top[:, None]).sum(axis=1))).astype(np.float32)

    def log10(self, before: np.ndarray, after: np.ndarray) -> np.ndarray:
        s = np.einsum("ij,ij->i", self.left[before], self.right[after]) + self.bias[after] - self.log_sum[before]
        return s.astype(np.float64) / np.log(10)


def train(pairs: np.ndarray, dim: int = DIM, noise: float = NOISE, rounds: int = ROUNDS, rate: float = 0.05, seed: int = 3) -> Model:
    """pairs[u, w]: how often class w follows class u.  Expected noise-contrastive estimation
    with the unigram distribution as noise, by Adam."""
    k = len(pairs)
    total = max(float(pairs.sum()), 1.0)
    n = (pairs / total).astype(np.float32)
    unigram = ((pairs.sum(axis=0) + ADD) / (total + ADD * k)).astype(np.float32)
    n += (SHRINK / total * unigram).astype(np.float32)
    of = n.sum(axis=1, keepdims=True)
    fake = noise * of * unigram
    shift = np.log(noise * unigram)
    rng = np.random.default_rng(seed)
    w = [rng.normal(0, 0.1, (k, dim)).astype(np.float32), rng.normal(0, 0.1, (k, dim)).astype(np.float32), np.log(unigram)]
    m, v = [np.zeros_like(x) for x in w], [np.zeros_like(x) for x in w]
    for t in range(1, rounds + 1):
        d = w[0] @ w[1].T
        d += w[2] - shift
        np.clip(d, -30, 30, out=d)
        p = 1 / (1 + np.exp(-d))
        p *= n + fake
        p -= n
        step = rate * (1 - (t - 1) / rounds)
        for i, g in enumerate((p @ w[1], p.T @ w[0], p.sum(axis=0))):
            m[i] += 0.1 * (g - m[i])
            v[i] += 0.01 * (g * g - v[i])
            w[i] -= step * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.99**t)) + 1e-8)
    return Model(*w)


def small_classes(words: Iterable[bytes]) -> np.ndarray:
    """The small model's class of each number of the large one."""
    own = [1 + i if i < WORDS else 1 + WORDS + spelling(t) for i, t in enumerate(words)]
    return np.array([0, *own, *range(1 + WORDS, CLASSES)], np.int64)


def contexts(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The context of each number of the large model, and the small model's class of each context."""
    n = min(len(words), CONTEXTS)
    of = np.array([0, *(1 + i if i < n else 1 + n + spelling(t) for i, t in enumerate(words)), *range(1 + n, 1 + n + TAIL)], np.int64)
    return of, small_classes(words[:n])


class Large:
    """rows: vectors of the u contexts, the weights of the CONTEXT places, vectors of the v words.  The last value of a word
    is its bias, the one before meets what the small model divides by.  noise: of words; norm: logarithms of the exact sums,
    by place and context; mix: weights of the places and of the unigram, by the nearest context."""

    def __init__(self, small: Model, words: list[bytes], n: np.ndarray):
        of = small_classes(words)
        self.of, classes = contexts(words)
        self.u, self.v, n = len(classes), len(of), n + ADD
        self.noise = (n / n.sum()).astype(np.float32)
        share = n / np.bincount(of, n, len(small.bias))[of]
        left = np.hstack([small.left[classes], -small.log_sum[classes][:, None], np.zeros((self.u, 1))])
        places = np.array(PLACES[:CONTEXT])[:, None] * np.ones((CONTEXT, left.shape[1]))
        right = np.hstack([small.right[of], np.ones((self.v, 1)), (small.bias[of] + np.log(share))[:, None]])
        self.rows = np.vstack([left, places, right]).astype(np.float32)
        self.norm = np.zeros((CONTEXT, self.u), np.float32)
        self.mix = np.tile(np.array(MIXTURE, np.float32), (self.u, 1))

    def __getstate__(self) -> dict:
        """Vectors go to the workers in half precision, biases in single."""
        return self.__dict__ | {"rows": (self.rows[:, :-2].astype(np.float16), self.rows[:, -2:])}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state | {"rows": np.hstack([state["rows"][0].astype(np.float32), state["rows"][1]])})

    def predicted(self, place: int, context: np.ndarray) -> np.ndarray:
        h = self.rows.take(context, 0) * self.rows[self.u + place]
        h[:, -1] = 1
        return h

    def sums(self, context: np.ndarray) -> np.ndarray:
        """Logarithms of the sums over all words, by place, of contexts: batched matrix products."""
        words, out = self.rows[self.u + CONTEXT :].T, np.empty((CONTEXT, len(context)), np.float32)
        for i in range(0, len(context), 64):
            for k in range(CONTEXT):
                s = self.predicted(k, context[i : i + 64]) @ words
                top = s.max(axis=1)
                s -= top[:, None]
                np.exp(s, out=s)
                out[k, i : i + 64] = top + np.log(s.sum(axis=1, dtype=np.float64))
        return out

    def chances(self, before: np.ndarray, after: np.ndarray) -> np.ndarray:
        """Probabilities of after (numbers); before: CONTEXT rows of numbers, the nearest first."""
        u, q = self.of.take(before), self.rows.take(self.u + CONTEXT + after, 0)
        mix = self.mix.take(u[0], 0)
        p = mix[:, CONTEXT] * self.noise.take(after)
        for k in range(CONTEXT):
            p += mix[:, k] * np.exp(np.einsum("ij,ij->i", self.predicted(k, u[k]), q) - self.norm[k, u[k]])
        return p

    def log10(self, before: np.ndarray, after: np.ndarray) -> np.ndarray:
        return np.log10(self.chances(before, after).astype(np.float64))


def windows(seqs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The tokens before each token of texts, nearest first (ends before a text), and the tokens."""
    after = np.concatenate(seqs)
    starts = np.cumsum([0, *map(len, seqs)])[:-1]
    before = np.zeros((CONTEXT, len(after)), np.int64)
    for k in range(CONTEXT):
        before[k, k + 1 :] = after[: len(after) - k - 1]
        for j in range(k + 1):  # a text's first tokens have ends before them
            at = starts + j
            before[k, at[at < len(after)]] = 0
    return before, after


class Learner:
    """Steps of sampled noise-contrastive estimation on a copy of a large model."""

    def __init__(self, model: Large, seed: int):
        self.m = copy(model)
        self.m.rows = model.rows.copy()
        self.start, self.rng = model.rows, np.random.default_rng(seed)
        self.square = np.full(len(model.rows), SQUARE, np.float32)
        self.times = np.zeros(len(model.rows), np.float32)
        self.shift = np.log(FAKES * model.noise)
        self.upto = np.cumsum(model.noise, dtype=np.float64)
        self.explained = np.zeros((model.u, CONTEXT + 1))
        self.held: list[tuple[np.ndarray, np.ndarray]] = []

    def step(self, before: np.ndarray, after: np.ndarray) -> None:
        m, u, p = self.m, self.m.u, self.m.rows
        fake = np.minimum(np.searchsorted(self.upto, self.rng.random(max(SAMPLES)) * self.upto[-1], "right"), m.v - 1)
        of = m.of.take(before)
        left, places = p.take(of.ravel(), 0).reshape(*of.shape, -1), p[u : u + CONTEXT][:, None]
        h = left * places
        h[:, :, -1] = 1
        q, qf = p.take(u + CONTEXT + after, 0), p.take(u + CONTEXT + fake, 0)
        s = np.einsum("kij,ij->ki", h, q)
        g = -1 / (1 + np.exp(np.clip(s - self.shift[after], -30, 30)))
        gh, gf = np.empty_like(h), np.zeros_like(qf)
        for k, (n, weight) in enumerate(zip(SAMPLES, WEIGHTS)):
            e = qf[:n] @ h[k].T  # noise by tokens: products with either side are fast this way
            np.subtract(self.shift[fake[:n], None], e, out=e)
            with np.errstate(over="ignore"):  # then the share is 0
                np.exp(e, out=e)
            e += 1
            np.divide(FAKES / n, e, out=e)
            np.matmul(e.T, qf[:n], out=gh[k])
            gf[:n] += np.float32(weight) * (e @ h[k])
        gh += g[:, :, None] * q
        gh[:, :, -1] = 0
        self.update(np.arange(u, u + CONTEXT), np.einsum("kij,kij->kj", gh, left))
        weight = np.array(WEIGHTS, np.float32)[:, None]
        own = gh * (places * weight[:, :, None])
        g *= weight
        at = np.concatenate([of.ravel(), u + CONTEXT + after, u + CONTEXT + fake]).astype(np.int32)
        self.update(at, np.vstack([own.reshape(-1, p.shape[1]), np.einsum("ki,kij->ij", g, h), gf]))
        self.explain(of[0], np.exp(np.minimum(s, 0)), m.noise[after])

    def explain(self, nearest: np.ndarray, places: np.ndarray, unigram: np.ndarray) -> None:
        """A step of expectation-maximisation for the mixture's weights, which follow at times."""
        w = self.m.mix.take(nearest, 0)
        w[:, :CONTEXT] *= places.T
        w[:, CONTEXT] *= unigram
        w /= w.sum(axis=1, keepdims=True)
        self.held.append((nearest, w))
        if len(self.held) >= HELD:
            self.weigh()

    def weigh(self) -> None:
        if self.held:
            nearest, w = (np.concatenate(x) for x in zip(*self.held))
            for k in range(CONTEXT + 1):
                self.explained[:, k] += np.bincount(nearest, w[:, k], len(self.explained))
            self.m.mix = mixture(self.explained)
            self.held.clear()

    def update(self, at: np.ndarray, g: np.ndarray) -> None:
        keys = at.astype(np.int64) << PLACE_BITS
        keys |= np.arange(len(at))
        keys.sort()  # numbers alone sort faster than their places
        at = keys >> PLACE_BITS
        first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        rows, g = at.take(first), np.add.reduceat(g.take(keys & ((1 << PLACE_BITS) - 1), 0), first, axis=0)
        square = self.square.take(rows)
        square += np.einsum("ij,ij->i", g, g) / g.shape[1]
        self.square[rows] = square
        g *= (np.float32(RATE) / np.sqrt(square))[:, None]
        self.m.rows[rows] = self.m.rows.take(rows, 0) - g
        self.times[rows] += 1


def mixture(explained: np.ndarray) -> np.ndarray:
    """Weights by the nearest context, from how many tokens each place and the unigram explained there."""
    of_all = explained.sum(axis=0) + BELIEF * np.array(MIXTURE)
    w = explained + BELIEF * of_all / of_all.sum()
    return (w / w.sum(axis=1, keepdims=True)).astype(np.float32)


def trained(model: Large, rows: DataFrame) -> Large:
    """The model after sampled noise-contrastive estimation on all texts of rows (ids), with its mixture and its exact sums."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(model)
    width, n_rows = model.rows.shape[1], len(model.rows)

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        own = None
        for b in batches:
            if not len(b):
                continue
            own = own or Learner(shared.value, TaskContext.get().partitionId())
            before, after = windows([np.frombuffer(x, "<u4").astype(np.int64) for x in b["ids"]])
            order = own.rng.permutation(len(after))
            for i in range(0, len(order), STEP):
                own.step(before[:, order[i : i + STEP]], after[order[i : i + STEP]])
        if own:
            own.weigh()
            yield pd.DataFrame({"block": [-1], "at": [b""], "a": [b""], "d": [own.explained.astype("<f8").tobytes()]})
            a = own.times / (own.times + STEPS)
            for i in range(0, n_rows, BLOCK):
                at = np.flatnonzero(own.times[i : i + BLOCK]).astype("<i4")
                if len(at):
                    yield pd.DataFrame({"block": [i // BLOCK], "at": [at.tobytes()], "a": [a[i + at].tobytes()], "d": [(own.m.rows[i + at] - own.start[i + at]).astype(np.float16).tobytes()]})

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list[np.ndarray]] = {}
        explained = None
        for b in batches:
            for block, at, a, d in zip(b["block"], b["at"], b["a"], b["d"]):
                if block < 0:
                    own = np.frombuffer(d, "<f8")
                    explained = own if explained is None else explained + own
                    continue
                x = held.setdefault(block, [np.zeros((BLOCK, width)), np.zeros(BLOCK), np.zeros(BLOCK)])
                at, a = np.frombuffer(at, "<i4"), np.frombuffer(a, np.float32)
                x[0][at] += np.frombuffer(d, np.float16).reshape(-1, width)
                x[1][at] += a
                x[2][at] += np.log1p(-a)
        if explained is not None:
            yield pd.DataFrame({"block": [-1], "d": [explained.astype("<f8").tobytes()]})
        for block, (d, a, log) in held.items():
            d *= (-np.expm1(log) / np.maximum(a, 1e-9))[:, None]
            yield pd.DataFrame({"block": [block], "d": [d.astype(np.float32).tobytes()]})

    texts = rows.select("ids")  # a learner passes on a row for each token that it has seen; so they are fewer than tasks
    texts = texts.coalesce(max(texts.rdd.getNumPartitions() // 2, spark.sparkContext.defaultParallelism))
    parts = texts.mapInPandas(learn, "block int, at binary, a binary, d binary")
    out = copy(model)
    out.rows, explained = model.rows.copy(), np.zeros((model.u, CONTEXT + 1))
    for r in parts.repartition("block").mapInPandas(merge, "block int, d binary").toLocalIterator():  # the model's size
        if r["block"] < 0:
            explained += np.frombuffer(r["d"], "<f8").reshape(explained.shape)
            continue
        d = np.frombuffer(r["d"], np.float32).reshape(-1, width)
        i = r["block"] * BLOCK
        out.rows[i : i + BLOCK] += d[: n_rows - i]
    out.mix = mixture(explained)
    out.__setstate__(out.__getstate__())  # as the workers see it
    shared.destroy()
    final = spark.sparkContext.broadcast(out)

    def divide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield pd.DataFrame({"id": b["id"], "z": final.value.sums(b["id"].to_numpy()).T.astype("<f8").tolist()})

    tasks = max(1, min(-(-out.u // 128), 2 * spark.sparkContext.defaultParallelism))
    for r in spark.range(0, out.u, 1, tasks).mapInPandas(divide, "id long, z array<double>").collect():  # a row for each context
        out.norm[:, r["id"]] = r["z"]
    final.destroy()
    return out


def encoded(docs: DataFrame, shared, ends: int) -> DataFrame:
    """A row for each document: uid, doc_id (as a string), held_out, n_tokens, base (sum of log10(c + ADD)
    over tokens in head and the end), known, ids (0 the end, then the words of shared, then the classes by
    spelling; 32-bit numbers), rare (tokens), times; and rows with pairs (keys u * CLASSES + w and counts)
    of the small model's classes in each task's training documents.  shared: counts of HEAD words."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = shared.value
        place = {t: i for i, t in enumerate(table)}.get
        first_tail, last = 1 + len(table), _LAST
        of = small_classes(table)
        log = np.log10(np.array([*table.values(), ends]) + ADD)
        seen = np.zeros(CLASSES * CLASSES, np.int64)
        for b in batches:
            out = []
            for uid, doc, held, text in zip(b["uid"], b["doc_id"], b["held_out"], b["text"]):
                words = tokens(text)
                at = np.append(np.fromiter(map(place, words, repeat(-1)), np.int64, len(words)), len(table))
                seq = np.append(at[:-1] + 1, 0)
                gaps = np.flatnonzero(at < 0)
                odd = [words[i] for i in gaps.tolist()]
                rare = Counter(odd)
                if rare:
                    seq[gaps] = [first_tail + last[t[-1]] + (len(t) > 7) if t.isascii() else first_tail + spelling(t) for t in odd]
                    base = log[at[at >= 0]].sum()
                else:
                    base = log[at].sum()
                if not held:
                    small = of[seq]
                    np.add.at(seen, np.concatenate(([0], small[:-1])) * CLASSES + small, 1)
                known = len(at) - sum(rare.values()) - (ends == 0)
                out.append((uid, doc, held, len(at), base, known, seq.astype("<u4").tobytes(), list(rare), list(rare.values()), None, None))
            yield pd.DataFrame(out, columns=names)
        keys = np.flatnonzero(seen)
        if len(keys):
            yield pd.DataFrame([(None, None, None, None, None, None, None, None, None, keys.astype("<i8").tolist(), seen[keys].tolist())], columns=names)

    schema = "uid long, doc_id string, held_out boolean, n_tokens long, base double, known long, ids binary, rare array<binary>, times array<int>, keys array<long>, counts array<long>"
    names = [x.split()[0] for x in schema.split(", ")]
    return docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("string"), held_out().alias("held_out"), "text").mapInPandas(run, schema)


class Fitted:
    """model; inside: log10 of what the counts of a class by spelling are divided by; counts: a table of all training tokens;
    n_train, n_types and rows (``encoded``)."""

    def __init__(self, **values):
        self.__dict__.update(values)


def fit(docs: DataFrame) -> Fitted:
    spark = docs.sparkSession
    arrow_batches(spark)
    learn = docs.filter(~held_out())
    counts = stored(token_counts(learn), "lm-counts")
    ends = learn.count()
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).collect()[0]
    head = frequent(counts, HEAD)
    words = spark.sparkContext.broadcast(head)  # HEAD entries
    rows = stored(encoded(docs, words, ends), "lm-rows")

    def by_class(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b = b[[bytes(t) not in words.value for t in b["token"]]]
            yield pd.DataFrame({"cls": [spelling(bytes(t)) for t in b["token"]], "n": b["n"]}).astype("int64")

    inside, tail = np.full(TAIL, np.log10(ADD)), np.zeros(TAIL)
    for r in counts.mapInPandas(by_class, "cls long, n long").groupBy("cls").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
        inside[r["cls"]], tail[r["cls"]] = np.log10(r["n"] + ADD * (r["v"] + 1)), r["n"]
    pairs = rows.filter("keys is not null").select(F.explode(F.arrays_zip("keys", "counts")).alias("x"))
    pairs = pairs.groupBy("x.keys").agg(F.sum("x.counts").alias("n")).toArrow()  # CLASSES**2 rows at most
    matrix = np.zeros(CLASSES * CLASSES)
    matrix[pairs["keys"].to_numpy()] = pairs["n"].to_numpy()
    small = train(matrix.reshape(CLASSES, CLASSES))
    start = Large(small, list(head), np.array([ends, *head.values(), *tail], np.float64))
    model = trained(start, rows.filter("uid is not null and not held_out"))
    return Fitted(model=model, inside=inside, counts=counts, n_train=total + ends, n_types=distinct + (ends > 0), rows=rows, words=list(head))


def _with_counts(rare: DataFrame, rows: DataFrame, counts: DataFrame) -> DataFrame:
    """rare (uid, token, times) with n, null for tokens that training texts don't have.  Tokens outside of the head are seldom in
    training texts, but may be frequent in the others: those in more than HOT of these (so few) are joined by broadcast."""
    hot = rows.filter("held_out").select(F.explode("rare").alias("token")).groupBy("token").agg(F.count("*").alias("rows")).filter(F.col("rows") > HOT).select("token")
    hot = stored(hot, "lm-hot")
    if hot.isEmpty():
        return rare.join(counts, "token", "left")
    hot = F.broadcast(hot.join(counts, "token", "left"))
    return rare.join(hot, "token").unionByName(rare.join(hot, "token", "left_anti").join(counts, "token", "left"))


def score(docs: DataFrame, fitted: Fitted | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    fitted = fitted or fit(docs)
    rows, counts, inside, n_train, n_types = fitted.rows, fitted.counts, fitted.inside, fitted.n_train, fitted.n_types
    shared = docs.sparkSession.sparkContext.broadcast(fitted.model)

    found = rows.filter("uid is not null")
    rare = found.select("uid", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("uid", F.col("x.rare").alias("token"), F.col("x.times").alias("times"))
    got = (
        _with_counts(rare, found, counts)
        .select("uid", (F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + F.lit(ADD))).alias("log"), F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0).alias("known"))
        .groupBy("uid")
        .agg(F.sum("log").alias("log"), F.sum("known").alias("more"))
    )

    @F.pandas_udf("double")
    def of_ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        """log10 of the model's probabilities, less the sums inside classes by spelling."""
        model = shared.value
        less = np.concatenate([np.zeros(model.v - TAIL), inside])
        for b in batches:
            seqs = [np.frombuffer(x, "<u4").astype(np.int64) for x in b]
            out = []
            for i in range(0, len(seqs), 50):
                part = seqs[i : i + 50]
                before, after = windows(part)
                logs = model.log10(before, after) - less[after]
                out.append(np.add.reduceat(logs, np.cumsum([0, *map(len, part[:-1])])))
            yield pd.Series(np.concatenate(out) if out else [], dtype="float64")

    logs = F.col("base") + F.coalesce("log", F.lit(0.0))
    unit = float(np.log10(n_train + ADD * (n_types + 1)))
    return found.join(got, "uid", "left").select(
        F.col("doc_id").cast(dict(docs.dtypes)["doc_id"]), "held_out", "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).cast("long").alias("n_known"), F.lit(n_train).cast("long").alias("train_tokens"),
        (logs - F.col("n_tokens") * F.lit(unit)).alias("base_score"),
        (F.coalesce("log", F.lit(0.0)) + of_ids("ids")).alias("score"),
    )


def op7(docs: DataFrame) -> DataFrame:
    return score(docs)
