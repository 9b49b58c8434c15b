"""Where models come in.  A hook is a function from a batch to a batch; none is called here but
deterministic stand-ins.  Calls run on executors in Arrow batches, are made once for each worker,
retried with growing pauses, and can be cached by content, as retried tasks repeat them."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from threading import Lock

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions.text import hashed
from .operators.dialogue import augmented_record
from .operators.validate import variant_ok

FAILED = "__ERROR__"


def retried(call: Callable, tries: int = 3, pause: float = 1.0, failure=None, most: float = 20.0, sleep: Callable = time.sleep) -> Callable:
    """call with tries, pauses that double up to most, and failure (or failure(error)) at the end."""

    def run(*args):
        for k in range(tries):
            try:
                return call(*args)
            except Exception as e:  # any failure of a service is tried again
                error = e
                if k + 1 < tries:
                    sleep(min(pause * 2**k, most))
        return failure(error) if callable(failure) else failure

    return run


def asks_to_wait(error: Exception) -> float | None:
    """Seconds that a service asks for: None unless its status is 429, then what Retry-After says (0 where it says nothing).
    Status and headers are read from the error or from the response that it holds, as HTTP clients have them."""
    held = [error, getattr(error, "response", None)]
    codes = [getattr(x, name, None) for x in held for name in ("status", "status_code", "code")]
    if 429 not in codes:
        return None
    said = next((h.get("Retry-After") for x in held if (h := getattr(x, "headers", None))), None)
    try:
        return max(float(said), 0.0)
    except (TypeError, ValueError):
        return 0.0


class Keys:
    """Clients of a service, one for each key, in turn.  A client that was told to wait rests; the turn goes on with the others, and
    only where all rest does a call wait, for the one that is free first.  Safe among threads of one worker."""

    def __init__(self, clients: list, clock: Callable[[], float] = time.monotonic):
        self._clients, self._free, self._next, self._lock, self._clock = list(clients), [0.0] * len(clients), 0, Lock(), clock

    def __call__(self) -> tuple[int, object, float]:
        """place, client and the seconds until it is free."""
        with self._lock:
            n, now = len(self._clients), self._clock()
            turn = [(self._next + k) % n for k in range(n)]
            i = next((i for i in turn if self._free[i] <= now), None)
            i = min(turn, key=self._free.__getitem__) if i is None else i
            self._next = (i + 1) % n
            return i, self._clients[i], max(self._free[i] - now, 0.0)

    def rest(self, i: int, seconds: float) -> None:
        with self._lock:
            self._free[i] = max(self._free[i], self._clock() + seconds)


def service(clients: list, send: Callable, tries: int = 8, most: float = 20.0, sleep: Callable = time.sleep, clock: Callable[[], float] = time.monotonic) -> Callable[[str], str | None]:
    """send(client, prompt) as a call that gives the reply, or None after so many tries.  At a 429 the client rests as long as the
    service asks, or longer from try to try, at most ``most`` seconds; other failures are tried again with the next
    client after a pause that doubles."""
    keys = Keys(clients, clock)

    def call(prompt: str) -> str | None:
        limited = failed = 0
        for _ in range(tries):
            i, client, wait = keys()
            if wait:
                sleep(wait)
            try:
                return send(client, prompt)
            except Exception as e:  # any failure of a service is tried again
                if (asked := asks_to_wait(e)) is not None:
                    limited += 1
                    keys.rest(i, min(max(asked, 2.0 ** (limited - 1)), most))
                elif limited + failed + 1 < tries:
                    failed += 1
                    sleep(min(0.5 * 2.0 ** (failed - 1), most))
        return None

    return call


def called(df: DataFrame, prompt: str, make: Callable[[], Callable[[str], str | None]], workers: int = 6) -> DataFrame:
    """df with reply (null where the call failed) and ok; so many calls at once in each task.  Cache by content
    (``uncached``) what must not be asked twice, as retried tasks ask again."""

    def hook() -> Callable[[pd.DataFrame], pd.DataFrame]:
        call, pool = make(), ThreadPoolExecutor(workers)
        return lambda b: b.assign(reply=list(pool.map(call, b[prompt])))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return applied(df, hook, f"{schema}, reply string").withColumn("ok", F.coalesce(F.length("reply") > 0, F.lit(False)))


#: What a paraphrase hook answers.
VARIANT = "dialogue array<struct<from:string,value:string>>, rewrite string"


def paraphrased(df: DataFrame, reply: str = "reply") -> DataFrame:
    """df (dialogue, rewrite, meta and a hook's reply as JSON) with variant: the record, marked as augmented, of a reply
    that may stand for the original; null where there is no reply or it may not."""
    v = F.from_json(reply, VARIANT)
    good = variant_ok(F.col("dialogue"), F.col("rewrite"), F.col("__v.dialogue"), F.col("__v.rewrite"))
    stripped = F.transform("__v.dialogue", lambda x: F.struct(x["from"].alias("from"), F.trim(x["value"]).alias("value")))
    return df.withColumn("__v", v).withColumn("variant", F.when(good, augmented_record(stripped, F.col("__v.rewrite"), F.col("meta")))).drop("__v")


def applied(df: DataFrame, make: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], schema: str, chunk: int | None = None) -> DataFrame:
    """Rows through a hook that make() sets up once for each worker and partition; at most chunk rows at a time, if given."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hook = make()
        for b in batches:
            step = chunk or max(len(b), 1)
            for i in range(0, len(b), step):
                yield hook(b.iloc[i : i + step].reset_index(drop=True))

    return df.mapInPandas(run, schema)


def by_length(df: DataFrame, length: str, make: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], schema: str, budget: int, window: int = 4096) -> DataFrame:
    """Rows through a hook in batches of like length: of ``window`` rows of a partition at a time, sorted by length, each batch has
    as many as fit into budget when all are padded to its longest (one, if one alone is longer).  A partition holds no more
    than a window; rows come out batch by batch, so they are to be told by an id."""

    def batches_of(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        rows = rows.sort_values(length, kind="stable").reset_index(drop=True)
        sizes, begin = rows[length].fillna(0).astype("int64").tolist(), 0
        for i, n in enumerate(sizes):
            if i > begin and n * (i + 1 - begin) > budget:
                yield rows.iloc[begin:i].reset_index(drop=True)
                begin = i
        if begin < len(sizes):
            yield rows.iloc[begin:].reset_index(drop=True)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hook, held, n = make(), [], 0
        for b in parts:
            for at in range(0, len(b), window):
                held.append(b.iloc[at : at + window])
                n += len(held[-1])
                if n >= window:
                    yield from map(hook, batches_of(pd.concat(held, ignore_index=True)))
                    held, n = [], 0
        if held:
            yield from map(hook, batches_of(pd.concat(held, ignore_index=True)))

    return df.mapInPandas(run, schema)


class Bucket:
    """Lets through so many calls a second, and as many at once; others wait their turn."""

    def __init__(self, rate: float, clock: Callable[[], float] = time.monotonic, sleep: Callable = time.sleep):
        self._gap, self._clock, self._sleep, self._lock, self._free = 1.0 / rate, clock, sleep, Lock(), clock()

    def __call__(self) -> None:
        with self._lock:
            at = max(self._free, self._clock())
            self._free = at + self._gap
        if (wait := at - self._clock()) > 0:
            self._sleep(wait)


def leased(df: DataFrame, prompt: str, keys: list[str], make: Callable[[list[str]], Callable[[str], str | None]], rate: float, tasks: int) -> DataFrame:
    """``called`` over a cluster, with each key in one task alone and at most ``rate`` calls a second for each key.

    The stage is a barrier: its tasks run at once and are retried at once, and none runs twice at a time.  They gather each
    other's partitions, and of the keys, in that order, each takes every so-manieth; tasks beyond the number of keys are not
    made.  make gets the task's keys.  There must be as many free slots as tasks."""
    tasks = max(1, min(tasks, len(keys)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import BarrierTaskContext

        context = BarrierTaskContext.get()
        ranks = sorted(int(x) for x in context.allGather(str(context.partitionId())))
        mine = keys[ranks.index(context.partitionId()) :: len(ranks)]
        calls, buckets = [make([k]) for k in mine], [Bucket(rate) for _ in mine]
        pools = [ThreadPoolExecutor(1) for _ in mine]  # a key's calls are one after the other

        def one(k: int, text: str) -> str | None:
            buckets[k]()
            return calls[k](text)

        for b in batches:
            asked = [pools[i % len(mine)].submit(one, i % len(mine), text) for i, text in enumerate(b[prompt])]
            yield b.assign(reply=[a.result() for a in asked])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    out = df.repartition(tasks).mapInPandas(run, f"{schema}, reply string", barrier=True)
    return out.withColumn("ok", F.coalesce(F.length("reply") > 0, F.lit(False)))


def uncached(df: DataFrame, cache: DataFrame, key: list[str]) -> DataFrame:
    """Rows that no call has answered yet."""
    return df.join(cache.select(*key).distinct(), key, "left_anti")


def stub_predict(last_user: Column, key: Column, model: str) -> Column:
    """A stand-in for a model: the last turn, for some rows as it is and for others as a request."""
    return F.when(hashed(key, model) % 3 == 0, last_user).otherwise(F.concat(F.lit("Request: "), last_user))


def stub_score(key: Column, salt: str, null_every: int = 11) -> Column:
    """A stand-in for a judge: 0, 1 or, for some rows, no score."""
    h = hashed(key, salt)
    return F.when(h % null_every == 0, None).otherwise((h % 2).cast("int"))
