"""Rolling windows against a plain version."""

import random
import zlib

import pandas as pd
import pytest
from pyspark.sql import functions as F

from turnloom.llm import rolling


def brute(docs, windows=(1800, 86_400)):
    at = lambda d: None if d is None else 60 * ((d + zlib.crc32(str(d).encode()) % 1000) // 6)
    rows = [(d, at(d), None if t is None else len(t), lang, s) for d, t, lang, s in docs]
    out = []
    for d, e, _, _, s in rows:
        for w in windows:
            seen = [] if e is None else [r for r in rows if r[4] == s and r[1] is not None and e - w <= r[1] < e]
            x = sorted(r[2] for r in seen if r[2] is not None)
            m = len(x)
            out.append((d, w, e, len(seen), sum(x), len({r[3] for r in seen} - {None}), x[-(-m // 2) - 1] if m else None, x[-(-99 * m // 100) - 1] if m else None))
    return sorted(out, key=repr)


COLS = ["doc_id", "window_s", "event_s", "n_events", "sum_chars", "n_langs", "median_chars", "high_chars"]


def made(seed, n, spread):
    chance = random.Random(seed)
    return [(chance.choice([i * spread, i * spread, -i * spread, 3, None]), chance.choice(["", None, "é𝒳" * chance.randrange(9), "x" * chance.randrange(300)]), chance.choice(["en", "de", None, "fr", "en"]), chance.choice(["a", "a", "a", "b", None, "|"])) for i in range(n)]


@pytest.mark.parametrize("seed,n,spread", [(1, 400, 1), (2, 300, 37), (3, 300, 900), (4, 200, 40_000)])
def test_against_plain(spark, seed, n, spread):
    docs = made(seed, n, spread)
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").select("*", *[F.lit("x").alias(c) for c in ("key", "n", "chunk", "length", "event_s", "own", "window_s", "x", "source_key")])
    got = rolling.op13(df)
    assert sorted(got.columns) == sorted(COLS)
    assert sorted((tuple(r[c] for c in COLS) for r in got.collect()), key=repr) == brute(docs)


def test_hot_keys_by_broadcast(spark, monkeypatch):
    from turnloom.llm import shared

    monkeypatch.setattr(shared, "HOT", 2)
    docs = [(7, "abc", "en", "a")] * 30 + made(9, 60, 1)
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")
    assert sorted((tuple(r[c] for c in COLS) for r in rolling.op13(df).collect()), key=repr) == brute(docs)


def test_odd_tables(spark):
    schema = "doc_id long, text string, lang string, source string"
    assert rolling.op13(spark.createDataFrame([], schema)).collect() == []
    docs = [(2**63 - 1, "a", "en", "s"), (None, None, None, None), (1, "y" * 500_000, "en", "s"), (7, "", "en", "s")]
    got = {(r["doc_id"], r["window_s"]): r for r in rolling.op13(spark.createDataFrame(docs, schema)).collect()}
    assert len(got) == 8 and got[2**63 - 1, 1800]["event_s"] is None and got[None, 1800]["n_events"] == 0 and got[None, 86_400]["median_chars"] is None


def test_linked_lists_at_random():
    chance = random.Random(11)
    for _ in range(300):
        w = chance.choice([60, 300, 1800])
        n = chance.randrange(1, 60)
        rows = pd.DataFrame({"event_s": [60 * chance.randrange(-w // 60, w // 60) for _ in range(n)], "length": [chance.choice([None, 1, 1, 2, 3, 50]) for _ in range(n)], "lang": [chance.choice(["a", "b", None]) for _ in range(n)], "n": [chance.choice([1, 1, 2, 5]) for _ in range(n)]})
        got = rolling.features(rows, 0, w, (w,))
        for r in got.to_dict("records"):
            seen = rows[(rows.event_s >= r["event_s"] - w) & (rows.event_s < r["event_s"])]
            x = sorted(v for v, k in zip(seen.length, seen.n) if not pd.isna(v) for _ in range(k))
            m = len(x)
            assert r["n_events"] == seen.n.sum() and r["sum_chars"] == sum(x) and r["n_langs"] == seen.lang.nunique()
            assert (None if pd.isna(r["median_chars"]) else r["median_chars"]) == (x[-(-m // 2) - 1] if m else None)
            assert (None if pd.isna(r["high_chars"]) else r["high_chars"]) == (x[-(-99 * m // 100) - 1] if m else None)
