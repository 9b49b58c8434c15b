"""Mixing against a plain version of the targets and what rounding has to keep."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tests.llm.brute import WS
from turnloom.llm import mixing

SF = "/root/testdata/sf0.001"


def plain_targets(sizes, share=1.5, most=2.0, weights=(3, 1, 2)):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, out = share * sum(sizes.values()), {}
    while len(out) < len(names):
        w = sum(weight[s] for s in names if s not in out)
        over = [s for s in names if s not in out and left * weight[s] / w > most * sizes[s]]
        if not over:
            return out | {s: left * weight[s] / w for s in names if s not in out}
        for s in over:
            out[s] = most * sizes[s]
        left -= sum(out[s] for s in over)
    return out


def check(docs, got, slack=None):
    """docs: (doc_id, source, text); got: rows of op12."""
    size = lambda t: len(WS.findall(t or ""))
    sums = defaultdict(int)
    for _, s, t in docs:
        sums[s] += size(t)
    want = plain_targets(sums)
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((d, size(t)) for d, _, t in docs)
    by = defaultdict(list)
    for r in got:
        by[r["source_size"], round(r["target"], 6)].append(r)
        times = r["target"] / r["source_size"] if r["source_size"] else 0
        assert r["copies"] in (int(times), int(times) + 1) and r["taken"] == r["copies"] * r["size"] <= 2 * r["size"]
    assert Counter({k: len(v) for k, v in by.items()}) == Counter((sums[s], round(want[s], 6)) for _, s, _ in docs)
    for k, rows in by.items():
        if len({s for s in sums if (sums[s], round(want[s], 6)) == k}) == 1:
            assert abs(sum(r["taken"] for r in rows) - rows[0]["target"]) <= max(r["size"] for r in rows) / 2 + 1e-6


@pytest.mark.parametrize("block", [4096, 5, 2])
def test_targets_and_rounding(spark, monkeypatch, block):
    monkeypatch.setattr(mixing, "BLOCK", block)
    df = spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id < 150" if block < 10 else "true")
    got = mixing.op12(df).collect()
    check([(r["doc_id"], r["source"], r["text"]) for r in df.collect()], got)
    again = mixing.op12(df.repartition(7)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))


def test_hot_copies_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(mixing, "COPIES", 10)
    rows = [(1, "a", "one two three")] * 40 + [(None, None, "x y"), (None, None, "z"), (None, None, None), (2, "b", ""), (2, "b", None), (3, "c", "w " * 50_000), (4, "\U0001f600", "u v"), (5, "￮", "s")] + [(i, "d", "q " * (i % 9)) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").select("*", *[F.lit("x").alias(c) for c in ("size", "target", "doc", "block", "chance", "same", "n", "open", "place")])
    check(rows, mixing.op12(df).collect())
    assert mixing.op12(df.limit(0)).collect() == []


def test_meeting_keeps_words_and_chances():
    """Words are kept to the last row; on average each row keeps its probability."""
    chance = random.Random(3)
    rows = [(size, 0.3) for size in (900, 400, 350, 40, 33, 20, 11, 7, 5, 2)]
    total, hits = sum(s * p for s, p in rows), [0.0] * len(rows)
    n = 20_000
    for _ in range(n):
        x, left = mixing.meet(rows, chance)
        assert all(v in (0.0, 1.0) for i, v in enumerate(x) if i != left)
        assert abs(sum(s * v for (s, _), v in zip(rows, x)) - total) < 1e-6
        hits = [h + v for h, v in zip(hits, x)]
    assert all(abs(h / n - 0.3) < 0.015 for h in hits), hits


def test_small_sources_come_near_their_targets():
    """A long document that stays open is rounded, and shorter ones make up for it."""
    import numpy as np

    sizes, x = np.array([5000.0, 800, 300, 120, 60, 30, 11, 5, 2]), np.array([0.42, 0, 1, 0, 0, 0, 0, 1, 0])
    total = float(sizes @ x)
    mixing.settle(sizes, x, 0)
    assert set(x) <= {0.0, 1.0} and abs(sizes @ x - total) == 1077  # 2,100 words are owed, the other documents that can turn have 1,023
    sizes, x = np.array([50.0, 9, 8, 7, 3, 2, 1]), np.array([0.6, 0, 1, 1, 1, 0, 1])
    total = float(sizes @ x)
    mixing.settle(sizes, x, 0)
    assert abs(sizes @ x - total) <= 1
    x = np.array([0.5])
    mixing.settle(np.array([7.0]), x, 0)
    assert x.tolist() == [1.0]
