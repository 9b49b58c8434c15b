"""Very long texts, many small partitions, clashing columns and tokens that only held-out texts have."""

import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from turnloom.llm import chat, decontam, lm, packing, quality, rules, simhash, substrings

LINE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"


def long_text(n, seed=0):
    """n words in sentences and lines, none of which stands twice."""
    return " ".join(f"w{seed}x{i}{'.' if i % 11 == 10 else ''}" + ("\n" if i % 97 == 96 else "") for i in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, long_text(60_000) + " " + LINE + ". " + LINE + "."), (2, LINE + ". " + LINE + "."), (3, None), (4, "short one")]
    return spark.createDataFrame(rows, "doc_id long, text string"), rows


def test_decontamination_is_linear(spark):
    """One text of eight times as many words takes little more than eight times as long, with a one-word item too."""
    bench = spark.createDataFrame([(1, LINE), (2, "needle")], "item_id long, text string").coalesce(1)
    took = []
    for n in (1000, 80_000, 640_000):
        df = spark.createDataFrame([(n, long_text(n) + " " + LINE + " needle")], "doc_id long, text string")
        began = time.time()
        r = decontam.op3(df, bench).collect()[0]
        took.append(time.time() - began)
        assert (r["n_words"], r["n_hit"], r["n_items"]) == (n + 21, 21, 2)
    assert took[2] < 10 * took[1] + 2, took


def test_decontamination_of_long_texts(spark, docs):
    df, rows = docs
    bench = [(1, LINE), (2, "short one"), (3, "w0x59999")]
    got = decontam.op3(df, spark.createDataFrame(bench, "item_id long, text string"))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == sorted(brute.op3(rows, bench), key=repr)


def test_rules_packing_and_fingerprints_of_long_texts(spark, docs):
    from tokenizers import Tokenizer

    df, rows = docs
    want = {r[0]: r[1:] for r in brute.op6(rows)}
    got = rules.op6(df.withColumn("source", F.lit("a"))).collect()
    assert {r["doc_id"]: (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in got} == want
    tk = Tokenizer.from_file(packing.tokenizer_path())
    tk.encode_special_tokens = True
    brute.op5([tuple(r) for r in packing.op5(df).collect()], rows, lambda t: tk.encode(t, add_special_tokens=False).ids)
    assert sorted((tuple(r)[:3] for r in simhash.op9(df).collect()), key=repr) == sorted((tuple(r)[:3] for r in brute.op9(rows)), key=repr)


def test_scores_of_long_texts(spark, docs):
    df, rows = docs
    labels = spark.createDataFrame([(2, 1), (4, 0)], "doc_id long, quality int")
    got = {r["doc_id"]: r["score"] for r in quality.op8(df, labels).collect()}
    assert set(got) == {1, 2, 3, 4} and all(0 <= s <= 1 for s in got.values())
    base = {r[0]: r[5] for r in brute.op7(rows)}
    assert {r["doc_id"]: r["base_score"] for r in lm.op7(df).collect()} == pytest.approx(base)


def test_passages_of_long_texts_are_removed_but_once(spark, docs):
    df, rows = docs
    got = {r["doc_id"]: r for r in substrings.op2(df).collect()}
    kept = got[1]["text"]
    assert kept.startswith(rows[0][1][:400_000]) and got[1]["n_removed"] <= 6 and LINE in kept and LINE not in (got[2]["text"] or "")


def test_hot_spans_are_found_in_many_small_partitions(spark, monkeypatch):
    """A span with a share above the bound is named though no file holds it often: tasks read files together."""
    monkeypatch.setattr(substrings, "CHUNK", 4000)
    monkeypatch.setattr(substrings, "HOT", 1 / 1000)
    monkeypatch.setattr(substrings, "LEAST", 20)
    rows = [(i, (LINE + ". " + LINE + ". " if i % 8 == 0 else "") + long_text(300, i)) for i in range(1000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(300)
    found = substrings.spans(df)
    hot = {r["a"] for r in substrings.hot_spans(found).collect()}
    of_line = {a for a, _ in substrings.runs(LINE + ". " + LINE + ".")[0]}
    assert hot >= of_line and len(hot) <= 1000
    left = {r["doc_id"]: r["text"] for r in substrings.op2(df).collect()}
    assert LINE in left[0] and not any(LINE in left[i] for i in range(8, 1000, 8))


def test_tokens_that_only_held_out_texts_have(spark, monkeypatch):
    """A token frequent in held-out texts and absent from training ones is joined by broadcast; scores stay the same."""
    held = [n for n in range(10_000) if zlib.crc32(str(n).encode()) % 10 == 0][:60]
    train = [n for n in range(10_000) if zlib.crc32(str(n).encode()) % 10][:60]
    rows = [(n, "zorblax one two zorblax") for n in held] + [(n, f"one two three t{n}") for n in train]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    monkeypatch.setattr(lm, "HEAD", 3)
    one = {r["doc_id"]: tuple(r) for r in lm.op7(df.coalesce(1)).collect()}
    monkeypatch.setattr(lm, "HOT", 10)
    two = {r["doc_id"]: tuple(r) for r in lm.op7(df.coalesce(1)).collect()}
    assert one.keys() == two.keys()
    for k in one:
        assert one[k][:5] == two[k][:5] and one[k][5:] == pytest.approx(two[k][5:])
    base = {r[0]: r[5] for r in brute.op7(rows)}
    assert {k: v[5] for k, v in two.items()} == pytest.approx(base)
    assert all(two[n][3] == 3 for n in held)  # one, two and the end are known


def test_chat_keeps_clashing_columns_apart_and_long_conversations_whole(spark):
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"text {t} </turn> \\### " * (1 + t % 3)) for t in range(3000)] + [(2, 0, "user", "x" * 500_000), (2, 1, "assistant", None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    wide = df.select("*", *[F.lit("x").alias(c) for c in ("n_turns", "rows", "formatted", "mask", "loss", "key", "h", "at", "turns")])
    want = sorted(tuple(r) for r in chat.op4(df).collect())
    assert sorted(tuple(r) for r in chat.op4(wide).collect()) == want
    plain = {r[0]: tuple(r) for r in brute.op4(rows)}
    for r in want:
        if r[0] in plain:
            assert tuple(r)[:5] == plain[r[0]][:5]


def test_features_of_the_classifier_against_plain_hashes():
    """Words, their repeats and grams of three to five characters of marked words, by a loop over Python numbers."""
    mask = (1 << 64) - 1

    def mix(h, kind):
        return ((((h + kind) & mask) * 0xFF51AFD7ED558CCD & mask) >> 40) % (quality.BUCKETS - 1)

    def plain(text):
        out, cps = [], [quality._MARK] + [quality._MARK if c in "\t\n\x0b\f\r " else ord(c) for c in text] + [quality._MARK]
        for n in (3, 4, 5):
            for i in range(len(cps) - n + 1):
                g = cps[i : i + n]
                if quality._MARK not in g[1:-1]:
                    h = 0
                    for c in g:
                        h = (h * 0x100000001B3 + c) & mask
                    out.append(mix(h, n))
        words = "".join(" " if c == quality._MARK else chr(c) for c in cps).split(" ")
        hashes = []
        for w in filter(None, words):
            h, p = 0, 1
            for c in w:
                h, p = (h + ord(c) * p) & mask, p * quality._BASE & mask
            hashes.append(h)
            out.append(mix(h, 1))
        return sorted(out + [quality.BUCKETS - 1 for a, b in zip(hashes, hashes[1:]) if a == b])

    for text in ("one two two three", "a", " é𝒳 é𝒳\n\nb ", "x" * 40, "tab\tand  space"):
        got = sorted(int(x) for _, what in quality.blocks([text]) for x in what)
        assert got == plain(text), text
    both = np.concatenate([owner for owner, _ in quality.blocks(["one", None, "two"])])
    assert set(both.tolist()) == {0, 2}
