"""Predictions against gold texts and against the dialogue they come from, word by word.

Words are what ``norm`` leaves between spaces.  ``matched`` counts the words that gold and prediction have
in common in one order (a longest common subsequence), in Arrow batches: a bit for each gold word, all of them
moved by one addition for each predicted word.  ``foreign`` gives runs of predicted words that stand nowhere
in the dialogue, and ``slots`` compares numeric slots; both are built-in expressions.

Defined cases: null texts have no words; a share of nothing is null, so that a domain without predicted words
has no precision.  Very long texts are single rows, with time of the product of both lengths over 64.  Repeated
words count as often as they stand.  Further columns stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import nfc, norm, numbers


def words(c: Column) -> Column:
    return F.filter(F.split(norm(nfc(F.coalesce(c, F.lit("")))), " "), lambda w: w != "")


def common(gold: list[str], pred: list[str]) -> int:
    """Length of the longest common subsequence.  Bit i of row is 0 where the best up to gold word i is one more than up to the word before."""
    at: dict[str, int] = {}
    for i, w in enumerate(gold):
        at[w] = at.get(w, 0) | 1 << i
    full = row = (1 << len(gold)) - 1
    for w in pred:
        hit = row & at.get(w, 0)
        row = (row + hit | row - hit) & full
    return len(gold) - row.bit_count()


def matched(df: DataFrame, gold: str, pred: str, name: str = "matched") -> DataFrame:
    """df with the number of words that its arrays gold and pred have in common in one order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [common(g or [], p or []) for g, p in zip(b.column(b.schema.get_field_index(gold)).to_pylist(), b.column(b.schema.get_field_index(pred)).to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(n, pa.int32())], names=[*b.schema.names, name])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(run, f"{schema}, `{name}` int")


def foreign(pred: Column, source: Column) -> Column:
    """Runs of words of pred (an array) that are not in source (an array), as texts in order."""
    new = F.array_except(pred, source)
    marked = F.array_join(F.transform(pred, lambda w: F.when(F.array_contains(new, w), w).otherwise("\n")), " ")
    return F.filter(F.transform(F.split(marked, "\n"), lambda x: F.trim(x)), lambda x: x != "")


def slots(gold: Column, pred: Column) -> tuple[Column, Column, Column]:
    """Numeric slots of both texts, and those of both: three counts."""
    g, p = numbers(F.coalesce(gold, F.lit(""))), numbers(F.coalesce(pred, F.lit("")))
    return F.size(g), F.size(p), F.size(F.array_intersect(g, p))


def compared(df: DataFrame, gold: str, pred: str, source: str) -> DataFrame:
    """df with gold_words, pred_words, matched, foreign (texts), foreign_words, gold_slots, pred_slots and both_slots of its texts."""
    df = df.withColumn("__g", words(F.col(gold))).withColumn("__p", words(F.col(pred))).withColumn("__s", words(F.col(source)))
    df = matched(df, "__g", "__p").withColumn("foreign", foreign(F.col("__p"), F.col("__s")))
    g, p, both = slots(F.col(gold), F.col(pred))
    split = F.transform("foreign", lambda x: F.size(F.split(x, " ")))
    return df.select(
        *[c for c in df.columns if not c.startswith("__") and c not in ("matched", "foreign")], F.size("__g").alias("gold_words"), F.size("__p").alias("pred_words"), "matched", "foreign",
        F.aggregate(split, F.lit(0), lambda a, n: a + n).alias("foreign_words"), g.alias("gold_slots"), p.alias("pred_slots"), both.alias("both_slots"),
    )


def report(df: DataFrame, *by: str) -> DataFrame:
    """Over all rows of a group: precision, recall and F1 of words and of numeric slots, and how much of the predictions is foreign to the dialogue."""
    share = lambda a, b: F.try_divide(F.sum(a).cast("double"), F.sum(b))
    both = lambda m, a, b: F.try_divide(2.0 * F.sum(m), F.sum(a) + F.sum(b))
    return df.groupBy(*by).agg(
        F.count("*").alias("n"), share("matched", "pred_words").alias("word_precision"), share("matched", "gold_words").alias("word_recall"), both("matched", "gold_words", "pred_words").alias("word_f1"),
        share("both_slots", "pred_slots").alias("slot_precision"), share("both_slots", "gold_slots").alias("slot_recall"), both("both_slots", "gold_slots", "pred_slots").alias("slot_f1"),
        F.avg((F.size("foreign") > 0).cast("double")).alias("hallucinated"), share("foreign_words", "pred_words").alias("foreign_share"),
    )
