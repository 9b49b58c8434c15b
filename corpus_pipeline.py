"""The training-data pipeline: documents through five stages, each a written table.

A stage takes (spark, docs, sf_dir) and works on all rows of docs; its result is written as
Parquet into the shared folder and read again as the next one's docs.  All but the last return
the columns of documents; further columns, whatever their names, stay with their rows.  An empty
table goes through as an empty one, very long texts as whole rows.  What a stage stored on its way,
and its input, are removed once its own result is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from turnloom import storage
from turnloom.llm import decontam, packing, pii, quality, simhash
from turnloom.llm.shared import stored, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score of 0.3 or more stay.  A null or empty text has the score of the intercept; rows with one text
    have one score, so repeated rows stay or go together; without labels of both classes the share of class 1 decides.
    Rows with a null doc_id are scored as others."""
    return quality.keep(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked fingerprints one row stays: that with the smallest doc_id (null ids last), of one id with
    several texts that with the smallest text hash, of rows repeated whole any one.  Null and empty texts and those of
    white space have the fingerprint 0 and are one group.  Which documents are linked is fixed by the fingerprint (3-word
    shingles, 3 bits), so near copies that changed more than that stay: see the README for figures."""
    return simhash.dedup(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go, each repeated row of them.  Null and empty texts have no words and stay; items without
    words contaminate nothing, an empty benchmark lets all stay."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data become [KIND]; n_chars follows the text.  All rows stay, repeated ones too; a null text stays
    null, an empty one empty."""
    return pii.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens, a row for each piece of a document.  A null or empty text has only the end id, a
    repeated row is packed again, a null doc_id stays null; without rows there are no pieces."""
    return packing.op5(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("private_data", private_data),
    ("packing", pack),
]

#: SQL can't express the classifier, the fingerprints or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        before = len(storage.written)
        docs = stored(stage(spark, docs, sf_dir), name)
        storage.remove(spark, *last, *storage.written[before:-1])
        last = [storage.written[-1]]
    return STAGES[-1][1](spark, docs, sf_dir)
