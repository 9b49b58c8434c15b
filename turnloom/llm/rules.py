"""Quality rules of documents and of their hosts (native).

Rules of a document are computed from arrays inside its row.  The hash of a window of 8 words
is built by doubling: hashes of words, of pairs, of fours, of eights, each from two of the
former.  Too few words or too many repeated ones fail a document by itself (``base_failed``).
Four rules more are too weak for that, but count for its host: too many symbols, repeated lines,
words too short or too long.  Failures are summed by host; each host's rate is shrunk with a beta
prior that is fitted, by moments, to the other hosts (a bad host is not part of what it is held
against), and a host is rejected when two deviations of its posterior still leave it above the
prior's mean by two deviations of the prior.  Verdicts are joined back to documents.

Defined cases: a null or empty text has no words and fails (fewer than 20 words).  A very long
text is one row with arrays of its words.  A null host gets no verdict, so the document's own
rules decide; a single host has no others to be held against and stays.  Repeated rows each count.
Without rows the result is empty.  Further columns are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import SPACE, space_words, stored

RUN = 8
#: Rules that count for a host: symbols a word, share of repeated lines, characters a word (least, most), in whole numbers.
SYMBOLS, LINES, SHORT, LONG = (1, 10), (3, 10), 3, 10
#: Deviations, of the host's posterior and of the prior.
DEVIATIONS = 2.0
#: Most rejected hosts that are broadcast; more are joined with salted keys.
BROADCAST_HOSTS = 50_000
SALTS = 32


def _doubled(h: Column, step: int) -> Column:
    return F.zip_with(h, F.slice(h, step + 1, F.greatest(F.size(h) - step, F.lit(0))), lambda a, b: F.xxhash64(a, b))


def features(docs: DataFrame, host: str = "source") -> DataFrame:
    """doc_id, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, failed (any rule)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = docs.select(
        "doc_id",
        F.col(host).alias("host"),
        space_words(F.col("text")).alias("w"),
        (F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        lines.alias("lines"),
    )
    df = df.select(
        "doc_id", "host", F.length(F.array_join("w", "")).cast("long").alias("word_chars"), "n_symbols", F.size("lines").alias("n_lines"),
        F.size("w").cast("long").alias("n_words"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("w", lambda x: F.xxhash64(x)).alias("h"),
    )
    for step in (1, 2, 4):
        df = df.withColumn("h", _doubled(F.col("h"), step))
    df = df.withColumn("h", F.slice("h", 1, F.greatest(F.size("h") - (RUN - 1), F.lit(0))))
    df = df.withColumn("twice", F.size(F.array_distinct("h")) < F.size("h"))
    df = df.withColumn("s", F.when(F.col("twice"), F.array_sort(F.transform("h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    at = lambda a, i: F.get(F.col(a), i)
    df = df.withColumn(
        "p",
        F.when(
            F.col("twice"),
            F.array_sort(F.transform(F.filter("s", lambda x, i: F.coalesce(at("s", i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(at("s", i + 1)["h"] == x["h"], F.lit(False))), lambda x: x["i"])),
        ),
    )
    covered = F.aggregate(F.transform("p", lambda x, i: F.least(F.lit(RUN), F.coalesce(at("p", i + 1) - x, F.lit(RUN)))), F.lit(0), lambda a, b: a + b)
    df = df.select(
        "doc_id", "host", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines",
        F.when(F.col("twice"), covered).otherwise(0).cast("long").alias("n_repeat_words"),
    ).withColumn("base_failed", (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30))
    n, chars = F.col("n_words"), F.col("word_chars")
    weak = (F.col("n_symbols") * SYMBOLS[1] > n * SYMBOLS[0]) | (F.col("n_dup_lines") * LINES[1] > F.col("n_lines") * LINES[0]) | (chars < n * SHORT) | (chars > n * LONG)
    return df.withColumn("failed", F.col("base_failed") | weak).drop("n_lines")


def host_verdicts(rows: DataFrame, deviations: float = DEVIATIONS) -> DataFrame:
    """host, n, failed, rate (shrunk), bound, rejected: for rows with host and failed."""
    hosts = rows.filter(F.col("host").isNotNull()).groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("failed").cast("long")).alias("failed"))
    r, inv = F.col("failed") / F.col("n"), 1 / F.col("n")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    all_ = hosts.agg(F.count("*").alias("k"), zero(F.sum("n")).alias("n"), zero(F.sum("failed")).alias("failed"), zero(F.sum(r)).alias("r"), zero(F.sum(r * r)).alias("r2"), zero(F.sum(inv)).alias("inv")).first()
    k = all_["k"] - 1
    if k < 1:
        return hosts.select("host", "n", "failed", r.alias("rate"), F.lit(1.0).alias("bound"), F.lit(False).alias("rejected"))
    share = lambda name, own: (F.lit(float(all_[name])) - own) / k  # noqa: E731  of the other hosts
    mean = F.least(F.greatest((F.lit(float(all_["failed"])) - F.col("failed")) / (F.lit(float(all_["n"])) - F.col("n")), F.lit(1e-3)), F.lit(1 - 1e-3))
    mean, strength = prior(mean, share("r2", r * r) - share("r", r) * share("r", r), share("inv", inv))
    got = hosts.withColumns({"__mean": mean, "__strength": strength})
    mean, strength = F.col("__mean"), F.col("__strength")
    rate = (F.col("failed") + mean * strength) / (F.col("n") + strength)
    own, of_all = F.sqrt(rate * (1 - rate) / (F.col("n") + strength + 1)), F.sqrt(mean * (1 - mean) / (strength + 1))
    return got.select("host", "n", "failed", rate.alias("rate"), (mean + deviations * of_all).alias("bound"), (rate - deviations * own > mean + deviations * of_all).alias("rejected"))


def prior(mean: Column, var: Column, inv: Column) -> tuple[Column, Column]:
    """Mean and strength (a + b) of a beta prior by moments: the variance between hosts, without that of
    counting.  inv: the mean of 1/n over hosts.  Bounded, so that few hosts or equal rates still give one."""
    spread = F.greatest(var - mean * (1 - mean) * inv, F.lit(1e-6))
    return mean, F.least(F.greatest(mean * (1 - mean) / spread - 1, F.lit(2.0)), F.lit(1000.0))


def judge(docs: DataFrame, host: str = "source", deviations: float = DEVIATIONS) -> DataFrame:
    """features() with base_failed and kept."""
    rows = stored(features(docs, host), "rules")
    bad = stored(host_verdicts(rows, deviations).filter("rejected").select("host"), "rules-hosts")
    if bad.count() <= BROADCAST_HOSTS:
        out = rows.join(F.broadcast(bad.withColumn("bad", F.lit(True))), "host", "left")
    else:
        salted = bad.select("host", F.lit(True).alias("bad"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        out = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"], "left")
    return out.withColumn("kept", ~F.col("base_failed") & F.col("bad").isNull()).drop("bad", "salt", "failed")


def op6(docs: DataFrame) -> DataFrame:
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
