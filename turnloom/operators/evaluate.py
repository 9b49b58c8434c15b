"""Evaluation: predictions and scores meet records by id, never by position in a file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import percent
from ..storage import stored


def models_by_records(models: list[str], records: DataFrame) -> DataFrame:
    """Each record for each model; the list of models is short."""
    return records.withColumn("model", F.explode(F.array(*map(F.lit, models))))


def zipped(records: DataFrame, *others: DataFrame, on: str | list[str] = "row_id") -> DataFrame:
    for x in others:
        records = records.join(x, on, "left")
    return records


def accuracy(df: DataFrame) -> DataFrame:
    """model, pattern (null: all), n, accuracy; a missing score counts as 0."""
    return df.rollup("model", "pattern").agg(F.count("*").alias("n"), F.avg(F.coalesce("score", F.lit(0)).cast("double")).alias("accuracy"), F.grouping_id().alias("g")).filter("g < 3").drop("g")


def side_by_side(df: DataFrame, models: dict[str, str], key: str = "row_id", *keep: str) -> DataFrame:
    """A row for each record with each model's output in a column (models: name to column) and the columns of keep."""
    out = [F.max(F.when(F.col("model") == m, F.col("output"))).alias(c) for m, c in models.items()]
    return df.groupBy(key).agg(*[F.max(c).alias(c) for c in keep], *out)


def report(df: DataFrame) -> DataFrame:
    """Counts by context_required, by user_turns and by domain in one pass; by names the grouping."""
    cols = ["context_required", "user_turns", "domain"]
    got = df.select(F.col("context_required").cast("string").alias(cols[0]), F.col("user_turns").cast("string").alias(cols[1]), F.col("domain").alias(cols[2]))
    got = got.groupingSets([[c] for c in cols], *cols).agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    by = F.when(F.col("g") == 3, cols[0]).when(F.col("g") == 5, cols[1]).otherwise(cols[2])
    return got.select(by.alias("by"), F.coalesce(*cols).alias("value"), "n")


def shares(df: DataFrame, *by: str) -> DataFrame:
    """Counts with their share of all rows and that as a text; rows are counted once, and their sum is one number."""
    got = stored(df.groupBy(*by).agg(F.count("*").alias("n")), "shares")
    share = F.col("n") / F.lit(got.agg(F.sum("n")).first()[0])
    return got.withColumn("share", share).withColumn("percent", percent(share))


def outcomes(df: DataFrame, done: Column, names: tuple[str, str]) -> DataFrame:
    """One row: how many rows were done and how many not (converted and skipped, kept and dropped)."""
    done = F.coalesce(done, F.lit(False))
    return df.agg(F.count_if(done).alias(names[0]), F.count_if(~done).alias(names[1]))


def call_report(calls: DataFrame, accepted: int, seconds: float) -> DataFrame:
    """One row from calls (ok): ok, failed, success (their share, text), accepted, samples_per_second; no calls count as none of one."""
    n_ok, n_all = F.count_if("ok"), F.count("*")
    return calls.agg(
        n_ok.alias("ok"), (n_all - n_ok).alias("failed"), percent(n_ok / F.greatest(n_all, F.lit(1)), 0).alias("success"), F.lit(accepted).cast("long").alias("accepted"),
        F.lit(accepted / max(seconds, 1.0)).alias("samples_per_second"),
    )


def distribution(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n"))


def rule_baseline(last_user: Column, context: Column) -> Column:
    """A last turn that is only a temperature, after talk of the air conditioning, becomes a request; else it stays."""
    n = F.regexp_extract(last_user, r"(\d+)", 1)
    only = last_user.rlike(r"(?U)^\D*\d+\s*(độ|độ C)?\D{0,12}$") & (n != "")
    return F.when(only & context.rlike("(?iU)điều h[oò]|máy lạnh|AC"), F.concat(F.lit("Đặt điều hòa ở "), n, F.lit(" độ."))).otherwise(last_user)


def without_system(dialogue: Column) -> Column:
    return F.filter(dialogue, lambda t: t["role"] != "system")
