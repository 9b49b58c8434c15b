"""Prompts for a generator hook, as string columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clause
from ..hooks import called
from ..operators.validate import bulk_reason
from ..sources.ingest import recovered, samples


def skeleton(user_turns: Column) -> Column:
    """user → bot → ... → user."""
    return F.array_join(F.concat(F.flatten(F.array_repeat(F.array(F.lit("user"), F.lit("bot")), (user_turns - 1).cast("int"))), F.array(F.lit("user"))), " → ")


def prompt(shots: Column, domains: Column, user_turns: Column, context_required: Column, n: Column, seed: Column) -> Column:
    """Examples (JSON text), the form of a sample, the domains wanted and a seed."""
    kind = F.when(context_required, "the last turn needs the turns before it").otherwise("the last turn stands alone")
    return F.concat(
        F.when(shots != "", F.concat(F.lit("Examples of style, not to be repeated:\n"), shots, F.lit("\n\n"))).otherwise(""),
        F.lit('Answer with {"samples": [...]} of '), n.cast("string"), F.lit(" objects with turns, rewrite, domain and rationale. Turns: "), skeleton(user_turns),
        F.lit("; "), kind, F.lit(". Domains: "), F.array_join(domains, ", "), F.lit(". Seed "), seed.cast("string"), F.lit("."),
    )


def navigation_request(opening: Column, place: Column, preference: Column, departure: Column) -> Column:
    """The rewrite of a request for a way; preference and departure only where there are any."""
    return F.concat(opening, F.lit(" "), place, clause(", ưu tiên ", preference), clause(" và khởi hành ", departure), F.lit("."))


#: Buckets of a smoke run (fixed values): context_required, user turns.
SMOKE = ((True, 2), (True, 3), (False, 1), (False, 2))


def smoke(spark: SparkSession, make: Callable[[], Callable[[str], str | None]], domain: str = "navigation") -> DataFrame:
    """One call for each of four buckets: the samples of the replies with their reason, null for those that are kept."""
    df = spark.createDataFrame(list(SMOKE), "context_required boolean, want int")
    asked = df.withColumn("prompt", prompt(F.lit(""), F.array(F.lit(domain)), F.col("want"), F.col("context_required"), F.lit(1), F.lit(1)))
    got = samples(recovered(called(asked, "prompt", make).filter("ok").select(F.col("context_required").alias("ctx"), "want", "reply"), "reply"))
    return got.select("ctx", "want", "pos", "turns", "rewrite", bulk_reason(F.col("turns"), F.col("rewrite"), F.col("domain"), F.col("ctx"), F.col("want")).alias("reason"))
