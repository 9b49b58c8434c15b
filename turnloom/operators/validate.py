"""Validators.  Each gives the first failing rule as a column, null for an accepted row; all
are built-in expressions but NFC, which goes to Python in one Arrow pass, and there only for
text that it may change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import COMPOUND_MARKERS, NEGATION_MARKERS, digit_runs, has_marker, nfc, norm, numbers, text_of, token_count, within
from ..schema import PATTERNS
from .dedup import sized
from .dialogue import last_user, users


def _first(*rules: tuple[str, Column]) -> Column:
    out = None
    for reason, bad in rules:
        out = F.when(bad, reason) if out is None else out.when(bad, reason)
    return out


def _turn_reason(turns: Column, bad: str, alternate: bool) -> Column:
    """The reason of the earliest turn that is wrong; in a turn: no object, role or content, same role as before."""

    def reason(t: Column, i: Column) -> Column:
        rules = [("turn_not_dict", t.isNull()), (bad, F.coalesce(~t["role"].isin("user", "bot"), F.lit(True)) | (text_of(t["content"]) == ""))]
        if alternate:
            rules.append(("not_alternating", F.get(turns, i - 1)["role"] == t["role"]))
        return _first(*rules)

    return F.get(F.filter(F.transform(turns, reason), lambda r: r.isNotNull()), F.lit(0))


def _text(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: t["content"]), " ")


def bench_reason(turns: Column, rewrite: Column, domain: Column, pattern: Column, context_required: Column | None = None, present: Column | None = None, min_turns: int = 3) -> Column:
    """Rules for benchmark samples.  A sample whose context_required is false may have one turn and may repeat it."""
    free = F.lit(False) if context_required is None else context_required.eqNullSafe(F.lit(False))
    r, last = text_of(rewrite), F.try_element_at(turns, F.lit(-1))
    said, own = numbers(_text(turns)), numbers(_text(users(turns)))
    used = numbers(r)
    leaked = F.size(F.array_intersect(used, F.array_except(said, own))) > 0
    in_turn = _turn_reason(turns, "bad_role_or_empty", False)
    return _first(
        ("not_dict", F.lit(False) if present is None else ~present),
        ("too_few_turns", turns.isNull() | (F.size(turns) < F.when(free, 1).otherwise(min_turns))),
        ("missing_field", (r == "") | (text_of(domain) == "")),
        ("rewrite_length", ~F.char_length(r).between(5, 240)),
        ("turn_not_dict", in_turn == "turn_not_dict"),
        ("bad_role_or_empty", in_turn == "bad_role_or_empty"),
        ("not_ending_user", last["role"] != "user"),
        ("final_user_too_long", token_count(last["content"]) > 25),
        ("rewrite_equals_final_turn", ~free & (norm(nfc(r)) == norm(nfc(last["content"])))),
        ("hallucinated_numbers", ~within(used, said)),
        ("leaked_bot_number", (pattern == "irrelevant_context") & leaked),
        ("negation_marker_missing", (pattern == "negation") & ~has_marker(r, NEGATION_MARKERS)),
        ("compound_connector_missing", (pattern == "compound_intent") & ~has_marker(r, COMPOUND_MARKERS)),
    )


def ingest_reason(turns: Column, rewrite: Column, domain: Column, pattern: Column, context_required: Column, present: Column | None = None) -> Column:
    """bench_reason after the gate on the pattern."""
    p = text_of(pattern)
    return F.when(p == "", "no_pattern").when(~p.isin(*PATTERNS), "bad_pattern").otherwise(bench_reason(turns, rewrite, domain, p, context_required, present))


def bulk_reason(turns: Column, rewrite: Column, domain: Column, context_required: Column, want_user_turns: Column, present: Column | None = None) -> Column:
    """Rules for bulk samples of a bucket (context_required, user turns)."""
    r = text_of(rewrite)
    in_turn = _turn_reason(turns, "bad_turn", True)
    last = F.try_element_at(turns, F.lit(-1))
    return _first(
        ("not_dict", F.lit(False) if present is None else ~present),
        ("missing_field", turns.isNull() | (r == "") | (text_of(domain) == "")),
        ("rewrite_length", ~F.char_length(r).between(5, 240)),
        ("turn_not_dict", in_turn == "turn_not_dict"),
        ("bad_turn", in_turn == "bad_turn"),
        ("not_alternating", in_turn == "not_alternating"),
        ("not_start_user", (F.size(turns) == 0) | (F.get(turns, F.lit(0))["role"] != "user")),
        ("not_end_user", last["role"] != "user"),
        ("wrong_user_turns", F.size(users(turns)) != want_user_turns),
        ("hallucinated_number", ~within(numbers(r), numbers(_text(turns)))),
        ("ctx_but_identical", context_required & (norm(nfc(r)) == norm(nfc(last_user(turns))))),
        ("noctx_pulled_number", ~context_required & ~within(numbers(r), numbers(last_user(turns)))),
    )


def variant_ok(dialogue: Column, rewrite: Column, other: Column, other_rewrite: Column) -> Column:
    """Whether a paraphrase (other: array of struct(from, value)) may stand for the original."""
    pairs = F.zip_with(dialogue, other, lambda a, b: (a["from"] == b["from"]) & (text_of(b["value"]) != ""))
    same = F.forall(F.zip_with(dialogue, other, lambda a, b: a["value"] == b["value"]), lambda x: F.coalesce(x, F.lit(False)))
    r = text_of(other_rewrite)
    return F.coalesce(
        other.isNotNull() & (r != "") & (F.size(dialogue) == F.size(other)) & F.forall(pairs, lambda x: F.coalesce(x, F.lit(False)))
        & (F.element_at(other, -1)["from"] == "human") & within(digit_runs(rewrite), digit_runs(r)) & ~((r == rewrite) & same),
        F.lit(False),
    )


def qc_verdict(soft: Column, hard: Column) -> Column:
    """soft: how many of the ten soft criteria hold; hard: whether any hard one fails."""
    return F.when(hard, "drop").when(soft < 8, "fix").otherwise("keep")


def difficulty(score: Column) -> Column:
    """What a weak model's score says: solved samples are too easy; without a score they stay."""
    return F.when(score.isNull(), "judge_error").when(score == 1, "rejected_too_easy").otherwise("kept_hard")


def counters(df: DataFrame, reason: str = "reason") -> DataFrame:
    return df.filter(F.col(reason).isNotNull()).groupBy(reason).agg(F.count("*").alias("n")).orderBy(F.desc("n"), reason)


def ingest_stats(df: DataFrame, key: list[str], order: list[str], reason: str = "reason", files: str | None = None) -> DataFrame:
    """One row: raw, no_pattern, bad_pattern, rejected, duplicate, kept, share of context_required (and files),
    from rows with reason; of accepted rows with one key the first is kept.  Rows are summed by key and
    reason before the shuffle, so a key that most rows have is no burden."""
    r, n = F.col(reason), F.sum("n")
    named = sized(df, [*key, reason], order, "context_required")
    none = F.lit(0).cast("long")
    out = named.agg(
        F.coalesce(n, none).alias("raw"), *[F.coalesce(F.sum(F.when(cond, F.col("n"))), none).alias(name) for name, cond in (
            ("no_pattern", r == "no_pattern"), ("bad_pattern", r == "bad_pattern"), ("rejected", r.isNotNull() & ~r.isin("no_pattern", "bad_pattern")))],
        F.coalesce(F.sum(F.when(r.isNull(), F.col("n") - 1)), none).alias("duplicate"), F.count_if(r.isNull()).alias("kept"),
        F.avg(F.when(r.isNull(), F.col("context_required").cast("double"))).alias("context_share"),
    )
    return out if files is None else out.withColumn("files", F.lit(df.agg(F.count_distinct(files)).first()[0]))


def known_patterns(patterns: list[str] | None) -> list[str]:
    """Those asked for, all if none are; ValueError for one that is not known."""
    if unknown := [p for p in patterns or () if p not in PATTERNS]:
        raise ValueError(f"unknown patterns {unknown}; known are {list(PATTERNS)}")
    return list(patterns or PATTERNS)
