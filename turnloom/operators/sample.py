"""Shuffles, quotas, caps and splits, all by hash: reproducible, and the same in any engine.

Counts of groups are small tables (a row for each stratum or bucket, or for a band of hashes in
it); no task ranks all rows of a group.  ``hashed`` order ends in the key, so ranks are total.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import hashed
from ..storage import stored
from .rowids import running

#: The share of samples that need context, and how many user turns samples have.
CONTEXT_SHARE = 2 / 3
TURN_SHARES = {True: {2: 0.45, 3: 0.35, 4: 0.20}, False: {1: 0.55, 2: 0.45}}


#: Most buckets whose plan is broadcast.
FEW_BUCKETS = 100_000


def shuffled(df: DataFrame, key: str, salt: str) -> DataFrame:
    return df.withColumn("h", hashed(F.col(key), salt)).orderBy("h", key)


def take(df: DataFrame, n: int, key: str, salt: str) -> DataFrame:
    """n rows in hash order."""
    return shuffled(df, key, salt).limit(n)


def rank_in(df: DataFrame, group: list[str], key: str, salt: str, name: str = "rn", total: str | None = None) -> DataFrame:
    """Rows with their rank in hash order inside the group (and the group's size).  A group may hold
    most rows: hashes are cut into 4,096 bands, rows are ranked inside group and band, and the
    bands' sizes, summed, give what stands before each."""
    h = hashed(F.col(key), salt)
    df = df.withColumn("__h", h).withColumn("__band", F.shiftright("__h", 20))
    own = Window.partitionBy(*[f"__{i}" for i in range(len(group))])
    sizes = df.groupBy(*[F.col(c).alias(f"__{i}") for i, c in enumerate(group)], F.col("__band").alias("__b")).agg(F.count("*").alias("__size"))
    sizes = sizes.withColumn("__before", F.sum("__size").over(own.orderBy("__b")) - F.col("__size")).withColumn("__all", F.sum("__size").over(own))
    ranks = df.withColumn("__rank", F.row_number().over(Window.partitionBy(*group, "__band").orderBy("__h", key)))
    on = F.col("__band") == F.col("__b")
    for i, c in enumerate(group):
        on = on & F.col(c).eqNullSafe(F.col(f"__{i}"))
    out = ranks.join(sizes, on).withColumn(name, F.col("__rank") + F.col("__before"))
    out = out.withColumn(total, F.col("__all")) if total else out
    return out.drop("__h", "__band", "__b", "__size", "__before", "__all", "__rank", *[f"__{i}" for i in range(len(group))])


#: Most rows of a group that Spark's own limit inside groups (a partial limit before the shuffle) covers, and the parts that
#: groups with more are cut into, level by level: a task of the last levels meets at most the rows asked for from each part.
SPARK_GROUP_LIMIT, PARTS = 1000, (4096, 64, 1)


def heads(df: DataFrame, group: list[str], n: int, order: list[Column | str], name: str = "__rn") -> DataFrame:
    """The first n rows of each group by order, with their rank.  A group may hold most rows.  Up to Spark's limit each task passes
    on no more than n of a group; beyond it rows are cut by hash of their order into parts, each part to its first n rows,
    and parts of parts likewise.  Rows of equal order are told apart by chance; let order end in a unique column."""
    part = F.xxhash64(*order)
    for parts in PARTS if n > SPARK_GROUP_LIMIT else PARTS[-1:]:
        by = [*group, F.pmod(part, F.lit(parts))] if parts > 1 else group
        df = df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col(name) <= n)
    return df


def stratum(domain: Column, context_required: Column) -> Column:
    """domain|true, domain|false or domain|na."""
    return F.concat_ws("|", F.coalesce(domain, F.lit("unknown")), F.coalesce(context_required.cast("string"), F.lit("na")))


def split(df: DataFrame, by: str, key: str, salt: str = "split", valid: float = 0.1, train: float = 0.8) -> DataFrame:
    """Rows with split.  In each stratum of n: round(n * valid) are valid (1 if that is none and
    n >= 3), then round(n * train) train as far as there are rows, the rest test; half to even."""
    df = rank_in(df, [by], key, salt, total="n")
    v = F.bround(F.col("n") * valid).cast("int")
    v = F.when((v == 0) & (F.col("n") >= 3), 1).otherwise(v)
    t = F.least(F.bround(F.col("n") * train).cast("int"), F.col("n") - v)
    return df.withColumn("split", F.when(F.col("rn") <= t, "train").when(F.col("rn") <= t + v, "valid").otherwise("test")).drop("n", "rn")


def downsampled(df: DataFrame, group: str, target: int, key: str, salt: str) -> DataFrame:
    """If there are more than target rows: max(1, target // groups) of each group, then rows of the
    remainder up to target."""
    n, groups = df.agg(F.count("*"), F.count_distinct(group)).first()
    if n <= target:
        return df
    each = max(1, target // groups)
    first = rank_in(df, [group], key, salt)
    got = first.filter(F.col("rn") <= each).drop("rn")
    sizes = first.groupBy(group).agg(F.least(F.count("*"), F.lit(each)).alias("n")).agg(F.sum("n")).first()[0]
    if sizes >= target:
        return take(got, target, key, salt)
    rest = take(first.filter(F.col("rn") > each).drop("rn"), target - sizes, key, salt + "-rest").drop("h")
    return got.unionByName(rest)


def ratio_plan(need: int, free: int, target: int) -> tuple[int, int]:
    """How many rows that need context, and how many that don't, for two to one."""
    if target > 0:
        n_free = min(free, target // 3)
        return min(need, target - n_free), n_free
    n_free = min(free, need // 2)
    return 2 * n_free, n_free


def ratio_balanced(df: DataFrame, flag: str, target: int, key: str, salt: str) -> DataFrame:
    need, free = df.agg(F.count_if(F.col(flag)), F.count_if(~F.col(flag))).first()
    a, b = ratio_plan(need, free, target)
    return rank_in(df, [flag], key, salt).filter(F.col("rn") <= F.when(F.col(flag), a).otherwise(b)).drop("rn")


def quota_plan(total: int, share: float = CONTEXT_SHARE) -> dict[tuple[bool, int], int]:
    """Rows for each bucket (context_required, user turns); what rounding leaves goes to the largest count of turns."""
    out = {}
    with_context = round(total * share)
    for flag, n in ((True, with_context), (False, total - with_context)):
        parts = {k: round(n * s) for k, s in TURN_SHARES[flag].items()}
        parts[max(parts)] += n - sum(parts.values())
        out |= {(flag, k): v for k, v in parts.items()}
    return out


def quota_table(spark: SparkSession, plan: dict[tuple[bool, int], int]) -> DataFrame:
    return spark.createDataFrame([(*k, v) for k, v in plan.items()], "context_required boolean, user_turns int, quota int")


def deficits(quota: DataFrame, have: DataFrame, each: Column, oversample: float) -> DataFrame:
    """For each bucket: have, need and the calls that need asks for, of so many samples each."""
    got = have.groupBy("context_required", "user_turns").agg(F.count("*").alias("have"))
    df = quota.join(got, ["context_required", "user_turns"], "left").withColumn("have", F.coalesce("have", F.lit(0)))
    df = df.withColumn("need", F.greatest(F.lit(0), F.col("quota") - F.col("have")))
    return df.withColumn("calls", F.when(F.col("need") > 0, F.greatest(F.lit(1), F.ceil(F.col("need") * oversample / each))).otherwise(0))


def batches_needed(deficit: int, size: int, oversample: float) -> int:
    return max(1, int((deficit * oversample + size - 1) // size))


def batches(deficit: Column, size: int, oversample: float) -> Column:
    """``batches_needed`` for each row."""
    return F.greatest(F.lit(1).cast("long"), F.floor((deficit * oversample + (size - 1)) / size))


def samples_per_call(user_turns: Column, default: int = 4, long: int = 2) -> Column:
    return F.when(user_turns >= 4, long).when(user_turns == 3, 3).otherwise(default)


def cap_plan(sizes: list[tuple[tuple, int]], quota: dict[tuple, int], cap: int) -> dict[tuple, int]:
    """How many of each bucket (in order of first sight) to take: the quota, then what is missing
    from the largest surplus on, or what is too much from the largest take on."""
    got = {b: min(n, quota.get(b, 0)) for b, n in sizes}
    missing = cap - sum(got.values())
    spare = {b: n - got[b] for b, n in sizes} if missing > 0 else dict(got)
    for b in sorted(spare, key=spare.get, reverse=True):
        step = min(spare[b], abs(missing))
        got[b] += step if missing > 0 else -step
        missing += -step if missing > 0 else step
        if not missing:
            break
    return got


def cap_takes(sizes: DataFrame, cap: int) -> DataFrame:
    """``cap_plan`` where there are many buckets: sizes (n, first, quota) with take.  What stands before a bucket in the order of its
    spare rows comes from prefix sums, so no task and not the driver sees all buckets."""
    got = sizes.withColumn("take", F.least("n", F.coalesce("quota", F.lit(0).cast("long"))))
    missing = cap - (got.agg(F.sum("take")).first()[0] or 0)
    got = got.withColumn("spare", F.col("n") - F.col("take") if missing > 0 else F.col("take"))
    got = running(got, [F.desc("spare"), F.asc("first")], "spare", "before")
    step = F.least(F.col("spare"), F.greatest(F.lit(0), F.lit(abs(missing)) - F.col("before")))
    return got.withColumn("take", F.col("take") + step if missing > 0 else F.col("take") - step).drop("spare", "before", "quota")


def capped(df: DataFrame, bucket: list[str], quota: dict[tuple, int], cap: int, order: str) -> DataFrame:
    """At most cap rows, by cap_plan; in a bucket the first by order."""
    kinds = dict(df.dtypes)
    names = ", ".join(f"`{c}` {kinds[c]}" for c in bucket)
    sizes = stored(df.groupBy(*bucket).agg(F.count("*").alias("n"), F.min(order).alias("first")), "capped")
    spark, few = df.sparkSession, sizes.count() <= FEW_BUCKETS
    if few:
        rows = sizes.orderBy("first").collect()
        plan = cap_plan([(tuple(r[c] for c in bucket), r["n"]) for r in rows], quota, cap)
        takes = spark.createDataFrame([(*k, v) for k, v in plan.items()], f"{names}, take long")
    else:
        quotas = spark.createDataFrame([(*k, v) for k, v in quota.items()], f"{names}, quota long")
        takes = stored(cap_takes(_joined(sizes, quotas, bucket, "left"), cap).select(*bucket, "take"), "capped")
    most = takes.agg(F.max("take")).first()[0]
    if not most:
        return df.limit(0)
    return _joined(heads(df, bucket, most, [order], "__rn"), F.broadcast(takes) if few else takes, bucket).filter("__rn <= take").select(*df.columns)


def few_shots(pool: DataFrame, context_required: bool, user_turns: int, k: int, order: str, salt: str = "shots") -> DataFrame:
    """k of the first max(3k, 6) of the pool with that context_required (of all if there are none), those with that many user turns first."""
    same = pool.filter(F.col("context_required") == context_required)
    chosen = pool if same.isEmpty() else same
    first = chosen.orderBy(F.when(F.col("user_turns") == user_turns, 0).otherwise(1), order).limit(max(3 * k, 6))
    return take(first, k, order, salt)


def few_shots_of(pool: DataFrame, k: int, order: str, by: list[str], salt: str = "shots") -> DataFrame:
    """``few_shots`` for every bucket (context_required, user_turns) in each group of by (say, domain), in one plan: the pool's rows
    with for_context and for_turns, the bucket that they are shown to.  A bucket's pool is its group's rows of that context
    or, where there are none, all of the group.

    A row stands in two lists, that of its group and context and that of its group alone.  Of a list only the first
    max(3k, 6) rows of each count of turns, and of all counts, go on; so a bucket chooses among few rows and none is ranked."""
    n, keys = max(3 * k, 6), [f"__by{i}" for i in range(len(by))]
    rows = pool.select(F.struct(*[F.col(f"`{c}`") for c in pool.columns]).alias("row"), *[F.col(c).alias(b) for c, b in zip(by, keys)], F.col("context_required").alias("context"), F.col("user_turns").alias("turns"), F.col(order).alias("at"))
    lists = rows.withColumn("wide", F.explode(F.array(F.lit(False), F.lit(True)))).filter("wide OR context IS NOT NULL").withColumn("context", F.when(~F.col("wide"), F.col("context")))
    of = [*keys, "wide", "context"]
    same = heads(lists, [*of, "turns"], n, ["at"]).drop("__rn")
    first = heads(same, of, n, ["at"]).drop("__rn")
    own = rows.filter("context IS NOT NULL").select(*keys, F.col("context").alias("for_context"), F.lit(False).alias("wide")).distinct()
    buckets = rows.select(*keys, F.col("turns").alias("for_turns"), F.explode(F.array(F.lit(False), F.lit(True))).alias("for_context")).distinct()
    buckets = _joined(buckets, own, [*keys, "for_context"], "left").withColumn("wide", F.coalesce("wide", F.lit(True))).withColumn("context", F.when(~F.col("wide"), F.col("for_context")))
    exact = _joined(buckets.withColumn("turns", F.col("for_turns")), same, [*of, "turns"]).withColumn("other", F.lit(0))
    rest = _joined(buckets, first, of).filter(~F.col("turns").eqNullSafe(F.col("for_turns"))).withColumn("other", F.lit(1))
    bucket = [*keys, "for_turns", "for_context"]
    cols = [*bucket, "other", "at", "row"]
    chosen = heads(exact.select(*cols).unionByName(rest.select(*cols)), bucket, n, ["other", "at"]).drop("__rn")
    return heads(chosen.withColumn("h", hashed(F.col("at"), salt)), bucket, k, ["h", "at"]).select("for_context", "for_turns", "row.*")


def _joined(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A join in which nulls of the keys equal each other."""
    right = right.select(*[F.col(c).alias(f"__r_{c}") if c in on else F.col(c) for c in right.columns])
    return left.join(right, reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__r_{c}")) for c in on]), how).drop(*[f"__r_{c}" for c in on])


def target_cut(df: DataFrame, group: list[str], target: int, *order: str) -> DataFrame:
    """The first target rows of each group, however large the group or the target."""
    return heads(df, group, target, list(order)).drop("__rn")
