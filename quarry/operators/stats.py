"""Evaluation statistics, comparisons of two engines, and audits."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def group_stats(df: DataFrame, keys: Sequence[str], value: str, success: Column, averages: Sequence[str] = ()) -> DataFrame:
    """Count, success rate, nearest-rank p50 and p90, 95 % interval and averages of each group."""
    n, mean = F.count("*"), F.avg(value)
    margin = 1.96 * F.coalesce(F.stddev_pop(value), F.lit(0.0)) / F.sqrt(F.nullif(F.count(value), F.lit(0)))
    exact = lambda q: F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY `{value}`)")
    return df.groupBy(*keys).agg(
        n.alias("n"), F.avg(success.cast("double")).alias("success_rate"), exact(0.5).alias("p50"), exact(0.9).alias("p90"),
        (mean - margin).alias("ci95_low"), (mean + margin).alias("ci95_high"), *[F.avg(c).alias(f"avg_{c}") for c in averages],
    )


def exact_quantile(df: DataFrame, keys: Sequence[str], value: str, q: float, out: str, accuracy: int = 10_000) -> DataFrame:
    """The least value that a share ``q`` of a group's values doesn't exceed, by group: nulls don't count.

    A sketch brackets it first, then only the values within the bracket, a few in
    ``accuracy``, are ranked, so that no task holds a large group.
    """
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("__v"))
    slack = 3 / accuracy
    ends = F.percentile_approx("__v", [max(q - slack, 0.0), min(q + slack, 1.0)], accuracy)
    brackets = rows.groupBy(*keys).agg(ends.alias("__ends"), F.count("*").alias("__all")).select(*[F.col(k).alias(f"__{k}") for k in keys], "__ends", "__all")
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
    low, high = F.get("__ends", F.lit(0)), F.get("__ends", F.lit(1))
    counted = rows.join(brackets, on).where(F.col("__v") <= high).groupBy(*keys, "__all", F.when(F.col("__v") >= low, F.col("__v")).alias("__v")).agg(F.count("*").alias("__n"))
    upto = F.sum("__n").over(Window.partitionBy(*keys).orderBy(F.asc_nulls_first("__v")))
    wanted = F.greatest(F.ceil(F.lit(q) * F.col("__all")), F.lit(1))
    ranked = counted.withColumn("__upto", upto).withColumn("__wanted", wanted)
    return ranked.where("__v IS NOT NULL AND __upto >= __wanted AND __upto - __n < __wanted").select(*keys, F.col("__v").alias(out))


def upper_median(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """The element in the upper middle of each group's sorted numbers (A23): the lower middle from above."""
    turned = df.withColumn("__turned", -F.col(value))
    return exact_quantile(turned, keys, "__turned", 0.5, "upper_median").withColumn("upper_median", -F.col("upper_median"))


def unfinished_calls(explicit: Column, running: Column, started: Column, completed: Column, errored: Column) -> Column:
    """The number given, else the larger of running details and started less ended."""
    return F.coalesce(explicit, F.greatest(running, started - completed - errored, F.lit(0)))


def pairwise(judged: DataFrame, baseline: str, treatment: str) -> DataFrame:
    """Mean delta, wins and ties of a treatment over a baseline, one row."""
    b, t = F.col(baseline), F.col(treatment)
    count = lambda c: F.count_if(c)
    return judged.agg(
        F.count("*").alias("pairs"), F.coalesce(F.avg(t - b), F.lit(0.0)).alias("mean_delta"), count(t > b).alias("treatment_wins"),
        count(t < b).alias("baseline_wins"), count(t == b).alias("ties"), F.coalesce(F.avg(b), F.lit(0.0)).alias("mean_baseline"), F.coalesce(F.avg(t), F.lit(0.0)).alias("mean_treatment"),
    )


def paired(df: DataFrame, keys: Sequence[str], arm: str, baseline: str, treatment: str, value: str) -> DataFrame:
    """Baseline and treatment value of each key that has both, in one aggregation."""
    pick = lambda a: F.min(F.when(F.col(arm) == a, F.col(value)))
    return df.where(F.col(arm).isin(baseline, treatment)).groupBy(*keys).agg(pick(baseline).alias("baseline"), pick(treatment).alias("treatment")).where("baseline IS NOT NULL AND treatment IS NOT NULL")


def first_reason(rules: Sequence[tuple[Column, str]]) -> Column:
    """The reason of the first rule that holds, else null."""
    out = F.lit(None).cast("string")
    for rule, reason in reversed(rules):
        out = F.when(rule, F.lit(reason)).otherwise(out)
    return out


def verified(text: Column, required: Sequence[str], forbidden: Sequence[str], pattern: str | None = None) -> Column:
    """struct(correct, missing, found): required and forbidden substrings without regard to case."""
    low = F.lower(F.coalesce(text, F.lit("")))
    missing = F.filter(F.array(*[F.when(~F.contains(low, F.lit(x.lower())), F.lit(x)) for x in required]), lambda x: x.isNotNull()) if required else F.array().cast("array<string>")
    if pattern is not None:
        missing = F.concat(missing, F.when(~F.coalesce(text, F.lit("")).rlike(pattern), F.array(F.lit(pattern))).otherwise(F.array().cast("array<string>")))
    found = F.filter(F.array(*[F.when(F.contains(low, F.lit(x.lower())), F.lit(x)) for x in forbidden]), lambda x: x.isNotNull()) if forbidden else F.array().cast("array<string>")
    return F.struct(((F.size(missing) == 0) & (F.size(found) == 0)).alias("correct"), missing.alias("missing"), found.alias("found"))


def surplus(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def multiset_difference(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, left_n, right_n) where two multisets differ."""
    both = a.select(*keys, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(b.select(*keys, F.lit(0).alias("l"), F.lit(1).alias("r")))
    return both.groupBy(*keys).agg(F.sum("l").alias("left_n"), F.sum("r").alias("right_n")).where("left_n <> right_n")


def one_sided(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """Full outer comparison by key: both values, their difference, the side that is alone."""
    joined = a.select(key, F.col(value).alias("left_value")).join(b.select(key, F.col(value).alias("right_value")), key, "full")
    side = F.when(F.col("right_value").isNull(), "left").when(F.col("left_value").isNull(), "right").otherwise("both")
    delta = F.coalesce("left_value", F.lit(0)) - F.coalesce("right_value", F.lit(0))
    return joined.withColumn("side", side).withColumn("delta", delta)


def top_share(df: DataFrame, key: str, k: int) -> DataFrame:
    """The ``k`` commonest values with their percentage of all rows."""
    counts = df.groupBy(key).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(total)).select(key, "n", F.round(100.0 * F.col("n") / F.col("total"), 4).alias("percent")).orderBy(F.desc("n"), key).limit(k)  # one row
