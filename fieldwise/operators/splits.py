"""Time splits of contests: every contest falls in one place, and time never runs backwards."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldwise.operators.scan import durable, with_prefix


def order_groups(df: DataFrame, group: str, time: str) -> DataFrame:
    """One row per contest with its place from 0 in the order of first time, then key; and the number of contests. Contests are written once."""
    firsts = durable(df.groupBy(group).agg(F.min(time).alias("first_time")))
    placed = with_prefix(firsts, ["first_time", group], {"__at": "*"}, cheap=True).withColumn("place", F.col("__at") - 1).drop("__at")
    return placed.crossJoin(F.broadcast(firsts.agg(F.count(F.lit(1)).alias("groups"))))


def split_fractions(df: DataFrame, group: str, time: str, valid: float = 0.2, test: float = 0.2) -> DataFrame:
    """train, valid, test by fractions of contests, the latest in test."""
    n, n_test = F.col("groups"), F.floor(F.col("groups") * test)
    n_valid = F.floor(n * valid)
    role = F.when(F.col("place") < n - n_test - n_valid, "train").when(F.col("place") < n - n_test, "valid").otherwise("test")
    return order_groups(df, group, time).select(group, "first_time", role.alias("split"))


def split_cutoff(df: DataFrame, group: str, time: str, cutoff: str, valid: float = 0.5) -> DataFrame:
    """Contests before ``cutoff`` train; of the later ones the first share is valid, rounded up, the rest test."""
    placed = order_groups(df, group, time)
    before = placed.agg(F.count_if(F.col("first_time") < F.lit(cutoff).cast("timestamp")).alias("before"))
    later = F.col("groups") - F.col("before")
    role = F.when(F.col("place") < F.col("before"), "train").when(F.col("place") < F.col("before") + later - F.floor(later * (1 - valid)), "valid").otherwise("test")
    return placed.crossJoin(F.broadcast(before)).select(group, "first_time", role.alias("split"))


def block_of(place, groups, k: int):
    """Balanced blocks: the remainder goes to the first ones."""
    size, extra = F.floor(groups / k), groups % k
    head = extra * (size + 1)
    return F.when(place < head, F.floor(place / (size + 1))).otherwise(extra + F.floor((place - head) / F.greatest(size, F.lit(1)))).cast("int")


def split_kfold(df: DataFrame, group: str, time: str, k: int) -> DataFrame:
    """Fold i trains on the blocks before i and validates on block i; in long form."""
    placed = order_groups(df, group, time).withColumn("block", block_of(F.col("place"), F.col("groups"), k))
    folds = placed.withColumn("fold", F.explode(F.sequence(F.greatest(F.col("block"), F.lit(1)), F.lit(k - 1))))
    return folds.select("fold", group, "first_time", F.when(F.col("block") < F.col("fold"), "train").otherwise("valid").alias("role"))


def grouped_time_cv(df: DataFrame, group: str, time: str, k: int) -> DataFrame:
    """k folds over k + 1 blocks: fold i trains on blocks 0..i and validates on the next. k is at least 2 and at most the number of contests."""
    ordered = order_groups(df, group, time)
    k = max(2, min(k, (ordered.select("groups").first() or [0])[0]))
    placed = ordered.withColumn("block", block_of(F.col("place"), F.col("groups"), k + 1))
    folds = placed.withColumn("fold", F.explode(F.sequence(F.greatest(F.col("block") - 1, F.lit(0)), F.lit(k - 1))))
    return folds.select("fold", group, "first_time", F.when(F.col("block") <= F.col("fold"), "train").otherwise("valid").alias("role"))


def check_splits(df: DataFrame, splits: DataFrame, group: str, gap_days: float = 0.0) -> DataFrame:
    """Violations by rule: contests missing, in several splits, unknown, and roles whose times overlap or are less than ``gap_days`` apart."""
    per = splits.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    known = df.select(group).distinct()
    bounds = splits.groupBy("split").agg(F.min("first_time").alias("low"), F.max("first_time").alias("high"))
    after = bounds.select(F.col("split").alias("next"), F.col("low").alias("next_low"))
    overlap = bounds.crossJoin(F.broadcast(after)).where(f"(split = 'train' AND next IN ('valid', 'test') OR split = 'valid' AND next = 'test') AND (high > next_low OR unix_micros(CAST(next_low AS timestamp)) - unix_micros(CAST(high AS timestamp)) < {int(gap_days * 86_400_000_000)})")
    rules = {"missing": known.join(per, group, "left_anti"), "unknown": per.join(known, group, "left_anti"), "repeated": per.where("n > 1"), "overlap": overlap}
    return reduce(DataFrame.unionByName, (d.agg(F.lit(k).alias("rule"), F.count(F.lit(1)).alias("violations")) for k, d in rules.items()))


def write_splits(splits: DataFrame, path: str) -> None:
    """The splits as Parquet, one folder for each, and a manifest of counts beside them."""
    splits.write.mode("overwrite").partitionBy("split").parquet(f"{path}/splits")
    splits.groupBy("split").agg(F.count(F.lit(1)).alias("groups"), F.min("first_time").alias("first"), F.max("first_time").alias("last")).write.mode("overwrite").json(f"{path}/manifest")
