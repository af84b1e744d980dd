"""Dataset profiles: summaries, coverage, histograms and rates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldwise.operators.scan import durable, quantiles


def summarize(df: DataFrame, group: str = "race_id", entities=("horse_id", "jockey_id", "trainer_id"), time: str = "race_dt") -> DataFrame:
    per = df.groupBy(group).agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("contests"), F.avg("n").alias("mean_runners"))
    repeats = df.groupBy(group, entities[0]).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n") - 1)), F.lit(0)).alias("duplicate_keys"))
    rows = df.agg(F.count(F.lit(1)).alias("rows"), *[F.countDistinct(e).alias(f"n_{e}") for e in entities], F.min(time).alias("first_time"), F.max(time).alias("last_time"))
    return rows.crossJoin(per).crossJoin(repeats)


def missingness(df: DataFrame) -> DataFrame:
    counts = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count(c).alias(c) for c in df.columns])
    long = counts.unpivot(["rows"], df.columns, "column", "non_null")
    return long.select("column", "non_null", (F.col("rows") - F.col("non_null")).alias("nulls"), ((F.col("rows") - F.col("non_null")) * 100.0 / F.col("rows")).alias("pct"))


def dtypes_table(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame(df.dtypes, "column string, type string")


def runners_per_contest(df: DataFrame, group: str = "race_id", entity: str = "horse_id") -> DataFrame:
    return df.groupBy(group).agg(F.countDistinct(entity).alias("runners"))


def overround(df: DataFrame, odds: str = "odds", group: str = "race_id") -> DataFrame:
    return df.where(F.col(odds) > 1).groupBy(group).agg(F.sum(1 / F.col(odds)).alias("overround"), F.count(F.lit(1)).alias("priced"), F.lit(odds).alias("source"))


def spread(df: DataFrame, column: str) -> DataFrame:
    """Mean, median, tenth and ninetieth percentile (linear), and the count, all from one written column."""
    rows = durable(df.select(column))
    cuts = quantiles(rows, column, {"median": 0.5, "p10": 0.1, "p90": 0.9}, cheap=True)
    return rows.agg(F.count(column).alias("n"), F.avg(column).alias("mean")).crossJoin(F.broadcast(cuts))


def overround_pct(table: DataFrame, column: str = "overround") -> DataFrame:
    """Each contest's overround in percent, and the mean over contests."""
    percent = table.withColumn("overround_pct", F.col(column) * 100)
    return percent.crossJoin(F.broadcast(percent.agg(F.avg("overround_pct").alias("mean_pct"))))


def peaks(rates: DataFrame, by: str) -> DataFrame:
    """The peak rows of ``rate_by_group``, in order."""
    return rates.where("is_peak = 1").orderBy(by)


def coverage(df: DataFrame, entities=("horse_id", "jockey_id", "trainer_id"), time: str = "race_dt") -> DataFrame:
    """Rows, distinct entities and the span of time."""
    return df.agg(F.count(F.lit(1)).alias("rows"), *[F.countDistinct(e).alias(f"n_{e}") for e in entities], F.min(time).alias("first_time"), F.max(time).alias("last_time"))


def market_health(df: DataFrame, prob: str, odds: str, group: str = "race_id") -> DataFrame:
    per = durable(df.groupBy(group).agg(F.sum(prob).alias("total"), F.count(odds).alias("priced"), F.count(prob).alias("told"), F.count(F.lit(1)).alias("rows")).drop(group))
    known = lambda c, name: F.coalesce(F.sum(c), F.lit(0).cast("long")).alias(name)
    rows = per.agg(known("rows", "rows"), known("priced", "with_odds"), known("told", "with_prob"))
    return rows.crossJoin(spread(per, "total").withColumnRenamed("n", "summed")).crossJoin(per.agg(F.count(F.lit(1)).alias("contests"), F.count_if(F.col("priced") == 0).alias("no_odds")))


def sample_rows(df: DataFrame, n: int, seed: str, keys: list[str]) -> DataFrame:
    """At most n rows, the same ones for a seed: those whose hashed key is smallest."""
    return df.orderBy(F.md5(F.concat_ws(":", F.lit(seed), *keys)), *keys).limit(n)


def monthly_volume(df: DataFrame, time: str = "race_dt", group: str = "race_id") -> DataFrame:
    return df.groupBy(F.date_trunc("month", time).cast("date").alias("month")).agg(F.countDistinct(group).alias("contests"))


def share_within(df: DataFrame, by: str, value: str) -> DataFrame:
    counts = df.groupBy(by, value).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(by)))


def histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """Equal-width bins; the last one is closed; a single value goes to the first of bins around it."""
    value = F.col(column).cast("double")
    ends = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi")).select(F.when(F.col("lo") == F.col("hi"), F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"), F.when(F.col("lo") == F.col("hi"), F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"))
    placed = df.where(value.isNotNull()).crossJoin(F.broadcast(ends)).select("lo", "hi", F.least(F.floor((value - F.col("lo")) * bins / (F.col("hi") - F.col("lo"))), F.lit(bins - 1)).cast("int").alias("bin"))
    width = (F.col("hi") - F.col("lo")) / bins
    return placed.groupBy("bin", "lo", "hi").agg(F.count(F.lit(1)).alias("n")).select("bin", (F.col("lo") + F.col("bin") * width).alias("from"), "n")


def capped_hist(df: DataFrame, column: str, cap: float = 600.0, bins: int = 60) -> DataFrame:
    """As ``histogram`` of values up to the cap or the 99.5 percentile, whichever is less; the column is written once."""
    df = durable(df.select(column))
    limit = quantiles(df, column, {"__top": 0.995}, cheap=True).select(F.least(F.lit(cap), F.col("__top")).alias("__cap"))
    return histogram(df.crossJoin(F.broadcast(limit)).withColumn(column, F.least(column, "__cap")), column, bins)


def overround_hist(df: DataFrame, column: str = "overround", low: float = 0.9, high: float = 1.5, width: float = 0.01) -> DataFrame:
    """Counts in bins of a fixed width, and the window between the 0.5 and 99.5 percentiles of all values as ``low`` and ``high``. Values are rounded to nine
    places first, since a sum's last bits follow the order of its rows: many stand on an edge."""
    df, value = durable(df.select(F.round(column, 9).alias("o"))), F.col("o")
    window = quantiles(df, "o", {"low": 0.005, "high": 0.995}, cheap=True)
    at = F.least(F.floor(F.round((value - low) / width, 6)), F.lit(round((high - low) / width) - 1)).cast("int")
    return df.where(value.between(low, high)).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(window))


def int_histogram(df: DataFrame, column: str) -> DataFrame:
    """Counts for every whole number from the least to the greatest, empty ones too."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("int").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    ends = counts.agg(F.min("value").alias("lo"), F.max("value").alias("hi")).where("lo IS NOT NULL")
    return ends.select(F.explode(F.sequence("lo", "hi")).alias("value")).join(counts, "value", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def rate_by_group(df: DataFrame, by: str, value: str, flag: str = "is_win", least: int = 10) -> DataFrame:
    """Rate, Wilson 95 % interval, Beta(0.5, 0.5) shrunk rate, and the peak value of each group."""
    z = 1.959963984540054
    rates = df.groupBy(by, value).agg(F.count(flag).alias("n"), F.sum(flag).alias("wins")).where(F.col("n") >= least)
    p, n = F.col("wins") / F.col("n"), F.col("n")
    centre, half, scale = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)), 1 + z * z / n
    out = rates.withColumns({"rate": p, "low": (centre - half) / scale, "high": (centre + half) / scale, "shrunk": (F.col("wins") + 0.5) / (n + 1)})
    first = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("shrunk"), F.desc("n"), value))
    return out.withColumn("is_peak", (first == 1).cast("int"))


def corr_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson correlations of all pairs, in long form, from one pass."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    one = df.agg(*[F.corr(a, b).alias(f"{a}~{b}") for a, b in pairs])
    long = one.unpivot([], [f"{a}~{b}" for a, b in pairs], "pair", "corr")
    return long.select(F.split("pair", "~")[0].alias("a"), F.split("pair", "~")[1].alias("b"), "corr")


def ingest_audit(before: DataFrame, after: DataFrame, group: str, time: str) -> DataFrame:
    ins = before.agg(F.count(F.lit(1)).alias("rows_in"))
    outs = after.agg(F.count(F.lit(1)).alias("rows_out"), F.countDistinct(group).alias("contests"), F.min(time).alias("first_time"), F.max(time).alias("last_time"))
    return ins.crossJoin(outs).withColumn("removed", F.col("rows_in") - F.col("rows_out"))
