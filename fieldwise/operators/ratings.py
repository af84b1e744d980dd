"""Elo-like and empirical-Bayes ratings, decayed z-scores and their blend, in closed form: all are decayed prior sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldwise.functions.prices import rank_score
from fieldwise.operators.features import DAY_US, ERA, TIES, decayed_sum, expanding_mean, micros
from fieldwise.operators.scan import dealt, durable, in_part

#: Rows of one day that one task sorts and adds up; with more of them, ranges split days.
MOST_OF_A_DAY = 2_000_000
BLEND = {"horse_elo": 0.5, "horse_eb": 0.2, "jockey_elo": 0.15, "trainer_elo": 0.15}


def elo(df: DataFrame, entity: str, time: str, out: str, k: float = 16.0, reference: float = 8.0, mean: float = 0.0, half_life: float = 90.0, ties=TIES, strict: bool = False, hot: bool = False) -> DataFrame:
    """The rating before each row: the mean plus decayed gains K * (score - 0.5) of earlier rows."""
    gain = k * F.sqrt(F.greatest(F.col("field_size") / reference, F.lit(1.0))) * (rank_score(F.col("pos"), F.col("field_size")) - 0.5)
    rated = decayed_sum(df.withColumn("__gain", gain), [entity], time, {"__sum": "__gain"}, half_life, ties, strict, hot)
    return rated.withColumn(out, mean + F.col("__sum")).drop("__gain", "__sum")


def eb(df: DataFrame, entity: str, time: str, out: str, flag: str = "is_win", n0: float = 20.0, half_life: float = 120.0, baseline: float | str = "global", centre: bool = False, ties=TIES, strict: bool = False, hot: bool = False) -> DataFrame:
    """Beta-binomial prior with decayed successes and trials; the baseline is given, or the clipped mean of all rows (``global``)
    or of all earlier ones (``expanding``, 0.5 before the first)."""
    wins = df.withColumn("__one", F.lit(1.0)).withColumn("__hit", (F.col(flag) >= 0.5).cast("double"))
    clipped = lambda c: F.greatest(F.least(c, F.lit(1 - 1e-9)), F.lit(1e-9))
    if baseline == "global":
        wins = wins.crossJoin(F.broadcast(wins.agg(clipped(F.avg("__hit")).alias("__base"))))
    elif baseline == "expanding":
        wins = expanding_mean(wins, time, "__hit", "__base", ties).withColumn("__base", F.coalesce(clipped(F.col("__base")), F.lit(0.5)))
    else:
        wins = wins.withColumn("__base", F.lit(float(baseline)))
    summed = decayed_sum(wins, [entity], time, {"__s": "__hit", "__n": "__one"}, half_life, ties, strict, hot)
    rate = (n0 * F.col("__base") + F.col("__s")) / (n0 + F.col("__n"))
    return summed.withColumn(out, rate - F.col("__base") if centre else rate).drop("__one", "__hit", "__base", "__s", "__n")


def decayed_z(df: DataFrame, time: str, columns: list[str], half_life: float = 180.0, order: tuple[str, ...] = TIES) -> DataFrame:
    """Adds ``<column>_z``: the score of each value against the mean and spread of all earlier rows, which fade with time.

    Rows follow each other by time, then ``order``, over the whole table. A running mean whose weight, squares
    and own value all halve every ``half_life`` days needs no loop. With ages in half-lives, before a row

        weight = 1e-6 * 2^-age(first) + sum of 2^-age
        mean   = (sum of x * 4^-age) / weight
        spread = 2^-age(first) + sum of (x - its mean)^2 * its weight / (its weight + 1) * 2^-age

    and the variance is spread / weight, 1e-9 at least. So two global prefix scans give every row's score, and
    no task sees more than its range. Null and non-finite values count as 0. Ages are rebased in eras of half ``ERA`` half-lives: scans
    run inside an era, and what the era before gave is added, faded; older rows weigh less than a double can add to. Rows with a null time
    come first and score null. The rows are written once. Both scans run over the same ranges, each range and era with the totals before it: days, or
    ranges of rows where a day holds more than ``MOST_OF_A_DAY``.
    """
    span, numbered, group = ERA // 2, range(len(columns)), ["__part", "__era"]
    stored = durable(df)
    day = F.coalesce(F.floor(micros(time) / F.lit(float(DAY_US))).cast("int"), F.lit(-(2**31)))
    first = stored.agg(F.min(micros(time)).alias("__first"))
    longest = stored.groupBy(day).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0

    def aged(table: DataFrame) -> DataFrame:
        held = [F.when(F.abs(F.col(c).cast("double")) < float("inf"), F.col(c).cast("double")).otherwise(0.0).alias(f"__x{i}") for i, c in enumerate(columns)]
        age = (micros(time) - F.col("__first")) / F.lit(float(DAY_US)) / F.lit(float(half_life))
        rows = table.crossJoin(F.broadcast(first)).select("*", *held, age.alias("__whole")).drop("__first")
        rows = rows.withColumn("__era", F.coalesce(F.floor(F.col("__whole") / span).cast("int"), F.lit(-1))).withColumn("__age", F.col("__whole") - F.col("__era") * span)
        return rows.withColumn("__up", F.pow(F.lit(2.0), "__age")).withColumns({f"__u{i}": F.col(f"__x{i}") * F.col("__up") * F.col("__up") for i in numbered})

    if longest <= MOST_OF_A_DAY:  # days are ranges that need no dealing: the narrow rows are shuffled once
        counted = aged(stored.withColumn("__part", day))
        rows = aged(stored.withColumn("__part", day).repartition("__part"))
    else:
        rows = counted = aged(dealt(stored, [time, *order], cheap=True))

    def faded(table: DataFrame, source: DataFrame, sums: dict[str, str], powers: dict[str, int], start: dict[str, float]) -> DataFrame:
        """Adds prefix sums inside eras, with what the era before holds at its end and, in the first era, the start. ``source`` holds the same rows for the totals."""
        totals = source.groupBy(*group).agg(*[F.sum(c).alias(o) for o, c in sums.items()])
        eras = totals.groupBy((F.col("__era") + 1).alias("__era")).agg(*[(F.sum(o) * F.pow(F.lit(2.0), F.lit(-span * powers[o]))).alias(f"__c{o}") for o in sums])
        before = Window.partitionBy("__era").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
        begun = {o: F.lit(start.get(o, 0.0)) * F.pow(F.lit(2.0), F.lit(-span) * F.col("__era").cast("double")) for o in sums}
        upto = totals.select(*group, *[F.coalesce(F.sum(o).over(before), F.lit(0.0)).alias(f"__b{o}") for o in sums]).join(eras, "__era", "left")
        offsets = upto.select(*group, *[(F.col(f"__b{o}") + F.coalesce(F.col(f"__c{o}"), F.lit(0.0)) + begun[o]).alias(f"__o{o}") for o in sums])
        inside = Window.partitionBy(*group).orderBy("__age", *order).rowsBetween(Window.unboundedPreceding, -1)
        joined = in_part(table, offsets, ["__era"])  # a row for each range and each era
        return joined.withColumns({o: F.col(f"__o{o}") + F.coalesce(F.sum(c).over(inside), F.lit(0.0)) for o, c in sums.items()}).drop(*[f"__o{o}" for o in sums])

    rows = faded(rows, counted, {"__w": "__up"} | {f"__s{i}": f"__u{i}" for i in numbered}, {"__w": 1} | {f"__s{i}": 2 for i in numbered}, {"__w": 1e-6})
    rows = rows.withColumn("__w", F.col("__w") / F.col("__up"))
    rows = rows.withColumns({f"__d{i}": F.col(f"__x{i}") - F.col(f"__s{i}") / (F.col("__up") * F.col("__up")) / F.greatest(F.col("__w"), F.lit(1e-300)) for i in numbered})
    rows = rows.withColumns({f"__g{i}": F.col(f"__d{i}") * F.col(f"__d{i}") * F.col("__w") / (F.col("__w") + 1) * F.col("__up") for i in numbered})
    rows = faded(rows, rows, {f"__m{i}": f"__g{i}" for i in numbered}, {f"__m{i}": 1 for i in numbered}, {f"__m{i}": 1.0 for i in numbered})
    spread = lambda i: F.col(f"__m{i}") / F.col("__up") / F.greatest(F.col("__w"), F.lit(1e-6))
    score = lambda i: F.when(F.col("__whole").isNotNull(), F.col(f"__d{i}") / F.sqrt(F.greatest(spread(i), F.lit(1e-9))))
    return rows.select(*df.columns, *[score(i).alias(f"{c}_z") for i, c in enumerate(columns)])


def blended_ratings(df: DataFrame, time: str = "race_dt", half_life: float = 180.0, weights: dict[str, float] | None = None, ties=TIES) -> DataFrame:
    """Keys, the four ratings before each row, their decayed z-scores, and the scores' weighted sum. The rows are written once, since the
    ratings need the mean of all of them too, again after horses and jockeys, and after the few trainers, who are dealt by day: so the disk holds the shuffles of
    one of these steps at a time."""
    weights = weights or BLEND
    rated = durable(df.select("race_id", time, "horse_id", "jockey_id", "trainer_id", "field_size", "pos", "is_win"))
    rated = eb(elo(rated, "horse_id", time, "horse_elo", ties=ties), "horse_id", time, "horse_eb", ties=ties)
    rated = elo(rated, "jockey_id", time, "jockey_elo", ties=ties).drop("is_win")
    rated = elo(rated, "trainer_id", time, "trainer_elo", ties=ties, hot=True)
    scored = decayed_z(rated.drop("field_size", "pos"), time, list(weights), half_life, ties)
    return scored.withColumn("rating_blend", sum((w * F.col(f"{c}_z") for c, w in weights.items()), F.lit(0.0)))
