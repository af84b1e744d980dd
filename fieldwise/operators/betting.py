"""Edges, selection, stakes, settlement, sweeps and bootstrap intervals."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldwise.functions.prices import clip_prob
from fieldwise.operators.coerce import with_label
from fieldwise.operators.guards import Guards, expected
from fieldwise.operators.scan import with_prefix


def edges(df: DataFrame, model: str = "model_prob", market: str = "mkt_implied") -> DataFrame:
    return df.withColumn("edge", clip_prob(F.col(model)) - clip_prob(F.col(market)))


def select_bets(df: DataFrame, by: list[str] | None = None, threshold=0.02, cap=20.0, top=1, odds: str = "mkt_odds_decimal", group: str = "race_id", entity: str = "horse_id") -> DataFrame:
    """Edges at or over the threshold at prices in (1, cap], the best ``top`` of each contest."""
    fit = df.where((F.col("edge") >= threshold) & (F.col(odds) > 1) & (F.col(odds) <= cap))
    rank = F.row_number().over(Window.partitionBy(*(by or []), group).orderBy(F.desc("edge"), entity))
    return fit.withColumn("__rank", rank).where(F.col("__rank") <= top).drop("__rank")


def stake(df: DataFrame, fraction: float | None = None, flat: float = 1.0, odds: str = "mkt_odds_decimal", prob: str = "model_prob") -> DataFrame:
    """A flat stake, or a share of the growth-optimal one."""
    b, q = F.col(odds) - 1, F.col(prob)
    return df.withColumn("stake", F.lit(flat) if fraction is None else fraction * F.greatest(F.lit(0.0), (q * b - (1 - q)) / b))


def with_pnl(df: DataFrame, odds: str = "mkt_odds_decimal", won: str = "is_win") -> DataFrame:
    return df.withColumn("pnl", F.when(F.col(won) == 1, F.col("stake") * (F.col(odds) - 1)).otherwise(-F.col("stake")))


def summary(df: DataFrame, by: list[str], odds: str = "mkt_odds_decimal", won: str = "is_win", group: str = "race_id") -> DataFrame:
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("bets"), F.countDistinct(group).alias("contests"), F.sum("stake").alias("staked"), F.sum("pnl").alias("pnl"),
        F.try_divide(F.sum("pnl"), F.sum("stake")).alias("roi"), F.avg(won).alias("hit_rate"), F.avg(odds).alias("mean_odds"),
    )


def settle(df: DataFrame, by: list[str] = (), **names) -> DataFrame:
    return summary(with_pnl(df), list(by), **names)


def compound(df: DataFrame, fraction: float, initial: float, odds: str = "mkt_odds_decimal", prob: str = "model_prob", won: str = "is_win") -> DataFrame:
    """Final bankroll of fractional stakes without bounds: a product of factors, so no order and no single task."""
    b, q = F.col(odds) - 1, F.col(prob)
    part = fraction * F.greatest(F.lit(0.0), (q * b - (1 - q)) / b)
    factor = 1 + part * F.when(F.col(won) == 1, b).otherwise(-1.0)
    grown = df.agg(F.count(F.lit(1)).alias("bets"), F.when(F.count_if(factor <= 0) > 0, 0.0).otherwise(initial * F.exp(F.sum(F.when(factor > 0, F.ln(factor))))).alias("final"))
    return grown.withColumn("roi", F.col("final") / initial - 1)


def compound_path(df: DataFrame, fraction: float, initial: float, order: list[str], odds: str = "mkt_odds_decimal", prob: str = "model_prob", won: str = "is_win") -> DataFrame:
    """Adds the bankroll after each bet in ``order``: a global prefix sum of the factors' logarithms; 0 from the first ruin on.

    Logarithms are added as decimals of 20 places, so a bankroll's digits do not depend on the ranges in which they were added."""
    b, q = F.col(odds) - 1, F.col(prob)
    factor = 1 + fraction * F.greatest(F.lit(0.0), (q * b - (1 - q)) / b) * F.when(F.col(won) == 1, b).otherwise(-1.0)
    steps = df.withColumn("__f", factor).withColumns({"__log": F.when(F.col("__f") > 0, F.ln("__f")).otherwise(0.0), "__ruin": (F.col("__f") <= 0).cast("long")})
    finite = F.abs("__log") < float("inf")
    steps = steps.withColumns({"__exact": F.when(finite, F.col("__log")).cast("decimal(28,20)"), "__wild": F.when(~finite, F.col("__log")).otherwise(0.0)})
    run = with_prefix(steps, order, {"__grown": "__exact", "__odd": "__wild", "__ruined": "__ruin"})
    grown = F.col("__grown").cast("double") + F.col("__odd")
    return run.withColumn("bankroll", F.when(F.col("__ruined") > 0, 0.0).otherwise(initial * F.exp(grown))).drop("__f", "__log", "__ruin", "__exact", "__wild", "__grown", "__odd", "__ruined")


def ranked_once(df: DataFrame, grid: DataFrame, by: list[str], odds: str = "mkt_odds_decimal", group: str = "race_id", entity: str = "horse_id") -> DataFrame:
    """The bets of every row of a small ``grid`` (threshold, cap, top and more), each with its grid row's columns.

    A threshold only cuts the end of a contest's order, so edges are ranked once for each price cap; rows that no grid row
    takes fall before the ranking. ``by`` are columns of ``df`` inside which contests are ranked. Rows are shuffled by contest before they are taken for each cap.
    """
    ends = grid.agg(F.min("threshold").alias("__least"), F.max("top").alias("__most"), F.max("cap").alias("__dearest"))
    caps = grid.select(F.col("cap").alias("__cap")).distinct()
    fit = df.crossJoin(F.broadcast(ends)).where((F.col("edge") >= F.col("__least")) & (F.col(odds) > 1) & (F.col(odds) <= F.col("__dearest"))).drop("__least", "__dearest")
    fit = fit.repartition(group).join(F.broadcast(caps), F.col(odds) <= F.col("__cap"))
    rank = F.row_number().over(Window.partitionBy(*by, "__cap", group).orderBy(F.desc("edge"), entity))
    held = fit.withColumn("__rank", rank).where(F.col("__rank") <= F.col("__most")).drop("__most")
    taken = held.join(F.broadcast(grid), (F.col("__cap") == F.col("cap")) & (F.col("edge") >= F.col("threshold")) & (F.col("__rank") <= F.col("top")))
    return taken.drop("__cap", "__rank")


def sweep(df: DataFrame, grid: DataFrame, won: str = "is_win") -> DataFrame:
    """One summary row for each (threshold, cap, top) of a small grid, from one pass over the edges."""
    names = ["threshold", "cap", "top"]
    done = settle(stake(ranked_once(df, grid.select(*names).distinct(), [])), names, won=won)
    return grid.join(done, names, "left").na.fill({"bets": 0, "contests": 0, "staked": 0.0, "pnl": 0.0})


def share_of(fraction, odds: str = "mkt_odds_decimal", prob: str = "model_prob"):
    """The share of the bankroll that a fraction of the growth-optimal stake is."""
    b, q = F.col(odds) - 1, F.col(prob)
    return fraction * F.greatest(F.lit(0.0), (q * b - (1 - q)) / b)


def compare(df: DataFrame, configs: DataFrame, won: str = "is_win") -> DataFrame:
    """Named configurations (label, threshold, cap, top, fraction or null for flat stakes of 1) on the same edges, best return first, none last."""
    bets = ranked_once(df, configs, []).withColumn("stake", F.when(F.col("fraction").isNull(), 1.0).otherwise(share_of(F.col("fraction"))))
    done = settle(bets, ["label"], won=won)
    named = configs.select("label").join(done, "label", "left").na.fill({"bets": 0, "contests": 0})
    return named.orderBy(F.desc_nulls_last("roi"), "label")


def fraction_sweep(df: DataFrame, families: DataFrame, fractions=(0.0, 0.05, 0.10, 0.20, 0.30), initial: float = 1000.0, won: str = "is_win", odds: str = "mkt_odds_decimal") -> DataFrame:
    """One row for each family (threshold, cap, top), ``calibration`` of the edges and fraction: bets and the compounded bankroll.

    ``df`` is a union of edge tables told apart by ``calibration``. Each bet multiplies the bankroll by 1 + share * return, so
    logarithms of factors add up and no order is needed; a factor that is not positive is ruin, without a growth. Fraction 0 stakes nothing.
    """
    bets = ranked_once(df, families, ["calibration"])
    tried = bets.withColumn("fraction", F.explode(F.array(*[F.lit(float(f)) for f in fractions])))
    factor = 1 + share_of(F.col("fraction")) * F.when(F.col(won) == 1, F.col(odds) - 1).otherwise(-1.0)
    names = ["family", "calibration", "fraction"]
    each = tried.withColumn("__f", factor).groupBy(*names, "race_id").agg(  # rows lie by contest already
        F.count(F.lit(1)).alias("n"), F.count(won).alias("told"), F.sum(won).alias("wins"), F.count(odds).alias("priced"), F.sum(odds).alias("odds"), F.count_if(F.col("__f") <= 0).alias("ruins"),
        F.sum(F.when(F.col("__f") > 0, F.ln("__f"))).alias("grown"),
    )
    out = each.groupBy(*names).agg(
        F.sum("n").alias("bets"), F.count("race_id").alias("contests"), F.try_divide(F.sum("wins"), F.sum("told")).alias("hit_rate"), F.try_divide(F.sum("odds"), F.sum("priced")).alias("mean_odds"),
        F.when(F.sum("ruins") == 0, F.sum("grown")).alias("log_growth"),
    )
    out = out.withColumn("final", F.coalesce(initial * F.exp("log_growth"), F.lit(0.0)))
    return out.withColumn("roi", F.col("final") / initial - 1)


def per_contest_pnl(bets: DataFrame, group: str = "race_id") -> DataFrame:
    return bets.groupBy(group).agg(F.count(F.lit(1)).alias("bets"), F.sum("stake").alias("staked"), F.sum("pnl").alias("pnl"))


def _steps() -> list[float]:
    """Where a uniform number begins to mean one more of a Poisson(1) variable."""
    steps, mass, total = [], 0.36787944117144233, 0.0
    for k in range(8):
        total += mass
        steps.append(total)
        mass /= k + 1
    return steps


def replicate_weights(block: np.ndarray, draws: int) -> np.ndarray:
    """Poisson(1) weights of blocks (32-bit hashes) in each draw, from a hash of both: one row for each block."""
    low, x = np.uint64(0xFFFFFFFF), block.astype(np.uint64)[:, None] ^ (np.arange(draws, dtype=np.uint64) * np.uint64(0x9E3779B1) & np.uint64(0xFFFFFFFF))[None, :]
    x = x * np.uint64(0x85EBCA6B) & low
    x ^= x >> np.uint64(13)
    x = x * np.uint64(0xC2B2AE35) & low
    x ^= x >> np.uint64(16)
    return np.searchsorted(np.array(_steps()), x / 2.0**32, side="right").astype(np.float64)


def block_bootstrap(df: DataFrame, ratios: dict[str, tuple[str, str]], group: str, draws: int = 1000, seed: str = "b1") -> DataFrame:
    """Ratios of sums under Poisson(1) weights for whole contests: ``draw`` and a column for each ratio (top, bottom).

    Contests are reduced to their sums first. Each task adds up all draws of its contests and gives one row a draw, so what is shuffled
    follows tasks and draws, not contests.
    """
    columns = list(dict.fromkeys(c for pair in ratios.values() for c in pair))
    block = F.conv(F.left(F.md5(F.concat_ws(":", F.lit(seed), group)), F.lit(8)), 16, 10).cast("long").alias("block")
    blocks = df.groupBy(group).agg(*[F.coalesce(F.sum(F.col(c).cast("double")), F.lit(0.0)).alias(c) for c in columns]).select(block, *columns)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((draws, len(columns)))
        for batch in batches:
            values = np.column_stack([batch.column(c).to_numpy() for c in columns])
            for i in range(0, len(values), 1000):
                total += replicate_weights(batch.column("block").to_numpy()[i : i + 1000], draws).T @ values[i : i + 1000]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(draws)), *(pa.array(total[:, k]) for k in range(len(columns)))], names=["draw", *columns])

    parts = blocks.mapInArrow(add_up, "draw long, " + ", ".join(f"`{c}` double" for c in columns))
    summed = parts.groupBy("draw").agg(*[F.sum(c).alias(c) for c in columns])
    return summed.select("draw", *[F.try_divide(F.col(top), F.col(bottom)).alias(name) for name, (top, bottom) in ratios.items()])


def interval(draws: DataFrame, level: float = 0.95) -> DataFrame:
    """For each statistic of ``block_bootstrap``: mean, low and high. Draws are few, so exact percentiles need no ranks."""
    names = [c for c in draws.columns if c != "draw"]
    tail = (1 - level) / 2
    at = F.expr(f"percentile(value, array({tail}, {1 - tail}))")
    return draws.unpivot([], names, "stat", "value").groupBy("stat").agg(F.avg("value").alias("mean"), at[0].alias("low"), at[1].alias("high"))


def loss_sums(df: DataFrame, model: str, market: str, label: str, eps: float = 1e-12) -> DataFrame:
    """Adds what bootstraps of log loss and Brier differences (model less market) add up: both differences and 1 for each row."""
    y, m, k = F.col(label), clip_prob(F.col(model), eps), clip_prob(F.col(market), eps)
    loss = lambda q: -(y * F.ln(q) + (1 - y) * F.ln(1 - q))
    rows = df.where(F.col(model).isNotNull() & F.col(market).isNotNull() & y.isNotNull())
    return rows.withColumns({"logloss_diff": loss(m) - loss(k), "brier_diff": (m - y) * (m - y) - (k - y) * (k - y), "one": F.lit(1.0)})


def verdict(ci: DataFrame) -> DataFrame:
    return ci.withColumn("verdict", F.when(F.col("low") > 0, "profitable").when(F.col("high") < 0, "not profitable").otherwise("undecided"))


def edges_from_pred(market: DataFrame, pred: DataFrame, column: str, keys: list[str], implied: str = "mkt_implied", guards: Guards | None = None) -> DataFrame:
    """Edges of predictions against the market; rows without either are dropped, and none left is an error (see ``expected``)."""
    out = market.join(pred.select(*keys, F.col(column).alias("model_prob")), keys, "left")
    out = out.withColumn("edge", F.col("model_prob") - F.col(implied)).where(F.col("edge").isNotNull())
    return expected(guards, out, F.count(F.lit(1)) > 0, "no prediction meets the market")


def load_bets(df: DataFrame, odds: str = "odds", won: str = "won", staked: str = "stake") -> DataFrame:
    """Stored bets as numbers, with labels in any form that ``with_label`` reads and their returns worked out again; rows without a price over 1 are dropped."""
    number = lambda c: F.col(c).cast("string").try_cast("double")
    told = with_label(df, [won], "__won").drop(won).withColumnRenamed("__won", won)
    out = told.withColumns({odds: number(odds), staked: F.coalesce(number(staked), F.lit(1.0))}).where(F.col(odds) > 1)
    return out.withColumn("pnl", F.when(F.col(won) == 1, F.col(staked) * (F.col(odds) - 1)).otherwise(-F.col(staked)))
