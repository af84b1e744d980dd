"""Joins: checked many-to-one, market, backward as-of, labels, names and context."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldwise.functions.prices import coalesce_odds, implied_raw
from fieldwise.operators.checks import check_unique
from fieldwise.operators.guards import Guards, expected
from fieldwise.operators.scan import carried_forward


def join_m1(left: DataFrame, right: DataFrame, on: list[str], guards: Guards | None = None) -> DataFrame:
    """Left join; the right side must be unique on the key. With ``guards`` its keys are counted in the shuffle that the join makes anyway and
    judged by ``guards.check`` after the action; without, in a pass of their own before it."""
    if guards:
        counted = right.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(*on)))
        return left.join(guards.expect(counted, F.max("__n") <= 1, f"right side repeats keys of {on}", unread=True).drop("__n"), on, "left")
    if examples := check_unique(right, on).limit(3).collect():
        raise ValueError(f"right side repeats keys, such as {examples}")
    return left.join(right, on, "left")


def normalize(df: DataFrame, prob: str, group: str, out: str) -> DataFrame:
    """Share of the group's sum over non-null values; groups whose sum is not positive stay as they are."""
    total = F.sum(prob).over(Window.partitionBy(group))
    return df.withColumn(out, F.when(total > 0, F.col(prob) / total).otherwise(F.col(prob)))


def attach_market(features: DataFrame, odds: DataFrame, keys=("race_id", "horse_id"), prefix: str = "mkt_", guards: Guards | None = None) -> DataFrame:
    """Prices, implied probabilities, and those scaled to 1 in each contest of the odds table."""
    priced = odds.select(*keys, coalesce_odds(F.col("odds_text"), F.col("odds_text")).alias("odds")).withColumn("raw", implied_raw(F.col("odds")))
    scaled = normalize(priced, "raw", keys[0], "implied")
    named = scaled.select(*keys, F.col("odds").alias(f"{prefix}odds_decimal"), F.col("raw").alias(f"{prefix}implied_raw"), F.col("implied").alias(f"{prefix}implied"))
    return join_m1(features, named, list(keys), guards)


def with_market(df: DataFrame, group: str = "race_id", prefix: str = "mkt_") -> DataFrame:
    """As ``attach_market`` where the prices are on the rows themselves: one window, no join."""
    return with_implied(with_odds(df, prefix), group, prefix)


def with_odds(df: DataFrame, prefix: str = "mkt_") -> DataFrame:
    return df.withColumn(f"{prefix}odds_decimal", coalesce_odds(F.col("odds_text"), F.col("odds_text")))


def with_implied(df: DataFrame, group: str = "race_id", prefix: str = "mkt_") -> DataFrame:
    """The second half of ``with_market``: probabilities that prices imply, as they are and scaled in each contest."""
    raw = df.withColumn(f"{prefix}implied_raw", implied_raw(F.col(f"{prefix}odds_decimal")))
    return normalize(raw, f"{prefix}implied_raw", group, f"{prefix}implied")


def asof_join(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, columns: list[str], suffix: str = "_asof", hot: bool = False) -> DataFrame:
    """For each left row, the last right row of its entity that is not later. One shuffle by entity; with ``hot``, rows of both sides are dealt in
    ranges of entity and time and the last right row is carried from range to range, so that an entity with very many rows meets no single task."""
    lefts = left.withColumns({f"{c}{suffix}": F.lit(None).cast(dict(right.dtypes)[c]) for c in columns} | {"__t": F.col(left_time), "__side": F.lit(1)})
    rights = right.select(*by, *[F.col(c).alias(f"{c}{suffix}") for c in columns], F.col(right_time).alias("__t"), F.lit(0).alias("__side"))
    both = lefts.unionByName(rights, allowMissingColumns=True)
    held = F.struct(*[f"{c}{suffix}" for c in columns])
    if hot:
        marked = both.withColumn("__right", F.when(F.col("__side") == 0, held))
        found = carried_forward(marked, "__right", ["__t", "__side"], by, "__held").where("__side = 1")
        return found.select(*left.columns, *[F.col("__held")[f"{c}{suffix}"].alias(f"{c}{suffix}") for c in columns])
    seen = F.last(F.when(F.col("__side") == 0, held), ignorenulls=True).over(Window.partitionBy(*by).orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, 0))
    found = both.withColumn("__held", seen).where("__side = 1")
    return found.select(*left.columns, *[F.col("__held")[f"{c}{suffix}"].alias(f"{c}{suffix}") for c in columns])


def snapshot_join(left: DataFrame, right: DataFrame, keys: list[str], suffix: str) -> DataFrame:
    return left.join(right.select(*keys, *[F.col(c).alias(c + suffix) for c in right.columns if c not in keys]), keys, "left")


def attach_labels(df: DataFrame, labels: DataFrame, keys: list[str], label: str = "won", guards: Guards | None = None) -> DataFrame:
    """Labels by trimmed, upper-cased keys; absent ones are 0, and none met at all is an error. Its rows are read once: see ``expected``."""
    clean = lambda d: [F.upper(F.trim(F.col(k).cast("string"))).alias(f"__{k}") for k in keys]
    known = labels.select(*clean(labels), F.col(label).alias("__label")).groupBy(*[f"__{k}" for k in keys]).agg(F.max("__label").alias("__label"))
    joined = df.select("*", *clean(df)).join(known, [f"__{k}" for k in keys], "left")
    met = (F.count("__label") > 0) | (F.count(F.lit(1)) == 0)
    told = joined.select(*df.columns, F.coalesce("__label", F.lit(0)).cast("int").alias(label), F.col("__label"))
    return expected(guards, told, met, "no row meets a label", unread=True).drop("__label")


def join_for_metrics(pred: DataFrame, raw: DataFrame, keys: list[str], need: list[str]) -> DataFrame:
    return pred.join(raw, keys).where(" AND ".join(f"{c} IS NOT NULL AND NOT isnan({c}) AND abs({c}) < double('inf')" for c in need))


def attach_names(df: DataFrame, dims: dict[str, tuple]) -> DataFrame:
    """First name of each id by an order, for several entities: column to (table, id, name) or (table, id, name, order); the order is the name by default."""
    for column, (table, key, name, *order) in dims.items():
        by = F.struct(*order[0], name) if order else F.col(name)
        first = table.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("string").alias(column)).agg(F.min_by(name, by).alias(f"{column}_name"))
        df = df.join(first, column, "left")
    return df


def attach_context(df: DataFrame, raw: DataFrame, keys: list[str], columns: list[str], guards: Guards | None = None) -> DataFrame:
    """A contest's context; rows of ``raw`` that repeat it count once, and two different contexts for one contest are an error."""
    return join_m1(df, raw.select(*keys, *columns).distinct(), keys, guards)


def semi_mask(df: DataFrame, groups: DataFrame, key: str, name: str = "member") -> DataFrame:
    return df.join(groups.select(key).distinct().withColumn(name, F.lit(True)), key, "left").withColumn(name, F.coalesce(name, F.lit(False)))
