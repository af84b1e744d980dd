"""Dedupe, top levels and latest snapshots."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def dedupe(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key by ``order``, which should be total: files have no row order."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def dedupe_entities(df: DataFrame, group: str, time: str, entities: list[str], order: list) -> DataFrame:
    """One row per (group, time, entity), for each kind of entity in turn."""
    return reduce(lambda d, e: dedupe(d, [group, time, e], order), entities, df)


def top_levels(df: DataFrame, column: str, k: int = 20) -> DataFrame:
    """The ``k`` most frequent values, with share; ties by value."""
    counts = df.groupBy(F.col(column).cast("string").alias("level")).agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(F.lit(1)).alias("total"))
    best = counts.orderBy(F.desc("n"), F.asc_nulls_last("level")).limit(k)
    return best.crossJoin(F.broadcast(total)).select(F.lit(column).alias("column"), "level", "n", (F.col("n") / F.col("total")).alias("share"))


def latest_topn(df: DataFrame, entity: str, value: str, order: list[str], n: int) -> DataFrame:
    """Each entity's last row by ``order``, then the ``n`` largest values."""
    last = df.groupBy(entity).agg(F.max_by(F.struct(value), F.struct(*order)).alias("s")).select(entity, f"s.{value}")
    return last.where(F.col(value).isNotNull()).orderBy(F.desc(value), entity).limit(n)


def latest_topn_by(df: DataFrame, entity: str, value: str, category: str, order: list[str], n: int) -> DataFrame:
    """As ``latest_topn``, for each level of a category."""
    last = df.groupBy(category, entity).agg(F.max_by(F.struct(value), F.struct(*order)).alias("s")).select(category, entity, f"s.{value}")
    rank = F.row_number().over(Window.partitionBy(category).orderBy(F.desc(value), entity))
    return last.where(F.col(value).isNotNull()).withColumn("rank", rank).where(F.col("rank") <= n)
