"""Data-quality checks: each gives its violations as a DataFrame."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def check_required(df: DataFrame, columns: list[str]) -> list[str]:
    return [c for c in columns if c not in df.columns]


def missing_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """The required columns that are absent, one row each."""
    return df.sparkSession.createDataFrame([(c,) for c in check_required(df, columns)], "column string")


def check_finite(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row for each column with nulls or non-finite values: column, bad."""
    bad = df.agg(*[F.count_if(F.col(c).isNull() | F.isnan(F.col(c).cast("double")) | (F.abs(F.col(c).cast("double")) == float("inf"))).alias(c) for c in columns])
    return bad.unpivot([], columns, "column", "bad").where("bad > 0")


def check_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


#: What a sum's last digits, which follow the order of its rows, may add to a bound.
SLACK = 1e-12


def check_prob_sum(df: DataFrame, group: str, prob: str, atol: float = 1e-6) -> DataFrame:
    """Groups without a sum, or whose sum is more than ``atol`` away from 1. A sum that stands on the bound is none, in whatever order its rows came."""
    return df.groupBy(group).agg(F.sum(prob).alias("total")).where(F.col("total").isNull() | (F.abs(F.col("total") - 1) - atol > SLACK))


def check_prob_table(df: DataFrame, group: str, entity: str, prob: str) -> DataFrame:
    p = F.col(prob).cast("double")
    return df.where(F.col(group).isNull() | F.col(entity).isNull() | p.isNull() | F.isnan(p) | ~p.between(0, 1))


def check_label(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNull() | ~F.col(column).isin(0, 1))


def check_constant(df: DataFrame, group: str, column: str) -> DataFrame:
    return df.groupBy(group).agg(F.min(column).alias("low"), F.max(column).alias("high")).where("low <> high")


def check_canonical(df: DataFrame, keys: list[str], label: str, constant: str) -> DataFrame:
    """Counts of violations by rule."""
    if missing := check_required(df, [*keys, label, constant]):
        raise ValueError(f"missing columns: {missing}")
    rules = {"unique_key": check_unique(df, keys), "label": check_label(df, label), "constant": check_constant(df, keys[0], constant)}
    return reduce(DataFrame.unionByName, (d.agg(F.lit(k).alias("rule"), F.count(F.lit(1)).alias("violations")) for k, d in rules.items()))


def check_row_contract(df: DataFrame, keys: list[str], numbers: dict[str, str], levels: dict[str, list[str]]) -> DataFrame:
    """Rows with an empty key, text that does not fit its type, or a value outside a set, by rule."""
    tests = {f"empty_{k}": F.coalesce(F.trim(F.col(k).cast("string")), F.lit("")) == "" for k in keys}
    tests |= {f"{c}_is_{t}": (F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) != "") & F.col(c).cast("string").try_cast(t).isNull() for c, t in numbers.items()}
    tests |= {f"{c}_level": F.col(c).isNotNull() & ~F.upper(F.trim(c)).isin(*v) for c, v in levels.items()}
    return df.agg(*[F.count_if(t).alias(n) for n, t in tests.items()]).unpivot([], list(tests), "rule", "violations")
