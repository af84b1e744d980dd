"""Scans and sinks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_csv_union(spark: SparkSession, paths: list[str]) -> DataFrame:
    """CSV files or globs, put together by column name; columns absent from a file are null."""
    if not paths:
        raise ValueError("give a path or a glob")
    found = [spark.read.option("recursiveFileLookup", "true").csv(p, header=True) for p in paths]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), found)


def read_columns(spark: SparkSession, path: str, columns: list[str], fallback: dict[str, list[str]] | None = None) -> DataFrame:
    """Only the columns asked for; an absent one may be read from a fallback."""
    table = spark.read.parquet(path)
    source = {c: next((x for x in [c, *(fallback or {}).get(c, [])] if x in table.columns), None) for c in columns}
    return table.select(*[F.col(s).alias(c) for c, s in source.items() if s])


def read_table(spark: SparkSession, path: str, lower: bool = False) -> DataFrame:
    table = spark.read.csv(path, header=True, inferSchema=True) if path.lower().endswith((".csv", ".csv.gz")) else spark.read.parquet(path)
    return table.toDF(*[c.lower() for c in table.columns]) if lower else table


def write_canonical(df: DataFrame, path: str, order: list[str]) -> None:
    df.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").parquet(path)


def write_bucketed(df: DataFrame, name: str, path: str, group: str, order: list[str], buckets: int = 200) -> DataFrame:
    """The canonical table in ``buckets`` files by contest, each sorted, as the table ``name`` at ``path``; given back as it is read.

    Windows, groupings and joins by ``group`` then need no exchange. Choose ``buckets`` so that one holds some 100 MB; rows without a contest share one.
    """
    spark = df.sparkSession
    dealt = df.repartition(buckets, group).sortWithinPartitions(group, *order)
    dealt.write.mode("overwrite").option("path", path).bucketBy(buckets, group).sortBy(group, *order).saveAsTable(name)
    return spark.table(name)


def write_dual(df: DataFrame, base: str) -> None:
    df.write.mode("overwrite").parquet(f"{base}.parquet")
    df.sparkSession.read.parquet(f"{base}.parquet").write.mode("overwrite").csv(f"{base}.csv", header=True)


def write_summary(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def fingerprint(df: DataFrame) -> DataFrame:
    """Rows and an order-free content hash."""
    return df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")), F.lit(0)).cast("string").alias("fingerprint"))


def append_ledger(df: DataFrame, path: str, **about: str) -> None:
    """One row for each run: time, what it was, counts and fingerprint."""
    fingerprint(df).select(F.current_timestamp().alias("at"), *[F.lit(v).alias(k) for k, v in about.items()], "*").write.mode("append").parquet(path)
