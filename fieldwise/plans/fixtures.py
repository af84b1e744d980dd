"""Maps the star-schema test tables to contests: one row per entrant of a contest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldwise.operators.sets import dedupe


def runners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entrants. Lines are shuffled by part, where repeats meet too, by supplier where these are too many to send around, and by the contest's id as text, which windows by contest then need no more."""
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    lines = dedupe(read("lineitem").repartition("l_partkey"), ["l_orderkey", "l_partkey"], ["l_linenumber", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity"])
    entrants = lines.join(read("part"), F.col("l_partkey") == F.col("p_partkey")).join(read("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    contests = read("orders").join(read("customer"), F.col("o_custkey") == F.col("c_custkey"))
    joined = entrants.withColumn("race_id", F.col("l_orderkey").cast("string")).join(contests.withColumn("race_id", F.col("o_orderkey").cast("string")), "race_id")
    return joined.selectExpr(
        "race_id",
        "cast(l_partkey as string) AS horse_id",
        "cast(l_suppkey as string) AS jockey_id",
        "cast(s_nationkey as string) AS trainer_id",
        "cast(o_orderdate as timestamp) AS race_dt",
        "o_orderstatus AS discipline",
        "c_mktsegment AS course",
        "o_orderpriority AS going",
        "1000 + (l_orderkey % 30) * 100 AS distance_m",
        "l_linenumber AS draw",
        "p_size AS official_rating",
        "l_quantity AS weight_lbs",
        "2 + p_size % 10 AS age",
        "l_extendedprice AS completion_time",
        "cast(dense_rank() OVER (PARTITION BY race_id ORDER BY l_extendedprice ASC NULLS LAST) AS int) AS pos",
        "cast(count(*) OVER (PARTITION BY race_id) AS int) AS field_size",
        """CASE l_linenumber % 4 WHEN 0 THEN 'EVS' WHEN 1 THEN concat(cast(l_quantity AS int), '/', l_linenumber + 1)
           WHEN 2 THEN cast(1 + l_quantity / 4 AS string) ELSE CASE WHEN l_suppkey % 10 = 0 THEN 'SP' ELSE cast(1 + l_quantity / 5 AS string) END END AS odds_text""",
    ).withColumn("is_win", (F.col("pos") == 1).cast("int"))


#: The same rows for SQL checks; every query text begins with it.
RUNNERS_SQL = """
WITH base AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY l_linenumber, l_suppkey, l_shipdate, l_extendedprice, l_quantity) AS rn FROM lineitem),
runners0 AS (SELECT CAST(l_orderkey AS VARCHAR) AS race_id, CAST(l_partkey AS VARCHAR) AS horse_id, CAST(l_suppkey AS VARCHAR) AS jockey_id, CAST(s_nationkey AS VARCHAR) AS trainer_id,
  o_orderdate AS race_dt, epoch_us(o_orderdate) AS us, o_orderstatus AS discipline, c_mktsegment AS course, o_orderpriority AS going, 1000 + (l_orderkey % 30) * 100 AS distance_m, l_linenumber AS draw,
  p_size AS official_rating, l_quantity AS weight_lbs, 2 + p_size % 10 AS age, l_extendedprice AS completion_time,
  dense_rank() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice)::INT AS pos, count(*) OVER (PARTITION BY l_orderkey)::INT AS field_size,
  CASE l_linenumber % 4 WHEN 0 THEN 2.0 WHEN 1 THEN 1 + floor(l_quantity) / (l_linenumber + 1) WHEN 2 THEN 1 + l_quantity / 4 ELSE CASE WHEN l_suppkey % 10 = 0 THEN NULL ELSE 1 + l_quantity / 5 END END AS price
  FROM base JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE rn = 1),
runners AS (SELECT * REPLACE (CASE WHEN price > 1 THEN price END AS price), (pos = 1)::INT AS is_win FROM runners0),
market AS (SELECT *, CASE WHEN price > 0 THEN 1 / price END AS raw, (1 / price) / sum(1 / price) OVER (PARTITION BY race_id) AS implied FROM runners)
"""
