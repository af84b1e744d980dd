"""Global order without one task: range partitions, their counts, and offsets; exact quantiles from them."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def fresh_path(spark: SparkSession, what: str) -> str:
    """A new path in the shared checkpoint folder. Only a local session may do without that setting."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{(folder or '/tmp/checkpoints').rstrip('/')}/{what}-{uuid.uuid4().hex}"


#: Under this setting Spark removes an action's shuffle files when it ends, and not only once the driver happens to collect garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def durable(df: DataFrame) -> DataFrame:
    """A copy of ``df`` in the shared checkpoint folder: both passes of a scan must see the same partitions. The shuffles that made it are removed, so
    steps that are written one after the other need the disk of the largest, not of all."""
    spark = df.sparkSession
    path = fresh_path(spark, "scan")
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    table = spark.read.schema(df.schema).parquet(path)
    table.durable_at = path
    return table


def discard(*tables: DataFrame) -> None:
    """Remove durable tables that no later step reads."""
    for table in tables:
        session = table.sparkSession
        path = session.sparkContext._jvm.org.apache.hadoop.fs.Path(table.durable_at)
        path.getFileSystem(session._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def dealt(df: DataFrame, keys: list, partitions: int | None = None, cheap: bool = False) -> DataFrame:
    """The rows in ranges of ``keys``, each range with its number ``__part``, written so that all passes see the same ranges.

    The rows are written before they are dealt too, since finding the ranges reads them once more; that copy is removed. ``cheap`` says that reading
    them again costs little, as after a stored table.
    """
    rows = df if cheap else durable(df)
    ranged = rows.repartitionByRange(partitions, *keys) if partitions else rows.repartitionByRange(*keys)
    held = durable(ranged.withColumn("__part", F.spark_partition_id()))
    if not cheap:
        discard(rows)
    return held


def in_part(held: DataFrame, offsets: DataFrame, within: list[str]) -> DataFrame:
    """Joins to each row what ``offsets`` (__part, ``within``, further columns) holds for its range and group: one row for each range at most
    where only groups are listed that begin in an earlier range."""
    named = offsets.select(F.col("__part").alias("__p"), *[F.col(c).alias(f"__in_{c}") for c in within], *[c for c in offsets.columns if c not in ("__part", *within)])
    match = F.col("__part") == F.col("__p")
    for c in within:
        match &= F.col(c).eqNullSafe(F.col(f"__in_{c}"))
    return held.join(F.broadcast(named), match, "left").drop("__p", *[f"__in_{c}" for c in within])


def with_prefix(df: DataFrame, order: list, sums: dict[str, str], partitions: int | None = None, own: bool = True, within: list[str] = (), cheap: bool = False) -> DataFrame:
    """Adds running totals over the global order: ``sums`` maps new columns to columns (``*`` counts rows).

    Rows are range-partitioned and sorted; each partition's totals, one row each, give the offsets.
    ``own=False`` leaves the row itself out. With ``within``, totals start anew for each of its values, and a value with very many rows
    still spreads over partitions: only values that begin in an earlier partition have an offset, at most one for each partition.
    Nulls count as 0. For ``cheap`` see ``dealt``.
    """
    within = list(within)
    held = dealt(df, [*within, *order], partitions, cheap)
    value = lambda c: F.lit(1) if c == "*" else F.coalesce(F.col(c), F.lit(0))
    totals = held.groupBy("__part", *within).agg(*[F.sum(value(c)).alias(f"__{o}") for o, c in sums.items()])
    before = Window.partitionBy(*within).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("__part", *within, *[F.sum(f"__{o}").over(before).alias(f"__{o}") for o in sums])
    joined = in_part(held, offsets.where(" OR ".join(f"`__{o}` IS NOT NULL" for o in sums)), within)
    inside = Window.partitionBy("__part", *within).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if own else -1)
    out = joined.withColumns({o: F.coalesce(F.col(f"__{o}"), F.lit(0)) + F.coalesce(F.sum(value(c)).over(inside), F.lit(0)) for o, c in sums.items()})
    return out.drop("__part", *[f"__{o}" for o in sums])


def with_prior(df: DataFrame, source: DataFrame, within: list, slot, order: list, sums: dict) -> DataFrame:
    """Adds the totals of all earlier rows of the same values of ``within``, by ``slot`` (such as the day) and then ``order``: ``sums`` maps new columns to column expressions.

    Rows are shuffled once, by group and slot, and take what the slots before add up to; these totals come from ``source``, which holds the same rows and is read once.
    So a group with very many rows spreads over its slots, and only a slot must fit a task. Nulls count as 0; a null group or slot is one of its own, the null slot the first.
    """
    named = {"__slot": F.coalesce(slot.cast("long"), F.lit(-(2**63)))} | {f"__k{i}": F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("")) for i, c in enumerate(within)}
    keys = list(named)
    totals = source.groupBy(*[c.alias(k) for k, c in named.items()]).agg(*[F.sum(F.coalesce(c, F.lit(0))).alias(f"__{o}") for o, c in sums.items()])
    before = Window.partitionBy(*keys[1:]).orderBy("__slot").rowsBetween(Window.unboundedPreceding, -1)
    upto = totals.select(*keys, *[F.sum(f"__{o}").over(before).alias(f"__{o}") for o in sums])
    joined = df.withColumns(named).join(upto.hint("shuffle_hash"), keys, "left")  # the rows are sorted once, inside their slots
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = joined.withColumns({o: F.coalesce(F.col(f"__{o}"), F.lit(0)) + F.coalesce(F.sum(F.coalesce(c, F.lit(0))).over(inside), F.lit(0)) for o, c in sums.items()})
    return out.drop(*keys, *[f"__{o}" for o in sums])


def carried_forward(df: DataFrame, value: str, order: list[str], within: list[str], out: str) -> DataFrame:
    """Adds ``out``: the last value that is not null at or before each row of its group, by ``order``.

    Each range gives the last value of each of its groups; a group that goes on in a later range takes the last one of the ranges before. So a
    group with very many rows spreads over ranges, and what is broadcast is one row for each range at most.
    """
    held = dealt(df, [*within, *order])
    ends = held.groupBy("__part", *within).agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(*order))).alias("__end"))
    before = Window.partitionBy(*within).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ends.select("__part", *within, F.last("__end", ignorenulls=True).over(before).alias("__before")).where("__before IS NOT NULL")
    inside = Window.partitionBy("__part", *within).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = in_part(held, offsets, within)
    return joined.withColumn(out, F.coalesce(F.last(value, ignorenulls=True).over(inside), F.col("__before"))).drop("__part", "__before")


def with_halo(df: DataFrame, at: str, order: list[str], within: list[str], reach: int) -> DataFrame:
    """The rows in ranges of group and ``at`` (whole numbers), and to each range the earlier ranges' rows of its groups from ``reach`` before
    its first on. ``__part`` is the range and ``__own`` is false for what was given to it, so a frame that looks back ``reach`` at most is whole inside a range.

    Only groups that begin in an earlier range are given anything: one for each range at most. Rows that lie within ``reach`` are given to as many
    ranges as they span, so ranges should not be much shorter than the reach.
    """
    held = dealt(df, [*within, at, *order])
    lows = held.groupBy("__part", *within).agg(F.min(at).alias("__low"))
    earlier = F.lag("__part").over(Window.partitionBy(*within).orderBy("__part"))
    begun = lows.withColumn("__earlier", earlier).where("__earlier IS NOT NULL")
    named = begun.select(F.col("__part").alias("__p"), *[F.col(c).alias(f"__in_{c}") for c in within], "__low")
    match = (F.col("__part") < F.col("__p")) & (F.col(at) >= F.col("__low") - reach)
    for c in within:
        match &= F.col(c).eqNullSafe(F.col(f"__in_{c}"))
    given = held.join(F.broadcast(named), match).select(*[c for c in held.columns if c != "__part"], F.col("__p").alias("__part"), F.lit(False).alias("__own"))
    return held.withColumn("__own", F.lit(True)).unionByName(given)


#: Buckets into which one pass of ``quantiles`` splits a range of values.
BUCKETS = 4096


def quantiles(df: DataFrame, column: str, shares: dict[str, float], cheap: bool = False) -> DataFrame:
    """One row: the exact quantiles of ``column`` by name, linear between neighbours.

    Radix selection: each pass splits the ranges of values that hold a wanted rank, two for each share at most, into ``BUCKETS`` of equal width,
    counts them with their least and greatest value, and goes on in the bucket with the rank until that holds one value. A pass is a map-side count with at most
    2 * shares * ``BUCKETS`` rows from a task; a range shrinks ``BUCKETS`` times or more, so two or three passes do, and nothing is sorted. The column
    is written once, alone, unless ``cheap`` says that reading the rows again costs little, as after a stored table. Nulls and values that are not finite are left out; without values all are null.
    """
    value = F.col(column).cast("double")
    values = df.select(value.alias("v")).where(F.abs(F.col("v")) < float("inf"))
    held = values if cheap else durable(values)
    total, low, high = held.agg(F.count("v"), F.min("v"), F.max("v")).first()
    ranks = {r for q in shares.values() for r in (math.floor((total - 1) * q), math.ceil((total - 1) * q))} if total else set()
    found: dict[int, float] = {}
    open_: dict[int, tuple[float, float, int]] = {r: (low, high, r) for r in ranks}  # a rank's range of values, and the rank inside it
    while open_:
        found |= {r: lo for r, (lo, hi, _) in open_.items() if lo == hi}
        open_ = {r: v for r, v in open_.items() if r not in found}
        spans = sorted({(lo, hi) for lo, hi, _ in open_.values()})
        if not spans:
            break
        v, span, bucket = F.col("v"), F.lit(None).cast("int"), F.lit(None).cast("int")
        for i, (lo, hi) in enumerate(spans):
            inside = v.between(lo, hi)
            share = (v / 2 - lo / 2) / F.lit(hi / 2 - lo / 2)
            span, bucket = F.when(inside, i).otherwise(span), F.when(inside, F.least(F.floor(share * BUCKETS), F.lit(BUCKETS - 1)).cast("int")).otherwise(bucket)
        counts = held.select(span.alias("span"), bucket.alias("bucket"), "v").where("span IS NOT NULL").groupBy("span", "bucket").agg(F.count("v"), F.min("v"), F.max("v")).collect()
        placed: dict[tuple, list] = {}
        for i, b, n, lo, hi in sorted(counts):
            placed.setdefault(spans[i], []).append((n, lo, hi))
        for rank, (lo, hi, left) in open_.items():
            for n, least, most in placed[lo, hi]:
                if left < n:
                    open_[rank] = (least, most, left)
                    break
                left -= n
    if not cheap:
        discard(held)
    out = []
    for name, q in shares.items():
        place = (total - 1) * q
        a, b = (found[math.floor(place)], found[math.ceil(place)]) if total else (None, None)
        out.append(F.lit(None if a is None else a + (place - math.floor(place)) * (b - a)).cast("double").alias(name))
    return df.sparkSession.range(1).select(*out)
