"""Logistic and isotonic fits as Spark aggregates: Newton steps from sums, and pooling in ranges that meet at their seams."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldwise.functions.prices import clip_prob
from fieldwise.operators.scan import carried_forward, discard, durable

#: Newton steps of a fit at most; each is one pass of sums.
STEPS = 12
#: A step that moves every coefficient by less than this share of it (and of 1) is the last: the error left is of the order of its square.
SETTLED = 1e-9
#: Boundary points of an isotonic fit that are sent to all tasks; more are carried forward in ranges.
MOST_POINTS = 100_000


@dataclass(frozen=True)
class Logistic:
    """1 / (1 + exp(-(intercept + sum of weights * features)))."""

    features: tuple[str, ...]
    intercept: float
    weights: tuple[float, ...]

    def probability(self, columns: dict | None = None):
        """The probability as a column; ``columns`` may give a feature's column, absent and null ones are 0."""
        value = lambda c: F.coalesce((columns or {}).get(c, F.col(c)).cast("double"), F.lit(0.0))
        margin = sum((w * value(c) for c, w in zip(self.features, self.weights)), F.lit(self.intercept))
        return 1 / (1 + F.exp(-margin))


@dataclass(frozen=True)
class Isotonic:
    """A non-decreasing step fit; ``points`` holds score and value at both ends of each block."""

    points: DataFrame


def newton(rows: DataFrame, features: list[str], label: str, folds: list[int], l2: float = 1.0, steps: int = STEPS) -> dict[int, Logistic]:
    """A logistic fit for each fold, all in one job a step. ``rows`` has the features as doubles, the label, and ``folds``: the array of
    the folds that train on the row.

    A fold minimises the sum of its rows' log losses and l2 / 2 * (sum of squared weights); the intercept is free. Each step is one
    aggregation of gradient and Hessian sums, (d + 1) * (d + 4) / 2 for a fold, from which the driver solves a small system; when no fold moves any more, further ones
    would change nothing. A fold without rows keeps zeros.
    """
    d = len(features)
    theta = {f: np.zeros(d + 1) for f in folds}
    spread = rows.select(*features, label, F.explode("folds").alias("fold"))
    x = [F.lit(1.0), *[F.col(c) for c in features]]
    for _ in range(steps):
        old = dict(theta)
        given = F.create_map(*[v for f in folds for v in (F.lit(f), F.array(*[F.lit(float(t)) for t in theta[f]]))])
        known = spread.withColumn("__t", F.element_at(given, F.col("fold")))
        margin = sum((F.col("__t")[j] * x[j] for j in range(d + 1)), F.lit(0.0))
        known = known.withColumn("__q", 1 / (1 + F.exp(-margin))).withColumn("__v", F.col("__q") * (1 - F.col("__q")))
        sums = [F.sum((F.col("__q") - F.col(label)) * x[j]).alias(f"g{j}") for j in range(d + 1)] + [F.sum(F.col("__v") * x[i] * x[j]).alias(f"h{i}_{j}") for i in range(d + 1) for j in range(i, d + 1)]
        for row in known.groupBy("fold").agg(*sums).collect():  # one row for each fold
            t, ridge = theta[row["fold"]], np.diag([0.0] + [l2] * d)
            grad = np.array([row[f"g{j}"] for j in range(d + 1)]) + ridge @ t
            hess = np.array([[row[f"h{min(i, j)}_{max(i, j)}"] for j in range(d + 1)] for i in range(d + 1)]) + ridge
            theta[row["fold"]] = t - np.linalg.lstsq(hess, grad, rcond=None)[0] if np.linalg.matrix_rank(hess) <= d else t - np.linalg.solve(hess, grad)
        if all((np.abs(theta[f] - old[f]) <= SETTLED * (1 + np.abs(theta[f]))).all() for f in folds):
            break
    return {f: Logistic(tuple(features), float(t[0]), tuple(float(w) for w in t[1:])) for f, t in theta.items()}


def fit_logistic(df: DataFrame, features: list[str], label: str, l2: float = 1.0, steps: int = STEPS) -> Logistic:
    """One logistic fit over the rows with a label; absent and null features are 0."""
    value = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in df.columns else F.lit(0.0)
    rows = durable(df.where(F.col(label).isNotNull()).select(*[value(c).alias(f"x{i}") for i, c in enumerate(features)], F.col(label).cast("double").alias("y"), F.array(F.lit(0)).alias("folds")))
    made = newton(rows, [f"x{i}" for i in range(len(features))], "y", [0], l2, steps)[0]
    discard(rows)
    return Logistic(tuple(features), made.intercept, made.weights)


def fit_platt(df: DataFrame, prob: str, label: str, c: float = 1.0, eps: float = 1e-6) -> Logistic:
    """Logistic calibration on the clipped probability, its slope under an L2 penalty of 1 / C."""
    told = df.select(clip_prob(F.col(prob), eps).alias("p"), F.col(label).cast("double").alias("y")).na.drop()
    return fit_logistic(told, ["p"], "y", 1 / c)


def _pool(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pools neighbours of sorted blocks while an earlier mean is above a later one."""
    stack: list[list] = []
    for batch in batches:
        for lo, hi, n, s in zip(batch["lo"].tolist(), batch["hi"].tolist(), batch["n"].tolist(), batch["s"].tolist()):
            stack.append([lo, hi, n, s])
            while len(stack) > 1 and stack[-2][3] * stack[-1][2] >= stack[-1][3] * stack[-2][2]:
                _, high, m, t = stack.pop()
                stack[-1][1:] = [high, stack[-1][2] + m, stack[-1][3] + t]
    for a in range(0, len(stack), 10_000):
        yield pd.DataFrame(stack[a : a + 10_000], columns=["lo", "hi", "n", "s"])


def isotonic_blocks(df: DataFrame, score: str, label: str) -> DataFrame:
    """Blocks (lo, hi, n, s) of the least-squares non-decreasing fit of a 0/1 label on a score.

    Scores are counted first, so copies meet in map-side sums. Blocks are pooled inside ranges of scores; while means of two ranges that meet are out of order, what is left
    is dealt into a quarter as many ranges and pooled again. Pooling is associative, so the result does not depend on the ranges. The last round, if it
    comes to that, holds all blocks that are left in one task: as many as the fit has steps, not rows.
    """
    counted = df.groupBy(F.col(score).cast("double").alias("lo")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("long")).alias("s")).where("lo IS NOT NULL")
    blocks = durable(counted.select("lo", F.col("lo").alias("hi"), "n", "s"))
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while True:
        pooled = blocks.repartitionByRange(ranges, "lo").sortWithinPartitions("lo").mapInPandas(_pool, "lo double, hi double, n long, s long")
        made = durable(pooled.withColumn("part", F.spark_partition_id()))
        discard(blocks)
        mean = F.col("s") / F.col("n")
        seams = made.groupBy("part").agg(F.min("lo").alias("at"), F.min_by(mean, "lo").alias("first"), F.max_by(mean, "lo").alias("last")).orderBy("at").collect()  # a row for each range
        blocks = made
        if ranges == 1 or all(a["last"] < b["first"] for a, b in zip(seams, seams[1:])):
            return blocks.drop("part")
        ranges = max(1, ranges // 4)


def fit_isotonic(df: DataFrame, prob: str, label: str, eps: float = 1e-6) -> Isotonic:
    told = df.select(clip_prob(F.col(prob), eps).alias("p"), F.col(label).cast("long").alias("y")).na.drop()
    blocks = isotonic_blocks(told, "p", "y")
    ends = F.explode(F.array_distinct(F.array("lo", "hi"))).alias("score")
    return Isotonic(durable(blocks.select(ends, (F.col("s") / F.col("n")).alias("value"))))


def interpolate(df: DataFrame, model: Isotonic, at: str, out: str) -> DataFrame:
    """Adds the fit's value at a score: linear between neighbouring points, the end points' beyond them; null stays null."""
    if model.points.count() <= MOST_POINTS:
        points = np.array(sorted(tuple(r) for r in model.points.collect())).reshape(-1, 2)
        shared = df.sparkSession.sparkContext.broadcast(points)

        @F.pandas_udf("double")
        def value(s: pd.Series) -> pd.Series:
            x, y = shared.value.T
            return pd.Series(np.interp(s, x, y) if len(x) else np.nan, index=s.index, dtype="float64").where(s.notna())

        return df.withColumn(out, value(F.col(at).cast("double")))
    points = model.points.select(F.struct("score", "value").alias("__point"), F.col("score").alias("__at"), F.lit(True).alias("__is"))
    both = df.withColumns({"__at": F.col(at).cast("double"), "__is": F.lit(False)}).unionByName(points, allowMissingColumns=True)
    low = carried_forward(both.withColumn("__side", (~F.col("__is")).cast("int")), "__point", ["__at", "__side"], [], "__low")
    high = carried_forward(low.withColumn("__back", -F.col("__at")), "__point", ["__back", "__side"], [], "__high").where("NOT __is")
    x, (x0, y0), (x1, y1) = F.col("__at"), (F.col("__low.score"), F.col("__low.value")), (F.col("__high.score"), F.col("__high.value"))
    between = F.when(x1 > x0, y0 + (y1 - y0) * (x - x0) / (x1 - x0)).otherwise(F.coalesce(y0, y1))
    return high.withColumn(out, F.when(x.isNotNull(), F.coalesce(between, y0, y1))).select(*[c for c in df.columns if c != out], out)


def save(model: Logistic | Isotonic, path: str, spark: SparkSession | None = None) -> None:
    """A logistic model as one row of JSON, an isotonic one as its points in Parquet."""
    if isinstance(model, Isotonic):
        model.points.write.mode("overwrite").parquet(path)
    else:
        told = json.dumps({"features": model.features, "intercept": model.intercept, "weights": model.weights})
        (spark or SparkSession.active()).createDataFrame([(told,)], "value string").write.mode("overwrite").text(path)


def load(path: str, method: str) -> Logistic | Isotonic:
    spark = SparkSession.active()
    if method == "isotonic":
        return Isotonic(spark.read.parquet(path))
    told = json.loads(spark.read.text(path).first()[0])
    return Logistic(tuple(told["features"]), told["intercept"], tuple(told["weights"]))
