"""Probabilities, calibration and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldwise.functions.prices import clip_prob, finite
from fieldwise.operators import calibration
from fieldwise.operators.coerce import feature_columns
from fieldwise.operators.guards import Guards
from fieldwise.operators.joins import attach_labels, normalize
from fieldwise.operators.scan import discard, durable, quantiles, with_prefix
from fieldwise.operators.splits import grouped_time_cv


def predict_eb(df: DataFrame, columns: tuple[str, ...] | None = None, weights=(0.70, 0.15, 0.15), group: str = "race_id", eps: float = 1e-6) -> DataFrame:
    """The weighted sum of the horse's, jockey's and trainer's rating, normalised per contest and clipped. Without ``columns`` each rating is the
    first there is of ``eb_*_rt``, ``rating_*_rt`` and ``eb_*``; none is an error. A row that lacks one of them counts as 1e-9."""
    if columns is None:
        found = {e: next((c for c in (f"eb_{e}_rt", f"rating_{e}_rt", f"eb_{e}") if c in df.columns), None) for e in ("horse", "jockey", "trainer")}
        if missing := [e for e, c in found.items() if c is None]:
            raise ValueError(f"no rating of {missing} among {df.columns}")
        columns = tuple(found.values())
    blend = sum((w * F.col(c).cast("double") for c, w in zip(columns, weights)), F.lit(0.0))
    raw = F.coalesce(finite(blend), F.lit(0.0)) + 1e-9
    return normalize(df.withColumn("__raw", raw), "__raw", group, "model_prob").drop("__raw").withColumn("model_prob", clip_prob(F.col("model_prob"), eps))


def log_loss(p, y, eps: float = 1e-15):
    q = clip_prob(p, eps)
    return -(y * F.ln(q) + (1 - y) * F.ln(1 - q))


def binary_metrics(df: DataFrame, prob: str, label: str, threshold: float = 0.5) -> DataFrame:
    p, y = F.col(prob), F.col(label)
    return df.agg(F.count(F.lit(1)).alias("n"), F.avg(log_loss(p, y)).alias("logloss"), F.avg(((p >= threshold).cast("int") == y).cast("double")).alias("accuracy"), F.avg((p - y) * (p - y)).alias("brier"))


def auc(df: DataFrame, prob: str, label: str) -> DataFrame:
    """Rank-sum AUC, ties averaged: rows are first reduced to distinct scores."""
    scores = df.groupBy(F.col(prob).alias("score")).agg(F.sum(label).cast("long").alias("pos"), F.count(F.lit(1)).alias("all")).withColumn("neg", F.col("all") - F.col("pos"))
    ranked = with_prefix(scores, ["score"], {"neg_upto": "neg"})
    won = F.col("pos") * (F.col("neg_upto") - F.col("neg") + 0.5 * F.col("neg"))
    return ranked.agg((F.sum(won) / F.nullif(F.sum("pos") * F.sum("neg"), F.lit(0).cast("long"))).alias("auc"))


def logloss_by_contest(df: DataFrame, prob: str, label: str, group: str = "race_id") -> DataFrame:
    per = df.where(F.col(label) == 1).groupBy(group).agg(F.avg(-F.ln(clip_prob(F.col(prob), 1e-15))).alias("loss"))
    return per.agg(F.count(F.lit(1)).alias("contests"), F.avg("loss").alias("logloss"))


def reliability(df: DataFrame, prob: str, label: str, bins: int = 10) -> DataFrame:
    """Equal-width bins, closed on the right, the lowest value included."""
    at = F.greatest(F.least(F.ceil(F.round(F.col(prob) * bins, 9)), F.lit(bins)), F.lit(1)).cast("int") - 1
    return df.groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(prob).alias("mean_p"), F.avg(label).alias("mean_y"))


def ece_of(df: DataFrame, prob: str, label: str, bins: int = 10, strategy: str = "width") -> DataFrame:
    """Calibration error over bins of equal width or, with ``quantile``, of about equal counts."""
    return ece(reliability(df, prob, label, bins) if strategy == "width" else quantile_reliability(df, prob, label, bins))


def ece(table: DataFrame) -> DataFrame:
    return table.agg((F.sum(F.col("n") * F.abs(F.col("mean_p") - F.col("mean_y"))) / F.sum("n")).alias("ece"))


def quantile_reliability(df: DataFrame, prob: str, label: str, q: int = 10) -> DataFrame:
    """Bins with about equal counts, cut at exact quantiles; equal cuts merge. Both columns are written once."""
    df = durable(df.select(prob, label))
    ends = quantiles(df, prob, {f"__q{i}": i / q for i in range(1, q)}, cheap=True)
    cuts = ends.select(F.array_distinct(F.array(*[f"__q{i}" for i in range(1, q)])).alias("cuts"))
    placed = df.crossJoin(F.broadcast(cuts)).withColumn("bin", F.size(F.filter("cuts", lambda c: c < F.col(prob))))
    return placed.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg(prob).alias("mean_p"), F.avg(label).alias("mean_y"))


def pit(df: DataFrame, prob: str, label: str, group: str = "race_id", entity: str = "horse_id") -> DataFrame:
    """Probability integral transform of winners: what stands before, plus a hashed share of their own."""
    upto = F.sum(prob).over(Window.partitionBy(group).orderBy(entity).rowsBetween(Window.unboundedPreceding, 0))
    share = F.conv(F.left(F.md5(F.concat_ws(":", group, entity)), F.lit(8)), 16, 10).cast("double") / F.lit(2.0**32)
    placed = df.withColumn("pit", upto - F.col(prob) + share * F.col(prob)).where(F.col(label) == 1)
    return placed.select(group, entity, "pit")


def roi_deciles(df: DataFrame, prob: str, odds: str, label: str, keys: list[str], n: int = 10) -> DataFrame:
    """Return on unit stakes by decile of probability; ties follow the keys."""
    rows = durable(df.where(F.col(odds).isNotNull() & F.col(prob).isNotNull()).select(prob, odds, label, *keys))
    placed = with_prefix(rows, [prob, *keys], {"__at": "*"}, cheap=True).crossJoin(F.broadcast(rows.agg(F.count(F.lit(1)).alias("__all"))))
    decile = F.floor((F.col("__at") - 1) * n / F.col("__all")).cast("int")
    back = F.when(F.col(label) == 1, F.col(odds) - 1).otherwise(-1.0)
    return placed.groupBy(decile.alias("decile")).agg(F.count(F.lit(1)).alias("n"), F.avg(prob).alias("mean_p"), F.avg(back).alias("roi"))


def compare_market(df: DataFrame, model: str, market: str, label: str) -> DataFrame:
    y, m, k = F.col(label), F.col(model), F.col(market)
    rows = df.where(m.isNotNull() & k.isNotNull() & y.isNotNull())
    named = rows.agg(F.count(F.lit(1)).alias("n"), F.avg(log_loss(m, y, 1e-12)).alias("model_logloss"), F.avg(log_loss(k, y, 1e-12)).alias("market_logloss"), F.avg((m - y) * (m - y)).alias("model_brier"), F.avg((k - y) * (k - y)).alias("market_brier"))
    return named.withColumns({"logloss_gain": F.col("market_logloss") - F.col("model_logloss"), "brier_gain": F.col("market_brier") - F.col("model_brier")})


def apply_calibrator(df: DataFrame, model: calibration.Logistic | calibration.Isotonic, prob: str, out: str, eps: float = 1e-6) -> DataFrame:
    """Adds or replaces ``out``: the calibrated, clipped probability. ``eps`` clips what goes in and should be that of the fit."""
    p = clip_prob(F.col(prob), eps)
    if isinstance(model, calibration.Logistic):
        return df.withColumn(out, clip_prob(model.probability({model.features[0]: p}))).select(*[c for c in df.columns if c != out], out)
    made = calibration.interpolate(df.withColumn("__p", p), model, "__p", "__made")
    return made.withColumn(out, clip_prob(F.col("__made"))).select(*[c for c in df.columns if c != out], out)


fit_platt, fit_isotonic = calibration.fit_platt, calibration.fit_isotonic
save_calibrator, load_calibrator = calibration.save, calibration.load


#: Columns of a label table that may hold the label, in order.
LABEL_COLUMNS = ("won", "obs__is_winner", "is_winner", "label", "target")


def fit_calibrator(pred: DataFrame, method: str = "platt", labels: DataFrame | None = None, prob: str = "model_prob", keys=("race_id", "horse_id")):
    """A calibrator fitted on predictions with a label of their own or from a label table, and one row of Brier scores before and after.

    Rows without a finite probability and a label are left out. ``none`` fits nothing. A label table without a known label column is an error.
    The rows are written once, and that write tells whether any met a label.
    """
    guards = Guards()
    if "won" not in pred.columns:
        if labels is None:
            raise ValueError("predictions hold no label and no label table is given")
        column = next((c for c in LABEL_COLUMNS if c in labels.columns), None)
        if column is None:
            raise ValueError(f"no label among {LABEL_COLUMNS}")
        told = labels.select(*keys, (F.coalesce(F.col(column).cast("string").try_cast("double"), F.lit(0.0)) >= 0.5).cast("int").alias("won"))
        pred = attach_labels(pred, told, list(keys), guards=guards)
    rows = guards.settled(pred.where(F.col("won").isNotNull() & ~F.isnan(prob) & (F.abs(F.col(prob)) < float("inf"))).select(clip_prob(F.col(prob)).alias(prob), F.col("won").cast("int").alias("won")))
    if method == "none":
        model, after = None, rows.withColumn("__after", F.col(prob))
    else:
        model = fit_platt(rows, prob, "won") if method == "platt" else fit_isotonic(rows, prob, "won")
        after = apply_calibrator(rows, model, prob, "__after")
    brier = lambda c: F.avg((F.col(c) - F.col("won")) * (F.col(c) - F.col("won")))
    report = after.agg(F.count(F.lit(1)).alias("n"), brier(prob).alias("brier_before"), brier("__after").alias("brier_after"))
    return model, report.withColumn("improvement", F.col("brier_before") - F.col("brier_after"))


def summarize_run(df: DataFrame, prob: str, label: str, group: str = "race_id", entity: str = "horse_id") -> DataFrame:
    """One row: rows and contests, binary metrics, contest log loss, calibration error, and the PIT's mean and variance."""
    parts = [
        binary_metrics(df, prob, label).drop("accuracy"),
        logloss_by_contest(df, prob, label, group).withColumnRenamed("logloss", "contest_logloss"),
        ece(reliability(df, prob, label)),
        pit(df, prob, label, group, entity).agg(F.avg("pit").alias("pit_mean"), F.var_pop("pit").alias("pit_var")),
    ]
    out = parts[0]
    for part in parts[1:]:  # one row each
        out = out.crossJoin(F.broadcast(part))
    return out


def _classifier(features: list[str], kind: str, seed: int):
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier, LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    model = LogisticRegression(regParam=1e-3, maxIter=100) if kind == "logistic" else GBTClassifier(maxIter=20, maxDepth=4, seed=seed)
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features"), model])


def fit_classifier(df: DataFrame, features: list[str], label: str, kind: str = "logistic", seed: int = 7):
    rows = df.where(F.col(label).isNotNull())
    return _classifier(features, kind, seed).fit(rows.select(F.col(label).cast("double").alias("label"), *feature_columns(rows, features)))


def score(df: DataFrame, model, features: list[str], out: str = "model_prob", eps: float = 1e-6) -> DataFrame:
    """A model's probability for each row: that of a logistic fit, or of a saved Spark model its own probability, else the logistic of its margin, else its
    clipped prediction. Absent and null features are 0."""
    if isinstance(model, calibration.Logistic):
        given = {c: F.lit(0.0) for c in model.features if c not in df.columns}
        return df.withColumn(out, clip_prob(model.probability(given), eps))
    from pyspark.ml.functions import vector_to_array

    made = model.transform(df.select(*[F.col(c).alias(f"__{c}") for c in df.columns], *feature_columns(df, features)))
    if "probability" in made.columns:
        value = vector_to_array("probability")[1]
    elif "rawPrediction" in made.columns:
        value = 1 / (1 + F.exp(-vector_to_array("rawPrediction")[1]))
    else:
        value = F.col("prediction")
    return made.select(*[F.col(f"__{c}").alias(c) for c in df.columns if c != out], clip_prob(value, eps).alias(out))


def train_oof(df: DataFrame, features: list[str], label: str = "is_win", group: str = "race_id", time: str = "race_dt", k: int = 4, kind: str = "logistic", seed: int = 7) -> DataFrame:
    """Adds ``oof_prob``: each contest scored by the model fitted on the blocks of time before its own, and
    normalised within the contest; null for the first block, which nothing comes before.

    The rows are written once, and again with their folds. Logistic fits of all folds go forward together, one job a Newton step: a row's sums count for every fold after its block. Trees are fitted fold by fold.
    """
    held = durable(df)
    rows = durable(held.join(grouped_time_cv(held, group, time, k).where("role = 'valid'").select(group, F.col("fold").alias("__fold")), group, "left"))
    discard(held)
    own = F.coalesce("__fold", F.lit(-1))
    if kind == "logistic":
        value = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in df.columns else F.lit(0.0)
        xs = [f"x{i}" for i in range(len(features))]
        after = F.filter(F.array(*[F.lit(i) for i in range(k)]), lambda f: f > own)
        train = rows.where(F.col(label).isNotNull()).select(*[value(c).alias(x) for c, x in zip(features, xs)], F.col(label).cast("double").alias("__y"), after.alias("folds"))
        fits = calibration.newton(train, xs, "__y", list(range(k)))
        scored = F.lit(None).cast("double")
        for fold, fit in fits.items():
            named = calibration.Logistic(tuple(features), fit.intercept, fit.weights)
            scored = F.when(F.col("__fold") == fold, clip_prob(named.probability({c: value(c) for c in features}))).otherwise(scored)
        return normalize(rows.withColumn("__p", scored), "__p", group, "oof_prob").drop("__p", "__fold")
    parts = [rows.where("__fold IS NULL").drop("__fold").withColumn("oof_prob", F.lit(None).cast("double"))]
    for fold in range(k):
        model = fit_classifier(rows.where(own < fold), features, label, kind, seed)
        scored = score(rows.where(F.col("__fold") == fold).drop("__fold"), model, features, "__p")
        parts.append(normalize(scored, "__p", group, "oof_prob").drop("__p"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
