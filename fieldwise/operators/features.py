"""Leak-free history features. Windows of one entity share their sort; nothing looks at the row itself or later."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldwise.functions.prices import bucket
from fieldwise.operators.coerce import forbid_prefix, with_place
from fieldwise.operators.joins import asof_join
from fieldwise.operators.scan import durable, with_halo, with_prefix, with_prior
from fieldwise.operators.sets import dedupe

DAY_US = 86_400_000_000
TIES = ("race_id", "horse_id")


def micros(time: str):
    return F.unix_micros(F.col(time).cast("timestamp"))


def day(time: str):
    return F.floor(micros(time) / F.lit(float(DAY_US)))


#: Rows of one key and day that one task sorts and adds up; with more of them, ranges split days.
MOST_OF_A_DAY = 2_000_000


def short_days(df: DataFrame, keys: list[str], time: str) -> bool:
    counts = df.groupBy(*keys, day(time).alias("__day")).agg(F.count(F.lit(1)).alias("n"))
    return (counts.agg(F.max("n")).first()[0] or 0) <= MOST_OF_A_DAY


def history(entity: list[str], time: str, ties=TIES, strict: bool = False):
    """All earlier rows of an entity: by time then keys, or by time alone (``strict``)."""
    if strict:
        return Window.partitionBy(*entity).orderBy(micros(time)).rangeBetween(Window.unboundedPreceding, -1)
    return Window.partitionBy(*entity).orderBy(micros(time), *ties).rowsBetween(Window.unboundedPreceding, -1)


def rolling_form(df: DataFrame, entity: str, time: str, flags: list[str], days=(90, 180, 365), min_history: int = 1, hot: bool = False) -> DataFrame:
    """Counts, sums and rates over [t - h, t); all null on an empty frame, rates also under ``min_history``. Rows of one entity and time see the same
    frame, so ``hot`` first adds them up to one row: these are dealt by entity and time in ranges, each of which is also given the rows of the longest frame
    before it, and the rows, which are read twice, take theirs by a join."""
    rows, by, one, many = df, [entity], F.lit(1), {f: f for f in flags}
    if hot:
        many = {f: f"__f{i}" for i, f in enumerate(flags)}
        times = df.groupBy(F.col(entity).alias("__who"), micros(time).alias("__us")).agg(F.count(F.lit(1)).alias("__rows"), *[F.sum(f).alias(c) for f, c in many.items()])
        rows, by, one = with_halo(times, "__us", [], ["__who"], max(days) * DAY_US), ["__part", "__who"], F.col("__rows")
    out = {}
    for h in days:
        frame = Window.partitionBy(*by).orderBy("__us" if hot else micros(time)).rangeBetween(-h * DAY_US, -1)
        n = F.sum(one).over(frame) if hot else F.count(one).over(frame)
        out[f"n_{h}"] = F.when(n > 0, n)
        for f in flags:
            total = F.sum(many[f]).over(frame)
            out[f"{f}_sum_{h}"], out[f"{f}_rate_{h}"] = total, F.when(n >= min_history, total / n)
    made = rows.withColumns(out)
    if not hot:
        return made
    seen = made.where("__own").select("__who", "__us", *out)
    return df.join(seen, F.col(entity).eqNullSafe(F.col("__who")) & micros(time).eqNullSafe(F.col("__us")), "left").drop("__who", "__us")


#: Half-lives of one era: powers of two up to this stay well inside a double.
ERA = 400


def decayed_sum(df: DataFrame, entity: list[str], time: str, columns: dict[str, str], half_life: float, ties=TIES, strict: bool = False, hot: bool = False) -> DataFrame:
    """Prior sums with weight 0.5 ** (days / half_life), as prefix sums rebased to eras of ``ERA`` half-lives.

    A row's sum is that of the earlier rows of its era and that of the era before; what is older weighs under 2 ** -``ERA``, less than a
    double can add to. ``strict`` leaves out rows of the same time. ``hot`` writes the rows and deals them by entity, era and day (or by time in ranges, where a
    day holds more than ``MOST_OF_A_DAY``), whose totals are carried on; it follows ``ties``, so it can't be strict. Rows without a time have no sum.
    """
    if hot and strict:
        raise ValueError("a strict sum has no order among rows of the same time to deal them by")
    age = micros(time) / F.lit(float(DAY_US)) / F.lit(float(half_life))
    era = F.floor(age / ERA).cast("int")
    if hot:  # eras and ages are worked out where they are needed, so they are neither written nor shuffled
        old, stored = age - era * ERA, durable(df)
        up, down = F.pow(F.lit(2.0), old), F.pow(F.lit(2.0), -old)
        eras = [F.sum(F.col(c) * F.pow(F.lit(2.0), old - ERA)).alias(f"__e{i}") for i, c in enumerate(columns.values())]
        if short_days(stored, entity, time):
            ran = with_prior(stored, stored, [*[F.col(c) for c in entity], era], day(time), [micros(time), *ties], {f"__s{i}": F.col(c) * up for i, c in enumerate(columns.values())})
        else:
            rows = stored.withColumns({"__era": era, "__age": old} | {f"__v{i}": F.col(c) * up for i, c in enumerate(columns.values())})
            ran = with_prefix(rows, ["__age", *ties], {f"__s{i}": f"__v{i}" for i in range(len(columns))}, own=False, within=[*entity, "__era"], cheap=True)
        ends = stored.agg(F.min(era), F.max(era)).first()
        if ends[0] == ends[1]:  # one era, or no row with a time: nothing lies in an era before
            sums = {o: F.col(f"__s{i}") * down for i, o in enumerate(columns)}
            return ran.withColumns(sums).select(*[c for c in df.columns if c not in columns], *columns)
        before = stored.groupBy(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(entity)], (era + 1).alias("__next")).agg(*eras)
        same = era == F.col("__next")
        for i, c in enumerate(entity):
            same &= F.col(c).eqNullSafe(F.col(f"__k{i}"))
        joined = ran.join(before, same, "left")
        sums = {o: (F.col(f"__s{i}") + F.coalesce(F.col(f"__e{i}"), F.lit(0.0))) * down for i, o in enumerate(columns)}
        return joined.withColumns(sums).select(*[c for c in df.columns if c not in columns], *columns)
    grown = df.withColumn("__era", era).withColumn("__age", age - F.col("__era") * ERA)
    up, down = F.pow(F.lit(2.0), "__age"), F.pow(F.lit(2.0), -F.col("__age"))
    before = Window.partitionBy(*entity).orderBy("__era").rangeBetween(-1, -1)
    here = history([*entity, "__era"], time, ties, strict)
    # the wider window first: one shuffle by entity serves both
    grown = grown.withColumns({f"__e{i}": F.sum(F.col(c) * F.pow(F.lit(2.0), F.col("__age") - ERA)).over(before) for i, c in enumerate(columns.values())})
    sums = {o: (F.coalesce(F.sum(F.col(c) * up).over(here), F.lit(0.0)) + F.coalesce(F.col(f"__e{i}"), F.lit(0.0))) * down for i, (o, c) in enumerate(columns.items())}
    return grown.withColumns(sums).drop("__age", "__era", *[f"__e{i}" for i in range(len(columns))])


def expanding_mean(df: DataFrame, time: str, flag: str, out: str, ties=TIES) -> DataFrame:
    """The mean of all rows before each one in the whole table's order; null for the first."""
    ran = with_prefix(df.withColumn("__at", micros(time)), ["__at", *ties], {"__n": "*", "__w": flag}, own=False)
    return ran.withColumn(out, F.try_divide(F.col("__w"), F.col("__n"))).drop("__at", "__n", "__w")


def hot_counts(df: DataFrame, keys: list[str], time: str, flag: str, ties=TIES, source: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Adds ``__w`` and ``__n``, the sum and number of ``flag`` over all earlier rows of the same keys, dealt by keys and day (or by time in ranges, where a day holds more
    than ``MOST_OF_A_DAY``). ``source`` is a stored table of the same rows; without it the rows are written first. Gives that table too."""
    rows = durable(df) if source is None else df
    source, one = rows if source is None else source, F.col(flag).isNotNull().cast("long")
    if short_days(source, keys, time):
        return with_prior(rows, source, [F.col(k) for k in keys], day(time), [micros(time), *ties], {"__w": F.col(flag), "__n": one}), source
    held = rows.withColumns({"__at": micros(time), "__one": one})
    return with_prefix(held, ["__at", *ties], {"__w": flag, "__n": "__one"}, own=False, within=keys, cheap=True).drop("__at", "__one"), source


def prior_rate(df: DataFrame, keys: list[str], time: str, flag: str, out: str, ties=TIES, strict: bool = False, hot: bool = False) -> DataFrame:
    """Rate over all earlier rows of the same keys. ``strict`` leaves out rows of the same time. ``hot`` writes the rows and deals them
    by keys and day, so that keys with a large share of all rows meet no single task."""
    if hot:
        ran, _ = hot_counts(df, keys, time, flag, ties)
        return ran.withColumn(out, F.col("__w") / F.nullif(F.col("__n"), F.lit(0))).drop("__w", "__n")
    w = history(keys, time, ties, strict)
    return df.withColumn(out, F.sum(flag).over(w) / F.nullif(F.count(flag).over(w), F.lit(0)))


def top_levels_of(df: DataFrame, columns: list[str], n: int) -> dict[str, list]:
    """The ``n`` most frequent levels of each of some text columns, from one pass. Collects at most n names for each."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("level")) for c in columns])).alias("x")).select("x.*")
    first = F.row_number().over(Window.partitionBy("column").orderBy(F.desc("count"), F.asc_nulls_last("level")))
    rows = long.groupBy("column", "level").count().withColumn("k", first).where(F.col("k") <= n).collect()
    return {c: [r["level"] for r in sorted(rows, key=lambda r: r["k"]) if r["column"] == c] for c in columns}


def one_hot_topn(df: DataFrame, column: str, n: int, top: list | None = None) -> DataFrame:
    """One 0/1 column for each of the ``n`` most frequent levels and one for the rest. Collects at most n names, if they are not given."""
    if top is None:
        top = [r[0] for r in df.groupBy(column).count().orderBy(F.desc("count"), F.asc_nulls_last(column)).limit(n).collect()]
    hits = {f"{column}_{'null' if v is None else v}": F.col(column).eqNullSafe(F.lit(v)).cast("int") for v in top}
    other = 1 - sum((F.col(column).eqNullSafe(F.lit(v)).cast("int") for v in top), F.lit(0))
    return df.withColumns(hits | {f"{column}_OTHER": other})


def delta_median(df: DataFrame, column: str, group: str, out: str) -> DataFrame:
    return df.withColumn(out, F.col(column) - F.expr(f"percentile({column}, 0.5) OVER (PARTITION BY {group})"))


def draw_features(df: DataFrame, draw: str = "draw", group: str = "race_id") -> DataFrame:
    n = F.count(F.lit(1)).over(Window.partitionBy(group))
    scaled = df.withColumn("draw_norm", (F.col(draw) - 1) / F.greatest(n - 1, F.lit(1)))
    low, mid = F.col("draw_norm") < 0.33, F.col("draw_norm") < 0.66
    return scaled.withColumns({"draw_low": low.cast("int"), "draw_mid": (~low & mid).cast("int"), "draw_high": (~mid & (F.col("draw_norm") <= 1.01)).cast("int")})


def prior_eb_rate(df: DataFrame, entities: list[str], time: str, flag: str, n0: float = 20.0, ties=TIES, baseline: str = "global", strict: bool = False, hot: tuple[str, ...] = (), cheap: bool = False, mean_of: DataFrame | None = None) -> DataFrame:
    """(wins before + n0 * mu) / (runs before + n0); mu is the mean of all rows, or of all earlier ones (``expanding``, 0.5 before the first);
    a null entity gives mu. Rows are dealt by entity and day for the entities in ``hot``, each time written before it unless ``cheap`` says that ``df`` is a stored table;
    after that, nothing reads ``df`` again. Counts are carried, and turned into rates at the end. ``mean_of`` may give a table of the same rows that costs less to read for their mean."""
    out, source = df, df
    if baseline == "expanding":
        out = expanding_mean(df, time, flag, "__mu", ties).withColumn("__mu", F.coalesce("__mu", F.lit(0.5)))
    for i, e in enumerate(entities):
        if e in hot:
            out, source = hot_counts(out, [e], time, flag, ties, source if cheap else None)
            out = out.withColumnsRenamed({"__w": f"__w{i}", "__n": f"__n{i}"})
        else:
            w = history([e], time, ties, strict)
            out = out.withColumns({f"__w{i}": F.coalesce(F.sum(flag).over(w), F.lit(0)), f"__n{i}": F.count(flag).over(w)})
    if baseline != "expanding":
        out = out.crossJoin(F.broadcast((source if mean_of is None else mean_of).agg(F.avg(flag).alias("__mu"))))
    for i, e in enumerate(entities):
        shrunk = (F.col(f"__w{i}") + n0 * F.col("__mu")) / (F.col(f"__n{i}") + n0)
        out = out.withColumn(f"eb_{e.removesuffix('_id')}", F.when(F.col(e).isNull(), F.col("__mu")).otherwise(shrunk)).drop(f"__w{i}", f"__n{i}")
    return out.drop("__mu")


def build_features(df: DataFrame, ratings: DataFrame | None = None, days=(90, 365), half_lives=(90.0,), distance_edges=(1000, 1600, 2400, 3000), levels: int = 5) -> DataFrame:
    """The feature table: keys, times, ``is_win`` and ``is_place``, and form, decay, affinity, context, handicap and draw blocks as columns of the same row.

    ``ratings`` holds entity, ``race_dt`` and rating columns for horse, jockey and trainer; each row gets the last ones before or at its time, with
    the suffix ``_rt``. Columns of the current event (``obs__``) are dropped first. All that looks at a contest comes first, then all that looks at one kind of
    entity after the other, which its ratings are joined to first: so rows are shuffled once for each. ``df`` is read several times, for the mean and the levels too.
    """
    out = forbid_prefix(with_place(df), ["obs__"]).withColumn("off_time", F.col("race_dt"))
    out = out.withColumn("distance_bucket", bucket(F.col("distance_m"), list(distance_edges)))
    for column, top in top_levels_of(df, ["going", "course"], levels).items():
        out = one_hot_topn(out, column, levels, top)
    out = draw_features(delta_median(delta_median(out, "official_rating", "race_id", "rating_delta"), "weight_lbs", "race_id", "weight_delta"))
    rates = {"horse_id": {"horse_course": "course", "horse_distance": "distance_bucket"}, "jockey_id": {"jockey_going": "going"}, "trainer_id": {"trainer_discipline": "discipline"}}
    for entity, with_context in rates.items():
        own = [c for c in ratings.columns if c.startswith(entity.removesuffix("_id")) and c != entity] if ratings is not None else []
        if own:
            one = dedupe(ratings.select(entity, "race_dt", *own), [entity, "race_dt"], own)
            out = asof_join(out, one, [entity], "race_dt", "race_dt", own, "_rt")
        if entity == "horse_id":
            out = rolling_form(out, entity, "race_dt", ["is_win", "is_place"], days)
            for h in half_lives:
                out = decayed_sum(out.withColumn("__one", F.lit(1.0)), [entity], "race_dt", {f"win_decayed_{int(h)}": "is_win", f"runs_decayed_{int(h)}": "__one"}, h).drop("__one")
        out = prior_eb_rate(out, [entity], "race_dt", "is_win", mean_of=df)  # by entity alone, which serves the rates in a context too
        for name, context in with_context.items():
            out = prior_rate(out, [entity, context], "race_dt", "is_win", f"{name}_rate")
    return out
