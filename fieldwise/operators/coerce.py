"""Projection, coercion and derived label operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldwise.functions.prices import finite, leading_rank, parse_fractional
from fieldwise.operators.guards import Guards, expected

TYPES = {"float": "double", "float32": "float", "int": "int", "int64": "long", "string": "string", "category": "string"}
#: Words for a win, and columns that may hold a win or a place, in order. All other words mean none.
WIN_TOKENS = ("y", "yes", "true", "t", "1", "1st", "win", "won", "winner")
WIN_COLUMNS = ("win", "won", "winner", "is_winner", "obs__is_winner", "result", "outcome")
RANK_COLUMNS = ("rank", "position", "pos", "finish_position", "official_position", "placing", "place", "obs__uposition")
#: Columns that may hold a contest's time, in order, before and after date and time as text; columns with a result.
TIME_SOURCES = ("race_dt", "race_datetime", "off_time")
TIME_ALIASES = ("date", "timestamp", "time", "ts")
FLAG_COLUMNS = ("won", "is_winner", "winner", "won_flag", "obs__is_winner")
POSITION_COLUMNS = ("finish_position", "position", "pos", "finpos", "placing", "obs__uposition")
RESULT_COLUMNS = ("finish_position", "position", "pos", "result", "outcome", "placing", "finish", "obs__uposition")
TRUE_TOKENS = ("true", "yes", "y", "winner", "win", "won", "1")
FALSE_TOKENS = ("false", "no", "n", "loser", "lose", "lost", "0")
FIRST_TOKENS = ("1", "1st", "first", "winner", "won")
#: Decimal prices, then fractional ones, in order.
DECIMAL_COLUMNS = ("decimal_odds", "mkt_odds_decimal", "odds_decimal", "sp_decimal", "isp_decimal", "bsp_decimal", "obs__bsp", "bsp", "betfair_sp", "bfsp", "sp", "ltp_5min")
FRACTIONAL_COLUMNS = ("fractional_odds", "odds_fractional", "sp_fractional", "sp_frac", "fractional", "obs__sp_frac", "obs__fractional_odds")


def rename(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed({a: b for a, b in names.items() if a in df.columns})


def coerce(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Casts by shorthand; values that do not fit become null."""
    return df.withColumns({c: F.col(c).cast("string").try_cast(TYPES[k]) for c, k in kinds.items() if c in df.columns})


def coerce_schema(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """As ``coerce``; strings are trimmed, categories trimmed and upper-cased."""
    out = coerce(df, kinds)
    trimmed = {c: F.trim(c) for c, k in kinds.items() if k == "string" and c in df.columns}
    return out.withColumns(trimmed | {c: F.upper(F.trim(c)) for c, k in kinds.items() if k == "category" and c in df.columns})


def to_utc(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: F.try_to_timestamp(F.col(c).cast("string")) for c in columns if c in df.columns})


def with_event_time(df: DataFrame) -> DataFrame:
    """``race_dt`` and ``off_time`` from the first source there is: a time column, date and time as text, a column of a general name."""
    found = next((c for c in TIME_SOURCES if c in df.columns), None)
    if found is None and {"date", "race_time"} <= set(df.columns):
        at = F.try_to_timestamp(F.concat_ws(" ", F.trim(F.col("date").cast("string")), F.trim(F.col("race_time").cast("string"))))
    else:
        found = found or next((c for c in TIME_ALIASES if c in df.columns), None)
        if found is None:
            raise ValueError(f"no time among {[*TIME_SOURCES, 'date and race_time', *TIME_ALIASES]}")
        at = F.try_to_timestamp(F.col(found).cast("string"))
    out = df.withColumn("race_dt", at)
    return out if "off_time" in df.columns else out.withColumn("off_time", F.col("race_dt"))


def clean_text(df: DataFrame, columns: list[str]) -> DataFrame:
    """White space of any kind collapsed to single blanks, none at the ends."""
    return df.withColumns({c: F.trim(F.regexp_replace(F.col(c).cast("string"), r"(?U)\s+", " ")) for c in columns if c in df.columns})


def ordered_category(df: DataFrame, column: str, levels: list[str]) -> DataFrame:
    """Upper-cased level, null outside ``levels``, and its position from 0."""
    place = F.create_map(*[x for i, v in enumerate(levels) for x in (F.lit(v.upper()), F.lit(i))])
    code = F.try_element_at(place, F.upper(F.trim(column)))
    return df.withColumn(f"{column}_code", code).withColumn(column, F.when(code.isNotNull(), F.upper(F.trim(column))))


def normalize_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.withColumns({k: F.upper(F.trim(F.col(k).cast("string"))) for k in keys})


def drop_null(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.na.drop(subset=columns)


def with_field_size(df: DataFrame, group: str = "race_id") -> DataFrame:
    if "field_size" in df.columns:
        return df
    size = F.col("n_runners") if "n_runners" in df.columns else F.count(F.lit(1)).over(Window.partitionBy(group))
    return df.withColumn("field_size", size.cast("int"))


def with_win(df: DataFrame) -> DataFrame:
    """``is_win`` from the first column that may hold a win: 1 for a word or number that means one, 0 for all else and null. Without such
    a column, 1 where the first column with a place begins with the number 1. Without either it is null."""
    text = lambda c: F.lower(F.trim(F.col(c).cast("string")))
    if told := next((c for c in WIN_COLUMNS if c in df.columns), None):
        won = text(told).isin(*WIN_TOKENS)
    elif told := next((c for c in RANK_COLUMNS if c in df.columns), None):
        won = leading_rank(text(told)) == 1
    else:
        return df.withColumn("is_win", F.lit(None).cast("int"))
    return df.withColumn("is_win", F.coalesce(won, F.lit(False)).cast("int"))


def _readings(df: DataFrame, column: str) -> dict[str, tuple]:
    """Ways to read a label from a column: by name the label and what makes the way usable."""
    text = F.lower(F.trim(F.col(column).cast("string")))
    number = text.try_cast("double")
    first = F.coalesce((F.regexp_extract(text, r"^\s*(\d+)", 1) == "1") | text.isin(*FIRST_TOKENS), F.lit(False))
    return {
        "number": (F.coalesce(number != 0, F.lit(False)), number.isNotNull()),
        "token": (F.coalesce(text.isin(*TRUE_TOKENS), F.lit(False)), text.isin(*TRUE_TOKENS, *FALSE_TOKENS)),
        "place": (F.coalesce(number == 1, F.lit(False)), number.isNotNull()),
        "result": (first, first),
    }


def with_label(df: DataFrame, candidates: list[str] | None = None, label: str = "label") -> DataFrame:
    """A strict 0/1 label from the first column, and way of reading it, that is usable in any row.

    Flags come first (numbers other than 0, or words), then places as numbers (1 wins), then places and results as text. Named ``candidates`` are
    read as flags, or as places first if they bear a place's name. Values that say nothing are 0. One pass finds what is usable.
    """
    if candidates is None:
        ways = [(c, w) for c in FLAG_COLUMNS for w in ("number", "token")] + [(c, "place") for c in POSITION_COLUMNS] + [(c, "result") for c in RESULT_COLUMNS]
    else:
        ways = [(c, w) for c in candidates for w in (("place", "result") if c in POSITION_COLUMNS else ("number", "token", "result"))]
    ways = [(c, w) for c, w in ways if c in df.columns]
    usable = df.agg(*[F.count_if(_readings(df, c)[w][1]).alias(f"{c}~{w}") for c, w in ways]).first() if ways else {}
    chosen = next(((c, w) for c, w in ways if usable[f"{c}~{w}"]), None)
    if chosen is None:
        raise ValueError(f"no usable label among {candidates or df.columns}")
    return df.withColumn(label, _readings(df, chosen[0])[chosen[1]][0].cast("int"))


def extract_odds(df: DataFrame, keys=("race_id", "horse_id"), guards: Guards | None = None) -> DataFrame:
    """Keys and ``decimal_odds`` over 1 from the first decimal column there is, else the first fractional one; none left is an error (see ``expected``)."""
    decimal = next((c for c in DECIMAL_COLUMNS if c in df.columns), None)
    fractional = next((c for c in FRACTIONAL_COLUMNS if c in df.columns), None)
    if decimal is None and fractional is None:
        raise ValueError(f"no odds among {[*DECIMAL_COLUMNS, *FRACTIONAL_COLUMNS]}")
    price = finite(F.col(decimal).cast("string").try_cast("double")) if decimal else parse_fractional(F.col(fractional))
    out = df.select(*keys, price.alias("decimal_odds")).where("decimal_odds > 1")
    return expected(guards, out, F.count(F.lit(1)) > 0, f"no usable price in {decimal or fractional}")


def with_position(df: DataFrame, group: str = "race_id", time: str = "completion_time") -> DataFrame:
    if time in df.columns:
        return df.withColumn("pos", F.dense_rank().over(Window.partitionBy(group).orderBy(F.asc_nulls_last(time))).cast("int"))
    return df.withColumn("pos", F.when(F.col("is_win") == 1, 1).otherwise(2))


def alias(df: DataFrame, names: dict[str, list[str]]) -> DataFrame:
    """New columns from the first candidate present; absent ones stay absent."""
    found = {n: next((c for c in cs if c in df.columns), None) for n, cs in names.items()}
    return df.withColumns({n: F.col(c) for n, c in found.items() if c})


def forbid_prefix(df: DataFrame, prefixes: list[str], action: str = "drop") -> DataFrame:
    bad = [c for c in df.columns if c.startswith(tuple(prefixes))]
    if bad and action == "raise":
        raise ValueError(f"columns of the current event: {bad}")
    return df.drop(*bad)


def with_place(df: DataFrame, group: str = "race_id") -> DataFrame:
    size = F.count(F.lit(1)).over(Window.partitionBy(group))
    paid = F.col("places_paid") if "places_paid" in df.columns else F.when(size >= 8, 3).otherwise(2)
    return df.withColumn("is_place", (F.col("pos") <= paid).cast("int"))


def filter_range(df: DataFrame, column: str, low: float, high: float) -> DataFrame:
    value = F.col(column).cast("string").try_cast("double")
    return df.where(value.between(low, high))


def feature_columns(df: DataFrame, columns: list[str]) -> list:
    return [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) if c in df.columns else F.lit(0.0).alias(c) for c in columns]


def align_features(df: DataFrame, columns: list[str]) -> DataFrame:
    """Exactly ``columns``, as doubles; absent and null values are 0."""
    return df.select(*feature_columns(df, columns))


def make_xy(df: DataFrame, target: str, drop: list[str], prefixes=("obs__",)) -> DataFrame:
    """Numeric predictors and the target; observed columns are rejected."""
    forbid_prefix(df.drop(*drop, target), list(prefixes), "raise")
    numeric = [c for c, t in df.dtypes if t in ("int", "bigint", "float", "double", "smallint", "tinyint") and c not in (*drop, target)]
    return df.select(*[F.col(c).cast("double").alias(c) for c in numeric], F.col(target).cast("int").alias("target"))


def pick_prob_col(df: DataFrame, priorities: list[str]) -> str:
    """The first priority present; else the shortest numeric column with over 98 % of values in [0, 1]."""
    for c in priorities:
        if c in df.columns:
            return c
    numeric = [c for c, t in df.dtypes if t in ("int", "bigint", "float", "double")]
    share = df.agg(*[F.avg(F.col(c).between(0, 1).cast("double")).alias(c) for c in numeric]).first()
    good = [c for c in numeric if (share[c] or 0) > 0.98]
    if not good:
        raise ValueError("no column looks like a probability")
    return min(good, key=lambda c: (len(c), c))
