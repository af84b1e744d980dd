"""Registered queries of the contest operators, each with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldwise.functions import prices
from fieldwise.operators import betting, calibration, checks, coerce, features, guards, joins, models, profile, ratings, scan, sets, splits
from fieldwise.plans.fixtures import RUNNERS_SQL, runners
from fieldwise.sources import io

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
KEYS = ["race_id", "horse_id"]


def query(sql: str | None = None, base: bool = True):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = (RUNNERS_SQL + sql) if base else sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*[(F.round(c, places) + 0.0).alias(c) if t == "double" else F.col(c).cast("long").alias(c) if t in ("int", "bigint") else F.col(c) for c, t in df.dtypes])


def market(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.with_market(runners(spark, sf_dir))


ENTITIES = ["horse_id", "jockey_id", "trainer_id"]


def rated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model probabilities and edges. The entrants are written once, and again with the counts of horses and jockeys: so the disk holds the shuffles of one of these steps
    at a time, and the few trainers are dealt by day. What prices imply is worked out after the ratings, so that it goes through none of their shuffles."""
    priced = scan.durable(joins.with_odds(runners(spark, sf_dir)).select("race_id", *ENTITIES, "race_dt", "discipline", "draw", "is_win", "mkt_odds_decimal"))
    known = features.prior_eb_rate(priced, ENTITIES, "race_dt", "is_win", hot=("trainer_id",))
    scan.discard(priced)
    return betting.edges(joins.with_implied(models.predict_eb(known)))


def rated_once(spark: SparkSession, sf_dir: str, *columns) -> DataFrame:
    """Columns of ``rated``, written for queries that read them several times."""
    return scan.durable(rated(spark, sf_dir).select(*columns))


def with_ratings(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Keys, time, wins and further columns of the entrants, written as in ``rated``, with the ratings before each."""
    own = scan.durable(runners(spark, sf_dir).select("race_id", *ENTITIES, "race_dt", "is_win", *columns))
    known = features.prior_eb_rate(own, ENTITIES, "race_dt", "is_win", hot=("trainer_id",))
    scan.discard(own)
    return known


# SQL that several queries share: ratings, model probabilities and edges
_W = "PARTITION BY {0} ORDER BY us, race_id, horse_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
_EB = "(coalesce(sum(is_win) OVER (" + _W + "), 0) + 20 * (SELECT avg(is_win) FROM runners)) / (count(is_win) OVER (" + _W + ") + 20)"
_RATED = f""",
eb AS (SELECT *, {_EB.format("horse_id")} AS eb_horse, {_EB.format("jockey_id")} AS eb_jockey, {_EB.format("trainer_id")} AS eb_trainer FROM market),
m1 AS (SELECT *, 0.70 * eb_horse + 0.15 * eb_jockey + 0.15 * eb_trainer + 1e-9 AS blend FROM eb),
m2 AS (SELECT *, greatest(least(blend / sum(blend) OVER (PARTITION BY race_id), 1 - 1e-6), 1e-6) AS model_prob FROM m1),
rated AS (SELECT *, model_prob - greatest(least(implied, 1 - 1e-6), 1e-6) AS edge FROM m2)
"""
_BETS = (
    _RATED
    + """, bets0 AS (SELECT *, row_number() OVER (PARTITION BY race_id ORDER BY round(edge, 12) DESC, horse_id) AS k FROM rated WHERE edge >= 0.02 AND price > 1 AND price <= 20),
bets AS (SELECT *, CASE WHEN is_win = 1 THEN price - 1 ELSE -1 END AS pnl FROM bets0 WHERE k = 1)
"""
)
_SUMMARY = "count(*) AS bets, count(DISTINCT race_id) AS contests, round(count(*)::DOUBLE, 6) AS staked, round(sum(pnl), 6) AS pnl, round(sum(pnl) / count(*), 6) AS roi, round(avg(is_win), 6) AS hit_rate, round(avg(price), 6) AS mean_odds"


def bets_of(df: DataFrame) -> DataFrame:
    return betting.with_pnl(betting.stake(betting.select_bets(df.withColumn("edge", F.round("edge", 12)))))


@query(_BETS + f"SELECT discipline, {_SUMMARY} FROM bets GROUP BY discipline")
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From raw rows to one summary of settled bets for each discipline."""
    return rounded(betting.summary(bets_of(rated(spark, sf_dir)), ["discipline"]))


@query("SELECT l_orderkey, round(l_extendedprice * (1 - l_discount), 6) + 0.0 AS net FROM lineitem WHERE l_quantity < 10", base=False)
def s2_read_columns(spark, sf_dir):
    lines = io.read_columns(spark, f"{sf_dir}/lineitem.parquet", ["l_orderkey", "price", "l_discount", "l_quantity"], {"price": ["l_extendedprice"]})
    return rounded(lines.where("l_quantity < 10").select("l_orderkey", (F.col("price") * (1 - F.col("l_discount"))).alias("net")))


@query("SELECT s_suppkey, s_name FROM supplier", base=False)
def s3_read_table(spark, sf_dir):
    return io.read_table(spark, f"{sf_dir}/supplier.parquet", lower=True).select("s_suppkey", "s_name")


@query("SELECT (SELECT count(*) FROM lineitem) AS rows_in, count(*) AS rows_out, count(DISTINCT race_id) AS contests, strftime(min(race_dt), '%Y-%m-%d') AS first_time, strftime(max(race_dt), '%Y-%m-%d') AS last_time, (SELECT count(*) FROM lineitem) - count(*) AS removed FROM runners")
def s7_ingest_audit(spark, sf_dir):
    audit = profile.ingest_audit(table(spark, sf_dir, "lineitem"), runners(spark, sf_dir), "race_id", "race_dt")
    return rounded(audit.withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in ("first_time", "last_time")}))


@query("SELECT o_orderkey AS race_id, o_orderstatus AS discipline FROM orders", base=False)
def p1_rename(spark, sf_dir):
    return coerce.rename(table(spark, sf_dir, "orders"), {"o_orderkey": "race_id", "o_orderstatus": "discipline", "absent": "x"}).select("race_id", "discipline")


@query("SELECT event_id, try_cast(props AS DOUBLE) AS props, round(value, 6) AS value, try_cast(event_type AS BIGINT) AS event_type FROM events", base=False)
def p2_coerce(spark, sf_dir):
    return rounded(coerce.coerce(table(spark, sf_dir, "events").select("event_id", "props", "value", "event_type"), {"props": "float", "value": "float", "event_type": "int64"}))


@query("SELECT p_partkey, trim(p_name) AS p_name, upper(trim(p_brand)) AS p_brand, p_size::BIGINT AS p_size FROM part", base=False)
def p3_coerce_schema(spark, sf_dir):
    return rounded(coerce.coerce_schema(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_size"), {"p_name": "string", "p_brand": "category", "p_size": "int"}))


@query("SELECT o_orderkey, epoch_us(o_orderdate) AS us FROM orders", base=False)
def p4_to_utc(spark, sf_dir):
    text = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("string").alias("at"))
    return coerce.to_utc(text, ["at"]).select("o_orderkey", F.unix_micros("at").alias("us"))


@query("SELECT o_orderkey, epoch_us(o_orderdate::DATE::TIMESTAMP + INTERVAL 90 MINUTE) AS us FROM orders", base=False)
def p5_event_time(spark, sf_dir):
    parts = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("date"), F.lit("01:30").alias("race_time"))
    return coerce.with_event_time(parts).select("o_orderkey", F.unix_micros("off_time").alias("us"))


@query("SELECT event_id, epoch_us(ts) AS us FROM events", base=False)
def p5_event_time_alias(spark, sf_dir):
    """A table whose only time has a general name."""
    return coerce.with_event_time(table(spark, sf_dir, "events").select("event_id", "ts")).select("event_id", F.unix_micros("race_dt").alias("us"))


#: Unicode white space as both sides of the check see it.
_WHITE = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


@query(f"SELECT doc_id, trim(regexp_replace(text, '{_WHITE}', ' ', 'g'), ' ') AS text FROM documents", base=False)
def p6_clean_text(spark, sf_dir):
    return coerce.clean_text(table(spark, sf_dir, "documents").select("doc_id", "text"), ["text"])


@query("SELECT o_orderkey, CASE WHEN o_orderstatus IN ('F', 'O') THEN o_orderstatus END AS o_orderstatus, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 END::BIGINT AS o_orderstatus_code FROM orders", base=False)
def p7_ordered_category(spark, sf_dir):
    return rounded(coerce.ordered_category(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", ["f", "o"]))


@query("SELECT upper(trim(c_name)) AS c_name, c_custkey::VARCHAR AS c_custkey FROM customer", base=False)
def p8_normalize_keys(spark, sf_dir):
    return coerce.normalize_keys(table(spark, sf_dir, "customer").select("c_name", "c_custkey"), ["c_name", "c_custkey"])


@query("SELECT count(*) AS n FROM runners WHERE price IS NOT NULL")
def p9_drop_null(spark, sf_dir):
    return coerce.drop_null(market(spark, sf_dir), ["mkt_odds_decimal"]).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT race_id, horse_id, field_size::BIGINT AS field_size FROM runners")
def p10_field_size(spark, sf_dir):
    return rounded(coerce.with_field_size(runners(spark, sf_dir).drop("field_size")).select(*KEYS, "field_size"))


@query("SELECT race_id, horse_id, pos::BIGINT AS finish FROM runners")
def p11_parse_rank(spark, sf_dir):
    told = runners(spark, sf_dir).withColumn("result", F.concat(F.lit(" "), "pos", F.lit("th")))
    return rounded(told.select(*KEYS, prices.leading_rank(F.col("result")).alias("finish")))


@query("SELECT race_id, horse_id, is_win::BIGINT AS is_win FROM runners")
def p12_win(spark, sf_dir):
    told = runners(spark, sf_dir).withColumn("winner", F.when(F.col("pos") == 1, "Yes").when(F.col("pos") == 2, "no").otherwise("?")).withColumn("result", F.concat("pos", F.lit("th"))).drop("is_win")
    return rounded(coerce.with_win(told).select(*KEYS, "is_win"))


@query("SELECT race_id, horse_id, (pos <= 3)::BIGINT AS by_flag, (pos = 1)::BIGINT AS by_result, (pos = 1)::BIGINT AS by_place FROM runners")
def p12_win_sources(spark, sf_dir):
    """Words in the first column there is, nulls and words unread as none; a result's text; a place where no column tells of wins."""
    base = runners(spark, sf_dir).drop("is_win")
    pos = F.col("pos")
    flagged = base.withColumns({"won": F.when(pos == 1, " Winner").when(pos == 2, "1st").when(pos == 3, "T").when(pos == 4, "non-winner").when(pos == 5, "??"), "result": F.lit("won")})
    told = base.select(*KEYS, F.concat(pos.cast("string"), F.when(pos == 1, "st").otherwise("th")).alias("outcome"))
    made = coerce.with_win(flagged).select(*KEYS, F.col("is_win").alias("by_flag")).join(coerce.with_win(told).select(*KEYS, F.col("is_win").alias("by_result")), KEYS)
    return rounded(made.join(coerce.with_win(base.select(*KEYS, "pos")).select(*KEYS, F.col("is_win").alias("by_place")), KEYS))


@query("SELECT race_id, horse_id, is_win::BIGINT AS by_place, is_win::BIGINT AS by_result, (pos <= 2)::BIGINT AS by_token FROM runners")
def p13_label(spark, sf_dir):
    """Places as numbers, results as text and words; columns that say nothing are passed over."""
    told = runners(spark, sf_dir).select(*KEYS, F.lit("?").alias("won"), F.col("pos").cast("string").alias("finish_position"), F.concat("pos", F.when(F.col("pos") == 1, "st").otherwise("th")).alias("res"), F.when(F.col("pos") <= 2, " YES").otherwise("no").alias("tok"))
    read = coerce.with_label(coerce.with_label(coerce.with_label(told, None, "by_place"), ["won", "res"], "by_result"), ["tok"], "by_token")
    return rounded(read.select(*KEYS, "by_place", "by_result", "by_token"))


@query("SELECT race_id, horse_id, pos::BIGINT AS pos FROM runners")
def p14_position(spark, sf_dir):
    return rounded(coerce.with_position(runners(spark, sf_dir).drop("pos")).select(*KEYS, "pos"))


@query("SELECT race_id, horse_id, round((1609.344 + 201.168 * (draw % 8) + 0.9144 * weight_lbs::INT)::DOUBLE, 6) AS metres FROM runners")
def p15_distance(spark, sf_dir):
    told = runners(spark, sf_dir).withColumn("d", F.concat(F.lit("1m"), F.col("draw") % 8, F.lit("f "), F.col("weight_lbs").cast("int"), F.lit("y")))
    return rounded(told.select(*KEYS, prices.distance_to_m(F.col("d")).alias("metres")))


@query("SELECT race_id, horse_id, course AS venue FROM runners")
def p16_alias(spark, sf_dir):
    return coerce.alias(runners(spark, sf_dir), {"venue": ["track", "course"], "none": ["absent"]}).select(*KEYS, "venue")


@query("SELECT race_id, horse_id, distance_m FROM runners")
def p17_forbid_prefix(spark, sf_dir):
    seen = runners(spark, sf_dir).select(*KEYS, "distance_m", F.col("pos").alias("obs__pos"))
    return coerce.forbid_prefix(seen, ["obs__"])


@query("SELECT race_id, horse_id, (pos <= CASE WHEN field_size >= 8 THEN 3 ELSE 2 END)::BIGINT AS is_place FROM runners")
def p18_place(spark, sf_dir):
    return rounded(coerce.with_place(runners(spark, sf_dir)).select(*KEYS, "is_place"))


@query("SELECT race_id, horse_id, age::BIGINT AS age FROM runners WHERE age BETWEEN 3 AND 7")
def p19_filter_range(spark, sf_dir):
    return rounded(coerce.filter_range(runners(spark, sf_dir), "age", 3, 7).select(*KEYS, "age"))


@query("SELECT round(age::DOUBLE, 6) AS age, 0.0::DOUBLE AS absent, round(draw::DOUBLE, 6) AS draw FROM runners")
def p20_align_features(spark, sf_dir):
    return rounded(coerce.align_features(runners(spark, sf_dir), ["age", "absent", "draw"]))


@query("SELECT age::DOUBLE AS age, draw::DOUBLE AS draw, is_win::BIGINT AS target FROM runners")
def p21_make_xy(spark, sf_dir):
    return rounded(coerce.make_xy(runners(spark, sf_dir).select(*KEYS, "age", "draw", "is_win"), "is_win", KEYS))


@query("""SELECT name AS picked FROM (SELECT 'age' AS name, avg((age BETWEEN 0 AND 1)::INT) AS s FROM market UNION ALL SELECT 'implied', avg((implied BETWEEN 0 AND 1)::INT) FROM market UNION ALL
SELECT 'is_win', avg((is_win BETWEEN 0 AND 1)::INT) FROM market UNION ALL SELECT 'raw', avg((raw BETWEEN 0 AND 1)::INT) FROM market UNION ALL SELECT 'draw', avg((draw BETWEEN 0 AND 1)::INT) FROM market) WHERE s > 0.98 ORDER BY length(name), name LIMIT 1""")
def p22_pick_prob(spark, sf_dir):
    base = market(spark, sf_dir)
    name = coerce.pick_prob_col(base.select("age", F.col("mkt_implied").alias("implied"), "is_win", F.col("mkt_implied_raw").alias("raw"), "draw"), ["model_prob"])
    return base.agg(F.lit(name).alias("picked"))


@query("SELECT race_id, horse_id, round(price, 8) AS odds, round(raw, 8) AS raw FROM market")
def o1_o4_prices(spark, sf_dir):
    told = runners(spark, sf_dir)
    odds = prices.coalesce_odds(F.col("odds_text"), F.col("odds_text"))
    return rounded(told.select(*KEYS, odds.alias("odds")).withColumn("raw", prices.implied_raw(F.col("odds"))), 8)


@query("SELECT race_id, horse_id, round(price, 6) AS decimal_odds FROM runners WHERE price > 1 AND draw % 4 IN (2, 3)")
def o5_extract_odds(spark, sf_dir):
    """A decimal column among the candidates; its fractions and words are no numbers."""
    return rounded(coerce.extract_odds(runners(spark, sf_dir).withColumnRenamed("odds_text", "bsp")))


@query("SELECT race_id, horse_id, round(price, 6) AS decimal_odds FROM runners WHERE price > 1 AND draw % 4 = 1")
def o5_extract_fractions(spark, sf_dir):
    base = runners(spark, sf_dir)
    return rounded(coerce.extract_odds(base.where("draw % 4 > 0").withColumnRenamed("odds_text", "sp_frac")))


@query("SELECT l_orderkey, l_linenumber, greatest(least(l_discount, 0.95), 0.05) + 0.0 AS p FROM lineitem", base=False)
def o6_clip(spark, sf_dir):
    return rounded(table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("int"), prices.clip_prob(F.col("l_discount"), 0.05).alias("p")))


@query("SELECT r.race_id, r.horse_id, round(price, 8) AS odds, round(raw, 8) AS raw, round(implied, 8) AS implied FROM market r")
def j1_j2_market(spark, sf_dir):
    base = runners(spark, sf_dir)
    own = guards.Guards()
    joined = own.settled(joins.attach_market(base.select(*KEYS), base.select(*KEYS, "odds_text"), guards=own))
    return rounded(joined.select(*KEYS, F.col("mkt_odds_decimal").alias("odds"), F.col("mkt_implied_raw").alias("raw"), F.col("mkt_implied").alias("implied")), 8)


@query("SELECT p.event_id, round(s.value, 6) AS value_asof FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT user_id, ts, value FROM events WHERE event_type = 'signup') s ON p.user_id = s.user_id AND p.ts >= s.ts", base=False)
def j3_asof(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    pick = lambda kind: events.where(F.col("event_type") == kind)
    found = joins.asof_join(pick("purchase").select("event_id", "user_id", "ts"), pick("signup").select("user_id", "ts", "value"), ["user_id"], "ts", "ts", ["value"])
    return rounded(found.select("event_id", "value_asof"))


_HOT_EVENTS = "e AS (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 0 ELSE user_id END AS user_id, ts, value, event_type FROM events)"


@query(f"WITH {_HOT_EVENTS} SELECT p.event_id, round(s.value, 6) AS value_asof FROM (SELECT * FROM e WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT user_id, ts, max(value) AS value FROM e WHERE event_type = 'click' GROUP BY ALL) s ON p.user_id = s.user_id AND p.ts >= s.ts", base=False)
def j3_asof_hot(spark, sf_dir):
    """One user has half of all rows: dealt by user and time, the last click carried from range to range."""
    events = table(spark, sf_dir, "events").withColumn("user_id", F.when(F.col("event_id") % 2 == 0, 0).otherwise(F.col("user_id")))
    clicks = events.where("event_type = 'click'").groupBy("user_id", "ts").agg(F.max("value").alias("value"))
    found = joins.asof_join(events.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), clicks, ["user_id"], "ts", "ts", ["value"], hot=True)
    return rounded(found.select("event_id", "value_asof"))


@query("SELECT race_id, horse_id, round(price, 6) AS price_snap FROM runners")
def j4_snapshot(spark, sf_dir):
    base = market(spark, sf_dir)
    return rounded(joins.snapshot_join(base.select(*KEYS), base.select(*KEYS, F.col("mkt_odds_decimal").alias("price")), KEYS, "_snap"))


@query("SELECT race_id, horse_id, CASE WHEN draw <= 2 THEN is_win ELSE 0 END::BIGINT AS won FROM runners")
def j5_labels(spark, sf_dir):
    base = runners(spark, sf_dir)
    labels = base.where("draw <= 2").select(F.concat(F.lit(" "), "race_id").alias("race_id"), "horse_id", F.col("is_win").alias("won"))
    return rounded(joins.attach_labels(base.select(*KEYS), labels, KEYS))


@query("SELECT race_id, horse_id, round(price, 6) AS odds, is_win::BIGINT AS is_win FROM runners WHERE price IS NOT NULL AND is_win IS NOT NULL")
def j6_metrics_join(spark, sf_dir):
    base = market(spark, sf_dir)
    pred = base.select(*KEYS, F.col("mkt_odds_decimal").alias("odds"))
    return rounded(joins.join_for_metrics(pred, base.select(*KEYS, "is_win"), KEYS, ["odds"]))


@query("SELECT race_id, horse_id, p_name AS horse_id_name, s_name AS jockey_id_name, n_name AS trainer_id_name FROM runners JOIN part ON horse_id = p_partkey::VARCHAR JOIN supplier ON jockey_id = s_suppkey::VARCHAR JOIN nation ON trainer_id = n_nationkey::VARCHAR")
def j7_names(spark, sf_dir):
    dims = {"horse_id": (table(spark, sf_dir, "part"), "p_partkey", "p_name"), "jockey_id": (table(spark, sf_dir, "supplier"), "s_suppkey", "s_name"), "trainer_id": (table(spark, sf_dir, "nation"), "n_nationkey", "n_name")}
    return joins.attach_names(runners(spark, sf_dir), dims).select(*KEYS, "horse_id_name", "jockey_id_name", "trainer_id_name")


@query("SELECT o_orderkey, (SELECT min_by(p_name, (l_shipdate, l_linenumber, p_name)) FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_orderkey = o_orderkey) AS o_key_name FROM orders", base=False)
def j7_first_name(spark, sf_dir):
    """Ids that have several names: the first by an order."""
    names = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    told = joins.attach_names(table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderkey").cast("string").alias("o_key")), {"o_key": (names, "l_orderkey", "p_name", ["l_shipdate", "l_linenumber"])})
    return told.select("o_orderkey", "o_key_name")


@query("SELECT race_id, horse_id, course, going FROM runners")
def j8_context(spark, sf_dir):
    base, own = runners(spark, sf_dir), guards.Guards()
    return own.settled(joins.attach_context(base.select(*KEYS), base, ["race_id"], ["course", "going"], own))


@query("SELECT race_id, horse_id, bool_or(discipline = 'F') OVER (PARTITION BY race_id) AS member FROM runners")
def j9_semi_mask(spark, sf_dir):
    base = runners(spark, sf_dir)
    return joins.semi_mask(base.select(*KEYS), base.where("discipline = 'F'"), "race_id")


@query("SELECT race_id, horse_id, draw::BIGINT AS draw FROM runners")
def d1_dedupe(spark, sf_dir):
    return rounded(runners(spark, sf_dir).select(*KEYS, "draw"))


@query("""
, a AS (SELECT *, row_number() OVER (PARTITION BY race_id, us, horse_id ORDER BY draw, horse_id) AS k1 FROM runners), b AS (SELECT *, row_number() OVER (PARTITION BY race_id, us, jockey_id ORDER BY draw, horse_id) AS k2 FROM a WHERE k1 = 1),
c AS (SELECT *, row_number() OVER (PARTITION BY race_id, us, trainer_id ORDER BY draw, horse_id) AS k3 FROM b WHERE k2 = 1) SELECT race_id, horse_id FROM c WHERE k3 = 1""")
def d2_dedupe_entities(spark, sf_dir):
    return sets.dedupe_entities(runners(spark, sf_dir), "race_id", "race_dt", ["horse_id", "jockey_id", "trainer_id"], ["draw", "horse_id"]).select(*KEYS)


@query('SELECT \'course\' AS "column", course AS level, count(*) AS n, round(count(*)::DOUBLE / (SELECT count(*) FROM runners), 6) AS share FROM runners GROUP BY course ORDER BY n DESC, level LIMIT 3')
def d3_top_levels(spark, sf_dir):
    return rounded(sets.top_levels(runners(spark, sf_dir), "course", 3))


@query("SELECT horse_id, round(max_by(weight_lbs, (us, race_id)), 6) AS weight_lbs FROM runners GROUP BY horse_id ORDER BY weight_lbs DESC, horse_id LIMIT 20")
def d4_latest_topn(spark, sf_dir):
    return rounded(sets.latest_topn(runners(spark, sf_dir), "horse_id", "weight_lbs", ["race_dt", "race_id"], 20))


@query("""
, l AS (SELECT discipline, horse_id, max_by(weight_lbs, (us, race_id)) AS weight_lbs FROM runners GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY discipline ORDER BY weight_lbs DESC, horse_id) AS rank FROM l)
SELECT discipline, horse_id, round(weight_lbs, 6) AS weight_lbs, rank FROM k WHERE rank <= 5""")
def d5_latest_topn_by(spark, sf_dir):
    return rounded(sets.latest_topn_by(runners(spark, sf_dir), "horse_id", "weight_lbs", "discipline", ["race_dt", "race_id"], 5))


@query("SELECT count(*) AS rows, count(DISTINCT horse_id) AS n_horse_id, count(DISTINCT jockey_id) AS n_jockey_id, count(DISTINCT trainer_id) AS n_trainer_id, strftime(min(race_dt), '%Y-%m-%d') AS first_time, strftime(max(race_dt), '%Y-%m-%d') AS last_time, count(DISTINCT race_id) AS contests, round(count(*)::DOUBLE / count(DISTINCT race_id), 6) AS mean_runners, 0::BIGINT AS duplicate_keys FROM runners")
def a1_summarize(spark, sf_dir):
    return rounded(profile.summarize(runners(spark, sf_dir)).withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in ("first_time", "last_time")}))


_A2 = {"price": "price", "implied": "implied", "age": "age", "course": "course", "first": "CASE WHEN pos = 1 THEN horse_id END"}


@query(" UNION ALL ".join(f"""SELECT '{n}' AS "column", count({e}) AS non_null, count(*) - count({e}) AS nulls, round(100.0 * (count(*) - count({e})) / count(*), 6) AS pct FROM market""" for n, e in _A2.items()))
def a2_missingness(spark, sf_dir):
    base = market(spark, sf_dir)
    return rounded(profile.missingness(base.select(F.col("mkt_odds_decimal").alias("price"), F.col("mkt_implied").alias("implied"), "age", "course", F.when(F.col("pos") == 1, F.col("horse_id")).alias("first"))))


@query("SELECT column_name AS \"column\", CASE data_type WHEN 'VARCHAR' THEN 'string' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' WHEN 'INTEGER' THEN 'int' ELSE lower(data_type) END AS type FROM information_schema.columns WHERE table_name = 'lineitem'", base=False)
def a3_dtypes(spark, sf_dir):
    return profile.dtypes_table(table(spark, sf_dir, "lineitem"))


@query("SELECT race_id, count(DISTINCT horse_id) AS runners FROM runners GROUP BY race_id")
def a4_runners_per_contest(spark, sf_dir):
    return profile.runners_per_contest(runners(spark, sf_dir))


_OVER = ", ov AS (SELECT race_id, sum(1 / price) AS overround, count(*) AS priced FROM runners WHERE price > 1 GROUP BY race_id)\n"


def _overrounds(spark, sf_dir):
    return profile.overround(market(spark, sf_dir), "mkt_odds_decimal")


@query(_OVER + "SELECT race_id, round(overround, 6) AS overround, priced, 'mkt_odds_decimal' AS source FROM ov")
def a5_overround(spark, sf_dir):
    return rounded(_overrounds(spark, sf_dir))


@query(_OVER + "SELECT count(*) AS n, round(avg(overround), 6) AS mean, round(quantile_cont(overround, 0.5), 6) AS median, round(quantile_cont(overround, 0.1), 6) AS p10, round(quantile_cont(overround, 0.9), 6) AS p90 FROM ov")
def a6_overround_summary(spark, sf_dir):
    return rounded(profile.spread(_overrounds(spark, sf_dir), "overround"))


@query(", per AS (SELECT race_id, sum(implied) AS total, count(price) AS priced FROM market GROUP BY race_id) SELECT (SELECT count(*) FROM market) AS rows, (SELECT count(price) FROM market) AS with_odds, (SELECT count(implied) FROM market) AS with_prob, count(total) AS summed, round(avg(total), 6) AS mean, round(quantile_cont(total, 0.5), 6) AS median, round(quantile_cont(total, 0.1), 6) AS p10, round(quantile_cont(total, 0.9), 6) AS p90, count(*) AS contests, count_if(priced = 0)::BIGINT AS no_odds FROM per")
def a7_a9_market_health(spark, sf_dir):
    return rounded(profile.market_health(market(spark, sf_dir), "mkt_implied", "mkt_odds_decimal"))


@query("SELECT race_id, horse_id FROM runners ORDER BY md5('s1:' || race_id || ':' || horse_id), race_id, horse_id LIMIT 50")
def a8_sample(spark, sf_dir):
    return profile.sample_rows(runners(spark, sf_dir).select(*KEYS), 50, "s1", KEYS)


@query("SELECT strftime(date_trunc('month', race_dt), '%Y-%m-%d') AS month, count(DISTINCT race_id) AS contests FROM runners GROUP BY 1")
def a10_monthly(spark, sf_dir):
    return profile.monthly_volume(runners(spark, sf_dir)).withColumn("month", F.col("month").cast("string"))


@query("SELECT discipline, age::BIGINT AS age, count(*) AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY discipline), 6) AS share FROM runners GROUP BY discipline, age")
def a11_age_share(spark, sf_dir):
    return rounded(profile.share_within(runners(spark, sf_dir), "discipline", "age"))


@query(", s AS (SELECT race_id, count(DISTINCT horse_id) AS r FROM runners GROUP BY race_id) SELECT count(*) AS n, round(avg(r), 6) AS mean, round(quantile_cont(r, 0.5), 6) AS median, round(quantile_cont(r, 0.1), 6) AS p10, round(quantile_cont(r, 0.9), 6) AS p90 FROM s")
def a12_field_sizes(spark, sf_dir):
    return rounded(profile.spread(profile.runners_per_contest(runners(spark, sf_dir)), "runners"))


@query(", e AS (SELECT min(weight_lbs) AS lo, max(weight_lbs) AS hi FROM runners) SELECT least(floor((weight_lbs - lo) * 30 / (hi - lo)), 29)::BIGINT AS bin, round(min(lo) + least(floor((weight_lbs - lo) * 30 / (hi - lo)), 29) * (min(hi) - min(lo)) / 30, 6) AS \"from\", count(*) AS n FROM runners, e GROUP BY bin, least(floor((weight_lbs - lo) * 30 / (hi - lo)), 29)")
def a13_histogram(spark, sf_dir):
    return rounded(profile.histogram(runners(spark, sf_dir), "weight_lbs", 30))


@query(_OVER + ", r AS (SELECT round(overround, 9) AS o FROM ov), q AS (SELECT round(quantile_cont(o, 0.005), 6) AS low, round(quantile_cont(o, 0.995), 6) AS high FROM r) SELECT least(floor(round((o - 0.9) / 0.01, 6)), 59)::BIGINT AS bin, count(*) AS n, min(low) AS low, min(high) AS high FROM r, q WHERE o BETWEEN 0.9 AND 1.5 GROUP BY bin")
def a14_overround_hist(spark, sf_dir):
    return rounded(profile.overround_hist(_overrounds(spark, sf_dir)))


@query(", c AS (SELECT least(600.0, quantile_cont(price, 0.995)) AS cap FROM runners), v AS (SELECT least(price, cap) AS x FROM runners, c WHERE price IS NOT NULL), e AS (SELECT min(x) AS lo, max(x) AS hi FROM v), b AS (SELECT least(floor((x - lo) * 60 / (hi - lo)), 59)::BIGINT AS bin, lo, hi FROM v, e) SELECT bin, round(lo + bin * (hi - lo) / 60, 6) AS \"from\", count(*) AS n FROM b GROUP BY bin, lo, hi")
def a15_capped_hist(spark, sf_dir):
    return rounded(profile.capped_hist(market(spark, sf_dir).select("mkt_odds_decimal").where("mkt_odds_decimal IS NOT NULL"), "mkt_odds_decimal"))


@query(", g AS (SELECT unnest(range(min(age), max(age) + 1)) AS value FROM runners) SELECT value::BIGINT AS value, count(age) AS n FROM g LEFT JOIN runners ON age = value GROUP BY value")
def a16_int_histogram(spark, sf_dir):
    return rounded(profile.int_histogram(runners(spark, sf_dir), "age"))


@query(_OVER + "SELECT race_id, round(overround * 100, 6) AS overround_pct, round(avg(overround * 100) OVER (), 6) AS mean_pct FROM ov")
def a17_overround_pct(spark, sf_dir):
    return rounded(profile.overround_pct(_overrounds(spark, sf_dir)).select("race_id", "overround_pct", "mean_pct"))


_RATE = """, r AS (SELECT discipline, age, count(*) AS n, sum(is_win) AS wins FROM runners GROUP BY ALL HAVING count(*) >= 10), z AS (SELECT *, wins / n AS p, 1.959963984540054 AS z FROM r),
t AS (SELECT *, (p + z*z/(2*n) - z * sqrt(p*(1-p)/n + z*z/(4*n*n))) / (1 + z*z/n) AS low, (p + z*z/(2*n) + z * sqrt(p*(1-p)/n + z*z/(4*n*n))) / (1 + z*z/n) AS high, (wins + 0.5) / (n + 1) AS shrunk FROM z),
u AS (SELECT discipline, age::BIGINT AS age, n, wins::BIGINT AS wins, round(p, 6) AS rate, round(low, 6) AS low, round(high, 6) AS high, round(shrunk, 6) AS shrunk, (row_number() OVER (PARTITION BY discipline ORDER BY shrunk DESC, n DESC, age) = 1)::BIGINT AS is_peak FROM t)
"""


@query(_RATE + "SELECT * FROM u")
def a18_rate_by_group(spark, sf_dir):
    return rounded(profile.rate_by_group(runners(spark, sf_dir), "discipline", "age"))


@query(_RATE + "SELECT * FROM u WHERE is_peak = 1")
def a19_peaks(spark, sf_dir):
    return rounded(profile.peaks(profile.rate_by_group(runners(spark, sf_dir), "discipline", "age"), "discipline"))


_CORR = ["age", "weight_lbs", "draw", "implied"]


@query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) + 0.0 AS corr FROM market" for i, a in enumerate(_CORR) for b in _CORR[i:]))
def a20_corr(spark, sf_dir):
    return rounded(profile.corr_matrix(market(spark, sf_dir).withColumnRenamed("mkt_implied", "implied"), _CORR))


@query("SELECT count(*) AS rows, count(DISTINCT horse_id) AS n_horse_id, count(DISTINCT jockey_id) AS n_jockey_id, count(DISTINCT trainer_id) AS n_trainer_id, strftime(min(race_dt), '%Y-%m-%d') AS first_time, strftime(max(race_dt), '%Y-%m-%d') AS last_time FROM runners")
def a21_coverage(spark, sf_dir):
    return rounded(profile.coverage(runners(spark, sf_dir)).withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in ("first_time", "last_time")}))


@query(_BETS + "SELECT race_id, count(*) AS bets, count(*)::DOUBLE AS staked, round(sum(pnl), 6) + 0.0 AS pnl FROM bets GROUP BY race_id")
def a22_per_contest(spark, sf_dir):
    return rounded(betting.per_contest_pnl(bets_of(rated(spark, sf_dir))))


@query("SELECT race_id, round(sum(implied), 6) AS total FROM market GROUP BY race_id")
def w1_normalize(spark, sf_dir):
    return rounded(market(spark, sf_dir).groupBy("race_id").agg(F.sum("mkt_implied").alias("total")))


_ROLL = "PARTITION BY horse_id ORDER BY us RANGE BETWEEN 90*86400000000 PRECEDING AND 1 PRECEDING"


@query(f"SELECT race_id, horse_id, nullif(count(*) OVER w, 0) AS n_90, (sum(is_win) OVER w)::BIGINT AS is_win_sum_90, round((sum(is_win) OVER w) / nullif(count(*) OVER w, 0), 6) AS is_win_rate_90 FROM runners WINDOW w AS ({_ROLL})")
def w2_rolling(spark, sf_dir):
    return rounded(features.rolling_form(runners(spark, sf_dir), "horse_id", "race_dt", ["is_win"], (90,)).select(*KEYS, "n_90", "is_win_sum_90", "is_win_rate_90"))


_ROLL_HOT = "PARTITION BY trainer_id ORDER BY us RANGE BETWEEN {0}*86400000000 PRECEDING AND 1 PRECEDING"


@query("SELECT race_id, horse_id, " + ", ".join(f"nullif(count(*) OVER ({_ROLL_HOT.format(h)}), 0) AS n_{h}, (sum(is_win) OVER ({_ROLL_HOT.format(h)}))::BIGINT AS is_win_sum_{h}" for h in (90, 365)) + " FROM runners")
def w2_rolling_hot(spark, sf_dir):
    """Some 25 entities hold all rows: ranges of entity and time, each with the frame before it."""
    own = scan.durable(runners(spark, sf_dir).select(*KEYS, "trainer_id", "race_dt", "is_win"))
    return rounded(features.rolling_form(own, "trainer_id", "race_dt", ["is_win"], (90, 365), hot=True).select(*KEYS, "n_90", "is_win_sum_90", "n_365", "is_win_sum_365"))


@query(f", p AS (SELECT race_id, horse_id, coalesce(sum(is_win * pow(2, (us - u0) / 86400000000.0 / 90)) OVER ({_W.format('trainer_id')}), 0) / pow(2, (us - u0) / 86400000000.0 / 90) AS s, coalesce(sum(pow(2, (us - u0) / 86400000000.0 / 90)) OVER ({_W.format('trainer_id')}), 0) / pow(2, (us - u0) / 86400000000.0 / 90) AS n FROM runners, (SELECT min(us) AS u0 FROM runners)) SELECT race_id, horse_id, round(s, 6) + 0.0 AS wins, round(n, 6) + 0.0 AS runs FROM p")
def w3_decayed_hot(spark, sf_dir):
    made = features.decayed_sum(runners(spark, sf_dir).withColumn("one", F.lit(1.0)), ["trainer_id"], "race_dt", {"wins": "is_win", "runs": "one"}, 90, hot=True)
    return rounded(made.select(*KEYS, "wins", "runs"))


@query(f", g AS (SELECT *, 16 * sqrt(greatest(field_size / 8.0, 1)) * (CASE WHEN field_size <= 1 THEN 1.0 ELSE 1 - (pos - 1)::DOUBLE / (field_size - 1) END - 0.5) AS gain FROM runners), p AS (SELECT race_id, horse_id, us, u0, sum(gain * pow(2, (us - u0) / 86400000000.0 / 90)) OVER ({_W.format('trainer_id')}) AS e, sum(is_win * pow(2, (us - u0) / 86400000000.0 / 120)) OVER ({_W.format('trainer_id')}) AS s, sum(pow(2, (us - u0) / 86400000000.0 / 120)) OVER ({_W.format('trainer_id')}) AS n FROM g, (SELECT min(us) AS u0 FROM g)) SELECT race_id, horse_id, round(coalesce(e, 0) / pow(2, (us - u0) / 86400000000.0 / 90), 5) + 0.0 AS elo, round((20 * (SELECT avg(is_win) FROM runners) + coalesce(s, 0) / pow(2, (us - u0) / 86400000000.0 / 120)) / (20 + coalesce(n, 0) / pow(2, (us - u0) / 86400000000.0 / 120)), 6) AS eb FROM p")
def r2_r3_hot(spark, sf_dir):
    """Ratings of entities with very many rows each."""
    own = scan.durable(runners(spark, sf_dir).select(*KEYS, "trainer_id", "race_dt", "field_size", "pos", "is_win"))
    rated_rows = ratings.elo(own, "trainer_id", "race_dt", "elo", hot=True).drop("field_size", "pos")
    return rounded(ratings.eb(rated_rows, "trainer_id", "race_dt", "eb", hot=True).select(*KEYS, F.round("elo", 5).alias("elo"), "eb"))


@query(f"SELECT race_id, horse_id, round({_EB.format('trainer_id')}, 6) AS eb_trainer FROM runners")
def w9_prior_eb_hot(spark, sf_dir):
    own = scan.durable(runners(spark, sf_dir).select(*KEYS, "trainer_id", "race_dt", "is_win"))
    return rounded(features.prior_eb_rate(own, ["trainer_id"], "race_dt", "is_win", hot=("trainer_id",), cheap=True).select(*KEYS, "eb_trainer"))


@query(", p AS (SELECT a.race_id, a.horse_id, sum(b.is_win * pow(0.5, (a.us - b.us) / 86400000000.0 / 180)) AS s FROM runners a LEFT JOIN runners b ON a.horse_id = b.horse_id AND (b.us, b.race_id) < (a.us, a.race_id) GROUP BY ALL) SELECT race_id, horse_id, round(coalesce(s, 0), 6) + 0.0 AS decayed FROM p")
def w3_decayed(spark, sf_dir):
    return rounded(features.decayed_sum(runners(spark, sf_dir), ["horse_id"], "race_dt", {"decayed": "is_win"}, 180).select(*KEYS, "decayed"))


@query(", p AS (SELECT a.race_id, a.horse_id, sum(b.is_win * pow(0.5, (a.us - b.us) / 86400000000.0 / 0.5)) AS s FROM runners a LEFT JOIN runners b ON a.horse_id = b.horse_id AND b.us < a.us GROUP BY ALL) SELECT race_id, horse_id, round(coalesce(s, 0), 6) + 0.0 AS decayed FROM p")
def w3_decayed_strict(spark, sf_dir):
    """A half-life of half a day, so histories span thousands of them, and no rows of the same time."""
    return rounded(features.decayed_sum(runners(spark, sf_dir), ["horse_id"], "race_dt", {"decayed": "is_win"}, 0.5, strict=True).select(*KEYS, "decayed"))


@query(f"SELECT race_id, horse_id, round((sum(is_win) OVER w) / nullif(count(is_win) OVER w, 0), 6) AS rate FROM runners WINDOW w AS ({_W.format('trainer_id')})")
def w4_prior_rate_hot(spark, sf_dir):
    """Keys with a large share of all rows each, dealt in ranges of key and time."""
    return rounded(features.prior_rate(runners(spark, sf_dir), ["trainer_id"], "race_dt", "is_win", "rate", hot=True).select(*KEYS, "rate"))


@query(f"SELECT race_id, horse_id, round((sum(is_win) OVER w) / nullif(count(is_win) OVER w, 0), 6) AS rate FROM runners WINDOW w AS ({_W.format('jockey_id, going')})")
def w4_prior_rate(spark, sf_dir):
    return rounded(features.prior_rate(runners(spark, sf_dir), ["jockey_id", "going"], "race_dt", "is_win", "rate").select(*KEYS, "rate"))


@query("SELECT race_id, horse_id, CASE WHEN distance_m < 1000 THEN NULL WHEN distance_m < 1600 THEN '[1000,1600)' WHEN distance_m < 2400 THEN '[1600,2400)' WHEN distance_m < 3000 THEN '[2400,3000)' END AS bucket FROM runners")
def w5_bucket(spark, sf_dir):
    return runners(spark, sf_dir).select(*KEYS, prices.bucket(F.col("distance_m"), [1000, 1600, 2400, 3000]).alias("bucket"))


@query(", k AS (SELECT course, row_number() OVER (ORDER BY count(*) DESC, course) AS k FROM runners GROUP BY course) SELECT race_id, horse_id, (k = 1)::BIGINT AS top1, (k = 2)::BIGINT AS top2, (k > 2)::BIGINT AS rest FROM runners JOIN k USING (course)")
def w6_one_hot(spark, sf_dir):
    made = features.one_hot_topn(runners(spark, sf_dir), "course", 2)
    first, second, rest = [c for c in made.columns if c.startswith("course_")]
    return rounded(made.select(*KEYS, F.col(first).alias("top1"), F.col(second).alias("top2"), F.col(rest).alias("rest")))


@query("SELECT race_id, horse_id, round(weight_lbs - quantile_cont(weight_lbs, 0.5) OVER (PARTITION BY race_id), 6) + 0.0 AS delta FROM runners")
def w7_delta_median(spark, sf_dir):
    return rounded(features.delta_median(runners(spark, sf_dir), "weight_lbs", "race_id", "delta").select(*KEYS, "delta"))


@query(", d AS (SELECT *, (draw - 1)::DOUBLE / greatest(field_size - 1, 1) AS x FROM runners) SELECT race_id, horse_id, round(x, 6) AS draw_norm, (x < 0.33)::BIGINT AS draw_low, (x >= 0.33 AND x < 0.66)::BIGINT AS draw_mid, (x >= 0.66 AND x <= 1.01)::BIGINT AS draw_high FROM d")
def w8_draw(spark, sf_dir):
    return rounded(features.draw_features(runners(spark, sf_dir)).select(*KEYS, "draw_norm", "draw_low", "draw_mid", "draw_high"))


@query(_RATED + "SELECT race_id, horse_id, round(eb_horse, 6) AS eb_horse, round(eb_jockey, 6) AS eb_jockey, round(eb_trainer, 6) AS eb_trainer FROM rated")
def w9_prior_eb(spark, sf_dir):
    return rounded(with_ratings(spark, sf_dir).select(*KEYS, "eb_horse", "eb_jockey", "eb_trainer"))


_HIST = "round((sum(is_win) OVER ({w})) / nullif(count(is_win) OVER ({w}), 0), 6)"
_HORSE_ELO = ", gn AS (SELECT race_id, horse_id, us, 16 * sqrt(greatest(field_size / 8.0, 1)) * (CASE WHEN field_size <= 1 THEN 1.0 ELSE 1 - (pos - 1)::DOUBLE / (field_size - 1) END - 0.5) AS gain FROM runners), he AS (SELECT a.race_id, a.horse_id, coalesce(sum(b.gain * pow(0.5, (a.us - b.us) / 86400000000.0 / 90)), 0) AS horse_elo FROM gn a LEFT JOIN gn b ON a.horse_id = b.horse_id AND (b.us, b.race_id) < (a.us, a.race_id) GROUP BY ALL)\n"


@query(
    _RATED
    + _HORSE_ELO
    + ", rl AS (SELECT horse_id, us, min(horse_elo) AS horse_elo FROM he JOIN runners USING (race_id, horse_id) GROUP BY ALL)"
    + f", ft AS (SELECT *, CASE WHEN distance_m < 1000 THEN NULL WHEN distance_m < 1600 THEN '[1000,1600)' WHEN distance_m < 2400 THEN '[1600,2400)' WHEN distance_m < 3000 THEN '[2400,3000)' END AS distance_bucket, (pos <= CASE WHEN field_size >= 8 THEN 3 ELSE 2 END)::BIGINT AS is_place FROM rated)"
    + ", dc AS (SELECT a.race_id, a.horse_id, coalesce(sum(b.is_win * pow(0.5, (a.us - b.us) / 86400000000.0 / 90)), 0) AS win_decayed_90 FROM runners a LEFT JOIN runners b ON a.horse_id = b.horse_id AND (b.us, b.race_id) < (a.us, a.race_id) GROUP BY ALL)\n"
    + f"SELECT ft.race_id, ft.horse_id, is_win::BIGINT AS is_win, is_place, round((sum(is_place) OVER r) / nullif(count(*) OVER r, 0), 6) AS is_place_rate_365, {_HIST.format(w=_W.format('horse_id, course'))} AS horse_course_rate, {_HIST.format(w=_W.format('horse_id, distance_bucket'))} AS horse_distance_rate, distance_bucket, round(win_decayed_90, 6) + 0.0 AS win_decayed_90, (course = 'BUILDING')::BIGINT AS course_building, round(official_rating - quantile_cont(official_rating, 0.5) OVER (PARTITION BY race_id), 6) + 0.0 AS rating_delta, round(eb_horse, 6) AS eb_horse, round(rl.horse_elo, 4) + 0.0 AS horse_elo_rt FROM ft JOIN dc USING (race_id, horse_id) JOIN rl ON rl.horse_id = ft.horse_id AND rl.us = ft.us WINDOW r AS (PARTITION BY ft.horse_id ORDER BY ft.us RANGE BETWEEN 365*86400000000 PRECEDING AND 1 PRECEDING)".replace("PARTITION BY horse_id", "PARTITION BY ft.horse_id").replace("ORDER BY us,", "ORDER BY ft.us,").replace(", race_id, horse_id ROWS", ", ft.race_id, ft.horse_id ROWS").replace("OVER (PARTITION BY race_id)", "OVER (PARTITION BY ft.race_id)")
)
def w10_features(spark, sf_dir):
    """The entrants are written once, as they are read for the ratings, the levels and the mean too. A decayed sum that stands on a tie of the rounding, such as 2^-7, does
    not follow its last digits: it is rounded at 14 places first."""
    base = scan.durable(runners(spark, sf_dir).drop("odds_text", "completion_time", "age"))
    ratings_table = ratings.elo(base, "horse_id", "race_dt", "horse_elo").select("horse_id", "race_dt", "horse_elo")
    made = features.build_features(base, ratings_table)
    return rounded(made.select(*KEYS, "is_win", "is_place", "is_place_rate_365", "horse_course_rate", "horse_distance_rate", "distance_bucket", F.round(F.round("win_decayed_90", 14), 6).alias("win_decayed_90"), F.col("course_BUILDING").alias("course_building"), "rating_delta", "eb_horse", F.round("horse_elo_rt", 4).alias("horse_elo_rt")))


@query("SELECT race_id, horse_id, round(CASE WHEN field_size <= 1 THEN 1.0 ELSE 1 - (pos - 1)::DOUBLE / (field_size - 1) END, 6) AS score FROM runners")
def r1_rank_score(spark, sf_dir):
    return rounded(runners(spark, sf_dir).select(*KEYS, prices.rank_score(F.col("pos"), F.col("field_size")).alias("score")))


@query(", g AS (SELECT *, 16 * sqrt(greatest(field_size / 8.0, 1)) * (CASE WHEN field_size <= 1 THEN 1.0 ELSE 1 - (pos - 1)::DOUBLE / (field_size - 1) END - 0.5) AS gain FROM runners), p AS (SELECT a.race_id, a.horse_id, sum(b.gain * pow(0.5, (a.us - b.us) / 86400000000.0 / 90)) AS s FROM g a LEFT JOIN g b ON a.horse_id = b.horse_id AND (b.us, b.race_id) < (a.us, a.race_id) GROUP BY ALL) SELECT race_id, horse_id, round(coalesce(s, 0), 5) + 0.0 AS elo FROM p")
def r2_elo(spark, sf_dir):
    return rounded(ratings.elo(runners(spark, sf_dir), "horse_id", "race_dt", "elo").select(*KEYS, "elo"), 5)


@query(", m AS (SELECT avg(is_win) AS mu FROM runners), p AS (SELECT a.race_id, a.horse_id, coalesce(sum(b.is_win * pow(0.5, (a.us - b.us) / 86400000000.0 / 120)), 0) AS s, coalesce(sum(CASE WHEN b.us IS NOT NULL THEN pow(0.5, (a.us - b.us) / 86400000000.0 / 120) END), 0) AS n FROM runners a LEFT JOIN runners b ON a.horse_id = b.horse_id AND (b.us, b.race_id) < (a.us, a.race_id) GROUP BY ALL) SELECT race_id, horse_id, round((20 * mu + s) / (20 + n), 6) AS eb FROM p, m")
def r3_eb(spark, sf_dir):
    return rounded(ratings.eb(runners(spark, sf_dir), "horse_id", "race_dt", "eb").select(*KEYS, "eb"))


_PLACE = ", f AS (SELECT race_id, min(us) AS us FROM runners GROUP BY race_id), pl AS (SELECT race_id, us, row_number() OVER (ORDER BY us, race_id) - 1 AS place, count(*) OVER () AS groups FROM f)\n"


@query(_PLACE + "SELECT race_id, place::BIGINT AS place FROM pl")
def t1_order_groups(spark, sf_dir):
    return rounded(splits.order_groups(runners(spark, sf_dir), "race_id", "race_dt").select("race_id", "place"))


@query(_PLACE + "SELECT race_id, CASE WHEN place < groups - floor(groups * 0.2) - floor(groups * 0.2) THEN 'train' WHEN place < groups - floor(groups * 0.2) THEN 'valid' ELSE 'test' END AS split FROM pl")
def t2_split_fractions(spark, sf_dir):
    return splits.split_fractions(runners(spark, sf_dir), "race_id", "race_dt").select("race_id", "split")


@query(_PLACE + ", b AS (SELECT count_if(us < epoch_us(TIMESTAMP '1996-01-01')) AS before FROM pl) SELECT race_id, CASE WHEN place < before THEN 'train' WHEN place < before + (groups - before) - floor((groups - before) * 0.5) THEN 'valid' ELSE 'test' END AS split FROM pl, b")
def t2_split_cutoff(spark, sf_dir):
    return splits.split_cutoff(runners(spark, sf_dir), "race_id", "race_dt", "1996-01-01 00:00:00").select("race_id", "split")


_BLOCK = ", bl AS (SELECT race_id, ntile({k}) OVER (ORDER BY us, race_id) - 1 AS block FROM f)\n"


@query(_PLACE + _BLOCK.format(k=5) + "SELECT fold::BIGINT AS fold, race_id, CASE WHEN block < fold THEN 'train' ELSE 'valid' END AS role FROM bl, range(1, 5) t(fold) WHERE block <= fold")
def t3_kfold(spark, sf_dir):
    return rounded(splits.split_kfold(runners(spark, sf_dir), "race_id", "race_dt", 5).select("fold", "race_id", "role"))


@query(_PLACE + """, g AS (SELECT race_id, us, CASE race_id::BIGINT % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'valid' ELSE 'test' END AS split, race_id::BIGINT AS k FROM f), b AS (SELECT split, min(us) AS low, max(us) AS high FROM g WHERE k % 7 > 0 GROUP BY split)
SELECT 'missing' AS rule, count_if(k % 7 = 0)::BIGINT AS violations FROM g UNION ALL SELECT 'unknown', count_if(k % 7 > 0 AND k % 11 = 0) FROM g UNION ALL SELECT 'repeated', count_if(k % 7 > 0 AND k % 5 = 0) FROM g
UNION ALL SELECT 'overlap', count(*) FROM b x, b y WHERE (x.split = 'train' AND y.split IN ('valid', 'test') OR x.split = 'valid' AND y.split = 'test') AND (x.high > y.low OR y.low - x.high < 86400000000)""")
def t5_check_splits(spark, sf_dir):
    """Splits by number: some contests are left out, some are there twice, some are unknown, and times overlap."""
    base = runners(spark, sf_dir)
    made = base.groupBy("race_id").agg(F.min("race_dt").alias("first_time")).withColumn("k", F.col("race_id").cast("long")).where("k % 7 > 0").withColumn("split", F.expr("CASE k % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'valid' ELSE 'test' END"))
    strange = made.where("k % 11 = 0").withColumn("race_id", F.concat(F.lit("x"), "race_id"))
    return rounded(splits.check_splits(base, made.union(made.where("k % 5 = 0")).union(strange), "race_id", gap_days=1))


@query(_PLACE + """, s AS (SELECT race_id, us, CASE WHEN place < groups - floor(groups * 0.2) - floor(groups * 0.2) THEN 'train' WHEN place < groups - floor(groups * 0.2) THEN 'valid' ELSE 'test' END AS split FROM pl), b AS (SELECT split, min(us) AS low, max(us) AS high FROM s GROUP BY split)
SELECT unnest(['missing', 'unknown', 'repeated']) AS rule, 0::BIGINT AS violations UNION ALL SELECT 'overlap', count(*) FROM b x, b y WHERE (x.split = 'train' AND y.split IN ('valid', 'test') OR x.split = 'valid' AND y.split = 'test') AND (x.high > y.low OR y.low - x.high < 0)""")
def t5_check_good_splits(spark, sf_dir):
    base = runners(spark, sf_dir)
    return rounded(splits.check_splits(base, splits.split_fractions(base, "race_id", "race_dt"), "race_id"))


@query(_PLACE + _BLOCK.format(k=5) + "SELECT fold::BIGINT AS fold, race_id, CASE WHEN block <= fold THEN 'train' ELSE 'valid' END AS role FROM bl, range(0, 4) t(fold) WHERE block <= fold + 1")
def t6_grouped_cv(spark, sf_dir):
    return rounded(splits.grouped_time_cv(runners(spark, sf_dir), "race_id", "race_dt", 4).select("fold", "race_id", "role"))


@query("SELECT 'price' AS \"column\", count_if(price IS NULL)::BIGINT AS bad FROM runners")
def v2_finite(spark, sf_dir):
    return rounded(checks.check_finite(market(spark, sf_dir).withColumnRenamed("mkt_odds_decimal", "price"), ["price", "age"]))


@query("SELECT l_orderkey, l_partkey, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1", base=False)
def v3_unique(spark, sf_dir):
    return checks.check_unique(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_partkey"])


@query("SELECT race_id, round(sum(raw), 6) AS total FROM market GROUP BY race_id HAVING sum(raw) IS NULL OR abs(sum(raw) - 1) > 0.2")
def v4_prob_sum(spark, sf_dir):
    return rounded(checks.check_prob_sum(market(spark, sf_dir), "race_id", "mkt_implied_raw", 0.2))


@query("SELECT race_id, horse_id FROM market WHERE implied IS NULL OR implied NOT BETWEEN 0 AND 1")
def v5_prob_table(spark, sf_dir):
    return checks.check_prob_table(market(spark, sf_dir), "race_id", "horse_id", "mkt_implied").select(*KEYS)


@query("SELECT count(*) AS n FROM runners WHERE pos NOT IN (0, 1)")
def v6_label(spark, sf_dir):
    return checks.check_label(runners(spark, sf_dir), "pos").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT race_id, min(draw)::BIGINT AS low, max(draw)::BIGINT AS high FROM runners GROUP BY race_id HAVING min(draw) <> max(draw)")
def v7_constant(spark, sf_dir):
    return rounded(checks.check_constant(runners(spark, sf_dir), "race_id", "draw"))


@query("""SELECT 'unique_key' AS rule, (SELECT count(*) FROM (SELECT 1 FROM runners GROUP BY race_id, jockey_id HAVING count(*) > 1))::BIGINT AS violations UNION ALL SELECT 'label', count_if(pos NOT IN (0, 1)) FROM runners
UNION ALL SELECT 'constant', count(*) FROM (SELECT 1 FROM runners GROUP BY race_id HAVING min(draw) <> max(draw))""")
def v8_canonical(spark, sf_dir):
    """Keys that repeat, a label of more than two values and a column that is not constant in a contest."""
    return rounded(checks.check_canonical(runners(spark, sf_dir), ["race_id", "jockey_id"], "pos", "draw"))


@query("SELECT name AS \"column\" FROM (SELECT unnest(['l_orderkey', 'l_partkey', 'race_id', 'L_TAX', 'horse_id']) AS name) WHERE name NOT IN (SELECT column_name FROM information_schema.columns WHERE table_name = 'lineitem')", base=False)
def v1_required(spark, sf_dir):
    return checks.missing_columns(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_partkey", "race_id", "L_TAX", "horse_id"])


@query("SELECT 'empty_event_id' AS rule, 0::BIGINT AS violations UNION ALL SELECT 'event_type_is_int', count(*) FROM events UNION ALL SELECT 'event_type_level', count_if(upper(event_type) <> 'CLICK') FROM events", base=False)
def v9_row_contract(spark, sf_dir):
    return rounded(checks.check_row_contract(table(spark, sf_dir, "events"), ["event_id"], {"event_type": "int"}, {"event_type": ["CLICK"]}))


@query(_RATED + "SELECT race_id, horse_id, round(model_prob, 6) AS model_prob, round(edge, 6) + 0.0 AS edge FROM rated")
def m1_b1_edges(spark, sf_dir):
    return rounded(rated(spark, sf_dir).select(*KEYS, "model_prob", "edge"))


def newton_sql(rows: str, d: int, l2: float = 1.0, steps: int = calibration.STEPS, name: str = "nt") -> str:
    """Newton steps of a logistic fit for each fold of ``rows`` (fold, y, x1 .. xd; d is 1 or 2), unrolled; the last one is ``name``."""
    w = [f"w{j}" for j in range(1, d + 1)]
    x = ["1.0", *[f"x{j}" for j in range(1, d + 1)]]
    margin = " + ".join(["b", *[f"w{j} * x{j}" for j in range(1, d + 1)]])
    out = f", {name}0 AS MATERIALIZED (SELECT DISTINCT fold, 0.0::DOUBLE AS b, " + ", ".join(f"0.0::DOUBLE AS {c}" for c in w) + f" FROM {rows})\n"
    grad = ", ".join(f"sum((q - y) * {x[j]}){f' + {l2} * any_value(w{j})' if j else ''} AS g{j}" for j in range(d + 1))
    hess = ", ".join(f"sum(q * (1 - q) * {x[i]} * {x[j]}){f' + {l2}' if i == j and i else ''} AS h{i}{j}" for i in range(d + 1) for j in range(i, d + 1))
    if d == 1:
        det, moves = "(h00 * h11 - h01 * h01)", ["(h11 * g0 - h01 * g1)", "(h00 * g1 - h01 * g0)"]
    else:
        minors = {"00": "(h11 * h22 - h12 * h12)", "01": "(h02 * h12 - h01 * h22)", "02": "(h01 * h12 - h02 * h11)", "11": "(h00 * h22 - h02 * h02)", "12": "(h01 * h02 - h00 * h12)", "22": "(h00 * h11 - h01 * h01)"}
        det = "(h00 * (h11 * h22 - h12 * h12) + h01 * (h02 * h12 - h01 * h22) + h02 * (h01 * h12 - h02 * h11))"
        moves = [" + ".join(f"{minors[f'{min(i, j)}{max(i, j)}']} * g{j}" for j in range(3)) for i in range(3)]
    moved = ", ".join(f"{c} - ({m}) / {det} AS {c}" for c, m in zip(["b", *w], moves))
    for k in range(steps):
        known = f"SELECT r.*, {', '.join(['b', *w])}, 1 / (1 + exp(-({margin}))) AS q FROM {rows} r JOIN {name}{k} t ON r.fold = t.fold"
        out += f", {name}{k + 1 if k + 1 < steps else ''} AS MATERIALIZED (SELECT fold, {moved} FROM (SELECT fold, any_value(b) AS b, {', '.join(f'any_value({c}) AS {c}' for c in w)}, {grad}, {hess} FROM ({known}) GROUP BY fold))\n"
    return out


_BOUND = "greatest(least({0}, 1 - 1e-6), 1e-6)"
_PLATT = ", pr AS (SELECT 0 AS fold, " + _BOUND.format("model_prob") + " AS x1, is_win::DOUBLE AS y FROM rated)\n" + newton_sql("pr", 1)
_PLATTED = _BOUND.format(f"1 / (1 + exp(-(b + w1 * {_BOUND.format('model_prob')})))")
# the least-squares non-decreasing fit is the greatest over starts of the least over ends of means
_ISO = """, ic AS (SELECT round(model_prob, 2) AS x, count(*) AS n, sum(is_win) AS s FROM rated GROUP BY 1), ia AS (SELECT x, sum(n) OVER (ORDER BY x) AS n, sum(s) OVER (ORDER BY x) AS s, row_number() OVER (ORDER BY x) AS i FROM ic),
iz AS (SELECT x, n, s, i FROM ia UNION ALL SELECT NULL, 0, 0, 0), im AS (SELECT a.i + 1 AS j, b.i AS k, (b.s - a.s)::DOUBLE / (b.n - a.n) AS m FROM iz a JOIN iz b ON b.i > a.i),
il AS (SELECT ia.i, im.j, min(im.m) AS m FROM ia JOIN im ON im.j <= ia.i AND im.k >= ia.i GROUP BY ALL), iso AS MATERIALIZED (SELECT ia.x, max(il.m) AS v FROM ia JOIN il USING (i) GROUP BY ia.x)
"""


@query(_RATED + _PLATT + f"SELECT race_id, horse_id, round({_PLATTED}, 6) AS calibrated FROM rated, nt")
def m2_platt(spark, sf_dir):
    df = rated_once(spark, sf_dir, *KEYS, "model_prob", "is_win")
    return rounded(models.apply_calibrator(df, models.fit_platt(df, "model_prob", "is_win"), "model_prob", "calibrated").select(*KEYS, "calibrated"))


@query(_RATED + _ISO + f"SELECT race_id, horse_id, round({_BOUND.format('v')}, 6) AS calibrated FROM rated JOIN iso ON x = round(model_prob, 2)")
def m3_isotonic(spark, sf_dir):
    """Scores of two places, so that SQL can try all starts and ends."""
    df = rated_once(spark, sf_dir, *KEYS, F.round("model_prob", 2).alias("p"), "is_win")
    model = models.fit_isotonic(df, "p", "is_win", eps=0.0)
    return rounded(models.apply_calibrator(df, model, "p", "calibrated", eps=0.0).select(*KEYS, "calibrated"))


@query(_RATED + _PLATT + f"SELECT race_id, horse_id, round({_PLATTED}, 6) AS model_prob FROM rated, nt WHERE draw <= 3")
def m4_saved_calibrator(spark, sf_dir):
    """Fitted, saved to the shared folder, loaded, and put in place of the probability."""
    df, path = rated_once(spark, sf_dir, *KEYS, "draw", "model_prob", "is_win"), scan.fresh_path(spark, "calibrator")
    models.save_calibrator(models.fit_platt(df, "model_prob", "is_win"), path)
    made = models.apply_calibrator(df.where("draw <= 3").select(*KEYS, "model_prob"), models.load_calibrator(path, "platt"), "model_prob", "model_prob")
    return rounded(made)


@query(_RATED + _PLATT + f"""SELECT 'platt' AS method, count(*) AS n, round(avg((model_prob - is_win) ** 2), 6) AS brier_before, round(avg(({_PLATTED} - is_win) ** 2), 6) AS brier_after, round(avg((model_prob - is_win) ** 2) - avg(({_PLATTED} - is_win) ** 2), 6) AS improvement FROM rated, nt""")
def m5_fit_calibrator(spark, sf_dir):
    """Labels joined to predictions, the fit, and Brier scores before and after."""
    df = rated_once(spark, sf_dir, *KEYS, "model_prob", "is_win")
    labels = df.select(F.concat(F.lit(" "), "race_id").alias("race_id"), "horse_id", F.col("is_win").alias("is_winner"))
    return rounded(models.fit_calibrator(df.select(*KEYS, "model_prob"), "platt", labels)[1].select(F.lit("platt").alias("method"), "*"))


@query()
def m5_fit_isotonic(spark, sf_dir):
    """Full scores: as many distinct ones as rows; tests hold the fit against a plain loop."""
    df = rated(spark, sf_dir).select(*KEYS, "model_prob", F.col("is_win").alias("won"))
    return models.fit_calibrator(df, "isotonic")[1]


@query(_RATED + "SELECT count(*) AS n, round(avg((model_prob - is_win) ** 2), 6) AS brier_before, round(avg((model_prob - is_win) ** 2), 6) AS brier_after, 0.0::DOUBLE AS improvement FROM rated")
def m5_no_calibrator(spark, sf_dir):
    df = rated_once(spark, sf_dir, *KEYS, "model_prob", "is_win")
    return rounded(models.fit_calibrator(df.select(*KEYS, "model_prob"), "none", df.select(*KEYS, F.col("is_win").alias("label")))[1])


_LL = "-(is_win * ln({p}) + (1 - is_win) * ln(1 - {p}))"


@query(_RATED + f"SELECT count(*) AS n, round(avg({_LL.format(p='model_prob')}), 6) AS logloss, round(avg(((model_prob >= 0.5)::INT = is_win)::INT), 6) AS accuracy, round(avg((model_prob - is_win) ** 2), 6) AS brier FROM rated")
def m8_metrics(spark, sf_dir):
    return rounded(models.binary_metrics(rated(spark, sf_dir), "model_prob", "is_win"))


@query(_RATED + ", s AS (SELECT round(model_prob, 9) AS x, is_win FROM rated), r AS (SELECT is_win, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS k FROM s) SELECT round((sum(k) FILTER (is_win = 1) - sum(is_win) * (sum(is_win) + 1) / 2.0) / (sum(is_win) * (count(*) - sum(is_win))), 6) AS auc FROM r")
def m9_auc(spark, sf_dir):
    return rounded(models.auc(rated(spark, sf_dir).withColumn("model_prob", F.round("model_prob", 9)), "model_prob", "is_win"))


@query(_RATED + ", c AS (SELECT race_id, avg(-ln(model_prob)) AS loss FROM rated WHERE is_win = 1 GROUP BY race_id) SELECT count(*) AS contests, round(avg(loss), 6) AS logloss FROM c")
def m10_contest_logloss(spark, sf_dir):
    return rounded(models.logloss_by_contest(rated(spark, sf_dir), "model_prob", "is_win"))


_REL = _RATED + ", rel AS (SELECT greatest(least(ceil(round(model_prob * 10, 9)), 10), 1)::BIGINT - 1 AS bin, count(*) AS n, avg(model_prob) AS mean_p, avg(is_win) AS mean_y FROM rated GROUP BY bin)\n"


@query(_REL + "SELECT bin, n, round(mean_p, 6) AS mean_p, round(mean_y, 6) AS mean_y FROM rel")
def m11_reliability(spark, sf_dir):
    return rounded(models.reliability(rated(spark, sf_dir), "model_prob", "is_win"))


@query(_REL + "SELECT round(sum(n * abs(mean_p - mean_y)) / sum(n), 6) AS ece FROM rel")
def m12_ece(spark, sf_dir):
    return rounded(models.ece(models.reliability(rated(spark, sf_dir), "model_prob", "is_win")))


@query(_RATED + ", v AS (SELECT round(model_prob, 9) AS p, is_win FROM rated), c AS (SELECT list_distinct(quantile_cont(p, [0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9])) AS cuts FROM v), b AS (SELECT p, is_win, len(list_filter(cuts, lambda c: c < p)) AS bin FROM v, c), r AS (SELECT count(*) AS n, avg(p) AS mean_p, avg(is_win) AS mean_y FROM b GROUP BY bin) SELECT round(sum(n * abs(mean_p - mean_y)) / sum(n), 6) AS ece FROM r")
def m12_ece_quantile(spark, sf_dir):
    return rounded(models.ece_of(rated(spark, sf_dir).withColumn("model_prob", F.round("model_prob", 9)), "model_prob", "is_win", strategy="quantile"))


@query(_RATED + ", v AS (SELECT round(model_prob, 9) AS p, is_win FROM rated), c AS (SELECT list_distinct(quantile_cont(p, [0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9])) AS cuts FROM v), b AS (SELECT p, is_win, len(list_filter(cuts, lambda c: c < p)) AS bin FROM v, c) SELECT bin, count(*) AS n, round(avg(p), 6) AS mean_p, round(avg(is_win), 6) AS mean_y FROM b GROUP BY bin")
def m13_quantile_reliability(spark, sf_dir):
    return rounded(models.quantile_reliability(rated(spark, sf_dir).withColumn("model_prob", F.round("model_prob", 9)), "model_prob", "is_win"))


@query(_RATED + ", p AS (SELECT *, sum(model_prob) OVER (PARTITION BY race_id ORDER BY horse_id ROWS UNBOUNDED PRECEDING) AS upto FROM rated) SELECT race_id, horse_id, round(upto - model_prob + ('0x' || left(md5(race_id || ':' || horse_id), 8))::BIGINT / 4294967296.0 * model_prob, 6) AS pit FROM p WHERE is_win = 1")
def m14_pit(spark, sf_dir):
    return rounded(models.pit(rated(spark, sf_dir), "model_prob", "is_win"))


@query(_RATED + ", v AS (SELECT *, round(model_prob, 9) AS p FROM rated WHERE price IS NOT NULL), k AS (SELECT *, row_number() OVER (ORDER BY p, race_id, horse_id) - 1 AS place, count(*) OVER () AS n FROM v) SELECT floor(place * 10 / n)::BIGINT AS decile, count(*) AS n, round(avg(p), 6) AS mean_p, round(avg(CASE WHEN is_win = 1 THEN price - 1 ELSE -1 END), 6) + 0.0 AS roi FROM k GROUP BY decile")
def m15_roi_deciles(spark, sf_dir):
    return rounded(models.roi_deciles(rated(spark, sf_dir).withColumn("model_prob", F.round("model_prob", 9)), "model_prob", "mkt_odds_decimal", "is_win", KEYS))


_CLIP = "greatest(least(implied, 1 - 1e-12), 1e-12)"


@query(_RATED + f", t AS (SELECT count(*) AS n, avg({_LL.format(p='model_prob')}) AS a, avg({_LL.format(p=_CLIP)}) AS b, avg((model_prob - is_win) ** 2) AS c, avg((implied - is_win) ** 2) AS d FROM rated WHERE implied IS NOT NULL) SELECT n, round(a, 6) AS model_logloss, round(b, 6) AS market_logloss, round(c, 6) AS model_brier, round(d, 6) AS market_brier, round(b - a, 6) + 0.0 AS logloss_gain, round(d - c, 6) + 0.0 AS brier_gain FROM t")
def m16_compare_market(spark, sf_dir):
    return rounded(models.compare_market(rated(spark, sf_dir), "model_prob", "mkt_implied", "is_win"))


@query(_BETS + "SELECT race_id, horse_id, round(edge, 6) AS edge, round(price, 6) AS odds FROM bets")
def b3_select_bets(spark, sf_dir):
    return rounded(bets_of(rated(spark, sf_dir)).select(*KEYS, "edge", F.col("mkt_odds_decimal").alias("odds")))


@query(_BETS + "SELECT race_id, horse_id, round(0.1 * greatest(0, (model_prob * (price - 1) - (1 - model_prob)) / (price - 1)), 6) AS stake FROM bets")
def b4_stake(spark, sf_dir):
    return rounded(betting.stake(bets_of(rated(spark, sf_dir)), 0.1).select(*KEYS, "stake"))


@query(_BETS + f"SELECT {_SUMMARY} FROM bets")
def b5_settle(spark, sf_dir):
    return rounded(betting.summary(bets_of(rated(spark, sf_dir)), []))


@query(_BETS + ", f AS (SELECT 1 + 0.001 * greatest(0, (model_prob * (price - 1) - (1 - model_prob)) / (price - 1)) * CASE WHEN is_win = 1 THEN price - 1 ELSE -1 END AS factor FROM bets) SELECT count(*) AS bets, round(1000 * exp(sum(ln(factor))), 4) AS final, round(exp(sum(ln(factor))) - 1, 4) + 0.0 AS roi FROM f")
def b6_compound(spark, sf_dir):
    return rounded(betting.compound(bets_of(rated(spark, sf_dir)), 0.001, 1000.0), 4)


@query(_RATED + """, grid AS (SELECT threshold, cap, top FROM (VALUES (0.01), (0.03), (0.05)) a(threshold), (VALUES (10.0), (30.0)) b(cap), (VALUES (1), (2)) c(top)),
s AS (SELECT grid.*, race_id, is_win, price, row_number() OVER (PARTITION BY threshold, cap, top, race_id ORDER BY round(edge, 12) DESC, horse_id) AS k FROM rated, grid WHERE round(edge, 12) >= threshold AND price > 1 AND price <= cap)
SELECT threshold::DOUBLE AS threshold, cap::DOUBLE AS cap, top::BIGINT AS top, count(*) AS bets, count(DISTINCT race_id) AS contests, count(*)::DOUBLE AS staked, round(sum(CASE WHEN is_win = 1 THEN price - 1 ELSE -1 END), 6) AS pnl, round(avg(CASE WHEN is_win = 1 THEN price - 1 ELSE -1 END), 6) AS roi, round(avg(is_win), 6) AS hit_rate, round(avg(price), 6) AS mean_odds FROM s WHERE k <= top GROUP BY threshold, cap, top""")
def b7_sweep(spark, sf_dir):
    grid = spark.sql("SELECT threshold, cap, top FROM (VALUES (0.01D), (0.03D), (0.05D)) AS a(threshold), (VALUES (10.0D), (30.0D)) AS b(cap), (VALUES (1), (2)) AS c(top)")
    return rounded(betting.sweep(rated(spark, sf_dir).withColumn("edge", F.round("edge", 12)), grid))


_CONFIGS = "('flat', 0.02, 20.0, 1, NULL), ('wide', 0.0, 50.0, 3, 0.1), ('strict', 0.1, 8.0, 1, 0.5), ('none', 0.99, 2.0, 1, NULL)"


@query(_RATED + f""", c(label, threshold, cap, top, fraction) AS (VALUES {_CONFIGS}),
s AS (SELECT c.*, race_id, is_win, price, model_prob, row_number() OVER (PARTITION BY label, race_id ORDER BY round(edge, 12) DESC, horse_id) AS k FROM rated, c WHERE round(edge, 12) >= threshold AND price > 1 AND price <= cap),
t AS (SELECT *, CASE WHEN fraction IS NULL THEN 1.0::DOUBLE ELSE fraction * greatest(0, (model_prob * (price - 1) - (1 - model_prob)) / (price - 1)) END AS stake FROM s WHERE k <= top)
SELECT c.label, count(t.label) AS bets, count(DISTINCT race_id) AS contests, round(sum(stake), 6) AS staked, round(sum(stake * CASE WHEN is_win = 1 THEN price - 1 ELSE -1 END), 6) + 0.0 AS pnl, round(sum(stake * CASE WHEN is_win = 1 THEN price - 1 ELSE -1 END) / sum(stake), 6) + 0.0 AS roi, round(avg(is_win), 6) AS hit_rate, round(avg(price), 6) AS mean_odds FROM c LEFT JOIN t USING (label) GROUP BY c.label""")
def b8_compare(spark, sf_dir):
    configs = spark.sql(f"SELECT label, cast(threshold AS double) AS threshold, cast(cap AS double) AS cap, top, cast(fraction AS double) AS fraction FROM VALUES {_CONFIGS} AS t(label, threshold, cap, top, fraction)")
    return rounded(betting.compare(rated(spark, sf_dir).withColumn("edge", F.round("edge", 12)), configs))


_FAMILIES = "('precision', 0.05, 10.0, 1), ('balanced', 0.02, 20.0, 1), ('high_volume', 0.0, 50.0, 2)"


@query(_RATED + _PLATT + _ISO + f""", fa(family, threshold, cap, top) AS (VALUES {_FAMILIES}), fr AS (SELECT unnest([0.0, 0.05, 0.1, 0.2, 0.3])::DOUBLE AS fraction),
e AS (SELECT 'platt' AS calibration, race_id, horse_id, is_win, price, implied, {_PLATTED} AS model_prob FROM rated, nt UNION ALL SELECT 'iso', race_id, horse_id, is_win, price, implied, {_BOUND.format('v')} FROM rated JOIN iso ON x = round(model_prob, 2)),
e2 AS (SELECT *, round(greatest(least(model_prob, 1 - 1e-6), 1e-6) - greatest(least(implied, 1 - 1e-6), 1e-6), 9) AS edge FROM e),
s AS (SELECT e2.*, family, top, row_number() OVER (PARTITION BY calibration, family, race_id ORDER BY edge DESC, horse_id) AS k FROM e2, fa WHERE edge >= threshold AND price > 1 AND price <= cap),
t AS (SELECT *, 1 + fraction * greatest(0, (model_prob * (price - 1) - (1 - model_prob)) / (price - 1)) * CASE WHEN is_win = 1 THEN price - 1 ELSE -1 END AS factor FROM s, fr WHERE k <= top),
u AS (SELECT family, calibration, fraction, count(*) AS bets, count(DISTINCT race_id) AS contests, avg(is_win) AS hit_rate, avg(price) AS mean_odds, sum(ln(factor)) AS grown FROM t GROUP BY ALL)
SELECT family, calibration, round(fraction, 6) AS fraction, bets, contests, round(hit_rate, 6) AS hit_rate, round(mean_odds, 6) AS mean_odds, round(grown, 4) + 0.0 AS log_growth, CASE WHEN grown < 3 THEN round(1000 * exp(grown), 3) END AS final, CASE WHEN grown < 3 THEN round(exp(grown) - 1, 6) END AS roi, (1000 * exp(grown) < 1)::BIGINT AS ruined FROM u""")
def b9_fraction_sweep(spark, sf_dir):
    """Families, fitted calibrations and fractions from one job: the bankroll, and whether less than one of the first thousand is left. Bankrolls
    of over twenty times the first one are told by their growth alone, since their last digits are no result."""
    base = rated_once(spark, sf_dir, *KEYS, "is_win", "mkt_odds_decimal", "mkt_implied", "model_prob", F.round("model_prob", 2).alias("p"))
    platt, iso = models.fit_platt(base, "model_prob", "is_win"), models.fit_isotonic(base, "p", "is_win", eps=0.0)
    tables = [models.apply_calibrator(base, platt, "model_prob", "model_prob").withColumn("calibration", F.lit("platt")), models.apply_calibrator(base, iso, "p", "model_prob", eps=0.0).withColumn("calibration", F.lit("iso"))]
    edges = betting.edges(tables[0].unionByName(tables[1])).withColumn("edge", F.round("edge", 9))
    families = spark.sql(f"SELECT family, cast(threshold AS double) AS threshold, cast(cap AS double) AS cap, top FROM VALUES {_FAMILIES} AS t(family, threshold, cap, top)")
    made = betting.fraction_sweep(edges, families, (0.0, 0.05, 0.10, 0.20, 0.30))
    near = F.col("log_growth") < 3
    told = made.withColumns({"final": F.when(near, F.round("final", 3)), "roi": F.when(near, F.col("roi")), "ruined": (F.col("final") < 1).cast("int"), "log_growth": F.round("log_growth", 4)})
    return rounded(told)


#: Draws of the registered bootstraps.
DRAWS = 1000
_HASHED = f""", h0 AS (SELECT bl.*, draw, xor(('0x' || left(md5('b1:' || race_id), 8))::BIGINT, (draw * 2654435761) % 4294967296)::UBIGINT AS x FROM bl, range(0, {DRAWS}) t(draw)),
h1 AS (SELECT * REPLACE (x * 2246822507::UBIGINT % 4294967296::UBIGINT AS x) FROM h0), h2 AS (SELECT * REPLACE (xor(x, x >> 13) AS x) FROM h1), h3 AS (SELECT * REPLACE (x * 3266489909::UBIGINT % 4294967296::UBIGINT AS x) FROM h2), h4 AS (SELECT * REPLACE (xor(x, x >> 16) AS x) FROM h3),
w AS (SELECT *, (u >= 0.36787944117144233)::INT + (u >= 0.7357588823428847)::INT + (u >= 0.9196986029286058)::INT + (u >= 0.9810118431238462)::INT + (u >= 0.9963401531726563)::INT + (u >= 0.9994058151824183)::INT + (u >= 0.999916758850712)::INT + (u >= 0.9999897508033253)::INT AS n FROM (SELECT *, x / 4294967296.0 AS u FROM h4))
"""
_DRAWS = _BETS + ", bl AS (SELECT race_id, sum(pnl) AS pnl, count(*) AS stake FROM bets GROUP BY race_id)" + _HASHED + ", dr AS (SELECT draw, sum(n * pnl) / sum(n * stake) AS roi FROM w GROUP BY draw)\n"
_MKT = "greatest(least(implied, 1 - 1e-12), 1e-12)"
_DIFFS = (
    _RATED
    + f", ls AS (SELECT race_id, -(is_win * ln(model_prob) + (1 - is_win) * ln(1 - model_prob)) + (is_win * ln({_MKT}) + (1 - is_win) * ln(1 - {_MKT})) AS l, (model_prob - is_win) ** 2 - ({_MKT} - is_win) ** 2 AS b FROM rated WHERE implied IS NOT NULL), bl AS (SELECT race_id, sum(l) AS l, sum(b) AS b, count(*) AS one FROM ls GROUP BY race_id)"
    + _HASHED
    + ", dr AS (SELECT draw, sum(n * l) / sum(n * one) AS logloss, sum(n * b) / sum(n * one) AS brier FROM w GROUP BY draw)\n"
)


def roi_draws(spark, sf_dir):
    return betting.block_bootstrap(bets_of(rated(spark, sf_dir)), {"roi": ("pnl", "stake")}, "race_id", DRAWS, "b1")


@query(_DRAWS + "SELECT draw, round(roi, 6) + 0.0 AS roi FROM dr")
def b11_bootstrap(spark, sf_dir):
    return rounded(roi_draws(spark, sf_dir))


@query(_DIFFS + "SELECT 'logloss' AS stat, round(avg(logloss), 6) + 0.0 AS mean, round(quantile_cont(logloss, 0.025), 6) + 0.0 AS low, round(quantile_cont(logloss, 0.975), 6) + 0.0 AS high FROM dr UNION ALL SELECT 'brier', round(avg(brier), 6) + 0.0, round(quantile_cont(brier, 0.025), 6) + 0.0, round(quantile_cont(brier, 0.975), 6) + 0.0 FROM dr")
def b11_loss_intervals(spark, sf_dir):
    """Intervals of the log loss and Brier differences between model and market."""
    rows = betting.loss_sums(rated(spark, sf_dir), "model_prob", "mkt_implied", "is_win")
    draws = betting.block_bootstrap(rows, {"logloss": ("logloss_diff", "one"), "brier": ("brier_diff", "one")}, "race_id", DRAWS, "b1")
    return rounded(betting.interval(draws))


@query(_DRAWS + ", i AS (SELECT avg(roi) AS mean, quantile_cont(roi, 0.025) AS low, quantile_cont(roi, 0.975) AS high FROM dr) SELECT 'roi' AS stat, round(mean, 6) AS mean, round(low, 6) AS low, round(high, 6) AS high, CASE WHEN low > 0 THEN 'profitable' WHEN high < 0 THEN 'not profitable' ELSE 'undecided' END AS verdict FROM i")
def b12_verdict(spark, sf_dir):
    return rounded(betting.verdict(betting.interval(roi_draws(spark, sf_dir))))


@query(_RATED + """, q AS (SELECT race_id, horse_id, CASE WHEN draw = 1 THEN 0.0 ELSE 0.70 * eb_horse + 0.15 * eb_jockey + 0.15 * eb_trainer END + 1e-9 AS raw FROM eb)
SELECT race_id, horse_id, round(greatest(least(raw / sum(raw) OVER (PARTITION BY race_id), 1 - 1e-6), 1e-6), 6) AS model_prob FROM q""")
def m1_snapshot_ratings(spark, sf_dir):
    """Ratings joined under either name; a row that lacks one of them has no blend."""
    base = with_ratings(spark, sf_dir, "draw")
    named = base.select(*KEYS, F.col("eb_horse").alias("eb_horse_rt"), F.when(F.col("draw") > 1, F.col("eb_jockey")).alias("rating_jockey_rt"), F.col("eb_trainer").alias("rating_trainer_rt"))
    return rounded(models.predict_eb(named).select(*KEYS, "model_prob"))


@query(_REL + f""", e AS (SELECT sum(n * abs(mean_p - mean_y)) / sum(n) AS ece FROM rel), c AS (SELECT race_id, avg(-ln(model_prob)) AS loss FROM rated WHERE is_win = 1 GROUP BY race_id),
p AS (SELECT *, sum(model_prob) OVER (PARTITION BY race_id ORDER BY horse_id ROWS UNBOUNDED PRECEDING) AS upto FROM rated), q AS (SELECT upto - model_prob + ('0x' || left(md5(race_id || ':' || horse_id), 8))::BIGINT / 4294967296.0 * model_prob AS pit FROM p WHERE is_win = 1)
SELECT count(*) AS n, round(avg({_LL.format(p='model_prob')}), 6) AS logloss, round(avg((model_prob - is_win) ** 2), 6) AS brier, (SELECT count(*) FROM c) AS contests, (SELECT round(avg(loss), 6) FROM c) AS contest_logloss, (SELECT round(ece, 6) FROM e) AS ece, (SELECT round(avg(pit), 6) FROM q) AS pit_mean, (SELECT round(var_pop(pit), 6) FROM q) AS pit_var FROM rated""")
def m17_summarize_run(spark, sf_dir):
    return rounded(models.summarize_run(rated(spark, sf_dir), "model_prob", "is_win"))


@query(_RATED + "SELECT race_id, horse_id, round(model_prob - implied, 6) + 0.0 AS edge FROM rated WHERE implied IS NOT NULL AND draw <= 3")
def b2_edges_from_pred(spark, sf_dir):
    df = rated_once(spark, sf_dir, *KEYS, "draw", "mkt_implied", "model_prob")
    pred = df.where("draw <= 3").select(*KEYS, F.col("model_prob").alias("p_win"))
    return rounded(betting.edges_from_pred(df.select(*KEYS, "mkt_implied"), pred, "p_win", KEYS).select(*KEYS, "edge"))


@query("SELECT race_id, horse_id, round(CASE WHEN is_win = 1 THEN price - 1 ELSE -1 END, 6) + 0.0 AS pnl FROM runners WHERE price > 1")
def b10_load_bets(spark, sf_dir):
    told = market(spark, sf_dir).select(*KEYS, F.col("mkt_odds_decimal").cast("string").alias("odds"), F.when(F.col("is_win") == 1, "Yes").otherwise("lost").alias("won"), F.lit("1").alias("stake"))
    return rounded(betting.load_bets(told).select(*KEYS, "pnl"))


_PAIRED = "FROM g a LEFT JOIN g b ON a.{0} = b.{0} AND (b.us, b.race_id, b.horse_id) < (a.us, a.race_id, a.horse_id) GROUP BY ALL"
_AGED = "coalesce(sum({0} * pow(0.5, (a.us - b.us) / 86400000000.0 / {1})), 0)"
_Z = ["horse_elo", "horse_eb", "jockey_elo", "trainer_elo"]
_UP = "ORDER BY us, race_id, horse_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
# the mean fades as well as its weight, so its sum has half the half-life; see ratings.decayed_z
_BLEND = (
    ", g AS (SELECT *, 16 * sqrt(greatest(field_size / 8.0, 1)) * (CASE WHEN field_size <= 1 THEN 1.0 ELSE 1 - (pos - 1)::DOUBLE / (field_size - 1) END - 0.5) AS gain FROM runners)\n"
    + ", ho AS (SELECT a.race_id, a.horse_id, " + _AGED.format("b.gain", 90) + " AS horse_elo, (20 * (SELECT avg(is_win) FROM runners) + " + _AGED.format("b.is_win", 120) + ") / (20 + " + _AGED.format("(b.us IS NOT NULL)::INT", 120) + ") AS horse_eb " + _PAIRED.format("horse_id") + ")\n"
    + "".join(
        f", {e[:2]} AS (SELECT race_id, horse_id, coalesce(sum(gain * pow(2, (us - u0) / 86400000000.0 / 90)) OVER (PARTITION BY {e}_id {_UP}), 0) / pow(2, (us - u0) / 86400000000.0 / 90) AS {e}_elo FROM g, (SELECT min(us) AS u0 FROM g))\n"
        for e in ("jockey", "trainer")
    )
    + ", c AS (SELECT race_id, horse_id, us, horse_elo, horse_eb, jockey_elo, trainer_elo, pow(2::DOUBLE, (us - min(us) OVER ()) / 86400000000.0 / 180) AS up FROM g JOIN ho USING (race_id, horse_id) JOIN jo USING (race_id, horse_id) JOIN tr USING (race_id, horse_id))\n"
    + f", z1 AS (SELECT *, (1e-6 + coalesce(sum(up) OVER ({_UP}), 0)) / up AS w, " + ", ".join(f"coalesce(sum({x} * up * up) OVER ({_UP}), 0) / up / up AS s_{x}" for x in _Z) + " FROM c)\n"
    + ", z2 AS (SELECT *, " + ", ".join(f"{x} - s_{x} / w AS d_{x}" for x in _Z) + " FROM z1)\n"
    + ", z3 AS (SELECT *, " + ", ".join(f"d_{x} / sqrt(greatest((1 + coalesce(sum(d_{x} ** 2 * w / (w + 1) * up) OVER ({_UP}), 0)) / up / greatest(w, 1e-6), 1e-9)) AS {x}_z" for x in _Z) + " FROM z2)\n"
)


@query(_BLEND + "SELECT race_id, horse_id, round(horse_elo_z, 4) + 0.0 AS horse_elo_z, round(trainer_elo_z, 4) + 0.0 AS trainer_elo_z FROM z3")
def r4_decayed_z(spark, sf_dir):
    made = ratings.blended_ratings(runners(spark, sf_dir))
    return rounded(made.select(*KEYS, "horse_elo_z", "trainer_elo_z"), 4)


@query(_BLEND + "SELECT race_id, horse_id, " + ", ".join(f"round({x}, 4) + 0.0 AS {x}" for x in _Z) + ", round(0.5 * horse_elo_z + 0.2 * horse_eb_z + 0.15 * jockey_elo_z + 0.15 * trainer_elo_z, 4) + 0.0 AS rating_blend FROM z3")
def r5_blended_ratings(spark, sf_dir):
    return rounded(ratings.blended_ratings(runners(spark, sf_dir)).select(*KEYS, *_Z, "rating_blend"), 4)


FEATURES = ["draw", "official_rating", "weight_lbs", "distance_m", "eb_horse", "eb_jockey", "eb_trainer"]


@query()
def m6_train_oof(spark, sf_dir):
    base = with_ratings(spark, sf_dir, "draw", "official_rating", "weight_lbs", "distance_m")
    return models.train_oof(base.select(*KEYS, "race_dt", "is_win", *FEATURES), FEATURES).select(*KEYS, "oof_prob")


_OOF_ROWS = """, bk AS (SELECT race_id, CASE WHEN place < (groups % 5) * (groups // 5 + 1) THEN place // (groups // 5 + 1) ELSE groups % 5 + (place - (groups % 5) * (groups // 5 + 1)) // (groups // 5) END::INT AS block FROM pl),
tr AS (SELECT f.fold, eb_horse AS x1, weight_lbs::DOUBLE AS x2, is_win::DOUBLE AS y FROM eb JOIN bk USING (race_id) JOIN (SELECT unnest(range(4)) AS fold) f ON bk.block <= f.fold)
"""


@query(_PLACE + ", " + _RATED.strip().removeprefix(",").strip() + _OOF_ROWS + newton_sql("tr", 2) + f""", sc AS (SELECT eb.race_id, eb.horse_id, CASE WHEN b IS NOT NULL THEN {_BOUND.format('1 / (1 + exp(-(b + w1 * eb_horse + w2 * weight_lbs)))')} END AS p FROM eb JOIN bk USING (race_id) LEFT JOIN nt ON nt.fold = bk.block - 1)
SELECT race_id, horse_id, round(p / sum(p) OVER (PARTITION BY race_id), 6) AS oof_prob FROM sc""")
def m6_oof_two_features(spark, sf_dir):
    """All folds fitted together; SQL makes the same Newton steps for each."""
    base = with_ratings(spark, sf_dir, "weight_lbs")
    two = ["eb_horse", "weight_lbs"]
    return rounded(models.train_oof(base.select(*KEYS, "race_dt", "is_win", *two), two).select(*KEYS, "oof_prob"))


@query(_RATED + ", tr AS (SELECT 0 AS fold, eb_horse AS x1, weight_lbs::DOUBLE AS x2, is_win::DOUBLE AS y FROM eb)" + newton_sql("tr", 2) + f"SELECT race_id, horse_id, round({_BOUND.format('1 / (1 + exp(-(b + w1 * eb_horse + w2 * weight_lbs)))')}, 6) AS model_prob FROM eb, nt")
def m7_score(spark, sf_dir):
    """Fit, save to the shared folder, load, score; a feature that the table lacks is 0."""
    path, two = scan.fresh_path(spark, "model"), ["eb_horse", "weight_lbs"]
    base = scan.durable(with_ratings(spark, sf_dir, "weight_lbs").select(*KEYS, "is_win", *two))
    calibration.save(calibration.fit_logistic(base, two, "is_win"), path)
    return rounded(models.score(base.select(*KEYS, *two), calibration.load(path, "logistic"), two).select(*KEYS, "model_prob"))


@query(_BETS + ", f AS (SELECT *, 1 + 0.001 * greatest(0, (model_prob * (price - 1) - (1 - model_prob)) / (price - 1)) * CASE WHEN is_win = 1 THEN price - 1 ELSE -1 END AS factor FROM bets) SELECT race_id, horse_id, round(1000 * exp(sum(ln(factor)) OVER (ORDER BY us, race_id, horse_id ROWS UNBOUNDED PRECEDING)), 4) AS bankroll FROM f")
def b6_compound_path(spark, sf_dir):
    bets = bets_of(rated(spark, sf_dir)).select("race_dt", *KEYS, "model_prob", "mkt_odds_decimal", "is_win")
    return rounded(betting.compound_path(bets, 0.001, 1000.0, ["race_dt", *KEYS]).select(*KEYS, "bankroll"), 4)


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 2 = 1 THEN o_orderpriority END AS o_orderpriority FROM orders", base=False)
def s1_csv_union(spark, sf_dir):
    """Two CSV folders with different columns, read as one table."""
    orders, path = table(spark, sf_dir, "orders"), scan.fresh_path(spark, "csv")
    orders.where("o_orderkey % 2 = 0").select("o_orderkey", "o_orderstatus").write.csv(f"{path}/even", header=True)
    orders.where("o_orderkey % 2 = 1").select("o_orderkey", "o_orderpriority").write.csv(f"{path}/odd", header=True)
    return io.read_csv_union(spark, [f"{path}/even", f"{path}/odd"]).withColumn("o_orderkey", F.col("o_orderkey").cast("long"))


@query("SELECT race_id, horse_id, pos::BIGINT AS pos FROM runners")
def s4_canonical(spark, sf_dir):
    path = scan.fresh_path(spark, "canonical")
    io.write_canonical(runners(spark, sf_dir), path, ["race_dt", *KEYS])
    return rounded(io.read_columns(spark, path, [*KEYS, "pos"]))


@query("SELECT race_id, horse_id, round(raw, 8) AS raw, round(round(implied, 12), 8) AS implied, count(*) OVER (PARTITION BY race_id) AS runners FROM market")
def s4_bucketed(spark, sf_dir):
    """Implied probabilities of each contest, from a table bucketed by contest: no exchange after the scan. The last digit of a sum depends on the order
    of rows, so shares are rounded to 12 places before they are to 8."""
    path = scan.fresh_path(spark, "bucketed")
    name = "runners_" + path[-32:]
    stored = io.write_bucketed(runners(spark, sf_dir).select(*KEYS, "race_dt", "odds_text"), name, path, "race_id", ["race_dt", "horse_id"], buckets=16)
    scaled = coerce.with_field_size(joins.with_market(stored)).withColumnRenamed("field_size", "runners")
    return rounded(scaled.select(*KEYS, F.col("mkt_implied_raw").alias("raw"), F.round("mkt_implied", 12).alias("implied"), "runners"), 8)


@query("SELECT n_nationkey::BIGINT AS n_nationkey, count(*)::BIGINT AS customers, 2::BIGINT AS copies FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL", base=False)
def s5_dual(spark, sf_dir):
    """The table as Parquet and as CSV; rows that both hold."""
    path = scan.fresh_path(spark, "dual")
    io.write_dual(table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").cast("long").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("customers")), path)
    both = io.read_table(spark, f"{path}.parquet").unionByName(io.read_table(spark, f"{path}.csv").selectExpr("cast(n_nationkey AS long) AS n_nationkey", "cast(customers AS long) AS customers"))
    return both.groupBy("n_nationkey", "customers").agg(F.count(F.lit(1)).alias("copies"))


@query(_BETS + f"SELECT {_SUMMARY} FROM bets")
def s6_summary(spark, sf_dir):
    path = scan.fresh_path(spark, "summary")
    io.write_summary(betting.summary(bets_of(rated(spark, sf_dir)), []), path)
    return rounded(spark.read.schema("bets long, contests long, staked double, pnl double, roi double, hit_rate double, mean_odds double").json(path))


@query("SELECT 'orders' AS what, count(*)::BIGINT AS \"rows\", 2::BIGINT AS runs, 1::BIGINT AS fingerprints FROM orders", base=False)
def s8_ledger(spark, sf_dir):
    """Two runs over the same rows, the second in another order, leave one fingerprint."""
    path, orders = scan.fresh_path(spark, "ledger"), table(spark, sf_dir, "orders")
    for rows in (orders, orders.repartition(3)):
        io.append_ledger(rows, path, what="orders")
    return spark.read.parquet(path).groupBy("what", "rows").agg(F.count(F.lit(1)).alias("runs"), F.countDistinct("fingerprint").alias("fingerprints"))


@query(_PLACE + "SELECT CASE WHEN place < groups - floor(groups * 0.2) - floor(groups * 0.2) THEN 'train' WHEN place < groups - floor(groups * 0.2) THEN 'valid' ELSE 'test' END AS split, count(*)::BIGINT AS groups FROM pl GROUP BY ALL")
def t4_write_splits(spark, sf_dir):
    path = scan.fresh_path(spark, "splits")
    splits.write_splits(splits.split_fractions(runners(spark, sf_dir), "race_id", "race_dt"), path)
    return spark.read.parquet(f"{path}/splits").groupBy("split").agg(F.count(F.lit(1)).alias("groups"))
