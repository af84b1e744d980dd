import pytest
from pyspark.sql import functions as F

from fieldwise.operators import betting, coerce, joins
from fieldwise.operators.guards import Guards

KEYS = ["race_id", "horse_id"]


def _sides(spark):
    left = spark.createDataFrame([("r1", "h1"), ("r2", "h2")], "race_id string, horse_id string")
    right = spark.createDataFrame([("r1", "h1", 1), ("r3", "h3", 0)], "race_id string, horse_id string, won int")
    return left, right


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_repeated_keys_are_found_by_the_action(spark):
    left, right = _sides(spark)
    own = Guards()
    assert _rows(own.settled(joins.join_m1(left, right, KEYS, own))) == [("r1", "h1", 1), ("r2", "h2", None)]
    for again in ("r1", "r3", None):  # met, not met, and null keys that repeat
        own = Guards()
        joined = joins.join_m1(left, right.union(spark.createDataFrame([(again, "h1" if again == "r1" else "h3", 5)] * (1 if again else 2), right.schema)), KEYS, own)
        with pytest.raises(ValueError, match="repeats keys"):
            own.settled(joined)


@pytest.mark.parametrize("which", ["left", "right", "both"])
def test_empty_sides(spark, which):
    """A side without rows may leave the plan while it runs; a condition on it then has its stated result."""
    left, right = _sides(spark)
    left, right = (left.where("race_id > 'z'") if which != "right" else left), (right.where("race_id > 'z'") if which != "left" else right)
    own = Guards()
    assert own.settled(joins.join_m1(left, right, KEYS, own)).count() == left.count()
    if which == "left":
        assert joins.attach_labels(left, right, KEYS).count() == 0
    else:
        assert left.count() == 0 or pytest.raises(ValueError, joins.attach_labels, left, right, KEYS)
    with pytest.raises(ValueError):
        betting.edges_from_pred(left.withColumn("mkt_implied", F.lit(0.2)), right, "won", KEYS)
    with pytest.raises(ValueError):
        coerce.extract_odds(left.where("race_id > 'z'").withColumn("sp", F.lit("3")))


def test_one_pass(spark, tmp_path):
    """With guards every input row is read once: labels, prices and predictions are checked by the writing action."""
    left, right = _sides(spark)
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    passed = left.repartition(2).mapInArrow(counted, left.schema)
    labelled = joins.attach_labels(passed, right, KEYS)
    assert read.value == 2 and _rows(labelled) == [("r1", "h1", 1), ("r2", "h2", 0)] and read.value == 2
    own = Guards()
    edges = betting.edges_from_pred(passed.withColumn("mkt_implied", F.lit(0.25)), right, "won", KEYS, guards=own)
    odds = coerce.extract_odds(passed.withColumn("sp", F.lit("3")), guards=own)
    assert read.value == 2  # nothing has run
    assert _rows(own.settled(edges.join(odds, KEYS))) == [("r1", "h1", 0.25, 1, 0.75, 3.0)] and read.value == 6


def test_market_guard_adds_no_exchange(spark):
    left, right = _sides(spark)
    odds = right.withColumn("odds_text", F.lit("2.5"))
    exchanges = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plain, watched = exchanges(joins.attach_market(left, odds)), exchanges(joins.attach_market(left, odds, guards=Guards()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert watched <= plain
