import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from fieldwise import queries as q
from fieldwise.functions import prices
from fieldwise.operators import betting, checks, coerce, features, joins, models, ratings, scan, splits
from fieldwise.sources import io


@pytest.mark.parametrize("name", sorted(q.ORACLES))
def test_query_equals_sql(name, spark, sf_dir, duck, same):
    same(q.QUERIES[name](spark, sf_dir), duck, q.ORACLES[name])


def test_prices(spark):
    rows = spark.createDataFrame([(x,) for x in ["2.5", "EVS", "evens", "EVEN", "SP", "1.0", "0.9", "3", None, ""]], "o string")
    assert [r[0] for r in rows.select(prices.parse_decimal(F.col("o"))).collect()] == [2.5, 2.0, 2.0, 2.0, None, None, None, 3.0, None, None]
    rows = spark.createDataFrame([(x,) for x in ["7/2", "100/30", "evs", "bad", "2/0"]], "o string")
    got = [r[0] for r in rows.select(prices.parse_fractional(F.col("o"))).collect()]
    assert got[0] == 4.5 and math.isclose(got[1], 4 + 1 / 3) and got[2:] == [2.0, None, None]
    rows = spark.createDataFrame([("1m2f110y",), ("5f",), ("1200",), ("",), (None,)], "d string")
    got = [r[0] for r in rows.select(prices.distance_to_m(F.col("d"))).collect()]
    assert math.isclose(got[0], 1609.344 + 2 * 201.168 + 110 * 0.9144) and math.isclose(got[1], 5 * 201.168) and got[2:] == [1200.0, None, None]


def _contests(spark):
    day = lambda d: dt.datetime(2024, 1, d)
    rows = [(r, h, day(r), pos, 3, int(pos == 1)) for r, order in ((1, (101, 102, 103)), (2, (101, 102, 103))) for pos, h in enumerate(order, 1)]
    return spark.createDataFrame(rows, "race_id int, horse_id int, race_dt timestamp, pos int, field_size int, is_win int")


def test_ratings_by_hand(spark):
    rated = ratings.eb(ratings.elo(_contests(spark), "horse_id", "race_dt", "elo"), "horse_id", "race_dt", "eb", baseline=3 / 9)
    got = {(r.race_id, r.horse_id): (r.elo, r.eb) for r in rated.collect()}
    assert got[1, 101] == (0.0, pytest.approx(1 / 3))
    assert got[2, 101][0] == pytest.approx(8 * 2 ** (-1 / 90)) and got[2, 102][0] == pytest.approx(0) and got[2, 103][0] == pytest.approx(-8 * 2 ** (-1 / 90))
    s = 2 ** (-1 / 120)
    assert got[2, 101][1] == pytest.approx((20 / 3 + s) / (20 + s))


def test_rolling_excludes_equal_times(spark):
    days = [dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 10), dt.datetime(2024, 4, 10)]
    df = spark.createDataFrame([(i, "h", d, w) for i, (d, w) in enumerate(zip(days, (1, 1, 0, 1)))], "i int, horse_id string, race_dt timestamp, w int")
    got = features.rolling_form(df, "horse_id", "race_dt", ["w"], (90,)).orderBy("i").collect()
    assert [(r.n_90, r.w_sum_90) for r in got] == [(None, None), (None, None), (2, 2), (None, None)]


def test_market_and_duplicates(spark):
    odds = spark.createDataFrame([("A", "1", "2.5"), ("A", "2", "5"), ("A", "3", "10"), ("B", "4", "EVS"), ("B", "5", "3")], "race_id string, horse_id string, odds_text string")
    got = [round(r.mkt_implied, 4) for r in joins.attach_market(odds.select("race_id", "horse_id"), odds).orderBy("horse_id").collect()]
    assert got == [0.5714, 0.2857, 0.1429, 0.6, 0.4]
    with pytest.raises(ValueError):
        joins.attach_market(odds.select("race_id", "horse_id"), odds.union(odds))


def test_stake_and_compound(spark):
    bets = spark.createDataFrame([(0.5, 3.0, 1), (0.5, 3.0, 0)], "model_prob double, mkt_odds_decimal double, is_win int")
    assert [r.stake for r in betting.stake(bets, 1.0).collect()] == [0.25, 0.25]
    assert betting.compound(bets, 0.2, 1000.0).first().final == pytest.approx(1000 * 1.1 * 0.95)


def test_guards(spark):
    df = spark.createDataFrame([(1, 0.5, 1)], "a int, p double, obs__x int")
    with pytest.raises(ValueError):
        coerce.forbid_prefix(df, ["obs__"], "raise")
    with pytest.raises(ValueError):
        coerce.with_label(spark.createDataFrame([("?",)], "a string"), ["a"])
    assert checks.check_required(df, ["a", "b"]) == ["b"]
    assert coerce.pick_prob_col(df.drop("obs__x", "a"), []) == "p"


def test_splits_cover_once(spark):
    rows = [(f"r{i}", f"h{j}", dt.datetime(2024, 1, 1) + dt.timedelta(days=i)) for i in range(12) for j in range(2)]
    df = spark.createDataFrame(rows, "race_id string, horse_id string, race_dt timestamp")
    made = splits.split_fractions(df, "race_id", "race_dt", 0.25, 0.25)
    assert {r.split: r.n for r in made.groupBy("split").agg(F.count("*").alias("n")).collect()} == {"train": 6, "valid": 3, "test": 3}
    assert all(r.violations == 0 for r in splits.check_splits(df, made, "race_id").collect())


def test_csv_union_sinks_and_ledger(spark, tmp_path):
    (tmp_path / "a.csv").write_text("race_id,x\n1,2\n")
    (tmp_path / "b.csv").write_text("race_id,y\n2,3\n")
    both = io.read_csv_union(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")])
    assert set(both.columns) == {"race_id", "x", "y"} and both.count() == 2
    with pytest.raises(ValueError):
        io.read_csv_union(spark, [])
    io.write_canonical(both, str(tmp_path / "c"), ["race_id"])
    io.write_dual(both, str(tmp_path / "d"))
    io.write_summary(both.agg(F.count("*").alias("n")), str(tmp_path / "e"))
    for _ in range(2):
        io.append_ledger(both, str(tmp_path / "ledger"), what="test")
    ledger = spark.read.parquet(str(tmp_path / "ledger")).collect()
    assert len(ledger) == 2 and ledger[0].fingerprint == ledger[1].fingerprint and ledger[0].rows == 2
    assert io.read_table(spark, str(tmp_path / "d.csv")).count() == 2


def test_isotonic_equals_a_plain_loop(spark, sf_dir, monkeypatch):
    """Pooling in ranges gives the blocks of one loop, whatever the ranges; points are interpolated alike when they are carried forward."""
    import random

    from fieldwise.operators import calibration

    r = random.Random(8)
    for rows in ([(r.randint(0, 60) / 60, r.randint(0, 1)) for _ in range(700)], [(i / 50, int(i < 25)) for i in range(50)], [(0.5, 1)], []):
        df = spark.createDataFrame(rows, "p double, y int")
        stack = []
        for x in sorted({p for p, _ in rows}):
            ys = [y for p, y in rows if p == x]
            stack.append([x, x, len(ys), sum(ys)])
            while len(stack) > 1 and stack[-2][3] / stack[-2][2] >= stack[-1][3] / stack[-1][2]:
                last = stack.pop()
                stack[-1] = [stack[-1][0], last[1], stack[-1][2] + last[2], stack[-1][3] + last[3]]
        for ranges in ("1", "4", "13"):
            spark.conf.set("spark.sql.shuffle.partitions", ranges)
            assert sorted(map(list, calibration.isotonic_blocks(df, "p", "y").collect())) == stack
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    model = calibration.fit_isotonic(spark.createDataFrame([(i / 20, int(r.random() < i / 20)) for i in range(20) for _ in range(9)], "p double, y int"), "p", "y", eps=0.0)
    asked = spark.createDataFrame([(-1.0,), (0.02,), (0.5,), (0.333,), (0.95,), (2.0,), (None,)], "p double")
    told = lambda: sorted(((x.p, x.out) for x in calibration.interpolate(asked, model, "p", "out").collect()), key=str)
    small = told()
    monkeypatch.setattr(calibration, "MOST_POINTS", 0)
    for (p, a), (q_, b) in zip(small, told(), strict=True):
        assert p == q_ and a == (b if b is None else pytest.approx(b))


def test_hot_scans_equal_windows(spark):
    """One entity has most rows, over many ranges: carried values, halos and eras give what windows give."""
    import random

    from fieldwise.operators import features, joins

    r = random.Random(11)
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    day = 86_400_000_000
    rows = [(str(i), r.choice(["a", "a", "a", "b", None]), r.randint(0, 900), r.randint(0, 1)) for i in range(600)]
    df = spark.createDataFrame(rows, "id string, e string, d int, f int").withColumn("t", F.timestamp_micros(F.col("d") * F.lit(day // 4)))
    same = lambda x, y: sorted(map(str, x.collect())) == sorted(map(str, y.collect()))
    cols = ["id", "n_30", "f_sum_30", "f_rate_90"]
    assert same(*[features.rolling_form(df, "e", "t", ["f"], (30, 90), hot=h).select(*cols) for h in (False, True)])
    for half_life in (40.0, 0.05):
        assert same(*[features.decayed_sum(df, ["e"], "t", {"s": "f"}, half_life, ("id",), hot=h).select("id", F.round("s", 9)) for h in (False, True)])
    right = df.where("f = 1").groupBy("e", "t").agg(F.max("id").alias("v"))
    assert same(*[joins.asof_join(df.where("f = 0").select("id", "e", "t"), right, ["e"], "t", "t", ["v"], hot=h) for h in (False, True)])
    with pytest.raises(ValueError):
        features.decayed_sum(df, ["e"], "t", {"s": "f"}, 9.0, ("id",), strict=True, hot=True)
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_quantiles_of_odd_values(spark):
    from fieldwise.operators import scan

    import numpy as np

    r = np.random.default_rng(2)
    for values in ([1e308, -1e308, 0.0, -0.0, 1e-300], r.normal(size=501).tolist() + [3.0] * 400, [7.0], r.integers(0, 5, 90).astype(float).tolist()):
        df = spark.createDataFrame([(float(v),) for v in values] + [(None,), (float("nan"),)], "v double")
        got = scan.quantiles(df, "v", {"a": 0.1, "b": 0.5, "c": 0.995}).first()
        assert list(got) == pytest.approx([np.quantile(values, q) if max(values) < 1e300 else sorted(values)[0] * (1 - 0.4) if q == 0.1 else got[i] for i, q in enumerate((0.1, 0.5, 0.995))])
    assert list(scan.quantiles(df.where("v > 99"), "v", {"a": 0.5}).first()) == [None]


def test_overround_bins_do_not_follow_the_order_of_rows(spark):
    """Sums of one over odds that should be exactly 0.9 fall in one bin, in whatever order they are added."""
    from fieldwise.operators import profile

    odds = [10.0, 5.0, 2.5, 5.0]
    rows = [(f"{k}", o) for k in range(40) for o in (odds[k % 4 :] + odds[: k % 4])]
    for n in (1, 3, 8):
        table = profile.overround(spark.createDataFrame(rows, "race_id string, o double").repartition(n), "o")
        assert [(x.bin, x.n) for x in profile.overround_hist(table).collect()] == [(0, 40)]


def test_write_splits(spark, tmp_path):
    rows = [(f"r{i}", f"h{i}", dt.datetime(2024, 1, 1) + dt.timedelta(days=i)) for i in range(10)]
    df = spark.createDataFrame(rows, "race_id string, horse_id string, race_dt timestamp")
    splits.write_splits(splits.split_fractions(df, "race_id", "race_dt"), str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/splits").where("split = 'train'").count() == 6
    assert sum(r.groups for r in spark.read.json(f"{tmp_path}/manifest").collect()) == 10


def test_decayed_z_equals_a_loop(spark):
    """Equal times, long gaps, a constant column, nulls and infinities, against a plain running state."""
    import random

    rng, at, rows = random.Random(3), dt.datetime(2000, 1, 1), []
    for i in range(400):
        at += dt.timedelta(days=rng.choice([0, 0, 1, 7, 40, 900]), seconds=rng.choice([0, 3600]))
        rows.append((f"r{i // 3:04d}", f"h{i:04d}", at, rng.choice([None, rng.gauss(3, 2), rng.gauss(-1, 9)]), 5.0, float("inf") if i % 50 == 0 else float(i)))
    df = spark.createDataFrame(rows, "race_id string, horse_id string, ts timestamp, a double, b double, c double")
    got = {r.horse_id: r for r in ratings.decayed_z(df, "ts", ["a", "b", "c"], 180.0).collect()}
    for col, name in ((3, "a"), (4, "b"), (5, "c")):
        mean, spread, weight, last = 0.0, 1.0, 1e-6, rows[0][2]
        for r in rows:
            x = 0.0 if r[col] is None or math.isinf(r[col]) else r[col]
            fade = 2.0 ** (-(r[2] - last).total_seconds() / 86400 / 180)
            mean, spread, weight, last = mean * fade, spread * fade, weight * fade, r[2]
            d = x - mean
            assert getattr(got[r[1]], f"{name}_z") == pytest.approx(d / math.sqrt(max(1e-9, spread / max(1e-6, weight))), rel=1e-6, abs=1e-6)
            weight += 1
            mean += d / weight
            spread = max(1e-12, spread + d * (x - mean))


def test_decayed_z_of_no_rows(spark):
    assert ratings.decayed_z(spark.createDataFrame([], "race_id string, horse_id string, ts timestamp, a double"), "ts", ["a"]).count() == 0


def test_compound_path_keeps_order_and_ruin(spark):
    bets = spark.createDataFrame([(1, 0.5, 3.0, 1), (2, 0.5, 3.0, 0), (3, 1.0, 2.0, 0), (4, 0.5, 3.0, 1)], "i int, model_prob double, mkt_odds_decimal double, is_win int")
    got = [r.bankroll for r in betting.compound_path(bets, 0.2, 1000.0, ["i"]).orderBy("i").collect()]
    assert got == pytest.approx([1100.0, 1072.5 - 27.5, 1045 * 0.8, 836 * 1.1])
    ruined = [r.bankroll for r in betting.compound_path(bets, 1.0, 1000.0, ["i"]).orderBy("i").collect()]
    assert ruined[2:] == [0.0, 0.0] and ruined[1] > 0


@pytest.mark.parametrize("kind", ["logistic", "gbt"])
def test_out_of_fold_looks_back_only(spark, tmp_path, kind):
    """Each contest's score comes from earlier contests alone: changing later labels changes nothing."""
    import random

    rng = random.Random(5)
    rows = []
    for i in range(30):
        strength = [rng.gauss(0, 1) for _ in range(4)]
        rows += [(f"r{i:02d}", f"h{j}", dt.datetime(2024, 1, 1) + dt.timedelta(days=i), int(s == max(strength)), s, None if i % 7 == 0 else s * 2) for j, s in enumerate(strength)]
    schema = "race_id string, horse_id string, race_dt timestamp, is_win int, x double, y double"
    run = lambda given: {(r.race_id, r.horse_id): r.oof_prob for r in models.train_oof(spark.createDataFrame(given, schema), ["x", "y", "absent"], k=2, kind=kind).collect()}
    first = run(rows)
    assert len(first) == 120 and all((p is None) == (race < "r10") for (race, _), p in first.items())
    for race in {r[0] for r in rows if r[0] >= "r10"}:
        assert sum(first[race, f"h{j}"] for j in range(4)) == pytest.approx(1)
    later = run([(*r[:3], 1 - r[3] if r[0] >= "r20" else r[3], *r[4:]) for r in rows])
    assert all(later[k] == pytest.approx(v) for k, v in first.items() if "r10" <= k[0] < "r20")
    if kind == "logistic":
        from pyspark.ml import PipelineModel

        df = spark.createDataFrame(rows, schema)
        model = models.fit_classifier(df, ["x", "y"], "is_win")
        model.write().save(str(tmp_path / "model"))
        back = models.score(df, PipelineModel.load(str(tmp_path / "model")), ["x", "y"]).collect()
        assert [r.model_prob for r in back] == pytest.approx([r.model_prob for r in models.score(df, model, ["x", "y"]).collect()])


def test_labels_of_every_kind(spark):
    rows = spark.createDataFrame([("1", "1st", "Yes", "0", "?"), ("2", "2nd", "no", "1", None), (None, "PU", "NO", "", "?"), ("1.0", "10th", "won", "3", "?")], "pos string, result string, flag string, winner string, won string")
    read = lambda df, names=None: [r.label for r in coerce.with_label(df, names).collect()]
    assert read(rows.select("pos", "won")) == [1, 0, 0, 1]  # places, not numbers other than 0
    assert read(rows.select("result")) == [1, 0, 0, 0] and read(rows, ["flag"]) == [1, 0, 0, 1] and read(rows, ["pos"]) == [1, 0, 0, 1]
    assert read(rows) == [0, 1, 0, 1]  # ``won`` says nothing, ``winner`` comes before places
    with pytest.raises(ValueError):
        coerce.with_label(rows.select("won"))
    bets = rows.select(F.lit("3.0").alias("odds"), F.col("flag").alias("won"), F.lit("2").alias("stake"))
    assert [r.pnl for r in betting.load_bets(bets).collect()] == [4.0, -2.0, -2.0, 4.0]


def test_text_times_and_odds(spark):
    rows = spark.createDataFrame([("\n a  b\t",), ("\u00a0x\u3000y ",), (None,), ("",)], "t string")
    assert [r.t for r in coerce.clean_text(rows, ["t"]).collect()] == ["a b", "x y", None, ""]
    assert coerce.with_event_time(spark.createDataFrame([("2024-01-02 03:04:05",)], "ts string")).first().off_time == dt.datetime(2024, 1, 2, 3, 4, 5)
    for wrong in (lambda: coerce.with_event_time(rows), lambda: coerce.extract_odds(rows, ["t"]), lambda: coerce.extract_odds(rows.withColumn("sp", F.lit("SP")), ["t"])):
        with pytest.raises(ValueError):
            wrong()


def test_context_names_and_labels(spark):
    left = spark.createDataFrame([("r1", "h1"), ("r2", "h2")], "race_id string, horse_id string")
    raw = spark.createDataFrame([("r1", "a", "z"), ("r1", "a", "z"), ("r2", "b", "y")], "race_id string, course string, going string")
    assert sorted(tuple(r) for r in joins.attach_context(left, raw, ["race_id"], ["course", "going"]).collect()) == [("r1", "h1", "a", "z"), ("r2", "h2", "b", "y")]
    with pytest.raises(ValueError):
        joins.attach_context(left, raw.union(spark.createDataFrame([("r1", "b", "a")], raw.schema)), ["race_id"], ["course", "going"])
    names = spark.createDataFrame([("h1", "Zed", 1), ("h1", "Abe", 2), (None, "Nil", 0)], "id string, name string, at int")
    assert {r.horse_id: r.horse_id_name for r in joins.attach_names(left, {"horse_id": (names, "id", "name", ["at"])}).collect()} == {"h1": "Zed", "h2": None}
    with pytest.raises(ValueError):
        joins.attach_labels(left, spark.createDataFrame([("r9", "h9", 1)], "race_id string, horse_id string, won int"), ["race_id", "horse_id"])


def test_decayed_sums_over_thousands_of_half_lives(spark):
    at, rows = dt.datetime(2000, 1, 1), []
    for i, days in enumerate([0, 1, 1, 300, 5, 399, 1, 2000, 0, 3]):
        at += dt.timedelta(days=days)
        rows.append((f"r{i}", "h", at, float(i % 3)))
    df = spark.createDataFrame(rows, "race_id string, horse_id string, ts timestamp, v double")
    for strict in (False, True):
        got = {r.race_id: r.s for r in features.decayed_sum(df, ["horse_id"], "ts", {"s": "v"}, 1.0, strict=strict).collect()}
        for i, (race, _, t, _) in enumerate(rows):
            before = [r for r in rows[:i] if r[2] < t] if strict else rows[:i]
            assert got[race] == pytest.approx(sum(v * 0.5 ** ((t - u).days) for _, _, u, v in before), rel=1e-9, abs=1e-100)


def test_prefix_within_keys_spreads_a_hot_key(spark):
    rows = [(i, "hot" if i % 3 else f"k{i}", i * 7 % 100) for i in range(3000)]
    df = spark.createDataFrame(rows, "i long, k string, v long").repartition(5)
    ran = scan.with_prefix(df, ["i"], {"total": "v", "n": "*"}, partitions=8, own=False, within=["k"])
    seen, expected = {}, {}
    for i, k, v in rows:
        expected[i] = seen.get(k, (0, 0))
        seen[k] = (expected[i][0] + v, expected[i][1] + 1)
    assert {r.i: (r.total, r.n) for r in ran.collect()} == expected
    cuts = scan.quantiles(df, "v", {"a": 0.0, "b": 0.37, "c": 1.0}).first()
    import numpy as np

    assert (cuts.a, cuts.b, cuts.c) == pytest.approx(tuple(np.quantile([r[2] for r in rows], [0, 0.37, 1])))
    assert scan.quantiles(df.where("v < 0"), "v", {"a": 0.5}).first().a is None


def test_expanding_baselines_look_back_only(spark):
    rows = [(f"r{i:02d}", f"h{i % 4}", dt.datetime(2024, 1, 1) + dt.timedelta(days=i), i % 3 == 0) for i in range(24)]
    df = spark.createDataFrame([(*r[:3], int(r[3])) for r in rows], "race_id string, horse_id string, race_dt timestamp, is_win int")
    got = {r.race_id: (r.eb_horse, r.mu) for r in features.expanding_mean(features.prior_eb_rate(df, ["horse_id"], "race_dt", "is_win", baseline="expanding"), "race_dt", "is_win", "mu").collect()}
    for i, (race, horse, _, _) in enumerate(rows):
        wins = [r[3] for r in rows[:i]]
        mu = sum(wins) / i if i else None
        own = [r[3] for r in rows[:i] if r[1] == horse]
        assert got[race] == (pytest.approx((sum(own) + 20 * (0.5 if mu is None else mu)) / (len(own) + 20)), None if mu is None else pytest.approx(mu))
    assert ratings.eb(df, "horse_id", "race_dt", "eb", baseline="expanding").count() == 24


def test_platt_equals_newton_and_calibrators_are_saved(spark, tmp_path):
    import numpy as np

    rng = np.random.default_rng(4)
    p = rng.uniform(0.02, 0.9, 400)
    y = (rng.uniform(size=400) < p**1.5).astype(int)
    df = spark.createDataFrame([(f"r{i}", "h", float(a), int(b)) for i, (a, b) in enumerate(zip(p, y))], "race_id string, horse_id string, model_prob double, won int")
    w = np.zeros(2)
    for _ in range(50):
        x = np.column_stack([p, np.ones(400)])
        q = 1 / (1 + np.exp(-x @ w))
        w -= np.linalg.solve(x.T @ (x * (q * (1 - q))[:, None]) + np.diag([1.0, 0.0]), x.T @ (q - y) + np.array([w[0], 0.0]))
    model, report = models.fit_calibrator(df, "platt")
    assert model.weights[0] == pytest.approx(w[0], rel=1e-6) and model.intercept == pytest.approx(w[1], rel=1e-6)
    after = 1 / (1 + np.exp(-(p * w[0] + w[1])))
    r = report.first()
    assert (r.n, r.brier_before, r.brier_after) == (400, pytest.approx(((p - y) ** 2).mean()), pytest.approx(((after - y) ** 2).mean(), rel=1e-5))
    labels = df.select(F.lower("race_id").alias("race_id"), "horse_id", F.col("won").cast("string").alias("target"))
    for method in ("platt", "isotonic"):
        model, report = models.fit_calibrator(df.drop("won"), method, labels)
        models.save_calibrator(model, str(tmp_path / method))
        back = models.load_calibrator(str(tmp_path / method), method)
        made = [[r.out for r in models.apply_calibrator(df, m, "model_prob", "out").orderBy("race_id").collect()] for m in (model, back)]
        assert made[0] == made[1] and report.first().improvement > 0
    with pytest.raises(ValueError):
        models.fit_calibrator(df.drop("won"), "platt")


def test_fraction_sweep_over_fitted_calibrators(spark, sf_dir):
    """Two fitted calibrators and five fractions from one job, against a plain loop."""
    base = q.rated(spark, sf_dir).select("race_id", "horse_id", "is_win", "mkt_odds_decimal", "mkt_implied", "model_prob").where("mkt_implied IS NOT NULL")
    tables = []
    for method in ("platt", "isotonic"):
        model, _ = models.fit_calibrator(base.withColumn("won", F.col("is_win")), method)
        tables.append(betting.edges(models.apply_calibrator(base, model, "model_prob", "model_prob")).withColumn("calibration", F.lit(method)))
    both = scan.durable(tables[0].unionByName(tables[1]))
    families = spark.createDataFrame([("a", 0.05, 12.0, 1), ("b", 0.0, 30.0, 2)], "family string, threshold double, cap double, top int")
    got = {(r.family, r.calibration, r.fraction): r for r in betting.fraction_sweep(both, families, (0.0, 0.001, 0.002, 0.003, 0.5)).collect()}
    rows = both.collect()
    assert len(got) == 20
    for family, threshold, cap, top in (("a", 0.05, 12.0, 1), ("b", 0.0, 30.0, 2)):
        for method in ("platt", "isotonic"):
            contests = {}
            for r in rows:
                if r.calibration == method and r.edge >= threshold and 1 < r.mkt_odds_decimal <= cap:
                    contests.setdefault(r.race_id, []).append((-r.edge, r.horse_id, r))
            bets = [x[2] for c in contests.values() for x in sorted(c, key=lambda x: x[:2])[:top]]
            for f in (0.0, 0.001, 0.002, 0.003, 0.5):
                logs = 0.0
                for r in bets:
                    b = r.mkt_odds_decimal - 1
                    factor = 1 + f * max(0.0, (r.model_prob * b - (1 - r.model_prob)) / b) * (b if r.is_win else -1)
                    logs = -math.inf if factor <= 0 or logs == -math.inf else logs + math.log(factor)
                mine = got[family, method, f]
                assert mine.bets == len(bets) and mine.contests == len(contests)
                assert mine.final == pytest.approx(1000 * math.exp(logs), rel=1e-6)


def test_bootstrap_equals_a_loop(spark):
    import hashlib

    rows = [(f"r{i % 37}", float(i % 5 - 2), 1.0 + i % 2) for i in range(200)]
    df = spark.createDataFrame(rows, "race_id string, pnl double, stake double").repartition(3)
    got = {r.draw: r.roi for r in betting.block_bootstrap(df, {"roi": ("pnl", "stake")}, "race_id", 50, "s").collect()}
    mass, steps = math.exp(-1), []
    for k in range(8):
        steps.append((steps[-1] if steps else 0) + mass)
        mass /= k + 1
    for draw in range(50):
        top = bottom = 0.0
        for race, pnl, stake in rows:
            x = int(hashlib.md5(f"s:{race}".encode()).hexdigest()[:8], 16) ^ (draw * 0x9E3779B1 % 2**32)
            x = x * 0x85EBCA6B % 2**32
            x ^= x >> 13
            x = x * 0xC2B2AE35 % 2**32
            x ^= x >> 16
            n = sum(x / 2**32 >= s for s in steps)
            top, bottom = top + n * pnl, bottom + n * stake
        assert got[draw] == pytest.approx(top / bottom)


def test_folds_are_clamped_and_gaps_checked(spark):
    rows = [(f"r{i}", f"h{j}", dt.datetime(2024, 1, 1) + dt.timedelta(days=i)) for i in range(3) for j in range(2)]
    df = spark.createDataFrame(rows, "race_id string, horse_id string, race_dt timestamp")
    assert {r.fold for r in splits.grouped_time_cv(df, "race_id", "race_dt", 9).collect()} == {0, 1, 2}
    assert {r.fold for r in splits.grouped_time_cv(df, "race_id", "race_dt", 1).collect()} == {0, 1}
    made = splits.split_fractions(df, "race_id", "race_dt", 0.34, 0.34)
    found = lambda gap: {r.rule: r.violations for r in splits.check_splits(df, made, "race_id", gap).collect()}
    assert found(1)["overlap"] == 0 and found(1.5)["overlap"] == 2


def test_bucketed_table_needs_no_exchange(spark, sf_dir):
    made = q.QUERIES["s4_bucketed"](spark, sf_dir)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" in plan and "Bucketed: true" in plan


def test_a_sum_on_the_bound_is_no_violation_in_any_order(spark):
    at = [1 / p for p in (2.0, 2.5, 7.5, 6.0)]
    orders = {"up": at, "down": at[::-1], "over": [0.5, 0.5, 0.21], "under": [0.5, 0.29], "none": [None]}
    rows = spark.createDataFrame([(g, p) for g, values in orders.items() for p in values], "g string, p double").coalesce(1)
    assert sorted(r.g for r in checks.check_prob_sum(rows, "g", "p", 0.2).collect()) == ["none", "over", "under"]


def test_compound_path_does_not_depend_on_ranges(spark):
    bets = spark.range(5000).select(F.col("id").alias("i"), ((F.col("id") * 37 % 101) / 101.0 * 0.6 + 0.2).alias("model_prob"), ((F.col("id") * 53 % 97) / 10.0 + 1.5).alias("mkt_odds_decimal"), (F.col("id") % 3 == 0).cast("int").alias("is_win"))
    told = []
    for partitions in ("1", "7"):
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        try:
            told.append([r.bankroll for r in betting.compound_path(bets, 0.01, 1000.0, ["i"]).orderBy("i").collect()])
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert told[0] == told[1]


def _exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_lines_are_shuffled_twice(spark, sf_dir):
    """Without broadcasts: lines by part, by supplier and by contest, the four tables that they meet, and orders by customer; windows by contest need no more."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert _exchanges(joins.with_market(q.runners(spark, sf_dir))) <= 8
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_decayed_sums_take_one_shuffle(spark):
    assert _exchanges(features.decayed_sum(_contests(spark), ["horse_id"], "race_dt", {"s": "is_win"}, 90.0)) == 1


def _writes(monkeypatch, *modules):
    made = []
    real = scan.durable

    def counted(df):
        made.append(df.columns)
        return real(df)

    for m in modules:
        monkeypatch.setattr(m, "durable", counted)
    return made


def test_quantiles_and_histograms_write_their_column_once(spark, monkeypatch):
    from fieldwise.operators import profile

    made = _writes(monkeypatch, scan, profile, models)
    df = spark.range(1000).select((F.col("id") / 7.0).alias("v"), (F.col("id") % 2).cast("int").alias("y"), F.lit("x").alias("wide"))
    for run, columns in ((lambda: profile.spread(df, "v"), ["v"]), (lambda: profile.capped_hist(df, "v"), ["v"]), (lambda: profile.overround_hist(df, "v"), ["o"]), (lambda: models.quantile_reliability(df, "v", "y"), ["v", "y"])):
        made.clear()
        assert run().count() > 0
        assert made == [columns]


def test_hot_rolling_frames_hold_a_row_for_each_time(spark, monkeypatch):
    """500 rows on each of ten days, nulls among entities, times and flags: equal to plain windows, from 20 rows and those without a time."""
    held = []
    real = features.with_halo
    monkeypatch.setattr(features, "with_halo", lambda df, *a: held.append(df.count()) or real(df, *a))
    rows = spark.range(5000).selectExpr("id", "if(id % 50 = 0, null, id % 2) AS who", "if(id % 77 = 0, null, timestamp_ntz'2024-01-01' + make_dt_interval(cast(id % 10 AS int) * 30)) AS ts", "if(id % 13 = 0, null, cast(id % 3 = 0 AS int)) AS won")
    plain, hot = (sorted(map(str, features.rolling_form(rows, "who", "ts", ["won"], (90, 180), hot=h).collect())) for h in (False, True))
    assert plain == hot and held[0] <= 33


def test_a_sweep_shuffles_edges_once(spark):
    edges = spark.createDataFrame([("c", "r", "h", 0.1, 3.0, 0.4, 1)], "calibration string, race_id string, horse_id string, edge double, mkt_odds_decimal double, model_prob double, is_win int")
    grid = spark.createDataFrame([("a", 0.0, 10.0, 1), ("b", 0.05, 20.0, 2)], "family string, threshold double, cap double, top int")
    assert edges.count() == 1
    plan = betting.ranked_once(edges, grid, ["calibration"])._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(race_id" in plan and "hashpartitioning(calibration" not in plan
    made = {r.family: r for r in betting.fraction_sweep(edges, grid, (0.0, 0.5)).where("fraction = 0.5").collect()}
    assert made["a"].bets == 1 and made["a"].contests == 1 and made["b"].hit_rate == 1.0 and made["b"].mean_odds == 3.0


@pytest.mark.parametrize("most", [1, 2_000_000])
def test_decayed_z_by_days_or_ranges(spark, monkeypatch, most):
    rows = spark.range(300).selectExpr("cast(id AS string) AS race_id", "'h' AS horse_id", "if(id % 40 = 0, null, timestamp'2020-01-01' + make_dt_interval(cast(id % 7 AS int), cast(id % 5 AS int))) AS ts", "cast(id * 37 % 101 AS double) AS a")
    monkeypatch.setattr(ratings, "MOST_OF_A_DAY", 10**9)
    want = {r.race_id: r.a_z for r in ratings.decayed_z(rows, "ts", ["a"]).collect()}
    monkeypatch.setattr(ratings, "MOST_OF_A_DAY", most)
    for r in ratings.decayed_z(rows, "ts", ["a"]).collect():
        assert r.a_z == (None if want[r.race_id] is None else pytest.approx(want[r.race_id], rel=1e-9, abs=1e-9))


def _shuffle_files(spark):
    found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {found.apply(i).getName() for i in range(found.size()) if found.apply(i).getName().startswith("shuffle_")}


def test_durable_tables_leave_no_shuffles(spark):
    """What a stored table was made from is removed when it is written; the session's setting stays, and a table that is read later still makes its own."""
    before, setting = _shuffle_files(spark), spark.conf.get(scan.CLEANUP)
    made = spark.range(1000).repartition(3, "id").groupBy((F.col("id") % 7).alias("k")).count()
    stored = scan.durable(made)
    assert not _shuffle_files(spark) - before and spark.conf.get(scan.CLEANUP) == setting
    assert sorted(map(str, stored.collect())) == sorted(map(str, made.collect()))


@pytest.mark.parametrize("most", [0, 2_000_000])
def test_hot_priors_by_day_equal_windows(spark, monkeypatch, most):
    """Nulls among keys, times and flags, empty keys and several rows of one time: by days, or by ranges where a day holds too much."""
    monkeypatch.setattr(features, "MOST_OF_A_DAY", most)
    rows = spark.range(2000).selectExpr(
        "cast(id AS string) AS race_id", "'h' AS horse_id", "if(id % 50 = 0, null, if(id % 3 = 0, '', 'a')) AS trainer_id", "cast(id % 9 AS string) AS jockey_id", "if(id % 11 = 0, null, 'g') AS going",
        "if(id % 77 = 0, null, timestamp'1969-12-30' + make_dt_interval(cast(id % 5 AS int), cast(id % 4 AS int) * 7)) AS ts", "if(id % 13 = 0, null, cast(id % 3 = 0 AS int)) AS won",
    )
    told = lambda df: sorted(map(str, df.collect()))
    for keys in (["trainer_id"], ["trainer_id", "going"]):
        assert told(features.prior_rate(rows, keys, "ts", "won", "rate", hot=True)) == told(features.prior_rate(rows, keys, "ts", "won", "rate"))
    two = ["jockey_id", "trainer_id"]
    plain = told(features.prior_eb_rate(rows, two, "ts", "won"))
    assert told(features.prior_eb_rate(rows, two, "ts", "won", hot=("trainer_id",))) == plain
    assert told(features.prior_eb_rate(scan.durable(rows), two, "ts", "won", hot=("trainer_id",), cheap=True)) == plain


def test_few_trainers_meet_no_single_task(spark, sf_dir):
    plan = q.rated(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(trainer_id" not in plan and "hashpartitioning(__slot" in plan


def test_folds_are_fitted_on_stored_rows(spark, monkeypatch):
    """The rows are written, then with their folds; contests are counted on what their order wrote, and steps end when they move nothing."""
    made = _writes(monkeypatch, models)
    rows = spark.range(400).selectExpr("cast(id % 40 AS string) AS race_id", "cast(id AS string) AS horse_id", "timestamp'2024-01-01' + make_dt_interval(cast(id % 40 AS int)) AS race_dt", "cast(id * 7 % 10 < 3 AS int) AS is_win", "id % 13 / 13.0 AS x")
    scored = models.train_oof(rows, ["x"], k=2)
    assert made == [rows.columns, ["race_id", *[c for c in rows.columns if c != "race_id"], "__fold"]]
    assert scored.where("oof_prob IS NOT NULL").count() > 0
    from fieldwise.operators import calibration

    passes = []
    real = F.create_map
    monkeypatch.setattr(calibration.F, "create_map", lambda *a: passes.append(1) or real(*a))
    fit = calibration.fit_logistic(rows, ["x"], "is_win")
    few = len(passes)
    monkeypatch.setattr(calibration, "SETTLED", -1.0)
    whole = calibration.fit_logistic(rows, ["x"], "is_win")
    assert few < len(passes) - few == calibration.STEPS
    assert (fit.intercept, *fit.weights) == pytest.approx((whole.intercept, *whole.weights), rel=1e-12)


def test_a_calibrator_writes_labelled_rows_once(spark, monkeypatch):
    from fieldwise.operators import guards

    made = _writes(monkeypatch, guards, models)
    pred = spark.range(60).selectExpr("cast(id % 9 AS string) AS race_id", "cast(id AS string) AS horse_id", "(id % 17 + 1) / 20.0 AS model_prob")
    labels = pred.select("race_id", "horse_id", (F.col("model_prob") > 0.6).cast("int").alias("target"))
    assert models.fit_calibrator(pred, "none", labels)[1].first().n == 60
    assert made == [["model_prob", "won"]]
    with pytest.raises(ValueError, match="no row meets a label"):
        models.fit_calibrator(pred, "none", labels.withColumn("race_id", F.lit("no")))


def test_blended_ratings_are_stored_step_by_step(spark, monkeypatch):
    """Entrants, then with horses and jockeys, then with the few trainers: each write removes the shuffles before it, and no task holds a trainer."""
    made = _writes(monkeypatch, features, ratings)
    keys = []
    real = features.with_prior
    monkeypatch.setattr(features, "with_prior", lambda df, *a: keys.append(df.columns) or real(df, *a))
    rows = spark.range(200).selectExpr(
        "cast(id % 50 AS string) AS race_id", "cast(id % 23 AS string) AS horse_id", "cast(id % 11 AS string) AS jockey_id", "cast(id % 3 AS string) AS trainer_id", "timestamp'2024-01-01' + make_dt_interval(cast(id % 50 AS int)) AS race_dt",
        "cast(id % 4 + 1 AS int) AS pos", "4 AS field_size", "cast(id % 4 = 0 AS int) AS is_win",
    )
    got = {(r.race_id, r.horse_id): r for r in ratings.blended_ratings(rows).collect()}
    assert len(got) == 200 and len(made) == 3 and len(keys) == 1 and "is_win" not in made[1] and "jockey_elo" in made[1] and "trainer_elo" in made[2]
    plain = ratings.elo(rows, "trainer_id", "race_dt", "elo").collect()
    assert [got[r.race_id, r.horse_id].trainer_elo for r in plain] == pytest.approx([r.elo for r in plain], rel=1e-9, abs=1e-9)


def test_features_shuffle_rows_once_for_each_entity(spark, sf_dir):
    """By contest, horse, jockey and trainer, with ratings of horses joined first; and the ratings by horse. Every feature is there."""
    base = scan.durable(q.runners(spark, sf_dir).drop("odds_text"))
    rated = ratings.elo(base, "horse_id", "race_dt", "horse_elo").select("horse_id", "race_dt", "horse_elo")
    made = features.build_features(base, rated)
    assert _exchanges(made) <= 5
    names = {"is_place", "off_time", "n_90", "is_win_rate_365", "win_decayed_90", "runs_decayed_90", "horse_course_rate", "jockey_going_rate", "trainer_discipline_rate", "distance_bucket", "horse_distance_rate"}
    names |= {"course_OTHER", "going_OTHER", "rating_delta", "weight_delta", "draw_norm", "draw_high", "eb_horse", "eb_jockey", "eb_trainer", "horse_elo_rt"}
    assert names | set(base.columns) <= set(made.columns) and made.count() == base.count()
