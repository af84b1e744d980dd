"""Stages that give whole rows: names of columns that clash, and one shuffle of what they carry."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldwise.llm import exact_dedup, mixing, near_dedup
from fieldwise.llm.common import among, discard, stored

STAGES = {"exact": exact_dedup.deduplicate, "near": near_dedup.deduplicate, "mix": mixing.mixed_documents}


@pytest.fixture(scope="module")
def rows(spark):
    long = " ".join(f"word{i}" for i in range(60))
    texts = [(1, long), (2, long), (2, long), (3, long.replace("word7 ", "")), (None, "a b"), (None, "a b"), (None, "c d"), (0, "c d"), (5, None), (6, "")]
    return spark.createDataFrame([(i, t, "en", "src1", None) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.mark.parametrize("name", STAGES)
def test_stages_leave_columns_of_any_name(name, rows):
    clash = "row key id none digest n copy copies kept_id kept_mark __digest __key __row __mark __id __copies text_md5 range before key_ a.b c`d".split()
    given = rows.select("*", *[F.concat(F.lit(f"{c}:"), F.coalesce("doc_id", F.lit(-1))).alias(c) for c in clash])
    made = STAGES[name](given)
    assert made.columns == given.columns
    got = [tuple(r) for r in made.collect()]
    assert all(r[5:] == tuple(f"{c}:{-1 if r[0] is None else r[0]}" for c in clash) for r in got)
    assert Counter(r[:5] for r in got) == Counter(tuple(r) for r in STAGES[name](rows).collect())


def test_kept_rows(rows):
    assert Counter((r.doc_id, r.text and r.text[:3]) for r in exact_dedup.deduplicate(rows).collect()) == Counter([(1, "wor"), (3, "wor"), (None, "a b"), (0, "c d"), (5, None)])
    near = Counter((r.doc_id, r.text and r.text[:3]) for r in near_dedup.deduplicate(rows).collect())
    assert near[1, "wor"] == 1 and not near[2, "wor"] and not near[3, "wor"]


@pytest.mark.parametrize("name", STAGES)
def test_whole_rows_are_shuffled_once(name, spark, rows):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        made = STAGES[name](rows)
        plan = spark._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(made._jdf.queryExecution(), "formatted")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    shuffles = re.findall(r"\(\d+\) Exchange\nInput \[\d+\]: (.*)", plan)
    assert len([s for s in shuffles if re.search(r"\brow#", s)]) == 1
    assert not [s for s in shuffles if re.search(r"\btext#", s)]


@pytest.mark.parametrize("most_words", [1, 1 << 21])
def test_a_filter_of_bits_loses_no_wanted_row(most_words, spark):
    rows = spark.range(20_000).select(F.when(F.col("id") > 0, F.col("id")).alias("word"), F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("bits"), "id")
    wanted = rows.where("id % 20 = 0").select(F.col("word").alias("a"), F.col("bits").alias("b"))
    left = {r.id for r in among(rows, ["word", "bits"], wanted, most_words=most_words).select("id").collect()}
    assert left >= set(range(0, 20_000, 20))
    assert most_words == 1 or len(left) < 4_000
    assert not among(rows, ["word", "bits"], wanted.limit(0)).count()


def test_near_dedup_shuffles_no_text_that_shares_no_band(spark):
    rng = np.random.default_rng(21)
    texts = [" ".join(f"{x:08x}" for x in rng.integers(0, 2**32, 4000)) for _ in range(100)]
    texts[1] = texts[0] + " end"
    docs = stored(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    sc = spark.sparkContext._jsc.sc()

    def shuffled():
        sc.listenerBus().waitUntilEmpty(30_000)
        return sc.statusStore().executorList(False).apply(0).totalShuffleWrite()

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = shuffled()
        kept = {r.doc_id for r in near_dedup.near_dedup(docs, words=3, percent=85).where("kept").collect()}
        assert kept == set(range(100)) - {1}
        assert shuffled() - before < sum(map(len, texts)) / 4
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        discard(docs)
