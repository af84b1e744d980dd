"""Training samples stay bounded where one id stands on very many rows or a text is very long, and stages take any column name."""

from pyspark.sql import functions as F

from fieldwise.llm import common, language_id, near_dedup


def test_a_repeated_id_gives_one_text(spark, monkeypatch):
    docs = spark.range(20_000).select(F.when(F.col("id") < 100, F.col("id")).otherwise(7).alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string"), F.repeat(F.lit("x"), F.lit(500))).alias("text"), F.lit("en").alias("lang"))
    labels = docs.select("doc_id", (F.col("doc_id") % 2).alias("toxic"))
    monkeypatch.setattr(common, "MOST_CHARS", 50)
    found = common.labelled_sample(docs, labels, "toxic", 50)
    assert 0 < len(found) <= 100 and len({r[0] for r in found}) == len(found) and all(len(r[1]) <= 50 for r in found)
    seen = []
    monkeypatch.setattr(language_id, "fit", lambda texts, *rest: seen.extend(texts))
    language_id.train(docs, sample=60)
    assert 0 < len(seen) <= 60


def test_near_dedup_takes_any_column_name(spark):
    text = " ".join(f"word{i}" for i in range(60))
    rows = [(i, text + (" more" if i == 2 else ""), "en", "s", 1, "a", "b", "c", "d") for i in range(3)] + [(9, "another text altogether, not like them", "en", "s", 1, "a", "b", "c", "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept_id string, kept_mark string, component string, first string")
    kept = near_dedup.deduplicate(docs, words=5, percent=80)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [0, 9]
