"""Helpers that several training-data operators share: durable tables and bounded samples."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldwise.llm.text import mix

#: Where durable tables go in a local session that names no shared folder, as in tests.
LOCAL_CHECKPOINTS = "/tmp/checkpoints"
#: Spark's setting for the bytes of a batch that goes to a Python worker, and what it is set to for texts.
BATCH_BYTES, BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", "2m"
#: How much of a sample is drawn beyond its size, so that chance does not leave it short.
SPARE = 1.25
#: Characters of a text that a training sample reads.
MOST_CHARS = 200_000


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Only a local session may do without that setting."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return named or LOCAL_CHECKPOINTS


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage: a lost executor costs no recomputation, and a table used several times
    is computed once.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.stored_at = path
    return table


def discard(*tables: DataFrame) -> None:
    """Remove stored tables that no later step reads."""
    for table in tables:
        path = table.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(table.stored_at)
        path.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def map_texts(rows: DataFrame, made: Callable, schema) -> DataFrame:
    """``rows.mapInArrow(made, schema)`` for rows that hold texts or sets: batches of about ``BATCH`` bytes, where the session names no size.

    Spark's default of 64 MB is held several times for each task: while the batch grows and is written outside the heap, in the worker, and on its way back.
    The session keeps the setting, as Spark reads it when the rows are asked for."""
    conf = rows.sparkSession.conf
    if BATCH_BYTES not in conf.getAll:
        conf.set(BATCH_BYTES, BATCH)
    return rows.mapInArrow(made, schema)


def packed(docs: DataFrame, **keys) -> DataFrame:
    """All columns of ``docs`` as one struct ``row``, beside ``keys``: no column of the user's can clash with a key. ``row.*`` gives them back."""
    return docs.select(F.struct(*[F.col(f"`{c.replace('`', '``')}`") for c in docs.columns]).alias("row"), *[v.alias(k) for k, v in keys.items()])


def places(doc_id, digest) -> dict:
    """A row's id and text as three keys that are never null. Joins and drops of repeats on just these share one shuffle."""
    return {"digest": digest, "id": F.coalesce(doc_id.cast("long"), F.lit(0)), "none": doc_id.cast("long").isNull()}


def among(rows: DataFrame, keys: list[str], wanted: DataFrame, bits: int = 16, most_words: int = 1 << 21) -> DataFrame:
    """All of ``rows`` whose ``keys`` are in ``wanted`` (its columns, in that order), and about one in ``bits`` of the others, without a shuffle.

    Each wanted key sets one bit, chosen by its hash, of ``bits`` that there are for each; words of 64 bits are broadcast. There are at most ``most_words``
    of them, so with very many wanted keys more of the others stay. No wanted row is lost, and the join that follows decides.
    """
    words = min(most_words, wanted.count() * bits // 64 + 1)
    spot = lambda frame, columns: F.pmod(F.xxhash64(*[frame[c] for c in columns]), F.lit(64 * words))
    word, at = (lambda x: F.shiftright(x, 6)), (lambda x: F.pmod(x, F.lit(64)).cast("int"))
    theirs, ours = spot(wanted, wanted.columns), spot(rows, keys)
    table = wanted.select(word(theirs).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), at(theirs)).alias("bit"))
    table = table.groupBy("word").agg(F.bit_or("bit").alias("bits"))
    return rows.join(F.broadcast(table), (word(ours) == table["word"]) & (F.getbit(table["bits"], at(ours)) == 1), "left_semi")


def drawn(key, share):
    """True for about ``share`` of all keys, the same ones each time: a threshold on their hash."""
    return F.pmod(F.xxhash64(key), F.lit(1 << 40)) < (share * F.lit(float(1 << 40))).cast("long")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, limit: int, where=None) -> list[tuple]:
    """At most ``limit`` rows of (doc_id, text, label) for each label value 0 and 1.

    Labels are counted, and ids whose hash falls below a threshold that follows from the counts are drawn; so
    however many rows and tasks there are, about ``SPARE * limit`` ids of each value reach the driver, and those with
    the smallest hashes are taken. Their texts are fetched through a join with at most ``2 * limit`` ids.
    An id that repeats counts once, with its greatest label, and gives one text. Null labels, ids and texts are left out.
    """
    spark = docs.sparkSession
    ids = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where("doc_id IS NOT NULL AND label IN (0, 1)")
    ids = ids.groupBy("doc_id").agg(F.max("label").alias("label"))
    if where is not None:
        ids = ids.where(where)
    chosen = []
    for value, count in sorted(ids.groupBy("label").count().collect()):
        found = ids.where(F.col("label") == value).where(drawn("doc_id", F.lit(min(1.0, SPARE * limit / count)))).select(F.xxhash64("doc_id"), "doc_id", "label").collect()
        chosen += [(r[1], r[2]) for r in sorted(found)[:limit]]
    if not chosen:
        return []
    picked = spark.createDataFrame(chosen, "doc_id long, label int").dropDuplicates(["doc_id"])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text IS NOT NULL").join(F.broadcast(picked), "doc_id")
    return sorted((r["doc_id"], r["text"], r["label"]) for r in one_text(rows, ["doc_id", "label"]).toLocalIterator())


def one_text(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each key: of its texts the one with the smallest hash, of which training reads ``MOST_CHARS`` characters. So an id that very many rows
    repeat, or a very long text, adds a bounded number of bytes to a sample."""
    return rows.groupBy(*keys).agg(F.min_by(F.left("text", F.lit(MOST_CHARS)), F.xxhash64("text")).alias("text"))


def families(bags: list[set[bytes]], samples: int = 16, least: int = 8) -> list[int]:
    """A family for each bag of words: equal bags, and bags of ``least`` words or more of which about half are
    shared, as ``samples`` MinHash samples tell, are one. A copied document must not count as many texts. The
    bags are those of the bounded training sample."""
    up = list(range(len(bags)))

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    keys = mix(np.arange(1, samples + 1, dtype=np.uint64))
    signed = np.zeros((len(bags), samples), np.uint64)
    equal: dict[frozenset, int] = {}
    large: list[int] = []
    for i, bag in enumerate(bags):
        up[i] = equal.setdefault(frozenset(bag), i)
        if up[i] < i or len(bag) < least:
            continue
        h = np.array([crc32(w) for w in bag], np.uint64)
        signed[i] = mix(h[:, None] ^ keys[None, :]).min(axis=0)
        for k in np.flatnonzero((signed[large] == signed[i]).sum(axis=1) * 2 >= samples).tolist():
            x, y = top(large[k]), top(i)
            up[max(x, y)] = min(x, y)
        large.append(i)
    return [top(i) for i in range(len(bags))]
