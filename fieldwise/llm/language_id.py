"""Language ID with a bit-sliced Bloom filter whose lookups return language bitmasks.

Training takes, for each language, the ``per_language`` byte n-grams that most of its sampled
documents hold. One table holds all languages' Bloom filters side by side, in as many 64-bit words
a row as they need: bit j of a row belongs to language j, so ANDing the rows of an n-gram's hashes
gives every language that has it. A text's lookups are counted for each bit, the counts are corrected by that
language's false-positive rate, and the largest share decides.

Training reads at most ``sample`` documents of each language (smallest hashed ids, drawn by a
threshold that follows from each language's count; null languages are left out), and learns every language. Scoring reads whole texts slice by slice,
shuffles nothing, and ships one table of ``2**bits`` words for each 64 languages.

Defined cases: null text, empty text and text without a letter give ``und`` and score 0. Ties go
to the alphabetically first language. Without training rows everything is ``und``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldwise.llm import text as tx
from fieldwise.llm.common import SPARE, drawn, one_text

HASHES = 3
_SEED = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray
    false_rate: np.ndarray
    bits: int


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the 4-byte n-grams of lower-cased bytes, white space as one blank value, and the row of each."""
    b = tx.LOWER[data].astype(np.uint32)
    b[tx.SPACE[data]] = 32
    n = len(b) - 3
    if n <= 0:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    code = b[:n] | b[1 : n + 1] << np.uint32(8) | b[2 : n + 2] << np.uint32(16) | b[3:] << np.uint32(24)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    inside = row[:n] == row[3:]
    return code[inside], row[:n][inside]


def rows_of(code: np.ndarray, k: int, bits: int) -> np.ndarray:
    return ((code.astype(np.uint64) + np.uint64(1)) * _SEED[k] >> np.uint64(64 - bits)).astype(np.int64)


def lookup(table: np.ndarray, code: np.ndarray, bits: int) -> np.ndarray:
    """The languages' bits of each code, one line for each word of the table."""
    mask = table[:, rows_of(code, 0, bits)]
    for k in range(1, HASHES):
        mask &= table[:, rows_of(code, k, bits)]
    return mask


def bit(words: np.ndarray, j: int) -> np.ndarray:
    return (words[j >> 6] >> np.uint64(j & 63)) & np.uint64(1)


def fit(texts: list[str], langs: list[str], per_language: int, bits: int) -> Model:
    names = sorted(set(langs))
    by_name: dict[str, list[str]] = {name: [] for name in names}
    for t, x in zip(texts, langs):
        by_name[x].append(t)
    table = np.zeros((-(-len(names) // 64), 1 << bits), np.uint64)
    for j, name in enumerate(names):
        found = [np.unique(grams(*tx.raw(pa.array([t], pa.string())))[0]) for t in by_name[name]]
        code, count = np.unique(np.concatenate(found), return_counts=True)
        top = np.sort(code[np.lexsort((code, -count))[:per_language]])
        for k in range(HASHES):
            table[j >> 6, rows_of(top, k, bits)] |= np.uint64(1 << (j & 63))
    # the false-positive rate of each language, as its filter's fill gives it
    fill = np.array([bit(table, j).mean() for j in range(len(names))])
    return Model(names, table, fill**HASHES, bits)


def train(docs: DataFrame, sample: int = 600, per_language: int = 3000, bits: int = 17, where=None) -> Model:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text").where("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL")
    if where is not None:
        rows = rows.where(where)
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()
    if not counts:
        return Model([], np.zeros((0, 1 << bits), np.uint64), np.zeros(0), bits)
    shares = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, SPARE * sample / r["n"])) for r in counts], "lang string, share double")
    drew = rows.select("doc_id", "lang").join(F.broadcast(shares), "lang").where(drawn("doc_id", F.col("share")))
    ids: dict[str, list] = {}
    for r in sorted(drew.select("lang", F.xxhash64("doc_id").alias("hash"), "doc_id").distinct().collect()):
        ids.setdefault(r["lang"], []).append(r["doc_id"])
    picked = docs.sparkSession.createDataFrame([(i,) for found in ids.values() for i in found[:sample]], "doc_id long").distinct()
    found = sorted(one_text(rows.join(F.broadcast(picked), "doc_id"), ["doc_id", "lang"]).toLocalIterator(), key=lambda r: (r[0], r[1]))
    return fit([r["text"] for r in found], [r["lang"] for r in found], per_language, bits)


def score(column: pa.Array, model: Model) -> tuple[list[str], np.ndarray]:
    data, offsets = tx.raw(column)
    code, row = grams(data, offsets)
    mask, rows = lookup(model.table, code, model.bits), len(offsets) - 1
    total = np.bincount(row, minlength=rows).astype(np.float64)
    hits = np.stack([np.bincount(row[bit(mask, j) == 1], minlength=rows) for j in range(len(model.languages))], axis=1)
    true = np.clip((hits - total[:, None] * model.false_rate) / (1 - model.false_rate), 0, None)
    best = true.argmax(axis=1)
    share = true[np.arange(rows), best] / np.maximum(true.sum(axis=1), 1e-9)
    # ASCII letters are plain; other texts with a high byte are looked at character by character
    plain = tx.row_sums(((data | 32) - 97 < 26), offsets) > 0
    high = tx.row_sums(data >= 0x80, offsets) > 0
    letter = [bool(p) or bool(h) and any(c.isalpha() for c in t.as_py() or "") for p, h, t in zip(plain, high, column)]
    return [model.languages[b] if ok else "und" for b, ok in zip(best, letter)], np.where(letter, np.clip(share, 0, 1), 0.0)


def language_id(docs: DataFrame, model: Model) -> DataFrame:
    """One row per document: doc_id, lang_pred, score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for part in tx.slices(batch):
                names, share = score(part.column("text"), m) if m.languages else (["und"] * part.num_rows, np.zeros(part.num_rows))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(names, pa.string()), pa.array(share)], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(predict, "doc_id long, lang_pred string, score double")
