"""Exact dedup against a minimal perfect hash over the distinct digests of a history.

Texts are equal when they agree after each run of ASCII white space becomes one space. History
rows are reduced to distinct digests; shards of about ``shard_size`` digests each get a minimal
perfect hash (hash and displace: a pilot, mixed into the keys, for each bucket; single keys go straight to free slots).
A slot holds the full digest, the winner's doc_id and the count. New digests, already reduced to
one row each, are looked up in their shard, compared byte for byte, and either join the
member's group or form groups among themselves.

Scale: groups are aggregated before any shuffle of rows; shard numbers come from counts; each row
then meets its group through a join on the digest, in which a hot digest can be split by
adaptive execution. Texts are read once, and never shuffled.

Defined cases: null text counts as empty; the smallest doc_id of equal texts stays; rows with a
null doc_id come after all others and stay only where no other row of the group has one. Rows
that repeat a doc_id and text share keep_id and are all marked kept: they are one document.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldwise.llm.common import discard, packed, places, stored
from fieldwise.llm.text import mix

EMPTY = -(2**31)
#: Pilots that a bucket may try. Each tries fresh slots, so the last buckets of a shard need some multiples of its size.
PILOTS = 1 << 26


def normalised(text):
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[ \t-\r]+", " ")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id and the 32-byte digest of its normalised text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2(normalised(F.col("text")), 256)).alias("digest"))


def groups(rows: DataFrame) -> DataFrame:
    return rows.groupBy("digest").agg(F.min("doc_id").alias("winner"), F.count(F.lit(1)).alias("n"))


def _lanes(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit parts of digests given as rows of 32 bytes: one picks the bucket, one the slot."""
    parts = np.ascontiguousarray(keys).view("<u8").reshape(len(keys), 4)
    return parts[:, 1], parts[:, 2]


def _spot(b: np.ndarray, pilot: np.ndarray, n: int) -> np.ndarray:
    """The slot of keys under a pilot. Both are mixed, so each pilot places the keys of a bucket anew."""
    return (mix(b ^ mix(pilot.astype(np.uint64) + np.uint64(1))) % np.uint64(max(n, 1))).astype(np.int64)


def build(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pilots and the slot of each key: a bijection of n distinct digests onto 0..n-1."""
    n = len(keys)
    buckets = max(1, n * 5 // 8)
    pilots, slot = np.full(buckets, EMPTY, np.int32), np.zeros(n, np.int64)
    if not n:
        return pilots, slot
    a, b = _lanes(keys)
    bucket = (a % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    starts = np.searchsorted(bucket[order], np.arange(buckets + 1))
    sizes, taken = np.diff(starts), np.zeros(n, bool)
    for size in sorted(set(sizes[sizes > 1].tolist()), reverse=True):
        waiting, pilot = np.flatnonzero(sizes == size), 0
        members = order[starts[waiting][:, None] + np.arange(size)]
        while len(waiting):  # every waiting bucket tries the next pilot; those that get all their slots leave
            spot = _spot(b[members], np.array([pilot]), n)
            within = np.sort(spot, axis=1)
            fits = np.flatnonzero(~taken[spot].any(axis=1) & (within[:, 1:] != within[:, :-1]).all(axis=1))
            first = np.zeros(len(fits) * size, bool)
            first[np.unique(spot[fits], return_index=True)[1]] = True
            won = fits[first.reshape(-1, size).all(axis=1)]
            taken[spot[won]], slot[members[won]], pilots[waiting[won]] = True, spot[won], pilot
            left = np.setdiff1d(np.arange(len(waiting)), won)
            waiting, members, pilot = waiting[left], members[left], pilot + 1
            if pilot == PILOTS:
                raise ValueError("no pilot separates the digests of a bucket: two agree in 128 bits")
    free = np.flatnonzero(~taken)
    single = np.flatnonzero(sizes == 1)
    slot[order[starts[single]]] = free
    pilots[single] = -free - 1
    return pilots, slot


def locate(keys: np.ndarray, pilots: np.ndarray, n: int) -> np.ndarray:
    """The slot each key would have; only a comparison with the slot's digest tells members."""
    a, b = _lanes(keys)
    pilot = pilots[(a % np.uint64(len(pilots))).astype(np.int64)].astype(np.int64)
    return np.where(pilot >= 0, _spot(b, np.maximum(pilot, 0), n), np.where(pilot == EMPTY, 0, -pilot - 1))


def _bytes(column: pa.ChunkedArray) -> np.ndarray:
    joined = b"".join(column.to_pylist())
    return np.frombuffer(joined, np.uint8).reshape(-1, 32)


def merge_by_hash(history: DataFrame, new: DataFrame, shard_size: int = 200_000) -> DataFrame:
    """Groups of both sides: digest, winner, n. Each side has one row per digest."""
    shards = max(1, math.ceil(max(history.count(), new.count()) / shard_size))
    shard = F.pmod(F.xxhash64("digest"), F.lit(shards)).alias("shard")

    def index(table: pa.Table) -> pa.Table:
        keys = _bytes(table["digest"])
        pilots, slot = build(keys)
        back = np.argsort(slot)
        blob = lambda x: pa.array([x.tobytes()], pa.binary())
        winner, counts = table["winner"].fill_null(2**63 - 1).to_numpy(), table["n"].to_numpy()
        return pa.table([table["shard"].slice(0, 1), blob(pilots), blob(keys[back]), blob(winner[back]), blob(counts[back])], names=["shard", "pilots", "slots", "winners", "counts"])

    built = stored(history.select(shard, "digest", "winner", "n").groupBy("shard").applyInArrow(index, "shard long, pilots binary, slots binary, winners binary, counts binary"))

    def look_up(left: pa.Table, right: pa.Table) -> pa.Table:
        winner, n = left["winner"].fill_null(2**63 - 1).to_numpy(), left["n"].to_numpy()
        keys = _bytes(left["digest"])
        if right.num_rows:
            part = {c: right[c][0].as_buffer() for c in right.column_names[1:]}
            slots = np.frombuffer(part["slots"], np.uint8).reshape(-1, 32)
            winners, counts = np.frombuffer(part["winners"], np.int64).copy(), np.frombuffer(part["counts"], np.int64).copy()
            spot = locate(keys, np.frombuffer(part["pilots"], np.int32), len(slots))
            member = (slots[spot] == keys).all(axis=1) if len(keys) else np.zeros(0, bool)
            winners[spot[member]] = np.minimum(winners[spot[member]], winner[member])
            counts[spot[member]] += n[member]
            keys, winner, n = np.concatenate([slots, keys[~member]]), np.concatenate([winners, winner[~member]]), np.concatenate([counts, n[~member]])
        flat = pa.FixedSizeBinaryArray.from_buffers(pa.binary(32), len(keys), [None, pa.py_buffer(np.ascontiguousarray(keys))]).cast(pa.binary())
        return pa.table([flat, pa.array(winner, mask=winner == 2**63 - 1), pa.array(n)], names=["digest", "winner", "n"])

    merged = stored(new.select(shard, "digest", "winner", "n").groupBy("shard").cogroup(built.groupBy("shard")).applyInArrow(look_up, "digest binary, winner long, n long"))
    discard(built)
    return merged


def exact_dedup(docs: DataFrame, is_history=None, shard_size: int = 200_000) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    ``is_history`` is a condition on doc_id that tells the rows already known; by default rows
    whose hashed id is even.
    """
    rows = stored(digests(docs))
    old = F.coalesce(is_history if is_history is not None else F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0, F.lit(False))
    known, new = stored(groups(rows.where(old))), stored(groups(rows.where(~old)))
    both = merge_by_hash(known, new, shard_size)
    discard(known, new)
    merged = both.withColumnRenamed("digest", "key")
    joined = rows.join(merged, rows["digest"] == merged["key"])
    return joined.select(
        "doc_id",
        F.col("winner").alias("keep_id"),
        F.col("n").alias("group_size"),
        F.col("doc_id").eqNullSafe(F.col("winner")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def deduplicate(docs: DataFrame) -> DataFrame:
    """The documents that stay, all columns: one row of each distinct normalised text.

    Whole rows are shuffled once, by text and id together, so that the copies of a text spread over tasks.
    """
    kept = exact_dedup(docs).where("kept")
    kept = kept.select(*[v.alias(k) for k, v in places(F.col("doc_id"), F.unhex("text_sha256")).items()]).distinct()
    rows = packed(docs, **places(F.col("doc_id"), F.unhex(F.sha2(normalised(F.col("text")), 256))))
    return rows.join(kept, kept.columns, "left_semi").dropDuplicates(kept.columns).select("row.*")
