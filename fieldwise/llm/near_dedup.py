"""MinHash near-dedup with odd sketches.

A document is the set of its distinct shingles of ``words`` words. Its MinHash samples give
``bands`` band keys, and are folded into a bitmap in which each sample flips one bit: an odd sketch. The bits in
which two sketches differ estimate a high similarity closely, so most candidates fall before
their full sets are compared; those that stay are confirmed on the full sets.

1. Documents with equal sets form one class, which goes on with one number.
2. Within each band bucket every member meets the bucket's smallest member.
3. Confirmed links are joined into components. In rounds, each member outside its bucket's main
   component names its likeliest partners in other components of the bucket; those are confirmed and
   components joined, and later rounds name more, until nobody has a partner left that was not named. So every
   pair that shares a band is connected already, ruled out by its sketches, or compared, while a
   bucket of m like texts costs a few m comparisons. Only members whose set sizes allow the
   similarity meet. Larger buckets are cut into blocks of ``block`` members, so no task holds more than two blocks. A bucket of m texts of
   like sizes that are all just too different compares m * m sketches at worst: no link may be lost.
4. Components of all links give the result.

Two bitmaps rule pairs out. The odd sketch of the samples leaves five standard deviations of room. The
parities of the whole set are never further apart than the sets themselves, so they drop no link; sets of more than
``FOLD`` shingles fold a sample of them, again with five standard deviations of room.

Scale: counts and smallest members are combined before shuffles, joins on hot keys can be split by adaptive
execution, comparisons with one leader are dealt over salts. Signatures are shuffled once, where rows form classes; later steps
take the sketches of those classes alone that share a band with another. Full sets are written once, for one row of
each of these, found by a join on ids and text digests; a filter of bits drops other texts before that join shuffles them, and nothing
else of the text is kept. Tables of earlier steps are removed when no later step reads them.

Defined cases: null, empty and blank texts have no shingles, link with nothing and are kept; fewer
words than ``words`` form one shingle; every row is given, repeated ones too; rows with a null doc_id take part as others
do, and where a component has no other rows, its component_id is null and its rows count as kept; different texts may share a
doc_id; no rows give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldwise.llm import text as tx
from fieldwise.llm.common import among, discard, map_texts, packed, places, stored
from fieldwise.llm.components import connected_components

SKETCH_BITS = 512
PARITY_BITS = 1024
#: Sets up to this size fold all their shingles.
FOLD = 512
_rng = np.random.default_rng(99)
_MULTIPLY = _rng.integers(1, 2**63, 512, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 2**63, 512, dtype=np.uint64)


def shingle_sets(column: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all rows, one row after the other, and where each begins."""
    data, offsets = tx.raw(column)
    data = tx.LOWER[data]
    spans = tx.word_spans(data, offsets)
    h = tx.span_hashes(data, spans.start, spans.end)
    shingle, at = tx.windows(h, spans.row, words)
    first = np.searchsorted(at, spans.first)
    sets = []
    for i, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
        if b > a:
            sets.append(np.unique(shingle[a:b]))
        else:
            own = h[spans.first[i] : spans.first[i + 1]]
            whole = (own * tx._WINDOW[: len(own)]).sum(dtype=np.uint64) + np.uint64(len(own))
            sets.append(tx.mix(np.array([whole] if len(own) else [], np.uint64)))
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), np.cumsum([0, *map(len, sets)])


def signatures(shingles: np.ndarray, begin: np.ndarray, bands: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Band keys and odd sketches of non-empty sets."""
    n = len(begin) - 1
    sample = np.zeros((n, bands * rows), np.uint64)
    for k in range(bands * rows):
        sample[:, k] = np.minimum.reduceat(shingles * _MULTIPLY[k] + _ADD[k], begin[:-1])
    keys = np.zeros((n, bands), np.uint64)
    for r in range(rows):
        keys = tx.mix(keys * np.uint64(3) + sample[:, r::rows])
    keys = tx.mix(keys + np.arange(bands, dtype=np.uint64))
    bit = (tx.mix(sample + np.arange(bands * rows, dtype=np.uint64)) % np.uint64(SKETCH_BITS)).astype(np.int64)
    odd = np.zeros((n, SKETCH_BITS), np.uint8)
    np.add.at(odd, (np.repeat(np.arange(n), bands * rows), bit.ravel()), 1)
    return keys, np.packbits(odd & 1, axis=1, bitorder="little").view("<u8").reshape(n, SKETCH_BITS // 64)


def parities(shingles: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The level of each non-empty set, and the parities of its shingles whose hash the level lets in."""
    level = np.maximum(np.ceil(np.log2(size / FOLD)), 0).astype(np.int64)
    row = np.repeat(np.arange(len(size)), size)
    h = tx.mix(shingles ^ np.uint64(0xBEEF))
    taken = (h >> np.uint64(32)) < (np.uint64(1 << 32) >> level[row].astype(np.uint64))
    odd = np.zeros((len(size), PARITY_BITS), np.uint8)
    np.add.at(odd, (row[taken], (h[taken] % np.uint64(PARITY_BITS)).astype(np.int64)), 1)
    return level, np.packbits(odd & 1, axis=1, bitorder="little").view("<u8").reshape(len(size), PARITY_BITS // 64)


def most_differing_bits(similarity: float, samples: int) -> int:
    """How many bits may differ before a pair is dropped: five standard deviations beyond what
    ``similarity`` gives. Each of the differing samples flips up to two bits, less what falls together."""
    expected = samples * (1 - similarity)
    high = min(samples, expected + 5 * (expected * similarity) ** 0.5 + 1)
    return int(np.ceil(SKETCH_BITS / 2 * (1 - np.exp(-4 * high / SKETCH_BITS)) + 2 * SKETCH_BITS**0.5 * 0.5))


CLASS = ["n_shingles", "class_a", "class_b"]


def digest(text):
    return F.unhex(F.sha2(F.coalesce(text.cast("string"), F.lit("")), 256))


def grouped(docs: DataFrame, words: int = 5, percent: int = 80, bands: int = 30, rows: int = 6, block: int = 2048, salt_size: int = 256) -> tuple[DataFrame, DataFrame]:
    """Every row as doc_id, mark (its text's digest) and ``CLASS``; and for each class its least doc_id, its first (doc_id, mark) and its component's number."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest(F.col("text")).alias("mark"), "text")
    fits = most_differing_bits(percent / 100, bands * rows)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tx.slices(batch):
                shingles, begin = shingle_sets(part.column("text"), words)
                size = np.diff(begin)
                some = np.flatnonzero(size)
                ends = np.concatenate([[0], np.cumsum(size[some])])
                none = np.zeros((0, 1), np.uint64)
                keys, odd = signatures(shingles, ends, bands, rows) if len(some) else (none, none)
                level, parity = parities(shingles, size[some]) if len(some) else (np.zeros(0, np.int64), none)
                total = [np.concatenate([[np.uint64(0)], np.cumsum(tx.mix(shingles ^ seed))]) for seed in (np.uint64(0x51), np.uint64(0xA7F1))]
                class_a, class_b = ((t[begin[1:]] - t[begin[:-1]]).view(np.int64) for t in total)
                at = np.zeros(part.num_rows, np.int64)
                at[some] = np.arange(len(some))
                where = [at[i] if size[i] else None for i in range(part.num_rows)]
                lists = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.view(np.int64).ravel())).take(pa.array(where, pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("mark"), pa.array(size), pa.array(class_a), pa.array(class_b), lists(keys), lists(odd), pa.array(np.append(level, 0)[at]), lists(parity)], names=["doc_id", "mark", *CLASS, "keys", "odd", "level", "parity"])

    described = stored(map_texts(texts, describe, "doc_id long, mark binary, n_shingles long, class_a long, class_b long, keys array<long>, odd array<long>, level long, parity array<long>"))
    about = ["n_shingles", "level", "odd", "parity"]
    signed = ["keys", *about[1:]]
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "mark", *signed)).alias("row")
    reps = described.where("n_shingles > 0").groupBy(*CLASS).agg(F.min("doc_id").alias("least"), first)
    its_first = F.struct("row.no_id", "row.doc_id", "row.mark").alias("first")
    reps = stored(reps.select(F.monotonically_increasing_id().alias("rep"), *CLASS, "least", its_first, *[f"row.{c}" for c in signed]))
    rows = stored(described.select("doc_id", "mark", *CLASS))
    discard(described)
    classes = stored(reps.select("rep", *CLASS, "least", "first"))

    buckets = reps.select("rep", F.explode("keys").alias("bucket"))
    heads = buckets.groupBy("bucket").agg(F.min("rep").alias("head"), F.count(F.lit(1)).alias("members")).where("members > 1")
    filled = stored(buckets.join(heads, "bucket"))
    # what later steps read of classes that share a band with another
    told = reps.select("rep", F.col("first.doc_id").alias("first_id"), F.col("first.mark").alias("first_mark"), *about)
    shared = stored(told.join(filled.select("rep").distinct(), "rep"))
    discard(reps)
    sketch = shared.select("rep", *about)
    side = lambda x: sketch.select(F.col("rep").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in about])
    apart = lambda c, n: sum((F.bit_count(F.col(f"{c}_a")[i].bitwiseXOR(F.col(f"{c}_b")[i])) for i in range(n // 64)), F.lit(0))
    most = (F.col("n_shingles_a") + F.col("n_shingles_b")) * F.lit((100 - percent) / (100 + percent))
    expected = most / F.pow(F.lit(2.0), F.col("level_a"))
    room = F.when(F.col("level_a") == 0, most).otherwise(expected + 5 * F.sqrt(expected) + 5)
    likely = (apart("odd", SKETCH_BITS) <= fits) & ((F.col("level_a") != F.col("level_b")) | (apart("parity", PARITY_BITS) <= room + F.lit(1e-6)))

    def similar(pairs: DataFrame) -> DataFrame:
        """Pairs a, b whose sketches are near enough."""
        return pairs.join(side("b"), "b").join(side("a"), "a").where(likely).select("a", "b")

    stars = stored(similar(filled.where("rep <> head").select(F.col("head").alias("a"), F.col("rep").alias("b")).distinct()))
    # full sets, once, of classes that share a band with another
    wanted = shared.select("rep", "first_id", "first_mark")
    its_text = (F.col("mark") == F.col("first_mark")) & F.col("doc_id").eqNullSafe(F.col("first_id"))

    def as_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # repeated rows give one set for each task
        for batch in batches:
            fresh = [not (r in seen or seen.add(r)) for r in batch.column("rep").to_pylist()]
            for part in tx.slices(batch.filter(pa.array(fresh, pa.bool_()))):
                shingles, begin = shingle_sets(part.column("text"), words)
                yield pa.RecordBatch.from_arrays([part.column("rep"), pa.LargeBinaryArray.from_buffers(pa.large_binary(), part.num_rows, [None, pa.py_buffer((begin * 8).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(shingles))]).cast(pa.binary())], names=["rep", "shingles"])

    near = among(texts, ["doc_id", "mark"], wanted.select("first_id", "first_mark"))
    sets = stored(map_texts(near.join(wanted, its_text).select("rep", "text"), as_sets, "rep long, shingles binary"))

    def confirmed(pairs: DataFrame) -> DataFrame:
        """Pairs whose full sets meet the bound. Each group is one a (or a salt of it): its set comes
        first, then those of its partners, so a task holds one set and one batch."""
        counts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / salt_size).cast("int").alias("salts"))
        heads = counts.join(sets.withColumnRenamed("rep", "a"), "a").select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(None).cast("long").alias("b"), "shingles")
        others = pairs.join(sets.withColumnRenamed("rep", "b"), "b").join(counts, "a").select("a", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"), "b", "shingles")

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            group, mine = None, np.zeros(0, np.uint64)
            for batch in batches:
                out = []
                for a, salt, b, blob in zip(*(c.to_pylist() for c in batch.columns)):
                    theirs = np.frombuffer(blob, np.uint64)
                    if b is None:
                        group, mine = (a, salt), theirs
                        continue
                    assert group == (a, salt)
                    both = np.concatenate([mine, theirs])
                    both.sort(kind="stable")
                    shared = int((both[1:] == both[:-1]).sum())
                    if 100 * shared >= percent * (len(both) - shared):
                        out.append((a, b))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out) if out else ([], []))], names=["a", "b"])

        dealt = heads.unionByName(others).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
        return map_texts(dealt, compare, "a long, b long")

    links = stored(confirmed(stars))
    parts = connected_components(links)

    # pairs of one bucket that stars left apart
    tables, tested, limit = [shared, filled, stars, sets, links], stars, 2
    while True:
        named = partners(filled.where("members > 2"), parts, sketch, limit, block, fits, percent)
        fresh = stored(named.select("a", "b").distinct().join(tested, ["a", "b"], "left_anti"))
        more = named.where("more").limit(1).count() > 0
        discard(named)
        if fresh.limit(1).count():
            towards = parts.select(F.col("node").alias("a"), F.col("component").alias("b"))
            joined = stored(towards.union(confirmed(fresh)))
            before, parts = parts, connected_components(joined)
            discard(joined, before)
            tested = tested.union(fresh)
        tables.append(fresh)
        if not more:
            break
        limit *= 4
    discard(*tables)
    numbered = classes.join(parts.select(F.col("node").alias("rep"), "component"), "rep", "left")
    return rows, numbered.select(*CLASS, "least", "first", F.coalesce("component", "rep").alias("component"))


def near_dedup(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept. Links: 100 * shared >= percent * union."""
    described, classes = grouped(docs, **options)
    least = classes.groupBy("component").agg(F.min("least").alias("component_id"))
    named = classes.join(least, "component").select(*CLASS, "component_id")
    full = described.where("n_shingles > 0").join(named, CLASS).select("doc_id", "n_shingles", "component_id")
    bare = described.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return full.unionByName(bare).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def partners(filled: DataFrame, parts: DataFrame, sketch: DataFrame, limit: int, block: int, fits: int, percent: int) -> DataFrame:
    """For members outside their bucket's main component: their ``limit`` likeliest partners in other
    components (a < b), and whether a member has more than that."""
    grouped = filled.join(parts.select(F.col("node").alias("rep"), "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    split = grouped.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
    members = stored(grouped.join(split.select("bucket"), "bucket", "left_semi"))
    shares = members.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("n"))
    main = shares.groupBy("bucket").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.sum("n").alias("all"), F.max("n").alias("most"))
    # a step is a little less than the ratio of sizes that the similarity allows, so partners are at most one step apart
    step = F.floor(F.ln("n_shingles") / F.lit(-math.log(percent / 100 * 0.999))).cast("int")
    sized = stored(members.join(main, "bucket").join(sketch, "rep").withColumn("step", step))  # three times read below
    blocks = F.greatest(F.ceil(F.col("all") / block), F.lit(1)).cast("int")
    minor_blocks = F.greatest(F.ceil((F.col("all") - F.col("most")) / block), F.lit(1)).cast("int")
    given = ["bucket", "rep", "component", "head", "n_shingles", "level", "odd", "parity"]
    own, all_blocks, all_minor = F.pmod(F.xxhash64("rep"), blocks).cast("int"), F.explode(F.sequence(F.lit(0), blocks - 1)), F.explode(F.sequence(F.lit(0), minor_blocks - 1))
    around = sized.withColumn("step", F.explode(F.array(F.col("step") - 1, F.col("step"), F.col("step") + 1)))
    minor = sized.where("component <> main")
    around = around.join(minor.select("bucket", "step").distinct(), ["bucket", "step"], "left_semi")
    left = around.select(*given, "step", F.lit(0).alias("side"), own.alias("i"), all_minor.alias("j"))
    right = minor.select(*given, "step", F.lit(1).alias("side"), all_blocks.alias("i"), F.pmod(F.xxhash64("rep"), minor_blocks).cast("int").alias("j"))

    def cross(table: pa.Table) -> pa.Table:
        side, rep, comp, head, size, level = (table[c].to_numpy() for c in ("side", "rep", "component", "head", "n_shingles", "level"))
        odd, parity = (table[c].combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(rep), -1) for c in ("odd", "parity"))
        here, a, b, over = np.flatnonzero(side == 0), [], [], []
        for k in np.flatnonzero((side == 1) & (rep != head)).tolist():
            near = here[(comp[here] != comp[k]) & (rep[here] != head[k])]
            near = near[np.bitwise_count(odd[near] ^ odd[k]).sum(axis=1, dtype=np.int64) <= fits]
            bits = np.bitwise_count(parity[near] ^ parity[k]).sum(axis=1, dtype=np.int64)
            most = (size[near] + size[k]) * ((100 - percent) / (100 + percent))
            expected = most / 2.0 ** level[k]
            room = np.where(level[k] == 0, most, expected + 5 * np.sqrt(expected) + 5) + 1e-6
            fair = (level[near] != level[k]) | (bits <= room)
            near, share = near[fair], np.where(level[near] == level[k], bits / room, 1.0)[fair]
            chosen = near[np.argsort(share, kind="stable")[:limit]]
            a.append(np.minimum(rep[chosen], rep[k]))
            b.append(np.maximum(rep[chosen], rep[k]))
            over.append(np.full(len(chosen), len(near) > limit))
        flat = lambda x, kind: pa.array(np.concatenate(x) if x else np.zeros(0), kind)
        return pa.table([flat(a, pa.int64()), flat(b, pa.int64()), flat(over, pa.bool_())], names=["a", "b", "more"])

    named = stored(left.unionByName(right).groupBy("bucket", "step", "i", "j").applyInArrow(cross, "a long, b long, more boolean"))
    discard(members, sized)
    return named


def deduplicate(docs: DataFrame, **options) -> DataFrame:
    """The documents that stay, one of each group, all columns: the row with the smallest doc_id, nulls last, then the smallest text digest.

    Rows are known by doc_id and text, so texts that share an id, or have none, keep their own place. Whole rows are shuffled once.
    """
    described, classes = grouped(docs, **options)
    winners = classes.groupBy("component").agg(F.min("first").alias("first")).select("first.doc_id", "first.mark")
    winners = winners.union(described.where("n_shingles = 0").select("doc_id", "mark").distinct())
    kept = winners.select(*[v.alias(k) for k, v in places(F.col("doc_id"), F.col("mark")).items()])
    rows = packed(docs, **places(F.col("doc_id"), digest(F.col("text"))))
    return rows.join(kept, kept.columns, "left_semi").dropDuplicates(kept.columns).select("row.*")
