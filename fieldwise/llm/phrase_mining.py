"""Phrases of two to five words by Toivonen's method: a sample proposes, full passes count the proposals and their negative border, until closed.

Words of a piece that stand together make a phrase; f is the number of its occurrences in all texts of one language. No phrase occurs oftener
than a part of it, so a phrase can be frequent only if its parts (all words but the last, all but the first) are.

1. A sample of the documents proposes: phrases that occur often enough in it, under a threshold below the sample's share of ``least``,
   so that few frequent ones are missed. Words, then pairs, then longer phrases, each only where the parts were proposed.
2. A pass over all documents counts exactly those phrases whose two parts are proposed, and all words: the proposals, by their text, and their
   negative border as far as it occurs, by hashes of 48 bits. Where hashes meet the border's counts are too high, never too low.
3. A border phrase with ``least`` occurrences was missed. A further pass counts these by their text, and all phrases that hold one and were not
   counted. That closes the search, whatever the sample held: a frequent phrase that the first pass did not count has a shortest part that is not
   proposed, and the parts of that part are, so it is of the border and was missed. Without missed ones there is no further pass.

Proposals are kept as the bits of a Bloom filter, whose size follows from their number up to ``MOST_BITS`` (128 MB), so what
tasks get is bounded. A false positive counts as proposed in both passes alike: more is counted, nothing is lost. Counts that are returned are exact: tasks number words by a
dictionary, count phrases of a slice by numbers, and Spark sums them by the phrases' text. Slices follow ``SLICE`` bytes of text,
and a long text is cut between pieces. Tables that later passes read are written to the shared folder.

Defined cases: null texts are empty and have no words; null languages are ``und``; documents that repeat count as often as they stand there; ids and further columns are
not read, apart from the sample's hash; no documents, or nothing frequent, give no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldwise.llm.common import discard, drawn, stored
from fieldwise.llm.text import mix

LONGEST = 5
#: Bits of a hash that are kept.
SEEN = np.uint64((1 << 48) - 1)
#: The share of documents that proposes, and the proposals' threshold as a part of what a phrase at the bound is expected to have there.
SHARE, LOWERED = 0.125, 0.45
LEAST_BITS, MOST_BITS, PARTS = 1 << 20, 1 << 30, 256
SLICE = 6 << 20
#: Phrases that are written out at once.
AT_ONCE = 50_000
#: Salts of the ranking: a language may hold most phrases.
SALTS = 32
#: Languages whose numbers of words are sent to all tasks; more are joined.
MOST_LANGS = 100_000
_FOLD = bytes(97 + b - 65 if 65 <= b <= 90 else 10 if b in b".,;:!?\x0a\x0b\x0c\x0d" else 32 if b == 9 else b for b in range(256))
_STEP = [np.uint64(0x9E3779B97F4A7C15 + 2 * 0x51ED27 * k) for k in range(LONGEST)]


class Bits:
    """A Bloom filter over 64-bit hashes; two bits for each."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.mask = bits, np.uint64(len(bits) * 8 - 1)

    @staticmethod
    def places(h: np.ndarray, mask: np.uint64) -> tuple[np.ndarray, np.ndarray]:
        return (h & mask).astype(np.int64), (mix(h) & mask).astype(np.int64)

    def has(self, h: np.ndarray) -> np.ndarray:
        one, two = self.places(h, self.mask)
        return ((self.bits[one >> 3] >> (one & 7).astype(np.uint8)) & (self.bits[two >> 3] >> (two & 7).astype(np.uint8)) & 1).astype(bool)


def hash_of(words: list[np.ndarray]) -> np.ndarray:
    """The hash, of 48 bits, of phrases from those of their words, place by place."""
    if len(words) == 1:
        return words[0]
    total = np.zeros(len(words[0]), np.uint64)
    for k, h in enumerate(words):
        total += mix(h + _STEP[k])
    return mix(total) & SEEN


def word_hash(key: bytes) -> int:
    return xxhash.xxh64_intdigest(key)


def hashes(keys: list[str]) -> np.ndarray:
    """The hash of each key ``language LF phrase``."""
    out = np.zeros(len(keys), np.uint64)
    known: dict[str, int] = {}
    at: dict[int, list[int]] = {}
    words: dict[int, list[list[int]]] = {}
    for i, key in enumerate(keys):
        lang, _, phrase = key.rpartition("\n")
        row = []
        for word in phrase.split(" "):
            name = f"{lang}\n{word}"
            if name not in known:
                known[name] = word_hash(name.encode())
            row.append(known[name] & int(SEEN))
        at.setdefault(len(row), []).append(i)
        words.setdefault(len(row), []).append(row)
    for k, rows in words.items():
        out[at[k]] = hash_of(list(np.array(rows, np.uint64).T))
    return out


class Words(dict):
    """Numbers from 1 of the words of one language in a slice; 0 ends a piece, -1 is no word."""

    def __init__(self, lang: str, keys: list[bytes]):
        super().__init__({b"\n": 0, b"": -1})
        self.front, self.keys = lang.encode() + b"\n", keys

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self.keys)
        self.keys.append(self.front + word)
        return n


class Slice:
    """The words of some texts as numbers, and counts of their phrases."""

    def __init__(self):
        self.keys: list[bytes] = [b""]
        self.langs: dict[str, Words] = {}
        self.parts: list[np.ndarray] = []

    def add(self, text: bytes, lang: str) -> None:
        if lang not in self.langs:
            self.langs[lang] = Words(lang, self.keys)
        found = text.translate(_FOLD).replace(b"\n", b" \n ").split(b" ")
        self.parts += [np.fromiter(map(self.langs[lang].__getitem__, found), np.int32, len(found)), np.zeros(1, np.int32)]

    def count(self, proposed: Bits | None, failed: Bits | None, lengths: Iterable[int], sample: bool) -> Iterator[tuple]:
        """Pairs of keys and counts, or of hashes and counts, of phrases of each length.

        In a sample: of phrases whose parts are proposed, parts of three words or more counting as such. Else, without ``failed``, of phrases whose parts are proposed: those
        that are proposed themselves by key, the border by hash; and under a key without words how many each language has. With ``failed``: of those of the
        border that are in it, and of phrases that were not counted and hold one of it.
        """
        ids = np.concatenate(self.parts)
        ids = ids[ids >= 0]
        keys, n = self.keys, len(ids)
        size, longest = np.int64(len(keys)), max(lengths)
        h = np.fromiter(map(word_hash, keys), np.uint64, len(keys)) & SEEN
        asked = proposed.has(h) if proposed else np.full(len(keys), sample)
        missed = ~asked & failed.has(h) if failed else np.zeros(len(keys), bool)
        asked[0] = missed[0] = False
        if 1 in lengths:
            counts = np.bincount(ids, minlength=len(keys))
            told, border = np.flatnonzero(missed if failed else asked), np.flatnonzero(~asked[1:]) + 1
            yield [keys[i] for i in told.tolist()], counts[told]
            if not failed and not sample:
                yield h[border], counts[border]
                total = {w.front: 0 for w in self.langs.values()}
                for key, c in zip(keys[1:], counts[1:].tolist()):
                    total[key[: key.rindex(b"\n") + 1]] += c
                yield list(total), np.array(list(total.values()))
        if longest < 2 or not n:
            return
        at = np.flatnonzero((asked | missed)[ids])
        # of each phrase that is looked at: its place and number, whether it is proposed, and whether it holds a failed one
        code, known, holds = ids[at].astype(np.int64), asked[ids[at]], missed[ids[at]]
        for k in range(2, longest + 1):
            i = np.flatnonzero(np.diff(at) == 1)
            parts, hot = known[i] & known[i + 1], holds[i] | holds[i + 1]
            at, number = at[i], code[i] * size + ids[at[i] + k - 1]
            if not len(at):
                return
            mark = hash_of([h[ids[at + j]] for j in range(k)])
            known = parts & proposed.has(mark) if not sample or k < 3 else parts
            lost = parts & ~known & failed.has(mark) if failed else np.zeros(len(at), bool)
            if k in lengths:
                wanted = lost | (hot & ~parts) if failed else parts if sample else known
                yield from self.told(number[wanted], at[wanted], ids, k)
                if not failed and not sample:
                    yield np.unique(mark[parts & ~known], return_counts=True)
            holds = hot | lost
            left = known | holds
            at, known, holds = at[left], known[left], holds[left]
            _, code = np.unique(number[left], return_inverse=True)

    def told(self, code: np.ndarray, at: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple[list[bytes], np.ndarray]]:
        _, first, counts = np.unique(code, return_index=True, return_counts=True)
        keys = self.keys
        for a in range(0, len(first), AT_ONCE):
            rows = [ids[at[first[a : a + AT_ONCE]] + j].tolist() for j in range(k)]
            words = [[keys[i].rsplit(b"\n", 1)[1] for i in row] for row in rows[1:]]
            yield [b" ".join((keys[i], *rest)) for i, *rest in zip(rows[0], *words)], counts[a : a + AT_ONCE]


def counted(docs: DataFrame, proposed: np.ndarray | None, failed: np.ndarray | None, lengths: tuple[int, ...], sample: bool = False) -> DataFrame:
    """Key, h and n of phrases of the given lengths over all rows of ``docs`` (text, lang), by key or, with an empty key, by hash; see ``Slice.count``."""
    shared = docs.sparkSession.sparkContext.broadcast((proposed, failed))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, missed = (Bits(b) if b is not None else None for b in shared.value)
        part, held = Slice(), 0

        def rows() -> Iterator[pa.RecordBatch]:
            for keys, counts in part.count(asked, missed, lengths, sample):
                for a in range(0, len(keys), AT_ONCE):
                    own, number = keys[a : a + AT_ONCE], pa.array(counts[a : a + AT_ONCE], pa.int64())
                    if isinstance(own, list):
                        named = [pa.array(own, pa.binary()).cast(pa.string()), pa.array(np.zeros(len(own), np.int64))]
                    else:
                        named = [pa.array([""] * len(own)), pa.array(own.astype(np.int64))]
                    yield pa.RecordBatch.from_arrays([*named, number], names=["key", "h", "n"])

        for batch in batches:
            for text, lang in zip(batch.column("text"), batch.column("lang")):
                if not text.is_valid:
                    continue
                data, lang = text.as_buffer().to_pybytes(), lang.as_py() if lang.is_valid else "und"
                for piece in pieces_of(data):
                    part.add(piece, lang)
                    held += len(piece)
                    if held >= SLICE:
                        yield from rows()
                        part, held = Slice(), 0
        if held:
            yield from rows()

    return docs.select("text", F.col("lang").cast("string").alias("lang")).mapInArrow(run, "key string, h long, n long").groupBy("key", "h").agg(F.sum("n").alias("n"))


def pieces_of(text: bytes) -> Iterator[bytes]:
    """A text in parts of about ``SLICE`` bytes, cut where a piece ends."""
    begin = 0
    while len(text) - begin > SLICE:
        ends = [i for i in (text.find(bytes([b]), begin + SLICE) for b in b".,;:!?\n\x0b\x0c\r") if i >= 0]
        if not ends:
            break
        yield text[begin : min(ends) + 1]
        begin = min(ends) + 1
    yield text[begin:]


def filter_of(keys: DataFrame, size: int | None = None, also: np.ndarray | None = None) -> np.ndarray:
    """The filter's bits with the hashes of keys, or those in ``h`` where a key is empty, made part by part in tasks. ``also`` is a filter to add to."""
    bits = size or (len(also) * 8 if also is not None else LEAST_BITS)
    width = bits // 8 // PARTS
    place_mask = np.uint64(bits - 1)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = batch.column("h").to_numpy().astype(np.uint64)
            one, two = Bits.places(np.where(given > 0, given, hashes(batch.column("key").to_pylist())), place_mask)
            both = np.unique(np.concatenate([one, two]))
            yield pa.RecordBatch.from_arrays([pa.array(both // (width * 8)).cast(pa.int32()), pa.array(both)], names=["part", "place"])

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, np.ndarray] = {}
        for batch in batches:
            part, place = (c.to_numpy() for c in batch.columns)
            for p in np.unique(part).tolist():
                own = made.setdefault(p, np.zeros(width, np.uint8))
                at = place[part == p] - p * width * 8
                np.bitwise_or.at(own, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(list(made), pa.int32()), pa.array([b.tobytes() for b in made.values()], pa.binary())], names=["part", "bits"])

    out = also.copy() if also is not None else np.zeros(bits // 8, np.uint8)
    shards = min(PARTS, int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    spread = keys.select("key", "h").mapInArrow(places, "part int, place long").repartition(shards, "part")
    for part, own in spread.mapInArrow(gathered, "part int, bits binary").collect():  # PARTS rows at most, the filter's size in all
        out[part * width : (part + 1) * width] |= np.frombuffer(own, np.uint8)
    return out


def proposals(docs: DataFrame, least: int, share: float) -> np.ndarray:
    """The filter of phrases that are frequent in a sample under the lowered threshold."""
    enough = max(2, int(least * share * LOWERED)) if share < 1 else least
    sample = stored(docs.where(drawn(F.struct("doc_id", "text"), F.lit(share))).select("text", "lang"))
    bits, size, tables = None, LEAST_BITS, []
    for lengths in ((1,), (2,), tuple(range(3, LONGEST + 1))):
        found = stored(counted(sample, bits, None, lengths, True).where(F.col("n") >= enough))
        tables.append(found)
        total = sum(t.count() for t in tables)
        size = min(MOST_BITS, max(LEAST_BITS, 1 << (16 * total).bit_length()))
        if bits is None or size > len(bits) * 8:
            bits = None
            for t in tables:
                bits = filter_of(t, size, bits)
        else:
            bits = filter_of(found, size, bits)
    discard(sample, *tables)
    return bits


def frequent(docs: DataFrame, least: int = 100, share: float = SHARE) -> list[DataFrame]:
    """Tables of key and n, one for each full pass: every phrase of up to ``LONGEST`` words with ``least`` occurrences, and under a key
    without a phrase each language's words."""
    bits, often = proposals(docs, least, share), F.col("n") >= least
    first = stored(counted(docs, bits, None, tuple(range(1, LONGEST + 1))).where(often | F.col("key").endswith("\n")))
    named, failed = first.where("key <> ''").select("key", "n"), first.where("key = ''")
    count = failed.count()
    if not count:
        return [named]
    missed = filter_of(failed, min(MOST_BITS, max(LEAST_BITS, 1 << (16 * count).bit_length())))
    return [named, stored(counted(docs, bits, missed, tuple(range(1, LONGEST + 1))).where(often)).select("key", "n")]


def collocations(docs: DataFrame, least: int = 100, top: int = 2000, share: float = SHARE) -> DataFrame:
    """The best phrases of each language: lang, rank, phrase, a, l, r, n, score.

    A phrase's score is its least over all cuts in two of floor(1000 * a * n / (l * r)); phrases inside a longer one that occurs as often are left out.
    """
    both = reduce(DataFrame.unionByName, frequent(docs, least, share))
    split = both.select(F.regexp_extract("key", r"(?s)^(.*)\n", 1).alias("lang"), F.substring_index("key", "\n", -1).alias("phrase"), F.col("n").cast("decimal(16,0)").alias("f"))
    known, words = split.where("phrase <> ''"), split.where("phrase = ''").select("lang", F.col("f").alias("n"))
    long = known.withColumn("k", F.size(F.split("phrase", " "))).where("k > 1")
    cut = long.select("lang", "phrase", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"), "k")
    sides = cut.withColumns({"left": F.expr("substring_index(phrase, ' ', cut)"), "right": F.expr("substring_index(phrase, ' ', cut - k)")})
    lefts = known.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l"))
    rights = known.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r"))
    few = words.count() <= MOST_LANGS  # one short row each
    placed = sides.join(lefts, ["lang", "left"]).join(rights, ["lang", "right"]).join(F.broadcast(words) if few else words, "lang")
    scored = placed.withColumn("score", F.expr("(CAST(1000 AS decimal(4,0)) * a * n) div (l * r)"))
    best = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "cut", "l", "r", "a", "n")).alias("s")).select("lang", "phrase", "s.*")
    ends = [F.expr("substring_index(phrase, ' ', k - 1)"), F.expr("substring_index(phrase, ' ', 1 - k)")]
    inside = long.where("k > 2").select("lang", F.explode(F.array(*ends)).alias("phrase"), F.col("f").alias("a"))
    alone = best.join(inside, ["lang", "phrase", "a"], "left_anti")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = alone.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    some = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    first = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    number = lambda c: F.col(c).cast("long").alias(c)
    return first.select("lang", number("rank"), "phrase", number("a"), number("l"), number("r"), number("n"), number("score"))
