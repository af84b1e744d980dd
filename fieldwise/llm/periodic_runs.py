"""Periodic runs of words: recursive frequency splitting, then a scan of lags in what survives.

A run is a stretch of consecutive words in which words ``q`` apart are identical, ``q`` being its smallest period, of
``max(12, 2 * q)`` words or more, that no neighbour extends. So each word of a run occurs twice or more in it. A word that
occurs once in its segment joins no run there and splits the segment; pieces under 12 words hold no run and go. Counts are
taken anew in the pieces until nothing changes. All texts of a slice are split together, each beginning as one segment.

What survives is scanned by lag. Up to lag 11 all words are compared with those ``q`` further on. From lag 12, words that
match their counterpart fill ``q`` places or more in a row, so one of them stands at a multiple of ``q`` and is alike over
seven words on one side at least: only those places are looked at, about m * ln(m) / 12 for m words in all, then extended word by word.

Words are numbered by a dictionary, so that equal numbers are equal words. One pass, nothing is shuffled; a slice of texts is
held at a time, and one text is a single value. Defined cases: null and empty texts have no words and no run; a null doc_id
has null in place of its hash, and its text stays as it is; documents that repeat, and columns besides doc_id and text, change nothing.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldwise.llm.text import mix, slices

LEAST = 12
#: Places that are compared at once.
AT_ONCE = 1 << 20
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def planted(words: list, doc_id: int | None) -> list:
    """The words with a tail that repeats, in a tenth of all documents, as the hash of the id says."""
    h = 1 if doc_id is None else crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    tail = words[a : a + p]
    return words[:a] + (tail * ((n - a) // p + 1))[: n - a]


def surviving(ids: np.ndarray, starts: np.ndarray) -> list[tuple[int, int]]:
    """Bounds of the stretches left by splitting; ``starts`` are the first words of texts."""
    at = np.arange(len(ids))
    segment = np.searchsorted(starts, at, "right") - 1
    total = int(ids.max(initial=0)) + 1
    while len(at):
        _, where, count = np.unique(segment * total + ids[at], return_inverse=True, return_counts=True)
        left = count[where] >= 2
        at, old = at[left], segment[left]
        if not len(at):
            break
        cut = np.append(True, (np.diff(at) != 1) | (np.diff(old) != 0))
        number = np.cumsum(cut) - 1
        long = np.bincount(number)[number] >= LEAST
        if left.all() and long.all():
            edges = np.append(np.flatnonzero(cut), len(at))
            return [(int(at[x]), int(at[y - 1]) + 1) for x, y in zip(edges[:-1], edges[1:])]
        at, segment = at[long], number[long]
    return []


def stretches(same: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Bounds of ``least`` or more true values in a row."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], same, [False]]).astype(np.int8)))
    begin, end = edge[::2], edge[1::2]
    long = end - begin >= least
    return list(zip(begin[long].tolist(), end[long].tolist()))


def reach(a: np.ndarray, b: np.ndarray) -> int:
    """How many words at the front are alike, looked at in blocks that double."""
    n, at, step = min(len(a), len(b)), 0, 64
    while at < n:
        other = np.flatnonzero(a[at : at + step] != b[at : at + step][: len(a[at : at + step])])
        if len(other):
            return at + int(other[0])
        at, step = at + step, step * 2
    return n


def lags(marks: np.ndarray, most: int) -> Iterable[int]:
    """Lags from ``LEAST`` to ``most`` at which some mark recurs, or all of them where listing the pairs is the dearer way."""
    order = np.argsort(marks, kind="stable")
    ranked, found = marks[order], []
    same = ranked[1:] == ranked[:-1]
    group = np.diff(np.flatnonzero(np.concatenate([[True], ~same, [True]])))
    if (group * (group - 1)).sum() > 4 * len(marks):
        return range(LEAST, most + 1)
    for d in range(1, int(group.max(initial=1))):
        found.append((order[d:] - order[:-d])[ranked[d:] == ranked[:-d]])
    lag = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    return lag[(lag >= LEAST) & (lag <= most)].tolist()


def lag_scan(w: np.ndarray) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) of one segment, lags ascending."""
    m, seen, out = len(w), set(), []

    def take(begin: int, end: int, q: int) -> None:
        if (begin, end + q) not in seen:  # else it has a smaller period, whose run has the same bounds
            seen.add((begin, end + q))
            out.append((begin, end + q - begin, q))

    for q in range(1, min(LEAST, m // 2 + 1)):
        for begin, end in stretches(w[:-q] == w[q:], max(LEAST, 2 * q) - q):
            take(begin, end, q)
    if m < 2 * LEAST:
        return out
    seven = np.zeros(m, np.uint64)  # marks of seven words from each place on; a mark that fails rules out, one that holds is looked at
    spread = mix(w.astype(np.uint64) + np.uint64(1))
    for j in range(7):
        seven[: m - j] += spread[j:] * np.uint64(2 * j + 3)
    back = np.zeros(m, np.uint64)  # those of the seven words that end at a place
    back[6:] = seven[: m - 6]
    lag = np.asarray(lags(seven, m // 2), np.int64)
    places = (m - 1) // lag  # multiples of each lag that have a counterpart
    for some in np.split(lag, np.flatnonzero(np.diff(np.cumsum(places) // AT_ONCE)) + 1) if len(lag) else []:
        many = (m - 1) // some
        q_of = np.repeat(some, many)
        at = (np.arange(len(q_of)) - np.repeat(np.cumsum(many) - many, many)) * q_of
        near = (seven[at] == seven[at + q_of]) | ((at >= 6) & (back[at] == back[at + q_of]))
        done, last = -1, 0
        for i, q in zip(at[near].tolist(), q_of[near].tolist()):
            if q != last:
                done, last = -1, q
            if i < done or w[i] != w[i + q]:
                continue
            end = i + reach(w[i : m - q], w[i + q :])
            begin = i - reach(w[:i][::-1], w[q : i + q][::-1])
            done = end
            if end - begin >= q:
                take(begin, end, q)
    return out


class Numbers(dict):
    """A number for each word met."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def runs_of(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """The runs (start, length, period) of each text, by start, then period."""
    number = Numbers().__getitem__
    ids = np.concatenate([np.zeros(0, np.int64), *[np.fromiter(map(number, words), np.int64, len(words)) for words in texts]])
    starts = np.cumsum([0, *map(len, texts)])
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for x, y in surviving(ids, starts[:-1]):
        t = int(np.searchsorted(starts, x, "right")) - 1
        found[t] += [(x - int(starts[t]) + s, length, q) for s, length, q in lag_scan(ids[x:y])]
    return [sorted(r, key=lambda v: (v[0], v[2])) for r in found]


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run holds after its first period, joined by blanks."""
    if not runs:
        return b" ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    for s, length, q in runs:
        change[s + q] += 1
        change[s + length] -= 1
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(change)[:-1] == 0).tolist()])


def periodic_runs(docs: DataFrame, plant: bool = False) -> DataFrame:
    """One row per document: doc_id, n_runs, the longest run, digests of all runs and of the collapsed text.
    With ``plant``, words of a tenth of the documents are made to repeat first."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                names = part.column("doc_id").to_pylist()
                texts = [WORD.findall(t.encode()) if t else [] for t in part.column("text").to_pylist()]
                if plant:
                    texts = [planted(words, name) for words, name in zip(texts, names)]
                rows = []
                for name, words, runs in zip(names, texts, runs_of(texts)):
                    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
                    told = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
                    listed = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
                    rows.append((name, len(runs), *told, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(collapsed(words, runs)).hexdigest()))
                kinds = [pa.int64()] * 6 + [pa.string()] * 2
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[c.split()[0] for c in SCHEMA.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(look, SCHEMA)
