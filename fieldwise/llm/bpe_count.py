"""Token counts by heap-and-linked-list byte-pair merging, without making ids.

A text is split as the vocabulary's byte-level pre-tokenizer splits it. In each piece the
lowest-ranked adjacent pair is popped from a heap until none is left; the count is the number of
initial symbols less the number of merges. Special strings in a text are one token each, as the
library has it by default. Other settings of a vocabulary than these raise. Counts of pieces are memoised in each worker, at most ``MEMO`` of them.

The merge list is read on the driver and sent to tasks once; its size is that of the vocabulary.
Nothing is shuffled. Defined cases: null and empty texts have 0 bytes and 0 tokens.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The pre-tokenizer's pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MEMO = 1_000_000


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable ones stand for themselves."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in keep else chr(next(spare)) for b in range(256)]


def load(path: str) -> tuple[list[tuple[bytes, bytes]], list[str]]:
    """Merges as pairs of byte strings in rank order, and special strings."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    pre, kind = model["pre_tokenizer"] or {}, model["model"]
    plain = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not model.get("normalizer")
    flags = any(t[k] for t in model["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized"))
    if not plain or flags or kind["type"] != "BPE" or any(kind.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
        raise ValueError("not a byte-level vocabulary with the plain pre-tokenizer and special strings as they stand")
    back = {s: b for b, s in enumerate(byte_symbols())}
    pairs = [m if isinstance(m, list) else m.split(" ") for m in model["model"]["merges"]]
    return [tuple(bytes(back[c] for c in side) for side in pair) for pair in pairs], [t["content"] for t in model["added_tokens"]]


def count_merges(piece: bytes, ranks: dict[tuple[bytes, bytes], int]) -> int:
    """Tokens of one piece: symbols less merges. A popped pair is stale unless both its symbols still stand."""
    n = len(piece)
    if n < 2:
        return n
    symbol: list[bytes | None] = [piece[i : i + 1] for i in range(n)]
    nxt, prv = [*range(1, n), -1], [*range(-1, n - 1)]
    heap = [(r, i, symbol[i], symbol[i + 1]) for i in range(n - 1) if (r := ranks.get((symbol[i], symbol[i + 1]))) is not None]
    heapify(heap)
    merges = 0
    while heap:
        _, i, a, b = heappop(heap)
        j = nxt[i]
        if symbol[i] != a or j < 0 or symbol[j] != b:
            continue
        merges += 1
        made = symbol[i] = a + b
        symbol[j] = None
        k = nxt[i] = nxt[j]
        if k >= 0:
            prv[k] = i
            if (r := ranks.get((made, symbol[k]))) is not None:
                heappush(heap, (r, i, made, symbol[k]))
        h = prv[i]
        if h >= 0 and (r := ranks.get((symbol[h], made))) is not None:
            heappush(heap, (r, h, symbol[h], made))
    return n - merges


class Memo(dict):
    """Counts of words by word, each read with ``before`` in front; forgets all when full."""

    def __init__(self, count, before: str):
        super().__init__()
        self.count, self.before = count, before

    def __missing__(self, word: str) -> int:
        n = self.count(self.before + word)
        if len(word) <= 64:
            if len(self) >= MEMO:
                self.clear()
            self[word] = n
        return n


class Counter:
    def __init__(self, merges, specials):
        self.ranks = {m: i for i, m in reversed(list(enumerate(merges)))}
        self.split = regex.compile(PATTERN).findall
        self.special = regex.compile("|".join(regex.escape(s) for s in sorted(specials, key=len, reverse=True))) if specials else None
        self.marks = [s[:2] for s in specials]
        self.pieces = Memo(lambda piece: count_merges(piece.encode(), self.ranks), "")
        self.first, self.later = Memo(self.by_pieces, ""), Memo(self.by_pieces, " ")

    def by_pieces(self, text: str) -> int:
        return sum(map(self.pieces.__getitem__, self.split(text)))

    def plain(self, text: str) -> int:
        """A text without special strings.

        Where all white space is single blanks and line feeds between words, no piece spans two
        words, and a word's count depends only on whether a blank stands before it. Joining the
        words with single blanks gives the text back just then, since ``split`` knows all white space.
        """
        if " ".join(text.split()) != text.replace("\n", " "):
            return self.by_pieces(text)
        lines = text.split("\n")
        total, later = len(lines) - 1, self.later.__getitem__
        for line in lines:
            words = line.split(" ")
            total += self.first[words[0]] + sum(map(later, words[1:]))
        return total

    def __call__(self, text: str) -> int:
        if not any(m in text for m in self.marks) or len(parts := self.special.split(text)) < 2:
            return self.plain(text) if text else 0
        return len(parts) - 1 + sum(self.plain(p) for p in parts if p)


_workers: dict[int, Counter] = {}  # by broadcast, kept while a Python worker lives


def bpe_count(docs: DataFrame, vocabulary: str, limit: int = 512) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit."""
    shared = docs.sparkSession.sparkContext.broadcast(load(vocabulary))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from fieldwise.llm import bpe_count as here

        key = hash(vocabulary)
        if key not in here._workers:
            here._workers[key] = Counter(*shared.value)
        tokens = here._workers[key]
        for batch in batches:
            texts = pc.fill_null(batch.column("text"), "")
            counts = [tokens(t.as_py()) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pc.binary_length(texts).cast(pa.int64()), pa.array(counts, pa.int64()), pa.array([c > limit for c in counts], pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
