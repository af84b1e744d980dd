"""Byte-pair encoding and decoding by depth-first traversal of a trie of distinct words.

The encoding of a string less its last token is the encoding of the string without that token's bytes. So the last token of every
prefix tells the whole encoding, and a prefix that many words share needs it once. The distinct pieces of a slice of texts go into a
trie over bytes that a worker keeps; new nodes are visited depth first, and each takes its last token from the nodes above: of
the tokens that end there, the one that stays beside the last token of what is before it, when the two are merged
as the vocabulary says. Ids are read off a word's nodes from its end.

A text is cut into pieces as the vocabulary's pre-tokenizer cuts it; special strings in a text are one token each, as the library has it by
default. Other settings of a vocabulary raise. The vocabulary is read on the driver and sent to tasks once. A trie of more than ``NODES`` nodes is begun anew, and so are full memos; pieces over ``LONG`` bytes are walked
without it, in arrays. Nothing is shuffled, and a slice of texts is held at a time.
Defined cases: null and empty texts have no ids and decode to the empty text; documents that repeat, null ids and further columns change nothing.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldwise.llm import bpe_count
from fieldwise.llm.text import slices

NODES, WORDS, PAIRS, LONG = 500_000, 400_000, 400_000, 512
#: Units of a text whose white space is single blanks and line feeds between words.
UNIT = re.compile(r"\n| ?[^ \n]+")
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def load(path: str) -> tuple[list[tuple[bytes, bytes]], dict[bytes, int], dict[str, int]]:
    """Merges in rank order, the id of each token's bytes, and the ids of special strings."""
    merges, _ = bpe_count.load(path)
    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    back = {s: b for b, s in enumerate(bpe_count.byte_symbols())}
    special = {t["content"]: t["id"] for t in model["added_tokens"]}
    known = {token: i for token, i in model["model"]["vocab"].items() if token not in special}
    return merges, {bytes(back[c] for c in token): i for token, i in known.items()}, special


class Vocabulary:
    """Tokens, and whether two of them stay as they are when they stand side by side."""

    def __init__(self, merges: list[tuple[bytes, bytes]], ids: dict[bytes, int], special: dict[str, int]):
        self.rank = {m: i for i, m in reversed(list(enumerate(merges)))}
        self.bytes_of = {i: b for b, i in ids.items()} | {i: s.encode() for s, i in special.items()}
        self.ids = {b: i for b, i in ids.items() if self.merged(b) == [b]}  # the others are never made
        self.tails = {b[k:]: -1 for b in self.ids for k in range(len(b))} | self.ids
        self.size = {i: len(b) for i, b in self.bytes_of.items()} | {-1: 0}
        self.beside: dict[tuple[int, int], bool] = {}

    def merged(self, text: bytes) -> list[bytes]:
        """Merges of a short string, the lowest rank first and the leftmost of equal ones."""
        parts: list[bytes | None] = [text[i : i + 1] for i in range(len(text))]
        after, before = [*range(1, len(text)), -1], [*range(-1, len(text) - 1)]
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(len(text) - 1) if (r := self.rank.get((parts[i], parts[i + 1]))) is not None]
        heapify(heap)
        while heap:
            _, i, a, b = heappop(heap)
            j = after[i]
            if j < 0 or parts[i] != a or parts[j] != b:
                continue
            parts[i], parts[j], after[i] = a + b, None, after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (r := self.rank.get((parts[x], parts[y]))) is not None:
                    heappush(heap, (r, x, parts[x], parts[y]))
        return [p for p in parts if p is not None]

    def stay(self, first: int, second: int) -> bool:
        told = self.beside.get((first, second))
        if told is None:
            if len(self.beside) >= PAIRS:
                self.beside.clear()
            a, b = self.bytes_of[first], self.bytes_of[second]
            told = self.beside[first, second] = self.merged(a + b) == [a, b]
        return told

    def last(self, path: bytes, end: int, tokens) -> int:
        """The last token of the first ``end`` bytes of ``path``; ``tokens[n]`` is that of its first n. Just one token fits, so
        the likeliest are tried first: the whole, and the token before with one more byte."""
        if (i := self.ids.get(path[:end])) is not None:
            return i
        grown = self.size[tokens[end - 1]] + 1
        if (i := self.ids.get(path[end - grown : end])) is not None and self.stay(tokens[end - grown], i):
            return i
        for size in range(1, end):
            i = self.tails.get(path[end - size : end])
            if i is None:
                break
            if i >= 0 and self.stay(tokens[end - size], i):
                return i
        raise ValueError(f"no token for {path[:end]!r}")

    def read(self, tokens, end: int) -> bytes:
        """The ids of the first ``end`` bytes of a path, from the last tokens of its prefixes."""
        out = array("I")
        while end:
            out.append(i := tokens[end])
            end -= self.size[i]
        out.reverse()
        return out.tobytes()


class Trie:
    """Last tokens of all prefixes met: a node for each, its token made when it is first visited."""

    def __init__(self, words: Vocabulary):
        self.words = words
        self.clear()

    def clear(self) -> None:
        self.child: dict[int, int] = {}  # by node and byte
        self.token = array("i", [-1])

    def encode(self, pieces: set[bytes]) -> dict[bytes, bytes]:
        """Insert pieces and read their ids. Pieces in order are a depth-first traversal: each goes down from where it leaves the one before."""
        child, token, last, out = self.child, self.token, self.words.last, {}
        path, nodes, tokens = b"", [0], [-1]
        for piece in sorted(pieces):
            shared, most = 0, min(len(path), len(piece))
            while shared < most and path[shared] == piece[shared]:
                shared += 1
            del nodes[shared + 1 :], tokens[shared + 1 :]
            node = nodes[-1]
            for end in range(shared + 1, len(piece) + 1):
                edge = node << 8 | piece[end - 1]
                node = child.get(edge, 0)
                if not node:
                    node = child[edge] = len(token)
                    token.append(last(piece, end, tokens))
                nodes.append(node)
                tokens.append(token[node])
            out[piece] = self.words.read(tokens, len(piece))
            path = piece
        return out


class Codec:
    """Encodes slices of texts; keeps the trie and the ids of words between them."""

    def __init__(self, merges, ids, special):
        self.words = Vocabulary(merges, ids, special)
        self.trie = Trie(self.words)
        self.memo: dict[str, bytes] = {}
        self.split = regex.compile(bpe_count.PATTERN).findall
        self.special = {s: array("I", [i]).tobytes() for s, i in special.items()}
        self.mark = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True)) + ")") if special else None

    def units(self, text: str) -> list[str]:
        """Parts of a text without special strings that pieces do not cross: words where all white space is single, else pieces."""
        return UNIT.findall(text) if " ".join(text.split()) == text.replace("\n", " ") else self.split(text)

    def walk(self, piece: bytes) -> bytes:
        """Ids of one long piece: the same propagation along a single path."""
        tokens = array("i", [-1])
        for end in range(1, len(piece) + 1):
            tokens.append(self.words.last(piece, end, tokens))
        return self.words.read(tokens, len(piece))

    def learn(self, units: set[str]) -> dict[str, bytes]:
        """Ids of units: those met lately, and new ones through the trie."""
        new = units.difference(self.memo)
        cut = {u: [u.encode()] if u.isascii() and u.lstrip(" ").isalpha() else [p.encode() for p in self.split(u)] for u in new}
        pieces = {p for parts in cut.values() for p in parts}
        if len(self.trie.token) > NODES:
            self.trie.clear()
        ids = self.trie.encode({p for p in pieces if len(p) <= LONG}) | {p: self.walk(p) for p in pieces if len(p) > LONG}
        made = {u: b"".join([ids[p] for p in parts]) for u, parts in cut.items()}
        if len(self.memo) + len(made) > WORDS:
            self.memo = {u: self.memo[u] for u in units if u in self.memo}
        self.memo.update(made)
        return self.memo

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, four bytes each."""
        parts = [self.mark.split(t) if self.mark else [t] for t in texts]
        cut = [[p if p in self.special else self.units(p) for p in text] for text in parts]
        known = self.learn({u for text in cut for p in text if not isinstance(p, str) for u in p}).__getitem__
        return [b"".join([self.special[p] if isinstance(p, str) else b"".join(map(known, p)) for p in text]) for text in cut]

    def decode(self, ids: bytes) -> str:
        """The text of ids, special strings as they are; bytes that are no UTF-8 become replacement characters."""
        return b"".join(map(self.words.bytes_of.__getitem__, array("I", ids))).decode("utf-8", "replace")


_workers: dict[str, Codec] = {}  # by vocabulary, kept while a Python worker lives


def bpe_encode(docs: DataFrame, vocabulary: str) -> DataFrame:
    """One row per document: doc_id, ids (array of int) and the text they decode to."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_run(docs, vocabulary, lambda name, ids, text: (name, array("I", ids).tolist(), text), [pa.int64(), pa.list_(pa.int32()), pa.string()], ["doc_id", "ids", "decoded"]), "doc_id long, ids array<int>, decoded string")


def bpe_digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """One row per document: doc_id, the number of ids, and digests of the ids and of the text they decode to."""
    digest = lambda name, ids, text: (name, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    made = _run(docs, vocabulary, digest, [pa.int64(), pa.int64(), pa.string(), pa.string()], [c.split()[0] for c in SCHEMA.split(", ")])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(made, SCHEMA)


def _run(docs: DataFrame, vocabulary: str, told, kinds: list, names: list[str]):
    shared = docs.sparkSession.sparkContext.broadcast(load(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from fieldwise.llm import bpe_trie as here

        if vocabulary not in here._workers:
            here._workers[vocabulary] = here.Codec(*shared.value)
        codec = here._workers[vocabulary]
        for batch in batches:
            for part in slices(batch):
                made = codec.encode([t or "" for t in part.column("text").to_pylist()])
                rows = [told(name, ids, codec.decode(ids)) for name, ids in zip(part.column("doc_id").to_pylist(), made)]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return run
