"""Packing by the dot-product heuristic of vector bin packing.

An example needs tokens, one segment, and loss-bearing tokens; a sequence has limits on all
three. Of a document, the first ``prompt_share`` of its tokens (rounded down) is its prompt, which bears no loss; all tokens after it do.
The limit on loss-bearing tokens is below that on tokens, so a sequence needs prompts as well. The open sequence takes, of the examples that fit, the one whose demand has the largest
dot product with what is left, both as shares of the limits. When none fits, the example of which most fits
is cut to fill the rest. Examples over a limit are cut first: the rest after the prompt into pieces of the limit on loss, the prompt
into pieces that fill what such a piece leaves of a sequence.

Each task packs its rows in windows of about ``window`` tokens, ``MOST_EXAMPLES`` documents at most: nothing is shuffled, memory is
bounded by a window and the longest text. Sequences that lack over ``spare`` tokens, such as a window's last, are cut into
sequences whose lengths are powers of two, which take no padding.
A task that runs again makes the same sequences; ids hold the partition's number.

Defined cases: null and empty texts are the end token alone; a repeated row is packed as an
example of its own; a null doc_id is kept; no rows give no sequences. A limit under 1 raises.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldwise.llm import text as tx
from fieldwise.llm.common import map_texts

#: A worker that remembers twice as many words keeps so many, those it met most often.
MEMO = 300_000
#: Bytes of texts whose distinct words are looked up together.
SLICE = 1 << 20
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"


def pack(lengths: list[int], loss_from: list[int], max_tokens: int, max_segments: int, max_loss: int, least_cut: int = 8) -> list[list[tuple[int, int, int]]]:
    """Sequences as lists of (example, start, length). Tokens before ``loss_from`` bear no loss."""

    def loss(i: int, a: int, b: int) -> int:
        return max(0, b - max(a, loss_from[i]))

    if min(max_tokens, max_segments, max_loss) < 1:
        raise ValueError("all limits must be 1 or more")
    max_loss = min(max_loss, max_tokens)
    gap = max_tokens - max_loss or max_tokens
    done: list[list[tuple[int, int, int]]] = []
    kinds: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for i, n in enumerate(lengths):
        a = 0
        while n - a > max_tokens or loss(i, a, n) > max_loss:
            take = min(gap, loss_from[i] - a) if a < loss_from[i] else min(max_loss, n - a)
            kinds.setdefault((take, loss(i, a, a + take)), []).append((i, a))
            a += take
        if n > a:
            kinds.setdefault((n - a, loss(i, a, n)), []).append((i, a))
    size = max(len(kinds) * 2, 64)
    need, waiting, of = np.zeros((size, 3)), np.zeros(size, bool), {}
    pools: list[list[tuple[int, int]]] = []
    scale = np.array([max_tokens, max_segments, max_loss], dtype=np.float64)

    def add(kind: tuple[int, int], items: list[tuple[int, int]]) -> None:
        nonlocal need, waiting
        k = of.get(kind)
        if k is None:
            k = of[kind] = len(pools)
            pools.append([])
            if k >= len(need):
                need, waiting = np.concatenate([need, np.zeros_like(need)]), np.concatenate([waiting, np.zeros_like(waiting)])
            need[k] = kind[0], 1, kind[1]
        pools[k].extend(items)
        waiting[k] = True

    for kind in sorted(kinds, reverse=True):
        add(kind, kinds[kind])
    left = sum(map(len, pools))
    while left:
        room, sequence = scale.copy(), []
        while left and room[0] >= 1 and room[1] >= 1:
            fits = waiting & (need[:, 0] <= room[0]) & (need[:, 2] <= room[2])
            value = np.where(fits, need @ (room / scale / scale), -1.0)
            k = int(value.argmax())
            if value[k] >= 0:
                i, a = pools[k].pop()
                take = int(need[k, 0])
                left -= 1
            else:
                if room[0] < least_cut:
                    break
                # loss-bearing tokens come last in an example, so of each this much fits
                prefix = np.where(waiting, np.minimum(room[0], need[:, 0] - need[:, 2] + room[2]), -1)
                k = int(prefix.argmax())
                take = int(prefix[k])
                if take < least_cut:
                    break
                i, a = pools[k].pop()
                rest, end = int(need[k, 0]) - take, a + int(need[k, 0])
                add((rest, loss(i, a + take, end)), [(i, a + take)])
            if not pools[k]:
                waiting[k] = False
            room -= (take, 1, loss(i, a, a + take))
            sequence.append((i, a, take))
        done.append(sequence)
    return done


def powers(sequence: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """A sequence cut into ones whose lengths are powers of two, the longest first."""
    total, out, rest = sum(n for _, _, n in sequence), [], list(reversed(sequence))
    while total:
        room, part = 1 << (total.bit_length() - 1), []
        total -= room
        while room:
            i, a, n = rest.pop()
            take = min(n, room)
            part.append((i, a, take))
            room -= take
            if take < n:
                rest.append((i, a + take, n - take))
        out.append(part)
    return out


#: How ``Words`` takes words apart itself: the file's own steps, which it does for words of printable ASCII (but ``<``, with which special tokens begin)
#: and Latin-1 letters. These have one form in NFC and one lower case each, in every version of Unicode. All other words go to the library.
STEPS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ]},
}
SUFFIX = "</w>"
NOT_PLAIN = re.compile("[^ -;=-~À-ÖØ-öø-ÿ]")
#: Pieces of lower-cased plain words, whose letters beyond ASCII are written as the two characters that stand for their bytes.
PIECE = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\x80-\uffff]+|[0-9]|[!-/:-@\\[-`{-~]+| ")


def room(values: np.ndarray, n: int) -> np.ndarray:
    """``values`` with room for ``n``, at least twice as much as before where it does not suffice."""
    return values if n <= len(values) else np.concatenate([values, np.zeros(max(n, 2 * len(values)) - len(values), values.dtype)])


class Words(dict):
    """Numbers of white-space separated words, and each word's token ids.

    The vocabulary's pieces never span white space, so a text's ids are its words' ids in turn.
    Each distinct word of a slice is looked up once. Unknown ones get the next numbers: plain ones are taken apart here and their pieces given to the
    library's model, others are tokenized together by the library, as one text. At most twice ``MEMO`` words and a slice's are remembered;
    what is forgotten is tokenized anew.
    """

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, WhitespaceSplit

        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        steps = made["pre_tokenizer"].get("pretokenizers", [{}])
        if (steps[0].get("type"), steps[0].get("behavior"), steps[0].get("invert")) != ("Split", "Removed", True) or "\\s]" not in steps[0]["pattern"]["Regex"].replace("\\s\\p{L}\\p{N}]", "\\s]"):
            raise ValueError("this vocabulary's pieces may span white space")
        self.tokenizer = Tokenizer.from_file(path)
        self.same = all(made.get(k) == v for k, v in STEPS.items()) and made["model"].get("end_of_word_suffix") == SUFFIX and all("<" in t["content"] for t in made["added_tokens"])
        byte_level = ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = [(c, byte_level.pre_tokenize_str(c)[0][0]) for c in map(chr, range(0xDF, 0x100)) if c.isalpha()]
        self.pieces = Tokenizer(self.tokenizer.model)  # the same model, not a copy
        self.pieces.pre_tokenizer = WhitespaceSplit()
        self.last = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.last[[i for token, i in made["model"]["vocab"].items() if token.endswith(SUFFIX)]] = True
        # the numbers of ends, ids and met that are in use follow from the number of words
        self.ends, self.ids, self.met = np.zeros(1, np.int64), np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def forget(self) -> None:
        """Keep the ``MEMO`` words met most often; what they were met before counts by half from now on."""
        n, words = len(self), list(self)
        keep = np.sort(np.argpartition(-self.met[:n], MEMO)[:MEMO])
        size = np.diff(self.ends[: n + 1])[keep]
        ends = np.concatenate([[0], np.cumsum(size)])
        self.ids = self.ids[np.arange(ends[-1]) + np.repeat(self.ends[keep] - ends[:-1], size)]
        self.ends, self.met = ends, self.met[keep] // 2
        self.clear()
        self.update((words[i], n) for n, i in enumerate(keep.tolist()))

    def plain_ids(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of plain words, each followed by a blank, and where each word's end."""
        text = text.lower()
        for letter, written in self.letters:
            text = text.replace(letter, written)
        pieces = PIECE.findall(text)
        ids = np.array(self.pieces.encode_batch_fast([" ".join(pieces)], add_special_tokens=False)[0].ids, np.uint32)
        blank = np.array([p == " " for p in pieces], bool)
        ends = np.concatenate([[0], np.flatnonzero(self.last[ids]) + 1])  # of pieces: their last tokens, and no others, have the suffix
        if len(ends) - 1 != len(pieces) - blank.sum():
            raise ValueError("a piece's tokens do not end with the suffix")
        return ids, ends[np.cumsum(~blank)[blank]]

    def other_ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same of any words, by the library."""
        ids, ends = [], []
        for i in range(0, len(words), 5000):
            part = words[i : i + 5000]
            made = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            starts = np.cumsum([len(w) + 1 for w in part])
            ends += (len(ids) + np.searchsorted(np.array([a for a, _ in made.offsets], np.int64), starts)).tolist()
            ids += made.ids
        return np.array(ids, np.uint32), np.array(ends, np.int64)

    def learn(self, words: list[bytes]) -> np.ndarray:
        """Numbers for words that are not known yet."""
        text = b" ".join([*words, b""]).decode()
        if not self.same:
            odd = np.ones(len(words), bool)
        elif NOT_PLAIN.search(text):
            odd = np.array([NOT_PLAIN.search(w) is not None for w in text[:-1].split(" ")], bool)
            text = " ".join([*(words[i].decode() for i in np.flatnonzero(~odd).tolist()), ""])
        else:
            odd = np.zeros(len(words), bool)
        order, n = np.argsort(odd, kind="stable"), len(self)
        made = [self.plain_ids(text)] if not odd.all() else []
        if odd.any():
            made.append(self.other_ids([words[i].decode() for i in np.flatnonzero(odd).tolist()]))
        self.update(zip((words[i] for i in order.tolist()) if odd.any() else words, range(n, n + len(words))))
        self.ends, self.met = room(self.ends, len(self) + 1), room(self.met, len(self))
        self.met[n : len(self)] = 0
        for ids, ends in made:
            upto = int(self.ends[n])
            self.ids = room(self.ids, upto + len(ids))
            self.ends[n + 1 : n + 1 + len(ends)], self.ids[upto : upto + len(ids)] = upto + ends, ids
            n += len(ends)
        numbers = np.empty(len(words), np.int64)
        numbers[order] = np.arange(len(self) - len(words), len(self))
        return numbers

    def encode(self, texts: list[bytes] | pa.Array) -> list[np.ndarray]:
        if len(self) > 2 * MEMO:
            self.forget()
        texts = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.binary()), "").cast(pa.string())
        split = pc.ascii_split_whitespace(texts)  # of blanks at either end empty words come, which have no ids
        words = split.flatten().dictionary_encode()
        where, counts, distinct = words.indices.to_numpy(), split.offsets.to_numpy(), words.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()
        k = np.fromiter(map(self.get, distinct, repeat(-1)), np.int64, len(distinct))
        new = np.flatnonzero(k < 0)
        if len(new):
            k[new] = self.learn([distinct[i] for i in new.tolist()])
        self.met[k] += np.bincount(where, minlength=len(k))
        size = (self.ends[k + 1] - self.ends[k])[where]
        upto = np.concatenate([[0], np.cumsum(size)])
        flat = self.ids[np.arange(upto[-1]) + np.repeat(self.ends[k][where] - upto[:-1], size)]
        return np.split(flat, upto[counts[1:-1]]) if len(texts) else []


_workers: dict[str, Words] = {}


def packed(lengths: list[int], loss_from: list[int], max_tokens: int, max_segments: int, max_loss: int, spare: int = 16) -> list[list[tuple[int, int, int]]]:
    """As ``pack``, with sequences that lack over ``spare`` tokens cut into powers of two."""
    out = []
    for sequence in pack(lengths, loss_from, max_tokens, max_segments, max_loss):
        short = sum(n for _, _, n in sequence)
        out += powers(sequence) if max_tokens - short > spare and short & (short - 1) else [sequence]
    return out


#: Documents that a window holds at most: very short ones would fill it by their number long before their tokens do.
MOST_EXAMPLES = 100_000


def pack_documents(docs: DataFrame, vocabulary: str, end_id: int = 1, max_tokens: int = 2048, max_segments: int = 64, max_loss: int = 1792, prompt_share: float = 0.25, window: int = 3_000_000) -> DataFrame:
    """Pieces of all documents, placed in sequences; ``loss_tokens`` says how many of a piece's tokens bear loss."""
    if min(max_tokens, max_segments, max_loss) < 1:
        raise ValueError("all limits must be 1 or more")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from fieldwise.llm import packing as here

        if vocabulary not in here._workers:
            here._workers[vocabulary] = Words(vocabulary)
        words, task, number = here._workers[vocabulary], TaskContext.get().partitionId(), 0
        names, ids, held = [], [], 0

        def flush():
            nonlocal names, ids, held, number
            sizes = [len(x) for x in ids]
            prompts = [int(n * prompt_share) for n in sizes]
            sequences = packed(sizes, prompts, max_tokens, max_segments, max_loss)
            rows = []
            for sequence in sequences:
                offset = 0
                for i, a, n in sequence:
                    rows.append((names[i], a, n, zlib.crc32(ids[i][a : a + n].tobytes()), len(ids[i]), (task << 32) + number, offset, max(0, a + n - max(a, prompts[i]))))
                    offset += n
                number += 1
            names, ids, held = [], [], 0
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=[c.split()[0] for c in PIECES.split(", ")])

        for batch in batches:
            for part in tx.slices(batch, size=SLICE):
                for name, x in zip(part.column("doc_id").to_pylist(), words.encode(part.column("text"))):
                    names.append(name)
                    ids.append(np.append(x, np.uint32(end_id)).astype("<u4"))
                    held += len(ids[-1])
                if held >= window or len(names) >= MOST_EXAMPLES:
                    yield flush()
        if names:
            yield flush()

    return map_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), place, PIECES)
