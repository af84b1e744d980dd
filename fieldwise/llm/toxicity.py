"""Toxicity: a support vector machine over a gappy subsequence kernel with Nyström landmarks, trained on labelled sentences.

The kernel of two windows sums, over all triples of bytes that both hold in order within a span of ``SPAN`` bytes, the product
of decayed weights (``DECAY`` for each byte spanned), is scaled to 1 for equal windows and raised to ``DEGREE``. A window
is a word between two edge marks. Marks and digits inside it belong to no triple: they are gaps, as inserted characters are, which
cost some decay and break no match. A run of three or more single letters is a window of its own as well. When texts are scored,
two or three neighbouring words without their blanks are a window too, if they begin and end with the two bytes of a landmark of sentences labelled 1 and come
as close as ``CLOSE`` to one: an insult cut by blanks. Less than that, words that meet by chance would count.

A sentence counts as its worst window and a text as its worst sentence (a multiple-instance machine). Training uses a bounded sample of
labelled rows, of which copies count once. Every sentence of a text labelled 0 is a negative example, standing for its worst window;
every text labelled 1 is a positive one, standing for the windows that tell it from texts labelled 0, with and without altered
letters, and, once there is a machine, for its worst window. Landmarks are the windows of
sentences labelled 1 that occur there more often than chance allows, the most frequent first and none that resembles another, and
the windows of sentences labelled 0 that are closest to them. A window's kernel values with the landmarks, whitened by the landmarks' own kernel
matrix, are its features. Platt scaling on margins of texts left out of the fit, in ``FOLDS`` turns, makes the scores; texts labelled 1
count there once as they are, and once with nothing to tell them but one window in which a letter is inserted, doubled, dropped or
masked, unless texts labelled 0 hold windows just as close to it.

Nothing is shuffled; memory follows one slice of whole texts. Defined cases: null and empty texts, and
texts without words, get the score of a text whose windows share nothing with any landmark. Without
labels of both kinds, or without a window that tells them apart, every score is 0.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import lgamma, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldwise.llm import text as tx
from fieldwise.llm.common import families, labelled_sample

SPAN, DECAY, DEGREE = 5, 0.7, 3
#: Windows with a kernel (before it is raised) of so much resemble each other; one of them is enough as a landmark.
TWIN = 0.55
#: Texts left out in turn for calibration: one of so many.
FOLDS = 2
#: A window whose kernel (before it is raised) has a bound below this with every landmark of sentences labelled 1 shares too little
#: with them and counts as sharing nothing.
LEAST = 0.5
#: Margins of words that a worker remembers.
MEMO = 500_000
#: Weights in the fit: of an altered window, and the most of one window of sentences labelled 0; the margins asked of telling
#: and of altered windows.
BENT, MOST, GOAL, BENT_GOAL = 4.0, 30, 3.0, 4.5
#: Weight of an altered text in calibration, in texts labelled 1.
ALTERED = 1.0
#: The kernel (before it is raised) that an altered window has at least with its own.
ALIKE = 0.6
#: Bytes of a window that are looked at; longer ones are cut into pieces of so many, each of which has the last ``OVERLAP`` of the one before.
WIDEST, OVERLAP = 64, 24
#: The kernel (before it is raised) that neighbouring words, as one window, have at least with a landmark of sentences labelled 1.
CLOSE = 0.8
OFFSETS = [(j, k) for k in range(2, SPAN) for j in range(1, k)]
START, GAP, END = 1, 2, 3

#: Bytes as they are compared: lower-cased, and one value for all marks and digits.
FOLD = tx.LOWER.copy()
FOLD[[b for b in range(33, 127) if not chr(b).isalpha()]] = GAP


def gapped(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Triples of all windows: the window's number, the three bytes as one code, and the weight. Gaps belong to none."""
    size = end - start + 2
    first = np.concatenate([[0], np.cumsum(size)])
    flat = np.arange(first[-1]) - np.repeat(first[:-1], size)
    left, word = np.repeat(size, size) - flat, np.repeat(np.arange(len(start)), size)
    body = FOLD[data[np.minimum(np.maximum(np.repeat(start, size) + flat - 1, 0), len(data) - 1)]].astype(np.int32) if len(data) else np.zeros(0, np.int32)
    body[flat == 0], body[left == 1] = START, END
    solid = body != GAP
    words, codes, weights = [], [], []
    for j, k in OFFSETS:
        at = np.flatnonzero(left > k)
        at = at[solid[at] & solid[at + j] & solid[at + k]]
        words.append(word[at])
        codes.append(body[at] << 16 | body[at + j] << 8 | body[at + k])
        weights.append(np.full(len(at), DECAY ** (k + 1)))
    return np.concatenate(words), np.concatenate(codes), np.concatenate(weights)


def self_kernel(word: np.ndarray, code: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """Each window's kernel with itself: equal triples add up before they are squared."""
    key = word.astype(np.int64) << 24 | code
    order = np.argsort(key, kind="stable")
    key = key[order]
    starts = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    sums = np.add.reduceat(weight[order], starts) if len(starts) else np.zeros(0)
    return np.bincount(key[starts] >> 24, weights=sums**2, minlength=n)


def as_spans(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    size = np.array([len(w) for w in words], np.int64)
    ends = np.cumsum(size)
    return np.frombuffer(b"".join(words), np.uint8), ends - size, ends


class Landmarks:
    """Landmark windows, the first ``toxic`` of them (by default all) from sentences labelled 1; kernel values of other windows with them."""

    def __init__(self, words: list[bytes], toxic: int | None = None):
        self.words = words
        data, start, end = as_spans(words)
        word, code, weight = gapped(data, start, end)
        self.codes, at = np.unique(code, return_inverse=True)
        self.weights = np.zeros((len(self.codes), len(words)), np.float32)
        np.add.at(self.weights, (at, word), (weight / np.sqrt(np.maximum(self_kernel(word, code, weight, len(words)), 1e-12))[word]).astype(np.float32))
        self.most = self.weights[:, :toxic].max(axis=1) if len(self.codes) else np.zeros(0, np.float32)
        self.table = np.full(1 << 24, -1, np.int32 if len(self.codes) > 32000 else np.int16)
        self.table[self.codes] = np.arange(len(self.codes))

    def kernel(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """One row for each window: its kernel with each landmark."""
        rows, found = self.near(data, start, end)
        out = np.zeros((len(start), len(self.words)), np.float32)
        out[rows] = found
        return out

    def near(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The windows that share enough with a landmark of sentences labelled 1, and their kernels with all landmarks."""
        rows, found = [np.zeros(0, np.int64)], [np.zeros((0, len(self.words)), np.float32)]
        for a in range(0, len(start), 4000):
            s, e = start[a : a + 4000], end[a : a + 4000]
            word, code, weight = gapped(data, s, e)
            at = self.table[code]
            hit = np.flatnonzero(at >= 0)
            # no such landmark's kernel is over the sum of the greatest weights that any landmark has for the shared triples,
            # and a window's kernel with itself is at least the sum of its squared weights
            most = np.bincount(word[hit], weights=weight[hit] * self.most[at[hit]], minlength=len(s))
            near = most >= LEAST * np.sqrt(np.bincount(word, weights=weight**2, minlength=len(s)))
            mine, number = near[word], np.cumsum(near) - 1
            own = np.ones(len(s))
            own[near] = self_kernel(number[word[mine]], code[mine], weight[mine], int(near.sum()))
            scale = 1 / np.sqrt(np.maximum(own, 1e-12))
            near &= most * scale >= LEAST
            hit = hit[near[word[hit]]]
            hit = hit[np.argsort(word[hit], kind="stable")]
            mine, number = np.flatnonzero(near), np.cumsum(near) - 1
            out = np.zeros((len(mine), len(self.words)), np.float32)
            for part in np.array_split(hit, max(1, len(hit) // 40_000)):
                if len(part):
                    first = np.flatnonzero(np.append(True, np.diff(word[part]) > 0))
                    np.add.at(out, number[word[part][first]], np.add.reduceat(self.weights[at[part]] * weight[part, None].astype(np.float32), first, axis=0))
            rows.append(a + mine)
            found.append((out * scale[mine, None].astype(np.float32)) ** DEGREE)
        return np.concatenate(rows), np.concatenate(found)

    def of(self, words: list[bytes]) -> np.ndarray:
        return self.kernel(*as_spans(words)) if words else np.zeros((0, len(self.words)), np.float32)


@dataclass
class Model:
    landmarks: list[bytes]
    toxic: int  # the first so many are from sentences labelled 1
    telling: set[bytes]  # training windows that tell texts apart
    robust: set[bytes]  # landmarks that still tell texts apart when a letter is altered
    direction: np.ndarray  # SVM weights on kernel values with the landmarks, the whitening included
    bias: float
    scale: tuple[float, float]

    def prepare(self) -> Model:
        self.near, self.memo = Landmarks(self.landmarks, self.toxic), {}
        self.begins, self.ends = np.zeros(1 << 16, bool), np.zeros(1 << 16, bool)
        known = [w for w in self.landmarks[: self.toxic] if len(w) >= 3]
        self.begins[[w[0] << 8 | w[1] for w in known]] = self.ends[[w[-2] << 8 | w[-1] for w in known]] = True
        self.longest = max(map(len, known), default=0)
        return self

    def cut(self, data: np.ndarray, words: tx.Spans) -> tuple[np.ndarray, np.ndarray]:
        """Texts that hold an insult cut by one or two blanks, and the margin of each such window."""
        folded, low, high, row = FOLD[data], words.start.copy(), words.end.copy(), words.row
        for _ in range(3):  # marks around words
            low += (high - low > 1) & (folded[low] == GAP)
            high -= (high - low > 1) & (folded[high - 1] == GAP)
        pieces, texts = [], []
        for n in (2, 3):
            first = np.arange(max(len(low) - n + 1, 0))
            first = first[(row[first] == row[first + n - 1]) & (high[first + n - 1] - low[first] <= self.longest + 2 * n)]
            last = first + n - 1
            second = np.where(high[first] - low[first] > 1, low[first] + 1, low[first + 1])
            late = np.where(high[last] - low[last] > 1, high[last] - 2, high[last - 1] - 1)
            code = lambda a, b: folded[a].astype(np.int32) << 8 | folded[b]
            for i in first[self.begins[code(low[first], second)] & self.ends[code(late, high[last] - 1)]].tolist():
                pieces.append(b"".join(folded[a:b].tobytes() for a, b in zip(low[i : i + n].tolist(), high[i : i + n].tolist())))
                texts.append(row[i])
        if not pieces:
            return np.zeros(0, np.int64), np.zeros(0)
        found = self.near.of(pieces)
        close = found[:, : self.toxic].max(axis=1) >= CLOSE**DEGREE
        return np.array(texts)[close], found[close] @ self.direction + self.bias

    def scores(self, column: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale[0] * self.worst(column) + self.scale[1], -30, 30)))

    def margins(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The margin of each window; those that share no triple with a landmark have the bias."""
        return self.near.kernel(data, start, end) @ self.direction + self.bias

    def worst(self, column: pa.Array) -> np.ndarray:
        """The highest margin among each text's windows."""
        data, offsets = tx.raw(column)
        words = tx.word_spans(data, offsets)
        held, margin = self.cut(data, words)
        data, start, end, row = windows(data, words)
        kind, first, back = np.unique(tx.span_hashes(FOLD[data], start, end), return_index=True, return_inverse=True)
        kind = kind.tolist()
        known = list(map(self.memo.get, kind))
        new = [i for i, m in enumerate(known) if m is None]
        if new:
            if len(self.memo) > MEMO:
                self.memo.clear()
            for i, m in zip(new, self.margins(data, start[first[new]], end[first[new]]).tolist()):
                self.memo[kind[i]] = known[i] = m
        worst = np.full(len(offsets) - 1, self.bias)
        np.maximum.at(worst, row, np.array(known, np.float64)[back])
        np.maximum.at(worst, held, margin)
        return worst


def windows(data: np.ndarray, words: tx.Spans) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words, in pieces of at most ``WIDEST`` bytes, and after them the joined letters of runs of three or more words of one letter."""
    start, end, row = words.start, words.end, words.row
    if not len(words):
        return data, start, end, row
    single = (end - start == 1) & ((data[start] | 32) - 97 < 26)
    edge = np.flatnonzero(np.append(True, (single[1:] != single[:-1]) | (row[1:] != row[:-1])))
    size = np.diff(np.append(edge, len(words)))
    runs = [(data[start[e : e + n]], row[e]) for e, n in zip(edge.tolist(), size.tolist()) if n >= 3 and single[e]]
    if runs:
        sizes = np.array([len(w) for w, _ in runs])
        ends = len(data) + np.cumsum(sizes)
        data = np.concatenate([data, *(w for w, _ in runs)])
        start, end, row = np.concatenate([start, ends - sizes]), np.concatenate([end, ends]), np.concatenate([row, [r for _, r in runs]])
    pieces = np.maximum(-(-(end - start - OVERLAP) // (WIDEST - OVERLAP)), 1)
    if pieces.max() > 1:
        step = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start, end, row = np.repeat(start, pieces) + step * (WIDEST - OVERLAP), np.repeat(end, pieces), np.repeat(row, pieces)
        end = np.minimum(end, start + WIDEST)
    return data, start, end, row


def altered(word: bytes, rng: np.random.Generator, places: int = 6) -> list[bytes]:
    """A window with one letter inserted, doubled, dropped or masked, and with two inserted, at places of its own choice."""
    letter = lambda: bytes([97 + int(rng.integers(26))])
    out = []
    for i in rng.permutation(np.arange(1, len(word)))[:places].tolist():
        other = int(rng.integers(1, len(word)))
        once = word[:other] + letter() + word[other:]
        out += [word[:i] + letter() + word[i:], word[:i] + word[i - 1 : i] + word[i:], word[:i] + word[i + 1 :], word[:i] + b"*" + word[i + 1 :], once[:i] + letter() + once[i:]]
    return out


def one_altered(text: str, model: Model, rng: np.random.Generator) -> str | None:
    """A text whose only telling window is a robust one with a letter altered; None without a robust one."""
    words = text.encode().split()
    bare = [FOLD[np.frombuffer(word, np.uint8)].tobytes().strip(b"\x02") for word in words]
    places = [i for i, w in enumerate(bare) if w in model.robust]
    if not places:
        return None
    at = places[int(rng.integers(len(places)))]
    words[at] = altered(bare[at], rng, 1)[int(rng.integers(4))]
    return b" ".join(w for i, w in enumerate(words) if i == at or bare[i] not in model.telling).decode(errors="replace")


def squared_hinge(x: np.ndarray, y: np.ndarray, cost: np.ndarray, l2: float, goal: np.ndarray) -> tuple[np.ndarray, float]:
    """Primal L2-loss SVM by Newton steps on the rows inside the margin, which is ``goal`` for each row."""
    x1 = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x1.shape[1])
    ridge = l2 * np.eye(len(w)) * cost.sum()
    ridge[-1, -1] *= 1e-3
    for step in range(40):
        inside = y * (x1 @ w) < goal
        xa, ca, ya = x1[inside], cost[inside], (goal * y)[inside]
        new = np.linalg.solve(xa.T @ (xa * ca[:, None]) + ridge, xa.T @ (ca * ya))
        if np.abs(new - w).max() < 1e-7:
            break
        w = 0.5 * w + 0.5 * new if step > 15 else new
    return w[:-1], float(w[-1])


def platt(margin: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the weighted logistic loss's minimum. Newton steps are halved until the loss falls:
    whole steps run away where the labels are nearly separable."""
    n1, n0 = label.sum(), len(label) - label.sum()
    target = np.where(label > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.column_stack([margin, np.ones(len(margin))])
    ridge = np.array([0.1, 1e-3])
    loss = lambda w: (weight * (np.logaddexp(0, x @ w) - target * (x @ w))).sum() + 0.5 * (ridge * w * w).sum()
    w = np.array([1.0, 0.0])
    now = loss(w)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (p - target)) + ridge * w
        bend = x.T @ (x * (weight * np.maximum(p * (1 - p), 1e-9))[:, None]) + np.diag(ridge)
        step, share = np.linalg.solve(bend, slope), 1.0
        while share > 1e-10 and loss(w - share * step) > now:
            share /= 2
        new = w - share * step
        before, now = now, min(now, loss(new))
        w = new if now < before else w
        if before - now <= 1e-10 * max(1.0, abs(now)):
            break
    return float(w[0]), float(w[1])


def sentences(text: str) -> list[set[bytes]]:
    """The distinct windows of each sentence, folded; a sentence ends at ``.``, ``!``, ``?`` or a line feed."""
    raw = text.encode()
    for mark in (b"!", b"?", b"\n"):
        raw = raw.replace(mark, b". ")
    parts = raw.split(b". ")
    data, offsets = tx.raw(pa.array(parts, pa.binary()).cast(pa.string()))
    data, start, end, row = windows(data, tx.word_spans(data, offsets))
    folded = FOLD[data].tobytes()
    out: list[set[bytes]] = [set() for _ in parts]
    for a, b, r in zip(start.tolist(), end.tolist(), row.tolist()):
        out[r].add(folded[a:b].strip(b"\x02"))
    return [s - {b""} for s in out if s]


def chance(hits: int, n: int, share: float) -> float:
    """Natural logarithm of the largest term of the binomial tail: ``hits`` or more of n fall in a part of size ``share``."""
    return lgamma(n + 1) - lgamma(hits + 1) - lgamma(n - hits + 1) + hits * log(share) + (n - hits) * log(1 - share)


def apart(words: list[bytes], most: int) -> list[bytes]:
    """At most ``most`` of the windows, in their order, leaving out those that resemble one already taken."""
    if not words:
        return []
    alike, chosen = Landmarks(words).of(words) >= TWIN**DEGREE, []
    for i in range(len(words)):
        if len(chosen) < most and not alike[i, chosen].any():
            chosen.append(i)
    return [words[i] for i in chosen]


class Sample:
    """Labelled texts as sentences of numbered windows; copies are one family."""

    def __init__(self, rows: list[tuple[int, str, int]]):
        self.label = np.array([label for _, _, label in rows])
        number: dict[bytes, int] = {}
        self.texts, self.bags, family = [], [], []
        for _, t, _ in rows:
            parts = sentences(t)
            self.texts.append([np.array([number.setdefault(w, len(number)) for w in s], np.int32) for s in parts if s])
            self.bags.append(np.unique(np.concatenate(self.texts[-1])) if self.texts[-1] else np.zeros(0, np.int32))
        self.words = list(number)
        self.family = np.array(families([{self.words[k] for k in bag.tolist()} for bag in self.bags]))

    def counts(self, use: np.ndarray, value: int) -> tuple[np.ndarray, int]:
        """How many families of texts of one label hold each window, and how many families there are."""
        mine = [i for i in use.tolist() if self.label[i] == value]
        if not mine:
            return np.zeros(len(self.words), np.int64), 0
        window = np.concatenate([self.bags[i] for i in mine])
        family = np.concatenate([np.full(len(self.bags[i]), self.family[i]) for i in mine])
        pairs = np.unique(window.astype(np.int64) << 32 | family)
        return np.bincount(pairs >> 32, minlength=len(self.words)), len({int(self.family[i]) for i in mine})


def machine(sample: Sample, use: np.ndarray, landmarks: int, l2: float) -> Model | None:
    """The machine fitted on the texts ``use`` of a sample."""
    (hits, n_toxic), (misses, n_clean) = sample.counts(use, 1), sample.counts(use, 0)
    if not n_toxic or not n_clean:
        return None
    share, least = n_toxic / (n_toxic + n_clean), -log(max(int((hits > 0).sum()), 2))
    odds = (hits + 0.5) / (n_toxic + 1) * (n_clean + 1) / (misses + 0.5)
    told = [k for k in np.flatnonzero((hits >= 3) & (odds > 4)).tolist() if len(sample.words[k]) >= 3 and chance(int(hits[k]), int(hits[k] + misses[k]), share) < least]
    positives, negatives = [i for i in use.tolist() if sample.label[i]], [i for i in use.tolist() if not sample.label[i]]
    told = sorted(told, key=lambda k: (-int(hits[k]), sample.words[k]))[: 32 * landmarks]
    chosen = apart([sample.words[k] for k in told], landmarks)
    if not chosen:
        return None
    telling = np.zeros(len(sample.words), bool)
    telling[told] = True
    # negatives: windows of sentences labelled 0, without those that tell texts apart
    pool = np.flatnonzero((misses > 0) & ~telling)
    marks = Landmarks(chosen)
    rows, like = marks.near(*as_spans([sample.words[k] for k in pool.tolist()]))
    kept, near = pool[rows], like.max(axis=1) if len(rows) else np.zeros(0)
    # a landmark is robust if few texts labelled 0 hold a window as close to it as an altered one is
    hits_of = {sample.words[k]: int(hits[k]) for k in told}
    robust = [w for w, n in zip(chosen, misses[kept] @ (like >= ALIKE**DEGREE)) if n <= 0.1 * hits_of[w]]
    close = [sample.words[k] for k in kept[np.argsort(-near, kind="stable")[: 4 * len(chosen)]].tolist()]
    words = chosen + [w for w in close if w not in chosen]
    del marks, like
    gram = Landmarks(words).of(words).astype(np.float64)
    base = Landmarks(words, len(chosen))
    value, vector = np.linalg.eigh((gram + gram.T) / 2)
    good = value > 1e-4
    white = (vector[:, good] / np.sqrt(value[good])).astype(np.float32)  # K(L, L) ** -1/2 on its range
    features = lambda found: found @ white
    low_of = np.full(len(sample.words), -1)
    low_of[kept] = np.arange(len(kept))
    low = features(base.of([sample.words[k] for k in kept.tolist()]))
    held = [low_of[s] for i in negatives for s in sample.texts[i]]
    held = [h[h >= 0] for h in held if h.max() >= 0]
    shown = np.flatnonzero(hits > 0)
    rows, found = base.near(*as_spans([sample.words[k] for k in shown.tolist()]))
    shown, high = shown[rows], features(found)  # the others' features are 0
    high_of = np.full(len(sample.words), -1)
    high_of[shown] = np.arange(len(shown))
    rng = np.random.default_rng(7)
    bent = features(base.of([v for w in robust for v in altered(w, rng)])).reshape(-1, white.shape[1])
    told = [k for k in told if high_of[k] >= 0]
    w, b = np.zeros(white.shape[1]), 0.0
    for turn in range(3):
        # each text labelled 1 stands for the windows that tell it; from the second turn on also for its worst window
        positive = Counter({int(high_of[k]): min(int(hits[k]), 20) for k in told})
        if turn:
            worst = high @ w + b
            for i in positives:
                mine = high_of[sample.bags[i]]
                mine = mine[mine >= 0]
                if len(mine):
                    if worst[best := int(mine[worst[mine].argmax()])] > 0:
                        positive[best] += 1
            worst = low @ w
            negative = Counter(int(h[worst[h].argmax()]) for h in held)
        else:
            negative = Counter(rng.permutation(len(low))[:5000].tolist()) + Counter(np.argsort(-near, kind="stable")[:2000].tolist())
        p, q = np.array(list(positive), int), np.array(list(negative), int)
        x = np.concatenate([high[p], bent, low[q], np.zeros((1, white.shape[1]))])  # the last for all windows that share nothing
        y = np.concatenate([np.ones(len(p) + len(bent)), -np.ones(len(q) + 1)])
        cost = np.concatenate([[positive[k] for k in p.tolist()], np.full(len(bent), BENT), [min(negative[k], MOST) for k in q.tolist()], [1000.0]])
        goal = np.ones(len(y))
        goal[: len(p)][telling[shown[p]]] = GOAL
        goal[len(p) : len(p) + len(bent)] = BENT_GOAL
        w, b = squared_hinge(x, y, cost, l2, goal)
    return Model(words, len(chosen), {sample.words[k] for k in told}, {*robust}, (white @ w).astype(np.float32), b, (1.0, 0.0))


def worst_of(model: Model, texts: list[str]) -> np.ndarray:
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])
    ready = model.prepare()
    return np.concatenate([ready.worst(part.column("text")) for part in tx.slices(batch)]) if texts else np.zeros(0)


def fit(rows: list[tuple[int, str, int]], landmarks: int = 64, l2: float = 1e-5, clean_weight: float = 1.0) -> Model | None:
    """``rows`` are (id, text, label); ``clean_weight`` is how many texts one sampled clean text stands for."""
    sample = Sample(rows)
    model = machine(sample, np.arange(len(rows)), landmarks, l2)
    if model is None:
        return None
    rng, margin, label, weight = np.random.default_rng(11), [], [], []
    for fold in range(FOLDS):
        out = np.flatnonzero(tx.mix(sample.family.astype(np.uint64)) % np.uint64(FOLDS) == fold)
        part = machine(sample, np.setdiff1d(np.arange(len(rows)), out), landmarks, l2)
        if part is not None:
            margin.append(worst_of(part, [rows[i][1] for i in out]))
            label.append(sample.label[out])
            bent = [t for i in out if sample.label[i] and (t := one_altered(rows[i][1], part, rng))]
            margin.append(worst_of(part, bent))
            label.append(np.ones(len(bent), int))
            weight += [np.where(sample.label[out] > 0, 1.0, clean_weight), np.full(len(bent), ALTERED)]
    if len({v for part in label for v in part.tolist()}) < 2:
        margin, label, weight = [worst_of(model, [t for _, t, _ in rows])], [sample.label], [np.where(sample.label > 0, 1.0, clean_weight)]
    model.scale = platt(np.concatenate(margin), np.concatenate(label).astype(np.float64), np.concatenate(weight))
    return model


def train(docs: DataFrame, labels: DataFrame, max_train_docs: int = 1000, where=None) -> Model | None:
    """Fit on at most ``max_train_docs`` rows of each label; ``where`` limits the labelled rows."""
    rows = labelled_sample(docs, labels, "toxic", max_train_docs, where)
    learned = labels if where is None else labels.where(where)
    counts = {r[0]: r[1] for r in learned.groupBy(F.col("toxic").cast("int")).count().collect()}
    taken = Counter(label for _, _, label in rows)
    ratio = (counts.get(0, 0) / max(taken[0], 1)) / max(counts.get(1, 0) / max(taken[1], 1), 1e-9)
    return fit(rows, clean_weight=max(ratio, 1.0))


_workers: dict[str, Model] = {}  # the last model, with what it remembers


def toxicity(docs: DataFrame, model: Model | None) -> DataFrame:
    """One row per document: doc_id, score."""
    state = None if model is None else (model.landmarks, model.toxic, set(), set(), model.direction, model.bias, model.scale)
    shared = docs.sparkSession.sparkContext.broadcast(state)

    name = uuid.uuid4().hex

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from fieldwise.llm import toxicity as here

        if shared.value is not None and name not in here._workers:
            here._workers.clear()
            here._workers[name] = Model(*shared.value).prepare()
        ready = here._workers.get(name)
        for batch in batches:
            for part in tx.slices(batch):
                score = ready.scores(part.column("text")) if ready is not None else np.zeros(part.num_rows)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(score, pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(judge, "doc_id long, score double")
