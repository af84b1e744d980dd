"""Quality rules: a linear-chain CRF marks each line as content or boilerplate.

The Viterbi path over a document's lines gives its content lines; the share of words in them
decides whether the document is kept. Each task works on slices of whole texts, so nothing is
shuffled and memory follows one slice.

Training: at most ``max_train_docs`` labelled documents of each label value, ``max_doc_lines`` lines of one document
and ``max_train_lines`` lines in all. All lines of a document labelled bad are boilerplate. A line of a good one is content, unless it
repeats an earlier line of its document or is a known line: one that stands with at most ``SHORT`` words in ``KNOWN`` or more sampled documents that are no copies
of each other (licenses, menus, footers). The model keeps the hashes of known lines, and they are a feature as well.
The least content share of a kept document is fitted to the sampled documents' labels. Chains are cut into pieces of ``PIECE`` lines for training, so its memory is bounded whatever the longest document is.

Defined cases: null or empty text has no words, one empty line, fails the base rules and has
content share 0. Repeated rows are judged row by row. Without usable labels the CRF has zero
weights, marks every line as content, and only the base rules decide. ``line_quality`` raises where a column to keep bears the name
of a decision; ``good_documents`` keeps all columns, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldwise.llm import text as tx
from fieldwise.llm.common import families, labelled_sample, map_texts

SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[list(b"#*$%&|<>")] = True
DIGITS = np.zeros(256, dtype=bool)
DIGITS[list(b"0123456789")] = True
MARKS = np.zeros(256, dtype=bool)
MARKS[list(b".,;:!?\"')")] = True

#: Line features in order; all but the bias are 0 or 1.
FEATURES = ("bias", "no_words", "under_4_words", "over_40_words", "symbol", "symbol_per_5_words", "pipes", "ends_in_mark", "starts_upper", "digit_heavy", "repeats_line", "echo_any", "echo_half", "window_any", "window_half", "long_words", "tail_lines", "known_line")
#: A line in so many sampled documents, copies counted once, is boilerplate.
KNOWN = 3
#: Longer lines are passages that documents quote, not boilerplate.
SHORT = 16
#: Lines of one training chain, and lines of a padded group of chains.
PIECE, GROUP = 256, 40_000


@dataclass
class Crf:
    """Two states, 0 boilerplate and 1 content: ``emit`` scores content against boilerplate."""

    emit: np.ndarray
    turn: np.ndarray
    known: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    min_share: float = 0.5

    def viterbi(self, x: np.ndarray) -> list[bool]:
        """The best path over one document's lines."""
        (t00, t01), (t10, t11) = self.turn.tolist()
        gap, back = 0.0, []  # score of ending in content less that of ending in boilerplate
        for i, e in enumerate((x @ self.emit).tolist()):
            if i:
                to0, to1 = gap + t10 > t00, gap + t11 >= t01
                back.append((to0, to1))
                gap = (gap + t11 if to1 else t01) - (gap + t10 if to0 else t00)
            gap += e
        state = gap >= 0
        path = [state]
        for to0, to1 in reversed(back):
            state = to1 if state else to0
            path.append(state)
        return path[::-1]


def fit_crf(docs: list[tuple[np.ndarray, np.ndarray]], rounds: int = 80, l2: float = 1e-3, l2_turn: float = 0.1) -> Crf:
    """Maximum conditional likelihood by forward-backward and Adam; ``docs`` holds (features, labels) of lines.

    Most documents' lines all bear one label, which would make the transitions drown the lines' own evidence; ``l2_turn`` holds
    them back.
    """
    emit, turn = np.zeros(len(FEATURES)), np.zeros((2, 2))
    docs = sorted(((x[i : i + PIECE], y[i : i + PIECE]) for x, y in docs for i in range(0, len(y), PIECE)), key=lambda d: len(d[1]))
    if len({int(v) for _, y in docs for v in np.unique(y)}) < 2:
        return Crf(emit, turn)
    groups, i = [], 0
    while i < len(docs):
        n = 1
        while i + n < len(docs) and (n + 1) * len(docs[i + n][1]) <= GROUP:
            n += 1
        part, t = docs[i : i + n], len(docs[i + n - 1][1])
        x, y, on = np.zeros((n, t, len(FEATURES))), np.zeros((n, t), int), np.zeros((n, t), bool)
        for k, (a, b) in enumerate(part):
            x[k, : len(b)], y[k, : len(b)], on[k, : len(b)] = a, b, True
        groups.append((x, y, on))
        i += n
    total, m, v = sum(len(y) for _, y in docs), np.zeros(len(FEATURES) + 4), np.zeros(len(FEATURES) + 4)
    for step in range(1, rounds + 1):
        grad = np.zeros(len(FEATURES) + 4)
        for x, y, on in groups:
            n, t, _ = x.shape
            score = np.stack([np.zeros((n, t)), x @ emit], axis=2)
            ahead = np.zeros((n, t, 2))
            ahead[:, 0] = score[:, 0]
            for i in range(1, t):
                ahead[:, i] = np.where(on[:, i, None], np.logaddexp(ahead[:, i - 1, :1] + turn[0], ahead[:, i - 1, 1:] + turn[1]) + score[:, i], ahead[:, i - 1])
            whole = np.logaddexp(ahead[:, -1, 0], ahead[:, -1, 1])
            behind = np.zeros((n, t, 2))
            for i in range(t - 2, -1, -1):
                nxt = turn[None] + (score[:, i + 1] + behind[:, i + 1])[:, None, :]
                behind[:, i] = np.where(on[:, i + 1, None], np.logaddexp(nxt[:, :, 0], nxt[:, :, 1]), 0.0)
            p1 = np.where(on, np.exp(np.minimum(ahead[:, :, 1] + behind[:, :, 1] - whole[:, None], 0)), 0.0)
            grad[: len(FEATURES)] += np.einsum("ntf,nt->f", x, np.where(on, y - p1, 0.0))
            pair = np.exp(np.minimum(ahead[:, :-1, :, None] + turn + (score + behind)[:, 1:, None, :] - whole[:, None, None, None], 0)) * on[:, 1:, None, None]
            seen = np.zeros((2, 2))
            np.add.at(seen, (y[:, :-1][on[:, 1:]], y[:, 1:][on[:, 1:]]), 1)
            grad[len(FEATURES) :] += (seen - pair.sum((0, 1))).ravel()
        grad = grad / total - np.concatenate([l2 * emit, l2_turn * turn.ravel()])
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        move = 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        emit, turn = emit + move[: len(FEATURES)], turn + move[len(FEATURES) :].reshape(2, 2)
    return Crf(emit, turn)


def scan(column: pa.Array, known: np.ndarray | None = None) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Base counts of each row; features, words and first index of its lines."""
    data, offsets = tx.raw(column)
    words, lines = tx.word_spans(data, offsets), tx.line_spans(data, offsets)
    wh, lh = tx.span_hashes(data, words.start, words.end), tx.span_hashes(data, lines.start, lines.end)
    line_words = np.searchsorted(words.start, lines.end) - np.searchsorted(words.start, lines.start)
    _, later = tx.repeated(lh, lines.row)
    window, at = tx.windows(wh, words.row, 5)
    twice, _ = tx.repeated(window, words.row[at])
    covered = np.zeros(len(words), bool)
    for j in range(5):
        covered[at[twice] + j] = True
    points = np.zeros(len(data) + 1, np.int64)
    np.cumsum(((data & 0xC0) != 0x80) & ~tx.SPACE[data], out=points[1:])
    base = {
        "n_words": words.first[1:] - words.first[:-1],
        "word_chars": points[offsets[1:]] - points[offsets[:-1]],
        "n_symbols": tx.row_sums(SYMBOLS[data], offsets),
        "n_dup_lines": tx.row_sums(later & (line_words > 0), lines.first),
        "n_repeat_words": tx.row_sums(covered, words.first),
    }

    def per_line(flags: np.ndarray) -> np.ndarray:
        total = np.zeros(len(data) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return total[lines.end] - total[lines.start]

    def words_of_line(flags: np.ndarray) -> np.ndarray:
        total = np.zeros(len(words) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        lo = np.searchsorted(words.start, lines.start)
        return total[lo + line_words] - total[lo]

    echo = np.zeros(len(words), bool)
    echo[1:] = (wh[1:] == wh[:-1]) & (words.row[1:] == words.row[:-1])
    symbols, digits, size = per_line(SYMBOLS[data]), per_line(DIGITS[data]), np.maximum(lines.end - lines.start, 1)
    pipes, again, covers, n = per_line(data == 124), words_of_line(echo), words_of_line(covered), np.maximum(line_words, 1)
    padded = np.append(data, 32)
    lo = np.searchsorted(words.start, lines.start)
    head = np.append(words.start, len(data))[np.minimum(lo, len(words))]
    tail = np.append(words.end, 0)[lo + line_words - 1] - 1
    some = line_words > 0
    x = np.stack(
        [np.ones(len(lines)), ~some, some & (line_words < 4), line_words > 40, symbols > 0, 5 * symbols > n, pipes > 1]
        + [some & MARKS[padded[np.where(some, tail, len(data))]], some & ((padded[head] - 65 < 26) | (padded[head] >= 0xC3)), 4 * digits > size, later & some]
        + [again > 0, 2 * again > n, covers > 0, 2 * covers > n, size > 14 * n, (lines.first[1:] - lines.first[:-1])[lines.row] > 8, some & np.isin(lh, known if known is not None else [])],
        axis=1,
    ).astype(np.float64)
    return base, x, line_words, lines.first


def line_hashes(text: str) -> np.ndarray:
    """Hashes of a text's lines of 1 to ``SHORT`` words."""
    data, offsets = tx.raw(pa.array([text], pa.string()))
    words, lines = tx.word_spans(data, offsets), tx.line_spans(data, offsets)
    n = np.searchsorted(words.start, lines.end) - np.searchsorted(words.start, lines.start)
    some = (n > 0) & (n <= SHORT)
    return tx.span_hashes(data, lines.start[some], lines.end[some])


def known_lines(texts: list[str]) -> np.ndarray:
    """Sorted hashes of lines that ``KNOWN`` or more families of texts hold; copies of a text are one family."""
    family = families([set(t.encode().split()) for t in texts])
    pairs = {(h, f) for t, f in zip(texts, family) for h in set(line_hashes(t).tolist())}
    return np.array(sorted(h for h, n in Counter(h for h, _ in pairs).items() if n >= KNOWN), np.uint64)


def train(docs: DataFrame, labels: DataFrame, max_train_docs: int = 700, max_train_lines: int = 60_000, max_doc_lines: int = 2_000) -> Crf:
    """Fit the CRF on a bounded sample of documents with a quality label."""
    return fit(labelled_sample(docs, labels, "quality", max_train_docs), max_train_lines, max_doc_lines)


def fit(rows: list[tuple[int, str, int]], max_train_lines: int = 60_000, max_doc_lines: int = 2_000) -> Crf:
    """``rows`` are (id, text, label)."""
    known, found, lines = known_lines([t for _, t, _ in rows]), [], 0
    for _, text, label in rows:
        part = "\n".join(text.split("\n", max_doc_lines)[:max_doc_lines])
        _, x, _, _ = scan(pa.array([part], pa.string()), known)
        if lines + len(x) <= max_train_lines:
            boilerplate = x[:, [FEATURES.index("repeats_line"), FEATURES.index("known_line")]].any(axis=1)
            found.append((x, np.where(boilerplate, 0, label)))
            lines += len(x)
    crf = fit_crf(found)
    crf.known = known
    parts = [judge_part(pa.array([t], pa.string()), crf) for _, t, _ in rows]
    crf.min_share = best_share([float(p["content_share"][0]) for p in parts if not p["base_failed"][0]], [label for p, (_, _, label) in zip(parts, rows) if not p["base_failed"][0]])
    return crf


def best_share(shares: list[float], labels: list[int]) -> float:
    """The least content share of a kept document: of the cuts that part the labels within a hundredth of the best, both labels
    weighing the same, the lowest, so that good documents stay; 0.5 at most."""
    if len({*labels}) < 2:
        return 0.5
    share, good = np.array(shares), np.array(labels) == 1
    values = np.unique(share)
    cuts = np.concatenate([[0.0], (values[1:] + values[:-1]) / 2])
    right = np.array([(share[good] >= c).mean() + (share[~good] < c).mean() for c in cuts])
    return float(min(0.5, cuts[right >= right.max() - 0.01].min()))


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
DECISIONS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_lines long, content_lines long, content_share double"


def judge_part(column: pa.Array, crf: Crf) -> dict[str, np.ndarray]:
    """The decisions on each text of a column."""
    base, x, words, first = scan(column, crf.known)
    n, repeats = base["n_words"], base["n_repeat_words"]
    failed = (n < 10) | (100 * repeats > 20 * n)
    content, share = np.zeros(len(n), np.int64), np.zeros(len(n))
    for i, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
        path = np.array(crf.viterbi(x[a:b]), dtype=bool)
        content[i], share[i] = path.sum(), words[a:b][path].sum() / max(n[i], 1)
    return base | {"base_failed": failed, "kept": ~failed & (share >= crf.min_share), "n_lines": np.diff(first), "content_lines": content, "content_share": share}


def line_quality(docs: DataFrame, crf: Crf, keep: list[str]) -> DataFrame:
    """Decision columns for every row of ``docs``, after its columns ``keep``."""
    names = [field.split()[0] for field in DECISIONS.split(", ")]
    if clash := {c.lower() for c in keep} & {*names}:
        raise ValueError(f"columns to keep bear names of decisions: {sorted(clash)}")
    schema = docs.select(*keep).schema
    for decision in DECISIONS.split(", "):
        schema = schema.add(*decision.split())
    only_text = keep if "text" in keep else [*keep, "text"]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tx.slices(batch):
                made = judge_part(part.column("text"), crf)
                yield pa.RecordBatch.from_arrays([part.column(c) for c in keep] + [pa.array(made[c]) for c in names], names=[f.name for f in schema])

    return map_texts(docs.select(*only_text), judge, schema)


def good_documents(docs: DataFrame, crf: Crf) -> DataFrame:
    """The rows of ``docs`` that are kept, with just its columns."""

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tx.slices(batch):
                yield part.filter(pa.array(judge_part(part.column("text"), crf)["kept"]))

    return map_texts(docs, choose, docs.schema)


def mark_lines(docs: DataFrame, crf: Crf) -> DataFrame:
    """One row per line: doc_id, line number, the line and whether it is content."""
    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tx.slices(batch):
                texts = pc.fill_null(part.column("text"), "").to_pylist()
                _, x, _, first = scan(part.column("text"), crf.known)
                marks = [crf.viterbi(x[a:b]) for a, b in zip(first[:-1], first[1:])]
                rows = [(i, k, s, m) for i, t, path in zip(part.column("doc_id").to_pylist(), texts, marks) for k, (s, m) in enumerate(zip(t.split("\n"), path))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.string(), pa.bool_()))], names=["doc_id", "line", "content", "is_content"])

    return map_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), lines, "doc_id long, line long, content string, is_content boolean")
