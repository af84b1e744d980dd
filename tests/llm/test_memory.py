"""What a worker holds at once: batches of texts, and words that packing remembers."""

import numpy as np
import pyarrow as pa
import public_tokenizers
from tokenizers import Tokenizer

from fieldwise.llm import line_quality, packing

BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def test_texts_go_to_workers_in_small_batches(spark):
    def batch_sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows], "size": [batch.nbytes]})

    docs = spark.range(0, 4000, 1, 1).selectExpr("id doc_id", "repeat(concat(md5(string(id)), ' '), 128) text").localCheckpoint()
    crf = line_quality.Crf(np.zeros(len(line_quality.FEATURES)), np.zeros((2, 2)))
    try:
        spark.conf.unset(BYTES)
        assert line_quality.line_quality(docs, crf, ["doc_id"]).select("doc_id").distinct().count() == 4000
        sizes = docs.mapInArrow(batch_sizes, "n long, size long").collect()
        assert sum(r.n for r in sizes) == 4000 and max(r.size for r in sizes) < 4_000_000  # 17 MB in all
        spark.conf.set(BYTES, "5m")
        assert line_quality.good_documents(docs, crf).count() == 0  # words that repeat
        assert spark.conf.get(BYTES).lower() in ("5m", "5242880b")  # a size that the session names stays
    finally:
        spark.conf.unset(BYTES)


def test_packing_remembers_few_words(monkeypatch):
    monkeypatch.setattr(packing, "MEMO", 50)
    path = public_tokenizers.path("word_bpe_49k.json")
    words, library = packing.Words(path), Tokenizer.from_file(path)
    for k in range(12):
        texts = [" ".join(["the", "same", *(f"Wort{40 * k + 10 * t + i}é" for i in range(10))]) for t in range(4)]
        for text, ids in zip(texts, words.encode([t.encode() for t in texts])):
            assert ids.tolist() == library.encode(text, add_special_tokens=False).ids
        assert len(words) <= 2 * 50 + 42
    assert b"the" in words and b"same" in words  # frequent ones stay


def test_packing_takes_words_apart_as_the_library_does():
    path = public_tokenizers.path("word_bpe_49k.json")
    words, library, rng = packing.Words(path), Tokenizer.from_file(path), np.random.default_rng(7)
    alphabets = ["'strevmld'S!.", "abcdefghijklmnopqrstuvwxyzABZ", "0123456789a,", "".join(map(chr, range(33, 127))), "ÀÖØÞßàöøÿ×÷µªº²aB'", "ΑΣσςİıſKÅﬁ中文́̈ \x85\x1c\x00\x7f“”…<|>a'"]
    odd = ["<|endoftext|>", "a<|startoftext|>b", "<|END", "it's", "'S'll'''s", "!'s", "Å", "́a", "", "x" * 3000, "###", "naïve", "STRASSEẞ", " ", "a b"]
    for start in range(40):
        made = ["".join(rng.choice(list(alphabets[(start + k) % 6 if start % 2 else start % 4]), rng.integers(1, 14))) for k in range(60)]
        texts = [" ".join(made[:30]), "\n\t " + "\x0b".join(made[30:]) + " \r\f", " ".join(odd) if start % 3 == 2 else "", " ", made[0]]
        for text, ids in zip(texts, words.encode([t.encode() for t in texts]), strict=True):
            assert ids.tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_packing_looks_distinct_words_up_once_and_plain_ones_cost_no_full_pass():
    class Counted(packing.Words):
        looked_up = 0

        def get(self, *args):
            self.looked_up += 1
            return super().get(*args)

    path = public_tokenizers.path("word_bpe_49k.json")
    words, text = Counted(path), "It's the Élève's 25th, " * 1000
    expected, words.tokenizer = words.tokenizer.encode(text, add_special_tokens=False).ids, None
    assert [x.tolist() for x in words.encode([text.encode(), b"the"])] == [expected, words.encode([b"the"])[0].tolist()]
    assert words.looked_up == 4 + 1 + 1  # four words, the empty one after the last blank, and "the" again
