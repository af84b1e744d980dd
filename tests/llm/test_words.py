"""Token ids by the trie, phrases and periodic runs, against the tokenizers library, SQL and brute force."""

import hashlib
import random
from array import array
from collections import Counter
from zlib import crc32

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

import __spark_entry__ as entry
from fieldwise.llm import bpe_trie, periodic_runs, phrase_mining

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
ODD = "doc_id long, text string, lang string, key string, n long, __part string"


@pytest.fixture(scope="module")
def codec():
    return bpe_trie.Codec(*bpe_trie.load(VOCABULARY))


@pytest.fixture(scope="module")
def library():
    made = Tokenizer.from_file(VOCABULARY)
    made.no_truncation()
    made.no_padding()
    return made


def same_ids(codec, library, texts):
    for text, ids, want in zip(texts, codec.encode(texts), library.encode_batch(texts, add_special_tokens=False)):
        assert array("I", ids).tolist() == want.ids
        assert codec.decode(ids) == library.decode(want.ids, skip_special_tokens=False)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from("abeth 's\n\t.<|>"), st.characters(exclude_categories=["Cs"])), max_size=80), max_size=6))
def test_trie_ids_equal_the_library(codec, library, texts):
    same_ids(codec, library, texts)


def test_trie_odd_texts(codec, library):
    parts = ["a", "the", "ing", " ", "  ", "\n", "'s", "12", "<|endoftext|>", "<|end", "é", "日本", "😀", " ", "==", "\r\n"]
    r = random.Random(5)
    same_ids(codec, library, ["".join(r.choice(parts) for _ in range(r.randint(0, 60))) for _ in range(300)])
    same_ids(codec, library, ["", "a" * 4000, " " * 3000, "=" * 2000, "ab" * 1500, "日本" * 700, "<|endoftext|>" * 3])


def test_trie_begins_anew(library, monkeypatch):
    for name, most in (("NODES", 30), ("WORDS", 10), ("PAIRS", 20)):
        monkeypatch.setattr(bpe_trie, name, most)
    own = bpe_trie.Codec(*bpe_trie.load(VOCABULARY))
    r = random.Random(6)
    for _ in range(20):
        same_ids(own, library, [" ".join("".join(r.choice("abcdest") for _ in range(r.randint(1, 9))) for _ in range(12)) for _ in range(4)])


def test_trie_shares_prefixes(codec):
    own = bpe_trie.Trie(codec.words)
    own.encode({b"national", b"nation", b"nations"})
    assert len(own.token) == 1 + len("national") + 1  # one node more for the other ending


def test_trie_rows(spark, library):
    docs = spark.createDataFrame([(1, "One word, two.", "en", "k", 1, "p"), (1, "One word, two.", "en", "k", 1, "p"), (None, None, None, None, None, None), (3, "", None, None, None, None)], ODD)
    got = sorted(tuple(r) for r in bpe_trie.bpe_digests(docs, VOCABULARY).where("doc_id IS NOT NULL").collect())
    ids = library.encode("One word, two.", add_special_tokens=False).ids
    digest = lambda b: hashlib.sha256(b).hexdigest()
    row = (1, len(ids), digest(array("I", ids).tobytes()), digest(b"One word, two."))
    assert got == [row, row, (3, 0, digest(b""), digest(b""))]
    assert [r["ids"] for r in bpe_trie.bpe_encode(docs, VOCABULARY).where("doc_id = 1").collect()] == [ids, ids]
    assert bpe_trie.bpe_digests(docs.limit(0), VOCABULARY).count() == 0


def test_trie_query(spark, sf_dir, library):
    rows = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    for r in entry.queries()["op11_bpe_trie"](spark, sf_dir).collect():
        ids = library.encode(rows[r["doc_id"]], add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(array("I", ids).tobytes()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def brute_runs(w):
    out = []
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            stretch = w[i : j + q]
            if j > i and len(stretch) >= max(12, 2 * q) and all(any(a != b for a, b in zip(stretch, stretch[p:])) for p in range(1, q)):
                out.append((i, len(stretch), q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def periodic_text(r):
    k, n = r.choice([1, 2, 3, 5, 40]), r.randint(0, 110)
    w = [b"%d" % r.randint(0, k) for _ in range(n)]
    if n > 4 and r.random() < 0.7:
        a = r.randint(0, n - 1)
        p = r.randint(1, max(1, (n - a) // 2))
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)] + [b"%d" % r.randint(0, k) for _ in range(r.randint(0, 25))]
    return w


@pytest.mark.parametrize("seed", range(4))
def test_runs_equal_brute_force(seed):
    r = random.Random(seed)
    for _ in range(150):
        texts = [periodic_text(r) for _ in range(r.randint(0, 5))]
        assert periodic_runs.runs_of(texts) == [brute_runs(t) for t in texts]


def test_long_runs():
    r = random.Random(9)
    block = [b"%d" % r.randint(0, 400) for _ in range(3000)]
    words = [b"x"] * 40 + block * 3 + block[:100] + [b"y%d" % i for i in range(500)]
    assert periodic_runs.runs_of([words]) == [[(0, 40, 1), (40, 9100, 3000)]]


def test_splitting_leaves_whole_runs():
    r = random.Random(10)
    words = [b"w%d" % i for i in range(30)] + [b"a", b"b", b"c"] * 5 + [b"v%d" % i for i in range(30)]
    assert periodic_runs.runs_of([words]) == [[(30, 15, 3)]]
    assert periodic_runs.runs_of([[b"w%d" % r.randint(0, 10**6) for _ in range(200)]]) == [[]]


def test_runs_query(spark, sf_dir):
    rows = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    got = entry.queries()["op13_periodic_runs"](spark, sf_dir).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(rows)
    for r in got:
        w = periodic_runs.WORD.findall((rows[r["doc_id"]] or "").encode())
        h, n = crc32(str(r["doc_id"]).encode()), len(w)
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = brute_runs(w) if n < 1500 else periodic_runs.runs_of([w])[0]
        assert r["n_runs"] == len(runs)
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=None)
        assert (r["start"], r["length"], r["period"]) == (best or (None,) * 3)
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if best else None)
        gone = {i for s, length, q in runs for i in range(s + q, s + length)}
        assert r["collapsed_sha256"] == hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest()
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{length},{q}\n" for s, length, q in runs).encode()).hexdigest()


def test_runs_rows(spark):
    docs = spark.createDataFrame([(1, " ".join("a" * 16), "en", "k", 1, "p"), (None, " ".join("a" * 16), None, None, None, None), (3, None, None, None, None, None), (3, None, None, None, None, None)], ODD)
    got = sorted((tuple(r)[:6] for r in periodic_runs.periodic_runs(docs).collect()), key=str)
    none, run = (0, None, None, None, None), (1, 0, 16, 1, 16000)
    assert got == [(1, *run), (3, *none), (3, *none), (None, *run)]
    spread = spark.createDataFrame([(1, " ".join(["a", "b"] * 8)), (None, " ".join(["a", "b"] * 8))], "doc_id long, text string")
    assert sorted((tuple(r)[:6] for r in periodic_runs.periodic_runs(spread, plant=True).collect()), key=str)[-1] == (None, 1, 0, 16, 2, 8000)
    assert periodic_runs.periodic_runs(docs.limit(0)).count() == 0


def brute_phrases(rows, least, top):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else "\n" if c in ".,;:!?\n\x0b\x0c\r" else " " if c == "\t" else c for c in text or "")
        for piece in folded.split("\n"):
            w = [x for x in piece.split(" ") if x]
            n[lang] += len(w)
            for k in range(1, 6):
                f.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    often = {p: c for p, c in f.items() if c >= least}
    out = []
    for (lang, p), a in often.items():
        if len(p) < 2:
            continue
        cuts = [(1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
        inside = any(x == lang and len(q) > len(p) and c >= a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for (x, q), c in often.items())
        if not inside:
            score, k = min(cuts)
            out.append((lang, " ".join(p), a, f[lang, p[:k]], f[lang, p[k:]], n[lang], score))
    ranked = []
    for lang in {r[0] for r in out}:
        own = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))[:top]
        ranked += [(lang, i + 1, *r[1:]) for i, r in enumerate(own)]
    return sorted(ranked)


@pytest.mark.parametrize(("seed", "share", "least"), [(1, 0.5, 6), (2, 0.1, 5), (3, 1.0, 4)])
def test_phrases_equal_brute_force(spark, seed, share, least):
    r = random.Random(seed)
    vocabulary = ["A", "b", "c d", "the", "Ünder", "x\ty", "of", "one", "ﬁ", "z."]
    rows = [(r.choice(["en", "d e", None, "l\nf"]), "".join(r.choice(vocabulary) + r.choice([" ", " ", "  ", ", ", "\n"]) for _ in range(r.randint(0, 60)))) for _ in range(120)] + [("en", None), ("en", "")] + [("de", "same words here again")] * 9
    docs = spark.createDataFrame([(i, t, lang, "k", 1, "p") for i, (lang, t) in enumerate(rows)], ODD)
    for top in (2000, 7):
        got = sorted(tuple(x) for x in phrase_mining.collocations(docs, least, top, share).collect())
        assert got == brute_phrases(rows, least, top)
    assert phrase_mining.collocations(docs.limit(0), least).count() == 0


def test_missed_phrases_are_found_by_a_further_pass(spark):
    """A sample without any document proposes nothing: words fail, and all that holds them is counted."""
    docs = spark.createDataFrame([(i, "one two three four five six" if i % 2 else "rare%d one two, six" % i, "en") for i in range(80)], "doc_id long, text string, lang string")
    first, second = phrase_mining.frequent(docs, 30, 0.0)
    assert [tuple(r) for r in first.collect()] == [("en\n", 40 * 6 + 40 * 4)]
    keys = {r["key"]: r["n"] for r in second.collect()}
    assert len(keys) == 6 + 5 + 4 + 3 + 2 and keys["en\ntwo three four five six"] == 40 and keys["en\none two"] == 80
    assert len(phrase_mining.frequent(docs, 30, 1.0)) == 1


def test_long_texts_are_cut_between_pieces(monkeypatch):
    monkeypatch.setattr(phrase_mining, "SLICE", 10)
    text = b"one two three. four five six seven eight nine ten, a b c d e f g h"
    parts = list(phrase_mining.pieces_of(text))
    assert b"".join(parts) == text and len(parts) > 1 and all(p[-1:] in b".," for p in parts[:-1])


def test_phrase_query_equals_sql(spark, sf_dir, duck, same):
    same(entry.queries()["op12_collocations"](spark, sf_dir), duck, entry.oracle_sql()["op12_collocations"])
