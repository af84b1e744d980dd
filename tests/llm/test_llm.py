import hashlib
import json
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from fieldwise.llm import bpe_count, chat_format, exact_dedup, language_id, line_quality, mixing, near_dedup, packing, queries, toxicity, url_rules
from fieldwise.llm import text as tx
from fieldwise.llm.common import labelled_sample, stored
from fieldwise.llm.components import connected_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, digest string"
ODD = [
    (1, None, "en", "src1", 0, "x", "y"), (2, "", None, None, None, None, None), (3, " \n\t", "en", "src0", 3, None, None), (4, "a b c d", "en", "src0", 7, None, None), (4, "a b c d", "en", "src0", 7, None, None),
    (5, "a  b\nc d", "fr", None, 8, None, None), (6, "word " * 30_000, "de", "src9", 1, None, None), (7, "x" * 50_000, "de", "src9", 1, None, None), (8, "é ÀÉ 123 <|endoftext|> i.d.i.o.t", "xx", "src5", 5, None, None),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(name, spark, sf_dir, duck, same):
    same(queries.QUERIES[name](spark, sf_dir), duck, queries.ORACLES[name])


def words_of(text):
    return (text or "").encode().split()


def test_line_quality_counts(spark, sf_dir, docs):
    got = {r.doc_id: r for r in queries.op1_line_quality(spark, sf_dir).collect()}
    for r in docs.collect():
        words, mine = words_of(r.text), got[r.doc_id]
        windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
        covered = {i + j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(5)}
        lines = (r.text or "").split("\n")
        dup = sum(1 for i, x in enumerate(lines) if words_of(x) and x in lines[:i])
        assert (mine.n_words, mine.word_chars, mine.n_symbols, mine.n_dup_lines, mine.n_repeat_words) == (len(words), sum(len(w.decode()) for w in words), sum(r.text.count(c) for c in "#*$%&|<>"), dup, len(covered))
        assert mine.base_failed == (len(words) < 10 or 100 * len(covered) > 20 * len(words)) and (not mine.kept or not mine.base_failed)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").collect()
    good = [got[r.doc_id].kept for r in labels if r.quality == 1 and not got[r.doc_id].base_failed]
    assert np.mean(good) > 0.95


def test_viterbi_equals_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(50):
        crf = line_quality.Crf(rng.normal(size=3), rng.normal(size=(2, 2)))
        x = rng.normal(size=(6, 3))
        e = x @ crf.emit
        value = lambda p: sum(e[i] for i in range(6) if p[i]) + sum(crf.turn[p[i], p[i + 1]] for i in range(5))
        paths = [[(n >> i) & 1 for i in range(6)] for n in range(64)]
        assert value([int(s) for s in crf.viterbi(x)]) == pytest.approx(max(map(value, paths)))


def test_boilerplate_lines_of_a_good_document():
    """A license that unrelated documents end with, and a repeated line, are boilerplate; so transitions see both labels in one document."""
    rng = np.random.default_rng(8)
    word = lambda: "".join(rng.choice(list("aeioulnrst"), rng.integers(2, 9)))
    sentence = lambda: " ".join(word() for _ in range(12)).capitalize() + "."
    license_line, menu = "Licensed under the Plain License, Version 2.0.", "Home | News | Contact"
    good = lambda: "\n".join([*(sentence() for _ in range(8)), menu, sentence(), menu, license_line])
    bad = lambda: "\n".join(" ".join(f"{word()}$$$ |" for _ in range(6)) for _ in range(10))
    rows = [(i, good() if i % 2 else bad(), i % 2) for i in range(80)]
    crf = line_quality.fit(rows)
    text = good()
    _, x, _, _ = line_quality.scan(pa.array([text]), crf.known)
    assert crf.viterbi(x) == [line not in (menu, license_line) for line in text.split("\n")]
    judged = line_quality.judge_part(pa.array([good(), bad(), "\n".join([license_line] * 2)]), crf)
    assert judged["kept"].tolist() == [True, False, False] and np.abs(crf.turn).max() > 0


def test_line_model_trains_in_bounded_memory():
    import tracemalloc

    rows = [(1, "one line of words\n" * 50_000, 0)] + [(i, f"Some {i} words of a good line here.\nAnd {i} more of them there.", i % 2) for i in range(2, 40)]
    tracemalloc.start()
    line_quality.fit(rows)
    assert tracemalloc.get_traced_memory()[1] < 200e6
    tracemalloc.stop()


def test_quality_stage_with_clashing_columns(spark, odd):
    labels = spark.createDataFrame([(4, 1, 0), (8, 0, 1)], "doc_id long, quality int, toxic int")
    crf = line_quality.train(odd, labels)
    clash = odd.withColumn("n_words", F.lit(1))
    with pytest.raises(ValueError):
        line_quality.line_quality(clash, crf, clash.columns)
    kept = line_quality.good_documents(clash, crf)
    judged = line_quality.line_quality(odd, crf, ["doc_id"])
    assert kept.columns == clash.columns and kept.count() == judged.where("kept").count()


def test_url_ties_long_urls_and_many_ranges(spark):
    """Equal lengths: the longer host wins. Ranges follow the partitions, and one very hot host fills them all."""
    rules = spark.createDataFrame([("ab.org", "/", "block"), ("org", "/xyz", "allow"), ("hot.com", "/", "block")], "host string, path string, verdict string")
    rows = [(0, "http://ab.org/xyz"), (1, "http://c.ab.org/x" + "y" * 200_000)] + [(i, f"http://{'hot.com' if i % 3 else f's{i}.net'}/{i}") for i in range(2, 6000)]
    pages = spark.createDataFrame(rows, "page_id long, url string").repartition(4)
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "100")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        made = url_rules.url_rules(pages, rules)
        got = {r.page_id: (r.rule, r.verdict) for r in made.collect()}
        used = made.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert got[0] == ("ab.org/", "block") and got[1] == ("ab.org/", "block") and len(got) == 6000
    assert all(got[i] == (("hot.com/", "block") if i % 3 else (None, "allow")) for i in range(2, 6000))
    assert len(used) > 90 and max(r["count"] for r in used) < 300


def test_url_rules_by_hand(spark):
    urls = ["http://A.Example.NET/en/x", "http://example.net/de", "http://example.com/de/a?b", "http://x.example.com/fr/", "ftp://a.org/fr/#", "http://net/", "http://net", "http://evilnet/", "nourl", None, "http://example.net./en/", "x://a..net/"]
    pages = spark.createDataFrame([(i, u, "junk") for i, u in enumerate(urls)] + [(0, urls[0], "junk")], "page_id long, url string, host string")
    rules = spark.createDataFrame([*url_rules.RULES, ("net", "/", "block"), (None, "/", "block")], "host string, path string, verdict string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_rules.url_rules(pages, rules).collect()}
    assert [got[i][0] for i in range(12)] == ["example.net/en/", "net/", "example.com/de/", None, "org/fr/", "net/", None, None, None, None, None, "net/"]
    assert [got[i][1] for i in range(12)] == ["allow", "block", "block", "allow", "allow", "block", "allow", "allow", "allow", "allow", "allow", "block"]
    assert url_rules.url_rules(pages, rules).count() == 13 and url_rules.url_rules(pages.limit(0), rules).count() == 0


def test_chat_round_trip(spark):
    tricky = ["\\### Assistant: </turn> ok", "\\b\\h\\l", "a\\", "", None, "</turn>\n### x\n#", "\n#"]
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", t, "x") for i, t in enumerate(tricky)] + [(2, 0, "user", "q", "x"), (2, 1, "assistant", "a", "x"), (3, 0, None, None, "x"), (None, 0, "assistant", "z", "x"), (2, 2, "we#ird\n", "w", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    made = chat_format.chat_format(df)
    got = {r.conv_id: r for r in made.select("*", chat_format.read_back(F.col("formatted")).alias("turns"), chat_format.masked_text(F.col("segments")).alias("m")).collect()}
    for conv in (1, 2, 3, None):
        mine = sorted(((r[1], r[2] or "", r[3] or "") for r in rows if r[0] == conv))
        assert [(t.role, t.text) for t in got[conv].turns] == [x[1:] for x in mine]
        assert got[conv].m == "".join(x[2] for x in mine if x[1] == "assistant")
    assert not got[2].valid and not got[3].valid and chat_format.chat_digests(df.limit(0)).count() == 0


def test_chat_of_long_texts_and_odd_templates(spark):
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", f"#{i} <b> \\" * (20_000 if i < 2 else 1)) for i in range(2000)] + [(2, None, "user", "first"), (2, 1, "assistant", "second")]
    got = {r.conv_id: r for r in chat_format.chat_digests(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    answers = "".join(t for c, _, role, t in rows if c == 1 and role == "assistant")
    assert got[1].n_turns == 2000 and got[1].loss_chars == len(answers) and got[1].loss_sha256 == hashlib.sha256(answers.encode()).hexdigest()
    assert got[2].valid and got[2].loss_chars == 6
    dotted = chat_format.Template(opening="[.", after_role=".]", closing="[..*]", escapes=(("\\", "\\b"), (".", "\\d")))
    made = chat_format.chat_format(spark.createDataFrame([(1, 0, "user", "a.b[..*]"), (1, 1, "assistant", "\\d.")], "conv_id long, turn long, role string, text string"), dotted)
    assert [(t.role, t.text) for t in made.select(chat_format.read_back(F.col("formatted"), dotted).alias("t")).first().t] == [("user", "a.b[..*]"), ("assistant", "\\d.")]
    for wrong in (dict(closing="END"), dict(escapes=(("#", "\\h"), ("<", "\\l"))), dict(escapes=(("\\", "\\#"), ("#", "\\h"), ("<", "\\l")))):
        with pytest.raises(ValueError):
            chat_format.Template(**wrong)


def test_mix_shortage_goes_to_siblings_first(spark):
    plan = mixing.Plan(domains={"web": 0.5, "books": 0.5}, languages={"en": 0.5, "de": 0.5}, share=1.0, max_epochs=1)
    leaves = spark.createDataFrame([("web", "en", "s", 1, 10), ("web", "de", "s", 1, 100), ("books", "en", "s", 1, 100), ("books", "de", "s", 1, 100)], "domain string, lang string, source string, docs long, tokens long")
    got = {(r.domain, r.lang): r.leaf_budget for r in mixing.budgets(leaves, mixing.Plan(**{**plan.__dict__, "share": 0.5})).collect()}
    assert got == {("web", "en"): 10, ("web", "de"): 67, ("books", "en"): 38, ("books", "de"): 38}


def labelled(sf):
    docs = pq.read_table(f"{sf}/documents.parquet", columns=["doc_id", "text", "lang"]).to_pylist()
    toxic = {r["doc_id"]: r["toxic"] for r in pq.read_table(f"{sf}/labels.parquet").to_pylist()}
    return [(r["doc_id"], r["text"], toxic[r["doc_id"]], r["lang"]) for r in docs if toxic.get(r["doc_id"]) is not None and r["text"]]


def is_held(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


@pytest.mark.parametrize("sf,least", [("sf0.01", 0.5), ("sf0.1", 0.8)])
def test_toxicity_held_out(spark, sf, least):
    """sf0.01 has 37 toxic rows to learn from; sf0.1 enough that calibration has nearly separable labels. Part of both labels is noise."""
    sf = f"/root/testdata/{sf}"
    got = {r.doc_id: r for r in queries.op5_toxicity(spark, sf).collect()}
    held = [r for r in labelled(sf) if is_held(r[0])]
    assert all(got[r[0]].held_out for r in held) and all(0 <= r.score <= 1 for r in got.values())
    hit, clean = [got[r[0]].predicted for r in held if r[2]], [got[r[0]].predicted for r in held if not r[2]]
    assert np.mean(hit) > least and np.mean(clean) < 0.03


def test_toxicity_of_altered_insults(spark):
    """Each kind of single alteration of insults, in clean sentences, is found; clean texts are left alone."""
    sf = "/root/testdata/sf0.1"
    model = toxicity.train(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"), where=~queries.held_out(4, 2)).prepare()
    held = [r for r in labelled("/root/testdata/sf0.1") if is_held(r[0]) and not r[2] and r[3] == "en" and len(r[1]) < 1500][:12]
    rng = np.random.default_rng(5)
    place = lambda w: int(rng.integers(1, len(w)))
    letter = lambda: chr(97 + int(rng.integers(26)))
    kinds = {
        "plain": lambda w, i: w, "mark": lambda w, i: w[:i] + "." + w[i:], "spaced": lambda w, i: " ".join(w), "capitals": lambda w, i: w.upper() + "!",
        "inserted": lambda w, i: w[:i] + letter() + w[i:], "doubled": lambda w, i: w[:i] + w[i - 1] + w[i:], "dropped": lambda w, i: w[:i] + w[i + 1 :], "masked": lambda w, i: w[:i] + "*" + w[i + 1 :],
        "dashed": lambda w, i: "-".join(w), "cut": lambda w, i: w[:i] + " " + w[i:], "cut twice": lambda w, i: w[:1] + " " + w[1:3] + "  " + w[3:] + ".",
    }
    insults = "idiot moron scum clown trash pathetic worthless stupid loser disgusting".split()
    for name, change in kinds.items():
        texts = [f"{r[1]} ononly {change(w, place(w))} thea." for w in insults for r in held]
        found = (model.scores(pa.array(texts)) >= 0.3).reshape(len(insults), -1).mean(axis=1)
        assert found.mean() >= 0.8, (name, dict(zip(insults, found)), model.scale, model.robust)
    assert (model.scores(pa.array([r[1] for r in held])) >= 0.3).mean() == 0


def brute_kernel(a, b):
    """The gap-weighted kernel of two windows by a loop over all triples."""
    def triples(w):
        w, out = bytes([1]) + w + bytes([3]), defaultdict(float)
        for i in range(len(w)):
            for j in range(i + 1, len(w)):
                for k in range(j + 1, min(len(w), i + toxicity.SPAN)):
                    if 2 not in (w[i], w[j], w[k]):
                        out[w[i], w[j], w[k]] += toxicity.DECAY ** (k - i + 1)
        return out

    x, y = triples(a), triples(b)
    dot = lambda p, q: sum(v * q.get(u, 0) for u, v in p.items())
    return dot(x, y) / max((dot(x, x) * dot(y, y)) ** 0.5, 1e-9)


def joined_neighbours(words, longest):
    """Two and three neighbouring words, without marks at their edges, as one."""
    bare = [w.strip(b"\x02") or b"\x02" for w in words]
    return [b"".join(bare[i : i + n]) for n in (2, 3) for i in range(len(bare) - n + 1) if sum(map(len, words[i : i + n])) + n - 1 <= longest + 2 * n]


def test_toxicity_kernel_equals_a_double_loop():
    rng = np.random.default_rng(12)
    random_word = lambda: bytes(rng.choice(np.frombuffer(b"abcde\x02", np.uint8), rng.integers(2, 9)))
    marks, others = [random_word() for _ in range(12)], [random_word() for _ in range(150)]
    got = toxicity.Landmarks(marks).of(others)
    for i, w in enumerate(others):
        own = [brute_kernel(w, m) for m in marks]
        if max(own) >= toxicity.LEAST:
            assert got[i] == pytest.approx([k**toxicity.DEGREE for k in own], abs=1e-5)
        else:
            assert (got[i] == 0).all() or got[i] == pytest.approx([k**toxicity.DEGREE for k in own], abs=1e-5)
    model = toxicity.Model(marks, 12, set(), set(), rng.normal(size=12).astype(np.float32), -1.0, (1.0, 0.0)).prepare()
    data, start, end = toxicity.as_spans(others)
    assert model.margins(data, start, end) == pytest.approx(got @ model.direction - 1.0, abs=1e-5)
    texts = [b" ".join(others[i : i + 5]).decode() for i in range(0, 150, 5)] + ["", "a i d i o t b"]
    worst = model.worst(pa.array(texts))
    for k in range(30):
        mine = others[5 * k : 5 * k + 5]
        cut = [v for v in joined_neighbours(mine, max(map(len, marks))) if any(brute_kernel(v, m) >= toxicity.CLOSE for m in marks)
               and any(v[:2] == m[:2] for m in marks if len(m) > 2) and any(v[-2:] == m[-2:] for m in marks if len(m) > 2)]
        assert worst[k] == pytest.approx(max(-1.0, model.margins(*toxicity.as_spans(mine + cut)).max()), abs=1e-5)
    assert worst[30] == -1.0


def test_insults_cut_by_blanks_or_in_long_words():
    """Neighbouring words count together only where they come close to a landmark; a piece's end hides no landmark of ``OVERLAP`` bytes."""
    model = toxicity.Model([b"worthless", b"idiot", b"wo"], 2, set(), set(), np.array([2.0, 2.0, 0.0], np.float32), -1.0, (1.0, 0.0)).prepare()
    worst = lambda *texts: model.worst(pa.array(list(texts))).tolist()
    assert worst("such an id iot!", "a (WORTH less) one", "wor th \n less", "i diot", "idio t") == pytest.approx([1.0] * 5, abs=0.1)
    assert worst("id", "wo", "", None, "id riot", "ideas iot", "iot id", "id and iot", "worthy unless") == pytest.approx([-1.0] * 9, abs=0.35)
    assert worst("id", "iot") == pytest.approx([-1.0, -1.0], abs=0.35)  # two texts do not meet
    data, start, end, row = toxicity.windows(*(lambda d, o: (d, toxicity.tx.word_spans(d, o)))(*toxicity.tx.raw(pa.array(["x" * 1000, "ab"]))))
    spans = [(a, b) for a, b, r in zip(start.tolist(), end.tolist(), row.tolist()) if r == 0]
    assert max(b - a for a, b in spans) <= toxicity.WIDEST and spans[-1][1] == 1000 and len(start) == len(spans) + 1
    assert all(any(a <= i and i + toxicity.OVERLAP <= b for a, b in spans) for i in range(1000 - toxicity.OVERLAP + 1))


@pytest.mark.parametrize("weight", [1.0, 8.5, 500.0])
def test_platt_finds_the_minimum(weight):
    rng = np.random.default_rng(4)
    margin = np.concatenate([rng.choice([-2.0, -0.6, 2.24], 1200), rng.choice([2.1, 2.7, 5.6, 10.0], 1200, p=[0.01, 0.04, 0.75, 0.2])])
    label = np.repeat([0.0, 1.0], 1200)
    each = np.where(label > 0, 1.0, weight)
    slope, offset = toxicity.platt(margin, label, each)
    target = np.where(label > 0, 1201 / 1202, 1 / 1202)
    loss = lambda s, o: (each * (np.logaddexp(0, s * margin + o) - target * (s * margin + o))).sum() + 0.05 * s * s + 0.0005 * o * o
    assert all(loss(slope, offset) <= loss(slope + ds, offset + do) + 1e-6 for ds in (-0.05, 0, 0.05) for do in (-0.2, 0, 0.2))


def brute_components(rows, words, percent):
    low = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    sets = {}
    for i, t in rows:
        w = (t or "").encode().translate(low).split()
        sets[i] = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} or ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(i for i in sets if sets[i])
    for k, i in enumerate(ids):
        for j in ids[:k]:
            a, b = len(sets[i]), len(sets[j])
            if min(a, b) * 100 >= percent * max(a, b):
                n = len(sets[i] & sets[j])
                if 100 * n >= percent * (a + b - n) and top(i) != top(j):
                    up[max(top(i), top(j))] = min(top(i), top(j))
    return {i: top(i) for i in sets}, {i: len(s) for i, s in sets.items()}


def check_near(df, words, percent, **options):
    expected, size = brute_components([(r.doc_id, r.text) for r in df.collect()], words, percent)
    got = {r.doc_id: r for r in near_dedup.near_dedup(df, words=words, percent=percent, **options).collect()}
    assert {i: r.component_id for i, r in got.items()} == expected
    assert all(r.n_shingles == size[i] and r.kept == (r.doc_id == r.component_id) for i, r in got.items())


def test_near_dedup_equals_brute_force(docs):
    check_near(docs, 3, 85)


def test_near_dedup_of_a_large_group_near_the_bound(spark):
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(260):
        w = list(base)
        for k in rng.choice(120, rng.integers(1, 7), replace=False):
            w[k] = f"v{rng.integers(10**6)}"
        rows.append((int(i) + 1, " ".join(w)))
    check_near(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85, block=32, salt_size=16)


def test_near_dedup_links_of_long_texts(spark):
    """Sets of more than FOLD shingles, whose parities are sampled: pairs just over the bound are linked, pairs just under are not."""
    rng, rows = np.random.default_rng(15), []
    for g in range(40):
        base = [f"g{g}w{i}" for i in range(1500 + 40 * g)]
        for copy in range(2):
            w = list(base)
            if copy:  # each changed word changes three of n - 2 shingles
                share = 0.86 if g % 2 else 0.83
                change = int((1 - share) / (1 + share) * (len(w) - 2) / 3)
                for k in rng.choice(np.arange(2, len(w) - 3, 4), change, replace=False):
                    w[k] = f"v{rng.integers(10**9)}"
            rows.append((2 * g + copy, " ".join(w)))
    check_near(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85)


def test_near_dedup_of_null_and_shared_ids(spark):
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(None, base), (None, base + " x"), (5, base + " y"), (5, "quite another text of some seven words"), (9, base.upper()), (None, "alone here with five words"), (None, None), (3, ""), (3, "")]
    df = spark.createDataFrame([(*r, "k", "m") for r in rows], "doc_id long, text string, kept string, mark string")
    got = Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_dedup(df).collect())
    assert got == {(None, 56, 5, False): 1, (None, 57, 5, False): 1, (5, 57, 5, True): 1, (5, 3, 5, True): 1, (9, 56, 5, False): 1, (None, 1, None, True): 1, (None, 0, None, True): 1, (3, 0, 3, True): 2}
    left = near_dedup.deduplicate(df)
    assert left.columns == df.columns
    assert Counter((r.doc_id, r.text) for r in left.collect()) == Counter([(5, base + " y"), (5, rows[3][1]), (None, rows[5][1]), (None, None), (3, "")])


def test_components(spark):
    chain = [(i, i + 1) for i in range(1, 60)] + [(100, 100 + i) for i in range(1, 50)] + [(7, 7)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert all(got[i] == 1 for i in range(1, 61)) and all(got[100 + i] == 100 for i in range(50))
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_perfect_hash():
    keys = np.random.default_rng(0).integers(0, 256, (3000, 32), dtype=np.uint8)
    for n in [*range(1, 65), 3000] * 3:
        keys = np.random.default_rng(int(keys[0, 0]) + n).integers(0, 256, (3000, 32), dtype=np.uint8)
        pilots, slot = exact_dedup.build(keys[:n])
        assert sorted(slot.tolist()) == list(range(n)) and (exact_dedup.locate(keys[:n], pilots, n) == slot).all()
        assert (exact_dedup.locate(keys[1000:2000], pilots, n) < n).all()


def test_exact_dedup_of_small_tables(spark):
    for n in (2, 3, 4, 7, 12, 40):
        df = spark.createDataFrame([(i, f"text {i % (n - 1)}") for i in range(n)], "doc_id long, text string")
        got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(df).collect()}
        assert got == {i: (i % (n - 1), 2 if i % (n - 1) == 0 else 1, i < n - 1) for i in range(n)}


def test_bpe_vocabularies_with_other_settings_raise(tmp_path):
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        model = json.load(f)
    for change in (dict(normalizer={"type": "NFC"}), dict(pre_tokenizer={**model["pre_tokenizer"], "add_prefix_space": True}), dict(model={**model["model"], "byte_fallback": True})):
        (tmp_path / "other.json").write_text(json.dumps(model | change))
        with pytest.raises(ValueError):
            bpe_count.load(str(tmp_path / "other.json"))
    with pytest.raises(ValueError):
        packing.Words(public_tokenizers.path("byte_bpe_50k.json"))


def test_bpe_counts_equal_the_library(docs, odd):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    both = docs.select("doc_id", "text").union(odd.select("doc_id", "text"))
    got = bpe_count.bpe_count(both, public_tokenizers.path("byte_bpe_50k.json"))
    texts = [r.text or "" for r in both.collect()]
    assert [r.n_tokens for r in got.collect()] == [len(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_bpe_counts_of_mixed_white_space():
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer, counter, rng = Tokenizer.from_file(path), bpe_count.Counter(*bpe_count.load(path)), np.random.default_rng(6)
    texts = ["x\n\xa0\xa0y", "one two\n\xa0\xa0three four", "a\tb\tc\n\n", "a b\n\n\nc\td\te", "a \xa0 b\tc", " ", "\n", "a\n", "a\x1fb c"]
    texts += ["".join(rng.choice(["a", "bc", "'s", "7", " ", " ", "\n", "\n", "\t", "\xa0", "\u3000", "\r"], rng.integers(1, 16))) for _ in range(50_000)]
    assert [counter(t) for t in texts] == [len(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_language_held_out(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    held = [r for r in queries.op9_language_id(spark, sf).collect() if r.held_out]
    assert np.mean([truth[r.doc_id] == r.lang_pred for r in held]) > 0.95


def test_language_of_more_than_64(spark):
    rng = np.random.default_rng(7)
    words = {f"l{j:03}": ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 8)) for _ in range(12)] for j in range(130)}
    rows = [(4 * j + i, " ".join(rng.permutation(words[name])), name) for j, name in enumerate(words) for i in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(df, where="doc_id % 4 < 3")
    got = {r.doc_id: r.lang_pred for r in language_id.language_id(df, model).collect()}
    assert len(model.languages) == 130 and got == {r[0]: r[2] for r in rows}


def test_language_lookups_equal_sets():
    """Against plain sets of n-grams: no language is missed, extra ones come at the filters' rate, and corrected counts decide as true counts do."""
    rng = np.random.default_rng(9)
    names = [f"l{j:02}" for j in range(70)]
    syllables = {n: ["".join(rng.choice(list("abcdefghijklmnop"), 3)) for _ in range(15)] for n in names}
    text = lambda n: " ".join("".join(rng.choice(syllables[n], 3)) for _ in range(40))
    texts, langs = zip(*[(text(n), n) for n in names for _ in range(4)])
    model = language_id.fit(list(texts), list(langs), 300, 14)
    ranked = {}
    for n in names:
        seen = Counter(g for t, x in zip(texts, langs) if x == n for g in {t.encode()[i : i + 4] for i in range(len(t) - 3)})
        ranked[n] = {g for g, _ in sorted(seen.items(), key=lambda r: (-r[1], int.from_bytes(r[0], "little")))[:300]}
    probes = sorted({bytes(rng.choice(np.frombuffer(b"abcdefghijklmnop ", np.uint8), 4)) for _ in range(3000)} | set().union(*ranked.values()))
    codes = np.array([int.from_bytes(g, "little") for g in probes], np.uint32)
    mask = language_id.lookup(model.table, codes, model.bits)
    for j, n in enumerate(names):
        found, true = language_id.bit(mask, j) == 1, np.array([g in ranked[n] for g in probes])
        assert found[true].all()
        assert found[~true].mean() == pytest.approx(model.false_rate[j], abs=0.02)
    fresh = [text(n) for n in names]
    got, share = language_id.score(pa.array(fresh), model)
    for t, n, g, s in zip(fresh, names, got, share):
        grams = [t.encode()[i : i + 4] for i in range(len(t) - 3)]
        hits = {x: sum(y in ranked[x] for y in grams) for x in names}
        assert g == n == max(names, key=hits.get) and s == pytest.approx(hits[n] / sum(hits.values()), abs=0.1)


def test_language_sample_is_bounded(spark):
    rows = [(i, "das ist ein satz" if i % 10 else "this is a line", "de" if i % 10 else "en") for i in range(5000)]
    taken = []
    fit, language_id.fit = language_id.fit, lambda texts, langs, *rest: taken.extend(langs) or fit(texts, langs, *rest)
    try:
        language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(16), sample=100)
    finally:
        language_id.fit = fit
    assert Counter(taken) == {"de": 100, "en": 100}
    labels = spark.createDataFrame([(i, i % 10 > 0) for i in range(5000)], "doc_id long, bad boolean").withColumn("bad", F.col("bad").cast("int"))
    sample = labelled_sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"), labels, "bad", 50)
    assert Counter(r[2] for r in sample) == {0: 50, 1: 50}


def check_packing(df, pieces, limit=2048):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {r.doc_id: np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4") for r in df.collect()}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        assert zlib.crc32(ids[p.doc_id][p.start : p.start + p.length].tobytes()) == p.ids_crc32 and p.doc_tokens == len(ids[p.doc_id])
        by_doc[p.doc_id].append((p.start, p.length))
        by_sequence[p.sequence_id].append((p.offset, p.length))
    for i, parts in by_doc.items():
        assert sum(n for _, n in parts) % len(ids[i]) == 0
    padded = 0
    for parts in by_sequence.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= limit
        padded += 0 if at & (at - 1) == 0 else limit - at
    return padded, sum(p.length for p in pieces)


def test_packing_round_trip(spark, sf_dir, docs):
    pieces = queries.op10_packing(spark, sf_dir).collect()
    padded, total = check_packing(docs, pieces)
    assert padded < 0.02 * total
    loss, segments = Counter(), Counter()
    for p in pieces:
        prompt = int(p.doc_tokens * 0.25)
        assert p.loss_tokens == max(0, p.start + p.length - max(p.start, prompt))
        loss[p.sequence_id] += p.loss_tokens
        segments[p.sequence_id] += 1
    assert max(loss.values()) == 1792 and max(segments.values()) <= 64  # the limit on loss binds


def test_packing_limits():
    rng = np.random.default_rng(2)
    lengths = rng.integers(1, 300, 400).tolist()
    prompts = [int(rng.integers(0, n + 1)) for n in lengths]
    made = packing.pack(lengths, prompts, 256, 4, 100)
    seen = Counter()
    for sequence in made:
        assert sum(n for _, _, n in sequence) <= 256 and len(sequence) <= 4
        assert sum(max(0, a + n - max(a, prompts[i])) for i, a, n in sequence) <= 100
        seen.update((i, k) for i, a, n in sequence for k in range(a, a + n))
    assert len(seen) == sum(lengths) and set(seen.values()) == {1}
    for limits in ((0, 4, 100), (256, 0, 100), (256, 4, 0)):
        with pytest.raises(ValueError):
            packing.pack(lengths, prompts, *limits)
    long = packing.packed([9000, 1, 40], [0, 1, 40], 256, 4, 1)  # one loss-bearing token a sequence
    assert sum(n for q in long for _, _, n in q) == 9041 and all(sum(max(0, a + n - max(a, (0, 1, 40)[i])) for i, a, n in q) <= 1 for q in long)


def test_odd_rows(spark, sf_dir, odd):
    """Null, empty, blank and very long texts, repeated rows, null columns, clashing extra columns."""
    labels = spark.createDataFrame([(4, 1, 0), (8, 0, 1), (None, 1, 1), (6, None, None)], "doc_id long, quality int, toxic int")
    crf = line_quality.train(odd, labels)
    judged = line_quality.line_quality(odd.select("doc_id", "text"), crf, ["doc_id"])
    assert judged.count() == len(ODD) and judged.where("doc_id IN (1, 2, 3) AND kept").count() == 0
    assert line_quality.mark_lines(odd, crf).count() == sum(len((r[1] or "").split("\n")) for r in ODD)
    exact = {r.doc_id: r for r in exact_dedup.exact_dedup(odd).collect()}
    assert exact[2].keep_id == 1 and exact[4].group_size == 3 and exact[5].keep_id == 4 and not exact[5].kept
    assert exact_dedup.deduplicate(odd).where("doc_id = 4").count() == 1 and exact_dedup.deduplicate(odd).columns == odd.columns
    near = {r.doc_id: r for r in near_dedup.near_dedup(odd).collect()}
    assert near[1].n_shingles == 0 and near[1].kept and near[5].component_id == 4 and near[6].n_shingles == 1
    assert {r.doc_id for r in near_dedup.deduplicate(odd).collect()} == {1, 2, 3, 4, 6, 7, 8}
    assert {r.doc_id for r in mixing.mix(odd, mixing.Plan(share=2.0)).collect()} >= {4, 5, 6, 7, 8}
    model = language_id.train(odd)
    named = {r.doc_id: r for r in language_id.language_id(odd, model).collect()}
    assert named[1].lang_pred == named[2].lang_pred == named[3].lang_pred == "und" and named[6].lang_pred != "und"
    assert toxicity.toxicity(odd, toxicity.train(odd, labels)).count() == len(ODD)
    check_packing(odd, packing.pack_documents(odd, public_tokenizers.path("word_bpe_49k.json")).collect())


def test_empty_tables(spark, odd):
    none, labels = odd.limit(0), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    path = public_tokenizers.path
    made = [
        line_quality.line_quality(none.select("doc_id", "text"), line_quality.train(none, labels), ["doc_id"]), exact_dedup.exact_dedup(none), near_dedup.near_dedup(none), mixing.mix(none), toxicity.toxicity(none, toxicity.train(none, labels)),
        bpe_count.bpe_count(none, path("byte_bpe_50k.json")), language_id.language_id(none, language_id.train(none)), packing.pack_documents(none, path("word_bpe_49k.json")),
    ]
    assert [d.count() for d in made] == [0] * len(made)


def test_spans_match_python():
    rng = np.random.default_rng(3)
    for _ in range(100):
        texts = ["".join(rng.choice(list("ab é\n \t"), rng.integers(0, 14))) for _ in range(rng.integers(1, 6))]
        data, offsets = tx.raw(pa.array(texts, pa.string()))
        raw, words, lines = bytes(data), tx.word_spans(data, offsets), tx.line_spans(data, offsets)
        assert [(r, raw[s:e]) for r, s, e in zip(words.row, words.start, words.end)] == [(i, w) for i, t in enumerate(texts) for w in t.encode().split()]
        assert [(r, raw[s:e]) for r, s, e in zip(lines.row, lines.start, lines.end)] == [(i, w) for i, t in enumerate(texts) for w in t.encode().split(b"\n")]


def test_pipeline_stages(spark, sf_dir, docs):
    rows, kept = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        rows = stored(stage(spark, rows, sf_dir))
        kept[name] = rows
    assert all(kept[n].columns == docs.columns for n, _ in corpus_pipeline.STAGES[:-1])
    judged = {r.doc_id for r in queries.op1_line_quality(spark, sf_dir).where("kept").collect()}
    texts = {r.doc_id: r.text for r in kept["quality_rules"].collect()}
    assert set(texts) == judged
    first = {}
    for i in sorted(texts):
        first.setdefault(tuple(words_of(texts[i])) + (texts[i][:1].isspace(), texts[i][-1:].isspace()), i)
    assert {r.doc_id for r in kept["exact_dedup"].collect()} == set(first.values())
    groups, _ = brute_components([(i, texts[i]) for i in first.values()], 5, 80)
    assert {r.doc_id for r in kept["near_dedup"].collect()} == set(groups.values())
    mixed = Counter(r.doc_id for r in kept["mixing"].collect())
    taken = {r.doc_id: r.copies for r in mixing.mix(kept["near_dedup"]).collect()}
    assert mixed == taken
    check_packing(kept["mixing"], kept["packing"].collect())


def test_pipeline_keeps_texts_without_an_id_of_their_own(spark, sf_dir, docs):
    """Two texts with a null doc_id and two that share one pass every stage as four documents."""
    rows = stored(corpus_pipeline.quality_rules(spark, docs, sf_dir))
    near = near_dedup.near_dedup(rows).select("doc_id", "component_id").collect()
    size = Counter(r.component_id for r in near)
    alone = {r.doc_id for r in near if size[r.component_id] == 1}
    labelled = {r.doc_id for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    best = sorted((r for r in rows.collect() if r.doc_id in alone), key=lambda r: (r.doc_id in labelled, r.doc_id))[:4]
    new_id = dict(zip((r.doc_id for r in best), (None, None, -7, -7)))
    odd_ids = {r.text: new_id[r.doc_id] for r in best}
    renamed = spark.createDataFrame([r.asDict() | {"doc_id": new_id.get(r.doc_id, r.doc_id)} for r in docs.collect()], docs.schema)
    for name, stage in corpus_pipeline.STAGES[:3]:
        renamed = stored(stage(spark, renamed, sf_dir))
        found = [(r.text, r.doc_id) for r in renamed.collect() if r.text in odd_ids]
        assert set(found) == set(odd_ids.items()), name
        assert name == "quality_rules" or len(found) == 4
    mixed = stored(mixing.mixed_documents(renamed))
    count = F.regexp_count("text", F.lit(r"[^ \t-\r]+")).cast("long").alias("n_tokens")
    expected = {(r.doc_id, r.n_tokens): r[2] for r in mixing.mix(renamed).groupBy("doc_id", "n_tokens").agg(F.sum("copies")).collect()}
    assert Counter((r.doc_id, r.n_tokens) for r in mixed.select("doc_id", count).collect()) == expected
    every = mixing.mixed_documents(renamed, mixing.Plan(share=2.0))
    assert Counter(r.text for r in every.collect()) == {r.text: 2 for r in renamed.collect()}
    pieces = packing.pack_documents(mixed, public_tokenizers.path("word_bpe_49k.json"))
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert sum(p.length for p in pieces.collect()) == sum(len(tokenizer.encode(r.text, add_special_tokens=False).ids) + 1 for r in mixed.collect())


def test_mix_takes_no_more_rows_without_ids_than_it_counted(spark):
    rows = [(None, f"{w} " * 10, "en", "src0") for w in "abcd"] + [(5, "e " * 10, "en", "src0"), (5, "f " * 10, "de", "src5"), (6, "g " * 10, "en", "src0"), (6, "g " * 10, "en", "src0")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for share in (0.3, 0.5, 0.75, 1.2):
        plan = mixing.Plan(share=share)
        assert mixing.mixed_documents(df, plan).count() == mixing.mix(df, plan).agg(F.sum("copies")).first()[0]


def test_mix_spreads_rows_of_one_id(spark):
    """One id, or none, on very many rows: the seeded order deals them over the ranges, and the prefix fits the budget as closely as with own ids."""
    texts = spark.range(4000).selectExpr("if(id % 2 = 0, 7L, null) AS doc_id", "concat('w', id, ' x y') AS text", "'en' AS lang", "'src0' AS source")
    taken = mixing.mix(texts, mixing.Plan(share=0.5, max_epochs=1), digits=2).agg(F.sum(F.col("n_tokens") * F.col("copies")), F.max("leaf_budget")).first()
    assert 0 <= taken[1] - taken[0] < 3
    own = mixing.mixed_documents(texts, mixing.Plan(share=0.5, max_epochs=1))
    by_id = {r.doc_id: r["count"] for r in own.groupBy("doc_id").count().collect()}
    assert by_id.keys() == {7, None} and min(by_id.values()) > 800
