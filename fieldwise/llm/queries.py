"""The queries of the training-data operators, with their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldwise.llm import bpe_count, bpe_trie, chat_format, exact_dedup, language_id, line_quality, mixing, near_dedup, packing, periodic_runs, phrase_mining, toxicity, url_rules


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(modulus: int, rest: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(modulus)) == rest


def op1_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    crf = line_quality.train(docs, table(spark, sf_dir, "labels"))
    return line_quality.line_quality(docs.select("doc_id", "text"), crf, ["doc_id"])


def op2_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in url_rules.RULES)
    return url_rules.url_rules(table(spark, sf_dir, "pages"), spark.sql(f"SELECT * FROM VALUES {values} AS t(host, path, verdict)"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat_format.chat_digests(given.unionByName(chat_format.probe(spark)))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), where=~held_out(4, 2))
    scored = toxicity.toxicity(docs, model)
    return scored.select("doc_id", held_out(4, 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(table(spark, sf_dir, "documents"), words=3, percent=85)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op8_bpe_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_count.bpe_count(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.train(docs, where=~held_out(3, 1))
    named = language_id.language_id(docs, model)
    return named.select("doc_id", held_out(3, 1).alias("held_out"), "lang_pred", "score")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op11_bpe_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_trie.bpe_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_mining.collocations(table(spark, sf_dir, "documents"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.periodic_runs(table(spark, sf_dir, "documents"), plant=True)


QUERIES = {f.__name__: f for f in (op1_line_quality, op2_url_rules, op3_chat_format, op4_mixing, op5_toxicity, op6_near_dedup, op7_exact_dedup, op8_bpe_count, op9_language_id, op10_packing, op11_bpe_trie, op12_collocations, op13_periodic_runs)}

_URL_SQL = r"""
WITH u AS (
  SELECT page_id,
    CASE WHEN url IS NULL OR strpos(url, '://') = 0 THEN '' ELSE substr(url, strpos(url, '://') + 3) END AS rest
  FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(rule_host, rule_path, verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
m AS (SELECT page_id, rule_host || rule_path AS rule, verdict,
    row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host || rule_path) DESC, length(rule_host) DESC) AS k
  FROM h JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT h.page_id, h.host, h.path, m.rule, coalesce(m.verdict, 'allow') AS verdict
FROM h LEFT JOIN m ON h.page_id = m.page_id AND m.k = 1
"""

_CHAT_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, length(replace(replace(replace(text, '\', '\b'), '#', '\h'), '<', '\l')) AS text_len,
    length(replace(replace(replace(role, '\', '\b'), '#', '\h'), '<', '\l')) AS role_len,
    lag(role, 1, 'start') OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS back FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  sum(4 + role_len + 2 + text_len + 8)::BIGINT AS formatted_chars,
  bool_and(before || '>' || role IN ('start>system', 'start>user', 'system>user', 'user>assistant', 'assistant>user'))
    AND max(CASE WHEN back = 1 THEN role END) = 'assistant' AS valid
FROM e GROUP BY conv_id
"""

_EXACT_SQL = r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[ \t-\r]+', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*)::BIGINT AS group_size FROM t GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM t JOIN g USING (text_sha256)
"""

_MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '(none)' WHEN right(source, 1) IN ('0','1','2','3') THEN 'web' WHEN right(source, 1) IN ('4','5','6') THEN 'books' ELSE 'news' END AS domain,
    coalesce(lang, '(none)') AS lang, coalesce(source, '(none)') AS source,
    coalesce(length(regexp_extract_all(text, '[^ \t-\r]+')), 0)::BIGINT AS n_tokens, md5(coalesce(text, '')) AS text_md5 FROM documents),
leaf AS (SELECT domain, lang, source, sum(n_tokens) AS tokens, sum(n_tokens)::DOUBLE * 2 AS cap, 0.125::DOUBLE AS weight FROM d GROUP BY ALL),
dom AS (SELECT domain, sum(cap) AS cap, CASE domain WHEN 'web' THEN 0.5 WHEN 'books' THEN 0.25 WHEN 'news' THEN 0.25 ELSE 0.125 END::DOUBLE AS weight,
    (SELECT floor(sum(tokens) * 0.75)::DOUBLE FROM leaf) AS budget FROM leaf GROUP BY domain),
dom1 AS (SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY cap / weight, domain ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY cap / weight, domain ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM dom),
dom2 AS (SELECT domain, CASE WHEN cap <= level * weight THEN cap ELSE greatest(max(CASE WHEN cap > level * weight THEN level END) OVER (), 0) * weight END AS budget FROM dom1),
lan AS (SELECT domain, lang, sum(cap) AS cap, CASE lang WHEN 'en' THEN 0.5 WHEN 'de' THEN 0.2 WHEN 'fr' THEN 0.2 WHEN 'es' THEN 0.1 ELSE 0.125 END::DOUBLE AS weight FROM leaf GROUP BY ALL),
lan1 AS (SELECT lan.*, budget, (budget - coalesce(sum(cap) OVER (PARTITION BY domain ORDER BY cap / weight, lang ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (PARTITION BY domain ORDER BY cap / weight, lang ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM lan JOIN dom2 USING (domain)),
lan2 AS (SELECT domain, lang, CASE WHEN cap <= level * weight THEN cap ELSE greatest(max(CASE WHEN cap > level * weight THEN level END) OVER (PARTITION BY domain), 0) * weight END AS budget FROM lan1),
src1 AS (SELECT leaf.*, budget, (budget - coalesce(sum(cap) OVER (PARTITION BY domain, lang ORDER BY cap / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (PARTITION BY domain, lang ORDER BY cap / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM leaf JOIN lan2 USING (domain, lang)),
src2 AS (SELECT domain, lang, source, tokens, floor(CASE WHEN cap <= level * weight THEN cap ELSE greatest(max(CASE WHEN cap > level * weight THEN level END) OVER (PARTITION BY domain, lang), 0) * weight END + 1e-6)::BIGINT AS leaf_budget FROM src1),
p AS (SELECT *, CASE WHEN tokens > 0 THEN leaf_budget // tokens ELSE 0 END::BIGINT AS epochs FROM src2),
o AS (SELECT d.*, p.leaf_budget, p.epochs, p.leaf_budget - p.epochs * p.tokens AS rest,
    sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5('mix-1:' || p.epochs || ':' || coalesce(doc_id::VARCHAR, '') || ':' || text_md5), doc_id, n_tokens ROWS UNBOUNDED PRECEDING) AS upto
  FROM d JOIN p USING (domain, lang, source))
SELECT doc_id, domain, lang, source, n_tokens, leaf_budget, (epochs + (upto <= rest)::INT)::BIGINT AS copies FROM o WHERE epochs + (upto <= rest)::INT > 0
"""

_PHRASE_SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n-\r]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^ \t]+') AS ws FROM p),
i AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
g AS (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase FROM i, (SELECT unnest(range(1, 6)) AS k) WHERE i + k - 1 <= len(ws)),
n AS (SELECT lang, count(*) AS n FROM g WHERE k = 1 GROUP BY lang),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1),
s AS (SELECT c.lang, c.phrase, c.a, lf.f AS l, rf.f AS r, n.n, cut, (1000::HUGEINT * c.a * n.n) // (lf.f::HUGEINT * rf.f) AS score
  FROM c JOIN (SELECT unnest(range(1, 5)) AS cut) ON cut < c.k JOIN n ON n.lang = c.lang
  JOIN f lf ON lf.lang = c.lang AND lf.phrase = array_to_string(c.ws[:cut], ' ') JOIN f rf ON rf.lang = c.lang AND rf.phrase = array_to_string(c.ws[cut + 1:], ' ')),
b AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS first FROM s),
o AS (SELECT * FROM b WHERE first = 1 AND NOT EXISTS (SELECT 1 FROM c q WHERE q.lang = b.lang AND q.k > 2 AND q.a >= b.a AND q.phrase <> b.phrase AND contains(' ' || q.phrase || ' ', ' ' || b.phrase || ' ')))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score FROM o
QUALIFY rank <= 2000
"""

ORACLES = {"op2_url_rules": _URL_SQL, "op3_chat_format": _CHAT_SQL, "op4_mixing": _MIX_SQL, "op7_exact_dedup": _EXACT_SQL, "op12_collocations": _PHRASE_SQL}
