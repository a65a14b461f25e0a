"""The registered queries of this subpackage, and their SQL where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from shelfmark.llm import bpe, embedding_dedup, jaccard_join, language, language_model, order_minhash, packing, quality, source_audit, suffix_dedup, token_alignment, token_counts, toxicity
from shelfmark.llm.common import documents

WORDS = r"'[^\x20\x09-\x0D]+'"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The queries that SQL can say. The others are tested against the tokenizers' libraries, brute force or held-out rows.
SQL: dict[str, str] = {
    "op1_jaccard_join": f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), {WORDS}) AS w FROM documents),
  s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS shingle FROM w),
  n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
  shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b USING (shingle) WHERE a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
  links AS (SELECT a, b FROM shared JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * k >= 90 * (x.n + y.n - k)),
  both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
  reach(doc_id, to_id) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, b FROM reach r JOIN both_ways ON r.to_id = a)
  SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id FROM documents d LEFT JOIN n USING (doc_id)
  JOIN (SELECT doc_id, min(to_id) AS component_id FROM reach GROUP BY doc_id) m USING (doc_id)""",
    "op5_host_quality": rf"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
  w AS (SELECT *, regexp_extract_all(t, {WORDS}) AS w, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^ 	-
]')) AS l FROM d),
  x AS (SELECT rid, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM w),
  five AS (SELECT rid, i, word || ' ' || lead(word, 1) OVER p || ' ' || lead(word, 2) OVER p || ' ' || lead(word, 3) OVER p || ' ' || lead(word, 4) OVER p AS v
    FROM x WINDOW p AS (PARTITION BY rid ORDER BY i)),
  twice AS (SELECT rid, i FROM five WHERE v IS NOT NULL QUALIFY count(*) OVER (PARTITION BY rid, v) > 1),
  c AS (SELECT rid, count(DISTINCT j) AS n FROM (SELECT rid, unnest(range(i, i + 5)) AS j FROM twice) GROUP BY rid),
  m AS (SELECT doc_id, source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
    len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, len(l) AS n_lines, length(regexp_replace(t, '\P{{Lu}}+', '', 'g')) AS n_capitals
    FROM w LEFT JOIN c USING (rid)),
  b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m),
  f AS (SELECT *, base_failed OR 100 * n_symbols > 25 * n_words OR 100 * n_dup_lines > 50 * n_lines OR 100 * n_capitals > 50 * word_chars
    OR word_chars < 2 * n_words OR word_chars > 15 * n_words AS failed FROM b),
  h AS (SELECT source, count(*) AS docs, count(*) FILTER (failed) AS failures FROM f GROUP BY source),
  g AS (SELECT sum(failures) / sum(docs) AS mean, avg((failures / docs) ^ 2) - avg(failures / docs) ^ 2 AS v, avg(1 / docs) AS inv FROM h),
  prior AS (SELECT mean, CASE WHEN v > mean * (1 - mean) * inv THEN least(10000, greatest(1, mean * (1 - mean) / (v - mean * (1 - mean) * inv) - 1)) ELSE 10000 END AS size FROM g),
  verdict AS (SELECT source, (failures + mean * size) / (docs + size) > 0.5 AS host_blocked FROM h, prior)
  SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT failed AND NOT host_blocked AS kept, host_blocked
  FROM f JOIN verdict ON f.source IS NOT DISTINCT FROM verdict.source""",
    "op12_source_audit": rf"""WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
  t AS (SELECT r, lang, source, unnest(w) AS term FROM d),
  kept AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
  c AS (SELECT lang, source, term, count(*) AS k FROM t JOIN kept USING (lang, term) GROUP BY lang, source, term),
  g AS (SELECT DISTINCT lang, source FROM d),
  v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
  n AS (SELECT lang, source, sum(k) AS n FROM c GROUP BY lang, source),
  whole AS (SELECT lang, sum(n) AS n FROM n GROUP BY lang),
  p AS (SELECT g.lang, g.source, kept.term, coalesce(k, 0) AS k, 1 + 1000000000::HUGEINT * (coalesce(k, 0) + 2) // (coalesce(n, 0) + 2 * v) AS p
    FROM g JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN c USING (lang, source, term) LEFT JOIN n USING (lang, source)),
  q AS (SELECT lang, term, 1 + 1000000000::HUGEINT * (sum(k) + 2) // (any_value(n) + 2 * any_value(v)) AS q FROM c JOIN whole USING (lang) JOIN v USING (lang) GROUP BY lang, term),
  f AS (SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) AS value
    FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY x.lang, x.source, y.source),
  pairs AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(value, 0) AS value
    FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN f ON f.lang = x.lang AND f.source = x.source AND f.item = y.source),
  terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // (p + q) AS value FROM p JOIN q USING (lang, term) WHERE k > 0 AND p > q),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
  SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 10""",
}


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_query(documents(spark, sf_dir, "doc_id", "text"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_count_query(documents(spark, sf_dir, "doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))


def op3_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.language_model_query(spark, sf_dir)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup_query(documents(spark, sf_dir, "doc_id", "text"))


def op5_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_query(documents(spark, sf_dir, "doc_id", "text", "source"))


def op6_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.fingerprint_query(spark, sf_dir)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_query(spark, sf_dir)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.language_query(spark, sf_dir)


def op9_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packing_query(documents(spark, sf_dir, "doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_query(documents(spark, sf_dir, "doc_id", "text"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op11_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.embedding_query(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.audit_query(documents(spark, sf_dir, "text", "lang", "source"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return token_alignment.alignment_query(documents(spark, sf_dir, "doc_id", "text"), a, b)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    name: query for name, query in list(globals().items()) if name.startswith("op") and name[2].isdigit()
}
