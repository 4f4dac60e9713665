"""The queries ``opN_<name>`` and the SQL that gives the same rows, where SQL can."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quadrille.llm.adaptive_rules import adaptive_rules
from quadrille.llm.common import table
from quadrille.llm.decontaminate import contaminated
from quadrille.llm.langid import fit as fit_languages
from quadrille.llm.langid import held_out, identify
from quadrille.llm.ngram_join import ngram_components
from quadrille.llm.packing import pack
from quadrille.llm.paragraph_dedup import paragraph_groups
from quadrille.llm.quality_rank import rank_quality
from quadrille.llm.recurrent_lm import score_documents
from quadrille.llm.sparse_suffix import repeated_spans
from quadrille.llm.warc import deduplicated_archives

#: Vocabulary of op6.
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(spark, table(spark, sf_dir, "documents"), n=3, percent=90)


def op2_bradley_terry(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return rank_quality(docs, labels, ~held_out()).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op3_revisit_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated_archives(spark, table(spark, sf_dir, "pages"))


def op4_paragraph_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraph_groups(spark, table(spark, sf_dir, "documents"))


def op5_latent_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark, table(spark, sf_dir, "documents"), tokenizer=TOKENIZER)


def op7_adaptive_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adaptive_rules(spark, table(spark, sf_dir, "documents")).drop("reasons")


def op8_script_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_languages(docs, ~held_out())
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op9_gated_recurrent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    out_of_fold = held_out(n=5, at=1)
    scored = score_documents(spark, table(spark, sf_dir, "documents"), ~out_of_fold)
    return scored.select("doc_id", out_of_fold.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op10_sparse_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(spark, table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_ngram_jaccard": op1_ngram_jaccard,
        "op2_bradley_terry": op2_bradley_terry,
        "op3_revisit_resolution": op3_revisit_resolution,
        "op4_paragraph_minhash": op4_paragraph_minhash,
        "op5_latent_decontamination": op5_latent_decontamination,
        "op6_best_two_fit": op6_best_two_fit,
        "op7_adaptive_rules": op7_adaptive_rules,
        "op8_script_viterbi": op8_script_viterbi,
        "op9_gated_recurrent_lm": op9_gated_recurrent_lm,
        "op10_sparse_suffix": op10_sparse_suffix,
    }


OP7_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT r, list_filter(string_split_regex(t, '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS ws,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \t\n\x0B\f\r]')) AS ls FROM d),
p AS (SELECT r, generate_subscripts(ws, 1) AS i, ws FROM w WHERE len(ws) >= 3),
g AS (SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS s FROM p WHERE i <= len(ws) - 2),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS c FROM g) WHERE c >= 2),
rep AS (SELECT r, count(DISTINCT place) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS place FROM twice) GROUP BY r),
m AS (
  SELECT r, doc_id, lang, source, len(ws) AS n_words,
         length(regexp_replace(t, '[ \t\n\x0B\f\r]+', '', 'g')) AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
         len(ls) - len(list_distinct(ls)) AS n_dup_lines,
         coalesce(rep.n, 0) AS n_repeat_words, len(ls) AS n_lines,
         length(regexp_replace(t, '[^A-Z]+', '', 'g')) AS n_upper
  FROM d JOIN w USING (r) LEFT JOIN rep USING (r)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
v AS (
  SELECT r, lang, source, base_failed, unnest([
      {'k': 'symbols', 'v': CASE WHEN word_chars > 0 THEN 10000 * n_symbols // word_chars ELSE 0 END, 'm': 300},
      {'k': 'dup_lines', 'v': CASE WHEN n_lines > 0 THEN 10000 * n_dup_lines // n_lines ELSE 0 END, 'm': 3500},
      {'k': 'repeats', 'v': CASE WHEN n_words > 0 THEN 10000 * n_repeat_words // n_words ELSE 0 END, 'm': 2500},
      {'k': 'capitals', 'v': CASE WHEN word_chars > 0 THEN 10000 * n_upper // word_chars ELSE 0 END, 'm': 1500},
      {'k': 'word_length', 'v': CASE WHEN n_words > 0 THEN 100 * word_chars // n_words ELSE 0 END, 'm': 300}]) AS x FROM b),
u AS (
  SELECT r, lang, source, base_failed, x.k AS k, x.v AS v, x.m AS m,
         (x.v >> greatest(length(bin(x.v)) - 6, 0)) << greatest(length(bin(x.v)) - 6, 0) AS bucket FROM v),
s AS (SELECT lang, source, k, m, bucket, count(*) AS n FROM u WHERE NOT base_failed GROUP BY ALL),
lv AS (
  SELECT 0 AS level, lang, source, k, m, bucket, n FROM s
  UNION ALL SELECT 1, lang, NULL, k, m, bucket, n FROM s
  UNION ALL SELECT 2, NULL, NULL, k, m, bucket, n FROM s),
mg AS (SELECT level, lang, source, k, m, bucket, sum(n) AS n FROM lv GROUP BY ALL),
rk AS (
  SELECT *, sum(n) OVER (PARTITION BY level, lang, source, k ORDER BY bucket) AS upto,
         sum(n) OVER (PARTITION BY level, lang, source, k) AS total FROM mg),
f AS (
  SELECT level, lang, source, k, max(total) AS total,
         min(bucket) FILTER (WHERE 4 * upto >= 3 * total)
           + greatest(3.0 * (min(bucket) FILTER (WHERE 4 * upto >= 3 * total) - min(bucket) FILTER (WHERE 4 * upto >= total)), max(m)) AS fence
  FROM rk GROUP BY level, lang, source, k),
judged AS (
  SELECT u.r, bool_or(u.v > CASE WHEN a.total >= 50 THEN a.fence WHEN l.total >= 50 THEN l.fence ELSE c.fence END) AS beyond
  FROM u
  LEFT JOIN f a ON a.level = 0 AND a.k = u.k AND a.lang IS NOT DISTINCT FROM u.lang AND a.source IS NOT DISTINCT FROM u.source
  LEFT JOIN f l ON l.level = 1 AND l.k = u.k AND l.lang IS NOT DISTINCT FROM u.lang
  LEFT JOIN f c ON c.level = 2 AND c.k = u.k
  GROUP BY u.r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT coalesce(beyond, false) AS kept
FROM b JOIN judged USING (r)
"""


OP3_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS h FROM pages),
d AS (
  SELECT page_id, octet_length(encode(t)) AS payload_bytes,
         array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           ((('0x' || substr(h, 5 * (i // 4)::INT + 1, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31) + 1, 1)), '') AS payload_digest
  FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to
FROM m
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_revisit_resolution": OP3_SQL, "op7_adaptive_rules": OP7_SQL}
