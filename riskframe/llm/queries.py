"""Registered queries of this package, each over its whole table, and their DuckDB statements."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskframe.llm import (compression_lang, credentials, divergence, exact_dedup, hard_negatives, lm_scoring, middle, mixing,
                           packing, quality_knn, simhash, substrings, toxicity)
from riskframe.llm.common import documents, embeddings, labels

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


TOKENIZER = "word_bpe_49k.json"


def tokenizer_file() -> str:
    import public_tokenizers
    return public_tokenizers.path(TOKENIZER)


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


@query("op10_block_naming", """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
""")
def op10_block_naming(spark, sf_dir):
    return exact_dedup.exact_groups(documents(spark, sf_dir)).drop("uid")


@query("op9_configuration_packing")
def op9_configuration_packing(spark, sf_dir):
    return packing.pack(documents(spark, sf_dir), tokenizer_file())


@query("op3_golay_simhash")
def op3_golay_simhash(spark, sf_dir):
    return simhash.near_groups(documents(spark, sf_dir)).drop("uid", "kept")


@query("op8_neighbour_quality")
def op8_neighbour_quality(spark, sf_dir):
    return quality_knn.scored(documents(spark, sf_dir), labels(spark, sf_dir))


@query("op4_temperature_mixing")
def op4_temperature_mixing(spark, sf_dir):
    return mixing.permuted(mixing.copies(documents(spark, sf_dir))).drop("uid")


@query("op1_distribution_divergence")
def op1_distribution_divergence(spark, sf_dir):
    return divergence.rules(documents(spark, sf_dir))


@query("op6_credential_linking")
def op6_credential_linking(spark, sf_dir):
    return credentials.scan(documents(spark, sf_dir))


@query("op5_ngram_toxicity")
def op5_ngram_toxicity(spark, sf_dir):
    return toxicity.scored(documents(spark, sf_dir), labels(spark, sf_dir))


@query("op2_log_bilinear")
def op2_log_bilinear(spark, sf_dir):
    return lm_scoring.scores(documents(spark, sf_dir))


@query("op7_suffix_buckets")
def op7_suffix_buckets(spark, sf_dir):
    return substrings.cut_repeats(documents(spark, sf_dir))


@query("op11_zstd_language")
def op11_zstd_language(spark, sf_dir):
    return compression_lang.predicted(documents(spark, sf_dir))


@query("op12_block_rotation", r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS w
  FROM documents),
u AS (
  SELECT *, len(w) AS n, ('0x' || h[1:8])::BIGINT % (len(w) + 1) AS a, ('0x' || h[9:16])::BIGINT % (len(w) + 1) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
                   OR ('0x' || h[17:24])::BIGINT % 100 >= 50 THEN 'plain'
              WHEN ('0x' || h[25:32])::BIGINT % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM t),
v AS (
  SELECT *, array_to_string(w[1:least(a, b)], '') AS p, array_to_string(w[least(a, b) + 1:greatest(a, b)], '') AS m,
         array_to_string(w[greatest(a, b) + 1:], '') AS s
  FROM u)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                        ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM v
""")
def op12_block_rotation(spark, sf_dir):
    rows = middle.restore(middle.transform(documents(spark, sf_dir)))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                       F.sha2("restored", 256).alias("restored_sha256"))


@query("op13_angular_negatives", """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
         list_inner_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5),
n AS (
  SELECT p.*, s.other_id AS negative_id, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id)::INT AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same
       AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
""")
def op13_angular_negatives(spark, sf_dir):
    rows = embeddings(spark, sf_dir)
    changed = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows.withColumn("label", changed))
