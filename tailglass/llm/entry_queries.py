"""The queries over the corpus operators, by name, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from .block_anchors import repeat_digest
from .block_crf import extract
from .co_training import quality
from .common import table
from .compression_bands import compression_bands
from .credential_automata import scan
from .cutting_stock import pack
from .dual_tree import hard_negatives
from .prob_minhash import near_classes
from .qgram_lemma import leaks
from .script_viterbi import languages
from .sparse_product import rank_documents
from .wavelet import token_files
from .zip_warc import archive_pages


def op1_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression_bands(table(spark, sf_dir, "documents"))


def op2_block_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def op3_script_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages(table(spark, sf_dir, "documents"))


def op4_block_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeat_digest(table(spark, sf_dir, "documents"))


def op5_prob_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(table(spark, sf_dir, "documents"))


def op6_qgram_lemma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_cutting_stock(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op8_wavelet_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(table(spark, sf_dir, "documents"))


def op9_co_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_zip_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_pages(table(spark, sf_dir, "pages"))


def op11_sparse_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 50, once=True)


def op12_credential_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def op13_dual_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", shifted), "vec_id % 50 = 0")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_compression_bands": op1_compression_bands,
    "op2_block_crf": op2_block_crf,
    "op3_script_viterbi": op3_script_viterbi,
    "op4_block_anchors": op4_block_anchors,
    "op5_prob_minhash": op5_prob_minhash,
    "op6_qgram_lemma": op6_qgram_lemma,
    "op7_cutting_stock": op7_cutting_stock,
    "op8_wavelet_matrix": op8_wavelet_matrix,
    "op9_co_training": op9_co_training,
    "op10_zip_warc": op10_zip_warc,
    "op11_sparse_product": op11_sparse_product,
    "op12_credential_automata": op12_credential_automata,
    "op13_dual_tree": op13_dual_tree,
    "pipeline": corpus_pipeline.run,
}

#: op4: all windows of 35 words, counted; the rest is cutting and joining again.
OP4_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
places AS (
  SELECT rid, i, array_to_string(list_slice(ws, i, i + 34), ' ') AS k
  FROM (SELECT rid, ws, unnest(range(1, len(ws) - 33)) AS i FROM docs)),
found AS (SELECT k FROM places GROUP BY k HAVING count(*) > 1),
cut AS (
  SELECT DISTINCT rid, unnest(range(i, i + 35)) AS pos FROM places SEMI JOIN found USING (k)),
words AS (SELECT rid, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS pos FROM docs),
kept AS (
  SELECT rid, string_agg(word, ' ' ORDER BY pos) AS text, count(*) AS n
  FROM words ANTI JOIN cut USING (rid, pos) GROUP BY rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(text, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (rid)
"""

#: op10: five hexadecimal digits of the SHA-1 are four of base 32.
OP10_SQL = """
WITH pays AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
firsts AS (SELECT html, min(page_id) AS first FROM pays GROUP BY html)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                1 + CAST((CAST('0x' || substr(hex, CAST(1 + 5 * (i // 4) AS INTEGER), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS INTEGER), 1)), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM pays JOIN firsts USING (html)
"""

#: op11: terms by splitting at what is none; the weights and impacts as the contract states them.
OP11_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id,
         list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ts
  FROM documents),
items AS (
  SELECT row_number() OVER () AS iid, item_id,
         list_distinct(list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '')) AS ts
  FROM benchmark),
sums AS (SELECT count(*) FILTER (WHERE len(ts) > 0) AS n_docs, CAST(sum(len(ts)) AS BIGINT) AS n_terms FROM docs),
tfs AS (SELECT rid, term, count(*) AS tf FROM (SELECT rid, unnest(ts) AS term FROM docs) GROUP BY rid, term),
weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tfs, sums GROUP BY term),
lengths AS (SELECT rid, doc_id, 50 + (50 * len(ts) * n_docs) // n_terms AS m FROM docs, sums WHERE len(ts) > 0),
scores AS (
  SELECT iid, item_id, rid, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
  FROM (SELECT iid, item_id, unnest(ts) AS term FROM items) JOIN weights USING (term) JOIN tfs USING (term) JOIN lengths USING (rid)
  GROUP BY iid, item_id, rid, doc_id),
ranked AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY iid ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score
  FROM scores WHERE score > 0)
SELECT * FROM ranked WHERE rank <= 50
"""

#: op13: all pairs of an anchor and a row.
OP13_SQL = """
WITH rows AS (
  SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT a.rid AS aid, a.vec_id AS anchor_id, a.label = r.label AS same, r.rid, r.vec_id, CAST(list_inner_product(a.q, r.q) AS BIGINT) AS score
  FROM rows a JOIN rows r ON a.rid <> r.rid WHERE a.vec_id % 50 = 0),
positives AS (
  SELECT aid, rid AS pid, anchor_id, vec_id AS positive_id, score AS positive_score FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY aid ORDER BY score DESC, vec_id NULLS LAST, rid) <= 5),
found AS (
  SELECT p.anchor_id, positive_id, vec_id AS negative_id, positive_score, score AS negative_score,
         CAST(row_number() OVER (PARTITION BY aid, pid ORDER BY score DESC, vec_id NULLS LAST, n.rid) AS INTEGER) AS rank
  FROM positives p JOIN pairs n USING (aid)
  WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
SELECT * FROM found WHERE rank <= 3
"""

ORACLE_SQL: dict[str, str] = {"op4_block_anchors": OP4_SQL, "op10_zip_warc": OP10_SQL, "op11_sparse_product": OP11_SQL, "op13_dual_tree": OP13_SQL}
