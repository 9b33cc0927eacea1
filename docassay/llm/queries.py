"""Queries of the training-data operators, with production parameters, over their whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docassay.llm import bpe, covertree, dac, hmm, langid, mih, mincut, mixing, pii, probminhash
from docassay.llm._common import crc_remainder, read_table


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return pii.digest(docs, pii.fit(pii.cells(docs)))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").withColumn("held_out", crc_remainder("doc_id", 3) == 1)
    model = langid.fit(docs.where("not held_out"))
    return langid.predict(docs, model, keep=("doc_id", "held_out"))


def op3_token_id_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dac.round_trip(read_table(spark, sf_dir, "documents"), tokenizer_path())


def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covertree.top_k(read_table(spark, sf_dir, "embeddings"))


OP4_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
  WHERE q.vec_id % 50 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
  FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return probminhash.classes(read_table(spark, sf_dir, "documents"))


#: Shares of the tokens that each domain of the labelled table is to have.
TARGETS = {"high": 0.7, "low": 0.25, "toxic": 0.05}


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = mixing.quality_domains(read_table(spark, sf_dir, "labels"))
    return mixing.mix(read_table(spark, sf_dir, "documents"), labels, TARGETS)


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages")
    return mincut.extract(pages, mincut.fit(pages))


def op8_hmm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return hmm.score(docs.select("doc_id", "text", (crc_remainder("doc_id", 7) == 2).alias("held_out")))


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mih.nearest(read_table(spark, sf_dir, "embeddings"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(read_table(spark, sf_dir, "documents"), tokenizer_path())


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_pii, op2_language_id, op3_token_id_output, op4_exact_top_k, op5_minhash_near_dedup, op6_source_mixing, op7_html_extraction, op8_hmm_scoring, op9_nearest_neighbours, op10_bpe)}


def oracle_sql() -> dict[str, str]:
    """SQL for those of the queries that it can express."""
    return {"op4_exact_top_k": OP4_SQL}
