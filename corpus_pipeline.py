"""Documents to token ids: each stage is one of the training-data operators, in the order that costs least.

Language identification drops documents in which no language is found; near-deduplication keeps one document of each
class; personal data are replaced by their kind; documents are emitted at the rates that bring the domains of the
labelled table to their target shares; the texts that remain become token ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docassay.llm import bpe, langid, mixing, pii, probminhash
from docassay.llm._common import discard, materialise, read_table
from docassay.llm.queries import TARGETS, tokenizer_path

#: SQL cannot express the fitted stages; a test holds the pipeline against its stages, which have tests of their own.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_identified(docs, langid.fit(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return probminhash.deduplicate(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs, pii.fit(pii.cells(docs)))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.resample(docs, mixing.quality_domains(read_table(spark, sf_dir, "labels")), TARGETS)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.tokens(docs, tokenizer_path(), keep=("doc_id", "lang", "source"))


STAGES = [("language_id", language), ("minhash_near_dedup", near_duplicates), ("pii", personal_data), ("source_mixing", mixture), ("bpe", token_ids)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what a stage returns is written and read again before the next one."""
    docs, before = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
        if before is not None:
            discard(before)  # the next stage reads what this one wrote
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
