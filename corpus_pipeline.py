"""Corpus preparation: quality, near duplicates, benchmark leaks, personal data, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next stage's
documents. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noteloom.llm import decontaminate, near_dedup, pii, quality
from noteloom.llm.common import drop_materialized, materialize, table, tidy
from noteloom.llm.queries import tokenizer_path
from noteloom.llm.sentencepiece_bpe import encode_documents


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier rejects go, by id, language and text; null and empty texts stay, and an empty table gives no rows."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exactly one row of each group of near duplicates stays: that with the least id, nulls last; null texts are one group."""
    return near_dedup.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose own text holds a test item go, whatever their id; null and empty texts stay."""
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts are replaced by the names of their kinds; n_chars follows the new text. Null texts stay null; every row stays."""
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and hashes of ids and decoded text, a row for each row; a null text counts as empty."""
    return encode_documents(docs, tokenizer_path("piece_bpe_32k.model"))


STAGES = [
    ("quality classifier", quality_stage),
    ("MinHash near-dedup", near_dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("PII", pii_stage),
    ("SentencePiece encoding and decoding", token_stage),
]

#: The n-gram model and the sketches are beyond SQL; a test holds the stages against a plain version.
ORACLE_SQL = None


@tidy
def _written(stage, spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A stage's result as a table; the tables that its operators read for it go."""
    return materialize(stage(spark, docs, sf_dir))


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again; a stage's table goes once the next one's is there."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        before, docs = docs, _written(stage, spark, docs, sf_dir)
        drop_materialized(before)
    return docs
