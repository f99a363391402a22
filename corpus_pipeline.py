"""The corpus pipeline: language, near duplicates, secrets, mixing and tokens, each over what the stage before kept."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

from codeloom.llm.jaccard import keep_one
from codeloom.llm.langid import keep_identified
from codeloom.llm.mixing import mix_documents
from codeloom.llm.pieces import encode_documents
from codeloom.llm.ledger import redact_secrets
from codeloom.session import STAGE_SETTING, write_stage

TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"
BATCH_BYTES = "4m"


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; those without letters go, null and empty texts with them.

    This and all later stages keep the columns of documents, take rows that repeat alike, and leave an empty table empty.
    """
    _prepare(spark)
    return keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose shingles overlap: the one with the smallest id. Rows of one id stay or go together."""
    _prepare(spark)
    return keep_one(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced in their texts; ``n_chars`` follows."""
    _prepare(spark)
    return redact_secrets(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their sources takes them; rows without a source are one more source."""
    _prepare(spark)
    return mix_documents(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' columns with their token ids, checked against SentencePiece; a null text has null ids."""
    _prepare(spark)
    return encode_documents(docs, TOKENIZER)


STAGES = [
    ("language ID", language), ("n-gram Jaccard join", near_duplicates), ("secret scans", secrets),
    ("mixing sources", mixing), ("SentencePiece encoding", encoding),
]

# SQL has neither the classifier nor the tokenizer; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again by the next."""
    _prepare(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = write_stage(stage(spark, docs, sf_dir), "pipeline")
    return STAGES[-1][1](spark, docs, sf_dir)


def _prepare(spark: SparkSession) -> None:
    """A local session without a shared folder gets one for this run, and texts go to Python in batches of few bytes."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(STAGE_SETTING, None)
    if not named and spark.sparkContext.master.startswith("local["):
        spark.conf.set(STAGE_SETTING, os.path.join(tempfile.gettempdir(), f"codeloom-{spark.sparkContext.applicationId}"))
    # Both sides of a worker hold a batch, twice while it is written; the default is 64 MB.
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
