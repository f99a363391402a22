"""Registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.ann import nearest_vectors
from codeloom.llm.fim import fim_report
from codeloom.llm.importance import resample
from codeloom.llm.jaccard import jaccard_components
from codeloom.llm.langid import language_report
from codeloom.llm.ledger import find_secrets
from codeloom.llm.mixing import mix_report
from codeloom.llm.phrases import contamination_report
from codeloom.llm.pieces import encode_documents
from codeloom.llm.quality import rate_quality
from codeloom.llm.toxicity import rate_toxicity, train_chain
from codeloom.llm.web import extract_pages
from codeloom.llm.whitening import whitening_report

TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[query.__name__] = query
    return query


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@register
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weak supervision: rules vote, EM weighs them, the posterior decides."""
    return rate_quality(table(spark, sf_dir, "documents"))


@register
def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often a mix to target weights takes each document."""
    return mix_report(table(spark, sf_dir, "documents"))


@register
def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents linked by the overlap of their five-word shingles."""
    return jaccard_components(table(spark, sf_dir, "documents"))


@register
def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of pages by the container path of their host."""
    return extract_pages(table(spark, sf_dir, "pages"))


@register
def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document, checked against SentencePiece and decoded again."""
    rows = encode_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), TOKENIZER)
    return rows.select("doc_id", "n_tokens", "ids", "parity", "round_trip")


@register
def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of every fiftieth one."""
    return nearest_vectors(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@register
def op7_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents drawn by their likeness to those labelled as good."""
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@register
def op8_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document, each blob scanned once."""
    return find_secrets(table(spark, sf_dir, "documents"))


@register
def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, family first."""
    return language_report(table(spark, sf_dir, "documents"))


@register
def op10_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probability of each category for every document, from a chain of classifiers."""
    docs = table(spark, sf_dir, "documents")
    return rate_toxicity(docs, train_chain(docs, table(spark, sf_dir, "labels")))


@register
def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding on its first 16 whitened components."""
    return whitening_report(table(spark, sf_dir, "embeddings"))


@register
def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document cut and put together for filling in the middle."""
    return fim_report(table(spark, sf_dir, "documents"))


@register
def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie within phrases of the benchmark."""
    return contamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
