"""Catalogue, dictionary and benchmark folders, and the clean-catalogue sink."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions.text import code_key, stem_parts
from codeloom.operators.translate import last_entry_wins
from codeloom.sources.csv_files import LATIN1, UTF8, CsvFiles

# Column names under which dictionaries keep codes and descriptions.
CODE_COLUMNS = {"id", "id_clasificacion"}
TEXT_COLUMNS = {"text", "descripcion"}
# Benchmark files are benchmark_<name>.csv and test the catalogue <name>_es.
BENCHMARK_PREFIX, BENCHMARK_SUFFIX = "benchmark_", "_es"


def read_catalogues(
    spark: SparkSession, folder: str, meta: Iterable[str] = (), only: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """Every ``*.csv`` in the folder as one catalogue named by its file stem.

    Returns the rows ``classifier, id, text, <meta>`` and a report with one row per
    file. Files without the needed columns are reported and left out; the others are read. There must be one at least.
    """
    needed = ["id", "text", *meta]
    files = CsvFiles(spark, folder)
    heads = files.heads if only is None else files.heads.where(F.col("stem") == only)
    missing = F.array_except(F.array(*[F.lit(c) for c in needed]), "columns")
    report = heads.select(
        F.col("stem").alias("classifier"), F.col("name").alias("file"),
        F.when(F.col("utf8"), UTF8).otherwise(LATIN1).alias("encoding"), (F.size(missing) == 0).alias("ok"),
        F.when(F.size(missing) > 0, F.concat(F.lit("missing columns: "), F.array_join(missing, ", "))).otherwise("").alias("message"),
    )
    rows = files.records(heads.where(files.with_columns(needed))).select(F.col("stem").alias("classifier"), *[F.col("record")[c].alias(c) for c in needed])
    return rows, report


def dictionary_columns(columns: Column) -> tuple[Column, Column]:
    """(code, text) column of a dictionary's header: by name, else the first two; null if there are fewer."""

    def last(names: set[str]) -> Column:
        return F.try_element_at(F.filter(columns, lambda c: F.lower(c).isin(sorted(names))), F.lit(-1))

    code, text = last(CODE_COLUMNS), last(TEXT_COLUMNS)
    both, enough = code.isNotNull() & text.isNotNull(), F.size(columns) > 1
    first = [F.when(enough, F.get(columns, F.lit(i))) for i in (0, 1)]
    return F.when(both, code).otherwise(first[0]), F.when(both, text).otherwise(first[1])


def read_dictionaries(spark: SparkSession, folder: str) -> DataFrame:
    """``classifier, lang, code, text`` from files named ``<classifier>_<lang>.csv``.

    A code given twice in a file has the text of its last row.
    """
    files = CsvFiles(spark, folder)
    code, text = dictionary_columns(F.col("columns"))
    heads = files.heads.withColumns({"code_column": code, "text_column": text}).where("code_column is not null")
    classifier, lang = stem_parts(F.col("stem"))
    rows = files.records(heads).select(
        classifier.alias("classifier"), lang.alias("lang"),
        code_key(F.coalesce(F.try_element_at("record", "code_column"), F.lit(""))).alias("code"),
        F.regexp_replace(F.coalesce(F.try_element_at("record", "text_column"), F.lit("")), r"(?U)^\s+|\s+$", "").alias("text"),
        F.col("place").alias("_place"),
    )
    return last_entry_wins(rows, F.col("_place"))


def read_benchmarks(spark: SparkSession, folder: str) -> DataFrame:
    """``classifier, id_registro, literal, ground_truth, difficulty`` of all benchmark files."""
    needed = ["id_registro", "literal", "ground_truth", "difficulty"]
    files = CsvFiles(spark, folder, f"{BENCHMARK_PREFIX}*.csv")
    name = F.regexp_replace("stem", BENCHMARK_PREFIX, "")
    return files.records(files.heads.where(files.with_columns(needed))).select(
        F.concat(name, F.lit(BENCHMARK_SUFFIX)).alias("classifier"), *[F.col("record")[c].alias(c) for c in needed]
    )


def described_rows(df: DataFrame) -> DataFrame:
    """Catalogue rows that have a text."""
    return df.where("text IS NOT NULL AND text <> ''")


def write_clean_catalogue(df: DataFrame, path: str) -> None:
    """Write the rows that have a text, with every field quoted."""
    described_rows(df).write.option("header", True).option("quoteAll", True).option("escape", '"').csv(path)
