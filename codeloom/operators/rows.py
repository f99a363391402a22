"""Row cleaning, row numbers and removed-row counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codeloom.functions.text import clean, clean_columns, has_text
from codeloom.schema import named
from codeloom.session import Stages, write_stage


def sanitise_catalogue(df: DataFrame) -> DataFrame:
    """Rows with an id and a text, both cleaned; rows that would end up empty are left out."""
    return clean_columns(df.where(has_text(F.col("id")) & has_text(F.col("text"))), ["id", "text"])


def removed_rows(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """How many rows ``sanitise_catalogue`` keeps and removes, in one pass."""
    missing = F.col("id").isNull() | F.col("text").isNull()
    kept = has_text(F.col("id")) & has_text(F.col("text"))
    return df.groupBy(*(by or [])).agg(
        F.count("*").alias("total_rows"),
        F.count_if(missing).alias("missing_rows"),
        F.count_if(~missing & ~kept).alias("blank_rows"),
        F.count_if(kept).alias("kept_rows"),
        F.count_if(~kept).alias("removed_rows"),
    )


def add_uuid(df: DataFrame) -> DataFrame:
    """A random row identity. It changes when recomputed: write the table before using it."""
    return df.withColumn("uuid", F.uuid())


def drop_empty_queries(df: DataFrame, text: str = "query") -> DataFrame:
    """Queries with their text cleaned; those without any text left are dropped."""
    return df.where(has_text(F.col(text))).withColumn(text, clean(F.col(text)))


def number_rows(
    df: DataFrame, order: list[str | Column], name: str = "ordinal", stored: bool = False, stages: Stages | None = None
) -> DataFrame:
    """Number all rows from 0 in the given order; equal rows keep the order they come in.

    The rows are range-partitioned and sorted, and written once with their place in
    the partition. Only the partition sizes, one row each, are then summed up in
    one task; no task ever sees the whole table. The arrival number as the last sort
    key lets a value that many rows share be cut over several partitions. It must not
    change when a task is run again, so it is written out first, unless the rows are
    ``stored``: read from files in the same order each time.
    """
    arrived = df.withColumn("_arrival", F.monotonically_increasing_id())
    if not stored:
        arrived = write_stage(arrived, "arrived", stages)
    by = [*order, "_arrival"]
    placed = write_stage(
        arrived.repartitionByRange(*by).sortWithinPartitions(*by).drop("_arrival").withColumns(
            {"_part": F.spark_partition_id(), "_place": F.monotonically_increasing_id()}
        ),
        "numbered",
        stages,
    )
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_size"), F.min("_place").alias("_first"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select("_part", "_first", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    # One row per partition of the table: bounded by the number of tasks.
    return placed.join(F.broadcast(starts), "_part").select(
        *[named(c) for c in df.columns], (F.col("_start") + F.col("_place") - F.col("_first")).alias(name)
    )


def auto_id(df: DataFrame, order: list[str | Column], name: str = "id", stored: bool = False) -> DataFrame:
    """``r_<ordinal>`` ids for tables that come without one."""
    numbered = number_rows(df, order, "_ordinal", stored)
    return numbered.withColumn(name, F.concat(F.lit("r_"), F.col("_ordinal"))).drop("_ordinal")
