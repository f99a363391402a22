"""Accuracy of ranked codes against known ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Top-3 accuracy from which a catalogue counts as viable or borderline.
VIABLE = 0.70
BORDERLINE = 0.50


def hit_columns(codes: Column, truth: Column) -> dict[str, Column]:
    """Whether the best code, and any of the best three, is (one of) the accepted ones.

    ``truth`` is an array of accepted codes.
    """
    return {
        "hit_top1": F.coalesce(F.array_contains(truth, F.get(codes, F.lit(0))), F.lit(False)),
        "hit_top3": F.coalesce(F.arrays_overlap(F.slice(codes, 1, 3), truth), F.lit(False)),
    }


def judge(found: DataFrame, truth: str = "ground_truth") -> DataFrame:
    """Best code, best score and hits of rows that carry their own truth and ``hits``.

    ``truth`` is a code or an array of codes. Rows without results are misses.
    """
    accepted = F.col(truth)
    if found.schema[truth].dataType.typeName() != "array":
        accepted = F.array(accepted.cast("string"))
    codes = F.coalesce(F.transform("hits", lambda h: h["doc_id"]), F.array().cast("array<string>"))
    best = F.get(F.col("hits"), F.lit(0))
    return found.withColumn("_codes", codes).select(
        *[c for c in found.columns if c != "hits"],
        F.array_join(accepted, "|").alias("correct_code"),
        F.coalesce(F.get(F.col("_codes"), F.lit(0)), F.lit("")).alias("top1_code"),
        F.round(F.coalesce(best["score"], F.lit(0.0)), 4).alias("top1_score"),
        *[c.alias(n) for n, c in hit_columns(F.col("_codes"), accepted).items()],
    )


def judge_cases(cases: DataFrame, found: DataFrame, truth: str = "ground_truth", key: str = "query_id") -> DataFrame:
    """``judge`` for results that were found apart from the cases; ``key`` is unique in both."""
    return judge(cases.join(found.select(key, "hits"), key, "left"), truth)


def difficulty_class(note: Column) -> Column:
    return F.substring(note, 1, 1)


def accuracy(judged: DataFrame, by: list[str]) -> DataFrame:
    """Number of cases, top-1 and top-3 rate and mean best score per group."""
    return judged.groupBy(*by).agg(
        F.count("*").alias("total_cases"),
        F.avg(F.col("hit_top1").cast("double")).alias("top1_acc"),
        F.avg(F.col("hit_top3").cast("double")).alias("top3_acc"),
        F.avg("top1_score").alias("mean_score"),
    )


def verdict(top3: Column) -> Column:
    return (
        F.when(top3 >= VIABLE, "viable").when(top3 >= BORDERLINE, "borderline").otherwise("not viable")
    )


def macro_accuracy(per_group: DataFrame) -> DataFrame:
    """All groups together: cases summed, rates averaged without weights."""
    return per_group.agg(
        F.sum("total_cases").alias("total_cases"),
        F.avg("top1_acc").alias("top1_acc"),
        F.avg("top3_acc").alias("top3_acc"),
    ).withColumn("verdict", verdict(F.col("top3_acc")))
