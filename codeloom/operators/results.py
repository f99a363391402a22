"""Operators on search results, flat (one row per hit) or as a ``hits`` column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codeloom.functions.hierarchy import group_prefix, hits_consensus, is_ambiguous, suggested_root
from codeloom.functions.text import strip_punctuation
from codeloom.operators.joins import lookup_join
from codeloom.schema import REVERSE_OUTPUT, SEARCH_OUTPUT, added_columns, named


Keys = Sequence[str]
# What tells queries apart; where several catalogues are searched, their column comes first.
QUERY: Keys = ("query_id",)


def _replace(hit: Column, fields: list[str], **changed: Column) -> Column:
    return F.struct(*[changed.get(f, hit[f]).alias(f) for f in fields])


def _hit_fields(found: DataFrame) -> list[str]:
    return [f.name for f in found.schema["hits"].dataType.elementType.fields]


def drop_duplicate_docs(results: DataFrame, keys: Keys = QUERY) -> DataFrame:
    """Keep the best-ranked row of each document in each query's results."""
    place = W.partitionBy(*keys, "doc_id").orderBy("rank")
    return results.withColumn("_place", F.row_number().over(place)).where("_place = 1").drop("_place")


def rerank_from_zero(results: DataFrame, keys: Keys = QUERY) -> DataFrame:
    """Number each query's rows 0, 1, 2 and so on in the order of their ranks."""
    place = F.row_number().over(W.partitionBy(*keys).orderBy("rank", "doc_id"))
    return results.withColumn("rank", place - 1)


def drop_duplicate_hits(found: DataFrame, rerank: bool = False) -> DataFrame:
    """The same on the ``hits`` column; ``rerank`` numbers the rest from 0. No shuffle."""
    codes = F.transform("hits", lambda h: h["doc_id"])
    first = F.filter("hits", lambda h, i: F.array_position(codes, h["doc_id"]) == i + 1)
    found = found.withColumn("hits", first)
    if rerank:
        fields = _hit_fields(found)
        found = found.withColumn("hits", F.transform("hits", lambda h, i: _replace(h, fields, rank=i)))
    return found


def add_definitions(results: DataFrame, definitions: DataFrame) -> DataFrame:
    """Add ``id_definition`` by document code; null where ``doc_id, definition`` has none."""
    known = definitions.select("doc_id", F.col("definition").alias("id_definition"))
    return lookup_join(results, known, ["doc_id"]).select(*results.columns, "id_definition")


def block_rows(df: DataFrame, blocked: DataFrame, key: str = "doc_id") -> DataFrame:
    """Leave out the rows whose ``key`` is on the block list."""
    return lookup_join(df, blocked.select(key).distinct(), [key], "left_anti").select(*df.columns)


def sort_results(results: DataFrame) -> DataFrame:
    """Search results by query and rank, for reports; other steps need no order."""
    return results.orderBy("query_id", "rank")


def sort_reverse_results(results: DataFrame) -> DataFrame:
    return results.orderBy("id", "doc_id")


def punctuation_free(queries: DataFrame, column: str = "query") -> DataFrame:
    return queries.withColumn(column, strip_punctuation(F.col(column)))


def upper_case(queries: DataFrame, column: str = "query") -> DataFrame:
    return queries.withColumn(column, F.upper(column))


def nest_hits(found: DataFrame, keys: Keys = QUERY) -> DataFrame:
    """One row per query: its ranked results, whether they are ambiguous, and the common root.

    Works row by row on the ``hits`` column, so nothing is grouped.
    """
    fields = [f for f in _hit_fields(found) if f not in {"doc_id", "doc_text", "score", "rank"}]

    def entry(h: Column) -> Column:
        return F.struct(
            h["doc_id"].alias("label"), h["doc_text"].alias("description"),
            h["score"].alias("score"), h["rank"].alias("rank"), *[h[f].alias(f) for f in fields],
        )

    ambiguous, root = hits_consensus(F.col("hits"))
    return found.where(F.size("hits") > 0).select(
        *_input_keys(keys), F.transform("hits", entry).alias("response"),
        ambiguous.alias("is_ambiguous"), root.alias("suggested_root"),
    )


def _input_keys(keys: Keys) -> list[Column]:
    return [F.col(k).alias("input_id") if k == "query_id" else F.col(k) for k in keys]


def nest_results(results: DataFrame, keys: Keys = QUERY) -> DataFrame:
    """``nest_hits`` for flat rows, as they are after a hook.

    Groups by query id; a query has no more rows than the search was asked for.
    """
    extra = added_columns(results, SEARCH_OUTPUT, also=keys)
    entry = F.struct("rank", "doc_id", "doc_text", "score", *[named(c) for c in extra])
    grouped = results.groupBy(*keys).agg(F.sort_array(F.collect_list(entry)).alias("hits"))
    return nest_hits(grouped, keys)


def nest_merged_hits(found: DataFrame, keys: Keys, n_results: int) -> DataFrame:
    """``nest_results`` from a ``hits`` column: rows that share their keys are one query, with its first ``n_results`` hits.

    One shuffle, of lists that are complete already; nothing is exploded.
    """
    kinds = {name: kind for name, kind in SEARCH_OUTPUT.columns}
    lead = ("rank", "doc_id", "doc_text", "score")
    own = [c for c in found.columns if c not in {"hits", *SEARCH_OUTPUT.names, *keys}]
    rest = [f for f in _hit_fields(found) if f not in lead]

    def entry(h: Column) -> Column:
        return F.struct(*[h[f].cast(kinds[f]).alias(f) for f in lead], *[named(c) for c in own], *[h[f].alias(f) for f in rest])

    entries = found.where(F.size("hits") > 0).select(*[F.col(k) for k in keys], F.transform("hits", entry).alias("hits"))
    merged = F.slice(F.sort_array(F.flatten(F.collect_list("hits"))), 1, n_results)
    return nest_hits(entries.groupBy(*keys).agg(merged.alias("hits")), keys)


def nest_reverse_results(results: DataFrame, keys: Keys = ("id",)) -> DataFrame:
    """One row per query id: its documents in code order.

    For results cut to a number of rows per query; a search for all matches (-1)
    can give a query any number of rows and is better left flat.
    """
    extra = added_columns(results, REVERSE_OUTPUT, also=keys)
    entry = F.struct(F.col("doc_id").alias("label"), F.col("doc_text").alias("description"), *[named(c) for c in extra])
    return results.groupBy(*[F.col(k).alias("input_id") if k == "id" else F.col(k) for k in keys]).agg(
        F.sort_array(F.collect_list(entry)).alias("response")
    )


def results_consensus(results: DataFrame, keys: Keys = QUERY) -> DataFrame:
    """Ambiguity and suggested root per query, from flat rows ranked from 1.

    Every aggregate is combined in the map tasks; no list of rows is built.
    """

    def at_rank(rank: int, column: str) -> Column:
        return F.max(F.when(F.col("rank") == rank, F.col(column)))

    grouped = results.groupBy(*keys).agg(
        F.count("*").alias("n_codes"), group_prefix(F.col("doc_id")).alias("common_prefix"),
        at_rank(1, "doc_id").alias("top_code"), at_rank(1, "score").alias("first_score"),
        at_rank(2, "score").alias("second_score"),
    ).withColumn("is_ambiguous", is_ambiguous(F.col("first_score"), F.col("second_score")))
    root = suggested_root(F.col("common_prefix"), F.col("top_code"), F.col("n_codes"), F.col("is_ambiguous"))
    return grouped.withColumn("suggested_root", root)
