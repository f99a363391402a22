"""Reverse search: catalogue rows by code or by code prefix."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codeloom.errors import InvalidInput
from codeloom.operators.joins import block_join, dealt_join, joined_rows, lookup_join
from codeloom.schema import REVERSE_INPUT, named, require_positive, validate
from codeloom.session import write_stage

BROADCAST_BYTES = 32 * 1024 * 1024
# Rows that a task puts out, about, where codes with many documents meet many queries.
TASK_ROWS = 1_000_000
# The same without a limit, where files are the smaller the more rows of a code they hold.
ALL_TASK_ROWS = 4_000_000


# Rows of one key that are cut by one task at once: keys with more are dealt to so many parts.
PART_ROWS = 250_000


def first_rows(df: DataFrame, keys: list[str], order: list[str], n: int, part_rows: int | None = None) -> DataFrame:
    """The first ``n`` rows per key, chosen in two steps, so that no key meets in one task before it is cut.

    Spark cuts within the map tasks by itself up to a threshold. Above it keys are counted, and
    the first rows of each part of a frequent key are chosen before those of the key: the more
    rows it has, the more parts.
    """

    def cut(rows: DataFrame, by: list) -> DataFrame:
        place = F.row_number().over(W.partitionBy(*by).orderBy(*order))
        return rows.withColumn("_cut", place).where(F.col("_cut") <= n).drop("_cut")

    if n > int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000")):
        df = cut(deal_parts(df, keys, part_rows or PART_ROWS), [*keys, "_deal"]).select(*[named(c) for c in df.columns])
    return cut(df, keys)


def deal_parts(df: DataFrame, keys: list[str], part_rows: int) -> DataFrame:
    """``df`` with the part of its key, ``_deal``, that each row goes to. Counts combine in the map tasks."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("_rows")).where(F.col("_rows") > part_rows)
    frequent = counts.select(*keys, F.ceil(F.col("_rows") / part_rows).alias("_parts"))
    rows = lookup_join(df, frequent, keys)
    return rows.withColumn("_deal", F.pmod(F.xxhash64(*[named(c) for c in df.columns]), F.coalesce("_parts", F.lit(1)))).drop("_parts")


def mark_repeated(asked: DataFrame, keys: list[str]) -> DataFrame:
    """``asked`` with ``_again``: whether its key may have further rows. Null ids count as repeated."""
    again = asked.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1").select(*keys, F.lit(True).alias("_again"))
    return lookup_join(asked, again, keys).withColumn("_again", F.coalesce("_again", F.col("id").isNull()))


def reverse_search(
    queries: DataFrame,
    catalogue: DataFrame,
    max_n_results: int = 100,
    partial_match: bool = False,
    *,
    by: str | None = None,
    broadcast_bytes: int = BROADCAST_BYTES,
    task_rows: int | None = None,
) -> DataFrame:
    """Rows ``id, doc_id, doc_text, <metadata>`` of ``catalogue`` for each query code.

    With ``by`` both sides carry that column and a query only sees its own catalogue.

    A document matches when its id equals the code, or with ``partial_match`` when it
    starts with the code. Each query id gets its first ``max_n_results`` documents in
    the order of id, text and uuid; -1 returns all of them.

    Prefix matching is an equality join: every document id is spread over its prefixes
    of the lengths the queries ask for. With a limit, no code can contribute more than
    ``max_n_results`` documents to any query, so surplus ones go before the join, and only
    ids that ask more than once are cut again after it.

    Where more than ``task_rows`` rows could come out, they are counted by code, and the join is dealt
    to as many tasks as that takes. Without a limit, blocks of documents meet runs of queries (``block_join``).
    """
    require_positive("max_n_results", max_n_results, unlimited=True)
    own = [by] if by else []
    on = ["_code", *own]
    asked = validate(queries, REVERSE_INPUT).select("id", F.col("doc_id").alias("_code"), *own)
    stats = asked.agg(
        F.count("*").alias("n"),
        F.sum(sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in ["id", "_code", *own]), F.lit(16))).alias("bytes"),
        F.collect_set(F.length("_code")).alias("lengths"),
    ).first()
    if stats["n"] == 0:
        raise InvalidInput("the reverse search has no queries")

    meta = [c for c in catalogue.columns if c not in {"id", "text", "uuid", "embeddings", by}]
    last = ["uuid"] if "uuid" in catalogue.columns else []
    docs = catalogue.where(F.col("id").isNotNull()).select(
        F.col("id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("doc_text"), *own, *meta, *last
    )
    order = ["doc_id", "doc_text", *last]
    if partial_match:
        lengths = F.array(*[F.lit(n) for n in sorted(stats["lengths"])])
        fitting = F.filter(lengths, lambda n: n <= F.length("doc_id"))
        docs = docs.withColumn("_length", F.explode(fitting))
        docs = docs.withColumn("_code", F.substring("doc_id", F.lit(1), F.col("_length"))).drop("_length")
    else:
        docs = docs.withColumn("_code", F.col("doc_id"))

    limited = max_n_results != -1
    task_rows = task_rows or (TASK_ROWS if limited else ALL_TASK_ROWS)
    broadcast = (stats["bytes"] or 0) <= broadcast_bytes
    many = not limited or stats["n"] * max_n_results > task_rows
    if limited and many:
        asked = mark_repeated(asked, ["id", *own])
    if broadcast:
        # Few queries: documents nobody asks for go first, and no query shuffles for the joins.
        docs = docs.join(F.broadcast(asked.select(*on).distinct()), on, "left_semi")
    every = docs
    if limited:
        docs = first_rows(docs, on, order, max_n_results)
    if broadcast:
        rows = joined_rows(every, asked, on, max_n_results).agg(F.sum("_rows").alias("rows")).first()["rows"] or 0 if many else 0
        if rows > task_rows and not limited:
            found = block_join(docs, asked, on, task_rows)
        else:
            docs = docs.repartition(-(-rows // task_rows)) if rows > task_rows else docs
            found = docs.join(F.broadcast(asked), on)
    elif many:
        found = dealt_join(docs, asked, on, joined_rows(every, asked, on, max_n_results), task_rows)
    else:
        found = write_stage(docs, "reverse").join(asked, on)
    if limited and many:
        again = first_rows(found.where("_again"), ["id", *own], order, max_n_results)
        found = found.where("not _again").unionByName(again)
    elif limited:
        found = first_rows(found, ["id", *own], order, max_n_results)
    return found.select("id", "doc_id", "doc_text", *own, *meta)
