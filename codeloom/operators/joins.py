"""Joins to lookup tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codeloom.schema import named
from codeloom.session import write_stage

BROADCAST_BYTES = 64 * 1024 * 1024
# Rows of one key that ``block_join`` puts together: documents in a block, and queries in a run. Their pairs are held at once.
BLOCK_ROWS = 64
RUN_ROWS = 256


def row_bytes(df: DataFrame) -> Column:
    """Size of a row's values as text, plus eight bytes each: an upper bound for what it holds."""
    size = F.lit(0)
    for c in df.columns:
        size = size + F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(0)) + 8
    return size


def table_bytes(df: DataFrame) -> int:
    return df.agg(F.coalesce(F.sum(row_bytes(df)), F.lit(0)).alias("bytes")).first()["bytes"]


def lookup_join(
    rows: DataFrame, lookup: DataFrame, on: list[str], how: str = "left", broadcast_bytes: int = BROADCAST_BYTES, stored: bool = False
) -> DataFrame:
    """Join ``rows`` to a lookup table with (at most) one row per key.

    The lookup table is measured. A small one is broadcast, and the rows stay where
    they are however unevenly their keys are spread. A large one is written out first:
    both inputs of the shuffle join are then plain reads, which is what adaptive
    execution needs to split the partition of a frequent key. One that is ``stored`` is read as it is.
    """
    if table_bytes(lookup) <= broadcast_bytes:
        return rows.join(F.broadcast(lookup), on, how)
    return rows.join(lookup if stored else write_stage(lookup, "lookup"), on, how)


def joined_rows(docs: DataFrame, asked: DataFrame, on: list[str], limit: int = -1) -> DataFrame:
    """``_docs``, ``_asked`` and the rows of their join, ``_rows``, for each key that both have. Counts combine in the map tasks."""
    count = F.count("*")
    held = docs.groupBy(*on).agg((count if limit == -1 else F.least(count, F.lit(limit))).alias("_docs"))
    return held.join(asked.groupBy(*on).agg(count.alias("_asked")), on).withColumn("_rows", F.col("_docs") * F.col("_asked"))


def dealt_join(docs: DataFrame, asked: DataFrame, on: list[str], loads: DataFrame, task_rows: int) -> DataFrame:
    """``docs`` and ``asked`` joined by a shuffle, dealt by what comes out and not by what goes in.

    A key with more than ``task_rows`` rows in the result is dealt to so many parts, or a few more: both of its sides are split,
    and a part of the one meets every part of the other. They are split so that the fewest rows are sent, the larger side more
    often: what is sent grows with the root of ``task_rows`` only, and not with the smaller side times the parts.
    """
    parts = F.ceil(F.col("_rows") / task_rows)
    cuts = F.greatest(F.lit(1), F.least(parts, F.round(F.sqrt(parts * F.col("_docs") / F.col("_asked"))).cast("long")))
    loads = write_stage(loads.select(*on, cuts.alias("_cuts"), F.ceil(parts / cuts).alias("_asked_cuts"), "_docs", "_asked", "_rows"), "loads")
    told = loads.agg(F.sum(F.col("_rows") + F.col("_docs") + F.col("_asked")).alias("rows")).first()["rows"] or 0
    # Fewer than this Spark would deal a second time.
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-told // task_rows))
    loads = loads.select(*on, "_cuts", "_asked_cuts")

    def dealt(side: DataFrame, own: str, other: str, place: list[str]) -> DataFrame:
        rows = lookup_join(side, loads, on, "inner", stored=True)
        rows = rows.withColumn(place[0], F.pmod(F.xxhash64(*[named(c) for c in side.columns]), F.col(own)))
        rows = rows.withColumn(place[1], F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1)))
        return rows.select(*[named(c) for c in side.columns], "_cut", "_asked_cut").repartition(tasks, *on, "_cut", "_asked_cut")

    docs, asked = dealt(docs, "_cuts", "_asked_cuts", ["_cut", "_asked_cut"]), dealt(asked, "_asked_cuts", "_cuts", ["_asked_cut", "_cut"])
    return docs.join(asked, [*on, "_cut", "_asked_cut"]).drop("_cut", "_asked_cut")


def block_join(docs: DataFrame, asked: DataFrame, on: list[str], task_rows: int) -> DataFrame:
    """``docs`` joined to a broadcast ``asked``, for results that are far larger than both.

    A key's documents are dealt to parts by the rows that come out, and put in blocks within them, its queries in runs. Every
    block meets every run, and only then are they taken apart: neighbouring rows share their document or repeat a
    run, so a file holds few different values in short cycles, which is what keeps it small. The numbers by which
    rows go to blocks are frozen by a write, so equal rows are dealt apart as well.
    """
    docs = write_stage(docs.withColumn("_row", F.monotonically_increasing_id()), "documents")
    parts = F.ceil(F.col("_rows") / task_rows)
    blocks = parts * F.ceil(F.col("_docs") / (parts * BLOCK_ROWS))
    loads = joined_rows(docs, asked, on).select(
        *on, parts.alias("_parts"), blocks.alias("_blocks"), F.ceil(F.col("_asked") / RUN_ROWS).alias("_runs"), "_rows"
    )
    loads = write_stage(loads, "loads")
    tasks = max(1, -(-(loads.agg(F.sum("_rows").alias("rows")).first()["rows"] or 0) // task_rows))

    def held(side: DataFrame) -> Column:
        return F.collect_list(F.struct(*[named(c) for c in side.columns if c not in {*on, "_row"}]))

    place = F.row_number().over(W.partitionBy(*on).orderBy(*[named(c) for c in asked.columns if c not in on])) - 1
    runs = asked.withColumn("_run", F.floor(place / RUN_ROWS)).groupBy(*on, "_run").agg(held(asked).alias("_asked"))
    dealt = lookup_join(docs, loads.drop("_rows"), on, "inner", stored=True)
    dealt = dealt.withColumn("_block", F.pmod(F.xxhash64("_row"), F.col("_blocks"))).withColumn("_part", F.col("_block") % F.col("_parts"))
    # A block is put together once for each run, as Spark holds all that comes out of one row.
    dealt = dealt.repartition(tasks, *on, "_part").withColumn("_run", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_runs") - 1)))
    met = dealt.groupBy(*on, "_part", "_block", "_run").agg(held(docs).alias("_docs")).join(F.broadcast(runs), [*on, "_run"])
    return met.select(*on, "_asked", F.inline("_docs")).select("*", F.inline("_asked")).drop("_asked")
